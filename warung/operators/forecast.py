"""Weekly profit forecast: series, features, split, models, scores, champion,
feature impact and the page's result views (M0-M11, B6, T5).

What the dashboard fixes is the shape of the result tables (``skor``,
``prediksi``, ``dampak``, ``meta``) and their meaning: the first weeks train,
the last weeks test, the champion is the lowest MAPE, impact is coefficient
times the training standard deviation of the feature.  The model list, the
features and the regularization values below are our choice.

Scale: the only heavy step is the weekly aggregate of the sales fact (a
partial aggregate and one shuffle of week keys).  The weekly series is as
long as the covered time span (52 rows a year) whatever the data volume, so
the global windows over it (lags, row numbers) and the MLlib fits run on a
frame of a few hundred rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from warung.fixed_values import (METRICS, SERIES_ACTUAL, SERIES_PREDICTED_PREFIX,
                                 TOP_IMPACT)
from warung.session import materialized
from warung.functions.scalars import (dash_if_missing, fixed_text, money_text,
                                      percent_text, plain_text, signed_text)

WEEKLY = "decimal(24,4)"
TEST_WEEKS = 52
SEASON = 52
FEATURES = ["t", "lag_1", "lag_2", "lag_4", "lag_52", "mean_4"]


@dataclass(frozen=True)
class LinearSpec:
    name: str
    reg_param: float | None
    elastic_net: float


# Penalties are chosen from GRID by time-ordered validation (see ``tuned``);
# the target is near 10^6, so the grid is wide.
GRID = [0.1, 1e3, 1e4, 1e5, 1e6]
VALIDATION_WEEKS = 26
MAX_ITER = 500
LINEAR_MODELS = [LinearSpec("Linear Regression", 0.0, 0.0),
                 LinearSpec("Ridge", None, 0.0),
                 LinearSpec("Lasso", None, 1.0)]
NAIVE_MODELS = {"Naive (lag 1)": "lag_1", "Seasonal naive (lag 52)": "lag_52",
                "Mean of last 4 weeks": "mean_4"}
SINGLE_MODELS = {f"OLS on {c}": c for c in ("t", "lag_1", "lag_52", "mean_4")}
RUN_A, RUN_B = "MLlib", "SQL closed form"


# ------------------------------------------------------------- M1 series
def weekly_profit(sales: DataFrame) -> DataFrame:
    """M1: weekly profit (Monday weeks) over the *full* weeks of the data;
    a week without sales is 0; ``t`` numbers the weeks from 1.

    The partial first and last weeks are left out, so every week sums seven
    days of data.  One pass over the fact: the per-week aggregate also
    carries each week's first and last day; windows over the (time-span
    bounded) week series then give the full-week range and fill empty weeks
    between consecutive non-empty ones.
    """
    per = (sales.where(F.col("tanggal").isNotNull())
           .groupBy(F.trunc(F.col("tanggal").cast("date"), "week").alias("week"))
           .agg(F.sum("profit").alias("profit"),
                F.min("tanggal").cast("date").alias("d_lo"),
                F.max("tanggal").cast("date").alias("d_hi")))
    everything = Window.partitionBy()
    step = F.expr("INTERVAL 7 DAYS")
    bounded = (per
               .withColumn("first", F.trunc(F.date_add(F.min("d_lo").over(everything), 6), "week"))
               .withColumn("last", F.trunc(F.date_sub(F.max("d_hi").over(everything), 6), "week"))
               .withColumn("nxt", F.lead("week").over(Window.orderBy("week"))))
    upto = F.coalesce(F.date_sub(F.col("nxt"), 7), F.col("week"))
    filled = (bounded
              .select(F.posexplode(F.sequence(F.col("week"), upto, step)).alias("i", "wk"),
                      "profit", "first", "last")
              .where((F.col("wk") >= F.col("first")) & (F.col("wk") <= F.col("last"))))
    t = F.row_number().over(Window.orderBy("week")).cast("bigint")
    return (filled
            .select(F.col("wk").cast("timestamp_ntz").alias("week"),
                    F.when(F.col("i") == 0, F.col("profit")).otherwise(F.lit(0))
                     .cast(WEEKLY).alias("profit"))
            .withColumn("t", t))


def forecast_frame(weekly: DataFrame, test_weeks: int = TEST_WEEKS) -> DataFrame:
    """M1/M2: lag features and the time-ordered split.

    Features only look back (``lag``), so a week never sees its own value; the
    last ``test_weeks`` weeks are ``test`` and every one of them lies after
    every ``train`` week.  A row is ``usable`` once all its lags exist.
    """
    w = Window.orderBy("t")
    lag = lambda k: F.lag("profit", k).over(w)
    n = F.max("t").over(Window.partitionBy())
    return (weekly
            .select("week", "t", "profit", lag(1).alias("lag_1"), lag(2).alias("lag_2"),
                    lag(3).alias("lag_3"), lag(4).alias("lag_4"), lag(SEASON).alias("lag_52"),
                    n.alias("n_weeks"))
            .withColumn("mean_4", F.round((F.col("lag_1") + F.col("lag_2") + F.col("lag_3")
                                           + F.col("lag_4")) * F.lit(Decimal("0.25")), 4))
            .withColumn("split", F.when(F.col("t") > F.col("n_weeks") - test_weeks, "test")
                        .otherwise("train"))
            .withColumn("usable", F.col("lag_52").isNotNull() & F.col("mean_4").isNotNull())
            .drop("n_weeks"))


def training_meta(frame: DataFrame) -> DataFrame:
    """M9: train weeks, test weeks and the cut-off (first test week)."""
    u = frame.where("usable")
    return u.agg(F.sum(F.when(F.col("split") == "train", 1).otherwise(0)).cast("int").alias("n_latih"),
                 F.sum(F.when(F.col("split") == "test", 1).otherwise(0)).cast("int").alias("n_uji"),
                 F.min(F.when(F.col("split") == "test", F.col("week"))).alias("batas"))


# -------------------------------------------------------- M3/M4 models
def naive_predictions(frame: DataFrame) -> DataFrame:
    """Naive yardsticks on the test weeks: last week, same week last year,
    mean of the last four weeks.  Plain columns, no fitting."""
    test = frame.where((F.col("split") == "test") & F.col("usable"))
    stack = F.explode(F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(col).cast("double").alias("prediksi"))
        for name, col in NAIVE_MODELS.items()]))
    return (test.select("week", F.col("profit").cast("double").alias("aktual"), stack.alias("p"))
            .select(F.col("p.model").alias("model"), "week", "aktual", "p.prediksi"))


def score(predictions: DataFrame) -> DataFrame:
    """M4: R², RMSE, MSE and MAPE (a fraction) per model on the test weeks.

    R² = 1 - SSE / (n * population variance of the actuals); MAPE skips weeks
    whose actual is 0.  Values are rounded (R² and MAPE to 9 decimals, RMSE
    to 4, MSE to whole units) so they do not depend on the order in which a
    distributed sum adds its terms.
    """
    e = F.col("aktual") - F.col("prediksi")
    per = (predictions.groupBy("model")
           .agg(F.avg(e * e).alias("mse"),
                F.sum(e * e).alias("sse"),
                (F.count(F.lit(1)) * F.var_pop("aktual")).alias("sst"),
                F.avg(F.abs(e) / F.nullif(F.abs(F.col("aktual")), F.lit(0.0))).alias("mape")))
    return per.select(
        "model",
        F.round(F.lit(1.0) - F.col("sse") / F.nullif(F.col("sst"), F.lit(0.0)), 9).alias("r2"),
        F.round(F.sqrt("mse"), 4).alias("rmse"),
        F.round("mse", 0).alias("mse"),
        F.round("mape", 9).alias("mape"))


def _design(frame: DataFrame) -> DataFrame:
    cols = [F.col(c).cast("double").alias(c) for c in FEATURES]
    return frame.where("usable").select("week", "split", F.col("profit").cast("double").alias("y"), *cols)


def _fit(spec: LinearSpec, reg_param: float, train: DataFrame):
    """One MLlib fit; a solver that stops at its iteration limit is an error."""
    lr = LinearRegression(featuresCol="features", labelCol="y", predictionCol="prediksi",
                          regParam=reg_param, elasticNetParam=spec.elastic_net,
                          solver="normal", maxIter=MAX_ITER, tol=1e-9)
    model = lr.fit(train)
    if model.summary.totalIterations >= MAX_ITER:
        raise RuntimeError(f"{spec.name} did not converge in {MAX_ITER} iterations")
    return model


@dataclass(frozen=True)
class Gram:
    """Moments of features and label over the weeks ``t <= edge`` (all, if
    none): count, means and population covariances, the label last.  A few
    dozen numbers whatever the length of the series."""
    n: int
    mean: np.ndarray
    cov: np.ndarray

    def merged(self, other: "Gram") -> "Gram":
        """The moments of both sets of weeks together."""
        if not self.n or not other.n:
            return self if self.n else other
        n, d = self.n + other.n, other.mean - self.mean
        cov = (self.n * self.cov + other.n * other.cov) / n + np.outer(d, d) * (self.n * other.n / n ** 2)
        return Gram(n, self.mean + d * (other.n / n), cov)


def _train_weeks(data: DataFrame) -> DataFrame:
    """The training weeks with ``late``: is it one of the last VALIDATION_WEEKS."""
    late = F.col("t") > F.max("t").over(Window.partitionBy()) - VALIDATION_WEEKS
    return data.where(F.col("split") == "train").withColumn("late", late)


def gram_folds(data: DataFrame) -> tuple[Gram, Gram]:
    """The training weeks' moments before and in the last VALIDATION_WEEKS,
    both from one aggregate (two rows)."""
    cols = [*FEATURES, "y"]
    sums = [F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)]
    sums += [F.covar_pop(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    got = {r["late"]: r for r in _train_weeks(data).groupBy("late").agg(F.count(F.lit(1)).alias("n"), *sums).collect()}

    def gram(r) -> Gram:
        k = len(cols)
        if r is None:
            return Gram(0, np.zeros(k), np.zeros((k, k)))
        return Gram(r["n"], np.array([r[f"m_{i}"] for i in range(k)]),
                    np.array([[r[f"c_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]))

    return gram(got.get(False)), gram(got.get(True))


def gram_fits(gram: Gram, elastic_net: float, penalties: list[float]) -> list[tuple[np.ndarray, float]]:
    """(coefficients, intercept) for every penalty, from the moments alone.

    Features and label are standardized; a penalty ``r`` becomes ``r / sd(y)``.
    Ridge (0): one eigendecomposition serves all penalties.  Lasso (1):
    coordinate descent on the correlations, from the largest penalty down, each
    starting at the last solution.  A feature without variance gets 0."""
    k = len(FEATURES)
    sd = np.sqrt(np.diag(gram.cov))
    used = np.flatnonzero(sd[:k] > 0)
    out = {r: np.zeros(k) for r in penalties}
    if len(used) and sd[k] > 0:
        corr = gram.cov[np.ix_(used, used)] / np.outer(sd[used], sd[used])
        target = gram.cov[used, k] / (sd[used] * sd[k])
        if elastic_net == 0.0:
            values, vectors = np.linalg.eigh(corr)
            turned = vectors.T @ target
        elif elastic_net != 1.0:
            raise ValueError("closed forms exist for ridge (0) and lasso (1) only")
        w = np.zeros(len(used))
        for r in sorted(penalties, reverse=True):
            bound = r / sd[k]
            if elastic_net == 0.0:
                w = vectors @ (turned / (values + bound))
            else:
                w = _descend(corr, target, bound, w)
            out[r][used] = w * sd[k] / sd[used]
    return [(out[r], float(gram.mean[k] - out[r] @ gram.mean[:k])) for r in penalties]


def _descend(corr: np.ndarray, target: np.ndarray, bound: float, w: np.ndarray, rounds: int = 100_000) -> np.ndarray:
    """Coordinate descent for the lasso on correlations; not converging is an error."""
    w = w.copy()
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(w)):
            rest = target[j] - corr[j] @ w + w[j]
            new = np.sign(rest) * max(abs(rest) - bound, 0.0)
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < 1e-13:
            return w
    raise RuntimeError(f"the lasso did not converge in {rounds} rounds")


def linear(coef: np.ndarray, base: float):
    """The prediction of a linear model as a column."""
    value = F.lit(float(base))
    for c, n in zip(coef, FEATURES):
        value = value + F.lit(float(c)) * F.col(n)
    return value


def tuned(specs: list[LinearSpec], data: DataFrame, early: Gram, grid: list[float] = GRID) -> dict[str, float]:
    """Each model's penalty: its own, or that of the grid with the lowest MAPE
    on the last VALIDATION_WEEKS training weeks, fitted on the weeks before them
    (ties: the smaller).  All candidates are scored in one aggregate."""
    open_specs = [s for s in specs if s.reg_param is None]
    fixed = {s.name: s.reg_param for s in specs if s.reg_param is not None}
    if not open_specs:
        return fixed
    late = _train_weeks(data).where("late")
    error = lambda value: F.avg(F.abs(F.col("y") - value) / F.nullif(F.abs(F.col("y")), F.lit(0.0)))
    fits = {s.name: gram_fits(early, s.elastic_net, grid) for s in open_specs}
    got = late.agg(*[error(linear(*fit)).alias(f"{name}_{i}") for name, of in fits.items() for i, fit in enumerate(of)]).first()
    best = {name: min((got[f"{name}_{i}"], r) for i, r in enumerate(grid))[1] for name in fits}
    return {s.name: fixed[s.name] if s.name in fixed else best[s.name] for s in specs}


def fit_linear_models(frame: DataFrame, specs: list[LinearSpec] = LINEAR_MODELS):
    """M3: MLlib linear regressions on the training weeks (normal equations;
    for the L1 model MLlib falls back to an iterative solver).  Returns test
    predictions, the coefficients (model, fitur, coef), the training weeks and
    the penalty of each model.

    Penalties are chosen from moments (``gram_folds``, ``tuned``), so MLlib
    fits each model once.  The weekly frame (52 rows a year) is written once and
    read back, so the fits do not recompute it and nothing stays cached.
    """
    data = materialized(_design(frame), "forecast-frame")
    penalties = tuned(specs, data, gram_folds(data)[0])
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    train = data.where(F.col("split") == "train")
    ready, test = assembler.transform(train), assembler.transform(data.where(F.col("split") == "test"))
    preds, coefs = [], []
    for spec in specs:
        model = _fit(spec, penalties[spec.name], ready)
        preds.append(model.transform(test)
                     .select(F.lit(spec.name).alias("model"), "week", F.col("y").alias("aktual"),
                             "prediksi"))
        coefs += [(spec.name, f, float(c)) for f, c in zip(FEATURES, model.coefficients.toArray())]
    pred = preds[0]
    for p in preds[1:]:
        pred = pred.unionByName(p)
    coef_df = frame.sparkSession.createDataFrame(coefs, "model string, fitur string, coef double")
    return pred, coef_df, train, penalties


def closed_form(frame: DataFrame, penalties: dict[str, float], specs: list[LinearSpec] = LINEAR_MODELS) -> DataFrame:
    """Run B: the same models without MLlib, from the moments of the training
    weeks (one aggregate) by ``gram_fits``; the predictions are a projection."""
    data = _design(frame)
    early, late = gram_folds(data)
    gram = early.merged(late)
    if not gram.n:
        return data.limit(0).select(F.lit("").alias("model"), "week", F.col("y").alias("aktual"), F.col("y").alias("prediksi"))
    test = data.where(F.col("split") == "test")
    stack = F.explode(F.array(*[
        F.struct(F.lit(s.name).alias("model"), linear(*gram_fits(gram, s.elastic_net, [penalties[s.name]])[0]).alias("prediksi"))
        for s in specs])).alias("p")
    return test.select("week", F.col("y").alias("aktual"), stack).select("p.model", "week", "aktual", "p.prediksi")


def single_fits(frame: DataFrame) -> DataFrame:
    """One-feature least squares on the training weeks by SQL aggregates:
    (model, fitur, coef, intercept, dampak), ``dampak`` as in M11."""
    train = _design(frame).where(F.col("split") == "train")
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(c).alias("fitur"), F.col(c).alias("x"))
                                for m, c in SINGLE_MODELS.items()])).alias("s")
    fit = train.select("y", stack).select("s.model", "s.fitur", "s.x", "y").groupBy("model", "fitur").agg(
        F.regr_slope("y", "x").alias("coef"), F.regr_intercept("y", "x").alias("intercept"), F.stddev_samp("x").alias("sd"))
    return fit.select("model", "fitur", "coef", "intercept", (F.col("coef") * F.col("sd")).alias("dampak"))


def single_predictions(frame: DataFrame) -> DataFrame:
    """Test-week predictions of the one-feature models (four rows of fits)."""
    test = _design(frame).where(F.col("split") == "test")
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("fitur"), F.col(c).alias("x")) for c in SINGLE_MODELS.values()])).alias("s")
    return (test.select("week", F.col("y").alias("aktual"), stack).select("week", "aktual", "s.fitur", "s.x")
            .join(F.broadcast(single_fits(frame)), "fitur")
            .select("model", "week", "aktual", (F.col("intercept") + F.col("coef") * F.col("x")).alias("prediksi")))


def plain_forecast(frame: DataFrame) -> dict[str, DataFrame]:
    """The result tables over models that SQL states in full: the naive
    yardsticks and the one-feature fits."""
    predictions = naive_predictions(frame).unionByName(single_predictions(frame))
    skor = pick_champion(score(predictions)).withColumn("reg_param", F.lit(None).cast("double"))
    prediksi = predictions.join(F.broadcast(skor.where("terbaik").select("model")), "model", "left_semi")
    return {"skor": skor, "prediksi": prediksi.select("week", "aktual", "prediksi", "model"),
            "dampak": single_fits(frame).select("model", "fitur", "dampak"), "meta": training_meta(frame)}


def feature_impact(coefs: DataFrame, train: DataFrame) -> DataFrame:
    """Coefficient x sample standard deviation (ddof 1) of the feature
    over the training weeks, per model and feature."""
    sd = train.agg(*[F.stddev_samp(c).alias(c) for c in FEATURES])
    sd_long = sd.unpivot([], FEATURES, "fitur", "sd")
    return (coefs.join(F.broadcast(sd_long), "fitur")
            .select("model", "fitur", (F.col("coef") * F.col("sd")).alias("dampak")))


def pick_champion(scores: DataFrame) -> DataFrame:
    """Mark the lowest-MAPE model (ties by name) as ``terbaik``."""
    rn = F.row_number().over(Window.orderBy(F.col("mape").asc_nulls_last(), F.col("model")))
    return scores.withColumn("terbaik", rn == 1)


def build_forecast(sales: DataFrame, test_weeks: int = TEST_WEEKS) -> dict[str, DataFrame]:
    """M1 -> M2 -> M3/M4 -> M10 -> M11; the four result tables.

    ``skor``: one row per model — run A (MLlib) scores, run B (closed form)
    scores in the ``*_b`` columns for the models that have one, ``reg_param``
    NULL for the naive yardsticks.
    """
    frame = materialized(forecast_frame(weekly_profit(sales), test_weeks), "forecast-weeks")
    naive = naive_predictions(frame)
    lin_a, coefs, train, penalties = fit_linear_models(frame)
    params = frame.sparkSession.createDataFrame(list(penalties.items()), "model string, reg_param double")
    run_b = score(closed_form(frame, penalties)).select("model", *[F.col(c).alias(f"{c}_b") for c in ("r2", "rmse", "mse", "mape")])
    predictions = naive.unionByName(lin_a)
    skor = pick_champion(score(predictions)
                         .join(F.broadcast(params), "model", "left")
                         .join(F.broadcast(run_b), "model", "left"))
    champion = skor.where("terbaik").select("model")
    prediksi = (predictions.join(F.broadcast(champion), "model", "left_semi")
                .select(F.col("week"), "aktual", "prediksi", "model"))
    return {"skor": skor, "prediksi": prediksi,
            "dampak": feature_impact(coefs, train),
            "meta": training_meta(frame)}


# ---------------------------------------------------- page result views
def model_card(skor: DataFrame) -> DataFrame:
    """The champion's name, R², RMSE and MAPE in percent, with the
    card texts; no row when no model is marked."""
    best = skor.where(F.col("terbaik")).orderBy(F.col("mape").asc_nulls_last(), "model").limit(1)
    return best.select("model", "r2", "rmse", (F.col("mape") * 100).alias("mape_pct"),
                       plain_text(F.col("r2"), 3).alias("r2_text"),
                       money_text(F.col("rmse")).alias("rmse_text"),
                       percent_text(F.col("mape") * 100).alias("mape_text"))


def predicted_vs_actual(prediksi: DataFrame, model_name: str | None = None) -> DataFrame:
    """The test-period series in long form (week, series, value)."""
    name = F.lit(model_name) if model_name else F.col("model") if "model" in prediksi.columns \
        else F.lit("model")
    return (prediksi.select("week", F.lit(SERIES_ACTUAL).alias("a_name"),
                            F.concat(F.lit(SERIES_PREDICTED_PREFIX), name).alias("p_name"),
                            "aktual", "prediksi")
            .select("week", F.explode(F.array(
                F.struct(F.col("a_name").alias("series"), F.col("aktual").alias("value")),
                F.struct(F.col("p_name").alias("series"), F.col("prediksi").alias("value")))).alias("s"))
            .select("week", "s.series", "s.value")
            .orderBy("week", "series"))


def compare_engines(skor: DataFrame, metric: str = "RMSE", suffix: str = "_b",
                    run_a: str = RUN_A, run_b: str = RUN_B) -> DataFrame:
    """One metric from two score runs side by side, scaled for
    display; only models whose run-B R² exists take part."""
    col, scale, _ = METRICS[metric]
    other = f"r2{suffix}"
    have = skor.where(F.col(other).isNotNull() & ~F.isnan(F.col(other)))
    fmt = {"r2": lambda c: plain_text(c, 3), "rmse": money_text,
           "mape": lambda c: percent_text(c, 1)}[col]
    long = have.select("model", F.explode(F.array(
        F.struct(F.lit(run_b).alias("run"), (F.col(f"{col}{suffix}") * scale).alias("value")),
        F.struct(F.lit(run_a).alias("run"), (F.col(col) * scale).alias("value")))).alias("r"))
    return long.select("model", "r.run", "r.value", fmt(F.col("r.value")).alias("text"))


def score_table(skor: DataFrame) -> DataFrame:
    """Model, regParam, R², MAPE, RMSE, MSE with display texts
    (missing values print "—")."""
    return skor.select(
        "model", "reg_param", "r2", "mape", "rmse", "mse",
        dash_if_missing(fixed_text(F.col("reg_param"), 3)).alias("reg_param_text"),
        dash_if_missing(plain_text(F.col("r2"), 4)).alias("r2_text"),
        dash_if_missing(plain_text(F.col("mape"), 4)).alias("mape_text"),
        dash_if_missing(fixed_text(F.col("rmse"), 0)).alias("rmse_text"),
        dash_if_missing(fixed_text(F.col("mse"), 0)).alias("mse_text"))


def feature_impact_top(dampak: DataFrame, model_name: str | None = None,
                       n: int = TOP_IMPACT) -> DataFrame:
    """The n features with the largest absolute impact (sign
    kept, ties by name), their sign class and whether any shown is negative."""
    d = dampak if model_name is None or "model" not in dampak.columns \
        else dampak.where(F.col("model") == model_name)
    top = (d.where(F.col("dampak").isNotNull() & ~F.isnan("dampak"))
           .orderBy(F.abs("dampak").desc(), "fitur").limit(n))
    rank = F.row_number().over(Window.orderBy(F.abs("dampak").desc(), "fitur"))
    any_neg = F.max(F.col("dampak") < 0).over(Window.partitionBy())
    return top.select(rank.alias("rank"), "fitur", "dampak",
                      F.when(F.col("dampak") >= 0, "positive").otherwise("negative").alias("sign"),
                      signed_text(F.col("dampak")).alias("text"),
                      any_neg.alias("any_negative"))


def champion_for_impact(skor: DataFrame, dampak: DataFrame) -> DataFrame:
    """The model whose impacts the page shows: the champion when it has
    coefficients, else the best (lowest MAPE) model that has them."""
    with_coef = dampak.select("model").distinct()
    return (skor.join(with_coef, "model", "left_semi")
            .orderBy(F.col("terbaik").desc(), F.col("mape").asc_nulls_last(), "model")
            .limit(1).select("model"))
