import datetime as dt
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from helpers import SALES_SCHEMA
from warung.operators import forecast as FC

SKOR_SCHEMA = ("model string, reg_param double, r2 double, rmse double, mse double, mape double, "
               "r2_b double, rmse_b double, mse_b double, mape_b double")


def scores(spark):
    rows = [("Linear", 0.0, 0.9, 100.0, 1e4, 0.05, 0.89, 101.0, 1.02e4, 0.051),
            ("Ridge", 0.1, 0.8, 120.0, 1.44e4, 0.07, 0.8, 121.0, 1.46e4, 0.071),
            ("Naive", None, 0.5, 200.0, 4e4, 0.2, None, None, None, None)]
    return FC.pick_champion(spark.createDataFrame(rows, SKOR_SCHEMA))


def test_champion_card(spark):
    s = scores(spark)
    assert [r.model for r in s.where("terbaik").collect()] == ["Linear"]
    card = FC.model_card(s).first()
    assert (card.model, card.r2_text, card.rmse_text, card.mape_text) == ("Linear", "0.900", "$100", "5.0%")


def test_no_champion_gives_no_card(spark):
    s = scores(spark).withColumn("terbaik", F.lit(False))
    assert FC.model_card(s).count() == 0


def test_compare_two_runs(spark):
    rows = FC.compare_engines(scores(spark), "MAPE").collect()
    assert len(rows) == 4 and {r.model for r in rows} == {"Linear", "Ridge"}
    got = {(r.model, r.run): r.text for r in rows}
    assert got[("Linear", FC.RUN_A)] == "5.0%" and got[("Linear", FC.RUN_B)] == "5.1%"


def test_score_table_dash_for_missing(spark):
    rows = {r.model: r for r in FC.score_table(scores(spark)).collect()}
    assert rows["Naive"].reg_param_text == "—"
    assert rows["Ridge"].reg_param_text == "0.100"
    assert rows["Linear"].rmse_text == "100" and rows["Linear"].r2_text == "0.9000"


def test_impact_order_and_sign(spark):
    d = spark.createDataFrame([("b", 3.0), ("a", -3.0), ("c", 2.0), ("d", 1.0)], "fitur string, dampak double")
    rows = FC.feature_impact_top(d).collect()
    assert [(r.fitur, r.dampak, r.sign) for r in rows] == [
        ("a", -3.0, "negative"), ("b", 3.0, "positive"), ("c", 2.0, "positive"), ("d", 1.0, "positive")]
    assert rows[0].text == "-3" and rows[1].text == "+3" and all(r.any_negative for r in rows)


def _weekly_sales(spark, start, days):
    rows = []
    for i in range(days):
        day = start + dt.timedelta(days=i)
        rows.append((day, "A", "Complete", 1, 1, Decimal("1"), Decimal(str((i % 7) + 1))))
    return spark.createDataFrame(rows, SALES_SCHEMA)


def test_weekly_profit_full_weeks_only(spark):
    s = _weekly_sales(spark, dt.datetime(2024, 1, 3), 30)  # Wed 3 Jan .. Thu 1 Feb
    w = FC.weekly_profit(s).collect()
    assert [r.week.day for r in w] == [8, 15, 22]
    assert all(r.profit == Decimal("28") for r in w) and [r.t for r in w] == [1, 2, 3]


def test_frame_is_leak_free_and_time_ordered(spark):
    s = _weekly_sales(spark, dt.datetime(2020, 1, 6), 7 * 130)
    fr = FC.forecast_frame(FC.weekly_profit(s)).collect()
    by_t = {r.t: r for r in fr}
    assert all(by_t[t].lag_1 == by_t[t - 1].profit for t in by_t if t > 1)
    assert all(by_t[t].lag_52 == by_t[t - 52].profit for t in by_t if t > 52)
    test_weeks = [r.week for r in fr if r.split == "test"]
    train_weeks = [r.week for r in fr if r.split == "train"]
    assert len(test_weeks) == FC.TEST_WEEKS and max(train_weeks) < min(test_weeks)
    meta = FC.training_meta(FC.forecast_frame(FC.weekly_profit(s))).first()
    assert meta.n_uji == 52 and meta.n_latih == 130 - 52 - 52 and meta.batas == min(test_weeks)


def test_single_feature_ols_matches_sql(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    rows = [(float(x), 3.0 * x + 2.0 + ((x * 7) % 5) - 2.0) for x in range(40)]
    df = spark.createDataFrame(rows, "x double, y double")
    m = LinearRegression(featuresCol="f", labelCol="y", solver="normal").fit(
        VectorAssembler(inputCols=["x"], outputCol="f").transform(df))
    sql = df.agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a")).first()
    assert round(m.coefficients[0], 9) == round(sql.b, 9)
    assert round(m.intercept, 9) == round(sql.a, 9)


def test_naive_scores_by_hand(spark):
    pred = spark.createDataFrame([("m", 10.0, 8.0), ("m", 20.0, 25.0), ("m", 0.0, 1.0)],
                                 "model string, aktual double, prediksi double")
    r = FC.score(pred).first()
    sse = 4 + 25 + 1
    mean = 10.0
    sst = (0 + 100 + 100)
    assert r.mse == round(sse / 3, 0) and r.rmse == round((sse / 3) ** 0.5, 4)
    assert r.r2 == round(1 - sse / sst, 9) and r.mape == round((2 / 10 + 5 / 20) / 2, 9)
    assert mean == 10.0


def test_mllib_ols_matches_least_squares_on_real_series(spark):
    import numpy as np

    from warung.sources import marts as M
    fs = M.build_marts(spark, "/root/testdata/sf0.001")["fact_sales"]
    frame = FC.forecast_frame(FC.weekly_profit(fs))
    spec = [FC.LinearSpec("ols", 0.0, 0.0)]
    _, coefs, train, _ = FC.fit_linear_models(frame, spec)
    rows = train.select("y", *FC.FEATURES).collect()   # the weekly series: bounded, small
    X = np.array([[1.0] + [r[c] for c in FC.FEATURES] for r in rows])
    y = np.array([r["y"] for r in rows])
    beta = np.linalg.lstsq(X, y, rcond=None)[0][1:]
    got = {r.fitur: r.coef for r in coefs.collect()}
    for f, b in zip(FC.FEATURES, beta):
        assert abs(got[f] - b) <= 1e-6 * max(1.0, abs(b)), (f, got[f], b)
    # impact = coefficient x sample standard deviation on the training rows
    imp = {r.fitur: r.dampak for r in FC.feature_impact(coefs, train).collect()}
    for j, f in enumerate(FC.FEATURES):
        assert abs(imp[f] - got[f] * np.std(X[:, j + 1], ddof=1)) <= 1e-6 * max(1.0, abs(imp[f]))


def test_closed_form_agrees_with_mllib(spark):
    """Run B shares no code with run A; the penalties mean the same in both."""
    from warung.sources import marts as M
    frame = FC.forecast_frame(FC.weekly_profit(M.build_marts(spark, "/root/testdata/sf0.001")["fact_sales"]))
    specs = [FC.LinearSpec("ols", 0.0, 0.0), FC.LinearSpec("ridge", 1e4, 0.0), FC.LinearSpec("lasso", 1e3, 1.0)]
    a, _, _, penalties = FC.fit_linear_models(frame, specs)
    b = FC.closed_form(frame, penalties, specs)
    run_a = {(r.model, r.week): r.prediksi for r in a.collect()}
    run_b = {(r.model, r.week): r.prediksi for r in b.collect()}
    assert {m for m, _ in run_b} == {"ols", "ridge", "lasso"}
    for k, v in run_b.items():
        assert abs(run_a[k] - v) <= 1e-6 * max(1.0, abs(v)), k


def _fold(x, y):
    z = np.column_stack([x, y])
    return FC.Gram(len(y), z.mean(axis=0), np.cov(z.T, bias=True))


def test_moments_of_folds_add_up():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(60, 6)) * [1, 5, 5, 2, 9, 1] + 3, rng.normal(size=60)
    whole, parts = _fold(x, y), _fold(x[:41], y[:41]).merged(_fold(x[41:], y[41:]))
    assert parts.n == 60 and np.allclose(parts.mean, whole.mean) and np.allclose(parts.cov, whole.cov)
    empty = FC.Gram(0, np.zeros(7), np.zeros((7, 7)))
    assert empty.merged(whole) is whole and whole.merged(empty) is whole


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 6))
    x[:, 5] = 7.0                                    # no variance: coefficient 0
    y = 4 * x[:, 0] - 2 * x[:, 1] + rng.normal(size=80)
    g = _fold(x, y)
    for r, (coef, base) in zip((0.05, 0.5, 50.0), FC.gram_fits(g, 1.0, [0.05, 0.5, 50.0])):
        sx, sy = x[:, :5].std(axis=0), y.std()
        slope = ((x[:, :5] - x[:, :5].mean(axis=0)) / sx).T @ (y - x @ coef - base) / len(y) / sy
        w = coef[:5] * sx / sy
        assert coef[5] == 0 and np.all(np.abs(slope) <= r / sy + 1e-9)
        assert np.allclose(slope[w != 0], np.sign(w[w != 0]) * r / sy, atol=1e-9)
    assert not np.any(coef)                          # the largest penalty removes every feature


def test_ridge_penalties_from_one_decomposition():
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(50, 6)), rng.normal(size=50)
    g = _fold(x, y)
    for r, (coef, _) in zip((0.0, 1.0, 100.0), FC.gram_fits(g, 0.0, [0.0, 1.0, 100.0])):
        extra = np.diag(np.diag(g.cov)[:6]) * r / y.std()
        assert np.allclose(coef, np.linalg.solve(g.cov[:6, :6] + extra, g.cov[:6, 6]))
