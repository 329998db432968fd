"""Mixing sources to target weights by temperature.

A source holding the share ``p`` of all tokens gets the weight ``p ** alpha``
(normalised).  ``alpha`` is bisected so that the mixture reaches a wanted
entropy, or so that no source is repeated more often than a limit.  The
weights are realised as budgets of tokens, and a budget as permuted blocks:
whole epochs of a source, then the first blocks of its permutation until the
budget is full; of the block at the edge, documents in permuted order.

Tokens are words (``[^\\x20\\x09-\\x0D]+``); a document without words counts
one.  The source of most tokens is taken exactly once, so no document is lost
(alpha <= 1 makes the others' budgets at least their own size).

Defined results: a null text counts one token; a null source is a source;
equal rows are dealt with alike; an empty table gives no row; columns that the
caller has are kept, but for those named like the ``mix_`` columns added here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from warung.llm.store import saved


ADDED = ("mix_tokens", "mix_weight", "mix_epoch", "mix_block")


def word_count(text: Column) -> Column:
    """Words of the text, without splitting it: every word begins at the start
    or after white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def tempered(shares: list[float], alpha: float) -> list[float]:
    raw = [p ** alpha if p else 0.0 for p in shares]
    return [r / sum(raw) for r in raw]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w)


def repetitions(shares: list[float], weights: list[float]) -> list[float]:
    """Epochs of each source when the one with the least gets one."""
    ratio = [w / p if p else 0.0 for w, p in zip(weights, shares, strict=True)]
    least = min((r for r in ratio if r), default=1.0)
    return [r / least for r in ratio]


def fit_alpha(shares: list[float], *, max_repeat: float | None = None, min_entropy: float | None = None, steps: int = 60) -> float:
    """The largest change of the mixture that a limit on repetition allows, or
    the smallest that reaches an entropy; 1 keeps the natural shares, 0 makes
    all sources equal.  Both quantities fall as alpha rises."""
    def flat_enough(a: float) -> bool:
        w = tempered(shares, a)
        if max_repeat is not None:
            return max(repetitions(shares, w), default=1.0) > max_repeat
        return entropy(w) >= (min_entropy or 0.0)
    if (max_repeat is None) == (min_entropy is None):
        raise ValueError("give either max_repeat or min_entropy")
    if not shares or flat_enough(1.0) or not flat_enough(0.0):
        return 1.0 if not shares or flat_enough(1.0) else 0.0
    low, high = 0.0, 1.0                            # low is flat enough, high is not
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if flat_enough(middle) else (low, middle)
    return high if max_repeat is not None else low


def _exact(value: Column) -> Column:
    """A sum that does not depend on the order of the rows."""
    return F.sum(value.cast("decimal(38,24)"))


def entropies(totals: DataFrame, total: int, alphas: list[float]) -> list[float]:
    """Entropy of the mixture at each alpha, by one aggregate over the table
    of tokens ``n`` by source."""
    log = F.log(F.col("n") / F.lit(total))
    sums = []
    for a in alphas:
        sums += [_exact(F.exp(log * a)), _exact(F.exp(log * a) * log)]
    found = [float(x) for x in totals.agg(*[c.alias(f"c{k}") for k, c in enumerate(sums)]).first()]
    return [math.log(z) - a * s / z for a, z, s in zip(alphas, found[::2], found[1::2], strict=True)]


def fit_alpha_table(totals: DataFrame, total: int, least: int, most: int, *, max_repeat: float | None = None,
                    min_entropy: float | None = None, steps: int = 15) -> float:
    """``fit_alpha`` for a table of any number of sources.  Repetition follows
    from the smallest and the largest source alone; for an entropy each step
    tries fifteen values, as four steps of bisection would."""
    if max_repeat is not None or min_entropy is None:
        return fit_alpha([most / total, least / total], max_repeat=max_repeat, min_entropy=min_entropy)
    natural, equal = entropies(totals, total, [1.0, 0.0])
    if natural >= min_entropy or equal < min_entropy:
        return 1.0 if natural >= min_entropy else 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        grid = [low + (high - low) * k / 16 for k in range(17)]
        flat = [h >= min_entropy for h in entropies(totals, total, grid[1:16])]
        k = (flat + [False]).index(False)
        low, high = grid[k], grid[k + 1]
    return low


def mix(docs: DataFrame, *, max_repeat: float | None = None, min_entropy: float | None = None, blocks: int = 4096,
        seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        max_sources: int | None = None) -> DataFrame:
    """The rows of the mixture: each document once per epoch it is taken in.

    Adds ``mix_tokens``, ``mix_epoch`` (from 0), ``mix_block`` (its block's
    place in the epoch's permutation) and ``mix_weight``.

    Documents fall into ``blocks`` blocks per source by hash of their id, or of
    their text where the id is null; rows alike in that are taken together.  One scan sums
    the blocks; a source's budget then ends within one block of its
    permutation, and a second scan finds the document at which it ends.  What
    is taken follows from those two places, one row per source.  All tables by
    source are written and joined, so there may be as many sources as
    documents; while those tables are small, no document moves.  A caller that
    wants an error beyond some number of sources gives ``max_sources``.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.startswith("_mix_") or c in ADDED])
    rows = docs.withColumn("mix_tokens", F.greatest(word_count(F.col(text_col)), F.lit(1)).cast("long"))
    rows = rows.withColumn("_mix_source", F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null")))
    known = F.col(id_col).isNotNull()
    mark = lambda k: F.when(known, F.xxhash64(F.lit(k), F.col(id_col))).otherwise(F.xxhash64(F.lit(k), F.col(text_col)))
    rows = rows.withColumn("_mix_blk", F.pmod(mark(seed), F.lit(blocks)))
    rows = rows.withColumn("_mix_key", F.struct(mark(seed + 1).alias("h"), F.col(id_col).alias("id")))
    sums = saved(spark, rows.groupBy("_mix_source", "_mix_blk").agg(F.sum("mix_tokens").alias("n")), "mix-blocks")
    totals = saved(spark, sums.groupBy("_mix_source").agg(F.sum("n").alias("n")), "mix-totals")
    facts = totals.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.min("n").alias("least"), F.max("n").alias("most")).first()
    if max_sources is not None and facts["k"] > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    total, least, most = (facts[c] or 1 for c in ("n", "least", "most"))
    alpha = fit_alpha_table(totals, total, least, most, max_repeat=max_repeat, min_entropy=min_entropy) if facts["k"] else 1.0
    raw = F.pow(F.col("n") / F.lit(total), F.lit(alpha))
    norm = float(totals.agg(_exact(raw)).first()[0] or 1)
    times = F.pow(F.col("n") / F.lit(most), F.lit(alpha - 1))            # the largest source is taken once
    budget = F.greatest(F.rint(F.col("n") * times).cast("long"), F.col("n"))
    plan = (totals.withColumn("_mix_budget", budget)
            .select("_mix_source", (raw / norm).alias("mix_weight"), F.expr("_mix_budget div n").alias("_mix_epochs"),
                    (F.col("_mix_budget") % F.col("n")).alias("_mix_rest")))

    def place(epoch: Column) -> Column:
        """A block's place in the permutation of an epoch."""
        return F.struct(F.xxhash64(F.lit(seed), epoch, F.col("_mix_blk")).alias("h"), F.col("_mix_blk").alias("b"))

    # the block of the part epoch in which each budget ends
    spot = place(F.col("_mix_epochs"))
    ranked = sums.join(plan, "_mix_source").withColumn("_mix_spot", spot)
    ranked = ranked.withColumn("_mix_before", F.sum("n").over(W.partitionBy("_mix_source").orderBy("_mix_spot")) - F.col("n"))
    edge = saved(spark, ranked.where("_mix_before <= _mix_rest and _mix_before + n > _mix_rest")
                 .select("_mix_source", F.col("_mix_spot").alias("_mix_edge"), F.col("_mix_blk").alias("_mix_edge_blk"),
                         (F.col("_mix_rest") - F.col("_mix_before")).alias("_mix_room")), "mix-edges")
    # the last document of it that fits; equal ids are taken together
    ending = edge.select("_mix_source", F.col("_mix_edge_blk").alias("_mix_blk"), "_mix_room")
    inner = (rows.select("_mix_source", "_mix_blk", "_mix_key", "mix_tokens").join(ending, ["_mix_source", "_mix_blk"])
             .groupBy("_mix_source", "_mix_key", "_mix_room").agg(F.sum("mix_tokens").alias("n")))
    inner = inner.withColumn("_mix_run", F.sum("n").over(W.partitionBy("_mix_source").orderBy("_mix_key")))
    last = inner.where("_mix_run <= _mix_room").groupBy("_mix_source").agg(F.max("_mix_key").alias("_mix_last"))
    ends = saved(spark, plan.join(edge, "_mix_source", "left").join(last, "_mix_source", "left"), "mix-ends")

    met = rows.join(ends, "_mix_source")                               # sent along while it is small
    inside = (spot < F.col("_mix_edge")) | ((F.col("_mix_blk") == F.col("_mix_edge_blk")) & (F.col("_mix_key") <= F.col("_mix_last")))
    epochs = F.col("_mix_epochs") - F.when(F.coalesce(inside, F.lit(False)), 0).otherwise(1)
    out = met.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), epochs)))
    out = out.withColumn("mix_block", F.pmod(place(F.col("mix_epoch"))["h"], F.lit(2**31)))
    return out.drop(*[c for c in out.columns if c.startswith("_mix_")])
