r"""Importance resampling towards a target distribution, on hashed n-grams.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z lower-cased;
features are all runs of one and two consecutive words, each hashed to one of
``buckets`` buckets.  A bucket's gain is the logarithm of its smoothed share in
the target over that in the corpus; a document's weight is the mean gain of
its features.  Documents are drawn without replacement by the Gumbel top-k
trick: weight plus noise that only depends on the document's id.

A batch's texts are joined with a sentinel byte that no word holds; one regular
expression pass finds all words, the document of each word is its place among
the document offsets (``searchsorted``), and word pairs that reach over a
document's end are masked before buckets are counted.  Matches are taken a
bounded number at a time, so the length of a text does not matter.

Counts are summed per task before they are shuffled, the gains are a table of
``buckets`` rows, and the draw is a distributed sort whose ranks follow from a
row count per sorting task.

Defined results: a null or empty text, or one without words, has no feature
and weight 0; a null id counts as the empty text in the noise and comes after
all others of its score; repeated rows are drawn each; with an empty target or
corpus every gain is that of empty counts; an empty table yields no row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from warung.llm import textscan as S
from warung.llm.store import saved

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SENTINEL = b"\x00"


def batch_features(texts: list[bytes | None], buckets: int, at_once: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(documents, their words, feature documents, feature buckets)`` of the
    joined texts, some ``at_once`` words at a time."""
    sizes = np.array([len(t) if t else 0 for t in texts], dtype=np.int64)
    offsets = np.cumsum(sizes + len(SENTINEL)) - sizes - len(SENTINEL)
    found = WORD.finditer(SENTINEL.join([t.lower() if t else b"" for t in texts]))
    before: tuple[int, int] | None = None                              # document and CRC of the word before
    while matches := list(islice(found, at_once)):
        words = [m[0] for m in matches]
        starts = np.fromiter((m.start() for m in matches), np.int64, len(matches))
        owner = np.searchsorted(offsets, starts, side="right") - 1
        one = list(map(zlib.crc32, words))
        # CRC of "first second" goes on from that of "first "
        head = [before[1], *one[:-1]] if before else one[:-1]
        spaced = map(zlib.crc32, repeat(b" "), head)
        two = np.fromiter(map(zlib.crc32, words if before else words[1:], spaced), np.int64, len(head))
        left = np.concatenate([[before[0]], owner[:-1]]) if before else owner[:-1]
        right = owner if before else owner[1:]
        inside = left == right
        yield owner, np.concatenate([owner, right[inside]]), np.concatenate([np.array(one, np.int64), two[inside]]) % buckets
        before = (int(owner[-1]), one[-1])


def bucket_counts(docs: DataFrame, *, buckets: int = 10_000, text_col: str = "text") -> DataFrame:
    """``bucket, n`` over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, texts in S.texts_of(batch, text_col):
                for _, _, found in batch_features(texts, buckets):
                    total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    return docs.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(spark: SparkSession, docs: DataFrame, target: DataFrame, *, buckets: int = 10_000, text_col: str = "text", target_text_col: str = "text") -> np.ndarray:
    """Each bucket's gain in thousandths, rounded down (``buckets`` numbers)."""
    s = bucket_counts(docs, buckets=buckets, text_col=text_col).withColumnRenamed("n", "s")
    t = bucket_counts(target, buckets=buckets, text_col=target_text_col).withColumnRenamed("n", "t")
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0)
    rows = both.collect()                                              # one row per bucket, whatever the corpus
    out = np.zeros((2, buckets), dtype=np.float64)
    for r in rows:
        out[:, r["bucket"]] = r["s"], r["t"]
    (s, t), (s_all, t_all) = out, out.sum(axis=1)
    return np.floor(1000 * np.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, n_features, weight`` of every row."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in S.texts_of(batch, text_col):
                n_words, n, total = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
                for words, owner, found in batch_features(texts, buckets):
                    n_words += np.bincount(words, minlength=len(texts))
                    n += np.bincount(owner, minlength=len(texts))
                    total += np.bincount(owner, weights=gain[found], minlength=len(texts)).astype(np.int64)   # whole numbers, exact in doubles
                yield pa.RecordBatch.from_arrays([part.column(id_col), *(pa.array(x, pa.int64()) for x in (n_words, n, total // np.maximum(n, 1)))],
                                                 [id_col, "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_features long, weight long").withColumnRenamed(id_col, "id")


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the SHA-256 of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, *, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = 10_000,
             id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """``id_col, n_words, n_features, weight, score, rank`` of every row; rank
    1, 2, 3 ... for the drawn ``percent`` of the rows with ``least_words`` words
    or more, else null."""
    gain = gains(spark, docs, target, buckets=buckets, text_col=text_col, target_text_col=target_text_col)
    rows = weigh(docs, gain, id_col=id_col, text_col=text_col)
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("_rid", F.monotonically_increasing_id())
    rows = saved(spark, rows, "resample-scored")
    enough = F.col("n_words") >= least_words
    n = rows.where(enough).count()
    drawn = percent * n // 100

    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), "n_features", "weight", "_rid"]   # the row id splits runs of equal rows
    line = saved(spark, rows.where(enough).orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "resample-line")
    part = F.shiftright("_at", 33)
    tasks = line.groupBy(part.alias("_task")).agg(F.count("*").alias("k"))
    tasks = tasks.select("_task", (F.sum("k").over(W.orderBy("_task")) - F.col("k")).alias("before"))   # a row per sorting task
    place = F.col("before") + F.col("_at").bitwiseAND(2**33 - 1) + 1
    line = line.withColumn("_task", part).join(F.broadcast(tasks), "_task").withColumn("rank", F.when(place <= drawn, place))
    out = line.select(*rows.columns, "rank").unionByName(rows.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")
