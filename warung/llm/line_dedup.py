r"""Line deduplication by a deletion-neighbourhood join.

A line is the sequence of its words, A-Z lower-cased; the edit unit is the
word.  Of equal lines the earliest occurrence (by doc_id, then line number)
stays.  Of lines within one edit of each other (of at least ``min_words``
words: one edit in five is a similarity of 0.8), a line goes when an earlier
one is within the bound, whether that one itself stays or not.

Lines meet by hashed variants: a line and its one-word deletions.  Two lines of
equal length are within one substitution exactly if they agree without the
word at some place; lines whose lengths differ by one, if the longer without a
word is the shorter.  Only the earliest line of a variant matters, so variants
are aggregated to minima and no pairs are listed; the pair that decides is
verified on its words.  Before variants are emitted, a line must share a half
with another line (one edit leaves a half untouched), which loses nothing and
spares most lines.

Defined results: a null text has no lines and stays null; lines without words
are never removed; rows equal in doc_id and text count as one document; the
columns of ``docs`` are kept, but for those that the added ones are named like.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warung.llm import textscan as S
from warung.llm.store import discard, saved


class _Lines:
    """Word hashes of one text, by line."""

    def __init__(self, data: bytes):
        self.raw = S.as_array(data.lower())
        starts, ends = S.word_spans(self.raw)
        words = S.span_hashes(S.prefix_hash(self.raw), starts, ends)
        self.starts, self.ends = starts, ends
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * S.powers(len(words)), dtype=np.uint64)])
        low, high = S.line_spans(self.raw)
        first = np.searchsorted(starts, low)
        count = np.searchsorted(starts, high) - first
        self.n_lines = len(low)
        self.number = np.flatnonzero(count)
        self.first, self.count = first[self.number], count[self.number]

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return S.span_hashes(self.prefix, a, b)

    def hashes(self) -> np.ndarray:
        return self.span(self.first, self.first + self.count)

    def halves(self) -> list[np.ndarray]:
        """Keys of the first and last half, as the line itself and as the
        shorter of a pair (one word more)."""
        out, end = [], self.first + self.count
        for m in (self.count, self.count + 1):
            half = m // 2
            tag = m.astype(np.uint64) * np.uint64(4)
            out.append(S.mix(self.span(self.first, self.first + half) + tag + np.uint64(1)))
            out.append(S.mix(self.span(end - (m - half), end) + tag + np.uint64(2)))
        return out

    def deletions(self, line: int, low: int, high: int) -> np.ndarray:
        """Hashes of the line without word ``low``, ..., ``high - 1``."""
        a, n = int(self.first[line]), int(self.count[line])
        at = np.arange(a + low, a + high)
        inverse = S.powers(len(self.prefix), S._INVERSE)
        head = (self.prefix[at] - self.prefix[a]) * inverse[a]
        tail = (self.prefix[a + n] - self.prefix[at + 1]) * inverse[a + 1]
        return S.mix(head + tail + np.uint64(n - 1))


def _line_rows(docs: DataFrame, min_words: int) -> DataFrame:
    """One row per line with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in S.texts_of(batch):
                rows: list[list[np.ndarray]] = []
                for low, high in S.bounded(texts):
                    some = [t or b"" for t in texts[low:high]]
                    lines = _Lines(b"\n".join(some))                  # hashes do not depend on where a line stands
                    if len(lines.number):
                        first = np.cumsum([0, *(t.count(b"\n") + 1 for t in some)])
                        text = np.searchsorted(first, lines.number, side="right") - 1
                        rows.append([low + text, lines.number - first[text], lines.hashes(), lines.count, *lines.halves()])
                if not rows:
                    continue
                row, number, h, count, *halves = (np.concatenate(c) for c in zip(*rows, strict=True))
                take, long_enough = pa.array(row), count >= min_words
                shorter = count + 1 >= min_words  # may be the shorter one of a pair
                keys = [pa.array(x.view(np.int64), mask=~(long_enough if j < 2 else shorter)) for j, x in enumerate(halves)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(take) for c in ("doc_id", "rid", "rid2")), pa.array(number.astype(np.int32)),
                     pa.array(h.view(np.int64)), *keys], ["doc_id", "rid", "rid2", "line", "h", "k0", "k1", "k2", "k3"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(S.lean(run), f"doc_id {kind}, rid long, rid2 int, line int, h long, k0 long, k1 long, k2 long, k3 long")


def _bytes(part: pa.RecordBatch) -> list[bytes]:
    return part.column("text").cast(pa.binary()).to_pylist()


def _variants(rows: DataFrame) -> DataFrame:
    """Variant rows of candidate lines: ``rows`` hold a text and its candidate
    lines ``want`` (line, four flags: which halves are shared).

    ``kind`` 1: a place left out, among lines of one length; 2: a line with one
    word less; 3: a line as it is, to be met by kind 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out: list[list] = []
                for k, (text, want) in enumerate(zip(_bytes(part), part.column("want").to_pylist(), strict=True)):
                    lines = _Lines(text)
                    place = {int(n): j for j, n in enumerate(lines.number)}
                    h = lines.hashes()
                    for w in want:
                        j = place[w["line"]]
                        n, shared = int(lines.count[j]), w["shared"]
                        found, kinds = [], []
                        if shared & 3:
                            low, high = (0 if shared & 2 else n // 2), (n if shared & 1 else n // 2)
                            gone = lines.deletions(j, low, high)
                            spot = S.mix(np.arange(low, high, dtype=np.uint64) * np.uint64(64) + np.uint64(7))
                            found += [S.mix(gone ^ spot ^ S.mix(np.full(1, n, np.uint64))), gone]
                            kinds += [np.full(high - low, 1, np.int8), np.full(high - low, 2, np.int8)]
                        if shared & 12:
                            found.append(h[j:j + 1])
                            kinds.append(np.full(1, 3, np.int8))
                        size = sum(map(len, kinds))
                        out.append([np.full(size, k), np.concatenate(found), np.concatenate(kinds), np.full(size, h[j]), np.full(size, w["line"], np.int32)])
                if not out:
                    continue
                row, key, kind, h_all, line = (np.concatenate(c) for c in zip(*out, strict=True))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(kind), pa.array(h_all.view(np.int64)), part.column("doc_id").take(take),
                     part.column("rid").take(take), pa.array(line)], ["key", "kind", "h", "doc_id", "rid", "line"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(S.lean(run), f"key long, kind byte, h long, doc_id {kind}, rid long, line int")


def _word_lists(rows: DataFrame) -> DataFrame:
    """``(h, words)`` of the wanted lines, one row per line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                hs, words = [], []
                for text, want in zip(_bytes(part), part.column("want").to_pylist(), strict=True):
                    split = [x.split() for x in text.lower().split(b"\n")]
                    for w in want:
                        hs.append(w["h"])
                        words.append(b" ".join(split[w["line"]]))
                yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(words, pa.binary())], ["h", "words"])

    return rows.mapInArrow(S.lean(run), "h long, words binary")


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether two word lists are within one substitution, insertion or deletion."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def find_removed(spark: SparkSession, docs: DataFrame, min_words: int) -> tuple[DataFrame, list[DataFrame]]:
    """``doc_id, rid, rid2, line, exact`` of every line to remove, from
    ``docs(doc_id, rid, rid2, text)``; and the scratch tables that it reads."""
    lines = saved(spark, _line_rows(docs, min_words), "lines")
    place = F.struct("doc_id", "rid", "line")
    keys = ["k0", "k1", "k2", "k3"]
    unique = lines.groupBy("h").agg(F.min(F.struct("doc_id", "rid", "line", "rid2")).alias("f"), F.count("*").alias("n"),
                                    *(F.first(k).alias(k) for k in keys))
    unique = saved(spark, unique.select("h", "n", F.struct("f.doc_id", "f.rid", "f.line").alias("first"), F.col("f.rid2").alias("rid2"), *keys), "lines-unique")

    # lines that share a half with another line
    half = unique.select("h", F.posexplode(F.array(*keys)).alias("which", "key")).where("key is not null")
    shared = half.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key")
    flags = (half.join(shared.hint("shuffle_hash"), "key").groupBy("h").agg(F.bit_or(F.expr("shiftleft(1, which)")).alias("shared")))
    # as the longer line the halves (n) count against another's (n + 1) as well
    candidates = saved(spark, unique.join(flags, "h").select("h", "shared", "first", "rid2"), "lines-candidates")

    whole = docs.select("rid", "rid2", "text").dropDuplicates(["rid", "rid2"])
    wanted = (candidates.groupBy(F.col("first.rid").alias("rid"), "rid2")
              .agg(F.first("first.doc_id").alias("doc_id"), F.collect_list(F.struct(F.col("first.line").alias("line"), "shared", "h")).alias("want")))
    texts = saved(spark, whole.join(wanted, ["rid", "rid2"]), "lines-texts")
    variants = _variants(texts).select("key", "kind", "h", place.alias("first"))

    # the earliest line of each variant; kinds 2 and 3 meet each other.  Few
    # variants are of two lines, and only those are compared by their place
    every = saved(spark, variants.withColumn("group", F.when(F.col("kind") == 1, 1).otherwise(2)), "lines-variants")
    several = every.groupBy("group", "key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("group", "key")
    mine = saved(spark, every.join(several.hint("shuffle_hash"), ["group", "key"], "left_semi"), "lines-shared-variants")
    least = lambda k: F.min(F.when(F.col("kind") == k, F.struct("first", "h")))
    best = mine.groupBy("group", "key").agg(least(1).alias("m1"), least(2).alias("m2"), least(3).alias("m3"))
    met = mine.join(best, ["group", "key"])
    other = F.when(F.col("kind") == 1, F.col("m1")).when(F.col("kind") == 2, F.col("m3")).otherwise(F.col("m2"))
    near = (met.select("h", "first", other.alias("o")).where(F.col("o.first") < F.col("first"))
            .groupBy("h").agg(F.min("o").alias("o")).select("h", F.col("o.h").alias("earlier")))
    near = saved(spark, near, "lines-near")

    # verify the deciding pairs on their words
    words = saved(spark, _word_lists(texts), "lines-words")
    pairs = (near.join(words, "h").join(words.select(F.col("h").alias("earlier"), F.col("words").alias("other")), "earlier"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [within_one(x.split(b" "), y.split(b" "))
                  for x, y in zip(batch.column("words").to_pylist(), batch.column("other").to_pylist(), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["h"])

    sure = pairs.mapInArrow(verify, "h long").distinct().withColumn("near", F.lit(True))
    going = (unique.join(sure.hint("shuffle_hash"), "h", "left").where("n > 1 or near")
             .select("h", "first", F.coalesce("near", F.lit(False)).alias("near")))
    hit = lines.select("doc_id", "rid", "rid2", "line", "h").join(going.hint("shuffle_hash"), "h")
    same = place.eqNullSafe(F.col("first"))
    found = hit.where(F.col("near") | ~same).select("doc_id", "rid", "rid2", "line", (~same).alias("exact"))
    return found, [lines, unique, candidates, texts, every, mine, near, words]


def dedup_lines(spark: SparkSession, docs: DataFrame, *, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the remaining lines as text, and ``n_lines``, ``n_exact``
    and ``n_near`` (removed lines that repeat an earlier one, or are near one)."""
    added = ["n_lines", "n_exact", "n_near", "n_gone"]
    keep = [c for c in docs.columns if c != text_col and c not in added]
    rid, rid2 = "_warung_rid", "_warung_rid2"
    rows = (docs.select(*keep, text_col).withColumn(rid, F.xxhash64(id_col, text_col)).withColumn(rid2, F.hash(F.lit(5), text_col, id_col)))
    slim = rows.select(F.col(id_col).alias("doc_id"), F.col(rid).alias("rid"), F.col(rid2).alias("rid2"), F.col(text_col).alias("text"))
    found, scratch = find_removed(spark, slim, min_words)
    gone = (found.distinct().groupBy(F.col("rid").alias(rid), F.col("rid2").alias(rid2))
            .agg(F.collect_list("line").alias("gone"), F.sum(F.col("exact").cast("long")).alias("n_exact"), F.count("*").alias("n_gone")))
    gone = saved(spark, gone, "lines-gone")
    discard(spark, scratch)
    met = rows.join(gone, [rid, rid2], "left").drop(rid, rid2)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, whole in S.texts_of(batch, text_col):
                texts, n_lines = [], []
                for text, out in zip(whole, part.column("gone").to_pylist(), strict=True):
                    n_lines.append(0 if text is None else text.count(b"\n") + 1)
                    if out:
                        drop = set(out)
                        text = b"\n".join([x for k, x in enumerate(text.split(b"\n")) if k not in drop])
                    texts.append(None if text is None else text.decode("utf-8", "replace"))
                count = [pa.array([x or 0 for x in part.column(c).to_pylist()], pa.int64()) for c in ("n_exact", "n_gone")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), *count],
                                                 [*keep, text_col, "n_lines", "n_exact", "n_gone"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    out = met.mapInArrow(S.lean(rebuild), (kinds + ", " if kinds else "") + f"`{text_col}` string, n_lines long, n_exact long, n_gone long")
    return out.withColumn("n_near", F.col("n_gone") - F.col("n_exact")).drop("n_gone")
