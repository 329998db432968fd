"""Repeated passages by a logarithmic family of anchor tables.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts
anywhere else in the corpus.  The levels hold counts of anchor hashes in place
of suffix arrays: of the ``LENGTH - GRAM + 1`` grams in any string of
``LENGTH`` bytes the one of the smallest hash is an anchor, so equal strings
have equal anchors at equal places, and only anchors are indexed (about one in
76 bytes), by the hash of their ``GRAM`` bytes.

Documents come in batches.  A batch's table is scanned against every level of
the family for common keys; levels of equal size merge into one of twice the
size, so an entry is rewritten a logarithmic number of times.

An anchor met twice is then resolved exactly.  Occurrences with equal
surroundings (all bytes that a string through the anchor can cover) are one
class; a class of two or more is removed as a whole.  The others, at the edges
of matches, are compared with the classes of the same anchor, string by string:
in one task for a few classes, by a distributed count for an anchor with very
many.  Nothing is listed pairwise.

Defined results: a null text is empty; an empty or short text loses nothing;
repeated rows are documents of their own, so all their strings repeat; texts
are bytes, and a cut may fall inside a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warung.llm import textscan as S
from warung.llm.store import discard, saved

LENGTH = 200
GRAM = 50
SIDE = LENGTH - GRAM


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours, by block prefixes."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, x[-1], dtype=x.dtype)
    padded[:n] = x
    padded = padded.reshape(blocks, width)
    head = best.accumulate(padded, axis=1).ravel()
    tail = best.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(tail[:n - width + 1], head[width - 1:n])


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors of a text, their keys and surroundings' hashes."""
    n = len(raw)
    if n < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    prefix = S.prefix_hash(raw)
    inverse = S.powers(n + 1, S._INVERSE)
    grams = S.mix((prefix[GRAM:] - prefix[:-GRAM]) * inverse[:n - GRAM + 1])
    low = _sliding(grams, SIDE + 1, np.minimum)               # by string
    # a gram is an anchor if it is the smallest of some string that holds it
    spread = np.zeros(n - GRAM + 1 + SIDE, dtype=np.uint64)
    spread[SIDE:SIDE + len(low)] = low
    at = np.flatnonzero(_sliding(spread, SIDE + 1, np.maximum) == grams)
    left, right = np.maximum(at - SIDE, 0), np.minimum(at + LENGTH, n)
    around = S.span_hashes(prefix, left, right)
    around = S.mix(around + (at - left).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return at, grams[at], around


def _anchor_rows(docs: DataFrame, batches_n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rid = part.column("rid").to_numpy()
                found = [anchors(S.as_array(t)) for t in S.opened(part)]
                counts = [len(f[0]) for f in found]
                if not sum(counts):
                    continue
                at, key, ctx = (np.concatenate(c) for c in zip(*found, strict=True))
                row = np.repeat(rid, counts)
                turn = (S.mix(row.view(np.uint64)) % np.uint64(batches_n)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(turn), pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(row), pa.array(at.astype(np.int32))],
                    ["turn", "key", "ctx", "rid", "pos"])

    return docs.mapInArrow(run, "turn int, key long, ctx long, rid long, pos int")


class Family:
    """The levels: ``(batches in it, table of key and n)``, largest first."""

    def __init__(self, spark: SparkSession):
        self.spark, self.levels, self.repeated, self.turns, self.tables = spark, [], [], 0, []

    def add(self, suffixes: DataFrame) -> None:
        """A new batch (rows with ``key``): its array, the scans, the merges."""
        self.turns += 1
        name = f"suffix-{self.turns}"
        array = saved(self.spark, suffixes.groupBy("key").agg(F.count("*").alias("n")).sortWithinPartitions("key"), name)
        self.tables.append(array)
        self.repeated.append(array.where("n > 1").select("key"))
        size, merge = 1, []
        for level_size, level in reversed(self.levels):
            if level_size == size:
                merge.append(level)               # the merge is its scan
                size += level_size
            else:
                self.repeated.append(array.select("key").join(level.select("key"), "key"))
        if merge:
            both = array
            for level in merge:
                both = both.unionByName(level)
            array = saved(self.spark, both.groupBy("key").agg(F.sum("n").alias("n")).sortWithinPartitions("key"), f"{name}-merged")
            self.tables.append(array)
            self.repeated.append(array.where("n > 1").select("key"))
        self.levels = [x for x in self.levels if all(x[1] is not m for m in merge)] + [(size, array)]

    def keys(self) -> DataFrame:
        """Every key that the corpus has twice."""
        out = self.repeated[0]
        for more in self.repeated[1:]:
            out = out.unionByName(more)
        return out.distinct()


def _string_hashes(around: list[bytes], lead: np.ndarray) -> np.ndarray:
    """(classes, SIDE + 1): hash of the string that begins ``o`` bytes before
    the anchor, 0 where the text ends first.  ``around`` holds the surroundings
    of the anchor, ``lead`` how many bytes of them come before it."""
    size = np.array([len(a) for a in around])
    low = np.cumsum(size) - size
    prefix = S.prefix_hash(S.as_array(b"".join(around)))
    start = (low + lead)[:, None] - np.arange(SIDE + 1)
    inside = (start >= low[:, None]) & (start + LENGTH <= (low + size)[:, None])
    start = np.where(inside, start, 0)
    end = np.where(inside, start + LENGTH, 0)
    return np.where(inside, S.span_hashes(prefix, start, end) | np.uint64(1), np.uint64(0))


def _tags(h: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The strings' hashes with their anchor's key and distance from it: a
    string is the same only there."""
    return S.mix(h ^ S.mix(key.view(np.uint64))[:, None] ^ S.mix(np.arange(1, SIDE + 2, dtype=np.uint64))[None, :])


def _surroundings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, ctx, n, rid, pos, lead, around`` of one occurrence per class."""
    per_text = wanted.groupBy("rid").agg(F.collect_list(F.struct("key", "ctx", "n", "pos", "many")).alias("want"))
    texts = docs.select("rid", *S.SQUEEZED).join(per_text, "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [[] for _ in range(8)]
                for rid, text, want in zip(part.column("rid").to_pylist(), S.opened(part), part.column("want").to_pylist(), strict=True):
                    for w in want:
                        low = max(w["pos"] - SIDE, 0)
                        for c, v in zip(rows, (w["key"], w["ctx"], w["n"], rid, w["pos"], w["many"], w["pos"] - low,
                                               text[low:w["pos"] + LENGTH]), strict=True):
                            c.append(v)
                kinds = [pa.int64()] * 4 + [pa.int32(), pa.bool_(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)],
                                                 ["key", "ctx", "n", "rid", "pos", "many", "lead", "around"])

    return texts.mapInArrow(run, "key long, ctx long, n long, rid long, pos int, many boolean, lead int, around binary")


def _edges_in_groups(classes: DataFrame) -> DataFrame:
    """``rid, begin, end`` of what repeats, for the single classes of each key."""
    names = ["key", "n", "rid", "pos", "lead"]

    def solve(c: dict[str, np.ndarray], around: list[bytes]) -> pa.RecordBatch:
        """Whole groups at a time: equal strings at equal places of one key."""
        h = _string_hashes(around, c["lead"])
        flat = _tags(h, c["key"]).ravel()
        real = np.flatnonzero(h.ravel())
        order = real[np.argsort(flat[real])]
        same = flat[order][1:] == flat[order][:-1]
        twice = np.zeros(len(flat), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        flags = np.zeros((h.shape[0], SIDE + 3), dtype=np.int8)
        flags[:, 1:-1] = twice.reshape(h.shape) & (c["n"] == 1)[:, None]
        step = np.diff(flags, axis=1)
        row, first = np.nonzero(step == 1)
        _, after = np.nonzero(step == -1)
        pos = c["pos"][row]
        return pa.RecordBatch.from_arrays([pa.array(c["rid"][row]), pa.array((pos - after + 1).astype(np.int32)),
                                           pa.array((pos - first + LENGTH).astype(np.int32))], ["rid", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, around = {n: np.empty(0, np.int64) for n in names}, []
        for batch in batches:
            rest = {n: np.concatenate([rest[n], batch.column(n).to_numpy()]) for n in names}
            around += batch.column("around").to_pylist()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(rest["key"])) + 1]) if around else np.zeros(1, int)
            at = 0                                # up to the last group, which may go on
            while at < starts[-1]:
                stop = starts[np.searchsorted(starts, min(at + 4096, starts[-1]), side="right") - 1]
                stop = stop if stop > at else starts[np.searchsorted(starts, at, side="right")]
                yield solve({n: v[at:stop] for n, v in rest.items()}, around[at:stop])
                at = stop
            rest, around = {n: v[at:] for n, v in rest.items()}, around[at:]
        if len(around) > 1:
            yield solve(rest, around)

    return classes.repartition("key").sortWithinPartitions("key").mapInArrow(run, "rid long, begin int, end int")


def _edges_by_count(classes: DataFrame) -> DataFrame:
    """The same for keys of very many classes: one row per string, counted."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                key, n, rid, pos = (part.column(c).to_numpy() for c in ("key", "n", "rid", "pos"))
                h = _string_hashes(part.column("around").to_pylist(), part.column("lead").to_numpy())
                row, o = np.nonzero(h)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_tags(h, key)[row, o].view(np.int64)), pa.array(rid[row]), pa.array((pos[row] - o).astype(np.int32)),
                     pa.array(n[row] == 1)], ["string", "rid", "begin", "asks"])

    rows = classes.mapInArrow(spell, "string long, rid long, begin int, asks boolean")
    twice = rows.groupBy("string").agg(F.count("*").alias("times")).where("times > 1").drop("times")
    return rows.where("asks").join(twice, "string").select("rid", "begin", (F.col("begin") + LENGTH).alias("end"))


def repeated_spans(spark: SparkSession, docs: DataFrame, *, batches: int = 3, group: int = 2048) -> DataFrame:
    """``rid, found`` (spans, overlapping) of every text of ``docs`` with a
    repeat; ``docs`` are squeezed rows with an id ``rid`` of their own."""
    rows = saved(spark, _anchor_rows(docs, batches), "suffix-anchors")
    family = Family(spark)
    for turn in range(batches):
        family.add(rows.where(F.col("turn") == turn))
    hits = saved(spark, rows.join(family.keys(), "key").select("key", "ctx", "rid", "pos"), "suffix-hits")
    discard(spark, [rows, *family.tables])
    classes = (hits.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("rid", "pos")).alias("one"))
               .select("key", "ctx", "n", "one.rid", "one.pos"))
    classes = saved(spark, classes, "suffix-classes")
    whole = (hits.join(classes.where("n > 1").select("key", "ctx"), ["key", "ctx"])
             .select("rid", F.greatest(F.col("pos") - SIDE, F.lit(0)).alias("begin"), (F.col("pos") + LENGTH).alias("end")))
    by_text = lambda spans: spans.groupBy("rid").agg(F.collect_list(F.struct("begin", "end")).alias("found"))
    whole = saved(spark, by_text(whole), "suffix-whole")
    discard(spark, [hits])
    apart = (classes.groupBy("key").agg(F.count("*").alias("c"), F.min("n").alias("least"))
             .where("c > 1 and least = 1").select("key", (F.col("c") > group).alias("many")))
    near = saved(spark, _surroundings(docs, classes.join(apart, "key")), "suffix-edges")
    discard(spark, [classes])
    # one after the other, so that only one's shuffles lie on disk
    grouped = saved(spark, by_text(_edges_in_groups(near.where("not many"))), "suffix-grouped")
    counted = saved(spark, by_text(_edges_by_count(near.where("many"))), "suffix-counted")
    discard(spark, [near])
    # one row per text with a repeat, so the tables above can go
    lists = whole.unionByName(grouped).unionByName(counted).groupBy("rid").agg(F.flatten(F.collect_list("found")).alias("found"))
    lists = saved(spark, lists, "suffix-spans")
    discard(spark, [whole, grouped, counted])
    return lists


def _merged(spans: list, size: int) -> list[tuple[int, int]]:
    """Maximal runs of the spans, cut to the text."""
    out: list[list[int]] = []
    for a, b in sorted((s["begin"], min(s["end"], size)) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", batches: int = 3) -> DataFrame:
    """``doc_id, kept (bytes), spans, n_bytes, n_removed, n_spans, kept_sha256``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # every row gets an id of its own, which holds once it is written
    rows = saved(spark, S.squeezed(rows, ["doc_id"], "text").withColumn("rid", F.monotonically_increasing_id()), "suffix-texts")
    met = rows.join(repeated_spans(spark, rows, batches=batches), "rid", "left")

    def cut(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [[] for _ in range(6)]
                for text, spans in zip(S.opened(part), part.column("found").to_pylist(), strict=True):
                    runs = _merged(spans or [], len(text))
                    stops = [0, *(x for r in runs for x in r), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(stops[0::2], stops[1::2], strict=True))
                    values = (kept, [{"begin": a, "end": b} for a, b in runs], len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
                    for c, v in zip(out, values, strict=True):
                        c.append(v)
                span = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
                kinds = [pa.binary(), pa.list_(span), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))],
                                                 ["doc_id", "kept", "spans", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = met.drop("rid").mapInArrow(cut, f"doc_id {kind}, kept binary, spans array<struct<begin:int,end:int>>, n_bytes long, "
                                          "n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("doc_id", id_col)
