"""MinHash near-duplicates by a chosen-path set similarity join.

Every document's set of word shingles has a sketch of minwise hashes.  In each
of several independent trees a node chooses one or two sketch positions by the
hash of its path, and every document in it branches to the child named by the
value it has there.  Small nodes are compared exhaustively, large ones branch
again.  A pair of similarity ``s`` meets in a first-level node of a tree with
probability ``s`` or more, so ``trees`` gives the recall.

Groups of thousands of near copies never get small by branching, so pairs
already connected are passed over:

1. equal sets are one class;
2. in every node each class is held against one pivot (the smallest hash, so
   much the same in all nodes); confirmed links give components;
3. nodes that hold more than one component are compared exhaustively across
   components: small ones, and large ones whose rows outside the largest
   component times all rows are few enough; the others in their children.  At
   first every row only meets its most similar partner, then all that are left.

A pair whose sketches agree closely enough is confirmed on the full sets.
Work per row is bounded at every step: nodes are cut into blocks.  No step
gives out all pairs of a group: the last one brings the full sets of the rows
that have a plausible partner to one place, confirms pairs there, and emits
only links that join two components.

Defined results: a null or empty text, or one without words, has the empty set
and is linked with nothing; equal texts and repeated rows are one component;
a doc_id that stands on several rows gets a row for each; ties take the
smallest doc_id, a null one before all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warung.llm import textscan as S
from warung.llm.components import components
from warung.llm.grouping import groups
from warung.llm.store import discard, saved

POSITIONS = 128
_SEEDS = np.random.default_rng(99).integers(1, 2**31, (2, POSITIONS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Minwise 32-bit values of a non-empty set."""
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(POSITIONS, 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(shingles), 1024):      # a block of values at a time
        part = low[None, at:at + 1024] * _SEEDS[0]
        part += high[None, at:at + 1024] * _SEEDS[1]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def chosen(paths: np.ndarray, similarity: float) -> np.ndarray:
    """Positions that each path chooses: (n, 2), the second -1 where it chooses
    only one; ``1 / similarity`` on average."""
    first = (S.mix(paths + np.uint64(1)) % np.uint64(POSITIONS)).astype(np.int64)
    second = ((first.astype(np.uint64) + np.uint64(1) + S.mix(paths + np.uint64(2)) % np.uint64(POSITIONS - 1)) % np.uint64(POSITIONS)).astype(np.int64)
    also = (S.mix(paths + np.uint64(3)) >> np.uint64(11)).astype(np.float64) / 2**53 < 1 / similarity - 1
    return np.stack([first, np.where(also, second, -1)], 1)


def children(paths: np.ndarray, sketches: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) for every position chosen."""
    picks = chosen(paths, similarity)
    rows, child = [], []
    for j in (0, 1):
        at = np.flatnonzero(picks[:, j] >= 0)
        value = sketches[at, picks[at, j]].astype(np.uint64)
        step = S.mix(value * np.uint64(0x9E3779B97F4A7C15) + picks[at, j].astype(np.uint64))
        rows.append(at)
        child.append(S.mix(paths[at] * np.uint64(3) + step))
    return np.concatenate(rows), np.concatenate(child)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """``(doc_id, k1, k2, n, class, sketch, small)`` of ``docs(doc_id, text, k1, k2)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in S.texts_of(batch):
                n, cls, sk, small = [], [], [], []
                for text in texts:
                    found = S.document_set(text, k)
                    n.append(len(found))
                    if len(found):
                        cls.append(int(S.mix(found).sum(dtype=np.uint64).view(np.int64)))
                        values = sketch(found)
                        sk.append(values.tobytes())
                        small.append((values & np.uint32(255)).astype(np.uint8).tobytes())
                    else:
                        cls.append(None), sk.append(None), small.append(None)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("doc_id", "k1", "k2")), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sk, pa.binary()),
                     pa.array(small, pa.binary())], ["doc_id", "k1", "k2", "n", "class", "sketch", "small"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(S.lean(run), f"doc_id {kind}, k1 long, k2 int, n long, class long, sketch binary, small binary")


def _branch(rows: DataFrame, similarity: float, trees: int = 0) -> DataFrame:
    """Rows (class, sketch[, node, comp]) to their children's rows (node, class[,
    comp]); with ``trees`` from the roots."""
    deeper = not trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                values = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint32).reshape(part.num_rows, POSITIONS)
                for tree in range(max(trees, 1)):
                    paths = part.column("node").to_numpy().view(np.uint64) if deeper else S.mix(np.full(part.num_rows, tree + 1, np.uint64))
                    row, child = children(paths, values, similarity)
                    take = pa.array(row)
                    more = ["comp"] if deeper else []
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *(part.column(c).take(take) for c in ["class", *more])],
                                                     ["node", "class", *more])

    return rows.mapInArrow(S.lean(run), "node long, class long" + (", comp long" if deeper else ""))


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of rows of 8-bit sketches."""
    return ((a == b).mean(-1) - 1 / 256) / (1 - 1 / 256)


def _compare(rows: DataFrame, least: float) -> DataFrame:
    """The most similar plausible partner ``(node, left, a, b)`` of each left row
    among the right ones of other components within each (node, ga, gb); a row
    can be both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["node", "ga", "gb"]):
            left, right = np.flatnonzero(g["is_left"]), np.flatnonzero(g["is_right"])
            if not len(left) or len(right) < 2 and len(left) < 2:
                continue
            out_a, out_b = [], []
            for at in range(0, len(left), 64):
                rows_l = left[at:at + 64]
                i, j = np.nonzero(g["comp"][rows_l][:, None] != g["comp"][right][None, :])
                if not len(i):
                    continue
                near = agreement(g["small"][rows_l[i]], g["small"][right[j]])
                order = np.lexsort([-near, i])
                best = np.zeros(len(i), dtype=bool)
                best[order[np.flatnonzero(np.diff(i[order], prepend=-1))]] = True
                ok = best & (near >= least)
                out_a.append(g["class"][rows_l[i[ok]]])
                out_b.append(g["class"][right[j[ok]]])
            if out_a and sum(map(len, out_a)):
                a, b = np.concatenate(out_a), np.concatenate(out_b)
                node = np.full(len(a), g["node"][0])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(a), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))],
                                                 ["node", "left", "a", "b"])

    keys = ["node", "ga", "gb"]
    spread = rows.repartition(*keys).sortWithinPartitions(*keys)
    return spread.mapInArrow(S.lean(run), "node long, left long, a long, b long").where("a <> b")


def _bundles(rows: DataFrame, least: float, percent: int, items: int = 1 << 20) -> DataFrame:
    """Rows ``(g1, g2, class, comp, small, is_left, is_right)`` that have a plausible
    partner in another component of their (node, ga, gb).  Rows that hang
    together by such pairs are one bundle, named by what is in it, so one that
    other nodes hold as well stays once; either side of a bundle is cut at
    about ``items`` shingles, whose sets one task can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["node", "ga", "gb"]):
            # a class can be a left row and another, right one
            _, row, at_ = np.unique(g["class"], return_index=True, return_inverse=True)
            sides = [np.bincount(at_, g[side]) > 0 for side in ("is_left", "is_right")]
            g = {name: v[row] for name, v in g.items()}
            left, right = map(np.flatnonzero, sides)
            bundle = np.arange(len(row))          # each row's first row
            asks, asked = np.zeros(len(bundle), dtype=bool), np.zeros(len(bundle), dtype=bool)
            for at in range(0, len(left), 64):
                rows_l = left[at:at + 64]
                n_l, n_r = g["n"][rows_l][:, None], g["n"][right][None, :]
                i, j = np.nonzero((g["comp"][rows_l][:, None] != g["comp"][right][None, :])
                                  & (100 * np.minimum(n_l, n_r) >= percent * np.maximum(n_l, n_r)))
                ok = agreement(g["small"][rows_l[i]], g["small"][right[j]]) >= least
                i, j = rows_l[i[ok]], right[j[ok]]
                asks[i] = asked[j] = True
                while (bundle[i] != bundle[j]).any():
                    x, y = bundle[i], bundle[j]
                    np.minimum.at(bundle, np.maximum(x, y), np.minimum(x, y))
                    while (bundle[bundle] != bundle).any():
                        bundle = bundle[bundle]
            met = np.flatnonzero(asks | asked)
            met = met[np.argsort(bundle[met], kind="stable")]
            for some in np.split(met, np.flatnonzero(np.diff(bundle[met])) + 1):
                if not len(some):
                    continue
                parts = [np.split(side, np.flatnonzero(np.diff(np.cumsum(g["n"][side]) // items)) + 1) for side in (some[asks[some]], some[asked[some]])]
                for one in parts[0]:
                    for other in parts[1]:
                        both = np.union1d(one, other)
                        is_left, is_right = np.isin(both, one), np.isin(both, other)
                        h = S.mix(g["class"][both].view(np.uint64) * np.uint64(4) + S.mix(g["class"][both].view(np.uint64))
                                  + is_left.astype(np.uint64) + is_right.astype(np.uint64) * np.uint64(2))
                        names = [v.sum(dtype=np.uint64).view(np.int64) for v in (h, S.mix(h + np.uint64(7)))]
                        yield pa.RecordBatch.from_arrays(
                            [*(pa.array(np.full(len(both), v)) for v in names), pa.array(g["class"][both]), pa.array(g["comp"][both]),
                             pa.array([v.tobytes() for v in g["small"][both]], pa.binary()), pa.array(is_left), pa.array(is_right)],
                            ["g1", "g2", "class", "comp", "small", "is_left", "is_right"])

    keys = ["node", "ga", "gb"]
    spread = rows.repartition(*keys).sortWithinPartitions(*keys)
    found = spread.mapInArrow(S.lean(run), "g1 long, g2 long, class long, comp long, small binary, is_left boolean, is_right boolean")
    return found.dropDuplicates(["g1", "g2", "class"])


def _joined(bundles: DataFrame, sets: DataFrame, least: float, percent: int) -> DataFrame:
    """Links ``(a, b)``, confirmed on the full sets, that join the components of
    each bundle as all its pairs would: fewer than it has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["g1", "g2"], ragged=("items",)):
            n = np.array([len(x) // 8 for x in g["items"]])
            ids = np.unique(np.frombuffer(b"".join(g["items"]), np.uint64), return_inverse=True)[1]
            ends = np.cumsum(n)
            sets_ = [ids[e - k:e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            mark, comp, right = np.zeros(len(ids), dtype=bool), g["comp"].copy(), np.flatnonzero(g["is_right"])
            out_a, out_b = [], []
            for x in np.flatnonzero(g["is_left"]).tolist():
                ask = comp[right] != comp[x]
                if g["is_right"][x]:              # each pair once
                    ask &= ~(g["is_left"][right] & (right < x))
                with_ = right[ask]
                with_ = with_[100 * np.minimum(n[with_], n[x]) >= percent * np.maximum(n[with_], n[x])]
                with_ = with_[agreement(g["small"][x][None, :], g["small"][with_]) >= least]
                if not len(with_):
                    continue
                mark[sets_[x]] = True
                hits = mark[np.concatenate([sets_[y] for y in with_.tolist()])]
                mark[sets_[x]] = False
                same = np.add.reduceat(hits, np.cumsum(n[with_]) - n[with_], dtype=np.int64)
                for y in with_[100 * same >= percent * (n[x] + n[with_] - same)].tolist():
                    if comp[y] != comp[x]:
                        out_a.append(g["class"][x]), out_b.append(g["class"][y])
                        comp[comp == comp[y]] = comp[x]
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(out_a, out_b)), pa.array(np.maximum(out_a, out_b))], ["a", "b"])

    keys = ["g1", "g2"]
    spread = bundles.join(sets.select("class", "items"), "class").repartition(*keys).sortWithinPartitions(*keys)
    return spread.mapInArrow(S.lean(run), "a long, b long").distinct()


def _confirm(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    percent = round(similarity * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ok = []
                for x, y in zip(part.column("xa").to_pylist(), part.column("xb").to_pylist(), strict=True):
                    both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]))
                    union = len(both) - (same := int((both[1:] == both[:-1]).sum()))
                    ok.append(100 * same >= percent * union)
                part = part.filter(pa.array(ok))
                yield part.select(["a", "b"])

    met = pairs.join(sets.select(F.col("class").alias("a"), F.col("items").alias("xa")), "a")
    met = met.join(sets.select(F.col("class").alias("b"), F.col("items").alias("xb")), "b")
    return met.select("a", "b", "xa", "xb").mapInArrow(S.lean(run), "a long, b long")


def least_agreement(similarity: float) -> float:
    """The share of equal positions from which a pair is confirmed on its full
    sets: 4.5 standard deviations below the similarity."""
    return similarity - 4.5 * math.sqrt(similarity * (1 - similarity) / POSITIONS)


def _full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``(class, items)``: the sorted shingles of the wanted classes ``(k1, k2,
    class)``, from the text of one document of each; a row of ``docs`` meets one
    class at most, however many share its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in S.texts_of(batch):
                items, cls = [], []
                for text, want in zip(texts, part.column("class").to_pylist(), strict=True):
                    found = S.document_set(text, k)
                    # two texts whose 96-bit keys agree are told apart here
                    if int(S.mix(found).sum(dtype=np.uint64).view(np.int64)) == want:
                        items.append(found.tobytes())
                        cls.append(want)
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(items, pa.binary())], ["class", "items"])

    rows = docs.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).select("class", "text")
    return rows.mapInArrow(S.lean(run), "class long, items binary").dropDuplicates(["class"])


def near_duplicates(spark: SparkSession, docs: DataFrame, *, k: int = 4, similarity: float = 0.8, trees: int = 10,
                    small_node: int = 64, comparisons: int = 1 << 21, block: int = 2048, depth: int = 8, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.hash(F.lit(6), "text", "doc_id"))
    least = least_agreement(similarity)
    every = saved(spark, _sets(texts, k), "cps-sets")
    classes = (every.where("class is not null").groupBy("class")
               .agg(F.min(F.struct("doc_id", "k1", "k2", "n", "sketch", "small")).alias("r"))
               .select("class", "r.*"))
    classes = saved(spark, classes, "cps-classes")
    rows_of = saved(spark, every.select("doc_id", "n", "class"), "cps-rows")
    discard(spark, [every])

    # 1. first-level nodes that hold more than one class, and their pivots
    first = _branch(classes.select("class", "sketch"), similarity, trees)
    order = F.struct(F.xxhash64(F.lit(1), "class"), "class")
    sizes = (first.groupBy("node").agg(F.count("*").alias("size"), F.min(order).alias("p")).where("size > 1")
             .select("node", "size", F.col("p.class").alias("pivot")))
    members = saved(spark, first.join(sizes, "node"), "cps-nodes")
    brief = classes.select("class", "small")
    star = members.where("class <> pivot").select("class", "pivot").distinct()
    met = (star.join(brief, "class").join(brief.select(F.col("class").alias("pivot"), F.col("small").alias("other")), "pivot"))
    close = F.pandas_udf(lambda x, y: _agreement_series(x, y), "double")
    best = (met.select("class", "pivot", close("small", "other").alias("near")).where(F.col("near") >= least)
            .groupBy("class").agg(F.max(F.struct("near", F.col("pivot").alias("b"))).alias("m")))
    pairs = saved(spark, best.select(F.least("class", "m.b").alias("a"), F.greatest("class", "m.b").alias("b")).distinct(), "cps-star")
    ids, keys = classes.select("class", "doc_id"), classes.select("class", "k1", "k2")
    wanted = lambda p: p.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    sets = saved(spark, _full_sets(texts, keys.join(wanted(pairs), "class"), k), "cps-full")
    links = saved(spark, _confirm(pairs, sets, similarity), "cps-links")
    group = components(spark, links).withColumnRenamed("node", "class").withColumnRenamed("component", "comp")

    # 2. what is still apart, node by node and level by level
    labelled = classes.select("class").join(group, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    labelled = saved(spark, labelled, "cps-labelled")
    slim = members.join(labelled, "class").select("node", "class", "comp")
    mixed = slim.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("node")
    now = slim.join(mixed, "node")
    held, before, scratch = None, [members], []
    for level in range(1, depth + 1):
        now = saved(spark, now, f"cps-level-{level}")
        discard(spark, before)
        per = now.groupBy("node", "comp").agg(F.count("*").alias("c"))
        per = per.groupBy("node").agg(F.sum("c").alias("size"), F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps"))
        per = saved(spark, per.where("comps > 1").select("node", "size", F.col("top.comp").alias("major"), (F.col("size") - F.col("top.c")).alias("rest")), f"cps-sizes-{level}")
        direct = (F.col("size") <= small_node) | (F.col("size") * F.col("rest") <= comparisons) | F.lit(level == depth)
        rows = now.join(per.where(direct), "node").join(classes.select("class", "small", "n"), "class")
        rows = saved(spark, rows.withColumn("ask", F.lit(True)), f"cps-held-{level}")   # a union of files, not of plans
        scratch.append(rows)
        held = rows if held is None else held.unionByName(rows)
        large = per.where(~direct).select("node")
        before = [now, per]
        if large.isEmpty():
            discard(spark, before)
            break
        wide = now.join(large, "node", "left_semi").join(classes.select("class", "sketch"), "class")
        now = _branch(wide, similarity)
    def merged(extra: DataFrame) -> DataFrame:
        """Links between components join the components: ``(comp, top_comp)``."""
        ends = (extra.join(labelled.withColumnRenamed("class", "a").withColumnRenamed("comp", "ca"), "a")
                .join(labelled.withColumnRenamed("class", "b").withColumnRenamed("comp", "cb"), "b"))
        joined = components(spark, ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        return joined.withColumnRenamed("node", "comp").withColumnRenamed("component", "top_comp")

    def relabel(df: DataFrame, joined: DataFrame) -> DataFrame:
        return df.join(joined, "comp", "left").withColumn("comp", F.coalesce("top_comp", "comp")).drop("top_comp")

    # each row with its most similar partner first: that joins nearly all that
    # belongs together, and what is then still apart is compared in full
    hits = saved(spark, _compare(_blocks(held, small_node, block), least), "cps-pairs")
    if not hits.isEmpty():
        pairs = hits.select("a", "b").distinct()
        lacking = keys.join(wanted(pairs), "class").join(sets.select("class"), "class", "left_anti")
        sets = sets.unionByName(saved(spark, _full_sets(texts, lacking, k), "cps-full-best"))
        extra = saved(spark, _confirm(pairs, sets, similarity), "cps-links-best")
        # a row without a plausible partner has no more to ask
        asks = hits.select("node", F.col("left").alias("class")).distinct().withColumn("ask", F.lit(True))
        held = held.drop("ask").join(hits.select("node").distinct(), "node", "left_semi").join(asks, ["node", "class"], "left")
        held = saved(spark, held.withColumn("ask", F.coalesce("ask", F.lit(False))), "cps-asking")
        discard(spark, scratch)
        if not extra.isEmpty():
            joined = merged(extra)
            labelled = saved(spark, relabel(labelled, joined), "cps-labelled-best")
            held = held.join(joined.withColumnRenamed("comp", "major").withColumnRenamed("top_comp", "top_major"), "major", "left")
            held = relabel(held.withColumn("major", F.coalesce("top_major", "major")).drop("top_major"), joined)
            apart = held.groupBy("node").agg(F.count(F.when(F.col("comp") != F.col("major"), 1)).alias("rest"))
            held = held.drop("rest").join(apart.where("rest > 0"), "node")
        percent = round(similarity * 100)
        bundles = saved(spark, _bundles(_blocks(held, small_node, block), least, percent), "cps-bundles")
        lacking = keys.join(bundles.select("class").distinct(), "class").join(sets.select("class"), "class", "left_anti")
        sets = sets.unionByName(saved(spark, _full_sets(texts, lacking, k), "cps-full-rest"))
        extra = saved(spark, _joined(bundles, sets, least, percent), "cps-links-rest")
        if not extra.isEmpty():
            labelled = saved(spark, relabel(labelled, merged(extra)), "cps-labelled-rest")

    # 3. the smallest doc_id of each component
    joined = ids.join(labelled, "class")
    lowest = (joined.groupBy("comp").agg(F.min(F.struct("doc_id")).alias("least"))      # a null one first
              .select("comp", F.col("least.doc_id").alias("component_id")))
    final = joined.join(lowest, "comp").select("class", "component_id")
    out = (rows_of.where("class is not null").join(final, "class").select("doc_id", "n", "component_id")
           .unionByName(rows_of.where("class is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _agreement_series(x, y):
    import pandas as pd
    if not len(x):
        return pd.Series([], dtype="float64")
    a, b = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), POSITIONS) for s in (x, y))
    return pd.Series(agreement(a, b))


def _blocks(rows: DataFrame, small_node: int, block: int) -> DataFrame:
    """Groups to compare.  A small node is one group of rows that are right,
    and left if they still ask.  Of a large one the asking rows outside its
    largest component are left, all rows right; either side is cut into blocks
    that meet pairwise."""
    whole = rows.where(F.col("size") <= small_node).select(
        "node", F.lit(0).alias("ga"), F.lit(0).alias("gb"), "class", "small", "n", "comp", F.col("ask").alias("is_left"), F.lit(True).alias("is_right"))
    big = (rows.where(F.col("size") > small_node).withColumn("pa", F.ceil(F.col("rest") / block).cast("int"))
           .withColumn("pb", F.ceil(F.col("size") / block).cast("int")))
    place = lambda parts: F.pmod(F.xxhash64(F.lit(2), "class"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = (big.where("comp <> major and ask").withColumn("ga", place("pa")).withColumn("gb", every("pb"))
            .select("node", "ga", "gb", "class", "small", "n", "comp", F.lit(True).alias("is_left"), F.lit(False).alias("is_right")))
    right = (big.withColumn("gb", place("pb")).withColumn("ga", every("pa"))
             .select("node", "ga", "gb", "class", "small", "n", "comp", F.lit(False).alias("is_left"), F.lit(True).alias("is_right")))
    return whole.unionByName(left).unionByName(right)
