"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected to blocks of eight dimensions by random orthonormal
rows, scaled, and decoded to the nearest point of the E8 lattice, in several
independent tables.  A vector is stored in its own cell and in the few
neighbouring cells nearest to it; vectors that meet in a cell are compared by
cosine in double precision.  The number of tables follows from a simulation of
pairs exactly at the threshold.

Equal vectors are collapsed before anything is compared and counted by their
number.  A cell over ``block`` rows is cut into parts whose pairs are separate
groups, so no group grows with the data and no comparison is dropped.  A link
found in several cells counts in the first only, which each side can work out
by itself, so no list of pairs is ever shuffled.

Defined results: a vector that is null, empty, zero or holds a null or
non-finite component, or whose label is null, links with nothing; vectors of
different length do not link; repeated rows link with each other and share
their class's component; ties take the smallest id.  A null id is none: a
component takes the smallest of its other ids, and of rows without one only
those are kept whose component has no id at all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warung.llm import textscan as S
from warung.llm.components import components
from warung.llm.store import saved


# ------------------------------------------------------------------- lattice
def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum."""
    p = np.rint(x)
    gap = x - p
    odd = p.sum(1) % 2 != 0
    rows = np.flatnonzero(odd)
    at = np.abs(gap[rows]).argmax(1)
    p[rows, at] += np.where(gap[rows, at] >= 0, 1.0, -1.0)
    return p


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: D8, or D8 shifted by one half in every coordinate."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    closer = ((x - b) ** 2).sum(1) < ((x - a) ** 2).sum(1)
    a[closer] = b[closer]
    return a


@lru_cache
def shortest_vectors() -> np.ndarray:
    """The 240 lattice vectors of length sqrt(2), from the lattice's definition."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        v = np.array([0.5 if bits >> k & 1 else -0.5 for k in range(8)])
        if v.sum() % 2 == 0:
            out.append(v)
    return np.array(out)


@lru_cache(maxsize=256)
def _rows(dim: int, table: int, blocks: int, seed: int) -> np.ndarray:
    """``8 * blocks`` random orthonormal rows (Gaussian ones beyond ``dim``)."""
    rng = np.random.default_rng([seed, table, dim])
    g = rng.normal(size=(dim, 8 * blocks))
    if 8 * blocks <= dim:
        g = np.linalg.qr(g)[0]
    else:
        g /= math.sqrt(dim)
    return g


def cells(unit: np.ndarray, table: int, *, step: float, probes: int, blocks: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each row's own cell (n) and of its neighbouring cells
    (n, probes * blocks): a neighbour differs in one block."""
    n, dim = unit.shape
    shift = np.random.default_rng([seed, table]).random(8 * blocks)
    x = unit @ _rows(dim, table, blocks, seed) / step + shift
    point = np.empty((n, 8 * blocks))
    for k in range(blocks):
        point[:, 8 * k:8 * k + 8] = nearest_e8(x[:, 8 * k:8 * k + 8])

    def code(p: np.ndarray) -> np.ndarray:
        whole = (2 * p).astype(np.int64).view(np.uint64)
        return S.mix((whole * S.powers(p.shape[1])).sum(1, dtype=np.uint64) + np.uint64(table))

    around = np.empty((n, probes * blocks), dtype=np.uint64)
    short = shortest_vectors()
    for k in range(blocks):
        part = slice(8 * k, 8 * k + 8)
        if probes:
            toward = (x[:, part] - point[:, part]) @ short.T
            best = np.argpartition(-toward, probes - 1, axis=1)[:, :probes]
            for j in range(probes):
                moved = point.copy()
                moved[:, part] += short[best[:, j]]
                around[:, k * probes + j] = code(moved)
    return code(point), around


def _meets(home: np.ndarray, around: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows ``a`` and ``b`` share a cell that one of them owns."""
    return ((home[a] == home[b]) | (around[b] == home[a][:, None]).any(1) | (around[a] == home[b][:, None]).any(1))


@lru_cache
def tables_for(threshold: float, dim: int, miss: float, ratio: float, probes: int, blocks: int, seed: int, trials: int = 4000) -> int:
    """Tables that leave a pair exactly at the threshold unfound with at most
    the probability ``miss``."""
    rng = np.random.default_rng(seed + 1)
    u = rng.normal(size=(trials, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=(trials, dim))
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = threshold * u + math.sqrt(max(0.0, 1 - threshold ** 2)) * w
    both = np.concatenate([u, v])
    home, around = cells(both, 0, step=cell_step(threshold, dim, ratio), probes=probes, blocks=blocks, seed=seed)
    rate = _meets(home, around, np.arange(trials), np.arange(trials) + trials).mean()
    return max(1, math.ceil(math.log(miss) / math.log(max(1e-12, 1 - min(rate, 0.999999)))))


def cell_step(threshold: float, dim: int, ratio: float) -> float:
    """Lattice unit, so that pairs at the threshold are ``ratio`` units apart."""
    return math.sqrt(2 - 2 * threshold) * math.sqrt(8 / max(dim, 8)) / ratio


# --------------------------------------------------------------- group by cell
def _links(ids, table, part, vectors, own, threshold, setting) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (positions) of one cell that are to be linked here."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cosine = unit @ unit.T
    near = np.argwhere(np.triu(cosine >= threshold - 1e-9, 1))
    if not len(near):
        return near[:, 0], near[:, 1]
    a, b = near[:, 0], near[:, 1]
    ok = (own[a] | own[b]) & (ids[a] != ids[b])
    low, high = part
    if low != high:                               # a pair of parts: only pairs across
        side = setting["side"](ids)
        ok &= side[a] != side[b]
    a, b = a[ok], b[ok]
    dot = (vectors[a] * vectors[b]).sum(1)
    size = np.sqrt((vectors ** 2).sum(1))
    ok = dot / (size[a] * size[b]) >= threshold
    a, b = a[ok], b[ok]
    if not len(a):
        return a, b
    used, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    ua, ub = back[:len(a)], back[len(a):]
    first = np.ones(len(a), dtype=bool)
    for t in range(table + 1):
        home, around = cells(unit[used], t, **setting["lattice"])
        if t < table:
            first &= ~_meets(home, around, ua, ub)
        else:                                     # both may look into the other's cell
            twice = (around[ub] == home[ua][:, None]).any(1) & (around[ua] == home[ub][:, None]).any(1)
            smaller = np.where(ids[a] < ids[b], own[a], own[b])
            first &= ~twice | smaller | (own[a] & own[b])
        if not first.any():
            break
    return a[first], b[first]


def _roots(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that each position reaches."""
    root = ids.copy()
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == root).all():
            return root
        root = new


def near_duplicates(spark: SparkSession, vectors: DataFrame, *, threshold: float = 0.98, miss: float = 1e-4, ratio: float = 0.35,
                    probes: int = 2, blocks: int | None = None, block: int = 2048, seed: int = 17, id_col: str = "vec_id",
                    vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    ``blocks`` of eight projected dimensions make a cell code; by default their
    number grows with the logarithm of the rows, which keeps the number of
    unlike vectors that share a cell about constant.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"),
                          F.col(label_col).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("v", lambda x: x != 0)
    good = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & finite & nonzero, F.lit(False))
    rows = rows.withColumn("good", good)
    usable = rows.where("good")
    classes = usable.groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("m"))
    classes = saved(spark, classes.withColumn("id", F.monotonically_increasing_id()), "lattice-classes")   # ids of the classes' own
    facts = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    dim = facts["dim"] or 8
    if blocks is None:
        blocks = max(1, min(dim // 8, math.ceil(math.log(max(facts["n"], 2) / 1e5) / math.log(250))))
    lattice = {"step": cell_step(threshold, dim, ratio), "probes": probes, "blocks": blocks, "seed": seed}
    tables = tables_for(threshold, dim, miss, ratio, probes, blocks, seed)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each cell that a vector is in."""
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, m, label = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "m", "tag"))
                found = part.column("v").to_pylist()
                size = np.array([len(v) for v in found])
                for d in np.unique(size):
                    rows_d = np.flatnonzero(size == d)
                    unit = np.array([found[k] for k in rows_d])
                    unit /= np.abs(unit).max(1, keepdims=True)
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    salt = S.mix(label[rows_d].astype(np.int64).view(np.uint64) + np.uint64(d))
                    stored = part.column("v").take(pa.array(rows_d))
                    for t in range(tables):
                        home, around = cells(unit, t, **lattice)
                        for k, code in enumerate([home, *around.T]):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array((code ^ salt).view(np.int64)), pa.array(np.full(len(rows_d), t, np.int32)),
                                 pa.array(np.full(len(rows_d), k == 0)), pa.array(ids[rows_d]), pa.array(m[rows_d]), stored],
                                ["cell", "tab", "own", "id", "m", "v"])

    tagged = classes.select("id", "m", F.xxhash64("label").alias("tag"), "v")
    dealt = tagged.mapInArrow(deal, "cell long, tab int, own boolean, id long, m long, v array<double>")
    # cells that hold one vector, or none that owns them, have nothing to compare
    sizes = (dealt.groupBy("cell", "tab").agg(F.count("*").alias("n"), F.max("own").alias("any_own"))
             .where("n > 1 and any_own").withColumn("parts", F.ceil(F.col("n") / block).cast("int")).drop("any_own", "n"))
    kept = dealt.join(sizes, ["cell", "tab"])
    side = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.col("parts")).cast("int")
    kept = kept.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    kept = kept.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other")).drop("other", "parts")
    spread = kept.repartition("cell", "tab", "low", "high").sortWithinPartitions("cell", "tab", "low", "high")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Walks the sorted rows group by group."""
        def solve(group: pa.Table) -> pa.RecordBatch | None:
            ids = group.column("id").to_numpy()
            sizes_v = np.array(group.column("v").combine_chunks().value_lengths())
            if len(ids) < 2 or (sizes_v != sizes_v[0]).any():
                return None
            vec = group.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            m = group.column("m").to_numpy()
            own = group.column("own").to_numpy(zero_copy_only=False)
            sides = group.column("side").to_numpy()
            part = (group.column("low")[0].as_py(), group.column("high")[0].as_py())
            a, b = _links(ids, group.column("tab")[0].as_py(), part, vec, own, threshold,
                          {"lattice": lattice, "side": lambda _: sides})
            if not len(a):
                return None
            links = np.bincount(a, m[b], len(ids)) + np.bincount(b, m[a], len(ids))
            root = _roots(len(ids), a, b, ids)
            at = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at].astype(np.int64)), pa.array(root[at])],
                                              ["id", "links", "root"])

        rest: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if rest is None else pa.concat_tables([rest, now])
            if not now.num_rows:
                continue
            keys = [now.column(c).to_numpy() for c in ("cell", "tab", "low", "high")]
            edge = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            starts = np.concatenate([[0], edge])
            for begin, end in zip(starts[:-1], starts[1:], strict=True):
                if end - begin > 1 and (out := solve(now.slice(begin, end - begin))) is not None:
                    yield out
            rest = now.slice(starts[-1])
        if rest is not None and rest.num_rows and (out := solve(rest)) is not None:
            yield out

    found = saved(spark, spread.mapInArrow(compare, "id long, links long, root long"), "lattice-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    group = components(spark, found.select(F.col("id").alias("a"), F.col("root").alias("b")).where("a <> b").distinct())
    lowest = (group.join(classes.select(F.col("id").alias("node"), "least"), "node")
              .groupBy("component").agg(F.min("least").alias("lowest")))
    group = group.join(lowest, "component").select(F.col("node").alias("id"), "component", "lowest")
    one = (classes.join(links, "id", "left").join(group, "id", "left")
           .select("label", "v", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                   F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("lowest")).alias("component_id")))
    linked = usable.join(one, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id",
                                            F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
