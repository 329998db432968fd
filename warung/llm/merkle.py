"""Merkle manifest of a dataset by a butterfly exchange.

Every row is a leaf digest, every value of ``tree_col`` a tree over its leaves
in order, and the subroots are the leaves of one tree above.  While several
nodes remain, each run of ``fanout`` consecutive ones becomes their digest.

Leaves are ranked by a distributed sort and dealt into aligned blocks of
``fanout ** levels``; a block is a partition of the tree that one row holds.
Then the blocks swap subtree roots round by round: in round ``r`` the aligned
groups of ``fanout`` subtrees of ``fanout ** r`` blocks exchange their roots,
each block sending its own to the block at the same place in every sibling
subtree (in the ragged last subtree a block stands in for several places).
Every block hashes its ancestor for itself, so after the last round it holds
the root and all upper siblings of its leaves, without a pass downwards; no
block gets more than ``fanout`` messages in a round.

Defined results: a null field counts as ``-``; a null tree comes first; leaves
of one id follow one another by digest, ids that are null come first; repeated
rows are leaves each; a null id is never picked for tampering; an empty table
yields no row.  Columns that are not fields are left aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from warung.llm.store import saved

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ------------------------------------------------------------------- digests
def sized(c: Column) -> Column:
    """A field's bytes with their count before them; ``-`` if null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[sized(c) for c in fields]).cast("binary"), 256)


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def grown(nodes: list[str], fanout: int, height: int | None = None) -> list[list[str]]:
    """The levels above ``nodes``, them included: ``height`` levels, or as many
    as leave one node."""
    out = [nodes]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        out.append([digest(out[-1][k:k + fanout]) for k in range(0, len(out[-1]), fanout)])
    return out


def fold(node: str, path: Sequence[tuple[int, Sequence[str]]]) -> str:
    """The root that follows from a node and its (place, siblings) by level."""
    for place, siblings in path:
        node = digest([*siblings[:place], node, *siblings[place:]])
    return node


# ------------------------------------------------------------------ the forest
def ranked(spark: SparkSession, leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """``leaves(tree, ...)`` with ``idx`` and ``total`` in their tree, by a
    distributed sort and a count for each sorting task and tree."""
    line = saved(spark, leaves.orderBy("tree", *order).withColumn("_at", F.monotonically_increasing_id()), "merkle-line")
    part = F.shiftright("_at", 33).alias("_part")
    runs = line.groupBy(part, "tree").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    by = W.partitionBy("tree")                                         # a row per sorting task
    runs = saved(spark, runs.select(F.col("_part").alias("p"), F.col("tree").alias("t"), "first", F.sum("n").over(by).alias("total"),
                                    (F.sum("n").over(by.orderBy("_part")) - F.col("n")).alias("before")), "merkle-runs")
    met = line.withColumn("_part", part).join(runs, (F.col("_part") == F.col("p")) & (F.col("tree") == F.col("t")))
    return met.select(*leaves.columns, (F.col("before") + F.col("_at") - F.col("first")).alias("idx"), "total")


def blocks(spark: SparkSession, leaves: DataFrame, order: Sequence[str], fanout: int, levels: int) -> DataFrame:
    """``tree, block, total, digest, members``: aligned blocks with the root of
    their own part of the tree; a member is ``(idx, id, leaf, other)``."""
    size = fanout ** levels
    rows = ranked(spark, leaves, order).withColumn("block", F.expr(f"idx div {size}"))
    member = F.struct("idx", "id", "leaf", "other")
    held = rows.groupBy("tree", "block").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(member)).alias("members"))

    def root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = []
            for total, nodes in zip(batch.column("total").to_pylist(), batch.column("members").to_pylist(), strict=True):
                roots.append(grown([m["leaf"] for m in nodes], fanout, levels if total > size else None)[-1][0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], [*batch.schema.names, "digest"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in held.dtypes)
    return saved(spark, held.mapInArrow(root, f"{kinds}, digest string"), "merkle-blocks")


def butterfly(spark: SparkSession, held: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``tree, block, digest, path``: each block's root of its whole tree and
    the siblings of its ancestors, one array a round."""
    size = fanout ** levels
    n = F.ceil(F.col("total") / size).cast("long")
    now = held.select("tree", "block", n.alias("n"), "digest", F.array().cast("array<array<string>>").alias("path"))
    most = now.agg(F.max("n")).first()[0] or 1
    step = 1
    while step < most:                                                 # log(blocks) rounds
        nodes = F.expr(f"(n + {step - 1}) div {step}")
        a, low = F.expr(f"block div {step}"), F.col("block") % step
        blocks_of = lambda x: F.least(F.lit(step), F.col("n") - x * step)
        first = F.expr(f"(block div {step * fanout}) * {fanout}")
        sent = now.where(nodes > 1).select("*", a.alias("a"), low.alias("low"), blocks_of(a).alias("mine"),
                                           F.explode(F.sequence(first, F.least(first + fanout - 1, nodes - 1))).alias("to"))
        places = F.when(F.col("to") == F.col("a"), F.array("low")).when(
            F.col("low") < blocks_of(F.col("to")), F.sequence("low", blocks_of(F.col("to")) - 1, F.col("mine")))
        own = F.col("to") == F.col("a")
        sent = sent.select("tree", "n", "to", "digest", (F.col("a") % fanout).alias("place"), F.when(own, F.col("path")).alias("path"), F.explode(places).alias("k"))
        met = sent.groupBy("tree", (F.col("to") * step + F.col("k")).alias("block")).agg(
            F.max("n").alias("n"), (F.max("to") % fanout).alias("own"), F.first("path", ignorenulls=True).alias("path"),
            F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("run"))
        whole = F.sha2(F.array_join(F.col("run.digest"), "").cast("binary"), 256)
        others = F.transform(F.filter("run", lambda x: x["place"] != F.col("own")), lambda x: x["digest"])
        met = met.select("tree", "block", "n", whole.alias("digest"), F.array_append("path", others).alias("path"))
        now = saved(spark, now.where(nodes <= 1).unionByName(met), f"merkle-round-{step}")
        step *= fanout
    return now.drop("n")


def _local_paths(nodes: list[str], fanout: int, height: int | None) -> Iterator[list[tuple[int, list[str]]]]:
    """Each node's places and siblings within its block."""
    levels = grown(nodes, fanout, height)[:-1]
    for j in range(len(nodes)):
        path, k = [], j
        for level in levels:
            run = k // fanout * fanout
            near = level[run:run + fanout]
            path.append((k - run, near[:k - run] + near[k - run + 1:]))
            k //= fanout
        yield path


def _upper(block: int, path: list[list[str]], fanout: int) -> list[tuple[int, list[str]]]:
    return [(block // fanout ** r % fanout, siblings) for r, siblings in enumerate(path)]


def _members(batch: pa.RecordBatch, fanout: int, levels: int) -> Iterator[tuple[dict, dict, list[tuple[int, list[str]]]]]:
    """(row, member, path within the tree) of every leaf."""
    for k in range(batch.num_rows):
        row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
        upper = _upper(row["block"], row["path"], fanout)
        local = _local_paths([m["leaf"] for m in row["members"]], fanout, levels if row["total"] > fanout ** levels else None)
        for m, path in zip(row["members"], local, strict=True):
            yield row, m, path + upper


def _forest(spark: SparkSession, leaves: DataFrame, order: Sequence[str], fanout: int, levels: int) -> DataFrame:
    held = blocks(spark, leaves, order, fanout, levels)
    up = butterfly(spark, held, fanout, levels).select(F.col("tree").alias("_t"), F.col("block").alias("_b"), F.col("digest").alias("subroot"), "path")
    met = held.drop("digest").join(up, (F.col("tree") == F.col("_t")) & (F.col("block") == F.col("_b")))
    return met.select("tree", "block", "total", "members", "path", "subroot")


def manifest(spark: SparkSession, docs: DataFrame, *, fields: Sequence[str] = tuple(FIELDS), id_col: str = "doc_id", tree_col: str = "lang",
             received: Column | None = None, fanout: int = 8, levels: int = 3) -> DataFrame:
    """``id_col, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    ``received`` is the leaf digest of the row as it has come back (null: as it
    was); ``folded_root`` follows from it and the manifest's siblings, and
    ``verified`` says whether it is the root.
    """
    leaf = leaf_digest([F.col(c) for c in fields])
    # a tree's name with null before all others; strings compare by their bytes
    name = F.coalesce(F.concat(F.lit("1"), F.col(tree_col).cast("string")), F.lit("0"))
    rows = docs.select(name.alias("tree"), F.col(id_col).alias("id"), leaf.alias("leaf"), (F.lit(None).cast("string") if received is None else received).alias("other"))
    rows = saved(spark, rows.withColumn("_rid", F.monotonically_increasing_id()), "merkle-leaves")   # the row id splits runs of equal rows
    trees = _forest(spark, rows, ["id", "leaf", "_rid"], fanout, levels)

    # the subroots are the leaves of one tree
    tops = trees.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("subroot").alias("leaf"), F.lit(None).cast("string").alias("other"))
    tops = _forest(spark, tops, ["id"], fanout, levels)

    def top_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(m["id"], [p for p, _ in path], [s for _, s in path], row["subroot"]) for row, m, path in _members(batch, fanout, levels)]
            names, places, siblings, root = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(places, pa.list_(pa.int32())), pa.array(siblings, pa.list_(pa.list_(pa.string()))), pa.array(root, pa.string())],
                ["_tree", "top_places", "top_siblings", "root"])

    above = tops.mapInArrow(top_paths, "_tree string, top_places array<int>, top_siblings array<array<string>>, root string")
    met = trees.join(above, F.col("tree") == F.col("_tree")).drop("tree", "_tree")

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8):
                part = batch.slice(at, 8)
                kind = part.schema.field("members").type.value_type.field("id").type
                out: list[list] = [[], [], [], [], [], []]
                for row, m, path in _members(part, fanout, levels):
                    path = path + list(zip(row["top_places"], row["top_siblings"], strict=True))
                    proof = hashlib.sha256()
                    for _, siblings in path:
                        proof.update("".join(siblings).encode())
                    for column, value in zip(out, (m["id"], m["leaf"], row["subroot"], row["root"], proof.hexdigest(), fold(m["other"] or m["leaf"], path)), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], kind), *(pa.array(c, pa.string()) for c in out[1:])],
                                                 ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = met.mapInArrow(prove, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def tampered_leaf(fields: Sequence[str] = tuple(FIELDS), *, id_col: str = "doc_id", text_col: str = "text", every: int = 3) -> Column:
    """The leaf of a row whose text came back with A-Z lower-cased, where
    ``every`` divides the CRC-32 of the id in decimal; else null."""
    changed = [F.translate(c, UPPER, LOWER) if c == text_col else F.col(c) for c in fields]
    picked = F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0
    return F.when(picked, leaf_digest(changed))
