"""Category co-purchase graph.

Input is the edge table ``category_pairs(kat1, kat2, n)`` with ``kat1 < kat2``
and ``n`` the number of orders holding both categories (built by
``marts.build_category_pairs``).  Node and edge counts are bounded by the
category domain, so the global windows here (volume order, density) run over
a dimension-sized frame, never over fact rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from warung.fixed_values import CO_PURCHASE_SUFFIX, ORDER_SUFFIX, PAIR_JOINER, TILE_SIZE, TOP_PAIRS
from warung.functions.scalars import count_text, percent_text


def _edge_ends(pairs: DataFrame) -> DataFrame:
    """Both ends of every edge stacked into one keyed list."""
    return (pairs.select(F.col("kat1").alias("category"), "n")
            .unionByName(pairs.select(F.col("kat2").alias("category"), "n")))


def category_volume(pairs: DataFrame) -> DataFrame:
    """Weighted degree — sum of ``n`` over the edges touching a node
    (a self pair would count twice); ``ord`` is the volume order (T8)."""
    vol = (_edge_ends(pairs).where(F.col("category").isNotNull())
           .groupBy("category")
           .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("volume")))
    ord_ = F.row_number().over(Window.orderBy(F.col("volume").desc(), F.col("category")))
    return vol.select(ord_.cast("bigint").alias("ord"), "category", "volume")


def graph_nodes(pairs: DataFrame) -> DataFrame:
    """Node list with weight and hover text ``"{k} — {v} co-purchase"``."""
    vol = category_volume(pairs)
    return vol.select("ord", "category", "volume",
                      F.concat(F.col("category"), F.lit(" — "), count_text(F.col("volume")),
                               F.lit(CO_PURCHASE_SUFFIX)).alias("text"))


def graph_edges(pairs: DataFrame) -> DataFrame:
    """Every edge, no threshold, with text ``"a + b: n order"``."""
    return pairs.select("kat1", "kat2", F.col("n").cast("bigint").alias("n"),
                        F.concat(F.col("kat1"), F.lit(" + "), F.col("kat2"), F.lit(": "),
                                 count_text(F.col("n")), F.lit(ORDER_SUFFIX)).alias("text"))


def graph_density(pairs: DataFrame) -> DataFrame:
    """Nodes V, observed pairs E, possible V(V-1)/2 and density E/possible
    in percent (NULL when fewer than two nodes)."""
    v = category_volume(pairs).agg(F.count(F.lit(1)).alias("n_categories"))
    e = pairs.agg(F.count(F.lit(1)).alias("n_pairs"))
    both = v.unionByName(e, allowMissingColumns=True).agg(
        F.max("n_categories").alias("n_categories"), F.max("n_pairs").alias("n_pairs"))
    possible = F.expr("n_categories * (n_categories - 1) div 2")
    dens = F.col("n_pairs").cast("double") / F.nullif(F.col("possible"), F.lit(0)).cast("double") * 100.0
    return (both.select(F.coalesce("n_categories", F.lit(0)).cast("bigint").alias("n_categories"),
                        F.coalesce("n_pairs", F.lit(0)).cast("bigint").alias("n_pairs"))
            .withColumn("possible", possible.cast("bigint"))
            .withColumn("density", dens)
            .withColumn("text", percent_text(F.col("density"), 0)))


def assert_unique_edges(pairs: DataFrame) -> DataFrame:
    """Each unordered pair must appear once (a repeat would be ambiguous: the
    drawn matrix keeps only one of them).  Checked inside the job."""
    a, b = F.least("kat1", "kat2"), F.greatest("kat1", "kat2")
    dup = F.raise_error(F.concat(F.lit("duplicate category pair: "), F.col("a"), F.lit(" + "), F.col("b")))
    return (pairs.groupBy(a.alias("a"), b.alias("b"))
            .agg(F.count(F.lit(1)).alias("_k"), F.first("n").alias("n"))
            .select(F.col("a").alias("kat1"), F.col("b").alias("kat2"),
                    F.when(F.col("_k") > 1, dup).otherwise(F.col("n")).alias("n")))


def co_purchase_matrix(pairs: DataFrame) -> DataFrame:
    """The symmetric category x category matrix in sparse long form
    ``(y_ord, y, x_ord, x, z)``, axes in volume order.

    Two rows per edge, one in each direction; a pair that is absent means 0,
    and the diagonal (drawn empty) is absent too, so the rows grow with the
    observed edges and not with the square of the categories.

    The checked edge list is turned into both directions once (U2); node
    volumes are the sums of that list per row end (each edge counts once per
    end, a self pair twice — the same weighted degree as G1).
    """
    edges = assert_unique_edges(pairs)
    sym = (edges.select(F.col("kat1").alias("y"), F.col("kat2").alias("x"), "n")
           .unionByName(edges.select(F.col("kat2").alias("y"), F.col("kat1").alias("x"), "n")))
    vol = (sym.where(F.col("y").isNotNull())
           .groupBy("y").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("volume")))
    order = Window.orderBy(F.col("volume").desc(), F.col("y"))
    nodes = vol.select(F.row_number().over(order).cast("bigint").alias("ord"), "y")
    return (sym.where(F.col("y") != F.col("x"))
            .join(nodes.withColumnRenamed("ord", "y_ord"), "y")
            .join(nodes.select(F.col("ord").alias("x_ord"), F.col("y").alias("x")), "x")
            .select("y_ord", "y", "x_ord", "x", F.coalesce(F.col("n").cast("double"), F.lit(0.0)).alias("z")))


def co_purchase_tile(pairs: DataFrame, y_from: int = 1, x_from: int = 1, size: int = TILE_SIZE) -> DataFrame:
    """G2/J6/U2, drawn: ``(y_ord, y, x_ord, x, z)`` for every cell of a square
    tile of the matrix, ``size`` nodes a side from the places ``y_from`` and
    ``x_from`` of the volume order: 0 where no order holds both categories,
    NULL on the diagonal.

    At most ``size`` squared rows, whatever the number of categories: the
    tile's row nodes are spread over its columns' places, nodes and edges then
    meet them by equi-joins.  A tile that reaches past the last node ends there.
    """
    nodes = category_volume(pairs).select("ord", F.col("category").alias("name"))
    places = F.sequence(F.lit(x_from).cast("bigint"), F.lit(x_from + size - 1).cast("bigint"))
    cells = (nodes.where(F.col("ord").between(y_from, y_from + size - 1))
             .select(F.col("ord").alias("y_ord"), F.col("name").alias("y"), F.explode(places).alias("x_ord"))
             .join(nodes.select(F.col("ord").alias("x_ord"), F.col("name").alias("x")), "x_ord"))
    edges = assert_unique_edges(pairs)
    z = F.when(F.col("y") != F.col("x"), F.coalesce(F.col("n").cast("double"), F.lit(0.0)))
    return (cells.withColumn("kat1", F.least("y", "x")).withColumn("kat2", F.greatest("y", "x"))
            .join(edges, ["kat1", "kat2"], "left")
            .select("y_ord", "y", "x_ord", "x", z.alias("z")))


def top_pairs(pairs: DataFrame, n: int = TOP_PAIRS) -> DataFrame:
    """The n most frequent pairs with label ``"a  +  b"``; ties by name."""
    top = (pairs.where(F.col("n").isNotNull())
           .orderBy(F.col("n").desc(), "kat1", "kat2").limit(n))
    rank = F.row_number().over(Window.orderBy(F.col("n").desc(), "kat1", "kat2"))
    return top.select(rank.cast("bigint").alias("rank"), "kat1", "kat2", F.col("n").cast("bigint").alias("n"),
                      F.concat(F.col("kat1"), F.lit(PAIR_JOINER), F.col("kat2")).alias("label"),
                      count_text(F.col("n")).alias("text"))


def write_network(pairs: DataFrame, path: str) -> None:
    """Write the drawable network (nodes and edges) as parquet."""
    graph_nodes(pairs).write.mode("overwrite").parquet(f"{path.rstrip('/')}/nodes")
    graph_edges(pairs).write.mode("overwrite").parquet(f"{path.rstrip('/')}/edges")

