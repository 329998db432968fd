"""Products and brands page: lookups, per-product and per-brand sums, top-k
and the rank-tie table (J1, J2, A8, A9, T1, T2, T4).

Shapes at scale: sales are first summed per product (map-side partial
aggregate, one shuffle on ``product_id``); the product dimension is reduced
to one row per key in the same hash layout, so the brand lookup joins
without a further shuffle of the large side.  Top-k is Spark's distributed
``TakeOrderedAndProject`` (per-partition top k, then a merge of k rows per
partition); name labels are looked up only for the k winners.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from warung.fixed_values import RANKINGS, TOP_N
from warung.functions.scalars import (as_missing, count_text, is_present, key_label,
                                      money_text, short_label)

def _is_double(df: DataFrame, col: str) -> bool:
    return dict(df.dtypes).get(col) in ("double", "float")


def unique_dim(dim: DataFrame, cols=("product_name", "brand")) -> DataFrame:
    """The product dimension with one row per key; a duplicated key is an
    error raised inside the job (a lookup must not multiply sales rows)."""
    dup = F.raise_error(F.concat(F.lit("duplicate product_id in dim_products: "),
                                 F.col("product_id").cast("string")))
    n = F.count(F.lit(1))
    return (dim.groupBy("product_id")
            .agg(n.alias("_n"), *[F.first(c).alias(c) for c in cols])
            .select("product_id", *[F.when(F.col("_n") > 1, dup).otherwise(F.col(c)).alias(c)
                                    for c in cols]))


def per_product(sales: DataFrame) -> DataFrame:
    """Units and profit per product (missing measure values are skipped)."""
    dbl = {c: _is_double(sales, c) for c in ("items", "profit")}
    return (sales.where(F.col("product_id").isNotNull())
            .groupBy("product_id")
            .agg(F.sum(as_missing(F.col("items"), dbl["items"])).alias("units"),
                 F.sum(as_missing(F.col("profit"), dbl["profit"])).alias("profit")))


def per_brand(sales: DataFrame, dim: DataFrame) -> DataFrame:
    """Units and profit per brand; products without a brand drop out."""
    brands = unique_dim(dim.select("product_id", "brand"), ("brand",))
    return (per_product(sales).join(brands, "product_id", "left")
            .where(F.col("brand").isNotNull())
            .groupBy("brand")
            .agg(F.sum("units").alias("units"), F.sum("profit").alias("profit")))


def _top(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """N largest present values; ties go to the lower key."""
    dbl = _is_double(df, value)
    v = as_missing(F.col(value), dbl)
    return (df.select(key, v.alias("value"))
            .where(is_present(F.col("value"), dbl))
            .orderBy(F.col("value").desc(), F.col(key).asc())
            .limit(n))


def _text(measure: str):
    return count_text if measure == "units" else money_text


def top_products(sales: DataFrame, dim: DataFrame, measure: str = "units",
                 n: int = TOP_N) -> DataFrame:
    """Top products by units or profit, with the full display
    name (the key as text when the product is unknown), the shortened label
    and the value text."""
    top = _top(per_product(sales), "product_id", measure, n)
    names = unique_dim(dim.select("product_id", "product_name")
                       .join(F.broadcast(top.select("product_id")), "product_id", "left_semi"),
                       ("product_name",))
    full = key_label(F.col("product_name"), F.col("product_id"))
    rank = F.row_number().over(Window.orderBy(F.col("value").desc(), F.col("product_id")))
    return (top.join(F.broadcast(names), "product_id", "left")
            .select(rank.cast("bigint").alias("rank"), "product_id", full.alias("label"),
                    short_label(full).alias("short_label"),
                    F.col("value").cast("bigint" if measure == "units" else "double").alias("value"),
                    _text(measure)(F.col("value")).alias("text")))


def top_brands(sales: DataFrame, dim: DataFrame, measure: str = "units",
               n: int = TOP_N) -> DataFrame:
    """Top brands by units or profit."""
    top = _top(per_brand(sales, dim), "brand", measure, n)
    rank = F.row_number().over(Window.orderBy(F.col("value").desc(), F.col("brand")))
    return top.select(rank.cast("bigint").alias("rank"), "brand", short_label(F.col("brand")).alias("short_label"),
                      F.col("value").cast("bigint" if measure == "units" else "double").alias("value"),
                      _text(measure)(F.col("value")).alias("text"))


def rank_ties(sales: DataFrame, n: int = TOP_N) -> DataFrame:
    """T4: per ranking (units, profit) the value at #1 and #n, how many of the
    top n equal the #n value, and the value at #n+1.  A ranking with n or
    fewer members is skipped, so the result may have no rows.

    Both rankings are one branch: the per-product sums stacked into (ranking,
    product, value), cut to the n+1 first of each ranking (Spark limits the
    groups of a ranked window before its shuffle), then one aggregate by
    ranking over those few rows.
    """
    per = per_product(sales)
    value_type = "decimal(38,4)"
    labels = dict(zip(("units", "profit"), RANKINGS))
    stacked = (per.select("product_id", F.explode(F.array(*[
        F.struct(F.lit(label).alias("peringkat"), as_missing(F.col(m), _is_double(per, m)).cast(value_type).alias("v"))
        for m, label in labels.items()])).alias("s"))
        .select("product_id", "s.peringkat", "s.v").where(F.col("v").isNotNull()))
    order = Window.partitionBy("peringkat").orderBy(F.col("v").desc(), F.col("product_id"))
    top = stacked.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n + 1)
    at = lambda k: F.max(F.when(F.col("rn") == k, F.col("v").cast("double")))
    first = F.array_sort(F.collect_list(F.when(F.col("rn") <= n, F.col("v").cast("double"))))
    return (top.groupBy("peringkat")                # n + 1 rows per ranking
            .agg(F.count(F.lit(1)).alias("members"), at(1).alias("top_1"), at(n).alias(f"top_{n}"),
                 first.alias("firsts"), at(n + 1).alias(f"top_{n + 1}"))
            .where(F.col("members") > n)
            .select("peringkat", "top_1", f"top_{n}",
                    F.size(F.filter("firsts", lambda x: x == F.col(f"top_{n}"))).cast("bigint").alias(f"ties_in_top_{n}"),
                    f"top_{n + 1}"))
