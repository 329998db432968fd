"""Sales summary page: KPI row, trends, orders by status, category table.

A1-A4, A7, R1-R6.  Every input is an already filtered fact (see
``filters.filter_all``); every output is small (one row, a bucket series, a
domain-sized table), and only that small result ever leaves the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from warung.fixed_values import KPI_CARDS, STATUS_ORDER, TREND_SERIES
from warung.functions.scalars import (at_least_one, bucket_start, count_share_text,
                                      count_text, grain_step, money_text, percent_of,
                                      percent_text)


def domain(df: DataFrame, name: str, values: list) -> DataFrame:
    """A small inline domain ``(ord, name)``; its size is fixed by the list."""
    rows = ", ".join(f"({i + 1}, '{v}')" for i, v in enumerate(values))
    return df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(ord, {name})")


def distinct_products(products: DataFrame, *keys: str) -> DataFrame:
    """A3: exact number of products per ``keys``, from product bitmaps
    (``filters.product_sets``) or, without, from a fact."""
    if "products" not in products.columns:
        return products.groupBy(*keys).agg(F.count_distinct("product_id").alias("n_products"))
    union = products.groupBy(*keys, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("products")).alias("n"))
    return union.groupBy(*keys).agg(F.sum("n").alias("n_products"))


def kpi_cards(sales: DataFrame, orders: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """A1-A3: one row — gross sales, profit, orders, cancel rate (%), distinct
    products sold.

    Sales and orders carry their own filters; when the order fact has no
    category column the category filter does not reach it, so the cancel rate
    may cover more than the sales KPIs (kept as in the dashboard).  The two
    global aggregates are stacked and folded into one row (no join).

    With ``products`` (product sets, or the sales fact, under the same filters)
    ``sales`` may be the rollup: sums come from it, distinct products from there.
    """
    s = sales.agg(F.sum("gross_sales").alias("gross_sales"), F.sum("profit").alias("profit"))
    p = distinct_products(sales if products is None else products).withColumnRenamed("n_products", "products_sold")
    o = orders.agg(
        F.sum("orders").alias("orders"),
        F.sum(F.when(F.col("status") == "Cancelled", F.col("orders"))).alias("cancelled"))
    both = s.unionByName(p, allowMissingColumns=True).unionByName(o, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("gross_sales", "profit", "products_sold",
                                      "orders", "cancelled")])
    return both.select(
        F.coalesce(F.col("gross_sales").cast("double"), F.lit(0.0)).alias("gross_sales"),
        F.coalesce(F.col("profit").cast("double"), F.lit(0.0)).alias("profit"),
        F.coalesce(F.col("orders").cast("bigint"), F.lit(0).cast("bigint")).alias("orders"),
        F.coalesce(percent_of(F.coalesce(F.col("cancelled"), F.lit(0)),
                              at_least_one(F.col("orders"))), F.lit(0.0)).alias("cancel_rate"),
        F.coalesce(F.col("products_sold"), F.lit(0).cast("bigint")).alias("products_sold"))


def orders_by_status(orders: DataFrame) -> DataFrame:
    """Orders per status of the fixed domain, with its share of the
    domain total (unknown statuses drop out of both); ascending by orders."""
    per = (orders.where(F.col("status").isNotNull())
           .groupBy("status").agg(F.sum("orders").alias("orders")))
    kept = per.join(F.broadcast(domain(orders, "status", STATUS_ORDER)), "status")
    total = at_least_one(F.sum("orders").over(Window.partitionBy()))
    return (kept.select("status", F.col("orders").cast("bigint").alias("orders"),
                        percent_of(F.col("orders"), total).alias("share"))
            .withColumn("text", count_share_text(F.col("orders"), F.col("share")))
            .orderBy("orders", "status"))


def category_table(sales: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Per category units, gross, profit and distinct products; by gross
    desc.  With ``products`` ``sales`` may be the rollup, as in ``kpi_cards``."""
    known = F.col("category").isNotNull()
    sums = (sales.where(known).groupBy("category")
            .agg(F.sum("items").cast("bigint").alias("unit"),
                 F.sum("gross_sales").cast("double").alias("gross"),
                 F.sum("profit").cast("double").alias("profit")))
    count = distinct_products((sales if products is None else products).where(known), "category").withColumnRenamed("n_products", "produk_unik")
    return (sums.join(count, "category", "left")
            .select("category", "unit", "gross", "profit", F.coalesce("produk_unik", F.lit(0)).cast("bigint").alias("produk_unik"))
            .orderBy(F.col("gross").desc(), "category"))


def trend(sales: DataFrame, grain: str = "month") -> DataFrame:
    """Gross sales and profit per day / Monday week / month.

    Every bucket between the first and the last bucket of the *filtered* data
    is present; empty ones are 0.  One pass over the fact: the per-bucket
    aggregate (map-side combined) is followed by a window over the bucket
    series, which is as long as the covered time span whatever the data
    volume; each bucket emits itself plus the empty buckets up to the next
    one (``sequence(bucket, next - step)``), so no calendar join and no
    second scan are needed.
    """
    per = (sales.where(F.col("tanggal").isNotNull())
           .groupBy(bucket_start(F.col("tanggal"), grain).alias("tanggal"))
           .agg(F.sum("gross_sales").alias("gross_sales"), F.sum("profit").alias("profit")))
    step = grain_step(grain)
    with_next = per.withColumn("nxt", F.lead("tanggal").over(Window.orderBy("tanggal")))
    upto = F.coalesce(F.col("nxt") - step, F.col("tanggal"))
    filled = with_next.select(F.posexplode(F.sequence(F.col("tanggal"), upto, step)).alias("i", "bucket"),
                              "gross_sales", "profit")
    own = F.col("i") == 0
    return (filled
            .select(F.col("bucket").cast("timestamp_ntz").alias("tanggal"),
                    F.when(own, F.col("gross_sales").cast("double")).otherwise(F.lit(0.0)).alias("gross_sales"),
                    F.when(own, F.col("profit").cast("double")).otherwise(F.lit(0.0)).alias("profit"))
            .orderBy("tanggal"))


def trend_long(trend_df: DataFrame) -> DataFrame:
    """The two series in long form, with the last bucket flagged (the
    end-of-line label)."""
    names = F.create_map(*[x for k, v in TREND_SERIES.items() for x in (F.lit(k), F.lit(v))])
    long = trend_df.unpivot("tanggal", list(TREND_SERIES), "kolom", "value")
    last = F.max("tanggal").over(Window.partitionBy())
    return long.select(names[F.col("kolom")].alias("series"), "tanggal", "value",
                       (F.col("tanggal") == last).alias("is_last"))


def trend_end_labels(trend_df: DataFrame) -> DataFrame:
    """Latest bucket and its value per series."""
    long = trend_df.unpivot("tanggal", list(TREND_SERIES), "kolom", "value")
    names = F.create_map(*[x for k, v in TREND_SERIES.items() for x in (F.lit(k), F.lit(v))])
    return (long.groupBy("kolom")
            .agg(F.max("tanggal").alias("tanggal"), F.max_by("value", "tanggal").alias("value"))
            .select(names[F.col("kolom")].alias("series"), "tanggal", "value"))


def report_labels(kpi: DataFrame) -> DataFrame:
    """The KPI row as the five card texts ``(ord, card, text)``:
    money as ``$1,234``, counts with grouping, the cancel rate as ``12.3%``."""
    texts = [money_text(F.col("gross_sales")), money_text(F.col("profit")),
             count_text(F.col("orders")), percent_text(F.col("cancel_rate")),
             count_text(F.col("products_sold"))]
    cards = F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.lit(name).alias("card"), t.alias("text"))
                      for i, (name, t) in enumerate(zip(KPI_CARDS, texts))])
    return kpi.select(F.explode(cards).alias("c")).select("c.ord", "c.card", "c.text")
