"""Summary tables ("marts") the dashboard reads, and how they are kept.

Builders (B1-B5) turn the source tables into the marts; all of them are lazy
DataFrames, so a caller that only needs some columns of a mart only pays for
those.  ``load_mart`` (S1-S8) keeps a written copy of the marts under a root
path and reuses it when it is complete and current, else rebuilds and
rewrites it.

Mapping from the source tables (our choice; the dashboard fixes only the
output columns):

* category = ``p_type`` + ' ' + last word of ``p_name``; brand = ``p_brand``;
  product = part.
* tanggal = day of ``o_orderdate``.
* status = 5-LOW & F -> Returned, 5-LOW & P -> Cancelled, else
  F -> Complete, O -> Shipped, P -> Processing.
* items = sum of whole quantities; gross_sales = sum of ``l_extendedprice`` as
  decimal(12,2); profit = sum over lines of
  ``l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice`` as
  decimal(18,4).  Sums are decimal so they are exact and do not depend on the
  order in which partitions are added.
* event_type = view -> product, click -> cart, purchase -> purchase,
  error -> cancel, others unchanged; traffic source = ``user_id mod 5`` into
  the fixed source list; sessions = distinct users per day, event type and
  source (a session is a user-day: the events carry no session id).
* category_pairs = number of orders holding both categories.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warung.fixed_values import (FACTS_WITH_DATE, FORECAST_TABLES,
                                 GRAPH_TABLE, MART_TABLES, PRODUCT_BITS_TABLE, ROLLUP_TABLE, TRAFFIC_SOURCES)
from warung.functions.scalars import day_ts
from warung.sources.tables import read_table

# Value ranges of one line: prices below 10^10, discounts below 10, unit costs
# below 10^7 and quantities below 10^5.  With these a line's amounts stay within
# 18 digits, so Spark computes them on 64-bit longs instead of BigDecimal; a
# value outside its range is an overflow error (ANSI mode), never a silently
# wrong sum.
MONEY = "decimal(12,2)"
RATE = "decimal(3,2)"
UNIT_COST = "decimal(9,2)"
QUANTITY = "decimal(5,0)"
# sums of a cell
CELL_MONEY = "decimal(22,2)"
CELL_PROFIT = "decimal(28,4)"
# tasks that sum lines: for each split of the line files (Spark's splits are at
# most 128 MB), and at most
TASKS_PER_SPLIT = 16
MAX_LINE_TASKS = 10_000


# ----------------------------------------------------------------- mappings
def category_of(p_type, p_name):
    return F.concat_ws(" ", p_type, F.substring_index(p_name, " ", -1))


def status_of(priority, status):
    low = priority == F.lit("5-LOW")
    return (F.when(low & (status == "F"), "Returned")
             .when(low & (status == "P"), "Cancelled")
             .when(status == "F", "Complete")
             .when(status == "O", "Shipped")
             .when(status == "P", "Processing"))


def funnel_stage_of(event_type):
    return (F.when(event_type == "view", "product")
             .when(event_type == "click", "cart")
             .when(event_type == "error", "cancel")
             .otherwise(event_type))


def traffic_source_of(user_id):
    sources = F.array(*[F.lit(s) for s in TRAFFIC_SOURCES])
    return F.element_at(sources, (F.pmod(user_id, F.lit(len(TRAFFIC_SOURCES))) + 1).cast("int"))


# ----------------------------------------------------------------- builders
def exact(x, name: str, kind: str):
    """``x`` as a decimal or whole number; a value with more digits than the
    type holds is an error raised inside the job, never rounded."""
    made = x.cast(kind)
    lost = F.raise_error(F.concat(F.lit(f"{name} does not fit {kind}: "), x.cast("string")))
    return F.when(made.cast("double") != x.cast("double"), lost).otherwise(made)


def product_lines(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("product_id"),
        category_of(F.col("p_type"), F.col("p_name")).alias("category"),
        exact(F.col("p_retailprice"), "p_retailprice", UNIT_COST).alias("unit_cost"))


def order_lines(orders: DataFrame) -> DataFrame:
    return orders.select(
        "o_orderkey",
        day_ts(F.col("o_orderdate")).alias("tanggal"),
        status_of(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("status"))


SALES_GRAIN = ["tanggal", "category", "status", "product_id"]


def lines_by_order(lineitem: DataFrame, days: DataFrame, how: str, *more: str) -> DataFrame:
    """Lines as narrow rows with the day and status of their orders, and ``more``
    columns of ``days`` (as of ``order_lines``).

    An equi-join left to Catalyst/AQE.  A quantity that is not whole, or money
    with more digits than its type, is an error.
    """
    qty = exact(F.col("l_quantity"), "l_quantity", "bigint")
    price = exact(F.col("l_extendedprice"), "l_extendedprice", MONEY)
    disc = exact(F.col("l_discount"), "l_discount", RATE)
    lines = lineitem.select("l_orderkey", F.col("l_partkey").alias("product_id"), qty.alias("q"),
                            price.alias("ext"), disc.alias("disc"))
    return (lines.join(days, F.col("l_orderkey") == F.col("o_orderkey"), how)
            .select("tanggal", "status", "product_id", "q", "ext", "disc", *more))


def with_revenue(lines: DataFrame) -> DataFrame:
    """Lines of ``lines_by_order`` with ``rev``, their ``ext * (1 - disc)``."""
    return lines.withColumn("rev", F.col("ext") * (F.lit(1) - F.col("disc"))).drop("disc")


def sales_lines(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """The lines behind B1.  No line is dropped: one without its order has a
    NULL day and status."""
    return with_revenue(lines_by_order(lineitem, order_lines(orders), "left"))


def line_tasks(*lineitem: DataFrame) -> int:
    """Tasks that sum lines: a few for each split of the files, as the cells
    of one task have to fit its memory (nearly every line is a cell of its own,
    and left to coalesce, a task gets millions of them and spills)."""
    return max(1, min(TASKS_PER_SPLIT * sum(t.rdd.getNumPartitions() for t in lineitem), MAX_LINE_TASKS))


def product_kinds(part: DataFrame) -> DataFrame:
    """Parts of one key and category as one row: their number, those with a
    cost, and the sum of these costs."""
    return (product_lines(part).groupBy(F.col("product_id").alias("p_key"), "category")
            .agg(F.count(F.lit(1)).alias("parts"), F.count("unit_cost").alias("priced"), F.sum("unit_cost").cast("decimal(19,2)").alias("cost")))


def sales_cells(lines: DataFrame, part: DataFrame, tasks: int) -> DataFrame:
    """Cells of B1, see ``kind_cells``."""
    return kind_cells(lines, product_kinds(part), tasks)


def kind_cells(lines: DataFrame, kinds: DataFrame, tasks: int) -> DataFrame:
    """Cells of B1 with ``lines`` and ``with_profit``, the lines behind them and
    those with a profit; ``lines`` as of ``sales_lines``, their ``sign`` (if any)
    is 1 or -1.

    Lines are summed before they meet their part, as a narrow row of its own
    keys: a cell's profit is the sum of ``rev`` less its quantity times the unit
    cost.  Parts of one key and category are summed too (``kinds``, of
    ``product_kinds``), so a key that comes more than once multiplies lines as a
    join of lines would.  A line without its part has a NULL category and no
    profit.
    """
    signed = "sign" in lines.columns
    sign = F.col("sign") if signed else F.lit(1)
    turned = lambda c: F.when(sign < 0, -F.col(c)).otherwise(F.col(c)) if signed else F.col(c)
    lines = lines.withColumn("paid", F.col("q").cast(QUANTITY))
    both = F.col("q").isNotNull() & F.col("rev").isNotNull()
    keys = ["tanggal", "status", "product_id"]
    cells = (lines.repartition(tasks, *keys).groupBy(*keys)
             .agg(F.sum(turned("q")).alias("q"), F.sum(turned("ext")).alias("ext"), F.sum(F.when(both, turned("rev"))).alias("rev"),
                  F.sum(F.when(both, turned("paid"))).alias("paid"), F.count(F.when(both, 1)).alias("met"),
                  F.sum(sign).alias("n"), F.sum(F.when(both, sign).otherwise(0)).alias("n_paid")))
    times = F.coalesce(F.col("parts"), F.lit(1))
    count = lambda x: x.cast("decimal(10,0)")
    profit = F.when((F.col("met") > 0) & (F.col("priced") > 0),
                    (F.col("rev").cast("decimal(27,4)") * count(F.col("priced")) - F.col("paid").cast("decimal(15,0)") * F.col("cost")).cast(CELL_PROFIT))
    return (cells.join(kinds, F.col("product_id") == F.col("p_key"), "left")
            .select(*SALES_GRAIN, (F.col("q") * times).alias("items"),
                    (F.col("ext").cast("decimal(27,2)") * count(times)).cast(CELL_MONEY).alias("gross_sales"), profit.alias("profit"),
                    (F.col("n") * times).alias("lines"), (F.col("n_paid") * F.coalesce("priced", F.lit(0))).alias("with_profit")))


def build_fact_sales(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """B1: tanggal x category x status x product_id -> items, gross_sales,
    profit (see ``sales_cells``)."""
    cells = sales_cells(sales_lines(lineitem, orders), part, line_tasks(lineitem))
    return cells.select(*SALES_GRAIN, "items", "gross_sales", "profit")


def build_sales_rollup(fact_sales: DataFrame) -> DataFrame:
    """tanggal x category x status -> items, gross_sales, profit.

    What the KPI sums, trends, category sums and the forecast read: at most
    days x categories x statuses rows (about 577,000 for the seven years and
    48 categories of the test data), whatever the number of lines.  Distinct
    products do not add up; ``build_product_bits`` keeps them.
    """
    return (fact_sales.groupBy("tanggal", "category", "status")
            .agg(F.sum("items").alias("items"), F.sum("gross_sales").alias("gross_sales"),
                 F.sum("profit").cast("decimal(38,4)").alias("profit")))


def build_product_bits(fact_sales: DataFrame) -> DataFrame:
    """month x category x status x bucket -> ``products``, the set of product
    ids as a bitmap of 32,768 bits (4 KB, run-length compressed in the file).

    Bitmaps merge exactly: the union over any months, categories and statuses
    is a bitwise or, its size a bit count, so distinct products never need the
    product grain.  Rows grow with months and the range of the ids (one bucket
    per 32,768 ids), not with lines; a NULL id is in no set, as for a distinct
    count.
    """
    at = F.col("product_id")
    return (fact_sales.where(at.isNotNull())
            .groupBy(F.trunc(F.col("tanggal").cast("date"), "month").alias("month"), "category", "status",
                     F.bitmap_bucket_number(at).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("products")))


def build_fact_orders(orders: DataFrame) -> DataFrame:
    """B2: tanggal x status -> number of orders."""
    return (order_lines(orders)
            .groupBy("tanggal", "status")
            .agg(F.count(F.lit(1)).alias("orders")))


def build_fact_events(events: DataFrame) -> DataFrame:
    """Tanggal x event_type x traffic_source -> sessions (distinct user-days)."""
    return (events
            .select(day_ts(F.col("ts")).alias("tanggal"),
                    funnel_stage_of(F.col("event_type")).alias("event_type"),
                    traffic_source_of(F.col("user_id")).alias("traffic_source"),
                    "user_id")
            .groupBy("tanggal", "event_type", "traffic_source")
            .agg(F.count_distinct("user_id").alias("sessions")))


def build_dim_products(part: DataFrame) -> DataFrame:
    """One row per product."""
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brand"),
        category_of(F.col("p_type"), F.col("p_name")).alias("category"))


def build_category_pairs(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """kat1 < kat2 -> number of orders holding both categories.

    Distinct (order, category) rows (a hash aggregate, combined before its
    shuffle) meet themselves by an equi-join on the order with ``kat1 < kat2``,
    over one reused exchange that adaptive execution can split where an order
    is hot; the pair counts are combined before a shuffle of pair keys.  Lines
    without an order key or category (an unknown part) make no pair.
    """
    cats = (lineitem.select("l_orderkey", "l_partkey")
            .join(product_lines(part).select("product_id", "category"),
                  F.col("l_partkey") == F.col("product_id"))
            .where(F.col("category").isNotNull() & F.col("l_orderkey").isNotNull())
            .select("l_orderkey", "category").distinct())
    left = cats.withColumnRenamed("category", "kat1")
    right = cats.withColumnRenamed("category", "kat2")
    return (left.join(right, "l_orderkey")
            .where(F.col("kat1") < F.col("kat2"))
            .groupBy("kat1", "kat2")
            .agg(F.count(F.lit(1)).alias("n")))


def build_marts(spark: SparkSession, src_root: str) -> dict[str, DataFrame]:
    """Lazy B1-B4 from the source tables under ``src_root``."""
    part = read_table(spark, src_root, "part")
    orders = read_table(spark, src_root, "orders")
    lineitem = read_table(spark, src_root, "lineitem")
    events = read_table(spark, src_root, "events")
    return {
        "fact_sales": build_fact_sales(lineitem, orders, part),
        "fact_orders": build_fact_orders(orders),
        "fact_events": build_fact_events(events),
        "dim_products": build_dim_products(part),
        ROLLUP_TABLE: build_sales_rollup(build_fact_sales(lineitem, orders, part)),
        PRODUCT_BITS_TABLE: build_product_bits(build_fact_sales(lineitem, orders, part)),
    }


def build_graph(spark: SparkSession, src_root: str) -> DataFrame:
    return build_category_pairs(read_table(spark, src_root, "lineitem"),
                                read_table(spark, src_root, "part"))


# ------------------------------------------------------------ materializing
class MartMissing(RuntimeError):
    """A result table is absent; the message names its path and its job."""

    def __init__(self, path: str, job: str, cause: Exception | None = None):
        super().__init__(f"result table missing at {path}; run {job} first"
                         + (f" ({cause})" if cause else ""))
        self.path = path
        self.job = job


REQUIRED_COLUMNS = {
    "fact_sales": ["tanggal", "category", "status", "product_id", "items",
                   "gross_sales", "profit"],
    ROLLUP_TABLE: ["tanggal", "category", "status", "items", "gross_sales", "profit"],
    PRODUCT_BITS_TABLE: ["month", "category", "status", "bucket", "products"],
    "fact_orders": ["tanggal", "status", "orders"],
    "fact_events": ["tanggal", "event_type", "traffic_source", "sessions"],
    "dim_products": ["product_id", "product_name", "brand"],
    GRAPH_TABLE: ["kat1", "kat2", "n"],
    "skor": ["model", "reg_param", "r2", "rmse", "mse", "mape", "terbaik"],
    "prediksi": ["week", "aktual", "prediksi"],
    "dampak": ["fitur", "dampak"],
    "meta": ["n_latih", "n_uji", "batas"],
}


def mart_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


# Sort order inside each written file: the dashboard filters facts by date
# range (and category), so date-clustered row groups let the pushed-down
# filters skip row groups.  A per-task sort; no extra shuffle.
WRITE_ORDER = {"fact_sales": ["tanggal", "category"], ROLLUP_TABLE: ["tanggal", "category"], "fact_orders": ["tanggal"],
               "fact_events": ["tanggal"], PRODUCT_BITS_TABLE: ["month", "category"]}
# Facts large enough to be written in month directories, so a date-range
# filter prunes whole directories (``PartitionFilters``) before any file is
# opened.  The small facts (days x a few keys) stay one data set.
#
# Before such a write the rows are rebalanced by month (Spark's REBALANCE
# hint): AQE cuts the shuffle output into partitions of about
# ``spark.sql.adaptive.advisoryPartitionSizeInBytes``, splitting a month that
# holds a third of all rows over many tasks and merging small months, so each
# month becomes a few right-sized files instead of one file per write task.
# The extra shuffle moves the narrow mart rows, not the source lines.
MONTH_PARTITIONED = {"fact_sales"}
PARTITION_COLUMN = "month"


MANIFESTS = "_manifests"
MANIFEST_SCHEMA = "version string, published timestamp, src_root string, tables array<string>, source_mark string"
Derived = Callable[[dict[str, DataFrame]], DataFrame]


SOURCE_TABLES = ["orders", "lineitem", "part", "events"]


def source_files(spark: SparkSession, src_root: str, tables: Iterable[str] = tuple(SOURCE_TABLES)) -> DataFrame:
    """``(table, path, length, modified)`` of the source's files, from a listing;
    no file is opened."""
    found = None
    for t in tables:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
                 .load(f"{src_root.rstrip('/')}/{t}.parquet")
                 .select(F.lit(t).alias("table"), "path", "length", F.col("modificationTime").alias("modified")))
        found = files if found is None else found.unionByName(files)
    return found


def source_mark(files: DataFrame) -> str:
    """The content of a source as one text: number of files, bytes and two
    sums of hashes over path, size and modification time."""
    sums = [F.sum(F.xxhash64(F.lit(k), "table", "path", "length", F.unix_micros("modified")).cast("decimal(38,0)")) for k in (1, 2)]
    return ":".join(str(x or 0) for x in files.agg(F.count("*"), F.sum("length"), *sums).first())


def write_tables(spark: SparkSession, frames: dict[str, DataFrame | Derived], root: str, src_root: str = "",
                 parallel: int = 4, mark: str | None = None) -> str:
    """Write the tables into a folder of a new version and publish it.

    The writes are independent jobs, so they are submitted together from a few
    driver threads; a table given as a function is derived from the written
    ones afterwards.  The last step writes one small manifest; readers go by
    the newest manifest, so they never see a half-written version, and a
    refresh that dies leaves the older version in force.
    """
    from concurrent.futures import ThreadPoolExecutor

    version = uuid.uuid4().hex[:12]
    folder = mart_path(root, f"v-{version}")

    def write(item):
        name, df = item
        writer_cols = []
        if name in MONTH_PARTITIONED and "tanggal" in df.columns:
            df = (df.withColumn(PARTITION_COLUMN, F.trunc(F.col("tanggal").cast("date"), "month"))
                  .hint("rebalance", PARTITION_COLUMN))
            writer_cols = [PARTITION_COLUMN]
        if name in WRITE_ORDER and set(WRITE_ORDER[name]) <= set(df.columns):
            df = df.sortWithinPartitions(*writer_cols, *WRITE_ORDER[name])
        df.write.partitionBy(*writer_cols).parquet(mart_path(folder, name))

    direct = {n: df for n, df in frames.items() if isinstance(df, DataFrame)}
    with ThreadPoolExecutor(max_workers=max(1, min(parallel, len(direct)))) as pool:
        list(pool.map(write, direct.items()))
    written = {n: spark.read.parquet(mart_path(folder, n)) for n in direct}
    for name, derive in frames.items():
        if name not in direct:
            write((name, derive(written)))
    tables = ", ".join(f"'{n}'" for n in frames)
    manifest = spark.sql(f"SELECT '{version}' AS version, current_timestamp() AS published, array({tables}) AS tables")
    manifest = manifest.withColumn("src_root", F.lit(src_root)).withColumn("source_mark", F.lit(mark))
    manifest.coalesce(1).write.mode("append").json(mart_path(root, MANIFESTS))
    return version


def published(spark: SparkSession, root: str) -> list[dict]:
    """The manifests of ``root``, newest first; none if nothing is published.
    Only a missing path means that; any other error is raised."""
    try:
        rows = spark.read.schema(MANIFEST_SCHEMA).json(mart_path(root, MANIFESTS)).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return [r.asDict() for r in sorted(rows, key=lambda r: (r["published"], r["version"]), reverse=True)]


def read_tables(spark: SparkSession, root: str, names: Iterable[str],
                required: dict[str, list[str]] | None = None, src_root: str | None = None,
                mark: str | None = None) -> dict[str, DataFrame] | None:
    """The newest published tables, or ``None`` if one is absent,
    stale, or built from another source (``src_root``) or from other files of
    it (``mark``, see ``source_mark``).

    A table is stale when it lacks a required column (the dashboard's check is
    that the three facts carry ``tanggal``; ours lists every column read).
    """
    names = list(names)
    for m in published(spark, root):
        if set(names) <= set(m["tables"]) and src_root in (None, m["src_root"]) and mark in (None, m["source_mark"]):
            break
    else:
        return None
    out = {n: spark.read.parquet(mart_path(mart_path(root, f"v-{m['version']}"), n)) for n in names}
    if any(not set((required or {}).get(n, [])) <= set(df.columns) for n, df in out.items()):
        return None
    return out


def load_or_build(spark: SparkSession, root: str, names: list[str],
                  build: Callable[[], dict[str, DataFrame | Derived]],
                  required: dict[str, list[str]] | None = None,
                  refresh: bool = False, src_root: str = "", mark: str | None = None) -> dict[str, DataFrame]:
    """Reuse the published tables when complete and of this source (with
    ``mark``, of its very files), else build, write, publish and read back.

    Reading the written copy cuts the lineage: later jobs start from the
    parquet files, not from the source joins.
    """
    if not refresh:
        found = read_tables(spark, root, names, required, src_root, mark)
        if found is not None:
            return found
    write_tables(spark, build(), root, src_root, mark=mark)
    found = read_tables(spark, root, names, required, src_root)
    if found is None:  # pragma: no cover - a write that did not land
        raise MartMissing(root, "the mart build")
    return found


def load_mart(spark: SparkSession, mart_root: str, src_root: str,
              refresh: bool = False, with_graph: bool = False) -> dict[str, DataFrame]:
    """S1/S4/S5/S7 for the dashboard tables and the rollup (and, with
    ``with_graph``, the category-pair table), published as one version."""
    names = MART_TABLES + ([GRAPH_TABLE] if with_graph else [])
    required = {n: REQUIRED_COLUMNS[n] for n in names}
    for n in FACTS_WITH_DATE:
        assert "tanggal" in required[n]

    def build():
        frames: dict[str, DataFrame | Derived] = dict(build_marts(spark, src_root))
        frames[ROLLUP_TABLE] = lambda written: build_sales_rollup(written["fact_sales"])
        frames[PRODUCT_BITS_TABLE] = lambda written: build_product_bits(written["fact_sales"])
        if with_graph:
            frames[GRAPH_TABLE] = build_graph(spark, src_root)
        return frames

    # Files that came, went or changed since make the published copy another's
    mark = source_mark(source_files(spark, src_root))
    return load_or_build(spark, mart_root, names, build, required, refresh, src_root, mark)


def load_table(spark: SparkSession, mart_root: str, src_root: str, name: str) -> DataFrame:
    """One table on demand, published by itself under ``mart_root/name`` and
    reused from there; the rollup and the product sets are built from the
    published fact."""
    def build():
        if name == GRAPH_TABLE:
            return {name: build_graph(spark, src_root)}
        if name in (ROLLUP_TABLE, PRODUCT_BITS_TABLE):
            derive = build_sales_rollup if name == ROLLUP_TABLE else build_product_bits
            return {name: derive(load_table(spark, mart_root, src_root, "fact_sales"))}
        return {name: build_marts(spark, src_root)[name]}

    return load_or_build(spark, mart_path(mart_root, name), [name], build, {name: REQUIRED_COLUMNS[name]}, src_root=src_root)[name]


def load_graph(spark: SparkSession, mart_root: str, src_root: str | None = None,
               refresh: bool = False) -> DataFrame:
    """S2/S6/S8 for the category-pair table; without a source, a missing
    table is an error naming its path and job."""
    names = [GRAPH_TABLE]
    required = {GRAPH_TABLE: REQUIRED_COLUMNS[GRAPH_TABLE]}
    if src_root is None:
        found = read_tables(spark, mart_root, names, required)
        if found is None:
            raise MartMissing(mart_path(mart_root, GRAPH_TABLE), "build_category_pairs")
        return found[GRAPH_TABLE]
    return load_or_build(spark, mart_root, names,
                         lambda: {GRAPH_TABLE: build_graph(spark, src_root)},
                         required, refresh, src_root)[GRAPH_TABLE]


def load_forecast(spark: SparkSession, mart_root: str,
                  build: Callable[[], dict[str, DataFrame]] | None = None,
                  refresh: bool = False, src_root: str = "") -> dict[str, DataFrame]:
    """S3/S6/S8 for the forecast results (skor, prediksi, dampak, meta)."""
    required = {n: REQUIRED_COLUMNS[n] for n in FORECAST_TABLES}
    if build is None:
        found = read_tables(spark, mart_root, FORECAST_TABLES, required)
        if found is None:
            raise MartMissing(mart_root, "build_forecast")
        return found
    return load_or_build(spark, mart_root, FORECAST_TABLES, build, required, refresh, src_root)


def mart_inventory(frames: dict[str, DataFrame]) -> DataFrame:
    """One row per table: name and row count, counted in one union job."""
    parts = [df.select(F.lit(name).alias("table_name")) for name, df in frames.items()]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    return stacked.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_rows"))
