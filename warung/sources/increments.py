"""The sales marts kept up by increments.

New order and line files give a delta that is merged into the published facts:
sums and line counts add up, product sets are or-ed, and only the months that
the delta touches are written again.  A published state is a stack of layers;
each layer is a version folder and the months it holds, the lowest holds all
others, and a month is read from the topmost layer that has it.  A reader takes
one manifest, so it never sees half an increment, and older states stay whole.

An order may arrive after its lines: those lines stand in the month ``none``
until then, and move to the order's month by the delta.  Files that went or
changed, and new products (they may change old lines), lead to a full build;
nothing is guessed.

Lines meet their orders once and are written with their day; then they are
summed, merged and written a group of months at a time, and the shuffles of each
job go at its end.  So what lies on disk at once is the shuffle of the lines by
order, or those of one group, not all shuffles of a publish.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warung.fixed_values import PRODUCT_BITS_TABLE, ROLLUP_TABLE
from warung.session import materialized, remove_path, scratch_path, shuffles_go
from warung.sources import marts as M
from warung.sources.tables import read_table

TABLES = ["fact_sales", "fact_orders", ROLLUP_TABLE, PRODUCT_BITS_TABLE]
SOURCES = ["orders", "lineitem", "part"]
MANIFESTS = "_increments"
MANIFEST_SCHEMA = "version string, published timestamp, src_root string, mark string, layers string"
KEY = "bulan"                                    # month as text, ``none`` without a day
MEASURES = ["items", "gross_sales", "profit"]
NO_MONTH = "none"
# months are summed and written in groups of about this share of the rows, and
# of at least so many
GROUP_SHARE = 1 / 6
GROUP_ROWS = 12_000_000


def _month(c: str = "tanggal"):
    return F.coalesce(F.date_format(F.col(c).cast("date"), "yyyy-MM"), F.lit(NO_MONTH)).alias(KEY)


# -------------------------------------------------------------------- layers
def states(spark: SparkSession, root: str) -> list[dict]:
    """Published states, newest first; none if nothing is published."""
    try:
        rows = spark.read.schema(MANIFEST_SCHEMA).json(M.mart_path(root, MANIFESTS)).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    found = sorted(rows, key=lambda r: (r["published"], r["version"]), reverse=True)
    return [r.asDict() | {"layers": json.loads(r["layers"])} for r in found]


def _read(spark: SparkSession, root: str, state: dict, table: str) -> DataFrame:
    """One table of a state: each layer without the months above it.  Of the
    sales fact a month is a directory, so what is hidden is never opened."""
    out, above = None, []
    for layer in state["layers"]:
        rows = spark.read.option("basePath", path := M.mart_path(M.mart_path(root, f"v-{layer['version']}"), table)).schema(_schema(spark, root, state, table)).parquet(path)
        if above:
            rows = rows.where(~F.col(KEY).isin(above))
        above = above + layer["months"]
        out = rows if out is None else out.unionByName(rows)
    return out


def _schema(spark: SparkSession, root: str, state: dict, table: str):
    lowest = M.mart_path(M.mart_path(root, f"v-{state['layers'][-1]['version']}"), table)
    schema = spark.read.parquet(lowest).schema
    schema[KEY].dataType = schema["status"].dataType       # never guessed from the directory names
    return schema


def read_sales(spark: SparkSession, root: str, *, lines: bool = False) -> dict[str, DataFrame]:
    """The newest published sales marts; ``MartMissing`` without any.  With
    ``lines`` the facts keep their line counts and month keys."""
    known = states(spark, root)
    if not known:
        raise M.MartMissing(M.mart_path(root, MANIFESTS), "publish_sales")
    out = {t: _read(spark, root, known[0], t) for t in TABLES}
    return out if lines else {t: df.drop("lines", KEY) for t, df in out.items()}


# ------------------------------------------------------------------ the delta
def _kinds(cells: DataFrame) -> DataFrame:
    """Cells in the types of the published fact, which take any number of merges."""
    kinds = {"items": "bigint", "gross_sales": "decimal(38,2)", "profit": "decimal(38,4)", "lines": "bigint", "with_profit": "bigint"}
    return cells.select(*M.SALES_GRAIN, *[F.col(c).cast(k).alias(c) for c, k in kinds.items()])


def _summed(cells: DataFrame, tasks: int) -> DataFrame:
    """Cells merged by ``tasks`` tasks (few cells meet another, so they are
    summed after their shuffle); one that has lost all its lines is gone."""
    sums = cells.repartition(tasks, *M.SALES_GRAIN).groupBy(*M.SALES_GRAIN).agg(*[F.sum(c).alias(c) for c in (*MEASURES, "lines", "with_profit")])
    out = _kinds(sums).where("lines > 0")
    return out.withColumn("profit", F.when(F.col("with_profit") > 0, F.col("profit")))


def _groups(rows: DataFrame, months: list[str] | None = None) -> list[tuple[list[str], float]]:
    """The months of ``rows`` (or ``months``), in groups of neighbours, each with
    its share of the rows; a group that has more than its size is one month.
    The driver gets a row per month."""
    counts = {r[0]: r[1] for r in rows.groupBy(KEY).count().collect()}
    counts = {m: counts.get(m, 0) for m in sorted(months if months is not None else counts)}
    total = sum(counts.values())
    size, groups, held = max(GROUP_ROWS, GROUP_SHARE * total), [[]], 0
    for m, n in counts.items():
        if groups[-1] and held + n > size:
            groups.append([])
            held = 0
        groups[-1].append(m)
        held += n
    return [(g, sum(counts[m] for m in g) / max(total, 1)) for g in groups]


def _share(tasks: int, share: float) -> int:
    return max(1, round(tasks * share))


def _dated(spark: SparkSession, lines: DataFrame, part: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """Lines written with their month, the kinds of their parts, and where both
    lie until the groups are written."""
    path = scratch_path(spark, "sales-lines")

    def put(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(M.mart_path(path, name))
        return spark.read.schema(df.schema).parquet(M.mart_path(path, name))

    return put(lines.withColumn(KEY, _month()), "lines"), put(M.product_kinds(part), "kinds"), path


def _of(rows: DataFrame, months: list[str]) -> DataFrame:
    return rows.where(F.col(KEY).isin(months)).drop(KEY)


def _order_cells(orders: DataFrame) -> DataFrame:
    return M.build_fact_orders(orders)


def _files(spark: SparkSession, src_root: str, table: str, paths: list[str]) -> DataFrame:
    whole = read_table(spark, src_root, table)
    return spark.read.schema(whole.schema).parquet(*paths) if paths else whole.limit(0)


def _write(spark: SparkSession, root: str, version: str, groups: list[tuple[list[str], float]],
           sales: Callable[[list[str], float], DataFrame], orders: DataFrame) -> None:
    """The tables of a version; ``sales`` gives the cells of a group of months."""
    folder = M.mart_path(root, f"v-{version}")

    def put(df: DataFrame, name: str) -> DataFrame:
        own = [KEY] if name in M.MONTH_PARTITIONED else []             # the others are small: months lie side by side in a file
        rows = df.hint("rebalance", *own).sortWithinPartitions(KEY, *M.WRITE_ORDER[name])
        rows.write.mode("append").partitionBy(*own).parquet(M.mart_path(folder, name))
        return spark.read.schema(df.schema).parquet(M.mart_path(folder, name))

    # independent jobs, submitted together (as in ``marts.write_tables``); what
    # is derived from the written fact follows it
    with ThreadPoolExecutor(max_workers=2) as pool:
        counts = pool.submit(put, orders.withColumn(KEY, _month()), "fact_orders")
        for months, share in groups:                               # one after the other, so that only one's shuffles lie on disk
            fact = put(sales(months, share).withColumn(KEY, _month()), "fact_sales")
        bits = pool.submit(put, M.build_product_bits(fact).withColumn(KEY, _month("month")), PRODUCT_BITS_TABLE)
        put(M.build_sales_rollup(fact).withColumn(KEY, _month()), ROLLUP_TABLE)
        counts.result(), bits.result()


def publish_sales(spark: SparkSession, root: str, src_root: str) -> dict:
    """Bring the published sales marts up to the files now under ``src_root``.

    Returns what was done: ``{"done": "reused" | "increment" | "full", "months":
    [...], "version": ...}``; an unchanged source is told from the listing alone.
    """
    with shuffles_go(spark):
        return _publish(spark, root, src_root)


def _publish(spark: SparkSession, root: str, src_root: str) -> dict:
    files = M.source_files(spark, src_root, SOURCES)
    mark, known = M.source_mark(files), states(spark, root)
    if known and known[0]["src_root"] == src_root and known[0]["mark"] == mark:
        return {"done": "reused", "months": [], "version": known[0]["version"]}
    version = uuid.uuid4().hex[:12]
    folder = M.mart_path(root, f"v-{version}")
    files.write.parquet(M.mart_path(folder, "_files"))
    files = spark.read.parquet(M.mart_path(folder, "_files"))

    layers, done, months = [], "full", []
    if known and known[0]["src_root"] == src_root:
        before = spark.read.parquet(M.mart_path(M.mart_path(root, f"v-{known[0]['version']}"), "_files"))
        gone = before.exceptAll(files)
        new = files.exceptAll(before)
        if gone.isEmpty() and new.where("table = 'part'").isEmpty():
            # one path per new file, as Spark's own file listing holds on the driver
            fresh = {t: [r["path"] for r in new.where(F.col("table") == t).select("path").collect()] for t in SOURCES}
            old = {t: [r["path"] for r in before.where(F.col("table") == t).select("path").collect()] for t in ("lineitem", "orders")} if fresh["orders"] else {}
            months = _increment(spark, root, src_root, known[0], version, fresh, old)
            done, layers = "increment", known[0]["layers"]
    if done == "full":
        _full(spark, root, src_root, version)
    if done == "full" or months:
        layers = [{"version": version, "months": months}, *layers]
    row = spark.sql("SELECT current_timestamp() AS published").select(
        F.lit(version).alias("version"), "published", F.lit(src_root).alias("src_root"), F.lit(mark).alias("mark"), F.lit(json.dumps(layers)).alias("layers"))
    row.coalesce(1).write.mode("append").json(M.mart_path(root, MANIFESTS))
    return {"done": done, "months": months, "version": version}


def _full(spark: SparkSession, root: str, src_root: str, version: str) -> None:
    """Write all months."""
    source = {t: read_table(spark, src_root, t) for t in SOURCES}
    lines, kinds, path = _dated(spark, M.lines_by_order(source["lineitem"], M.order_lines(source["orders"]), "left"), source["part"])
    tasks = M.line_tasks(source["lineitem"])

    def cells(months: list[str], share: float) -> DataFrame:
        return _kinds(M.kind_cells(M.with_revenue(_of(lines, months)), kinds, _share(tasks, share)))

    _write(spark, root, version, _groups(lines), cells, _order_cells(source["orders"]))
    remove_path(spark, path)


def _increment(spark: SparkSession, root: str, src_root: str, state: dict, version: str, fresh: dict[str, list[str]],
               old: dict[str, list[str]]) -> list[str]:
    """Write the months that new files touch, as they are with them."""
    part, orders = read_table(spark, src_root, "part"), read_table(spark, src_root, "orders")
    new_lines, new_orders = _files(spark, src_root, "lineitem", fresh["lineitem"]), _files(spark, src_root, "orders", fresh["orders"])
    held = {t: _read(spark, root, state, t) for t in ("fact_sales", "fact_orders")}
    lines = M.lines_by_order(new_lines, M.order_lines(orders), "left").withColumn("sign", F.lit(1))
    tables, waiting = [new_lines], held["fact_sales"].where(F.col(KEY) == NO_MONTH)
    if fresh["orders"] and not waiting.isEmpty():
        # old lines whose order has come now get its day, and leave the cells
        # without a day if none of its key had come before
        old_lines, known = _files(spark, src_root, "lineitem", old["lineitem"]), _files(spark, src_root, "orders", old["orders"])
        days = M.order_lines(new_orders).withColumn("sign", F.lit(1))
        first = new_orders.select("o_orderkey").distinct().join(known.select("o_orderkey"), "o_orderkey", "left_anti")
        left = first.select("o_orderkey", *[F.lit(None).cast(days.schema[c].dataType).alias(c) for c in ("tanggal", "status")], F.lit(-1).alias("sign"))
        tables.append(old_lines)
        lines = lines.unionByName(M.lines_by_order(old_lines, days.unionByName(left), "inner", "sign"))
    lines, kinds, path = _dated(spark, lines, part)
    order_delta = materialized(_order_cells(new_orders), "orders-delta")
    touched = lines.select(KEY).union(order_delta.select(_month())).distinct()
    months = sorted(r[0] for r in touched.collect())                   # a row per month
    hit = F.col(KEY).isin(months)
    tasks, all_tasks = M.line_tasks(*tables), M.line_tasks(read_table(spark, src_root, "lineitem"))

    def cells(some: list[str], share: float) -> DataFrame:
        delta = M.kind_cells(M.with_revenue(_of(lines, some)), kinds, _share(tasks, share))
        return _summed(_of(held["fact_sales"], some).unionByName(delta), _share(all_tasks, share))

    if months:
        counts = held["fact_orders"].where(hit).drop(KEY).unionByName(order_delta)
        counts = counts.groupBy("tanggal", "status").agg(F.sum("orders").alias("orders"))
        _write(spark, root, version, _groups(held["fact_sales"].where(hit).select(KEY).unionByName(lines.select(KEY)), months), cells, counts)
    remove_path(spark, path)
    return months
