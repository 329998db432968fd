"""Registered queries: one entry per operator key, each with its DuckDB
cross-check SQL beside it.

Every query reads the source tables under ``root`` (the marts are derived
lazily from them), so its work grows with the data.  Dashboard parameters
are the defaults of the page (whole date range, no list filter) unless the
key says ``_filtered``, which applies one fixed sidebar selection.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warung.fixed_values import (CO_PURCHASE_SUFFIX, FUNNEL_ROWS, FUNNEL_STAGES, KPI_CARDS, ORDER_SUFFIX, STAGE_NAMES,
                                  STATUS_ORDER, TILE_SIZE, TOP_N, TOP_PAIRS)
from warung.operators import filters, graph, products, sales, visitors
from warung.plans.oracle_sql import with_marts
from warung.sources import marts as M


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str = ""


REGISTRY: dict[str, Query] = {}


def register(key: str, sql: str | None, doc: str = ""):
    def deco(fn):
        REGISTRY[key] = Query(fn, sql, doc or (fn.__doc__ or "").strip())
        return fn
    return deco


# ----------------------------------------------------------- shared views
# One fixed sidebar selection for the ``_filtered`` keys.
VIEW_START = dt.datetime(1996, 1, 1)
VIEW_END = dt.datetime(1999, 12, 31)
VIEW_CATEGORIES = ["ECONOMY ring", "PROMO bolt", "SMALL anvil"]
VIEW_STATUSES = ["Complete", "Cancelled", "Shipped"]


def _sql_list(vals) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in vals)


SQL_DEFAULT_RANGE = "tanggal BETWEEN (SELECT lo FROM bounds) AND (SELECT hi FROM bounds)"
SQL_VIEW_RANGE = (f"tanggal BETWEEN TIMESTAMP '{VIEW_START:%Y-%m-%d}' "
                  f"AND TIMESTAMP '{VIEW_END:%Y-%m-%d}'")
SQL_VIEW_SALES = (f"{SQL_VIEW_RANGE} AND category IN ({_sql_list(VIEW_CATEGORIES)}) "
                  f"AND status IN ({_sql_list(VIEW_STATUSES)})")
# fact_orders has no category column, so the category filter skips it.
SQL_VIEW_ORDERS = f"{SQL_VIEW_RANGE} AND status IN ({_sql_list(VIEW_STATUSES)})"


_BOUNDS_CACHE: dict[tuple[str, str], tuple] = {}


def _session_key(spark: SparkSession, root: str) -> tuple[str, str]:
    return (spark.sparkContext.applicationId, root)


def _built(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The marts as lazy builds from the source tables (for the build keys)."""
    return M.build_marts(spark, root)


def _mart_root(spark: SparkSession, root: str, what: str = "marts") -> str:
    """One place per application and source under the shared folder."""
    from warung.session import checkpoint_root
    app, tag = spark.sparkContext.applicationId, hashlib.md5(root.encode()).hexdigest()[:12]
    return f"{checkpoint_root(spark).rstrip('/')}/warung-{what}/{app}/{tag}"


class _Marts(dict):
    """The marts of a source, each built when it is first asked for, written
    under the shared folder and read back (S4/S5): page queries start from the
    written parquet, and one that reads two tables builds those two."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__()
        self.spark, self.root = spark, root

    def __missing__(self, name: str) -> DataFrame:
        self[name] = M.load_table(self.spark, _mart_root(self.spark, self.root), self.root, name)
        return self[name]

    def get(self, name, default=None):
        return self[name]


_MART_CACHE: dict[tuple[str, str], _Marts] = {}


def _marts(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    key = _session_key(spark, root)
    if key not in _MART_CACHE:
        _MART_CACHE[key] = _Marts(spark, root)
    return _MART_CACHE[key]


def _bounds(spark: SparkSession, root: str) -> tuple:
    """F6 default date range, computed once per session and source."""
    key = _session_key(spark, root)
    if key not in _BOUNDS_CACHE:
        _BOUNDS_CACHE[key] = filters.date_bounds(_marts(spark, root)[M.ROLLUP_TABLE])
    return _BOUNDS_CACHE[key]


class _View(dict):
    """The facts under one selection, each filtered when it is asked for."""

    def __init__(self, spark: SparkSession, root: str, selection: tuple):
        super().__init__()
        self.marts, self.selection, self.bounds = _marts(spark, root), selection, lambda: _bounds(spark, root)

    def __missing__(self, name: str) -> DataFrame:
        if name == "products":
            self[name] = filters.product_sets(self.marts[M.PRODUCT_BITS_TABLE], self.marts["fact_sales"], *self.selection, bounds=self.bounds())
            return self[name]
        table = {"sales": "fact_sales", "orders": "fact_orders", "rollup": M.ROLLUP_TABLE}[name]
        self[name] = filters.filter_facts(self.marts[table], *self.selection)
        return self[name]


def _view(spark: SparkSession, root: str, filtered: bool = False) -> dict[str, DataFrame]:
    if filtered:
        return _View(spark, root, (VIEW_START, VIEW_END, VIEW_CATEGORIES, VIEW_STATUSES))
    return _View(spark, root, _bounds(spark, root))


def _events(spark: SparkSession, root: str) -> DataFrame:
    """Visitor facts over their own date range (sales and events need not
    overlap in time, and the visitor page takes the date filter only)."""
    return filters.filter_facts(_marts(spark, root)["fact_events"], None, None)


def _pairs(spark: SparkSession, root: str) -> DataFrame:
    return _marts(spark, root)[M.GRAPH_TABLE]


def _sales_view_sql(filtered: bool) -> tuple[list[str], list[str]]:
    """CTE names and extra CTEs for the filtered sales ``s`` and orders ``o``."""
    if filtered:
        extra = [f"s AS (SELECT * FROM fact_sales WHERE {SQL_VIEW_SALES})",
                 f"o AS (SELECT * FROM fact_orders WHERE {SQL_VIEW_ORDERS})"]
    else:
        extra = [f"s AS (SELECT * FROM fact_sales WHERE {SQL_DEFAULT_RANGE})",
                 f"o AS (SELECT * FROM fact_orders WHERE {SQL_DEFAULT_RANGE})"]
    return ["fact_sales", "fact_orders", "bounds"], extra


def _sales_sql(body: str, filtered: bool = False, more: list[str] | None = None) -> str:
    names, extra = _sales_view_sql(filtered)
    return with_marts(names, body, extra + list(more or []))


EVENTS_SQL = ["e AS (SELECT * FROM fact_events WHERE tanggal IS NOT NULL)"]


# ------------------------------------------------------- sources and marts
@register("build_fact_sales", with_marts(["fact_sales"], """
SELECT tanggal, category, status, product_id, items,
       CAST(gross_sales AS DOUBLE) AS gross_sales, CAST(profit AS DOUBLE) AS profit
FROM fact_sales"""))
def q_build_fact_sales(spark, root):
    """B1: the sales fact from lineitem, orders and part."""
    return _built(spark, root)["fact_sales"].select(
        "tanggal", "category", "status", "product_id", "items",
        F.col("gross_sales").cast("double").alias("gross_sales"),
        F.col("profit").cast("double").alias("profit"))


@register("build_sales_increments", with_marts(["fact_sales"], """
SELECT tanggal, category, status, product_id, items,
       CAST(gross_sales AS DOUBLE) AS gross_sales, CAST(profit AS DOUBLE) AS profit
FROM fact_sales"""))
def q_build_sales_increments(spark, root):
    """The source arrives in two deliveries, some lines before
    their orders; the published fact after the second is that of one build."""
    from warung.session import scratch_path
    from warung.sources.increments import publish_sales, read_sales
    from warung.sources.tables import read_sources
    base, source = scratch_path(spark, "increments"), read_sources(spark, root, ("part", "orders", "lineitem"))
    for k in (0, 1):
        source["orders"].where(F.col("o_orderkey") % 2 == k).write.mode("append").parquet(f"{base}/source/orders.parquet")
        late = F.col("l_orderkey") % 8 == 7                              # by then their orders are known, or not yet
        source["lineitem"].where(~late if k == 0 else late).write.mode("append").parquet(f"{base}/source/lineitem.parquet")
        if k == 0:
            source["part"].write.parquet(f"{base}/source/part.parquet")
        publish_sales(spark, f"{base}/marts", f"{base}/source")
    return read_sales(spark, f"{base}/marts")["fact_sales"].select(
        "tanggal", "category", "status", "product_id", "items",
        F.col("gross_sales").cast("double").alias("gross_sales"), F.col("profit").cast("double").alias("profit"))


@register("build_fact_orders", with_marts(["fact_orders"], "SELECT * FROM fact_orders"))
def q_build_fact_orders(spark, root):
    """B2: orders per day and status."""
    return _built(spark, root)["fact_orders"]


@register("build_fact_events", with_marts(["fact_events"], "SELECT * FROM fact_events"))
def q_build_fact_events(spark, root):
    """Sessions per day, funnel stage and traffic source."""
    return _built(spark, root)["fact_events"]


@register("build_dim_products", with_marts(["dim_products"], "SELECT * FROM dim_products"))
def q_build_dim_products(spark, root):
    """The product dimension."""
    return _built(spark, root)["dim_products"]


@register("category_pairs", with_marts(["category_pairs"], "SELECT * FROM category_pairs"))
def q_category_pairs(spark, root):
    """Orders holding both categories, per category pair."""
    return M.build_graph(spark, root)


@register("load_mart", with_marts(
    ["fact_sales", "fact_orders", "fact_events", "dim_products", "category_pairs"], """
SELECT 'fact_sales' AS table_name, COUNT(*) AS n_rows FROM fact_sales
UNION ALL SELECT 'fact_orders', COUNT(*) FROM fact_orders
UNION ALL SELECT 'fact_events', COUNT(*) FROM fact_events
UNION ALL SELECT 'dim_products', COUNT(*) FROM dim_products
UNION ALL SELECT 'sales_rollup', COUNT(*) FROM (SELECT DISTINCT tanggal, category, status FROM fact_sales) r
UNION ALL SELECT 'sales_products', COUNT(*) FROM (
  SELECT DISTINCT date_trunc('month', tanggal) AS m, category, status, CASE WHEN product_id > 0 THEN 1 + (product_id - 1) // 32768 ELSE product_id // 32768 END AS b
  FROM fact_sales WHERE product_id IS NOT NULL) r
UNION ALL SELECT 'category_pairs', COUNT(*) FROM category_pairs"""))
def q_load_mart(spark, root):
    """Publish all marts of the source as one version, or reuse
    the published ones, then read them back."""
    frames = M.load_mart(spark, _mart_root(spark, root, "mart-set"), root, with_graph=True)
    return M.mart_inventory(frames)


@register("build_fact_events_stream", with_marts(["fact_events"], "SELECT * FROM fact_events"))
def q_build_fact_events_stream(spark, root):
    """B3 incrementally: event files through a stateless Structured Streaming
    job into an exactly-once parquet sink, then the mart over the sink."""
    from warung.session import scratch_path
    from warung.streaming.events import refresh_fact_events
    base = scratch_path(spark, "events-stream")
    return refresh_fact_events(spark, root, f"{base}/user_days", f"{base}/_checkpoint",
                               glob="events.parquet")

# -------------------------------------------------------------- filters
FILTERED_SALES_COLS = ("tanggal", "category", "status", "product_id", "items")


@register("filter_all", _sales_sql("""
SELECT tanggal, category, status, product_id, items,
       CAST(gross_sales AS DOUBLE) AS gross_sales, CAST(profit AS DOUBLE) AS profit
FROM s""", filtered=True))
def q_filter_all(spark, root):
    """The sales fact under one sidebar selection."""
    s = _view(spark, root, filtered=True)["sales"]
    return s.select(*FILTERED_SALES_COLS, F.col("gross_sales").cast("double").alias("gross_sales"),
                    F.col("profit").cast("double").alias("profit"))


@register("option_categories", with_marts(["fact_sales"], """
SELECT DISTINCT category FROM fact_sales WHERE category IS NOT NULL"""))
def q_option_categories(spark, root):
    """the category picker's options."""
    return filters.option_categories(_marts(spark, root)[M.ROLLUP_TABLE])


# ------------------------------------------------------------ sales page
def _kpi_sql(filtered: bool) -> str:
    return _sales_sql("""
SELECT COALESCE(CAST((SELECT SUM(gross_sales) FROM s) AS DOUBLE), 0.0) AS gross_sales,
       COALESCE(CAST((SELECT SUM(profit) FROM s) AS DOUBLE), 0.0) AS profit,
       COALESCE(CAST((SELECT SUM(orders) FROM o) AS BIGINT), 0) AS orders,
       CAST(COALESCE((SELECT SUM(CASE WHEN status = 'Cancelled' THEN orders END) FROM o), 0) AS DOUBLE)
         / CAST(GREATEST(COALESCE((SELECT SUM(orders) FROM o), 0), 1) AS DOUBLE) * 100.0 AS cancel_rate,
       (SELECT COUNT(DISTINCT product_id) FROM s) AS products_sold""", filtered)


@register("kpi_cards", _kpi_sql(False))
def q_kpi_cards(spark, root):
    """A1-A3: the KPI row over the whole range (flagship)."""
    v = _view(spark, root)
    return sales.kpi_cards(v["rollup"], v["orders"], v["products"])


@register("kpi_cards_filtered", _kpi_sql(True))
def q_kpi_cards_filtered(spark, root):
    """A1-A3 under the sidebar selection."""
    v = _view(spark, root, filtered=True)
    return sales.kpi_cards(v["rollup"], v["orders"], v["products"])


# A selection that cuts into its first and last month.
EDGE_START, EDGE_END = dt.datetime(1996, 1, 17), dt.datetime(1998, 5, 9)


@register("kpi_cards_part_months", _kpi_sql(True).replace(f"{VIEW_START:%Y-%m-%d}", f"{EDGE_START:%Y-%m-%d}").replace(f"{VIEW_END:%Y-%m-%d}", f"{EDGE_END:%Y-%m-%d}"))
def q_kpi_cards_part_months(spark, root):
    """A1-A3 where the range cuts into its first and last month: product sets
    of whole months, days of the two others."""
    v = _View(spark, root, (EDGE_START, EDGE_END, VIEW_CATEGORIES, VIEW_STATUSES))
    return sales.kpi_cards(v["rollup"], v["orders"], v["products"])


def _labels_sql() -> str:
    kpi = _kpi_sql(False).split("\nSELECT COALESCE", 1)
    cards = ", ".join(f"({i + 1}, '{c}')" for i, c in enumerate(KPI_CARDS))
    return (kpi[0] + ",\nk AS (SELECT COALESCE" + kpi[1] + """)
SELECT c.ord, c.card,
       CASE c.ord WHEN 1 THEN '$' || format('{:,.0f}', k.gross_sales)
                  WHEN 2 THEN '$' || format('{:,.0f}', k.profit)
                  WHEN 3 THEN format('{:,.0f}', CAST(k.orders AS DOUBLE))
                  WHEN 4 THEN format('{:.1f}', k.cancel_rate) || '%'
                  ELSE format('{:,.0f}', CAST(k.products_sold AS DOUBLE)) END AS text
FROM (VALUES """ + cards + """) c(ord, card), k""")


@register("report_labels", _labels_sql())
def q_report_labels(spark, root):
    """The KPI cards as display texts."""
    v = _view(spark, root)
    return sales.report_labels(sales.kpi_cards(v["rollup"], v["orders"], v["products"]))


def _status_sql(filtered: bool) -> str:
    return _sales_sql(f"""
SELECT status, orders, share,
       format('{{:,.0f}}', CAST(orders AS DOUBLE)) || '  (' || format('{{:.1f}}', share) || '%)' AS text
FROM (SELECT status, CAST(orders AS BIGINT) AS orders,
             CAST(orders AS DOUBLE) / CAST(GREATEST(COALESCE(SUM(orders) OVER (), 0), 1) AS DOUBLE) * 100.0 AS share
      FROM (SELECT status, SUM(orders) AS orders FROM o
            WHERE status IN ({_sql_list(STATUS_ORDER)}) GROUP BY status) t) u""", filtered)


@register("orders_by_status", _status_sql(False))
def q_orders_by_status(spark, root):
    """Orders per known status and share of their total."""
    return sales.orders_by_status(_view(spark, root)["orders"])


@register("orders_by_status_filtered", _status_sql(True))
def q_orders_by_status_filtered(spark, root):
    """A4 under the sidebar selection."""
    return sales.orders_by_status(_view(spark, root, filtered=True)["orders"])


def _category_sql(filtered: bool) -> str:
    return _sales_sql("""
SELECT category, CAST(SUM(items) AS BIGINT) AS unit, CAST(SUM(gross_sales) AS DOUBLE) AS gross,
       CAST(SUM(profit) AS DOUBLE) AS profit, COUNT(DISTINCT product_id) AS produk_unik
FROM s WHERE category IS NOT NULL GROUP BY category""", filtered)


@register("category_table", _category_sql(False))
def q_category_table(spark, root):
    """Per-category breakdown."""
    v = _view(spark, root)
    return sales.category_table(v["rollup"], v["products"])


@register("category_table_filtered", _category_sql(True))
def q_category_table_filtered(spark, root):
    """A7 under the sidebar selection."""
    v = _view(spark, root, filtered=True)
    return sales.category_table(v["rollup"], v["products"])


TRUNC_SQL = {"day": "CAST(CAST(tanggal AS DATE) AS TIMESTAMP)",
             "week": "CAST(date_trunc('week', CAST(tanggal AS DATE)) AS TIMESTAMP)",
             "month": "CAST(date_trunc('month', CAST(tanggal AS DATE)) AS TIMESTAMP)"}
STEP_SQL = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH"}


def _trend_ctes(grain: str) -> list[str]:
    return [f"per AS (SELECT {TRUNC_SQL[grain]} AS tanggal, SUM(gross_sales) AS g, SUM(profit) AS p "
            f"FROM s WHERE tanggal IS NOT NULL GROUP BY 1)",
            f"cal AS (SELECT CAST(unnest(generate_series((SELECT MIN(tanggal) FROM per), "
            f"(SELECT MAX(tanggal) FROM per), {STEP_SQL[grain]})) AS TIMESTAMP) AS tanggal)",
            "tr AS (SELECT cal.tanggal, COALESCE(CAST(per.g AS DOUBLE), 0.0) AS gross_sales, "
            "COALESCE(CAST(per.p AS DOUBLE), 0.0) AS profit FROM cal LEFT JOIN per ON cal.tanggal = per.tanggal)"]


def _trend_sql(grain: str, filtered: bool) -> str:
    return _sales_sql("SELECT * FROM tr", filtered, _trend_ctes(grain))


for _grain, _name in (("day", "daily"), ("week", "weekly"), ("month", "monthly")):
    for _filtered in (False, True):
        _key = f"trend_{_name}" + ("_filtered" if _filtered else "")

        def _run(spark, root, grain=_grain, filtered=_filtered):
            return sales.trend(_view(spark, root, filtered)["rollup"], grain)

        register(_key, _trend_sql(_grain, _filtered),
                 f"R1-R4: gross sales and profit per {_grain}, gaps filled with 0"
                 + (" (sidebar selection)" if _filtered else ""))(_run)


@register("trend_long", _sales_sql("""
SELECT series, tanggal, value, tanggal = MAX(tanggal) OVER () AS is_last FROM (
  SELECT 'Gross sales' AS series, tanggal, gross_sales AS value FROM tr
  UNION ALL SELECT 'Profit', tanggal, profit FROM tr) u""", False, _trend_ctes("month")))
def q_trend_long(spark, root):
    """The monthly trend (default grain) in long form, last bucket flagged."""
    return sales.trend_long(sales.trend(_view(spark, root)["rollup"], "month"))


@register("trend_end_labels", _sales_sql("""
SELECT series, tanggal, value FROM (
  SELECT 'Gross sales' AS series, tanggal, gross_sales AS value FROM tr
  UNION ALL SELECT 'Profit', tanggal, profit FROM tr) u
WHERE tanggal = (SELECT MAX(tanggal) FROM tr)""", False, _trend_ctes("month")))
def q_trend_end_labels(spark, root):
    """The value at the last monthly bucket of each series."""
    return sales.trend_end_labels(sales.trend(_view(spark, root)["rollup"], "month"))


# ---------------------------------------------------------- visitor page
def _funnel_values() -> str:
    rows = []
    for i, s in enumerate(FUNNEL_STAGES):
        row = FUNNEL_ROWS[min(i, len(FUNNEL_ROWS) - 1)]
        rows.append(f"({i + 1}, '{s}', '{STAGE_NAMES[s]}', '{row}')")
    return ", ".join(rows)


@register("funnel", with_marts(["fact_events"], f"""
SELECT ord, event_type AS stage, stage_name, funnel_row, sessions, pct,
       CASE WHEN sessions = 0 THEN ''
            WHEN ord <= 2 THEN format('{{:,.0f}}', CAST(sessions AS DOUBLE)) || '<br>' || format('{{:.1f}}', pct) || '%'
            ELSE stage_name || '<br>' || format('{{:,.0f}}', CAST(sessions AS DOUBLE)) || ' (' || format('{{:.1f}}', pct) || '%)' END AS text
FROM (
  SELECT j.*, CAST(sessions AS DOUBLE)
           / CAST(GREATEST(COALESCE(MAX(CASE WHEN ord = 1 THEN sessions END) OVER (), 0), 1) AS DOUBLE) * 100.0 AS pct
  FROM (SELECT st.ord, st.event_type, st.stage_name, st.funnel_row,
               CAST(COALESCE(per.sessions, 0) AS BIGINT) AS sessions
        FROM (VALUES {_funnel_values()}) st(ord, event_type, stage_name, funnel_row)
        LEFT JOIN (SELECT event_type, SUM(sessions) AS sessions FROM e
                   WHERE event_type IN ({_sql_list(FUNNEL_STAGES)}) GROUP BY 1) per
          ON st.event_type = per.event_type) j) k""", EVENTS_SQL))
def q_funnel(spark, root):
    """The four-stage visit funnel."""
    return visitors.funnel(_events(spark, root))


@register("sessions_by_source", with_marts(["fact_events"], """
SELECT traffic_source, CAST(SUM(sessions) AS BIGINT) AS sessions,
       format('{:,.0f}', CAST(SUM(sessions) AS DOUBLE)) || ' Sesi' AS text
FROM e WHERE event_type = 'product' AND traffic_source IS NOT NULL GROUP BY 1""", EVENTS_SQL))
def q_sessions_by_source(spark, root):
    """Product-view sessions per traffic source."""
    return visitors.sessions_by_source(_events(spark, root))


# A date window inside the events' range (events and orders do not overlap in
# time here), so F5 and F6 reach the visitor page.
EVENTS_START = dt.datetime(2024, 1, 8)
EVENTS_END = dt.datetime(2024, 1, 20)
EVENTS_VIEW_SQL = [f"e AS (SELECT * FROM fact_events WHERE tanggal BETWEEN TIMESTAMP '{EVENTS_START:%Y-%m-%d}' "
                   f"AND TIMESTAMP '{EVENTS_END:%Y-%m-%d}')"]


def _events_view(spark, root):
    """The events of that window; category and status lists do not reach them."""
    return filters.filter_facts(_marts(spark, root)["fact_events"], EVENTS_START, EVENTS_END, VIEW_CATEGORIES, VIEW_STATUSES,
                                use_category=False, use_status=False)


def _events_view_sql(key: str) -> str:
    return REGISTRY[key].sql.replace(EVENTS_SQL[0], EVENTS_VIEW_SQL[0])


@register("funnel_filtered", _events_view_sql("funnel"))
def q_funnel_filtered(spark, root):
    """The funnel of a date window; stages without sessions stay."""
    return visitors.funnel(_events_view(spark, root))


@register("sessions_by_source_filtered", _events_view_sql("sessions_by_source"))
def q_sessions_by_source_filtered(spark, root):
    """Product-view sessions per traffic source in a date window."""
    return visitors.sessions_by_source(_events_view(spark, root))


# ---------------------------------------------------------- products page
PER_PRODUCT_SQL = ("pp AS (SELECT product_id, SUM(items) AS units, SUM(profit) AS profit "
                   "FROM s WHERE product_id IS NOT NULL GROUP BY 1)")
PER_BRAND_SQL = ("pb AS (SELECT d.brand, SUM(pp.units) AS units, SUM(pp.profit) AS profit "
                 "FROM pp LEFT JOIN dim_products d ON pp.product_id = d.product_id "
                 "WHERE d.brand IS NOT NULL GROUP BY 1)")


def _label_sql(col: str, width: int = 38) -> str:
    return (f"CASE WHEN length({col}) <= {width} THEN {col} "
            f"ELSE regexp_replace(substring({col}, 1, {width}), ' [^ ]*$', '') || '…' END")


def _top_product_sql(measure: str, filtered: bool) -> str:
    vtype = "BIGINT" if measure == "units" else "DOUBLE"
    text = (f"format('{{:,.0f}}', CAST(t.value AS DOUBLE))" if measure == "units"
            else f"'$' || format('{{:,.0f}}', CAST(t.value AS DOUBLE))")
    names, extra = _sales_view_sql(filtered)
    body = f"""
SELECT t.rank, t.product_id, COALESCE(d.product_name, CAST(t.product_id AS VARCHAR)) AS label,
       {_label_sql("COALESCE(d.product_name, CAST(t.product_id AS VARCHAR))")} AS short_label,
       CAST(t.value AS {vtype}) AS value, {text} AS text
FROM (SELECT product_id, {measure} AS value,
             ROW_NUMBER() OVER (ORDER BY {measure} DESC, product_id) AS rank
      FROM pp WHERE {measure} IS NOT NULL) t
LEFT JOIN dim_products d ON t.product_id = d.product_id
WHERE t.rank <= {TOP_N}"""
    return with_marts(names + ["dim_products"], body, extra + [PER_PRODUCT_SQL])


def _top_brand_sql(measure: str, filtered: bool) -> str:
    vtype = "BIGINT" if measure == "units" else "DOUBLE"
    text = (f"format('{{:,.0f}}', CAST(value AS DOUBLE))" if measure == "units"
            else f"'$' || format('{{:,.0f}}', CAST(value AS DOUBLE))")
    names, extra = _sales_view_sql(filtered)
    body = f"""
SELECT rank, brand, {_label_sql("brand")} AS short_label, CAST(value AS {vtype}) AS value, {text} AS text
FROM (SELECT brand, {measure} AS value, ROW_NUMBER() OVER (ORDER BY {measure} DESC, brand) AS rank
      FROM pb WHERE {measure} IS NOT NULL) t
WHERE rank <= {TOP_N}"""
    return with_marts(names + ["dim_products"], body, extra + [PER_PRODUCT_SQL, PER_BRAND_SQL])


for _measure in ("units", "profit"):
    for _filtered in (False, True):
        def _run_p(spark, root, measure=_measure, filtered=_filtered):
            v = _view(spark, root, filtered)
            return products.top_products(v["sales"], _marts(spark, root)["dim_products"], measure)

        def _run_b(spark, root, measure=_measure, filtered=_filtered):
            v = _view(spark, root, filtered)
            return products.top_brands(v["sales"], _marts(spark, root)["dim_products"], measure)

        _suffix, _note = ("_filtered", " (sidebar selection)") if _filtered else ("", "")
        register(f"top_products_{_measure}{_suffix}", _top_product_sql(_measure, _filtered),
                 f"T1/J1: top {TOP_N} products by {_measure}{_note}")(_run_p)
        register(f"top_brands_{_measure}{_suffix}", _top_brand_sql(_measure, _filtered),
                 f"T2/J2/A9: top {TOP_N} brands by {_measure}{_note}")(_run_b)


def _rank_ties_sql(filtered: bool) -> str:
    names, extra = _sales_view_sql(filtered)
    parts = []
    for label, measure in (("unit terjual", "units"), ("profit", "profit")):
        parts.append(f"""
SELECT '{label}' AS peringkat,
       MAX(CASE WHEN rn = 1 THEN value END) AS top_1,
       MAX(CASE WHEN rn = {TOP_N} THEN value END) AS top_{TOP_N},
       CAST(SUM(CASE WHEN rn <= {TOP_N} AND value = nth THEN 1 ELSE 0 END) AS BIGINT) AS ties_in_top_{TOP_N},
       MAX(CASE WHEN rn = {TOP_N + 1} THEN value END) AS top_{TOP_N + 1}
FROM (SELECT value, rn, MAX(CASE WHEN rn = {TOP_N} THEN value END) OVER () AS nth
      FROM (SELECT CAST({measure} AS DOUBLE) AS value,
                   ROW_NUMBER() OVER (ORDER BY {measure} DESC, product_id) AS rn
            FROM pp WHERE {measure} IS NOT NULL) r
      WHERE rn <= {TOP_N + 1}) x
HAVING COUNT(*) > {TOP_N}""")
    return with_marts(names, "\nUNION ALL\n".join(parts), extra + [PER_PRODUCT_SQL])


@register("rank_ties", _rank_ties_sql(False))
def q_rank_ties(spark, root):
    """T4: values at #1, #10, #11 and ties with #10, for units and profit."""
    return products.rank_ties(_view(spark, root)["sales"])


@register("rank_ties_filtered", _rank_ties_sql(True))
def q_rank_ties_filtered(spark, root):
    """T4 under the sidebar selection."""
    return products.rank_ties(_view(spark, root, filtered=True)["sales"])


# ---------------------------------------------------------------- graph
VOLUME_SQL = ("vol AS (SELECT category, CAST(SUM(n) AS BIGINT) AS volume FROM ("
              "SELECT kat1 AS category, n FROM category_pairs UNION ALL "
              "SELECT kat2, n FROM category_pairs) u WHERE category IS NOT NULL GROUP BY 1)")
NODES_SQL = ("nodes AS (SELECT ROW_NUMBER() OVER (ORDER BY volume DESC, category) AS ord, "
             "category, volume FROM vol)")


@register("category_volume", with_marts(["category_pairs"], "SELECT * FROM nodes",
                                        [VOLUME_SQL, NODES_SQL]))
def q_category_volume(spark, root):
    """Weighted degree per category, in volume order."""
    return graph.category_volume(_pairs(spark, root))


@register("graph_nodes", with_marts(["category_pairs"], """
SELECT ord, category, volume,
       category || ' — ' || format('{:,.0f}', CAST(volume AS DOUBLE)) || ' co-purchase' AS text
FROM nodes""", [VOLUME_SQL, NODES_SQL]))
def q_graph_nodes(spark, root):
    """Node list of the drawn network."""
    return graph.graph_nodes(_pairs(spark, root))


@register("graph_edges", with_marts(["category_pairs"], """
SELECT kat1, kat2, CAST(n AS BIGINT) AS n,
       kat1 || ' + ' || kat2 || ': ' || format('{:,.0f}', CAST(n AS DOUBLE)) || ' order' AS text
FROM category_pairs"""))
def q_graph_edges(spark, root):
    """Edge list of the drawn network."""
    return graph.graph_edges(_pairs(spark, root))


@register("graph_density", with_marts(["category_pairs"], """
SELECT n_categories, n_pairs, possible,
       CAST(n_pairs AS DOUBLE) / CAST(NULLIF(possible, 0) AS DOUBLE) * 100.0 AS density,
       format('{:.0f}', CAST(n_pairs AS DOUBLE) / CAST(NULLIF(possible, 0) AS DOUBLE) * 100.0) || '%' AS text
FROM (SELECT v AS n_categories, e AS n_pairs, CAST(v * (v - 1) // 2 AS BIGINT) AS possible
      FROM (SELECT (SELECT COUNT(*) FROM vol) AS v, (SELECT COUNT(*) FROM category_pairs) AS e) c) d""",
    [VOLUME_SQL]))
def q_graph_density(spark, root):
    """Categories, observed and possible pairs, density."""
    return graph.graph_density(_pairs(spark, root))


@register("co_purchase_matrix", with_marts(["category_pairs"], """
SELECT a.ord AS y_ord, a.category AS y, b.ord AS x_ord, b.category AS x, CAST(p.n AS DOUBLE) AS z
FROM (SELECT kat1, kat2, n FROM category_pairs UNION ALL SELECT kat2, kat1, n FROM category_pairs) p
JOIN nodes a ON p.kat1 = a.category JOIN nodes b ON p.kat2 = b.category
WHERE p.kat1 <> p.kat2""",
    [VOLUME_SQL, NODES_SQL]))
def q_co_purchase_matrix(spark, root):
    """The symmetric co-purchase matrix, sparse long form."""
    return graph.co_purchase_matrix(_pairs(spark, root))


@register("top_pairs", with_marts(["category_pairs"], f"""
SELECT rank, kat1, kat2, CAST(n AS BIGINT) AS n, kat1 || '  +  ' || kat2 AS label,
       format('{{:,.0f}}', CAST(n AS DOUBLE)) AS text
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY n DESC, kat1, kat2) AS rank
      FROM category_pairs WHERE n IS NOT NULL) t
WHERE rank <= {TOP_PAIRS}"""))
def q_top_pairs(spark, root):
    """The most frequent category pairs."""
    return graph.top_pairs(_pairs(spark, root))


def _tile_sql(pairs: str) -> str:
    return with_marts(["category_pairs"], f"""
SELECT a.ord AS y_ord, a.category AS y, b.ord AS x_ord, b.category AS x,
       CASE WHEN a.category <> b.category THEN COALESCE(CAST(e.n AS DOUBLE), 0.0) END AS z
FROM nodes a CROSS JOIN nodes b
LEFT JOIN cp e ON e.kat1 = LEAST(a.category, b.category) AND e.kat2 = GREATEST(a.category, b.category)
WHERE a.ord <= {TILE_SIZE} AND b.ord <= {TILE_SIZE}""",
        [f"cp AS ({pairs})", VOLUME_SQL.replace("category_pairs", "cp"), NODES_SQL])


@register("co_purchase_tile", _tile_sql("SELECT * FROM category_pairs"))
def q_co_purchase_tile(spark, root):
    """The first tile of the matrix, every cell drawn."""
    return graph.co_purchase_tile(_pairs(spark, root))


@register("co_purchase_tile_top_pairs", _tile_sql(
    f"SELECT * FROM category_pairs WHERE n IS NOT NULL ORDER BY n DESC, kat1, kat2 LIMIT {TOP_PAIRS}"))
def q_co_purchase_tile_top_pairs(spark, root):
    """The matrix of the most frequent pairs alone; cells of no such
    pair are 0."""
    return graph.co_purchase_tile(graph.top_pairs(_pairs(spark, root)).select("kat1", "kat2", "n"))


@register("network_file", with_marts(["category_pairs"], f"""
SELECT 'node' AS kind, category AS name, CAST(NULL AS VARCHAR) AS other, volume AS weight,
       category || ' — ' || format('{{:,.0f}}', CAST(volume AS DOUBLE)) || '{CO_PURCHASE_SUFFIX}' AS text
FROM nodes
UNION ALL SELECT 'edge', kat1, kat2, CAST(n AS BIGINT),
       kat1 || ' + ' || kat2 || ': ' || format('{{:,.0f}}', CAST(n AS DOUBLE)) || '{ORDER_SUFFIX}'
FROM category_pairs""", [VOLUME_SQL, NODES_SQL]))
def q_network_file(spark, root):
    """The drawable network, written and read back."""
    from warung.session import scratch_path
    path = scratch_path(spark, "network")
    graph.write_network(_pairs(spark, root), path)
    nodes, edges = (spark.read.parquet(f"{path}/{k}") for k in ("nodes", "edges"))
    return (nodes.select(F.lit("node").alias("kind"), F.col("category").alias("name"), F.lit(None).cast("string").alias("other"),
                         F.col("volume").alias("weight"), "text")
            .unionByName(edges.select(F.lit("edge").alias("kind"), F.col("kat1").alias("name"), F.col("kat2").alias("other"),
                                      F.col("n").alias("weight"), "text")))


# ------------------------------------------------------------ forecast
from warung.operators import forecast as FC  # noqa: E402

FC_SALES = ["s AS (SELECT * FROM fact_sales WHERE tanggal IS NOT NULL)"]
WEEKLY_SQL = [
    """wk AS (
  SELECT w.week, CAST(COALESCE(p.profit, 0) AS DECIMAL(24,4)) AS profit,
         ROW_NUMBER() OVER (ORDER BY w.week) AS t
  FROM (SELECT CAST(unnest(generate_series(
                 date_trunc('week', CAST(lo AS DATE) + INTERVAL 6 DAY),
                 date_trunc('week', CAST(hi AS DATE) - INTERVAL 6 DAY), INTERVAL 7 DAY)) AS TIMESTAMP) AS week
        FROM (SELECT MIN(tanggal) AS lo, MAX(tanggal) AS hi FROM s) b) w
  LEFT JOIN (SELECT CAST(date_trunc('week', CAST(tanggal AS DATE)) AS TIMESTAMP) AS week,
                    SUM(profit) AS profit
             FROM s GROUP BY 1) p ON w.week = p.week)"""]
FRAME_SQL = WEEKLY_SQL + [
    f"""fr AS (
  SELECT week, t, profit,
         LAG(profit, 1) OVER (ORDER BY t) AS lag_1, LAG(profit, 2) OVER (ORDER BY t) AS lag_2,
         LAG(profit, 3) OVER (ORDER BY t) AS lag_3, LAG(profit, 4) OVER (ORDER BY t) AS lag_4,
         LAG(profit, {FC.SEASON}) OVER (ORDER BY t) AS lag_52, MAX(t) OVER () AS n_weeks
  FROM wk)""",
    f"""frame AS (
  SELECT *, lag_52 IS NOT NULL AND mean_4 IS NOT NULL AS usable FROM (
    SELECT *, ROUND((lag_1 + lag_2 + lag_3 + lag_4) * 0.25, 4) AS mean_4,
           CASE WHEN t > n_weeks - {FC.TEST_WEEKS} THEN 'test' ELSE 'train' END AS split
    FROM fr) x)"""]
NAIVE_SQL = FRAME_SQL + ["np AS (" + "\n  UNION ALL ".join(
    f"SELECT '{name}' AS model, week, CAST(profit AS DOUBLE) AS aktual, CAST({col} AS DOUBLE) AS prediksi "
    f"FROM frame WHERE split = 'test' AND usable" for name, col in FC.NAIVE_MODELS.items()) + ")"]


def _fc_sql(body: str, ctes: list[str]) -> str:
    return with_marts(["fact_sales"], body, FC_SALES + ctes)


def _weekly(spark, root):
    return FC.weekly_profit(_marts(spark, root)[M.ROLLUP_TABLE])


def _frame(spark, root):
    return FC.forecast_frame(_weekly(spark, root))


@register("weekly_profit", _fc_sql("SELECT week, CAST(profit AS DOUBLE) AS profit, t FROM wk", WEEKLY_SQL))
def q_weekly_profit(spark, root):
    """M1: weekly profit over full Monday weeks, gaps 0."""
    return _weekly(spark, root).select("week", F.col("profit").cast("double").alias("profit"), "t")


FRAME_COLS = ["profit", "lag_1", "lag_2", "lag_3", "lag_4", "lag_52", "mean_4"]


@register("forecast_split", _fc_sql(
    "SELECT week, t, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FRAME_COLS)
    + ", split, usable FROM frame", FRAME_SQL))
def q_forecast_split(spark, root):
    """M1/M2: lag features and the time-ordered train/test split."""
    return _frame(spark, root).select("week", "t", *[F.col(c).cast("double").alias(c) for c in FRAME_COLS],
                                      "split", "usable")


@register("forecast_metrics", _fc_sql("""
SELECT model, ROUND(1.0 - sse / NULLIF(sst, 0.0), 9) AS r2, ROUND(SQRT(mse), 4) AS rmse,
       ROUND(mse, 0) AS mse, ROUND(mape, 9) AS mape
FROM (SELECT model, AVG((aktual - prediksi) * (aktual - prediksi)) AS mse,
             SUM((aktual - prediksi) * (aktual - prediksi)) AS sse,
             COUNT(*) * VAR_POP(aktual) AS sst,
             AVG(ABS(aktual - prediksi) / NULLIF(ABS(aktual), 0.0)) AS mape
      FROM np GROUP BY model) m""", NAIVE_SQL))
def q_forecast_metrics(spark, root):
    """M4: R², RMSE, MSE, MAPE of the naive yardsticks on the test weeks."""
    return FC.score(FC.naive_predictions(_frame(spark, root)))


@register("training_meta", _fc_sql("""
SELECT CAST(SUM(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS INTEGER) AS n_latih,
       CAST(SUM(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS INTEGER) AS n_uji,
       MIN(CASE WHEN split = 'test' THEN week END) AS batas
FROM frame WHERE usable""", FRAME_SQL))
def q_training_meta(spark, root):
    """M9: train weeks, test weeks, cut-off."""
    return FC.training_meta(_frame(spark, root))


@register("fit_linear_models", None)
def q_fit_linear_models(spark, root):
    """M3: MLlib OLS / ridge / lasso scores on the test weeks (rows-only:
    solver numerics)."""
    return FC.score(FC.fit_linear_models(_frame(spark, root))[0])


@register("feature_impact", None)
def q_feature_impact(spark, root):
    """Coefficient x training standard deviation per model and feature."""
    _, coefs, train, _ = FC.fit_linear_models(_frame(spark, root))
    return FC.feature_impact(coefs, train)


# ---- ordinary and ridge least squares: SQL solves the normal equations
_K = len(FC.FEATURES)
_XS = [f"x{i}" for i in range(1, _K + 1)]
_PRED = "a + list_dot_product(b, [" + ", ".join(_XS) + "])"
L2_SPECS = [s for s in FC.LINEAR_MODELS if s.elastic_net == 0.0]


def _step(k: int) -> str:
    """One elimination step: column ``k`` becomes a unit vector."""
    return f"""el{k} AS (SELECT fold, r, my, mx,
  [CASE WHEN i = {k} THEN [v / m[{k}][{k}] FOR v IN m[i]]
        ELSE [m[i][j] - m[i][{k}] * m[{k}][j] / m[{k}][{k}] FOR j IN range(1, {_K + 2})] END FOR i IN range(1, {_K + 1})] AS m
  FROM el{k - 1})"""


L2_SQL = FRAME_SQL + [
    "xs AS (SELECT week, split, " + ", ".join(f"CAST({c} AS DOUBLE) AS {x}" for c, x in zip(FC.FEATURES, _XS))
    + f", CAST(profit AS DOUBLE) AS y, t > MAX(CASE WHEN split = 'train' THEN t END) OVER () - {FC.VALIDATION_WEEKS} AS late "
      "FROM frame WHERE usable)",
    "folds AS (SELECT 'early' AS fold, * FROM xs WHERE split = 'train' AND NOT late "
    "UNION ALL SELECT 'all', * FROM xs WHERE split = 'train')",
    "mom AS (SELECT fold, stddev_pop(y) AS sy, AVG(y) AS my, [" + ", ".join(f"AVG({x})" for x in _XS) + "] AS mx, ["
    + ", ".join("[" + ", ".join(f"covar_pop({x}, {z})" for z in [*_XS, "y"]) + "]" for x in _XS) + "] AS cv FROM folds GROUP BY fold)",
    f"""el0 AS (SELECT fold, r, my, mx,
  [[cv[i][j] + CASE WHEN i = j THEN cv[i][i] * r / sy ELSE 0 END FOR j IN range(1, {_K + 2})] FOR i IN range(1, {_K + 1})] AS m
  FROM mom, (VALUES {", ".join(f"(CAST({r} AS DOUBLE))" for r in [0.0, *FC.GRID])}) p(r))""",
    *[_step(k) for k in range(1, _K + 1)],
    f"""fit AS (SELECT fold, r, b, my - list_dot_product(b, mx) AS a
  FROM (SELECT fold, r, my, mx, [v[{_K + 1}] FOR v IN m] AS b FROM el{_K}) e)""",
    f"""best AS (SELECT r FROM fit, xs WHERE fold = 'early' AND r > 0 AND split = 'train' AND late
  GROUP BY r ORDER BY AVG(ABS(y - ({_PRED})) / NULLIF(ABS(y), 0.0)), r LIMIT 1)""",
    "chosen AS (SELECT CASE WHEN r = 0 THEN 'Linear Regression' ELSE 'Ridge' END AS model, r AS reg_param, a, b "
    "FROM fit WHERE fold = 'all' AND (r = 0 OR r = (SELECT r FROM best)))"]


@register("fit_l2_models", _fc_sql(f"""
SELECT model, reg_param, ROUND(1.0 - sse / NULLIF(sst, 0.0), 6) AS r2, ROUND(SQRT(mse), 2) AS rmse, ROUND(mape, 6) AS mape
FROM (SELECT model, reg_param, AVG((y - p) * (y - p)) AS mse, SUM((y - p) * (y - p)) AS sse,
             COUNT(*) * VAR_POP(y) AS sst, AVG(ABS(y - p) / NULLIF(ABS(y), 0.0)) AS mape
      FROM (SELECT model, reg_param, y, {_PRED} AS p FROM chosen, xs WHERE split = 'test') q
      GROUP BY model, reg_param) m""", L2_SQL))
def q_fit_l2_models(spark, root):
    """M3: MLlib OLS and ridge with the tuned penalty, scored on the test weeks
    (rounded to what two solvers share)."""
    predictions, _, _, penalties = FC.fit_linear_models(_frame(spark, root), L2_SPECS)
    params = spark.createDataFrame(list(penalties.items()), "model string, reg_param double")
    return FC.score(predictions).join(F.broadcast(params), "model").select(
        "model", "reg_param", F.round("r2", 6).alias("r2"), F.round("rmse", 2).alias("rmse"), F.round("mape", 6).alias("mape"))


@register("feature_impact_l2", _fc_sql("""
SELECT model, fitur, ROUND(b[i] * sd, 2) AS dampak
FROM chosen, (""" + " UNION ALL ".join(
    f"SELECT {i} AS i, '{c}' AS fitur, stddev_samp(x{i}) AS sd FROM xs WHERE split = 'train'" for i, c in enumerate(FC.FEATURES, 1)) + ") d", L2_SQL))
def q_feature_impact_l2(spark, root):
    """Feature impact of the OLS and ridge fits, to the cent."""
    _, coefs, train, _ = FC.fit_linear_models(_frame(spark, root), L2_SPECS)
    return FC.feature_impact(coefs, train).select("model", "fitur", F.round("dampak", 2).alias("dampak"))


# ---- the same views over models that SQL states in full
_TRAIN, _TEST = "usable AND split = 'train'", "usable AND split = 'test'"
SINGLE_SQL = NAIVE_SQL + [
    "sf AS (" + "\n  UNION ALL ".join(
        f"SELECT '{m}' AS model, '{c}' AS fitur, regr_slope(CAST(profit AS DOUBLE), CAST({c} AS DOUBLE)) AS coef, "
        f"regr_intercept(CAST(profit AS DOUBLE), CAST({c} AS DOUBLE)) AS intercept, stddev_samp(CAST({c} AS DOUBLE)) AS sd "
        f"FROM frame WHERE {_TRAIN}" for m, c in FC.SINGLE_MODELS.items()) + ")",
    "sp AS (SELECT * FROM np UNION ALL " + "\n  UNION ALL ".join(
        f"SELECT '{m}' AS model, week, CAST(profit AS DOUBLE) AS aktual, "
        f"(SELECT intercept FROM sf WHERE fitur = '{c}') + (SELECT coef FROM sf WHERE fitur = '{c}') * CAST({c} AS DOUBLE) AS prediksi "
        f"FROM frame WHERE {_TEST}" for m, c in FC.SINGLE_MODELS.items()) + ")",
    """sk AS (SELECT *, ROW_NUMBER() OVER (ORDER BY mape, model) = 1 AS terbaik FROM (
  SELECT model, ROUND(1.0 - sse / NULLIF(sst, 0.0), 9) AS r2, ROUND(SQRT(mse), 4) AS rmse, ROUND(mse, 0) AS mse, ROUND(mape, 9) AS mape
  FROM (SELECT model, AVG((aktual - prediksi) * (aktual - prediksi)) AS mse, SUM((aktual - prediksi) * (aktual - prediksi)) AS sse,
               COUNT(*) * VAR_POP(aktual) AS sst, AVG(ABS(aktual - prediksi) / NULLIF(ABS(aktual), 0.0)) AS mape
        FROM sp GROUP BY model) m) s)"""]


def _plain(spark, root):
    return FC.plain_forecast(_frame(spark, root))


@register("single_fits", _fc_sql("""
SELECT model, fitur, ROUND(coef, 6) AS coef, ROUND(intercept, 2) AS intercept, ROUND(coef * sd, 2) AS dampak FROM sf""", SINGLE_SQL))
def q_single_fits(spark, root):
    """One-feature least squares and impacts on the training weeks."""
    return FC.single_fits(_frame(spark, root)).select(
        "model", "fitur", F.round("coef", 6).alias("coef"), F.round("intercept", 2).alias("intercept"), F.round("dampak", 2).alias("dampak"))


@register("plain_scores", _fc_sql("SELECT model, r2, rmse, mse, mape, terbaik FROM sk", SINGLE_SQL))
def q_plain_scores(spark, root):
    """Scores and champion among naive and one-feature models."""
    return _plain(spark, root)["skor"].select("model", "r2", "rmse", "mse", "mape", "terbaik")


@register("plain_model_card", _fc_sql("""
SELECT model, r2, rmse, mape * 100 AS mape_pct, format('{:.3f}', r2) AS r2_text, '$' || format('{:,.0f}', rmse) AS rmse_text,
       format('{:.1f}', mape * 100) || '%' AS mape_text
FROM sk WHERE terbaik""", SINGLE_SQL))
def q_plain_model_card(spark, root):
    """The card of that champion."""
    return FC.model_card(_plain(spark, root)["skor"])


@register("plain_score_table", _fc_sql("""
SELECT model, CAST(NULL AS DOUBLE) AS reg_param, r2, mape, rmse, mse, '—' AS reg_param_text, format('{:.4f}', r2) AS r2_text,
       format('{:.4f}', mape) AS mape_text, format('{:,.0f}', rmse) AS rmse_text, format('{:,.0f}', mse) AS mse_text
FROM sk""", SINGLE_SQL))
def q_plain_score_table(spark, root):
    """The score table; a missing penalty prints a dash."""
    return FC.score_table(_plain(spark, root)["skor"])


@register("plain_predicted_vs_actual", _fc_sql("""
SELECT week, series, ROUND(value, 4) AS value FROM (
  SELECT week, 'Laba sebenarnya' AS series, aktual AS value FROM sp WHERE model = (SELECT model FROM sk WHERE terbaik)
  UNION ALL SELECT week, 'Tebakan ' || model, prediksi FROM sp WHERE model = (SELECT model FROM sk WHERE terbaik)) u""", SINGLE_SQL))
def q_plain_predicted_vs_actual(spark, root):
    """The test weeks of that champion, long form."""
    out = FC.predicted_vs_actual(_plain(spark, root)["prediksi"])
    return out.select("week", "series", F.round("value", 4).alias("value"))


@register("plain_feature_impact_top", _fc_sql("""
SELECT CAST(ROW_NUMBER() OVER (ORDER BY ABS(d) DESC, fitur) AS INTEGER) AS rank, fitur, ROUND(d, 2) AS dampak,
       CASE WHEN d >= 0 THEN 'positive' ELSE 'negative' END AS sign,
       CASE WHEN format('{:,.0f}', d) LIKE '-%' THEN '' ELSE '+' END || format('{:,.0f}', d) AS text,
       MAX(d < 0) OVER () AS any_negative
FROM (SELECT fitur, coef * sd AS d FROM sf) x""", SINGLE_SQL))
def q_plain_feature_impact_top(spark, root):
    """The strongest features of the one-feature models."""
    top = FC.feature_impact_top(_plain(spark, root)["dampak"])
    return top.withColumn("dampak", F.round("dampak", 2))


_FORECAST_CACHE: dict[tuple[str, str], dict[str, DataFrame]] = {}


def _forecast_tables(spark, root) -> dict[str, DataFrame]:
    """B6 once per session and source: fit, write under the shared
    checkpoint folder, read back (later page views read the parquet)."""
    key = _session_key(spark, root)
    if key not in _FORECAST_CACHE:
        _FORECAST_CACHE[key] = M.load_forecast(
            spark, _mart_root(spark, root, "forecast"), lambda: FC.build_forecast(_marts(spark, root)[M.ROLLUP_TABLE]), src_root=root)
    return _FORECAST_CACHE[key]


@register("build_forecast", None)
def q_build_forecast(spark, root):
    """The score table written by the forecast build."""
    return _forecast_tables(spark, root)["skor"]


@register("pick_champion", None)
def q_pick_champion(spark, root):
    """The champion row (lowest MAPE)."""
    return _forecast_tables(spark, root)["skor"].where("terbaik").select("model", "mape", "terbaik")


@register("model_card", None)
def q_model_card(spark, root):
    """M0: the champion's card."""
    return FC.model_card(_forecast_tables(spark, root)["skor"])


@register("predicted_vs_actual", None)
def q_predicted_vs_actual(spark, root):
    """M5: the champion's test-period series, long form."""
    return FC.predicted_vs_actual(_forecast_tables(spark, root)["prediksi"])


for _metric, _name in (("RMSE", "compare_engines"), ("R²", "compare_engines_r2"), ("MAPE", "compare_engines_mape")):
    def _run_c(spark, root, metric=_metric):
        return FC.compare_engines(_forecast_tables(spark, root)["skor"], metric)

    register(_name, None, f"M6: {_metric} of run A and run B side by side")(_run_c)


@register("score_table", None)
def q_score_table(spark, root):
    """M7: the full score table with display texts."""
    return FC.score_table(_forecast_tables(spark, root)["skor"])


@register("feature_impact_top", None)
def q_feature_impact_top(spark, root):
    """M8: the ten strongest features of the champion (or of the best model
    with coefficients when a naive yardstick wins)."""
    t = _forecast_tables(spark, root)
    name = FC.champion_for_impact(t["skor"], t["dampak"]).first()
    return FC.feature_impact_top(t["dampak"], name["model"] if name else None)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.run for k, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q.sql for k, q in REGISTRY.items() if q.sql}


__all__ = ["REGISTRY", "queries", "oracle_sql"]
