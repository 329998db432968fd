"""Dashboard filters.

All filters are plain ``where`` clauses, so Catalyst pushes them into the
parquet scan of a written mart (``PushedFilters``) or below the joins of a
lazily built one.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warung.functions.scalars import is_present

MONTH = "month"  # partition column of a month-partitioned mart

DateLike = dt.date | dt.datetime | str | None


def _ts_literal(v: DateLike):
    if v is None:
        return None
    if isinstance(v, str):
        v = dt.datetime.fromisoformat(v)
    if isinstance(v, dt.datetime):
        v = v.replace(tzinfo=None)
    elif isinstance(v, dt.date):
        v = dt.datetime(v.year, v.month, v.day)
    # A text literal cast to timestamp_ntz involves no time zone (a Python
    # datetime literal would pass through the process and session zones).
    return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")


def filter_facts(df: DataFrame, start: DateLike, end: DateLike,
                 categories: Sequence[str] = (), statuses: Sequence[str] = (),
                 use_category: bool = True, use_status: bool = True) -> DataFrame:
    """``start <= tanggal <= end`` (both ends inclusive; NULL dates
    drop), ``category IN`` and ``status IN`` — each list filter is skipped
    when the list is empty, its switch is off, or the column is absent.

    A missing bound only drops NULL dates.
    """
    cond = F.col("tanggal").isNotNull()
    lo, hi = _ts_literal(start), _ts_literal(end)
    if lo is not None:
        cond = cond & (F.col("tanggal") >= lo)
    if hi is not None:
        cond = cond & (F.col("tanggal") <= hi)
    if MONTH in df.columns:
        # a mart written in month directories: the same range on the
        # partition column prunes directories before files are opened
        if lo is not None:
            cond = cond & (F.col(MONTH) >= F.trunc(lo.cast("date"), "month"))
        if hi is not None:
            cond = cond & (F.col(MONTH) <= F.trunc(hi.cast("date"), "month"))
    if use_category and categories and "category" in df.columns:
        cond = cond & F.col("category").isin(list(categories))
    if use_status and statuses and "status" in df.columns:
        cond = cond & F.col("status").isin(list(statuses))
    return df.where(cond)


def _moment(v: DateLike) -> dt.datetime | None:
    if isinstance(v, str):
        v = dt.datetime.fromisoformat(v)
    if isinstance(v, dt.date) and not isinstance(v, dt.datetime):
        v = dt.datetime(v.year, v.month, v.day)
    return v.replace(tzinfo=None) if v is not None else None


def _month_from(v: dt.datetime) -> dt.datetime:
    """The first month start at or after ``v``."""
    first = dt.datetime(v.year, v.month, 1)
    return first if v <= first else dt.datetime(v.year + v.month // 12, v.month % 12 + 1, 1)


def product_sets(bits: DataFrame, sales: DataFrame, start: DateLike, end: DateLike, categories: Sequence[str] = (),
                 statuses: Sequence[str] = (), bounds: tuple[DateLike, DateLike] = (None, None)) -> DataFrame:
    """The product bitmaps of a selection: whole months from ``bits`` (see
    ``marts.build_product_bits``), the days of a month that is cut into from
    the sales fact.  A range that reaches the ``bounds`` of the data cuts into
    no month there, so the default view and whole months read ``bits`` alone.
    """
    from warung.sources.marts import build_product_bits

    lo, hi = _moment(start), _moment(end)
    least, most = map(_moment, bounds)
    lo = None if lo is None or (least is not None and lo <= least) else lo
    hi = None if hi is None or (most is not None and hi >= most) else hi
    month, edges = F.col("month").isNotNull(), []
    first = lo and _month_from(lo)
    # a month is whole if its last midnight is in the range
    last = hi and _month_from(dt.datetime(hi.year, hi.month, hi.day) + dt.timedelta(days=1))
    if last is not None and last > dt.datetime(hi.year, hi.month, hi.day) + dt.timedelta(days=1):
        last = dt.datetime(hi.year, hi.month, 1)          # the month that ``hi`` cuts into is not whole
    if first is not None and last is not None and last <= first:
        edges.append((lo, hi))
        month = F.lit(False)
    else:
        if first is not None:
            month = month & (F.col("month") >= F.lit(first.date().isoformat()).cast("date"))
            if lo < first:
                edges.append((lo, first - dt.timedelta(microseconds=1)))
        if last is not None:
            month = month & (F.col("month") < F.lit(last.date().isoformat()).cast("date"))
            if last <= hi:
                edges.append((last, hi))
    whole = bits.where(month)
    if categories:
        whole = whole.where(F.col("category").isin(list(categories)))
    if statuses:
        whole = whole.where(F.col("status").isin(list(statuses)))
    whole = whole.select("category", "status", "bucket", "products")
    for a, b in edges:
        days = build_product_bits(filter_facts(sales, a, b, categories, statuses))
        whole = whole.unionByName(days.select("category", "status", "bucket", "products"))
    return whole


def date_bounds(sales: DataFrame) -> tuple[dt.datetime | None, dt.datetime | None]:
    """First and last day of the sales fact (one tiny aggregate job)."""
    row = sales.agg(F.min("tanggal").alias("lo"), F.max("tanggal").alias("hi")).first()
    return (row["lo"], row["hi"]) if row is not None else (None, None)


def resolve_range(sales: DataFrame, start: DateLike = None,
                  end: DateLike = None) -> tuple[DateLike, DateLike]:
    """an incomplete range falls back to the bounds of the sales fact."""
    if start is not None and end is not None:
        return start, end
    return date_bounds(sales)


def filter_all(marts: dict[str, DataFrame], start: DateLike = None, end: DateLike = None,
               categories: Sequence[str] = (), statuses: Sequence[str] = ()
               ) -> dict[str, DataFrame]:
    """The filtered facts of one dashboard view, the sales rollup and the
    product sets (the sales fact itself where the marts have none).

    Sales and orders take every filter; events take the date range only (a
    visitor who is only browsing has no category or order status).
    """
    rollup = marts.get("sales_rollup", marts["fact_sales"])
    bounds = date_bounds(rollup)
    lo, hi = (start, end) if start is not None and end is not None else bounds
    bits, whole = marts.get("sales_products"), filter_facts(marts["fact_sales"], lo, hi, categories, statuses)
    return {
        "products": whole if bits is None else product_sets(bits, marts["fact_sales"], lo, hi, categories, statuses, bounds),
        "rollup": filter_facts(rollup, lo, hi, categories, statuses),
        "sales": whole,
        "orders": filter_facts(marts["fact_orders"], lo, hi, categories, statuses),
        "events": filter_facts(marts["fact_events"], lo, hi, categories, statuses,
                               use_category=False, use_status=False),
    }


def option_categories(sales: DataFrame) -> DataFrame:
    """sorted distinct category list (for the category picker)."""
    return (sales.select("category").where(F.col("category").isNotNull())
            .distinct().orderBy("category"))


def has_rows(df: DataFrame) -> bool:
    """False when the filtered sales are empty (the page then stops)."""
    return not df.isEmpty()


def present(df: DataFrame, column: str) -> DataFrame:
    """rows whose value exists (neither NULL nor NaN)."""
    is_double = dict(df.dtypes).get(column) in ("double", "float")
    return df.where(is_present(F.col(column), is_double))
