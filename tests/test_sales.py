from decimal import Decimal

from pyspark.sql import functions as F

from helpers import ORDERS_SCHEMA, SALES_SCHEMA, d
from warung.operators import filters, sales


def _sales(spark, rows):
    return spark.createDataFrame(rows, SALES_SCHEMA)


def gap_sales(spark):
    rows = [(d(2024, 1, 3), "A", "Complete", 1, 1, Decimal("1.00"), Decimal("1")),
            (d(2024, 1, 8), "A", "Complete", 1, 1, Decimal("2.00"), Decimal("2")),
            (d(2024, 1, 23), "A", "Complete", 2, 1, Decimal("4.00"), Decimal("4"))]
    return _sales(spark, rows)


def test_gap_fill_daily_weekly_monthly(spark):
    s = gap_sales(spark)
    daily = sales.trend(s, "day").collect()
    assert len(daily) == 21
    assert sum(r.gross_sales for r in daily) == 7.0
    assert [r.gross_sales for r in daily if r.gross_sales == 0].count(0.0) == 18
    weekly = {r.tanggal.day: r.gross_sales for r in sales.trend(s, "week").collect()}
    assert weekly == {1: 1.0, 8: 2.0, 15: 0.0, 22: 4.0}
    monthly = sales.trend(s, "month").collect()
    assert [(r.tanggal, r.gross_sales) for r in monthly] == [(d(2024, 1, 1), 7.0)]


def test_trend_of_empty_frame_has_no_buckets(spark):
    s = filters.filter_facts(gap_sales(spark), d(2030, 1, 1), d(2030, 2, 1))
    assert sales.trend(s, "day").count() == 0


def test_unknown_status_share_vs_kpi(spark):
    o = spark.createDataFrame([(d(2024, 1, 1), "Complete", 3), (d(2024, 1, 1), "Lost", 1)],
                              ORDERS_SCHEMA)
    st = sales.orders_by_status(o).collect()
    assert [(r.status, r.orders, r.share, r.text) for r in st] == [("Complete", 3, 100.0, "3  (100.0%)")]
    kpi = sales.kpi_cards(gap_sales(spark), o).first()
    assert kpi.orders == 4


def test_no_orders_cancel_rate_zero(spark):
    o = spark.createDataFrame([], ORDERS_SCHEMA)
    kpi = sales.kpi_cards(gap_sales(spark), o).first()
    assert kpi.cancel_rate == 0.0 and kpi.orders == 0
    assert kpi.gross_sales == 7.0 and kpi.products_sold == 2


def test_cancel_rate(spark):
    o = spark.createDataFrame([(d(2024, 1, 1), "Cancelled", 1), (d(2024, 1, 2), "Complete", 7)],
                              ORDERS_SCHEMA)
    assert sales.kpi_cards(gap_sales(spark), o).first().cancel_rate == 1 / 8 * 100


def test_empty_filters_and_missing_category_column(spark):
    s = gap_sales(spark)
    assert filters.filter_facts(s, None, None, [], []).count() == 3
    o = spark.createDataFrame([(d(2024, 1, 1), "Complete", 3)], ORDERS_SCHEMA)
    # orders have no category column: the category filter is skipped
    assert filters.filter_facts(o, None, None, ["B"], []).count() == 1
    assert filters.filter_facts(s, None, None, ["B"], []).count() == 0


def test_date_edges_inclusive_and_null_dropped(spark):
    rows = [(d(2024, 1, 1), "A", "Complete", 1, 1, Decimal("1"), Decimal("1")),
            (d(2024, 1, 31), "A", "Complete", 1, 1, Decimal("1"), Decimal("1")),
            (None, "A", "Complete", 1, 1, Decimal("1"), Decimal("1"))]
    s = _sales(spark, rows)
    assert filters.filter_facts(s, d(2024, 1, 1), d(2024, 1, 31)).count() == 2
    assert filters.filter_facts(s, None, None).count() == 2


def test_default_range_from_sales(spark):
    v = filters.filter_all({"fact_sales": gap_sales(spark),
                            "fact_orders": spark.createDataFrame(
                                [(d(2024, 1, 5), "Complete", 1), (d(2024, 3, 1), "Complete", 1)],
                                ORDERS_SCHEMA),
                            "fact_events": spark.createDataFrame([], "tanggal timestamp_ntz")})
    assert v["orders"].count() == 1


def test_grains_reconcile_with_kpi(spark):
    s = gap_sales(spark)
    kpi = sales.kpi_cards(s, spark.createDataFrame([], ORDERS_SCHEMA)).first()
    for g in ("day", "week", "month"):
        t = sales.trend(s, g).agg(F.sum("gross_sales"), F.sum("profit")).first()
        assert (t[0], t[1]) == (kpi.gross_sales, kpi.profit)
    cat = sales.category_table(s).agg(F.sum("gross")).first()[0]
    assert cat == kpi.gross_sales


def test_trend_long_and_end_labels(spark):
    t = sales.trend(gap_sales(spark), "week")
    long = sales.trend_long(t)
    assert long.count() == 8
    assert {r.series for r in long.where("is_last").collect()} == {"Gross sales", "Profit"}
    ends = {r.series: (r.tanggal.day, r.value) for r in sales.trend_end_labels(t).collect()}
    assert ends == {"Gross sales": (22, 4.0), "Profit": (22, 4.0)}


def test_report_labels_texts(spark):
    o = spark.createDataFrame([(d(2024, 1, 1), "Cancelled", 1), (d(2024, 1, 2), "Complete", 3)],
                              ORDERS_SCHEMA)
    rows = sales.report_labels(sales.kpi_cards(gap_sales(spark), o)).collect()
    assert [(r.card, r.text) for r in rows] == [
        ("Gross Sales", "$7"), ("Profit", "$7"), ("Order", "4"), ("Cancel Rate", "25.0%"),
        ("Produk Terjual", "2")]


def test_results_do_not_depend_on_session_time_zone(spark):
    s = gap_sales(spark)
    want = [tuple(r) for r in sales.trend(filters.filter_facts(s, d(2024, 1, 3), d(2024, 1, 8)), "week").collect()]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("America/Sao_Paulo", "Asia/Kolkata", "Pacific/Kiritimati"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            got = [tuple(r) for r in sales.trend(filters.filter_facts(s, d(2024, 1, 3), d(2024, 1, 8)), "week").collect()]
            assert got == want, tz
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_null_category_dropped(spark):
    rows = [(d(2024, 1, 1), None, "Complete", 1, 2, Decimal("5"), Decimal("1")),
            (d(2024, 1, 1), "A", "Complete", 2, 3, Decimal("7"), Decimal("2"))]
    cats = sales.category_table(_sales(spark, rows)).collect()
    assert [(r.category, r.unit, r.gross, r.produk_unik) for r in cats] == [("A", 3, 7.0, 1)]
    assert [r.category for r in filters.option_categories(_sales(spark, rows)).collect()] == ["A"]
