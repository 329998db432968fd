from helpers import EVENTS_SCHEMA, d
from warung.operators import visitors


def test_funnel_partial(spark):
    ev = spark.createDataFrame([(d(2024, 1, 1), "product", "Email", 10),
                                (d(2024, 1, 1), "cancel", "Email", 2),
                                (d(2024, 1, 1), "signup", "Email", 9)], EVENTS_SCHEMA)
    rows = visitors.funnel(ev).collect()
    assert [(r.stage, r.sessions, r.pct) for r in rows] == [
        ("product", 10, 100.0), ("cart", 0, 0.0), ("purchase", 0, 0.0), ("cancel", 2, 20.0)]
    assert [r.text for r in rows] == ["10<br>100.0%", "", "", "Cancel<br>2 (20.0%)"]
    assert [r.funnel_row for r in rows][2:] == ["Akhir kunjungan"] * 2


def test_funnel_has_four_rows_when_empty(spark):
    ev = spark.createDataFrame([], EVENTS_SCHEMA)
    rows = visitors.funnel(ev).collect()
    assert len(rows) == 4 and all(r.sessions == 0 for r in rows)


def test_sessions_by_source_keeps_unknown(spark):
    ev = spark.createDataFrame([(d(2024, 1, 1), "product", "Email", 3),
                                (d(2024, 1, 2), "product", "Radio", 1),
                                (d(2024, 1, 2), "cart", "Email", 5)], EVENTS_SCHEMA)
    rows = visitors.sessions_by_source(ev).collect()
    assert [(r.traffic_source, r.sessions, r.text) for r in rows] == [
        ("Radio", 1, "1 Sesi"), ("Email", 3, "3 Sesi")]
