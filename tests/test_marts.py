import os
import tempfile

import pytest

from warung.sources import marts as M

SRC = "/root/testdata/sf0.001"


def test_missing_mart_names_path_and_job(spark):
    root = tempfile.mkdtemp(prefix="warung-missing-")
    with pytest.raises(M.MartMissing) as e:
        M.load_graph(spark, os.path.join(root, "nowhere"))
    assert "category_pairs" in str(e.value) and "build_category_pairs" in str(e.value)
    with pytest.raises(M.MartMissing) as e:
        M.load_forecast(spark, os.path.join(root, "nowhere"))
    assert "build_forecast" in str(e.value)


def test_stale_mart_triggers_rebuild(spark):
    root = tempfile.mkdtemp(prefix="warung-stale-")
    built = M.build_marts(spark, SRC)
    stale = dict(built)
    stale["fact_events"] = built["fact_events"].drop("tanggal")
    M.write_tables(spark, stale, root)
    assert M.read_tables(spark, root, list(built), M.REQUIRED_COLUMNS) is None
    calls = []

    def build():
        calls.append(1)
        return M.build_marts(spark, SRC)

    frames = M.load_or_build(spark, root, list(built), build, M.REQUIRED_COLUMNS)
    assert calls == [1] and "tanggal" in frames["fact_events"].columns
    again = M.load_or_build(spark, root, list(built), build, M.REQUIRED_COLUMNS)
    assert calls == [1] and again["fact_sales"].count() == frames["fact_sales"].count()
    M.load_or_build(spark, root, list(built), build, M.REQUIRED_COLUMNS, refresh=True)
    assert calls == [1, 1]


def test_category_pairs_brute_force(spark):
    lineitem = spark.createDataFrame(
        [(1, 10), (1, 11), (1, 12), (1, 10), (2, 10), (2, 11), (3, 12), (4, 13), (4, 13)],
        "l_orderkey bigint, l_partkey bigint")
    part = spark.createDataFrame(
        [(10, "x a", "T", 1.0), (11, "x b", "T", 1.0), (12, "y a", "T", 1.0), (13, "z c", "U", 1.0)],
        "p_partkey bigint, p_name string, p_type string, p_retailprice double")
    got = {(r.kat1, r.kat2): r.n for r in M.build_category_pairs(lineitem, part).collect()}
    cats = {10: "T a", 11: "T b", 12: "T a", 13: "U c"}
    orders = {}
    for o, p in lineitem.collect():
        orders.setdefault(o, set()).add(cats[p])
    want = {}
    for s in orders.values():
        for a in s:
            for b in s:
                if a < b:
                    want[(a, b)] = want.get((a, b), 0) + 1
    assert got == want == {("T a", "T b"): 2}


def test_events_sessions_are_distinct_user_days(spark):
    import datetime as dt
    ev = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1, 9), 5, "view", 1.0, "{}"),
         (2, dt.datetime(2024, 1, 1, 17), 5, "view", 1.0, "{}"),
         (3, dt.datetime(2024, 1, 1, 17), 10, "view", 1.0, "{}"),
         (4, dt.datetime(2024, 1, 2, 8), 5, "click", 1.0, "{}")],
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    rows = {(r.tanggal.day, r.event_type, r.traffic_source): r.sessions
            for r in M.build_fact_events(ev).collect()}
    assert rows == {(1, "product", "Email"): 2, (2, "cart", "Email"): 1}


def test_half_finished_refresh_leaves_the_old_version(spark):
    root = tempfile.mkdtemp(prefix="warung-half-")
    one = spark.range(3).withColumnRenamed("id", "x")
    M.write_tables(spark, {"a": one, "b": one}, root, "src")

    def fail(_):
        raise RuntimeError("died midway")

    with pytest.raises(RuntimeError):
        M.write_tables(spark, {"a": spark.range(9).withColumnRenamed("id", "x"), "b": fail}, root, "src")
    found = M.read_tables(spark, root, ["a", "b"], {"a": ["x"]}, "src")
    assert found["a"].count() == 3 and found["b"].count() == 3


def test_without_manifest_or_of_another_source_nothing_is_reused(spark):
    root = tempfile.mkdtemp(prefix="warung-manifest-")
    spark.range(3).write.parquet(os.path.join(root, "v-x", "a"))
    assert M.read_tables(spark, root, ["a"]) is None
    M.write_tables(spark, {"a": spark.range(4)}, root, "src")
    assert M.read_tables(spark, root, ["a"], src_root="other") is None
    assert M.read_tables(spark, root, ["a"], src_root="src")["a"].count() == 4


def test_lines_without_part_or_order_stay(spark):
    from warung.operators import products
    lineitem = spark.createDataFrame([(1, 10, 2.0, 10.0, 0.1), (1, 99, 4.0, 20.0, 0.0), (7, 10, 1.0, 5.0, 0.0)],
                                     "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double")
    orders = spark.createDataFrame([(1, "1995-01-02", "1-URGENT", "F")], "o_orderkey long, o_orderdate string, o_orderpriority string, o_orderstatus string")
    orders = orders.withColumn("o_orderdate", orders["o_orderdate"].cast("date"))
    part = spark.createDataFrame([(10, "red ring", "ECONOMY", 1.0)], "p_partkey long, p_name string, p_type string, p_retailprice double")
    rows = {(r.product_id, r.tanggal is None): r for r in M.build_fact_sales(lineitem, orders, part).collect()}
    assert len(rows) == 3
    assert rows[(99, False)].category is None and rows[(99, False)].profit is None and rows[(99, False)].items == 4
    assert rows[(10, True)].status is None and rows[(10, True)].items == 1
    dim = spark.createDataFrame([(10, "red ring", "B")], "product_id long, product_name string, brand string")
    top = products.top_products(M.build_fact_sales(lineitem, orders, part), dim, "units").collect()
    assert [r.label for r in top] == ["99", "red ring"]


def test_a_part_quantity_is_an_error(spark):
    lineitem = spark.createDataFrame([(1, 10, 2.5, 10.0, 0.1)],
                                     "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double")
    orders = spark.createDataFrame([(1, "F", "1-URGENT")], "o_orderkey long, o_orderstatus string, o_orderpriority string").selectExpr("*", "date'1995-01-02' AS o_orderdate")
    part = spark.createDataFrame([(10, "red ring", "ECONOMY", 1.0)], "p_partkey long, p_name string, p_type string, p_retailprice double")
    with pytest.raises(Exception, match="l_quantity"):
        M.build_fact_sales(lineitem, orders, part).collect()


def test_one_order_with_thousands_of_categories(spark):
    n = 1500
    lineitem = spark.range(n).selectExpr("1L AS l_orderkey", "id AS l_partkey")
    part = spark.range(n).selectExpr("id AS p_partkey", "concat('x c', lpad(id, 5, '0')) AS p_name", "'T' AS p_type", "1.0D AS p_retailprice")
    pairs = M.build_category_pairs(lineitem, part)
    assert pairs.count() == n * (n - 1) // 2
