"""What a publish of the sales marts leaves on disk, and its groups of months."""
import glob
import tempfile
import time

import pytest

from warung.session import checkpoint_root
from warung.sources import increments as I
from warung.sources import marts as M
from warung.sources.tables import read_table

ORDER = "o_orderkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp_ntz"
LINE = "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double"
PART = "p_partkey long, p_name string, p_type string, p_retailprice double"


def add(spark, src, table, rows, schema):
    kinds = dict(x.split(" ") for x in schema.split(", "))
    plain = ", ".join(f"{c} {'string' if k == 'timestamp_ntz' else k}" for c, k in kinds.items())
    spark.createDataFrame(rows, plain).selectExpr(*[f"cast({c} AS {k}) AS {c}" for c, k in kinds.items()]).coalesce(1).write.mode("append").parquet(f"{src}/{table}.parquet")


def order(k):
    return (k, "FOP"[k % 3], "5-LOW" if k % 4 == 0 else "1-URGENT", None if k == 7 else f"1996-{1 + k % 6:02d}-{1 + k % 28:02d} 00:00:00")


def lines(keys):
    return [(k, p, float(1 + k % 5), 10.0 * p + k, d) for k in keys for p, d in ((1, 0.1), (2, None), (9, 0.25))] + [(None, 1, 1.0, 1.0, 0.0)]


@pytest.fixture()
def place(spark):
    base = tempfile.mkdtemp(prefix="warung-disk-")
    src = f"{base}/src"
    add(spark, src, "part", [(1, "red ring", "ECONOMY", 1.5), (1, "big ring", "ECONOMY", 2.0), (2, "red bolt", "PROMO", None)], PART)
    add(spark, src, "orders", [order(k) for k in range(30)], ORDER)
    add(spark, src, "lineitem", lines(range(0, 60, 2)), LINE)
    return src, f"{base}/marts"


def late(spark, src):
    # an order that had come before comes again, and one for lines that still have none
    add(spark, src, "orders", [order(k) for k in range(30, 55)] + [(4, "F", "1-URGENT", "1996-12-01 00:00:00"), order(40)], ORDER)
    add(spark, src, "lineitem", lines(range(1, 60, 2)), LINE)


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def same_as_batch(spark, src, root):
    source = {t: read_table(spark, src, t) for t in I.SOURCES}
    fact = M.build_fact_sales(source["lineitem"], source["orders"], source["part"])
    got = I.read_sales(spark, root)
    assert rows(got["fact_sales"], fact.columns) == rows(fact, fact.columns)
    rollup = M.build_sales_rollup(fact)
    assert rows(got["sales_rollup"], rollup.columns) == rows(rollup, rollup.columns)


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (found.apply(i).getName() for i in range(found.size()))
    return {x for x in names if x.startswith("shuffle_")}


def test_no_shuffle_outlives_its_job(spark, place):
    src, root = place
    before = shuffle_files(spark)
    I.publish_sales(spark, root, src)
    late(spark, src)
    between = shuffle_files(spark)
    assert I.publish_sales(spark, root, src)["done"] == "increment"
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left, (len(left), len(between - before))


def test_groups_of_months_give_the_same_fact(spark, place, monkeypatch):
    src, root = place
    monkeypatch.setattr(I, "GROUP_ROWS", 1)
    monkeypatch.setattr(I, "GROUP_SHARE", 0.3)
    made = []
    groups = I._groups
    monkeypatch.setattr(I, "_groups", lambda *a: made.append(groups(*a)) or made[-1])
    assert I.publish_sales(spark, root, src)["done"] == "full"
    same_as_batch(spark, src, root)
    late(spark, src)
    done = I.publish_sales(spark, root, src)
    assert done["done"] == "increment" and I.NO_MONTH in done["months"]
    same_as_batch(spark, src, root)
    assert [len(g) > 2 for g in made] == [True, True]
    assert [m for g, _ in made[1] for m in g] == done["months"]
    assert all(abs(sum(share for _, share in g) - 1) < 1e-9 for g in made)
    assert not glob.glob(f"{checkpoint_root(spark).removeprefix('file:')}/sales-lines-*")


def test_groups_hold_neighbours_up_to_their_size(spark, monkeypatch):
    monkeypatch.setattr(I, "GROUP_ROWS", 10)
    counts = {"1996-01": 4, "1996-02": 5, "1996-03": 30, "1996-04": 1, "none": 8}
    df = spark.createDataFrame([(m,) for m, n in counts.items() for _ in range(n)], f"{I.KEY} string")
    assert [g for g, _ in I._groups(df)] == [["1996-01", "1996-02"], ["1996-03"], ["1996-04", "none"]]
    assert [g for g, _ in I._groups(df, ["1996-05", "none"])] == [["1996-05", "none"]]
    assert I._groups(df.limit(0)) == [([], 0.0)]
