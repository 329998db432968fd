"""Sales marts by increments against a build of everything at once."""
import glob
import os
import tempfile

import pytest

from warung.operators import sales
from warung.sources import increments as I
from warung.sources import marts as M
from warung.sources.tables import read_table

SF = "/root/testdata/sf0.001"
YEAR = "o_orderdate >= '1996-02-01' AND o_orderdate < '1996-08-01'"


def orders_of(spark, which):
    return spark.read.parquet(f"{SF}/orders.parquet").where(YEAR).where(f"o_orderkey % 10 {which}")


def lines_of(spark, which):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    keys = spark.read.parquet(f"{SF}/orders.parquet").where(YEAR).selectExpr("o_orderkey AS l_orderkey")
    return lines.join(keys, "l_orderkey", "left_semi").where(f"l_orderkey % 10 {which}").select(*lines.columns)


def put(df, root, table):
    df.coalesce(1).write.mode("append").parquet(f"{root}/{table}.parquet")


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def same_as_batch(spark, root, src):
    source = {t: read_table(spark, src, t) for t in I.SOURCES}
    fact = M.build_fact_sales(source["lineitem"], source["orders"], source["part"])
    got = I.read_sales(spark, root)
    assert rows(got["fact_sales"], fact.columns) == rows(fact, fact.columns)
    orders = M.build_fact_orders(source["orders"])
    assert rows(got["fact_orders"], orders.columns) == rows(orders, orders.columns)
    rollup = M.build_sales_rollup(fact)
    assert rows(got["sales_rollup"], rollup.columns) == rows(rollup, rollup.columns)
    assert sales.distinct_products(got["sales_products"]).first()[0] == fact.where("product_id IS NOT NULL").select("product_id").distinct().count()


@pytest.fixture()
def place(spark):
    base = tempfile.mkdtemp(prefix="warung-incr-")
    src, root = f"{base}/it's src", f"{base}/marts"
    put(spark.read.parquet(f"{SF}/part.parquet"), src, "part")
    put(orders_of(spark, "< 6"), src, "orders")
    put(lines_of(spark, "< 7"), src, "lineitem")
    return src, root


def test_batch_equals_increments(spark, place):
    src, root = place
    assert I.publish_sales(spark, root, src)["done"] == "full"
    same_as_batch(spark, root, src)
    assert I.publish_sales(spark, root, src)["done"] == "reused"
    before = I.states(spark, root)[0]

    # one file of lines of one month: one month is written again
    key = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey % 10 < 6 AND o_orderdate >= '1996-03-01' AND o_orderdate < '1996-04-01'").select("o_orderkey")
    put(lines_of(spark, "< 6").join(key.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey", "left_semi"), src, "lineitem")
    done = I.publish_sales(spark, root, src)
    assert (done["done"], done["months"]) == ("increment", ["1996-03"])
    assert [os.path.basename(p) for p in glob.glob(f"{root}/v-{done['version']}/fact_sales/bulan=*")] == ["bulan=1996-03"]
    same_as_batch(spark, root, src)
    assert I._read(spark, root, before, "fact_sales").count() > 0       # the older state is whole

    # orders of lines that stood without a day, and lines of orders still to come
    put(orders_of(spark, "IN (6, 7)"), src, "orders")
    done = I.publish_sales(spark, root, src)
    assert done["done"] == "increment" and "none" in done["months"]
    same_as_batch(spark, root, src)
    put(lines_of(spark, ">= 7"), src, "lineitem")
    put(orders_of(spark, "> 7"), src, "orders")
    assert I.publish_sales(spark, root, src)["done"] == "increment"
    same_as_batch(spark, root, src)


def test_a_changed_file_or_new_products_build_all(spark, place):
    src, root = place
    I.publish_sales(spark, root, src)
    put(spark.createDataFrame([(10**9, "new ring", "B", "T", 1.0)], "p_partkey long, p_name string, p_brand string, p_type string, p_retailprice double")
        .join(spark.read.parquet(f"{SF}/part.parquet").drop("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice").limit(1)), src, "part")
    assert I.publish_sales(spark, root, src)["done"] == "full"
    same_as_batch(spark, root, src)


def test_load_mart_follows_the_files(spark, place):
    src, root = place
    put(spark.read.parquet(f"{SF}/events.parquet"), src, "events")
    first = M.load_mart(spark, root + "-all", src)["fact_orders"].agg({"orders": "sum"}).first()[0]
    assert len(M.published(spark, root + "-all")) == 1
    M.load_mart(spark, root + "-all", src)
    assert len(M.published(spark, root + "-all")) == 1                   # reused
    put(orders_of(spark, "= 8"), src, "orders")
    again = M.load_mart(spark, root + "-all", src)["fact_orders"].agg({"orders": "sum"}).first()[0]
    assert again > first and len(M.published(spark, root + "-all")) == 2


def test_nothing_published_names_the_job(spark):
    with pytest.raises(M.MartMissing, match="publish_sales"):
        I.read_sales(spark, tempfile.mkdtemp(prefix="warung-none-"))
