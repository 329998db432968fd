from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from py4j.protocol import Py4JJavaError

from helpers import DIM_SCHEMA, SALES_SCHEMA, d
from warung.operators import products


def _sales(spark, per_product, measure="items"):
    rows = []
    for pid, v in per_product:
        items = v if measure == "items" else 1
        profit = Decimal(str(v)) if measure == "profit" else Decimal("0")
        rows.append((d(2024, 1, 1), "A", "Complete", pid, items, Decimal("1"), profit))
    return spark.createDataFrame(rows, SALES_SCHEMA)


def _dim(spark, ids):
    return spark.createDataFrame([(i, f"product {i}", f"B{i % 3}") for i in ids], DIM_SCHEMA)


def ties(spark):
    vals = [(1, 100)] + [(i, 50) for i in range(2, 12)] + [(12, 10)]
    return _sales(spark, vals)


def test_top_ties_go_to_lower_key(spark):
    top = products.top_products(ties(spark), _dim(spark, range(1, 13)), "units").collect()
    assert [r.product_id for r in top] == [1] + list(range(2, 11))
    assert [r.rank for r in top] == list(range(1, 11))
    assert top[0].text == "100" and top[1].label == "product 2"


def test_rank_ties_table(spark):
    rows = {r.peringkat: r for r in products.rank_ties(ties(spark)).collect()}
    u = rows["unit terjual"]
    assert (u.top_1, u.top_10, u.ties_in_top_10, u.top_11) == (100.0, 50.0, 9, 50.0)


def test_rank_ties_skips_short_rankings(spark):
    short = _sales(spark, [(i, i) for i in range(1, 11)])
    assert products.rank_ties(short).count() == 0


def test_missing_values_skipped(spark):
    rows = [(1, 5.0), (2, 7.0), (3, float("nan")), (4, None)]
    df = spark.createDataFrame(rows, "product_id bigint, units double")
    df = df.withColumn("profit", df.units)
    top = products._top(df, "product_id", "units", 10).collect()
    assert [(r.product_id, r.value) for r in top] == [(2, 7.0), (1, 5.0)]


def test_unmatched_product_label_and_brand(spark):
    s = _sales(spark, [(1, 5), (99, 8)])
    top = products.top_products(s, _dim(spark, [1]), "units").collect()
    assert [(r.product_id, r.label) for r in top] == [(99, "99"), (1, "product 1")]
    brands = products.top_brands(s, _dim(spark, [1]), "units").collect()
    assert [(r.brand, r.value) for r in brands] == [("B1", 5)]


def test_null_brand_dropped(spark):
    s = _sales(spark, [(1, 5), (2, 3)])
    dim = spark.createDataFrame([(1, "p1", None), (2, "p2", "X")], DIM_SCHEMA)
    assert [(r.brand, r.value) for r in products.top_brands(s, dim).collect()] == [("X", 3)]


def test_duplicate_dimension_key_is_an_error(spark):
    s = _sales(spark, [(1, 5)])
    dim = spark.createDataFrame([(1, "a", "X"), (1, "b", "Y")], DIM_SCHEMA)
    with pytest.raises((PySparkException, Py4JJavaError)):
        products.top_brands(s, dim).collect()
    with pytest.raises((PySparkException, Py4JJavaError)):
        products.top_products(s, dim).collect()


def test_profit_top_text(spark):
    s = _sales(spark, [(1, 1234.5), (2, -3)], "profit")
    top = products.top_products(s, _dim(spark, [1, 2]), "profit").collect()
    assert [r.text for r in top] == ["$1,234", "$-3"]
