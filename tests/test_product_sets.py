"""Distinct products from month bitmaps against a distinct count of the fact."""
import datetime as dt
import random

import pytest

from helpers import SALES_SCHEMA, d
from warung.operators import filters, sales
from warung.sources import marts as M


@pytest.fixture(scope="module")
def fact(spark):
    rng = random.Random(8)
    ids = [0, 1, 32768, 32769, 65536, -1, -32768, 10**12, None, *range(40, 60)]
    rows = [(d(2024, rng.randint(1, 5), rng.randint(1, 28)) if rng.random() > 0.05 else None, rng.choice(["a", "b", None]),
             rng.choice(["x", "y", None]), rng.choice(ids), 1, None, None) for _ in range(600)]
    rows += [(d(2024, 1, 31), "a", "x", 999, 1, None, None), (d(2024, 3, 1), "a", "x", 998, 1, None, None), (d(2024, 3, 31), "a", "x", 997, 1, None, None)]
    return spark.createDataFrame(rows, SALES_SCHEMA).cache()


RANGES = [(None, None), (d(2024, 1, 1), d(2024, 5, 31)), (d(2024, 1, 31), d(2024, 3, 1)), (d(2024, 2, 1), d(2024, 3, 31)), (d(2024, 2, 10), d(2024, 2, 20)),
          (d(2024, 2, 1), d(2024, 2, 29)), (d(2024, 1, 15), d(2024, 4, 30)), ("2024-02-02", dt.date(2024, 4, 15)), (d(2023, 1, 1), d(2025, 1, 1)),
          (d(2024, 4, 1), d(2024, 3, 1)), (d(2024, 3, 31), None), (None, d(2024, 3, 31))]


@pytest.mark.parametrize("start, end", RANGES)
@pytest.mark.parametrize("lists", [((), ()), (("a",), ("x", "y"))])
def test_sets_equal_a_distinct_count(spark, fact, start, end, lists):
    bits = M.build_product_bits(fact)
    kept = filters.filter_facts(fact, start, end, *lists)
    for bounds in ((None, None), filters.date_bounds(fact)):
        found = filters.product_sets(bits, fact, start, end, *lists, bounds=bounds)
        assert (sales.distinct_products(found).first()[0] or 0) == sales.distinct_products(kept).first()[0]
        by = lambda df: {r.category: r.n_products for r in sales.distinct_products(df, "category").collect() if r.n_products}
        assert by(found) == by(kept)


def test_a_bitmap_row_per_month_category_status_and_id_range(spark):
    rows = spark.range(0, 100_000).selectExpr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 60 as int)) AS tanggal", "'a' AS category", "'x' AS status",
                                              "id % 1000 AS product_id")
    bits = M.build_product_bits(rows)
    assert bits.count() == 2 * 2                   # ids 1-999 and 0 lie in two buckets, the days in two months
    assert sales.distinct_products(bits).first()[0] == 1000
