"""Every registered key against its DuckDB SQL on the smallest data set."""
import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))


def test_all_keys_match_duckdb(spark):
    from oracle_check import compare
    from warung.plans import catalog
    res = compare(spark, "/root/testdata/sf0.001", list(catalog.REGISTRY), verbose=False)
    bad = {k: v for k, v in res.items() if not (v == "OK" or v.startswith("rows-only"))}
    assert not bad, bad


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["gross_sales", "profit", "orders", "cancel_rate", "products_sold"]
    assert df.count() == 1
    assert set(E.oracle_sql()) <= set(E.queries())
