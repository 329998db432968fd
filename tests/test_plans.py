"""Plan guards: shapes that would not survive a large cluster fail here."""
import contextlib
import io

from warung.plans import catalog

SF = "/root/testdata/sf0.001"
# keys whose callable writes data (plans of their read-back are checked elsewhere)
WRITERS = {"load_mart", "build_sales_increments", "build_fact_events_stream", "build_forecast", "pick_champion",
           "model_card", "predicted_vs_actual", "compare_engines", "score_table",
           "feature_impact_top", "fit_linear_models", "feature_impact"}


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_no_cross_product_or_python_in_any_plan(spark):
    for key, q in catalog.REGISTRY.items():
        if key in WRITERS:
            continue
        df = q.run(spark, SF)
        assert len(set(df.columns)) == len(df.columns), (key, df.columns)  # the driver keys on names
        plan = plan_of(df)
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                    "ArrowEvalPython", "FlatMapGroupsInPandas"):
            assert bad not in plan, (key, bad)


def test_filters_reach_the_scan(spark):
    plan = plan_of(catalog.REGISTRY["filter_all"].run(spark, SF))
    assert "PushedFilters: [IsNotNull(tanggal), GreaterThanOrEqual(tanggal" in plan
    assert "In(category, [ECONOMY ring,PROMO bolt,SMALL anvil])" in plan
    assert "ReadSchema: struct<tanggal:timestamp_ntz,category:string,status:string,product_id:bigint" in plan


def test_kpi_and_category_views_never_scan_the_product_grain(spark):
    for key in ("kpi_cards", "kpi_cards_filtered", "category_table", "category_table_filtered", "report_labels"):
        plan = plan_of(catalog.REGISTRY[key].run(spark, SF))
        assert "product_id" not in plan and "/fact_sales/" not in plan and "/sales_products/" in plan, key
    plan = plan_of(catalog.REGISTRY["kpi_cards_part_months"].run(spark, SF))
    assert "product_id" in plan and "/sales_products/" in plan


def test_hot_key_paths_combine_map_side(spark):
    pairs = plan_of(catalog.REGISTRY["category_pairs"].run(spark, SF))
    # distinct (order, category) rows are combined before the shuffle, and no
    # array of an order's pairs is built
    assert pairs.count("HashAggregate") >= 4 and "Generate" not in pairs and "collect_" not in pairs
    assert "ReusedExchange" in pairs or pairs.count("Exchange") >= 2
    sales = plan_of(catalog.REGISTRY["build_fact_sales"].run(spark, SF))
    assert "partial_sum" in sales
    top = plan_of(catalog.REGISTRY["top_products_units"].run(spark, SF))
    assert "TakeOrderedAndProject" in top and "partial_sum" in top
