"""The sales cells: lines are summed before they meet their part."""
from pyspark.sql import functions as F

from test_plans import plan_of
from warung.sources import marts as M


def source(spark):
    lines = [(1, 10, 2.0, 10.0, 0.1), (1, 10, 3.0, 12.5, 0.0), (1, 10, 1.0, 4.0, None), (1, 10, None, 7.0, 0.0), (2, 20, 5.0, None, 0.1),
             (2, 30, 1.0, 3.0, 0.0), (2, 40, 1.0, 2.0, 0.0), (9, 10, 1.0, 5.0, 0.0), (None, None, 1.0, 1.0, 0.0), (2, 20, 1.0, 8.0, 0.25)]
    lineitem = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double")
    orders = spark.createDataFrame([(1, "F", "1-URGENT"), (2, "P", "5-LOW"), (2, "P", "5-LOW")], "o_orderkey long, o_orderstatus string, o_orderpriority string")
    part = spark.createDataFrame([(10, "red ring", "ECONOMY", 1.5), (10, "big ring", "ECONOMY", 2.0), (10, "red bolt", "PROMO", None),
                                  (20, "red ring", "ECONOMY", 1.0), (20, "red ring", "ECONOMY", None), (30, None, None, 0.5), (None, "x", "y", 1.0)],
                                 "p_partkey long, p_name string, p_type string, p_retailprice double")
    return lineitem, orders.selectExpr("*", "date'1995-01-02' AS o_orderdate"), part


def joined(lineitem, orders, part):
    """Every line with every part of its key, as rows."""
    rows = (lineitem.join(M.order_lines(orders), F.col("l_orderkey") == F.col("o_orderkey"), "left")
            .join(M.product_lines(part), F.col("l_partkey") == F.col("product_id"), "left"))
    profit = F.expr("l_extendedprice * (1 - l_discount) - l_quantity * cast(unit_cost AS double)")
    return (rows.drop("product_id").withColumnRenamed("l_partkey", "product_id").withColumn("p", profit).groupBy(*M.SALES_GRAIN)
            .agg(F.sum("l_quantity").cast("long"), F.sum("l_extendedprice"), F.round(F.sum("p"), 4), F.count("*"), F.count("p")))


def rows(df):
    return sorted((tuple(float(x) if i > 3 and x is not None else x for i, x in enumerate(r)) for r in df.collect()), key=str)


def test_cells_are_sums_over_joined_lines(spark):
    lineitem, orders, part = source(spark)
    cells = M.sales_cells(M.sales_lines(lineitem, orders), part, 3)
    assert rows(cells) == rows(joined(lineitem, orders, part))
    fact = M.build_fact_sales(lineitem, orders, part)
    assert rows(fact) == [r[:7] for r in rows(cells)]
    assert [t for _, t in fact.dtypes[4:]] == ["bigint", "decimal(22,2)", "decimal(28,4)"]


def test_signed_lines_cancel(spark):
    lineitem, orders, part = source(spark)
    lines = M.sales_lines(lineitem, orders)
    both = lines.withColumn("sign", F.lit(1)).unionByName(lines.withColumn("sign", F.lit(-1)))
    for r in M.sales_cells(both, part, 3).collect():
        assert not r["items"] and not r["gross_sales"] and not r["profit"] and r["lines"] == 0 and r["with_profit"] == 0


def test_lines_are_dealt_to_tasks_by_the_size_of_their_files(spark):
    lineitem, orders, part = source(spark)
    tasks = M.line_tasks(lineitem)
    assert tasks == M.TASKS_PER_SPLIT * lineitem.rdd.getNumPartitions()
    plan = plan_of(M.build_fact_sales(lineitem, orders, part))
    assert "hashpartitioning(tanggal" in plan and "REPARTITION_BY_NUM" in plan


def test_held_and_new_cells_are_merged_after_their_shuffle(spark):
    from warung.sources import increments as I
    lineitem, orders, part = source(spark)
    cells = I._kinds(M.sales_cells(M.sales_lines(lineitem, orders), part, 3))
    merged = I._summed(cells.unionByName(cells), 3)
    assert "REPARTITION_BY_NUM" in plan_of(merged)
    double = lambda r: tuple(x * 2 if i > 3 and x is not None else x for i, x in enumerate(r))
    assert rows(merged) == sorted(map(double, rows(cells)), key=str)
