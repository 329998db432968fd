"""Visitor page: visit funnel and sessions by traffic source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from warung.fixed_values import FUNNEL_ROWS, FUNNEL_STAGES, SESSIONS_SUFFIX, STAGE_NAMES
from warung.functions.scalars import at_least_one, count_text, percent_of, percent_text


def funnel(events: DataFrame) -> DataFrame:
    """Sessions per funnel stage, exactly four rows, absent stages 0.

    Stages are independent sums (a later stage may exceed an earlier one);
    shares are of the product stage (at least 1).  ``row`` is the funnel row a
    stage is drawn in: purchase and cancel share the last one.  ``text`` is
    empty for a zero stage, ``"1,234<br>56.7%"`` for the first two stages and
    ``"<name><br>1,234 (56.7%)"`` for the last row.
    """
    per = (events.where(F.col("event_type").isin(FUNNEL_STAGES))
           .groupBy("event_type").agg(F.sum("sessions").alias("sessions")))
    rows = ", ".join(f"({i + 1}, '{s}', '{STAGE_NAMES[s]}', '{FUNNEL_ROWS[min(i, len(FUNNEL_ROWS) - 1)]}')"
                     for i, s in enumerate(FUNNEL_STAGES))
    stages = events.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(ord, event_type, stage_name, funnel_row)")
    v = F.coalesce(F.col("sessions"), F.lit(0)).cast("bigint")
    joined = stages.join(F.broadcast(per), "event_type", "left").withColumn("sessions", v)
    peak = at_least_one(F.max(F.when(F.col("ord") == 1, F.col("sessions"))).over(Window.partitionBy()))
    with_pct = joined.withColumn("pct", percent_of(F.col("sessions"), peak))
    text = (F.when(F.col("sessions") == 0, F.lit(""))
             .when(F.col("ord") <= 2, F.concat(count_text(F.col("sessions")), F.lit("<br>"),
                                               percent_text(F.col("pct"))))
             .otherwise(F.concat(F.col("stage_name"), F.lit("<br>"), count_text(F.col("sessions")),
                                 F.lit(" ("), percent_text(F.col("pct")), F.lit(")"))))
    return (with_pct.select("ord", F.col("event_type").alias("stage"), "stage_name", "funnel_row",
                            "sessions", "pct", text.alias("text"))
            .orderBy("ord"))


def sessions_by_source(events: DataFrame) -> DataFrame:
    """Sessions of product views per traffic source, ascending;
    sources outside the fixed list are kept."""
    return (events.where((F.col("event_type") == "product") & F.col("traffic_source").isNotNull())
            .groupBy("traffic_source")
            .agg(F.sum("sessions").cast("bigint").alias("sessions"))
            .select("traffic_source", "sessions",
                    F.concat(count_text(F.col("sessions")), F.lit(SESSIONS_SUFFIX)).alias("text"))
            .orderBy("sessions", "traffic_source"))
