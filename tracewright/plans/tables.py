"""Reading the driver's tables and the stand-ins that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as places with made-up coordinates."""
    return table(spark, sf_dir, "nation").select(
        F.format_string("n%02d", "n_nationkey").alias("point_id"),
        (F.col("n_nationkey") * 7 - 90).cast("double").alias("lon"),
        (F.col("n_nationkey") * 3 - 36).cast("double").alias("lat"),
        (F.col("n_regionkey") == 0).alias("equality"),
    )


PLACES_SQL = """points as (select printf('n%02d', n_nationkey) as point_id, cast(n_nationkey * 7 - 90 as double) as lon,
    cast(n_nationkey * 3 - 36 as double) as lat, n_regionkey = 0 as equality from nation)"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as flows from the supplier's to the customer's nation."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("flow_id"),
        F.col("o_orderstatus").alias("scenario_id"),
        F.format_string("n%02d", "s_nationkey").alias("origin_id"),
        F.format_string("n%02d", "c_nationkey").alias("destination_id"),
        F.col("l_quantity").alias("trips"),
        F.lit("items").alias("unit"),
    )


FLOWS_SQL = """flows as (select o_orderstatus as scenario_id, printf('n%02d', s_nationkey) as origin_id,
    printf('n%02d', c_nationkey) as destination_id, l_quantity as trips, 'items' as unit
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points on a plane, in metres, with residents and a scope."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.round(F.col("embedding")[0].cast("double") * 10000).cast("long").alias("x"),
        F.round(F.col("embedding")[1].cast("double") * 10000).cast("long").alias("y"),
        (F.col("vec_id") % 400 + 1).alias("residents"),
        "label",
    )


POINTS_SQL = """pts as (select vec_id, cast(round(cast(embedding[1] as double) * 10000) as bigint) as x,
    cast(round(cast(embedding[2] as double) * 10000) as bigint) as y, vec_id % 400 + 1 as residents, label from embeddings)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as samples along a line: every event is 10 m on, its value in cents is the height in mm."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("line_id"), "event_id", ((F.row_number().over(order) - 1) * 10).cast("long").alias("at_m"), F.round(F.col("value") * 100).cast("long").alias("height_mm"), "event_type"
    )


SERIES_SQL = """series as (select user_id as line_id, event_id, cast((row_number() over (partition by user_id order by ts, event_id) - 1) * 10 as bigint) as at_m,
    cast(round(value * 100) as bigint) as height_mm, event_type from events)"""


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as nodes, a user's consecutive events as directed edges weighted by how rare they are."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    node = F.concat("event_type", F.lit("-"), (F.col("user_id") % 9).cast("string"))
    steps = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", node.alias("src")).withColumn("dst", F.lead("src").over(order)).where("dst is not null and src <> dst")
    return steps.groupBy("src", "dst").agg(F.count("*").alias("n")).withColumn("weight", (F.lit(1000) / F.col("n")).cast("long") + 1)


TRANSITIONS_SQL = """steps as (select event_type || '-' || (user_id % 9) as src,
    lead(event_type || '-' || (user_id % 9)) over (partition by user_id order by ts, event_id) as dst from events),
    edges as (select src, dst, count(*) as n, cast(floor(1000 / count(*)) as bigint) + 1 as weight from steps
    where dst is not null and src <> dst group by src, dst)"""
