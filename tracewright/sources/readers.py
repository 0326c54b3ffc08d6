"""Readers of evidence files with declared schemas.  Rows that do not fit are kept apart, never dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.projection import wgs84_to_grid

FEATURE = "type string, id string, geometry struct<type: string, coordinates: string>, properties map<string, string>"


def read_geojson_lines(spark: SparkSession, path: str, max_feature_bytes: int = 4 << 20) -> tuple[DataFrame, DataFrame]:
    """Features of files with one feature a line, and the lines that are not valid features with the reason.

    A line that holds a whole FeatureCollection gives its features, each like a line of its own.  The lines of an
    envelope around features (its opening, its closing brackets, its own members such as a name) are no features and no
    faults; any other line is kept with a reason.  Coordinates stay JSON text until a geometry kernel needs them.
    """
    line = F.regexp_replace(F.trim("value"), r",$", "")
    rows = spark.read.text(path).select(line.alias("line")).where("line <> ''")
    whole = F.get_json_object("line", "$.features")
    inside = F.from_json(whole, "array<string>")
    rows = rows.withColumn("inside", F.when(F.get_json_object("line", "$.type") == "FeatureCollection", inside))
    # Members of a collection beside its features.
    member = r'("type"\s*:\s*"FeatureCollection"|"(name|crs|bbox|features)"\s*:)'
    envelope = F.col("line").rlike(r"^[\[\]{}]+$") | F.col("line").rlike(r"^(\{\s*)?" + member + r'(?!.*"Feature")')
    rows = rows.where(F.col("inside").isNotNull() | ~envelope).select(F.explode(F.coalesce("inside", F.array("line"))).alias("line"))
    rows = rows.withColumn("f", F.from_json("line", FEATURE, {"mode": "PERMISSIVE"}))
    reason = (
        F.when(F.octet_length("line") > max_feature_bytes, "too-large").when(F.col("line").rlike(r":\s*-?(NaN|Infinity)"), "not-finite")
        .when(F.col("f.type").isNull() | (F.col("f.type") != "Feature"), "malformed").when(F.col("f.geometry.type").isNull(), "no-geometry")
    )
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason is null").select(F.coalesce("f.id", F.col("f.properties")["id"]).alias("feature_id"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))
    return good, rows.where("reason is not null").select("line", "reason")


def line_points(coordinates: str = "coordinates"):
    """A LineString's coordinates as ``array<struct<x, y>>``."""
    pairs = F.from_json(F.col(coordinates), "array<array<double>>")
    return F.transform(pairs, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


COUNTS = "count_point_id string, observation_year string, direction_of_travel string, easting string, northing string, latitude string, longitude string, road_name string, all_motor_vehicles string"


def read_traffic_counts(spark: SparkSession, path: str, cell_m: int = 10_000) -> DataFrame:
    """Traffic counts from CSV: trimmed, typed, on the grid by their own coordinates or by projection, with their cell and a disposition."""
    raw = spark.read.csv(path, header=True, schema=COUNTS, enforceSchema=False, mode="PERMISSIVE")
    clean = raw.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in raw.columns])
    whole = lambda c: F.expr(f"try_cast({c} as bigint)")
    number = lambda c: F.expr(f"try_cast({c} as double)")
    east, north = wgs84_to_grid(number("latitude"), number("longitude"))
    rows = clean.select(
        "count_point_id", whole("observation_year").alias("observation_year"), F.lower("direction_of_travel").alias("direction_of_travel"), "road_name", whole("all_motor_vehicles").alias("all_motor_vehicles"),
        F.coalesce(number("easting"), F.round(east, 1)).alias("easting"), F.coalesce(number("northing"), F.round(north, 1)).alias("northing"),
    )
    state = F.when(F.col("count_point_id").isNull(), "no-identity").when(F.col("easting").isNull() | F.col("northing").isNull(), "no-location").when(F.col("all_motor_vehicles").isNull() | (F.col("all_motor_vehicles") < 0), "no-count").otherwise("usable")
    return rows.withColumn("cell_x", F.floor(F.col("easting") / cell_m)).withColumn("cell_y", F.floor(F.col("northing") / cell_m)).withColumn("disposition", state)


WAY = T.StructType([
    T.StructField("_id", T.LongType()),
    T.StructField("nd", T.ArrayType(T.StructType([T.StructField("_ref", T.LongType())]))),
    T.StructField("tag", T.ArrayType(T.StructType([T.StructField("_k", T.StringType()), T.StructField("_v", T.StringType())]))),
])
NODE = T.StructType([T.StructField("_id", T.LongType()), T.StructField("_lat", T.DoubleType()), T.StructField("_lon", T.DoubleType())])


def read_osm_ways(spark: SparkSession, path: str) -> DataFrame:
    """Ways of an OSM XML extract with their points in order and their tags; a way that lacks a node says how many."""
    ways = spark.read.format("xml").options(rowTag="way").schema(WAY).load(path)
    nodes = spark.read.format("xml").options(rowTag="node").schema(NODE).load(path).select(F.col("_id").alias("ref"), F.col("_lon").alias("x"), F.col("_lat").alias("y"))
    tags = F.map_from_entries(F.transform(F.array_distinct(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>"))), lambda t: F.struct(t["_k"], F.trim(t["_v"]))))
    parts = ways.select(F.col("_id").alias("way_id"), tags.alias("tags"), F.posexplode_outer("nd").alias("at", "nd"))
    rows = parts.join(nodes, F.col("nd._ref") == F.col("ref"), "left")
    return rows.groupBy("way_id").agg(
        F.first("tags").alias("tags"), F.transform(F.array_sort(F.collect_list(F.when(F.col("ref").isNotNull(), F.struct("at", "x", "y")))), lambda p: F.struct(p["x"], p["y"])).alias("points"),
        F.count_if(F.col("ref").isNull()).alias("missing_nodes"),
    )


def strict_key_join(key: str, **tables: DataFrame) -> DataFrame:
    """Tables joined on a key that every one must hold exactly once; otherwise the query fails with the key."""
    out = None
    for name, df in tables.items():
        one = df.groupBy(key).agg(F.count("*").alias(f"n_{name}"), F.first(F.struct(*[c for c in df.columns if c != key])).alias(name))
        out = one if out is None else out.join(one, key, "full")
    bad = F.lit(False)
    for name in tables:
        bad = bad | (F.coalesce(f"n_{name}", F.lit(0)) != 1)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("key is not in every table once: "), F.col(key).cast("string"))).cast(out.schema[key].dataType)).otherwise(F.col(key))
    return out.select(checked.alias(key), *[f"{name}.*" for name in tables])
