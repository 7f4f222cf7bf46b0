"""Point patterns, snapshots and grids as views over the given tables, for Spark and, as text, for the SQL oracle.

Coordinates are whole millimetres, so squared distances are exact in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning
from ..sources.tables import read_table

WINDOW = (0.0, 0.0, 20000.0, 10000.0)
NX, NY, SIDE = 40, 20, 500


def all_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, pattern_id, point_id, x, y, uncropped: every event is a point. A user's events make up two patterns, which
    share them unevenly, so that small and large patterns occur."""
    return read_table(spark, sf_dir, "events").selectExpr(
        "if((user_id div 4) % 2 = 0, 'Data', 'Model') as source", "user_id * 2 + if(event_id % 8 < user_id % 8, 0, 1) as pattern_id", "event_id as point_id",
        "cast(round(value * 100) as bigint) as x", "cast(get_json_object(props, '$.k') as bigint) * 100 + event_id % 100 as y")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.crop(all_points(spark, sf_dir), WINDOW)


def crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About 600 points for each supplier, numbered inside the pattern."""
    return read_table(spark, sf_dir, "lineitem").selectExpr(
        "'Data' as source", "l_suppkey as pattern_id",
        "row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate) as point_id",
        "cast(l_quantity * 400 as bigint) as x", "(l_partkey * 37 + l_linenumber) % 10000 as y")


def epoch_millis(df: DataFrame, column: str) -> str:
    """SQL text for milliseconds since 1970 of a time, rounded down. A time without zone counts as UTC, whatever zone the
    session has: casts to a zoned timestamp would shift it by the session's zone."""
    if df.schema[column].dataType.typeName() == "timestamp":
        return f"unix_millis({column})"
    at = f"cast({column} as timestamp_ntz)"
    return f"(unix_date(date({at})) * 86400000L + hour({at}) * 3600000L + minute({at}) * 60000L + cast(floor(extract(second from {at}) * 1000) as bigint))"


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    return events.selectExpr(
        f"{epoch_millis(events, 'ts')} div 3600000 as t", "user_id as object_identifier", "event_id as seq",
        "cast(round(value * 100) as bigint) as x_position_mm", "cast(get_json_object(props, '$.k') as bigint) * 100 + event_id % 100 as y_position_mm",
        "if(event_type in ('view', 'click'), 0, 1) as stand_or_walk", "value")


def velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = cleaning.dedup_in_snapshot(snapshots(spark, sf_dir), "t", "object_identifier", "seq", "first")
    return first.where("object_identifier % 5 <> 0").selectExpr("t", "object_identifier", "value - 50 as x_vel_SG", "cast(object_identifier % 7 - 3 as double) as y_vel_SG")


def grid(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    return spark.range(NX * NY).selectExpr(
        "cast(id as int) as grid_index", f"cast(id % {NX} as int) as x_rounded", f"cast(id div {NX} as int) as y_rounded",
        f"id % {NX} * 500D + 250D as x", f"(id div {NX}) * 500D + 250D as y")


def clean_grid(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    return grid(spark).where("not (x_rounded >= 30 and y_rounded < 4)")


def cells(df: DataFrame) -> DataFrame:
    """df with ix, iy and grid_index on the 40 x 20 grid."""
    ix = F.least(F.expr(f"x div {SIDE}"), F.lit(NX - 1)).cast("int")
    iy = F.least(F.expr(f"y div {SIDE}"), F.lit(NY - 1)).cast("int")
    return df.withColumn("ix", ix).withColumn("iy", iy).withColumn("grid_index", F.col("iy") * NX + F.col("ix"))


SQL = {
    "allpts": """SELECT CASE WHEN (user_id // 4) % 2 = 0 THEN 'Data' ELSE 'Model' END AS source, user_id * 2 + CASE WHEN event_id % 8 < user_id % 8 THEN 0 ELSE 1 END AS pattern_id, event_id AS point_id,
        CAST(round(value * 100) AS BIGINT) AS x, CAST(json_extract_string(props, '$.k') AS BIGINT) * 100 + event_id % 100 AS y
        FROM events""",
    "pts": "SELECT * FROM allpts WHERE x BETWEEN 0 AND 20000 AND y BETWEEN 0 AND 10000",
    "snaps": """SELECT epoch_ms(ts) // 3600000 AS t, user_id AS object_identifier, event_id AS seq, CAST(round(value * 100) AS BIGINT) AS x_position_mm,
        CAST(json_extract_string(props, '$.k') AS BIGINT) * 100 + event_id % 100 AS y_position_mm,
        CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END AS stand_or_walk, value FROM events""",
    "firsts": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t, object_identifier ORDER BY seq) AS rn FROM snaps) WHERE rn = 1",
    "lasts": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t, object_identifier ORDER BY seq DESC) AS rn FROM snaps) WHERE rn = 1",
    "vel": "SELECT t, object_identifier, value - 50 AS x_vel_SG, CAST(object_identifier % 7 - 3 AS DOUBLE) AS y_vel_SG FROM firsts WHERE object_identifier % 5 <> 0",
    "grid": "SELECT CAST(i AS INT) AS grid_index, CAST(i % 40 AS INT) AS x_rounded, CAST(i // 40 AS INT) AS y_rounded, i % 40 * 500.0::DOUBLE + 250 AS x, (i // 40) * 500.0::DOUBLE + 250 AS y FROM range(800) r(i)",
    "cleangrid": "SELECT * FROM grid WHERE NOT (x_rounded >= 30 AND y_rounded < 4)",
    "cells": "SELECT *, CAST(least(x // 500, 39) AS INT) AS ix, CAST(least(y // 500, 19) AS INT) AS iy, CAST(least(y // 500, 19) * 40 + least(x // 500, 39) AS INT) AS grid_index FROM pts",
    "pairs": """SELECT a.source, a.pattern_id, a.point_id AS i, b.point_id AS j, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2
        FROM pts a JOIN pts b ON a.source = b.source AND a.pattern_id = b.pattern_id AND a.point_id <> b.point_id""",
    "sizes": "SELECT source, pattern_id, count(*) AS n FROM pts GROUP BY 1, 2",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY source, pattern_id, i ORDER BY d2, j) AS rk FROM pairs",
    "near1": "SELECT source, pattern_id, i AS point_id, sqrt(d2) AS d FROM ranked WHERE rk = 1",
    "near2": "SELECT source, pattern_id, i AS point_id, sqrt(d2) AS d FROM ranked WHERE rk = 2",
    "occ": "SELECT t, count(DISTINCT object_identifier) AS occupancy FROM snaps GROUP BY t",
    "fracs": "SELECT t, avg(CASE WHEN stand_or_walk = 0 THEN 1.0 ELSE 0.0 END) AS frac_standing FROM snaps GROUP BY t",
}
NEEDS = {
    "pts": ["allpts"], "firsts": ["snaps"], "lasts": ["snaps"], "vel": ["firsts"], "cleangrid": ["grid"], "cells": ["pts"], "pairs": ["pts"],
    "sizes": ["pts"], "ranked": ["pairs"], "near1": ["ranked"], "near2": ["ranked"], "occ": ["snaps"], "fracs": ["snaps"],
}


def sql(body: str, *views: str, **more: str) -> str:
    """An oracle query: the named views and what they need, then further ones, then the body."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in views:
        add(name)
    listed = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({text})" for n, text in more.items()]
    return ("WITH " + ",\n".join(listed) + "\n" if listed else "") + body
