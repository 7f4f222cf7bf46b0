"""Snapshots under another session zone, and events with missing values, against the same SQL."""

import os

import duckdb
import pytest

from footfall.plans.registry import ORACLE_SQL, QUERIES
from tests.compare import same

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def elsewhere(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("name", ["read_snapshot_files", "snapshot_occupancy", "one_row_per_snapshot", "attach_velocity", "direction"])
def test_session_zone_plays_no_part(elsewhere, name):
    same(QUERIES[name], ORACLE_SQL[name], elsewhere, FOLDER)


@pytest.fixture(scope="module")
def holed(tmp_path_factory):
    """The events, each column null now and then."""
    folder = tmp_path_factory.mktemp("holed")
    for name in os.listdir(FOLDER):
        if name != "events.parquet":
            os.symlink(f"{FOLDER}/{name}", folder / name)
    # many in few hours, so that some have a person more than once
    hole = lambda c, n, value=None: f"case when event_id % {n} = 0 then null else {value or c} end as {c}"
    columns = ", ".join([hole("event_id", 7), hole("ts", 11, "date_trunc('day', ts)"), hole("user_id", 23), hole("event_type", 5), hole("value", 13), hole("props", 17)])
    duckdb.connect().execute(f"copy (select {columns} from '{FOLDER}/events.parquet') to '{folder}/events.parquet' (format parquet)")
    return str(folder)


def chosen(name, columns, spark, folder):
    """Whole columns only: a person's rows that all lack seq are alike to the SQL, so they are left out."""
    same(lambda s, d: QUERIES[name](s, d).where("seq is not null").selectExpr(*columns), f"select {', '.join(columns)} from ({ORACLE_SQL[name]}) where seq is not null", spark, folder)


def test_first_rows_without_seq(spark, holed):
    chosen("dedup_first", ["seq"], spark, holed)


def test_snapshot_without_time(spark, holed):
    columns = ["coalesce(t, -1) as t", "standing", "walking"]
    same(lambda s, d: QUERIES["split_standing"](s, d).selectExpr(*columns), f"select {', '.join(columns)} from ({ORACLE_SQL['split_standing']})", spark, holed)


def test_points_without_place(spark, holed):
    chosen("to_patterns", ["pattern_index", "seq"], spark, holed)
