"""The registered query where a source's profile has its peak at an end, or does not reach the ends."""

import os

import duckdb
import pytest

from footfall.plans.registry import ORACLE_SQL, QUERIES
from tests.compare import same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("value", ["event_id % 3", "event_id % 3 + 50", "30 + event_id % 60"])
def test_best_interior(spark, tmp_path, value):
    for name in os.listdir(FOLDER):
        if name != "events.parquet":
            os.symlink(f"{FOLDER}/{name}", tmp_path / name)
    columns = f"* replace (case when (user_id // 4) % 2 = 0 then ({value})::DOUBLE else value end as value)"
    duckdb.connect().execute(f"copy (select {columns} from '{FOLDER}/events.parquet') to '{tmp_path}/events.parquet' (format parquet)")
    same(QUERIES["best_interior"], ORACLE_SQL["best_interior"], spark, str(tmp_path))
