"""Registering queries beside their SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def register(queries: dict[str, Query], oracles: dict[str, str], oracle: str | None = None) -> Callable[[Query], Query]:
    """Decorator: the function's name is the query's; oracle is its SQL."""

    def add(query: Query) -> Query:
        queries[query.__name__] = query
        if oracle:
            oracles[query.__name__] = oracle
        return query

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that both engines print the same value; no negative zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def work_path(spark: SparkSession, tag: str) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, or a temporary one on a single machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/footfall-{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written to a new shared folder and read back: lineage ends there."""
    path = work_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
