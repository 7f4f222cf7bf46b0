"""Parquet and CSV in and out. Schemas are explicit; column names are parameters where inputs differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import cells_to_physical, physical_to_cell_id

SNAPSHOTS = "time_ms long, object_identifier long, x_position_mm double, y_position_mm double, occupancy int, frac_standing double, stand_or_walk int, x_vel_SG double, y_vel_SG double"
GRID = "grid_index int, x double, y double, x_rounded int, y_rounded int"
PATTERNS = "pattern_id long, x double, y double"
MODEL_PATTERNS = "pattern_id long, cell_id int, x double, y double"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_snapshots(spark: SparkSession, path: str, schema: str = SNAPSHOTS) -> DataFrame:
    """Snapshot points; columns that the files lack are null."""
    return spark.read.schema(schema).parquet(path)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GRID).parquet(path)


def _by_header(spark: SparkSession, path: str) -> DataFrame:
    """(pattern_id, cell_id, x, y, has_cell) of CSV files whose columns each file's own header names, in any order. Quotes,
    a byte order mark and blank lines are passed over; a file without a header is an error."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    fields = F.transform(F.split("value", ","), lambda v: F.trim(F.regexp_replace(v, "[\\ufeff\"]", "")))
    lines = lines.select("file", fields.alias("fields"))
    header = F.exists("fields", lambda v: F.lower(v) == "pattern_id")
    heads = lines.where(header).groupBy("file").agg(F.first(F.transform("fields", F.lower)).alias("names"))  # a row for each file
    rows = lines.where(~header).join(heads, "file", "left")
    names = F.when(F.col("names").isNull(), F.raise_error(F.concat(F.lit("no header in "), "file"))).otherwise(F.col("names"))
    named = rows.select("fields", names.alias("names"))
    field = lambda n: F.get("fields", F.array_position("names", F.lit(n)).cast("int") - 1)
    return named.select(field("pattern_id").cast("long").alias("pattern_id"), field("cell_id").cast("int").alias("cell_id"), field("x").cast("double").alias("x"), field("y").cast("double").alias("y"), F.array_contains("names", F.lit("cell_id")).alias("has_cell"))


def read_patterns_csv(spark: SparkSession, path: str, with_cell: bool | None = None, ncols: int = 160, nrows: int = 26, **axes: float) -> DataFrame:
    """(pattern_id, cell_id), distinct: one point for each occupied cell. Where a file has no cell_id, it is the cell of the
    grid nearest to x, y. with_cell tells whether all files have it; without it each file's own header does."""
    derived = physical_to_cell_id(F.col("x"), F.col("y"), ncols, nrows, **axes)
    if with_cell is None:
        df = _by_header(spark, path).withColumn("cell_id", F.when(F.col("has_cell"), F.col("cell_id")).otherwise(derived))
    else:
        df = spark.read.schema(MODEL_PATTERNS if with_cell else PATTERNS).csv(path, header=True)
        df = df if with_cell else df.withColumn("cell_id", derived)
    return df.select("pattern_id", "cell_id").distinct()


def write_patterns(samples: DataFrame, grid: DataFrame, path: str, form: str = "csv") -> None:
    """One row per point: pattern_id, cell_id and the cell's centre x, y. A cell that is not on the grid is an error."""
    out = cells_to_physical(samples.select("pattern_id", "cell_id"), grid, "cell_id").select("pattern_id", "cell_id", "x", "y")
    if form == "csv":
        out.write.mode("overwrite").csv(path, header=True)
    else:
        out.write.mode("overwrite").parquet(path)


def write_raster(raster: DataFrame, path: str) -> None:
    raster.write.mode("overwrite").parquet(path)


def write_metrics(metrics: dict[str, DataFrame], path: str, reuse: bool = True) -> dict[str, DataFrame]:
    """One folder per metric; those stored already are read, not computed again."""
    out = {}
    for name, df in metrics.items():
        spark, target = df.sparkSession, f"{path}/{name}"
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        done = jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
        if not (reuse and done.getFileSystem(conf).exists(done)):
            df.write.mode("overwrite").parquet(target)
        out[name] = spark.read.parquet(target)
    return out
