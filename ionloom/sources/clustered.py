"""A table laid out by the ranges of one column, of which a query for windows reads few files.

Below path: rows, whose files follow each other in the column (a value that many rows share is split by a second column), and bounds, with each file's
least and largest value and number of rows. Windows are merged and set against the bounds; only files that meet one are opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bandjoin


def write_clustered(df: DataFrame, path: str, column: str, key: str, files: int) -> None:
    """Overwrite path with df in about so many files by range of column, then key. Rows without a value go last of all files' order and into bounds as such."""
    order = [F.col(column).asc_nulls_last(), F.col(key).asc_nulls_last()]
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/rows")
    rows = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows").select(F.col("_metadata.file_path").alias("file"), F.col(column).alias("v"))
    rows.groupBy("file").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/bounds")


def files_of(spark: SparkSession, path: str, windows: DataFrame) -> tuple[list[str], int]:
    """The files that meet one of the windows (lo, hi), ends included, and the number of all files."""
    bounds = spark.read.parquet(f"{path}/bounds")
    merged = bandjoin.union_intervals(windows, "lo", "hi").select(F.col("lo").alias("from"), F.col("hi").alias("to"))
    # a row for each file; the windows stay where they are
    met = merged.join(F.broadcast(bounds), (F.col("lo") <= F.col("to")) & (F.col("hi") >= F.col("from"))).select("file").distinct()
    return sorted(r.file for r in met.collect()), bounds.count()


def read_windows(spark: SparkSession, path: str, column: str, windows: DataFrame, width: float) -> tuple[DataFrame, float]:
    """The rows of path whose value lies in one of the windows, and the share of files that are read for them. width sizes the buckets of the join with windows."""
    files, every = files_of(spark, path, windows)
    rows = spark.read.parquet(f"{path}/rows")
    if not files:
        return rows.limit(0), 0.0
    rows = spark.read.schema(rows.schema).parquet(*files)
    return bandjoin.in_intervals(rows, bandjoin.union_intervals(windows, "lo", "hi"), column, width), len(files) / every
