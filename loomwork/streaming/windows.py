"""Event-time windows, late rows and duplicates; every function takes batch and, unless it says so, streaming frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_time(df: DataFrame, ts: str, delay: str | None = None) -> DataFrame:
    """ts as TIMESTAMP, which watermarks need, with the watermark if a delay is given."""
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, delay) if delay else df


def windowed(df: DataFrame, ts: str, size: str, keys: list[str], aggs: list[Column], slide: str | None = None) -> DataFrame:
    """Tumbling windows, or sliding ones if `slide` is given; window_start and window_end beside keys and aggregates."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return _flat(df.groupBy(w.alias("w"), *keys).agg(*aggs))


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Windows that end after `gap` without a row of the key."""
    return _flat(df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*aggs))


def _flat(df: DataFrame) -> DataFrame:
    return df.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in df.columns if c != "w"])


def with_lateness(df: DataFrame, arrival: str, ts: str, delay: str, within: list[str] | None = None) -> DataFrame:
    """Batch: `watermark` as it stood when each row came (its own time included) and `late`.

    The watermark of a whole stream is one running maximum, so rows are ordered in one place; give `within` to hold a
    watermark for each source instead, which also spreads the work.
    """
    w = Window.partitionBy(*(within or [])).orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.max(ts).over(w) - F.expr(f"INTERVAL {delay}")
    return df.withColumn("watermark", mark).withColumn("late", F.col(ts) < F.col("watermark"))


def late_policy(df: DataFrame, ts: str, policy: str, lateness: str = "0 SECONDS") -> tuple[DataFrame, DataFrame]:
    """Rows kept and rows put aside of a frame from with_lateness: drop, side_output or update."""
    too_late = F.col(ts) < F.col("watermark") - F.expr(f"INTERVAL {lateness}")
    if policy == "drop":
        return df.where(~too_late), df.where("false")
    if policy == "side_output":
        return df.where(~F.col("late")), df.where("late")
    if policy == "update":
        return df, df.where("false")
    raise ValueError(f"unknown policy {policy}")


def exactly_once(df: DataFrame, keys: list[str], arrival: str | None = None) -> DataFrame:
    """One row for each idempotency key: the first to arrive; streams drop repeats within their watermark."""
    if df.isStreaming:
        return df.dropDuplicatesWithinWatermark(keys)
    w = Window.partitionBy(*keys).orderBy(arrival)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def punctuated(df: DataFrame, ts: str, marker: Column, arrival: str, within: list[str]) -> DataFrame:
    """Batch: the watermark that marker rows set, for each source."""
    w = Window.partitionBy(*within).orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("watermark", F.max(F.when(marker, F.col(ts))).over(w))


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append", trigger: dict | None = None):
    """Runs a streaming query over what there is now into Parquet files."""
    q = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    q.awaitTermination()
    return q


def table_stream(spark, folder: str, name: str) -> DataFrame:
    """A Parquet table, one file or a folder of them, as a stream of its files."""
    path = f"{folder}/{name}.parquet"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_folder = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    return r.parquet(path) if is_folder else r.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
