"""Kafka and relational databases through Spark's own formats; their jars must be on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: str | None = None, starting: str = "earliest", per_trigger: int = 1_000_000) -> DataFrame:
    df = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).option("maxOffsetsPerTrigger", per_trigger).load()
    df = df.select(F.col("key").cast("string"), F.col("value").cast("string"), "timestamp", "partition", "offset")
    return df.select("*", F.from_json("value", schema).alias("data")) if schema else df


def to_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str, key: str | None = None):
    k = F.col(key).cast("string") if key else F.lit(None).cast("string")
    return df.select(k.alias("key"), F.to_json(F.struct(*df.columns)).alias("value")).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def jdbc_table(spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 8, **options) -> DataFrame:
    """A table, read in parts of a numeric column's range if one is given."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column:
        r = r.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return r.load()


def to_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options) -> None:
    df.write.format("jdbc").mode(mode).option("url", url).option("dbtable", table).options(**options).save()
