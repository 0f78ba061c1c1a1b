"""Placing rows: reproducible hashes, ranges and buckets, and what skew they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def md5_bucket(key: Column, n: int) -> Column:
    """The first 15 hex digits of the key's MD5 as a number, modulo n: the same on every engine."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(n))


def by_hash(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.repartition(n, *keys)


def by_range(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.repartitionByRange(n, *keys)


def round_robin(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n)


def slices(df: DataFrame, n: int, group: str, *order: str) -> DataFrame:
    """Equal slices of each group's order."""
    return df.withColumn("slice", F.ntile(n).over(Window.partitionBy(group).orderBy(*order)))


def score_bucket(score: Column, low: float, high: float, n: int) -> Column:
    return F.width_bucket(score, F.lit(low), F.lit(high), F.lit(n))


def skewed_keys(df: DataFrame, key: str, factor: float) -> DataFrame:
    """Keys with over `factor` times the mean rows of a key."""
    per = df.groupBy(key).agg(F.count("*").alias("rows"))
    mean = per.agg(F.avg("rows").alias("mean_rows"))
    return per.join(F.broadcast(mean)).where(F.col("rows") > factor * F.col("mean_rows"))  # one row is broadcast


def salted_sum(df: DataFrame, key: str, value: str, salts: int = 16) -> DataFrame:
    """A sum by key whose hot keys are first summed by a salt."""
    s = df.withColumn("_s", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    return s.groupBy(key, "_s").agg(F.sum(value).alias("v")).groupBy(key).agg(F.sum("v").alias(f"sum_{value}"))


def placement(log: DataFrame, item: str, place: str, share: float = 0.5) -> DataFrame:
    """Where an item is read most: `move` if over `share` of its reads come from one place, else `replicate`."""
    per = log.groupBy(item, place).agg(F.count("*").alias("reads"))
    best = per.groupBy(item).agg(F.max_by(place, F.struct("reads", place)).alias("place"), F.max("reads").alias("most"), F.sum("reads").alias("reads"))
    return best.select(item, "place", "reads", F.when(F.col("most") > share * F.col("reads"), "move").otherwise("replicate").alias("advice"))
