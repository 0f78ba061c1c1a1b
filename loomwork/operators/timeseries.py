"""Load profiles, trends, health and cost figures over time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hourly_profile(df: DataFrame, ts: str) -> DataFrame:
    """hour 0 to 23 and the mean rows of that hour over the days that have any; hours without rows are 0."""
    per = df.groupBy(F.to_date(ts).alias("d"), F.hour(ts).alias("hour")).agg(F.count("*").alias("n")).groupBy("hour").agg(F.avg("n").alias("mean_rows"))
    return df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour")).join(per, "hour", "left").select("hour", F.coalesce("mean_rows", F.lit(0.0)).alias("mean_rows"))


def peaks(profile: DataFrame, high: float = 1.3, low: float = 0.7) -> DataFrame:
    """Hours above or below these shares of the mean of all 24."""
    mean = F.avg("mean_rows").over(Window.partitionBy())  # 24 rows
    got = profile.withColumn("all", mean)
    return got.withColumn("kind", F.when(F.col("mean_rows") > high * F.col("all"), "peak").when(F.col("mean_rows") < low * F.col("all"), "low")).where("kind is not null").select("hour", "kind")


def periodicity(profile: DataFrame, above: float = 0.3) -> DataFrame:
    return profile.agg((F.stddev_samp("mean_rows") / F.avg("mean_rows")).alias("variation")).withColumn("periodic", F.col("variation") > above)


def quarter_trend(df: DataFrame, series: str, order: list[str], value: str, least: int = 100) -> DataFrame:
    """(mean of the last quarter - of the first) / first; 0 for short series."""
    w = Window.partitionBy(series)
    got = df.withColumns({"_r": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)})
    q = F.floor(F.col("_n") / 4)
    means = got.groupBy(series, "_n").agg(F.avg(F.when(F.col("_r") <= q, F.col(value))).alias("a"), F.avg(F.when(F.col("_r") > F.col("_n") - q, F.col(value))).alias("b"))
    return means.select(series, F.col("_n").alias("n"), F.when(F.col("_n") < least, 0.0).otherwise(F.try_divide(F.col("b") - F.col("a"), F.col("a"))).alias("trend"))


def half_trend(df: DataFrame, series: str, order: list[str], value: str, last: int = 20) -> DataFrame:
    """Relative change between the halves of the last rows, with n / last as confidence."""
    w = Window.partitionBy(series)
    got = df.withColumn("_r", F.row_number().over(w.orderBy(*[F.desc(c) for c in order]))).where(F.col("_r") <= last).withColumn("_n", F.count("*").over(w))
    h = F.floor(F.col("_n") / 2)
    a, b = F.avg(F.when(F.col("_r") > F.col("_n") - h, F.col(value))), F.avg(F.when(F.col("_r") <= F.col("_n") - h, F.col(value)))
    return got.groupBy(series, "_n").agg(a.alias("a"), b.alias("b")).select(series, F.try_divide(F.col("b") - F.col("a"), F.col("a")).alias("change"), (F.col("_n") / last).alias("confidence"))


def latest_status(df: DataFrame, metric: str, ts: str, status: str, ranks: list[str]) -> DataFrame:
    """The latest status of each metric, the worst of them (ranks: worst first) and the share that is healthy, in one row."""
    now = df.groupBy(metric).agg(F.max_by(status, ts).alias("status"))
    order = F.create_map(*[x for i, s in enumerate(ranks) for x in (F.lit(s), F.lit(i))])
    return now.agg(F.coalesce(F.min_by("status", order[F.col("status")]), F.lit("HEALTHY")).alias("status"), F.avg((~F.col("status").isin(ranks)).cast("double")).alias("healthy"))


def failure_evidence(df: DataFrame, series: str, order: list[str], value: str, critical: float, least: int = 10) -> DataFrame:
    """0.2 if the last quarter is over 1.5 times the first, 0.15 if the variation is over 0.5, 0.3 if over 30 % of the last 20 are critical; rows above 0.4."""
    w = Window.partitionBy(series)
    got = df.withColumns({"_r": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)}).where(F.col("_n") >= least)
    q = F.greatest(F.floor(F.col("_n") / 4), F.lit(1))
    s = got.groupBy(series, "_n").agg(
        F.avg(F.when(F.col("_r") <= q, F.col(value))).alias("a"), F.avg(F.when(F.col("_r") > F.col("_n") - q, F.col(value))).alias("b"),
        (F.stddev_samp(value) / F.avg(value)).alias("cv"), F.avg(F.when(F.col("_r") > F.col("_n") - 20, (F.col(value) >= critical).cast("double"))).alias("crit"),
    )
    part = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0))
    return s.select(series, ((part(F.col("b") > 1.5 * F.col("a"), 20) + part(F.col("cv") > 0.5, 15) + part(F.col("crit") > 0.3, 30)) / 100).alias("evidence")).where("evidence > 0.4")


def spend(df: DataFrame, by: str, cost: str, use: str, budget: float) -> DataFrame:
    mean = df.groupBy(by).agg(F.avg(cost).alias("_m"))
    got = df.join(mean, by)
    waste = (F.col(use) < 0.3) & (F.col(cost) > 0.5 * F.col("_m"))
    return got.groupBy(by).agg(F.sum(cost).alias("total"), F.avg(cost).alias("mean"), F.count_if(waste).alias("waste_hours")).withColumn("over_budget", F.col("total") > budget)


def waste(df: DataFrame, by: str, use: str) -> DataFrame:
    got = df.groupBy(by).agg(F.avg((F.col(use) < 0.05).cast("double")).alias("idle_share"), F.max(use).alias("most"), F.avg(use).alias("mean"))
    return got.select(by, (F.col("idle_share") > 0.2).alias("idle"), (F.col("most") > 2 * F.col("mean")).alias("overprovisioned"))


def bucket_means(df: DataFrame, keys: list, order: list[str], value: str, last: int = 20, least: int = 3) -> DataFrame:
    """Mean and deviation of the last rows of each bucket that has enough."""
    names = [f"k{i}" for i in range(len(keys))]
    got = df.withColumns(dict(zip(names, keys, strict=True)))
    w = Window.partitionBy(*names).orderBy(*[F.desc(c) for c in order])
    return got.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last).groupBy(*names).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation")).where(F.col("n") >= least)


def histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts up to each bound, in one pass."""
    one = df.agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(float(b)).alias("bound"), F.col(f"b{i}").alias("rows")) for i, b in enumerate(bounds)])).alias("x")).select("x.*")


def weighted_vectors(df: DataFrame, vector: str, weight, by: str | None = None) -> DataFrame:
    """position, value: the weighted mean of vectors by position."""
    x = df.select(*([by] if by else []), weight.alias("w"), F.posexplode(vector).alias("position", "x"))
    return x.groupBy(*([by] if by else []), "position").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w")).alias("value"))


def clip_l2(vector, limit: float):
    """A vector scaled down to a length of at most `limit`."""
    n = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") * F.least(F.lit(1.0), F.try_divide(F.lit(limit), n)))


def last_of_each(df: DataFrame, key: str, n: int, order: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def greedy_schedule(df: DataFrame, link: str, priority: str, size: str, capacity: float) -> DataFrame:
    """By priority, each transfer that still fits its link's capacity; a link's transfers are planned in one worker."""

    def run(pdf):
        left, keep = capacity, []
        pdf = pdf.sort_values([priority, size], ascending=[False, True])
        for s in pdf[size]:
            keep.append(s <= left)
            left -= s if keep[-1] else 0
        return pdf[keep]

    return df.groupBy(link).applyInPandas(run, df.schema)


def load_pattern(df: DataFrame, ts: str, series: str, order: list[str], value: str, least: int = 1440) -> DataFrame:
    """For each series: unknown (few samples), periodic, trending or stable; and the forecast for the next hour from the last 60 values."""
    per_day = df.groupBy(series, F.to_date(ts).alias("d"), F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))
    hours = per_day.groupBy(series, "hour").agg(F.avg("n").alias("m")).groupBy(series).agg(F.sum("m").alias("s"), F.sum(F.col("m") * F.col("m")).alias("ss"))
    mean = F.col("s") / 24  # hours without rows are 0
    cv = hours.select(series, (F.sqrt((F.col("ss") - 24 * mean * mean) / 23) / mean).alias("cv"))
    trend = quarter_trend(df, series, order, value)
    w = Window.partitionBy(series).orderBy(*[F.desc(c) for c in order])
    last = df.withColumn("_r", F.row_number().over(w)).where("_r <= 60").groupBy(series).agg(F.avg(value).alias("recent"))
    got = trend.join(cv, series).join(last, series)
    kind = F.when(F.col("n") < least, "unknown").when(F.col("cv") > 0.3, "periodic").when(F.abs("trend") > 0.1, "trending").otherwise("stable")
    return got.select(series, kind.alias("pattern"), (F.col("recent") * F.when(kind == "trending", 1 + F.col("trend") / 24).otherwise(1.0)).alias("forecast"))
