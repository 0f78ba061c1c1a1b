"""Scores and reports for finance, retail, manufacturing and health data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.relational import tasks


def fraud_scores(df: DataFrame, user: str, order: list[str], amount: str, location: str, risky: Column, sensitivity: float = 0.7) -> DataFrame:
    """In each user's order: 0.3 above three times the mean so far, 0.2 for a new location, 0.1 with a history, 0.4 for a risky merchant."""
    w = Window.partitionBy(user).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    mean = F.coalesce(F.avg(amount).over(before), F.col(amount))
    new = F.row_number().over(Window.partitionBy(user, location).orderBy(*order)) == 1
    seen = F.row_number().over(w) > 1
    part = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0))
    tenths = part(F.col(amount) > 3 * mean, 3) + part(new, 2) + part(seen, 1) + part(risky, 4)
    level = F.when(F.col("tenths") < 3, "low").when(F.col("tenths") < 5, "medium").when(F.col("tenths") < 7, "high").otherwise("critical")
    return df.withColumn("tenths", tenths).withColumns({"score": F.col("tenths") / 10, "level": level, "review": F.col("tenths") / 10 >= sensitivity}).drop("tenths")


def portfolio_risk(df: DataFrame, by: str, rating: str, volatility: str, liquidity: str, market: float = 0.5) -> DataFrame:
    return df.groupBy(by).agg(F.avg(F.coalesce(rating, F.lit(0.5))).alias("credit_risk"), F.avg(F.coalesce(volatility, F.lit(0.2))).alias("volatility_risk"), F.lit(market).alias("market_risk"), F.avg(1 - F.coalesce(liquidity, F.lit(0.5))).alias("liquidity_risk"))


def customer_360(customers: DataFrame, purchases: DataFrame, key: str, amount: str, order: list[Column], item: str, last: int = 5) -> DataFrame:
    """Lifetime value, purchases and the latest ones (newest first) beside each customer."""
    total = purchases.groupBy(key).agg(F.sum(amount).alias("lifetime_value"), F.count("*").alias("n_purchases"))
    w = Window.partitionBy(key).orderBy(*order)
    recent = purchases.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_n", item))).alias("r")).select(key, F.transform("r", lambda x: x[item]).alias("recent"))
    return customers.join(total, key, "left").join(recent, key, "left").withColumns({"lifetime_value": F.coalesce("lifetime_value", F.lit(0.0)), "n_purchases": F.coalesce("n_purchases", F.lit(0))})


def demand_forecast(df: DataFrame, product: str, day: str, quantity: str, horizon: int = 7) -> DataFrame:
    """Daily sums; mean of the last 30 days with the trend of their halves (if 7 or more) carried on; whole numbers, not below 0; from 3 days on."""
    daily = df.groupBy(product, day).agg(F.sum(quantity).alias("q"))
    w = Window.partitionBy(product)
    last = daily.withColumn("r", F.row_number().over(w.orderBy(F.desc(day)))).where("r <= 30").withColumn("n", F.count("*").over(w))
    half = F.floor(F.col("n") / 2)
    agg = last.groupBy(product, "n").agg(F.avg("q").alias("mean"), F.avg(F.when(F.col("r") > F.col("n") - half, F.col("q"))).alias("a"), F.avg(F.when(F.col("r") <= F.col("n") - half, F.col("q"))).alias("b"))
    slope = F.when(F.col("n") >= 7, (F.col("b") - F.col("a")) / F.col("n")).otherwise(F.lit(0.0))
    days = agg.where("n >= 3").withColumn("slope", slope).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return days.select(product, "step", F.greatest(F.floor(F.col("mean") + F.col("slope") * F.col("step")), F.lit(0)).cast("long").alias("forecast"))


def item_similarity(df: DataFrame, user: str, item: str) -> DataFrame:
    """Jaccard similarity of the sets of users of each two items that share one. Items must be few beside users' rows."""
    pairs = df.select(user, item).distinct()
    n = pairs.groupBy(item).agg(F.count("*").alias("n"))
    baskets = pairs.groupBy(user).agg(F.sort_array(F.collect_set(item)).alias("s"))
    both = baskets.select(F.posexplode("s").alias("p", "a"), "s").select("a", F.explode(F.slice("s", F.col("p") + 2, F.size("s"))).alias("b"))
    co = both.groupBy("a", "b").agg(F.count("*").alias("co"))
    na, nb = n.select(F.col(item).alias("a"), F.col("n").alias("na")), n.select(F.col(item).alias("b"), F.col("n").alias("nb"))
    return co.join(na, "a").join(nb, "b").select("a", "b", "co", (F.col("co") / (F.col("na") + F.col("nb") - F.col("co"))).alias("similarity"))


def recommend(df: DataFrame, user: str, item: str, n: int = 5, few: bool = False) -> DataFrame:
    """The n items not yet had whose similarities to the user's own sum up highest, ties to the smaller item.

    Rows are dealt by user once. With `few` (the caller knows that there are some thousand items at most) the similarities go to all
    tasks, and sums and ranks need no further shuffle; otherwise each item of each user is shuffled to its similar ones.
    """
    rows = df.select(user, item)
    if few:
        rows = rows.repartition(tasks(rows), user)
    s = item_similarity(rows, user, item).select("a", "b", "similarity")
    # an item is next to itself with no similarity, which tells apart what a user has
    pairs = s.select(F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b"), (F.col("similarity") if x != y else F.lit(None)).alias("similarity")) for x, y in ("ab", "ba", "aa", "bb")])).alias("p")).select("p.*").distinct()
    pairs = pairs.withColumnRenamed("a", item)
    sums = rows.distinct().join(F.broadcast(pairs) if few else pairs, item).groupBy(user, "b").agg(F.sum("similarity").alias("score"), F.count_if(F.col("similarity").isNull()).alias("_had")).withColumnRenamed("b", item)
    new = sums.where(F.col("score").isNotNull() & ((F.col("_had") == 0) | F.col(user).isNull())).drop("_had")
    w = Window.partitionBy(user).orderBy(F.desc(F.round("score", 9)), item)
    return new.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def sensor_anomalies(df: DataFrame, limits: DataFrame, kind: str, value: str) -> DataFrame:
    """limits(kind, low, high); severity is high more than 50 from the upper limit."""
    got = df.join(F.broadcast(limits), kind)  # a row for each kind of sensor
    return got.where((F.col(value) < F.col("low")) | (F.col(value) > F.col("high"))).withColumn("severity", F.when(F.abs(F.col(value) - F.col("high")) > 50, "high").otherwise("medium"))


def failure_risk(df: DataFrame, machine: str, hours: str, life: float, vibration: str, temperature: str) -> DataFrame:
    usage = F.least(F.max(hours) / life, F.lit(1.0))
    wear = F.when(F.max(vibration) > 50, 0.2).otherwise(0.0) + F.when(F.max(temperature) > 80, 0.3).otherwise(0.0)
    risk = df.groupBy(machine).agg((0.7 * usage + 0.3 * wear).alias("risk"))
    return risk.withColumn("status", F.when(F.col("risk") >= 0.7, "critical").when(F.col("risk") >= 0.4, "warning").otherwise("healthy"))


def defect_rates(df: DataFrame, batch: str, defect: Column, limit: float = 0.05) -> DataFrame:
    got = df.groupBy(batch).agg(F.count("*").alias("units"), F.count_if(defect).alias("defects"))
    return got.withColumn("rate", F.col("defects") / F.col("units")).withColumn("passed", F.col("rate") <= limit)


def pareto(df: DataFrame, cause: str) -> DataFrame:
    """Counts by cause, largest first, with shares summed up. There are few causes, so one window orders them."""
    per = df.groupBy(cause).agg(F.count("*").alias("defects"))
    w = Window.orderBy(F.desc("defects"), cause)
    return per.withColumns({"rank": F.row_number().over(w), "running": F.sum("defects").over(w.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("defects").over(Window.partitionBy())}).select(cause, "defects", "rank", (F.col("running") / F.col("total")).alias("share"))


def anonymise(x: Column) -> Column:
    return F.substring(F.sha2(x.cast("string").cast("binary"), 256), 1, 16)


def k_number(x: Column, k: int) -> Column:
    return F.floor(x / k) * k


def k_text(x: Column, keep: int = 2) -> Column:
    return F.rpad(F.substring(x, 1, keep), F.greatest(F.length(x), F.lit(keep)), "*")


def noisy(x: Column, sensitivity: float, epsilon: float, seed: int) -> Column:
    """Laplace noise by the inverse of its distribution function."""
    u = F.rand(seed) - 0.5
    return x - F.lit(sensitivity / epsilon) * F.signum(u) * F.log(1 - 2 * F.abs(u))


def encrypt(x: Column, key: Column) -> Column:
    return F.base64(F.aes_encrypt(x.cast("binary"), key))


def decrypt(x: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(x), key).cast("string")


def residency(df: DataFrame, region: str, allowed: dict[str, list[str]], tenant: str) -> DataFrame:
    """Rows with `compliant`: whether the tenant may hold data of that region."""
    rule = F.create_map(*[x for t, r in allowed.items() for x in (F.lit(t), F.array(*map(F.lit, r)))])
    return df.withColumn("compliant", F.coalesce(F.array_contains(F.try_element_at(rule, F.col(tenant)), F.col(region)), F.lit(False)))


def audit(df: DataFrame, **want) -> DataFrame:
    """Events that have all of the given values; None leaves a column free."""
    for c, v in want.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    return df
