"""Joins, sets and row selection with the semantics callers ask for by name."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "outer", "full": "outer", "semi": "left_semi", "left_semi": "left_semi", "anti": "left_anti", "left_anti": "left_anti"}
#: Estimated bytes under which a side may be broadcast.
SMALL = 10 << 20


def join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Equi-join on columns of the same name; of other shared columns the left one stays. Null keys match only if null_safe.

    With null_safe, rows whose keys are all null meet each with each, dealt evenly over the tasks: as one key they'd
    be one task's work. Their sides are read again for that.
    """
    if how not in HOW:
        raise ValueError(f"unknown join type {how}")
    keys = [on] if isinstance(on, str) else list(on)
    shared = [c for c in right.columns if c in left.columns and c not in keys]
    right = right.drop(*shared)
    if not null_safe:
        return left.join(right, keys, HOW[how])
    kind, theirs = HOW[how], {k: f"_r_{k}" for k in keys}
    named = right.withColumnsRenamed(theirs)
    none = lambda names: reduce(lambda a, b: a & b, [F.col(c).isNull() for c in names])
    a, b = left.where(~none(keys)), named.where(~none(theirs.values()))
    same = (lambda x, y: x == y) if len(keys) == 1 else (lambda x, y: x.eqNullSafe(y))
    met = a.join(b, reduce(lambda x, y: x & y, [same(a[k], b[r]) for k, r in theirs.items()]), kind)
    if kind in ("right", "outer"):
        met = met.withColumns({k: F.coalesce(k, r) for k, r in theirs.items()})
    met = met.drop(*theirs.values())
    a, b = left.where(none(keys)), right.where(none(keys))
    any_of = lambda df: df.select(F.lit(1).alias("_any")).limit(1)
    if kind in ("left_semi", "left_anti"):
        return met.union(a.join(any_of(b), F.lit(True), kind))
    n = tasks(left)  # for both sides: which one is sent to all tasks, if any, is known at run time
    met = met.union(a.repartition(n).crossJoin(b.drop(*keys).repartition(n)))
    if kind in ("left", "outer"):
        met = met.unionByName(a.join(any_of(b), F.lit(True), "left_anti"), allowMissingColumns=True)
    if kind in ("right", "outer"):
        met = met.unionByName(b.join(any_of(a), F.lit(True), "left_anti"), allowMissingColumns=True)
    return met


def tasks(df: DataFrame) -> int:
    """Parts for work that is large beside its input, so adaptive execution must not merge them by bytes."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def strategy(left: DataFrame, right: DataFrame, rows: int | None = None) -> str:
    """What a planner with size estimates alone would take; Catalyst and adaptive execution decide for real."""
    if min(estimated_bytes(left), estimated_bytes(right)) <= SMALL:
        return "broadcast_hash"
    return "sort_merge" if rows is None or rows > 1_000_000 else "shuffle_hash"


def prefixed_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """All columns of both sides, named left_* and right_*."""
    a, b = left.withColumnsRenamed({c: f"left_{c}" for c in left.columns}), right.withColumnsRenamed({c: f"right_{c}" for c in right.columns})
    return a.join(b, a[f"left_{left_key}"] == b[f"right_{right_key}"], HOW[how])


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of left whose `point` lies in [low, high) of a row of right; cells of `width` make it an equi-join."""
    cell = lambda c: F.floor(c / F.lit(width)).cast("long")
    b = right.withColumn("_cell", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))))
    a = left.withColumn("_cell", cell(F.col(point)))
    return a.join(b, "_cell").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_cell")


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, values: Sequence[str]) -> DataFrame:
    """For each left row the latest right row of its key at or before it: one sort of both sides by key and time."""
    both = left.withColumn("_side", F.lit(1)).unionByName(right.select(by, at, F.struct(*values).alias("_v")).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return got.select(*left.columns, *[F.col("_v")[v].alias(f"asof_{v}") for v in values])


def union_by_name(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def drop_duplicates_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Of rows with the same keys, the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(k)


#: Rows up to which skip() finds the first ones by heaps; beyond, one task sorts all rows.
SKIP = 1_000_000


def skip(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows in ascending order of the columns `keys` but for the first n; of rows tied at the cut, any.

    Spark's own offset sends all rows through one task. Here the row at the cut is found by heaps of n rows, and what lies beyond
    it is sorted in parts; only rows up to the cut are compared as wholes.
    """
    if not 0 < n <= SKIP:
        return df.orderBy(*keys).offset(n)
    first, at = df.orderBy(*keys).limit(n), F.struct(*keys)
    cut = F.broadcast(first.agg(F.max(at).alias("_cut")))  # one row
    beyond = df.join(cut, at > F.col("_cut")).drop("_cut")
    rest = df.join(cut, at <= F.col("_cut")).drop("_cut").exceptAll(first)
    return beyond.union(rest).orderBy(*keys)


def top_k_of_each(df: DataFrame, keys: Sequence[str], k: int, *order: Column | str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A row for each numeric column: count, mean, population deviation, least and greatest value, in one pass."""
    kinds = dict(df.dtypes)
    cols = list(columns or [c for c, t in kinds.items() if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")])
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    one = df.agg(*[F.struct(*[f(F.col(c).cast("double")).cast("long" if s == "count" else "double").alias(s) for s, f in stats.items()]).alias(c) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("s")) for c in cols])).alias("x")).select("x.column", "x.s.*")


def group_by_key(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("values"))


def flat_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """Rows that fn(dict) yields for each row, in Arrow batches."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [x for r in b.to_dict("records") for x in fn(r)]
            if rows:
                yield pd.DataFrame(rows)

    return df.mapInPandas(run, schema)
