"""Changes between snapshots, their application, and views kept up to date by them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """op (insert, update, delete), key, before, after and the changed columns; nulls compare equal."""
    cols = [c for c in new.columns if c != key]
    a, b = old.select(key, F.struct(*old.columns).alias("before")), new.select(key, F.struct(*new.columns).alias("after"))
    both = a.join(b, key, "full_outer")
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").when(~F.col("before").eqNullSafe(F.col("after")), "update")
    changed = F.filter(F.array(*[F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), F.lit(c)) for c in cols]), lambda x: x.isNotNull())
    return both.withColumn("op", op).where("op is not null").withColumn("changed", F.when(F.col("op") == "update", changed)).select("op", key, "before", "after", "changed")


def since(log: DataFrame, seq: int) -> DataFrame:
    return log.where(F.col("seq") > seq)


def latest(log: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("seq"))
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def apply(target: DataFrame, log: DataFrame, key: str, resolve: str = "source") -> DataFrame:
    """target after the log (op, key, after, seq). resolve: `source` takes the change, `target` keeps rows that exist."""
    if resolve not in ("source", "target"):
        raise ValueError(f"unknown resolution {resolve}")
    last = latest(log, key)
    rows = last.where("op <> 'delete'").select("after.*")
    if resolve == "target":
        return target.join(last.where("op = 'delete'").select(key), key, "left_anti").unionByName(rows.join(target.select(key), key, "left_anti"))
    return target.join(last.select(key), key, "left_anti").select(*target.columns).unionByName(rows.select(*target.columns))


def refresh_keys(view: DataFrame, base: DataFrame, changed: DataFrame, keys: list[str], aggs: list) -> DataFrame:
    """A grouped view after changes: only the groups that changed are computed anew."""
    touched = changed.select(*keys).distinct()
    fresh = base.join(touched, keys, "left_semi").groupBy(*keys).agg(*aggs)
    return view.join(touched, keys, "left_anti").unionByName(fresh)


class MaterialisedViews:
    """Named queries over versioned tables: refreshed in full or by keys, with their state; equal texts are answered by the view."""

    def __init__(self, spark, folder: str):
        from loomwork.sources.versioned import VersionedTable

        self.spark, self.folder, self._table, self.views = spark, folder, VersionedTable, {}

    def create(self, name: str, query: str, strategy: str = "on_demand") -> None:
        if strategy not in ("immediate", "on_demand", "periodic", "incremental", "deferred"):
            raise ValueError(f"unknown strategy {strategy}")
        self.views[name] = {"query": query, "strategy": strategy, "state": "stale", "table": self._table(self.spark, f"{self.folder}/{name}")}
        if strategy == "immediate":
            self.refresh(name)

    def refresh(self, name: str) -> None:
        v = self.views[name]
        v["table"].write(self.spark.sql(v["query"]), "overwrite")
        v["state"] = "fresh"

    def apply_delta(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Puts rows in place of those with the same keys."""
        now = self.views[name]["table"].read()
        self.views[name]["table"].write(now.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows), "overwrite")

    def invalidate(self, name: str) -> None:
        self.views[name]["state"] = "stale"
        if self.views[name]["strategy"] == "immediate":
            self.refresh(name)

    def query(self, name: str) -> DataFrame:
        if self.views[name]["state"] == "stale" and self.views[name]["strategy"] != "deferred":
            self.refresh(name)
        return self.views[name]["table"].read()

    def rewrite(self, query: str) -> DataFrame:
        plain = lambda q: " ".join(q.lower().split())
        for name, v in self.views.items():
            if plain(v["query"]) == plain(query) and v["state"] == "fresh":
                return v["table"].read()
        return self.spark.sql(query)

    def drop(self, name: str) -> None:
        del self.views[name]


def replicate(changes: DataFrame, table, key: str, checkpoint: str) -> None:
    """A stream of changes (op, key, after, seq) into a versioned table, batch by batch, until what there is now is applied."""

    def batch(df, _):
        target = table.read() if table.exists() else df.where("false").select("after.*")
        table.write(apply(target, df, key), "overwrite")

    changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def concat_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
