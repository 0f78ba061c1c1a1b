"""Aggregates by name, and fold-style ones as grouped Pandas functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Aggregators:
    """name -> function of a column; built-ins keep partial aggregation."""

    def __init__(self) -> None:
        self._known: dict[str, Callable[[Column], Column]] = {
            "count": F.count, "sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "first": F.first, "last": F.last,
            "count_distinct": F.countDistinct, "approx_count_distinct": F.approx_count_distinct, "stddev": F.stddev, "variance": F.variance,
            "collect_list": lambda c: F.sort_array(F.collect_list(c)), "collect_set": lambda c: F.sort_array(F.collect_set(c)),
        }

    def register(self, name: str, make: Callable[[Column], Column]) -> None:
        self._known[name] = make

    def get(self, name: str) -> Callable[[Column], Column]:
        if name not in self._known:
            raise KeyError(f"unknown aggregate {name}")
        return self._known[name]

    def create(self, name: str, column: str | Column, alias: str | None = None) -> Column:
        got = self.get(name)(F.col(column) if isinstance(column, str) else column)
        return got.alias(alias) if alias else got

    def names(self) -> list[str]:
        return sorted(self._known)


def fold(init, step: Callable, finish: Callable = lambda a: a, kind: str = "double"):
    """An aggregate from a Python fold over a group's non-null values."""
    def run(values):
        acc = init
        for v in values.dropna():
            acc = step(acc, v)
        return finish(acc)

    return F.pandas_udf(run, kind, F.PandasUDFType.GROUPED_AGG)


def reduce_column(df, column: str, merge: Callable[[Column, Column], Column], zero: Column, parts: int = 64):
    """A tree reduction by an associative expression: within parts first, then over their results."""
    salted = df.select(F.col(column).alias("v")).withColumn("p", F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
    once = salted.groupBy("p").agg(F.aggregate(F.collect_list("v"), zero, merge).alias("v"))
    return once.agg(F.aggregate(F.collect_list("v"), zero, merge).alias(column))
