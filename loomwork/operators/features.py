"""Features of entities, model records, and a search for parameters."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class FeatureStore:
    def __init__(self) -> None:
        self.features: dict[str, dict] = {}
        self.groups: dict[str, list[str]] = {}

    def register(self, name: str, values: DataFrame, entity: str, default=None, sources: list[str] | None = None) -> None:
        """values(entity, name), one row for each entity."""
        self.features[name] = {"values": values, "entity": entity, "default": default, "sources": sources or []}

    def group(self, name: str, features: list[str]) -> None:
        self.groups[name] = features

    def vectors(self, entities: DataFrame, group: str) -> DataFrame:
        df = entities
        for n in self.groups[group]:
            f = self.features[n]
            df = df.join(f["values"].select(f["entity"], n), f["entity"], "left")
            if f["default"] is not None:
                df = df.withColumn(n, F.coalesce(n, F.lit(f["default"])))
        return df

    def lineage(self, name: str) -> list[str]:
        return self.features[name]["sources"]


class Models:
    """Runs with parameters and metrics; versions with stages."""

    def __init__(self) -> None:
        self.runs: list[dict] = []
        self.versions: dict[str, list[dict]] = {}

    def log(self, params: dict, metrics: dict) -> int:
        self.runs.append({"params": params, "metrics": metrics, "time": time.time()})
        return len(self.runs) - 1

    def best(self, metric: str, lowest: bool = False) -> dict:
        return (min if lowest else max)((r for r in self.runs if metric in r["metrics"]), key=lambda r: r["metrics"][metric])

    def register(self, name: str, model, run: int | None = None) -> int:
        self.versions.setdefault(name, []).append({"model": model, "run": run, "stage": "none"})
        return len(self.versions[name])

    def promote(self, name: str, version: int, stage: str) -> None:
        for v in self.versions[name]:
            if v["stage"] == stage:
                v["stage"] = "archived"
        self.versions[name][version - 1]["stage"] = stage

    def serve(self, name: str, stage: str = "production"):
        return next(v["model"] for v in self.versions[name] if v["stage"] == stage)


def score_with(df: DataFrame, model: Callable, columns: list[str], kind: str = "double") -> DataFrame:
    """model(frame of columns) -> series, in Arrow batches."""
    f = F.pandas_udf(lambda *s: model(dict(zip(columns, s, strict=True))), kind)
    return df.withColumn("prediction", f(*columns))


def search(space: dict[str, tuple[float, float]], quality: Callable[[dict], float], rounds: int = 20, sources: int = 8, limit: int = 5, seed: int = 0) -> tuple[dict, float]:
    """Bee-colony search for the parameters of greatest quality: near moves, more of them where quality is, new places for stale ones."""
    r = random.Random(seed)
    new = lambda: {k: r.uniform(*b) for k, b in space.items()}
    places = [new() for _ in range(sources)]
    worth, stale = [quality(p) for p in places], [0] * sources
    best = max(zip(worth, places, strict=True), key=lambda x: x[0])
    for _ in range(rounds):
        low = min(worth)
        picks = [*range(sources), *r.choices(range(sources), [w - low + 1e-9 for w in worth], k=sources)]
        for i in picks:
            k, other = r.choice(list(space)), places[r.randrange(sources)]
            lo, hi = space[k]
            tried = places[i] | {k: min(hi, max(lo, places[i][k] + r.uniform(-1, 1) * (places[i][k] - other[k] or (hi - lo) * 0.1)))}
            v = quality(tried)
            if v > worth[i]:
                places[i], worth[i], stale[i] = tried, v, 0
            else:
                stale[i] += 1
            best = max(best, (worth[i], places[i]), key=lambda x: x[0])
        for i in range(sources):
            if stale[i] > limit:
                places[i], stale[i] = new(), 0
                worth[i] = quality(places[i])
    return best[1], best[0]
