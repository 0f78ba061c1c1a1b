"""Frames kept by name, with tags to drop them by."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame


class Cache:
    """At most `most` frames; the one used least, and of those the oldest, goes first."""

    def __init__(self, most: int = 32, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        self.most, self.level, self._kept, self._tick = most, level, {}, 0

    def get(self, name: str, make, tags: tuple[str, ...] = ()) -> DataFrame:
        self._tick += 1
        if name not in self._kept:
            while len(self._kept) >= self.most:
                self.drop(min(self._kept, key=lambda n: (self._kept[n]["uses"], self._kept[n]["at"])))
            self._kept[name] = {"df": make().persist(self.level), "tags": set(tags), "uses": 0, "at": self._tick}
        self._kept[name]["uses"] += 1
        return self._kept[name]["df"]

    def drop(self, name: str) -> None:
        self._kept.pop(name)["df"].unpersist()

    def invalidate(self, tag: str) -> list[str]:
        gone = [n for n, k in self._kept.items() if tag in k["tags"]]
        for n in gone:
            self.drop(n)
        return gone

    def names(self) -> list[str]:
        return sorted(self._kept)
