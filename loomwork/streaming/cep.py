"""Patterns over event sequences by key.

A pattern is a list of steps; `followed_by` lets other events lie between, `next` doesn't. One partial match starts at every
event that satisfies the first step, and advances at the first event that fits (relaxed) or at each (non-deterministic).
Optional steps may be skipped; `times(n)` asks for n events; `within` counts from the first event.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    name: str
    conditions: tuple = ()
    strict: bool = False
    least: int = 1
    most: int = 1

    def fits(self, row: dict) -> bool:
        return all(c(row) for c in self.conditions)


@dataclass(frozen=True)
class Pattern:
    name: str
    steps: tuple[Step, ...] = ()
    seconds: float | None = None
    forks: bool = False

    @classmethod
    def begin(cls, step: str, name: str = "pattern") -> "Pattern":
        return cls(name, (Step(step),))

    def _last(self, **change) -> "Pattern":
        return replace(self, steps=(*self.steps[:-1], replace(self.steps[-1], **change)))

    def followed_by(self, step: str) -> "Pattern":
        return replace(self, steps=(*self.steps, Step(step)))

    def next(self, step: str) -> "Pattern":
        return replace(self, steps=(*self.steps, Step(step, strict=True)))

    def where(self, condition) -> "Pattern":
        return self._last(conditions=(*self.steps[-1].conditions, condition))

    def times(self, n: int) -> "Pattern":
        return self._last(least=n, most=n)

    def one_or_more(self) -> "Pattern":
        return self._last(least=1, most=1 << 30)

    def optional(self) -> "Pattern":
        return self._last(least=0)

    def within(self, seconds: float) -> "Pattern":
        return replace(self, seconds=seconds)

    def non_deterministic(self) -> "Pattern":
        return replace(self, forks=True)


@dataclass
class Matcher:
    """Partial matches: (step, events taken at it, all events)."""

    pattern: Pattern
    open: list = field(default_factory=list)

    def _advance(self, step: int, taken: int, row: dict):
        """Where this event can lead from a partial match: (step, taken) pairs."""
        steps, out = self.pattern.steps, []
        if step < len(steps) and taken < steps[step].most and steps[step].fits(row):
            out.append((step, taken + 1))
        k, enough = step + 1, taken >= steps[step].least
        while enough and k < len(steps):
            if steps[k].fits(row):
                out.append((k, 1))
            enough = steps[k].least == 0
            k += 1
        return out

    def _complete(self, step: int, taken: int) -> bool:
        return taken >= self.pattern.steps[step].least and all(s.least == 0 for s in self.pattern.steps[step + 1 :])

    def feed(self, row: dict, at: float) -> list[list[dict]]:
        found, kept = [], []
        starts = [(0, 0, [], at)] if self.pattern.steps[0].fits(row) else []
        for step, taken, events, since in [*self.open, *starts]:
            if self.pattern.seconds is not None and at - since > self.pattern.seconds:
                continue
            to = self._advance(step, taken, row)
            nxt = self.pattern.steps[step + 1] if taken >= self.pattern.steps[step].least and step + 1 < len(self.pattern.steps) else None
            if not to:
                if not (nxt and nxt.strict) and not (events and self.pattern.steps[step].strict and taken < self.pattern.steps[step].least):
                    kept.append((step, taken, events, since))
                continue
            for s, t in to[-1:] if not self.pattern.forks else to:
                new = (s, t, [*events, row], since)
                if self._complete(s, t):
                    found.append(new[2])
                else:
                    kept.append(new)
            if self.pattern.forks and events:
                kept.append((step, taken, events, since))
        self.open = kept
        return found


def matches(df: DataFrame, key: str, ts: str, order: str, patterns: list[Pattern], id_col: str) -> DataFrame:
    """key, pattern, first, last, events (ids) of every match; a key's events must fit in one worker."""

    def run(pdf):
        import pandas as pd

        pdf, out = pdf.sort_values([ts, order]), []
        rows = pdf.to_dict("records")
        for p in patterns:
            m = Matcher(p)
            for r in rows:
                for events in m.feed(r, r[ts].timestamp()):
                    out.append((r[key], p.name, events[0][ts], events[-1][ts], [int(e[id_col]) for e in events]))
        return pd.DataFrame(out, columns=[key, "pattern", "first", "last", "events"])

    kind = dict(df.dtypes)
    return df.groupBy(key).applyInPandas(run, f"{key} {kind[key]}, pattern string, first {kind[ts]}, last {kind[ts]}, events array<long>")


def first_followed_by(df: DataFrame, key: str, ts: str, a: Column, b: Column, seconds: int) -> DataFrame:
    """Every row that satisfies a with the time of the first later b within the limit, by one window and no self-join."""
    w = Window.partitionBy(key).orderBy(ts).rowsBetween(1, Window.unboundedFollowing)
    got = df.withColumn("followed_at", F.min(F.when(b, F.col(ts))).over(w)).where(a)
    return got.where(F.col("followed_at").isNotNull() & (F.unix_micros(F.col("followed_at").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp")) <= seconds * 1_000_000))


def next_is(df: DataFrame, key: str, ts: str, order: str, a: Column, b: Column) -> DataFrame:
    """Rows that satisfy a whose very next row of the key satisfies b."""
    w = Window.partitionBy(key).orderBy(ts, order)
    return df.withColumn("_b", F.lead(b).over(w)).where(a & F.col("_b")).drop("_b")


def times_within(df: DataFrame, key: str, ts: str, a: Column, n: int, seconds: int) -> DataFrame:
    """Rows that satisfy a and are at least the n-th to do so within the last `seconds`."""
    hit = df.where(a).withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    w = Window.partitionBy(key).orderBy("_us").rangeBetween(-seconds * 1_000_000, 0)
    return hit.withColumn("hits", F.count("*").over(w)).where(F.col("hits") >= n).drop("_us")
