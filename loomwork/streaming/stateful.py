"""Operators that keep state of their own between batches of a stream."""

from __future__ import annotations

import pickle

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomwork.streaming.cep import Matcher, Pattern


def match_stream(df: DataFrame, key: str, ts: str, patterns: list[Pattern], id_col: str, watermarked: bool = True) -> DataFrame:
    """key, pattern, events of matches over a stream; partial matches are the state of each key.

    Rows of a batch are taken in the order of ts and id; put a watermark on ts to hold the state of keys that have gone quiet
    for no longer than it allows.
    """
    kind = dict(df.dtypes)[key]

    def step(k, frames, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        kept = pickle.loads(state.get[0]) if state.exists else [[] for _ in patterns]
        matchers = [Matcher(p, o) for p, o in zip(patterns, kept, strict=True)]
        found = []
        pdf = pd.concat(list(frames))
        for r in pdf.sort_values([ts, id_col]).to_dict("records"):
            for m in matchers:
                found += [(k[0], m.pattern.name, [int(e[id_col]) for e in events]) for events in m.feed(r, r[ts].timestamp())]
        state.update((pickle.dumps([m.open for m in matchers]),))
        limit = max((p.seconds or 0 for p in patterns), default=0)
        if watermarked and limit:
            last = int(pdf[ts].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + int(limit * 1000) + 1)
        yield pd.DataFrame(found, columns=[key, "pattern", "events"])

    timeout = GroupStateTimeout.EventTimeTimeout if watermarked else GroupStateTimeout.NoTimeout
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, pattern string, events array<long>", "blob binary", "append", timeout)
