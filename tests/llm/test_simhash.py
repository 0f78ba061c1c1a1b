import random
from collections import Counter

import helpers as H
import numpy as np
import xxhash

from loomwork.llm import simhash
from loomwork.llm.graph import components
from loomwork.llm.queries import registry


def fp(text, k=4):
    w = H.words(text)
    if not w:
        return 0
    s = [" ".join(w)] if len(w) <= k else [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    h = np.array(h, dtype=np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))


def roots(fps, radius=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    v = np.array(fps, dtype=np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= radius) + i + 1:
            parent[find(int(j))] = find(i)
    return [find(i) for i in range(len(v))]


def check(rows, docs):
    want = Counter()
    fps = [fp(d["text"]) for d in docs]
    root = roots(fps)
    least = {}
    for d, r in zip(docs, root):
        if d["doc_id"] is not None:
            least[r] = min(least.get(r, d["doc_id"]), d["doc_id"])
    for d, f, r in zip(docs, fps, root):
        want[(d["doc_id"], f"{f:016x}", least.get(r))] += 1
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == want


def test_whole_table(spark, tiny, tmp_path):
    rng = random.Random(5)
    base = [f"w{rng.randrange(999)}" for _ in range(120)]
    near = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(len(w))] = f"n{i}"
        near.append((100 + i, " ".join(w), "en", "s", "x"))
    for folder in (tiny, H.save(spark, tmp_path, H.ODD + near)):
        rows = registry.queries["op6_simhash_near_dedup"](spark, folder).collect()
        check(rows, spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    assert registry.queries["op6_simhash_near_dedup"](spark, H.save(spark, tmp_path / "none", [])).count() == 0


def test_links_lose_nothing(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    more = [v]
    for k in range(1, 6):  # up to five bits away
        x = v[:300].copy()
        for _ in range(k):
            x ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
        more.append(x)
    ball = v[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    fps = np.unique(np.concatenate([*more, ball]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for radius in (0, 4, 6):
        got = {r["node"]: r["root"] for r in components(simhash.links(df, radius)).collect()}
        mine = [got.get(int(x), int(x)) for x in fps.view(np.int64)]
        want = roots(fps, radius)
        groups = lambda labels: {frozenset(np.flatnonzero(np.array(labels) == x).tolist()) for x in set(labels)}
        assert groups(mine) == groups(want)


def test_thresholds_cover_the_radius():
    n, both = 10_000, np.full((64, 64), 2500.0) + np.diag(np.full(64, 2500.0))
    for size in (100, 10_000, 10**7, 10**9):
        for radius in (0, 3, 4, 8):
            groups, ts = simhash.plan(size, both * size / n, radius)
            assert sorted(b for g in groups for b in g) == list(range(64))
            assert sum(ts) == radius - len(groups) + 1


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(e).collect()}
    assert len({got[i] for i in range(41)}) == 1 and got[1000] == got[1001] != got[0]
    assert components(e.limit(0)).count() == 0
