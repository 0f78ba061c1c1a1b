from collections import defaultdict

import numpy as np

from loomwork.llm import ann
from loomwork.llm.queries import registry


def brute(rows, k=20, every=20):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for i in sorted({int(i) for i in ids if i % every == 0}):
        q = x[ids == i][0]
        s = (x * q).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def recall(rows, want):
    got = defaultdict(list)
    for r in rows:
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    assert set(got) == set(want)
    for q, w in want.items():
        g = sorted(got[q])
        assert [x[0] for x in g] == list(range(1, len(w) + 1))
        assert [(-s, v) for _, v, s in g] == sorted((-s, v) for _, v, s in g)
        hit += len({v for _, v, _ in g} & {v for v, _ in w})
        total += len(w)
    return hit / total


def test_recall_on_a_table(spark):
    folder = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = registry.queries["op3_nearest_neighbours"](spark, folder).collect()
    assert recall(rows, brute([(x["vec_id"], x["embedding"]) for x in e])) >= 0.9


def clustered(n, d=64, seed=1):
    """Vectors about 500 centres, so that each has some two hundred neighbours at cosines of about 0.9."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(500, d))[rng.integers(0, 500, n)] + 0.3 * rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_recall_of_many_vectors(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    x = clustered(100_000)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))}), f"{tmp_path}/v.parquet")
    rows = ann.neighbours(spark.read.parquet(f"{tmp_path}/v.parquet"), lambda i: i % 100 == 0).toArrow()
    q, v = rows["query_id"].to_numpy(), rows["vec_id"].to_numpy()
    asked = np.arange(0, len(x), 100)
    s = x[asked].astype(np.float64) @ x.T.astype(np.float64)
    s[np.arange(len(asked)), asked] = -2
    best = np.argpartition(-s, 20, axis=1)[:, :20]
    want = {(int(a), int(b)) for a, row in zip(asked, best, strict=True) for b in row}
    got = set(zip(q.tolist(), v.tolist(), strict=True))
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.95


def test_share_of_codes_touched():
    """At a recall of 0.9 and more a query looks at few of the codes."""
    x = clustered(100_000)
    mean, matrix = ann.fit(x[:20_000])
    index = ann.Index(ann.encode(x, mean, matrix))
    hit, fetched, radius = 0, 0, 40
    for i in range(0, 5000, 50):
        at, radius = index.search(index.codes[i], 150, max(4, radius - 2))
        s = x[at] @ x[i]
        mine = set(at[np.argsort(-s)[:21]].tolist())
        hit += len(mine & set(np.argsort(-(x @ x[i]))[:21].tolist()))
        fetched += len(at)
    assert hit / 2100 >= 0.9
    assert fetched / 100 / len(x) < 0.02
    print("touched", index.touched / 100 / len(x), "looked up", index.looked / 100)
    assert index.touched / 100 / len(x) < 0.2


def test_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[20][1]) for i in range(60)]  # a frequent vector
    bad = [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] + [1.0] * 7), (2060, [float("inf")] + [1.0] * 7), (2080, [None] + [1.0] * 7), (2100, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, "x") for r in [*rows, *bad, rows[5]]], "vec_id long, embedding array<float>, score string")
    got = ann.neighbours(df, lambda i: i % 20 == 0, k=20, block=100, query_block=7).collect()
    want = brute(rows)
    assert recall(got, want) == 1.0  # blocks smaller than what a radius takes in: all is compared
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 1040] == [v for v, _ in want[1040]]
    assert ann.neighbours(df.limit(0), lambda i: i % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.neighbours(few, lambda i: i % 20 == 0).collect()] == [(0, 1, 1, 0.5)]


def test_probing_loses_nothing():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 2**63, (2000, 2), dtype=np.uint64)
    codes[1::2] = codes[::2] ^ (rng.integers(0, 2**63, (1000, 2), dtype=np.uint64) & rng.integers(0, 2**63, (1000, 2), dtype=np.uint64) & rng.integers(0, 2**63, (1000, 2), dtype=np.uint64))
    index = ann.Index(codes)
    for q in codes[:40]:
        for radius in (0, 5, 20, 50, 128):
            d = np.bitwise_count(codes ^ q).sum(axis=1)
            at, dist = index.within(q, radius)
            assert at.tolist() == np.flatnonzero(d <= radius).tolist() and dist.tolist() == d[d <= radius].tolist()
