import math
import zlib
from collections import Counter, defaultdict

import helpers as H
import numpy as np

from loomwork.llm import pitman_yor as P
from loomwork.llm.queries import registry


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def brute(docs):
    train = Counter()
    for d in docs:
        if not held(d["doc_id"]):
            train.update([*H.words(d["text"]), None])
    n, v = sum(train.values()), len(train)
    out = []
    for d in docs:
        w = [*H.words(d["text"]), None]
        base = sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        out.append((d["doc_id"], held(d["doc_id"]), len(w), sum(train[x] > 0 for x in w), n, base))
    return out


def test_counts_and_base(spark, tiny, tmp_path):
    for folder in (tiny, H.save(spark, tmp_path)):
        docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
        rows = registry.queries["op5_pitman_yor_scoring"](spark, folder).collect()
        key = lambda r: tuple((x is not None, x or 0) for x in r[:4]) + (round(r[5], 6),)
        got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows), key=key)
        want = sorted(brute(docs), key=key)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
        assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    assert registry.queries["op5_pitman_yor_scoring"](spark, H.save(spark, tmp_path / "none", [])).count() == 0


def test_better_than_the_base_on_held_out(spark):
    rows = registry.queries["op5_pitman_yor_scoring"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    score, base = sum(r["score"] for r in rows), sum(r["base_score"] for r in rows)
    assert score > 0.9 * base
    got = P.perplexity(registry.queries["op5_pitman_yor_scoring"](spark, "/root/testdata/sf0.01")).where("held_out").first()
    assert abs(math.log10(got["perplexity"]) + score / sum(r["n_tokens"] for r in rows)) < 1e-9


def test_one_bucket_sums_to_one():
    """A bucket alone holds all words: every context's probabilities and the unknown word's add up to 1."""
    rng = np.random.default_rng(0)
    words = np.sort(rng.integers(1, 2**63, 30, dtype=np.uint64))
    pairs = defaultdict(list)
    for _ in range(3000):
        w = min(29, int(rng.exponential(6)))
        pairs[w, int(rng.integers(0, 5)) * (w % 2 + 1)].append(0)
    keys = sorted(pairs)
    per = np.bincount([w for w, _ in keys], minlength=30)
    part = P._pack(np.array([1, 1], dtype="<i8"), words[per > 0], per[per > 0].astype("<u4"), np.array([u for _, u in keys], dtype="<u2"), np.array([len(pairs[k]) for k in keys], dtype="<u4"), np.zeros(3000, dtype="<u2"))
    b = P.Bucket(0, [part])
    assert b.c.sum() == b.count.sum() == 3000
    V = len(b.w)
    tables = np.bincount(b.cu, weights=(b.c > 0), minlength=P.CLASSES)
    state = {"V": float(V), "C": float((b.c > 0).sum()), "T": float(V), "d": (0.4, 0.6)}
    t, C, T = b.sample([(state, tables)] * 4)[-1]
    assert (t >= (b.c > 0)).all() and (t <= b.c).all() and (T >= 1).all() and (T <= C).all()
    root = (C - 0.4 * T + (1 + 0.4 * T.sum()) / (V + 1)) / (1 + C.sum())
    unknown = (1 + 0.4 * T.sum()) / (V + 1) / (1 + C.sum())
    assert abs(root.sum() + unknown - 1) < 1e-9
    for u in set(b.cu.tolist()):
        own = b.cu == u
        cu, tu = b.c[own].sum(), t[own].sum()
        p = (1 + 0.6 * tu) * root / (1 + cu)
        p[b.cw[own]] += (b.c[own] - 0.6 * t[own]) / (1 + cu)
        assert abs(p.sum() + (1 + 0.6 * tu) * unknown / (1 + cu) - 1) < 1e-9 and (p > 0).all()


def test_seating_matches_its_distribution():
    """Tables of three customers at one cell: draws, weighted, follow the process's exact distribution."""
    b = P.Bucket.__new__(P.Bucket)
    b.np, b.rng = np, np.random.default_rng(5)
    a, g, d, n = 0.7, 0.3, 0.5, 200_000
    t, logw = b.seat(np.full(n, 3), np.full(n, a), np.full(n, g), d)
    w = np.exp(logw)
    got = [w[t == k].sum() / w.sum() for k in (1, 2, 3)]
    new = lambda t_: a + g * t_  # noqa: E731  the next table's weight with t_ tables there
    exact = [(1 - d) * (2 - d), (1 - d) * new(1) + new(1) * (2 - 2 * d), new(1) * new(2)]
    assert np.allclose(got, np.array(exact) / sum(exact), atol=0.01)


def test_averaged_probabilities_against_enumeration():
    """Two contexts and two words of few customers: the mean over many sweeps is the exact posterior's mean."""
    import itertools

    d0, d1, (s0, s1) = 0.4, 0.6, P.STRENGTH
    cells = {(0, 0): 3, (0, 1): 1, (1, 0): 2, (1, 1): 2}  # (word, context): customers
    part = P._pack(np.array([1, 1], dtype="<i8"), np.array([5, 9], dtype="<u8"), np.array([2, 2], dtype="<u4"), np.array([0, 1, 0, 1], dtype="<u2"), np.array(list(cells.values()), dtype="<u4"), np.zeros(8, dtype="<u2"))
    V = 2

    def stirling(n, k, d):
        if n == k:
            return 1.0
        return 0.0 if k < 1 or k > n else stirling(n - 1, k - 1, d) + (n - 1 - d * k) * stirling(n - 1, k, d)

    rise = lambda x, n, step: math.prod(x + i * step for i in range(n))  # noqa: E731  x (x + step) ..
    total, mean = 0.0, Counter()
    for ts in itertools.product(*(range(1, c + 1) for c in cells.values())):
        t = dict(zip(cells, ts, strict=True))
        C = [sum(v for (w, _), v in t.items() if w == x) for x in (0, 1)]
        for T in itertools.product(*(range(1, c + 1) for c in C)):
            weight = math.prod(stirling(c, t[k], d1) for k, c in cells.items()) * math.prod(stirling(C[w], T[w], d0) for w in (0, 1))
            for u in (0, 1):
                weight *= rise(s1 + d1, sum(v for (_, x), v in t.items() if x == u) - 1, d1)
            weight *= rise(s0 + d0, sum(T) - 1, d0) / rise(s0 + 1, sum(C) - 1, 1) * (1 / (V + 1)) ** sum(T)
            total += weight
            for (w, u), c in cells.items():
                root = (C[w] - d0 * T[w] + (s0 + d0 * sum(T)) / (V + 1)) / (s0 + sum(C))
                cu, tu = sum(v for (_, x), v in cells.items() if x == u), sum(v for (_, x), v in t.items() if x == u)
                mean[w, u] += weight * (c - d1 * t[w, u] + (s1 + d1 * tu) * root) / (s1 + cu)
    want = np.array([mean[k] / total for k in cells])
    got = np.zeros(4)
    runs = 200
    for i in range(runs):
        b = P.Bucket(i, [part])
        customers = np.bincount(b.cu, weights=b.c, minlength=P.CLASSES)
        states = [({"V": float(V), "C": 4.0, "T": 2.0, "d": (d0, d1)}, np.bincount(b.cu, weights=b.c > 0, minlength=P.CLASSES))]
        for _ in range(6):
            t, C, T = P.Bucket(i, [part]).sample(states)[-1]  # replayed, as the passes do
            states.append((states[0][0] | {"C": float(C.sum()), "T": float(T.sum())}, np.bincount(b.cu, weights=t, minlength=P.CLASSES)))
        got += b.predict(states, customers, 2) / runs
    assert np.abs(got - want).max() < 0.01, (got, want)


def test_contexts_are_words_themselves(spark, tmp_path):
    """Two words whose hashes begin alike, each always before a word of its own."""
    from xxhash import xxh64_intdigest

    seen = {}
    a, b = next((seen[x], w) for w in (f"w{i}" for i in range(100_000)) if seen.setdefault(x := xxh64_intdigest(w) >> 48, w) != w)
    rows = [(i, f"{a} x" if i % 2 else f"{b} y", "en", "s", "c") for i in range(400)]
    got = registry.queries["op5_pitman_yor_scoring"](spark, H.save(spark, tmp_path, rows)).collect()
    assert len(got) == 400
    assert all(abs(r["score"] - math.log10(0.5)) < 0.1 for r in got)  # only the first word is open


def test_frequent_cells_are_seated_customer_by_customer():
    """Tables and weights of 300 customers against a loop over customers."""
    b = P.Bucket.__new__(P.Bucket)
    b.np, b.rng = np, np.random.default_rng(5)
    r, n, c, d = np.random.default_rng(6), 40_000, 300, 0.3
    for a, g in ((2.0, 0.9), (0.02, 0.001)):
        t, logw = b.seat(np.full(n, c), np.full(n, a), np.full(n, g), d)
        t1, w1 = np.ones(n), np.zeros(n)
        for i in range(1, c):
            z = a + g * t1 + i - d * t1
            t1 += r.random(n) * z < a + g * t1
            w1 += np.log(z)
        for x, y in ((t, t1), (logw, w1), (t * t, t1 * t1), (t * logw, t1 * w1)):
            assert abs(x.mean() - y.mean()) < 5 * np.sqrt((x.var() + y.var()) / n) + 1e-7, (a, g, x.mean(), y.mean())


def test_names_are_read_as_written():
    """Names with and without numbers; those with numbers take a fraction of their hashes' bytes."""
    r = np.random.default_rng(1)
    numbered = np.unique(r.integers(0, 2**64, P.NUMBERED, dtype=np.uint64))
    others = r.integers(0, 2**64, 1000, dtype=np.uint64)
    ends = numbered[[0, -1]]
    for names, table in ((np.concatenate([r.choice(numbered, 9000), others, ends]), numbered), (others, numbered), (others, numbered[:0]), (ends, numbered), (others[:0], numbered)):
        names = np.unique(names)
        data, place = P._write_names(names, table)
        assert (P._read_names(data, table)[place] == names).all() and sorted(place.tolist()) == list(range(len(names)))
    few = np.unique(r.choice(numbered, 9000))
    assert len(P._write_names(few, numbered)[0]) < 2 * len(few)


def test_blocks_leave_no_small_rests(spark, monkeypatch):
    """Batches that don't fill blocks to the byte: as many blocks as their text needs, of one task, and scores as of one block."""
    from pyspark.sql import functions as F

    text = " ".join(f"w{k}" for k in range(400))
    docs = spark.createDataFrame([(i, f"{text} own{i}") for i in range(4000)], "doc_id long, text string").coalesce(1)
    rows = docs.withColumn("held", F.lit(False))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    monkeypatch.setattr(P, "BLOCK_BYTES", size // 3)
    numbered = spark.sparkContext.broadcast(np.zeros(0, dtype=np.uint64))
    got = P._blocks(rows, F.col("held"), P._keys(spark, 4), numbered).where("bucket < 0").count()
    assert got <= 4  # with small rests: twice as many nearly
