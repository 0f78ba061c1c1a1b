from collections import Counter, defaultdict

import helpers as H
import numpy as np
import pytest

from loomwork.llm import counting, packing, tokenfile
from loomwork.llm.queries import registry

Q = registry.queries


def test_packing_matches_brute_force(spark, tiny, tmp_path):
    for folder in (tiny, H.save(spark, tmp_path)):
        docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
        rows = Q["op1_best_fit_packing"](spark, folder).collect()
        want = Counter()
        for d in docs:
            ids = [*H.encode(d["text"]), 2]
            at, k = 0, 0
            while at < len(ids):
                n = (len(ids) - at) % 1024 or 1024
                want[(d["doc_id"], k, at, n, H.crc(ids[at : at + n]))] += 1
                at, k = at + n, k + 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
        bins = defaultdict(list)
        for r in rows:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for b in bins.values():
            at = 0
            for o, n in sorted(b):
                assert o == at
                at += n
            assert at <= 1024
        total = sum(n for *_, n, _ in want.elements())
        small = [r["length"] for r in rows]
        bound = packing.lower_bound(np.bincount(small, minlength=1025), 1024)
        assert -(-total // 1024) <= bound <= len(bins) <= bound * 1.03 + 1


def test_exchange_helps_and_keeps_items(spark):
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 101, 3000).tolist()
    items = spark.createDataFrame([(i, int(s), "x", "y", 1) for i, s in enumerate(sizes)], "k int, length long, part string, closed string, offset int")
    rows = packing.pack(items, capacity=100, group=200).collect()
    assert sorted((r["k"], r["length"]) for r in rows) == list(enumerate(sizes))
    used = len({r["sequence_id"] for r in rows})
    assert used <= packing.lower_bound(np.bincount(sizes, minlength=101), 100) * 1.03
    one_round = len({r["sequence_id"] for r in packing.pack(items, capacity=100, group=200, rounds=1).collect()})
    assert used <= one_round
    fill = defaultdict(int)
    for r in rows:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 100


def test_bound_is_a_bound():
    rng = np.random.default_rng(0)
    for _ in range(200):
        cap = int(rng.integers(5, 60))
        sizes = rng.integers(1, cap + 1, int(rng.integers(1, 40)))
        b, _, used = packing.best_fit(sizes, cap)
        assert -(-sizes.sum() // cap) <= packing.lower_bound(np.bincount(sizes, minlength=cap + 1), cap) <= used
    assert packing.lower_bound(np.bincount([6] * 9, minlength=11), 10) == 9
    assert packing.lower_bound(np.zeros(11, dtype=int), 10) == 0


def test_empty_packing(spark, tmp_path):
    assert Q["op1_best_fit_packing"](spark, H.save(spark, tmp_path, [])).count() == 0


def test_token_files_round_trip(spark, tiny, tmp_path):
    for folder in (tiny, H.save(spark, tmp_path)):
        docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
        out = tokenfile.write(spark.read.parquet(f"{folder}/documents.parquet"), shard_ids=5000, parts=3)
        rows = tokenfile.read(spark, out, with_ids=True).collect()
        rows.sort(key=lambda r: r["start"])
        at = 0
        for r in rows:
            assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == H.crc(r["ids"])
            at += r["n_tokens"]
        order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in rows]
        assert order == sorted(order)
        assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == Counter((d["doc_id"], (*H.encode(d["text"]), 0)) for d in docs)
        again = Q["op4_token_files"](spark, folder).collect()
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in again) == Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows)
    assert Q["op4_token_files"](spark, H.save(spark, tmp_path, [])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 300, 2000])
def test_elias_fano(n):
    v = np.cumsum(np.random.default_rng(n).integers(0, 900, n))
    bits, low, high = tokenfile.EliasFano.encode(v)
    ef = tokenfile.EliasFano(n, bits, low, high)
    assert ef.all().tolist() == v.tolist() == [ef.select(i) for i in range(n)]
    assert len(low) + len(high) <= n * (2 + max(1, int(v[-1] / n)).bit_length()) / 8 + 2 if n else True


def test_counts_follow_edits(spark, tiny, tmp_path):
    for folder in (tiny, H.save(spark, tmp_path)):
        docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
        want = Counter()
        for d in docs:
            t = d["text"] or ""
            h = len(t) // 2
            new = t + "\n-- end --"
            new = new[:h] + " [...] " + new[h + 12 :]
            new = f"# {'?' if d['source'] is None else d['source']}\n" + new
            want[(d["doc_id"], len(H.encode(t)), len(H.encode(new)), len(new))] += 1
        rows = Q["op2_token_counts"](spark, folder).collect()
        assert Counter((r["doc_id"], r["n_tokens"], r["n_edited"], r["n_chars"]) for r in rows) == want
        long = [r for r in rows if r["n_leaves"] > 20]
        assert long and all(r["n_encoded"] < 64 * 12 for r in long)
    assert Q["op2_token_counts"](spark, H.save(spark, tmp_path, [])).count() == 0


def test_edits_table_and_stored_trees(spark):
    d = H.docs(spark)
    edits = spark.createDataFrame([(1, 2, 0, 3, "A dog's"), (1, 1, 5, None, ""), (99, 1, 0, 1, "x"), (None, 1, 0, 1, "x"), (6, 1, -5, 10**6, "gone"), (3, 1, 4, 9, "new")], "doc_id long, seq int, start int, stop int, put string")
    trees = counting.count(d.dropDuplicates(["doc_id"]))
    joined = counting.with_edits(d.dropDuplicates(["doc_id"]), edits).join(trees, "doc_id", "left")
    got = {r["doc_id"]: r for r in counting.recount(joined).collect()}
    assert got[1]["n_edited"] == len(H.encode("A dog'scat"[: len("A dog's") + 0] + "the c"[3:]))
    assert got[6]["n_edited"] == len(H.encode("gone")) and got[3]["n_edited"] == len(H.encode("new"))
    assert got[2]["n_edited"] == got[2]["n_tokens"] and got[2]["n_encoded"] == 0


def test_added_tokens_as_the_library_has_them(spark):
    import random

    from loomwork.llm.tokens import Encoder, default_path

    enc, plain = Encoder(default_path()), Encoder(default_path(), added=False)
    ids = lambda b: np.frombuffer(b, dtype="<u4").tolist()
    r = random.Random(9)
    bits = ["<|endoftext|>", "<|endoftext", "|>", "<", "|", " ", "  ", "\n", "a", " word", "it's", "12"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(600)]
    for t in texts:
        assert ids(enc.ids(t)) == H.encode(t) == ids(b"".join(enc.each(enc.split(t))))
    assert len(ids(enc.ids("a<|endoftext|>b"))) == 3 and len(ids(plain.ids("a<|endoftext|>b"))) > 3
    for t in texts:  # edits that make and break added tokens
        long = ("filler words " * r.randrange(40)) + t + (" more words" * r.randrange(40))
        tree = counting.Tree(long, default_path(), leaf=3)
        for _ in range(3):
            a = r.randrange(len(tree.text) + 1)
            tree.edit(a, min(len(tree.text), a + r.randrange(6)), r.choice(bits))
            assert tree.total == len(H.encode(tree.text))
