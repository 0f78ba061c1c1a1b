"""near_dedup of the pipeline against Jaccard similarity alone."""

import random

import helpers as H
from test_simhash import fp

from loomwork.llm import near_copies


def shingles(t, k=5):
    w = H.words(t)
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def stays(texts):
    """The least id of each group that is linked by Jaccard similarity."""
    s, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {find(i) for i in range(len(s))}


def left(spark, tmp_path, texts, **how):
    path = H.save(spark, tmp_path, [(i, t, "en", "s", "c") for i, t in enumerate(texts)])
    return sorted(r["doc_id"] for r in near_copies.one_of_each(spark.read.parquet(f"{path}/documents.parquet"), **how).collect())


def other(r, w, n, tag):
    w = list(w)
    for k in r.sample(range(len(w)), n):
        w[k] = f"{tag}x{k}"
    return w


def test_family_with_false_hubs(spark, tmp_path):
    r = random.Random(11)
    base = [f"w{r.randrange(5000)}" for _ in range(300)]
    variants = [other(r, base, 6, f"v{i}") for i in range(100)]  # below 0.8 of each other, many within nine bits
    texts = [" ".join(v) for v in variants] + [" ".join(other(r, v, 1, f"t{i}")) for i, v in enumerate(variants)]
    want = stays(texts)
    assert want == set(range(100))
    assert left(spark, tmp_path, texts) == sorted(want)


def test_equal_fingerprints_of_unlike_texts(spark, tmp_path):
    r = random.Random(2)
    line = " ".join(f"line{k}" for k in range(9))
    texts = [" ".join([line] * 60 + [f"own{i}n{r.randrange(10**6)}" for _ in range(120)]) for i in range(6)]
    assert len({fp(t, 5) for t in texts}) < 6
    assert left(spark, tmp_path, texts) == list(range(6))


def test_every_pair_above_the_similarity(spark, tmp_path):
    r = random.Random(5)
    texts = []
    for i in range(60):  # one to six edits of texts of 60 to 330 words: similarities about 0.8 and more
        w = [f"b{i}w{r.randrange(900)}" for _ in range(60 + 45 * (i % 6 + 1))]
        texts += [" ".join(w), " ".join(other(r, w, 1 + i % 6, f"e{i}"))]
    s = [shingles(t) for t in texts]
    pairs = [(i, i + 1) for i in range(0, 120, 2) if len(s[i] & s[i + 1]) >= 0.8 * len(s[i] | s[i + 1])]
    far = [p for p in pairs if (fp(texts[p[0]], 5) ^ fp(texts[p[1]], 5)).bit_count() > 9]
    assert len(far) >= 5  # a search within nine bits of the fingerprints finds none of these
    assert left(spark, tmp_path, texts) == left(spark, tmp_path, texts, hot=1) == sorted(stays(texts))


def test_passages_shared_by_unlike_texts_and_cut_copies(spark, tmp_path):
    r = random.Random(8)
    passages = [[f"p{k}w{j}" for j in range(40)] for k in range(6)]
    texts = []
    for i in range(50):  # unlike texts meet at many shingles; copies have edits, or lack up to a fifth of the words
        own = [f"o{i}w{j}" for j in range(r.randrange(60, 260))]
        a, b = r.sample(passages, 2)
        w = own[:20] + a + own[20:50] + b + own[50:]
        copy = other(r, w, 1 + i % 5, f"e{i}") if i % 2 else w[: int(len(w) * r.uniform(0.76, 0.9))]
        texts += [" ".join(w), " ".join(copy)]
    s = [shingles(t) for t in texts]
    alike = [len(s[i] & s[i + 1]) / len(s[i] | s[i + 1]) for i in range(0, 100, 2)]
    assert sum(0.8 <= x < 0.84 for x in alike) >= 3 and sum(x < 0.8 for x in alike) >= 5
    assert sum(1 for i in range(0, 100, 2) for j in range(i) if s[i] & s[j]) > 500
    assert left(spark, tmp_path, texts) == left(spark, tmp_path, texts, hot=1) == sorted(stays(texts))


def test_family_about_as_alike_as_a_link_needs(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(other(r, base, r.choice((1,) + (2,) * 9), f"v{i}")) for i in range(260)]
    s = [shingles(t) for t in texts]
    alike = sum(len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]) for i in range(260) for j in range(i))
    assert alike > 1000
    verified, cut = [], near_copies.cut

    def counted(df, name="t", *args, **how):
        got = cut(df, name, *args, **how)
        if name == "pairs":
            verified.append(got.count())
        return got

    monkeypatch.setattr(near_copies, "cut", counted)
    assert left(spark, tmp_path, texts) == sorted(stays(texts))
    assert sum(verified) < 20 * len(texts)  # each with each: 33,670
