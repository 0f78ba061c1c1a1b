import math
import random
import zlib
from collections import Counter, defaultdict

import helpers as H
import numpy as np

from loomwork.llm import langid
from loomwork.llm.queries import registry


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = registry.queries["op7_language_id"](spark, folder).collect()
    lang = {d["doc_id"]: d["lang"] for d in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(lang) and all(r["held_out"] == held(r["doc_id"]) for r in rows)
    out = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]
    assert len(out) > 100 and np.mean(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["rejected"] for r in rows]) < 0.02


def test_odd_rows(spark, tmp_path):
    more = [(100 + i, f"das ist nicht der weg und die katze {i}", "de", "s", "c") for i in range(40)] + [(200 + i, f"the way is not this and that cat {i}", "en", "s", "c") for i in range(40)]
    rows = registry.queries["op7_language_id"](spark, H.save(spark, tmp_path, H.ODD + more + [(900, "12 34 !!", "en", "s", "c")])).collect()
    assert len(rows) == len(H.ODD) + 81
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == "und" and by[i]["rejected"] and by[i]["score"] == 0 for i in (3, 4, 5, 900))
    assert by[105]["lang_pred"] == "de" and by[205]["lang_pred"] == "en"
    assert registry.queries["op7_language_id"](spark, H.save(spark, tmp_path / "none", [])).count() == 0


def test_probabilities_sum_to_one():
    texts = ["abracadabra", "banana band", "cabana"]
    codes, starts, _ = langid.codes_of(texts)
    g = langid.grams(codes)
    use = np.ones(len(codes), dtype=bool)
    for k in range(langid.ORDER - 1):
        use[starts + k] = False
    _, first, n = np.unique(g[-1][use], return_index=True, return_counts=True)
    at = np.flatnonzero(use)[first]
    m = langid.Model.fit(["x"], {"lang": np.zeros(len(at), dtype=np.int64), "count": n, **{f"g{k + 1}": h[at] for k, h in enumerate(g)}})
    alphabet = sorted(set("".join(texts) + " "))
    for context in ("aba", "   ", "xyz", "ban"):
        probes = np.array([[ord(c) for c in context + a] for a in alphabet], dtype=np.uint32)
        total = sum(float(np.exp(m.logs(langid.grams(p), np.array([3]))[0, 0])) for p in probes)
        assert abs(total + 1 / (len(alphabet) + 1) - 1) < 0.2 and total <= 1 + 1e-9


def test_long_text_by_parts(spark, monkeypatch):
    texts = ["ab cd " * 50, "xyz"]
    codes, starts, _ = langid.codes_of(texts)
    g = langid.grams(codes)
    m = langid.Model.fit(["x"], {"lang": np.zeros(len(codes) - 3, dtype=np.int64), "count": np.ones(len(codes) - 3), **{f"g{k + 1}": h[3:] for k, h in enumerate(g)}})
    whole, n = m.entropies(texts)
    monkeypatch.setattr(langid, "CHUNK", 37)
    parts, n2 = m.entropies(texts)
    assert np.allclose(whole, parts) and (n == n2).all()


def test_normal_text():
    assert langid.normal('The key = "AKIA12XY" Is here x9') == "the key is here"
    assert langid.normal("abc123") == "abc" and langid.normal("12 ..") == "" == langid.normal(None)


def test_windows_reach_all_parts():
    t = "".join(chr(97 + i // 10_000) for i in range(260_000))
    w = langid.windows(t, 20_000)
    assert 19_900 < len(w) < 20_100 and len(set(w) - {" "}) >= 10 and t[-1] != w[-1] or "z" in w
    assert langid.windows("short", 20_000) == "short"


def test_clashing_names_and_few_texts(spark):
    r = random.Random(1)
    word = lambda a: "".join(r.choice(a) for _ in range(5))
    rows = [(i, " ".join(word("abcde" if i % 2 else "vwxyz") for _ in range(40)), "aa" if i % 2 else "zz", "s", "c") for i in range(12)]
    d = H.docs(spark, rows)
    for c in ("score", "lang_pred", "rejected", "Cross_Entropy"):
        d = d.withColumn(c, langid.F.lit(f"own {c}"))
    model = langid.train(d, langid.F.lit(True))  # under five texts of a language are held back
    got = langid.predict(d, model)
    assert got.columns == [*d.columns, "lang_pred_", "score_", "cross_entropy_", "rejected_"]
    out = got.collect()
    assert all(x["score"] == "own score" and x["lang_pred_"] == x["lang"] and not x["rejected_"] for x in out)
    odd = H.docs(spark, [(1, "qqqq jjjj kkkk pppp " * 30, "aa", "s", "c")])
    assert langid.predict(odd, model).first()["rejected"]


def test_every_language_is_learned(spark):
    r = random.Random(2)
    rows = []
    for k in range(230):
        own = [chr(0x4E00 + 40 * k + j) for j in range(30)]
        rows += [(1000 * k + i, " ".join("".join(r.choice(own) for _ in range(4)) for _ in range(20)), f"l{k}", "s", "c") for i in range(3)]
    model = langid.train(H.docs(spark, rows), langid.F.lit(True))
    got = langid.predict(H.docs(spark, rows), model).collect()
    assert len({x["lang_pred"] for x in got}) > 220


def test_cross_entropy_against_brute_force():
    """Interpolated Kneser-Ney over dictionaries of strings."""
    r = random.Random(4)
    texts = {"aa": [" ".join("".join(r.choice("aabbcde") for _ in range(r.randrange(1, 6))) for _ in range(12)) for _ in range(6)], "bb": [" ".join("".join(r.choice("cdeffg") for _ in range(r.randrange(1, 6))) for _ in range(12)) for _ in range(6)]}
    langs, N, cols = sorted(texts), langid.ORDER, [[] for _ in range(langid.ORDER + 2)]
    for x, k in enumerate(langs):
        codes, starts, _ = langid.codes_of(texts[k])
        g = langid.grams(codes)
        use = np.ones(len(codes), dtype=bool)
        for j in range(N - 1):
            use[starts + j] = False
        _, first, n = np.unique(g[-1][use], return_index=True, return_counts=True)
        at = np.flatnonzero(use)[first]
        for c, v in zip(cols, (np.full(len(at), x), n, *(h[at] for h in g)), strict=True):
            c.append(v)
    rows = [np.concatenate(c) for c in cols]
    m = langid.Model.fit(langs, {"lang": rows[0], "count": rows[1], **{f"g{k + 1}": rows[2 + k] for k in range(N)}})
    asked = ["abba cab", "fgf gce", "zzz", "a", *texts["aa"][:2], *texts["bb"][:2]]
    got, _ = m.entropies(asked)
    for x, k in enumerate(langs):
        top = Counter(t[i : i + N] for s in texts[k] for t in ["   " + s + " "] for i in range(len(t) - N + 1))
        count = {N: top}
        for j in range(N - 1, 0, -1):
            count[j] = Counter(gram[1:] for gram in count[j + 1])
        total, kinds, disc = {}, {}, {}
        for j in range(1, N + 1):
            total[j], kinds[j] = defaultdict(int), defaultdict(int)
            for gram, c in count[j].items():
                total[j][gram[:-1]] += c
                kinds[j][gram[:-1]] += 1
            n1, n2 = (sum(c == i for c in count[j].values()) for i in (1, 2))
            disc[j] = min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5))

        def p(gram):
            j = len(gram)
            if not j:
                return 1 / (len(count[1]) + 1)
            low, t = p(gram[1:]), total[j].get(gram[:-1], 0)
            return low if not t else max(count[j].get(gram, 0) - disc[j], 0) / t + disc[j] * kinds[j][gram[:-1]] / t * low

        for i, s in enumerate(asked):
            t = "   " + s + " "
            want = -sum(math.log(p(t[a : a + N])) for a in range(len(t) - N + 1)) / (len(s) + 1)
            assert abs(got[i, x] - want) < 1e-6, (s, k)
