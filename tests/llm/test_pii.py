import hashlib
import math
import random
import re
from collections import Counter

import helpers as H

from loomwork.llm import pii
from loomwork.llm.queries import registry

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def base(t):
    t = t or ""
    only = lambda x: re.sub("[^0-9]", "", x)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(only(m[0])) <= 15]
    return sorted(out)


def odd():
    r = random.Random(4)
    bits = ["a", "b@c.de", "@", ".", "..", "_x@y.z", "1.2.3.4", "255.0.1.02", "256.1.1.1", "4111 1111-1111 1111", "4111111111111111", "  ", "-", " ", "7", "12", "+1 (743) 555-3824", "+", "é", "\U0001f600", "x@y", "%", "\ue000", "\ue001", "0", "5500-0000 0000 0004", "\n", "a@b.co.uk", "+49.30.1234567"]
    rows = [(1000 + i, "".join(r.choice(bits) for _ in range(r.randrange(1, 14))), "en", "s", "x") for i in range(1500)]
    return rows + [(5000, "1 " * 20000 + "4111 1111 1111 1111", "en", "s", "x"), (5001, "a" * 50000 + "@b." + "c." * 5000 + "d", "en", "s", "x"), (5002, "1" * 50000, "en", "s", "x"), (5003, "a@b.c " * 300, "en", "s", "x")]


def test_base_matches_patterns(spark, tiny, tmp_path):
    for folder in (tiny, H.save(spark, tmp_path, H.ODD + odd())):
        docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
        want = Counter()
        for d in docs:
            b = base(d["text"])
            text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in b)
            want[(d["doc_id"], *(sum(x[1] == k for x in b) for k in range(4)), hashlib.sha256(text.encode()).hexdigest())] += 1
        rows = registry.queries["op8_pii"](spark, folder).collect()
        assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows) == want
    assert registry.queries["op8_pii"](spark, H.save(spark, tmp_path / "none", [])).count() == 0


def terms(t):
    bare = [re.sub(r"^[^\w]+|[^\w]+$|^_+|_+$", "", w.lower()) for w in re.split(r"[\x20\x09-\x0d]+", t)]
    return {w for w in bare if len(w) > 1 and any(c.isalpha() for c in w)}


def corpus(seed=1):
    r = random.Random(seed)
    w = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    rows = [(i, f"Zorblatt {w(30)} ann@corp.example.com {w(30)} from desk{i % 3}", "en", "s", "c") for i in range(12)]  # far apart
    rows += [(50, rows[0][1], "en", "s", "c")] * 5  # copies are no support
    near = f"{w(60)} Quux bob@corp.example.com {w(40)}".split()
    rows += [(60 + i, " ".join([*near[: 3 * i], w(1), *near[3 * i + 1 :]]), "en", "s", "c") for i in range(20)]  # nor are near copies
    rows += [(100 + i, f"the {w(20)} of day {i} from desk{i % 3} us today", "en", "s", "c") for i in range(200)]
    rows += [(400 + i, f"{w(25)} Common +1 (743) 555-38{i:02} 10.0.0.1 once", "en", "s", "c") for i in range(10)]
    rows += [(500 + i, f"{w(25)} Common elsewhere", "en", "s", "c") for i in range(60)]
    return rows


def test_revealing_terms_against_brute_force(spark):
    rows = [x for x in corpus() if not 60 <= x[0] < 80]
    texts = sorted({x[1] for x in rows})
    entities = {t: {(k, re.sub("[^0-9]", "", t[a:b]) if k > 1 else t[a:b].lower()) for a, k, b in base(t)} for t in texts}
    holds = {t: terms(t) for t in texts}
    n_e, n_t, n_et = Counter(e for t in texts for e in entities[t]), Counter(x for t in texts for x in holds[t]), Counter((e, x) for t in texts for e in entities[t] for x in holds[t])
    N, want = len(texts), Counter()
    for (e, x), k in n_et.items():
        pmi, info = math.log2(k * N / (n_e[e] * n_t[x])), math.log2(N / n_e[e])
        if k >= pii.SUPPORT and pmi > 0 and pmi >= pii.DISCLOSURE * info:
            want[x, round(pmi, 6), round(info, 6)] += 1
    got = Counter((x["term"], round(x["pmi"], 6), round(x["information"], 6)) for x in pii.revealing(H.docs(spark, rows))[0].collect())
    assert got == want
    assert {"zorblatt", "once"} < {x[0] for x in got} and "common" not in {x[0] for x in got}


def test_revealing_terms_and_sanitising(spark):
    rows = corpus()
    found = pii.find(H.docs(spark, rows)).cache()
    got = {r["doc_id"]: r for r in found.select("*", pii.spell("spans").alias("said")).collect()}
    assert got[3]["said"].startswith("term:0:8,email")  # thirty words away, at the text's edge
    assert all(got[i]["said"].startswith("term:0:8,email") for i in range(12)) and got[50]["said"] == got[0]["said"]
    assert not any("term" in got[i]["said"] for i in (150, 60, 62, 79, 505))
    text = dict((x[0], x[1]) for x in rows)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(found).collect()}
    assert clean[3] == text[3].replace("Zorblatt", "[TERM]").replace("ann@corp.example.com", "[EMAIL]")
    assert clean[150] == text[150]


def test_clashing_names(spark):
    names = ["base", "spans", "_t", "_text", "_card", "_key", "_mail", "_email", "_ip", "_phone", "_digit", "_terms", "key", "entity", "W"]
    d = H.docs(spark, corpus())
    for c in names:
        d = d.withColumn(c, pii.F.lit(f"own {c}"))
    got = pii.clean(d)
    assert got.columns == d.columns
    r = got.where("doc_id = 3").first()
    assert all(r[c] == f"own {c}" for c in names) and r["text"].startswith("[TERM] ")
