import random
from collections import Counter, defaultdict

import corpus_pipeline as C
import helpers as H
import pytest
import test_pii

ITEM = "what is the total weight of nine grey boxes when every box holds four red stones and two blue ones"


def shingles(t, k=5):
    w = H.words(t)
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def alike(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) >= 0.8 * len(x | y)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(3)
    vocab = [f"{a}{b}" for a in ("the", "sun", "moon", "river", "stone", "wind", "tree", "road") for b in ("er", "ing", "ly", "ed", "s", "ness", "ful", "")]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    rows = [(i, text(r.randrange(30, 400)), "en", "s", "c") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s", "c") for i in range(5)]  # exact copies
    for i in range(5, 10):  # near copies
        w = rows[i][1].split()
        w[len(w) // 2] = "changed"
        rows.append((100 + i, " ".join(w), "en", "s", "c"))
    rows += [(200, f"{text(40)} {ITEM} {text(40)}", "en", "s", "c"), (201, ITEM.upper(), "en", "s", "c")]
    rows += [(300, f"{text(50)} write to ann.{1}@mail.example.com or +1 (743) 555-3824 from 10.0.0.1 card 4111 1111 1111 1111", "en", "s", "c")]
    rows += [(400, None, "en", "s", "c"), (401, "  12 34 !!", "en", "s", "c"), (None, text(60), "en", None, "c"), (402, text(4000), "en", "s", "c"), *[(500, rows[20][1], "en", "s", "c")] * 2]
    path = tmp_path_factory.mktemp("tables")
    H.docs(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows


def test_stages(spark, folder, tmp_path):
    path, rows = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in C.STAGES:
        got = stage(spark, docs, path)
        if name != "pack":
            assert got.columns == docs.columns
        got.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.collect())
    lang, near, clean, private, packed = seen
    key = lambda x: Counter((r["doc_id"], r["text"]) for r in x)
    assert key(lang) == Counter((r[0], r[1]) for r in rows if r[0] not in (400, 401))
    # near-dedup: of each group, linked by brute force, the smallest id stays
    parent = list(range(len(lang)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(lang)):
        for j in range(i):
            if alike(lang[i]["text"], lang[j]["text"]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(lang):
        groups[find(i)].append(r)
    first = [min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) for g in groups.values()]
    assert key(near) == key(first) and len(near) < len(lang) - 9
    assert key(clean) == Counter({k: n for k, n in key(near).items() if ITEM not in k[1].lower()})
    before = {r["doc_id"]: r["text"] for r in clean}
    after = {r["doc_id"]: r["text"] for r in private}
    assert set(before) == set(after) and all(not test_pii.base(t) for t in after.values())
    assert all(after[i] == t for i, t in before.items() if not test_pii.base(t))
    assert after[300].endswith("write to [EMAIL] or [PHONE] from [IP] card [CARD]")
    want = Counter()
    for r in private:
        ids = [*H.encode(r["text"]), 2]
        at = k = 0
        while at < len(ids):
            n = (len(ids) - at) % 1024 or 1024
            want[r["doc_id"], k, at, n, H.crc(ids[at : at + n])] += 1
            at, k = at + n, k + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    again = C.run(spark, path).collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in again) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)


def test_no_documents(spark, tmp_path):
    path = H.save(spark, tmp_path, [])
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert C.run(spark, path).count() == 0
