import helpers as H

from loomwork.llm import decontamination as D
from loomwork.llm.queries import registry

ITEM = "A train leaves Boston at 9 and covers 120 km before it meets Anna who then walks 120 km back home"


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_whole_table(spark, tiny):
    got = {(r["doc_id"], r["item_id"]) for r in registry.queries["op10_decontamination"](spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()
    assert got == {(d["doc_id"], b["item_id"]) for d in docs for b in items if b["text"] in d["text"]} != set()


def test_slots(spark):
    again = ITEM.replace("Boston", "Chicago").replace("120 km", "75 miles").replace("Anna", "Marie").replace(" 9 ", " 14 ")
    broken = "A train leaves Rome at 3 and covers 50 km before it meets Luke who then walks 99 km back home"
    other = "A man sings in Boston at 9 and sells 120 fish before he meets Anna who then eats"
    rows = [(1, f"Some text here. {again}. The end", "en", "s", "c"), (2, ITEM.lower(), "en", "s", "c"), (3, other, "en", "s", "c"), (4, broken, "en", "s", "c"), (None, ITEM, None, None, None), *H.ODD[1:]]
    got = D.find(H.docs(spark, rows), bench(spark, [(7, ITEM), (7, ITEM), (8, None), (9, ""), (10, "too short")])).collect()
    assert {r["doc_id"] for r in got} - {4} == {1, 2, None} and len(got) == len({r["doc_id"] for r in got})
    one = next(r for r in got if r["doc_id"] == 1)
    assert one["coverage"] > 0.9 and one["changed"] >= 3
    whole = next(r for r in got if r["doc_id"] is None)
    assert one["slots"] == whole["slots"] and whole["changed"] == 0
    four = [r for r in got if r["doc_id"] == 4]  # one of its numbers stands for two: the windows that hold it don't count
    assert not four or four[0]["coverage"] < one["coverage"]
    loop = "then he paid 5 euros for 5 apples and 5 pears and 5 plums and got 5 coins back"
    told = bench(spark, [(1, loop)])
    same, mixed = loop.replace("5", "8"), "then he paid 1 euros for 2 apples and 3 pears and 4 plums and got 6 coins back"
    assert [r["doc_id"] for r in D.find(H.docs(spark, [(1, same, *"esc"), (2, mixed, *"esc")]), told).collect()] == [1]


def test_clean_keeps_columns_and_blocks(spark, monkeypatch):
    items = [(i, f"alpha{i} beta gamma delta epsilon zeta eta theta iota kappa{i} lambda mu") for i in range(30)]
    rows = [(i, f"intro words {items[i][1]} outro", "en", "s", "c") for i in range(0, 30, 3)] + H.ODD
    d = H.docs(spark, rows)
    one = D.clean(d, bench(spark, items))
    assert one.columns == d.columns and one.count() == len(H.ODD)
    monkeypatch.setattr(D, "BLOCK", 100)
    assert D.clean(d, bench(spark, items)).count() == len(H.ODD)
    assert D.find(d, bench(spark, [])).count() == 0 and D.find(H.docs(spark, []), bench(spark, items)).count() == 0


LONG_ITEM = " ".join(f"{a}{b}" for a in ("stone", "river", "cloud", "grass", "metal", "paper") for b in ("ing", "ed", "ful", "ness", "ly", "er", "ish", "less", "able", "y"))[:-8].rstrip()


def found(spark, text, item):
    return D.find(H.docs(spark, [(1, f"some words before it , {text} , and others after it", "en", "s", "c")]), bench(spark, [(7, item)])).count() == 1


def test_partial_moved_and_changed_items(spark):
    w = LONG_ITEM.split()
    assert len(w) == 59
    assert found(spark, " ".join(w[10:40]), LONG_ITEM)  # 30 of 59 words
    assert not found(spark, " ".join(w[10:30]), LONG_ITEM)
    long = " ".join([*w, *(f"more{x}" for x in "abcdefghijklmnopqrstuvwxyz"), *(f"also{x}" for x in "abcdefghijklmnopqrstuvwxyz")])
    assert found(spark, " ".join(w[10:45]), long)  # a run of 35 words in a row
    thirty = w[:30]
    assert found(spark, " ".join([*thirty[:9], "put", *thirty[9:18], "in", *thirty[18:26]]), " ".join(thirty))
    for n in (9, 15, 22):
        changed = [*w[: n // 2], "other", *w[n // 2 + 1 : n]]
        assert found(spark, " ".join(changed), " ".join(w[:n])), n


def test_items_of_numbers_and_names_and_short_ones(spark):
    for item in ("12 17 29 34 41 58 63 77 85 96", "so Anna Berta Carla Dora Emma Frida Greta Hanna Ida Jana", "three grey boxes"):
        assert found(spark, item, item) and found(spark, item.upper(), item)
    assert not found(spark, "12 17 29 30 31 32 33 34 35 36", "12 17 29 34 41 58 63 77 85 96") and not found(spark, "three red boxes", "three grey boxes")


def test_items_whose_windows_have_too_few_words(spark):
    """Each alone in its size, to the letter and with other numbers and names."""
    pairs = [("so Anna gave Bob 5 kg", "so Marie gave Tom 7 kg"), ("What is 12 + 34 times 56 ?", "What is 9 + 81 times 3 ?"), ("so does Anna owe Marie 40 dollars or 30 euros from Berlin", "so does Ida owe Clara 4 dollars or 3 euros from Rome")]
    for item, again in pairs:
        assert found(spark, item, item) and found(spark, again, item), item
    assert not found(spark, "What is 9 + 81 minus 3 ?", "What is 12 + 34 times 56 ?")
    assert not found(spark, "What is 9 + 9 times 3 and 4", "What is 12 + 34 times 56 and 56")


def test_against_brute_force(spark):
    """Windows compared as lists of words, each document with each item; the verdict by the same rule."""
    import random
    from collections import defaultdict

    import pyarrow as pa

    r = random.Random(6)
    vocab = ["the", "box", "of", "stone", "Anna", "Bob", "Rome", "12", "7", "30%", "kg", "weighs", "and", "then", "goes", "to", "with", "red", "How", "many", "."]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([3, 5, 7, 8, 9, 12, 20, 40])))) for i in range(40)]
    docs = []
    for d in range(120):
        w = [r.choice(vocab) for _ in range(r.randrange(0, 40))]
        for _ in range(r.randrange(3)):
            x = r.choice(items)[1].split()
            x = [r.choice(vocab) if r.random() < 0.08 else y for y in x][r.randrange(3) :]
            k = r.randrange(len(w) + 1)
            w[k:k] = x
        docs.append((d, " ".join(w), "en", "s", "c"))

    def words(t):
        _, shape, kind, lit = D.template(pa.array([t]), D.Lexicon())
        return [(int(k), None if k else int(x)) for k, x in zip(kind, lit, strict=True)], [int(x) for x in lit], kind, lit

    want = set()
    told = [(i, *words(t)) for i, t in items]
    for d, t, *_ in docs:
        shape, letters, _, dlit = words(t)
        for i, ishape, iletters, ikind, ilit in told:
            n0 = len(ishape)
            if not n0:
                continue
            n = n0 if n0 <= D.WINDOW else min(D.WINDOW, max(D.LEAST, (n0 - 1) // 2))
            few = [q for q in range(n0 - n + 1) if sum(not k for k, _ in ishape[q : q + n]) >= min(D.LITERALS, n)] if n0 >= D.SHORTEST else []
            m = n
            if not few and n0 >= D.SHORTEST and sum(not k for k, _ in ishape) >= D.PLAIN:
                few, m = [0], n0
            at = {}
            for p in range(len(shape)):
                for q in range(n0):
                    if q + n <= n0 and p + n <= len(shape) and letters[p : p + n] == iletters[q : q + n]:
                        at[p, q, n] = True
                    if q in few and p + m <= len(shape) and shape[p : p + m] == ishape[q : q + m]:
                        at.setdefault((p, q, m), False)
            shifts = defaultdict(list)
            for (p, q, k), e in at.items():
                shifts[p - q].append((p, q, k, e))
            item = (ikind, ilit, frozenset(few))
            ok = [D.judge(item, dlit, f, D.WINDOW, D.COVER, True)[0] for f in shifts.values()]
            chains, last = [], None
            for s in sorted(shifts):
                if last is None or s - last > max(D.WINDOW, n0 // 2):
                    chains.append([])
                chains[-1] += shifts[s]
                last = s
            ok += [D.judge(item, dlit, f, D.WINDOW, D.COVER, False)[0] for f in chains if f]
            if any(ok):
                want.add((d, i))
    got = D.find(H.docs(spark, docs), bench(spark, items)).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == want and len(want) > 30


def test_clashing_names(spark):
    d = H.docs(spark, [(1, "free text", "en", "s", "c"), (2, ITEM, "en", "s", "c")]).withColumnRenamed("length", "leaks")
    got = D.clean(d, bench(spark, [(7, ITEM)])).collect()
    assert [(r["doc_id"], r["leaks"]) for r in got] == [(1, "c")]
    assert D.mark(d, bench(spark, [(7, ITEM)])).columns == [*d.columns, "leaks_"]


def test_words_are_told_apart_as_by_searches_alone(monkeypatch):
    """Most words need no search for marks; what they turn into is what the searches give."""
    import random

    from xxhash import xxh64_intdigest

    def searched(word):
        core = D._EDGE.sub("", word)
        low, flags = core.lower(), 8 * (word[-1:] in ".!?:;" or word.rstrip("\"')]»”’")[-1:] in ".!?")
        if D._NUMBER.match(core):
            flags |= 1
        else:
            flags |= 2 * (low in D.UNITS)
            low = D._INNER.sub("", low)
            flags |= 4 * (len(core) > 1 and core[0].isupper() and core[1:].islower() and low not in D.OPENERS)
        return xxh64_intdigest(low), flags | 16 * (not low)

    r = random.Random(3)
    odd = ["".join(r.choice("azZßİΣς_-+$€%.,:;!?\"')]»”’0123²½٣漢") for _ in range(r.randrange(1, 7))) for _ in range(20_000)]
    plain = ["stone", "Anna", "the", "The", "kg", "elleé", "word.", "Rome,", "red?"]
    want = {w: searched(w) for w in odd + plain}
    lexicon = D.Lexicon()
    assert all(lexicon.of(w) == got for w, got in want.items())

    class Never:
        def __getattr__(self, name):
            raise AssertionError("a search for a plain word")

    for name in ("_EDGE", "_INNER", "_NUMBER"):
        monkeypatch.setattr(D, name, Never())
    assert all(D.Lexicon().of(w) == want[w] for w in plain)
