"""Benchmark leaks, also with other numbers, names and units.

Words become template tokens: numbers, units after a number, and capitalised words inside a sentence turn into typed
placeholders, all else is its lower-case letters and digits. Windows of template tokens of the benchmark are kept by hash and
met with those of the documents; windows with too few words that are no placeholders are left out of these. All windows are
met by their words and values in lower case, too, so a copy in other case or of numbers and names only is found. Matches of a
document and an item are lined up by their offset, those at near offsets also together, as words may be put in or left out;
then the placeholders' values are compared: one value in the item must stand for one value in the document all along, else
those windows don't count unless they agree to the letter. A document is contaminated by an item if the windows left are enough
of its windows or hold enough of its tokens (`COVER`), or `RUN` tokens of it in a row.

The benchmark is broadcast in blocks of at most `BLOCK` windows, so its size is bounded whatever its length; there is one pass
over the documents for each block.

Nulls: null or empty texts hold nothing; null ids stay. Items no longer than a window are one window, those of fewer than
`SHORTEST` tokens, or of placeholders with fewer than `PLAIN` other words, are found only to the letter, as their template says
too little; items whose windows all have too few words are met by their whole template. Items up to two windows have shorter
windows, so a word changed leaves some on both sides, but a window's length of tokens must be found. Texts of any length are read
whole. Ties between values that a slot might stand for go to the smaller hash. Repeated rows are marked alike; repeated items
count once each. Without documents or items nothing is found. Further columns stay, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from loomwork.llm.common import fresh, give_back

WINDOW, SHORTEST, LITERALS = 8, 5, 4
#: Words that are no placeholders, of an item whose windows have too few of them, from which its whole template is searched for.
PLAIN = 2
COVER = 0.5
#: So many tokens of an item in a row are a leak, however long the item is.
RUN = 30
#: The shortest windows of items that are longer than one window.
LEAST = 4
BLOCK = 1_000_000
SLICE = 1 << 20
KNOWN = 30_000
#: Units that become placeholders after a number.
UNITS = frozenset("mm cm m km in inch inches ft feet foot yd yards mile miles mg g kg lb lbs oz ton tons ml l liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur dollar dollars euro euros cent cents percent % degree degrees mph kmh kph watt watts kw volt volts joule joules newton newtons pound pounds gram grams kilogram kilograms meter meters metre metres kilometer kilometers kilometre kilometres".split())
#: Words that often begin a question or sentence and are no names, wherever they stand.
OPENERS = frozenset("a an the this that these those what which who whom whose when where why how if is are was were do does did can could will would should has have had in on at for from by of to and or but after before during each every find solve given suppose let consider compute calculate there it he she they we you".split())
NUM, UNIT, NAME = 1, 2, 3
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?$")
_EDGE = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")
_INNER = re.compile(r"[\W_]+")
_M = 0x9E3779B97F4A7C15


class Lexicon:
    """What words turn into; kept for the first `KNOWN` words, as the frequent ones come early."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def of(self, word: str) -> tuple[int, int]:
        """A hash and flags: 1 number, 2 unit, 4 capitalised, 8 ends a sentence, 16 nothing but marks."""
        got = self.known.get(word)
        if got is not None:
            return got
        core, flags = word, 0
        if not word.isalnum():  # else there is no mark in it, which most words are spared to be searched for
            flags = 8 * (word[-1:] in ".!?:;" or word.rstrip("\"')]»”’")[-1:] in ".!?")
            core = word.rstrip(".,:;!?")
            if not core.isalnum():
                core = _EDGE.sub("", word)
        low = core.lower()
        if not core.isalpha() and _NUMBER.match(core):
            flags |= 1
        else:
            flags |= 2 * (low in UNITS)
            if not low.isalnum():
                low = _INNER.sub("", low)
            if core[:1].isupper() and len(core) > 1 and core[1:].islower() and low not in OPENERS:
                flags |= 4
        if not low:
            flags |= 16
        got = (xxh64_intdigest(low), flags)
        if len(self.known) < KNOWN:
            self.known[word] = got
        return got


def template(texts, lexicon: Lexicon):
    """Tokens of all texts in a row: text index, template hashes, kinds (0: word) and literal hashes."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    words = pc.ascii_split_whitespace(texts.fill_null(""))
    sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    flat = words.flatten().dictionary_encode()
    seen = flat.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
    pairs = [*map(lexicon.of, seen)]
    h = np.array([p[0] for p in pairs], dtype=np.uint64)
    fl = np.array([p[1] for p in pairs], dtype=np.int64)
    at = flat.indices.to_numpy()
    text = np.repeat(np.arange(len(sizes)), sizes)
    keep = (fl[at] & 16) == 0 if len(seen) else np.zeros(0, dtype=bool)
    at, text = at[keep], text[keep]
    lit, flag = h[at] if len(seen) else np.zeros(0, dtype=np.uint64), fl[at] if len(seen) else np.zeros(0, dtype=np.int64)
    prev = np.zeros(len(at), dtype=np.int64)
    prev[1:] = flag[:-1]
    start = np.ones(len(at), dtype=bool)
    start[1:] = text[1:] != text[:-1]
    prev[start] = 8
    kind = np.where(flag & 1, NUM, np.where((flag & 2 > 0) & (prev & 1 > 0), UNIT, np.where((flag & 4 > 0) & (prev & 8 == 0), NAME, 0)))
    shape = np.where(kind > 0, kind.astype(np.uint64), lit)
    return text, shape, kind, lit


def windows(shape, size: int):
    """The hash of each window that starts at a place (the last size - 1 places have none)."""
    import numpy as np

    n = len(shape) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        out = out * np.uint64(_M) + shape[j : j + n]
    return out ^ (out >> np.uint64(29))


def _index(rows, size: int):
    """Windows of items, by size and whether they are to the letter: (sorted hashes, item, place); and the items' tokens."""
    import numpy as np
    import pyarrow as pa

    lex, found, items = Lexicon(), defaultdict(list), []
    for k, text in enumerate(rows):
        _, shape, kind, lit = template(pa.array([text or ""]), lex)
        length = len(shape)
        n = length if length <= size else min(size, max(LEAST, (length - 1) // 2))
        items.append((kind, lit, frozenset()))
        if not length:
            continue
        w = windows(lit, n)
        found[n, True] += [(int(w[i]), k, i) for i in range(len(w))]
        if length < SHORTEST:
            continue
        w = windows(shape, n)
        plain = np.convolve(kind == 0, np.ones(n, dtype=int), "valid")
        ok = np.flatnonzero(plain >= min(LITERALS, n)).tolist()
        if not ok and (kind == 0).sum() >= PLAIN:  # numbers and names mostly: the whole item is one window
            n, w, ok = length, windows(shape, length), [0]
        items[-1] = (kind, lit, frozenset(ok))
        if ok:
            found[n, False] += [(int(w[i]), k, i) for i in ok]
    out = {}
    for key, f in found.items():
        f.sort()
        h, k, i = (np.array(x, dtype=t) for x, t in zip(zip(*f, strict=True), (np.uint64, np.int64, np.int64), strict=True))
        table = np.zeros(1 << 18, dtype=bool)
        table[(h >> np.uint64(46)).astype(np.int64)] = True
        out[key] = (h, k, i, table)
    return out, items


def longest(places) -> int:
    """The most places in a row."""
    most = now = 0
    last = None
    for q in sorted(places):
        now = now + 1 if last is not None and q == last + 1 else 1
        most, last = max(most, now), q
    return most


def judge(item, lit, found, window: int, cover: float, straight: bool) -> tuple[bool, float, int, int]:
    """Whether windows (place in the document, in the item, size, to the letter) are a leak; coverage, slots, changed values."""
    kinds, lits, ok = item
    slots = {(q + j, p + j) for p, q, n, _ in found for j in range(n) if kinds[q + j]}
    pairs = Counter((int(kinds[q]), int(lits[q]), int(lit[p])) for q, p in slots)
    to: dict[tuple[int, int], int] = {}
    for (kd, a, b), _ in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
        to.setdefault((kd, a), b)  # the most frequent value
    wrong = {(q, p) for q, p in slots if to[int(kinds[q]), int(lits[q])] != int(lit[p])}
    good = [(q, n) for p, q, n, exact in found if exact or not any((q + j, p + j) in wrong for j in range(n))]
    tokens = {q + j for q, n in good for j in range(n)}
    share = max(len(ok & {q for q, _ in good}) / len(ok) if ok else 0.0, len(tokens) / len(kinds))
    leak = len(tokens) >= min(len(kinds), window) and (share >= cover or (straight and len(tokens) >= RUN and longest(tokens) >= RUN))
    return leak, share, len({q for q, _ in slots}), sum(a != b for (_, a), b in to.items())


def mark(docs: DataFrame, bench: DataFrame, window: int = WINDOW, cover: float = COVER, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all if not given) and the items that contaminate: array of (item_id, coverage, slots, changed).

    That column is the last one; its name is `leaks`, or if docs have that already, with underscores after it.
    """
    keep = keep or docs.columns
    leaks_ = fresh(docs.columns, "leaks")
    spark = docs.sparkSession
    items = bench.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    weight = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(weight) // (2 * BLOCK)))  # two windows have four characters at least, but for the shortest words
    leak = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("slots", T.LongType()), T.StructField("changed", T.LongType())]))
    out = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col])))
    out = out.withColumn(leaks_, F.array().cast(leak))
    for part in range(blocks):
        rows = sorted(items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == part).collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        sent = spark.sparkContext.broadcast((*_index([r["text"] for r in rows], window), [r["item_id"] for r in rows]))
        names, schema = out.columns, out.schema

        def run(batches, sent=sent, names=names):
            import numpy as np
            import pyarrow as pa

            index, items_, ids = sent.value
            lex = Lexicon()

            def search(texts):
                """text index -> leaks"""
                text, shape, kind, lit = template(texts, lex)
                hits: dict[tuple[int, int], dict[int, dict]] = defaultdict(lambda: defaultdict(dict))
                for (n, exact), (keys, item, place, table) in index.items():
                    w = windows(lit if exact else shape, n)
                    at = np.flatnonzero(table[(w >> np.uint64(46)).astype(np.int64)] & (text[: len(w)] == text[n - 1 :])) if len(w) else []
                    if not len(at):
                        continue
                    left, right = np.searchsorted(keys, w[at], "left"), np.searchsorted(keys, w[at], "right")
                    for p, a, b in zip(at.tolist(), left.tolist(), right.tolist(), strict=True):
                        for x in range(a, b):
                            q = int(place[x])
                            same = hits[int(text[p]), int(item[x])][p - q]
                            same[p, q, n] = exact or same.get((p, q, n), False)
                best: dict[tuple[int, int], tuple[bool, float, int, int]] = {}
                for (t, k), shifts in hits.items():
                    found = {s: [(*x, e) for x, e in f.items()] for s, f in shifts.items()}
                    best[t, k] = max(judge(items_[k], lit, f, window, cover, True) for f in found.values())
                    # words put in or left out move what follows: offsets that are near each other together
                    order, group = sorted(found), []
                    for s in [*order, None]:
                        if group and (s is None or s - group[-1] > max(window, len(items_[k][0]) // 2)):
                            if len(group) > 1:
                                best[t, k] = max(best[t, k], judge(items_[k], lit, [x for g in group for x in found[g]], window, cover, False))
                            group = []
                        group.append(s)
                out_: dict[int, list] = defaultdict(list)
                for (t, k), (leak, c, s, ch) in sorted(best.items()):
                    if leak:
                        out_[t].append({"item_id": ids[k], "coverage": round(c, 6), "slots": s, "changed": ch})
                return out_

            for b in batches:
                texts = b.column(names.index(text_col))
                leaks = b.column(names.index(leaks_)).to_pylist()
                size, i = texts.nbytes // max(len(texts), 1) + 1, 0
                step = max(1, SLICE // size)
                while i < len(texts):
                    for t, found in search(texts.slice(i, step)).items():
                        leaks[i + t] = leaks[i + t] + found
                    i += step
                cols = [b.column(k) if c != leaks_ else pa.array(leaks, b.schema.field(k).type) for k, c in enumerate(names)]
                yield pa.RecordBatch.from_arrays(cols, names=names)
            give_back()

        out = out.mapInArrow(run, schema)
    return out.select(*(F.col(f"`{c}`") for c in keep), leaks_)


def find(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """doc_id, item_id, coverage, slots, changed: a row for each document and item that contaminates it."""
    got = mark(docs.select("doc_id", "text"), bench, keep=["doc_id"], **how)
    return got.where(F.size("leaks") > 0).select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")


def clean(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """The documents that no item contaminates, with their columns."""
    got = mark(docs, bench, **how)
    return got.where(F.size(got.columns[-1]) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))
