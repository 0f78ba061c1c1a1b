"""Near copies by word shingles: one document of each group stays.

A node is a distinct set of shingles, so exact copies cost nothing. Two nodes are linked if their Jaccard similarity is at least
`similarity`. SimHash finds most links: distinct shingles give a 64-bit fingerprint, the generalised pigeonhole search of
`simhash` returns what lies within `RADIUS` bits, and exact sets verify it. A similarity of 0.8 can be 17 bits and more, beyond
any pigeonhole of 64 bits, so what fingerprints can't reach is found by prefixes: shingles have one order, rare ones first, and
alike sets share a shingle among the first n - ceil(similarity * n) + 1 of each. Only nodes that no verified link connects yet
meet there: first with one hub of each shingle, then with some 8 and some 64 of its nodes, then each with each, and after each
step what is connected needs no more pairs. So a family of texts about as alike as a link needs, each with links to a tenth of the
others, costs each node some pairs and not one with every other; only nodes without a link meet all others of their shingles. Two nodes that share several shingles in a row of their
prefixes meet at the first of them, and only where as many shingles can follow as a link needs: the first shingle that an alike
pair shares always passes both. No link is lost, whatever the order or the fingerprints.
Sizes and parity bits (one for each shingle at least), which bound the similarity from above, leave out pairs that can't be
alike before sets are sent.

Shingles that a sample of documents, or more than `HOT` prefixes, have come last in the order, so passages that many
unlike documents share hardly meet.

Nulls: a null text has no words; texts without words are one group. Null ids sort last within a group. Texts of fewer words than
a shingle are one shingle. Very long texts are whole sets. Among equal ids the first row by file and place stays; repeated rows
are one group. Without rows the result is empty. All columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import cut, fresh, give_back
from loomwork.llm.graph import components
from loomwork.llm.simhash import links

RADIUS = 4
#: Documents of the sample that tells which shingles are frequent, from how many of them on, and how many such at most.
SAMPLE, OFTEN, MOST_FREQUENT = 10_000, 4, 100_000
#: Nodes of a shingle from which it goes to the end of the order, and how many shingles do at most (16 bytes each).
HOT, MOST_LOUD = 40, 500_000
#: Rounds of pairs with one hub of each shingle, and how many of a shingle's nodes (about) others meet then, before each node meets each.
ROUNDS, SOME = 1, (8, 64)
#: Rows up to which keys (some 24 bytes each) are broadcast.
SMALL = 500_000
SLICE = 1 << 20
#: Parity bits that travel with nodes; those that verify are a power of two of this at least.
COARSE = 256
#: Bits of the map, always of one size, that keeps shingles of one node only from being sent to meet others.
MAP = 26
_M, _PAD = 0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D


def sets(texts, words: int):
    """Distinct shingle hashes of a batch of texts, sorted within each, and where each text's begin."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from xxhash import xxh64_intdigest

    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    n = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten().dictionary_encode()
    seen = flat.dictionary.cast(pa.binary()).to_pylist()
    ix, doc = flat.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(n)), n)
    if b"" in seen:  # blanks at the ends
        keep = ix != seen.index(b"")
        ix, doc = ix[keep], doc[keep]
        n = np.bincount(doc, minlength=len(n))
    h = np.array([xxh64_intdigest(x) for x in seen], dtype=np.uint64)
    room = np.maximum(n, words)
    start = np.cumsum(room) - room
    w = np.full(int(room.sum()), _PAD, dtype=np.uint64)
    w[np.arange(len(ix)) - (np.cumsum(n) - n)[doc] + start[doc]] = h[ix]
    many = room - words + 1
    who = np.repeat(np.arange(len(n)), many)
    at = np.arange(len(who)) - (np.cumsum(many) - many)[who] + start[who]
    s = np.zeros(max(len(w) - words + 1, 0), dtype=np.uint64)
    for j in range(words):
        s = s * np.uint64(_M) + w[j : j + len(s)]
    s = s[at]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # bits must be even for fingerprints
        s = (s ^ (s >> np.uint64(shift))) * np.uint64(factor)
    s ^= s >> np.uint64(31)
    order = np.lexsort((s, who))
    s, who = s[order], who[order]
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != s[:-1]) | (who[1:] != who[:-1])
    s, who = s[keep], who[keep]
    return s, np.searchsorted(who, np.arange(len(n) + 1))


def _slices(batch, text: int):
    """A batch in parts of about SLICE bytes of text."""
    i, step = 0, max(1, SLICE * batch.num_rows // max(batch.column(text).nbytes, 1))
    while i < batch.num_rows:
        yield batch.slice(i, step)
        i += step


def _lists(values, ends):
    import numpy as np
    import pyarrow as pa

    return pa.ListArray.from_arrays(np.asarray(ends, dtype=np.int32), pa.array(values.view(np.int64)))


def shingle_sets(keyed: DataFrame, words: int, key: str = "node") -> DataFrame:
    """key, s: the distinct shingles of each text of keyed(key, text)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for b in _slices(batch, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(*sets(b.column(1), words))], names=[key, "s"])
        give_back()

    return keyed.select(key, "text").mapInArrow(run, f"{key} long, s array<long>")


def profiles(keyed: DataFrame, words: int, similarity: float, often: list[tuple[int, int]]) -> DataFrame:
    """doc_id, file, at, node (hash of the set), n (its size), fp, bits (parity) and prefix of each row of keyed(doc_id, file, at, text)."""
    sent = keyed.sparkSession.sparkContext.broadcast(sorted((x & 0xFFFFFFFFFFFFFFFF, k) for x, k in often))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        known = np.array([x for x, _ in sent.value] or [0], dtype=np.uint64)
        count = np.array([k for _, k in sent.value] or [0], dtype=np.int64)
        for batch in batches:
            for b in _slices(batch, 3):
                s, ends = sets(b.column(3), words)
                n, first = np.diff(ends), ends[:-1]
                who = np.repeat(np.arange(len(n)), n)
                fp = np.zeros(len(n), dtype=np.uint64)
                for bit in range(64):
                    fp |= (2 * np.add.reduceat((s >> np.uint64(bit)) & np.uint64(1), first) > n).astype(np.uint64) << np.uint64(bit)
                wide = np.maximum(COARSE, 1 << np.ceil(np.log2(n)).astype(np.int64))
                room = np.cumsum(wide) - wide
                parity = (np.bincount(room[who] + (s & (wide[who] - 1).astype(np.uint64)).astype(np.int64), minlength=int(wide.sum())) & 1).astype(np.uint8)
                bits = np.packbits(parity).view(np.uint64)
                low = (np.bincount(who * COARSE + (s & np.uint64(COARSE - 1)).astype(np.int64), minlength=len(n) * COARSE) & 1).astype(np.uint8)
                coarse = np.packbits(low).view(np.uint64)
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                rank = np.where(known[at] == s, count[at], 0)
                order = np.lexsort((s, rank, who)) if rank.any() else np.arange(len(s))
                most = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
                head = order[(np.arange(len(s)) - first[who]) < most[who]]
                node = [xxh64_intdigest(s[x:y].tobytes()) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                cols = [pa.array(np.array(node, dtype=np.uint64).view(np.int64)), pa.array(n), pa.array(fp.view(np.int64)), _lists(bits, np.append(room, wide.sum()) // 64), _lists(coarse, np.arange(len(n) + 1) * (COARSE // 64)), _lists(s[head], np.concatenate([[0], np.cumsum(most)]))]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), *cols], names=["doc_id", "file", "at", "node", "n", "fp", "bits", "coarse", "prefix"])
        give_back()

    return keyed.select("doc_id", "file", "at", "text").mapInArrow(run, "doc_id long, file long, at long, node long, n long, fp long, bits array<long>, coarse array<long>, prefix array<long>")


def frequent(keyed: DataFrame, words: int) -> list[tuple[int, int]]:
    """(shingle, count) of shingles that a sample of documents has often. They only order shingles: any order finds all pairs."""
    n = keyed.count()
    part = keyed if n <= SAMPLE else keyed.sample(SAMPLE / n, seed=42)
    got = shingle_sets(part.select("at", "text"), words, "at").select(F.explode("s").alias("x")).groupBy("x").agg(F.count("*").alias("k")).where(f"k >= {OFTEN}")
    return [(r["x"], r["k"]) for r in got.orderBy(F.desc("k")).limit(MOST_FREQUENT).collect()]


def with_row_key(docs: DataFrame, file: str, at: str) -> tuple[DataFrame, DataFrame]:
    """docs as they can be read again, and the same with the file (a hash of its path) and the place of each row in it."""
    place = {file: F.xxhash64("_metadata.file_path"), at: F.col("_metadata.row_index")}
    try:
        return docs, docs.withColumns(place)
    except Exception as e:
        if "_metadata" not in str(e):
            raise
        docs = cut(docs, "documents")
        return docs, docs.withColumns(place)


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """docs without near copies: of each group the row of the smallest id stays, with its columns."""
    import numpy as np

    file_, at_ = fresh(docs.columns, "file"), fresh(docs.columns, "at")
    docs, whole = with_row_key(docs, file_, at_)
    keyed = whole.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(file_).alias("file"), F.col(at_).alias("at"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sure = lambda df: F.broadcast(df) if df.count() <= SMALL else df
    often = frequent(keyed, words)
    rows = cut(profiles(keyed, words, similarity, often), "profiles")
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "file", "at")
    first = rows.groupBy("node").agg(F.min(place).alias("m"))
    copies = cut(rows.select("node", "file", "at").join(first, "node").where("file <> m.file or at <> m.at").select("file", "at"), "copies")
    known = rows.withColumn("m", place)
    if copies.count() <= SMALL:
        known = known.join(F.broadcast(copies), ["file", "at"], "left_anti")
    else:
        known = cut(known.join(copies, ["file", "at"], "left_anti"), "known")
    facts = lambda k: known.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}"))
    size = F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-6
    most = (1 - similarity) / (1 + similarity) * (F.col("na") + F.col("nb")) + 1e-6  # shingles that only one of two alike sets has

    def folded(bits: str, to: str):
        """Parity bits as wide as those of `to`: bits that fall on one place are added up."""
        half = F.size(bits) / 2
        return F.when(F.size(bits) > F.size(to), F.zip_with(F.slice(bits, F.lit(1), half.cast("int")), F.slice(bits, half.cast("int") + 1, half.cast("int")), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(bits))

    differ = F.aggregate(F.zip_with(folded("bitsa", "bitsb"), folded("bitsb", "bitsa"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    roughly = sum((F.bit_count(F.col("coarsea")[k].bitwiseXOR(F.col("coarseb")[k])) for k in range(COARSE // 64)), F.lit(0))

    full: DataFrame | None = None  # the sets that were needed so far

    def verify(pairs: DataFrame) -> DataFrame | None:
        """The pairs (a, b) whose sets are alike."""
        nonlocal full
        pairs = cut(pairs, "pairs")
        if pairs.isEmpty():
            return None
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        new = ends if full is None else ends.join(full.select("node"), "node", "left_anti")
        new = cut(new.join(known.select("node", "m.file", "m.at"), "node"), "ends")
        more = cut(shingle_sets(keyed.join(sure(new), ["file", "at"]).select("node", "text"), words), "sets")
        full = more if full is None else full.unionAll(more)
        a = full.join(sure(pairs.select(F.col("a").alias("node")).distinct()), "node", "left_semi").select(F.col("node").alias("a"), F.col("s").alias("sa"))
        b = full.join(sure(pairs.withColumnRenamed("b", "node")), "node").select("a", F.col("node").alias("b"), F.col("s").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        held = cut(b.join(a, "a").where(both >= similarity * (F.size("sa") + F.size("sb") - both) - 1e-9).select("a", "b"), "held")
        return None if held.isEmpty() else held

    def plausible(pairs: DataFrame) -> DataFrame:
        return pairs.join(facts("a"), "a").join(facts("b"), "b").where(size).where(differ <= most).select("a", "b")

    held = roots = None

    def connect(pairs: DataFrame) -> None:
        nonlocal held, roots
        more = verify(pairs)
        if more is not None:
            held = more if held is None else held.unionAll(more)
            roots = components(held)

    def rooted(df: DataFrame) -> DataFrame:
        return df.withColumn("root", F.col("node")) if roots is None else df.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    # what SimHash finds: equal fingerprints and those within the radius, each by the least node of its fingerprint
    heads = cut(known.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    near = links(heads.select("fp"), RADIUS)
    head = lambda k: heads.select(F.col("fp").alias(k), F.col("head").alias(f"h{k}"))
    equal = known.select("fp", "node").join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    connect(plausible(equal.union(near.join(head("a"), "a").join(head("b"), "b").select("ha", "hb"))))

    # all others share a shingle of their prefixes
    def counted(prefixes: DataFrame) -> DataFrame:
        """shingle, nodes: what more than one node has."""
        return cut(prefixes.select(F.explode("prefix").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("nodes")).where("nodes > 1"), "counted")

    def meeting(prefixes: DataFrame, many: DataFrame) -> DataFrame:
        """shingle, node, n, pos: the nodes that have these shingles, and where in their prefixes."""
        slot = F.col("shingle").bitwiseAND(F.lit((1 << MAP) - 1))
        words_ = many.select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, cast(shingle & 63L as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        table = np.zeros(1 << (MAP - 6), dtype=np.int64)
        table[words_["word"].to_numpy()] = words_["bits"].to_numpy()
        sent = docs.sparkSession.sparkContext.broadcast(table)

        def run(batches):
            import pyarrow as pa

            bits = sent.value.view(np.uint64)
            for b in batches:
                prefix = b.column(2)
                s = prefix.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                many_ = prefix.value_lengths().to_numpy(zero_copy_only=False)
                who = np.repeat(np.arange(b.num_rows), many_)
                pos = np.arange(len(s)) - np.repeat(np.cumsum(many_) - many_, many_)
                keep = (bits[((s & np.uint64((1 << MAP) - 1)) >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63))) & np.uint64(1) > 0
                at = pa.array(who[keep])
                yield pa.RecordBatch.from_arrays([pa.array(s[keep].view(np.int64)), b.column(0).take(at), b.column(1).take(at), pa.array(pos[keep].astype(np.int64))], names=["shingle", "node", "n", "pos"])

        return cut(prefixes.select("node", "n", "prefix").mapInArrow(run, "shingle long, node long, n long, pos long").join(many.select("shingle"), "shingle"), "shared")

    def mixed(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Nodes of shingles that several components have, and these shingles with how many and a hub."""
        at = rooted(shared)
        hub = F.min(F.struct(F.xxhash64("node", F.lit(step)).alias("h"), "node", "root", "n")).alias("hub")
        each = at.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), hub, F.count("*").alias("nodes"))
        return at, cut(each.where("lo <> hi").select("shingle", "hub", "nodes"), "mixed")

    many = counted(known)
    loud = [(r["shingle"], r["nodes"]) for r in many.where(F.col("nodes") > hot).orderBy(F.desc("nodes")).limit(MOST_LOUD).collect()]
    prefixes = known
    if loud:  # they go last, which changes the prefixes that hold them only
        named = F.broadcast(docs.sparkSession.createDataFrame([(s,) for s, _ in loud], "shingle long"))
        changed = cut(known.select("node", F.explode("prefix").alias("shingle")).join(named, "shingle", "left_semi").select("node").distinct(), "changed")
        high = max((k for _, k in often), default=0)
        ends = cut(known.select("node", "doc_id", "file", "at").join(sure(changed), "node"), "ends")
        again = profiles(keyed.drop("doc_id").join(sure(ends.drop("node")), ["file", "at"]), words, similarity, list({**dict(often), **{s: high + k for s, k in loud}}.items()))
        prefixes = known.join(sure(changed), "node", "left_anti").select("node", "n", "prefix").unionByName(cut(again.select("node", "n", "prefix"), "again"))
        many = counted(prefixes)
    shared = meeting(prefixes, many)
    for step in range(ROUNDS):
        at, several = mixed(shared)
        pairs = at.join(several, "shingle").where("root <> hub.root").select(F.col("hub.node").alias("a"), F.col("node").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb"))
        connect(plausible(pairs.where(size).select("a", "b").distinct()))
    step = ROUNDS
    at, several = mixed(shared)
    before = F.lag("shingle").over(Window.partitionBy("node").orderBy("pos"))
    # some k nodes of a shingle have a place below k, the same nodes for shingles of the same nodes
    place_ = F.pmod(F.xxhash64("node", F.lit(step)), F.lit(1 << 30)) / (1 << 30) * F.col("nodes")
    left = cut(at.drop("root").join(several.select("shingle", "nodes"), "shingle").join(known.select("node", "coarse"), "node").withColumns({"before": before, "place": place_}).drop("nodes"), "left")
    start = F.coalesce(F.col("beforea") != F.col("beforeb"), F.lit(True))  # else they meet at the shingle before, too
    enough = F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb")) >= similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-6
    for low, high in zip((0, *SOME), (*SOME, None), strict=True):  # each pair meets at the step of its lesser place
        at = rooted(left.where(F.col("place") >= low))
        a, b = (at.select("shingle", F.col("node").alias(k), F.col("root").alias(f"r{k}"), *(F.col(c).alias(f"{c}{k}") for c in ("n", "pos", "before", "coarse", "place"))) for k in "ab")
        once = F.col("a") < F.col("b")
        if high is not None:
            a, once = a.where(F.col("placea") < high), once | (F.col("placeb") >= high)
        cross = (a["shingle"] == b["shingle"]) & once & (F.col("ra") != F.col("rb")) & size & start & enough & (roughly <= most)
        connect(plausible(a.join(b, cross).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))

    placed = rooted(known.select("node", "m"))
    stay = placed.groupBy("root").agg(F.min("m").alias("stays"))
    of = cut(placed.select("node", "root").join(stay, "root").select("node", F.col("stays.file").alias("f"), F.col("stays.at").alias("p")), "of")
    gone = cut(rows.select("node", "file", "at").join(of, "node").where("file <> f or at <> p").select(F.col("file").alias(file_), F.col("at").alias(at_)), "gone")
    return whole.join(sure(gone), [file_, at_], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
