"""A hierarchical Pitman-Yor language model over words.

A text's tokens are its words and one end. The restaurant of a context (the word before, or the start) serves words; its base
measure is the restaurant that all contexts share, whose own base is uniform over the known words and one for all others.
Seatings are sampled cell by cell (a context's customers that eat one word): a cell is seated anew customer by customer under
the rest of the state and taken by its weight, which is a Metropolis step within Gibbs sampling. Of a frequent cell's customers
those that join tables are drawn at once up to the next that opens one, from the same distribution. After each sweep the
restaurants' totals are gathered, so the next sees what all cells did. The sweeps after the first `BURN` are samples; a word's
probability is the mean of its predictive probabilities under each of them, and `perplexity` sums up scores.

Blocks of texts send each bucket of words what they hold of it: pairs of context and word, and the documents of each
occurrence. A bucket is stored once with all blocks' parts, in a bucketed table, so later passes don't shuffle it; it knows all
of its words. Every context has its own totals: buckets send what they hold of each to the register that has the context, and
get back the sums of the contexts that occur in them. Buckets answer with sums for each document of a block. No vocabulary,
of words or contexts, is ever held in one place. Frequent words, of a sample, have numbers of 16 bits by which parts name their
contexts; all others are named by their hashes. That is a way of writing only: which words have numbers changes no result.

Nulls: a null text is an end alone; null ids count as the empty text for the fold. Repeated rows each count. Without training
tokens every word is unknown and has probability 1; without rows the result is empty. Words are told apart by 64-bit hashes. Texts
of any length are whole: one may be a block of its own. There are no ties. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import bucketed, cut, give_back

#: Pairs of a part at most, so its contexts have numbers of 16 bits; a block's share of more is in several parts.
CLASSES = 1 << 16
#: Text of a block, and of all blocks' shares in a bucket.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
#: Words that have numbers, and text of the sample that tells which.
NUMBERED, SAMPLE_BYTES = 1 << 16, 32 << 20
SWEEPS, BURN = 3, 1
STRENGTH = (1.0, 1.0)  # of the shared restaurant and of contexts
SEED = 11
#: From so many customers of a cell on, a step is taken for each new table, not for each customer.
SINGLY = 64
#: Buckets for each register of contexts' totals.
SHARE = 4


def _pack(*arrays) -> bytes:
    import numpy as np

    head = np.array([len(a) for a in arrays], dtype="<i8")
    return head.tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpack(data: bytes, *kinds: str):
    import numpy as np

    head, at, out = np.frombuffer(data, dtype="<i8", count=len(kinds)), 8 * len(kinds), []
    for n, k in zip(head.tolist(), kinds, strict=True):
        out.append(np.frombuffer(data, dtype=k, count=n, offset=at))
        at += out[-1].nbytes
    return out


def _planes(a) -> bytes:
    """Numbers of eight bytes, all their first bytes first: sorted or small ones are compressed well."""
    import numpy as np

    return np.ascontiguousarray(a).view("u1").reshape(-1, 8).T.tobytes()


def _numbers(data: bytes, kind: str):
    import numpy as np

    return np.ascontiguousarray(np.frombuffer(data, dtype="u1").reshape(8, -1).T).view(kind).ravel()


def _write_names(names, numbered) -> tuple[bytes, "np.ndarray"]:
    """Sorted names in few bytes, given the sorted names that have numbers; and the place that each gets, as these come first."""
    import numpy as np
    import pyarrow as pa

    at = np.searchsorted(numbered, names)
    has = numbered[np.minimum(at, len(numbered) - 1)] == names if len(numbered) else np.zeros(len(names), dtype=bool)
    place = np.where(has, np.cumsum(has) - 1, has.sum() + np.cumsum(~has) - 1)
    gaps = np.diff(at[has], prepend=0).astype("<u2")
    raw = gaps.view("u1").reshape(-1, 2).T.tobytes() + _planes(names[~has])
    return _pack(np.array([len(gaps), len(raw)], dtype="<i8")) + pa.compress(raw, codec="zstd", asbytes=True), place


def _read_names(data: bytes, numbered):
    import numpy as np
    import pyarrow as pa

    (n, size), at = _unpack(data[:24], "<i8")[0].tolist(), 24
    raw = np.frombuffer(pa.decompress(data[at:], size, codec="zstd"), dtype="u1")
    gaps = np.ascontiguousarray(raw[: 2 * n].reshape(2, n).T).view("<u2").ravel()
    return np.concatenate([numbered[np.cumsum(gaps, dtype=np.int64)], _numbers(raw[2 * n :], "<u8")])


def _numbered(rows: DataFrame, volume: int):
    """The hashes, sorted, of words that a sample of texts has most often."""
    import numpy as np

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from xxhash import xxh64_intdigest

        for b in batches:
            got = pc.value_counts(pc.ascii_split_whitespace(pc.ascii_lower(b.column(0).fill_null(""))).flatten())
            h = np.array([xxh64_intdigest(x) for x in got.field(0).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), got.field(1).cast(pa.int64())], names=["h", "k"])
        give_back()

    part = rows.select("text") if volume <= SAMPLE_BYTES else rows.select("text").sample(SAMPLE_BYTES / volume, seed=SEED)
    often = part.mapInArrow(run, "h long, k long").groupBy("h").agg(F.sum("k").alias("k")).orderBy(F.desc("k"), "h").limit(NUMBERED)
    return np.sort(np.array([r["h"] for r in often.collect()], dtype=np.int64).view(np.uint64))


def _log_gamma(x):
    """Stirling's series, for x above 3."""
    import numpy as np

    y = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x


#: A block's part of a bucket: number of its documents, of those in training; words; pairs of each word; contexts; occurrences of each pair; their documents.
PART = ("<i8", "<u8", "<u4", "<u2", "<u4", "<u2")


def _press(part: bytes) -> bytes:
    """A part, smaller: what is shuffled and stored of it."""
    import numpy as np
    import pyarrow as pa

    arrays = _unpack(part, *PART)
    raw = part[: 8 * len(PART)] + b"".join(np.ascontiguousarray(a).view("u1").reshape(-1, a.itemsize).T.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _loose(data: bytes) -> bytes:
    import numpy as np
    import pyarrow as pa

    raw = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd"), dtype="u1")
    at, out = 8 * len(PART), [raw[: 8 * len(PART)].tobytes()]
    for n, size in zip(raw[:at].view("<i8").tolist(), (int(k[2:]) for k in PART), strict=True):
        out.append(raw[at : at + n * size].reshape(size, n).T.tobytes())
        at += n * size
    return b"".join(out)


def _blocks(docs: DataFrame, held: Column, keys: list[int], numbered) -> DataFrame:
    """bucket, block, part, the names of the part's contexts (as written with `numbered`, a broadcast); and under bucket -1 - block the block's documents."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        end, start = xxh64_intdigest(b" end"), xxh64_intdigest(b" start")
        task, made, buckets = TaskContext.get().partitionId(), 0, len(keys)

        def block(ids, texts, out):
            order = np.argsort(out, kind="stable")  # training documents first
            texts, ids, out = texts.take(pa.array(order)), ids.take(pa.array(order)), out[order]
            words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
            n = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = words.flatten().dictionary_encode()
            seen = flat.dictionary.cast(pa.binary()).to_pylist()
            ix = flat.indices.to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(n)), n)
            if b"" in seen:  # blanks at the ends
                keep = ix != seen.index(b"")
                ix, doc = ix[keep], doc[keep]
                n = np.bincount(doc, minlength=len(n))
            h = np.array([*map(xxh64_intdigest, seen), end, start], dtype=np.uint64)
            # tokens and contexts, each document with its end
            first = np.cumsum(n + 1) - (n + 1)
            at = np.arange(len(ix)) + doc
            w = np.full(len(ix) + len(n), len(seen), dtype=np.int64)
            w[at] = ix
            who = np.repeat(np.arange(len(n)), n + 1)
            rank = np.empty(len(h), dtype=np.int64)
            by = np.lexsort((h, h % np.uint64(buckets)))
            rank[by] = np.arange(len(h))
            u = np.empty(len(w), dtype=np.int64)
            u[1:] = rank[w[:-1]]
            u[first] = rank[-1]  # the start
            key = (rank[w] << 32) | u
            o = np.argsort(key, kind="stable")
            key, who = key[o], who[o]
            change = np.flatnonzero(np.diff(key)) + 1
            p0 = np.concatenate([[0], change])
            occ = np.diff(np.append(p0, len(key)))
            pw, pu = key[p0] >> 32, key[p0] & 0xFFFFFFFF
            hb = h[by]
            pb = (hb[pw] % np.uint64(buckets)).astype(np.int64)
            edge = np.flatnonzero(np.diff(pb)) + 1
            yield -1, _pack(np.asarray(ids.fill_null(0)).astype("<i8"), np.asarray(ids.is_null()).astype("<i1"), out.astype("<i1"), (n + 1).astype("<i8")), b""
            head = np.array([len(n), int((~out).sum())], dtype="<i8")
            cuts = [(x, min(x + CLASSES, b)) for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(pb)], strict=True) for x in range(a, b, CLASSES)]
            for a, b in cuts:
                own = pw[a:b]
                names, cu = np.unique(hb[pu[a:b]], return_inverse=True)
                written, place = _write_names(names, numbered.value)
                cu = place[cu]
                starts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
                lo, hi = p0[a], (p0[b] if b < len(p0) else len(key))
                yield int(pb[a]), _press(_pack(head, hb[own[starts]], np.diff(np.append(starts, b - a)).astype("<u4"), cu.astype("<u2"), occ[a:b].astype("<u4"), who[lo:hi].astype("<u2"))), written

        def gathered():
            """Batches put together up to a block's size, whatever the session's batches are; none leaves a small rest."""
            kept, size, rows = [], 0, 0
            for b in batches:
                if kept and (size + b.column(1).nbytes > BLOCK_BYTES or rows + b.num_rows > 60_000):
                    yield pa.concat_batches(kept)
                    kept, size, rows = [], 0, 0
                kept.append(b)
                size, rows = size + b.column(1).nbytes, rows + b.num_rows
            if kept:
                yield pa.concat_batches(kept)

        for b in gathered():
            ids, texts = b.column(0), b.column(1).fill_null("")
            out = np.asarray(b.column(2).to_pylist(), dtype=bool)
            size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            i = 0
            while i < len(texts):
                before = size[i - 1] if i else 0
                j = max(i + 1, min(int(np.searchsorted(size, before + BLOCK_BYTES)), i + 60_000, len(texts)))
                number = task << 32 | made
                made += 1
                parts = [(-1 - number if k < 0 else keys[k], p, u) for k, p, u in block(ids.slice(i, j - i), texts.slice(i, j - i), out[i:j])]
                for a in range(0, len(parts), 64):
                    some = parts[a : a + 64]
                    ks, ps, us = zip(*some, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array([number] * len(some), pa.int64()), pa.array(ps, pa.binary()), pa.array(us, pa.binary())], names=["bucket", "block", "part", "contexts"])
                i = j
        give_back()

    return docs.select("doc_id", "text", held.alias("held")).mapInArrow(run, "bucket long, block long, part binary, contexts binary")


def _keys(spark, buckets: int) -> list[int]:
    """A number for each bucket, each in a partition of its own when they are dealt by hash."""
    got = spark.range(24 * buckets, numPartitions=1).groupBy(F.pmod(F.hash("id"), F.lit(buckets)).alias("place")).agg(F.min("id").alias("id")).collect()
    at = {r["place"]: r["id"] for r in got}
    return [at.get(b, 24 * buckets + b) for b in range(buckets)]


class Bucket:
    """All that blocks hold of a bucket's words: cells, customers, and who they are."""

    def __init__(self, bucket: int, parts: list[bytes], contexts: list | None = None):
        """Contexts of parts are numbers into their part's names, which are `contexts` (arrays); without these, the same in all parts."""
        import numpy as np

        self.np = np
        got = [_unpack(p, *PART) for p in parts]
        self.heads = [g[0] for g in got]
        sizes = [len(g[3]) for g in got]
        self.w, wi = np.unique(np.concatenate([g[1] for g in got]), return_inverse=True)
        per = np.concatenate([g[2] for g in got]).astype(np.int64)
        cu = [g[3].astype(np.int64) for g in got]
        if contexts is not None:
            self.u, ui = np.unique(np.concatenate(contexts), return_inverse=True)
            first = np.cumsum([0, *map(len, contexts)])
            cu = [ui[a + x] for a, x in zip(first.tolist(), cu, strict=False)]
        key = (np.repeat(wi.astype(np.int64), per) << 32) | np.concatenate(cu)
        cells, self.pair = np.unique(key, return_inverse=True)
        self.cw, self.cu = cells >> 32, cells & 0xFFFFFFFF
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.occ, self.docs = [g[4].astype(np.int64) for g in got], [g[5] for g in got]
        c = np.zeros(len(cells))
        for k, g in enumerate(got):
            train = np.repeat(np.arange(sizes[k]), self.occ[k])[self.docs[k] < self.heads[k][1]]
            c += np.bincount(self.pair[self.at[k] : self.at[k + 1]], weights=np.bincount(train, minlength=sizes[k]), minlength=len(cells))
        self.c = c.astype(np.int64)
        self.count = np.bincount(self.cw, weights=c, minlength=len(self.w)).astype(np.int64)
        self.rng = np.random.default_rng([SEED, bucket])

    def seat(self, c, weight, grow, d):
        """Tables for c customers of each cell that come one after the other, with the log weight of the draw.

        A customer opens a table with weight `weight + grow * tables` (what the base gives), else joins one of those there.
        How many join until the next opens one is a Polya urn's waiting time, a geometric number whose chance is beta distributed;
        from SINGLY customers on it is drawn as such, so a frequent cell takes a step for each table.
        """
        np = self.np
        order = np.argsort(-c, kind="stable")
        cs, a, g = c[order], weight[order], grow[order]
        t, logw = (cs > 0).astype(np.float64), np.zeros(len(cs))
        up = -cs
        for i in range(1, SINGLY):
            n = int(np.searchsorted(up, -i, side="left"))  # cells of more than i customers
            if not n:
                break
            new = a[:n] + g[:n] * t[:n]
            z = new + i - d * t[:n]
            t[:n] += self.rng.random(n) * z < new
            logw[:n] += np.log(z)
        at = np.arange(int(np.searchsorted(up, -SINGLY, side="left")))
        seated = np.full(len(at), float(SINGLY))
        while len(at):
            new, old = a[at] + g[at] * t[at], seated - d * t[at]
            p = self.rng.beta(new, old)
            with np.errstate(divide="ignore"):
                join = np.floor(np.log1p(-self.rng.random(len(at))) / np.log1p(-np.maximum(p, 1e-300)))
            left = cs[at] - seated
            opens = join < left
            come = np.where(opens, join + 1, left)
            logw[at] += _log_gamma(new + old + come) - _log_gamma(new + old)
            t[at] += opens
            seated = seated + come
            more = seated < cs[at]
            at, seated = at[more], seated[more]
        out, w = np.empty(len(c)), np.empty(len(c))
        out[order], w[order] = t, logw
        return out, w

    def sample(self, states: list[tuple[dict, object]]):
        """The seating after each sweep: tables of each cell and, in the shared restaurant, customers and tables of each word.

        states has, for each sweep, the totals of all restaurants before it.
        """
        np = self.np
        s0, s1 = STRENGTH
        many = self.c > 1
        t = (self.c > 0).astype(np.float64)
        c, u, w = self.c[many], self.cu[many], self.cw[many]
        T, logw, out = (self.count > 0).astype(np.float64), None, []
        for state, tables in states:
            d0, d1 = state["d"]
            base = 1.0 / (state["V"] + 1)
            rest0 = np.full(len(self.w), (s0 + d0 * state["T"]) * base)
            C = np.bincount(self.cw, weights=t, minlength=len(self.w))
            root = (C - d0 * T + rest0) / (s0 + state["C"])
            own = t[many]
            a = (s1 + d1 * np.maximum(tables[u] - own, 0)) * root[w]
            new, lw = self.seat(c, a, d1 * root[w], d1)
            take = np.ones(len(c), dtype=bool) if logw is None else np.log(self.rng.random(len(c))) < lw - logw
            logw = np.where(take, lw, logw) if logw is not None else lw
            t[many] = np.where(take, new, own)
            C = np.bincount(self.cw, weights=t, minlength=len(self.w)).astype(np.int64)
            T, _ = self.seat(C, rest0, np.full(len(C), d0 * base), d0)
            out.append((t.copy(), C, T))
        return out

    def predict(self, states: list[tuple[dict, object]], customers, burn: int):
        """The mean predictive probability of each cell's word in its context; states as for `sample`, and the totals after the last sweep."""
        np = self.np
        s0, s1 = STRENGTH
        p, kept = np.zeros(len(self.c)), 0
        for k, (t, C, T) in enumerate(self.sample(states[:-1])):
            if k < burn:
                continue
            state, tables = states[k + 1]
            d0, d1 = state["d"]
            root = (C - d0 * T + (s0 + d0 * state["T"]) / (state["V"] + 1)) / (s0 + state["C"])
            p += (self.c - d1 * t + (s1 + d1 * tables[self.cu]) * root[self.cw]) / (s1 + customers[self.cu])
            kept += 1
        return p / kept


def _discount(n1: float, n2: float) -> float:
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5


def score(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each text; rows where `held` holds are not learned from."""
    import numpy as np

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held.alias("held"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4, -(-int(volume) // BUCKET_BYTES))
    registers = -(-buckets // SHARE)
    spark = docs.sparkSession
    numbered = spark.sparkContext.broadcast(_numbered(rows, int(volume)))
    sent = _blocks(rows, F.col("held"), _keys(spark, buckets), numbered)
    # bucketed, so a bucket meets its contexts' totals without being shuffled again
    store = bucketed(sent, "bucket", buckets, "buckets")
    held_in = store.where("bucket >= 0").groupBy("bucket")
    edges = np.array([-(-(r << 64) // registers) for r in range(1, registers)], dtype=np.uint64)
    scheme = "bucket long, register int, totals binary, sweep int"
    replies: list[DataFrame] = []

    def meet(work, schema: str) -> DataFrame:
        """What `work` makes of a bucket and the totals of its contexts that were gathered so far: customers, and tables after each sweep."""
        told = spark.createDataFrame([], scheme)
        for r in replies:
            told = told.unionByName(r.where("bucket >= 0"))

        def run(left, right):
            give_back()  # of the bucket before
            x = Bucket(left["bucket"][0].as_py(), [_loose(p.as_py()) for p in left["part"]], [_read_names(p.as_py(), numbered.value) for p in left["contexts"]])
            got: dict[int, dict] = {}
            for sweep, register, data in zip(right["sweep"].to_pylist(), right["register"].to_pylist(), right["totals"], strict=True):
                got.setdefault(sweep, {})[register] = _numbers(data.as_py(), "<i8")
            # the first has customers and tables of each register, later ones tables
            own = [[np.concatenate([v[r].reshape(2 if k == 0 else 1, -1)[i] for r in sorted(v)]) for i in range(2 if k == 0 else 1)] for k, v in sorted(got.items())]
            return work(left, x, own[0][0] if own else None, [o[-1] for o in own])

        return held_in.cogroup(told.groupBy("bucket")).applyInArrow(run, schema)

    def spread(states: list[dict]):
        """A pass over the buckets that sums up each context's customers (at first) and tables after these sweeps; numbers of its own."""

        def send(left, x, customers, tables):
            import pyarrow as pa

            if not states:
                t = (x.c > 0).astype(float)
                C = np.bincount(x.cw, weights=t, minlength=len(x.w))
                own = [x.count.sum(), (x.count > 0).sum(), (x.c == 1).sum(), (x.c == 2).sum(), C.sum(), (C == 1).sum(), (C == 2).sum()]
            else:
                t, C, T = x.sample(list(zip(states, tables, strict=True)))[-1]
                own = [C.sum(), T.sum()]
            sums = [np.bincount(x.cu, weights=v, minlength=len(x.u)).astype("<i8") for v in ([t] if states else [x.c, t])]
            at = [0, *np.searchsorted(x.u, edges).tolist(), len(x.u)]
            out = [(r, _planes(x.u[a:b]), _planes(np.concatenate([v[a:b] for v in sums]))) for r, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
            out.append((-1, b"", _planes(np.array(own).astype("<i8"))))
            r, names, totals = zip(*out, strict=True)
            return pa.table([pa.array(r, pa.int32()), pa.array([left["bucket"][0].as_py()] * len(r), pa.int64()), pa.array(names, pa.binary()), pa.array(totals, pa.binary())], names=["register", "bucket", "names", "totals"])

        def total(t):
            import pyarrow as pa

            register, got = t["register"][0].as_py(), [_numbers(x.as_py(), "<i8") for x in t["totals"]]
            if register < 0:
                to, data = [-1], [_planes(np.sum(got, axis=0))]
            else:
                names = [_numbers(x.as_py(), "<u8") for x in t["names"]]
                _, which = np.unique(np.concatenate(names), return_inverse=True)
                kinds = len(got[0]) // len(names[0])
                sums = [np.bincount(which, weights=np.concatenate([g.reshape(kinds, -1)[i] for g in got]))[which].astype("<i8") for i in range(kinds)]
                at = np.cumsum([0, *map(len, names)]).tolist()
                to, data = t["bucket"].to_pylist(), [_planes(np.concatenate([v[a:b] for v in sums])) for a, b in zip(at, at[1:], strict=False)]
            return pa.table([pa.array(to, pa.int64()), pa.array([register] * len(to), pa.int32()), pa.array(data, pa.binary())], names=["bucket", "register", "totals"])

        sums = meet(send, "register int, bucket long, names binary, totals binary").groupBy("register").applyInArrow(total, "bucket long, register int, totals binary")
        replies.append(cut(sums.withColumn("sweep", F.lit(len(replies))), "totals", "zstd"))
        got = replies[-1].where("bucket < 0").first()
        return _numbers(bytes(got["totals"]), "<i8").tolist() if got else [0] * 7

    N, V, n1, n2, C, m1, m2 = spread([])
    states = [{"V": float(V), "C": float(C), "T": float(V), "d": (_discount(m1, m2), _discount(n1, n2))}]
    for _ in range(SWEEPS if N else 0):
        C, T = spread(list(states))
        states.append(states[0] | {"C": float(C), "T": float(T)})

    def answer(left, x, customers, tables):
        import pyarrow as pa

        p = x.predict(list(zip(states, tables, strict=True)), customers, BURN) if N else np.ones(len(x.c))
        logp, known = np.log10(p), (x.count > 0)[x.cw]
        base = np.log10(x.count + 0.1)[x.cw]
        data = []
        for k in range(len(x.docs)):
            cell = x.pair[x.at[k] : x.at[k + 1]]
            who, n = x.docs[k], int(x.heads[k][0])
            full = np.repeat(cell, x.occ[k])
            sums = [np.bincount(who, weights=v[full], minlength=n) for v in (base, logp, known.astype(float))]
            touched = np.flatnonzero(np.bincount(who, minlength=n)).astype("<u2")
            data.append(_pack(touched, *(s[touched].astype(kind) for s, kind in zip(sums, ("<f8", "<f8", "<u4"), strict=True))))
        return pa.table([left["block"].combine_chunks(), pa.array([False] * len(data)), pa.array(data, pa.binary())], names=["block", "names", "part"])

    def gather(t):
        import pyarrow as pa

        who = next(p for n, p in zip(t["names"].to_pylist(), t["part"].to_pylist(), strict=True) if n)
        ids, gone, out, tokens = _unpack(who, "<i8", "<i1", "<i1", "<i8")
        sums = np.zeros((3, len(ids)))
        for n, p in zip(t["names"].to_pylist(), t["part"].to_pylist(), strict=True):
            if not n:
                at, *v = _unpack(p, "<u2", "<f8", "<f8", "<u4")
                for k in range(3):
                    sums[k, at] += v[k]
        base = sums[0] - tokens * np.log10(N + 0.1 * (V + 1))
        return pa.table([pa.array(ids, mask=gone > 0), pa.array(out > 0), pa.array(tokens), pa.array(sums[2].astype(np.int64)), pa.array(np.full(len(ids), int(N))), pa.array(base), pa.array(sums[1])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    answers = meet(answer, "block long, names boolean, part binary")
    names = store.where("bucket < 0").select("block", F.lit(True).alias("names"), "part")
    return answers.unionByName(names).groupBy("block").applyInArrow(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, n_tokens, perplexity of the texts that `score` gave."""
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"))
