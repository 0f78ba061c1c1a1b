"""SimHash near-duplicates by the generalised pigeonhole principle.

Distinct fingerprints alone take part in the search, so copies cost nothing. Correlated bits are grouped into partitions; a
dynamic program gives each partition its own threshold t_i with sum(t_i) = radius - partitions + 1, so that two fingerprints
within the radius agree up to t_i bits on some partition i. Costs are rows sent out plus candidates, estimated from the
frequencies of all fingerprints' bits; the number of partitions is chosen by the same costs. A fingerprint goes to its own
value of partition i and to all values within t_i bits; what meets is verified over all 64 bits. Groups that meet send on only
links that connect them (a walk over the group), never all pairs.

Nulls: a null text has no words, fingerprint zero, and links like any other; a null id keeps its row and takes part in links,
but is never a component's id (a component of null ids only has a null id). Repeated rows are returned as often as they occur.
Texts of any length are whole; a bit that half of the shingles have is not set. Without rows the result is empty. Further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import cut, give_back
from loomwork.llm.graph import components

BITS = 64
#: A candidate pair's cost beside that of a row sent out.
PAIR_COST = 0.1
#: Partitions' thresholds sum to this at most, and a fingerprint has so many probes.
MOST_ABOVE = 6
MOST_PROBES = 700
#: Runs up to this length compare all their pairs at once; longer ones are walked.
SHORT = 24
#: Runs longer than this are dealt over further blocks of bits first.
LONG = 20_000


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", also: str = "") -> DataFrame:
    """doc_id, fp (64 bits in a long): bit b is set if over half of the shingles' XXH64 have it set. also: further columns "name type, .."."""
    more = [x.split()[0] for x in also.split(", ")] if also else []

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
        find = re.compile(rb"[^\x20\x09-\x0d]+").findall
        weights = np.uint64(1) << np.arange(64, dtype=np.uint64)

        def of(text: bytes) -> int:
            w = find(text.translate(low))
            if not w:
                return 0
            whole = b" ".join(w)
            if len(w) <= words:
                return xxh64_intdigest(whole, seed)
            ends = np.cumsum([len(x) + 1 for x in w])
            starts = np.concatenate([[0], ends[:-1]])
            ends = ends[words - 1 :] - 1
            counts, n = np.zeros(64, dtype=np.int64), len(ends)
            for i in range(0, n, 1 << 16):
                h = [xxh64_intdigest(whole[a:b], seed) for a, b in zip(starts[i : i + (1 << 16)].tolist(), ends[i : i + (1 << 16)].tolist(), strict=False)]
                bits = np.unpackbits(np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                counts += bits.sum(axis=0, dtype=np.int64)
            return int(weights[2 * counts > n].sum())

        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fp = np.array([of(x.as_py() or b"") for x in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *(b.column(2 + k) for k in range(len(more)))], names=["doc_id", "fp", *more])
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more).mapInArrow(run, "doc_id long, fp long" + (also and ", " + also))


def bit_statistics(fps: DataFrame):
    """How many fingerprints there are, and how often bits i and j are both set: 64 x 64 sums, counted where the rows are."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            v = b.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(v), 1 << 16):
                m = np.unpackbits(v[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += m.T @ m
                n += len(m)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([np.append(total.ravel(), n).tolist()], pa.list_(pa.float64()))], names=["s"])

    part = fps.select("fp").mapInArrow(run, "s array<double>")
    rows = part.select(F.posexplode("s").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()  # 4097 sums
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r["k"]] = r["v"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, both, m: int) -> list[list[int]]:
    """m groups of like size; each takes in turn the bit that correlates most with those it has."""
    import numpy as np

    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    free, groups = set(range(BITS)), [[] for _ in range(m)]
    for k in range(BITS):
        g = groups[k % m]
        nxt = max(sorted(free), key=lambda b: (round(float(sum(corr[b, x] for x in g)), 9), -b) if g else (-b,))
        g.append(nxt)
        free.remove(nxt)
    return [sorted(g) for g in groups]


def within(p, bits: list[int], most: int) -> list[float]:
    """Chance that two fingerprints differ in at most 0, 1, .. of these bits, if bits are independent."""
    import numpy as np

    d = np.zeros(most + 1)
    d[0] = 1
    for b in bits:
        q = 2 * p[b] * (1 - p[b])
        d = d * (1 - q) + np.concatenate([[0], d[:-1]]) * q
    return np.cumsum(d).tolist()


def plan(n: int, both, radius: int) -> tuple[list[list[int]], list[int]]:
    """The groups of bits and their thresholds (-1: not searched) of least estimated cost."""
    from math import comb

    import numpy as np

    n = max(n, 1)
    p, best = np.diag(both) / n, None
    for m in range(1, min(radius + 1, BITS) + 1):
        groups, total = group_bits(n, both, m), radius - m + 1
        if total > MOST_ABOVE:  # too many probes to be of use
            continue
        most = max(total, 0) + m - 1
        cost = []
        for g in groups:
            chance = within(p, g, most)
            cost.append([0.0] + [n * sum(comb(len(g), k) for k in range(t + 1)) + PAIR_COST * n * n / 2 * chance[t] for t in range(most + 1)])
        # least cost of the first groups for each sum of (threshold + 1)
        table: list[dict[int, tuple[float, list[int]]]] = [{0: (0.0, [])}]
        for c in cost:
            row: dict[int, tuple[float, list[int]]] = {}
            for s, (x, ts) in table[-1].items():
                for t in range(-1, most + 1):
                    y = (x + c[t + 1], [*ts, t])
                    if s + t + 1 <= total + m and (s + t + 1 not in row or y[0] < row[s + t + 1][0]):
                        row[s + t + 1] = y
            table.append(row)
        x, ts = table[-1][total + m]
        sent = sum(comb(len(g), k) for g, t in zip(groups, ts, strict=True) for k in range(t + 1))
        if sent > MOST_PROBES:
            continue
        if best is None or x < best[0]:
            best = (x, groups, ts)
    return best[1], best[2]


def mask(bits) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """fps(fp), distinct -> (a, b): verified links that connect all fingerprints within the radius, directly or by others."""
    import numpy as np

    n, both = bit_statistics(fps)
    groups, ts = plan(n, both, radius)
    probes = [F.struct(F.lit(i).alias("part"), F.lit(mask(g)).alias("mask"), F.lit(mask(flip)).alias("flip"), F.lit(k == 0).alias("own")) for i, (g, t) in enumerate(zip(groups, ts, strict=True)) for k in range(t + 1) for flip in combinations(g, k)]
    sent = fps.select("fp", F.explode(F.array(*probes)).alias("p")).select(F.col("p.part").alias("part"), (F.col("fp").bitwiseAND(F.col("p.mask")).bitwiseXOR(F.col("p.flip"))).alias("value"), "fp", F.col("p.own").alias("own"))
    parts = max(fps.sparkSession.sparkContext.defaultParallelism, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sent = sent.repartition(parts, "part", "value").sortWithinPartitions("part", "value")

    def run(batches):
        import pyarrow as pa

        def walk(v):
            """Links along which a breadth-first walk meets all fingerprints of v that are within the radius of another."""
            rest, found = v, []
            while len(rest) > 1:
                todo, rest = [rest[0]], rest[1:]
                while todo and len(rest):
                    x = todo.pop()
                    near = np.bitwise_count(rest ^ x) <= radius
                    if near.any():
                        y = rest[near]
                        found.append((np.full(len(y), x), y))
                        todo += list(y)
                        rest = rest[~near]
            return found

        blocks = [np.uint64(sum(1 << b for b in range(j, 64, radius + 1))) for j in range(radius + 1)]

        def large(v):
            v = np.unique(v)
            if len(v) <= LONG:
                return walk(v)
            # two within the radius agree on one of radius + 1 blocks
            found = []
            for block in blocks:
                keys = v & block
                order = np.argsort(keys, kind="stable")
                for run_ in np.split(v[order], np.flatnonzero(np.diff(keys[order])) + 1):
                    if len(run_) > 1:
                        found += walk(run_)
            return found

        def join(part, value, fp, own):
            new = np.concatenate([[True], (part[1:] != part[:-1]) | (value[1:] != value[:-1])])
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(part)))
            found = []
            for k in np.flatnonzero(size > SHORT):
                s = slice(start[k], start[k] + size[k])
                if own[s].any():
                    found += large(fp[s])
            # short runs: each row with the rows before it, one step further each time
            run_size = np.repeat(np.where(size > SHORT, 0, size), size)
            place = np.arange(len(part)) - np.repeat(start, size)
            at = np.flatnonzero((run_size > 1) & (place > 0))
            d = 1
            while len(at):
                a, b = fp[at], fp[at - d]
                hit = (own[at] | own[at - d]) & (a != b) & (np.bitwise_count(a ^ b) <= radius)
                if hit.any():
                    found.append((a[hit], b[hit]))
                d += 1
                at = at[place[at] >= d]
            if not found:
                return None
            a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0].view(np.int64)), pa.array(pairs[1].view(np.int64))], names=["a", "b"])

        kept: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.asarray(batch.column(3).to_pylist(), dtype=bool)
            cols = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64), own)
            # the last run may go on in the next batch
            changes = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
            first_differs = bool(kept) and (kept[-1][0][-1] != cols[0][0] or kept[-1][1][-1] != cols[1][0])
            if len(changes) or first_differs:
                c = changes[-1] + 1 if len(changes) else 0
                now = [np.concatenate([*(k[i] for k in kept), cols[i][:c]]) for i in range(4)]
                if len(now[0]) > 1 and (got := join(*now)) is not None:
                    yield got
                kept = [tuple(x[c:] for x in cols)]
            else:
                kept.append(cols)
        if kept:
            now = [np.concatenate([k[i] for k in kept]) for i in range(4)]
            if len(now[0]) > 1 and (got := join(*now)) is not None:
                yield got

    return sent.select("part", "value", "fp", "own").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the smallest id among all documents reachable over links, itself included."""
    rows = cut(fingerprints(docs, words, id_col=id_col, text_col=text_col), "fp")
    return group_fingerprints(rows, radius)


def group_fingerprints(rows: DataFrame, radius: int = 4) -> DataFrame:
    """rows(doc_id, fp) on stable storage -> the same with component_id."""
    known = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "known")
    roots = components(links(known.select("fp"), radius)).withColumnRenamed("node", "fp")
    placed = known.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = cut(placed.select("fp", "root").join(least, "root").select("fp", "component_id"), "of")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp) -> "F.Column":
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
