"""Nearest neighbours by multi-index hashing over learned binary codes.

Codes: the vectors' principal axes, rotated several times so that signs lose least (iterative quantisation, each rotation from
its own start), give `rotations` x dimension bits. A code is split into 16-bit substrings, each with a table from every value to
the codes that have it. Two codes within radius r differ in at most t_j bits of some substring j if sum(t_j + 1) > r, so looking
up all values within t_j of the query's in each table retrieves every code within r; a query's radius starts from what the last
one needed and grows until `enough` codes of the block lie within it. Those are ranked by inner products of the original vectors
in double precision. How many codes a probe touches depends on the radius: few where neighbours are near, most where they are
nearly as far as random vectors, as no table of substrings tells such apart.

Equal vectors are one entry with its smallest k + 1 ids, which is all that any answer can hold of them. Entries are dealt at
random to blocks of 65,536 and queries to blocks of their own. Each block of entries meets each block of queries once and builds
its tables there, some thousandths of what its queries cost; entries are sent once for every 16,384 queries, and a query's best are
merged by its key. Every row is indexed; only the rotations are fitted on a sample of at most `SAMPLE` rows.

Nulls: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows of a null id or of another
length than the most frequent one. A row repeated with the same vector counts once; an id with two vectors is no neighbour of
itself. Ties go to smaller ids. Without queries or rows the result is empty. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import cut

SAMPLE = 20_000
ROTATIONS = 4
BLOCK, QUERY_BLOCK = 65_536, 16_384
#: Codes of a block that a query's radius takes in at least.
ENOUGH = 500
PART = 16


def fit(x, rotations: int = ROTATIONS, steps: int = 8, seed: int = 0):
    """The mean and a matrix (dimension x bits) whose signs are the code."""
    import numpy as np

    x = np.asarray(x, dtype=np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean, d = x.mean(axis=0), x.shape[1]
    c = x - mean
    _, axes = np.linalg.eigh(c.T @ c / max(len(x), 1))
    p = c @ axes
    rng, out = np.random.default_rng(seed), []
    for _ in range(rotations):
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(steps):
            u, _, v = np.linalg.svd(np.where(p @ r > 0, 1.0, -1.0).T @ p)
            r = (u @ v).T
        out.append(axes @ r)
    m = np.concatenate(out, axis=1)
    pad = -m.shape[1] % 64
    return mean, np.concatenate([m, rng.normal(size=(d, pad))], axis=1) if pad else m


def encode(x, mean, matrix):
    """Codes as rows of 64-bit words."""
    import numpy as np

    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.packbits((x - mean) @ matrix > 0, axis=1, bitorder="little").view("<u8")


def near_values() -> tuple:
    """All 16-bit patterns, those of fewer bits first, and how many have up to 0, 1, .. bits."""
    import numpy as np

    x = np.arange(1 << PART, dtype=np.uint32)
    bits = np.bitwise_count(x)
    return x[np.argsort(bits, kind="stable")], np.cumsum(np.bincount(bits))


class Index:
    """Substring tables of a block of codes: for each value the codes that have it."""

    def __init__(self, codes):
        import numpy as np

        self.np, self.codes = np, codes
        self.n, self.parts = len(codes), codes.view("<u2").reshape(len(codes), -1)
        self.m = self.parts.shape[1]
        self.flips, self.many = near_values()
        self.tables, self.looked, self.touched = [], 0, 0
        for j in range(self.m):
            v = self.parts[:, j]
            first = np.concatenate([[0], np.cumsum(np.bincount(v, minlength=1 << PART))])
            self.tables.append((first, np.argsort(v, kind="stable")))

    def thresholds(self, radius: int) -> list[int]:
        """t_j with sum(t_j + 1) = radius + 1."""
        base, more = divmod(radius + 1, self.m)
        return [min(PART, base + (j < more) - 1) for j in range(self.m)]

    def within(self, query, radius: int):
        """All codes within the radius and their distances."""
        np = self.np
        seen = np.zeros(self.n, dtype=bool)
        for v, t, (first, order) in zip(query.view("<u2").tolist(), self.thresholds(radius), self.tables, strict=True):
            if t < 0:
                continue
            values = self.flips[: self.many[t]] ^ np.uint32(v)
            a = first[values]
            size = first[values + 1] - a
            hit = size > 0
            a, size = a[hit], size[hit]
            self.looked += len(values)
            at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
            seen[order[at]] = True
        at = np.flatnonzero(seen)
        self.touched += len(at)
        d = np.bitwise_count(self.codes[at] ^ query).sum(axis=1, dtype=np.int64)
        keep = d <= radius
        return at[keep], d[keep]

    def search(self, query, enough: int, radius: int):
        """The codes within the least radius of a growing row of them that takes in `enough`; and that radius."""
        bits = PART * self.m
        while True:
            at, d = self.within(query, radius)
            if len(at) >= min(enough, self.n) or radius >= bits:
                return at, radius
            radius = min(bits, radius + max(2, bits // 64))


def valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).where("vec_id is not null and v is not null")
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists("v", lambda x: x != 0))


def neighbours(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", rotations: int = ROTATIONS, enough: int = ENOUGH, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for the rows where `is_query` (a condition on vec_id) holds."""
    import numpy as np

    spark, schema = df.sparkSession, "query_id long, rank int, vec_id long, score double"
    rows = valid(df, id_col, vec_col)
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], schema)
    d = dims[0]["d"]
    rows = cut(rows.where(F.size("v") == d).distinct(), "vectors")
    n = rows.count()
    share = min(1.0, 0.9 * SAMPLE / n)
    sample = rows.where(F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).limit(SAMPLE).select("v").toArrow()["v"].to_numpy()
    x = np.stack(sample).astype(np.float64) if len(sample) else np.eye(d)
    mean, matrix = fit(x, rotations)
    bits = matrix.shape[1]
    # the radius at which codes take in about `enough` of the sample's share, as a start
    codes = encode(x, mean, matrix)
    probe = codes[:: max(1, len(codes) // 50)]
    dist = np.sort(np.stack([np.bitwise_count(codes ^ q).sum(axis=1) for q in probe]), axis=1)
    start = int(np.median(dist[:, min(len(codes) - 1, max(1, int(enough * len(codes) / block)))])) if len(codes) else bits // 4
    model = spark.sparkContext.broadcast((mean, matrix, max(4, start - bits // 32)))
    w = Window.partitionBy("v").orderBy("vec_id")
    # smallest ids of each vector: the row limit reaches below the shuffle, so a frequent vector is cut down where it lies
    few = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    few = cut(few.withColumn("e", F.monotonically_increasing_id()), "entries")
    queries = rows.where(is_query(F.col("vec_id")))
    asked = cut(queries.select("v").distinct().withColumn("q", F.monotonically_increasing_id()), "asked")
    n_few, n_asked = few.count(), asked.count()
    blocks, cores = max(1, -(-n_few // block)), spark.sparkContext.defaultParallelism
    # smaller blocks of queries where there are too few for all cores
    q_blocks = max(1, -(-n_asked // query_block), min(-(-n_asked // 256), -(-cores // blocks)))
    deal = lambda c, m, salt: F.pmod(F.xxhash64(F.lit(salt), c), F.lit(m)).cast("int")
    entries = few.withColumn("b", deal("e", blocks, 1)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    ask = asked.withColumn("qb", deal("q", q_blocks, 2)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def answer(left, right):
        import pyarrow as pa

        mean, matrix, radius = model.value
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            mat = lambda t: t["v"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(t.num_rows, -1)
            x, q = mat(left), mat(right)
            index, codes, ids = Index(encode(x, mean, matrix)), encode(q, mean, matrix), left["ids"].to_pylist()
            least = np.array([i[0] for i in ids])
            for i, key in enumerate(right["q"].to_pylist()):
                at, r = index.search(codes[i], enough, radius)
                radius = max(4, radius - 2) if r == radius and len(at) > 2 * enough else r
                score = (x[at] * q[i]).sum(axis=1)
                top = np.lexsort((least[at], -score))[: k + 1]
                pairs = sorted((-s, v) for a, s in zip(at[top].tolist(), score[top].tolist(), strict=True) for v in ids[a])[: k + 1]
                out[0] += [key] * len(pairs)
                out[1] += [v for _, v in pairs]
                out[2] += [-s for s, _ in pairs]
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["q", "vec_id", "score"])

    got = entries.groupBy("b", "qb").cogroup(ask.groupBy("b", "qb")).applyInArrow(answer, "q long, vec_id long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = got.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i")))).alias("near"))
    found = cut(asked.join(found, "q"), "found")
    each = queries.select(F.col("vec_id").alias("query_id"), "v").join(found.select("v", "near"), "v")
    own = F.slice(F.filter("near", lambda x: x["i"] != F.col("query_id")), 1, k)
    return each.select("query_id", F.posexplode(own).alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))
