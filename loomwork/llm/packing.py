"""Best-fit packing with bounds that certify each partition's number of sequences.

Documents longer than a sequence are cut into full pieces, the first may be shorter. Pieces are dealt at random to groups of
a bounded size; each group runs best-fit decreasing and computes lower bounds by dual feasible functions. A group that meets
its bound is certified and closed. Otherwise its full sequences close, and the documents of sequences with gaps are
exchanged: they are dealt anew over fewer groups and packed again, together with those of other groups. A rerun that needs
no fewer sequences than the documents came with keeps them as they were.

Nulls: a null text counts as empty, a null id is kept. Empty texts are documents of the end id alone. Repeated rows are
packed as often as they occur. Without rows there are no sequences. Further columns of documents are ignored;
items keep theirs. Texts of any length are cut whole. Pieces of like size are packed in the order in which they came.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.common import cut, fresh
from loomwork.llm.tokens import default_path, encoder

#: Pieces of a group: it must fit in one worker's memory and is packed in one go.
GROUP = 32_768
ROUNDS = 4
#: Groups are this many times fewer in each following round.
SHRINK = 8

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32."""
    path = path or default_path()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc, end = encoder(path), np.asarray([end_id], dtype="<u4").tobytes()
        for b in batches:
            out = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = enc.ids(text.as_py()) + end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    for col, v in zip(out, (doc, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])), strict=True):
                        col.append(v)
                    at, k = at + size, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECE)


def lower_bound(counts, capacity: int) -> int:
    """The best of several dual feasible functions over a histogram of sizes (counts[s] items of size s).

    Each maps sizes so that what fits in one sequence sums to 1 at most; the rounded-up sum is then a bound. Taken here:
    the thresholds t (sizes over capacity - t count whole, those under t not at all) and the staircases
    floor((k + 1) x) / k, which keep x where (k + 1) x is whole.
    """
    import numpy as np

    counts = np.asarray(counts, dtype=np.int64)[: capacity + 1]
    if not counts[1:].sum():
        return 0
    size = np.arange(capacity + 1, dtype=np.int64)
    many, mass = np.cumsum(counts), np.cumsum(counts * size)
    t = np.arange(0, capacity // 2 + 1)
    whole = many[-1] - many[capacity - t]
    middle = mass[capacity - t] - np.where(t > 0, mass[np.maximum(t - 1, 0)], 0)
    best = int(np.max(-(-(whole * capacity + middle) // capacity)))
    for k in range(1, 33):
        step = (k + 1) * size
        exact = step % capacity == 0
        # in units of 1 / (k * capacity)
        worth = np.where(exact, size * k, (step // capacity) * capacity)
        best = max(best, -(-int((counts * worth).sum()) // (k * capacity)))
    return best


def best_fit(sizes, capacity: int):
    """Best-fit decreasing: the sequence and offset of each size, and the number of sequences."""
    import numpy as np

    order = np.argsort(-np.asarray(sizes), kind="stable")
    bins, offs = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # sequences by what is left in them
    open_, used = 0, 0  # bit g: some sequence has g left
    for i in order.tolist():
        s = int(sizes[i])
        fit = open_ >> s
        if fit:
            g = s + (fit & -fit).bit_length() - 1
            b = free[g].pop()
            if not free[g]:
                open_ &= ~(1 << g)
        else:
            g, b = capacity, used
            used += 1
        bins[i], offs[i] = b, capacity - g
        if g > s:
            free[g - s].append(b)
            open_ |= 1 << (g - s)
    return bins, offs, used


def pack(items: DataFrame, capacity: int = 1024, group: int = GROUP, rounds: int = ROUNDS, size_col: str = "length") -> DataFrame:
    """items with sequence_id and offset, which replace columns of these names. Sizes are from 1 to capacity; each row is an item.

    Also returned: `certified`, true if the row's group met its lower bound when its sequence was closed.
    """
    items = items.drop("sequence_id", "offset", "certified")
    part, closed_ = fresh(items.columns, "part"), fresh(items.columns, "closed")
    fields = [*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("certified", T.BooleanType())]
    schema, state = T.StructType(fields), T.StructType([*fields, T.StructField(closed_, T.BooleanType())])
    base = cut(items.withColumn("sequence_id", F.monotonically_increasing_id()), "items")
    full = F.col(size_col) >= capacity
    done = base.where(full).select(*items.columns, "sequence_id", F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    left = base.where(~full).withColumn("offset", F.lit(0).cast("long"))
    n = left.count()
    groups = max(1, -(-n // group))
    def packer(r: int, last: bool):
        def run(key, t):
            import numpy as np
            import pyarrow as pa

            sizes = t.column(size_col).to_numpy()
            was, where = t.column("sequence_id").to_numpy(), t.column("offset").to_numpy()
            known, old = np.unique(was, return_inverse=True)
            bins, offs, used = best_fit(sizes, capacity)
            if used >= len(known):
                bins, offs, used, ids = old, where, len(known), was
            else:
                ids = -1 - ((r << 56) | (key[0].as_py() << 24) | bins)
            bound = lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
            certified = used <= bound
            fill = np.bincount(bins, weights=sizes)
            closed = np.full(len(sizes), True) if certified or last else fill[bins] >= capacity
            t = t.drop_columns([part, "sequence_id", "offset"])
            for name, v in (("sequence_id", ids), ("offset", offs), ("certified", np.full(len(sizes), certified)), (closed_, closed)):
                t = t.append_column(name, pa.array(v))
            return t

        return run

    for r in range(rounds):
        if not n:
            break
        last = r == rounds - 1 or (r > 0 and groups == 1)

        # the sequence id as key keeps what shares a sequence together from the second round on
        dealt = left.withColumn(part, F.pmod(F.xxhash64(F.col("sequence_id"), F.lit(r)), F.lit(groups)))
        got = cut(dealt.groupBy(part).applyInArrow(packer(r, last), state), "packed")
        done = done.unionByName(got.where(F.col(closed_)).select(*schema.names))
        if last:
            break
        left = got.where(~F.col(closed_)).drop("certified", closed_)
        n = left.count()
        groups = max(1, min(-(-n // group), -(-groups // SHRINK)))
    return done.select(*schema.names)


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None, group: int = GROUP) -> DataFrame:
    """Tokenizes, cuts and packs: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified."""
    return pack(pieces(docs, capacity, end_id, path), capacity, group)
