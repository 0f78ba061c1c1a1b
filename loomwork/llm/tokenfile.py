"""Token ids on disk: concatenated ids with Elias-Fano coded document boundaries.

A shard holds a run of documents in ascending id order: their ids one after the other as unsigned 16- or 32-bit integers,
the documents' end positions in Elias-Fano form, and the document ids as signed 64-bit differences. Shards are binary records
of Parquet files, so they are written by Spark's commit protocol to any file system that Spark reaches and survive lost
executors; (part, shard) orders them. A boundary costs 2 + log2(ids / documents) bits, and `select` finds one through samples
of the upper bits without a table of 64-bit offsets.

Nulls: a null text counts as empty, null document ids come first. An empty text is one end id. Equal document ids are ordered
by a hash of the text and repeated rows all stay. Texts of any length are whole; a shard closes after the document
that fills it. No rows: no shards. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm.common import new_path
from loomwork.llm.tokens import default_path, encoder

SHARD = "part int, shard int, n_docs long, n_ids long, width int, ids binary, ends_low binary, ends_high binary, low_bits int, doc_ids binary, no_id long"
#: A shard closes at so many ids: 16 MB at two bytes each.
SHARD_IDS = 8_000_000
#: Shards up to which their places (some 30 bytes each) are broadcast.
SMALL = 500_000
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence: `low_bits` of each value as they are, the rest in unary; every SAMPLE-th one bit is indexed."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes):
        import numpy as np

        self.np, self.n, self.low_bits = np, n, low_bits
        self.low = np.frombuffer(low, dtype=np.uint8)
        self.high = np.frombuffer(high, dtype=np.uint8)
        ones = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)
        # the byte that holds each sampled one bit
        self.sample = np.searchsorted(ones, np.arange(1, n + 1, SAMPLE))
        self.before = np.where(self.sample > 0, ones[np.maximum(self.sample - 1, 0)], 0) if n else np.zeros(0, dtype=np.int64)

    @classmethod
    def encode(cls, values) -> tuple[int, bytes, bytes]:
        import numpy as np

        v = np.asarray(values, dtype=np.int64)
        n = len(v)
        if not n:
            return 0, b"", b""
        low_bits = max(0, int(v[-1]) // n).bit_length() - 1 if int(v[-1]) >= n else 0
        low_bits = max(0, low_bits)
        up = (v >> low_bits) + np.arange(n)
        bits = np.zeros(int(up[-1]) + 1, dtype=np.uint8)
        bits[up] = 1
        lows = ((v[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).ravel()
        return low_bits, np.packbits(lows, bitorder="little").tobytes(), np.packbits(bits, bitorder="little").tobytes()

    def _low(self, i: int) -> int:
        at, w = i * self.low_bits, self.low_bits
        if not w:
            return 0
        return (int.from_bytes(self.low[at // 8 : (at + w + 7) // 8].tobytes(), "little") >> (at % 8)) & ((1 << w) - 1)

    def select(self, i: int) -> int:
        """Value i: the place of the i-th one bit among the upper bits, and the lower bits as they are."""
        k = i // SAMPLE
        byte, seen = int(self.sample[k]), int(self.before[k])
        while True:
            here = int(self.high[byte]).bit_count()
            if seen + here > i:
                break
            seen, byte = seen + here, byte + 1
        b = int(self.high[byte])
        for _ in range(i - seen):
            b &= b - 1
        place = 8 * byte + (b & -b).bit_length() - 1
        return ((place - i) << self.low_bits) | self._low(i)

    def all(self):
        """All values at once."""
        np = self.np
        up = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.int64) - np.arange(self.n)
        if not self.low_bits:
            return up
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return (up << self.low_bits) | (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)


def write(docs: DataFrame, out: str | None = None, end_id: int = 0, path: str | None = None, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> str:
    """Writes the shards of docs and returns their folder."""
    spark = docs.sparkSession
    path, out = path or default_path(), out or new_path(spark, "tokens")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc, end, part = encoder(path), np.asarray([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId()
        ids, ends, doc_ids, n, shard = [], [], [], 0, 0

        def close():
            all_ids = np.frombuffer(b"".join(ids), dtype="<u4")
            width = 2 if not len(all_ids) or int(all_ids.max()) < 65536 else 4
            bits, low, high = EliasFano.encode(ends)
            known = np.array([0 if d is None else d for d in doc_ids], dtype=np.int64)
            row = (part, shard, len(ends), n, width, all_ids.astype(f"<u{width}").tobytes(), low, high, bits, np.diff(known, prepend=0).astype("<i8").tobytes(), sum(d is None for d in doc_ids))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[x.split()[0] for x in SHARD.split(", ")])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = enc.ids(text.as_py()) + end
                ids.append(x)
                n += len(x) // 4
                ends.append(n)
                doc_ids.append(doc)
                if n >= shard_ids:
                    yield close()
                    ids, ends, doc_ids, n, shard = [], [], [], 0, shard + 1
        if ends:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = parts or max(1, spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
    # equal ids are told apart by a hash, so one frequent id is dealt to many parts
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, F.asc_nulls_first("doc_id"), F.asc("tie")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc("tie"))
    ordered.select("doc_id", "text").mapInArrow(run, SHARD).write.option("compression", "zstd").parquet(out)
    return out


def shards(spark: SparkSession, out: str) -> DataFrame:
    """The shards with `base`, the ids of all shards before each."""
    df = spark.read.schema(SHARD).parquet(out)
    # a row for each part, tens of MB of text each, summed up in one task; and one for each shard
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = df.groupBy("part").agg(F.sum("n_ids").alias("n"), F.sort_array(F.collect_list(F.struct("shard", "n_ids"))).alias("s")).withColumn("part_base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inner = F.expr("transform(s, (x, i) -> struct(x.shard as shard, part_base + aggregate(slice(s, 1, i), 0L, (a, y) -> a + y.n_ids) as base))")
    bases = first.select("part", F.explode(inner).alias("b")).select("part", "b.shard", "b.base")
    return df.join(F.broadcast(bases) if df.count() <= SMALL else bases, ["part", "shard"])


def read(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """Documents read back: doc_id, start, n_tokens, ids_crc32, and ids on demand."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for s in b.to_pylist():
                ids = np.frombuffer(s["ids"], dtype=f"<u{s['width']}").astype("<u4")
                ends = EliasFano(s["n_docs"], s["low_bits"], s["ends_low"], s["ends_high"]).all()
                starts = np.concatenate([[0], ends[:-1]])
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
                doc = np.cumsum(np.frombuffer(s["doc_ids"], dtype="<i8"))
                gone = np.arange(len(doc)) < s["no_id"]  # nulls come first
                cols = [pa.array(doc, mask=gone), pa.array(starts + s["base"]), pa.array(ends - starts), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array([ids[x:y].tolist() for x, y in zip(starts, ends, strict=True)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

    return shards(spark, out).select("n_docs", "width", "ids", "ends_low", "ends_high", "low_bits", "doc_ids", "no_id", "base").mapInArrow(run, schema)
