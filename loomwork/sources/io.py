"""Readers and writers, malformed rows apart, generated rows, and paged HTTP as a data source."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomwork.sources.resilience import retry

CODECS = {"none": "none", "snappy": "snappy", "gzip": "gzip", "lz4": "lz4_raw", "zstd": "zstd", "brotli": "brotli"}
MODES = {"skip": "DROPMALFORMED", "raise": "FAILFAST", "keep": "PERMISSIVE"}


def read_csv(spark: SparkSession, path: str, header: bool = True, delimiter: str = ",", quote: str = '"', columns: list[str] | None = None, encoding: str = "UTF-8", malformed: str = "skip") -> DataFrame:
    """All columns are texts; without a header they are col_0, col_1, .. if not named."""
    r = spark.read.option("header", header).option("sep", delimiter).option("quote", quote).option("encoding", encoding).option("mode", MODES[malformed]).option("enforceSchema", False)
    df = r.csv(path)
    if columns:
        return df.toDF(*columns)
    return df if header else df.toDF(*[f"col_{i}" for i in range(len(df.columns))])


def read_csv_strict(spark: SparkSession, path: str, columns: list[str], header: bool = True, delimiter: str = ",") -> tuple[DataFrame, DataFrame]:
    """Rows with exactly these columns, and the others' raw lines."""
    schema = ", ".join(f"`{c}` string" for c in columns) + ", _corrupt string"
    lines = spark.read.text(path)
    lines = lines.where(F.col("value") != delimiter.join(columns)) if header else lines
    got = lines.select("value", F.from_csv("value", schema, {"sep": delimiter, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return _apart(got)


def _apart(got: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed rows `r` of lines `value`, and the lines that could not be parsed."""
    ok = F.col("r").isNotNull() & F.col("r._corrupt").isNull()
    return got.where(ok).select("r.*").drop("_corrupt"), got.where(~ok).select(F.col("value").alias("line"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows, and the lines that are not JSON."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return _apart(lines.select("value", F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")))


def read_json(spark: SparkSession, path: str, array_field: str | None = None) -> DataFrame:
    """A file that is one array or object, or an array in one of its fields."""
    df = spark.read.option("multiLine", True).json(path)
    return df.select(F.explode(F.col(array_field)).alias("x")).select("x.*") if array_field else df


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "error").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, delimiter: str = ",", header: bool = True, append: bool = False) -> None:
    df = df.select(*columns) if columns else df
    df.write.mode("append" if append else "error").option("header", header).option("sep", delimiter).option("nullValue", "").csv(path)


def write_parquet(df: DataFrame, path: str, codec: str = "snappy", partition_by: list[str] | None = None, mode: str = "error") -> None:
    w = df.write.mode(mode).option("compression", CODECS[codec])
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where=None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    return df.select(*columns) if columns else df


def batches(df: DataFrame, size: int):
    """Lists of rows, drawn partition by partition."""
    out = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        out.append(row)
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out


def generate(spark: SparkSession, count: int, schema: dict[str, str], seed: int = 0, error_rate: float = 0.0) -> DataFrame:
    """Rows of uuid, timestamp, int, float, bool, category, text or enum:a,b columns; a share of them null for errors."""
    def make(i: int, kind: str):
        s = seed + i
        if kind.startswith("enum:") or kind == "category":
            v = kind[5:].split(",") if kind.startswith("enum:") else list("ABCDE")
            return F.element_at(F.array(*map(F.lit, v)), (F.floor(F.rand(s) * len(v)) + 1).cast("int"))
        return {
            "uuid": lambda: F.expr(f"uuid({s})"), "timestamp": lambda: F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")), "int": lambda: F.floor(F.rand(s) * 1000).cast("long"), "float": lambda: F.rand(s) * 1000,
            "bool": lambda: F.rand(s) < 0.5, "text": lambda: F.concat(F.lit("text "), F.floor(F.rand(s) * 1e6).cast("string")),
        }[kind]()

    cols = [(F.when(F.rand(seed + 1000 + i) >= error_rate, make(i, k)) if error_rate else make(i, k)).alias(c) for i, (c, k) in enumerate(schema.items())]
    return spark.range(count).select(*cols)


def watch(spark: SparkSession, folder: str, schema, kind: str = "json", pattern: str = "*", per_trigger: int = 1000) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).format(kind).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(folder)


class Topic:
    """A partitioned append-only log of Parquet files; a consumer group's checkpoint holds its offsets."""

    SCHEMA = "key string, value string, timestamp timestamp, partition int"

    def __init__(self, spark: SparkSession, path: str, partitions: int = 4):
        self.spark, self.path, self.partitions = spark, path, partitions

    def produce(self, df: DataFrame, key: str | None = None) -> None:
        k = F.col(key).cast("string") if key else F.lit(None).cast("string")
        place = F.pmod(F.xxhash64(k) if key else F.monotonically_increasing_id(), F.lit(self.partitions)).cast("int")
        df.select(k.alias("key"), F.to_json(F.struct(*df.columns)).alias("value"), F.current_timestamp().alias("timestamp"), place.alias("partition")).write.mode("append").parquet(f"{self.path}/data")

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.SCHEMA).parquet(f"{self.path}/data")

    def consume(self, group: str, handle) -> None:
        """handle(frame) of what the group hasn't seen yet."""
        seen = {"done": False}

        def batch(df, _):
            handle(df)
            seen["done"] = True

        self.stream().writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.path}/groups/{group}").trigger(availableNow=True).start().awaitTermination()


class _Page(InputPartition):
    def __init__(self, page: int):
        self.page = page


class HttpReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.o, self.fields = options, [f.name for f in schema]

    def partitions(self):
        return [_Page(i) for i in range(int(self.o.get("pages", 1)))]

    def read(self, part):
        from urllib.request import Request, urlopen

        url = self.o["url"].replace("{page}", str(part.page))

        def fetch():
            with urlopen(Request(url, headers=json.loads(self.o.get("headers", "{}"))), timeout=float(self.o.get("timeout", 30))) as r:
                return json.load(r)

        got = retry(fetch, attempts=int(self.o.get("retries", 3)) + 1, wait=float(self.o.get("wait", 0.5)))
        if isinstance(got, dict):
            got = next((got[k] for k in ("data", "items", "results") if k in got), [got])
        for r in got:
            yield tuple(r.get(f) for f in self.fields)


class HttpSource(DataSource):
    """spark.dataSource.register(HttpSource); read.format("paged_http").schema(..).option("url", "http://../?page={page}").option("pages", n)."""

    @classmethod
    def name(cls):
        return "paged_http"

    def reader(self, schema):
        return HttpReader(dict(self.options), schema)
