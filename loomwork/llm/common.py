"""Shared folders, lineage cuts and text helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.session import ship

_own: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); on a local master a temporary one of this process where that is unset."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="loomwork-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


_made: list[str] = []
_named: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{scratch_dir(spark)}/loomwork/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def bucketed(df: DataFrame, by: str, buckets: int, name: str) -> DataFrame:
    """As `cut`, dealt by the hash of `by`, which later joins and groups by it needn't deal again; the table is in the session's catalogue."""
    spark = df.sparkSession
    _named.append(f"loomwork_{uuid.uuid4().hex}")
    write = df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by)
    write.options(path=new_path(spark, name), compression="zstd").saveAsTable(_named[-1])
    return spark.table(_named[-1])


def drop_scratch(spark: SparkSession) -> int:
    """Deletes the tables that this process has cut so far; frames that read them can't be used any more."""
    for t in _named:
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    _named.clear()
    path, n = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, len(_made)
    for p in _made:
        where = path(p)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _made.clear()
    return n


def cut(df: DataFrame, name: str = "t", codec: str = "snappy", **options) -> DataFrame:
    """Writes df to the shared folder and reads it back: the plan starts anew there, and lost executors cost nothing that was written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(compression=codec, **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(columns, name: str) -> str:
    """A column's name that none of `columns` has, in any case."""
    have = {c.lower() for c in columns}
    while name.lower() in have:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def crc_of_id(col) -> "F.Column":
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def give_back() -> None:
    """At the end of a task: memory that a worker has freed goes back to the system, as workers live on between tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
