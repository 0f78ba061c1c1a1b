"""Versioned tables: Parquet data beside a log of JSON commits.

A commit is one file named by its version, created exclusively: of two writers one wins, the other reads again and, for
appends, tries the next version. The log and the data live where Hadoop's file system API reaches.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ConflictError(RuntimeError):
    pass


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._jvm, self._Path = jvm, jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # the log
    def _log(self, version: int) -> str:
        return f"{self.path}/_log/{version:020d}.json"

    def exists(self) -> bool:
        return self._fs.exists(self._Path(self._log(0)))

    def version(self) -> int:
        if not self.exists():
            return -1
        return max(int(s.getPath().getName()[:20]) for s in self._fs.listStatus(self._Path(f"{self.path}/_log")))

    def _commit(self, version: int, actions: dict) -> None:
        try:
            out = self._fs.create(self._Path(self._log(version)), False)
        except Exception as e:
            raise ConflictError(f"version {version} exists") from e
        out.write(bytearray(json.dumps(actions).encode()))
        out.close()

    def commits(self) -> list[dict]:
        """All commits: one small entry for each version."""
        out = []
        for v in range(self.version() + 1):
            stream = self._fs.open(self._Path(self._log(v)))
            out.append(json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"version": v})
            stream.close()
        return out

    def snapshot(self, version: int | None = None, timestamp: float | None = None) -> dict:
        """Active folders and schema at a version or a time in epoch seconds."""
        log = self.commits()
        if timestamp is not None:
            log = [c for c in log if c["time"] <= timestamp]
        if version is not None:
            if version > len(log) - 1 or version < 0:
                raise ValueError(f"there is no version {version}")
            log = log[: version + 1]
        if not log:
            raise ValueError("no version that early")
        files, state = {}, {}
        for c in log:
            for f in c.get("remove", []):
                files.pop(f, None)
            files.update({f["path"]: f for f in c.get("add", [])})
            state |= {k: c[k] for k in ("schema", "partition_by", "mapping", "description") if k in c}
        return {"files": files, "version": log[-1]["version"], **state}

    # writing
    def create(self, schema: T.StructType, partition_by: list[str] | None = None, description: str = "") -> "VersionedTable":
        if self.exists():
            raise ConflictError("the table exists")
        self._commit(0, {"op": "create", "time": time.time(), "schema": schema.json(), "mapping": {f.name: f.name for f in schema}, "partition_by": partition_by or [], "description": description, "add": []})
        return self

    def _store(self, df: DataFrame, partition_by: list[str]) -> dict:
        folder = f"data/{uuid.uuid4().hex}"
        w = df.write.partitionBy(*partition_by) if partition_by else df.write
        w.parquet(f"{self.path}/{folder}")
        stored = self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}")
        plain = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "string", "date")]
        got = stored.agg(F.count("*").alias("n"), *[f(c).cast("string").alias(f"{k}_{i}") for i, c in enumerate(plain) for k, f in (("min", F.min), ("max", F.max))], *[F.count_if(F.col(c).isNull()).alias(f"null_{i}") for i, c in enumerate(plain)]).first()
        return {"path": folder, "rows": got["n"], "stats": {c: {"min": got[f"min_{i}"], "max": got[f"max_{i}"], "nulls": got[f"null_{i}"]} for i, c in enumerate(plain)}}

    def write(self, df: DataFrame, mode: str = "append", partition_by: list[str] | None = None, based_on: int | None = None) -> int:
        """Commits df. based_on: the version that df was made from; if another one came in between, ConflictError and no change."""
        if mode not in ("append", "overwrite", "error"):
            raise ValueError(f"unknown mode {mode}")
        if mode == "error" and self.exists():
            raise ConflictError("the table exists")
        if not self.exists():
            self.create(df.schema, partition_by)
        snap = self.snapshot()
        names = {v: k for k, v in snap["mapping"].items()}
        physical = df if mode == "overwrite" else df.select(*[F.col(c).alias(snap["mapping"].get(c, c)) for c in df.columns])
        add = self._store(physical, snap.get("partition_by", []))
        for _ in range(20):
            snap = self.snapshot()
            if based_on is not None and snap["version"] != based_on:
                raise ConflictError(f"version {snap['version']} came after {based_on}, which was read")
            actions = {"op": mode, "time": time.time(), "add": [add], "remove": list(snap["files"]) if mode == "overwrite" else []}
            if mode == "overwrite":
                actions |= {"schema": df.schema.json(), "mapping": {c: c for c in df.columns}}
            try:
                self._commit(snap["version"] + 1, actions)
                return snap["version"] + 1
            except ConflictError:
                if mode != "append":
                    raise
        raise ConflictError(f"too many writers; columns {sorted(names)}")

    # reading
    def read(self, version: int | None = None, timestamp: float | None = None, where: tuple[str, str, str] | None = None) -> DataFrame:
        """A snapshot; `where` (column, low, high as texts) leaves out folders whose statistics exclude it."""
        snap = self.snapshot(version, timestamp)
        schema = T.StructType.fromJson(json.loads(snap["schema"]))
        names = snap["mapping"]
        physical = T.StructType([T.StructField(names[f.name], f.dataType, True) for f in schema])
        keep = list(snap["files"].values())
        if where:
            c, low, high = where
            kind = next(f.dataType for f in schema if f.name == c)
            num = float if isinstance(kind, T.NumericType) else str
            keep = [f for f in keep if (s := f["stats"].get(names[c])) is None or s["max"] is None or not (num(s["max"]) < num(low) or num(s["min"]) > num(high))]
        if not keep:
            return self.spark.createDataFrame([], schema)
        if snap.get("partition_by"):  # each folder has its own root of partition values
            parts = [self.spark.read.schema(physical).parquet(f"{self.path}/{f['path']}") for f in keep]
            df = reduce(DataFrame.unionAll, parts)
        else:
            df = self.spark.read.schema(physical).parquet(*(f"{self.path}/{f['path']}" for f in keep))
        return df.select(*[F.col(names[f.name]).alias(f.name) for f in schema])

    def history(self, limit: int | None = None) -> DataFrame:
        rows = [(c["version"], c["op"], float(c["time"]), sum(f["rows"] for f in c.get("add", [])), len(c.get("remove", []))) for c in reversed(self.commits())]
        return self.spark.createDataFrame(rows[:limit], "version long, operation string, time double, rows_added long, folders_removed long")

    # upkeep
    def optimize(self, parts: int = 1) -> int:
        snap = self.snapshot()
        if len(snap["files"]) < 2:
            return snap["version"]
        names = snap["mapping"]
        df = self.read()
        add = self._store(df.select(*[F.col(c).alias(names[c]) for c in df.columns]).coalesce(parts), snap.get("partition_by", []))
        self._commit(snap["version"] + 1, {"op": "optimize", "time": time.time(), "add": [add], "remove": list(snap["files"])})
        return snap["version"] + 1

    def vacuum(self, retention_hours: float = 168) -> list[str]:
        """Deletes folders that no snapshot of the retention time needs."""
        now, needed, active = time.time(), set(), set()
        for c in self.commits():
            active = (active - set(c.get("remove", []))) | {f["path"] for f in c.get("add", [])}
            if c["time"] >= now - retention_hours * 3600:
                needed |= active
        needed |= active
        root, gone = self._Path(f"{self.path}/data"), []
        for s in self._fs.listStatus(root) if self._fs.exists(root) else []:
            name = f"data/{s.getPath().getName()}"
            if name not in needed and s.getModificationTime() / 1000 < now - retention_hours * 3600 + 1:
                self._fs.delete(s.getPath(), True)
                gone.append(name)
        return gone

    # changes to rows
    def delete(self, condition: Column) -> int:
        now = self.version()
        return self.write(self.read(now).where(~F.coalesce(condition, F.lit(False))), "overwrite", based_on=now)

    def update(self, condition: Column, values: dict[str, Column]) -> int:
        now, hit = self.version(), F.coalesce(condition, F.lit(False))
        df = self.read(now)
        return self.write(df.withColumns({c: F.when(hit, v).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in values.items()}), "overwrite", based_on=now)

    def merge(self, source: DataFrame, key: str, update: bool = True, insert: bool = True, delete: Column | None = None) -> int:
        """Matching rows take the source's values (or go where `delete` holds of the source); others are inserted."""
        version = self.version()
        now = self.read(version)
        if delete is not None:
            now = now.join(source.where(delete).select(key), key, "left_anti")
            source = source.where(~F.coalesce(delete, F.lit(False)))
        keep = now.join(source.select(key), key, "left_anti") if update else now
        new = source if update and insert else source.join(now.select(key), key, "left_semi" if update else "left_anti")
        return self.write(keep.unionByName(new.select(*now.columns)), "overwrite", based_on=version)

    # changes to the schema: names map to stored columns, so no data is rewritten
    def evolve(self, add: dict[str, str] | None = None, rename: dict[str, str] | None = None, drop: list[str] | None = None) -> int:
        snap = self.snapshot()
        fields = T.StructType.fromJson(json.loads(snap["schema"])).fields
        names = dict(snap["mapping"])
        fields = [f for f in fields if f.name not in (drop or [])]
        for f in fields:
            if f.name in (rename or {}):
                names[rename[f.name]] = names.pop(f.name)
                f.name = rename[f.name]
        for c, kind in (add or {}).items():
            fields.append(T.StructField(c, T._parse_datatype_string(kind), True))
            names[c] = f"{c}_{uuid.uuid4().hex[:6]}" if c in names.values() else c
        names = {f.name: names[f.name] for f in fields}
        self._commit(snap["version"] + 1, {"op": "evolve", "time": time.time(), "schema": T.StructType(fields).json(), "mapping": names})
        return snap["version"] + 1


def transforms(column: str, kind: str, n: int | None = None) -> Column:
    """Partition values: identity, year, month, day, hour, bucket(n), truncate(n), void."""
    c = F.col(column)
    made = {
        "identity": lambda: c, "year": lambda: F.date_format(c, "yyyy"), "month": lambda: F.date_format(c, "yyyy-MM"), "day": lambda: F.date_format(c, "yyyy-MM-dd"), "hour": lambda: F.date_format(c, "yyyy-MM-dd-HH"),
        "bucket": lambda: F.pmod(F.xxhash64(c), F.lit(n)), "truncate": lambda: F.substring(c.cast("string"), 1, n), "void": lambda: F.lit(None).cast("string"),
    }
    if kind not in made:
        raise ValueError(f"unknown transform {kind}")
    return F.coalesce(made[kind]().cast("string"), F.lit("__null__")) if kind != "void" else made[kind]()
