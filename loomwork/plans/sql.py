"""SQL over registered tables, with four keywords of its own that turn into hints and settings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|\w+|\s+|.", re.S)


def rewrite(query: str) -> tuple[str, dict]:
    """Standard SQL and what else was asked for.

    `WAGGLE JOIN` is a join whose strategy adaptive execution picks, `SWARM PARTITION BY c` repartitions the result by c,
    `PHEROMONE CACHE` keeps the result and `SCOUT HINT` turns speculation on. Nothing inside quotes or comments is touched.
    """
    tokens = _TOKEN.findall(query)
    words = [(i, t.upper()) for i, t in enumerate(tokens) if re.fullmatch(r"\w+", t)]
    asked: dict = {"partition": [], "cache": False, "speculate": False, "adaptive_joins": 0}
    gone: set[int] = set()
    for k, (i, w) in enumerate(words):
        after = [x for _, x in words[k + 1 : k + 4]]
        if w == "WAGGLE" and after[:1] == ["JOIN"]:
            asked["adaptive_joins"] += 1
            gone.add(i)
        elif w == "SWARM" and after[:2] == ["PARTITION", "BY"] and len(after) > 2:
            asked["partition"].append(tokens[words[k + 3][0]])
            gone.update(range(i, words[k + 3][0] + 1))
        elif w == "PHEROMONE" and after[:1] == ["CACHE"]:
            asked["cache"] = True
            gone.update(range(i, words[k + 1][0] + 1))
        elif w == "SCOUT" and after[:1] == ["HINT"]:
            asked["speculate"] = True
            gone.update(range(i, words[k + 1][0] + 1))
    return "".join(t for i, t in enumerate(tokens) if i not in gone), asked


class SqlContext:
    def __init__(self, spark: SparkSession):
        self.spark, self._names = spark, set()
        self._kept: dict[str, DataFrame] = {}

    @classmethod
    def over(cls, spark: SparkSession, folder: str, names: list[str] | None = None) -> "SqlContext":
        """A context over a folder's Parquet tables."""
        ctx = cls(spark)
        for n in names or TABLES:
            ctx.register_table(n, spark.read.parquet(f"{folder}/{n}.parquet"))
        return ctx

    def register_table(self, name: str, source: DataFrame | list | str) -> DataFrame:
        if isinstance(source, str):
            kind = source.rsplit(".", 1)[-1].lower()
            read = {"csv": lambda: self.spark.read.csv(source, header=True), "json": lambda: self.spark.read.json(source, multiLine=True), "jsonl": lambda: self.spark.read.json(source), "parquet": lambda: self.spark.read.parquet(source), "orc": lambda: self.spark.read.orc(source)}
            if kind not in read:
                raise ValueError(f"no reader for {source}")
            source = read[kind]()
        elif isinstance(source, list):
            source = self.spark.createDataFrame(source)
        source.createOrReplaceTempView(name.lower())
        self._names.add(name.lower())
        return source

    register_view = register_table

    def drop_table(self, name: str) -> None:
        self.spark.catalog.dropTempView(name.lower())
        self._names.discard(name.lower())

    def tables(self) -> list[str]:
        return sorted(self._names)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name.lower())

    def describe(self, name: str) -> DataFrame:
        return self.spark.sql(f"DESCRIBE TABLE {name.lower()}")

    def sql(self, query: str) -> DataFrame:
        text, asked = rewrite(query)
        key = " ".join(text.split())
        if asked["cache"] and key in self._kept:
            return self._kept[key]
        if asked["speculate"]:
            # a core setting: it holds for sessions built with it, here it is only noted
            self.speculation_asked = True
        df = self.spark.sql(text)
        if asked["partition"]:
            df = df.repartition(*asked["partition"])
        if asked["cache"]:
            df = self._kept.setdefault(key, df.persist())
        return df

    def explain(self, query: str) -> str:
        text, _ = rewrite(query)
        return self.spark.sql(f"EXPLAIN FORMATTED {text}").first()[0]
