"""What is known of tables: who may read them, where they come from, what they hold, with whom they are shared."""

from __future__ import annotations

import fnmatch
import re
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of column names that tell of personal data.
PII_NAMES = {"email": r"e?mail", "phone": r"phone|mobile|tel", "ssn": r"ssn|social", "credit_card": r"card|cc_?num", "name": r"name", "address": r"addr|street|zip|postal", "birth_date": r"dob|birth", "ip_address": r"(^|_)ip(_|$)"}


class Catalog:
    def __init__(self) -> None:
        self.tables: dict[str, dict] = {}
        self.grants: set[tuple[str, str, str]] = set()
        self.shares: dict[str, set[str]] = {}
        self.recipients: dict[str, dict] = {}

    def register(self, name: str, df: DataFrame, tags: list[str] | None = None, **more) -> None:
        self.tables[name] = {"schema": df.schema, "tags": set(tags or []), "frame": df, **more}

    def get(self, name: str) -> dict:
        return self.tables[name]

    def list(self, pattern: str = "*") -> list[str]:
        return sorted(fnmatch.filter(self.tables, pattern))

    def search(self, *tags: str) -> list[str]:
        return sorted(n for n, t in self.tables.items() if set(tags) <= t["tags"])

    def update(self, name: str, **more) -> None:
        self.tables[name] |= more

    def drop(self, name: str) -> None:
        del self.tables[name]

    # access
    def grant(self, who: str, table: str, what: str) -> None:
        self.grants.add((who, table, what))

    def revoke(self, who: str, table: str, what: str) -> None:
        self.grants.discard((who, table, what))

    def allowed(self, who: str, table: str, what: str) -> bool:
        return (who, table, what) in self.grants

    def read(self, who: str, table: str) -> DataFrame:
        if not self.allowed(who, table, "read"):
            raise PermissionError(f"{who} may not read {table}")
        return self.tables[table]["frame"]

    # sharing
    def share(self, name: str, *tables: str) -> None:
        self.shares.setdefault(name, set()).update(tables)

    def recipient(self, name: str, shares: list[str], hours: float = 24) -> str:
        token = uuid.uuid4().hex
        self.recipients[token] = {"name": name, "shares": shares, "until": time.time() + 3600 * hours}
        return token

    def shared_tables(self, token: str) -> list[str]:
        r = self.recipients.get(token)
        if r is None or r["until"] < time.time():
            raise PermissionError("no such token, or it has expired")
        return sorted(t for s in r["shares"] for t in self.shares.get(s, ()))


def pii_columns(df: DataFrame) -> dict[str, str]:
    """Column -> kind, by its name."""
    return {c: k for c in df.columns for k, p in PII_NAMES.items() if re.search(p, c.lower())}


def sensitivity(df: DataFrame) -> str:
    kinds = set(pii_columns(df).values())
    return "high" if kinds & {"ssn", "credit_card", "birth_date"} else "medium" if kinds else "low"


def upstream(edges: DataFrame, start, depth: int = 64) -> DataFrame:
    """edges(src, dst): every node that `start` comes from, with the least number of steps."""
    edges.createOrReplaceTempView("_lineage_edges")
    got = edges.sparkSession.sql(f"WITH RECURSIVE r(node, depth) AS (SELECT dst, 1 FROM _lineage_edges WHERE src = {start!r} UNION ALL SELECT e.dst, depth + 1 FROM r JOIN _lineage_edges e ON e.src = r.node WHERE depth < {depth}) SELECT * FROM r")
    return got.groupBy("node").agg(F.min("depth").alias("depth"))


def downstream(edges: DataFrame, start, depth: int = 64) -> DataFrame:
    return upstream(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, depth)
