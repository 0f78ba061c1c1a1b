"""Relationships between tables, joins along them, and questions in plain words."""

from __future__ import annotations

import re
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiplicity(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Mean rows of a key on either side and the kind of relationship: one to one up to 1.1 on both, many to many above."""
    per = lambda df, c, name: df.where(F.col(c).isNotNull()).groupBy(c).count().agg(F.avg("count").alias(name))
    kind = F.when((F.col("left_rows") <= 1.1) & (F.col("right_rows") <= 1.1), "one_to_one").when((F.col("left_rows") > 1.1) & (F.col("right_rows") > 1.1), "many_to_many").otherwise("one_to_many")
    return per(left, a, "left_rows").crossJoin(per(right, b, "right_rows")).withColumn("kind", kind)  # one row each


def _stem(column: str) -> str:
    return re.sub(r"^[a-z]{1,2}_", "", column.lower())


def relationships(schemas: dict[str, list[str]]) -> list[tuple[str, str, str, str]]:
    """(table, column, table, column) of columns that share a name, one-letter prefixes aside, and look like keys."""
    out, names = [], sorted(schemas)
    for i, s in enumerate(names):
        for t in names[i + 1 :]:
            out += [(s, a, t, b) for a in schemas[s] for b in schemas[t] if _stem(a) == _stem(b) and re.search(r"(key|_id|^id)$", _stem(a))]
    return out


def join_path(schemas: dict[str, list[str]], start: str, goal: str) -> list[tuple[str, str, str, str]] | None:
    """The fewest joins from one table to another."""
    edges: dict[str, list] = {}
    for s, a, t, b in relationships(schemas):
        edges.setdefault(s, []).append((s, a, t, b))
        edges.setdefault(t, []).append((t, b, s, a))
    todo, seen = deque([(start, [])]), {start}
    while todo:
        at, path = todo.popleft()
        if at == goal:
            return path
        for e in edges.get(at, []):
            if e[2] not in seen:
                seen.add(e[2])
                todo.append((e[2], [*path, e]))
    return None


def join_along(tables: dict[str, DataFrame], path: list[tuple[str, str, str, str]], start: str) -> DataFrame:
    df = tables[start]
    for _, a, t, b in path:
        right = tables[t]
        df = df.join(right, df[a] == right[b])
    return df


_AGG = {"average": "avg", "mean": "avg", "avg": "avg", "total": "sum", "sum": "sum", "count": "count", "many": "count", "number": "count", "maximum": "max", "highest": "max", "max": "max", "minimum": "min", "lowest": "min", "min": "min"}
_CMP = [(r"(?:greater|more|larger|higher|over|above) (?:than )?", ">"), (r"(?:less|fewer|smaller|lower|under|below) (?:than )?", "<"), (r"at least ", ">="), (r"at most ", "<="), (r"(?:equals?|equal to|is) ", "=")]


def to_sql(question: str, schemas: dict[str, list[str]]) -> str:
    """Spark SQL for a question such as "average o_totalprice of orders by o_orderstatus where o_custkey over 5"."""
    q = question.strip()
    low = q.lower()
    words = re.findall(r"\w+", low)
    table = next((t for w in words for t in schemas if w in (t, t.rstrip("s"))), None)
    if table is None:
        raise ValueError("no known table is named")
    cols = schemas[table]
    col_in = lambda text: next((c for w in re.findall(r"\w+", text) for c in cols if w in (c.lower(), _stem(c))), None)
    agg = next((_AGG[w] for w in words if w in _AGG), None)
    by = re.search(r"\b(?:by|per|for each) (\w+)", low)
    group = col_in(by[1]) if by else None
    head = re.split(r"\b(?:by|per|where|with|order|sorted)\b", re.sub(r"\btop \d+", "", low))[0]
    target = col_in(head)
    cond = []
    for pattern, op in _CMP:
        for m in re.finditer(r"(\w+) (?:is )?" + pattern + r"('?[\w.\-]+'?)", q, re.I):
            c = col_in(m[1].lower())
            if c and not cond:
                v = m[2] if re.fullmatch(r"-?[\d.]+", m[2]) else "'" + m[2].strip("'") + "'"
                cond.append(f"{c} {op} {v}")
    top = re.search(r"\btop (\d+)", low)
    if agg:
        what = "count(*)" if agg == "count" or target is None else f"{agg}({target})"
        sel = f"{group + ', ' if group else ''}{what} AS value"
    else:
        sel = target or "*"
    sql = f"SELECT {sel} FROM {table}"
    if cond:
        sql += " WHERE " + " AND ".join(cond)
    if group and agg:
        sql += f" GROUP BY {group}"
    if top:
        sql += f" ORDER BY {'value' if agg else (target or cols[0])} DESC LIMIT {top[1]}"
    return sql
