"""Paths through small graphs of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fewest_hops(links: DataFrame, start, goal, most: int = 16) -> DataFrame:
    """links(src, dst, cost): a path of fewest hops, the cheapest of them, as (path, hops, cost); empty if there is none."""
    links.createOrReplaceTempView("_links")
    kind = dict(links.dtypes)["src"]
    got = links.sparkSession.sql(f"""
        WITH RECURSIVE r(node, path, hops, cost) AS (
            SELECT CAST({start!r} AS {kind}), array(CAST({start!r} AS {kind})), 0, CAST(0 AS DOUBLE)
            UNION ALL
            SELECT l.dst, concat(path, array(l.dst)), hops + 1, r.cost + l.cost FROM r JOIN _links l ON l.src = r.node WHERE hops < {most} AND NOT array_contains(path, l.dst) AND r.node <> CAST({goal!r} AS {kind})
        ) SELECT path, hops, cost FROM r WHERE node = CAST({goal!r} AS {kind})""")
    return got.orderBy("hops", "cost", F.array_join(F.transform("path", lambda x: x.cast("string")), ",")).limit(1)
