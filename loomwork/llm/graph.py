"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node, root) for every node that has an edge; root is one node of its component.

    Each round every node joins its least neighbour (by a hash, so chains of rising ids halve too) and edges are drawn
    between what is left; maps of all rounds are composed at the end. Each round's tables are written to the shared folder.
    Repeated edges count once, edges of a node with itself and of nulls not at all; without edges the result is empty.
    """
    h = lambda c: F.xxhash64(F.lit(17), c)
    now = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    nodes = maps = None
    while True:
        if now.isEmpty():
            break
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.min(F.struct(h("b").alias("h"), F.col("b").alias("to"))).alias("m")
        step = both.groupBy("a").agg(least).select(F.col("a").alias("node"), F.when(F.struct(h("a"), F.col("a")) < F.struct("m.h", "m.to"), F.col("a")).otherwise(F.col("m.to")).alias("to"))
        step = cut(step, "step")
        if maps is None:
            maps = step.select("node", F.col("to").alias("root"))
        else:
            maps = maps.join(step.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        maps = cut(maps, "maps")
        a, b = step.select(F.col("node").alias("a"), F.col("to").alias("ta")), step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        now = now.join(a, "a").join(b, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        now = cut(now, "edges")
    if maps is None:
        spark = edges.sparkSession
        nodes = spark.createDataFrame([], "node long, root long")
    return maps if maps is not None else nodes
