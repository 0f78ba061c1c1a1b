"""Reply trees as conversations.

A table of messages with parents holds trees of replies. Iterative self-joins double what is known of each node's way to its
root: after k rounds its ancestor 2^k up, and the sum of scores till there, so ways of n nodes take log2(n) rounds. Leaves are
branches; those of a tree are ranked by their mean score, and only the chosen ones are enumerated, by the same doubling, and
formatted as one conversation each. Each round's rows are one for each node (and then one for each node of a chosen way), whatever
the trees look like; rounds end at the size of the largest tree, so what has no root by then is on a cycle or hangs on one.

The template marks a turn as `<|start|>role\\n text<|end|>\\n`. In texts and roles `&` and `<` are escaped (`&amp;`, `&lt;`), in
roles line breaks too, so no text can hold a mark and all of it can be read back. The loss mask is a list of spans of the
formatted text, one for each assistant text; `under` reads what lies under them.

Only DataFrame expressions are used. Nulls: null texts and roles count as empty, nodes of a null tree form one tree, a null
node is left out; a parent that isn't in the tree makes its child a root. Nodes on a cycle, and what hangs on one, have no root
and are left out. Null scores don't count in a mean; branches without scores come last. Repeated nodes are one node, the one that
sorts first by parent, role and text. Branches of like score rank by their leaf's id. Texts of any length are kept whole; a
conversation is one row. No messages: no conversations. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import cut

#: Fixed values of the template.
START, END = "<|start|>", "<|end|>\n"
ASSISTANT = "assistant"


def escape(x: Column) -> Column:
    return F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(x: Column) -> Column:
    return F.replace(escape(x), F.lit("\n"), F.lit("&nl;"))


def unescape_role(x: Column) -> Column:
    return unescape(F.replace(x, F.lit("&nl;"), F.lit("\n")))


def same(*pairs: tuple[str, str]) -> Column:
    """Equal tree and node; a null tree is one tree."""
    (t, u), (n, o) = pairs
    return F.col(t).eqNullSafe(F.col(u)) & (F.col(n) == F.col(o))


def climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """nodes(tree, node, parent, score), each node once -> the nodes that have a root, with `hops` (nodes on the way, both ends
    included), `total` and `known` (scores on it), and `leaf`; and for each k the steps (t, n, to) of 2^k nodes up."""
    most = nodes.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    there = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    linked = nodes.join(there, same(("tree", "t"), ("parent", "n")), "left")
    now = cut(linked.select("tree", "node", F.col("n").alias("to"), F.lit(1).cast("long").alias("hops"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total"), F.col("score").isNotNull().cast("long").alias("known")), "climb")
    parents = now.where("to is not null").select(F.col("tree").alias("t"), F.col("to").alias("n")).distinct()
    leaves = now.join(parents, same(("tree", "t"), ("node", "n")), "left_anti").select("tree", "node")
    steps, reach, closed = [], 1, now.where("to is null")
    while True:
        open_ = now.where("to is not null")  # only these go on
        if open_.isEmpty() or reach > 2 * most:
            break
        steps.append(open_.select(F.col("tree").alias("t"), F.col("node").alias("n"), "to"))
        up = closed.unionAll(open_).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("to").alias("to2"), F.col("hops").alias("hops2"), F.col("total").alias("total2"), F.col("known").alias("known2"))
        more = [(F.col(c) + F.col(f"{c}2")).alias(c) for c in ("hops", "total", "known")]
        now = cut(open_.join(up, same(("tree", "t"), ("to", "n"))).select("tree", "node", F.col("to2").alias("to"), *more), "climb")
        closed = closed.unionAll(now.where("to is null"))
        reach *= 2
    ends = leaves.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.lit(True).alias("leaf"))
    rooted = closed.join(ends, same(("tree", "t"), ("node", "n")), "left")
    return rooted.select("tree", "node", "hops", "total", "known", F.coalesce("leaf", F.lit(False)).alias("leaf")), steps


def paths(chosen: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """chosen(tree, leaf) -> (tree, leaf, node, up): every node from each leaf to its root, `up` steps above the leaf."""
    done = cut(chosen.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up")), "paths")
    for k, step in enumerate(steps):
        more = done.join(step, same(("tree", "t"), ("node", "n"))).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        done = done.unionByName(cut(more, "more"))
    return done


def conversations(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """messages(tree, node, parent, role, text, score) -> a row for each chosen path.

    Columns: tree, leaf, score (the path's mean), rank, n_turns, formatted, mask: array<struct<start, stop>> in code points.
    """
    m = messages.select("tree", "node", "parent", "role", "text", "score").where(F.col("node").isNotNull())
    m = cut(m.withColumn("_k", F.row_number().over(Window.partitionBy("tree", "node").orderBy("parent", "role", "text"))).where("_k = 1").drop("_k"), "messages")
    ways, steps = climb(m.select("tree", "node", "parent", "score"))
    branches = ways.where("leaf").select("tree", F.col("node").alias("leaf"), F.when(F.col("known") > 0, F.col("total") / F.col("known")).alias("score"))
    if best is not None:
        order = Window.partitionBy("tree").orderBy(F.desc_nulls_last("score"), "leaf")
        branches = branches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    else:
        branches = branches.withColumn("rank", F.lit(None).cast("int"))
    branches = cut(branches, "branches")
    p = paths(branches, steps)
    full = p.join(m.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text"), same(("tree", "t"), ("node", "n")))
    turn = F.struct((-F.col("up")).alias("at"), F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END)).alias("said"), F.length(escape_role(F.col("role"))).alias("head"), (F.col("role") == ASSISTANT).alias("learn"))
    own = full.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    facts = branches.select(F.col("tree").alias("t"), F.col("leaf").alias("n"), "score", "rank")
    ranked = own.join(facts, same(("tree", "t"), ("leaf", "n")))

    def step(acc, x):
        a = acc["at"] + len(START) + x["head"] + 1
        end = acc["at"] + F.length(x["said"])
        one = F.array(F.struct(a.alias("start"), (end - len(END)).alias("stop")))
        return F.struct(end.alias("at"), F.when(x["learn"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    mask = F.aggregate("turns", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out")), step, lambda acc: acc["out"])
    return ranked.select("tree", "leaf", "score", "rank", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda x: x["said"]), "").alias("formatted"), mask.alias("mask"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    parts = F.split(formatted, r"\Q" + END + r"\E", -1)
    turns = F.slice(parts, 1, F.size(parts) - 1)

    body = lambda x: F.substring(x, F.lit(len(START) + 1), F.length(x))
    role = lambda b: F.substring_index(b, "\n", 1)
    text = lambda b: F.substring(b, F.length(role(b)) + 2, F.length(b))
    return F.transform(turns, lambda x: F.struct(unescape_role(role(body(x))).alias("role"), unescape(text(body(x))).alias("text")))


def under(formatted: Column, mask: Column) -> Column:
    """The texts that lie under a mask's spans, unescaped."""
    return F.transform(mask, lambda x: unescape(F.substring(formatted, x["start"] + 1, x["stop"] - x["start"])))


def chain(rows: DataFrame, tree: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as trees: each row replies to the one before it; rows of one turn are ordered by role and text."""
    w = Window.partitionBy("tree").orderBy(F.asc_nulls_first(order), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    at = F.row_number().over(w).cast("long")
    r = rows.select(F.col(tree).cast("long").alias("tree"), F.col(order), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("node", at)
    return r.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))
