"""Registered queries of sources, sinks, the versioned table's log, topics, views and placement, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import partitioning as P
from loomwork.plans.catalogue import registry
from loomwork.plans.queries_kernels import _folder
from loomwork.session import table
from loomwork.sources import io
from loomwork.sources.catalog import Catalog
from loomwork.sources.versioned import VersionedTable, transforms
from loomwork.streaming import cdc
from loomwork.streaming import windows as W

q = registry.query
_NAMES = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"), "o_orderstatus", "o_totalprice")


_ORDERS = "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus, o_totalprice FROM orders"


@q(oracle="SELECT c_custkey, c_name, 'row' AS kind FROM customer UNION ALL SELECT count(*), 'broken', 'bad' FROM customer WHERE c_custkey % 100 = 0")
def source_csv_strict(spark, sf_dir):
    """Customers as lines, every hundredth also as a broken one: good rows, and how many lines were not."""
    path, c = _folder(spark, "strict"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    good = c.select(F.concat_ws(",", F.col("c_custkey").cast("string"), F.col("c_name")).alias("value"))
    bad = c.where("c_custkey % 100 = 0").select(F.concat(F.lit("x,y,z,"), F.col("c_name")).alias("value"))
    spark.range(1).select(F.lit("c_custkey,c_name").alias("value")).unionByName(good).unionByName(bad).write.text(path)
    rows, broken = io.read_csv_strict(spark, path, ["c_custkey", "c_name"])
    return rows.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.lit("row").alias("kind")).unionByName(broken.agg(F.count("*").alias("c_custkey")).select("c_custkey", F.lit("broken").alias("c_name"), F.lit("bad").alias("kind")))


@q(oracle="SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name FROM supplier")
def source_json_array(spark, sf_dir):
    """Suppliers written as one object with an array field, and read back."""
    path = _folder(spark, "array")
    whole = table(spark, sf_dir, "supplier").agg(F.to_json(F.struct(F.collect_list(F.struct("s_suppkey", "s_name")).alias("items"))).alias("value"))
    whole.write.text(path)
    return io.read_json(spark, path, "items").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name")


@q(oracle=_ORDERS + " WHERE o_totalprice > 1000")
def source_parquet_partitioned(spark, sf_dir):
    """Written by status with another codec; columns and a filter on reading."""
    path = _folder(spark, "parquet")
    io.write_parquet(_orders(spark, sf_dir), path, codec="zstd", partition_by=["o_orderstatus"])
    return io.read_parquet(spark, path, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"], F.col("o_totalprice") > 1000)


@q(oracle="SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def source_topic(spark, sf_dir):
    """Orders produced twice over to a topic; a group sees each once, also over two runs."""
    t, out = io.Topic(spark, _folder(spark, "topic"), 4), _folder(spark, "seen")
    o = _orders(spark, sf_dir)
    take = lambda df: df.select(F.from_json("value", _NAMES).alias("r")).select("r.*").write.mode("append").parquet(out)
    t.produce(o.where("o_orderstatus = 'F'"), "o_custkey")
    t.consume("g", take)
    t.produce(o.where("o_orderstatus <> 'F'"), "o_custkey")
    t.consume("g", take)
    return spark.read.schema(_NAMES).parquet(out).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@q(oracle=_ORDERS)
def source_watched_folder(spark, sf_dir):
    """New files of a folder as a stream, run until none is left, with its checkpoint."""
    src, out = _folder(spark, "watched"), _folder(spark, "out")
    _orders(spark, sf_dir).write.json(src)
    W.run_to_end(io.watch(spark, src, _NAMES, pattern="*.json"), out, _folder(spark, "state"))
    return spark.read.schema(_NAMES).parquet(out)


@q(oracle="SELECT CAST(v AS BIGINT) AS version, op AS operation, n AS rows_added, CAST(g AS BIGINT) AS folders_removed FROM (SELECT 0 AS v, 'create' AS op, CAST(0 AS BIGINT) AS n, 0 AS g UNION ALL SELECT 1, 'append', count(*), 0 FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 2, 'append', count(*), 0 FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 3, 'overwrite', count(*), 2 FROM orders WHERE o_orderstatus <> 'P') AS h")
def table_history(spark, sf_dir):
    t, o = VersionedTable(spark, _folder(spark, "table")), _orders(spark, sf_dir)
    t.write(o.where("o_orderstatus = 'F'"))
    t.write(o.where("o_orderstatus <> 'F'"))
    t.delete(F.col("o_orderstatus") == "P")
    return t.history().drop("time")


@q(oracle="SELECT count(*) AS kept, sum(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END) AS now FROM orders")
def table_vacuum(spark, sf_dir):
    """What no kept version needs goes; the newest version reads as before."""
    t, o = VersionedTable(spark, _folder(spark, "table")), _orders(spark, sf_dir)
    t.write(o)
    n = t.read().count()
    t.delete(F.col("o_orderstatus") == "P")
    assert t.vacuum(retention_hours=-1)
    return t.read().agg(F.lit(n).cast("long").alias("kept"), F.sum(F.lit(1).cast("int")).alias("now"))


@q(oracle="SELECT o_orderstatus, CAST(0 AS BIGINT) AS other, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def table_file_pruning(spark, sf_dir):
    """One commit a status; a filter by statistics reads the folder that may hold it and no other."""
    t, o = VersionedTable(spark, _folder(spark, "table")), _orders(spark, sf_dir)
    for status in ("F", "O", "P"):
        t.write(o.where(F.col("o_orderstatus") == status))
    got = t.read(where=("o_orderstatus", "F", "F"))
    return got.agg(F.min("o_orderstatus").alias("o_orderstatus"), F.count_if(F.col("o_orderstatus") != "F").alias("other"), F.count("*").alias("n"))


@q(oracle="SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, substr(o_orderstatus, 1, 1) AS s, count(*) AS n FROM orders GROUP BY ALL")
def table_partition_transforms(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(transforms("o_orderdate", "year").cast("long").alias("y"), F.substring(transforms("o_orderdate", "month"), 6, 2).cast("long").alias("m"), transforms("o_orderstatus", "truncate", 1).alias("s"))
    return o.groupBy("y", "m", "s").agg(F.count("*").alias("n"))


@q(oracle=_ORDERS + " WHERE o_orderstatus <> 'P' UNION ALL SELECT CAST(o_orderkey AS BIGINT), CAST(o_custkey AS BIGINT), o_orderstatus, o_totalprice * 2 FROM orders WHERE o_orderstatus = 'P'")
def cdc_replicated(spark, sf_dir):
    """A stream of changes into a versioned table: inserts, then updates of the pending orders."""
    o, src = _orders(spark, sf_dir), _folder(spark, "changes")
    change = lambda df, op, seq: df.select(F.lit(op).alias("op"), "o_orderkey", F.struct(*df.columns).alias("after"), F.lit(seq).cast("long").alias("seq"))
    log = change(o, "insert", 1).unionByName(change(o.where("o_orderstatus = 'P'").withColumn("o_totalprice", F.col("o_totalprice") * 2), "update", 2))
    log.write.parquet(src)
    t = VersionedTable(spark, _folder(spark, "target"))
    cdc.replicate(spark.readStream.schema(log.schema).parquet(src), t, "o_orderkey", _folder(spark, "state"))
    return t.read().select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@q(oracle="SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def view_refreshed(spark, sf_dir):
    """A view that goes stale and is refreshed when it is asked; an equal query is answered by it."""
    views, text = cdc.MaterialisedViews(spark, _folder(spark, "views")), "SELECT o_orderstatus, count(*) AS n FROM _view_orders GROUP BY o_orderstatus"
    o = _orders(spark, sf_dir)
    o.where("o_orderstatus = 'F'").createOrReplaceTempView("_view_orders")
    views.create("v", text)
    views.query("v")
    o.createOrReplaceTempView("_view_orders")
    views.invalidate("v")
    views.query("v")
    return views.rewrite(text.lower().replace("_view_orders", "_VIEW_orders"))


@q(oracle="SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer")
def catalogue_shared(spark, sf_dir):
    """Tables registered, found by tag and shared; each read under a grant."""
    c = Catalog()
    for name in ("orders", "customer", "nation"):
        c.register(name, table(spark, sf_dir, name), ["sales"] if name != "nation" else ["places"])
    for name in c.search("sales"):
        c.grant("ann", name, "read")
    c.share("s", *c.search("sales"))
    names = c.shared_tables(c.recipient("bob", ["s"]))
    got = [c.read("ann", n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in sorted(names, reverse=True)]
    return got[0].unionByName(got[1])


@q(oracle="SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, TRUE AS even FROM orders")
def part_round_robin(spark, sf_dir):
    """Dealt in turn: nothing is lost, and parts differ by some rows only."""
    parts = P.round_robin(_orders(spark, sf_dir), 8).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("c"), F.sum("o_orderkey").alias("k"))
    return parts.agg(F.sum("c").alias("n"), F.sum("k").alias("keys"), (F.max("c") - F.min("c") <= 64).alias("even"))
