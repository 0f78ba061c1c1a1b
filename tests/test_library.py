"""Readers, tables, streams, patterns and the SQL front end on small inputs."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from loomwork.functions import compat
from loomwork.operators import discovery, features, quality
from loomwork.operators import relational as R
from loomwork.sources import catalog, io
from loomwork.sources.versioned import ConflictError, VersionedTable, transforms
from loomwork.streaming import cdc, cep
from loomwork.streaming import windows as W
from loomwork.plans.sql import SqlContext, rewrite


# SQL ------------------------------------------------------------------------------------------------------------------
def test_keywords_turn_into_hints():
    text, asked = rewrite("SELECT 'WAGGLE JOIN' AS a -- WAGGLE JOIN\nFROM x WAGGLE JOIN y ON x.i = y.i SWARM PARTITION BY i PHEROMONE CACHE SCOUT HINT")
    assert "'WAGGLE JOIN'" in text and "-- WAGGLE JOIN" in text and "x  JOIN y" in text
    assert asked == {"partition": ["i"], "cache": True, "speculate": True, "adaptive_joins": 1}


def test_context(spark, tmp_path):
    ctx = SqlContext(spark)
    ctx.register_table("People", [{"id": 1, "age": 30}, {"id": 2, "age": 25}])
    (tmp_path / "c.csv").write_text("a,b\n1,x\n")
    ctx.register_table("c", str(tmp_path / "c.csv"))
    assert ctx.tables() == ["c", "people"]
    assert ctx.sql("SELECT count(*) AS n FROM people WHERE age > 26").first()["n"] == 1
    kept = ctx.sql("SELECT id FROM people PHEROMONE CACHE")
    assert ctx.sql("SELECT id  FROM people PHEROMONE CACHE") is kept
    assert "Physical Plan" in ctx.explain("SELECT * FROM people WAGGLE JOIN c ON id = a")
    assert {r["col_name"] for r in ctx.describe("people").collect()} == {"id", "age"}
    ctx.drop_table("people")
    assert ctx.tables() == ["c"]
    with pytest.raises(ValueError):
        ctx.register_table("z", "z.xyz")


def test_union_of_sql_features(spark):
    ctx = SqlContext(spark)
    ctx.register_table("table1", [{"id": i} for i in (1, 2, 3)])
    ctx.register_table("table2", [{"id": i} for i in (2, 3, 4)])
    n = lambda op: sorted(r["id"] for r in ctx.sql(f"SELECT id FROM table1 {op} SELECT id FROM table2").collect())
    assert n("UNION") == [1, 2, 3, 4] and len(n("UNION ALL")) == 6 and n("INTERSECT") == [2, 3] and n("EXCEPT") == [1]


# readers and writers --------------------------------------------------------------------------------------------------
def test_csv(spark, tmp_path):
    (tmp_path / "h.csv").write_text("name,age,city\nAnn,30,Rome\nBob,25,Oslo\n")
    (tmp_path / "n.csv").write_text("a,b,c\nd,e,f\n")
    (tmp_path / "bad.csv").write_text("name,age,city\nAnn,30,Rome\nBob,25\nCid,1,2,3\n")
    df = io.read_csv(spark, str(tmp_path / "h.csv"))
    assert df.dtypes == [("name", "string"), ("age", "string"), ("city", "string")] and df.count() == 2
    assert io.read_csv(spark, str(tmp_path / "n.csv"), header=False).columns == ["col_0", "col_1", "col_2"]
    good, bad = io.read_csv_strict(spark, str(tmp_path / "bad.csv"), ["name", "age", "city"])
    assert [r["name"] for r in good.collect()] == ["Ann"] and bad.count() == 2


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"n": "a", "v": 1}, {"n": "b", "v": 2}]')
    (tmp_path / "r.json").write_text('{"metadata": {"count": 2}, "records": [{"id": 1, "value": "x"}, {"id": 2, "value": "y"}]}')
    (tmp_path / "l.jsonl").write_text('{"id": 1}\nnot json\n{"id": 2}\n')
    assert io.read_json(spark, str(tmp_path / "a.json")).count() == 2
    assert [r["id"] for r in io.read_json(spark, str(tmp_path / "r.json"), "records").collect()] == [1, 2]
    good, bad = io.read_jsonl(spark, str(tmp_path / "l.jsonl"), "id long")
    assert good.count() == 2 and [r["line"] for r in bad.collect()] == ["not json"]


def test_parquet_batches_and_codecs(spark, tmp_path):
    df = spark.range(25).withColumn("p", F.col("id") % 2)
    for codec in ("none", "snappy", "gzip", "zstd"):
        io.write_parquet(df, f"{tmp_path}/{codec}", codec, ["p"])
    assert io.read_parquet(spark, f"{tmp_path}/zstd", ["id"], "p = 1").count() == 12
    assert [len(b) for b in io.batches(df, 10)] == [10, 10, 5]


def test_generated_rows(spark):
    g = io.generate(spark, 500, {"u": "uuid", "t": "timestamp", "i": "int", "f": "float", "b": "bool", "c": "category", "x": "text", "e": "enum:p,q"}, seed=1, error_rate=0.2)
    rows = g.collect()
    assert len(rows) == 500 and {r["e"] for r in rows} == {"p", "q", None}
    assert 40 < sum(r["i"] is None for r in rows) < 180


def test_topic_groups(spark, tmp_path):
    t, seen = io.Topic(spark, str(tmp_path)), []
    t.produce(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), "id")
    t.consume("g", lambda df: seen.extend(json.loads(r["value"])["id"] for r in df.collect()))
    t.produce(spark.createDataFrame([(3, "c")], "id int, v string"), "id")
    t.consume("g", lambda df: seen.extend(json.loads(r["value"])["id"] for r in df.collect()))
    assert sorted(seen) == [1, 2, 3]


def test_http_pages(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.rsplit("=", 1)[1])
            body = json.dumps({"items": [{"id": 10 * page + i, "v": "x"} for i in range(2)]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(io.HttpSource)
    df = spark.read.format("paged_http").schema("id long, v string").option("url", f"http://127.0.0.1:{server.server_port}/?p={{page}}").option("pages", "3").load()
    assert sorted(r["id"] for r in df.collect()) == [0, 1, 10, 11, 20, 21]
    server.shutdown()


# versioned tables -----------------------------------------------------------------------------------------------------
def test_versioned_table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert not t.exists() and t.version() == -1
    rows = lambda *x: spark.createDataFrame(list(x), "id long, v double")
    t.write(rows((1, 1.0), (2, 2.0)))
    t.write(rows((3, 3.0)))
    with pytest.raises(ConflictError):
        t.write(rows((9, 9.0)), "error")
    assert t.version() == 2 and t.read().count() == 3 and t.read(version=1).count() == 2
    assert t.read(where=("id", "3", "3")).count() == 1  # the first folder is left out by its statistics
    t.update(F.col("id") == 1, {"v": F.lit(10.0)})
    t.delete(F.col("id") == 2)
    t.merge(spark.createDataFrame([(3, 30.0), (4, 40.0), (1, None)], "id long, v double"), "id", delete=F.col("v").isNull())
    assert sorted(map(tuple, t.read().collect())) == [(3, 30.0), (4, 40.0)]
    t.write(rows((5, 5.0)))
    before = t.version()
    t.optimize()
    assert t.version() == before + 1 and len(t.snapshot()["files"]) == 1 and t.read().count() == 3
    assert t.read(timestamp=t.commits()[1]["time"]).count() == 2
    with pytest.raises(ValueError):
        t.read(timestamp=0.0)
    t.evolve(add={"w": "string"}, rename={"v": "value"})
    t.write(spark.createDataFrame([(6, 6.0, "new")], "id long, value double, w string"))
    assert t.read().columns == ["id", "value", "w"] and t.read().where("w IS NULL").count() == 3
    t.evolve(drop=["w"])
    assert t.read().columns == ["id", "value"] and t.read().count() == 4
    assert t.history(2).first()["operation"] == "evolve"
    assert t.vacuum(0) and t.read().count() == 4


def test_of_two_writers_one_wins(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.write(spark.range(3))
    with pytest.raises(ConflictError):
        t._commit(t.version(), {"op": "append", "time": 0})
    stale = VersionedTable(spark, str(tmp_path / "t"))
    t.write(spark.range(2))
    stale.write(spark.range(1))  # an append takes the next version
    assert t.read().count() == 6


def test_transforms(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-05-06 07:08:09' AS t, 'abcdef' AS s, CAST(NULL AS STRING) AS n")
    got = df.select(transforms("t", "year"), transforms("t", "month"), transforms("t", "day"), transforms("t", "hour"), transforms("s", "truncate", 3), transforms("n", "identity"), transforms("s", "void")).first()
    assert list(got) == ["2024", "2024-05", "2024-05-06", "2024-05-06-07", "abc", "__null__", None]
    assert 0 <= int(df.select(transforms("s", "bucket", 8)).first()[0]) < 8
    with pytest.raises(ValueError):
        transforms("s", "x")


def test_catalogue_of_tables(spark):
    c, df = catalog.Catalog(), spark.createDataFrame([("a@b.c", "x", "1.2.3.4")], "email string, full_name string, ip string")
    c.register("crm.people", df, ["pii", "raw"])
    c.register("crm.orders", df.select("ip"), ["raw"])
    assert c.list("crm.*") == ["crm.orders", "crm.people"] and c.search("pii") == ["crm.people"]
    with pytest.raises(PermissionError):
        c.read("ann", "crm.people")
    c.grant("ann", "crm.people", "read")
    assert c.read("ann", "crm.people").count() == 1
    c.share("s", "crm.orders")
    assert c.shared_tables(c.recipient("bob", ["s"])) == ["crm.orders"]
    with pytest.raises(PermissionError):
        c.shared_tables(c.recipient("bob", ["s"], hours=-1))
    assert catalog.pii_columns(df) == {"email": "email", "full_name": "name", "ip": "ip_address"} and catalog.sensitivity(df) == "medium"
    e = spark.createDataFrame([("c", "b"), ("b", "a"), ("d", "b")], "src string, dst string")
    assert {r["node"]: r["depth"] for r in catalog.upstream(e, "c").collect()} == {"b": 1, "a": 2}
    assert {r["node"] for r in catalog.downstream(e, "a").collect()} == {"b", "c", "d"}


# streams --------------------------------------------------------------------------------------------------------------
def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", i % 2) for i in range(0, 600, 7)]
    df = spark.createDataFrame(rows, "id long, ts string, k int").withColumn("ts", F.col("ts").cast("timestamp"))
    for i, part in enumerate((df.where("id < 300"), df.where("id >= 300"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    W.run_to_end(W.windowed(W.event_time(stream, "ts", "1 minute"), "ts", "1 hour", ["k"], [F.count("*").alias("n")]), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {tuple(r) for r in W.windowed(df, "ts", "1 hour", ["k"], [F.count("*").alias("n")]).collect()}
    assert got <= want and len(want) - len(got) == 2  # the last hour stays open
    twice = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    twice = W.exactly_once(W.event_time(twice.unionByName(twice), "ts", "1 hour"), ["id", "ts"])
    W.run_to_end(twice, f"{tmp_path}/once", f"{tmp_path}/state2")
    assert spark.read.parquet(f"{tmp_path}/once").count() == len(rows)


def test_replication_and_views(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, v string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], "id long, v string")
    d = cdc.diff(old, new, "id").withColumn("seq", F.lit(1))
    assert {(r["id"], r["op"]) for r in d.collect()} == {(2, "update"), (3, "delete"), (4, "insert")}
    assert d.where("id = 2").first()["changed"] == ["v"]
    log = d.select("op", "id", "after", "seq")
    assert {tuple(r) for r in cdc.apply(old, log, "id").collect()} == {tuple(r) for r in new.collect()}
    assert {tuple(r) for r in cdc.apply(old, log, "id", "target").collect()} == {(1, "a"), (2, "b"), (4, "d")}
    t = VersionedTable(spark, f"{tmp_path}/t")
    t.write(old)
    log.write.parquet(f"{tmp_path}/log")
    cdc.replicate(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log"), t, "id", f"{tmp_path}/state")
    assert {tuple(r) for r in t.read().collect()} == {tuple(r) for r in new.collect()}
    new.createOrReplaceTempView("src")
    v = cdc.MaterialisedViews(spark, f"{tmp_path}/views")
    v.create("byv", "SELECT v, count(*) AS n FROM src GROUP BY v", "immediate")
    assert v.query("byv").count() == 3
    v.apply_delta("byv", spark.createDataFrame([("a", 5)], "v string, n long"), ["v"])
    assert {r["v"]: r["n"] for r in v.rewrite("select v,  count(*) as n from src group by v").collect()}.get("a") in (1, 5)
    assert v.query("byv").where("v = 'a'").first()["n"] == 5


def rows_of(kinds):
    return [{"t": k, "i": i} for i, k in enumerate(kinds)]


def run(pattern, kinds, step=1.0):
    m = cep.Matcher(pattern)
    return [[e["i"] for e in x] for i, r in enumerate(rows_of(kinds)) for x in m.feed(r, i * step)]


def test_patterns():
    is_ = lambda k: (lambda r: r["t"] == k)
    ab = cep.Pattern.begin("a").where(is_("a")).followed_by("b").where(is_("b"))
    assert run(ab, "axb") == [[0, 2]] and run(ab, "aab") == [[0, 2], [1, 2]]
    strict = cep.Pattern.begin("a").where(is_("a")).next("b").where(is_("b"))
    assert run(strict, "axb") == [] and run(strict, "ab") == [[0, 1]]
    assert run(ab.within(1.5), "axxb") == [] and run(ab.within(5), "axxb") == [[0, 3]]
    aa = cep.Pattern.begin("a").where(is_("a")).times(2)
    assert run(aa, "axa") == [[0, 2]]
    opt = cep.Pattern.begin("a").where(is_("a")).followed_by("x").where(is_("x")).optional().followed_by("b").where(is_("b"))
    assert [0, 2] in run(opt, "ayb") and [0, 1, 2] in run(opt, "axb")
    assert sorted(run(ab.non_deterministic(), "abb")) == [[0, 1], [0, 2]]


# quality, discovery, features -----------------------------------------------------------------------------------------
def test_quality(spark):
    df = spark.createDataFrame([(i, float(i), "a" if i % 2 else "") for i in range(20)] + [(99, 1000.0, None)], "id long, v double, s string")
    out = quality.iqr_outliers(df, ["v"]).first()
    assert (out["q1"], out["q3"], out["outliers"]) == (5.0, 15.0, 1)
    prof, clean, said = quality.prepare(df, ["v"], ["s"])
    assert {r["column"]: r["missing"] for r in prof.collect()} == {"id": 0, "v": 0, "s": 11}
    assert clean.count() == 10 and clean.agg(F.max("v")).first()[0] == 19.0
    assert {(r["column"], r["suggestion"]) for r in said.collect()} >= {("v", "normalise"), ("s", "encode")}
    good, bad = quality.validate(spark.createDataFrame([("1", "x"), ("z", None)], "a string, b string"), {"a": "int", "b": "string"}, ["b"])
    assert good.count() == 1 and len(bad.first()["errors"]) == 2
    assert quality.drift(df.schema, df.withColumn("v", F.lit("x")).drop("s").withColumn("n", F.lit(1)).schema) == [("n", "added"), ("s", "removed"), ("v", "retyped")]


def test_discovery(spark):
    s = {"orders": ["o_orderkey", "o_custkey", "o_totalprice"], "customer": ["c_custkey", "c_nationkey"], "nation": ["n_nationkey"], "lone": ["x"]}
    assert [e[2] for e in discovery.join_path(s, "orders", "nation")] == ["customer", "nation"]
    assert discovery.join_path(s, "orders", "lone") is None
    assert discovery.to_sql("how many orders by o_custkey", s) == "SELECT o_custkey, count(*) AS value FROM orders GROUP BY o_custkey"
    assert discovery.to_sql("top 3 totalprice of orders", s) == "SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 3"
    with pytest.raises(ValueError):
        discovery.to_sql("nothing known", s)


def test_features_models_search(spark):
    m = features.Models()
    m.log({"a": 1}, {"acc": 0.5})
    m.log({"a": 2}, {"acc": 0.9})
    assert m.best("acc")["params"] == {"a": 2}
    m.register("m", lambda c: c["x"] * 2)
    m.register("m", lambda c: c["x"] * 3)
    m.promote("m", 1, "production")
    m.promote("m", 2, "production")
    df = features.score_with(spark.createDataFrame([(1.0,), (2.0,)], "x double"), m.serve("m"), ["x"])
    assert [r["prediction"] for r in df.collect()] == [3.0, 6.0]
    best, value = features.search({"x": (-5, 5), "y": (-5, 5)}, lambda p: -((p["x"] - 1) ** 2) - (p["y"] + 2) ** 2, rounds=60)
    assert value > -0.5 and abs(best["x"] - 1) < 1


def _pairs_by_task(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_null_keys_of_an_outer_join_meet_in_many_tasks(spark):
    a = spark.range(400, numPartitions=1).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("v"))
    b = spark.range(50, numPartitions=1).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("w"))
    n = _pairs_by_task(R.join(a, b, "k", "outer", null_safe=True))
    assert sum(n) == 20_000 and max(n) < 4_000


def test_null_keys_of_an_inner_join_meet_in_many_tasks_even_without_broadcasts(spark):
    a = spark.range(401, numPartitions=1).select(F.when(F.col("id") < 400, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    b = spark.range(351, 402, numPartitions=1).select(F.when(F.col("id") != 400, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("w"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in (was, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            n = _pairs_by_task(R.join(a, b, "k", "inner", null_safe=True))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        assert sum(n) == 20_001 and max(n) < 4_000


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer", "semi", "anti"])
def test_null_safe_join_of_several_keys(spark, how):
    rows = [(None, None), (None, 1), (1, None), (1, 1), (None, None), (None, 2)]
    a = spark.createDataFrame([(x, y, i) for i, (x, y) in enumerate([*rows, (7, 7)])], "x int, y int, v int")
    for theirs in (rows + [(8, 8)], [(1, None), (9, None)], []):
        b = spark.createDataFrame([(x, y, i) for i, (x, y) in enumerate(theirs)], "x int, y int, w int")
        a.createOrReplaceTempView("null_a"), b.createOrReplaceTempView("null_b")
        cols = {"semi": "a.*", "anti": "a.*", "inner": "a.*, w", "left": "a.*, w"}.get(how, "coalesce(a.x, b.x), coalesce(a.y, b.y), v, w")
        want = spark.sql(f"SELECT {cols} FROM null_a a {'full' if how == 'outer' else how} JOIN null_b b ON a.x <=> b.x AND a.y <=> b.y")
        assert sorted(map(str, map(tuple, R.join(a, b, ["x", "y"], how, null_safe=True).collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_skip(spark):
    rows = [(x, y) for x in (None, 2.0, float("nan"), -1.0, 2.0) for y in (None, 3, 3, 1)]
    df = spark.createDataFrame(rows, "x double, y int")
    for n in (0, 1, 5, 9, 19, 20, 99):
        assert list(map(str, R.skip(df, n, "x", "y").collect())) == list(map(str, df.orderBy("x", "y").collect()))[n:]
    assert R.skip(df.where("y > 5"), 3, "x").count() == 0
    many = spark.range(100_000, numPartitions=8)
    got = R.skip(many, 1000, "id")
    assert [got.count(), got.first()["id"]] == [99_000, 1000]


def test_skip_sorts_in_parts(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would merge so few rows
    try:
        parts = R.skip(spark.range(100_000, numPartitions=8), 1000, "id").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) > 1 and max(r["count"] for r in parts) < 60_000


def test_query_with_an_offset_sends_no_rows_through_one_task(spark):
    from loomwork.plans.catalogue import registry

    plan = registry.queries["offset_without_limit"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CollectLimit" not in plan and "GlobalLimit" not in plan


@pytest.mark.parametrize("few", [True, False])
def test_recommendations(spark, few):
    from loomwork.operators import industry

    had = {1: "abc", 2: "abd", 3: "bd", 4: "cde", 5: "z", 6: "abcdez"}
    df = spark.createDataFrame([(u, i) for u, s in had.items() for i in s] + [(1, "a"), (3, None)], "u int, i string")
    who = {i: {u for u, s in had.items() if i in s} for i in "abcdez"}
    sim = lambda a, b: len(who[a] & who[b]) / len(who[a] | who[b])
    want = set()
    for u, s in had.items():
        score = {b: sum(sim(a, b) for a in s) for b in who if b not in s and any(who[a] & who[b] for a in s)}
        want |= {(u, i, r, round(score[i], 6)) for r, i in enumerate(sorted(score, key=lambda i: (-round(score[i], 9), i))[:2], 1)}
    got = industry.recommend(df, "u", "i", 2, few=few).collect()
    assert {(r["u"], r["i"], r["rank"], round(r["score"], 6)) for r in got} == want and len(got) == len(want)


def test_query_of_recommendations_shuffles_baskets_only(spark):
    from loomwork.plans.catalogue import registry

    plan = registry.queries["recommend_items"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("BroadcastHashJoin")]  # sums and ranks of each user's candidates
    assert "Window" in above and "Exchange" not in above and "SortMergeJoin" not in above


def test_joins_and_scalars(spark):
    a = spark.createDataFrame([(1, "l"), (None, "l")], "k int, v string")
    b = spark.createDataFrame([(1, "r"), (None, "r")], "k int, v string")
    assert R.join(a, b, "k").count() == 1 and R.join(a, b, "k", null_safe=True).count() == 2
    assert R.join(a, b, "k").first()["v"] == "l"
    with pytest.raises(ValueError):
        R.join(a, b, "k", "sideways")
    assert R.strategy(spark.range(5), spark.range(9)) == "broadcast_hash" and R.describe(spark.range(0)).first()["count"] == 0
    row = spark.createDataFrame([("  ab \t", 2.5)], "s string, x double").select(compat.strip(F.col("s")), compat.half_even(F.col("x")), compat.substr0(F.lit("hello"), 1, 3), compat.concat_lenient(F.lit("a"), F.lit(None)), compat.cast_or_null(F.lit("x"), "int")).first()
    assert list(row) == ["ab", 2.0, "ell", "a", None]


def test_pattern_stream_keeps_state(spark, tmp_path):
    from loomwork.streaming.stateful import match_stream

    rows = [(1, "u", "a", 0), (2, "v", "a", 1), (3, "u", "x", 2), (4, "u", "b", 3), (5, "v", "b", 4000)]
    df = spark.createDataFrame(rows, "id long, k string, t string, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000))
    for i in (0, 1):
        df.where(f"id {'<=' if i == 0 else '>'} 2").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    p = cep.Pattern.begin("a", "ab").where(lambda r: r["t"] == "a").followed_by("b").where(lambda r: r["t"] == "b").within(60)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("ts", "1 hour")
    W.run_to_end(match_stream(stream, "k", "ts", [p], "id"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert [(r["k"], r["events"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("u", [1, 4])]


def test_routes(spark):
    from loomwork.operators.routes import fewest_hops

    links = spark.createDataFrame([("a", "b", 1.0), ("b", "d", 1.0), ("a", "c", 5.0), ("c", "d", 5.0), ("d", "a", 1.0), ("a", "e", 9.0)], "src string, dst string, cost double")
    assert fewest_hops(links, "a", "d").first()["path"] == ["a", "b", "d"]
    assert fewest_hops(links, "e", "a").count() == 0


def test_retries_breaker_and_cache(spark):
    from loomwork.operators.caching import Cache
    from loomwork.sources.resilience import Breaker, OpenError, retry

    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert retry(flaky, wait=1, jitter=0, sleep=waits.append) == 7 and waits == [1, 2]
    now = [0.0]
    b = Breaker(2, 10, clock=lambda: now[0])
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            b.call(lambda: 1 / 0)
    with pytest.raises(OpenError):
        b.call(lambda: 1)
    now[0] = 11
    assert b.call(lambda: 1) == 1
    c = Cache(2)
    df = c.get("a", lambda: spark.range(3), ("t",))
    assert c.get("a", lambda: None) is df
    c.get("b", lambda: spark.range(1))
    c.get("c", lambda: spark.range(1), ("t",))
    assert c.names() == ["a", "c"] and c.invalidate("t") == ["a", "c"] and c.names() == []


def test_optimisers():
    import numpy as np

    from loomwork.operators import optimise

    f = lambda p: (p["x"] - 1) ** 2 + (p["y"] + 2) ** 2
    bounds = {"x": (-5, 5), "y": (-5, 5)}
    assert optimise.particles(f, bounds)[1] < 1e-3 and optimise.fireflies(f, bounds)[1] < 0.5 and optimise.hybrid(f, bounds)[1] < 1e-3
    a = np.linspace(0, 2 * np.pi, 9)[:-1]
    xy = np.stack([np.cos(a), np.sin(a)], axis=1)
    d = np.linalg.norm(xy[:, None] - xy[None], axis=2)
    assert abs(optimise.ant_tour(d)[1] - d[range(8), [(i + 1) % 8 for i in range(8)]].sum()) < 1e-6


def test_a_change_is_not_lost_to_another_writer(spark, tmp_path, monkeypatch):
    import pytest
    from pyspark.sql import functions as F

    from loomwork.sources.versioned import ConflictError, VersionedTable

    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.write(spark.range(10))
    store = t._store

    def between(df, by):
        monkeypatch.setattr(t, "_store", store)
        VersionedTable(spark, t.path).write(spark.range(100, 105))
        return store(df, by)

    monkeypatch.setattr(t, "_store", between)
    with pytest.raises(ConflictError):
        t.delete(F.col("id") == 3)
    assert t.read().count() == 15
    t.delete(F.col("id") == 3)
    assert t.read().count() == 14
