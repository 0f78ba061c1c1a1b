"""Event time, changes, patterns, quality, industry and series kernels, storage and placement."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import functions as F

from loomwork.operators import discovery as D
from loomwork.operators import industry as I
from loomwork.operators import partitioning as P
from loomwork.operators import quality as Q
from loomwork.operators import timeseries as S
from loomwork.plans.catalogue import registry
from loomwork.session import ship, table
from loomwork.streaming import cdc, cep
from loomwork.streaming import windows as W

q = registry.query
_temp: list[str] = []


def _folder(spark, name: str) -> str:
    """A new folder below the shared one; a temporary one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _temp:
            _temp.append(tempfile.mkdtemp(prefix="loomwork-q-"))
            atexit.register(shutil.rmtree, _temp[0], ignore_errors=True)
        base = f"file://{_temp[0]}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# event time -----------------------------------------------------------------------------------------------------------
def _n():
    return [F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")]


@q(oracle="SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') + INTERVAL '1 hour' AS window_end, user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2, 3")
def stream_tumbling(spark, sf_dir):
    return W.windowed(table(spark, sf_dir, "events"), "ts", "1 hour", ["user_id"], _n())


@q(oracle="SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') - k * INTERVAL '1 hour' AS window_start, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') - k * INTERVAL '1 hour' + INTERVAL '2 hours' AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2, 3")
def stream_sliding(spark, sf_dir):
    return W.windowed(table(spark, sf_dir, "events"), "ts", "2 hours", ["event_type"], _n(), slide="1 hour")


@q(oracle="""WITH a AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL '30 minutes' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a) SELECT min(ts) AS window_start, max(ts) + INTERVAL '30 minutes' AS window_end, user_id, count(*) AS n, round(sum(value), 2) AS total FROM b GROUP BY user_id, s""")
def stream_session(spark, sf_dir):
    return W.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"], _n())


@q(oracle="WITH a AS (SELECT *, 2 * (event_id + CASE WHEN event_id % 10 = 0 THEN 25 ELSE 0 END) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS arrival, user_id % 4 AS source FROM events), l AS (SELECT *, max(ts) OVER (PARTITION BY source ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - INTERVAL '30 minutes' AS watermark FROM a) SELECT event_id, CASE WHEN ts < watermark - INTERVAL '15 minutes' THEN 'dropped' WHEN ts < watermark THEN 'side' ELSE 'main' END AS fate FROM l")
def stream_late_policies(spark, sf_dir):
    arrival = 2 * (F.col("event_id") + F.when(F.col("event_id") % 10 == 0, 25).otherwise(0)) + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    e = table(spark, sf_dir, "events").withColumns({"arrival": arrival, "source": F.col("user_id") % 4})
    marked = W.with_lateness(e, "arrival", "ts", "30 MINUTES", ["source"])
    kept, _ = W.late_policy(marked, "ts", "drop", "15 MINUTES")
    main, _ = W.late_policy(marked, "ts", "side_output")
    fate = lambda df, name: df.select("event_id", F.lit(name).alias("fate"))
    return fate(main, "main").unionByName(fate(kept.join(main.select("event_id"), "event_id", "left_anti"), "side")).unionByName(fate(marked.join(kept.select("event_id"), "event_id", "left_anti"), "dropped"))


@q(oracle="SELECT event_id, user_id FROM events")
def stream_exactly_once(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    twice = e.withColumn("arrival", F.col("event_id")).unionByName(e.where("event_id % 3 = 0").withColumn("arrival", F.col("event_id") + 5))
    return W.exactly_once(twice, ["user_id", "ts"], "arrival").select("event_id", "user_id")


@q(oracle="SELECT event_id, max(CASE WHEN event_type = 'signup' THEN ts END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS watermark FROM events")
def stream_punctuated_watermark(spark, sf_dir):
    return W.punctuated(table(spark, sf_dir, "events"), "ts", F.col("event_type") == "signup", "event_id", ["user_id"]).select("event_id", "watermark")


@q(oracle="SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS n FROM events WHERE date_trunc('day', ts) < (SELECT date_trunc('day', max(ts) - INTERVAL '1 hour') FROM events) GROUP BY 1")
def stream_append_mode(spark, sf_dir):
    """A real streaming query over the table's files: windows that the watermark has closed."""
    stream = W.table_stream(spark, sf_dir, "events")
    agg = W.event_time(stream, "ts", "1 hour").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    out = _folder(spark, "stream")
    W.run_to_end(agg.select(F.col("w.start").alias("window_start"), "n"), f"{out}/data", f"{out}/state")
    return spark.read.schema("window_start timestamp, n long").parquet(f"{out}/data").select(F.col("window_start").cast("timestamp_ntz"), "n")


# changes --------------------------------------------------------------------------------------------------------------
def _snapshots(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    old = o.where("o_orderkey % 13 <> 0")
    new = o.where("o_orderkey % 11 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return old, new


_SNAP = "WITH old AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 13 <> 0), new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 11 <> 0) "


@q(oracle=_SNAP + "SELECT CASE WHEN old.o_orderkey IS NULL THEN 'insert' WHEN new.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS op, coalesce(old.o_orderkey, new.o_orderkey) AS o_orderkey, old.o_totalprice AS before, new.o_totalprice AS after, CASE WHEN old.o_orderkey IS NOT NULL AND new.o_orderkey IS NOT NULL THEN 'o_totalprice' ELSE '' END AS changed FROM old FULL JOIN new ON old.o_orderkey = new.o_orderkey WHERE old.o_orderkey IS NULL OR new.o_orderkey IS NULL OR old.o_totalprice <> new.o_totalprice")
def cdc_diff(spark, sf_dir):
    d = cdc.diff(*_snapshots(spark, sf_dir), "o_orderkey")
    return d.select("op", "o_orderkey", F.col("before.o_totalprice").alias("before"), F.col("after.o_totalprice").alias("after"), F.coalesce(F.array_join("changed", ","), F.lit("")).alias("changed"))


@q(oracle=_SNAP + "SELECT * FROM new")
def cdc_apply(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    d = cdc.diff(old, new, "o_orderkey")
    log = d.select("op", "o_orderkey", "after", F.lit(2).alias("seq")).unionByName(d.where("op = 'update'").select(F.lit("delete").alias("op"), "o_orderkey", "after", F.lit(1).alias("seq")))
    return cdc.apply(old, cdc.since(log, 0), "o_orderkey")


@q(oracle="SELECT o_custkey, count(*) AS n, round(sum(CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END), 2) AS total FROM orders GROUP BY 1")
def view_incremental(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    now = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    aggs = [F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")]
    return cdc.refresh_keys(o.groupBy("o_custkey").agg(*aggs), now, now.where("o_orderkey % 7 = 0"), ["o_custkey"], aggs)


# patterns -------------------------------------------------------------------------------------------------------------
@q(oracle="WITH a AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS followed_at FROM events) SELECT event_id, user_id, followed_at FROM a WHERE event_type = 'view' AND followed_at - ts <= INTERVAL '24 hours'")
def cep_followed_by(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return cep.first_followed_by(e, "user_id", "ts", F.col("event_type") == "view", F.col("event_type") == "purchase", 86400).select("event_id", "user_id", "followed_at")


@q(oracle="WITH a AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS last FROM events) SELECT user_id, 'buys' AS pattern, ts AS first, last FROM a WHERE event_type = 'view' AND last - ts <= INTERVAL '24 hours'")
def cep_general_matcher(spark, sf_dir):
    ship(spark)
    is_ = lambda kind: (lambda r: r["event_type"] == kind)
    p = cep.Pattern.begin("view", "buys").where(is_("view")).followed_by("purchase").where(is_("purchase")).within(86400)
    return cep.matches(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", [p], "event_id").select("user_id", "pattern", "first", "last")


@q(oracle="WITH a AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) SELECT event_id, user_id FROM a WHERE event_type = 'click' AND nxt = 'purchase'")
def cep_strict_next(spark, sf_dir):
    return cep.next_is(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("event_type") == "click", F.col("event_type") == "purchase").select("event_id", "user_id")


@q(oracle="WITH a AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '2 days' PRECEDING AND CURRENT ROW) AS hits FROM events WHERE event_type = 'error') SELECT * FROM a WHERE hits >= 3")
def cep_times_within(spark, sf_dir):
    return cep.times_within(table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "error", 3, 172800).select("event_id", "user_id", "hits")


# quality --------------------------------------------------------------------------------------------------------------
def _holes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("c_acctbal"))


_HOLES = "WITH h AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS c_acctbal FROM customer) "
_PROF = "SELECT '{c}' AS \"column\", count(*) AS \"rows\", count(*) FILTER (WHERE {c} IS NULL) AS missing, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS distinct_values, count(*) FILTER (WHERE {c} IS NULL) > 0.3 * count(*) AS missing_high, count(*) - (count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)) AS duplicates FROM h"


@q(oracle=_HOLES + " UNION ALL ".join(_PROF.format(c=c) for c in ("c_custkey", "c_mktsegment", "c_acctbal")))
def dq_profile(spark, sf_dir):
    return Q.profile(_holes(spark, sf_dir))


_POS = "SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM (SELECT {e} AS v FROM {t}) x WHERE v IS NOT NULL"


@q(oracle="WITH s AS (" + _POS.format(e="value", t="events") + "), f AS (SELECT max(n) AS n, max(CASE WHEN i = n // 4 THEN v END) AS q1, max(CASE WHEN i = 3 * n // 4 THEN v END) AS q3 FROM s) SELECT 'value' AS \"column\", f.n AS n, q1, q3, count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers FROM s, f GROUP BY ALL")
def dq_iqr_outliers(spark, sf_dir):
    return Q.iqr_outliers(table(spark, sf_dir, "events"), ["value"])


@q(oracle=_HOLES + ", s AS (" + _POS.format(e="c_acctbal", t="h WHERE c_mktsegment IS NOT NULL") + "), f AS (SELECT max(CASE WHEN i = CAST(floor(0.05 * n) AS BIGINT) THEN v END) AS lo, max(CASE WHEN i = CAST(floor(0.95 * n) AS BIGINT) THEN v END) AS hi FROM s) SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal IS NOT NULL THEN least(greatest(c_acctbal, lo), hi) END AS c_acctbal FROM h, f WHERE c_mktsegment IS NOT NULL")
def dq_winsorise(spark, sf_dir):
    return Q.auto_clean(_holes(spark, sf_dir), ["c_acctbal"], ["c_mktsegment"])


@q(oracle="SELECT 'p_size' AS \"column\", 'normalise' AS suggestion UNION ALL SELECT 'p_type', 'encode' UNION ALL SELECT 'd', 'parse_date'")
def dq_suggest(spark, sf_dir):
    return Q.suggest(table(spark, sf_dir, "part").select("p_size", "p_type", F.concat(F.lit("2024-01-"), F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0")).alias("d")))


def _raw(spark, sf_dir):
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.when(o % 10 == 0, "bad").otherwise(o.cast("string")).alias("id"), F.when(o % 4 == 0, None).when(o % 6 == 1, "x1").otherwise(F.col("o_totalprice").cast("string")).alias("price"))


_RAW = "WITH r AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'bad' ELSE CAST(o_orderkey AS VARCHAR) END AS id, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 6 = 1 THEN 'x1' ELSE CAST(o_totalprice AS VARCHAR) END AS price FROM orders) "


@q(oracle=_RAW + "SELECT CAST(id AS BIGINT) AS id, CAST(price AS DOUBLE) AS price FROM r WHERE try_cast(id AS BIGINT) IS NOT NULL AND try_cast(price AS DOUBLE) IS NOT NULL")
def dq_validate(spark, sf_dir):
    return Q.validate(_raw(spark, sf_dir), {"id": "long", "price": "double"}, ["price"])[0]


@q(oracle=_RAW + "SELECT 'id' AS \"column\", 'type' AS error_type, count(*) AS \"rows\" FROM r WHERE id = 'bad' UNION ALL SELECT 'price', 'missing', count(*) FROM r WHERE price IS NULL UNION ALL SELECT 'price', 'type', count(*) FROM r WHERE price = 'x1'")
def dq_dead_letters(spark, sf_dir):
    return Q.dead_letters(Q.validate(_raw(spark, sf_dir), {"id": "long", "price": "double"}, ["price"])[1])


@q(oracle="WITH e AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) OR row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 1 ELSE 0 END AS fresh FROM events) SELECT 'event_type' AS \"column\", count(*) AS \"rows\", count(DISTINCT event_type) AS distinct_values, CAST(sum(fresh) AS BIGINT) AS runs, count(DISTINCT event_type) < 0.5 * count(*) AS dictionary, sum(fresh) < 0.5 * count(*) AS run_length FROM e")
def encoding_profile(spark, sf_dir):
    return Q.encoding_profile(table(spark, sf_dir, "events"), ["event_type"], "event_id", ["user_id"])


@q(oracle="WITH a AS (SELECT avg(n) AS x FROM (SELECT count(*) AS n FROM customer GROUP BY c_custkey)), b AS (SELECT avg(n) AS y FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)) SELECT x AS left_rows, round(y, 6) AS right_rows, CASE WHEN x <= 1.1 AND y <= 1.1 THEN 'one_to_one' WHEN x > 1.1 AND y > 1.1 THEN 'many_to_many' ELSE 'one_to_many' END AS kind FROM a, b")
def relationship_kind(spark, sf_dir):
    return D.multiplicity(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey").withColumn("right_rows", F.round("right_rows", 6))


@q(oracle="SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def join_path(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "nation")}
    path = D.join_path({k: v.columns for k, v in t.items()}, "orders", "nation")
    return D.join_along(t, path, "orders").groupBy("n_name").agg(F.count("*").alias("n"))


@q(oracle="SELECT o_orderstatus, avg(o_totalprice) AS value FROM orders WHERE o_custkey > 500 GROUP BY o_orderstatus")
def question_in_words(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    o.createOrReplaceTempView("orders")
    text = D.to_sql("average o_totalprice of orders by o_orderstatus where o_custkey over 500", {"orders": o.columns})
    return spark.sql(text).withColumn("value", F.round("value", 4))


registry.sql["question_in_words"] = registry.sql["question_in_words"].replace("avg(o_totalprice) AS value", "round(avg(o_totalprice), 4) AS value")


# industry -------------------------------------------------------------------------------------------------------------
@q(oracle="""WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) // 20 AS loc FROM events), w AS (SELECT *, coalesce(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), value) AS m, row_number() OVER (PARTITION BY user_id, loc ORDER BY ts, event_id) AS ln, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM e),
s AS (SELECT event_id, CASE WHEN value > 3 * m THEN 3 ELSE 0 END + CASE WHEN ln = 1 THEN 2 ELSE 0 END + CASE WHEN rn > 1 THEN 1 ELSE 0 END + CASE WHEN event_type = 'error' THEN 4 ELSE 0 END AS t FROM w)
SELECT event_id, t / 10 AS score, CASE WHEN t < 3 THEN 'low' WHEN t < 5 THEN 'medium' WHEN t < 7 THEN 'high' ELSE 'critical' END AS level, t / 10 >= 0.7 AS review FROM s""")
def fraud_scores(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("loc", F.floor(F.get_json_object("props", "$.k").cast("long") / 20))
    return I.fraud_scores(e, "user_id", ["ts", "event_id"], "value", "loc", F.col("event_type") == "error").select("event_id", "score", "level", "review")


@q(oracle="SELECT c_nationkey, round(avg(coalesce(CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal / 10000 END, 0.5)), 6) AS credit_risk, round(avg(coalesce(NULL, 0.2)), 6) AS volatility_risk, 0.5::DOUBLE AS market_risk, round(avg(1 - c_custkey % 3 / 10), 6) AS liquidity_risk FROM customer GROUP BY 1")
def portfolio_risk(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal") / 10000).alias("r"), F.lit(None).cast("double").alias("v"), (F.col("c_custkey") % 3 / 10).alias("l"))
    got = I.portfolio_risk(c, "c_nationkey", "r", "v", "l")
    return got.select("c_nationkey", *[F.round(x, 6).alias(x) for x in ("credit_risk", "volatility_risk")], "market_risk", F.round("liquidity_risk", 6).alias("liquidity_risk"))


@q(oracle="WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) SELECT c_custkey, round(coalesce(sum(o_totalprice), 0), 2) AS lifetime_value, count(o_orderkey) AS n_purchases, coalesce(string_agg(CASE WHEN r <= 5 THEN CAST(o_orderkey AS VARCHAR) END, ',' ORDER BY r), '') AS recent FROM customer LEFT JOIN o ON c_custkey = o_custkey GROUP BY 1")
def customer_360(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey").withColumn("item", F.col("o_orderkey").cast("string"))
    got = I.customer_360(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", "o_totalprice", [F.desc("o_orderdate"), F.desc("o_orderkey")], "item")
    return got.select("c_custkey", F.round("lifetime_value", 2).alias("lifetime_value"), "n_purchases", F.coalesce(F.array_join("recent", ","), F.lit("")).alias("recent"))


@q(oracle="""WITH d AS (SELECT l_partkey, l_shipdate, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC) AS r FROM d), l AS (SELECT *, count(*) OVER (PARTITION BY l_partkey) AS n FROM r WHERE r <= 30),
a AS (SELECT l_partkey, n, avg(q) AS mean, avg(CASE WHEN r > n - n // 2 THEN q END) AS x, avg(CASE WHEN r <= n - n // 2 THEN q END) AS y FROM l GROUP BY 1, 2 HAVING n >= 3)
SELECT l_partkey, step, CAST(greatest(floor(mean + CASE WHEN n >= 7 THEN (y - x) / n ELSE 0 END * step), 0) AS BIGINT) AS forecast FROM a, (SELECT CAST(unnest([1, 2, 3]) AS INT) AS step)""")
def demand_forecast(spark, sf_dir):
    return I.demand_forecast(table(spark, sf_dir, "lineitem"), "l_partkey", "l_shipdate", "l_quantity", 3)


_ITEMS = "WITH u AS (SELECT DISTINCT o_custkey AS u, l_partkey % 50 AS i FROM orders JOIN lineitem ON o_orderkey = l_orderkey), n AS (SELECT i, count(*) AS n FROM u GROUP BY 1), s AS (SELECT a.i AS a, b.i AS b, count(*) AS co FROM u a JOIN u b ON a.u = b.u AND a.i < b.i GROUP BY 1, 2), j AS (SELECT a, b, co, co / (x.n + y.n - co) AS sim FROM s JOIN n x ON a = x.i JOIN n y ON b = y.i) "


def _bought(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(l, o.o_orderkey == l.l_orderkey).select(F.col("o_custkey").alias("u"), (F.col("l_partkey") % 50).alias("i"))


@q(oracle=_ITEMS + "SELECT a, b, co, round(sim, 9) AS similarity FROM j")
def item_similarity(spark, sf_dir):
    return I.item_similarity(_bought(spark, sf_dir), "u", "i").withColumn("similarity", F.round("similarity", 9))


@q(oracle=_ITEMS + ", d AS (SELECT a, b, sim FROM j UNION ALL SELECT b, a, sim FROM j), g AS (SELECT u.u, d.b AS i, sum(sim) AS score FROM u JOIN d ON u.i = d.a WHERE NOT EXISTS (SELECT 1 FROM u o WHERE o.u = u.u AND o.i = d.b) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY round(score, 9) DESC, i) AS rank FROM g) SELECT u, i, round(score, 6) AS score, rank FROM r WHERE rank <= 3")
def recommend_items(spark, sf_dir):
    return I.recommend(_bought(spark, sf_dir), "u", "i", 3, few=True).select("u", "i", F.round("score", 6).alias("score"), "rank")


@q(oracle="WITH l(event_type, low, high) AS (VALUES ('click', 10.0, 60.0), ('view', 5.0, 30.0)) SELECT event_id, event_type, CASE WHEN abs(value - high) > 50 THEN 'high' ELSE 'medium' END AS severity FROM events JOIN l USING (event_type) WHERE value < low OR value > high")
def sensor_anomalies(spark, sf_dir):
    limits = spark.createDataFrame([("click", 10.0, 60.0), ("view", 5.0, 30.0)], "event_type string, low double, high double")
    return I.sensor_anomalies(table(spark, sf_dir, "events"), limits, "event_type", "value").select("event_id", "event_type", "severity")


@q(oracle="WITH r AS (SELECT user_id, 0.7 * least(max(event_id) / 12000.0::DOUBLE, 1.0) + 0.3 * (CASE WHEN max(value) > 50 THEN 0.2 ELSE 0 END + CASE WHEN max(value) > 80 THEN 0.3 ELSE 0 END) AS risk FROM events GROUP BY 1) SELECT user_id, round(risk, 9) AS risk, CASE WHEN risk >= 0.7 THEN 'critical' WHEN risk >= 0.4 THEN 'warning' ELSE 'healthy' END AS status FROM r")
def failure_risk(spark, sf_dir):
    return I.failure_risk(table(spark, sf_dir, "events"), "user_id", "event_id", 12000.0, "value", "value").withColumn("risk", F.round("risk", 9))


@q(oracle="SELECT l_suppkey, count(*) AS units, count(*) FILTER (WHERE l_returnflag = 'R') AS defects, round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 9) AS rate, count(*) FILTER (WHERE l_returnflag = 'R') / count(*) <= 0.33 AS passed FROM lineitem GROUP BY 1")
def defect_rates(spark, sf_dir):
    return I.defect_rates(table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_returnflag") == "R", 0.33).withColumn("rate", F.round("rate", 9))


@q(oracle="WITH c AS (SELECT event_type, count(*) AS defects FROM events GROUP BY 1) SELECT event_type, defects, row_number() OVER w AS rank, round(sum(defects) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(defects) OVER (), 9) AS share FROM c WINDOW w AS (ORDER BY defects DESC, event_type)")
def defect_pareto(spark, sf_dir):
    return I.pareto(table(spark, sf_dir, "events"), "event_type").withColumn("share", F.round("share", 9))


@q(oracle="SELECT c_custkey, substring(sha256(c_name), 1, 16) AS who, CAST(floor(c_acctbal / 500) * 500 AS BIGINT) AS band, rpad(substring(c_mktsegment, 1, 2), CAST(length(c_mktsegment) AS INT), '*') AS segment FROM customer")
def anonymise(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", I.anonymise(F.col("c_name")).alias("who"), I.k_number(F.col("c_acctbal"), 500).cast("long").alias("band"), I.k_text(F.col("c_mktsegment")).alias("segment"))


@q(oracle="SELECT c_custkey, c_name FROM customer")
def encrypt_round_trip(spark, sf_dir):
    key = F.lit(b"0123456789abcdef")
    return table(spark, sf_dir, "customer").select("c_custkey", I.decrypt(I.encrypt(F.col("c_name"), key), key).alias("c_name"))


@q(oracle="SELECT count(*) = 25 AS all_groups, TRUE AS close FROM nation")
def private_aggregate(spark, sf_dir):
    """Noisy counts stay near the true ones; the noise itself is random."""
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    noisy = n.withColumn("m", I.noisy(F.col("n"), 1.0, 1.0, 7))
    return noisy.agg((F.count("*") == 25).alias("all_groups"), (F.max(F.abs(F.col("m") - F.col("n"))) < 40).alias("close"))


# series ---------------------------------------------------------------------------------------------------------------
_PROFILE = "WITH p AS (SELECT h.hour, coalesce(m, 0) AS mean_rows FROM (SELECT unnest(range(24)) AS hour) h LEFT JOIN (SELECT hour, avg(n) AS m FROM (SELECT CAST(ts AS DATE) AS d, hour(ts) AS hour, count(*) AS n FROM events WHERE hour(ts) <> 3 AND (hour(ts) > 8 OR user_id % 3 = 0) GROUP BY 1, 2) GROUP BY 1) x ON h.hour = x.hour) "


def _profile(spark, sf_dir):
    return S.hourly_profile(table(spark, sf_dir, "events").where("hour(ts) <> 3 AND (hour(ts) > 8 OR user_id % 3 = 0)"), "ts")


@q(oracle=_PROFILE + "SELECT CAST(hour AS INT) AS hour, round(mean_rows, 6) AS mean_rows FROM p")
def ts_hourly_profile(spark, sf_dir):
    return _profile(spark, sf_dir).withColumn("mean_rows", F.round("mean_rows", 6))


@q(oracle=_PROFILE + "SELECT * FROM (SELECT CAST(hour AS INT) AS hour, CASE WHEN mean_rows > 1.3 * avg(mean_rows) OVER () THEN 'peak' WHEN mean_rows < 0.7 * avg(mean_rows) OVER () THEN 'low' END AS kind FROM p) WHERE kind IS NOT NULL")
def ts_peak_low_hours(spark, sf_dir):
    return S.peaks(_profile(spark, sf_dir))


@q(oracle=_PROFILE + "SELECT round(stddev_samp(mean_rows) / avg(mean_rows), 9) AS variation, stddev_samp(mean_rows) / avg(mean_rows) > 0.3 AS periodic FROM p")
def ts_periodicity(spark, sf_dir):
    return S.periodicity(_profile(spark, sf_dir)).withColumn("variation", F.round("variation", 9))


@q(oracle="WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, n, round(CASE WHEN n < 100 THEN 0 ELSE (avg(CASE WHEN r > n - n // 4 THEN value END) - avg(CASE WHEN r <= n // 4 THEN value END)) / avg(CASE WHEN r <= n // 4 THEN value END) END, 9) AS trend FROM r GROUP BY 1, 2")
def ts_quarter_trend(spark, sf_dir):
    return S.quarter_trend(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value").withColumn("trend", F.round("trend", 9))


@q(oracle="WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events), l AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM r WHERE r <= 20) SELECT user_id, round((avg(CASE WHEN r <= n - n // 2 THEN value END) - avg(CASE WHEN r > n - n // 2 THEN value END)) / avg(CASE WHEN r > n - n // 2 THEN value END), 9) AS change, n / 20 AS confidence FROM l GROUP BY user_id, n")
def ts_half_trend(spark, sf_dir):
    return S.half_trend(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").withColumn("change", F.round("change", 9))


@q(oracle="WITH l AS (SELECT user_id, arg_max(upper(event_type), ts) AS s FROM events GROUP BY 1) SELECT coalesce(arg_min(s, CASE s WHEN 'ERROR' THEN 0 WHEN 'SIGNUP' THEN 1 END), 'HEALTHY') AS status, round(avg(CASE WHEN s IN ('ERROR', 'SIGNUP') THEN 0 ELSE 1 END), 9) AS healthy FROM l")
def ts_latest_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("s", F.upper("event_type"))
    return S.latest_status(e, "user_id", "ts", "s", ["ERROR", "SIGNUP"]).withColumn("healthy", F.round("healthy", 9))


@q(oracle="WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events), s AS (SELECT user_id, avg(CASE WHEN r <= greatest(n // 4, 1) THEN value END) AS a, avg(CASE WHEN r > n - greatest(n // 4, 1) THEN value END) AS b, stddev_samp(value) / avg(value) AS cv, avg(CASE WHEN r > n - 20 THEN CASE WHEN value >= 60 THEN 1 ELSE 0 END END) AS c FROM r WHERE n >= 10 GROUP BY user_id, n), e AS (SELECT user_id, (CASE WHEN b > 1.5 * a THEN 20 ELSE 0 END + CASE WHEN cv > 0.5 THEN 15 ELSE 0 END + CASE WHEN c > 0.3 THEN 30 ELSE 0 END) / 100 AS evidence FROM s) SELECT * FROM e WHERE evidence > 0.4")
def ts_failure_evidence(spark, sf_dir):
    return S.failure_evidence(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 60.0)


@q(oracle="WITH m AS (SELECT *, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS m, (o_orderkey % 10) / 10 AS u FROM orders) SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, count(*) FILTER (WHERE u < 0.3 AND o_totalprice > 0.5 * m) AS waste_hours, sum(o_totalprice) > 1e8 AS over_budget FROM m GROUP BY 1")
def spend_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("u", F.col("o_orderkey") % 10 / 10)
    return S.spend(o, "o_orderpriority", "o_totalprice", "u", 1e8).withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


@q(oracle="SELECT user_id, avg(CASE WHEN value / 100 < 0.05 THEN 1.0 ELSE 0 END) > 0.2 AS idle, max(value / 100) > 2 * avg(value / 100) AS overprovisioned FROM events GROUP BY 1")
def waste_report(spark, sf_dir):
    return S.waste(table(spark, sf_dir, "events").withColumn("u", F.col("value") / 100), "user_id", "u")


@q(oracle="WITH r AS (SELECT o_custkey // 100 AS k0, o_totalprice, row_number() OVER (PARTITION BY o_custkey // 100 ORDER BY o_orderkey DESC) AS r FROM orders) SELECT k0, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS deviation FROM r WHERE r <= 20 GROUP BY 1 HAVING count(*) >= 3")
def bucket_predictor(spark, sf_dir):
    got = S.bucket_means(table(spark, sf_dir, "orders"), [F.floor(F.col("o_custkey") / 100)], ["o_orderkey"], "o_totalprice")
    return got.withColumns({"mean": F.round("mean", 4), "deviation": F.round("deviation", 4)})


@q(oracle="SELECT bound, count(*) FILTER (WHERE value <= bound) AS \"rows\" FROM events, (SELECT unnest([1.0, 10.0, 25.0, 50.0, 100.0]::DOUBLE[]) AS bound) GROUP BY 1")
def histogram_buckets(spark, sf_dir):
    return S.histogram(table(spark, sf_dir, "events"), "value", [1, 10, 25, 50, 100])


@q(oracle="WITH s AS (" + _POS.format(e="value", t="events") + ") SELECT max(CASE WHEN i = CAST(floor(0.5 * n) AS BIGINT) THEN v END) AS p50, max(CASE WHEN i = CAST(floor(0.9 * n) AS BIGINT) THEN v END) AS p90 FROM s")
def quantile_positional(spark, sf_dir):
    return Q.positional(table(spark, sf_dir, "events"), ["value"], {"p50": 0.5, "p90": 0.9}).select("p50", "p90")


@q(oracle="WITH x AS (SELECT label, vec_id % 5 + 1 AS w, unnest(embedding) AS x, unnest(range(len(embedding))) AS position FROM embeddings) SELECT label, CAST(position AS INT) AS position, round(sum(w * CAST(x AS DOUBLE)) / sum(w), 6) AS value FROM x GROUP BY 1, 2")
def federated_average(spark, sf_dir):
    return S.weighted_vectors(table(spark, sf_dir, "embeddings"), "embedding", F.col("vec_id") % 5 + 1, "label").withColumn("value", F.round("value", 6))


@q(oracle="SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * least(1.0, 0.5 / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 6) AS norm FROM embeddings")
def clip_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", S.clip_l2("embedding", 0.5).alias("v"))
    return v.select("vec_id", F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


@q(oracle="SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3")
def audit_last_events(spark, sf_dir):
    return S.last_of_each(table(spark, sf_dir, "events"), "user_id", 3, ["ts", "event_id"]).select("user_id", "event_id")


@q()
def transfer_schedule(spark, sf_dir):
    ship(spark)
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("link"), "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("p"), "o_totalprice")
    return S.greedy_schedule(o, "link", "p", "o_totalprice", 2e6)


# placement and storage ------------------------------------------------------------------------------------------------
@q(oracle="SELECT ('0x' || substring(md5(CAST(o_custkey AS VARCHAR)), 1, 15))::BIGINT % 8 AS part, count(*) AS n FROM orders GROUP BY 1")
def part_hash_sizes(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(P.md5_bucket(F.col("o_custkey"), 8).alias("part")).agg(F.count("*").alias("n"))


@q(oracle="SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS slice FROM orders")
def part_slices(spark, sf_dir):
    return P.slices(table(spark, sf_dir, "orders"), 4, "o_orderstatus", "o_totalprice", "o_orderkey").select("o_orderkey", "slice")


@q(oracle="SELECT CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 11 ELSE CAST(floor(value / 10) AS BIGINT) + 1 END AS bucket, count(*) AS n FROM events GROUP BY 1")
def part_score_buckets(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(P.score_bucket(F.col("value"), 0.0, 100.0, 10).alias("bucket")).agg(F.count("*").alias("n"))


@q(oracle="WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, n AS \"rows\" FROM c WHERE n > 1.8 * (SELECT avg(n) FROM c)")
def part_skewed_keys(spark, sf_dir):
    return P.skewed_keys(table(spark, sf_dir, "orders"), "o_custkey", 1.8).select("o_custkey", "rows")


@q(oracle="SELECT o_orderstatus, sum(o_custkey) AS sum_o_custkey FROM orders GROUP BY 1")
def part_salted_sum(spark, sf_dir):
    return P.salted_sum(table(spark, sf_dir, "orders"), "o_orderstatus", "o_custkey")


@q(oracle="SELECT o_orderkey, o_totalprice, 0 AS version FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN o_totalprice + 5 ELSE o_totalprice END, 9 FROM orders WHERE o_orderstatus <> 'P'")
def table_time_travel(spark, sf_dir):
    """Write, append, update, delete, rename a column, compact; then the first data and the last."""
    from loomwork.sources.versioned import VersionedTable

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    t = VersionedTable(spark, _folder(spark, "table"))
    t.write(o.where("o_orderstatus = 'F'"))
    t.write(o.where("o_orderstatus <> 'F'"))
    t.update(F.col("o_custkey") % 2 == 0, {"o_totalprice": F.col("o_totalprice") + 5})
    t.delete(F.col("o_orderstatus") == "P")
    t.evolve(rename={"o_totalprice": "price"})
    t.optimize()
    return t.read(version=1).select("o_orderkey", "o_totalprice", F.lit(0).alias("version")).unionByName(t.read().select("o_orderkey", F.col("price").alias("o_totalprice"), F.lit(9).alias("version")))


@q(oracle="SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def table_merge(spark, sf_dir):
    """Finished orders change, open ones stay, pending ones are new."""
    from loomwork.sources.versioned import VersionedTable

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    t = VersionedTable(spark, _folder(spark, "table"))
    t.write(o.where("o_orderstatus <> 'P'"))
    t.merge(o.where("o_orderstatus <> 'O'").withColumn("o_totalprice", F.col("o_totalprice") * 2), "o_orderkey")
    return t.read()


@q(oracle="WITH RECURSIVE e AS (SELECT n_nationkey AS src, n_nationkey // 2 AS dst FROM nation WHERE n_nationkey > 0), r AS (SELECT dst AS node, 1 AS depth FROM e WHERE src = 24 UNION ALL SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.node) SELECT node, min(depth) AS depth FROM r GROUP BY 1")
def lineage_upstream(spark, sf_dir):
    from loomwork.sources.catalog import upstream

    edges = table(spark, sf_dir, "nation").where("n_nationkey > 0").select(F.col("n_nationkey").alias("src"), F.floor(F.col("n_nationkey") / 2).cast("int").alias("dst"))
    return upstream(edges, 24)


@q(oracle="SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}')) AS emails, len(regexp_extract_all(text, '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}')) AS ips FROM documents")
def pii_value_scan(spark, sf_dir):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", n("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}").alias("emails"), n("[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}").alias("ips"))


@q(oracle="SELECT c_custkey, round(coalesce(sum(o_totalprice), 0), 2) AS spend, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def feature_vectors(spark, sf_dir):
    from loomwork.operators.features import FeatureStore

    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    store = FeatureStore()
    store.register("spend", o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("spend")), "c_custkey", default=0.0)
    store.register("n_orders", o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders")), "c_custkey", default=0)
    store.group("shopping", ["spend", "n_orders"])
    return store.vectors(c.select("c_custkey"), "shopping")


@q(oracle="SELECT count(*) AS n, count(DISTINCT id) AS ids, count(*) FILTER (WHERE kind NOT IN ('a', 'b')) AS bad FROM (SELECT o_orderkey AS id, 'a' AS kind FROM orders LIMIT 1000)")
def generated_rows(spark, sf_dir):
    from loomwork.sources.io import generate

    g = generate(spark, 1000, {"id": "uuid", "kind": "enum:a,b", "v": "float"}, seed=3)
    return g.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count_if(~F.col("kind").isin("a", "b")).alias("bad"))


@q(oracle="SELECT p_partkey, p_name, p_size FROM part")
def csv_json_round_trip(spark, sf_dir):
    from loomwork.sources import io

    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    f = _folder(spark, "files")
    io.write_csv(p, f"{f}/csv")
    back = io.read_csv(spark, f"{f}/csv").select(F.col("p_partkey").cast("long"), "p_name", F.col("p_size").cast("int"))
    io.write_jsonl(back, f"{f}/json")
    return io.read_jsonl(spark, f"{f}/json", "p_partkey long, p_name string, p_size int")[0]


@q(oracle="""WITH p AS (SELECT event_type, CAST(ts AS DATE) AS d, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2, 3), m AS (SELECT event_type, h, avg(n) AS m FROM p GROUP BY 1, 2), c AS (SELECT event_type, sqrt((sum(m * m) - 24 * (sum(m) / 24) * (sum(m) / 24)) / 23) / (sum(m) / 24) AS cv FROM m GROUP BY 1),
r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events), t AS (SELECT event_type, n, (avg(CASE WHEN r > n - n // 4 THEN value END) - avg(CASE WHEN r <= n // 4 THEN value END)) / avg(CASE WHEN r <= n // 4 THEN value END) AS trend, avg(CASE WHEN r > n - 60 THEN value END) AS recent FROM r GROUP BY 1, 2),
k AS (SELECT *, CASE WHEN n < 1440 THEN 'unknown' WHEN cv > 0.3 THEN 'periodic' WHEN abs(trend) > 0.1 THEN 'trending' ELSE 'stable' END AS pattern FROM t JOIN c USING (event_type)) SELECT event_type, pattern, round(recent * CASE WHEN pattern = 'trending' THEN 1 + trend / 24 ELSE 1 END, 6) AS forecast FROM k""")
def ts_load_pattern(spark, sf_dir):
    return S.load_pattern(table(spark, sf_dir, "events"), "ts", "event_type", ["ts", "event_id"], "value").withColumn("forecast", F.round("forecast", 6))


@q(oracle="WITH p AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, arg_max(event_type, (n, event_type)) AS place, CAST(sum(n) AS BIGINT) AS reads, CASE WHEN max(n) > 0.4 * sum(n) THEN 'move' ELSE 'replicate' END AS advice FROM p GROUP BY 1")
def part_placement_advice(spark, sf_dir):
    return P.placement(table(spark, sf_dir, "events"), "user_id", "event_type", 0.4)


@q(oracle="SELECT c_custkey, (c_mktsegment = 'BUILDING' AND c_nationkey IN (1, 2, 3)) OR (c_mktsegment = 'MACHINERY' AND c_nationkey IN (4)) AS compliant FROM customer")
def data_residency(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("n", F.col("c_nationkey").cast("string"))
    return I.residency(c, "n", {"BUILDING": ["1", "2", "3"], "MACHINERY": ["4"]}, "c_mktsegment").select("c_custkey", "compliant")


@q(oracle="SELECT event_type, count(*) AS n FROM events WHERE user_id = 7 GROUP BY 1")
def audit_search(spark, sf_dir):
    return I.audit(table(spark, sf_dir, "events"), user_id=7, event_type=None).groupBy("event_type").agg(F.count("*").alias("n"))
