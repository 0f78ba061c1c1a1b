"""Projections, filters, joins, aggregates, windows, ordering, sets and functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions import compat
from loomwork.operators import relational as R
from loomwork.operators.aggregates import Aggregators
from loomwork.plans.catalogue import registry
from loomwork.plans.sql import SqlContext
from loomwork.session import table

q = registry.query


def both(name: str, text: str, tables: str, oracle: str | None = None) -> None:
    """One SQL text for this engine and, unless it has its own, for the oracle."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return SqlContext.over(spark, sf_dir, tables.split()).sql(text)

    registry.add(name, run, oracle or text)


# flagship ---------------------------------------------------------------------------------------------------------------
@q(oracle="""
SELECT r_name, strftime(o_orderdate, '%Y-%m') AS month, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1, 2""")
def revenue_by_region_month(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    orders = t("orders").where("o_orderdate >= TIMESTAMP_NTZ'1995-01-01'").select("o_orderkey", "o_custkey", "o_orderdate")
    df = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    df = df.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return df.groupBy("r_name", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n_lines"))


# scans and projections ----------------------------------------------------------------------------------------------------
@q(oracle="SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 45")
def scan_pushdown(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select("l_orderkey", "l_quantity")


@q(oracle="SELECT o_orderkey AS id, o_totalprice * 2 AS doubled, 'x' AS tag FROM orders")
def project_alias(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") * 2).alias("doubled"), F.lit("x").alias("tag"))


@q(oracle="SELECT p_partkey, p_name, p_size, p_retailprice - 1 AS net, p_size + 1 AS bigger FROM part")
def with_column_and_drop(spark, sf_dir):
    return table(spark, sf_dir, "part").withColumn("net", F.col("p_retailprice") - 1).withColumn("bigger", F.col("p_size") + 1).drop("p_brand", "p_type", "p_retailprice")


@q(oracle="SELECT c_custkey AS key, c_name FROM customer WHERE c_acctbal > 9000")
def rename_and_select_expr(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_acctbal > 9000").withColumnRenamed("c_custkey", "key").selectExpr("key", "c_name")


# filters --------------------------------------------------------------------------------------------------------------
for name, cond in {
    "filter_compare": "o_totalprice > 100000 AND o_totalprice <= 200000 AND o_orderkey != 7",
    "filter_and_or_not": "(o_orderstatus = 'F' OR o_orderstatus = 'P') AND NOT o_orderpriority = '1-URGENT'",
    "filter_between": "o_totalprice BETWEEN 1000 AND 50000",
    "filter_in": "o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "filter_not_in": "o_orderstatus NOT IN ('F', 'O')",
    "filter_like": "o_orderpriority LIKE '%-H_GH'",
    "filter_not_like": "o_orderpriority NOT LIKE '4%'",
    "filter_modulo": "o_orderkey % 7 = 3",
}.items():
    both(name, f"SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE {cond}", "orders")


@q(oracle="SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%'")
def filter_ilike(spark, sf_dir):
    return table(spark, sf_dir, "part").where(compat.matches_pattern(F.col("p_name"), "%RED%")).select("p_partkey", "p_name")


@q(oracle="SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') OR starts_with(p_name, 'blue') OR ends_with(p_name, 'gear')")
def filter_text_methods(spark, sf_dir):
    n = F.col("p_name")
    return table(spark, sf_dir, "part").where(n.contains("ring") | n.startswith("blue") | n.endswith("gear")).select("p_partkey", "p_name")


@q(oracle="SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders WHERE CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END IS NULL OR o_totalprice < 2000")
def filter_nulls(spark, sf_dir):
    price = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", price.alias("price")).where(F.col("price").isNull() | (F.col("price") < 2000))


@q(oracle="SELECT event_id, event_type, value FROM events WHERE event_type = 'click' AND value > 50 AND event_type IN ('click', 'view') AND regexp_matches(props, '^.*9.*$')")
def filter_named_conditions(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    for c in (("event_type", "eq", "click"), ("value", "gt", 50), ("event_type", "in", ["click", "view"]), ("props", "regex", ".*9.*")):
        df = df.where(compat.condition(*c))
    return df.select("event_id", "event_type", "value")


@q(oracle="SELECT o_orderkey, o_totalprice / nullif(o_orderkey % 5, 0) AS ratio FROM orders")
def divide_by_zero_is_null(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", compat.divide(F.col("o_totalprice"), F.col("o_orderkey") % 5).alias("ratio"))


# expressions ----------------------------------------------------------------------------------------------------------
both("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN upper('medium') ELSE 'small' END AS size FROM orders", "orders")
both("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code FROM orders", "orders")
both("cast_permissive", "SELECT o_orderkey, try_cast(substring(o_orderpriority, 1, 1) AS BIGINT) AS level, try_cast(o_orderpriority AS BIGINT) AS nothing FROM orders", "orders")
both("literals_without_from", "SELECT 1 AS one, -2.5e1 AS minus, 'it' AS word, TRUE AS yes, CAST(NULL AS INT) AS nothing -- a comment", "region", "SELECT 1 AS one, CAST(-2.5e1 AS DOUBLE) AS minus, 'it' AS word, TRUE AS yes, CAST(NULL AS INT) AS nothing")
both("arithmetic_precedence", "SELECT l_orderkey, l_linenumber, -l_quantity + 2 * (l_tax - 1) / 4 AS v FROM lineitem WHERE NOT l_quantity = 1 AND l_tax > 0.02 OR l_discount = 0.1", "lineitem")

# subqueries -----------------------------------------------------------------------------------------------------------
both("subquery_in", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", "customer orders")
both("subquery_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)", "customer orders")
both("subquery_exists", "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_name = 'ASIA')", "nation region")
both("subquery_correlated_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)", "customer orders")
both("subquery_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", "customer orders")
both("subquery_scalar", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT 1.9 * avg(o_totalprice) FROM orders)", "orders")
both("subquery_scalar_correlated", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS most FROM customer", "customer orders")
both("derived_table", "SELECT status, n FROM (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus) x WHERE n > 10", "orders")
both("cte_chain", "WITH big(k, c) AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 250000), per AS (SELECT c, count(*) AS n FROM big GROUP BY c) SELECT c_name, n FROM per JOIN customer ON c = c_custkey WHERE n > 1", "orders customer")

# joins ----------------------------------------------------------------------------------------------------------------
both("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'", "orders customer")
both("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000", "orders customer")
both("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT OUTER JOIN customer ON c_custkey = o_custkey", "orders customer")
both("join_full", "SELECT s_suppkey, c_custkey FROM supplier FULL OUTER JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey", "supplier customer")
both("join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region", "nation region")
both("join_several_conditions", "SELECT o_orderkey, l_linenumber FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_shipdate > o.o_orderdate AND l.l_quantity > 40", "orders lineitem")
both("join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "nation")
both("join_waggle", "SELECT o_orderkey, c_name FROM orders WAGGLE JOIN customer ON o_custkey = c_custkey SWARM PARTITION BY o_orderkey SCOUT HINT", "orders customer", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")


def _two(spark, sf_dir):
    """Customers and suppliers by their numbers under one name; every third is null."""
    key = lambda c: F.when(F.col(c) % 3 != 0, F.col(c)).alias("k")
    c = table(spark, sf_dir, "customer").select(key("c_custkey"), "c_custkey", F.lit("left").alias("side"))
    s = table(spark, sf_dir, "supplier").select(key("s_suppkey"), "s_suppkey", F.lit("right").alias("side"))
    return c, s


_TWO = "WITH c AS (SELECT CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS k, c_custkey, 'left' AS side FROM customer), s AS (SELECT CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey END AS k, s_suppkey FROM supplier) "
for how, sql in {
    "inner": "SELECT k, c_custkey, side, s_suppkey FROM c JOIN s USING (k)", "left": "SELECT k, c_custkey, side, s_suppkey FROM c LEFT JOIN s USING (k)", "right": "SELECT k, c_custkey, side, s_suppkey FROM c RIGHT JOIN s USING (k)",
    "outer": "SELECT k, c_custkey, side, s_suppkey FROM c FULL JOIN s USING (k)", "semi": "SELECT k, c_custkey, side FROM c SEMI JOIN s USING (k)", "anti": "SELECT k, c_custkey, side FROM c ANTI JOIN s USING (k)",
}.items():
    registry.add(f"join_using_{how}", lambda spark, sf_dir, how=how: R.join(*_two(spark, sf_dir), "k", how), _TWO + sql)
registry.add("join_null_safe", lambda spark, sf_dir: R.join(*_two(spark, sf_dir), "k", "inner", null_safe=True), _TWO + "SELECT c.k, c_custkey, side, s_suppkey FROM c JOIN s ON c.k IS NOT DISTINCT FROM s.k")
registry.add("join_null_safe_outer", lambda spark, sf_dir: R.join(*_two(spark, sf_dir), "k", "outer", null_safe=True), _TWO + "SELECT coalesce(c.k, s.k) AS k, c_custkey, side, s_suppkey FROM c FULL JOIN s ON c.k IS NOT DISTINCT FROM s.k")


@q(oracle="SELECT n_nationkey AS left_n_nationkey, n_name AS left_n_name, n_regionkey AS left_n_regionkey, r_regionkey AS right_r_regionkey, r_name AS right_r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def join_prefixed(spark, sf_dir):
    return R.prefixed_join(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").where("r_name <> 'ASIA'"), "n_regionkey", "r_regionkey", "left")


@q(oracle="SELECT p_partkey, low, high FROM part JOIN (SELECT p_partkey * 10.0 + 900 AS low, p_partkey * 10.0 + 915 AS high FROM part) r ON p_retailprice >= low AND p_retailprice < high")
def join_range(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    r = p.select((F.col("p_partkey") * 10.0 + 900).alias("low"), (F.col("p_partkey") * 10.0 + 915).alias("high"))
    return R.range_join(p.select("p_partkey", "p_retailprice"), r, "p_retailprice", "low", "high", 15).select("p_partkey", F.col("low").cast("double"), F.col("high").cast("double"))


@q(oracle="WITH p AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'view') SELECT p.user_id, p.ts, p.value, v.event_id AS asof_event_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts")
def join_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return R.asof_join(e.where("event_type = 'purchase'").select("user_id", "ts", "value"), e.where("event_type = 'view'").select("user_id", "ts", "event_id"), "user_id", "ts", ["event_id"])


# aggregates -----------------------------------------------------------------------------------------------------------
both("agg_global", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders", "orders")
both("agg_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_quantity < 49 GROUP BY l_returnflag, l_linestatus", "lineitem")
both("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag", "lineitem")
both("agg_group_by_expression", "SELECT o_custkey % 10 AS bucket, count(*) AS n, round(sum(o_totalprice + 1), 2) AS s FROM orders GROUP BY o_custkey % 10", "orders")
both("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 100000", "orders")
both("agg_expression_over_aggregates", "SELECT o_orderstatus, round(sum(o_totalprice) / count(*), 4) AS mean, count(*) * 2 AS twice FROM orders GROUP BY o_orderstatus", "orders")
both("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "lineitem")
both("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "orders")
both("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", "orders")
both("agg_conditional", "SELECT l_shipmode_like AS flag, count(*) FILTER (WHERE l_quantity > 25) AS large, count(*) AS n FROM (SELECT l_returnflag AS l_shipmode_like, l_quantity FROM lineitem) x GROUP BY 1", "lineitem")
both("agg_statistics", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c FROM lineitem GROUP BY l_returnflag", "lineitem")


@q(oracle="SELECT o_custkey % 3 AS g, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 1 END AS nullable, count(CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END) AS n, coalesce(sum(CASE WHEN o_orderkey < 0 THEN o_totalprice END), 0.0) AS nothing FROM orders GROUP BY 1, 2")
def agg_null_groups(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumns({"g": F.col("o_custkey") % 3, "nullable": F.when(F.col("o_custkey") % 3 != 0, 1)})
    return o.groupBy("g", "nullable").agg(F.count(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice"))).alias("n"), compat.sum0(F.when(F.col("o_orderkey") < 0, F.col("o_totalprice"))).alias("nothing"))


@q(oracle="SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS kinds, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1")
def agg_registry(spark, sf_dir):
    a = Aggregators()
    a.register("sum2", lambda c: F.round(F.sum(c), 2))
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.array_join(a.create("collect_set", "o_orderpriority"), ",").alias("kinds"), a.create("count", "o_orderkey", "n"), a.create("sum2", "o_totalprice", "s"))


@q(oracle="SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def agg_collect_list(spark, sf_dir):
    return R.group_by_key(table(spark, sf_dir, "nation"), "n_regionkey", "n_name").select("n_regionkey", F.array_join("values", ",").alias("names"))


@q(oracle="SELECT 'c_acctbal' AS \"column\", count(c_acctbal) AS \"count\", round(avg(c_acctbal), 6) AS mean, round(stddev_pop(c_acctbal), 6) AS std, min(c_acctbal) AS min, max(c_acctbal) AS max FROM customer UNION ALL SELECT 'c_custkey', count(c_custkey), round(avg(c_custkey), 6), round(stddev_pop(c_custkey), 6), CAST(min(c_custkey) AS DOUBLE), CAST(max(c_custkey) AS DOUBLE) FROM customer")
def describe_numeric(spark, sf_dir):
    return R.describe(table(spark, sf_dir, "customer"), ["c_acctbal", "c_custkey"]).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@q(oracle="SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS F, sum(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS O, sum(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS P FROM orders GROUP BY 1")
def agg_pivot(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()


@q(oracle="SELECT 'l_tax' AS k, round(sum(l_tax), 4) AS v FROM lineitem UNION ALL SELECT 'l_discount', round(sum(l_discount), 4) FROM lineitem")
def unpivot_sums(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.sum("l_tax").alias("l_tax"), F.sum("l_discount").alias("l_discount")).unpivot([], ["l_tax", "l_discount"], "k", "v").select("k", F.round("v", 4).alias("v"))


@q(oracle="SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS median FROM lineitem GROUP BY 1")
def agg_percentile(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity)").alias("median"))


@q(oracle="SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def agg_group_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").count().withColumnRenamed("count", "n")


# windows --------------------------------------------------------------------------------------------------------------
_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
for name, expr in {
    "win_row_number": f"row_number() OVER ({_W})", "win_rank": "rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)", "win_dense_rank": "dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)",
    "win_lag": f"lag(o_orderkey, 1) OVER ({_W})", "win_lead": f"lead(o_orderkey, 2, -1) OVER ({_W})", "win_first_value": f"first_value(o_orderkey) OVER ({_W})",
    "win_last_value": f"last_value(o_orderkey) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", "win_running_sum": f"round(sum(o_totalprice) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2)",
    "win_moving_average": f"round(avg(o_totalprice) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4)", "win_range_frame": "count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW)",
    "win_ntile": f"ntile(4) OVER ({_W})", "win_percent_rank": f"round(percent_rank() OVER ({_W}), 6)", "win_count_partition": "count(*) OVER (PARTITION BY o_custkey)",
}.items():
    both(name, f"SELECT o_orderkey, {expr} AS v FROM orders", "orders")


@q(oracle="SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2")
def win_top_of_each(spark, sf_dir):
    return R.top_k_of_each(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], 2, F.desc("o_totalprice"), "o_orderkey").drop("o_totalprice")


# order, limit, distinct ---------------------------------------------------------------------------------------------------
both("sort_multi_key", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus DESC, o_totalprice ASC, o_orderkey LIMIT 50", "orders")
both("sort_hidden_column_nulls", "SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END DESC NULLS LAST, o_orderkey LIMIT 40", "orders")
both("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 35", "orders")
both("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "orders")


@q(oracle="SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark, sf_dir):
    return R.top_k(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), "o_orderkey")


@q(oracle="SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 14990")
def offset_without_limit(spark, sf_dir):
    return R.skip(table(spark, sf_dir, "orders").select("o_orderkey"), 14990, "o_orderkey")


@q(oracle="SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()


@q(oracle="SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n = 1")
def drop_duplicates_first(spark, sf_dir):
    return R.drop_duplicates_first(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["event_id"]).select("event_id", "user_id", "event_type")


# sets -----------------------------------------------------------------------------------------------------------------
_A, _B = "SELECT c_nationkey AS k FROM customer WHERE c_custkey < 40", "SELECT s_nationkey AS k FROM supplier WHERE s_suppkey < 60"
for name, op in {"set_union": "UNION", "set_union_all": "UNION ALL", "set_intersect": "INTERSECT", "set_intersect_all": "INTERSECT ALL", "set_except": "EXCEPT", "set_except_all": "EXCEPT ALL"}.items():
    both(name, f"{_A} {op} {_B}", "customer supplier")
both("set_chain", f"({_A} UNION {_B}) EXCEPT SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1", "customer supplier nation")


@q(oracle="SELECT c_custkey AS id, c_name AS name, NULL::BIGINT AS s FROM customer UNION ALL SELECT s_suppkey, NULL, s_nationkey FROM supplier")
def union_by_name(spark, sf_dir):
    return R.union_by_name(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("s"), F.col("s_suppkey").alias("id")))


# functions ------------------------------------------------------------------------------------------------------------
both("fn_string", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, trim(concat('  ', p_name, ' ')) AS t, length(p_name) AS n, substring(p_name, 2, 3) AS s, replace(p_brand, '#', '-') AS r, concat(p_name, '/', p_type) AS c, reverse(p_name) AS v, lpad(p_name, 12, '*') AS p FROM part", "part")
both("fn_math", "SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS a, round(l_extendedprice, 1) AS r, floor(l_tax * 100) AS f, ceil(l_extendedprice) AS c, round(sqrt(l_quantity), 9) AS s, round(power(l_tax, 2), 9) AS p, l_orderkey % 7 AS m, sign(l_tax) AS g FROM lineitem", "lineitem", "SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS a, round(l_extendedprice, 1) AS r, CAST(floor(l_tax * 100) AS BIGINT) AS f, CAST(ceil(l_extendedprice) AS BIGINT) AS c, round(sqrt(l_quantity), 9) AS s, round(power(l_tax, 2), 9) AS p, l_orderkey % 7 AS m, CAST(sign(l_tax) AS DOUBLE) AS g FROM lineitem")
both("fn_date", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, extract(HOUR FROM o_orderdate) AS h, date_trunc('MONTH', o_orderdate) AS t, date_add(CAST(o_orderdate AS DATE), 10) AS plus, date_sub(CAST(o_orderdate AS DATE), 3) AS minus, datediff(CAST(o_orderdate AS DATE), DATE'1995-01-01') AS days FROM orders", "orders", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, extract(HOUR FROM o_orderdate) AS h, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS t, CAST(o_orderdate AS DATE) + 10 AS plus, CAST(o_orderdate AS DATE) - 3 AS minus, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders")
both("fn_extract", "SELECT event_id, extract(YEAR FROM ts) AS y, extract(MONTH FROM ts) AS mo, extract(DAY FROM ts) AS d, extract(HOUR FROM ts) AS h, extract(MINUTE FROM ts) AS mi, second(ts) AS s FROM events", "events")
both("fn_coalesce_nullif", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), nullif(o_orderpriority, '5-LOW'), 'none') AS v, nullif(o_custkey, 5) AS n FROM orders", "orders")
both("fn_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
both("fn_if_split", "SELECT p_partkey, if(p_size > 25, 'big', 'small') AS s, split(p_name, ' ')[0] AS head FROM part", "part", "SELECT p_partkey, if(p_size > 25, 'big', 'small') AS s, split_part(p_name, ' ', 1) AS head FROM part")


@q(oracle="SELECT p_partkey, substring(p_name, 3, 4) AS s0, p_name || '' || p_brand AS c, round_even(p_retailprice, 1) AS r, length(CAST(p_size AS VARCHAR)) AS n, trim(p_name) AS t FROM part")
def fn_compat(spark, sf_dir):
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", compat.substr0(n, 2, 4).alias("s0"), compat.concat_lenient(n, F.lit(None), F.col("p_brand")).alias("c"), compat.half_even(F.col("p_retailprice"), 1).alias("r"), compat.length_of(F.col("p_size")).alias("n"), compat.strip(F.concat(F.lit("\t "), n, F.lit("\n"))).alias("t"))


@q(oracle="SELECT o_orderkey, CAST(floor(epoch(o_orderdate - TIMESTAMP '1996-03-01 12:00:00') / 86400) AS BIGINT) AS days FROM orders")
def fn_days_between(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", compat.days_between(F.col("o_orderdate"), F.expr("TIMESTAMP'1996-03-01 12:00:00'")).alias("days"))


@q(oracle="SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 5) AS sq, round(list_max(embedding), 6) AS most FROM embeddings")
def fn_array(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(e).cast("long").alias("n"), F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 5).alias("sq"), F.round(F.array_max(e), 6).alias("most"))


@q(oracle="SELECT doc_id, count(*) AS words, count(DISTINCT word) AS kinds FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \\t\\n\\r]+')) AS word FROM documents) AS w GROUP BY doc_id")
def udtf_explode(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"[ \t\n\r]+")).alias("word"))
    return words.groupBy("doc_id").agg(F.count("*").alias("words"), F.count_distinct("word").alias("kinds"))


@q(oracle="SELECT o_orderkey, o_totalprice * 1.1 AS v FROM orders")
def udf_pandas(spark, sf_dir):
    """A vectorised scalar function of the caller's own."""
    from loomwork.session import ship

    ship(spark)
    f = F.pandas_udf(lambda s: s * 1.1, "double")
    return table(spark, sf_dir, "orders").select("o_orderkey", f("o_totalprice").alias("v"))


@q(oracle="SELECT o_orderstatus, round(sum(o_totalprice * o_totalprice), 0) AS v FROM orders GROUP BY 1")
def udaf_fold(spark, sf_dir):
    from loomwork.operators.aggregates import fold
    from loomwork.session import ship

    ship(spark)
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.round(fold(0.0, lambda a, x: a + x * x)("o_totalprice"), 0).alias("v"))


@q(oracle="SELECT p_partkey, n FROM part, (SELECT unnest([1, 2]) AS n) WHERE p_size >= n * 20")
def udtf_flat_map(spark, sf_dir):
    from loomwork.session import ship

    ship(spark)
    return R.flat_map(table(spark, sf_dir, "part").select("p_partkey", "p_size"), lambda r: [{"p_partkey": r["p_partkey"], "n": n} for n in (1, 2) if r["p_size"] >= 20 * n], "p_partkey long, n int")


@q(oracle="SELECT o_orderkey, o_custkey * 3 + 1 AS v FROM orders")
def udf_sql(spark, sf_dir):
    ctx = SqlContext.over(spark, sf_dir, ["orders"])
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION triple(x BIGINT) RETURNS BIGINT RETURN x * 3 + 1")
    return ctx.sql("SELECT o_orderkey, triple(o_custkey) AS v FROM orders")


@q(oracle="SELECT sum(o_orderkey) AS o_orderkey FROM orders")
def reduce_tree(spark, sf_dir):
    from loomwork.operators.aggregates import reduce_column

    return reduce_column(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long")), "o_orderkey", lambda a, x: a + x, F.lit(0).cast("long"))


_ = Window
