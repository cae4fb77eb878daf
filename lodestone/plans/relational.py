"""The relational surface of the query verb over the given tables, each with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import dialect as D
from lodestone.operators.graph import transitive_closure
from lodestone.sources.tables import table

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()

#: Statements that both engines take as they are.
SHARED = {
    "project_expressions": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue, l_quantity > 25 AS large FROM lineitem",
    "filter_three_valued": "SELECT o_orderkey, o_orderstatus FROM orders WHERE (o_orderstatus IN ('O', 'F') AND NOT o_totalprice < 100000) OR (o_orderpriority NOT IN ('1-URGENT', '5-LOW') AND o_custkey <= 200)",
    "null_tests": "SELECT d.doc_id, l.toxic IS NULL AS unlabelled, l.quality IS NOT NULL AS rated FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "join_inner": "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 200000",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000",
    "join_right": "SELECT d.doc_id, l.doc_id AS label_id, l.toxic FROM documents d RIGHT JOIN labels l ON d.doc_id = l.doc_id AND d.lang = 'en'",
    "join_full": "SELECT d.doc_id AS left_id, l.doc_id AS right_id FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id AND d.lang = 'en'",
    "join_cross": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
    "join_theta": "SELECT a.n_name AS first, b.n_name AS second FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_using": "SELECT doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)",
    "join_natural": "SELECT doc_id, lang, toxic FROM (SELECT doc_id, lang FROM documents) a NATURAL JOIN (SELECT doc_id, toxic FROM labels) b",
    "join_semi": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)",
    "join_semi_in": "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)",
    "join_anti": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "anti_not_in": "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount = 0 AND l_tax = 0 AND l_suppkey IS NOT NULL)",
    "scalar_subquery": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)",
    "scalar_subquery_correlated": "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer",
    "agg_grouped": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_shipdate) AS first_ship, max(l_discount) AS max_discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "agg_global": "SELECT count(*) AS n, count(toxic) AS n_toxic, min(doc_id) AS lo, max(doc_id) AS hi FROM labels",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag",
    "distinct_rows": "SELECT DISTINCT lang, source FROM documents",
    "agg_having": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 590 AND min(l_quantity) < 2",
    "agg_filter": "SELECT event_type, count(*) FILTER (WHERE value > 50) AS large, count(*) AS n FROM events GROUP BY event_type",
    "agg_total": "SELECT n.n_name, coalesce(round(sum(s_acctbal), 2), 0.0) AS balance FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name",
    "win_ranking": "SELECT c_custkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS rk, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS dr FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)",
    "win_distribution": "SELECT c_custkey, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, ntile(4) OVER w AS quarter FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)",
    "win_lag_lead": "SELECT conv_id, turn, lag(role) OVER w AS before, lead(role, 1, 'none') OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "win_values": "SELECT conv_id, turn, first_value(length(text)) OVER w AS first_len, last_value(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_len, nth_value(length(text), 2) OVER w AS second_len FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "win_rows_frame": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS near_sum FROM events",
    "win_range_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near_sizes FROM part",
    "cte_plain": "WITH big AS (SELECT l_orderkey, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY l_orderkey), top AS (SELECT * FROM big WHERE qty > 150) SELECT o.o_orderkey, top.qty FROM top JOIN orders o ON o.o_orderkey = top.l_orderkey",
    "setop_union": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "setop_union_all": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "setop_intersect": "SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels",
    "setop_except": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE toxic = 0",
    "order_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "limit_offset_page": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus, o_orderkey LIMIT 50 OFFSET 100",
    "order_nulls": "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality ASC NULLS FIRST, d.doc_id LIMIT 40",
    "is_distinct_from": "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS DISTINCT FROM 0",
    "derived_values": "SELECT n.n_name, v.tag FROM (VALUES (1, 'one'), (2, 'two'), (3, 'three')) AS v(k, tag) JOIN nation n ON n.n_nationkey = v.k",
    "cond_funcs": "SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'other' END AS kind, coalesce(nullif(quality, 0), -1) AS q, ifnull(toxic, 9) AS t FROM labels",
    "search_substring": "SELECT count(*) AS n FROM documents WHERE text LIKE '%Apache License%'",
    "symbol_join": "SELECT count(*) AS n FROM conversations c JOIN conversations d ON c.conv_id = d.conv_id AND d.turn = c.turn + 1 WHERE c.role = 'user' AND d.role = 'assistant'",
    "join_sorted_listing": "SELECT r.r_name, n.n_name, s.s_name FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal < 0",
    "max_timestamp": "SELECT max(ts) AS last_ts, min(ts) AS first_ts FROM events",
}

#: Statements whose spelling differs: Spark's, then DuckDB's.
SPELLED = {
    "cte_recursive": (
        "WITH RECURSIVE n(level, x, hi) MAX RECURSION LEVEL 64 AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT), max(o_custkey) FROM orders UNION ALL SELECT level + 1, x * 2, hi FROM n WHERE x * 2 <= hi), o AS (SELECT length(bin(o_custkey)) AS level, count(*) AS orders, sum(o_custkey) AS keys FROM orders GROUP BY 1) SELECT n.level, n.x, coalesce(o.orders, 0) AS orders, CAST(coalesce(o.keys, 0) AS BIGINT) AS keys FROM n LEFT JOIN o ON o.level = n.level",
        "WITH RECURSIVE n(level, x, hi) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT), max(o_custkey) FROM orders UNION ALL SELECT level + 1, x * 2, hi FROM n WHERE x * 2 <= hi), o AS (SELECT length(bin(o_custkey)) AS level, count(*) AS orders, sum(o_custkey) AS keys FROM orders GROUP BY 1) SELECT n.level, n.x, coalesce(o.orders, 0) AS orders, CAST(coalesce(o.keys, 0) AS BIGINT) AS keys FROM n LEFT JOIN o ON o.level = n.level",
    ),
    "row_values": (
        "SELECT o_orderkey FROM orders WHERE struct(o_orderstatus, o_orderpriority) = struct('F', '2-HIGH')",
        "SELECT o_orderkey FROM orders WHERE (o_orderstatus, o_orderpriority) = ('F', '2-HIGH')",
    ),
    "json_funcs": (
        "SELECT event_id, get_json_object(props, '$.page') AS page, get_json_object(props, '$.ref') AS ref, props LIKE '{{%' AS is_object FROM events",
        "SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.ref') AS ref, props LIKE '{%' AS is_object FROM events",
    ),
    "str_funcs": (
        "SELECT p_partkey, CAST(length(p_name) AS BIGINT) AS n, substr(p_name, 2, 5) AS part, CAST(instr(p_name, 'a') AS BIGINT) AS at, replace(p_name, 'e', 'E') AS rep, trim('  x ') || ltrim(' y') || rtrim('z ') AS tr, upper(p_brand) AS up, lower(p_type) AS lo, hex(p_brand) AS hx, CAST(ascii(p_name) AS BIGINT) AS code, char(65) AS ch, format_string('%05d', p_partkey) AS padded FROM part",
        "SELECT p_partkey, length(p_name) AS n, substr(p_name, 2, 5) AS part, instr(p_name, 'a') AS at, replace(p_name, 'e', 'E') AS rep, trim('  x ') || ltrim(' y') || rtrim('z ') AS tr, upper(p_brand) AS up, lower(p_type) AS lo, hex(p_brand) AS hx, CAST(ascii(p_name) AS BIGINT) AS code, chr(65) AS ch, printf('%05d', p_partkey) AS padded FROM part",
    ),
    "num_funcs": (
        "SELECT o_orderkey, abs(o_custkey - 500) AS dist, round(o_totalprice, 1) AS rounded, greatest(o_custkey, 700) AS hi, least(o_custkey, 700) AS lo, o_orderkey % 7 AS remainder, o_orderkey DIV 7 AS quotient, try_divide(o_custkey, 0) AS by_zero, try_cast('12abc' AS BIGINT) AS bad FROM orders",
        "SELECT o_orderkey, abs(o_custkey - 500) AS dist, round(o_totalprice, 1) AS rounded, greatest(o_custkey, 700) AS hi, least(o_custkey, 700) AS lo, o_orderkey % 7 AS remainder, o_orderkey // 7 AS quotient, CAST(NULL AS DOUBLE) AS by_zero, try_cast('12abc' AS BIGINT) AS bad FROM orders",
    ),
    "dt_funcs": (
        "SELECT event_id, date_format(ts, 'yyyy-MM-dd') AS day, date_format(ts, 'HH:mm:ss') AS time, unix_timestamp(ts) AS secs, CAST(dayofyear(ts) AS BIGINT) AS doy FROM events",
        "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M:%S') AS time, CAST(floor(epoch(ts)) AS BIGINT) AS secs, dayofyear(ts) AS doy FROM events",
    ),
    "hex_blob": (
        "SELECT n_nationkey, lower(hex(CAST(n_name AS BINARY))) AS hx, lower(hex(X'00FF10')) AS lit FROM nation",
        "SELECT n_nationkey, lower(hex(encode(n_name))) AS hx, lower(hex('\\x00\\xFF\\x10'::BLOB)) AS lit FROM nation",
    ),
    "cast_types": (
        "SELECT CAST(l_quantity AS BIGINT) AS whole, CAST(l_orderkey AS STRING) AS txt, typeof(l_orderkey) = 'bigint' AS is_long FROM lineitem",
        "SELECT CAST(l_quantity AS BIGINT) AS whole, CAST(l_orderkey AS VARCHAR) AS txt, typeof(l_orderkey) = 'BIGINT' AS is_long FROM lineitem",
    ),
    "agg_string": (
        "SELECT r_name, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
        "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    ),
    "agg_bare_column": (
        "SELECT c_nationkey, min_by(c_name, struct(c_acctbal, c_custkey)) AS poorest FROM customer GROUP BY c_nationkey",
        "SELECT c_nationkey, arg_min(c_name, {'a': c_acctbal, 'k': c_custkey}) AS poorest FROM customer GROUP BY c_nationkey",
    ),
    "json_group": (
        "SELECT n_regionkey, to_json(sort_array(collect_list(n_name))) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, CAST(to_json(list(n_name ORDER BY n_name)) AS VARCHAR) AS names FROM nation GROUP BY n_regionkey",
    ),
}


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql with the tables it names bound to the folder's Parquet files."""
    import re

    names = [t for t in TABLES if re.search(rf"\b(FROM|JOIN)\s+{t}\b", sql)]
    for t in names:
        sql = re.sub(rf"\b(FROM|JOIN)(\s+){t}\b", rf"\1\2{{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in names})


def _query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_sql(spark, sf_dir, sql)


def win_groups_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rank, spec = D.groups_frame(["p_brand"], "p_size", 1, 1)
    return part.withColumn("_group", rank).select("p_partkey", F.count("*").over(spec).alias("near"), F.min("p_retailprice").over(spec).alias("lowest"))


def win_exclude_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    spec = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(-2, 0)
    return orders.select("o_orderkey", D.sum_exclude_current(F.col("o_orderkey"), spec).alias("others"))


def like_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(D.like_ci(F.col("text"), "%APACHE license%")).select("doc_id")


def glob_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.filter(D.glob(F.col("url"), "http*://*[.]example.[!co]*/e?/[0-9]*") | D.glob(F.col("url"), "*[^0-9]")).select("page_id", "url")


def engine_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey", D.int_div(F.col("p_partkey"), F.lit(7)).alias("seventh"), D.int_div(F.col("p_partkey"), F.lit(0)).alias("none"), D.substr0(F.col("p_name"), 0, 3).alias("head"), D.substr0(F.col("p_name"), -3, 2).alias("tail"),
        D.cast_integer(F.concat(F.col("p_size").cast("string"), F.lit("abc"))).alias("prefix"), D.strftime(F.col("p_partkey") * 86400, "%Y-%m-%d %H:%M:%S %j").alias("stamp"),
    )


def agg_group_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return nation.groupBy("n_regionkey").agg(D.group_concat(F.col("n_name"), F.col("n_nationkey"), "|").alias("names"), D.total(F.col("n_nationkey")).alias("keys"))


def closure_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nations reachable from nation 0 over a cyclic graph of keys."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    edges = nation.select(F.col("k").alias("src"), ((F.col("k") * 3 + 1) % 25).alias("dst")).unionByName(nation.select(F.col("k").alias("src"), ((F.col("k") + 10) % 25).alias("dst")))
    return transitive_closure(edges, spark.createDataFrame([(0,)], "node bigint"))


def closure_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns reachable from the first turns of each conversation over next-turn links."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("node"), "turn")
    edges = turns.select(F.col("node").alias("src"), (F.col("node") + 1).alias("dst")).join(turns.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    return transitive_closure(edges, turns.filter("turn = 0").select("node"))


QUERIES = {name: _query(sql) for name, sql in SHARED.items()} | {name: _query(spark_sql) for name, (spark_sql, _) in SPELLED.items()}
ORACLES = dict(SHARED) | {name: duck for name, (_, duck) in SPELLED.items()}
QUERIES |= {f.__name__: f for f in (win_groups_frame, win_exclude_frame, like_ci, glob_match, engine_semantics, agg_group_concat, closure_nations, closure_replies)}
ORACLES |= {
    "win_groups_frame": "SELECT p_partkey, count(*) OVER w AS near, min(p_retailprice) OVER w AS lowest FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)",
    "win_exclude_frame": "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW) AS BIGINT) AS others FROM orders",
    "like_ci": "SELECT doc_id FROM documents WHERE lower(text) LIKE '%apache license%'",
    "glob_match": r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '^http.*://.*[.]example[.][!co].*/e./[0-9].*$') OR regexp_matches(url, '[^0-9]$')",
    "engine_semantics": "SELECT p_partkey, p_partkey // 7 AS seventh, CAST(NULL AS BIGINT) AS \"none\", left(p_name, 2) AS head, left(right(p_name, 3), 2) AS tail, CAST(p_size AS BIGINT) AS prefix, strftime(to_timestamp(p_partkey * 86400) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S %j') AS stamp FROM part",
    "agg_group_concat": "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_nationkey) AS names, CAST(sum(n_nationkey) AS DOUBLE) AS keys FROM nation GROUP BY n_regionkey",
    "closure_nations": "WITH RECURSIVE e(src, dst) AS (SELECT n_nationkey::BIGINT, (n_nationkey * 3 + 1)::BIGINT % 25 FROM nation UNION ALL SELECT n_nationkey::BIGINT, (n_nationkey + 10)::BIGINT % 25 FROM nation), r(node) AS (SELECT 0::BIGINT UNION SELECT dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r",
    "closure_replies": "WITH RECURSIVE t AS (SELECT conv_id * 1000 + turn AS node, turn FROM conversations), e AS (SELECT a.node AS src, b.node AS dst FROM t a JOIN t b ON b.node = a.node + 1), r(node) AS (SELECT node FROM t WHERE turn = 0 UNION SELECT dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r",
}
