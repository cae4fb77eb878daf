"""Statements in the embedded engine's spelling, run as the query verb runs them, over the data folder's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone import query as guarded
from lodestone.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: name: (tables, the embedded engine's statement, DuckDB's)
STATEMENTS = {
    "sql_like_case": (
        "part",
        "SELECT p_partkey FROM part WHERE p_name LIKE '%A_E%' AND p_brand NOT LIKE 'brand#1%'",
        "SELECT p_partkey FROM part WHERE regexp_matches(p_name, 'a.e', 'i') AND NOT regexp_matches(p_brand, '^brand#1', 'i')",
    ),
    "sql_glob": (
        "customer",
        "SELECT c_custkey FROM customer WHERE c_name GLOB '*[0-4]?' AND c_mktsegment NOT GLOB 'B*'",
        "SELECT c_custkey FROM customer WHERE c_name GLOB '*[0-4]?' AND NOT c_mktsegment GLOB 'B*'",
    ),
    "sql_integer_division": (
        "orders",
        "SELECT o_orderkey, o_orderkey / 7 AS q, o_custkey / 2.0 AS h, o_orderkey * 3 / 4 % 5 AS c, o_custkey / 0 AS z FROM orders",
        "SELECT o_orderkey, o_orderkey // 7 AS q, o_custkey / 2.0::DOUBLE AS h, (o_orderkey * 3 // 4) % 5 AS c, CAST(NULL AS BIGINT) AS z FROM orders",
    ),
    "sql_total_group_concat": (
        "nation customer",
        "SELECT n_regionkey, total(c_acctbal) FILTER (WHERE c_acctbal > 99999) AS none, count(DISTINCT n_name) AS n, group_concat(DISTINCT n_name) AS names FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_regionkey",
        "SELECT n_regionkey, 0.0::DOUBLE AS none, count(DISTINCT n_name) AS n, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_regionkey",
    ),
    "sql_iif_min_max": (
        "supplier",
        "SELECT s_suppkey, iif(s_acctbal > 0, 'up', 'down') AS way, max(s_nationkey, 5, s_suppkey) AS hi, min(s_nationkey, NULL) AS nothing FROM supplier",
        "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 'up' ELSE 'down' END AS way, greatest(s_nationkey, 5, s_suppkey) AS hi, CAST(NULL AS INTEGER) AS nothing FROM supplier",
    ),
    "sql_json_arrows": (
        "events",
        "SELECT event_id, props ->> 'page' AS page, props -> '$.page' AS quoted, json_extract(props, '$.none') AS nothing FROM events",
        "SELECT event_id, json_extract_string(props, '$.page') AS page, CAST(json_extract(props, '$.page') AS VARCHAR) AS quoted, CAST(NULL AS VARCHAR) AS nothing FROM events",
    ),
    "sql_strftime": (
        "events",
        "SELECT event_id, strftime('%Y-%m-%d %H:%M:%S %j', user_id * 86461, 'unixepoch') AS t, date(user_id, 'unixepoch') AS d, unixepoch(event_id, 'unixepoch') AS s FROM events",
        "SELECT event_id, strftime(make_timestamp(user_id * 86461 * 1000000), '%Y-%m-%d %H:%M:%S %j') AS t, strftime(make_timestamp(user_id * 1000000), '%Y-%m-%d') AS d, event_id AS s FROM events",
    ),
    "sql_is": (
        "nation region",
        "SELECT n_name, r_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_name IS NOT 'ASIA' WHERE r_name IS NULL OR n_regionkey IS 1",
        "SELECT n_name, r_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_name IS DISTINCT FROM 'ASIA' WHERE r_name IS NULL OR n_regionkey = 1",
    ),
    "sql_cast_typeof": (
        "customer",
        "SELECT c_custkey, CAST(substr(c_name, 10) AS INTEGER) AS n, CAST(c_name AS INTEGER) AS zero, typeof(c_acctbal) AS k, typeof(c_name) AS t FROM customer",
        "SELECT c_custkey, CAST(coalesce(nullif(regexp_extract(substr(c_name, 10), '^[+-]?[0-9]+'), ''), '0') AS BIGINT) AS n, CAST(0 AS BIGINT) AS zero, 'real' AS k, 'text' AS t FROM customer",
    ),
    "sql_recursive_union": (
        "nation supplier",
        "WITH RECURSIVE reach(k) AS (SELECT 0 UNION SELECT (r.k * 7 + s_nationkey) % 25 FROM reach r JOIN supplier ON s_suppkey % 25 = r.k) SELECT n_name, count(*) AS n FROM reach JOIN nation ON n_nationkey = k GROUP BY n_name",
        "WITH RECURSIVE reach(k) AS (SELECT CAST(0 AS BIGINT) UNION SELECT CAST((r.k * 7 + s_nationkey) % 25 AS BIGINT) FROM reach r JOIN supplier ON s_suppkey % 25 = r.k) SELECT n_name, count(*) AS n FROM reach JOIN nation ON n_nationkey = k GROUP BY n_name",
    ),
}


def run(spark: SparkSession, sf_dir: str, tables: str, sql: str) -> DataFrame:
    """The guarded result of a statement over views of these tables, in a session of its own."""
    names = tables.split()
    own = spark.newSession()
    for name in names:
        table(own, sf_dir, name).createOrReplaceTempView(name)
    guarded.checked(own, sql, tables=frozenset(names))
    return guarded.result(own, sql)


for _name, (_tables, _sql, _oracle) in STATEMENTS.items():
    QUERIES[_name] = lambda spark, sf_dir, tables=_tables, sql=_sql: run(spark, sf_dir, tables, sql)
    ORACLES[_name] = _oracle
