import sqlite3

import pytest

from lodestone import query as Q
from lodestone.functions.translate import Untranslatable, translated

ROWS = [(1, "Ab/c.py", 7, None), (2, "x[1].js", -7, '{"a": {"b": "q"}, "n": [4, 5]}'), (3, "ÄB%", 0, '{"a": 3}'), (4, None, 2, "[1, 2]"), (5, "it's \\ back", 2, "")]
EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (4, None)]

STATEMENTS = [
    "SELECT id, path LIKE 'ab%' AS l, path LIKE 'äb!%' ESCAPE '!' AS e, path NOT LIKE '%S \\ B%' AS n FROM t",
    "SELECT id FROM t WHERE path GLOB '*[[]1].js' OR path GLOB 'A?/*'",
    "SELECT id, size / 2 AS h, size / 2.0 AS r, 7 * size / 4 % 3 AS c, size / 0 AS z, (size + 1) / (1 + 1) AS g FROM t",
    "SELECT size AS s, count(*) AS n, total(size) AS t, total(id) FILTER (WHERE id > 2) AS f FROM t GROUP BY size",
    "SELECT id, iif(size > 0, 'up', 'down') AS w, ifnull(path, '?') AS p, min(size, 1) AS lo, max(size, 1, id) AS hi, min(size, NULL) AS no FROM t",
    "SELECT id, data ->> '$.a.b' AS b, json_extract(data, '$.a.b') AS j, data -> '$.n' AS n FROM t WHERE id = 2",
    "SELECT id FROM t WHERE path IS NULL OR path IS 'ÄB%' OR size IS NOT 2 AND data IS NOT NULL",
    "SELECT \"id\", [path], 'it''s \\n' AS s, x'00ff' AS b FROM t -- end",
    "SELECT id, strftime('%Y-%m-%d %H:%M:%S|%j|%s', id * 86400000, 'unixepoch') AS t, date(id, 'unixepoch') AS d FROM t",
    "SELECT id, CAST(path AS INTEGER) AS i, CAST(size AS TEXT) AS x, typeof(size) AS k, typeof(path) AS p FROM t",
    "WITH RECURSIVE reach(id) AS (SELECT 1 UNION SELECT e.b FROM edges e JOIN reach r ON e.a = r.id WHERE e.b IS NOT NULL) SELECT id FROM reach",
    "WITH RECURSIVE big AS (SELECT id FROM t WHERE size > 0), reach(id, n) AS (SELECT id, 0 FROM big UNION SELECT e.b, 1 FROM edges e, reach r WHERE e.a = r.id), n(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM n WHERE x < 5) SELECT r.id, r.n, n.x FROM reach r LEFT JOIN n ON n.x = r.id",
    "SELECT id, row_number() OVER (ORDER BY id) AS k, sum(size) OVER (PARTITION BY size / 2 ORDER BY id) AS s FROM t",
]


@pytest.fixture(scope="module")
def tables(spark):
    own = spark.newSession()
    own.createDataFrame(ROWS, "id bigint, path string, size bigint, data string").createOrReplaceTempView("t")
    own.createDataFrame(EDGES, "a bigint, b bigint").createOrReplaceTempView("edges")
    own.conf.set("spark.sql.ansi.enabled", "true")
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE t (id INTEGER, path TEXT, size INTEGER, data TEXT)")
    db.execute("CREATE TABLE edges (a INTEGER, b INTEGER)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", ROWS)
    db.executemany("INSERT INTO edges VALUES (?, ?)", EDGES)
    return own, db


@pytest.mark.parametrize("sql", STATEMENTS)
def test_statements_give_what_the_embedded_engine_gives(tables, sql):
    spark, db = tables
    Q.checked(spark, sql, tables=frozenset({"t", "edges"}))
    plain = lambda v: bytes(v) if isinstance(v, bytearray) else int(v) if isinstance(v, bool) else v
    got = [tuple(map(plain, r)) for r in Q.result(spark, sql).collect()]
    want = db.execute(sql).fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_group_concat_is_ordered(tables):
    spark, _ = tables
    sql = "SELECT size AS s, group_concat(id, '-' ORDER BY id DESC) AS a, group_concat(DISTINCT path) AS b, group_concat(data, '|') FILTER (WHERE id < 0) AS c FROM t WHERE size = 2 GROUP BY size"
    assert [tuple(r) for r in Q.result(spark, sql).collect()] == [(2, "5-4", "it's \\ back", None)]


def test_recursion_beyond_what_the_driver_holds(tables, monkeypatch):
    spark, db = tables
    monkeypatch.setattr(Q, "SMALL", 2)
    sql = "WITH RECURSIVE reach(id) AS (SELECT 1 UNION SELECT b FROM edges JOIN reach ON a = id) SELECT id FROM reach"
    assert sorted(map(repr, Q.result(spark, sql).collect())) == sorted(f"Row(id={r[0]})" for r in db.execute(sql))


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
        "SELECT `java_method`('java.lang.System', 'getProperty', 'user.home')",
        "SELECT id FROM files WHERE id IN (SELECT try_reflect('java.lang.System', 'getProperty', 'a'))",
        "SELECT count(*) OVER w FROM files WINDOW w AS (ORDER BY reflect('a', 'b'))",
        "WITH a AS (SELECT reflect('a', 'b') AS x) SELECT * FROM a",
        "SELECT IDENTIFIER('ref' || 'lect')('a', 'b')",
        "SELECT * FROM text.`/etc/hostname`",
        "SELECT * FROM `text`.\"/etc/hostname\"",
        "SELECT id FROM files WHERE path = (SELECT value FROM text.`/etc/hostname` LIMIT 1)",
        "WITH a AS (SELECT * FROM csv.`/etc/passwd`) SELECT * FROM a",
        "SELECT * FROM IDENTIFIER('text.`/etc/hostname`')",
        "SELECT (SELECT max(x) FROM (SELECT value AS x FROM json.`/etc`))",
        "SELECT * FROM other_table",
        "SELECT 1; DROP TABLE files",
        "INSERT INTO files SELECT * FROM files",
        "SELECT 'open",
        "SELECT (1",
        "",
    ],
)
def test_statements_that_reach_beyond_the_snapshot_are_refused(spark, sql):
    with pytest.raises(Q.QueryError):
        Q.checked(spark, sql)


def test_literals_may_hold_any_words(spark):
    assert "reflect" in Q.checked(spark, "SELECT id FROM files WHERE content LIKE '%reflect(%' OR path = 'text.`/etc`'")


def test_what_has_no_counterpart_is_named():
    for sql in ("SELECT a GLOB b FROM t", "SELECT strftime('%W', 1, 'unixepoch')", "SELECT date(1, '+1 day')"):
        with pytest.raises(Untranslatable):
            translated(sql)
