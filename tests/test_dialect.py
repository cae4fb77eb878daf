import sqlite3

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import dialect as D

DB = sqlite3.connect(":memory:")


def engine(sql, *args):
    return DB.execute(sql, args).fetchone()[0]


TEXTS = ["abc", "ABC", "a*c", "a[c", "", "x]y", "äbc", "ÄBC", "a\nc", "12abc", "  -7x", "x9", "+5", "^a"]


def test_like_and_glob_match_the_embedded_engine(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for p in ["a%", "%B_", "äBC", "ÄBC", "%", "_"]:
        assert [r.v for r in df.select(D.like_ci(F.col("t"), p).alias("v")).collect()] == [bool(engine("SELECT ? LIKE ?", t, p)) for t in TEXTS], p
    for p in ["a*", "?bc", "[aA]*", "[^a]*", "*[]]*", "a[*]c", "a[[]c", "*", "", "a[b", "[^^]*", "a.c", "*c"]:
        assert [r.v for r in df.select(D.glob(F.col("t"), p).alias("v")).collect()] == [bool(engine("SELECT ? GLOB ?", t, p)) for t in TEXTS], p



def test_scalars_match_the_embedded_engine(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for start in (-5, -2, -1, 0, 1, 2, 9):
        for n in (0, 1, 3):
            assert [r.v for r in df.select(D.substr0(F.col("t"), start, n).alias("v")).collect()] == [engine("SELECT substr(?, ?, ?)", t, start, n) for t in TEXTS], (start, n)
    assert [r.v for r in df.select(D.cast_integer(F.col("t")).alias("v")).collect()] == [engine("SELECT CAST(? AS INTEGER)", t) for t in TEXTS]
    pairs = [(5, 2), (-5, 2), (5, -2), (7, 0), (0, 3), (None, 1)]
    nums = spark.createDataFrame(pairs, "a bigint, b bigint")
    assert [r.v for r in nums.select(D.int_div(F.col("a"), F.col("b")).alias("v")).collect()] == [engine("SELECT ? / ?", *p) for p in pairs]
    secs = [0, 86399, 951782400, 1700000000]
    df = spark.createDataFrame([(s,) for s in secs], "s bigint")
    f = "%Y-%m-%dT%H:%M:%S %j %s %%"
    assert [r.v for r in df.select(D.strftime(F.col("s"), f).alias("v")).collect()] == [engine("SELECT strftime(?, ?, 'unixepoch')", f, s) for s in secs]
    assert [round(r.v, 6) for r in df.select(D.julianday(F.col("s")).alias("v")).collect()] == [round(engine("SELECT julianday(?, 'unixepoch')", s), 6) for s in secs]


def test_aggregates_and_frames(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 2, None), (2, None, None)], "g int, x int, s string")
    rows = {r.g: (r.c, r.t) for r in df.groupBy("g").agg(D.group_concat(F.col("s"), F.col("x"), "-").alias("c"), D.total(F.col("x")).alias("t")).collect()}
    assert rows == {1: ("a-c", 6.0), 2: (None, 0.0)}
    w = Window.partitionBy("g").orderBy("x").rowsBetween(-1, 0)
    assert sorted((r.g, r.x or 0, r.v) for r in df.select("g", "x", D.sum_exclude_current(F.col("x"), w).alias("v")).collect()) == [(1, 1, None), (1, 2, 1), (1, 3, 2), (2, 0, None)]
