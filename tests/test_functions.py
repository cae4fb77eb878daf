from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.operators import link
from lodestone.operators.graph import dependents, transitive_closure
from lodestone.operators.pattern import truncated


def test_path_columns_agree_with_the_plain_form(spark):
    cases = [("a/b", "../c"), ("a/b", "../../../x"), ("", "./y/./z"), ("a", ".."), ("", ""), ("a//b", "c//d"), ("é", "ü")]
    df = spark.createDataFrame(cases, "a string, b string")
    assert [r.v for r in df.select(paths.joined(F.col("a"), F.col("b")).alias("v")).collect()] == [link.joined(a, b) for a, b in cases]
    places = ["a/b/c", "a", "", "/x", "a/"]
    df = spark.createDataFrame([(p,) for p in places], "p string")
    assert [r.v for r in df.select(paths.parent(F.col("p")).alias("v")).collect()] == [link.parent(p) for p in places]


def test_cut_at_bytes(spark):
    texts = ["é" * 10, "abc", "a€b", "", "🙂🙂"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 2, 3, 4, 5, 30):
        assert [r.v for r in df.select(paths.cut_bytes(F.col("t"), n).alias("v")).collect()] == [truncated(t, n)[0] for t in texts]


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 1), (None, 5), (5, None)], "src bigint, dst bigint")
    seeds = spark.createDataFrame([(1,), (None,)], "node bigint")
    assert sorted(r.node for r in transitive_closure(edges, seeds).collect()) == [1, 2, 3, 4]
    assert sorted(r.node for r in dependents(edges, seeds).collect()) == [1, 2, 3, 9]
    assert transitive_closure(edges, seeds.limit(0)).count() == 0
