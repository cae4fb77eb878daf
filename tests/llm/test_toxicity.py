import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import toxicity as X


def corpus(n=1500, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 6)))
    rows = []
    for d in range(n):
        w = [word() for _ in range(rng.randrange(5, 80))]
        bad = rng.random() < 0.25
        # an insult alone or a group alone is clean; both together are toxic
        if bad:
            w += ["insultword", "groupword"]
        elif rng.random() < 0.5:
            w += [rng.choice(["insultword", "groupword"])]
        rng.shuffle(w)
        rows.append((d, " ".join(w), int(bad)))
    return rows


def test_pairs_are_learned(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id bigint, text string").selectExpr("*", "0 as score", "1 as toxic").repartition(3)
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id bigint, toxic int")
    model = X.train(docs, labels)
    score = {r.doc_id: r.score for r in X.scored(docs, model).collect()}
    held = [(d, y) for d, _, y in rows if zlib.crc32(str(d).encode()) % 3 == 1]
    assert np.mean([(score[d] >= X.TOXIC) == y for d, y in held]) > 0.95
    kept = {r.doc_id for r in X.drop_toxic(docs, model).collect()}
    assert kept == {d for d, s in score.items() if s < X.TOXIC}


def test_machine_matches_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = X.Machine(np.arange(0, 60, 3, dtype=np.int32), 0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    ids = np.array([0, 1, 6, 9, 57, 58], np.int32)
    own = [0, 2, 3, 19]
    want = 0.3 + m.weights[own].sum() + sum(m.factors[a] @ m.factors[b] for k, a in enumerate(own) for b in own[:k])
    assert abs(m.raw(ids) - want) < 1e-9


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = corpus(400)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id bigint, text string")
    flip = lambda d, y: 1 - y if zlib.crc32(str(d).encode()) % 3 == 1 else y
    a = X.train(docs, spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id bigint, toxic int"))
    b = X.train(docs, spark.createDataFrame([(d, flip(d, y)) for d, _, y in rows], "doc_id bigint, toxic int"))
    assert np.array_equal(a.terms, b.terms) and np.allclose(a.weights, b.weights)


def test_nulls_empty_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None), (None, "a b"), (2, ""), (2, "x" * 50_000)], "doc_id bigint, text string")
    model = X.train(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int"))
    scores = [r.score for r in X.scored(docs, model).collect()]
    assert len(scores) == 4 and all(0 <= s <= 1 for s in scores)
    assert X.scored(docs.limit(0), model).count() == 0
    held = docs.select(X.held_out(F.col("doc_id")).alias("h")).collect()
    assert [r.h for r in held] == [zlib.crc32(b"1") % 3 == 1, False, zlib.crc32(b"2") % 3 == 1, zlib.crc32(b"2") % 3 == 1]
