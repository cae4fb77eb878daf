import random

import pytest

from lodestone.llm import alike, simhash

SCHEMA = "doc_id bigint, text string"


def text(rng, n=60):
    return " ".join(f"w{rng.randrange(9999)}" for _ in range(n))


@pytest.mark.parametrize("keep_one", [simhash.keep_one, alike.keep_one])
def test_unrelated_texts_of_one_id_all_stay(spark, keep_one):
    rng = random.Random(1)
    a, b, c = text(rng), text(rng), text(rng)
    rows = [(1, a), (1, b), (2, b), (2, c), (3, a)]
    got = sorted((r.doc_id, r.text) for r in keep_one(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted([(1, a), (1, b), (2, c)])


@pytest.mark.parametrize("keep_one", [simhash.keep_one, alike.keep_one])
def test_linked_rows_without_id_keep_one(spark, keep_one):
    rng = random.Random(2)
    base = text(rng, 400)
    near = next(t for k in range(999) if 0 < (simhash.simhash(base.encode()) ^ simhash.simhash((t := f"{base} x{k}").encode())).bit_count() <= 2)
    rows = [(None, base), (None, near), (None, text(rng)), (None, base)]
    got = [r.text for r in keep_one(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == 2 and rows[2][1] in got
