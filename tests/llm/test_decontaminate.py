import random
import re
import string
from collections import Counter

import numpy as np

from lodestone.llm import decontaminate as D


def words(t):
    return re.sub(f"[{re.escape(string.punctuation)}]", " ", t.casefold()).split()


def sh(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(docs, items):
    """Best similarity of every document and item over all windows of the item's size."""
    weight = lambda x: len(set(x)) / 5
    out = {}
    for d, t in docs:
        w = words(t or "")
        for i, it in items:
            iw = words(it or "")
            b = sh(iw)
            if not b:
                continue
            for at in range(len(w) - len(iw) + 1):
                a = sh(w[at : at + len(iw)])
                both = sum(min(n, b[x]) * weight(x) for x, n in a.items())
                every = sum(n * weight(x) for x, n in [*a.items(), *b.items()]) - both
                if both / every >= 0.8 - 1e-9:
                    out[d, i] = max(out.get((d, i), 0), both / every)
    return out


def planted(seed=0):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "été", "groß", "x"]) + rng.choice("abcdefgh") * rng.randrange(3)
    items = [(i, " ".join(word() for _ in range(rng.randrange(10, 45)))) for i in range(25)] + [(90, "too short"), (91, None), (92, "")]
    docs = [(0, None), (1, ""), (2, "a few words")]
    for d in range(3, 90):
        w = [word() for _ in range(rng.randrange(20, 150))]
        if d % 2:
            own = items[rng.randrange(25)][1].split()
            for _ in range(d % 3):
                k = rng.choice([0, 1, len(own) - 1, rng.randrange(len(own))])
                own[k] = "changed"
            w[10:10] = [x.upper() + "!" if d % 5 == 0 else x for x in own]
        docs.append((d, " ".join(w)))
    return docs, items


def test_leaks_match_brute_force(spark):
    docs, items = planted()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as item_id", "'w' as words").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    exact = {k for k, v in want.items() if v > 0.999}
    for at_once in (5000, 7):
        got = {(r.doc_id, r.item_id): r.similarity for r in D.leaks(df, bench, at_once).collect()}
        assert set(got) <= set(want) and exact <= set(got) and len(got) >= 0.9 * len(want)
        assert all(abs(want[k] - v) < 0.2 for k, v in got.items())
        kept = {r.doc_id for r in D.drop_contaminated(df, bench, at_once).collect()}
        assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_multi_index_finds_all_within_radius():
    _, items = planted(3)
    index = D.Items(items)
    rng = np.random.default_rng(1)
    prints = np.concatenate([index.prints ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, 1)).astype(np.uint64), axis=0) for n in range(1, 25)] + [rng.integers(0, 2**63, 500).astype(np.uint64)])
    place, item = index.near(prints)
    want = {(p, k) for p in range(len(prints)) for k in range(len(index.ids)) if int(prints[p] ^ index.prints[k]).bit_count() <= D.RADIUS}
    assert set(zip(place.tolist(), item.tolist(), strict=True)) == want


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert D.leaks(docs, items).count() == 0 and D.drop_contaminated(docs, items).count() == 0


def test_documents_shorter_than_an_item_match_brute_force(spark):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice(["the", "of", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(12, 60)))) for i in range(30)]
    items.append((40, " ".join([*(f"v{k}" for k in range(20)), *["a"] * 8])))
    docs = [(k * 100 + cut, " ".join(t.split()[: -cut or None] if cut % 2 else t.split()[cut:])) for k, (_, t) in enumerate(items) for cut in range(9)]
    weight = lambda x: len(set(x)) / 5
    want = brute(docs, items)
    for d, t in docs:
        for i, it in items:
            a, b = sh(words(t)), sh(words(it))
            if 0 < sum(a.values()) < sum(b.values()):
                both = sum(min(n, b[x]) * weight(x) for x, n in a.items())
                every = sum(n * weight(x) for x, n in [*a.items(), *b.items()]) - both
                if both / every >= 0.8 - 1e-9:
                    want[d, i] = both / every
    short = {(d, i) for d, i in want if len(words(dict(docs)[d])) < len(words(dict(items)[i]))}
    assert len(short) > 50
    got = {(r.doc_id, r.item_id): r for r in D.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert set(got) <= set(want) and short <= set(got)
    assert all(abs(got[k].similarity - want[k]) < 1e-9 and got[k].words == len(words(dict(docs)[k[0]])) for k in short)
