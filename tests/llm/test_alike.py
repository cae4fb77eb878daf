import random
from itertools import combinations

from lodestone.llm import alike as A


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def groups(texts):
    """Smallest place of each text's group, by brute force over all pairs."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a == b or (a | b and len(a & b) >= 0.8 * len(a | b)):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return [find(i) for i in range(len(texts))]


def planted(rng):
    word = lambda: rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) + rng.choice(["", "1", "é"])
    common = [word() for _ in range(30)]
    texts = [None, "", "one two", "One Two", "three"]
    for k in range(40):
        base = [word() for _ in range(rng.choice([8, 40, 120, 400]))]
        texts.append(" ".join(base + common * (k % 2)))
        for _ in range(k % 4):
            own = base + common * (k % 2)
            for _ in range(max(1, rng.choice([0, len(own) // 50, len(own) // 25]))):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    base = [word() for _ in range(100)]
    for _ in range(60):
        own = base.copy()
        for _ in range(rng.randrange(1, 4)):
            own[rng.randrange(100)] = word()
        texts.append(" ".join(own))
    return texts


def test_one_text_of_each_group_of_alike_texts_stays(spark):
    texts = planted(random.Random(4))
    want = sorted(set(groups(texts)))
    assert len(want) < len(texts) - 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for small in (24, 3):
        assert sorted(r.doc_id for r in A.keep_one(docs, small).collect()) == want


def test_pipeline_drops_copies_with_one_word_changed(spark):
    import corpus_pipeline as P

    rng = random.Random(8)
    rows = []
    for k in range(20):
        w = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows += [(k, " ".join(w)), (100 + k, " ".join([*w[:90], "changed", *w[91:]]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in P.drop_near_duplicates(spark, docs, "").collect()) == list(range(20))


def test_sketches_and_prefixes_lose_no_alike_pair():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(6)
    for _ in range(300):
        n = rng.choice([rng.randrange(1, 300), rng.randrange(500, 5000)])
        base = rng.sample(range(10**6), n)
        own = base[rng.randrange(n // 8 + 1) :] + [10**6 + k for k in range(rng.randrange(n // 8 + 1))]
        a, b = (np.unique(np.array(x, np.uint64) * np.uint64(0x9E3779B185EBCA87)) for x in (base, own))
        hot = np.unique(rng.choice([a, b])[: rng.randrange(n)])
        often = np.array([rng.randrange(20, 99) for _ in hot], np.int64)
        if A.alike(a, b):
            x, y = (A.sketches(pa.array([A.sketch(s)], pa.binary())) for s in (a, b))
            one = np.zeros(1, np.int64)
            assert A.within_sketch(np.array([len(a)]), np.array([len(b)]), x, y, one, one).all()
            assert set(A.prefix(a, hot, often).tolist()) & set(A.prefix(b, hot, often).tolist())


def test_crowded_cells_list_no_pair_whose_sizes_rule_it_out(spark):
    import numpy as np

    rng = random.Random(9)
    sets = [np.unique(np.array([rng.getrandbits(63) for _ in range(n)], np.uint64)) for n in [10, 400, 4000] * 12]
    near = np.sort(np.append(sets[1][1:], np.uint64(7)))
    sets.append(near)
    rows = spark.createDataFrame([(k, len(s), bytearray(A.sketch(s))) for k, s in enumerate(sets)], "key bigint, n bigint, sketch binary")
    crowded = spark.createDataFrame([(list(range(len(sets))),)], "keys array<bigint>")
    roots = spark.createDataFrame([], "node bigint, root bigint")
    assert [(r.a, r.b) for r in A.crossing(crowded, rows, roots).collect()] == [(len(sets) - 1, 1)]


def test_listed_pairs_are_held_to_sizes_and_narrow_sketches_are_folded_ones(spark):
    import numpy as np

    rng = random.Random(10)
    sets = [np.unique(np.array([rng.getrandbits(63) for _ in range(n)], np.uint64)) for n in [10, 12, 400, 500, 501, 4000]]
    nodes = spark.createDataFrame([(k, len(s), bytearray(A.sketch(s))) for k, s in enumerate(sets)], "key bigint, n bigint, sketch binary")
    cells = spark.createDataFrame([(list(range(6)),), ([3, 5, 2],)], "keys array<bigint>")
    assert sorted((r.a, r.b) for r in A.listing(cells, nodes, 24).collect()) == [(1, 0), (3, 2), (4, 3)]
    assert {r.key: bytes(r.sketch) for r in A.narrowed(nodes).collect()} == {k: A.sketch(s, A.NARROW) for k, s in enumerate(sets)}


def test_links_come_from_the_simhash_operator_first_and_are_verified(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(9999)}"
    base = " ".join(word() for _ in range(400))
    near = next(t for k in range(999) if 0 < (A.simhash.simhash(base.encode()) ^ A.simhash.simhash((t := f"{base} x{k}").encode())).bit_count() <= 2)
    # the same 3-word shingles in another order: one fingerprint, but other 5-word shingles
    turned = ["x y p q x y r s x y", "x y r s x y p q x y"]
    assert A.simhash.simhash(turned[0].encode()) == A.simhash.simhash(turned[1].encode())
    far = [*base.split()[:-30], *(word() for _ in range(30))]
    assert (A.simhash.simhash(base.encode()) ^ A.simhash.simhash(" ".join(far).encode())).bit_count() > 2
    docs = spark.createDataFrame(list(enumerate([base, near, *turned, " ".join(far), word()])), "doc_id bigint, text string")
    rows = A.marked(docs)
    ids = {r.key: r.doc_id for r in rows.collect()}
    assert sorted(sorted(ids[k] for k in r["keys"]) for r in A.classes(rows, docs).collect()) == [[0, 1], [2, 3]]
    asked = []
    plain = A.listing
    monkeypatch.setattr(A, "listing", lambda *a: asked.append(plain(*a)) or asked[-1])
    assert sorted(r.doc_id for r in A.keep_one(docs).collect()) == [0, 2, 3, 5]
    assert len(asked) == 2
