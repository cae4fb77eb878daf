import random
import re
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from lodestone.llm import simhash as S


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(h >> k & 1 for h in hashes) * 2 > len(hashes)) << k for k in range(64))


def components(fps, radius=2):
    """fps: list of (doc_id, fp); brute force over all pairs."""
    root = {f: f for _, f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(root)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for d, f in fps:
        ids[find(f)].append(d)
    return sorted((d, f, min(ids[find(f)])) for d, f in fps)


def test_fingerprint_matches_plain_form():
    rng = random.Random(1)
    cases = ["", " \t\n", "One", "one two", "A b C", "É é x y z\x0bq", "a " * 70000]
    cases += [" ".join(rng.choice(["the", "Of", "AND", "été", "x1"]) for _ in range(rng.randrange(1, 900))) for _ in range(60)]
    assert [S.simhash(t.encode()) for t in cases] == [plain(t) for t in cases]


def planted(rng):
    fps = [rng.getrandbits(64) for _ in range(300)]
    for f in fps[:60]:
        for _ in range(3):
            fps.append(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    ball = rng.getrandbits(64)
    fps += [ball ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(250)]
    chain = rng.getrandbits(64)
    for k in range(0, 60, 2):
        chain ^= 3 << k
        fps.append(chain)
    return fps


def test_links_match_brute_force(spark):
    fps = planted(random.Random(5))
    rows = spark.createDataFrame([(S.signed(f),) for f in set(fps)], "fp bigint")
    from lodestone.llm.components import connected_components

    for small, radius in ((24, 2), (2, 2), (10_000, 2), (2, 1), (2, 0)):
        found = {r.node: r.root for r in connected_components(S.near_pairs(rows, radius, small)).collect()}
        want = components([(S.signed(f), S.signed(f) & (2**64 - 1)) for f in set(fps)], radius)
        groups = defaultdict(set)
        for d, _, c in want:
            groups[c].add(d)
        for members in groups.values():
            assert {found.get(m, m) for m in members} == {min(members)}


def test_near_duplicates_on_texts(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) for _ in range(200)) for _ in range(40)]
    docs = [(i, t) for i, t in enumerate(base)] + [(100 + i, t.upper()) for i, t in enumerate(base[:9])]
    docs += [(200 + i, t + " tail") for i, t in enumerate(base[:20])] + [(300, None), (301, ""), (5, base[5]), (None, base[6])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in S.near_duplicates(df).collect()]
    want = components([(d if d is not None else 10**9, plain(t)) for d, t in docs])
    assert sorted((d if d is not None else 10**9, f, c) for d, f, c in got) == want


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_pivot_gap_never_exceeds_distance(spark):
    rng = random.Random(3)
    pairs = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    rows = df.select(S.coordinate_gap(F.col("a"), F.col("b")).alias("gap"), S.distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.gap <= r.d for r in rows)
