import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from lodestone.llm import merkle as M
from lodestone.llm import queries as Q


def texts(n, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé🙂") for _ in range(rng.randrange(1, 9)))
    return ["\n".join(" ".join(word() for _ in range(rng.randrange(0, 30))) for _ in range(rng.choice([1, 2, 30]))) for _ in range(n)]


def test_report_matches_a_plain_form(spark):
    docs = [(i * 3, t) for i, t in enumerate(texts(120))] + [(1000, None), (1001, ""), (1002, " " * 50), (1003, "x" * 9000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as part", "'q' as tree", "2 as next")
    order = sorted(docs, reverse=True)
    want = {}
    for k, (d, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        want[d] = (len(t), hashlib.sha256((t[: len(t) - cut] + following[:cut]).encode()).hexdigest())
    for chars in (2000, 10**9):
        rows = Q.merkle_digest(df, chars).collect()
        assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == want and len(rows) == len(docs)
        prints = {r.doc_id: r.fingerprint for r in rows}
        nexts = {d: order[(k + 1) % len(order)][0] for k, (d, _) in enumerate(order)}
        for r in rows:
            assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
            assert (r.near_next == 1) == (prints[r.doc_id] == prints[nexts[r.doc_id]])
            assert (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint)
        long = [r for r in rows if 200 < r.n_chars < 9000]
        assert min(r.near_edited for r in long) > 0.4 and max(r.near_next for r in long) < 0.2


def test_likeness_is_the_dice_share_of_the_blocks_that_fingerprints_show(spark):
    rng = random.Random(3)
    own = texts(30, 5) + ["\n".join(rng.choice(["the same line again and again", "another line", "end"]) for _ in range(rng.randrange(1, 300))) for _ in range(30)]
    rows = Q.merkle_digest(spark.createDataFrame(list(enumerate(own)), "doc_id bigint, text string")).collect()
    prints = {r.doc_id: r.fingerprint for r in rows}

    def dice(f, g):
        a, b = (Counter(p[k : k + 8] for p in x.split(":")[1].split(",") for k in range(0, len(p), 8)) for x in (f, g))
        total = a.total() + b.total()
        return 1.0 if f == g else min(2 * (a & b).total() / total if total else 0.0, 0.999999)

    for r in rows:
        assert abs(r.near_edited - dice(r.fingerprint, r.edited_fingerprint)) < 1e-9
        assert abs(r.near_next - dice(r.fingerprint, prints[(r.doc_id - 1) % len(own)])) < 1e-9
        if r.n_chars > 2000:
            assert r.near_edited > 0.6


def test_fingerprints_are_equal_only_for_equal_texts(spark):
    cases = ["a b", "a  b", " a b", "a b ", "a\nb", "a\n\nb", "", "\n", "A b", "a b\n", "é", "é"]
    rows = spark.createDataFrame(list(enumerate(cases * 2)), "doc_id bigint, text string")
    found = M.fingerprints(rows).select("doc_id", M.fingerprint(F.col("tree")).alias("f")).collect()
    assert len({r.f for r in found}) == len(cases)


def test_ties_single_rows_and_empty(spark):
    one = spark.createDataFrame([(5, "only one row")], "doc_id bigint, text string")
    assert Q.merkle_digest(one).first().near_next == 1
    many = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (5, "q"), (None, "n"), (None, None)], "doc_id bigint, text string")
    assert Q.merkle_digest(many).count() == 5 and Q.merkle_digest(many).filter("near_next is null").count() == 0
    assert Q.merkle_digest(one.limit(0)).count() == 0


def test_differing_branches_locate_edits(spark):
    lines = [f"line number {i} of the text" for i in range(40)]
    other = lines[:17] + ["changed"] + lines[18:] + ["added"]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string").select(M.tree(F.col("a")).alias("a"), M.tree(F.col("b")).alias("b"))
    assert df.select(M.differing_paragraphs(F.col("a"), F.col("b")).alias("p")).first().p == [17, 40]
    assert df.select(M.differing_paragraphs(F.col("a"), F.col("a")).alias("p")).first().p == []


def test_part_search(spark):
    borders = sorted(random.Random(1).sample(range(100_000), 300))
    df = spark.range(0, 100_000, 37)
    rows = df.select("id", M.part_of(F.col("id"), borders).alias("p")).collect()
    assert all(r.p == sum(b <= r.id for b in borders) for r in rows)
