import random
import re
from collections import defaultdict

from lodestone.llm import line_dedup as L


def brute(docs):
    rows = []
    nodes = defaultdict(set)
    for d, t in docs:
        for pos, line in enumerate((t or "").split("\n")):
            w = ["<*>" if re.search("[0-9]", x) else x for x in line.split()]
            if w:
                nodes[len(w), *w[:2]].add(tuple(w))
                rows.append((d, t or "", pos, w))
    keys = defaultdict(list)
    for d, t, pos, w in rows:
        n = len(w)
        keys["all", tuple(w)].append((d, pos, t, n))
        if n >= 12 and len(nodes[n, *w[:2]]) > 1:
            width = -(-(n - 2) // 5)
            for b in range(5):
                keys["open", b, n, tuple(w[: 2 + b * width]), tuple(w[2 + (b + 1) * width :])].append((d, pos, t, n))
    drops = set()
    for found in keys.values():
        n = found[0][3]
        if len({t for _, _, t, _ in found}) >= (2 if n >= 20 else 3 if n >= 6 else 10):
            _, pos0, t0, _ = min(found, key=lambda x: (x[0], x[1]))
            drops |= {(d, pos) for d, pos, t, _ in found if (t, pos) != (t0, pos0)}
    return drops


def planted(seed=0):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefg") * rng.randrange(1, 4)
    lines = [" ".join(word() for _ in range(n)) for n in (1, 3, 8, 8, 25, 60)]
    docs = []
    for d in range(120):
        own = [" ".join(word() for _ in range(rng.randrange(0, 30))) for _ in range(rng.randrange(1, 8))]
        for line in lines:
            if rng.random() < 0.3:
                own.insert(rng.randrange(len(own) + 1), line)
        own.append(f"  posted on {d} at {rng.randrange(99)}:00 by the user {word()} of this forum under the license x\t")
        docs.append((d, "\n".join(own)))
    return docs + [(200 + d, t) for d, t in docs[:10]] + [(300, None), (301, ""), (302, "\n\n")]


def test_dropped_lines_match_brute_force(spark):
    docs = planted()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'k' as key", "1 as pos", "2 as dropped").repartition(3)
    want = brute(docs)
    rows = {r.doc_id: r for r in L.drop_recurring_lines(df).collect()}
    assert {(d, p) for d, r in rows.items() for p in r.dropped} == want and want
    for d, t in docs:
        kept = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in want)
        assert rows[d].text == kept and rows[d].n_lines == len((t or "").split("\n"))


def test_repeated_rows_null_ids_and_empty(spark):
    long = " ".join(f"w{chr(97 + i)}" for i in range(25))
    docs = [(1, f"{long}\none"), (1, f"{long}\none"), (None, f"two\n{long}"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert sorted((r.text or "") for r in L.drop_recurring_lines(df).collect()) == sorted(["", f"{long}\none", f"{long}\none", "two"]) or sorted((r.text or "") for r in L.drop_recurring_lines(df).collect()) == sorted(["", "one", "one", f"two\n{long}"])
    assert L.drop_recurring_lines(df.limit(0)).count() == 0
