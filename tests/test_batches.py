"""What a Python worker holds of one Arrow batch, without Spark."""

import tracemalloc
from collections import Counter

import pyarrow as pa

from lodestone.operators import extract
from lodestone.plans import evidence

PAGE = "<html><body>" + '<div class="a"><p>some <b>text</b></p></div>' * 40 + "</body></html>"


def peak(rows, run):
    """Bytes of Python objects at most while the output for one batch of so many pages is read."""
    batch = pa.record_batch(rows)
    list(run(iter([batch.slice(0, 1)])))
    tracemalloc.start()
    try:
        for _ in run(iter([batch])):
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_pages_of_a_batch_are_matched_one_tree_at_a_time():
    few, many = (peak({"html": [PAGE] * n}, evidence.tag_counts) for n in (4, 80))
    assert many < 2 * few


def test_tags_are_counted_over_slices():
    pages = pa.record_batch({"html": [PAGE] * 600 + [None, ""]})
    found = {}
    for b in evidence.tag_counts(iter([pages])):
        for tag, n in zip(b["tag"].to_pylist(), b["n"].to_pylist()):
            found[tag] = found.get(tag, 0) + n
    assert found == {"html": 600, "body": 600, "div": 24000, "p": 24000, "b": 24000}


def test_evidence_of_a_batch_is_bounded_by_bytes():
    page = PAGE.replace("<p>", '<section><p><a href="/x">y</a>').replace("</p>", "</p></section>")
    rows = lambda n: {"path": [f"p{k}" for k in range(n)], "content": [page] * n, "language": ["html"] * n, "lossy": [False] * n}
    few, many = (peak(rows(n), extract.path_evidence) for n in (100, 500))
    assert many < 2 * few
    found = list(extract.path_evidence(iter([pa.record_batch(rows(500))])))
    assert len(found) > 3 and sum(b.num_rows for b in found) == 500 * len(extract.analyze(page, "html")[1])
    assert list(dict.fromkeys(p for b in found for p in b["path"].to_pylist())) == rows(500)["path"]


def test_files_of_one_path_or_none_keep_their_own_evidence(spark):
    files = [("a.html", "<h1>x</h1>", "html"), ("a.html", "<h2>y</h2><!-- c -->", "html"), (None, "<title>z</title>", "html"), ("b.bin", None, None), ("c.html", "", "html")]
    df = spark.createDataFrame([(p, t, lang, False, k) for k, (p, t, lang) in enumerate(files)], "path string, content string, language string, lossy boolean, place int")
    want = sorted((p or "", *r[:4]) for p, t, lang in files for r in extract.analyze(t, lang)[1])
    assert sorted((r.path or "", r.ord, r.key, r.kind, r.origin) for r in extract.evidence_of(df).collect()) == want
    whole = {r.place: r for r in extract.analyzed(df).collect()}
    for k, (p, t, lang) in enumerate(files):
        status, rows = extract.analyze(t, lang)
        assert (whole[k].path, whole[k].content) == (p, t) and tuple(whole[k])[5:9] == status and [tuple(r) for r in whole[k].rows] == rows


def test_evidence_queries_do_not_shuffle_texts(spark):
    made = evidence.report_evidence_kinds(spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1
    want = Counter()
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect():
        want.update((x[2], x[4]) for x in extract.analyze(r.html, "html")[1])
    assert {(r.kind, r.span_availability): r.n for r in made.collect()} == want
