import corpus_pipeline as P
from lodestone.llm import decontaminate, simhash, toxicity
from lodestone.session import materialise

SF = "/root/testdata/sf0.001"


def test_stages_do_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in P.STAGES:
        after = materialise(stage(spark, before, SF), name)
        rows = {r.doc_id: r for r in before.collect()}
        if name == "packing":
            assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == set(rows)
            break
        kept = {r.doc_id: r for r in after.collect()}
        assert after.columns == columns and set(kept) <= set(rows)
        if name == "toxicity":
            score = {r.doc_id: r.score for r in toxicity.scored(before, toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
            assert set(kept) == {d for d, s in score.items() if s < toxicity.TOXIC}
        elif name == "line_dedup":
            assert set(kept) == set(rows) and any(len(kept[d].text) < len(rows[d].text) for d in kept)
            assert all(kept[d].n_chars == len(kept[d].text) for d in kept)
        elif name == "near_duplicates":
            found = simhash.near_duplicates(before).collect()
            assert set(kept) == {r.component_id for r in found}
        elif name == "decontamination":
            leaks = {r.doc_id for r in decontaminate.leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert set(kept) == set(rows) - leaks
        before = after


def test_one_row_of_each_group_stays(spark):
    rows = [(3, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "y"), (None, "q r s t", "z"), (None, "q r s t", "z"), (None, "a b c d", "w"), (7, None, "n"), (8, "", "m")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _mark string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in simhash.keep_one(docs).collect())
    assert got == [(-1, "q r s t"), (1, "a b c d"), (7, None)] or got == [(-1, "q r s t"), (1, "a b c d"), (7, "")]
