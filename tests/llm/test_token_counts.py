import random

import public_tokenizers
import pytest
import sentencepiece

from lodestone.llm import token_counts as T

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BITS = ["the", "été", "x1", "don't", "a\nb", "\n", "", " ", "  ", "\t", "<s>", "</s>", "<unk>", "<0x0A>", "日本語", "12345", "!?", "▁", "a▁b", "🙂", "\r\n", "\x00", " "]


def texts(n=250, seed=1):
    rng = random.Random(seed)
    return [rng.choice(["", " "]).join(rng.choice(BITS) for _ in range(rng.choice([0, 1, 2, 5, 60, 400]))) for _ in range(n)]


@pytest.mark.parametrize("head", [0, 30, 100_000])
def test_counts_equal_the_library(spark, head):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = list(enumerate([*texts(), "", " ", "\n", "  ", "a ", "▁", None, "word " * 9000, "z" * 20_000]))
    docs += docs[:5] + [(None, "null id")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' as pre_token", "7 as pieces").repartition(3)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in T.token_counts(df, MODEL, head=head).collect())
    want = sorted((d if d is not None else -1, len((t or "").encode()), len(library.encode(t or ""))) for d, t in docs)
    assert got == want


def test_empty_table(spark):
    assert T.token_counts(spark.createDataFrame([], "doc_id bigint, text string"), MODEL).count() == 0
