import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lodestone.llm import packing as P

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
WORDS = ["the", "été", "x1", "don't", "a\nb", "\n\n", "", " ", "\t", "<|endoftext|>", "日本語", "12345", "!?", "é", "  ", "'s", " ", "²", "ⅷ", "🙂", "q\n'll\nz", "a\t\nb", "\nc", "d\n", "e\0f", "g\x1c\nh"]


def texts(n, seed=0):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 3, 50, 700]))) for _ in range(n)]


def test_ids_equal_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder = P.loaded(PATH, PATTERN)
    for t in [*texts(150), " lead", "tail ", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "a" * 30_000]:
        assert np.frombuffer(coder.of(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t[:80]


def check(rows, texts_by_id):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts_by_id)
    for doc_id, own in pieces.items():
        ids = library.encode(texts_by_id[doc_id] or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()) == zlib.crc32(r.ids)
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == own[0].tier and at & (at - 1) == 0 and at <= 2048


def test_every_id_in_one_piece_and_no_padding(spark):
    docs = dict(enumerate(texts(400, 7))) | {1000: None, 1001: "", 1002: "word " * 9000}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").selectExpr("*", "1 as ids", "2 as tier").repartition(3)
    check(P.packed(df, PATH, PATTERN, block_tokens=20_000).collect(), docs)


def test_empty_table(spark):
    assert P.packed(spark.createDataFrame([], "doc_id bigint, text string"), PATH, PATTERN).count() == 0


def test_tiers_and_step_groups():
    rng = random.Random(4)
    lengths = [rng.choice([10] * 9 + [100] * 9 + [300] * 4 + [700, 1500, 5000]) + rng.randrange(50) for _ in range(600)]
    windows, rest = P.pack(lengths)
    assert {w.tier for w in windows} == set(P.TIERS)
    assert sum(p.length for p in rest) < 2048
    assert sum(p.length for w in windows for p in w.pieces) + sum(p.length for p in rest) == sum(lengths)
    groups = P.step_groups(windows)
    tokens = defaultdict(int)
    for k, g in groups.items():
        tokens[g, windows[k].tier] += windows[k].tier
    assert len({g for g, _ in tokens}) == len(tokens) and max(tokens.values()) <= P.STEP_TOKENS


def test_step_groups_are_full_but_for_a_tasks_last(spark):
    docs = dict(enumerate(texts(500, 11)))
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(2)
    rows = P.packed(df, PATH, PATTERN, block_tokens=20_000, step_tokens=4096).collect()
    check(rows, docs)
    tokens = defaultdict(int)
    for r in rows:
        tokens[r.step_group] += r.length
    tasks = {g >> 40 for g in tokens}
    short = [g for g, n in tokens.items() if n != 4096]
    assert max(tokens.values()) == 4096 and len(short) == len({g >> 40 for g in short}) <= len(tasks) < len(tokens)
    mixed = defaultdict(set)
    for r in rows:
        mixed[r.step_group].add(r.tier)
    assert all(len(t) == 1 for g, t in mixed.items() if g not in short)


def test_repeated_rows_null_ids_and_a_very_long_text(spark):
    rows = [(1, "a b c")] * 3 + [(None, "x y"), (None, None), (2, "word\nline " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'k' as tier", "3 as sequence_id").repartition(1)
    library = Tokenizer.from_file(PATH)
    found = P.packed(df, PATH, PATTERN).collect()
    want = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r.length for r in found) == want
    assert sorted(sum(r.length for r in found if r.doc_id == k) for k in (1, None)) == sorted([3 * (len(library.encode("a b c").ids) + 1), len(library.encode("x y").ids) + 2])
