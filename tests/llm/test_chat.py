import hashlib
import random

import pytest

from lodestone.llm import chat as C
from lodestone.llm import queries as Q

BITS = ["<|turn:user|>\n", "<|end|>\n", "<\\|", "<\\\\|end|>", "</s>[INST] ok [/INST]", "é🙂", "\n", "", " ", "|>", "<", "%7C>", "\\"]


def turns(seed=0, convs=60):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        start = 1 if c % 3 else 0
        for t in range(start, rng.choice([1, 2, 5, 40])):
            role = "system" if t == 0 and c % 2 == 0 else rng.choice(["user", "assistant", "tool|>%", None, "a<|b"]) if c % 5 == 0 else ("user", "assistant")[t % 2]
            rows.append((c, t, role, None if rng.random() < 0.05 else "".join(rng.choice(BITS) * rng.randrange(1, 9) for _ in range(rng.randrange(0, 20)))))
    return rows


@pytest.mark.parametrize("budget,history", [(2048, 512), (60, 30), (20, 0)])
def test_digests_match_the_rows(spark, budget, history):
    rows = turns()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as window", "'x' as loss")
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted((t, role or "", text or "") for cc, t, role, text in rows if cc == c)
        loss = "".join(x for _, r, x in own if r == "assistant")
        want[c] = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in Q.chat_digest(df, budget, history).collect()}
    assert got == want


def test_windows_keep_the_budget_repeat_history_and_the_system_turn(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, t, ("assistant", "user")[t % 2], f"turn {t} " + "x" * 80) for t in range(1, 30)] + [(1, 30, "user", "y" * 2000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    windows = sorted(C.formatted(df, 120, 40).collect(), key=lambda w: w.window)
    assert len(windows) > 5 and all(C.read_back(w.formatted)[0][0] == "system" for w in windows)
    assert all(w.tokens <= 120 for w in windows[:-1]) and windows[-1].tokens > 120
    assert all(w.repeated == 2 for w in windows[1:-1])
    for a, b in zip(windows, windows[1:-1]):
        assert C.read_back(a.formatted)[-1][:2] == C.read_back(b.formatted)[1][:2]


def test_ties_nulls_and_empty(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    rows = [(None, 1, "user", "a"), (None, 1, "user", "a"), (None, None, None, None), (2, 1, "assistant", "b"), (2, 1, "assistant", "a")]
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in Q.chat_digest(spark.createDataFrame(rows, schema)).collect()}
    assert got == {None: (3, 0), 2: (2, 2)}
    assert Q.chat_digest(spark.createDataFrame([], schema)).count() == 0


def test_escapes_are_reversible():
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice(["<", "\\", "|", ">", "x", "%", "7C>"]) for _ in range(rng.randrange(12)))
        assert C.unescape(C.escape(t)) == t and "<|" not in C.escape(t)
        assert C.unguarded(C.guarded(t)) == t and "|>" not in C.guarded(t)


@pytest.mark.parametrize("budget,history", [(2048, 512), (120, 40)])
def test_the_oracle_agrees(spark, budget, history):
    from tests.oracle import oracle_rows, rows_of

    sf = "/root/testdata/sf0.001"
    more = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id bigint, turn bigint, role string, text string")
    found = Q.chat_digest(spark.read.parquet(f"{sf}/conversations.parquet").select(more.columns).unionByName(more), budget, history)
    _, want = oracle_rows(sf, Q.ESTIMATED_WINDOWS.replace("2048", str(budget)).replace("512)", f"{history})"))
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == want


def brute_windows(coder, own, budget, history):
    """(turns repeated, turns new) of each window, by trying every start and end."""
    size = [len(coder.encode(C.Turn(r, x, 0).shown, add_special_tokens=False).ids) for r, x in own]
    system = 1 if own and own[0][0] == "system" else 0
    room = budget - sum(size[:system])
    found, a, f = [], system, system
    while f < len(own):
        g = max(e for e in range(f + 1, len(own) + 1) if e == f + 1 or sum(size[a:e]) <= room)
        found.append((a, f, g))
        if g < len(own):
            a = min(k for k in range(a, g + 1) if sum(size[k:g]) <= max(0, min(room - size[g], history)))
        f = g
    return found or [(1, 1, 1)], system, size


@pytest.mark.parametrize("budget,history", [(2048, 512), (150, 60)])
def test_windows_by_real_tokens_match_brute_force(spark, budget, history):
    import public_tokenizers
    from tokenizers import Tokenizer

    names = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    coder = Tokenizer.from_file(names[0])
    rows = turns(3, 25) + [(98, 0, "system", "be brief"), (99, 0, "user", "word " * 9000), (99, 1, "assistant", "<|endoftext|> fin ")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {}
    for w in C.formatted(df, budget, history, names).collect():
        assert w.tokens == len(coder.encode(w.formatted, add_special_tokens=False).ids)
        got.setdefault(w.conv_id, {})[w.window] = ([x[:2] for x in C.read_back(w.formatted)], w.repeated)
    for c in {r[0] for r in rows}:
        own = [x[1:] for x in sorted((t, r or "", x or "") for cc, t, r, x in rows if cc == c)]
        spans, system, size = brute_windows(coder, own, budget, history)
        assert [got[c][k] for k in range(len(got[c]))] == [(own[:system] + own[a:g], f - a + (system if k else 0)) for k, (a, f, g) in enumerate(spans)]


def test_the_query_splits_what_exceeds_the_budget(spark):
    sf = "/root/testdata/sf0.001"
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    talks = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        talks.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    talks[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in Q.op2_chat_format(spark, sf).collect()}
    assert set(got) == set(talks)
    for c, rows in talks.items():
        own = [x[1:] for x in sorted(rows)]
        spans, system, _ = brute_windows(coder, own, C.BUDGET, C.HISTORY)
        chars = sum(len(C.Turn(r, x, 0).shown) for a, _, g in spans for r, x in own[:system] + own[a:g])
        loss = "".join(x for r, x in own if r == "assistant")
        assert (got[c].n_turns, got[c].n_windows, got[c].formatted_chars, got[c].loss_chars) == (len(own), len(spans), chars, len(loss))
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
