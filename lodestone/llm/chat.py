"""Chat formatting in budgeted, turn-aligned windows with a loss mask."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.llm.packing import Ids
from lodestone.llm.rows import memo, slices

#: Token budget of a window, and the part of it that repeated history may take.
BUDGET = 2048
HISTORY = 512
#: Shuffle partitions are sized by the session; a conversation streams through one of them turn by turn.
TURN = re.compile(r"<\|turn:(.*?)\|>\n(.*?)<\|end\|>\n", re.S)
END = "<|end|>\n"


def escape(text: str) -> str:
    """text without the template's marks: each `<`, backslashes, `|` gets one backslash more."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<" in text else text


def guarded(role: str) -> str:
    """A role as it stands in a turn's mark, which ends at the first `|>`."""
    return escape(role).replace("%", "%25").replace("|>", "%7C>") if "%" in role or "|>" in role or "<" in role else role


def unguarded(role: str) -> str:
    return unescape(role.replace("%7C>", "|>").replace("%25", "%")) if "%" in role or "<" in role else role


@dataclass
class Turn:
    role: str
    text: str
    tokens: int
    head: str = field(init=False)
    body: str = field(init=False)

    def __post_init__(self) -> None:
        self.head, self.body = f"<|turn:{guarded(self.role)}|>\n", escape(self.text)

    @property
    def shown(self) -> str:
        return self.head + self.body + END


@dataclass
class Windows:
    """The windows of one conversation, built while its turns stream by; holds at most a budget of turns."""

    budget: int = BUDGET
    history: int = HISTORY
    number: int = 0
    seen: int = 0
    system: Turn | None = None
    turns: list[Turn] = field(default_factory=list)
    #: Prefix sums of the held turns' tokens; the first `repeated` turns are history.
    sums: list[int] = field(default_factory=lambda: [0])
    repeated: int = 0

    def add(self, turn: Turn) -> Iterator[dict]:
        if self.seen == 0 and turn.role == "system":
            self.system = turn
            self.turns, self.sums, self.repeated = [], [0], 0
        else:
            room = self.budget - (self.system.tokens if self.system else 0)
            if len(self.turns) > self.repeated and self.sums[-1] + turn.tokens > room:
                yield self.window()
                self.keep(room - turn.tokens)
            elif self.sums[-1] + turn.tokens > room:
                self.drop(room - turn.tokens)
            self.turns.append(turn)
            self.sums.append(self.sums[-1] + turn.tokens)
        self.seen += 1

    def keep(self, room: int) -> None:
        """The longest run of last turns within the history's and the next turn's budget becomes history."""
        self.repeated = len(self.turns)
        self.drop(min(room, self.history))

    def drop(self, room: int) -> None:
        first = next(k for k in range(len(self.sums)) if self.sums[-1] - self.sums[k] <= max(0, room))
        base = self.sums[first]
        self.turns, self.sums, self.repeated = self.turns[first:], [x - base for x in self.sums[first:]], self.repeated - first

    def window(self) -> dict:
        """Formatted text, code point spans of the loss, the turns repeated in front, and tokens."""
        again = self.number > 0
        shown = ([self.system] if self.system else []) + self.turns
        repeated = self.repeated + (1 if self.system and again else 0)
        parts, spans, at = [], [], 0
        for k, t in enumerate(shown):
            parts += [t.head, t.body, END]
            start = at + len(t.head)
            if k >= repeated and t.role == "assistant":
                spans.append((start, start + len(t.body)))
            at = start + len(t.body) + len(END)
        self.number += 1
        return {"window": self.number - 1, "formatted": "".join(parts), "loss": spans, "repeated": repeated, "tokens": self.sums[-1] + (self.system.tokens if self.system else 0)}

    def end(self) -> Iterator[dict]:
        if len(self.turns) > self.repeated or (self.system and self.number == 0):
            yield self.window()


_loaded: dict[tuple[str, str], Ids] = {}
memo("chat format", _loaded.clear)


def counted(turns: DataFrame, tokenizer: tuple[str, str] | None) -> DataFrame:
    """turns (conv_id, turn, role, text) with the column tokens, counted before anything is shuffled.

    tokenizer is (path of a byte-level vocabulary in JSON, its pre-token pattern); a turn is counted as it stands in
    a window, marks and escapes included. As every turn ends in a line feed before a `<`, where pre-tokens are cut,
    the counts of a window's turns add up to the window's. Without a tokenizer, tokens are estimated as a quarter of
    the text's UTF-8 bytes and four for the marks.
    """
    if tokenizer is None:
        size = F.octet_length(F.coalesce("text", F.lit("")))
        return turns.withColumn("tokens", F.lit(4) + F.ceil(size / 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices("chat format", batches, 3):
            if tokenizer not in _loaded:
                _loaded[tokenizer] = Ids(*tokenizer)
            ids = _loaded[tokenizer].of
            sizes = [len(ids(Turn(role or "", text or "", 0).shown)) // 4 for role, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int64())], names=[*b.schema.names, "tokens"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in turns.schema)
    return turns.mapInArrow(run, f"{kinds}, tokens bigint")


def formatted(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """One row per window of each conversation: conv_id, window, formatted, loss (spans of code points), repeated, tokens.

    Tokens are those of the tokenizer, or estimated without one (`counted`). Windows hold whole turns up to the budget; a turn that exceeds it has a window of its own. The system turn, if
    it is a conversation's first, stands in front of every window, and the last turns of the window before are
    repeated within `history` tokens; only text of assistant turns that no earlier window showed is under the loss.
    Turns are ordered by turn, role and text, nulls first; null roles and texts are empty; rows with a null
    conv_id are one conversation. A conversation streams through its task and is never held as a whole.
    """
    kind = turns.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held, size = None, 0

        def batch() -> pa.RecordBatch:
            cols = list(zip(*[(c, w["window"], w["formatted"], w["loss"], w["repeated"], w["tokens"]) for c, w in out], strict=True))
            spans = pa.array([[{"start": a, "end": b} for a, b in x] for x in cols[3]], types[3])
            return pa.RecordBatch.from_arrays([spans if k == 3 else pa.array(c, t) for k, (c, t) in enumerate(zip(cols, types, strict=True))], names=names)

        for b in slices("chat format", batches, 2):
            for conv, role, text, tokens in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
                if held is None or conv != held[0]:
                    if held:
                        out += [(held[0], w) for w in held[1].end()]
                    held = (conv, Windows(budget, history))
                for w in held[1].add(Turn(role or "", text or "", tokens)):
                    out.append((conv, w))
                    size += len(w["formatted"])
                if size > 4_000_000:
                    yield batch()
                    out, size = [], 0
        if held:
            out += [(held[0], w) for w in held[1].end()]
        if out:
            yield batch()

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = ["conv_id", "window", "formatted", "loss", "repeated", "tokens"]
    types = [to_arrow_type(kind), pa.int64(), pa.string(), span, pa.int64(), pa.int64()]
    schema = f"conv_id {kind.simpleString()}, window bigint, formatted string, loss array<struct<start:bigint,end:bigint>>, repeated bigint, tokens bigint"
    sized = counted(turns.select("conv_id", "turn", "role", "text"), tokenizer)
    dealt = sized.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text", "tokens").mapInArrow(run, schema)


def read_back(window: str) -> list[tuple[str, str, int]]:
    """(role, text, start of the escaped text) of the turns in a formatted window."""
    return [(unguarded(m[1]), unescape(m[2]), m.start(2)) for m in TURN.finditer(window)]


