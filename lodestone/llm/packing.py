"""Hierarchical multi-length packing of documents into token sequences."""

from __future__ import annotations

import bisect
from array import array
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from lodestone.llm.rows import memo, slices, task_base, texts

#: Context sizes, longest first; each is a power of two, so that a full window needs no padding.
TIERS = (2048, 1024, 512, 256)
#: Tokens that one task holds before it packs them.
BLOCK_TOKENS = 1_000_000
#: Token budget of a step group; a group holds windows of one tier.
STEP_TOKENS = 8 * 2048
END_ID = 1
#: Words whose ids a worker remembers: those of the last one to two times so many distinct words.
REMEMBER = 200_000
#: Longest word that is remembered.
WORD = 48
#: Bytes as the characters that a byte-level vocabulary writes them with: visible Latin-1 stands for itself, the
#: others follow from 256 on.
_VISIBLE = [b for b in range(256) if chr(b).isprintable() and chr(b) != " "]
_LETTER = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_VISIBLE))}


class Ids:
    """Token ids as little-endian unsigned 32-bit bytes, as the tokenizers library gives them for a byte-level
    vocabulary in JSON without a normalizer, whose pre-tokens `pattern` matches.

    No pre-token spans a single space between two words, so that words are encoded once each and remembered, and so
    are the pre-tokens of words. Texts with added tokens' strings or other spaces go to the library as a whole.
    """

    def __init__(self, path: str, pattern: str):
        self.coder = Tokenizer.from_file(path)
        self.model = self.coder.model
        self.split = regex.compile(pattern).findall
        self.added = [t.content for t in self.coder.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.coder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, w: str) -> bytes:
        """The ids of a word with the space before it, if any, that is not in `known`."""
        ids = self.before.get(w)
        if ids is None:
            parts = None if w[1:].isalpha() and w[0] == " " else self.split(w)  # a space and letters are one pre-token
            if parts is None or len(parts) == 1:
                found = self.model.tokenize(w.encode().decode("latin-1").translate(_LETTER))
                ids = array("I", [t.id for t in found]).tobytes()
            else:
                ids = b"".join([self.known.get(x) or self.word(x) for x in parts])
        if len(w) <= WORD:
            if len(self.known) >= REMEMBER:
                self.before, self.known = self.known, {}
            self.known[w] = ids
        return ids

    def of(self, text: str) -> bytes:
        if not text or "  " in text or text[-1] == " " or text[0] == " " or "\0" in text or any(t in text for t in self.added):
            return self.encode(text)
        return b"".join([self.known.get(w) or self.word(w) for w in text.replace(" ", "\0 ").split("\0")])


_loaded: dict[tuple[str, str], Ids] = {}
memo("packing", _loaded.clear)


def loaded(path: str, pattern: str) -> Ids:
    """One coder a worker process, kept over tasks."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Ids(path, pattern)
    return _loaded[path, pattern]


@dataclass(order=True)
class Piece:
    """length tokens of a document from start on; doc is its place in the block."""

    doc: int
    start: int
    length: int


@dataclass
class Window:
    tier: int
    pieces: list[Piece] = field(default_factory=list)

    @property
    def cost(self) -> int:
        """Attention cost when pieces attend within themselves only."""
        return sum(p.length * p.length for p in self.pieces)


class Pool:
    """Pieces by length: the longest of at most a given length, or the shortest above it."""

    def __init__(self) -> None:
        self.by_length: dict[int, deque[Piece]] = defaultdict(deque)
        self.lengths: list[int] = []

    def add(self, piece: Piece) -> None:
        if not self.by_length[piece.length]:
            bisect.insort(self.lengths, piece.length)
        self.by_length[piece.length].append(piece)

    def take(self, length: int) -> Piece:
        found = self.by_length[length].popleft()
        if not self.by_length[length]:
            self.lengths.remove(length)
        return found

    def at_most(self, length: int) -> Piece | None:
        k = bisect.bisect_right(self.lengths, length)
        return self.take(self.lengths[k - 1]) if k else None

    def above(self, length: int) -> Piece | None:
        k = bisect.bisect_right(self.lengths, length)
        return self.take(self.lengths[k]) if k < len(self.lengths) else None


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> tuple[list[Window], list[Piece]]:
    """Full windows over documents of these token counts, and the pieces that were too few for another window."""
    return pack_pieces((Piece(doc, 0, n) for doc, n in enumerate(lengths)), tiers)


def pack_pieces(pieces: Iterable[Piece], tiers: tuple[int, ...] = TIERS) -> tuple[list[Window], list[Piece]]:
    """Full windows over these pieces, and the pieces that were too few for another window.

    Whole longest-tier windows are cut from long pieces. What remains of each is routed to the smallest tier that
    holds it. Tiers are packed longest first: the longest piece opens a window, its gap is filled with the longest
    pieces of shorter tiers that fit, and what is left is closed with a cut from the next longer piece, whose rest
    is routed again.
    """
    windows: list[Window] = []
    pool = Pool()
    longest = tiers[0]
    for p in pieces:
        at, end = p.start, p.start + p.length
        while end - at >= longest:
            windows.append(Window(longest, [Piece(p.doc, at, longest)]))
            at += longest
        if end > at:
            pool.add(Piece(p.doc, at, end - at))
    rest: list[Piece] = []
    for k, tier in enumerate(tiers):
        floor = tiers[k + 1] if k + 1 < len(tiers) else 0
        while pool.lengths and pool.lengths[-1] > floor:
            window, gap = Window(tier), tier
            while gap:
                piece = pool.at_most(gap) if window.pieces else pool.take(pool.lengths[-1])
                if piece is None and (piece := pool.above(gap)) is not None:
                    pool.add(Piece(piece.doc, piece.start + gap, piece.length - gap))
                    piece = Piece(piece.doc, piece.start, gap)
                if piece is None:
                    break
                window.pieces.append(piece)
                gap -= piece.length
            if gap:
                rest += window.pieces
            else:
                windows.append(window)
    return windows, sorted(rest)


def close(rest: list[Piece]) -> list[Window]:
    """The last pieces of a task as windows of falling powers of two, so that they need no padding either."""
    total = sum(p.length for p in rest)
    windows: list[Window] = []
    todo = deque(rest)
    for size in (1 << k for k in range(total.bit_length() - 1, -1, -1)):
        while total >= size:
            window, gap = Window(size), size
            while gap:
                piece = todo.popleft()
                if piece.length > gap:
                    todo.appendleft(Piece(piece.doc, piece.start + gap, piece.length - gap))
                    piece = Piece(piece.doc, piece.start, gap)
                window.pieces.append(piece)
                gap -= piece.length
            windows.append(window)
            total -= size
    return windows


def step_groups(windows: list[Window], step_tokens: int = STEP_TOKENS) -> dict[int, int]:
    """Window place -> group. The windows of a tier are dealt to as few groups of at most step_tokens as hold them,
    back and forth by falling cost, so that the groups of a tier are within one window of equal tokens and have
    about equal costs. `whole_groups` first leaves only windows that fill their groups."""
    groups: dict[int, int] = {}
    base = 0
    for tier in sorted({w.tier for w in windows}, reverse=True):
        places = sorted((k for k, w in enumerate(windows) if w.tier == tier), key=lambda k: (-windows[k].cost, k))
        count = -(-len(places) * tier // step_tokens)
        for turn, k in enumerate(places):
            lap, seat = divmod(turn, count)
            groups[k] = base + (seat if lap % 2 == 0 else count - 1 - seat)
        base += count
    return groups


def whole_groups(windows: list[Window], step_tokens: int = STEP_TOKENS) -> tuple[list[Window], list[Piece]]:
    """The windows that fill whole groups of their tier, and the pieces of the others, which are packed again."""
    kept, rest = [], []
    left = {tier: sum(w.tier == tier for w in windows) for tier in {w.tier for w in windows}}
    left = {tier: n - n % max(1, step_tokens // tier) for tier, n in left.items()}
    for w in windows:
        left[w.tier] -= 1
        if left[w.tier] >= 0:
            kept.append(w)
        else:
            rest += w.pieces
    return kept, joined(rest)


def joined(pieces: list[Piece]) -> list[Piece]:
    """Pieces with those that follow each other in a document made one."""
    found: list[Piece] = []
    for p in sorted(pieces):
        if found and found[-1].doc == p.doc and found[-1].start + found[-1].length == p.start:
            found[-1] = Piece(p.doc, found[-1].start, found[-1].length + p.length)
        else:
            found.append(p)
    return found


@dataclass
class Doc:
    """What a block holds of a document: its id, its tokens in all, and the ids of tokens from first on."""

    doc_id: object
    tokens: int
    first: int
    ids: bytes

    def part(self, start: int, length: int) -> bytes:
        return self.ids[4 * (start - self.first) : 4 * (start - self.first + length)]


def packed(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: tuple[int, ...] = TIERS,
    block_tokens: int = BLOCK_TOKENS,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset, tier, step_group.

    Every task packs its own rows in blocks of at most about block_tokens, without a shuffle; a longer document
    is cut into windows on its own. What a block leaves over goes to the next one. Step groups hold windows of one
    tier and step_tokens tokens each; the last of a task holds what is left, in windows of its longest tier and
    of falling powers of two. A null text is empty and gives the end id alone; repeated rows and rows with a null
    id are packed as often as they occur, apart from each other. An empty table gives no row. sequence_id and
    step_group are numbered within ranges that belong to the task.
    """

    def rows(windows: list[Window], groups: dict[int, int], block: list[Doc], at: int, group_at: int) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(windows), 256):
            out: list[tuple] = []
            for k in range(a, min(len(windows), a + 256)):
                offset = 0
                for p in windows[k].pieces:
                    doc = block[p.doc]
                    out.append((doc.doc_id, p.start, p.length, doc.part(p.start, p.length), doc.tokens, at + k, offset, windows[k].tier, group_at + groups[k]))
                    offset += p.length
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = loaded(path, pattern), np.array([END_ID], "<u4").tobytes()
        sequences = group = task_base()
        block: list[Doc] = []
        todo: list[Piece] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequences, group, block, todo, held
            windows, rest = pack_pieces(todo, tiers)
            windows, more = whole_groups(windows, step_tokens)
            groups = step_groups(windows, step_tokens)
            yield from rows(windows, groups, block, sequences, group)
            sequences, group = sequences + len(windows), group + len(set(groups.values()))
            # the documents of what is left move to the front of the next block, cut to it
            left = joined(rest + more)
            block, todo = [Doc(d.doc_id, d.tokens, p.start, d.part(p.start, p.length)) for p in left for d in [block[p.doc]]], [Piece(k, p.start, p.length) for k, p in enumerate(left)]
            held = sum(p.length for p in left)

        for batch in slices("packing", batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids = coder.of(text) + end
                block.append(Doc(doc_id, len(ids) // 4, 0, ids))
                todo.append(Piece(len(todo), 0, len(ids) // 4))
                held += len(ids) // 4
                if held >= block_tokens:
                    yield from flush()
        if todo:
            yield from flush()
            windows, rest = pack_pieces(todo, tiers[:1])
            size, tail = max(1, step_tokens // tiers[0]), close(rest)
            steps = [windows[a : a + size] for a in range(0, len(windows), size)]
            if steps and len(steps[-1]) < size:
                steps[-1] += tail
            elif tail:
                steps.append(tail)
            for some in steps:
                yield from rows(some, dict.fromkeys(range(len(some)), 0), block, sequences, group)
                sequences, group = sequences + len(some), group + 1

    kind = docs.schema[id_col].dataType
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
    arrow = [to_arrow_type(kind), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    schema = f"doc_id {kind.simpleString()}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group bigint"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
