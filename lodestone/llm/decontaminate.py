"""Benchmark decontamination by SimHash windows, multi-index Hamming blocks and weighted-shingle similarity."""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.llm.rows import memo, slices, texts

#: Words of a shingle, and the similarity from which a window counts as a copy of an item.
SHINGLE = 5
THRESHOLD = 0.8
#: Hamming radius. Two windows of some 25 shingles at the threshold differ in 10 bits on average, with a deviation
#: of 3; farther windows of that similarity are about 3 in 100, and fewer the longer or the more alike they are.
RADIUS = 15
#: Index blocks of 16 bits; one of them differs in at most RADIUS // 4 bits.
HAMMING_BLOCKS = 4
#: Items searched in one pass over the documents; more items take more passes.
ITEMS_AT_ONCE = 5000
#: Shingles of a document that are looked at together.
CHUNK = 1 << 16

_PUNCT = bytes(32 if chr(c) in string.punctuation else c for c in range(256))
_P = np.uint64(0x9E3779B185EBCA87)
_SEEN_BITS = 22


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the text's shingles, in order, and of its words: case folded, punctuation of ASCII taken as spaces."""
    words = text.casefold().encode("utf-8", "replace").translate(_PUNCT).split()
    total = len(words) - SHINGLE + 1
    if total < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    s = h[:total].copy()
    for k in range(1, SHINGLE):
        s = s * _P + h[k : k + total]
    s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    return s ^ (s >> np.uint64(32)), h


def weights(h: np.ndarray) -> np.ndarray:
    """Weight of each shingle over these words: the share of its words that are distinct."""
    total = len(h) - SHINGLE + 1
    new = [np.logical_and.reduce([h[k : k + total] != h[j : j + total] for j in range(k)]) if k else np.ones(total, bool) for k in range(SHINGLE)]
    return np.sum(new, axis=0) / SHINGLE


def window_prints(s: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each window of `size` shingles of s."""
    bits = np.unpackbits(s.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))
    return packed_signs(sums, size)


def packed_signs(sums: np.ndarray, size: int) -> np.ndarray:
    ones = sums[size:] - sums[:-size]
    return np.packbits(ones * 2 > size, axis=1, bitorder="little").view("<u8").ravel()


def masks(bits: int, upto: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for r in range(upto + 1) for c in combinations(range(bits), r)], np.uint64)


class Items:
    """The benchmark's items of one pass: fingerprints in a multi-index, shingle counts and weights."""

    def __init__(self, items: list[tuple[object, str]], radius: int = RADIUS, threshold: float = THRESHOLD):
        self.radius, self.threshold = radius, threshold
        found = [(i, *both) for i, t in items if len((both := shingles(t or ""))[0])]
        self.ids = [i for i, _, _ in found]
        self.sizes = np.array([len(s) for _, s, _ in found], np.int64)
        self.counts = [Counter(s.tolist()) for _, s, _ in found]
        self.weight = {x: w for _, s, h in found for x, w in zip(s.tolist(), weights(h).tolist(), strict=True)}
        self.totals = [sum(self.weight[x] * n for x, n in c.items()) for c in self.counts]
        self.all = np.array(sorted(self.weight), np.uint64)
        #: Items of the shingle at k of all: owners[starts[k]:starts[k + 1]].
        place = np.concatenate([np.searchsorted(self.all, np.unique(s)) for _, s, _ in found]) if found else np.zeros(0, np.int64)
        self.owners = np.repeat(np.arange(len(found)), [len(c) for c in self.counts]).astype(np.int32)[np.argsort(place, kind="stable")]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(place, minlength=len(self.all)))))
        self.seen = np.zeros(1 << _SEEN_BITS, bool)
        self.seen[(self.all >> np.uint64(64 - _SEEN_BITS)).astype(np.int64)] = True
        self.prints = np.array([window_prints(s, len(s))[0] for _, s, _ in found], np.uint64)
        width = 64 // HAMMING_BLOCKS
        near = masks(width, radius // HAMMING_BLOCKS)
        self.index = []
        for b in range(HAMMING_BLOCKS):
            values = ((self.prints >> np.uint64(width * b)) & np.uint64((1 << width) - 1))[:, None] ^ near[None, :]
            values = values.ravel().astype(np.int64)
            order = np.argsort(values, kind="stable")
            offsets = np.zeros((1 << width) + 1, np.int64)
            np.cumsum(np.bincount(values, minlength=1 << width), out=offsets[1:])
            self.index.append((offsets, (order // len(near)).astype(np.int32)))

    def similarity(self, window: np.ndarray, weight: float, item: int) -> float:
        """Weighted Jaccard of shingle counts; weight is the window's total."""
        counts = self.counts[item]
        both = sum(self.weight[x] * min(n, counts[x]) for x, n in Counter(window.tolist()).items() if x in counts)
        return both / (weight + self.totals[item] - both)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in prints, item) of all pairs within the radius."""
        width = 64 // HAMMING_BLOCKS
        found = []
        for b, (offsets, owner) in enumerate(self.index):
            v = ((prints >> np.uint64(width * b)) & np.uint64((1 << width) - 1)).astype(np.int64)
            lengths = offsets[v + 1] - offsets[v]
            place = np.repeat(np.arange(len(prints)), lengths)
            inner = np.arange(len(place)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            item = owner[np.repeat(offsets[v], lengths) + inner]
            ok = np.bitwise_count(prints[place] ^ self.prints[item]) <= self.radius
            found.append(place[ok] * len(self.ids) + item[ok])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.ids), pairs % len(self.ids)

    def search(self, text: str) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window of each item found in the text.

        A window without any shingle of any item has similarity 0; only windows that touch one are
        fingerprinted, in each size that an item has. For items longer than the text, the text is the window.
        """
        if not self.ids:
            return []
        s, h = shingles(text)
        hits = np.flatnonzero(self.seen[(s >> np.uint64(64 - _SEEN_BITS)).astype(np.int64)])
        if len(hits):
            at = np.minimum(np.searchsorted(self.all, s[hits]), len(self.all) - 1)
            known = self.all[at] == s[hits]
            hits, at = hits[known], at[known]
        best: dict[int, tuple[float, int]] = {}
        if len(hits) and len(s) < self.sizes.max():
            total = float(weights(h).sum())
            for k in np.unique(np.concatenate([self.owners[self.starts[x] : self.starts[x + 1]] for x in np.unique(at)])).tolist():
                if self.sizes[k] > len(s) and (similarity := self.similarity(s, total, k)) >= self.threshold - 1e-9:
                    best[k] = (similarity, 0)
        reach = int(self.sizes.max())
        for lo, hi in regions(hits, reach, len(s)):
            part = s[lo:hi]
            weighed = np.concatenate(([0.0], np.cumsum(weights(h[lo : hi + SHINGLE - 1]))))
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))
            for size in np.unique(self.sizes[self.sizes <= len(part)]).tolist():
                place, item = self.near(packed_signs(sums, size))
                own = self.sizes[item] == size
                for p, k in zip(place[own].tolist(), item[own].tolist(), strict=True):
                    similarity = self.similarity(part[p : p + size], weighed[p + size] - weighed[p], k)
                    if similarity >= self.threshold - 1e-9 and similarity > best.get(k, (0.0, 0))[0]:
                        best[k] = (similarity, lo + p)
        return [(k, sim, at, min(int(self.sizes[k]), len(s)) + SHINGLE - 1) for k, (sim, at) in sorted(best.items())]


def regions(hits: np.ndarray, reach: int, total: int) -> list[tuple[int, int]]:
    """Ranges of shingles that hold every window of up to `reach` shingles around a hit, cut with overlap where long."""
    found: list[list[int]] = []
    for h in hits.tolist():
        lo, hi = max(0, h - reach + 1), min(total, h + reach)
        if found and lo <= found[-1][1] and hi - found[-1][0] <= CHUNK:
            found[-1][1] = hi
        else:
            found.append([lo, hi])
    return [(a, b) for a, b in found]


def item_blocks(benchmark: DataFrame, at_once: int = ITEMS_AT_ONCE) -> Iterator[list[tuple[object, str]]]:
    """The benchmark in blocks of at most at_once items, by id; the driver holds one block at a time."""
    items = benchmark.filter("text is not null").select("item_id", "text").orderBy("item_id", "text")
    block: list[tuple[object, str]] = []
    for r in items.toLocalIterator():
        block.append((r.item_id, r.text))
        if len(block) == at_once:
            yield block
            block = []
    if block:
        yield block


_last: list = [None, None]
memo("decontamination", lambda: _last.__setitem__(slice(None), [None, None]))


def built(items: list[tuple[object, str]]) -> Items:
    """The index of these items, kept for the worker's next task of the same pass."""
    if _last[0] != items:
        _last[:] = items, Items(items)
    return _last[1]


def leaks(docs: DataFrame, benchmark: DataFrame, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, words) for each row of docs and each item that a window of it copies.

    Null texts and items of fewer than five words match nothing; repeated rows are reported as often as they occur.
    """
    kinds = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, similarity double, first_word bigint, words bigint"
    found = docs.sparkSession.createDataFrame([], schema)
    names = ["doc_id", "item_id", "similarity", "first_word", "words"]
    types = [*map(to_arrow_type, kinds), pa.float64(), pa.int64(), pa.int64()]
    for block in item_blocks(benchmark, at_once):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = built(sent.value)
            for batch in slices("decontamination", batches, 1):
                out = [(d, items.ids[k], sim, at, n) for d, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True) for k, sim, at, n in items.search(t)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        found = found.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """docs without the rows that hold a copy of an item; all columns stay as they are."""
    place = docs.columns.index("text")
    for block in item_blocks(benchmark, at_once):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = built(sent.value)
            for batch in slices("decontamination", batches, place):
                yield batch.filter(pa.array([not items.search(t) for t in texts(batch.column(place))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

