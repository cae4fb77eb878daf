"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.rows import slices, texts

#: Hash space of the terms.
BITS = 20
#: Leading characters of a word that are terms besides the word.
STEMS = (4, 5, 6)
#: A term that occurs at least so often in a text is a term of its own for each of these numbers.
TIMES = (1, 2, 3)
#: Most labelled rows that are fitted on; beyond, a sample by hash of the id.
TRAIN_ROWS = 8000
#: Terms that the model keeps: those in at least so many fitted rows whose share differs most between the labels.
LEAST_ROWS = 4
KEPT_TERMS = 6000
FACTORS = 8
EPOCHS = 24
BATCH = 256
RATE = 0.05
DECAY = 2e-4
#: Score from which a text counts as toxic.
TOXIC = 0.7

_PUNCT = bytes(32 if chr(c) in string.punctuation else c for c in range(256))


def _hashes(words: Iterable[str], mark: str = "") -> np.ndarray:
    return (np.fromiter((xxhash.xxh64_intdigest(w + mark, len(w) if mark else 0) for w in words), np.uint64) >> np.uint64(1)).astype(np.int64)


def _stems(words: dict[str, int], size: int) -> np.ndarray:
    """Hash of the first `size` characters of each word, -1 for shorter words; each stem is hashed once."""
    cut = [w[:size] if len(w) >= size else "" for w in words]
    place = dict(zip(dict.fromkeys(cut), count()))
    found = _hashes(place, "*")
    if "" in place:
        found[place[""]] = -1
    return found[np.fromiter(map(place.__getitem__, cut), np.int64, len(cut))]


def terms_of(rows: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of the hashed terms of whole texts, each once a row, sorted: words and stems, once for each number
    of TIMES that they reach. With wanted (a flag for each term) only those.

    Texts are taken together, so that each word is hashed once for all of them.
    """
    words = [t.casefold().encode().translate(_PUNCT).decode().split() for t in rows]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for some in words for w in some]
    place = dict(zip(dict.fromkeys(flat), count()))
    table = np.stack([_hashes(place), *(_stems(place, n) for n in STEMS)], axis=1)
    known, local = np.unique(table, return_inverse=True)
    slots = [(known * (2 * n + 1) >> np.int64(17)) & ((1 << BITS) - 1) for n in TIMES]
    use = known >= 0
    if wanted is not None:
        use &= np.logical_or.reduce([wanted[s] for s in slots])
    local = np.where(use[local], local, -1).reshape(table.shape)
    found = local[np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))]
    owner = np.repeat(np.arange(len(rows), dtype=np.int64), sizes)[:, None] * np.int64(len(known) + 1)
    pairs, counts = np.unique((owner + found)[found >= 0], return_counts=True)
    row, term = pairs // (len(known) + 1), pairs % (len(known) + 1)
    every = np.unique(np.concatenate([row[counts >= n] << BITS | s[term[counts >= n]] for n, s in zip(TIMES, slots, strict=True)]))
    row, term = every >> BITS, every & ((1 << BITS) - 1)
    if wanted is not None:
        row, term = row[wanted[term]], term[wanted[term]]
    return row, term.astype(np.int32)


@dataclass
class Machine:
    """score = sigmoid(bias + sum of weights + pairwise products of factors) over the terms of a text."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, ids: np.ndarray) -> float:
        at = np.searchsorted(self.terms, ids)
        at = at[self.terms[np.minimum(at, len(self.terms) - 1)] == ids] if len(self.terms) else at[:0]
        v = self.factors[at]
        pairs = 0.5 * (np.square(v.sum(axis=0)).sum() - np.square(v).sum()) if len(at) else 0.0
        return float(self.bias + self.weights[at].sum() + pairs)

    def wanted(self) -> np.ndarray:
        """A flag for each hashed term: whether the machine knows it."""
        found = np.zeros(1 << BITS, bool)
        found[self.terms] = True
        return found

    def scores(self, rows: list[str], wanted: np.ndarray) -> np.ndarray:
        """Scores of texts; wanted as above, which the caller holds over batches."""
        row, term = terms_of(rows, wanted)
        at = np.searchsorted(self.terms, term)
        sums = lambda x: np.bincount(row, weights=x, minlength=len(rows))
        factors = self.factors[at]
        raw = self.bias + sums(self.weights[at]) - 0.5 * sums(np.square(factors).sum(axis=1))
        for k in range(factors.shape[1]):
            raw = raw + 0.5 * np.square(sums(factors[:, k]))
        return 1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30)))


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """Fit by Adam on logistic loss. Without rows of both labels the model has the prior alone."""
    y = np.asarray(labels, np.float64)
    prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else -3.0
    nothing = Machine(np.zeros(0, np.int32), prior, np.zeros(0), np.zeros((0, FACTORS)))
    if not len(y) or y.min() == y.max():
        return nothing
    # counted and cut down in parts, so that the driver never holds all terms of all rows twice
    df, pos = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for a in range(0, len(rows), BATCH):
        df += np.bincount(np.concatenate(rows[a : a + BATCH]), minlength=1 << BITS)
        if toxic := [r for r, t in zip(rows[a : a + BATCH], y[a : a + BATCH], strict=True) if t]:
            pos += np.bincount(np.concatenate(toxic), minlength=1 << BITS)
    share = df / len(y)
    lift = (pos - df * y.mean()) / np.sqrt(np.maximum(df * y.mean() * (1 - y.mean()) * (1 - share), 1e-9))
    lift[df < LEAST_ROWS] = 0
    kept = np.sort(np.argsort(-np.abs(lift), kind="stable")[:KEPT_TERMS])
    kept = kept[np.abs(lift[kept]) > 2]
    if not len(kept):
        return nothing
    slot = np.full(1 << BITS, -1, np.int32)
    slot[kept] = np.arange(len(kept))
    found = [s[s >= 0] for s in (slot[r] for r in rows)]
    starts = np.concatenate(([0], np.cumsum([len(s) for s in found])))
    cols = np.concatenate(found)
    rng = np.random.default_rng(seed)
    m = len(kept)
    theta = np.concatenate((np.zeros((m, 1)), rng.normal(0, 0.02, (m, FACTORS))), axis=1)
    bias = np.array([prior])
    first, second, b1, b2, t = np.zeros_like(theta), np.zeros_like(theta), np.zeros(2), np.zeros(2), 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // BATCH)):
            t += 1
            spans = [np.arange(starts[r], starts[r + 1]) for r in batch]
            n = np.array([len(s) for s in spans])
            at = np.concatenate(spans)
            own, c = np.repeat(np.arange(len(batch)), n), cols[at]
            part = theta[c]
            sums = np.stack([np.bincount(own, weights=part[:, k], minlength=len(batch)) for k in range(1 + FACTORS)], axis=1)
            squares = np.bincount(own, weights=np.square(part[:, 1:]).sum(axis=1), minlength=len(batch))
            raw = bias[0] + sums[:, 0] + 0.5 * (np.square(sums[:, 1:]).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[batch]) / len(batch)
            each = np.concatenate((np.ones((len(c), 1)), sums[own, 1:] - part[:, 1:]), axis=1) * error[own, None]
            used, inverse = np.unique(c, return_inverse=True)
            grad = np.stack([np.bincount(inverse, weights=each[:, k], minlength=len(used)) for k in range(1 + FACTORS)], axis=1) + DECAY * theta[used]
            first[used] = 0.9 * first[used] + 0.1 * grad
            second[used] = 0.999 * second[used] + 0.001 * grad * grad
            theta[used] -= rate * (first[used] / (1 - 0.9**t)) / (np.sqrt(second[used] / (1 - 0.999**t)) + 1e-6)
            g = error.sum()
            b1[0], b2[0] = 0.9 * b1[0] + 0.1 * g, 0.999 * b2[0] + 0.001 * g * g
            bias[0] -= rate * (b1[0] / (1 - 0.9**t)) / (np.sqrt(b2[0] / (1 - 0.999**t)) + 1e-6)
    return Machine(kept.astype(np.int32), float(bias[0]), theta[:, 0], theta[:, 1:])


def held_out(doc_id: Column) -> Column:
    """Whether a row is never learned from: crc32 of the id as text has remainder 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = TRAIN_ROWS) -> Machine:
    """Fit on the labelled rows that are not held out, about most_rows of them at most, chosen by hash of the id.

    Null labels and null ids are left out; of an id with several labels the largest counts.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    count = known.count()
    share = int(min(1.0, most_rows / max(1, count)) * (1 << 30))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices("toxicity", batches, 1):
            row, term = terms_of(texts(b.column(1)))
            found = [x.tobytes() for x in np.split(term, np.searchsorted(row, np.arange(1, b.num_rows)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary()), b.column(2)], names=["doc_id", "ids", "toxic"])

    kinds = docs.schema["doc_id"].dataType.simpleString(), labels.schema["toxic"].dataType.simpleString()
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    rows = picked.mapInArrow(run, f"doc_id {kinds[0]}, ids binary, toxic {kinds[1]}").toPandas()
    rows = rows.sort_values(["doc_id", "ids"], kind="stable")
    return fit([np.frombuffer(x, np.int32) for x in rows["ids"]], rows["toxic"].to_numpy() > 0)


def scored(docs: DataFrame, model: Machine) -> DataFrame:
    """(doc_id, score) for each row; a null text is empty and scores as one."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value.wanted()
        for b in slices("toxicity", batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.scores(texts(b.column(1)), wanted))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, score double")


def drop_toxic(docs: DataFrame, model: Machine, limit: float = TOXIC) -> DataFrame:
    """docs without the rows that score at least `limit`; all columns stay as they are.

    A null or empty text has no terms and scores by the prior alone; rows with null ids and repeated rows are each
    judged by their own text; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value.wanted()
        for b in slices("toxicity", batches, place):
            yield b.filter(pa.array(sent.value.scores(texts(b.column(place)), wanted) < limit))

    return docs.mapInArrow(run, docs.schema)
