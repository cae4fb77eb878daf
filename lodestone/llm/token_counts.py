"""Token counts from pieces per distinct pre-token, without materialising ids."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.rows import memo, numbered, slices, texts
from lodestone.session import materialise

#: Most frequent pre-tokens that are sent to all tasks, and the longest that may be one: bounds the broadcast.
HEAD = 150_000
HEAD_CHARS = 48
#: Distinct pre-tokens that a task gathers before it hands them on.
GATHER = 300_000

_SPACES = re.compile(" *[^ ]+| +")


def pre_tokens(text: str) -> tuple[Counter, int]:
    """Pre-token frequencies of a text and its line feeds, each of which is one piece of its own.

    A text starts with one space more (the model's dummy prefix) and is cut before each run of spaces and
    around line feeds: no piece of the vocabulary holds another character before a space, or a line feed
    (`splits_exactly` checks both), so that no merge crosses a cut and counts add up.
    """
    if not text:
        return Counter(), 0
    if "▁" in text:
        text = text.replace("▁", " ")
    lines = (" " + text).split("\n")
    spaced: list[str] = []
    found: Counter = Counter()
    for line in lines:
        if "  " in line or line[-1:] == " ":
            found.update(_SPACES.findall(line))
        else:
            first, *words = line.split(" ")
            spaced += words
            if first:
                found[first] += 1
    for word, n in Counter(spaced).items():
        found[" " + word] += n
    return found, len(lines) - 1


def splits_exactly(model: sentencepiece.SentencePieceProcessor) -> bool:
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return not any("\n" in p or re.search("[^▁]▁", p) for p in pieces)


def count_pieces(model: sentencepiece.SentencePieceProcessor, tokens: list[str]) -> list[int]:
    """Pieces of each pre-token; one without a leading space is encoded behind a line feed, which takes two pieces."""
    ready = [t[1:] if t[0] == " " else "\n" + t for t in tokens]
    # the model puts no dummy prefix before an empty string, which stands for the pre-token of one space
    return [(len(ids) if r else 1) - 2 * (t[0] != " ") for t, r, ids in zip(tokens, ready, model.encode(ready, num_threads=1), strict=True)]


_models: dict[str, sentencepiece.SentencePieceProcessor] = {}
memo("token counts", _models.clear)


def model_of(path: str) -> sentencepiece.SentencePieceProcessor:
    if path not in _models:
        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        if not splits_exactly(_models[path]):
            raise ValueError(f"pre-tokens of {path} are not independent of each other")
    return _models[path]


def piece_table(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """(pre_token, docs, pieces): every distinct pre-token of the corpus, in how many documents, and its pieces."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["pre_token", "docs"])

        for batch in slices("token counts", batches, 0):
            for text in texts(batch.column(0)):
                held.update(pre_tokens(text)[0].keys())
                if len(held) > GATHER:
                    yield out()
                    held = Counter()
        if held:
            yield out()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_path)
        for batch in batches:
            pieces = pa.array(count_pieces(model, batch.column(0).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pieces], names=["pre_token", "docs", "pieces"])

    seen = docs.select(text_col).mapInArrow(gather, "pre_token string, docs bigint")
    return seen.groupBy("pre_token").agg(F.sum("docs").alias("docs")).mapInArrow(encode, "pre_token string, docs bigint, pieces bigint")


def most_common(table: DataFrame, most: int) -> DataFrame:
    """The rows of the most frequent pre-tokens, at most `most`: all above a document frequency, which a histogram
    over quarter powers of two (a few hundred rows) fixes, so that nothing is sorted or sent to the driver."""
    step = F.floor(F.log2("docs") * 4)
    least, held = None, 0
    for r in sorted(table.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.step):
        held += r.n
        if held > most:
            break
        least = r.step
    return table.filter(step >= least) if least is not None else table.limit(0)


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) per row of docs, without begin, end or added tokens; a null text is empty.

    Pieces are counted once per distinct pre-token. The most frequent pre-tokens (at most `head`) reach the
    per-document frequencies as a broadcast table; the others, none of which is in more documents than the
    head's rarest, by a shuffle on the pre-token. Repeated rows stay apart.
    """
    spark = docs.sparkSession
    table = materialise(piece_table(docs, model_path, text_col), "pieces")
    top = most_common(table.filter(F.length("pre_token") <= HEAD_CHARS), head)
    common = spark.sparkContext.broadcast(dict(top.select("pre_token", "pieces").toPandas().itertuples(index=False, name=None)))
    kind = docs.schema[id_col].dataType

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        for at, batch in numbered(slices("token counts", batches, 1)):
            sizes, sums, rare, freq, owner = [], [], [], [], []
            for k, text in enumerate(texts(batch.column(1))):
                found, total = pre_tokens(text)
                more = []
                for token, n in found.items():
                    pieces = known.get(token)
                    if pieces is None:
                        more.append(token)
                    else:
                        total += pieces * n
                # a row for the document itself, whose key no pre-token equals, and one for each rare pre-token
                rare += [f"\n{at + k}", *more]
                freq += [0, *(found[t] for t in more)]
                owner += repeat(k, len(more) + 1)
                sizes += [len(text.encode()), *repeat(0, len(more))]
                sums += [total, *repeat(0, len(more))]
            places = np.array(owner, np.int64)
            columns = [batch.column(0).take(pa.array(places)), pa.array(places + at), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(rare, pa.string()), pa.array(freq, pa.int64())]
            for a in range(0, len(places), 50_000):
                yield pa.RecordBatch.from_arrays([c.slice(a, 50_000) for c in columns], names=names)

    names = ["doc_id", "row", "n_bytes", "known", "pre_token", "freq"]
    parts = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(split, f"doc_id {kind.simpleString()}, row bigint, n_bytes bigint, known bigint, pre_token string, freq bigint")
    counted = parts.join(table.select("pre_token", "pieces"), "pre_token", "left")
    tokens = F.col("known") + F.col("freq") * F.coalesce("pieces", F.lit(0))
    return counted.groupBy("row", "doc_id").agg(F.sum("n_bytes").alias("n_bytes"), F.sum(tokens).alias("n_tokens")).drop("row")
