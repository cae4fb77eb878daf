"""Near-duplicate groups by exact 5-word similarity: SimHash classes by pivot distance tables, verified; then a prefix
filter and parity sketches for the pairs that these leave apart, verified; components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import simhash
from lodestone.llm.components import connected_components
from lodestone.llm.decontaminate import _P
from lodestone.llm.rows import slices, utf8
from lodestone.llm.token_counts import most_common
from lodestone.session import discard, materialise, settled

#: Words of a shingle. Texts are alike from a Jaccard similarity of their shingle sets of 4/5.
WIDTH = 5
#: Fewest bits of a sketch, and its bits a shingle, rounded up to a power of two: few pairs below 0.79 pass.
SKETCH, WIDE = 512, 4
#: Bits a shingle of what unrelated texts are told apart by first.
NARROW = 1
#: Up to SENT keys of rows to look for go to all tasks (16 bytes each or so); more are joined by a shuffle.
SENT = 500_000
#: Members of a cell up to which all its pairs are listed; larger ones list this many neighbours first.
SMALL_CELL, NEIGHBOURS = 24, 4
#: Shingles in more texts than COMMON rank last in prefixes, by frequency; at most MOST of them are sent to all tasks.
COMMON, MOST = 16, 200_000
GATHER = 1 << 21
#: Members of a crowded cell compared at once with the rest.
ROWS = 256


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted hashes of the distinct shingles: ASCII lower case, words between ASCII white space.

    Fewer words than WIDTH: the whole sequence is the one shingle. No word: the empty set.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    total = len(h) - WIDTH + 1
    s = h[:total].copy()
    for k in range(1, WIDTH):
        s = s * _P + h[k : k + total]
    s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(s ^ (s >> np.uint64(32)))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def sketch_bits(n: int, bits: int) -> int:
    return max(SKETCH, 1 << (bits * n - 1).bit_length()) if n else SKETCH


def sketch(s: np.ndarray, bits: int = WIDE) -> bytes:
    """Parity of the number of shingles at each bit. Each bit that two sketches differ in takes a shingle that one
    text alone has; alike texts have at most a ninth of their sizes' sum of those. Halves of a sketch, one over the
    other, are the sketch of half the bits. A sketch has at least `bits` bits a shingle."""
    size = sketch_bits(len(s), bits)
    return np.packbits(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """The sketch x in `words` 64-bit words."""
    return np.bitwise_xor.reduce(x.reshape(-1, words), axis=0)


def prefix(s: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first shingles of s in an order that all texts share (rare ones by hash, then common ones by frequency).

    Alike texts share at least 4/5 of either one's shingles, so that their prefixes of n - ceil(4n/5) + 1 meet.
    """
    upto = len(s) - (4 * len(s) + 4) // 5 + 1
    if len(common) and len(s):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        rank = np.where(common[at] == s, often[at], 0)
        if rank.any():
            return s[np.argsort(rank, kind="stable")[:upto]]
    return s[:upto]


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, frequencies) of shingles of many texts. Which ones are found sets the cost, not the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[np.ndarray]) -> pa.RecordBatch:
            s, n = np.unique(np.concatenate(held), return_counts=True)
            more = n > 1
            return pa.RecordBatch.from_arrays([pa.array(s[more].view(np.int64)), pa.array(n[more])], names=["shingle", "docs"])

        held, size = [], 0
        for batch in slices("near duplicates", batches, 0):
            for t in utf8(batch.column(0)):
                held.append(shingle_set(t))
                size += len(held[-1])
                if size > GATHER:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    found = docs.select("text").mapInArrow(run, "shingle bigint, docs bigint").groupBy("shingle").agg(F.sum("docs").alias("docs")).filter(F.col("docs") > COMMON)
    top = most_common(materialise(found, "common"), MOST).toPandas()
    s, n = top["shingle"].to_numpy(np.int64).view(np.uint64), top["docs"].to_numpy(np.int64)
    order = np.argsort(s)
    return s[order], n[order]


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, key, n, sketch, prefix) per row: hashes of the text and of its shingle set, and what finds pairs."""
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = sent.value
        for batch in slices("near duplicates", batches, 2):
            sets = [shingle_set(t) for t in utf8(batch.column(2))]
            keys = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)
            heads = [prefix(s, common, often).view(np.int64) for s in sets]
            columns = [pa.array(keys), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary()), pa.array(heads, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "mark", "key", "n", "sketch", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", mark_of(), "text").mapInArrow(run, f"doc_id {kind}, mark bigint, key bigint, n bigint, sketch binary, prefix array<bigint>")


def mark_of():
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")


def sketches(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Each sketch, and all of them folded to SKETCH bits."""
    every = [np.frombuffer(x, np.uint64) for x in column.to_pylist()]
    return every, np.stack([folded(x, SKETCH // 64) for x in every])


def within_sketch(na: np.ndarray, nb: np.ndarray, a: tuple[list, np.ndarray], b: tuple[list, np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which pairs (p of a, q of b), of na and nb shingles, the sketches allow: in the fewest bits first, then, where
    texts are long, in the most that both have."""
    ok = 9 * np.bitwise_count(a[1][p] ^ b[1][q]).sum(axis=-1, dtype=np.int64) <= na + nb
    for k in np.flatnonzero(ok):
        x, y = a[0][p[k]], b[0][q[k]]
        words = min(len(x), len(y))
        if words > SKETCH // 64:
            ok[k] = 9 * int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum(dtype=np.int64)) <= na[k] + nb[k]
    return ok


def among(rows: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """rows joined to keys by the first column of keys, a materialised table: by broadcast up to SENT keys."""
    return rows.join(F.broadcast(keys) if keys.count() <= SENT else keys, keys.columns[0], how)


def ends(pairs: DataFrame, name: str) -> DataFrame:
    """(key), materialised: what occurs in pairs (a, b)."""
    return materialise(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), name)


def nodes_of(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, n, sketch), one row of each of keys, materialised."""
    return materialise(among(rows.select("key", "n", "sketch"), keys).dropDuplicates(["key"]), "nodes")


def narrowed(nodes: DataFrame) -> DataFrame:
    """nodes (key, n, sketch) with sketches folded to NARROW bits a shingle, so that few bytes go with each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices("near duplicates", batches, 2):
            sizes = [sketch_bits(n, NARROW) // 64 for n in x.column(1).to_pylist()]
            less = [folded(np.frombuffer(s, np.uint64), w).tobytes() for s, w in zip(x.column(2).to_pylist(), sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(less, pa.binary())], names=["key", "n", "sketch"])

    return nodes.select("key", "n", "sketch").mapInArrow(run, "key bigint, n bigint, sketch binary")


def members_of(cells: DataFrame) -> DataFrame:
    """(cell, key) of each of a cell's keys."""
    return cells.select(F.monotonically_increasing_id().alias("cell"), "keys").select("cell", F.explode("keys").alias("key"))


def listing(cells: DataFrame, nodes: DataFrame, small_cell: int, roots: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of cells (keys), of a materialised table, that sizes allow and that roots (node, root) leave apart:
    all of cells up to small_cell, those nearest in size of larger ones."""
    known = nodes.select("key", "n", F.col("key").alias("root"))
    if roots is not None:
        known = nodes.select("key", "n").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    sized = members_of(cells).join(known, "key").groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("n", "key", "root"))).alias("keys"))
    step = F.when(F.size("keys") <= small_cell, small_cell).otherwise(NEIGHBOURS)
    pairs = sized.select(F.posexplode("keys").alias("at", "x"), "keys", step.alias("step")).select("x", F.explode(F.expr("slice(keys, at + 2, step)")).alias("y"))
    return pairs.filter("5 * x.n >= 4 * y.n and x.root != y.root").select(F.greatest("x.key", "y.key").alias("a"), F.least("x.key", "y.key").alias("b")).distinct()


def sketched(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sketches allow, materialised."""
    side = lambda x: nodes.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices("near duplicates", batches, 4):
            if x.num_rows:
                at = np.arange(x.num_rows)
                ok = within_sketch(x.column(2).to_numpy(), x.column(3).to_numpy(), sketches(x.column(4)), sketches(x.column(5)), at, at)
                yield x.select(["a", "b"]).filter(pa.array(ok))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
    return materialise(both.mapInArrow(run, "a bigint, b bigint"), "near")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts (key, text) are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices("near duplicates", batches, 3):
            ok = [alike(shingle_set(a), shingle_set(b)) for a, b in zip(utf8(x.column(2)), utf8(x.column(3)), strict=True)]
            yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def confirmed(pairs: DataFrame, rows: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The candidate pairs (a, b) whose texts are alike, materialised."""
    texts = materialise(texts_of(pairs, rows, docs), f"{name}_texts")
    found = materialise(verified(pairs, texts), name)
    discard(texts)
    return found


def texts_of(pairs: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, text) of one row of each key that occurs in pairs."""
    own = among(rows.select("key", "mark"), ends(pairs, "pair_keys"))
    marks = materialise(own.groupBy("key").agg(F.min("mark").alias("mark")).select("mark", "key"), "marks")
    held = docs.select(mark_of(), F.coalesce("text", F.lit("")).alias("text"))
    return among(held, marks, "inner").select("key", "text").dropDuplicates(["key"])


def crossing(crowded: DataFrame, rows: DataFrame, roots: DataFrame) -> DataFrame:
    """All pairs of crowded cells that sizes and sketches allow and that roots (node, root) leave apart, materialised."""
    schema = "a bigint, b bigint"
    members = materialise(members_of(crowded), "members")
    placed = members.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    open_ = placed.groupBy("cell").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("cell")
    apart = materialise(placed.join(open_, "cell", "left_semi").select("cell", "key", "root"), "apart")
    nodes = nodes_of(rows, materialise(apart.select("key").distinct(), "apart_keys"))
    known = apart.join(narrowed(nodes), "key")

    def run(x: pa.Table) -> pa.Table:
        x = x.sort_by([("n", "ascending"), ("key", "ascending")])
        keys, root, n = (x.column(c).to_numpy() for c in ("key", "root", "n"))
        bits = sketches(x.column("sketch"))
        found = []
        for lo in range(0, len(n), ROWS):
            some = slice(lo, min(len(n), lo + ROWS))
            upto = int(np.searchsorted(n, n[some][-1] * 5 // 4, side="right"))
            # each pair by its own sizes: a short text's sketch says nothing beside a long one's
            ok = (root[some, None] != root[None, lo:upto]) & (5 * n[some, None] >= 4 * n[None, lo:upto])
            i, j = np.nonzero(np.triu(ok, 1))
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)] + lo, j[at : at + (1 << 16)] + lo
                fine = within_sketch(n[p], n[q], bits, bits, p, q)
                found.append(np.stack((keys[p[fine]], keys[q[fine]])))
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    like = materialise(known.select("cell", "key", "root", "n", "sketch").groupBy("cell").applyInArrow(run, schema).distinct(), "crossing")
    return sketched(like, nodes)


def classes(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(keys) of each class of the SimHash operator (fingerprints, pivot distance tables, components) with several."""
    found = simhash.near_duplicates(docs.select(mark_of(), "text"), "mark").select("doc_id", "component_id").distinct()
    keyed = found.join(rows.select(F.col("mark").alias("doc_id"), "key").distinct(), "doc_id")
    cells = keyed.groupBy("component_id").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    return cells.filter(F.size("keys") > 1).select("keys")


def shared(rows: DataFrame) -> DataFrame:
    """(keys) of each set of texts that meet in a shingle of their prefixes."""
    entries = rows.filter("n > 0").select("key", F.explode("prefix").alias("cell"))
    cells = entries.groupBy("cell").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    return cells.filter(F.size("keys") > 1).select("keys").distinct()


def confirmed_in(cells: DataFrame, rows: DataFrame, docs: DataFrame, small_cell: int, roots: DataFrame | None, name: str) -> DataFrame:
    """The pairs (a, b) that cells list and whose texts are alike, materialised."""
    keys = materialise(cells.select(F.explode("keys").alias("key")).distinct(), "cell_keys")
    nodes = nodes_of(rows, keys)
    listed = materialise(listing(cells, nodes, small_cell, roots), "listed")
    like = sketched(listed, narrowed(nodes))
    near = sketched(like, nodes)
    for x in (listed, like, nodes, keys):
        discard(x)
    return confirmed(near, rows, docs, name)


def links(rows: DataFrame, docs: DataFrame, small_cell: int = SMALL_CELL) -> DataFrame:
    """Links (a, b) between keys that connect all alike texts; each link is between alike texts.

    The classes of the SimHash operator come first. Fingerprints of alike texts may differ in more bits than it links,
    so that cells of prefixes follow for the pairs that are still apart. Cells up to small_cell list all pairs. Larger
    ones list the nearest few of each member first; then all pairs that the links found so far leave in different
    components.
    """
    # settled, so that what finds cells goes before the next shuffles
    spark = docs.sparkSession
    near = confirmed_in(settled(spark, "classes", lambda: classes(rows, docs)), rows, docs, small_cell, None, "classed")
    cells = settled(spark, "cells", lambda: shared(rows))
    found = near.unionByName(confirmed_in(cells, rows, docs, small_cell, connected_components(near), "found"))
    crowded = cells.filter(F.size("keys") > small_cell)
    if crowded.isEmpty():
        return found
    more = crossing(crowded, rows, connected_components(found))
    return found.unionByName(confirmed(more, rows, docs, "crossed"))


def keep_one(docs: DataFrame, small_cell: int = SMALL_CELL) -> DataFrame:
    """docs with one row of each group of texts that a chain of alike texts connects; all columns stay as they are.

    The row with the smallest id stays, and of those the one whose text has the smallest hash; null ids come last.
    Texts without words are alike.
    """

    def first() -> DataFrame:
        rows = materialise(marked(docs), "marked")
        roots = connected_components(links(rows, docs, small_cell))
        placed = rows.select("doc_id", "mark", "key").join(roots.withColumnRenamed("node", "key"), "key", "left")
        order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
        return placed.groupBy(F.coalesce("root", "key").alias("root")).agg(F.min(order).alias("row")).select("row.doc_id", "row.mark")

    # all columns of docs in one struct, so that no name of theirs clashes; nulls in the key's struct are equal, and
    # rows dealt by the whole key once serve the join and what drops repeated rows
    chosen = settled(docs.sparkSession, "chosen", first).select(F.struct("doc_id", "mark").alias("key"))
    key = F.struct("doc_id", mark_of()).cast(chosen.schema["key"].dataType)
    held = docs.select(key.alias("key"), F.struct(*docs.columns).alias("row"))
    return held.join(chosen, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
