"""SimHash fingerprints and near-duplicate components by pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import connected_components
from lodestone.llm.rows import slices, utf8
from lodestone.session import materialise

#: Largest number of differing bits of a link.
RADIUS = 2
#: Blocks of the fingerprint; RADIUS differing bits leave at least BLOCKS - RADIUS blocks untouched.
BLOCKS = 4
#: Members of a cell up to which its pairs are listed; larger cells are linked through midpoints instead.
SMALL_CELL = 24
SHINGLES_AT_ONCE = 255 * 256


def simhash(text: bytes, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over word shingles: ASCII lower case, words between ASCII white space, repeats included.

    Fewer words than width: the whole sequence is the one shingle. No word: zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total = len(words) - width + 1
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, SHINGLES_AT_ONCE):
        upto = min(total, at + SHINGLES_AT_ONCE)
        spans = zip(starts[at:upto].tolist(), ends[at + width - 1 : upto + width - 1].tolist(), strict=True)
        hashes = np.array([digest(flat[a:b], seed) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        even = len(bits) // 255 * 255
        counts += bits[:even].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[even:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, fp) per row of docs; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices("near duplicates", batches, 1):
            found = np.fromiter((simhash(t) for t in utf8(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def pivots() -> list[list[int]]:
    """Reference fingerprints by block: the 16 Walsh codewords of a 16-bit block, with zeros in the other blocks.

    The distances to a block's codewords less the distance to its first one depend on that block's bits only,
    and over all codewords (an orthogonal basis) they tell blocks apart but for rare pairs.
    """
    width = 64 // BLOCKS
    words = [sum(((j & k).bit_count() & 1) << j for j in range(width)) for k in range(width)]
    return [[signed(w << (width * b)) for w in words] for b in range(BLOCKS)]


def distance(a: Column, b: Column | int) -> Column:
    return F.bit_count(a.bitwiseXOR(F.lit(b).cast("long") if isinstance(b, int) else b))


def cells(distinct: DataFrame) -> DataFrame:
    """The pivot table of each fingerprint as cell keys: (fp, cell), one cell for each set of blocks left untouched.

    Fingerprints within RADIUS bits agree on at least BLOCKS - RADIUS blocks; there every pivot coordinate
    differs by zero, so that they share a cell.
    """
    fp = F.col("fp")
    profile = [F.xxhash64(*[distance(fp, p) - distance(fp, block[0]) for p in block[1:]]) for block in pivots()]
    table = distinct.select("fp", *[p.alias(f"p{b}") for b, p in enumerate(profile)])
    sets = [(a, b) for a in range(BLOCKS) for b in range(a)]
    return table.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(k), f"p{a}", f"p{b}") for k, (a, b) in enumerate(sets)])).alias("cell"))


def coordinate_gap(x: Column, y: Column) -> Column:
    """The largest difference of two fingerprints' distances to the reference fingerprints; at most their distance."""
    return F.greatest(*[F.abs(distance(x, p) - distance(y, p)) for block in pivots() for p in block])


def near_pairs(distinct: DataFrame, radius: int = RADIUS, small_cell: int = SMALL_CELL) -> DataFrame:
    """Links (a, b), a > b, that connect all fingerprints within radius (at most 2) of each other.

    Cells up to small_cell members list their pairs, discard those whose pivot coordinates differ by more than
    radius and verify the rest. Members of larger cells are linked exactly without pairs: two fingerprints are
    within 2 bits if and only if some fingerprint is within 1 bit of both, so that each is grouped under itself
    and its 64 neighbours, in groups of at most 65.
    """
    if radius > BLOCKS - 2:
        raise ValueError("the cells hold for radius up to BLOCKS - 2")
    keyed = cells(distinct)
    sizes = keyed.groupBy("cell").agg(F.count("*").alias("members")).filter("members > 1")
    crowded = keyed.join(sizes, "cell")
    small = crowded.filter(F.col("members") <= small_cell).groupBy("cell").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = (
        small.select(F.posexplode("fps").alias("at", "b"), "fps")
        .select("b", F.explode(F.slice("fps", F.col("at") + 2, F.lit(small_cell))).alias("a"))
        .filter(coordinate_gap(F.col("a"), F.col("b")) <= radius)
        .filter(distance(F.col("a"), F.col("b")) <= radius)
    )
    large = crowded.filter(F.col("members") > small_cell).select("fp").distinct()
    return pairs.select("a", "b").unionByName(_exact_links(large, radius)).distinct()


def _exact_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that connect all of fps within radius, without listing pairs."""
    fp = F.col("fp")
    near = F.array(*[fp.bitwiseXOR(F.lit(signed(1 << k)).cast("long")) for k in range(64)])
    if radius == 0:
        return fps.select(fp.alias("a"), fp.alias("b")).limit(0)
    if radius == 1:
        flipped = fps.select(fp.alias("a"), F.explode(near).alias("b"))
        return flipped.filter("a > b").join(fps.select(fp.alias("b")), "b", "left_semi").select("a", "b")
    hubs = fps.select("fp", F.explode(F.array_append(near, fp)).alias("hub")).groupBy("hub").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    return hubs.filter(F.size("fps") > 1).select(F.explode(F.slice("fps", 2, 64)).alias("a"), F.element_at("fps", 1).alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs; component_id is the smallest id reachable over links.

    Equal fingerprints are one node, whatever the number of their documents. Empty texts share fingerprint zero
    and are linked like any other. Rows with a null id get the component of their fingerprint.
    """
    marked = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "distinct")
    roots = connected_components(near_pairs(distinct.select("fp"), radius))
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_fp = materialise(linked.join(smallest, "root").select("fp", "component_id", "copies"), "by_fp")
    return spread(marked, by_fp, "fp", "copies", ["component_id"])


def spread(rows: DataFrame, table: DataFrame, key: str, weight: str, values: list[str], parts: int = 4096) -> DataFrame:
    """rows joined to table (one row a key) without gathering a hot key: keys that hold more than 1/parts of the
    rows, of which there are fewer than parts, go by broadcast; the others by a shuffle."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) > max(1000, total // parts)
    some = rows.join(F.broadcast(table.filter(hot).select(key, *values, F.lit(True).alias("_hot"))), key, "left")
    rest = some.filter("_hot is null").drop("_hot", *values).join(table.filter(~hot).select(key, *values), key)
    columns = [*rows.columns, *values]
    return some.filter("_hot").select(*columns).unionByName(rest.select(*columns))


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: the one with the smallest id, null ids last.

    Of rows that repeat that id in the component, the one whose text has the smallest hash. All columns stay as they
    are, whatever their names. An empty table stays empty.
    """
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    row = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), mark.alias("mark"))
    found = near_duplicates(docs.select(row.alias("doc_id"), "text"), radius=radius).select("component_id").distinct()
    chosen = found.select("component_id.id", F.col("component_id.mark").alias("least"))
    held = docs.select("doc_id", mark.alias("mark"), F.struct(*docs.columns).alias("row"))
    kept = held.join(chosen, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("least")), "left_semi")
    return kept.dropDuplicates(["doc_id", "mark"]).select("row.*")
