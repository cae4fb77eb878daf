"""Document fingerprints by a Merkle tree over sections, paragraphs and word blocks; DataFrame functions only."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.rows import let

#: Blocks of up to four words, or of 32 characters of longer words, with the white space behind them.
#: The blocks of a paragraph, joined, are the paragraph.
BLOCK = r"\s*(?:\S{1,32}\s*){1,4}|\s+"
#: Paragraphs (lines) of a section.
SECTION = 8
#: Characters of text that one task orders.
PART_CHARS = 8_000_000
#: Most parts, as their borders are sampled on the driver.
MOST_PARTS = 4096


def tree(text: Column) -> Column:
    """struct<root, sections, paragraphs, blocks>: node hashes by level, blocks nested in their paragraphs.

    A node hashes its children in order, the root the number of code points too. Equal texts have equal trees;
    texts that differ do so in a block, and so in its paragraph, its section and the root.
    """
    blocks = F.transform(F.split(text, "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(BLOCK), F.lit(0)), lambda b: F.xxhash64(b)))

    def sections(paragraphs: Column) -> Column:
        last = F.floor((F.size(paragraphs) - 1) / F.lit(SECTION)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda s: F.xxhash64(F.slice(paragraphs, s * SECTION + 1, SECTION)))

    def above(b: Column) -> Column:
        def top(p: Column) -> Column:
            def node(s: Column) -> Column:
                root = F.md5(F.concat_ws(",", F.length(text).cast("string"), F.array_join(F.transform(s, lambda x: F.hex(x)), ",")))
                return F.struct(root.alias("root"), s.alias("sections"), p.alias("paragraphs"), b.alias("blocks"))

            return let(sections(p), node)

        return let(F.transform(b, lambda x: F.xxhash64(x)), top)

    return let(blocks, above)


def short(block: Column) -> Column:
    """The part of a block's hash that the fingerprint shows."""
    return block.bitwiseAND(F.lit(0xFFFFFFFF))


def fingerprint(t: Column) -> Column:
    """Root, colon, the blocks of each paragraph as 8 hex digits, paragraphs joined by commas."""
    digits = lambda b: F.lpad(F.lower(F.hex(short(b))), 8, "0")
    return F.concat(t.root, F.lit(":"), F.array_join(F.transform(t.blocks, lambda p: F.array_join(F.transform(p, digits), "")), ","))


def shown(t: Column) -> Column:
    """The blocks as the fingerprint shows them, the repeats of each numbered, so that the array is a multiset:
    sorted, cut into runs of equal blocks, and hashed with the place in the run."""

    def numbered(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

        def runs(at: Column) -> Column:
            def run(start: Column, k: Column) -> Column:
                last = F.coalesce(F.get(at, k + 1), F.size(s)) - 1 - start
                return F.transform(F.sequence(F.lit(0), last), lambda n: F.xxhash64(F.get(s, start), n))

            return F.flatten(F.transform(at, run))

        return let(starts, runs)

    return let(F.array_sort(F.transform(F.flatten(t.blocks), short)), numbered)


def likeness(a_root: Column, a_shown: Column, b_root: Column, b_shown: Column) -> Column:
    """1 for equal roots; else the Dice share of common blocks, repeats counted, less than 1. Two empty sides with
    other roots: 0."""
    total = F.size(a_shown) + F.size(b_shown)
    share = F.when(total > 0, 2.0 * F.size(F.array_intersect(a_shown, b_shown)) / total).otherwise(0.0)
    return F.when(a_root == b_root, 1.0).otherwise(F.least(share, F.lit(0.999999)))


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Places (from 0) of the paragraphs that differ between two trees, found from the differing sections down."""
    count = F.greatest(F.size(a.sections), F.size(b.sections))
    at = lambda nodes, i: F.get(nodes, i)
    sections = F.filter(F.sequence(F.lit(0), count - 1), lambda s: ~at(a.sections, s).eqNullSafe(at(b.sections, s)))
    paragraphs = F.flatten(F.transform(sections, lambda s: F.sequence(s * SECTION, s * SECTION + (SECTION - 1))))
    return F.when(a.root == b.root, F.array().cast("array<int>")).otherwise(F.filter(paragraphs, lambda p: ~at(a.paragraphs, p).eqNullSafe(at(b.paragraphs, p))))


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with one column more, `tree`; a null text is empty."""
    return docs.withColumn("tree", tree(F.coalesce(F.col(text_col), F.lit(""))))


def part_of(value: Column, borders: list, step: int = 64) -> Column:
    """How many of the sorted borders are at most value, by a search of two levels."""
    if not borders:
        return F.lit(0)
    coarse, fine = borders[::step], F.array(*map(F.lit, borders))
    upto = lambda a: F.size(F.filter(a, lambda x: x <= value))
    if len(borders) <= step:
        return upto(fine)
    return let(upto(F.array(*map(F.lit, coarse))), lambda k: F.when(k > 0, (k - 1) * step + upto(F.slice(fine, F.greatest((k - 1) * step + 1, F.lit(1)), step))).otherwise(0))


def with_next(docs: DataFrame, prepare: dict[str, Column], part_chars: int = PART_CHARS) -> DataFrame:
    """docs (doc_id, text) and `prepare`'s columns, each with `next`: a struct of the next row's text and prepared columns.

    Order: descending doc_id, null ids last, rows of one id by descending hash of the text, then text; after the
    last row comes the first. Rows are dealt to parts of this order, and the first row of each part goes to the
    part before it too, so that texts are shuffled once and no task sees more than its part.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    parts = max(1, min(MOST_PARTS, -(-chars // part_chars)))
    wanted = [k / parts for k in range(1, parts)]
    borders = sorted(set(docs.agg(F.percentile_approx("doc_id", wanted, 20_000)).first()[0] or [])) if wanted else []
    docs = docs.withColumn("part", F.when(F.col("doc_id").isNull(), -1).otherwise(part_of(F.col("doc_id"), borders)))
    first = F.max(F.struct(F.col("doc_id"), F.col("mark"))).alias("first")
    firsts = sorted(docs.groupBy("part").agg(first).collect(), key=lambda r: -r.part)
    spark = docs.sparkSession
    ghosts = [(r.part, r.first.doc_id, r.first.mark, firsts[k - 1].part) for k, r in enumerate(firsts)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = F.broadcast(spark.createDataFrame(ghosts, f"g_part int, g_id {kind}, g_mark bigint, to int"))
    on = (F.col("part") == F.col("g_part")) & F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("mark") == F.col("g_mark"))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.col("to").alias("part"), F.lit(True).alias("ghost"))
    sent = docs.join(table, on, "left").select("doc_id", "text", "mark", F.explode(F.when(F.col("to").isNotNull(), F.array(own, ghost)).otherwise(F.array(own))).alias("sent"))
    dealt = sent.select("doc_id", "text", "mark", "sent.part", "sent.ghost").repartition(max(parts, len(firsts)), "part")
    ready = dealt.select("*", *[c.alias(n) for n, c in prepare.items()])
    order = Window.partitionBy("part").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.col("mark").desc(), F.col("text").desc())
    following = F.lead(F.struct("text", *prepare)).over(order)
    return ready.withColumn("next", following).filter(~F.col("ghost")).drop("part", "ghost", "mark")


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(n / 3) code points replaced by the first as many of the following text."""
    cut = F.floor(F.length(text) / F.lit(3)).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - cut), F.substr(following, F.lit(1), cut))


def edit_report(docs: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Each row of docs with its tree, its edited text's tree, and how alike its fingerprint is to that and to the next row's.

    Repeated ids are rows of their own; an empty table gives an empty result.
    """
    own = tree(F.col("text"))
    base = with_next(docs, {"tree": own}, part_chars)
    both = base.withColumn("edited", edited(F.col("text"), F.col("next.text")))
    return both.withColumn("edited_tree", tree(F.col("edited")))


