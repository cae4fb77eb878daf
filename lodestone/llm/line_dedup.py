"""Line dedup by a log-template tree; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.rows import let
from lodestone.llm.simhash import spread
from lodestone.session import materialise, settled

#: Leading tokens that are levels of the tree, below the token count.
DEPTH = 2
#: Blocks of the tokens behind them; a template may leave one block open, a fifth of the line.
BLOCKS = 5
#: Fewest tokens of a line that may have an open block.
OPEN_TOKENS = 12
#: Documents of different texts in which a template must recur, by the tokens of its lines: from 20, from 6, fewer.
RECURS = ((20, 2), (6, 3), (1, 10))
#: A token that holds a digit is a variable field.
FIELD = r"\S*[0-9]\S*"


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, pos, n, node, key, open): each line with tokens, its leaf's hash, its template's hash, and the
    hashes of its templates with one open block. mark is the hash of the document's text."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select("doc_id", F.xxhash64(text).alias("mark"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", FIELD, "<*>")).otherwise(F.col("line"))
    tokens = lines.select("doc_id", "mark", "pos", F.array_remove(F.split(masked, r"\s+"), "").alias("t")).withColumn("n", F.size("t")).filter("n > 0")
    width = F.ceil((F.col("n") - DEPTH) / F.lit(BLOCKS)).cast("int")
    parts = tokens.select(
        "doc_id", "mark", "pos", "n", F.xxhash64("n", F.slice("t", 1, DEPTH)).alias("node"),
        *[F.xxhash64(F.when(F.col("n") > DEPTH + b * width, F.slice("t", DEPTH + 1 + b * width, F.greatest(width, F.lit(1))))).alias(f"b{b}") for b in range(BLOCKS)],
    )
    blocks = [f"b{b}" for b in range(BLOCKS)]
    opened = F.array(*[F.xxhash64("node", F.lit(b), *[x for x in blocks if x != f"b{b}"]) for b in range(BLOCKS)])
    return parts.select("doc_id", "mark", "pos", "n", "node", F.xxhash64("node", *blocks).alias("key"), F.when(F.col("n") >= OPEN_TOKENS, opened).alias("open"))


def needed(n: Column, recurs: tuple[tuple[int, int], ...]) -> Column:
    found = F.lit(None).cast("int")
    for least, count in reversed(recurs):
        found = F.when(n >= least, count).otherwise(found)
    return found


def recurring_lines(docs: DataFrame, recurs: tuple[tuple[int, int], ...] = RECURS) -> DataFrame:
    """(doc_id, mark, pos) of every line to drop: its template recurs across documents and it isn't the first of it.

    Lines go down a tree of fixed depth: token count, then leading tokens with variable fields open. At a leaf,
    lines are of one template if their tokens are equal, fields apart, or, in leaves that hold several such
    templates, if they are equal but for one of five blocks of tokens. Documents of equal text count as one and
    keep the same lines. First is by smallest doc_id, then by position.
    """
    lines = materialise(lines_of(docs.select("doc_id", "text")), "lines")
    mixed = lines.groupBy("node").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo != hi").select("node")
    at = ["doc_id", "mark", "pos", "n"]
    opened = lines.filter("open is not null").join(mixed, "node", "left_semi").select(*at, F.explode("open").alias("key"))
    rows = lines.select(*at, "key").unionByName(opened)
    by_text = rows.groupBy("key", "mark").agg(F.min(F.struct("doc_id", "pos")).alias("at"), F.first("n").alias("n"), F.count("*").alias("rows"))
    by_key = by_text.groupBy("key").agg(F.count("*").alias("texts"), F.min(F.struct("at.doc_id", "mark", "at.pos")).alias("first"), F.first("n").alias("n"), F.sum("rows").alias("rows"))
    recurring = materialise(by_key.filter(F.col("texts") >= needed(F.col("n"), recurs)).select("key", "first", "rows"), "templates")
    found = spread(rows.select("doc_id", "mark", "pos", "key"), recurring, "key", "rows", ["first"])
    return found.filter("mark != first.mark or pos != first.pos").select("doc_id", "mark", "pos").distinct()


def drop_recurring_lines(docs: DataFrame, recurs: tuple[tuple[int, int], ...] = RECURS) -> DataFrame:
    """docs with the recurring lines taken out of `text`, and the columns `dropped` (sorted places) and `n_lines`.

    Every row stays, also one whose lines all go; a null text stays null. Line feeds join the kept lines.
    """
    def places() -> DataFrame:
        return recurring_lines(docs, recurs).groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))

    # the other columns travel in one struct, so that no name of theirs clashes
    rest = [c for c in docs.columns if c not in ("text", "dropped", "n_lines")]
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id"), F.col("text"), F.xxhash64(text).alias("mark"), F.struct(*rest).alias("row"))
    drops = settled(docs.sparkSession, "drops", places).toDF("d", "m", "dropped")
    both = own.join(drops, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
    lines = F.split(F.col("text"), "\n", -1)
    kept = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(let(lines, lambda x: without(x, F.col("dropped"))), "\n"))
    columns = [kept.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("dropped", "n_lines")]
    return both.select(*columns, F.size(F.split(text, "\n", -1)).alias("n_lines"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def without(lines: Column, places: Column) -> Column:
    """lines without those at the sorted places: the slices between them, so that long documents stay linear."""
    ends = F.concat(places, F.array(F.size(lines)))
    return F.flatten(F.transform(ends, lambda e, i: F.slice(lines, start_after(places, i) + 1, e - start_after(places, i))))


def start_after(places: Column, i: Column) -> Column:
    return F.when(i > 0, F.get(places, i - 1) + 1).otherwise(F.lit(0))
