"""The registered queries of the operators; each applies one operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestone.llm import chat, decontaminate, line_dedup, merkle, packing, pii, token_counts, toxicity, url_filter
from lodestone.llm import simhash as simhash_
from lodestone.llm.rows import slices
from lodestone.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted"))


def chat_digest(turns: DataFrame, budget: int = chat.BUDGET, history: int = chat.HISTORY, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """Digests of each conversation, read back from its formatted windows, which follow each other in one task."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        held = None

        def row() -> list:
            conv, n, turns, chars, loss, total, windows = held
            return [conv, n, turns.hexdigest(), chars, loss.hexdigest(), total, windows]

        for b in slices("chat format", batches, 2):
            for w in b.to_pylist():
                if held is None or held[0] != w["conv_id"] or w["window"] == 0:
                    if held:
                        out.append(row())
                    held = [w["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text, _ in chat.read_back(w["formatted"])[w["repeated"] :]:
                    held[1] += 1
                    held[2].update(f"{role}\n{text}\n".encode())
                for span in w["loss"]:
                    text = chat.unescape(w["formatted"][span["start"] : span["end"]])
                    held[3] += len(text)
                    held[4].update(text.encode())
                held[5] += len(w["formatted"])
                held[6] += 1
            if len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], names=names)
                out = []
        if held:
            out.append(row())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], names=names)

    kind = turns.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return chat.formatted(turns, budget, history, tokenizer).mapInArrow(run, schema)


@query
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digest(turns.unionByName(more), tokenizer=(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def merkle_digest(docs: DataFrame, part_chars: int = merkle.PART_CHARS) -> DataFrame:
    t, e = F.col("tree"), F.col("edited_tree")
    found = merkle.edit_report(docs, part_chars).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), merkle.fingerprint(t).alias("fingerprint"), merkle.fingerprint(e).alias("edited_fingerprint"),
        t.root.alias("r0"), e.root.alias("r1"), F.col("next.tree.root").alias("r2"), merkle.shown(t).alias("s0"), merkle.shown(e).alias("s1"), merkle.shown(F.col("next.tree")).alias("s2"),
    )
    near = lambda k: merkle.likeness(F.col("r0"), F.col("s0"), F.col(f"r{k}"), F.col(f"s{k}"))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near(1).alias("near_edited"), near(2).alias("near_next"))


@query
def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_digest(table(spark, sf_dir, "documents"))


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def pii_digest(docs: DataFrame) -> DataFrame:
    base = [k.name for k in pii.KINDS if k.is_base]
    found = pii.find_pii(docs.select("doc_id", "text"))
    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    digest = F.sha2(pii.listed(F.filter("pii", lambda s: s.kind.isin(base))), 256)
    return found.select("doc_id", *map(count, base), digest.alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"))


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_.hex_digits(found.fp).alias("fingerprint"), "component_id")


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), F.array_join("dropped", ",").alias("dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLES["op10_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS doc, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
tokens AS (
  SELECT doc_id, doc, pos, list_filter(string_split_regex(regexp_replace(line, '\S*[0-9]\S*', '<*>', 'g'), '\s+'), lambda x: x <> '') AS t FROM lines),
leaves AS (
  SELECT *, len(t) AS n, CAST(greatest(ceil((len(t) - 2) / 5.0), 1) AS BIGINT) AS w, CAST(len(t) AS VARCHAR) || ' ' || array_to_string(t[1:2], ' ') AS node,
         array_to_string(t, ' ') AS key FROM tokens WHERE len(t) > 0),
mixed AS (SELECT node FROM leaves GROUP BY node HAVING count(DISTINCT key) > 1),
opened AS (
  SELECT doc_id, doc, pos, n, 'open ' || b || ' ' || array_to_string(t[1:2 + b * w], ' ') || ' * ' || array_to_string(t[3 + (b + 1) * w:], ' ') || ' ' || n AS key
  FROM leaves, (SELECT unnest(range(5)) AS b) WHERE n >= 12 AND node IN (SELECT node FROM mixed)),
every AS (SELECT doc_id, doc, pos, n, n || ' ' || key AS key FROM leaves UNION ALL SELECT doc_id, doc, pos, n, key FROM opened),
recurring AS (
  SELECT key, arg_min(doc, {'d': doc_id, 'p': pos}) AS first_doc, arg_min(pos, {'d': doc_id, 'p': pos}) AS first_pos FROM every
  GROUP BY key HAVING count(DISTINCT doc) >= CASE WHEN min(n) >= 20 THEN 2 WHEN min(n) >= 6 THEN 3 ELSE 10 END),
drops AS (SELECT DISTINCT doc_id, pos FROM every JOIN recurring USING (key) WHERE doc <> first_doc OR pos <> first_pos),
marked AS (
  SELECT l.doc_id, count(*) AS n_lines, count(d.pos) AS n_dropped, coalesce(string_agg(CAST(d.pos AS VARCHAR), ',' ORDER BY l.pos) FILTER (d.pos IS NOT NULL), '') AS dropped,
         sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (d.pos IS NULL), '')) AS kept_sha256
  FROM lines l LEFT JOIN drops d ON l.doc_id = d.doc_id AND l.pos = d.pos GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_dropped, dropped, kept_sha256 FROM marked
"""

ORACLES["op8_pii"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT doc_id, 'email' AS kind, 1 AS place, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS m, regexp_split_to_array(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS g FROM d
  UNION ALL SELECT doc_id, 'ip', 2, regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'), regexp_split_to_array(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') FROM d
  UNION ALL SELECT doc_id, 'card', 3, regexp_extract_all(t, '[0-9](?:[ -]?[0-9])+'), regexp_split_to_array(t, '[0-9](?:[ -]?[0-9])+') FROM d
  UNION ALL SELECT doc_id, 'phone', 4, regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), regexp_split_to_array(t, '\+[0-9][ ().0-9-]+[0-9]') FROM d
  UNION ALL SELECT doc_id, 'iban', 5, regexp_extract_all(t, '\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b'), regexp_split_to_array(t, '\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b') FROM d),
each AS (SELECT doc_id, kind, place, m, g, unnest(range(1, len(m) + 1)) AS i FROM found),
placed AS (
  SELECT doc_id, kind, place, m[i] AS s, regexp_replace(m[i], '[^0-9]', '', 'g') AS digits, replace(m[i], ' ', '') AS bare,
         CAST(sum(length(m[i]) + length(g[i])) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop FROM each),
kept AS (
  SELECT doc_id, kind, place, stop - length(s) AS start, stop FROM placed WHERE CASE kind
    WHEN 'email' THEN TRUE
    WHEN 'ip' THEN len(list_filter(string_split(s, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST(right(x, 3) AS INTEGER) > 255)) = 0
    WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15
    WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(string_split(reverse(digits), ''), lambda c, i:
      CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) ELSE (CAST(c AS INTEGER) * 2) % 10 + CASE WHEN CAST(c AS INTEGER) > 4 THEN 1 ELSE 0 END END)) % 10 = 0
    ELSE length(bare) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(bare[5:] || bare[1:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)),
      lambda a, x: (a * CASE WHEN x < 10 THEN 10 ELSE 100 END + x) % 97) = 1 END)
SELECT d.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
       sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY place, start) FILTER (place < 5), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY place, start) FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id GROUP BY d.doc_id
"""


#: The windows of op2 under estimated tokens. SQL can't count those of a tokenizer, which the query goes by, so that
#: this holds the operator without a tokenizer; the query itself is held against brute force.
ESTIMATED_WINDOWS = r"""
WITH RECURSIVE rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, 4 + (strlen(text) + 3) // 4 AS tokens,
         18 + length(text) + len(regexp_extract_all(text, '<\\*\|')) + length(role) + len(regexp_extract_all(role, '<\\*\|')) + 2 * len(regexp_extract_all(role, '%|\|>')) AS chars FROM rows),
digests AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
         CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
         coalesce(max(tokens) FILTER (i = 1 AND role = 'system'), 0) AS sys_tokens, coalesce(max(chars) FILTER (i = 1 AND role = 'system'), 0) AS sys_chars,
         list(tokens ORDER BY i) FILTER (NOT (i = 1 AND role = 'system')) AS t, list(chars ORDER BY i) FILTER (NOT (i = 1 AND role = 'system')) AS c FROM turns GROUP BY conv_id),
sums AS (
  SELECT conv_id, 2048 - sys_tokens AS room, sys_chars, coalesce(len(t), 0) AS m, t,
         list_transform(range(0, coalesce(len(t), 0) + 1), lambda k: CAST(coalesce(list_sum(t[1:k]), 0) AS BIGINT)) AS s,
         list_transform(range(0, coalesce(len(t), 0) + 1), lambda k: CAST(coalesce(list_sum(c[1:k]), 0) AS BIGINT)) AS z FROM digests),
windows AS (
  SELECT conv_id, CAST(1 AS BIGINT) AS a, CAST(1 AS BIGINT) AS f,
         coalesce(list_filter(range(2, m + 1), lambda p: s[p + 1] > room)[1], m + 1) AS g FROM sums
  UNION ALL
  SELECT conv_id, a, f, coalesce(list_filter(range(f + 1, m + 1), lambda p: s[p + 1] - s[a] > room)[1], m + 1) AS g FROM (
    SELECT w.conv_id, list_filter(range(w.a, w.g + 1), lambda k: s[w.g] - s[k] <= greatest(0, least(room - t[w.g], 512)))[1] AS a, w.g AS f, m, s, room
    FROM windows w JOIN sums USING (conv_id) WHERE w.g <= m)),
totals AS (
  SELECT conv_id, CAST(sum(sys_chars + z[g] - z[a]) AS BIGINT) AS formatted_chars, count(*) AS n_windows FROM windows JOIN sums USING (conv_id) GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows FROM digests JOIN totals USING (conv_id)
"""
