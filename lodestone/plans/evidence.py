"""Queries of the evidence index over the given tables: documents and pages stand for files, events for changes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.engine import line_count
from lodestone.functions import paths
from lodestone.limits import Limits
from lodestone.llm.rows import slices
from lodestone.operators import diff, extract, link, pattern, syntax
from lodestone.session import scratch_path
from lodestone.sources import corpus
from lodestone.sources.tables import table
from lodestone.streaming import changes

QUERIES = {}
ORACLES = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.classified(corpus.from_documents(table(spark, sf_dir, "documents")))


def page_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.evidence_of(corpus.classified(corpus.from_pages(table(spark, sf_dir, "pages"))))


DOC_PATH = "source || '/' || doc_id || '.' || lang"


@query("SELECT count(*) AS file_count FROM documents")
def report_file_count(spark, sf_dir):
    return documents(spark, sf_dir).agg(F.count("*").alias("file_count"))


@query(f"""SELECT {DOC_PATH} AS path, 'indexed' AS file_kind, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS byte_len, FALSE AS lossy, CAST(NULL AS VARCHAR) AS language FROM documents
UNION ALL SELECT 'page' || page_id || '/' || regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/$', '') || '.html', 'indexed', sha256(html), CAST(strlen(html) AS BIGINT), FALSE, 'html' FROM pages""")
def classify_files(spark, sf_dir):
    files = corpus.from_documents(table(spark, sf_dir, "documents")).unionByName(corpus.from_pages(table(spark, sf_dir, "pages")))
    return corpus.classified(files).drop("content")


@query(f"""WITH f AS (SELECT {DOC_PATH} AS path, sha256(text) AS h FROM documents), g AS (SELECT substr(sha256(path), 1, 3) AS g, path || chr(0) || h || chr(10) AS line FROM f),
d AS (SELECT g, sha256(string_agg(line, '' ORDER BY line)) AS d FROM g GROUP BY g) SELECT sha256(string_agg(g || ':' || d, chr(10) ORDER BY g)) AS manifest_hash FROM d""")
def manifest_hash(spark, sf_dir):
    return diff.manifest_hash(documents(spark, sf_dir))


def perturbed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The corpus, and the corpus after every 10th document went, every 10th changed and every 20th came anew."""
    docs = table(spark, sf_dir, "documents")
    k = F.pmod("doc_id", F.lit(10))
    later = docs.filter(k != 0).withColumn("text", F.when(k == 1, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")))
    anew = docs.filter(F.pmod("doc_id", F.lit(20)) == 5).withColumn("source", F.concat("source", F.lit("/new")))
    after = later.unionByName(anew)
    return documents(spark, sf_dir).select("path", "content_hash"), corpus.classified(corpus.from_documents(after)).select("path", "content_hash")


AFTER = f"""a AS (SELECT {DOC_PATH} AS path, sha256(text) AS h FROM documents),
b AS (SELECT {DOC_PATH} AS path, sha256(text || CASE WHEN doc_id % 10 = 1 THEN ' changed' ELSE '' END) AS h FROM documents WHERE doc_id % 10 <> 0
UNION ALL SELECT source || '/new/' || doc_id || '.' || lang, sha256(text) FROM documents WHERE doc_id % 20 = 5)"""


@query(f"WITH {AFTER} SELECT path, CASE WHEN a.h IS NULL THEN 'Added' WHEN b.h IS NULL THEN 'Deleted' ELSE 'Modified' END AS status FROM a FULL JOIN b USING (path) WHERE a.h IS DISTINCT FROM b.h")
def snapshot_diff(spark, sf_dir):
    return diff.compare(*perturbed(spark, sf_dir))


@query(f"WITH {AFTER} SELECT CASE WHEN a.h IS NULL THEN 'Added' WHEN b.h IS NULL THEN 'Deleted' ELSE 'Modified' END AS status, count(*) AS n FROM a FULL JOIN b USING (path) WHERE a.h IS DISTINCT FROM b.h GROUP BY ALL")
def change_counts(spark, sf_dir):
    return diff.compare(*perturbed(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {AFTER} SELECT path, h AS content_hash FROM b")
def post_update_manifest(spark, sf_dir):
    stored, current = perturbed(spark, sf_dir)
    changed = diff.compare(stored, current)
    upserts = current.join(changed.filter("status != 'Deleted'"), "path", "left_semi")
    return diff.after_update(stored, upserts, changed.filter("status = 'Deleted'"))


@query(f"WITH {AFTER}, f AS (SELECT doc_id AS id, {DOC_PATH} AS path, sha256(text) AS h FROM documents) SELECT id, path FROM f WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.path = f.path AND b.h = f.h)")
def stale_findings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    findings = docs.select(F.col("doc_id").alias("id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"), F.sha2("text", 256).alias("content_hash"))
    return findings.join(perturbed(spark, sf_dir)[1], ["path", "content_hash"], "left_anti").select("id", "path")


@query("""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '<[a-zA-Z][^>]*[^-a-z]href="([^"]*)"', 1)) AS source FROM pages) SELECT page_id, source, count(*) AS n FROM m WHERE source <> '' GROUP BY ALL""")
def evidence_links(spark, sf_dir):
    rows = page_evidence(spark, sf_dir).filter("kind = 'Import'")
    return rows.groupBy(F.regexp_extract("path", "^page([0-9]+)/", 1).cast("bigint").alias("page_id"), F.get_json_object("payload", "$.source").alias("source")).agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT unnest(regexp_extract_all(regexp_replace(html, '<script>.*?</script>|<style>.*?</style>|<!--.*?-->', '', 'gs'), '<(h[1-6]|title|article|section)[ >]', 1)) AS kind FROM pages) SELECT kind, count(*) AS n FROM m GROUP BY kind""")
def evidence_headings(spark, sf_dir):
    rows = page_evidence(spark, sf_dir).filter("kind = 'Structure'")
    return rows.groupBy(F.get_json_object("payload", "$.kind").alias("kind")).agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<!--.*?-->')) AS text FROM pages) SELECT page_id, text, count(*) AS n FROM m GROUP BY ALL""")
def evidence_comments(spark, sf_dir):
    rows = page_evidence(spark, sf_dir).filter("kind = 'Comment'")
    return rows.groupBy(F.regexp_extract("path", "^page([0-9]+)/", 1).cast("bigint").alias("page_id"), F.get_json_object("payload", "$.text").alias("text")).agg(F.count("*").alias("n"))


@query()
def report_evidence_kinds(spark, sf_dir):
    return page_evidence(spark, sf_dir).groupBy("kind", "span_availability").agg(F.count("*").alias("n"))


@query(f"SELECT {DOC_PATH} AS path, 'NotAttempted' AS parse_outcome FROM documents ORDER BY 1 LIMIT 20")
def report_failures_topk(spark, sf_dir):
    files = documents(spark, sf_dir).withColumn("parser_availability", F.when(F.col("language").isNull(), "Unavailable").otherwise("Available"))
    return files.filter("file_kind = 'indexed' and parser_availability != 'Available'").select("path", F.lit("NotAttempted").alias("parse_outcome")).orderBy("path").limit(20)


@query("""WITH s AS (SELECT conv_id, turn, strlen(text) AS z FROM conversations), c AS (SELECT *, z <= 1500 AS fits, sum(CASE WHEN z <= 1500 THEN z ELSE 0 END) OVER w AS total, sum(CASE WHEN z <= 1500 THEN 1 ELSE 0 END) OVER w AS place FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, fits AND total <= 3000 AND place <= 5 AS keep FROM c), m AS (SELECT conv_id, max(turn) + 1 AS ord FROM k GROUP BY conv_id HAVING count(*) > count(*) FILTER (keep))
SELECT CAST(conv_id AS VARCHAR) AS path, turn AS ord, 'k' || turn AS key FROM k WHERE keep UNION ALL SELECT CAST(conv_id AS VARCHAR), ord, 'evidence:truncated' FROM m""")
def evidence_caps(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("ord"), F.concat(F.lit("k"), "turn").alias("key"), F.lit("Comment").alias("kind"), F.col("text").alias("payload"))
    return extract.capped(rows, Limits(evidence_items=6, evidence_item_bytes=1500, evidence_file_bytes=3000, evidence_reserve_bytes=0)).select("path", "ord", "key")


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as script files that import one another: by a path, a package name or an unknown form."""
    k = F.col("p_partkey")
    to = F.pmod(k * 7 + 3, F.lit(2500))
    raw = F.when(k % 5 == 4, F.lit("import React from 'react'")).when(k % 5 == 3, F.lit("import nothing from here")).otherwise(F.concat(F.lit("import x from '../m"), to % 10, F.lit("/./f"), to, F.lit("'")))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("m"), k % 10, F.lit("/f"), k, F.lit(".js")).alias("from_path"), k.alias("ord"), F.lit("javascript").alias("language"), raw.alias("raw"))


LINKS = """t AS (SELECT p_partkey AS k, (p_partkey * 7 + 3) % 2500 AS j FROM part), e AS (SELECT 'm' || k % 10 || '/f' || k || '.js' AS from_path,
CASE WHEN k % 5 < 3 AND j IN (SELECT p_partkey FROM part) THEN 'm' || j % 10 || '/f' || j || '.js' END AS to_path,
CASE WHEN k % 5 = 4 THEN 'External' WHEN k % 5 = 3 OR j NOT IN (SELECT p_partkey FROM part) THEN 'Unresolved' ELSE 'Resolved' END AS resolution_kind, k % 5 = 3 AS syntax_unmodeled FROM t)"""


@query(f"WITH {LINKS} SELECT from_path, to_path, resolution_kind, CASE WHEN resolution_kind = 'Resolved' THEN 'High' END AS confidence, syntax_unmodeled FROM e")
def link_resolution(spark, sf_dir):
    imports = _modules(spark, sf_dir)
    return link.edges(imports, imports.select(F.col("from_path").alias("path"))).select("from_path", "to_path", "resolution_kind", "confidence", "syntax_unmodeled")


@query(f"WITH {LINKS} SELECT resolution_kind, count(*) AS n, count(*) FILTER (resolution_kind = 'Unresolved' AND syntax_unmodeled) AS unmodeled FROM e GROUP BY 1")
def report_edge_kinds(spark, sf_dir):
    edges = link_resolution(spark, sf_dir)
    return edges.groupBy("resolution_kind").agg(F.count("*").alias("n"), F.sum(F.when((F.col("resolution_kind") == "Unresolved") & F.col("syntax_unmodeled"), 1).otherwise(0)).alias("unmodeled"))


@query("SELECT o_orderkey, 'a/' || (o_orderkey % 3) || '/x' || o_orderkey AS place, 'a' AS above, 'x' AS root FROM orders")
def path_normalize(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    place = paths.joined(F.concat(F.lit("a/b/../"), k % 3), F.concat(F.lit("./y/../x"), k))
    return orders.select("o_orderkey", place.alias("place"), paths.parent(F.lit("a/b")).alias("above"), paths.joined(F.lit("a"), F.lit("../../../x")).alias("root"))


@query("""WITH d AS (SELECT doc_id, strlen(text) AS z, hex(encode(text)) AS h FROM documents),
c AS (SELECT *, CASE WHEN z <= 2000 THEN z ELSE list_filter([2000, 1999, 1998, 1997], lambda k: substr(h, 2 * k + 1, 1) NOT IN ('8', '9', 'A', 'B'))[1] END AS n FROM d)
SELECT doc_id, decode(unhex(substr(h, 1, 2 * n))) AS shown, z > 2000 AS text_truncated FROM c""")
def match_text_cut(spark, sf_dir):
    cut = paths.cut_bytes(F.col("text"), 2000)
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", cut.alias("shown"), (F.octet_length(cut) < F.octet_length("text")).alias("text_truncated"))


@query("""WITH c AS (SELECT CAST(user_id AS VARCHAR) AS path, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'dirty' END AS change, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) SELECT path, change, seq FROM c WHERE rn = 1""")
def collapse_events(spark, sf_dir):
    """event_id is the sequence, user_id the path; an error stands for a removal."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("path"), F.when(F.col("event_type") == "error", "remove").otherwise("modify").alias("kind"))
    return changes.collapse(events)


@query("SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS BIGINT) AS lines FROM documents")
def line_range_check(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", line_count(F.col("text")).cast("long").alias("lines"))


@query(ORACLES["collapse_events"])
def stream_collapse(spark, sf_dir):
    """The same over a file stream: each micro-batch is collapsed into a folder, under a checkpoint, until drained."""
    base = scratch_path(spark, "stream")
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    kind = F.when(F.col("event_type") == "error", "remove").otherwise("modify")
    arrived = stream.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("path"), kind.alias("kind"))
    out = f"{base}/collapsed"
    write = lambda df, n: changes.collapse(df).write.mode("overwrite").parquet(f"{out}/batch={n}")
    arrived.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    batches = spark.read.schema("path string, change string, seq bigint").parquet(f"{out}/*")
    return batches.groupBy("path").agg(F.max_by("change", "seq").alias("change"), F.max("seq").alias("seq"))


def tag_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tag, n) of a task's pages by slices; one page's tree stands at a time, so that batches of any size fit."""
    parts = pattern.compile_pattern("(element name: (tag_name) @tag)")
    for batch in slices("structure", batches, 0):
        counts: Counter[str] = Counter()
        for html in batch.column(0):
            tree = syntax.parse("html", html.as_py() or "")
            counts.update(tree.source.slice(node).lower() for _, node in pattern.matches(parts, tree))
        yield pa.record_batch({"tag": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})


@query("""WITH m AS (SELECT unnest(regexp_extract_all(regexp_replace(html, '<script>.*?</script>|<style>.*?</style>|<!--.*?-->', '', 'gs'), '<([a-zA-Z][a-zA-Z0-9]*)[ >/]', 1)) AS tag FROM pages
UNION ALL SELECT unnest(regexp_extract_all(html, '<(script|style)>', 1)) FROM pages) SELECT lower(tag) AS tag, count(*) AS n FROM m GROUP BY 1""")
def structure_matches(spark, sf_dir):
    """Captures of a tree pattern over every page, by their text."""
    found = table(spark, sf_dir, "pages").select("html").mapInArrow(tag_counts, "tag string, n bigint")
    return found.groupBy("tag").agg(F.sum("n").alias("n"))


@query("SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN ('documents', 'pages', 'labels', 'lineitem')")
def catalog_columns(spark, sf_dir):
    names = ["documents", "pages", "labels", "lineitem"]
    return spark.createDataFrame([(t, c) for t in names for c in table(spark, sf_dir, t).columns], "table_name string, column_name string")
