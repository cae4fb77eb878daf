"""The six verbs over one corpus: query, report, structure, finding, health, project_control."""

from __future__ import annotations

import os
import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import query as guarded
from lodestone.limits import DEFAULT, Limits
from lodestone.operators import diff, extract, link, pattern, syntax
from lodestone.operators.numbering import numbered
from lodestone.schema import HASH_ALGORITHM, INTERNAL, TABLES
from lodestone.session import materialise, scratch, ship
from lodestone.sources import corpus
from lodestone.sources.ignore import MARKER_DIR
from lodestone.store import Pointer, StaleBaseline, Store
from lodestone.streaming.changes import DESYNCED, HEALTHY, Watch, drain, until_quiet


#: What errors of a damaged or incomplete table say.
DAMAGE = ("not a Parquet file", "CANNOT_READ_FILE_FOOTER", "FILE_NOT_EXIST", "PATH_NOT_FOUND", "FileNotFoundException", "UNABLE_TO_INFER_SCHEMA", "corrupt", "PARQUET_COLUMN_DATA_TYPE_MISMATCH")


class TimeBudgetExceeded(RuntimeError):
    pass


class ChangedDuringSample(RuntimeError):
    """A file changed between its reading and the publish; tried again."""


class SnapshotChanged(RuntimeError):
    """The revision changed while a verb read it."""


@dataclass
class PublishReport:
    revision_id: str
    added: int
    modified: int
    deleted: int
    unchanged: int
    skipped: list[tuple[str, str]]


@dataclass
class Counters:
    calls: int = 0
    errors: int = 0
    total_ms: int = 0


@dataclass
class Engine:
    """One corpus in a folder and its store below the marker folder. All verbs but health and project_control bring
    the index up to date first."""

    spark: SparkSession
    root: str
    limits: Limits = DEFAULT
    pack: str = syntax.PACK_VERSION
    incremental_edges: bool = False
    session_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    watch: Watch = field(default_factory=Watch)
    counters: Counters = field(default_factory=Counters)
    progress: Callable[[str], None] = lambda _: None
    before_publish: Callable[[], None] = lambda: None
    last_sync: int | None = None

    def __post_init__(self) -> None:
        self.root = os.path.realpath(self.root)
        if os.path.islink(os.path.join(self.root, MARKER_DIR)):
            raise PermissionError(f"{MARKER_DIR} in {self.root} is a link")
        ship(self.spark)
        self.store = Store(self.spark, os.path.join(self.root, MARKER_DIR))
        self._slots = threading.BoundedSemaphore(self.limits.concurrent_calls)

    # --- control

    def project_control(self, action: str) -> dict:
        with self._call():
            if action == "on":
                fresh = self.store.create(self.root)
                report = self.publish()
                return {"status": "enabled", "path": self.root, "import": {"added": report.added, "unchanged": report.unchanged, "revision_id": report.revision_id, "created": fresh}}
            if action == "off":
                status = "disabled" if self.store.exists() else "already_disabled"
                self.store.drop()
                self.watch = Watch()
                return {"status": status, "path": self.root, "import": None}
            raise ValueError("action is on or off")

    @contextmanager
    def _call(self):
        """A slot, and the counters; neither statements nor content are ever logged."""
        began = time.monotonic()
        with self._slots:
            try:
                yield
            except Exception:
                self.counters.errors += 1
                raise
            finally:
                self.counters.calls += 1
                self.counters.total_ms += int((time.monotonic() - began) * 1000)

    # --- sync

    def ensure_current(self) -> Pointer:
        if not self.store.exists():
            raise LookupError(f"no corpus is enabled at {self.root}")
        self.store.purge_findings(self.session_id)
        if not self._readable():
            self.progress("rebuild")
            self.store.drop()
            self.store.create(self.root)
            self.watch.health = DESYNCED
        until = time.monotonic() + self.limits.sync_seconds
        try:
            if not self.watch.trusted() or self.store.current() is None:
                self.publish(until)
            else:
                until_quiet(lambda: self.reconcile(until), self.limits.barrier_loops)
        except Exception:
            self.watch.health = DESYNCED
            raise
        found = self.store.current()
        assert found is not None
        return found

    def _readable(self) -> bool:
        """Whether the current revision's tables open; a damaged store is rebuilt from the corpus, findings and all, so
        that an error that doesn't say damage (one of the network or of a lost executor) is raised instead."""
        try:
            pointer = self.store.current()
            for name in ("files", "evidence", "dependency_edges") if pointer else ():
                self.store.read(name, pointer).head(1)
            return True
        except (ValueError, KeyError, FileNotFoundError):
            return False
        except Exception as e:  # noqa: BLE001  Spark says damage in its message
            if any(x in str(e) for x in DAMAGE):
                return False
            raise

    def consume(self, source: str, checkpoint: str) -> None:
        """Take what an event folder holds into the pending changes; offsets are kept by the checkpoint."""

        def apply(changes: DataFrame, _: int) -> None:
            for r in changes.orderBy("seq").toLocalIterator():
                self.watch.record(r.path, "remove" if r.change == "deleted" else "modify")

        drain(self.spark, source, checkpoint, apply)

    def publish(self, until: float | None = None) -> PublishReport:
        """Full verification: list, hash, compare, extract what changed, one revision. Retried if another got ahead."""
        until = until or time.monotonic() + self.limits.sync_seconds
        for attempt in range(self.limits.publish_retries + 1):
            upto = self.watch.sequence
            try:
                with scratch(self.spark):
                    report = self._publish(None, until)
                break
            except (StaleBaseline, ChangedDuringSample):
                if attempt == self.limits.publish_retries:
                    raise
        self.watch.acknowledge(upto)
        self.watch.health = HEALTHY
        self.watch.full_publishes += 1
        self.last_sync = int(time.time())
        return report

    def reconcile(self, until: float) -> bool:
        """Apply the pending changes; whether there were any."""
        upto, pending = self.watch.snapshot()
        if not pending:
            return False
        with scratch(self.spark):
            self._publish(pending, until)
        self.watch.acknowledge(upto)
        self.watch.full_publishes = 0
        self.last_sync = int(time.time())
        return True

    def _deadline(self, until: float) -> None:
        if time.monotonic() > until:
            raise TimeBudgetExceeded(f"the sync exceeded {self.limits.sync_seconds} seconds")

    def _publish(self, pending: dict[str, str] | None, until: float) -> PublishReport:
        baseline = self.store.current()
        old = self.store.read("files", baseline)
        self.progress("discover")
        listing = corpus.list_files(self.root)
        paths = listing.files if pending is None else [(p, n) for p, n in listing.files if p in pending]
        raw = materialise(corpus.read_files(self.spark, self.root, paths, self.limits.max_file_bytes), "raw")
        self._deadline(until)
        size = raw.agg(F.sum(F.octet_length("bytes").cast("long"))).first()[0] or 0
        if size > self.limits.max_total_import_bytes:
            raise ValueError(f"the corpus has {size} bytes, over the limit of {self.limits.max_total_import_bytes}")
        skipped = [(r.path, r.skip) for r in raw.filter("skip is not null").select("path", "skip").collect()] + listing.skipped
        now = corpus.classified(raw.filter("skip is null"))
        kept = now.select("path", "content_hash")
        if pending is not None:
            gone = self.spark.createDataFrame([(p,) for p in pending], "path string")
            kept = kept.unionByName(old.select("path", "content_hash").join(gone, "path", "left_anti"))
        stays = self.spark.createDataFrame([(p,) for p, _ in skipped], "path string")
        if pending is not None:
            kept = kept.unionByName(old.select("path", "content_hash").join(stays, "path", "left_semi").join(now.select("path"), "path", "left_anti"))
        changes = materialise(diff.compare(old, kept), "changes")
        counts = diff.counts(changes, len(listing.files))
        same_pack = baseline is not None and baseline.parser_pack_version == self.pack
        if baseline is not None and same_pack and not (counts["added"] or counts["modified"] or counts["deleted"]):
            return PublishReport(baseline.revision_id, 0, 0, 0, counts["unchanged"], skipped)
        self._deadline(until)
        self.progress("extract")
        wanted = changes.filter("status != 'Deleted'").select("path")
        fresh = now if not same_pack and pending is None else now.join(wanted, "path", "left_semi")
        analyzed = materialise(extract.analyzed(fresh), "analyzed")
        self._deadline(until)
        tables = self._tables(baseline, old, analyzed, changes)
        manifest = diff.manifest_hash(tables["files"]).first().manifest_hash
        self.before_publish()
        self._revalidate(raw, wanted)
        self._deadline(until)
        self.progress("publish")
        pointer = self.store.publish(baseline, tables, manifest, self.pack)
        self._invalidate(pointer)
        return PublishReport(pointer.revision_id, counts["added"], counts["modified"], counts["deleted"], counts["unchanged"], skipped)

    def _revalidate(self, raw: DataFrame, wanted: DataFrame) -> None:
        """Read the files to publish again; ChangedDuringSample if one isn't what it was."""
        read = raw.filter("skip is null").join(wanted, "path", "left_semi").select("path", F.sha2("bytes", 256).alias("was"))
        sizes = [(r.path, 0) for r in read.select("path").collect()]
        again = corpus.read_files(self.spark, self.root, sizes, self.limits.max_file_bytes).select("path", F.sha2("bytes", 256).alias("now"))
        changed = read.join(again, "path", "left").filter(~F.col("was").eqNullSafe(F.col("now"))).select("path").head(1)
        if changed:
            raise ChangedDuringSample(changed[0].path)

    def _tables(self, baseline: Pointer | None, old: DataFrame, analyzed: DataFrame, changes: DataFrame) -> dict[str, DataFrame]:
        """The tables of the next revision: the last one's rows without what is touched, and the new rows. A path keeps its id."""
        number = (baseline.id if baseline else 0) + 1
        touched = changes.select("path").unionByName(analyzed.select("path")).distinct()
        top = old.agg(F.max("id")).first()[0] or 0
        ids = analyzed.select("path").join(old.select("path", "id"), "path", "left")
        fresh = numbered(ids.filter("id is null").select("path"), "path", "id", top + 1)
        ids = ids.filter("id is not null").unionByName(fresh)
        files = analyzed.join(ids, "path").select(
            "id", "path", "file_kind", "content", "content_hash", F.lit(HASH_ALGORITHM).alias("hash_algorithm"), "byte_len", F.lit(None).cast("long").alias("modified_unix_seconds"), "language",
            F.col("language").isNotNull().alias("language_detected"), "parser_availability", "parse_outcome", "parse_error_reason", "extraction_completeness", F.lit(number).cast("long").alias("last_revision_id"),
        )
        files = materialise(old.join(touched, "path", "left_anti").select(*TABLES["files"].names).unionByName(files.select(*TABLES["files"].names)), "files")
        rows = extract.capped(extract.evidence_rows(analyzed), self.limits)
        before = self.store.read("evidence", baseline).join(touched, "path", "left_anti")
        own = before.drop("id", "file_id").unionByName(rows.select(*[c for c in TABLES["evidence"].names if c not in ("id", "file_id")]))
        evidence = materialise(own.join(files.select("path", F.col("id").alias("file_id")), "path").withColumn("id", F.col("file_id") * 100_000 + F.col("ord")).select(*TABLES["evidence"].names), "evidence")
        source = evidence
        if self.incremental_edges:
            source = evidence.join(analyzed.select("path"), "path", "left_semi")
        imports = source.filter("kind = 'Import'").select(F.col("path").alias("from_path"), "ord", F.get_json_object("payload", "$.source").alias("raw"))
        imports = imports.join(files.filter("language is not null").select(F.col("path").alias("from_path"), "language"), "from_path")
        edges = link.edges(imports, files.select("path"))
        number_of = files.select("path", "id")
        edges = edges.join(number_of.select(F.col("path").alias("from_path"), F.col("id").alias("from_file_id")), "from_path").join(number_of.select(F.col("path").alias("to_path"), F.col("id").alias("to_file_id")), "to_path", "left")
        edges = edges.withColumn("id", F.col("from_file_id") * 100_000 + F.col("ord")).select(*TABLES["dependency_edges"].names)
        if self.incremental_edges:
            gone = changes.filter("status = 'Deleted'").select("path")
            last = self.store.read("dependency_edges", baseline)
            kept = last.join(touched.select(F.col("path").alias("from_path")), "from_path", "left_anti").join(gone.select(F.col("path").alias("to_path")), "to_path", "left_anti")
            edges = kept.select(*TABLES["dependency_edges"].names).unionByName(edges)
        return {"files": files, "evidence": evidence, "dependency_edges": edges}

    def _invalidate(self, pointer: Pointer) -> None:
        """Findings whose file changed or went are stale from now on, also if the content comes back."""
        files = self.store.read("files", pointer).select("path", F.col("content_hash").alias("source_hash"))
        gone = self.store.findings(pointer).filter("status = 'current'").join(files, ["path", "source_hash"], "left_anti").select("id").collect()
        if gone:
            self.store.mark_stale([r.id for r in gone])

    # --- reading

    @contextmanager
    def snapshot(self, pointer: Pointer):
        """Temporary views of one revision's tables; SnapshotChanged if it is no longer current at the end."""
        spark = self.spark.newSession()
        for name in TABLES:
            shown = [c for c in TABLES[name].names if c not in INTERNAL.get(name, ())]
            Store(spark, self.store.root).read(name, pointer).select(*shown).createOrReplaceTempView(name)
        spark.conf.set("spark.sql.cteRecursionLevelLimit", self.limits.query_recursion_levels)
        spark.conf.set("spark.sql.cteRecursionRowLimit", self.limits.query_recursion_rows)
        yield spark
        now = self.store.current()
        if now is None or now.id != pointer.id:
            raise SnapshotChanged(f"{pointer.revision_id} is no longer current")

    def query(self, sql: str, offset: int = 0) -> guarded.Page:
        with self._call():
            guarded.checked(self.spark, sql, self.limits)
            pointer = self.ensure_current()
            with self.snapshot(pointer) as spark:
                return guarded.within(spark, self.limits.query_seconds, lambda: guarded.page(guarded.result(spark, sql, self.limits), offset, pointer.revision_id, self.limits))

    def report(self) -> dict:
        with self._call():
            pointer = self.ensure_current()
            return report(self.store, pointer, self.limits)

    def structure(self, file: str, query: str) -> dict:
        with self._call():
            if len(query.encode()) > self.limits.structure_text_bytes:
                raise ValueError(f"the pattern exceeds {self.limits.structure_text_bytes} bytes")
            pointer = self.ensure_current()
            row = self.store.read("files", pointer).filter(F.col("path") == file).select("content", "language").first()
            if row is None or row.content is None or row.language is None or not syntax.available(row.language):
                raise LookupError(f"{file} is not a file with a language that can be parsed")
            tree = syntax.parse(row.language, row.content)
            found, cut = [], False
            for name, node in pattern.matches(pattern.compile_pattern(query), tree, self.limits.structure_seconds):
                if len(found) == self.limits.structure_matches:
                    cut = True
                    break
                text, short = pattern.truncated(tree.source.slice(node), self.limits.structure_match_bytes)
                (a, b), (c, d) = tree.source.place(node.start), tree.source.place(node.end)
                found.append({"capture_name": name, "node_kind": node.kind, "start_byte": node.start, "end_byte": node.end, "start_line": a, "start_column": b, "end_line": c, "end_column": d, "text": text, "text_truncated": short, "extraction_failed": False})
            return {"revision_id": pointer.revision_id, "language": row.language, "matches": found, "truncated": cut}

    def finding(self, file: str, line_start: int, line_end: int, severity: str, category: str, title: str, description: str) -> dict:
        with self._call():
            for name, value, most in (("severity", severity, 100), ("category", category, 100), ("title", title, 200), ("description", description, 10_000)):
                if not value.strip() or len(value) > most:
                    raise ValueError(f"{name} is blank or longer than {most} characters")
            pointer = self.ensure_current()
            row = self.store.read("files", pointer).filter(F.col("path") == file).select("content_hash", line_count(F.col("content")).alias("lines")).first()
            if row is None or row.lines is None:
                raise LookupError(f"{file} is not a text file of the corpus")
            if not 1 <= line_start <= line_end <= row.lines:
                raise ValueError(f"lines {line_start} to {line_end} are not in 1 to {row.lines}")
            last = self.store.findings(pointer).agg(F.max("created_at_unix")).first()[0] or 0
            values = {"path": file, "source_hash": row.content_hash, "line_start": line_start, "line_end": line_end, "severity": severity, "category": category, "title": title, "description": description}
            now = self.store.current()
            if now is None or now.id != pointer.id:
                raise SnapshotChanged(f"{pointer.revision_id} is no longer current")
            number = self.store.add_finding(values | {"created_at_unix": max(int(time.time()), last), "evidence_revision": pointer.revision_id, "session_id": self.session_id})
            return {"id": number, "revision_id": pointer.revision_id, "source_hash": row.content_hash, "status": "current"}

    def health(self) -> dict:
        """Never syncs; what can't be read is null, or -1 for the files."""
        pointer, files = None, -1
        try:
            pointer = self.store.current()
            files = self.store.read("files", pointer).count() if pointer else -1
        except Exception:  # noqa: BLE001  a damaged store is reported, not raised
            pointer = None
        state = self.watch
        return {
            "phase": state.phase(pointer.revision_id if pointer else None) if self.store.exists() else "no_active_project", "watcher_health": state.health, "pending_dirty": sum(c == "dirty" for c, _ in state.pending.values()),
            "pending_deleted": sum(c == "deleted" for c, _ in state.pending.values()), "watcher_sequence": state.sequence, "last_verified_sequence": state.verified, "last_sync_unix_seconds": self.last_sync,
            "revision_id": pointer.revision_id if pointer else None, "parser_pack_version": pointer.parser_pack_version if pointer else None, "file_count": files, "tool_call_count": self.counters.calls,
            "tool_call_error_count": self.counters.errors, "tool_call_total_ms": self.counters.total_ms, "consecutive_full_publishes": state.full_publishes,
        }


def line_count(content):
    """Lines of a text: none in an empty one; a final line feed ends the last line."""
    lines = F.size(F.split(content, "\n", -1))
    return F.when(content.isNotNull(), F.when(content == "", 0).otherwise(lines - F.when(content.endswith("\n"), 1).otherwise(0)))


def report(store: Store, pointer: Pointer, limits: Limits = DEFAULT) -> dict:
    """The fixed aggregates over one revision."""
    files, evidence, edges = (store.read(t, pointer) for t in ("files", "evidence", "dependency_edges"))
    failed = files.filter("file_kind = 'indexed' and (parser_availability != 'Available' or parse_outcome = 'Failed')")
    by = lambda df, c: [(r[0], r[1]) for r in df.groupBy(c).agg(F.count("*").alias("n")).orderBy(c).collect()]
    kinds = by(evidence, "kind")
    return {
        "revision_id": pointer.revision_id, "file_count": files.count(), "languages": [{"language": a, "file_count": n} for a, n in by(files.filter("language is not null"), "language")],
        "evidence_counts": [{"kind": a, "count": n} for a, n in kinds], "parser_failure_count": failed.count(),
        "parser_failure_files": [r.asDict() for r in failed.orderBy("path").limit(limits.report_failures).select("path", "parse_outcome", "parse_error_reason").collect()],
        "open_finding_count": store.findings(pointer).filter("status = 'current'").count(), "import_resolution": [{"kind": a, "count": n} for a, n in by(edges, "resolution_kind")],
        "diagnostic_count": dict(kinds).get("Diagnostic", 0), "unsupported_language_unresolved_count": edges.filter("resolution_kind = 'Unresolved' and syntax_unmodeled").count(),
    }
