"""Snapshot store: immutable table folders and one exclusively created pointer a revision."""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from lodestone.schema import SCHEMA_VERSION, TABLES

CONTRACT_VERSION = 1


class StaleBaseline(RuntimeError):
    """Another publisher made the next revision first."""


@dataclass(frozen=True)
class Pointer:
    id: int
    data: str
    manifest_hash: str
    parser_pack_version: str
    created_at_unix: int
    baseline: int
    schema_version: int = SCHEMA_VERSION

    @property
    def revision_id(self) -> str:
        return f"rev-{self.id}"


class Store:
    """A store under `root`/: data/{uuid}/{table}, _revisions/N.json, findings.

    Tables are written below a fresh uuid first; then the pointer is created under the next number by a link that
    fails if it exists, so that one of several publishers wins and readers see whole revisions only. The folder is
    a local or shared POSIX file system; an object store needs a conditional put in `_create`.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, *parts: str) -> str:
        return os.path.join(self.root, *parts)

    def create(self, corpus: str) -> bool:
        """False if it was there; a root of another corpus or contract is refused."""
        os.makedirs(self._path("_revisions"), exist_ok=True)
        project = self._path("project.json")
        row = {"id": 1, "project_id": "default", "root_path": corpus, "contract_version": CONTRACT_VERSION, "schema_version": 1, "created_at_unix": int(time.time())}
        if self._create(project, row):
            return True
        found = json.load(open(project))
        if found["root_path"] != corpus or found["contract_version"] != CONTRACT_VERSION:
            raise ValueError(f"{project} belongs to {found['root_path']}, contract {found['contract_version']}")
        return False

    def exists(self) -> bool:
        return os.path.isfile(self._path("project.json"))

    def drop(self) -> None:
        shutil.rmtree(self.root, ignore_errors=True)

    def _create(self, path: str, value: dict) -> bool:
        """Whole content or nothing, and only one creator."""
        draft = f"{path}.{uuid.uuid4().hex}.draft"
        with open(draft, "w") as f:
            json.dump(value, f)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, path)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)

    def current(self) -> Pointer | None:
        numbers = [int(n[:-5]) for n in os.listdir(self._path("_revisions")) if n.endswith(".json")] if os.path.isdir(self._path("_revisions")) else []
        if not numbers:
            return None
        with open(self._path("_revisions", f"{max(numbers)}.json")) as f:
            found = json.load(f)
        if found.get("schema_version", 1) > SCHEMA_VERSION:
            raise ValueError(f"schema version {found['schema_version']} is newer than {SCHEMA_VERSION}")
        return Pointer(**{"schema_version": 1} | found)

    def publish(self, baseline: Pointer | None, tables: dict[str, DataFrame], manifest_hash: str, pack: str, now: int | None = None) -> Pointer:
        """Write tables as the revision after baseline; StaleBaseline if that is not current any more."""
        self._check(baseline)
        data = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(self._path("data", data, name))
        self._check(baseline)
        made = max(int(now if now is not None else time.time()), baseline.created_at_unix if baseline else 0)
        pointer = Pointer((baseline.id if baseline else 0) + 1, data, manifest_hash, pack, made, baseline.id if baseline else 0)
        if not self._create(self._path("_revisions", f"{pointer.id}.json"), asdict(pointer)):
            raise StaleBaseline(f"revision {pointer.id} exists")
        return pointer

    def _check(self, baseline: Pointer | None) -> None:
        found = self.current()
        if (found.id if found else 0) != (baseline.id if baseline else 0):
            raise StaleBaseline(f"the baseline is {baseline.id if baseline else 0}, current is {found.id if found else 0}")

    def read(self, name: str, pointer: Pointer | None) -> DataFrame:
        """A table of one revision; columns that an older schema lacks are null. No revision: empty."""
        if name == "revisions":
            return self.revisions()
        if name == "project":
            row = json.load(open(self._path("project.json")))
            return self.spark.createDataFrame([tuple(row[f] for f in TABLES[name].names)], TABLES[name])
        if name == "findings":
            return self.findings(pointer)
        if pointer is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(self._path("data", pointer.data, name))

    def revisions(self) -> DataFrame:
        folder, rows = self._path("_revisions"), []
        current = self.current()
        for name in os.listdir(folder) if current else []:
            if name.endswith(".json"):
                p = Pointer(**json.load(open(os.path.join(folder, name))))
                rows.append((p.id, p.revision_id, p.manifest_hash, p.parser_pack_version, p.created_at_unix, p.id == current.id))
        return self.spark.createDataFrame(sorted(rows), TABLES["revisions"])

    # findings: an append-only log, as they make no revision; stale ids are recorded with the revision that made them so

    def _finding_rows(self) -> list[dict]:
        folder = self._path("findings")
        names = sorted((int(n[:-5]) for n in os.listdir(folder) if n.endswith(".json"))) if os.path.isdir(folder) else []
        return [json.load(open(os.path.join(folder, f"{n}.json"))) for n in names]

    def add_finding(self, row: dict) -> int:
        os.makedirs(self._path("findings"), exist_ok=True)
        number = max((r["id"] for r in self._finding_rows()), default=0) + 1
        while not self._create(self._path("findings", f"{number}.json"), row | {"id": number}):
            number += 1
        return number

    def _stale(self) -> set[int]:
        path = self._path("stale")
        return {int(n) for n in os.listdir(path)} if os.path.isdir(path) else set()

    def findings(self, pointer: Pointer | None) -> DataFrame:
        stale = self._stale()
        rows = [r | {"status": "stale" if r["id"] in stale else "current"} for r in self._finding_rows()]
        return self.spark.createDataFrame([tuple(r[f] for f in TABLES["findings"].names) for r in rows], TABLES["findings"])

    def mark_stale(self, ids: list[int]) -> None:
        os.makedirs(self._path("stale"), exist_ok=True)
        for n in ids:
            open(self._path("stale", str(n)), "w").close()

    def purge_findings(self, session: str) -> int:
        gone = [r["id"] for r in self._finding_rows() if r["session_id"] != session]
        for n in gone:
            os.unlink(self._path("findings", f"{n}.json"))
        return len(gone)

    def sweep(self, older_than: float) -> list[str]:
        """Remove data folders that no pointer names and that are older than the deadline of a sync."""
        folder = self._path("data")
        named = {json.load(open(self._path("_revisions", n)))["data"] for n in os.listdir(self._path("_revisions")) if n.endswith(".json")}
        gone = [d for d in (os.listdir(folder) if os.path.isdir(folder) else []) if d not in named and time.time() - os.path.getmtime(os.path.join(folder, d)) > older_than]
        for d in gone:
            shutil.rmtree(os.path.join(folder, d), ignore_errors=True)
        return gone

    def forget_before(self, keep: int) -> None:
        """Drop the tables of all but the last `keep` revisions; their log entries stay."""
        current = self.current()
        for n in range(1, (current.id if current else 0) - keep + 1):
            p = self._path("_revisions", f"{n}.json")
            if os.path.exists(p):
                shutil.rmtree(self._path("data", Pointer(**json.load(open(p))).data), ignore_errors=True)

