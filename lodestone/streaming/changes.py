"""The change stream: events to keyed sets of paths, batches with a checkpoint, and the watcher's state."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.ignore import IGNORE_FILES, IgnoreRules, excluded

EVENTS = "seq bigint, path string, kind string"

HEALTHY, NEEDS_VERIFICATION, DESYNCED, UNAVAILABLE = "Healthy", "NeedsVerification", "Desynced", "Unavailable"


def change_of(kind: Column) -> Column:
    """remove: deleted; modify and create: dirty; others are no change."""
    return F.when(kind == "remove", "deleted").when(kind.isin("modify", "create"), "dirty")


def collapse(events: DataFrame) -> DataFrame:
    """(path, change, seq): the last change of each path by sequence; a later delete supersedes a modify and a later
    create a delete, so that a file deleted and made again is not lost."""
    changes = events.select("path", "seq", change_of(F.col("kind")).alias("change")).filter("change is not null")
    return changes.groupBy("path").agg(F.max(F.struct("seq", "change")).alias("last")).select("path", "last.change", "last.seq")


def is_ignore_file(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1).isin(*IGNORE_FILES)


@dataclass
class Watch:
    """What a corpus has pending; a set by path, acknowledged only up to the sequence that was read."""

    health: str = NEEDS_VERIFICATION
    sequence: int = 0
    verified: int = 0
    pending: dict[str, tuple[str, int]] = field(default_factory=dict)
    full_publishes: int = 0

    def record(self, path: str, kind: str, rules: IgnoreRules | None = None) -> None:
        if path.rsplit("/", 1)[-1] in IGNORE_FILES:
            self.health = NEEDS_VERIFICATION if self.health == HEALTHY else self.health
        elif excluded(path) or (rules and rules.ignored(path)):
            return
        change = {"remove": "deleted", "modify": "dirty", "create": "dirty"}.get(kind)
        if change:
            self.sequence += 1
            self.pending[path] = (change, self.sequence)

    def snapshot(self) -> tuple[int, dict[str, str]]:
        return self.sequence, {p: c for p, (c, _) in self.pending.items()}

    def acknowledge(self, upto: int) -> None:
        self.pending = {p: x for p, x in self.pending.items() if x[1] > upto}
        self.verified = max(self.verified, upto)

    def trusted(self) -> bool:
        return self.health == HEALTHY

    def phase(self, revision_id: str | None) -> str:
        if self.health == UNAVAILABLE:
            return "unavailable"
        if self.health in (NEEDS_VERIFICATION, DESYNCED):
            return "restoring"
        return "importing" if revision_id is None else "restoring" if self.pending else "steady_state"


def drain(spark: SparkSession, source: str, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> None:
    """Collapse what has arrived in the event folder (Parquet files of EVENTS) and apply it, once a micro-batch.

    The checkpoint holds the offsets, so that a restart goes on where it ended; apply must be idempotent by batch.
    """
    stream = spark.readStream.schema(EVENTS).parquet(source)
    query = stream.writeStream.foreachBatch(lambda df, n: apply(collapse(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def until_quiet(step: Callable[[], bool], most: int = 16) -> int:
    """Run step until it finds nothing more; RuntimeError after `most` loops."""
    for n in range(most):
        if not step():
            return n
    raise RuntimeError(f"the corpus kept changing over {most} rounds")
