"""Session helpers: a local builder for tests and the shared folder of a cluster."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and single-machine runs; a cluster brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets one
    of our own; on a cluster, where no local folder is shared, RuntimeError."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"lodestone-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of the session's application, once, unless PYTHONPATH names it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="lodestone-package-"), "lodestone.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    context.addPyFile(target)


_made = threading.local()


def _paths() -> list[str]:
    if not hasattr(_made, "paths"):
        _made.paths = []
    return _made.paths


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder, which `scratch` and `discard_all` remove."""
    folder = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"
    _paths().append(folder)
    return f"{folder}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}.parquet")
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._scratch = path.rsplit("/", 1)[0]
    return found


def discard(df: DataFrame) -> None:
    """Removes what `materialise` wrote for df, which nothing may read any more."""
    if getattr(df, "_scratch", None):
        _remove(df.sparkSession, [df._scratch])


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns, materialised, and what make materialised on the way removed."""
    mark = len(_paths())
    found = materialise(make(), name)
    _remove(spark, [p for p in _paths()[mark:] if p != found._scratch])
    _paths()[mark:] = [found._scratch]
    return found


def _remove(spark: SparkSession, paths: list[str]) -> None:
    """Removes folders, and has the driver look for shuffles that nothing refers to any more: executors keep their
    files until the driver's garbage is collected."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        place = jvm.org.apache.hadoop.fs.Path(p)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes what this thread materialises within; results must have been read or written by then."""
    mark = len(_paths())
    try:
        yield
    finally:
        _remove(spark, _paths()[mark:])
        del _paths()[mark:]


def discard_all(spark: SparkSession) -> None:
    """Removes all that this thread has materialised so far; results that still read it are lost."""
    _remove(spark, _paths())
    _paths().clear()
