"""Corpus sources: a directory tree, or rows of documents or pages, as one row per file with its bytes."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.ignore import IGNORE_FILES, MARKER_DIR, IgnoreRules, excluded_dir

#: Languages by extension, as far as the index names them.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "ts": "typescript", "tsx": "tsx",
    "rs": "rust", "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp",
    "cs": "csharp", "swift": "swift", "dart": "dart", "rb": "ruby", "php": "php", "pl": "perl", "pm": "perl", "lua": "lua", "jl": "julia", "ml": "ocaml",
    "hs": "haskell", "ex": "elixir", "exs": "elixir", "erl": "erlang", "sol": "solidity", "sh": "bash", "sql": "sql", "html": "html", "htm": "html",
    "css": "css", "json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml", "md": "markdown",
}
SNIFF_BYTES = 8000


def language_of(path: Column) -> Column:
    """The language of a path by its extension, by a map of fixed size; null if unknown."""
    name = F.element_at(F.split(path, "/"), -1)
    extension = F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1)))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(known, F.coalesce(extension, F.lit("")))


def classified(files: DataFrame) -> DataFrame:
    """(path, bytes) with file_kind, content, content_hash, byte_len, lossy and language: columns only, no Python.

    A NUL byte in the first 8000 makes a file binary, without content. Ill-formed UTF-8 is replaced and flagged.
    """
    data = F.col("bytes")
    binary = F.position(F.lit(b"\x00"), F.substring(data, 1, SNIFF_BYTES)) > 0
    text = F.make_valid_utf8(data.cast("string"))
    return files.select(
        "path", F.when(binary, "binary").otherwise("indexed").alias("file_kind"), F.when(~binary, text).alias("content"), F.sha2(data, 256).alias("content_hash"),
        F.octet_length(data).cast("long").alias("byte_len"), (~binary & ~F.is_valid_utf8(data.cast("string"))).alias("lossy"), F.when(~binary, language_of(F.col("path"))).alias("language"),
    )


def from_documents(docs: DataFrame) -> DataFrame:
    """Documents as files: source/doc_id.lang."""
    return docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"), F.col("text").cast("binary").alias("bytes"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Pages as files: their place on their host, with .html behind it."""
    place = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    return pages.select(F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit("/"), F.regexp_replace(place, r"/$", ""), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("bytes"))


@dataclass(frozen=True)
class Listing:
    """Files to index, sorted by path, and what was left out, with the reason."""

    files: list[tuple[str, int]]
    skipped: list[tuple[str, str]]
    rules: IgnoreRules
    directories: list[str]


def list_files(root: str, everywhere: str = "") -> Listing:
    """Walk a tree on the driver: hidden files too, links not followed, ignore rules on; one bad entry is skipped."""
    texts: dict[str, str] = {}
    files: list[tuple[str, int]] = []
    skipped: list[tuple[str, str]] = []
    directories: list[str] = []
    exclude = os.path.join(root, ".git", "info", "exclude")
    own_exclude = ""
    if os.path.isfile(exclude) and any(os.path.isfile(os.path.join(root, x)) for x in IGNORE_FILES):
        own_exclude = open(exclude, errors="replace").read()
    rules = IgnoreRules.of(texts, own_exclude, everywhere)
    todo = [""]
    while todo:
        folder = todo.pop()
        directories.append(folder)
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except OSError as e:
            skipped.append((folder, str(e)))
            continue
        own = {e.name: e for e in entries if e.name in IGNORE_FILES and e.is_file(follow_symlinks=False)}
        for name in own:
            path = f"{folder}/{name}" if folder else name
            texts[path] = open(os.path.join(root, path), errors="replace").read()
        if own:
            rules = IgnoreRules.of(texts, own_exclude, everywhere)
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            try:
                path.encode()
                if e.is_symlink():
                    continue
                if e.is_dir(follow_symlinks=False):
                    if not excluded_dir(path) and not rules.ignored(path, True):
                        todo.append(path)
                elif e.is_file(follow_symlinks=False) and not rules.ignored(path):
                    files.append((path, e.stat(follow_symlinks=False).st_size))
            except (OSError, UnicodeEncodeError) as err:
                skipped.append((repr(path), str(err)))
    return Listing(sorted(files), sorted(skipped), rules, sorted(directories))


def read_files(spark: SparkSession, root: str, paths: list[tuple[str, int]], max_bytes: int) -> DataFrame:
    """(path, bytes, skip): the listed files, read by the executors, which must see root; too large ones have a reason
    and no bytes. binaryFile is not used as it leaves out names that start with a dot or an underscore."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                data, skip = None, None
                try:
                    if os.path.getsize(os.path.join(root, path)) > max_bytes:
                        skip = "larger than the limit"
                    else:
                        with open(os.path.join(root, path), "rb") as f:
                            data = f.read(max_bytes + 1)
                        if len(data) > max_bytes:
                            data, skip = None, "larger than the limit"
                except OSError as e:
                    skip = str(e)
                yield pd.DataFrame({"path": [path], "bytes": [data], "skip": [skip]})

    listing = spark.createDataFrame(paths, "path string, size bigint")
    tasks = max(1, min(len(paths) // 50 + 1, 512))
    return listing.repartition(tasks, "path").mapInPandas(read, "path string, bytes binary, skip string")


def find_root(start: str) -> str:
    """The nearest folder at or above start that holds the marker; refuses a marker that is a link."""
    here = os.path.realpath(start)
    here = os.path.dirname(here) if os.path.isfile(here) else here
    while True:
        marker = os.path.join(here, MARKER_DIR)
        if os.path.islink(marker):
            raise PermissionError(f"{marker} is a link")
        if os.path.isdir(marker):
            return here
        if os.path.dirname(here) == here:
            raise LookupError(f"no corpus is enabled at or above {start}")
        here = os.path.dirname(here)
