"""Path arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined(base: Column, rest: Column) -> Column:
    """base/rest with `.` and `..` worked out; `..` stops at the root."""
    parts = F.filter(F.split(F.concat_ws("/", base, rest), "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    step = lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p))
    return F.array_join(F.aggregate(parts, empty, step), "/")


def parent(path: Column) -> Column:
    return F.when(F.position(F.lit("/"), path) > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def cut_bytes(text: Column, most: int) -> Column:
    """text within most UTF-8 bytes, cut at a character."""
    data = text.cast("binary")
    cut = F.substring(data, 1, most)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.regexp_replace(F.make_valid_utf8(cut.cast("string")), "�+$", ""))
