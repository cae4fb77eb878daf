"""Column helpers for what the embedded engine's SQL has and Spark's lacks, or does otherwise."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def like_ci(value: Column, pattern: str) -> Column:
    """LIKE that ignores the case of ASCII letters only."""
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower(value).like("".join(c.lower() if c.isascii() else c for c in pattern))


def glob_regex(pattern: str) -> str:
    """The regular expression of a GLOB pattern: `*`, `?`, `[...]` and `[^...]`; a `]` first in brackets is plain.

    A bracket that never closes matches nothing.
    """
    out, k = ["^"], 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            out.append("(?s:.*)")
        elif c == "?":
            out.append("(?s:.)")
        elif c == "[":
            start = k + 1 + (pattern[k + 1 : k + 2] == "^")
            end = pattern.find("]", start + 1)
            if end < 0:
                return "(?!)"
            inner = "".join("\\" + x if x in "\\[]^&" else x for x in pattern[start:end])
            out.append(f"[{'^' if start > k + 1 else ''}{inner}]")
            k = end
        else:
            out.append("\\" + c if not c.isalnum() and c.isascii() else c)
        k += 1
    return "".join(out) + "\\z"


def glob(value: Column, pattern: str) -> Column:
    return value.rlike(glob_regex(pattern))


def total(value: Column) -> Column:
    """Sum as a double; 0.0 over no rows."""
    return F.coalesce(F.sum(value.cast("double")), F.lit(0.0))


def group_concat(value: Column, order: Column | None = None, separator: str = ",") -> Column:
    """Concatenation of the non-null values, by `order` where given; null over none. One string a group: bounded by
    the group's size, as the result itself is."""
    if order is None:
        return F.listagg(value.cast("string"), F.lit(separator))
    pairs = F.filter(F.sort_array(F.collect_list(F.struct(order.alias("o"), value.cast("string").alias("v")))), lambda p: p.v.isNotNull())
    return F.when(F.count(value) > 0, F.array_join(F.transform(pairs, lambda p: p.v), separator))


def int_div(a: Column, b: Column) -> Column:
    """Integer division toward zero; null for a zero divisor."""
    return F.when(b != 0, (a - F.when(b != 0, a % b)) / F.when(b != 0, b)).cast("long")


def substr0(value: Column, start: int, length: int) -> Column:
    """substr with the engine's counting: position 0 stands before the first character and uses up one of length;
    a negative start counts from the end, and what lies before the first character uses up length too."""
    n = F.length(value)
    first = F.lit(start) if start >= 0 else n + start + 1
    end = first + length
    begin = F.greatest(first, F.lit(1))
    return F.substr(value, begin, F.greatest(end - begin, F.lit(0)))


def cast_integer(value: Column) -> Column:
    """CAST of text to an integer by its longest numeric prefix; 0 if there is none."""
    digits = F.regexp_extract(value, r"^\s*([+-]?[0-9]{1,18})", 1)
    return F.when(value.isNotNull(), F.coalesce(F.when(digits != "", digits).cast("long"), F.lit(0).cast("long")))


def groups_frame(w_partition: list[str], order: str, before: int, after: int) -> tuple[Column, WindowSpec]:
    """(peer group number, spec) for a GROUPS frame: range over the dense rank. Add the column first, then use the
    spec built by `over_groups`."""
    rank = F.dense_rank().over(Window.partitionBy(*w_partition).orderBy(order))
    return rank, Window.partitionBy(*w_partition).orderBy("_group").rangeBetween(-before, after)


def sum_exclude_current(value: Column, spec: WindowSpec) -> Column:
    """sum over a frame without the current row; null if no other value is in it."""
    others = F.count(value).over(spec) - F.when(value.isNotNull(), 1).otherwise(0)
    return F.when(others > 0, F.sum(value).over(spec) - F.coalesce(value, F.lit(0)))


def strftime(seconds: Column, pattern: str) -> Column:
    """strftime of Unix seconds in UTC for %Y %m %d %H %M %S %j %s %%."""
    names = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD"}
    parts, k = [], 0
    stamp = F.timestamp_seconds(seconds)
    while k < len(pattern):
        if pattern[k] == "%" and k + 1 < len(pattern):
            c = pattern[k + 1]
            parts.append(F.date_format(stamp, names[c]) if c in names else seconds.cast("string") if c == "s" else F.lit(c))
            k += 2
        else:
            parts.append(F.lit(pattern[k]))
            k += 1
    return F.concat(*parts)


def julianday(seconds: Column) -> Column:
    return seconds / 86400.0 + 2440587.5


def json_text(value: Column, path: str) -> Column:
    """`->>`: the value at a path as text."""
    return F.get_json_object(value, path)
