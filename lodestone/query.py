"""Guarded read-only SQL with paging and budgets, and the JSON encoding of rows."""

from __future__ import annotations

import datetime
import decimal
import json
import math
import re
import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lodestone.functions.translate import Token, Untranslatable, tokens_of, written
from lodestone.limits import DEFAULT, Limits
from lodestone.schema import TABLES
from lodestone.session import materialise


class QueryError(ValueError):
    pass


#: Logical plan classes of statements that read: fixed values. Anything else is refused.
READING = {
    "Project", "Filter", "UnresolvedRelation", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "Aggregate", "UnresolvedHaving", "Sort", "GlobalLimit", "LocalLimit", "Limit", "Offset", "Distinct",
    "Union", "Intersect", "Except", "Join", "UnresolvedInlineTable", "ResolvedInlineTable", "LocalRelation", "OneRowRelation", "UnresolvedWith", "WithWindowDefinition", "Window", "Generate", "LateralJoin", "Pivot", "Unpivot",
    "UnresolvedTableValuedFunction", "Sample", "View", "UnresolvedTVFAliases", "Range", "CTERelationDef", "CTERelationRef", "WithCTE", "UnresolvedAsOfJoin", "Tail",
}


@dataclass
class Page:
    revision_id: str | None
    rows: list[dict]
    truncated: bool
    next_offset: int | None


#: Words that no statement may hold outside literals: functions that run any code of the JVM or read files, and
#: names made up at run time, which no check of the text could see.
REFUSED = {"reflect", "java_method", "try_reflect", "identifier", "from_protobuf", "to_protobuf", "read_files", "python_worker_logs"}


def words(tokens: list[Token]) -> Iterator[str]:
    for t in tokens:
        if t.kind in ("word", "name"):
            yield (t.text if t.kind == "word" else t.text[1:-1]).lower()
        if t.inner:
            yield from words(t.inner)


def nodes(plan) -> Iterator:
    """Every node of a parsed plan, those of common table expressions and of subqueries in expressions included."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        for children in (node.children(), node.innerChildren()):
            todo += [children.apply(k) for k in range(children.size())]


def checked(spark: SparkSession, text: str, limits: Limits = DEFAULT, tables: frozenset[str] = frozenset(TABLES)) -> str:
    """One reading statement in Spark's spelling, without a final semicolon; QueryError else.

    Judged by its parsed plan, not its words: it may hold reading nodes only, and name no relation but `tables`
    and its own common table expressions. Functions that reach the JVM or files are refused by name.
    """
    if len(text.encode()) > limits.query_text_bytes:
        raise QueryError(f"the statement exceeds {limits.query_text_bytes} bytes")
    sql = re.sub(r"[\s;]+$", "", text.strip())
    if not sql:
        raise QueryError("the statement is empty")
    try:
        tokens = tokens_of(sql)
        sql = written(tokens)
    except Untranslatable as e:
        raise QueryError(str(e)) from e
    if any(t.kind == "op" and t.text == ";" for t in tokens):
        raise QueryError("one statement at a time")
    if found := REFUSED.intersection(words(tokens)):
        raise QueryError(f"{min(found)} is not allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(f"SELECT * FROM (\n{sql}\n)")
        inner = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise QueryError(str(getattr(e, "_desc", None) or e).split("\n", 1)[0]) from e
    known = tables | {name.lower() for name, *_ in expressions_of(tokens)[0]}
    for p in (plan, inner):
        for node in nodes(p):
            name = node.getClass().getSimpleName().rstrip("$")
            if name not in READING:
                raise QueryError(f"{name} is not a reading statement")
            if name == "UnresolvedRelation":
                parts = node.multipartIdentifier()
                if parts.size() != 1 or parts.apply(0).lower() not in known:
                    raise QueryError(f"there is no table {parts.mkString('.')}")
    return sql


def expressions_of(tokens: list[Token]) -> tuple[list[tuple[str, list[str], list[Token], list[Token]]], list[Token]]:
    """The common table expressions of a statement (name, columns, its own tokens, body), nested ones too behind
    them, and the tokens of the statement that follows them."""
    found, at = [], 0
    if tokens and tokens[0].is_word("with"):
        at = 1 + (len(tokens) > 1 and tokens[1].is_word("recursive"))
        while at < len(tokens):
            start, name = at, tokens[at].text if tokens[at].kind == "word" else tokens[at].text[1:-1]
            at += 1
            columns = []
            if at < len(tokens) and tokens[at].kind == "group":
                columns = [t.text if t.kind == "word" else t.text[1:-1] for t in tokens[at].inner if t.kind in ("word", "name")]
                at += 1
            while at < len(tokens) and tokens[at].is_word("as", "not", "materialized"):
                at += 1
            if at >= len(tokens) or tokens[at].kind != "group":
                break
            found.append((name, columns, tokens[start : at + 1], tokens[at].inner))
            at += 1
            if at >= len(tokens) or tokens[at].text != ",":
                break
            at += 1
    nested = [x for t in tokens if t.inner for x in expressions_of(t.inner)[0]]
    return found + nested, tokens[at:]


def result(spark: SparkSession, text: str, limits: Limits = DEFAULT) -> DataFrame:
    """What a checked statement gives. Recursion that drops repeated rows (UNION), which Spark lacks, is run here,
    round by round, for expressions at the head of the statement."""
    tokens = tokens_of(re.sub(r"[\s;]+$", "", text.strip()))
    if not tokens[0].is_word("with") or not tokens[1].is_word("recursive"):
        return spark.sql(f"SELECT * FROM (\n{written(tokens)}\n)")
    every, rest = expressions_of(tokens)
    kept: list[str] = []

    def headed(sql: str) -> str:
        return f"WITH RECURSIVE {', '.join(kept)} {sql}" if kept else sql

    # nested expressions stand behind those of the head and are part of their bodies
    heads = [x for x in every if any(x[2] and x[2][0] is t for t in tokens)]
    for name, columns, own, body in heads:
        at = next((k for k, t in enumerate(body) if t.is_word("union") and not body[k + 1].is_word("all")), None)
        if at is not None and name.lower() in words(body[at:]):
            reached(spark, name, columns, headed(written(body[:at])), headed(written(body[at + 1 :])), limits)
        else:
            kept.append(written(own))
    return spark.sql(f"SELECT * FROM (\n{headed(written(rest))}\n)")


#: Rows up to which a recursion's rows are held by the driver; beyond, they are tables of the shared folder.
SMALL = 5000


def reached(spark: SparkSession, name: str, columns: list[str], seed: str, step: str, limits: Limits) -> None:
    """A view `name` of all rows that the seed and repeated steps over the rows found last give, each row once."""
    first = spark.sql(seed)
    first = (first.toDF(*columns) if columns else first).distinct()
    schema = StructType([StructField(f.name, f.dataType) for f in first.schema])
    names = first.columns

    def held(df: DataFrame) -> tuple[list | None, DataFrame]:
        rows = df.limit(SMALL + 1).collect()
        if len(rows) <= SMALL:
            return rows, spark.createDataFrame(rows, schema)
        return None, materialise(df, "reached")

    rows, found = held(first)
    last, seen = found, None if rows is None else set(map(tuple, rows))
    total = len(rows) if rows is not None else found.count()
    for _ in range(limits.query_recursion_levels):
        last.createOrReplaceTempView(name)
        following = spark.sql(step).toDF(*names)
        following = following.select(*[F.col(f.name).cast(f.dataType) for f in schema]).distinct()
        if seen is None:
            same = [following[c].eqNullSafe(found[c]) for c in names]
            following = following.join(found, reduce(lambda a, b: a & b, same), "left_anti")
        rows, last = held(following)
        if seen is not None and rows is not None:
            rows = [r for r in rows if tuple(r) not in seen]
            last = spark.createDataFrame(rows, schema)
        elif seen is not None:
            seen = None
            last = materialise(last.join(found, reduce(lambda a, b: a & b, [last[c].eqNullSafe(found[c]) for c in names]), "left_anti"), "reached")
        n = len(rows) if rows is not None else last.count()
        if not n:
            found.createOrReplaceTempView(name)
            return
        total += n
        if total > limits.query_recursion_rows:
            break
        if seen is not None:
            seen.update(map(tuple, rows))
            found = spark.createDataFrame([*seen], schema) if len(seen) <= SMALL else materialise(spark.createDataFrame([*seen], schema), "reached")
            seen = seen if len(seen) <= SMALL else None
        else:
            found = materialise(found.unionByName(last), "reached")
    raise QueryError("the recursion exceeds its budget")


def encoded(value: object) -> object:
    """A cell as JSON: non-finite numbers null, bytes as lower-case hex, decimals as text, times as ISO text."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, bytes | bytearray):
        return bytes(value).hex()
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, datetime.datetime | datetime.date):
        return value.isoformat()
    if isinstance(value, datetime.timedelta):
        return value.total_seconds()
    if isinstance(value, dict):
        return {str(k): encoded(v) for k, v in value.items()}
    if hasattr(value, "asDict"):
        return {k: encoded(v) for k, v in value.asDict().items()}
    if isinstance(value, list | tuple):
        return [encoded(v) for v in value]
    return value


def _size(value: object) -> int:
    return len(value) if isinstance(value, bytes | bytearray) else len(value.encode()) if isinstance(value, str) else 8


def page(df: DataFrame, offset: int, revision_id: str | None, limits: Limits = DEFAULT) -> Page:
    """Rows from offset on: at most the row limit, then as many from the front as the response may hold."""
    if offset < 0:
        raise QueryError("offset is negative")
    found = df.offset(offset).limit(limits.query_rows + 1).collect()
    rows = []
    for r in found[: limits.query_rows]:
        for name, value in zip(df.columns, r, strict=True):
            if _size(value) > limits.query_value_bytes:
                raise QueryError(f"a value of {name} exceeds {limits.query_value_bytes} bytes")
        rows.append({name: encoded(value) for name, value in zip(df.columns, r, strict=True)})
    return shrunk(rows, len(found) > limits.query_rows, offset, revision_id, limits)


def shrunk(rows: list[dict], more: bool, offset: int, revision_id: str | None, limits: Limits = DEFAULT) -> Page:
    sizes = [len(json.dumps(r, ensure_ascii=False).encode()) + 1 for r in rows]
    room, n = limits.query_response_bytes - 256, 0
    while n < len(rows) and room >= sizes[n]:
        room -= sizes[n]
        n += 1
    truncated = more or n < len(rows)
    return Page(revision_id, rows[:n], truncated, offset + n if truncated else None)


def within(spark: SparkSession, seconds: float, work):
    """work() with Spark's jobs cancelled beyond the time; QueryError names the budget."""
    tag, over = f"lodestone-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        over.set()
        spark.interruptTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.addTag(tag)
    timer.start()
    try:
        return work()
    except Exception as e:
        if over.is_set():
            raise QueryError(f"the statement exceeded its budget of {seconds} seconds") from e
        if isinstance(e, PySparkException):
            raise QueryError(str(e).split("\n", 1)[0]) from e
        raise
    finally:
        timer.cancel()
        spark.removeTag(tag)
