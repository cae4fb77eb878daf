"""Files to typed evidence rows: structure, imports, exports, comments, docstrings, symbols, diagnostics, bindings."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.limits import DEFAULT, Limits
from lodestone.llm.rows import BYTES, slices
from lodestone.operators.syntax import Node, Tree, available, parse

#: Node kinds of bindings, fields and imports: fixed values.
BINDINGS = {"let_declaration", "const_declaration", "var_declaration", "val_declaration", "binding", "parameter", "assignment"}
FIELDS = {"field_declaration", "property_declaration", "field_definition", "public_field_definition", "property_signature"}
IMPORTS = {
    "import_statement", "import_from_statement", "import_declaration", "import_header", "using_directive", "using_statement", "import_directive", "import_specification",
    "library_import", "use_statement", "namespace_use_declaration", "preproc_include", "open_module", "pp_include_lib", "import",
}
STRUCTURES = {"function_definition": "Function", "class_definition": "Class", "heading": "Heading"}
HTML_STRUCTURES = {"h1", "h2", "h3", "h4", "h5", "h6", "title", "article", "section"}

Row = tuple[str, str, str, Node | None, dict]
SPANS = ["start_byte", "end_byte", "start_line", "start_column", "end_line", "end_column"]
EVIDENCE = "ord bigint, key string, kind string, origin string, span_availability string, " + ", ".join(f"{c} bigint" for c in SPANS) + ", payload string"
STATUS = "parser_availability string, parse_outcome string, parse_error_reason string, extraction_completeness string"


def _name(node: Node, tree: Tree) -> str | None:
    """The first identifier among the children, or up to three levels down; type names don't count."""
    level = [node]
    for c in node.children:
        if c.kind == "identifier" and c.field == "name":
            return tree.source.slice(c)
    for _ in range(4):
        for n in level:
            for c in n.children:
                if c.kind == "identifier" and c.field not in ("type", "annotation", "returns"):
                    return tree.source.slice(c)
        level = [c for n in level for c in n.children if c.field not in ("type", "annotation", "returns")]
    return None


def _structures(tree: Tree, language: str) -> Iterator[Row]:
    k = 0
    for n in tree.root.walk():
        kind = STRUCTURES.get(n.kind) or ("Element" if n.kind == "element" and n.attrs["tag"] in HTML_STRUCTURES else None)
        if not kind:
            continue
        node = n.attrs.get("ast")
        if language == "html":
            name = " ".join(tree.source.slice(c) for c in n.walk() if c.kind == "text")
        else:
            name = _name(n, tree)
        decorators = [ast.unparse(d) for d in getattr(node, "decorator_list", [])]
        signature = tree.source.slice(n).split("\n", 1)[0].strip()
        visibility = "private" if name and name.startswith("_") else "public"
        yield f"structure:{k}", "Structure", "PackStructure", n, {"kind": n.attrs["tag"] if kind == "Element" else kind, "name": name, "visibility": visibility, "decorators": decorators, "signature": signature}
        k += 1


def _imports(tree: Tree, language: str) -> Iterator[Row]:
    k = 0
    for n in tree.root.walk():
        node = n.attrs.get("ast")
        payload = None
        if isinstance(node, ast.Import | ast.ImportFrom):
            payload = {"source": tree.source.slice(n), "items": [a.name for a in node.names], "alias": next((a.asname for a in node.names if a.asname), None), "is_wildcard": any(a.name == "*" for a in node.names)}
        elif language == "html" and n.kind == "element" and n.attrs["attributes"].get("href"):
            payload = {"source": n.attrs["attributes"]["href"], "items": [], "alias": None, "is_wildcard": False}
        if payload:
            yield f"import:{k}", "Import", "PackStructure", n, payload
            k += 1


def _generic_imports(tree: Tree) -> Iterator[Row]:
    """Import statements by node kind, outermost only; for languages whose parser reports none."""
    k, todo = 0, [tree.root]
    while todo:
        n = todo.pop()
        if n.kind in IMPORTS:
            text = tree.source.slice(n).strip()
            yield f"generic_import:{k}", "Import", "GenericWalker", n, {"source": text, "items": [], "alias": None, "is_wildcard": "*" in text}
            k += 1
        else:
            todo += reversed(n.children)


def _exports(tree: Tree, language: str) -> Iterator[Row]:
    k = 0
    for n in tree.root.children:
        node = n.attrs.get("ast")
        if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets) and isinstance(node.value, ast.List | ast.Tuple):
            for x in node.value.elts:
                if isinstance(x, ast.Constant) and isinstance(x.value, str):
                    yield f"export:{k}", "Export", "PackStructure", n, {"name": x.value, "kind": "Named"}
                    k += 1
    if language in {"javascript", "typescript", "jsx", "tsx"}:
        for n in tree.root.children:
            line_start = tree.source.data.rfind(b"\n", 0, n.start) + 1
            if n.children and re.match(rb"\s*export\b", tree.source.data[line_start : n.start + 1]):
                yield f"export:{k}", "Export", "PackStructure", n, {"name": tree.source.slice(n.children[0]), "kind": "Named"}
                k += 1


def _comments(tree: Tree) -> Iterator[Row]:
    for k, n in enumerate(n for n in tree.root.walk() if n.kind == "comment"):
        text = tree.source.slice(n)
        yield f"comment:{k}", "Comment", "PackStructure", n, {"text": text, "kind": "Block" if text.startswith(("/*", "<!--", "(*")) else "Line", "associated_node": None}


def _docstrings(tree: Tree) -> Iterator[Row]:
    k = 0
    for n in tree.root.walk():
        node = n.attrs.get("ast")
        if isinstance(node, ast.Module | ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef) and (text := ast.get_docstring(node)) is not None:
            body = next((c for c in n.children if c.kind == "expression_statement"), n)
            yield f"docstring:{k}", "Docstring", "PackStructure", body, {"text": text, "format": "PythonTripleQuote", "associated_item": getattr(node, "name", None)}
            k += 1


def _symbols(tree: Tree, language: str) -> Iterator[Row]:
    k = 0
    for n in tree.root.walk():
        if n.kind in ("function_definition", "class_definition") and (name := _name(n, tree)):
            yield f"symbol:{k}", "Symbol", "PackSymbol", n, {"name": name, "kind": STRUCTURES[n.kind], "type_annotation": None, "doc": None}
            k += 1


def _bindings(tree: Tree) -> Iterator[Row]:
    k = 0
    for n in tree.root.walk():
        field = n.kind in FIELDS
        if (field or n.kind in BINDINGS) and (name := _name(n, tree)):
            kind = 'Other("Field")' if field else "Constant" if n.kind.startswith("const") else "Variable"
            yield f"{'field' if field else 'variable'}:{k}", "Symbol", "GenericWalker", n, {"name": name, "kind": kind, "type_annotation": None, "doc": None}
            k += 1


def _diagnostics(tree: Tree) -> Iterator[Row]:
    for k, (message, severity, start, end) in enumerate(tree.errors):
        yield f"diagnostic:{k}", "Diagnostic", "PackStructure", Node("error", start, end), {"message": message, "severity": severity}


Extractor = Callable[[Tree, str], Iterator[Row]]
#: In the order of the evidence of a file. More may be registered.
EXTRACTORS: list[Extractor] = [_structures, _imports, _exports, lambda t, _: _comments(t), lambda t, _: _docstrings(t), _symbols, lambda t, _: _diagnostics(t)]


def extract(language: str, text: str) -> list[Row]:
    tree = parse(language, text)
    rows = [row for f in EXTRACTORS for row in f(tree, language)]
    rows += _bindings(tree)
    if not any(r[1] == "Import" for r in rows):
        rows += _generic_imports(tree)
    return [(*r[:3], _spanned(r[3], tree), r[4]) for r in rows]


def _spanned(node: Node | None, tree: Tree) -> list[int | None] | None:
    if node is None or node.end < node.start:
        return None
    (a, b), (c, d) = tree.source.place(node.start), tree.source.place(node.end)
    return [node.start, node.end, a, b, c, d]


def analyze(content: str | None, language: str | None, lossy: bool = False) -> tuple[tuple, list[tuple]]:
    """(status, evidence rows) of one file; status as in STATUS, rows as in EVIDENCE.

    No content or language: not attempted. A parser that fails: Failed with its reason. An error among the
    diagnostics: SyntaxErrors. Replaced bytes are reported after the outcome is decided.
    """
    rows: list = []
    if content is None or language is None or not available(language):
        status = ("Unavailable", "NotAttempted", None, "Unavailable")
    else:
        try:
            rows = extract(language, content)
            failed = any(r[1] == "Diagnostic" for r in rows)
            status = ("Available", "SyntaxErrors" if failed else "Succeeded", None, "Partial")
        except Exception as e:  # noqa: BLE001  a parser's failure is a result of its own
            status = ("Available", "Failed", f"{type(e).__name__}: {e}", "Unavailable")
    if lossy:
        rows = [*rows, ("encoding:0", "Diagnostic", "SourceContent", None, {"message": "content is not valid UTF-8; ill-formed bytes were replaced", "severity": "warning"})]
    out = []
    for k, (key, kind, origin, span, payload) in enumerate(rows):
        have = "Present" if span else "DerivedEvidence" if origin == "SourceContent" else "NormalizerUnavailable"
        out.append((k, key, kind, origin, have, *(span or [None] * 6), json.dumps(payload, ensure_ascii=False, separators=(",", ":"))))
    return status, out


#: Bytes that an evidence row counts beside its payload.
ROW_BYTES = 200
_ARROW = {"string": pa.string(), "bigint": pa.int64()}
_FIELDS = [pa.field(name, _ARROW[kind]) for name, kind in (c.split() for c in EVIDENCE.split(", "))]


def _analyses(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Files in a row, and what `analyze` gives for each: as many at once as keep their texts and evidence below a bound
    of bytes, one at least."""
    content, language, lossy = (columns.index(c) for c in ("content", "language", "lossy"))
    for batch in slices("extract", batches, content):
        first, size = 0, 0
        found: list[tuple] = []
        for k in range(batch.num_rows):
            found.append(analyze(batch.column(content)[k].as_py(), batch.column(language)[k].as_py(), bool(batch.column(lossy)[k].as_py())))
            size += sum(len(r[-1]) + ROW_BYTES for r in found[-1][1])
            if size >= BYTES or k == batch.num_rows - 1:
                yield batch.slice(first, k + 1 - first), found
                first, size, found = k + 1, 0, []


def _flat(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_FIELDS)]


def analyzed(files: DataFrame) -> DataFrame:
    """files (path, content, language, lossy and others) with the parser's status and `rows`, the evidence of each."""
    columns = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*columns, *(c.split()[0] for c in STATUS.split(", ")), "rows"]
        for files, found in _analyses(batches, columns):
            status = [pa.array([s[k] for s, _ in found], pa.string()) for k in range(len(STATUS.split(", ")))]
            ends = pa.array([0, *accumulate(len(rows) for _, rows in found)], pa.int32())
            rows = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(_flat([r for _, rows in found for r in rows]), fields=_FIELDS))
            yield pa.record_batch([*files.columns, *status, rows], names)

    struct = "array<struct<" + ", ".join(f"{c.split()[0]}:{c.split()[1]}" for c in EVIDENCE.split(", ")) + ">>"
    return files.mapInArrow(run, StructType([*files.schema.fields, *StructType.fromDDL(f"{STATUS}, rows {struct}").fields]))


def path_evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, content, language, lossy) to path and EVIDENCE."""
    for files, found in _analyses(batches, ["path", "content", "language", "lossy"]):
        paths = [p for p, (_, rows) in zip(files.column(0).to_pylist(), found, strict=True) for _ in rows]
        yield pa.record_batch([pa.array(paths, pa.string()), *_flat([r for _, rows in found for r in rows])], ["path", *(f.name for f in _FIELDS)])


def evidence_of(files: DataFrame) -> DataFrame:
    """The evidence rows of files (path, content, language, lossy) in one narrow pass, without their status."""
    return files.select("path", "content", "language", "lossy").mapInArrow(path_evidence, f"path string, {EVIDENCE}")


def evidence_rows(analyzed_files: DataFrame) -> DataFrame:
    return analyzed_files.select("path", F.explode("rows").alias("r")).select("path", "r.*")


def capped(evidence: DataFrame, limits: Limits = DEFAULT, key: str = "path") -> DataFrame:
    """Evidence within the limits of each file, and a marker where some was dropped.

    Items over the item limit are skipped first; then, in order, the first item that breaks the count or the byte
    limit ends the file. One slot and a reserve of bytes are the marker's. The marker counts the items kept and
    those there were. A window of each file by order, which one file's evidence bounds.
    """
    size = F.octet_length("payload").cast("long")
    marked = evidence.withColumn("_size", size).withColumn("_fits", F.col("_size") <= limits.evidence_item_bytes)
    order = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    room = limits.evidence_file_bytes - limits.evidence_reserve_bytes
    kept_size = F.sum(F.when(F.col("_fits"), F.col("_size")).otherwise(0)).over(order)
    place = F.sum(F.when(F.col("_fits"), 1).otherwise(0)).over(order)
    judged = marked.withColumn("_keep", F.col("_fits") & (kept_size <= room) & (place <= limits.evidence_items - 1))
    columns = evidence.columns
    kept = judged.filter("_keep").select(*columns)
    counts = judged.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col("_keep").cast("long")).alias("kept"), F.max("ord").alias("last")).filter("n > kept")
    payload = F.to_json(F.struct(F.lit("evidence was truncated to the limits").alias("message"), F.lit("warning").alias("severity"), F.col("n").alias("original_item_count"), F.col("kept").alias("kept_item_count")))
    values: dict[str, Column] = {"ord": F.col("last") + 1, "key": F.lit("evidence:truncated"), "kind": F.lit("Diagnostic"), "origin": F.lit("SourceContent"), "span_availability": F.lit("DerivedEvidence"), "payload": payload, key: F.col(key)}
    marker = counts.select(*[values.get(c, F.lit(None)).cast(evidence.schema[c].dataType).alias(c) for c in columns])
    return kept.unionByName(marker)
