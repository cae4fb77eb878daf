"""Neutral syntax trees: real parsers for Python, HTML and JSON, line lexers for other languages."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from dataclasses import field as made
from functools import cached_property
from html.parser import HTMLParser

PACK_VERSION = "1.0"


@dataclass
class Node:
    """A typed node over a half-open byte range; `field` is its role in its parent."""

    kind: str
    start: int
    end: int
    children: list[Node] = made(default_factory=list)
    field: str | None = None
    named: bool = True
    attrs: dict = made(default_factory=dict)

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += reversed(node.children)


class Source:
    """Positions of a text: code points to bytes, bytes to zero-based lines and columns in code points."""

    def __init__(self, text: str):
        self.text = text
        self.data = text.encode("utf-8", "surrogatepass")
        self.ascii = len(self.data) == len(text)

    @cached_property
    def _bytes(self) -> list[int]:
        at, out = 0, [0]
        for c in self.text:
            at += 1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4
            out.append(at)
        return out

    @cached_property
    def line_starts(self) -> list[int]:
        return [0] + [m.end() for m in re.finditer(b"\n", self.data)]

    def byte(self, char: int) -> int:
        return char if self.ascii else self._bytes[char]

    def place(self, byte: int) -> tuple[int, int]:
        from bisect import bisect_right

        line = bisect_right(self.line_starts, byte) - 1
        start = self.line_starts[line]
        return line, byte - start if self.ascii else len(self.data[start:byte].decode("utf-8", "replace"))

    def slice(self, node: Node) -> str:
        return self.data[node.start : node.end].decode("utf-8", "replace")


@dataclass
class Tree:
    root: Node
    source: Source
    #: (message, severity, start, end)
    errors: list[tuple[str, str, int, int]]


_PY_KINDS = {
    "FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "ClassDef": "class_definition", "Import": "import_statement", "ImportFrom": "import_from_statement",
    "Assign": "assignment", "AnnAssign": "assignment", "AugAssign": "augmented_assignment", "Name": "identifier", "arg": "parameter", "Return": "return_statement", "If": "if_statement",
    "For": "for_statement", "While": "while_statement", "With": "with_statement", "Try": "try_statement", "Call": "call", "Attribute": "attribute", "Constant": "literal", "Expr": "expression_statement",
    "Lambda": "lambda", "BinOp": "binary_operator", "Compare": "comparison_operator", "List": "list", "Dict": "dictionary", "Tuple": "tuple", "Raise": "raise_statement", "keyword": "keyword_argument",
}


def _python(source: Source) -> Tree:
    errors: list[tuple[str, str, int, int]] = []
    try:
        module = ast.parse(source.text)
    except (SyntaxError, ValueError, RecursionError) as e:
        line = min(max(1, getattr(e, "lineno", 1) or 1), len(source.line_starts))
        at = source.line_starts[line - 1]
        errors.append((getattr(e, "msg", None) or str(e), "error", at, at))
        return Tree(_lexed("python", source), source, errors)

    def place(line: int, column: int) -> int:
        return source.line_starts[line - 1] + column

    def name_node(node: ast.AST, start: int, end: int, name: str) -> Node | None:
        m = re.compile(rb"\b" + re.escape(name.encode()) + rb"\b").search(source.data, start, end)
        return Node("identifier", m.start(), m.end(), field="name") if m else None

    def build(node: ast.AST, role: str | None) -> Node | None:
        if not hasattr(node, "lineno"):
            return None
        start, end = place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset)
        own = Node(_PY_KINDS.get(type(node).__name__, type(node).__name__.lower()), start, end, field=role)
        name = getattr(node, "name", None) if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) else node.arg if isinstance(node, ast.arg) else None
        if name and (named := name_node(node, start, end, name)):
            own.children.append(named)
        for key, value in ast.iter_fields(node):
            for x in value if isinstance(value, list) else [value]:
                if isinstance(x, ast.arguments):
                    own.children += [c for a in [*x.posonlyargs, *x.args, *x.kwonlyargs, *filter(None, [x.vararg, x.kwarg])] if (c := build(a, "parameters"))]
                elif isinstance(x, ast.AST) and (c := build(x, {"targets": "left", "target": "left", "value": "right"}.get(key, key))):
                    own.children.append(c)
        own.children.sort(key=lambda c: (c.start, -c.end))
        own.attrs["ast"] = node
        return own

    root = Node("module", 0, len(source.data), [c for x in module.body if (c := build(x, None))], attrs={"ast": module})
    root.children += [Node("comment", source.byte(m.start()), source.byte(m.end())) for m in _comments("python", source.text)]
    root.children.sort(key=lambda c: (c.start, -c.end))
    return Tree(root, source, errors)


class _Html(HTMLParser):
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self, source: Source):
        super().__init__(convert_charrefs=False)
        self.source = source
        self.starts = [0] + [m.end() for m in re.finditer("\n", source.text)]
        self.root = Node("document", 0, len(source.data))
        self.open = [self.root]

    def here(self) -> int:
        line, column = self.getpos()
        return self.source.byte(self.starts[line - 1] + column)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        raw = self.get_starttag_text() or ""
        start = self.here()
        end = start + len(raw.encode())
        node = Node("element", start, end, attrs={"tag": tag, "attributes": dict(attrs)})
        node.children.append(Node("tag_name", start + 1, start + 1 + len(tag.encode()), field="name"))
        for key, value in attrs:
            m = re.search(re.escape(key) + r"""(\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", raw, re.I)
            if m:
                at = start + len(raw[: m.start()].encode())
                node.children.append(Node("attribute", at, at + len(m[0].encode()), field="attribute", attrs={"name": key, "value": value}))
        self.open[-1].children.append(node)
        if tag not in self.VOID and not raw.endswith("/>"):
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].attrs["tag"] == tag:
                end = min(len(self.source.data), self.here() + len(f"</{tag}>"))
                for node in self.open[k:]:
                    node.end = end
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        if data.strip():
            start = self.here()
            self.open[-1].children.append(Node("text", start, start + len(data.encode())))

    def handle_comment(self, data: str) -> None:
        start = self.here()
        self.open[-1].children.append(Node("comment", start, min(len(self.source.data), start + len(data.encode()) + 7)))


def _html(source: Source) -> Tree:
    parser = _Html(source)
    parser.feed(source.text)
    parser.close()
    for node in parser.open[1:]:
        node.end = len(source.data)
    return Tree(parser.root, source, [])


def _json(source: Source) -> Tree:
    errors = []
    try:
        json.loads(source.text)
    except ValueError as e:
        at = source.byte(min(len(source.text), getattr(e, "pos", 0)))
        errors.append((str(e), "error", at, at))
    except RecursionError as e:
        errors.append((str(e), "error", 0, 0))
    root = Node("document", 0, len(source.data))
    stack = [root]
    key: Node | None = None
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+', source.text):
        start, end, c = source.byte(m.start()), source.byte(m.end()), m[0]
        if c in "{[":
            node = Node("object" if c == "{" else "array", start, end)
            stack[-1].children.append(node)
            stack.append(node)
        elif c in "}]":
            if len(stack) > 1:
                closed = stack.pop()
                closed.end = end
                if stack[-1].kind == "pair":
                    stack.pop().end = end
        elif c == ":":
            if stack[-1].children:
                key = stack[-1].children.pop()
                key.field = "key"
                pair = Node("pair", key.start, end, [key])
                stack[-1].children.append(pair)
                stack.append(pair)
        elif c != ",":
            stack[-1].children.append(Node("string" if c[0] == '"' else "literal", start, end, field="value" if stack[-1].kind == "pair" else None))
            if stack[-1].kind == "pair":
                stack.pop().end = end
    return Tree(root, source, errors)


_HASH = {"python", "ruby", "perl", "julia", "bash", "elixir", "toml", "yaml"}
_DASH = {"lua", "haskell", "sql"}


def _comments(language: str, text: str) -> Iterator[re.Match]:
    strings = r"""(?P<s>\"\"\".*?\"\"\"|'''.*?'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    if language in _HASH:
        line = r"(?P<c>\#[^\n]*)"
    elif language in _DASH:
        line = r"(?P<c>--[^\n]*)"
    elif language == "ocaml":
        line = r"(?P<c>\(\*.*?\*\))"
    else:
        line = r"(?P<c>//[^\n]*|/\*.*?\*/)"
    for m in re.finditer(f"{strings}|{line}", text, re.S):
        if m["c"] is not None:
            yield m


#: (kind, pattern with an optional group `name`) by line, over text whose comments are blanked.
_IMPORTS = [
    (r"^[ \t]*(?:pub(?:\([a-z]+\))? )?use [^;\n]+(?:\{[^}]*\})?;", "use_statement", {"rust"}),
    (r"^[ \t]*import\b[^\n;]*?\bfrom\b[^\n;]*;?|^[ \t]*import\s+['\"][^'\"\n]+['\"];?", "import_statement", {"javascript", "typescript", "jsx", "tsx"}),
    (r"^[ \t]*import\s+(?:\w+\s+)?\"[^\"\n]+\"|^[ \t]+\"[^\"\n]+\"$", "import_declaration", {"go"}),
    (r"^[ \t]*import\b[^\n]*", "import_declaration", {"java", "kotlin", "scala", "swift", "dart", "haskell", "solidity", "python"}),
    (r"^[ \t]*from\s[^\n]*", "import_from_statement", {"python"}),
    (r"^[ \t]*#[ \t]*include\b[^\n]*", "preproc_include", {"c", "cpp"}),
    (r"^[ \t]*using\b[^\n;=(]*;?", "using_directive", {"csharp", "julia"}),
    (r"^[ \t]*use\s[^\n;]*;?", "namespace_use_declaration", {"php", "perl"}),
    (r"^[ \t]*open\s[^\n]*", "open_module", {"ocaml"}),
]
_DEFINITIONS = [
    (r"\b(?:fn|func|function|fun|def|sub)\s+(?:\([^)\n]*\)\s*)?(?P<name>\w+)\s*[(<]", "function_definition"),
    (r"\b(?:class|struct|enum|trait|interface|module|contract|protocol)\s+(?P<name>\w+)", "class_definition"),
    (r"\b(?:let|const|var|val)\s+(?:mut\s+)?(?P<name>\w+)", "let_declaration"),
]
_FIELDS = r"^[ \t]+(?:(?:pub|public|private|protected|static|final|readonly)\s+)*(?P<name>\w+)\s*:\s*[\w<>\[\]:&'. ]+[,;]?\s*$"


def _lexed(language: str, source: Source) -> Node:
    """A flat tree of comments, imports, definitions and bindings of a language without a parser."""
    text = source.text
    blank = list(text)
    nodes: list[Node] = []
    for m in _comments(language, text):
        nodes.append(Node("comment", source.byte(m.start()), source.byte(m.end())))
        blank[m.start() : m.end()] = [c if c == "\n" else " " for c in m[0]]
    plain = "".join(blank)

    def add(m: re.Match, kind: str) -> None:
        lead = len(m[0]) - len(m[0].lstrip())
        node = Node(kind, source.byte(m.start() + lead), source.byte(m.end()))
        if "name" in m.groupdict() and m["name"]:
            node.children.append(Node("identifier", source.byte(m.start("name")), source.byte(m.end("name")), field="name"))
        if kind == "let_declaration" and re.match(r"\s*const\b", m[0]):
            node.kind = "const_declaration"
        nodes.append(node)

    for pattern, kind, languages in _IMPORTS:
        if language in languages:
            for m in re.finditer(pattern, plain, re.M):
                add(m, kind)
    for pattern, kind in _DEFINITIONS:
        for m in re.finditer(pattern, plain):
            add(m, kind)
    if language in {"rust", "typescript", "swift", "kotlin"}:
        for m in re.finditer(_FIELDS, plain, re.M):
            add(m, "property_signature" if language == "typescript" else "field_declaration")
    if language == "markdown":
        for m in re.finditer(r"^#{1,6}[ \t]+(?P<name>[^\n]*)", text, re.M):
            add(m, "heading")
    nodes.sort(key=lambda n: (n.start, -n.end))
    return Node("source_file", 0, len(source.data), nodes)


def available(language: str) -> bool:
    return language in GRAMMARS


def parse(language: str, text: str) -> Tree:
    source = Source(text)
    return GRAMMARS[language](source)


GRAMMARS = {"python": _python, "html": _html, "json": _json} | {
    x: (lambda source, x=x: Tree(_lexed(x, source), source, []))
    for x in "javascript typescript jsx tsx rust go java kotlin scala c cpp csharp swift dart ruby php perl lua julia ocaml haskell elixir erlang solidity bash sql css toml yaml markdown".split()
}
