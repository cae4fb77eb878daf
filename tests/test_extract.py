import json

import pytest

from lodestone.limits import Limits
from lodestone.operators import extract, pattern, syntax

PY = '"""Doc ü."""\nimport os, sys as s\nfrom .a import *\n\n__all__ = ["run"]\nLIMIT = 3\n\n\n@cached\ndef run(x, y=1):  # note\n    """Run it."""\n    z = x\n    return z\n\n\nclass _C:\n    def m(self): pass\n'


def rows(language, text):
    return [(r[0], r[1], r[4]) for r in extract.extract(language, text)]


def test_python_evidence():
    found = rows("python", PY)
    keys = [k for k, _, _ in found]
    assert keys[:3] == ["structure:0", "structure:1", "structure:2"]
    by = {k: p for k, _, p in found}
    assert by["structure:0"]["name"] == "run" and by["structure:0"]["decorators"] == ["cached"] and by["structure:1"]["visibility"] == "private"
    assert by["import:0"]["items"] == ["os", "sys"] and by["import:0"]["alias"] == "s" and by["import:1"]["is_wildcard"]
    assert by["export:0"]["name"] == "run" and by["comment:0"]["text"] == "# note" and by["docstring:0"]["text"] == "Doc ü."
    assert {p["name"] for k, _, p in found if k.startswith("variable")} >= {"LIMIT", "x", "y", "z", "self"}
    assert keys.index("symbol:0") < keys.index("variable:0")


def test_spans_are_bytes_and_columns_characters():
    status, found = extract.analyze("ü = 1\nbü = é(2)  # c\n", "python")
    comment = next(r for r in found if r[2] == "Comment")
    assert status == ("Available", "Succeeded", None, "Partial")
    text = "ü = 1\nbü = é(2)  # c\n"
    assert comment[5] == text.encode().index(b"#") and comment[7:9] == (1, text.split("\n")[1].index("#"))


@pytest.mark.parametrize(
    "language,text,source",
    [("rust", "use crate::a::b;\n// use no::such;\nfn f() {}", "use crate::a::b;"), ("javascript", "import x from './y';\nconst k = 1;", "import x from './y';"), ("c", '#include "x.h"\nint main(void) {}', '#include "x.h"'),
     ("java", "import java.util.*;\nclass A {}", "import java.util.*;"), ("csharp", "using System.IO;\nclass A {}", "using System.IO;"), ("ocaml", "open Printf\n", "open Printf"), ("julia", "using LinearAlgebra\n", "using LinearAlgebra"),
     ("go", 'package m\nimport "fmt"\n', 'import "fmt"'), ("php", "use Foo\\Bar;\n", "use Foo\\Bar;"), ("swift", "import Foundation\n", "import Foundation"), ("dart", "import './a.dart';\n", "import './a.dart';")],
)
def test_generic_imports(language, text, source):
    found = [(k, p) for k, kind, p in rows(language, text) if kind == "Import"]
    assert [p["source"] for _, p in found] == [source] and found[0][0] == "generic_import:0"


@pytest.mark.parametrize("language", sorted(syntax.GRAMMARS))
def test_any_text_is_parsed_or_fails_as_a_result(language):
    for text in ["", "\n", "x", "((((", '"""', "\x01\x02", "<a href=x><!-- c", "{[}", "import", "é" * 50]:
        status, _ = extract.analyze(text, language)
        assert status[0] == "Available"


def test_outcomes():
    assert extract.analyze(None, "python")[0][:2] == ("Unavailable", "NotAttempted")
    assert extract.analyze("x", None)[0][:2] == ("Unavailable", "NotAttempted")
    assert extract.analyze("def f(:", "python")[0][1] == "SyntaxErrors"
    status, found = extract.analyze("x = 1", "python", lossy=True)
    assert status[1] == "Succeeded" and found[-1][1] == "encoding:0"


def test_html_and_json():
    found = rows("html", '<html><!-- hi --><title>T</title><h1 id="a">Big <b>x</b></h1><a href="/q">l</a><br></html>')
    assert [(k, p.get("name") or p.get("source") or p.get("text")) for k, kind, p in found] == [("structure:0", "T"), ("structure:1", "Big  x"), ("import:0", "/q"), ("comment:0", "<!-- hi -->")]
    assert extract.analyze("{bad", "json")[0][1] == "SyntaxErrors"


def test_caps(spark):
    sizes = [40, 90, 30, 40, 5]
    data = [("p", k, f"k{k}", "Comment", "x" * s) for k, s in enumerate(sizes)] + [("q", 0, "k0", "Comment", "y")]
    df = spark.createDataFrame(data, "path string, ord bigint, key string, kind string, payload string")
    found = extract.capped(df, Limits(evidence_item_bytes=64, evidence_file_bytes=100, evidence_reserve_bytes=0)).collect()
    assert sorted((r.path, r.key) for r in found) == [("p", "evidence:truncated"), ("p", "k0"), ("p", "k2"), ("q", "k0")]
    assert json.loads(next(r.payload for r in found if r.key == "evidence:truncated"))["kept_item_count"] == 2
    many = spark.range(25).selectExpr("'p' as path", "id as ord", "concat('k', id) as key", "'Comment' as kind", "'z' as payload")
    assert extract.capped(many, Limits(evidence_items=11)).count() == 11


def captures(language, text, query):
    tree = syntax.parse(language, text)
    return [(c, tree.source.slice(n)) for c, n in pattern.matches(pattern.compile_pattern(query), tree)]


def test_patterns():
    assert captures("python", PY, "(function_definition name: (identifier) @n)") == [("n", "run"), ("n", "m")]
    assert captures("python", PY, '((function_definition name: (identifier) @n) (#eq? @n "m"))') == [("n", "m")]
    assert captures("python", PY, "(class_definition (function_definition name: (_) @f) @d)")[0] == ("d", "def m(self): pass")
    assert captures("python", PY, "[(import_statement) (import_from_statement)] @i") == [("i", "import os, sys as s"), ("i", "from .a import *")]
    assert captures("python", PY, "(function_definition (parameter)* @p)")[:2] == [("p", "x"), ("p", "y")]
    assert captures("json", '{"a": [1, {"b": 2}]}', "(pair key: (string) @k)") == [("k", '"a"'), ("k", '"b"')]
    for bad in ["", "(", "(a", "x", "(a) (#nope? @a)", ")"]:
        with pytest.raises(pattern.PatternError):
            pattern.compile_pattern(bad)
    assert pattern.truncated("é" * 10, 5) == ("éé", True) and pattern.truncated("ab", 5) == ("ab", False)
