import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.operators import link

KNOWN = {
    "pkg/__init__.py", "pkg/a.py", "pkg/sub/b.py", "pkg/sub/__init__.py", "a.py", "web/util.js", "web/util.ts", "web/lib/index.js", "web/only.ts", "lib/Foo.dart", "inc/x.h", "inc/main.c", "stdio.h",
    "Cargo.toml", "src/lib.rs", "src/helper.rs", "src/a/mod.rs", "src/a/b.rs", "src/a/c/mod.rs", "crates/api/Cargo.toml", "crates/api/src/main.rs", "crates/api/src/x.rs", "My/Module.pm", "System/IO.cs",
}

CASES = [
    ("python", "pkg/sub/b.py", "from pkg.a import x", ("Resolved", "High", "pkg/a.py")),
    ("python", "pkg/sub/b.py", "from pkg.sub import x", ("Resolved", "High", "pkg/sub/__init__.py")),
    ("python", "pkg/a.py", "from .sub.b import y", ("Resolved", "High", "pkg/sub/b.py")),
    ("python", "pkg/sub/b.py", "from ..a import y", ("Resolved", "High", "pkg/a.py")),
    ("python", "pkg/a.py", "from . import b", ("Resolved", "High", "pkg/__init__.py")),
    ("python", "a.py", "from . import b", ("Unresolved", None, None)),
    ("python", "a.py", "import os", ("External", None, None)),
    ("python", "a.py", "import from_util", ("External", None, None)),
    ("python", "a.py", "from 'x' import y", ("Unresolved", None, None)),
    ("python", "a.py", "from\tpkg.a import\tz", ("Resolved", "High", "pkg/a.py")),
    ("javascript", "web/app.js", "import u from './util'", ("Resolved", "Low", "web/util.js")),
    ("typescript", "web/app.ts", "import {x} from './only'", ("Resolved", "High", "web/only.ts")),
    ("javascript", "web/app.js", "import x from './lib';", ("Resolved", "High", "web/lib/index.js")),
    ("javascript", "web/lib/index.js", "import '../util.js'", ("Resolved", "High", "web/util.js")),
    ("javascript", "web/app.js", "import React from 'react'", ("External", None, None)),
    ("javascript", "web/app.js", "import x from broken", ("Unresolved", None, None)),
    ("go", "main.go", 'import "fmt"', ("Unresolved", None, None)),
    ("c", "inc/main.c", '#include "x.h"', ("Resolved", "High", "inc/x.h")),
    ("c", "main.c", "#include <stdio.h>", ("Resolved", "High", "stdio.h")),
    ("c", "inc/main.c", "#include <stdlib.h>", ("Unresolved", None, None)),
    ("dart", "main.dart", "import 'package:flutter/material.dart';", ("External", None, None)),
    ("dart", "main.dart", "import './lib/Foo.dart';", ("Resolved", "High", "lib/Foo.dart")),
    ("csharp", "P.cs", "using static System.IO;", ("Resolved", "High", "System/IO.cs")),
    ("perl", "m.pl", "use My::Module;", ("Resolved", "High", "My/Module.pm")),
    ("perl", "m.pl", "use strict;", ("External", None, None)),
    ("ocaml", "m.ml", "open Printf", ("External", None, None)),
    ("swift", "m.swift", "import Foundation", ("External", None, None)),
    ("rust", "src/a/b.rs", "use crate::helper::greet;", ("Resolved", "High", "src/helper.rs")),
    ("rust", "crates/api/src/main.rs", "pub(crate) use crate::x::{A, B};", ("Resolved", "High", "crates/api/src/x.rs")),
    ("rust", "src/a/b.rs", "use super::c::Thing;", ("Resolved", "Low", "src/a/c/mod.rs")),
    ("rust", "src/a/b.rs", "use super::*;", ("Resolved", "Low", "src/a/mod.rs")),
    ("rust", "src/helper.rs", "use super::*;", ("Resolved", "Low", "src/lib.rs")),
    ("rust", "src/a/mod.rs", "use self::b::f;", ("Resolved", "Low", "src/a/b.rs")),
    ("rust", "src/a/b.rs", "use super::super::helper;", ("Resolved", "Low", "src/helper.rs")),
    ("rust", "src/a/b.rs", "use crate::*;", ("Resolved", "High", "src/lib.rs")),
    ("rust", "src/a/b.rs", "use std::fs;", ("External", None, None)),
    ("rust", "src/a/b.rs", "extern crate x;", ("Unresolved", None, None)),
]


@pytest.mark.parametrize("language,importer,raw,want", CASES)
def test_one_import(language, importer, raw, want):
    assert link.resolve(language, importer, raw, KNOWN) == want


def test_joins_agree_with_the_plain_form(spark):
    imports = spark.createDataFrame([(imp, k, lang, raw) for k, (lang, imp, raw, _) in enumerate(CASES)], "from_path string, ord bigint, language string, raw string")
    paths = spark.createDataFrame([(p,) for p in KNOWN], "path string")
    rows = {r.ord: r for r in link.edges(imports, paths).collect()}
    assert len(rows) == len(CASES)
    for k, (lang, imp, raw, want) in enumerate(CASES):
        assert (rows[k].resolution_kind, rows[k].confidence, rows[k].to_path) == want, raw
        assert rows[k].syntax_unmodeled == (link.plan(lang, imp, raw).reference is None)


segment = st.from_regex(r"[a-z][a-z0-9_]{0,7}", fullmatch=True)
gap = st.sampled_from([" ", "  ", "\t", " \t"])


@settings(max_examples=200, deadline=None, database=None)
@given(st.lists(segment, min_size=1, max_size=3), gap, gap, gap, segment)
def test_from_import_names_its_module(parts, a, b, c, name):
    module = ".".join(parts)
    assert link.reference(f"from{a}{module}{b}import{c}{name}", link.PYTHON) == module


def test_paths_stop_at_the_root():
    assert link.joined("a/b", "../../../x") == "x" and link.joined("", "./y/./z") == "y/z" and link.joined("a", "..") == ""


def test_rows_that_share_their_key_stay_single(spark):
    rows = [("web/app.ts", 1, "typescript", "import {x} from './only'")] * 3 + [("src/a/b.rs", 1, "rust", "use crate::helper;")] * 2 + [("a.py", 2, None, None), (None, None, "python", "from pkg.a import x"), (None, None, "rust", None)]
    imports = spark.createDataFrame(rows, "from_path string, ord bigint, language string, raw string")
    paths = spark.createDataFrame([(p,) for p in sorted(KNOWN)] * 2, "path string")
    found = sorted((r.from_path or "", r.to_path or "", r.resolution_kind, r.confidence or "") for r in link.edges(imports, paths).collect())
    want = [(p or "", *(x or "" for x in (lambda kind, sure, to: (to, kind, sure))(*link.resolve(lang or "", p or "", raw or "", KNOWN)))) for p, _, lang, raw in rows]
    assert found == sorted(want)


def test_joins_agree_with_the_plain_form_on_many_known_sets(spark):
    known = {b + x for b in ("m/a", "m/a.b", "m", "py") for kind in link.SUFFIXES for x in link.SUFFIXES[kind]} | {"", "/index.js", "/__init__.py", "index", "a/", ".js", "é/ü.ts"}
    raws = ["import './a'", "import './a.b'", "import './a.js'", "import '../m'", "import '../py'", "import './index'", "import '../é/ü'", "from .a import x", "from . import x", "from ... import x", "import m.a", "import m.a.b", "from m.a.js import x", '#include "a"', "use m::a", "import '.././'", "import react"]
    groups = [sorted(known)[k::7] for k in range(7)] + [sorted(known)]
    imports = [("m/x" if k % 2 else "x", n, lang, raw) for n, (k, lang, raw) in enumerate((k, lang, raw) for k in range(2) for lang in ("python", "javascript", "c", "go") for raw in raws)]
    for group in groups:
        got = {r.ord: (r.resolution_kind, r.confidence, r.to_path) for r in link.edges(spark.createDataFrame(imports, "from_path string, ord bigint, language string, raw string"), spark.createDataFrame([(p,) for p in group], "path string")).collect()}
        assert got == {n: link.resolve(lang, p, raw, set(group)) for p, n, lang, raw in imports}


def test_imports_are_not_spread_over_their_suffixes(spark):
    imports = spark.range(10).selectExpr("concat('m/f', id, '.js') as from_path", "id as ord", "'javascript' as language", "concat(\"import x from './f\", id + 1, \"'\") as raw")
    made = link.edges(imports, imports.selectExpr("from_path as path"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapIn") <= 3 and plan.count("hashpartitioning") <= 5 and "BroadcastHashJoin" not in plan
    assert sum(r.to_path is not None for r in made.collect()) == 9
