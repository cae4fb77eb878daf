"""Raw import text to files: references, what they may name, and resolution by joins over the known paths."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.rows import slices

#: Extensions that the fallback tries, in order: fixed values.
FALLBACK_EXTENSIONS = (
    "py js ts jsx tsx mjs cjs rb go rs java c cpp cc h hpp hh kt kts swift cs dart scala sc hs lua php pl pm ex exs ml sol jl erl hrl"
).split()


@dataclass(frozen=True)
class Rules:
    """How a family of languages spells modules."""

    extensions: tuple[str, ...]
    index: str | None
    separator: str
    path_relative: bool


PYTHON = Rules(("py",), "__init__", ".", False)
SCRIPT = Rules(("js", "ts", "jsx", "tsx", "mjs", "cjs"), "index", "/", True)
FALLBACK = Rules(tuple(FALLBACK_EXTENSIONS), None, ".", True)
KINDS = {"python": PYTHON, "script": SCRIPT, "fallback": FALLBACK}
FAMILIES = {"python": PYTHON, "python3": PYTHON, "javascript": SCRIPT, "typescript": SCRIPT, "jsx": SCRIPT, "tsx": SCRIPT}


@dataclass(frozen=True)
class Probe:
    """A candidate: within the lowest step that has a known path, the lowest place wins; a probe with a guard counts
    only if its guard is the known one of the lowest rank (rank None: if no guard is known)."""

    step: int
    place: int
    path: str
    forced: str | None = None
    rank: int = 0
    guard: str | None = None


@dataclass(frozen=True)
class Plan:
    """verdict: External or Unresolved where no path decides."""

    reference: str | None
    verdict: str
    probes: tuple[Probe, ...] = ()


def joined(base: str, rest: str) -> str:
    """base/rest with `.` and `..` worked out; `..` stops at the root."""
    parts: list[str] = []
    for p in f"{base}/{rest}".split("/"):
        if p == "..":
            del parts[-1:]
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts)


def parent(path: str) -> str:
    return path.rpartition("/")[0]


def quoted(text: str) -> str | None:
    m = re.search(r"""(['"])(.*?)\1""", text, re.S)
    first = re.search(r"""['"]""", text)
    return m[2] if m and first and m.start() == first.start() else None


def python_dots(text: str) -> bool:
    return text.startswith(".") and not text.startswith(("./", "../"))


_AFTER = re.compile(r"(from|using|use|open|import)\s+(\S.*)", re.S)


def reference(raw: str, rules: Rules) -> str | None:
    """The module that an import statement names, for all languages but Rust; None where its form isn't known."""
    text = raw.strip()
    if text.startswith("."):
        return text if text == "." or text.startswith(("./", "../")) or python_dots(text) else None
    words = text.split()
    m = _AFTER.fullmatch(text)
    keyword, rest = (m[1], m[2].split()) if m else (None, [])
    if text.startswith("from") and text[4:5].isspace():
        return None if not rest or rest[0][0] in "\"'" else rest[0]
    if "from" in words:
        return quoted(text)
    if text.startswith("import") and (path := quoted(text)) is not None:
        return path if path.startswith(("./", "../", "package:", "dart:")) else None
    if keyword == "using":
        names = [w.rstrip(";") for w in rest]
        return names[0] if names[0] != "static" else names[1] if len(names) > 1 else None
    if keyword == "use":
        return rest[0].rstrip(";").replace("::", ".").replace("\\", ".")
    if keyword == "open":
        return rest[0]
    if text.startswith("#include"):
        inner = text[len("#include") :].strip()
        path = re.fullmatch(r'"(.*)"|<(.*)>', inner, re.S)
        return "./" + (path[1] if path[1] is not None else path[2]).strip() if path else None
    if keyword == "import":
        return None if rest[0][0] in "\"'" else rest[0]
    if text in ("using", "use", "open", "import", "from") or (text and rules.separator not in text and not re.search(r"[ \"']", text)):
        return text or None
    return None


def rust_reference(raw: str) -> str | None:
    text = raw.strip()
    for prefix in ("pub(crate) ", "pub(super) ", "pub(self) ", "pub "):
        while text.startswith(prefix):
            text = text[len(prefix) :]
    if not text.startswith("use "):
        return None
    return re.sub(r"(::)+$", "", re.split("[;{ ]", text[4:], maxsplit=1)[0]) or None


def suffixes(rules: Rules) -> list[str]:
    """What may follow a module's path, in order."""
    found = ["", *(f".{e}" for e in rules.extensions)]
    if rules.index:
        found += [f"/{rules.index}.{e}" for e in rules.extensions] + [f"/{rules.index}"]
    return found


#: By kind of target: a module of a family of languages, or a file named in full.
SUFFIXES = {kind: suffixes(rules) for kind, rules in KINDS.items()} | {"exact": [""]}


def _probes(paths: list[str], step: int = 0, forced: str | None = None, rank: int = 0, guard: str | None = None) -> list[Probe]:
    return [Probe(step, k, p, forced, rank, guard) for k, p in enumerate(paths)]


@dataclass(frozen=True)
class Target:
    """What an import names: base followed by one of SUFFIXES[kind], the first that is known. No base: nothing to look for."""

    reference: str | None
    verdict: str
    base: str | None = None
    kind: str | None = None


def target(language: str, importer: str, raw: str) -> Target:
    """For all languages but Rust."""
    rules = FAMILIES.get(language, FALLBACK)
    kind = next(k for k, r in KINDS.items() if r is rules)
    ref = reference(raw, rules)
    if ref is None:
        return Target(None, "Unresolved")
    text = ref.strip()
    if rules.path_relative and text.startswith(("./", "../")):
        return Target(ref, "Unresolved", joined(parent(importer), text), kind)
    if python_dots(text):
        dots = len(text) - len(text.lstrip("."))
        base = parent(importer)
        for _ in range(dots - 1):
            base = parent(base)
        rest = text[dots:]
        if rest:
            return Target(ref, "Unresolved", joined(base, rest.replace(".", "/")), kind)
        return Target(ref, "Unresolved", f"{base}/{rules.index}.py", "exact") if rules.index else Target(ref, "Unresolved")
    if text.startswith(("package:", "dart:")) or rules.separator not in text:
        return Target(ref, "External")
    return Target(ref, "Unresolved", text if rules.separator == "/" else text.replace(rules.separator, "/"), kind)


def plan(language: str, importer: str, raw: str) -> Plan:
    """What to probe for an import of a file."""
    if language == "rust":
        return _rust_plan(importer, raw)
    t = target(language, importer, raw)
    return Plan(t.reference, t.verdict, tuple(_probes([t.base + x for x in SUFFIXES[t.kind]])) if t.kind else ())


def _module_files(folder: str) -> list[str]:
    return [f"{folder}.rs", f"{folder}/mod.rs", f"{folder}/lib.rs", f"{folder}/main.rs"] if folder else []


def _rust_steps(rest: str, base: str) -> list[list[str]]:
    """Steps for the segments below a folder: the longest chain first; none left: the module's own file."""
    rest = rest.strip().removesuffix("*").rstrip(":")
    if not rest:
        return [_module_files(base)]
    parts = [p for p in rest.split("::") if p]
    return [[f"{joined(base, '/'.join(parts[:n]))}.rs", f"{joined(base, '/'.join(parts[:n]))}/mod.rs"] for n in range(len(parts), 0, -1)]


def _rust_plan(importer: str, raw: str) -> Plan:
    ref = rust_reference(raw)
    if ref is None:
        return Plan(None, "Unresolved")
    folder = parent(importer)
    head, _, rest = ref.partition("::")
    if head == "crate" and ref in ("crate",) or ref.startswith("crate::"):
        probes: list[Probe] = []
        ups = [folder]
        while ups[-1]:
            ups.append(parent(ups[-1]))
        bases = [(k, joined(d, "src"), joined(d, "Cargo.toml")) for k, d in enumerate(ups)] + [(len(ups), "src", None)]
        for rank, base, guard in bases:
            root = [f"{base}/lib.rs", f"{base}/main.rs"]
            steps = _rust_steps(rest, base) if rest.strip().removesuffix("*").rstrip(":") else [root]
            probes += [p for k, s in enumerate(steps) for p in _probes(s, k, None, rank, guard)]
        return Plan(ref, "Unresolved", tuple(probes))
    if head not in ("self", "super"):
        return Plan(ref, "External")
    stem = re.sub(r"\.[^.]*$", "", importer.rpartition("/")[2])
    own = folder if stem in ("mod", "lib", "main") else joined(folder, stem)
    strict, loose = own, folder
    if head == "super":
        strict, loose = parent(own), parent(folder)
        while rest == "super" or rest.startswith("super::"):
            rest = rest.partition("::")[2]
            strict, loose = parent(strict), parent(loose)
    steps = [s for base in (strict, loose) for s in _rust_steps(rest, base)] + [_module_files(strict), _module_files(loose)]
    return Plan(ref, "Unresolved", tuple(p for k, s in enumerate(steps) for p in _probes(s, k, "Low")))


def resolve(language: str, importer: str, raw: str, known: set[str]) -> tuple[str, str | None, str | None]:
    """(resolution_kind, confidence, path) of one import, for callers without Spark and for tests."""
    found = plan(language, importer, raw)
    guards = {(p.rank, p.guard) for p in found.probes if p.guard}
    rank = min((r for r, g in guards if g in known), default=max((p.rank for p in found.probes), default=0))
    hits = sorted((p.step, p.place, p.path, p.forced) for p in found.probes if p.rank == rank and p.path in known)
    if not hits:
        return found.verdict, None, None
    first = [h for h in hits if h[0] == hits[0][0]]
    return "Resolved", first[0][3] or ("High" if len(first) == 1 else "Low"), first[0][2]


def _targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(from_path, ord, language, raw) with what each import names."""
    for b in slices("link", batches, 3, rows=8192):
        found = [target(lang or "", p or "", r or "") for lang, p, r in zip(*(b.column(k).to_pylist() for k in (2, 0, 3)), strict=True)]
        yield pa.record_batch(
            {"from_path": b.column(0), "ord": b.column(1), "raw_import_text": b.column(3), "syntax_unmodeled": pa.array([t.reference is None for t in found], pa.bool_())}
            | {c: pa.array([getattr(t, c) for t in found], pa.string()) for c in ("verdict", "base", "kind")}
        )


def _by_base(paths: DataFrame) -> DataFrame:
    """(base, python, script, fallback) of known paths: a row for each base that a path is a suffix away from, with the
    suffix's place as a bit for each kind. A suffix is empty, an extension or a last component, so a path has three at most."""
    path = F.col("path")
    bits: dict[str, dict[str, int]] = {}
    for kind in KINDS:
        for k, x in enumerate(SUFFIXES[kind]):
            bits.setdefault(x, dict.fromkeys(KINDS, 0))[kind] = 1 << k
    places = F.create_map(*[c for x, masks in bits.items() for c in (F.lit(x), F.struct(*[F.lit(m).cast("long").alias(kind) for kind, m in masks.items()]))])
    tail = lambda c: F.when(path.contains(c), F.concat(F.lit(c), F.substring_index(path, c, -1)))
    spread = paths.select(path, F.explode(F.array(F.lit(""), tail("."), tail("/"))).alias("tail"))
    found = spread.select(F.left(path, F.length(path) - F.length("tail")).alias("base"), F.try_element_at(places, F.coalesce("tail", F.lit("\x00"))).alias("m"))
    return found.filter("base is not null and m is not null").select("base", "m.*")


def _general_edges(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges of all languages but Rust, whose imports name one base each.

    The bases that imports name, distinct, are joined to those of the known paths; what is known of each goes back to
    the imports. Imports without a base are dealt by a hash, and that join's other side gets a shuffle of its own, so
    that adaptive execution may split a base that very many imports share. Both joins sort: a plan of Python's output
    is too easily taken for small enough to broadcast.
    """
    named = imports.mapInArrow(_targets, "from_path string, ord bigint, raw_import_text string, syntax_unmodeled boolean, verdict string, base string, kind string")
    wanted = named.filter("base is not null").select("base").distinct()
    known = _by_base(paths).join(wanted.hint("merge"), "base", "left_semi").groupBy("base").agg(*[F.bit_or(kind).alias(kind) for kind in KINDS])
    dealt = named.withColumn("deal", F.coalesce(F.length("base"), -1 - F.pmod(F.hash("from_path", "ord"), F.lit(1 << 20))))
    linked = dealt.join(known.withColumn("deal", F.length("base")).hint("merge"), ["base", "deal"], "left")
    mask, suffix = F.lit(None).cast("long"), F.lit(None).cast("string")
    low = F.bit_count(F.col("mask").bitwiseAND(-F.col("mask")) - 1)
    for kind in SUFFIXES:
        own: Column = F.col("kind") == kind
        mask = F.when(own, F.col(kind) if kind in KINDS else F.col("python").bitwiseAND(F.lit(1))).otherwise(mask)
        suffix = F.when(own, F.get(F.array(*map(F.lit, SUFFIXES[kind])), low)).otherwise(suffix)
    hits = linked.withColumn("mask", F.nullif(mask, F.lit(0)))
    found = F.col("mask").isNotNull()
    return hits.select(
        "from_path", "ord", "raw_import_text", F.when(found, F.concat("base", suffix)).alias("to_path"), F.when(found, "Resolved").otherwise(F.col("verdict")).alias("resolution_kind"),
        F.when(found, F.when(F.bit_count("mask") == 1, "High").otherwise("Low")).alias("confidence"), "syntax_unmodeled",
    )


def _rust_probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(from_path, raw) with each path that decides the import, once."""
    for b in slices("link", batches, 1):
        found = [(p, r, x) for p, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in {y for probe in _rust_plan(p or "", r or "").probes for y in (probe.path, probe.guard) if y}]
        yield pa.record_batch([pa.array([f[k] for f in found], pa.string()) for k in range(3)], ["importer", "raw_text", "path"])


def _rust_resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(from_path, ord, raw, known) to edges."""
    for b in slices("link", batches, 2):
        given = [(p or "", r or "") for p, r in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
        found = [resolve("rust", p, r, set(known or ())) for (p, r), known in zip(given, b.column(3).to_pylist(), strict=True)]
        kinds, confidences, to_paths = (pa.array([f[k] for f in found], pa.string()) for k in range(3))
        unmodeled = pa.array([rust_reference(r) is None for _, r in given], pa.bool_())
        yield pa.record_batch([b.column(0), b.column(1), b.column(2), to_paths, kinds, confidences, unmodeled], ["from_path", "ord", "raw_import_text", "to_path", "resolution_kind", "confidence", "syntax_unmodeled"])


def _rust_edges(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """Rust's edges, whose plans have steps and guards: the known ones of the paths that a plan probes go back to it."""
    probed = imports.select("from_path", "raw").distinct().mapInArrow(_rust_probed, "importer string, raw_text string, path string")
    known = probed.select("path").distinct().join(paths.select("path").distinct(), "path", "left_semi")
    seen = probed.join(known, "path").groupBy("importer", "raw_text").agg(F.collect_list("path").alias("known"))
    same = F.col("from_path").eqNullSafe(F.col("importer")) & F.col("raw").eqNullSafe(F.col("raw_text"))
    given = imports.join(seen, same, "left").select("from_path", "ord", "raw", "known")
    return given.mapInArrow(_rust_resolved, "from_path string, ord bigint, raw_import_text string, to_path string, resolution_kind string, confidence string, syntax_unmodeled boolean")


def edges(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """(from_path, ord, raw_import_text, to_path, resolution_kind, confidence, syntax_unmodeled): one row per row of
    imports (from_path, ord, language, raw), which none is dropped from."""
    imports = imports.select("from_path", "ord", "language", "raw")
    rust = F.coalesce(F.col("language") == "rust", F.lit(False))
    return _general_edges(imports.filter(~rust), paths).unionByName(_rust_edges(imports.filter(rust), paths))
