"""Personal data by proposing patterns, confirming validators and context words; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.rows import let, prefix_sums


@dataclass(frozen=True)
class Kind:
    """pattern must have its matches as Java finds them one after another; near: words that raise the score."""

    name: str
    pattern: str
    base: float
    near: str
    is_base: bool = True


# Possessive forms of the contract's patterns. A match may start inside a run of its first characters only
# where the match before it ended, so that a run is scanned once and long texts stay linear.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8, r"mail|contact|kontakt|correo|courriel|write"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 0.6, r"\bip\b|host|server|address|adresse|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.6, r"card|visa|master|credit|karte|tarjeta|carte|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, r"tel|phone|call|fax|mobil|anruf|llam|appel"),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", 0.7, r"iban|bank|konto|account|cuenta|compte", is_base=False),
)
#: Characters before a span in which context words count.
CONTEXT = 48
#: Score that a context word adds.
RAISE = 0.2


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string (at most some dozens) holds."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.when(d.cast("int") > 4, 1).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an IBAN without spaces has remainder 1 modulo 97, letters counting as 10 to 35."""
    turned = F.concat(F.substring(text, 5, 99), F.substring(text, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97) == 1


def confirmed(kind: Kind, match: Column) -> Column:
    if kind.name == "ip":
        return F.forall(F.split(match, r"\."), lambda part: F.length(F.regexp_replace(part, "^0+", "")).between(0, 3) & (F.right(part, F.lit(3)).cast("int") <= 255))
    if kind.name == "card":
        return let(digits_of(match), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    if kind.name == "phone":
        return F.length(digits_of(match)).between(8, 15)
    if kind.name == "iban":
        return let(F.replace(match, F.lit(" "), F.lit("")), lambda t: F.when(F.length(t).between(15, 34), mod97(t)).otherwise(False))
    return F.lit(True)


def spans_of(kind: Kind, text: Column) -> Column:
    """array<struct<kind,start,end,score>> of a kind in text, in code points, end exclusive.

    Matches and the gaps between them give the positions, so that the text is walked twice and never sliced.
    """
    pattern = F.lit(kind.pattern)

    def place(matches: Column, gaps: Column) -> Column:
        lengths = F.transform(matches, lambda m, i: (F.length(F.element_at(gaps, i + 1)) + F.length(m)).cast("long"))
        sums = prefix_sums(lengths)

        def span(m: Column, i: Column, at: Column) -> Column:
            gap = F.element_at(gaps, i + 1)
            start = F.element_at(at, i + 1) + F.length(gap)
            near = F.lower(F.right(gap, F.lit(CONTEXT))).rlike(kind.near)
            score = F.lit(kind.base) + F.when(near, RAISE).otherwise(0.0)
            return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), score.alias("score"), confirmed(kind, m).alias("ok"))

        found = let(sums, lambda at: F.transform(matches, lambda m, i: span(m, i, at)))
        return F.transform(F.filter(found, lambda s: s.ok), lambda s: F.struct(s.kind, s.start, s.end, s.score))

    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    found = let(matches, lambda m: F.when(F.size(m) > 0, let(F.split(text, kind.pattern, -1), lambda gaps: place(m, gaps))))
    return F.coalesce(found, F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>"))


def find_pii(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with one column more, `pii`: the confirmed spans by kind as listed, then by start.

    A null text has none. Spans never overlap within a kind. The score is the kind's base, raised by context
    words shortly before the span; spans that a validator refuses are dropped.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("pii", F.concat(*[spans_of(k, text) for k in kinds]))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def mask_pii(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, least: float = 0.0) -> DataFrame:
    """docs whose spans of at least this score are replaced by [KIND], where spans of different kinds don't overlap
    an earlier one."""
    spans = F.array_sort(F.filter(F.col("pii"), lambda s: s.score >= least), lambda a, b: F.when(a.start != b.start, F.signum(a.start - b.start)).otherwise(F.signum(b.end - a.end)).cast("int"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    text = F.coalesce(F.col(text_col), F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        kept = F.concat(acc.out, F.substr(text, acc.at + 1, s.start - acc.at), F.lit("["), F.upper(s.kind), F.lit("]"))
        return F.when(s.start >= acc.at, F.struct(s.end.alias("at"), kept.alias("out"))).otherwise(acc)

    masked = F.aggregate(spans, start, step, lambda acc: F.concat(acc.out, F.substr(text, acc.at + 1, F.length(text).cast("long"))))
    return find_pii(docs, text_col, kinds).withColumn(text_col, masked).drop("pii")
