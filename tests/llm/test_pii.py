import hashlib
import random
import re

from lodestone.llm import pii as P
from lodestone.llm import queries as Q

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


BITS = ["a@b.cc", "a@b.c.d", "x_y%z+1@q-r.st", "@", ".", "1.2.3.4", "256.1.1.1", "001.02.3.0004", "1.2.3.4.5.6.7.8", "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (839) 555-1724", "+49", "+1..2", "é", "🙂", "\n", " ", "-", "+", "12", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "99999999999.1.1.1", "tel ", "mail: ", "0000.0.0.0"]


def test_spans_match_a_plain_form(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(BITS) + rng.choice(["", "", " ", "x"]) for _ in range(rng.choice([1, 3, 10, 60]))) for _ in range(400)]
    texts += [None, "", "a" * 50_000, "1 " * 40_000, "12 3" * 20_000, "a@b" + ".c" * 30_000, "+1 " * 20_000, "1.2.3.4 " * 3000, "a" * 30_000 + "@b.c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'x' as kind", "3 as start")
    for r in Q.pii_digest(df).collect():
        want = base(texts[r.doc_id] or "")
        assert [s for s in r.spans.split(",") if s and not s.startswith("iban")] == want, texts[r.doc_id][:100]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k) for s in want) for k in PATTERNS)


def test_iban_context_and_masking(spark):
    text = "My konto: DE89 3704 0044 0532 0130 00, not DE88370400440532013000; mail me at a@b.cc!"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    found = P.find_pii(df).first().pii
    assert [(s.kind, text[s.start : s.end], round(s.score, 1)) for s in found] == [("email", "a@b.cc", 1.0), ("iban", "DE89 3704 0044 0532 0130 00", 0.9)]
    assert P.mask_pii(df).first().text == "My konto: [IBAN], not DE88370400440532013000; mail me at [EMAIL]!"


def test_empty_table(spark):
    assert Q.pii_digest(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
