import random
import re

from lodestone.llm import url_filter as U


def plain(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def plain_rule(host, path):
    fits = []
    for rule in U.RULES:
        own, start = rule[: rule.index("/")], rule[rule.index("/") :]
        if ("." + host).endswith("." + own) and path.startswith(start):
            fits.append(rule)
    return max(fits, key=len, default=None)


URLS = [
    None, "", "no url", "http://A.Example.ORG/es/x?y=1", "https://example.org/en/12#a", "http://x.org", "http://x.org/", "http://notexample.org/es/", "a://b://c/d",
    "http://É.com/fr/", "http://a.com/de/?q=/x", "http://a.com?x=/fr/", "http://com/fr/1", "ftp://free-bets.example.net/en/5", "://h/p", "http:///p", "http://xorg/",
]


def test_hosts_paths_and_rules(spark):
    rng = random.Random(1)
    urls = URLS + ["".join(rng.choice(["http", "://", "/", "?", "#", "example.org", ".com", "/en/1", "/fr/", "/de/", "A", "é"]) for _ in range(rng.randrange(8))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").selectExpr("*", "'x' as host", "1 as verdict")
    judge = U.fit(U.labelled())
    for r in U.judged(df).collect():
        host, path = plain(urls[r.page_id])
        rule = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        p = judge.probability(host, path)
        assert r.verdict == (U.RULES[rule] if rule else "block" if p >= U.BLOCK else "allow") and abs(r.probability - p) < 1e-9
    assert U.judged(df.limit(0)).count() == 0


def test_held_out_hosts():
    rows = U.labelled()
    hosts = sorted({h for h, _, _ in rows})
    random.Random(3).shuffle(hosts)
    right = total = 0
    for fold in range(5):
        out = set(hosts[fold::5])
        judge = U.fit([r for r in rows if r[0] not in out])
        for h, p, y in rows:
            if h in out:
                right += (judge.probability(h, p) >= U.BLOCK) == y
                total += 1
    assert right / total > 0.75
