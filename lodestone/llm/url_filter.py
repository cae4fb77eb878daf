"""URL judgements: domain rules, and logistic regression on hashed character n-grams elsewhere."""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

#: Rules as host/path: the host and all its subdomains, paths that start so. The longest that fits decides.
RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}

#: The labelled table, written for this module: hosts to block, hosts to allow. Each is listed with two of PATHS, so
#: that paths, languages and endings, alike on both sides, tell nothing; the paths behind a bar are listed besides.
BLOCKED = """
adult-videos.com xxx-tube.net free-porn-clips.com hot-escort-girls.net sexcams-live.com adult-dating.biz nude-pics.info
x-rated-movies.net porn-hd.org adult-chat.net casino-royal.com online-casino.net big-slots.win poker-club.biz win-jackpot.net
betting-tips.com sports-bets.net free-bet-bonus.com lotto-winner.info best-bets.com roulette-casino.org cheap-viagra.com
pills-online.net discount-pharmacy.biz cheap-meds.com diet-pills.info cheap-cialis.net generic-pills.com spam-mailer.net
spam-links.info link-farm.net content-farm.biz spam-blog.com article-farm.org ads-server.net ad-track.com track-clicks.net
ad-tracker.com popup-ads.info ads-media.net tracking-pixel.com banner-ads.biz payday-loan.com cheap-loans.net replica-watch.com
free-winner.net get-rich-quick.biz warez-downloads.net keygen-crack.com free-movies-dl.net malware-host.biz phishing-login.net
free-coins-hack.com miracle-diet.info adults-only.org xxx-live.com casino-bonus.net win-casino-cash.com free-slots.org
| free-porn/clip casino/bonus/100 buy/cheap-pills ads/click track/click?id=9 xxx/video bets/free spam/list
"""
ALLOWED = """
library.edu docs.python-guide.org wiki.history.net museum.art.org university.edu kitchen-recipes.com weather-today.net
cityhall.gov cycling-forum.net travel-notes.com school.net science-review.org mountain-photos.com readers.net theory.com
hospital.org region-maps.net theatre.com archive.net stories.org newsroom.net another.com nation.net therefore.com station.org
others.com thornton.net handstand.com ontario.net eastern.com reading.net blending.org nothing.com mention.net editions.org
nations.com tidings.net northern.com wherever.net shoreline.org heather.com anthem.net lantern.com rhetoric.edu threads.net
output.com question.net market-stalls.org open-source.net athletics.net address-book.net public-health.org winter-sports.net
alphabet.org advice.net thunder.net entire.com reason.net onward.org the-times.net in-the-north.com old-town.net tree-house.org
one-to-one.net at-home.com herding.net tention.org thesis.com hereto.net thanet.org errand.com isthmus.net inherent.com
| news/world/2021 articles/88 catalogue/12 album/3 lessons/5 projects/4 research/physics minutes/7
"""
PATHS = "en/3 de/49 fr/144.html es/12 en/264?page=2 de/7/ fr/22 en/ index.html a/123 en/601#top es/15/ 1890 page/9".split()
FRONTS = ("", "www.", "m.", "blog.")
BITS = 16
GRAMS = (3, 4, 5)
EPOCHS = 300
RATE = 0.5
DECAY = 2e-3
#: Probability from which a url without a rule is blocked.
BLOCK = 0.6
REMEMBER = 100_000

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_DIGITS = str.maketrans(string.digits, "0" * 10)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; the path then up
    to `?`, `#` or the end. A null, or one without `://`, has neither."""
    rest = (url or "").partition("://")[2]
    end = min((k for c in "/?#" if (k := rest.find(c)) >= 0), default=len(rest))
    host, rest = rest[:end].translate(_LOWER), rest[end:]
    end = min((k for c in "?#" if (k := rest.find(c)) >= 0), default=len(rest))
    return host, rest[:end]


def by_host(rules: Iterable[str]) -> dict[str, list[tuple[str, str]]]:
    """(start of the path, rule) of the rules of each host, longest first."""
    found: dict[str, list[tuple[str, str]]] = {}
    for rule in sorted(rules, key=len, reverse=True):
        own, slash, start = rule.partition("/")
        found.setdefault(own, []).append((slash + start, rule))
    return found


def fitting(host: str, path: str, index: dict[str, list[tuple[str, str]]]) -> str | None:
    """The longest rule that fits, looked up by the host and by what follows each of its dots, so that a url costs
    its dots and the rules of those hosts, not all rules."""
    best, own = None, host
    while True:
        rule = next((r for start, r in index.get(own, ()) if path.startswith(start)), None)
        if rule is not None and (best is None or len(rule) > len(best)):
            best = rule
        _, dot, own = own.partition(".")
        if not dot:
            return best


def rule_of(host: str, path: str, rules: dict[str, str] = RULES) -> str | None:
    return fitting(host, path, by_host(rules))


def grams(text: str, kind: str) -> list[int]:
    """Hashed character n-grams of a host or path, digits alike, with marks at both ends."""
    text = f"^{text.translate(_DIGITS)}$"
    found = {text[k : k + n] for n in GRAMS for k in range(len(text) - n + 1)}
    return [xxhash.xxh32_intdigest(kind + g) & ((1 << BITS) - 1) for g in found]


@dataclass
class Judge:
    bias: float
    weights: np.ndarray

    def part(self, text: str, kind: str) -> float:
        return float(self.weights[grams(text, kind)].sum())

    def probability(self, host: str, path: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.part(host, "h") + self.part(path, "p"), -30, 30))))


def labelled() -> list[tuple[str, str, int]]:
    """(host, path, label) of the table."""
    rows = []
    for listed, y in ((BLOCKED, 1), (ALLOWED, 0)):
        hosts, _, own = listed.partition("|")
        for k, host in enumerate(hosts.split()):
            rows += [(*split_url(f"http://{FRONTS[j % len(FRONTS)]}{host}/{PATHS[j % len(PATHS)]}"), y) for j in (2 * k, 2 * k + 1)]
        rows += [(*split_url(f"http://{host}/{path}"), y) for path in own.split() for host in ("site.com", "page.net")]
    return rows


def fit(rows: list[tuple[str, str, int]]) -> Judge:
    """Logistic regression by full-batch gradient steps with weight decay; the same weights each time."""
    ids = [grams(h, "h") + grams(p, "p") for h, p, _ in rows]
    owner, cols = np.repeat(np.arange(len(rows)), [len(x) for x in ids]), np.concatenate(ids)
    y, w, bias = np.array([r[2] for r in rows], float), np.zeros(1 << BITS), 0.0
    for _ in range(EPOCHS):
        raw = bias + np.bincount(owner, weights=w[cols], minlength=len(rows))
        error = (1 / (1 + np.exp(-raw)) - y) / len(rows)
        w -= RATE * (np.bincount(cols, weights=error[owner], minlength=len(w)) + DECAY * w)
        bias -= RATE * error.sum()
    return Judge(float(bias), w)


def judged(pages: DataFrame, judge: Judge | None = None, rules: dict[str, str] | None = None, block: float = BLOCK) -> DataFrame:
    """(page_id, host, path, rule, verdict, probability) per row of pages; a null or malformed url has an empty host
    and path and no rule, and is judged like any other. probability is the method's, whether or not a rule decides."""
    sent = pages.sparkSession.sparkContext.broadcast((judge or fit(labelled()), RULES if rules is None else rules))
    kind = pages.schema["page_id"].dataType
    names = ["page_id", "host", "path", "rule", "verdict", "probability"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, own = sent.value
        index = by_host(own)
        hosts: dict[str, float] = {}
        for b in batches:
            out = []
            for url in b.column(1).to_pylist():
                host, path = split_url(url)
                if host not in hosts:
                    if len(hosts) > REMEMBER:
                        hosts.clear()
                    hosts[host] = model.part(host, "h")
                raw = model.bias + hosts[host] + model.part(path, "p")
                p = float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))
                rule = fitting(host, path, index)
                out.append((host, path, rule, own[rule] if rule else ("block" if p >= block else "allow"), p))
            types = [pa.string()] * 4 + [pa.float64()]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=names)

    return pages.select("page_id", "url").mapInArrow(run, f"page_id {kind.simpleString()}, host string, path string, rule string, verdict string, probability double")

