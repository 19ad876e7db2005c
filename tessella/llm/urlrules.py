"""Operator 2, URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern in the syntax of common filter lists: `||` anchors at a host or any of its subdomains, `|` at the
start or end, `^` is a separator or the end, `*` any run, all else literal; it is matched against lower(host) + path.
A rule's literal tokens are the runs of [a-z0-9] that the pattern bounds on both sides, so a url that the rule matches
holds each of them as a whole token. The index files each rule under the one that is rarest in the urls at hand; a
url's tokens fetch candidates, and only candidates run their regular expressions. Rules without such a token are
candidates everywhere.

Site rules (host, path) are filed in the same way, under the rarest token of their host and path; the longest that fits
a url decides. read_rules() reads patterns from a filter list. Otherwise the pattern rules decide: block if a block pattern fits and no allow pattern does, else allow.

Token counts cover all urls but keep only tokens of the rules, so both they and the index are bounded by the rule list,
which is broadcast once (about 1 kB a rule: lists of some hundred thousand rules, not of rules that grow with the pages).

Defined cases: a null url or one without :// has empty host and path, no rule, verdict allow. Repeated rows are judged
alike, null page_ids pass through, extra columns are ignored, empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, map_arrow, table

_FOLD = str.maketrans(UPPER, LOWER)
_TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Site:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Pattern:
    text: str
    verdict: str = "block"


SITES = (
    Site("com", "/", "allow"),
    Site("example.com", "/en/", "block"),
    Site("www.example.com", "/en/", "allow"),
    Site("net", "/es/", "block"),
    Site("net", "/fr/", "block"),
)
#: Gambling, adult, pharmacy and download spam; pages of trackers and logins. Allow patterns are exceptions.
PATTERNS = (
    *(Pattern(f"^{w}^") for w in ("casino", "poker", "jackpot", "slots", "betting", "porn", "xxx", "sex", "escort", "viagra", "cialis", "warez", "torrent", "crack", "keygen", "replica", "payday", "loans", "lottery", "malware")),
    Pattern("^cheap^pills^"),
    Pattern("^adult^*.html|"),
    Pattern("/wp-login.php"),
    Pattern("/track^click^"),
    Pattern("^sex^education^", "allow"),
    Pattern("||health.example.org^viagra^", "allow"),
)


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    if url is None or "://" not in url:
        return "", ""
    rest = re.split("[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_FOLD), slash + path


def regex_of(text: str) -> str:
    """The regular expression of a pattern; RE2, Java and Python read it alike."""
    out = ""
    if text.startswith("||"):
        out, text = r"^([^/]*\.)?", text[2:]
    elif text.startswith("|"):
        out, text = "^", text[1:]
    end = text.endswith("|")
    for c in text[:-1] if end else text:
        out += r"([^a-z0-9]|^|$)" if c == "^" else ".*" if c == "*" else re.escape(c) if c in r".\+?()[]{}" else c
    return out + ("$" if end else "")


def literal_tokens(text: str) -> list[str]:
    """Tokens that every url which the pattern fits must hold whole."""
    body = text.removeprefix("||").removeprefix("|")
    anchored = len(body) < len(text)
    end = body.endswith("|")
    body = body[:-1] if end else body
    found = []
    for m in _TOKEN.finditer(body):
        left = body[m.start() - 1] != "*" if m.start() else anchored
        right = body[m.end()] != "*" if m.end() < len(body) else end
        if left and right:
            found.append(m[0])
    return found


def site_tokens(rule: Site) -> list[str]:
    """Tokens that every url which the site rule fits must hold whole: those of its host, and of its path but an open last one."""
    path = rule.path.translate(_FOLD)
    return [*_TOKEN.findall(rule.host), *(m[0] for m in _TOKEN.finditer(path) if m.end() < len(path))]


#: Options of a rule that don't narrow what it fits here.
PLAIN_OPTIONS = {"important", "all", "doc", "document"}


@dataclass(frozen=True)
class Rules:
    """What a filter list holds: its url rules, and how many lines of each kind were left out, as a url alone can't decide them."""

    patterns: tuple[Pattern, ...]
    skipped: dict[str, int]


def read_rules(lines: Iterable[str]) -> Rules:
    """Rules of a filter list, which read a url in any case. `@@` before a rule allows, `!` and `[` begin comments.

    A scheme at a rule's start is left off, as patterns begin with the host. Lines are skipped and counted that hide
    elements (`##`, `#@#` and the like), are regular expressions (`/.../`) or have options that narrow them
    (`$third-party`, `$domain=`, types of requests).
    """
    patterns, skipped = [], defaultdict(int)
    for line in map(str.strip, lines):
        if not line or line[0] in "![":
            continue
        if re.search(r"#[@?$%]*#", line):
            skipped["element"] += 1
            continue
        verdict = "allow" if line.startswith("@@") else "block"
        body, _, options = line.removeprefix("@@").partition("$")
        if len(body) > 1 and body[0] == body[-1] == "/" and re.search(r"[\\^$*+?()|{}\[\]]", body.strip("/")):
            skipped["expression"] += 1
        elif options and not {o.strip() for o in options.split(",")} <= PLAIN_OPTIONS:
            skipped["options"] += 1
        elif text := re.sub(r"^(\|?)[a-z*]+://", r"\1", body.translate(_FOLD)).strip():
            patterns.append(Pattern(text, verdict))
    return Rules(tuple(patterns), dict(skipped))


def token_counts(pages: DataFrame, wanted: list[str]) -> dict[str, int]:
    """In how many urls of all pages each wanted token occurs: at most one row for each token of the rules."""
    if not wanted:
        return {}
    spark = pages.sparkSession
    tokens = pages.select(F.explode(F.array_distinct(F.split(F.translate("url", UPPER, LOWER), "[^a-z0-9]+"))).alias("token"))
    # a row for each token of the rules
    keep = spark.createDataFrame([(x,) for x in wanted], "token string")
    return dict(tuple(r) for r in tokens.join(F.broadcast(keep), "token", "left_semi").groupBy("token").count().collect())


class Index:
    """Rules by their rarest token. Picklable; regular expressions are compiled on first use."""

    def __init__(self, sites: tuple[Site, ...], patterns: tuple[Pattern, ...], counts: dict[str, int]):
        self.by_token: dict[str, list] = defaultdict(list)
        self.always: list = []
        rare = lambda tokens: min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default=None)
        for rule in (*sites, *patterns):
            token = rare(site_tokens(rule) if isinstance(rule, Site) else literal_tokens(rule.text))
            (self.always if token is None else self.by_token[token]).append(rule)
        self.compiled: dict[str, re.Pattern] = {}

    def fits(self, p: Pattern, target: str) -> bool:
        if (found := self.compiled.get(p.text)) is None:
            found = self.compiled[p.text] = re.compile(regex_of(p.text), re.S)
        return found.search(target) is not None

    def judge(self, host: str, path: str) -> tuple[str | None, str, str | None, int]:
        """Deciding site rule, verdict, deciding pattern, number of candidates."""
        target = (host + path).translate(_FOLD)
        candidates = [*self.always, *(r for t in {*_TOKEN.findall(target)} for r in self.by_token.get(t, ()))]
        best, hits = None, {}
        for r in candidates:
            if isinstance(r, Site):
                if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or (len(r.name), r.name) > (len(best.name), best.name)):
                    best = r
            elif host and self.fits(r, target):
                hits.setdefault(r.verdict, []).append(r.text)
        if best is not None:
            return best.name, best.verdict, None, len(candidates)
        if "block" in hits and "allow" not in hits:
            return None, "block", min(hits["block"]), len(candidates)
        return None, "allow", min(hits["allow"]) if "allow" in hits else None, len(candidates)


def filter_urls(pages: DataFrame, sites: tuple[Site, ...] = SITES, patterns: tuple[Pattern, ...] = PATTERNS) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern, candidates for every page."""
    wanted = sorted({*(t for p in patterns for t in literal_tokens(p.text)), *(t for s in sites for t in site_tokens(s))})
    index = pages.sparkSession.sparkContext.broadcast(Index(sites, patterns, token_counts(pages, wanted)))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        split = [parts(u) for u in b.column(1).to_pylist()]
        rule, verdict, pattern, n = zip(*(index.value.judge(*x) for x in split))
        host, path = zip(*split)
        columns = [b.column(0).cast(pa.int64()), *(pa.array(x, pa.string()) for x in (host, path, rule, verdict, pattern)), pa.array(n, pa.int32())]
        return pa.record_batch(columns, names=["page_id", "host", "path", "rule", "verdict", "pattern", "candidates"])

    return map_arrow(pages.select("page_id", "url"), run, "page_id long, host string, path string, rule string, verdict string, pattern string, candidates int")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).drop("pattern", "candidates")


def oracle() -> str:
    """Every rule against every url, without an index."""
    any_of = lambda v: " OR ".join(f"regexp_matches(t, '{regex_of(p.text)}', 's')" for p in PATTERNS if p.verdict == v)
    fit = lambda s: f"(host = '{s.host}' OR suffix(host, '.{s.host}')) AND prefix(path, '{s.path}')"
    longest = sorted(SITES, key=lambda s: -len(s.name))
    return rf"""
WITH a AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a
), c AS (
  SELECT *, translate(host || path, '{UPPER}', '{LOWER}') AS t, CASE {" ".join(f"WHEN {fit(s)} THEN '{s.name}'" for s in longest)} END AS rule FROM b
)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{s.name}' THEN '{s.verdict}'" for s in longest)}
  WHEN host <> '' AND ({any_of("block")}) AND NOT ({any_of("allow")}) THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""
