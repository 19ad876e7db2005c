"""Operator 13, secret scans: parts of credentials linked by an interval join within scopes.

Base spans are certain: assignments to secret names, access keys, long hexadecimal runs. Other forms are weak: a name, an
e-mail address, a host or a run of mixed characters is no secret by itself. Weak parts are of three classes:
identifiers (accounts and key ids), endpoints (URLs, hosts, addresses) and secrets (runs of letters and digits, labelled
pass phrases); base spans count as secrets (assignments, hexadecimal runs) or identifiers (access keys) as well. A weak
part is reported only when a complementary one stands within REACH code points of it in its scope, a paragraph: a secret
beside an identifier or endpoint, an identifier or endpoint beside a secret.

Base spans and parts are found by batches of whole texts. Documents that hold both sides of a pair, a small share, go on
to the interval join: their parts are dealt by document, sorted within each scope, and each part meets the nearest
complementary part before and after it by running extremes. That is linear in the parts: no pair is formed, however many
lie within reach of each other. Parts of one document are disjoint (a part that overlaps one of an earlier class goes,
base spans first), so the nearest one is also the one whose end (or start) is nearest.

Positions count code points, ends are exclusive. Defined cases: null text is empty and has no spans; repeated rows and
null doc_ids are rows of their own; extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, map_arrow, table, texts


def _either(word: str) -> str:
    """A pattern of an ASCII word in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
#: Base kinds in their order: pattern, group that must have so many characters.
BASE = {
    "assign": (rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Weak classes in the order in which they take text. Patterns mean the same to RE2; what may stand before a sign that must follow is bounded, so time is linear.
_LABEL = r"[\"']?\x20*[:=]\x20*[\"']?"
_ACCOUNT = "|".join(map(_either, ("client_id", "access_key_id", "account", "username", "user", "login")))
_HOST = "|".join(map(_either, ("endpoint", "hostname", "host", "server")))
_PHRASE = "|".join(map(_either, ("passphrase", "pwd", "private_key", "signature", "auth")))
WEAK = {
    "identifier": rf"A(?:KIA|SIA|IDA|ROA)[A-Z0-9]{{12,}}|({_ACCOUNT}){_LABEL}[A-Za-z0-9@._-]{{3,}}|[A-Za-z0-9._%+-]{{1,64}}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "endpoint": rf"[A-Za-z][A-Za-z0-9+.-]{{0,31}}://[^\x00-\x20\"'<>\x7f]+|({_HOST}){_LABEL}[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?|[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}(?::[0-9]+)?",
    "secret": rf"({_PHRASE}){_LABEL}[A-Za-z0-9+/_.=-]{{4,}}|[A-Za-z0-9+/_-]{{20,}}=*",
}
KINDS = [*BASE, *WEAK]
#: Which side of a pair a kind stands for.
SECRETS = {"assign", "hex", "secret"}
REACH = 300
_BASE = {k: (re.compile(p.encode()), g, n) for k, (p, g, n) in BASE.items()}
_BASE["hex"] = (re.compile(rb"[0-9a-f]{24,}"), 0, 24)  # maximal runs of 24 or more, found without the shorter ones
_WEAK = {k: re.compile(p.encode()) for k, p in WEAK.items()}
_BREAK = re.compile(rb"\n[\x20\x09-\x0D]*\n")
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_NAMED = [(b"passw", b"secret", b"token", b"api"), (b"client_id", b"access_key_id", b"account", b"user", b"login"), (b"endpoint", b"host", b"server"), (b"passphrase", b"pwd", b"private_key", b"signature", b"auth")]
_MIXED = re.compile(rb"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])", re.S)


def mixed(found: bytes) -> bool:
    """Whether a weak secret is labelled or holds digits, capitals and small letters: plain long words do not."""
    return found[:20].translate(_FOLD).startswith(_NAMED[3]) or _MIXED.match(found) is not None


def base_spans(text: bytes, low: bytes) -> list[tuple[int, int, int]]:
    """Kind, start, end in bytes of the base spans; low is the text in lower case. Kinds whose literals are missing aren't searched."""
    out = []
    for k, (kind, (pattern, group, least)) in enumerate(_BASE.items()):
        if (kind == "assign" and not any(x in low for x in _NAMED[0])) or (kind == "access" and b"AKIA" not in text):
            continue
        out += [(k, *m.span()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return out


def weak_parts(text: bytes, low: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak parts in bytes, disjoint from base spans and each other; none where the document lacks one side of a pair."""
    labels = b":" in text or b"=" in text
    named = lambda k: labels and any(x in low for x in _NAMED[k])
    may = {"identifier": b"@" in text or b"SIA" in text or b"AKIA" in text or b"IDA" in text or b"ROA" in text or named(1), "endpoint": b"://" in text or text.count(b".") >= 3 or named(2), "secret": True}
    if not (may["identifier"] or may["endpoint"] or base):
        return []
    taken = sorted((s, e) for _, s, e in base)
    out: list[tuple[int, int, int]] = []
    for k, (kind, pattern) in enumerate(_WEAK.items(), len(BASE)):
        if kind == "secret" and not out and not any(b[0] == 1 for b in base):
            break  # neither identifier nor endpoint
        if not may[kind]:
            continue
        # base spans may nest, so the furthest end before a start tells
        starts, ends = [s for s, _ in taken], np.maximum.accumulate([e for _, e in taken]) if taken else []
        own = []
        for m in pattern.finditer(text):
            if kind == "secret" and not mixed(m[0]):
                continue
            s, e = m.span()
            at = bisect_right(starts, s)
            if not ((at and ends[at - 1] > s) or (at < len(starts) and starts[at] < e)):
                own.append((k, s, e))
        out += own
        taken = sorted(taken + [(s, e) for _, s, e in own])
    classes = {KINDS[k] in SECRETS for k, _, _ in [*base, *out]}
    return out if len(classes) == 2 else []


def _points(text: bytes, at: list[int]) -> list[int]:
    """Offsets in code points of offsets in bytes."""
    if text.isascii():
        return at
    total = np.concatenate([[0], np.cumsum(np.frombuffer(text, np.int8) >= -64)])
    return total[at].tolist()


def spans_of(text: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Base spans (start, kind, end) in order; and, where weak parts may be linked, all parts (scope, start, kind, end). In code points."""
    low = text.translate(_FOLD)
    base = base_spans(text, low)
    weak = weak_parts(text, low, base)
    if not base and not weak:
        return [], []
    both = [*base, *weak]
    where = iter(_points(text, [x for _, s, e in both for x in (s, e)]))
    told = [(next(where), k, next(where)) for k, _, _ in both]
    scopes: list[int] = []
    if weak:
        breaks = [m.end() for m in _BREAK.finditer(text)]
        scopes = [bisect_right(breaks, s) for _, s, _ in both]
    return sorted(told[: len(base)]), [(c, *x) for c, x in zip(scopes, told)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


PART = "struct<scope:int,start:int,kind:int,end:int>"
SCANNED = f"doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, parts array<{PART}>"


def scan(docs: DataFrame) -> DataFrame:
    """SCANNED for every row of docs (doc_id, text): base spans, and the parts of documents that may hold linked ones."""
    kind = pa.list_(pa.struct([(x, pa.int32()) for x in ("scope", "start", "kind", "end")]))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        counts, hashes, spans, parts = [], [], [], []
        for t in texts(b.column(1)):
            base, all_parts = spans_of(t)
            of = [k for _, k, _ in base]
            counts.append([of.count(k) for k in range(len(BASE))])
            spans.append(joined(base))
            hashes.append(hashlib.sha256(spans[-1].encode()).hexdigest())
            parts.append([dict(zip(("scope", "start", "kind", "end"), x)) for x in all_parts])
        n = np.array(counts, np.int64).reshape(-1, len(BASE))
        columns = [b.column(0).cast(pa.int64()), *(pa.array(n[:, k]) for k in range(len(BASE))), pa.array(hashes, pa.string()), pa.array(spans, pa.string()), pa.array(parts, kind)]
        return pa.record_batch(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "parts"])

    return map_arrow(docs.select("doc_id", "text"), run, SCANNED)


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Of parts (row_id, scope, start, kind, end; one class's parts disjoint from the other's weak ones), base spans and those weak parts that have a complement within reach."""
    secret = F.col("kind").isin([KINDS.index(x) for x in SECRETS])
    scope = Window.partitionBy("row_id", "scope").orderBy("start", "kind")
    before, after = scope.rowsBetween(Window.unboundedPreceding, -1), scope.rowsBetween(1, Window.unboundedFollowing)
    ends = lambda c: F.max(F.when(c, F.col("end"))).over(before)
    starts = lambda c: F.min(F.when(c, F.col("start"))).over(after)
    near = parts.withColumns({"end_s": ends(secret), "end_o": ends(~secret), "start_s": starts(secret), "start_o": starts(~secret)})
    gap = lambda a, b: (F.col(b) - F.col(a)) <= reach
    met = F.when(secret, F.coalesce(gap("end_o", "start"), F.lit(False)) | F.coalesce(gap("end", "start_o"), F.lit(False))).otherwise(F.coalesce(gap("end_s", "start"), F.lit(False)) | F.coalesce(gap("end", "start_s"), F.lit(False)))
    return near.where((F.col("kind") < len(BASE)) | met).select("row_id", "scope", "start", "kind", "end")


def secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked of every row of docs."""
    # row ids are fixed by being written
    scanned = cut(scan(docs).withColumn("row_id", F.monotonically_increasing_id()), "scanned")
    plain = scanned.where("size(parts) = 0").drop("parts", "row_id").withColumn("n_linked", F.lit(0).cast("long"))
    some = scanned.where("size(parts) > 0").drop("spans")
    parts = some.select("row_id", F.inline("parts")).repartition("row_id")
    spans = linked(parts, reach).groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))  # of one document
    spans = spans.select("row_id", F.expr(f"array_join(transform(found, x -> concat_ws(':', element_at(array({', '.join(map(repr, KINDS))}), x.kind + 1), x.start, x.end)), ',')").alias("spans"), F.expr(f"size(filter(found, x -> x.kind >= {len(BASE)}))").cast("long").alias("n_linked"))
    rest = some.drop("parts").join(spans, "row_id", "left").drop("row_id").fillna("", ["spans"]).fillna(0, ["n_linked"])
    return plain.unionByName(rest)


def op13_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """Positions from the pieces between matches; every weak part against every other of its scope."""
    q = lambda p: p.replace("'", "''")

    def found(k: int, pattern: str, where: str) -> str:
        group, kept = (BASE[KINDS[k]][1], f"length(g) >= {BASE[KINDS[k]][2]}") if k < len(BASE) else (0, where)
        return f"""
  SELECT doc_id, t, {k} AS kind, s, s + length(m) AS e FROM (
    SELECT doc_id, t, m, g, (sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m))::BIGINT AS s FROM (
      SELECT doc_id, t, unnest(ms) AS m, unnest(gs) AS g, unnest(ps[:len(ms)]) AS p, unnest(range(len(ms))) AS i FROM (
        SELECT doc_id, t, regexp_extract_all(t, '{q(pattern)}', 0) AS ms, regexp_extract_all(t, '{q(pattern)}', {group}) AS gs, string_split_regex(t, '{q(pattern)}') AS ps FROM d))) WHERE {kept}"""

    labelled = f"regexp_matches(m, '^({_PHRASE})')"
    weak = {3: "true", 4: "true", 5: f"({labelled} OR (regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')))"}
    clear = lambda a, *others: " AND ".join(f"NOT EXISTS (FROM {o} o WHERE o.doc_id = {a}.doc_id AND o.s < {a}.e AND {a}.s < o.e)" for o in others)
    secret = lambda a: f"{a}.kind IN (0, 2, 5)"
    name = "CASE kind " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(KINDS)) + " END || ':' || s || ':' || e"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(found(k, BASE[x][0], "") for k, x in enumerate(BASE))}),
w3 AS (SELECT * FROM ({found(3, WEAK["identifier"], weak[3])}) a WHERE {clear("a", "base")}),
w4 AS (SELECT * FROM ({found(4, WEAK["endpoint"], weak[4])}) a WHERE {clear("a", "base", "w3")}),
w5 AS (SELECT * FROM ({found(5, WEAK["secret"], weak[5])}) a WHERE {clear("a", "base", "w3", "w4")}),
parts AS (SELECT *, len(regexp_extract_all(left(t, s), '\n[\x20\x09-\x0D]*\n')) AS scope FROM (FROM base UNION ALL FROM w3 UNION ALL FROM w4 UNION ALL FROM w5)),
kept AS (SELECT doc_id, kind, s, e FROM parts a WHERE kind < 3 OR EXISTS (FROM parts b WHERE a.doc_id = b.doc_id AND a.scope = b.scope AND ({secret("a")}) <> ({secret("b")}) AND (b.s - a.e BETWEEN 0 AND {REACH} OR a.s - b.e BETWEEN 0 AND {REACH}))),
j AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind > 2) AS n_linked,
    coalesce(string_agg({name}, ',' ORDER BY s, kind) FILTER (kind < 3), '') AS base, string_agg({name}, ',' ORDER BY s, kind) AS spans FROM kept GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM d LEFT JOIN j ON d.doc_id = j.doc_id
"""
