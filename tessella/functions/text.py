"""Text functions as Column builders. Only NFKC, case folding and digests of several matches need Python (Arrow UDFs)."""

from __future__ import annotations

import functools
import hashlib
import json
import operator
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import rules, vocab

FULL = "".join(map(chr, (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), *range(0xFF10, 0xFF1A)))) + "\u3000"
HALF = "".join(chr(ord(c) - 0xFEE0) for c in FULL[:-1]) + " "


#: Unicode classes: blanks, letters, digits and word borders of all scripts, as the rules mean them.
UNICODE = "(?U)"


def _sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(UNICODE + pattern), F.lit(to))


def _fits(c: Column, pattern: str) -> Column:
    return c.rlike(UNICODE + pattern)


def fold_width(c: Column) -> Column:
    """Full-width letters, digits and blank become ASCII, zero-width characters vanish; other punctuation stays."""
    return F.translate(c, FULL + vocab.ZERO_WIDTH, HALF)


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def _nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def label_key_ascii(c: Column) -> Column:
    """label_key of ASCII text, without Python."""
    return _sub(F.lower(c), vocab.KEY_STRIP, "")


def label_key(c: Column) -> Column:
    """NFKC, case folded, without blanks and punctuation. Python runs only for text that is not ASCII."""
    ascii_only = ~c.rlike(r"[^\x00-\x7F]")
    return _sub(F.when(ascii_only, F.lower(c)).otherwise(_nfkc_casefold(F.when(~ascii_only, c))), vocab.KEY_STRIP, "")


def key_of(name: str) -> str:
    return re.sub(vocab.KEY_STRIP, "", unicodedata.normalize("NFKC", name).casefold())


LOOKUP = {key_of(a): label for label, names in vocab.ALIASES.items() for a in (*names, label)}


def canonical(c: Column, ascii_only: bool = False) -> Column:
    """Canonical label of an exact name; null for null, empty and unknown ones."""
    known = F.create_map(*(F.lit(x) for pair in LOOKUP.items() for x in pair))
    return F.try_element_at(known, label_key_ascii(c) if ascii_only else label_key(c))


def canonical_relaxed(c: Column, ascii_only: bool = False) -> Column:
    """canonical, else without side and severity words, else without their Chinese forms."""
    words = F.split(trimmed(c), UNICODE + r"[\s\-_/,]+")
    kept = F.filter(words, lambda w: (w != "") & ~F.lower(F.btrim(w, F.lit("."))).isin(*vocab.QUALIFIERS))
    fewer = F.when((F.size(kept) > 0) & (F.size(kept) != F.size(words)), F.array_join(kept, " "))
    bare = _sub(c, vocab.CJK_QUALIFIER, "")
    return F.coalesce(canonical(c, ascii_only), canonical(fewer, ascii_only), canonical(F.when((bare != "") & (bare != c), bare), ascii_only))


def is_negated(c: Column) -> Column:
    return _fits(trimmed(c), vocab.NEGATED_LABEL)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Characters that Unicode keeps for programs' own use, one for each rule for identifiers; they vanish from texts.
_MARKS = "".join(chr(0xFDD0 + k) for k in range(len(rules.IDENTIFIERS)))


def _need(value: str, context: str) -> str:
    """What a text must hold for a rule to match: the rule's context, a digit, a caret, or the names of institutions that end its value."""
    return r"\d" if r"\d" in value else context or (r"\^" if r"\^" in value else value[value.rindex("(?:") :].removesuffix("(?![0-9A-Za-z])"))


def scrubbed(c: Column) -> Column:
    """struct<now, fired>: the text without identifiers, and the kinds of the rules that fired, in order.

    Rules with the same need (a digit, a label before a name) run only where the text meets it. A rule leaves its own mark
    in what it puts in place of a value, and the marks tell in the end which rules fired, so each runs once.
    """
    groups: list[tuple[str, list[tuple[str, str]]]] = []
    for mark, (kind, value, context) in zip(_MARKS, rules.IDENTIFIERS):
        step = f"(?<ctx>{context})(?:{value})", "${ctx}[" + mark + f"REDACTED:{kind}]"
        if not groups or groups[-1][0] != _need(value, context):
            groups.append((_need(value, context), []))
        groups[-1][1].append(step)

    def run(need: str, steps: list[tuple[str, str]]) -> Callable[[Column], Column]:
        def of(x: Column) -> Column:
            now = x
            for pattern, to in steps:
                now = _sub(now, pattern, to)
            return F.when(_fits(x, need), now).otherwise(x)

        return of

    now = F.translate(fold_width(c), _MARKS, "")
    for need, steps in groups:
        now = _bound(now, run(need, steps))
    told = lambda x: F.array_compact(F.array(*(F.when(F.contains(x, F.lit(m)), F.lit(kind)) for m, (kind, _, _) in zip(_MARKS, rules.IDENTIFIERS))))
    return _bound(now, lambda x: F.named_struct(F.lit("now"), F.translate(x, _MARKS, ""), F.lit("fired"), told(x)))


def scrub(c: Column) -> tuple[Column, Column]:
    """The fields of scrubbed(); who needs both keeps the struct in a column first, so that it is computed once."""
    both = scrubbed(c)
    return both["now"], both["fired"]


def trimmed(c: Column) -> Column:
    """Without blanks of any script at its ends."""
    return _sub(c, r"^\s+|\s+$", "")


def redact(c: Column) -> Column:
    for pattern, to in rules.REDACTIONS:
        c = _sub(c, pattern, to)
    return c


def sanitize(c: Column, nfkc: bool = True) -> Column:
    """NFKC, without zero-width characters, every run of blanks one, trimmed; null is empty."""
    t = F.translate(_nfkc(c) if nfkc else c, vocab.ZERO_WIDTH + vocab.SOFT_HYPHEN, "")
    return F.trim(_sub(F.coalesce(t, F.lit("")), r"\s+", " "))


def injection_category(c: Column, nfkc: bool = True) -> Column:
    """First attack category of the text, or empty."""
    t = sanitize(c, nfkc)
    out = F.lit("")
    for pattern, category in reversed(rules.ATTACKS):
        out = F.when(_fits(t, pattern), F.lit(category)).otherwise(out)
    return out


def untrusted(c: Column, label: str = "UNTRUSTED") -> Column:
    """The text without attacks, its tags defused, wrapped."""
    t = sanitize(c)
    for pattern in (*(p for p, _ in rules.ATTACKS), rules.VERDICT_FORCING):
        t = _sub(t, pattern, "[removed]")
    return F.concat(F.lit(f"<{label}>"), F.translate(t, "<>", "‹›"), F.lit(f"</{label}>"))


#: What a text must hold for any rule of committing language to match: texts without it skip all rules.
_COMMITTING = "(?i)诊|排除|除外|建议|" + "|".join(("diagnos", "rule", "exclude", "prescrib", "start", "initiate", "administer", "treat"))


def redlines(c: Column) -> Column:
    """array<struct<kind, matched, start, end>> of every rule's matches after folding widths, rule by rule; overlaps are all given.

    Texts are folded once, and only those that hold a word of some rule are searched by the rules. Spans come from the
    lengths of what stands between the matches.
    """
    of = "array<struct<kind: string, matched: string, start: int, end: int>>"

    def one(t: Column, kind: str, pattern: str) -> Column:
        pattern = UNICODE + "(?i)" + pattern
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        gaps = F.transform(F.split(t, pattern, -1), F.length)
        upto = lambda lengths, i: F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda x, n: x + n)

        def at(m: Column, i: Column) -> Column:
            start = upto(gaps, i + 1) + upto(F.transform(found, F.length), i)
            return F.struct(F.lit(kind).alias("kind"), m.alias("matched"), start.alias("start"), (start + F.length(m)).alias("end"))

        return F.transform(found, at)

    def every(t: Column) -> Column:
        return F.when(_fits(t, _COMMITTING), F.flatten(F.array(*(one(t, *rule) for rule in rules.REDLINES)))).otherwise(F.array().cast(of))

    # bound to a variable, the folded text is one value for all rules
    return F.get(F.transform(F.array(fold_width(c)), every), F.lit(0))


def neutral(c: Column) -> Column:
    for pattern, to in rules.NEUTRAL:
        c = _sub(c, pattern, to)
    return c


def has_disclaimer(c: Column) -> Column:
    """Says that a machine wrote it and that a physician must review it."""
    t = F.coalesce(fold_width(c), F.lit(""))
    any_of = lambda of, words: of.rlike("|".join(map(re.escape, words)))
    return any_of(F.upper(t), vocab.MACHINE_WORDS) & any_of(t, vocab.REVIEW_WORDS)


def drop_marked(c: Column, mark: str = "XXXX") -> Column:
    """Without whole words that hold mark, then without orphaned leading conjunctions and punctuation; others unchanged."""
    words = F.filter(F.split(F.trim(_sub(c, r"\s+", " ")), " "), lambda w: ~w.contains(mark) & (w != ""))
    # a chain in which each step reads the one before once: words now stand one blank apart, and what is left begins with a letter or digit
    text = F.regexp_replace(F.array_join(words, " "), r"^(?i:[.,;:]*+(?:and|or|but)[.,;:]*+(?: |\z))++", "")
    text = F.regexp_replace(text, r"^(?:[^ \p{L}\p{N}]++(?: |\z))++", "")
    return F.when(c.contains(mark), F.regexp_replace(text, " ([.,;:])", "$1")).otherwise(c)


def segments(c: Column) -> Column:
    """Clauses without list markers, blank ones left out."""
    parts = F.split(F.coalesce(c, F.lit("")), "[.;,\n。；，]+")
    return F.filter(F.transform(parts, lambda x: trimmed(_sub(x, r"^\s*(?:\d+[.)]|[-•])\s*", ""))), lambda x: x != "")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, UNICODE + r"(?<=[.!?])\s+"), trimmed), lambda x: x != "")


def confidence(c: Column) -> Column:
    """Score of a confidence phrase: the longest known phrase that it contains decides, 0.3 without one."""
    t = F.lower(trimmed(F.coalesce(c, F.lit(""))))
    words = sorted(((w, p) for p, ws in vocab.CONFIDENCE.items() for w in ws), key=lambda x: -len(x[0]))
    out = F.lit(0.3)
    for word, p in reversed(words):
        out = F.when(t.contains(word), F.lit(p)).otherwise(out)
    return out


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def mention_class(sentence: Column, keyword: Column) -> Column:
    """negated, hedge or affirmed, by what stands before the keyword in its sentence."""

    def of(prefix: Column) -> Column:
        has = lambda words: functools.reduce(operator.or_, (prefix.contains(w) for w in words))
        return F.when(has(vocab.NEGATION_TRIGGERS), "negated").when(has(vocab.HEDGE_TRIGGERS), "hedge").otherwise("affirmed")

    # a keyword that is not there has an empty prefix, in which nothing is found
    before = lambda low: F.concat(F.substring(low, F.lit(1), F.call_function("locate", keyword, low) - 1), F.lit(" "))
    return _once(_once(F.lower(sentence), before), of)


def effusion_severity(sentence: Column) -> Column:
    low = F.lower(sentence)
    any_of = lambda words: _fits(low, r"\b(" + "|".join(words) + r")\b")
    return F.when(any_of(vocab.LARGE_WORDS), "large").when(any_of(vocab.SMALL_WORDS), "small").otherwise("unspecified")


def mentions(text: Column) -> Column:
    """array<struct<sentence, keyword, label, classification, severity>> of every sentence and keyword in it."""

    def of(s: Column) -> Column:
        hits = [
            F.when(
                F.lower(s).contains(k),
                F.struct(s.alias("sentence"), F.lit(k).alias("keyword"), F.lit(label).alias("label"), mention_class(s, F.lit(k)).alias("classification"), F.when(F.lit(label == "PleuralEffusion"), effusion_severity(s)).alias("severity")),
            )
            for k, label in vocab.MENTION_KEYWORDS.items()
        ]
        return F.array_compact(F.array(*hits))

    return F.flatten(F.transform(sentences(text), of))


def weak_labels(mesh: Column) -> Column:
    """Canonical labels of the heads of "head/qualifier" terms, distinct. Headings are ASCII, so no Python runs."""
    return F.array_distinct(F.array_compact(F.transform(mesh, lambda m: canonical(F.trim(F.split(m, "/")[0]), ascii_only=True))))


#: What counts as an embedded image, and what stands for it.
_URI = re.compile(r"data:([\w.+-]+/[\w.+-]+);base64,([A-Za-z0-9+/=]{32,})")
_MASK = "[MASKED {} · sha256:{} · {} b64 chars]"


@F.pandas_udf(StringType())
def mask_data_uris(s: pd.Series) -> pd.Series:
    """Each embedded image becomes its type, the start of its digest and its length. A text that can't be masked is withheld."""

    def mask(x: str | None) -> str | None:
        try:
            return None if x is None else _URI.sub(lambda m: _MASK.format(m[1], hashlib.sha256(m[2].encode()).hexdigest()[:12], len(m[2])), x)
        except Exception:
            return "[withheld]"

    return s.map(mask)


#: A JSON string as it is written, and the colon that makes it a key.
_JSON_STRING = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*+:?'


def string_leaves(doc: Column) -> Column:
    """array<string>: every string value within a JSON document, in order, keys left out; of a key given twice both values; none where it does not parse; null for null."""
    written = F.filter(F.regexp_extract_all(doc, F.lit(_JSON_STRING), 0), lambda x: ~x.endswith(":"))
    values = F.from_json(F.concat(F.lit("["), F.array_join(written, ","), F.lit("]")), "array<string>")
    return F.when(F.get_json_object(doc, "$").isNotNull(), values).when(doc.isNotNull(), F.array().cast("array<string>"))


def film_reference(path: Column, content: Column) -> Column:
    """What stands for a film in a traced prompt: its type, the start of its digest and its name; never its pixels."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    kind = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in vocab.FILM_TYPES.items() for x in pair)), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))), F.lit("image/png"))
    digest = F.coalesce(F.substring(F.sha2(content, 256), 1, 12), F.lit("unreadable"))
    return F.concat(F.lit("[MASKED "), kind, F.lit(" · sha256:"), digest, F.lit(" · "), name, F.lit("]"))


def generation_input(prompt: Column, reference: Column, system: Column | None = None) -> Column:
    """A traced request as a JSON list of messages, the film by its reference."""
    part = lambda kind, text, url: F.struct(F.lit(kind).alias("type"), text.alias("text"), F.when(url.isNotNull(), F.struct(url.alias("url"))).alias("image_url"))
    none = F.lit(None).cast("string")
    user = F.to_json(F.struct(F.lit("user").alias("role"), F.array(part("text", prompt, none), part("image_url", none, reference)).alias("content")))
    first = F.lit(None).cast("string") if system is None else F.when(system != "", F.to_json(F.struct(F.lit("system").alias("role"), system.alias("content"))))
    return F.concat(F.lit("["), F.concat_ws(",", first, user), F.lit("]"))


def token_totals(prompt: Column, completion: Column, total: Column) -> Column:
    """struct<input, output, total>: zero means unknown and is null; without a total the sum of its parts counts."""
    known = lambda c: F.nullif(F.coalesce(c.cast("long"), F.lit(0)), F.lit(0))
    both = F.coalesce(total.cast("long"), F.coalesce(prompt, F.lit(0)).cast("long") + F.coalesce(completion, F.lit(0)).cast("long"))
    return F.struct(known(prompt).alias("input"), known(completion).alias("output"), known(both).alias("total"))
