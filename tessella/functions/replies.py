"""Model replies: tolerant JSON, then rows. Fences and single values parse in the JVM; scanning for a value needs an Arrow UDF."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import text, vocab

ITEM = "label string, confidence string, laterality string, severity string, description string, negated boolean"
SENTENCE = "text string, section string, evidence_ids array<string>"
# Fixed value: a fenced block.
_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)


def first_value(reply: str | None, openers: str = "[{", fence: bool = True) -> str | None:
    """The first value that parses at an opener: within the fenced block if there is one, else anywhere in the reply."""
    if not reply:
        return None
    inside = _FENCE.search(reply) if fence else None
    text_ = inside[1] if inside else reply
    decoder = json.JSONDecoder()
    for at in (i for i, c in enumerate(text_) if c in openers):
        try:
            return json.dumps(decoder.raw_decode(text_, at)[0], ensure_ascii=False)
        except ValueError:
            pass
    return None


@F.pandas_udf(StringType())
def json_value(s: pd.Series) -> pd.Series:
    return s.map(first_value)


@F.pandas_udf(StringType())
def json_object(s: pd.Series) -> pd.Series:
    return s.map(lambda x: first_value(x, "{", False))


def items(reply: Column) -> Column:
    """array of ITEM structs of a list, of an object's findings, or of a bare object; elements that are no objects are left out; null if nothing parses."""
    value = json_value(reply)
    wrapped = F.get_json_object(value, "$.findings")
    given = F.when(F.coalesce(wrapped, F.lit("")).startswith("["), wrapped).otherwise(value)
    each = F.when(given.startswith("["), F.from_json(given, "array<string>")).when(given.startswith("{"), F.array(given))
    return F.transform(F.filter(each, lambda x: F.coalesce(F.ltrim(x).startswith("{"), F.lit(False))), lambda x: F.from_json(x, ITEM))


def findings(reply: Column) -> Column:
    """array<struct<raw_label, label, prob, notes>> of the items with a label, the negated ones left out; side and severity are notes."""
    blank = lambda c: F.coalesce(text.trimmed(c), F.lit("")) == ""
    kept = F.filter(items(reply), lambda x: ~blank(x["label"]) & ~F.coalesce(x["negated"], F.lit(False)) & ~text.is_negated(x["label"]))
    note = lambda x, name: F.when(~blank(x[name]), F.concat(F.lit(f"{name}: "), text.trimmed(x[name])))

    def finding(x: Column) -> Column:
        raw = text.trimmed(x["label"])
        return F.struct(raw.alias("raw_label"), text.canonical_relaxed(raw, ascii_only=True).alias("label"), score(x["confidence"]).alias("prob"), F.array_compact(F.array(note(x, "laterality"), note(x, "severity"))).alias("notes"))

    return F.transform(kept, finding)


def score(c: Column) -> Column:
    """A number is clamped to 0..1; words go through their table; true and false are the lowest."""
    number = c.try_cast("double")
    return F.when(F.lower(c).isin("true", "false"), F.lit(0.3)).when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))).otherwise(text.confidence(c))


def descriptions(reply: Column) -> Column:
    return F.transform(F.filter(items(reply), lambda x: F.trim(x["label"]) != ""), lambda x: F.struct(x["label"].alias("raw_label"), F.coalesce(x["description"], x["label"]).alias("text")))


def verdict(reply: Column) -> Column:
    """The object's verdict; else the first of the three words that stands in the reply; else UNCERTAIN."""
    words = ("CONFIRM", "REJECT", "UNCERTAIN")
    given = F.upper(F.trim(F.get_json_object(json_object(reply), "$.verdict")))
    out = F.lit("UNCERTAIN")
    for w in reversed(words):
        out = F.when(F.upper(reply).rlike(rf"\b{w}\b"), F.lit(w)).otherwise(out)
    return F.coalesce(F.when(given.isin(*words), given), out)


def draft_sentences(reply: Column) -> Column:
    """array<SENTENCE> in section order: of an object keyed by section, of {sentences: []}, of a flat list, or of one sentence; blank ones dropped."""
    value = json_value(reply)
    flat = F.from_json(F.coalesce(F.get_json_object(value, "$.sentences"), value), f"array<struct<{SENTENCE}>>")
    keyed = F.from_json(value, ", ".join(f"{s} array<struct<text: string, evidence_ids: array<string>>>" for s in vocab.SECTIONS))
    none = F.array().cast(f"array<struct<{SENTENCE}>>")
    of = lambda s: F.coalesce(F.transform(keyed[s], lambda x: F.struct(x["text"].alias("text"), F.lit(s).alias("section"), x["evidence_ids"].alias("evidence_ids"))), none)
    by_key = F.concat(*(of(s) for s in vocab.SECTIONS))
    in_section = lambda s: F.filter(F.coalesce(flat, none), lambda x: x["section"] == s)
    ordered = F.concat(*map(in_section, vocab.SECTIONS))
    return F.filter(F.when(F.size(by_key) > 0, by_key).otherwise(ordered), lambda x: F.coalesce(F.trim(x["text"]) != "", F.lit(False)))
