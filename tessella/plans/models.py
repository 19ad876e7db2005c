"""The model seam: batch functions behind two signatures, and the deterministic offline ones that are the default.

A live client is a function of a batch (a list of prompts, a list of image paths) to replies; it runs in an Arrow UDF that
is marked nondeterministic, so a plan neither repeats nor moves it, and its output is written before it is used twice.
With a ledger (plans/ledger.py) no reply is paid for twice, not even by a run that follows one that was killed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..config import Settings
from ..functions import text, vocab
from .ledger import TIMEOUT_S, Ledger, Replies, ask

# Lines of the offline report writer.
TECHNIQUE = "本检查为胸部正位（后前位）X线摄片。"
NEGATIVE = "本次胸部X线摄片未见明显异常征象。"
RECOMMENDATION = "建议结合临床病史及既往影像资料进一步随诊评估。"
DISCLAIMER = "本报告由AI生成，须经医师复核后签发。"
POSITIVE_LINE = "%s：概率约%.2f，提示阳性表现。"
NEGATIVE_LINE = "%s：概率约%.2f，未见明确异常征象。"
IMPRESSION = ("胸部X线摄片考虑", "、", "可能。")


@dataclass(frozen=True)
class Clients:
    """Live clients of the three calls; one that is missing leaves its offline stand-in in place."""

    reader: Replies | None = None
    arbiter: Replies | None = None
    writer: Replies | None = None


def calls(client: Replies, timeout: float = TIMEOUT_S, size: int = 8):
    """An Arrow UDF of prompt and image path to struct<reply, error>, in batches of size prompts; one that fails or takes over timeout seconds a prompt is tried once more, then its error is given."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for prompts, paths in batches:
            said, errors = [], []
            for at in range(0, len(prompts), size):
                some = slice(at, at + size)
                replies, error = ask(client, prompts[some].tolist(), paths[some].tolist(), timeout)
                said += replies
                errors += [error] * len(replies)
            yield pd.DataFrame({"reply": pd.Series(said, dtype=object), "error": pd.Series(errors, dtype=object)})

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, StructType([StructField("reply", StringType()), StructField("error", StringType())])).asNondeterministic()


def answered(rows: DataFrame, client: Replies, prompt: Column, image: Column, ledger: Ledger | None = None, name: str = "model", attempt: int = 1) -> DataFrame:
    """rows with said (reply and error), from the ledger where there is one. Else it is kept before it is used, so no plan asks twice: in the folder of spark.checkpoint.dir, or in memory where that is unset."""
    if ledger is not None:
        return ledger.answered(rows, client, prompt, image, name, attempt)
    out = rows.withColumn("said", calls(client)(prompt, image))
    if rows.sparkSession.conf.get("spark.checkpoint.dir", None) or rows.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir"):
        return out.checkpoint()
    return out.persist()


def checked_client(settings: Settings, key: str = "", model: str = "") -> None:
    """A live configuration that lacks key or model raises; it never falls back to the offline reader."""
    if settings.use_live_models and not (key and model):
        raise ValueError("live models need a key and a model name")


def offline_reader_b(impression: Column, prob: float = 0.9) -> Column:
    """array<struct<label, raw_label, prob>>: the clauses of the impression, the first of each canonical label or clause, negated ones left out."""
    known = F.transform(text.segments(impression), lambda s: F.struct(s.alias("raw"), text.canonical_relaxed(s, ascii_only=True).alias("label")))
    named = F.filter(known, lambda x: ~text.is_negated(x["raw"]))
    keys = F.transform(named, lambda x: F.coalesce(x["label"], x["raw"]))
    first = F.filter(F.transform(named, lambda x, i: F.struct(x.alias("x"), (F.array_position(keys, F.coalesce(x["label"], x["raw"])) == i + 1).alias("first"))), lambda y: y["first"])
    return F.transform(first, lambda y: F.struct(F.coalesce(y["x"]["label"], y["x"]["raw"]).alias("label"), y["x"]["raw"].alias("raw_label"), F.lit(prob).alias("prob"), y["x"]["label"].isNotNull().alias("mapped")))


def offline_report(found: Column, positive: float = 0.5) -> Column:
    """array<struct<text, section, evidence_ids>> from findings (array of structs with evidence_id, label, prob)."""
    sentence = lambda t, s, ids: F.struct(t.alias("text"), F.lit(s).alias("section"), ids.alias("evidence_ids"))
    none = F.array().cast("array<string>")
    ids = F.transform(found, lambda f: f["evidence_id"])
    hits = F.filter(found, lambda f: f["prob"] >= positive)
    line = lambda f: F.when(f["prob"] >= positive, F.format_string(POSITIVE_LINE, f["label"], f["prob"])).otherwise(F.format_string(NEGATIVE_LINE, f["label"], f["prob"]))
    names = F.array_join(F.array_distinct(F.transform(hits, lambda f: f["label"])), IMPRESSION[1])
    impression = F.when(F.size(hits) > 0, sentence(F.concat(F.lit(IMPRESSION[0]), names, F.lit(IMPRESSION[2])), "impression", F.transform(hits, lambda f: f["evidence_id"]))).otherwise(sentence(F.lit(NEGATIVE), "impression", ids))
    advice = F.when(F.size(ids) > 0, F.array(sentence(F.lit(RECOMMENDATION), "recommendation", ids))).otherwise(F.array().cast("array<struct<text: string, section: string, evidence_ids: array<string>>>"))
    return F.concat(F.array(sentence(F.lit(TECHNIQUE), "technique", none)), F.transform(found, lambda f: sentence(line(f), "findings", F.array(f["evidence_id"]))), F.array(impression), advice)


def reader_b_prompt(indication: Column, history: Column) -> Column:
    """What the second reader may see: indication and history, wrapped as untrusted; never what the first reader found."""
    return F.concat_ws("\n", F.lit("Read the film. Reply with a JSON list of findings: label, confidence, laterality, severity, negated."), text.untrusted(indication, "INDICATION"), text.untrusted(history, "HISTORY"))


def arbiter_prompt(disagreements: DataFrame, passages: str = "passages") -> Column:
    shown = lambda c: F.coalesce(F.format_string("%.2f", F.col(c)), F.lit("not reported"))
    return F.concat_ws("\n", F.concat(F.lit("label: "), F.col("label")), F.concat(F.lit("kind: "), F.col("kind")), F.concat(F.lit("first reader: "), shown("a_prob")), F.concat(F.lit("second reader: "), shown("b_prob")), F.array_join(F.col(passages), "\n"), F.lit('Reply with {"verdict": "CONFIRM|REJECT|UNCERTAIN", "reasoning": "..."}'))


def report_prompt(found: Column) -> Column:
    return F.concat_ws("\n", F.lit(f"Write a report with the sections {', '.join(vocab.SECTIONS)} as JSON; cite evidence ids."), F.array_join(F.transform(found, lambda f: F.format_string("evidence_id: %s label: %s probability: %.2f", f["evidence_id"], f["label"], f["prob"])), "\n"))
