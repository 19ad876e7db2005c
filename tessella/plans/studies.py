"""The study pipeline as one plan over all studies: intake, scrubbing, quality control, two readers, merge, triage,
arbitration, report, evidence check with one retry, language guard, status.

Inputs: studies (study_id, image_path, indication, impression_text, and the columns of quality control) and findings of
the first reader (findings schema). Alerts depend on the raw readings alone, never on the report branch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import replies, text, vocab
from ..operators import agreement, evidence, findings, retrieval, search
from . import models
from .ledger import Ledger

SENT = "array<struct<text: string, section: string, evidence_ids: array<string>>>"


def intake(studies: DataFrame) -> DataFrame:
    """blocked (no image) and notes (an injection only leaves a note)."""
    category = text.injection_category(F.concat_ws(" ", "indication", "history"))
    note = F.when(category != "", F.concat(F.lit("possible injection: "), category))
    return studies.withColumns({"blocked": F.coalesce(F.trim("image_path") == "", F.lit(True)), "notes": F.array_compact(F.array(note))})


def scrubbed(studies: DataFrame) -> DataFrame:
    for c in ("indication", "history"):
        studies = studies.withColumn("_scrubbed", text.scrubbed(F.coalesce(F.col(c), F.lit(""))))
        studies = studies.withColumns({f"{c}_fired": F.col("_scrubbed.fired"), f"{c}_sha": F.sha2(F.coalesce(c, F.lit("")), 256), c: F.col("_scrubbed.now")}).drop("_scrubbed")
    return studies


def controlled(studies: DataFrame, settings: Settings) -> DataFrame:
    issues, ok = search.qc_issues(F.col("width"), F.col("height"), F.col("std"), F.col("mean"), F.col("symmetry"), settings.symmetry_threshold)
    return studies.withColumns({"qc_issues": issues, "qc_ok": ok})


def second_reader(studies: DataFrame) -> DataFrame:
    """Findings of the offline second reader, in clause order."""
    rows = studies.select("study_id", F.posexplode(models.offline_reader_b(F.col("impression_text"))).alias("ord", "f"))
    return rows.select("study_id", F.lit("b").alias("reader"), F.col("ord").cast("long").alias("ord"), "f.label", "f.prob", F.lit("vlm").alias("source"), "f.raw_label", F.lit("").alias("image_ref"), "f.mapped")


def live_reader(studies: DataFrame, client: models.Replies, ledger: Ledger | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings, descriptions and notes of a live second reader. Its prompt holds the indication and the history, never what the first reader found."""
    said = models.answered(studies.select("study_id", "indication", "history", "image_path"), client, models.reader_b_prompt(F.col("indication"), F.col("history")), F.col("image_path"), ledger, "reader")
    found = said.select("study_id", F.posexplode(replies.findings(F.col("said.reply"))).alias("ord", "f"))
    found = found.select("study_id", F.lit("b").alias("reader"), F.col("ord").cast("long").alias("ord"), F.coalesce("f.label", "f.raw_label").alias("label"), "f.prob", F.lit("vlm").alias("source"), "f.raw_label", F.lit("").alias("image_ref"), F.col("f.label").isNotNull().alias("mapped"))
    told = said.select("study_id", F.posexplode(replies.descriptions(F.col("said.reply"))).alias("ord", "f"))
    told = told.select("study_id", F.col("ord").cast("long").alias("ord"), text.canonical_relaxed(F.col("f.raw_label"), ascii_only=True).alias("label"), "f.text").where("label is not null")
    note = F.when(F.col("said.error").isNotNull(), F.concat(F.lit("second reader failed: "), F.col("said.error"))).when(replies.items(F.col("said.reply")).isNull(), F.lit("the second reader's reply did not parse"))
    return found, told, said.select("study_id", note.alias("reader_note")).where("reader_note is not null")


def passages(asked: DataFrame, guidelines: DataFrame, k: int = 3) -> DataFrame:
    """label, kind and the texts of the k guidelines (ord, text) nearest to both words, by hashed words."""
    query = asked.withColumn("query_id", F.xxhash64("label", "kind")).withColumn("text", F.concat_ws(" ", "label", "kind"))
    docs = guidelines.select(F.col("ord").alias("doc_id"), "ord", "text")
    best = retrieval.top_k_words(query.select("query_id", "text"), docs, k).join(docs.select("doc_id", "text"), "doc_id")
    best = best.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("passages"))
    return query.select("query_id", "label", "kind").join(best, "query_id").drop("query_id")


def live_arbiter(judged: DataFrame, client: models.Replies, guidelines: DataFrame | None, films: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """judged with the verdict of a live judge for what is funded; a call that fails is uncertain."""
    asked = judged.where("funded")
    none = F.array().cast("array<string>")
    if guidelines is None:
        asked = asked.withColumn("passages", none)
    else:
        found = passages(asked.select("label", "kind").distinct(), guidelines)
        if ledger is not None and ledger.trace is not None:
            found = ledger.trace.watch(found, "retrieve-guidelines", F.concat_ws(" ", "label", "kind"), output_chars=F.length(F.array_join("passages", "")))
        asked = asked.join(found, ["label", "kind"], "left").withColumn("passages", F.coalesce("passages", none))
    asked = asked.join(films.select("study_id", "image_path"), "study_id")
    said = models.answered(asked.select("study_id", "position", "image_path", models.arbiter_prompt(asked).alias("prompt")), client, F.col("prompt"), F.col("image_path"), ledger, "arbiter")
    verdict = F.when(F.col("said.error").isNotNull(), "UNCERTAIN").otherwise(replies.verdict(F.col("said.reply")))
    return judged.join(said.select("study_id", "position", verdict.alias("verdict")), ["study_id", "position"], "left")


def live_draft(out: DataFrame, client: models.Replies, ledger: Ledger | None = None, attempt: int = 1) -> DataFrame:
    """out with the draft of a live writer where it has every section; else the draft stays, with a note. Rows with retried are asked in the second attempt, and fall back to the offline draft."""
    through = out.where(~F.col("blocked") & F.col("qc_ok") & (F.lit(True) if attempt == 1 else F.col("retried")))
    said = models.answered(through.select("study_id", "image_path", models.report_prompt(F.col("findings")).alias("prompt")), client, F.col("prompt"), F.col("image_path"), ledger, "writer", attempt)
    wrote = replies.draft_sentences(F.col("said.reply"))
    said = said.select("study_id", wrote.alias("wrote"), F.col("said.error").alias("error"), F.lit(True).alias("asked"))
    complete = F.col("wrote").isNotNull() & (F.size(F.array_except(F.array(*map(F.lit, vocab.SECTIONS)), F.transform("wrote", lambda s: s["section"]))) == 0)
    why = F.when(F.col("error").isNotNull(), F.concat(F.lit("report writer failed: "), F.col("error"))).otherwise(F.lit("the written report lacked a section"))
    both = out.join(said, "study_id", "left").withColumns({"ok": F.coalesce(complete, F.lit(False)), "asked": F.coalesce("asked", F.lit(False))})
    offline = models.offline_report(F.col("findings")) if attempt > 1 else F.col("draft")
    draft = F.when(F.col("ok"), F.col("wrote")).when(F.col("asked"), offline).otherwise(F.col("draft"))
    return both.withColumns({"notes": F.when(F.col("asked") & ~F.col("ok"), F.array_append("notes", why)).otherwise(F.col("notes")), "draft": draft}).drop("wrote", "error", "ok", "asked")


def evidence_check(drafts: DataFrame, rewrite: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Drafts (draft, known) with a bounded retry: those with a violation (retried) are written once more, what still violates is stripped.

    rewrite: gives the drafts back, with new ones where retried.
    """
    bad = lambda d: F.size(d) != F.size(evidence.checked(d, F.col("known")))
    again = drafts.withColumn("retried", bad(F.col("draft")))
    if rewrite is not None:
        again = rewrite(again)
    ok = evidence.checked(F.col("draft"), F.col("known"))
    return again.withColumn("removed", F.size("draft") - F.size(ok)).withColumn("draft", ok)


def language_guard(drafts: DataFrame) -> DataFrame:
    """Sentences that commit are toned down; the disclaimer is set where it lacks its two facts."""
    quiet = F.transform("draft", lambda s: F.struct(F.when(F.size(text.redlines(s["text"])) > 0, text.neutral(s["text"])).otherwise(s["text"]).alias("text"), s["section"].alias("section"), s["evidence_ids"].alias("evidence_ids")))
    return drafts.withColumn("draft", quiet).withColumn("disclaimer", F.when(text.has_disclaimer(F.col("disclaimer")), F.col("disclaimer")).otherwise(models.DISCLAIMER))


def status(drafts: DataFrame) -> DataFrame:
    """CRITICAL_ESCALATED, HELD or DRAFT_READY; only a ready draft is looked at by the output gate, which may hold it."""
    complete = F.size(F.array_except(F.array(*map(F.lit, vocab.SECTIONS)), F.transform("draft", lambda s: s["section"]))) == 0
    clean = F.forall("draft", lambda s: F.size(text.redlines(s["text"])) == 0)
    gate = complete & clean & text.has_disclaimer(F.col("disclaimer"))
    return drafts.withColumn("status", F.when(F.col("blocked"), "GUARDRAIL_BLOCKED").when(~F.col("qc_ok"), "NEEDS_REPEAT").when(F.size("alerts") > 0, "CRITICAL_ESCALATED").when(F.col("held"), "HELD").when(gate, "DRAFT_READY").otherwise("HELD"))


def run(studies: DataFrame, first: DataFrame, settings: Settings = Settings(), verdicts: Callable[[DataFrame], Column] | None = None, clients: models.Clients = models.Clients(), guidelines: DataFrame | None = None, ledger: Ledger | None = None) -> DataFrame:
    """One row a study: status, alerts, kappa, disagreements, draft, disclaimer, removed, retried, notes, budget_spent.

    clients: live models in place of the offline stand-ins; guidelines (ord, text): what the live judge may look up;
    ledger: where replies are kept. Live settings without clients raise: they never fall back to the stand-ins.
    """
    if settings.use_live_models and None in (clients.reader, clients.arbiter, clients.writer):
        raise ValueError("live models are asked for, but a client is missing")
    seen = controlled(scrubbed(intake(studies)), settings)
    through = seen.where(~F.col("blocked") & F.col("qc_ok"))  # readers only see what passes
    a = first.join(through.select("study_id"), "study_id", "left_semi").select("study_id", F.lit("a").alias("reader"), "ord", "label", "prob", F.lit("cnn").alias("source"), F.col("label").alias("raw_label"), "image_ref", text.canonical(F.col("label"), ascii_only=True).isNotNull().alias("mapped"))
    b, told, noted = second_reader(through), None, None
    if clients.reader is not None:
        b, told, noted = live_reader(through, clients.reader, ledger)
    both = a.unionByName(b)
    alerts = findings.triage(both.withColumn("ord", F.col("ord") + F.when(F.col("reader") == "b", F.lit(1_000_000)).otherwise(0)), settings.critical_threshold)
    alerts = alerts.groupBy("study_id").agg(F.sort_array(F.collect_list(F.struct("label", "prob", "source", "image_ref"))).alias("alerts"))
    describing = settings.reader_b_mode == "describer"
    m = agreement.merge(both.where("mapped") if not describing else both.where("mapped and reader = 'a'"), settings.report_threshold, settings.magnitude_gap)
    k = agreement.kappa(m, settings.report_threshold, F.col("in_vocabulary"))
    if describing:  # the first reader is compared with itself
        k = k.withColumn("kappa", F.lit(1.0))
    else:  # a second reader that named only strange labels agreed on nothing
        k = agreement.measurable_kappa(k, both.where("reader = 'b'"))
    strange = both.where("NOT mapped" if not describing else "false").select("study_id", "label", F.when(F.col("reader") == "a", F.col("prob")).alias("a_prob"), F.when(F.col("reader") == "b", F.col("prob")).alias("b_prob"), F.lit("unique").alias("kind"), F.lit(False).alias("in_vocabulary"), F.lit(1).alias("late"))
    disputes = m.where("kind <> 'agree'" if not describing else "false").select("study_id", "label", "a_prob", "b_prob", "kind", "in_vocabulary", F.lit(0).alias("late")).unionByName(strange).withColumn("ord", F.struct("late", "label"))
    judged = findings.budget(disputes, settings.max_judgments)
    if clients.arbiter is not None:
        judged = live_arbiter(judged, clients.arbiter, guidelines, through, ledger)
    else:
        judged = judged.withColumn("verdict", findings.offline_verdict(F.col("kind"), F.col("a_prob"), F.col("b_prob")) if verdicts is None else verdicts(judged))
    judged = judged.withColumn("verdict", F.when(F.col("funded"), F.col("verdict")).otherwise("UNARBITRATED"))
    settled = judged.where("verdict <> 'REJECT'").select("study_id", "label", F.coalesce(F.greatest("a_prob", "b_prob"), F.lit(0.5)).alias("prob"), F.lit("arbiter").alias("source"), (F.col("verdict") != "CONFIRM").alias("needs_human"))
    agreed = m.where("kind = 'agree'" if not describing else "true").select("study_id", "label", F.coalesce("prob", "a_prob").alias("prob"), F.when(F.coalesce("source", F.lit("a")) == "a", "cnn").otherwise("vlm").alias("source"), F.lit(False).alias("needs_human"))
    final = agreed.unionByName(settled).withColumn("ord", F.col("label"))
    final = findings.dedup_and_cap(final, settings.max_findings, F.col("label")).withColumn("evidence_id", findings.evidence_id(F.col("source"), F.col("label"), F.lit("")))
    final = final.withColumn("notes", F.array().cast("array<string>"))
    if describing:  # what the second reader says about a finding stands beside it
        if told is None:
            told = b.where("mapped").select("study_id", "label", F.col("raw_label").alias("text"), "ord")
        final = agreement.describe(final, told)
    per = final.groupBy("study_id").agg(F.sort_array(F.collect_list(F.struct("rank", "evidence_id", "label", "prob", "source", "needs_human", "notes"))).alias("findings"), F.bool_or("needs_human").alias("held"))
    argued = judged.groupBy("study_id").agg(F.sort_array(F.collect_list(F.struct("position", "label", "kind", "verdict", "in_vocabulary", "a_prob", "b_prob"))).alias("disagreements"), F.count_if("funded").alias("budget_spent"))
    out = seen.join(alerts, "study_id", "left").join(k.select("study_id", "kappa"), "study_id", "left").join(argued, "study_id", "left").join(per, "study_id", "left")
    empty = F.array().cast("array<struct<rank: int, evidence_id: string, label: string, prob: double, source: string, needs_human: boolean, notes: array<string>>>")
    out = out.withColumns({"findings": F.coalesce("findings", empty), "held": F.coalesce("held", F.lit(False)), "budget_spent": F.coalesce("budget_spent", F.lit(0)), "alerts": F.coalesce("alerts", F.array().cast("array<struct<label: string, prob: double, source: string, image_ref: string>>"))})
    out = out.withColumn("known", F.transform("findings", lambda f: f["evidence_id"])).withColumn("draft", models.offline_report(F.col("findings"))).withColumn("disclaimer", F.lit(models.DISCLAIMER))
    if noted is not None:
        out = out.join(noted, "study_id", "left").withColumn("notes", F.when(F.col("reader_note").isNotNull(), F.array_append("notes", F.col("reader_note"))).otherwise(F.col("notes"))).drop("reader_note")
    rewrite = None
    if clients.writer is not None:
        out = live_draft(out, clients.writer, ledger)
        rewrite = lambda rows: live_draft(rows, clients.writer, ledger, attempt=2)
    # the offline writer's second draft is its first, and studies that were stopped have no writer
    checked = evidence_check(out, rewrite).withColumn("retried", F.col("retried") & ~F.col("blocked") & F.col("qc_ok"))
    return status(language_guard(checked))


def timeline(trace: DataFrame) -> DataFrame:
    """latency_ms (null under two events) and whether the alert came before the report, by study."""
    at = lambda node: F.min(F.when(F.col("node") == node, F.col("ts")))
    return trace.groupBy("study_id").agg(F.when(F.count("*") >= 2, (F.max("ts") - F.min("ts")) * 1000).alias("latency_ms"), (at("critical_triage") < at("report_writer")).alias("alert_first"))


def ranked_primary(views: DataFrame) -> DataFrame:
    return findings.ranked_films(views).where("rank = 1")


def study_films(paths: Column, single: Column) -> Column:
    """The study's films, else its one display film."""
    some = F.filter(F.coalesce(paths, F.array().cast("array<string>")), lambda x: x != "")
    return F.when(F.size(some) > 0, some).otherwise(F.array(single))


def scores(states: DataFrame) -> DataFrame:
    """study_id, name, value: numbers of a run for a trace; null ones are left out."""
    wide = states.select("study_id", F.size("alerts").cast("double").alias("alerts"), F.col("budget_spent").cast("double").alias("calls"), F.size(F.filter("findings", lambda f: f["needs_human"])).cast("double").alias("needs_human"), F.coalesce(F.size("disagreements"), F.lit(0)).cast("double").alias("disagreements"), "kappa")
    return wide.unpivot(["study_id"], ["alerts", "calls", "needs_human", "disagreements", "kappa"], "name", "value").where("value is not null")

