"""What a page about a study shows, assembled for all studies: image, dual read, report, alerts, audit.

Every block is a row a study that is joined to the states; lists hold what one study has (films, labels, sentences, the
events of a run).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vocab
from ..operators import agreement, findings
from ..sources.corpus import data_uri
from .studies import timeline

DUAL = "array<struct<label: string, a_prob: double, b_prob: double, agreed: boolean, kind: string, verdict: string>>"
LOCI = "array<struct<label: string, prob: double, locus: struct<cx: double, cy: double, r: double>>>"


def dual_read(states: DataFrame, readings: DataFrame) -> DataFrame:
    """study_id, dual: a row for each label that a reader named (readings: the labels of the vocabulary) or that was in dispute, in order.

    A label in dispute shows the probs, kind and verdict of the dispute; of a label disputed twice the last counts.
    """
    fought = states.select("study_id", F.inline("disagreements")).groupBy("study_id", "label").agg(F.max(F.struct("position", "kind", "verdict", F.col("a_prob").alias("a"), F.col("b_prob").alias("b"))).alias("d"))
    named = agreement.matched(readings).select("study_id", "label", "a_prob", "b_prob")
    rows = named.join(fought, ["study_id", "label"], "full_outer")
    lost = F.col("d").isNotNull()
    shown = F.struct("label", F.when(lost, F.col("d.a")).otherwise(F.col("a_prob")).alias("a_prob"), F.when(lost, F.col("d.b")).otherwise(F.col("b_prob")).alias("b_prob"), (~lost).alias("agreed"), F.col("d.kind").alias("kind"), F.col("d.verdict").alias("verdict"))
    return rows.groupBy("study_id").agg(F.sort_array(F.collect_list(shown)).alias("dual"))


def image(states: DataFrame, readings: DataFrame, films: DataFrame | None = None) -> DataFrame:
    """study_id, image: the displayed film with the first reader's loci on it, how many lie on other films, and its pixels if films (path, content) has it."""
    shown = states.select("study_id", "image_path")
    loci = findings.on_film(readings.where("reader = 'a'"), shown)
    out = shown.join(loci, "study_id", "left")
    url: Column = F.lit(None).cast("string")
    if films is not None:
        kinds = F.create_map(*(F.lit(x) for pair in vocab.FILM_TYPES.items() for x in pair))
        mime = F.coalesce(F.try_element_at(kinds, F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))), F.lit("image/png"))
        out = out.join(films.select(F.col("path").alias("image_path"), data_uri(mime, F.col("content")).alias("url")), "image_path", "left")
        url = F.col("url")
    views = F.array("image_path") if "image_paths" not in states.columns else F.col("image_paths")
    out = out if "image_paths" not in states.columns else out.join(states.select("study_id", "image_paths"), "study_id")
    return out.select("study_id", F.struct(F.col("image_path").alias("path"), url.alias("data_url"), views.alias("views"), F.coalesce("n_elsewhere", F.lit(0)).alias("loci_on_other_views"), F.coalesce("loci", F.array().cast(LOCI)).alias("loci")).alias("image"))


def dashboard(states: DataFrame, trace: DataFrame, readings: DataFrame, films: DataFrame | None = None) -> DataFrame:
    """study_id and dashboard: status, blocked (whatever is not a ready draft), image, dual_read, report, critical, audit.

    states: of studies.run(); trace: study_id, node, ts; readings: raw findings of both readers (study_id, reader, label,
    prob, ord, image_ref, locus, and mapped if it was told already which labels are of the vocabulary); films: path, content.
    """
    canonical = text.canonical(F.col("label"), ascii_only=True).isNotNull()
    known = readings.where(F.coalesce("mapped", canonical) if "mapped" in readings.columns else canonical)
    events = trace.groupBy("study_id").agg(F.sort_array(F.collect_list(F.struct("ts", "node"))).alias("timeline"))
    rows = states.join(dual_read(states, known), "study_id", "left").join(image(states, readings, films), "study_id", "left").join(events, "study_id", "left").join(timeline(trace), "study_id", "left")
    evidence = F.map_from_entries(F.transform(F.array_distinct(F.transform("findings", lambda f: f["evidence_id"])), lambda i: F.struct(i.alias("key"), F.element_at(F.filter("findings", lambda f: f["evidence_id"] == i), F.lit(-1)).alias("value"))))
    have = lambda c, other: F.col(c) if c in states.columns else other
    none = lambda kind: F.lit(None).cast(kind)
    audit = F.struct(
        F.struct(have("indication_fired", none("array<string>")).alias("indication"), have("history_fired", none("array<string>")).alias("history")).alias("deid"),
        F.struct(have("qc_ok", none("boolean")).alias("ok"), have("qc_issues", none("array<string>")).alias("issues")).alias("qc"),
        "latency_ms", "budget_spent", F.col("timeline").alias("trace"), have("notes", none("array<string>")).alias("notes"),
    )
    return rows.select("study_id", F.struct(
        "status", (F.col("status") != "DRAFT_READY").alias("blocked"), "image",
        F.struct("kappa", F.coalesce("dual", F.array().cast(DUAL)).alias("rows")).alias("dual_read"),
        F.struct(F.col("draft").alias("sentences"), evidence.alias("evidence_map"), "disclaimer", F.col("removed").alias("removed_count")).alias("report"),
        F.struct("alerts", "timeline", "alert_first").alias("critical"), audit.alias("audit"),
    ).alias("dashboard"))
