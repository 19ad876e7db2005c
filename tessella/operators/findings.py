"""Findings of readers: maxima by label, alerts, duplicates, caps, budgets, thresholds.

Ties never depend on partitioning: every ranking ends in an ordinal, and maxima are maxima of structs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical
from ..functions.vocab import CRITICAL


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def evidence_id(source: Column, label: Column, given: Column) -> Column:
    return F.coalesce(F.nullif(given, F.lit("")), F.concat_ws(":", source, label))


def argmax_by_label(readings: DataFrame, keys: list[str]) -> DataFrame:
    """For each key the highest prob (clamped) and the image_ref it comes from; the first by ord wins ties. One partial aggregate."""
    best = F.max(F.struct(clamp(F.col("prob")).alias("prob"), (-F.col("ord")).alias("first"), "image_ref"))
    return readings.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.prob", "best.image_ref")


def triage(findings: DataFrame, threshold: float = 0.3, labels: tuple[str, ...] = CRITICAL) -> DataFrame:
    """Alerts: of each critical label at or above threshold the highest finding; source is both where two readers saw it."""
    hit = findings.where(F.col("label").isin(*labels) & (F.col("prob") >= threshold))
    best = F.max(F.struct("prob", (-F.col("ord")).alias("first"), "source", "image_ref"))
    of = hit.groupBy("study_id", "label").agg(best.alias("best"), F.count_distinct("source").alias("n"))
    return of.select("study_id", "label", "best.prob", F.when(F.col("n") > 1, "both").otherwise(F.col("best.source")).alias("source"), "best.image_ref")


def dedup_and_cap(findings: DataFrame, most: int = 50, key: Column | None = None) -> DataFrame:
    """The highest finding of each label and study (first on ties), of these the most highest; blank labels are dropped."""
    key = F.coalesce(canonical(F.col("label")), F.lower(F.trim("label"))) if key is None else key
    rows = findings.where(F.trim("label") != "").withColumn("_key", key)
    one = Window.partitionBy("study_id", "_key").orderBy(F.desc("prob"), "ord")
    rows = rows.withColumn("_n", F.row_number().over(one)).where("_n = 1")
    top = Window.partitionBy("study_id").orderBy(F.desc("prob"), "ord")
    return rows.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= most).drop("_n", "_key")


def budget(disagreements: DataFrame, most: int = 12) -> DataFrame:
    """position and funded: those inside the vocabulary first, unique ones last, then as they came."""
    order = Window.partitionBy("study_id").orderBy(~F.col("in_vocabulary"), F.col("kind") == "unique", "ord")
    return disagreements.withColumn("position", F.row_number().over(order)).withColumn("funded", F.col("position") <= most)


def offline_verdict(kind: Column, a_prob: Column, b_prob: Column) -> Column:
    """The deterministic judge."""
    high = F.coalesce(F.greatest(a_prob, b_prob), F.lit(0.0))
    return F.when(kind == "unique", "UNCERTAIN").when(kind == "magnitude", "CONFIRM").when(high >= 0.6, "CONFIRM").otherwise("REJECT")


def with_thresholds(findings: DataFrame, points: DataFrame, default: float = 0.5, critical: tuple[str, ...] = CRITICAL) -> DataFrame:
    """threshold and calibrated: the operating point of the label, else default; critical labels may only be lowered. points has a row a label."""
    known = points.where("threshold is not null").select("label", F.col("threshold").alias("_t"))
    t = F.coalesce("_t", F.lit(default))
    t = F.when(F.col("label").isin(*critical), F.least(t, F.lit(default))).otherwise(t)
    return findings.join(known, "label", "left").withColumns({"threshold": t, "calibrated": F.col("_t").isNotNull()}).drop("_t")


def ranked_films(views: DataFrame) -> DataFrame:
    """rank of each film: frontal first, then symmetry, then name."""
    order = Window.partitionBy("study_id").orderBy(F.col("view") != "frontal", F.desc(F.round("symmetry", 6)), "path")
    return views.withColumn("rank", F.row_number().over(order))


def valid_prob(prob: Column) -> Column:
    """prob, which must lie between 0 and 1; null passes."""
    return F.when(prob.isNull() | prob.between(0, 1), prob).otherwise(F.raise_error(F.concat(F.lit("prob out of range: "), prob.cast("string"))).cast("double"))


def dropped(findings: DataFrame, most: int = 50, key: Column | None = None) -> DataFrame:
    """n_blank, n_capped and dropped by study: what dedup_and_cap leaves out besides repeats of a label. Two aggregates, no ranking."""
    key = F.coalesce(canonical(F.col("label")), F.lower(F.trim("label"))) if key is None else key
    blank = F.coalesce(F.trim("label"), F.lit("")) == ""
    by = findings.groupBy("study_id", F.when(~blank, key).alias("_key")).agg(F.count_if(blank).alias("b"), F.max(~blank).alias("_named"))
    of = by.groupBy("study_id").agg(F.sum("b").alias("n_blank"), F.greatest(F.lit(0), F.count_if("_named") - most).alias("n_capped"))
    return of.withColumn("dropped", F.col("n_blank") + F.col("n_capped"))


def on_film(findings: DataFrame, displayed: DataFrame) -> DataFrame:
    """study_id, loci (of findings on the displayed film, or with no film named) and n_elsewhere. displayed: study_id, image_path."""
    rows = findings.where("locus is not null").join(displayed, "study_id")
    here = (F.coalesce("image_ref", F.lit("")) == "") | (F.col("image_ref") == F.col("image_path"))
    return rows.groupBy("study_id").agg(F.sort_array(F.collect_list(F.when(here, F.struct("label", "prob", "locus")))).alias("loci"), F.count_if(~here).alias("n_elsewhere"))


def evidence_map(findings: DataFrame) -> DataFrame:
    """study_id and a map from evidence id to label, prob and source; of a repeated id the last by ord counts."""
    last = findings.groupBy("study_id", "evidence_id").agg(F.max(F.struct("ord", "label", "prob", "source")).alias("x"))
    return last.groupBy("study_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("evidence_id", F.struct("x.label", "x.prob", "x.source").alias("value"))))).alias("evidence"))
