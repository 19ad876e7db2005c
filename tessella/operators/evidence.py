"""Citations of report sentences against known evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import CLAIM_SECTIONS, SECTIONS


def is_claim(section: Column) -> Column:
    return section.isin(*CLAIM_SECTIONS)


def violations(cited: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Sentences (keys) with a reason: no_evidence (no citation at all), dangling (cites what is not known) and their dangling ids.

    cited: a row for each citation, evidence_id null for a sentence without any. known: evidence_id, distinct.
    """
    hit = cited.join(known.select("evidence_id", F.lit(True).alias("_known")), "evidence_id", "left")
    lost = F.col("evidence_id").isNotNull() & F.col("_known").isNull()
    of = hit.groupBy(*keys).agg(F.count("evidence_id").alias("n_cited"), F.sort_array(F.collect_set(F.when(lost, F.col("evidence_id")))).alias("dangling"))
    reason = F.when(F.col("n_cited") == 0, "no_evidence").when(F.size("dangling") > 0, "dangling")
    return of.withColumn("reason", reason).where("reason is not null").select(*keys, "reason", "dangling")


def coverage(cited: DataFrame, known: DataFrame, study: str, keys: list[str]) -> DataFrame:
    """Of each study: claims, supported ones (at least one known citation) and their share; 1 without claims."""
    hit = cited.join(known.select("evidence_id", F.lit(1).alias("_known")), "evidence_id", "left")
    one = hit.groupBy(study, *keys).agg(F.max(F.coalesce("_known", F.lit(0))).alias("ok"))
    return one.groupBy(study).agg(F.count("*").alias("claims"), F.sum("ok").cast("long").alias("supported")).withColumn("coverage", F.coalesce(F.try_divide("supported", "claims"), F.lit(1.0)))


def known_only(ids: Column, known: Column) -> Column:
    """Citations that are known, first mention of each, in order."""
    return F.filter(F.array_distinct(ids), lambda x: F.array_contains(known, x))


def known_citations(cited: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """keys and their distinct known citations, in order of the ids: known_only where the known ids are a table."""
    hit = cited.join(known.select("evidence_id"), "evidence_id", "left_semi")
    return hit.groupBy(*keys).agg(F.sort_array(F.collect_set("evidence_id")).alias("cited"))


def missing_sections(sentences: DataFrame, required: tuple[str, ...] = SECTIONS, key: str = "study_id", section: str = "section") -> DataFrame:
    of = sentences.groupBy(key).agg(F.collect_set(section).alias("_have"))
    return of.select(key, F.sort_array(F.array_except(F.array(*map(F.lit, required)), "_have")).alias("missing"))


def checked(draft: Column, known: Column) -> Column:
    """Sentences of a draft (array of structs with section and evidence_ids) that are no violation."""
    return F.filter(draft, lambda s: ~is_claim(s["section"]) | ((F.size(s["evidence_ids"]) > 0) & (F.size(F.array_except(s["evidence_ids"], known)) == 0)))
