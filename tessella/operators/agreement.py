"""Agreement of two readers. Both readers' rows of a label meet in one aggregate, which is the full outer join on the label with one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import COMPARISON


def matched(findings: DataFrame) -> DataFrame:
    """study_id, label, a_prob, b_prob (null where a reader did not name it), a, b: of repeated labels a reader's last one counts.

    a and b hold its prob and image_ref, and its locus where findings have one.
    """
    last = lambda r: F.max(F.when(F.col("reader") == r, F.struct("ord", "prob", *(c for c in ("image_ref", "locus") if c in findings.columns))))
    both = findings.groupBy("study_id", "label").agg(last("a").alias("a"), last("b").alias("b"))
    return both.select("study_id", "label", F.col("a.prob").alias("a_prob"), F.col("b.prob").alias("b_prob"), "a", "b")


def kind(a: Column, b: Column, threshold: Column, gap: float = 0.3, mapped: Column | None = None) -> Column:
    """unique, presence, magnitude or agree. Labels that map to nothing are always unique."""
    only = F.when(F.coalesce(a, b) >= threshold, "unique").otherwise("agree")
    both = F.when((a >= threshold) != (b >= threshold), "presence").when((a >= threshold) & (F.abs(a - b) >= gap), "magnitude").otherwise("agree")
    out = F.when(a.isNull() | b.isNull(), only).otherwise(both)
    return out if mapped is None else F.when(~mapped, "unique").otherwise(out)


def merge(findings: DataFrame, threshold: float = 0.5, gap: float = 0.3, vocabulary: tuple[str, ...] = COMPARISON) -> DataFrame:
    """matched with kind, in_vocabulary and, where the readers agree, the merged prob and its source, film and locus (the first reader wins ties)."""
    m = matched(findings)
    m = m.withColumns({"kind": kind(F.col("a_prob"), F.col("b_prob"), F.lit(threshold), gap), "in_vocabulary": F.col("label").isin(*vocabulary)})
    a_wins = F.col("b_prob").isNull() | (F.col("a_prob") >= F.col("b_prob"))
    agreed = F.col("kind") == "agree"
    winner = F.when(agreed, F.when(a_wins, F.col("a")).otherwise(F.col("b")))
    carried = {c: winner[c] for c in ("prob", "image_ref", "locus") if c == "prob" or c in findings.columns}
    return m.withColumns({**carried, "source": F.when(agreed, F.when(a_wins, "a").otherwise("b"))})


def kappa_of(n: Column, pos_a: Column, pos_b: Column, same: Column) -> Column:
    """Cohen's kappa of n labels; 1 where chance explains all agreement (or n is 0)."""
    pa, pb = F.try_divide(pos_a, n), F.try_divide(pos_b, n)
    pe = pa * pb + (1 - pa) * (1 - pb)
    return F.when((n == 0) | (pe >= 1 - 1e-9), F.lit(1.0)).otherwise((F.try_divide(same, n) - pe) / (1 - pe))


def kappa(match: DataFrame, threshold: float = 0.5, universe: Column | None = None, name: str = "kappa") -> DataFrame:
    """study_id, n_labels, kappa and degenerate over the labels of universe."""
    use = F.lit(True) if universe is None else universe
    pa, pb = F.coalesce(F.col("a_prob") >= threshold, F.lit(False)), F.coalesce(F.col("b_prob") >= threshold, F.lit(False))
    n = match.groupBy("study_id").agg(F.count_if(use).alias("n"), F.count_if(use & pa).alias("na"), F.count_if(use & pb).alias("nb"), F.count_if(use & (pa == pb)).alias("same"))
    na, nb = F.try_divide("na", "n"), F.try_divide("nb", "n")
    pe = na * nb + (1 - na) * (1 - nb)
    return n.select("study_id", F.col("n").alias("n_labels"), kappa_of(F.col("n"), F.col("na"), F.col("nb"), F.col("same")).alias(name), F.coalesce(pe >= 1 - 1e-9, F.lit(True)).alias("degenerate"))


def agreement(match: DataFrame, threshold: float = 0.5, vocabulary: tuple[str, ...] = COMPARISON) -> DataFrame:
    """Narrow (vocabulary) and wide kappa of each study, side by side, in one aggregate."""
    narrow = F.col("label").isin(*vocabulary)
    pa, pb = F.coalesce(F.col("a_prob") >= threshold, F.lit(False)), F.coalesce(F.col("b_prob") >= threshold, F.lit(False))
    counts = lambda w, x: [F.count_if(w).alias(f"n{x}"), F.count_if(w & pa).alias(f"a{x}"), F.count_if(w & pb).alias(f"b{x}"), F.count_if(w & (pa == pb)).alias(f"s{x}")]
    n = match.groupBy("study_id").agg(*counts(narrow, "n"), *counts(F.lit(True), "w"))
    k = lambda x: kappa_of(F.col(f"n{x}"), F.col(f"a{x}"), F.col(f"b{x}"), F.col(f"s{x}"))
    return n.select("study_id", k("n").alias("narrow"), k("w").alias("wide"), F.col("nn").alias("n_narrow"), F.col("nw").alias("n_wide"))


def describe(findings: DataFrame, descriptions: DataFrame) -> DataFrame:
    """findings with the texts of their label's descriptions appended to notes, in order; unmatched descriptions add no finding."""
    texts = descriptions.groupBy("study_id", "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("_texts"))
    return findings.join(texts, ["study_id", "label"], "left").withColumn("notes", F.concat(F.coalesce("notes", F.array().cast("array<string>")), F.coalesce("_texts", F.array().cast("array<string>")))).drop("_texts")


def dual_view(match: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Both readers' probs, the kind of disagreement and its verdict, a row a label."""
    return match.join(verdicts.select("study_id", "label", "verdict"), ["study_id", "label"], "left")


def measurable_kappa(kappas: DataFrame, second: DataFrame) -> DataFrame:
    """kappas (study_id, kappa, ...) with 0 where the second reader named only labels outside the vocabulary: no agreement could be measured.

    second: study_id and mapped, a row for each of its findings.
    """
    of = second.groupBy("study_id").agg((F.count_if("mapped") == 0).alias("_strange"))
    return kappas.join(of, "study_id", "left").withColumn("kappa", F.when(F.coalesce("_strange", F.lit(False)), F.lit(0.0)).otherwise(F.col("kappa"))).drop("_strange")


def both_named(match: DataFrame) -> DataFrame:
    """study_id and the labels that both readers named, in order."""
    both = F.when(F.col("a_prob").isNotNull() & F.col("b_prob").isNotNull(), F.col("label"))
    return match.groupBy("study_id").agg(F.sort_array(F.collect_set(both)).alias("labels"))
