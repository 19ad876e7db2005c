"""Scores against labels: ROC area, thresholds, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Parts into which the scores of a key are dealt for running sums.
PARTS = 256


def _ranked(counts: DataFrame, keys: list[str], score: str, sums: dict[str, str]) -> DataFrame:
    """counts (a row a key and distinct score) with running sums of columns below each score, in two levels.

    Scores are dealt in order over PARTS intervals of their range; sums run within an interval, and over the intervals
    before it, so no task holds all scores of a key.
    """
    span = counts.groupBy(*keys).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    rows = counts.join(span, keys) if keys else counts.join(F.broadcast(span), F.lit(True))
    share = F.coalesce(F.try_divide((F.col(score) - F.col("_lo")).cast("double"), (F.col("_hi") - F.col("_lo")).cast("double")), F.lit(0.0))
    rows = rows.withColumn("_part", F.least(F.floor(share * PARTS), F.lit(PARTS - 1)).cast("int")).drop("_lo", "_hi")
    parts = rows.groupBy(*keys, "_part").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, F.col("_part").alias("_p"), *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums))
    on = F.col("_part") == F.col("_p")
    for k in keys:
        parts = parts.withColumnRenamed(k, f"_k_{k}")
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    within = Window.partitionBy(*keys, "_part").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_within_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums}).join(parts, on)  # at most PARTS rows a key
    out = rows.withColumns({name: F.col(f"_within_{c}") + F.col(f"_before_{c}") for c, name in sums.items()})
    return out.select(*keys, score, *(c for c in counts.columns if c not in (*keys, score)), *sums.values())


def auc(scores: DataFrame, keys: list[str], score: str = "score", positive: str = "positive") -> DataFrame:
    """Area under the ROC curve by key, ties half: from counts by distinct score, so only those are ranked."""
    by = scores.groupBy(*keys, score).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    by = _ranked(by, keys, score, {"n": "below"})
    return by.groupBy(*keys).agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("n") / F.lit(2.0))), F.sum("p") * F.sum("n")).alias("auc"))


def _at(scores: DataFrame, keys: list[str], score: str, index: Column) -> DataFrame:
    """The score at index (from 0, a column of n) in rising order, by key, from counts of distinct scores."""
    by = _ranked(scores.groupBy(*keys, score).agg(F.count("*").alias("c")), keys, score, {"c": "below"})
    of = by.groupBy(*keys).agg(F.sum("c").alias("n"))
    hit = by.join(of, keys) if keys else by.join(F.broadcast(of), F.lit(True))
    return hit.where(F.col("below") + F.col("c") > index).groupBy(*keys).agg(F.min(score).alias("threshold"))


def threshold_at_specificity(negatives: DataFrame, keys: list[str], target: float, score: str = "score") -> DataFrame:
    n = F.col("n")
    return _at(negatives, keys, score, F.least(n - 1, F.bround(F.lit(target) * n).cast("long")))


def threshold_at_sensitivity(positives: DataFrame, keys: list[str], target: float, score: str = "score") -> DataFrame:
    n = F.col("n")
    return _at(positives, keys, score, F.greatest(F.lit(0), F.bround(F.lit(1 - target) * n).cast("long") - 1))


def rates(scores: DataFrame, thresholds: DataFrame, keys: list[str], score: str = "score", positive: str = "positive") -> DataFrame:
    """specificity, sensitivity and positive_rate_at_half (of negatives), rounded to 4."""
    s, p, t = F.col(score), F.col(positive), F.col("threshold")
    mean = lambda which, hit: F.round(F.avg(F.when(which, hit.cast("double"))), 4)
    return scores.join(thresholds, keys).groupBy(*keys, "threshold").agg(mean(~p, s < t).alias("specificity"), mean(p, s >= t).alias("sensitivity"), mean(~p, s >= 0.5).alias("positive_rate_at_half"), F.count_if(p).alias("n_pos"), F.count_if(~p).alias("n_neg"))


def is_normal(mesh: Column) -> Column:
    return (F.size(mesh) > 0) & F.forall(mesh, lambda x: F.lower(F.trim(x)) == "normal")


def rule_text(n_pos: Column, target: float = 0.9, critical: Column | None = None) -> Column:
    """How a threshold came about, by how many positives there were, and what it is for on critical labels."""
    text = F.when(n_pos == 0, F.lit(f"specificity {target:g} only: no positives")).when(n_pos < 25, F.format_string(f"specificity {target:g}: few positives (n=%d)", n_pos)).otherwise(F.format_string(f"specificity {target:g} (n=%d)", n_pos))
    return text if critical is None else F.concat(text, F.when(critical, "; alert candidate").otherwise(""))


def head_limited(rows: DataFrame, normal: Column, order: list[Column], n_normal: int, n_other: int) -> DataFrame:
    """The first n_normal normal rows and the first n_other others in corpus order; 0 takes all."""
    head = lambda df, n: df if n <= 0 else df.orderBy(*order).limit(n)
    return head(rows.where(normal), n_normal).unionByName(head(rows.where(~F.coalesce(normal, F.lit(False))), n_other))


def keep_as_peer(per_study: DataFrame, floor: float = 0.4, ceiling: float = 0.4, offline: bool = False) -> DataFrame:
    """mean_kappa, disagreeing_share and decision over studies (kappa, n_disagreements). Offline stand-ins measure nothing: it raises."""
    if offline:
        raise ValueError("the offline reader's agreement decides nothing; run with live models")
    of = per_study.agg(F.avg("kappa").alias("mean_kappa"), F.avg((F.col("n_disagreements") > 0).cast("double")).alias("disagreeing_share"))
    return of.withColumn("decision", F.when((F.col("mean_kappa") >= floor) & (F.col("disagreeing_share") <= ceiling), "reader").otherwise("describer"))


def argmax_label(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The label with the highest score of each key, the first by ord on ties."""
    return scores.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("ord")).alias("first"), "label"))["label"].alias("top"))


def mean_delta_excluding(deltas: DataFrame, target: str, keys: list[str] = []) -> DataFrame:
    """Mean change of the scores of all labels but target, by key; null without any."""
    return deltas.groupBy(*keys).agg(F.avg(F.when(F.col("label") != target, F.col("delta"))).alias("mean_delta"))
