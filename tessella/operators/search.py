"""Search over studies, pages of results, point and latest lookups, allowlisted projections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocab import DICOM_ALLOWED, FILE_META_IDENTIFIERS

#: What a stored run carries; raw texts are not among it.
PERSISTED = ("study_id", "image_path", "deid_report", "qc", "findings", "disagreements", "kappa", "arbitration_records", "alerts", "report", "status", "notes", "trace_events", "budget_spent", "tokens_used")


def matches(needle: str, identifier: Column, texts: list[Column], terms: Column | None = None) -> Column:
    """The trimmed needle, any case, in the id, a text or a term; an empty one matches all."""
    n = needle.strip().lower()
    if not n:
        return F.lit(True)
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(n)), F.lit(False))
    out = has(identifier.cast("string"))
    for t in texts:
        out = out | has(t)
    return out if terms is None else out | F.coalesce(F.exists(terms, has), F.lit(False))


def page(found: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first limit rows (all, if 0 or less) and total, how many there are. Both are parts of one plan; nothing runs before it does."""
    top = found.orderBy(*order) if limit <= 0 else found.orderBy(*order).limit(limit)
    return top.join(F.broadcast(found.agg(F.count("*").alias("total"))), F.lit(True)).orderBy(*order)


def point(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The rows with this key; a key that is not there raises LookupError."""
    found = rows.where(F.col(key) == F.lit(value))
    if found.isEmpty():
        raise LookupError(f"no {key} {value!r}")
    return found


def without_prefixed(rows: DataFrame, name: str, prefixes: tuple[str, ...]) -> DataFrame:
    """Rows whose name starts with none of prefixes (spans of routers, for one); null names stay."""
    return rows.where(~F.coalesce(F.col(name).rlike("^(" + "|".join(map(re.escape, prefixes)) + ")"), F.lit(False)))


def meta_identifiers(meta: Column) -> Column:
    """Names of the identifiers of a file's meta group that are not empty, in their fixed order."""
    return F.filter(F.array(*map(F.lit, FILE_META_IDENTIFIERS)), lambda k: F.coalesce(F.try_element_at(meta, k), F.lit("")) != "")


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row by order of each key, through a maximum where possible: one row a key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def study_order(study_id: str = "study_id") -> list[Column]:
    """Numeric ids first, by value, then the others."""
    c = F.col(study_id)
    return [(~c.rlike(r"^\d+$")), F.expr(f"try_cast({study_id} as decimal(38,0))"), c]


def allowed_tags(tags: Column) -> tuple[Column, Column]:
    """Tags that pass, and the names of those that do not."""
    allow = F.array(*map(F.lit, DICOM_ALLOWED))
    return F.map_filter(tags, lambda k, v: F.array_contains(allow, k)), F.sort_array(F.array_except(F.map_keys(tags), allow))


def qc_issues(width: Column, height: Column, std: Column, mean: Column, symmetry: Column, threshold: float = 0.5) -> tuple[Column, Column]:
    """Issues of an image and whether it passes; size and contrast are hard."""
    # 128 pixels, deviation 5, exposure 15 to 235.
    issues = F.array_compact(F.array(F.when((width < 128) | (height < 128), F.lit("low_resolution")), F.when(std < 5.0, F.lit("low_contrast")), F.when(~mean.between(15, 235), F.lit("exposure")), F.when(symmetry < threshold, F.lit("asymmetric"))))
    return issues, ~F.arrays_overlap(issues, F.array(F.lit("low_resolution"), F.lit("low_contrast")))
