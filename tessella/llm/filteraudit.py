"""Operator 12, filter interaction audit: an incidence matrix product over the pass and fail masks of five filters.

Each document gets a mask of the filters that it fails. Whatever their order, what becomes of a document depends on its
mask alone, so the documents of a part (a source) are summed up by three histograms over the 32 masks: all, labelled
good, labelled toxic. Those rows are stacked and multiplied by integer matrices of 32 rows and 600 columns (120 orders
times 5 steps), one for each outcome. A part's result takes 600 rows, however many documents it has.

Filters: A under 50 words; B under 65 % different words; C over 5 % letters A-Z; D holds a symbol of `#$%&*|`;
E equals the text of a smaller doc_id anywhere in the table. E is decided by a minimum for each digest of a text (128
bits of BLAKE2) that combines before the shuffle, and a join on digest and doc_id, so a text with any number of copies
is never gathered.

Defined cases: null text is empty, null source is the part "" (as the empty source is). A null doc_id neither is a copy
nor makes one, and has no labels. Rows repeated with one doc_id are documents each; none of them is a copy of another
row with its doc_id. A document is good (toxic) if any of its rows in labels says 1. Extra columns are ignored, an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, cut, map_arrow, table, texts

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS, COLUMNS = 1 << len(FILTERS), len(ORDERS) * len(FILTERS)
SYMBOLS = b"#$%&*|"
MIN_WORDS = 50
COPY = 1 << FILTERS.index("E")


def own_mask(text: bytes) -> int:
    """The bits of A, B, C and D of a whole text in UTF-8."""
    words = text.split()  # bytes: splits at \x20 and \x09-\x0D only
    points = len(text) if text.isascii() else int((np.frombuffer(text, np.int8) >= -64).sum())
    capitals = len(text) - len(text.translate(None, UPPER.encode()))
    failed = (len(words) < MIN_WORDS, 100 * len(set(words)) < 65 * len(words), 100 * capitals > 5 * points, any(c in text for c in SYMBOLS))
    return sum(1 << k for k, x in enumerate(failed) if x)


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, mask (A to D) of every row of docs (doc_id, text, source)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        whole = texts(b.column(1))
        digests = pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in whole], pa.binary())
        return pa.record_batch([b.column(0).cast(pa.int64()), b.column(2), digests, pa.array(list(map(own_mask, whole)), pa.int32())], names=["doc_id", "part", "digest", "mask"])

    return map_arrow(docs.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("part")), run, "doc_id long, part string, digest binary, mask int")


def outcomes() -> dict[str, np.ndarray]:
    """The matrices, masks by (order, step): 1 where a document of that mask is kept, removed, redundant or unique at that step."""
    mask = np.arange(MASKS)[:, None]
    bit = np.array([1 << FILTERS.index(f) for o in ORDERS for f in o])
    before = np.array([sum(1 << FILTERS.index(f) for f in o[:k]) for o in ORDERS for k in range(len(o))])
    fails, gone = (mask & bit) > 0, (mask & before) > 0
    return {k: m.astype(np.int64) for k, m in (("kept", ~fails & ~gone), ("removed", fails & ~gone), ("redundant", fails & gone), ("unique_fails", mask == bit))}


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def histograms(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic of the rows of masks(): at most 32 rows a part."""
    rows = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    told = labels.groupBy("doc_id").agg(*(F.max((F.col(c) == 1).cast("int")).alias(a) for c, a in (("quality", "is_good"), ("toxic", "is_toxic"))))
    copy = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), F.lit(COPY)).otherwise(F.lit(0))
    whole = rows.join(first, ["digest", "doc_id"], "left").join(told, "doc_id", "left").withColumn("mask", F.col("mask") + copy)
    count = lambda c, a: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(F.lit(0))).alias(a)
    return whole.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("is_good", "good"), count("is_toxic", "toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step: RESULT."""
    bins = histograms(cut(masks(docs), "masks"), labels)
    parts = bins.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("bins"))  # 32 entries at most
    matrix = outcomes()
    steps = np.array([FILTERS.index(f) for o in ORDERS for f in o])
    orders, numbers = [o for o in ORDERS for _ in o], np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                some = b.slice(at, 64)
                whole, good, toxic = stacked = np.zeros((3, some.num_rows, MASKS), np.int64)
                for k, entries in enumerate(some.column(1).to_pylist()):
                    for e in entries:
                        stacked[:, k, e["mask"]] = e["n"], e["good"], e["toxic"]
                removed = whole @ matrix["removed"]
                letter = np.stack([removed[:, steps == k].sum(1) for k in range(len(FILTERS))], 1)
                found = [whole @ matrix["kept"], removed, whole @ matrix["redundant"], whole @ matrix["unique_fails"], good @ matrix["removed"], toxic @ matrix["removed"], letter[:, steps]]
                names = some.column(0).take(pa.array(np.repeat(np.arange(some.num_rows), COLUMNS)))
                columns = [names, pa.array(orders * some.num_rows), pa.array(np.tile(numbers, some.num_rows)), *(pa.array(x.ravel()) for x in found)]
                yield pa.record_batch(columns, names=[x.split()[0] for x in RESULT.split(", ")])

    return parts.mapInArrow(run, RESULT)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Every document is led through every order, step by step.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    {'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
     'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)} AS x
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), m AS (
  SELECT doc_id, part, good, toxic, CASE WHEN x.A THEN 'A' ELSE '' END || CASE WHEN x.B THEN 'B' ELSE '' END || CASE WHEN x.C THEN 'C' ELSE '' END
    || CASE WHEN x.D THEN 'D' ELSE '' END || CASE WHEN x.E THEN 'E' ELSE '' END AS fails FROM f
), a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM a, a AS b, a AS c, a AS d, a AS e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o
), r AS (
  SELECT part, filter_order, step, filter_order[step] AS letter,
    sum(CASE WHEN translate(fails, filter_order[step + 1:], '') = '' THEN 1 ELSE 0 END) AS kept,
    sum(CASE WHEN contains(fails, filter_order[step]) AND translate(fails, filter_order[step:], '') = '' THEN 1 ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, filter_order[step]) AND translate(fails, filter_order[step:], '') <> '' THEN 1 ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = filter_order[step] THEN 1 ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, filter_order[step]) AND translate(fails, filter_order[step:], '') = '' THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, filter_order[step]) AND translate(fails, filter_order[step:], '') = '' THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""
