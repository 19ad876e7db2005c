"""Operator 6, SimHash near-duplicates by a segment-popcount embedding and a grid range join.

A fingerprint of 64 bits is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of two
embeddings never exceeds the Hamming distance of their fingerprints, so links lie within Manhattan distance REACH. The
segments are dealt into g groups: at most REACH groups can differ, so two linked fingerprints agree in all coordinates
of some g - REACH groups. Each such choice of groups is a grid whose cells hold equal coordinates. Within a cell a range
join on the total bit count comes first, then the Manhattan distance of the embeddings (counts are kept in unary, so it
is the number of bits in which two differ), and what passes both lower bounds is verified by the Hamming distance. g
grows with the number of distinct fingerprints, which keeps cells small; every g is exact.

Copies share a fingerprint and meet once, as one row. A cell gives a spanning forest of its links, not all pairs. Cells
of over HOT rows are split into blocks, and each pair of blocks is a task's group of its own. Components come from
star steps over the forests.

without_near_duplicates() is the form for filtering: shingles of five words, and a link is a Jaccard similarity of 0.8
or more. Fingerprints of such texts may differ in more bits than a grid can reach, so those that the grid links are
checked by their shingles first, and jaccard completes the links exactly.

Defined cases: null or wordless text has fingerprint zero and links like any other. A null doc_id is never a
component's smallest id (null only if a component has no other). Repeated rows are copies. Ties do not arise: the
smallest id is unique. Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard
from .common import cut, free_name, map_arrow, row_key, table, texts, trim
from .components import components
from .jaccard import SEED, fingerprint_of, hashes

SHINGLE, REACH = 4, 4
#: Ways over which a component's smallest id is sent to its fingerprints, so a large one is no single task.
SALTS = 16
#: Rows of a cell beyond which it is split, and rows compared at once.
HOT, BLOCK = 20_000, 1_024
#: Distinct fingerprints up to which so many groups of segments serve.
GROUPS = ((2_000_000, 5), (50_000_000, 6), (1_000_000_000, 7), (1 << 62, 8))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a whole text in UTF-8, unsigned."""
    return fingerprint_of(hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *more: str) -> DataFrame:
    """doc_id, the long columns named by more, and fp (the 64 bits as a long) of every row."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(x, shingle) for x in texts(b.column(0))], np.uint64).view(np.int64)
        return pa.record_batch([*b.columns[1:], pa.array(fp)], names=[*b.schema.names[1:], "fp"])

    return map_arrow(docs.select("text", F.col("doc_id").cast("long"), *more), run, ", ".join(f"{c} long" for c in ("doc_id", *more, "fp")))


def masks(groups: int, reach: int = REACH) -> list[int]:
    """For each choice of groups - reach groups, the bits of their segments. Segment k is in group k mod groups."""
    own = [sum(3 << 2 * k for k in range(g, 32, groups)) for g in range(groups)]
    out = [sum(own[g] for g in some) for some in combinations(range(groups), groups - reach)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def embedded(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 segments, each in unary in its two bits (00, 01, 11)."""
    fp, low = fp.view(np.uint64), np.uint64(0x5555555555555555)
    other = fp >> np.uint64(1)
    return ((fp | other) & low) | ((fp & other & low) << np.uint64(1))


def manhattan(e: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Manhattan distance of embeddings: unary counts differ in as many bits as their difference."""
    return np.bitwise_count(e ^ f)


def linked(fp: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within fp (distinct): fingerprints, and the root of each that has another root."""
    bits = np.bitwise_count(fp.view(np.uint64)).astype(np.int16)
    order = np.lexsort((fp, bits))
    fp, bits, e = fp[order], bits[order], embedded(fp[order])
    label = np.arange(len(fp))
    for a in range(0, len(fp), BLOCK):
        b = min(a + BLOCK, len(fp))
        end = int(np.searchsorted(bits, bits[b - 1] + reach, "right"))  # counts further off can't be linked
        for c in range(a, end, 8 * BLOCK):
            d = min(c + 8 * BLOCK, end)
            i, j = np.nonzero(manhattan(e[a:b, None], e[None, c:d]) <= reach)
            i, j = i + a, j + c
            near = (i < j) & (np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= reach)
            i, j = i[near], j[near]
            while len(i):
                p, q = label[i], label[j]
                open_ = p != q
                i, j, p, q = i[open_], j[open_], p[open_], q[open_]
                np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
                while (up := label[label]).tobytes() != label.tobytes():
                    label = up
    other = label != np.arange(len(fp))
    return fp[other], fp[label[other]]


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[np.ndarray]:
    """The values (last column) of each run of equal keys (the first columns) in a sorted partition, runs of one row left out."""
    rest: np.ndarray | None = None
    for b in batches:
        now = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1)
        now = now if rest is None else np.concatenate([rest, now])
        if not len(now):
            continue
        at = np.flatnonzero((now[1:, :keys] != now[:-1, :keys]).any(1)) + 1
        start = np.concatenate([[0], at])
        for i, j in zip(start[:-1], start[1:]):
            if j - i > 1:
                yield now[i:j, keys]
        rest = now[start[-1] :].copy()
    if rest is not None and len(rest) > 1:
        yield rest[:, keys]


def links(fps: DataFrame, groups: int | None = None, hot: int = HOT) -> DataFrame:
    """Spanning forests (u, v) of the links between the distinct fingerprints fps.fp."""
    n = fps.count()
    chosen = masks(groups or next(g for most, g in GROUPS if n <= most))
    # bit counts of all two-bit segments at once, in unary
    other, low = F.shiftrightunsigned("fp", 1), F.lit(0x5555555555555555)
    counts = F.col("fp").bitwiseOR(other).bitwiseAND(low).bitwiseOR(F.shiftleft(F.col("fp").bitwiseAND(other).bitwiseAND(low), 1))
    cells = fps.select("fp", counts.alias("e")).select("fp", F.posexplode(F.array(*(F.col("e").bitwiseAND(F.lit(m)) for m in chosen))).alias("t", "cell"))
    crowded = cells.groupBy("t", "cell").count().where(F.col("count") > hot).select("t", "cell", F.ceil(F.col("count") / hot).cast("long").alias("parts"))
    dealt = cells.join(crowded, ["t", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)).cast("long"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select(F.col("t").cast("long").alias("t"), "cell", F.least("own", "with").alias("a"), F.greatest("own", "with").alias("b"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp in groups_of(batches, 4):
            u, v = linked(fp)
            if len(u):
                yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])
        trim()

    spread = dealt.repartition("t", "cell", "a", "b").sortWithinPartitions("t", "cell", "a", "b")
    return spread.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable through links of fingerprints): one row a document."""
    of_docs = cut(fingerprints(docs, shingle), "fingerprints")
    least = cut(of_docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = cut(components(links(least.select("fp"))).withColumnRenamed("node", "fp"), "roots")
    smallest = roots.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    # every linked fingerprint asks for its root's smallest id: roots are salted, so a large component is many tasks' work
    salts = F.explode(F.array(*(F.lit(k).cast("long") for k in range(SALTS)))).alias("salt")
    asked = roots.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    named = asked.join(smallest.select("root", "component_id", salts), ["root", "salt"]).select("fp", "component_id", F.lit(True).alias("linked"))
    every = cut(least.join(named, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id")), "named")
    return of_docs.join(every, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, keys: Callable[[DataFrame], DataFrame], roots: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of docs, all columns, without all but one of each class: that with the smallest doc_id (null last).

    keys: from doc_id, text and row to doc_id, row and fp of every row; roots: fp and root of those that have another root than themselves.
    """
    row = row_key(docs)
    of_docs = cut(keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row.alias("row"))), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")
    first = of_docs.groupBy("fp").agg(F.min(order).alias("first")).join(roots(of_docs), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    own, kept_id, kept_row = free_name(docs, "own_row", "kept_id", "kept_row")
    kept = cut(first.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias(kept_id), F.col("first.row").alias(kept_row)), "kept")
    out = docs.withColumn(own, row).join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_row)), "left_semi")
    if not of_docs.groupBy("doc_id", "row").count().where("count > 1").isEmpty():  # rows that repeat in all columns
        out = out.dropDuplicates(["doc_id", own])
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def without_near_duplicates(docs: DataFrame, hot: int = jaccard.HOT_ROWS) -> DataFrame:
    """The rows of docs, all columns, without all but one of each group of near-duplicates (five words, Jaccard similarity of 0.8 or more): that with the smallest doc_id (null last).

    Links of the fingerprints come first, exact links of the shingles complete them. Groups are those of the exact links.
    """
    key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")
    keyed = docs.select(key, "text")
    return one_of_each(docs, lambda rows: rows.select("doc_id", "row", key.alias("fp")), lambda _: jaccard.classes(keyed, links, hot))


def op6_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
