"""Operator 4, exact top-k by inner product: dual-tree search over cover trees of queries and data.

A node has a centre (one of its points), a covering radius, and the largest norm below it; children have centres chosen
far apart (farthest-first), so siblings are separated by at least the radius at which they were made, as in a cover
tree. For a query node (centre q, radius r) and a data node (centre p, radius s) no inner product below them exceeds
<q,p> + r*|p| + s*|q| + r*s. A pair of nodes whose bound lies below the worst k-th score of the query group is pruned;
pairs are visited best bound first, so that the k-th scores rise early; leaves meet as blocks of one matrix product.

The upper levels are shared by all tasks: a tree over a bounded sample (SAMPLE vectors) gives cells, and every vector
goes to the cell with the nearest centre. A first pass finds each query's k-th score within the sample, which its real
one cannot fall below. Pairs of a query cell and a data cell whose bound lies below that for all queries of the cell are
dropped before anything is copied. Queries of neighbouring cells make blocks of about QUERY_BLOCK, and a query block
meets the data cells that are left to it, each in a task's group of its own (cells beyond DATA_BLOCK rows in parts); that
keeps its k best, and a ranking by query joins them.

Defined cases: vectors that are null, hold null or a non-finite component, or have a null id take no part. Only vectors
of the same length are compared; lengths that the sample misses are one cell, which is never pruned. Rows with a query's
own id are never its candidates. A row that repeats another (same id, same vector) counts once; several vectors of one
id are candidates of their own, and as queries are refused by taking the first in the order of their components. Ties go
to the smaller id. Extra columns are ignored. Fewer rows than k give all; empty tables give an empty result. Components
are rounded to integers by the caller, so sums are exact.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

K = 20
LEAF, FANOUT = 256, 8
QUERY_BLOCK, DATA_BLOCK = 4_096, 16_384
#: Vectors of the sample, rows of a cell, about, and cells at most.
SAMPLE, CELL, CELLS = 4_096, 8_192, 1_024
#: Tasks at most in which pairs of blocks meet.
MOST_PARTS = 20_000
#: Of bounds, for rounding: never prunes a tie.
SLACK = 1e-6


class Node:
    __slots__ = ("centre", "radius", "norm", "rows", "children")

    def __init__(self, x: np.ndarray, rows: np.ndarray, centre: int, far: np.ndarray):
        self.rows, self.centre = rows, x[centre]
        self.radius, self.norm = float(far.max()), float(np.linalg.norm(x[centre]))
        self.children: list[Node] = []


def build(x: np.ndarray, leaf: int = LEAF) -> Node:
    """A tree over the rows of x; every leaf has at most leaf rows or only equal ones."""

    def node(rows: np.ndarray, centre: int, far: np.ndarray) -> Node:
        n = Node(x, rows, centre, far)
        if len(rows) <= leaf or n.radius == 0:
            return n
        own = x[rows]
        centres, near, belongs = [centre], far.copy(), np.zeros(len(rows), np.int64)
        while len(centres) < FANOUT:  # farthest first: centres are at least as far apart as any row from its centre
            k = int(near.argmax())
            if near[k] == 0:
                break
            d = np.sqrt(np.square(own - own[k]).sum(1))
            closer = d < near
            belongs[closer], near = len(centres), np.minimum(near, d)
            centres.append(int(rows[k]))
        for c, i in enumerate(centres):
            if (mine := belongs == c).any():
                n.children.append(node(rows[mine], i, near[mine]))
        return n

    return node(np.arange(len(x)), 0, np.sqrt(np.square(x - x[0]).sum(1)))


def leaves(n: Node) -> list[Node]:
    return [n] if not n.children else [y for c in n.children for y in leaves(c)]


def search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int = K, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each query row its k best rows of x: scores and ids (padded with -inf and -1), and how many leaf products were made."""
    scores, found = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
    made = 0
    if not len(q) or not len(x):
        return scores, found, q_ids, made
    root = build(x, leaf)
    for group in leaves(build(q, leaf)):
        rows = group.rows
        best_s, best_i = scores[rows], found[rows]
        worst = -np.inf
        bound = lambda n: float(group.centre @ n.centre) + group.radius * n.norm + n.radius * group.norm + group.radius * n.radius
        heap, count = [(-bound(root), 0, root)], 1
        while heap:
            top, _, n = heapq.heappop(heap)
            if -top * (1 + SLACK) + SLACK < worst:
                break  # no pair left can reach a k-th score of this group
            if n.children:
                for c in n.children:
                    b = bound(c)
                    if b * (1 + SLACK) + SLACK >= worst:
                        heapq.heappush(heap, (-b, count, c))
                        count += 1
                continue
            made += 1
            s = q[rows] @ x[n.rows].T
            i = np.broadcast_to(ids[n.rows], s.shape)
            s = np.where(i == q_ids[rows, None], -np.inf, s)
            s, i = np.concatenate([best_s, s], 1), np.concatenate([best_i, i], 1)
            order = np.lexsort((i, -s), axis=1)[:, :k]
            best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            worst = float(best_s[:, -1].min())
        scores[rows], found[rows] = best_s, best_i
    return scores, found, q_ids, made


class Cells:
    """Centres of the cells of each vector length, in the order of the tree's leaves, and the sample itself; bounded by SAMPLE."""

    def __init__(self, sample: pd.DataFrame, cells: int):
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for dim, own in sample.groupby("dim"):
            x, ids = np.array(own["v"].tolist(), float).reshape(len(own), -1), own["vec_id"].to_numpy()
            parts = leaves(build(x, max(1, math.ceil(len(x) / max(1, cells)))))[:CELLS] if cells > 1 else []
            self.of[int(dim)] = (np.array([n.centre for n in parts]), x, ids)

    def centres(self) -> list[tuple]:
        return [(dim, k, c.tolist()) for dim, (centres, _, _) in self.of.items() for k, c in enumerate(centres)]

    def place(self, dim: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell (-1: the one without a centre) and distance to its centre of each row."""
        centres = self.of[dim][0] if dim in self.of else []
        if not len(centres):
            return np.full(len(x), -1), np.zeros(len(x))
        near = np.square(x).sum(1)[:, None] + np.square(centres).sum(1)[None] - 2 * x @ centres.T
        cell = near.argmin(1)
        return cell, np.sqrt(np.square(x - centres[cell]).sum(1))

    def floor(self, dim: int, x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """What each query's k-th score cannot fall below: its k-th in the sample, one vector an id."""
        if dim not in self.of:
            return np.full(len(x), -np.inf)
        _, sample, own = self.of[dim]
        _, first = np.unique(own, return_index=True)
        scores = np.where(own[first][None] == ids[:, None], -np.inf, x @ sample[first].T)
        return np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(x), -np.inf)


def dealt(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Data (vec_id, v, dim, cell, part), queries (vec_id, v, dim, block) and the pairs of blocks and cells that may hold a best one (dim, block, cell, part)."""
    spark = rows.sparkSession
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).select("vec_id", "v", "dim").toPandas()
    cells = Cells(sample, min(CELLS, math.ceil(n / CELL)))

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, own in b.groupby("dim"):
                x, ids, asks = np.array(own["v"].tolist(), float).reshape(len(own), -1), own["vec_id"].to_numpy(), own["query"].to_numpy()
                cell, far = cells.place(int(dim), x)
                floor = np.full(len(own), np.nan)
                floor[asks] = cells.floor(int(dim), x[asks], ids[asks], k)
                yield own.assign(cell=cell.astype("int32"), far=far, norm=np.sqrt(np.square(x).sum(1)), floor=floor)

    kind = "vec_id long, v array<double>, dim int, query boolean, cell int, far double, norm double, floor double"
    at = cut(rows.select("vec_id", "v", "dim", "query").mapInPandas(locate, kind), "located")
    by = ["dim", "cell"]
    # a row a cell: CELLS at most for each length
    size = at.groupBy(*by).agg(F.ceil(F.count("*") / DATA_BLOCK).cast("int").alias("parts"), F.max("far").alias("s"), F.max("norm").alias("norm"), F.count_if("query").alias("asks"), F.max(F.when(F.col("query"), F.col("far"))).alias("r"), F.min(F.when(F.col("query"), F.col("floor"))).alias("floor"))
    # neighbouring cells make a block of queries; a cell with more is blocks of its own
    order = Window.partitionBy("dim").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("asks").over(order), F.lit(0))
    size = size.withColumns({"block": F.floor(ahead / QUERY_BLOCK).cast("int"), "pieces": F.greatest(F.lit(1), F.ceil(F.col("asks") / QUERY_BLOCK)).cast("int")})
    centres = spark.createDataFrame(cells.centres(), "dim int, cell int, centre array<double>")
    size = cut(size.join(F.broadcast(centres), by, "left"), "cells")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)
    q = size.where("asks > 0").select("dim", "block", "pieces", F.col("centre").alias("a"), "r", "floor")
    d = size.select(F.col("dim").alias("d"), "cell", "parts", F.col("centre").alias("b"), "s", "norm")
    bound = dot(F.col("a"), F.col("b")) + F.sqrt(dot(F.col("a"), F.col("a"))) * F.col("s") + F.col("r") * F.col("norm")
    may = F.coalesce(bound + SLACK * (1 + F.abs(bound)) >= F.col("floor"), F.lit(True))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    pairs = q.join(d, (F.col("dim") == F.col("d")) & may).select("dim", "block", "pieces", "cell", "parts").distinct()
    pairs = pairs.withColumn("part", each("parts")).select("dim", "block", "pieces", "cell", "part").withColumn("piece", each("pieces")).select("dim", "block", "piece", "cell", "part").distinct()
    data = at.join(F.broadcast(size.select(*by, "parts")), by).select("vec_id", "v", "dim", "cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"))
    first = at.where("query").groupBy("vec_id", "dim").agg(F.min(F.struct("v", "cell")).alias("x")).select("vec_id", "dim", "x.v", "x.cell")
    asked = first.join(F.broadcast(size.select(*by, "block", "pieces")), by).select("vec_id", "v", "dim", "block", F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int").alias("piece"))
    return data, asked, cut(pairs, "pairs")


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score (double) of vectors (vec_id, v: array<double>); is_query says which rows are queries."""
    sound = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != math.inf), F.lit(False)))
    rows = cut(vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.size("v").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("query")).dropDuplicates(["vec_id", "v"]), "vectors")
    data, asked, pairs = dealt(rows, k)
    by = ["dim", "block", "piece", "cell", "part"]
    named = [F.col(c).alias(c) for c in (*by, "vec_id", "v")]  # columns of their own on either side
    left = asked.join(pairs, ["dim", "block", "piece"]).select(*named)
    right = data.join(pairs, ["dim", "cell", "part"]).select(*named)

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        if a.empty or b.empty:
            return out
        x = [np.array(c["v"].tolist(), float).reshape(len(c), -1) for c in (a, b)]
        s, i, ids, _ = search(x[0], a["vec_id"].to_numpy(), x[1], b["vec_id"].to_numpy(), k)
        hit = np.isfinite(s)
        return pd.DataFrame({"query_id": np.repeat(ids, hit.sum(1)), "vec_id": i[hit], "score": s[hit]})

    # a stated number of partitions is not merged: two blocks are little data and much work
    parts = min(max(1, pairs.count()), MOST_PARTS)
    left, right = left.repartition(parts, *by), right.repartition(parts, *by)
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(pair, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.when(F.isnan(x) | (F.abs(x) == math.inf), x.cast("double")).otherwise(F.floor(F.lit(64) * x.cast("double")).cast("double"))).alias("v"))
    return top_k(rows, F.col("vec_id") % 20 == 0).withColumn("score", F.col("score").cast("long"))


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
