"""Exact nearest vectors: the k largest dot products of each query, block by block as matrix products.

A task holds a block of queries and reads its documents once. What a query has found so far bounds what a later block must
reach, so nearly all products are only compared with that bound; those that reach it are rounded as Spark rounds. A product
within its own error of a rounding border, where the order of the sum could decide, is summed again from left to right.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

#: Bytes of queries that are sent to all tasks; beyond it queries and documents are dealt over groups that meet in pairs.
SENT_BYTES, GROUP_BYTES = 16_000_000, 64_000_000
#: Queries and documents of one matrix product.
QUERIES, DOCS = 1_024, 4_096
_MOST = np.finfo(float).max

#: Reads a column: for each length of vectors their rows and their matrix.
Reader = Callable[[pa.Array], dict[int, tuple[np.ndarray, np.ndarray]]]


def vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Lists of doubles. Those that are null or hold a null are in no matrix."""
    length = np.array(pc.fill_null(pc.list_value_length(column), -1))
    inner = column.flatten()
    if inner.null_count:
        length[pc.list_parent_indices(column).filter(inner.is_null()).to_numpy()] = -1
    out = {}
    for n in np.unique(length[length >= 0]).tolist():
        rows = np.flatnonzero(length == n)
        out[n] = rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), n)
    return out


def _left_to_right(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Dot products over the first axis, summed in its order."""
    out = np.zeros(np.broadcast_shapes(q.shape[1:], d.shape[1:]))
    for x, y in zip(q, d):
        out += x * y
    return out


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as Spark rounds doubles: the shortest decimal of each, halves away from zero."""
    some, at = np.unique(x, return_inverse=True)
    step = Decimal(1).scaleb(-digits)
    return np.array([float(Decimal(repr(v)).quantize(step, ROUND_HALF_UP)) if abs(v) < 1e15 else v for v in some.tolist()], float)[at]


def best_of_block(q: np.ndarray, d: np.ndarray, k: int, digits: int | None, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q, rows of d and products of the k best of each query in a block, equal ones by row of d, but for those under what kept holds; kept (k a query) is brought up to date."""
    with np.errstate(all="ignore"):
        s = q @ d.T if digits is not None else _left_to_right(q.T[:, :, None], d.T[:, None, :])
        if not np.isfinite(s.sum()):
            s = np.where(np.isnan(s), _MOST, np.clip(s, -_MOST, _MOST))
        bound = kept.min(axis=1)
        if len(d) > k and not np.isfinite(bound).all():
            bound = np.maximum(bound, np.partition(s, len(d) - k, axis=1)[:, len(d) - k])
        error, scale = 0.0, 10.0 ** (digits or 0)
        if digits is not None:
            error = 3e-16 * (q.shape[1] + 2) * np.sqrt((q * q).sum(axis=1).max() * (d * d).sum(axis=1).max())
            error = error if np.isfinite(error) else _MOST / scale / 4
            bound = bound - 2 * error - 2 / scale
        r, c = np.nonzero(s >= bound[:, None])
        out = s[r, c]
        if digits is not None:
            x = out * scale
            out = np.rint(x) / scale + 0.0
            near = np.flatnonzero((np.abs(x - np.floor(x) - 0.5) <= error * scale) | ~(np.abs(x) < 2.0**52))
            for at in range(0, len(near), QUERIES * DOCS // 16):
                some = near[at : at + QUERIES * DOCS // 16]
                out[some] = half_up(_left_to_right(q.T[:, r[some]], d.T[:, c[some]]), digits) + 0.0
        else:
            out = np.where(np.abs(out) < _MOST, out, _left_to_right(q.T[:, r], d.T[:, c])) if (np.abs(out) >= _MOST).any() else out
    value = np.where(np.isnan(out), _MOST, np.clip(out, -_MOST, _MOST))
    order = np.lexsort((c, -value, ~np.isnan(out), r))
    r, c, out, value = r[order], c[order], out[order], value[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    own = place < k
    r, c, out, value, place = r[own], c[own], out[own], value[own], place[own]
    fresh = np.full_like(kept, -np.inf)
    fresh[r, place] = value
    kept[:] = np.partition(np.concatenate([kept, fresh], axis=1), k, axis=1)[:, k:]
    return r, c, out


def _sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, DOCS):
            yield b.slice(at, DOCS)


def _found(asked: pa.Table, batches: Iterable[pa.RecordBatch], k: int, digits: int | None, of: Reader, names: list[str]) -> Iterator[pa.RecordBatch]:
    """query_id, doc_id, ord, sim of documents (doc_id, ord, d) that hold the k best of each query (query_id, q), and few others."""
    asked = asked.combine_chunks()
    ids = asked.column(0).combine_chunks()
    lists = asked.column(1).combine_chunks()
    queries = of(lists)
    told = np.zeros(len(ids), bool)
    for rows, _ in queries.values():
        told[rows] = True
    queries[-1] = np.flatnonzero(~told), np.zeros((int((~told).sum()), 0))  # without a product
    kept = {n: np.full((len(rows), k), -np.inf) for n, (rows, _) in queries.items()}
    for b in _sliced(batches):
        b = b.take(pc.sort_indices(b.column(1), null_placement="at_start"))
        docs = of(b.column(2))
        for n, (rows, q) in queries.items():
            cols, d = docs.get(n, (np.zeros(0, int), np.zeros((0, max(n, 0)))))
            others = np.setdiff1d(np.arange(b.num_rows), cols)[:k]
            for at in range(0, len(rows), QUERIES):
                own = rows[at : at + QUERIES]
                r, c, sim = best_of_block(q[at : at + QUERIES], d, k, digits, kept[n][at : at + QUERIES]) if len(d) else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
                left = pa.array(np.concatenate([own[r], np.repeat(own, len(others))]))
                right = pa.array(np.concatenate([cols[c], np.tile(others, len(own))]))
                sims = pa.concat_arrays([pa.array(sim, pa.float64()), pa.nulls(len(own) * len(others), pa.float64())])
                yield pa.RecordBatch.from_arrays([ids.take(left), b.column(0).take(right), b.column(1).take(right), sims], names=names)


def nearest(queries: DataFrame, docs: DataFrame, k: int, digits: int | None, of: Reader, width: Callable[[Column], Column], sent: int = SENT_BYTES, group: int = GROUP_BYTES) -> DataFrame:
    """query_id, doc_id, ord, sim: among docs (doc_id, ord, d) the k best of each query (query_id, q), and few others; of reads q and d.

    width: bytes of a row of q or d in its matrix. Up to sent bytes of queries, which are counted, go to all tasks; more of
    them are dealt over parts, documents over slices of about group bytes, and every part meets every slice.
    """
    asked, read = queries.select("query_id", "q"), docs.select("doc_id", "ord", "d")
    schema = StructType([StructField("query_id", asked.schema["query_id"].dataType), *(StructField(c, read.schema[c].dataType) for c in ("doc_id", "ord")), StructField("sim", DoubleType())])
    names = schema.names
    size_of = lambda rows, c: rows.agg(F.coalesce(F.sum(F.lit(16) + F.greatest(width(F.col(c)), F.lit(0))), F.lit(0))).first()[0]
    size = size_of(asked, "q")
    if size <= sent:
        shared = asked.sparkSession.sparkContext.broadcast(asked.toArrow())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _found(shared.value, batches, k, digits, of, names)

        return read.mapInArrow(scan, schema)
    parts, slices = -(-size // sent), max(1, -(-size_of(read, "d") // group))
    deal = lambda rows, own, n, other, m: rows.withColumn(own, F.pmod(F.xxhash64(rows.columns[0]), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(_found(left.select(["query_id", "q"]), right.select(["doc_id", "ord", "d"]).to_batches(), k, digits, of, names)) if left.num_rows else []
        return pa.Table.from_batches(found) if found else to_arrow_schema(schema).empty_table()

    left, right = deal(asked, "_part", parts, "_slice", slices), deal(read, "_slice", slices, "_part", parts)
    return left.groupBy("_part", "_slice").cogroup(right.groupBy("_part", "_slice")).applyInArrow(meet, schema)
