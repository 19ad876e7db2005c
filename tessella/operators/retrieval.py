"""Retrieval: cosine top-k, hashed bags of words, substring joins."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from . import automaton, nearest

DIM = 256
#: Rows up to which one side of a theta join is sent to all tasks; beyond it the sides meet in blocks.
BROADCAST_ROWS = 50_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def blocked(left: DataFrame, right: DataFrame, condition: Column | None, rows: int = BROADCAST_ROWS) -> DataFrame:
    """left theta-join right: by broadcast where right has at most rows rows (counted), else in blocks of an equi-join on a block number."""
    n = right.count()
    if n <= rows:
        return left.join(F.broadcast(right), condition if condition is not None else F.lit(True))
    parts = -(-n // rows)
    dealt = right.withColumn("_part", F.pmod(F.xxhash64(*right.columns), F.lit(parts)).cast("int"))
    spread = left.withColumn("_part_l", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    on = F.col("_part_l") == F.col("_part")
    return spread.join(dealt, on if condition is None else on & condition).drop("_part", "_part_l")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("sim"), "ord")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "doc_id", "sim", "rank")


def top_k(queries: DataFrame, docs: DataFrame, k: int = 3, digits: int | None = None, sent: int = nearest.SENT_BYTES, group: int = nearest.GROUP_BYTES) -> DataFrame:
    """query_id, doc_id, sim, rank: the k docs (doc_id, ord, d) with the largest dot product of each query (query_id, q; a stated query set), rounded to digits if given, first by ord on ties.

    Vectors are arrays of doubles; a product with a null, or of vectors that differ in length, is null and comes last.
    """
    spread = docs.repartition(docs.sparkSession.sparkContext.defaultParallelism, "doc_id")  # a row is few bytes and much work
    return _ranked(nearest.nearest(queries, spread, k, digits, nearest.vectors, lambda c: F.size(c) * 8, sent, group), k)


def bucket(token: Column) -> Column:
    """md5 of the token modulo 256: its last byte."""
    return F.conv(F.right(F.md5(token), F.lit(2)), 16, 10).cast("int")


#: Fixed value: words are runs of letters, digits and underscores of any script.
WORDS = r"[\p{L}\p{N}_]+"


def hashed_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, bucket, weight: sparse unit vectors of word counts."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORDS), F.lit(0))
    counts = docs.select(key, F.explode(words).alias("_w")).groupBy(key, bucket(F.col("_w")).alias("bucket")).agg(F.count("*").cast("double").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return counts.select(key, "bucket", (F.col("n") / norm).alias("weight"))


def word_vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The matrix of lists of words: hashed_words, zeros included. A batch hashes each of its words once."""
    words = column.flatten().dictionary_encode()
    of = np.array([hashlib.md5(w.encode()).digest()[-1] for w in words.dictionary.to_pylist()], np.int64)
    at = pc.list_parent_indices(column).to_numpy().astype(np.int64) * DIM + of[words.indices.to_numpy()]
    counts = np.bincount(at, minlength=len(column) * DIM).reshape(len(column), DIM).astype(float)
    norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return {DIM: (np.arange(len(column)), counts / np.where(norm > 0, norm, 1.0))}


def top_k_words(queries: DataFrame, docs: DataFrame, k: int = 3, digits: int = 12, sent: int = nearest.SENT_BYTES, group: int = nearest.GROUP_BYTES) -> DataFrame:
    """query_id, doc_id, sim, rank: the k docs (doc_id, ord, text; both unique) nearest to each query (query_id, text) by hashed words, first by ord on ties of sim rounded to digits.

    A text of some length has words in most of the DIM buckets, so postings of a bucket would hold nearly every doc. Each
    task counts the words of its docs and multiplies their vectors with those of all queries; nothing but the best of each
    query is shuffled. Docs that share no bucket with a query have similarity 0.
    """
    words = F.regexp_extract_all(F.lower(F.col("text")), F.lit(WORDS), F.lit(0))
    asked, read = queries.select("query_id", words.alias("q")), docs.select("doc_id", "ord", words.alias("d"))
    return _ranked(nearest.nearest(asked, read, k, digits, word_vectors, lambda c: F.lit(DIM * 8), sent, group), k)


#: Bytes of values that are sent to all tasks; beyond it values and texts are dealt over groups that meet in pairs.
SENT_BYTES, GROUP_BYTES = 16_000_000, 32_000_000
_AUTOMATA: dict[str, list] = {}


def _finders(key: str, values: list[bytes]) -> list:
    """Automata of values, made once a worker; those of other calls go."""
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = automaton.automata(values)
    return _AUTOMATA[key]


def _held(key: str, values: list[bytes], texts: list[bytes]) -> list[list[str]]:
    """For each text the values that it holds."""
    out: list[list[str]] = [[] for _ in texts]
    for part, finder in _finders(key, values):
        for t, k in finder.held(texts):
            out[t].append(part[k].decode())
    return [sorted(x) for x in out]


def contains_join(texts: DataFrame, text: str, truths: DataFrame, value: str, sent: int = SENT_BYTES, group: int = GROUP_BYTES) -> DataFrame:
    """Rows of texts and truths (no column in common) where the text holds the value; null and empty values never match.

    All different values are looked for at once by automata (operators/automaton.py), so a text is read once whatever the
    number, script and shape of the values, and only texts that hold one go on. Values up to sent bytes, which are
    counted, go to all tasks; more of them are dealt over groups of about group bytes, and every group meets every group
    of texts.
    """
    named = truths.where(F.col(value) != "")
    distinct = named.select(F.col(value).cast("string").alias("value")).distinct()
    size = distinct.agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()[0]
    names, whole = texts.columns, texts.where(F.col(text).isNotNull())
    schema = StructType([*whole.schema.fields, StructField("_held", ArrayType(StringType()))])
    at = names.index(text)

    def tell(b: pa.RecordBatch | pa.Table, key: str, values: list[bytes]) -> Iterator[pa.RecordBatch]:
        for part in b.to_batches() if isinstance(b, pa.Table) else [b]:
            for k in range(0, part.num_rows, 256):
                some = part.slice(k, 256)
                found = _held(key, values, some.column(at).cast(pa.binary()).to_pylist())
                some = pa.RecordBatch.from_arrays([*some.columns, pa.array(found, pa.list_(pa.string()))], names=[*some.schema.names, "_held"])
                yield some.filter(pa.array([bool(x) for x in found]))

    if size <= sent:
        given = sorted(r[0].encode() for r in distinct.toLocalIterator())
        key, shared = uuid.uuid4().hex, texts.sparkSession.sparkContext.broadcast(given)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from tell(b, key, shared.value)

        hits = whole.mapInArrow(scan, schema)
    else:
        parts = -(-size // group)
        slices = max(1, -(-whole.agg(F.sum(F.octet_length(text))).first()[0] // group))
        dealt = whole.withColumn("_slice", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in names)), F.lit(slices)).cast("int")).withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        asked = distinct.withColumn("_group", F.pmod(F.xxhash64("value"), F.lit(parts)).cast("int")).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            given = right.column("value").cast(pa.binary()).to_pylist()
            found = list(tell(left.select(names), uuid.uuid4().hex, given)) if given else []
            return pa.Table.from_batches(found, to_arrow_schema(schema)) if found else to_arrow_schema(schema).empty_table()

        hits = dealt.groupBy("_group", "_slice").cogroup(asked.groupBy("_group", "_slice")).applyInArrow(meet, schema)
    return hits.withColumn("_value", F.explode("_held")).drop("_held").join(named, F.col("_value") == F.col(value)).drop("_value")
