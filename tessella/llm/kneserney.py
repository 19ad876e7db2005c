"""Operator 9, quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is one of characters (order ORDER), for each language: it needs no tokeniser, tells prose from tables, symbol
noise and foreign text, and its n-gram types level off while tokens grow. Trusted text is that of labelled documents of
quality 1. Counting is a sharded aggregate: each task counts its own n-grams first, the counts meet by key, and lower
orders get continuation counts from the types of the next higher one. Discounts are the modified ones (D1, D2, D3+ from
counts of counts, by language and order), and a key's probability and its context's back-off weight are joined at that
key.

Scoring is a join of n-grams with the sharded model. An n-gram and all that it backs off to share the two characters
before its last one, so the model is sharded by those; unigrams and bigrams go to every shard. A task gives the different
n-grams of each batch of documents, by shard and compressed; they are dealt over (shard, salt), a task there holds one
shard and resolves what reaches it; and the results, a log probability for each different n-gram of a batch, are written
by batch, where the task that scores the batch reads its own. What a task reads is bounded by its batch, not by the
model. A batch is known by a hash of its texts; n-grams without a result (a batch cut otherwise on a second reading) are
resolved by reading shard after shard.

Thresholds are quantiles, by language, of the perplexity of trusted documents that were kept out of the counts (fold 0 of
FOLDS). A language with fewer than LEAST of those is judged by the quantile, over all languages, of the distance to the
language's own mean, or by the quantile over all.

Defined cases: null text, empty text and text shorter than two characters have no perplexity and stay. A language
without trusted text has no model and its documents stay (null language is a language of its own, apart from the empty
one). Repeated rows count and are scored alike. Labels of unknown documents are ignored; an empty labels table keeps
everything. Extra columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, map_arrow, slices, table, take_over, trim, unsigned_mix

ORDER = 5
FOLDS = 5
LEAST = 5
QUANTILE = 0.99
#: Trusted ids (8 bytes each) up to which they are sent to all tasks.
BROADCAST_IDS = 1_000_000
#: Bytes and rows of a batch whose n-grams are asked for together.
BATCH, BATCH_ROWS = 16_000_000, 10_000
#: Files of a shard.
FILES = 8
#: Rows of the model in a shard, about, and batches whose results are in one file, about.
SHARD_ROWS, BATCHES = 1_500_000, 4
#: Ways at least over which the n-grams that ask for one shard are dealt; beyond, one for so many batches.
SALTS, ASKING = 8, 16
#: Slots by which a task knows n-grams of a language that it has met (8 bytes each).
MET = 1 << 19
#: Characters are classes of 12 bits: themselves below 3,072, else one of 1,023 by remainder; 0 stands before a text.
BITS = 12
_MASK = np.uint64((1 << BITS) - 1)


def classes(text: str, spaced: bool = False) -> np.ndarray:
    """Class of each character; every white space is a blank, runs of them one (spaced: they are already)."""
    c = np.frombuffer((text if spaced else " ".join(text.split())).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return np.where(c < 3072, np.maximum(c, 1), 3072 + 1 + c % 1023)


def grams(texts: list[str], spaced: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the ORDER-grams that end at each character (12 bits a character, the last one lowest), and lengths of the texts."""
    parts = [classes(t, spaced) for t in texts]
    lengths = np.array([len(p) for p in parts], np.int64)
    pad = np.zeros(ORDER - 1, np.uint64)
    flat = np.concatenate([y for p in parts for y in (pad, p)] or [pad])
    keys = np.zeros(len(flat), np.uint64)
    for back in range(ORDER - 1, -1, -1):
        shifted = np.zeros_like(flat)
        shifted[back:] = flat[: len(flat) - back] if back else flat
        keys = (keys << np.uint64(BITS)) | shifted
    real = np.ones(len(flat), bool)
    at = np.concatenate([[0], np.cumsum(lengths + ORDER - 1)[:-1]]) if len(lengths) else np.zeros(0, int)
    for k in range(ORDER - 1):
        real[at + k] = False
    return keys[real], lengths


def pieces(texts: list[str], size: int = 250_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Keys of texts, about size characters at once: number of the first text, keys, lengths. A longer text comes in slices that know what stands before."""
    at, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if len(t) > size:
            if k > at:
                yield at, *grams(texts[at:k])
            t = " ".join(t.split())
            for a in range(0, len(t), size):
                keys, _ = grams([t[max(0, a - ORDER + 1) : a + size]], True)
                keys = keys[ORDER - 1 :] if a else keys
                yield k, keys, np.array([len(keys)])
            at, held = k + 1, 0
        elif held > size or k == len(texts) - 1:
            yield at, *grams(texts[at : k + 1])
            at, held = k + 1, 0


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, key, n: counts of the highest order over docs (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 10_000, 32_000_000):
            langs = b.column(1).to_pylist()
            texts = b.column(0).to_pylist()
            for lang in sorted({*langs}):
                own = [t for t, x in zip(texts, langs) if x == lang]
                keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                for _, part, _ in pieces(own):  # a piece's counts are added to those of the batch
                    k, n = np.unique(part, return_counts=True)
                    keys, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
                    counts = np.bincount(at, np.concatenate([counts, n])).astype(np.int64)
                yield pa.record_batch([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(counts)], names=["lang", "key", "n"])

    return docs.select("text", "lang").mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _pow(bits: int) -> int:
    return (1 << bits) - 1


def model(trusted: DataFrame) -> DataFrame:
    """lang, level, key, p (log probability, null for a context only), back (log back-off weight of it as a context, null if it is none).

    level is the number of characters of key; level 0 is the empty context.
    """
    counts = cut(count_grams(trusted), "grams")
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        # continuation counts: how many different characters stand before; what begins a text has its plain count already
        levels[k] = cut(levels[k + 1].groupBy("lang", F.col("key").bitwiseAND(F.lit(_pow(BITS * k))).alias("key")).agg(F.count("*").alias("n")), "grams")
    rows = None
    lower = trusted.sparkSession.createDataFrame([], "lang string, key long, p double")
    for k in range(1, ORDER + 1):
        own = levels[k]
        cc = own.groupBy("lang").agg(*(F.count_if(F.col("n") == j).cast("double").alias(f"c{j}") for j in (1, 2, 3, 4)))
        y = F.col("c1") / F.greatest(F.col("c1") + 2 * F.col("c2"), F.lit(1.0))
        ds = [F.greatest(F.lit(0.1), F.least(F.lit(float(j)) - 0.05, j - (j + 1) * y * F.col(f"c{j + 1}") / F.greatest(F.col(f"c{j}"), F.lit(1.0)))) for j in (1, 2, 3)]
        cc = cc.select("lang", *(d.alias(f"d{j}") for j, d in zip((1, 2, 3), ds)))
        own = own.join(F.broadcast(cc), "lang")  # one row a language that trusted text has: bounded by the label list
        own = own.withColumns({"context": F.shiftright("key", BITS), "d": F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))})
        of = own.groupBy("lang", "context").agg(F.sum("n").alias("all"), F.sum("d").alias("freed"))
        gamma = of.select("lang", F.col("context").alias("key"), F.log(F.col("freed") / F.col("all")).alias("back"), "all")
        own = own.join(gamma.select("lang", F.col("key").alias("context"), "back", "all"), ["lang", "context"])
        if k == 1:
            below = F.lit(1.0 / (1 << BITS))
        else:
            own = own.withColumn("suffix", F.col("key").bitwiseAND(F.lit(_pow(BITS * (k - 1))))).join(lower.select("lang", F.col("key").alias("suffix"), F.col("p").alias("q")), ["lang", "suffix"])
            below = F.exp("q")
        scored = cut(own.select("lang", "key", F.log((F.col("n") - F.col("d")) / F.col("all") + F.exp("back") * below).alias("p")), "level")
        part = scored.select("lang", F.lit(k).alias("level"), "key", "p", F.lit(None).cast("double").alias("back"))
        part = part.union(gamma.select("lang", F.lit(k - 1).alias("level"), "key", F.lit(None).cast("double").alias("p"), "back"))
        rows = part if rows is None else rows.union(part)
        lower = scored
    return rows.groupBy("lang", "level", "key").agg(F.max("p").alias("p"), F.max("back").alias("back"))


def _hash(keys: np.ndarray, level: int, lang: int, back: bool = False) -> np.ndarray:
    """Where the model keeps a key's probability, or its back-off weight."""
    return unsigned_mix(keys ^ np.uint64((level | 8 * back) << 60) ^ np.uint64(lang * 0x9E3779B97F4A7C15 & (2**64 - 1)))


def lang_key(c: str) -> str:
    """A language as a key: null is none of the others."""
    return F.coalesce(F.concat(F.lit("="), c), F.lit("")).alias(c)


def lang_code(lang: str) -> int:
    """A number of 40 bits for a language; the table's hash holds it whole."""
    return int.from_bytes(hashlib.sha1(lang.encode()).digest()[:5], "big")


def shard_of(pair: np.ndarray, lang: int, shards: int) -> np.ndarray:
    """The shard of a pair of characters."""
    return (unsigned_mix((pair & np.uint64(_pow(2 * BITS))) ^ np.uint64(lang << 24)) % np.uint64(shards)).astype(np.int32)


def write_shards(rows: DataFrame) -> tuple[str, int]:
    """Writes the model as files of hash and value, a folder a shard (-1: what all shards need); gives the path and how many."""
    n = rows.count()
    shards = max(1, math.ceil(n / SHARD_ROWS))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lang, level, key = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)
        found: list[tuple] = [(np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0))]
        for x in set(lang.tolist()):
            code = lang_code(x)
            for k in range(ORDER + 1):
                own = (lang == x) & (level == k)
                for column, back in ((3, False), (4, True)):
                    value = b.column(column).to_numpy(zero_copy_only=False).astype(float)
                    at = own & ~np.isnan(value)
                    pair = key[at] if back else key[at] >> np.uint64(BITS)
                    small = k <= (1 if back else 2)
                    found.append((np.full(len(pair), -1, np.int32) if small else shard_of(pair, code, shards), _hash(key[at], k, code, back), value[at]))
        shard, h, value = map(np.concatenate, zip(*found))
        return pa.record_batch([pa.array(shard), pa.array(h.view(np.int64)), pa.array(value)], names=["shard", "h", "value"])

    path = fresh(rows.sparkSession, "model")
    hashed = map_arrow(rows.select("lang", F.col("level").cast("int"), "key", "p", "back"), run, "shard int, h long, value double")
    # a shard is some files of one task each, so neither it nor what all shards need is a single task's work
    part = F.pmod(F.col("h"), F.lit(FILES)).alias("part")
    hashed.withColumn("part", part).repartition((shards + 1) * FILES, "shard", "part").drop("part").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return path, shards


class Shard:
    """Open-addressed table of hashes and values: 2 to 4 slots a row, probes vectorised."""

    def __init__(self, h: np.ndarray, value: np.ndarray):
        self.size = 1 << max(4, int(2 * len(h)).bit_length())
        self.at = np.full(self.size, -1, np.int32)
        self.h, self.value = np.append(h, np.uint64(0)), np.append(value, np.nan)
        todo = np.arange(len(h), dtype=np.int32)
        slot = self.slot(h)
        while len(todo):
            free = self.at[slot] < 0
            self.at[slot[free]] = todo[free]  # of those with one slot, the last stays
            lost = self.at[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & (self.size - 1)

    def slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(24)).astype(np.int64) & (self.size - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Value of each hash, NaN for those not there."""
        slot = self.slot(h)
        row = self.at[slot]
        out = np.where((row >= 0) & (self.h[row] == h), row, -1)
        open_ = np.flatnonzero((row >= 0) & (out < 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (self.size - 1)
            row = self.at[slot[open_]]
            hit = (row >= 0) & (self.h[row] == h[open_])
            out[open_[hit]] = row[hit]
            open_ = open_[(row >= 0) & ~hit]
        return self.value[out]


_LOADED: OrderedDict[tuple[str, int], Shard] = OrderedDict()


def load(path: str, shard: int) -> Shard:
    """A shard from the shared folder; a worker keeps the one it used last (about 60 MB), beside what all shards need."""
    take_over("kneserney", _LOADED.clear)
    if (path, shard) not in _LOADED:
        for key in [k for k in _LOADED if k[0] != path or (k[1] >= 0 and shard >= 0)]:
            del _LOADED[key]
        fs, base = pafs.FileSystem.from_uri(path)
        found = fs.get_file_info(pafs.FileSelector(f"{base}/shard={shard}", allow_not_found=True))
        parts = [pq.read_table(f.path, filesystem=fs, columns=["h", "value"], partitioning=None) for f in found if f.path.endswith(".parquet")]
        t = pa.concat_tables(parts) if parts else pa.table({"h": pa.array([], pa.int64()), "value": pa.array([], pa.float64())})
        _LOADED[path, shard] = Shard(t["h"].to_numpy().view(np.uint64), t["value"].to_numpy())
    return _LOADED[path, shard]


def resolve(keys: np.ndarray, lang: str, path: str, shard: int) -> np.ndarray:
    """Log probability of the last character of each key of a shard under the model of the language; NaN without a model."""
    code = lang_code(lang)
    all_, own = load(path, -1), load(path, shard)
    logs = np.zeros(len(keys))
    if np.isnan(all_.find(_hash(np.zeros(1, np.uint64), 0, code, True)))[0]:
        return np.full(len(keys), np.nan)
    open_ = np.arange(len(keys))
    for level in range(ORDER, 0, -1):
        mine = keys[open_] & np.uint64(_pow(BITS * level))
        p = (own if level > 2 else all_).find(_hash(mine, level, code))
        missing = np.isnan(p)
        logs[open_[~missing]] += p[~missing]
        open_, mine = open_[missing], mine[missing]
        back = (own if level > 2 else all_).find(_hash(mine >> np.uint64(BITS), level - 1, code, True))
        logs[open_] += np.where(np.isnan(back), 0.0, back)
    logs[open_] -= BITS * math.log(2)
    return logs


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed differences."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked_keys(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about BATCH bytes or BATCH_ROWS rows, from smaller ones: the more text, the fewer n-grams are asked for twice."""
    held: list[pa.RecordBatch] = []

    def whole() -> pa.RecordBatch:
        out = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
        held.clear()
        return out

    for b in batches:
        if b.num_rows:
            held.append(b)
        if held and (sum(x.nbytes for x in held) >= BATCH or sum(x.num_rows for x in held) >= BATCH_ROWS):
            yield whole()
    if held:
        yield whole()


def batch_id(b: pa.RecordBatch, text: int, lang: int) -> int:
    h = xxhash.xxh64()
    for s in slices(iter([b.select([b.schema.names[text], b.schema.names[lang]])])):
        for t, x in zip(s.column(0).to_pylist(), s.column(1).to_pylist()):
            h.update(f"{len(t or '')} {x or ''} ".encode())
            h.update((t or "").encode("utf-8", "surrogatepass"))
    return h.intdigest() - (1 << 63)


def by_language(b: pa.RecordBatch, text: int, lang: int) -> Iterator[tuple[str, np.ndarray, list[str]]]:
    """Language key, rows and texts of a batch, in slices."""
    at = 0
    for s in slices(iter([b])):
        langs = np.array(["" if x is None else "=" + x for x in s.column(lang).to_pylist()], object)
        texts = np.array([x or "" for x in s.column(text).to_pylist()], object)
        for x in sorted(set(langs.tolist())):
            own = np.flatnonzero(langs == x)
            yield x, at + own, texts[own].tolist()
        at += s.num_rows


class Classifier:
    """A written model and the thresholds by language (at most one for each language of the labels)."""

    def __init__(self, path: str, shards: int, thresholds: dict[str, float]):
        self.path, self.shards, self.thresholds = path, shards, thresholds

    def resolved(self, docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[str, int]:
        """Writes the log probabilities of the different n-grams of every batch of docs; gives the path and the number of folders."""
        path, shards = self.path, self.shards
        t, l = docs.columns.index(text), docs.columns.index(lang)

        def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in gathered(batches):
                name = batch_id(b, t, l)
                met: dict[str, np.ndarray] = {}
                found: dict[str, list[np.ndarray]] = {}
                for x, _, texts in by_language(b, t, l):
                    table_ = met.setdefault(x, np.zeros(MET, np.uint64))
                    for _, keys, _ in pieces(texts):
                        slot = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (MET - 1)
                        new = table_[slot] != keys  # key 0 is no n-gram
                        table_[slot[new]] = keys[new]
                        found.setdefault(x, []).append(np.unique(keys[new]))
                rows = []
                for x, parts in found.items():
                    keys = np.unique(np.concatenate(parts))
                    shard = shard_of(keys >> np.uint64(BITS), lang_code(x), shards)
                    rows += [(name, x, int(s), packed_keys(keys[shard == s])) for s in np.unique(shard)]
                yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int32(), pa.binary()))], names=["batch", "lang", "shard", "keys"])
            trim()

        def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 256):
                logs = [resolve(unpacked_keys(raw), x, path, s).astype("<f4").tobytes() for x, s, raw in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]
                yield pa.record_batch([*b.columns[:2], b.column(3), pa.array(logs, pa.binary())], names=["batch", "lang", "keys", "logs"])

        asked = cut(docs.mapInArrow(needs, "batch long, lang string, shard int, keys binary"), "asked")
        batches = asked.select("batch").distinct().count()
        salts = max(SALTS, math.ceil(batches / ASKING))
        dealt = asked.withColumn("salt", F.pmod(F.col("batch"), F.lit(salts))).repartition(shards * salts, "shard", "salt").sortWithinPartitions("shard").drop("salt")
        told = dealt.mapInArrow(answers, "batch long, lang string, keys binary, logs binary")
        folders = max(1, math.ceil(batches / BATCHES))
        out = fresh(docs.sparkSession, "by-batch")
        told.withColumn("folder", F.pmod(F.col("batch"), F.lit(folders)).cast("int")).repartition(folders, "folder").sortWithinPartitions("folder", "batch").write.partitionBy("folder").parquet(out)
        return out, folders

    def perplexities(self, b: pa.RecordBatch, text: int, lang: int, answers: tuple[str, int]) -> np.ndarray:
        """Perplexity by character of each text of a batch; NaN without a model of its language, or for under two characters."""
        name = batch_id(b, text, lang)
        fs, base = pafs.FileSystem.from_uri(answers[0])
        known: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for f in fs.get_file_info(pafs.FileSelector(f"{base}/folder={name % answers[1]}", allow_not_found=True)):
            if f.path.endswith(".parquet"):
                t = pq.read_table(f.path, filesystem=fs, columns=["lang", "keys", "logs"], partitioning=None, filters=[("batch", "=", name)])
                for x, keys, logs in zip(*(t[c].to_pylist() for c in ("lang", "keys", "logs"))):
                    known.setdefault(x, []).append((unpacked_keys(keys), np.frombuffer(logs, "<f4").astype(float)))
        tables = {x: Shard(_hash(np.concatenate([k for k, _ in parts]), 0, 0), np.concatenate([v for _, v in parts])) for x, parts in known.items()}
        sums, counts = np.zeros(b.num_rows), np.zeros(b.num_rows)
        for x, rows, texts in by_language(b, text, lang):
            own = tables.get(x)
            for first, keys, lengths in pieces(texts):
                logs = own.find(_hash(keys, 0, 0)) if own is not None else np.full(len(keys), np.nan)
                missing = np.flatnonzero(np.isnan(logs))
                if len(missing):  # no model of the language, or another batch than the one that asked
                    logs[missing] = self.looked_up(keys[missing], x)
                ends = np.cumsum(lengths)
                whole = np.concatenate([[0.0], np.cumsum(logs)])
                np.add.at(sums, rows[first : first + len(lengths)], whole[ends] - whole[ends - lengths])
                np.add.at(counts, rows[first : first + len(lengths)], lengths)
        return np.where(counts > 1, np.exp(-sums / np.maximum(counts, 1)), np.nan)

    def looked_up(self, keys: np.ndarray, lang: str) -> np.ndarray:
        """Log probabilities from the model itself, shard after shard."""
        out = np.full(len(keys), np.nan)
        code = lang_code(lang)
        if not np.isnan(load(self.path, -1).find(_hash(np.zeros(1, np.uint64), 0, code, True)))[0]:
            shard = shard_of(keys >> np.uint64(BITS), code, self.shards)
            for s in np.unique(shard):
                out[shard == s] = resolve(keys[shard == s], lang, self.path, int(s))
        return out

    def limits(self, langs: list) -> list[float | None]:
        return [self.thresholds.get("" if x is None else "=" + x) for x in langs]

    def judge(self, b: pa.RecordBatch, text: int, lang: int, answers: tuple[str, int]) -> tuple[np.ndarray, list[float | None], np.ndarray]:
        """Perplexity, threshold and verdict of each row of a batch."""
        ppl = self.perplexities(b, text, lang, answers)
        limits = self.limits(b.column(lang).to_pylist())
        return ppl, limits, ~(ppl > np.array([np.inf if x is None else x for x in limits], float))


def train(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> Classifier:
    """Counts, model and thresholds from the documents that labels mark with quality 1."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    good = cut(good, "good")
    if good.count() <= BROADCAST_IDS:  # else the texts are shuffled to the ids
        good = F.broadcast(good)
    trusted = docs.select("doc_id", "lang", "text").where("text is not null").join(good, "doc_id", "left_semi")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    made = Classifier(*write_shards(cut(model(trusted.where(fold != 0).select("text", lang_key("lang"))), "rows")), {})
    held = cut(trusted.where(fold == 0).select("lang", "text"), "held")
    answers = made.resolved(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            yield pa.record_batch([b.column(0), pa.array(made.perplexities(b, 1, 0, answers))], names=["lang", "ppl"])
        trim()

    ppl = cut(held.mapInArrow(run, "lang string, ppl double").where(~F.isnan("ppl")).select(lang_key("lang"), F.log("ppl").alias("ppl")), "ppl")
    return Classifier(made.path, made.shards, thresholds(ppl, quantile))


def thresholds(held: DataFrame, quantile: float) -> dict[str, float]:
    """The threshold of each language, from logarithms of perplexities (lang, ppl) of held-out trusted documents."""
    at = lambda c: F.percentile_approx(c, F.lit(quantile), 10_000)
    of = {r["lang"]: r for r in held.groupBy("lang").agg(at("ppl").alias("t"), F.avg("ppl").alias("mean"), F.count("*").alias("n")).collect()}  # a row a language
    if not of:
        return {}
    mean = F.create_map(*(F.lit(x) for k, r in of.items() for x in (k, r["mean"])))
    spread = held.agg(at(F.col("ppl") - F.element_at(mean, F.col("lang"))).alias("t")).first()["t"]
    # a billionth more, so that the document which set a threshold is not rejected by rounding
    return {k: math.exp(r["t"] if r["n"] >= LEAST else r["mean"] + spread) * (1 + 1e-9) for k, r in of.items()}


def classify(docs: DataFrame, model_: Classifier) -> DataFrame:
    """doc_id, lang, perplexity (null if it has none), threshold (null if its language has none), kept."""
    docs = docs.select("doc_id", "text", "lang")
    answers = model_.resolved(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            ppl, limit, kept = model_.judge(b, 1, 2, answers)
            yield pa.record_batch([b.column(0).cast(pa.int64()), b.column(2), pa.array(ppl, from_pandas=True), pa.array(limit, pa.float64()), pa.array(kept)], names=["doc_id", "lang", "perplexity", "threshold", "kept"])
        trim()

    return docs.mapInArrow(run, "doc_id long, lang string, perplexity double, threshold double, kept boolean")


def kept_only(docs: DataFrame, model_: Classifier) -> DataFrame:
    """The rows of docs that stay, all columns."""
    text, lang = docs.columns.index("text"), docs.columns.index("lang")
    answers = model_.resolved(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            yield b.filter(pa.array(model_.judge(b, text, lang, answers)[2]))
        trim()

    return docs.mapInArrow(run, docs.schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
