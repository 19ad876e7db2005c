"""Near-duplicates by exact Jaccard similarity of word shingles: what completes SimHash where a filter needs exact links.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. No reach of SimHash
bits is equivalent to that, so links are found in three steps, each of which looks only at texts that the steps before
have not brought together:

1. fingerprints that a SimHash grid links;
2. cells of equal min-hashes: each text is paired with the one text of another group in its cell that may be most
   similar, so that a large group of near copies costs its size and not its square;
3. prefix filtering, which is exact: under one order of all shingles, two linked sets share one of the first
   n - ceil(0.8 n) + 1 shingles of either. The order puts shingles that are common in a fixed share of the texts last and
   those by frequency; any order is exact, this one keeps cells small. A prefix cell gives the pairs of texts that are not
   in one component yet and that may be similar.

Whether a pair may be similar follows from bounds that never miss a link: the sizes of the sets, the places of the shared
shingle, and counts of the shingles in BUCKETS buckets by hash, whose common part is no smaller than that of the sets.
What passes is checked by its shingles; only texts of such pairs are sent. Cells of over HOT_ROWS rows are split into
blocks, and each pair of blocks is a task's group of its own. Components come from star steps over the links.

Defined cases: texts without words, null too, are alike. A text of under five words is one shingle. Copies meet once, as
one row. Sets are of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, slices, texts, trim, unsigned_mix
from .components import components

SHINGLE, SEED = 5, 42
#: Least similarity of linked texts, as a fraction.
OF, PARTS = 4, 5
#: Min-hashes of a set.
MINS = 3
#: One of so many texts is counted, sampled texts that make a shingle common, and common shingles (16 bytes each) sent to all tasks.
SHARE, COMMON, MOST_COMMON = 8, 3, 500_000
#: Buckets by which shingles are counted.
BUCKETS = 128
#: Rows of a cell beyond which it is split.
HOT_ROWS = 4_000
#: Ways over which the rows of a cell are dealt where they only ask whether it is open.
SALTS = 8
#: Keys (8 bytes each) that are sent to all tasks; shuffled beyond.
BROADCAST_KEYS = 500_000


def hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the shingles of a whole text in UTF-8, in their order, repeats included; none without words."""
    w = text.lower().split()
    n = len(w)
    if not n:
        return np.zeros(0, np.uint64)
    s, digest = b" ".join(w), xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(s, SEED)], np.uint64)
    ends = list(accumulate((len(x) + 1 for x in w), initial=0))
    return np.fromiter((digest(s[i : j - 1], SEED) for i, j in zip(ends, ends[shingle:])), np.uint64, n - shingle + 1)


def fingerprint_of(h: np.ndarray) -> int:
    """SimHash of shingle hashes: the bits set in over half of them."""
    total = np.zeros(64, np.int64)
    for a in range(0, len(h), 65_536):
        total += np.unpackbits(h[a : a + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view("<u8")[0])


def distinct(h: np.ndarray) -> np.ndarray:
    """A set of shingle hashes, sorted; that of a text without words holds one of its own."""
    return np.unique(h) if len(h) else np.zeros(1, np.uint64)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    return distinct(hashes(text, shingle))


def linked_sizes(a: int, b: int, common: int) -> bool:
    """Whether sets of a and b shingles with so many common ones are similar enough."""
    return PARTS * common >= OF * (a + b - common)


def prefix(s: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of all shingles: common (sorted) ones last, by their rank."""
    size = len(s) - -(-OF * len(s) // PARTS) + 1
    if not len(common):
        return s[:size]
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    late = common[at] == s
    rare = s[~late]
    return rare[:size] if len(rare) >= size else np.concatenate([rare, s[late][np.argsort(rank[at[late]])]])[:size]


def common_shingles(keyed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a share of the texts, sorted, and their ranks by frequency."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.concatenate([np.zeros(0, np.uint64), *map(shingles, texts(b.column(0)))]).view(np.int64))], names=["s"])

    sample = keyed.where(F.pmod(F.xxhash64("key"), F.lit(SHARE)) == 0).select("text")
    often = map_arrow(sample, run, "s long").groupBy("s").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "s").limit(MOST_COMMON).toArrow()
    s, count = often["s"].to_numpy().astype(np.int64).view(np.uint64), often["count"].to_numpy()
    order = np.argsort(s)
    rank = np.empty(len(s), np.int64)
    rank[np.lexsort((s, count))] = np.arange(len(s))
    return s[order], rank[order]


CELLS = "kind byte, cell long, key long, n int, place int, hist binary"


def histogram(s: np.ndarray) -> bytes:
    """How many shingles of a set are in each bucket: in units of a power of two, rounded up, which the last byte names."""
    count = np.bincount((s & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    shift = max(0, int(count.max()).bit_length() - 7)
    return (-(-count // (1 << shift))).clip(0, 255).astype(np.uint8).tobytes() + bytes([shift])


def may_share(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """At most how many shingles a set can share with each of the others, from their histograms (rows of BUCKETS + 1 bytes)."""
    units = lambda h: h[..., :-1].astype(np.int32) << h[..., -1:].astype(np.int32)
    return np.minimum(units(one), units(many)).sum(-1)


def cells_of(keyed: DataFrame, common: np.ndarray, rank: np.ndarray) -> DataFrame:
    """kind (0: prefix, -1: the SimHash fingerprint, else the min-hash), cell, key, number of shingles, place in the prefix, histogram (with the fingerprint)."""
    seeds = unsigned_mix(np.arange(1, MINS + 1))
    kinds = np.array([-1, *range(1, MINS + 1)], np.int8)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        parts: list[list[np.ndarray]] = [[np.zeros(0, kind)] for kind in (np.int8, np.uint64, np.int64, np.int32, np.int32)]
        hists: list[bytes | None] = []
        for k, x in zip(b.column(0).to_numpy(), texts(b.column(1))):
            h = hashes(x)
            s = distinct(h)
            first = prefix(s, common, rank)
            m = len(first) + len(kinds)
            lows = np.array([fingerprint_of(h), *(unsigned_mix(s ^ seed).min() for seed in seeds)], np.uint64)
            row = np.concatenate([np.zeros(len(first), np.int8), kinds]), np.concatenate([first, lows]), np.full(m, k), np.full(m, len(s), np.int32), np.concatenate([np.arange(len(first), dtype=np.int32), np.zeros(len(kinds), np.int32)])
            for part, values in zip(parts, row):
                part.append(values)
            hists += [None] * len(first) + [histogram(s)] + [None] * MINS
        kind, cell, key, n, place = map(np.concatenate, parts)
        return pa.record_batch([pa.array(kind), pa.array(cell.view(np.int64)), pa.array(key), pa.array(n), pa.array(place), pa.array(hists, pa.binary())], names=["kind", "cell", "key", "n", "place", "hist"])

    return map_arrow(keyed, run, CELLS)


def shared_cells(cells: DataFrame) -> DataFrame:
    """The rows of cells that hold two keys or more, and all fingerprints. A cell is only streamed past, so one of any size may be in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None  # the last key of the open cell, held back until its next row
        many = False  # whether rows of the open cell have been given
        for b in batches:
            if not b.num_rows:
                continue
            held = rest is not None
            t = pa.Table.from_batches([rest, b] if held else [b]).combine_chunks()
            kind, cell, key = (t[k].to_numpy() for k in ("kind", "cell", "key"))
            same = (kind[1:] == kind[:-1]) & (cell[1:] == cell[:-1])
            twin = same & (key[1:] == key[:-1])
            fresh = np.append(True, ~twin)  # keys are sorted in their cell: one row of each
            t, kind, cell, same = t.filter(pa.array(fresh)), kind[fresh], cell[fresh], same[~twin]
            give = np.append(False, same) | np.append(same, False)
            give[0] |= held and many
            last = len(give) - 1
            many = bool(give[last] and (last > 0 or many))
            give |= kind < 0
            yield from t.slice(0, last).filter(pa.array(give[:last])).to_batches()
            rest = t.slice(last).combine_chunks().to_batches()[0]
        if rest is not None and (many or rest.column(0)[0].as_py() < 0):
            yield rest
        trim()

    return cells.repartition("kind", "cell").sortWithinPartitions("kind", "cell", "key").mapInArrow(run, CELLS)


def pairs(rows: DataFrame, nearest: bool, hot: int = HOT_ROWS) -> DataFrame:
    """u, v: texts of one cell (kind, cell, key, n, place, root, hist) with different roots that may be similar; nearest: of each text only the one it may share most with."""
    crowded = rows.groupBy("kind", "cell").agg(F.ceil(F.count("*") / hot).cast("long").alias("parts")).where("parts > 1")
    dealt = rows.join(crowded, ["kind", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)).cast("long"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    by = ["kind", "cell", "a", "b"]
    dealt = dealt.select("kind", "cell", F.least("own", "with").alias("a"), F.greatest("own", "with").alias("b"), "key", F.col("n").cast("long").alias("n"), F.col("place").cast("long").alias("place"), "root", "hist")

    def some(t: pa.Table) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((t["key"].to_numpy(), t["n"].to_numpy()))
        key, n, place, root = (t[c].to_numpy()[order] for c in ("key", "n", "place", "root"))
        if root.min() == root.max():
            return
        hist = np.frombuffer(b"".join(t["hist"].to_pylist()), np.uint8).reshape(len(key), -1)[order]
        for i in range(1, len(key)):
            j = np.arange(np.searchsorted(n, -(-OF * n[i] // PARTS)), i)
            # the fewest shingles that linked sets of these sizes share, and the most that these can, if the cell's is their first
            j = j[root[j] != root[i]]
            fewest = -(-OF * (n[i] + n[j]) // (OF + PARTS))
            j = j[np.minimum(n[i] - place[i], n[j] - place[j]) >= fewest]
            if len(j):
                most = may_share(hist[i], hist[j])
                near = most >= -(-OF * (n[i] + n[j]) // (OF + PARTS))
                j, most = j[near], most[near]
            if len(j):
                j = j[[int(np.argmax(most / (n[i] + n[j] - most + 1e-9)))]] if nearest else j
                yield pa.record_batch([pa.array(np.minimum(key[i], key[j])), pa.array(np.maximum(key[i], key[j]))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in slices(batches, 10_000):
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            cells = np.stack([t[c].to_numpy() for c in by], 1)
            start = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]).any(1)))
            for i, j in zip(start[:-1], start[1:]):
                if j - i > 1:
                    yield from some(t.slice(i, j - i))
            rest = t.slice(start[-1])
        if rest is not None and rest.num_rows > 1:
            yield from some(rest)
        trim()

    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "u long, v long").distinct()


def checked(candidates: DataFrame, keyed: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) that are linked."""
    keys = cut(candidates.select(F.explode(F.array("u", "v")).alias("key")).distinct(), "keys")
    sent = F.broadcast if keys.count() <= BROADCAST_KEYS else lambda df: df
    needed = cut(keyed.join(sent(keys), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")), "needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for b in slices(batches):
            linked = []
            for u, x, y in zip(b.column(0).to_pylist(), texts(b.column(2)), texts(b.column(3))):
                if u != last:
                    last, left = u, shingles(x)
                right = shingles(y)
                linked.append(linked_sizes(len(left), len(right), len(np.intersect1d(left, right, assume_unique=True))))
            yield b.select(["u", "v"]).filter(pa.array(linked, pa.bool_()))

    second = candidates.join(needed.select(F.col("key").alias("v"), F.col("text").alias("right")), "v")
    both = second.join(needed.select(F.col("key").alias("u"), F.col("text").alias("left")), "u").select("u", "v", "left", "right")
    return both.sortWithinPartitions("u").mapInArrow(run, "u long, v long")


def classes(keyed: DataFrame, fingerprint_links: Callable[[DataFrame], DataFrame], hot: int = HOT_ROWS) -> DataFrame:
    """fp, root: the keys of keyed (key, text) that are linked to others, directly or not, and the smallest of those.

    fingerprint_links: from the distinct fingerprints (fp) to links (u, v) among them.
    """
    shared = cut(shared_cells(cells_of(keyed, *common_shingles(keyed))), "shared")
    prints = shared.where("kind < 0")

    def apart(kinds: str, edges: DataFrame) -> DataFrame:
        """Shared cells of these kinds that hold keys not brought together yet, with the keys' roots and histograms."""
        roots = cut(components(edges).withColumnRenamed("node", "key"), "roots")
        rows = shared.where(kinds).drop("hist").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
        open_ = rows.groupBy("kind", "cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        # a cell of a large group has many rows: it is met by several tasks
        salted = open_.select("kind", "cell", F.explode(F.array(*(F.lit(k).cast("long") for k in range(SALTS)))).alias("salt"))
        rows = cut(rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS))).join(salted, ["kind", "cell", "salt"], "left_semi").drop("salt"), "open")
        return rows.join(prints.select("key", "hist").dropDuplicates(["key"]), "key")

    # 1. texts of one fingerprint meet the first of them; linked fingerprints meet by their first texts
    of = prints.select(F.col("cell").alias("fp"), "key")
    first = cut(of.groupBy("fp").agg(F.min("key").alias("first"), F.max("key").alias("last")), "first")
    copies = of.join(first.where("first < last"), "fp").where("key > first").select(F.col("first").alias("u"), F.col("key").alias("v"))
    met = fingerprint_links(first.select("fp")).join(first.select(F.col("fp").alias("u"), F.col("first").alias("x")), "u").join(first.select(F.col("fp").alias("v"), F.col("first").alias("y")), "v")
    edges = cut(checked(cut(copies.union(met.select(F.least("x", "y"), F.greatest("x", "y"))).distinct(), "pairs"), keyed), "links")
    # 2. min-hashes, 3. prefixes
    for kinds, nearest in (("kind > 0", True), ("kind = 0", False)):
        edges = edges.union(cut(checked(cut(pairs(apart(kinds, edges), nearest, hot), "pairs"), keyed), "links"))
    return cut(components(edges).select(F.col("node").alias("fp"), "root"), "classes")
