"""Operator 8, best-fit packing by a grouping genetic algorithm on islands with elite migration.

Documents become token ids and one end id, are cut where longer than a sequence, and the pieces are packed whole. Pieces
are dealt over shards of about SHARD pieces. Best fit in falling order packs a shard first; where it meets the lower
bound (sizes over capacity, rounded up) nothing can be better and the shard is done. The other shards are evolved by
ISLANDS islands, each a group of its own on the cluster: a population of packings (the best fit and jittered orders)
evolves by grouping crossover, which injects a random part of one parent's well-filled bins whole into the other,
removes duplicates by dissolving the bins they came from and the emptiest one, trades displaced pieces against one or
two placed ones where that fills a bin better, and best-fits what is left. Fitness is the number of bins, then how
unevenly they are filled. An island stops at the bound or after PATIENCE generations without a gain. Between EPOCHS the
elite of each island migrates to the next island of its shard. The best packing of a shard's islands stays. What lies in
poorly filled bins of all shards is pooled and packed in the same way once more, so shards don't leave a part-filled bin
each.

Tokenisation is exact: white space never joins tokens, so the different words of a slice are encoded once and kept in a
bounded cache; words of Latin letters within simple punctuation are taken apart column by column and their runs go to the
tokeniser's model directly, other words through the whole tokeniser.

Defined cases: null and empty texts are the end id alone. Repeated rows and null doc_ids are documents of their own.
Extra columns are ignored. Very long texts are cut into pieces, never dropped. Ties in fill keep the first bin. Empty
tables give an empty result.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, table, take_over

CAPACITY = 2_048
SHARD, ISLANDS, EPOCHS = 8_192, 2, 3
POPULATION, START, PATIENCE = 12, 4, 10
WELL, POOR = 0.98, 0.95
#: Bins at most that a crossover injects: what it displaces is placed anew piece by piece.
INJECTED = 64
#: Bins of so many pieces at most take part in trades of pairs: with more pieces in a bin, best fit leaves no room.
PAIRED = 8
#: Runs of letters or punctuation, and other words, whose ids a worker remembers twice at most (about 200 bytes each): those met lately, and those met before.
CACHE_WORDS = 200_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Cache:
    """A bounded memory of two generations: what is met again moves to the younger one, the older one is dropped whole."""

    def __init__(self, make):
        self.make, self.young, self.old = make, {}, {}

    def all_of(self, keys: list[str]) -> list[bytes]:
        out = list(map(self.young.get, keys))
        for k, x in enumerate(out):
            if x is None:
                key = keys[k]
                if (x := self.old.get(key)) is None:
                    x = self.make(key)
                out[k] = x
                if len(key) <= 64:
                    self.young[key] = x
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        return out


class Encoder:
    """Token ids of texts, as tokenizers gives them without special tokens added, by a cache of words."""

    #: No ' and no <, > and |: with them, what follows matters (contractions, special tokens).
    MARKS = r"[!-&(-/:;=?@\[\]\\^_`{}~]*"
    PLAIN = f"^(?P<a>{MARKS})(?P<b>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<c>{MARKS})$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        #: How byte-level models write bytes as characters.
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.parts, self.words = Cache(self.part), Cache(self.word)

    def part(self, s: str) -> bytes:
        """Ids of one lower-case run of letters or punctuation."""
        text = s if s.isascii() else "".join(self.letters[b] for b in s.encode())
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def word(self, s: str) -> bytes:
        return array("I", self.whole.encode(s, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin (one more entry than texts)."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        counts = pc.list_value_length(split).to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(split.flatten())
        if not len(coded):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        words = coded.dictionary
        plain = pc.extract_regex(words, self.PLAIN)  # null for other words; lower case is one letter for one there
        before, letters, after = (pc.struct_field(plain, k) for k in range(3))
        runs = pc.dictionary_encode(pa.concat_arrays([before, pc.utf8_lower(letters), after]))
        found = self.parts.all_of(runs.dictionary.to_pylist())
        # each word is three runs; another word is one of its own and two empty ones
        of = pc.fill_null(runs.indices, -1).to_numpy().reshape(3, -1).T.copy()
        odd = np.flatnonzero(pc.is_null(plain).to_numpy(zero_copy_only=False))
        of[odd] = len(found) + len(odd)
        of[odd, 0] = len(found) + np.arange(len(odd))
        found = [*found, *self.words.all_of(words.take(pa.array(odd)).to_pylist()), b""]
        # a slice has fewer than 2**31 tokens, so 4 bytes do for places
        length = np.fromiter(map(len, found), np.int32, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        offset = np.cumsum(length, dtype=np.int32) - length
        at = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(length[of].sum(1, dtype=np.int32)[at], dtype=np.int64)])
        run = of[at].ravel()
        run = run[length[run] > 0]
        own = length[run]
        place = np.repeat(offset[run] - np.cumsum(own, dtype=np.int32) + own, own)
        place += np.arange(len(place), dtype=np.int32)
        return flat[place], ends[np.concatenate([[0], np.cumsum(counts)])]


_ENCODERS: dict[str, Encoder] = {}
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every document, in place order; with_ids adds their ids (the real sequences' content)."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("packing", _ENCODERS.clear)
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encoder = _ENCODERS[path]
        for b in slices(batches, 4_000, 6_000_000):
            ids = b.column(0).to_pylist()
            flat, starts = encoder.encode(b.column(1))
            out: list[tuple] = []
            for k, doc in enumerate(ids):
                own = np.append(flat[starts[k] : starts[k + 1]], np.uint32(0)).astype("<u4", copy=False)
                for p, s in enumerate(range(0, len(own), capacity)):
                    part = own[s : s + capacity]
                    out.append((doc, p, s, len(part), crc32(part), *([part.astype(np.int64)] if with_ids else [])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out[0])])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE + ", ids array<int>" * with_ids)


def best_fit(sizes: np.ndarray, order: np.ndarray, bins: np.ndarray, room: list[int], capacity: int) -> None:
    """Puts the pieces of order into the fullest bin with room for each, or a new one; changes bins and room."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    for k, r in enumerate(room):
        by_room[r].append(k)
    mask = sum(1 << r for r in range(capacity + 1) if by_room[r])
    for i, n in zip(order.tolist(), sizes[order].tolist()):
        fit = mask >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            k = by_room[r].pop()
            if not by_room[r]:
                mask &= ~(1 << r)
        else:
            r, k = capacity, len(room)
            room.append(capacity)
        bins[i] = k
        room[k] = left = r - n
        by_room[left].append(k)
        mask |= 1 << left


def packed(sizes: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    bins = np.full(len(sizes), -1, np.int64)
    best_fit(sizes, order, bins, [], capacity)
    return bins


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Smaller is better: bins used, then how unevenly they are filled (negated)."""
    fill = np.bincount(bins, sizes)
    fill = fill[fill > 0]
    return len(fill), -float(np.square(fill / capacity).sum())


def traded(sizes: np.ndarray, bins: np.ndarray, n: int, loose: np.ndarray, capacity: int, rounds: int = 6) -> np.ndarray:
    """Trades loose pieces (bin -1) for one or two smaller placed ones of a bin that they fill better; changes bins, gives the loose ones then."""
    for _ in range(rounds):
        if not len(loose):
            break
        loose = loose[np.argsort(sizes[loose], kind="stable")]
        placed = np.flatnonzero(bins >= 0)
        placed = placed[np.argsort(bins[placed], kind="stable")]
        own, count = bins[placed], np.bincount(bins[placed], minlength=n)
        slack = capacity - np.bincount(own, sizes[placed], n).astype(np.int64)
        # what may leave: single pieces, and pairs of pieces of one bin; what may come: single loose pieces, and pairs of near ones
        out_a, out_b = [placed], [np.full(len(placed), -1)]
        for step in range(1, PAIRED):
            same = np.flatnonzero((own[step:] == own[:-step]) & (count[own[step:]] <= PAIRED))
            out_a.append(placed[same])
            out_b.append(placed[same + step])
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        leaves = sizes[a] + np.where(b >= 0, sizes[b], 0)
        few = loose if len(loose) <= 256 else loose[np.linspace(0, len(loose) - 1, 256).astype(int)]
        i, j = np.triu_indices(len(few), 1)
        in_a, in_b = np.concatenate([loose, few[i]]), np.concatenate([np.full(len(loose), -1), few[j]])
        comes = sizes[in_a] + np.where(in_b >= 0, sizes[in_b], 0)
        order = np.argsort(comes, kind="stable")
        in_a, in_b, comes = in_a[order], in_b[order], comes[order]
        best = np.searchsorted(comes, leaves + slack[bins[a]], "right") - 1
        gain = np.where(best >= 0, comes[np.maximum(best, 0)] - leaves, 0)
        used_bin, used = np.zeros(n, bool), np.zeros(len(sizes), bool)
        gone: list[int] = []
        top = np.flatnonzero(gain > 0)
        top = top[np.lexsort((-gain[top], (slack[bins[a[top]]] - gain[top])))][: 8 * len(loose)]  # the fullest bins first
        for t in top.tolist():
            k, x, y = int(bins[a[t]]), int(in_a[best[t]]), int(in_b[best[t]])
            if k < 0 or used_bin[k] or used[x] or y >= 0 and used[y]:
                continue
            used_bin[k] = used[x] = True
            for z in (int(a[t]), int(b[t])):
                if z >= 0:
                    bins[z] = -1
                    gone.append(z)
            bins[x] = k
            if y >= 0:
                used[y] = True
                bins[y] = k
        if not gone:
            break
        loose = np.concatenate([loose[~used[loose]], np.array(gone, loose.dtype)])
    return loose


def crossover(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """a with a random half of b's well-filled bins, INJECTED at most, injected whole."""
    fill = np.bincount(b, sizes)
    good = np.flatnonzero(fill >= WELL * capacity)
    injected = np.zeros(len(fill), bool)
    injected[rng.permutation(good)[: min((len(good) + 1) // 2, INJECTED)]] = True
    injected = injected[b]
    if not injected.any():
        injected = (np.arange(len(fill)) == int(fill.argmax()))[b]
    hit = np.zeros(a.max() + 1, bool)
    hit[a[injected]] = True
    stay = ~hit[a]
    # some bins of a are dissolved besides: the emptiest, and one or two at random
    rest = np.bincount(a, sizes)
    rest[hit[: len(rest)] | (rest == 0)] = np.inf
    if np.isfinite(rest).any():
        stay &= ~np.isin(a, [int(rest.argmin()), *rng.choice(np.flatnonzero(np.isfinite(rest)), 2)])
    out = np.full(len(a), -1, np.int64)
    _, out[injected] = np.unique(b[injected], return_inverse=True)
    n = int(out.max()) + 1
    if stay.any():
        _, own = np.unique(a[stay], return_inverse=True)
        out[stay] = own + n
        n = int(out.max()) + 1
    loose = traded(sizes, out, n, np.flatnonzero(out < 0), capacity)
    placed = out >= 0
    room = (capacity - np.bincount(out[placed], sizes[placed], n)).astype(int).tolist()
    best_fit(sizes, loose[np.argsort(-sizes[loose], kind="stable")], out, room, capacity)
    return out


def bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins."""
    return max(math.ceil(sizes.sum() / capacity), int((2 * sizes > capacity).sum()))


def falling(sizes: np.ndarray, capacity: int) -> np.ndarray:
    return packed(sizes, np.argsort(-sizes, kind="stable"), capacity)


def evolve(sizes: np.ndarray, seeds: list[np.ndarray], capacity: int, seed: int) -> np.ndarray:
    """The best packing found from the given packings and fresh ones."""
    rng = np.random.default_rng(seed)
    least = bound(sizes, capacity)
    score = lambda p: fitness(sizes, p, capacity)
    people = [(score(p), k, p) for k, p in enumerate(seeds or [falling(sizes, capacity)])]
    while len(people) < START and min(people)[0][0] > least:
        jitter = 0.02 + 0.3 * rng.random()
        p = packed(sizes, np.argsort(-sizes * (1 + jitter * rng.random(len(sizes))), kind="stable"), capacity)
        people.append((score(p), len(people), p))
    born, still = len(people), 0
    while still < PATIENCE and min(people)[0][0] > least:
        people.sort()
        i, j = (int(min(rng.integers(0, len(people), 2))) for _ in range(2))
        before = people[0][0]
        for x, y in ((i, j), (j, i)):
            p = crossover(sizes, people[x][2], people[y][2], capacity, rng)
            people.append((score(p), born, p))
            born += 1
        people.sort()
        seen: set = set()  # the worst go, and twins
        people = [x for x in people if not (x[0] in seen or seen.add(x[0]))][:POPULATION]
        still = 0 if people[0][0] < before else still + 1
    return min(people)[2]


def _evolved(cut_pieces: DataFrame, shards: int, capacity: int) -> DataFrame:
    """rid, length, shard, bin, place, fill of the best packing of each shard."""
    own = cut_pieces.select("rid", "length", F.pmod(F.xxhash64("rid"), F.lit(shards)).alias("shard"))

    def places(of: pd.DataFrame) -> pd.DataFrame:
        of = of.sort_values(["bin", "rid"])
        by = of.groupby("bin")["length"]
        return of.assign(place=by.cumsum() - of["length"], fill=by.transform("sum"))

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rid")
        sizes = g["length"].to_numpy()
        bins = falling(sizes, capacity)
        return places(g.assign(bin=bins, open=len(np.unique(bins)) > bound(sizes, capacity)))[["rid", "length", "shard", "bin", "place", "fill", "open"]]

    def first(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rid")
        return g.assign(bin=evolve(g["length"].to_numpy(), [], capacity, int(g["island"].iloc[0])))[["rid", "length", "shard", "island", "bin"]]

    def later(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["guest", "rid"])
        home, guest = g[g["guest"] == 0], g[g["guest"] == 1]
        elite = evolve(home["length"].to_numpy(), [home["bin"].to_numpy(), guest["bin"].to_numpy()], capacity, 100 + int(home["island"].iloc[0]))
        return home.assign(bin=elite)[["rid", "length", "shard", "island", "bin"]]

    def best(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["island", "rid"])
        of = min((h for _, h in g.groupby("island")), key=lambda h: fitness(h["length"].to_numpy(), h["bin"].to_numpy(), capacity))
        return places(of)[["rid", "length", "shard", "bin", "place", "fill"]]

    found = "rid long, length long, shard long, bin long, place long, fill long"
    # a stated number of partitions is not merged: a shard is little data and much work
    fitted = cut(own.repartition(shards, "shard").groupBy("shard").applyInPandas(fit, found + ", open boolean"), "fitted")
    done = fitted.where("not open").drop("open")
    hard = fitted.where("open").select("shard").distinct().count()
    if not hard:
        return done
    kind = "rid long, length long, shard long, island int, bin long"
    islands = fitted.where("open").select("rid", "length", "shard", F.explode(F.array(*(F.lit(k) for k in range(ISLANDS)))).alias("island"))
    now = islands.repartition(hard * ISLANDS, "shard", "island").groupBy("shard", "island").applyInPandas(first, kind)
    for _ in range(EPOCHS - 1):
        both = now.withColumn("guest", F.explode(F.array(F.lit(0), F.lit(1))))
        both = both.withColumn("island", F.pmod(F.col("island") + F.col("guest"), F.lit(ISLANDS)).cast("int"))
        now = both.repartition(hard * ISLANDS, "shard", "island").groupBy("shard", "island").applyInPandas(later, kind)
    return done.union(now.groupBy("shard").applyInPandas(best, found))


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """cut_pieces (a written table with length and rid, a number of its own for each row) with sequence_id and offset."""
    rows = cut_pieces
    whole = rows.where(F.col("length") == capacity).select("rid", (F.col("rid") * 4 + 3).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = rows.where(F.col("length") < capacity)
    first = cut(_evolved(short, max(1, math.ceil(short.count() / shard)), capacity), "packed")
    poor = F.col("fill") < POOR * capacity
    name = lambda k: (F.col("shard") * (1 << 34) + F.col("bin") * 4 + k).alias("sequence_id")
    done = first.where(~poor).select("rid", name(0), F.col("place").alias("offset"))
    rest = first.where(poor).select("rid", "length")
    again = _evolved(rest, max(1, math.ceil(rest.count() / shard)), capacity).select("rid", name(1), F.col("place").alias("offset"))
    return rows.join(done.union(again).union(whole), "rid").drop("rid")


def packing(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of every document."""
    return pack(cut(pieces(docs, path, capacity).withColumn("rid", F.monotonically_increasing_id()), "pieces"), capacity)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing(table(spark, sf_dir, "documents"))
