"""Operators 4, 6, 7, 8, 9, 10 and the pipeline: edge cases and brute force."""

import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF, assert_same, rows_of
from tessella.llm import covertree, jaccard, kneserney, mixing, packing, simhash, warc
from tessella.llm.common import row_key
from tessella.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def roots(n, links):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


# --- 4


def test_top_k_against_sql(spark):
    assert_same(covertree.op4_cover_tree_topk(spark, SF), covertree.ORACLE)


def test_top_k_cases(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [0.5]), (40, [-1.0, 0.25]), (None, [1.0, 1.0]), (60, [0.5])]
    path = tmp_path / "embeddings.parquet"
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("v", F.lit(2)).write.parquet(str(path))
    got = {}
    for r in covertree.op4_cover_tree_topk(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {20: [(1, 4096), (2, 4096), (40, -4096)], 40: [(1, -4096), (2, -4096), (20, -4096)], 60: [(7, 1024)]}


@pytest.mark.parametrize("spread", [0.0, 0.05, 3.0])
def test_dual_trees_prune_nothing_they_need(spread):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 10, (12, 5))
    x = np.floor(centres[rng.integers(0, 12, 1500)] + rng.normal(0, spread, (1500, 5)))
    ids = rng.permutation(1500)
    s, i, _, made = covertree.search(x[:90], ids[:90], x, ids, 7, leaf=20)
    exact = x[:90] @ x.T
    for k in range(90):
        order = sorted((j for j in range(1500) if ids[j] != ids[k]), key=lambda j: (-exact[k, j], ids[j]))[:7]
        assert list(i[k]) == [ids[j] for j in order] and list(s[k]) == [exact[k, j] for j in order]
    if spread == 0.05:
        assert made < 0.7 * len(covertree.leaves(covertree.build(x, 20))) * len(covertree.leaves(covertree.build(x[:90], 20)))


def test_blocks_of_queries_and_data_agree(spark, monkeypatch):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("double")).alias("v"))
    whole = rows_of(covertree.top_k(v, F.col("vec_id") % 20 == 0, 5))
    monkeypatch.setattr(covertree, "QUERY_BLOCK", 7)
    monkeypatch.setattr(covertree, "DATA_BLOCK", 30)
    monkeypatch.setattr(covertree, "CELL", 60)
    assert rows_of(covertree.top_k(v, F.col("vec_id") % 20 == 0, 5)) == whole


def test_pairs_of_far_cells_never_meet(spark, monkeypatch):
    monkeypatch.setattr(covertree, "CELL", 40)
    monkeypatch.setattr(covertree, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 40, (10, 6))
    x = np.floor(centres[np.arange(600) // 60] + rng.normal(0, 0.5, (600, 6)))
    rows = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, v array<double>")
    ready = rows.selectExpr("vec_id", "v", "size(v) AS dim", "vec_id % 20 = 0 AS query")
    _, asked, pairs = covertree.dealt(ready, 5)
    every = asked.select("block", "piece").distinct().count() * 64  # cells of the tree
    assert pairs.count() < 0.3 * every
    got = {}
    for r in covertree.top_k(rows, F.col("vec_id") % 20 == 0, 5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    for q in range(0, 600, 20):
        want = sorted(((-float(x[q] @ x[k]), k) for k in range(600) if k != q))[:5]
        assert [got[q][i + 1] for i in range(5)] == [(-s, k) for s, k in want]


# --- 6


def brute_fingerprint(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.mark.parametrize("t", ["", "a", "a b c", "A b\tc\nD", "a b c d e", "É é b c d", "x y z w " * 3])
def test_fingerprint(t):
    assert simhash.fingerprint(t.encode()) == brute_fingerprint(t)


def test_near_duplicates_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fp = {k: brute_fingerprint(t) for k, t in docs.items()}
    ids = sorted(fp)
    want = roots(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fp[ids[a]] ^ fp[ids[b]]).bit_count() <= 4])
    got = {r["doc_id"]: r for r in simhash.op6_simhash_neardup(spark, SF).collect()}
    assert all(got[k]["fingerprint"] == f"{fp[k]:016x}" and got[k]["component_id"] == ids[want[i]] for i, k in enumerate(ids))


@pytest.mark.parametrize("groups, hot", [(5, 10**6), (6, 10**6), (7, 10**6), (5, 40)])
def test_grid_finds_every_link(spark, groups, hot):
    rng = np.random.default_rng(groups)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(0, 6)), replace=False)) for b in base for _ in range(6)]
    fp = sorted({*map(int, base), *near, 0, (1 << 64) - 1})
    signed = [x - (1 << 64) if x >> 63 else x for x in fp]
    want = roots(len(fp), [(a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 4])
    found = components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), groups, hot)).collect()
    of = {r["node"]: r["root"] for r in found}
    mine = [of.get(x, x) for x in signed]
    assert len({*zip(want, mine)}) == len(set(want)) == len(set(mine))


def test_embedding_is_a_lower_bound():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 64, (2, 500), np.uint64)
    counts = lambda x: np.array([[int(v) >> 2 * k & 1 | 0 for k in range(32)] for v in x]) + np.array([[int(v) >> 2 * k + 1 & 1 for k in range(32)] for v in x])
    distance = simhash.manhattan(simhash.embedded(a), simhash.embedded(b))
    assert (distance == np.abs(counts(a) - counts(b)).sum(1)).all() and (distance <= np.bitwise_count(a ^ b)).all()


def test_components_of_chains_and_hubs(spark):
    links = [(k, k + 1) for k in range(100, 140)] + [(0, k) for k in range(1, 60)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{k: 100 for k in range(100, 141)}, **{k: 0 for k in range(60)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each_group_stays(spark):
    long = " ".join(f"w{k}" for k in range(300))
    rows = [(5, long, "en", "s", 1), (3, long + " tail", "en", "s", 1), (3, long + " tail", "en", "s", 1), (None, long, "en", "s", 1), (9, "other words entirely here", "en", "s", 1), (8, None, "en", "s", 1), (7, " ", "de", None, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for c in ("row", "fp", "key", "root", "own_row", "kept_id", "kept_row", "tessella_row", "first", "a.b"):
        docs = docs.withColumn(c, F.lit(7))
    docs = docs.withColumn("tags", F.create_map(F.lit("a"), F.col("doc_id")))
    out = simhash.without_near_duplicates(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [3, 7, 9] and {r["own_row"] for r in out.collect()} == {7}
    nulls = spark.createDataFrame([(1, "a b", None, "en", 1), (1, "a b", "en", None, 1)], DOCS)  # the same values, at other places
    assert len(simhash.without_near_duplicates(nulls).collect()) == 1 and len({r[0] for r in nulls.select(row_key(nulls)).collect()}) == 2
    assert {r["component_id"] for r in simhash.near_duplicates(docs.where("doc_id is null")).collect()} == {None}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def five_words(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute_jaccard(rows):
    """Ids (sorted) and roots of the texts with five-word Jaccard of 0.8 or more."""
    ids = sorted(rows)
    s = [five_words(rows[k]) for k in ids]
    near = [(a, b) for a in range(len(ids)) for b in range(a) if 5 * len(s[a]) >= 4 * len(s[b]) and 4 * len(s[a]) <= 5 * len(s[b]) and 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b])]
    return ids, roots(len(ids), near)


@pytest.mark.parametrize("hot, mins", [(jaccard.HOT_ROWS, jaccard.MINS), (3, 1)])
def test_stage_keeps_one_of_each_jaccard_group(spark, monkeypatch, hot, mins):
    monkeypatch.setattr(jaccard, "MINS", mins)
    rng = np.random.default_rng(8)
    common = [f"c{k}" for k in range(40)]
    rows = {}
    for g in range(12):
        base = [f"v{x}" for x in rng.integers(0, 400, int(rng.integers(30, 200)))] + common
        for edits in (0, 0, 1, 2, 3, 4, 5, 6):
            w = list(base)
            for at in rng.choice(len(w), edits, replace=False):
                w[at] = f"new{rng.integers(0, 10**6)}"
            rows[len(rows)] = " ".join(w)
    many = [f"m{k}" for k in range(120)]
    for k in range(80):  # one large group
        rows[len(rows)] = " ".join(many[: 60 + k // 20] + [f"x{k}"] + many[60 + k // 20 :])
    for t in ("", None, " ", "a b", "A  b", "a b c", "a b c d e", "a b c d e f"):
        rows[len(rows)] = t
    ids, want = brute_jaccard(rows)
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows.items()], DOCS)
    assert {r["doc_id"] for r in simhash.without_near_duplicates(docs, hot).collect()} == {ids[r] for r in want}
    apart = [simhash.fingerprint((rows[k] or "").encode()) ^ simhash.fingerprint((rows[ids[r]] or "").encode()) for k, r in zip(ids, want)]
    assert sum(x.bit_count() > 4 for x in apart) > 10  # pairs that four SimHash bits don't reach


def test_histograms_bound_what_sets_share():
    rng = np.random.default_rng(6)
    for size in (1, 30, 3_000, 60_000):
        a = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
        b = np.unique(np.concatenate([a[: size // 2], rng.integers(0, 1 << 63, size, np.uint64)]))
        h = [np.frombuffer(jaccard.histogram(x), np.uint8) for x in (a, b)]
        assert all(len(x) == jaccard.BUCKETS + 1 for x in h) and len(np.intersect1d(a, b)) <= jaccard.may_share(h[0], np.stack([h[1]]))[0]


def test_stage_against_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ids, want = brute_jaccard({r["doc_id"]: r["text"] for r in docs.collect()})
    assert sorted(r["doc_id"] for r in corpus_pipeline.without_copies(spark, docs, "").collect()) == sorted({ids[r] for r in want})
    assert corpus_pipeline.without_copies(spark, docs.limit(0), "").count() == 0


# --- 7


def test_mix_against_sql(spark):
    assert_same(mixing.op7_source_mixing(spark, SF), mixing.ORACLE)


def test_mix_cases(spark):
    rows = [(1, "a b c", "en", "x", 0), (2, None, "en", "x", 0), (3, "w " * 5000, "en", "y", 0), (4, "v " * 900, "en", None, 0), (4, "v " * 900, "en", None, 0), (None, "u " * 300, "en", "z", 0), (6, "", "en", "empty", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("idx", F.lit(0)).withColumn("block", F.lit(0))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in got)
    target = {r["source_size"]: r["target"] for r in got}
    sizes = {"empty": 0, "x": 3, "y": 5000, "z": 300, None: 1800}
    # by code point, null last: empty 1, x 2, y 3, z 1, null 2; capped ones stop at three times their size
    left = sum(sizes.values()) - 9 - 900
    assert target[0] == 0 and target[3] == 9 and target[300] == 900 and target[5000] == pytest.approx(left * 3 / 5) and target[1800] == pytest.approx(left * 2 / 5)
    by = {}
    for r in got:
        by[r["source_size"]] = by.get(r["source_size"], 0) + r["taken"]
    assert all(abs(by[s] - t) <= mixing.BLOCK for s, t in target.items())
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and sum(len((r["text"] or "").split()) for r in out.collect()) == sum(by.values())
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_shards_draw_all_slots_and_epochs_are_permutations(spark):
    own = mixing.sized(spark.read.parquet(f"{SF}/documents.parquet"))
    sources = mixing.plan_sources(own, 16).cache()
    placed = mixing.placements(sources, 64).collect()
    quota = {r["idx"]: r["slots"] for r in sources.collect()}
    n = sum(quota.values())
    assert {k: sum(r["idx"] == k for r in placed) for k in quota} == quota  # every source has its quota
    blocks = {r["idx"]: r["blocks"] for r in sources.collect()}
    for (idx, epoch), group in itertools.groupby(sorted(placed, key=lambda r: (r["idx"], r["epoch"])), key=lambda r: (r["idx"], r["epoch"])):
        b = [r["block"] for r in group]
        assert len(set(b)) == len(b) and max(b) < blocks[idx]
        assert len(b) == blocks[idx] or epoch == quota[idx] // blocks[idx]
    in_shard = {}
    for r in placed:
        in_shard[r["shard"]] = in_shard.get(r["shard"], 0) + 1
    assert all(in_shard[s] == min(64, n - 64 * s) for s in in_shard) and len(in_shard) == math.ceil(n / 64)


def test_shard_counts_are_multinomial(spark):
    sources = spark.createDataFrame([(k, 20_000, 40_000 * (k + 1), 40_000 * (k * (k + 1) // 2)) for k in range(4)], "idx long, blocks long, slots long, before long")
    total = 400_000
    counts = np.zeros((400, 4))
    for r in mixing.shard_counts(sources, total, 1_000).collect():
        counts[r["shard"], r["idx"]] = r["n"]
    assert (counts.sum(1) == 1_000).all()
    p = np.arange(1, 5) / 10
    assert np.abs(counts.mean(0) - 1_000 * p).max() < 4 * np.sqrt(1_000 * 0.25 / 400)
    assert np.allclose(counts.var(0), 1_000 * p * (1 - p), rtol=0.4)  # no lattice: the variance is the multinomial one
    assert abs(np.corrcoef(counts[:-1, 0], counts[1:, 0])[0, 1]) < 0.2


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 997])
def test_permutations_are_one_to_one_and_mix(spark, n):
    rows = spark.range(n).selectExpr("id AS x", f"CAST({n} AS LONG) AS n", "CAST(5 AS LONG) AS which")
    got = [r["y"] for r in mixing.permuted(rows, "x", "n", "which", "y").orderBy("x").collect()]
    assert sorted(got) == list(range(n))
    if n > 900:
        steps = np.diff(got) % n
        assert len(set(steps)) > n / 3  # no stride


# --- 8


def test_tokens_are_those_of_the_tokenizer(monkeypatch):
    e = packing.Encoder(packing.tokenizer_path())
    odd = ["it's <|endoftext|> x", "ÀÉ Ünï.", "a b  \x1c c a\x0bb", "", "12,3 $%&*'", "\u200b \u200bzz", "ΑΣ ΣΑΣ.", "İi", "e\u0301 \u0301a ﬁ", "x" * 5000, "Ab,. c!? d", "中文 字 ，", "don't we'll", "(ab)...", "'sab '", "ab&&& **", "-x-"]
    ids, at = e.encode(pa.array([*odd, None]))
    for k, t in enumerate(odd):
        assert e.whole.encode(t, add_special_tokens=False).ids == ids[at[k] : at[k + 1]].tolist(), t
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)  # words pass through both generations of the cache
    few = [random.Random(k).choice(odd[0].split() + odd[-4].split() + ["again"]) for k in range(60)]
    for k in range(0, 60, 5):
        assert e.encode(pa.array([" ".join(few[k : k + 5])]))[0].tolist() == e.whole.encode(" ".join(few[k : k + 5]), add_special_tokens=False).ids
    assert len(e.parts.young) + len(e.parts.old) <= 40
    assert e.encode(pa.array(["again"]))[0].tolist() == e.whole.encode("again", add_special_tokens=False).ids


def test_packing(spark):
    rows = [(k, "word " * n, "en", "s", 0) for k, n in enumerate([0, 1, 2047, 2048, 5000, 300, 300, 700, 1500, 40])] + [(3, None, "en", "s", 0), (None, "x", "en", "s", 0), (5, "word " * 300, "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("rid", F.lit(1)).withColumn("offset", F.lit(1))
    got = packing.packing(docs).collect()
    assert sorted(r["length"] for r in got if r["doc_id"] == 4) == [905, 2048, 2048] and sum(r["length"] for r in got) == sum(len((r[1] or "").split()) + 1 for r in rows)
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(seqs) == 7  # four full ones; 1501, 905, 701 and three of 301 don't fit in two
    one = next(r for r in got if r["doc_id"] == 1)
    e = packing.Encoder(packing.tokenizer_path())
    assert one["ids_crc32"] == zlib.crc32(np.array([*e.whole.encode("word", add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert packing.packing(docs.limit(0)).count() == 0


def test_packing_of_all_documents_against_the_tokenizer(spark):
    """Every document of sf0.01: ids, cuts and digests by the tokenizer itself, sequences without gaps, as few as the tokens allow."""
    sf = "/root/testdata/sf0.01"
    tokenizer, want = packing.Encoder(packing.tokenizer_path()).whole, {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for k, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[r["doc_id"], k] = (start, len(part), zlib.crc32(part.tobytes()))
    got = packing.op8_packing(spark, sf).collect()
    assert len(got) == len(want) and {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    filled = {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(filled) == packing.bound(np.array([n for _, n, _ in want.values()]), 2048)


def test_crossover_keeps_every_piece_and_evolution_never_worsens():
    rng = np.random.default_rng(7)
    sizes = rng.integers(50, 1400, 400)
    a, b = (packing.packed(sizes, np.argsort(-sizes * (1 + 0.2 * rng.random(400))), 2048) for _ in range(2))
    child = packing.crossover(sizes, a, b, 2048, rng)
    assert (child >= 0).all() and np.bincount(child, sizes).max() <= 2048
    bfd = packing.packed(sizes, np.argsort(-sizes, kind="stable"), 2048)
    assert packing.fitness(sizes, packing.evolve(sizes, [], 2048, 1), 2048) <= packing.fitness(sizes, bfd, 2048)


def triplets(n, capacity, seed):
    """Pieces of which three fill a sequence exactly: best fit wastes room, n sequences are enough."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        a = int(rng.integers(int(0.38 * capacity), int(0.49 * capacity)))
        b = int(rng.integers(int(0.25 * capacity), (capacity - a) // 2 + 1))
        out += [a, b, capacity - a - b]
    return np.array(out)


@pytest.mark.parametrize("n", [20, 40, 83])
def test_evolution_gains_where_best_fit_wastes_room(n):
    sizes = triplets(n, 1000, n)
    bins = packing.evolve(sizes, [], 1000, 1)
    used = len(np.unique(bins))
    assert np.bincount(bins, sizes).max() <= 1000 and n <= used <= n + 2 < len(np.unique(packing.falling(sizes, 1000)))


def test_evolution_against_all_packings_of_few_pieces():
    def least(sizes, capacity):
        def place(k, room):
            if k == len(sizes):
                return len(room)
            options = {r: i for i, r in enumerate(room) if r >= sizes[k]}
            return min([place(k + 1, [*room, capacity - sizes[k]])] + [place(k + 1, [*room[:i], r - sizes[k], *room[i + 1 :]]) for r, i in options.items()])

        return place(0, [])

    rng = np.random.default_rng(3)
    for k in range(40):
        sizes = rng.integers(15, 60, 8)
        assert len(np.unique(packing.evolve(sizes, [], 100, k))) == least(sizes.tolist(), 100)


def test_hard_shards_are_evolved_on_islands(spark):
    sizes = triplets(40, 2048, 5)
    rows = spark.createDataFrame([(k, int(n)) for k, n in enumerate(sizes)], "rid long, length long").selectExpr("rid", "length", "rid AS own")
    got = packing.pack(rows).collect()
    fill = {}
    for r in got:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(r["own"] for r in got) == list(range(120)) and len(fill) <= 42 < len(np.unique(packing.falling(sizes, 2048)))
    for parts in fill.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048


# --- 9


def brute_model(texts, order):
    """Interpolated modified Kneser-Ney in plain dictionaries, padded with order - 1 starts."""
    grams = {k: {} for k in range(1, order + 1)}
    for t in texts:
        s = (0,) * (order - 1) + tuple(int(c) for c in kneserney.classes(t))
        for i in range(order - 1, len(s)):
            g = s[i - order + 1 : i + 1]
            grams[order][g] = grams[order].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        for g in grams[k + 1]:
            grams[k][g[1:]] = grams[k].get(g[1:], 0) + 1

    def discounts(k):
        c = [sum(1 for n in grams[k].values() if n == j) for j in range(5)]
        y = c[1] / max(c[1] + 2 * c[2], 1)
        return [max(0.1, min(j - 0.05, j - (j + 1) * y * c[j + 1] / max(c[j], 1))) for j in (1, 2, 3)]

    ds = {k: discounts(k) for k in grams}

    def p(g):
        if not g:
            return 1 / 4096
        k, ctx = len(g), g[:-1]
        own = {x: n for x, n in grams[k].items() if x[:-1] == ctx}
        if not own:
            return p(g[1:])
        total = sum(own.values())
        d = lambda n: ds[k][min(n, 3) - 1]
        n = own.get(g, 0)
        return (n - d(n) if n else 0) / total + sum(map(d, own.values())) / total * p(g[1:])

    def ppl(t):
        s = (0,) * (order - 1) + tuple(int(c) for c in kneserney.classes(t))
        logs = [math.log(p(s[i - order + 1 : i + 1])) for i in range(order - 1, len(s))]
        return math.exp(-sum(logs) / len(logs))

    return ppl


@pytest.mark.parametrize("rows", [10**6, 50])
def test_perplexity_against_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(kneserney, "SHARD_ROWS", rows)
    monkeypatch.setattr(kneserney, "SALTS", 2)
    texts = ["the cat sat on the mat", "a cat and a dog", "the dog sat", "mats and cats and dogs"]
    path, shards = kneserney.write_shards(kneserney.model(spark.createDataFrame([(t, "=en") for t in texts], "text string, lang string")))
    ppl = brute_model(texts, kneserney.ORDER)
    asked = ["the cat sat", "zzz ###", "dog mat", "中文 the", "the cat sat"]
    made = kneserney.Classifier(path, shards, {})
    docs = spark.createDataFrame([(t, "en") for t in asked] + [("a b", "xx"), ("a b", None), ("", "en"), ("a", "en"), (None, "en")], "text string, lang string").coalesce(1)
    batch = docs.toArrow().combine_chunks().to_batches()[0]
    want = pytest.approx([ppl(t) for t in asked], rel=1e-5)
    answers = made.resolved(docs)
    loaded = []
    with monkeypatch.context() as m:  # every n-gram of the batch was resolved by the join
        m.setattr(kneserney, "load", lambda *x: loaded.append(x) or kneserney.Shard(np.zeros(0, np.uint64), np.zeros(0)))
        got = made.perplexities(batch, 0, 1, answers)
    assert got[: len(asked)].tolist() == want and np.isnan(got[len(asked) :]).all()
    other = made.perplexities(batch.slice(0, 3), 0, 1, answers)  # a batch that no one asked for
    assert other.tolist() == pytest.approx([ppl(t) for t in asked[:3]], rel=1e-9)
    assert (rows == 50) == (shards > 1)


def test_batches_come_back_whole(spark, monkeypatch):
    monkeypatch.setattr(kneserney, "SHARD_ROWS", 8_000)
    monkeypatch.setattr(kneserney, "SALTS", 2)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    many = {r["doc_id"]: r for r in kneserney.classify(docs, kneserney.train(docs, labels)).collect()}
    monkeypatch.setattr(kneserney, "SHARD_ROWS", 10**7)
    one = {r["doc_id"]: r for r in kneserney.classify(docs.repartition(3), kneserney.train(docs, labels)).collect()}
    assert len(many) == len(one) == docs.count()
    for k, r in one.items():
        assert many[k]["kept"] == r["kept"] and (many[k]["perplexity"] is None) == (r["perplexity"] is None)
        assert r["perplexity"] is None or many[k]["perplexity"] == pytest.approx(r["perplexity"], rel=1e-6)


def test_packed_keys():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 60, 5000, np.uint64))
    assert (kneserney.unpacked_keys(kneserney.packed_keys(keys)) == keys).all()


def test_thresholds_against_brute_force(spark):
    rng = np.random.default_rng(4)
    held = {"=en": rng.normal(2, 0.2, 400), "=de": rng.normal(3, 0.1, 60), "": rng.normal(2.5, 0.1, 3)}
    got = kneserney.thresholds(spark.createDataFrame([(k, float(x)) for k, xs in held.items() for x in xs], "lang string, ppl double"), 0.95)
    at = lambda xs: sorted(xs)[math.ceil(0.95 * len(xs)) - 1]
    assert got["=en"] == pytest.approx(math.exp(at(held["=en"]))) and got["=de"] == pytest.approx(math.exp(at(held["=de"])))
    assert got[""] == pytest.approx(math.exp(held[""].mean() + at([x - xs.mean() for xs in held.values() for x in xs])))  # too few of its own
    assert kneserney.thresholds(spark.createDataFrame([], "lang string, ppl double"), 0.95) == {}


def test_junk_goes_and_clean_stays(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("etaoinsrhl"), 5)) for _ in range(80)]
    say = lambda n: " ".join(rng.choice(words, n))
    rows = [(k, say(60), "en", "s", 0) for k in range(120)] + [(500, "#$% &*( @!" * 20, "en", "s", 0), (501, None, "en", "s", 0), (502, "x", None, "s", 0), (503, "#$% ##", "xx", "s", 0), (504, say(4000), "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("ppl", F.lit(1)).withColumn("h", F.lit(1))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(120)] + [(77777, 1, 0)], "doc_id long, quality int, toxic int")
    model = kneserney.train(docs, labels)
    got = {r["doc_id"]: r["kept"] for r in kneserney.classify(docs, model).collect()}
    assert not got.pop(500) and all(got.values())
    assert kneserney.kept_only(docs, model).count() == len(rows) - 1
    assert all(r["kept"] for r in kneserney.classify(docs, kneserney.train(docs, labels.limit(0))).collect()) and kneserney.classify(docs.limit(0), model).count() == 0


# --- 10


def test_warc_against_sql(spark):
    assert_same(warc.op10_warc(spark, SF), warc.ORACLE)


def test_warc_cases(spark, tmp_path):
    big = "é" * 800
    rows = [(1, "http://a.com/x", big), (1, "http://a.com/x", big), (2, None, big), (None, "http://a.com/x\n ü", None), (5, "ftp", ""), (3, "http://a.com/x", "y" * 1000), (9, "http://b.a.com/x", "y" * 1000), (10, "http://c.com", "z" * 999), (11, "http://c.com", "z" * 999), (12, "http://c.com", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("key", F.lit(1))
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    from conftest import oracle

    for t in ("region nation customer supplier part orders lineitem events documents embeddings benchmark labels conversations".split()):
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    want = oracle(warc.ORACLE, str(tmp_path))[1]
    assert rows_of(warc.read_back(warc.write_archive(pages, block_lines=2, file_bytes=500), pages)) == want
    assert warc.read_back(warc.write_archive(pages.limit(0)), pages.limit(0)).count() == 0


def test_warc_lookup(spark):
    pages = spark.createDataFrame([(k, f"http://h{k % 7}.com/{k}", f"page {k}") for k in range(100)], "page_id long, url string, html string")
    reader = warc.Reader(warc.write_archive(pages, block_lines=5))
    assert len(reader.rows) >= 20
    for k in (0, 41, 99):
        (line,) = reader.lines(warc.entry_key(f"http://h{k % 7}.com/{k}", k))
        assert reader.get(line)["payload"] == f"page {k}".encode()
    assert list(reader.lines(warc.entry_key("http://none.com", 1))) == []
    assert warc.url_key("http://www.A.com/x?q") == "com,a,www)/x?q"


def test_salted_groups_equal_broadcast_ones(spark, monkeypatch):
    pages = spark.createDataFrame([(k, "u", "p" * 1500 if k % 3 else f"{k}" * 800) for k in range(60)], "page_id long, url string, html string")
    small = rows_of(warc.marked(pages).drop("payload"))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert rows_of(warc.marked(pages).drop("payload")) == small


# --- pipeline


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = {r["doc_id"] for r in docs.collect()}
        docs = stage(spark, docs, sf).cache()
        after = {r["doc_id"] for r in docs.collect()}
        assert docs.columns == columns and after < before
        gone = before - after
        if name == "neardup":  # exactly one of each brute-force group
            ids, want = brute_jaccard({k: texts[k] for k in before})
            assert after == {ids[r] for r in want}
        else:
            field, bad = ("toxic", 1) if name == "toxicity" else ("quality", 0)
            known = [labels[k][field] == bad for k in gone if k in labels]
            assert np.mean(known) > 0.8
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, sf).cache()
    want = sum(r["taken"] for r in mixing.mix(docs).collect())
    assert mixed.columns == columns and sum(len((r["text"] or "").split()) for r in mixed.collect()) == want
    assert all(set(r["text"].split()) <= set(texts[r["doc_id"]].split()) for r in mixed.collect()) and n
    # run() gives the pieces that a plain loop over the mixed documents makes
    whole = packing.Encoder(packing.tokenizer_path()).whole
    plain = []
    for r in mixed.collect():
        ids = [*whole.encode(r["text"], add_special_tokens=False).ids, 0]
        plain += [(r["doc_id"], k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    ran = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in ran) == sorted(plain)
    fill = {}
    for r in ran:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= math.ceil(sum(fill.values()) / 2048) + 2
