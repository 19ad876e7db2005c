"""Values in texts, and texts by hashed words."""

import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows_of
from tessella.operators import automaton, nearest, retrieval


def held(values, texts, **kw):
    out = set()
    for part, finder in automaton.automata([v.encode() for v in values], **kw):
        out |= {(t, part[k].decode()) for t, k in finder.held([x.encode() for x in texts])}
    return out


def plain(values, texts):
    return {(k, v) for k, t in enumerate(texts) for v in values if v and v in t}


@pytest.mark.parametrize("depth, states", [(1, 3), (2, 9), (3, 40_000), (12, 30), (12, 40_000)])
def test_automata_find_what_contains_finds(depth, states):
    rng = random.Random(depth)
    word = lambda n, letters: "".join(rng.choices(letters, k=rng.randrange(n)))
    for letters in ("ab", "a张王\x00é", "abcdefgh "):
        values = [word(20, letters) for _ in range(60)] + [""]
        texts = [word(400, letters) for _ in range(30)] + ["", word(9_000, letters)]
        assert held(values, texts, depth=depth, states=states) == plain(values, texts)


def test_automata_read_overlaps_scripts_and_no_separators():
    values = ["he", "she", "hers", "欧阳", "欧阳修文", "12345678901234567", "345", "\x00"]
    texts = ["ushers", "患者欧阳修文来诊", "x12345678901234567x", "he\x00", "he", "rs", "欧", "阳"]
    assert held(values, texts) == plain(values, texts)


def test_automata_take_linear_time():
    rng = random.Random(1)
    values = ["".join(rng.choices("0123456789abcdef", k=24)) for _ in range(3_000)]
    text = "".join(rng.choices("0123456789abcdef", k=2_000_000))
    finders = automaton.automata([v.encode() for v in values])
    took = []
    for n in (500_000, 2_000_000):
        began = time.process_time()
        for _, f in finders:
            f.held([text[:n].encode()])
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 1


def test_contains_join(spark):
    texts = [(1, "患者欧阳修文来诊"), (2, "call 13800001111now"), (3, None), (4, ""), (5, "call 13800001111now"), (None, "欧阳"), (6, "x" * 70_000 + "needle" + "y" * 70_000)]
    truths = [("a", "欧阳"), ("b", "欧阳修文"), ("c", "13800001111"), ("d", ""), ("e", None), ("f", "needle"), ("g", "needle"), ("h", "absent")]
    left = spark.createDataFrame(texts, "id long, t string").repartition(3)
    right = spark.createDataFrame(truths, "kind string, v string").repartition(2)
    want = sorted(((i, k) for i, t in texts for k, v in truths if t and v and v in t), key=repr)
    for sent, group in ((10**6, 1), (0, 10), (0, 10**6)):
        got = retrieval.contains_join(left, "t", right, "v", sent, group)
        assert got.columns == ["id", "t", "kind", "v"] and sorted(((r["id"], r["kind"]) for r in got.collect()), key=repr) == want
    assert retrieval.contains_join(left, "t", right.where("kind in ('d', 'e')"), "v").count() == 0
    assert retrieval.contains_join(left.limit(0), "t", right, "v").count() == 0


def dense(queries, docs, k):
    import hashlib
    import re
    from collections import Counter

    def vector(t):
        n = Counter(hashlib.md5(w.encode()).digest()[-1] for w in re.findall(r"\w+", (t or "").lower()))
        norm = sum(v * v for v in n.values()) ** 0.5 or 1.0
        return {b: v / norm for b, v in n.items()}

    vectors = [(i, o, vector(t)) for i, o, t in docs]
    out = set()
    for q, t in queries:
        v = vector(t)
        scored = sorted((-round(sum(w * d.get(b, 0) for b, w in v.items()), 9), o, i) for i, o, d in vectors)
        out |= {(q, i, r, -s) for r, (s, o, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("k", [1, 3, 50])
def test_indexed_retrieval_equals_dense(spark, k):
    rng = random.Random(k)
    words = ["胸部", "气胸", "肺炎，", "pneumo", "café", "heart", "size", "左侧。", "x_1", "Ⅳ", "３", "́a", "of"] + [f"w{n}" for n in range(40)]
    text = lambda n: " ".join(rng.choices(words, k=rng.randrange(n)))
    docs = [(f"d{n}", n * 7 % 60, text(30)) for n in range(60)] + [("same", 99, "heart size"), ("twin", 98, "heart size"), ("none", 97, None)]
    queries = [(n, text(12)) for n in range(25)] + [(77, ""), (78, None), (79, "heart size"), (80, "气胸，左侧。")]
    got = retrieval.top_k_words(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(docs, "doc_id string, ord long, text string").repartition(3), k, 9)
    assert {(r["query_id"], r["doc_id"], r["rank"], r["sim"]) for r in got.collect()} == dense(queries, docs, k)


@pytest.mark.parametrize("sent", [10**7, 5_000])
def test_words_are_scored_without_pairing_postings(spark, sent):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(3_000)}" for _ in range(n))
    docs = [(n, n % 100, text(rng.choice((20, 400)))) for n in range(300)]
    docs += [(1_000 + n, 1_000 + n, docs[7][2]) for n in range(30)]
    docs = [(i, k, t) for k, (i, _, t) in enumerate(docs)]
    queries = [(n, text(40)) for n in range(20)] + [(50, docs[7][2])]
    got = retrieval.top_k_words(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, ord long, text string").repartition(3), 5, 9, sent, 100_000)
    assert {(r["query_id"], r["doc_id"], r["rank"], r["sim"]) for r in got.collect()} == dense(queries, docs, 5)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def by_pairs(queries, docs, k, digits):
    """Every pair through Spark's own sums and rounding."""
    sim = retrieval.dot(F.col("q"), F.col("d"))
    pairs = queries.crossJoin(docs).withColumn("sim", sim if digits is None else F.round(sim, digits))
    best = Window.partitionBy("query_id").orderBy(F.desc("sim"), "ord")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "doc_id", "sim", "rank")


@pytest.mark.parametrize("digits, sent", [(6, 10**7), (2, 10**7), (2, 500), (None, 10**7), (None, 500)])
def test_top_k_equals_every_pair(spark, monkeypatch, digits, sent):
    monkeypatch.setattr(nearest, "DOCS", 7)
    monkeypatch.setattr(nearest, "QUERIES", 5)
    rng = random.Random(digits)
    some = lambda n: [round(rng.uniform(-2, 2), rng.choice((0, 1, 2, 17))) for _ in range(n)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [1.0, None, 2.0], [nan, 0.0, 1.0], [inf, 1.0, 1.0], [-inf, 1.0, 0.0], [1e200, -1e200, 3.0], [-0.0, 0.0, 0.0], [1.0, 2.0], [0.0625, 0.125, 0.005], [1e11, 1e-5, 1.0]]
    vectors = odd + [some(3) for _ in range(60)] + [[0.5, 0.25, 0.125]] * 20
    docs = spark.createDataFrame([(f"d{n}", 200 - n, v) for n, v in enumerate(vectors)], "doc_id string, ord long, d array<double>").repartition(3)
    queries = spark.createDataFrame([(n, v) for n, v in enumerate(odd + [some(3) for _ in range(9)] + [some(4)])], "query_id long, q array<double>")
    for k in (1, 4, 100):
        got = retrieval.top_k(queries, docs, k, digits, sent, 1_000)
        assert rows_of(got.withColumn("sim", F.col("sim").cast("string"))) == rows_of(by_pairs(queries, docs, k, digits).withColumn("sim", F.col("sim").cast("string")))
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
