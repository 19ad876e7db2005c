"""Operator 5, toxicity: a counterfactual-regularised linear classifier.

Features are the presence of words and of word beginnings (2 to 6 letters, lower case, outer punctuation stripped), so
inflected and compounded insults are seen too. A logistic model over the most telling features is fitted to labelled
texts. Identity terms are swapped for others of their group in each labelled text that holds one, and the squared change
of the score (before the sigmoid) is penalised; every term alone is also paired with its group's next term and with no
term at all, so a neutral mention of a group carries no weight whether or not the labels are biased. Word dropout makes
each insult count by itself.

The fit reads a bounded sample: at most SAMPLE labelled texts of each class, those with the smallest hash; the
intercept is moved to the prior of all labels in the training fold. Scoring covers every whole text.

Defined cases: null or empty text gets the score of no feature. Without labels of both classes the model has no
features and its score is the labels' prior (0 without labels). A null doc_id is held out and never labelled. Repeated
rows are scored alike; labels that repeat count each time; null labels are ignored. Extra columns are ignored. Empty
tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_arrow, slices, table, trim

SAMPLE = 4_000
FEATURES = 4_000
FOLDS = 5
#: Letters of a word beginning, and of the longest word that is a feature.
BEGINNINGS, LONGEST = range(2, 7), 40
PENALTY, RIDGE, KEEP = 4.0, 3e-4, 0.35
STRIP = ".,;:!?\"'()[]{}«»“”„…-–|"
#: Terms of one line may stand for each other.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners", "citizens"),
    ("disabled", "deaf", "blind", "autistic", "old", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus"),
    ("ausländer", "flüchtlinge", "einheimische", "migranten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
)
SWAP = {w: line[(k + 1) % len(line)] for line in IDENTITIES for k, w in enumerate(line)}


def word_features(word: str) -> list[str]:
    """Features of one word: itself and its beginnings."""
    w = word.lower().strip(STRIP)
    return [f"={w}"] * (0 < len(w) <= LONGEST) + [f"^{w[:k]}" for k in BEGINNINGS if k <= len(w)]


class Words:
    """The words of a column of texts: of which text and which of the different words each one is."""

    def __init__(self, texts: pa.Array):
        split = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
        coded = pc.dictionary_encode(split.flatten())
        self.n = len(texts)
        self.text = np.repeat(np.arange(self.n), pc.list_value_length(split).to_numpy())
        self.code = coded.indices.to_numpy()
        self.words = pc.utf8_trim(coded.dictionary, STRIP)

    def parts(self) -> Iterator[tuple[str, np.ndarray, pa.Array]]:
        """Each kind of feature: its mark, which different words have one, and their names without the mark."""
        size = pc.utf8_length(self.words).to_numpy()
        for mark, k in [("=", 0), *(("^", k) for k in BEGINNINGS)]:
            has = np.flatnonzero(size >= k if k else (size > 0) & (size <= LONGEST))
            own = self.words.take(pa.array(has))
            yield mark, has, pc.utf8_slice_codeunits(own, 0, k) if k else own

    def hits(self, names: "Names") -> np.ndarray:
        """texts x features: which of the named features each text has."""
        out = np.zeros((self.n, names.n + 1), bool)  # the last column takes what is not named
        for mark, has, own in self.parts():
            at = np.full(len(self.words), names.n, np.int64)
            at[has] = names.place(mark, own)
            out[self.text, at[self.code]] = True
        return out[:, :-1]

    def features(self) -> tuple[np.ndarray, pa.Array]:
        """Every text's different features: its number, and the feature's name."""
        texts, found = [np.zeros(0, np.int64)], [pa.array([], pa.string())]
        for mark, has, own in self.parts():
            coded = pc.dictionary_encode(own)
            at = np.full(len(self.words), -1, np.int64)
            at[has] = coded.indices.to_numpy()
            code = at[self.code]
            both = np.unique((self.text * (len(coded.dictionary) + 1) + code)[code >= 0])
            texts.append(both // (len(coded.dictionary) + 1))
            found.append(pc.binary_join_element_wise(mark, coded.dictionary.take(pa.array(both % (len(coded.dictionary) + 1))), ""))
        return np.concatenate(texts), pa.concat_arrays([x.cast(pa.string()) for x in found])


class Names:
    """Features by name, looked up a column at once."""

    def __init__(self, names: list[str]):
        self.n = len(names)
        self.of = {m: (pa.array([x[1:] for x in names if x[0] == m], pa.string()), np.array([k for k, x in enumerate(names) if x[0] == m] + [self.n], np.int64)) for m in "=^"}

    def place(self, mark: str, words: pa.Array) -> np.ndarray:
        """Number of each feature, n for those not named."""
        known, number = self.of[mark]
        return number[pc.fill_null(pc.index_in(words, value_set=known), len(known)).to_numpy()]


@dataclass
class Model:
    """Weights by feature; picklable and bounded by FEATURES."""

    weights: dict[str, float]
    intercept: float
    names: Names = field(init=False, repr=False)

    def __post_init__(self):
        self.names, self.vector = Names(list(self.weights)), np.array(list(self.weights.values()))

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Score of each text. Rounded before the sigmoid, so equal texts have equal scores wherever they stand."""
        z = np.zeros(len(texts))
        for a in range(0, len(texts), 250):
            z[a : a + 250] = Words(texts.slice(a, 250)).hits(self.names) @ self.vector
        return 1 / (1 + np.exp(-np.clip(np.round(z + self.intercept, 9), -700, 700)))


class Rows:
    """Sparse rows of ones; sums by row and by column are differences of running sums, so nothing is copied but the values."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.n, self.width = len(rows), width
        self.cols = np.concatenate([np.empty(0, np.int32), *(r.astype(np.int32) for r in rows)])
        self.ends = np.cumsum([len(r) for r in rows], dtype=np.int64)
        row = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.ends, prepend=0))
        self.by_col = row[np.argsort(self.cols, kind="stable")]
        self.col_ends = np.cumsum(np.bincount(self.cols, minlength=width))

    @staticmethod
    def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0.0], np.cumsum(values)])[ends]
        return np.diff(upto, prepend=0.0)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self._sums(w[self.cols], self.ends)

    def back(self, g: np.ndarray) -> np.ndarray:
        return self._sums(g[self.by_col], self.col_ends)


def fit(names: list[str], features: list[np.ndarray], swapped: list[np.ndarray | None], labels: np.ndarray, prior: float, penalty: float = PENALTY, seed: int = 11) -> Model:
    """names: of all features, those of the identity terms too; features: numbers of each text's; swapped: of its counterfactual's, if it has one; prior: share of label 1 where the texts were drawn."""
    pos, n = int(labels.sum()), len(labels)
    base = min(max(prior, 1e-6), 1 - 1e-6)
    if not 0 < pos < n:
        return Model({}, math.log(base / (1 - base)) if n else -50.0)
    joined = np.concatenate(features) if features else np.empty(0, np.int64)
    own = np.repeat(labels, [len(f) for f in features])
    ids, at = np.unique(joined, return_inverse=True)
    a = np.bincount(at, own, len(ids)) / pos
    b = np.bincount(at, 1 - own, len(ids)) / (n - pos)
    seen = np.bincount(at, minlength=len(ids))
    gain = np.where(seen >= 4, np.abs(a - b) / np.sqrt(a * (1 - a) / pos + b * (1 - b) / (n - pos) + 1.0 / n**2), 0)
    best = np.sort(ids[np.argsort(-gain, kind="stable")[:FEATURES]][: int((gain >= 3).sum())])
    number = {x: k for k, x in enumerate(names)}
    numbered = lambda w: np.unique([number[x] for x in word_features(w)])
    terms = [numbered(w) for w in SWAP]
    vocab = np.union1d(best, np.concatenate(terms))
    place = lambda f: np.searchsorted(vocab, f[np.isin(f, vocab)])
    placed = [place(f) for f in features]
    rng = np.random.default_rng(seed)
    dropped = [f[rng.random(len(f)) < KEEP] for f in placed]
    d, y = len(vocab), np.concatenate([labels, labels]).astype(float)
    # a text that word dropout left nothing of says nothing about its label
    weight = np.where(y == 1, n / pos, n / (n - pos)) * np.concatenate([np.ones(n), [0.5 * (len(f) > 0 or t == 0) for f, t in zip(dropped, labels)]])
    weight /= weight.sum()
    x = Rows(placed + dropped, d)
    pairs = [(p, place(s)) for p, s in zip(placed, swapped) if s is not None]
    pairs += [(place(numbered(u)), place(numbered(v))) for u, v in SWAP.items()]
    pairs += [(place(f), np.empty(0, np.int64)) for f in terms]
    left, right = Rows([p for p, _ in pairs], d), Rows([q for _, q in pairs], d)
    w, c, m, v = np.zeros(d), 0.0, np.zeros(d + 1), np.zeros(d + 1)
    for step in range(1, 401):
        g = (1 / (1 + np.exp(-(x.dot(w) + c))) - y) * weight
        change = left.dot(w) - right.dot(w)
        grad = x.back(g) + RIDGE * w + 2 * penalty / len(pairs) * (left.back(change) - right.back(change))
        full = np.append(grad, g.sum())
        m, v = 0.9 * m + 0.1 * full, 0.99 * v + 0.01 * full**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, c = w - move[:-1], c - move[-1]
    # classes weighed alike in the fit; the intercept is moved part of the way to the prior, as insults are telling
    c += 0.5 * math.log(base / (1 - base))
    kept = np.abs(w) > 1e-4
    return Model({names[k]: x for k, x in zip(vocab[kept].tolist(), w[kept].tolist())}, float(c))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = PENALTY) -> Model:
    """Fits to labels.toxic of the training folds: documents with crc32(doc_id as text) mod FOLDS other than 0."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold != 0)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    total = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    drawn = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = F.broadcast(drawn[0].union(drawn[1]))  # at most twice sample narrow rows
    texts = cut(docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic"), "labelled")
    size = {r[0]: r[1] for r in texts.groupBy("toxic").count().collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500):
            text, found = Words(b.column(0)).features()
            coded = pc.dictionary_encode(found)
            toxic = b.column(1).to_numpy()[text]
            both = [np.bincount(coded.indices.to_numpy()[toxic == k], minlength=len(coded.dictionary)).astype(np.int64) for k in (0, 1)]
            yield pa.record_batch([coded.dictionary, *map(pa.array, both)], names=["f", "n0", "n1"])

    # the most telling features, by how far the shares of the classes lie apart; only these reach the driver
    counts = texts.mapInArrow(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 + n1 >= 4")
    n0, n1 = float(max(size.get(0, 0), 1)), float(max(size.get(1, 0), 1))
    a, b = F.col("n1") / n1, F.col("n0") / n0
    gain = F.abs(a - b) / F.sqrt(F.greatest(a * (1 - a), F.lit(0.0)) / n1 + F.greatest(b * (1 - b), F.lit(0.0)) / n0 + 1.0 / (n0 + n1) ** 2)
    best = counts.withColumn("gain", F.round(gain, 9)).where("gain >= 3").orderBy(F.desc("gain"), "f").limit(FEATURES)
    names = sorted({r["f"] for r in best.select("f").collect()} | {f for w in SWAP for f in word_features(w)})
    lookup = Names(names)

    def swap(text: str | None) -> str | None:
        """The text with its identity terms swapped, null if it has none."""
        words = (text or "").lower().split()
        swapped = [SWAP.get(w.strip(STRIP), w) for w in words]
        return " ".join(swapped) if swapped != words else None

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = lambda column: [np.flatnonzero(h).tolist() for h in Words(column).hits(lookup)]
        others = pa.array([swap(x) for x in b.column(0).to_pylist()], pa.string())
        other = [x if has else None for x, has in zip(lists(others), others.is_valid().to_pylist())]
        kind = pa.list_(pa.int32())
        return pa.record_batch([b.column(1).cast(pa.int32()), pa.array(lists(b.column(0)), kind), pa.array(other, kind)], names=["toxic", "own", "other"])

    rows = map_arrow(texts, run, "toxic int, own array<int>, other array<int>").toArrow()
    array = lambda c: [np.asarray(x, np.int32) if x is not None else None for x in rows[c].to_pandas()]
    y, own, swapped = rows["toxic"].to_numpy(), array("own"), array("other")
    order = sorted(range(len(y)), key=lambda k: (y[k], own[k].tobytes()))  # the order of rows must not matter
    made = fit(names, [own[i] for i in order], [swapped[i] for i in order], y[order] if len(y) else y, total.get(1, 0) / max(1, sum(total.values())), penalty)
    del rows, own, swapped
    trim()
    return made


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row of docs."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = model.scores(b.column(1))
        return pa.record_batch([b.column(0).cast(pa.int64()), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model does not reject; null and empty texts stay unless the prior alone rejects."""
    at = docs.columns.index("text")

    def run(batches):
        for b in slices(batches):
            yield b.filter(pa.array(model.scores(b.column(at)) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(True))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
