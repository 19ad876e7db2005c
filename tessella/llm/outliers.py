"""Operator 1, quality rules: robust multivariate outliers by minimum-covariance-determinant (MCD) estimates.

Base rules read exact counts of the whole text. A document that passes them is then judged against the others of its
language and source: its counts become a vector of shape statistics (word length, symbols, repeated lines, repeated
windows, length), each group gets a robust centre and scatter, and vectors beyond a Mahalanobis distance are rejected.

The scatter is found by concentration steps over all rows of a group, from two deterministic starts (median and MAD;
plain mean and covariance): keep the half nearest to the current centre, re-estimate, repeat. The determinant of the
half never grows; the start with the smaller one wins. A reweighting step then re-estimates from all rows within the
0.975 chi-square quantile. A step is two partial aggregates (a quantile sketch of the distances, then sums), so a group
of any size is never collected, and its parameters are one row that is joined back.

The distance beyond which a vector is rejected comes from the distances of the group itself: SPREAD robust standard
deviations (from quartiles) of their logarithm above its median. For normal vectors that is about the 0.999 chi-square
quantile (20.5), the least it can be; where a group's distances have heavier tails, it lies further out.

Defined cases: null or empty text has no words and fails the base rules. Null language or source is a group of its own.
Groups under MIN_GROUP rows have no estimate of their own: their rows are judged by that of their language over all
sources, then, where the language has too few as well, by that of all rows, however few those are. Repeated rows are
judged one by one and alike. Extra columns of the input are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import cut, map_arrow, table, texts

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MIN_GROUP = 60
STEPS = 3
#: Groups (about 300 bytes each) whose parameters are sent to all tasks.
BROADCAST_GROUPS = 50_000
#: Robust standard deviations of the logarithm of squared distances beyond which a vector is rejected (2.5 is customary with medians).
SPREAD = 2.5
#: The least such distance: the chi-square quantile 0.999, for groups whose rows hardly differ.
LEAST_CUT = 20.52
#: Chi-square quantile 0.975 of 5 dimensions, and what makes the scatter within it that of a normal distribution.
NEAR, WITHIN = 12.83, 1.055
#: Least standard deviation of each component: what rounding and short texts alone bring about. It also keeps the
#: scatter regular where most rows of a group hold the same value.
FLOOR = (0.05, 0.10, 0.10, 0.12, 0.35)
DIM = len(FLOOR)
PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
DOUBLES = ArrayType(DoubleType())
COUNTS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def counts_of(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text in UTF-8."""
    w = text.split()  # bytes: splits at \x20 and \x09-\x0D only
    n = len(w)
    if not n:
        return 0, 0, sum(text.count(c) for c in SYMBOLS), 0, 0
    body = b"".join(w)
    chars = len(body) if body.isascii() else int((np.frombuffer(body, np.int8) >= -64).sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > 3:
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) < n - 2:
            seen: set = set()
            twice = {x for x in windows if x in seen or seen.add(x)}
            reach = 0
            for i, x in enumerate(windows):
                if x in twice:
                    repeated += i + 3 - max(i, reach)
                    reach = i + 3
    return n, chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated


def count_words(docs: DataFrame) -> DataFrame:
    """The counts of every row of docs (doc_id, text, lang, source)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = np.array([counts_of(x) for x in texts(b.column(1))], np.int64).reshape(-1, 5)
        return pa.record_batch([b.column(0).cast(pa.int64()), b.column(2), b.column(3), *(pa.array(c[:, i]) for i in range(5))], names=["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    return map_arrow(docs.select("doc_id", "text", "lang", "source"), run, COUNTS)


def vector() -> list:
    """The transformed statistics; each is bounded or grows with the logarithm of the text."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.sqrt(F.col("n_symbols") / n),
        F.log1p(F.col("n_dup_lines").cast("double")) / F.log(n + 10),
        F.sqrt(F.col("n_repeat_words") / n),
        F.log(n),
    ]


def _distance(p: str):
    """Squared distance of x0.. to the centre and inverse scatter in the array column p (centre, then upper triangle)."""
    d = [F.col(f"x{i}") - F.col(p)[i] for i in range(DIM)]
    out = F.lit(0.0)
    for k, (i, j) in enumerate(PAIRS):
        out = out + d[i] * d[j] * F.col(p)[DIM + k] * (1.0 if i == j else 2.0)
    return out


def _solve(sums: np.ndarray, widen: float) -> tuple[np.ndarray, float]:
    """Centre, inverse of the floored scatter and log determinant from count, sums and products."""
    n = max(sums[0], 1.0)
    m = sums[1 : 1 + DIM] / n
    s = np.zeros((DIM, DIM))
    for k, (i, j) in enumerate(PAIRS):
        s[i, j] = s[j, i] = sums[1 + DIM + k] / n - m[i] * m[j]
    s = s * widen + np.diag(np.square(FLOOR))
    return np.concatenate([m, np.linalg.inv(s)[[i for i, _ in PAIRS], [j for _, j in PAIRS]]]), float(np.linalg.slogdet(s)[1])


def _moments(where) -> list:
    one = F.when(where, F.lit(1.0)).otherwise(F.lit(0.0))
    xs = [F.col(f"x{i}") for i in range(DIM)]
    return [F.sum(one), *(F.sum(one * x) for x in xs), *(F.sum(one * xs[i] * xs[j]) for i, j in PAIRS)]


#: The half with the smallest distances has too small a scatter; its share of a normal distribution's, 5 dimensions.
CONSISTENCY = 1.0 / 0.46


@F.pandas_udf(DOUBLES)
def _params(sums: pd.Series) -> pd.Series:
    return sums.map(lambda x: _solve(np.asarray(x, float), CONSISTENCY)[0].tolist())


@F.pandas_udf(DoubleType())
def _logdet(sums: pd.Series) -> pd.Series:
    return sums.map(lambda x: _solve(np.asarray(x, float), CONSISTENCY)[1])


@F.pandas_udf(DOUBLES)
def _reweighted(sums: pd.Series) -> pd.Series:
    return sums.map(lambda x: _solve(np.asarray(x, float), WITHIN)[0].tolist())


@F.pandas_udf(DOUBLES)
def _plain(sums: pd.Series) -> pd.Series:
    return sums.map(lambda x: _solve(np.asarray(x, float), 1.0)[0].tolist())


@F.pandas_udf(DOUBLES)
def _diagonal(centre: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    def one(m, a, b):
        sd = (np.asarray(b, float) - np.asarray(a, float)) / 1.349
        inv = np.zeros((DIM, DIM))
        np.fill_diagonal(inv, 1 / (np.square(sd) + np.square(FLOOR)))
        return np.concatenate([np.asarray(m, float), inv[[i for i, _ in PAIRS], [j for _, j in PAIRS]]]).tolist()

    return pd.Series([one(*x) for x in zip(centre, low, high)])


def _sent(params: DataFrame):
    """How a table of a row a group is joined: sent to all tasks up to BROADCAST_GROUPS groups, shuffled beyond."""
    return F.broadcast if params.count() <= BROADCAST_GROUPS else lambda df: df


def mcd(counted: DataFrame, keys: list[str], steps: int = STEPS, least: int | Column = MIN_GROUP, spread: float = SPREAD) -> DataFrame:
    """A row for each group of keys (no nulls) of least rows or more (a number, or one of the keys): its parameters p (centre, then upper triangle of the inverse scatter) and the squared distance cut."""
    rows = counted.select(*keys, *(x.alias(f"x{i}") for i, x in enumerate(vector())))
    xs = [f"x{i}" for i in range(DIM)]
    quartiles = [F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000) for x in xs]
    first = rows.groupBy(*keys).agg(F.array(*_moments(F.lit(True))).alias("s"), *(q.alias(f"q{i}") for i, q in enumerate(quartiles))).where(F.col("s")[0] >= least)
    at = lambda k: F.array(*(F.col(f"q{i}")[k] for i in range(DIM)))
    params = cut(first.select(*keys, F.col("s")[0].alias("n"), _diagonal(at(1), at(0), at(2)).alias("p0"), _plain("s").alias("p1")), "mcd")
    sent = _sent(params)  # every table of parameters below has these groups
    for _ in range(steps):
        near = rows.join(sent(params), keys).withColumns({"d0": _distance("p0"), "d1": _distance("p1")})
        half = near.groupBy(*keys).agg(*(F.percentile_approx(f"d{k}", F.lit(0.5), 1000).alias(f"h{k}") for k in (0, 1)))
        nearest = near.join(sent(half), keys)
        sums = nearest.groupBy(*keys).agg(F.first("n").alias("n"), *(F.array(*_moments(F.col(f"d{k}") <= F.col(f"h{k}"))).alias(f"s{k}") for k in (0, 1)))
        params = cut(sums.select(*keys, "n", *(_params(f"s{k}").alias(f"p{k}") for k in (0, 1)), *(_logdet(f"s{k}").alias(f"l{k}") for k in (0, 1))), "mcd")
    best = params.select(*keys, "n", F.when(F.col("l0") <= F.col("l1"), F.col("p0")).otherwise(F.col("p1")).alias("p"))
    near = rows.join(sent(best), keys).groupBy(*keys).agg(F.array(*_moments(_distance("p") <= NEAR)).alias("s"), F.first("p").alias("p"), F.first("n").alias("n"))
    # where fewer than half lie that near (the half's scatter was no normal one), the estimate stays as it is
    final = cut(near.select(*keys, F.when(F.col("s")[0] >= F.col("n") / 2, _reweighted("s")).otherwise(F.col("p")).alias("p")), "mcd")
    quartile = F.percentile_approx(F.log(_distance("p") + 1e-9), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000)
    cuts = rows.join(sent(final), keys).groupBy(*keys).agg(F.first("p").alias("p"), quartile.alias("q"))
    return cut(cuts.select(*keys, "p", F.greatest(F.lit(LEAST_CUT), F.exp(F.col("q")[1] + spread * (F.col("q")[2] - F.col("q")[0]) / 1.349)).alias("cut")), "mcd")


def quality_outliers(docs: DataFrame, spread: float = SPREAD) -> DataFrame:
    """doc_id, lang, source, the five counts, base_failed, distance, wider_distance, cut, kept: one row a document.

    Distances are squared. distance is that to the estimate of the document's group, null if it has none; wider_distance
    then is that to the estimate of its language, or else of all rows.
    """
    return judged(cut(count_words(docs), "counts"), spread)


def judged(counted: DataFrame, spread: float = SPREAD) -> DataFrame:
    """quality_outliers of counted documents. The estimates of all three levels (all rows, a language, a group) come from one set of steps; wider ones are made only where a smaller one is missing."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    keyed = counted.withColumns({"base_failed": base, "k_lang": F.concat(F.lit("="), F.col("lang")), "k_source": F.concat(F.lit("="), F.col("source"))}).fillna("", ["k_lang", "k_source"])
    sizes = cut(keyed.groupBy("k_lang", "k_source").agg(F.sum(F.when(F.col("base_failed"), 0).otherwise(1)).alias("n")), "sizes")
    wide = sizes.groupBy("k_lang").agg(F.sum("n").alias("n"), F.min("n").alias("least")).where(F.col("least") < MIN_GROUP)
    levels = F.array_compact(F.array(F.lit(2), F.when(F.col("wide"), F.lit(1)), F.lit(None if wide.where(F.col("n") < MIN_GROUP).isEmpty() else 0).cast("int")))
    passed = keyed.where(~F.col("base_failed")).join(_sent(sizes)(wide.select("k_lang", F.lit(True).alias("wide"))), "k_lang", "left").withColumn("level", F.explode(levels))
    passed = passed.withColumns({"k_lang": F.when(F.col("level") > 0, F.col("k_lang")).otherwise(""), "k_source": F.when(F.col("level") > 1, F.col("k_source")).otherwise("")})
    params = mcd(passed, ["level", "k_lang", "k_source"], least=F.when(F.col("level") > 0, MIN_GROUP).otherwise(1), spread=spread)
    sent = _sent(params)
    rows = keyed.withColumns({f"x{i}": x for i, x in enumerate(vector())}).withColumn("k_all", F.lit(""))
    for level, p, keys in ((2, "p", ["k_lang", "k_source"]), (1, "p_lang", ["k_lang"]), (0, "p_all", ["k_all"])):
        own = params.withColumn("k_all", F.lit("")).where(F.col("level") == level).select(*keys, F.col("p").alias(p), F.col("cut").alias(f"cut_{p}"))
        rows = rows.join(sent(own), keys, "left")
    rows = rows.withColumn("distance", _distance("p")).withColumn("wider_distance", F.when(F.col("p").isNull(), F.coalesce(_distance("p_lang"), _distance("p_all"))))
    far, limit = F.coalesce("distance", "wider_distance", F.lit(0.0)), F.when(F.col("p").isNotNull(), F.col("cut_p")).when(F.col("p_lang").isNotNull(), F.col("cut_p_lang")).otherwise(F.col("cut_p_all"))
    return rows.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "wider_distance", limit.alias("cut"), (~F.col("base_failed") & (far <= F.coalesce(limit, F.lit(math.inf)))).alias("kept"))


def op1_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_outliers(table(spark, sf_dir, "documents")).drop("lang", "source", "wider_distance", "cut")
