"""The first reader: every film of a study through a model, as batches in Python workers.

A model is a function of a batch of prepared films to probabilities by label and, if it has them, activation maps. It is
made by a factory, once a worker.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import pixels
from ..operators import findings, search

Infer = Callable[[np.ndarray], tuple[np.ndarray, list[dict[str, np.ndarray]] | None]]
SIDE = 224
READ = "study_id string, ord long, label string, prob double, image_ref string, locus struct<cx: double, cy: double, r: double>, error string"
_MODELS: dict[str, Infer] = {}


def prepared(a: np.ndarray, side: int = SIDE) -> np.ndarray:
    """The middle square of an 8-bit film on a side x side grid, from -1 to 1."""
    n = min(a.shape)
    y, x = ((s - n) // 2 for s in a.shape)
    return pixels.resampled(a[y : y + n, x : x + n], side) / 127.5 - 1


def calibrated(scores: np.ndarray, logits: bool) -> np.ndarray:
    """Probabilities: a sigmoid of logits; scores that are probabilities already stay as they are."""
    p = 1 / (1 + np.exp(-scores)) if logits else scores
    if np.isnan(p).any() or (p < 0).any() or (p > 1).any():
        raise ValueError("probabilities out of range")
    return p


def model_of(name: str, make: Callable[[], Infer]) -> Infer:
    if name not in _MODELS:
        _MODELS[name] = make()
    return _MODELS[name]


BATCH = 16


def read(films: DataFrame, name: str, make: Callable[[], Infer], labels: list[str], decode: Callable[[str, bytes], np.ndarray] | None = None, logits: bool = False, thresholds: dict[str, float] | None = None, default: float = 0.5, batch: int = BATCH) -> DataFrame:
    """Readings (READ) of films (study_id, path, content): a row for each film and label, its locus only where the label is called; a film that fails is one row with its error.

    The model sees up to batch films at a time. Where a batch fails, its films are read one by one, so that one of them
    does not take the others along.
    """

    def rows_of(infer: Infer, some: list[tuple[str, str, np.ndarray]]) -> list[tuple]:
        try:
            scores, maps = infer(np.stack([x for *_, x in some]))
            scores = np.asarray(scores, float)
            if len(scores) != len(some):
                raise ValueError(f"{len(scores)} readings of {len(some)} films")
            ps = [calibrated(row, logits) for row in scores]
        except Exception as e:
            if len(some) > 1:
                return [r for x in some for r in rows_of(infer, [x])]
            return [(some[0][0], 0, None, math.nan, some[0][1], None, f"{type(e).__name__}: {e}")]
        out = []
        for i, ((study, path, _), p) in enumerate(zip(some, ps)):
            for k, label in enumerate(labels):
                heat = maps[i].get(label) if maps and p[k] >= (thresholds or {}).get(label, default) else None
                spot = pixels.peak(heat) if heat is not None else None
                out.append((study, k, label, float(p[k]), path, None if spot is None else dict(zip(("cx", "cy", "r"), spot)), None))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        infer, some = model_of(name, make), []
        told = lambda rows: pd.DataFrame(rows, columns=["study_id", "ord", "label", "prob", "image_ref", "locus", "error"])
        for b in batches:
            rows = []
            for study, path, content in zip(b["study_id"], b["path"], b["content"]):
                try:
                    some.append((study, path, prepared((decode or pixels.decoded)(path, content))))
                except Exception as e:
                    rows.append((study, 0, None, math.nan, path, None, f"{type(e).__name__}: {e}"))
                if len(some) == batch:
                    rows += rows_of(infer, some)
                    some = []
            yield told(rows)
        if some:
            yield told(rows_of(infer, some))

    return films.select("study_id", "path", "content").mapInPandas(run, READ)


def alerts(readings: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Alerts of the first reader: of each study and label the highest reading over its films (the first path on ties), if it is critical."""
    best = readings.where("error IS NULL").groupBy("study_id", "label").agg(F.min(F.struct((-findings.clamp(F.col("prob"))).alias("least"), "image_ref")).alias("x"))
    return findings.triage(best.select("study_id", "label", (-F.col("x.least")).alias("prob"), "x.image_ref", F.lit("cnn").alias("source"), F.lit(0).alias("ord")), threshold)


def invariant(films: DataFrame, settings: Settings = Settings(), decode: Callable[[str, bytes], np.ndarray] | None = None) -> DataFrame:
    """path and invariant: whether quality control says the same of a film (path, content) and of a slightly brighter, noisier copy; null where it can't be decoded. The noise is that of the path."""
    kinds = [f"{c}_{k} {t}" for k in ("a", "b") for c, t in (("width", "int"), ("height", "int"), ("mean", "double"), ("std", "double"), ("symmetry", "double"))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    a = (decode or pixels.decoded)(path, content)
                    both = [pixels.describe(path, b"", lambda *_, x=x: x)[1:6] for x in (a, pixels.perturbed(a, zlib.crc32(path.encode())))]
                except Exception:
                    both = [(None,) * 5] * 2
                rows.append((path, *both[0], *both[1]))
            yield pd.DataFrame(rows, columns=["path", *(k.split(" ")[0] for k in kinds)])

    seen = films.select("path", "content").mapInPandas(run, f"path string, {', '.join(kinds)}")
    ok = lambda k: search.qc_issues(*(F.col(f"{c}_{k}") for c in ("width", "height", "std", "mean", "symmetry")), settings.symmetry_threshold)[1]
    return seen.select("path", F.when(F.col("width_a").isNotNull(), ok("a") == ok("b")).alias("invariant"))
