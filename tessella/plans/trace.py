"""What stages did, measured as rows pass: counts, seconds, characters, errors.

A stage is watched by aggregates that Spark gathers in the tasks and brings to the driver when the job that runs the
stage ends, so nothing is computed twice and no worker has to report. Spans are handed out once, and leave masked through
sources/store.py: export().
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SPANS = "name string, rows long, seconds double, errors long, input_chars long, output_chars long, text string"


class Trace:
    """Spans of one run. wait: seconds for the figures of a stage whose job has ended; one that never ran is left out."""

    def __init__(self, wait: float = 5.0):
        self.wait, self._watched = wait, []

    def watch(self, df: DataFrame, name: str, text: Column | None = None, **figures: Column) -> DataFrame:
        """df, watched as it passes: its rows, sums of figures (seconds, errors, input_chars, output_chars) and one of its texts."""
        seen = Observation()
        self._watched.append((name, seen))
        sums = [F.sum(c).alias(k) for k, c in figures.items()]
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *sums, *([] if text is None else [F.max(text).alias("text")]))

    def spans(self, spark: SparkSession) -> DataFrame:
        """Spans (SPANS) of the stages that ran since the last call; figures that a stage does not have are null."""
        rows, late = [], []
        for name, seen in self._watched:
            got: list[dict] = []
            t = threading.Thread(target=lambda out=got, s=seen: out.append(s.get), daemon=True)
            t.start()
            t.join(self.wait)
            if got:
                rows.append((name, *(got[0].get(c.split()[0]) for c in SPANS.split(", ")[1:])))
            else:
                late.append((name, seen))
        self._watched = late
        return spark.createDataFrame(rows, SPANS)
