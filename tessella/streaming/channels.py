"""Keyed additive state: writers of a run append to its channels, and nothing they send overwrites anything.

A run's state is the accepted items of its channels, an entry of Spark's state store for what a batch adds, and for each writer
the numbers it has sent (as ranges, so a writer that counts takes a few bytes). An update that comes twice, from a writer that sent it
again or from a batch that ran again, is accepted once; writers may come in any order and interleave. A run that has been
quiet for a while of event time is closed: its channels come out whole and its state goes.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

UPDATE = "study_id string, channel string, writer string, seq long, ts timestamp, item string"
#: kind: appended (an item at its place in the channel) or closed (a channel of a run that ended, items in order of time, writer and number).
CHANGE = "study_id string, kind string, channel string, place long, writer string, seq long, ts timestamp, item string, items array<string>"
_COLUMNS = [c.split(" ")[0] for c in CHANGE.split(", ")]


def add_number(ranges: list[list[int]], n: int) -> bool:
    """Adds n to sorted, disjoint ranges [first, last]; false if it was there."""
    if not ranges or n > ranges[-1][1] + 1:
        ranges.append([n, n])
        return True
    at = bisect_right(ranges, n, key=itemgetter(0))
    if at and ranges[at - 1][1] >= n:
        return False
    left, right = at > 0 and ranges[at - 1][1] == n - 1, at < len(ranges) and ranges[at][0] == n + 1
    if left and right:
        ranges[at - 1][1] = ranges[at][1]
        del ranges[at]
    elif left:
        ranges[at - 1][1] = n
    elif right:
        ranges[at][0] = n
    else:
        ranges.insert(at, [n, n])
    return True


#: Keys over which runs are dealt, and accepted items that a call holds back before it writes them.
BUCKETS, HELD = 1_024, 50_000
#: Time, writer and number.
_ORDER = itemgetter(0, 1, 2)


def _changes(rows: list[tuple]) -> pd.DataFrame:
    """Rows of CHANGE, times in microseconds."""
    values = list(zip(*rows))
    values[6] = np.array(values[6], "datetime64[us]").astype("datetime64[ns]")
    return pd.DataFrame(dict(zip(_COLUMNS, map(list, values[:6])), ts=values[6], item=list(values[7]), items=list(values[8])))


class _Channels(StatefulProcessor):
    """Runs are dealt over BUCKETS keys, as calls, batches and frames of each key cost far more than a run's few rows; each run has its own entries."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "study string", "told string")
        # one entry holds what a batch adds to a run
        self.items = handle.getMapState("items", "study string, pack long", "packed string")
        # runs that one timer looks at; none of them is due before it
        self.due = handle.getMapState("due", "at long", "studies string")

    def _watch(self, dues: dict[str, int]) -> None:
        """One timer for runs with the times at which they end if nothing comes, at the first of them."""
        if dues:
            at = min(dues.values())
            others = self.due.getValue((at,))
            self.due.updateValue((at,), (json.dumps([*(json.loads(others[0]) if others else []), *dues]),))
            self.handle.registerTimer(at)

    def _put(self, told: dict[str, dict], new: dict[str, list]) -> None:
        for study, rows in new.items():
            self.items.updateValue((study, told[study]["packs"]), (json.dumps(rows),))
            told[study]["packs"] += 1
        new.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        told: dict[str, dict] = {}
        opened, touched, new, held = [], set(), {}, 0
        for b in rows:
            at, out = b["ts"].astype("datetime64[us]").astype("int64").tolist(), []
            for row in sorted(zip(at, b["writer"].tolist(), map(int, b["seq"].tolist()), b["channel"].tolist(), b["item"].tolist(), b["study_id"].tolist()), key=_ORDER):
                ts, writer, seq, channel, item, study = row
                own = told.get(study)
                if own is None:
                    kept = self.seen.getValue((study,))
                    own = told[study] = json.loads(kept[0]) if kept else {"sent": {}, "count": {}, "last": 0, "packs": 0}
                    if not kept:
                        opened.append(study)
                if add_number(own["sent"].setdefault(f"{channel}\x1f{writer}", []), seq):
                    place = own["count"].get(channel, 0)
                    own["count"][channel] = place + 1
                    own["last"] = max(own["last"], ts // 1000)
                    touched.add(study)
                    new.setdefault(study, []).append(row[:5])
                    out.append((study, "appended", channel, place, writer, seq, ts, item, None))
            held += len(out)
            if held > HELD:
                self._put(told, new)
                held = 0
            if out:
                yield _changes(out)
        self._put(told, new)
        for study in touched:
            self.seen.updateValue((study,), (json.dumps(told[study]),))
        self._watch({s: told[s]["last"] + self.idle_ms for s in opened})

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, timer = timerValues.getCurrentWatermarkInMs(), (expiredTimerInfo.getExpiryTimeInMs(),)
        later = {}
        studies = json.loads(self.due.getValue(timer)[0])
        self.due.removeKey(timer)
        for study in studies:
            own = json.loads(self.seen.getValue((study,))[0])
            if own["last"] + self.idle_ms > now:  # updates came since
                later[study] = own["last"] + self.idle_ms
                continue
            whole: dict[str, list] = {}
            for pack in range(own["packs"]):
                for ts, writer, seq, channel, item in json.loads(self.items.getValue((study, pack))[0]):
                    whole.setdefault(channel, []).append((ts, writer, seq, item))
                self.items.removeKey((study, pack))
            self.seen.removeKey((study,))
            ordered = {c: sorted(x, key=_ORDER) for c, x in sorted(whole.items())}
            yield _changes([(study, "closed", c, len(x), None, None, x[-1][0], None, [i[3] for i in x]) for c, x in ordered.items()])
        self._watch(later)

    def close(self) -> None:
        pass


def keyed(spark: SparkSession) -> None:
    """State of this kind needs the store that keeps it on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def channels(updates: DataFrame, late: str = "10 minutes", idle_s: float = 3_600) -> DataFrame:
    """CHANGE of a stream of UPDATE: what is appended, and whole channels of runs that were quiet for idle_s seconds.

    Rows more than late behind the newest are not taken. Null items are items; rows without study, channel, writer, number
    or time are left out. It writes as it appends (output mode append or update).
    """
    keyed(updates.sparkSession)
    whole = updates.where(F.forall(F.array(*(F.col(c).isNull() for c in ("study_id", "channel", "writer", "seq", "ts"))), lambda x: ~x)).withWatermark("ts", late)
    return whole.withColumn("bucket", F.pmod(F.xxhash64("study_id"), F.lit(BUCKETS)).cast("int")).groupBy("bucket").transformWithStateInPandas(statefulProcessor=_Channels(int(idle_s * 1000)), outputStructType=CHANGE, outputMode="Append", timeMode="EventTime")


def whole(updates: DataFrame) -> DataFrame:
    """The batch answer: study_id, channel, items of all updates, each once, in order of time, writer and number."""
    once = updates.where("study_id IS NOT NULL AND channel IS NOT NULL AND writer IS NOT NULL AND seq IS NOT NULL AND ts IS NOT NULL").groupBy("study_id", "channel", "writer", "seq").agg(F.min(F.struct("ts", "item")).alias("x"))
    items = F.sort_array(F.collect_list(F.struct("x.ts", "writer", "seq", "x.item")))  # of one run
    return once.groupBy("study_id", "channel").agg(F.transform(items, lambda i: i["item"]).alias("items"))


def unheralded(alerts: DataFrame, reports: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Reports (study_id, report_at) of a stream that no alert (study_id, alert_at) of another stream came before, within the time stated: report_at and alert_at (null, or that of an alert that came late).

    A stream-stream outer join: both sides are watermarked and the join is bounded in time, so its state is as well.
    """
    a = alerts.select(F.col("study_id").alias("a_study"), "alert_at").withWatermark("alert_at", late)
    r = reports.select("study_id", "report_at").withWatermark("report_at", late)
    near = (F.col("study_id") == F.col("a_study")) & F.expr(f"alert_at BETWEEN report_at - INTERVAL {within} AND report_at + INTERVAL {within}")
    return r.join(a, near, "left_outer").where("alert_at IS NULL OR alert_at > report_at").select("study_id", "report_at", "alert_at")


def once_a_batch(stream: DataFrame, path: str, checkpoint: str):
    """Writes each batch to a folder of its number, over what is there: a batch that runs again adds nothing."""

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
