"""Keyed state and joined streams: restarts, replays, late rows; equal to the batch answers."""

import random
from datetime import UTC, datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.streaming import channels, feed

BEGIN = datetime(2024, 1, 1)


def at(minutes):
    return BEGIN + timedelta(minutes=minutes)


def put(spark, path, rows, kind=channels.UPDATE):
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(path))


def run(spark, tmp_path, source="in"):
    stream = channels.channels(spark.readStream.schema(channels.UPDATE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / source)), "30 minutes", 3_600)
    feed.drain(channels.once_a_batch(stream, str(tmp_path / "out"), str(tmp_path / "cp")))
    return spark.read.schema(channels.CHANGE).parquet(str(tmp_path / "out")).collect()


def test_numbers_in_ranges():
    rng = random.Random(2)
    for _ in range(200):
        ranges, seen = [], set()
        for n in rng.choices(range(30), k=40):
            assert channels.add_number(ranges, n) == (n not in seen)
            seen.add(n)
        assert [n for a, b in ranges for n in range(a, b + 1)] == sorted(seen)
        assert all(a[1] + 1 < b[0] for a, b in zip(ranges, ranges[1:]))


def test_interleaved_writers_keep_every_event_after_a_restart(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"s{s}", c, w, n, at(n * 2 + (w == "b")), f"{s}{c}{w}{n}") for s in range(3) for c in ("notes", "trace") for w in ("a", "b") for n in range(6)]
    rng.shuffle(rows)
    put(spark, tmp_path / "in", rows[:25])
    first = run(spark, tmp_path)
    assert {(r["study_id"], r["channel"], r["item"]) for r in first if r["kind"] == "appended"} == {(r[0], r[1], r[5]) for r in rows[:25]}
    # the query starts again from its checkpoint; a writer sends again what it has sent, and what is new
    put(spark, tmp_path / "in", rows[15:50] + rows[20:30])
    put(spark, tmp_path / "in", rows[40:] + [(None, "notes", "a", 0, at(3), "x"), ("s0", None, "a", 0, at(3), "x")])
    got = [r for r in run(spark, tmp_path) if r["kind"] == "appended"]
    assert sorted((r["study_id"], r["channel"], r["writer"], r["seq"], r["item"]) for r in got) == sorted((r[0], r[1], r[2], r[3], r[5]) for r in rows)
    for s in range(3):
        for c in ("notes", "trace"):
            assert sorted(r["place"] for r in got if r["study_id"] == f"s{s}" and r["channel"] == c) == list(range(12))
    # quiet runs are closed once the watermark has passed them, and equal the batch answer
    put(spark, tmp_path / "in", [("later", "notes", "a", 0, at(600), "z"), ("later", "notes", "a", 1, at(601), None)])
    put(spark, tmp_path / "in", [("later", "notes", "a", 2, at(602), "y")])
    closed = {(r["study_id"], r["channel"]): r["items"] for r in run(spark, tmp_path) if r["kind"] == "closed"}
    batch = {(r["study_id"], r["channel"]): r["items"] for r in channels.whole(spark.read.schema(channels.UPDATE).parquet(str(tmp_path / "in"))).collect()}
    assert closed == {k: v for k, v in batch.items() if k[0] != "later"} and batch["later", "notes"] == ["z", None, "y"]


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    put(spark, tmp_path / "in", [("s", "notes", "a", n, at(n), str(n)) for n in range(5)])
    before = len(run(spark, tmp_path))
    last = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as if the driver had died between the write and the commit
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert before == 5 and len(run(spark, tmp_path)) == 5


@pytest.mark.parametrize("cut", [1, 3])
def test_reports_before_their_alerts_are_flagged(spark, tmp_path, cut):
    alerts = [("a", at(0)), ("b", at(30)), ("c", at(5)), ("far", at(-200)), ("end", at(900)), ("end", at(1_000))]
    reports = [("a", at(1)), ("b", at(20)), ("none", at(10)), ("c", at(5)), ("far", at(2)), ("end", at(901)), ("end", at(1_001))]
    alerts.sort(key=lambda r: r[1])
    reports.sort(key=lambda r: r[1])
    for name, rows in (("alerts", alerts), ("reports", reports)):
        kind = f"study_id string, {'alert_at' if name == 'alerts' else 'report_at'} timestamp"
        for part in range(cut):
            own = rows[part * len(rows) // cut : (part + 1) * len(rows) // cut]
            put(spark, tmp_path / name, own, kind)
    read = lambda name, c: spark.readStream.schema(f"study_id string, {c} timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / name))
    flagged = channels.unheralded(read("alerts", "alert_at"), read("reports", "report_at"))
    feed.drain(channels.once_a_batch(flagged, str(tmp_path / "out"), str(tmp_path / "cp")))
    got = spark.read.schema("study_id string, report_at timestamp, alert_at timestamp").parquet(str(tmp_path / "out"))
    assert sorted((r["study_id"], r["alert_at"]) for r in got.collect()) == [("b", at(30)), ("far", None), ("none", None)]
    assert got.where(F.col("study_id") == "b").first()["report_at"] == at(20)


class Store:
    """State of one key in dicts; counts the calls."""

    def __init__(self):
        self.maps, self.timers, self.calls = {}, set(), 0

    def getMapState(self, name, *_):
        store, values = self, self.maps.setdefault(name, {})

        class State:
            def getValue(self, k):
                store.calls += 1
                return values.get(k)

            def updateValue(self, k, v):
                store.calls += 1
                values[k] = v

            def removeKey(self, k):
                store.calls += 1
                del values[k]

        return State()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class Clock:
    def __init__(self, now, at=None):
        self.getCurrentWatermarkInMs, self.getExpiryTimeInMs = lambda: now, lambda: at


def test_runs_share_calls_and_end_when_they_are_quiet(monkeypatch):
    monkeypatch.setattr(channels, "HELD", 300)
    rng, store, done, sent = random.Random(8), Store(), channels._Channels(60_000), {}
    done.init(store)
    rows = [(f"s{n}", rng.choice("xy"), rng.choice("ab"), rng.randrange(40), at(rng.randrange(5)), f"{n}") for n in range(1_000) for _ in range(4)]
    frames = [pd.DataFrame(rows[k : k + 1_000], columns=["study_id", "channel", "writer", "seq", "ts", "item"]) for k in range(0, 4_000, 1_000)]
    for s, c, w, n, t, x in rows:
        sent.setdefault((s, c, w, n), []).append((t, x))
    got = list(done.handleInputRows((7,), iter(frames), None))
    assert len(got) == 4 and sum(map(len, got)) == len(sent) and store.calls <= 3 * 1_000 + 10 and len(store.timers) == 1
    assert list(done.handleInputRows((7,), iter(frames), None)) == [] and len(store.timers) == 1
    # half of the runs go on
    more = pd.DataFrame([(f"s{n}", "x", "c", 1, at(30), "late") for n in range(0, 1_000, 2)], columns=frames[0].columns)
    assert list(map(len, done.handleInputRows((7,), iter([more]), None))) == [500]
    ended = []
    for minute in range(40):
        now = int(at(minute).replace(tzinfo=UTC).timestamp() * 1000)
        for t in sorted(t for t in store.timers if t <= now):
            store.timers.remove(t)
            for f in done.handleExpiredTimer((7,), Clock(now), Clock(now, t)):
                ended += [(minute, r) for r in f.to_dict("records")]
    items = {(r["study_id"], r["channel"]): r["items"] for _, r in ended}
    assert len(items) == len(ended) and sum(map(len, items.values())) == len(sent) + 500
    assert {m for m, r in ended if int(r["study_id"][1:]) % 2 == 0} == {31} and max(m for m, r in ended if int(r["study_id"][1:]) % 2) == 5
    assert not any(store.maps.values()) and not store.timers
