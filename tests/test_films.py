"""Films through a model in batches, gates from films, the run store."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import gate
from tessella.operators import gates
from tessella.plans import films
from tessella.sources import archives, corpus, store
from test_archives import film, packed

LABELS = ["Mass", "Pneumothorax"]


def decode(path, content):
    if content == b"bad":
        raise ValueError("no film")
    return np.full((300, 260), content[0], np.uint8)


def table(spark, rows):
    return spark.createDataFrame(rows, "study_id string, path string, content binary")


def make(log, fail_at=None):
    def infer(batch):
        with open(log, "a") as f:
            f.write(f"{len(batch)}\n")
        level = batch[:, 0, 0]
        if fail_at is not None and (np.abs(level - (fail_at / 127.5 - 1)) < 1e-6).any():
            raise RuntimeError("out of range")
        return np.stack([(level + 1) / 2, 1 - (level + 1) / 2], 1), None

    return lambda: infer


def test_a_model_sees_batches_and_one_film_fails_alone(spark, tmp_path):
    rows = [(f"s{k}", f"f{k:02}", bytes([k])) for k in range(40)] + [("s99", "f99", b"bad")]
    log = str(tmp_path / "log")
    got = films.read(table(spark, rows).coalesce(1), "batches", make(log, fail_at=21), LABELS, decode).collect()
    sizes = [int(x) for x in open(log).read().split()]
    assert max(sizes) == 16 and sizes.count(1) == 16 and sum(sizes) == 56  # three batches, one of them film by film
    probs = {r["image_ref"]: r["prob"] for r in got if r["label"] == "Mass"}
    assert len(probs) == 39 and all(p == pytest.approx(int(k[1:]) / 255) for k, p in probs.items())
    assert {r["image_ref"]: r["error"] for r in got if r["error"]} == {"f21": "RuntimeError: out of range", "f99": "ValueError: no film"}
    one = films.read(table(spark, rows[:5]).coalesce(1), "single", make(log), LABELS, decode, batch=1).collect()
    assert sorted((r["image_ref"], r["label"], r["prob"]) for r in one) == sorted((r["image_ref"], r["label"], r["prob"]) for r in got if r["image_ref"] < "f05")


def test_critical_gate_from_films(spark, tmp_path):
    """Expected alerts are met by what the first reader sees on films; a case without a film neither hits nor misses."""
    rows = [("p1", "a", bytes([20])), ("p1", "b", bytes([250])), ("n1", "c", bytes([240])), ("x", "d", b"bad")]
    seen = films.read(table(spark, rows), "gate", make(str(tmp_path / "log")), LABELS, decode)
    alerts = films.alerts(seen)
    assert [(r["study_id"], r["label"], r["image_ref"]) for r in alerts.collect()] == [("p1", "Pneumothorax", "a")]
    cases = spark.createDataFrame([("p1", "Pneumothorax", True), ("n1", "Pneumothorax", False), ("far", "Pneumothorax", True)], "study_id string, label string, expected boolean")
    suite = lambda a, s: gates.critical_suite(cases, a, s).first()
    r = suite(alerts, seen.where("error IS NULL"))
    assert r["passed"] and (r["n_cases"], r["n_runnable"], r["metrics"]["recall"], r["metrics"]["false_positive_rate"]) == (3, 2, 1.0, 0.0)
    assert not suite(alerts, None)["passed"] and not suite(alerts.limit(0), seen)["passed"] and not suite(alerts, seen.limit(0))["passed"]


def test_robustness_gate_goes_red_when_a_film_flips(spark, tmp_path):
    rng = np.random.default_rng(3)
    sound = np.clip(rng.normal(120, 40, (200, 200)), 0, 255).astype("<u2")
    weak = (np.indices((200, 200)).sum(0) % 2 * 9 + 100).astype("<u2")  # its deviation is just too small; noise lifts it
    (tmp_path / "films.tar.gz").write_bytes(packed([("CXR7_1.dcm", film(sound)), ("notes.txt", b"x")]))
    assert gate.main(["--suite", "robustness", "--films", str(tmp_path / "films.tar.gz"), "--report-path", str(tmp_path / "out")], spark) == 0
    suite = json.loads(spark.read.text(str(tmp_path / "out")).first()[0])["suites"][0]
    assert suite["metrics"]["invariance"] == 1.0 and suite["n_cases"] == 7
    rows = spark.createDataFrame([("a", b"a"), ("b", b"b"), ("c", b"c")], "path string, content binary")
    shown = lambda path, content: {"a": sound.astype(np.uint8).clip(0, 255), "b": weak.astype(np.uint8)}[path]
    got = {r["path"]: r["invariant"] for r in films.invariant(rows, decode=shown).collect()}
    assert got == {"a": True, "b": False, "c": None}
    red = gate.suites(spark, ("robustness",), films=rows, decode=shown).first()
    assert not red["passed"] and red["metrics"]["invariance"] == pytest.approx(1 / 3) and gate.suites(spark, ("robustness",)).first()["passed"]


def states(spark, ids, day="2024-03-01"):
    rows = spark.createDataFrame([(i,) for i in ids], "run_id string")
    at = F.unix_timestamp(F.lit(f"{day} 12:00:00")).cast("double")
    return rows.select("run_id", F.concat(F.lit("s"), "run_id").alias("study_id"), F.lit("HELD").alias("status"), at.alias("created_at"), F.array(F.lit("x")).alias("alerts"), F.lit("secret").alias("indication"))


def test_a_batch_written_again_adds_nothing(spark, tmp_path):
    kept = store.TableStore(spark, str(tmp_path / "runs"))
    kept.append(states(spark, ["a", "b", "c"]), 1)
    kept.append(states(spark, ["d"], "2024-03-02"), 2)
    kept.append(states(spark, ["a", "b", "c"]), 1)  # as after a failure between write and commit
    kept.append(states(spark, ["e"]))
    assert sorted(r["run_id"] for r in kept.read().collect()) == ["a", "b", "c", "d", "e"]
    assert [r["study_id"] for r in kept.get("d").collect()] == ["sd"] and kept.get("d", "2024-03-01").count() == 0 and kept.get("zz").count() == 0
    assert [r["run_id"] for r in store.newest(kept.read(), 1).collect()] == ["d"]


def test_a_lookup_reads_one_shard(spark, tmp_path):
    kept = store.TableStore(spark, str(tmp_path / "runs"))
    kept.append(states(spark, [f"r{k}" for k in range(200)]), 0)
    files = len(list((tmp_path / "runs").rglob("*.parquet")))
    assert files == store.TableStore.SHARDS
    df = kept.get("r17", "2024-03-01")
    assert len(df.collect()) == 1
    scan = next(x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in x)
    assert "shard" in scan.split("PartitionFilters")[1].split("PushedFilters")[0] and "EqualTo(run_id,r17)" in scan
    jvm = df._jdf.queryExecution().executedPlan()
    while jvm.children().size():
        jvm = jvm.children().head()
    assert jvm.metrics().apply("numFiles").value() == 1


def test_a_stream_of_states_is_stored_once(spark, tmp_path):
    kept = store.TableStore(spark, str(tmp_path / "runs"))
    for part in (["a", "b"], ["c"]):
        states(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(states(spark, ["a"]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):
        kept.sink(stream, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        for f in sorted((tmp_path / "cp" / "commits").glob("*1*")):
            f.unlink()  # the last batch was written, but its commit was lost
    assert sorted(r["run_id"] for r in kept.read().collect()) == ["a", "b", "c"]


def test_fixtures_come_back(spark, tmp_path):
    """Gold cases, guidelines, operating points, PHI samples and scores through the files that their sources read."""
    (tmp_path / "gold.json").write_text(json.dumps({"metadata": {"n": 2}, "cases": [{"study_id": "1", "image_path": "CXR1_*.png", "expected_critical": ["Pneumothorax"]}, {"study_id": "2", "image_path": "", "expected_critical": []}]}))
    assert [(r["study_id"], list(r["expected_critical"])) for r in corpus.gold_cases(spark, str(tmp_path / "gold.json")).collect()] == [("1", ["Pneumothorax"]), ("2", [])]
    (tmp_path / "guide.json").write_text(json.dumps({"disclaimer": "x", "entries": [{"id": "g1", "text": "气胸", "meta": {"topic": "t"}}, {"id": "g2", "text": "b", "meta": {}}]}))
    assert [(r["ord"], r["id"], r["text"]) for r in corpus.guidelines(spark, str(tmp_path / "guide.json")).collect()] == [(0, "g1", "气胸"), (1, "g2", "b")]
    (tmp_path / "points.json").write_text(json.dumps([{"label": "Mass", "threshold": 0.4}, {"label": "Hernia", "threshold": None}]))
    there = lambda p: p.endswith("points.json")
    assert [r["label"] for r in corpus.operating_points(spark, str(tmp_path / "points.json"), there).collect()] == ["Mass"]
    assert corpus.operating_points(spark, str(tmp_path / "none"), there).count() == corpus.operating_points(spark, None, there).count() == 0
    from tessella.functions import synth

    samples = synth.samples(spark, 6)
    store.write_json(samples, str(tmp_path / "phi"))
    back = corpus.phi_samples(spark, str(tmp_path / "phi"), lines=True)
    assert sorted(r["seed"] for r in back.collect()) == list(range(6)) and back.select(F.explode("ground_truth")).count() == samples.select(F.explode("ground_truth")).count()
    store.write_scores(spark.createDataFrame([("Mass", 0.5), ("Hernia", 0.25)], "label string, score double"), str(tmp_path / "scores"))
    assert {(r["label"], r["score"]) for r in spark.read.parquet(str(tmp_path / "scores")).collect()} == {("Mass", 0.5), ("Hernia", 0.25)}
    assert corpus.corpus_root(["a", "b"], lambda p: p == "a/reports") == "a" and corpus.corpus_root(["a", "b"], lambda p: False) == "b"
    loads = []
    load = lambda root: loads.append(root) or spark.range(2)
    assert corpus.cached("r", load).count() == corpus.cached("r", load).count() == 2 and loads == ["r"]
    corpus.reset_cache()
    assert corpus.cached("r", load).count() == 2 and loads == ["r", "r"]
    corpus.reset_cache()
    assert archives.KINDS["tags"] == "map<string,string>"
