"""Paid calls: asked once, whatever fails; the one rewrite of a draft; what stages tell the driver."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from tessella.config import Settings
from tessella.plans import ledger, models, studies
from tessella.plans.trace import Trace
from tessella.sources import store
from test_engine import cases


def asked_of(path):
    return sorted(path.read_text().splitlines()) if path.exists() else []


def counting(path, reply=lambda p: p.upper(), die=None, flag=None):
    """A client that writes every prompt it answers to a file; it dies once where it meets die."""

    def client(prompts, paths):
        out = []
        for p in prompts:
            if p == die and not os.path.exists(flag):
                open(flag, "w").close()
                os._exit(1)
            out.append(reply(p))
        with open(path, "a") as f:
            f.writelines(f"{p}\n" for p in prompts)
        return out

    return client


def test_each_call_is_paid_once_across_failures_and_runs(spark, tmp_path):
    log, flag = tmp_path / "log", str(tmp_path / "flag")
    rows = spark.range(60).select((F.col("id") % 40).alias("n"), F.concat(F.lit("p"), F.col("id") % 40).alias("prompt"), F.lit("film").alias("film")).repartition(4)
    kept = ledger.Ledger(spark, str(tmp_path / "ledger"), shards=4, batch=1)
    with pytest.raises(Exception):  # the worker dies, and with it the run: a local master does not try tasks again
        kept.answered(rows, counting(log, die="p17", flag=flag), F.col("prompt"), F.col("film"))
    before = asked_of(log)
    assert 0 < len(before) < 40 and len(set(before)) == len(before)
    again = ledger.Ledger(spark, str(tmp_path / "ledger"), shards=4, batch=1)
    got = again.answered(rows, counting(log, die="p17", flag=flag), F.col("prompt"), F.col("film")).collect()
    assert len(got) == 60 and all(r["said"]["reply"] == r["prompt"].upper() and r["said"]["error"] is None for r in got)
    assert asked_of(log) == sorted(f"p{k}" for k in range(40))
    assert again.answered(rows, counting(log), F.col("prompt"), F.col("film")).count() == 60 and len(asked_of(log)) == 40
    again.answered(rows.limit(1), counting(log), F.col("prompt"), F.col("film"), attempt=2)
    again.answered(rows.limit(1), counting(log), F.col("prompt"), F.col("film"), name="other")
    assert len(asked_of(log)) == 42


def test_a_retried_task_reads_its_shard_first(spark, tmp_path):
    """Calls of a first attempt that Spark does not see, as its task was lost, are not paid again."""
    log = tmp_path / "log"
    rows = spark.range(8).select(F.concat(F.lit("p"), "id").alias("prompt"), F.lit(None).cast("string").alias("film"))
    kept = ledger.Ledger(spark, str(tmp_path / "ledger"), shards=1)
    first = kept.replies
    kept.replies = lambda folder: first(folder).limit(0)  # as if nothing had been there when the plan was made
    kept.answered(rows, counting(log), F.col("prompt"), F.col("film"))
    kept.answered(rows, counting(log), F.col("prompt"), F.col("film"))
    assert len(asked_of(log)) == 8


def test_errors_are_kept_but_asked_again(spark, tmp_path):
    log = tmp_path / "log"
    rows = spark.createDataFrame([("good",), ("bad",), (None,)], "prompt string").withColumn("film", F.lit("f"))
    kept = ledger.Ledger(spark, str(tmp_path / "ledger"), shards=1, batch=1)

    def fails(p):
        if p == "bad":
            raise ValueError("no reply")
        return p + "!"

    got = {r["prompt"]: r["said"] for r in kept.answered(rows, counting(log, fails), F.col("prompt"), F.col("film")).collect()}
    assert got["good"]["reply"] == "good!" and got[None]["reply"] == "!" and got["bad"]["reply"] is None and got["bad"]["error"] == "ValueError: no reply"
    got = {r["prompt"]: r["said"] for r in kept.answered(rows, counting(log), F.col("prompt"), F.col("film")).collect()}
    assert got["bad"]["reply"] == "BAD" and got["bad"]["error"] is None and asked_of(log) == ["", "bad", "good"]
    assert kept.answered(rows.limit(0), counting(log), F.col("prompt"), F.col("film")).count() == 0


def test_a_slow_prompt_costs_its_batch_alone():
    slow = lambda prompts, paths: [__import__("time").sleep(9 if "slow" in prompts else 0) or p for p in prompts]
    assert ledger.ask(slow, ["a", "b"], ["", ""], 0.3) == (["a", "b"], None)
    said, error = ledger.ask(slow, ["slow", "b"], ["", ""], 0.1, 0)
    assert said == [None, None] and error.startswith("TimeoutError")


def writer(path, second):
    """Cites what is not there in its first reply to a prompt; the second reply is given."""

    def client(prompts, paths):
        out = []
        for p in prompts:
            mark = path / hashlib.sha256(p.encode()).hexdigest()
            ids = ["gone"] if not mark.exists() and "Cardiomegaly" in p else p.split("evidence_id: ")[1].split(" ")[:1] if "evidence_id: " in p else ["cnn:Mass"]
            out.append(second if mark.exists() and second else json.dumps({s: [{"text": f"{s} {ids[0]}.", "evidence_ids": ids}] for s in ("technique", "findings", "impression", "recommendation")}))
            mark.touch()
        with open(path / "log", "a") as f:
            f.writelines("x\n" for _ in prompts)
        return out

    return client


@pytest.mark.parametrize("second, text", [(None, "technique vlm:Cardiomegaly."), ("not a report", models.TECHNIQUE)])
def test_a_draft_in_violation_is_written_once_more(spark, tmp_path, second, text):
    kept = ledger.Ledger(spark, str(tmp_path / "ledger"), shards=2)
    clients = models.Clients(writer=writer(tmp_path, second))
    got = {r["study_id"]: r for r in studies.run(*cases(spark), clients=clients, ledger=kept).collect()}
    assert {k: r["retried"] for k, r in got.items()} == {k: k == "s3" for k in got}
    assert got["s3"]["draft"][0]["text"] == text and got["s3"]["removed"] == 0 and len(got["s3"]["draft"]) >= 4
    assert len((tmp_path / "log").read_text().splitlines()) == 4  # three that pass, one of them twice
    assert ("the written report lacked a section" in got["s3"]["notes"]) == (second is not None)
    if second is None:  # another run pays nothing
        again = {r["study_id"]: r for r in studies.run(*cases(spark), clients=clients, ledger=kept).collect()}
        assert again["s3"]["draft"] == got["s3"]["draft"] and len((tmp_path / "log").read_text().splitlines()) == 4


def test_live_settings_without_clients_raise(spark):
    with pytest.raises(ValueError):
        studies.run(*cases(spark), Settings(use_live_models=True))
    with pytest.raises(ValueError):
        studies.run(*cases(spark), Settings(use_live_models=True), clients=models.Clients(reader=lambda p, q: p))


def test_stages_are_traced_once_and_leave_masked(spark, tmp_path):
    trace = Trace()
    kept = ledger.Ledger(spark, str(tmp_path / "ledger"), shards=2, trace=trace)
    clients = models.Clients(arbiter=lambda p, q: ["Patient John Smith, call 313-555-0199" if "Mass" in x else 1 / 0 for x in p], reader=lambda p, q: ['[{"label": "mass"}]'] * len(p))
    rules = spark.createDataFrame([(0, "mass unique: compare"), (1, "heart")], "ord int, text string")
    assert studies.run(*cases(spark), clients=clients, guidelines=rules, ledger=kept).count() == 5
    spans = {r["name"]: r for r in trace.spans(spark).collect()}
    assert set(spans) == {"reader", "arbiter", "retrieve-guidelines"} and trace.spans(spark).count() == 0
    assert spans["reader"]["rows"] == 3 and spans["reader"]["errors"] == 0 and spans["reader"]["seconds"] >= 0 and spans["reader"]["input_chars"] > 100
    assert spans["arbiter"]["errors"] == spans["arbiter"]["rows"] > 0 and spans["retrieve-guidelines"]["rows"] > 0
    trace.watch(spark.range(3), "never run")
    trace.wait = 0.2
    assert trace.spans(spark).count() == 0
    out = []
    told = spark.createDataFrame([("arbiter", "Patient: John Smith, call 313-555-0199")], "name string, text string")
    assert store.export(told, "a", "b", lambda df: out.extend(df.collect())) and "Smith" not in out[0]["text"] and "0199" not in out[0]["text"]
