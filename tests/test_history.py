"""History as versions: kills, interrupts, races, compaction, retention, reads as of a version."""

from __future__ import annotations

import json
import os
import signal
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from brookloom import cli
from brookloom.operators import history
from brookloom.plans import versions
from brookloom.plans.jobs import Dataset, Parameters
from brookloom.plans.pipeline import Pipeline
from brookloom.plans.tables import claimed
from brookloom.plans.versions import History, HistoryConflict

REPO = str(Path(__file__).resolve().parent.parent)


def three(spark, root, calls, stop=None, value=0, **more):
    """a, then b, then c; ``stop``: what c does."""
    p = Pipeline(spark, root, **{"journal_seconds": 0.0} | more)

    def build(name):
        def make():
            calls.append(name)
            if name == "c" and stop:
                stop()
            return spark.range(3).withColumn("n", F.lit(name))

        return make

    jobs = [Dataset(p, n, build(n), track=False) for n in "abc"]
    jobs[0].depends_on(Parameters(p, "v", value))
    jobs[1].depends_on(jobs[0])
    jobs[2].depends_on(jobs[1])
    return p


def test_an_interrupt_keeps_what_had_ended(spark, tmp_path):
    root, calls = f"file://{tmp_path}", []

    def interrupt():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        three(spark, root, calls, interrupt).run()
    assert calls == ["a", "b", "c"] and History(spark, root).versions() == []
    assert three(spark, root, calls).run() == {"PI v": "Success", "a": "Skipped", "b": "Skipped", "c": "Success"}
    assert calls == ["a", "b", "c", "c"] and os.listdir(tmp_path / ".history/journal") == []
    assert three(spark, root, calls).run()["c"] == "Skipped"


def test_a_killed_run_is_taken_up(spark, tmp_path):
    """The process dies at once inside the third job; nothing of it runs after that."""
    script = f"""
        import os, signal, sys
        sys.path.insert(0, {REPO!r})
        from pyspark.sql import SparkSession
        from tests.test_history import three
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
        three(spark, "file://{tmp_path}/root", [], lambda: os.kill(os.getpid(), signal.SIGKILL)).run()
    """
    ended = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], capture_output=True, timeout=300, check=False)
    assert ended.returncode == -signal.SIGKILL, ended.stderr.decode()[-2000:]
    calls = []
    out = three(spark, f"file://{tmp_path}/root", calls).run()
    assert calls == ["c"] and out["b"] == "Skipped"
    assert {r.job_id for r in History(spark, f"file://{tmp_path}/root").table("edges").select(F.col("down").alias("job_id")).collect()} == {"a", "b", "c"}


def test_a_journal_that_was_published_is_not_taken_twice(spark, tmp_path):
    root, calls = f"file://{tmp_path}", []
    kept = History(spark, root)
    old = kept.journal(0, 0.0)
    old.add("x", {"x": "1"}, "d", [])
    three(spark, root, calls).run()  # takes x over, as a run that ended there
    assert {r.job_id for r in kept.table("outputs").collect()} == {"PI v", "a", "b", "c", "x"}
    for own, wanted in ((False, {"PI v", "b", "c", "x"}), (True, {"PI v", "a", "b", "c", "x"})):
        late = kept.journal(kept.manifest()["version"] if own else 0, 0.0)  # one from before another run's version: what both wrote runs again
        late.add("a", {"a": "other"}, "d", [])
        kept.recover(7)
        assert {r.job_id for r in kept.table("outputs").collect()} == wanted
    assert kept.table("outputs").where("job_id = 'a'").first().hash == "other"


def test_a_lost_claim_fails_and_leaves_nothing_wrong(spark, tmp_path):
    root, calls = f"file://{tmp_path}", []

    def other():
        three(spark, root, [], journal_seconds=9.0).run()

    first = three(spark, root, calls, other, journal_seconds=9.0)
    with pytest.raises(HistoryConflict):
        first.run()
    kept = History(spark, root)
    assert kept.versions() == [1, 2] and not list(tmp_path.glob(".history/journal/*"))
    assert sorted(os.listdir(tmp_path / ".history/changes")) == sorted(n.split("/")[1] for n in kept.manifest()["changes"])
    calls.clear()
    assert three(spark, root, calls).run()["c"] == "Success" and calls == ["a", "b", "c"]  # both had written these tables


def test_one_of_many_claims(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: claimed(spark, f"file://{tmp_path}/v/1.json", str(k)), range(24)))
    assert won.count(True) == 1 and (tmp_path / "v/1.json").read_text() == str(won.index(True))
    assert [n for n in os.listdir(tmp_path / "v") if not n.startswith(".")] == ["1.json"]


def test_only_changed_rows_are_written(spark, tmp_path):
    root = f"file://{tmp_path}"

    def declare(value):
        p = Pipeline(spark, root)
        for k in range(6):
            Dataset(p, f"d{k}", lambda k=k: spark.range(k + 1), track=False).depends_on(Parameters(p, f"p{k}", value if k == 3 else 0))
        return p

    assert set(declare(0).run().values()) == {"Success"}
    kept = History(spark, root)
    assert kept.versions() == [1]
    declare(0).run()
    assert kept.versions() == [1]  # nothing changed
    out = declare(1).run()
    assert out["d3"] == "Success" and out["d2"] == "Skipped" and kept.versions() == [1, 2]
    rows = spark.read.parquet(f"{root}/.history/{kept.manifest()['changes'][-1]}")
    # d3 gave the rows that it had given: its output stands
    assert {(r.kind, r.a, r.gone) for r in rows.collect()} == {("outputs", "PI p3", False), ("edges", "PI p3", False)}
    before = {r.output_name: r.hash for r in kept.table("outputs", 1).collect()}
    after = {r.output_name: r.hash for r in kept.table("outputs").collect()}
    assert {k for k in after if after[k] != before[k]} == {"PI p3"}


def test_compaction_and_retention(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(versions, "COMPACT", 3)
    root = f"file://{tmp_path}"
    kept = History(spark, root, kept=4)
    state, states, at = {}, {0: {}}, 0
    for step in range(1, 10):
        new = {f"j{k}": f"{step}" for k in range(step % 4 + 1)} | {f"only{step}": "x"}
        gone = [k for k in state if k.startswith("only")]
        rows = [(k, k, v, False) for k, v in new.items()] + [(k, k, None, True) for k in gone]
        at = kept.publish({"outputs": spark.createDataFrame(rows, "job_id string, output_name string, hash string, gone boolean")}, at, 100 + step)
        state = {k: v for k, v in state.items() if k not in gone} | new
        states[at] = dict(state)
    assert kept.versions() == [6, 7, 8, 9] and kept.manifest()["changes"] == [] and len(kept.manifest(8)["changes"]) == 2
    for v in kept.versions():
        assert {r.job_id: r.hash for r in kept.table("outputs", v).collect()} == states[v]
    used = {n for v in kept.versions() for n in [*kept.manifest(v)["changes"], kept.manifest(v)["snapshot"]]}
    assert {f"{f}/{n}" for f in ("changes", "snapshots") for n in os.listdir(tmp_path / ".history" / f)} == used
    cli.main(["history-diff", root, "--runs", "106", "109"])
    said = {line.split("\t")[0]: line.split("\t")[2] for line in capsys.readouterr().out.splitlines()}
    assert said == {k: "added" if k not in states[6] else "removed" if k not in states[9] else "changed" for k in states[6].keys() | states[9].keys() if states[6].get(k) != states[9].get(k)}
    cli.main(["versions", root])
    assert [line.split("\t")[:2] for line in capsys.readouterr().out.splitlines()] == [[str(v), str(100 + v)] for v in kept.versions()]
    with pytest.raises(KeyError, match="run 3"):
        kept.of_run(3)
    cli.main(["history", root, "--version", "7"])
    assert len(capsys.readouterr().out.splitlines()) == len(states[7])


def test_changes_and_latest_are_each_others_inverse(spark):
    import random

    rng = random.Random(4)
    key = lambda: (rng.choice("abc"), rng.randrange(6))
    schema = "k string, n int, v string, w int"
    old = {key(): (rng.choice(["x", None]), 1) for _ in range(12)}
    now, rows, base = dict(old), [], spark.createDataFrame([(*k, *v) for k, v in old.items()], schema)
    for version in range(1, 5):
        new = {k: v for k, v in now.items() if rng.random() < 0.7} | {key(): (rng.choice(["x", None]), version) for _ in range(4)}
        a, b = (spark.createDataFrame([(*k, *v) for k, v in d.items()], schema) for d in (now, new))
        found = history.changes(a, b, ["k", "n"]).collect()
        assert {(r.k, r.n): r.gone for r in found} == {k: k not in new for k in now.keys() | new.keys() if now.get(k) != new.get(k)}
        rows += [(r.k, r.n, r.v, r.w, r.gone, version) for r in found]
        now = new
    got = history.latest(base, spark.createDataFrame(rows, schema + ", gone boolean, version int"), ["k", "n"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((*k, *v) for k, v in now.items()), key=repr)


def test_a_journal_flushes_what_waits(spark, tmp_path):
    kept = History(spark, f"file://{tmp_path}")
    slow = kept.journal(3, 100.0)
    slow.add("a", {"a": "1"}, "d", [("u", "u", "h"), ("v", "v", None)])
    assert not (tmp_path / ".history/journal").exists()
    slow.flush()
    (file,) = [f for f in (tmp_path / ".history/journal" / slow.name).iterdir() if f.suffix == ".json" and not f.name.startswith(".")]
    assert json.loads(file.read_text())["job_id"] == "a" and slow.name.startswith("000000000003-")
    found = versions.journal_changes(spark.read.schema(versions.ENTRIES).json(f"file://{tmp_path}/.history/journal/{slow.name}"))
    assert [tuple(r) for r in found["edges"].orderBy("up").collect()] == [("u", "a", "u", "h", False), ("v", "a", "v", None, True)]
    slow.close()
    assert os.listdir(tmp_path / ".history/journal") == []


def test_changes_walked_are_those_joined(spark, tmp_path):
    """What a pass changes, from the driver's walk and from joins, over runs of random graphs with failures and renames."""
    import random

    from brookloom.plans.jobs import Job, TempDataset
    from brookloom.plans.versions import as_rows

    rng = random.Random(6)
    compared = []

    class Both(Pipeline):
        def _publish(self, looked):
            walked = sorted(map(repr, self._few_changes(looked)))
            parts = [as_rows(k, df, 0).drop("version") for k, df in self._changes(looked).items()]
            joined = sorted(repr(tuple(r)) for p in parts for r in p.collect())
            assert walked == joined
            compared.append(len(walked))
            super()._publish(looked)

    class Mark(Job):
        said = "same"

        def run(self, inputs_hash):
            if self.said == "fail":
                raise ValueError(self.job_id)
            return dict.fromkeys(self.outputs, self.said)

    class Passing(Mark):
        kind = TempDataset.kind

    for _ in range(7):
        p = Both(spark, f"file://{tmp_path}")
        jobs = []
        for k in range(12):
            if rng.random() < 0.85:
                job = rng.choice([Mark, Mark, Passing])(p, [f"j{k}", f"k{k}"] if k % 4 == 0 else [f"j{k}"])
                job.said = rng.choice(["same", "same", "same", "other", "fail"])
                above = rng.sample(jobs, min(len(jobs), rng.randrange(3)))
                job.depends_on(*[u if rng.random() < 0.6 else u.outputs[0] for u in above])
                jobs.append(job)
        p.run(raise_errors=False)
    assert len(compared) > 3 and max(compared) > 10
