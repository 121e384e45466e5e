"""A store that pipelines share: races, dead builders, several tables of a key, equal tables, sweeping."""

from __future__ import annotations

import os
import time
from concurrent.futures import ThreadPoolExecutor

import pytest

from brookloom.functions.digests import written_digest
from brookloom.plans.jobs import JobContractError, Parameters, SharedDataset
from brookloom.plans.pipeline import Pipeline
from brookloom.sources.shared import Conflict, Store


def test_pipelines_that_race_build_once(spark, tmp_path):
    calls = []

    def run(k):
        p = Pipeline(spark, f"file://{tmp_path}/{k}")

        def build():
            calls.append(k)
            time.sleep(1)
            return {"a": spark.range(3), "b": spark.range(4)}

        job = SharedDataset(p, f"file://{tmp_path}/store", ["a", "b"], build, track=False)
        out = p.run()
        return out[job.job_id], job.read("a").count(), job.read("b").count()

    with ThreadPoolExecutor(3) as pool:
        assert list(pool.map(run, range(3))) == [("Success", 3, 4)] * 3
    assert len(calls) == 1 and not [n for n in os.listdir(tmp_path / "store/a+b/claims") if not n.startswith(".")]


def test_a_dead_builder_is_followed(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", stale=2.0, poll=0.1)

    def make(folder):
        return {"x": written_digest(spark.range(2), f"{folder}/x")[0]}

    (tmp_path / "s/claims").mkdir(parents=True)
    claim = tmp_path / "s/claims/k.000000.json"
    claim.write_text("dead")
    began = time.time()
    found = store.built("k", "me", make)
    assert time.time() - began > 1 and spark.read.parquet(store.place(found["x"])).count() == 2
    with pytest.raises(ZeroDivisionError):
        store.built("other", "me", lambda folder: 1 / 0)
    assert store.built("other", "me", make) == found  # the failed builder left the key to the next one
    assert len(os.listdir(tmp_path / "s/tables")) >= 1 and len([n for n in os.listdir(tmp_path / "s/outputs") if not n.startswith(".")]) == 1


def test_a_slow_builder_shows_that_it_lives(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", stale=1.0, poll=0.1)
    calls = []

    def make(folder):
        calls.append(folder)
        time.sleep(3)
        return {"x": written_digest(spark.range(2), f"{folder}/x")[0]}

    with ThreadPoolExecutor(2) as pool:
        one, two = pool.map(lambda k: store.built("k", str(k), make), range(2))
    assert one == two and len(calls) == 1


def test_equal_inputs_give_equal_tables(spark, tmp_path):
    n = [2]

    def declare():
        p = Pipeline(spark, f"file://{tmp_path}/p")
        return p, SharedDataset(p, f"file://{tmp_path}/store", "s", lambda: spark.range(n[0]), track=False).depends_on(Parameters(p, "x", 1))

    p, job = declare()
    p.run()
    import shutil

    shutil.rmtree(tmp_path / "store/s/tables")
    n[0] = 3
    p, job = declare()
    p.run(raise_errors=False)
    assert isinstance(job.error, JobContractError) and isinstance(job.error.__cause__, Conflict)
    n[0] = 2
    p, job = declare()
    assert p.run()[job.job_id] == "Success" and job.read().count() == 2


def test_grace(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", grace=3_600.0)
    for k in ("k1", "k2"):
        store.use("pipe", k)
        store.built(k, "me", lambda folder, k=k: {"x": written_digest(spark.range(len(k) + int(k[1])), f"{folder}/x")[0]})
    assert store.sweep() == []
    old = time.time() - 7_200
    for n in os.listdir(tmp_path / "s/outputs"):
        os.utime(tmp_path / "s/outputs" / n, (old, old))
    orphan = tmp_path / "s/tables/k9-dead"
    orphan.mkdir()
    os.utime(orphan, (old, old))
    assert len(store.sweep()) == 1 and store.found("k1") is None and store.found("k2") and not orphan.exists()
