"""What a run will do, told before it does: against runs of random graphs, and where ephemerals wait for each other."""

from __future__ import annotations

import copy
import dataclasses
import datetime
import decimal
import enum
import random
import re
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brookloom.functions.code import UndeclaredNonLocals, check_non_locals, function_digest, globals_read, outside
from brookloom.functions.digests import parameter_digest
from brookloom.operators import invalidation
from brookloom.operators.graph import EPHEMERAL
from brookloom.plans import pipeline as plans
from brookloom.plans.jobs import Dataset, Dump, Function, Job, Parameters, Tables, TempDataset
from brookloom.plans.pipeline import Pipeline
from brookloom.sources import files

OFFSET, NAMES, OTHER = 1, ("a", "b"), ["list"]


class Mark(Job):
    """``said``: what it gives, or fail; ``there``: whether its output is present."""

    said, there = "same", True

    def run(self, inputs_hash):
        if self.said == "fail":
            raise ValueError(self.job_id)
        return dict.fromkeys(self.outputs, self.said)

    def present(self):
        return self.there


class Passing(Mark):
    kind = EPHEMERAL


@pytest.mark.parametrize("walked", [1_000, 0])
def test_a_plan_is_what_a_run_does(spark, tmp_path, monkeypatch, walked):
    monkeypatch.setattr(plans, "WALKED", walked)
    rng = random.Random(walked)
    seen = set()
    kinds = [rng.choice([Mark, Mark, Passing]) for _ in range(16)]
    above = [rng.sample(range(k), min(k, rng.randrange(1, 4))) for k in range(16)]
    values = [0] * 16
    for turn in range(4):
        changing = turn % 2 == 1  # then every Output job that runs gives something new
        p = Pipeline(spark, f"file://{tmp_path}")
        jobs = []
        for k in range(16):
            job = kinds[k](p, [f"j{k}"]).depends_on(*[jobs[u] for u in above[k]])
            if k % 4 == 1:
                values[k] += rng.random() < 0.3
                job.depends_on(Parameters(p, f"p{k}", values[k]))
            job.there = rng.random() < 0.9
            jobs.append(job)
        plan = {r.job_id: (r.action, r.cause) for r in p.plan().collect()}
        sure = {i for i, (a, _) in plan.items() if a == "Run"}
        for job in jobs:
            # an ephemeral that runs only because it is needed has to give what it gave
            if changing and (job.kind != EPHEMERAL or plan[job.job_id][1] != "needed below"):
                job.said = f"new {turn}"
        out = p.run()
        for i, (action, cause) in plan.items():
            seen.add(action)
            may = {"Run": {"Success"}, "Skip": {"Skipped"}, "Depends": {"Success"} if changing else {"Success", "Skipped"}}
            assert out[i] in may[action], (i, action, cause, out[i])
        assert sure <= {i for i, o in out.items() if o == "Success"}
        for job in jobs:
            job.there = True
    assert seen == {"Run", "Skip", "Depends"}


def test_decisions_end(spark):
    """Taken in turn, one-step decisions end on random graphs and are what a run gives; the smallest wait was A, E, O."""
    nodes = spark.createDataFrame([("A", "Always"), ("E", "Ephemeral"), ("O", "Output")], "job_id string, kind string")
    edges = spark.createDataFrame([("A", "E"), ("E", "O")], "up string, down string")
    done = spark.createDataFrame([("A", "Success")], "job_id string, state string")
    for e, o, need, wanted in (
        ("Invalidated", "Unknown", None, {"E": "Run", "O": "Wait"}),
        ("Validated", "Validated", None, {"E": "Wait", "O": "Skip"}),
        ("Validated", "Validated", False, {"E": "Skip", "O": "Skip"}),
        ("Validated", "Invalidated", True, {"E": "Run", "O": "Wait"}),
        ("Invalidated", "Unknown", False, {"E": "Skip", "O": "Wait"}),
    ):
        valid = spark.createDataFrame([("E", e), ("O", o)], "job_id string, vstatus string")
        required = invalidation.downstream_requirement(edges, spark.createDataFrame([("E", "O", need)], "up string, down string, required boolean"))
        assert {r.job_id: r.action for r in invalidation.decisions(nodes, edges, done, valid, required).collect()} == wanted


def test_a_chain_of_passing_ephemerals_does_not_wait(spark):
    nodes = spark.createDataFrame([("A", "Always"), ("E1", "Ephemeral"), ("E2", "Ephemeral"), ("O", "Output")], "job_id string, kind string")
    edges = spark.createDataFrame([("A", "E1"), ("E1", "E2"), ("E2", "O")], "up string, down string")
    done = spark.createDataFrame([("A", "Success")], "job_id string, state string")
    valid = spark.createDataFrame([("E1", "Validated"), ("E2", "Validated"), ("O", "Validated")], "job_id string, vstatus string")
    unknown = invalidation.downstream_requirement(edges, spark.createDataFrame([], "up string, down string, required boolean"))
    assert {r.job_id: r.action for r in invalidation.decisions(nodes, edges, done, valid, unknown).collect()} == {"E1": "Wait", "E2": "Wait", "O": "Skip"}


@pytest.mark.parametrize("walked", [1_000, 0])
def test_a_failure_of_a_passed_ephemeral_flags_what_was_skipped(spark, tmp_path, monkeypatch, walked):
    monkeypatch.setattr(plans, "WALKED", walked)

    def declare(said="same", value=0):
        p = Pipeline(spark, f"file://{tmp_path}")
        e = Passing(p, ["e"])
        e.said = said
        one, two = (Mark(p, [n]).depends_on(e) for n in ("o1", "o2"))
        Mark(p, ["below o1"]).depends_on(one)
        two.depends_on(Parameters(p, "v", value))
        return p

    assert set(declare().run().values()) == {"Success"}
    out = declare("fail", 1).run(raise_errors=False)
    assert out == {"PI v": "Success", "e": "Failed", "o1": "UpstreamFailed", "o2": "UpstreamFailed", "below o1": "Skipped"}
    out = declare("same", 1).run()
    assert (out["e"], out["o1"], out["o2"], out["below o1"]) == ("Success", "Skipped", "Success", "Skipped")


def test_which_tables_are_there(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(plans, "WALKED", 0)
    root = f"file://{tmp_path}"
    calls = []

    def declare():
        p = Pipeline(spark, root)
        for n in ("a", "deep/b"):
            Dataset(p, n, lambda n=n: calls.append(n) or spark.range(3), track=False)
        Dataset(p, ["two", "more"], lambda: calls.append("two") or {"two": spark.range(1), "more": spark.range(2)}, track=False)
        Dataset(p, "none", lambda: calls.append("none") or spark.range(0), empty_ok=True, track=False)
        several = Tables(p, "several", lambda: calls.append("several") or {"x": spark.range(1), "y": spark.range(2)}, track=False)
        Dump(p, "text.tsv", several.tables).depends_on(several)
        return p

    declare().run()
    names = {r.output_name for r in files.stored_tables(spark, root).collect()}
    assert names == {"a", "deep", "deep/b", "two", "more", "none", "several", "several/x", "several/y", "text.tsv", "text.tsv/x", "text.tsv/y"}
    calls.clear()
    monkeypatch.setattr(Dataset, "present", lambda self: pytest.fail("asked for itself"))
    assert set(declare().run().values()) == {"Skipped"} and not calls
    import shutil

    for n in ("more", "none", "deep"):
        shutil.rmtree(tmp_path / n)
    monkeypatch.undo()
    monkeypatch.setattr(plans, "WALKED", 0)
    plan = {r.job_id: (r.action, r.cause) for r in declare().plan().collect()}
    assert {i: c for i, (a, c) in plan.items() if a == "Run"} == {"deep/b": "absent", "more:::two": "absent", "none": "absent"}
    out = declare().run()
    assert sorted(calls) == ["deep/b", "none", "two"] and out["a"] == "Skipped"


def test_functions_under_another_python_are_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(plans, "WALKED", 0)
    version = ["3.12"]

    class Aged(Function):
        def run(self, inputs_hash):
            found = super().run(inputs_hash)[self.job_id].split("|")
            return {self.job_id: "|".join([version[0], found[1], found[2] + version[0], found[3]])}

    def declare():
        p = Pipeline(spark, f"file://{tmp_path}")
        Mark(p, ["m"]).depends_on(Aged(p, "f", lambda: 1))
        return p

    declare().run()
    version[0] = "3.13"
    assert declare().run()["m"] == "Skipped"


# --- outside variables
def outer():
    enclosed = [1]

    def middle():
        own = 2
        return lambda x: x + own + OFFSET + len(enclosed)

    return middle


class Holder:
    def method(self, x):
        return [y + OFFSET for y in x if y]


def test_nested_code_is_looked_into():
    local = lambda: (lambda x: x + OFFSET)
    with pytest.raises(UndeclaredNonLocals, match="OFFSET"):
        check_non_locals(local)
    with pytest.raises(UndeclaredNonLocals, match="OFFSET.*enclosed|enclosed.*OFFSET"):
        check_non_locals(outer())
    assert set(outside(outer())) == {"OFFSET", "enclosed"}
    with pytest.raises(UndeclaredNonLocals, match="OFFSET"):
        check_non_locals(Holder().method)

    def comprehension():
        return {k: [v for v in NAMES] for k in range(3)}

    def generator():
        def inner():
            yield from (x for x in OTHER)

        return inner

    def with_class():
        class Inner:
            NAMES = 3
            size = OFFSET + NAMES  # its own NAMES

            def deep(self):
                return OTHER

        return Inner

    def harmless():
        class Inner:
            """Doc."""

            def size(self):
                own = len([1])
                return lambda: own + re.compile("x").groups

        return Inner, Path

    for function, names in ((comprehension, {"NAMES"}), (generator, {"OTHER"}), (with_class, {"OFFSET", "OTHER"}), (harmless, set())):
        found = {n for n in globals_read(function.__code__) if n in ("NAMES", "OTHER", "OFFSET")}
        assert found == names, function
        if names:
            with pytest.raises(UndeclaredNonLocals):
                check_non_locals(function)
        else:
            check_non_locals(function)


def test_an_allowed_constant_counts(monkeypatch):
    local = lambda: (lambda x: x + OFFSET)
    before = function_digest(local, ["OFFSET"])
    monkeypatch.setitem(globals(), "OFFSET", 50)
    assert function_digest(local, ["OFFSET"]) != before and function_digest(local) == function_digest(local, ["OTHER"])
    check_non_locals(local, ["OFFSET"])


def test_a_changed_constant_runs_again(spark, tmp_path, monkeypatch):
    def declare():
        p = Pipeline(spark, f"file://{tmp_path}")
        Dataset(p, "t", lambda: spark.range(2).selectExpr(*[f"id + {o} AS n" for o in (lambda: [OFFSET])()]), allowed=["OFFSET"])
        return p

    assert declare().run()["t"] == "Success" and declare().run()["t"] == "Skipped"
    monkeypatch.setitem(globals(), "OFFSET", 50)
    p = declare()
    assert p.run()["t"] == "Success" and p.jobs["t"].read().agg({"n": "max"}).first()[0] == 51


def test_the_example_of_the_readme_runs(spark, tmp_path):
    text = (Path(__file__).resolve().parent.parent / "README.md").read_text()
    code = re.search(r"```python\n(.*?)```", text, re.S)[1].replace("s3a://bucket", f"file://{tmp_path}")
    spark.createDataFrame([(1, 2.0), (2, 3.0), (2, None)], "k long, price double").write.parquet(f"file://{tmp_path}/lines")
    own = {"spark": spark}
    exec(compile(code, "README", "exec"), own)  # noqa: S102
    assert own["p"].run() == dict.fromkeys(own["p"].jobs, "Skipped") | {i: "Success" for i, j in own["p"].jobs.items() if j.kind == "Always"}
    assert own["p"].jobs["revenue"].read().count() == 2


def test_a_temporary_table_is_planned(spark, tmp_path):
    def declare(value):
        p = Pipeline(spark, f"file://{tmp_path}")
        temp = TempDataset(p, "temp", lambda: spark.range(2), track=False)
        Dataset(p, "out", lambda: temp.read(), track=False, allowed=["temp"]).depends_on(temp, Parameters(p, "v", value))
        return p

    declare(0).run()
    assert {r.job_id: r.action for r in declare(0).plan().collect()} == {"PI v": "Run", "temp": "Skip", "out": "Skip"}
    assert {r.job_id: (r.action, r.cause) for r in declare(1).plan().collect() if r.job_id != "PI v"} == {"temp": ("Run", "needed below"), "out": ("Run", "an input's content")}


# --- parameters
class Slotted:
    __slots__ = ("a", "b")

    def __init__(self, a):
        self.a = a


@dataclasses.dataclass
class Point:
    x: int
    y: object = None


class Colour(enum.IntEnum):
    RED = 1


plain = st.recursive(
    st.none() | st.booleans() | st.integers() | st.floats() | st.text() | st.binary(),
    lambda x: st.lists(x) | st.tuples(x) | st.dictionaries(st.text() | st.integers(), x) | st.builds(Point, st.integers(), x) | st.builds(Slotted, x),
    max_leaves=12,
)


@given(plain)
@settings(max_examples=150, deadline=None)
def test_parameters_are_told_by_their_values(value):
    assert parameter_digest(value) == parameter_digest(copy.deepcopy(value)) == parameter_digest([value][0])
    assert len({parameter_digest(x) for x in (value, [value], {"a": value}, Point(1, value), Slotted(value))}) == 5


def test_parameters_of_many_kinds():
    a = np.arange(6)
    kinds = [a, a.reshape(2, 3), a.astype("i4"), a.astype(float), np.array([1, None], object), np.float32(1), np.float64(1), 1.0, 1, True, "1", b"1", Colour.RED, Slotted(1), Point(1), Point(1, 2), Slotted(None)]
    kinds += [datetime.date(2020, 1, 1), datetime.timedelta(1), decimal.Decimal("1"), range(3), {1, 2}, {1: 2, "1": 2}, [1, 2]]
    assert len({parameter_digest(k) for k in kinds}) == len(kinds)
    assert parameter_digest(a[::2]) == parameter_digest(np.array([0, 2, 4])) and parameter_digest({1, 2}) == parameter_digest({2, 1})
    assert parameter_digest({"b": 1, "a": 2}) == parameter_digest({"a": 2, "b": 1})
    one, two = [1], [1]
    one.append(one), two.append([1, two])
    assert parameter_digest(one) == parameter_digest(copy.deepcopy(one)) != parameter_digest(two)
    ring = Point(1)
    ring.y = {"back": ring}
    assert parameter_digest(ring) == parameter_digest(copy.deepcopy(ring)) != parameter_digest(Point(1, {"back": None}))
    for refused in (len, lambda: 1, object()):
        with pytest.raises(TypeError):
            parameter_digest(refused)
