"""Behaviour of the incremental pipeline: how often each job's function is called."""

from __future__ import annotations

import os
import collections

import pytest

from brookloom.plans.jobs import (
    Attribute,
    Dataset,
    Entry,
    EphemeralChanged,
    External,
    File,
    JobContractError,
    JobGenerating,
    JobList,
    JobRedefinition,
    Loading,
    NotADag,
    OutputConflict,
    Parameters,
    TempDataset,
    ValuePlusHash,
    another_plot,
    cached,
    cached_in,
    flatten_jobs,
    force_load,
    job_or_filename,
    plot,
    shell,
)
from brookloom.functions.code import UndeclaredNonLocals
from brookloom.plans import pipeline as planning
from brookloom.plans.pipeline import JobsFailed, Pipeline


class Setup:
    """Declares the same jobs again and again, as a script does that is started anew."""

    def __init__(self, spark, root):
        self.spark, self.root, self.calls = spark, f"file://{root}", collections.Counter()
        self.values = {}

    def new(self, **more):
        return Pipeline(self.spark, self.root, **more)

    def rows(self, name, value=None):
        def build():
            self.calls[name] += 1
            if isinstance(self.values.get(name), Exception):
                raise self.values[name]
            return self.spark.createDataFrame([(self.values.get(name, value or name),)], "v string")

        return build


@pytest.fixture()
def setup(spark, tmp_path):
    return Setup(spark, tmp_path)


@pytest.fixture(params=[1_000, 0], ids=["walked whole", "asked of Spark"])
def walked(request, monkeypatch):
    """Small graphs planned as large ones are, as well."""
    monkeypatch.setattr(planning, "WALKED", request.param)


def chain(s, param="p", order="abc"):
    p = s.new()
    up = Parameters(p, "x", param)
    jobs = {}
    for i, name in enumerate(order):
        jobs[name] = Dataset(p, name, s.rows(name), track=False)
        jobs[name].depends_on(up if i == 0 else jobs[order[i - 1]])
    return p, jobs


def test_second_run_skips(walked, setup):
    p, _ = chain(setup)
    assert set(p.run().values()) == {"Success"}
    p, jobs = chain(setup)
    assert {j: o for j, o in p.run().items() if j in "abc"} == dict.fromkeys("abc", "Skipped")
    assert setup.calls == {"a": 1, "b": 1, "c": 1}
    assert jobs["c"].read().collect()[0][0] == "c"


def test_early_cutoff_where_an_output_stays_equal(walked, setup):
    chain(setup)[0].run()
    assert chain(setup, "q")[0].run()["a"] == "Success"
    assert setup.calls == {"a": 2, "b": 1, "c": 1}


def test_change_goes_down(walked, setup):
    chain(setup)[0].run()
    setup.values = {"a": "other"}
    chain(setup, "q")[0].run()
    assert setup.calls == {"a": 2, "b": 2, "c": 1}  # b's own output is the same again


def test_missing_output_is_rebuilt(walked, setup, tmp_path):
    import shutil

    chain(setup)[0].run()
    shutil.rmtree(tmp_path / "b")
    chain(setup)[0].run()
    assert setup.calls == {"a": 1, "b": 2, "c": 1}


def test_failure_stops_what_depends_on_it_only(walked, setup):
    setup.values = {"b": ValueError("no")}
    p, _ = chain(setup)
    other = Dataset(p, "z", setup.rows("z"), track=False)
    assert p.run(raise_errors=False) | {} == {"PI x": "Success", "a": "Success", "b": "Failed", "c": "UpstreamFailed", "z": "Success"}
    assert other.outcome == "Success" and isinstance(p.jobs["b"].error, ValueError) and p.jobs["b"].failed
    setup.values = {}
    p, _ = chain(setup)
    p.run()
    assert setup.calls == {"a": 1, "b": 2, "c": 1, "z": 1}
    setup.values = {"a": ValueError("no")}
    with pytest.raises(JobsFailed):
        chain(setup, "new")[0].run()


def temp_chain(s, param="p"):
    p = s.new()
    t = TempDataset(p, "t", s.rows("t"), track=False).depends_on(Parameters(p, "x", param))
    out = Dataset(p, "out", s.rows("out"), track=False).depends_on(t)
    return p, t, out


def test_ephemeral_runs_only_when_needed_and_is_deleted(walked, setup, tmp_path):
    temp_chain(setup)[0].run()
    assert setup.calls == {"t": 1, "out": 1} and not (tmp_path / "t").exists()
    assert temp_chain(setup)[0].run()["t"] == "Skipped"
    assert setup.calls == {"t": 1, "out": 1}
    import shutil

    shutil.rmtree(tmp_path / "out")
    temp_chain(setup)[0].run()
    assert setup.calls == {"t": 2, "out": 2}


def test_ephemeral_without_consumers_never_runs(setup):
    p = setup.new()
    TempDataset(p, "t", setup.rows("t"), track=False)
    assert p.run()["t"] == "Skipped" and not setup.calls


def test_constant_input_must_give_constant_output(walked, setup, tmp_path):
    import shutil

    temp_chain(setup)[0].run()
    shutil.rmtree(tmp_path / "out")
    setup.values = {"t": "changed"}
    p, t, _ = temp_chain(setup)
    assert p.run(raise_errors=False)["out"] == "UpstreamFailed" and isinstance(t.error, EphemeralChanged)


def test_failed_consumer_keeps_the_ephemeral(setup, tmp_path):
    setup.values = {"out": ValueError("no")}
    temp_chain(setup)[0].run(raise_errors=False)
    assert (tmp_path / "t").exists()


def test_partial_dependency(walked, setup):
    def declare(b):
        p = setup.new()

        def build():
            setup.calls["m"] += 1
            return {"a": setup.spark.range(1), "b": setup.spark.range(b)}

        m = Dataset(p, ["a", "b"], build, track=False).depends_on(Parameters(p, "x", b))
        Dataset(p, "of_a", setup.rows("of_a"), track=False).depends_on("a")
        Dataset(p, "of_b", setup.rows("of_b"), track=False).depends_on("b")
        assert m.upstreams[0].job_id == "PI x"
        return p

    declare(1).run()
    declare(2).run()
    assert setup.calls == {"m": 2, "of_a": 1, "of_b": 2}


def test_absent_jobs_resume(walked, setup):
    chain(setup)[0].run()
    p = setup.new()
    Parameters(p, "x", "p")
    p.run()
    assert chain(setup)[0].run()["c"] == "Skipped"


def test_changed_input_set(walked, setup):
    chain(setup)[0].run()
    p, jobs = chain(setup)
    jobs["c"].depends_on("a")
    p.run()
    assert setup.calls == {"a": 1, "b": 1, "c": 2}


def test_function_changes_and_closures(setup, spark):
    def declare(n):
        p = setup.new()

        def build():
            setup_calls.append(n)
            return spark.range(n)

        setup_calls = []
        return p, Dataset(p, "d", build, allowed=["n", "setup_calls"]), setup_calls

    p, _, calls = declare(1)
    p.run()
    p, _, calls = declare(2)
    p.run()
    assert calls == [2]


def test_contracts(setup, spark):
    p = setup.new()
    empty = Dataset(p, "e", lambda: spark.range(0), track=False)
    wrong = Dataset(p, "w", lambda: {"other": spark.range(1)}, track=False)
    none = Loading(p, "n", lambda: None, track=False)
    Dataset(p, "of_n", setup.rows("of_n"), track=False).depends_on(none)
    p.run(raise_errors=False)
    assert all(isinstance(j.error, JobContractError) for j in (empty, wrong, none))
    with pytest.raises(OutputConflict):
        Dataset(p, ["e", "f"], lambda: None, track=False)
    with pytest.raises(NotADag):
        empty.depends_on("e")
    Parameters(p, "q", 1)
    with pytest.raises(JobRedefinition):
        Parameters(p, "q", 2)
    with pytest.raises(TypeError):
        Parameters(p, "f", len)
    with pytest.raises(ValueError, match="names|name"):
        Dataset(p, "a:::b", lambda: None, track=False)
    with pytest.raises(TypeError):
        empty.depends_on(3)


def test_cycles(setup):
    p = setup.new()
    a, b, c = (Dataset(p, x, setup.rows(x), track=False) for x in "abc")
    a.depends_on(b)
    with pytest.raises(NotADag):
        b.depends_on(a)
    b.depends_on(c)
    c.depends_on(a)
    with pytest.raises(NotADag):
        p.run()


def test_generated_jobs_and_deferred_dependencies(walked, setup):
    p = setup.new()

    def more():
        Dataset(p, "late", setup.rows("late"), track=False)

    JobGenerating(p, "gen", more, track=False)
    Dataset(p, "d", setup.rows("d"), track=False).depends_on(lambda: Parameters(p, "deferred", 1))
    out = p.run()
    assert out["late"] == "Success" and "PI deferred" in out


def test_focus_and_prune(setup):
    p, jobs = chain(setup)
    assert p.run([jobs["b"]])["c"] == "Pruned" and setup.calls == {"a": 1, "b": 1}
    p.prune(jobs["b"])
    assert p.run()["b"] == "Pruned" and p.outcomes["c"] == "Pruned"
    p.unprune(jobs["b"])
    assert p.run()["c"] == "Success" and p.status()["Success"] >= 1


def test_file_inputs(setup, tmp_path):
    f = tmp_path / "in.txt"
    f.write_text("one")

    def declare():
        p = setup.new()
        Dataset(p, "d", setup.rows("d"), track=False).depends_on(File(p, f"file://{f}"))
        return p

    declare().run()
    declare().run()
    f.write_text("two")
    declare().run()
    assert setup.calls == {"d": 2}
    f.unlink()
    assert isinstance(next(iter(_errors(declare()).values())), FileNotFoundError)


def _errors(p):
    p.run(raise_errors=False)
    return p.errors


def test_loaders(setup, spark):
    class Box:
        pass

    box, seen = Box(), []
    p = setup.new()
    at = Attribute(p, "at", box, "table", lambda: spark.range(3), track=False)
    Dataset(p, "d", lambda: spark.range(box.table.count()), track=False).depends_on(at)
    load, calc = cached(p, "c", lambda: spark.range(4), lambda df: seen.append(df.count()), allowed=["seen"])
    Dataset(p, "e", lambda: spark.range(seen[0]), track=False).depends_on(load)
    vp = Loading(p, "vp", lambda: ValuePlusHash(5, "abc"), track=False)
    Dataset(p, "f", setup.rows("f"), track=False).depends_on(vp)
    assert set(p.run().values()) == {"Success"}
    assert not hasattr(box, "table") and seen == [4] and calc.read().count() == 4


def test_plot_external_and_shell(setup, spark, tmp_path):
    p = setup.new()
    folder = tmp_path / "ext"
    plot(p, "pl", lambda: spark.range(5), lambda pdf, path: open(path, "w").write(str(len(pdf))), str(tmp_path / "p.png"))
    External(p, str(folder), ["x.txt"], ["sh", "-c", "echo hi; echo 1 > x.txt"])
    shell(p, str(tmp_path / "sh"), ["y.txt"], "#!/bin/sh\necho 2 > y.txt\n")
    bad = External(p, str(tmp_path / "bad"), [], ["false"])
    out = p.run(raise_errors=False)
    assert bad.failed and list(p.errors) == [bad.job_id], p.errors
    assert set(out.values()) == {"Success", "Failed"}
    assert (folder / "stdout.txt").read_text() == "hi\n" and (tmp_path / "p.png").read_text() == "5"
    assert spark.read.csv(f"file://{tmp_path}/pl.tsv", header=True, sep="\t").count() == 5


def test_events_are_followed(setup, spark):
    from brookloom.streaming import events

    p, _ = chain(setup)
    p.report = True
    p.run()
    stream = events.outcome_counts(events.followed(spark, f"{setup.root}/.events")).writeStream.format("memory").queryName("followed").outputMode("complete").start()
    stream.processAllAvailable()
    stream.stop()
    assert {r.outcome: r.n for r in spark.sql("SELECT outcome, sum(n) AS n FROM followed GROUP BY outcome").collect()} == {"Success": 4}


def test_shared_datasets(spark, tmp_path):
    from brookloom.plans.jobs import SharedDataset

    calls, n = [], [2]

    def declare(root, value):
        p = Pipeline(spark, f"file://{tmp_path}/{root}")

        def build():
            calls.append(root)
            return spark.range(n[0])

        return p, SharedDataset(p, f"file://{tmp_path}/store", "s", build, track=False, grace=0.0).depends_on(Parameters(p, "x", value))

    for root, value in (("one", 1), ("two", 1), ("one", 1)):
        p, job = declare(root, value)
        p.run()
        assert job.read().count() == 2
    assert calls == ["one"]
    n[0] = 3
    for root in ("one", "two"):
        p, job = declare(root, 2)
        p.run()
    assert calls == ["one", "one"] and job.read().count() == 3
    # what the first two used is swept by itself with the next build
    assert len(os.listdir(tmp_path / "store/s/tables")) == 2
    n[0] = 4
    p, job = declare("one", 3)
    p.run()
    assert len(os.listdir(tmp_path / "store/s/tables")) == 2 and declare("two", 2)[1].read().count() == 3
    assert job.remove_unused() == [] and job.read().count() == 4


def test_command_line(setup, tmp_path, capsys, spark):
    from brookloom import cli

    chain(setup)[0].run()
    import shutil

    shutil.copytree(tmp_path / ".history", tmp_path / "older" / ".history")
    setup.values = {"a": "other"}
    chain(setup, "q")[0].run()
    cli.main(["history-diff", f"file://{tmp_path}/older", f"file://{tmp_path}"])
    assert "PI x" in capsys.readouterr().out
    cli.main(["forget", f"file://{tmp_path}", "b", "--yes"])
    chain(setup, "q")[0].run()
    assert setup.calls["b"] == 3
    setup.spark.createDataFrame([("there",)], "v string").write.parquet(f"file://{tmp_path}/there")
    cli.main(["record", f"file://{tmp_path}", "there", "b"])
    p, jobs = chain(setup, "q")
    Dataset(p, "there", setup.rows("there"), track=False)
    assert p.run()["there"] == "Skipped" and jobs["b"].outcome == "Skipped" and "there" not in setup.calls
    cli.main(["hash-file", f"file://{tmp_path}/a/_SUCCESS"])
    cli.main(["history", f"file://{tmp_path}"])
    assert "PI x" in capsys.readouterr().out


def test_folders_of_files(walked, setup, tmp_path, monkeypatch):
    from brookloom.sources import files

    folder = tmp_path / "in"
    for k in (1, 2):
        (folder / f"d={k}").mkdir(parents=True)
        (folder / f"d={k}" / "a.txt").write_text(str(k))
    (tmp_path / "other.txt").write_text("x")
    opened = []
    hashed = files.hashed_by_name
    monkeypatch.setattr(files, "hashed_by_name", lambda spark, which: opened.append(len(which)) or hashed(spark, which))

    def declare():
        p = setup.new()
        Dataset(p, "d", setup.rows("d"), track=False).depends_on(File(p, f"file://{folder}"))
        Dataset(p, "o", setup.rows("o"), track=False).depends_on(File(p, tmp_path / "other.txt"))
        return p

    declare().run()
    declare().run()
    assert opened == [0] and setup.calls == {"d": 1, "o": 1}
    (folder / "d=1" / "a.txt").write_text("22")
    (folder / "d=2" / "a.txt").write_text("11")
    declare().run()
    assert opened == [0, 2] and setup.calls == {"d": 2, "o": 1}


def test_dependencies_of_many_kinds(setup, tmp_path):
    p = setup.new()
    a, b, c, d = (Dataset(p, x, setup.rows(x), track=False) for x in "abcd")
    pair = cached(p, "k", setup.rows("k"), print, allowed=["self", "name", "value"])
    with pytest.raises(TypeError, match="load, calc"):
        d.depends_on(pair)
    from pathlib import Path

    d.depends_on((x for x in (a, [b])), {"c": c}.values(), Path("a"), None, pair.load)
    assert {u.job_id for u in d.upstreams} == {"a", "b", "c", "k"} and p.has_edge(a, "d") and not p.has_edge(d, a)
    assert [j.job_id for j in p.find("^[ab]$")] == ["a", "b"] and flatten_jobs([a, [b, (c,)]]) == [a, b, c]
    e, f = Dataset(p, "e", setup.rows("e"), track=False), Dataset(p, "f", setup.rows("f"), track=False)
    JobList([e, f]).depends_on(a, b)
    assert p.has_edge(a, e) and p.has_edge(b, f)
    assert job_or_filename(p, "a") == ("a", [a]) and job_or_filename(p, e) == ("e", [e])
    name, jobs = job_or_filename(p, f"{tmp_path}/y/../x.txt")
    assert name == str(tmp_path / "x.txt") and isinstance(jobs[0], File)
    p.unique(setup, "one")
    with pytest.raises(ValueError, match="one"):
        p.unique(setup, "one")


def test_undeclared_outside_variables(setup, spark):
    p, seven = setup.new(), 7
    with pytest.raises(UndeclaredNonLocals):
        Dataset(p, "d", lambda: spark.range(seven))
    Dataset(p, "e", lambda: spark.range(seven), allowed=["seven"])


def test_temporary_tables_that_are_still_there(setup, tmp_path):
    setup.values = {"out": ValueError("no")}
    temp_chain(setup)[0].run(raise_errors=False)
    setup.values = {}
    temp_chain(setup)[0].run()
    assert setup.calls == {"t": 1, "out": 2} and not (tmp_path / "t").exists()


def test_values_that_are_still_loaded(setup, spark):
    box, calls, fail = {}, [], [True]

    def declare(value):
        p = setup.new()

        def load():
            calls.append(value)
            return spark.range(value)

        def use():
            if fail[0]:
                raise ValueError("no")
            return spark.range(box["t"].count())

        at = Entry(p, "at", box, "t", load, track=False).depends_on(Parameters(p, "n", value))
        Dataset(p, "d", use, track=False).depends_on(at)
        return p

    declare(3).run(raise_errors=False)
    declare(3).run(raise_errors=False)
    assert calls == [3] and box["t"].count() == 3
    declare(4).run(raise_errors=False)
    fail[0] = False
    declare(4).run()
    assert calls == [3, 4] and box == {}


def test_cached_attributes_and_entries(setup, spark):
    class Box:
        pass

    box, place, n = Box(), {}, [3]
    def declare(value):
        p = setup.new()
        one = cached_in(Attribute, p, "at", box, "t", lambda: spark.range(n[0]), allowed=["n"])
        two = cached_in(Entry, p, "en", place, "t", lambda: spark.range(n[0]), allowed=["n"])
        two.calc.depends_on(Parameters(p, "n", value))

        def build():
            setup.calls["d"] += 1
            return spark.range(box.t.count() + place["t"].count())

        Dataset(p, "d", build, track=False).depends_on(one.load, two.load)
        return p

    declare(1).run()
    declare(2).run()  # calculated again, the same rows
    assert setup.calls == {"d": 1} and not hasattr(box, "t") and place == {}
    p = setup.new()
    job = cached_in(Entry, p, "fo", place, "u", lambda: spark.range(2)).load
    force_load(job)
    p.run()
    assert job.outcome == "Success"


def test_plots_of_several_tables(setup, spark, tmp_path):
    p = setup.new()
    seen = []

    def draw(tables, path):
        seen.append({k: len(t) for k, t in tables.items()} if isinstance(tables, dict) else len(tables))
        open(path, "w").write("x")

    jobs = plot(p, "two", lambda: {"a": spark.range(2), "b": spark.range(3)}, draw, str(tmp_path / "1.png"), allowed=["seen"])
    another_plot(jobs, draw, str(tmp_path / "2.png"), ["seen"])
    bare = plot(p, "bare", lambda: spark.range(4), draw, str(tmp_path / "3.png"), cache_calc=False, create_table=False, allowed=["seen"])
    another_plot(bare, draw, str(tmp_path / "4.png"), ["seen"])
    assert bare.cache is None and bare.table is None
    p.run()
    assert sorted(map(str, seen)) == ["4", "4", "{'a': 2, 'b': 3}", "{'a': 2, 'b': 3}"]
    assert spark.read.csv(f"file://{tmp_path}/two.tsv/b", header=True, sep="\t").count() == 3


def test_external_calls_around_the_command(setup, tmp_path):
    p, seen = setup.new(), []
    External(p, str(tmp_path / "x"), ["y.txt"], ["sh", "-c", "cat in > y.txt; echo out"], prefix="run_", before=lambda job: open(f"{job.folder}/in", "w").write("hi"), after=lambda job: seen.append(job.folder), own_session=True, allowed=["seen"])
    shell(p, str(tmp_path / "sh"), ["z.txt"], lambda: "#!/bin/sh\necho 3 > z.txt\n")
    p.run()
    assert (tmp_path / "x/y.txt").read_text() == "hi" and (tmp_path / "x/run_stdout.txt").read_text() == "out\n" and seen == [str(tmp_path / "x")]
    assert (tmp_path / "sh/z.txt").read_text() == "3\n"


def test_errors_are_kept_of_some_runs(setup, tmp_path):
    import os

    setup.values = {"a": ValueError("no")}
    for _ in range(3):
        p, _ = chain(setup)
        p.kept_runs = 2
        p.run(raise_errors=False)
    rows = p.stored_errors().collect()
    assert len(rows) == 2 and {(r.job_id, r.error, r.message) for r in rows} == {("a", "ValueError", "no")} and "build" in rows[0].trace
    here = os.getcwd()
    p = setup.new()
    Dataset(p, "w", lambda: os.chdir(tmp_path) or setup.spark.range(1), track=False)
    p.run(raise_errors=False)
    assert isinstance(p.jobs["w"].error, JobContractError) and os.getcwd() == here


def test_a_stopped_rename_loses_nothing(spark, tmp_path):
    from brookloom.plans.tables import recovered, rename

    for name, text in (("new", "2"), ("x.old", "1")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f").write_text(text)
    recovered(spark, f"file://{tmp_path}/x")
    assert (tmp_path / "x/f").read_text() == "1"
    rename(spark, f"file://{tmp_path}/new", f"file://{tmp_path}/x")
    assert (tmp_path / "x/f").read_text() == "2" and not (tmp_path / "x.old").exists()


def test_a_wide_graph_runs_what_changed(setup):
    """A graph beyond what is walked whole: only changed jobs and what lies below are looked at."""
    from brookloom.plans.jobs import Job

    class Mark(Job):
        def run(self, inputs_hash):
            setup.calls[self.job_id] += 1
            return {self.job_id: setup.values.get(self.job_id, "same")}

    def declare(n=1_500):
        p = setup.new()
        last = Mark(p, ["last"])
        for i in range(n):
            last.depends_on(Mark(p, [f"f{i:05}"]).depends_on(Parameters(p, f"p{i % 10}", setup.values.get(f"p{i % 10}", 0))))
        return p

    declare().run()
    assert sum(setup.calls.values()) == 1_501
    setup.calls.clear()
    assert set(declare().run().values()) == {"Success", "Skipped"} and not setup.calls
    setup.values = {"p3": 1, "f00003": "other"}
    out = declare().run()
    assert len(setup.calls) == 151 and setup.calls["last"] == 1 and out["f00003"] == "Success" and out["f00004"] == "Skipped"


def test_datasets_that_do_not_need_each_other_run_at_once(setup):
    import threading

    spark, started = setup.spark, collections.Counter()

    def declared(at_once, wait):
        p = Pipeline(spark, f"{setup.root}-{at_once}", at_once=at_once)

        def build(name, fails=False):
            def run():
                started[at_once, name] += 1
                if name in "abc" and wait is not None:
                    wait.wait(60)
                if fails:
                    raise ValueError(name)
                return spark.range(3)

            return run

        temp = TempDataset(p, "temp", build("temp"), track=False)
        some = [Dataset(p, n, build(n, n == "b"), track=False).depends_on(temp) for n in "abc"]
        for job in some:
            Dataset(p, f"below {job.job_id}", build(job.job_id * 2), track=False).depends_on(job)
        return p

    found = {}
    for at_once in (1, 3):
        p = declared(at_once, threading.Barrier(3) if at_once > 1 else None)
        found[at_once] = p.run(raise_errors=False), set(p.errors), sorted(p.now)
        again = declared(at_once, None).run(raise_errors=False)
        assert (again["a"], again["b"], again["below c"]) == ("Skipped", "Failed", "Skipped")
    assert found[1] == found[3] and found[3][0]["below b"] == "UpstreamFailed" and found[3][1] == {"b"}
    assert started[3, "temp"] == started[1, "temp"] and started[3, "a"] == 1


def test_jobs_that_ended_before_an_interrupt_are_kept_also_at_once(setup):
    spark = setup.spark

    def declared(stop):
        p = Pipeline(spark, f"{setup.root}-stopped", at_once=2, journal_seconds=0)

        def bad():
            if stop:
                raise KeyboardInterrupt
            return spark.range(2)

        first = [Dataset(p, n, lambda: spark.range(2), track=False) for n in "ab"]
        Dataset(p, "c", bad, track=False).depends_on(*first)
        return p

    with pytest.raises(KeyboardInterrupt):
        declared(True).run()
    assert declared(False).run() == {"a": "Skipped", "b": "Skipped", "c": "Success"}


def test_a_changed_working_directory_fails_also_at_once(setup, tmp_path):
    here = os.getcwd()
    p = Pipeline(setup.spark, f"{setup.root}-cwd", at_once=2)
    Dataset(p, "w", lambda: os.chdir(tmp_path) or setup.spark.range(1), track=False)
    Dataset(p, "x", lambda: setup.spark.range(1), track=False)
    found = p.run(raise_errors=False)
    assert found["w"] == "Failed" and os.getcwd() == here and isinstance(p.errors["w"], JobContractError)


def test_a_picture_of_too_many_rows_fails_before_it_is_read(setup, tmp_path):
    from brookloom.plans.jobs import Picture

    p = setup.new()
    picture = Picture(p, str(tmp_path / "x.png"), lambda: {"": setup.spark.range(11)}, lambda df, path: open(path, "w").close())
    picture.most_rows = 10
    p.run(raise_errors=False)
    assert "aggregate" in str(picture.error) and not (tmp_path / "x.png").exists()
    picture.most_rows = 11
    p.run()
    assert (tmp_path / "x.png").exists()
