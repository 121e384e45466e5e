"""Commands on executors: outcomes a row, streams through a process, retried tasks, jobs that need them all to end well."""

from __future__ import annotations

import os

import duckdb
import pytest

from brookloom.operators import commands
from brookloom.plans import queries
from brookloom.plans.jobs import Commands, Dataset, TempCommands, TempExternal
from brookloom.plans.pipeline import JobsFailed, Pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "k long, command array<string>, stdin string, stderr int"


def test_outcomes(spark):
    rows = [
        (1, ["sh", "-c", "cat; echo e >&2; printf x > made.bin"], "hello", 7),
        (2, ["sh", "-c", "exit 4"], None, 7),
        (2, ["sh", "-c", "exit 4"], None, 7),
        (3, None, "x", None),
        (4, [], "x", None),
        (5, ["no-such-command-anywhere"], "x", None),
        (6, ["sleep", "30"], "x", None),
        (7, ["printf", "\\377"], None, None),
        (None, ["echo", None], None, None),
        (8, ["true"], "much that it does not read " * 40_000, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    found = commands.outcomes(df, stdin="stdin", made=["made.bin", "other"], at_once=4, seconds=2.0).collect()
    assert list(found[0].asDict()) == ["k", "command", "stdin", "return_code", "stdout", "stderr", "files"]
    assert sorted((str(r.k), r.return_code, r.stdout) for r in found) == sorted(
        [("1", 0, "hello"), ("2", 4, ""), ("2", 4, ""), ("3", 127, ""), ("4", 127, ""), ("5", 127, ""), ("6", 124, ""), ("7", 0, "\ufffd"), ("None", 127, ""), ("8", 0, "")]
    )
    by = {r.k: r for r in found}
    assert by[1].stderr == "e\n" and dict(by[1].files) == {"made.bin": b"x"} and by[2].files == {} and "no-such" in by[5].stderr
    assert commands.outcomes(df.limit(0)).count() == 0


def test_many_commands_run_at_once(spark):
    df = spark.range(200).selectExpr("id", "array('sh', '-c', concat('echo ', id)) command")
    found = commands.outcomes(df, at_once=50)
    assert found.rdd.getNumPartitions() == 50
    assert sorted((r.id, r.stdout) for r in found.collect()) == [(k, f"{k}\n") for k in range(200)]


def test_piped(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("two\nlines",), ("",), ("ä" * 100_000,)], "line string").repartition(2)
    assert sorted(r.line for r in commands.piped(df, "line", ["cat"]).collect()) == sorted(["b", "a", "two", "lines", "", "ä" * 100_000])
    # neither side is held whole: more than pipes hold goes in and comes out
    assert commands.piped(spark.range(300_000), "id", ["cat"]).count() == 300_000
    assert {r.line for r in commands.piped(spark.range(300_000), "id", ["head", "-n", "1"]).collect()} >= {"0"}
    with pytest.raises(Exception, match="ended with 5: sorry"):
        commands.piped(df, "line", ["sh", "-c", "echo sorry >&2; exit 5"]).collect()


@pytest.mark.parametrize("name", ["piped_sums", "command_outcomes"])
def test_queries_equal_their_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    db = duckdb.connect()
    for t in ("lineitem", "supplier"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    wanted = db.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, wanted)) and wanted


def test_commands_as_a_job(spark, tmp_path):
    code = tmp_path / "code"
    code.write_text("3")

    def declared(allowed=(0,)):
        p = Pipeline(spark, f"file://{tmp_path}/p")
        job = Commands(p, "ran", lambda: spark.range(6).selectExpr("id", f"array('sh', '-c', 'echo x > x.txt; [ {{}} -lt 5 ] || exit $(cat {code})') command".replace("{}", "' || id || '")), made=["x.txt"], allowed_codes=allowed, at_once=3, track=False)
        return p, job

    p, job = declared()
    with pytest.raises(JobsFailed, match="1 commands failed.*ended with 3"):
        p.run()
    assert not job.present() and spark.read.parquet(f"file://{tmp_path}/p/ran.new").where("return_code = 3").count() == 1
    code.write_text("0")
    p, job = declared()
    assert p.run()[job.job_id] == "Success" and job.read().count() == 6
    p, job = declared()
    assert p.run()[job.job_id] == "Skipped"
    p, job = declared((0, 1))
    assert p.run()[job.job_id] == "Success"


def test_a_command_that_lacks_its_file(spark, tmp_path):
    p = Pipeline(spark, f"file://{tmp_path}/p")
    Commands(p, "ran", lambda: spark.range(2).selectExpr("array('true') command"), made=["x"], track=False)
    with pytest.raises(JobsFailed, match="2 commands failed"):
        p.run()


def test_temporary_commands(spark, tmp_path):
    p = Pipeline(spark, f"file://{tmp_path}/p")
    temp = TempCommands(p, "temp", lambda: spark.range(3).selectExpr("id", "array('echo', string(id)) command"), track=False)
    unneeded = TempExternal(p, str(tmp_path / "never"), ["y"], ["touch", "y"])
    beside = TempExternal(p, str(tmp_path / "beside"), ["y"], ["sh", "-c", "echo 2 > y"])
    last = Dataset(p, "last", lambda: temp.read().selectExpr("cast(trim(stdout) as int) x", f"'{open(beside.folder + '/y').read().strip()}' y"), track=False).depends_on(temp, beside)
    out = p.run()
    assert out[last.job_id] == "Success" and sorted(tuple(r) for r in last.read().collect()) == [(0, "2"), (1, "2"), (2, "2")]
    assert not temp.present() and not os.path.exists(f"{beside.folder}/y") and not os.path.exists(unneeded.folder)
