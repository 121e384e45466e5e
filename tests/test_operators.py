"""Graph and history operators against plain Python on random graphs, and all queries against their SQL."""

from __future__ import annotations

import random
from pathlib import Path

import duckdb
import pytest

from brookloom.functions import code, digests
from brookloom.operators import graph, history, invalidation
from brookloom.plans import queries
from brookloom.sources import files, shared

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tables(spark, seed, n=14):
    rng = random.Random(seed)
    kinds = {f"j{i:02}": rng.choice(["Always", "Output", "Ephemeral", "Ephemeral"]) for i in range(n)}
    edges = {(f"j{a:02}", f"j{b:02}") for a in range(n) for b in range(a + 1, n) if rng.random() < 0.18}
    return kinds, edges, spark.createDataFrame(list(kinds.items()), "job_id string, kind string"), spark.createDataFrame(sorted(edges), "up string, down string")


def reach(starts, edges):
    seen, todo = set(), list(starts)
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [b for a, b in edges if a == x]
    return seen


def ids(df):
    return {r[0] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_graph(spark, seed):
    kinds, edges, nodes, e = tables(spark, seed)
    back = {(b, a) for a, b in edges}
    one = spark.createDataFrame([("j03",)], "job_id string")
    assert ids(graph.descendants(one, e)) == reach(["j03"], edges)
    assert ids(graph.ancestors(one, e)) == reach(["j03"], back)
    assert ids(graph.focus(nodes, e, one)) == reach(["j03"], back)
    assert ids(graph.prune(nodes, e, one)) == set(kinds) - reach(["j03"], edges)
    level = {}
    for x in sorted(kinds):
        level[x] = max((level[a] + 1 for a, b in edges if b == x), default=0)
    assert dict(graph.levels(nodes, e).collect()) == level
    left, links = set(kinds), set(edges)
    while gone := {x for x in left if kinds[x] == "Ephemeral" and not any(a == x and b in left for a, b in links)}:
        left -= gone
    assert ids(graph.leaf_ephemerals(nodes, e)) == set(kinds) - left
    assert ids(graph.upstream_failed(e, one)) == reach(["j03"], edges) - {"j03"}
    assert not ids(graph.cycle_members(nodes, e))
    need, todo = set(), ["j12", "j13"]
    while todo:
        x = todo.pop()
        if x not in need:
            need.add(x)
            todo += [a for a, b in edges if b == x and kinds[a] == "Ephemeral"]
    bad = spark.createDataFrame([("j12",), ("j13",)], "job_id string")
    assert {tuple(r) for r in graph.required_edges(nodes, e, bad).collect()} == {(a, b) for a, b in edges if b in need}


def test_a_long_chain(spark, monkeypatch):
    monkeypatch.setattr(graph, "PARTS", 4)
    n = 30
    nodes = spark.createDataFrame([(f"j{i:03}", "Output") for i in range(n)], "job_id string, kind string")
    e = spark.createDataFrame([(f"j{i:03}", f"j{i + 1:03}") for i in range(n - 1)] + [("j000", f"j{i:03}") for i in range(2, n)], "up string, down string")
    assert dict(graph.levels(nodes, e).collect()) == {f"j{i:03}": i for i in range(n)}
    first = spark.createDataFrame([("j005",)], "job_id string")
    few = e.where("up <> 'j000'")
    assert ids(graph.descendants(first, few)) == {f"j{i:03}" for i in range(5, n)} and graph.descendants(first, few).count() == n - 5
    places = spark.createDataFrame([(f"j{i:03}", i if i != 7 else 99) for i in range(n)], "job_id string, position int")
    assert {tuple(r) for r in graph.order_violations(few, places).collect()} == {("j007", "j008")}


def test_cycles(spark):
    nodes = spark.createDataFrame([(x, "Output") for x in "abcd"], "job_id string, kind string")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")], "up string, down string")
    assert ids(graph.cycle_members(nodes, e)) == {"b", "c"}
    assert {tuple(r) for r in graph.short_cycles(e).collect()} == {("b", "c"), ("c", "b")}
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(nodes, e)
    empty = nodes.limit(0)
    assert not ids(graph.descendants(empty, e)) and not graph.levels(empty, e).collect()


def test_history(spark):
    old = spark.createDataFrame([("a", "a", "1"), ("b", "b", "1"), ("c", "c", "1"), ("gone", "gone", "1"), ("u", "u", "1")], "job_id string, output_name string, hash string")
    new = spark.createDataFrame([("a", "a", "2")], old.schema)
    outcomes = spark.createDataFrame([("a", "Success"), ("b", "Failed"), ("c", "Skipped"), ("u", "UpstreamFailed")], "job_id string, outcome string")
    assert {r.job_id: r.hash for r in history.merge_outputs(old, new, outcomes).collect()} == {"a": "2", "c": "1", "gone": "1", "u": "1"}
    diff = {r.job_id: r.status for r in history.difference(old, new, ["job_id"]).collect()}
    assert diff == {"a": "changed", "b": "removed", "c": "removed", "gone": "removed", "u": "removed"}


def test_logs_beyond(spark):
    logs = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1)], "job string, run int")
    assert {tuple(r) for r in history.beyond(logs, ["job"], ["run"], 2).collect()} == {("a", 0), ("a", 1), ("a", 2)}


def test_rename_match(spark):
    rng = random.Random(3)
    name = lambda: ":::".join(sorted(rng.sample("abcdefgh", rng.randint(1, 4))))
    lost, known = ({(name(), rng.choice("xyz")) for _ in range(12)} for _ in range(2))
    want = {}
    for up, down in lost:
        best = min(((-len(set(up.split(":::")) & set(o.split(":::"))), o) for o, d in known if d == down), default=(0, ""))
        if best[0]:
            want[up, down] = (best[1], -best[0])
    frames = [spark.createDataFrame(sorted(x), "up string, down string") for x in (lost, known)]
    assert {(r.up, r.down): (r.old_up, r.overlap) for r in invalidation.rename_match(*frames).collect()} == want


def test_startup(spark):
    nodes = spark.createDataFrame([("a", "Always"), ("o", "Output"), ("m", "Output"), ("e", "Ephemeral")], "job_id string, kind string")
    changed = spark.createDataFrame([("o", False), ("m", False), ("e", True)], "job_id string, changed boolean")
    missing = spark.createDataFrame([("m", "absent")], "job_id string, reason string")
    assert dict(invalidation.startup(nodes, changed, missing).collect()) == {"a": "Run", "o": "Unknown", "m": "Invalidated", "e": "Invalidated"}


def test_digests(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "i int, s string")
    b = spark.createDataFrame([(2, None), (1, "x"), (2, None)], "i int, s string").repartition(3)
    assert digests.table_digest(a) == digests.table_digest(b) != digests.table_digest(a.distinct())
    assert digests.parameter_digest({"a": 1, "b": {2, 3}}) == digests.parameter_digest({"b": {3, 2}, "a": 1}) != digests.parameter_digest({"a": "1", "b": {2, 3}})
    with pytest.raises(TypeError):
        digests.parameter_digest(a)
    assert spark.sql("SELECT 'ls -l --all x' AS c").select(digests.command_lines(digests.F.col("c"))).first()[0].count("\n") == 2


def test_function_digests():
    def make(n):
        def f(x):
            return x + n

        return f

    assert code.same_function(code.function_digest(make(1)), code.function_digest(make(1)))
    assert not code.same_function(code.function_digest(make(1)), code.function_digest(make(2)))
    assert not code.same_function(code.function_digest(lambda x: x + 1), code.function_digest(lambda x: x + 2))
    with pytest.raises(code.UndeclaredNonLocals):
        code.check_non_locals(make(1))
    code.check_non_locals(make(1), ["n"])
    code.check_non_locals(lambda: DATA, ["DATA"])


def test_udfs_in_closures():
    from pyspark.sql import functions as F

    def holder(n):
        one = F.udf(lambda x: x + n, "int")

        def build():
            return one

        return build

    def other(kind):
        one = F.udf(lambda x: x * 2, kind)
        return lambda: one

    assert code.same_function(code.function_digest(holder(1)), code.function_digest(holder(1)))
    assert not code.same_function(code.function_digest(holder(1)), code.function_digest(holder(2)))
    assert not code.same_function(code.function_digest(other("int")), code.function_digest(other("long")))

    def deep(n):
        def inner():
            return n

        def outer():
            return inner()

        return outer

    assert not code.same_function(code.function_digest(deep(1)), code.function_digest(deep(2)))

    class Holder:
        def __init__(self, n):
            self.n = n

        def run(self):
            return 1

    assert code.function_digest(Holder(1).run)["code"] == code.function_digest(Holder(2).run)["code"]


def digest_of(spark, root, history=None):
    found = files.fingerprints(spark, [root], history)
    roots = spark.createDataFrame([(files.qualified(spark, root),)], "root string")
    row = files.root_digests(files.within(spark, roots, found)).first()
    return row["digest"] if row else None


def test_files(spark, tmp_path):
    import hashlib
    import json
    import os
    import time

    root = f"file://{tmp_path}"
    (tmp_path / "a").write_text("AAA")
    (tmp_path / "b").write_text("B")
    (tmp_path / "b.sha256").write_text("0" * 64)
    found = {r.path.rsplit("/", 1)[-1]: r.hash for r in files.fingerprints(spark, [root]).collect()}
    assert found == {"a": hashlib.sha256(b"AAA").hexdigest(), "b": "0" * 64}
    os.utime(tmp_path / "b.sha256", (time.time() - 100,) * 2)
    with pytest.raises(Exception, match="older"):
        files.fingerprints(spark, [root]).collect()
    cells = [{"cell_type": "code", "source": "1"}, {"cell_type": "raw", "source": "x"}]
    for out in ("p", "q"):
        (tmp_path / "n.ipynb").write_text(json.dumps({"cells": [c | {"outputs": out} for c in cells]}))
        hashed = files.notebook_digests(spark, f"file://{tmp_path}/n.ipynb").first().hash
        assert hashed == found.setdefault("n", hashed)


def test_folders_are_told_by_paths_and_bytes(spark, tmp_path):
    import os
    import shutil

    root = tmp_path / "in [1]"  # brackets are no pattern
    for part, text in (("d=1", "one"), ("d=2", "two"), ("d=2/deep", "three")):
        (root / part).mkdir(parents=True)
        (root / part / "a.txt").write_text(text)
    seen = [digest_of(spark, f"file://{root}")]

    def changed():
        seen.append(digest_of(spark, f"file://{root}"))
        assert seen[-1] not in seen[:-1]

    (root / "d=1/a.txt").write_text("two")
    (root / "d=2/a.txt").write_text("one")
    changed()  # swapped
    shutil.move(root / "d=1", root / "d=3")
    changed()  # a renamed partition
    (root / "d=2/deep/a.txt").write_text("four")
    changed()  # a nested file
    (root / "d=2/deep/b.txt").write_text("four")
    changed()
    shutil.copytree(root, tmp_path / "moved")
    assert digest_of(spark, f"file://{tmp_path}/moved") == seen[-1]
    # what has the same second and size isn't opened
    old = files.fingerprints(spark, [f"file://{root}"]).withColumn("hash", digests.F.lit("known"))
    old = spark.createDataFrame(old.collect(), old.schema)
    os.utime(root / "d=2/a.txt", (1, 1))
    assert sorted(r.hash == "known" for r in files.fingerprints(spark, [f"file://{root}"], old).collect()) == [False, True, True, True]
    (root / "d=3/a.txt").chmod(0)
    assert "known" in {r.hash for r in files.fingerprints(spark, [f"file://{root}/d=3"], old).collect()}


def test_large_files_are_hashed_in_ranges(spark, tmp_path, monkeypatch):
    import hashlib

    monkeypatch.setattr(files, "LARGE", 1000)
    monkeypatch.setattr(files, "RANGE", 300)
    data = bytes(range(256)) * 5
    (tmp_path / "big").write_bytes(data)
    (tmp_path / "small").write_bytes(data[:1000])
    want = hashlib.sha256("".join(hashlib.sha256(data[i : i + 300]).hexdigest() for i in range(0, len(data), 300)).encode()).hexdigest()
    found = {r.path.rsplit("/", 1)[-1]: r.hash for r in files.fingerprints(spark, [f"file://{tmp_path}"]).collect()}
    assert found == {"big": want, "small": hashlib.sha256(data[:1000]).hexdigest()}


def test_shared(spark):
    by_input = spark.createDataFrame([("p", "i1", "o1"), ("p", "i2", "o1"), ("p", "i3", "o2"), ("p", "i3", "o3")], "prefix string, input_key string, output_key string")
    used = spark.createDataFrame([("p", "h", "i1", 1), ("p", "h", "i1", 2)], "prefix string, history_key string, input_key string, run_id int")
    assert {r.output_key for r in shared.unreferenced(by_input, used).collect()} == {"o2", "o3"}


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    rows = sorted(repr([str(r[c]) for c in columns]) for r in df.collect())
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(repr([str(r[i]) for i in at]) for r in want.fetchall())
