"""What operators move and make, by plans and by rows, so that it grows with their input."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookloom.operators import graph, history, invalidation
from brookloom.plans.tables import settings
from brookloom.sources import files

#: As on tables too large to broadcast.
LARGE = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}


def shuffles(spark: SparkSession, df: DataFrame) -> int:
    with settings(spark, LARGE):
        df = df.select("*")
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def most_rows(spark: SparkSession, df: DataFrame) -> int:
    """Rows of the step of ``df`` that gives most of them."""
    df.collect()
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = store.executionsList()
    last = runs.apply(runs.size() - 1)
    values, found = store.executionMetrics(last.executionId()), [0]
    for i in range(last.metrics().size()):
        one = last.metrics().apply(i)
        if one.name() == "number of output rows" and values.contains(one.accumulatorId()):
            found.append(int(values.apply(one.accumulatorId()).replace(",", "")))
    return max(found)


def graph_tables(spark: SparkSession) -> dict[str, DataFrame]:
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("m", "c")], "up string, down string")
    inputs = spark.createDataFrame([("b", "a", "a"), ("c", "a", "a"), ("c", "m1", "m"), ("c", "m2", "m")], "job_id string, input_name string, up string")
    outputs = spark.createDataFrame([("a", "a", "aa"), ("m", "m1", "1"), ("m", "m2", "text")], "job_id string, output_name string, hash string")
    hist = spark.createDataFrame([("a", "b", "a", "aa"), ("m", "c", "m1", "1"), ("m", "c", "m2", "other"), ("x", "c", "x", "0a"), ("a", "m", "a", "Ab")], "up string, down string, output_name string, hash string")
    return {"edges": edges, "inputs": inputs, "outputs": outputs, "hist": hist}


@pytest.mark.parametrize("given", [True, False])
def test_edges_are_compared_by_one_shuffle_of_keys(spark: SparkSession, given: bool) -> None:
    t = graph_tables(spark)
    found = invalidation.edge_invalidated(t["edges"] if given else None, t["inputs"], t["outputs"], t["hist"])
    assert {tuple(r) for r in found.collect()} == {("a", "b", False), ("a", "c", True), ("m", "c", True)}
    assert shuffles(spark, found) <= 3  # ten before


def test_merge_of_edges_moves_digests_as_bytes_once(spark: SparkSession) -> None:
    t = graph_tables(spark)
    nodes = spark.createDataFrame([(x, "Output") for x in "abcm"], "job_id string, kind string")
    outcomes = spark.createDataFrame([("c", "Success")], "job_id string, outcome string")
    merged = history.merge_edges(t["hist"], nodes, t["edges"], t["inputs"], t["outputs"].where("job_id = 'a'"), t["outputs"], outcomes)
    want = {("a", "b", "a", "aa"), ("a", "c", "a", "aa"), ("m", "c", "m1", "1"), ("m", "c", "m2", "other"), ("x", "c", "x", "0a")}
    assert {tuple(r) for r in merged.collect()} == want  # a is no more above m
    texts = spark.createDataFrame([("",), ("0a",), ("0A",), ("abc",), ("é",), (None,)], "x string")
    assert [r[0] for r in texts.select(history.packed("x").alias("p")).select(history.unpacked("p")).collect()] == ["", "0a", "0A", "abc", "é", None]


def test_names_that_share_a_part_are_no_pairs(spark: SparkSession) -> None:
    n = 1500
    names = spark.range(2 * n).select(F.concat(F.lit("p:::q"), F.col("id") % n).alias("up"), F.lit("j").alias("down"), (F.col("id") < n).alias("new"))
    lost, known = names.where("new").select("up", "down"), names.where("not new").select("up", "down")
    found = invalidation.rename_match(lost, known)
    assert most_rows(spark, found) <= 10 * n  # the pairs with p in common were 2,250,000
    assert found.where("overlap <> 2 or old_up <> up").isEmpty() and found.count() == n


def test_names_of_many_parts_match_as_those_of_few(spark: SparkSession) -> None:
    import random

    def name() -> str:
        return ":::".join(random.choice("abcdefghijkl") for _ in range(random.choice([1, 2, 3, 6, 7, 9])))

    random.seed(3)
    lost, known = ([(name(), random.choice("xy")) for _ in range(40)] for _ in range(2))
    want = {}
    for up, down in lost:
        found = [(-len(set(up.split(":::")) & set(old.split(":::"))), old) for old, other in known if other == down]
        if found and min(found)[0] < 0:
            want[up, down] = (min(found)[1], -min(found)[0])
    frames = [spark.createDataFrame(rows, "up string, down string") for rows in (lost, known)]
    assert {(r.up, r.down): (r.old_up, r.overlap) for r in invalidation.rename_match(*frames).collect()} == want


@pytest.mark.parametrize("given", [True, False])
def test_edges_are_compared_by_one_shuffle_of_keys(spark: SparkSession, given: bool) -> None:
    t = graph_tables(spark)
    found = invalidation.edge_invalidated(t["edges"] if given else None, t["inputs"], t["outputs"], t["hist"])
    assert {tuple(r) for r in found.collect()} == {("a", "b", False), ("a", "c", True), ("m", "c", True)}
    assert shuffles(spark, found) <= 3  # ten before


def test_merge_of_edges_moves_digests_as_bytes_once(spark: SparkSession) -> None:
    t = graph_tables(spark)
    nodes = spark.createDataFrame([(x, "Output") for x in "abcm"], "job_id string, kind string")
    outcomes = spark.createDataFrame([("c", "Success")], "job_id string, outcome string")
    merged = history.merge_edges(t["hist"], nodes, t["edges"], t["inputs"], t["outputs"].where("job_id = 'a'"), t["outputs"], outcomes)
    want = {("a", "b", "a", "aa"), ("a", "c", "a", "aa"), ("m", "c", "m1", "1"), ("m", "c", "m2", "other"), ("x", "c", "x", "0a")}
    assert {tuple(r) for r in merged.collect()} == want  # a is no more above m
    texts = spark.createDataFrame([("",), ("0a",), ("0A",), ("abc",), ("é",), (None,)], "x string")
    assert [r[0] for r in texts.select(history.packed("x").alias("p")).select(history.unpacked("p")).collect()] == ["", "0a", "0A", "abc", "é", None]


def test_names_that_share_a_part_are_no_pairs(spark: SparkSession) -> None:
    n = 1500
    names = spark.range(2 * n).select(F.concat(F.lit("p:::q"), F.col("id") % n).alias("up"), F.lit("j").alias("down"), (F.col("id") < n).alias("new"))
    lost, known = names.where("new").select("up", "down"), names.where("not new").select("up", "down")
    found = invalidation.rename_match(lost, known)
    assert most_rows(spark, found) <= 10 * n  # the pairs with p in common were 2,250,000
    assert found.where("overlap <> 2 or old_up <> up").isEmpty() and found.count() == n


def test_names_of_many_parts_match_as_those_of_few(spark: SparkSession) -> None:
    import random

    def name() -> str:
        return ":::".join(random.choice("abcdefghijkl") for _ in range(random.choice([1, 2, 3, 6, 7, 9])))

    random.seed(3)
    lost, known = ([(name(), random.choice("xy")) for _ in range(40)] for _ in range(2))
    want = {}
    for up, down in lost:
        found = [(-len(set(up.split(":::")) & set(old.split(":::"))), old) for old, other in known if other == down]
        if found and min(found)[0] < 0:
            want[up, down] = (min(found)[1], -min(found)[0])
    frames = [spark.createDataFrame(rows, "up string, down string") for rows in (lost, known)]
    assert {(r.up, r.down): (r.old_up, r.overlap) for r in invalidation.rename_match(*frames).collect()} == want


@pytest.mark.parametrize("given", [True, False])
def test_edges_are_compared_by_one_shuffle_of_keys(spark: SparkSession, given: bool) -> None:
    t = graph_tables(spark)
    found = invalidation.edge_invalidated(t["edges"] if given else None, t["inputs"], t["outputs"], t["hist"])
    assert {tuple(r) for r in found.collect()} == {("a", "b", False), ("a", "c", True), ("m", "c", True)}
    assert shuffles(spark, found) <= 3  # ten before


def test_merge_of_edges_moves_digests_as_bytes_once(spark: SparkSession) -> None:
    t = graph_tables(spark)
    nodes = spark.createDataFrame([(x, "Output") for x in "abcm"], "job_id string, kind string")
    outcomes = spark.createDataFrame([("c", "Success")], "job_id string, outcome string")
    merged = history.merge_edges(t["hist"], nodes, t["edges"], t["inputs"], t["outputs"].where("job_id = 'a'"), t["outputs"], outcomes)
    want = {("a", "b", "a", "aa"), ("a", "c", "a", "aa"), ("m", "c", "m1", "1"), ("m", "c", "m2", "other"), ("x", "c", "x", "0a")}
    assert {tuple(r) for r in merged.collect()} == want  # a is no more above m
    texts = spark.createDataFrame([("",), ("0a",), ("0A",), ("abc",), ("é",), (None,)], "x string")
    assert [r[0] for r in texts.select(history.packed("x").alias("p")).select(history.unpacked("p")).collect()] == ["", "0a", "0A", "abc", "é", None]


def test_names_that_share_a_part_are_no_pairs(spark: SparkSession) -> None:
    n = 1500
    names = spark.range(2 * n).select(F.concat(F.lit("p:::q"), F.col("id") % n).alias("up"), F.lit("j").alias("down"), (F.col("id") < n).alias("new"))
    lost, known = names.where("new").select("up", "down"), names.where("not new").select("up", "down")
    found = invalidation.rename_match(lost, known)
    assert most_rows(spark, found) <= 10 * n  # the pairs with p in common were 2,250,000
    assert found.where("overlap <> 2 or old_up <> up").isEmpty() and found.count() == n


def test_names_of_many_parts_match_as_those_of_few(spark: SparkSession) -> None:
    import random

    def name() -> str:
        return ":::".join(random.choice("abcdefghijkl") for _ in range(random.choice([1, 2, 3, 6, 7, 9])))

    random.seed(3)
    lost, known = ([(name(), random.choice("xy")) for _ in range(40)] for _ in range(2))
    want = {}
    for up, down in lost:
        found = [(-len(set(up.split(":::")) & set(old.split(":::"))), old) for old, other in known if other == down]
        if found and min(found)[0] < 0:
            want[up, down] = (min(found)[1], -min(found)[0])
    frames = [spark.createDataFrame(rows, "up string, down string") for rows in (lost, known)]
    assert {(r.up, r.down): (r.old_up, r.overlap) for r in invalidation.rename_match(*frames).collect()} == want


@pytest.mark.parametrize("held", [graph.HELD, 0])
def test_cycles_below_a_long_chain(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, held: int) -> None:
    n, calls = 12, []
    whole = graph.written
    monkeypatch.setattr(graph, "HELD", held)
    monkeypatch.setattr(graph, "written", lambda df, name: calls.append(name) or whole(df, name))
    chain = [(f"n{i}", f"n{i + 1}") for i in range(n)]
    rows = [*chain, (f"n{n}", "x"), ("x", "y"), ("y", "x"), ("y", "between"), ("between", "z"), ("z", "z"), ("z", "end"), ("end", "last")]
    edges = spark.createDataFrame(rows, "up string, down string")
    nodes = edges.selectExpr("up as job_id").union(edges.selectExpr("down")).distinct()
    assert {r.job_id for r in graph.cycle_members(nodes, edges).collect()} == {"x", "y", "between", "z"}
    assert len(calls) <= (2 if held else n + 6)  # before: a table for each node of the chain, from all edges


def test_a_sweep_joins_edges_once_with_what_must_run(spark: SparkSession) -> None:
    edges = spark.createDataFrame([("e", "o"), ("p", "e"), ("e", "k")], "up string, down string")
    nodes = spark.createDataFrame([("e", "Ephemeral"), ("p", "Output"), ("o", "Output"), ("k", "Output")], "job_id string, kind string")
    found = invalidation.sweep(nodes, edges, spark.createDataFrame([("o",)], "job_id string"))
    assert {tuple(r) for r in found.collect()} == {("e", "o", True), ("p", "e", True), ("e", "k", False)}
    with settings(spark, LARGE):
        plan = found.select("*")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(down" in plan and "hashpartitioning(up" not in plan  # edges were joined by both before


@pytest.mark.parametrize("through", [True, False])
def test_a_walk_from_many_takes_out_used_edges(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, through: bool) -> None:
    names, whole = [], graph.written
    monkeypatch.setattr(graph, "MANY", 1)
    monkeypatch.setattr(graph, "written", lambda df, name: names.append((name, (out := whole(df, name)).count())) or out)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("c", "a"), ("b", "s"), ("s", "t")], "up string, down string")
    go = spark.createDataFrame([("b",), ("c",)], "job_id string") if through else None
    found = {r.job_id for r in graph.closure(spark.createDataFrame([("a",)], "job_id string"), edges, go).collect()}
    assert found == ({"a", "b", "c", "d", "s"} if through else {"a", "b", "c", "d", "s", "t"})
    assert ("steps", 4 if through else 5) in names  # all six edges were joined again in every round before


def test_a_plan_takes_stored_tables_as_they_are(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    from brookloom.plans.tables import written

    names = []
    monkeypatch.setattr("brookloom.plans.tables.written", lambda df, name: names.append(name) or written(df, name))
    edges = written(spark.createDataFrame([("e", "o")], "up string, down string"), "edges")
    nodes = written(spark.createDataFrame([("e", "Ephemeral"), ("o", "Output")], "job_id string, kind string"), "nodes")
    found = invalidation.planned(nodes, edges, spark.createDataFrame([("o", "differs")], "job_id string, cause string"))
    assert {(r.job_id, r.action) for r in found.collect()} == {("o", "Run"), ("e", "Run")} and not {"nodes", "edges"} & set(names)


def test_requirement_of_given_edges_is_one_aggregation(spark: SparkSession) -> None:
    said = spark.createDataFrame([("a", "b", True), ("a", "c", None), ("d", "c", None), ("e", "c", False)], "up string, down string, required boolean")
    found = invalidation.downstream_requirement(None, said)
    assert dict(found.collect()) == dict(invalidation.downstream_requirement(said.select("up", "down"), said).collect()) == {"a": "yes", "d": "unknown", "e": "no"}
    assert shuffles(spark, found) == 1


def test_files_are_listed_once_to_tell_what_changed(spark, tmp_path, monkeypatch):
    for n in range(40):
        (tmp_path / f"d{n}").mkdir()
        (tmp_path / f"d{n}" / "x").write_text(str(n))
    read, plain = [], files.reader
    monkeypatch.setattr(files, "reader", lambda *a: read.append(a) or plain(*a))
    known = files.fingerprints(spark, [f"file://{tmp_path}"])
    assert known.count() == 40 and len(read) == 2
    read.clear()
    assert {r.hash for r in files.fingerprints(spark, [f"file://{tmp_path}"], known).collect()} == {r.hash for r in known.collect()}
    assert len(read) == 1


def test_edges_are_compared_in_tasks_that_are_not_merged(spark):
    edges = spark.createDataFrame([(f"u{n}", "d") for n in range(50)], "up string, down string")
    outputs = edges.select(F.col("up").alias("job_id"), F.col("up").alias("output_name"), F.lit("h").alias("hash"))
    known = edges.where("up <> 'u7'").select("up", "down", F.col("up").alias("output_name"), F.lit("h").alias("hash"))
    found = invalidation.edge_invalidated(edges, edges.select(F.col("down").alias("job_id"), F.col("up").alias("input_name"), "up"), outputs, known)
    assert found.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert {r.up for r in found.where("invalidated").collect()} == {"u7"} and found.count() == 50


def test_partial_comparison_moves_its_rows_once(spark):
    from brookloom.plans.queries import partial_dependency_compare

    assert shuffles(spark, partial_dependency_compare(spark, "/root/testdata/sf0.001")) <= 4


def test_line_items_are_told_apart_in_tasks_that_are_not_merged(spark):
    from brookloom.plans.derived import Derived

    assert Derived(spark, "/root/testdata/sf0.001").edges.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_input_keys_are_made_in_tasks_that_are_not_merged(spark):
    import hashlib

    from brookloom.functions import digests

    inputs = spark.createDataFrame([("j", x) for x in "abcd"], "job_id string, input_name string")
    outputs = spark.createDataFrame([("a", "0a"), ("b", "0A"), ("c", ""), ("d", None)], "output_name string, hash string")
    found = digests.input_key(inputs, outputs)
    assert found.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert found.first().input_key == hashlib.sha256(b"a=0a\nb=0A\nc=\nd").hexdigest()


def test_ready_jobs_are_found_without_telling_line_items_apart(spark):
    from brookloom.plans.queries import ready

    with settings(spark, LARGE):
        plan = ready(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" in plan and "REPARTITION_BY_NUM" not in plan  # a shuffle of line items before


def test_input_names_are_dealt_before_they_are_collected(spark):
    import hashlib

    rows = spark.createDataFrame([("j", x) for x in "cabac"], "job_id string, input_name string")
    found = invalidation.input_digest(rows)
    assert found.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism  # 1 before
    assert found.first().input_digest == hashlib.md5(b"a\nb\nc").hexdigest()


@pytest.mark.parametrize("many", [1, 3])
def test_levels_of_many_nodes_read_only_edges_that_are_left(spark, monkeypatch, many):
    sizes = []

    def kept(df, name):
        out = written_(df, name)
        if name == "edges":
            sizes.append((out.count(), out.where("up is null").count()))
        return out

    written_ = graph.written
    monkeypatch.setattr(graph, "written", kept)
    monkeypatch.setattr(graph, "MANY", many, raising=False)
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "job_id string")
    edges = spark.createDataFrame([("a", "d"), ("b", "d"), ("c", "e"), ("c", "e"), ("d", "f"), ("e", "f"), ("a", "f"), ("f", "g")], "up string, down string")
    found = {tuple(r) for r in graph.levels(nodes, edges).collect()}
    assert found == {("a", 0), ("b", 0), ("c", 0), ("d", 1), ("e", 1), ("f", 2), ("g", 3)}
    assert sizes == ([(7, 0), (7, 4), (3, 2), (1, 1)] if many == 1 else [(7, 0), (7, 4)])  # all edges in all rounds before
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(nodes, edges.union(spark.createDataFrame([("g", "f")], "up string, down string")))


def test_edges_that_lie_by_upstream_are_compared_and_walked_where_they_lie(spark, monkeypatch):
    from brookloom.plans.derived import Derived
    from brookloom.plans.tables import dropped

    plain, lying = Derived(spark, "/root/testdata/sf0.001"), Derived(spark, "/root/testdata/sf0.001").dealt()
    assert lying.edges.count() == plain.edges.count() and lying.edges.join(plain.edges, ["up", "down"], "left_anti").isEmpty()
    plans, write = [], invalidation.written
    monkeypatch.setattr(invalidation, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    with settings(spark, LARGE):
        changed = invalidation.changed_jobs(lying.inputs, lying.cur_output, lying.hist_edge)
        assert graph.descendants(changed, lying.edges).count() == graph.descendants(changed, plain.edges).count()
        assert plans[0].count("Exchange hashpartitioning") == 3  # nodes twice, and the jobs found; edges were shuffled four times before
        assert shuffles(spark, lying.edges.join(changed.withColumnRenamed("job_id", "up"), "up")) == 1
    want = invalidation.edge_invalidated(None, plain.inputs, plain.cur_output, plain.hist_edge).where("invalidated").select("down").distinct()
    assert {r.job_id for r in changed.collect()} == {r.down for r in want.collect()}
    stale = changed.withColumn("cause", F.lit("differs"))
    plan = [{tuple(r) for r in invalidation.planned(g.nodes, g.edges, stale).collect()} for g in (plain, lying)]
    assert plan[0] == plan[1] and {action for _, action, _ in plan[0]} == {"Run", "Depends", "Skip"}
    before = spark.catalog.listTables()
    dropped(lying.edges)
    assert len(spark.catalog.listTables()) == len(before) - 1


def test_a_plan_ends_at_ephemerals_that_only_feed_ephemerals(spark):
    edges = spark.createDataFrame([("o", "e"), ("e", "f"), ("f", "g"), ("o", "p"), ("k", "p"), ("h", "k"), ("k", "e")], "up string, down string")
    nodes = spark.createDataFrame([(x, "Output" if x in "op" else "Ephemeral") for x in "oefgpkh"], "job_id string, kind string")
    for odd, want in (("o", {"o": "Run", "p": "Depends", "k": "Depends", "h": "Depends"}), ("p", {"p": "Run", "k": "Run", "h": "Run"}), ("f", {})):
        found = invalidation.planned(nodes, edges, spark.createDataFrame([(odd, "differs")], "job_id string, cause string"))
        assert {r.job_id: r.action for r in found.collect() if r.action != "Skip"} == want


def test_edges_that_lie_by_upstream_are_merged_where_they_lie(spark):
    import re

    from brookloom.plans.derived import Derived

    found = []
    for g in (Derived(spark, "/root/testdata/sf0.001"), Derived(spark, "/root/testdata/sf0.001").dealt()):
        new = g.cur_output.join(g.outcomes.where("outcome = 'Success'").select("job_id"), "job_id", "left_semi")
        nodes, edges = g.nodes.where("k <> 5"), g.edges.where("up not like 'S%2'")  # rows of absent jobs stay, those of edges that are gone go
        lying = {"buckets": g.edges._buckets} if "_buckets" in g.edges.__dict__ else {}
        merged = history.merge_edges(g.hist_edge, nodes, edges, g.inputs, new, g.hist_output, g.outcomes, **lying)
        with settings(spark, LARGE):
            plan = merged.select("*")._jdf.queryExecution().executedPlan().toString()
        found.append((sorted(map(tuple, merged.collect())), len(re.findall(r"Exchange hashpartitioning\(up#\d+, down#\d+", plan))))
    assert found[0][0] == found[1][0] and len(set(found[0][0])) == len(found[0][0]) > 1000
    assert found[0][1] and not found[1][1]  # all rows were shuffled by edge before


def test_validation_by_changed_jobs_reads_no_edges(spark):
    t = graph_tables(spark)
    nodes = spark.createDataFrame([("a", "Output"), ("b", "Output"), ("c", "Output"), ("m", "Ephemeral"), ("e", "Ephemeral")], "job_id string, kind string")
    known = spark.createDataFrame([("m",)], "job_id string")
    whole = invalidation.node_validation(nodes, t["edges"], invalidation.edge_invalidated(t["edges"], t["inputs"], t["outputs"], t["hist"]), known)
    changed = invalidation.changed_jobs(t["inputs"], t["outputs"], t["hist"])
    found = invalidation.node_validation(nodes, None, changed.select(F.col("job_id").alias("down"), F.lit(True).alias("invalidated")), known)
    assert [r.job_id for r in changed.collect()] == ["c"]
    assert dict(found.collect()) == dict(whole.collect()) == {"a": "Validated", "b": "Validated", "c": "Invalidated", "m": "Validated", "e": "Invalidated"}
    assert shuffles(spark, found) <= 5 < shuffles(spark, whole)


def test_files_are_put_into_few_folders_and_looked_at_once(spark, tmp_path, monkeypatch):
    import hashlib

    rows = spark.range(300).select(F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") > 0, F.concat(F.lit("é"), "id")).alias("text"))
    assert files.put(rows, f"file://{tmp_path}/made") == 300
    folders = list((tmp_path / "made").iterdir())
    assert 1 < len(folders) <= max(2, 4 * spark.sparkContext.defaultParallelism)  # a folder a file before
    want = {f"n{i}": hashlib.sha256(f"é{i}\n".encode() if i else b"\n").hexdigest() for i in range(300)}
    asked, plain = [], files.hashed
    monkeypatch.setattr(files, "hashed", lambda *a: asked.append(len(a)) or plain(*a))
    found = files.fingerprints(spark, [f"file://{tmp_path}/made"])
    assert {r.path.rsplit("/", 1)[-1]: r.hash for r in found.collect()} == want
    assert asked == [2]  # whether any is large was asked of each file again before
    monkeypatch.setattr(files, "LARGE", 5)  # texts of 100 on are 6 bytes
    assert {r.path.rsplit("/", 1)[-1] for r in files.fingerprints(spark, [f"file://{tmp_path}/made"]).collect()} == set(want)
    assert files.put(rows.limit(0), f"file://{tmp_path}/none") == 0
