"""Graph operators over nodes(job_id, kind) and edges(up, down), as rounds of joins.

A round joins the last round's new rows with the edges; each round's rows are a stored table, so plans stay short and
shuffles hold new rows only. Nothing but a row count or a flag reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookloom.plans.tables import dropped, written

ALWAYS, OUTPUT, EPHEMERAL = "Always", "Output", "Ephemeral"
#: Rounds after which what has been found so far is put into one table.
PARTS = 16
#: Rows of a first round from which on its edges, used by then, are taken out for the rounds that follow.
MANY = 250_000
#: Edges of which cycles are looked for within one task; of more, in rounds.
HELD = 1_000_000


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def closure(start: DataFrame, edges: DataFrame, through: DataFrame | None = None) -> DataFrame:
    """(job_id): ``start`` and all that its edges lead to. ``through``: nodes beyond which the walk goes on, all if None.

    Ends on graphs with cycles as well: a node is visited once. A round joins the last round's nodes with the edges, and
    takes out the visited ones: a table that is compacted when as many rounds have passed as it then has parts, so that a
    chain of n nodes reads O(n) small tables a few times and no plan grows with n. Where many nodes start, the edges that
    rounds after the first can still use, which don't leave a start and do leave ``through``, are stored once.
    """
    steps = edges.select(F.col("up").alias("job_id"), F.col("down").alias("next"))
    front = written(start.select("job_id").distinct(), "front")
    visited, parts = front, [front]
    first, many, rest = True, front.count() >= MANY, None
    while True:
        go_on = front if through is None or first or rest is not None else front.join(through.select("job_id"), "job_id", "left_semi")
        new = written(go_on.join(steps, "job_id").select(F.col("next").alias("job_id")).distinct().join(visited, "job_id", "left_anti"), "front")
        if new.isEmpty():
            dropped(new, *([] if rest is None else [rest]))
            return visited
        if first and many:
            steps = steps.join(front, "job_id", "left_anti")
            rest = steps = written(steps if through is None else steps.join(through.select("job_id"), "job_id", "left_semi"), "steps")
        first = False
        front = new
        parts.append(new)
        if len(parts) > PARTS:
            visited = written(union(parts), "visited")
            dropped(*parts[:-1])  # the last is the next round's front
            parts = [visited]
            front = new
        else:
            visited = union(parts)


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("down").alias("up"), F.col("up").alias("down"))


def descendants(start: DataFrame, edges: DataFrame) -> DataFrame:
    return closure(start, edges)


def ancestors(start: DataFrame, edges: DataFrame) -> DataFrame:
    return closure(start, reversed_edges(edges))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(job_id, level): the longest path that leads to a node. A graph with a cycle fails. Edges may repeat.

    Nodes without an open upstream are peeled off, a level a round; a node's open upstreams are counted down by the edges
    that leave the level, so each edge is used once and each node placed once. The edges that leave a level of many nodes
    are marked in a stored table, and later rounds read the others alone; once none is left, none is joined.
    """
    inner = edges.join(nodes.select(F.col("job_id").alias("up")), "up", "left_semi").join(nodes.select(F.col("job_id").alias("down")), "down", "left_semi").select("up", "down").distinct()
    inner = held = written(inner, "edges")
    waits = inner.groupBy(F.col("down").alias("job_id")).agg(F.count(F.lit(1)).alias("open"))
    left = written(nodes.select("job_id").distinct().join(waits, "job_id", "left").select("job_id", F.coalesce("open", F.lit(0)).alias("open")), "open")
    found, parts, depth = None, [], 0
    while True:
        free = written(left.where("open = 0").select("job_id", F.lit(depth).alias("level")), "level")
        if free.isEmpty():
            dropped(free)
            break
        parts.append(free)
        ups, before = free.select(F.col("job_id").alias("up")), held
        if inner is not None and free.count() >= MANY:
            if inner.isEmpty():
                inner = None
            else:
                held = written(inner.join(ups.withColumn("used", F.lit(True)), "up", "left").select(F.when(F.col("used").isNull(), F.col("up")).alias("up"), "down"), "edges")
                inner = held.where("up is not null")
        waiting = left.where("open > 0")
        if inner is None:
            after = written(waiting, "open")
        else:
            gone = ups.join(inner, "up").select("down") if held is before else held.where("up is null").select("down")
            done = gone.groupBy(F.col("down").alias("job_id")).agg(F.count(F.lit(1)).alias("done"))
            after = written(waiting.join(done, "job_id", "left").select("job_id", (F.col("open") - F.coalesce("done", F.lit(0))).alias("open")), "open")
        dropped(left, *([] if held is before else [before]))
        left, depth = after, depth + 1
        if len(parts) > PARTS:
            found = written(union(parts), "levels")
            dropped(*parts)
            parts = [found]
    cycle = not left.isEmpty()
    dropped(left, held)
    if cycle:
        raise ValueError("the graph has a cycle")
    return union(parts) if parts else nodes.select("job_id", F.lit(0).alias("level")).limit(0)


def order_violations(edges: DataFrame, order: DataFrame) -> DataFrame:
    """Edges whose upstream doesn't come before its downstream in ``order`` (job_id, position), or isn't in it."""
    up, down = (order.select(F.col("job_id").alias(x), F.col("position").alias(f"{x}_at")) for x in ("up", "down"))
    both = edges.join(up, "up", "left").join(down, "down", "left")
    return both.where(~F.coalesce(F.col("up_at") < F.col("down_at"), F.lit(False))).select("up", "down")


def cycle_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(job_id): nodes that are on a cycle or between cycles: empty for a DAG.

    Edges of nodes without upstream or without downstream are peeled off again and again, so that a round reads what the
    last one left; once that is at most ``HELD`` edges, one task does the rest, which may be as many rounds as a chain has nodes.
    """
    ids = nodes.select("job_id").distinct()

    def within(left: DataFrame, held: DataFrame) -> DataFrame:
        return written(held.join(left.withColumnRenamed("job_id", "up"), "up", "left_semi").join(left.withColumnRenamed("job_id", "down"), "down", "left_semi").select("up", "down"), "peel")

    held = within(ids, edges)
    size = held.count()
    while size > HELD:
        ends = held.select(F.col("up").alias("job_id")).distinct().join(held.select(F.col("down").alias("job_id")), "job_id", "left_semi")
        after = within(ends, held)
        dropped(held)
        was, held, size = size, after, after.count()
        if size == was:
            return held.select(F.col("up").alias("job_id")).distinct()
    return held.coalesce(1).mapInPandas(peeling(), "job_id string")


def peeling() -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Nodes that are left of edges (up, down) when those without an edge in or without one out go, until none does."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = pd.concat([pd.DataFrame({"up": [], "down": []}, dtype=object), *batches], ignore_index=True)
        codes, names = pd.factorize(pd.concat([edges["up"], edges["down"]], ignore_index=True))
        ends = codes[: len(edges)], codes[len(edges) :]
        n = len(names)
        alive = [True] * n
        # both ways: how many edges lead to a node, and which nodes an edge leads to
        ways = []
        for a, b in (ends, ends[::-1]):
            order = a.argsort(kind="stable")
            ways.append(([0, *pd.Series(a).value_counts().reindex(range(n), fill_value=0).cumsum()], b[order].tolist(), pd.Series(b).value_counts().reindex(range(n), fill_value=0).tolist()))
        gone = [x for x in range(n) if not ways[0][2][x] or not ways[1][2][x]]
        for x in gone:
            alive[x] = False
        while gone:
            x = gone.pop()
            for first, to, open_ in ways:
                for y in to[first[x] : first[x + 1]]:
                    open_[y] -= 1
                    if alive[y] and not open_[y]:
                        alive[y] = False
                        gone.append(y)
        yield pd.DataFrame({"job_id": pd.Series(list(names), dtype=object)[pd.Series(alive, dtype=bool)]})

    return run


def short_cycles(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is an edge too, or that lead from a node to itself."""
    back = reversed_edges(edges)
    return edges.join(back, ["up", "down"], "left_semi").distinct()


def kinds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, jobs, with_inputs): jobs by kind, and those of them that have upstreams."""
    fed = edges.select(F.col("down").alias("job_id"), F.lit(True).alias("fed")).distinct()
    return nodes.join(fed, "job_id", "left").groupBy("kind").agg(F.count(F.lit(1)).alias("jobs"), F.count("fed").alias("with_inputs"))


def output_conflicts(outputs: DataFrame) -> DataFrame:
    """(output_name, jobs): outputs (job_id, output_name) that more than one job declares."""
    return outputs.groupBy("output_name").agg(F.countDistinct("job_id").alias("jobs")).where("jobs > 1")


def leaf_ephemerals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(job_id): ephemerals all of whose descendants are ephemeral: no other kept node needs them."""
    eph = nodes.where(F.col("kind") == EPHEMERAL).select("job_id")
    kept_roots = nodes.where(F.col("kind") != EPHEMERAL).select("job_id")
    return eph.join(ancestors(kept_roots, edges), "job_id", "left_anti")


def focus(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes that are in ``ids`` or lead to one of them."""
    return nodes.join(ancestors(ids, edges), "job_id", "left_semi")


def prune(nodes: DataFrame, edges: DataFrame, ids: DataFrame, immune: DataFrame | None = None) -> DataFrame:
    """Nodes that are left without ``ids`` and their descendants; ``immune`` ones stay."""
    gone = descendants(ids, edges)
    if immune is not None:
        gone = gone.join(immune.select("job_id"), "job_id", "left_anti")
    return nodes.join(gone, "job_id", "left_anti")


def related(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes in the cones above or below ``ids``; a given id itself only if it is in another one's cone."""
    starts = ids.select("job_id").distinct()
    below = descendants(edges.join(starts.withColumnRenamed("job_id", "up"), "up", "left_semi").select(F.col("down").alias("job_id")), edges)
    above = ancestors(edges.join(starts.withColumnRenamed("job_id", "down"), "down", "left_semi").select(F.col("up").alias("job_id")), edges)
    return nodes.join(below.union(above).distinct(), "job_id", "left_semi")


def only(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids.select("job_id").distinct(), "job_id", "left_semi")


def required_walk(nodes: DataFrame, edges: DataFrame, invalidated: DataFrame) -> DataFrame:
    """(job_id): ``invalidated`` nodes and ephemerals that have to deliver to them: the edges into these must deliver."""
    eph = nodes.where(F.col("kind") == EPHEMERAL).select("job_id")
    reached = closure(invalidated, reversed_edges(edges), through=eph)
    # a node that isn't ephemeral stops the walk unless it is invalidated itself
    return reached.join(eph.union(invalidated.select("job_id")), "job_id", "left_semi").distinct()


def required_edges(nodes: DataFrame, edges: DataFrame, invalidated: DataFrame) -> DataFrame:
    """Edges that must deliver: those into ``invalidated`` nodes, and onward into each ephemeral that has to deliver."""
    return edges.join(required_walk(nodes, edges, invalidated).withColumnRenamed("job_id", "down"), "down", "left_semi").select("up", "down")


def upstream_failed(edges: DataFrame, failed: DataFrame) -> DataFrame:
    """Nodes that follow a failed one and didn't fail themselves."""
    return descendants(failed, edges).join(failed.select("job_id"), "job_id", "left_anti")


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): the graph in GraphML's node and edge elements, for viewers."""

    def safe(c: Column) -> Column:
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))

    own = nodes.select(F.concat(F.lit('<node id="'), safe(F.col("job_id")), F.lit('"><data key="kind">'), F.col("kind"), F.lit("</data></node>")).alias("line"))
    return own.union(edges.select(F.concat(F.lit('<edge source="'), safe(F.col("up")), F.lit('" target="'), safe(F.col("down")), F.lit('"/>')).alias("line")))
