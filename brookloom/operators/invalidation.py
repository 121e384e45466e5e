"""What has to run again: comparisons of the present graph and outputs with the stored history, as joins and aggregates.

Tables: nodes(job_id, kind), edges(up, down), inputs(job_id, input_name, up), cur_output and hist_output(job_id,
output_name, hash), hist_inputs(job_id, input_digest), hist_edge(up, down, output_name, hash).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookloom.operators.graph import ALWAYS, EPHEMERAL, OUTPUT, ancestors, descendants, required_walk
from brookloom.plans.tables import by_first_key, dealt, dropped, spread, stored, written

SEPARATOR = ":::"
#: Names of so many parts are matched by every choice of them (63 of six), others by pairs.
FEW_PARTS = 6


def input_digest(inputs: DataFrame) -> DataFrame:
    """(job_id, input_digest): MD5 of a job's sorted distinct input names, a line each.

    Names are dealt before they are collected: sets are many as jobs, and made before a shuffle they would spill.
    """
    names = F.array_join(F.array_sort(F.collect_set("input_name")), "\n")
    return spread(inputs.select("job_id", "input_name"), "job_id").groupBy("job_id").agg(F.md5(names).alias("input_digest"))


def inputs_changed(nodes: DataFrame, digests: DataFrame, hist_inputs: DataFrame) -> DataFrame:
    """(job_id, changed): against history; without history, changed unless the job has no inputs."""
    now = nodes.select("job_id").join(digests, "job_id", "left")
    both = now.join(hist_inputs.select("job_id", F.col("input_digest").alias("was")), "job_id", "left")
    changed = F.when(F.col("was").isNull(), F.col("input_digest").isNotNull()).otherwise(~F.coalesce(F.col("was") == F.col("input_digest"), F.lit(False)))
    return both.select("job_id", changed.alias("changed"))


def missing_outputs(nodes: DataFrame, present: DataFrame, hist_output: DataFrame) -> DataFrame:
    """(job_id, reason): Output jobs any part of which is absent, or that history doesn't know."""
    parts = nodes.where(F.col("kind") == OUTPUT).select("job_id", F.explode(F.split("job_id", SEPARATOR)).alias("output_name"))
    there = parts.join(present.select("output_name", F.lit(True).alias("there")).distinct(), "output_name", "left")
    whole = there.groupBy("job_id").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("all_there"))
    known = whole.join(hist_output.select("job_id", F.lit(True).alias("known")).distinct(), "job_id", "left")
    reason = F.when(~F.col("all_there"), "absent").when(F.col("known").isNull(), "no history")
    return known.select("job_id", reason.alias("reason")).where("reason is not null")


def unknown_outputs(nodes: DataFrame, hist_output: DataFrame) -> DataFrame:
    """(job_id): jobs with an output that history doesn't know."""
    parts = nodes.select("job_id", F.explode(F.split("job_id", SEPARATOR)).alias("output_name"))
    return parts.join(hist_output.select("job_id", "output_name"), ["job_id", "output_name"], "left_anti").select("job_id").distinct()


def same_fingerprint(up: Column, was: Column, now: Column) -> Column:
    """Whether two fingerprints of the job ``up`` say the same, by its class.

    A function's (of a job FI ...) holds Python's version, and hashes of source, byte code and closure: byte code is
    compared where both come from one version, else the source. All others are compared as texts.
    """
    a, b = F.split(was, "\\|"), F.split(now, "\\|")
    code = F.when((a[0] == b[0]) & (b[2] != ""), a[2] == b[2]).otherwise(a[1] == b[1])
    typed = up.startswith("FI ") & (F.size(a) == 4) & (F.size(b) == 4)
    return F.when(typed, code & (a[3] == b[3])).otherwise(was == now)


def edge_invalidated(edges: DataFrame | None, inputs: DataFrame, cur_output: DataFrame, hist_edge: DataFrame) -> DataFrame:
    """(up, down, invalidated): whether any output that ``down`` consumes of ``up`` differs from what it last consumed.

    Only consumed outputs are compared, by ``same_fingerprint``; no history of one counts as a difference. ``edges`` None:
    those that ``inputs`` name. History is compared with the outputs where a job's edges lie together; what is shuffled by
    edge is keys and whether they are the same, once, and a name that is its job's id isn't repeated.
    """

    def name(c: str) -> Column:
        return F.when(F.col(c) == F.col("up"), "=").otherwise(F.concat(F.lit("+"), c)).alias("output_name")

    now = cur_output.select(F.col("job_id").alias("up"), "output_name", F.col("hash").alias("now"))
    seen = hist_edge.select("up", "down", "output_name", F.col("hash").alias("was")).join(now, ["up", "output_name"], "left")
    same = F.coalesce(same_fingerprint(F.col("up"), F.col("was"), F.col("now")), F.lit(False))
    used = inputs.select("up", F.col("job_id").alias("down"), name("input_name"), F.lit("u").alias("row"), F.lit(None).cast("boolean").alias("same"))
    rows = used.where("up is not null and down is not null").union(seen.select("up", "down", name("output_name"), F.lit("h"), same))
    if edges is not None:
        rows = rows.union(edges.where("up is not null and down is not null").select("up", "down", F.lit(None).cast("string"), F.lit("e"), F.lit(None).cast("boolean")))
    by_output = spread(rows, "up", "down").groupBy("up", "down", "output_name").agg(
        F.bool_or(F.col("row") == "u").alias("used"), F.bool_or(F.col("row") == "e").alias("edge"), F.bool_and("same").alias("same")
    )
    found = by_output.groupBy("up", "down").agg(
        F.bool_or("used").alias("used"), F.bool_or("edge").alias("edge"), F.bool_or(F.col("used") & ~F.coalesce("same", F.lit(False))).alias("invalidated")
    )
    return found.where("used" if edges is None else "used and edge").select("up", "down", "invalidated")


def changed_jobs(inputs: DataFrame, cur_output: DataFrame, hist_edge: DataFrame) -> DataFrame:
    """(job_id): jobs of which ``edge_invalidated`` finds an edge invalidated, as a stored table.

    Where ``inputs`` and ``hist_edge`` lie by upstream (``dealt``), current outputs alone are shuffled, and the jobs found.
    """
    now = cur_output.select(F.col("job_id").alias("up"), "output_name", F.col("hash").alias("now"))
    seen = hist_edge.select("up", "down", "output_name", F.col("hash").alias("was")).join(now, ["up", "output_name"])
    same = seen.where(same_fingerprint(F.col("up"), F.col("was"), F.col("now"))).select("up", "down", "output_name")
    used = inputs.select("up", F.col("job_id").alias("down"), F.col("input_name").alias("output_name")).where("up is not null and down is not null")
    with by_first_key(inputs.sparkSession):
        return written(used.join(same, ["up", "down", "output_name"], "left_anti").select(F.col("down").alias("job_id")).distinct(), "changed")


def rename_match(lost: DataFrame, known: DataFrame) -> DataFrame:
    """(up, down, old_up, overlap): for edges without history, the former upstream of the same job with most common parts.

    ``lost`` (up, down), ``known`` (up, down): present edges and those of history. Ties go to the smallest old id. Names of
    at most ``FEW_PARTS`` parts meet by every choice of their parts, of which ``known`` keeps the smallest name: the largest
    choice that two share is what they have in common, so rows grow with the names and not with their pairs. Names of more
    parts meet all others of the job, a pair a common part.
    """
    parts = F.array_sort(F.array_distinct(F.split("up", SEPARATOR)))
    new, old = (df.where("up is not null and down is not null").select("down", "up", parts.alias("parts")) for df in (lost, known))
    few = F.size("parts") <= FEW_PARTS

    def choices(df: DataFrame) -> DataFrame:
        every = "transform(sequence(1, shiftleft(1, size(parts)) - 1), m -> filter(parts, (x, i) -> (shiftright(m, i) & 1) = 1))"
        return df.where(few).select("down", "up", F.explode(F.expr(every)).alias("common"))

    def one_by_one(a: DataFrame, b: DataFrame) -> DataFrame:
        mine, others = (df.select("down", F.col("up").alias(x), F.explode("parts").alias("part")).distinct() for df, x in ((a, "up"), (b, "old_up")))
        return mine.join(others, ["down", "part"]).groupBy("up", "down", "old_up").agg(F.count(F.lit(1)).cast("int").alias("overlap"))

    smallest = choices(old).groupBy("down", "common").agg(F.min("up").alias("old_up"))
    met = choices(new).join(smallest, ["down", "common"]).select("up", "down", "old_up", F.size("common").alias("overlap"))
    pairs = met.union(one_by_one(new.where(~few), old)).union(one_by_one(new.where(few), old.where(~few)))
    best = pairs.groupBy("up", "down").agg(F.min(F.struct((-F.col("overlap")).alias("most"), "old_up")).alias("best"))
    return best.select("up", "down", "best.old_up", (-F.col("best.most")).alias("overlap"))


def node_validation(nodes: DataFrame, edges: DataFrame | None, edge_state: DataFrame, hist_output: DataFrame) -> DataFrame:
    """(job_id, vstatus) from edge states (up, down, invalidated or null where ``up`` isn't done). ``edges`` None: all that
    decide are in ``edge_state``.

    Any invalidated edge: Invalidated. Else any pending one: Unknown. Else Validated, but an ephemeral without history is
    Invalidated.
    """
    told = (edge_state if edges is None else edges.join(edge_state, ["up", "down"], "left")).where(F.coalesce("invalidated", F.lit(True)))  # others decide nothing
    state = told.groupBy(F.col("down").alias("job_id")).agg(F.bool_or("invalidated").alias("bad"), F.count_if(F.col("invalidated").isNull()).alias("pending"))
    known = hist_output.select("job_id", F.lit(True).alias("known")).distinct()
    both = nodes.join(state, "job_id", "left").join(known, "job_id", "left")
    status = F.when(F.coalesce("bad", F.lit(False)), "Invalidated").when(F.coalesce("pending", F.lit(0)) > 0, "Unknown")
    status = status.when((F.col("kind") == EPHEMERAL) & F.col("known").isNull(), "Invalidated").otherwise("Validated")
    return both.select("job_id", status.alias("vstatus"))


def startup(nodes: DataFrame, changed: DataFrame, missing: DataFrame) -> DataFrame:
    """(job_id, state) before anything runs: Always jobs run; jobs with changed inputs or missing outputs are Invalidated."""
    both = nodes.join(changed, "job_id", "left").join(missing.select("job_id", F.lit(True).alias("missing")), "job_id", "left")
    state = F.when(F.col("kind") == ALWAYS, "Run").when(F.coalesce("changed", F.lit(False)) | F.coalesce("missing", F.lit(False)), "Invalidated").otherwise("Unknown")
    return both.select("job_id", state.alias("state"))


def sweep(nodes: DataFrame, edges: DataFrame, invalid: DataFrame) -> DataFrame:
    """(up, down, required) before anything runs: whether ``down`` needs what ``up`` gives.

    Edges into Always jobs and ``invalid`` (job_id) ones are required, those into other Output jobs aren't, and those into
    other ephemerals are where any edge out of them is: walked upwards from the first, each node once. ``edges`` is read
    again and again: give a stored table.
    """
    starts = nodes.where(F.col("kind") == ALWAYS).select("job_id").union(invalid.select("job_id")).distinct()
    need = required_walk(nodes, edges, starts).select(F.col("job_id").alias("down"), F.lit(True).alias("required"))
    return edges.select("up", "down").join(need, "down", "left").select("up", "down", F.coalesce("required", F.lit(False)).alias("required"))


def planned(nodes: DataFrame, edges: DataFrame, stale: DataFrame) -> DataFrame:
    """(job_id, action, cause) of what a run will do, before it does: Run, Depends or Skip.

    ``stale`` (job_id, cause): jobs that differ from history by what is known now. They run, and so do Always jobs, and
    ephemerals that have to deliver to what runs. What lies below a job that runs depends on whether that gives what it
    gave before, and so does an ephemeral that only such a job needs. An ephemeral below which nothing else lies is
    skipped. Closures over stored tables, each of which visits a node once: it always ends. Walks upwards go on from
    ephemerals alone, so they read the edges that leave one; where ``edges`` lie by upstream (``dealt``), these are stored by
    downstream.
    """
    nodes, rows = stored(nodes, "nodes", "job_id", "kind"), edges.__dict__.get("_rows")
    edges = stored(edges, "edges", "up", "down")
    eph = nodes.where(F.col("kind") == EPHEMERAL).select("job_id")
    feeds = edges.join(eph.withColumnRenamed("job_id", "up"), "up", "left_semi").select("up", "down")
    feeds = written(feeds, "feeds") if rows is None else dealt(feeds, "feeds", "down", rows)
    # all that lies below an idle ephemeral is idle as well
    idle = written(eph.join(ancestors(nodes.where(F.col("kind") != EPHEMERAL).select("job_id"), feeds), "job_id", "left_anti"), "idle")
    odd = written(stale.join(idle, "job_id", "left_anti").groupBy("job_id").agg(F.min("cause").alias("cause")), "stale")

    def givers(to: DataFrame) -> DataFrame:
        """Ephemerals that have to deliver if ``to`` run, and those of ``to`` themselves."""
        return ancestors(to, feeds).join(eph, "job_id", "left_semi").distinct()

    runs = odd.join(nodes, "job_id").where(F.col("kind") != ALWAYS).select("job_id", "cause")
    need = givers(runs.union(nodes.where(F.col("kind") == ALWAYS).select("job_id", F.lit("always")))).join(runs, "job_id", "left_anti")
    sure = written(runs.union(need.select("job_id", F.lit("needed below"))).union(nodes.where(F.col("kind") == ALWAYS).select("job_id", F.lit("always"))), "sure")
    # what an ephemeral gives that only runs because it is needed is what it gave before
    below = descendants(odd.select("job_id"), edges).join(sure, "job_id", "left_anti")
    below = written(below.join(idle, "job_id", "left_anti"), "below")
    perhaps = below.union(givers(below).join(sure, "job_id", "left_anti")).distinct().withColumn("cause", F.lit("above"))
    dropped(feeds)
    both = nodes.join(sure.withColumn("action", F.lit("Run")).union(perhaps.withColumn("action", F.lit("Depends"))), "job_id", "left")
    return both.select("job_id", F.coalesce("action", F.lit("Skip")).alias("action"), "cause")


def downstream_requirement(edges: DataFrame | None, required: DataFrame) -> DataFrame:
    """(job_id, requirement): yes if any edge out of a job is required, unknown if any is undecided, else no.

    ``edges`` None: those of ``required``."""
    both = required if edges is None else edges.join(required.select("up", "down", "required"), ["up", "down"], "left")
    said = F.when(F.bool_or("required"), "yes").when(F.count_if(F.col("required").isNull()) > 0, "unknown").otherwise("no")
    return both.groupBy(F.col("up").alias("job_id")).agg(said.alias("requirement"))


def ready(nodes: DataFrame, edges: DataFrame, states: DataFrame) -> DataFrame:
    """(job_id): jobs to run (state Run or Invalidated) all of whose upstreams are finished (Success or Skipped). Edges may repeat."""
    done = states.where(F.col("state").isin("Success", "Skipped")).select(F.col("job_id").alias("up"))
    waiting = edges.join(done, "up", "left_anti").select(F.col("down").alias("job_id")).distinct()
    return nodes.select("job_id").join(states.where(F.col("state").isin("Run", "Invalidated")), "job_id", "left_semi").join(waiting, "job_id", "left_anti")


def cleanup_ready(nodes: DataFrame, edges: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(job_id): ephemerals that succeeded and all of whose direct downstreams ended, none of them failed."""
    ended = outcomes.select(F.col("job_id").alias("down"), "outcome")
    below = edges.join(ended, "down", "left").groupBy(F.col("up").alias("job_id")).agg(
        F.bool_and(F.coalesce(F.col("outcome").isin("Success", "Skipped"), F.lit(False))).alias("clean")
    )
    own = nodes.where(F.col("kind") == EPHEMERAL).join(outcomes.where(F.col("outcome") == "Success").select("job_id"), "job_id", "left_semi")
    return own.join(below, "job_id", "left").where(F.coalesce("clean", F.lit(True))).select("job_id")


def changed_ephemerals(validated: DataFrame, cur_output: DataFrame, hist_output: DataFrame) -> DataFrame:
    """(job_id): validated ephemerals that ran again and gave another output: constant input has to give constant output."""
    now = cur_output.join(validated.select("job_id"), "job_id", "left_semi")
    was = hist_output.select("job_id", "output_name", F.col("hash").alias("was"))
    return now.join(was, ["job_id", "output_name"], "left").where(~(F.col("hash").eqNullSafe(F.col("was")))).select("job_id").distinct()


def decisions(nodes: DataFrame, edges: DataFrame, states: DataFrame, validation: DataFrame, requirement: DataFrame) -> DataFrame:
    """(job_id, action) of the jobs that have no outcome yet: UpstreamFailed, Run, Skip or Wait.

    ``states`` (job_id, state) holds outcomes, ``validation`` (job_id, vstatus) and ``requirement`` (job_id, requirement)
    what ``node_validation`` and ``downstream_requirement`` give. A failed upstream decides first. Jobs run once all
    upstreams have ended: Always jobs, invalidated Output jobs, validated ephemerals that a job below needs, and
    invalidated ephemerals unless none does. Validated Output jobs, and ephemerals that none needs, are skipped once all
    upstreams have ended or pass: a validated ephemeral with nothing undecided above it passes, as it would give what it
    gave. All others wait. Some job always runs or is skipped while any is left, so taking the actions in turn ends.
    """
    edges = stored(edges, "edges", "up", "down")
    left = written(nodes.select("job_id", "kind").join(states.select("job_id"), "job_id", "left_anti").join(validation, "job_id", "left").join(requirement, "job_id", "left"), "left")
    may = (F.col("kind") == EPHEMERAL) & F.coalesce(F.col("vstatus") == "Validated", F.lit(False))
    passing = left.where(may).select("job_id").join(descendants(left.where(~may).select("job_id"), edges), "job_id", "left_anti")
    known = states.select(F.col("job_id").alias("up"), "state").union(passing.select(F.col("job_id").alias("up"), F.lit("Passing")))
    state = F.coalesce("state", F.lit("Open"))
    above = edges.join(known, "up", "left").groupBy(F.col("down").alias("job_id")).agg(
        F.bool_or(state.isin("Failed", "UpstreamFailed")).alias("failed"), F.bool_and(state.isin("Success", "Skipped")).alias("ended"), F.bool_and(state.isin("Success", "Skipped", "Passing")).alias("passed")
    )
    both = left.join(above, "job_id", "left").withColumns({"ended": F.coalesce("ended", F.lit(True)), "passed": F.coalesce("passed", F.lit(True)), "need": F.coalesce("requirement", F.lit("no"))})
    output = F.col("kind") == OUTPUT
    runs = (F.col("kind") == ALWAYS) | output & (F.col("vstatus") == "Invalidated") | (F.col("kind") == EPHEMERAL) & ((F.col("need") == "yes") | (F.col("need") == "unknown") & (F.col("vstatus") == "Invalidated"))
    skips = F.when(output, F.col("vstatus") == "Validated").otherwise((F.col("kind") == EPHEMERAL) & (F.col("need") == "no"))
    action = F.when(F.coalesce("failed", F.lit(False)), "UpstreamFailed").when(runs & F.col("ended"), "Run").when(skips & F.col("passed"), "Skip").otherwise("Wait")
    return both.select("job_id", action.alias("action"))
