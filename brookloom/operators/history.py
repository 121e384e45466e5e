"""History: merge of a run into the stored tables, difference of two states, removal of chosen jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookloom.operators.graph import EPHEMERAL


def merge_outputs(old: DataFrame, new: DataFrame, outcomes: DataFrame) -> DataFrame:
    """hist_output after a run: rows of jobs that gave an output are replaced; those of jobs that took part, gave none and
    weren't kept from running by a failure above go; those of jobs that took no part, or were skipped, stay."""
    gone = outcomes.where(~F.col("outcome").isin("Skipped", "UpstreamFailed", "Pruned")).select("job_id")
    kept = old.join(new.select("job_id").union(gone).distinct(), "job_id", "left_anti")
    return kept.unionByName(new.select(*old.columns))


def merge_inputs(old: DataFrame, digests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """hist_inputs after a run: of jobs that ran or were skipped the present digest, none of failed ones, else as before."""
    good = outcomes.where(F.col("outcome").isin("Success", "Skipped")).select("job_id")
    gone = outcomes.where(~F.col("outcome").isin("UpstreamFailed", "Pruned")).select("job_id")
    return old.join(gone, "job_id", "left_anti").unionByName(digests.join(good, "job_id", "left_semi").select(*old.columns))


def merge_edges(old: DataFrame, nodes: DataFrame, edges: DataFrame, inputs: DataFrame, cur_output: DataFrame, hist_output: DataFrame, outcomes: DataFrame, buckets: int | None = None) -> DataFrame:
    """hist_edge after a run.

    Rows of an edge that is gone while both its jobs are there go; rows of absent jobs stay. Of an edge into a job that
    gave an output, or an ephemeral that was skipped: the upstream's new output, else the row as it was, else the
    upstream's stored output. Where ``old`` and ``edges`` lie by upstream in so many ``buckets`` (``dealt``), they are merged
    where they lie.
    """
    given = outcomes.where(F.col("outcome") == "Success").select("job_id")
    passed = nodes.where(F.col("kind") == EPHEMERAL).join(outcomes.where(F.col("outcome") == "Skipped").select("job_id"), "job_id", "left_semi").select("job_id")
    used = inputs.select("up", F.col("job_id").alias("down"), F.col("input_name").alias("output_name"))
    fresh = used.join(given.union(passed).withColumnRenamed("job_id", "down").distinct(), "down", "left_semi")
    names = ["up", "output_name"]
    fresh = fresh.join(cur_output.select(F.col("job_id").alias("up"), "output_name", F.col("hash").alias("now")), names, "left").join(
        hist_output.select(F.col("job_id").alias("up"), "output_name", F.col("hash").alias("stored")), names, "left"
    )
    # old and fresh rows and edges meet in one shuffle; of old rows without either, whether both jobs are there
    none, name = F.lit(None).cast("binary"), F.when(F.col("output_name") == F.col("up"), "=").otherwise(F.concat(F.lit("+"), "output_name"))
    rows = old.select("up", "down", name.alias("name"), packed("hash").alias("was"), none.alias("now"), none.alias("stored"), F.lit(False).alias("fresh"), F.lit(False).alias("edge"))
    fresh = fresh.select("up", "down", name, none, packed("now"), F.when(F.col("now").isNull(), packed("stored")), F.lit(True), F.lit(False))
    rows = rows.union(fresh if buckets is None else fresh.repartition(buckets, "up"))
    rows = rows.union(edges.select("up", "down", F.lit(None).cast("string"), none, none, none, F.lit(False), F.lit(True)))
    both = (rows.repartition("up", "down") if buckets is None else rows).groupBy("up", "down", "name").agg(*[F.max(c).alias(c) for c in ("was", "now", "stored", "fresh", "edge")])
    both = both.withColumn("stays", F.max(F.col("edge")).over(Window.partitionBy("up", "down")) | F.col("fresh"))
    found = F.when(F.col("fresh"), F.coalesce("now", "was", "stored")).otherwise(F.col("was"))
    both = both.select("up", "down", "name", found.alias("found"), "stays").where("found is not null")
    here = nodes.select("job_id", F.lit(True).alias("there"))
    left = both.where(~F.col("stays")).join(here.select(F.col("job_id").alias("up"), F.col("there").alias("a")), "up", "left").join(here.select(F.col("job_id").alias("down"), F.col("there").alias("b")), "down", "left")
    kept = both.where("stays").union(left.where("a is null or b is null").select(*both.columns))
    name = F.when(F.col("name") == "=", F.col("up")).otherwise(F.expr("substring(name, 2)"))
    return kept.select("up", "down", name.alias("output_name"), unpacked("found").alias("hash"))


def packed(c: str) -> Column:
    """A text as bytes: of one in lower hexadecimal digits, as digests are, half as many, after a byte that tells which."""
    digits = F.length(F.translate(c, "0123456789abcdef", "")) == 0
    return F.when(digits & (F.length(c) % 2 == 0), F.concat(F.unhex(F.lit("01")), F.unhex(c))).otherwise(F.concat(F.unhex(F.lit("00")), F.encode(c, "UTF-8")))


def unpacked(c: str) -> Column:
    rest = F.expr(f"substring({c}, 2)")
    return F.when(F.expr(f"substring({c}, 1, 1)") == F.unhex(F.lit("01")), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def recorded(hist_output: DataFrame, hist_inputs: DataFrame, made: DataFrame, no_inputs: str) -> tuple[DataFrame, DataFrame]:
    """hist_output and hist_inputs with ``made`` (job_id, output_name, hash), as if these jobs had run without inputs.

    Jobs of which history has an output or an input digest stay as they are. ``no_inputs``: the digest of no inputs.
    """
    known = hist_output.select("job_id").union(hist_inputs.select("job_id")).distinct()
    new = made.join(known, "job_id", "left_anti")
    digests = new.select("job_id").distinct().withColumn("input_digest", F.lit(no_inputs))
    return hist_output.unionByName(new.select(*hist_output.columns)), hist_inputs.unionByName(digests.select(*hist_inputs.columns))


def merge_files(old: DataFrame, seen: list[DataFrame]) -> DataFrame:
    """Fingerprints of input files after a run: those seen in it, and the others as before."""
    out = old
    for new in seen:
        out = out.join(new.select("path").distinct(), "path", "left_anti").unionByName(new.select(*old.columns).dropDuplicates(["path"]))
    return out


def beyond(logs: DataFrame, group: list[str], order: list[str], keep: int) -> DataFrame:
    """The rows of each group that aren't among the last ``keep`` by the columns ``order``: logs that may go."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*[F.desc(c) for c in order]))
    return logs.withColumn("_rank", rank).where(F.col("_rank") > keep).drop("_rank")


def difference(old: DataFrame, new: DataFrame, keys: list[str], value: str = "hash") -> DataFrame:
    """(keys, status, was, now): added, removed or changed rows."""
    a = old.select(*keys, F.col(value).alias("was"), F.lit(True).alias("_old"))
    b = new.select(*keys, F.col(value).alias("now"), F.lit(True).alias("_new"))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return a.join(b, keys, "full").select(*keys, status.alias("status"), "was", "now").where("status is not null")


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows by which ``new`` differs from ``old``, with ``gone`` where only ``old`` has the key: what ``latest`` makes
    ``new`` of again. Keys have no nulls and are there once."""
    values = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*values).alias("_was"), F.lit(True).alias("_in_old"))
    b = new.select(*keys, F.struct(*values).alias("_now"), F.lit(True).alias("_in_new"))
    both = a.join(b, keys, "full").where(~(F.col("_was").eqNullSafe(F.col("_now")) & F.col("_in_old").eqNullSafe(F.col("_in_new"))))
    return both.select(*keys, *[F.col(f"_now.{v}").alias(v) for v in values], F.col("_in_new").isNull().alias("gone"))


def latest(base: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with the newest row of each key in ``changed`` (by its column version) in its place, or without it where that
    row is ``gone``. ``base`` is read as it is: only the changes are grouped, and few of them are broadcast."""
    rest = [c for c in changed.columns if c not in keys]
    newest = changed.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_newest")).select(*keys, *[F.col(f"_newest.{c}").alias(c) for c in rest])
    return base.join(newest.select(*keys), keys, "left_anti").unionByName(newest.where(~F.col("gone")).select(*base.columns))


def without_jobs(hist_output: DataFrame, hist_inputs: DataFrame, hist_edge: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """History without the rows of ``jobs`` (job_id), matched as whole ids: what they and their consumers do runs again."""
    ids = jobs.select("job_id").distinct()
    edges = hist_edge.join(ids.withColumnRenamed("job_id", "up"), "up", "left_anti").join(ids.withColumnRenamed("job_id", "down"), "down", "left_anti")
    return hist_output.join(ids, "job_id", "left_anti"), hist_inputs.join(ids, "job_id", "left_anti"), edges.select(*hist_edge.columns)


def outcome_summary(nodes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(outcome, n): jobs by their outcome; those without one were skipped. Of several passes, a failure is final."""
    last = outcomes.groupBy("job_id").agg(F.when(F.bool_or(F.col("outcome") == "Failed"), "Failed").otherwise(F.max_by("outcome", "pass")).alias("outcome"))
    return nodes.join(last, "job_id", "left").groupBy(F.coalesce("outcome", F.lit("Skipped")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
