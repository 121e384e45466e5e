"""The corpus pipeline: each stage calls one operator of brookloom.llm, and is written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookloom.llm import language, queries, shingle_join, toxicity
from brookloom.llm.shared import drop_stage, quoted, scratch, ship, stage, unused

#: Rows that may be broadcast to take rejected documents out; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` stored with a number for each row, and that column's name."""
    ship(docs.sparkSession)
    (row,) = unused(docs, "_row")
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def without_rejected(stored: DataFrame, rejected: DataFrame, row: str) -> DataFrame:
    """The rows of ``stored`` whose numbers aren't in ``rejected``, without their numbers."""
    gone = stage(rejected.select(row), "rejected")
    return stored.join(kept_or_not(gone, row), row, "left_anti").select(*map(quoted, stored.columns)).drop(row)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without words, of an unknown language or of no clear one go."""
    stored, row = numbered(docs)
    found = language.identify_documents(stored, [row], "text", "lang", "source")
    return without_rejected(stored, found.where("rejected"), row)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7. Labels are learned from rows whose crc32(doc_id as text) mod 3 is not 1."""
    model = queries.toxicity_model(spark, sf_dir, docs)
    (score,) = unused(docs, "_score")
    return toxicity.score(docs, model, "text", score).where(F.col(score) < 0.7).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five words, a similarity of 0.8. Texts without words are in no group.

    It has the smallest doc_id, nulls last, then the smallest hash of its text; of rows that are alike in both, a number
    that Spark gives each stored row decides: so of rows that repeat, or copies without ids, one stays.
    """
    stored, row = numbered(docs)
    rows = stored.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.col(row).alias("row"))
    groups = shingle_join.similar_groups(rows, "row", "text", 5, 80, 100)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "row")
    grouped = stage(groups.where("n_shingles > 0").select("row", "component_id", rank.alias("rank")), "groups")
    # minima are taken before the shuffle, and the rows of a hot group are never brought together
    firsts = stage(grouped.groupBy("component_id").agg(F.min("rank")["row"].alias("row"), F.count(F.lit(1)).alias("n")).where("n > 1"), "firsts")
    gone = grouped.join(kept_or_not(firsts, "component_id"), "component_id", "left_semi").join(kept_or_not(firsts, "row"), "row", "left_anti")
    return without_rejected(stored, gone.select(F.col("row").alias(row)), row)


def kept_or_not(keys: DataFrame, name: str) -> DataFrame:
    """The keys, to be broadcast where they are few."""
    found = keys.select(name)
    return F.broadcast(found) if keys.count() <= BROADCAST_ROWS else found


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, packed into sequences of 1024 tokens."""
    return queries.op1_packing(spark, sf_dir, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("packing", packing_stage),
]

#: SQL has no tokenizer: tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has stored on its way is deleted once its result is stored."""
    docs, last = queries.table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        with scratch() as kept:
            after = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
            kept.append(after)
        if last is not None:
            drop_stage(last)
        docs = last = after
    return STAGES[-1][1](spark, docs, sf_dir)
