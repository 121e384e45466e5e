"""python -m brookloom.cli COMMAND: look at a pipeline's history as of any version, compare two, make chosen jobs run again,
record tables that are there as made, hash files."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from brookloom.functions.digests import table_digest
from brookloom.operators import history
from brookloom.plans.pipeline import NO_NAMES, OUTPUTS
from brookloom.plans.tables import frame
from brookloom.plans.versions import KINDS, History
from brookloom.sources import files


def show(df: DataFrame) -> None:
    """Rows one by one: the driver holds one partition at a time."""
    for row in df.toLocalIterator():
        print("\t".join("" if x is None else str(x) for x in row))


def publish(kept: History, after: dict[str, DataFrame]) -> None:
    """A version in which the tables of ``after`` are as given."""
    at = kept.manifest()["version"]
    changed = {kind: history.changes(kept.table(kind, at), df, KINDS[kind][0]) for kind, df in after.items()}
    kept.publish(changed, at, int(time.time() * 1000))


def forget(spark: SparkSession, root: str, jobs: list[str], sure: bool = False) -> None:
    """Take the rows of ``jobs`` out of history. Asks for the word yes first, unless ``sure``."""
    if not sure and input(f"make {', '.join(jobs)} run again? Type yes: ").strip() != "yes":
        print("nothing done")
        return
    kept, ids = History(spark, root), frame(spark, [(j,) for j in jobs], "job_id string")
    left = history.without_jobs(*(kept.table(k) for k in ("outputs", "inputs", "edges")), ids)
    publish(kept, dict(zip(("outputs", "inputs", "edges"), left, strict=True)))


def record(spark: SparkSession, root: str, names: list[str]) -> None:
    """Take tables of datasets that history doesn't know, and that have no inputs, for made: they don't run again."""
    made = frame(spark, [(n, n, table_digest(spark.read.parquet(f"{root}/{n}"))) for n in names], OUTPUTS)
    kept = History(spark, root)
    outputs, inputs = history.recorded(kept.table("outputs"), kept.table("inputs"), made, NO_NAMES)
    publish(kept, {"outputs": outputs, "inputs": inputs})


def compared(spark: SparkSession, roots: list[str], runs: list[int] | None, versions: list[int] | None) -> DataFrame:
    """What jobs gave, in two pipelines, or in one as of two runs or versions."""
    kept = [History(spark, r) for r in (roots * 2)[:2]]
    at = [h.of_run(r) for h, r in zip(kept, runs, strict=True)] if runs else versions or [None, None]
    return history.difference(*(h.table("outputs", v) for h, v in zip(kept, at, strict=True)), ["job_id", "output_name"])


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    words = {"history": ["root"], "history-diff": ["root"], "versions": ["root"], "forget": ["root", "job"], "record": ["root", "job"], "hash-file": ["path"]}
    for name, own in words.items():
        one = commands.add_parser(name)
        for w in own:
            one.add_argument(w, nargs="+" if w == "job" or name == "history-diff" else None)
        if name == "forget":
            one.add_argument("--yes", action="store_true", help="don't ask")
        if name == "history-diff":
            one.add_argument("--runs", type=int, nargs=2)
        if name in ("history", "history-diff"):
            one.add_argument("--version", type=int, nargs=1 if name == "history" else 2)
    said = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if said.command == "history":
        show(History(spark, said.root).table("outputs", said.version[0] if said.version else None).orderBy("job_id", "output_name"))
    elif said.command == "history-diff":
        show(compared(spark, said.root, said.runs, said.version).orderBy("job_id"))
    elif said.command == "versions":
        kept = History(spark, said.root)
        for v in kept.versions():
            found = kept.manifest(v)
            print(v, found["run_id"], time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(found["time"])), sep="\t")
    elif said.command == "forget":
        forget(spark, said.root, said.job, said.yes)
    elif said.command == "record":
        record(spark, said.root, said.job)
    else:
        show(files.fingerprints(spark, [said.path]))


if __name__ == "__main__":
    main()
