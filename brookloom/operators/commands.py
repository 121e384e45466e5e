"""Commands of the operating system as Spark tasks: a process for each row, or one that a partition's rows stream through.

What a command reads and gives are columns, so nothing is left on a machine: a task that is tried again gives its rows
again, and the table that holds them is written once by Spark's own commit.
"""

from __future__ import annotations

import contextlib
import os
import subprocess
import tempfile
import threading
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns that ``outcomes`` adds.
OUTCOME = "return_code int, stdout string, stderr string, files map<string,binary>"
#: Return codes of commands that weren't started, and of those that were stopped after ``seconds``.
NOT_STARTED, STOPPED = 127, 124


def outcomes(
    df: DataFrame, command: str = "command", stdin: str | None = None, made: Iterable[str] = (), at_once: int | None = None, seconds: float | None = None, env: dict[str, str] | None = None
) -> DataFrame:
    """Run each row's ``command`` (array of texts); the row's columns and return_code, stdout, stderr, files.

    ``stdin``: column with the text or bytes that the command reads. ``made``: names of files whose bytes are kept where
    the command makes them; a missing one has no entry. Rows are dealt evenly over ``at_once`` tasks (as many as the
    cluster runs at once unless given), and a task runs its commands one by one, so an executor holds one command's output
    for each of its cores. A null or empty command, and one that can't be started, give 127; one that takes longer than
    ``seconds`` is stopped and gives 124. Repeated rows run each. Columns of ``df`` that are named like the new ones give
    way to them; an empty table stays empty. Output that isn't UTF-8 is read with replacement characters.
    """
    added = StructType.fromDDL(OUTCOME)
    names, made = {f.name.lower() for f in added.fields}, list(made)
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    read = [f.name for f in df.schema.fields]
    tasks = at_once or df.sparkSession.sparkContext.defaultParallelism
    schema = StructType([*kept, *added.fields])
    spread = df.repartition(tasks)

    # inside, as all that tasks call: executors need nothing of this package
    def text(found: bytes | None) -> str:
        return (found or b"").decode("utf-8", "replace")

    def ran(words: list[str] | None, given: bytes) -> tuple[int, str, str, list[tuple[str, bytes]]]:
        if not words or any(w is None for w in words):
            return NOT_STARTED, "", "no command", []
        # the executor's own folder, which goes with the application; the command's goes with the command
        with tempfile.TemporaryDirectory(dir=SparkFiles.getRootDirectory()) as folder:
            try:
                done = subprocess.run(words, input=given, capture_output=True, cwd=folder, env={**os.environ, **(env or {})}, timeout=seconds, check=False)
                code, out, err = done.returncode, text(done.stdout), text(done.stderr)
            except subprocess.TimeoutExpired as e:
                code, out, err = STOPPED, text(e.stdout), f"{text(e.stderr)}stopped after {seconds} s"
            except (OSError, ValueError) as e:
                code, out, err = NOT_STARTED, "", str(e)
            files = []
            for name in made:
                if os.path.isfile(f"{folder}/{name}"):
                    with open(f"{folder}/{name}", "rb") as f:
                        files.append((name, f.read()))
        return code, out, err, files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(read)}
            for i in range(batch.num_rows):
                given = columns[stdin][i].as_py() if stdin else None
                given = given.encode() if isinstance(given, str) else bytes(given or b"")
                found = ran(columns[command][i].as_py(), given)
                values = [columns[f.name].slice(i, 1) for f in kept]
                values += [pa.array([x], kind) for x, kind in zip(found, (pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.binary())), strict=True)]
                yield pa.RecordBatch.from_arrays(values, [f.name for f in schema.fields])

    return spread.mapInArrow(run, schema)


def piped(df: DataFrame, line: str, command: list[str], env: dict[str, str] | None = None) -> DataFrame:
    """(line): what ``command`` writes when it reads the texts of column ``line``, one process for each partition.

    Rows stream through the process: neither side is held whole. Nulls are left out; a text that holds line feeds is as many
    lines. Which rows share a process is up to Spark, so a command has to give what can be put together afterwards (partial
    sums, or lines of their own). A partition without rows starts the command too, as a pipe does. A return code other
    than 0 fails the task with what the command wrote to its error output; a task that is tried again starts anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, env={**os.environ, **(env or {})})
        errors: list[bytes] = []
        failed: list[BaseException] = []

        def feed() -> None:
            try:
                for batch in batches:
                    for x in batch.column(0):
                        if x.is_valid:
                            process.stdin.write(x.as_py().encode() + b"\n")
            except BrokenPipeError:
                pass  # the command has read enough; its return code tells whether it was content
            except BaseException as e:  # noqa: BLE001  raised again by the task's own thread
                failed.append(e)
            finally:
                with contextlib.suppress(BrokenPipeError):
                    process.stdin.close()

        def listen() -> None:
            # the last 64 KB at most
            for chunk in iter(lambda: process.stderr.read(8_192), b""):
                errors.append(chunk)
                del errors[:-8]

        helpers = [threading.Thread(target=f, daemon=True) for f in (feed, listen)]
        for h in helpers:
            h.start()
        try:
            held: list[str] = []
            for got in process.stdout:
                held.append(got.removesuffix(b"\n").decode("utf-8", "replace"))
                if len(held) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["line"])
                    held = []
            code = process.wait()
            for h in helpers:
                h.join()
            if failed:
                raise failed[0]
            if code:
                raise RuntimeError(f"{command} ended with {code}: {b''.join(errors).decode('utf-8', 'replace')}")
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["line"])
        finally:
            if process.poll() is None:
                process.kill()

    return df.select(F.col(line).cast("string").alias("line")).mapInArrow(run, "line string")


def refused(found: DataFrame, allowed_codes: Iterable[int], made: Iterable[str], shown: int = 5) -> tuple[int, list[str]]:
    """How many outcomes have a return code that isn't allowed or lack a file; of a few of them, what they are."""
    lacks = [~F.map_contains_key("files", name) for name in made]
    bad = found.where(~F.col("return_code").isin(list(allowed_codes)) | (F.exists(F.array(*lacks), lambda x: x) if lacks else F.lit(False)))
    few = bad.select("command", "return_code", F.substring("stderr", 1, 500).alias("stderr"), F.map_keys("files").alias("has")).limit(shown).collect()
    return (bad.count() if few else 0), [f"{list(r.command or [])} ended with {r.return_code}, made {r.has}: {r.stderr}" for r in few]
