"""Results shared by many pipelines: stored once under the hash of their rows, found by the key of their inputs.

Layout of a store; each JSON file is put where none is, or belongs to one writer, and no folder is ever moved:
  tables/   what builders wrote, a folder each
  outputs/  by the hash of a table's rows, where it is
  keys/     by the key of the inputs, the hashes of the outputs by name
  claims/   by the key, who builds it now; numbered, so that a dead builder's is followed by the next one's
  uses/     by pipeline, the key that it uses

As tables: by_input(prefix, input_key, output_key), used_by(prefix, input_key).
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookloom.plans.tables import claimed, delete, exists, frame, names_in, path_of, read_text, write_text

BY_INPUT, USED_BY = "prefix string, input_key string, output_key string", "prefix string, input_key string"


def unreferenced(by_input: DataFrame, used_by: DataFrame) -> DataFrame:
    """(prefix, output_key): stored outputs none of whose input keys any pipeline still uses."""
    stay = by_input.join(used_by.select("input_key").distinct(), "input_key", "left_semi")
    gone = by_input.join(used_by.select("input_key").distinct(), "input_key", "left_anti")
    return gone.select("prefix", "output_key").distinct().join(stay.select("prefix", "output_key"), ["prefix", "output_key"], "left_anti")


class Conflict(Exception):
    """Equal inputs gave another table."""


class Store:
    """``stale``: seconds without a sign of life after which a builder counts as dead. ``grace``: seconds that what no
    pipeline uses is kept."""

    def __init__(self, spark: SparkSession, path: str, stale: float = 600.0, grace: float = 7 * 86_400.0, poll: float = 0.2):
        self.spark, self.path, self.stale, self.grace, self.poll = spark, path.rstrip("/"), stale, grace, poll

    def _read(self, name: str) -> dict | None:
        return json.loads(read_text(self.spark, f"{self.path}/{name}")) if exists(self.spark, f"{self.path}/{name}") else None

    def _age(self, name: str) -> float:
        system, where = path_of(self.spark, f"{self.path}/{name}")
        return time.time() - system.getFileStatus(where).getModificationTime() / 1000 if system.exists(where) else float("inf")

    def place(self, output: str) -> str | None:
        """Where the table with this hash is; None if it was swept."""
        found = self._read(f"outputs/{output}.json")
        return f"{self.path}/{found['folder']}" if found and exists(self.spark, f"{self.path}/{found['folder']}/_SUCCESS") else None

    def found(self, key: str) -> dict[str, str] | None:
        """{name: hash} of what is stored for a key, if all of it is there."""
        known = self._read(f"keys/{key}.json")
        return known["outputs"] if known and all(self.place(o) for o in known["outputs"].values()) else None

    def use(self, pipeline: str, key: str) -> None:
        name = hashlib.sha256(pipeline.encode()).hexdigest()
        write_text(self.spark, f"{self.path}/uses/{name}.json", json.dumps({"pipeline": pipeline, "input_key": key}), overwrite=True)

    def used(self, pipeline: str) -> str | None:
        found = self._read(f"uses/{hashlib.sha256(pipeline.encode()).hexdigest()}.json")
        return found["input_key"] if found else None

    # --- building
    def _claims(self, key: str) -> list[str]:
        return sorted(n for n in names_in(self.spark, f"{self.path}/claims") if n.startswith(f"{key}.") and n.endswith(".json"))

    @contextmanager
    def _alive(self, claim: str, owner: str) -> Iterator[None]:
        ended = threading.Event()

        def beat() -> None:
            while not ended.wait(self.stale / 4):
                write_text(self.spark, f"{self.path}/claims/{claim}", owner, overwrite=True)

        thread = threading.Thread(target=beat, daemon=True)
        thread.start()
        try:
            yield
        finally:
            ended.set()
            thread.join()

    def built(self, key: str, owner: str, make: Callable[[str], dict[str, str]]) -> dict[str, str]:
        """{name: hash} of the tables for a key: those stored, or what ``make(folder)`` writes to folder/name.

        Of pipelines that ask at once one builds and the others wait for it. A builder that fails, or dies, leaves the key
        to the next one. A table that equals a stored one isn't kept twice. Fails with Conflict where a key that was built
        before, and swept, now gives something else.
        """
        while True:
            if known := self.found(key):
                return known
            claims = self._claims(key)
            if not claims or self._age(f"claims/{claims[-1]}") > self.stale:
                claim = f"{key}.{int(claims[-1].split('.')[1]) + 1 if claims else 0:06d}.json"
                if claimed(self.spark, f"{self.path}/claims/{claim}", owner):
                    if known := self.found(key):  # built since we looked
                        delete(self.spark, f"{self.path}/claims/{claim}")
                        return known
                    break
            time.sleep(self.poll)
        folder = f"tables/{key}-{uuid.uuid4().hex}"
        try:
            with self._alive(claim, owner):
                made = make(f"{self.path}/{folder}")
                known = self._read(f"keys/{key}.json")
                if known and known["outputs"] != made:
                    raise Conflict(key)
                for name, output in made.items():
                    self._keep(output, f"{folder}/{name}")
                claimed(self.spark, f"{self.path}/keys/{key}.json", json.dumps({"input_key": key, "outputs": made}))
        except BaseException:
            delete(self.spark, f"{self.path}/{folder}")
            raise
        finally:
            for c in self._claims(key):
                delete(self.spark, f"{self.path}/claims/{c}")
        return made

    def _keep(self, output: str, folder: str) -> None:
        """Name a table by its hash, unless one of that hash is there."""
        entry = f"{self.path}/outputs/{output}.json"
        if self.place(output) is None:
            delete(self.spark, entry)
        if not claimed(self.spark, entry, json.dumps({"folder": folder})):
            self._drop(folder)

    def _drop(self, folder: str) -> None:
        """Delete a table, with its build's folder if that was the last one."""
        delete(self.spark, f"{self.path}/{folder}")
        build = f"{self.path}/{folder.rpartition('/')[0]}"
        if not [n for n in names_in(self.spark, build) if not n.startswith(".")]:
            delete(self.spark, build)

    # --- sweeping
    def tables(self) -> tuple[DataFrame, DataFrame]:
        """by_input and used_by."""
        spark = self.spark

        def read(name: str, schema: str) -> DataFrame:
            return spark.read.schema(schema).json(f"{self.path}/{name}") if names_in(spark, f"{self.path}/{name}") else frame(spark, [], schema)

        keys = read("keys", "input_key string, outputs map<string,string>")
        by_input = keys.select(F.lit("").alias("prefix"), "input_key", F.explode(F.map_values("outputs")).alias("output_key"))
        return by_input, read("uses", "pipeline string, input_key string").select(F.lit("").alias("prefix"), "input_key")

    def sweep(self) -> list[str]:
        """Delete stored tables that no pipeline uses and that are older than ``grace``, and what dead builders left; the
        hashes of the tables gone. Uses are looked at once more before a table goes; one that is taken up in that very
        moment is found missing by its pipeline's next run, and built again."""
        spark, gone = self.spark, []
        for row in unreferenced(*self.tables()).toLocalIterator():
            output = row["output_key"]
            entry = self._read(f"outputs/{output}.json")
            if entry and self._age(f"outputs/{output}.json") >= self.grace:
                by_input, used = self.tables()
                if by_input.where(F.col("output_key") == output).join(used, "input_key", "left_semi").isEmpty():
                    delete(spark, f"{self.path}/outputs/{output}.json")
                    self._drop(entry["folder"])
                    gone.append(output)
        held = {json.loads(read_text(spark, f"{self.path}/outputs/{n}"))["folder"].split("/")[1] for n in names_in(spark, f"{self.path}/outputs") if n.endswith(".json")}
        for n in names_in(spark, f"{self.path}/tables"):
            if n not in held and self._age(f"tables/{n}") >= max(self.grace, self.stale) and not self._claims(n.split("-")[0]):
                delete(spark, f"{self.path}/tables/{n}")
        return gone
