"""Fingerprints: of rows, tables, parameters, names and inputs."""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
from collections.abc import Mapping
from datetime import date, datetime, time, timedelta
from decimal import Decimal
from enum import Enum
from typing import Any
from uuid import UUID

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

SEPARATOR = ":::"
NO_INPUT = "no_input"


def row_digest(*columns: str | Column) -> Column:
    """SHA-256 of columns as JSON, so that nulls, empty texts and neighbours aren't mixed up."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) if isinstance(c, str) else c for c in columns]), {"ignoreNullFields": "false"}), 256)


def measures(df: DataFrame) -> list[Column]:
    """Aggregates by which tables are told apart: a count and two sums of row hashes, over any order of the rows.

    Maps are hashed as their sorted entries. Repeated rows count.
    """
    plain = [F.array_sort(F.map_entries(quoted(f.name))) if f.dataType.typeName() == "map" else quoted(f.name) for f in df.schema.fields]
    one = F.xxhash64(*plain) if plain else F.lit(0)
    two = F.xxhash64(F.lit("second"), *plain)
    return [F.count(F.lit(1)).alias("n"), *[F.sum(h.cast("decimal(38,0)")).cast("string").alias(k) for k, h in (("a", one), ("b", two))]]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def measured_digest(df: DataFrame, found: Mapping[str, Any]) -> str:
    return hashlib.sha256(json.dumps([df.schema.json(), found["n"], found["a"], found["b"]]).encode()).hexdigest()


def table_digest(df: DataFrame) -> str:
    """Fingerprint of a table's schema and rows, whatever their order: one aggregation."""
    return measured_digest(df, df.agg(*measures(df)).first().asDict())


def written_digest(df: DataFrame, path: str) -> tuple[str, int]:
    """Write ``df`` as Parquet to ``path``; its fingerprint and rows, both taken while it is written."""
    seen = Observation()
    df.observe(seen, *measures(df)).write.mode("overwrite").parquet(path)
    found = seen.get
    return measured_digest(df, found), found["n"]


def canonical(value: Any, above: tuple[int, ...] = ()) -> Any:
    """A value that JSON writes in one way only.

    Mappings and sets are sorted; arrays of numpy stand with their type, shape and bytes; dataclasses and other objects with
    their class and their attributes, those in slots too. A value that holds itself is shown by how many levels up it is.
    Callables, tables and objects without attributes are refused: nothing tells what they hold.
    """
    if isinstance(value, DataFrame) or type(value).__module__.startswith("pandas"):
        raise TypeError("a table is no parameter; make it a dataset")
    if value is None or isinstance(value, (bool, int, float, str)) and not isinstance(value, Enum):
        return [type(value).__name__, repr(value) if isinstance(value, float) else value]
    if isinstance(value, (bytes, bytearray)):
        return [type(value).__name__, bytes(value).hex()]
    if isinstance(value, os.PathLike):
        return ["path", os.fspath(value)]
    if isinstance(value, (datetime, date, time, timedelta, Decimal, complex, range, UUID, np.generic, np.dtype)):
        return [type(value).__name__, repr(value)]
    if id(value) in above:
        return ["above", len(above) - above.index(id(value))]
    inside = (*above, id(value))
    if isinstance(value, np.ndarray):
        if value.dtype.hasobject:
            return ["array", list(value.shape), [canonical(x, inside) for x in value.ravel().tolist()]]
        return ["array", value.dtype.str, list(value.shape), hashlib.sha256(np.ascontiguousarray(value).tobytes()).hexdigest()]
    if isinstance(value, Mapping):
        return ["map", sorted(([canonical(k, inside), canonical(v, inside)] for k, v in value.items()), key=json.dumps)]
    if isinstance(value, (set, frozenset)):
        return ["set", sorted((canonical(x, inside) for x in value), key=json.dumps)]
    if isinstance(value, Enum):
        return [type(value).__qualname__, value.name, canonical(value.value, inside)]
    if isinstance(value, (list, tuple)):
        return ["list", [canonical(x, inside) for x in value]]
    if callable(value):
        raise TypeError("a function is no parameter; depend on it as a function")
    slots = [n for c in type(value).__mro__ for n in ([c.__slots__] if isinstance(getattr(c, "__slots__", ()), str) else getattr(c, "__slots__", ())) if n not in ("__dict__", "__weakref__")]
    if not slots and not hasattr(value, "__dict__"):
        raise TypeError(f"{type(value).__qualname__} has no attributes that tell what it holds")
    found = {n: getattr(value, n) for n in slots if hasattr(value, n)} | getattr(value, "__dict__", {})
    return [type(value).__name__, canonical(found, inside)]


def parameter_digest(value: Any) -> str:
    return hashlib.sha256(json.dumps(canonical(value), sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def normal_path(path: str | os.PathLike) -> str:
    """A path or address without . and .. and doubled slashes, told from its text alone: links aren't followed."""
    scheme, found, rest = os.fspath(path).rpartition("://")
    return f"{scheme}{found}{posixpath.normpath(rest)}" if rest else os.fspath(path)


def parts(job_id: str | Column) -> Column:
    """The outputs that a job id names."""
    return F.split(F.col(job_id) if isinstance(job_id, str) else job_id, SEPARATOR)


def short_id(job_id: str | Column) -> Column:
    """The first output, and how many more there are."""
    c = F.col(job_id) if isinstance(job_id, str) else job_id
    more = F.size(parts(c)) - 1
    return F.when(more > 0, F.concat(F.substring_index(c, SEPARATOR, 1), F.lit(" +"), more.cast("string"))).otherwise(c)


def input_key(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(job_id, input_key): SHA-256 over the sorted (name, hash) pairs of what a job consumes."""
    from brookloom.operators.history import packed, unpacked
    from brookloom.plans.tables import spread

    pairs = inputs.join(outputs.select(F.col("output_name").alias("input_name"), "hash").distinct(), "input_name").select("job_id", "input_name", packed("hash").alias("hash"))
    pairs = spread(pairs, "job_id").select("job_id", "input_name", unpacked("hash").alias("hash"))  # digests are shuffled as bytes
    lines = F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "input_name", "hash"))), "\n")
    return pairs.groupBy("job_id").agg(F.sha2(lines, 256).alias("input_key"))


def command_lines(command: Column) -> Column:
    """A shell command with each flag on a line of its own."""
    return F.regexp_replace(command, r" (-{1,2}[A-Za-z])", " \\\\\n  $1")

