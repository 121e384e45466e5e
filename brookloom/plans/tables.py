"""Tables that outlive a plan: written to the folder that all executors share, read back, dropped when done with."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Rows of a bucket of a ``dealt`` table, about.
BUCKET = 2_000_000
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a local one only where none is set, as in tests."""
    found = spark.conf.get(CHECKPOINT_DIR, None)
    if not found:
        app = spark.sparkContext.applicationId
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        if app not in _own_dirs:
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="brookloom-")
        found = _own_dirs[app]
    return found.rstrip("/")


def path_of(spark: SparkSession, path: str):  # noqa: ANN201
    """(file system, path) of Hadoop, for any store that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = path_of(spark, path)
    return system.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    system, where = path_of(spark, path)
    system.delete(where, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Move ``old`` to ``new``; what was at ``new`` is kept as ``new``.old until that is done, and ``recovered`` puts it back."""
    system, a = path_of(spark, old)
    _, b = path_of(spark, new)
    _, aside = path_of(spark, f"{new}.old")
    if system.exists(b):
        system.delete(aside, True)
        if not system.rename(b, aside):
            raise OSError(f"cannot move {new} aside")
    if not system.rename(a, b):
        raise OSError(f"cannot move {old} to {new}")
    system.delete(aside, True)


def recovered(spark: SparkSession, path: str) -> None:
    """Put back what a ``rename`` that was stopped had set aside."""
    if not exists(spark, path) and exists(spark, f"{path}.old"):
        rename(spark, f"{path}.old", path)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if it isn't there."""
    system, where = path_of(spark, path)
    return [f.getPath().getName() for f in system.listStatus(where)] if system.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    system, where = path_of(spark, path)
    stream = system.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    system, where = path_of(spark, path)
    stream = system.create(where, overwrite)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def claimed(spark: SparkSession, path: str, text: str) -> bool:
    """Put a file where none is, whole at once; False where one is there. One of any number of callers gets True.

    A local file is linked to its place and one of HDFS is renamed to it, which both refuse a place that is taken. An object
    store makes a file when its stream is closed, and refuses one that is there by then (``create`` without overwriting:
    a conditional put).
    """
    system, where = path_of(spark, path)
    system.mkdirs(where.getParent())
    scheme = system.getUri().getScheme()
    if scheme not in ("file", "hdfs", "viewfs", "webhdfs"):
        try:
            write_text(spark, path, text)
        except Py4JJavaError as e:
            if system.exists(where):
                return False
            raise e
        return True
    beside = f"{path}.{uuid.uuid4().hex}"
    write_text(spark, beside, text)
    try:
        if scheme == "file":
            local = [p.toUri().getPath() for p in (path_of(spark, beside)[1], where)]
            try:
                os.link(*local)
            except FileExistsError:
                return False
            return True
        return bool(system.rename(path_of(spark, beside)[1], where))
    finally:
        system.delete(path_of(spark, beside)[1], False)


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of plain values as a table, by way of Arrow."""
    kind = StructType.fromDDL(schema)
    if not rows:
        return spark.createDataFrame([], kind)
    columns = zip(*rows, strict=True)
    return spark.createDataFrame(pa.table({f.name: pa.array(c, to_arrow_type(f.dataType)) for f, c in zip(kind.fields, columns, strict=True)}), kind)


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The session's settings as wanted, for what is run inside."""
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a stored table: its plan is cut, and no executor's loss makes it be computed again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brookloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def tasks(spark: SparkSession) -> int:
    """As many tasks as shuffles have, 4 a core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as shuffles have, 4 a core at least; Spark doesn't merge them into few large ones."""
    return df.repartition(tasks(df.sparkSession), *keys)


def dealt(df: DataFrame, name: str, key: str, rows: int) -> DataFrame:
    """The distinct rows of ``df``, about ``rows`` of them, as a stored table whose rows lie by ``key``, in buckets.

    Joins and aggregations by ``key`` don't shuffle it, and those by more columns needn't (see ``by_first_key``). The catalog
    names the table until it is dropped.
    """
    spark = df.sparkSession
    n = max(tasks(spark), -(-rows // BUCKET))
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/brookloom/{table}"
    with settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": "2"}):  # a task's rows are one bucket: nothing to sort
        df.repartition(n, key).distinct().write.bucketBy(n, key).format("parquet").option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._written_at, out._table, out._rows, out._buckets = path, table, rows, n
    return out


def by_first_key(spark: SparkSession):  # noqa: ANN201
    """Settings under which rows that lie by one key of a join aren't shuffled by all of them."""
    return settings(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false"})


def stored(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """Columns of ``df`` as a stored table: where ``written`` gave it, that one."""
    return df.select(*columns) if "_written_at" in df.__dict__ else written(df.select(*columns), name)


def dropped(*frames: DataFrame) -> None:
    for df in frames:
        if table := df.__dict__.get("_table"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        if path := df.__dict__.get("_written_at"):
            delete(df.sparkSession, path)
