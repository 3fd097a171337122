"""Scratch tables in the shared folder the cluster names.

Cutting lineage here always means "write a table, read it back": the result
survives the loss of an executor, and both readers of it see the same rows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the folder set on the context.

    Only a local session without either gets a folder of its own.  A cluster
    must name a shared one, because a machine-local path would not be readable
    from the other executors.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="fundlens-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


_written: dict[str, list[str]] = {}


def _session(spark: SparkSession) -> str:
    return f"{spark.sparkContext.applicationId}/{spark._jsparkSession.sessionUUID()}"


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/fundlens-{label}-{uuid.uuid4().hex}"
    _written.setdefault(_session(spark), []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete this session's scratch tables and checkpoints; call it once results are stored."""
    paths = _written.pop(_session(spark), [])
    for path in paths:
        delete(spark, path)
    return len(paths)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as a parquet table in the scratch folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a scratch table that no DataFrame in use reads any more."""
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        delete(table.sparkSession, folder)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a path on whatever file system it is on."""
    where, system = _file_system(spark, path)
    if not system.exists(where):
        return []
    return [status.getPath().getName() for status in system.listStatus(where)]


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, such as a manifest."""
    where, system = _file_system(spark, path)
    stream = system.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small text file in place at once: readers see the old one, none, or all of the new one."""
    where, system = _file_system(spark, path)
    part, _ = _file_system(spark, f"{path.rsplit('/', 1)[0]}/_part-{uuid.uuid4().hex}")
    stream = system.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    system.delete(where, False)
    if not system.rename(part, where):
        raise OSError(f"cannot write {path}")


def delete(spark: SparkSession, path: str) -> None:
    where, system = _file_system(spark, path)
    system.delete(where, True)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())
