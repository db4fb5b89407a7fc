"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import NotFound


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Where the session names none, one is made only if all of Spark is a single process on this
    machine, and removed at its end. On a cluster executors wouldn't see each other's files there,
    so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        path = tempfile.mkdtemp(prefix="spanloom-")
        atexit.register(shutil.rmtree, path, True)
        path = f"file://{path}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/spanloom-{spark.sparkContext.applicationId}"
    if path not in _made:
        files, where = _at(spark, path)
        files.mkdirs(where)
        files.deleteOnExit(where)
        _made.add(path)
    return path


_made: set[str] = set()


def staged(df: DataFrame) -> DataFrame:
    """The same rows, read from a table in the shared folder: lineage ends there."""
    path = f"{own_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Removes all that this application has staged. Frames that read it can't be used any more."""
    path = own_dir(spark)
    files, where = _at(spark, path)
    files.delete(where, True)
    _made.discard(path)


def _at(spark: SparkSession, path: str):
    """(file system, path) of the JVM's file access, which knows every scheme."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as a file of its own."""
    files, where = _at(spark, path)
    out = files.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def extract_member(spark: SparkSession, archive: str, member: str, into: str) -> tuple[str, str]:
    """Writes a zip archive's member to a file, as a stream; gives the digests of the archive and the member."""
    jvm = spark.sparkContext._jvm
    copy = lambda source, target: jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, target, 1 << 16, False)
    digest = lambda: jvm.java.security.MessageDigest.getInstance("SHA-256")
    hexed = lambda d: bytes(x & 0xFF for x in d.digest()).hex()
    files, where = _at(spark, archive)
    whole = jvm.java.security.DigestInputStream(files.open(where), digest())
    entries = jvm.java.util.zip.ZipInputStream(whole)
    while (entry := entries.getNextEntry()) is not None and entry.getName() != member:
        pass
    if entry is None:
        raise NotFound(f"{member} isn't in {archive}")
    data = jvm.java.security.DigestInputStream(entries, digest())
    files, where = _at(spark, into)
    out = files.create(where, True)
    copy(data, out)
    out.close()
    copy(whole, jvm.java.io.OutputStream.nullOutputStream())  # the rest of the archive, for its digest
    entries.close()
    return hexed(whole.getMessageDigest()), hexed(data.getMessageDigest())
