"""Helpers shared by the text-corpus operators: table access, scratch tables, word rules."""

from __future__ import annotations

import atexit
import ctypes
import functools
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts define it: a run without space, tab, LF, VT, FF, CR.
WORD_RE = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch while a table is written.
ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_temporary: dict[str, str] = {}  # by application: folders of local sessions without a shared one
_scratch: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer splits than cores (a file of one row group is one task) is dealt out to all cores."""
    found, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return found.repartition(cores) if found.rdd.getNumPartitions() < cores else found


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the cluster names one.

    Only a local session without that setting (tests) gets a temporary folder; elsewhere
    executors would not see it, so the setting is asked for.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        application = spark.sparkContext.applicationId
        found = _temporary.setdefault(application, "") or "file://" + tempfile.mkdtemp(prefix="quillspan-")
        _temporary[application] = found
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs no recomputation of what came
    before, and lets several later plans read one result.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    batch = spark.conf.get(_BATCH)
    if int(batch) > ROWS:  # Spark's own default is too much text at once for two workers beside a JVM
        spark.conf.set(_BATCH, str(ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, batch)
    _scratch.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a materialized table that nothing reads any more."""
    _delete(df.sparkSession, df.scratch_path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _sweep() -> None:
    for spark, path in _scratch:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone: the cluster's cleaner has the folder
            return


atexit.register(_sweep)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores more as it takes to be none of the table's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def word_count(text) -> F.Column:
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def unit_hash(*cols, seed: int) -> F.Column:
    """A uniform number inside (0, 1) that depends on the columns' values only."""
    return ((F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))).cast("double")


@functools.cache
def single_threaded_blas() -> None:
    """Hold numpy's BLAS to one thread: a task has one core, and small products lose by more."""
    if not os.path.exists("/proc/self/maps"):
        return
    with open("/proc/self/maps") as maps:
        paths = {line.split()[-1] for line in maps if "openblas" in line}
    for path in paths:
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                break


@functools.cache
def _libc():
    try:
        found = ctypes.CDLL("libc.so.6")
        found.malloc_trim  # noqa: B018
        return found
    except (OSError, AttributeError):
        return None


def trimmed(batches):
    """The batches of a Python task; at its end the worker gives freed memory back to the system, since it stays alive for other tasks."""
    yield from batches
    if _libc():
        _libc().malloc_trim(0)


def text_blocks(texts: list, most: int):
    """(first, last) index ranges of consecutive texts with about `most` characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
