"""Folders of immutable parts with a list of the parts that count: a small transactional table.

Parts are written under new names; a snapshot file then names the parts that make up the
next version. A version's file is created once and never replaced, so of two writers that start from one
version the second fails, and readers see a whole version or the one before. A write that fails
before its snapshot leaves parts that no version names; `vacuum` deletes them. All paths
are Hadoop paths, so any file system that Spark can write holds such a folder.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession


#: Temporary folders of local sessions without a shared one, by application.
_temporary: dict[str, str] = {}


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to be."""


def file_system(spark: SparkSession, path: str):
    """(file system, path) of a Hadoop path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where it is set; on a local master without it, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        application = spark.sparkContext.applicationId
        found = _temporary.setdefault(application, "") or "file://" + tempfile.mkdtemp(prefix="quillspan-")
        _temporary[application] = found
    return found.rstrip("/")


def children(spark: SparkSession, path: str) -> list:
    """Names, lengths and modification times of what is in a folder, by name; none if it is not there."""
    fs, target = file_system(spark, path)
    if not fs.exists(target):
        return []
    return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(target))


def delete(spark: SparkSession, path: str) -> None:
    fs, target = file_system(spark, path)
    fs.delete(target, True)


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        return [int(name[1:-5]) for name, _, _ in children(self.spark, f"{self.path}/_snapshots") if name.startswith("v") and name.endswith(".json")]

    def read(self, version: int | None = None) -> tuple[int, dict]:
        """(version, content) of the newest version, or of an older one; (0, {}) before the first."""
        known = self.versions()
        if not known:
            return 0, {}
        version = known[-1] if version is None else version
        fs, target = file_system(self.spark, self._file(version))
        stream = fs.open(target)
        try:
            content = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, json.loads(content)

    def commit(self, base: int, content: dict) -> int:
        """Make content version base + 1, unless another writer has done so."""
        fs, draft = file_system(self.spark, f"{self.path}/_snapshots/.draft-{uuid.uuid4().hex}")
        _, target = file_system(self.spark, self._file(base + 1))
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        finally:
            stream.close()
        jvm = self.spark.sparkContext._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(draft, target, options)  # without OVERWRITE: fails where the version is taken
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(target):
                raise Conflict(f"version {base + 1} of {self.path} is taken") from e
            raise
        return base + 1

    def vacuum(self, folder: str, prefix: str, kept: set[str]) -> int:
        """Delete the parts of a folder that are named prefix... and are not among those kept; how many went."""
        gone = [name for name, _, _ in children(self.spark, f"{self.path}/{folder}") if name.startswith(prefix) and name.removeprefix(prefix) not in kept]
        for name in gone:
            delete(self.spark, f"{self.path}/{folder}/{name}")
        return len(gone)

    def _file(self, version: int) -> str:
        return f"{self.path}/_snapshots/v{version:09d}.json"
