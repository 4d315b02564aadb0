"""Versioned folders: data is written first, then one commit file names it; a version is there or it is not.

A commit is a rename that refuses to replace, so of two runs that saw the same version one gets the next number and the
other is told. Data without a commit file (a run that stopped in between) is never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

COMMITS, DATA = "_commits", "data"


class VersionConflict(RuntimeError):
    """Another run has committed since the version this one started from."""


class Versions:
    """The versions of one folder, numbered from 1."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._java = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, *parts: str):
        return self._java.Path("/".join([self.path, *parts]))

    def latest(self) -> int:
        """The number of the last committed version; 0 if there is none."""
        folder = self._at(COMMITS)
        files = folder.getFileSystem(self._conf)
        if not files.exists(folder):
            return 0
        names = (s.getPath().getName() for s in files.listStatus(folder))
        return max((int(n) for n in names if n.isdigit()), default=0)

    def reserve(self) -> str:
        """A fresh name for the data of a version to come."""
        return uuid.uuid4().hex

    def data_path(self, name: str) -> str:
        return f"{self.path}/{DATA}/{name}"

    def open(self, version: int) -> str:
        """Where the data of a committed version is."""
        at = self._at(COMMITS, f"{version:020d}")
        stream = at.getFileSystem(self._conf).open(at)
        try:
            name = stream.readUTF()
        finally:
            stream.close()
        return self.data_path(name)

    def commit(self, name: str, after: int) -> int:
        """Make the data the version after `after`; VersionConflict if that is not the last one any more."""
        version = after + 1
        folder, draft, final = self._at(COMMITS), self._at(COMMITS, f".{name}"), self._at(COMMITS, f"{version:020d}")
        if self.latest() != after:
            raise VersionConflict(f"{self.path} is at version {self.latest()}, not {after}")
        files = folder.getFileSystem(self._conf)
        files.mkdirs(folder)
        stream = files.create(draft, True)
        stream.writeUTF(name)
        stream.close()
        context = self._java.FileContext.getFileContext(final.toUri(), self._conf)
        never = self.spark.sparkContext._gateway.new_array(getattr(self._java, "Options$Rename"), 0)
        try:
            context.rename(draft, final, never)
        except Exception as error:
            files.delete(draft, False)
            if "FileAlreadyExistsException" in str(error):
                raise VersionConflict(f"version {version} of {self.path} was committed by another run") from error
            raise
        return version
