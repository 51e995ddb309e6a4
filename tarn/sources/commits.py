"""Versions of a table that is several folders: one small file a version, switched by one rename."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has made the version first."""


class CommitLog:
    """Numbered states of a collection in ``path/_versions``: what is read is what the greatest number says.

    Data folders are written first and named by the state that ``commit`` makes visible, so a reader sees all of a change
    or nothing, and what a failed writer leaves is never read. The file system must rename a file at once and not onto one
    that is there, as HDFS does; on an object store without such renames only one writer may be at work.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        fs, where = self._at("_versions")
        if not fs.exists(where):
            return []
        return sorted(int(n[:-5]) for s in fs.listStatus(where) if (n := s.getPath().getName()).endswith(".json") and n[:-5].isdigit())

    def read(self, version: int) -> dict[str, Any]:
        fs, where = self._at(f"_versions/{version}.json")
        stream = fs.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> tuple[int, dict[str, Any] | None]:
        """Number and state of what is read now; (0, None) before the first commit."""
        found = self.versions()
        return (found[-1], self.read(found[-1])) if found else (0, None)

    def commit(self, before: int, state: dict[str, Any]) -> int:
        """Makes ``state`` the version after ``before``."""
        fs, draft = self._at(f"_versions/draft-{uuid.uuid4().hex}")
        _, where = self._at(f"_versions/{before + 1}.json")
        stream = fs.create(draft, True)
        stream.write(json.dumps(state).encode())
        stream.close()
        if fs.exists(where) or not fs.rename(draft, where):
            fs.delete(draft, False)
            raise Conflict(f"version {before + 1} of {self.path} is there already")
        return before + 1

    def remove(self, name: str) -> None:
        fs, where = self._at(name)
        fs.delete(where, True)

    def vacuum(self, used: set[str], prefix: str) -> list[str]:
        """Deletes folders with a prefix that are not ``used``, and all states but the current one. No writer may be at work."""
        fs, where = self._at("")
        gone = [n for s in fs.listStatus(where) if (n := s.getPath().getName()).startswith(prefix) and n not in used]
        for name in gone:
            self.remove(name)
        for version in self.versions()[:-1]:
            self.remove(f"_versions/{version}.json")
        return gone
