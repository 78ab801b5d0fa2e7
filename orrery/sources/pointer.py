"""A small file that names the folders of a stored table, replaced in one step."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Pointer:
    """`CURRENT` in a folder: what it holds is seen whole or not at all, so a write that fails before `replace` changes nothing.

    Folders have names of their own, none is ever written twice. One writer at a time; any number of readers.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop, self._conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        self._fs = self.path("").getFileSystem(self._conf)

    def path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    def read(self) -> dict | None:
        where = self.path("CURRENT")
        if not self._fs.exists(where):
            return None
        source = self._fs.open(where)
        try:
            return json.loads(bytes(source.readAllBytes()))
        finally:
            source.close()

    def replace(self, content: dict) -> None:
        draft, current = self.path(f"CURRENT.{uuid.uuid4().hex}"), self.path("CURRENT")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 1)
        options[0] = getattr(self._hadoop, "Options$Rename").OVERWRITE
        self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._fs.makeQualified(draft), self._fs.makeQualified(current), options)

    def names(self) -> list[str]:
        """What lies in the folder."""
        return self.names_in("") if self._fs.exists(self.path("")) else []

    def names_in(self, name: str) -> list[str]:
        """What lies in one of its folders, without Spark's and hidden markers."""
        found = (s.getPath().getName() for s in self._fs.listStatus(self.path(name)))
        return sorted(n for n in found if not n.startswith(".") and n != "_SUCCESS")

    def delete(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self.path(name), True)
