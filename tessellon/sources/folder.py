"""Small files that processes agree through: written whole, once, on whatever file system holds them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Folder:
    """JSON records by name. put_once relies on a rename that fails where the name is taken, as HDFS gives it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._make(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._make(f"{self.root}/{name}" if name else self.root)

    def names(self) -> list[str]:
        """Names of the records that are there, in order; those being written don't count."""
        if not self._fs.exists(self._at("")):
            return []
        found = (x.getPath().getName() for x in self._fs.listStatus(self._at("")))
        return sorted(n for n in found if not n.startswith((".", "_")))

    def _write(self, at, record: dict) -> None:
        out = self._fs.create(at, True)
        out.write((json.dumps(record) + "\n").encode())
        out.close()

    def put_once(self, name: str, record: dict) -> None:
        """Write a record under a name that nobody has used; FileExistsError otherwise. A crash leaves nothing that counts."""
        made = self._at(f".{name}-{uuid.uuid4().hex}")
        self._write(made, record)
        if self._fs.exists(self._at(name)) or not self._fs.rename(made, self._at(name)):
            self._fs.delete(made, False)
            raise FileExistsError(f"{self.root}/{name}")

    def put(self, name: str, record: dict) -> None:
        """Write or replace a record."""
        self._write(self._at(name), record)

    def get(self, name: str) -> dict:
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
