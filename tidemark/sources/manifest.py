"""Versioned manifests: the ordered run list, published by rename through the Hadoop file system.

A reader sees one version or the next, never a mixture; a merged run has a name
of its own, so nothing that a live version names is overwritten.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Manifest:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/_manifest"))

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/_manifest"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def load(self) -> dict:
        """The newest version; an empty one where there is none."""
        v = self.versions()
        if not v:
            return {"version": 0, "runs": [], "batches": [], "next_run": 0, "next_seq": 0}
        text = self.spark.read.text(f"{self.root}/_manifest/v{v[-1]}.json", wholetext=True).first()[0]
        return json.loads(text)

    def publish(self, state: dict) -> dict:
        """Write the next version; fails if another writer was first."""
        new = state | {"version": state["version"] + 1}
        tmp = self._path(f"{self.root}/_manifest/.tmp-{uuid.uuid4().hex}")
        out = self._fs.create(tmp, True)
        out.write(json.dumps(new).encode())
        out.close()
        if not self._fs.rename(tmp, self._path(f"{self.root}/_manifest/v{new['version']}.json")):
            self._fs.delete(tmp, False)
            raise RuntimeError(f"manifest version {new['version']} exists: one writer at a time")
        return new

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
