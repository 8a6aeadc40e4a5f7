"""Where an index lives: versioned Parquet folders and JSON manifests, through
Spark's own file systems. A version is published by writing its manifest last, so
a reader sees whole versions only."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def folder(self, version: int, table: str) -> str:
        return f"{self.path}/v{version:08d}/{table}"

    def versions(self) -> list[int]:
        root = self._path(self.path)
        if not self.fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(root)]
        return sorted(int(n[9:17]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def read(self, version: int | None = None) -> dict:
        version = self.versions()[-1] if version is None else version
        stream = self.fs.open(self._path(f"{self.path}/manifest-{version:08d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def publish(self, manifest: dict) -> None:
        target = self._path(f"{self.path}/manifest-{manifest['version']:08d}.json")
        part = self._path(f"{self.path}/.manifest-{manifest['version']:08d}.part")
        stream = self.fs.create(part, True)
        stream.write(json.dumps(manifest, indent=1).encode())
        stream.close()
        if not self.fs.rename(part, target):
            raise FileExistsError(f"version {manifest['version']} was published by another writer")

    def drop(self, version: int | None = None, tables: list[str] | None = None) -> None:
        """Remove one version (of its tables only these, if given), or the whole index."""
        if version is None:
            self.fs.delete(self._path(self.path), True)
            return
        self.fs.delete(self._path(f"{self.path}/manifest-{version:08d}.json"), False)
        for folder in [f"v{version:08d}"] if tables is None else [f"v{version:08d}/{t}" for t in tables]:
            self.fs.delete(self._path(f"{self.path}/{folder}"), True)
