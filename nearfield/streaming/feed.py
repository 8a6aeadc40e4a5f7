"""A stream of new rows into an index.

Micro-batches are appended to a delta table next to the index; queries read the
graph and the delta together, exactly for the delta. `merge` moves the batches
that are there into the graphs as a batch job; their names are in the manifest of
the version that has them, so a batch counts once, whenever it lands and wherever
a merge is broken off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearfield.operators import exact
from nearfield.operators.index import GraphIndex

DELTA = "row_id long, filter_val long, vec array<double>, batch long"


class Feed:
    def __init__(self, index: GraphIndex, path: str):
        self.index, self.path, self.spark = index, path.rstrip("/"), index.spark

    def start(self, stream: DataFrame, checkpoint: str, id: str = "id", vec: str = "embedding", filter: str = "bucket", **trigger) -> StreamingQuery:
        """stream: a streaming DataFrame. A batch that is run again replaces its
        own folder, so each row arrives once."""

        def append(batch: DataFrame, number: int) -> None:
            rows = batch.where(F.col(vec).isNotNull()).select(F.col(id).cast("long").alias("row_id"), F.col(filter).cast("long").alias("filter_val"), F.col(vec).cast("array<double>").alias("vec"))
            rows.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

        return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def _batches(self) -> list[int]:
        """Finished batches that no version of the index has."""
        root = self.index.store._path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("batch=")]
        done = {p.getName()[6:] for p in names if fs.exists(self.index.store._path(p, "_SUCCESS"))}
        return sorted(set(map(int, done)) - set(self._merged()))

    def _merged(self) -> list[int]:
        return GraphIndex(self.spark, self.index.store.path).manifest.get("feeds", {}).get(self.path, [])

    @property
    def delta(self) -> DataFrame:
        return self._read(self._batches())

    def _read(self, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], DELTA)
        return self.spark.read.schema(DELTA).option("basePath", self.path).parquet(*(f"{self.path}/batch={b}" for b in batches))

    def search(self, q, k: int = 10, where: Column | None = None, keys: list[tuple[str, int]] | None = None, **options) -> DataFrame:
        near = self.index.search(q, k, where, keys=keys, **options)
        new = exact.knn(self.delta.where(self.index._filter(where, keys)), q, k, metric=self.index.options.metric, id="row_id", vec="vec")
        return near.unionByName(new).orderBy("d", "row_id").limit(k)

    def merge(self) -> GraphIndex:
        """Insert the batches that have landed, by name, then delete them."""
        batches, merged = self._batches(), self._merged()
        if batches:
            index = GraphIndex(self.spark, self.index.store.path)
            feeds = {**index.manifest.get("feeds", {}), self.path: sorted({*merged, *batches})}
            self.index = index.insert(self._read(batches), "row_id", "vec", "filter_val", feeds=feeds)
        for b in {*merged, *batches}:  # of merges that were broken off, too
            p = self.index.store._path(f"{self.path}/batch={b}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        return self.index
