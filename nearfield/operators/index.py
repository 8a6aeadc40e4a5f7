"""The graph index over DataFrames: build, search, insert, delete, vacuum.

Rows are dealt out to shards by a hash of their id; a task builds or searches the
graph of one shard, bounded by IndexOptions.shard_rows, and shards need nothing
from each other. A shard is stored as one row: ids, filter values and marks as
arrays, which Spark filters, and vectors, links and codes as bytes, which a task
reads in place. So a search is a scan, a filter and a map: nothing of the index
is shuffled, and shards whose filter values can't pass aren't read. Deletions are
a table of ids beside the shards until the next insert, or until they are many.
Every change publishes a new version; a reader keeps its own.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from nearfield.functions import metrics
from nearfield.operators import cache, exact, telemetry
from nearfield.operators.graph import COUNTERS, PackedGraph, ShardGraph, pack, packed_codes
from nearfield.plans import stats
from nearfield.plans.options import IndexOptions, SearchOptions
from nearfield.sources.store import Store

QUERY_BATCH = 10_000
HELD_ROWS = 2_000_000  # results that a task holds
SMALL_ROWS = 1_000_000  # ids (of deletions, or of rows that pass) that are sent to every executor
SHARDS = "shard int, n int, dim int, entry int, lo long, hi long, row_id array<long>, filter_val array<long>, deleted array<boolean>, vec binary, level binary, links binary, extra binary, codes binary"
BLOBS = ["n", "dim", "entry", "vec", "level", "links", "extra", "codes"]


ROW = pa.schema([
    *((c, pa.int32()) for c in ("shard", "n", "dim", "entry")), *((c, pa.int64()) for c in ("lo", "hi")), ("row_id", pa.list_(pa.int64())), ("filter_val", pa.list_(pa.int64())),
    ("deleted", pa.list_(pa.bool_())), *((c, pa.binary()) for c in ("vec", "level", "links", "extra", "codes")),
])


def _pack(g: ShardGraph, shard: int) -> pa.Table:
    return pa.Table.from_pylist([{"shard": shard, **pack(g)}] if g._n else [], ROW)


def _open(old: pa.Table, o: IndexOptions, seed: int, gone: set[int]) -> ShardGraph:
    row = old.to_pylist()[0]
    g = PackedGraph(o, row).open(seed, row["filter_val"])
    g.deleted = [d or i in gone for d, i in zip(g.deleted, g.ids, strict=True)]
    return g


def _add(g: ShardGraph, rows: pa.Table, gated: set[int]) -> None:
    """Rows (row_id, filter_val, vec), in the order of their ids."""
    rows = rows.sort_by("row_id").combine_chunks()
    if rows.num_rows:
        vectors = rows.column("vec").combine_chunks()
        flat = (vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors).flatten().to_numpy(zero_copy_only=False)
        g.add(rows.column("row_id").to_pylist(), rows.column("filter_val").to_pylist(), list(flat.reshape(rows.num_rows, -1)), gated)


def _shards(batches, wanted: tuple[str, ...] = ()):
    """Batches of rows (shard, pos, row_id, deleted, passes, wanted columns, and
    a shard's bytes on its first row) -> (shard, row, passes) of whole shards."""
    row, parts = None, []

    def whole():
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        row["row_id"], row["deleted"] = columns[0], columns[1]
        return row["shard"], row | dict(zip(wanted, columns[3:], strict=True)), columns[2]

    for batch in batches:
        pos = batch.column("pos").to_numpy()
        cuts = [*np.flatnonzero(pos == 0).tolist(), len(pos)]
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("row_id", "deleted", "passes")] + [np.array(batch.column(c).to_pylist(), object) for c in wanted]
        if cuts[0]:
            parts.append([c[: cuts[0]] for c in columns])
        for at, to in zip(cuts, cuts[1:], strict=False):
            if row is not None:
                yield whole()
            row, parts = {c: batch.column(c)[at].as_py() for c in ("shard", *BLOBS)}, [[c[at:to] for c in columns]]
    if row is not None:
        yield whole()


def _best(qid: np.ndarray, row_id: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each query."""
    order = np.lexsort((row_id, d, qid))
    own = qid[order]
    order = order[np.arange(len(own)) - np.searchsorted(own, own) < k]
    return qid[order], row_id[order], d[order]


class Best:
    """The k nearest rows (None: all) of each of n queries, of parts that come
    one after the other. What is farther than k rows of its query doesn't stay."""

    def __init__(self, n: int, k: int | None):
        self.k, self.held, self.size, self.bound = k, [], 0, np.full(n, np.inf)
        self.most = HELD_ROWS if k is None else min(HELD_ROWS, 2 * k * n)

    def add(self, own: np.ndarray, row_id: np.ndarray, d: np.ndarray) -> int:
        """How many rows are held now."""
        near = ~(d > self.bound[own])
        self.held.append((own[near], row_id[near], d[near]))
        self.size += len(self.held[-1][0])
        if self.k is not None and self.size > self.most:
            own, _, d = self.rows()
            last = np.flatnonzero(np.arange(self.size) - np.searchsorted(own, own) == self.k - 1)
            self.bound[own[last]] = d[last]
        return self.size

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.held) > 1:
            parts = tuple(map(np.concatenate, zip(*self.held, strict=True)))
            self.held = [parts if self.k is None else _best(*parts, self.k)]
            self.size = len(self.held[0][0])
        return self.held[0] if self.held else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows, which are held no longer."""
        out, self.held, self.size = self.rows(), [], 0
        return out


def _found_rows(names: np.ndarray, own: np.ndarray, row_id: np.ndarray, d: np.ndarray):
    for at in range(0, len(own), 100_000):
        some = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(names[own[some]]), pa.array(row_id[some]), pa.array(d[some])], names=["qid", "row_id", "d"])


def _seed(o: IndexOptions, shard: int, more: int = 0) -> int:
    return (max(o.build_seed, 0) + 7919 * shard + 104729 * more) % 2**32


class GraphIndex:
    """An index at a path, at one version."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.store = spark, Store(spark, path)
        self.manifest = self.store.read(version)
        self.options = IndexOptions(**self.manifest["options"])

    @property
    def version(self) -> int:
        return self.manifest["version"]

    @property
    def name(self) -> str:
        return self.store.path

    @property
    def stats(self) -> stats.FilterStats:
        return stats.FilterStats(**self.manifest["stats"])

    @property
    def shards(self) -> DataFrame:
        """One row per shard, as stored."""
        return self.spark.read.schema(SHARDS).parquet(self.store.folder(self.manifest["nodes"], "nodes"))

    @property
    def coded(self) -> DataFrame:
        """The shards with codes, computed where none are stored (the cache keeps them)."""
        if self.options.inline_codes:
            return self.shards
        o, at = self.options, ROW.get_field_index("codes")

        def encode(batches):
            for batch in batches:
                codes = [packed_codes(PackedGraph(o, row)) if row["n"] else b"" for row in batch.to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(codes, pa.binary())], names=batch.schema.names)

        return self.shards.mapInArrow(encode, SHARDS)

    @property
    def gone(self) -> DataFrame | None:
        """(row_id) of deletions that aren't in the shards yet."""
        return None if self.manifest["gone"] is None else self.spark.read.schema("row_id long").parquet(self.store.folder(self.manifest["gone"], "gone"))

    @property
    def nodes(self) -> DataFrame:
        """One row per node: shard, node, row_id, filter_val, deleted, vec."""
        o = self.options

        def decode(batches):
            for shard, row, _ in _shards(batches, ("filter_val",)):
                vec = PackedGraph(o, row).vec
                for at in range(0, row["n"], 1000):
                    to = min(at + 1000, row["n"])
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array(np.full(to - at, shard, np.int32)), "node": pa.array(np.arange(at, to, dtype=np.int32)), "row_id": pa.array(row["row_id"][at:to], pa.int64()),
                        "filter_val": pa.array(row["filter_val"][at:to].tolist(), pa.int64()), "deleted": pa.array(row["deleted"][at:to], pa.bool_()), "vec": pa.array(list(vec[at:to].astype(np.float64)), pa.list_(pa.float64())),
                    })

        return self._stream(self.shards, F.lit(True), None).mapInArrow(decode, "shard int, node int, row_id long, filter_val long, deleted boolean, vec array<double>")

    def _stream(self, shards: DataFrame, passes: Column, passing: DataFrame | None) -> DataFrame:
        """Shards as streams of their rows, in place and in order, with `passes`;
        the bytes of a shard are on its first row only. No row changes its task
        as long as `passing` and the deletions are of bounded size."""
        first = lambda c: F.when(F.col("pos") == 0, F.col(c)).alias(c)
        d = shards.select("shard", *BLOBS, F.posexplode(F.arrays_zip("row_id", "filter_val", "deleted")).alias("pos", "_r"))
        d = d.select("shard", "pos", F.col("_r.row_id").alias("row_id"), F.col("_r.filter_val").alias("filter_val"), F.col("_r.deleted").alias("deleted"), *map(first, BLOBS))
        moved = False
        for ids, mark in ((self.gone, "_gone"), (passing, "_ok")):
            if ids is not None:
                small = ids.count() <= SMALL_ROWS
                moved |= not small
                ids = ids.withColumn(mark, F.lit(True))
                d = d.join(F.broadcast(ids) if small else ids, "row_id", "left")
        if self.gone is not None:
            d = d.withColumn("deleted", F.col("deleted") | F.coalesce("_gone", F.lit(False))).drop("_gone")
        ok = passes if passing is None else passes & F.coalesce("_ok", F.lit(False))
        d = d.select("shard", "pos", "row_id", "filter_val", "deleted", (ok & ~F.col("deleted")).alias("passes"), *BLOBS)
        return d.repartition("shard").sortWithinPartitions("shard", "pos") if moved else d

    # -- build ------------------------------------------------------------------------------------------------------
    @classmethod
    def build(cls, df: DataFrame, path: str, options: IndexOptions | None = None, id: str = "id", vec: str = "embedding", filter: str | None = "bucket", **extra) -> GraphIndex:
        """Index all rows of df with a vector; rows of null vectors are left
        out, as are zero vectors under cosine. An empty df gives an empty index.
        extra: entries of the manifest."""
        spark, o = df.sparkSession, options or IndexOptions(gamma=SearchOptions.of(df.sparkSession).default_gamma)
        rows = _rows(df, id, vec, filter, o)
        n, dims, dim = rows.agg(F.count("*"), F.countDistinct(F.size("vec")), F.max(F.size("vec"))).first()
        if dims > 1:
            raise ValueError("vectors of different dimensions can't share an index")
        shards = max(1, -(-n // o.shard_rows))
        if o.build_mb and n and (need := n * o.bytes_per_row(dim)) > shards * (o.build_mb << 20):
            shards = int(-(-need // (o.build_mb << 20)))
            warnings.warn(f"graphs of {o.shard_rows} rows don't fit into build_mb = {o.build_mb}: {shards} shards are built", stacklevel=2)
        gated = [r.part for r in stats.partition_counts(rows, "filter_val").where(F.col("n") < o.payload_min_cardinality).collect()] if o.payload_min_cardinality else []

        def build_shard(key: tuple, rows: pa.Table) -> pa.Table:
            shard = key[0].as_py()
            g = ShardGraph(o, dim, _seed(o, shard))
            _add(g, rows, set(gated))
            return _pack(g, shard)

        store = Store(spark, path)
        version = max(store.versions(), default=0) + 1
        sharded = rows.withColumn("shard", F.pmod(F.xxhash64("row_id"), F.lit(shards)).cast("int"))
        sharded.groupBy("shard").applyInArrow(build_shard, SHARDS).write.mode("overwrite").parquet(store.folder(version, "nodes"))
        fs = stats.FilterStats.of(rows, "filter_val")
        store.publish({"version": version, "nodes": version, "gone": None, "options": o.as_dict(), "dim": dim, "shards": shards, "rows": n, "deleted": 0, "gated": gated, "stats": {"rows": fs.rows, "distinct": fs.distinct, "bounds": fs.bounds}, **extra})
        return cls(spark, path, version)

    # -- search -----------------------------------------------------------------------------------------------------
    def search(self, q, k: int | None = 10, where: Column | None = None, passing: DataFrame | None = None, keys: list[tuple[str, int]] | None = None, on_short: str = "return", **options) -> DataFrame:
        """The nearest rows of a vector q: row_id, d. where: over filter_val and
        row_id; passing: a table (id) of rows that pass, for predicates on other
        columns; keys: (operator, constant) on filter_val. on_short='exact':
        answer exactly where the graph finds fewer than k."""
        if q is None:
            return self.spark.createDataFrame([], "row_id long, d double")
        found = self._found(np.zeros(1, np.int64), np.array([q], np.float64), k, where, passing, keys, **options).select("row_id", "d").orderBy("d", "row_id")
        found = found if k is None else found.limit(k)
        if k is not None and on_short == "exact":
            found = found.cache()
            if found.count() < k:
                return self.exact(q, k, where, passing, keys)
        return found

    def view(self, name: str, q, k: int | None = 10, **search) -> None:
        """The search as a temporary view (row_id, d), to be joined in SQL."""
        self.search(q, k, **search).createOrReplaceTempView(name)

    def reachability(self) -> DataFrame:
        """(shard, nodes, unreached, lost): nodes that layer 0 doesn't reach from
        the entry, and sampled nodes that a search for their own vector misses."""
        o = self.options

        def probe(batches):
            for shard, row, _ in _shards(batches):
                g = PackedGraph(o, row)
                passes, ids = np.ones(g._n, bool), g.ids.tolist()
                some = range(0, g._n, max(1, g._n // 50))
                lost = sum(ids[i] not in {r for _, r in g.search(g.vec[i], passes, max(100, o.ef_construction), 10)[0]} for i in some if not g.deleted[i])
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "nodes": [g._n], "unreached": [g.unreached()], "lost": [lost]})

        return self._stream(self.shards, F.lit(True), None).mapInArrow(probe, "shard int, nodes long, unreached long, lost long")

    def _filter(self, where: Column | None, keys: list[tuple[str, int]] | None) -> Column:
        from nearfield.functions.predicates import conjunction

        passes = F.lit(True) if where is None else where
        return F.coalesce(passes & conjunction([("filter_val", op, c) for op, c in keys or []]), F.lit(False))

    def exact(self, q, k: int | None = 10, where: Column | None = None, passing: DataFrame | None = None, keys: list[tuple[str, int]] | None = None) -> DataFrame:
        live = self.nodes.where(~F.col("deleted") & self._filter(where, keys))
        if passing is not None:
            live = live.join(passing.select(F.col("id").alias("row_id")).distinct(), "row_id", "left_semi")
        return exact.knn(live, q, k, metric=self.options.metric, id="row_id", vec="vec")

    def search_batch(self, queries: DataFrame, k: int | None = 10, where: Column | None = None, passing: DataFrame | None = None, keys: list[tuple[str, int]] | None = None, **options) -> DataFrame:
        """qid, row_id, d, rank for each row (qid, q) of queries. Every shard gets
        up to QUERY_BATCH of them at a time; more go in several rounds."""
        rounds = -(-queries.count() // QUERY_BATCH)
        if rounds > 1:
            # Twice the rounds keep each, dealt out by hash, below the limit.
            dealt = queries.withColumn("_round", F.pmod(F.xxhash64("qid"), F.lit(2 * rounds)))
            parts = [self._search_some(dealt.where(F.col("_round") == i).drop("_round"), k, where, passing, keys, **options) for i in range(2 * rounds)]
            out = parts[0]
            for part in parts[1:]:
                out = out.unionByName(part)
            return out
        return self._search_some(queries, k, where, passing, keys, **options)

    def _search_some(self, queries: DataFrame, k: int | None, where: Column | None, passing: DataFrame | None, keys: list[tuple[str, int]] | None, **options) -> DataFrame:
        asked = queries.where("q IS NOT NULL").select(F.col("qid").cast("long").alias("qid"), F.col("q").cast("array<double>").alias("q")).toArrow()
        for size in pc.unique(pc.list_value_length(asked.column("q"))).to_pylist():
            self._same_dim(size)
        vectors = exact.matrix(asked.column("q"), self.manifest["dim"])[1] if asked.num_rows and self.manifest["dim"] is not None else np.empty((0, 0))
        best = Window.partitionBy("qid").orderBy("d", "row_id")
        ranked = self._found(asked.column("qid").to_numpy(), vectors, k, where, passing, keys, **options).select("qid", "row_id", "d", F.row_number().over(best).alias("rank"))
        return ranked if k is None else ranked.where(F.col("rank") <= k)

    def _same_dim(self, dim: int) -> None:
        if self.manifest["dim"] is not None and dim != self.manifest["dim"]:
            raise ValueError(f"different vector dimensions {self.manifest['dim']} and {dim}")

    def _found(self, qids: np.ndarray, vectors: np.ndarray, k: int | None, where: Column | None, passing: DataFrame | None, keys: list[tuple[str, int]] | None, **options) -> DataFrame:
        """qid, row_id, d: up to k rows of every shard for each query (a row of vectors)."""
        s = SearchOptions.of(self.spark, **options)
        if self.manifest["dim"] is None:
            return self.spark.createDataFrame([], "qid long, row_id long, d double")
        ef = stats.budget(s.ef_search, s.target_recall, self.stats, keys or [])
        o, codes = self.options, s.use_codes or self.options.inline_codes
        if len(qids):
            self._same_dim(vectors.shape[1])
        shards = cache.shards(self, s) if s.use_cache and s.cache_mb else self.shards
        for op, c in keys or []:  # shards in which no row can pass
            shards = shards.where({"<": F.col("lo") < c, "<=": F.col("lo") <= c, "=": (F.col("lo") <= c) & (F.col("hi") >= c), ">=": F.col("hi") >= c, ">": F.col("hi") > c}[op])
        if passing is not None:
            passing = passing.select(F.col("id").alias("row_id")).distinct()
        shared, counters = self.spark.sparkContext.broadcast((qids, vectors)), telemetry.counters(self.spark)

        def search_shards(batches):
            qids, vectors = shared.value
            names, own = np.unique(qids, return_inverse=True)
            best = Best(len(names), k)
            for _, row, passes in _shards(batches):
                g, passes = PackedGraph(o, row), passes.astype(bool)
                if len(qids) == 1:
                    found, count = g.search(vectors[0], passes, ef, k, s.member_first, s.buffered_emission, codes)
                    size = best.add(np.repeat(own, len(found)), np.array([i for _, i in found], np.int64), np.array([d for d, _ in found], np.float64))
                else:
                    at, places, far, count = g.search_flat(vectors, passes, ef, k, s.member_first, s.buffered_emission, codes)
                    size = best.add(own[at], np.asarray(g.ids, np.int64)[places], far)
                for c in COUNTERS:
                    counters[c].add(count[c])
                if size > HELD_ROWS:
                    yield from _found_rows(names, *best.take())
            yield from _found_rows(names, *best.take())

        return self._stream(shards, self._filter(where, keys), passing).mapInArrow(search_shards, "qid long, row_id long, d double")

    def knn(self, base: DataFrame, q, k: int = 10, keys: list[tuple[str, int]] | None = None, id: str = "id", **options) -> DataFrame:
        """By whichever path costs less, with all columns of base joined last."""
        s = SearchOptions.of(self.spark, **options)
        sel = self.stats.selectivity(keys) if keys else None
        path = stats.choose_path(self.manifest["rows"], sel, True, s.enable_index)
        found = self.search(q, k, keys=keys, **options) if path == "index" else self.exact(q, k, keys=keys)
        return base.join(F.broadcast(found), base[id] == found["row_id"]).drop("row_id").orderBy("d", id)

    # -- changes ----------------------------------------------------------------------------------------------------
    def _publish(self, table: str, content: DataFrame, **changes) -> GraphIndex:
        """A version whose `table` (nodes or gone) has this content."""
        version = max(self.store.versions()) + 1
        content.write.mode("overwrite").parquet(self.store.folder(version, table))
        changes = {k: v() if callable(v) else v for k, v in changes.items()}
        self.store.publish({**self.manifest, "version": version, table: version, **changes})
        return GraphIndex(self.spark, self.store.path, version)

    def insert(self, df: DataFrame, id: str = "id", vec: str = "embedding", filter: str | None = "bucket", **extra) -> GraphIndex:
        """A version with the rows of df in the graphs of their shards. extra:
        entries of the manifest that change with it."""
        o, dim = self.options, self.manifest["dim"]
        extra = {k: self.manifest[k] for k in ("feeds",) if k in self.manifest} | extra
        if dim is None:
            return GraphIndex.build(df, self.store.path, o, id, vec, filter, **extra)
        rows = _rows(df, id, vec, filter, o)
        n, least, most = rows.agg(F.count("*"), F.min(F.size("vec")), F.max(F.size("vec"))).first()
        if n and (least != dim or most != dim):
            raise ValueError(f"different vector dimensions {dim} and {most if most != dim else least}")
        if self.manifest["rows"] + n > 2 * self.manifest["shards"] * o.shard_rows:  # shards would outgrow their bound: deal out anew
            return GraphIndex.build(self._live().unionByName(rows.select(F.col("row_id").alias("id"), F.col("vec").alias("embedding"), F.col("filter_val").alias("bucket"))), self.store.path, o, **extra)
        return self._rewrite(rows, rows=self.manifest["rows"] + n, **extra)

    def _rewrite(self, new_rows: DataFrame | None, **changes) -> GraphIndex:
        """Shards with the deletions so far marked, and then new rows (row_id,
        filter_val, vec) added."""
        o, dim, gated, version = self.options, self.manifest["dim"], set(self.manifest["gated"]), self.version
        own = F.pmod(F.xxhash64("row_id"), F.lit(self.manifest["shards"])).cast("int").alias("shard")
        parts = [] if new_rows is None else [new_rows.select(own, "row_id", "filter_val", "vec", F.lit(False).alias("gone"))]
        if self.gone is not None:
            parts.append(self.gone.select(own, "row_id", F.lit(None).cast("long").alias("filter_val"), F.lit(None).cast("array<double>").alias("vec"), F.lit(True).alias("gone")))
        new = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

        def merge(key: tuple, old: pa.Table, more: pa.Table) -> pa.Table:
            shard = key[0].as_py()
            seed, flag = _seed(o, shard, version), more.column("gone")
            gone = set(more.filter(flag).column("row_id").to_pylist())
            g = _open(old, o, seed, gone) if old.num_rows else ShardGraph(o, dim, seed)
            _add(g, more.filter(pc.invert(flag)), gated)
            return _pack(g, shard)

        merged = self.shards.groupBy("shard").cogroup(new.groupBy("shard")).applyInArrow(merge, SHARDS)
        return self._publish("nodes", merged, gone=None, **changes)

    def delete(self, ids: DataFrame, id: str = "id") -> GraphIndex:
        """A version in which these rows are no results; they stay as bridges.
        Only their ids are written, until they are more than SMALL_ROWS.
        `manifest['deleted']` counts the dead nodes."""
        if self.manifest["dim"] is None:
            return self
        asked = ids.select(F.col(id).cast("long").alias("row_id")).distinct()
        live = self._stream(self.shards, F.lit(True), None).where("NOT deleted").select("row_id")
        hit = live.join(asked, "row_id", "left_semi").cache()
        gone = hit.distinct() if self.gone is None else hit.unionAll(self.gone).distinct()
        out = self._publish("gone", gone, deleted=lambda: self.manifest["deleted"] + hit.count())
        hit.unpersist()
        return out._rewrite(None) if out.gone.count() > SMALL_ROWS else out

    def update(self, df: DataFrame, id: str = "id", vec: str = "embedding", filter: str | None = "bucket") -> GraphIndex:
        return self.delete(df, id).insert(df, id, vec, filter)

    def _live(self) -> DataFrame:
        return self.nodes.where("NOT deleted").select(F.col("row_id").alias("id"), F.col("vec").alias("embedding"), F.col("filter_val").alias("bucket"))

    def compact(self) -> GraphIndex:
        """Build anew without the deleted nodes."""
        return GraphIndex.build(self._live(), self.store.path, self.options, **{k: self.manifest[k] for k in ("feeds",) if k in self.manifest})

    def drop(self) -> None:
        cache.invalidate(self.name)
        self.store.drop()

    def vacuum(self, keep: int = 1) -> dict:
        """Remove all versions but the last `keep`; (versions removed, nodes, dead)."""
        old, kept = self.store.versions()[:-keep], self.store.versions()[-keep:]
        used = {(m[t], t) for m in map(self.store.read, kept) for t in ("nodes", "gone") if m[t] is not None}
        for v in old:
            self.store.drop(v, [t for t in ("nodes", "gone") if (v, t) not in used])
        return {"versions_removed": len(old), "nodes": self.shards.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], "deleted": self.manifest["deleted"]}

    def cursor(self, q, where: Column | None = None, passing: DataFrame | None = None, keys: list[tuple[str, int]] | None = None, **options) -> Cursor:
        return Cursor(self, q, {"where": where, "passing": passing, "keys": keys}, options)


class Cursor:
    """A search that can be gone on with. Each fetch gives the nearest rows that
    weren't given before; the budget grows while it finds too few of them."""

    def __init__(self, index: GraphIndex, q, filters: dict, options: dict):
        self.index, self.filters, self.options = index, filters, options
        self.rescan(q)

    def rescan(self, q) -> None:
        """Begin again, with another query vector."""
        self.q, self.given = q, []
        self.ef = SearchOptions.of(self.index.spark, **self.options).ef_search

    def fetch(self, n: int) -> list[tuple[int, float]]:
        """Up to n further rows (row_id, d)."""
        rows = max(1, self.index.manifest["rows"])
        given = set(self.given)
        while True:
            found = self.index.search(self.q, len(given) + n, **self.filters, **{**self.options, "ef_search": min(self.ef, 10_000_000), "target_recall": 0.0}).collect()
            new = [(r.row_id, r.d) for r in found if r.row_id not in given][:n]
            if len(new) == n or self.ef >= rows:
                self.given += [i for i, _ in new]
                return new
            self.ef *= 2


def _rows(df: DataFrame, id: str, vec: str, filter: str | None, o: IndexOptions) -> DataFrame:
    value = F.col(filter).cast("long") if filter else F.lit(None).cast("long")
    rows = df.where(F.col(vec).isNotNull()).select(F.col(id).cast("long").alias("row_id"), value.alias("filter_val"), F.col(vec).cast("array<double>").alias("vec"))
    return rows.where(metrics.norm("vec") > 0) if o.metric == "cosine" else rows


def dictionary(df: DataFrame, column: str, ranges: int = 256) -> DataFrame:
    """(value, code): a text filter's codes, 1, 2, ... in the order of the text, so
    that comparisons of texts become comparisons of codes. Values are numbered
    within ranges, between splitters from a bounded sample of them."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    splitters = sorted(r.value for r in values.orderBy(F.xxhash64("value")).limit(ranges - 1).collect())
    if not splitters:
        return values.withColumn("code", F.lit(1).cast("long"))
    below = F.size(F.filter(F.array(*map(F.lit, splitters)), lambda s: s <= F.col("value")))
    dealt = values.select("value", F.explode(F.array(below)).alias("_range"))  # explode() keeps the optimizer from moving the expression into the window
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", before.alias("_base"))
    numbered = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy("value")))
    return numbered.join(F.broadcast(base), "_range").select("value", (F.col("_base") + F.col("_at")).cast("long").alias("code"))
