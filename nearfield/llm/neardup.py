"""Near-duplicate documents: SuperMinHash, banding, verification, union-find.

1. A document's set is its distinct 5-word shingles (with fewer words the whole
   sequence is one), as 64-bit hashes. Documents of equal sets form a class,
   numbered by a 64-bit hash of the whole set; one text of it goes on.
2. SuperMinHash: every element ranks the M slots by its own random permutation,
   level by level; a slot keeps its least (level, fraction). A document stops as
   soon as no later level can lower any slot. BANDS bands of ROWS slots: a pair
   at the threshold misses all of them with probability below 1e-7.
3. Every bucket is tied to its least member (a row per member, never per pair);
   connected components of these ties are coarse clusters, which hold every
   linked pair.
4. Full sets of a cluster meet once, in one task. There pairs whose signatures
   leave a link possible are tried, likest first, on the full sets, unless they
   are joined already (union-find); only the edges that join something leave the
   task. A cluster of more than CHUNK members is first taken apart in rounds by
   leaders: each member is measured against up to LEADERS of its cluster that are
   far from each other, and goes to the cell of the nearest, and of each other
   one that the triangle inequality (the Jaccard distance is a metric) leaves a
   link to. What is linked to a cell's leader needs no further pair but with
   members that aren't, and only within the band of distances in which a link is
   possible; the rest are the clusters of the next round. So a group of near
   copies costs a row each. What rounds don't make smaller meets in one task for
   each pair of its chunks.
5. Connected components of those edges are the groups.

Defined cases: null or wordless texts have an empty set and link with nothing; a
null doc_id links like others, but is no component_id (without any in reach, it
is null and the row is kept); rows that repeat a doc_id are one document, linked
with all that any of its texts is linked with; an empty table gives an empty
result; extra columns are ignored. `one_of_each` takes rows for themselves:
different texts that share a doc_id stay, unless they are near-duplicates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import drop_path, materialize, row_hash, tidy, wrapped
from nearfield.llm.components import components

SHINGLE, PERCENT = 5, 85
BANDS, ROWS = 36, 6
M = BANDS * ROWS
KEYS = [f"k{i}" for i in range(BANDS)]
CHUNK, CHUNK_SHINGLES = 800, 3_000_000  # members, and shingles, that one side of a task holds
BROADCAST_ROWS = 1_000_000  # ids of cluster members that are sent to every executor; beyond it the join shuffles
LEADERS, LEADER_BYTES, ROUNDS = 16, 32_000_000, 8  # leaders of a cluster in a round, the bytes of their sets, and rounds
PROGRESS = 0.9  # a round that leaves more of its rows open is the last
LARGE_GROUP = 8_000_000  # bytes of a task's sets after which memory is given back
MARGIN = 0.20  # signatures' agreement may be so far below the threshold: over 6 standard deviations of M slots

U = np.uint64
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64 - 1, 256, dtype=np.uint64) | U(1)
_BASE, _STEP = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    data = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    # A word's hash: its bytes' numbers by powers of a base, from its own start.
    within = np.arange(len(data)) - np.repeat(starts, lengths)
    word = mix(np.add.reduceat(_BYTES[data] * _power(int(lengths.max()))[within], starts) + lengths.astype(np.uint64) * _BASE)
    k = min(size, len(words))
    n = len(words) - k + 1
    out = np.full(n, U(k))
    for i in range(k):
        out = out * _STEP + word[i : i + n]
    return np.unique(mix(out))


_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([[U(1)], np.full(max(n, 64) - 1, _BASE | U(1))]), dtype=np.uint64)
    return _powers


def super_minhash(sets: list[np.ndarray], m: int = M) -> np.ndarray:
    """One row of m slots (level << 32 | fraction) for each nonempty set."""
    sizes = np.array([len(s) for s in sets])
    x, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    top = np.int64(2**62)
    h = np.full(len(sets) * m, top)
    ks: list[np.ndarray] = []
    perm = None
    for level in range(m):
        draw = mix(x + U((0xD6E8FEB86659FD93 * (level + 1)) & (2**64 - 1)))
        k = level + ((draw >> U(32)) * U(m - level) >> U(32)).astype(np.int64)
        if perm is None and level < 4:
            slot = k.copy()
            for t in range(level - 1, -1, -1):  # undo the swaps of the levels before
                at, to = slot == t, slot == ks[t]
                slot[to] = t
                slot[at & ~to] = ks[t][at & ~to]
            ks.append(k)
        else:
            rows = np.arange(len(x))
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.uint8), (len(x), 1))
                for t, kt in enumerate(ks):
                    held = perm[rows, kt]
                    perm[rows, kt] = perm[:, t]
                    perm[:, t] = held
            slot = perm[rows, k]
            perm[rows, k] = perm[:, level]
            perm[:, level] = slot
        value = (np.int64(level) << np.int64(32)) | (draw & U(0xFFFFFFFF)).astype(np.int64)
        np.minimum.at(h, doc * m + slot.astype(np.int64), value)
        open_docs = h.reshape(-1, m).max(axis=1) >= np.int64(level + 1) << np.int64(32)
        if not open_docs.any():
            break
        live = open_docs[doc]
        if not live.all():
            x, doc, ks = x[live], doc[live], [kt[live] for kt in ks]
            perm = perm[live] if perm is not None else None
    return h.reshape(-1, m)


def bands(sig: np.ndarray) -> np.ndarray:
    """A key for each band of each row, different for different bands."""
    parts = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS))
    for i in range(ROWS):
        key = mix(key * _STEP + parts[:, :, i])
    return key.view(np.int64)


def short(sig: np.ndarray) -> np.ndarray:
    return (mix(sig.astype(np.uint64)) & U(255)).astype(np.uint8)


def _batches(texts, limit: int = 100_000):
    """Texts' sets, a bounded number of elements at a time."""
    group, held = [], 0
    for t in texts:
        s = shingles(t)
        group.append(s)
        held += len(s)
        if held >= limit:
            yield group
            group, held = [], 0
    if group:
        yield group


def class_of(s: np.ndarray) -> int:
    """A number for a set: two sums over its elements and its size, mixed."""
    both = np.array([mix(s).sum(dtype=np.uint64), mix(s ^ _STEP).sum(dtype=np.uint64)])
    return int(mix(mix(both[:1]) + both[1:] * _STEP + U(len(s))).view(np.int64)[0])


def _sign(batches):
    """Rows (doc_id, row, text) -> doc_id, row, n, class and band keys."""
    names = ["doc_id", "row", "n", "c", *KEYS]
    with np.errstate(over="ignore"):
        for batch in batches:
            at = 0
            for sets in _batches(x.as_py() for x in batch.column(2)):
                full = np.flatnonzero([len(s) > 0 for s in sets])
                keys = np.zeros((len(sets), BANDS), np.int64)
                if len(full):
                    keys[full] = bands(super_minhash([sets[i] for i in full]))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(sets)).cast(pa.int64()), batch.column(1).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()), *(pa.array(keys[:, i]) for i in range(BANDS)),
                ], names=names)
                at += len(sets)
    tidy()


def _sets(batches):
    """Rows (root, c, text) -> (root, c, shingles, sig)."""
    names = ["root", "c", "shingles", "sig"]
    with np.errstate(over="ignore"):
        for batch in batches:
            at = 0
            for sets in _batches(x.as_py() for x in batch.column(2)):
                sigs = short(super_minhash(sets))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, len(sets)) for i in range(2)), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sigs], pa.binary())], names=names)
                at += len(sets)
    tidy()


def distance(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 1 - both / (len(a) + len(b) - both)


def _lead(reach: float):
    """Candidates of a cluster -> those that lead: each over twice a link's
    distance from those before it."""

    def lead(table: pa.Table) -> pa.Table:
        kept: list[tuple[int, np.ndarray]] = []
        for c, data in sorted(zip(table.column("c").to_pylist(), table.column("shingles").to_pylist(), strict=True)):
            s = np.frombuffer(data, np.uint64)
            if not kept or all(distance(s, k) > 2 * reach for _, k in kept) and sum(k.nbytes for _, k in kept) + s.nbytes <= LEADER_BYTES:
                kept.append((c, s))
        return pa.table({"root": table.column("root").slice(0, 1).take([0] * len(kept)), "c": [c for c, _ in kept], "shingles": [s.tobytes() for _, s in kept]})

    return lead


def cells(d: np.ndarray, reach: float) -> np.ndarray:
    """The leaders whose cells a member of these distances goes to."""
    return np.flatnonzero(d <= d.min() + 2 * reach + 1e-9)


def _assign(reach: float):
    """Rows (root, salt, member, c, shingles), the leaders of each (root, salt)
    before its members -> (root, leader, c, d) for each cell of a member."""

    def assign(batches):
        held, leaders = None, []
        for batch in batches:
            out: list[tuple[int, int, int, float]] = []
            for root, salt, member, c, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                s = np.frombuffer(data, np.uint64)
                if (root, salt) != held:
                    held, leaders = (root, salt), []
                if not member:
                    leaders.append((c, s))
                    continue
                d = np.array([distance(s, k) for _, k in leaders])
                out += [(root, leaders[j][0], c, d[j]) for j in cells(d, reach)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], names=["root", "leader", "c", "d"])
        tidy()

    return assign


def link(ids: np.ndarray, sets: list[np.ndarray], sig: np.ndarray, side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows; with `side`, only between
    rows of different sides."""
    n = len(ids)
    size = np.array([len(s) for s in sets])
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    likely, least = [], int(np.floor(sig.shape[1] * (percent / 100 - MARGIN)))
    for i in range(n - 1):  # one row against those after it: memory in proportion to n
        near = 100 * np.minimum(size[i], size[i + 1 :]) >= percent * np.maximum(size[i], size[i + 1 :])
        if side is not None:
            near &= side[i + 1 :] != side[i]
        j = np.flatnonzero(near)
        if len(j):
            same = (sig[j + i + 1] == sig[i]).sum(axis=1)
            ok = same >= least
            if ok.any():
                likely.append(np.stack([same[ok], np.full(ok.sum(), i), j[ok] + i + 1], axis=1).astype(np.int32))
    out = []
    if likely:
        pairs = np.concatenate(likely)
        for _, i, j in pairs[np.argsort(-pairs[:, 0], kind="stable")].tolist():
            a, b = find(i), find(j)
            if a == b:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[a] = b
                out.append((int(ids[i]), int(ids[j])))
    return out


def _verify(percent: int):
    def verify(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("c").to_numpy()
        views = {}
        for name, kind in (("shingles", np.uint64), ("sig", np.uint8)):
            column = table.column(name).chunk(0)
            edge = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            data = column.buffers()[2]
            views[name] = [np.frombuffer(data, kind, (edge[i + 1] - edge[i]) // np.dtype(kind).itemsize, edge[i]) for i in range(len(ids))]
        side = table.column("chunk").to_numpy() if table.column("a")[0].as_py() != table.column("b")[0].as_py() else None
        found = np.array(link(ids, views["shingles"], np.stack(views["sig"]), side, percent), np.int64).reshape(-1, 2)
        if table.nbytes > LARGE_GROUP:
            del table, views
            tidy()
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return verify


def _pairs(state: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) within clusters: one task for each pair of chunks."""
    dealt = state.join(sizes.select("root", "chunks"), "root").withColumn("chunk", F.pmod(F.xxhash64("c"), F.col("chunks")).cast("int"))
    met = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("_o"))
    met = met.select("root", F.least("chunk", "_o").alias("a"), F.greatest("chunk", "_o").alias("b"), "chunk", "c", "shingles", "sig")
    return met.groupBy("root", "a", "b").applyInArrow(_verify(percent), "a long, b long")


def links(state: DataFrame, path: str, percent: int) -> DataFrame:
    """Edges (a, b) that connect what is linked within the clusters of state
    (root, c, shingles, sig), a written table at `path`."""
    spark, reach, found = state.sparkSession, 1 - percent / 100, []
    for number in range(ROUNDS + 1):
        sizes = state.groupBy("root").agg(F.count("*").alias("_n"), F.sum(F.octet_length("shingles") / 8).alias("_s"))
        sizes, _ = materialize(sizes.select("root", "_n", F.ceil(F.greatest(F.col("_n") / CHUNK, F.col("_s") / CHUNK_SHINGLES)).cast("int").alias("chunks")), "sizes")
        big = sizes.where("chunks > 1")
        rows = big.agg(F.sum("_n")).first()[0]
        if not rows or number == ROUNDS:
            found.append(materialize(_pairs(state, sizes, percent), "links")[0])
            break
        first = Window.partitionBy("root").orderBy(F.xxhash64("c", F.lit(number)), "c")
        some = state.select("root", "c").join(big.select("root"), "root", "left_semi").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= LEADERS)
        leaders = state.select("root", "c", "shingles").join(some.select("root", "c"), ["root", "c"], "left_semi").groupBy("root").applyInArrow(_lead(reach), "root long, c long, shingles binary")
        # Members are dealt out in chunks; each chunk gets the leaders, before its members.
        wide = big.select("root", "chunks")
        members = state.select("root", "c", "shingles").join(wide, "root").select("root", F.pmod(F.xxhash64("c"), F.col("chunks")).cast("int").alias("salt"), F.lit(1).alias("member"), "c", "shingles")
        before = leaders.join(wide, "root").select("root", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("salt"), F.lit(0).alias("member"), "c", "shingles")
        met = before.unionAll(members).repartition("root", "salt").sortWithinPartitions("root", "salt", "member")
        at, _ = materialize(met.mapInArrow(_assign(reach), "root long, leader long, c long, d double"), "cells")
        linked = F.col("d") <= reach + 1e-9
        # The nearest member that isn't linked to the cell's leader tells which linked ones it may be linked with.
        open_cells, _ = materialize(at.groupBy("root", "leader").agg(F.min(F.when(~linked, F.col("d"))).alias("_least")).where("_least IS NOT NULL"), "open")
        left = at.join(open_cells, ["root", "leader"]).where(~linked | (F.col("d") >= F.col("_least") - reach - 1e-9))
        left, at_left = materialize(left.select(F.xxhash64("root", "leader").alias("_cell"), "root", "c"), "left")
        if left.count() > PROGRESS * rows:
            found.append(materialize(_pairs(state, sizes, percent), "links")[0])
            break
        # Distances are of full sets: a member that is within reach is linked.
        found.append(at.where(linked & (F.col("c") != F.col("leader"))).select(F.col("c").alias("a"), F.col("leader").alias("b")))
        found.append(materialize(_pairs(state.join(big.select("root"), "root", "left_anti"), sizes, percent), "links")[0])
        state, new = materialize(left.join(state, ["root", "c"]).select(F.col("_cell").alias("root"), "c", "shingles", "sig"), "state")
        drop_path(spark, path, at_left)
        path = new
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def _groups(docs: DataFrame, percent: int, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """signed: doc_id, row (a hash of both), n and c of every row of docs; and
    the groups of classes, (c, group, id): the least class and doc_id in reach.
    by_id: rows of one doc_id are one document."""
    spark = docs.sparkSession
    row = F.xxhash64("doc_id", "text")
    keys = ", ".join(f"{k} long" for k in KEYS)
    signed, _ = materialize(docs.select("doc_id", row.alias("row"), "text").mapInArrow(_sign, f"doc_id long, row long, n long, c long, {keys}"), "signatures")
    classes = signed.where("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("id"), F.min("row").alias("row"), *(F.first(k).alias(k) for k in KEYS))
    classes, _ = materialize(classes, "classes")
    buckets, at_buckets = materialize(classes.select("c", F.explode(F.array(*KEYS)).alias("key")), "buckets")
    leads, _ = materialize(buckets.groupBy("key").agg(F.min("c").alias("lead"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "leads")
    ties = buckets.join(leads, "key").where("c <> lead").select(F.col("c").alias("a"), F.col("lead").alias("b")).distinct()
    coarse, _ = materialize(components(ties), "clusters")
    drop_path(spark, at_buckets)
    members = coarse.join(classes.select("c", "row"), F.col("node") == F.col("c")).select("root", "c", F.col("row").alias("_row"))
    members = F.broadcast(members) if coarse.count() <= BROADCAST_ROWS else members
    texts = docs.where("text IS NOT NULL").select(row.alias("row"), "text").join(members, F.col("row") == F.col("_row"))
    texts = texts.groupBy("c").agg(F.first("root").alias("root"), F.first("text").alias("text"))  # rows that repeat each other count once
    held, path = materialize(texts.select("root", "c", "text").mapInArrow(_sets, "root long, c long, shingles binary, sig binary"), "sets")
    edges = links(held, path, percent)
    if by_id:
        own = signed.where("doc_id IS NOT NULL AND c IS NOT NULL").select("doc_id", "c")
        several, _ = materialize(own.groupBy("doc_id").agg(F.min("c").alias("b"), F.max("c").alias("_max")).where("b <> _max").select("doc_id", "b"), "several")
        edges = edges.unionAll(own.join(several, "doc_id").where("c <> b").select(F.col("c").alias("a"), "b"))
    groups = classes.select("c", "id").join(components(edges), F.col("c") == F.col("node"), "left").select("c", "id", F.coalesce("root", "c").alias("group"))
    groups, _ = materialize(groups, "groups")
    least, _ = materialize(groups.groupBy("group").agg(F.min("id").alias("id")), "least")
    return signed.select("doc_id", "row", "n", "c"), materialize(groups.select("c", "group").join(least, "group"), "known")[0]


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of docs."""
    signed, known = _groups(docs, percent, by_id=True)
    out = signed.join(known.withColumnRenamed("c", "_c"), F.col("c") == F.col("_c"), "left")
    component = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component.isNull() | F.coalesce(F.col("doc_id") == component, F.lit(False))).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near-duplicate rows, with its columns: that of
    the least doc_id (null last), then of the least hash. Rows without words stay."""
    signed, known = _groups(docs, percent, by_id=False)
    rows = signed.where("c IS NOT NULL").groupBy("row", "c").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("_n")).join(known, "c")
    rows, _ = materialize(rows, "rows")  # tables: the rows of a large group can then be split in the join
    best, _ = materialize(rows.where(F.col("doc_id").eqNullSafe(F.col("id"))).groupBy("group").agg(F.min("row").alias("_best")), "best")
    judged, _ = materialize(rows.join(best, "group").select("row", "_n", (F.col("row") == F.col("_best")).alias("_kept")), "judged")
    gone, _ = materialize(judged.where("NOT _kept OR _n > 1").select(F.col("row").alias("_row"), "_kept"), "gone")
    keyed = wrapped(docs).select("_doc", F.xxhash64("_doc.doc_id", "_doc.text").alias("_key"))
    rest = keyed.join(gone.select("_row"), F.col("_key") == F.col("_row"), "left_anti")
    # Of rows that repeat a kept one, that of the least hash of all columns stays, the same in each run.
    again = keyed.withColumn("_all", row_hash(docs)).join(gone.where("_kept").select("_row"), F.col("_key") == F.col("_row"), "left_semi")
    one = again.groupBy("_key").agg(F.min_by("_doc", "_all").alias("_doc"))
    return rest.select("_doc").unionByName(one.select("_doc")).select("_doc.*")
