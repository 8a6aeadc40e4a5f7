"""Removal of repeated passages: every byte covered by a string of `length`
bytes that also starts anywhere else, by a suffix array over content-defined
tokens.

A suffix array of all suffixes takes more than 20 bytes for each byte of text, so
suffixes are sampled: of each `length`-byte window, the sub-string of GRAM bytes
with the least hash is its anchor, and neighbouring windows with one anchor form a
run. Equal windows have equal anchors at equal offsets, so texts are cut into the
same runs wherever they agree, but for the ends of the agreement, and suffixes
need to be compared only where a run begins. A suffix's leading tokens are the
hash of the run's anchor and that of all bytes of the run with what its windows
reach; 50 bytes of text give about one suffix of 32 bytes.

1. Splitters from a bounded sample of all suffixes (Spark's range partitioner,
   over a written table of them) range-partition the suffixes by their leading
   tokens (and, among equal ones, by a hash of their place, so that a hot passage
   is dealt out over many buckets). A bucket is sorted by multikey quicksort and
   compared neighbour by neighbour; one summary row per bucket, of the tokens at
   its ends, compares across boundaries.
2. Suffixes with both tokens equal are repeated for the whole run. Only where
   different runs share an anchor do they need a closer look, one copy of each.
3. Those runs are cut into pieces of PIECE windows, whose tokens are the bytes
   that all windows of a piece share, and all its bytes, and sorted alike; what is
   open still is cut into single windows, whose bytes decide.
4. The covered bytes of each document are taken out of its text.

Defined cases: null text is empty; texts shorter than `length` lose nothing; null
doc_id is a document like others; rows that repeat each other are documents of
their own, so their passages occur elsewhere; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import drop_path, materialize, tidy

LENGTH, GRAM, PIECE = 200, 64, 8
BUCKET_ROWS = 2_000_000  # suffixes that a bucket is planned for
BLOCK = 1 << 19  # windows handled at a time
BROADCAST_ROWS = 1_000_000

U = np.uint64
_BYTES = np.random.Generator(np.random.PCG64(20240301)).integers(1, 2**64 - 1, 256, dtype=np.uint64) | U(1)
_BASE = 0x9E3779B97F4A7C15
_LOW = U(0xFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of the base and of its inverse, modulo 2 ** 64."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int):
        if len(cls.up) < n:
            grow = lambda b: np.cumprod(np.concatenate([[U(1)], np.full(max(n, 1 << 16), U(b))]), dtype=np.uint64)
            cls.up, cls.down = grow(_BASE), grow(pow(_BASE, -1, 1 << 64))
        return cls.up, cls.down


class Hasher:
    """Hashes of any sub-strings of some bytes, from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = _Powers.get(len(data) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[: len(data)], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    n = len(v)
    a = np.full(-(-n // w) * w, U(2**64 - 1))
    a[:n] = v
    rows = a.reshape(-1, w)
    upto = np.minimum.accumulate(rows, axis=1).ravel()
    rest = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(rest[: n - w + 1], upto[w - 1 : n])


def runs(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor's offset from start, anchor hash, run hash)
    of the runs of all texts. Texts are joined into blocks of bounded size; a
    window is used only if it lies in one text. Longer texts are cut into
    blocks, and a run that goes on in the next block is two runs."""
    found, group, held = [], [], 0

    def settle():
        nonlocal group, held
        if group:
            found.append(_block(group, length))
        group, held = [], 0

    for i, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), BLOCK):
            part = text[at : at + BLOCK + length - 1] if len(text) > BLOCK else text
            if held + len(part) > BLOCK:
                settle()
            group.append((i, at, part))
            held += len(part)
    settle()
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else tuple(np.empty(0, np.int64) for _ in range(6))


def _block(group: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    gram = min(GRAM, length)
    data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
    sizes = np.array([len(p) for _, _, p in group])
    ends = np.cumsum(sizes)
    hasher = Hasher(data)
    grams = np.arange(len(data) - gram + 1)
    h = hasher(grams, grams + gram)
    # The least hash decides, in a tie the rightmost place.
    key = (h & ~_LOW) | (_LOW - grams.astype(np.uint64))
    anchor = (_LOW - (_least(key, length - gram + 1) & _LOW)).astype(np.int64)
    windows = sizes - length + 1
    text = np.repeat(np.arange(len(group)), windows)
    window = np.repeat(ends - sizes - (np.cumsum(windows) - windows), windows) + np.arange(len(text))
    of = anchor[window]
    at = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (text[1:] != text[:-1])]))
    first, count, of, text = window[at], np.diff(np.concatenate([at, [len(window)]])), of[at], text[at]
    offset = of - first
    run = mix(hasher(first, first + count - 1 + length) + (offset * 65536 + count).astype(np.uint64))
    start = first - (ends - sizes)[text] + np.array([a for _, a, _ in group])[text]
    return np.array([i for i, _, _ in group])[text], start, count, offset, h[of], run


def _bytes(texts: pa.Array) -> list[bytes]:
    return [t or b"" for t in texts.cast(pa.string()).cast(pa.binary()).to_pylist()]


def _pack(start: np.ndarray, count: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return start << 24 | count << 12 | offset


TOKENS = ["h", "ctx", "r", "a", "b", "c"]


def multikey(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows by all keys, and how many keys each row of that
    order has in common with the one before it. As in multikey quicksort only
    rows that tie so far are sorted by the next key."""
    n = len(keys[0])
    order = np.argsort(keys[0], kind="quicksort")
    common = np.zeros(n, np.int8)
    if n:
        common[1:] = keys[0][order][1:] == keys[0][order][:-1]
    for depth, key in enumerate(keys[1:], 1):
        tied = common == depth
        within = np.flatnonzero(tied | np.concatenate([tied[1:], [False]]))
        if not len(within):
            break
        segment = np.cumsum(~tied[within])
        order[within] = order[within][np.lexsort((key[order[within]], segment))]
        same = key[order[1:]] == key[order[:-1]]
        common[1:] += (tied[1:] & same).astype(np.int8)
    return order, common


def _bucket(batches):
    """A bucket's suffixes -> those that are repeated, or open (of a group h with
    different ctx, some seen once) or at an edge of the bucket, and a note of what
    is at the edges."""
    from pyspark import TaskContext

    names, part = ["r", "a", "b", "c", "same", "open", "first", "edge", "part", "note"], TaskContext.get().partitionId()
    columns = [np.concatenate(x) for x in zip(*([c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows), strict=True)]
    if not columns:
        return
    h, ctx, *payload = columns
    order, common = multikey([h, ctx])
    h, ctx, payload = h[order], ctx[order], [p[order] for p in payload]
    n = len(order)
    kind, group = np.cumsum(common < 2) - 1, np.cumsum(common < 1) - 1
    count, of = np.bincount(kind), group[np.flatnonzero(common < 2)]  # rows of a kind, group of a kind
    kinds = np.bincount(of)
    once = np.bincount(of, weights=count == 1).astype(np.int64)
    same, opened, first = count[kind] > 1, ((kinds > 1) & (once > 0))[group], common < 2
    edge = (group == 0) | (group == group[-1]) << 1 | (kind == 0) << 2 | (kind == kind[-1]) << 3
    at_ends = lambda g: int(once[g] - sum(count[k] == 1 for k in {0, len(count) - 1} if of[k] == g))
    note = {
        "part": part, "first": [int(h[0]), int(ctx[0])], "last": [int(h[-1]), int(ctx[-1])], "kinds": len(count), "groups": len(kinds),
        "rows": [int(count[0]), int(count[-1])], "many": [bool(kinds[0] > 1), bool(kinds[-1] > 1)], "once": [at_ends(0) > 0, at_ends(len(kinds) - 1) > 0],
    }
    keep = np.flatnonzero(same | opened | (edge > 0))
    yield pa.RecordBatch.from_arrays([*(pa.array(p[keep]) for p in payload), pa.array(same[keep]), pa.array(opened[keep]), pa.array(first[keep]), pa.array(edge[keep].astype(np.int32)), pa.array(np.full(len(keep), part, np.int32)), pa.nulls(len(keep), pa.string())], names=names)
    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in payload), *(pa.nulls(1, pa.bool_()) for _ in range(3)), pa.nulls(1, pa.int32()), pa.array([part], pa.int32()), pa.array([json.dumps(note)])], names=names)
    tidy()


def across(notes: list[dict]) -> list[tuple]:
    """Notes of the buckets in order -> (part, same and open of the rows at its
    first edge, those at its last edge, whether its first kind goes on from the
    bucket before)."""
    root: dict[tuple, tuple] = {}

    def find(x: tuple) -> tuple:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    def node(what: str, i: int, end: int) -> tuple:
        return (what, i, 0 if notes[i]["kinds" if what == "kind" else "groups"] == 1 else end)

    many: set[tuple] = set()
    goes_on = [False] * len(notes)
    for i in range(1, len(notes)):
        before, now = notes[i - 1]["last"], notes[i]["first"]
        if before[0] == now[0]:
            if before == now:
                goes_on[i] = True
                root[find(node("kind", i, 0))] = find(node("kind", i - 1, 1))
            else:
                many.add(node("group", i, 0))
            root[find(node("group", i, 0))] = find(node("group", i - 1, 1))
    rows: dict[tuple, int] = {}
    for i, x in enumerate(notes):
        for k in {node("kind", i, 0), node("kind", i, 1)}:
            rows[find(k)] = rows.get(find(k), 0) + x["rows"][k[2]]
    several = {find(g) for g in many}
    once: set[tuple] = set()
    for i, x in enumerate(notes):
        for end in (0, 1):
            g = find(node("group", i, end))
            several |= {g} if x["many"][end] else set()
            once |= {g} if x["once"][end] or rows[find(node("kind", i, end))] == 1 else set()
    out = []
    for i, x in enumerate(notes):
        sides = [(rows[find(node("kind", i, end))] > 1, (g := find(node("group", i, end))) in several and g in once) for end in (0, 1)]
        out.append((x["part"], *sides[0], *sides[1], goes_on[i]))
    return out


def _sorted(source: DataFrame, rows, name: str) -> DataFrame:
    """The suffixes that `rows` makes of source, sorted: (r, a, b, c, same, open,
    first) of those that are repeated or open; first: the one that stands for
    all that equal it."""
    spark = source.sparkSession
    suffixes, path = materialize(source.mapInArrow(rows, ", ".join(f"{c} long" for c in TOKENS)), f"{name}-suffixes")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-suffixes.count() // BUCKET_ROWS))
    dealt = suffixes.repartitionByRange(parts, "h", "ctx", "r")
    bucketed, _ = materialize(dealt.mapInArrow(_bucket, "r long, a long, b long, c long, same boolean, open boolean, first boolean, edge int, part int, note string"), name)
    drop_path(spark, path)
    notes = sorted((json.loads(r.note) for r in bucketed.where("note IS NOT NULL").select("note").collect()), key=lambda x: x["part"])  # one a bucket
    edges = F.broadcast(spark.createDataFrame(across(notes), "part int, same0 boolean, open0 boolean, same1 boolean, open1 boolean, goes_on boolean"))
    at = lambda bit: F.col("edge").bitwiseAND(bit) > 0
    d = bucketed.where("note IS NULL").join(edges, "part")
    same = F.when(at(4), F.col("same0")).when(at(8), F.col("same1")).otherwise(F.col("same"))
    opened = F.when(at(1), F.col("open0")).when(at(2), F.col("open1")).otherwise(F.col("open"))
    first = F.col("first") & ~(at(4) & F.col("goes_on"))
    return d.select("r", "a", "b", "c", same.alias("same"), opened.alias("open"), first.alias("first")).where("same OR open")


def _tokens(h: np.ndarray, ctx: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    h, ctx = h.astype(np.uint64).view(np.int64), ctx.astype(np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, ctx, name_of(a, b), a, b, c)], names=TOKENS)


def name_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two numbers."""
    return mix(mix(a.astype(np.int64).view(np.uint64)) + b.astype(np.int64).view(np.uint64) * U(_BASE)).view(np.int64)


def _runs(length: int):
    """Rows (row, text) -> the suffixes that begin where runs do: a is the row, b
    the run's place."""

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    few = batch.slice(at, 1000)
                    text, start, count, offset, h, ctx = runs(_bytes(few.column(1)), length)
                    yield _tokens(h, ctx, few.column(0).to_numpy()[text], _pack(start, count, offset), np.zeros(len(text), np.int64))
        tidy()

    return run


def _contexts(length: int):
    """Rows (row, text, places) -> (run, place, bytes) of its runs at the places."""

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                for row, text, places in zip(*(batch.column(i) for i in range(3)), strict=True):
                    data, opened = (text.as_py() or "").encode("utf-8", "surrogatepass"), np.array(places.as_py(), np.int64)
                    cut = [data[p >> 24 : (p >> 24) + (p >> 12 & 4095) - 1 + length] for p in opened.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(name_of(np.full(len(opened), row.as_py(), np.int64), opened)), pa.array(opened), pa.array(cut, pa.binary())], names=["run", "place", "bytes"])

    return run


def _pieces(length: int, size: int):
    """Rows (run, place, bytes, wanted pieces) -> the suffixes of pieces of `size`
    windows: a is the run, b the first window, c piece << 12 | windows. A piece
    holds the windows whose distance to the anchor, divided by size, is `piece`;
    wanted: those of the PIECE-sized ones to cut, null for all."""

    def cut(few):
        place = few.column(1).to_numpy()
        data = few.column(2)
        edge = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
        base = edge[:-1] - edge[0]
        hasher = Hasher(np.frombuffer(data.buffers()[2], np.uint8)[edge[0] : edge[-1]])
        count, offset = place >> 12 & 4095, place & 4095
        row = np.repeat(np.arange(len(place)), count)
        window = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        distance = offset[row] - window
        piece = distance // size
        first = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])]))
        n = np.diff(np.concatenate([first, [len(row)]]))
        wanted = few.column(3)
        if wanted.null_count < len(wanted):
            lists = np.repeat(np.arange(len(wanted)), np.diff(wanted.offsets.to_numpy()))
            keep = np.isin(row[first] * 4096 + distance[first] // PIECE, lists * 4096 + wanted.flatten().to_numpy())
            first, n = first[keep], n[keep]
        row, at, q, distance = row[first], window[first], piece[first], distance[first]
        # What all windows of a piece share starts `size * q` before the anchor.
        core = base[row] + offset[row] - size * q
        h = mix(hasher(core, core + length - size + 1) + q.astype(np.uint64))
        ctx = mix(hasher(base[row] + at, base[row] + at + n - 1 + length) + (distance * 65536 + n).astype(np.uint64))
        return _tokens(h, ctx, few.column(0).to_numpy()[row], at, q << 12 | n)

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    yield cut(batch.slice(at, 2000))
        tidy()

    return run


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, start, n): windows start..start+n-1 of the document occur elsewhere.
    docs: row (a hash of doc_id and text), text."""
    if not 1 < length < 4096:
        raise ValueError("length must be from 2 to 4095")
    long = docs.where(F.octet_length("text") >= length)
    level = _sorted(long.select("row", "text"), _runs(length), "level0")
    start, n = F.expr("shiftright(b, 24)"), F.expr("shiftright(b, 12) & 4095")
    whole = level.where("same").select(F.col("a").alias("row"), start.alias("start"), n.alias("n"))
    opened = level.where("open AND first")
    lists, _ = materialize(opened.groupBy(F.col("a").alias("_row")).agg(F.collect_list("b").alias("_places")), "lists")
    texts = _some(long, lists, "_row").join(lists, F.col("row") == F.col("_row"))
    cut, at_cut = materialize(texts.select("row", "text", "_places").mapInArrow(_contexts(length), "run long, place long, bytes binary").dropDuplicates(["run"]), "contexts")
    level1 = _sorted(cut.withColumn("_want", F.lit(None).cast("array<long>")), _pieces(length, PIECE), "level1")
    wanted, _ = materialize(level1.where("open AND first").groupBy(F.col("a").alias("_run")).agg(F.collect_set(F.expr("shiftright(c, 12)")).alias("_want")), "wanted")
    closer, at_closer = materialize(cut.join(wanted, F.col("run") == F.col("_run")).select("run", "place", "bytes", "_want"), "closer")
    level2 = _sorted(closer, _pieces(length, 1), "level2")
    drop_path(docs.sparkSession, at_cut, at_closer)
    parts = [x.where("same").select(F.col("a").alias("_run"), F.col("b").alias("_at"), F.expr("c & 4095").alias("n")) for x in (level1, level2)]
    single = opened.where("NOT same").select(F.col("r").alias("_run"), F.col("a").alias("row"), start.alias("_from"))
    return whole.unionByName(parts[0].unionAll(parts[1]).join(single, "_run").select("row", (F.col("_from") + F.col("_at")).alias("start"), "n"))


def _some(docs: DataFrame, listed: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """docs whose row is, or isn't, in `listed`, told by broadcast while that is
    of bounded size: only ids are sent, and the other texts are not shuffled."""
    ids = listed.select(key)
    return docs.join(F.broadcast(ids) if listed.count() <= BROADCAST_ROWS else ids, F.col("row") == F.col(key), how)


def covered(starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Windows -> maximal removed runs, as rows (from, to)."""
    order = np.argsort(starts, kind="stable")
    begin, end = starts[order], np.maximum.accumulate(starts[order] + counts[order] - 1 + length)
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
    return np.stack([begin[new], end[np.concatenate([new[1:], [len(begin)]]) - 1]], axis=1)


def _cut(length: int, texts: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text, windows in zip(*(batch.column(i) for i in range(3)), strict=True):
                data, windows = (text.as_py() or "").encode("utf-8", "surrogatepass"), windows.as_py()
                spans = covered(np.array([w["start"] for w in windows]), np.array([w["n"] for w in windows]), length).tolist() if windows else []
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((doc_id.as_py(), len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if texts else None, [{"start": a, "end": b} for a, b in spans] if texts else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=names)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of docs, and with
    `texts` the kept bytes and the removed spans (byte offsets)."""
    d = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    marks = repeated_windows(d, length).groupBy(F.col("row").alias("_row")).agg(F.collect_set(F.struct("start", "n")).alias("_windows"))
    marks, _ = materialize(marks, "marks")
    marked = _some(d, marks, "_row").join(marks, F.col("row") == F.col("_row")).select("doc_id", "text", "_windows")
    others = _some(d, marks, "_row", "left_anti").select("doc_id", "text", F.lit(None).cast(marks.schema["_windows"].dataType).alias("_windows"))
    return marked.unionAll(others).mapInArrow(_cut(length, texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start: long, end: long>>")
