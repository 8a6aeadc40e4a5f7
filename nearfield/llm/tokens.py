"""Token-ID output: documents -> wavelet matrix shards -> rows read back.

Documents are range-partitioned and sorted by doc_id (null first) and a hash of
the text, so that rows that share a doc_id can be split, tokenised, closed by an end id and written as shards of up to
SHARD_TOKENS ids (a document is never split) into the shared folder. Every
attempt of a task writes files of its own name; only those that a finished
attempt reported count, so lost executors leave no half or double shards.

Splitting at ASCII white space changes no token of a tokenizer whose
pre-tokenizer drops white space, so the pieces between are encoded once and kept
in a bounded table.

Defined cases: null or empty text has the end id only; null doc_id comes first;
repeated rows are documents of their own; an empty table writes no file; extra
columns are ignored.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.llm.common import materialize, new_path, tidy

SHARD_TOKENS, END_ID = 8_000_000, 2
CACHED_PIECES, KEPT_PIECES = 400_000, 150_000  # in a task, and from task to task of a Python worker
SLICE_BYTES = 12_000_000  # of text encoded at a time
_loaded: dict[str, tuple] = {}


#: Letters that normalizers (NFC, lower case) turn into letters; all others are encoded piece by piece.
WORD = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
#: Such letters and signs (no apostrophe, which may begin a word) after them.
HEAD, SIGNS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
CLOSED = HEAD + r"[!-&(-/:-@\[-`{-~]+$"


def _spread(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (counts[0] numbers), begin[1], ..."""
    n = int(counts.sum())
    kind = np.int32 if n < 2**31 else np.int64
    out = np.repeat((begin - (np.cumsum(counts) - counts)).astype(kind), counts)
    out += np.arange(n, dtype=kind)
    return out


def _strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()  # much quicker than to_pylist()


class _Table(dict):
    """Pieces -> numbers; a new piece gets the next one and waits in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class Encoder:
    """Whole texts -> ids, through a bounded table of pieces. When it is full,
    the half used most stays."""

    def __init__(self, path: str, cached: int = CACHED_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer, self.cached = Tokenizer.from_file(path), cached
        self.table = _Table()
        self.begin, self.length, self.uses = (np.zeros(0, np.int64) for _ in range(3))
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.ids = np.zeros(0, self.kind)
        names = sorted(self.tokenizer.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1])
        rules = json.loads(self.tokenizer.normalizer.__getstate__()) if self.tokenizer.normalizer else {}
        self.lowers = any(r.get("type") == "Lowercase" for r in rules.get("normalizers", [rules]))
        self.whole = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]  # found in the text as it is
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)  # tokens that end a word
        for name, i in names:
            self.ends[i] = name.endswith("</w>")

    def _ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in a row, and how many each has."""
        # Pieces of letters are one word each: they are encoded together and told apart by word ends.
        chosen = np.flatnonzero(pc.match_substring_regex(pieces, WORD).to_numpy(zero_copy_only=False))
        plain = _strings(pieces.take(pa.array(chosen)))
        joined = self.tokenizer.encode_batch_fast([" ".join(plain[i : i + 1000]) for i in range(0, len(plain), 1000)], add_special_tokens=False)
        ids = np.concatenate([np.asarray(e.ids, self.kind) for e in joined] or [np.zeros(0, self.kind)])
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(chosen) or len(ids) != (last[-1] + 1 if len(last) else 0):
            raise ValueError("the tokenizer doesn't end words as expected")
        counts = np.zeros(len(pieces), np.int64)
        counts[chosen] = np.diff(np.concatenate([[-1], last]))
        others = np.setdiff1d(np.arange(len(pieces)), chosen, assume_unique=True)
        alone = [np.asarray(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(_strings(pieces.take(pa.array(others))), add_special_tokens=False)]
        counts[others] = [len(a) for a in alone]
        begin = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), self.kind)
        out[_spread(begin[chosen], counts[chosen])] = ids
        out[_spread(begin[others], counts[others])] = np.concatenate([*alone, np.zeros(0, self.kind)])
        return out, counts

    def _learn(self) -> None:
        pieces, self.table.new = pa.array(self.table.new, pa.string()), []
        # Letters and closing signs are two words; each is encoded once.
        two = pc.match_substring_regex(pieces, CLOSED)
        heads = pc.if_else(two, pc.utf8_rtrim(pieces, SIGNS), pieces).dictionary_encode()
        tails = pc.replace_substring_regex(pieces.filter(two), HEAD, "").dictionary_encode()
        head, closed = heads.indices.to_numpy(), np.flatnonzero(two.to_numpy(zero_copy_only=False))
        tail = tails.indices.to_numpy() + len(heads.dictionary)
        ids, counts = self._ids(pa.concat_arrays([heads.dictionary, tails.dictionary]))
        begin = np.cumsum(counts) - counts
        n = counts[head]
        n[closed] += counts[tail]
        start = np.cumsum(n) - n
        flat = np.zeros(int(n.sum()), self.kind)
        flat[_spread(start, counts[head])] = ids[_spread(begin[head], counts[head])]
        flat[_spread(start[closed] + counts[head[closed]], counts[tail])] = ids[_spread(begin[tail], counts[tail])]
        self.begin = np.concatenate([self.begin, start + len(self.ids)])
        self.length = np.concatenate([self.length, n])
        self.uses = np.concatenate([self.uses, np.zeros(len(n), np.int64)])
        self.ids = np.concatenate([self.ids, flat])

    def trim(self, most: int) -> None:
        """Forget all but the pieces used most."""
        if len(self.table) <= most:
            return
        names = list(self.table)
        keep = np.sort(np.argsort(-self.uses, kind="stable")[:most])
        begin, n = self.begin[keep], self.length[keep]
        self.ids = self.ids[_spread(begin, n)]
        self.begin, self.length, self.uses = np.cumsum(n) - n, n, self.uses[keep] // 2
        self.table = _Table()
        for i, k in enumerate(keep.tolist()):
            self.table[names[k]] = i

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: none) in a row, and where each text's end."""
        if len(self.table) > self.cached:
            self.trim(self.cached // 2)
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if self.lowers:  # in small letters before, as fewer pieces differ
            lower = pc.ascii_lower(texts)
            if not any(pc.any(pc.match_substring(lower, t)).as_py() for t in self.whole):
                texts = lower
        split = pc.ascii_split_whitespace(texts)
        pieces = split.flatten().dictionary_encode()
        each = np.fromiter(map(self.table.__getitem__, _strings(pieces.dictionary)), np.int64, len(pieces.dictionary))
        if self.table.new:
            self._learn()
        which = each[pieces.indices.to_numpy()]
        self.uses += np.bincount(which, minlength=len(self.uses))
        n = self.length[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[_spread(self.begin[which], n)]
        offsets = split.offsets.to_numpy()
        return ids, upto[offsets[1:] - offsets[0]]


def slices(texts: pa.Array, limit: int):
    """(from, to) of consecutive texts of about `limit` bytes together."""
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + limit, "right")) - 1)
        yield at, min(to, len(texts))
        at = to


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _writer(tokenizer_path: str, folder: str, shard_tokens: int, end_id: int):
    def write(batches):
        import os
        import uuid

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyarrow import fs
        from pyspark import TaskContext

        from nearfield.llm.wavelet import encode

        enc, (store, root) = encoder(tokenizer_path), fs.FileSystem.from_uri(folder)
        part, attempt, made = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        docs, arrays, sizes, held, end = [], [], [], 0, np.array([end_id], enc.kind)

        def flush():
            nonlocal docs, arrays, sizes, held, made
            name = f"shard-{part:06d}-{made:06d}-{attempt}.wm"
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(encode(np.concatenate(arrays), docs, np.cumsum(sizes)))
            row = pa.RecordBatch.from_pydict({"name": [name], "part": [part], "seq": [made], "tokens": [held]}, schema=pa.schema([("name", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("tokens", pa.int64())]))
            docs, arrays, sizes, held, made = [], [], [], 0, made + 1
            return row

        for batch in batches:
            for at, to in slices(batch.column(1), SLICE_BYTES):
                ids, ends = enc.encode(batch.column(1).slice(at, to - at))
                for doc_id, own in zip(batch.column(0).slice(at, to - at).to_pylist(), np.split(ids, ends[:-1]), strict=True):
                    docs.append(doc_id)
                    arrays += [own, end]
                    sizes.append(len(own) + 1)
                    held += len(own) + 1
                    if held >= shard_tokens:
                        yield flush()
        if docs:
            yield flush()
        enc.trim(KEPT_PIECES)
        tidy()

    return write


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Write all of docs; returns (name, part, seq, tokens, base) per shard: base
    is the number of ids in the shards before it. One small row per shard."""
    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    order = ("doc_id", F.xxhash64("text"))
    ordered = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    made, _ = materialize(ordered.mapInArrow(_writer(tokenizer_path, folder, shard_tokens, end_id), "name string, part int, seq int, tokens long"), "shards")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _reader(batches):
    from nearfield.llm.wavelet import Shard

    schema = pa.schema([("name", pa.string()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            shard = Shard(content.as_py())
            ids, ends = memoryview(shard.decode()), shard.ends
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            crc = [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([path.as_py().rsplit("/", 1)[-1]] * len(starts)), pa.array(shard.doc_ids, pa.int64()), pa.array(starts), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())], schema=schema)
    tidy()


def read_shards(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder).select("path", "content")
    rows = files.mapInArrow(_reader, "name string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(shards.select("name", "base"), "name").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer_path: str, folder: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write docs as shards (into a new shared folder unless given) and read
    them back."""
    folder = folder or new_path(docs.sparkSession, "tokens")
    return read_shards(docs.sparkSession, folder, write_shards(docs, tokenizer_path, folder, shard_tokens))
