"""Language identification by prediction by partial matching.

Bytes are mapped to symbols: letters A-Z lower-cased, other ASCII to one space
symbol (runs of it count once), each byte from 0x80 up to its own. For each
language a context tree of up to ORDER symbols is grown from a bounded sample of
labelled rows and then frozen: in a context seen n times with t different
followers, a follower seen c times has probability c / (n + t), any other escapes
with t / (n + t) to the shorter context; below the empty context all symbols are
alike. All languages share one set of context nodes, so the deepest node of every
position is looked up once and its exact code lengths in all languages are one
row of a table. A text's language is that of the least total code length (the
first by name in a tie); the score is its share of 2 ** -length over all
languages, the gain the share of bits it saves against a code without any model.

Defined cases: null texts and texts without a letter are `und` with score 0, as
is everything if no row can be learned from; a null doc_id is neither held out
nor learned from; repeated rows each get a row; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import tidy, wrapped

ORDER = 3
SAMPLE_ROWS = 300  # labelled rows learned from, for each language
SAMPLE_CHARS = 20_000  # characters learned from in one of them: a stretch at a hashed place of a longer text
OVERSAMPLE = 4  # times SAMPLE_ROWS: rows that a threshold of the hash lets through before they are ranked
LEAST_SCORE = 0.5  # in the pipeline: the language is likelier than all others together
LEAST_GAIN = 0.0  # in the pipeline: a text that no language's model codes shorter than no model is in none of them
LEAST_SEEN = 2  # a context gets a node if some language saw it so often
PIECE = 1 << 18  # symbols scored at a time
LETTER = regex.compile(r"\p{L}")
SPACE, OTHER, HIGH = 0, 27, 28  # symbols: 1..26 letters, 28.. bytes from 0x80 seen in training


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model:
    def __init__(self, samples: dict[str, list[str]], order: int = ORDER):
        self.langs, self.order = sorted(samples), order
        data = {lang: [t.encode() for t in samples[lang]] for lang in self.langs}
        high = sorted({b for texts in data.values() for t in texts for b in set(t) if b >= 0x80})
        self.symbol = np.full(256, SPACE, np.uint8)
        self.symbol[0x80:] = OTHER
        for i in range(26):
            self.symbol[ord("a") + i] = self.symbol[ord("A") + i] = 1 + i
        for i, b in enumerate(high):
            self.symbol[b] = HIGH + i
        self.size = HIGH + len(high)
        self._grow([np.concatenate([self.symbols(t, True) for t in data[lang]] or [np.empty(0, np.uint8)]) for lang in self.langs])

    def symbols(self, data: bytes, padded: bool = False) -> np.ndarray:
        """Symbols of a text; padded: with the spaces that stand before it."""
        s = self.symbol[np.frombuffer(data, np.uint8)]
        if len(s):
            s = s[~((s == SPACE) & np.concatenate([[True], s[:-1] == SPACE]))]
        return np.concatenate([np.zeros(self.order, np.uint8), s]) if padded else s

    def _grow(self, texts: list[np.ndarray]) -> None:
        a, n_langs = self.size, len(self.langs)
        known = np.zeros(1, np.int64)  # codes of the contexts of the present depth; the last symbol is the highest digit
        p = np.full((1, a, n_langs), 1.0 / a)
        self.tables, rows, first = [], [], 0
        for depth in range(self.order + 1):
            counts = np.zeros((len(known), a, n_langs))
            for k, t in enumerate(texts):
                if len(t) <= self.order:
                    continue
                code = self._codes(t, depth)
                at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                hit = known[at] == code
                np.add.at(counts, (at[hit], t[self.order :][hit], k), 1)
            n, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
            with np.errstate(invalid="ignore", divide="ignore"):
                p = np.where(n == 0, p, np.where(counts > 0, counts / (n + kinds), kinds / (n + kinds) * p))
            rows.append(p)
            if depth == self.order:
                break
            # Longer contexts that were seen often enough; a table leads from each node to them, or back to itself.
            seen: dict[int, int] = {}
            for t in texts:
                if len(t) > self.order:
                    for c, m in zip(*map(np.ndarray.tolist, np.unique(self._codes(t, depth + 1), return_counts=True)), strict=True):
                        seen[c] = max(seen.get(c, 0), m)
            parents = set(known.tolist())
            longer = np.array(sorted(c for c, m in seen.items() if m >= LEAST_SEEN and c // a in parents), np.int64)
            table = np.repeat(np.arange(first + len(known), dtype=np.int32)[:, None], a, axis=1)
            parent = np.searchsorted(known, longer // a)
            table[first + parent, longer % a] = first + len(known) + np.arange(len(longer))
            self.tables.append(table)
            first, p, known = first + len(known), p[parent] if len(longer) else p[:0], longer
        p = np.concatenate(rows)
        self.cost = (-np.log2(p)).reshape(len(p) * a, n_langs).astype(np.float32)

    def _codes(self, t: np.ndarray, depth: int) -> np.ndarray:
        """A number for the `depth` symbols before each position from `order` on."""
        code = np.zeros(len(t) - self.order, np.int64)
        for back in range(1, depth + 1):
            code = code * self.size + t[self.order - back : len(t) - back]
        return code

    def lengths(self, texts: list[np.ndarray]) -> np.ndarray:
        """Code length in bits of each padded text, in each language."""
        a = np.concatenate(texts)
        node = np.zeros(len(a) - self.order, np.int64)
        for back, table in enumerate(self.tables, 1):
            node = table[node, a[self.order - back : len(a) - back]]
        bits = self.cost[node * self.size + a[self.order :]]
        ends = np.cumsum([len(t) for t in texts]) - self.order
        starts = np.concatenate([[0], ends[:-1] + self.order])
        out = np.zeros((len(texts), len(self.langs)))
        full = np.flatnonzero(ends > starts)
        if full.size:
            cuts = np.stack([starts[full], ends[full]], axis=1).ravel()
            out[full] = np.add.reduceat(np.concatenate([bits, np.zeros((1, len(self.langs)), np.float32)]), cuts, axis=0, dtype=np.float64)[::2]
        return out

    def score(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Language, score and gain of each text."""
        found, group, held = [("und", 0.0, 0.0)] * len(texts), [], 0
        size = dict.fromkeys(range(len(texts)), 0)

        def settle():
            nonlocal group, held
            if not group:
                return
            bits = self.lengths([s for _, s in group])
            total: dict[int, np.ndarray] = {}
            for (i, _), b in zip(group, bits, strict=True):
                total[i] = total.get(i, 0) + b
            sums.update({i: sums.get(i, 0) + b for i, b in total.items()})
            group, held = [], 0

        sums: dict[int, np.ndarray] = {}
        for i, t in enumerate(texts):
            if not t or not self.langs or not LETTER.search(t):
                continue
            s = self.symbols(t.encode("utf-8", "surrogatepass"), True)
            size[i] = len(s) - self.order
            for at in range(0, max(1, len(s) - self.order), PIECE):
                piece = s[at : at + PIECE + self.order]
                group.append((i, piece))
                held += len(piece)
                if held >= PIECE:
                    settle()
        settle()
        for i, b in sums.items():
            best = int(np.argmin(b))
            found[i] = (self.langs[best], float(1 / np.exp2(np.maximum(b[best] - b, -1000)).sum()), float(1 - b[best] / (size[i] * np.log2(self.size))))
        return found


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """From text and lang of at most `rows` documents a language, the first by a
    hash of doc_id, not held out; of rows that repeat a doc_id the least text, and
    of a text over `chars` characters a stretch of so many. Only rows whose hash
    is below a threshold, set by the language's number of documents, are ranked:
    their number depends neither on the input nor on the number of tasks."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).withColumn("_h", F.xxhash64(F.lit("langid"), "doc_id"))
    # One narrow row a language, as in the model itself, which every executor gets.
    share = labelled.groupBy("lang").agg((F.lit(float(OVERSAMPLE * rows)) / F.approx_count_distinct("doc_id")).alias("_share")).withColumnRenamed("lang", "_l")
    low = (F.col("_h") / F.lit(2.0**64) + 0.5) <= F.col("_share")
    some = labelled.select("doc_id", "lang", "_h").join(F.broadcast(share), (F.col("lang") == F.col("_l")) & low).select("doc_id", "lang", "_h").distinct()
    order = Window.partitionBy("lang").orderBy("_h", "doc_id")
    ids = some.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= rows).select("doc_id", "lang")
    samples: dict[str, list[str]] = {}
    # ids holds at most `rows` rows a language, as the model does, so it can be sent to every executor.
    sample = labelled.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    at = F.pmod(F.xxhash64("doc_id", F.lit("stretch")), F.greatest(F.char_length("text") - chars, F.lit(0)) + 1) + 1
    for lang, text in sample.select("lang", F.substr("text", at.cast("int"), F.lit(chars))).collect():
        samples.setdefault(lang, []).append(text)
    return Model(samples)


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """docs' columns `keep`, lang_pred, score and gain for every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(*keep, *([] if "text" in keep else ["text"]))
    at = source.columns.index("text")
    schema = source.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("gain", "double")

    def run(batches):
        m = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                few = batch.slice(i, 512)
                found = m.score(few.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*(few.column(k) for k in range(len(keep))), pa.array([x[0] for x in found], pa.string()), *(pa.array([x[k] for x in found], pa.float64()) for k in (1, 2))], names=schema.names)
        tidy()

    return source.mapInArrow(run, schema)


def predict(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score per document, learned from docs."""
    return identify(docs, train(docs, rows), ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs in a learned language, with their columns: those with a
    letter that the likeliest language's model codes shorter than no model (gain
    above LEAST_GAIN), if its score is at least LEAST_SCORE. If no language could be learned, those with a letter."""
    model = train(docs, rows)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows_in = wrapped(docs).select("_doc", F.col("_doc.text").alias("text"))
    return identify(rows_in, model, ["_doc"]).where((F.col("lang_pred") != "und") & (F.col("gain") > LEAST_GAIN) & (F.col("score") >= LEAST_SCORE)).select("_doc.*")
