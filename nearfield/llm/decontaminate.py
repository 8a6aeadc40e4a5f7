"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are the maximal runs outside ASCII punctuation, space and control
characters, after lower-casing A-Z; they are compared by 64-bit hashes. An item's
windows are its runs of 13 words (an item of fewer words is one window).
Winnowing: of every window's 7-grams the least hash is its fingerprint, and only
the places of fingerprints are kept, each once. Equal windows have equal
fingerprints, so every shared window holds a place of the corpus and one of an
item that join. Each joined pair is then extended word by word to both sides, as
far as windows that hold the place can reach: where the common run is as long as
the item's window, all of it is hit. For items of 7 to 12 words the window
narrows to theirs; shorter ones are one gram themselves.

A bit map of the items' fingerprints spares the corpus most rows before the join.
A fingerprint that more than HOT different surroundings in items share is joined
with the whole window instead, so that a frequent phrase never pairs each of its
occurrences with each item. One pass over the texts finds all.

Defined cases: null or wordless texts have no words and no hits; a null item_id
makes hits but isn't listed; repeated items count once; repeated documents each
get a row; empty tables give no hits or no rows; extra columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import ascii_lower, materialize, wrapped

WINDOW, GRAM = 13, 7
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIEVE_WORDS = 1 << 14  # 64-bit numbers in the bit map of fingerprints
HOT = 64  # surroundings of a fingerprint that are joined by it alone
BROADCAST_ROWS = 1_000_000  # rows of item fingerprints that are sent to every executor; beyond it the join shuffles


def _words(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_words, hs: a hash of each word, in order."""
    words = F.array_remove(F.split(ascii_lower(F.coalesce("text", F.lit(""))), NOT_WORD), "")
    return df.select(*keys, words.alias("_w")).select(*keys, F.size("_w").cast("long").alias("n_words"), F.transform("_w", lambda w: F.xxhash64(w)).alias("hs"))


def _runs_of(df: DataFrame, keep: list[str], column: str, n: int, how: str) -> DataFrame:
    """`column`, an array, becomes that of `how` (of x and y) over every n
    neighbours, in steps of doubled width; the last step overlaps."""
    width = 1
    while width < n:
        by = min(width, n - width)
        rest = f"greatest(size({column}) - {by}, 0)"
        step = f"zip_with(slice({column}, 1, {rest}), slice({column}, {1 + by}, {rest}), (x, y) -> {how})"
        df, width = df.select(*keep, F.expr(step).alias(column)), width + by
    return df


def _places(df: DataFrame, keep: list[str], grams: dict[int, int], window: int, sieve: Column | None = None) -> DataFrame:
    """Rows (keep, pos, k, print, at, before, mid, after) of the fingerprints:
    for each k in grams those of all runs of grams[k] k-grams. before and after:
    the words on both sides, nearest first, as far as a window can reach. Rows
    without any keep one row; pos counts the places of a row from 0."""
    d, found = df.select(*keep, "hs"), []
    for k, run in grams.items():
        g, reach = f"_g{k}", max(0, window - k) if k == min(GRAM, window) else 0
        have = [*keep, "hs", *(f"_g{j}" for j in grams if j < k)]
        d = _runs_of(d.withColumn(g, F.col("hs")), have, g, k, "xxhash64(x, y)")
        last = f"(size({g}) - {run - 1})"
        # A gram is a fingerprint if it is the least of some run of grams that it is in.
        chosen = f"exists(sequence(greatest(1, i - {run - 1}), least(i, {last})), j -> {g}[i - 1] = array_min(slice({g}, j, {run})))" if run > 1 else "true"
        bit = f"shiftright(_sieve[int(shiftright({g}[i - 1], 6) & {SIEVE_WORDS - 1})], int({g}[i - 1] & 63)) & 1 = 1 AND " if sieve is not None else ""
        at = f"CASE WHEN {last} > 0 THEN filter(sequence(1, size({g})), i -> {bit}{chosen}) ELSE array() END"
        row = f"struct({k} AS k, {g}[i - 1] AS print, i AS at, reverse(slice(hs, greatest(1, i - {reach}), least(i - 1, {reach}))) AS before, slice(hs, i, {k}) AS mid, slice(hs, i + {k}, {reach}) AS after)"
        found.append(f"transform({at}, i -> {row})")
    if sieve is not None:
        d = d.withColumn("_sieve", sieve)
    return d.select(*keep, F.expr(f"posexplode_outer(concat({', '.join(found)}))").alias("pos", "_p")).select(*keep, "pos", "_p.*")


def _sieve(prints: DataFrame) -> Column:
    """A bit map of the items' fingerprints, SIEVE_WORDS numbers of 64 bits. It
    only spares rows: what it lets through is still joined."""
    words = dict(prints.select((F.shiftright("print", 6).bitwiseAND(SIEVE_WORDS - 1)).alias("w"), F.expr("shiftleft(1L, int(print & 63))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect())
    return F.from_json(F.lit(json.dumps([words.get(i, 0) for i in range(SIEVE_WORDS)])), "array<bigint>")


def _sized(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small.hint("merge")


def _common(a: str, b: str) -> Column:
    """How many words two arrays begin with in common."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    other = F.array_position(same, False)
    return F.when(other > 0, other - 1).otherwise(F.size(same)).cast("int")


def _whole(places: DataFrame, keep: list[str]) -> DataFrame:
    """Rows (keep, k, print, span, off, win): the windows of `span` words around
    each place, `off` words of them before it."""
    d = places.select("*", F.explode(F.sequence(F.lit(0), F.col("span") - F.col("k"))).alias("off"))
    more = F.col("span") - F.col("k") - F.col("off")
    d = d.where((F.size("before") >= F.col("off")) & (F.size("after") >= more))
    return d.select(*keep, "k", "print", "span", "off", F.concat(F.reverse(F.slice("before", F.lit(1), F.col("off"))), "mid", F.slice("after", F.lit(1), more)).alias("win"))


def _grams(lengths: list[int], window: int) -> dict[int, int]:
    """k -> the number of k-grams in the shortest window that k serves."""
    gram, grams = min(GRAM, window), {}
    for n in sorted(lengths):
        grams.setdefault(min(gram, n), n - min(gram, n) + 1)
    return grams


def matches(docs: DataFrame, benchmark: DataFrame, keys: list[str], window: int = WINDOW) -> tuple[DataFrame, DataFrame | None]:
    """docs and benchmark as from `_words` -> rows (keys, n_words) for all docs;
    and (keys, start, end, items): words start..end-1 are in windows of these
    items (None if no item has a word)."""
    items = benchmark.where("n_words > 0").withColumn("span", F.least("n_words", F.lit(window)).cast("int"))
    lengths = [n for (n,) in items.select("span").distinct().collect()]  # at most `window` numbers
    if not lengths:
        return docs.select(*keys, "n_words"), None
    grams = _grams(lengths, window)
    # An item's places are those of all runs that its own window asks for, or more.
    around = ["k", "print", "before", "mid", "after", "span"]
    own = _places(items, ["item_id", "span"], grams, window).where(F.col("k") == F.least("span", F.lit(min(GRAM, window))))
    own, _ = materialize(own.groupBy(*around).agg(F.collect_set("item_id").alias("items")), "fingerprints")
    places, _ = materialize(_places(docs, [*keys, "n_words"], grams, window, _sieve(own)), "places")
    hot = own.groupBy("k", "print").agg(F.count("*").alias("_n")).where(F.col("_n") > HOT).select("k", "print")
    hot, _ = materialize(hot, "hot")
    rows, few = own.count(), hot.count()
    cold = own.join(_sized(hot, few), ["k", "print"], "left_anti").withColumnsRenamed({"before": "_b", "mid": "_m", "after": "_a"})
    met = places.where("print IS NOT NULL").join(_sized(cold, rows), ["k", "print"]).where("mid = _m")
    left, right = _common("before", "_b"), _common("after", "_a")
    run = met.select(*keys, "k", "at", "span", "items", left.alias("_l"), right.alias("_r")).where("_l + k + _r >= span")
    found = run.select(*keys, (F.col("at") - F.col("_l")).alias("start"), (F.col("at") + F.col("k") + F.col("_r")).alias("end"), "items")
    if few:
        known = _whole(own.join(_sized(hot, few), ["k", "print"], "left_semi"), ["items"])
        known = known.groupBy("k", "print", "span", "off", "win").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
        here = places.join(_sized(hot, few), ["k", "print"], "left_semi").withColumn("span", F.explode(F.array(*map(F.lit, sorted(lengths))))).where("span >= k")
        here = _whole(here.withColumn("_at", F.col("at")), [*keys, "_at"]).join(known, ["k", "print", "span", "off", "win"])
        found = found.unionAll(here.select(*keys, (F.col("_at") - F.col("off")).alias("start"), (F.col("_at") - F.col("off") + F.col("span")).alias("end"), "items"))
    return places.where("coalesce(pos, 0) = 0").select(*keys, "n_words"), found


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash
    per row of docs. Contaminated: hit words are at least 1 in `least`."""
    keys = ["doc_id", "text_hash"]
    d = _words(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), keys)
    every, found = matches(d, _words(benchmark.select("item_id", "text"), ["item_id"]), keys, window)
    if found is None:
        hit = every.select(*keys, F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("_items")).limit(0)
    else:
        spans = found.groupBy(*keys).agg(F.collect_set(F.struct("start", "end")).alias("_at"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("_items"))
        # Runs in the order of their starts; each adds what lies beyond the end of those before it.
        step = lambda a, x: F.struct((a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["end"]).alias("end"))
        n_hit = F.aggregate(F.array_sort("_at"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"].cast("long")
        hit = spans.select(*keys, n_hit.alias("n_hit"), F.array_sort(F.transform("_items", lambda x: x.cast("string"))).alias("_items"))
    hit = hit.withColumnsRenamed({"doc_id": "_id", "text_hash": "_th"})
    out = every.join(hit, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_th")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        "doc_id", "n_words", n_hit.cast("long").alias("n_hit"),
        F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("_items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * least >= F.col("n_words"))).alias("contaminated"), "text_hash",
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated, with their columns."""
    bad = decontaminate(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th")).distinct()
    bad, _ = materialize(bad, "contaminated")  # its size is known then: while it is small, the texts aren't shuffled
    return wrapped(docs).join(bad, F.col("_doc.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("_doc.text") == F.col("_th")), "left_anti").select("_doc.*")
