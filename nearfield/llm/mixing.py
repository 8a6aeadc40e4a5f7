"""Mixing sources to target weights by weighted fair queueing.

Sources in code point order (null last) weigh 5, 2, 1, 5, 2, 1, ... and share
the corpus total; a target stops at REPEATS times its source's size and the
excess goes to the others by weight. Each source offers its documents in a
hashed order, REPEATS times over. An offer's virtual finish time is the number
of its source's words up to and with it, divided by the source's target. In the
global order of finish times the total budget is reached at time 1: offers that
finish by then are taken whole, and those in service, one per source at most,
are truncated to the words served by then; the words that remain of rounding go,
one each, to the sources whose offer in service finishes first. So what is taken
adds up to the budget, and each source's part is its target, to a word.

The mix comes out in the order of virtual finish times. As time 1 serves the
whole budget, equal stretches of time hold equally many words: they are the
splitters of the range partitioning, without a sample.

Defined cases: null text has size 0; documents without words are taken as often
as their place in the queue says, with 0 words; a source without words has target
0 and nothing of it is taken; repeated rows are documents of their own, and equal
rows are interchangeable; an empty table gives an empty result. Every choice
depends on the rows alone, so reruns agree. A truncated text keeps its first
words and the white space between them; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import materialize, row_hash, running_sum, wrapped

WEIGHTS, REPEATS = (5.0, 2.0, 1.0), 3
ROWS_PER_BUCKET, LEAST_BUCKETS = 50_000, 64
EQUAL_ROWS = 10_000  # equal rows that queue as one; more are dealt out over several places
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size) rows, one per source -> with source_no, target.

    target = min(repeats * source_size, level * weight), where the level makes
    the targets add up to the total: sources are filled in the order of
    repeats * source_size / weight; those before the level are full. One narrow
    row per source, so these windows run over the sources, not the documents.
    """
    w = list(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.withColumn("source_no", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, w)), F.pmod("source_no", F.lit(len(w))) + 1)
    cap = (F.col("source_size") * repeats).cast("double")
    s = numbered.withColumns({"_w": weight, "_cap": cap}).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("_ratio", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("_ratio", "source_no").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("_total", F.sum("source_size").over(every).cast("double"))
    s = s.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest))
    # The first source, in that order, whose cap isn't reached sets the level of all after it.
    s = s.withColumn("_level", F.first(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")), ignorenulls=True).over(Window.orderBy("_ratio", "source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return s.withColumn("target", F.coalesce(F.least("_cap", F.col("_level") * F.col("_w")), F.col("_cap"))).select("source", "source_no", "source_size", "target")


def queues(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, keep: tuple = ()) -> DataFrame:
    """The queue: one row for up to EQUAL_ROWS equal documents, with doc_id,
    source, size, keep, source_no, source_size, target, words (its source's part
    of the budget), equal (how many documents it stands for) and _upto (the
    source's words up to and with all of them)."""
    same = ["doc_id", "source", "size", *keep]
    sized = docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), *keep)
    sized, _ = materialize(sized.groupBy(*same).agg(F.count("*").alias("equal")), "sized")
    rows = sized.agg(F.coalesce(F.sum(F.ceil(F.col("equal") / EQUAL_ROWS)), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, -(-rows // ROWS_PER_BUCKET))
    known = targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("equal")).alias("source_size")), weights, repeats)
    known, _ = materialize(known.withColumn("words", F.floor("target")), "targets")
    d = sized.join(known.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    d = d.select("*", F.explode(F.sequence(F.lit(0), ((F.col("equal") - 1) / EQUAL_ROWS).cast("int"))).alias("_part")).withColumn("equal", F.least(F.col("equal") - F.col("_part") * EQUAL_ROWS, F.lit(EQUAL_ROWS)))
    # The shuffled order of a source: its documents by hash, dealt out over ranges of the hash.
    d = d.withColumn("_h", F.xxhash64(F.lit("mixing"), "doc_id", "size", "_part")).withColumn("_b", F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * buckets))
    d = running_sum(d.withColumn("_all", F.col("size") * F.col("equal")), ["source_no"], "_b", ["_h", "doc_id", *keep, "_part"], "_all", "_upto")
    d, _ = materialize(d.drop("_h", "_b", "_all", "_part"), "queues")
    # One row per source at most: the offer in service at the cut, by its finish time.
    offer = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_r")
    serving = d.where("size > 0").select("*", offer)
    end = F.col("_r") * F.col("source_size") + F.col("_upto")
    first = end - F.col("size") * F.col("equal")
    own_end = first + (F.floor((F.col("words") - first) / F.col("size")) + 1) * F.col("size")
    serving = serving.where((first <= F.col("words")) & (end > F.col("words"))).select("source_no", (own_end / F.col("target")).alias("_finish"))
    spare = known.agg(F.round(F.sum("target") - F.sum("words")).alias("_spare"))
    more = serving.withColumn("_rank", F.row_number().over(Window.orderBy("_finish", "source_no"))).join(F.broadcast(spare), F.col("_rank") <= F.col("_spare")).select("source_no")
    known, _ = materialize(known.join(more.withColumn("_more", F.lit(1)), "source_no", "left").select("source_no", (F.col("words") + F.coalesce("_more", F.lit(0))).alias("words")), "parts")
    return d.drop("words").join(known, "source_no")


def _served(upto: Column, repeats: int) -> tuple[Column, Column]:
    """How many offers of a document are begun, and the words served, if its own
    words end at `upto` in its source's order."""
    start = [F.lit(r) * F.col("source_size") + upto - F.col("size") for r in range(repeats)]
    copies = sum(((s < F.col("words")).cast("int") for s in start), F.lit(0))
    taken = sum((F.least(F.greatest(F.col("words") - s, F.lit(0)), F.col("size")) for s in start), F.lit(0))
    return copies, taken.cast("long")


def each(queue: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """One row per document of the queue, with copies and taken."""
    d = queue.select("*", F.explode(F.sequence(F.lit(1), F.col("equal").cast("int"))).alias("_i"))
    d = d.withColumn("_upto", F.col("_upto") - (F.col("equal") - F.col("_i")) * F.col("size"))
    copies, taken = _served(F.col("_upto"), repeats)
    return d.withColumns({"copies": copies, "taken": taken})


def mix_table(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, keep: tuple = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies
    (how many of its offers the queue begins) and taken (words); `keep` is carried."""
    return each(queues(docs, weights, repeats, keep), repeats).select("doc_id", "source", "size", "source_size", "target", "copies", "taken", *keep)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), n), "")


def mix_documents(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The mix itself: each row of docs as often as the queue takes it, the one
    at its source's cut truncated, with all columns, in the order of finish times."""
    key = ["_row", "_id", "_null"]
    keyed = lambda df: df.withColumns({"_id": F.coalesce("doc_id", F.lit(0)), "_null": F.col("doc_id").isNull()})
    marked = wrapped(docs).select("_doc", "_doc.doc_id", "_doc.source", "_doc.text", row_hash(docs).alias("_row"))
    queue = each(queues(marked, weights, repeats, ("_row",)), repeats).where("copies > 0")
    # Equal rows share a key, and are shuffled as one. Of the counts that they take only a few are different.
    begin = F.col("_upto") - F.col("size")
    levels = keyed(queue).groupBy(*key, "copies", "taken").agg(F.count("*").alias("rows"), F.min("size").alias("size"), F.min(begin / F.col("target")).alias("at"), F.min(F.col("source_size") / F.col("target")).alias("lap"))
    levels = levels.groupBy(*key).agg(F.collect_list(F.struct("copies", "taken", "rows", "size", "at", "lap")).alias("_levels"))
    chosen = keyed(marked).groupBy(*key).agg(F.first("_doc").alias("_doc")).join(levels, key).select("_doc", F.explode("_levels").alias("_l"))
    copy = chosen.select("_doc", "_l", F.explode(F.sequence(F.lit(1), F.col("_l.rows"))).alias("_i")).select("_doc", "_l", F.explode(F.sequence(F.lit(0), F.col("_l.copies") - 1)).alias("_r"))
    left = F.col("_l.taken") - F.col("_r") * F.col("_l.size")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    finish = F.col("_l.at") + F.col("_r") * F.col("_l.lap")
    out = copy.select("_doc", left.alias("_left"), (left < F.col("_l.size")).alias("_cut"), finish.alias("_time"))
    out = out.repartitionById(parts, F.least(F.floor(F.coalesce("_time", F.lit(0.0)) * parts), F.lit(parts - 1)).cast("int")).sortWithinPartitions("_time")
    text = F.when(F.col("_cut"), first_words(F.col("_doc.text"), F.col("_left").cast("int"))).otherwise(F.col("_doc.text"))
    return out.select(*(text.alias("text") if c == "text" else F.col(f"_doc.`{c}`") for c in docs.columns))
