"""Mixing sources to target weights with a low-discrepancy schedule.  DataFrame functions only.

* Targets: every source gets its share of the wanted words by weight, but at most ``max_repeat``
  times its own size; what is cut off is shared again by weight (water filling).
* Schedule: slot i of the mix is the golden-ratio point ``frac(i * phi)`` mapped through the
  cumulative targets to a source, so every stretch of the mix is close to the weights.
* Blocks: each source's documents are put in a random but repeatable order and cut into blocks of
  ``block_words`` words; the r-th slot of a source takes its r-th block, none beyond its target.

So the slots decide how many words a source gives and in which order.  A source's number of slots is within
a few of ``target / block_words`` (the points' discrepancy), its words as many blocks below its target at most.

A source may hold any share of the rows: running sums and ranks are made per (source, bucket)
with the bucket totals added, never per source in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.llm.common import WORD, fresh_names, stored

LEAST_BLOCK, LARGEST_BLOCK, SLOTS = 16, 1024, 1 << 20
GOLDEN = 2654435769  # 2**32 / golden ratio, odd
_PERIOD = 1 << 31


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame, share: float = 1.5, max_repeat: float = 2.0) -> DataFrame:
    """sources (source, size, weight) plus ``target``: water-filled shares of share * all sizes.

    One row per source, so the windows over the whole table see one row per source.
    """
    every, cap = Window.partitionBy(), F.col("size") * F.lit(max_repeat)
    first = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("size").over(every) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    ranked = (sources.withColumn("weight", F.col("weight").cast("double")).withColumn("_cap", cap)
              .withColumn("_ratio", F.col("_cap") / F.col("weight"))
              .withColumn("_level", level).withColumn("_at", F.row_number().over(first)))
    # the first source that its cap does not stop sets the level for all those after it
    found = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_at", "_level"))).over(every)
    return (ranked.withColumn("_found", found)
            .withColumn("target", F.when(F.col("_at") >= F.col("_found._at"), F.col("weight") * F.col("_found._level"))
                        .otherwise(F.col("_cap")))
            .select(*sources.columns, "target"))


def repeating_weights(sources: DataFrame, pattern: tuple[float, ...]) -> DataFrame:
    """sources plus ``weight``: the pattern repeated over the sources by code point, null last."""
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in pattern]),
                                                     (at % len(pattern) + 1).cast("int")))


def place_documents(items: DataFrame, seed: str = "mix") -> DataFrame:
    """items (id, source, size) plus ``at``: words of the source before the document in its random order."""
    items = stored(items.withColumn("_order", F.substring(
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, 16)), "items")
    buckets = max(1, int(4 * items.count() ** 0.5))
    bucket = F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("long")
    keyed = items.withColumn("_bucket", bucket)
    past = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
              .select("source", "_bucket", F.coalesce(F.sum("_sum").over(past), F.lit(0)).alias("_before")))
    inside = (Window.partitionBy("source", "_bucket").orderBy("_order", "id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    run = keyed.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    totals = totals.withColumnRenamed("source", "_s").withColumnRenamed("_bucket", "_b")
    return (run.join(totals, run.source.eqNullSafe(totals._s) & (run._bucket == totals._b))
            .select("id", "source", "size", (F.col("_before") + F.col("_in")).alias("at")))


def block_size(targets: DataFrame) -> int:
    """Words a block: as few as ``SLOTS`` slots allow, so that small mixes meet their targets closely,
    from 16 to 1024 words, so that the slots of large ones stay fewer than their documents."""
    total = targets.agg(F.sum(F.floor("target"))).first()[0] or 0
    return int(min(max(int(total) // SLOTS, LEAST_BLOCK), LARGEST_BLOCK))


def schedule(targets: DataFrame, block_words: int, step: int = GOLDEN) -> DataFrame:
    """targets (source, size, target) -> slots (slot, source, rank, words): rank counts a source's slots from 0.

    ``words`` is what all slots of the source take: a block each, but no more than its target.  A source with
    a target of a word or more that no point hits gets one slot at the end.  Points are ``step`` of 2**32 apart.
    """
    spark = targets.sparkSession
    whole = targets.select("source", F.floor("target").cast("long").alias("words")).filter("words > 0")
    head = whole.agg(F.sum("words"), F.count(F.lit(1))).first()
    total, n_sources = int(head[0] or 0), head[1]
    n = -(-total // block_words)
    cell_words = max(1, total // max(1024, n_sources))
    up_to = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = whole.withColumn("hi", F.sum("words").over(up_to)).withColumn("lo", F.col("hi") - F.col("words"))
    # equal cells of [0, total): a slot meets only the sources that reach into its cell
    ranges = ends.select("source", "lo", "hi", F.explode(F.sequence(
        F.floor(F.col("lo") / F.lit(cell_words)), F.floor((F.col("hi") - 1) / F.lit(cell_words)))).alias("cell"))
    part = F.pmod(F.col("id") % F.lit(_PERIOD) * F.lit(step), F.lit(1 << 32)) / F.lit(float(1 << 32))
    points = (spark.range(n).select(F.col("id").alias("slot"), F.floor(part * F.lit(float(total))).alias("p"))
              .withColumn("cell", F.floor(F.col("p") / F.lit(cell_words))))
    hit = points.join(ranges, "cell").filter("p >= lo and p < hi").select("slot", "source")
    missed = (ends.select("source").join(hit.select(F.col("source").alias("_s")).distinct(),
                                         F.col("source").eqNullSafe(F.col("_s")), "left_anti")
              .select((F.lit(n) + F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
                      .cast("long").alias("slot"), "source"))
    slots = stored(hit.union(missed), "slots")
    chunk = max(1024, int(n ** 0.5))
    slots = slots.withColumn("_chunk", F.floor(F.col("slot") / F.lit(chunk)).cast("long"))
    past = Window.partitionBy("source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = (slots.groupBy("source", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(past), F.lit(0)))
              .withColumn("_slots", F.sum("_n").over(Window.partitionBy("source")))
              .select(F.col("source").alias("_s"), F.col("_chunk").alias("_c"), "_before", "_slots"))
    ranked = slots.withColumn("_in", F.row_number().over(Window.partitionBy("source", "_chunk").orderBy("slot")) - 1)
    most = whole.select(F.col("source").alias("_t"), F.col("words").alias("_words"))
    return (ranked.join(counts, ranked.source.eqNullSafe(counts._s) & (ranked._chunk == counts._c))
            .join(most, F.col("source").eqNullSafe(F.col("_t")))
            .select("slot", "source", (F.col("_before") + F.col("_in")).alias("rank"),
                    F.least(F.col("_slots") * F.lit(block_words), F.col("_words")).alias("words")))


def mix_plan(placed: DataFrame, targets: DataFrame, slots: DataFrame, block_words: int, max_repeat: float = 2.0) -> DataFrame:
    """Rows (slot, source, id, size, at, round, from_word, to_word): the words of each document that each slot takes.

    placed: ``place_documents``; targets: ``source_targets``; slots: ``schedule``.  The blocks cut a source's
    repeated stream of documents (``round`` counts its repetitions) every ``block_words`` words.
    """
    shape = slots.filter("rank = 0").select(F.col("source").alias("_s"), "words")
    sizes = targets.select(F.col("source").alias("_t"), F.col("size").alias("source_size"))
    rounds = int(-(-max_repeat // 1))
    streams = (placed.filter("size > 0").join(shape, F.col("source").eqNullSafe(F.col("_s")))
               .join(sizes, F.col("source").eqNullSafe(F.col("_t")))
               .withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
               .withColumn("lo", F.col("at") + F.col("round") * F.col("source_size"))
               .withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("words"))).filter("lo < hi"))

    def block_of(p: Column) -> Column:
        return F.floor(p / F.lit(block_words))

    pieces = (streams.withColumn("block", F.explode(F.sequence(block_of(F.col("lo")), block_of(F.col("hi") - 1))))
              .withColumn("_from", F.greatest("lo", F.col("block") * F.lit(block_words)))
              .withColumn("_to", F.least(F.col("hi"), (F.col("block") + 1) * F.lit(block_words)))
              .select(F.col("source").alias("_s"), "block", "id", "size", "at", "round",
                      (F.col("_from") - F.col("lo")).alias("from_word"), (F.col("_to") - F.col("lo")).alias("to_word")))
    return (slots.select("slot", "source", "rank")
            .join(pieces, F.col("source").eqNullSafe(F.col("_s")) & (F.col("rank") == F.col("block")))
            .select("slot", "source", "id", "size", "at", "round", "from_word", "to_word"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_repeat: float = 2.0,
        block_words: int | None = None, id_col: str = "doc_id", source: str = "source", text: str = "text",
        step: int = GOLDEN):
    """(documents placed with their source's size and target, plan rows) of the whole table.

    ``block_words``: words a block, by ``block_size`` unless given; ``step``: of the schedule's points.

    Null text has no words and is never taken; null sources are a source of their own, last in order;
    null ids and repeated rows are placed like any other; other columns are not read.  An empty table,
    or one without words, gives targets of 0 and an empty plan.
    """
    items = stored(docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), word_count(text).alias("size")),
                   "sizes")
    sizes = items.groupBy("source").agg(F.sum("size").alias("size"))
    targets = stored(source_targets(repeating_weights(sizes, weights), share, max_repeat), "targets")
    placed = stored(place_documents(items), "placed")
    words = block_words or block_size(targets)
    slots = stored(schedule(targets, words, step), "schedule")
    plan = mix_plan(placed, targets, slots, words, max_repeat)
    known = targets.select(F.col("source").alias("_t"), F.col("size").alias("source_size"), "target")
    return placed.join(known, F.col("source").eqNullSafe(F.col("_t"))).drop("_t"), plan


def taken_words(placed: DataFrame, plan: DataFrame, rounds: int = 1) -> DataFrame:
    """placed plus ``taken``, the words of each document that the plan takes, repeats counted, and ``first_slots``:
    the first slot of the document in each of the first ``rounds`` repetitions of its source, null where none takes it."""
    # documents with words are told apart by their source and place in it
    firsts = [F.min(F.when(F.col("round") == r, F.col("slot"))) for r in range(rounds)]
    sums = (plan.groupBy(F.col("source").alias("_s"), F.col("at").alias("_a"))
            .agg(F.sum(F.col("to_word") - F.col("from_word")).alias("_taken"), F.array(*firsts).alias("first_slots")))
    key = F.when(F.col("size") > 0, F.col("at"))
    return (placed.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (key == F.col("_a")), "left")
            .withColumn("taken", F.coalesce("_taken", F.lit(0)).cast("long")).drop("_s", "_a", "_taken"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_repeat: float = 2.0,
                  block_words: int | None = None, id_col: str = "doc_id", source: str = "source",
                  text: str = "text", slot_col: str | None = None) -> DataFrame:
    """Whole documents of the mix, all columns: each as often as its taken words hold its size, rounded.

    Rows of one id, source and size share their taken words evenly.  With ``slot_col`` (a name that no
    column has) each copy also carries its slot, the mix's order: the first slot that takes words of it in
    that repetition of its source.  Null, empty and wordless texts are never taken, null ids and sources are like
    any other; an empty table gives no rows.  A long text is taken in many blocks and returned whole.
    """
    placed, plan = mix(docs, weights, share, max_repeat, block_words, id_col, source, text)
    rounds = int(-(-max_repeat // 1))
    words, i, src, size, copies, copy, firsts = fresh_names(docs.columns, "words", "i", "src", "size", "copies", "copy", "firsts")
    least = [F.min(F.element_at("first_slots", r + 1)) for r in range(rounds)]
    taken = (taken_words(placed, plan, rounds).filter("size > 0").groupBy("id", "source", "size")
             .agg(F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int").alias(copies), F.array(*least).alias(firsts))
             .filter(F.col(copies) > 0)
             .select(F.col("id").alias(i), F.col("source").alias(src), F.col("size").alias(size), copies, firsts))
    slot = [] if slot_col is None else [F.element_at(firsts, F.col(copy)).alias(slot_col)]
    return (docs.withColumn(words, word_count(text))
            .join(taken, F.col(id_col).eqNullSafe(F.col(i)) & F.col(source).eqNullSafe(F.col(src)) & (F.col(words) == F.col(size)))
            .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns, *slot))
