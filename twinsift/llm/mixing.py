"""Mixing sources to target weights with a low-discrepancy schedule.

Every source is a stream: its documents in a shuffled order laid end to end, repeated while its
target asks for it, and cut into blocks of equally many words. The mix is a list of slots. Slot
``j`` gets the golden-ratio point ``frac(j * 0.618...)``, and the source in whose part of the
cumulative target weights the point falls; the r-th slot of a source takes the r-th block of its
stream. Any run of slots thus has every source near its weight. Slots that the points leave
short of a target are appended, and a stream ends at its target, so targets are met to a word.

Nothing is done per source in one task: stream positions and slot ranks are prefix sums over
about sqrt(n) slices of a source, and points find their source through cells of equal width.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinsift.llm.common import numbered, passing_columns, words
from twinsift.staging import small_side, stage, stage_counted

#: The golden ratio's fraction in units of 10**-19: exact arithmetic at any slot number.
GOLDEN = 6180339887498948482

#: How often a document may be repeated at most.
MOST_REPEATS = 3


def source_targets(sizes: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """``(source, source_no, source_size, weight, target)`` of ``sizes(source, source_size)``.

    Sources in order of code points, null last, weigh 1, 2, 3, 1, ... and share the sum of all
    sizes. A target stops at ``most`` times its source's size and the excess goes to the others
    by weight, as water rises: with level L, target = least(most * size, L * weight). Taken in
    order of most * size / weight, each source is full as long as the level of those from it
    on lies above; the level is the highest of these. One row per source; one window over them.
    """
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    weighed = sizes.withColumn("source_no", rank).withColumn("weight", (F.col("source_no") - 1) % 3 + 1)
    full = F.col("source_size") * most
    fill = Window.orderBy(full / F.col("weight"), "source_no")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(full).over(before), F.lit(0))
    levels = weighed.withColumn("level", left / F.sum("weight").over(after))
    return levels.withColumn("target", F.least(full.cast("double"), F.max("level").over(every) * F.col("weight"))).drop("level")


def _streams(sized: DataFrame, n: int, seed: int, order: list[str]) -> DataFrame:
    """Rows with ``start``, the words of their source that come before them in its shuffled order."""
    bits = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    dealt = sized.withColumn("_order", F.xxhash64(*order, F.lit(seed))).withColumn("_slice", F.shiftrightunsigned("_order", 64 - bits))
    earlier = Window.partitionBy("source_no").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = dealt.groupBy("source_no", "_slice").agg(F.sum("size").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    within = Window.partitionBy("source_no", "_slice").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("size").over(within), F.lit(0))
    return dealt.withColumn("_own", own).join(slices, ["source_no", "_slice"]).withColumn("start", F.col("_before") + F.col("_own")).drop("_order", "_slice", "_own", "_before")


def schedule(spark: SparkSession, targets: DataFrame, n_sources: int, total: int, block: int) -> DataFrame:
    """``(slot, source_no, block_no)``: which block of which source each slot of the mix takes."""
    n = -(-total // block)
    cells = 1 << max(2, (4 * n_sources - 1).bit_length())
    share = Window.orderBy("source_no")
    upto = F.sum("target").over(share.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("target").over(share.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    parts = targets.where("target > 0").withColumn("high", upto)
    # The last part ends beyond 1, whatever the rounding of the sums.
    last = F.lead("high").over(share).isNull()
    parts = parts.withColumn("low", F.coalesce(F.lag("high").over(share), F.lit(0.0))).withColumn("high", F.when(last, 2.0).otherwise(F.col("high")))
    cell = F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.lit(cells - 1), F.floor(F.col("high") * cells)))).alias("cell")
    parts = parts.select("source_no", "low", "high", cell)
    point = F.expr(f"cast((cast(slot as decimal(19,0)) * {GOLDEN}BD) % 10000000000000000000BD as double) / 1e19D")
    slots = spark.range(n).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("cell", F.floor(F.col("point") * cells))
    chunk = F.floor(F.col("slot") / max(1, math.isqrt(n)))
    # One part per source and cell: some five times as many rows as there are sources.
    drawn = slots.join(small_side(parts, 5 * n_sources + 8), "cell").where("point >= low and point < high").select("slot", "source_no", chunk.alias("chunk"))
    drawn = stage(drawn, "slots")
    earlier = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("_own", within).join(before, ["source_no", "chunk"]).select("slot", "source_no", (F.col("_before") + F.col("_own")).alias("block_no"))
    have = counts.groupBy("source_no").agg(F.sum("n").alias("have"))
    need = F.ceil(F.col("words") / block)
    short = targets.join(have, "source_no", "left").withColumn("have", F.coalesce("have", F.lit(0))).where(need > F.col("have"))
    tail = short.select("source_no", F.explode(F.sequence(F.col("have"), need - 1)).alias("block_no"))
    at = F.row_number().over(Window.orderBy("block_no", "source_no")) - 1 + n
    return ranked.unionByName(tail.select(at.cast("bigint").alias("slot"), "source_no", "block_no"))


def mix(sized: DataFrame, block: int = 1024, seed: int = 42, most: int = MOST_REPEATS, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix of ``sized(source, size, ...)``: its pieces and what it takes of each row.

    The first DataFrame has one row per slot and part of a row in its block: ``slot``,
    ``source_no``, ``start`` (names the row within its source), ``begin`` and ``length`` in
    words of the row. The second has the rows of ``sized`` with ``source_size``, ``target`` and
    ``taken``. Rows of size 0 are never taken; null is a source; equal rows are separate rows.
    ``order`` names the columns whose hash shuffles a source, all of them by default.
    """
    spark = sized.sparkSession
    sized, n = stage_counted(sized, "mix-sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), most)
    words_asked = F.least(F.round("target").cast("bigint"), most * F.col("source_size"))
    targets, n_sources = stage_counted(targets.withColumn("words", words_asked), "mix-targets")
    total = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    facts = targets.select(F.col("source").alias("_source"), "source_no", "source_size", "target", "words")
    known = sized.join(small_side(facts, n_sources), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = stage(_streams(known, n, seed, order or sized.columns), "mix-streams")
    rounds = F.explode(F.sequence(F.lit(0), F.floor((F.col("words") - F.col("start") - 1) / F.col("source_size"))))
    taken = placed.where("size > 0 and start < words").select("source_no", "start", "size", "words", "source_size", rounds.alias("round"))
    taken = taken.withColumn("at", F.col("start") + F.col("round") * F.col("source_size")).withColumn("end", F.least(F.col("at") + F.col("size"), F.col("words")))
    blocks = F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block))).alias("block_no")
    parts = taken.select("source_no", "start", "at", "end", blocks)
    first = F.greatest(F.col("at"), F.col("block_no") * block)
    parts = parts.select("source_no", "block_no", "start", (first - F.col("at")).alias("begin"), (F.least(F.col("end"), (F.col("block_no") + 1) * block) - first).alias("length"))
    pieces = schedule(spark, targets, n_sources, total, block).join(parts, ["source_no", "block_no"])
    sums = pieces.groupBy("source_no", "start").agg(F.sum("length").alias("_taken"))
    sums = sums.select(F.col("source_no").alias("_no"), F.col("start").alias("_start"), "_taken")
    # Rows without words lie at the same start as the next row; they join with nothing.
    mine = (F.col("source_no") == F.col("_no")) & (F.when(F.col("size") > 0, F.col("start")) == F.col("_start"))
    rows = placed.join(sums, mine, "left").withColumn("taken", F.coalesce("_taken", F.lit(0)).cast("bigint"))
    return pieces, rows.select(*sized.columns, "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def mixed_documents(documents: DataFrame) -> DataFrame:
    """What the mix takes of every document. Null and empty texts have size 0 and are not taken."""
    _, rows = mix(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


@passing_columns
def repeat_documents(documents: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, rounded to whole documents.

    Rows are told apart by their place, so null and repeated ids do no harm; documents without
    words are not in a mix.
    """
    rows_of = numbered(documents, "mix-documents")
    sized = rows_of.select("_row", "doc_id", "source", word_count(F.col("text")).alias("size"))
    _, rows = mix(sized, order=["doc_id", "source", "size"])
    times = F.round(F.col("taken") / F.col("size")).cast("int")
    copies = rows.where("taken > 0").select("_row", times.alias("_times")).where("_times > 0")
    return rows_of.join(copies, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).select(*documents.columns)
