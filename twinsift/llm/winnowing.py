"""Document fingerprints by winnowing (Schleimer, Wilkerson and Aiken, 2003).

Words are hashed, every run of ``k`` words gets one hash, and of every ``window`` successive
run hashes the smallest is chosen, the rightmost one among equals. Any ``k + window - 1``
words that two texts share give them a common hash, and its position tells where. Words longer
than ``LONG`` characters, and words in scripts that are written without blanks, count as as many
words as they have characters, so texts of any kind have runs.

All of it is array functions of one row, so it needs no shuffle. A window minimum over ``w``
values is built in log2(w) passes, each taking the smaller of two shorter windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.llm.common import let

#: Bits of a packed value that hold the position (counted down); the 36 bits above hold the hash.
POSITION_BITS = 27
_LAST = (1 << POSITION_BITS) - 1
_HASH_MASK = (1 << (63 - POSITION_BITS)) - 1

#: Characters from which on a word is taken apart.
LONG = 24

# Scripts without blanks between words.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"

#: A character of such a script, a word of at most ``LONG`` others, or a character of any other word.
UNIT = rf"[{UNSPACED}]|(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D{UNSPACED}]{{1,{LONG}}}(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]"

#: Pieces between which block limits are placed by quantiles of the key.
PIECES = 128


def units(text: Column) -> Column:
    """The words of a text, and the characters of words that are long or in scripts without blanks."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0))


def winnow(text: Column, k: int = 5, window: int = 8) -> Column:
    """Chosen run hashes of ``text`` with their word positions, packed, in order of position.

    Null and blank texts give an empty array. Of a text of fewer than ``2 * window`` runs all are
    chosen, and after them each of its words by itself.
    """
    return let(F.transform(units(text), lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) > 0, _select(h, k, window)).otherwise(F.array().cast("array<bigint>")))


def _select(h: Column, k: int, window: int) -> Column:
    runs = F.size(h) - k + 1

    def packed(run: Column, i: Column) -> Column:
        return F.shiftleft(run.bitwiseAND(F.lit(_HASH_MASK)), POSITION_BITS).bitwiseOR((F.lit(_LAST) - i).cast("bigint"))

    def shrink(m: Column, span: int) -> Column:
        if span == window:
            return F.array_distinct(F.slice(m, F.lit(1), runs - window + 1))
        step = min(span, window - span)
        return let(F.transform(m, lambda x, i: F.least(x, F.get(m, i + step))), lambda n: shrink(n, span + step))

    every = F.transform(F.sequence(F.lit(0), runs - 1), lambda i: packed(F.xxhash64(*(F.get(h, i + j) for j in range(k))), i))
    single = F.transform(h, lambda x, i: packed(F.xxhash64(x), i))
    chosen = let(every, lambda m: F.when(runs >= 2 * window, shrink(m, 1)).otherwise(F.concat(m, single)))
    return F.when(runs < 1, single).otherwise(chosen)


def hashes(chosen: Column) -> Column:
    """The distinct hashes of a winnowed text."""
    return F.array_distinct(F.transform(chosen, lambda v: F.shiftright(v, POSITION_BITS)))


def as_text(chosen: Column) -> Column:
    """``hash@position`` of every chosen run, joined by commas; empty for a text without words."""
    return F.array_join(
        F.transform(chosen, lambda v: F.concat(F.hex(F.shiftright(v, POSITION_BITS)), F.lit("@"), F.lit(_LAST) - v.bitwiseAND(F.lit(_LAST)))), ","
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes; 1 for two empty ones."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise((F.size(a) + F.size(b) - either) / either)


def fingerprints(documents: DataFrame, k: int = 5, window: int = 8, text: str = "text") -> DataFrame:
    """``documents`` with ``chosen`` (packed runs) and ``fingerprint`` (their text) added."""
    return documents.withColumn("chosen", winnow(F.col(text), k, window)).withColumn("fingerprint", as_text(F.col("chosen")))


def with_next(rows: DataFrame, key: str, carry: dict[str, str], add: dict[str, Column] | None = None, blocks: int | None = None) -> DataFrame:
    """Rows with columns of the row that follows in descending ``key``; the first follows the last.

    ``carry`` maps new column names to columns of the following row, ``add`` has columns to
    compute from a row before that. The rows are shuffled once, into blocks of neighbouring
    keys; the first row of each block is also put at the end of the block before it. Limits of
    blocks come from quantiles of the keys, so at most ``blocks`` rows reach the driver.
    Null keys come last; rows with equal keys follow each other in order of a hash of theirs.
    """
    blocks = blocks or 16 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    least = -(1 << 63)
    keyed = F.coalesce(F.col(key).cast("bigint"), F.lit(least))
    limits = rows.agg(F.percentile_approx(F.col(key).cast("bigint"), [i / PIECES for i in range(PIECES + 1)], 10_000)).first()[0]
    block = _block(keyed, sorted(set(limits or [])), max(1, blocks // PIECES))
    placed = rows.withColumns({"_key": keyed, "_block": block})
    heads = sorted(placed.groupBy("_block").agg(F.max("_key").alias("key")).collect(), reverse=True)
    if not heads:
        added = rows.withColumns(add or {})
        return added.withColumns({name: F.lit(None).cast(added.schema[c].dataType) for name, c in carry.items()})
    before = [(head["key"], heads[i - 1]["_block"]) for i, head in enumerate(heads)]
    copies = rows.sparkSession.createDataFrame(before, "_key bigint, _to bigint")
    dealt = (
        placed.join(F.broadcast(copies), "_key", "left")
        .withColumn("_to", F.array_compact(F.array(F.struct(F.lit(0).alias("copy"), F.col("_block").alias("at")), F.when(F.col("_to").isNotNull(), F.struct(F.lit(1).alias("copy"), F.col("_to").alias("at"))))))
        .select(*rows.columns, "_key", F.inline("_to"))
        .repartition("at")
        .withColumns(add or {})
    )
    tie = F.xxhash64(*rows.columns)
    order = Window.partitionBy("at").orderBy("copy", F.desc("_key"), tie)
    follows = dealt.withColumns({name: F.lead(c).over(order) for name, c in carry.items()})
    return follows.where("copy = 0").drop("copy", "at", "_key")


def _block(key: Column, limits: list[int], inner: int) -> Column:
    """Number of the block of a key, rising with it: the piece between two limits, cut evenly."""
    if not limits:
        return F.lit(0).cast("bigint")
    at = F.array(*(F.lit(x) for x in limits))
    piece = F.size(F.filter(at, lambda x: x <= key))
    low, high = F.get(at, piece - 1).cast("double"), F.get(at, piece).cast("double")
    share = F.floor((key.cast("double") - low) / (high - low) * inner)
    return (piece * inner + F.coalesce(F.least(share, F.lit(inner - 1)), F.lit(0))).cast("bigint")


def edited_likeness(documents: DataFrame, k: int = 5, window: int = 8) -> DataFrame:
    """Fingerprints of texts and of edited texts, and how like they are.

    The last third of a text gives way to as many first characters of the next document (by
    descending doc_id; the first follows the last). A null text counts as empty; two texts
    without words are alike (1), a text with and one without are not (0). An empty table gives
    an empty result; repeated rows are separate documents that follow each other.
    """
    own = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    add = {"chosen": winnow(F.col("text"), k, window)}
    rows = with_next(own, "doc_id", {"next_text": "text", "next_chosen": "chosen"}, add)
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = rows.withColumn("edited", edited).withColumn("edited_chosen", winnow(F.col("edited"), k, window))
    rows = rows.withColumns({c: hashes(F.col(c.replace("set", "chosen"))) for c in ("set", "edited_set", "next_set")})
    return rows.select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("chosen")).alias("fingerprint"),
        as_text(F.col("edited_chosen")).alias("edited_fingerprint"),
        likeness(F.col("set"), F.col("edited_set")).alias("near_edited"),
        likeness(F.col("set"), F.col("next_set")).alias("near_next"),
        F.size("chosen").cast("bigint").alias("n_chosen"),
    )
