"""Operator 13: winnowed fingerprints of texts, by SQL functions alone.

The units of a text are its words, lower-cased; a word of over 16 characters counts as several. Each
unit is hashed once, and the hash of each ``k`` units is made of theirs as the window rolls on. Of each ``w``
neighbouring hashes the smallest is chosen, of equal ones the rightmost, so that any ``w + k - 1``
units that two texts share give both a common hash, and nothing shorter than ``k`` units does. A choice
is one whole number: the hash's 31 bits above 2^32 - 1 - the position, whose order is the one wanted.

Null text counts as empty. A text without units has an empty fingerprint, like only to another empty one;
one of fewer than ``k`` units has one hash, of all of them. Fewer than ``w`` hashes are one window.
Repeated rows are returned each, and count once where documents follow each other. Null ids come
last. No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import materialise

#: Units of a hash and hashes of a window: matches of five units are certain.
K, W = 2, 4
UNIT = r"\\S{1,16}"


def choices(text: Column, k: int = K, w: int = W) -> Column:
    """The chosen hashes of a text with their positions, in the text's order, each as one bigint."""
    of_units = ", ".join(f"get(units, i + {n})" for n in range(k))
    window = ", ".join(f"get(hashes, i + {n})" for n in range(w)) if w > 1 else "get(hashes, i), NULL"
    rolled = f"transform(sequence(0, greatest(size(units) - {k}, 0)), i -> shiftleft(xxhash64({of_units}) & 2147483647L, 32) + (4294967295L - i))"
    chosen = f"array_distinct(transform(sequence(0, greatest(size(hashes) - {w}, 0)), i -> least({window})))"
    # an array of one element names a value that is to be computed once
    return F.expr(
        f"""transform(array(transform(regexp_extract_all(lower(_text), '{UNIT}', 0), unit -> xxhash64(unit))), units ->
            if(size(units) = 0, CAST(array() AS ARRAY<BIGINT>), transform(array({rolled}), hashes -> {chosen})[0]))[0]"""
    )


def hashes(chosen: Column) -> Column:
    return F.transform(chosen, lambda x: F.shiftright(x, 32).cast("int"))


def positions(chosen: Column) -> Column:
    return F.transform(chosen, lambda x: (F.lit(4294967295) - x.bitwiseAND(F.lit(4294967295))).cast("int"))


def spelt(chosen: Column) -> Column:
    """The hashes in the text's order, hexadecimal, with points between them."""
    return F.array_join(F.transform(chosen, lambda x: F.lower(F.hex(F.shiftright(x, 32)))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two arrays; 1 of two empty ones."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / every)


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars, fingerprint: array of (hash, position), the position counted in units."""
    texts = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    made = texts.select("doc_id", F.length("_text").cast("bigint").alias("n_chars"), choices(F.col("_text"), k, w).alias("_chosen"))
    pairs = F.arrays_zip(hashes(F.col("_chosen")).alias("hash"), positions(F.col("_chosen")).alias("position"))
    return made.select("doc_id", "n_chars", pairs.alias("fingerprint"))


def followers(keyed: DataFrame) -> tuple[DataFrame, bool]:
    """(row, doc_id, n_chars, after) of distinct rows, ``after`` being the next by descending id; whether rows repeat.

    Rows without texts are put in order by ranges. What crosses from one range to the next is one row a range.
    """
    own = keyed.groupBy("row", "doc_id").agg(F.max(F.length("_text")).cast("bigint").alias("n_chars"), F.count("*").alias("times"))
    own = materialise(own, "fingerprint-rows")
    down = (F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("down"), "row")
    dealt = own.select("*", *down[:2]).repartitionByRange("none", "down", "row")
    dealt = materialise(dealt.withColumn("range", F.spark_partition_id()), "fingerprint-order")
    inside = Window.partitionBy("range").orderBy("none", "down", "row")
    firsts = dealt.groupBy("range").agg(F.min(F.struct("none", "down", "row")).alias("first"))
    # ranges are as few as partitions
    beyond = F.lead("first").over(Window.orderBy("range"))
    start = F.min("first").over(Window.partitionBy(F.lit(0)))
    firsts = firsts.select("range", F.coalesce(beyond, start)["row"].alias("beyond"))
    found = dealt.withColumn("after", F.lead("row").over(inside)).join(F.broadcast(firsts), "range")
    return found.select("row", "doc_id", "n_chars", F.coalesce("after", "beyond").alias("after")), not own.filter("times > 1").isEmpty()


def edited_likeness(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars, edited, chosen, edited_chosen, near_edited, near_next of each row.

    ``edited``: the text whose last third (rounded down, in code points) gives way to as many of
    the first of the next document by descending id, the first document following the last.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.concat_ws(":", F.col("doc_id").cast("bigint").cast("string"), F.xxhash64(text).cast("string"))
    keyed = docs.select(row.alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("_text"))
    order, repeated = followers(keyed)
    order = materialise(order, "fingerprint-followers")
    # both joins take the texts dealt in the same way, so they are shuffled once
    texts = keyed.select("row", "_text")
    to = order.select(F.col("after").alias("row"), F.col("row").alias("to"), "doc_id", "n_chars", F.floor(F.col("n_chars") / 3).cast("int").alias("third"))
    sent = texts.join(to, "row").select(F.col("to").alias("row"), "doc_id", "n_chars", "third", F.substring("_text", F.lit(1), F.col("third")).alias("begin"), hashes(choices(F.col("_text"), k, w)).alias("_next"))
    if repeated:
        sent = sent.dropDuplicates(["row"])
    made = texts.join(sent, "row").withColumn("edited", F.concat(F.substring("_text", F.lit(1), (F.col("n_chars") - F.col("third")).cast("int")), "begin"))
    chosen = made.select("doc_id", "n_chars", "edited", "_next", choices(F.col("_text"), k, w).alias("chosen"), F.col("edited").alias("_text"))
    both = chosen.select("doc_id", "n_chars", "edited", "_next", "chosen", choices(F.col("_text"), k, w).alias("edited_chosen"))
    own = hashes(F.col("chosen"))
    return both.select("doc_id", "n_chars", "edited", "chosen", "edited_chosen", likeness(own, hashes(F.col("edited_chosen"))).alias("near_edited"), likeness(own, F.col("_next")).alias("near_next"))
