"""Operator 4: rendezvous hashing of stable record keys over weighted shards, with DataFrame functions only.

For a key and each shard, u in (0, 1) comes from the MD5 of "key/shard" and the shard with the largest
-weight / ln(u) takes the record. A shard more or less leaves every other score as it was, so one more
shard takes records only into itself, and a share of weight / sum(weights) of them.

Slots number a shard's rows in two levels: by salts, which are taken from all columns that order the rows and are of a fixed
number, and within them; so rows that share a key, or have none, are spread as far as their texts differ.
Rows that are equal in all columns are counted before they are shuffled and numbered as one, so a record that makes a
third of all rows is one row until it is given out again.

Defined cases: a null key counts as the text "null"; a null text has no bytes and CRC-32 0; records with equal
keys share a shard, each row with a slot of its own; equal texts are no group here, as the key law lets only
key and shard count decide; of a very long text only its length and checksum are kept; only doc_id and text are read, so
other columns' names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hexadecimal digits of the MD5 that make u; 52 bits fit a double exactly.
_DIGITS = 13
#: Salts of slots: shards x salts counts are broadcast.
SALTS = 1024
#: Equal rows are given out by so many at a time.
_RUN = 100_000


def rendezvous_score(key: Column, shard: int, weight: float) -> Column:
    digest = F.md5(F.concat(key, F.lit(f"/{shard}")).cast("binary"))
    number = F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double")
    return F.lit(-float(weight)) / F.log((number + F.lit(0.5)) / F.lit(float(16**_DIGITS)))


def _largest(scores: Sequence[Column], first: int = 0) -> Column:
    """The struct (score, -shard) with the largest score, the lowest shard at a tie."""
    return F.greatest(*[F.struct(s.alias("score"), F.lit(-(first + i)).alias("minus")) for i, s in enumerate(scores)]) if len(scores) > 1 else F.struct(scores[0].alias("score"), F.lit(-first).alias("minus"))


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], grown_weight: float | None = None, shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """Add the shard of each row and, given the weight of one more shard, the shard with that one added."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights: one positive number for each shard")
    k = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    rest = df.select("*", _largest([rendezvous_score(k, i, w) for i, w in enumerate(weights)]).alias("__best"))
    out = rest.withColumn(shard, (-F.col("__best.minus")).cast("int"))
    if grown_weight is not None:
        more = rendezvous_score(k, len(weights), grown_weight)
        out = out.withColumn(grown, F.when(more > F.col("__best.score"), F.lit(len(weights))).otherwise(F.col(shard)).cast("int"))
    return out.drop("__best")


def slot_salt(order: Sequence[str], salts: int = SALTS) -> Column:
    text = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in order])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 4), 16, 10).cast("int") % salts


def add_slots(df: DataFrame, shard: str, order: Sequence[str], slot: str = "slot", salts: int = SALTS) -> DataFrame:
    """Number the rows of each shard from 0 without a gap, by the salt of the columns in `order` and then by them, nulls first.

    Rows are numbered within (shard, salt); the salts' counts, shards x salts rows, give the offsets. No task sees
    a whole shard. Rows that are equal in all columns are interchangeable and are one counted row until the end.
    """
    counted = df.withColumn("__salt", slot_salt(order, salts)).groupBy(*df.columns, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    counts = counted.groupBy(shard, "__salt").agg(F.sum("__n").alias("__n"))
    before = Window.partitionBy(shard).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inner = Window.partitionBy(shard, "__salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = counted.withColumn("__row", F.coalesce(F.sum("__n").over(inner), F.lit(0)))
    # at most shards x salts rows, whatever the input
    placed = numbered.join(F.broadcast(offsets), [shard, "__salt"]).withColumn("__first", F.col("__before") + F.col("__row"))
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / _RUN)))
    begin = F.col("__first") + F.col("__run") * _RUN
    slots = F.explode(F.sequence(begin, F.least(begin + _RUN, F.col("__first") + F.col("__n")) - 1))
    return placed.withColumn("__run", run).select(*df.columns, slots.alias(slot))


def shard_documents(documents: DataFrame, shards: int = 40, weights: Sequence[float] | None = None) -> DataFrame:
    """One row per document: its size, CRC-32, shard, slot, and its shard were there one more."""
    weights = list(weights or [1.0] * shards)
    sized = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length(F.col("text")), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = assign_shards(sized, "doc_id", weights, grown_weight=sum(weights) / len(weights))
    return add_slots(placed, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
