"""Operator 13: importance resampling of documents towards a target distribution of hashed n-grams, in Spark SQL.

1. The n-grams of all documents and of all target texts are exploded and counted by bucket, crc32 modulo `buckets`; the
   counts are combined before they are shuffled, so a task sends a row for each bucket at most.
2. A bucket's gain is floor(1000 * ln(((t + 1) * (S + buckets)) / ((s + 1) * (T + buckets)))). The table of gains has
   `buckets` rows whatever the input, so it is broadcast.
3. Documents are exploded again, joined with the gains and summed by row, again combined before the shuffle: a row of a
   few numbers for each document.
4. score = weight + Gumbel noise from the id's SHA-256, so the highest scores are a draw without replacement with odds
   exp(weight / 1000). Documents with enough words are sorted by ranges; a rank is the number of rows in the partitions
   before and the place in its own.

Defined cases: a null or empty text has no words, no features and weight 0; repeated rows are documents of their own, with
equal scores, and are ranked by the order of rows after doc_id; a null doc_id counts as the text "null" and sorts first
in a tie; of a very long text the words are one array in one row; an empty table, of documents or of targets, has counts
of 0. Only doc_id and text are read, so other columns' names cannot clash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, text_or_empty

#: Words: digits, letters a to z and all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of the text with A-Z in lower case."""
    return F.regexp_extract_all(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD), F.lit(0))


def ngrams(words: Column, shortest: int, longest: int) -> Column:
    """All runs of so many consecutive words, joined by one space."""
    parts, runs = [], words
    for n in range(1, longest + 1):
        if n > 1:  # no lambda refers to the words, which would be split again for each of them
            joined = F.zip_with(runs, F.slice(words, n, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
            runs = F.slice(joined, 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))
        if n >= shortest:
            parts.append(runs)
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _exploded(texts: DataFrame, keys: list[Column], grams: tuple[int, int], buckets: int) -> DataFrame:
    """Keys, number of words, and a bucket for each feature; one row without a bucket where there is no feature."""
    worded = texts.select(*keys, words_of(text_or_empty()).alias("words"))
    names = [c for c in worded.columns if c != "words"]
    sized = worded.select(*names, F.size("words").alias("n_words"), ngrams(F.col("words"), *grams).alias("features"))
    features = sized.select(*names, "n_words", F.explode_outer("features").alias("feature"))  # without the arrays beside it
    return features.select(*names, "n_words", (F.crc32(F.col("feature").cast("binary")) % buckets).cast("int").alias("bucket"))


def bucket_counts(texts: DataFrame, grams: tuple[int, int] = (1, 1), buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many features of the texts fall into each bucket that has one."""
    return _exploded(texts, [], grams, buckets).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gain_table(documents: DataFrame, target: DataFrame, grams: tuple[int, int] = (1, 1), buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) for each of the buckets."""
    own, wanted = materialise(bucket_counts(documents, grams, buckets)), materialise(bucket_counts(target, grams, buckets))
    total = lambda t, name: t.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias(name))
    every = documents.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(own.withColumnRenamed("n", "s"), "bucket", "left").join(wanted.withColumnRenamed("n", "t"), "bucket", "left")
    both = both.na.fill(0, ["s", "t"]).crossJoin(total(own, "S_all")).crossJoin(total(wanted, "T_all"))  # with one row each
    more, size = F.lit(1.0), F.lit(float(buckets))
    ratio = (F.col("t") + more) * (F.col("S_all") + size) / ((F.col("s") + more) * (F.col("T_all") + size))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def gumbel_noise(doc_id: Column, seed: str) -> Column:
    """floor(-1000 * ln(-ln(u))) with u in (0, 1) from the first 32 bits of the SHA-256 of seed:doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256)
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((number + F.lit(0.5)) / F.lit(4294967296.0))))


def score_documents(documents: DataFrame, target: DataFrame, grams: tuple[int, int] = (1, 1), buckets: int = 10_000, seed: str = "2024") -> DataFrame:
    """One row per document: row number, doc_id, n_words, n_features, weight and score."""
    gains = gain_table(documents, target, grams, buckets)
    keys = [F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id")]
    features = _exploded(documents, keys, grams, buckets).join(F.broadcast(gains), "bucket", "left")
    summed = features.groupBy("row", "doc_id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    return summed.withColumn("score", F.col("weight") + gumbel_noise(F.col("doc_id"), seed))


def partition_ranks(rows: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """Number rows from 1 in this order: sorted by ranges, each partition's rows after those of the partitions before."""
    place = F.monotonically_increasing_id()
    placed = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place))
    sizes = placed.groupBy(F.shiftrightunsigned("_place", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = placed.withColumn("_part", F.shiftrightunsigned("_place", 33)).join(F.broadcast(offsets), "_part")
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn(rank, F.col("_before") + inside + 1).drop("_place", "_part", "_before")


def resample(documents: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, grams: tuple[int, int] = (1, 1), buckets: int = 10_000, seed: str = "2024") -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, and its rank if it is among the `percent` drawn of the
    documents with at least `least_words` words."""
    scored = materialise(score_documents(documents, target, grams, buckets, seed))
    eligible = F.col("n_words") >= least_words
    ranked = partition_ranks(scored.where(eligible), [F.desc("score"), F.asc("doc_id"), F.asc("row")])
    drawn = scored.where(eligible).agg(F.floor(F.count(F.lit(1)) * percent / 100).alias("drawn"))
    ranked = ranked.crossJoin(drawn).withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")))  # with one row
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*out).unionByName(scored.where(~eligible).withColumn("rank", F.lit(None).cast("long")).select(*out))


def draw(documents: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents with their own columns, whatever their names; rows that share a doc_id come together."""
    chosen = resample(documents, target, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    whole = documents.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    return whole.join(chosen, F.col("_id").eqNullSafe(F.col("_drawn")), "left_semi").select("_row.*")
