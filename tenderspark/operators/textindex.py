"""Full-text index of a column as Parquet tables in key buckets, and the searches that read only the buckets they need.

- postings (bucket, token, doc, positions, length): a token's rows lie in one bucket, by its first three letters, and are
  sorted, so a token, and a wildcard or beginning of three letters or more, reads one bucket and few row groups of it.
- terms (bucket, token, n_docs): document frequencies.
- deletions (bucket, key, token, n_docs): a row for each string that a token becomes when up to two of its letters are left
  out. Two words within e edits share such a string with at most e letters left out of each, so the tokens near a word are
  looked up by the word's own strings and then compared by `levenshtein`; no other token is read.
- totals: the number of documents and tokens.

Rows are dealt to files by ranges of (bucket, token, doc), so a token that most documents hold is spread over many tasks.
Documents without a token are not in the index. The tables are immutable: a changed corpus gets a new folder.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import GRAMS, classify, fold_text, fuzzy_edits, near_prefix, prefix, query_words, tokens, wildcard_pattern

#: Letters by which a token is dealt to a bucket: those that a wildcard must begin with.
STEM = 3
#: BM25: saturation of a term's frequency, and weight of a document's length.
K1, B = 1.2, 0.75
#: Boost of a phrase in a compound query, and the constant score of a beginning; fixed values.
PHRASE_BOOST, BEGINNING = 3.0, 1.0


def _crc(text: str) -> int:
    return zlib.crc32(text.encode())


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(key, F.lit(buckets)).cast("int")


def _stem_bucket(token: Column, buckets: int) -> Column:
    return _bucket(F.crc32(F.substring(token, 1, STEM).cast("binary")), buckets)


def _one_left_out(token: Column) -> Column:
    at = F.when(F.length(token) > 0, F.sequence(F.lit(1), F.length(token))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat(F.substr(token, F.lit(1), i - 1), F.substr(token, i + 1, F.length(token))))


def left_out(token: Column, edits: int) -> Column:
    """The token and what it becomes without up to `edits` (1 or 2) of its letters."""
    one = _one_left_out(token)
    two = [F.flatten(F.transform(one, _one_left_out))] if edits > 1 else []
    return F.array_distinct(F.concat(F.array(token), one, *two))


def left_out_of_text(word: str, edits: int) -> set[str]:
    now, out = {word}, {word}
    for _ in range(edits):
        now = {w[:i] + w[i + 1 :] for w in now for i in range(len(w))}
        out |= now
    return out


def deletion_rows(strings: DataFrame, column: str, edits: Column | int, buckets: int) -> DataFrame:
    """(bucket, key, ...) of strings: the checksum of each string that deletions make of them, with their own columns."""
    kinds = left_out(F.col(column), edits) if isinstance(edits, int) else F.when(edits > 1, left_out(F.col(column), 2)).otherwise(left_out(F.col(column), 1))
    rows = strings.select(F.explode(kinds).alias("_made"), "*").withColumn("key", F.crc32(F.col("_made").cast("binary")))
    return rows.drop("_made").distinct().withColumn("bucket", _bucket(F.col("key"), buckets))


def near_strings(table: DataFrame, column: str, word: str, edits: int, buckets: int) -> DataFrame:
    """Rows of a deletions table whose string is within `edits` of the word, once each, with the number of edits."""
    keys = sorted({_crc(w) for w in left_out_of_text(word, edits)})
    found = table.where(F.col("bucket").isin(sorted({k % buckets for k in keys})) & F.col("key").isin(keys))
    rest = [c for c in table.columns if c not in ("bucket", "key")]
    return found.select(*rest).distinct().withColumn("edits", F.levenshtein(column, F.lit(word), edits)).where("edits >= 0")


def _write(rows: DataFrame, folder: str, *order: str) -> None:
    dealt = rows.repartitionByRange("bucket", *order).sortWithinPartitions("bucket", *order)
    dealt.write.partitionBy("bucket").mode("overwrite").parquet(folder)


class TextIndex:
    """Searches over an index that `build` has written. Results name documents by `doc`."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    @classmethod
    def build(cls, documents: DataFrame, id_col: str, text_col: str, folder: str, buckets: int = 64) -> TextIndex:
        spark = documents.sparkSession
        split = documents.select(F.col(id_col).cast("long").alias("doc"), tokens(text_col).alias("words"))
        sized = split.select("doc", F.size("words").alias("length"), "words").where("doc IS NOT NULL AND length > 0")
        placed = sized.select("doc", "length", F.posexplode("words").alias("at", "token"))
        rows = placed.groupBy("doc", "token").agg(F.sort_array(F.collect_list("at")).alias("positions"), F.first("length").alias("length"))
        _write(rows.withColumn("bucket", _stem_bucket(F.col("token"), buckets)), f"{folder}/postings", "token", "doc")
        index = cls(spark, folder, buckets)
        _write(index.postings().groupBy("bucket", "token").agg(F.count(F.lit(1)).alias("n_docs")), f"{folder}/terms", "token")
        # two edits are asked for from six letters on, so of tokens from four letters on
        near = deletion_rows(index.terms().select("token", "n_docs"), "token", F.when(F.length("token") > 3, 2).otherwise(1), buckets)
        _write(near, f"{folder}/deletions", "key")
        sized.agg(F.count(F.lit(1)).alias("docs"), F.sum("length").alias("words")).write.mode("overwrite").parquet(f"{folder}/totals")
        return index

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def postings(self) -> DataFrame:
        return self._read("postings", "bucket int, token string, doc long, positions array<int>, length int")

    def terms(self) -> DataFrame:
        return self._read("terms", "bucket int, token string, n_docs long")

    def deletions(self) -> DataFrame:
        return self._read("deletions", "bucket int, key long, token string, n_docs long")

    def _totals(self) -> tuple[int, float]:
        row = self._read("totals", "docs long, words long").first()
        return row["docs"], (row["words"] or 0) / max(row["docs"], 1)

    def _of_words(self, table: DataFrame, words: list[str]) -> DataFrame:
        buckets = sorted({_crc(w[:STEM]) % self.buckets for w in words})
        return table.where(F.col("bucket").isin(buckets) & F.col("token").isin(sorted(set(words))))

    def _beginning(self, beginning: str) -> DataFrame:
        """Postings of tokens with this beginning: one bucket, or all if it is shorter than the letters that deal them."""
        rows = self.postings().where(F.col("token").startswith(beginning))
        return rows.where(F.col("bucket") == _crc(beginning[:STEM]) % self.buckets) if len(beginning) >= STEM else rows

    def phrase(self, query: str) -> DataFrame:
        """(doc, times, length) of documents that hold the words one after the other."""
        words = query_words(query)
        if not words:
            return self.postings().select("doc", F.lit(0).cast("long").alias("times"), "length").limit(0)
        places = {w: [i for i, x in enumerate(words) if x == w] for w in words}
        offsets = F.create_map(*[x for w, at in places.items() for x in (F.lit(w), F.array(*map(F.lit, at)))])
        at = self._of_words(self.postings(), words).select("doc", "length", "token", F.explode("positions").alias("at"))
        starts = at.select("doc", "length", F.col("at"), F.explode(F.element_at(offsets, F.col("token"))).alias("offset"))
        whole = starts.groupBy("doc", "length", (F.col("at") - F.col("offset")).alias("start")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(words))
        return whole.groupBy("doc", "length").agg(F.count(F.lit(1)).alias("times")).select("doc", "times", "length")

    def wildcard(self, query: str) -> DataFrame:
        """(doc) of documents with a token that the whole pattern matches."""
        q = fold_text(query.strip())
        return self._beginning(re.split(r"[*?]", q, maxsplit=1)[0]).where(F.col("token").rlike(wildcard_pattern(q))).select("doc").distinct()

    def beginning(self, query: str) -> DataFrame:
        """(doc) of documents with a token that begins with the query."""
        return self._beginning(fold_text(query.strip())).select("doc").distinct()

    def near_terms(self, query: str) -> DataFrame:
        """(word, token, edits, n_docs): the tokens within one edit of a word of the query, two from six letters on."""
        out = self.terms().select(F.lit("").alias("word"), "token", F.lit(0).alias("edits"), "n_docs").limit(0)
        for w in sorted(set(query_words(query))):
            near = near_strings(self.deletions(), "token", w, fuzzy_edits(w), self.buckets)
            out = out.unionByName(near.withColumn("word", F.lit(w)))
        return out

    def fuzzy(self, query: str) -> DataFrame:
        """(doc, word, token, edits, n_docs, times, length). The tokens near some words are few, whatever the corpus; they
        prune the postings' buckets when the search runs."""
        found = self.near_terms(query).withColumn("bucket", _stem_bucket(F.col("token"), self.buckets))
        return self.postings().join(F.broadcast(found), ["bucket", "token"]).select("doc", "word", "token", "edits", "n_docs", F.size("positions").alias("times"), "length")

    def matches(self, query: str) -> DataFrame:
        """(doc) of the documents that the query string stands for, as `functions.text.matches` says by a scan."""
        kind, q = classify(query), query.strip()
        if kind == "phrase":
            return self.phrase(q[1:-1]).select("doc")
        if kind == "wildcard":
            return self.wildcard(q)
        if kind == "exists":
            raise ValueError("an empty query needs no index")
        return self.phrase(q).select("doc").unionByName(self.fuzzy(q).select("doc")).unionByName(self.beginning(q)).distinct()

    def relevance(self, query: str, k: int = 20) -> DataFrame:
        """(doc, score) of the k best: BM25 of the phrase, three times in a compound query, of the tokens near each word,
        less for each edit, and a constant for a beginning. Scores are rounded to 9 digits, so that ties are ties."""
        kind, q = classify(query), query.strip()
        docs, average = self._totals()

        def idf(n: Column) -> Column:
            return F.log(1 + (docs - n + 0.5) / (n + 0.5))

        def saturated(times: Column) -> Column:
            return times / (times + K1 * (1 - B + B * F.col("length") / F.lit(average)))

        def of_phrase(text: str, boost: float) -> DataFrame:
            words = query_words(text)
            weights = F.create_map(*[x for w in set(words) for x in (F.lit(w), F.lit(words.count(w)))]) if words else F.lit(None).cast("map<string,int>")
            whole = self._of_words(self.terms(), words).agg(F.sum(idf(F.col("n_docs")) * F.element_at(weights, F.col("token"))).alias("idf"))
            return self.phrase(text).crossJoin(F.broadcast(whole)).select("doc", (boost * F.col("idf") * saturated(F.col("times"))).alias("score"))

        if kind == "exists":
            raise ValueError("an empty query has no relevance")
        if kind == "wildcard":
            parts = self.wildcard(q).select("doc", F.lit(BEGINNING).alias("score"))
        elif kind == "phrase":
            parts = of_phrase(q[1:-1], 1.0)
        else:
            close = 1 - F.col("edits") / F.least(F.length("token"), F.length("word"))
            near = self.fuzzy(q).select("doc", (close * idf(F.col("n_docs")) * saturated(F.col("times"))).alias("score"))
            parts = of_phrase(q, PHRASE_BOOST).unionByName(near).unionByName(self.beginning(q).select("doc", F.lit(BEGINNING).alias("score")))
        summed = parts.groupBy("doc").agg(F.round(F.sum("score"), 9).alias("score"))
        return summed.orderBy(F.desc("score"), "doc").limit(k)


class Autocompletion:
    """Labels by the beginnings, of 2 to 15 letters, of their words: (bucket, gram, kind, label, n), n being the rows that
    have the label; and the deletions of one letter of all beginnings, for words with a typing error."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    @classmethod
    def build(cls, parts: dict[str, DataFrame], folder: str, buckets: int = 64) -> Autocompletion:
        labels = None
        for kind, df in parts.items():
            one = df.where("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
            labels = one if labels is None else labels.unionByName(one)
        words = labels.select("kind", "label", "n", F.explode(F.array_distinct(tokens("label"))).alias("word")).where(F.length("word") >= GRAMS[0])
        ends = F.sequence(F.lit(GRAMS[0]), F.least(F.length("word"), F.lit(GRAMS[1])))
        grams = words.select("kind", "label", "n", F.explode(F.transform(ends, lambda i: F.substr(F.col("word"), F.lit(1), i))).alias("gram")).distinct()
        _write(grams.withColumn("bucket", _bucket(F.crc32(F.col("gram").cast("binary")), buckets)), f"{folder}/grams", "gram", "kind", "label")
        found = cls(labels.sparkSession, folder, buckets)
        _write(deletion_rows(found.grams().select("gram").distinct(), "gram", 1, buckets), f"{folder}/near", "key")
        return found

    def grams(self) -> DataFrame:
        return self.spark.read.schema("bucket int, gram string, kind string, label string, n long").parquet(f"{self.folder}/grams")

    def complete(self, query: str, k: int = 5, edits: int = 0) -> DataFrame:
        """(kind, label, n) of each kind's first k labels with a word of this beginning; with one edit allowed, of labels
        that have such a word for each word of the query. Queries of under two letters have no result."""
        words = sorted({w[: GRAMS[1]] for w in query_words(query)}) if edits else [fold_text(query.strip())[: GRAMS[1]]]
        hits = None
        for w in words:
            if edits:
                near = near_strings(self.spark.read.schema("bucket int, key long, gram string").parquet(f"{self.folder}/near"), "gram", w, edits, self.buckets)
                near = near.select("gram", _bucket(F.crc32(F.col("gram").cast("binary")), self.buckets).alias("bucket"))
                rows = self.grams().join(F.broadcast(near), ["bucket", "gram"])  # the beginnings near one word
            else:
                rows = self.grams().where((F.col("bucket") == _crc(w) % self.buckets) & (F.col("gram") == w))
            one = rows.select("kind", "label", "n").distinct()
            hits = one if hits is None else hits.join(one, ["kind", "label", "n"], "left_semi")
        if hits is None:
            return self.grams().select("kind", "label", "n").limit(0)
        exact = near_prefix("label", query) if edits else prefix("label", query)
        rank = F.row_number().over(Window.partitionBy("kind").orderBy("label"))  # cut to k in each task before the shuffle
        return hits.where(exact).withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")
