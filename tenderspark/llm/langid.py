"""Operator 6: language identification by multinomial naive Bayes over hashed character n-grams.

Training counts hashed 1- to 3-grams of the lower-cased whole texts in each language. Every task adds up its own counts
per language and bucket before they are shuffled, so a language with a third of all rows is as cheap as others. The
log-probability matrix, languages x buckets, is of a bounded size: buckets are halved until it fits `most_bytes`, and the
driver gathers its counts, about four times as much. It is broadcast; texts are then scored by batches in numpy, summing
the rows of the matrix that their n-grams select. N-grams lie within one text, so a text's scores depend on nothing but
itself, however rows are dealt to tasks and batches; blocks of a long text overlap, so none is left out.

Defined cases: texts that are null or have no letter (`str.isalpha`) get `und` and score 0; nothing is learned from rows
without a language; if no language can be learned at all, every text gets `und`; ties go to the language first in
alphabetical order; repeated rows count each; a text of any length is lower-cased whole, goes by blocks and is used
whole; an empty table gives an empty result. Only the named columns are read, so other columns' names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64

UNKNOWN = "und"
#: Holds all letters, and a few number signs that `has_letter` leaves out.
_LETTER = re.compile(r"[^\W\d_]")
_BLOCK = 1 << 18


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def ngram_buckets(points: np.ndarray, orders: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Hash buckets of the character n-grams that begin at each place, for n from 1 to `orders`."""
    with np.errstate(over="ignore"):
        value = np.zeros(len(points), np.uint64)
        wide = points.astype(np.uint64) + np.uint64(1)
        for n in range(1, orders + 1):
            if len(points) < n:
                return
            value = (value[: len(points) - n + 1] * np.uint64(0x100000001B3)) + wide[n - 1 :] * np.uint64(0x9E3779B97F4A7C15)
            yield n, (mix64(value + np.uint64(n)) & np.uint64(buckets - 1)).astype(np.int32)


def text_ngrams(texts: list[str], orders: int, buckets: int, block: int = _BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all n-grams of the lower-cased texts, and the text's number of each, which rises; by blocks of texts,
    or of one longer text. No n-gram reaches from one text or block into the next."""
    at = 0
    while at < len(texts):
        to, lowered, size = at, [], 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= block):
            lowered.append(texts[to].lower())
            size += len(texts[to])
            to += 1
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) for t in lowered])
        for k in range(0, len(points), block if to == at + 1 else max(len(points), 1)):
            # a long text's block reads on by orders - 1 characters, for the n-grams that begin in it
            own = min(block, len(points) - k) if to == at + 1 else len(points)
            some = points[k : k + own + orders - 1]
            number = np.repeat(np.arange(at, to), lengths) if to > at + 1 else np.full(len(some), at)
            stop = np.repeat(np.cumsum(lengths), lengths) if to > at + 1 else np.full(len(some), len(some))
            for n, found in ngram_buckets(some, orders, buckets):
                begin = np.arange(min(len(found), own))
                inside = begin + n <= stop[begin]
                yield found[begin][inside], number[begin][inside]
        at = to


class Model:
    """Languages in order, and the matrix of log-probabilities, buckets x languages."""

    def __init__(self, languages: list[str], matrix: np.ndarray, prior: np.ndarray, orders: int):
        self.languages, self.matrix, self.prior, self.orders = languages, matrix, prior, orders

    def scores(self, texts: list[str], block: int = _BLOCK) -> np.ndarray:
        out = np.tile(self.prior, (len(texts), 1))
        for found, number in text_ngrams(texts, self.orders, len(self.matrix), block):
            if len(found):
                starts = np.flatnonzero(np.diff(number, prepend=-1))
                out[number[starts]] += np.add.reduceat(self.matrix[found], starts, axis=0)
        return out


def count_ngrams(df: DataFrame, lang: Column, text: Column, orders: int, buckets: int) -> DataFrame:
    """(lang, bucket, n): occurrences over the whole texts, added up in each task first; bucket -1 counts texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, counts in held.items():
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * (len(some) + 1), pa.string()), pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(counts[some], rows[name]), pa.int64())], names=["lang", "bucket", "n"])
            held.clear()
            rows.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            by: dict[str, list[str]] = {}
            for name, text in zip(langs, texts):
                by.setdefault(name, []).append(text)
            for name, some in by.items():
                if name not in held and len(held) >= 64:
                    yield from flush()
                counts = held.setdefault(name, np.zeros(buckets, np.int64))
                rows[name] = rows.get(name, 0) + len(some)
                for found, _ in text_ngrams(some, orders, buckets):
                    counts += np.bincount(found, minlength=buckets)
        yield from flush()

    narrow = df.select(lang.cast("string").alias("lang"), text.cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    return narrow.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(df: DataFrame, lang: Column, text: Column, orders: int = 3, buckets: int = 1 << 15, smoothing: float = 0.5, most_bytes: int = 256 << 20) -> Model | None:
    """Fit on all rows given; the driver gets languages x buckets counts, at most `most_bytes` (1024 languages), and no
    texts. The number of buckets does not depend on the languages; more of them than that are an error."""
    languages = sorted(r[0] for r in df.select(lang.cast("string").alias("lang")).where("lang IS NOT NULL").distinct().limit(most_bytes // (8 * buckets) + 1).collect())
    if buckets * len(languages) * 8 > most_bytes:
        raise ValueError(f"more languages than {most_bytes} bytes hold")
    if not languages:
        return None
    number = df.sparkSession.createDataFrame(list(enumerate(languages)), "number int, lang string")
    counted = count_ngrams(df, lang, text, orders, buckets).join(F.broadcast(number), "lang").select("number", "bucket", "n").toArrow()
    column, bucket, n = (counted.column(i).to_numpy() for i in range(3))
    matrix, prior = np.full((buckets, len(languages)), smoothing), np.zeros(len(languages))
    texts = bucket < 0
    matrix[bucket[~texts], column[~texts]] += n[~texts]
    prior[column[texts]] = n[texts]
    some = np.flatnonzero(prior)  # languages with no text but null have nothing to be learned from
    if not len(some):
        return None
    return Model([languages[i] for i in some], np.log(matrix / matrix.sum(axis=0))[:, some], np.log(prior[some] / prior.sum()), orders)


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: the likeliest language and its posterior probability."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            known = np.array([m is not None and has_letter(t) for t in texts], bool)
            names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if known.any():
                s = m.scores([t for t, k in zip(texts, known) if k])
                best = s.argmax(axis=1)
                names[known] = np.array(m.languages, object)[best]
                scores[known] = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify_languages(documents: DataFrame, held_out: Column, **options) -> DataFrame:
    """Learn from the rows that are not held out and predict all."""
    model = train(documents.where(~held_out), F.col("lang"), F.col("text"), **options)
    return predict(documents, model).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")
