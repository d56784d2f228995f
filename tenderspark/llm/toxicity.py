"""Operator 8: toxicity by a factorization machine over hashed terms.

Terms are the distinct lower-cased words of a whole text and the words' beginnings of 3 to 6 bytes, hashed; what comes
twice or more, and what makes a hundredth of the words, are terms too. The machine adds to the linear weights of its
terms the inner products of the terms' factor vectors, so it learns pairs such as an insult with a group's mention, of
which neither tells alone. It is fitted in numpy on a bounded sample: of each class at most `sample` labelled rows and
`sample_bytes` of text, those of the smallest id hashes, weighted back to the classes' sizes. The ids of the sample
(bounded) are broadcast to pick its texts, so that texts are not shuffled; one task gets the sample's terms and fits, and
the driver only passes on the weights, buckets x (factors + 1) floats. Scoring runs over all rows in batches of numpy.

Defined cases: a null or empty text has no terms and gets the share of toxic labels as its score; rows without a label
or an id are not learned from; repeated labels of an id count as one, toxic if any is; with no label of one class, the
score is the share of toxic labels (0.0 with none); a text of any length is used whole; an empty table gives an empty
result. Only the named columns are read, so other columns' names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hash_spans, list_array, mix64, slices, string_buffers, text_or_empty

BUCKETS = 1 << 18
_PREFIXES = (3, 4, 5, 6)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def term_buckets(raw: np.ndarray, off: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct term buckets of some consecutive lower-cased texts, joined, and how many each text has."""
    raw, off = raw[off[0] : off[-1]], off - off[0]
    inside = np.concatenate([[False], _WORD[raw], [False]])
    cut = np.zeros(len(raw) + 1, bool)
    cut[off] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    row = np.searchsorted(off, starts, "right") - 1
    parts, rows = [hash_spans(raw, starts, ends)], [row]
    for i, p in enumerate(_PREFIXES, 1):
        long = ends - starts > p
        parts.append(hash_spans(raw, starts[long], starts[long] + p) + np.uint64(i))
        rows.append(row[long])
    key = np.concatenate(rows).astype(np.int64) * buckets + (np.concatenate(parts) % np.uint64(buckets)).astype(np.int64)
    key, times = np.unique(key, return_counts=True)
    words = np.bincount(row, minlength=len(off) - 1)
    often = times >= 2
    dense = often & (times * 100 >= words[key // buckets])
    again = [key[some] // buckets * buckets + (mix64((key[some] % buckets).astype(np.uint64) + np.uint64(salt)) % np.uint64(buckets)).astype(np.int64) for some, salt in ((often, 1 << 40), (dense, 1 << 41))]
    key = np.unique(np.concatenate([key, *again]))
    counts = np.bincount(key // buckets, minlength=len(off) - 1)
    return key % buckets, counts


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return string_buffers(pc.utf8_lower(column))


class Machine:
    """Bias, linear weights and factor vectors over term buckets; buckets unseen in training weigh nothing."""

    def __init__(self, buckets: int, factors: int, seed: int = 7):
        self.bias = np.float32(0)
        self.weight = np.zeros(buckets, np.float32)
        self.factor = np.random.default_rng(seed).normal(0, 0.01, (buckets, factors)).astype(np.float32)

    def scores(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probabilities of texts from their joined terms and how many each has."""
        margin = np.full(len(counts), float(self.bias))
        some = np.flatnonzero(counts)
        if len(some):
            starts = (np.cumsum(counts) - counts)[some]
            v = self.factor[terms].astype(np.float64)
            total = np.add.reduceat(v, starts, axis=0)
            squares = np.add.reduceat(np.einsum("ij,ij->i", v, v), starts)
            linear = np.add.reduceat(self.weight[terms].astype(np.float64), starts)
            margin[some] += linear + 0.5 * (np.einsum("ij,ij->i", total, total) - squares)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit_machine(terms: list[np.ndarray], y: np.ndarray, weight: np.ndarray, buckets: int = BUCKETS, factors: int = 4, epochs: int = 6, rate: float = 0.1, decay: float = 1e-2, least: int = 15, drop: float = 0.5, share: float = 0.1, seed: int = 7) -> Machine:
    """Logistic loss by AdaGrad, row by row; terms that fewer than `least` rows have are left out. Each visit to a row
    drops a share of its terms, so that none is relied on alone; the weights are scaled by what stays. The bias is not
    learned: a text without known terms gets the `share` of toxic labels as its score."""
    df = np.zeros(buckets, np.int64)
    for i in range(0, len(terms), 256):
        df += np.bincount(np.concatenate(terms[i : i + 256]), minlength=buckets)
    seen = df >= least
    machine = Machine(buckets, factors, seed)
    machine.factor[~seen] = 0
    machine.bias = np.float32(np.log(share / (1 - share)))
    gw, gv = np.full(buckets, 1.0, np.float32), np.full((buckets, factors), 1.0, np.float32)
    rows = [t[seen[t]] for t in terms]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            t = rows[i]
            t = t[rng.random(len(t)) >= drop]
            v = machine.factor[t]
            s = v.sum(axis=0)
            margin = machine.bias + machine.weight[t].sum() + 0.5 * (s @ s - np.einsum("ij,ij->", v, v))
            g = np.float32((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[i]) * weight[i])
            if abs(g) < 1e-4:
                continue
            dw = g + decay * machine.weight[t]
            gw[t] += dw * dw
            machine.weight[t] -= rate * dw / np.sqrt(gw[t])
            dv = g * (s - v) + decay * v
            gv[t] += dv * dv
            machine.factor[t] = v - rate * dv / np.sqrt(gv[t])
    machine.weight *= 1 - drop
    machine.factor *= 1 - drop
    return machine


def _terms_of(df: DataFrame, buckets: int) -> DataFrame:
    """(toxic, doc_id, terms) for the rows (toxic, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = _lowered(batch.column(2))
            for a, b in slices(off):
                terms, counts = term_buckets(raw, off[a : b + 1], buckets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), list_array(terms.astype(np.int32), counts, pa.int32())], names=["toxic", "doc_id", "terms"])

    return df.mapInArrow(run, "toxic int, doc_id long, terms array<int>")


def _fitted(sample: DataFrame, sizes: dict[int, int], buckets: int, options: dict) -> DataFrame:
    """One row (bias, weight, factor): the machine, fitted by one task on a sample (toxic, doc_id, terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        y = t.column(0).to_numpy().astype(np.float64)
        lists = [c.values.to_numpy()[x:z] for c in t.column(2).chunks for x, z in zip(c.offsets.to_numpy()[:-1].tolist(), c.offsets.to_numpy()[1:].tolist())]  # views
        share = np.array([sizes[0] / max((y == 0).sum(), 1), sizes[1] / max((y == 1).sum(), 1)])[y.astype(int)]
        # each class weighs as in the labels, but the rarer one a fifth of all at least
        total = np.array([share[y == 0].sum(), share[y == 1].sum()])
        weight = share * np.maximum(0.2 * total.sum() / np.maximum(total, 1e-300), 1.0)[y.astype(int)]
        m = fit_machine(lists, y, weight / weight.mean(), buckets, share=sizes[1] / (sizes[0] + sizes[1]), **options)
        yield pa.RecordBatch.from_arrays([pa.array([float(m.bias)]), pa.array([m.weight.tobytes()]), pa.array([m.factor.tobytes()])], names=["bias", "weight", "factor"])

    # 2 * sample rows at most, in a certain order
    return sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "terms").mapInArrow(run, "bias double, weight binary, factor binary")


def train(documents: DataFrame, labels: DataFrame, usable: Column, sample: int = 4000, sample_bytes: int = 64 << 20, buckets: int = BUCKETS, **options) -> Machine | float:
    """Fit on labelled rows for which `usable`, a column over the ids, holds."""
    ids = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(usable)
    present = ids.join(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_or_empty()).alias("size")).groupBy("doc_id").agg(F.sum("size").alias("size")), "doc_id")
    sizes = dict(present.groupBy("toxic").count().collect())
    if len(sizes) < 2:
        return float(1 in sizes)
    parts = [present.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    by = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")  # over 2 * sample rows at most
    chosen = parts[0].unionByName(parts[1]).withColumns({"upto": F.sum("size").over(by), "rank": F.row_number().over(by)}).where((F.col("upto") <= sample_bytes) | (F.col("rank") == 1)).select("doc_id", "toxic")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").select("toxic", "doc_id", "text")
    got = _fitted(_terms_of(texts, buckets), sizes, buckets, options).first()
    machine = Machine(buckets, 1)
    machine.bias, machine.weight = np.float32(got["bias"]), np.frombuffer(got["weight"], np.float32)
    machine.factor = np.frombuffer(got["factor"], np.float32).reshape(buckets, -1)
    return machine


def _scores(machine: Machine | float, texts: pa.Array) -> np.ndarray:
    if isinstance(machine, float):
        return np.full(len(texts), machine)
    raw, off = _lowered(texts)
    found = [machine.scores(*term_buckets(raw, off[a : b + 1], len(machine.weight))) for a, b in slices(off)]
    return np.concatenate(found) if found else np.zeros(0)


def score(documents: DataFrame, machine: Machine | float) -> DataFrame:
    """One row per document: doc_id and score."""
    shared = documents.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(shared.value, batch.column(1)))], names=["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double")


def score_documents(documents: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3, **options) -> DataFrame:
    """Scores of all documents by a machine that has seen no held-out label."""
    scored = score(documents, train(documents, labels, ~held_out, **options))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(documents: DataFrame, labels: DataFrame, usable: Column, threshold: float = 0.3, **options) -> DataFrame:
    """The documents whose score is under the threshold, with their own columns; texts pass once and are not shuffled."""
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, labels, usable, **options))
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(pc.cast(batch.column(at), pa.string()), "")
            yield batch.filter(pa.array(_scores(shared.value, texts) < threshold, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
