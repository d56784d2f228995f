"""Operator 1: cost-balanced packing of documents into token sequences of a fixed capacity.

Each task packs its documents in pools of about `pool` sequences, where they are tokenised, so nothing is shuffled.
Of a document, whole stretches of `capacity` ids fill a sequence each; the rest is one piece. A pool's pieces are taken
by falling length, which is falling cost, and each goes to the sequence of lowest attention cost, a * length +
b * length**2 over its pieces, that still has room. A pool has the least number of sequences that can hold it, so a
piece that fits nowhere whole is cut over the cheapest sequences with room: padding stays under one sequence a pool.

Defined cases: a null or empty text is the single end id; special tokens' strings in a text are encoded as the library
does by default; a very long text is tokenised in blocks and fills sequences of its own but for its last ids; repeated
rows are documents of their own, with the same doc_id; ties in length keep the order of rows, ties in cost take the first sequence; a null doc_id stays null; an empty
table gives an empty result. Only doc_id and text are read, so other columns' names cannot clash. Sequence ids are the
partition's number and a counter, the same when a lost task runs again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import worker_encoder
from .common import list_array, text_or_empty

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def balance(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (number, start in it, length, sequence, offset there) for lengths under the capacity."""
    if not len(lengths):
        return []
    n = int(-(-int(lengths.sum()) // capacity))
    room = np.full(n, capacity, np.int64)
    cost = np.zeros(n)
    out = []

    def put(k: int, start: int, length: int, s: int) -> None:
        out.append((k, start, length, s, capacity - int(room[s])))
        room[s] -= length
        cost[s] += linear * length + quadratic * length * length

    for k in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[k])
        fits = np.flatnonzero(room >= length)
        if len(fits):
            put(k, 0, length, int(fits[np.argmin(cost[fits])]))
            continue
        start = 0
        while start < length:
            open_ = np.flatnonzero(room > 0)
            s = int(open_[np.argmin(cost[open_])])
            part = min(int(room[s]), length - start)
            put(k, start, part, s)
            start += part
    return out


class _Pool:
    """Documents of a task that wait to be packed; what is held is under a pool's ids and one block of texts."""

    def __init__(self, partition: int, capacity: int, sequences: int, linear: float, quadratic: float, keep_ids: bool):
        self.next = partition << 33
        self.capacity, self.most, self.linear, self.quadratic, self.keep_ids = capacity, sequences * capacity, linear, quadratic, keep_ids
        self.rest: list[tuple[int | None, int, int, np.ndarray]] = []
        self.held = 0
        self.rows: list[tuple] = []

    def _row(self, doc_id, ids: np.ndarray, start: int, total: int, sequence: int, offset: int) -> None:
        n = len(ids)
        self.rows.append((doc_id, start, n, zlib.crc32(ids), total, sequence, offset, self.linear * n + self.quadratic * n * n, ids if self.keep_ids else None))

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, whole = len(ids), len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self._row(doc_id, ids[start : start + self.capacity], start, total, self.next, 0)
            self.next += 1
        if whole < total:
            self.rest.append((doc_id, whole, total, ids[whole:].copy()))
            self.held += total - whole
        if self.held >= self.most:
            self.pack()

    def pack(self) -> None:
        lengths = np.array([len(x[3]) for x in self.rest], np.int64)
        last = -1
        for k, start, length, s, offset in balance(lengths, self.capacity, self.linear, self.quadratic):
            doc_id, base, total, ids = self.rest[k]
            self._row(doc_id, ids[start : start + length], base + start, total, self.next + s, offset)
            last = max(last, s)
        self.next += last + 1
        self.rest, self.held = [], 0

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * 9
        self.rows = []
        kinds = [pa.int64()] * 7 + [pa.float64()]
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        if self.keep_ids:
            flat = np.concatenate(columns[8]) if columns[8] else np.zeros(0, np.uint32)
            arrays.append(list_array(flat.astype(np.int32), np.array([len(x) for x in columns[8]], np.int64), pa.int32()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names)


def pack_documents(documents: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024, pool: int = 512, linear: float = 1.0, quadratic: float = 1.0 / 1024, keep_ids: bool = False) -> DataFrame:
    """One row per piece: where it stands in its document and in its sequence; with `keep_ids`, the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, specials=True)
        packer = _Pool(TaskContext.get().partitionId(), capacity, pool, linear, quadratic, keep_ids)
        end = np.array([end_id], "<u4")
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, ids, counts in encoder.encode(batch.column(1)):
                wide, at = ids.astype("<u4"), 0
                for k, n in enumerate(counts.tolist(), first):
                    packer.add(doc_ids[k], np.concatenate([wide[at : at + n], end]))
                    at += n
                if packer.rows:
                    yield packer.take()
        packer.pack()
        if packer.rows:
            yield packer.take()

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return narrow.mapInArrow(run, SCHEMA + ", ids array<int>" * keep_ids)
