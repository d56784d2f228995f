"""Operator 11: best-two-fit packing of whole documents into as few token sequences as it can.

Best-two-fit fills one sequence after the other: the longest document that still fits, until none does; then, where room
is left, the sequence's shortest document gives way to the two unpacked documents that together come closest to the room
that it had and the room left. What a sequence holds depends only on how many documents there are of each length, so the
packing is made from these counts, at most `capacity` numbers for a corpus of any size, and a filling is repeated for as
long as the counts allow it: the result is that of going one by one over all documents, not over a task's own.

1. Tasks tokenise their documents and cut those over the capacity; each piece gets its place among its task's pieces of
   the same length. This narrow table (no ids) is written to the checkpoint folder.
2. Counts by task and length, summed up over the tasks before, give each piece its rank among all of its length.
3. The driver turns the counts by length into fillings: (length, first rank, number in each sequence, first sequence,
   offset). Each filling that is repeated as often as possible uses up a length but for less than it needs of it, so there
   are at most sum(capacity / length) of them, each of at most sqrt(2 * capacity) lengths; they are broadcast.
4. A piece's length and rank give its filling by binary search, and from it sequence and offset.

Defined cases: a null or empty text is the single end id; special tokens' strings in a text are encoded as the library
does by default; a document over the capacity is cut into pieces of the capacity, after a first one that holds what is
left over; of a very long text a task holds one document's ids at a time; repeated rows are documents of their own with
the same doc_id; ties in length are numbered by task and row; a null doc_id stays null; an empty table gives an empty
result. Only doc_id and text are read, so other columns' names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import worker_encoder
from .common import list_array, materialise, text_or_empty

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long, task int, place long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fillings(counts: np.ndarray, capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Best-two-fit over counts[length] pieces: ({length: number in a sequence}, number of such sequences)."""
    left = counts.astype(np.int64).copy()
    lengths = np.arange(len(left))
    while True:
        longest = np.maximum.accumulate(np.where(left > 0, lengths, 0))  # that is not over each length
        if not longest[-1]:
            return
        fill: dict[int, int] = {}
        room, at = capacity, int(longest[capacity])
        while at:
            n = min(int(left[at]), room // at)
            fill[at] = n
            room -= n * at
            at = int(longest[min(room, at - 1)])
        use = dict(fill)
        if room and sum(fill.values()) > 1 and (pair := _pair(left, fill, room)):
            least = min(fill)
            use[least] -= 1
            for x in pair:
                use[x] = use.get(x, 0) + 1
        # again, while there is as much of each length as filling and exchange asked for
        times = 1 + min((int(left[x]) - max(n, fill.get(x, 0))) // n for x, n in use.items() if n)
        for x, n in use.items():
            left[x] -= n * times
        yield {x: n for x, n in use.items() if n}, times


def _pair(left: np.ndarray, fill: dict[int, int], room: int) -> tuple[int, int] | None:
    """The lengths of two unpacked pieces that fill most of the room that the shortest packed piece would leave, more than
    it does itself; of several pairs that with the longest piece."""
    least, free = min(fill), left.copy()
    for x, n in fill.items():
        free[x] -= n
    longest = np.maximum.accumulate(np.where(free > 0, np.arange(len(free)), 0))
    short = np.flatnonzero(free[: (room + least) // 2 + 1] > 0)
    long = longest[room + least - short]
    fits = (short > 0) & ((long > short) | ((long == short) & (free[short] > 1)))
    short, long = short[fits], long[fits]
    if not len(short) or (short + long).max() <= least:
        return None
    best = int(np.argmax(short + long))  # the first has the shortest, so the longest beside it
    return int(short[best]), int(long[best])


def assignments(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (length, first rank, number in a sequence, first sequence, offset) of all fillings, by length and rank."""
    rows, sequence, rank = [], 0, np.zeros(len(counts), np.int64)
    for use, times in fillings(counts, capacity):
        offset = 0
        for length in sorted(use, reverse=True):
            rows.append((length, rank[length], use[length], sequence, offset))
            rank[length] += use[length] * times
            offset += use[length] * length
        sequence += times
    table = np.array(rows, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def token_pieces(documents: DataFrame, tokenizer: str, end_id: int, capacity: int, keep_ids: bool = False) -> DataFrame:
    """One row per piece, with its place among its task's pieces of the same length."""
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, specials=True)
        task, places = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for first, ids, counts in encoder.encode(batch.column(1)):
                wide, at, rows, parts = ids.astype("<u4"), 0, [], []
                for k, n in enumerate(counts.tolist(), first):
                    own, at = np.concatenate([wide[at : at + n], end]), at + n
                    cuts = [0, *range((n + 1) % capacity or capacity, n + 2, capacity)]
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows.append((k, i, a, b - a, zlib.crc32(own[a:b]), n + 1, task, places[b - a]))
                        places[b - a] += 1
                        if keep_ids:
                            parts.append(own[a:b])
                table = np.array(rows, np.int64)
                arrays = [batch.column(0).take(pa.array(table[:, 0])), pa.array(table[:, 1].astype(np.int32)), *(pa.array(table[:, i]) for i in range(2, 6)), pa.array(table[:, 6].astype(np.int32)), pa.array(table[:, 7])]
                if keep_ids:
                    arrays.append(list_array(np.concatenate(parts).astype(np.int32), table[:, 3], pa.int32()))
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "ids"] if keep_ids else names)

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return narrow.mapInArrow(run, PIECES + ", ids array<int>" * keep_ids)


def pack_whole(documents: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """One row per piece: where it stands in its document and in its sequence; with `keep_ids`, the ids themselves."""
    pieces = materialise(token_pieces(documents, tokenizer, end_id, capacity, keep_ids))
    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = materialise(by_task.select("task", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[row["length"]] = row["n"]
    shared = documents.sparkSession.sparkContext.broadcast(assignments(counts, capacity))
    ranked = pieces.join(by_task.drop("n"), ["task", "length"]).withColumn("rank", F.col("before") + F.col("place"))
    names = [x.split()[0] for x in PACKED.split(", ")] + ["ids"] * keep_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        first_of = np.searchsorted(plan[:, 0], np.arange(capacity + 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column(3).to_numpy(), batch.column(6).to_numpy()
            found = np.empty(len(rank), np.int64)
            for x in np.unique(length):
                mine, begin = length == x, first_of[x]
                found[mine] = begin + np.searchsorted(plan[begin : first_of[x + 1], 1], rank[mine], "right") - 1
            _, first, use, sequence, offset = plan[found].T
            inside = rank - first
            columns = [*(batch.column(i) for i in range(6)), pa.array(sequence + inside // use), pa.array(offset + inside % use * length)]
            yield pa.RecordBatch.from_arrays(columns + batch.columns[7:], names=names)

    wanted = ["doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens", "rank"] + ["ids"] * keep_ids
    return ranked.select(*wanted).mapInArrow(place, PACKED + ", ids array<int>" * keep_ids)
