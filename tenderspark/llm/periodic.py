"""Operator 12: runs of words that repeat with a period, by block matching with an automaton over word numbers.

A run is a stretch of consecutive words with smallest period q and length >= max(6, 4 * q) that no neighbouring word
extends. For b, the largest power of two that is not over q, the first 2 * b - 1 words of a run hold a block of b words
that begins at a multiple of b, and the run holds this block again q words later, with b <= q < 2 * b. So, from small
scales to large ones, aligned blocks of b words, as sequences of integers, are the keys of a pyahocorasick automaton that
goes over the document; an occurrence at a distance of b to 2 * b - 1 is a seed, which is extended both ways by comparing words, exactly.

What keeps this near n * log(n) words for a document of n:
- a block becomes a key only if its grams of four words, at its ends and middle, recur at such a distance, which a run
  makes them do; documents in which no gram of four words recurs have no run;
- seeds inside a run of a smaller scale only find multiples of its period and are left out, as are seeds whose grams do
  not recur where a run would have them;
- where a block and its occurrence lie in two runs of one small period, only the distance of the runs' ends or of their
  beginnings can be a period.

A document's words are numbered by a dictionary of its own; the work is per document, nothing is shuffled.

Defined cases: null, empty and blank texts have no words, no runs and an empty collapsed text; repeated rows are rows of
their own; a null doc_id stays null and is never rewritten; a very long text is split in blocks, and a task holds its word
numbers and distinct words; ties of the strongest run go to the smallest start, then period; an empty table gives an
empty result. Only doc_id and text are read, so other columns' names cannot clash.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, string_buffers, text_or_empty

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
#: Factor of the polynomial whose values name grams of four words; equal values only make candidates.
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_GRAM = 4


def number_words(text: bytes, block: int = 8 << 20) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text, as numbers by first occurrence, and the distinct words."""
    known: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(text):
        to = min(at + block, len(text))
        while to < len(text) and text[to] not in SPACES:
            to += 1
        words = text[at:to].split()  # bytes split at exactly the six white spaces of the word pattern
        known.update(zip([w for w in dict.fromkeys(words) if w not in known], itertools.count(len(known))))
        parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        at = to
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), list(known)


class _Known:
    """Runs found so far, to ask which of them holds an interval."""

    def __init__(self, runs: list[tuple[int, int, int]]):
        table = np.array(sorted(runs), np.int64).reshape(-1, 3)
        self.start, self.period = table[:, 0], table[:, 2]
        self.end = table[:, 0] + table[:, 1]
        self.far = np.maximum.accumulate(self.end) if len(table) else self.end
        far_at = np.where(self.end == self.far, np.arange(len(table)), 0)
        self.which = np.maximum.accumulate(far_at) if len(table) else far_at

    def holding(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of a run that holds [start, end), else -1."""
        at = np.searchsorted(self.start, start, "right") - 1
        out = np.full(len(start), -1)
        some = np.flatnonzero(at >= 0)
        some = some[self.far[at[some]] >= end[some]]
        out[some] = self.which[at[some]]
        return out


def _matching(ids: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from i on, in steps of 1 or -1, equal those from j on; i is before j."""
    n, width, count = len(ids), 32, 0
    most = n - j if step > 0 else i + 1
    while count < most:
        m = min(width, most - count)
        if step > 0:
            differs = ids[i + count : i + count + m] != ids[j + count : j + count + m]
        else:
            differs = (ids[i - count - m + 1 : i - count + 1] != ids[j - count - m + 1 : j - count + 1])[::-1]
        if differs.any():
            return count + int(differs.argmax())
        count, width = count + m, 2 * width
    return count


class _Grams:
    """Grams of four words: do they recur at a distance?"""

    def __init__(self, ids: np.ndarray):
        with np.errstate(over="ignore"):
            v = (ids + 1).astype(np.uint64)
            g = ((v[:-3] * _FACTOR + v[1:-2]) * _FACTOR + v[2:-1]) * _FACTOR + v[3:]
        self.value = g
        order = np.argsort(g, kind="stable")
        ordered = g[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        self.repeats = not new.all()
        if self.repeats:
            group = np.cumsum(new) - 1
            self.group = np.empty(len(g), np.int64)
            self.group[order] = group
            self.wide = 2 * len(ids)
            self.places = group * self.wide + order

    def recur(self, at: np.ndarray, low: int, high: int) -> np.ndarray:
        """Whether the gram at each place is there again at a distance of low to high - 1."""
        own = self.group[at] * self.wide + at
        found = np.searchsorted(self.places, own + low)
        out = found < len(self.places)
        out[out] = self.places[found[out]] - own[out] < high
        return out


class _Names:
    """Numbers of the stretches of a power of two of words from each place on; equal stretches have equal numbers."""

    def __init__(self, ids: np.ndarray):
        self.width, self.number = 1, ids

    def of(self, width: int) -> np.ndarray:
        while self.width < width:
            both = self.number[: -self.width] * (int(self.number.max()) + 1) + self.number[self.width :]
            self.number = np.unique(both, return_inverse=True)[1]
            self.width *= 2
        return self.number


def _seeds(names: _Names, at: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks at `at` and the distances, b to 2 * b - 1, at which the automaton finds them again.

    A block's key is its words, from 8 words on the numbers of its quarters; the document is then read in strides of a
    quarter from each place of the first one on. So keys share no long chains of suffixes, however regular a text is.
    """
    size, u = min(b, 4), max(1, b // 4)
    number = names.of(u)
    first, last = int(at[0]), min(int(at[-1]) + 3 * b, len(number) + u - 1)
    some = number[first : last - u + 1]
    columns = -(-len(some) // u) + 1  # with an end mark in each line
    lines = np.full((columns, u), int(number.max()) + 1)
    lines.reshape(-1)[: len(some)] = some
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    keys: dict[tuple[int, ...], int] = {}
    blocks = number[at[:, None] + u * np.arange(size)]
    key = np.array([keys.setdefault(tuple(block), len(keys)) for block in blocks.tolist()])
    for block, k in keys.items():
        automaton.add_word(block, k)
    automaton.make_automaton()
    found = np.fromiter(itertools.chain.from_iterable(automaton.iter(tuple(lines.T.ravel().tolist()))), np.int64).reshape(-1, 2)
    line, column = np.divmod(found[:, 0], columns)
    wide = 4 * len(names.number) + 8 * b
    places = np.sort(found[:, 1] * wide + first + (column - size + 1) * u + line)
    own = key * wide + at
    low, high = np.searchsorted(places, own + b), np.searchsorted(places, own + 2 * b)
    hits = high - low
    stops = np.cumsum(hits)
    occurs = places[np.repeat(low - stops + hits, hits) + np.arange(stops[-1])]
    return np.repeat(at, hits), occurs - np.repeat(own, hits)


def _could_be(n: int, grams: _Grams, known: _Known, at: np.ndarray, d: np.ndarray, b: int) -> np.ndarray:
    """Which seeds may be the first block of a run that is not known."""
    keep = (at + 3 * d + 1 <= n) & (known.holding(at, at + d + b) < 0)
    for t in (np.full(len(d), b), d, 2 * d - 3):  # the run holds at least 3 * d + 1 words from the block on
        on = np.flatnonzero(keep & (t >= 0) & (t <= 2 * d - 3))
        x = at[on] + t[on]
        keep[on] = grams.value[x] == grams.value[x + d[on]]
    on = np.flatnonzero(keep)
    if len(on) and len(known.start):
        one, two = known.holding(at[on], at[on] + b), known.holding(at[on] + d[on], at[on] + d[on] + b)
        both = (one >= 0) & (two >= 0)
        both &= (known.period[one] == known.period[two]) & (4 * known.period[one] <= b)
        far = known.end[two] - known.end[one]
        near = known.start[two] - known.start[one]
        keep[on[both & (far != d[on]) & (near != d[on])]] = False
    return keep


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of numbers, by start and period."""
    n = len(ids)
    if n < 6:
        return []
    grams = _Grams(ids)
    if not grams.repeats:
        return []
    runs: list[tuple[int, int, int]] = []
    known, names, b = _Known(runs), _Names(ids), 1
    while 4 * b <= n:
        at = np.arange(0, n - 3 * b, b)  # before the last period but two
        for shift in {0, max(0, b - _GRAM), b // 2 if b >= 2 * _GRAM else 0}:
            at = at[at + shift + b + _GRAM <= n]
            at = at[grams.recur(at + shift, b, 2 * b)]
        at = at[known.holding(at, at + 3 * b - 1) < 0]
        if len(at):
            at, d = _seeds(names, at, b)
            keep = _could_be(n, grams, known, at, d, b)
            at, d = at[keep], d[keep]
            order = np.lexsort((at, d))
            before, until, count = 0, 0, len(runs)
            for p, q in zip(at[order].tolist(), d[order].tolist()):
                if q == before and p + q + b <= until:
                    continue
                start = p - _matching(ids, p - 1, p + q - 1, -1)
                end = p + q + b + _matching(ids, p + b, p + q + b, 1)
                before, until = q, end
                if end - start >= max(6, 4 * q):
                    runs.append((start, end - start, q))
            if len(runs) > count:
                known = _Known(runs)
        b *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> int | None:
    """The number of the run with the greatest length / period, compared exactly; the first of equal ones."""
    best = None
    for k, (_, length, period) in enumerate(runs):
        if best is None or length * runs[best][2] > runs[best][1] * period:
            best = k
    return best


def collapsed(ids: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """The words that stay: all but those of a run after its first period."""
    change = np.zeros(len(ids) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return ids[np.cumsum(change[:-1]) == 0]


def periodic_runs(documents: DataFrame, rewrite: Callable[[int, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, its runs by start and period, the number of the strongest one from 0, and the
    text without repetitions, its words joined by one space.

    rewrite(doc_id, n_words), for tests with planted loops, gives None or a place and a period: all words from there on
    then become repetitions of the first ones there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = string_buffers(batch.column(1))
            bounds, whole = off.tolist(), memoryview(raw)
            out: list[list] = [[], [], [], []]
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                ids, words = number_words(bytes(whole[bounds[k] : bounds[k + 1]]))
                loop = rewrite(doc_id, len(ids)) if rewrite and doc_id is not None else None
                if loop:
                    place = np.arange(len(ids))
                    place[loop[0] :] = loop[0] + (place[loop[0] :] - loop[0]) % loop[1]
                    ids = ids[place]
                runs = runs_of(ids)
                stay = collapsed(ids, runs) if runs else ids
                text = b" ".join(map(words.__getitem__, stay.tolist()))
                for column, value in zip(out, (len(ids), runs, strongest(runs), text)):
                    column.append(value)
            flat = np.array([r for runs in out[1] for r in runs], np.int64).reshape(-1, 3)
            ends = np.cumsum([0, *map(len, out[1])])
            runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"]))
            texts = pa.array(out[3], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), runs, pa.array(out[2], pa.int32()), texts], names=["doc_id", "n_words", "runs", "strongest", "text"])

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return narrow.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, strongest int, text string")


def planted_loop(doc_id: int, n: int) -> tuple[int, int] | None:
    """Where one document in ten, by the crc32 of its id, begins to repeat itself, and with what period."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def run_digests(found: DataFrame) -> DataFrame:
    """One row per document: number of runs, the strongest one, and SHA-256 of all runs and of the collapsed text."""
    best = F.element_at("runs", F.col("strongest") + 1)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(F.lit(1000) * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )
