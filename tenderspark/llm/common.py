"""What the operators of this subpackage share: tables, checkpoints, byte-level text helpers."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir; a temporary one only in local mode, where none is set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_or_empty(name: str = "text") -> F.Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def mix64(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over uint64 values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Moduli and bases of the two polynomials of `hash_spans`, and how many bytes go by in one block.
_POLYNOMIALS = ((2147483647, 1540483477), (2147483629, 1779033703))
_WINDOW = 1 << 20
_POWERS: dict[int, np.ndarray] = {}


def _powers(prime: int, base: int) -> np.ndarray:
    """base**i modulo the prime for i up to _WINDOW."""
    if prime not in _POWERS:
        p, n = np.ones(_WINDOW + 1, np.uint64), 1
        while n < len(p):
            m = min(n, len(p) - n)
            p[n : n + m] = p[:m] * np.uint64(pow(base, n, prime)) % np.uint64(prime)
            n += m
        _POWERS[prime] = p
    return _POWERS[prime]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column without nulls, without copying."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def slices(off: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes together, or one longer row."""
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to


def word_bounds(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words ``[^\x20\x09-\x0D]+`` of consecutive texts; off[0] is 0."""
    n = len(raw)
    inside = ~_IS_SPACE[raw]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = inside
    after = np.empty(n + 1, bool)
    after[:n] = inside
    after[n] = False
    starts = np.flatnonzero(after & (~before | cut))
    ends = np.flatnonzero(before & (~after | cut))
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def _polynomial(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, prime: int, base: int) -> np.ndarray:
    """Sum of (byte + 1) * base**(place in the span + _WINDOW) modulo the prime, for spans with rising starts."""
    up, p = _powers(prime, base), np.uint64(prime)
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        at = int(starts[first])
        last = int(np.searchsorted(starts, at + _WINDOW, "left"))
        begin, stop = starts[first:last] - at, ends[first:last] - at
        upto, carry, head = np.zeros(last - first, np.uint64), np.uint64(0), None
        for k in range(0, max(int(stop.max()), 1), _WINDOW):  # longer than one block only with a span that long
            some = raw[at + k : at + min(k + _WINDOW, int(stop.max()))]
            weight = up[: len(some)] if not k else up[: len(some)] * np.uint64(pow(base, k, prime)) % p
            sums = np.empty(len(some) + 1, np.uint64)
            sums[0] = 0
            np.cumsum((some.astype(np.uint64) + np.uint64(1)) * weight, out=sums[1:])
            sums += carry
            if head is None:
                head = sums[np.minimum(begin, len(some))] % p
            here = (stop >= k) & (stop <= k + len(some))
            upto[here] = sums[stop[here] - k] % p
            carry = sums[-1] % p
        out[first:last] = (upto + p - head) % p * up[_WINDOW - begin] % p
        first = last
    return out


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans with rising starts: two polynomials modulo primes near 2**31, so 62 bits tell spans
    apart. The moduli are primes, as modulo 2**64 long regular strings (Thue-Morse) collide for every base."""
    with np.errstate(over="ignore"):
        a, b = (_polynomial(raw, starts, ends, *x) for x in _POLYNOMIALS)
        return mix64((a << np.uint64(31)) + b + ((ends - starts).astype(np.uint64) << np.uint64(62)))


def hashed_words(raw: np.ndarray, off: np.ndarray, lower: bool = True, most: int = 8 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row number of every word of some consecutive texts; a very long text goes by blocks cut at white space."""
    raw = raw[off[0] : off[-1]]
    off = off - off[0]
    if len(off) == 2 and len(raw) > most:
        parts, at = [], 0
        while at < len(raw):
            to = min(at + most, len(raw))
            if to < len(raw):
                space = np.flatnonzero(_IS_SPACE[raw[at:to]])
                to = at + int(space[-1]) + 1 if len(space) else to
                while to < len(raw) and not _IS_SPACE[raw[to - 1]]:
                    to += 1
            parts.append(hashed_words(raw[at:to], np.array([0, to - at]), lower, len(raw))[0])
            at = to
        h = np.concatenate(parts)
        return h, np.zeros(len(h), np.int64)
    if lower:
        raw = _LOWER[raw]
    starts, ends, row = word_bounds(raw, off)
    return hash_spans(raw, starts, ends), row


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    off = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))
