"""Operator 7: byte-level BPE with the tokenizers library over Arrow batches, and its reversal.

Texts are cut where a character that is no white space meets a blank, tab or line end: no match of the splitting
pattern spans that place or looks back over it, so the pieces' ids joined are the text's ids. Pieces repeat, so a
bounded cache in each Python worker holds their ids, and the library sees every distinct piece about once. Pieces are
looked up by hashes, and their bytes are compared with those found. Texts of any length go through in blocks. The cuts
suit one splitting pattern, so a tokenizer that splits by another is refused.

Defined cases: a null text counts as empty and has no ids; special tokens' strings in a text are ordinary text, unless
`specials` asks for the tokens;
repeated rows are encoded each by itself; an empty table gives an empty result. Columns of the input other than the
two named ones are ignored, so their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

from .common import hash_spans, list_array, mix64, slices, string_buffers, text_or_empty

#: A text is encoded in blocks of about so many bytes.
_BLOCK = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r")] = True
_CONTROL_SPACE = np.zeros(256, bool)
_CONTROL_SPACE[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F]] = True
#: The other white space of Unicode in UTF-8, as numbers of two and three bytes; fixed values.
_SPACE_2 = np.array([0xC285, 0xC2A0])
_SPACE_3 = np.array([0xE19A80, 0xE1A08E, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others for the characters from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def tokenizer_from_ranks(path: str, pattern: str) -> Tokenizer:
    """A tokenizers BPE model that has the ids and merges of a rank file."""
    ranks = read_ranks(path)
    character = byte_characters()
    name = {t: "".join(character[b] for b in t) for t in ranks}
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:  # the two parts that the last merge joins
            best = min(((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(rank, 0))
            if best[0] >= rank:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        if len(parts) == 2:
            merges.append((name[parts[0]], name[parts[1]]))
    tokenizer = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    tokenizer.decoder = decoders.ByteLevel()
    return tokenizer


def load_tokenizer(path: str, pattern: str | None = None, specials: bool = False) -> Tokenizer:
    """From a tokenizers JSON file, or from a rank file and its splitting pattern; with `specials`, the strings of special
    tokens in a text are encoded as these tokens, as the library does by default."""
    if path.endswith(".tiktoken"):
        if pattern not in (None, public_tokenizers.PATTERN):
            raise ValueError(f"texts are not cut for the pattern {pattern}")
        return tokenizer_from_ranks(path, public_tokenizers.PATTERN)
    tokenizer = Tokenizer.from_file(path)
    parts = json.loads(tokenizer.to_str())
    splits = parts["pre_tokenizer"] or {}
    if parts["normalizer"] or splits.get("type") != "ByteLevel" or splits.get("add_prefix_space") or not splits.get("use_regex"):
        raise ValueError(f"{path}: texts are cut for a byte-level tokenizer with the usual pattern only")
    tokenizer.encode_special_tokens = not specials
    return tokenizer


def _after_text(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is no white space; places are at least 1."""
    one = raw[at - 1].astype(np.int64)
    two = (raw[np.maximum(at - 2, 0)].astype(np.int64) << 8) + one
    three = (raw[np.maximum(at - 3, 0)].astype(np.int64) << 16) + two
    return ~(_BLANK[one] | _CONTROL_SPACE[one] | np.isin(two, _SPACE_2) | np.isin(three, _SPACE_3))


def _safe_cuts(raw: np.ndarray) -> np.ndarray:
    """Places before a blank, tab or line end that stands after a character other than white space."""
    blank = _BLANK[raw]
    at = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    return at[_after_text(raw, at)] if len(at) else at


class _Index:
    """Numbers of 64-bit hashes: an open hash table in numpy."""

    def __init__(self, bits: int = 14):
        self.bits, self.used = bits, 0
        self.key = np.zeros(1 << bits, np.uint64)
        self.value = np.zeros(1 << bits, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if it has none."""
        mask = np.uint64((1 << self.bits) - 1)
        out = np.full(len(h), -1, np.int32)
        left, at = np.arange(len(h)), h & mask
        while len(left):
            k = self.key[at]
            hit = k == h[left]
            out[left[hit]] = self.value[at[hit]]
            on = ~hit & (k != 0)
            left, at = left[on], (at[on] + np.uint64(1)) & mask
        return out

    def add(self, h: np.ndarray, first: int) -> None:
        """Number new, distinct hashes from `first` on."""
        while (self.used + len(h)) * 2 > len(self.key):
            old, kept = self.key != 0, (self.key, self.value)
            self.bits, self.used = self.bits + 1, 0
            self.key, self.value = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._put(kept[0][old], kept[1][old])
        self._put(h, np.arange(first, first + len(h), dtype=np.int32))

    def _put(self, h: np.ndarray, value: np.ndarray) -> None:
        mask = np.uint64((1 << self.bits) - 1)
        self.used += len(h)
        at = h & mask
        while len(h):
            free = self.key[at] == 0
            self.key[at[free]] = h[free]
            won = self.key[at] == h
            self.value[at[won]] = value[won]
            h, value, at = h[~won], value[~won], (at[~won] + np.uint64(1)) & mask


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    """The array, or a longer copy of it that has room for n elements."""
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


class Encoder:
    """Ids of whole texts, with a cache of pieces that is bounded in entries and ids. A piece is looked up by its hash and
    taken only if its bytes are the cached ones; another piece with the same hash goes on to a next hash."""

    def __init__(self, path: str, pattern: str | None = None, specials: bool = False, entries: int = 800_000, ids: int = 8_000_000):
        self.tokenizer = load_tokenizer(path, pattern, specials)
        self.bytes = ByteTable(self.tokenizer)
        self.entries, self.most_ids = entries, ids
        self._forget()

    def _forget(self) -> None:
        self.index = _Index()
        self.pieces = self.used = self.used_raw = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.raw = np.zeros(1 << 18, np.uint8)
        self.start, self.length = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.raw_start, self.raw_length = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def _encode_pieces(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and each one's number of ids. Pieces that may stand one after the other, as they begin with a
        blank and end in text, go to the library some hundred to a string."""
        joins = _BLANK[raw[starts]] & _after_text(raw, ends)
        order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        starts, ends = starts[order], ends[order]
        sizes = ends - starts
        to = np.cumsum(sizes)
        flat = raw[np.repeat(starts - to + sizes, sizes) + np.arange(to[-1])].tobytes()
        n = int(joins.sum())
        cuts = np.concatenate([[0], to[: n : 500][1:] if n > 500 else [], to[n - 1 : n], to[n:]]).astype(np.int64)
        texts = [flat[a:b].decode("utf-8", "replace") for a, b in zip(cuts.tolist(), cuts[1:].tolist()) if b > a]
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(found)
        marks = np.searchsorted(np.cumsum(self.bytes.length[ids]), to, "left") + 1
        counts = np.diff(marks, prepend=0)
        back = np.argsort(order)
        begin = (marks - counts)[back]
        counts = counts[back]
        stops = np.cumsum(counts)
        return ids[np.repeat(begin - stops + counts, counts) + np.arange(stops[-1])], counts

    def _learn(self, h: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        ids, counts = self._encode_pieces(raw, starts, ends)
        sizes, n, new = ends - starts, self.pieces, len(h)
        stops = np.cumsum(sizes)
        flat = raw[np.repeat(starts - stops + sizes, sizes) + np.arange(stops[-1])]
        for name in ("start", "length", "raw_start", "raw_length"):
            setattr(self, name, _grown(getattr(self, name), n + new))
        self.ids, self.raw = _grown(self.ids, self.used + len(ids)), _grown(self.raw, self.used_raw + len(flat))
        self.length[n : n + new], self.raw_length[n : n + new] = counts, sizes
        self.start[n : n + new] = self.used + np.cumsum(counts) - counts
        self.raw_start[n : n + new] = self.used_raw + stops - sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.raw[self.used_raw : self.used_raw + len(flat)] = flat
        self.used, self.used_raw, self.pieces = self.used + len(ids), self.used_raw + len(flat), n + new
        self.index.add(h, n)

    def _same(self, at: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each piece has the bytes of the cached piece with this number."""
        sizes = ends - starts
        same = self.raw_length[at] == sizes
        some = np.flatnonzero(same)
        sizes, stops = sizes[some], np.cumsum(sizes[some])
        if len(some):
            step = np.arange(stops[-1]) - np.repeat(stops - sizes, sizes)
            differs = self.raw[np.repeat(self.raw_start[at[some]], sizes) + step] != raw[np.repeat(starts[some], sizes) + step]
            same[np.repeat(some, sizes)[differs]] = False
        return same

    def _numbers(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The cached number of each piece, after the missing ones are learned."""
        out = np.zeros(len(starts), np.int32)
        left, h = np.arange(len(starts)), hash_spans(raw, starts, ends)
        while len(left):
            h = np.maximum(h, np.uint64(1))
            at = self.index.find(h)
            if (missing := np.flatnonzero(at < 0)).size:
                new, first = np.unique(h[missing], return_index=True)
                some = left[missing[first]]
                self._learn(new, raw, starts[some], ends[some])
                at[missing] = self.index.find(h[missing])
            out[left] = at
            other = ~self._same(at, raw, starts[left], ends[left])
            left, h = left[other], mix64(h[other])
        return out

    def _encode_block(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts and each one's number of ids; off[0] is 0."""
        if self.pieces > self.entries or max(self.used, self.used_raw // 8) > self.most_ids:
            self._forget()
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        cut = np.zeros(len(raw) + 1, bool)
        cut[_safe_cuts(raw)] = True
        cut[off] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], len(raw))
        at = self._numbers(raw, starts, ends)
        lengths = self.length[at].astype(np.int64)
        stops = np.cumsum(lengths)
        ids = self.ids[np.repeat(self.start[at] - stops + lengths, lengths) + np.arange(stops[-1])]
        before = np.concatenate([[0], stops])[np.searchsorted(starts, off)]
        return ids, np.diff(before)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Blocks of a text column without nulls: the first row's number, all ids, and each row's number of ids."""
        raw, off = string_buffers(texts)
        for a, b in slices(off, _BLOCK):
            some = raw[off[a] : off[b]]
            if len(some) <= 2 * _BLOCK:
                yield a, *self._encode_block(some, off[a : b + 1] - off[a])
                continue
            parts, at = [], 0
            while at < len(some):
                to = min(at + _BLOCK, len(some))
                while to < len(some):
                    cuts = _safe_cuts(some[to - 4 : to + _BLOCK])
                    if (cuts := cuts[cuts >= 4]).size:
                        to += int(cuts[0]) - 4
                        break
                    to = min(to + _BLOCK - 4, len(some))
                parts.append(self._encode_block(some[at:to], np.array([0, to - at]))[0])
                at = to
            ids = np.concatenate(parts)
            yield a, ids, np.array([len(ids)])


class ByteTable:
    """The bytes of each id, for decoding and for offsets."""

    def __init__(self, tokenizer: Tokenizer):
        byte = {c: b for b, c in enumerate(byte_characters())}
        vocab = tokenizer.get_vocab()
        table = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            table[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.length = np.fromiter(map(len, table), np.int64, len(table))
        self.start = np.cumsum(self.length) - self.length
        self.raw = np.frombuffer(b"".join(table), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        return self.raw[np.repeat(self.start[ids] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]

    def character_spans(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of each id's bytes; a character split over ids belongs to each of them."""
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        raw = self.decode(ids)
        seen = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters begun before each byte
        if len(raw) == 0:
            return np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        return seen[np.minimum(ends - lengths + 1, len(raw))] - 1, seen[ends]


_ENCODERS: dict[tuple, Encoder] = {}


def worker_encoder(path: str, pattern: str | None = None, specials: bool = False) -> Encoder:
    """One encoder for each Python worker, which keeps its cache from task to task."""
    key = (path, pattern, specials)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def encode_texts(df: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: its id column, ids, and the first and end character of each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, pattern)
        table = encoder.bytes
        for batch in batches:
            for first, ids, counts in encoder.encode(batch.column(1)):
                ends = np.cumsum(counts)
                spans = [table.character_spans(ids[e - n : e]) for e, n in zip(ends, counts)]
                starts = np.concatenate([s for s, _ in spans]) if spans else np.zeros(0)
                stops = np.concatenate([s for _, s in spans]) if spans else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(counts)), list_array(ids.astype(np.int32), counts, pa.int32()), list_array(starts.astype(np.int64), counts, pa.int64()), list_array(stops.astype(np.int64), counts, pa.int64())], names=["id", "ids", "char_start", "char_end"])

    narrow = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return narrow.mapInArrow(run, "id long, ids array<int>, char_start array<long>, char_end array<long>").withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per list of ids: the bytes, and the text with a replacement character where a character is incomplete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_encoder(path, pattern).bytes
        for batch in batches:
            raw = [table.decode(np.array(ids or [], np.int64)).tobytes() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())], names=["id", "bytes", "text"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, bytes binary, text string").withColumnRenamed("id", id_col)


def round_trip_digests(df: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids as little-endian 32-bit integers and of the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, pattern)
        table = encoder.bytes
        for batch in batches:
            for first, ids, counts in encoder.encode(batch.column(1)):
                raw, ends = table.decode(ids), np.cumsum(counts)
                lengths = np.concatenate([[0], np.cumsum(table.length[ids])])
                wide = ids.astype("<u4")
                own, back = [], []
                for e, n in zip(ends, counts):
                    own.append(hashlib.sha256(wide[e - n : e]).hexdigest())
                    back.append(hashlib.sha256(raw[lengths[e - n] : lengths[e]]).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(counts)), pa.array(counts, pa.int64()), pa.array(own), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
