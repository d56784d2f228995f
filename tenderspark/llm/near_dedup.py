"""Operator 3: MinHash near-dedup by bottom-k sketches of one hash function.

1. Each text gives the set of its hashed word shingles; its `k` smallest values are the sketch. Equal sets are one class.
2. Inverted lists: the classes that retain a value. Each class looks for partners in the lists of its `keys` smallest
   values that at most `common` classes retain; values that more retain, as those of a passage that many documents share,
   come last in that order. Two sets of similarity s share none of them with a probability of about (1 - s) ** keys.
   Classes that mostly retain such values, as those of a large group of near copies, meet in these values' lists too.
3. In a list, the union-sketch estimate of the similarity keeps pairs from `slack` below the threshold on. Of sets of
   more than k values, a link at the threshold fails this with the binomial probability 1.2e-9 (threshold 0.85) or
   2.6e-8 (0.80) at k = 32 and slack = 0.45; smaller sets' estimates are exact. The miss of step 2 is apart. Of a list
   over `block_members`, each class is first compared with the list's pivot, its smallest class; then only those that
   did not link with it are compared with all, as blocks of these against blocks of all. So a large group of near copies
   is read about once for a value, not once for each of its blocks. Tasks give out spanning trees, not pairs.
4. Components of what is left are units. The step before is audited: of the first of `audits` classes that have at least
   `audit_links` partners with an estimate over the threshold, or else the last of these numbers, the share of partners
   that came into the same unit. Under `recall` the search runs again with twice the keys; after the last try the query
   fails.
5. The full sets of a unit's classes meet in one task (or, over `block_items`, first with the unit's pivot, then as
   blocks like those above), where exact Jaccard similarities link them. No row is dropped, capped or sampled.
6. The classes of one document, which has several if rows with different texts share its doc_id, hang together too.

Defined cases: texts that are null, empty or without words have an empty set and link with nothing; with fewer words
than a shingle has, the whole sequence is the one shingle; rows that share a doc_id are one document, whatever their
texts: each has its own set size, all have the document's component and verdict, and a link of any of them is the
document's; a row without a doc_id links with nothing, has no component and is kept; an empty table gives an empty
result; only doc_id and text are read, so other columns' names cannot clash. Sets hold 64-bit hashes of whole shingles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, list_array, materialise, mix64, slices, string_buffers, text_or_empty
from .components import Forest, connected_components, link_by_hubs

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63))

#: So many classes are broadcast at most, 40 bytes each, to pick out texts without shuffling them.
BROADCAST_IDS = 500_000

#: Part of a sketch that must be values of long lists before these are keys.
OFTEN_SHARE = 0.4


def shingle_sets(raw: np.ndarray, off: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each of some consecutive texts."""
    h, row = hashed_words(raw, off)
    n = len(off) - 1
    counts = np.bincount(row, minlength=n)
    ends = np.cumsum(counts)
    out = []
    with np.errstate(over="ignore"):
        for e, c in zip(ends.tolist(), counts.tolist()):
            w = h[e - c : e]
            m = min(words, c)
            if not m:
                out.append(w)
                continue
            total = np.full(c - m + 1, np.uint64(m))
            for i in range(m):
                total = mix64(total + w[i : c - m + 1 + i] * _ODD[i % 5] + np.uint64(i))
            out.append(np.unique(total))
    return out


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, off = string_buffers(batch.column(1))
    for a, b in slices(off):
        yield a, b, raw, off[a : b + 1]


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set."""
    with np.errstate(over="ignore"):
        one = np.array([np.add.reduce(mix64(s)) for s in sets], np.uint64).view(np.int64)
        return one, np.array([np.add.reduce(mix64(s ^ _ODD[1])) for s in sets], np.uint64).view(np.int64)


def sketches(documents: DataFrame, words: int, k: int) -> DataFrame:
    """(doc_id, n_shingles, sig_a, sig_b, sketch): set size, a 128-bit signature of the set, its k smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, off in _texts(batch):
                sets = shingle_sets(raw, off, words)
                one, two = _signatures(sets)
                low = [s[:k] for s in sets]
                flat = np.concatenate(low).view(np.int64) if low else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two), list_array(flat, np.array([len(s) for s in low], np.int64), pa.int64())],
                    names=["doc_id", "n_shingles", "sig_a", "sig_b", "sketch"],
                )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_shingles long, sig_a long, sig_b long, sketch array<long>")


def full_sets(documents: DataFrame, words: int) -> DataFrame:
    """(holder, sig_a, sig_b, items): the full set of each document; of a task's equal documents the first one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            for a, b, raw, off in _texts(batch):
                sets = shingle_sets(raw, off, words)
                ids = batch.column(0).slice(a, b - a)
                named = list(zip(ids.to_pylist(), *(x.tolist() for x in _signatures(sets))))
                new = [k for k, x in enumerate(named) if x not in seen and not seen.add(x)]
                if new:
                    flat = np.concatenate([sets[k] for k in new]).view(np.int64)
                    one, two = (pa.array([named[k][i] for k in new], pa.int64()) for i in (1, 2))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(new, pa.int64())), one, two, list_array(flat, np.array([len(sets[k]) for k in new], np.int64), pa.int64())], names=["holder", "sig_a", "sig_b", "items"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "holder long, sig_a long, sig_b long, items array<long>")


def union_estimate(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Estimated similarity of each pair of rows: the share of both among the k smallest of their sketches' union.

    Sketches are rows of k unsigned values, filled up with the largest one.
    """
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    filler = np.uint64(0xFFFFFFFFFFFFFFFF)
    real = both != filler
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~twice, axis=1)
    inside = rank <= k
    return (twice & inside).sum(axis=1) / np.maximum(np.minimum(rank[:, -1], k), 1)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Whole groups of rows with equal first columns, from a sorted partition, several to a chunk."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        first = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(n, bool)
        for c in first:
            change[1:] |= c[1:] != c[:-1]
        same = bool(held) and all(held[-1].column(i)[-1].as_py() == c[0] for i, c in enumerate(first))
        cuts = np.flatnonzero(change)
        if held and not same:
            yield held
            held = []
        if len(cuts):
            yield [*held, batch.slice(0, int(cuts[-1]))]
            held = [batch.slice(int(cuts[-1]))]
        else:
            held.append(batch)
    if held:
        yield held


def _padded(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    lengths, flat = _lists(column)
    out = np.full((len(lengths), width), np.uint64(0xFFFFFFFFFFFFFFFF))
    out[np.arange(width) < lengths[:, None]] = flat.view(np.uint64)
    return out


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    c = pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c
    return np.diff(c.offsets.to_numpy()), c.flatten().to_numpy()


def _tree(rep: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each member to the smallest member of its tree."""
    least = np.full(len(rep), np.iinfo(np.int64).max)
    np.minimum.at(least, root, rep)
    a, b = rep, least[root]
    return a[a != b], b[a != b]


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _seeded(linked: np.ndarray) -> Forest:
    """The forest in which those that are linked with a pivot hang together."""
    forest, some = Forest(len(linked)), np.flatnonzero(linked)
    if len(some) > 1:
        forest.join(int(some[0]), some[1:])
    return forest


def _list_candidates(k: int, n_keys: int, least: float, similar: float, longest: int):
    """For partitions sorted by (value, left, right): rep, set size, sketch, keys, linked -> candidate edges."""

    def short(rep, size, sketch, keys, value, starts, ends) -> Iterator[pa.RecordBatch]:
        counts = ends - starts
        for m in np.unique(counts[counts > 1]):
            s = starts[counts == m]
            i, j = np.triu_indices(int(m), 1)
            for at in range(0, len(s), max(1, 40_000 // len(i))):
                base = s[at : at + max(1, 40_000 // len(i))][:, None]
                a, b = (base + i).ravel(), (base + j).ravel()
                near = np.minimum(size[a], size[b]) >= similar * np.maximum(size[a], size[b])
                a, b = a[near], b[near]
                v = value[a].view(np.uint64)[:, None]
                ka = np.where(keys[a] < v, keys[a], np.uint64(0xFFFFFFFFFFFFFFFF))
                seen = np.zeros(len(a), bool)  # in the list of a smaller value too
                for c in range(keys.shape[1]):
                    seen |= ((ka == keys[b][:, c : c + 1]) & (ka != np.uint64(0xFFFFFFFFFFFFFFFF))).any(axis=1)
                a, b = a[~seen], b[~seen]
                if len(a):
                    ok = union_estimate(sketch[a], sketch[b], k) >= least
                    yield _edges(rep[a[ok]], rep[b[ok]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _groups(batches, 3):
            t = pa.Table.from_batches(chunk)
            value, left, right, rep, size = (t.column(i).to_numpy() for i in range(5))
            sketch, keys, tied = _padded(t.column(5), k), _padded(t.column(6), n_keys), t.column(7).to_numpy()
            change = np.flatnonzero((value[1:] != value[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])) + 1
            starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(value)]])
            few = ends - starts <= longest
            yield from short(rep, size, sketch, keys, value, starts[few], ends[few])
            for s, e in zip(starts[~few], ends[~few]):
                r, z, w = rep[s:e], size[s:e], sketch[s:e]

                def linked(hub: int, others: np.ndarray, z=z, w=w) -> np.ndarray:
                    ok = np.minimum(z[hub], z[others]) >= similar * np.maximum(z[hub], z[others])
                    if ok.any():
                        ok[ok] = union_estimate(np.repeat(w[hub : hub + 1], ok.sum(), 0), w[others[ok]], k) >= least
                    return ok

                yield _edges(*_tree(r, link_by_hubs(len(r), linked, _seeded(tied[s:e])).root))

    return run


def _verify(similar_num: int, similar_den: int):
    """For partitions sorted by (unit, left, right): rep, items, linked -> edges of exact links, as trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _groups(batches, 3):
            t = pa.Table.from_batches(chunk)
            unit, left, right, rep = (t.column(i).to_numpy() for i in range(4))
            (lengths, flat), tied = _lists(t.column(4)), t.column(5).to_numpy()
            change = np.flatnonzero((unit[1:] != unit[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])) + 1
            starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(unit)]])
            to = np.concatenate([[0], np.cumsum(lengths)])
            for s, e in zip(starts, ends):
                if e - s < 2:
                    continue
                size = lengths[s:e]
                _, ids = np.unique(flat[to[s] : to[e]], return_inverse=True)
                begin = np.cumsum(size) - size
                mark = np.zeros(int(ids.max()) + 1, bool)

                def linked(hub: int, others: np.ndarray, size=size, ids=ids, begin=begin, mark=mark) -> np.ndarray:
                    near = np.minimum(size[hub], size[others]) * similar_den >= similar_num * np.maximum(size[hub], size[others])
                    some = others[near]
                    if len(some):
                        mine = ids[begin[hub] : begin[hub] + size[hub]]
                        mark[mine] = True
                        n = size[some]
                        stops = np.cumsum(n)
                        both = np.add.reduceat(mark[ids[np.repeat(begin[some] - stops + n, n) + np.arange(stops[-1])]].astype(np.int64), stops - n)
                        mark[mine] = False
                        near[near] = similar_den * both >= similar_num * (size[hub] + n - both)
                    return near

                yield _edges(*_tree(rep[s:e], link_by_hubs(int(e - s), linked, _seeded(tied[s:e])).root))

    return run


def _salted_join(rows: DataFrame, few: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Join rows with one row a key, the rows of a frequent key being dealt to several tasks by their rep."""
    spread = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(salts)).cast("int")).join(spread, [key, "_salt"]).drop("_salt")


def _rest_against_all(rows: DataFrame, key: str, weight: Column, block: int) -> DataFrame:
    """Deal rows (key, rep, linked, ...), linked saying that a row is linked with its key's pivot: those that are not, in
    blocks of about `block` weight (left), against blocks of all the key's rows (right)."""
    sizes = rows.groupBy(key).agg(F.ceil(F.sum(F.when(~F.col("linked"), weight)) / block).cast("int").alias("_rest"), F.ceil(F.sum(weight) / block).cast("int").alias("_all")).where("_rest > 0")
    sized = _salted_join(rows, sizes, key)

    def side(some: DataFrame, own: str, own_blocks: str, other: str, other_blocks: str) -> DataFrame:
        placed = some.withColumn(own, F.pmod(F.xxhash64("rep", F.lit(7)), F.col(own_blocks)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_blocks) - 1)))

    rest = side(sized.where("NOT linked"), "left", "_rest", "right", "_all")
    return rest.unionByName(side(sized, "right", "_all", "left", "_rest")).drop("_rest", "_all")


def _estimated(rows: DataFrame, k: int, least: float, similar: float) -> DataFrame:
    """Rows (value, rep, n_shingles, sketch, keys, pivot) with the struct of the pivot compared: its id and `linked`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size, other = batch.column(2).to_numpy(), batch.column(6).to_numpy()
            ok = np.minimum(size, other) >= similar * np.maximum(size, other)
            if ok.any():
                ok[ok] = union_estimate(_padded(batch.column(3), k)[ok], _padded(batch.column(7), k)[ok], k) >= least
            ok |= batch.column(1).to_numpy() == batch.column(5).to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), pa.array(ok)], names=["value", "rep", "n_shingles", "sketch", "keys", "pivot", "linked"])

    flat = rows.select("value", "rep", "n_shingles", "sketch", "keys", F.col("pivot.rep").alias("pivot"), F.col("pivot.n_shingles").alias("n"), F.col("pivot.sketch").alias("s"))
    return flat.mapInArrow(run, "value long, rep long, n_shingles long, sketch array<long>, keys array<long>, pivot long, linked boolean")


def key_rounds(k: int, keys: int, common: int) -> Iterator[tuple[int, int, float]]:
    """(keys, common, often_share) of rounds with ever more keys; in the last one every retained value is a key, so it finds
    all pairs that share any, and needs no audit."""
    while keys < k:
        yield keys, common, OFTEN_SHARE
        keys, common = 2 * keys, 2 * common
    yield k, common, 0.0


def candidates(classes: DataFrame, k: int, keys: int, common: int, least: float, similar: float, block_members: int, often_share: float) -> DataFrame:
    """Edges (a, b) among classes (rep, n_shingles, sketch) that join all pairs with an estimate from `least` on, as far
    as they share one of their keys. Values that over `common` classes retain are keys of a class if they are more than
    `often_share` of its sketch."""
    # who retains a value with others
    entries = classes.select("rep", F.explode("sketch").alias("value"))
    shared = entries.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = _salted_join(entries, shared, "value", 8).groupBy("rep").agg(
        F.collect_list(F.when(F.col("n") <= common, F.col("value"))).alias("rare"),
        F.collect_list(F.when(F.col("n") > common, F.col("value"))).alias("often"),
    )
    by = classes.join(own, "rep").select(
        "rep",
        "n_shingles",
        "sketch",
        # in the sketch's order, that of unsigned hashes
        F.slice(F.filter("sketch", lambda v: F.array_contains(F.col("rare"), v)), 1, keys).alias("rare"),
        F.when(F.size("often") > often_share * F.size("sketch"), F.slice(F.filter("sketch", lambda v: F.array_contains(F.col("often"), v)), 1, keys)).otherwise(F.array().cast("array<bigint>")).alias("often"),
    )
    by = materialise(by)
    no = F.lit(False).alias("linked")
    rare = by.select(F.explode("rare").alias("value"), F.lit(0).alias("left"), F.lit(0).alias("right"), "rep", "n_shingles", "sketch", F.col("rare").alias("keys"), no)
    often = by.where("size(often) > 0").select(F.explode("often").alias("value"), "rep", "n_shingles", "sketch", F.col("often").alias("keys"))
    lengths = materialise(often.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("rep", "n_shingles", "sketch"), "rep").alias("pivot")))
    short = often.join(lengths.where(F.col("n") <= block_members).select("value"), "value").select("value", F.lit(0).alias("left"), F.lit(0).alias("right"), "rep", "n_shingles", "sketch", "keys", no)
    lists, tied = rare.unionByName(short), None
    if not lengths.where(F.col("n") > block_members).isEmpty():
        long = materialise(_estimated(_salted_join(often, lengths.where(F.col("n") > block_members).select("value", "pivot"), "value"), k, least, similar))
        tied = long.where("linked").select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
        lists = lists.unionByName(_rest_against_all(long.drop("pivot"), "value", F.lit(1), block_members))
    tasks = ["value", "left", "right"]
    found = lists.repartition(*tasks).sortWithinPartitions(*tasks).mapInArrow(_list_candidates(k, keys, least, similar, common), "a long, b long")
    return found if tied is None else found.unionByName(tied)


def audit_candidates(classes: DataFrame, units: DataFrame, k: int, threshold: float, similar: float, most: int) -> tuple[int, int]:
    """Of the pairs of `most` classes, chosen by the hash of their ids, with others that an estimate puts over the
    threshold: how many are in one unit, and how many there are."""
    placed = classes.join(units.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "n_shingles", "sketch", F.coalesce("component", "rep").alias("unit"))
    asked = placed.orderBy(F.xxhash64("rep"), "rep").limit(most).toArrow()
    if not asked.num_rows:
        return 0, 0
    shared = classes.sparkSession.sparkContext.broadcast((*(asked.column(i).to_numpy() for i in (0, 1, 3)), _padded(asked.column(2), k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, size, unit, sketch = shared.value
        values, n = sketch.ravel(), sketch.shape[0]
        order = np.argsort(values, kind="stable")
        order = order[values[order] != np.uint64(0xFFFFFFFFFFFFFFFF)]
        values, query = values[order], order // k
        got = true = 0
        for batch in batches:
            lengths, flat = _lists(batch.column(2))
            flat, row = flat.view(np.uint64), np.repeat(np.arange(len(lengths)), lengths)
            first, last = np.searchsorted(values, flat, "left"), np.searchsorted(values, flat, "right")
            hits = last - first
            stops = np.cumsum(hits)
            at = np.repeat(first - stops + hits, hits) + np.arange(stops[-1] if len(stops) else 0)
            pairs = np.unique(np.repeat(row, hits) * n + query[at])
            own, other, its, wide = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy(), _padded(batch.column(2), k)
            for i in range(0, len(pairs), 50_000):
                r, q = pairs[i : i + 50_000] // n, pairs[i : i + 50_000] % n
                some = (own[r] != rep[q]) & (np.minimum(other[r], size[q]) >= similar * np.maximum(other[r], size[q]))
                r, q = r[some], q[some]
                if len(r):
                    over = union_estimate(wide[r], sketch[q], k) >= threshold
                    true += int(over.sum())
                    got += int((its[r] == unit[q])[over].sum())
        yield pa.RecordBatch.from_arrays([pa.array([got]), pa.array([true])], names=["got", "true"])

    row = placed.mapInArrow(run, "got long, true long").agg(F.sum("got").alias("got"), F.sum("true").alias("true")).first()
    return row["got"] or 0, row["true"] or 0


def candidate_recall(classes: DataFrame, units: DataFrame, k: int, threshold: float, audits: Sequence[int], links: int) -> float:
    """The share of audited links that were found; more classes are asked until so many links are met. 1 if none is."""
    for most in audits:
        got, true = audit_candidates(classes, units, k, threshold, threshold, most)
        if true >= links:
            break
    return got / true if true else 1.0


def exact_links(documents: DataFrame, members: DataFrame, words: int, similar: tuple[int, int], block_items: int) -> DataFrame:
    """Edges (a, b) that join the members (rep, component, holder, sig_a, sig_b, long) whose sets are similar, for each
    component; a member's set is that of the holder's text with these signatures."""

    def sets_of(some: DataFrame) -> DataFrame:
        wanted = F.broadcast(some) if some.count() <= BROADCAST_IDS else some
        texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.select(F.col("holder").alias("doc_id")), "doc_id", "left_semi")
        own = wanted.select("rep", F.col("component").alias("unit"), "holder", "sig_a", "sig_b")
        return full_sets(texts, words).join(own, ["holder", "sig_a", "sig_b"]).drop("holder", "sig_a", "sig_b")

    dealt, tied = sets_of(members.where("NOT long")).select("unit", F.lit(0).alias("left"), F.lit(0).alias("right"), "rep", "items", F.lit(False).alias("linked")), None
    if not members.where("long").isEmpty():
        long = materialise(sets_of(members.where("long")).select("unit", "rep", "items"))
        pivots = long.where("rep = unit").dropDuplicates(["unit"]).select("unit", F.col("items").alias("of_pivot"))
        both = F.size(F.array_intersect("items", "of_pivot"))
        union = F.size("items") + F.size("of_pivot") - both
        long = materialise(_salted_join(long, pivots, "unit").select("unit", "rep", "items", (both * similar[1] >= union * similar[0]).alias("linked")))
        tied = long.where("linked").select(F.col("rep").alias("a"), F.col("unit").alias("b"))
        dealt = dealt.unionByName(_rest_against_all(long, "unit", F.size("items"), block_items))
    tasks = ["unit", "left", "right"]
    links = dealt.repartition(*tasks).sortWithinPartitions(*tasks).mapInArrow(_verify(*similar), "a long, b long")
    return links if tied is None else links.unionByName(tied)


def near_duplicates(
    documents: DataFrame,
    words: int = 5,
    similar: tuple[int, int] = (80, 100),
    k: int = 32,
    keys: int = 8,
    common: int = 32,
    slack: float = 0.45,
    block_members: int = 1024,
    block_items: int = 2_000_000,
    audits: Sequence[int] = (128, 1024, 8192),
    audit_links: int = 300,
    recall: float = 0.99,
) -> DataFrame:
    """One row per row of the documents: doc_id, n_shingles, component_id and whether it is its component's first."""
    threshold = similar[0] / similar[1]
    signature = ["sig_a", "sig_b", "n_shingles"]
    base = materialise(sketches(documents, words, k))
    worded = "n_shingles > 0 AND doc_id IS NOT NULL"
    classes = base.where(worded).groupBy(*signature).agg(F.min("doc_id").alias("holder"), F.first("sketch").alias("sketch"))
    classes = materialise(classes.withColumn("rep", F.monotonically_increasing_id()))
    for keys, common, often_share in key_rounds(k, keys, common):
        units = materialise(connected_components(candidates(classes, k, keys, common, threshold - slack, threshold, block_members, often_share)))
        if often_share == 0 or candidate_recall(classes, units, k, threshold, audits, audit_links) >= recall:
            break

    sized = units.withColumnRenamed("node", "rep").join(classes.drop("sketch"), "rep")
    long = sized.groupBy("component").agg((F.sum("n_shingles") > block_items).alias("long"))
    members = materialise(_salted_join(sized, long, "component", 8).select("rep", "component", "long", "holder", "sig_a", "sig_b"))

    # documents with several texts: their classes hang together
    own = F.struct(*signature)
    several = base.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(own).alias("low"), F.max(own).alias("high")).where("low <> high")
    parts = base.where(worded).select("doc_id", *signature).join(several.select("doc_id"), "doc_id", "left_semi").distinct()
    parts = materialise(parts.join(classes.select(*signature, "rep"), signature).select("doc_id", "rep"))
    same = _salted_join(parts, parts.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").select(F.col("rep").alias("a"), "b").where("a <> b")

    links = exact_links(documents, members, words, similar, block_items).unionByName(same)
    components = materialise(connected_components(links)).withColumnRenamed("node", "rep")
    placed = classes.drop("sketch").join(components, "rep", "left").withColumn("unit", F.coalesce("component", "rep"))
    least = placed.groupBy("unit").agg(F.min("holder").alias("component_id"))
    named = materialise(_salted_join(placed, least, "unit", 8).select(*signature, "rep", "component_id"))

    # exact copies of one text meet in one key
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(8)).cast("int")
    spread = named.drop("rep").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    joined = base.where(worded).select("doc_id", *signature).withColumn("_salt", salt).join(spread, [*signature, "_salt"])
    of_parts = parts.join(named.select("rep", "component_id"), "rep").select("doc_id", "component_id").distinct()
    alone = base.where(f"NOT ({worded})").select("doc_id", "n_shingles").join(of_parts, "doc_id", "left")
    alone = alone.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = joined.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(documents: DataFrame, **options) -> DataFrame:
    """The documents without those that are not their component's first, with their own columns, whatever their names; all
    rows of a doc_id stay or go together."""
    gone = near_duplicates(documents, **options).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    whole = documents.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    return whole.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
