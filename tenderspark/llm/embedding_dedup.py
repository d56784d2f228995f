"""Operator 2: embedding near-dedup by a robust-pruned flat graph.

1. Equal vectors are one class. Of a bounded sample, the leaders of dense balls are found, with neighbours counted by
   tasks: vectors nearer to a leader than half the linking angle all link with each other, so a ball that holds a third
   of all rows is counted, not compared. Its links to vectors outside are counted exactly in blocks, against those near
   enough to the leader.
2. All other classes go to the shards of their `overlap` nearest of at most `most_shards` centroids, which are fitted on
   the sample; a shard over `block_rows` is dealt as pairs of blocks. Each task builds a robust-pruned graph.
3. The adjacency lists that a vector got in its shards are united, and each task searches its part of the united graph
   greedily from its medoid for every member, whose own place is not given away, then expands the range: what links is
   expanded until nothing new links.
4. Found pairs are verified by their cosine in double precision. A pair counts in the first task that both share, so
   that no pair leaves a task: tasks give out counts and spanning trees, whose components are joined over all tasks.
5. The recall is audited against brute force for `audit` vectors, more where those have few links; under `recall` the
   search runs again with twice the overlap and beam. If the last try is under it too, all pairs of up to `exact_rows`
   classes are compared in blocks; with more, the query fails and says what recall it had.

All of this runs for each width of vectors with more than `block_rows` classes, and for the commonest; of the other
widths all pairs are compared in blocks.

Defined cases: vectors that are null, empty, zero or that hold null or non-finite components link with nothing; so do
vectors of different lengths with each other; rows that repeat a vec_id are vectors of their own and link if their vectors do; a row without a vec_id
is no link and has no component, but is kept; an empty table gives an empty result. Only vec_id and embedding are read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components

#: Sampled members from which a ball is dense; so a sample has at most a 24th as many balls as rows.
DENSE = 24


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    c = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy().reshape(len(c), -1) if len(c) else np.zeros((0, 1))


def unit_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors of length one in double precision; null where a vector links with nothing."""
    e = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    # scaled first, so that squares neither overflow nor vanish
    most = F.array_max(F.transform("e", lambda x: F.abs(x)))
    usable = (F.size("e") > 0) & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.col("most") > 0)
    scaled = df.select(F.col(id_col).cast("long").alias("vec_id"), e.alias("e")).withColumn("most", most).select("vec_id", F.when(usable, F.transform("e", lambda x: x / F.col("most"))).alias("e"))
    length = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    return scaled.withColumn("n", length).select("vec_id", F.transform("e", lambda x: x / F.col("n")).alias("v"))


def centroids_of(sample: np.ndarray, k: int, rounds: int = 4, seed: int = 5) -> np.ndarray:
    """Spherical k-means over the sample."""
    rng = np.random.default_rng(seed)
    k = min(k, len(sample))
    c = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds if k > 1 else 0):
        at = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, at, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-300), c)
    return c


def neighbour_counts(rows: DataFrame, sample: np.ndarray, inner: float) -> np.ndarray:
    """How many of the sample are near each of its rows; tasks take slices of the numbers (n) in `rows`."""
    shared = rows.sparkSession.sparkContext.broadcast(sample.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            n = batch.column(0).to_numpy()
            counts = [(w[n[i : i + 256]] @ w.T >= inner).sum(1) for i in range(0, len(n), 256)]
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())], names=["n", "near"])

    found = rows.mapInArrow(run, "n long, near long").where(F.col("near") >= DENSE).toArrow()
    out = np.zeros(len(sample), np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def dense_leaders(sample: np.ndarray, inner: float, counts: np.ndarray) -> np.ndarray:
    """Leaders of the balls (cosine >= inner) that hold at least DENSE of the sample, given each row's neighbours there."""
    left, leaders = counts >= DENSE, []
    for i in np.argsort(-counts, kind="stable"):
        if left[i]:
            near = sample @ sample[i] >= inner
            left[near] = False
            middle = sample[near].mean(axis=0)
            leaders.append(middle / np.linalg.norm(middle))
    return np.array(leaders).reshape(len(leaders), sample.shape[1])


def robust_graph(v: np.ndarray, candidates: int, degree: int, alpha: float) -> np.ndarray:
    """Adjacency rows of at most `degree` neighbours, filled up with -1: of the nearest `candidates`, one is left out if
    a kept one is `alpha` times nearer to it than the vector itself."""
    n = len(v)
    c = min(candidates, n - 1)
    out = np.full((n, degree), -1, np.int32)
    if c <= 0:
        return out
    w = v.astype(np.float32)
    for a in range(0, n, 256):
        b = min(a + 256, n)
        sim = w[a:b] @ w.T
        sim[np.arange(b - a), np.arange(a, b)] = -2
        near = np.argpartition(-sim, c - 1, axis=1)[:, :c]
        s = np.take_along_axis(sim, near, 1)
        order = np.argsort(-s, axis=1, kind="stable")
        near, s = np.take_along_axis(near, order, 1), np.take_along_axis(s, order, 1)
        own = np.maximum(1 - s, 0)  # half the squared distance
        between = 1 - np.matmul(w[near], w[near].transpose(0, 2, 1))
        open_, count = np.ones((b - a, c), bool), np.zeros(b - a, np.int64)
        for j in range(c):
            take = np.flatnonzero(open_[:, j] & (count < degree))
            out[a + take, count[take]] = near[take, j]
            count[take] += 1
            open_[take] &= alpha * alpha * between[take, j] > own[take]
    return out


def greedy_range_search(v: np.ndarray, adjacency: np.ndarray, start: int, queries: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For members `queries`: pairs (number in queries, member found with cosine >= least), itself left out."""
    n, q = len(v), len(queries)
    w = v.astype(np.float32)
    x = w[queries]
    seen = np.zeros((q, n), bool)
    seen[:, start] = True
    pool = np.full((q, beam), -1, np.int32)
    score = np.full((q, beam), -np.inf, np.float32)
    done = np.ones((q, beam), bool)
    pool[:, 0], score[:, 0], done[:, 0] = start, x @ w[start], False
    live = np.arange(q)
    while len(live):
        best = np.where(done[live], -np.inf, score[live]).argmax(1)
        go = ~done[live, best]
        live, best = live[go], best[go]
        if not len(live):
            break
        done[live, best] = True
        near = adjacency[pool[live, best]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        row, col = np.nonzero(fresh)
        seen[live[row], near[row, col]] = True
        s = np.full(near.shape, -np.inf, np.float32)
        s[row, col] = np.einsum("ij,ij->i", w[near[row, col]], x[live[row]])
        all_s = np.concatenate([score[live], s], 1)
        keep = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        score[live] = np.take_along_axis(all_s, keep, 1)
        pool[live] = np.take_along_axis(np.concatenate([pool[live], near], 1), keep, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], 1), keep, 1)
    # range expansion from what links; the member itself, if the search came upon it, is one of those
    linked = np.zeros((q, n), bool)
    row, col = np.nonzero((pool >= 0) & (score >= least - 1e-4))
    linked[row, pool[row, col]] = True
    tried = linked.copy()
    row, col = np.nonzero(linked)
    while len(row):
        near = adjacency[col]
        r, c = np.nonzero(near >= 0)
        key = np.unique(row[r].astype(np.int64) * n + near[r, c])
        key = key[~tried.ravel()[key]]
        tried.ravel()[key] = True
        row, col = key // n, key % n
        good = np.einsum("ij,ij->i", w[col], x[row]) >= least - 1e-4 if len(row) else np.zeros(0, bool)
        row, col = row[good], col[good]
        linked[row, col] = True
    linked[np.arange(q), queries] = False
    row, col = np.nonzero(linked)
    exact = np.concatenate([np.einsum("ij,ij->i", v[queries[row[i : i + 65536]]], v[col[i : i + 65536]]) for i in range(0, len(row), 65536)]) if len(row) else np.zeros(0)
    return row[exact >= least], col[exact >= least]


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (shard, left, right) of a partition sorted by them."""
    held, key = [], None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], 1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            if b > a:
                if key is not None and tuple(keys[a]) != key:
                    yield pa.Table.from_batches(held)
                    held = []
                key = tuple(keys[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _nearest(classes: DataFrame, centres: np.ndarray, overlap: int) -> DataFrame:
    """Add to (rep, v, times) the numbers of the nearest centres, first the nearest."""
    shared = classes.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        m = min(overlap, len(c))
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1))
            at = np.concatenate([np.argsort(-(v[i : i + 2048] @ c.T), axis=1, kind="stable")[:, :m] for i in range(0, len(v), 2048)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * m, pa.int32()), pa.array(np.sort(at, 1).ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lists], names=["rep", "v", "times", "shards"])

    return classes.select("rep", "v", "times").mapInArrow(run, "rep long, v array<double>, times long, shards array<int>")


def _dealt(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows by task (shard, left, right), with the blocks of all their shards: one task a shard, or one for each pair of
    its blocks."""
    flat = rows.withColumn("shard", F.explode("shards"))
    # at most as many rows as there are centroids
    blocks = flat.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep", "shard"), F.col("blocks")).cast("int")
    placed = flat.join(F.broadcast(blocks), "shard").withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return placed.withColumn("other", other).select("shard", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "own", "rep", "v", "times", "shards", *[c for c in rows.columns if c not in ("rep", "v", "times", "shards")])


def _search(least: float, beam: int, degree: int):
    """From the rows of each task with united adjacency lists: counts of links for each class, and tree edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tasks(batches):
            shard, left, right = (t.column(i)[0].as_py() for i in range(3))
            own, rep, times = (t.column(i).to_numpy() for i in (3, 4, 6))
            v, n = _matrix(t.column(5)), t.num_rows
            if n < 2:
                continue
            # the first shard that two members share: theirs are sorted
            shards = pa.concat_arrays(t.column(7).chunks)
            counts = np.diff(shards.offsets.to_numpy())
            mine = np.full((n, counts.max()), -1, np.int32)
            mine[np.arange(counts.max()) < counts[:, None]] = shards.flatten().to_numpy()
            lists = pa.concat_arrays(t.column(8).chunks)
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            order = np.argsort(rep)
            at = np.minimum(np.searchsorted(rep[order], flat), n - 1)
            here = rep[order][at] == flat
            row = np.repeat(np.arange(n), sizes)[here]
            col = order[at[here]]
            # lists of up to `overlap` shards go back to rows of even width
            rank = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))[:-1]]), np.bincount(row, minlength=n))
            adjacency = np.full((n, max(degree, int(rank.max(initial=0)) + 1)), -1, np.int32)
            adjacency[row, rank] = col
            middle = v.mean(axis=0)
            start = int((v @ middle).argmax())
            pairs_a, pairs_b = [], []
            step = max(16, min(512, 4_000_000 // n))
            for a in range(0, n, step):
                queries = np.arange(a, min(a + step, n))
                r, c = greedy_range_search(v, adjacency, start, queries, least, beam)
                if len(r):
                    pairs_a.append(queries[r])
                    pairs_b.append(c)
            if not pairs_a:
                continue
            a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
            key = np.unique(np.minimum(a, b).astype(np.int64) * n + np.maximum(a, b))
            a, b = key // n, key % n
            first = np.full(len(a), np.iinfo(np.int32).max)
            for i in range(mine.shape[1]):
                hit = ((mine[a][:, i : i + 1] == mine[b]) & (mine[b] >= 0)).any(1)
                first = np.where(hit & (mine[a, i] >= 0), np.minimum(first, mine[a, i]), first)
            mine_here = (first == shard) & (np.minimum(own[a], own[b]) == left) & (np.maximum(own[a], own[b]) == right)
            links = np.bincount(a[mine_here], times[b[mine_here]], n) + np.bincount(b[mine_here], times[a[mine_here]], n)
            some = np.flatnonzero(links)
            yield _found(rep, least_in_tree(n, a, b, rep), links)

    return run


def least_in_tree(n: int, a: np.ndarray, b: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """The smallest id in the component of each of n members that edges (a, b) join."""
    least = rep.copy()
    while True:
        low = np.minimum(least[a], least[b])
        before = least.copy()
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        if (before == least).all():
            return least


_FOUND = "a long, b long, links long"


def _found(rep: np.ndarray, root: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero((rep != root) | (links > 0))
    return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(root[some]), pa.array(links[some].astype(np.int64))], names=["a", "b", "links"])


def _graphs(candidates: int, degree: int, alpha: float):
    """From the rows of each task: (rep, list) with each member's robust-pruned neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tasks(batches):
            rep, v = t.column(4).to_numpy(), _matrix(t.column(5))
            near = robust_graph(v, candidates, degree, alpha)
            sizes = (near >= 0).sum(1)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(rep[near[near >= 0]], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(rep), lists], names=["rep", "list"])

    return run


def _in_balls(classes: DataFrame, leaders: np.ndarray, inner: float, outer: float) -> DataFrame:
    """Add to (rep, v, times) the dense ball that a vector is in, if any, and the others that it may link with."""
    shared = classes.sparkSession.sparkContext.broadcast(leaders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = _matrix(batch.column(1)) @ shared.value.T
            best = near.argmax(1)
            inside = near[np.arange(len(best)), best] >= inner
            close = near >= outer
            close[np.flatnonzero(inside), best[inside]] = False
            fringe = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(close.sum(1))]), pa.int32()), pa.array(np.nonzero(close)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(best.astype(np.int32), mask=~inside), fringe], names=["rep", "v", "times", "ball", "fringe"])

    return classes.select("rep", "v", "times").mapInArrow(run, "rep long, v array<double>, times long, ball int, fringe array<int>")


def _fringe_links(placed: DataFrame, least: float, block_rows: int) -> DataFrame:
    """Exact links between members of a ball and near vectors outside it, in pairs of blocks of either side. A pair whose
    other vector is in a ball itself counts for that vector alone, as it is met once more the other way."""
    members = placed.where("ball IS NOT NULL").select("ball", "rep", "v", "times")
    outside = placed.where("size(fringe) > 0").select(F.explode("fringe").alias("ball"), "rep", "v", "times", F.col("ball").isNotNull().alias("inside"))
    # at most a 24th as many rows as the sample has
    blocks = members.groupBy("ball").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("m")).join(outside.groupBy("ball").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("f")), "ball")

    def dealt(rows: DataFrame, own: str, other: str, side: int, inside: Column) -> DataFrame:
        placed_ = rows.join(F.broadcast(blocks), "ball").withColumn("_own", F.pmod(F.xxhash64("rep"), F.col(own)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        m, f = ("_own", "_other") if side == 0 else ("_other", "_own")
        return placed_.select("ball", F.col(m).alias("left"), F.col(f).alias("right"), F.lit(side).alias("side"), "rep", "v", "times", inside.alias("inside"))

    both = dealt(members, "m", "f", 0, F.lit(True)).unionByName(dealt(outside, "f", "m", 1, F.col("inside")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tasks(batches):
            side, rep, times = (t.column(i).to_numpy() for i in (3, 4, 6))
            v, inside = _matrix(t.column(5)), t.column(7).to_numpy()
            m, f = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            links, root = np.zeros(len(rep), np.int64), rep.copy()
            for i in range(0, len(f), 512):
                some = f[i : i + 512]
                hit = v[some] @ v[m].T >= least
                links[some] += hit @ times[m]
                links[m] += times[some][~inside[some]] @ hit[~inside[some]]
                touched = hit.any(1)
                root[some[touched]] = rep[m[hit[touched].argmax(1)]]
            yield _found(rep, root, links)

    return both.repartition("ball", "left", "right").sortWithinPartitions("ball", "left", "right").mapInArrow(run, _FOUND)


def exact_links(classes: DataFrame, least: float, block_rows: int) -> DataFrame:
    """(a, b, links) among classes (rep, v, times) by comparing all pairs of each width, in pairs of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tasks(batches):
            order = np.argsort(t.column(4).to_numpy())
            own, rep, times = (t.column(i).to_numpy()[order] for i in (3, 4, 6))
            v, n, same = _matrix(t.column(5))[order], len(order), t.column(1)[0] == t.column(2)[0]
            links, top = np.zeros(n, np.int64), np.arange(n)
            for i in range(0, n, 512):
                some = np.arange(i, min(i + 512, n))
                hit = v[some] @ v.T >= least
                # a pair of two blocks leaves pairs within either to that block's own task
                hit &= some[:, None] != np.arange(n) if same else own[some][:, None] != own
                links[some] = hit @ times
                a, b = np.nonzero(hit)
                top = least_in_tree(n, np.concatenate([some[a], np.arange(n)]), np.concatenate([b, top]), np.arange(n))
            yield _found(rep, rep[top], links)

    tasks = ["shard", "left", "right"]
    return _dealt(classes.withColumn("shards", F.array(F.size("v"))), block_rows).repartition(*tasks).sortWithinPartitions(*tasks).mapInArrow(run, _FOUND)


def graph_links(classes: DataFrame, sample: np.ndarray, least: float, overlap: int = 3, beam: int = 24, candidates: int = 40, degree: int = 20, alpha: float = 1.2, shard_rows: int = 1500, block_rows: int = 6000, most_shards: int = 4096) -> DataFrame:
    """(a, b, links) found by the flat graph among classes (rep, v, times): a's links in a task, b its tree's least."""
    n = classes.count()
    centres = centroids_of(sample, min(most_shards, max(1, math.ceil(overlap * n / shard_rows))))
    near = materialise(_nearest(classes, centres, overlap))
    tasks = ["shard", "left", "right"]
    graph = _dealt(near, block_rows).repartition(*tasks).sortWithinPartitions(*tasks).mapInArrow(_graphs(candidates, degree, alpha), "rep long, list array<long>")
    united = graph.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("list"))).alias("list"))
    searched = _dealt(near.join(united, "rep"), block_rows).repartition(*tasks).sortWithinPartitions(*tasks)
    return materialise(searched.mapInArrow(_search(least, beam, degree), _FOUND))


def audit_recall(classes: DataFrame, found: DataFrame, least: float, most: int = 1024, enough: int = 300) -> float:
    """Share of the true links of `most` vectors, chosen by the hash of their ids, that were found. As long as these have
    fewer than `enough` links, twice as many are asked, 16 times `most` in the end."""
    for n in (most << i for i in range(5)):
        share, true = _recall_of(classes, found, least, n)
        if true >= enough:
            break
    return share


def _recall_of(classes: DataFrame, found: DataFrame, least: float, most: int) -> tuple[float, int]:
    asked = classes.orderBy(F.xxhash64("rep"), "rep").select("rep", "v", "times").limit(most).toArrow()
    if asked.num_rows < 2:
        return 1.0, most
    ids, queries = asked.column(0).to_numpy(), _matrix(asked.column(1))
    shared = classes.sparkSession.sparkContext.broadcast((ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        total = np.zeros(len(own), np.int64)
        for batch in batches:
            if batch.num_rows:
                times = batch.column(2).to_numpy()
                rep, v = batch.column(0).to_numpy(), _matrix(batch.column(1))
                for i in range(0, len(own), 1024):
                    hit = q[i : i + 1024] @ v.T >= least
                    hit &= own[i : i + 1024, None] != rep[None, :]
                    total[i : i + 1024] += hit @ times
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own[some]), pa.array(total[some])], names=["a", "true"])

    true = classes.select("rep", "v", "times").mapInArrow(run, "a long, true long").groupBy("a").agg(F.sum("true").alias("true"))
    got = found.groupBy("a").agg(F.sum("links").alias("links"))
    row = true.join(got, "a", "left").agg(F.sum(F.least("true", F.coalesce("links", F.lit(0)))).alias("got"), F.sum("true").alias("true")).first()
    return (row["got"] / row["true"] if row["true"] else 1.0), (row["true"] or 0) if asked.num_rows == most else most


def link_vectors(vectors: DataFrame, similar: float = 0.9, sample_bytes: int = 16 << 20, recall: float = 0.99, tries: int = 3, audit: int = 1024, exact_rows: int = 200_000, overlap: int = 3, beam: int = 24, block_rows: int = 6000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept."""
    half = math.acos(similar) / 2 - 1e-3
    inner, outer = math.cos(half), math.cos(min(math.pi, math.acos(similar) + half + 1e-6))
    base = materialise(unit_vectors(vectors, id_col, vector_col).withColumns({"sig_a": F.xxhash64("v"), "sig_b": F.xxhash64(F.lit(7), "v")}))
    good = base.where("v IS NOT NULL AND vec_id IS NOT NULL")
    classes = materialise(good.groupBy("sig_a", "sig_b").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times"), F.first("v").alias("v")))
    # a row a width
    sizes = classes.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").collect()
    widths = [r["width"] for i, r in enumerate(sizes) if i == 0 or r["count"] > block_rows]
    parts, dense = [], []
    for width in widths:
        even = classes.where(F.size("v") == width).select("rep", "v", "times")
        sample = _matrix(even.orderBy(F.xxhash64("rep"), "rep").limit(max(256, sample_bytes // (8 * width))).select("v").toArrow().column(0).combine_chunks())
        numbers = even.sparkSession.range(0, len(sample), 1, max(1, min(64, len(sample) // 512)))
        leaders = dense_leaders(sample, inner, neighbour_counts(numbers.withColumnRenamed("id", "n"), sample, inner))
        loose = sample
        if len(leaders):
            placed = materialise(_in_balls(even, leaders, inner, outer))
            of_width = placed.where("ball IS NOT NULL").groupBy("ball").agg(F.sum("times").alias("total"), F.min("rep").alias("root"))
            dense.append(placed.where("ball IS NOT NULL").select("rep", "ball").join(F.broadcast(of_width), "ball").select("rep", "root", "total"))
            parts.append(materialise(_fringe_links(placed, similar, block_rows)))
            even = placed.where("ball IS NULL").select("rep", "v", "times")
            loose = sample[(sample @ leaders.T).max(axis=1) < inner]
        if len(loose) > 0 or not even.isEmpty():
            loose = loose if len(loose) else np.eye(1, width)
            for n in range(tries):
                found = graph_links(even, loose, similar, overlap << n, beam << n, block_rows=block_rows)
                if (got := audit_recall(even, found, similar, audit)) >= recall:
                    break
            else:
                if even.count() > exact_rows:
                    raise RuntimeError(f"recall {got:.3f} of links after {tries} tries, {recall} wanted")
                found = materialise(exact_links(even, similar, block_rows))
            parts.append(found)
    if len(widths) < len(sizes):
        parts.append(materialise(exact_links(classes.where(~F.size("v").isin(widths)).select("rep", "v", "times"), similar, block_rows)))
    counts = functools.reduce(DataFrame.unionByName, parts, base.sparkSession.createDataFrame([], _FOUND))
    balls = functools.reduce(DataFrame.unionByName, dense) if dense else None

    edges = counts.where("a <> b").select("a", "b")
    own = classes.select("sig_a", "sig_b", "rep", "times")
    if balls is not None:
        # a ball is one node, its root; balls' members are joined, not collected
        roots = balls.select("rep", "root")
        edges = edges.join(roots.withColumnRenamed("rep", "a"), "a", "left").select(F.coalesce("root", "a").alias("a"), "b").join(roots.withColumnRenamed("rep", "b"), "b", "left").select("a", F.coalesce("root", "b").alias("b"))
        own = own.join(balls, "rep", "left").select("sig_a", "sig_b", "rep", "times", F.coalesce("root", "rep").alias("node"), F.coalesce(F.col("total") - F.col("times"), F.lit(0)).alias("in_ball"))
    else:
        own = own.select("*", F.col("rep").alias("node"), F.lit(0).alias("in_ball"))
    components = connected_components(edges)
    links = counts.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    named = own.join(links, "rep", "left").join(components, "node", "left").select("sig_a", "sig_b", (F.col("times") - 1 + F.col("in_ball") + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = good.select("vec_id", "sig_a", "sig_b").join(named, ["sig_a", "sig_b"]).select("vec_id", "n_links", "component_id")
    alone = base.where("v IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def keep_first(vectors: DataFrame, id_col: str = "vec_id", **options) -> DataFrame:
    """The vectors without those that are not their component's first, with their own columns, whatever their names."""
    gone = link_vectors(vectors, id_col=id_col, **options).where("NOT kept").select(F.col("vec_id").alias("_gone")).distinct()
    whole = vectors.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"))
    return whole.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
