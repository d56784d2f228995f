"""Best-two-fit packing, periodic runs and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tenderspark.llm import best_fit, importance, periodic, queries


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


# Best-two-fit packing


def one_by_one(items, capacity):
    """Best-two-fit over single items; each bin as a sorted tuple."""
    items, bins = sorted(items, reverse=True), []
    while items:
        left, room, bin_ = list(items), capacity, []
        for x in items:
            if x <= room:
                bin_.append(x)
                left.remove(x)
                room -= x
        pairs = [(left[i] + left[j], left[i], left[j]) for i in range(len(left)) for j in range(i + 1, len(left))]
        if room and len(bin_) > 1 and (good := [p for p in pairs if min(bin_) < p[0] <= room + min(bin_)]):
            _, x, y = max(good)
            left.append(min(bin_))
            bin_.remove(min(bin_))
            left.remove(x)
            left.remove(y)
            bin_ += [x, y]
        items = sorted(left, reverse=True)
        bins.append(tuple(sorted(bin_)))
    return sorted(bins)


def test_fillings_are_those_of_single_items():
    rng = random.Random(7)
    for k in range(400):
        capacity = rng.choice([10, 30, 64])
        items = [x for _ in range(rng.randint(0, 30)) for x in [rng.randint(1, capacity)] * (rng.randint(1, 6) if k % 2 else 1)]
        counts = np.bincount(np.array(items, int), minlength=capacity + 1)
        got = sorted(tuple(sorted(x for x, n in use.items() for _ in range(n))) for use, times in best_fit.fillings(counts, capacity) for _ in range(times))
        assert got == one_by_one(items, capacity)


def test_exchange_of_the_shortest():
    """60 and 30 leave 10 free, in which nothing fits; 20 and 19 fill the place of 30 and the rest to 99."""
    counts = np.zeros(101, int)
    counts[[60, 30, 20, 19]] = 1
    assert list(best_fit.fillings(counts, 100)) == [({60: 1, 20: 1, 19: 1}, 1), ({30: 1}, 1)]


def check_whole_packing(rows, docs, capacity=1024):
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    ids = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids[r.doc_id, tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2])] += 1
    want, sequences = Counter(), {}
    for (doc_id, x), n in ids.items():
        first = len(x) % capacity or capacity
        cuts = [0, *range(first, len(x) + 1, capacity)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, i, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())] += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    lengths = [r.length for r in rows]
    return sorted(tuple(sorted(n for _, n in parts)) for parts in sequences.values()), lengths


def test_best_fit_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bins, lengths = check_whole_packing(queries.op11_best_fit_packing(spark, sf_dir).collect(), docs)
    assert bins == one_by_one(lengths, 1024)
    again, _ = check_whole_packing(best_fit.pack_whole(docs.repartition(5), queries.TOKENIZER).collect(), docs)
    assert again == bins  # however rows are dealt to tasks


def test_best_fit_cases(spark, odd_documents):
    more = odd_documents.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long"))
    docs = odd_documents.unionByName(odd_documents.where("doc_id IN (4, 6)")).unionByName(more)
    packed = best_fit.pack_whole(docs, queries.TOKENIZER, keep_ids=True)
    rows = packed.collect()
    check_whole_packing(rows, docs)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert best_fit.pack_whole(docs.limit(0), queries.TOKENIZER).count() == 0


# Periodic runs


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(w[i : j + q - p] == w[i + p : j + q] for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_every_period():
    rng, found = random.Random(3), 0
    for _ in range(1200):
        k, n, w = rng.choice([1, 2, 3, 5, 50]), rng.randint(0, 160), []
        while len(w) < n:
            base = [rng.randrange(k) for _ in range(rng.randint(1, 14))]
            if rng.random() < 0.4:
                base = base * rng.randint(1, 5) + [99]
            w += base if rng.random() < 0.3 else (base * 9)[: rng.randint(1, 8 * len(base))]
        runs = periodic.runs_of(np.array(w[:n], np.int64))
        assert runs == plain_runs(w[:n])
        found += len(runs)
    assert found > 1000


@pytest.mark.parametrize("n", [40, 999, 200_000])
def test_runs_in_runs(n):
    """One word, and one word with marks in between: the runs of the marks, and those of the word between them."""
    assert periodic.runs_of(np.zeros(n, np.int64)) == [(0, n, 1)]
    gap = n // 5
    marked = (np.arange(5 * gap) % gap == 0).astype(np.int64)
    inner = [(k * gap + 1, gap - 1, 1) for k in range(5)] if gap > 6 else []
    assert periodic.runs_of(marked) == sorted([(0, 5 * gap, gap), *inner])


def plain_digests(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(kept))


def test_periodic_runs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    small = docs.where("length(text) < 6000")
    got = periodic.run_digests(periodic.periodic_runs(small, periodic.planted_loop)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_digests(d, t) for d, t in texts_of(small).items())
    assert queries.op12_periodic_runs(spark, sf_dir).where("n_runs > 0").count() > 5


def test_periodic_cases(spark, odd_documents):
    docs = odd_documents.unionByName(odd_documents.where("doc_id = 4")).unionByName(odd_documents.where("doc_id = 8").withColumn("doc_id", F.lit(None).cast("long")))
    rows = {r.doc_id: r for r in periodic.periodic_runs(docs).collect()}
    assert rows[6].runs == [(0, 240_000, 8)] and rows[6].strongest == 0 and rows[6].text == "long words of a text without any end"
    assert (rows[1].n_words, rows[1].runs, rows[1].text) == (0, [], "") and rows[3].text == "" and rows[None].text == "a"
    assert sum(r.doc_id == 4 for r in periodic.periodic_runs(docs).collect()) == 2
    for r in periodic.run_digests(periodic.periodic_runs(docs.where("doc_id <> 6 OR doc_id IS NULL"), periodic.planted_loop)).collect():
        assert tuple(r) == plain_digests(r.doc_id, texts_of(docs)[r.doc_id] or "")
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_words_of_a_long_text_in_blocks():
    text = "  é one\u00a0two\x0bthree\x1cfour \n one".encode() * 50
    for block in (1, 7, 1 << 20):
        ids, words = periodic.number_words(text, block)
        assert [words[i].decode() for i in ids] == re.findall(r"[^\x20\x09-\x0D]+", text.decode())


# Importance resampling


def plain_resample(docs, target, grams=(1, 1), buckets=10_000, least=20, percent=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    def features(w):
        return [" ".join(w[i : i + n]) for n in range(grams[0], grams[1] + 1) for i in range(len(w) - n + 1)]

    crc = lambda f: zlib.crc32(f.encode()) % buckets
    rows = [(d, len(w := words(t)), list(map(crc, features(w)))) for d, t in docs]
    s, t = Counter(b for *_, x in rows for b in x), Counter(crc(f) for x in target for f in features(words(x)))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for d, n, x in rows:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in x)
        h = int(hashlib.sha256(f"2024:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    good = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(good[: percent * len(good) // 100], 1):
        r[4] = k
    return sorted(map(repr, (tuple(r[:5]) for r in out)))


@pytest.mark.parametrize("grams", [(1, 1), (1, 2)])
def test_resampling(spark, sf_dir, odd_documents, grams):
    docs, target = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    both = docs.select("doc_id", "text").unionByName(odd_documents.selectExpr("doc_id + 1000000 AS doc_id", "text")).unionByName(odd_documents.where("doc_id = 6").selectExpr("CAST(NULL AS bigint) AS doc_id", "text"))
    got = importance.resample(both.repartition(7), target, grams=grams).collect()
    want = plain_resample([tuple(r) for r in both.collect()], [r.text for r in target.collect()], grams)
    assert sorted(repr(tuple(r)) for r in got) == want
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, sum(r["rank"] is not None for r in got) + 1))


def test_resampling_cases(spark, odd_documents):
    none = odd_documents.limit(0)
    assert importance.resample(none, odd_documents).count() == 0
    many = odd_documents.where("doc_id = 6").crossJoin(spark.range(40).select(F.col("id").alias("copy")))  # equal rows, all drawn from by ties
    rows = importance.resample(many, none, percent=25).collect()
    assert len(rows) == 40 and sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 11))
    drawn = importance.draw(odd_documents.withColumn("_drawn", F.lit(1)), odd_documents, percent=100)
    assert drawn.columns == [*odd_documents.columns, "_drawn"] and [r.doc_id for r in drawn.collect()] == [6]
