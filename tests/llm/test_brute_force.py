"""Operators that SQL cannot express, against plain versions of their results; edge cases of every stage."""

import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tenderspark.llm import bpe, chat, embedding_dedup, langid, near_dedup, packing, quality, queries, sharding, token_scan, toxicity
from tenderspark.llm.components import connected_components


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_regular_strings_do_not_collide(spark):
    """Strings that share a polynomial hash modulo 2**64 with every base."""
    texts = [thue_morse(n, x) for n in (1024, 2048, 4096) for x in ("ab", "ba")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    t = Tokenizer.from_file(queries.TOKENIZER)
    ids = [t.encode(x, add_special_tokens=False).ids for x in texts]
    for r in bpe.round_trip_digests(docs, queries.RANKS, public_tokenizers.PATTERN).collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(np.array(ids[r.doc_id], "<u4").tobytes()).hexdigest()
    for r in packing.pack_documents(docs, queries.TOKENIZER).collect():
        part = np.array([*ids[r.doc_id], 0], "<u4")[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(part.tobytes())
    assert {r.doc_id: r.n_tokens for r in token_scan.token_counts(docs, queries.TOKENIZER, queries.END_ID).collect()} == {i: len(x) for i, x in enumerate(ids)}
    assert all(r.kept for r in near_dedup.near_duplicates(docs, words=3, similar=(85, 100)).collect())


def test_pieces_whose_hashes_collide(monkeypatch):
    """With 50 hashes in all, every piece still gets its own ids."""
    import pyarrow as pa

    real = bpe.hash_spans
    monkeypatch.setattr(bpe, "hash_spans", lambda *a: real(*a) % np.uint64(50))
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("abcdeé漢"), rng.integers(1, 6))) for _ in range(60)) for _ in range(40)]
    t = Tokenizer.from_file(queries.TOKENIZER)
    got = []
    for _, ids, counts in bpe.Encoder(queries.TOKENIZER).encode(pa.array(texts)):
        got += np.split(ids, np.cumsum(counts)[:-1])
    assert [x.tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_another_splitting_pattern_is_refused():
    with pytest.raises(ValueError):
        bpe.Encoder(queries.RANKS, r"\w+|\W+")
    with pytest.raises(ValueError):
        bpe.Encoder(public_tokenizers.path("word_bpe_49k.json"))


def plain_shard(key, shards):
    def score(i):
        n = int(hashlib.md5(f"{key}/{i}".encode()).hexdigest()[:13], 16)
        return -1.0 / math.log((n + 0.5) / 16**13)

    return max(range(shards), key=lambda i: (score(i), -i))


def test_sharding_takes_the_highest_score(spark, sf_dir, odd_documents):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd_documents.unionByName(odd_documents)):
        rows = sharding.shard_documents(docs).collect()
        for r in rows:
            assert (r.shard, r.grown_shard) == (plain_shard(r.doc_id, 40), plain_shard(r.doc_id, 41))
        salt = lambda r: int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:4], 16) % sharding.SALTS
        for shard in {r.shard for r in rows}:
            own = sorted((r for r in rows if r.shard == shard), key=lambda r: (salt(r), r.doc_id, r.text_crc32, r.size))
            assert [r.slot for r in sorted(own, key=lambda r: r.slot)] == list(range(len(own)))
            assert all(a.slot < b.slot for a, b in zip(own, own[1:]) if a[:3] != b[:3])


def test_a_record_repeated_many_times_gets_all_slots(spark):
    df = spark.range(250_003).select(F.lit(5).alias("k"), F.lit("x").alias("shard"))
    got = sharding.add_slots(df, "shard", ["k"]).agg(F.count("*"), F.min("slot"), F.max("slot"), F.countDistinct("slot")).first()
    assert tuple(got) == (250_003, 0, 250_002, 250_003)


def plain_scores(model, text):
    text, out = text.lower(), model.prior.copy()
    points = np.array([ord(c) for c in text], np.uint32)
    for n in range(1, model.orders + 1):
        for i in range(len(text) - n + 1):
            at = dict(langid.ngram_buckets(points[i : i + n], n, len(model.matrix)))[n][0]
            out = out + model.matrix[at]
    return out


def test_language_scores_come_from_a_texts_own_ngrams(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs, F.col("lang"), F.col("text"))
    rng = np.random.default_rng(0)
    texts = ["foo", "bar", "", "a", "ΑΣ ΑΣ", "İ x", "漢😀" * 40] + ["".join(rng.choice(list("abc défΣ"), rng.integers(0, 60))) for _ in range(20)]
    expected = np.array([plain_scores(model, t) for t in texts])
    for block in (1 << 18, 7, 31):  # with short blocks most texts are cut
        assert np.abs(model.scores(texts, block) - expected).max() < 1e-9
    short = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 5)], "doc_id bigint, text string").unionByName(docs.select("doc_id", "text"))
    results = [sorted(map(tuple, langid.predict(short.repartition(n), model).collect())) for n in (1, 17)]
    assert results[0] == results[1]


def test_language_counts_are_plain_counts(spark):
    rows = [("a", "abab"), ("b", "xyz"), ("a", "ba"), (None, "abc"), ("b", None)]
    df = spark.createDataFrame(rows, "lang string, text string")
    buckets = 1 << 10
    expected = {}
    for lang, text in rows:
        if lang and text is not None:
            points = np.array([ord(c) for c in text], np.uint32)
            expected[lang, -1] = expected.get((lang, -1), 0) + 1
            for n, found in langid.ngram_buckets(points, 3, buckets):
                for x in found.tolist():
                    expected[lang, x] = expected.get((lang, x), 0) + 1
    assert {(r.lang, r.bucket): r.n for r in langid.count_ngrams(df, F.col("lang"), F.col("text"), 3, buckets).collect()} == expected


def test_number_signs_are_no_letters():
    assert not any(map(langid.has_letter, ["½", "² Ⅷ 7_", "", "…"])) and langid.has_letter("½é")


def plain_toxicity(machine, text):
    found, _ = toxicity.term_buckets(*toxicity._lowered(__import__("pyarrow").array([text])))
    total = float(machine.bias) + sum(float(machine.weight[t]) for t in found)
    v = [[float(x) for x in machine.factor[t]] for t in found]
    total += sum(sum(x * y for x, y in zip(v[i], v[j])) for i in range(len(v)) for j in range(i))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def test_toxicity_query(spark, sf_dir):
    """Scores are the machine's, pair by pair; held-out labels change nothing, and are told apart."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = {r.doc_id: r for r in queries.op8_toxicity(spark, sf_dir).collect()}
    held = queries.fold_of_id(4) == 2
    machine = toxicity.train(docs, labels, ~held)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for i in sorted(texts, key=lambda i: len(texts[i]))[:60]:
        assert rows[i].score == pytest.approx(plain_toxicity(machine, texts[i]), abs=1e-6)
    assert all(r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = toxicity.train(docs, flipped, ~held)
    assert (other.weight == machine.weight).all() and (other.factor == machine.factor).all()


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"  # smaller tables have too few toxic documents to learn from
    got = {r.doc_id: r.score for r in queries.op8_toxicity(spark, folder).where("held_out").collect()}
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.doc_id in got}
    bad, good = [got[i] for i in y if y[i]], [got[i] for i in y if not y[i]]
    assert len(bad) > 50 and np.mean([a > b for a in bad for b in good]) > 0.85


def plain_estimates(groups, floors, lang_of):
    """Centre and covariance of each group by minimum covariance determinants, with exact quantiles."""
    floor = np.diag(np.square(floors))
    p = len(floors)

    def distance(x, m, c):
        d = x - m
        return np.einsum("ij,ij->i", d @ np.linalg.inv(c), d)

    def middle(cells):
        cells = np.sort(cells)
        return cells[(len(cells) + 1) // 2 - 1]

    raw = {}
    for g, x in groups.items():
        n = len(x)
        cells = np.floor(x * 2048)
        mid = np.array([middle(c) for c in cells.T])
        mad = np.array([middle(c) for c in np.abs(cells - mid).T]) / 2048
        centre, s = (mid + 0.5) / 2048, np.sqrt((1.4826 * mad) ** 2 + np.square(floors))
        z = (x - centre) / s
        scores = [np.tanh(z), z / np.sqrt((z * z).sum(1, keepdims=True) + 1e-12)]
        starts = [np.diag(s * s)]
        for t in scores:
            c = t.T @ t / n
            r = c / np.sqrt(np.outer(np.diag(c) + 1e-3, np.diag(c) + 1e-3))
            np.fill_diagonal(r, 1)
            starts.append(r * np.outer(s, s))
        half = (n + p + 1) // 2

        def step(m, c):
            near = x[np.argsort(distance(x, m, c), kind="stable")[:half]]
            return near.mean(0), np.cov(near.T, bias=True).reshape(p, p) + floor

        tried = [step(*step(centre, c)) for c in starts]
        m, c = min(tried, key=lambda e: np.linalg.slogdet(e[1])[1])
        for _ in range(8):
            m2, c2 = step(m, c)
            stop = np.linalg.slogdet(c2)[1] >= np.linalg.slogdet(c)[1] - 1e-6
            m, c = m2, c2
            if stop:
                break
        d = distance(x, m, c)
        near = x[d <= max(np.sort(d)[(n + 1) // 2 - 1] * quality.CHI2_975[p] / quality.CHI2_MEDIAN[p], quality.CHI2_975[p])]
        raw[g] = (len(near), near.mean(0), np.cov(near.T, bias=True).reshape(p, p))
    weight = {g: k / (1 + np.mean(np.diag(c) / np.square(floors))) for g, (k, _, c) in raw.items()}
    every = sum(weight[g] * c for g, (_, _, c) in raw.items()) / sum(weight.values())
    out = {}
    for g, (k, m, c) in raw.items():
        of = [(weight[h], raw[h][2]) for h in groups if lang_of(h) == lang_of(g)]
        wide = (sum(a * b for a, b in of) + quality.PRIOR_ROWS * every) / (sum(a for a, _ in of) + quality.PRIOR_ROWS)
        c = (k * c + quality.PRIOR_ROWS * wide) / (k + quality.PRIOR_ROWS) + floor
        d = distance(groups[g], m, c)
        out[g] = d / max(1.0, np.sort(d)[(len(d) + 1) // 2 - 1] / quality.CHI2_MEDIAN[p])
    return out


@pytest.mark.parametrize("broadcast_groups", [quality.BROADCAST_GROUPS, 0])
def test_determinants_against_numpy(spark, broadcast_groups):
    """Groups of several sizes and correlations, of which one has 30 % of outliers in one place."""
    rng = np.random.default_rng(8)
    floors = {"a": 0.1, "b": 0.2, "c": 0.1}
    groups = {}
    for k, (n, bad) in enumerate(((600, 180), (250, 0), (40, 4), (5, 0), (1, 0))):
        root = rng.normal(size=(3, 3)) * 0.6
        x = rng.normal(size=(n, 3)) @ root + rng.normal(size=3) * 5
        x[:bad] = x[bad:].mean(0) + [9, -8, 10] + rng.normal(size=(bad, 3)) * 0.2
        groups[f'{{"lang":"{"xy"[k % 2]}","source":"s{k}"}}'] = x
    rows = [(g, i, *map(float, r)) for g, x in groups.items() for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "_q_group string, i int, _q_x_a double, _q_x_b double, _q_x_c double").repartition(5)
    e = quality.Estimator(floors, broadcast_groups=broadcast_groups)
    got = {(r["_q_group"], r["i"]): r["_q_d"] for r in e.with_distance(df, e.fit(df)).collect()}
    expected = plain_estimates(groups, list(floors.values()), lambda g: g[:11])
    assert len(got) == len(rows)
    for g, d in expected.items():
        own = np.array([got[g, i] for i in range(len(d))])
        assert np.allclose(own, d, rtol=0.15, atol=0.15)
    big, rest = next(iter(expected)), [got[k] for k in got if k[1] >= 180]
    assert min(got[big, i] for i in range(180)) > quality.CUTOFF and np.mean(np.array(rest) <= quality.CUTOFF) > 0.99


def test_quality_verdicts_against_numpy(spark):
    rows = queries.op10_quality_rules(spark, "/root/testdata/sf0.01").collect()
    names = {r.doc_id: (r.lang, r.source) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    good, groups = {}, {}
    for r in rows:
        if not r.base_failed:
            more = r.n_words + 20
            x = [math.log1p(r.n_words), (r.word_chars + 100) / more, math.log1p(r.n_symbols / more), math.log1p(r.n_dup_lines) / math.log1p(r.n_words + 9), math.sqrt(r.n_repeat_words / more)]
            good.setdefault(names[r.doc_id], []).append(r.doc_id)
            groups.setdefault(names[r.doc_id], []).append(x)
    expected = plain_estimates({g: np.array(x) for g, x in groups.items()}, list(quality.VECTOR.values()), lambda g: g[0])
    kept = {i: d <= quality.CUTOFF for g in good for i, d in zip(good[g], expected[g].tolist())}
    near = {i for g in good for i, d in zip(good[g], expected[g].tolist()) if 0.8 < d / quality.CUTOFF < 1.25}
    assert {r.doc_id: r.kept for r in rows if not r.base_failed and r.doc_id not in near} == {i: k for i, k in kept.items() if i not in near}
    assert len(near) < 0.02 * len(kept) and not any(r.kept for r in rows if r.base_failed)


def test_components_in_rounds_and_in_one_task(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5100)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    one, many = ({r.node: r.component for r in connected_components(df, one_task=n).collect()} for n in (10**6, 0))
    assert one == many


def test_frequent_values_and_large_units_by_pivots(spark):
    """A family over every bound: copies of one text that differ in a few words, and some that differ more."""
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(0, 4)) if i % 5 else int(rng.integers(4, 12)), replace=False):
            words[at] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(words)))
    from test_near_dedup import plain_near_duplicates

    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = plain_near_duplicates(rows, 3, 85, 100)
    for options in ({}, {"block_members": 20, "block_items": 3000}):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, words=3, similar=(85, 100), **options).collect()}
        assert got == expected


def test_recall_under_the_wanted_share_fails(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"a b c d e f {i % 3}") for i in range(9)], "doc_id bigint, text string")
    monkeypatch.setattr(near_dedup, "audit_candidates", lambda *a: (5, 10))
    with pytest.raises(RuntimeError):
        near_dedup.near_duplicates(df)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 8))
    v[30:] = v[:30] + 0.01 * rng.normal(size=(30, 8))
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(embedding_dedup, "audit_recall", lambda *a: 0.5)
    assert embedding_dedup.link_vectors(df).where("n_links > 0").count() == 60  # by all pairs
    with pytest.raises(RuntimeError):
        embedding_dedup.link_vectors(df, exact_rows=10)


def test_rows_without_an_id_are_numbered_in_many_parts(spark):
    """All rows of the null key share a shard, but no window holds a twentieth of them."""
    df = spark.range(200_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    sums = df.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.lit(1).alias("size"))
    parts = sums.groupBy(sharding.slot_salt(["doc_id", "text_crc32", "size"]).alias("s")).count()
    assert parts.agg(F.max("count")).first()[0] * 20 < 200_000
    got = sharding.shard_documents(df).agg(F.count_distinct("shard"), F.count_distinct("slot"), F.max("slot")).first()
    assert tuple(got) == (1, 200_000, 199_999)


CLASHING = ("_gone", "_row", "_id", "_q_group", "_q_d", "_q_doc", "_q_words", "component", "rep", "toxic", "score", "linked", "_salt")


def test_every_stage_stands_odd_rows_and_names(spark, sf_dir, odd_documents):
    """Stages run on nulls, empty and very long texts, repeated rows, an empty table and columns with their own names."""
    docs = odd_documents.drop(*CLASHING).select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
    docs = docs.unionByName(docs.where("doc_id IN (3, 4)")).unionByName(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        assert out.columns == docs.columns and rows, name
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHING), name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.where("doc_id = 1").collect()[0].doc_tokens == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0


def test_null_ids_and_groups(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(None, text, None, None), (None, text, None, None), (1, text, None, "s")], "doc_id bigint, text string, lang string, source string")
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(df, words=3).collect()) == [(0, 0, True), (0, 0, True), (1, 1, True)]
    assert near_dedup.keep_first(df).count() == 3
    rows = quality.judge(df).collect()
    assert len(rows) == 3 and all(r.kept and r.distance is not None for r in rows)


def test_empty_tables(spark, odd_documents):
    none = odd_documents.limit(0)
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    for df in (
        sharding.shard_documents(none),
        token_scan.token_counts(none, queries.TOKENIZER, queries.END_ID),
        langid.identify_languages(none, F.lit(False)),
        bpe.round_trip_digests(none, queries.RANKS),
        toxicity.score_documents(none, labels, F.lit(False)),
        chat.read_back(chat.format_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))),
    ):
        assert df.count() == 0


def test_chat_cases(spark):
    """Null roles and texts, a very long text, repeated rows, a null conversation and clashing columns."""
    long = "<s>[role]\\" * 200_000
    rows = [(1, 0, None, None), (1, 1, "assistant", long), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", ""), (None, 0, "assistant", "x]")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").select("*", F.lit(1).alias("message"), F.lit(2).alias("seq"), F.lit(3).alias("again"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {1: (2, len(long)), 2: (3, 0), None: (1, 2)}
    assert got[1].turns_sha256 == hashlib.sha256(f"\n\nassistant\n{long}\n".encode()).hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"user\na\nuser\na\nassistant\n\n").hexdigest()
    assert got[None].loss_sha256 == hashlib.sha256(b"x]").hexdigest()


def test_embedding_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id bigint, embedding array<double>").select("*", F.lit("own").alias("_gone"), F.lit("own").alias("rep"))
    kept = embedding_dedup.keep_first(df)
    assert kept.columns == df.columns and {r.vec_id for r in kept.collect()} == {1, 3}
