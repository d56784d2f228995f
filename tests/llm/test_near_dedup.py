"""Operators on near copies, and the pipeline, against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tenderspark.llm import embedding_dedup, near_dedup, packing, quality, queries, toxicity
from tenderspark.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(ids, links):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def plain_near_duplicates(rows, words, num, den):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = frozenset() if not w else frozenset([tuple(w)]) if len(w) < words else frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1))
    ids = sorted(sets)
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * den >= num * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    links.append((a, b))
    root = components(ids, links)
    return {i: (len(sets[i]), root[i], root[i] == i) for i in ids}


def variants(seed=5):
    """Texts around the threshold, a large group of near copies, and a passage that many share."""
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"v{i}" for i in range(3000)])
    passage = list(rng.choice(vocabulary, 40))
    rows, key = [], 0
    for _ in range(25):
        base = list(rng.choice(vocabulary, int(rng.integers(30, 150))))
        for change in (0, 1, 2, 3, 5):
            words = list(base)
            for at in rng.choice(len(words), change, replace=False):
                words[at] = str(rng.choice(vocabulary))
            rows.append((key, " ".join(words)))
            key += 1
    base = list(rng.choice(vocabulary, 80))
    for _ in range(90):
        words = list(base)
        words[int(rng.integers(80))] = str(rng.choice(vocabulary))
        rows.append((key, " ".join(words).upper() if key % 2 else " ".join(words)))
        key += 1
    for _ in range(60):
        rows.append((key, " ".join([*rng.choice(vocabulary, 30), *passage])))
        key += 1
    return rows


def test_minhash_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op3_minhash_dedup(spark, sf_dir).collect()}
    assert got == plain_near_duplicates(rows, 3, 85, 100)


@pytest.mark.parametrize("words, similar, options", [(3, (85, 100), {}), (5, (80, 100), {"block_members": 16, "block_items": 2000, "common": 8})])
def test_minhash_variants(spark, words, similar, options):
    rows = variants()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, words=words, similar=similar, **options).collect()}
    assert got == plain_near_duplicates(rows, words, *similar)


def test_minhash_cases(spark, odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd_documents, words=3, similar=(85, 100)).collect()}
    assert got == plain_near_duplicates(rows, 3, 85, 100) and got[5][1] == 4
    assert near_dedup.near_duplicates(odd_documents.limit(0)).count() == 0
    kept = near_dedup.keep_first(odd_documents)
    assert kept.columns == odd_documents.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 6, 7, 8}


def plain_documents(rows, words, num, den):
    """Components of documents whose rows may have several texts."""
    keys = {k: (i, t) for k, (i, t) in enumerate(rows)}
    of_rows = plain_near_duplicates([(k, t) for k, (_, t) in keys.items()], words, num, den)
    ids = {i for i, _ in rows}
    root = components(ids, [(keys[k][0], keys[r][0]) for k, (_, r, _) in of_rows.items()])
    return sorted((i, of_rows[k][0], root[i], root[i] == i) for k, (i, _) in keys.items())


def test_documents_of_several_texts(spark):
    """Rows that share a doc_id are one document: its texts' links join them, and it has one verdict."""
    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcdefg"}
    near = {c: t.replace(f"{c}30", "other") for c, t in text.items()}
    rows = [(3, text["a"]), (5, text["a"]), (5, text["b"]), (8, text["b"])]
    rows += [(20, text["c"]), (20, text["d"]), (20, text["d"]), (21, near["d"]), (22, near["c"]), (23, text["e"]), (23, ""), (24, None), (25, near["e"]), (25, None)]
    rows += [(40, text["f"]), (40, text["g"]), (2, near["g"])]
    for docs in (rows[:4], rows, rows * 3):
        df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, words=3, similar=(85, 100)).collect())
        want = plain_documents(docs, 3, 85, 100)
        assert got == want
        first = {i for i, _, _, kept in want if kept}
        stay = sorted(((i, t) for i, t in docs if i in first), key=repr)
        assert sorted((tuple(r) for r in near_dedup.keep_first(df, words=3, similar=(85, 100)).collect()), key=repr) == stay
    assert {i for i, _, _, kept in plain_documents(rows[:4], 3, 85, 100) if kept} == {3}


def test_audit_asks_more_classes_until_links_are_met(spark, monkeypatch):
    asked = []

    def counted(classes, units, k, threshold, similar, most):
        asked.append(most)
        return (most // 10, most // 10)

    monkeypatch.setattr(near_dedup, "audit_candidates", counted)
    assert near_dedup.candidate_recall(None, None, 32, 0.8, (128, 1024, 8192), 300) == 1.0 and asked == [128, 1024, 8192]


@pytest.mark.parametrize("common", [1, 32])
def test_missed_recall_ends_with_every_value_as_a_key(spark, monkeypatch, common):
    """However many audits fail, the result is that of brute force; short lists or long ones."""
    used, real = [], near_dedup.candidates
    monkeypatch.setattr(near_dedup, "candidates", lambda *a: used.append((a[2], a[-1])) or real(*a))
    monkeypatch.setattr(near_dedup, "candidate_recall", lambda *a: 0.5)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 80)) for _ in range(12)]
    rows = [(100 * i + j, " ".join(w if rng.random() > 0.02 else "new" for w in t.split())) for i, t in enumerate(texts) for j in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, words=3, similar=(85, 100), common=common, block_members=4).collect())
    assert got == plain_documents(rows, 3, 85, 100) and any(not r[3] for r in got)
    assert used == [(8, 0.4), (16, 0.4), (32, 0.0)]


def plain_links(v):
    usable = {i: np.array(x, float) for i, x in v if x is not None and len(x) and all(y is not None and np.isfinite(y) for y in x) and np.any(np.array(x, float))}
    ids = sorted(usable)
    u = {i: usable[i] / np.linalg.norm(usable[i]) for i in ids}
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(u[a]) == len(u[b]) and u[a] @ u[b] >= 0.9]
    root = components([i for i, _ in v], links)
    n = dict.fromkeys(root, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], root[i], root[i] == i) for i in root}


def got_links(df, **options):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.link_vectors(df, **options).collect()}


def test_a_link_whose_sketches_differ_is_found(spark):
    """A pair at the threshold whose union sketch holds far fewer common values than its sets do."""
    rng = np.random.default_rng(1)
    base = " ".join(f"b{i}" for i in range(402))
    texts = [base + "".join(f" t{x}" for x in rng.integers(0, 1 << 40, 35)) for _ in range(1500)]
    raw = [t.encode() for t in texts]
    sets = near_dedup.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), 3)
    common = np.intersect1d(sets[0], sets[1])
    most = sorted(range(len(sets)), key=lambda i: np.isin(sets[i][:32], common).sum())[:20]
    share = {(a, b): np.isin(np.union1d(sets[a], sets[b])[:32], common).mean() for a in most for b in most if a < b}
    a, b = next(pair for pair, x in share.items() if 0.5 <= x < 0.6)
    assert len(common) / len(np.union1d(sets[a], sets[b])) >= 0.85
    docs = spark.createDataFrame([(1, texts[a]), (2, texts[b])], "doc_id bigint, text string")
    assert {r.component_id for r in near_dedup.near_duplicates(docs, words=3, similar=(85, 100)).collect()} == {1}


def test_embedding_query(spark, sf_dir):
    v = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op2_embedding_dedup(spark, sf_dir).collect()} == plain_links(v)


def test_embedding_balls_fringes_and_blocks(spark):
    """A dense ball with a fringe, chains of links, exact copies, and shards that are split."""
    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x)
    centre = unit(rng.normal(size=16))
    v = [unit(centre + rng.normal(size=16) * 0.03) for _ in range(150)] + [unit(centre + rng.normal(size=16) * s) for s in np.linspace(0.05, 0.2, 60)]
    other = unit(centre + 0.4 * unit(rng.normal(size=16)))
    v += [unit(other + rng.normal(size=16) * 0.03) for _ in range(80)]
    step = unit(rng.normal(size=16))
    for _ in range(12):
        step = unit(step + 0.3 * unit(rng.normal(size=16)))
        v.append(step)
    v += [unit(rng.normal(size=16)) for _ in range(300)]
    v += v[-3:]
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert got_links(df, block_rows=64) == plain_links(rows)


@pytest.mark.parametrize("block_rows", [6000, 64, 20])
def test_embedding_widths(spark, block_rows):
    """Near pairs within each of three widths: one searched by the graph, others too or compared in blocks."""
    rng = np.random.default_rng(6)
    rows = []
    for width, n in ((16, 120), (24, 80), (9, 30)):
        v = rng.normal(size=(n, width))
        v[n // 2 :] = v[: n - n // 2] + rng.normal(size=(n - n // 2, width)) * rng.uniform(0, 0.4, (n - n // 2, 1))
        rows += [(len(rows) + i, [float(y) for y in x]) for i, x in enumerate(v)]
    expected = plain_links(rows)
    assert min(sum(expected[i][0] for i, x in rows if len(x) == width) for width in (16, 24, 9)) > 10
    assert got_links(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), block_rows=block_rows) == expected


def test_embedding_cases(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, float("nan")]), (5, [1.0, None]), (6, [1e200, 0.0]), (7, [1e-200, 0.0]), (8, [1.0, 0.2]), (9, [0.0, 1.0]), (10, [1.0]), (11, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("v", F.lit(1))
    got = got_links(df)
    assert got[6][0] == 2 and got[7][1] == 6 and got[8][1] == 6 and got[10][0] == 1 and all(got[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 9))
    assert got_links(df.limit(0)) == {}


def test_robust_graph_leaves_out_what_a_kept_neighbour_covers():
    v = np.array([[1.0, 0.0], [0.999, 0.0447], [0.998, 0.0632], [0.0, 1.0]])
    near = embedding_dedup.robust_graph(v / np.linalg.norm(v, axis=1, keepdims=True), 3, 3, 1.2)
    assert set(near[0][near[0] >= 0]) == {1} or 2 not in near[0][:1]


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    root = components({x for e in links for x in e}, links)
    assert {i: r for i, r in root.items() if any(i in e and e[0] != e[1] for e in links)} == got


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = quality.keep_good(docs)
    clean = toxicity.keep_clean(good, spark.read.parquet(f"{sf_dir}/labels.parquet"), queries.fold_of_id(4) != 2)
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    first = {i for i, (_, _, kept) in plain_near_duplicates(rows, 5, 80, 100).items() if kept}
    assert 0 < len(first) < len(rows) < docs.count()
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()
    expected = packing.pack_documents(docs.where(F.col("doc_id").isin(list(first))), queries.TOKENIZER)
    assert {(r.doc_id, r.doc_tokens) for r in got} == {(r.doc_id, r.doc_tokens) for r in expected.collect()}


def test_every_stage_keeps_the_columns(spark, sf_dir, odd_documents):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd_documents, sf_dir).columns == odd_documents.columns
