"""The full-text index against scans, by what it reads, and its scores against a plain BM25."""

import math
import random
import re
import shutil
import zlib

import pytest
from pyspark.sql import functions as F

from tenderspark.functions.text import fold_text, fuzzy_edits, matches, near_prefix, prefix, query_words
from tenderspark.operators.textindex import Autocompletion, TextIndex, left_out_of_text

WORDS = "cesta cestička oprava opravy opráv most mosty mostný školský škola školy nákup nákupy služby služba Žilina a i o dodávka dodavka dodávky ulica".split()


@pytest.fixture(scope="module")
def titles():
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 9)))) for i in range(400)]
    return [*rows, (1000, None), (1001, ""), (1002, " – "), (1003, "Most, most; MOST! oprava mosta-mostu"), (None, "most")]


@pytest.fixture(scope="module")
def frame(spark, titles):
    return spark.createDataFrame(titles, "id bigint, title string").withColumn("doc", F.lit("own"))


@pytest.fixture(scope="module")
def index(frame, tmp_path_factory):
    return TextIndex.build(frame, "id", "title", str(tmp_path_factory.mktemp("index")), buckets=16)


@pytest.mark.parametrize("query", ['"oprava most"', '"most most"', '"Školský"', '"nič také"', "opr*", "most?", "mos*y", "dod?v*a", "opravy", "skolsky", "most", "zilna", "oprava mostu", "ce", "a", "dodavka skoly"])
def test_searches_equal_scans(frame, index, query):
    scan = {r.id for r in frame.where("id IS NOT NULL").where(matches(query, "title")).collect()}
    rows = [r.doc for r in index.matches(query).collect()]
    assert set(rows) == scan and len(rows) == len(set(rows))


def test_nothing_to_search(spark, index, tmp_path):
    for ask in (index.matches, index.relevance):
        with pytest.raises(ValueError):
            ask("  ")
    assert index.matches('"--"').count() == 0 and index.relevance("--").count() == 0
    none = TextIndex.build(spark.createDataFrame([], "id bigint, title string"), "id", "title", str(tmp_path))
    assert none.matches("most").count() == 0 and none.relevance("most").count() == 0


def test_a_search_reads_its_own_buckets(spark, index, tmp_path):
    """The searches need no other folder than that of their bucket, and their plans ask for no other."""
    own = zlib.crc32(b"opr") % 16
    assert index.postings().select("bucket").distinct().count() > 5
    shutil.copytree(f"{index.folder}/postings/bucket={own}", tmp_path / f"postings/bucket={own}")
    alone = TextIndex(spark, str(tmp_path), 16)
    for ask in (lambda x: x.phrase("oprava"), lambda x: x.wildcard("opra*"), lambda x: x.beginning("opravy")):
        assert sorted(ask(alone).collect()) == sorted(ask(index).collect()) != []
        plan = ask(index)._jdf.queryExecution().toString()
        assert re.search(rf"PartitionFilters: \[[^\]]*bucket#\d+ = {own}\)", plan) and re.search(r"PushedFilters: \[[^\]]*(StringStartsWith|EqualTo)\(token,opr", plan)


def test_near_terms_against_all_terms(index):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    terms = {r.token: r.n_docs for r in index.terms().collect()}
    for word in ("opravy", "mosty", "skola", "mst", "dodavkka", "nakpuy", "xyzzyx"):
        want = {(word, t, d, n) for t, n in terms.items() if (d := distance(t, word)) <= fuzzy_edits(word)}
        assert {tuple(r) for r in index.near_terms(word).collect()} == want
    asked = index.deletions().where(F.col("token") == "opravy").count()
    assert asked == len(left_out_of_text("opravy", 2))


def plain_scores(titles, query, k):
    docs = {i: w for i, t in titles if i is not None and (w := query_words(t or ""))}
    n, average = len(docs), sum(map(len, docs.values())) / len(docs)
    frequency = {}
    for w in docs.values():
        for t in set(w):
            frequency[t] = frequency.get(t, 0) + 1

    def edits(a, b, most):
        sets = {a: 0}
        for e in range(1, most + 1):
            for x in [x for x, d in sets.items() if d == e - 1]:
                letters = set(b)
                for i in range(len(x) + 1):
                    for y in [x[:i] + x[i + 1 :], *(x[:i] + c + x[i:] for c in letters), *(x[:i] + c + x[i + 1 :] for c in letters)]:
                        sets.setdefault(y, e)
        return sets.get(b)

    idf = lambda t: math.log(1 + (n - frequency.get(t, 0) + 0.5) / (frequency.get(t, 0) + 0.5))
    near = {(w, t): e for w in set(query_words(query)) for t in frequency if (e := edits(w, t, fuzzy_edits(w))) is not None}
    words, out = query_words(query), {}
    for i, w in docs.items():
        part = lambda times, w=w: times / (times + 1.2 * (0.25 + 0.75 * len(w) / average))
        score, hit = 0.0, False
        times = sum(w[j : j + len(words)] == words for j in range(len(w)))
        if times:
            score, hit = 3 * sum(map(idf, words)) * part(times), True
        for (a, t), e in near.items():
            if t in w:
                score, hit = score + (1 - e / min(len(a), len(t))) * idf(t) * part(w.count(t)), True
        if any(t.startswith(fold_text(query.strip())) for t in w):
            score, hit = score + 1, True
        if hit:
            out[i] = score
    return sorted(out.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]


@pytest.mark.parametrize("query", ["oprava most", "most most", "skoly", "Nákup"])
def test_relevance_against_plain_scores(index, titles, query):
    got = [(r.doc, r.score) for r in index.relevance(query, 30).collect()]
    want = plain_scores(titles, query, 30)
    assert [d for d, _ in got] == [d for d, _ in want]
    assert all(abs(a - b) < 1e-8 for (_, a), (_, b) in zip(got, want))
    phrase = [r.doc for r in index.relevance(f'"{query}"', 30).collect()]
    assert set(phrase) <= {r.doc for r in index.phrase(query).collect()}
    assert {r.score for r in index.relevance("opr*", 500).collect()} == {1.0}


def test_completion_equals_scans(spark, frame, tmp_path):
    labels = frame.select(F.col("title").alias("label"))
    found = Autocompletion.build({"a": labels, "b": labels.where("id % 2 = 0")}, str(tmp_path / "g"), buckets=8)
    for kind, df in (("a", labels), ("b", frame.where("id % 2 = 0").select(F.col("title").alias("label")))):
        for query, edits, test in (("opr", 0, prefix), ("Žil", 0, prefix), ("oprva", 1, near_prefix), ("skol most", 1, near_prefix), ("cesticka", 0, prefix)):
            want = sorted(r.label for r in df.where(F.col("label").isNotNull()).distinct().where(test("label", query)).collect())[:7]
            rows = sorted(found.complete(query, 7, edits).where(F.col("kind") == kind).collect(), key=lambda r: r.label)
            assert [r.label for r in rows] == want, (kind, query)
            if rows:
                assert rows[0].n == df.where(F.col("label") == rows[0].label).count()
    assert found.complete("x").count() == 0 and found.complete("-", edits=1).count() == 0
