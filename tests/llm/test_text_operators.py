"""Packing, token counts, byte-level BPE, sharding, quality rules, language, toxicity, chat against plain versions."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tenderspark.llm import bpe, chat, langid, packing, quality, queries, sharding, token_scan, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.TOKENIZER)


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def check_packing(rows, texts, tokenizer):
    ids = {d: tokenizer.encode(t, add_special_tokens=False).ids + [0] for d, t in texts.items()}
    covered, sequences = Counter(), {}
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        covered[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert covered == {d: len(x) for d, x in ids.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences), sum(covered.values())


def test_packing(spark, sf_dir, odd_documents, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n, tokens = check_packing(queries.op1_packing(spark, sf_dir).collect(), texts_of(docs), tokenizer)
    assert n * 1024 < tokens * 1.05
    check_packing(packing.pack_documents(odd_documents, queries.TOKENIZER).collect(), texts_of(odd_documents), tokenizer)
    assert packing.pack_documents(odd_documents.limit(0), queries.TOKENIZER).count() == 0


def test_balance_takes_the_cheapest_sequence():
    rows = packing.balance(np.array([600, 500, 300, 200, 100]), 1024, 1.0, 1 / 1024)
    # 1700 ids need two sequences, which cost 951.6 and 744.1; 300 goes to the second (1131.9), so 200 to the first
    # (1190.6) and 100 to the second
    assert rows == [(0, 0, 600, 0, 0), (1, 0, 500, 1, 0), (2, 0, 300, 1, 500), (3, 0, 200, 0, 600), (4, 0, 100, 1, 800)]


def test_special_tokens_in_texts(spark, tokenizer):
    """Packed ids are the library's own: the string of a special token is that token."""
    texts = ["a b <|endoftext|> c", "<|endoftext|>", "x  <|endoftext|>  y\n<|endoftext|>z", "a<|endoftext", " <|endoftext|><|endoftext|> \t q"]
    assert 50256 in tokenizer.encode(texts[0], add_special_tokens=False).ids
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    check_packing(packing.pack_documents(df, queries.TOKENIZER).collect(), dict(enumerate(texts)), tokenizer)


def test_token_counts(spark, sf_dir, odd_documents, tokenizer):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd_documents.repartition(1)):
        tokenizer.encode_special_tokens = True  # token files close documents by this id, so texts must not hold it
        expected = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) for d, t in texts_of(docs).items()}
        tokenizer.encode_special_tokens = False
        for block in (1 << 18, 700):
            rows = token_scan.token_counts(docs, queries.TOKENIZER, queries.END_ID, block).collect()
            assert {r.doc_id: r.n_tokens for r in rows} == expected and len(rows) == len(expected) and all(r.closed for r in rows)


def test_token_files(spark, tmp_path):
    np.array([5, 6, 0, 0, 7, 8, 9, 9, 0, 4], "<u2").tofile(tmp_path / "a.bin")
    np.array([], "<u2").tofile(tmp_path / "b.bin")
    for block in (1, 2, 3, 100):
        rows = token_scan.document_counts(token_scan.read_token_files(spark, str(tmp_path), 2, block), 0, 2, span=2).collect()
        assert sorted((r.doc_no, r.n_tokens, r.closed) for r in rows) == [(0, 2, True), (1, 0, True), (2, 4, True), (3, 1, False)]


def test_a_long_token_file_is_read_by_ranges(spark, tmp_path):
    """A sparse file of over 2 GB, in which 0 is no end id, and of which tasks read their own ranges."""
    size = (2 << 30) + (8 << 20)
    with open(tmp_path / "a.bin", "wb") as f:
        f.truncate(size)
        for at in (10, (2 << 30) + 40):
            f.seek(at)
            f.write(b"\x07\x00")
    rows = token_scan.document_counts(token_scan.read_token_files(spark, str(tmp_path), 2, 1 << 24), 7, 2).collect()
    assert sorted((r.doc_no, r.n_tokens, r.closed) for r in rows) == [(0, 5, True), (1, (1 << 30) + 20 - 6, True), (2, (size >> 1) - (1 << 30) - 21, False)]


def test_byte_bpe(spark, sf_dir, odd_documents):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd_documents):
        texts = texts_of(docs)
        for r in bpe.round_trip_digests(docs, queries.RANKS, public_tokenizers.PATTERN).collect():
            ids = encoding.encode_ordinary(texts[r.doc_id])
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_bpe_offsets_and_split_characters(spark, odd_documents):
    e = bpe.encode_texts(odd_documents.where("doc_id = 7"), queries.TOKENIZER)
    r = e.first()
    assert r.char_start[0] == 0 and r.char_end[-1] == len(odd_documents.where("doc_id = 7").first().text) and r.char_start == sorted(r.char_start)
    assert bpe.decode_ids(e, queries.TOKENIZER).first().text == odd_documents.where("doc_id = 7").first().text


def plain_statistics(t):
    w = WORD.findall(t)
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    times, covered, seen, dup = Counter(windows), set(), set(), 0
    for k, x in enumerate(windows):
        if times[x] > 1:
            covered.update(range(k, k + 5))
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed


def test_quality(spark, sf_dir, odd_documents):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for d in (docs, odd_documents):
        texts = texts_of(d)
        rows = quality.judge(d).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == plain_statistics(texts[r.doc_id])
            assert not (r.base_failed and r.kept)
    assert quality.keep_good(odd_documents).columns == odd_documents.columns
    assert quality.judge(odd_documents.limit(0)).count() == 0


def test_quality_rejects_an_outlier_and_keeps_the_rest(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(rng.integers(40, 120))), "en", "s") for i in range(300)]
    rows.append((999, " ".join(["#$%&|<>" * 3] * 2 + ["$" * int(n) for n in rng.integers(5, 40, 60)]), "en", "s"))
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not kept[999] and sum(kept.values()) >= 295


def test_quality_judges_small_groups_by_themselves(spark):
    """Languages and sources of 1 to 150 rows whose words are far longer than the corpus's."""
    rng = np.random.default_rng(3)

    def text(low, high, n):
        return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(low, high))) for _ in range(n))

    rows = [(-i, text(3, 8, rng.integers(40, 80)), "en", "s") for i in range(1500)]
    for k, n in enumerate((150, 40, 7, 3, 1)):
        rows += [(1000 * (k + 1) + i, text(20, 60, rng.integers(20, 60)), "ja" if k < 3 else None, f"s{k}") for i in range(n)]
    rows.append((9999, " ".join("$" * int(n) for n in rng.integers(20, 60, 60)), "ja", "s0"))
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not kept.pop(9999) and sum(kept.values()) >= len(kept) - 5
    for k, n in enumerate((150, 40, 7, 3, 1)):
        assert sum(kept[1000 * (k + 1) + i] for i in range(n)) >= n - 2 * (n > 7)


def test_sharding(spark, sf_dir, odd_documents):
    for d in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd_documents.unionByName(odd_documents)):
        texts = texts_of(d)
        rows = sharding.shard_documents(d).collect()
        assert len(rows) == d.count()
        slots = {}
        for r in rows:
            raw = texts[r.doc_id].encode()
            assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
            assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_rendezvous_weights(spark):
    got = sharding.assign_shards(spark.range(6000), "id", [1.0, 2.0, 3.0]).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] / 6000 for r in got}
    assert all(abs(share[i] - w) < 0.03 for i, w in enumerate((1 / 6, 2 / 6, 3 / 6)))


def test_language(spark, sf_dir, odd_documents):
    p = queries.op6_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert p.where("lang = lang_pred").count() >= 0.95 * p.count()
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_languages(odd_documents, F.lit(False)).collect()}
    assert len(out) == 8 and all(out[i] == ("und", 0.0) for i in (1, 2, 3)) and all(0 <= s <= 1 for _, s in out.values())
    assert all(r.lang_pred == "und" for r in langid.identify_languages(odd_documents, F.lit(True)).collect())


def test_toxicity_learns_a_pair(spark):
    rng = np.random.default_rng(4)
    plain = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(1600):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [*rng.choice(plain, 12), *["foulish"] * insult, *["grouplings"] * group]
        rows.append((i, " ".join(words)))
        labels.append((i, int(insult and group)))
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, marks, queries.fold_of_id(4) == 2).where("held_out").collect()}
    y = dict(labels)
    bad, good = [got[i] for i in got if y[i]], [got[i] for i in got if not y[i]]
    assert np.mean([a > b for a in bad for b in good]) > 0.95


def test_toxicity_cases(spark, odd_documents):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.score_documents(odd_documents, none, F.lit(False)).collect()} == {0.0}
    some = spark.createDataFrame([(4, 1), (8, 0), (None, 1), (2, None)], "doc_id bigint, toxic int")
    rows = toxicity.score_documents(odd_documents, some, F.lit(False)).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.keep_clean(odd_documents, none, F.lit(True)).columns == odd_documents.columns


def test_chat(spark, sf_dir):
    rows = {}
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    for conv, turn, role, text in [*table, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]:
        rows.setdefault(conv, []).append((turn, role, text or ""))
    got = {r.conv_id: r for r in queries.op9_chat_formatting(spark, sf_dir).collect()}
    assert got.keys() == rows.keys()
    for conv, turns in rows.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        g = got[conv]
        assert g.n_turns == len(turns) and g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_events(spark):
    log = [(1, 1, 1, "delta", "user", "hi"), (1, 2, 2, "delta", "assistant", "wr"), (1, 2, 3, "delta", "assistant", "ong"), (1, 2, 4, "regenerate", "assistant", None), (1, 2, 5, "delta", "assistant", "ri"), (1, 2, 6, "delta", "assistant", "ght"), (1, 3, 7, "delta", "user", "x"), (1, 3, 8, "edit", "user", "y"), (1, 4, 9, "delta", "user", "gone"), (1, 4, 10, "delete", "user", None)]
    df = spark.createDataFrame(log, "conv_id bigint, message int, seq bigint, kind string, role string, text string")
    assert [(r.message, r.text) for r in chat.fold(df).orderBy("message").collect()] == [(1, "hi"), (2, "right"), (3, "y")]
    assert chat.parse(chat.render_turn("a[b]", "\\<s>[role]x[/role]</s>\\l")) == [("a[b]", "\\<s>[role]x[/role]</s>\\l")]


def test_chat_log_needs_its_fold(spark):
    """The query's log holds deltas, edits, regenerations and deletions, and folds to the turns."""
    text = "Žltý [kôň]\n" + "\U0001f600 long </s> " * 100
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", text[: 90 * t] if t != 3 else None) for c in range(8) for t in range(12)]
    df = spark.createDataFrame(rows + rows[:1], "conv_id bigint, turn bigint, role string, text string")
    log = chat.turns_as_events(df).cache()
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert set(kinds) == {"delta", "edit", "regenerate", "delete"}
    assert max(len(r.text) for r in log.where("kind = 'delta'").select("text").collect()) == chat.PIECE
    got = sorted((r.conv_id, r.message.turn, r.message.again, r.role, r.text) for r in chat.fold(log).collect())
    assert got == sorted([(c, t, 1, r, x or "") for c, t, r, x in rows] + [(0, 0, 2, "user", "")])
    plain = {}
    for r in log.orderBy("conv_id", "message", "seq").collect():
        plain[r.conv_id, r.message] = plain.get((r.conv_id, r.message), "") + r.text
    assert any(plain[c, m] != x for c, m, _, x in chat.fold(log).select("conv_id", "message", "role", "text").collect())
