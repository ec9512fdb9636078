import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_help import DATA
from public_tokenizers import path
from pyspark.sql import functions as F

from granary.llm import blocks, pieces, tokens
from granary.llm.common import Scratch
from granary.llm.registry import op3_token_counts, op5_sentencepiece

BPE, MODEL = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_counts_against_the_library(spark, bpe):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op3_token_counts(spark, DATA).collect()}
    for i, t in rows:
        n = len(bpe.encode(t or "", add_special_tokens=False))
        assert got[i] == (len((t or "").encode()), n, n > 1024)


ODD = ["<|endoftext|>", "a<|endoftext|>  <|endoftext|>b ", " x  y\n\n z", "don't we'll THEY'RE", "日本語テキスト 123456", "   tab\t\ttab ", "é \U0001f600\U0001f468‍\U0001f469", "", None]


def test_counts_of_odd_texts(spark, docs, no_docs, docs_rows, bpe):
    rows = [(k, t) for k, t in enumerate(ODD)]
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(spark, spark.createDataFrame(rows, "doc_id long, text string"), BPE).collect()}
    assert got == {k: len(bpe.encode(t or "", add_special_tokens=False)) for k, t in rows}
    more = sorted((str(r.doc_id), r.n_tokens) for r in tokens.token_counts(spark, docs, BPE).collect())
    assert more == sorted((str(i), len(bpe.encode(t or "", add_special_tokens=False))) for i, t, _ in docs_rows)
    assert tokens.token_counts(spark, no_docs, BPE).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_pre_tokens_are_the_librarys(bpe, text):
    want = [text[a:b] for _, (a, b) in bpe.pre_tokenizer.pre_tokenize_str(text)]
    if "<|" not in text:
        assert tokens.splitter(BPE)(text) == want


def test_every_kind_of_character_is_the_librarys(bpe):
    split = tokens.splitter(BPE)
    for c in range(0x20, 0x30000, 7):
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}1 {chr(c)}"
            assert split(text) == [text[x:y] for _, (x, y) in bpe.pre_tokenizer.pre_tokenize_str(text)]


def digest(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_ids_against_the_library(spark, sp):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op5_sentencepiece(spark, DATA).collect()}
    for i, t in rows:
        ids = sp.encode(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].round_trip) == (len(ids), digest(ids), True)


PIECES = ["a  b\n\tc  ", " ", "", None, "▁x <s> </s> <unk> <0x41>", "日本語 123 4567", "\U0001f600 ok", "x" * 500, "=" * 90 + " " * 70 + "-" * 40, "é‍‍", "ﬁ Å\r\n", "\x00\x01"]


def test_ids_of_odd_texts(spark, docs, no_docs, docs_rows, sp):
    frame = spark.createDataFrame(list(enumerate(PIECES)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in pieces.encode_documents(spark, frame, MODEL).collect()}
    assert got == {k: sp.encode(t or "") for k, t in enumerate(PIECES)}
    back = spark.createDataFrame([(k, v) for k, v in got.items()], "k long, ids array<int>").select("k", pieces.decode_column(MODEL)("ids").alias("t")).collect()
    assert all(r.t == (PIECES[r.k] or "").replace("▁", " ") for r in back)
    more = sorted((str(r.doc_id), r.ids) for r in pieces.encode_documents(spark, docs, MODEL).collect())
    assert more == sorted((str(i), sp.encode(t or "")) for i, t, _ in docs_rows)
    assert pieces.encode_documents(spark, no_docs, MODEL).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abetr ing▁.,=-\n1", max_size=60))
def test_heap_and_cuts_are_the_librarys(sp, text):
    model = pieces.load(MODEL)
    ranks = {p: (int(r), i) for p, i, r in model.pieces}
    ids = [x for w in pieces.splitter(model)(text) for x in np.frombuffer(pieces.encode_long(w, model, ranks), ">u2").tolist()]
    assert ids == sp.encode(text)


def test_viterbi_fold_against_all_paths(spark):
    table = {"a": -1.0, "b": -1.5, "ab": -2.0, "abc": -2.2, "c": -3.0, "bc": -2.6, "ca": -1.1}
    model = pieces.Model("unigram", tuple((p, k, k) for k, p in enumerate(table)), (), 7, 8)
    words = ["a", "abc", "abcab", "cabca", "xab", "bbxca"]
    rows = spark.createDataFrame([(0, w) for w in words], "bucket long, word string")
    scores = F.array(*[F.lit(s) for s in table.values()])
    got = {r.word: r.s for r in pieces.lattice(rows, model).select("word", pieces.viterbi_fold(F.col("word"), F.col("edges"), scores, 3, -10.0).alias("s")).collect()}

    def best(w):
        if not w:
            return 0.0
        return max(best(w[k:]) + table.get(w[:k], -10.0 if k == 1 else float("-inf")) for k in range(1, min(3, len(w)) + 1))

    for w in words:
        cut = got[w]
        assert abs(sum(table.get(w[a - 1 : b - 1], -10.0) for a, b in zip(cut, cut[1:], strict=False)) - best(w)) < 1e-9


@given(st.lists(st.integers(0, 2**29 - 1)))
def test_packing(numbers):
    assert blocks.unpack(blocks.pack(np.array(numbers, np.int64))).tolist() == numbers


def test_kinds_of_models(tmp_path):
    with open(MODEL, "rb") as file:
        data = file.read()
    assert pieces.kind_of(data) == "bpe"
    # A later field overrides an earlier one, so these are models of other kinds.
    for number, kind in ((1, "unigram"), (3, "word")):
        assert pieces.kind_of(data + bytes([0x12, 2, 0x18, number])) == kind
        (tmp_path / kind).write_bytes(data + bytes([0x12, 2, 0x18, number]))
        with pytest.raises(ValueError, match="kind"):
            pieces.load(str(tmp_path / kind))


def test_a_task_has_the_words_of_one_bucket(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    chars = docs.agg(F.sum(F.length("text"))).first()[0]
    monkeypatch.setattr(blocks, "BUCKET_CHARS", chars // 12)
    _, words = blocks.store(Scratch(spark), docs, "doc_id", "text", str.split, counted=False)
    tasks = words.select("bucket", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({r.bucket for r in tasks}) == len({r.task for r in tasks}) == len(tasks) >= 13
    want = {r.doc_id: r.n_tokens for r in op3_token_counts(spark, DATA).collect()}
    monkeypatch.setattr(blocks, "BUCKET_CHARS", 8_000_000)
    assert want == {r.doc_id: r.n_tokens for r in op3_token_counts(spark, DATA).collect()}
