import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cairnflow.llm import token_counts as tc

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["Hello world", "a <|endoftext|> b<|endoftext|>", "", None, "  spaces \n\n  x", "naïve 中文😀  x \x1c\x85y", "x" * 4000, "we'll 123 go!!"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def test_counts_equal_the_library(spark, library, tmp_path):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(100, TEXTS[0], 0), (0, TEXTS[0], 0), (None, "other", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, digest int")
    got = tc.token_counts(docs, JSON, str(tmp_path / "cache")).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t, _ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_only_misses_are_encoded_and_appended(spark, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one")], "doc_id bigint, text string")
    tc.token_counts(docs, JSON, cache).collect()
    assert spark.read.parquet(cache).count() == 2
    more = docs.unionByName(spark.createDataFrame([(4, "three")], "doc_id bigint, text string"))
    assert {r.doc_id: r.n_tokens for r in tc.token_counts(more, JSON, cache).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    assert spark.read.parquet(cache).count() == 3
    tc.token_counts(docs, MODEL, cache).collect()  # another tokenizer has counts of its own
    assert spark.read.parquet(cache).count() == 5


def test_stored_counts_are_used(spark, tmp_path):
    cache = str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "one")], "doc_id bigint, text string")
    tc.token_counts(docs, JSON, cache).collect()
    fake = spark.read.parquet(cache).selectExpr("digest", "tokenizer", "cast(77 as bigint) n_tokens").collect()
    other = str(tmp_path / "other")
    spark.createDataFrame(fake, tc.CACHE_SCHEMA).write.parquet(other)
    assert tc.token_counts(docs, JSON, other).collect()[0].n_tokens == 77


def test_empty_table_and_shuffled_skip(spark, library, tmp_path, monkeypatch):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert tc.token_counts(empty, JSON, str(tmp_path / "a")).collect() == []
    monkeypatch.setattr(tc, "broadcast_if_small", lambda df: df)
    docs = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i}") for i in range(90)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in tc.token_counts(docs, JSON, str(tmp_path / "b")).collect()}
    assert got == {i: len(library.encode("same text" if i % 3 else f"text {i}")) for i in range(90)}


def test_sentencepiece(spark, tmp_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.createDataFrame([(1, "Hello world"), (2, None)], "doc_id bigint, text string")
    assert {r.doc_id: r.n_tokens for r in tc.token_counts(docs, MODEL, str(tmp_path / "c")).collect()} == {1: len(model.encode("Hello world")), 2: 0}


def test_pieces_of_all_of_unicode_are_the_library_s(library):
    """Every code point, between letters, numbers, spaces and signs: the split into pre-tokens changes no count."""
    counter = tc.counter(JSON, "own", open(JSON, "rb").read())
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = [f"a{c}1{c}{c} {c}!{c}\n{c}'s" for c in points]
    texts = ["".join(texts[k : k + 64]) for k in range(0, len(texts), 64)]
    got = counter.counts(texts)
    want = [len(x) for x in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [k for k, (a, b) in enumerate(zip(got, want, strict=True)) if a != b] == []
