import random

import public_tokenizers
import pytest
import tiktoken

from cairnflow.llm.bpe import Codec, PerfectHash, bpe_decode, bpe_encode, load_ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = load_ranks(PATH)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    alphabet = "abcdefghijABC  \n\t.,'s'll!?0123éèñßüÓ中文字😀 ​\x1c\x85|*#<>"
    made = ["".join(rng.choices(alphabet, k=rng.choice([1, 5, 40, 400]))) for _ in range(300)]
    return [*made, "", "a", "   ", "x" * 3000, "<|endoftext|>", "don't we'll", "\u0000", "word " * 2000]


def test_perfect_hash_fills_every_slot():
    keys = [f"k{i}".encode() for i in range(5000)]
    made = PerfectHash(keys)
    assert sorted(made.slot_key) == list(range(5000))
    assert made.candidates(keys) == list(range(5000))


def test_same_ids_as_the_library(library, texts):
    codec = Codec(RANKS, public_tokenizers.PATTERN)
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text), repr(text)
        assert codec.decode(ids) == text.encode()


def test_very_long_text_and_full_memo(library, monkeypatch):
    monkeypatch.setattr("cairnflow.llm.bpe.PIECES", 50)
    monkeypatch.setattr("cairnflow.llm.bpe.MEMO", 20)
    codec, text = Codec(RANKS, public_tokenizers.PATTERN), " ".join(f"wörd{i}  {i}" for i in range(500))
    got = list(codec.encode(["first", text, "last", text[:99]]))
    assert [x.tolist() for x in got] == [library.encode_ordinary(t) for t in ("first", text, "last", text[:99])]


def test_rows(spark, library):
    rows = [(1, "Hello wörld", 5), (1, "Hello wörld", 5), (None, None, 6), (3, "", 7), (4, "x" * 5000, 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    coded = bpe_encode(docs, PATH, public_tokenizers.PATTERN)
    back = sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in bpe_decode(coded, PATH).collect())
    assert back == sorted((str(i), t or "") for i, t, _ in rows)
    assert sorted(r.n_tokens for r in coded.collect()) == sorted(len(library.encode_ordinary(t or "")) for _, t, _ in rows)
    assert bpe_encode(docs.limit(0), PATH, public_tokenizers.PATTERN, decode=True).collect() == []

