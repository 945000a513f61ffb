"""The registered queries on the smallest tables: against their SQL, and against the libraries where SQL has none."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairnflow.llm import mixing
from cairnflow.llm.bpe import load_ranks
from cairnflow.llm.quality import quality_rules
from cairnflow.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    found = duck.sql(ORACLES[name])
    want, names = found.fetchall(), found.columns
    got = QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want))


@pytest.fixture(scope="module")
def texts(duck):
    return {i: t or "" for i, t in duck.sql("SELECT doc_id, text FROM documents").fetchall()}


def test_tokens_are_the_libraries_(spark, texts):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in QUERIES["op6_byte_bpe"](spark, DIR).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    for r in QUERIES["op10_token_counts"](spark, DIR).collect():
        n = len(other.encode(texts[r.doc_id], add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


def test_base_scores_of_the_language_model(spark, texts):
    words = lambda t: [*t.encode().lower().split(), b"\n"]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts = Counter(w for i, t in texts.items() if not held[i] for w in words(t))
    n, v = counts.total(), len(counts)
    rows = QUERIES["op1_maxent_lm"](spark, DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = words(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(counts[w] > 0 for w in own), n)
        assert abs(r.base_score - sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)) < 1e-6
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_pages_have_one_row_each(spark, duck):
    rows = QUERIES["op9_html_text"](spark, DIR).collect()
    assert sorted((r.page_id, r.url) for r in rows) == sorted(duck.sql("SELECT page_id, url FROM pages").fetchall())
    assert all(r.n_chars == len(r.text) and r.text == "\n".join(" ".join(x.split()) for x in r.text.split("\n")) for r in rows)


def test_rows_of_one_hash_go_together_at_the_threshold(spark, monkeypatch):
    """All rows of a source share one hash: the source is taken as a whole or not at all, whichever is nearer."""
    monkeypatch.setattr(mixing, "row_hash", lambda id_col, text_col: F.lit(12_345).cast("long"))
    docs = spark.createDataFrame([(i, "a b c d", s) for i in range(30) for s in ("x", "y", None)], "doc_id bigint, text string, source string")
    for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size"), F.count_distinct("copies").alias("kinds")).collect():
        assert r.kinds == 1 and abs(r.taken - r.target) <= r["size"] / 2


def test_rows_at_the_quality_threshold_stay_and_reruns_agree(spark):
    """All texts score the same, which is the threshold too."""
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(40))) for i in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id bigint, quality int")
    first, again = quality_rules(docs, labels).collect(), quality_rules(docs.repartition(7), labels).collect()
    assert all(r.kept and abs(r.llr - r.threshold) < 1e-6 for r in first) and sorted(first) == sorted(again)
