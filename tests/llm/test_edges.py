"""Every operator on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cairnflow.llm.bpe import bpe_encode
from cairnflow.llm.chunk_dedup import exact_classes
from cairnflow.llm.html_extract import extract_text
from cairnflow.llm.line_dedup import deduped_lines
from cairnflow.llm.maxent_lm import lm_scores
from cairnflow.llm.mixing import mix, mixed_rows
from cairnflow.llm.near_dups import jaccard_join, near_unique
from cairnflow.llm.quality import quality_rules
from cairnflow.llm.token_counts import token_counts
from cairnflow.llm.warc import fetch, read_archive, write_archive

LONG = " ".join(f"word{i % 700} of{i % 31}" for i in range(6000))
ROWS = [(1, "one two three four five six seven eight nine ten eleven", "a"), (1, "one two three four five six seven eight nine ten eleven", "a"), (2, None, None), (3, "", "a"), (None, "null id text", "b"), (5, LONG, "b"), (6, "Ünïcödé 中文 😀\n\n\x0b x", None), (None, None, "b")]
CLASH = "doc_id bigint, text string, source string, row int, id int, key string, digest int, size int, hash int, n int"


def noisy(rows):
    return [(*r, 1, 2, "k", 3, 4, 5, 6) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(noisy(ROWS), CLASH)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, 1)], "doc_id bigint, quality int, toxic int")


def operators(labels):
    return {
        "lm": lm_scores,
        "lines": lambda d: deduped_lines(d)[0],
        "mix": mix,
        "exact": exact_classes,
        "jaccard": jaccard_join,
        "bpe": lambda d: bpe_encode(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True),
        "quality": lambda d: quality_rules(d, labels),
        "tokens": lambda d: token_counts(d, public_tokenizers.path("byte_bpe_50k.json")),
    }


NAMES = ("lm", "lines", "mix", "exact", "jaccard", "bpe", "quality", "tokens")


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_each_row(docs, labels, name):
    out = operators(labels)[name](docs).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(docs, labels, name):
    assert operators(labels)[name](docs.limit(0)).collect() == []


def test_pages(spark):
    html = "<html><body><nav><a href=x>menu</a></nav><article><h1>Title</h1><p>A long paragraph &amp; more text.</p></article></body></html>"
    rows = [(1, "u", html, 0), (1, "u", html, 0), (2, None, html, 0), (None, "v", html, 0), (4, "w", None, 0), (5, "x", "", 0), (6, "y", "<p " * 5, 0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int")
    texts = extract_text(pages).collect()
    assert len(texts) == len(rows) and all(r.n_chars == len(r.text) for r in texts)
    assert {r.text for r in texts if r.page_id in (1, 2)} == {"Title\nA long paragraph & more text."}
    assert extract_text(pages.limit(0)).collect() == [] and write_archive(pages.limit(0)).collect() == []
    bundles = write_archive(pages)
    back = read_archive(bundles, payloads=True).collect()
    assert len(back) == len(rows)
    digest = hashlib.sha256(html.encode()).hexdigest()
    assert sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in back if r.payload_digest == digest) == sorted([("1", "response", None, len(html))] * 2 + [("2", "revisit", 1, len(html)), ("None", "response", None, len(html))])
    assert [(r.page_id, r.refers_to) for r in fetch(bundles, spark.createDataFrame([(2,), (77,)], "page_id bigint")).collect()] == [(2, 1)]


def test_stages_keep_columns(docs):
    for out in (deduped_lines(docs)[0].drop("n_lines", "n_dropped"), near_unique(docs), mixed_rows(docs)):
        assert out.columns == docs.columns


def test_near_unique_keeps_one_of_a_group(docs):
    kept = [r.doc_id for r in near_unique(docs.where("doc_id IS NOT NULL")).collect()]
    assert sorted(set(kept)) == [1, 2, 5, 6]  # 2 and 3 are both empty


def test_exact_dedup_keeps_the_largest_id(docs):
    kept = exact_classes(docs).where("kept").select("doc_id", "keep_id", "group_size")
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(1, 1, 2), (3, 3, 3), (None, None, 1), (5, 5, 1), (6, 6, 1)]))


def test_exact_dedup_with_clashing_keys(spark):
    texts = [("".join(chr(97 + (i * k) % 26) for i in range(3000)) + str(k % 20)) for k in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:5])], "doc_id bigint, text string")
    want = {i: max(j for j, u in enumerate(texts + texts[:5]) if u == t) for i, t in enumerate(texts + texts[:5])}
    assert {r.doc_id: r.keep_id for r in exact_classes(docs, key_bytes=1).collect()} == want


def test_held_out_rows_are_not_learned(docs):
    out = lm_scores(docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(9)))).collect()
    assert all(r.score <= 0 and r.base_score <= 0 and r.n_known <= r.n_tokens for r in out)
