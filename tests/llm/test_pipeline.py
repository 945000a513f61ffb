"""The corpus pipeline: its stages against SQL and the tokenizer's library, and on ids and texts that are null or repeated."""

import hashlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from corpus_pipeline import quality_stage

from cairnflow.llm.bpe import load_ranks
from cairnflow.llm.queries import ORACLES

DIR = "/root/testdata/sf0.001"
CLEAN = [" ".join(f"word{(i * k) % 97}" for i in range(1, 15)) for k in (1, 5, 7)]


def test_quality_stage_judges_rows_and_not_ids(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(None, CLEAN[0]), (None, CLEAN[1]), (None, "too short"), (None, None), (4, CLEAN[2]), (4, "junk"), (5, ""), (6, CLEAN[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = quality_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(str(r) for r in rows if r[1] in CLEAN)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The path of each stage's input, and of the last one's output."""
    where, paths = tmp_path_factory.mktemp("stages"), [f"{DIR}/documents.parquet"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, spark.read.parquet(paths[-1]), DIR).coalesce(1).write.parquet(str(where / str(k)))
        paths.append(str(where / str(k)))
    return paths


def sql(path, query):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}' || CASE WHEN '{path}' LIKE '%.parquet' THEN '' ELSE '/*.parquet' END)")
    con.sql(f"CREATE VIEW labels AS SELECT * FROM '{DIR}/labels.parquet'")
    return con.sql(query).fetchall()


def test_stages_do_what_their_operators_sql_says(spark, stages):
    first, judged, lines, unique, mixed, coded = stages
    ids = lambda path: Counter(r.doc_id for r in spark.read.parquet(path).select("doc_id").collect())
    texts = lambda path: [(r.doc_id, r.text) for r in spark.read.parquet(path).select("doc_id", "text").collect()]
    assert ids(judged) == Counter(r[0] for r in sql(first, f"SELECT doc_id FROM ({ORACLES['op8_quality']}) WHERE kept"))
    want = dict(sql(judged, f"SELECT doc_id, kept_sha256 FROM ({ORACLES['op2_line_dedup']})"))
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts(lines)} == want
    assert ids(unique) == Counter(r[0] for r in sql(lines, f"SELECT doc_id FROM ({ORACLES['op5_jaccard_join']}) WHERE doc_id = class_id"))
    taken = {i: (size, n) for i, size, n in sql(unique, f"SELECT doc_id, size, taken FROM ({ORACLES['op3_mixing']})")}
    assert {i: n * taken[i][0] for i, n in ids(mixed).items() if taken[i][0]} == {i: n for i, (_, n) in taken.items() if n}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter()
    for i, t in texts(mixed):
        own = library.encode_ordinary(t)
        want[i, len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter(map(tuple, spark.read.parquet(coded).collect())) == want
    assert all(spark.read.parquet(p).columns == spark.read.parquet(first).columns for p in (judged, lines, unique, mixed))


def test_nulls_repeats_and_no_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    long = " ".join(f"w{i % 977}x{i % 89}" for i in range(60_000))
    rows = [(1, CLEAN[0], "en", "a", 5), (1, CLEAN[0], "en", "a", 5), (1, CLEAN[1], None, None, None), (None, CLEAN[2], "en", "a", 1), (None, None, None, None, None), (3, "", "en", "b", 0), (4, long, "en", None, 9)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {1, None, 4} and any(r.doc_id == 4 for r in out)
    assert all(r.decoded_sha256 == hashlib.sha256(long.encode()).hexdigest() for r in out if r.doc_id == 4)
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).collect() == []
