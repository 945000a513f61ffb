"""Planted junk and clean texts at several table sizes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnflow.llm import quality
from cairnflow.llm.quality import quality_rules


def made(n: int) -> tuple[list[str], set[int]]:
    """`n` texts, and which of them are junk: every eighth has words that clean texts lack."""
    rng = random.Random(n)
    known = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    odds = [1 / (k + 1) for k in range(len(known))]
    texts, junk = [], set(range(0, n, 8))
    for i in range(n):
        size = rng.randint(30, 300)
        own = rng.choices(known, odds, k=size)
        texts.append(" ".join(w.upper() + rng.choice("#$%&*") * 3 for w in own) if i in junk else " ".join(own))
    return texts, junk


@pytest.mark.parametrize("n", [160, 800, 4000])
def test_junk_goes_and_clean_texts_stay(spark, n):
    texts, junk = made(n)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i not in junk)) for i in range(0, n) if i % 5 < 2], "doc_id bigint, quality int")
    rows = [r for r in quality_rules(docs, labels).collect() if not r.base_failed]
    gone = {r.doc_id for r in rows if not r.kept}
    bad = [r.doc_id for r in rows if r.doc_id in junk]
    assert len(bad) > n // 10 and len(gone & set(bad)) >= 0.95 * len(bad)
    assert len(gone - junk) <= 0.03 * n


def test_all_rows_labelled_good_are_trusted(spark):
    labels = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert quality.trusted_ids(labels.union(labels)).count() == 60_000


def test_percentiles_equal_numpys(spark):
    rng = np.random.default_rng(3)
    for values in ([0.5], [-1.5, 2.25], [0.1] * 50 + [0.1 + 1e-12] * 49, rng.normal(0, 1, 3001).tolist(), (rng.integers(-9, 9, 500) / 7).tolist()):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "llr double").repartition(3)
        n, found = quality.percentiles(df, [0.01, 0.25, 0.75])
        assert n == len(values) and np.allclose(found, np.percentile(values, [1, 25, 75]), rtol=0, atol=1e-15 * 8)
    assert quality.percentiles(spark.createDataFrame([], "llr double"), [0.5]) == (0, [])


def test_ids_beyond_a_broadcast_give_the_same_rows(spark, monkeypatch):
    texts, junk = made(160)
    rows = [*enumerate(texts), (None, texts[1]), (None, texts[2]), (3, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i not in junk)) for i in range(0, 160, 2)], "doc_id bigint, quality int")
    want = sorted(quality_rules(docs, labels, digest=True).collect(), key=str)
    monkeypatch.setattr(quality, "BROADCAST_BYTES", 0)
    assert sorted(quality_rules(docs, labels, digest=True).collect(), key=str) == want and len(want) == 163
