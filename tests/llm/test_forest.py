"""The forest: how prefixes get shorter, and links and classes against brute force, however groups are taken apart."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnflow.llm import near_dups as nd


def miss(lengths, threshold=0.8):
    return np.exp(sum(nd.log_miss(d, threshold) for d in lengths))


def test_prefixes_are_shortened_until_the_recall_is_reached(spark):
    rows = spark.range(1, nd.TREES + 1).select(F.col("id").cast("int").alias("crowded"))
    rows = rows.withColumn("rank", F.explode(F.sequence(F.lit(1), F.col("crowded"))))
    rows = rows.withColumn("length", nd.shortened(F.col("crowded"), F.col("rank"), 0.8, 0.9999))
    by_text = {}
    for r in rows.collect():
        by_text.setdefault(r.crowded, {})[r.rank] = r.length
    for crowded, found in by_text.items():
        lengths = [found[k] for k in sorted(found)]
        free = [nd.SHORTEST] * (nd.TREES - crowded)
        assert lengths == sorted(lengths) and lengths[-1] - lengths[0] <= 1  # the least crowded nodes first, in turn
        assert miss(free + lengths) <= 1e-4 * 1.000001
        if lengths[0] < nd.DEPTH:  # and no further: without the last one it isn't
            last = lengths.count(lengths[0]) - 1
            assert miss(free + lengths[:last] + [lengths[last] + 1] + lengths[last + 1 :]) > 1e-4
    assert by_text[4] == {1: 8, 2: 8, 3: 8, 4: 8} and by_text[nd.TREES][1] == 6
    with pytest.raises(ValueError, match="recall"):
        nd.check_recall(0.3, 0.9999)


def made(rng):
    """Groups of near copies, one of them large, and a chain of texts in which only neighbours are near."""
    texts = []
    for size, words in ((40, 60), (9, 30), (5, 4), (3, 200)):
        base = [f"w{rng.randrange(900)}" for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
            texts.append(" ".join(own))
    chain = [f"c{i}" for i in range(300)]
    texts += [" ".join(chain[6 * k : 6 * k + 120]) for k in range(25)]
    return texts + ["", "one", "one", " ", "é é é é é é"]


@pytest.mark.parametrize(("block", "crowd", "shingles"), [(1000, 64, 1_000_000), (6, 4, 500)])
def test_links_and_classes_against_brute_force(spark, monkeypatch, block, crowd, shingles):
    monkeypatch.setattr(nd, "BLOCK", block)
    monkeypatch.setattr(nd, "CROWD", crowd)
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", shingles)
    texts = made(random.Random(8))
    sets = []
    for t in texts:
        own = t.split()
        sets.append({tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set())
    n = len(texts)
    same = lambda i, j: texts[i] == texts[j]
    near = lambda i, j: bool(sets[i]) and not same(i, j) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if same(i, j) or near(i, j):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = {r.doc_id: r for r in nd.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)).collect()}
    for i in range(n):
        assert got[i].n_links == sum(j != i and (same(i, j) or near(i, j)) for j in range(n)), i
        assert got[i].copy_id == min(j for j in range(n) if same(i, j)) and got[i].class_id == root[i]
        assert got[i].n_text_links == len({texts[j] for j in range(n) if near(i, j)})


def test_hashes_of_all_texts_are_not_shuffled_for_those_in_crowded_nodes(spark, monkeypatch):
    plans, saved = {}, nd.saved

    def seen(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return saved(df, name)

    monkeypatch.setattr(nd, "saved", seen)
    monkeypatch.setattr(nd, "CROWD", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame(list(enumerate(made(random.Random(8)))), "doc_id bigint, text string")
        assert max(r.n_text_links for r in nd.jaccard_join(docs).collect()) > 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plans["near-prefixes"] and "SortMergeJoin" not in plans["near-prefixes"]
    assert "hashpartitioning" not in plans["near-prefixes"]
