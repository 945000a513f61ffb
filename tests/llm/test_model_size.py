"""The language model grows with its tokens, and words outside the head depend on their history."""

import random

from cairnflow.llm import maxent_lm


def test_model_grows_with_tokens():
    sizes = [maxent_lm.Size(n) for n in (10_000, 16_000_000, 80_000_000, 5_000_000_000)]
    assert [s.side for s in sizes] == [32, 32, 40, 104]
    for a, b in zip(sizes[1:], sizes[2:], strict=False):
        assert a.head < b.head and a.classes < b.classes and a.cells < b.cells and a.rounds < b.rounds and a.tasks < b.tasks
    assert sum(sizes[1].rows[1]) < sum(sizes[2].rows[1])
    for s in sizes:  # the tables are broadcast
        for rows, width, bound in zip(s.rows, s.widths, maxent_lm.TABLE_BYTES, strict=True):
            assert sum(rows) * width * 4 <= bound


def test_history_tells_words_of_one_prefix_apart(spark):
    n, rng = 1500, random.Random(6)  # all of the same first two bytes, a third beyond the head
    texts = []
    for _ in range(2500):
        at = rng.randrange(n)
        texts.append(" ".join(f"ww{(at + k) % n}" for k in range(20)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    held = [r for r in maxent_lm.lm_scores(docs).collect() if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 1, gain


def test_training_rows_are_used_once_in_few_tokens_too(spark, monkeypatch):
    tables, saved = [], maxent_lm.saved
    monkeypatch.setattr(maxent_lm, "saved", lambda df, name: (tables.append(name), saved(df, name))[1])
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} w{i % 3}") for i in range(90)], "doc_id bigint, text string")
    maxent_lm.lm_scores(docs).collect()
    assert tables.count("lm-changes") == maxent_lm.Size(4 * 90).rounds
