import numpy as np
import pytest

from cairnflow.llm.line_dedup import CuckooFilter, LineIndex, deduped_lines, postings


def test_filter_inserts_and_removes():
    rng = np.random.Generator(np.random.PCG64(1))
    h = np.unique(rng.integers(0, 1 << 63, 20_000, np.uint64))
    made = CuckooFilter(len(h))
    made.insert(h[:15_000])
    assert made.contains(h[:15_000]).all() and made.contains(h[15_000:]).mean() < 0.01
    made.remove(h[:7_000])
    assert made.contains(h[7_000:15_000]).all() and made.contains(h[:7_000]).mean() < 0.01
    assert (CuckooFilter.from_bytes(made.to_bytes()).table == made.table).all()
    with pytest.raises(OverflowError):
        CuckooFilter(100).insert(h)


def counts(index):
    return {bytes(r.key): (r.docs, r.first) for r in index.live().collect()}


def test_removal_undoes_insertion(spark):
    a = spark.createDataFrame([(i, f"a shared line of all\nline number {i // 2} is shared\nown line {i} alone") for i in range(40)], "doc_id bigint, text string")
    b = spark.createDataFrame([(i, f"a shared line of all\nown line {i - 50} alone\nnew line {i} here") for i in range(60, 90)], "doc_id bigint, text string")
    first = LineIndex.empty(spark, shards=1).insert(postings(a))
    both = first.insert(postings(b))
    assert counts(both.insert(postings(b))) == counts(both)
    assert counts(both) == counts(LineIndex.empty(spark).insert(postings(a.unionByName(b))))
    again = both.remove(b.selectExpr("doc_id doc"))
    assert counts(again) == counts(first)
    without = both.remove(spark.createDataFrame([(0,)], "doc bigint"))
    assert min(f for _, f in counts(without).values()) == 1
    asked = set(counts(both))
    seen = {bytes(r.key) for r in again._asked(both.live().select("key")).collect()}
    assert set(counts(first)) <= seen and len(asked - seen) > 25
    assert counts(again.insert(postings(b))) == counts(both)
    small = again.compacted()
    assert counts(small) == counts(first) and counts(small.insert(postings(b))) == counts(both)
    fine = both.resharded(5)
    assert fine.filters.count() == 5 and {bytes(r.key) for r in fine._asked(both.live().select("key")).collect()} == asked
    assert counts(fine.remove(b.selectExpr("doc_id doc"))) == counts(first)


def texts_of(n):
    return [(i, f"a line that all share\nline of three {i // 3} documents\nown line number {i}") for i in range(n)]


def test_the_rows_depend_on_the_filters(spark, monkeypatch):
    docs = spark.createDataFrame(texts_of(90), "doc_id bigint, text string")
    rows = lambda **how: {r.doc_id: r.text for r in deduped_lines(docs, **how)[0].collect()}
    want = {i: t if i == 0 else "\n".join(t.split("\n")[1 + (i % 3 > 0) :]) for i, t in texts_of(90)}
    assert rows() == want and rows(batches=3, put_back=4) == want and rows(batches=1) == want
    whole = LineIndex._refiltered
    monkeypatch.setattr(LineIndex, "_refiltered", lambda self, changed, add: whole(self, changed, add).limit(0))
    assert rows() != want  # filters that let nothing through


def test_shards_are_dealt_anew_as_keys_come(spark, monkeypatch):
    monkeypatch.setattr("cairnflow.llm.line_dedup.SHARD_KEYS", 40)
    index, sizes = None, []
    for k in range(4):
        part = spark.createDataFrame([(i + 50 * k, t + f" of {k}") for i, t in texts_of(50)], "doc_id bigint, text string")
        _, index = deduped_lines(part, index)
        sizes.append(index.shards)
    assert sizes[-1] > sizes[0] and index.keys == len(counts(index)) <= 2 * 40 * index.shards


def test_incremental_dedup(spark):
    a = spark.createDataFrame([(5, "the very same line\nshort\nshort")], "doc_id bigint, text string")
    b = spark.createDataFrame([(7, "  THE very same LINE \nshort\nanother line here"), (9, None)], "doc_id bigint, text string")
    _, index = deduped_lines(a)
    out = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in deduped_lines(b, index)[0].collect()}
    assert out == {7: ("short\nanother line here", 3, 1), 9: ("", 1, 0)}
