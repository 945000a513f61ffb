"""Held-out accuracy and brute force for what SQL cannot express."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cairnflow.llm import html_extract, maxent_lm
from cairnflow.llm.html_samples import labelled_pages
from cairnflow.llm.near_dups import jaccard_join
from cairnflow.llm.quality import quality_rules


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = []
    for _ in range(600):
        own = rng.choice([["le", "la", "que", "de", "oiseau", "eau"], ["the", "of", "and", "thing", "with", "is"]])
        out.append(" ".join(rng.choice(own) if rng.random() < 0.8 else rng.choice(own) + str(rng.randrange(50)) for _ in range(rng.randint(5, 60))))
    return out


def test_language_model(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in maxent_lm.lm_scores(docs).collect()}
    tokens = lambda t: [*t.lower().split(), "\n"]
    counts = Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        want = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
        assert abs(got[i].base_score - want) < 1e-6 and got[i].train_tokens == n
        assert got[i].n_known == sum(counts[w] > 0 for w in tokens(t))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_probabilities_sum_to_one(texts):
    """Over the whole vocabulary and one unknown word for each leaf, after several histories and with weights that matter."""
    counts = Counter(w for t in texts for w in [*t.lower().encode().split(), maxent_lm.END])
    hot = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    size = maxent_lm.Size(side=4)  # a head of 16 words, 512 leaves
    mass = Counter()
    for w, c in hot[size.head :]:
        mass[maxent_lm.cell_of(w, size)] += c + maxent_lm.PSEUDO
    looked_up = hot[:40]  # the others are rare, and their counts are joined
    vocabulary, weights = maxent_lm.Vocabulary(looked_up, mass, size), maxent_lm.Weights(size)
    rng = np.random.Generator(np.random.PCG64(1))
    for t in weights.tables:
        t += rng.normal(size=t.shape).astype(np.float32)
    unknown, k = {}, 0
    while len(unknown) < size.cells:
        word = f"new{k}".encode()
        unknown.setdefault(maxent_lm.cell_of(word, size), word)
        k += 1
    words = [w.decode() for w in (*(w for w, _ in hot if w != maxent_lm.END), *unknown.values())]
    for history in ("", "le", "de la", "unheard thing1", "le de la que"):
        rows = pa.array([f"{history} {w}" for w in words] + [history])
        number, code, cell, sizes, _, _ = vocabulary.encode(rows)
        score = maxent_lm.token_scores(vocabulary, weights, number, code, cell, sizes)
        ends = np.cumsum(sizes)
        at = np.append(ends[:-1] - 2, ends[-1] - 1)  # the word after the history, and the end after it
        found = [counts[w.encode()] for w in words] + [counts[maxent_lm.END]]
        p = 10 ** (score[at] + np.where(cell[at] >= 0, np.log10(np.array(found) + maxent_lm.PSEUDO), 0))
        assert abs(p.sum() - 1) < 1e-3, (history, p.sum())


def test_near_an_interpolated_bigram(spark):
    """Held-out rows of the small table: well above the base, and most of the way to a bigram that keeps every pair."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = [r for r in maxent_lm.lm_scores(rows).collect() if r.held_out]
    n = sum(r.n_tokens for r in found)
    base, score = sum(r.base_score for r in found) / n, sum(r.score for r in found) / n
    assert base < -4.0 and score > -3.6, (base, score)


def test_quality_columns(spark):
    rng = random.Random(9)
    words = ["aa", "b", "ccc", "#d", "e|f"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t ", "\x0b"]) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    texts += ["a b c d e f g h i j k l m n"] * 2 + ["x " * 40, "\n\nq\nq\n q", "one two three four five one two three four five"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 150, 3)], "doc_id bigint, quality int")
    for r in quality_rules(docs, labels).collect():
        t = texts[r.doc_id]
        own = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
        n = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(t)
        assert r.base_failed == (len(own) < 10 or 100 * len(covered) > 20 * len(own))


def test_links_against_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 30, 120]))]
        for _ in range(rng.randint(1, 8)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
            texts.append(" ".join(own))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {i: sum(near(i, j) for j in range(len(texts)) if j != i) for i in range(len(texts))}
    import cairnflow.llm.near_dups as nd

    for block in (1000, 3):  # one comparison, and many pairs of blocks
        old, nd.BLOCK = nd.BLOCK, block
        assert {r.doc_id: r.n_links for r in jaccard_join(docs).collect()} == want
        nd.BLOCK = old


def line_f1(found, pages):
    hits = sum(len(set(a.split("\n")) & set(b.split("\n"))) for a, (_, b) in zip(found, pages, strict=True))
    return 2 * hits / sum(len(set(a.split("\n"))) + len(set(b.split("\n"))) for a, (_, b) in zip(found, pages, strict=True))


def test_extractor_on_held_out_pages():
    pages = labelled_pages(150, first_seed=50_000)
    assert line_f1(html_extract.main_texts([h for h, _ in pages], html_extract.default_model()), pages) > 0.93


def test_extractor_on_layouts_that_training_lacks():
    """Element and class names of all parts of the page are others than in training."""
    model = html_extract.train(labelled_pages(300, unseen=False))
    pages = labelled_pages(150, first_seed=50_000, unseen=True)
    f1 = line_f1(html_extract.main_texts([h for h, _ in pages], model), pages)
    everything = ["\n".join(t for _, t in html_extract.Page(h).segments) for h, _ in pages]
    assert f1 > 0.85 and f1 > line_f1(everything, pages) + 0.1, f1


@pytest.mark.parametrize("bad", ["<p ", '<a ">" ', "<b>x", "<div>", "<!-- ", "</div>", "<p '", "&amp", "<i><div>" + "<b>" * 50 + "</i>" * 50, "< ", "<li>", '<a href="x>'])
def test_malformed_pages_take_linear_time(bad):
    import time

    took = []
    for size in (1 << 17, 1 << 20):
        began = time.process_time()
        html_extract.main_texts([bad * (size // len(bad))], html_extract.default_model())
        took.append(time.process_time() - began)
    assert took[1] < 25 and took[1] < 24 * max(took[0], 0.1), took


def test_messages_against_enumeration():
    page = html_extract.Page("<div class=ad>x<p>a b.</p></div><article><p>c</p></article>")
    forest = html_extract.Forest([page])
    rng = np.random.Generator(np.random.PCG64(2))
    weights, edge = rng.normal(size=len(html_extract.FEATURES)), rng.normal(size=(2, 2))
    n, listed, total, ones = len(page.tag), html_extract.features(page), 0.0, np.zeros(len(page.tag))
    for k in range(1 << n):
        y = [(k >> i) & 1 for i in range(n)]
        w = math.exp(sum(weights[f] for i in range(n) if y[i] for f in listed[i]) + sum(edge[y[page.parent[i]], y[i]] for i in range(1, n)))
        total += w
        ones += w * np.array(y)
    p, _, log_z = forest.marginals(weights, edge)
    assert np.allclose(p, ones / total) and abs(log_z - math.log(total)) < 1e-9
