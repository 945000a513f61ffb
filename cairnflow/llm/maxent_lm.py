"""Hashed maximum-entropy language model with class-factored softmax.

P(word | history) = P(class | history) * P(slot | class, history) * P(leaf | slot, history) * share. All three softmaxes are
log-linear in hashed features of the history: the word before (n = 2), the pair before (n = 3) and the word before the last
(skip). The most frequent words, the head, have a slot each and need no leaf; every other word of the vocabulary has a class,
a slot and a leaf by its hash, and in the leaf, which some words share, its smoothed part of the leaf's count. Slots, rounds
and weight rows grow with the training tokens (Size). Weights are trained by distributed gradient updates: each task runs
over its rows in mini-batches from the same weights, and the changes are averaged by how often a row of weights was used.
The gradient is observed less expected feature counts; for the expectation one outcome is drawn from the model, which is
unbiased and as sparse as what is observed. Tokens are scored in sparse batches: a token reads only the weight rows of its
own features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cairnflow.llm.common import forget, parts, saved

#: The word that ends a text; white space, so no text has it.
END = b"\n"
#: Words that tasks look up themselves, by frequency; counts of all others are joined. A bound on what is broadcast.
HOT = 65_536
#: Tokens of a mini-batch at most; leaves of a slot; weight rows that travel together.
BATCH, LEAVES, BLOCK_ROWS = 4096, 32, 256
#: Weight rows for each feature of the three softmaxes at least, and bytes of each table at most: they are broadcast.
LEAST_ROWS, TABLE_BYTES = ((16_384, 16_384, 8_192), (65_536, 65_536, 65_536), (32_768, 32_768)), (16 << 20, 32 << 20, 16 << 20)
#: Tokens of a training task at most, and those from which on tables and rounds grow.
TASK_TOKENS, GROWN = 4_000_000, 1 << 24
#: Bytes of text whose words are counted together, and that the model reads together.
COUNT_BYTES, LM_BYTES = 4 << 20, 1 << 20
PSEUDO = 0.1


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z in lower case and split at spaces and U+0009 to U+000D, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    words, sizes = lists.flatten(), np.diff(np.asarray(lists.offsets)).astype(np.int64)
    empty = np.asarray(pc.binary_length(words)) == 0  # a text without words has an empty one
    if empty.any():
        sizes -= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[empty], minlength=len(sizes))
        words = words.filter(pa.array(~empty))
    return words, sizes


def as_bytes(words: pa.Array) -> list[bytes]:
    if not len(words):
        return []
    words = pa.concat_arrays([words])  # offsets from 0
    ends, data = np.asarray(words.cast(pa.binary()).buffers()[1]).view(np.int32)[: len(words) + 1].tolist(), words.buffers()[2].to_pybytes()
    return [data[i:j] for i, j in zip(ends, ends[1:], strict=False)]


class Size:
    """What the model has for so many training tokens and distinct words: `side` slots a class and 2 * side classes.

    Half of the classes are the head's, in which every slot is a word, by frequency; the others are the tail's. side grows
    with the fourth root of the tokens, so the head and the tail's slots with the square root, as do the weight rows up to
    TABLE_BYTES. Each token is gone over once, however many there are.
    """

    def __init__(self, tokens: int = 0, words: int = HOT, side: int = 0):
        self.side = side or max(32, round(tokens**0.25 / 20) * 8)
        self.classes, self.head = 2 * self.side, self.side**2
        self.cells = self.head * LEAVES  # all leaves of the tail's slots
        self.widths = (self.classes, self.side, LEAVES)
        grown = max(1.0, tokens / GROWN) ** 0.5
        self.rows = []
        for least, width, bound in zip(LEAST_ROWS, self.widths, TABLE_BYTES, strict=True):
            scale = max(1 / 64, min(grown, bound / 4 / width / sum(least)))
            self.rows.append(tuple(BLOCK_ROWS * max(1, int(n * scale) // BLOCK_ROWS) for n in least))
        self.batch = int(min(BATCH, max(256, tokens // 64)))
        self.rounds = 2 + int(np.log2(max(1.0, tokens / GROWN)))
        self.tasks = max(1, -(-tokens // self.rounds // TASK_TOKENS))
        # The more uses a row has, the more histories share it, and the smaller its steps.
        self.rates = [min(1.5, 3.0 / max(1.0, tokens / max(1, min(words, *own))) ** 0.5) for own in self.rows]


SMALL = Size()


def cell_of(word: bytes, size: Size = SMALL) -> int:
    """The leaf of a word that is not in the head, counted through all leaves."""
    return zlib.crc32(word) % size.cells


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text (null: the empty text) divides by 10."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n, seen) over all rows of `texts` (held_out, text): in the training rows, and in all rows.

    Tasks send each part's distinct words; Spark sums them before and after the shuffle.
    """
    schema = "word binary, n bigint, seen bigint"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, COUNT_BYTES):
            for held in (False, True):
                own = batch.column(1).filter(pc.equal(batch.column(0), held))
                if not len(own):
                    continue
                words, _ = split_words(own)
                coded = words.dictionary_encode()
                seen = np.append(np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary)), len(own))
                word = pa.concat_arrays([coded.dictionary.cast(pa.binary()), pa.array([END], pa.binary())])
                yield pa.RecordBatch.from_arrays([word, pa.array(seen * (not held), pa.int64()), pa.array(seen, pa.int64())], schema=out)

    return texts.select("held_out", "text").mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def hot_words(counts: DataFrame, most: int = HOT) -> list[tuple[bytes, int]]:
    """(word, n) of the words that are seen most often in all rows, `most` at most, by n and word.

    Words of one count are in together or not at all. The count from which on words are in is found by a histogram of
    counts in steps of some 4 %, and one of single counts within the step in which it lies, so the driver gets no more
    than these and the words themselves. The end is always in.
    """
    step = F.floor(F.log2("seen") * 16)
    room, cut = most, None
    for key, n in sorted(((r.k, r["count"]) for r in counts.groupBy(step.alias("k")).count().collect()), reverse=True):
        if n > room:
            cut = key
            break
        room -= n
    least = 0
    if cut is not None:
        inside = sorted(((r.seen, r["count"]) for r in counts.where(step == cut).groupBy("seen").count().collect()), reverse=True)
        least = inside[0][0] + 1
        for seen, n in inside:
            if n > room:
                break
            room, least = room - n, seen
    found = [(bytes(r.word), r.n) for r in counts.where((F.col("seen") >= least) | (F.col("word") == F.lit(END))).select("word", "n").collect()]
    return sorted(found, key=lambda x: (-x[1], x[0]))


class Vocabulary:
    """The hot words with their counts, and what scoring needs of the others: each leaf's mass.

    A word's code is its slot through all classes, and its cell its leaf through all tail slots, -1 in the head. A leaf has
    room for one unknown word. mass: of each leaf, by its number, summed over the vocabulary's words outside the head.
    """

    def __init__(self, hot: list[tuple[bytes, int]], mass: dict[int, float], size: Size = SMALL):
        self.size, side, head = size, size.side, size.head
        self.words = pa.array([w.decode() for w, _ in hot], pa.string())
        self.end = next((i for i, (w, _) in enumerate(hot) if w == END), -1)
        self.counts = np.array([n for _, n in hot], float)
        self.known = np.append(self.counts > 0, False)
        self.cells = np.array([-1 if i < head and n else cell_of(w, size) for i, (w, n) in enumerate(hot)], np.int64)
        self.codes = np.where(self.cells < 0, np.arange(len(hot)), head + self.cells // LEAVES)
        self.leaf_mass = np.full(size.cells, PSEUDO)
        self.leaf_mass[list(mass)] += np.fromiter(mass.values(), float, len(mass))
        self.log_mass, self.log_count = np.log(self.leaf_mass), np.log10(np.append(self.counts, 1 - PSEUDO) + PSEUDO)
        slots = np.zeros(size.classes * side)
        own = np.flatnonzero(self.cells < 0)
        slots[own] = self.counts[own] + PSEUDO
        slots[head:] = self.leaf_mass.reshape(-1, LEAVES).sum(1)
        by_class = slots.reshape(-1, side)
        share = lambda x: np.log(np.maximum(x, 1e-9) / np.maximum(x.sum(-1, keepdims=True), 1e-9)).astype(np.float32)
        self.biases = [share(by_class.sum(1))[None], share(by_class), share(self.leaf_mass.reshape(-1, LEAVES))]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """(numbers, -1 for rare words; codes; cells; tokens of each text; the rare words, and of which texts they are)."""
        words, sizes = split_words(texts)
        found = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.words), -1))
        text = np.repeat(np.arange(len(sizes)), sizes)
        number = np.full(len(found) + len(sizes), self.end, np.int64)  # a text's last token is its end
        number[np.arange(len(found)) + text] = found
        at = np.flatnonzero(found < 0)
        rare = words.take(pa.array(at))
        code, cell = (self.codes[number], self.cells[number]) if len(self.codes) else (np.zeros_like(number), np.zeros_like(number))
        place = at + text[at]
        cell[place] = np.fromiter(map(zlib.crc32, as_bytes(rare)), np.int64, len(rare)) % self.size.cells
        code[place] = self.size.head + cell[place] // LEAVES
        return number, code, cell, sizes + 1, rare, text[at]


def hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """31 bits of a hash of both."""
    x = a * 0x1E3779B97F4A7C15
    x += b
    x *= 0x56E8FEB86659FD93
    x >>= 32
    x &= 0x7FFFFFFF
    return x


def place(h: np.ndarray, start: int, n: int) -> np.ndarray:
    """One of `n` rows from `start` on for each 31-bit hash."""
    x = h * n
    x >>= 31
    x += start
    return x


class Features:
    """The weight rows of each token's history in the three softmaxes. Rare words count as their leaf."""

    def __init__(self, number: np.ndarray, code: np.ndarray, cell: np.ndarray, sizes: np.ndarray, size: Size = SMALL):
        seen = np.where(number < 0, HOT + cell, number)
        start = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        one, two = np.empty_like(seen), np.empty_like(seen)
        one[1:], two[2:] = seen[:-1], seen[:-2]
        none = HOT + size.cells
        one[start] = two[start] = none
        two[start[sizes > 1] + 1] = none
        pair = hashed(one, two)
        cls = code // size.side
        (a, b, c), (d, e, f), (g, h) = size.rows
        self.tail = np.flatnonzero(cell >= 0)
        slot = code[self.tail]
        self.rows = [
            np.stack([place(hashed(one, 1), 0, a), place(pair, a, b), place(hashed(two, 2), a + b, c)]),
            np.stack([place(hashed(one, cls), 0, d), place(hashed(pair, cls), d, e), place(hashed(two, cls), d + e, f)]),
            np.stack([place(hashed(one[self.tail], slot), 0, g), place(hashed(pair[self.tail], slot), g, h)]),
        ]
        self.outcome = [cls, code % size.side, cell[self.tail] % LEAVES]
        self.under = [np.zeros_like(cls), cls, slot - size.head]


class Weights:
    """A table for each softmax: a row of the logits of all outcomes for each hashed feature."""

    def __init__(self, size: Size = SMALL):
        self.tables = [np.zeros((sum(rows), width), np.float32) for rows, width in zip(size.rows, size.widths, strict=True)]

    def sent(self) -> list[np.ndarray]:
        """The tables in half precision, as they are broadcast."""
        return [t.astype(np.float16) for t in self.tables]

    @classmethod
    def received(cls, tables: list[np.ndarray]) -> Weights:
        out = cls.__new__(cls)
        out.tables = [t.astype(np.float32) for t in tables]
        return out


def logits(table: np.ndarray, bias: np.ndarray, rows: np.ndarray, under: np.ndarray) -> np.ndarray:
    x = np.take(table, rows[0], 0)
    for own in rows[1:]:
        x += np.take(table, own, 0)
    x += np.take(bias, under, 0) if len(bias) > 1 else bias
    return x


def log_normaliser(x: np.ndarray) -> np.ndarray:
    """log of the sum of exp of each row. Single precision holds exp of -80 to 80, and logits are far from both."""
    return np.log(np.exp(np.minimum(x, 80, out=x), out=x) @ np.ones(x.shape[1], np.float32))


class Updates:
    """Gradient steps on one table; a row's step size falls with the square root of its uses, so far and in the mini-batch."""

    def __init__(self, table: np.ndarray, rate: float):
        self.table, self.flat, self.rate, self.used = table, table.reshape(-1), np.float32(rate), np.zeros(len(table), np.float32)

    def step(self, rows: np.ndarray, seen: np.ndarray, drawn: np.ndarray) -> None:
        wrong = np.flatnonzero(seen != drawn)  # elsewhere the two counts cancel
        own = rows[:, wrong]
        before = np.take(self.used, own)
        np.add.at(self.used, rows.ravel(), np.float32(1))
        now = np.take(self.used, own)
        rate = (self.rate / np.sqrt(now * np.sqrt(now - before))).ravel()
        at = own * self.table.shape[1]
        np.add.at(self.flat, (at + seen[wrong]).ravel(), rate)
        np.subtract.at(self.flat, (at + drawn[wrong]).ravel(), rate)


def _train(vocabulary: Vocabulary, start: list[np.ndarray], batches: Iterator[pa.RecordBatch], earlier: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """(a table, uses of its rows) after one run over the rows of a task from `start`; steps are smaller in later rounds."""
    size = vocabulary.size
    updates = [Updates(t.astype(np.float32), rate / (1 + earlier) ** 0.5) for t, rate in zip(start, size.rates, strict=True)]
    rng = np.random.Generator(np.random.PCG64(5))
    # The largest of logits plus Gumbel noise is a draw from their softmax; the noise is used from a random row on.
    noise = rng.gumbel(size=(5 * size.batch, max(size.widths))).astype(np.float32)
    for batch in parts(batches, LM_BYTES):
        number, code, cell, sizes, _, _ = vocabulary.encode(batch.column(0))
        made = Features(number, code, cell, sizes, size)
        for own, bias, rows, outcome, under in zip(updates, vocabulary.biases, made.rows, made.outcome, made.under, strict=True):
            for at in range(0, len(outcome), size.batch):
                part, shift = slice(at, at + size.batch), int(rng.integers(4 * size.batch))
                x = logits(own.table, bias, rows[:, part], under[part])
                x += noise[shift : shift + len(x), : x.shape[1]]
                own.step(rows[:, part], outcome[part], x.argmax(1))
    return [(u.table, u.used) for u in updates]


#: change: half-precision floats, the change of each weight; uses: single-precision floats, one for each row.
CHANGES = "piece int, change binary, uses binary"


def _summed(changes: DataFrame) -> DataFrame:
    """The changes of each piece, averaged by uses, as they stream in; a task holds its own pieces' sums only."""
    out = to_arrow_schema(StructType.fromDDL(CHANGES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for piece, change, uses in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = np.frombuffer(uses, np.float32)
                x = [np.frombuffer(change, np.float16).astype(np.float32).reshape(len(n), -1) * n[:, None], n]
                sums[piece] = [a + b for a, b in zip(sums[piece], x, strict=True)] if piece in sums else x
        for piece, (change, n) in sums.items():
            mean = (change / np.maximum(n, 1)[:, None]).astype(np.float16)
            yield pa.RecordBatch.from_pydict({"piece": [piece], "change": [mean.tobytes()], "uses": [n.tobytes()]}, schema=out)

    return changes.repartition("piece").mapInArrow(run, CHANGES)


def train(texts: DataFrame, vocabulary: Vocabulary) -> Weights:
    """Weights after the rounds of the model's size; each row of `texts` (columns part, text) is used once.

    A round's tasks start from the same weights; each sends, for pieces of BLOCK_ROWS rows, its changes and their uses.
    A table has hundreds of pieces, which share the means' work among tasks; the model, whose tables are bounded, is all that the driver receives.
    """
    spark, size = texts.sparkSession, vocabulary.size
    weights, words = Weights(size), spark.sparkContext.broadcast(vocabulary)
    out = to_arrow_schema(StructType.fromDDL(CHANGES))
    where = [(t, k) for t in weights.tables for k in range(0, len(t), BLOCK_ROWS)]
    for r in range(size.rounds):
        shared = spark.sparkContext.broadcast(weights.sent())

        def run(batches: Iterator[pa.RecordBatch], shared=shared, r=r) -> Iterator[pa.RecordBatch]:
            piece = 0
            for (table, uses), start in zip(_train(words.value, shared.value, batches, r), shared.value, strict=True):
                for k in range(0, len(uses), BLOCK_ROWS):
                    n = uses[k : k + BLOCK_ROWS]
                    if n.any():
                        change = table[k : k + BLOCK_ROWS] - start[k : k + BLOCK_ROWS]
                        yield pa.RecordBatch.from_pydict({"piece": [piece], "change": [change.astype(np.float16).tobytes()], "uses": [n.tobytes()]}, schema=out)
                    piece += 1

        changes = texts.where(F.col("part") == r).select("text").coalesce(size.tasks).mapInArrow(run, CHANGES)
        merged = saved(_summed(changes), "lm-changes")
        for row in merged.toLocalIterator():
            t, k = where[row.piece]
            t[k : k + BLOCK_ROWS] += np.frombuffer(row.change, np.float16).reshape(-1, t.shape[1])
        shared.destroy(blocking=True)  # its files on all machines
        forget(merged)
    return weights


def token_scores(vocabulary: Vocabulary, weights: Weights, number: np.ndarray, code: np.ndarray, cell: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 P(word | history) of each token, less log10(count + PSEUDO) for words outside the head."""
    made = Features(number, code, cell, sizes, vocabulary.size)
    score = np.zeros(len(number))
    score[made.tail] = -vocabulary.log_mass[cell[made.tail]]
    for k, (table, bias, rows, outcome, under) in enumerate(zip(weights.tables, vocabulary.biases, made.rows, made.outcome, made.under, strict=True)):
        for at in range(0, len(outcome), BATCH):
            part = slice(at, at + BATCH)
            x = logits(table, bias, rows[:, part], under[part])
            own = x[np.arange(len(x)), outcome[part]]
            score[made.tail[part] if k == 2 else part] += own - log_normaliser(x)
    return score / np.log(10)


def times_in_texts(words: pa.Array, text: np.ndarray, texts: int) -> pa.Array:
    """For each of `texts` texts its distinct words, with how often it has them."""
    coded = words.dictionary_encode()
    n = max(1, len(coded.dictionary))
    pair, times = np.unique(text * n + np.asarray(coded.indices), return_counts=True)
    kinds = [pa.field("word", pa.binary()), pa.field("times", pa.int64())]
    rows = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(pair % n)).cast(pa.binary()), pa.array(times, pa.int64())], fields=kinds)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(pair, np.arange(texts + 1) * n), pa.int32()), rows)


def score_batch(vocabulary: Vocabulary, weights: Weights, texts: pa.Array) -> dict[str, object]:
    """For each text: tokens, hot tokens that training has, the sum of log10(count + PSEUDO) over hot tokens, the rest of
    log10 P, and its rare words with how often it has them.

    log10 P of a text is its rest plus log10(count + PSEUDO) of its rare words.
    """
    number, code, cell, sizes, rare, text = vocabulary.encode(texts)
    base = vocabulary.log_count[number]  # that of rare words, at -1, is 0
    score = token_scores(vocabulary, weights, number, code, cell, sizes) + np.where(cell >= 0, base, 0.0)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    total = lambda x: np.add.reduceat(x, first) if len(first) else np.empty(0, x.dtype)
    return {"n_tokens": sizes, "hot_known": total(vocabulary.known[number].astype(np.int64)), "hot_sum": total(base), "rest": total(score), "rare": times_in_texts(rare, text, len(sizes))}


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The score of each whole text of `docs` under a model of those that are not held out.

    Returns id, held_out, n_tokens, n_known (tokens that training texts have), train_tokens, base_score (sum of
    log10((c + 0.1) / (N + 0.1 * (V + 1)))) and score (the model's log10 probability of the text; over all words and one
    unknown word for each leaf, probabilities sum to 1). Counts cover all training rows, and each of them is used in
    training. Words beyond the HOT most frequent ones are less than 1 / HOT of all tokens each, so joining their counts
    has no hot key. Null and empty texts are one end. Null ids are held out. Repeated rows give a row each; other columns
    are not read; an empty table gives no rows, and without training rows all words are unknown.
    """
    spark = docs.sparkSession
    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    counts = saved(word_counts(rows), "lm-counts")
    known = counts.where("n > 0")
    total, size = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    model = Size(total, size)
    hot = hot_words(counts)
    cell = F.crc32("word") % model.cells
    mass = {r.c: r.m for r in known.groupBy(cell.alias("c")).agg(F.sum(F.col("n") + PSEUDO).alias("m")).collect()}
    for w, n in hot[: model.head]:  # the head's words have slots of their own
        if n:
            mass[cell_of(w, model)] -= n + PSEUDO
    vocabulary = Vocabulary(hot, {c: max(0.0, m) for c, m in mass.items()}, model)
    parted = rows.where(~F.col("held_out")).select(F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(model.rounds)).alias("part"), "text")
    weights = train(parted, vocabulary)
    words, shared = spark.sparkContext.broadcast(vocabulary), spark.sparkContext.broadcast(weights.sent())
    schema = f"row bigint, id {kind}, held_out boolean, n_tokens bigint, hot_known bigint, hot_sum double, rest double, rare array<struct<word:binary,times:bigint>>"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights = words.value, Weights.received(shared.value)
        for batch in parts(batches, LM_BYTES):
            yield pa.RecordBatch.from_pydict({n: batch.column(i) for i, n in enumerate(("row", "id", "held_out"))} | score_batch(vocabulary, weights, batch.column(3)), schema=out)

    scored = saved(rows.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "text").mapInArrow(run, schema), "lm-scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times").join(known.select("word", "n"), "word", "left")
    known_times = F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0))
    rare = rare.groupBy("row").agg(known_times.alias("rare_known"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + PSEUDO)).alias("rare_sum"))
    both = scored.drop("rare").join(rare, "row", "left").na.fill(0, ["rare_known", "rare_sum"])
    unit = float(np.log10(total + PSEUDO * (size + 1)))
    return both.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("hot_known") + F.col("rare_known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("hot_sum") + F.col("rare_sum") - F.col("n_tokens") * unit).alias("base_score"), (F.col("rest") + F.col("rare_sum")).alias("score"),
    )
