"""Quality rules: repetition and length rules, then a hashed n-gram log-likelihood ratio. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.common import BROADCAST_BYTES, broadcast_if_small, saved, value_bytes

GAP, SYMBOL = r"[\x20\x09-\x0D]+", "[#*$%&|<>]"
#: n-grams of one and two words are hashed into so many buckets: the size of the broadcast weights, whatever the data.
BUCKETS = 1 << 16
#: Weights are whole millionths, so that sums don't depend on the order of addition.
UNIT = 1_000_000
WINDOW = 5
#: Pseudo-counts of the trusted model as a share of its n-grams: no n-gram weighs less than ln(PRIOR / (1 + PRIOR)).
PRIOR = 0.1
#: Parts of a unit in the bins by which percentiles are found; mean weights lie between some -3 and 50.
SCALES = (10**3, 10**6, 10**9)
#: Held-back trusted rows without which their spread is not known, and n-grams that such a row has at least.
MIN_HELD, MIN_GRAMS = 8, 20


def let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text, words, hashes): row numbers tell repeated rows apart within one job."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", GAP), ""))
    return rows.withColumn("hashes", F.transform("words", lambda w: F.crc32(w.cast("binary"))))


def gram_buckets() -> Column:
    """The buckets of all words and word pairs of a row: CRC-32 of a word, and for a pair a mix of both, by whole numbers."""
    single = F.transform("hashes", lambda h: h % BUCKETS)
    pair = lambda h, i: F.shiftright(F.get("hashes", i) * 1_103_515 + h * 12_345, 11) % BUCKETS
    double = F.transform(F.slice("hashes", F.lit(2), F.greatest(F.size("hashes") - 1, F.lit(0))), pair)
    return F.concat(single, double)


def repeat_words() -> Column:
    """Words in windows of WINDOW words that are found twice or more in the row; windows are compared by 64-bit hashes."""
    starts = F.when(F.size("hashes") >= WINDOW, F.sequence(F.lit(0), F.size("hashes") - WINDOW)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]))

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        first = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        add = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last"))
        return F.aggregate(at, first, add, lambda acc: acc["n"])

    return let(windows, lambda w: F.when(F.size(w) == F.size(F.array_distinct(w)), F.lit(0)).otherwise(covered(w))).cast("long")


def base_columns() -> dict[str, Column]:
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size("words").cast("long"),
        "word_chars": F.char_length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.regexp_count("text", F.lit(SYMBOL)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(),
    }


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(trusted_id, held): the ids of all rows labelled good; every fifth, by hash, is held back for the threshold."""
    good = labels.where(F.col("quality") == 1).where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("trusted_id")).distinct()
    return good.withColumn("held", F.crc32(F.concat(F.lit("held "), F.col("trusted_id").cast("string")).cast("binary")) % 5 == 0)


def with_trusted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """`rows` (row, id and others) with trusted_id: the id if `ids` (distinct, of a saved table) has it, else null.

    Up to BROADCAST_BYTES of ids are broadcast. Beyond, the rows are shuffled, those without an id by their number; Spark
    splits the rows of a hot id.
    """
    if value_bytes(ids) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(ids), F.col("id") == F.col("trusted_id"), "left")
    spread = F.when(F.col("id").isNull(), F.col("row")).otherwise(F.lit(0)).alias("spread")
    ids = ids.withColumn("own_spread", F.lit(0).cast("long"))
    return rows.select("*", spread).join(ids, (F.col("id") == F.col("trusted_id")) & (F.col("spread") == F.col("own_spread")), "left").drop("spread", "own_spread")


def percentiles(values: DataFrame, shares: list[float]) -> tuple[int, list[float]]:
    """(number of values, the exact percentiles), between two values by proportion, of `values` (saved, column llr).

    The values at the ranks in question are found by histograms, each within the bins of the one before in which such a
    rank lies, so neither a task nor the driver holds all values.
    """
    levels = [F.floor(F.col("llr") * scale).alias(f"bin{k}") for k, scale in enumerate(SCALES)] + [F.col("llr")]
    inside = values.where("llr IS NOT NULL").select(*levels)
    names, n, at = inside.columns, 0, {}
    for k in range(len(names)):
        found = sorted(tuple(r) for r in inside.groupBy(*names[: k + 1]).agg(F.count(F.lit(1)).alias("n")).collect())
        if k == 0:
            n = sum(r[-1] for r in found)
            if not n:
                return 0, []
            places = [share * (n - 1) for share in shares]
            at = {(): (0, {f(p) for p in places for f in (math.floor, math.ceil)})}  # rows before each bin; the ranks in it
        wanted: dict[tuple, tuple[int, set[int]]] = {}
        before: dict[tuple, int] = {}
        for *key, count in found:
            above = tuple(key[:-1])
            if above not in at:
                continue
            start = before.get(above, at[above][0])
            own = {rank for rank in at[above][1] if start <= rank < start + count}
            if own:
                wanted[tuple(key)] = start, own
            before[above] = start + count
        at = wanted
        inside = inside.where(F.col(names[k]).isin([key[-1] for key in at]))
    value = {rank: key[-1] for key, (_, ranks) in at.items() for rank in ranks}
    out = []
    for p in places:
        low, high = value[math.floor(p)], value[math.ceil(p)]
        out.append(low if low == high else (math.ceil(p) - p) * low + (p - math.floor(p)) * high)
    return n, out


def llr_weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, weight): ln of the bucket's probability under the trusted rows over that under all rows, in UNITs.

    One row for each of the BUCKETS buckets. The trusted multinomial is smoothed by pseudo-counts in proportion to all
    rows, PRIOR times as many as there are trusted n-grams, so weights have the same range at every size.
    """
    words = with_trusted(with_words(docs, id_col, text_col), trusted.where(~F.col("held")).select("trusted_id"))
    words = words.select(F.col("trusted_id").isNotNull().cast("long").alias("good"), gram_buckets().alias("buckets"))
    # explode_outer: explode would have a filter on the array pushed down, and the array made again for it.
    counts = words.select("good", F.explode_outer("buckets").alias("bucket"))
    counts = counts.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good"))
    counts = docs.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket")).join(counts, "bucket", "left").na.fill(0, ["raw", "good"])
    counts = saved(counts, "llr-counts")
    total = counts.agg((F.sum("raw") + BUCKETS).alias("all_raw"), F.sum("good").alias("all_good")).first()
    p = (F.col("raw") + 1) / F.lit(total["all_raw"])
    prior = max(1.0, PRIOR * total["all_good"])
    q = (F.col("good") + prior * p) / F.lit(total["all_good"] + prior)
    return counts.select("bucket", F.round(F.log(q / p) * UNIT).cast("long").alias("weight"))


def gram_scores(docs: DataFrame, weights: DataFrame, extra: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, extra columns, n_grams, llr) of each row; llr is the mean weight of its n-grams, null without any."""
    rows = with_words(docs, id_col, text_col).select("row", "id", *[c.alias(k) for k, c in extra.items()], gram_buckets().alias("buckets"))
    keys = ["row", "id", *extra]
    grams = rows.select(*keys, F.explode_outer("buckets").alias("bucket"))
    scored = grams.join(F.broadcast(weights), "bucket", "left")  # BUCKETS rows
    out = scored.groupBy(*keys).agg(F.count("bucket").alias("n_grams"), (F.sum("weight") / F.count("weight") / UNIT).alias("llr"))
    return out.select("id", *extra, "n_grams", "llr")


def llr_threshold(docs: DataFrame, weights: DataFrame, trusted: DataFrame, spreads: float, id_col: str, text_col: str) -> float:
    """The lowest percent of the mean weights of held-back trusted rows, less `spreads` interquartile ranges.

    Whole UNITs, rounded down; rows at the threshold stay. With fewer than MIN_HELD rows of MIN_GRAMS n-grams there is no
    estimate of either, and no row fails.
    """
    held = broadcast_if_small(trusted.where("held").select("trusted_id"))
    own = docs.join(held, F.col(id_col) == F.col("trusted_id"), "left_semi")
    scores = saved(gram_scores(own, weights, {}, id_col, text_col).where(F.col("n_grams") >= MIN_GRAMS).select("llr"), "llr-held")
    n, at = percentiles(scores, [0.01, 0.25, 0.75])
    return float("-inf") if n < MIN_HELD else math.floor((at[0] - spreads * (at[2] - at[1])) * UNIT) / UNIT


def quality_rules(docs: DataFrame, labels: DataFrame, min_words: int = 10, max_repeat_percent: int = 20, spreads: float = 0.5, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """The rules' columns and verdict of each row of `docs`.

    Returns id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, threshold and kept, and
    with `digest` the SHA-256 of the text (null: the empty text), which tells rows of one id apart. A row
    fails the base rules with fewer than `min_words` words or more than `max_repeat_percent` % of its words in repeated
    windows. Else it is kept if the mean weight of its hashed n-grams reaches the threshold, which is `spreads`
    interquartile ranges below the lowest percent of trusted rows that were not counted. Counts cover all rows, and
    all rows labelled good are trusted. With fewer than MIN_HELD rows to set the threshold by, no
    row fails the second test.

    Null texts have no words and fail. Repeated rows and null ids give a row each; null labels are no trusted rows; other
    columns are not read; an empty table gives no rows.
    """
    trusted = saved(trusted_ids(labels), "llr-trusted")
    weights = llr_weights(docs, trusted, id_col, text_col)
    threshold = llr_threshold(docs, weights, trusted, spreads, id_col, text_col)
    extra = base_columns() | ({"digest": F.unhex(F.sha2("text", 256))} if digest else {})
    rows = gram_scores(docs, weights, extra, id_col, text_col)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("threshold", F.lit(threshold))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.coalesce("llr", F.lit(0.0)) >= F.lit(threshold))).withColumnRenamed("id", id_col)
