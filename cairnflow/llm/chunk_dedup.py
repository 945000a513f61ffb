"""Exact dedup by content-defined chunk recipes.

Texts are cut where a rolling hash of the content says so; chunks are reduced to identifiers that byte comparison has
verified; texts are equal if their ordered lists of identifiers are. Long texts move at most once, chunk by chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.common import arrow_map, broadcast_if_small, lookup, saved

#: The rolling hash sees WINDOW bytes; chunks have MIN to MAX bytes, MIN + MEAN on average. MEAN is a power of two.
WINDOW, MIN, MEAN, MAX = 16, 256, 1024, 16_384
KEY_BYTES = 16
_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, np.uint32)


def cuts(data: bytes) -> list[int]:
    """Where the chunks of `data` end. A cut depends on the WINDOW bytes before it and on the last cut alone."""
    n = len(data)
    if n <= MIN:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    span = 1
    while span < WINDOW:  # h[i] comes to cover 2 * span bytes up to i
        h[span:] += h[:-span].copy() << np.uint32(span)
        span *= 2
    found = np.flatnonzero((h >> np.uint32(7)) % np.uint32(MEAN) == 0) + 1
    out, last, k = [], 0, 0
    while n - last > MIN:
        k = int(np.searchsorted(found, last + MIN))
        last = min(int(found[k]) if k < len(found) else n, last + MAX, n)
        out.append(last)
    if last < n:
        out.append(n)
    return out


def chunks(data: bytes) -> Iterator[bytes]:
    last = 0
    for end in cuts(data):
        yield data[last:end]
        last = end


def chunk_key(chunk: bytes, size: int = KEY_BYTES) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def _mapper(each: Callable[[int, bytes], Iterator[tuple]], width: int) -> Callable:
    """A step for arrow_map over (row, text) that gives each(row, UTF-8 text)'s rows, of `width` values, as c0, c1, ..."""

    def step(batch: pa.RecordBatch) -> dict[str, list]:
        rows = [x for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in each(row, text.encode())]
        return {f"c{i}": [x[i] for x in rows] for i in range(width)}

    return lambda: step


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bytes: int = KEY_BYTES) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of each row of `docs`; of equal texts the row of largest id stays.

    Null texts count as empty, which is a text like any other. Null ids are the smallest. Of rows equal in text and id
    one stays. Other columns are not read; an empty table gives no rows. Equality is never taken from a digest alone:
    two chunks with one key get different identifiers unless their bytes are the same.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def recipes():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            data = [t.encode() for t in batch.column(2).to_pylist()]
            return {"row": batch.column(0), "id": batch.column(1), "text_sha256": [hashlib.sha256(x).hexdigest() for x in data], "recipe": [b"".join(chunk_key(c, key_bytes) for c in chunks(x)) for x in data]}

        return step

    listed = saved(arrow_map(rows, recipes, f"row bigint, id {kind}, text_sha256 string, recipe binary"), "chunk-recipes")
    store = chunk_store(rows.select("row", "text"), key_bytes)
    doubtful = saved(store.groupBy("key").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key"), "chunk-doubtful")
    lists = listed.withColumnRenamed("recipe", "list") if doubtful.isEmpty() else saved(_told_apart(rows, listed, store, doubtful, key_bytes), "chunk-lists")
    groups = lists.groupBy("list").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "row")).alias("keep"))
    groups = saved(groups.select("list", "group_size", F.col("keep.id").alias("keep_id"), F.col("keep.row").alias("keep_row")), "chunk-groups")
    out = lookup(lists, groups, "list", "group_size", max(1, lists.count()))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def chunk_store(rows: DataFrame, key_bytes: int) -> DataFrame:
    """The distinct (key, part) of the chunks: grouping by the bytes themselves is what verifies a key.

    Each task sends a chunk once, however often it has it (partial aggregation), so copies are not moved again.
    """
    parts = arrow_map(rows, _mapper(lambda _, data: ((chunk_key(c, key_bytes), c) for c in set(chunks(data))), 2), "c0 binary, c1 binary")
    return parts.toDF("key", "part").distinct()


def _told_apart(rows: DataFrame, listed: DataFrame, store: DataFrame, doubtful: DataFrame, key_bytes: int) -> DataFrame:
    """`listed` with lists in which the chunks of a doubtful key also have their number among that key's chunks."""
    keys = broadcast_if_small(doubtful)
    of_key = store.join(keys, "key", "left_semi").groupBy("key").agg(F.sort_array(F.collect_set("part")).alias("parts"))
    clashes = saved(of_key.select("key", F.posexplode("parts").alias("ordinal", "part")), "chunk-clashes")
    places = arrow_map(rows.select("row", "text"), _mapper(lambda row, data: ((row, i, chunk_key(c, key_bytes), c) for i, c in enumerate(chunks(data))), 4), "c0 bigint, c1 int, c2 binary, c3 binary").toDF("row", "at", "key", "part")
    found = places.join(keys, "key", "left_semi").join(clashes, ["key", "part"]).select("row", F.struct("at", "ordinal").alias("x"))
    marks = found.groupBy("row").agg(F.sort_array(F.collect_list("x")).alias("marks"))
    told = listed.join(marks, "row", "left")
    marks = F.coalesce("marks", F.array().cast("array<struct<at:int,ordinal:int>>"))
    return told.select("row", "id", "text_sha256", F.struct("recipe", marks.alias("marks")).alias("list"))
