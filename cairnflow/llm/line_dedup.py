"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables.

A line's key is the line without white space at its ends and with A-Z in lower case; keys of MIN_CHARS code points or
more count. An index holds, as Parquet tables: postings (key, document), counts (key, number of documents, smallest
document, version) and a cuckoo filter of the live keys for each shard of keys. Counts are only appended to; a key's newest
row holds. An insertion asks the filters first: keys that they don't let through are new for certain and appended as they
are, and only the others have their rows looked up. A deletion appends the counts that are left and takes keys without
documents out of the filters again. Shards are dealt anew when they have grown to twice their size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructType

from cairnflow.llm.common import HOT_KEYS, SPACES, arrow_map, broadcast_if_small, parts, saved

MIN_CHARS, KEY_BYTES = 10, 16
#: Keys of a shard when shards are dealt; a filter takes about three bytes for each.
SHARD_KEYS = 200_000


def line_key(line: str) -> bytes | None:
    """The digest of a line's key; None for lines that are too short to count."""
    key = line.strip(SPACES)
    return hashlib.sha256(key.encode().lower()).digest()[:KEY_BYTES] if len(key) >= MIN_CHARS else None


class CuckooFilter:
    """A set of 64-bit hashes with deletion: 16-bit fingerprints in buckets of four, each in one of two buckets."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int):
        self.buckets = 1 << max(1, int(np.ceil(np.log2(max(capacity, 1) / (0.85 * self.SLOTS)))))
        self.table = np.zeros((self.buckets, self.SLOTS), np.uint16)

    @staticmethod
    def fingerprints(h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(48)) % np.uint64(65_535) + np.uint64(1)).astype(np.uint16)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f = self.fingerprints(h)
        first = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        return f, first, self.other(first, f)

    def other(self, bucket, f):
        return bucket ^ ((np.asarray(f, np.int64) * 0x5BD1E995 >> 4) & (self.buckets - 1))

    def insert(self, h: np.ndarray) -> None:
        """Adds distinct hashes; doubles the filter's size if that fails, which needs `h` to be all of its keys."""
        f, first, second = self.places(h)
        left = np.arange(len(h))
        for where in (first, second):  # all that find room at once: as many as a bucket has free slots
            order = left[np.argsort(where[left], kind="stable")]
            b = where[order]
            rank = np.arange(len(b)) - np.searchsorted(b, b)
            used = (self.table[b] != 0).sum(1)
            fits = rank + used < self.SLOTS
            empty = np.argsort(self.table[b] != 0, axis=1, kind="stable")  # free slots first
            self.table[b[fits], empty[fits, rank[fits]]] = f[order[fits]]
            left = order[~fits]
        rng = np.random.Generator(np.random.PCG64(len(h)))
        for i in left.tolist():
            self._kick(int(f[i]), int(second[i]), rng)

    def _kick(self, f: int, b: int, rng: np.random.Generator) -> None:
        for _ in range(self.KICKS):
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = f
                return
            s = int(rng.integers(self.SLOTS))
            f, self.table[b, s] = int(self.table[b, s]), f
            b = int(self.other(b, f))
        raise OverflowError("the filter is full")

    def contains(self, h: np.ndarray) -> np.ndarray:
        f, first, second = self.places(h)
        return (self.table[first] == f[:, None]).any(1) | (self.table[second] == f[:, None]).any(1)

    def remove(self, h: np.ndarray) -> None:
        """Takes one copy of each hash out; only hashes that were inserted may be removed."""
        for f, a, b in zip(*(x.tolist() for x in self.places(h)), strict=True):
            for bucket in (a, b):
                at = np.flatnonzero(self.table[bucket] == f)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break
            else:
                raise KeyError("a hash was never inserted")

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        out.table = np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy()
        out.buckets = len(out.table)
        return out


def key_hashes(keys: pa.ChunkedArray) -> np.ndarray:
    """The first eight bytes of keys of KEY_BYTES."""
    words = [np.frombuffer(c.buffers()[2], np.uint64, KEY_BYTES // 8 * len(c), int(np.frombuffer(c.buffers()[1], np.int32, 1, 4 * c.offset)[0])) for c in keys.chunks if len(c)]
    return np.concatenate(words).reshape(-1, KEY_BYTES // 8)[:, 0] if words else np.empty(0, np.uint64)


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The distinct (key, doc) of the lines of `docs` that count. Rows that share an id are one document."""

    def step(batch: pa.RecordBatch) -> dict[str, list]:
        ids, keys = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = {line_key(x) for x in (text or "").split("\n")} - {None}
            keys += own
            ids += [doc] * len(own)
        return {"key": keys, "doc": ids}

    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, lambda: step, f"key binary, doc {rows.schema['doc'].dataType.simpleString()}").distinct()


def _shard(n: int):
    return F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")


FILTERS = "shard int, filter binary"


class LineIndex:
    """One version of an index: its tables, and its number of shards and live keys. Changes give a new version; this one stays."""

    def __init__(self, postings: DataFrame, counts: DataFrame, filters: DataFrame, shards: int, keys: int = 0, version: int = 0):
        self.postings, self.counts, self.filters, self.shards, self.keys, self.version = postings, counts, filters, shards, keys, version

    @classmethod
    def empty(cls, spark: SparkSession, doc_type: str = "bigint", shards: int = 1) -> LineIndex:
        frame = lambda schema: spark.createDataFrame([], schema)
        return cls(frame(f"key binary, doc {doc_type}"), frame(f"key binary, docs bigint, first {doc_type}, version int"), frame(FILTERS), shards)

    def live(self, counts: DataFrame | None = None) -> DataFrame:
        """(key, docs, first) of each key that a document has: its newest count."""
        newest = F.max_by(F.struct("docs", "first"), "version").alias("c")
        return (self.counts if counts is None else counts).groupBy("key").agg(newest).select("key", "c.docs", "c.first").where("docs > 0")

    def insert(self, new: DataFrame) -> LineIndex:
        """With the postings `new` (saved, distinct) added; what is there already changes nothing, so an insertion may be repeated."""
        version = self.version + 1
        maybe = saved(self._asked(new.select("key").distinct()), "line-maybe")
        known = broadcast_if_small(maybe)
        # Of keys that the filters let through, and of these alone: postings that are there already, and exact counts.
        there = self.postings.join(known, "key", "left_semi").select(F.col("key").alias("old_key"), F.col("doc").alias("old_doc"))
        new = saved(new.join(there, (F.col("key") == F.col("old_key")) & F.col("doc").eqNullSafe(F.col("old_doc")), "left_anti"), "line-new")
        old = self.live(self.counts.join(known, "key", "left_semi")).select("key", F.col("docs").alias("old"), F.col("first").alias("old_first"))
        batch = new.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.min("doc").alias("first")).join(old, "key", "left")
        changed = batch.select("key", (F.col("docs") + F.coalesce("old", F.lit(0))).alias("docs"), F.least("first", "old_first").alias("first"), F.lit(version).alias("version"), F.col("old").isNull().alias("fresh"))
        changed = saved(changed, "line-changed")
        counts = self.counts.unionByName(changed.drop("fresh"))
        fresh = changed.where("fresh").select("key")
        keys = self.keys + fresh.count()
        out = LineIndex(self.postings.unionByName(new), counts, self.filters, self.shards, keys, version)
        if keys > 2 * SHARD_KEYS * self.shards:
            return out.resharded(-(-keys // SHARD_KEYS))
        out.filters = self._refiltered(fresh, add=True)
        return out if out.filters is not None else self_sharded(out)

    def remove(self, docs: DataFrame) -> LineIndex:
        """Without the documents of `docs` (column doc, null is a document too): as if they had never been inserted.

        Documents that the index doesn't have change nothing, and without any the index stays as it is.
        """
        version = self.version + 1
        gone = broadcast_if_small(saved(docs.select(F.col("doc").alias("gone")).distinct(), "line-gone"))
        same = F.col("doc").eqNullSafe(F.col("gone"))
        touched = saved(self.postings.join(gone, same, "left_semi").select("key").distinct(), "line-touched")
        posts = self.postings.join(gone, same, "left_anti")  # not written anew
        some = broadcast_if_small(touched)
        left = posts.join(some, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.min("doc").alias("first"))
        changed = saved(touched.join(left, "key", "left").select("key", F.coalesce("docs", F.lit(0)).alias("docs"), "first", F.lit(version).alias("version")), "line-changed")
        dead = changed.where("docs = 0").select("key")
        out = LineIndex(posts, self.counts.unionByName(changed), self.filters, self.shards, self.keys - dead.count(), version)
        out.filters = self._refiltered(dead, add=False)
        return out

    def resharded(self, shards: int) -> LineIndex:
        """The same index with so many shards, whose filters are made from the live keys."""

        def build(key: tuple, table: pa.Table) -> pa.Table:
            h, size = np.unique(key_hashes(table.column("key"))), 2
            while True:
                made = CuckooFilter(size * max(len(h), 512))
                try:
                    made.insert(h)
                    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([made.to_bytes()], pa.binary())})
                except OverflowError:
                    size *= 2

        filters = saved(self.live().select("key").withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(build, FILTERS), "line-filters")
        return LineIndex(self.postings, self.counts, filters, shards, self.keys, self.version)

    def compacted(self) -> LineIndex:
        """The same index with its postings and newest counts written as one table each, for when many changes have gathered."""
        counts = saved(self.live().withColumn("version", F.lit(self.version)), "line-counts")
        return LineIndex(saved(self.postings, "line-postings"), counts, self.filters, self.shards, self.keys, self.version)

    def _asked(self, keys: DataFrame) -> DataFrame:
        """Those of `keys` that their shard's filter lets through. A shard is one group of 2 * SHARD_KEYS keys at most."""

        def ask(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            own = left.column("key")
            if not right.num_rows:
                return pa.table({"key": own.slice(0, 0)})
            return pa.table({"key": own.filter(pa.array(CuckooFilter.from_bytes(right.column("filter")[0].as_py()).contains(key_hashes(own))))})

        sharded = keys.withColumn("shard", _shard(self.shards))
        return sharded.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(ask, "key binary")

    def _refiltered(self, changed: DataFrame, add: bool) -> DataFrame | None:
        """The filters after keys have come or gone; None if one has no room, so that all are made again."""
        out = to_arrow_schema(StructType.fromDDL(FILTERS + ", full boolean"))

        def change(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            h = key_hashes(left.column("key"))
            blobs = right.column("filter").to_pylist()
            made, full = CuckooFilter.from_bytes(blobs[0]) if blobs else CuckooFilter(2 * max(len(h), 512)), False
            try:
                made.insert(h) if add else made.remove(h)
            except OverflowError:
                full = True
            return pa.Table.from_pylist([{"shard": key[0].as_py(), "filter": made.to_bytes(), "full": full}], schema=out)

        sharded = changed.withColumn("shard", _shard(self.shards))
        done = saved(sharded.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(change, FILTERS + ", full boolean"), "line-filters")
        return done.drop("full") if done.where("full").isEmpty() else None


def self_sharded(index: LineIndex) -> LineIndex:
    """`index` with filters made again, with room for its keys."""
    return index.resharded(max(index.shards, -(-index.keys // SHARD_KEYS)))


def dropped_keys(found: DataFrame, shared: DataFrame) -> DataFrame:
    """(doc, keys): for each document the keys of `shared` (key, docs, first) that it loses, since a smaller one holds them.

    A few keys may be in a third of all documents: those with 1 / HOT_KEYS of all postings or more, HOT_KEYS at most, are
    broadcast; the postings of all others are shuffled by key.
    """
    total = max(1, found.count())
    hot = F.broadcast(shared.where(F.col("docs") * HOT_KEYS >= total).select("key", "first"))
    cold = shared.where(F.col("docs") * HOT_KEYS < total).select("key", "first")
    lose = found.join(hot, "key").unionByName(found.join(hot, "key", "left_anti").join(cold, "key"))
    lose = lose.where(~F.col("doc").eqNullSafe(F.col("first")))
    return lose.groupBy("doc").agg(F.collect_list("key").alias("keys"))


def deduped_lines(docs: DataFrame, index: LineIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batches: int = 2, put_back: int = 0) -> tuple[DataFrame, LineIndex]:
    """The rows of `docs` with columns n_lines, n_dropped and text_col as it stays, and the index with `docs` inserted.

    A key in two documents or more loses all its lines except in the smallest id that holds it. Null and empty texts are
    one empty line. Rows that share an id are one document and all keep what it keeps; null ids are one document, the
    largest. Repeated lines of the keeping document stay. Other columns stay as they are; an empty table gives no rows.

    Documents are inserted in `batches` parts by the hash of their ids, each of which asks the filters that those before
    have left. With `put_back`, one document in so many is deleted again and put back, which changes no row.
    """
    spark = docs.sparkSession
    found = saved(postings(docs, id_col, text_col), "line-postings")
    part = F.xxhash64(F.lit(3), "doc")
    index = index or LineIndex.empty(spark, found.schema["doc"].dataType.simpleString())
    for k in range(batches):
        index = index.insert(found.where(F.pmod(part, F.lit(batches)) == k))
    if put_back:
        again = found.where(F.pmod(F.shiftright(part, 20), F.lit(put_back)) == 0)
        index = index.remove(again.select("doc").distinct()).insert(again)
    lose = dropped_keys(found, saved(index.live().where("docs > 1"), "line-shared"))
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[docs[c].alias(n) for c, n in names.items()])
    rows = rows.join(lose.withColumnRenamed("doc", "lose_doc"), F.col(names[id_col]).eqNullSafe(F.col("lose_doc")), "left").drop("lose_doc")
    at, keys_at = list(names).index(text_col), len(names)
    schema = StructType([*rows.schema.fields[:-1]]).add("n_lines", LongType()).add("n_dropped", LongType())

    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            n_lines, n_dropped, texts = [], [], []
            for text, keys in zip(batch.column(at).to_pylist(), batch.column(keys_at).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                gone = set(keys or ())
                kept = [x for x in lines if line_key(x) not in gone] if gone else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                texts.append("\n".join(kept))
            columns = [*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 : keys_at], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    done = rows.mapInArrow(run, schema)
    return done.select(*[F.col(n).alias(c) for c, n in names.items()], "n_lines", "n_dropped"), index
