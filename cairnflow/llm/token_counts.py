"""Token counts through a digest cache: only texts whose count isn't stored are encoded, each once."""

from __future__ import annotations

import hashlib
import json
import os
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.llm.common import arrow_map, broadcast_if_small, lookup, saved, scratch_path

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens bigint"
#: Fixed value: the pre-token pattern of byte-level BPE, as the tokenizer library has it built in.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Blocks of characters that the library and `regex` class alike, whatever version of Unicode they know. A text
#: with any other character is encoded by the library as a whole.
ALIKE = "\\u0000-\\u024f\\u0300-\\u036f\\u0370-\\u03ff\\u0400-\\u04ff\\u1e00-\\u1eff\\u2000-\\u206f\\u20a0-\\u20bf\\u2190-\\u21ff\\u2500-\\u27bf\\u3000-\\u30ff\\u4e00-\\u9fa5\\uac00-\\ud7a3\\uff00-\\uffef\\U0001f300-\\U0001f64f"
#: Distinct pre-tokens whose counts a worker remembers before it starts afresh, and characters counted at a time.
MEMO, CHARS = 200_000, 2_000_000


class Counter:
    """Counts tokens with the library for a file's content: tokenizers for .json, sentencepiece for .model.

    Byte-level BPE without a normaliser never merges across pre-tokens, so there the library encodes each distinct
    pre-token once per worker and the counts are summed; other files have whole texts encoded.
    """

    def __init__(self, path: str, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.memo: dict[str, int] = {}
        self.special = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.count_whole = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.by_piece = False
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(content.decode())
        tokenizer.no_padding()
        tokenizer.no_truncation()
        self.count_whole = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        made = json.loads(content)
        split, added = made.get("pre_tokenizer") or {}, made.get("added_tokens") or []
        plain = not any(x.get(k) for x in added for k in ("lstrip", "rstrip", "single_word"))
        self.by_piece = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not made.get("normalizer") and plain
        self.split, self.other = regex.compile(BYTE_LEVEL), re.compile(f"[^{ALIKE}]")
        if added:
            self.special = re.compile("|".join(re.escape(x["content"]) for x in sorted(added, key=lambda x: -len(x["content"]))))

    def _learn(self, pieces: list[str]) -> None:
        if len(self.memo) > MEMO:
            self.memo = {}
        if new := list(set(pieces) - self.memo.keys()):
            for k in range(0, len(new), 4096):
                part = new[k : k + 4096]
                self.memo.update(zip(part, self.count_whole(part), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_piece:
            return [n for t in texts for n in self.count_whole([t])]
        out, waiting, chars = [], [], 0
        for text in texts:
            found = 0
            if not text.isascii() and self.other.search(text):
                found, pieces = self.count_whole([text])[0], []
            elif self.special and self.special.search(text):
                found = len(self.special.findall(text))
                pieces = [p for part in self.special.split(text) for p in self.split.findall(part)]
            else:
                pieces = self.split.findall(text)
            waiting.append((found, pieces))
            chars += len(text)
            if chars > CHARS:
                out += self._sum(waiting)
                waiting, chars = [], 0
        return out + self._sum(waiting)

    def _sum(self, waiting: list[tuple[int, list[str]]]) -> list[int]:
        self._learn([p for _, pieces in waiting for p in pieces])
        return [found + sum(map(self.memo.__getitem__, pieces)) for found, pieces in waiting]


_COUNTERS: dict[str, Counter] = {}  # a worker keeps its tokenizers between tasks


def counter(path: str, version: str, content: bytes) -> Counter:
    if version not in _COUNTERS:
        _COUNTERS[version] = Counter(path, content)
    return _COUNTERS[version]


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an empty table where nothing is stored yet."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(CACHE_SCHEMA).parquet(path) if there else spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of each row of `docs`; counts that are not in the cache are appended to it.

    Content is the UTF-8 text, null as empty, with no further normalisation: byte-level counts depend on every byte. Its
    SHA-256 and the tokenizer file's digest are the key. Of the rows of an uncached text only the one with the smallest
    id is encoded (rows that share that id as well are all encoded and stored once). `cache_path` None: a fresh cache in
    the scratch folder. Repeated rows and null ids give a row each; other columns are not read. The tokenizer's file is
    read by the driver alone: what tasks count with is what the key says.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        content = f.read()
    version = hashlib.sha256(content).hexdigest()  # another file, or another version of it, has counts of its own
    cache_path = cache_path or scratch_path(spark, "token-cache")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    keys = saved(rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "token-keys")
    stored = open_cache(spark, cache_path).where(F.col("tokenizer") == version).select("digest", F.lit(True).alias("known"))
    groups = keys.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first"))
    groups = saved(groups.join(stored.distinct(), "digest", "left"), "token-groups")
    total = max(1, keys.count())
    _append_misses(rows, keys, groups, total, tokenizer_path, content, version, cache_path)
    counts = open_cache(spark, cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    table = saved(groups.select("digest", "rows").join(counts, "digest"), "token-table")
    return lookup(keys, table, "digest", "rows", total).select(F.col("id").alias(id_col), "n_bytes", "n_tokens")


def _append_misses(rows: DataFrame, keys: DataFrame, groups: DataFrame, total: int, tokenizer_path: str, content: bytes, version: str, cache_path: str) -> None:
    """Encodes the texts that are not stored: a row is left out if its text is stored or another row of it is encoded.

    The rows left out are few as a rule; their (id, digest) are broadcast if counted few, so texts needn't be shuffled.
    """
    skip = lookup(keys.select("id", "digest"), groups.where("rows > 1 OR known"), "digest", "rows", total)
    skip = saved(skip.where("rows IS NOT NULL AND (coalesce(known, false) OR NOT id <=> first)").select(F.col("id").alias("skip_id"), F.col("digest").alias("skip_digest")).distinct(), "token-skip")
    todo = rows.join(broadcast_if_small(skip), rows["id"].eqNullSafe(skip["skip_id"]) & (rows["digest"] == skip["skip_digest"]), "left_anti")

    shared = rows.sparkSession.sparkContext.broadcast(content)  # some MB, as the file has

    def make():
        counts = counter(tokenizer_path, version, shared.value).counts

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            return {"digest": batch.column(0), "tokenizer": [version] * batch.num_rows, "n_tokens": counts(batch.column(1).to_pylist())}

        return step

    found = arrow_map(todo.select("digest", "text"), make, CACHE_SCHEMA)
    found.dropDuplicates(["digest"]).write.mode("append").parquet(cache_path)
