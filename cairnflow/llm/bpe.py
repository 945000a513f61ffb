"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash resolves pre-tokens that are vocabulary entries as a whole. Tier two: all other
pre-tokens are merged by rank with a heap over linked bytes. A bounded memo keeps what a worker has resolved.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.common import arrow_map

MIX, LOW = 0x9E3779B97F4A7C15, (1 << 64) - 1
#: Pre-tokens handled at a time, and pre-tokens that the memo holds before it starts afresh.
PIECES, MEMO = 200_000, 200_000


def _slots(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    x = (h ^ (d.astype(np.uint64) * np.uint64(MIX))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys fill n slots; a lookup reads one displacement and one slot."""

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // 3)
        h = self.hashes(keys)
        order: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, b in enumerate((h % np.uint64(self.buckets)).tolist()):
            order[b].append(i)
        # A displacement d >= 0 reseeds the bucket; d < 0 is the slot -d - 1 itself, for buckets of one key.
        self.displace = np.zeros(self.buckets, np.int64)
        self.slot_key: list[int] = [-1] * self.n
        for b in sorted(range(self.buckets), key=lambda b: -len(order[b])):
            own = order[b]
            if len(own) < 2:
                break
            hs = h[own]
            for start in range(0, 1 << 24, 64):
                d = np.arange(start, start + 64)
                got = _slots(np.tile(hs, 64), np.repeat(d, len(own)), self.n).reshape(64, -1).tolist()
                found = next((i for i, s in enumerate(got) if len(set(s)) == len(s) and all(self.slot_key[x] < 0 for x in s)), None)
                if found is not None:
                    self.displace[b] = start + found
                    for i, s in zip(own, got[found], strict=True):
                        self.slot_key[s] = i
                    break
            else:
                raise ValueError("two keys are the same")
        free = iter([s for s in range(self.n) if self.slot_key[s] < 0])
        for b in range(self.buckets):
            if len(order[b]) == 1:
                s = next(free)
                self.displace[b], self.slot_key[s] = -s - 1, order[b][0]

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))

    def candidates(self, keys: list[bytes]) -> list[int]:
        """For each key the number of the only key it can be; the caller compares them."""
        h = self.hashes(keys)
        d = self.displace[(h % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(d < 0, -d - 1, _slots(h, np.maximum(d, 0), self.n))
        return [self.slot_key[s] for s in slots.tolist()]


class Codec:
    """Encodes and decodes with `ranks` (token bytes to id), splitting text by `pattern`."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.keys, self.pattern, self.ranks = list(ranks), pattern, ranks
        self.ids = list(ranks.values())
        self.hash = PerfectHash(self.keys)
        self.bytes_of = [b""] * (max(self.ids) + 1)
        for k, i in ranks.items():
            self.bytes_of[i] = k

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "memo", "flat", "start")}

    def _ready(self) -> None:
        if not hasattr(self, "memo"):
            self.split = regex.compile(self.pattern)
            self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat, self.start = array("I"), array("q", [0])

    def merge(self, piece: bytes) -> list[int]:
        """Tier two: repeatedly joins the adjacent pair of lowest rank, the leftmost among equals."""
        ranks, n = self.ranks, len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            left = parts[i]
            j = after[i]
            if left is None or j >= n or len(left) + len(parts[j]) != size:
                continue  # one of the two has been merged with something else meanwhile
            parts[i] = left = left + parts[j]
            parts[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(left + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, len(left) + len(parts[k])))
            k = before[i]
            if k >= 0 and (r := ranks.get(parts[k] + left)) is not None:
                heapq.heappush(heap, (r, k, len(parts[k]) + len(left)))
        return [ranks[p] for p in parts if p is not None]

    def _learn(self, new: list[str]) -> None:
        raw = [p.encode() for p in new]
        keys, ids, flat, start, memo = self.keys, self.ids, self.flat, self.start, self.memo
        for piece, b, c in zip(new, raw, self.hash.candidates(raw), strict=True):
            if keys[c] == b:
                flat.append(ids[c])
            else:
                flat.extend(self.merge(b))
            memo[piece] = len(start) - 1
            start.append(len(flat))

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each piece."""
        if len(self.memo) > MEMO or len(self.flat) > 8 * MEMO:
            self._forget()
        if new := list(set(pieces) - self.memo.keys()):
            self._learn(new)
        at = np.fromiter(map(self.memo.__getitem__, pieces), np.int64, len(pieces))
        start = np.array(self.start, np.int64)
        first, sizes = start[at], start[at + 1] - start[at]
        ends = np.cumsum(sizes)
        flat = np.array(self.flat, np.uint32)
        return flat[np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        self._ready()
        waiting: list[int] = []
        pieces: list[str] = []
        for text in texts:
            if len(text) > 4 * PIECES:  # a very long text goes in parts; what is split is the whole text
                yield from self._encode_short(pieces, waiting)
                waiting, pieces = [], []
                matches = (m[0] for m in self.split.finditer(text))
                yield np.concatenate([np.empty(0, np.uint32), *(self.encode_pieces(part)[0] for part in iter(lambda m=matches: list(islice(m, PIECES)), []))])
                continue
            own = self.split.findall(text)
            pieces += own
            waiting.append(len(own))
            if len(pieces) > PIECES:
                yield from self._encode_short(pieces, waiting)
                waiting, pieces = [], []
        yield from self._encode_short(pieces, waiting)

    def _encode_short(self, pieces: list[str], counts: list[int]) -> Iterator[np.ndarray]:
        if counts:
            ids, sizes = self.encode_pieces(pieces)
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
            yield from np.split(ids, ends[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(id, n_tokens long, ids binary: little-endian unsigned 32-bit ids[, decoded binary]) of each row of `docs`.

    The vocabulary file is read on the driver and broadcast: its size is that of the file, not of the data. Null and
    empty texts have no tokens. Repeated rows and null ids give a row each. Only `id_col` and `text_col` are read, so
    other columns may have any name. A very long text is split as a whole and merged in parts of PIECES pre-tokens.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Codec(load_ranks(ranks_path), pattern))

    def make():
        codec = shared.value

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            ids = list(codec.encode([t or "" for t in batch.column(1).to_pylist()]))
            out = {"id": batch.column(0), "n_tokens": [len(x) for x in ids], "ids": [x.astype("<u4").tobytes() for x in ids]}
            return out | ({"decoded": [codec.decode(x) for x in ids]} if decode else {})

        return step

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return arrow_map(rows, make, f"id {kind}, n_tokens bigint, ids binary" + ", decoded binary" * decode).withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) of packed ids as bpe_encode gives them; null ids decode to nothing."""
    ranks = load_ranks(ranks_path)
    names = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        names[i] = token
    shared = encoded.sparkSession.sparkContext.broadcast(names)

    def make():
        names = shared.value
        return lambda batch: {"id": batch.column(0), "decoded": [b"".join(map(names.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in batch.column(1).to_pylist()]}

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return arrow_map(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, decoded binary").withColumnRenamed("id", id_col)
