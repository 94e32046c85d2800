"""Byte-level BPE encoding and decoding.

Pre-tokens found by the split pattern are resolved in two tiers, behind a bounded dictionary
of those met before, which answers most of them. A minimal perfect hash
(hash and displace: as many slots as tokens, one probe and one comparison) finds those that
are tokens themselves. Any other goes through merges: its bytes form a linked list and a
heap yields the adjacent pair of lowest rank, leftmost first, until none is left.

Both directions are one pass over the rows without any shuffle; what a Python worker keeps
(vocabulary, perfect hash, a cache of merged pre-tokens of bounded size) does not grow with
the data.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame

#: Pre-tokens whose ids a worker remembers; the cache is emptied when it is full.
CACHE_ENTRIES = 250_000
#: Characters of text that are split at once, which bounds a worker's memory; a longer text is split alone.
CHUNK_CHARS = 500_000
#: Keys of a bucket of the perfect hash, on average.
BUCKET = 2
#: Stands for a byte that has been merged into its left neighbour; no pair has a key this low.
GONE = -(1 << 40)


class PerfectHash:
    """Minimal perfect hash over distinct byte strings: ``get`` gives a key's value, or None for any other string."""

    def __init__(self, values: dict[bytes, int]):
        self.n = n = max(1, len(values))
        self.n_buckets = max(1, n // BUCKET)
        buckets: list[list[bytes]] = [[] for _ in range(self.n_buckets)]
        for key in values:
            buckets[xxhash.xxh64_intdigest(key) % self.n_buckets].append(key)
        self.seeds = [0] * self.n_buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        order = sorted(range(self.n_buckets), key=lambda b: -len(buckets[b]))
        free: list[int] | None = None
        for b in order:
            own = buckets[b]
            if not own:
                break
            if len(own) == 1:  # a lone key takes any free slot, which the seed names
                if free is None:
                    free = [i for i in range(n) if self.keys[i] is None]
                slots, seed = [free.pop()], 0
                seed = -1 - slots[0]
            else:
                seed = 1
                while True:
                    slots = [xxhash.xxh64_intdigest(k, seed) % n for k in own]
                    if len(set(slots)) == len(own) and all(self.keys[s] is None for s in slots):
                        break
                    seed += 1
            self.seeds[b] = seed
            for key, slot in zip(own, slots, strict=True):
                self.keys[slot], self.values[slot] = key, values[key]

    def get(self, key: bytes) -> int | None:
        seed = self.seeds[xxhash.xxh64_intdigest(key) % self.n_buckets]
        slot = -1 - seed if seed < 0 else xxhash.xxh64_intdigest(key, seed) % self.n
        return self.values[slot] if self.keys[slot] == key else None


class Codec(dict):
    """Encoder and decoder of one vocabulary, kept by each Python worker.

    As a dict it is the bounded cache from pre-tokens to their ids' bytes.
    """

    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.whole = PerfectHash(ranks)
        self.width = width = max(ranks.values(), default=0) + 1
        tokens: list[bytes | None] = [None] * width
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.binary())
        self.bytes = [ranks.get(bytes([x]), -1) for x in range(256)]
        #: Rank of what two tokens make, by left * width + right.
        self.pairs = {
            left * width + right: rank
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None
        }
        self.split = regex.compile(pattern).findall

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """The ids of a pre-token that is no token: heap over linked bytes."""
        pair, width = self.pairs.get, self.width
        n = len(piece)
        part = list(map(self.bytes.__getitem__, piece))
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [r * n + i for i in range(n - 1) if (r := pair(part[i] * width + part[i + 1])) is not None]
        heapify(heap)
        while heap:
            rank, i = divmod(heappop(heap), n)
            j = after[i]
            if j == n or (both := pair(part[i] * width + part[j])) != rank:
                continue  # one of the two has been merged meanwhile
            part[i], part[j] = both, GONE
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := pair(rank * width + part[k])) is not None:
                    heappush(heap, r * n + i)
            if i and (r := pair(part[h := before[i]] * width + rank)) is not None:
                heappush(heap, r * n + h)
        return tuple([x for x in part if x >= 0])

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        raw = piece.encode()
        own = self.whole.get(raw)
        self[piece] = ids = array("i", self.merged(raw) if own is None else (own,)).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        """The text's ids, four bytes each in this machine's order."""
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids."""
        return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, self.tokens.take(lists.values)), b"")


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i - start
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths) - start


def encode(df: DataFrame, vocab: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: ``id_col`` and its text's ids, ``ids array<int>``.

    Null and empty texts have no ids. Ids of rows may repeat or be null. Other columns of
    ``df`` are not read, so names cannot clash; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocab, pattern)
        for batch in batches:
            lengths = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            for start, n in _slices(lengths, CHUNK_CHARS):
                texts = batch.column(1).slice(start, n).to_pylist()
                ids = [own.encode(x or "") for x in texts]
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), column], names=[id_col, "ids"])

    narrow = df.select(df[id_col], df[text_col].cast("string").alias("__text"))
    kind = narrow.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, vocab: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row for each row: ``id_col``, ``ids array<int>`` and the bytes they stand for, ``decoded binary``.

    Null ids decode to no bytes; an id that the vocabulary
    lacks stands for nothing or, beyond its largest id, is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocab, pattern)
        for batch in batches:
            lists = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
            for start, n in _slices(lengths, CHUNK_CHARS):
                part = lists.slice(start, n)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths[start : start + n]))).astype(np.int32)), part.flatten())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), part, own.decode(ids)], names=[id_col, "ids", "decoded"])

    narrow = df.select(df[id_col], df[ids_col].cast("array<int>").alias("__ids"))
    kind = narrow.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")
