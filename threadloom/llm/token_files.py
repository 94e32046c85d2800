"""Token-id files: tokenised documents in ascending order of their ids, range-coded in blocks.

Documents are dealt by range of their id and sorted; every task tokenises its texts and
writes them in chunks of whole documents (about ``CHUNK_IDS`` ids; a longer document is a
chunk by itself). A chunk is one row of a Parquet dataset: ``file`` (the task's place in
order), ``chunk``, ``start`` (ids before it in its file), the documents' ids and lengths, and
one binary ``payload``. Spark's committer writes the rows, so a lost executor leaves no half
files, and any store that Spark reaches will do.

A payload is: the magic ``TLI2``, the number of blocks (u32), then for each block its number
of ids (u32), the crc32 of these ids as little-endian u32 (u32) and the size of its code
(u32), then all codes. Numbers are little-endian. Each block is coded with a fresh model
(see ``id_coder``) and verified against its checksum when it is read.

Defined results: null and empty texts have just the end id; null ids come first; repeated ids
each have their place, in the order of the hashes of their texts; an empty table gives files
without rows; columns other than the two named are not read.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadloom.llm import id_coder

MAGIC = b"TLI2"
BLOCK_IDS = 4096
CHUNK_IDS = 1 << 20
#: Chunks that are coded at once; their blocks are the coder's lanes, of which many make a numpy step cheap.
CHUNKS_AT_ONCE = 8
CACHE_ENTRIES = 250_000
_ENDS = ".,!?;:|$%&*#"


class WordTokenizer(dict):
    """Encodes texts by the tokenizers library, word by word, with a bounded cache from a word to its ids' bytes.

    The tokenizer's own splitting never joins what ASCII white space separates, nor a letter
    or digit and the punctuation after it, so the words' ids put together are the text's. A
    word that holds a special token goes whole to the library, which gives it its one id.
    """

    def __init__(self, path: str):
        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.ids = self.library.get_vocab_size()
        self.model = self.library.model
        # The byte-level alphabet: printable bytes stand for themselves, the others for 256 and up in order.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(hidden)}}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        text = word.decode()
        core = text.rstrip(_ENDS)
        if any(s in text for s in self.special):
            found = array("i", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        elif core and len(core) < len(text) and core[-1].lower()[-1].isalnum():
            found = self[core.encode()] + self[text[len(core) :].encode()]
        elif text.isalpha() and max(text) < "\u0250" and "\u0130" not in text:
            # One run of Latin letters: normalised by lower case alone, and one piece for the library's model.
            piece = text.lower()
            piece = piece if piece.isascii() else "".join(map(self.alphabet.__getitem__, piece.encode()))
            found = array("i", [t.id for t in self.model.tokenize(piece)]).tobytes()
        else:
            found = array("i", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split()))


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pack(chunks: list[np.ndarray], ids: int) -> list[bytes]:
    """The payloads of chunks of ids."""
    blocks = [[c[i : i + BLOCK_IDS] for i in range(0, len(c), BLOCK_IDS)] for c in chunks]
    codes = iter(id_coder.encode([b for own in blocks for b in own], ids))
    payloads = []
    for own in blocks:
        coded = [next(codes) for _ in own]
        heads = [struct.pack("<III", len(b), zlib.crc32(b.astype("<u4").tobytes()), len(c)) for b, c in zip(own, coded, strict=True)]
        payloads.append(b"".join([MAGIC, struct.pack("<I", len(own)), *heads, *coded]))
    return payloads


def unpack(payloads: list[bytes], ids: int) -> list[np.ndarray]:
    """The ids of each chunk; a damaged payload is an error."""
    codes, lengths, sums, counts = [], [], [], []
    for payload in payloads:
        if payload[:4] != MAGIC:
            raise ValueError("not a chunk of token ids")
        (n,) = struct.unpack_from("<I", payload, 4)
        at = 8 + 12 * n
        for length, total, size in struct.iter_unpack("<III", payload[8:at]):
            codes.append(payload[at : at + size])
            lengths.append(length)
            sums.append(total)
            at += size
        counts.append(n)
    blocks = id_coder.decode(codes, lengths, ids)
    for block, total in zip(blocks, sums, strict=True):
        if zlib.crc32(block.astype("<u4").tobytes()) != total:
            raise ValueError("a block of token ids does not match its checksum")
    found = []
    for n in counts:
        own, blocks = blocks[:n], blocks[n:]
        found.append(np.concatenate(own) if own else np.zeros(0, np.int32))
    return found


def write(docs: DataFrame, path: str, vocab: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenise ``docs``, with ``end_id`` after each document, and write the files to ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, file = tokenizer(vocab), TaskContext.get().partitionId()
        end = array("i", [end_id]).tobytes()
        chunk, start = 0, 0
        held: list[tuple[list, list[int], np.ndarray]] = []
        names: list = []
        parts: list[bytes] = []

        def close() -> None:
            if names:
                held.append((names.copy(), [len(p) // 4 for p in parts], np.frombuffer(b"".join(parts), np.int32)))
                names.clear()
                parts.clear()

        def rows() -> pa.RecordBatch:
            nonlocal chunk, start
            sizes = [len(ids) for _, _, ids in held]
            starts = [start + sum(sizes[:i]) for i in range(len(sizes))]
            columns = [
                pa.array([file] * len(held), pa.int32()), pa.array(range(chunk, chunk + len(held)), pa.int32()), pa.array(starts, pa.int64()),
                pa.array([n for n, _, _ in held], pa.list_(kind)), pa.array([n for _, n, _ in held], pa.list_(pa.int64())), pa.array(sizes, pa.int64()),
                pa.array(pack([ids for _, _, ids in held], own.ids), pa.binary()),
            ]
            chunk, start = chunk + len(held), start + sum(sizes)
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["file", "chunk", "start", "doc_ids", "lengths", "n_ids", "payload"])

        kind, size = None, 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = own.encode(text.as_py() or "") + end
                if size and size + len(ids) // 4 > CHUNK_IDS:
                    close()
                    size = 0
                    if len(held) == CHUNKS_AT_ONCE:
                        yield rows()
                names.append(name)
                parts.append(ids)
                size += len(ids) // 4
        close()
        if held:
            yield rows()

    named = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    ordered = named.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, f"file int, chunk int, start long, doc_ids array<{kind}>, lengths array<long>, n_ids long, payload binary").write.parquet(path)


def read(spark: SparkSession, path: str, vocab: str) -> DataFrame:
    """The documents of the files, in no order: ``doc_id``, ``start`` (ids of all documents before it) and ``ids array<int>``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = tokenizer(vocab).ids
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNKS_AT_ONCE):
                part = batch.slice(at, CHUNKS_AT_ONCE)
                chunks = unpack(part.column(4).to_pylist(), limit)
                for k, ids in enumerate(chunks):
                    lengths = np.array(part.column(3)[k].as_py(), np.int64)
                    ends = np.cumsum(lengths)
                    names = part.column(2).slice(k, 1).flatten()
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids))
                    columns = [pa.array([part.column(0)[k].as_py()] * len(lengths), pa.int32()), pa.array(part.column(1)[k].as_py() + ends - lengths), names, lists]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "start", "doc_id", "ids"])

    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    # One row for each file, however many documents it holds.
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = files.groupBy("file").agg(F.sum("n_ids").alias("n")).select("file", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    # The offset is joined to the chunks, which are few and packed, and not to the documents.
    chunks = files.join(F.broadcast(before), "file").select("file", (F.col("start") + F.col("before")).alias("start"), "doc_ids", "lengths", "payload")
    return chunks.mapInArrow(run, f"file int, start long, doc_id {kind}, ids array<int>").select("doc_id", "start", "ids")


def checksums(found: DataFrame) -> DataFrame:
    """For documents with ``ids`` their number and the crc32 of the ids as little-endian u32, in place of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "start", "ids").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
