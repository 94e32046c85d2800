import base64
import hashlib

import public_tokenizers
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF
from threadloom.llm import byte_bpe
from threadloom.llm.queries import BYTE_VOCAB, op1_byte_bpe

RANKS = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(BYTE_VOCAB, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = byte_bpe.codec(BYTE_VOCAB, public_tokenizers.PATTERN)


def ids(text):
    return pa.array([CODEC.encode(text)], pa.binary())[0].as_buffer().to_pybytes()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\x1c 'slted0éß中😀"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_codec_equals_the_library(text):
    import numpy as np

    found = np.frombuffer(CODEC.encode(text), np.int32)
    assert found.tolist() == LIBRARY.encode_ordinary(text)
    lists = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found))
    assert CODEC.decode(lists)[0].as_py() == text.encode()


def test_perfect_hash():
    values = {str(i).encode(): i for i in range(1000)}
    found = byte_bpe.PerfectHash(values)
    assert all(found.get(k) == v for k, v in values.items()) and sorted(found.values) == list(range(1000))
    assert found.get(b"x") is None and byte_bpe.PerfectHash({}).get(b"x") is None


def test_cache_overflow_changes_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 3)
    own = byte_bpe.Codec(BYTE_VOCAB, public_tokenizers.PATTERN)
    text = "one two three four five one two " * 5
    assert own.encode(text) == CODEC.encode(text) and len(own) <= 3


def test_query_equals_the_library(spark):
    wanted = {}
    for row in spark.read.parquet(f"{SF}/documents.parquet").collect():
        own = LIBRARY.encode_ordinary(row["text"] or "")
        wanted[row["doc_id"]] = (len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), hashlib.sha256((row["text"] or "").encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op1_byte_bpe(spark, SF).collect()} == wanted


def test_edge_cases(spark):
    rows = [(1, None, "x"), (None, "", "x"), (1, "ab", None), (1, "ab", None), (2, "w" * 50_000 + " the " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = byte_bpe.decode(byte_bpe.encode(docs, BYTE_VOCAB, public_tokenizers.PATTERN), BYTE_VOCAB, public_tokenizers.PATTERN).collect()
    assert sorted((bytes(r["decoded"]) for r in found), key=len) == [b"", b"", b"ab", b"ab", rows[4][1].encode()]
    assert byte_bpe.encode(docs.limit(0), BYTE_VOCAB, public_tokenizers.PATTERN).count() == 0
