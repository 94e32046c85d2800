import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.conftest import SF
from threadloom.llm import id_coder, token_files
from threadloom.llm.queries import END_ID, WORD_VOCAB, op5_token_files

OWN = token_files.WordTokenizer(WORD_VOCAB)


FRESH = Tokenizer.from_file(WORD_VOCAB)


def library(text):
    return FRESH.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(st.one_of(st.sampled_from(" \n\x1c\x0b'.,;!)0aIİΣé\u0301"), st.characters(exclude_categories=["Cs"])), max_size=40), st.sampled_from(["<|endoftext|>", "<|startoftext|>", " "])), max_size=5).map("".join))
def test_tokenizer_equals_the_library(text):
    assert np.frombuffer(OWN.encode(text), np.int32).tolist() == library(text)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 49407), st.sampled_from([2, 7, 11, 49407])), max_size=200), max_size=12))
def test_coder_round_trip(blocks):
    blocks = [np.array(b, np.int32) for b in blocks]
    codes = id_coder.encode(blocks, 49408)
    found = id_coder.decode(codes, [len(b) for b in blocks], 49408)
    assert [f.tolist() for f in found] == [b.tolist() for b in blocks]


def test_coder_learns_and_carries():
    rng = np.random.default_rng(0)
    regular = np.tile(rng.integers(0, 49408, 20), 300).astype(np.int32)
    assert len(id_coder.encode([regular], 49408)[0]) < len(regular) // 4
    many = [rng.integers(49300, 49408, 1000).astype(np.int32) for _ in range(50)]
    assert all((a == b).all() for a, b in zip(id_coder.decode(id_coder.encode(many, 49408), [1000] * 50, 49408), many, strict=True))


def test_coded_ids_are_smaller_than_deflated_ones():
    ids = np.concatenate([np.array([*library(r["text"]), END_ID], "<u4") for r in pq.read_table(f"{SF}/documents.parquet", columns=["text"]).to_pylist()])
    blocks = [ids[i : i + token_files.BLOCK_IDS] for i in range(0, len(ids), token_files.BLOCK_IDS)]
    coded = sum(map(len, id_coder.encode(blocks, 49408)))
    assert coded < 0.85 * sum(len(zlib.compress(b.astype("<u2").tobytes(), 9)) for b in blocks)
    counts = np.bincount(ids)
    assert coded < 1.05 * -np.sum(counts[counts > 0] * np.log2(counts[counts > 0] / len(ids))) / 8  # near the order-0 entropy of all ids


def test_counts_and_buffers_at_their_limits():
    rng = np.random.default_rng(1)
    many = [np.full(6000, 7, np.int32), rng.integers(0, 49408, 6000).astype(np.int32), np.repeat(rng.permutation(49408)[:60], 100).astype(np.int32), np.arange(43408, 49408, dtype=np.int32)]
    assert all((a == b).all() for a, b in zip(id_coder.decode(id_coder.encode(many, 49408), [len(b) for b in many], 49408), many, strict=True))
    small = [np.array([0, 1, 0, 1, 1], np.int32)]
    assert id_coder.decode(id_coder.encode(small, 2), [5], 2)[0].tolist() == small[0].tolist()


def test_damage_is_found():
    (payload,) = token_files.pack([np.arange(5000, dtype=np.int32)], 49408)
    assert token_files.unpack([payload], 49408)[0].tolist() == list(range(5000))
    for at in (0, 12, len(payload) // 2):
        broken = bytearray(payload)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            token_files.unpack([bytes(broken)], 49408)


def wanted(rows):
    found, start = [], 0
    for i, text in rows:
        ids = np.array([*library(text), END_ID], "<u4")
        found.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return found


def test_query_equals_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert sorted(map(tuple, op5_token_files(spark, SF).collect())) == wanted(docs)


def test_edge_cases(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK_IDS", 50)
    monkeypatch.setattr(token_files, "BLOCK_IDS", 16)
    rows = [(None, "zero"), (1, None), (2, ""), (3, "word " * 30_000), *[(i, f"text {i} # end" * (i % 9)) for i in range(4, 200)], (200, "same"), (200, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "2 as ids").repartition(7)
    token_files.write(docs, str(tmp_path / "files"), WORD_VOCAB, END_ID)
    found = token_files.checksums(token_files.read(spark, str(tmp_path / "files"), WORD_VOCAB)).collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == wanted(rows)
    token_files.write(docs.limit(0), str(tmp_path / "none"), WORD_VOCAB, END_ID)
    assert token_files.read(spark, str(tmp_path / "none"), WORD_VOCAB).count() == 0


SPECIAL = ["a <|endoftext|> b", "a<|endoftext|>b.", "<|startoftext|><|endoftext|>!?", "<|EndOfText|>", "x\n<|endoftext|>\ty", "\u00e9<|endoftext|>\u0301's", "<|endoftext|", "1<|startoftext|>.;", "<|end oftext|>"]


def test_special_tokens_are_one_id_as_in_the_library(spark, tmp_path):
    ids = [library(text) for text in SPECIAL]
    assert ids[0] == [320, 49407, 321]
    assert [np.frombuffer(OWN.encode(text), np.int32).tolist() for text in SPECIAL] == ids
    token_files.write(spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string"), str(tmp_path / "files"), WORD_VOCAB, END_ID)
    found = {r["doc_id"]: list(r["ids"]) for r in token_files.read(spark, str(tmp_path / "files"), WORD_VOCAB).collect()}
    assert found == {i: [*own, END_ID] for i, own in enumerate(ids)}


def test_codes_are_words_and_many_lanes_are_coded_at_once():
    rng = np.random.default_rng(2)
    blocks = [np.minimum(rng.geometric(0.01 * (1 + i % 9), int(n)), 49407).astype(np.int32) for i, n in enumerate(rng.integers(1, 300, 400))]
    codes = id_coder.encode(blocks, 49408)
    assert all(len(c) % 4 == 0 for c in codes)
    assert all((a == b).all() for a, b in zip(id_coder.decode(codes, [len(b) for b in blocks], 49408), blocks, strict=True))
    assert token_files.CHUNKS_AT_ONCE * token_files.CHUNK_IDS // token_files.BLOCK_IDS >= 2048
    with pytest.raises(ValueError):
        id_coder.encode(blocks, 1 << 19)
