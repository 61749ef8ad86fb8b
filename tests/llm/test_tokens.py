"""Packing and the codec against the tokenizer library itself."""
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from touchline.llm import packing, wordtable
from touchline.llm.queries import tokenizer_file
from touchline.llm.tokens import Encoder

BYTE, WORD = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")
SIGNS = " \n\t'.,!?-_aAzZéÉßñ09½ªİ́  日<|>endoftext"


@pytest.fixture(scope="module")
def byte_encoder():
    return Encoder(BYTE)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=SIGNS, max_size=40), min_size=1, max_size=5))
def test_encoder_equals_library(byte_encoder, texts):
    want = [x.ids for x in byte_encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in byte_encoder.encode(texts)] == want


def test_encoder_scans_little_at_once(byte_encoder):
    """The arrays over a call's texts stay small, however much text the call has, and the ids are the library's."""
    texts = [" ".join(f"w{i * 977 % 4999} of line {j}" for j in range(1500)) for i in range(60)]
    want = [x.ids for x in byte_encoder.tokenizer.encode_batch(texts[:3], add_special_tokens=False)]
    byte_encoder.encode(texts[:1])
    tracemalloc.start()
    got = byte_encoder.encode(texts)
    peak = tracemalloc.get_traced_memory()[1] - sum(x.nbytes for x in got)
    tracemalloc.stop()
    assert sum(map(len, texts)) > 1_200_000 and peak < 40e6, peak
    assert [x.tolist() for x in got[:3]] == want


def library(path, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def test_differencing_is_near_equal():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 129, 500).tolist()
    groups = packing.differencing(sizes, 32)
    assert sorted(i for g in groups for i in g) == list(range(500))
    sums = [sum(sizes[i] for i in g) for g in groups]
    assert max(sums) - min(sums) <= 4
    assert packing.differencing([], 3) == [[], [], []]
    assert sorted(map(len, packing.differencing([5, 5], 4))) == [0, 0, 1, 1]


def test_window_count_rises_beyond_capacity():
    groups = packing.near_equal_windows([6, 6, 6], 10)
    assert len(groups) == 3 and all(len(g) == 1 for g in groups)


def check_pieces(rows, want):
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    for doc, ids in want:
        pieces = sorted((r["start"], r["length"], r["ids_crc32"]) for r in got[doc] if r["doc_tokens"] == len(ids))
        spans = sorted({(s, n) for s, n, _ in pieces})
        assert sum(n for _, n in spans) == len(ids) or len(pieces) > len(spans)
        for s, n, crc in pieces:
            assert zlib.crc32(np.array(ids[s : s + n], dtype="<u4").tobytes()) == crc
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
        total += at
    return padding, total


def test_packing_documents(docs, texts):
    rows = packing.digests(packing.pack(docs, BYTE)).collect()
    want = [(i, library(BYTE, t)[0] + [0]) for i, t in texts.items()]
    padding, total = check_pieces(rows, want)
    assert total == sum(len(x) for _, x in want)
    assert padding <= 0.03 * total


def test_packing_odd_rows(spark, odd):
    rows = packing.digests(packing.pack(odd.withColumn("sequence_id", odd["doc_id"]), BYTE)).collect()
    want = [(r["doc_id"], library(BYTE, r["text"])[0] + [0]) for r in odd.collect()]
    _, total = check_pieces(rows, want)
    assert total == sum(len(x) for _, x in want)
    assert packing.pack(odd.limit(0), BYTE).count() == 0


def same_codec(rows, want):
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, list(r["ids"]), r["decoded"]) for r in rows))
    assert got == sorted((i is None, i or 0, *library(WORD, t)) for i, t in want)


def test_codec_equals_library(docs, texts):
    same_codec(wordtable.encode_decode(docs, WORD).collect(), texts.items())


def test_codec_in_many_chunks_and_odd_rows(odd):
    extra = odd.withColumn("ids", odd["doc_id"]).withColumn("chunk", odd["doc_id"])
    same_codec(wordtable.encode_decode(extra, WORD, chunk_chars=10).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert wordtable.encode_decode(odd.limit(0), WORD).count() == 0


def test_decode_by_join(spark):
    rows = [(1, [320, 2, 320]), (2, []), (3, None), (4, [49407])]
    got = {r["k"]: r["decoded"] for r in wordtable.decode(spark.createDataFrame(rows, "k int, ids array<int>"), WORD).collect()}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    assert got == {k: t.decode(ids or [], skip_special_tokens=False) for k, ids in rows}
