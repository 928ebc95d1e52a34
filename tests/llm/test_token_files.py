import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import TEXTS, awkward, empty, told
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from filigree.llm.packing import best_fit, fitted_sequences, pack_documents, patterns_of, plan, token_pieces
from filigree.llm.simple8b import BLOCK_IDS, documents_of, pack, segment, token_file_digest, unpack
from filigree.llm.tokens import encoder

BYTES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=300))
def test_words_give_back_any_values(values):
    words, _ = pack(np.array(values, np.uint64))
    assert unpack(words).tolist() == values


def test_blocks_start_where_they_say():
    values = np.random.default_rng(1).integers(0, 50_000, 3 * BLOCK_IDS + 17).astype(np.uint64)
    values[::1000] = 2**63 + 5
    words, blocks = pack(values)
    assert len(blocks) == 4
    assert unpack(words[int(blocks[2]) : int(blocks[3])]).tolist() == values[2 * BLOCK_IDS : 3 * BLOCK_IDS].tolist()


def test_segment_round_trip():
    ids = [np.arange(n, dtype="<u4") * 7 % 50_257 for n in (0, 1, 5000, 0, 20_000)]
    keys = [None, None, -3, 0, 7]
    back = list(documents_of(segment(keys, [x.tobytes() for x in ids])))
    assert [k for k, _ in back] == keys
    assert all(a.tolist() == b.tolist() for a, (_, b) in zip(ids, back))


@pytest.mark.parametrize("path", [BYTES, WORDS])
@pytest.mark.parametrize("text", ["a\nb c.\nDé\n1 x", "a\n\nb c", "a \nb", "a\t\nb\n", "\na b\n", "a.\n's b\r\nc\u2028\nd"])
def test_line_ends_between_words(path, text):
    whole = encoder(path).tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder(path).encode(text), "<u4").tolist() == whole


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,aAéÉsßİΣ1% ́<|>"), st.characters(codec="utf-8")), max_size=40))
def test_chunks_encode_like_whole_texts(path, text):
    whole = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids if len(text) < 3 else None
    whole = whole if whole is not None else encoder(path).tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder(path).encode(text), "<u4").tolist() == whole


def test_token_files_of_awkward_documents(spark):
    tokenizer, at, expected = Tokenizer.from_file(BYTES), 0, []
    unnamed = awkward(spark).where("doc_id IS NULL").orderBy(F.xxhash64(F.coalesce("text", F.lit(""))))
    named = sorted((x for x in TEXTS if x[0] is not None), key=lambda x: x[0])
    for doc_id, text in [(None, x["text"]) for x in unnamed.collect()] + named:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        expected.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert told(token_file_digest(awkward(spark), BYTES, 2), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expected, key=str)
    assert told(token_file_digest(empty(spark), BYTES, 2)) == []


def check_sequences(frame, capacity):
    frame = frame.sort_values(["sequence_id", "offset"])
    for _, x in frame.groupby("sequence_id"):
        assert x["offset"].tolist() == np.concatenate([[0], np.cumsum(x["length"])[:-1]]).tolist()
        assert x["length"].sum() <= capacity
    return frame["sequence_id"].nunique()


def test_packing_of_awkward_documents(spark):
    frame = pack_documents(awkward(spark), WORDS, 0, 64).toPandas()
    tokenizer = Tokenizer.from_file(WORDS)
    expected = []
    for doc_id, text in TEXTS:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        expected += [(doc_id, i // 64, i, len(ids[i : i + 64]), zlib.crc32(ids[i : i + 64].tobytes())) for i in range(0, len(ids), 64)]
    got = [
        (None if d != d else int(d), *rest)
        for d, *rest in frame[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(object).values.tolist()
    ]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert check_sequences(frame, 64) <= -(-frame["length"].sum() // 64) + 1
    assert pack_documents(empty(spark), WORDS, 0, 64).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 128), st.integers(1, 400), min_size=1, max_size=60))
def test_plans_hold_the_histogram(counts):
    histogram = np.zeros(129, np.int64)
    for length, n in counts.items():
        histogram[length] = n
    plain, fitted = best_fit(histogram, 128), plan(histogram, 128)
    for patterns in (plain, fitted):
        held = np.zeros(129, np.int64)
        for pattern, n in patterns.items():
            assert sum(pattern) <= 128
            np.add.at(held, list(pattern), n)
        assert held.tolist() == histogram.tolist()
    bound = -(-(histogram * np.arange(129)).sum() // 128)
    assert bound <= sum(fitted.values()) <= sum(plain.values())


def test_fitted_patterns_beat_best_fit():
    rng = np.random.default_rng(3)
    histogram = np.bincount(np.clip(rng.normal(700, 90, 30_000), 1, 2048).astype(int), minlength=2049)
    bound = -(-(histogram * np.arange(2049)).sum() // 2048)
    assert sum(plan(histogram, 2048).values()) < sum(best_fit(histogram, 2048).values())
    assert sum(plan(histogram, 2048).values()) < 1.05 * bound


def test_fitted_patterns_win_ties():
    # best-fit alone meets the bound too, with sequences of four and five pieces that no pattern has
    histogram = np.zeros(129, np.int64)
    for length, n in {64: 40, 60: 30, 40: 60, 32: 90, 28: 30, 16: 80, 8: 100}.items():
        histogram[length] = n
    bound = -(-(histogram * np.arange(129)).sum() // 128)
    assert sum(best_fit(histogram, 128).values()) == bound
    patterns = plan(histogram, 128)
    assert sum(patterns.values()) == bound
    made = {p for p in patterns if len(p) <= 3 and sum(p) == 128}
    assert sum(patterns[p] for p in made) > sum(n for p, n in best_fit(histogram, 128).items() if len(p) <= 3 and sum(p) == 128)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_fitted_patterns_make_most_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = token_pieces(docs, WORDS, 0, 2048).toPandas()
    histogram = np.bincount(pieces["length"], minlength=2049)
    made = sum(plan(histogram, 2048).values())
    fitted = sum(n for pattern, n in fitted_sequences(histogram, 2048) if len(pattern) > 1)
    assert made <= min(sum(best_fit(histogram, 2048).values()), 1.01 * (pieces["length"].sum() / 2048) + 1)
    assert fitted > 0.8 * (made - histogram[2048])
    assert plan(histogram, 2048) == plan(histogram, 2048)


def test_patterns_use_only_pieces_that_are_there():
    histogram = np.zeros(65, np.int64)
    histogram[[16, 20, 24, 32]] = [3, 1, 1, 2]
    full = {tuple(x) for x in patterns_of(histogram, 64, 3, 0, 0).tolist()}
    assert full == {(32, 32, 0, 0), (32, 16, 16, 0)}  # (24, 20, 20) needs two pieces of 20
    near = {tuple(x) for x in patterns_of(histogram, 64, 3, 8, 0).tolist()}
    assert near == full | {(32, 24, 0, 0)}
    histogram[16] = 4
    assert (16, 16, 16, 16) in {tuple(x) for x in patterns_of(histogram, 64, 4, 0, 0).tolist()}
