import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from quorumlab.llm import bitpack, bytebpe, packing, token_counts, wordbpe
from tokenizers import Tokenizer

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXT = st.text(alphabet=st.one_of(st.sampled_from(" \n\tabeinrst'.,-0123ÉßΣİé日本\U0001f600"), st.characters(codec="utf-8")), max_size=60)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def reference():
    coder = bytebpe.load(RANKS, public_tokenizers.PATTERN)
    return tiktoken.Encoding("r", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_word_ids_equal_the_library(text):
    coder, library = wordbpe.load(WORDS), Tokenizer.from_file(WORDS) if not hasattr(wordbpe, "_t") else wordbpe._t
    wordbpe._t = library
    expected = ids_of(library, text)
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == expected
    assert coder.count(text) == len(expected)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_byte_ids_equal_the_library_and_decode(text):
    coder = bytebpe.load(RANKS, public_tokenizers.PATTERN)
    ids = coder.encode(text).tolist()
    assert ids == coder.library.encode_ordinary(text)
    assert coder.decode(ids) == text


def test_transducer_on_long_runs(reference):
    coder = bytebpe.load(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(1)
    for text in ("a" * 3000, "ab" * 2000, " " * 500, "=" * 999, "".join(rng.choice("aeinrst") for _ in range(3000))):
        assert coder.encode(text).tolist() == reference.encode_ordinary(text)


def test_forgetting_does_not_change_ids(monkeypatch, reference):
    monkeypatch.setattr(bytebpe, "MAX_STEPS", 50)
    monkeypatch.setattr(bytebpe, "MAX_PAIRS", 20)
    coder = bytebpe.ByteBpe(bytebpe.load(RANKS, public_tokenizers.PATTERN).ranks, public_tokenizers.PATTERN)
    text = "Thereupon the thnting erouned wheresoever; reandth bleingly."
    assert coder.encode(text).tolist() == reference.encode_ordinary(text)


def test_utf8_stream_at_every_cut():
    data = "aé日\U0001f600z".encode()
    for cut in range(len(data) + 1):
        stream = bytebpe.Utf8Stream()
        assert stream.feed(data[:cut]) + stream.feed(data[cut:]) + stream.end() == data.decode()


def test_single_tokens_are_single(library):
    for piece in wordbpe.load(WORDS).single_tokens()[::97]:
        assert len(ids_of(library, piece)) == 1


def test_counts_of_odd_documents(odd_docs, no_docs, library):
    found = token_counts.token_counts(odd_docs, WORDS, limit=10).collect()
    texts = [r["text"] for r in odd_docs.collect()]
    expected = sorted((len((t or "").encode()), len(ids_of(library, t)), len(ids_of(library, t)) > 10) for t in texts)
    assert sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found) == expected
    assert token_counts.token_counts(no_docs, WORDS).count() == 0


def test_byte_round_trip_of_odd_documents(odd_docs, no_docs, reference):
    found = bytebpe.round_trip(odd_docs, RANKS, public_tokenizers.PATTERN).collect()
    expected = []
    for row in odd_docs.collect():
        ids = reference.encode_ordinary(row["text"] or "")
        expected.append((str(row["doc_id"]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((row["text"] or "").encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == sorted(expected)
    assert bytebpe.round_trip(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=200), st.data())
def test_bit_packing_round_trip(width, values, data):
    ids = np.array([v & ((1 << width) - 1) for v in values], "<u4")
    words = bitpack.pack_bits(ids, width)
    first = data.draw(st.integers(0, len(ids)))
    last = data.draw(st.integers(first, len(ids)))
    assert bitpack.unpack_bits(words, width, first, last).tolist() == ids[first:last].tolist()


def test_block_random_access():
    docs = [np.arange(n, dtype="<u4") * 7 % 50000 for n in (3, 0, 1000, 1)]
    block = bitpack.Block(bitpack.make_block(docs, 16))
    assert len(block) == 4 and all((block.document(i) == d).all() for i, d in enumerate(docs))
    assert bitpack.bit_width(49408) == 16 and bitpack.bit_width(65537) == 17


def test_files_hold_documents_in_order(spark, odd_docs, no_docs, library, tmp_path):
    bitpack.write(odd_docs, str(tmp_path / "ids"), WORDS)
    found = bitpack.read(spark, str(tmp_path / "ids")).orderBy("start").collect()
    rows = sorted(odd_docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""))
    start = 0
    for row, own in zip(rows, found, strict=True):
        ids = np.array([*ids_of(library, row["text"]), 1], "<u4")
        assert (own["doc_id"], own["start"], own["n_tokens"], own["ids_crc32"]) == (row["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    some = bitpack.read(spark, str(tmp_path / "ids"), 3, 5, with_ids=True).collect()
    assert sorted(r["doc_id"] for r in some) == [3, 4, 5] and all(len(r["ids"]) == r["n_tokens"] for r in some)
    bitpack.write(no_docs, str(tmp_path / "none"), WORDS)
    assert bitpack.read(spark, str(tmp_path / "none")).count() == 0


def check_packing(rows, size):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence), by_doc


def test_packing_of_odd_documents(odd_docs, no_docs, library):
    rows = packing.pack(odd_docs, WORDS, size=64, with_ids=True).collect()
    check_packing(rows, 64)
    found = {}
    for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["piece"])):
        assert r["start"] == 64 * r["piece"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
    total = sum(len(ids_of(library, r["text"])) + 1 for r in odd_docs.collect())
    assert sum(r["length"] for r in rows) == total and not found
    assert packing.pack(no_docs, WORDS).count() == 0


def test_packing_is_tight(documents):
    rows = packing.pack(documents, WORDS).collect()
    used, _ = check_packing(rows, packing.SIZE)
    assert used <= 1.02 * -(-sum(r["length"] for r in rows) // packing.SIZE) + 1


@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 5))
def test_best_fit_takes_the_tightest_open_bin(lengths, open_bins):
    bins, free = packing.BestFit(50, open_bins), {}
    for length in lengths:
        fitting = [f for f in free.values() if f >= length]
        sequence, offset = bins.place(length)
        if fitting:
            assert free[sequence] == min(fitting) and offset == 50 - free[sequence]
            free[sequence] -= length
        else:
            assert sequence not in free and offset == 0
            if len(free) >= open_bins and length < 50:
                tightest = min(free.values())
                del free[next(s for s in reversed(list(free)) if free[s] == tightest and s not in [x for own in bins.at for x in own])]
            free[sequence] = 50 - length
        if not free.get(sequence, 1):
            del free[sequence]
        assert bins.open == len(free) <= open_bins


def test_tables_are_emptied_for_another_operator():
    from quorumlab.llm import memo

    table = memo.Memo(str.upper, 10, fixed=["x"])
    memo.working_for("one")
    assert table["a"] == "A" and "a" in table
    memo.working_for("one")
    assert "a" in table
    memo.working_for("two")
    assert dict(table) == {"x": 1} and table["a"] == "A"


def test_table_stays_within_its_limit():
    from quorumlab.llm import memo

    table = memo.Memo(str.upper, 10)
    for i in range(500):
        assert table[str(i)] == str(i) and len(table) <= 10 and len(table.late) <= 5
