import resource

import numpy as np
import pyarrow as pa
import pytest

from bioquery.llm import ngram_join, words

TEXTS = ["", "One two\tTHREE", "É é\n\n x", "", "a" * 40 + " b", "  ", "last"]


def hashed(texts):
    data, offsets = words.string_bytes(pa.array(texts, type=pa.string()))
    hashes, row = words.word_hashes(data, offsets)
    return list(zip(row.tolist(), hashes.tolist(), strict=True))


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_cut_words_are_put_together(monkeypatch, block):
    whole = hashed(TEXTS)
    assert [r for r, _ in whole] == [1, 1, 1, 2, 2, 2, 4, 4, 6]
    monkeypatch.setattr(words, "CHUNK_BYTES", block)
    assert hashed(TEXTS) == whole


def test_case_of_letters_outside_ascii_counts():
    (_, one), (_, two) = hashed(["É", "é"])
    assert one != two
    assert hashed(["Ab"]) == hashed(["aB"])


def test_shingles_don_t_depend_on_blocks(monkeypatch):
    hashes = np.arange(1, 50, dtype=np.uint64)
    whole = words.shingles(hashes, 5)
    assert len(whole) == 45 and len(words.shingles(hashes[:3], 5)) == 1 and len(words.shingles(hashes[:0], 5)) == 0
    monkeypatch.setattr(words, "CHUNK_BYTES", 4)
    assert (words.shingles(hashes, 5) == whole).all()


def test_scratch_does_not_grow_with_a_text():
    """200 MB of text in one row: the set of its n-grams takes its own size and little beside."""
    column = pa.array([" ".join(f"w{i % 5000}" for i in range(50_000))] * 1)
    text = column[0].as_py()
    column = pa.array([" ".join([text] * 700)])
    assert len(column[0].as_py()) > 200_000_000
    list(ngram_join._sets(pa.array([text]), 3))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    (_, grams), = ngram_join._sets(column, 3)
    assert len(grams) == 5000
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
    assert grown < 2000  # 35 million words at 8 bytes, a few times


def test_nulls_are_empty():
    assert [len(g) for _, g in ngram_join._sets(pa.array([None, "", "a"], type=pa.string()), 3)] == [0, 0, 1]
