import zlib

import numpy as np
import pytest
from samples import words
from tokenizers import Tokenizer

from fundtrace.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_path())


TEXTS = [None, "", " \n ", "Éa, the. THE the! don't <|endoftext|> x<|startoftext|>", "Σας ΟΔΟΣ. ﬁx ǅ İ q́ ,,a''s 12th a1b2", "tab\tnbsp x\x1cy z",
         words(3, 3000), words(4, 1), words(4, 1), *[words(k, 40 + 90 * k) for k in range(25)]]


def test_pieces_equal_the_tokenizer(documents, tokenizer):
    got = {(r.doc_id, r.piece): r for r in packing.token_pieces(documents(TEXTS, "start piece"), packing.tokenizer_path(), 256).collect()}
    for d, t in enumerate(TEXTS):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 256):
            part, r = ids[k : k + 256], got.pop((d, k // 256))
            assert (r.start, r.length, r.ids_crc32) == (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert not got


def test_sequences_are_gapless_and_full(documents):
    df = packing.pack(packing.token_pieces(documents(TEXTS), packing.tokenizer_path(), 256), 256)
    rows = df.collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in rows)
    assert len(by) <= 1.1 * total / 256 + 1


def best_fit(lengths, size):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(size - n)
        else:
            gaps.remove(fit)
            gaps.append(fit - n)
    return len(gaps)


def made(spark, lengths):
    return spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")


@pytest.mark.parametrize("size,swept", [(50, 10**6), (256, 70)])
def test_as_many_sequences_as_best_fit_row_by_row(spark, monkeypatch, size, swept):
    """Through Spark, with one partition and with several, of which gaps look into lower ones."""
    monkeypatch.setattr(packing, "SWEPT_ROWS", swept)
    lengths = np.random.default_rng(size).integers(1, size + 1, 400).tolist()
    rows = packing.pack(made(spark, lengths), size).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert len(by) <= 1.01 * best_fit(lengths, size) + 1


def test_one_length_and_full_pieces(spark):
    """A run of equal lengths that holds everything, and pieces that leave no gap."""
    rows = packing.pack(made(spark, [7] * 300 + [64] * 5), 64).collect()
    assert len(rows) == 305 and len({r.sequence_id for r in rows}) == 5 + -(-300 // 9)


def test_sweep_gives_each_gap_the_largest_piece():
    role, of, offset = packing.sweep(np.array([3, 4, 5, 6, 9]), np.array([False, False, True, False, True]), 10)
    assert role.tolist() == [packing.PLACED, packing.PLACED, packing.SHRUNK, packing.PLACED, packing.SHRUNK]
    assert of.tolist() == [4, 2, -1, 4, -1] and offset.tolist() == [7, 5, 1, 1, 0]


def test_gaps_look_into_the_nearest_lower_partitions():
    meets = packing.across([(0, 0, 5, None, 2), (1, 1, 2, 7, 9), (2, 3, 0, 20, None)])
    # The gap of 7 surely holds three pieces of 2; the gaps of 20 hold two of 9, then two more of 2.
    assert meets == [(1, 0, 0, 5, 3, 3), (2, 0, 1, 2, 2, 2), (2, 1, 0, 2, 2, 10)]


def test_units_are_what_the_tokenizer_encodes(tokenizer):
    """Random strings of awkward characters: units one by one give the ids of the whole."""
    rng = np.random.default_rng(4)
    alphabet = list("aB zé.,;'<|>12_-—ßİŉſ×÷Σσ\u0301\u00a0\t\n=\u0338É")
    for _ in range(300):
        t = "".join(rng.choice(alphabet, rng.integers(1, 40)))
        raw = np.frombuffer(t.encode(), np.uint8)
        low, first, last, _, n = packing.units(raw, np.array([0]), np.array([len(raw)]))
        ids = [i for a, b in zip(first, last) for i in tokenizer.encode(low[a:b].tobytes().decode(), add_special_tokens=False).ids]
        assert n.tolist() == [len(first)] and ids == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_empty_table_and_repeated_rows(documents):
    path = packing.tokenizer_path()
    assert packing.pack(packing.token_pieces(documents([]), path)).count() == 0
    rows = packing.pack(packing.token_pieces(documents([(1, "a b", "en"), (1, "a b", "en")]), path)).collect()
    assert sorted(r.offset for r in rows) == [0, 3]
