"""Words whose hashes collide, or would under weaker hashes."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.test_search import brute
from tests.llm.test_tokens import ids

from sedimenta.llm import dac, neardup, token_count, words
from sedimenta.llm.queries import WORD_BPE


def mirrored(n, a, b):
    """Two words of the letters a and b by the parity of the bits of 0 to n - 1, each the other's mirror image."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


PAIRS = [mirrored(n, a, b) for n in (32, 64, 1024, 2048, 4096) for a, b in ("x1", "eQ", "xq", "éz")]


@pytest.mark.parametrize("pair", PAIRS, ids=lambda p: f"{len(p[0])}{p[0][:2]}")
def test_mirrored_words_differ(pair):
    column = pa.array([f"{w} and {w}" for w in pair] + [*pair])
    assert token_count.counter(WORD_BPE)(column).tolist() == [len(ids(t)) for t in column.to_pylist()]
    made = {}
    for row, found, edges in dac._encoder(WORD_BPE)(column):
        for i in range(len(edges) - 1):
            made[row + i] = made.get(row + i, []) + found[edges[i] : edges[i + 1]].tolist()
    assert [made[i] for i in range(4)] == [ids(t) for t in column.to_pylist()]


def test_colliding_hashes_are_told_apart_by_bytes(monkeypatch):
    """With hashes cut to three bits every piece meets others of its hash, in one batch and in later ones."""
    real = token_count.word_runs

    def weak(*a, **k):
        for row, hashes, *rest in real(*a, **k):
            yield row, hashes & np.uint64(7 << 61) | np.uint64(1), *rest

    monkeypatch.setattr(token_count, "word_runs", weak)
    texts = ["one two three, four. five six seven eight nine ten", "ten NINE eleven twelve <|endoftext|> TEN. a, b", "One, two. THREE", "", None]
    count = token_count.counter(WORD_BPE)
    for _ in range(2):
        assert count(pa.array(texts)).tolist() == [len(ids(t)) for t in texts]


def test_the_table_starts_anew(monkeypatch):
    monkeypatch.setattr(token_count, "TABLE_PIECES", 20)
    monkeypatch.setattr(token_count, "TABLE_BYTES", 100)
    count = token_count.counter(WORD_BPE)
    for k in range(30):
        texts = [f"word{k * j} other{j}, again{k}." for j in range(5)]
        assert count(pa.array(texts)).tolist() == [len(ids(t)) for t in texts]


def test_no_hash_is_zero(monkeypatch):
    monkeypatch.setattr(words, "mix", lambda h: h * np.uint64(0))
    _, found, _ = next(words.hashed_texts(pa.array(["a b c"])))
    assert found.tolist() == [1, 1, 1]


def test_long_words_in_sets(spark):
    """Texts that differ in mirrored words only aren't copies; the same long words in other documents and cases are."""
    rows = []
    for k, (a, b) in enumerate(PAIRS):
        rows += [(10 * k, f"{k} {a} p q r s"), (10 * k + 1, f"{k} {b} p q r s"), (10 * k + 2, f"{k}\t{a.replace('Q', 'q')} P Q R S")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert got[10][1] != got[11][1]


def test_token_files_of_long_words(spark):
    rows = [(k, f"{a} {b}") for k, (a, b) in enumerate(PAIRS)]
    got = {r.doc_id: r.ids_crc32 for r in dac.token_file_index(spark.createDataFrame(rows, "doc_id long, text string"), WORD_BPE).collect()}
    assert got == {k: zlib.crc32(np.array([*ids(t), 1], "<u4").tobytes()) for k, t in rows}
