import struct
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tests.llm.conftest import ROWS

from sedimenta.llm import byte_bpe, dac, token_count
from sedimenta.llm.queries import BYTE_BPE, WORD_BPE

LIBRARY = token_count.library(WORD_BPE)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


class Memory:
    def __init__(self, data):
        self.data, self.read = data, 0

    def read_at(self, n, at):
        self.read += n
        return self.data[at : at + n]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=1500))
def test_levels_give_back_every_id(some):
    shard = dac.Shard(Memory(dac.shard_bytes([1], [len(some)], np.array(some, np.uint32))))
    assert shard.all().tolist() == some
    for i in range(0, len(some), 97):
        assert shard.token(i) == some[i]


def test_random_access_reads_little():
    some = np.random.default_rng(0).integers(0, 50_000, 200_000).astype(np.uint32)
    memory = Memory(dac.shard_bytes([1], [len(some)], some))
    shard, memory.read = dac.Shard(memory), 0
    assert shard.token(123_456) == some[123_456]
    assert memory.read < 400
    with pytest.raises(IndexError):
        shard.token(len(some))


def test_token_files(odd, none):
    got = dac.token_file_index(odd, WORD_BPE).collect()
    start = 0
    for row, (doc_id, text, _) in zip(sorted(got, key=lambda r: r.start), sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        want = [*ids(text), 1]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, start, len(want), zlib.crc32(struct.pack(f"<{len(want)}I", *want)))
        start += len(want)
    assert dac.token_file_index(none, WORD_BPE).count() == 0


def test_small_shards(odd, tmp_path):
    folder = f"file://{tmp_path}/x"
    manifest = dac.write_shards(odd, WORD_BPE, folder, shard_tokens=5)
    assert manifest.count() > 3
    assert dac.read_documents(odd.sparkSession, folder).count() == len(ROWS)


def test_token_counts(odd, none):
    got = sorted(map(tuple, token_count.token_counts(odd, WORD_BPE).collect()), key=str)
    want = [(i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 2048) for i, t, _ in ROWS]
    assert got == sorted(want, key=str)
    assert token_count.token_counts(none, WORD_BPE).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_of_other_libraries(spark, name):
    import public_tokenizers as P

    texts = [t for _, t, _ in ROWS if t and len(t) < 1000] + ["word and word " * 30_000]
    lib = token_count.library(P.path(name))
    want = [len(lib.encode(t) if name.endswith("model") else lib.encode(t, add_special_tokens=False).ids) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_count.token_counts(df, P.path(name)).collect()}
    assert [got[i] for i in range(len(texts))] == want


@given(st.text(max_size=200))
def test_pieces_count_like_the_library(text):
    import pyarrow as pa

    text = text.encode("utf-8", "replace").decode()
    assert token_count.counter(WORD_BPE)(pa.array([text])).tolist() == [len(ids(text))]


def reference():
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.ranks_of(BYTE_BPE), special_tokens={})


@given(st.text(max_size=300))
def test_fold_like_tiktoken(text):
    text = text.encode("utf-8", "replace").decode()
    codec, enc = byte_bpe.Codec(BYTE_BPE), reference()
    found = next(codec.encode([text]))
    assert found == enc.encode_ordinary(text)
    assert codec.decode(found) == text.encode()


def test_byte_bpe_round_trip(odd, none):
    enc = reference()
    encoded = byte_bpe.encode(odd, BYTE_BPE)
    rows = encoded.collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in rows) == sorted((str(i), enc.encode_ordinary(t or "")) for i, t, _ in ROWS)
    back = byte_bpe.decode(encoded, BYTE_BPE).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in back) == sorted((str(i), (t or "").encode()) for i, t, _ in ROWS)
    assert byte_bpe.round_trip(odd, BYTE_BPE).count() == len(ROWS)
    assert byte_bpe.round_trip(none, BYTE_BPE).count() == 0


def test_fold_in_higher_order_functions(spark):
    words = [w.encode() for w in (" the", "thbleering", "é日", "x", "....", "aaaaaaaaaaaaaaaa", " 12345")]
    got = byte_bpe.fold_words(spark.createDataFrame([(bytearray(w),) for w in words], "word binary"), BYTE_BPE).collect()
    assert {bytes(r.word): tuple(r.ids) for r in got} == {w: byte_bpe.fold(w, byte_bpe.ranks_of(BYTE_BPE)) for w in words}
