"""Byte-level BPE by ranked merges over the distinct words of a batch; decoding concatenates the binary pieces of ids.

Every match of the vocabulary's pattern is a word. A word that has a rank is one id; otherwise its bytes are folded:
the adjacent pair of lowest rank (the leftmost of equals) is merged until no pair has one. Each distinct word of a
batch is folded once and kept in a bounded table.

encode() does this in Arrow batches. fold_words() is the same fold in Spark's higher-order functions over a table of
distinct words, with the rank map as one literal row; see the README for why it isn't the main path.

Null texts are encoded as empty: no ids, empty bytes. Ids outside the vocabulary can't be decoded and raise an error.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE_WORDS, LONG_PIECE = 200_000, 256


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    """The rank of each piece of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


def fold(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one word."""
    if (whole := ranks.get(word)) is not None:
        return (whole,)
    if len(word) > 48:
        return _fold_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    get = ranks.get
    found = [get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
    while found and (low := min(found)) < 1 << 60:
        i = found.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del found[i]
        if i < len(found):
            found[i] = get(parts[i] + parts[i + 1], 1 << 60)
        if i:
            found[i - 1] = get(parts[i - 1] + parts[i], 1 << 60)
    return tuple(ranks[p] for p in parts)


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same by a heap over a linked list of parts: n log n for long words."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def rank(i: int) -> int | None:
        return ranks.get(word[i : end[after[i]]]) if after[i] < n else None

    heap = [(r, i, end[after[i]]) for i in range(n - 1) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        end[i], after[i], alive[j] = end[j], after[j], False
        if after[i] < n:
            before[after[i]] = i
        for k in (i, before[i]):
            if k >= 0 and (r := rank(k)) is not None:
                heapq.heappush(heap, (r, k, end[after[k]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return tuple(out)


class Codec:
    """Encoder and decoder of one vocabulary, with a bounded table of the words met."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import regex

        self.ranks = ranks_of(path)
        self.words = regex.compile(pattern).findall
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: Iterable[str]) -> Iterator[list[int]]:
        for text in texts:
            words = self.words(text)
            if len(self.new) > TABLE_WORDS:
                self.old, self.new = self.new, {}
            new, long = self.new, []
            for word in set(words).difference(new):
                new[word] = self.old.get(word) or fold(word.encode(), self.ranks)
                if len(word) > LONG_PIECE:
                    long.append(word)
            yield list(chain.from_iterable(map(new.__getitem__, words)))
            for word in long:
                del new[word]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array<int>) of every row of docs; no shuffle."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            made = pa.array(codec.encode(x or "" for x in batch.column(1).to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=[id_col, "ids"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and the decoded bytes of every row; null ids decode to empty."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            raw = pa.array([codec.decode(x or ()) for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), raw], names=[id_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {id_type}, decoded binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256: encoded and decoded again where the text is, so ids never travel."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        names = [str(i) for i in range(len(codec.pieces))]
        for batch in batches:
            counts, shas, decoded = [], [], []
            for ids in codec.encode(x or "" for x in batch.column(1).to_pylist()):
                counts.append(len(ids))
                shas.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")


BUCKETS = 1 << 16


def fold_words(words: DataFrame, path: str, word_col: str = "word") -> DataFrame:
    """word and ids of distinct words (binary), by higher-order functions only.

    The rank map is one row of hashed buckets (its size is the vocabulary's), since element_at on a map literal
    searches it from the start.
    """
    spark = words.sparkSession
    table = spark.createDataFrame([(bytearray(p), r) for p, r in ranks_of(path).items()], "p binary, r int")
    hashed = lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int")
    buckets = table.groupBy(hashed(F.col("p")).alias("k")).agg(F.collect_list(F.struct("p", "r")).alias("v"))
    filled = buckets.join(spark.range(BUCKETS).select(F.col("id").cast("int").alias("k")), "k", "right").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("ranks"))
    row = words.join(F.broadcast(filled))
    rank = lambda x: F.get(F.filter(F.element_at(F.col("ranks"), hashed(x) + 1), lambda e: e["p"] == x), F.lit(0))["r"]
    n = F.octet_length(word_col)
    start = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.col(word_col), i, F.lit(1)))

    def step(parts, _):
        pairs = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(rank(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))).alias("r"), i.alias("i"))))
        best = F.array_min(F.filter(pairs, lambda p: p["r"].isNotNull()))["i"]
        return F.element_at(F.transform(F.array(best), lambda i: F.when(i.isNull(), parts).otherwise(F.concat(F.slice(parts, 1, i - 1), F.array(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))), F.slice(parts, i + 2, F.size(parts))))), 1)

    folded = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.aggregate(F.sequence(F.lit(1), n), start, step), rank))
    return row.select(word_col, folded.alias("ids"))
