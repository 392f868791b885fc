"""Token counts: Arrow batches in, lengths out, with the library of the vocabulary file.

Texts go to the library in sub-batches balanced by bytes. Where a tokenizer drops white space before it merges
(its pre-tokenizer keeps only matches that hold none), ASCII white space is a safe boundary, and so is the place before a full
stop or comma between a letter and white space: each distinct piece between
is encoded once, kept in a bounded table by a 64-bit hash with its bytes, which every hit is compared with, and a text's count is
the sum over its pieces. Long texts of other
tokenizers are cut before a space between two ASCII letters, which byte-level patterns never join across;
SentencePiece models, which add a prefix to every call, get whole texts.

Null texts count as empty: 0 bytes, 0 tokens. Null ids are kept. Repeated rows give repeated rows. Only the id and
text columns are read, so other columns never clash.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.words import mix, word_runs

BATCH_BYTES = 6 << 20
SLOT_BITS, TABLE_PIECES, TABLE_BYTES = 22, 2_000_000, 64 << 20
LIMIT = 2048

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@lru_cache(maxsize=4)
def library(path: str):
    """The tokenizer object of a .json file, or the SentencePiece processor of a .model file."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=4)
def _spec(path: str) -> tuple[dict, bool, np.ndarray | None]:
    """Of a .json file: what it says but for the vocabulary, whether it lower-cases, and which ids end a word (None if none are marked)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, ends = spec.pop("model"), None
    if suffix := model.get("end_of_word_suffix"):
        ends = np.zeros(library(path).get_vocab_size(), bool)
        ends[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
    return spec, "Lowercase" in json.dumps(spec.get("normalizer")), ends


def drops_spaces(path: str) -> bool:
    """Whether white space never reaches the merges and no added token holds any."""
    if path.endswith(".model"):
        return False
    spec = _spec(path)[0]
    first = spec.get("pre_tokenizer") or {}
    first = (first.get("pretokenizers") or [first])[0]
    pattern = (first.get("pattern") or {}).get("Regex", " ")
    kept = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and " " not in pattern and "\\s" not in pattern.replace("[^\\s", "")
    return bool(kept) and not any(c.isspace() or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", []) for c in t["content"])


#: A word of letters that lower-casing and composition treat one by one, and a mark that starts a match of its own.
_CORE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)").fullmatch


class PieceTable:
    """The ids that the library makes of pieces between white space, by a 64-bit hash of the piece, in numpy arrays.

    Open addressing over 2**SLOT_BITS slots; beyond TABLE_PIECES pieces or TABLE_BYTES of them it starts anew, so memory is
    bounded. A hit counts only if the piece has the bytes that are kept; other pieces of that hash get another. New pieces
    that are a word of letters, with a full stop or comma perhaps, go to the library many to a call, joined by spaces, and
    are told apart by the suffix that ends each word's last token; everything else goes piece by piece.
    """

    def __init__(self, path: str):
        self.tokenizer = library(path)
        _, self.folds, self.ends = _spec(path)
        self.keys, self.slots = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int32)
        self._clear()

    def _clear(self) -> None:
        self.keys[:] = 0
        self.size, self.used, self.held = 0, 0, 0
        self.first, self.sizes, self.pool = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)
        self.byte_first, self.byte_sizes, self.raw = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 20, np.uint8)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the pieces in the table, -1 for those not there."""
        at = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        held = self.keys[at]
        out = np.where(held == hashes, self.slots[at], -1)
        rest = np.flatnonzero((held != hashes) & (held != 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & (1 << SLOT_BITS) - 1
            held = self.keys[at[rest]]
            hit = held == hashes[rest]
            out[rest[hit]] = self.slots[at[rest[hit]]]
            rest = rest[~hit & (held != 0)]
        return out

    def _insert(self, hashes: np.ndarray, pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(hashes)
        raw, lengths = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces], np.int64)
        while self.size + n > len(self.first):
            self.first, self.sizes, self.byte_first, self.byte_sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.sizes, self.byte_first, self.byte_sizes))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.held + len(raw) > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros_like(self.raw)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.raw[self.held : self.held + len(raw)] = raw
        self.sizes[self.size : self.size + n] = sizes
        self.byte_sizes[self.size : self.size + n] = lengths
        self.first[self.size : self.size + n] = self.used + np.cumsum(sizes) - sizes
        self.byte_first[self.size : self.size + n] = self.held + np.cumsum(lengths) - lengths
        self.held += len(raw)
        places = np.arange(self.size, self.size + n, dtype=np.int32)
        self.size, self.used = self.size + n, self.used + len(ids)
        at, rest = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64), np.arange(n)
        while len(rest):
            free = rest[self.keys[at[rest]] == 0]
            self.keys[at[free]] = hashes[free]
            won = free[self.keys[at[free]] == hashes[free]]
            self.slots[at[won]] = places[won]
            rest = np.setdiff1d(rest, won, assume_unique=True)
            at[rest] = (at[rest] + 1) & (1 << SLOT_BITS) - 1

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(made)), np.uint32), np.array([len(x) for x in made], np.int32)

    def _add(self, hashes: np.ndarray, raw: list[bytes]) -> None:
        pieces = [r.decode() for r in raw]
        simple, other, words = [], [], []
        for i, piece in enumerate(pieces):
            if self.ends is not None and (m := _CORE(piece)):
                simple.append(i)
                words.append(1 + len(m[2]))
            else:
                other.append(i)
        for at in range(0, len(simple), 4000):
            some, n = simple[at : at + 4000], np.cumsum(words[at : at + 4000])
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([pieces[i] for i in some])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == n[-1] and ends[-1] == len(ids):
                self._insert(hashes[some], [raw[i] for i in some], ids, np.diff(ends[n - 1], prepend=0))
            else:
                other += some
        for at in range(0, len(other), 20_000):
            some = other[at : at + 20_000]
            self._insert(hashes[some], [raw[i] for i in some], *self._encode([pieces[i] for i in some]))

    def _same(self, places: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each piece has the bytes of its place."""
        same = self.byte_sizes[places] == sizes
        some = np.flatnonzero(same)
        n = sizes[some]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0)
        equal = data[at + np.repeat(starts[some] - ends + n, n)] == self.raw[at + np.repeat(self.byte_first[places[some]] - ends + n, n)]
        if not equal.all():
            same[some[np.searchsorted(ends, np.flatnonzero(~equal), "right")]] = False
        return same

    def places(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Places of the pieces that begin at starts in data, encoding those that are new."""
        if self.size + len(hashes) > TABLE_PIECES or self.held > TABLE_BYTES:
            self._clear()
        out, rest = np.empty(len(hashes), np.int64), np.arange(len(hashes))
        while len(rest):
            found = self._find(hashes)
            missing = np.flatnonzero(found < 0)
            if len(missing):
                new, first = np.unique(hashes[missing], return_index=True)
                which = rest[missing[first]]
                self._add(new, [data[a : a + n].tobytes() for a, n in zip(starts[which].tolist(), sizes[which].tolist(), strict=True)])
                found[missing] = self._find(hashes[missing])
            same = self._same(found, data, starts[rest], sizes[rest])
            out[rest[same]] = found[same]
            rest, hashes = rest[~same], mix(hashes[~same]) | np.uint64(1)
        return out

    def ids(self, places: np.ndarray) -> np.ndarray:
        """The ids of pieces one after another."""
        sizes = self.sizes[places].astype(np.int64)
        ends = np.cumsum(sizes)
        return self.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[places] - ends + sizes, sizes)]

    def counts(self, column: pa.Array) -> np.ndarray:
        """Ids in each text of a column."""
        out = np.zeros(len(column), np.int64)
        for row, hashes, edges, *pieces in word_runs(column, marks=True, folded=self.folds):
            places = self.places(hashes, *pieces)
            sums = np.concatenate([[0], np.cumsum(self.sizes[places], dtype=np.int64)])
            out[row : row + len(edges) - 1] += np.diff(sums[edges])
        return out

    def encoded(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of rows (a long text has several): first row, ids, and the offset of each row's ids and the end."""
        for row, hashes, edges, *pieces in word_runs(column, marks=True, folded=self.folds):
            places = self.places(hashes, *pieces)
            sums = np.concatenate([[0], np.cumsum(self.sizes[places], dtype=np.int64)])
            yield row, self.ids(places), sums[edges]


def by_bytes(texts: Iterable[bytes], size: int = BATCH_BYTES) -> Iterator[list[bytes]]:
    """Runs of texts of about size bytes."""
    run, held = [], 0
    for text in texts:
        run.append(text)
        held += len(text) + 64
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run


def safe_pieces(text: str, size: int = 1 << 16) -> list[str]:
    """text cut before spaces between two ASCII letters, in pieces of size characters or more."""
    out, at = [], 0
    while len(text) - at > size:
        end = text.find(" ", at + size)
        while end != -1 and not (text[end - 1].isascii() and text[end - 1].isalpha() and text[end + 1 : end + 2].isascii() and text[end + 1 : end + 2].isalpha()):
            end = text.find(" ", end + 1)
        if end == -1:
            break
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def counter(path: str) -> Callable[[pa.Array], np.ndarray]:
    """A function from a column of texts to token counts."""
    if drops_spaces(path):
        return PieceTable(path).counts
    model = library(path)

    def count(column: pa.Array) -> np.ndarray:
        out: list[int] = []
        for run in by_bytes(utf8(column)):
            if path.endswith(".model"):
                out += map(len, model.encode([t.decode() for t in run], num_threads=1))
            else:
                cut = [safe_pieces(t.decode()) for t in run]
                made = iter(model.encode_batch_fast([p for pieces in cut for p in pieces], add_special_tokens=False))
                out += [sum(len(next(made).ids) for _ in pieces) for pieces in cut]
        return np.array(out, np.int64)

    return count


def utf8(column: pa.Array) -> Iterator[bytes]:
    """Texts as bytes, null as empty."""
    return (b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist())


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every row of docs; no shuffle."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            tokens = pa.array(count(batch.column(1)), pa.int64())
            sizes = pc.fill_null(pc.cast(pc.binary_length(batch.column(1)), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, tokens, pc.greater(tokens, limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
