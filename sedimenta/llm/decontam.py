"""Benchmark decontamination by rare words, longest common subsequences and answer words, with latent semantic cosines.

1. Words (runs of letters and digits, A-Z folded) are hashed to 32 bits once and kept in the shared folder; the first 15
   bits are a word's term. Documents are cut into passages of PASSAGE words. A first pass over all passages counts those
   that hold each term, for idf weights, and adds up A'(A R) for the term counts A and a fixed random R.
2. With idf weights D that product spans the leading right singular vectors of the tf-idf matrix A D (D A'A R is its
   product with the random matrix R/D). A second pass adds up the same product for an orthonormal basis Q of that span,
   of passages scaled by their length, and its Ritz values and vectors finish the randomised SVD. Each task adds up its own
   part and the parts are summed by blocks of terms.
3. Terms become their idf-weighted rows of the singular vectors over the singular values. A benchmark item meets windows of
   the size nearest its length, a few steps of STEP words apart; a window is a candidate if its vector has a cosine of
   COSINE or more with the item's. For the rest, such as items whose words the space doesn't know, there is an exact way:
   they are confirmed by STRONG alone.
4. A candidate is confirmed on the words around it: by a longest common subsequence of STRONG of the item's words, or of
   WEAK of them with half of the answer words (the ANSWERS rarest by idf).
5. Cosines are only taken of windows that hold, with the words around them, KEYS of the item's key words: its rarest, so many
   that a longest common subsequence of STRONG of the item's words can't do without KEYS of them; they include the answer
   words. Items of few distinct answer words need half of those. This loses nothing that step 4 confirms, and leaves few
   of all cosines to take.

Items under MIN_WORDS words, too short for steps 3 and 4, are held by the documents that have their words one after another
(cosine 1); these are found while documents are hashed, by 64-bit hashes.

The benchmark is prepared in blocks of ITEMS items (SHORT_ITEMS short ones) in the shared folder, and a task holds one at a
time for each batch that it reads, so one pass over the documents does for any number of items and documents are never
shuffled. What comes to the driver is of fixed size: term counts, a terms x SKETCH matrix and a block of items.

Null and empty texts and items without words match nothing; items with equal texts are each reported. Null item ids are
reported as null. A document with several items has a row for each. An empty benchmark or table gives no hits. Rows that
repeat are each reported.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.words import chained, hashed_texts, letters_only
from sedimenta.session import give_back, scratch

TERM_BITS, PASSAGE = 15, 32
TERMS = 1 << TERM_BITS
SKETCH = 40
BLOCKS = 1024
STRONG, WEAK = 0.7, 0.5
COSINE, TAKEN = 0.05, 1 << 16
ANSWERS, KEYS = 8, 4
MIN_WORDS, ITEMS, SHORT_ITEMS = 8, 5000, 200_000
STEP = 3
PIECE = 65_536
_SPACES = letters_only()


def hashed_words(docs: DataFrame, folder: str, id_col: str, text_col: str, short: tuple[str, ...] = ()) -> DataFrame:
    """Runs of documents in the shared folder: ids, offsets (int64) and word hashes (uint32) in bytes, and the hits of the
    blocks of short items (place in the run, item, first word, words)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits: dict[int, list] = {}
            for path in short:
                for row, words, edges in hashed_texts(batch.column(1), _SPACES):
                    hits.setdefault(row, []).extend(short_matches(words, edges, loaded(path)))
            for row, words, edges in hashed_texts(batch.column(1), _SPACES):
                ids = pa.ListArray.from_arrays(pa.array([0, len(edges) - 1], pa.int32()), batch.column(0).slice(row, len(edges) - 1))
                columns = list(zip(*hits.get(row, ()), strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([ids, pa.array([edges.astype("<i8").tobytes()], pa.binary()), pa.array([(words >> np.uint64(32)).astype("<u4").tobytes()], pa.binary()), *(pa.array([c], pa.list_(pa.int64())) for c in columns)], names=["ids", "edges", "words", "at", "item", "first", "size"])

    docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"ids array<{id_type}>, edges binary, words binary, at array<long>, item array<long>, first array<long>, size array<long>").write.parquet(f"{folder}/words")
    return docs.sparkSession.read.parquet(f"{folder}/words")


@dataclass
class ShortItems:
    """A block of short items: sorted hashes of their words by number of words, with the item of each."""

    ids: list
    hashes: dict[int, np.ndarray]
    items: dict[int, np.ndarray]


def short_items(ids: list, words: list[np.ndarray]) -> ShortItems:
    hashes, items = {}, {}
    for n in {len(w) for w in words}:
        some = np.array([k for k, w in enumerate(words) if len(w) == n])
        h = chained(np.concatenate([words[k] for k in some]), n)[::n]
        order = np.argsort(h, kind="stable")
        hashes[n], items[n] = h[order], some[order]
    return ShortItems(ids, hashes, items)


def short_matches(words: np.ndarray, edges: np.ndarray, block: ShortItems) -> list[tuple[int, int | None, int, int]]:
    """(text, item id, first word, words) of the short items that each text holds, the first place of each."""
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for n, known in block.hashes.items():
        h = chained(words, n)
        lo, hi = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
        at = np.flatnonzero(hi > lo)
        text = np.searchsorted(edges, at, "right") - 1
        for i, t in zip(at.tolist(), text.tolist(), strict=True):
            if i + n <= edges[t + 1]:
                for k in block.items[n][lo[i] : hi[i]].tolist():
                    found.setdefault((t, k), (i - int(edges[t]), n))
    return [(t, block.ids[k], first, n) for (t, k), (first, n) in sorted(found.items())]


def _keep(path: str, value: object) -> str:
    fs, at = pa.fs.FileSystem.from_uri(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at) as f:
        f.write(pickle.dumps(value))
    return path


@lru_cache(maxsize=1)
def loaded(path: str) -> object:
    """A prepared block from the shared folder; one at a time is held."""
    fs, at = pa.fs.FileSystem.from_uri(path)
    with fs.open_input_file(at) as f:
        return pickle.loads(f.read())


def _terms(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint32(32 - TERM_BITS)).astype(np.int64)


def _places(edges: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each word, and the first of each text and the end, if every text begins at a multiple of size."""
    lengths = np.diff(edges)
    first = np.concatenate([[0], np.cumsum(-(-lengths // size))]) * size
    return np.arange(edges[-1]) + np.repeat(first[:-1] - edges[:-1], lengths), first


def _summed(hashed: DataFrame, make, width: int) -> np.ndarray:
    """Sums of TERMS x width matrices that make(terms, edges) gives for each run of texts: by task, then by block of terms."""
    rows = TERMS // BLOCKS

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TERMS, width))
        for batch in batches:
            for edges, words in zip(batch.column(0), batch.column(1), strict=True):
                edges, words = np.frombuffer(edges.as_buffer(), "<i8"), np.frombuffer(words.as_buffer(), "<u4")
                if len(words):
                    make(_terms(words), edges, total)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array([total[b * rows : (b + 1) * rows].astype("<f4").tobytes() for b in range(BLOCKS)], pa.binary())], names=["block", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(data, "<f4").astype(np.float64)
                if block in sums:
                    sums[block] += part
                else:
                    sums[block] = part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "data"])

    out = np.zeros((TERMS, width))
    for row in hashed.select("edges", "words").mapInArrow(parts, "block int, data binary").repartition("block").mapInArrow(add, "block int, data binary").collect():
        out[row.block * rows : (row.block + 1) * rows] = np.frombuffer(row.data, "<f8").reshape(rows, width)
    return out


def _gram(terms: np.ndarray, places: np.ndarray, end: int, x: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct terms, their rows of A'(W A x)) for the passages of a run, W the inverse of each passage's weight."""
    padded = np.full(end, TERMS)
    padded[places] = terms
    held = np.einsum("ijk->ik", x.take(padded, axis=0).reshape(-1, PASSAGE, x.shape[1]))
    held /= np.maximum(weights.take(padded).reshape(-1, PASSAGE).sum(1), 1e-9)[:, None]
    order = np.argsort(terms.astype(np.uint16), kind="stable")
    some = terms[order]
    firsts = np.flatnonzero(np.diff(some, prepend=-1))
    moved = np.ascontiguousarray(held.T).take((places // PASSAGE)[order], axis=1)
    return some[firsts], np.add.reduceat(moved, firsts, axis=1).T


def _random(seed: int) -> np.ndarray:
    out = np.random.default_rng(seed).normal(size=(TERMS + 1, SKETCH)).astype(np.float32)
    out[-1] = 0
    return out


@dataclass
class Space:
    """idf by term, and the projection of a term, idf-weighted and whitened; the last row is for no word."""

    idf: np.ndarray
    projection: np.ndarray


def fit(hashed: DataFrame, seed: int = 3) -> Space:
    """Term weights and the randomised SVD over all passages: two passes over the hashed words."""
    spark = hashed.sparkSession

    def first(terms: np.ndarray, edges: np.ndarray, total: np.ndarray) -> None:
        random = _random_of(seed)
        places, ends = _places(edges, PASSAGE)
        keys = np.sort(((places // PASSAGE) * TERMS + terms).astype(np.int64 if ends[-1] > 1 << 20 else np.int32))
        held = keys[np.diff(keys, prepend=-1) != 0]
        total[:, 0] += np.bincount(held % TERMS, minlength=TERMS)
        total[0, 1] += ends[-1] // PASSAGE
        some, rows = _gram(terms, places, ends[-1], random, _ONES)
        total[some, 2:] += rows

    sums = _summed(hashed, first, 2 + SKETCH)
    idf = np.log((max(sums[0, 1], 1.0) + 1) / (sums[:, 0] + 1)).astype(np.float32)
    basis, _ = np.linalg.qr(sums[:, 2:] * idf[:, None])
    weighted = np.concatenate([basis * idf[:, None], np.zeros((1, SKETCH))]).astype(np.float32)
    squares = np.append(idf**2, 0).astype(np.float32)
    shared = spark.sparkContext.broadcast((weighted, squares))

    def second(terms: np.ndarray, edges: np.ndarray, total: np.ndarray) -> None:
        x, weights = shared.value
        places, ends = _places(edges, PASSAGE)
        some, rows = _gram(terms, places, ends[-1], x, weights)
        total[some] += rows

    product = _summed(hashed, second, SKETCH) * idf[:, None]
    core = basis.T @ product
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    values = np.maximum(values, 1e-9 * max(values[-1], 1e-12))
    projection = basis @ vectors / np.sqrt(values) * np.sqrt(values[-1]) * idf[:, None]
    return Space(idf, np.concatenate([projection, np.zeros((1, SKETCH))]).astype(np.float32))


@lru_cache(maxsize=1)
def _random_of(seed: int) -> np.ndarray:
    return _random(seed)


_ONES = np.append(np.ones(TERMS, np.float32), 0).astype(np.float32)


@dataclass
class Items:
    """A block of the benchmark: word hashes, LCS masks, answer words, key words and vectors."""

    ids: list
    words: list[np.ndarray]
    masks: list[dict[int, int]]
    answers: list[frozenset[int]]
    key_words: np.ndarray  # sorted, with the item of each
    key_items: np.ndarray
    key_terms: np.ndarray  # whether a term is that of a key word
    least: np.ndarray  # key words that a text has to hold, by item
    wide: np.ndarray  # steps of a window, by item
    reach: np.ndarray  # steps on each side of it in which words count too
    vectors: np.ndarray


def window_of(n: int) -> int:
    """The window size nearest n words by ratio: STEP times 5 times a power of 1.5, in whole steps."""
    return STEP * max(3, round(5 * 1.5 ** round(np.log(n / (5 * STEP)) / np.log(1.5))))


def prepare(ids: list, words: list[np.ndarray], space: Space) -> Items:
    """A block of items from their word hashes (uint32), each of MIN_WORDS or more."""
    masks, answers, keys, least, vectors = [], [], [], [], []
    for w in words:
        mask: dict[int, int] = {}
        for i, x in enumerate(w.tolist()):
            mask[x] = mask.get(x, 0) | 1 << i
        masks.append(mask)
        rare = w[np.argsort(-space.idf[_terms(w)], kind="stable")]
        answers.append(frozenset(rare[:ANSWERS].tolist()))
        # a subsequence of STRONG of the words misses at most spare of them, so it holds KEYS of the spare + KEYS rarest
        spare = len(w) - int(np.ceil(STRONG * len(w)))
        keys.append(frozenset(rare[: max(ANSWERS, spare + KEYS)].tolist()))
        least.append(min(KEYS, -(-len(answers[-1]) // 2)))
        v = space.projection[_terms(w)].sum(0)
        vectors.append(v / max(np.linalg.norm(v), 1e-12))
    flat = sorted((x, k) for k, some in enumerate(keys) for x in some)
    key_words, key_terms = np.array([x for x, _ in flat], np.uint32), np.zeros(TERMS, bool)
    key_terms[_terms(key_words)] = True
    wide = np.array([window_of(len(w)) // STEP for w in words], np.int64)
    reach = np.array([-(-(len(w) // 2) // STEP) for w in words], np.int64)
    return Items(ids, words, masks, answers, key_words, np.array([k for _, k in flat], np.int64), key_terms, np.array(least, np.int64), wide, reach, np.array(vectors))


def common_subsequence(mask: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence of an item of n words (as masks) and words, by bit vectors."""
    full = (1 << n) - 1
    v = full
    for w in words:
        if (m := mask.get(w)) is not None:
            u = v & m
            v = (v + u | v - u) & full
    return n - v.bit_count()


def _cosines(words: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray, items: Items, space: Space) -> np.ndarray:
    """The cosine of each window words[begin:end] and its item; about TAKEN words at a time."""
    out, sizes = np.empty(len(begin)), end - begin
    cuts = np.append(np.flatnonzero(np.diff(np.cumsum(sizes) // TAKEN, prepend=-1)), len(begin))
    for at, to in zip(cuts[:-1], cuts[1:], strict=True):
        n = sizes[at:to]
        firsts = np.cumsum(n) - n
        v = np.add.reduceat(space.projection[_terms(words[np.arange(n.sum()) + np.repeat(begin[at:to] - firsts, n)])], firsts, axis=0)
        out[at:to] = np.einsum("ij,ij->i", v, items.vectors[item[at:to]]) / np.maximum(np.linalg.norm(v, axis=1), 1e-12)
    return out


def _candidates(words: np.ndarray, edges: np.ndarray, items: Items, space: Space) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, first step, cosine) of the windows that can be confirmed, sorted; under COSINE only STRONG confirms."""
    text, item, start = _confirmable(words, edges, items)
    begin = edges[text] + start * STEP
    cosine = _cosines(words, begin, np.minimum(edges[text + 1], begin + items.wide[item] * STEP), item, items, space)
    return text, item, start, cosine


def _confirmable(words: np.ndarray, edges: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, first step) of the windows that hold enough key words of an item, sorted; no window that can be confirmed is left out."""
    places, first = _places(edges, STEP)
    some = np.flatnonzero(items.key_terms[_terms(words)])
    lo, hi = np.searchsorted(items.key_words, words[some], "left"), np.searchsorted(items.key_words, words[some], "right")
    n = hi - lo
    item = items.key_items[np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)]
    some = np.repeat(some, n)
    order = np.argsort(item, kind="stable")
    item, some = item[order], some[order]
    text = np.searchsorted(edges, some, "right") - 1
    step = places[some] // STEP - first[text] // STEP
    # runs of as many key words as an item needs, short enough for one window and the words around it
    end = np.arange(len(item)) + items.least[item] - 1
    run = np.flatnonzero(end < len(item))
    end = end[run]
    fits = (item[end] == item[run]) & (text[end] == text[run])
    fits &= step[end] - step[run] < items.wide[item[run]] + 2 * items.reach[item[run]]
    run, end = run[fits], end[fits]
    item, text, low, high = item[run], text[run], step[end], step[run]
    wide, reach, stride = items.wide[item], items.reach[item], np.maximum(items.wide[item] // 6, 1)
    last = np.maximum(np.diff(first)[text] // STEP - wide, 0)
    # windows start at multiples of the stride and at the last place that holds one
    low, high = np.maximum(low - wide - reach + 1, 0), high + reach
    k = -(-low // stride)
    count = np.maximum(np.minimum(high, last) // stride - k + 1, 0)
    each = np.repeat(np.arange(len(item)), count)
    start = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + k[each]) * stride[each]
    ends = np.flatnonzero((last >= low) & (last <= high))
    found = np.unique(np.stack([np.concatenate([text[each], text[ends]]), np.concatenate([item[each], item[ends]]), np.concatenate([start, last[ends]])]), axis=1)
    return found[0], found[1], found[2]


def matches(words: np.ndarray, edges: np.ndarray, items: Items, space: Space) -> list[tuple[int, int, int, int, float]]:
    """(text, item, first word, common words, cosine) of the confirmed items of each text, the best window of each."""
    found: dict[tuple[int, int], tuple[int, float, int]] = {}
    for t, item, start, cosine in zip(*(x.tolist() for x in _candidates(words, edges, items, space)), strict=True):
        n, size = len(items.words[item]), int(items.wide[item]) * STEP
        begin = int(edges[t]) + start * STEP
        near = words[max(edges[t], begin - n // 2) : min(edges[t + 1], begin + size + n // 2)].tolist()
        common = common_subsequence(items.masks[item], n, near)
        if common >= STRONG * n or cosine >= COSINE and common >= WEAK * n and 2 * len(items.answers[item].intersection(near)) >= len(items.answers[item]):
            best = (common, cosine, begin - int(edges[t]))
            if best > found.get((t, item), (0,)):
                found[t, item] = best
    return [(t, item, start, common, cosine) for (t, item), (common, cosine, start) in sorted(found.items())]


def _all_matches(words: np.ndarray, edges: np.ndarray, items: Items, space: Space) -> Iterator[tuple[int, int, int, int, float]]:
    """matches() over a run of texts, in pieces of about PIECE words; longer texts in pieces that overlap."""
    t = 0
    while t < len(edges) - 1:
        end = t + 1
        while end < len(edges) - 1 and edges[end + 1] - edges[t] <= PIECE:
            end += 1
        size = int(edges[end] - edges[t])
        if end == t + 1 and size > 2 * PIECE:
            reach, best = 4 * STEP * int(items.wide.max()), {}
            for at in range(0, size, PIECE):
                part = words[edges[t] + at : min(edges[t] + at + PIECE + reach, edges[end])]
                for _, item, start, common, cosine in matches(part, np.array([0, len(part)]), items, space):
                    best[item] = max(best.get(item, (0,)), (common, cosine, at + start))
            yield from ((t, item, start, common, cosine) for item, (common, cosine, start) in sorted(best.items()))
        else:
            yield from ((t + i, *rest) for i, *rest in matches(words[edges[t] : edges[end]], edges[t : end + 1] - edges[t], items, space))
        t = end


def _blocks_of(benchmark: DataFrame, item_col: str, text_col: str, short: bool) -> Iterator[tuple[list, list[np.ndarray]]]:
    """ids and words of the short or the other items, in blocks of SHORT_ITEMS or ITEMS at most."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator()
    most, ids, words = SHORT_ITEMS if short else ITEMS, [], []
    for row in rows:
        for _, found, edges in hashed_texts(pa.array([row.t], pa.string()), _SPACES):
            if edges[-1] and (edges[-1] < MIN_WORDS) == short:
                ids.append(row.i)
                words.append(found)
        if len(ids) == most:
            yield ids, words
            ids, words = [], []
    if ids:
        yield ids, words


def _prepared(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, folder: str) -> tuple[DataFrame, Space | None, tuple[str, ...], tuple[str, ...]]:
    """Hashed documents, the space, and the files of the blocks of items and of short items."""
    short = tuple(_keep(f"{folder}/short/{k}", short_items(*some)) for k, some in enumerate(_blocks_of(benchmark, item_col, item_text, True)))
    hashed = hashed_words(docs, folder, id_col, text_col, short)
    space, blocks = None, []
    for k, (ids, words) in enumerate(_blocks_of(benchmark, item_col, item_text, False)):
        space = space or fit(hashed)
        blocks.append(_keep(f"{folder}/items/{k}", prepare(ids, [(w >> np.uint64(32)).astype(np.uint32) for w in words], space)))
    give_back()
    return hashed, space, tuple(blocks), short


HITS = "item_id long, first_word long, common_words long, item_words long, cosine double"


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", folder: str | None = None) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, first_word, common_words, item_words, cosine."""
    spark = docs.sparkSession
    hashed, space, blocks, _ = _prepared(docs, benchmark, id_col, text_col, item_col, item_text, folder or scratch(spark, "decontam"))
    shared = spark.sparkContext.broadcast(space)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    names = [id_col, *(x.split()[0] for x in HITS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, edges, words, at, item, first, size = batch.columns
            for k in range(len(batch)):
                if rows := list(zip(at[k].as_py(), item[k].as_py(), first[k].as_py(), size[k].as_py(), size[k].as_py(), [1.0] * len(at[k]), strict=True)):
                    yield hits(ids[k].values, rows)
            for path in blocks:
                items = loaded(path)
                for k in range(len(batch)):
                    found = _all_matches(np.frombuffer(words[k].as_buffer(), "<u4"), np.frombuffer(edges[k].as_buffer(), "<i8"), items, shared.value)
                    if rows := [(t, items.ids[i], start, common, len(items.words[i]), cosine) for t, i, start, common, cosine in found]:
                        yield hits(ids[k].values, rows)

    def hits(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        where, *rest = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(where)), *(pa.array(c, kind) for c, kind in zip(rest, kinds, strict=True))], names=names)

    return hashed.select("ids", "edges", "words", "at", "item", "first", "size").mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {HITS}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", folder: str | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item; one more pass, no shuffle of documents."""
    spark = docs.sparkSession
    _, space, blocks, short = _prepared(docs, benchmark, id_col, text_col, item_col, item_text, folder or scratch(spark, "decontam"))
    shared, at = spark.sparkContext.broadcast(space), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(len(batch), bool)
            runs = [(row, words if short else None, (words >> np.uint64(32)).astype(np.uint32), edges) for row, words, edges in hashed_texts(batch.column(at).cast(pa.string()), _SPACES)] if short or blocks else []
            for path in short:
                for row, words, _, edges in runs:
                    keep[[row + t for t, *_ in short_matches(words, edges, loaded(path))]] = False
            for path in blocks:
                for row, _, words, edges in runs:
                    keep[[row + t for t, *_ in _all_matches(words, edges, loaded(path), shared.value)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
