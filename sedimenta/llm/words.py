"""Vectorised word and shingle hashing over UTF-8 buffers (numpy), shared by near-duplicate search and retrieval.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, with A-Z folded to a-z. The 64-bit hash of a word of up to
LONG bytes is tabulated: the sum of a random number for each byte at its place, finished by a mixer, so two words that
differ collide with probability 2**-64 whatever their pattern. Longer words are hashed by blake2b. No hash is 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LONG = 64
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes with A-Z folded to a-z.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] = FOLDED[97:123]
_EXACT = np.random.default_rng(20240117).integers(0, 2**64, (LONG, 256), dtype=np.uint64)
_EXACT[:, SPACES] = 0
_VALUES, _EXACT = _EXACT[:, FOLDED].ravel(), _EXACT.ravel()
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
CHUNK = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finish for 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def letters_only() -> np.ndarray:
    """The bytes between words if words are runs of ASCII letters and digits and bytes of other scripts."""
    out = np.ones(256, bool)
    out[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
    return out


def _hash_piece(data: np.ndarray, cuts: np.ndarray, spaces: np.ndarray = SPACES, prefixes: tuple[int, ...] = (), values: np.ndarray = _VALUES, marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, start offsets and sizes in bytes of the words of data; no word crosses an offset in cuts.

    With prefixes, a column of hashes for the whole word and one for its first bytes, for each number of them. With
    marks, a full stop or comma between an ASCII letter and a space is a word of its own.
    """
    word = ~spaces[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = word[cuts]
    if marks:
        at = np.flatnonzero((data == 44) | (data == 46))
        at = at[at > 0]
        at = at[_LETTERS[data[at - 1]] & ~first[at]]
        after = np.minimum(at + 1, len(data) - 1)
        first[at[(at + 1 == len(data)) | ~word[after] | first[after]]] = True
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty((0, 1 + len(prefixes)) if prefixes else 0, np.uint64), starts, starts
    lead = starts[0]
    ends = np.append(starts[1:], len(data))
    sizes = np.diff(np.cumsum(word, dtype=np.int64)[ends - 1], prepend=0)
    place = np.minimum(np.arange(lead, len(data)) - np.repeat(starts, ends - starts), LONG - 1)
    part = values[(place << 8) + data[lead:]]
    if spaces is not SPACES:
        part[~word[lead:]] = 0
    whole = mix(np.add.reduceat(part, starts - lead))
    for i in np.flatnonzero(sizes > LONG).tolist():
        raw = data[starts[i] : starts[i] + sizes[i]]
        raw = FOLDED[raw] if values is _VALUES else raw
        whole[i] = int.from_bytes(hashlib.blake2b(raw.tobytes(), digest_size=8).digest(), "little")
    whole[whole == 0] = 1
    if not prefixes:
        return whole, starts, sizes
    heads = [mix(np.add.reduceat(np.where(place < size, part, np.uint64(0)), starts - lead) + np.uint64(size)) for size in prefixes]
    return np.column_stack([whole, *heads]), starts, sizes


def word_runs(column: pa.Array, spaces: np.ndarray = SPACES, prefixes: tuple[int, ...] = (), marks: bool = False, folded: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows of about CHUNK bytes: first row, word hashes, offset of each row's words and the end, the bytes
    as they were hashed, word starts and sizes.

    Null texts have no words. A text over CHUNK bytes is cut at white space into several runs of that one row, so memory
    follows CHUNK. Not folded: A-Z is left as it is, and so it is in runs that hold the start of a special token, <|.
    """
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    lengths = np.diff(offsets)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_valid()), lengths, 0)
    none = np.empty(0, np.int64)

    def hashed(text: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        exact = marks and (not folded or b"<|" in text.tobytes())
        found = _hash_piece(text, cuts, spaces, prefixes, _EXACT if exact else _VALUES, marks)
        return *found, (FOLDED[text] if marks and not exact else text)

    row, n = 0, len(column)
    while row < n:
        last, size = row, 0
        while last < n and (last == row or size + lengths[last] <= CHUNK):
            size += lengths[last]
            last += 1
        if last == row + 1 and size > CHUNK:
            text, at = data[offsets[row] : offsets[row] + size], 0
            while at < size:
                end = min(at + CHUNK, size)
                while end < size and not spaces[text[end]]:
                    step = np.flatnonzero(spaces[text[end : end + CHUNK]])
                    end = end + int(step[0]) if len(step) else min(end + CHUNK, size)
                words, starts, sizes, raw = hashed(text[at:end], none)
                yield row, words, np.array([0, len(words)]), raw, starts, sizes
                at = end
        else:
            if column.null_count:
                text = np.concatenate([data[offsets[i] : offsets[i] + lengths[i]] for i in range(row, last)] or [np.empty(0, np.uint8)])
                edges = np.concatenate([[0], np.cumsum(lengths[row:last])])
            else:
                text, edges = data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
            words, starts, sizes, raw = hashed(text, edges[1:-1]) if len(text) else (np.empty((0, 1 + len(prefixes)) if prefixes else 0, np.uint64), none, none, text)
            yield row, words, np.searchsorted(starts, edges), raw, starts, sizes
        row = last


def hashed_texts(column: pa.Array, spaces: np.ndarray = SPACES, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of whole rows: (first row, word hashes of the run, offset of each row's words and the end)."""
    held: list[np.ndarray] = []
    at = -1
    for row, words, edges, *_ in word_runs(column, spaces, prefixes):
        if held and row != at:
            yield at, (long := np.concatenate(held)), np.array([0, len(long)])
            held = []
        if len(edges) == 2:
            at = row
            held.append(words)
        else:
            yield row, words, edges
    if held:
        yield at, (long := np.concatenate(held)), np.array([0, len(long)])


def chained(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every width words that follow one another."""
    n = max(len(words) - width + 1, 0)
    h = np.full(n, 0x51ED270B * (width + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = (h ^ h >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93) + words[k : n + k]
        return mix(h)


def shingle_set(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; fewer words than size make one shingle."""
    return np.unique(chained(words, min(len(words), size))) if len(words) else words


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| for sorted distinct arrays; empty sets match nothing."""
    la, lb = len(a), len(b)
    if not la or not lb or 100 * min(la, lb) < percent * max(la, lb):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (la + lb - shared)
