"""N-grams, first-order transitions and divergence from a baseline, of hex-aware bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.coerce import hex_aware
from sedimenta.functions.fixed import baseline
from sedimenta.operators.rowwise import per_payload, round_all, zipped

_LOG_BASE = np.log2(np.array(baseline()))


def _name(gram: bytes) -> str:
    return gram.decode() if all(32 <= b <= 126 for b in gram) else gram.hex()


_named = lru_cache(maxsize=1 << 17)(_name)


def grams_of(raw: bytes, n: int = 2) -> list[tuple[str, float, int]]:
    """(n-gram, relative frequency, first place), in order of appearance."""
    total = len(raw) - n + 1
    if total < 1 or n < 1:
        return []
    if n <= 7:
        data = np.frombuffer(raw, np.uint8).astype(np.int64)
        key = np.zeros(total, np.int64)
        for k in range(n):
            key = key << 8 | data[k : k + total]
        keys, first, count = np.unique(key, return_index=True, return_counts=True)
        order = np.argsort(first, kind="stable")
        places = first[order]
        return list(zip([_named(raw[i : i + n]) for i in places.tolist()], round_all(count[order] / total, 5), places.tolist(), strict=True))
    seen: dict[bytes, list[int]] = {}
    for i in range(total):
        seen.setdefault(raw[i : i + n], [i, 0])[1] += 1
    return [(_name(g), round(c / total, 5), i) for g, (i, c) in seen.items()]


def transitions_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, rounded probability, share of the row) of each pair of neighbouring bytes that occurs."""
    if len(raw) < 2:
        none = np.empty(0)
        return none.astype(int), none.astype(int), none, none
    data = np.frombuffer(raw, np.uint8).astype(np.int64)
    pairs, count = np.unique(data[:-1] << 8 | data[1:], return_counts=True)
    a, b = pairs >> 8, pairs & 255
    rows = np.bincount(a, count, 256)
    return a, b, np.array(round_all(count / rows[a], 6)), rows[a] / (len(raw) - 1)


def transition_entropy_of(raw: bytes) -> float:
    _, _, p, share = transitions_of(raw)
    some = p > 0
    return round(float(0.0 - (share[some] * p[some] * np.log2(p[some])).sum()) + 0.0, 4)


def divergence_of(raw: bytes, log_base: np.ndarray = _LOG_BASE) -> float:
    """KL divergence from the baseline in bits, never below 0."""
    if not raw:
        return 0.0
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    some = np.flatnonzero(c)
    p = c[some] / len(raw)
    return round(max(0.0, float((p * (np.log2(p) - log_base[some])).sum())), 4)


def baseline_logs(custom: dict[int, float] | None) -> np.ndarray:
    """Logs of a baseline given by byte; bytes it lacks have 1e-6."""
    return _LOG_BASE if not custom else np.log2(np.array([custom.get(b, 1e-6) for b in range(256)]))


def _raw():
    return hex_aware(F.col("payload"))


def ngram_frequencies(df: DataFrame, n: int = 2) -> DataFrame:
    return zipped(df, _raw(), "gram string, freq double, first_pos long", lambda r: tuple(map(list, zip(*grams_of(r, n), strict=True))) or ([], [], []))


def top_of(raw: bytes, most: int = 8) -> list[tuple[str, float]]:
    return [(g, f) for g, f, _ in sorted(grams_of(raw, 2), key=lambda x: -x[1])[:most]]


def top_bigrams(df: DataFrame, most: int = 8) -> DataFrame:
    def made(r: bytes) -> tuple:
        top = top_of(r, most)
        return list(range(1, len(top) + 1)), [g for g, _ in top], [x for _, x in top]

    return zipped(df, _raw(), "rank int, gram string, freq double", made)


def transition_matrix(df: DataFrame) -> DataFrame:
    return zipped(df, _raw(), "b1 int, b2 int, p double", lambda r: tuple(x.tolist() for x in transitions_of(r)[:3]))


def transition_entropy(df: DataFrame) -> DataFrame:
    return per_payload(df, _raw(), "transition_entropy double", lambda r: (transition_entropy_of(r),))


def kl_divergence(df: DataFrame, custom: dict[int, float] | None = None) -> DataFrame:
    logs = baseline_logs(custom)
    return per_payload(df, _raw(), "kl_divergence double", lambda r: (divergence_of(r, logs),))
