"""Byte statistics of payloads: entropy, histogram, classes, windows, randomness. numpy over each payload's bytes."""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.coerce import plain
from sedimenta.operators.rowwise import per_payload, round_all, zipped


def counts_of(raw: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(raw, np.uint8), minlength=256)


def entropy_of(counts: np.ndarray) -> float:
    """Bits a byte."""
    n = counts.sum()
    if not n:
        return 0.0
    p = counts[counts > 0] / n
    return float(0.0 - (p * np.log2(p)).sum()) + 0.0


def classes_of(c: np.ndarray) -> tuple[float, ...]:
    """Percentages of printable, white space, control, high-bit and special bytes."""
    n = c.sum()
    if not n:
        return (0.0,) * 5
    printable = c[32:127].sum()
    spaces = c[9] + c[10] + c[13]
    plain_ones = c[48:58].sum() + c[65:91].sum() + c[97:123].sum() + c[32]
    return tuple(float(x * (100.0 / n)) for x in (printable, spaces + c[32], c[:32].sum() - spaces, c[128:].sum(), max(0, printable - plain_ones)))


def top_of(raw: bytes, most: int = 10) -> list[dict]:
    """The most frequent bytes, the first to appear before equals."""
    c = counts_of(raw)
    rank = sorted(np.flatnonzero(c).tolist(), key=lambda b: (-c[b], raw.index(b)))[:most]
    return [{"rank": i + 1, "b": b, "n": int(c[b])} for i, b in enumerate(rank)]


def _windows(raw: bytes, window: int, step: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Offsets, size and entropies of every full window."""
    n = len(raw)
    if 8 <= n < window:
        window, step = max(4, n // 3), max(1, n // 10)
    if n == 0 or n < window:
        return np.empty(0, np.int64), window, np.empty(0)
    data = np.frombuffer(raw, np.uint8)
    starts = np.arange(0, n - window + 1, step)
    entropies = np.zeros(len(starts))
    shares = np.arange(window + 1) / window
    terms = shares * np.log2(np.maximum(shares, 1e-300))
    for at in range(0, len(starts), 4096):
        part = np.sort(data[starts[at : at + 4096, None] + np.arange(window)], axis=1)
        new = np.ones(part.shape, bool)
        new[:, 1:] = part[:, 1:] != part[:, :-1]
        first = np.flatnonzero(new.ravel())
        size = np.diff(np.append(first, part.size))
        entropies[at : at + 4096] = 0.0 - np.bincount(first // window, terms[size], len(part))
    return starts, window, entropies


def window_arrays(raw: bytes, window: int = 32, step: int = 8) -> tuple[list[int], list[int], list[float], list[bool]]:
    """(offset, window size, entropy, spike) of every full window; payloads of 8 bytes or more that are shorter than a window
    get smaller ones."""
    starts, window, entropies = _windows(raw, window, step)
    return starts.tolist(), [window] * len(starts), round_all(entropies, 3), (entropies >= 6.5).tolist()


def window_sums(raw: bytes, window: int = 32, step: int = 8) -> tuple[int, int, int]:
    """Number of windows, of spikes, and the sum of entropies in thousandths, each rounded as in window_arrays."""
    entropies = _windows(raw, window, step)[2]
    milli = sum(int(np.rint(np.multiply(round_all(entropies[at : at + 4096], 3), 1000)).sum()) for at in range(0, len(entropies), 4096))
    return len(entropies), int((entropies >= 6.5).sum()), milli


def windows_of(raw: bytes, window: int = 32, step: int = 8) -> list[dict]:
    names = ("offset", "window_size", "entropy", "is_spike")
    return [dict(zip(names, w, strict=True)) for w in zip(*window_arrays(raw, window, step), strict=True)]


def chi_square_of(c: np.ndarray) -> float:
    n = int(c.sum())
    return round(256 * int((c.astype(np.int64) ** 2).sum()) / n - n, 4) if n else 0.0


def pi_of(raw: bytes) -> tuple[float, float]:
    """pi from disjoint byte pairs, and its error in percent."""
    if len(raw) < 4:
        return 0.0, 100.0
    pairs = len(raw) // 2
    d = np.frombuffer(raw, np.uint8, pairs * 2).astype(float) - 127.5
    x, y = d[::2], d[1::2]
    pi = 4.0 * int((x * x + y * y <= 127.5**2).sum()) / pairs
    return round(pi, 5), round(abs(pi - math.pi) / math.pi * 100.0, 2)


def correlation_of(raw: bytes) -> float:
    """Circular correlation of neighbouring bytes, from exact integer sums."""
    n = len(raw)
    if n < 2:
        return 0.0
    x = np.frombuffer(raw, np.uint8).astype(np.int64)
    s, xx, xy = int(x.sum()), int((x * x).sum()), int((x * np.roll(x, -1)).sum())
    low = n * xx - s * s
    return round(max(-1.0, min(1.0, (n * xy - s * s) / low)), 4) if low else 0.0


def assessment(chi: float, n: int) -> str:
    if n == 0:
        return "No data"
    if n < 256:
        return "Short Sample (Low Statistical Power)"
    return "Highly Uniform (Crypto/Packed)" if chi < 310 else "Moderately Uniform (Compressed)" if chi < 600 else "Non-Uniform (Structured Text/Code)"


def packer_points(h: float, chi: float, pi_error: float, corr: float, n: int) -> float:
    points = 45.0 if h >= 7.2 else 30.0 if h >= 6.5 else 15.0 if h >= 5.8 else 0.0
    if n >= 256:
        points += 25.0 if chi < 350 else 15.0 if chi < 600 else 0.0
    if n >= 128:
        points += 15.0 if pi_error < 5 else 8.0 if pi_error < 10 else 0.0
    if n >= 64:
        points += 15.0 if abs(corr) < 0.08 else 7.0 if abs(corr) < 0.15 else 0.0
    return min(100.0, points)


def classification(h: Column) -> Column:
    return F.when(h >= 6.8, "HIGH_ENTROPY_PACKED").when(h >= 5.6, "OBFUSCATED_DATA").when(h >= 4.5, "CODE_SCRIPT").otherwise("NORMAL_TEXT")


def class_of(h: float) -> str:
    return "HIGH_ENTROPY_PACKED" if h >= 6.8 else "OBFUSCATED_DATA" if h >= 5.6 else "CODE_SCRIPT" if h >= 4.5 else "NORMAL_TEXT"


def _raw(df: DataFrame) -> Column:
    return plain(F.col("payload"))


def byte_entropy(df: DataFrame) -> DataFrame:
    return per_payload(df, _raw(df), "total_bytes long, entropy double", lambda r: (len(r), round(entropy_of(counts_of(r)), 4)))


def entropy_class(df: DataFrame) -> DataFrame:
    h = per_payload(df, _raw(df), "h double", lambda r: (entropy_of(counts_of(r)),))
    return h.select("source", "payload_id", classification(F.col("h")).alias("classification"), (F.col("h") >= 5.6).alias("is_suspicious"))


def byte_histogram(df: DataFrame) -> DataFrame:
    """The bytes that occur, a row each."""

    def made(r: bytes) -> tuple:
        c = counts_of(r)
        some = np.flatnonzero(c)
        return some.tolist(), c[some].tolist()

    return zipped(df, _raw(df), "b int, n long", made)


def char_classes(df: DataFrame) -> DataFrame:
    fields = "printable_pct double, whitespace_pct double, control_pct double, high_bit_pct double, special_pct double"
    return per_payload(df, _raw(df), fields, lambda r: tuple(round(x, 2) for x in classes_of(counts_of(r))))


def top_bytes(df: DataFrame) -> DataFrame:
    return zipped(df, _raw(df), "rank int, b int, n long", lambda r: tuple([t[k] for t in top_of(r)] for k in ("rank", "b", "n")))


WINDOWS = "array<struct<offset:int,window_size:int,entropy:double,is_spike:boolean>>"


def sliding_entropy(df: DataFrame, window: int = 32, step: int = 8) -> DataFrame:
    return zipped(df, _raw(df), "offset int, window_size int, entropy double, is_spike boolean", lambda r: window_arrays(r, window, step))


def chi_square(df: DataFrame) -> DataFrame:
    return per_payload(df, _raw(df), "chi_square double", lambda r: (chi_square_of(counts_of(r)),))


def monte_carlo_pi(df: DataFrame) -> DataFrame:
    return per_payload(df, _raw(df), "pi double, error_pct double", pi_of)


def serial_correlation(df: DataFrame) -> DataFrame:
    return per_payload(df, _raw(df), "serial_correlation double", lambda r: (correlation_of(r),))


RANDOMNESS = "total_bytes long, shannon_entropy double, chi_square double, chi_square_assessment string, monte_carlo_pi double, monte_carlo_pi_error_pct double, serial_correlation double, packer_detected boolean, packer_confidence_pct double"


def randomness_of(r: bytes) -> tuple:
    c = counts_of(r)
    h, chi, (pi, error), corr = entropy_of(c), chi_square_of(c), pi_of(r), correlation_of(r)
    points = packer_points(h, chi, error, corr, len(r)) if r else 0.0
    return len(r), round(h, 4), round(chi, 2), assessment(chi, len(r)), pi, error, corr, points >= 60, round(points, 1)


def randomness_report(df: DataFrame) -> DataFrame:
    return per_payload(df, _raw(df), RANDOMNESS, randomness_of)


def compression_ratio(df: DataFrame) -> DataFrame:
    return per_payload(df, _raw(df), "compression_ratio double", lambda r: (round(len(zlib.compress(r, 9)) / len(r), 4) if r else 1.0,))


PROFILE = f"total_bytes long, shannon_entropy double, classification string, is_suspicious_entropy boolean, compression_ratio double, char_classes struct<printable_pct:double,whitespace_pct:double,control_pct:double,high_bit_pct:double,special_pct:double>, sliding_window_profile {WINDOWS}, byte_distribution_256 array<long>, byte_frequencies array<struct<rank:int,b:int,n:long>>"


def profile_of(r: bytes, window: int = 32, step: int = 8) -> tuple:
    c = counts_of(r)
    h = entropy_of(c)
    classes = dict(zip(("printable_pct", "whitespace_pct", "control_pct", "high_bit_pct", "special_pct"), (round(x, 2) for x in classes_of(c)), strict=True))
    return len(r), round(h, 4), class_of(h), h >= 5.6, round(len(zlib.compress(r, 9)) / len(r), 4) if r else 1.0, classes, windows_of(r, window, step), c.tolist(), top_of(r)


def entropy_profile(df: DataFrame, window: int = 32, step: int = 8) -> DataFrame:
    return per_payload(df, _raw(df), PROFILE, lambda r: profile_of(r, window, step))


SUMMARY = "total_bytes long, shannon_entropy double, classification string, is_suspicious_entropy boolean, printable_pct double, whitespace_pct double, control_pct double, high_bit_pct double, special_pct double, windows long, spikes long, window_milli long, byte_distribution string, byte_frequencies string"


def summary_of(r: bytes) -> tuple:
    c = counts_of(r)
    h = entropy_of(c)
    top = ",".join(f"{t['rank']}:{t['b']}:{t['n']}" for t in top_of(r))
    return len(r), round(h, 4), class_of(h), h >= 5.6, *(round(x, 2) for x in classes_of(c)), *window_sums(r), ",".join(map(str, c.tolist())), top


def entropy_summary(df: DataFrame) -> DataFrame:
    """The profile in flat columns: windows by number, spikes and sum of thousandths; no window leaves the worker."""
    return per_payload(df, _raw(df), SUMMARY, summary_of)
