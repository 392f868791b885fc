import math
import random
import zlib
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sedimenta.operators import bytestats as b
from sedimenta.operators import fingerprints as f
from sedimenta.operators import ngrams as n

# payload: entropy, chi-square, pi, correlation, transition entropy, divergence, windows
VALUES = {
    "banana": (1.4591, 591.3333, 4.0, -0.5586, 0.0, 4.0748, 0),
    "ABAB" * 30: (1.0, 15240.0, 4.0, -1.0, 0.0, 6.1778, 12),
    "The quick brown fox jumps over the lazy dog.": (4.4877, 677.4545, 4.0, -0.205, 0.9013, 1.3002, 2),
    "SELECT * FROM users WHERE id=1; " + "A" * 50: (2.5807, 7966.3902, 3.90244, 0.2321, 0.3396, 4.4657, 7),
    "héllo wörld – ünïcode": (3.9582, 494.4815, 4.0, -0.0341, 0.8273, 4.9387, 10),
    "<script>alert(document.cookie)</script>": (4.1823, 584.5897, 4.0, 0.1189, 0.7637, 2.6314, 1),
    "1' UNION SELECT 1,username,password FROM users--": (4.5698, 570.6667, 4.0, 0.4206, 0.8666, 1.8731, 3),
    "aaaaaaaa": (0.0, 2040.0, 4.0, 0.0, 0.0, 5.5339, 5),
}
HASHES = {
    "SELECT 1 FROM users WHERE id=1": "a0dc56d5037b2334", "SELECT 1 FROM users WHERE id=2": "a0dc56c5417ba234", "SELECT 1 FROM users WHERE id=3": "a0dc5685037ba3f4", "<svg onload=alert(1)>": "8b54cfbbef9155e0", "<svg onload=alert(2)>": "8671cfbbff9154e0",
    "<script>alert(window.origin);</script>": "923b58b7e4951462", "UNION SELECT 1,2,3--": "d51110e5028a1017", "UNION SELECT 1,2,4--": "f591108fabd21096",
}


@pytest.mark.parametrize("payload", VALUES)
def test_known_values(payload):
    raw = payload.encode()
    c = b.counts_of(raw)
    got = (round(b.entropy_of(c), 4), b.chi_square_of(c), b.pi_of(raw)[0], b.correlation_of(raw), n.transition_entropy_of(raw), n.divergence_of(raw), len(b.windows_of(raw)))
    assert got == VALUES[payload]


@given(st.binary(max_size=400))
def test_against_plain_definitions(raw):
    counts, size = Counter(raw), len(raw)
    c = b.counts_of(raw)
    assert math.isclose(b.entropy_of(c), -sum(v / size * math.log2(v / size) for v in counts.values()), abs_tol=1e-9)
    assert 0 <= b.entropy_of(c) <= 8
    if size:
        assert math.isclose(b.chi_square_of(c), sum((counts.get(i, 0) - size / 256) ** 2 / (size / 256) for i in range(256)), abs_tol=1e-3)
    for w in b.windows_of(raw):
        piece = raw[w["offset"] : w["offset"] + w["window_size"]]
        assert len(piece) == w["window_size"] and abs(w["entropy"] - b.entropy_of(b.counts_of(piece))) <= 0.00051
    rows = {}
    for a, p in zip(*(x.tolist() for x in n.transitions_of(raw)[::2]), strict=True):
        rows[a] = rows.get(a, 0) + p
    assert all(abs(v - 1) < 1e-3 for v in rows.values())
    assert n.divergence_of(raw) >= 0
    assert f.simhash_of(raw) == f.simhash_of(bytes(raw))


def test_random_and_text():
    raw = random.Random(42).randbytes(1024)
    size, h, _, said, *_, packed, points = b.randomness_of(raw)
    assert size == 1024 and h >= 7 and packed and points >= 60 and said == "Highly Uniform (Crypto/Packed)"
    assert not b.randomness_of(b"The quick brown fox jumps over the lazy dog and runs through the forest.")[7]
    assert b.entropy_of(b.counts_of(bytes(range(256)))) == 8.0
    assert b.randomness_of(b"") == (0, 0.0, 0.0, "No data", 0.0, 100.0, 0.0, False, 0.0)


def test_profile():
    raw = b"ABC" * 10 + b"\x00\xff"
    size, _, kind, odd, ratio, classes, windows, histogram, top = b.profile_of(raw)
    assert (size, kind, odd, histogram[65], histogram[0], len(windows)) == (32, "NORMAL_TEXT", False, 10, 1, 1)
    assert ratio == round(len(zlib.compress(raw, 9)) / 32, 4) and classes["high_bit_pct"] == 3.12
    assert [t["b"] for t in top] == [65, 66, 67, 0, 255]
    assert b.profile_of(b"")[7] == [0] * 256


def test_grams():
    assert [(g, x) for g, x, _ in n.grams_of(b"banana")] == [("ba", 0.2), ("an", 0.4), ("na", 0.4)]
    assert n.grams_of(b"a", 2) == [] and n.grams_of(b"\x00\x01", 2) == [("0001", 1.0, 0)]
    assert [g for g, *_ in n.grams_of(b"abcdefghijk", 9)] == ["abcdefghi", "bcdefghij", "cdefghijk"]
    assert n.top_of(b"banana") == [("an", 0.4), ("na", 0.4), ("ba", 0.2)]
    assert n.divergence_of(bytes(range(256))) > n.divergence_of(b"The quick brown fox")
    assert n.divergence_of(b"ab", n.baseline_logs({97: 0.5})) > 0


def test_fingerprints():
    for payload, want in HASHES.items():
        assert f"{f.simhash_of(payload.encode()):016x}" == want
    assert f.minhash_of(b"UNION SELECT 1,2,3--", 32)[:3] == [66531005, 325153367, 94256734]
    assert f.minhash_of(b"", 200) == [0] * 200 and len(f.minhash_of(b"abc", 200)) == 128
    assert f.largest_distance(0.85) == 9 and f.largest_distance(0.0) == 64 and f.largest_distance(1.1) == -1
