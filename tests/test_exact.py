"""Queries that SQL can't express, against plain Python over every row; and leader clusters against a loop."""

import base64
import html
import json
import math
import random
import re
import urllib.parse
import zlib
from collections import Counter
from hashlib import md5

import numpy as np
import pytest

from sedimenta.functions.fixed import SIGNATURES
from sedimenta.operators import decode, fingerprints
from sedimenta.plans import catalog
from sedimenta.sources.corpus import payload_corpus

PRINTABLE = set(map(chr, range(32, 127))) | set("\r\n\t")


@pytest.fixture(scope="module")
def corpus(spark, small):
    return {(r.source, r.payload_id): r.payload for r in payload_corpus(spark, small).collect()}


def rows(spark, small, name):
    return {(r.source, r.payload_id): r for r in catalog.queries()[name](spark, small).collect()}


def block(m):
    try:
        t = base64.b64decode(m.group(), validate=True).decode("utf-8")
    except ValueError:
        return m.group()
    return t if t and sum(c in PRINTABLE for c in t) > 0.85 * len(t) else m.group()


LAYERS = [
    urllib.parse.unquote,
    lambda t: html.unescape(t) if re.search("&.*;|&#", t, re.S) or "&" in t and ";" in t else t,
    lambda t: re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), re.sub(r"\\x([0-9a-fA-F]{2})", lambda m: chr(int(m[1], 16)), t)),
    lambda t: re.sub(r"""['"]\s*\+\s*['"]""", "", t),
    lambda t: re.sub(decode.BASE64, block, t),
]


def unwrapped(text):
    """(text, names of steps in order) by the five layers until nothing changes."""
    names = []
    for _ in range(8):
        before = text
        for (name, _), layer in zip(decode.STEPS, LAYERS, strict=True):
            if (new := layer(text)) != text:
                text = new
                names.append(name)
        if text == before:
            break
    return text, names


def assessed(raw):
    """(normalized, rules by (signature, found), risk, primary threat, severity, entropy)."""
    plain, names = unwrapped(raw)
    found = []
    for k, (category, pattern, weight, *_) in enumerate(SIGNATURES, 1):
        m = re.search(pattern, plain, re.I) or re.search(pattern, raw, re.I)
        if m:
            found.append((k, category, weight, m.group()))
    data = raw.encode()
    h = -sum(c / len(data) * math.log2(c / len(data)) for c in Counter(data).values()) if data else 0.0
    risk = min(100, sum(w for _, _, w, _ in found) + 25 * (h >= 5.6) + 15 * (len(names) > 1))
    scores = {}
    for _, category, weight, _ in found:
        scores[category] = scores.get(category, 0) + weight
    primary = max(scores, key=scores.get) if scores else "HIGH_ENTROPY_SUSPICIOUS_PAYLOAD" if h >= 5.6 else "BENIGN_OR_UNCLASSIFIED"
    severity = next(s for least, s in ((70, "CRITICAL"), (45, "HIGH"), (25, "MEDIUM"), (1, "LOW"), (0, "INFO")) if risk >= least)
    return plain, names, found, risk, primary, severity, h


def test_compression_ratio(spark, small, corpus):
    got = rows(spark, small, "compression_ratio")
    assert {k: r.compression_ratio for k, r in got.items()} == {k: round(len(zlib.compress(p.encode(), 9)) / len(p.encode()), 4) if p else 1.0 for k, p in corpus.items()}


def test_html_decode(spark, small, corpus):
    got = rows(spark, small, "html_decode")
    assert {k: r.decoded for k, r in got.items()} == {k: LAYERS[1](p) for k, p in corpus.items()}


def test_deobfuscate(spark, small, corpus):
    got = rows(spark, small, "deobfuscate")
    assert set(got) == set(corpus)
    for k, p in corpus.items():
        text, names = unwrapped(p)
        r = got[k]
        assert (r.normalized_payload, r.total_layers_unwrapped, r.transforms_applied, [s.transform for s in r.steps]) == (text, len(names), list(dict.fromkeys(names)), names), k


def test_threat_report(spark, small, corpus):
    got = rows(spark, small, "threat_report")
    assert set(got) == set(corpus)
    for k, p in corpus.items():
        plain, names, found, risk, primary, severity, h = assessed(p)
        r = got[k]
        assert (r.raw_payload, r.normalized_payload, r.risk_score, r.primary_threat, r.severity, r.total_layers_unwrapped) == (p, plain, risk, primary, severity, len(names)), k
        assert [(x.sig, x.category, x.weight, x.matched_subpattern) for x in r.matched_rules] == found
        assert r.cwe_mappings == sorted({SIGNATURES[f[0] - 1][3] for f in found}) and r.mitre_attack_mappings == sorted({SIGNATURES[f[0] - 1][4] for f in found})
        assert abs(r.shannon_entropy - h) < 6e-5
        assert set(r.secondary_threats) == {f[1] for f in found} - {primary}


def test_waf_rules(spark, small, corpus):
    got = rows(spark, small, "waf_rules")
    assert set(got) == set(corpus)
    for k, p in corpus.items():
        plain, _, found, _, primary, severity, _ = assessed(p)
        mark = re.escape((found[0][3] if found else plain)[:32])
        i = 900001 + int(md5(p.encode()).hexdigest()[:8], 16) % 90000
        r = got[k]
        assert (r.threat, r.severity) == (primary, severity)
        assert f'@rx {mark}" ' in r.modsecurity and f'"id:{i},' in r.modsecurity and f"Blocked {primary} Attack" in r.modsecurity
        assert r.cloudflare == f'(http.request.uri.query contains "{mark}" or http.request.body.raw contains "{mark}")'
        rule = json.loads(r.aws_waf)
        assert rule["Name"] == f"Block-{primary}-{i}" and rule["Statement"]["RegexMatchStatement"]["SearchString"] == mark
        assert f'content:"{mark[:20]}"' in r.suricata and f"sid:{i};" in r.suricata


@pytest.mark.parametrize("most", [0, 3, 9, 14, 40, 63])
def test_leaders_against_a_loop(spark, tmp_path, monkeypatch, most):
    """Random hashes, dense groups around some of them, repeats; several rounds."""
    rng = random.Random(most)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    bits = [rng.choice(seeds) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(0, 12))) & (2**64 - 1) for _ in range(700)] + seeds
    rng.shuffle(bits)
    monkeypatch.setattr(fingerprints, "ROUND", 90)
    monkeypatch.setattr(fingerprints, "largest_distance", lambda threshold: most)
    prints = spark.createDataFrame([(i, fingerprints.signed(b)) for i, b in enumerate(bits)], "idx long, bits long")
    got = {r.idx: (r.leader, r.cluster_id) for r in fingerprints.cluster_prints(prints, folder=f"file://{tmp_path}/c").collect()}
    leaders, want = [], {}
    for i, b in enumerate(bits):
        hit = next((k for k, x in leaders if (x ^ b).bit_count() <= most), None)
        if hit is None:
            leaders.append((i, b))
        want[i] = i if hit is None else hit
    rank = {k: n for n, (k, _) in enumerate(leaders, 1)}
    assert got == {i: (k, rank[k]) for i, k in want.items()}


def test_few_pairs_are_compared_on_random_hashes():
    """The buckets of a round give a hash well under one in a hundred leaders to compare."""
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2**64, 8192, dtype=np.uint64)
    table = fingerprints.Leaders(bits, np.arange(8192), 9)
    met = sum(int(np.diff(starts)[(bits >> np.uint64(lo) & np.uint64((1 << wide) - 1)).astype(np.int64)].sum()) for lo, wide, starts, _ in table.bands)
    assert met / 8192**2 < 0.012
