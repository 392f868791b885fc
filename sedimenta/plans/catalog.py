"""Queries over the payload corpus, and their DuckDB equivalents."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.fixed import CODE_BYTES, OBFUSCATIONS, PHP, PRIME, SCRIPTS, SHEBANG, SIGNATURES, ZERO_WIDTH, baseline, hash_family
from sedimenta.operators import bytestats, decode, fingerprints, ngrams, paths, polyglot, rules, shellcode, structure, threats
from sedimenta.plans import reports
from sedimenta.sources.corpus import CORPUS_SQL, fixtures, payload_corpus
from sedimenta.session import ship


def _over(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(payload_corpus(spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item with the next, and each fixture with the next."""
    ship(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.lit("benchmark").alias("source"), F.col("item_id").alias("i"), F.col("text").alias("p"))
    rows = items.unionByName(fixtures(spark).select("source", F.col("payload_id").alias("i"), F.col("payload").alias("p")))
    after = rows.select("source", (F.col("i") - 1).alias("i"), F.col("p").alias("right"))
    return rows.withColumnRenamed("p", "left").join(after, ["source", "i"]).withColumnRenamed("i", "payload_id")


def lsh_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(_pairs(spark, sf_dir), keys=("source", "payload_id"))


#: Sources in the order in which their payloads may lead.
CLUSTERED = ("conversations", "benchmark", "fixtures", "documents", "pages", "urls", "events")


def cluster_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leader clusters of the whole corpus, in the order of CLUSTERED and then of ids."""
    rows = payload_corpus(spark, sf_dir)
    place = F.array_position(F.array(*[F.lit(x) for x in CLUSTERED]), F.col("source")) - 1
    return fingerprints.cluster(rows.select((place * 10**12 + F.col("payload_id")).alias("idx"), "payload")).drop("preview")


def baseline_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence from a baseline of one's own: bytes it lacks have 1e-6."""
    return ngrams.kl_divergence(payload_corpus(spark, sf_dir), {b: 1 / 95 for b in range(32, 127)})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    over = {
        "byte_entropy": bytestats.byte_entropy, "entropy_class": bytestats.entropy_class, "byte_histogram": bytestats.byte_histogram, "char_classes": bytestats.char_classes, "top_bytes": bytestats.top_bytes,
        "sliding_entropy": bytestats.sliding_entropy, "chi_square": bytestats.chi_square, "monte_carlo_pi": bytestats.monte_carlo_pi, "serial_correlation": bytestats.serial_correlation, "randomness_report": bytestats.randomness_report,
        "compression_ratio": bytestats.compression_ratio, "entropy_profile": reports.entropy_profile,
        "ngram_freq": lambda d: ngrams.ngram_frequencies(d).drop("first_pos"), "trigram_freq": lambda d: ngrams.ngram_frequencies(d, 3).drop("first_pos"), "transition_matrix": ngrams.transition_matrix, "transition_entropy": ngrams.transition_entropy, "kl_divergence": ngrams.kl_divergence, "top_bigrams": ngrams.top_bigrams,
        "simhash": lambda d: fingerprints.simhash(d).drop("bits"), "minhash": fingerprints.minhash_rows, "markov_profile": reports.markov_profile,
        "threat_matches": lambda d: threats.threat_matches(d).select("source", "payload_id", "sig", "category", "cwe", "mitre", "weight", "matched_subpattern"), "threat_scores": threats.threat_scores, "threat_primary": threats.threat_primary, "cwe_mappings": threats.cwe_mappings, "threat_summary": threats.threat_summary, "threat_report": threats.threat_report,
        "waf_rules": rules.waf_rules, "ast_matches": structure.obfuscation_matches, "ast_score": structure.obfuscation_score, "ast_report": reports.ast_report, "zero_width": structure.zero_width,
        "polyglot_formats": polyglot.polyglot_formats, "embedded_scripts": polyglot.embedded_scripts, "polyglot_class": polyglot.polyglot_class, "polyglot_report": reports.polyglot_report,
        "shellcode_score": shellcode.shellcode_score, "shellcode_report": reports.shellcode_report, "nop_runs": shellcode.nop_runs,
        "deobfuscate": decode.deobfuscate, "html_decode": decode.html_decode, "url_decode": lambda d: decode.single_layers(d, "url"), "hex_decode": lambda d: decode.single_layers(d, "hex"), "concat_collapse": lambda d: decode.single_layers(d, "concat"), "base64_decode": lambda d: decode.single_layers(d, "base64"),
        "local_origin": paths.local_origins, "safe_path": paths.safe_paths,
    }
    return {name: _over(f) for name, f in over.items()} | {"lsh_compare": lsh_compare, "cluster_payloads": cluster_payloads, "baseline_divergence": baseline_divergence}


# DuckDB

_HEX = "hexed AS (SELECT source, payload_id, payload, hex(encode(payload)) AS h FROM corpus)"
_BARE = r"regexp_replace(payload, '\\[xX]', '', 'g')"
_HEX2 = rf"""hexed AS (SELECT source, payload_id, payload, CASE
    WHEN regexp_matches(payload, '^\\[xX]') AND regexp_full_match({_BARE}, '(\s*[0-9a-fA-F]{{2}})*\s*') THEN upper(regexp_replace({_BARE}, '\s', '', 'g'))
    WHEN length(payload) >= 16 AND length(payload) % 2 = 0 AND regexp_full_match(payload, '[0-9a-fA-F]+') THEN upper(payload)
    ELSE hex(encode(payload)) END AS h FROM corpus)"""
_BYTES = """codes AS (SELECT printf('%02X', i) AS x, i::INTEGER AS b FROM range(256) t(i)),
pairs AS (SELECT source, payload_id, unnest(l) AS x, unnest(range(len(l))) AS pos FROM (SELECT source, payload_id, regexp_extract_all(h, '..') AS l FROM hexed)),
bytes AS (SELECT source, payload_id, pos, b FROM pairs JOIN codes USING (x)),
hist AS (SELECT source, payload_id, b, count(*) AS c, min(pos) AS first_pos FROM bytes GROUP BY ALL),
sized AS (SELECT source, payload_id, (length(h) // 2)::BIGINT AS n FROM hexed)"""


def _bytes(select: str, hexed: str = _HEX, more: str = "") -> str:
    return f"WITH {CORPUS_SQL},\n{hexed},\n{_BYTES}{more}\n{select}"


_H = ", ent AS (SELECT s.source, s.payload_id, s.n, coalesce(0.0 - sum(c * 1.0 / n * log2(c * 1.0 / n)), 0.0) AS h FROM sized s LEFT JOIN hist USING (source, payload_id) GROUP BY ALL)"
_CHI = ", chi AS (SELECT s.source, s.payload_id, CASE WHEN s.n = 0 THEN 0.0 ELSE round_even(256.0 * coalesce(sum(c * c), 0)::DOUBLE / s.n - s.n, 4) END AS chi FROM sized s LEFT JOIN hist USING (source, payload_id) GROUP BY s.source, s.payload_id, s.n)"
_PI = """, duo AS (SELECT source, payload_id, pos // 2 AS k, count(*) AS two, sum((b - 127.5) * (b - 127.5)) AS d FROM bytes GROUP BY ALL),
circle AS (SELECT s.source, s.payload_id, s.n, count(*) FILTER (WHERE two = 2 AND d <= 127.5 * 127.5) AS hit FROM sized s LEFT JOIN duo USING (source, payload_id) GROUP BY ALL),
pies AS (SELECT source, payload_id, CASE WHEN n < 4 THEN 0.0 ELSE round_even(4.0 * hit / (n // 2), 5) END AS pi, CASE WHEN n < 4 THEN 100.0 ELSE round_even(abs(4.0 * hit / (n // 2) - pi()) / pi() * 100.0, 2) END AS error_pct FROM circle)"""
_CORR = """, nexts AS (SELECT source, payload_id, b, coalesce(lead(b) OVER w, first_value(b) OVER w) AS nb FROM bytes WINDOW w AS (PARTITION BY source, payload_id ORDER BY pos)),
sums AS (SELECT source, payload_id, sum(b)::DOUBLE AS s, sum(b * b)::DOUBLE AS xx, sum(b * nb)::DOUBLE AS xy FROM nexts GROUP BY ALL),
corrs AS (SELECT z.source, z.payload_id, CASE WHEN z.n < 2 OR z.n * xx - s * s = 0 THEN 0.0 ELSE round_even(greatest(-1.0, least(1.0, (z.n * xy - s * s) / (z.n * xx - s * s))), 4) END AS corr FROM sized z LEFT JOIN sums USING (source, payload_id))"""
_GRAM = """CASE WHEN regexp_full_match(g, '([2-6][0-9A-F]|7[0-9A-E])*') THEN array_to_string(list_transform(regexp_extract_all(g, '..'), lambda x: chr(('0x' || x)::INTEGER)), '') ELSE lower(g) END"""


def _grams(n: int) -> str:
    return f""", gr AS (SELECT source, payload_id, x || {' || '.join(f'lead(x, {k}) OVER w' for k in range(1, n))} AS g, pos FROM pairs WINDOW w AS (PARTITION BY source, payload_id ORDER BY pos)),
gc AS (SELECT source, payload_id, g, count(*) AS c, min(pos) AS first_pos FROM gr WHERE g IS NOT NULL GROUP BY ALL),
gf AS (SELECT source, payload_id, {_GRAM} AS gram, round_even(c * 1.0 / sum(c) OVER (PARTITION BY source, payload_id), 5) AS freq, first_pos FROM gc)"""


_MATRIX = """, tr AS (SELECT source, payload_id, b AS b1, lead(b) OVER (PARTITION BY source, payload_id ORDER BY pos) AS b2 FROM bytes),
tc AS (SELECT source, payload_id, b1, b2, count(*) AS c FROM tr WHERE b2 IS NOT NULL GROUP BY ALL),
tp AS (SELECT source, payload_id, b1, b2, round_even(c * 1.0 / sum(c) OVER (PARTITION BY source, payload_id, b1), 6) AS p, c FROM tc)"""
_SHINGLES = """, sh AS (SELECT source, payload_id, x || lead(x, 1) OVER w || lead(x, 2) OVER w AS g FROM pairs WINDOW w AS (PARTITION BY source, payload_id ORDER BY pos)),
sg AS (SELECT source, payload_id, g, count(*)::BIGINT AS w FROM sh WHERE g IS NOT NULL GROUP BY ALL UNION ALL SELECT source, payload_id, h, 1 FROM hexed WHERE length(h) IN (2, 4)),
mh AS (SELECT g, ('0x' || substr(md5(lower(g)), 1, 16))::UBIGINT AS v FROM (SELECT DISTINCT g FROM sg)),
sv AS (SELECT source, payload_id, w, v FROM sg JOIN mh USING (g))"""
_VOTES = ", ".join(f"sum(CASE WHEN (v >> {k}) & 1 = 1 THEN w ELSE -w END) AS v{k}" for k in range(64))
_SIM = f", vt AS (SELECT source, payload_id, {_VOTES} FROM sv GROUP BY source, payload_id), sim AS (SELECT source, payload_id, {' + '.join(f'(CASE WHEN v{k} > 0 THEN {1 << k}::UBIGINT ELSE 0::UBIGINT END)' for k in range(64))} AS s FROM vt)"
_MIN32 = ", mn AS (SELECT source, payload_id, [" + ", ".join(f"least(4294967295, min(({a}::HUGEINT * (v & 4294967295)::HUGEINT + {b}) % {PRIME}))::BIGINT" for a, b in hash_family()[:32]) + "] AS m FROM sv GROUP BY source, payload_id)"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re(p: str) -> str:
    return _text("(?i)" + p)


_SIGS = "sigs AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {_text(c)}, {_text(p and '')}, {w}, {_text(cwe)}, {_text(m)})" for i, (c, p, w, cwe, m, _) in enumerate(SIGNATURES, 1)) + ") AS t(sig, category, _p, weight, cwe, mitre))"
_FOUND = "found AS (" + " UNION ALL ".join(f"SELECT source, payload_id, {i} AS sig, regexp_extract(payload, {_re(p)}, 0) AS matched_subpattern FROM corpus" for i, (_, p, *_rest) in enumerate(SIGNATURES, 1)) + "), matched AS (SELECT source, payload_id, f.sig, category, cwe, mitre, weight, matched_subpattern FROM found f JOIN sigs USING (sig) WHERE matched_subpattern <> '')"
_CATS = "scores AS (SELECT source, payload_id, category, sum(weight)::INTEGER AS score, min(sig) AS first_sig FROM matched GROUP BY source, payload_id, category)"
_PRIMARY = f"""WITH {CORPUS_SQL},
{_HEX},
{_BYTES}{_H}, {_SIGS}, {_FOUND}, {_CATS},
best AS (SELECT source, payload_id, arg_min(category, -score * 100 + first_sig) AS top, sum(score) AS base FROM scores GROUP BY ALL),
risked AS (SELECT e.source, e.payload_id, h >= 5.6 AS odd, top, least(100, coalesce(base, 0) + CASE WHEN h >= 5.6 THEN 25 ELSE 0 END)::INTEGER AS risk_score FROM ent e LEFT JOIN best USING (source, payload_id)),
primary_of AS (SELECT source, payload_id, coalesce(top, CASE WHEN odd THEN 'HIGH_ENTROPY_SUSPICIOUS_PAYLOAD' ELSE 'BENIGN_OR_UNCLASSIFIED' END) AS primary_threat, risk_score,
  CASE WHEN risk_score >= 70 THEN 'CRITICAL' WHEN risk_score >= 45 THEN 'HIGH' WHEN risk_score >= 25 THEN 'MEDIUM' WHEN risk_score > 0 THEN 'LOW' ELSE 'INFO' END AS severity FROM risked)"""
_OBF = ", ".join(f"len(regexp_extract_all(payload, {_re(p)}))::INTEGER AS n{i}" for i, (_, p, _, _) in enumerate(OBFUSCATIONS))
_ZW = "'[\\x{200b}\\x{200c}\\x{200d}\\x{feff}\\x{ad}]'"
_DENSE = "(length(payload) - length(replace(payload, '+', '')) >= 5 AND length(payload) < 200)"
_TECH = " UNION ALL ".join([*(f"SELECT source, payload_id, {_text(n)} AS category, {w} AS weight FROM corpus WHERE regexp_matches(payload, {_re(p)})" for n, p, w, _ in OBFUSCATIONS), f"SELECT source, payload_id, '{ZERO_WIDTH[0]}', 30 FROM corpus WHERE regexp_matches(payload, {_ZW})", f"SELECT source, payload_id, 'EXCESSIVE_CONCATENATION_DENSITY', 15 FROM corpus WHERE {_DENSE}"])


_HEXF = _HEX2.split("hexed AS")[0] + rf"""hexed AS (SELECT source, payload_id, payload, CASE
    WHEN regexp_matches(payload, '^\s*\\x') AND regexp_full_match(replace(trim(payload), '\x', ''), '(\s*[0-9a-fA-F]{{2}})*\s*') THEN upper(regexp_replace(replace(trim(payload), '\x', ''), '\s', '', 'g'))
    ELSE hex(encode(payload)) END AS h FROM corpus)"""
_LATIN = "lat AS (SELECT source, payload_id, h, array_to_string(list_transform(regexp_extract_all(h, '..'), lambda x: chr(('0x' || x)::INTEGER)), '') AS t FROM hexed)"
_MAGIC = """fm AS (SELECT *, lower(t[1:512]) AS head FROM lat),
base AS (SELECT source, payload_id, t, h, list_filter([CASE WHEN starts_with(t, 'GIF87a') OR starts_with(t, 'GIF89a') THEN 'GIF' END, CASE WHEN starts_with(h, '89504E470D0A1A0A') THEN 'PNG' END, CASE WHEN starts_with(h, 'FFD8FF') THEN 'JPEG' END, CASE WHEN starts_with(t, '%PDF-') THEN 'PDF' END,
  CASE WHEN starts_with(h, '504B0304') OR (contains(t, 'PK' || chr(3) || chr(4)) AND contains(t, 'PK' || chr(5) || chr(6))) THEN 'ZIP' END, CASE WHEN starts_with(h, '7F454C46') THEN 'ELF' END, CASE WHEN starts_with(t, 'MZ') THEN 'PE_EXE' END,
  CASE WHEN contains(head, '<svg') THEN 'SVG' WHEN contains(head, '<?xml') THEN 'XML' WHEN contains(head, '<!doctype html') OR contains(head, '<html') THEN 'HTML' END], lambda x: x IS NOT NULL) AS f FROM fm)"""


def _found_scripts() -> str:
    each = lambda some: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, {_re(p)}) THEN {_text(n + ': ' + chr(39))} || regexp_extract(t, {_re(p)}, 0)[1:60] || {_text(chr(39))} END" for n, p in some) + "], lambda x: x IS NOT NULL)"
    return f""", js AS (SELECT *, {each(SCRIPTS)} AS js, {each(PHP)} AS php, contains(t, '#!/bin/sh') OR contains(t, '#!/bin/bash') AS bang, (list_contains(f, 'GIF') OR list_contains(f, 'JPEG') OR list_contains(f, 'PNG')) AND contains(substr(t, 17), 'PK' || chr(3) || chr(4)) AS zipped FROM base),
poly AS (SELECT source, payload_id, t, f || CASE WHEN len(php) > 0 THEN ['PHP'] ELSE [] END || CASE WHEN bang THEN ['SHELL_SCRIPT'] ELSE [] END || CASE WHEN zipped THEN ['ZIP'] ELSE [] END AS f, js || php || CASE WHEN bang THEN [{_text(SHEBANG)}] ELSE [] END AS s FROM js)"""


_LADDER = """, kinds AS (SELECT *, CASE
  WHEN list_contains(f, 'GIF') AND len(list_filter(s, lambda x: contains(x, 'JS') OR contains(x, 'script') OR contains(x, '/*'))) > 0 THEN ['GIF_JAVASCRIPT_POLYGLOT', '95']
  WHEN list_contains(f, 'PNG') AND list_contains(f, 'PHP') THEN ['PNG_PHP_WEBSHELL_POLYGLOT', '98']
  WHEN list_contains(f, 'PDF') AND (contains(t, '/JavaScript') OR contains(t, '/JS') OR contains(t, '/Launch')) THEN ['PDF_ACTION_SCRIPT_POLYGLOT', '90']
  WHEN list_contains(f, 'JPEG') AND list_contains(f, 'ZIP') THEN ['JPEG_ZIP_ARCHIVE_POLYGLOT', '88']
  WHEN list_contains(f, 'SVG') AND len(s) > 0 THEN ['SVG_SCRIPT_INJECTION_POLYGLOT', '92']
  WHEN len(f) >= 2 THEN ['HYBRID_' || f[1] || '_' || f[2] || '_POLYGLOT', '75']
  WHEN len(s) > 0 AND len(f) = 1 AND f[1] IN ('GIF', 'PNG', 'JPEG', 'PDF') THEN [f[1] || '_EMBEDDED_CODE_POLYGLOT', '85']
  ELSE ['MONOLITHIC_PAYLOAD', CASE WHEN len(s) > 0 THEN '40' ELSE '10' END] END AS k FROM poly)"""


def _code() -> str:
    """Machine-code points over Latin-1 text."""
    wide = lambda p: re.sub(r"\\x([0-9a-f]{2})", r"\\x{\1}", p)
    flags = ", ".join(f"regexp_matches(t, {_text(wide(p))}) AS {n}" for n, _, p, _ in CODE_BYTES)
    points = " + ".join(f"CASE WHEN {n} THEN {v}::DOUBLE ELSE 0.0::DOUBLE END" for n, v, _, _ in CODE_BYTES)
    return rf""", marks AS (SELECT source, payload_id, length(t) AS n, list_max(list_transform(regexp_extract_all(t, '\x{{90}}{{8,}}'), lambda x: length(x))) AS nops, len(regexp_extract_all(t, '[^\x20-\x7e]')) AS odd, {flags} FROM lat),
points AS (SELECT *, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE round_even(least(1.0::DOUBLE, CASE WHEN nops IS NOT NULL THEN least(0.4::DOUBLE, 0.1::DOUBLE + 0.05::DOUBLE * (nops // 8)) ELSE 0.0::DOUBLE END + {points} + CASE WHEN n >= 32 AND odd * 1.0::DOUBLE / n > 0.45 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END), 4) END AS score FROM marks)"""


_VERDICT = "score, score >= 0.5 AS is_probable_shellcode, nops IS NOT NULL OR poly_nop AS nop_sled_detected, call_pop OR fpu AS getpc_detected, syscall OR int80 OR sysenter AS syscall_detected, CASE WHEN n > 0 THEN round_even(odd * 1.0::DOUBLE / n, 4) END AS non_printable_ratio"


def oracle_sql() -> dict[str, str]:
    keys = "source, payload_id"
    with_corpus = f"WITH {CORPUS_SQL}"
    logs = ", ".join(f"({b}, {q!r}::DOUBLE)" for b, q in enumerate(baseline()))
    kl = lambda q: f"SELECT s.source, s.payload_id, coalesce(round_even(greatest(0.0, sum(c * 1.0 / n * (log2(c * 1.0 / n) - log2({q})))), 4), 0.0) AS kl_divergence FROM sized s LEFT JOIN hist USING (source, payload_id) LEFT JOIN base USING (b) GROUP BY s.source, s.payload_id"
    out = {
        "byte_entropy": _bytes(f"SELECT {keys}, n AS total_bytes, round_even(h, 4) AS entropy FROM ent", more=_H),
        "entropy_class": _bytes(f"SELECT {keys}, CASE WHEN h >= 6.8 THEN 'HIGH_ENTROPY_PACKED' WHEN h >= 5.6 THEN 'OBFUSCATED_DATA' WHEN h >= 4.5 THEN 'CODE_SCRIPT' ELSE 'NORMAL_TEXT' END AS classification, h >= 5.6 AS is_suspicious FROM ent", more=_H),
        "byte_histogram": _bytes(f"SELECT {keys}, b, c::BIGINT AS n FROM hist"),
        "char_classes": _bytes("SELECT s.source, s.payload_id, " + ", ".join(f"CASE WHEN s.n = 0 THEN 0.0 ELSE round_even(coalesce(sum(c) FILTER (WHERE {w}), 0)::DOUBLE * (100.0 / s.n), 2) END AS {n}" for n, w in (("printable_pct", "b BETWEEN 32 AND 126"), ("whitespace_pct", "b IN (9, 10, 13, 32)"), ("control_pct", "b < 32 AND b NOT IN (9, 10, 13)"), ("high_bit_pct", "b >= 128"), ("special_pct", "b BETWEEN 33 AND 126 AND NOT (b BETWEEN 48 AND 57 OR b BETWEEN 65 AND 90 OR b BETWEEN 97 AND 122)"))) + " FROM sized s LEFT JOIN hist USING (source, payload_id) GROUP BY s.source, s.payload_id, s.n"),
        "top_bytes": _bytes(f"SELECT {keys}, rank::INTEGER AS rank, b, c::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY source, payload_id ORDER BY c DESC, first_pos) AS rank FROM hist) WHERE rank <= 10"),
        "chi_square": _bytes(f"SELECT {keys}, chi AS chi_square FROM chi", more=_CHI),
        "monte_carlo_pi": _bytes(f"SELECT {keys}, pi, error_pct FROM pies", more=_PI),
        "serial_correlation": _bytes(f"SELECT {keys}, corr AS serial_correlation FROM corrs", more=_CORR),
        "randomness_report": _bytes("""SELECT source, payload_id, total_bytes, shannon_entropy, chi_square, chi_square_assessment, monte_carlo_pi, monte_carlo_pi_error_pct, serial_correlation, points >= 60 AS packer_detected, points AS packer_confidence_pct FROM (
  SELECT e.source, e.payload_id, e.n AS total_bytes, round_even(h, 4) AS shannon_entropy, round_even(chi, 2) AS chi_square, pi AS monte_carlo_pi, error_pct AS monte_carlo_pi_error_pct, corr AS serial_correlation,
    CASE WHEN e.n = 0 THEN 'No data' WHEN e.n < 256 THEN 'Short Sample (Low Statistical Power)' WHEN chi < 310 THEN 'Highly Uniform (Crypto/Packed)' WHEN chi < 600 THEN 'Moderately Uniform (Compressed)' ELSE 'Non-Uniform (Structured Text/Code)' END AS chi_square_assessment,
    least(100.0, CASE WHEN h >= 7.2 THEN 45.0 WHEN h >= 6.5 THEN 30.0 WHEN h >= 5.8 THEN 15.0 ELSE 0.0 END + CASE WHEN e.n < 256 THEN 0.0 WHEN chi < 350 THEN 25.0 WHEN chi < 600 THEN 15.0 ELSE 0.0 END + CASE WHEN e.n < 128 THEN 0.0 WHEN error_pct < 5 THEN 15.0 WHEN error_pct < 10 THEN 8.0 ELSE 0.0 END + CASE WHEN e.n < 64 THEN 0.0 WHEN abs(corr) < 0.08 THEN 15.0 WHEN abs(corr) < 0.15 THEN 7.0 ELSE 0.0 END)::DOUBLE AS points
  FROM ent e JOIN chi USING (source, payload_id) JOIN pies USING (source, payload_id) JOIN corrs USING (source, payload_id))""", more=_H + _CHI + _PI + _CORR),
        "ngram_freq": _bytes(f"SELECT {keys}, gram, freq FROM gf", _HEX2, _grams(2)),
        "trigram_freq": _bytes(f"SELECT {keys}, gram, freq FROM gf", _HEX2, _grams(3)),
        "transition_matrix": _bytes(f"SELECT {keys}, b1, b2, p FROM tp", _HEX2, _MATRIX),
        "transition_entropy": _bytes("SELECT s.source, s.payload_id, coalesce(round_even(h, 4), 0.0) AS transition_entropy FROM sized s LEFT JOIN (SELECT source, payload_id, 0.0 - sum(r * 1.0 / t * e) AS h FROM (SELECT source, payload_id, b1, sum(c) AS r, sum(sum(c)) OVER (PARTITION BY source, payload_id) AS t, sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) AS e FROM tp GROUP BY source, payload_id, b1) GROUP BY source, payload_id) USING (source, payload_id)", _HEX2, _MATRIX),
        "kl_divergence": _bytes(kl("q"), _HEX2, f", base AS (SELECT * FROM (VALUES {logs}) AS t(b, q))"),
        "baseline_divergence": _bytes(kl("coalesce(q, 1e-6)"), _HEX2, ", base AS (SELECT i::INTEGER AS b, (1.0::DOUBLE / 95) AS q FROM range(32, 127) t(i))"),
        "top_bigrams": _bytes(f"SELECT {keys}, rank::INTEGER AS rank, gram, freq FROM (SELECT *, row_number() OVER (PARTITION BY source, payload_id ORDER BY freq DESC, first_pos) AS rank FROM gf) WHERE rank <= 8", _HEX2, _grams(2)),
        "simhash": _bytes("SELECT h.source, h.payload_id, lower(printf('%016x', coalesce(s, 0::UBIGINT))) AS simhash FROM hexed h LEFT JOIN sim USING (source, payload_id)", _HEX2, _SHINGLES + _SIM),
        "minhash": _bytes("SELECT h.source, h.payload_id, unnest(range(32))::INTEGER AS perm, unnest(coalesce(m, [0::BIGINT for _x in range(32)])) AS value FROM hexed h LEFT JOIN mn USING (source, payload_id)", _HEX2, _SHINGLES + _MIN32),
        "lsh_compare": _bytes("""SELECT source, payload_id, lower(printf('%016x', a)) AS simhash, lower(printf('%016x', b)) AS other_simhash, bit_count(xor(a, b))::INTEGER AS hamming_distance, round_even(greatest(0.0, 1 - bit_count(xor(a, b)) / 64.0), 4) AS simhash_similarity, round_even(len(list_filter(range(32), lambda i: ma[i + 1] = mb[i + 1])) / 32.0, 4) AS minhash_jaccard_similarity
FROM (SELECT x.source, x.payload_id, x.s AS a, y.s AS b, x.m AS ma, y.m AS mb FROM prints x JOIN prints y ON x.source = y.source AND y.payload_id = x.payload_id + 1)""", _HEX2.replace("FROM corpus", "FROM corpus WHERE source IN ('benchmark', 'fixtures')"), _SHINGLES + _SIM + _MIN32 + ", prints AS (SELECT h.source, h.payload_id, coalesce(s, 0::UBIGINT) AS s, coalesce(m, [0::BIGINT for _x in range(32)]) AS m FROM hexed h LEFT JOIN sim USING (source, payload_id) LEFT JOIN mn USING (source, payload_id))"),
        "threat_matches": f"{with_corpus}, {_SIGS}, {_FOUND} SELECT {keys}, sig, category, cwe, mitre, weight, matched_subpattern FROM matched",
        "threat_scores": f"{with_corpus}, {_SIGS}, {_FOUND}, {_CATS} SELECT {keys}, category, score FROM scores",
        "threat_primary": f"{_PRIMARY} SELECT {keys}, primary_threat, risk_score, severity FROM primary_of",
        "threat_summary": f"{_PRIMARY} SELECT source, primary_threat, severity, count(*) AS payloads, sum(risk_score)::BIGINT AS total_risk FROM primary_of GROUP BY ALL",
        "cwe_mappings": f"{with_corpus}, {_SIGS}, {_FOUND} SELECT c.source, c.payload_id, coalesce(cwe, '') AS cwe FROM corpus c LEFT JOIN (SELECT source, payload_id, array_to_string(list_sort(list_distinct(list(cwe))), ',') AS cwe FROM matched GROUP BY ALL) USING (source, payload_id)",
        "ast_matches": f"{with_corpus}, counted AS (SELECT source, payload_id, {_OBF} FROM corpus) " + " UNION ALL ".join(f"SELECT {keys}, {_text(n)} AS category, n{i} AS n FROM counted WHERE n{i} > 0" for i, (n, *_r) in enumerate(OBFUSCATIONS)),
        "ast_score": f"{with_corpus}, tech AS ({_TECH}) SELECT c.source, c.payload_id, least(100.0, coalesce(sum(weight), 0))::DOUBLE AS complexity_score, coalesce(sum(weight), 0) >= 25 AS obfuscation_detected, coalesce(string_agg(category, ',' ORDER BY category), '') AS evasion_techniques FROM corpus c LEFT JOIN tech USING (source, payload_id) GROUP BY c.source, c.payload_id",
        "zero_width": f"{with_corpus} SELECT {keys}, len(regexp_extract_all(payload, {_ZW}))::INTEGER AS zero_width, {_DENSE} AS dense_concatenation FROM corpus",
        "concat_collapse": f"{with_corpus} SELECT {keys}, regexp_replace(payload, '[''\"]\\s*\\+\\s*[''\"]', '', 'g') AS decoded FROM corpus",
        "local_origin": f"{with_corpus} SELECT {keys}, payload = '' OR regexp_full_match(payload, '(?i)https?://(?:[^/?#@]*@)?(?:localhost|127\\.0\\.0\\.1|\\[::1\\])(?::[^/?#]*)?(?:[/?#].*)?') AS is_local FROM corpus WHERE source IN ('urls', 'fixtures')",
        "polyglot_formats": f"{with_corpus}, {_HEXF}, {_LATIN}, {_MAGIC} SELECT {keys}, array_to_string(f, ',') AS formats FROM base",
        "embedded_scripts": f"{with_corpus}, {_HEXF}, {_LATIN}, {_MAGIC}{_found_scripts()} SELECT {keys}, (unnest(range(len(s))))::INTEGER AS n, unnest(s) AS script FROM poly",
        "polyglot_class": f"{with_corpus}, {_HEXF}, {_LATIN}, {_MAGIC}{_found_scripts()}{_LADDER} SELECT {keys}, k[1] AS polyglot_class, k[2]::DOUBLE AS risk_score, array_to_string(f, ',') AS formats FROM kinds",
        "shellcode_score": f"{with_corpus}, {_HEX2}, {_LATIN}{_code()} SELECT {keys}, {_VERDICT} FROM points",
        "nop_runs": f"{with_corpus}, {_HEX2}, runs AS (SELECT source, payload_id, list_max(list_transform(regexp_extract_all(array_to_string(list_transform(regexp_extract_all(h, '..'), lambda x: CASE x WHEN '90' THEN 'N' ELSE '.' END), ''), 'N{{8,}}'), lambda x: length(x))) AS longest_run FROM hexed) SELECT {keys}, longest_run::INTEGER AS longest_run FROM runs WHERE longest_run IS NOT NULL",
    }
    out["polyglot_report"] = f"{with_corpus}, {_HEXF}, {_LATIN}, {_MAGIC}{_found_scripts()}{_LADDER} SELECT {keys}, {reports.polyglot_columns()} FROM kinds".replace("poly AS (SELECT source, payload_id, t,", "poly AS (SELECT source, payload_id, t, zipped,")
    out["shellcode_report"] = f"{with_corpus}, {_HEX2}, {_LATIN}{_code()} SELECT {keys}, {_VERDICT}, CASE WHEN n > 0 THEN score >= 0.5 END AS is_shellcode_likely, {reports.code_indicators()} AS indicators FROM points"
    out["ast_report"] = f"{with_corpus}, tech AS ({_TECH}), found AS (SELECT c.source, c.payload_id, c.payload, coalesce(sum(weight), 0) AS w, coalesce(list(category ORDER BY category) FILTER (WHERE category IS NOT NULL), []) AS t FROM corpus c LEFT JOIN tech USING (source, payload_id) GROUP BY c.source, c.payload_id, c.payload), hinted AS (SELECT *, {reports.HINT_LIST} AS hints FROM found) SELECT {keys}, w >= 25 AS obfuscation_detected, least(100.0, w)::DOUBLE AS complexity_score, array_to_string(t, chr(10)) AS evasion_techniques, {reports.constructs(_ZW)} AS detected_constructs, {reports.HINT_LINES} AS deobfuscation_hints FROM hinted"
    out["hex_decode"] = f"{with_corpus}, one AS (SELECT source, payload_id, {reports.replaced('payload', r'\\x[0-9a-fA-F]{2}', reports.ESCAPED)} AS p FROM corpus) SELECT {keys}, {reports.replaced('p', r'\\u[0-9a-fA-F]{4}', reports.ESCAPED)} AS decoded FROM one"
    out["base64_decode"] = f"{with_corpus} SELECT {keys}, {reports.replaced('payload', decode.BASE64, reports.DECODED_BLOCK)} AS decoded FROM corpus"
    out["url_decode"] = f"{with_corpus} SELECT {keys}, url_decode(payload) AS decoded FROM corpus"
    out["safe_path"] = f"{with_corpus}, cut AS (SELECT source, payload_id, list_filter(string_split(replace(url_decode(payload), chr(92), '/'), '/'), lambda x: x NOT IN ('', '.')) AS p FROM corpus WHERE source IN ('urls', 'fixtures')) SELECT {keys}, CASE WHEN list_contains(p, '..') OR contains(coalesce(p[1], ''), ':') THEN '' ELSE array_to_string(p, '/') END AS safe_path FROM cut"
    place = "CASE source " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(CLUSTERED)) + " END"
    out["cluster_payloads"] = "WITH RECURSIVE " + _bytes(f"""SELECT idx, dense_rank() OVER (ORDER BY leader) AS cluster_id, leader, lower(printf('%016x', s)) AS simhash
FROM prints JOIN (SELECT f.s, l.first AS leader FROM go JOIN firsts f USING (k) JOIN firsts l ON l.s = go.leader) USING (s)""", _HEX2, _SHINGLES + _SIM + f""", prints AS MATERIALIZED (SELECT {place} * 1000000000000 + h.payload_id AS idx, coalesce(s, 0::UBIGINT) AS s FROM hexed h LEFT JOIN sim USING (source, payload_id)),
firsts AS MATERIALIZED (SELECT s, min(idx) AS first, row_number() OVER (ORDER BY min(idx)) AS k FROM prints GROUP BY s),
go AS (SELECT 0::BIGINT AS k, []::UBIGINT[] AS led, NULL::UBIGINT AS leader UNION ALL SELECT k, CASE WHEN hit IS NULL THEN list_append(led, s) ELSE led END, coalesce(hit, s)
  FROM (SELECT f.k, f.s, led, list_filter(led, lambda x: bit_count(xor(x, f.s)) <= {fingerprints.largest_distance(0.85)})[1] AS hit FROM go JOIN firsts f ON f.k = go.k + 1))""").removeprefix("WITH ")
    wins = """, dims AS (SELECT source, payload_id, n, CASE WHEN n >= 8 AND n < 32 THEN greatest(4, n // 3) ELSE 32 END AS win, CASE WHEN n >= 8 AND n < 32 THEN greatest(1, n // 10) ELSE 8 END AS step FROM sized),
wins AS (SELECT source, payload_id, unnest(range(0, n - win + 1, step))::INTEGER AS offs, win::INTEGER AS win FROM dims WHERE n >= win)"""
    head = _bytes("").rstrip().replace("bytes AS (SELECT source, payload_id, pos, b FROM pairs", "bytes AS (SELECT source, payload_id, pos, pos // 32 AS blk, b FROM pairs")
    out["sliding_entropy"] = head + wins + ", spread AS (SELECT source, payload_id, offs, win, unnest(CASE WHEN offs // 32 = (offs + win - 1) // 32 THEN [offs // 32] ELSE [offs // 32, offs // 32 + 1] END) AS blk FROM wins)\nSELECT source, payload_id, offs AS \"offset\", win AS window_size, round_even(h, 3) AS entropy, h >= 6.5 AS is_spike FROM (SELECT source, payload_id, offs, win, 0.0 - sum(c * 1.0 / win * log2(c * 1.0 / win)) AS h FROM (SELECT w.source, w.payload_id, offs, win, b, count(*) AS c FROM spread w JOIN bytes y ON y.source = w.source AND y.payload_id = w.payload_id AND y.blk = w.blk WHERE y.pos BETWEEN w.offs AND w.offs + w.win - 1 GROUP BY ALL) GROUP BY ALL)"
    body = lambda name: out[name]
    tables = lambda name: f"(SELECT * FROM ({body(name)}))"
    out["entropy_profile"] = f"""SELECT e.source, e.payload_id, e.total_bytes, e.entropy AS shannon_entropy, k.classification, k.is_suspicious AS is_suspicious_entropy, printable_pct, whitespace_pct, control_pct, high_bit_pct, special_pct, coalesce(windows, 0)::BIGINT AS windows, coalesce(spikes, 0)::BIGINT AS spikes, coalesce(milli, 0)::BIGINT AS window_milli,
  array_to_string(list_transform(range(256), lambda i: coalesce(d[i], 0)), ',') AS byte_distribution, coalesce(top, '') AS byte_frequencies
FROM {tables("byte_entropy")} e JOIN {tables("entropy_class")} k USING (source, payload_id) JOIN {tables("char_classes")} c USING (source, payload_id)
LEFT JOIN (SELECT source, payload_id, map_from_entries(list((b::BIGINT, n))) AS d FROM {tables("byte_histogram")} GROUP BY ALL) USING (source, payload_id)
LEFT JOIN (SELECT source, payload_id, string_agg(rank || ':' || b || ':' || n, ',' ORDER BY rank) AS top FROM {tables("top_bytes")} GROUP BY ALL) USING (source, payload_id)
LEFT JOIN (SELECT source, payload_id, count(*) AS windows, count(*) FILTER (WHERE is_spike) AS spikes, sum(round(entropy * 1000)::BIGINT) AS milli FROM {tables("sliding_entropy")} GROUP BY ALL) USING (source, payload_id)"""
    out["markov_profile"] = f"""SELECT s.source, s.payload_id, z.n AS payload_length, transition_entropy, kl_divergence, simhash, ('0x' || simhash)::UBIGINT::VARCHAR AS simhash_int, m AS minhash_signature, transition_entropy > 5.5 OR kl_divergence > 4.5 AS is_anomalous_markov, coalesce(top, '') AS top_bigrams, c.score AS shellcode_score, c.is_probable_shellcode, c.indicators AS shellcode_indicators
FROM {tables("simhash")} s JOIN {tables("transition_entropy")} t USING (source, payload_id) JOIN {tables("kl_divergence")} k USING (source, payload_id) JOIN {tables("shellcode_report")} c USING (source, payload_id)
JOIN (SELECT source, payload_id, string_agg(value, ',' ORDER BY perm) AS m FROM {tables("minhash")} GROUP BY ALL) USING (source, payload_id)
JOIN ({_bytes(f"SELECT {keys}, n FROM sized", _HEX2)}) z USING (source, payload_id)
LEFT JOIN (SELECT source, payload_id, string_agg(gram || '=' || round(freq * 100000)::BIGINT, ',' ORDER BY rank) AS top FROM {tables("top_bigrams")} GROUP BY ALL) USING (source, payload_id)"""
    return {name: _rounded(sql) for name, sql in out.items()}


def _rounded(sql: str) -> str:
    """round_even(x, k) as the decimal nearest to x: by printf, since x * 10**k may round before it's rounded."""
    while (at := sql.find("round_even(")) >= 0:
        depth, end = 0, at + len("round_even")
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if not depth:
                break
        inner, _, digits = sql[at + len("round_even(") : end - 1].rpartition(",")
        sql = f"{sql[:at]}(printf('%.{digits.strip()}f', ({inner})::DOUBLE)::DOUBLE + 0.0){sql[end:]}"
    return sql


