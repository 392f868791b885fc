"""Operators as SQL functions, a table function of byte windows, and reports as views."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from sedimenta.operators import bytestats, decode, fingerprints, markov, ngrams, polyglot, rules, shellcode, structure, threats
from sedimenta.session import ship


def _bytes(x: object) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


def _mapped(kind: str, make):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else make(x))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pandas_udf(run, kind)


class ByteWindows:
    """offset, window_size, entropy and is_spike of each window of a payload."""

    def eval(self, payload: str, window: int, step: int):
        if payload is not None:
            for w in bytestats.windows_of(payload.encode(), window, step):
                yield w["offset"], w["window_size"], w["entropy"], w["is_spike"]


FUNCTIONS = {
    "shannon_entropy": ("double", lambda x: bytestats.entropy_of(bytestats.counts_of(_bytes(x)))),
    "chi_square": ("double", lambda x: bytestats.chi_square_of(bytestats.counts_of(_bytes(x)))),
    "serial_correlation": ("double", lambda x: bytestats.correlation_of(_bytes(x))),
    "transition_entropy": ("double", lambda x: ngrams.transition_entropy_of(_bytes(x))),
    "kl_divergence": ("double", lambda x: ngrams.divergence_of(_bytes(x))),
    "simhash_hex": ("string", lambda x: f"{fingerprints.simhash_of(_bytes(x)):016x}"),
    "minhash_signature": ("array<long>", lambda x: fingerprints.minhash_of(_bytes(x))),
    "decode_layers": ("string", lambda x: decode.decode_layers(x)[0]),
    "html_unescape": ("string", lambda x: decode._entities(x)),
    "monte_carlo_pi": ("double", lambda x: bytestats.pi_of(_bytes(x))[0]),
    "entropy_class": ("string", lambda h: bytestats.class_of(h)),
    "char_classes": ("array<double>", lambda x: bytestats.classes_of(bytestats.counts_of(_bytes(x)))),
    "byte_ngrams": ("array<string>", lambda x: [gram for gram, *_ in ngrams.grams_of(_bytes(x))]),
    "url_decode_layer": ("string", lambda x: decode._url(x)),
    "hex_decode_layer": ("string", lambda x: decode._escapes(x)),
    "concat_collapse": ("string", lambda x: decode._joined(x)),
    "base64_decode_layer": ("string", lambda x: decode._base64(x)),
}

#: SQL bodies of functions that need no Python.
EXPRESSIONS = {
    "hamming_hex": ("a STRING, b STRING", "INT", "bit_count(cast(conv(a, 16, -10) AS BIGINT) ^ cast(conv(b, 16, -10) AS BIGINT))"),
    "simhash_similarity": ("a STRING, b STRING", "DOUBLE", "1 - bit_count(cast(conv(a, 16, -10) AS BIGINT) ^ cast(conv(b, 16, -10) AS BIGINT)) / 64D"),
    "minhash_similarity": ("a ARRAY<BIGINT>, b ARRAY<BIGINT>", "DOUBLE", "CASE WHEN size(a) = size(b) AND size(a) > 0 THEN aggregate(zip_with(a, b, (x, y) -> IF(x = y, 1, 0)), 0, (s, e) -> s + e) / cast(size(a) AS DOUBLE) WHEN a IS NOT NULL AND b IS NOT NULL THEN 0D END"),
    "threat_severity": ("risk DOUBLE", "STRING", "CASE WHEN risk >= 70 THEN 'CRITICAL' WHEN risk >= 45 THEN 'HIGH' WHEN risk >= 25 THEN 'MEDIUM' WHEN risk > 0 THEN 'LOW' WHEN risk <= 0 THEN 'INFO' END"),
}

#: Reports by the name of their view.
REPORTS = {
    "threat_report": threats.threat_report, "waf_rules": rules.waf_rules, "deobfuscated": decode.deobfuscate, "entropy_profile": bytestats.entropy_profile, "randomness": bytestats.randomness_report, "compression": bytestats.compression_ratio,
    "polyglot": polyglot.polyglot_report, "obfuscation": structure.obfuscation_report, "shellcode": shellcode.report, "markov_profile": markov.profile, "simhash": fingerprints.simhash, "minhash": fingerprints.minhash, "ngrams": ngrams.ngram_frequencies,
}


def register_reports(spark: SparkSession, rows: DataFrame, prefix: str) -> list[str]:
    """Make every report over rows (source, payload_id, payload) a temporary view, prefix_name, and return their names.

    A view is a plan: nothing runs before it is queried. Null payloads have no row in any of them.
    """
    ship(spark)
    rows = rows.where("payload is not null")
    for name, make in REPORTS.items():
        make(rows).createOrReplaceTempView(f"{prefix}_{name}")
    return [f"{prefix}_{name}" for name in REPORTS]


def register(spark: SparkSession) -> None:
    """Make FUNCTIONS, EXPRESSIONS and byte_windows callable from SQL. Null arguments give null, or no windows."""
    ship(spark)
    for name, (kind, make) in FUNCTIONS.items():
        spark.udf.register(name, _mapped(kind, make))
    spark.udtf.register("byte_windows", udtf(ByteWindows, returnType="`offset` int, window_size int, entropy double, is_spike boolean"))
    for name, (arguments, kind, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
