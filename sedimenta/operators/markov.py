"""The combined n-gram, transition and fingerprint profile of a payload."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.coerce import hex_aware
from sedimenta.operators import fingerprints, ngrams, shellcode
from sedimenta.operators.rowwise import KEYS, made_of

FIELDS = "payload_length long, transition_entropy double, kl_divergence double, simhash string, simhash_int decimal(20,0), minhash_signature array<long>, is_anomalous_markov boolean, top_bigrams array<struct<gram:string,freq:double>>"


def _made(raw: bytes) -> tuple:
    h, kl, sim = ngrams.transition_entropy_of(raw), ngrams.divergence_of(raw), fingerprints.simhash_of(raw)
    return len(raw), h, kl, f"{sim:016x}", Decimal(sim), fingerprints.minhash_of(raw, 32), h > 5.5 or kl > 4.5, [{"gram": g, "freq": f} for g, f in ngrams.top_of(raw)]


def profile(df: DataFrame) -> DataFrame:
    """Every field of the profile, with the machine-code verdict of the same bytes."""
    raw = hex_aware(F.col("payload"))
    rows = df.where("payload is not null").select(*KEYS, "payload", raw.alias("raw"))
    rows = rows.select(*KEYS, "payload", "raw", made_of(F.col("raw"), FIELDS, _made).alias("made")).select(*KEYS, "payload", "raw", "made.*")
    names = tuple(c for c in rows.columns if c not in ("raw", "payload"))
    verdict = shellcode.report(rows, F.col("raw"), names)
    return verdict.select(*names, F.col("score").alias("shellcode_score"), "is_probable_shellcode", F.col("indicators").alias("shellcode_indicators"))
