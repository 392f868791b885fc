"""Signature matching, scores and severity: each signature is a literal pattern in one projection, so nothing is joined.

Texts are searched raw, or decoded first and raw where that finds nothing, if there is a decoded column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.coerce import fold_case, holds, java, rounded
from sedimenta.functions.fixed import SIGNATURES
from sedimenta.operators import bytestats, decode
from sedimenta.operators.rowwise import KEYS, made_of

CATEGORIES = tuple(dict.fromkeys(s[0] for s in SIGNATURES))


#: For each signature, strings of which a match holds one: a pattern is only tried on texts that hold one.
GUARDS = (
    ("union", "select", "insert", "update", "delete", "drop", "alter"), ("sleep", "benchmark", "waitfor"), ("'", "1=1"), ("<script", "javascript:", "vbscript:"),
    ("onerror", "onload", "onmouseover", "onclick", "onfocus", "onblur", "ontoggle", "onanimationstart"), ("document.", "window.location", "eval", "function", "alert", "prompt", "confirm"), (";", "|"), ("`", "$("), ("/bin/", "cmd.exe", "powershell"),
    ("../", "..\\", "%2e%2e%2f", "%252e"), ("/etc/", "win.ini", "php://", "file://"), ("{{", "${", "<%=", "[["), ("://127.", "://localhost", "://0.0", "://169.", "://metadata", "://10.", "://192."), ("<!entity", "system"), ("__proto__", "prototype"),
)


def snippet(c: Column, folded: Column, i: int) -> Column:
    """The first match of signature i, null if none."""
    return F.when(holds(folded, GUARDS[i]), F.nullif(F.regexp_extract(c, java(SIGNATURES[i][1]), 0), F.lit("")))


def matched_rules(raw: Column, normalized: Column | None = None, folded_raw: Column | None = None, folded_normalized: Column | None = None) -> Column:
    """An array of the rules that match, in order of the signatures; the folded texts may be given as columns."""
    rules, low = [], fold_case(raw) if folded_raw is None else folded_raw
    if normalized is not None:
        low_normalized = fold_case(normalized) if folded_normalized is None else folded_normalized
    for i, (category, _, weight, cwe, mitre, description) in enumerate(SIGNATURES, 1):
        found = snippet(raw, low, i - 1) if normalized is None else F.coalesce(snippet(normalized, low_normalized, i - 1), F.when(raw != normalized, snippet(raw, low, i - 1)))
        rules.append(F.struct(F.lit(i).alias("sig"), F.lit(category).alias("category"), F.lit(cwe).alias("cwe"), F.lit(mitre).alias("mitre"), F.lit(weight).alias("weight"), F.lit(description).alias("description"), found.alias("matched_subpattern")))
    return F.filter(F.array(*rules), lambda r: r["matched_subpattern"].isNotNull())


def with_rules(df: DataFrame) -> DataFrame:
    """source, payload_id and the rules that the raw payload matches."""
    rows = df.where(F.col("payload").isNotNull()).select(*KEYS, "payload", fold_case(F.col("payload")).alias("low"))
    return rows.select(*KEYS, matched_rules(F.col("payload"), folded_raw=F.col("low")).alias("rules"))


def threat_matches(df: DataFrame) -> DataFrame:
    # outer, since from inner ones Spark infers a filter that it pushes down and that matches every pattern again
    return with_rules(df).select(*KEYS, F.inline_outer("rules")).where("sig is not null")


def category_scores(rules: Column) -> Column:
    """Categories with a score above 0 as (score, order, category), best first, earlier signatures before equals."""
    def total(category: str) -> Column:
        return F.aggregate(F.filter(rules, lambda r: r["category"] == category), F.lit(0), lambda s, r: s + r["weight"])

    each = [F.struct((-total(c)).alias("minus"), F.lit(i).alias("place"), F.lit(c).alias("category")) for i, c in enumerate(CATEGORIES)]
    return F.array_sort(F.filter(F.array(*each), lambda x: x["minus"] < 0))


def threat_scores(df: DataFrame) -> DataFrame:
    scored = with_rules(df).select(*KEYS, F.explode_outer(category_scores(F.col("rules"))).alias("x")).where("x is not null")
    return scored.select(*KEYS, F.col("x.category").alias("category"), (-F.col("x.minus")).alias("score"))


def severity(risk: Column) -> Column:
    return F.when(risk >= 70, "CRITICAL").when(risk >= 45, "HIGH").when(risk >= 25, "MEDIUM").when(risk > 0, "LOW").otherwise("INFO")


def assessed(df: DataFrame, normalized: bool = True) -> DataFrame:
    """Every column of a threat report; with normalized, payloads are decoded first."""
    rows = df.where(F.col("payload").isNotNull())
    h = made_of(F.col("payload").cast("binary"), "h double", lambda r: (bytestats.entropy_of(bytestats.counts_of(r)),))["h"].alias("h")
    rows = rows.select(*KEYS, F.col("payload").alias("raw_payload"), h, *([made_of(F.col("payload"), decode.DECODED, decode.decoded_of).alias("d")] if normalized else []))
    if normalized:
        rows = rows.select(*KEYS, "raw_payload", "h", "d.*")
        rows = rows.select("*", fold_case(F.col("raw_payload")).alias("low"), fold_case(F.col("normalized_payload")).alias("low_normalized"))
        rules = matched_rules(F.col("raw_payload"), F.col("normalized_payload"), F.col("low"), F.col("low_normalized"))
        extra = F.when(F.col("total_layers_unwrapped") > 1, 15).otherwise(0)
    else:
        rows = rows.withColumn("low", fold_case(F.col("raw_payload")))
        rules, extra = matched_rules(F.col("raw_payload"), folded_raw=F.col("low")), F.lit(0)
    rows = rows.withColumn("matched_rules", rules).withColumn("scores", category_scores(F.col("matched_rules")))
    suspicious = F.col("h") >= 5.6
    base = F.aggregate("matched_rules", F.lit(0), lambda s, r: s + r["weight"])
    risk = F.least(F.lit(100), base + F.when(suspicious, 25).otherwise(0) + extra)
    none = F.when(suspicious, "HIGH_ENTROPY_SUSPICIOUS_PAYLOAD").otherwise("BENIGN_OR_UNCLASSIFIED")
    rows = rows.withColumn("risk_score", risk).withColumn("severity", severity(F.col("risk_score")))
    return rows.select(
        "*",
        F.coalesce(F.get("scores", F.lit(0))["category"], none).alias("primary_threat"),
        F.transform(F.slice("scores", 2, len(CATEGORIES)), lambda x: x["category"]).alias("secondary_threats"),
        F.array_sort(F.array_distinct(F.transform("matched_rules", lambda r: r["cwe"]))).alias("cwe_mappings"),
        F.array_sort(F.array_distinct(F.transform("matched_rules", lambda r: r["mitre"]))).alias("mitre_attack_mappings"),
    ).drop("scores", "low", "low_normalized")


def threat_primary(df: DataFrame) -> DataFrame:
    """Primary threat, risk and severity of raw payloads."""
    return assessed(df, normalized=False).select(*KEYS, "primary_threat", "risk_score", "severity")


def cwe_mappings(df: DataFrame) -> DataFrame:
    found = with_rules(df).select(*KEYS, F.array_sort(F.array_distinct(F.transform("rules", lambda r: r["cwe"]))).alias("c"))
    return found.select(*KEYS, F.array_join("c", ",").alias("cwe"))


def threat_report(df: DataFrame) -> DataFrame:
    report = assessed(df)
    return report.select(*KEYS, "raw_payload", "normalized_payload", "primary_threat", "secondary_threats", "severity", "risk_score", "matched_rules", "cwe_mappings", "mitre_attack_mappings", rounded(F.col("h"), 4).alias("shannon_entropy"), "total_layers_unwrapped", "transforms_applied", "steps")


def threat_summary(df: DataFrame) -> DataFrame:
    """Payloads by source, primary threat and severity."""
    return threat_primary(df).groupBy("source", "primary_threat", "severity").agg(F.count(F.lit(1)).alias("payloads"), F.sum("risk_score").cast("long").alias("total_risk"))


