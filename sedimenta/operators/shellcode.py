"""Machine-code heuristics over hex-aware bytes, as patterns on Latin-1 text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.coerce import hex_aware, latin1, rounded
from sedimenta.functions.fixed import CODE_BYTES
from sedimenta.operators.rowwise import KEYS


def _dialect(pattern: str) -> str:
    return "(?d)" + pattern


def nop_length(t: Column) -> Column:
    """Length of the longest run of 8 or more 0x90 bytes, null if none."""
    return F.array_max(F.transform(F.regexp_extract_all(t, F.lit("\\x90{8,}"), F.lit(0)), lambda x: F.length(x)))


def report(df: DataFrame, raw: Column | None = None, keep: tuple[str, ...] = KEYS) -> DataFrame:
    """score, verdicts, indicators and ratio; empty payloads have no ratio and no likely verdict."""
    rows = df.where("payload is not null").select(*keep, latin1(hex_aware(F.col("payload")) if raw is None else raw).alias("t"))
    t = F.col("t")
    rows = rows.select(*keep, "t", F.length("t").alias("n"), nop_length(t).alias("nops"), F.regexp_count(t, F.lit("[^\\x20-\\x7e]")).alias("odd"), *[t.rlike(_dialect(p)).alias(name) for name, _, p, _ in CODE_BYTES])
    ratio = F.col("odd") / F.col("n")
    is_dense = (F.col("n") >= 32) & (ratio > 0.45)
    points = F.when(F.col("nops").isNotNull(), F.least(F.lit(0.4), 0.1 + 0.05 * F.floor(F.col("nops") / 8))).otherwise(0.0)
    texts = [F.when(F.col("nops").isNotNull(), F.concat(F.lit("Standard x86 NOP sled (0x90 x "), F.col("nops").cast("string"), F.lit(")")))]
    for name, value, _, text in CODE_BYTES:
        points = points + F.when(F.col(name), value).otherwise(0.0)
        texts.append(F.when(F.col(name), F.lit(text)))
    points = points + F.when(is_dense, 0.2).otherwise(0.0)
    texts.append(F.when(is_dense, F.concat(F.lit("High non-printable byte density ("), F.format_string("%.1f%%", ratio * 100), F.lit(")"))))
    some = F.col("n") > 0
    score = F.when(some, rounded(F.least(F.lit(1.0), points), 4)).otherwise(0.0)
    rows = rows.withColumn("score", score)
    return rows.select(
        *keep, "score", (F.col("score") >= 0.5).alias("is_probable_shellcode"), F.when(some, F.col("score") >= 0.5).alias("is_shellcode_likely"), F.filter(F.array(*texts), lambda x: x.isNotNull()).alias("indicators"),
        (F.col("nops").isNotNull() | F.col("poly_nop")).alias("nop_sled_detected"), (F.col("call_pop") | F.col("fpu")).alias("getpc_detected"), (F.col("syscall") | F.col("int80") | F.col("sysenter")).alias("syscall_detected"), F.when(some, rounded(ratio, 4)).alias("non_printable_ratio"),
    )


def shellcode_score(df: DataFrame) -> DataFrame:
    return report(df).select(*KEYS, "score", "is_probable_shellcode", "nop_sled_detected", "getpc_detected", "syscall_detected", "non_printable_ratio")


def nop_runs(df: DataFrame) -> DataFrame:
    t = latin1(hex_aware(F.col("payload")))
    return df.where("payload is not null").select(*KEYS, nop_length(t).alias("longest_run")).where("longest_run is not null")
