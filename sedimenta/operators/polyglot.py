"""Files in more than one format: magic bytes, embedded scripts, and a ladder of classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.coerce import file_bytes, java, latin1
from sedimenta.functions.fixed import PHP, POLYGLOTS, SCRIPTS, SHEBANG, ZIP_ANOMALY
from sedimenta.operators.rowwise import KEYS

ZIP = "PK\x03\x04"


def formats(t: Column) -> Column:
    """Formats of bytes (as Latin-1) by their magic numbers, in order."""
    head = F.lower(F.substring(t, 1, 512))
    mark = lambda name, test: F.when(test, F.lit(name))
    each = [
        mark("GIF", t.startswith("GIF87a") | t.startswith("GIF89a")), mark("PNG", t.startswith("\x89PNG\r\n\x1a\n")), mark("JPEG", t.startswith("\xff\xd8\xff")), mark("PDF", t.startswith("%PDF-")),
        mark("ZIP", t.startswith(ZIP) | (t.contains(ZIP) & t.contains("PK\x05\x06"))), mark("ELF", t.startswith("\x7fELF")), mark("PE_EXE", t.startswith("MZ")),
        F.when(head.contains("<svg"), "SVG").when(head.contains("<?xml"), "XML").when(head.contains("<!doctype html") | head.contains("<html"), "HTML"),
    ]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def _scripts(t: Column, some: tuple[tuple[str, str], ...]) -> Column:
    each = []
    for name, pattern in some:
        found = F.regexp_extract(t, java(pattern), 0)
        each.append(F.when(found != "", F.concat(F.lit(f"{name}: '"), F.substring(found, 1, 60), F.lit("'"))))
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def with_formats(df: DataFrame) -> DataFrame:
    """t (Latin-1 text), base (formats by magic), formats (all) and scripts of every payload."""
    rows = df.where("payload is not null").select(*KEYS, latin1(file_bytes(F.col("payload"))).alias("t"))
    t = F.col("t")
    rows = rows.select("*", formats(t).alias("base"), _scripts(t, SCRIPTS).alias("js"), _scripts(t, PHP).alias("php"), (t.contains("#!/bin/sh") | t.contains("#!/bin/bash")).alias("shebang"))
    image = F.arrays_overlap("base", F.array(F.lit("GIF"), F.lit("JPEG"), F.lit("PNG"))) & F.substring(t, 17, 2**31 - 1).contains(ZIP)
    one = lambda test, x: F.when(test, F.array(F.lit(x))).otherwise(F.array().cast("array<string>"))
    return rows.select(*KEYS, "t", "base", image.alias("zipped"), F.concat("base", one(F.size("php") > 0, "PHP"), one(F.col("shebang"), "SHELL_SCRIPT"), one(image, "ZIP")).alias("formats"), F.concat("js", "php", one(F.col("shebang"), SHEBANG)).alias("scripts"))


def polyglot_formats(df: DataFrame) -> DataFrame:
    return with_formats(df).select(*KEYS, F.array_join("base", ",").alias("formats"))


def embedded_scripts(df: DataFrame) -> DataFrame:
    return with_formats(df).select(*KEYS, F.posexplode_outer("scripts").alias("n", "script")).where("script is not null")


def polyglot_report(df: DataFrame) -> DataFrame:
    rows = with_formats(df)
    has = lambda x: F.array_contains("formats", x)
    t, some, first = F.col("t"), F.size("scripts") > 0, F.get("formats", F.lit(0))
    tests = {
        "gif": has("GIF") & F.exists("scripts", lambda s: s.contains("JS") | s.contains("script") | s.contains("/*")),
        "png": has("PNG") & has("PHP"), "pdf": has("PDF") & (t.contains("/JavaScript") | t.contains("/JS") | t.contains("/Launch")), "jpeg": has("JPEG") & has("ZIP"),
        "svg": has("SVG") & some, "hybrid": F.size("formats") >= 2, "embedded": some & (F.size("formats") == 1) & first.isin("GIF", "PNG", "JPEG", "PDF"),
    }
    kind = F.lit("none")
    for name, test in reversed(tests.items()):
        kind = F.when(test, F.lit(name)).otherwise(kind)
    rows = rows.withColumn("kind", kind)
    k = F.col("kind")
    pick = lambda at, last: F.coalesce(*[F.when(k == n, F.lit(v[at]) if v[at] is not None else last[n]) for n, v in POLYGLOTS.items()])
    hybrid = F.concat(F.lit("HYBRID_"), F.array_join(F.slice("formats", 1, 2), "_"), F.lit("_POLYGLOT"))
    name = pick(0, {"hybrid": hybrid, "embedded": F.concat(first, F.lit("_EMBEDDED_CODE_POLYGLOT"))})
    risk = F.when((k == "none") & some, 40.0).otherwise(pick(1, {}))
    listed = F.concat(F.lit("Payload satisfies multiple file format signatures simultaneously: ['"), F.array_join("formats", "', '"), F.lit("']"))
    anomaly = pick(2, {"hybrid": listed, "embedded": F.lit(None).cast("string"), "none": F.lit(None).cast("string")})
    anomalies = F.filter(F.array(F.when(F.col("zipped"), F.lit(ZIP_ANOMALY)), anomaly), lambda x: x.isNotNull())
    advice = F.coalesce(*[F.when(k == n, F.array(*map(F.lit, v[3]))) for n, v in POLYGLOTS.items()])
    return rows.select(*KEYS, (k != "none").alias("is_polyglot"), F.col("formats").alias("detected_formats"), name.alias("polyglot_class"), risk.alias("risk_score"), F.col("scripts").alias("embedded_scripts"), anomalies.alias("structural_anomalies"), advice.alias("mitigation_advice"))


def polyglot_class(df: DataFrame) -> DataFrame:
    return polyglot_report(df).select(*KEYS, "polyglot_class", "risk_score", F.array_join("detected_formats", ",").alias("formats"))
