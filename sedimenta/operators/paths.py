"""Request predicates: local origins and safe relative paths, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.rowwise import KEYS


def local_origin(c: Column) -> Column:
    """No origin, or http(s) to this machine."""
    pattern = r"(?i)^https?://(?:[^/?#@]*@)?(?:localhost|127\.0\.0\.1|\[::1\])(?::[^/?#]*)?(?:[/?#].*)?$"
    return c.isNull() | (c == "") | c.rlike(pattern)


def safe_path(c: Column) -> Column:
    """A relative path without . parts; empty if a part is .. or the first holds a colon."""
    plain = F.replace(F.coalesce(F.try_url_decode(F.regexp_replace(F.regexp_replace(c, r"\+", "%2B"), r"%(?![0-9a-fA-F]{2})", "%25")), c), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(plain, "/"), lambda x: ~x.isin("", "."))
    bad = F.array_contains(parts, "..") | F.coalesce(F.contains(F.get(parts, F.lit(0)), F.lit(":")), F.lit(False))
    return F.when(bad, "").otherwise(F.array_join(parts, "/"))


def local_origins(df: DataFrame) -> DataFrame:
    return df.where("source in ('urls', 'fixtures')").select(*KEYS, local_origin(F.col("payload")).alias("is_local"))


def safe_paths(df: DataFrame) -> DataFrame:
    return df.where("source in ('urls', 'fixtures')").select(*KEYS, safe_path(F.col("payload")).alias("safe_path"))
