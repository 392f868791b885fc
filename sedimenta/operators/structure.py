"""Script obfuscation: ten patterns with their first three places, zero-width characters, density of plus signs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.coerce import fold_case, holds, java
from sedimenta.functions.fixed import EMPTY_HINT, HINTS, NO_HINT, OBFUSCATIONS, PLUS_DENSITY, ZERO_WIDTH
from sedimenta.operators.rowwise import KEYS


#: For each pattern, strings of which a match holds one.
GUARDS = (("atob", "buffer.from", "string.fromcharcode", "unescape", "decodeuricomponent"), ("[",), ("+",), ("$",), ("''", '""', "\\"), ("\\",), ("`", "iex", "invoke-expression", "frombase64string"), ("0x", "2130706433", "0"), ("/*",), ("_0x", "["))


def _rows(df: DataFrame) -> DataFrame:
    return df.where("payload is not null").select(*KEYS, "payload", fold_case(F.col("payload")).alias("low"))


def guarded(c: Column, i: int) -> Column:
    """Whether pattern i is worth a try on c; the folded text is the column low."""
    found = holds(F.col("low"), GUARDS[i])
    return found & c.rlike("0[xX]|0[0-7]{10}|2130706433") if i == 7 else found


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(java(pattern)), F.lit(0))


def first_matches(c: Column, pattern: str, most: int = 3) -> Column:
    """(matched_text, start, end) of the first matches, places in characters: lengths of the parts between, summed."""
    found = F.slice(matches(c, pattern), 1, most)
    parts = F.transform(F.split(c, java(pattern), most + 1), lambda x: F.length(x))
    start = F.aggregate(
        F.arrays_zip(F.slice(parts, 1, most).alias("gap"), found.alias("text")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<matched_text:string,start:int,end:int>>").alias("out")),
        lambda s, x: F.struct(
            (s["at"] + x["gap"] + F.coalesce(F.length(x["text"]), F.lit(0))).alias("at"),
            F.when(x["text"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(x["text"].alias("matched_text"), (s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + F.length(x["text"])).alias("end"))))).alias("out"),
        ),
    )
    return start["out"]


def zero_width_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(ZERO_WIDTH[1]))


def dense(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit("+"), F.lit(""))) >= PLUS_DENSITY[1]) & (F.length(c) < PLUS_DENSITY[2])


def techniques(c: Column) -> Column:
    """(category, weight) of what is found, by category."""
    each = [F.when(guarded(c, i) & c.rlike(java(p)), F.struct(F.lit(n).alias("category"), F.lit(w).alias("weight"))) for i, (n, p, w, _) in enumerate(OBFUSCATIONS)]
    each.append(F.when(zero_width_count(c) > 0, F.struct(F.lit(ZERO_WIDTH[0]).alias("category"), F.lit(ZERO_WIDTH[2]).alias("weight"))))
    each.append(F.when(dense(c), F.struct(F.lit(PLUS_DENSITY[0]).alias("category"), F.lit(PLUS_DENSITY[3]).alias("weight"))))
    return F.array_sort(F.filter(F.array(*each), lambda x: x.isNotNull()))


def obfuscation_matches(df: DataFrame) -> DataFrame:
    """Number of matches of each pattern that a payload has."""
    each = F.array(*[F.struct(F.lit(n).alias("category"), F.when(guarded(F.col("payload"), i), F.size(matches(F.col("payload"), p))).otherwise(0).alias("n")) for i, (n, p, _, _) in enumerate(OBFUSCATIONS)])
    return _rows(df).select(*KEYS, F.inline_outer(F.filter(each, lambda x: x["n"] > 0))).where("n is not null")


def score(found: Column) -> Column:
    return F.least(F.lit(100.0), F.aggregate(found, F.lit(0), lambda s, x: s + x["weight"]).cast("double"))


def obfuscation_score(df: DataFrame) -> DataFrame:
    rows = _rows(df).select(*KEYS, techniques(F.col("payload")).alias("t"))
    return rows.select(*KEYS, score(F.col("t")).alias("complexity_score"), (score(F.col("t")) >= 25).alias("obfuscation_detected"), F.array_join(F.transform("t", lambda x: x["category"]), ",").alias("evasion_techniques"))


def zero_width(df: DataFrame) -> DataFrame:
    return df.where("payload is not null").select(*KEYS, zero_width_count(F.col("payload")).cast("int").alias("zero_width"), dense(F.col("payload")).alias("dense_concatenation"))


def _constructs(found: Column, name: str, description: str, weight: int) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(name).alias("category"), m["matched_text"].alias("matched_text"), m["start"].alias("start"), m["end"].alias("end"), F.lit(description).alias("description"), F.lit(weight).alias("weight")))


def obfuscation_report(df: DataFrame) -> DataFrame:
    c = F.col("payload")
    rows = _rows(df).select(*KEYS, "payload", "low", techniques(c).alias("t"))
    constructs = []
    for i, (name, pattern, weight, description) in enumerate(OBFUSCATIONS):
        found = F.when(guarded(c, i) & c.rlike(java(pattern)), first_matches(c, pattern)).otherwise(F.array().cast("array<struct<matched_text:string,start:int,end:int>>"))
        constructs.append(_constructs(found, name, description, weight))
    n = zero_width_count(c)
    first = F.lower(F.lpad(F.hex(F.encode(F.regexp_extract(c, ZERO_WIDTH[1], 0), "UTF-16BE")), 4, "0"))
    hidden = F.struct(F.lit(ZERO_WIDTH[0]).alias("category"), F.concat(F.lit("Found "), n.cast("string"), F.lit(" zero-width characters (e.g. \\u"), first, F.lit(")")).alias("matched_text"), F.lit(0).alias("start"), F.length(c).alias("end"), F.lit(ZERO_WIDTH[3]).alias("description"), F.lit(ZERO_WIDTH[2]).alias("weight"))
    constructs.append(F.when(n > 0, F.array(hidden)).otherwise(F.array().cast("array<struct<category:string,matched_text:string,start:int,end:int,description:string,weight:int>>")))
    names = F.transform("t", lambda x: x["category"])
    hints = F.filter(F.array(*[F.when(F.arrays_overlap(names, F.array(*map(F.lit, some))), F.lit(text)) for some, text in HINTS]), lambda x: x.isNotNull())
    hints = F.when(c == "", F.array(F.lit(EMPTY_HINT))).when(F.size(hints) == 0, F.array(F.lit(NO_HINT))).otherwise(hints)
    return rows.select(*KEYS, (score(F.col("t")) >= 25).alias("obfuscation_detected"), score(F.col("t")).alias("complexity_score"), names.alias("evasion_techniques"), F.concat(*constructs).alias("detected_constructs"), hints.alias("deobfuscation_hints"))
