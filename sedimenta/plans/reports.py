"""Reports in flat columns, so that engines can be compared, and the DuckDB expressions of their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.fixed import CODE_BYTES, EMPTY_HINT, HINTS, NO_HINT, OBFUSCATIONS, POLYGLOTS, ZERO_WIDTH, ZIP_ANOMALY
from sedimenta.operators import bytestats, markov, polyglot, shellcode, structure


def _joined(c: str) -> Column:
    """An array of strings as one string of lines."""
    return F.array_join(c, "\n").alias(c)


def entropy_profile(df: DataFrame) -> DataFrame:
    """The profile; windows by number, spikes and sum of thousandths. The compression ratio is a query of its own."""
    return bytestats.entropy_summary(df.where("payload is not null"))


def markov_profile(df: DataFrame) -> DataFrame:
    """The profile; frequencies of bigrams in hundred-thousandths."""
    grams = F.array_join(F.transform("top_bigrams", lambda x: F.concat_ws("=", x["gram"], F.round(x["freq"] * 100000).cast("long"))), ",")
    flat = {"simhash_int": F.col("simhash_int").cast("string"), "minhash_signature": F.array_join("minhash_signature", ","), "top_bigrams": grams, "shellcode_indicators": F.array_join("shellcode_indicators", "\n")}
    return markov.profile(df).withColumns(flat)


def ast_report(df: DataFrame) -> DataFrame:
    """The report; a construct is a line of its category, places, weight and text."""
    r = structure.obfuscation_report(df)
    lines = F.array_join(F.transform("detected_constructs", lambda x: F.concat_ws("|", x["category"], x["start"], x["end"], x["weight"], x["matched_text"])), "\n")
    return r.select("source", "payload_id", "obfuscation_detected", "complexity_score", _joined("evasion_techniques"), lines.alias("detected_constructs"), _joined("deobfuscation_hints"))


def polyglot_report(df: DataFrame) -> DataFrame:
    r = polyglot.polyglot_report(df)
    return r.select("source", "payload_id", "is_polyglot", _joined("detected_formats"), "polyglot_class", "risk_score", _joined("embedded_scripts"), _joined("structural_anomalies"), _joined("mitigation_advice"))


def shellcode_report(df: DataFrame) -> DataFrame:
    return shellcode.report(df).withColumn("indicators", F.array_join("indicators", "\n"))


# DuckDB


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _lines(items: list[str]) -> str:
    """A list of expressions, nulls left out, as one string of lines."""
    return f"array_to_string(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL), chr(10))"


def polyglot_columns() -> str:
    """The last columns of a polyglot report, from the class k, formats f, scripts s and zipped."""
    names = {v[0] or {"hybrid": "HYBRID_%", "embedded": "%_EMBEDDED_CODE_POLYGLOT"}[n]: (n, v) for n, v in POLYGLOTS.items()}
    listed = "'Payload satisfies multiple file format signatures simultaneously: [''' || array_to_string(f, ''', ''') || ''']'"

    def case(make) -> str:
        return "CASE " + " ".join(f"WHEN k[1] LIKE {text(like)} THEN {make(n, v)}" for like, (n, v) in names.items()) + " END"

    odd = case(lambda n, v: text(v[2]) if v[2] else listed if n == "hybrid" else "NULL")
    anomalies = _lines([f"CASE WHEN zipped THEN {text(ZIP_ANOMALY)} END", odd])
    return f"k[1] <> 'MONOLITHIC_PAYLOAD' AS is_polyglot, array_to_string(f, chr(10)) AS detected_formats, k[1] AS polyglot_class, k[2]::DOUBLE AS risk_score, array_to_string(s, chr(10)) AS embedded_scripts, {anomalies} AS structural_anomalies, {case(lambda n, v: text(chr(10).join(v[3])))} AS mitigation_advice"


def code_indicators() -> str:
    """Lines of what speaks for machine code, from the flags, n, nops and odd."""
    ratio = "odd * 1.0::DOUBLE / n"
    sled = "CASE WHEN nops IS NOT NULL THEN 'Standard x86 NOP sled (0x90 x ' || nops || ')' END"
    dense = f"CASE WHEN n >= 32 AND {ratio} > 0.45 THEN 'High non-printable byte density (' || printf('%.1f', {ratio} * 100) || '%)' END"
    return _lines([sled, *(f"CASE WHEN {n} THEN {text(t)} END" for n, _, _, t in CODE_BYTES), dense])


def constructs(zero_width: str) -> str:
    """Lines of the first three matches of each obfuscation in payload, and of its zero-width characters."""
    lists = []
    for name, p, weight, _ in OBFUSCATIONS:
        pattern = text("(?i)" + p)
        m, s = f"regexp_extract_all(payload, {pattern})", f"string_split_regex(payload, {pattern})"
        start = "(list_sum(list_transform(z.s[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(z.m[1:k - 1], lambda x: length(x))), 0))::INTEGER"
        line = f"{text(name + '|')} || {start} || '|' || ({start} + length(z.m[k])) || '|{weight}|' || z.m[k]"
        lists.append(f"CASE WHEN len({m}) > 0 THEN list_transform([{{'m': {m}, 's': {s}}}], lambda z: list_transform(range(1, least(3, len(z.m)) + 1), lambda k: {line}))[1] END")
    n = f"len(regexp_extract_all(payload, {zero_width}))"
    hidden = f"CASE WHEN {n} > 0 THEN ['{ZERO_WIDTH[0]}|0|' || length(payload) || '|{ZERO_WIDTH[2]}|Found ' || {n} || ' zero-width characters (e.g. \\u' || printf('%04x', unicode(regexp_extract(payload, {zero_width}))) || ')'] END"
    return "array_to_string(flatten(list_filter([" + ", ".join([*lists, hidden]) + "], lambda x: x IS NOT NULL)), chr(10))"


#: The hints of the techniques t, and what stands for none.
HINT_LIST = "list_filter([" + ", ".join(f"CASE WHEN list_has_any(t, [{', '.join(map(text, some))}]) THEN {text(hint)} END" for some, hint in HINTS) + "], lambda x: x IS NOT NULL)"
HINT_LINES = f"CASE WHEN payload = '' THEN {text(EMPTY_HINT)} WHEN len(hints) = 0 THEN {text(NO_HINT)} ELSE array_to_string(hints, chr(10)) END"


def replaced(column: str, pattern: str, made: str) -> str:
    """column with each match of pattern replaced by the expression made of z[2]."""
    p = text(pattern)
    return f"CASE WHEN regexp_matches({column}, {p}) THEN array_to_string(list_transform(list_zip(string_split_regex({column}, {p}), regexp_extract_all({column}, {p})), lambda z: z[1] || coalesce({made}, '')), '') ELSE {column} END"


ESCAPED = "chr(('0x' || substr(z[2], 3))::INTEGER)"
_BLOCK = "TRY(decode(from_base64(z[2])))"
_PRINTABLE = f"length(regexp_replace({_BLOCK}, {text(chr(91) + '^' + chr(92) + 'x20-' + chr(92) + 'x7e' + chr(92) + 'r' + chr(92) + 'n' + chr(92) + 't]')}, '', 'g'))"
DECODED_BLOCK = f"CASE WHEN {_PRINTABLE} * 1.0 / length({_BLOCK}) > 0.85 THEN {_BLOCK} ELSE z[2] END"
