"""Text to bytes, in the ways that operators read it, and pattern dialects."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain(c: Column) -> Column:
    """UTF-8."""
    return c.cast("binary")


def hex_aware(c: Column) -> Column:
    """Hex for text that begins with a \\x escape or is 16 or more hex digits in pairs, else UTF-8."""
    bare = F.regexp_replace(c, r"\\[xX]", "")
    tight = F.regexp_replace(bare, r"\s", "")
    escaped = c.rlike(r"^\\[xX]") & bare.rlike(r"^(?:\s*[0-9a-fA-F]{2})*\s*$")
    digits = (F.length(c) >= 16) & (F.length(c) % 2 == 0) & c.rlike(r"^[0-9a-fA-F]+$") & ~c.contains("\n")
    return F.when(escaped, F.unhex(tight)).when(digits, F.unhex(c)).otherwise(c.cast("binary"))


def file_bytes(c: Column) -> Column:
    """Hex for trimmed text that begins with \\x, UTF-8 else or where that isn't hex."""
    bare = F.replace(F.regexp_replace(c, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), F.lit("\\x"), F.lit(""))
    escaped = c.rlike(r"^[\s\x1c-\x1f]*\\x") & bare.rlike(r"^(?:\s*[0-9a-fA-F]{2})*\s*$")
    return F.when(escaped, F.unhex(F.regexp_replace(bare, r"\s", ""))).otherwise(c.cast("binary"))


def flagged_hex(c: Column, flag: Column) -> Column:
    """Hex with escapes and white space left out where the flag is set and it is hex; hex-aware otherwise."""
    bare = F.regexp_replace(c, r"\\[xX]|\s+", "")
    return F.when(flag & bare.rlike(r"^(?:[0-9a-fA-F]{2})*$"), F.unhex(bare)).otherwise(hex_aware(c))


def latin1(raw: Column) -> Column:
    """One character a byte."""
    return F.decode(raw, "ISO-8859-1")


def rounded(x: Column, digits: int) -> Column:
    """The decimal nearest to a double's exact value, ties to even; round() and bround() round its shortest form.

    format_number does so for all but what is under one unit of the last place, which is compared with half a unit.
    """
    x, unit, half = x.cast("double"), 10.0**-digits, float(f"5e-{digits + 1}")
    up = F.abs(x) >= half if Decimal(half) > Decimal(f"5e-{digits + 1}") else F.abs(x) > half
    small = F.when(up, F.signum(x) * unit).otherwise(0.0)
    return F.when(F.abs(x) < unit, small).otherwise(F.call_function("format_number", x, F.lit("0." + "0" * digits)).cast("double"))


def fold_case(c: Column) -> Column:
    """Lower case, with the letters that patterns without case take for i, k and s."""
    return F.lower(F.translate(c, "\u017f\u0131\u0130\u212a", "siik"))


def holds(c: Column, some: tuple[str, ...]) -> Column:
    """Whether c holds one of some."""
    out = c.contains(some[0])
    for s in some[1:]:
        out = out | c.contains(s)
    return out


def java(pattern: str) -> str:
    """A pattern of Python's re with IGNORECASE as Java reads it: Unicode classes, . without line feed only, \\s with 1C-1F."""
    kept = pattern.replace(r"[\s\S]", "\0").replace(r"\s", r"[\s\x1c-\x1f]").replace("\0", r"[\s\S]")
    return "(?iudU)" + kept
