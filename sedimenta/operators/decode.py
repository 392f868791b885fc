"""Layered decoding of obfuscated text: an Arrow UDF with early exit and a step trace, and single layers natively."""

from __future__ import annotations

import base64
import binascii
import html
import re
import urllib.parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.rowwise import KEYS, per_payload

LAYERS = 8

# Step names and descriptions, patterns of the layers.
STEPS = (
    ("URL_DECODE", "Decoded percent-encoded URL hex characters."),
    ("HTML_ENTITY_DECODE", "Decoded HTML entities (&lt;, &#xNN;)."),
    ("HEX_UNICODE_ESCAPE_DECODE", "Decoded \\xNN and \\uNNNN character escape sequences."),
    ("STRING_CONCAT_COLLAPSE", "Collapsed fragmented string concatenations ('a'+'b')."),
    ("BASE64_DECODE", "Decoded Base64 payload block."),
)
HEX_ESCAPE, UNICODE_ESCAPE = r"\\x([0-9a-fA-F]{2})", r"\\u([0-9a-fA-F]{4})"
CONCATENATION = r"['\"]\s*\+\s*['\"]"
BASE64 = r"(?:[A-Za-z0-9+/]{4}){4,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?"

_HEX, _UNICODE, _CONCAT, _BASE64 = map(re.compile, (HEX_ESCAPE, UNICODE_ESCAPE, CONCATENATION, BASE64))
_PAIR = re.compile("[\ud800-\udbff][\udc00-\udfff]")
_LONE = re.compile("[\ud800-\udfff]")


def _scalar(text: str) -> str:
    """Surrogate pairs joined, lone ones replaced: Spark's strings hold neither."""
    text = _PAIR.sub(lambda m: m[0].encode("utf-16", "surrogatepass").decode("utf-16"), text)
    return _LONE.sub("�", text)


def _url(t: str) -> str:
    return urllib.parse.unquote(t) if "%" in t else t


def _entities(t: str) -> str:
    return html.unescape(t) if "&" in t and (";" in t or "&#" in t) else t


def _escapes(t: str) -> str:
    if "\\" not in t:
        return t
    point = lambda m: chr(int(m[1], 16))
    return _scalar(_UNICODE.sub(point, _HEX.sub(point, t)))


def _joined(t: str) -> str:
    return _CONCAT.sub("", t) if "+" in t else t


def _block(m: re.Match) -> str:
    try:
        text = base64.b64decode(m[0], validate=True).decode()
    except (binascii.Error, UnicodeDecodeError):
        return m[0]
    good = sum(" " <= c <= "~" or c in "\r\n\t" for c in text)
    return text if text and good / len(text) > 0.85 else m[0]


def _base64(t: str) -> str:
    return _BASE64.sub(_block, t)


_TRANSFORMS = (_url, _entities, _escapes, _joined, _base64)


def decode_layers(payload: str, layers: int = LAYERS) -> tuple[str, list[dict]]:
    """The text once no layer changes it (or after so many rounds), and the steps taken."""
    steps, text = [], payload
    for layer in range(1, layers + 1):
        before = len(steps)
        for (name, description), transform in zip(STEPS, _TRANSFORMS, strict=True):
            if (changed := transform(text)) != text:
                text = changed
                steps.append({"layer": layer, "transform": name, "description": description, "output_preview": text[:120]})
        if len(steps) == before:
            break
    return text, steps


DECODED = "normalized_payload string, total_layers_unwrapped int, transforms_applied array<string>, steps array<struct<layer:int,transform:string,description:string,output_preview:string>>"


def decoded_of(payload: str, layers: int = LAYERS) -> tuple:
    text, steps = decode_layers(payload, layers)
    return text, len(steps), list(dict.fromkeys(s["transform"] for s in steps)), steps


def deobfuscate(df: DataFrame, layers: int = LAYERS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return per_payload(df, F.col("payload"), DECODED, lambda p: decoded_of(p, layers), keys)


def html_decode(df: DataFrame) -> DataFrame:
    return per_payload(df, F.col("payload"), "decoded string", lambda p: (_entities(p),))


# Single layers as native expressions


def rebuilt(c: Column, pattern: str, make) -> Column:
    """c with each match of pattern replaced by make(match)."""
    return F.array_join(F.zip_with(F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda part, m: F.concat(part, F.coalesce(make(m), F.lit("")))), "")


def url_decoded(c: Column) -> Column:
    """Percent escapes decoded; + and bad escapes stay; invalid UTF-8 becomes U+FFFD where Spark can tell, else stays."""
    safe = F.regexp_replace(F.regexp_replace(c, r"\+", "%2B"), r"%(?![0-9a-fA-F]{2})", "%25")
    return F.when(c.contains("%"), F.coalesce(F.try_url_decode(safe), c)).otherwise(c)


def hex_decoded(c: Column) -> Column:
    """\\xNN, then \\uNNNN."""
    first = rebuilt(c, r"\\x[0-9a-fA-F]{2}", lambda m: F.decode(F.unhex(F.substring(m, 3, 2)), "ISO-8859-1"))
    return F.when(c.contains("\\"), rebuilt(first, r"\\u[0-9a-fA-F]{4}", lambda m: F.decode(F.unhex(F.substring(m, 3, 4)), "UTF-16BE"))).otherwise(c)


def concat_collapsed(c: Column) -> Column:
    return F.regexp_replace(c, r"['\"][\s\x1c-\x1f]*\+[\s\x1c-\x1f]*['\"]", "")


def base64_decoded(c: Column) -> Column:
    """Base64 runs of 16 characters or more whose bytes are UTF-8 and mostly printable."""

    def block(m: Column) -> Column:
        text = F.try_validate_utf8(F.try_to_binary(m, F.lit("base64")).cast("string"))
        good = F.length(F.regexp_replace(text, r"[^\x20-\x7e\r\n\t]", ""))
        return F.when(good / F.length(text) > 0.85, text).otherwise(m)

    return rebuilt(c, BASE64, block)


def single_layers(df: DataFrame, which: str) -> DataFrame:
    make = {"url": url_decoded, "hex": hex_decoded, "concat": concat_collapsed, "base64": base64_decoded}[which]
    return df.select(*KEYS, make(F.col("payload")).alias("decoded"))
