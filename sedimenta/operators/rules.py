"""Filter rules for four engines, made from threat reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.rowwise import KEYS
from sedimenta.operators.threats import assessed

FAMILIES = ("modsecurity", "cloudflare", "aws_waf", "suricata")


def escaped(c: Column) -> Column:
    """Backslashes before the characters that patterns give a meaning."""
    marked = F.regexp_replace(c, r"([\\\-\[\](){}.*+?^$|# &~])", r"\\$1")
    for raw, name in (("\t", "\\\t"), ("\n", "\\\n"), ("\r", "\\\r"), ("\x0b", "\\\x0b"), ("\x0c", "\\\x0c")):
        marked = F.replace(marked, F.lit(raw), F.lit(name))
    return marked


def rule_id(raw: Column) -> Column:
    """900001 to 990000, from a digest of the payload: the same in every process."""
    return (F.lit(900001) + F.pmod(F.conv(F.substring(F.md5(raw.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(90000))).cast("long")


def _json(c: Column) -> Column:
    """c as the inside of a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":"(.*)"\}$', 1)


def rules_for(reports: DataFrame) -> DataFrame:
    """threat, severity and the four rules of each report."""
    first = F.get("matched_rules", F.lit(0))["matched_subpattern"]
    pattern = escaped(F.substring(F.coalesce(first, F.col("normalized_payload")), 1, 32))
    # Fixed values below: the texts of the rules.
    rows = reports.select(*KEYS, F.col("primary_threat").alias("t"), "severity", pattern.alias("p"), rule_id(F.col("raw_payload")).cast("string").alias("i"))
    t, p, i = F.col("t"), F.col("p"), F.col("i")
    mod = F.concat(
        F.lit('# ModSecurity 3 / OWASP CRS Custom Filter\nSecRule ARGS|REQUEST_URI|REQUEST_BODY "@rx '), p, F.lit('" \\\n    "id:'), i,
        F.lit(",\\\n    phase:2,\\\n    deny,\\\n    status:403,\\\n    log,\\\n    msg:'Blocked "), t, F.lit(" Attack Pattern',\\\n    tag:'application-multi',\\\n    tag:'security-threat',\\\n    severity:'CRITICAL'\""),
    )
    cloud = F.concat(F.lit('(http.request.uri.query contains "'), p, F.lit('" or http.request.body.raw contains "'), p, F.lit('")'))
    aws = F.concat(
        F.lit('{\n  "Name": "Block-'), t, F.lit("-"), i, F.lit('",\n  "Priority": 10,\n  "Action": {\n    "Block": {}\n  },\n  "VisibilityConfig": {\n    "SampledRequestsEnabled": true,\n    "CloudWatchMetricsEnabled": true,\n    "MetricName": "Metric-'), t,
        F.lit('"\n  },\n  "Statement": {\n    "RegexMatchStatement": {\n      "SearchString": "'), _json(p),
        F.lit('",\n      "FieldToMatch": {\n        "QueryString": {}\n      },\n      "TextTransformations": [\n        {\n          "Priority": 0,\n          "Type": "URL_DECODE"\n        },\n        {\n          "Priority": 1,\n          "Type": "LOWERCASE"\n        }\n      ]\n    }\n  }\n}'),
    )
    suri = F.concat(F.lit('alert http any any -> $HTTP_SERVERS $HTTP_PORTS (msg:"ET ATTACK Known '), t, F.lit(' Injection Attempt"; flow:established,to_server; content:"'), F.substring(p, 1, 20), F.lit('"; nocase; http_uri; sid:'), i, F.lit("; rev:1; classtype:web-application-attack;)"))
    return rows.select(*KEYS, t.alias("threat"), "severity", mod.alias("modsecurity"), cloud.alias("cloudflare"), aws.alias("aws_waf"), suri.alias("suricata"))


def waf_rules(df: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """Rules for payloads, of the wanted families only."""
    return rules_for(assessed(df)).select(*KEYS, "threat", "severity", *families)
