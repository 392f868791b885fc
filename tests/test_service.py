import json
from io import StringIO

import pytest
from pyspark.sql import functions as F

from sedimenta import service
from sedimenta.functions.register import register
from sedimenta.operators import bytestats, threats
from sedimenta.sources import corpus
from sedimenta.streaming import payloads


@pytest.mark.parametrize("tool,arguments,field", [
    ("payload_analyze", {"payload": "<script>alert(1)</script>"}, "primary_threat"), ("payload_deobfuscate", {"payload": "%41"}, "normalized_payload"), ("payload_entropy", {"payload": "a" * 64, "window_size": 16}, "sliding_window_profile"),
    ("payload_waf_rules", {"payload": "{{7*7}}"}, "suricata"), ("payload_diagnostics", {}, "status"), ("payload_polyglot_audit", {"payload": "MZ<html>"}, "polyglot_class"), ("payload_ast_obfuscation", {"payload": "x"}, "complexity_score"),
    ("payload_markov_profile", {"payload": "banana", "ngram_order": 3}, "ngrams"), ("payload_lsh_fingerprint", {"payload": "banana", "compare_with": "bananas"}, "comparison"), ("payload_detect_shellcode", {"payload": "90 90 90 90 90 90 90 90 0f 05", "is_hex": True}, "score"),
])
def test_tools(spark, tool, arguments, field):
    answer = json.loads(service.handle(spark, json.dumps({"id": 1, "method": "tools/call", "params": {"name": tool, "arguments": arguments}})))
    assert field in json.loads(answer["result"]["content"][0]["text"])


def test_protocol(spark):
    codes = [json.loads(service.handle(spark, x))["error"]["code"] for x in ("{", '{"id":1,"method":"no"}', '{"id":1,"method":"tools/call","params":{"name":"no"}}')]
    assert codes == [-32700, -32601, -32603]
    assert service.handle(spark, '{"method":"notifications/initialized"}') is None
    assert len(json.loads(service.handle(spark, '{"id":1,"method":"tools/list"}'))["result"]["tools"]) == 10
    out = StringIO()
    service.serve_lines(spark, StringIO('{"id":1,"method":"ping"}\n\n{"id":2,"method":"initialize"}\n'), out)
    assert len(out.getvalue().splitlines()) == 2
    assert set(service.ROUTES.values()) <= set(service.TOOLS)


def test_command_line(spark, capsys, tmp_path):
    file = tmp_path / "p.txt"
    file.write_bytes(b"\xe9 ' OR 1=1")
    assert service.main(["analyze", str(file)], spark) == 0
    assert json.loads(capsys.readouterr().out)["primary_threat"] == "SQL_INJECTION"
    service.main(["waf", "{{7*7}}", "-t", "suricata"], spark)
    assert capsys.readouterr().out.startswith("alert http")
    service.main(["diagnostics"])
    assert json.loads(capsys.readouterr().out)["status"] == "healthy"
    assert service.safe_join(tmp_path, "a", "b").name == "b"
    with pytest.raises(PermissionError):
        service.safe_join(tmp_path, "..", "x")


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("SELECT shannon_entropy('AB') h, simhash_hex('banana') s, decode_layers('%41') d, shannon_entropy(NULL) n, hamming_hex('ff', '0f') x").first()
    assert (r.h, r.d, r.n, r.x, len(r.s)) == (1.0, "A", None, 4, 16)
    assert spark.sql("SELECT * FROM byte_windows(repeat('ab', 40), 32, 8)").count() == 7


def test_files_and_requests(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bin").write_bytes("é".encode())
    (tmp_path / "in/b.bin").write_bytes(b"\xe9\x90")
    got = {r.path.rpartition("/")[2]: r.payload for r in corpus.text_files(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.bin": "é", "b.bin": "é\x90"}
    lines = spark.createDataFrame([('{"payload":"<b>","window_size":16}',), ("{bad",), (None,)], "body string")
    parsed = corpus.requests(lines).collect()
    assert parsed[0].request.payload == "<b>" and parsed[0].request.window_size == 16 and not parsed[1].valid
    corpus.write_reports(bytestats.byte_entropy(corpus.fixtures(spark)), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == len(corpus.FIXTURES)


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("s", i, p) for i, p in enumerate(["{{7*7}}", "SELECT 1 FROM users WHERE id=1", "plain", "SELECT 1 FROM users WHERE id=2"])], payloads.SCHEMA)
    rows.coalesce(1).write.json(str(tmp_path / "in"))
    q = payloads.report_stream(payloads.payload_stream(spark, str(tmp_path / "in")), threats.threat_report, str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("primary_threat = 'SSTI'").count() == 1
    q = payloads.cluster_stream(payloads.payload_stream(spark, str(tmp_path / "in")), str(tmp_path / "k"), str(tmp_path / "kc"))
    q.awaitTermination(120)
    rows.select("source", (F.col("payload_id") + 10).alias("payload_id"), "payload").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    q = payloads.cluster_stream(payloads.payload_stream(spark, str(tmp_path / "in")), str(tmp_path / "k"), str(tmp_path / "kc"))
    q.awaitTermination(120)
    got = {r.payload_id: r.leader_id for r in spark.read.parquet(str(tmp_path / "k/clusters")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 1, 10: 0, 11: 1, 12: 2, 13: 1}


def test_event_time(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01T00:01:00", "{{7*7}}"), ("2024-01-01T00:02:00", "x"), ("2024-01-01T01:00:00", "x")], "ts string, payload string").withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = payloads.threat_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.severity, r.payloads) for r in spark.table("counts").collect()) == [("INFO", 1), ("INFO", 1), ("MEDIUM", 1)]


def test_http(spark):
    import threading
    import urllib.error
    import urllib.request

    server = service.http_server(spark, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def ask(path, body=None, origin=None):
        request = urllib.request.Request(base + path, body, {"Origin": origin} if origin else {})
        try:
            with urllib.request.urlopen(request, timeout=60) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    assert ask("/health")[0] == 200 and ask("/no")[0] == 404
    assert ask("/api/waf", b'{"payload":"{{7*7}}"}')[1]["threat"] == "SSTI"
    assert ask("/api/analyze", b"{bad")[0] == 400 and ask("/api/no", b"{}")[0] == 404
    assert ask("/api/analyze", b"{}", "http://evil.com")[0] == 403 and not service.is_local("null") and service.is_local("http://[::1]:80")
    server.shutdown()
