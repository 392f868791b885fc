import json

import pytest
from pyspark.sql import functions as F

from sedimenta import service
from sedimenta.functions.register import register, register_reports
from sedimenta.operators import fingerprints, threats


def test_more_sql_functions(spark):
    register(spark)
    r = spark.sql(
        "SELECT monte_carlo_pi('abcdefgh') pi, entropy_class(2.0) c, size(char_classes('a b')) k, byte_ngrams('aaab') g, url_decode_layer('%41') u, hex_decode_layer('\\\\x41') x, "
        "concat_collapse(NULL) n, minhash_similarity(minhash_signature('banana'), minhash_signature('banana')) same, minhash_similarity(array(1L, 2L), array(1L, 3L)) half, "
        "minhash_similarity(array(), array(1L)) none, minhash_similarity(NULL, array(1L)) missing, simhash_similarity('ff', '0f') s, threat_severity(45) t, threat_severity(NULL) tn"
    ).first()
    assert (r.k, r.u, r.x, r.n, r.same, r.half, r.none, r.missing) == (5, "A", "A", None, 1.0, 0.5, 0.0, None)
    assert (r.s, r.t, r.tn, len(r.g), r.c is not None, r.pi > 0) == (1 - 4 / 64, "HIGH", None, 2, True, True)


def test_severity_is_the_operators(spark):
    register(spark)
    risks = spark.createDataFrame([(float(x),) for x in (-1, 0, 0.5, 24.9, 25, 44, 45, 69, 70, 100)], "risk double")
    assert risks.where(F.expr("threat_severity(risk)") != threats.severity(F.col("risk"))).count() == 0


def test_similarity_is_the_operators(spark):
    register(spark)
    rows = spark.createDataFrame([(0, "banana", "bananas"), (1, "", "x"), (2, "same", "same")], "pair_id long, left string, right string")
    a, b = (F.expr(f"simhash_hex({x})") for x in ("left", "right"))
    got = rows.select(F.call_function("simhash_similarity", a, b).alias("x")).collect()
    assert [x.x for x in got] == [1 - bin(fingerprints.simhash_of(p.encode()) ^ fingerprints.simhash_of(q.encode())).count("1") / 64 for p, q in (("banana", "bananas"), ("", "x"), ("same", "same"))]


def test_report_views(spark):
    rows = spark.createDataFrame([("s", 1, "{{7*7}}"), ("s", 2, None), ("s", 3, "")], "source string, payload_id long, payload string")
    names = register_reports(spark, rows, "mine")
    assert "mine_threat_report" in names
    assert spark.sql("SELECT primary_threat FROM mine_threat_report WHERE payload_id = 1").first()[0] == "SSTI"
    for name in names:
        assert spark.table(name).where("payload_id = 2").count() == 0, name


def test_http_errors(spark, monkeypatch):
    post = lambda path, body: service.respond(spark, "POST", path, None, body)
    assert post("/api/entropy", b'{"payload":"x","window_size":"x"}')[0] == 400
    assert post("/api/entropy", b'{"payload":"x","window_size":null}')[0] == 400

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(service, "call", broken)
    assert post("/api/analyze", b'{"payload":"x"}') == (500, {"error": "RuntimeError: lost"})


@pytest.mark.parametrize("name", ["diagnostics", "doctor", "platform", "status"])
def test_state_commands(name, capsys):
    assert service.main([name]) == 0
    assert json.loads(capsys.readouterr().out)["status"] == "healthy"
    assert service.main([name, "--text"]) == 0
    assert "healthy" in capsys.readouterr().out


def test_tables(spark, capsys):
    assert service.main(["polyglot", "MZ<html>", "--text"], spark) == 0
    assert "detected_formats\n- PE_EXE" in capsys.readouterr().out
    assert service.main(["simhash", "banana"], spark) == 0
    assert len(json.loads(capsys.readouterr().out)["simhash"]) == 16
    assert service.as_text({"a": 1, "rows": [{"x": 1, "long": "p  q"}, {"x": 22}], "none": [], "in": {"k": True}}) == "a  1\n\nrows\nx   long\n1   p q\n22\n\nnone\n-\n\nin\nk  True"


def test_folders(tmp_path):
    made = service.ensure_dir(tmp_path / "a" / ".." / "b" / "c")
    assert made == (tmp_path / "b" / "c").resolve() and made.is_dir() and service.ensure_dir(made) == made
    assert service.normalize_path("~").is_absolute()
