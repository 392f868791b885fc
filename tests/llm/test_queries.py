import duckdb
import pytest

from sedimenta.llm import queries

NAMES = {"op1_token_files", "op2_warc", "op3_token_counts", "op4_main_text", "op5_chat", "op6_exact_topk", "op7_near_duplicates", "op8_byte_bpe", "op9_decontamination", "op10_toxicity"}


def test_names():
    assert set(queries.queries()) == NAMES and set(queries.oracle_sql()) < NAMES


@pytest.mark.parametrize("name", queries.ORACLES)
def test_spark_and_duckdb_agree(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    df = queries.queries()[name](spark, small)
    assert sorted(columns) == sorted(df.columns)
    want = sorted(str([r[columns.index(c)] for c in sorted(columns)]) for r in cursor.fetchall())
    assert sorted(str([r[c] for c in sorted(columns)]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(NAMES - {"op9_decontamination"}))
def test_every_row_has_a_result(spark, small, name):
    table = {"op2": "pages", "op4": "pages"}.get(name.split("_")[0], "documents")
    rows = queries.queries()[name](spark, small).count()
    if name == "op5_chat":
        assert rows == spark.read.parquet(f"{small}/conversations.parquet").select("conv_id").distinct().count() + 1
    elif name == "op6_exact_topk":
        assert rows == 10 * spark.read.parquet(f"{small}/embeddings.parquet").where("vec_id % 100 = 0").count()
    else:
        assert rows == spark.read.parquet(f"{small}/{table}.parquet").count()
