import random
import re
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tests.llm.test_search import brute, shingles

from sedimenta import session
from sedimenta.llm import byte_bpe, toxicity
from sedimenta.llm.queries import BYTE_BPE


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("p") / name)
        stage(spark, docs, small).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_and_order(stages, small, spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "byte_bpe"]
    for name, (before, after) in stages.items():
        if name != "byte_bpe":
            assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert ids(after) <= ids(before)
        assert after.count() == len(ids(after))


def test_toxic_go(stages, spark, small):
    before, after = stages["toxicity"]
    model = toxicity.fit(before, spark.read.parquet(f"{small}/labels.parquet"))
    want = {r.doc_id for r in toxicity.score(before, model).where("predicted = 0").collect()}
    assert ids(after) == want


def test_one_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    groups = brute([(r.doc_id, r.text) for r in before.collect()], 80)
    assert ids(after) == {i for i, (_, c) in groups.items() if i == c}


def test_pairs_between_the_thresholds(spark):
    """Pairs of a similarity of 0.80 to 0.85 are near-duplicates for the stage."""
    rng, rows = random.Random(11), []
    for k in range(40):
        words = [f"a{k}x{i}" for i in range(rng.choice([60, 120, 300]))]
        other, share = list(words), 1.0
        while share > 0.84:
            other[rng.randrange(len(other))] = f"n{rng.random()}"
            x, y = shingles(" ".join(words)), shingles(" ".join(other))
            share = len(x & y) / len(x | y)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    want = brute(rows, 80)
    assert ids(left) == {i for i, (_, c) in want.items() if i == c}
    assert 40 <= len(ids(left)) < 60


@pytest.fixture
def strange(spark):
    """Rows of documents with null, empty, very long, repeated and clashing values; a text of its own under a copy's id."""
    leak = "plain words of a long question that nobody would write by chance at all"
    rows = [(1, "the same text in several rows of this table", 0), (2, "the same text in several rows of this table", 0), (2, "another text that has only its id in common", 0), (2, "the same text in several rows of this table", 0), (None, "the same text in several rows of this table", 0), (4, None, 0), (5, "", 0), (None, None, 0), (7, "very long words " + "of one text and then some more, " * 60_000, 0), (8, f"it says {leak} twice {leak}", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    more = [F.lit("x").alias(c) for c in ("id", "key", "kept", "score", "ids", "words", "component_id", "label", "n_tokens", "__other")]
    return docs.select("*", *more), spark.createDataFrame([(1, leak), (None, None), (2, "")], "item_id long, text string")


def test_stages_on_odd_rows(spark, strange, tmp_path):
    docs, bench = strange
    for name, df in (("documents", docs), ("benchmark", bench), ("labels", spark.createDataFrame([(1, 0), (2, None)], "doc_id long, toxic int"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    texts = lambda df: sorted((str(r.doc_id), str(r.text)[:12]) for r in df.collect())
    every = texts(docs)
    toxic = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert toxic.columns == docs.columns and texts(toxic) == every
    one = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert one.columns == docs.columns and texts(one) == sorted([x for x in every if x != ("2", "the same tex")])
    clean = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and texts(clean) == [x for x in every if x[0] != "8"]
    assert corpus_pipeline.encode(spark, docs, str(tmp_path)).count() == docs.count()
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_run_leaves_only_its_result(spark, strange, tmp_path):
    docs, bench = strange
    for name, df in (("documents", docs), ("benchmark", bench), ("labels", spark.createDataFrame([], "doc_id long, toxic int"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    mark = session.scratch_mark(spark)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == docs.count() - 3
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    made = [f for f in session._made[spark.sparkContext.applicationId][mark:] if f]
    assert len(made) == 1 and len(list(Path(made[0].removeprefix("file://")).iterdir())) == 1


def test_leaks_go(stages, spark, small):
    before, after = stages["decontamination"]
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [words(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    text = {r.doc_id: " " + " ".join(words(r.text)) + " " for r in before.collect()}
    assert ids(before) - ids(after) == {i for i, t in text.items() if any(f" {' '.join(w)} " in t for w in items)}


def test_encoded(stages):
    before, after = stages["byte_bpe"]
    codec = byte_bpe.Codec(BYTE_BPE)
    want = {r.doc_id: len(next(codec.encode([r.text]))) for r in before.collect()}
    assert {r.doc_id: r.n_tokens for r in after.collect()} == want
