import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sedimenta.llm import html_extract, html_training, toxicity

HOME = "<html><body><nav><a href=/a>Menu</a></nav><div class=ad>Buy this now, please.</div><article><h1>A headline about things</h1><p>First &amp; only   paragraph,\nwith words enough to be one.</p><p>Second one<br>goes on, and it has a comma.<script>x</script></p></article><div id=comments><p>I don't agree with this at all, sorry.</p></div><footer>&copy; someone, somewhere.</footer>"


@pytest.fixture(scope="module")
def model():
    return html_extract.trained()


def test_main_text(spark, model):
    rows = [(1, "u", HOME, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "plain words, no tags", "x"), (None, "u", HOME, "x"), (1, "u", HOME, "x"), (6, "u", "<p>" + "long words, many of them. " * 100_000, "x"), (7, "u", "<<<>> & <p" * 100, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.main_texts(df).collect()
    want = "A headline about things\nFirst & only paragraph, with words enough to be one.\nSecond one goes on, and it has a comma."
    assert [r.text for r in got if r.page_id in (1, None)] == [want] * 3
    by = {r.page_id: r for r in got}
    assert by[2].text == by[3].text == "" and by[4].text == "plain words, no tags"
    assert by[6].n_chars == len("long words, many of them. " * 100_000) - 1
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.main_texts(df.where("false")).count() == 0


def test_held_out_pages(model):
    make, right, n = html_training.maker(4242), 0, 0
    for _ in range(150):
        page, y = html_training.labelled(make())
        kept = html_extract.decode(page, model.log_odds(html_extract.features(page)))
        for i in range(1, len(kept)):
            assert not kept[i] or kept[page.parents[i]]
        for piece, owner in zip(page.texts, page.owners, strict=True):
            want = bool(y[owner]) and page.tags[owner] not in html_extract.NEVER
            right += len(piece) * (kept[owner] == want)
            n += len(piece)
    assert right / n > 0.97


def test_parser():
    page = html_extract.Page("<ul><li>a<li>b</ul><p>c<div>d</div><!-- e --><b>f</p><style>g</style><![CDATA[h]]></td>i &lt;j")
    assert [t for t in page.texts] == ["a", "b", "c", "d", "f", "h", "i <j"]
    assert html_extract.render(page, [True] * len(page.tags)) == "a\nb\nc\nd\nf\nh\ni <j"
    assert [page.tags[o] for o in page.owners][:4] == ["li", "li", "p", "div"]


def toxic_rows():
    rng = random.Random(8)
    clean = ["w%s" % "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    bad = ["nasty", "vileone", "horrid"]
    rows = []
    for i in range(900):
        words = [rng.choice(clean) for _ in range(rng.randrange(5, 120))] + ["the", "of"]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice([".", "", ","])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(None, None, 0.5), (2000, "", 0.5), (2001, "clean " * 400_000 + "nasty", 0.5), (3, rows[3][1], 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5000, None), (1, rows[1][2])], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + 4
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[2001].predicted == 1 and by[2000].predicted == 0 and not by[None].held_out
    left = toxicity.reject(docs, model)
    assert left.columns == docs.columns and left.count() == sum(r.predicted == 0 for r in got)
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.0, 0.0]


def test_model_survives_pickling(spark):
    import pickle

    rows = toxic_rows()[:300]
    model = toxicity.train(pa.array([t for _, t, _ in rows]), np.array([y for *_, y in rows]), np.arange(300) % 5 == 1)
    again = pickle.loads(pickle.dumps(model))
    for _, buckets, edges in toxicity.bucketed(pa.array([t for _, t, _ in rows])):
        assert np.allclose(model.scores(buckets, edges), again.scores(buckets, edges))


def test_the_sample_is_bounded(spark, monkeypatch):
    """One row an id however often documents repeat it, no long text, and no more than the bytes allowed."""
    docs = spark.createDataFrame([(1, f"t{k}", "x") for k in range(500)] + [(3, "b", "x"), (4, None, "x"), (6, "long " * 300_000, "x")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, toxic int")
    got = {r.id: (r.text, r.label) for r in toxicity.labelled_sample(docs, labels).collect()}
    assert got == {i: x for i, x in {1: ("t0", 1), 3: ("b", 1), 4: ("", 0)}.items() if zlib.crc32(str(i).encode()) % 5}
    assert toxicity.labelled_sample(docs, labels).count() == len(got)
    many = spark.createDataFrame([(i, "w" * 100) for i in range(400)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "MOST_BYTES", 2050)
    assert toxicity.labelled_sample(many, marks).count() == 20


def test_toxicity_with_clashing_columns(odd, none):
    labels = odd.sparkSession.createDataFrame([(i, i % 2, "x", "y") for i in range(1, 9)], "doc_id long, toxic int, text string, id string")
    model = toxicity.fit(odd, labels)
    assert toxicity.score(odd, model).columns == ["doc_id", "held_out", "score", "predicted"]
    assert toxicity.score(odd, model).count() == odd.count()
    assert toxicity.reject(odd, model).columns == odd.columns and toxicity.reject(none, model).count() == 0
