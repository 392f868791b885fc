import random
import re

import numpy as np
import pytest

from sedimenta.llm import decontam

VOCABULARY = ["v%d" % i for i in range(3000)]


def text(rng, n):
    return [rng.choice(VOCABULARY[: rng.choice([40, 400, 3000])]) for _ in range(n)]


def accepted(item, answers, near):
    """STRONG or WEAK by a table of common subsequences, on words."""
    row = [0] * (len(near) + 1)
    for x in item:
        left = 0
        new = [0]
        for j, y in enumerate(near):
            left = row[j] + 1 if x == y else max(left, row[j + 1])
            new.append(left)
        row = new
    n, common = len(item), row[-1]
    return common >= decontam.STRONG * n or common >= decontam.WEAK * n and 2 * len(answers & set(near)) >= len(answers)


def leaks(rate, rarest):
    """(items, documents): every item once in a text of its own, a share of its words replaced by common ones."""
    rng = random.Random(3)
    items = [text(rng, rng.randrange(15, 60)) for _ in range(60)]
    docs = []
    for item in items:
        m = int(rate * len(item))
        order = sorted(range(len(item)), key=lambda i: -VOCABULARY.index(item[i]))
        leak = list(item)
        for i in order[:m] if rarest else rng.sample(order, m):
            leak[i] = rng.choice(VOCABULARY[:40])
        docs.append((text(rng, 80), leak, text(rng, 80)))
    return items, docs


@pytest.mark.parametrize(("rate", "rarest"), [(0.3, True), (0.35, False), (0.4, False), (0.45, False)])
def test_all_that_the_rules_accept_is_found(spark, rate, rarest):
    items, docs = leaks(rate, rarest)
    df = spark.createDataFrame([(k, " ".join(a + b + c)) for k, (a, b, c) in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    hashed = decontam.hashed_words(df, decontam.scratch(spark, "test"), "doc_id", "text")
    idf = decontam.fit(hashed).idf
    terms = {}
    for w in {w for item in items for w in item}:
        found = next(decontam.hashed_texts(decontam.pa.array([w]), decontam._SPACES))[1]
        terms[w] = int(decontam._terms((found >> np.uint64(32)).astype(np.uint32))[0])
    want = set()
    for k, item in enumerate(items):
        answers = {item[i] for i in np.argsort([-idf[terms[w]] for w in item], kind="stable")[: decontam.ANSWERS]}
        a, leak, c = docs[k]
        near = len(item) // 2
        if accepted(item, answers, a[-near:] + leak + c[:near]):
            want.add((k, k))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench).collect()}
    assert len(want) >= 30
    assert len(want & got) >= 0.98 * len(want)
    assert got <= {(k, k) for k in range(len(items))}


def test_short_items(spark):
    """Items of 1 to 7 words are held where their words follow one another, whatever the length of the document."""
    rng = random.Random(8)
    few = VOCABULARY[:12]
    items = [(n * 10 + k, " ".join(rng.choice(few) for _ in range(n))) for n in range(1, 8) for k in range(4)] + [(90, "V1, v2!"), (None, "v3 v4"), (91, ""), (92, "?!")]
    docs = [(k, " ".join(rng.choice(few) for _ in range(rng.randrange(0, 30)))) for k in range(150)] + [(1000, None), (1001, "v1"), (1001, "v1"), (None, "v1 v2"), (1002, "x v1 v2" * 60_000)]
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    want = []
    for d, t in docs:
        for i, x in items:
            if words(x) and f" {' '.join(words(x))} " in f" {' '.join(words(t))} ":
                want.append((d, i, len(words(x))))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(df, bench).collect()
    assert sorted(((r.doc_id, r.item_id, r.item_words) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        if r.doc_id is not None and r.doc_id < 1000:
            assert r.cosine == 1 and words(docs[r.doc_id][1])[r.first_word : r.first_word + r.item_words] == words(dict(items)[r.item_id])
    left = decontam.decontaminate(df, bench).collect()
    held = {(d, t) for d, t in docs if any(f" {' '.join(words(x))} " in f" {' '.join(words(t))} " for _, x in items if words(x))}
    assert sorted((str(r.doc_id), r.text) for r in left if r.text) == sorted((str(d), t) for d, t in docs if t and (d, t) not in held)


def test_many_items_take_one_pass(spark, monkeypatch):
    """More items than a block holds, short ones too; and documents of under eight words that a long item accepts."""
    rng = random.Random(12)
    items = [(k, " ".join(f"i{k}w{j}x{rng.randrange(99)}" for j in range(rng.choice([3, 5, 8, 9, 20])))) for k in range(5001)]
    monkeypatch.setattr(decontam, "SHORT_ITEMS", 900)
    rows = [(k, f"some {t} more words") for k, t in items[::500]] + [(90_000 + k, " ".join(t.split()[:6])) for k, t in items if len(t.split()) == 8][:3]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench).collect()}
    assert got == {(d, next(k for k, x in items if x.split()[:1] == (t.removeprefix("some ")).split()[:1])) for d, t in rows}
    assert decontam.decontaminate(df, bench).count() == 0
