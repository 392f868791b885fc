import itertools
import random
import re

import numpy as np

from sedimenta.llm import decontam, graph, neardup, topk
from sedimenta.llm.words import hashed_texts, jaccard_at_least, shingle_set

VECTORS = [(i, [float(np.sin(i * k)) for k in range(1, 20)], 0) for i in range(300)]
VECTORS += [(1000 + i, VECTORS[7][1], 0) for i in range(40)] + [(900, None, 0), (901, [1.0, None] + [0.0] * 17, 0), (902, [float("nan")] * 19, 0), (903, [float("inf")] * 19, 0), (904, [1.0, 2.0], 0), (905, [], 0), (None, [1.0] * 19, 0), (5, VECTORS[5][1], 0)]


def test_topk_against_brute_force(spark):
    df = topk.quantised(spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, rank int"))
    rows = [(r.id, np.array(r.ints)) for r in df.collect()]
    assert {r[0] for r in rows} == {i for i, v, _ in VECTORS if i is not None and i not in (900, 901, 902, 903)}
    got = {}
    for r in topk.exact_topk(df.where("id % 20 = 0"), df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    for q, v in rows:
        if q % 20 == 0:
            scores = sorted((-int(v @ w), i) for i, w in rows if i != q and len(w) == len(v))[:10]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert topk.exact_topk(df.where("false"), df).count() == topk.exact_topk(df, df.where("false")).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 64)), rng.normal(size=(60, 64))
    for s in topk.SEGMENTS:
        assert (topk.statistics(x, s) @ topk.statistics(y, s).T >= x @ y.T - 1e-9).all()


def test_wide_integers():
    search = topk.BlockSearch(np.array([1]), np.array([[2**30, 2**30]]), 2)
    search.meet(np.array([2, 3]), np.array([[2**30, 1], [2**30, 2]]))
    assert search.result().to_pydict()["score"] == [2**60 + 2**31, 2**60 + 2**30]
    search.meet(np.array([6, 5, 4]), np.array([[2**40, 2**40], [2**50, 2**50], [-(2**60), 2**60 + 4]]))
    assert search.result().to_pydict() == {"query_id": [1, 1], "id": [5, 6], "score": [2**63 - 1] * 2}


def test_huge_components(spark):
    rows = [(0, [1.0, 2.0]), (1, [1e18, 1.0]), (2, [-1e18, 0.0]), (3, [1e300, -1e300]), (4, [3.0, 1.0]), (5, [1e18, 1e18])]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    ints = {r.id: r.ints for r in df.collect()}
    got = {}
    for r in topk.exact_topk(df, df, 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    for q, v in ints.items():
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(v, w, strict=True)))), i) for i, w in ints.items() if i != q)[:3]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]


def test_blocks_are_dealt_evenly(spark, monkeypatch):
    """Many small blocks, several lengths of vector and ids that are null or repeat: as brute force."""
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 7)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    monkeypatch.setattr(topk, "KEPT", 2)
    rng = random.Random(4)
    rows = [(i, [rng.randrange(-9, 9) / 4 for _ in range(3 + i % 2)]) for i in range(150)]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4))
    ints = {r.id: r.ints for r in df.collect()}
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in topk.exact_topk(df.where("id % 3 = 0"), df, 4).collect()}
    want = {}
    for q, v in ints.items():
        if q % 3 == 0:
            scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i) for i, w in ints.items() if i != q and len(w) == len(v))[:4]
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(scores)}
    assert got == want
    assert len(topk._deals(spark, 7)) == 7


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 200) if i % 50] + [(500, 500 + k) for k in range(1, 90)] + [(rng.randrange(600, 700), rng.randrange(600, 700)) for _ in range(60)] + [(7, 7), (None, 4)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    find = lambda i: i if up.setdefault(i, i) == i else find(up[i])
    for a, b in edges:
        if a is not None and a != b:
            up[find(a)] = find(b)
    for a, b in itertools.combinations(up, 2):
        assert (find(a) == find(b)) == (got[a] == got[b])
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t):
    w = words(t)
    return frozenset(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}
    find = lambda i: i if up[i] == i else find(up[i])
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((find(a), find(b)))
            up[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_rows():
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(3000)]
    rows, k = [], 0
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 6, 40, 120, 400]))]
        for c in range(rng.choice([1, 2, 5, 40])):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 30)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((k * 3 % 1009, " ".join(text) if c % 2 else "  " + "\n".join(text).upper()))
            k += 1
    return rows + [(2001, None), (2002, ""), (2003, " \t"), (2004, "One two"), (2005, "one  TWO"), (2006, "é"), (2007, "É")]


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string")
    want = brute(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_large_nodes_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "NODE", 4)
    monkeypatch.setattr(neardup, "BLOCK", 5)
    rows = near_rows()
    want = brute(rows)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in want.items()}


def test_near_duplicates_of_odd_rows(odd, none):
    got = sorted((str(r.doc_id), r.n_shingles > 0, r.component_id, r.kept) for r in neardup.near_duplicates(odd).collect())
    assert got == sorted([("1", True, 1, True), ("2", False, 2, True), ("3", False, 3, True), ("4", False, 4, True), ("5", True, 5, True), ("6", True, 1, False), ("6", True, 1, False), ("None", True, None, True), ("8", True, 8, True)])
    assert neardup.near_duplicates(none).count() == 0


def test_word_hashes_follow_words():
    import pyarrow as pa

    texts = ["One two\tTHREE", None, "", "one", "é É", "x" * 9000 + " y"]
    seen = {}
    for row, hashes, edges in hashed_texts(pa.array(texts)):
        for i in range(len(edges) - 1):
            found = hashes[edges[i] : edges[i + 1]].tolist()
            assert len(found) == len(words(texts[row + i]))
            for w, h in zip(words(texts[row + i]), found, strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    a, b = np.arange(100, dtype=np.uint64), np.arange(8, 108, dtype=np.uint64)
    assert jaccard_at_least(a, b, 85) and not jaccard_at_least(a, b, 86) and not jaccard_at_least(a, a[:0], 1)
    assert len(shingle_set(np.arange(3, dtype=np.uint64))) == 1


def test_leaks(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice(["the", "er", "on", "an", "re", "ti", "ou", "st"]) for _ in range(rng.randrange(1, 5))) for _ in range(2500)]
    text = lambda n: [rng.choice(vocabulary[: rng.choice([60, 2500])]) for _ in range(n)]
    items = [text(rng.randrange(15, 60)) for _ in range(25)]
    docs, want = [], set()
    for d in range(300):
        body = text(rng.randrange(30, 500))
        if d % 6 == 0:
            k = d // 6 % 25
            leak = list(items[k])
            if d % 12 == 0:  # a paraphrase: words replaced and one dropped
                for _ in range(len(leak) // 8):
                    leak[rng.randrange(len(leak))] = rng.choice(vocabulary[:60])
                leak.pop(rng.randrange(len(leak)))
            at = rng.randrange(len(body))
            body[at:at] = leak
            want.add((d, k))
        docs.append((d, " ".join(body).capitalize(), "x"))
    bench = [(k, " ".join(w) + ".") for k, w in enumerate(items)] + [(98, None), (99, "too short")]
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, " ".join(text(200_000) + items[3] + text(10)), "x"), (None, " ".join(items[4]), "x")]
    want |= {(1002, 3), (None, 4)}
    df = spark.createDataFrame(docs, "doc_id long, text string, ids string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(df, b).collect()}
    assert got == want
    left = decontam.decontaminate(df, b)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {d for d, *_ in docs} - {d for d, _ in want}
    assert decontam.contaminated(df, b.where("false")).count() == 0
    assert decontam.contaminated(df.where("false"), b).count() == 0


def test_common_subsequence():
    mask = {}
    item = [1, 2, 3, 2, 5]
    for i, x in enumerate(item):
        mask[x] = mask.get(x, 0) | 1 << i

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j, row=row, x=x: row[j - 1] + 1 if x == b[j - 1] else max(left, row[j]), initial=0))
        return row[-1]

    rng = random.Random(2)
    for _ in range(300):
        other = [rng.randrange(1, 7) for _ in range(rng.randrange(0, 12))]
        assert decontam.common_subsequence(mask, len(item), other) == plain(item, other)
