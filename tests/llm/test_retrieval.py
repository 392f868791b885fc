import numpy as np
import pytest

from sedimenta.llm import decontam

RNG = np.random.default_rng(4)


@pytest.fixture(scope="module")
def made():
    """Items and three texts of each: as it is, and with its words reordered by halves, in other words."""
    projection = np.concatenate([RNG.normal(size=(decontam.TERMS, decontam.SKETCH)), np.zeros((1, decontam.SKETCH))]).astype(np.float32)
    space = decontam.Space(RNG.random(decontam.TERMS).astype(np.float32), projection)
    words = [RNG.integers(0, 1 << 32, n, dtype=np.uint32) for n in RNG.integers(8, 70, 40)]
    items = decontam.prepare(list(range(40)), words, space)
    other = lambda n: RNG.integers(0, 1 << 32, n, dtype=np.uint32)
    texts = [np.concatenate([other(30), w[len(w) // 2 :] if k % 3 == 1 else w, other(k)]) for k, w in enumerate(words)] + [other(0)]
    return np.concatenate(texts), np.append(0, np.cumsum([len(t) for t in texts])), items, space


def test_candidates_are_those_of_the_cosine(made, monkeypatch):
    """The cosines of all windows, by a plain loop; blocks of cosines join up."""
    words, edges, items, space = made
    monkeypatch.setattr(decontam, "TAKEN", 500)
    want = []
    for t, i, k in zip(*decontam._confirmable(words, edges, items), strict=True):
        at = edges[t] + k * decontam.STEP
        v = space.projection[decontam._terms(words[at : min(edges[t + 1], at + items.wide[i] * decontam.STEP)])].sum(0)
        cosine = v @ items.vectors[i] / max(np.linalg.norm(v), 1e-12)
        want.append((t, i, k, cosine))
    got = list(zip(*decontam._candidates(words, edges, items, space), strict=True))
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-5)
    assert got


def test_weak_matches_need_the_cosine(made, monkeypatch):
    words, edges, items, space = made
    pairs = lambda: {(t, i) for t, i, *_ in decontam.matches(words, edges, items, space)}
    strong = {(k, k) for k in range(40) if k % 3 != 1}
    assert pairs() > strong
    monkeypatch.setattr(decontam, "COSINE", 1.1)
    assert pairs() == strong
    assert decontam.matches(words[:0], np.array([0, 0]), items, space) == []
