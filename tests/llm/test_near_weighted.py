"""Weighted near duplicates against all pairs by the definition of the probability Jaccard similarity."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from marketweave.llm import near_dedup

WORDS = [f"w{i}" for i in range(60)]


def similarity(a, b):
    """Sum over common shingles of 1 / sum over all of the larger ratio, term by term."""
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())


def made(rng):
    texts = []
    for _ in range(5):
        base = list(rng.choice(WORDS, 40))
        for _ in range(9):
            w = list(base)
            for i in rng.integers(0, 40, rng.integers(0, 3)):
                w[i] = f"e{rng.integers(1000)}"
            line = " ".join(w[: rng.integers(8, 20)])
            texts.append("\n".join([" ".join(w)] + [line] * int(rng.integers(0, 4))))
    return [*texts, "", None, "one two", "one  two", " ".join(WORDS)]


@pytest.mark.parametrize("small", [32, 2])
def test_weighted_classes_equal_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "PART", 3)
    monkeypatch.setattr(near_dedup, "COPY_PAIRS", 2)
    texts = made(np.random.default_rng(3))
    sets, key = [], []
    for t in texts:
        w = (t or "").lower().split()
        key.append(tuple(w))
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            s = 1.0 if key[a] == key[b] else similarity(sets[a], sets[b])
            if s >= 0.8 - near_dedup.ROUNDING:
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = near_dedup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), counted=True).collect()
    want = defaultdict(list)
    for k in range(len(texts)):
        want[find(k)].append(k)
    classes = defaultdict(list)
    for r in got:
        classes[r.class_id].append(r.doc_id)
    assert sorted(map(sorted, classes.values())) == sorted(want.values())
    assert 3 < len(want) < len(texts) - 3


def test_recall_of_weighted_sketches():
    """Pairs at 0.8 share a band almost surely, those well below seldom: measured on weighted sets of known similarity."""
    rng = np.random.default_rng(8)
    found = {0.8: 0, 0.3: 0}
    for want in found:
        for _ in range(150):
            n, own = 200, 0
            x = rng.integers(1, 1 << 62, 400).astype(np.uint64)
            weights = rng.integers(1, 4, 400).astype(float)
            while True:  # elements of its own until the similarity is the wanted one
                a, b = np.sort(x[:n]), np.sort(x[own : n + own])
                order = {int(k): w for k, w in zip(x, weights, strict=True)}
                p, q = np.array([order[int(k)] for k in a]), np.array([order[int(k)] for k in b])
                if near_dedup.probability_jaccard(a, p, b, q) <= want:
                    break
                own += 1
            regs = [
                near_dedup.signatures(k, np.zeros(len(k), dtype=int), w, 1, near_dedup.BANDS * near_dedup.ROWS).reshape(near_dedup.BANDS, -1) for k,
                w in ((a, p), (b, q))
            ]
            found[want] += bool((regs[0] == regs[1]).all(axis=1).any())
    assert found[0.8] >= 149 and found[0.3] < 75


@pytest.mark.parametrize("counted", [True, False])
def test_prefixes_keep_every_link_and_part_texts_with_a_common_passage(spark, monkeypatch, counted):
    """Each two texts at 0.8 share a band of _prefixes; texts that only have a common passage share none."""
    monkeypatch.setattr(near_dedup, "SMALL", 0)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [t for t in made(np.random.default_rng(5)) if t] + [" ".join([f"u{k}x{i}" for i in range(30)] + [passage]) for k in range(20)]
    texts += [" ".join([*(f"c{i}" for i in range(60)), f"end{k}", *[f"c{i}" for i in range(k)]]) for k in range(8)]
    texts = list({near_dedup.text_key(t.encode()): t for t in texts}.values())
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    keys = [near_dedup.text_key(t.encode()) for t in texts]
    names = spark.createDataFrame([(k, 9) for k in keys], "key binary, n int")
    held = near_dedup._sets_of(docs, names.select("key"), 5, counted)
    bands = defaultdict(set)
    for r in near_dedup._prefixes(names, held, 0.8).collect():
        bands[bytes(r.key)].add(r.band)
    sets = []
    for t in texts:
        w = t.lower().split()
        found = Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1)))
        sets.append(found if counted else Counter(dict.fromkeys(found, 1)))
    linked = 0
    for a in range(len(texts)):
        for b in range(a):
            if similarity(sets[a], sets[b]) >= 0.8 - near_dedup.ROUNDING:
                linked += 1
                assert bands[keys[a]] & bands[keys[b]]
            if texts[a].endswith(passage) and texts[b].endswith(passage):
                assert not bands[keys[a]] & bands[keys[b]]
    assert linked > 10
