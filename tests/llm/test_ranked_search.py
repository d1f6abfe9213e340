"""Ranked search against a loop over items and documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from marketweave.llm import ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, top):
    counts = [Counter(terms(t)) for _, t in docs]
    n, total = sum(bool(c) for c in counts), sum(c.total() for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        rows = []
        for (doc, _), c in zip(docs, counts, strict=True):
            score = 0
            for t in set(terms(text)) & c.keys():
                m = 50 + 50 * c.total() * n // total
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, r[3], -r[0]) for k, r in enumerate(sorted(rows)[:top])]
    return out


def made(rng):
    words = ["The", "of", "ÉTÉ", "x1", "a-b", "ñ", *[f"w{i}" for i in range(60)]]
    text = lambda n: " ".join(rng.choice(words, n, p=None))
    docs = [(k, text(int(rng.integers(1, 60)))) for k in range(120)]
    docs += [(500, ""), (501, None), (502, "... \x7f"), (None, text(20)), (None, "w1 w2"), (3, docs[3][1]), (3, "w5 w5 w6"), (503, "w7 " * 30_000)]
    items = [(k, text(int(rng.integers(1, 25)))) for k in range(25)]
    return docs, [*items, (3, items[3][1]), (70, ""), (71, None), (72, "nowhere"), (None, "w1 w2 w3")]


@pytest.mark.parametrize(("top", "block_terms", "cells"), [(50, 131_072, 2_000_000), (3, 40, 500)])
def test_search_equals_loop(spark, monkeypatch, top, block_terms, cells):
    monkeypatch.setattr(ranked_search, "CELLS", cells)
    monkeypatch.setattr(ranked_search, "STEP", 300)
    docs, items = made(np.random.default_rng(2))
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, score int").repartition(3)
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, term string")
    got = ranked_search.search(d, i, top, block_terms).collect()
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(ranked(docs, items, top), key=order)


def test_empty_tables(spark):
    some, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    item = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.search(none, item).count() == 0
    assert ranked_search.search(some, item.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in ranked_search.search(some.union(spark.createDataFrame([(2, "c")], some.schema)), item).collect()] == [(1, 1, 1)]


def test_shared_pairs_are_added_once():
    """Items that share terms share nodes: fewer additions than terms, and the sums of each item alone."""
    rng = np.random.default_rng(6)
    common = list(range(30))
    items = [sorted({*common[: int(rng.integers(5, 30))], *rng.integers(30, 200, 10).tolist()}) for _ in range(40)]
    items.append(items[0])
    term = np.concatenate([np.array(i) for i in items])
    item = np.repeat(np.arange(len(items)), [len(i) for i in items])
    plan = ranked_search.share(term, item, 200, len(items))
    assert len(plan.left) < 0.6 * (len(term) - len(items))
    value = rng.integers(0, 1 << 40, (200, 5))
    t, d = (x.ravel() for x in np.meshgrid(np.arange(200), np.arange(5), indexing="ij"))
    got = ranked_search.accumulate(plan, t, d, value.ravel(), 5)
    assert (got == np.array([value[np.array(i)].sum(axis=0) for i in items])).all()
    assert plan.roots[0] == plan.roots[-1]
