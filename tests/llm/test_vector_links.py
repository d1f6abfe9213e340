"""Links between embeddings against all pairs."""

from collections import defaultdict

import numpy as np
import pytest

from marketweave.llm import hnsw, vector_links


def all_pairs(rows):
    """vec_id, links, least id of the component for each row."""
    fine = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    near = defaultdict(list)
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows):
            if i != j and fine[i] and fine[j] and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                    near[i].append(j)
    out = []
    for i, (v, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in near[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        least = min(ids) if ids else None
        out.append((v, len(near[i]), least, v is not None and v == least))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def crowd(rng, n=260, d=8):
    """Vectors by themselves, pairs around the threshold, a chain, and a crowd wider than a ball."""
    x = rng.standard_normal((n, d))
    x[:60] = x[0] + 0.12 * np.linalg.norm(x[0]) / np.sqrt(d) * rng.standard_normal((60, d))
    x[60:120] = x[120:180] + 0.3 * rng.standard_normal((60, d))
    for k in range(180, 200):  # neighbours linked, ends not
        x[k] = x[k - 1] + 0.25 * np.linalg.norm(x[k - 1]) * rng.standard_normal(d) / np.sqrt(d)
    x[200:220] = x[220]
    return x.astype(np.float32)


@pytest.mark.parametrize("shards", [1, 4])
def test_links_equal_all_pairs(spark, monkeypatch, shards):
    monkeypatch.setattr(vector_links, "BEAM", 4)
    monkeypatch.setattr(vector_links, "PIECE", 1000)
    vectors = crowd(np.random.default_rng(5))
    rows = [(int(k), [float(x) for x in v]) for k, v in enumerate(vectors)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [1.0, None] + [0.0] * 6), (1004, [float("nan")] * 8), (1005, [float("inf")] + [1.0] * 7)]
    rows += [(None, rows[3][1]), (None, rows[150][1]), (7, rows[7][1]), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (1008, [-0.0, 1.0]), (1009, [0.0, 1.0]), (None, [-1.0, 0.5])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, key string")
    got = vector_links.links(table, shards=shards).collect()
    assert in_order(map(tuple, got)) == in_order(all_pairs(rows))


def test_the_threshold_itself_links_in_double_precision(spark):
    # a cosine of 19/20 exactly, and one a little below it
    rows = [(1, [1.0, 0, 0, 0, 0]), (2, [19.0, 6, 1, 1, 1]), (3, [0.0, 0, 0, 0, 7]), (4, [1e300, 0, 0, 0, 0]), (5, [18.999999999999, 6, 1, 1, 1])]
    got = vector_links.links(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (2, 1), 2: (3, 1), 3: (0, 3), 4: (2, 1), 5: (1, 1)}


def test_empty_table(spark):
    got = vector_links.links(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"] and got.count() == 0


def test_recall_of_a_graph():
    """Neighbours at the linking cosine are found among random vectors, and each node finds itself."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 48)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, nodes, holder = hnsw.build(x, hnsw.levels(np.arange(3000, dtype=np.uint64)), 0.99)
    assert len(nodes) == 3000 and (nodes[holder] == np.arange(3000)).all()
    every = np.arange(len(nodes))[:, None]
    assert (graph.search(graph.vectors, 16)[0] == every).any(axis=1).all()
    noise = rng.standard_normal(graph.vectors.shape)
    noise -= (noise * graph.vectors).sum(axis=1, keepdims=True) * graph.vectors
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    turned = (0.95 * graph.vectors + np.sqrt(1 - 0.95**2) * noise).astype(np.float32)
    assert (graph.search(turned, 16)[0] == every).any(axis=1).mean() > 0.995
