"""Components from links, against a search of the graph."""

import numpy as np
import pytest

from marketweave.llm import near_dedup


def searched(links):
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    root = {}
    for start in sorted(near):
        todo = [] if start in root else [start]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = start
                todo += near[x]
    return root


def graphs():
    rng = np.random.default_rng(7)
    path = [(i + 1, i) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(300)]
    random = [(int(a), int(b)) for a, b in rng.integers(2000, 2400, (300, 2))]
    loops = [(5000, 5000), (5001, 5002), (5002, 5001), (5001, 5002)]
    some = path + star + random + loops
    return [some[i] for i in rng.permutation(len(some))]


@pytest.mark.parametrize(("chunk", "broadcast"), [(7, 0), (100, 10**6), (10**6, 10**6)])
def test_components_equal_a_search(spark, monkeypatch, chunk, broadcast):
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    monkeypatch.setattr(near_dedup, "MOST_BROADCAST", broadcast)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    links = graphs()
    found = near_dedup.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()
    assert len(found) == len({r.key for r in found})
    assert {r.key: r.root for r in found} == searched(links)


def test_binary_keys_and_stars_of_one_chunk():
    import pyarrow as pa

    links = [(b"%05d" % a, b"%05d" % b) for a, b in graphs()]
    batches = [pa.RecordBatch.from_arrays([pa.array([x[k] for x in part], pa.binary()) for k in (0, 1)], names=["a", "b"]) for part in (links[:50], links[50:])]
    got = near_dedup._contracted(batches)
    found = dict(zip(got.column("key").to_pylist(), got.column("root").to_pylist(), strict=True))
    assert found == searched(links) | {b"05000": b"05000"}


def test_no_links(spark):
    assert near_dedup.components(spark.createDataFrame([], "a binary, b binary")).collect() == []
