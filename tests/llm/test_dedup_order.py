"""Exact duplicates of an input whose rows come in another order each time it is read."""

from pyspark.sql import functions as F

from marketweave.llm import exact_dedup


def test_rows_may_come_in_any_order(spark):
    texts = [f"text {k % 40} " * (1 + k % 7) for k in range(300)] + ["same"] * 200
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {}
    for k, t in enumerate(texts):
        want[t] = max(want.get(t, 0), k)
    # another order and other partitions at each evaluation, as a retried shuffle may give
    shaken = table.withColumn("r", F.rand()).repartition(5, F.rand()).sortWithinPartitions("r").drop("r")
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.duplicates(shaken, block_bytes=16).collect()}
    assert got == {k: (want[t], k == want[t]) for k, t in enumerate(texts)}
