"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are looked up in a learned embedding; learned filters run over chunks of 2 * STRIDE bytes, each overlapping the
next by half, that cover the whole document; each filter's greatest response is pooled, and the pooled responses are
combined into one probability. The network is fitted on a bounded sample of labelled rows and scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, id_crc, small_batches

#: Labelled rows to fit on at most (those whose ids hash lowest), the bytes of the longest text among them, and of all.
SAMPLE, LONGEST, SAMPLE_BYTES = 4000, 100_000, 64_000_000
#: Shape of the network: embedding, half a chunk, filters.
EMBED, STRIDE, FILTERS = 8, 8, 48
EPOCHS, BATCH, SEED = 8, 32, 7
#: Least score of a document predicted as 1.
CUT = 0.3
_STEP = 1_000_000


def _padded(text: bytes) -> np.ndarray:
    """The text between zero bytes, filled up to whole strides, two at least."""
    size = max(2, -(-(len(text) + 1) // STRIDE))
    out = np.zeros(size * STRIDE, dtype=np.uint8)
    out[1 : len(text) + 1] = np.frombuffer(text, dtype=np.uint8)[: size * STRIDE - 1]
    return out


def _responses(net: dict, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filters' responses to each chunk of flat (a chunk starts at each stride but the last), and the embedded strides."""
    rows = net["embed"][flat].reshape(-1, STRIDE * EMBED)
    return rows[:-1] @ net["first"] + rows[1:] @ net["second"] + net["bias"], rows


def forward(net: dict, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Probability, pooled responses and where each was found, for each text; strides of one text are never mixed with another's."""
    parts = [_padded(t) for t in texts]
    strides = np.array([len(p) // STRIDE for p in parts])
    flat = np.concatenate(parts)
    response, rows = _responses(net, flat)
    ends = np.cumsum(strides)
    starts = ends - strides
    response[ends[:-1] - 1] = -np.inf  # chunks over the border of two texts
    pooled = np.maximum.reduceat(response, starts, axis=0)
    hidden = np.maximum(pooled, 0)
    z = hidden @ net["out"] + net["shift"]
    return 1 / (1 + np.exp(-z)), pooled, response, [starts, ends, rows, flat]


def _step_batch(net: dict, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict:
    p, pooled, response, (starts, ends, rows, flat) = forward(net, texts)
    dz = (p - y) * weight / len(texts)
    hidden = np.maximum(pooled, 0)
    grads = {"out": hidden.T @ dz, "shift": dz.sum()}
    dh = np.outer(dz, net["out"]) * (pooled > 0)
    at = np.stack([starts[i] + np.argmax(response[starts[i] : max(starts[i] + 1, ends[i] - 1)], axis=0) for i in range(len(texts))])
    # only the chunk that gave a filter's greatest response learns
    first = np.stack([dh[:, f] @ rows[at[:, f]] for f in range(FILTERS)], axis=1)
    second = np.stack([dh[:, f] @ rows[at[:, f] + 1] for f in range(FILTERS)], axis=1)
    grads |= {"first": first, "second": second, "bias": dh.sum(axis=0)}
    d, k = dh.ravel()[:, None], at.ravel()
    f = np.tile(np.arange(FILTERS), len(texts))
    both = flat.reshape(-1, STRIDE)
    where = np.concatenate([both[k].ravel(), both[k + 1].ravel()])
    back = np.concatenate([(w.T[f] * d).reshape(-1, EMBED) for w in (net["first"], net["second"])])
    embed = np.stack([np.bincount(where, weights=back[:, e], minlength=256) for e in range(EMBED)], axis=1)
    return grads | {"embed": embed}


def fit(texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """A network fitted by Adam; without both kinds of label its scores are constant."""
    rng = np.random.default_rng(seed)
    net = {
        "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        "first": rng.normal(0, 0.12, (STRIDE * EMBED, FILTERS)).astype(np.float32),
        "second": rng.normal(0, 0.12, (STRIDE * EMBED, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, dtype=np.float32),
        "out": rng.normal(0, 0.2, FILTERS).astype(np.float32),
        "shift": np.float32(0),
    }
    if not len(y) or y.min() == y.max():
        net["out"] *= 0
        net["shift"] = np.float32(4 if not len(y) or y[0] else -4)
        return net
    # both kinds weigh the same in sum
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    moment, square, t = {k: 0.0 for k in net}, {k: 0.0 for k in net}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            own = order[at : at + BATCH]
            grads, t = _step_batch(net, [texts[i] for i in own], y[own], weight[own]), t + 1
            rate = 0.004 * (1 - epoch / (epochs + 1))
            for k, g in grads.items():
                moment[k] = 0.9 * moment[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                net[k] = (net[k] - rate * (moment[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    return net


def score_texts(net: dict, texts: list[bytes]) -> np.ndarray:
    out, begin = [], 0
    while begin < len(texts):
        if len(texts[begin]) > _STEP:
            out.append(_score_long(net, texts[begin]))
            begin += 1
            continue
        end, size = begin, 0
        while end < len(texts) and len(texts[end]) <= _STEP and (end == begin or size + len(texts[end]) < _STEP):
            size += len(texts[end])
            end += 1
        out.append(forward(net, texts[begin:end])[0])
        begin = end
    return np.concatenate(out) if out else np.zeros(0)


def _score_long(net: dict, text: bytes) -> np.ndarray:
    """The same for a text of any length, a piece at a time; pieces share a stride, so that no chunk is missed."""
    flat, pooled = _padded(text), np.full(FILTERS, -np.inf)
    for at in range(0, len(flat) - STRIDE, _STEP // STRIDE * STRIDE):
        response, _ = _responses(net, flat[at : at + _STEP // STRIDE * STRIDE + STRIDE])
        pooled = np.maximum(pooled, response.max(axis=0))
    return np.array([1 / (1 + np.exp(-(np.maximum(pooled, 0) @ net["out"] + net["shift"])))])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> dict:
    """A network from at most sample labelled rows whose crc32(doc_id) mod 5 is not 0 and whose text has at most longest bytes.

    Together their texts have at most SAMPLE_BYTES, which is what the driver receives. Rows with null id or label are left
    out, as are ids with contradicting labels; of several rows of an id, the greatest text counts. Without usable rows,
    or with empty tables, the network is one that has learned nothing.
    """
    small_batches(docs.sparkSession)
    usable = labels.where("doc_id is not null and quality is not null").where(id_crc(F.col("doc_id"), 5) != 0)
    clear = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    chosen = cut(clear.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labels")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).where(F.octet_length("text") <= longest)
    found = cut(
        rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("quality").alias("quality")),
        "labelled"
    )
    # a window without a key over at most sample ids and lengths
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    few = found.select("doc_id", F.octet_length("text").alias("size")).withColumn("sum", F.sum("size").over(upto)).where(F.col("sum") <= SAMPLE_BYTES)
    found = found.join(F.broadcast(few.select("doc_id")), "doc_id", "left_semi").orderBy("doc_id").toPandas()
    return fit([bytes(t) for t in found["text"]], found["quality"].to_numpy(dtype=np.float64))


def score(docs: DataFrame, net: dict, cut_at: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; only the text decides the score. Null texts count as empty.

    Repeated rows are scored each for itself; an empty table gives an empty result. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, texts = (c.to_pylist() for c in batch.columns)
            p = score_texts(shared.value, [t or b"" for t in texts]).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(p), pa.array((p >= cut_at).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"]
            )

    rows = docs.select(
        "doc_id",
        F.coalesce(id_crc(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        F.col("text").cast("binary").alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fits on labels and scores every row of docs; empty tables give an empty result. Other columns are not read."""
    return score(docs, train(docs, labels, sample))
