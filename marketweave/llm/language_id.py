"""Language identification: multinomial naive Bayes over hashed character n-grams.

Spark counts hashed n-grams by language over all learnable documents; the log-probability matrix (languages x BUCKETS
float32 values) is broadcast, and batches of texts are scored as sparse counts in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_crc, small_batches

#: Hash buckets of the n-grams.
BUCKETS = 1 << 14
#: Lengths of the n-grams, in characters (code points).
ORDERS = (1, 2, 3, 4)
#: Languages that a model may have; the matrix then stays under MAX_LANGS * BUCKETS * 4 bytes (32 MB).
MAX_LANGS = 512
#: Characters handled at once inside a batch.
_STEP = 300_000
#: Odd factors of the hash.
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_LETTER = regex.compile(r"\p{L}")


def _grams(flat: np.ndarray, part: np.ndarray, fresh: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Start and bucket of each n-gram inside a part, for each order in turn; its last character is fresh."""
    code = np.zeros(len(flat), dtype=np.uint64)
    wide = flat.astype(np.uint64) + np.uint64(1)
    for n in range(1, max(ORDERS) + 1):
        if len(flat) < n:
            return
        code = code[: len(flat) - n + 1] * _BASE + wide[n - 1 :]
        if n in ORDERS:
            at = np.flatnonzero((part[: len(code)] == part[n - 1 :]) & fresh[n - 1 :])
            yield at, ((code[at] * _SPREAD) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)


def _flat(held: list[tuple[int, str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = np.frombuffer("".join(p for _, p, _ in held).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    flat[(flat >= 65) & (flat <= 90)] += np.uint32(32)
    sizes = np.array([len(p) for _, p, _ in held])
    owner = np.repeat([i for i, _, _ in held], sizes)
    # the characters that a part repeats from the one before it
    again = np.array([lead for _, _, lead in held])
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return flat, owner, place >= np.repeat(again, sizes)


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Flat code points (letter case of A-Z dropped), the text's number and whether it is new for each, about _STEP at a time.

    A piece never holds two parts of one text.
    """
    held, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t), _STEP):
            lead = min(at, max(ORDERS) - 1)
            held.append((i, t[at - lead : at + _STEP], lead))
            size += len(held[-1][1])
            if size >= _STEP:
                yield _flat(held)
                held, size = [], 0
    if held:
        yield _flat(held)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, count) of what this task has read."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.columns[0].to_pylist(), batch.columns[1].to_pylist()
        for lang in set(langs):
            total = sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            for piece in _pieces([t.decode("utf-8", "replace") for x, t in zip(langs, texts, strict=True) if x == lang and t]):
                for _, grams in _grams(*piece):
                    total += np.bincount(grams, minlength=BUCKETS)
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])],
            names=["lang", "bucket", "n"]
        )


def train(docs: DataFrame, usable: Column) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log probabilities by bucket, counted over all rows where usable holds.

    Rows with null text or null lang are not learned from. Without any usable row the model knows no language.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.col("text").cast("binary").alias("text"))
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    arrays = counts.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")).limit(MAX_LANGS + 1).collect()
    if len(arrays) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages to learn")
    arrays.sort(key=lambda r: r["lang"])
    matrix = np.zeros((len(arrays), BUCKETS), dtype=np.float64)
    for i, r in enumerate(arrays):
        matrix[i, r["b"]] = r["n"]
    matrix += 0.5
    logs = np.log(matrix / matrix.sum(axis=1, keepdims=True))
    # multiples of 2 ** -20, so that sums are exact in any order
    return [r["lang"] for r in arrays], (np.round(logs * (1 << 20)) / (1 << 20)).astype(np.float32)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs = model.value
        columns = np.ascontiguousarray(logs.T, dtype=np.float64)
        for batch in batches:
            ids, held, raw = (c.to_pylist() for c in batch.columns)
            texts = [(t or b"").decode("utf-8", "replace") for t in raw]
            sums = np.zeros((len(texts), len(langs)), dtype=np.float64)
            for flat, owner, fresh in _pieces(texts):
                if not langs:
                    break
                first = int(owner[0])
                keys, base = [], int(owner[-1]) - first + 1
                for at, grams in _grams(flat, owner, fresh):
                    keys.append((owner[at] - first) * BUCKETS + grams)
                # sparse counts of each text: its distinct buckets and how often they occur
                if base * BUCKETS <= 4_000_000:
                    total = np.bincount(np.concatenate(keys), minlength=base * BUCKETS).reshape(base, BUCKETS)
                    sums[first : first + base] += total.astype(np.float64) @ columns
                else:
                    at, n = np.unique(np.concatenate(keys), return_counts=True)
                    row, bucket = at // BUCKETS, at % BUCKETS
                    for k in range(len(langs)):
                        sums[first : first + base, k] += np.bincount(row, weights=n * logs[k, bucket].astype(np.float64), minlength=base)
            known = [bool(_LETTER.search(t)) and bool(langs) for t in texts]
            if langs:
                sums -= sums.max(axis=1, keepdims=True)
                chance = np.exp(sums)
                chance /= chance.sum(axis=1, keepdims=True)
                best = chance.argmax(axis=1)
            pred = [langs[best[i]] if k else "und" for i, k in enumerate(known)]
            score = [float(chance[i, best[i]]) if k else 0.0 for i, k in enumerate(known)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"]
            )

    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the posterior) of each row; only the text decides.

    Null texts and texts without a letter give und with score 0, as does every text under a model without languages.
    Equal scores give the language that sorts first. Repeated rows are predicted each for itself; an empty table gives an
    empty result. Other columns of docs are not read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_score(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learns from documents whose crc32(doc_id) mod 4 is not 2 (rows with null ids are not learned from), and predicts all.

    Each repeated row counts once more in what is learned. Without a usable row every prediction is und.
    """
    held = id_crc(F.col("doc_id"), 4) == 2
    return predict(docs, train(docs, F.coalesce(~held, F.lit(False))), held)


def keep_known(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The rows whose language is recognised with a posterior of at least min_score; und rows go."""
    small_batches(docs.sparkSession)
    held = id_crc(F.col("doc_id"), 4) == 2
    model = docs.sparkSession.sparkContext.broadcast(train(docs, F.coalesce(~held, F.lit(False))))

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        raw = [None if t is None else t.encode() for t in texts]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(range(len(raw)), pa.int64()), pa.array([False] * len(raw)), pa.array(raw, pa.binary())],
            names=["doc_id", "held_out", "text"]
        )
        out = next(_score(model)(iter([batch]))).to_pydict()
        return pd.Series([p != "und" and s >= min_score for p, s in zip(out["lang_pred"], out["score"], strict=True)])

    return docs.where(known("text"))
