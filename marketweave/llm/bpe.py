"""Byte-level BPE: encoding and decoding by batched merge rounds in numpy.

Texts are split by the tokenizer's pattern. Words that a worker has not met are encoded together: their byte symbols
lie in one flat array; in each round, adjacent pairs are looked up by binary search among the sorted pair keys of the
merge table, and each word merges its pair of lowest rank wherever it occurs, from left to right, until no pair is left.
Long words have a round for each rank, lowest first, whose pairs stand in an index by rank: such a round looks up no
pairs but those beside its merges, so that a word costs its merges and not its length times its ranks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The split pattern of the vocabulary's format (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that a worker remembers, their bytes, and those of a long word, which is not remembered; at a bound it forgets
#: all and goes on.
MEMORY, MEMORY_BYTES, LONG = 200_000, 32_000_000, 200
_NONE = np.int64(1 << 40)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, and back."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """A vocabulary with its merge table as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of.update({i: t.encode() for t, i in self.added.items()})
        self.first = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.width = max(self.bytes_of) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.split = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in self.added) + ")") if self.added else None
        self.known: dict[str, tuple[str, int, bytes]] = {}
        self.held = 0

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty words as one flat array, and the number of ids of each word."""
        ids = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_ids, done_owner = [], []
        while len(ids) > 1:
            pair = ids[:-1] * self.width + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & (owner[:-1] == owner[1:]), self.rank[at], _NONE)
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(np.append(rank, _NONE), starts)
            size = np.diff(np.append(starts, len(owner)))
            lowest = np.repeat(best, size)
            active = lowest < _NONE
            if not active.any():
                break
            hit = np.flatnonzero((rank == lowest[:-1]) & active[:-1])
            # of hits that overlap (a pair of equal symbols in a run), take the first, third, ... of each run
            run = np.cumsum(np.diff(hit, prepend=-2) != 1)
            place = np.arange(len(hit)) - np.flatnonzero(np.diff(run, prepend=0))[run - 1]
            hit = hit[place % 2 == 0]
            ids[hit] = self.made[rank[hit]]
            stay = np.ones(len(ids), dtype=bool)
            stay[hit + 1] = False
            ended = stay & ~active
            done_ids.append(ids[ended])
            done_owner.append(owner[ended])
            ids, owner = ids[stay & active], owner[stay & active]
        all_ids, all_owner = np.concatenate([*done_ids, ids]), np.concatenate([*done_owner, owner])
        order = np.argsort(all_owner, kind="stable")
        return all_ids[order], np.bincount(all_owner, minlength=len(words))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.rank[at], _NONE)

    def merge_long(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As merge, for words of any length: a round takes all places of the lowest rank that any word has."""
        ids = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        n = len(ids)
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank, alive = np.full(n, _NONE), np.ones(n, dtype=bool)
        places: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def file(at: np.ndarray) -> None:
            """Looks up the pairs that begin at the given places, and files them by rank."""
            after = following[at]
            here = at[after < n]
            here = here[owner[here] == owner[following[here]]]
            rank[at] = _NONE
            rank[here] = self._ranks(ids[here], ids[following[here]])
            here = here[rank[here] < _NONE]
            here = here[np.argsort(rank[here], kind="stable")]
            cuts = np.flatnonzero(np.diff(rank[here], prepend=-1))
            for k, part in zip(rank[here[cuts]].tolist(), np.split(here, cuts[1:]) if len(cuts) else (), strict=True):
                if k not in places:
                    places[k] = []
                    heapq.heappush(waiting, k)
                places[k].append(part)

        file(np.arange(n))
        while waiting:
            lowest = heapq.heappop(waiting)
            filed = places.pop(lowest)
            hit = np.unique(np.concatenate(filed)) if len(filed) > 1 else filed[0]
            hit = hit[rank[hit] == lowest]
            if not len(hit):
                continue
            # of hits that overlap, take the first, third, ... of each run
            run = np.cumsum(np.append(True, following[hit[:-1]] != hit[1:]))
            place = np.arange(len(hit)) - np.flatnonzero(np.diff(run, prepend=0))[run - 1]
            hit = hit[place % 2 == 0]
            gone = following[hit]
            after = following[gone]
            ids[hit] = self.made[lowest]
            alive[gone], rank[gone] = False, _NONE
            following[hit] = after
            inside = after < n
            before[after[inside]] = hit[inside]
            left = before[hit]
            file(np.unique(np.concatenate([hit, left[left >= 0]])))
        return ids[alive], np.bincount(owner[alive], minlength=len(words))

    def learn(self, words: list[str]) -> None:
        """Encodes new words and keeps, for each, its ids as text, their number and the bytes that the ids decode to."""
        long = [w for w in words if len(w) > LONG]
        words = [w for w in words if len(w) <= LONG] if long else words
        for part, merge in [(words[at : at + 20_000], self.merge) for at in range(0, len(words), 20_000)] + [(long, self.merge_long)] * bool(long):
            ids, n = merge([w.encode() for w in part])
            flat, ends = ids.tolist(), np.cumsum(n).tolist()
            begin = 0
            for word, end in zip(part, ends, strict=True):
                own = flat[begin:end]
                self.known[word] = (",".join(map(str, own)), end - begin, self.decode(own))
                self.held += 8 * len(word)
                begin = end

    def words(self, text: str) -> list[str]:
        if any(t in text for t in self.added):
            return [w for i, part in enumerate(self.specials.split(text)) for w in ([part] if i % 2 else self.split.findall(part))]
        return self.split.findall(text)

    def encode(self, texts: list[str]) -> Iterator[tuple[str, int, bytes]]:
        """For each text its ids joined by commas, their number, and the bytes that the ids decode to."""
        at = 0
        while at < len(texts):
            # texts of about a million characters are encoded together
            part, size = [], 0
            while at < len(texts) and (not part or size < 1_000_000):
                part.append(self.words(texts[at]))
                size += len(texts[at])
                at += 1
            met = set().union(*part)
            new = met - self.known.keys()
            if len(self.known) + len(new) > MEMORY or self.held > MEMORY_BYTES:
                self.known.clear()
                self.held, new = 0, met
            self.learn([w for w in new if w not in self.added])
            self.known.update({t: (str(i), 1, self.bytes_of[i]) for t, i in self.added.items()})
            for words in part:
                found = [self.known[w] for w in words]
                yield ",".join([f[0] for f in found]), sum([f[1] for f in found]), b"".join([f[2] for f in found])
            for w in [w for w in new if len(w) > LONG and w not in self.added]:
                self.held -= 8 * len(w)
                del self.known[w]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encode(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path or default_path())
        for batch in batches:
            doc, texts = (c.to_pylist() for c in batch.columns)
            sha = lambda x: hashlib.sha256(x).hexdigest()
            out = [(n, sha(ids.encode()), sha(back)) for ids, n, back in own.encode([t or "" for t in texts])]
            n, ids, back = zip(*out, strict=True) if out else ((), (), ())
            columns = [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; path is the vocabulary file (None: byte_bpe_50k.json).

    Null texts count as empty and have no token. Special tokens' strings in a text become the special ids, as in the
    tokenizers library. The decoded text is made of the ids, not of the input. Repeated rows are encoded each for itself.
    Other columns are not read; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_encode(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of each row; null texts have an empty array, an empty table gives an empty result."""
    small_batches(docs.sparkSession)

    def run(batches):
        own = tokenizer(path or default_path())
        for batch in batches:
            doc, texts = (c.to_pylist() for c in batch.columns)
            ids = [[int(i) for i in x.split(",")] if x else [] for x, _, _ in own.encode([t or "" for t in texts])]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of (doc_id, ids); bytes that are no UTF-8 become replacement characters, null ids a null text."""
    small_batches(rows.sparkSession)

    def run(batches):
        own = tokenizer(path or default_path())
        for batch in batches:
            doc, ids = (c.to_pylist() for c in batch.columns)
            text = [None if x is None else own.decode(x).decode("utf-8", "replace") for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(text, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
