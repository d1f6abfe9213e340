"""Quality rules: text statistics, fixed base rules, and a learned decision list.

The list is learned by sequential covering: conjunctions of thresholds are grown on one part of a labelled sample by
information gain and pruned on the other, one rule after the other, each on the rows that earlier rules leave. The
result is an ordered chain of Spark conditions over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, flat_words, small_batches, windows

#: Base rules (fixed values): least words, and the most words in repeated windows, in percent; words of a window.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
#: Labelled rows that a list is learned from, at most: those whose ids hash lowest.
SAMPLE = 8000
#: Share of clean rows that a rule may hit on its pruning part, and rules of a list.
MOST_WRONG, MOST_RULES = 0.02, 12
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_marks", "n_top")
#: What rules look at, as shares of the statistics.
FEATURES = {
    "mean_word": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeated": ("n_repeat_words", "n_words"),
    "distinct": ("n_distinct", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "marks": ("n_marks", "n_words"),
    "top_word": ("n_top", "n_words"),
    "words_a_line": ("n_words", "n_lines"),
}


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = {"doc_id": pa.int64()} | dict.fromkeys(STATS, pa.int64())
    for batch in batches:
        ids, texts = batch.columns[0].to_pylist(), [t or "" for t in batch.columns[1].to_pylist()]
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size < 2_000_000):
                size += len(texts[end])
                end += 1
            part = texts[begin:end]
            raw = [t.encode() for t in part]
            hashes, _, owner, flat = flat_words(raw, lower=False)
            capital = np.append(0, np.cumsum((flat >= 65) & (flat <= 90)))
            ends = np.cumsum([len(t) + 1 for t in raw])
            upper = capital[ends] - capital[ends - np.array([len(t) + 1 for t in raw])]
            n_words = np.bincount(owner, minlength=len(part))
            found, first = windows(hashes, owner, WINDOW)
            repeated = np.zeros(len(hashes) + 1, dtype=np.int64)
            if len(found):
                at = owner[first]
                order = np.lexsort((found, at))
                f, o = found[order], at[order]
                same = (f[1:] == f[:-1]) & (o[1:] == o[:-1])
                twice = np.zeros(len(f), dtype=bool)
                twice[1:] |= same
                twice[:-1] |= same
                hit = first[order[twice]]
                np.add.at(repeated, hit, 1)
                np.add.at(repeated, hit + WINDOW, -1)
            covered = np.cumsum(repeated)[:-1] > 0
            order = np.lexsort((hashes, owner))
            h, o = hashes[order], owner[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
            starts = np.flatnonzero(new)
            runs = np.diff(np.append(starts, len(h)))
            top = np.zeros(len(part), dtype=np.int64)
            np.maximum.at(top, o[starts], runs)
            chars, symbols, dup, lines, marks = [], [], [], [], []
            for text in part:
                chars.append(len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")))
                symbols.append(sum(map(text.count, SYMBOLS)))
                with_word = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
                lines.append(len(with_word))
                dup.append(len(with_word) - len(set(with_word)))
                marks.append(text.count("!") + text.count("?"))
            columns = [
                ids[begin:end],
                n_words,
                chars,
                symbols,
                dup,
                np.bincount(owner[covered], minlength=len(part)),
                lines,
                np.bincount(o[starts], minlength=len(part)),
                upper,
                marks,
                top
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))
            begin = end


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of each row, over whole texts; null texts count as empty and have zeros."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_stats, ", ".join(["doc_id long", *[f"{s} long" for s in STATS]]))


def feature(name: str) -> Column:
    part, whole = FEATURES[name]
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    limit: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.name)]
        return v > self.limit if self.above else v <= self.limit

    def column(self) -> Column:
        return feature(self.name) > self.limit if self.above else feature(self.name) <= self.limit


Rule = tuple[Condition, ...]


def _hits(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        out &= c.holds(x, names)
    return out


def _best(x: np.ndarray, bad: np.ndarray, names: list[str]) -> tuple[float, Condition | None]:
    """The condition of most information gain for the bad rows of x."""
    before, best, found = np.log2(bad.mean()), 1e-9, None
    for j, name in enumerate(names):
        order = np.argsort(x[:, j], kind="stable")
        v, b = x[order, j], bad[order]
        cuts = np.flatnonzero(v[1:] > v[:-1])
        if not len(cuts):
            continue
        p_low, n_low = np.cumsum(b)[cuts], cuts + 1
        for above, p, n in ((False, p_low, n_low), (True, b.sum() - p_low, len(b) - n_low)):
            gain = p * (np.log2(np.maximum(p, 1e-9) / n) - before)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = float(gain[k]), Condition(name, above, float((v[cuts[k]] + v[cuts[k] + 1]) / 2))
    return best, found


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], seed: int = 0) -> list[Rule]:
    """An ordered list of rules for the bad rows; empty if there is nothing to learn."""
    rng, rules, left = np.random.default_rng(seed), [], np.ones(len(x), dtype=bool)
    while len(rules) < MOST_RULES and bad[left].sum() >= 5 and (~bad[left]).any():
        at = rng.permutation(np.flatnonzero(left))
        grow, prune = at[: 2 * len(at) // 3], at[2 * len(at) // 3 :]
        rule, rows = (), grow
        while bad[rows].any() and not bad[rows].all() and len(rule) < 4:
            _, condition = _best(x[rows], bad[rows], names)
            if condition is None:
                break
            rule += (condition,)
            rows = rows[condition.holds(x[rows], names)]

        def worth(r: Rule, on: np.ndarray = prune) -> float:
            hit = _hits(r, x[on], names)
            p, n = (hit & bad[on]).sum(), (hit & ~bad[on]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = _hits(rule, x[prune], names) if rule else np.zeros(len(prune), dtype=bool)
        wrong = (hit & ~bad[prune]).sum()
        if not rule or not (hit & bad[prune]).any() or worth(rule) < 0.6 or wrong > MOST_WRONG * max(1, (~bad[prune]).sum()):
            break
        rules.append(rule)
        left &= ~_hits(rule, x, names)
    return rules


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules learned from at most sample labelled ids; rows with null id or label are left out, ids of contradicting labels
    too. Of several rows of an id, the greatest text counts. Without usable rows, or with empty tables, no rule is learned."""
    clear = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality"),
        F.max("quality").alias("most")
    ).where("quality = most")
    chosen = cut(clear.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labels")
    few = docs.select("doc_id", "text").join(
        F.broadcast(chosen.select("doc_id")),
        "doc_id",
        "left_semi"
    ).groupBy("doc_id").agg(F.max("text").alias("text"))
    rows = statistics(few).where(~base_failed()).join(F.broadcast(chosen), "doc_id").select(
        "quality",
        *[feature(n).alias(n) for n in FEATURES]
    ).orderBy("quality", *FEATURES).toPandas()
    names = list(FEATURES)
    return learn(rows[names].to_numpy(dtype=np.float64), rows["quality"].to_numpy() == 0, names)


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """Whether the list keeps a row, and the number of the rule that decided (0: none), as ordered conditions."""
    keep, number = None, None
    for i, rule in enumerate(rules):
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        keep = F.when(holds, False) if keep is None else keep.when(holds, False)
        number = F.when(holds, i + 1) if number is None else number.when(holds, i + 1)
    return (F.lit(True), F.lit(0)) if keep is None else (keep.otherwise(True), number.otherwise(0))


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    rule (the number of the learned rule that dropped the row, 0 if none).

    Null texts count as empty and fail the base rules. Without usable labels all that pass the base rules are kept.
    Repeated rows are judged each for itself; an empty table gives an empty result; other columns are not read. Words are
    compared by 64-bit hashes.
    """
    keep, number = verdict(train(docs, labels, sample))
    out = statistics(docs)
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & keep).alias("kept"),
        F.when(base_failed(), 0).otherwise(number).alias("rule")
    )
