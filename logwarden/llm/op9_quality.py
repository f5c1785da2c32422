"""Quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees are grown on the statistics of labelled rows; each path from a root to a node is a conjunctive rule.
A logistic model with an L1 penalty keeps few rules, and the kept ones become one Spark column expression. The statistics
are one pass over whole texts; scoring is that expression over their table, without Python.

Fitting reads the statistics of at most ``sample`` labelled rows, those with the smallest hash of the id.

Cases: a null text counts as empty, and an empty text has all statistics 0 and is scored like any other; without labelled rows, or with
labels of one kind only, the score is that kind's share (0.5 without any); null labels are not learned from, and an id with several
labels counts with each; repeated rows are scored each on their own; a null id is scored, never learned from and not held out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm.common import fold, hash_share, keyed_text, map_batches, ship, table
from logwarden.llm.text import blocks, hash_words, utf8, word_bounds
from logwarden.session import materialise

SAMPLE = 8000
#: Least score of a row that is predicted to be of good quality.
GOOD = 0.7

_CLASSES = np.zeros(256, np.int64)  # 0 other signs, 1 small letters, 2 capitals, 3 digits, 4 white space, 5 line ends, 6 bytes over 127, 7 .,
_CLASSES[97:123], _CLASSES[65:91], _CLASSES[48:58] = 1, 2, 3
_CLASSES[[32, 9, 11, 12, 13]], _CLASSES[10], _CLASSES[128:], _CLASSES[[44, 46]] = 4, 5, 6, 7
_FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80

STATISTICS = [
    "chars", "words", "word_length", "small_letters", "capitals", "digits", "signs", "points", "wide_letters", "white_space",
    "different_words", "word_entropy", "top_word", "lines", "repeated_lines", "repeated_line_chars", "short_words", "long_words",
]


def statistics(column: pa.Array) -> np.ndarray:
    """Rows by ``STATISTICS``: log counts, and shares between 0 and 1; all 0 for an empty text."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    out = np.zeros((n, len(STATISTICS)))
    for lo, hi in blocks(offsets, 1 << 22):
        part = offsets[lo : hi + 1]
        hashes, firsts = hash_words(data, part)
        starts, ends, _ = word_bounds(data, part)
        lengths = ends - starts
        for row in range(lo, hi):
            a, b = int(offsets[row]), int(offsets[row + 1])
            if a == b:
                continue
            raw = data[a:b]
            kinds = np.bincount(_CLASSES[raw], minlength=8)
            size = b - a
            own = slice(firsts[row - lo], firsts[row - lo + 1])
            words = int(own.stop - own.start)
            line = raw.tobytes().split(b"\n")
            seen: set[bytes] = set()
            again = [len(x) for x in line if x in seen or seen.add(x)]
            if words:
                _, counts = np.unique(hashes[own], return_counts=True)
                share = counts / words
                entropy = -(share * np.log(share)).sum() / np.log(words) if words > 1 else 1.0
                length = lengths[own]
                of_words = (len(counts) / words, entropy, share.max())
                by_length = (length.mean(), (length <= 2).mean(), (length >= 15).mean())
            else:
                of_words, by_length = (0, 0, 0), (0, 0, 0)
            out[row] = (
                np.log1p(_FIRST_BYTE[raw].sum()), np.log1p(words), by_length[0], kinds[1] / size, kinds[2] / size, kinds[3] / size, kinds[0] / size, kinds[7] / size,
                kinds[6] / size, (kinds[4] + kinds[5]) / size, *of_words, np.log1p(len(line)), len(again) / len(line), sum(again) / size, *by_length[1:],
            )
    return out


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of each row's whole text."""
    ship(docs.sparkSession)

    def measure(batch: pa.RecordBatch) -> dict:
        rows = statistics(batch.column(1))
        return {"doc_id": batch.column(0)} | {name: pa.array(rows[:, i]) for i, name in enumerate(STATISTICS)}

    return map_batches(keyed_text(docs, id_col, text_col), measure, "doc_id long, " + ", ".join(f"{x} double" for x in STATISTICS))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, limit), all of which must hold


@dataclass
class RuleEnsemble:
    bias: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def column(self) -> Column:
        """The score as an expression over columns named as ``STATISTICS``."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for i, above, limit in rule:
                holds = holds & (F.col(STATISTICS[i]) > F.lit(limit) if above else F.col(STATISTICS[i]) <= F.lit(limit))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        if self.rules:
            total = total + fired(x, self.rules) @ np.array(self.weights)
        return 1 / (1 + np.exp(-total))


def fired(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for i, above, limit in rule:
            out[:, k] *= (x[:, i] > limit) if above else (x[:, i] <= limit)
    return out


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 24) -> list[Rule]:
    """Paths of boosted trees; each tree sees half of the rows and of the statistics."""
    rng = np.random.default_rng(11)
    limits = [np.unique(np.quantile(x[:, i], np.linspace(0.02, 0.98, bins))) for i in range(x.shape[1])]
    binned = np.stack([np.searchsorted(limits[i], x[:, i], "left") for i in range(x.shape[1])], 1)
    margin, rules = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        columns = rng.permutation(x.shape[1])[: max(1, x.shape[1] // 2)]
        todo = [((), np.flatnonzero(rng.random(len(y)) < 0.5), np.arange(len(y)), 0)]
        while todo:
            path, rows, every, level = todo.pop()
            best = (1e-3, None, None)
            total_g, total_h = g[rows].sum(), h[rows].sum()
            if level < depth and len(rows) >= 20:
                for i in columns:
                    if not len(limits[i]):
                        continue
                    left_g = np.cumsum(np.bincount(binned[rows, i], g[rows], len(limits[i]) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(binned[rows, i], h[rows], len(limits[i]) + 1))[:-1]
                    few = np.cumsum(np.bincount(binned[rows, i], minlength=len(limits[i]) + 1))[:-1]
                    gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                    gain[(few < 8) | (few > len(rows) - 8)] = -1
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (gain[j], i, j)
            if best[1] is None:
                margin[every] += rate * total_g / (total_h + 1)
                continue
            _, i, j = best
            for above in (False, True):
                new = (*path, (int(i), above, float(limits[i][j])))
                rules[tuple(sorted(new))] = None
                todo.append((new, rows[(binned[rows, i] > j) == above], every[(binned[every, i] > j) == above], level + 1))
    return list(rules)


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 0.002, rounds: int = 400) -> RuleEnsemble:
    """Rules with the weights of a logistic model under an L1 penalty, by accelerated proximal steps."""
    if len(y) == 0:
        return RuleEnsemble(0.0)
    if y.min() == y.max():
        return RuleEnsemble(30.0 if y[0] else -30.0)
    rules = grow_rules(x, y)
    f = fired(x, rules)
    scale = np.maximum(f.std(0), 0.05)
    z = (f - f.mean(0)) / scale
    w, b = np.zeros(z.shape[1]), np.log(y.mean() / (1 - y.mean()))
    step = 4.0 * len(y) / max(np.linalg.norm(z, 2) ** 2, 1e-9)
    vw, vb = w, b
    for k in range(rounds):
        g = (1 / (1 + np.exp(-np.clip(z @ vw + vb, -30, 30))) - y) / len(y)
        new = vw - step * (z.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = vb - min(step, 4.0) * g.sum()
        pull = k / (k + 3)
        vw, vb, w, b = new + pull * (new - w), new_b + pull * (new_b - b), new, new_b
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    real = w / scale
    return RuleEnsemble(float(b - (f.mean(0) * real).sum()), [rules[i] for i in kept], [float(real[i]) for i in kept])


def fit_quality(measured: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", sample: int = SAMPLE) -> RuleEnsemble:
    """Ensemble from the statistics of labelled rows whose ``doc_id`` passes ``usable``."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).where(usable & F.col("label").isNotNull())
    rows = measured.join(hash_share(marked, "doc_id", sample, marked.count()), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "label", *STATISTICS).limit(sample).toPandas()
    return fit_rules(rows[STATISTICS].to_numpy(float).reshape(-1, len(STATISTICS)), (rows["label"].to_numpy(float) > 0.5).astype(float))


def score_quality(measured: DataFrame, model: RuleEnsemble, good: float = GOOD) -> DataFrame:
    """The table of statistics with score and predicted."""
    return measured.withColumn("score", model.column()).withColumn("predicted", F.when(F.col("score") >= good, 1).otherwise(0))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: a quality score for every whole text of ``documents``, learned from three quarters of the ids."""
    measured = materialise(text_statistics(table(spark, sf_dir, "documents")), "statistics")
    model = fit_quality(measured, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return score_quality(measured, model).select("doc_id", held_out, "score", "predicted")
