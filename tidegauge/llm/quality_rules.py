"""Quality rules: an isolation forest on the statistics that text rules look at.

The statistics of every whole text are counted once.  A forest of random splits is
grown on a bounded, hashed sample of documents; a document that few splits isolate
is anomalous.  The cut is calibrated on the labelled documents of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import arrow_pass, best_threshold, hashed_sample, text_bytes
from tidegauge.session import written

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_distinct", "n_upper", "n_letters", "n_marks", "n_stops", "n_digits"]
STATS = COUNTS + MORE

_CLASS = np.zeros((256, 7), np.int64)
_CLASS[:, 0] = 1  # code points: all but continuation bytes
_CLASS[128:192, 0] = 0
for _i in (9, 10, 11, 12, 13, 32):
    _CLASS[_i, 0] = 0
for _i in b"#*$%&|<>":
    _CLASS[_i, 1] = 1
_CLASS[65:91, 2] = 1
_CLASS[65:91, 3] = 1
_CLASS[97:123, 3] = 1
for _i in b"!?":
    _CLASS[_i, 4] = 1
for _i in b".,;:":
    _CLASS[_i, 5] = 1
_CLASS[48:58, 6] = 1


def _repeated(words: list[bytes]) -> tuple[int, int]:
    """Words in three-word windows found twice or more; distinct words."""
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    v = len(numbers)
    if len(ids) < 4:
        return 0, v
    pair = ids[:-1] * v + ids[1:]
    if v >= 1 << 20:  # keep the triple below 2^63
        pair = np.unique(pair, return_inverse=True)[1]
    triple = pair[:-1] * v + ids[2:]
    ordered = np.sort(triple)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0, v
    window = np.isin(triple, twice)
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : shift + len(window)] |= window
    return int(covered.sum()), v


def text_statistics(raw: bytes) -> list[int]:
    """The values of ``STATS`` for one text."""
    words = raw.split()
    if not words:
        return [0] * len(STATS)
    classes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeated, distinct = _repeated(words)
    word_chars, symbols, upper, letters, marks, stops, digits = classes.tolist()
    return [
        len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated,
        len(lines), distinct, upper, letters, marks, stops, digits,
    ]


def base_failed(stats: np.ndarray) -> np.ndarray:
    """Under 50 words, or more than half of the words in repeated windows."""
    words, repeated = stats[:, 0], stats[:, STATS.index("n_repeat_words")]
    return (words < 50) | (100 * repeated > 50 * words)


def features(stats: np.ndarray) -> np.ndarray:
    """Ratios on which the forest splits."""
    s = {name: stats[:, i].astype(np.float64) for i, name in enumerate(STATS)}
    words, lines = np.maximum(s["n_words"], 1), np.maximum(s["n_lines"], 1)
    chars = np.maximum(s["word_chars"], 1)
    return np.column_stack(
        [
            s["word_chars"] / words,
            np.log1p(20 * s["n_symbols"] / words),
            np.sqrt(s["n_dup_lines"] / lines),
            np.sqrt(s["n_repeat_words"] / words),
            np.sqrt(s["n_upper"] / np.maximum(s["n_letters"], 1)),
            np.sqrt(s["n_marks"] / words),
            np.sqrt(s["n_stops"] / words),
            np.log(s["n_distinct"]  + 1) / np.log(words + 1),
            np.sqrt(s["n_digits"] / chars),
        ]
    )


@dataclass(frozen=True)
class ForestParameters:
    """Size of the forest, and the price of a lost good document against a caught bad one.

    The forest is fitted on at most ``trees * rows_per_tree`` rows.  A statistic is
    split on in proportion to how well it alone parts good from bad among at most
    ``labelled`` labelled rows, and not at all below ``least_weight``: rare but
    harmless traits, such as digits, then isolate nobody.
    """

    trees: int = 100
    rows_per_tree: int = 256
    good_weight: float = 3.0
    labelled: int = 20_000
    least_weight: float = 0.15
    seed: int = 11


def split_weights(x: np.ndarray, good: np.ndarray, least: float) -> np.ndarray:
    """|2 AUC - 1| of each column, 0 below ``least``; all 1 if nothing is left."""
    ones = np.ones(x.shape[1])
    if not len(good) or good.min() == good.max():
        return ones
    n1, n0 = good.sum(), (~good).sum()
    weights = np.zeros(x.shape[1])
    for j in range(x.shape[1]):
        _, place, count = np.unique(x[:, j], return_inverse=True, return_counts=True)
        rank = (np.cumsum(count) - (count - 1) / 2)[place]
        auc = (rank[good].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
        weights[j] = abs(2 * auc - 1)
    weights[weights < least] = 0
    return weights if weights.any() else ones


class IsolationForest:
    """Trees in heap order: the children of node i are 2i+1 and 2i+2."""

    def __init__(self, sample: np.ndarray, how: ForestParameters, weights: np.ndarray | None = None):
        self.weights = np.ones(sample.shape[1]) if weights is None else weights
        rng = np.random.default_rng(how.seed)
        depth = int(np.ceil(np.log2(max(2, how.rows_per_tree))))
        nodes = 2 ** (depth + 1) - 1
        self.depth = depth
        self.feature = np.full((how.trees, nodes), -1, np.int16)
        self.cut = np.zeros((how.trees, nodes))
        self.path = np.zeros((how.trees, nodes))
        size = min(how.rows_per_tree, len(sample))
        for t in range(how.trees):
            rows = sample[rng.permutation(len(sample))[:size]]
            self._grow(t, 0, rows, 0, rng)
        self.mean_path = max(self._mean_path(size), 1e-9)

    @staticmethod
    def _mean_path(n: int) -> float:
        """Mean path length of a failed search among ``n`` rows."""
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def _grow(self, t: int, node: int, rows: np.ndarray, depth: int, rng) -> None:
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
        open_ = np.nonzero((high > low) & (self.weights > 0))[0] if len(rows) else np.zeros(0, int)
        if depth == self.depth or len(rows) < 2 or not len(open_):
            self.path[t, node] = depth + self._mean_path(len(rows))
            return
        f = int(rng.choice(open_, p=self.weights[open_] / self.weights[open_].sum()))
        cut = rng.uniform(low[f], high[f])
        self.feature[t, node], self.cut[t, node] = f, cut
        right = rows[:, f] >= cut
        self._grow(t, 2 * node + 1, rows[~right], depth + 1, rng)
        self._grow(t, 2 * node + 2, rows[right], depth + 1, rng)

    def normality(self, x: np.ndarray) -> np.ndarray:
        """1 - 2^(-mean path / expected path): high for ordinary rows."""
        if not len(x):
            return np.zeros(0)
        trees = np.arange(len(self.feature))[None, :]
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            f = self.feature[trees, node]
            step = 2 * node + 1 + (x[rows, np.maximum(f, 0)] >= self.cut[trees, node])
            node = np.where(f < 0, node, step)
        return 1 - 2 ** (-self.path[trees, node].mean(1) / self.mean_path)


STATS_SCHEMA = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in STATS)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATS])


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``STATS`` of every document; NULL and blank texts count nothing."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([text_statistics(raw) for raw in text_bytes(batch.column("text"))], np.int64)
        rows = rows.reshape(-1, len(STATS))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(rows[:, i]) for i in range(len(STATS)))],
            names=["doc_id", *STATS],
        )

    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return arrow_pass(picked, work, STATS_SCHEMA)


@dataclass(frozen=True)
class QualityRules:
    """A fitted forest and the cut below which a document is rejected."""

    forest: IsolationForest | None
    cut: float

    def kept(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(normality, kept) of rows of statistics."""
        if self.forest is None:
            return np.zeros(len(stats)), ~base_failed(stats)
        score = self.forest.normality(features(stats))
        return score, ~base_failed(stats) & (score >= self.cut)


def scored(stats: DataFrame, rules: QualityRules) -> DataFrame:
    """Add normality, base_failed and kept to rows of statistics."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = _matrix(batch)
        score, kept = rules.kept(m)
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(score), pa.array(base_failed(m)), pa.array(kept)],
            names=[*batch.schema.names, "normality", "base_failed", "kept"],
        )

    schema = STATS_SCHEMA + ", normality double, base_failed boolean, kept boolean"
    return arrow_pass(stats, work, schema)


def fit_rules(
    stats: DataFrame, labels: DataFrame, how: ForestParameters = ForestParameters()
) -> QualityRules:
    """Grow the forest on a bounded sample, calibrate the cut on all labelled rows.

    ``labels`` needs doc_id and quality (1 good, 0 bad; NULL is ignored).  Labelled
    rows come to the driver as a histogram of a thousand bins.  Rows that fail the
    base rules take no part.  Without labels of both kinds nothing is cut; without
    any row to grow on, only the base rules decide.
    """
    usable = stats.where("not (n_words < 50 or 100 * n_repeat_words > 50 * n_words)")
    sample = hashed_sample(usable, how.trees * how.rows_per_tree, "doc_id", *STATS).select(*STATS)
    rows = np.array([tuple(r) for r in sample.collect()], np.int64).reshape(-1, len(STATS))
    if not len(rows):
        return QualityRules(None, -np.inf)
    known = labels.where("quality in (0, 1)").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")
    )
    taught = hashed_sample(usable.join(known, "doc_id"), how.labelled, "doc_id", *STATS)
    taught = np.array([tuple(r) for r in taught.select(*STATS, "quality").collect()], np.int64)
    taught = taught.reshape(-1, len(STATS) + 1)
    weights = split_weights(features(taught[:, :-1]), taught[:, -1] == 1, how.least_weight)
    forest = IsolationForest(features(rows), how, weights)
    bins = (
        scored(usable.join(known.select("doc_id").distinct(), "doc_id", "left_semi"), QualityRules(forest, -np.inf))
        .select("doc_id", F.round("normality", 3).alias("normality"))
        .join(known, "doc_id")
        .groupBy("normality", "quality")
        .count()
        .collect()
    )
    # Counts shrink to at most about a hundred thousand rows with the same shares.
    total = sum(r["count"] for r in bins)
    shrink = max(1, total / 100_000)
    times = [max(1, round(r["count"] / shrink)) for r in bins]
    score = np.repeat([r["normality"] for r in bins], times)
    good = np.repeat([r["quality"] == 1 for r in bins], times)
    return QualityRules(forest, best_threshold(score, good, how.good_weight))


def judge(docs: DataFrame, labels: DataFrame, how: ForestParameters = ForestParameters()) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, normality.

    Other columns of ``docs`` are ignored; repeated rows are judged alike; NULL,
    empty and blank texts fail the base rules.
    """
    stats = written(rule_statistics(docs), "rule-statistics")
    return scored(stats, fit_rules(stats, labels, how)).select(
        "doc_id", *COUNTS, "base_failed", "kept", "normality"
    )


def keep_good(docs: DataFrame, labels: DataFrame, how: ForestParameters = ForestParameters()) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    The texts are counted a second time instead of being shuffled.
    """
    stats = written(rule_statistics(docs), "rule-statistics")
    rules = fit_rules(stats, labels, how)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([text_statistics(raw) for raw in text_bytes(batch.column("text"))], np.int64)
        return batch.filter(pa.array(rules.kept(rows.reshape(-1, len(STATS)))[1]))

    return arrow_pass(docs, work, docs.schema)
