"""Words, folds, and Arrow passes that the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A word is a run of characters other than space, tab, LF, VT, FF and CR.  In
# Python, ``bytes.split()`` cuts at exactly these bytes.
SPACES = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def word_array(text: Column) -> Column:
    """The words of a text; none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def fold(doc_id: Column, folds: int) -> Column:
    """``crc32(doc_id as text) mod folds``; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words.

    A shorter text is one shingle, its whole sequence; no words, no shingle.
    Distinct shingles are told apart by 64 bits.
    """
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    span = min(width, len(words))
    out = np.full(len(words) - span + 1, span, np.uint64)
    for i in range(span):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(words) - span + 1 + i])
    return np.unique(out)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes of each text without a detour over ``str``; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for value in column.cast(kind):
        yield value.as_py() or b""


def release_memory() -> None:
    """Give freed memory back to the machine; Python workers are kept between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_pass(
    df: DataFrame,
    work: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: str | T.StructType,
    rows: int = 500,
) -> DataFrame:
    """Map rows in Arrow batches; ``work`` sees at most ``rows`` of them at a time.

    Spark's batches hold thousands of texts; what ``work`` builds beside them is bounded
    by the smaller slices.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                out = work(batch.slice(start, rows))
                if out is not None and out.num_rows:
                    yield out
            release_memory()

    return df.mapInArrow(run, schema)


def hashed_sample(df: DataFrame, rows: int, *order: str) -> DataFrame:
    """At most ``rows`` rows in the order of a hash of ``order``: a fixed, bounded sample.

    Every task sends its first rows to be merged.  Of a large table, rows are
    therefore first thinned by the same hash to about twice the number wanted, so
    that what is sent does not grow with the number of tasks.  ``df`` is read
    twice; pass it written if it is dear.
    """
    key = F.xxhash64(*[F.col(c) for c in order], F.lit("sample"))
    total = df.count()
    if total > 2 * rows:
        width = 1 << 30
        df = df.where(F.pmod(key, F.lit(width)) < max(1, int(width * (2 * rows / total))))
    return df.orderBy(key, *order).limit(rows)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def fit_logistic(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 30
) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the intercept.

    With one class only, the intercept says so and all other coefficients are 0.
    """
    x1 = np.hstack([np.asarray(x, np.float64), np.ones((len(x), 1))])
    weight = np.ones(len(x)) if weight is None else weight
    beta = np.zeros(x1.shape[1])
    if len(y) == 0:
        return beta
    if y.min() == y.max():
        beta[-1] = 4.0 if y[0] else -4.0
        return beta
    penalty = np.full(x1.shape[1], ridge * len(y))
    penalty[-1] = 1e-9
    for _ in range(steps):
        p = sigmoid(x1 @ beta)
        gradient = x1.T @ (weight * (y - p)) - penalty * beta
        curve = (x1 * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        beta += step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return beta


def best_threshold(score: np.ndarray, good: np.ndarray, good_weight: float = 1.0) -> float:
    """The cut with the best weighted sum of both classes' shares on the right side.

    Rows at or above the cut count as good.  ``good_weight`` above 1 makes the
    loss of good rows dearer.  Without both classes nothing is cut.
    """
    if len(score) == 0 or good.min() == good.max():
        return -np.inf
    order = np.argsort(score, kind="stable")
    s, g = score[order], good[order].astype(float)
    lost = np.concatenate([[0.0], np.cumsum(g)]) / g.sum()
    caught = np.concatenate([[0.0], np.cumsum(1 - g)]) / (1 - g).sum()
    gain = caught - good_weight * lost
    gain[1:-1][s[1:] == s[:-1]] = -np.inf
    best = int(np.argmax(gain))
    if best == 0:
        return float(-np.inf)
    if best == len(s):
        return float(s[-1] + 1)
    return float((s[best - 1] + s[best]) / 2)
