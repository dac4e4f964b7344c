"""Quality by co-training: a content view and a page-metadata view teach each other.

The content view sees how a text is spelled (a hashed profile of byte pairs); the
metadata view sees only where it comes from and how the page is laid out.  Both
start from labelled rows.  In each round a Spark pass scores all unlabelled rows, and
every view labels those it is surest of, for the other one to learn from.  At the end
both are calibrated on labelled rows that took no part, and combined.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import (
    arrow_pass,
    best_threshold,
    fit_logistic,
    fold,
    hashed_sample,
    mix,
    sigmoid,
    text_bytes,
)
from tidegauge.session import broadcast_if_small, written


@dataclass(frozen=True)
class CoTrainingParameters:
    """Bounds of a view's fit: ``labelled`` rows, and ``pseudo`` rows labelled by the other view.

    Each of ``rounds`` rounds labels the surest ``share`` of all unlabelled rows on
    either side; the fit draws its bounded sample from all rows labelled so far.
    ``good_weight`` is the price of a lost good document.
    """

    labelled: int = 8_000
    pseudo: int = 2_000
    rounds: int = 5
    share: float = 0.05
    pairs: int = 256
    categories: int = 32
    good_weight: float = 3.0


N_LAYOUT = 8


def content_view(raw: bytes, pairs: int) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs; zeros for under two bytes."""
    b = np.frombuffer(raw, np.uint8).astype(np.int64)
    if len(b) < 2:
        return np.zeros(pairs, np.float32)
    bucket = ((b[:-1] * 256 + b[1:]) * 40503 >> 4) % pairs
    return np.sqrt(np.bincount(bucket, minlength=pairs) / (len(b) - 1)).astype(np.float32)


def metadata_view(raw: bytes, tags: tuple[str | None, ...], categories: int) -> np.ndarray:
    """Layout of the page, and its tags (language, source) as hashed indicators."""
    lines = [line.strip() for line in raw.split(b"\n")]
    lines = [line for line in lines if line]
    words = len(raw.split())
    n = max(1, len(lines))
    lengths = np.array([len(line) for line in lines] or [0], float)
    ends = sum(line[-1:] in (b".", b"!", b"?", b":", b'"') for line in lines)
    layout = np.array(
        [
            np.log1p(words),
            np.log1p(len(lines)),
            np.log1p(lengths.mean()),
            np.log1p(lengths.std()),
            np.log1p(lengths[0]),
            ends / n,
            1 - len(set(lines)) / n,
            np.log1p(len(raw)) - np.log1p(words),
        ]
    )
    hashed = np.zeros(categories)
    for place, tag in enumerate(tags):
        hashed[xxhash.xxh64_intdigest(f"{place}:{tag}") % categories] = 1
    return np.concatenate([layout, layout**2, hashed]).astype(np.float32)


def _views(batch: pa.RecordBatch, how: CoTrainingParameters) -> tuple[np.ndarray, np.ndarray]:
    texts = list(text_bytes(batch.column("text")))
    tags = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
    a = np.array([content_view(t, how.pairs) for t in texts], np.float32).reshape(-1, how.pairs)
    b = np.array([metadata_view(t, g, how.categories) for t, g in zip(texts, tags)], np.float32)
    return a, b.reshape(-1, 2 * N_LAYOUT + how.categories)


def _stored_views(rows: pa.RecordBatch | pa.Table, how: CoTrainingParameters) -> tuple[np.ndarray, np.ndarray]:
    """Features of both views as they are stored, content in half precision."""
    a = [np.frombuffer(r, "<f2") for r in rows.column("a").to_pylist()]
    b = [np.frombuffer(r, "<f4") for r in rows.column("b").to_pylist()]
    wide = 2 * N_LAYOUT + how.categories
    return np.array(a, np.float32).reshape(-1, how.pairs), np.array(b, np.float32).reshape(-1, wide)


class _View:
    """A logistic model on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (0.0, 1.0)
        self.beta = fit_logistic((x - self.mean) / self.scale, y, ridge=1e-3, steps=15)
        self.a, self.b = 1.0, 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.beta[:-1] + self.beta[-1]
        return self.a * np.clip(z, -30, 30) + self.b

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        if len(y) and y.min() != y.max():
            self.a, self.b = fit_logistic(self.logit(x)[:, None], y, ridge=1e-3)


@dataclass
class CoTrained:
    content: _View
    metadata: _View
    combine: np.ndarray
    cut: float
    how: CoTrainingParameters

    def scores(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        za, zb = self.content.logit(a), self.metadata.logit(b)
        return sigmoid(za), sigmoid(zb), sigmoid(np.column_stack([za, zb, np.ones(len(za))]) @ self.combine)


# --- the exchange --------------------------------------------------------------

# A view is sure from this logit (a probability of 0.95), and logits are binned this fine.
SURE, BINS = float(np.log(19.0)), 64


@dataclass
class Round:
    """Views of one round, and for each (view, label) the least bin that is labelled.

    Of that bin the rows whose hash lies below the second number are.
    """

    views: list[_View]
    cuts: dict[tuple[int, int], tuple[int, float]]


def _unit_hash(doc_id: np.ndarray, salt: int) -> np.ndarray:
    return mix(doc_id.astype(np.int64).view(np.uint64) + np.uint64(salt)) / 2.0**64


def _sure_bins(z: np.ndarray, label: int) -> np.ndarray:
    """How sure a view is of the label, as a bin; -1 if it is not."""
    toward = z if label else -z
    return np.where(toward > SURE, np.floor(toward * BINS), -1).astype(np.int64)


def given_labels(history: list[Round], x: list[np.ndarray], doc_id: np.ndarray) -> list[np.ndarray]:
    """What the other view has labelled for each view in the rounds so far; -1 for nothing.

    A row's labels follow from its features and the rounds alone, so no state is kept.
    """
    given = [np.full(len(doc_id), -1), np.full(len(doc_id), -1)]
    h = _unit_hash(doc_id, 1)
    for past in history:
        for v, view in enumerate(past.views):
            z, other = view.logit(x[v]), given[1 - v]
            free = other < 0
            for label in (1, 0):
                at, part = past.cuts[v, label]
                bins = _sure_bins(z, label)
                other[free & (bins >= 0) & ((bins > at) | ((bins == at) & (h < part)))] = label
    return given


def sure_counts(
    views: list[_View], history: list[Round], x: list[np.ndarray], doc_id: np.ndarray
) -> list[tuple[int, int, int, int]]:
    """(view, label, bin, rows) of the rows that a view is sure of and may still label."""
    given, out = given_labels(history, x, doc_id), []
    for v, view in enumerate(views):
        z, free = view.logit(x[v]), given[1 - v] < 0
        for label in (1, 0):
            bins, n = np.unique(_sure_bins(z, label)[free], return_counts=True)
            out += [(v, label, b, k) for b, k in zip(bins.tolist(), n.tolist()) if b >= 0]
    return out


def chosen_cuts(counts: dict[tuple[int, int], dict[int, int]], quota: dict[int, float]) -> tuple[dict, list[int]]:
    """The cut of each (view, label) that labels its quota of the surest rows; rows labelled for each view."""
    cuts, labelled = {}, [0.0, 0.0]
    for v in (0, 1):
        for label in (0, 1):
            left, cut = quota[label], (1 << 40, 0.0)
            for b, n in sorted(counts.get((v, label), {}).items(), reverse=True):
                if left <= 0:
                    break
                cut = (b, min(1.0, left / n))
                labelled[1 - v] += min(left, n)
                left -= n
            cuts[v, label] = cut
    return cuts, [int(np.ceil(n)) for n in labelled]


class Pool:
    """All unlabelled rows: doc_id and the features of both views, as a stored table."""

    def __init__(self, features: DataFrame, how: CoTrainingParameters):
        self.features, self.how = features, how
        self.size = features.count()

    def _pass(self, work, schema: str) -> DataFrame:
        how = self.how

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            return work(batch.column("doc_id").to_numpy(), list(_stored_views(batch, how)))

        return arrow_pass(self.features, run, schema)

    def counts(self, views: list[_View], history: list[Round]) -> dict[tuple[int, int], dict[int, int]]:
        """Histogram of the sure rows; logits are clipped, so the bins are bounded."""

        def work(doc_id: np.ndarray, x: list[np.ndarray]) -> pa.RecordBatch:
            rows = sure_counts(views, history, x, doc_id)
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["view", "label", "bin", "n"]
            )

        found: dict[tuple[int, int], dict[int, int]] = {}
        rows = self._pass(work, "view bigint, label bigint, bin bigint, n bigint")
        for r in rows.groupBy("view", "label", "bin").agg(F.sum("n").alias("n")).collect():
            found.setdefault((r["view"], r["label"]), {})[r["bin"]] = r["n"]
        return found

    def sample(self, history: list[Round], labelled: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Features and pseudo-labels for each view: a hashed sample of the rows labelled so far.

        Tasks thin the rows by their hash to about twice the bound before they are ordered.
        """
        part = [min(1.0, 2.0 * self.how.pseudo / max(1, n)) for n in labelled]

        def work(doc_id: np.ndarray, x: list[np.ndarray]) -> pa.RecordBatch:
            given, h = given_labels(history, x, doc_id), _unit_hash(doc_id, 2)
            rows = [(v, i) for v in (0, 1) for i in np.nonzero((given[v] >= 0) & (h < part[v]))[0].tolist()]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([v for v, _ in rows], pa.int64()),
                    pa.array([int(doc_id[i]) for _, i in rows], pa.int64()),
                    pa.array([float(h[i]) for _, i in rows], pa.float64()),
                    pa.array([int(given[v][i]) for v, i in rows], pa.int64()),
                    pa.array([x[v][i].astype("<f4").tobytes() for v, i in rows], pa.binary()),
                ],
                names=["view", "doc_id", "h", "label", "x"],
            )

        schema = "view bigint, doc_id bigint, h double, label bigint, x binary"
        taken = written(self._pass(work, schema).dropDuplicates(["view", "doc_id"]), "pseudo-labels")
        out = []
        for v, width in enumerate((self.how.pairs, 2 * N_LAYOUT + self.how.categories)):
            rows = taken.where(F.col("view") == v).orderBy("h", "doc_id").limit(self.how.pseudo).collect()
            x = np.array([np.frombuffer(r["x"], "<f4") for r in rows], np.float32).reshape(-1, width)
            out.append((x, np.array([r["label"] for r in rows], float)))
        return out


def co_train(
    a: np.ndarray, b: np.ndarray, y: np.ndarray, held: np.ndarray, pool: Pool, how: CoTrainingParameters
) -> CoTrained:
    """Co-train on labelled rows outside ``held`` and the pool; calibrate on ``held``."""
    own, fit = [a[~held], b[~held]], y[~held]
    views = [_View(x, fit) for x in own]
    if pool.size and len(fit) and fit.min() != fit.max():
        quota = {label: how.share * max(0.02, float((fit == label).mean())) * pool.size for label in (0, 1)}
        history: list[Round] = []
        labelled = [0, 0]
        for _ in range(how.rounds):
            cuts, more = chosen_cuts(pool.counts(views, history), quota)
            history.append(Round(views, cuts))
            labelled = [n + m for n, m in zip(labelled, more)]
            given = pool.sample(history, labelled)
            views = [_View(np.vstack([x, gx]), np.concatenate([fit, gy])) for x, (gx, gy) in zip(own, given)]
    content, metadata = views
    content.calibrate(a[held], y[held])
    metadata.calibrate(b[held], y[held])
    model = CoTrained(content, metadata, np.array([0.5, 0.5, 0.0]), -np.inf, how)
    if held.any() and y[held].min() != y[held].max():
        both = np.column_stack([content.logit(a[held]), metadata.logit(b[held])])
        model.combine = fit_logistic(both, y[held], ridge=1e-3)
        model.cut = best_threshold(model.scores(a[held], b[held])[2], y[held] == 1, how.good_weight)
    return model


def _pages(docs: DataFrame) -> DataFrame:
    """doc_id, text and the tags; a table without a tag column has NULL there."""
    tags = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c)
            for c in ("lang", "source")]
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *tags)


def fit_cotraining(
    docs: DataFrame, labels: DataFrame, how: CoTrainingParameters = CoTrainingParameters()
) -> CoTrained:
    """Fit on a bounded, hashed sample of labelled documents and on all unlabelled ones.

    ``labels`` needs doc_id and quality (0, 1; NULL is ignored).  Documents without an
    id take no part.  The features of all documents are stored once.
    """
    known = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("quality"))
    )
    pages = _pages(docs).where("doc_id is not null")
    # Bounded by its parameter, so it may be broadcast.
    wanted = hashed_sample(known.join(pages.select("doc_id"), "doc_id", "left_semi"), how.labelled, "doc_id")
    wanted = F.broadcast(wanted.select("doc_id", F.lit(True).alias("taught")))
    marked = written(known.join(wanted, "doc_id", "left"), "labelled")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = _views(batch, how)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([r.astype("<f2").tobytes() for r in a], pa.binary()),
             pa.array([r.astype("<f4").tobytes() for r in b], pa.binary())],
            names=["doc_id", "a", "b"],
        )

    views = arrow_pass(pages, work, "doc_id bigint, a binary, b binary")
    featured = written(views.join(broadcast_if_small(marked), "doc_id", "left"), "views")
    # Repeated ids can bring more rows than ids; one row of each is taken.
    table = featured.where("taught").dropDuplicates(["doc_id"]).orderBy("doc_id")
    table = table.withColumn("held", fold(F.col("doc_id"), 5) == 4).toArrow()
    a, b = _stored_views(table, how)
    y = np.array(table.column("quality").to_pylist(), float)
    held = np.array(table.column("held").to_pylist(), bool)
    return co_train(a, b, y, held, Pool(featured.where("quality is null").select("doc_id", "a", "b"), how), how)


def score_quality(docs: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, content_score, metadata_score, score, kept of every document.

    NULL and empty texts have an empty content profile and layout.  Repeated rows
    are scored alike; NULL tags are a tag of their own.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, both = model.scores(*_views(batch, model.how))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(a), pa.array(b), pa.array(both), pa.array(both >= model.cut)],
            names=["doc_id", "content_score", "metadata_score", "score", "kept"],
        )

    schema = "doc_id bigint, content_score double, metadata_score double, score double, kept boolean"
    return arrow_pass(_pages(docs), work, schema)
