"""Whitening of vectors by an incremental eigendecomposition.

1. Components become whole numbers; the fit list holds each distinct vector once.  Its
   size and sums are exact.
2. Every partition of the fit list keeps a spectrum (count, mean, eigenvalues and
   eigenvectors of its scatter).  A vector is a centred rank-one update: the eigenvalues
   are the roots of a secular equation, after deflation of directions that it leaves alone.
3. Two spectra combine by rank-one updates with the eigenpairs of one, and one more
   for the distance of the means.  Spectra meet in groups, round by round, so no task
   sees more than a group of them.
4. A Rayleigh-Ritz step makes the result exact to double precision whatever errors the
   updates have gathered: the covariance is projected on all merged directions in one
   distributed pass, and the small projected matrix is solved.

Only matrices of the vectors' length go through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.session import written

# Fixed: an entry c becomes floor(64 c) + 1000000.
SCALE, SHIFT = 64, 1_000_000
# Entries from here on are not whole numbers that sums can hold exactly.
LARGEST = float(1 << 45)


@dataclass(frozen=True)
class Whitening:
    """``components`` to give out; ``group`` spectra that a task combines."""

    components: int = 16
    group: int = 8


@dataclass
class Spectrum:
    """Count, mean, and the scatter about it as eigenvalues (rising) and eigenvectors (columns)."""

    count: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size), np.zeros(size), np.eye(size))

    def add(self, x: np.ndarray) -> None:
        """One more vector."""
        step = x - self.mean
        self.count += 1
        self.mean = self.mean + step / self.count
        if self.count > 1:
            self._update(step, (self.count - 1) / self.count)

    def merge(self, other: Spectrum) -> None:
        """All vectors of another spectrum."""
        if not other.count:
            return
        if not self.count:
            self.count, self.mean = other.count, other.mean
            self.values, self.vectors = other.values, other.vectors
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self._update(vector, value)
        total = self.count + other.count
        step = other.mean - self.mean
        self._update(step, self.count * other.count / total)
        self.mean = self.mean + step * (other.count / total)
        self.count = total

    def _update(self, vector: np.ndarray, weight: float) -> None:
        self.values, self.vectors = rank_one_update(self.values, self.vectors, vector, weight)


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z2 / (d - x), one above every d, as (nearest pole, distance from it).

    ``d`` rises strictly and z2 is positive.  Each root is measured from the pole it
    lies next to, so that differences to the poles keep their digits.  Steps come from
    a rational model with the two neighbouring poles; one that leaves the bracket is
    replaced by its middle.
    """
    k = len(d)
    j = np.arange(k)
    upper = np.append(d[1:], d[-1] + z2.sum())
    middle = 0.5 * (d + upper)
    left = 1 + (z2[:, None] / (d[:, None] - middle[None, :])).sum(axis=0) > 0
    left[-1] = True
    pole = np.where(left, j, np.minimum(j + 1, k - 1))
    origin = d[pole]
    delta = d[:, None] - origin[None, :]
    low = np.where(left, 0.0, (d - upper) / 2)
    high = np.where(left, (upper - d) / 2, 0.0)
    high[-1] = (upper - d)[-1]
    below = np.arange(k)[:, None] <= j[None, :]
    near, far = d - origin, upper - origin
    x = 0.5 * (low + high)
    for _ in range(60):
        gaps = delta - x
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = z2[:, None] / gaps
            slopes = terms / gaps
            value = 1 + terms.sum(axis=0)
            rise_low = np.where(below, slopes, 0).sum(axis=0)
            rise_high = np.where(below, 0, slopes).sum(axis=0)
            low, high = np.where(value < 0, x, low), np.where(value > 0, x, high)
            a1, a2 = near - x, far - x
            c = value - a1 * rise_low - a2 * rise_high
            a = (a1 + a2) * value - a1 * a2 * (rise_low + rise_high)
            b = a1 * a2 * value
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = x + step
        outside = ~np.isfinite(new) | (new <= low) | (new >= high)
        new = np.where(outside, 0.5 * (low + high), new)
        # a value within its own rounding error is a root
        done = np.abs(value) <= 2e-16 * (1 + np.abs(terms).sum(axis=0))
        new = np.where(done, x, new)
        done |= np.abs(new - x) <= 4e-16 * np.abs(new)
        x = new
        if done.all():
            break
    return pole, x


def rank_one_update(
    d: np.ndarray, u: np.ndarray, vector: np.ndarray, weight: float
) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of u diag(d) u' + weight vector vector'."""
    z = u.T @ vector
    scale = max(float(np.abs(d).max(initial=0)), weight * float(z @ z))
    if not scale > 0:
        return d, u
    tiny = 8 * np.finfo(float).eps * scale
    # Deflation: directions that the vector does not touch keep their eigenpair ...
    active = np.nonzero(weight * np.abs(z) * np.sqrt(z @ z) > tiny)[0]
    # ... and of equal eigenvalues a rotation leaves one that it touches.
    if len(active) > 1 and (np.diff(d[active]) <= tiny).any():
        u, z = u.copy(), z.copy()
        kept = [active[0]]
        for i in active[1:]:
            p = kept[-1]
            r = np.hypot(z[p], z[i])
            cos, sin = z[i] / r, z[p] / r
            if (d[i] - d[p]) * abs(cos * sin) <= tiny:
                u[:, p], u[:, i] = cos * u[:, p] - sin * u[:, i], sin * u[:, p] + cos * u[:, i]
                z[p], z[i] = 0.0, r
                kept[-1] = i
            else:
                kept.append(i)
        active = np.array(kept)
    if not len(active):
        return d, u
    dk, zk = d[active], z[active]
    rising = np.argsort(dk, kind="stable")
    active, dk, zk = active[rising], dk[rising], zk[rising]
    pole, x = secular_roots(dk, weight * zk * zk)
    # root - pole, without loss of digits; then the vector for which the roots are exact
    above = x[None, :] - (dk[:, None] - dk[pole][None, :])
    k = len(dk)
    bound = np.ones((k, k))
    if k > 1:
        i, j = np.arange(k)[:, None], np.arange(k)[None, :]
        following = np.append(dk[1:], 0.0)
        bound = np.where(j < i, dk[None, :] - dk[:, None], np.where(j < k - 1, following[None, :] - dk[:, None], 1.0))
    exact = np.sqrt(np.abs(np.prod(above / bound, axis=1))) * np.where(zk < 0, -1.0, 1.0)
    rotation = exact[:, None] / -above
    rotation /= np.sqrt((rotation * rotation).sum(axis=0))
    values, vectors = d.copy(), u.copy()
    values[active] = dk[pole] + x
    vectors[:, active] = u[:, active] @ rotation
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


SPECTRUM = "place bigint, size int, n bigint, mean binary, eigenvalues binary, eigenvectors binary"


def _spectrum_row(place: int, s: Spectrum) -> pa.RecordBatch:
    arrays = [
        pa.array([place], pa.int64()),
        pa.array([len(s.mean)], pa.int32()),
        pa.array([s.count], pa.int64()),
        *(pa.array([x.astype("<f8").tobytes()], pa.binary()) for x in (s.mean, s.values, s.vectors)),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["place", "size", "n", "mean", "eigenvalues", "eigenvectors"])


def _spectrum(row: dict) -> Spectrum:
    mean, values, vectors = (np.frombuffer(row[c], "<f8") for c in ("mean", "eigenvalues", "eigenvectors"))
    return Spectrum(row["n"], mean, values, vectors.reshape(row["size"], row["size"]))


def _whole(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """The vectors of a batch as rows of whole numbers."""
    return batch.column("x").flatten().to_numpy().reshape(-1, size)


def exact_deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int]]:
    """Rows of x - sums / n in doubles, and the exact sum of (n x - sums)^2 of each row.

    Whole numbers of 64 bits are used where they surely suffice, of any length elsewhere.
    """
    largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    kind = np.int64 if largest < 1 << 62 else object
    moved = x.astype(kind) * n - np.array(sums, kind)
    widest = int(np.abs(moved).max(initial=0))
    squares = moved if widest * widest * max(1, len(sums)) < 1 << 62 else moved.astype(object)
    return moved.astype(np.float64) / n, [int(s) for s in (squares * squares).sum(axis=1)]


def _summed(fit: DataFrame, size: int, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over the fit list of a matrix per batch, added up entry by entry."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = work(_whole(batch, size))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], names=["m"])

    entries = fit.mapInArrow(run, "m array<double>").select(F.posexplode("m").alias("at", "entry"))
    rows = entries.groupBy("at").agg(F.sum("entry").alias("entry")).toArrow().sort_by("at")
    return rows.column("entry").to_numpy()


def _whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): usable rows of the most frequent length, as whole numbers."""
    whole = F.transform("embedding", lambda c: F.floor(c * SCALE).cast("bigint") + SHIFT)
    usable = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    ).where(
        F.coalesce(
            (F.size("embedding") > 0)
            & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)),
            F.lit(False),
        )
    )
    return usable.select("vec_id", whole.alias("x"))


@dataclass
class Basis:
    """What every row is held against: exact size and sums, unit components, their eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float

    def known(self) -> np.ndarray:
        """Components that any vector of the fit list has a part in."""
        return known_components(self.eigenvalues)


def known_components(eigenvalues: np.ndarray) -> np.ndarray:
    least = 1e-13 * max(float(eigenvalues.max(initial=0)), 0.0) * max(1, len(eigenvalues))
    return (eigenvalues > least) & (eigenvalues > 0)


def merged_spectrum(fit: DataFrame, size: int, n: int, sums: list[int], how: Whitening) -> Spectrum:
    """Spectrum of the fit list: rank-one updates in partitions, then merged in groups."""

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        mine = Spectrum.empty(size)
        for batch in batches:
            for x in exact_deviations(_whole(batch, size), n, sums)[0]:
                mine.add(x)
        if mine.count:
            yield _spectrum_row(TaskContext.get().partitionId(), mine)

    def combine(key: tuple, rows: pa.Table) -> pa.Table:
        out = Spectrum.empty(size)
        for row in sorted(rows.to_pylist(), key=lambda r: r["place"]):
            out.merge(_spectrum(row))
        return pa.Table.from_batches([_spectrum_row(key[0].as_py(), out)])

    spectra = written(fit.mapInArrow(gather, SPECTRUM), "spectra")
    while spectra.limit(2).count() > 1:
        grouped = spectra.withColumn("group", F.expr(f"place DIV {how.group}"))
        spectra = written(grouped.groupBy("group").applyInArrow(combine, SPECTRUM), "spectra")
    return _spectrum(spectra.toArrow().to_pylist()[0])


def fit_whitening(rows: DataFrame, how: Whitening = Whitening()) -> tuple[DataFrame, Basis | None]:
    """The rows (vec_id, x) that take part, and the basis; no usable row, no basis.

    Rows of another length than the most frequent one (the longest of equally frequent
    ones) do not take part.
    """
    lengths = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if lengths is None:
        return rows, None
    size = lengths["size"]
    rows = rows.where(F.size("x") == size)
    fit = written(rows.select("x").distinct(), "fit-list")

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, high, low = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            x = _whole(batch, size)
            count += len(x)
            high += (x >> 26).sum(axis=0)
            low += (x & ((1 << 26) - 1)).sum(axis=0)
        sums = [Decimal((int(h) << 26) + int(b)) for h, b in zip(high, low)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([count], pa.int64()), pa.array([sums], pa.list_(pa.decimal128(38, 0)))], names=["n", "sums"]
        )

    parts = fit.mapInArrow(add, "n bigint, sums array<decimal(38,0)>")
    entries = parts.select("n", F.posexplode("sums").alias("at", "entry")).groupBy("at")
    totals = entries.agg(F.sum("n").alias("n"), F.sum("entry").alias("total")).orderBy("at").collect()
    n, sums = totals[0]["n"], [int(t["total"]) for t in totals]
    merged = merged_spectrum(fit, size, n, sums, how)
    directions, _ = np.linalg.qr(merged.vectors[:, ::-1])

    def projected(x: np.ndarray) -> np.ndarray:
        y = exact_deviations(x, n, sums)[0] @ directions
        return y.T @ y

    small = _summed(fit, size, projected).reshape(size, size) / n
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, components = values[::-1], (directions @ turn)[:, ::-1]
    # either sign will do; the largest coordinate decides it, so that reruns agree
    signs = np.sign(components[np.abs(components).argmax(axis=0), np.arange(size)])
    components = (components * signs)[:, : how.components]
    eigenvalues = np.maximum(values[: how.components], 0)
    known = known_components(eigenvalues)
    error = 0.0
    if known.any():
        scaled = components[:, known] / np.sqrt(eigenvalues[known])

        def squared(x: np.ndarray) -> np.ndarray:
            y = exact_deviations(x, n, sums)[0] @ scaled
            return y.T @ y

        covariance = _summed(fit, size, squared).reshape(scaled.shape[1], -1) / n
        error = float(np.abs(covariance - np.eye(len(covariance))).max())
    return rows, Basis(n, sums, components, eigenvalues, float(np.trace(small)), error)


def whiten(vectors: DataFrame, how: Whitening = Whitening()) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error.

    One row per usable row of ``vectors`` and component.  ``vectors`` needs vec_id and
    embedding (array of numbers); other columns are ignored.  Rows with a NULL or empty
    vector, a NULL, non-finite or very large (2^45) entry, or another length than most
    rows have are left out.  Repeated rows are whitened each and fitted once.  A
    component in which the fit list does not vary has a NULL ``whitened``; a fit list
    without any variance also a NULL ``explained``.  ``deviation`` is a decimal, since
    it grows with the square of the fit list.  No usable rows give none.
    """
    schema = (
        "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, "
        "explained double, identity_error double"
    )
    rows, basis = fit_whitening(_whole_vectors(vectors), how)
    if basis is None:
        return rows.sparkSession.createDataFrame([], schema)
    size, count = len(basis.sums), basis.components.shape[1]
    known = basis.known()
    scaled = np.where(known, basis.components / np.sqrt(np.where(known, basis.eigenvalues, 1.0)), np.nan)
    explained = basis.eigenvalues / basis.trace if basis.trace > 0 else np.full(count, np.nan)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                centred, deviations = exact_deviations(_whole(part, size), basis.n, basis.sums)
                held = len(deviations)
                row = np.repeat(np.arange(held), count)
                whitened = (centred @ scaled).ravel()
                shares = np.tile(explained, held)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(row)),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), held)),
                        pa.array(np.full(held * count, basis.n, np.int64)),
                        pa.array([Decimal(d) for d in deviations], pa.decimal128(38, 0)).take(pa.array(row)),
                        pa.array(whitened, mask=np.isnan(whitened)),
                        pa.array(shares, mask=np.isnan(shares)),
                        pa.array(np.full(held * count, basis.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(work, schema)
