"""Whitening against a direct decomposition."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import whitening
from tidegauge.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, embedding array<double>, label int, n bigint, x int, component string, whitened int"


def given(spark, rows):
    full = [(i, None if e is None else [None if c is None else float(c) for c in e], 1, 1, 1, "k", 1) for i, e in rows]
    return spark.createDataFrame(full, VECTORS)


def brute(rows, components=16):
    """Per usable row, in order: its id, exact deviation, and (value, share) per component up to sign."""
    whole = [[math.floor(64 * c) + 1_000_000 for c in e] for _, e in rows]
    fit = [list(x) for x in dict.fromkeys(map(tuple, whole))]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = []
    for (i, _), x in zip(rows, whole):
        moved = [n * c - s for c, s in zip(x, sums)]
        out.append((i, sum(m * m for m in moved), (np.array(moved) / n) @ vectors))
    return n, values, float((centred * centred).sum() / n), out


def check(df, rows):
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    n, values, trace, want = brute(rows)
    count = len(values)
    found = defaultdict(list)
    for r in df.collect():
        found[r["vec_id"], int(r["deviation"])].append(r)
    assert sum(map(len, found.values())) == len(rows) * count
    for i, deviation, projected in want:
        mine = sorted(found[i, deviation], key=lambda r: r["component"])
        assert len(mine) % count == 0 and {r["n"] for r in mine} == {n}
        assert {r["component"] for r in mine} == set(range(1, count + 1))
        assert all(r["identity_error"] <= 1e-10 for r in mine)
        for r in mine:
            k = r["component"] - 1
            if values[k] <= 1e-10 * max(values[0], 1e-300):
                assert r["whitened"] is None
            elif len(mine) == count:
                assert math.isclose(abs(r["whitened"]), abs(projected[k]) / math.sqrt(values[k]), rel_tol=1e-6, abs_tol=1e-7)
            if trace > 0:
                assert math.isclose(r["explained"], max(values[k], 0) / trace, rel_tol=1e-8, abs_tol=1e-12)
            else:
                assert r["explained"] is None


@pytest.mark.parametrize("size,count,parts", [(20, 300, 7), (3, 50, 1), (24, 9, 3)])
def test_rows_against_direct_decomposition(spark, size, count, parts):
    rng = np.random.default_rng(size)
    spread = np.linspace(0.5, 6, size)
    rows = [(i, (rng.normal(size=size) * spread).tolist()) for i in range(count)]
    rows += [(count, rows[3][1]), (count + 1, rows[3][1])]
    check(whitening.whiten(given(spark, rows).repartition(parts), whitening.Whitening(group=2)), rows)


def test_edges(spark):
    assert whitening.whiten(given(spark, [])).collect() == []
    unusable = [(1, None), (2, []), (3, [1.0, None]), (4, [math.nan, 0]), (5, [math.inf, 0]), (6, [1e38, 0]), (7, [1.0])]
    assert whitening.whiten(given(spark, unusable[:6])).collect() == []
    one = [(8, [0.5, -0.25])] * 3
    check(whitening.whiten(given(spark, unusable + one[:2])), one[:2])
    line = [(i, [float(i), 1.0, -2.0 * i]) for i in range(12)] + [(None, [3.0, 1.0, -6.0]), (4, [4.0, 1.0, -8.0])]
    check(whitening.whiten(given(spark, unusable + line)), line)
    wide = [(i, [(-1) ** i * 1e12 + i, float(i * i)]) for i in range(40)]
    check(whitening.whiten(given(spark, wide)), wide)


def test_rank_one_updates_and_merges():
    rng = np.random.default_rng(2)
    for size, count in ((1, 5), (6, 80), (12, 4), (30, 200)):
        x = np.round(rng.normal(size=(count, size)) * 4)
        x[:, -1] = 2.0
        spectra = [whitening.Spectrum.empty(size) for _ in range(3)]
        for i, row in enumerate(x):
            spectra[min(i % 4, 2)].add(row)
        spectra[0].merge(spectra[1])
        spectra[0].merge(whitening.Spectrum.empty(size))
        spectra[2].merge(spectra[0])
        got = spectra[2]
        centred = x - x.mean(axis=0)
        scatter = centred.T @ centred
        scale = np.abs(scatter).max() + 1
        assert got.count == count and np.allclose(got.mean, x.mean(axis=0))
        assert np.abs(got.vectors * got.values @ got.vectors.T - scatter).max() < 1e-12 * scale
        assert np.abs(got.vectors.T @ got.vectors - np.eye(size)).max() < 1e-11
        assert (np.diff(got.values) >= 0).all()


def test_secular_roots_against_a_direct_solution():
    rng = np.random.default_rng(5)
    for size in (1, 2, 9, 40):
        d = np.sort(rng.exponential(size=size)).cumsum()
        z = rng.normal(size=size) * 10.0 ** rng.integers(-6, 1, size)
        pole, x = whitening.secular_roots(d, 0.7 * z * z)
        want = np.linalg.eigvalsh(np.diag(d) + 0.7 * np.outer(z, z))
        assert np.allclose(d[pole] + x, want, rtol=1e-12, atol=1e-12 * want[-1])


def test_query_covers_every_vector(spark):
    df = QUERIES["op12_incremental_whitening"](spark, SMALL)
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    check(df, rows)
    assert dict(df.dtypes)["deviation"] == "bigint"
    spread = df.groupBy("component").agg(F.avg("whitened").alias("m"), F.var_pop("whitened").alias("v")).collect()
    assert len(spread) == 16 and all(abs(r["m"]) < 1e-9 and abs(r["v"] - 1) < 1e-6 for r in spread)
