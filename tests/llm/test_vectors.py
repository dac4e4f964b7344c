"""Vector links and whitening against brute force."""

import math

import duckdb
import numpy as np
import pytest

from tidegauge.llm import vector_cells
from tidegauge.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, embedding array<double>, label int, key string, cell int, v int, n int, component int"


def given(spark, rows, element="double"):
    full = [(i, None if e is None else [None if c is None else float(c) for c in e], label, "k", 1, 1, 1, 1) for i, e, label in rows]
    return spark.createDataFrame(full, VECTORS.replace("double", element))


def brute_links(rows, threshold):
    def usable(label, e):
        return label is not None and e and all(c is not None and math.isfinite(c) for c in e) and any(e)

    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    good = [i for i, (_, e, label) in enumerate(rows) if usable(label, e)]
    unit = {i: np.array(rows[i][1], float) / max(map(abs, rows[i][1])) for i in good}
    unit = {i: x / np.sqrt(x @ x) for i, x in unit.items()}
    for p, i in enumerate(good):
        for j in good[p + 1 :]:
            if rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                n[i], n[j] = n[i] + 1, n[j] + 1
                parent[root(i)] = root(j)
    ids = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            ids[root(i)] = min(ids.get(root(i), row[0]), row[0])
    out = [(row[0], n[i], ids.get(root(i)), row[0] == ids.get(root(i))) for i, row in enumerate(rows)]
    return sorted(out, key=repr)


def answered(df):
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def planted(seed, width, spread):
    """Near copies around a few centres of many sizes, and vectors of their own."""
    rng = np.random.default_rng(seed)
    rows = []
    for label in (1, 2):
        for size in (90, 40, 12, 3):
            centre = rng.normal(size=width)
            for _ in range(size):
                noise = rng.normal(size=width) * np.linalg.norm(centre) / math.sqrt(width)
                rows.append((centre + noise * rng.uniform(0, spread), label))
        rows += [(rng.normal(size=width), label) for _ in range(120)]
    rows += [rows[5], rows[5], (rows[5][0] * 3, rows[5][1])]
    order = rng.permutation(len(rows))
    return [(int(i), rows[i][0].tolist(), rows[i][1]) for i in order]


@pytest.mark.parametrize("width,spread,cell_rows,fan", [(24, 0.35, 16, 4), (3, 0.2, 16, 6), (24, 0.1, 1024, 64)])
def test_links_against_brute_force(spark, width, spread, cell_rows, fan):
    rows = planted(width, width, spread)
    how = vector_cells.VectorCells(cell_rows=cell_rows, fan=fan, sample=40, unit_rows=50, block_rows=13)
    assert answered(vector_cells.near_duplicate_vectors(given(spark, rows), how)) == brute_links(rows, 0.93)


def test_links_on_edges(spark):
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [math.nan, 1], 1), (5, [math.inf, 1], 1), (6, [None, 1], 1)]
    rows += [(7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (10, [2.0, -0.0], 1)]
    rows += [(None, [1.0, 0.1], 1), (None, [0.0, 1.0], 2), (None, None, None), (11, [1.0, 0.0, 0.0], 1)]
    rows += [(12, [1e300, 1e300], 3), (13, [1e-300, 1e-300], 3), (14, [1.0], 4), (15, [5.0], 4), (16, [-5.0], 4)]
    assert answered(vector_cells.near_duplicate_vectors(given(spark, rows))) == brute_links(rows, 0.93)
    assert vector_cells.near_duplicate_vectors(given(spark, [])).collect() == []
    floats = [(i, e, label) for i, e, label in rows if not e or i not in (12, 13)]
    found = answered(vector_cells.near_duplicate_vectors(given(spark, floats, "float")))
    assert found == brute_links(floats, 0.93)


def test_no_partner_lies_outside_the_cells_visited():
    for width, seed in ((2, 0), (3, 1), (16, 2)):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=(1500, width))
        near = x[:700] + rng.normal(size=(700, width)) * 0.25 * np.linalg.norm(x[:700], axis=1, keepdims=True) / math.sqrt(width)
        x = np.vstack([x, near])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        centres = vector_cells.spherical_kmeans(x[::7], 12, 4)
        cosines = x @ centres.T
        home = cosines.argmax(axis=1)
        least = np.array([cosines[home == c, c].min(initial=2.0) for c in range(len(centres))])
        seen = vector_cells.may_hold_partners(cosines, centres, least, math.acos(0.93))
        linked = x @ x.T >= 0.93
        i, j = np.nonzero(linked)
        assert seen[i, home[j]].all()
        if width == 2:
            assert seen.mean() < 0.5  # the bounds do leave cells out


def test_links_query_matches_sql(spark):
    embeddings = f"'{SMALL}/embeddings.parquet'"
    want = duckdb.sql(ORACLES["op11_spherical_cells"].replace("FROM embeddings", f"FROM {embeddings}")).fetchall()
    assert answered(QUERIES["op11_spherical_cells"](spark, SMALL)) == sorted(map(tuple, want), key=repr)
