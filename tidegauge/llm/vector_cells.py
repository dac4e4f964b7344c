"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

1. Rows with equal label and equal components are one node with a weight.
2. The nodes of a label and length are split into cells by spherical k-means, large
   cells again, until the products of a cell are few for its size.  Centres are fitted
   on a bounded sample of a cell; every node is assigned.
3. A node is at home in the cell of its nearest centre, and visits every other cell
   that may hold a partner.  Two bounds decide this: the cone of a cell (its farthest
   home, widened by the angle of the threshold), and the plane between two centres, on
   whose far side a node can lie by the sine of that angle.  Both are certain, so no
   link is lost, whatever the sample was.
4. Nodes within half that angle of a centre are linked with each other for certain (the
   core); they are counted, not compared.  All others are compared by products of
   blocks of homes and visitors, in doubles.
5. Blocks give out how many links a node has, and per group of linked nodes one edge a
   node to a representative.  Classes are the connected components; the smallest id stays.

A large group of near copies is a core, so its cost grows with its size.  Vectors
without any structure visit nearly all cells, and their label then costs all its
products, in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.components import components
from tidegauge.session import written


@dataclass(frozen=True)
class VectorCells:
    """Parameters.

    ``threshold`` is the least cosine of a link, above 0.  ``cell_rows`` is the size a
    cell is split towards, into at most ``fan`` cells at a time; ``sample`` is the
    expected number of a cell's nodes that its centres are fitted on, in ``rounds``.
    ``unit_rows`` bounds the nodes that a task assigns at a time, ``block_rows`` the
    sides of a product.
    """

    threshold: float = 0.93
    cell_rows: int = 1024
    fan: int = 64
    sample: int = 4096
    rounds: int = 8
    unit_rows: int = 4096
    block_rows: int = 1024

    @property
    def angle(self) -> float:
        return math.acos(self.threshold)

    @property
    def core(self) -> float:
        """Least cosine to a centre of nodes that are surely linked with each other."""
        return math.cos(self.angle / 2 - 1e-7)


# Room for rounding in the bounds; far above the error of a product of unit vectors.
SLACK = 1e-9


def unit_vectors(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    """Rows of raw components as unit vectors in doubles; scaled first, so squares stay finite."""
    raw = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _prepared(vectors: DataFrame) -> tuple[DataFrame, str]:
    """(vec_id, key, family, v) per row, and the type of v's components.

    ``key`` is a 128-bit hash of label and components, NULL for rows that link with
    nothing; ``family`` names label and length.
    """
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    spark_type, kind = ("float", "<f4") if element == "float" else ("double", "<f8")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, families, raws = [], [], []
            for label, given in zip(batch.column("label"), batch.column("embedding")):
                label, key, family, raw = label.as_py(), None, None, None
                if label is not None and given.is_valid and not given.values.null_count:
                    values = given.values.to_numpy(zero_copy_only=False).astype(kind) + 0.0
                    if len(values) and np.isfinite(values).all() and values.any():
                        raw = values.astype(kind).tobytes()
                        family = f"{len(values)}:{label}"
                        key = xxhash.xxh128_digest(family.encode() + b"\0" + raw)
                keys.append(key)
                families.append(family)
                raws.append(raw)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    pa.array(keys, pa.binary()),
                    pa.array(families, pa.string()),
                    pa.array(raws, pa.binary()),
                ],
                names=["vec_id", "key", "family", "v"],
            )

    given = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast(f"array<{spark_type}>").alias("embedding"),
    )
    return given.mapInArrow(work, "vec_id bigint, key binary, family string, v binary"), kind


def spherical_kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Unit centres of unit vectors; each starts far from those before it."""
    first = x.mean(axis=0)
    chosen = [int(np.argmax(x @ first))]
    nearest = x @ x[chosen[0]]
    rng = np.random.default_rng(11)
    for _ in range(k - 1):
        far = np.maximum(1 - nearest, 0)
        if far.sum() < 1e-12:
            break
        chosen.append(int(rng.choice(len(x), p=far / far.sum())))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(rounds):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-300), centres)
    return centres


def _centres(rows: DataFrame, plan: DataFrame, kind: str, how: VectorCells) -> DataFrame:
    """(cell, child, centre): fitted on a sample of every cell's homes.

    ``plan`` has cell, homes and k.  Nodes are drawn by a hash of their key.
    """
    width = 1 << 30
    drawn = F.pmod(F.xxhash64("key", F.lit("fit")), F.lit(width)) < F.lit(float(width * how.sample)) / F.col("homes")
    sample = rows.where("home").join(plan.select("cell", "homes", "k"), "cell").where(drawn)

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        centres = spherical_kmeans(unit_vectors(table.column("v"), kind), table.column("k")[0].as_py(), how.rounds)
        cell = key[0].as_py()
        return pa.table(
            {
                "cell": pa.array([cell] * len(centres), pa.string()),
                "child": pa.array([f"{cell}.{j}" for j in range(len(centres))], pa.string()),
                "centre": pa.array([c.tobytes() for c in centres], pa.binary()),
            }
        )

    chosen = sample.select("cell", "k", "v")
    return chosen.groupBy("cell").applyInArrow(fit, "cell string, child string, centre binary")


def _with_centres(rows: DataFrame, centres: DataFrame, plan: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on units of a cell's nodes beside all centres of that cell."""
    dealt = rows.join(plan.select("cell", "units"), "cell").withColumn(
        "unit", F.pmod(F.xxhash64("key"), F.col("units")).cast("int")
    )
    spread = centres.join(plan.select("cell", "units"), "cell").withColumn(
        "unit", F.explode(F.sequence(F.lit(0), (F.col("units") - 1).cast("int")))
    )
    right = spread.select(*[F.col(c).alias(c) for c in spread.columns])
    return dealt.groupBy("cell", "unit").cogroup(right.groupBy("cell", "unit")).applyInArrow(work, schema)


def _sorted_centres(table: pa.Table) -> tuple[list[str], np.ndarray, pa.Table]:
    table = table.sort_by("child")
    raw = b"".join(table.column("centre").to_pylist())
    return table.column("child").to_pylist(), np.frombuffer(raw, "<f8").reshape(table.num_rows, -1), table


def may_hold_partners(cosines: np.ndarray, centres: np.ndarray, least: np.ndarray, angle: float) -> np.ndarray:
    """Which cells (columns) may be home to a vector within ``angle`` of each row.

    ``cosines`` are those of the rows to the centres, ``least`` the lowest cosine of a
    cell's homes to its centre.
    """
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
    seen = np.empty(cosines.shape, bool)
    cone = np.arccos(np.clip(least, -1, 1)) + angle + SLACK
    lowest = np.where(cone < math.pi, np.cos(np.minimum(cone, math.pi)), -2.0)
    for cell in range(len(centres)):
        beyond = cosines - cosines[:, [cell]] - math.sin(angle) * apart[cell]
        seen[:, cell] = (beyond.max(axis=1) <= SLACK) & (cosines[:, cell] >= lowest[cell] - SLACK)
    return seen


NODE = "cell string, key binary, v binary, w bigint, home boolean, c double"


def _split(rows: DataFrame, plan: DataFrame, kind: str, how: VectorCells) -> tuple[DataFrame, DataFrame]:
    """The nodes in the cells below theirs, and (cell, stuck): whether a cell kept most of its parent."""
    centres = written(_centres(rows, plan, kind, how), "centres")

    def reach(key: tuple, nodes: pa.Table, given: pa.Table) -> pa.Table:
        children, points, _ = _sorted_centres(given)
        nodes = nodes.filter(nodes.column("home"))
        least, homes = np.full(len(children), 2.0), np.zeros(len(children), np.int64)
        if nodes.num_rows and children:
            cosines = unit_vectors(nodes.column("v"), kind) @ points.T
            home = cosines.argmax(axis=1)
            np.minimum.at(least, home, cosines.max(axis=1))
            homes = np.bincount(home, minlength=len(children))
        there = homes > 0
        return pa.table(
            {
                "cell": pa.array([key[0].as_py()] * int(there.sum()), pa.string()),
                "child": pa.array([c for c, t in zip(children, there) if t], pa.string()),
                "least": pa.array(least[there], pa.float64()),
                "homes": pa.array(homes[there].astype(np.int64), pa.int64()),
            }
        )

    reached = (
        _with_centres(rows, centres, plan, reach, "cell string, child string, least double, homes bigint")
        .groupBy("cell", "child")
        .agg(F.min("least").alias("least"), F.sum("homes").alias("child_homes"))
    )
    cells = written(
        centres.join(reached, ["cell", "child"])
        .join(plan.select("cell", "homes"), "cell")
        .withColumn("stuck", F.col("child_homes") > 0.9 * F.col("homes"))
        .drop("homes"),
        "cells",
    )

    def visit(key: tuple, nodes: pa.Table, given: pa.Table) -> pa.Table:
        children, points, given = _sorted_centres(given)
        if not nodes.num_rows or not children:
            return pa.table({n: pa.array([], t) for n, t in zip(NODE_NAMES, NODE_TYPES)})
        cosines = unit_vectors(nodes.column("v"), kind) @ points.T
        at_home = nodes.column("home").to_numpy()
        nearest = cosines.argmax(axis=1)
        seen = may_hold_partners(cosines, points, given.column("least").to_numpy(), how.angle)
        seen[at_home, nearest[at_home]] = True
        row, child = np.nonzero(seen)
        return pa.table(
            {
                "cell": pa.array(children, pa.string()).take(pa.array(child)),
                "key": nodes.column("key").take(pa.array(row)),
                "v": nodes.column("v").take(pa.array(row)),
                "w": nodes.column("w").take(pa.array(row)),
                "home": pa.array(at_home[row] & (nearest[row] == child)),
                "c": pa.array(cosines[row, child]),
            }
        )

    moved = written(_with_centres(rows, cells, plan, visit, NODE), "visits")
    return moved, cells.select(F.col("child").alias("cell"), "stuck")


NODE_NAMES = ["cell", "key", "v", "w", "home", "c"]
NODE_TYPES = [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.float64()]


def _blocks(count: Column, rows: int) -> Column:
    return F.ceil(count / rows)


def in_cells(nodes: DataFrame, kind: str, how: VectorCells) -> list[DataFrame]:
    """Tables of nodes in their final cells, each row with the sizes of its cell.

    ``nodes`` has family, key, v and w.  A cell is split on while its products are many
    for its size, unless a split no longer divides it.
    """
    units = F.greatest(F.lit(1), _blocks(F.col("total"), how.unit_rows)).alias("units")
    k = F.least(F.lit(how.fan), F.greatest(F.lit(1), _blocks(F.col("homes"), how.cell_rows))).cast("int").alias("k")
    rows = nodes.select(
        F.col("family").alias("cell"), "key", "v", "w", F.lit(True).alias("home"), F.lit(0.0).alias("c")
    )
    sizes = written(
        rows.groupBy("cell").agg(F.count("*").alias("homes"), F.count("*").alias("total")), "family-sizes"
    )
    done = []
    while True:
        plan = sizes.select("cell", "homes", "total", units, k)
        moved, stuck = _split(rows, plan, kind, how)
        core = F.col("c") >= how.core
        sizes = written(
            moved.groupBy("cell")
            .agg(
                F.count("*").alias("total"),
                F.count_if("home").alias("homes"),
                F.count_if(~core).alias("loose"),
                F.count_if(F.col("home") & ~core).alias("loose_homes"),
                F.sum(F.when(F.col("home") & core, F.col("w")).otherwise(0)).alias("core_weight"),
                F.min(F.when(F.col("home") & core, F.col("key"))).alias("anchor"),
            )
            .join(stuck, "cell"),
            "cell-sizes",
        )
        products = F.col("loose") * F.col("homes") + (F.col("total") - F.col("loose")) * F.col("loose_homes")
        again = (F.col("homes") > how.cell_rows) & (products > F.col("total") * how.cell_rows) & ~F.col("stuck")
        done.append(moved.join(sizes.where(~again), "cell"))
        sizes = sizes.where(again)
        if not sizes.limit(1).count():
            return done
        rows = moved.join(sizes.select("cell"), "cell")


def _linked(how: VectorCells, kind: str):
    """Links between the homes and the visitors of a unit, as counts and edges."""

    def compare(key: tuple, homes: pa.Table, visitors: pa.Table) -> pa.Table:
        nothing = pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
        if not homes.num_rows or not visitors.num_rows:
            return nothing
        x, y = unit_vectors(visitors.column("v"), kind), unit_vectors(homes.column("v"), kind)
        cosines = x @ y.T
        hit = cosines >= how.threshold
        for i, j in np.argwhere(np.abs(cosines - how.threshold) < 1e-13):
            hit[i, j] = math.fsum(x[i] * y[j]) >= how.threshold
        mine, theirs = visitors.column("key").to_pylist(), homes.column("key").to_pylist()
        place = {k: j for j, k in enumerate(theirs)}
        for i, own in enumerate(mine):
            if own in place:
                hit[i, place[own]] = False
        counts = hit @ homes.column("w").to_numpy().astype(np.int64)
        # the smallest home that is reached over links, by passing it on until nothing changes
        far = len(theirs)
        home_label = np.where(hit.any(axis=0), np.arange(far), far)
        while True:
            visitor_label = np.where(hit, home_label[None, :], far).min(axis=1)
            passed = np.minimum(home_label, np.where(hit, visitor_label[:, None], far).min(axis=0))
            if (passed == home_label).all():
                break
            home_label = passed
        ends = [(mine[i], theirs[m]) for i, m in enumerate(visitor_label.tolist()) if m < far]
        ends += [(theirs[j], theirs[m]) for j, m in enumerate(home_label.tolist()) if m < far]
        linked = np.nonzero(counts)[0].tolist()
        return pa.table(
            {
                "a": pa.array([mine[i] for i in linked] + [a for a, b in ends if a != b], pa.binary()),
                "b": pa.array([None] * len(linked) + [b for a, b in ends if a != b], pa.binary()),
                "n": pa.array(counts[linked].tolist() + [0] * sum(a != b for a, b in ends), pa.int64()),
            }
        )

    return compare


def _links(cells: DataFrame, kind: str, how: VectorCells) -> DataFrame:
    """(a, b, n): rows with b are edges that connect linked nodes, the others count links of a.

    Loose visitors meet all homes, core visitors the loose homes.  Core nodes of a cell
    are linked with its core homes without being compared.
    """
    core = F.col("c") >= how.core
    rows = cells.withColumn("core", core)
    by_core = rows.where("core and anchor IS NOT NULL")
    counted = by_core.select(
        F.col("key").alias("a"),
        F.lit(None).cast("binary").alias("b"),
        (F.col("core_weight") - F.when(F.col("home"), F.col("w")).otherwise(0)).alias("n"),
    ).where("n > 0")
    anchored = by_core.where(F.col("key") != F.col("anchor")).select(
        F.col("key").alias("a"), F.col("anchor").alias("b"), F.lit(0).cast("bigint").alias("n")
    )
    tight = F.col("total") - F.col("loose")
    n_blocks = {
        # met by loose visitors: homes' and visitors' blocks; met by core visitors: the same
        0: (_blocks(F.col("homes"), how.block_rows), _blocks(F.col("loose"), how.block_rows)),
        1: (_blocks(F.col("loose_homes"), how.block_rows), _blocks(tight, how.block_rows)),
    }

    def dealt(chosen: DataFrame, met: int, side: int) -> DataFrame:
        own, other = (n_blocks[met][side], n_blocks[met][1 - side])
        place = F.pmod(F.xxhash64("key", F.lit("block")), own).cast("int")
        partner = F.explode(F.sequence(F.lit(0), (other - 1).cast("int")))
        names = ["home_block", "visitor_block"] if side == 0 else ["visitor_block", "home_block"]
        return (
            chosen.where((own > 0) & (other > 0))
            .withColumn(names[0], place)
            .withColumn(names[1], partner)
            .select("cell", F.lit(met).alias("met"), "home_block", "visitor_block", "key", "v", "w")
        )

    homes = dealt(rows.where("home"), 0, 0).unionByName(dealt(rows.where("home and not core"), 1, 0))
    visitors = dealt(rows.where("not core"), 0, 1).unionByName(dealt(rows.where("core"), 1, 1))
    visitors = visitors.select(*[F.col(c).alias(c) for c in visitors.columns])
    unit = ["cell", "met", "home_block", "visitor_block"]
    compared = (
        homes.groupBy(*unit)
        .cogroup(visitors.groupBy(*unit))
        .applyInArrow(_linked(how, kind), "a binary, b binary, n bigint")
    )
    return counted.unionByName(anchored).unionByName(compared)


def near_duplicate_vectors(vectors: DataFrame, how: VectorCells = VectorCells()) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    ``vectors`` needs vec_id, embedding (array of numbers) and label; other columns are
    ignored.  Vectors of one label and one length are linked from a cosine of
    ``threshold``.  A NULL label, a NULL or empty vector, a zero vector, and one with a
    NULL or non-finite component link with nothing.  Every row is a vector: repeated
    rows link with each other.  ``component_id`` is the smallest vec_id reachable; a
    NULL id takes it too, and is kept only if its class has no id.  No rows give none.
    """
    prepared, kind = _prepared(vectors)
    rows = written(prepared, "vectors")
    nodes = written(
        rows.where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.first("family").alias("family"), F.first("v").alias("v"), F.count("*").alias("w")),
        "nodes",
    )
    links = None
    for cells in in_cells(nodes, kind, how):
        found = _links(cells, kind, how)
        links = found if links is None else links.unionByName(found)
    links = written(links, "links")
    counts = links.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    roots = components(links.where("b IS NOT NULL"), "a", "b").withColumnRenamed("node", "key")
    classes = written(
        nodes.select("key", "w")
        .join(counts, "key", "left")
        .join(roots, "key", "left")
        .select(
            "key", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("root", "key").alias("root")
        ),
        "vector-classes",
    )
    ids = rows.select("vec_id", "key").where(F.col("key").isNotNull()).groupBy("key").agg(F.min("vec_id").alias("vec_id"))
    firsts = ids.join(classes, "key").groupBy("root").agg(F.min("vec_id").alias("component_id"))
    named = classes.join(firsts, "root").select("key", "n_links", F.col("component_id").alias("_component"))
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("_component"))
    return (
        rows.select("vec_id", "key")
        .join(named, "key", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
