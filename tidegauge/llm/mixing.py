"""Mixing sources to target weights by a low-discrepancy schedule.

Words are dealt in equal blocks.  Every source's documents are shuffled and laid
end to end, which cuts its words into blocks.  Slot i of the schedule gets the point
frac(i * golden ratio); the source whose interval of cumulative weights holds the
point owns the slot.  The k-th slot of a source takes its k-th block, starting
over when the source is used up.  Everything is DataFrame functions.

Ranks and running sums over a whole source would put a hot source into one task.
Both go by buckets instead: sums inside buckets, plus the sums of earlier buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import word_array
from tidegauge.session import written

GOLDEN = 0.6180339887498949


@dataclass(frozen=True)
class MixParameters:
    """Weights repeat over the sources in code-point order; ``repeats`` bounds their use.

    A block has ``total / slots`` words, at least 1 and at most ``block``; a
    bucket of documents about ``bucket`` rows.
    """

    weights: Sequence[float] = (1.0, 2.0, 3.0)
    repeats: int = 3
    block: int = 4096
    slots: int = 1 << 17
    bucket: int = 1 << 13


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words; NULL text has none), shuffle key of every document."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.size(word_array(F.col("text"))).cast("bigint").alias("size"),
        F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias(
            "shuffle"
        ),
    )


def targets(sizes: DataFrame, how: MixParameters = MixParameters()) -> DataFrame:
    """source, source_size, weight, target of each source.

    Targets share the words of all sources by weight; none exceeds ``repeats``
    times its source, and what that leaves over goes to the others by weight.
    With sources ordered by limit per weight, the k-th is held at its limit just
    if the level that the rest would reach without it lies above.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row a source from here on.
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = (F.row_number().over(order) - 1) % len(how.weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in how.weights]), (turn + 1).cast("int"))
    limited = by_source.withColumn("weight", weight).withColumn(
        "limit", (F.col("source_size") * how.repeats).cast("double")
    )
    whole = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    levelled = (
        limited.withColumn("all_words", F.sum("source_size").over(whole).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("limits_before", F.coalesce(F.sum("limit").over(earlier), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
        .withColumn(
            "level", (F.col("all_words") - F.col("limits_before")) / (F.col("all_weight") - F.col("weight_before"))
        )
    )
    free = F.col("level") <= F.col("limit") / F.col("weight")
    level = F.min(F.when(free, F.struct(F.col("limit") / F.col("weight"), F.col("level")))).over(whole)
    return levelled.select(
        "source",
        "source_size",
        "weight",
        F.least(F.col("limit"), F.col("weight") * level["level"]).alias("target"),
    )


def running(rows: DataFrame, by: list[str], bucket: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over earlier rows of ``by``, in the order (bucket, order)."""
    inside = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, bucket).agg(F.sum(value).alias("_in"))
    offsets = sums.select(
        *[F.col(c).alias(f"_{c}") for c in by],
        F.col(bucket).alias("_bucket"),
        F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before"),
    )
    same = F.col(bucket) == F.col("_bucket")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return (
        rows.withColumn("_sum", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, same)
        .withColumn(name, F.col("_sum") + F.col("_before"))
        .drop("_sum", "_before", "_bucket", *[f"_{c}" for c in by])
    )


def schedule(plan: DataFrame, block: int, n_slots: int, bucket: int) -> DataFrame:
    """source, slot, rank: owners of the slots, ranked per source.

    ``plan`` has source, target, slots_wanted, low and high (the source's part of
    the unit interval).  A source that the points leave short by a few slots gets
    them after the last point.
    """
    spark = plan.sparkSession
    points = spark.range(n_slots).select(
        F.col("id").alias("slot"), (F.col("id") * F.lit(GOLDEN) % F.lit(1.0)).alias("point")
    )
    # The intervals are the keys of a lookup by cell; a cell crosses few borders.
    cells = 4096
    spans = plan.where("slots_wanted > 0").select(
        "source", "low", "high", "slots_wanted",
        F.explode(
            F.sequence(
                F.floor(F.col("low") * cells).cast("int"),
                F.least(F.floor(F.col("high") * cells).cast("int"), F.lit(cells - 1)),
            )
        ).alias("cell"),
    )
    owned = (
        points.withColumn("cell", F.floor(F.col("point") * cells).cast("int"))
        .join(spans, "cell")
        .where("point >= low and point < high")
        .select("source", "slot", "slots_wanted", F.floor(F.col("slot") / bucket).alias("chunk"))
    )
    ranked = running(owned, ["source"], "chunk", [F.col("slot")], F.lit(1), "rank").where("rank < slots_wanted")
    ranked = ranked.select("source", "slot", "rank")
    have = ranked.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("have"))
    missing = (
        plan.join(have, F.col("source").eqNullSafe(F.col("_source")), "left")
        .withColumn("have", F.coalesce("have", F.lit(0)))
        .where("have < slots_wanted")
        .select("source", F.explode(F.expr("sequence(have, slots_wanted - 1)")).alias("rank"))
        .select("source", (F.lit(n_slots) + F.col("rank")).alias("slot"), "rank")
    )
    return ranked.unionByName(missing)


def mix(docs: DataFrame, how: MixParameters = MixParameters()) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix.

    ``documents``: doc_id, size, source_size, target, taken, source, start (place in
    its source).  ``pieces``: slot, source, start, doc_id, from_word, to_word: which
    words of which document each slot takes, in schedule order.

    NULL sources are one source, the last; NULL, empty and blank texts have size 0
    and nothing is taken from them.  Repeated rows are documents of their own.
    Only doc_id, source and text are read.  No words at all give targets of 0.
    """
    rows = written(sized(docs), "sized")
    n, words = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = max(1, min(how.block, words // how.slots))
    buckets = max(1, n // how.bucket)

    goals = targets(rows, how)
    up_to = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    span = up_to.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("target").over(Window.partitionBy())
    wanted = F.floor(F.col("target") + 0.5).cast("bigint")
    per_pass = F.ceil(F.col("source_size") / block)
    plan = goals.select(
        "source", "source_size", "target",
        wanted.alias("wanted"),
        per_pass.alias("per_pass"),
        F.coalesce(
            F.when(
                F.col("source_size") > 0,
                F.floor(wanted / F.col("source_size")) * per_pass + F.ceil((wanted % F.col("source_size")) / block),
            ),
            F.lit(0),
        ).cast("bigint").alias("slots_wanted"),
        F.coalesce(F.try_divide(F.sum("target").over(span), total), F.lit(0.0)).alias("high"),
    ).withColumn("low", F.coalesce(F.lag("high").over(up_to), F.lit(0.0)))
    plan = written(plan, "mix-plan")

    # Shuffled documents end to end; the first digits of the key are the bucket.
    shuffled = rows.withColumn(
        "bucket", F.floor(F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("double") / 2.0**32 * buckets)
    )
    key = [F.col("shuffle"), F.col("doc_id").asc_nulls_first(), F.col("size")]
    placed = running(shuffled, ["source"], "bucket", key, F.col("size"), "start").select(
        "doc_id", "source", "size", "start"
    )
    placed = written(placed, "placed")

    n_slots = int(plan.agg(F.coalesce(F.sum("slots_wanted"), F.lit(0))).first()[0])
    slots = schedule(plan, block, n_slots, how.bucket)
    per_source = plan.select(F.col("source").alias("_source"), "source_size", "target", "wanted", "per_pass")
    same_source = F.col("source").eqNullSafe(F.col("_source"))
    dealt = (
        slots.join(per_source, same_source)
        .withColumn("block", F.expr("rank % per_pass"))
        .withColumn("left", F.expr(f"wanted - floor(rank / per_pass) * source_size - (rank % per_pass) * {block}"))
        .select(F.col("source").alias("_source"), F.col("block").alias("_block"), "slot", "left")
    )
    parts = (
        placed.where("size > 0")
        .withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
        .withColumn("first", F.expr(f"greatest(start, block * {block}) - block * {block}"))
        .withColumn("last", F.expr(f"least(start + size, (block + 1) * {block}) - block * {block}"))
    )
    pieces = (
        parts.join(dealt, same_source & (F.col("block") == F.col("_block")))
        .withColumn("upto", F.expr("least(last, left)"))
        .where("upto > first")
        .select(
            "slot", "source", "start", "doc_id",
            F.expr(f"block * {block} + first - start").alias("from_word"),
            F.expr(f"block * {block} + upto - start").alias("to_word"),
        )
    )
    taken = pieces.groupBy(F.col("source").alias("_s"), F.col("start").alias("_at")).agg(
        F.sum(F.col("to_word") - F.col("from_word")).alias("taken")
    )
    # Only a document with words owns its place; empty ones share the next one's.
    own = F.col("source").eqNullSafe(F.col("_s")) & (F.col("start") == F.col("_at")) & (F.col("size") > 0)
    documents = (
        placed.join(taken, own, "left")
        .join(per_source.select("_source", "source_size", "target"), same_source)
        .select(
            "doc_id", "size", "source_size", "target",
            F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "source", "start",
        )
    )
    return documents, pieces
