"""How far the sources of a language lie apart, term by term, in exact arithmetic.

1. Terms are counted per batch, then per (language, source, term).  The shuffle is
   dealt by (language, term), so that the same pass also sums a term over sources and
   drops terms that too few documents of the language hold.
2. Kept terms of a language are numbered without gaps.  Numbers are cut into blocks,
   and a (language, source, block) becomes one row: a sorted array of term numbers
   with their counts, at most ``block_terms`` long.
3. Every unordered pair of sources of a language is a task per block, in which the two
   arrays meet by a co-group.  The shorter is galloped through the longer; shared
   terms, terms of one side, and how many terms either has are priced.
4. Block sums are added up.  Terms that neither source has all cost the same, so
   their number is enough.  A value holds both ways.

No array is longer than a block, however large a source or a vocabulary is; the
arrays of a source travel once per other source, as the pairs ask.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import text_bytes
from tidegauge.session import written

# Letters A-Z and a-z and all code points from 0x80 make terms; A-Z are lower-cased.
# UTF-8 writes code points from 0x80 in bytes from 0x80, so bytes can be looked at alone.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


@dataclass(frozen=True)
class Divergence:
    """``least_documents`` that hold a kept term; ranks of the term part; terms of a block.

    ``held`` is the number of (source, term) entries that a task counts before it
    hands them on, which bounds its memory.
    """

    least_documents: int = 10
    top: int = 10
    block_terms: int = 1 << 15
    held: int = 300_000


def _terms(raw: bytes) -> list[bytes]:
    return raw.translate(_TERM_BYTES).split()


def _batch_counts(docs: DataFrame, how: Divergence) -> DataFrame:
    """(lang, source, term, n, docs) per task, folded as far as a task can."""

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = {}
        holders: dict[tuple[str, str], Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in counts.items():
                size = len(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(pa.scalar(lang, pa.string()), size),
                        pa.repeat(pa.scalar(source, pa.string()), size),
                        pa.array(list(found), pa.binary()),
                        pa.array(list(found.values()), pa.int64()),
                        pa.array([holders[lang, source][t] for t in found], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )
            counts.clear()
            holders.clear()

        for batch in batches:
            groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
            for group, raw in zip(groups, text_bytes(batch.column("text"))):
                found = Counter(_terms(raw))
                if found:
                    counts.setdefault(group, Counter()).update(found)
                    holders.setdefault(group, Counter()).update(found.keys())
                    if sum(map(len, counts.values())) > how.held:
                        yield from out()
        yield from out()

    return docs.mapInArrow(fold, "lang string, source string, term binary, n bigint, docs bigint")


def _kept_terms(docs: DataFrame, how: Divergence) -> DataFrame:
    """(lang, source, term, n, lang_n, part, place): counts of kept terms.

    ``part`` and ``place`` number the kept terms of a language inside a shuffle
    partition, which holds all rows of its terms, sorted.
    """
    by_term = Window.partitionBy("lang", "term")
    counted = (
        _batch_counts(docs, how)
        .repartition("lang", "term")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .withColumns({"lang_n": F.sum("n").over(by_term), "lang_docs": F.sum("docs").over(by_term)})
        .where(F.col("lang_docs") >= how.least_documents)
        .select("lang", "source", "term", "n", "lang_n")
        .sortWithinPartitions("lang", "term", "source")
    )

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, place = (None, None), -1
        for batch in batches:
            if not batch.num_rows:
                continue
            lang, term = batch.column("lang"), batch.column("term")
            new_lang = np.ones(len(lang), bool)
            new_lang[0] = lang[0].as_py() != last[0]
            new_lang[1:] = pc.not_equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False)
            new_term = new_lang.copy()
            new_term[0] |= term[0].as_py() != last[1]
            new_term[1:] |= pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
            steps = np.cumsum(new_term) + place
            # a language's first term has place 0
            starts = np.where(new_lang, steps, -1)
            if not new_lang[0]:
                starts[0] = 0
            places = steps - np.maximum.accumulate(starts)
            last, place = (lang[-1].as_py(), term[-1].as_py()), int(places[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.repeat(pa.scalar(part, pa.int64()), len(lang)), pa.array(places)],
                names=[*batch.schema.names, "part", "place"],
            )

    schema = "lang string, source string, term binary, n bigint, lang_n bigint, part bigint, place bigint"
    return counted.mapInArrow(number, schema)


def _numbered(kept: DataFrame, how: Divergence) -> DataFrame:
    """(lang, source, block, number, n): numbers of a language's terms have no gaps.

    One row per language and shuffle partition is sorted to give every partition's
    first number.
    """
    parts = kept.groupBy("lang", "part").agg((F.max("place") + 1).alias("terms"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.select("lang", "part", F.coalesce(F.sum("terms").over(before), F.lit(0)).alias("first"))
    at = kept.join(firsts, ["lang", "part"]).withColumn("_at", F.col("first") + F.col("place"))
    return at.select(
        "lang",
        "source",
        F.expr(f"_at DIV {how.block_terms}").alias("block"),
        F.expr(f"CAST(_at % {how.block_terms} AS INT)").alias("number"),
        "n",
    )


def encode_counts(numbers: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted array of (term number, count): steps between numbers, then counts as narrow as they fit."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(counts.max(initial=0)) < 1 << 8 * w)
    steps = np.diff(numbers, prepend=0).astype("<u4")
    return bytes([width]) + steps.tobytes() + counts.astype(f"<u{width}").tobytes()


def decode_counts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of ``encode_counts``."""
    width = raw[0]
    size = (len(raw) - 1) // (4 + width)
    steps = np.frombuffer(raw, "<u4", size, 1)
    return np.cumsum(steps, dtype=np.int64), np.frombuffer(raw, f"<u{width}", size, 1 + 4 * size).astype(np.int64)


def _arrays(numbered: DataFrame) -> DataFrame:
    """(lang, source, block, counts): one sorted array per group and block."""

    def encode(key: tuple, rows: pa.Table) -> pa.Table:
        numbers, counts = rows.column("number").to_numpy(), rows.column("n").to_numpy()
        order = np.argsort(numbers)
        return pa.table(
            {
                "lang": [key[0].as_py()],
                "source": [key[1].as_py()],
                "block": pa.array([key[2].as_py()], pa.int64()),
                "counts": pa.array([encode_counts(numbers[order], counts[order])], pa.binary()),
            }
        )

    schema = "lang string, source string, block bigint, counts binary"
    return numbered.groupBy("lang", "source", "block").applyInArrow(encode, schema)


def gallop(few: np.ndarray, many: np.ndarray, run: int = 256) -> np.ndarray:
    """Place in ``many`` of every element of ``few``, or -1; both sorted and distinct.

    Runs of ``few`` are looked up together.  From where the last run ended the reach
    doubles until it passes the run's last element; the search is inside that reach.
    """
    places = np.full(len(few), -1, np.int64)
    low = 0
    for start in range(0, len(few), run):
        part = few[start : start + run]
        reach = run
        while low + reach < len(many) and many[low + reach] < part[-1]:
            reach *= 2
        window = many[low : low + reach + 1]
        at = np.searchsorted(window, part)
        found = at < len(window)
        found[found] = window[at[found]] == part[found]
        places[start : start + run][found] = low + at[found]
        low += int(at[-1])
        if low >= len(many):
            break
    return places


def price(counts: np.ndarray, size: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / size), by long division so that nothing overflows."""
    whole, rest = np.divmod(counts + 2, size)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, size)
        whole = whole * 1000 + digit
    return 1 + whole


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); p and q stay below 2^31."""
    return (p - q) * (p - q) // (p + q)


def merged_value(
    a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size_a: int, size_b: int
) -> tuple[int, int]:
    """Value of the terms that either side holds, and how many they are."""
    if len(a[0]) > len(b[0]):
        a, b, size_a, size_b = b, a, size_b, size_a
    places = gallop(a[0], b[0])
    shared = places >= 0
    alone = np.ones(len(b[0]), bool)
    alone[places[shared]] = False
    none = np.zeros(1, np.int64)
    value = (
        gap(price(a[1][shared], size_a), price(b[1][places[shared]], size_b)).sum()
        + gap(price(a[1][~shared], size_a), price(none, size_b)).sum()
        + gap(price(none, size_a), price(b[1][alone], size_b)).sum()
    )
    return int(value), len(a[0]) + int(alone.sum())


def _pair_values(arrays: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, a, b, value, held): per pair of sources, over the terms that either holds."""
    sides = []
    for side in ("a", "b"):
        given = pairs.join(arrays.withColumnRenamed("source", side), ["lang", side])
        # both sides come from the same tables; new names keep their columns apart
        sides.append(given.select(*[F.col(c).alias(c) for c in given.columns]).groupBy("lang", "a", "b", "block"))
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        one, other = (decode_counts(t.column("counts")[0].as_py()) if t.num_rows else empty for t in (left, right))
        known = left if left.num_rows else right
        value, held = merged_value(
            one, other, known.column("size_a")[0].as_py(), known.column("size_b")[0].as_py()
        )
        return pa.table(
            {
                "lang": [key[0].as_py()],
                "a": [key[1].as_py()],
                "b": [key[2].as_py()],
                "value": pa.array([value], pa.int64()),
                "held": pa.array([held], pa.int64()),
            }
        )

    schema = "lang string, a string, b string, value bigint, held bigint"
    blocks = sides[0].cogroup(sides[1]).applyInArrow(merge, schema)
    return blocks.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("held").alias("held"))


def _priced(count: str, size: str) -> str:
    """``price`` as SQL; decimals hold 10^9 times any count."""
    return f"(1 + (CAST({count} + 2 AS DECIMAL(20, 0)) * 1000000000BD) DIV CAST({size} AS DECIMAL(20, 0)))"


def _gap_sql(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) DIV (({p}) + ({q}))"


def source_divergence(docs: DataFrame, how: Divergence = Divergence()) -> DataFrame:
    """lang, source, part, item, value, rank: how every source differs.

    Part ``pair`` has each other source of the language with the sum of
    floor((p-q)^2/(p+q)) over the language's kept terms; part ``term`` has the terms
    that a source holds more than the language does, up to rank ``top``.

    ``docs`` needs text, lang and source; other columns are ignored.  NULL in one of
    the three is the empty string.  Every row is a document, repeated ones too.  A
    group without a kept term has its pairs, and no terms.  Without kept terms all
    pairs are 0.  Equal values are ranked by item in UTF-8 order.  No documents, no rows.
    """
    named = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    )
    kept = written(_kept_terms(named, how), "kept-terms")
    vocabulary = (
        kept.groupBy("lang", "part").agg((F.max("place") + 1).alias("v")).groupBy("lang").agg(F.sum("v").alias("v"))
    )
    groups = written(
        named.select("lang", "source")
        .distinct()
        .join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
        .join(kept.groupBy("lang").agg(F.sum("n").alias("lang_total")), "lang", "left")
        .join(vocabulary, "lang", "left")
        .na.fill(0, ["n", "lang_total", "v"])
        .withColumns({"size": F.col("n") + 2 * F.col("v"), "lang_size": F.col("lang_total") + 2 * F.col("v")}),
        "groups",
    )
    a, b = (
        groups.select("lang", F.col("source").alias(side), F.col("size").alias(f"size_{side}"), "v")
        for side in ("a", "b")
    )
    pairs = a.join(b.drop("v"), "lang").where("a < b")
    arrays = written(_arrays(_numbered(kept, how)), "term-arrays")
    values = _pair_values(arrays, pairs)
    absent = _gap_sql(_priced("0", "size_a"), _priced("0", "size_b"))
    valued = pairs.join(values, ["lang", "a", "b"], "left").select(
        "lang",
        "a",
        "b",
        F.expr(f"CASE WHEN v = 0 THEN 0L ELSE coalesce(value, 0L) + (v - coalesce(held, 0L)) * ({absent}) END").alias(
            "value"
        ),
    )
    both = valued.select(
        "lang",
        F.inline(
            F.array(
                F.struct(F.col("a").alias("source"), F.col("b").alias("item"), "value"),
                F.struct(F.col("b").alias("source"), F.col("a").alias("item"), "value"),
            )
        ),
    )
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair_part = both.select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank")
    )
    rated = (
        kept.select("lang", "source", F.col("term").cast("string").alias("item"), F.col("n").alias("held"), "lang_n")
        .join(groups.select("lang", "source", "size", "lang_size"), ["lang", "source"])
        .withColumns({"p": F.expr(_priced("held", "size")), "q": F.expr(_priced("lang_n", "lang_size"))})
        .where("held > 0 and p > q")
        .withColumn("value", F.expr(_gap_sql("p", "q")))
    )
    term_part = rated.select(
        "lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank")
    ).where(F.col("rank") <= how.top)
    return pair_part.unionByName(term_part)
