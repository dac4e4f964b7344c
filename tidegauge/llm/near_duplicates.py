"""Near-duplicate classes by a signature-coordinate inverted join.

1. Each text becomes its set of word shingles and a MinHash signature.  Rows with
   the same word sequence share one key, and from there on are one entry.
2. Every (coordinate, value) of a signature is a posting.  Two texts that agree in
   at least ``matches`` of ``coordinates`` must share one of the
   ``coordinates - matches + 1`` rarest postings of either (prefix), so the rest,
   the long lists, are skipped.
3. Inside a list, agreements are counted over the whole signature, which stands in
   for merging the skipped lists.  Pairs at or above the match threshold tie their
   texts into a family; only ties that join something new are given out, so a
   list of n texts yields fewer than n rows.
4. In a family, full shingle sets are compared exactly by block products, and
   again only the links that join something new are given out.
5. Classes are the connected components of the confirmed links.

Lists and families have no cap.  A long one is cut into blocks, and every pair of
blocks is one unit of work, so that no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import LOWER, UPPER, arrow_pass, release_memory, shingle_hashes, text_bytes
from tidegauge.llm.components import components
from tidegauge.session import written

FOLD_CASE = bytes.maketrans(UPPER.encode(), LOWER.encode())


@dataclass(frozen=True)
class NearDuplicates:
    """Parameters.

    ``width`` words a shingle; pairs count from ``percent`` of their union.  With
    the defaults a pair at exactly 80 % agrees in fewer than 14 of 32 coordinates
    with probability 5e-7, and in fewer than 37 of 64 with 7e-6; more similar
    pairs are missed still more rarely.  ``list_block`` and ``family_block`` bound
    the texts of a unit of work, ``block_shingles`` its shingles.
    """

    width: int = 5
    percent: int = 80
    coordinates: int = 32
    matches: int = 14
    signature: int = 64
    signature_matches: int = 37
    list_block: int = 1024
    family_block: int = 512
    block_shingles: int = 1 << 20

    def multipliers(self) -> np.ndarray:
        rng = np.random.default_rng(7)
        return rng.integers(1, 2**63, self.signature, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


SKETCH = "doc_id bigint, text_hash bigint, key binary, n_shingles bigint, signature binary"


def _words(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD_CASE).split()


def sketches(docs: DataFrame, how: NearDuplicates) -> DataFrame:
    """One row per document: key of its word sequence, set size, signature.

    A text without words has a NULL key.
    """
    multipliers = how.multipliers()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, sizes, signatures = [], [], []
        for raw in text_bytes(batch.column("text")):
            words = _words(raw)
            shingles = shingle_hashes(words, how.width)
            sizes.append(len(shingles))
            if not words:
                keys.append(None)
                signatures.append(None)
                continue
            keys.append(xxhash.xxh128_digest(b" ".join(words)))
            least = np.full(how.signature, np.iinfo(np.uint64).max)
            for i in range(0, len(shingles), 4096):
                part = shingles[i : i + 4096]
                least = np.minimum(least, (multipliers[:, None] * part[None, :]).min(axis=1))
            signatures.append((least >> np.uint64(32)).astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text_hash"),
                pa.array(keys, pa.binary()),
                pa.array(sizes, pa.int64()),
                pa.array(signatures, pa.binary()),
            ],
            names=["doc_id", "text_hash", "key", "n_shingles", "signature"],
        )

    return arrow_pass(_identified(docs), work, SKETCH)


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text"),
        F.xxhash64("text").alias("text_hash"),
    )


def _postings(texts: DataFrame, how: NearDuplicates) -> DataFrame:
    """(key, posting) of the prefixes; postings that only one text has are left out."""
    c = how.coordinates

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = batch.column("signature").cast(pa.binary()).to_pylist()
        values = np.frombuffer(b"".join(raw), "<u4").reshape(len(raw), how.signature)[:, :c]
        posting = (np.arange(c, dtype=np.int64)[None, :] << 32) | values.astype(np.int64)
        rows = np.repeat(np.arange(len(raw)), c)
        return pa.RecordBatch.from_arrays(
            [batch.column("key").take(pa.array(rows)), pa.array(posting.ravel())],
            names=["key", "posting"],
        )

    posted = arrow_pass(texts.select("key", "signature"), work, "key binary, posting bigint")
    shared = posted.groupBy("posting").agg(F.count("*").alias("n")).where("n > 1")
    mine = posted.join(shared, "posting")
    # Postings of one text only cannot collide; they fill the prefix first.
    prefix = F.expr(f"slice(sorted, 1, greatest(0, {c - how.matches + 1} - ({c} - size(sorted))))")
    return (
        mine.groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("n", "posting"))).alias("sorted"))
        .select("key", F.explode(prefix).alias("entry"))
        .select("key", F.col("entry.posting").alias("posting"), F.col("entry.n").alias("n"))
    )


def _in_blocks(rows: DataFrame, group: str, n_blocks, member) -> DataFrame:
    """Copy each row to all pairs of blocks that its block takes part in.

    ``side`` is 0 for the left block of a pair (or the only one), 1 for the right.
    """
    with_block = rows.withColumn("_nb", n_blocks.cast("int")).withColumn(
        "_b", F.pmod(member, F.col("_nb")).cast("int")
    )
    copies = F.transform(
        F.sequence(F.lit(0), F.col("_nb") - 1),
        lambda o: F.struct(
            F.least(o, F.col("_b")).alias("bi"),
            F.greatest(o, F.col("_b")).alias("bj"),
            (o < F.col("_b")).cast("int").alias("side"),
        ),
    )
    spread = with_block.withColumn("_p", F.explode(copies)).select(
        *rows.columns, "_p.bi", "_p.bj", "_p.side"
    )
    return spread.repartition(group, "bi", "bj").sortWithinPartitions(group, "bi", "bj", "side")


def _runs(
    batches: Iterable[pa.RecordBatch], by: list[str], work: Callable[[pa.Table], list[tuple[bytes, bytes]]]
) -> Iterator[pa.RecordBatch]:
    """Apply ``work`` to each run of rows with equal ``by``; only one run is held beyond a batch."""
    held: list[pa.RecordBatch] = []
    held_key = None

    def out(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())],
            names=["a", "b"],
        )

    for batch in batches:
        keys = list(zip(*[batch.column(c).to_pylist() for c in by]))
        found: list[tuple[bytes, bytes]] = []
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            piece = batch.slice(start, i - start)
            if held and held_key != keys[start]:
                found += work(pa.Table.from_batches(held))
                held = []
            held_key = keys[start]
            held.append(piece)
            start = i
        if found:
            yield out(found)
        del batch
        release_memory()
    if held:
        pairs = work(pa.Table.from_batches(held))
        if pairs:
            yield out(pairs)
    release_memory()


def _spanning(keys: list[bytes], a: np.ndarray, b: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Ties of all that the pairs join, each to the smallest key of its part."""
    parent = list(range(len(keys)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    joined = 0
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            if keys[rx] < keys[ry]:
                rx, ry = ry, rx
            parent[rx] = ry
            joined += 1
            if joined == len(keys) - 1:
                break
    return [(keys[x], keys[root(x)]) for x in range(len(keys)) if parent[x] != x]


def _tied(how: NearDuplicates) -> Callable[[pa.Table], list[tuple[bytes, bytes]]]:
    """Pairs of a list whose signatures agree in enough coordinates."""

    def work(rows: pa.Table) -> list[tuple[bytes, bytes]]:
        keys = rows.column("key").to_pylist()
        n = len(keys)
        if n < 2:
            return []
        side = np.array(rows.column("side").to_pylist())
        values = np.frombuffer(b"".join(rows.column("signature").to_pylist()), "<u4").reshape(n, -1)
        left = np.nonzero(side == 0)[0]
        right = np.nonzero(side == 1)[0] if side.any() else left
        found_a, found_b = [], []
        for i in left.tolist():
            others = right if side.any() else left[left > i]
            if not len(others):
                continue
            same = values[others] == values[i]
            ok = (same[:, : how.coordinates].sum(1) >= how.matches) & (same.sum(1) >= how.signature_matches)
            hits = others[ok]
            found_a += [i] * len(hits)
            found_b += hits.tolist()
        return _spanning(keys, np.array(found_a, int), np.array(found_b, int))

    return work


def _flat(shingles: pa.Array) -> np.ndarray:
    """All hashes of a column of shingle sets in a row, without a copy of each set."""
    shingles = shingles.cast(pa.large_binary())
    ends = np.frombuffer(shingles.buffers()[1], np.int64)[shingles.offset : shingles.offset + len(shingles) + 1]
    return np.frombuffer(shingles.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<u8")


def _confirmed(how: NearDuplicates) -> Callable[[pa.Table], list[tuple[bytes, bytes]]]:
    """Links of a family block: exact intersections as a product of incidence matrices."""

    def work(rows: pa.Table) -> list[tuple[bytes, bytes]]:
        keys = rows.column("key").to_pylist()
        n = len(keys)
        if n < 2:
            return []
        side = np.array(rows.column("side").to_pylist())
        sizes = pc.binary_length(rows.column("shingles")).to_numpy().astype(np.int64) // 8
        owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
        flat = np.concatenate([_flat(chunk) for chunk in rows.column("shingles").chunks])
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        del flat
        several = count[column] > 1
        owner, column = owner[several], column[several].astype(np.int32)
        number = np.cumsum(count > 1) - 1
        column = number[column]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((n, n), np.float32)
        wide = 1 << 12
        edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + 1 + wide, wide))
        for k in range(len(edges) - 1):
            part = slice(edges[k], edges[k + 1])
            incidence = np.zeros((n, wide), np.float32)
            incidence[owner[part], column[part] - k * wide] = 1
            common += incidence @ incidence.T
        shared = np.rint(common).astype(np.int64)
        union = sizes[:, None] + sizes[None, :] - shared
        link = 100 * shared >= how.percent * union
        if side.any():
            link &= (side[:, None] == 0) & (side[None, :] == 1)
        else:
            link = np.triu(link, 1)
        a, b = np.nonzero(link)
        return _spanning(keys, a, b)

    return work


def _identity(doc_id: Column, text_hash: Column) -> Column:
    """One hash of what a row is found by."""
    return F.xxhash64(F.coalesce(doc_id.cast("bigint"), F.lit(-1)), text_hash)


def may_be_in(keys: DataFrame, most_bits: int = 1 << 27) -> Callable[[Column], Column]:
    """A test of a 64-bit hash against those in ``keys`` (column h): surely not, or perhaps.

    A Bloom filter of 16 bits a key and at most ``most_bits`` (16 MB), which bounds
    what is sent to the tasks.  Beyond that it answers perhaps more often; whatever
    passes is joined exactly, so nothing depends on it but the size of a shuffle.
    """
    wanted = 16 * max(1, keys.count())
    bits = min(most_bits, 1 << max(16, (wanted - 1).bit_length()))
    mask = F.lit(bits - 1).cast("bigint")
    places = F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask)))
    words = (
        keys.select(places.alias("place"))
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS INT))")).alias("bits"))
        .toArrow()
    )
    filled = np.zeros(bits >> 6, np.int64)
    filled[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    filled = filled.view(np.uint64)

    @F.pandas_udf("boolean")
    def perhaps(h: pd.Series) -> pd.Series:
        x = h.to_numpy().astype(np.int64).view(np.uint64)
        hit = np.ones(len(x), bool)
        for place in (x & np.uint64(bits - 1), (x >> np.uint64(32)) & np.uint64(bits - 1)):
            hit &= (filled[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return pd.Series(hit)

    return perhaps


def families(texts: DataFrame, how: NearDuplicates) -> DataFrame:
    """(node, root) of texts tied by enough equal coordinates."""
    postings = written(_postings(texts, how), "postings")
    listed = postings.join(texts.select("key", "signature"), "key")
    member = F.xxhash64("key")
    blocks = F.ceil(F.col("n") / how.list_block)
    spread = _in_blocks(listed, "posting", blocks, member)
    work = _tied(how)
    ties = spread.mapInArrow(lambda bs: _runs(bs, ["posting", "bi", "bj"], work), "a binary, b binary")
    return components(ties, "a", "b")


def confirmed_links(docs: DataFrame, texts: DataFrame, family: DataFrame, how: NearDuplicates) -> DataFrame:
    """(a, b): links inside families, enough of them to connect every class."""
    members = written(
        texts.select("key", "doc_id", "text_hash", "n_shingles").join(
            family.withColumnRenamed("node", "key"), "key"
        ),
        "family-members",
    )
    sizes = members.groupBy("root").agg(
        F.ceil(
            F.greatest(F.count("*") / how.family_block, F.sum("n_shingles") / how.block_shingles)
        ).alias("blocks")
    )
    wanted = members.select(
        F.coalesce("doc_id", F.lit(-1)).alias("w_id"), F.col("text_hash").alias("w_hash"),
        F.col("key").alias("w_key"), "root",
    )
    # Only texts that are perhaps in a family are shuffled.
    perhaps = may_be_in(members.select(_identity(F.col("doc_id"), F.col("text_hash")).alias("h")))
    found = _identified(docs).where(perhaps(_identity(F.col("doc_id"), F.col("text_hash"))))
    # Equal rows, and one text under NULL ids, are found alike; one of them stands for its key.
    found = found.select(
        F.coalesce("doc_id", F.lit(-1)).alias("w_id"), F.col("text_hash").alias("w_hash"), "text"
    ).dropDuplicates(["w_id", "w_hash"])
    full = found.join(wanted, ["w_id", "w_hash"]).select("w_key", "root", "text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_hashes(_words(raw), how.width).tobytes() for raw in text_bytes(batch.column("text"))]
        return pa.RecordBatch.from_arrays(
            [batch.column("w_key"), batch.column("root"), pa.array(sets, pa.binary())],
            names=["key", "root", "shingles"],
        )

    sets = arrow_pass(full, work, "key binary, root binary, shingles binary")
    spread = _in_blocks(sets.join(sizes, "root"), "root", F.col("blocks"), F.xxhash64("key"))
    check = _confirmed(how)
    return spread.mapInArrow(lambda bs: _runs(bs, ["root", "bi", "bj"], check), "a binary, b binary")


def _classified(docs: DataFrame, how: NearDuplicates) -> DataFrame:
    """Per document: doc_id, text_hash, n_shingles, root (key of its class), component_id."""
    sketched = written(sketches(docs, how), "sketches")
    texts = written(
        sketched.where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"),
        )
        .select("key", "first.doc_id", "first.text_hash", "n_shingles", "signature"),
        "texts",
    )
    family = written(families(texts, how), "families")
    links = confirmed_links(docs, texts, family, how)
    classes = written(components(links, "a", "b"), "classes")
    rooted = texts.select("key", "doc_id").join(
        classes.withColumnRenamed("node", "key"), "key", "left"
    ).withColumn("root", F.coalesce("root", "key"))
    ids = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(ids, "root").select("key", "root", "component_id")
    with_class = sketched.select("doc_id", "text_hash", "n_shingles", "key").join(named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return with_class.select(
        "doc_id", "text_hash", "n_shingles", "root", component.alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicate_classes(docs: DataFrame, how: NearDuplicates = NearDuplicates()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``docs`` needs doc_id and text; other columns are ignored.  A component's id is
    the smallest doc_id in it.  NULL, empty and blank texts have no shingles and
    are linked with nothing.  Repeated rows are copies.  A NULL doc_id takes the
    smallest id of its class, or NULL, and is kept only if the class has no id.
    """
    return _classified(docs, how).select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame, how: NearDuplicates = NearDuplicates()) -> DataFrame:
    """The documents with one left of every class; columns stay as they are.

    The row of the smallest doc_id stays.  If several rows of a class carry that
    id, or a class has no id at all, the one with the smallest text hash stays,
    and one of equal rows.  Texts without words all stay.
    """
    doc_id = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1))
    classes = written(_classified(docs, how).where("root is not null"), "near-classes")
    stays = classes.where("kept").groupBy("root").agg(F.min("text_hash").alias("first_hash"))
    gone = (
        classes.join(stays, "root")
        .where("not kept or text_hash != first_hash")
        .select(F.coalesce("doc_id", F.lit(-1)).alias("_g_id"), F.col("text_hash").alias("_g_hash"))
        .distinct()
    )
    gone = written(gone, "gone")
    # Rows that are surely not among them stay as they are, without a shuffle.
    perhaps = may_be_in(gone.select(_identity(F.col("_g_id"), F.col("_g_hash")).alias("h")))
    unsure = perhaps(_identity(F.col("doc_id"), F.xxhash64("text")))
    left = docs.where(~unsure).unionByName(
        docs.where(unsure).join(
            gone, (doc_id == F.col("_g_id")) & (F.xxhash64("text") == F.col("_g_hash")), "left_anti"
        )
    )
    equal = classes.where("kept").groupBy("doc_id", "text_hash").count().where("count > 1")
    if equal.limit(1).count():
        named = {"_id": doc_id, "_hash": F.xxhash64("text")}
        mine = equal.select(
            F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("text_hash").alias("_hash")
        )
        known = left.withColumns(named)
        once = known.join(mine, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])
        left = (
            known.join(mine, ["_id", "_hash"], "left_anti").unionByName(once).select(*docs.columns)
        )
    return left
