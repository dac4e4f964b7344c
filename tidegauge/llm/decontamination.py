"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words are counted over all documents.
2. Benchmark items are cut into passages, weighted by TF-IDF, and taken in blocks.
   A randomised SVD of each block, whose products are summed by Spark tasks, gives
   a latent space that holds nearly all of its energy.
3. Every document is cut into overlapping windows that hold any span of a passage's
   length.  Each distinct word of a window adds its product with a passage in that
   space.  The sum is held against what the passage needs, not against the window's
   length, so foreign or repeated words beside a copy take nothing from it.
4. Candidates are settled on words: the longest common subsequence within a span of
   about the passage's length, or a shorter one together with its answer, the last
   words, in one piece.  Longer items are also settled as a whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import LOWER, UPPER, arrow_pass, text_bytes
from tidegauge.llm.warc_packages import open_store
from tidegauge.session import new_table_path, written

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_MARKS = b".,;:!?\"'()[]{}"


@dataclass(frozen=True)
class DecontaminationParameters:
    """Passages of ``window`` words at steps of half; ``block`` passages share a latent space.

    Its ``rank`` may reach the block's size, so that no passage is cut off.
    An item of fewer than ``least_words`` words must recur as it is, word by word.
    ``subsequence`` is the share of the words of an item, or of one passage of a
    longer item, that must recur in order; with the last ``answer`` words in one
    piece, ``with_answer`` is enough.
    """

    window: int = 64
    block: int = 256
    dims: int = 1 << 16
    rank: int = 256
    energy: float = 1.0
    subsequence: float = 0.8
    with_answer: float = 0.65
    answer: int = 5
    least_words: int = 8


def plain_words(raw: bytes) -> list[bytes]:
    """Lower-case words without punctuation."""
    return raw.translate(_LOWER, _MARKS).split()


class WordColumns(dict):
    """Column of each word, remembered for up to ``most`` words; ``dims`` is a power of two."""

    def __init__(self, dims: int, most: int = 500_000):
        super().__init__()
        self.dims, self.most = dims, most

    def __missing__(self, word: bytes) -> int:
        self[word] = column = xxhash.xxh64_intdigest(word) & (self.dims - 1)
        return column

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _columns(words: list[bytes], dims: int) -> np.ndarray:
    return WordColumns(dims).of(words)


def inverse_frequencies(docs: DataFrame, how: DecontaminationParameters) -> np.ndarray:
    """ln((N + 1) / (df + 1)) of each hashed word over all documents; at least 0.05.

    Each task sends one count per hashed word, so the driver's sum is bounded.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(how.dims + 1, np.int64)
        columns = WordColumns(how.dims)
        for batch in batches:
            for raw in text_bytes(batch.column("text")):
                # A column beyond the hashed words counts the documents.
                counts[-1] += 1
                counts[columns.of(list(set(plain_words(raw))))] += 1
        used = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["w", "n"])

    rows = docs.select("text").mapInArrow(run, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    table = rows.toArrow()
    counts = np.zeros(how.dims + 1, np.int64)
    counts[table.column("w").to_numpy()] = table.column("n").to_numpy()
    return np.maximum(np.log((counts[-1] + 1) / (counts[:-1] + 1)), 0.05)


def benchmark_passages(benchmark: DataFrame, how: DecontaminationParameters) -> DataFrame:
    """item_id, words of the passage, words of the item; longer items give several passages."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, passages, items = [], [], []
        for item, raw in zip(batch.column("item_id").to_pylist(), text_bytes(batch.column("text"))):
            words = plain_words(raw)
            if not words:
                continue
            half = how.window // 2
            starts = range(0, max(1, len(words) - half), half)
            for s in starts:
                ids.append(item)
                passages.append(words[s : s + how.window])
                items.append(words)
        kind = pa.list_(pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(passages, kind), pa.array(items, kind)],
            names=["item_id", "passage", "item"],
        )

    picked = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    return arrow_pass(picked, work, "item_id bigint, passage array<binary>, item array<binary>")


@dataclass
class LatentSpace:
    """One block of passages: column of each hashed word, and what windows are held against.

    ``reach`` has, per column and passage, the product of a word with the passage in
    the latent space, as a share of what the passage needs to be a candidate.
    ``halves`` lists how many half windows surely hold a passage's span, and the
    passages that need as many.
    """

    column: np.ndarray
    reach: np.ndarray
    halves: list[tuple[int, np.ndarray]]
    passages: list[list[bytes]]
    items: list[tuple[int | None, list[bytes]]]


def _weighted(words: list[bytes], column: np.ndarray, idf: np.ndarray, dims: int) -> np.ndarray:
    """Unit vector of a passage over the block's columns; products of two weights are in IDF."""
    c = np.unique(_columns(words, dims))
    x = np.zeros(column.max() + 1)
    x[column[c]] = np.sqrt(idf[c])
    return x / (np.linalg.norm(x) + 1e-12)


def _span(n: int) -> int:
    """Words that may hold the recurring part of ``n`` words."""
    return n + n // 4 + 2


def _needed(weight: np.ndarray, times: np.ndarray, share: float) -> float:
    """The least sum of the weights of distinct words that ``share`` of all words can have.

    ``times`` has how often each occurs.  What the others weigh is bounded by taking
    the heaviest for its occurrences first, the last one in part.
    """
    lost = int(times.sum()) - int(np.ceil(share * times.sum() - 1e-9))
    order = np.argsort(-weight / times, kind="stable")
    gone = np.clip(lost - np.concatenate([[0], np.cumsum(times[order])[:-1]]), 0, times[order])
    return float(weight.sum() - (weight[order] / times[order] * gone).sum())


def latent_space(block: DataFrame, idf: np.ndarray, how: DecontaminationParameters) -> LatentSpace:
    """Randomised SVD of a block's TF-IDF matrix A.

    The range of A'A is found from random columns with one power step: Spark tasks
    hold rows of A and send A'(A Q), which is as large as the block's vocabulary
    allows (``block * window`` words at most) times the rank.
    """
    rows = block.select("item_id", "passage", "item").collect()  # one block, bounded
    used = np.unique(np.concatenate([_columns([bytes(w) for w in r["passage"]], how.dims) for r in rows]))
    column = np.full(how.dims, -1, np.int64)
    column[used] = np.arange(len(used))
    width = min(how.rank + 10, len(used), len(rows) + 10)
    q = np.random.default_rng(5).standard_normal((len(used), width)).astype(np.float32)

    def product(q: np.ndarray) -> np.ndarray:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(q.shape, np.float32)
            for batch in batches:
                a = [_weighted(p, column, idf, how.dims) for p in batch.column("passage").to_pylist()]
                a = np.array(a, np.float32).reshape(-1, len(q))
                total += a.T @ (a @ q)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        parts = block.select("passage").mapInArrow(run, "part binary").collect()
        return sum(np.frombuffer(p["part"], np.float32).reshape(q.shape) for p in parts)

    for _ in range(2):
        q = np.linalg.qr(product(q))[0].astype(np.float32)
    a = np.array([_weighted([bytes(w) for w in r["passage"]], column, idf, how.dims) for r in rows])
    _, s, vt = np.linalg.svd(a @ q, full_matrices=False)
    kept = int(np.searchsorted(np.cumsum(s**2) / max(1e-12, (s**2).sum()), how.energy)) + 1
    basis = (q @ vt.T[:, : min(kept, how.rank)]).astype(np.float32)
    passages = a @ basis
    weight = np.sqrt(idf[used])
    reach = (weight[:, None] * (basis @ passages.T)).astype(np.float32)
    items = [(r["item_id"], [bytes(w) for w in r["item"]]) for r in rows]
    texts = [[bytes(w) for w in r["passage"]] for r in rows]
    half = how.window // 2
    halves: dict[int, list[int]] = {}
    for i, words in enumerate(texts):
        c, times = np.unique(column[_columns(words, how.dims)], return_counts=True)
        # Passages of a longer item overlap by half: one has at least half of the item's share.
        share = how.with_answer / (1 + (len(items[i][1]) > len(words)))
        if len(words) < how.least_words:
            share = 1.0
        reach[:, i] /= max(1e-9, _needed(reach[c, i], times, share)) * (1 - 1e-3)
        halves.setdefault(-(-(_span(len(words)) + half - 1) // half), []).append(i)
    return LatentSpace(column, reach, [(k, np.array(i)) for k, i in sorted(halves.items())], texts, items)


def subsequence_length(masks: dict[bytes, int], n: int, words: list[bytes]) -> int:
    """Longest common subsequence by bit-parallel steps; ``masks`` has the places of each word."""
    full = (1 << n) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _settled(item: list[bytes], words: list[bytes], lo: int, hi: int, how: DecontaminationParameters) -> float:
    """Best share of the item's words recurring in order in a span between ``lo`` and ``hi``; 0 if too few."""
    n = len(item)
    if n < how.least_words:
        return float(any(words[s : s + n] == item for s in range(lo, hi - n + 1)))
    near = set(words[lo:hi])
    if sum(w in near for w in item) < how.with_answer * n:
        return 0.0
    masks: dict[bytes, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    span, step = _span(n), max(1, n // 8)
    answer = item[-how.answer :]
    best = 0.0
    for s in range(lo, max(lo + 1, hi - span + step), step):
        part = words[s : s + span]
        share = subsequence_length(masks, n, part) / n
        if share < how.subsequence:
            in_one_piece = share >= how.with_answer and any(
                part[i : i + len(answer)] == answer for i in range(len(part) - len(answer) + 1)
            )
            share = share if in_one_piece else 0.0
        best = max(best, share)
    return best


def candidates(c: np.ndarray, space: LatentSpace, how: DecontaminationParameters) -> Iterator[tuple[int, int, int]]:
    """(passage, start, end) of the windows of a text that may hold a passage.

    A word counts once for every half window it occurs in.
    """
    half = how.window // 2
    n = -(-len(c) // half)
    known = space.column[c]
    at = np.nonzero(known >= 0)[0]
    wide = space.reach.shape[0]
    own = np.unique(at // half * wide + known[at])
    if not len(own):
        return
    place, column = np.divmod(own, wide)
    sums = np.zeros((n, space.reach.shape[1]), np.float32)
    # At most a few thousand words are looked up at once, however long the text.
    edges = np.searchsorted(place, np.arange(0, n + 128, 128))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if lo < hi:
            first = np.nonzero(np.diff(place[lo:hi], prepend=-1))[0]
            sums[place[lo:hi][first]] = np.add.reduceat(space.reach[column[lo:hi]], first, axis=0)
    for k, passages in space.halves:
        part = sums[:, passages]
        total = part[: max(1, n - k + 1)].copy()
        for j in range(1, min(k, n)):
            total += part[j : j + len(total)]
        for s, i in np.argwhere(total >= 1).tolist():
            yield int(passages[i]), s * half, min(len(c), (s + k) * half)


def leaks_in(
    words: list[bytes], space: LatentSpace, columns: WordColumns, how: DecontaminationParameters
) -> dict[int | None, float]:
    """Items found in a text, with the best share of their words or of a passage's."""
    if not words:
        return {}
    found: dict[int | None, float] = {}
    for i, lo, hi in candidates(columns.of(words), space, how):
        item, text = space.items[i]
        if found.get(item, 0.0) == 1.0:
            continue
        share = _settled(space.passages[i], words, lo, hi, how)
        n = len(text)
        if n > how.window:  # the whole item may recur where this passage does not
            share = max(share, _settled(text, words, max(0, lo - n), min(len(words), hi + n), how))
        if share:
            found[item] = max(found.get(item, 0.0), share)
    return found


def _keep(space: LatentSpace, uri: str) -> None:
    store, path = open_store(uri)
    with store.open_output_stream(path) as out:
        out.write(pickle.dumps((space.column, space.reach, space.halves, space.passages, space.items), protocol=5))


class SpaceReader:
    """Latent spaces by their files; of those read, ``most`` bytes are remembered."""

    def __init__(self, most: int = 64 << 20):
        self.most, self.known = most, {}

    def __call__(self, uri: str) -> LatentSpace:
        if uri in self.known:
            return self.known[uri]
        store, path = open_store(uri)
        with store.open_input_file(path) as file:
            space = LatentSpace(*pickle.loads(file.read()))
        if sum(s.reach.nbytes for s in self.known.values()) + space.reach.nbytes <= self.most:
            self.known[uri] = space
        return space


def latent_spaces(
    docs: DataFrame, benchmark: DataFrame, how: DecontaminationParameters = DecontaminationParameters()
) -> list[str]:
    """Files in the shared folder, one per block of items, with its latent space.  No items give none.

    The driver holds one block at a time.
    """
    passages = written(benchmark_passages(benchmark, how), "passages")
    total = passages.count()
    if not total:
        return []
    blocks = -(-total // how.block)
    number = F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)).cast("int")
    # In the order of the blocks, so that a block opens its own part of the table.
    spread = written(
        passages.withColumn("block", number).repartitionByRange("block").sortWithinPartitions("block"), "blocks"
    )
    idf = inverse_frequencies(docs, how)
    files = []
    for b in sorted(r["block"] for r in spread.select("block").distinct().collect()):
        files.append(new_table_path(docs.sparkSession, "latent-space"))
        _keep(latent_space(spread.where(F.col("block") == b), idf, how), files[-1])
    return files


def _leaks_of_batch(
    batch: pa.RecordBatch, spaces: list[str], read: SpaceReader, how: DecontaminationParameters, first: bool
) -> list[dict[int | None, float]]:
    """Items found in each text, block after block; with ``first`` a text is left at its first item."""
    columns = WordColumns(how.dims)
    found: list[dict[int | None, float]] = [{} for _ in range(batch.num_rows)]
    for uri in spaces:
        space = read(uri)
        for known, raw in zip(found, text_bytes(batch.column("text"))):
            if first and known:
                continue
            for item, share in leaks_in(plain_words(raw), space, columns, how).items():
                known[item] = max(known.get(item, 0.0), share)
    return found


def benchmark_leaks(
    docs: DataFrame, spaces: list[str], how: DecontaminationParameters = DecontaminationParameters()
) -> DataFrame:
    """doc_id, contaminated, item_ids (sorted), share (of the best item's or passage's words) of every document.

    One pass over all documents: a task takes a slice of texts past the blocks of items,
    which it reads from the shared folder one at a time.  NULL and empty texts hold no
    item; an item without an id is reported as -1.
    """
    read = SpaceReader()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = _leaks_of_batch(batch, spaces, read, how, first=False)
        ids = [sorted({-1 if k is None else k for k in f}) for f in found]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([bool(f) for f in found], pa.bool_()),
                pa.array(ids, pa.list_(pa.int64())),
                pa.array([max(f.values(), default=0.0) for f in found], pa.float64()),
            ],
            names=["doc_id", "contaminated", "item_ids", "share"],
        )

    schema = "doc_id bigint, contaminated boolean, item_ids array<bigint>, share double"
    return arrow_pass(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), work, schema)


def without_leaks(
    docs: DataFrame, spaces: list[str], how: DecontaminationParameters = DecontaminationParameters()
) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    read = SpaceReader()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = _leaks_of_batch(batch, spaces, read, how, first=True)
        return batch.filter(pa.array([not f for f in found], pa.bool_()))

    return arrow_pass(docs, work, docs.schema)
