"""Language-model scoring by online logistic context mixing.

A text is its lower-case words and an end mark; a word is its bytes and a space, the
end mark a lone space.  Each byte is eight binary decisions.  For every decision
several predictors look up counts under a hash of their context: the last one to
four bytes, or the whole word so far.  Their log-odds are mixed with weights chosen
by a gate (the bit, and how much the longest contexts have seen), learned online; an
adaptive probability map refines the result.  The word's share of the training words
is mixed in.  The word before is a context too: what followed it in training takes a
share gated by how often it was seen.  Inside a document an adaptive share of the
probability goes to the words already seen there.  The sum of the logarithms is the
score.

The bit predictors' contexts end at the start of a word, so a distinct word is worked
out once; the word before comes in by counted pairs of words.  The counts behind
predictors, pairs and base score cover all training texts, and so do the lessons that
weights, map and shares are learned from.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import LOWER, UPPER, fold, release_memory, sigmoid, text_bytes
from tidegauge.llm.common import mix as spread_bits
from tidegauge.session import written

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
BITS = (16, 18, 19, 19, 21)  # log2 of the slots of each predictor
OFFSETS = np.concatenate([[0], np.cumsum([1 << b for b in BITS])])
N_INPUTS = len(BITS) + 1
CLASSES = 4
SETS = 8 * CLASSES * CLASSES
BUCKETS = 24


@dataclass(frozen=True)
class MixingParameters:
    """``frequent`` words travel with the scoring tasks, the rest are joined.

    A task remembers up to about ``remembered`` words; the spelling of a word that is not
    frequent is worked out once for all tasks.
    The mixer learns online from all training words: a learner takes about ``lessons``
    distinct ones in at most ``updates`` updates of ``lesson_batch`` words or more, and
    what the learners have learned is averaged.  ``cache`` is the number of words after
    which a document's own words count half as much as they could.  Of the pairs of
    frequent words, the ``pairs`` most frequent at most travel with the tasks: all
    from the least count on that keeps to it.  Pairs are counted in buckets of about
    ``bucket`` training words.
    """

    frequent: int = 100_000
    longest_frequent: int = 64
    remembered: int = 300_000
    lessons: int = 60_000
    lesson_batch: int = 100
    updates: int = 200
    rate: float = 0.1
    cache: float = 50.0
    pairs: int = 1 << 20
    bucket: int = 500_000


def lower_words(raw: bytes) -> list[bytes]:
    return raw.translate(_LOWER).split()


# --- contexts ------------------------------------------------------------------


@dataclass
class Contexts:
    """Bytes of a list of words, with the hash of each predictor's context."""

    byte: np.ndarray
    place: np.ndarray
    start: np.ndarray
    hashes: list[np.ndarray]


def contexts_of(words: list[bytes]) -> Contexts:
    """A space follows each word; contexts see nothing before the word."""
    byte = np.frombuffer(b" ".join([*words, b""]), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    place = np.arange(len(byte)) - np.repeat(start, size)
    previous = []
    for k in range(1, 5):
        shifted = np.zeros(len(byte), np.uint32)
        shifted[k:] = byte[:-k]
        shifted[place < k] = 0
        previous.append(shifted)
    hashes = [previous[0]]
    for k in range(1, 4):
        hashes.append(hashes[-1] * np.uint32(0x2F0B4C47) + previous[k] + np.uint32(1))
    whole = np.zeros(len(byte), np.uint32)
    # One step a place: the words that are long enough move on together.
    active = start[size > 1]
    left = size[size > 1]
    h = np.full(len(active), 0x9E3779B9, np.uint32)
    step = 0
    whole[start] = 0x9E3779B9
    while len(active):
        h = (h ^ byte[active + step]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        step += 1
        whole[active + step] = h
        more = left > step + 1
        active, left, h = active[more], left[more], h[more]
    hashes.append(whole)
    return Contexts(byte, place, start, hashes)


def shared_bytes(c: Contexts) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending words, where each byte with all before it in its word comes first, and which of these each byte is."""
    size = np.diff(np.append(c.start, len(c.byte)))
    before = np.concatenate([[0], size[:-1]])
    other = np.arange(len(c.byte)) - np.repeat(before, size)  # the same place of the word before
    same = (c.place < np.repeat(before, size)) & (c.byte == c.byte[other])
    differs = np.minimum.reduceat(np.where(same, len(c.byte), c.place), c.start)
    new = c.place >= np.repeat(differs, size)
    # Bytes at one place lie side by side, in the order of the words.
    order = np.argsort(c.place, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new[order]) - 1
    return order[new[order]], number


def slots(c: Contexts, bit: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The node of each byte's tree at ``bit``, and its slot for each predictor."""
    node = (np.uint32(1 << bit) | (c.byte >> np.uint8(8 - bit)).astype(np.uint32)) if bit else np.ones(
        len(c.byte), np.uint32
    )
    return node, slots_at(c.hashes, node)


def slots_at(hashes: list[np.ndarray], node: np.ndarray) -> list[np.ndarray]:
    """The slot of each node for each predictor; ``node`` may have a row for each bit."""
    out = [hashes[0] * np.uint32(256) + node]
    spread = node * np.uint32(0x9E3779B1)
    for k, bits in enumerate(BITS[1:], start=1):
        slot = hashes[k] ^ spread
        slot *= np.uint32(0x85EBCA6B)
        slot >>= np.uint32(32 - bits)
        out.append(slot)
    return out


def evidence(n: np.ndarray) -> np.ndarray:
    """Class of a slot by its count: unseen, few, some, many."""
    return ((n > 0.5).astype(np.uint8) + (n > 3.5) + (n > 40.5)).astype(np.uint8)


def gate(bit: int, long: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Weight set: the bit, and the evidence behind the four-byte and the whole-word context."""
    return (bit * CLASSES + long.astype(np.int64)) * CLASSES + whole


def bit_values(c: Contexts, bit: int) -> np.ndarray:
    return (c.byte >> np.uint8(7 - bit)) & np.uint8(1)


def log_odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + 0.1) / (n0 + 0.1)).astype(np.float32)


# --- the model -----------------------------------------------------------------


@dataclass
class Mixer:
    """Log-odds and evidence of the predictors' slots, gated weights, and the probability map.

    All arrays are of single precision; probabilities are kept off 0 and 1.
    """

    tables: list[np.ndarray]
    seen_long: np.ndarray
    seen_whole: np.ndarray
    weights: np.ndarray
    refine: np.ndarray

    def probabilities(self, c: Contexts, bit: int) -> np.ndarray:
        """Probability that ``bit`` of each byte is 1."""
        node, at = slots(c, bit)
        chosen = gate(bit, self.seen_long[at[3]], self.seen_whole[at[4]])
        w = self.weights.take(chosen, axis=0)
        z = w[:, -1].copy()
        for k, slot in enumerate(at):
            z += w[:, k] * self.tables[k][slot]
        return self.refined(z, node)

    def refined(self, z: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Mean of the mixed probability and the map's, between two of its buckets."""
        np.clip(z, -11.9, 11.9, out=z)
        x = (z + np.float32(12)) * np.float32((BUCKETS - 1) / 24)
        low = x.astype(np.int32)
        x -= low
        low += node.astype(np.int32) * BUCKETS
        below, above = self.refine[low], self.refine[low + 1]
        p = below + x * (above - below)
        p += 1 / (1 + np.exp(-z))
        p *= np.float32(0.5)
        return np.clip(p, 1e-5, 1 - 1e-5)

    def word_logs(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word with its space."""
        out = np.zeros(len(words))
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        for i in range(0, len(words), 20_000):
            own = order[i : i + 20_000]
            c = contexts_of([words[k] for k in own.tolist()])
            first, number = shared_bytes(c)
            c = replace(c, byte=c.byte[first], hashes=[h[first] for h in c.hashes])
            p = np.ones(len(first))
            for bit in range(8):
                one = self.probabilities(c, bit)
                p *= np.where(bit_values(c, bit), one, 1 - one)
            out[own] = np.add.reduceat(np.log10(p)[number], c.start)
        return out


@dataclass
class Taught:
    """What a stream of lessons has taught, and how many bits are behind each part of it.

    ``met`` has the log10 probability of each lesson when it was met.
    """

    weights: np.ndarray
    refine: np.ndarray
    set_bits: np.ndarray
    refine_bits: np.ndarray
    met: np.ndarray


def both_counts(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """How often each slot saw a 0 and a 1, side by side as one complex number."""
    counts = np.empty(len(n0), np.complex64)
    counts.real, counts.imag = n0, n1
    return counts


def learn(counts: np.ndarray, lessons: list[bytes], times: np.ndarray, how: MixingParameters) -> Taught:
    """Learn weights and map online from a stream of training words, each worth ``times`` occurrences.

    The counts hold every lesson already, so one occurrence is taken out of them
    before its bit is predicted.  What the words of an update have in common, all
    bytes up to one, is worked out once.
    """
    met = np.zeros(len(lessons))
    weights = np.zeros((N_INPUTS, SETS), np.float32)
    weights[: len(BITS)] = 0.3
    refine = np.tile(sigmoid(np.linspace(-12, 12, BUCKETS)), 256).astype(np.float32)
    set_bits, refine_bits = np.zeros(SETS), np.zeros(len(refine))
    own_count = np.array([1, 1j], np.complex64)
    level = np.arange(8, dtype=np.uint32)[:, None]
    width = max(how.lesson_batch, -(-len(lessons) // how.updates))
    for turn, i in enumerate(range(0, len(lessons), width)):
        order = np.array(sorted(range(i, min(i + width, len(lessons))), key=lessons.__getitem__), np.int64)
        c = contexts_of([lessons[k] for k in order.tolist()])
        first, number = shared_bytes(c)
        weight = np.bincount(number, np.repeat(times[order], np.diff(np.append(c.start, len(c.byte)))))
        rate = max(how.rate, 0.5 / (1 + turn))
        logs = np.empty(len(first))
        # The bits of a byte have sets and rows of their own, so they learn side by side.
        for j in range(0, len(first), 1 << 15):
            part = first[j : j + (1 << 15)]
            byte = c.byte[part].astype(np.uint32)
            one = (byte >> (7 - level)) & np.uint32(1)
            y = one.astype(np.float32)
            node = (np.uint32(1) << level) | (byte >> (8 - level))
            each = np.broadcast_to(weight[j : j + (1 << 15)], one.shape).ravel()
            own = own_count.take(one)
            x, seen = [], []
            for k, slot in enumerate(slots_at([h[part] for h in c.hashes], node)):
                n = counts.take(slot.astype(np.int64) + OFFSETS[k])
                n -= own
                n = n.view(np.float32).reshape(*one.shape, 2)
                np.maximum(n, 0, out=n)
                if k >= 3:
                    seen.append(evidence(n[..., 0] + n[..., 1]))
                x.append(log_odds(n[..., 0], n[..., 1]))
            g = gate(level.astype(np.int64), *seen)
            z = weights[-1].take(g)
            for k in range(len(BITS)):
                z += weights[k].take(g) * x[k]
            np.clip(z, -60, 60, out=z)
            g = g.ravel()
            error = (y - 1 / (1 + np.exp(-z))) * each.reshape(one.shape)
            bits = np.bincount(g, each, SETS)
            scale = rate / np.maximum(bits, 1)
            for k in range(len(BITS)):
                weights[k] += scale * np.bincount(g, (error * x[k]).ravel(), SETS)
            weights[-1] += scale * np.bincount(g, error.ravel(), SETS)
            set_bits += bits
            np.clip(z, -11.9, 11.9, out=z)
            row = node.astype(np.int64) * BUCKETS + np.rint((z + 12) * np.float32((BUCKETS - 1) / 24)).astype(np.int64)
            p = np.clip((1 / (1 + np.exp(-z)) + refine.take(row)) * np.float32(0.5), 1e-5, 1 - 1e-5)
            logs[j : j + (1 << 15)] = np.log(np.where(one, p, 1 - p)).sum(0, dtype=float) / np.log(10)
            row = row.ravel()
            total = np.bincount(row, each, len(refine))
            share = np.bincount(row, each * y.ravel(), len(refine)) / np.maximum(total, 1)
            refine += total / (total + 200.0) * (share - refine)
            refine_bits += total
        met[order] = np.add.reduceat(logs[number], c.start)
    return Taught(weights.T, refine, set_bits, refine_bits, met)


def mixer_of(n0: np.ndarray, n1: np.ndarray, weights: np.ndarray, refine: np.ndarray) -> Mixer:
    pieces = [slice(OFFSETS[k], OFFSETS[k + 1]) for k in range(len(BITS))]
    tables = [log_odds(n0[s], n1[s]) for s in pieces]
    seen = [evidence(n0[s] + n1[s]) for s in pieces[3:]]
    return Mixer(tables, *seen, np.ascontiguousarray(weights, np.float32), refine.astype(np.float32))


def teach(n0: np.ndarray, n1: np.ndarray, lessons: list[bytes], how: MixingParameters) -> tuple[Mixer, np.ndarray]:
    """The mixer that one stream of words makes, and the log10 probabilities they had when they were met."""
    taught = learn(both_counts(n0, n1), lessons, np.ones(len(lessons)), how)
    return mixer_of(n0, n1, taught.weights, taught.refine), taught.met


# --- Spark ---------------------------------------------------------------------


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts, counted where ``held_out`` is false; the end mark is the empty word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[bytes] = Counter()
            for held, raw in zip(batch.column("held_out").to_pylist(), text_bytes(batch.column("text"))):
                words = lower_words(raw)
                if held:
                    for w in words:
                        seen.setdefault(w, 0)
                else:
                    seen.update(words)
                seen[b""] += not held
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"]
            )
            del seen
            release_memory()

    picked = docs.select("held_out", "text")
    return picked.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def spelled_words(vocab: DataFrame, mixer: Mixer, frequent: dict[bytes, int]) -> DataFrame:
    """(word, n, log): the words that are not frequent, with the mixer's log10 probability."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            batch = batch.filter(pa.array([w not in frequent for w in words], pa.bool_()))
            logs = mixer.word_logs(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs)], names=["word", "n", "log"])

    return vocab.mapInArrow(run, "word binary, n bigint, log double")


def slot_counts(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each slot saw a 0 and a 1, over all words as often as they occur.

    Each task sends one row per slot in use; the slots are a fixed number.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Both counts of a slot lie side by side.
        n = [np.zeros(2 << bits, np.int64) for bits in BITS]
        for batch in batches:
            for i in range(0, batch.num_rows, 50_000):
                part = pa.Table.from_batches([batch.slice(i, 50_000)]).sort_by("word")
                c = contexts_of(part.column("word").to_pylist())
                times = np.repeat(part.column("n").to_numpy(), np.diff(np.append(c.start, len(c.byte))))
                first, number = shared_bytes(c)
                each = np.zeros(len(first), np.int64)
                np.add.at(each, number, times)
                c = replace(c, byte=c.byte[first], hashes=[h[first] for h in c.hashes])
                for bit in range(8):
                    y = bit_values(c, bit).astype(np.uint32)
                    for k, slot in enumerate(slots(c, bit)[1]):
                        np.add.at(n[k], slot * np.uint32(2) + y, each)
        n = np.concatenate(n).reshape(-1, 2).T
        used = np.nonzero(n.any(0))[0]
        for i in range(0, len(used), 1 << 17):
            u = used[i : i + (1 << 17)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(u.astype(np.int32)), pa.array(n[0, u]), pa.array(n[1, u])], names=["slot", "n0", "n1"]
            )
        del n, used
        release_memory()

    summed = (
        words.mapInArrow(run, "slot int, n0 bigint, n1 bigint")
        .groupBy("slot")
        .agg(F.sum("n0").cast("float").alias("n0"), F.sum("n1").cast("float").alias("n1"))
    )
    table = summed.toArrow()
    out = np.zeros((2, int(OFFSETS[-1])), np.float32)
    at = table.column("slot").to_numpy()
    out[0, at], out[1, at] = table.column("n0").to_numpy(), table.column("n1").to_numpy()
    return out[0], out[1]


@dataclass
class Scorer:
    """The mixer, the frequent words with their counts, and the sizes of the training text."""

    mixer: Mixer
    mixed: float
    frequent: dict[bytes, int]
    frequent_logs: np.ndarray
    tokens: int
    distinct: int
    how: MixingParameters

    def listed(self) -> list[bytes]:
        """The frequent words in the order of their numbers; the end mark is the first."""
        return [b"", *(w for w in self.frequent if w)]


def least_frequent(vocab: DataFrame, how: MixingParameters) -> int:
    """A power of two that at least ``how.frequent`` words reach, or 0.

    Words below it are left out before the frequent ones are sorted, so that what
    every task sends to be merged stays small.
    """
    listed = vocab.where(F.octet_length("word") <= how.longest_frequent)
    levels = listed.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.count("*").alias("words"))
    reached = 0
    for row in levels.orderBy(F.desc("level")).collect():
        reached += row["words"]
        if reached >= how.frequent:
            return 1 << row["level"]
    return 0


WEIGHT, REFINE, RATIO = range(3)  # what a learner hands on
RATIO_STEP = 64  # buckets of the ratio for each power of ten


def learned(words: DataFrame, counts: np.ndarray, tokens: int, distinct: int, how: MixingParameters) -> DataFrame:
    """(kind, at, bits, total): what all learners have learned from all training words.

    Every word goes to learners as often as it occurs: a rare one to one of them, a
    frequent one in parts to several, and inside a learner in parts to several updates.
    Weights and map are summed with the bits behind them.  The last kind has the
    occurrences by the ratio of a word's share of the other training words to its
    probability when it was met.
    """
    learners = max(1, -(-distinct // how.lessons))
    heaviest = max(1, tokens // (learners * max(1, how.lessons // 4)))
    copies = F.least(F.lit(learners), F.ceil(F.col("n") / heaviest)).cast("bigint")
    dealt = (
        words.withColumn("copies", copies)
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .select(
            F.pmod(F.xxhash64("word") + F.col("copy"), F.lit(learners)).alias("learner"),
            "word",
            "n",
            (F.floor(F.col("n") / F.col("copies")) + (F.col("copy") < F.col("n") % F.col("copies")).cast("bigint")).alias("times"),
        )
    )

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("word")
        times = rows.column("times").to_numpy()
        parts = -(-times // heaviest)
        place = np.repeat(np.arange(len(times)), parts)
        place = place[np.random.default_rng(3).permutation(len(place))]
        word = rows.column("word").to_pylist()
        n, times = rows.column("n").to_numpy()[place], (times / parts)[place]
        taught = learn(counts, [word[i] for i in place.tolist()], times, how)
        with np.errstate(divide="ignore"):
            ratio = np.log10((n - 1) / max(1, tokens - 1)) - taught.met
        # A word that occurs once has no share among the others.
        bucket = np.rint(np.clip(ratio, -20, 300) * RATIO_STEP).astype(np.int64)
        bucket, at = np.unique(bucket, return_inverse=True)
        bits = np.repeat(taught.set_bits, N_INPUTS), taught.refine_bits, np.bincount(at, times)
        total = bits[0] * taught.weights.ravel(), bits[1] * taught.refine, np.zeros(len(bucket))
        at = np.arange(SETS * N_INPUTS), np.arange(len(taught.refine)), bucket
        kind = np.repeat([WEIGHT, REFINE, RATIO], [len(x) for x in at])
        columns = {"kind": kind.astype(np.int32), "at": np.concatenate(at).astype(np.int32)}
        columns |= {"bits": np.concatenate(bits), "total": np.concatenate(total)}
        table = pa.table(columns)
        del rows, word, taught
        release_memory()
        return table

    each = dealt.groupBy("learner").applyInArrow(run, "kind int, at int, bits double, total double")
    return each.groupBy("kind", "at").agg(F.sum("bits").alias("bits"), F.sum("total").alias("total"))


def fit_scorer(vocab: DataFrame, how: MixingParameters = MixingParameters()) -> Scorer:
    """Learn from the (word, n) table of the training texts; an empty one is allowed.

    All words teach the mixer, as often as they occur.
    """
    totals = vocab.agg(F.sum("n"), F.count("*")).first()
    tokens, distinct = totals[0] or 0, totals[1] or 0
    top = (
        vocab.where((F.octet_length("word") <= how.longest_frequent) & (F.col("n") >= least_frequent(vocab, how)))
        .orderBy(F.desc("n"), "word")
        .limit(how.frequent)
        .toArrow()
    )
    frequent = dict(zip(top.column("word").to_pylist(), top.column("n").to_pylist()))
    n0, n1 = slot_counts(vocab)
    counts = both_counts(n0, n1)
    found = learned(vocab, counts, tokens, distinct, how).orderBy("kind", "at").toArrow()
    kind, at, bits, total = (found.column(c).to_numpy() for c in ("kind", "at", "bits", "total"))
    untaught = learn(counts, [], np.zeros(0), how)
    weights, refine = untaught.weights.ravel().copy(), untaught.refine
    for part, values in ((WEIGHT, weights), (REFINE, refine)):
        known = (kind == part) & (bits > 0)
        values[at[known]] = total[known] / bits[known]
    mixer = mixer_of(n0, n1, weights.reshape(SETS, N_INPUTS), refine)
    ratios = kind == RATIO
    return Scorer(
        mixer,
        share_of_mixer(10.0 ** (at[ratios] / RATIO_STEP), bits[ratios]),
        frequent,
        mixer.word_logs(list(frequent)),
        tokens,
        distinct,
        how,
    )


@dataclass
class Followers:
    """What the word before adds: all arrays are numbered like the frequent words.

    A word w after u has ``keep[u]`` times its own probability, plus ``extra`` of the
    pair if ``u * words + w`` is in the sorted ``keys``.  Over all w this sums to 1.
    """

    words: int
    keys: np.ndarray
    extra: np.ndarray
    keep: np.ndarray

    def of(self, before: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keep, extra) of each word; numbers from ``words`` on are no frequent words."""
        keep, extra = np.ones(len(ids)), np.zeros(len(ids))
        told = before < self.words
        keep[told] = self.keep[before[told]]
        if len(self.keys):
            both = np.nonzero(told & (ids < self.words))[0]
            key = before[both] * self.words + ids[both]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            extra[both[hit]] = self.extra[at[hit]]
        return keep, extra


def words_before(ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The word before each word of some texts end to end; the end mark before the first."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[start] = 0
    return before


def pair_counts(docs: DataFrame, listed: list[bytes], buckets: int) -> DataFrame:
    """(pairs, counts): how often a frequent word follows a frequent word, over all texts.

    A row has the distinct pairs of one of ``buckets`` buckets, as packed numbers.
    """
    words = len(listed)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: k for k, w in enumerate(listed)}
        for batch in batches:
            found = []
            for raw in text_bytes(batch.column("text")):
                own = lower_words(raw)
                ids = np.zeros(len(own) + 2, np.int64)  # an end mark on both sides
                ids[1:-1] = np.fromiter(map(number.get, own, repeat(words)), np.int64, len(own))
                both = (ids[:-1] < words) & (ids[1:] < words)
                found.append((ids[:-1] * words + ids[1:])[both])
            if not found:
                continue
            pair, n = np.unique(np.concatenate(found), return_counts=True)
            del found
            bucket = (spread_bits(pair.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, pair, n = bucket[order], pair[order], n[order].astype(np.int64)
            first = np.nonzero(np.diff(bucket, prepend=-1))[0]
            ends = np.append(first[1:], len(bucket))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[first]),
                    pa.array([pair[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
                    pa.array([n[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
                ],
                names=["bucket", "pairs", "counts"],
            )
            del pair, n, bucket, order, first, ends
            release_memory()

    def merge(rows: pa.Table) -> pa.Table:
        pair, n = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.int64) for c in ("pairs", "counts"))
        pair, place = np.unique(pair, return_inverse=True)
        n = np.bincount(place, n, minlength=len(pair)).astype(np.int64)
        del place
        release_memory()
        return pa.table({"pairs": pa.array([pair.tobytes()], pa.binary()), "counts": pa.array([n.tobytes()], pa.binary())})

    cut = docs.select("text").mapInArrow(run, "bucket int, pairs binary, counts binary")
    return cut.groupBy("bucket").applyInArrow(merge, "pairs binary, counts binary")


def least_pair_count(counted: DataFrame, most: int) -> int:
    """The least count that at most ``most`` pairs reach; from 64 on a power of two."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts in batch.column("counts").to_pylist():
                n = np.frombuffer(counts, np.int64)
                level = np.where(n < 64, n, 1 << np.log2(n).astype(np.int64))
                levels, pairs = np.unique(level, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(levels), pa.array(pairs.astype(np.int64))], names=["level", "pairs"]
                )

    least, reached = 1 << 62, 0
    sizes = counted.mapInArrow(run, "level bigint, pairs bigint").groupBy("level").agg(F.sum("pairs").alias("pairs"))
    for row in sizes.orderBy(F.desc("level")).collect():
        reached += row["pairs"]
        if reached > most:
            break
        least = row["level"]
    return least


def frequent_pairs(counted: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with at least ``least`` occurrences in ascending order, and their counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, counts in zip(batch.column("pairs").to_pylist(), batch.column("counts").to_pylist()):
                pair, n = np.frombuffer(pairs, np.int64), np.frombuffer(counts, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair[n >= least]), pa.array(n[n >= least])], names=["pair", "n"])

    table = counted.mapInArrow(run, "pair bigint, n bigint").toArrow()
    keys, n = table.column("pair").to_numpy(), table.column("n").to_numpy().astype(float)
    order = np.argsort(keys)
    return keys[order], n[order]


def learn_followers(docs: DataFrame, scorer: Scorer) -> Followers:
    """Count pairs over the training texts and fit the share of what follows a word.

    The shares are fitted by expectation steps, one for each power of two of the
    count of the word before, over every training word that follows a frequent one;
    an occurrence is taken out of its own counts.  What follows a word in pairs
    that do not travel has the word's own probability.
    """
    listed = scorer.listed()
    words = len(listed)
    count = np.array([scorer.frequent.get(w, 0) for w in listed], float)
    buckets = max(16, scorer.tokens // scorer.how.bucket)
    counted = written(pair_counts(docs, listed, buckets), "pair-counts")
    least = least_pair_count(counted, scorer.how.pairs)
    keys, n = frequent_pairs(counted, least)
    u, w = np.divmod(keys, words)
    rest = np.maximum(count - np.bincount(u, n, minlength=words), 0) / np.maximum(count, 1)
    level = np.log2(np.maximum(count, 1)).astype(np.int64)
    logs_of = dict(zip(scorer.frequent, scorer.frequent_logs.tolist()))
    own = scorer.mixed * 10.0 ** np.array([logs_of.get(x, -300.0) for x in listed])
    own += (1 - scorer.mixed) * count / max(1, scorer.tokens)
    left = np.where(n - 1 >= least, n - 1, 0) / np.maximum(count[u] - 1, 1)
    told = rest[u] * own[w] + left
    total = np.maximum(np.bincount(level, count), 1e-9)
    share = np.full(len(total), 0.5)
    for _ in range(30):
        s = share[level]
        ours = s[u] * told
        each = n * ours / np.maximum(ours + (1 - s[u]) * own[w], 1e-290)
        other = count * rest * s * rest / np.maximum(s * rest + 1 - s, 1e-9)
        share = (np.bincount(level[u], each, minlength=len(total)) + np.bincount(level, other)) / total
        share = np.clip(share, 0.0, 0.98)
    s = np.where(count > 0, share[level], 0.0)
    extra = (s[u] * n / np.maximum(count[u], 1)).astype(np.float32)
    return Followers(words, keys, extra, 1 - s * (1 - rest))


class Numbers(dict):
    """Numbers of words in the order in which they are first met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        return k


def seen_before(ids: np.ndarray) -> np.ndarray:
    """How often each word of a text occurred in it before."""
    order = np.argsort(ids, kind="stable")
    ranked = ids[order]
    first = np.empty(len(ids), bool)
    first[0] = True
    np.not_equal(ranked[1:], ranked[:-1], out=first[1:])
    place = np.arange(len(ids))
    before = np.empty(len(ids), np.int64)
    before[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    return before


def occurrence_terms(
    before: np.ndarray, start: np.ndarray, keep: np.ndarray, extra: np.ndarray, cache: float
) -> tuple[np.ndarray, np.ndarray]:
    """(a, d) of each word of some texts: its probability is a times the word's own plus d.

    The texts lie end to end; ``start`` has where each begins.  ``before`` has the
    earlier occurrences in the text.  Of the word's own probability, the word before
    leaves ``keep`` and adds ``extra``.  Before each word, the share
    ``repeats so far / (words so far + cache)`` goes to the words already seen in
    the text, by how often.
    """
    n = len(before)
    size = np.diff(np.append(start, n))
    place = np.arange(n) - np.repeat(start, size)
    repeats = np.concatenate([[0], np.cumsum(before > 0)])
    repeats = repeats[:-1] - np.repeat(repeats[start], size)
    share = repeats / (place + cache)
    return (1 - share) * keep, (1 - share) * extra + share * before / np.maximum(place, 1)


def share_of_mixer(ratio: np.ndarray, times: np.ndarray) -> float:
    """The mixer's weight against the training share, by expectation steps over all training words.

    ``ratio`` is a word's share over the mixer's probability.  A word's own occurrence
    is taken out of its count.
    """
    mixed = 0.5
    for _ in range(30 * bool(len(times))):
        mixed = float(np.average(mixed / (mixed + (1 - mixed) * ratio), weights=times))
    return min(max(mixed, 0.02), 0.98)


DOCUMENTS = (
    "row binary, doc_id bigint, held_out boolean, n_tokens bigint, n_bytes bigint, known bigint, logs double, "
    "rare array<binary>, factors array<float>, terms array<float>, score double"
)


def _scored(docs: DataFrame, scorer: Scorer, followers: Followers) -> DataFrame:
    """One row per document: sums over frequent words, and the rare words with their terms."""
    cache, remembered = scorer.how.cache, scorer.how.remembered
    listed = scorer.listed()
    count_0 = np.array([scorer.frequent.get(w, -1) for w in listed], np.int64)
    logs_of = dict(zip(scorer.frequent, scorer.frequent_logs.tolist()))
    own = scorer.mixed * 10.0 ** np.array([logs_of.get(w, -300.0) for w in listed])
    own += (1 - scorer.mixed) * np.maximum(count_0, 0) / max(1, scorer.tokens)
    del logs_of

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = os.urandom(8)
        row = 0
        numbers = Numbers()
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                if not numbers or len(numbers) > len(listed) + remembered:
                    numbers = Numbers((w, k) for k, w in enumerate(listed))
                    words = pa.array(listed, pa.binary())
                    size = np.array([len(w) + 1 for w in listed], np.int64)
                texts = []
                for raw in text_bytes(batch.column("text")):
                    own_words = lower_words(raw)
                    ids = np.zeros(len(own_words) + 1, np.int64)  # the end mark is the last
                    ids[:-1] = np.fromiter(map(numbers.__getitem__, own_words), np.int64, len(own_words))
                    texts.append(ids)
                new = list(islice(numbers, len(size), None))
                if new:
                    size = np.concatenate([size, np.array([len(w) + 1 for w in new], np.int64)])
                    words = pa.concat_arrays([words, pa.array(new, pa.binary())])
                before = np.concatenate([seen_before(ids) for ids in texts])
                n = np.array([len(ids) for ids in texts], np.int64)
                start = np.concatenate([[0], np.cumsum(n)[:-1]])
                ids = np.concatenate(texts)
                place = np.minimum(ids, len(listed) - 1)
                common = np.where(ids < len(listed), count_0[place], -1)
                rare = common < 0
                factor, term = occurrence_terms(before, start, *followers.of(words_before(ids, start), ids), cache)
                each = np.log10(np.where(rare, 1.0, np.maximum(factor * own[place] + term, 1e-290)))
                n_rare = np.add.reduceat(rare.astype(np.int64), start)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n_rare)]), pa.int32())
                keys = [task + k.to_bytes(4, "big") for k in range(row, row + len(texts))]
                row += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.binary()), batch.column("doc_id"), batch.column("held_out"),
                        pa.array(n), pa.array(np.add.reduceat(size[ids], start)), pa.array(n - n_rare),
                        pa.array(np.add.reduceat(np.log10(np.maximum(common, 0) + 1), start)),
                        pa.ListArray.from_arrays(offsets, words.take(pa.array(ids[rare]))),
                        pa.ListArray.from_arrays(offsets, pa.array(factor[rare].astype(np.float32))),
                        pa.ListArray.from_arrays(offsets, pa.array(term[rare].astype(np.float32))),
                        pa.array(np.add.reduceat(each, start)),
                    ],
                    names=[f.split()[0] for f in DOCUMENTS.split(", ")],
                )
                if i % 2000 == 1500:
                    release_memory()
            release_memory()

    return docs.mapInArrow(run, DOCUMENTS)


def rare_log(mixed: float, tokens: int) -> Column:
    """log10 probability of an occurrence (factor, term) of a word with (n, log)."""
    factor, log = F.col("factor").cast("double"), F.col("log")
    own = F.lit(mixed) * F.pow(F.lit(10.0), log) + F.lit((1 - mixed) / max(1, tokens)) * F.col("n")
    p = factor * own + F.col("term")
    # Very long words underflow; only the mixer has a say there.
    return F.when(p > 1e-290, F.log10(p)).otherwise(log + F.log10(factor * F.lit(mixed)))


def score_documents(docs: DataFrame, how: MixingParameters = MixingParameters()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Texts whose id's checksum leaves 2 by 7 are held out; a NULL id counts as the
    empty text.  NULL and empty texts are the end mark alone.  Repeated rows all
    teach and are scored alike; other columns are ignored.  Without any training
    text all counts are 0 and the mixer is untaught.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (fold(F.col("doc_id"), 7) == 2).alias("held_out"),
        "text",
    )
    # In order, words that begin alike lie together and are worked out together.
    vocab = written(vocabulary(rows).sortWithinPartitions("word"), "vocabulary")
    scorer = fit_scorer(vocab.where("n > 0"), how)
    spelled = spelled_words(vocab, scorer.mixer, scorer.frequent)
    followers = learn_followers(rows.where("not held_out"), scorer)
    scored = written(_scored(rows, scorer, followers), "scored-documents")
    # Words outside the frequent ones: counts and spelling come by a join.  A frequent
    # word is never among them, so no key is hot.
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "factors", "terms")).alias("w")).select(
        "row", F.col("w.rare").alias("word"), F.col("w.factors").alias("factor"), F.col("w.terms").alias("term")
    )
    found = (
        rare.join(spelled, "word")
        .groupBy("row")
        .agg(
            F.sum(F.log10(F.col("n") + 1)).alias("more_logs"),
            F.sum((F.col("n") > 0).cast("bigint")).alias("more_known"),
            F.sum(rare_log(scorer.mixed, scorer.tokens)).alias("more_score"),
        )
    )
    scored = (
        scored.drop("rare", "factors", "terms")
        .join(found, "row", "left")
        .withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    )
    spread = F.lit(float(np.log10(scorer.tokens + scorer.distinct + 1)))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(scorer.tokens).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * spread).alias("base_score"),
        "score",
        (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
