"""Toxicity: boosted trees over dense text features, with isotonic calibration.

The lexicon is mined from labelled texts: words far more frequent in toxic ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.boosting import BoostedTrees, Isotonic
from tidegauge.llm.common import LOWER, UPPER, arrow_pass, fold, hashed_sample, text_bytes
from tidegauge.session import written

# Second-person words of the four languages.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre usted tú ti vosotros"

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
# Digits and signs that stand for letters.
_PLAIN = bytes.maketrans(b"013457@$!", b"oieastasi")
_EDGE = b".,;:!?\"'()[]{}<>|*#%&$-_"
_INNER = b"*._-#"
_YOU = frozenset(w.encode() for w in SECOND_PERSON.split())


@dataclass(frozen=True)
class ToxicityParameters:
    """At most ``labelled`` labelled rows are learned from; ``lexicon`` words are kept.

    ``evidence`` is the least log-likelihood ratio of a lexicon word; ``near`` the
    reach, in words, of second-person proximity.
    """

    labelled: int = 20_000
    lexicon: int = 400
    evidence: float = 24.0
    near: int = 5


def plain_words(raw: bytes) -> list[bytes]:
    """Lower-case words without punctuation at their ends."""
    return [w.strip(_EDGE) for w in raw.translate(_LOWER).split()]


def _unmasked(word: bytes) -> bytes:
    """A word with signs for letters put back and signs between letters taken out."""
    return word.translate(_PLAIN).translate(None, _INNER)


def _masked(word: bytes) -> bool:
    """Letters mixed with digits or signs."""
    return len(word) > 2 and not word.isalpha() and word.isascii() and word[:1].isalpha() and any(
        c in b"013457@$!*._-#" for c in word
    )


N_FEATURES = 12


def text_features(raw: bytes, lexicon: dict[bytes, float], near: int) -> list[float]:
    """Dense features of one text; zeros for one without words."""
    words = plain_words(raw)
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    hits = [i for i, w in enumerate(words) if w in lexicon]
    weight = sum(lexicon[words[i]] for i in hits)
    masked = [i for i, w in enumerate(words) if _masked(w)] if not raw.isalpha() else []
    behind = [i for i in masked if words[i] not in lexicon and _unmasked(words[i]) in lexicon]
    weight += sum(lexicon[_unmasked(words[i])] for i in behind)
    found = sorted(hits + behind)
    you = [i for i, w in enumerate(words) if w in _YOU]
    close = 0
    if found and you:
        place = np.searchsorted(you, found)
        you_at = np.array([-(10**9), *you, 10**9])
        gap = np.minimum(found - you_at[place], you_at[place + 1] - found)
        close = int((gap <= near).sum())
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    return [
        len(found) / n,
        float(len(found)),
        float(len({words[i] for i in found})),
        weight / n,
        max((lexicon.get(words[i], 0.0) for i in found), default=0.0),
        close / n,
        len(you) / n,
        upper / max(1, upper + lower),
        float(counts[33] + counts[63]) / n,
        float(counts[44] + counts[46] + counts[58] + counts[59]) / n,
        len(masked) / n,
        float(np.log1p(n)),
    ]


def _mine(sample: DataFrame, how: ToxicityParameters) -> dict[bytes, float]:
    """Log-odds of the words with the strongest lean towards toxic texts."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, labels = [], []
        for raw, label in zip(text_bytes(batch.column("text")), batch.column("toxic").to_pylist()):
            own = {w for w in plain_words(raw) if 2 < len(w) <= 40}
            words += own
            labels += [label] * len(own)
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()), pa.array(labels, pa.int32())], names=["word", "toxic"]
        )

    n = sample.agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).first()
    bad, good = n["bad"] or 0, n["n"] - (n["bad"] or 0)
    if not bad or not good:
        return {}
    counted = (
        arrow_pass(sample.select("text", "toxic"), work, "word binary, toxic int")
        .groupBy("word")
        .agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    )
    share = bad / (bad + good)
    total = F.col("a") + F.col("b")
    ratio = 2 * (
        F.col("a") * F.log(F.col("a") / (total * share))
        + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (total * (1 - share)))).otherwise(0.0)
    )
    odds = F.log((F.col("a") + 0.5) / bad) - F.log((F.col("b") + 0.5) / good)
    top = (
        counted.where(F.col("a") > 0)
        .select("word", ratio.alias("evidence"), odds.alias("odds"))
        .where((F.col("evidence") >= how.evidence) & (F.col("odds") > 1.5))
        .orderBy(F.desc("evidence"), "word")
        .limit(how.lexicon)
    )
    return {bytes(r["word"]): float(r["odds"]) for r in top.collect()}


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[bytes, float]
    trees: BoostedTrees
    calibrate: Isotonic
    near: int

    def score(self, texts: list[bytes]) -> np.ndarray:
        x = np.array([text_features(t, self.lexicon, self.near) for t in texts]).reshape(-1, N_FEATURES)
        return self.calibrate(self.trees.margin(x))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, how: ToxicityParameters = ToxicityParameters()
) -> ToxicityModel:
    """Learn from at most ``how.labelled`` labelled rows whose id is not held out.

    ``labels`` needs doc_id and toxic (0, 1; NULL is ignored).  Three of the four
    learning folds fit lexicon and trees, the fourth fits the calibration.
    Without labels of both kinds the score is the share of label 1.
    """
    known = (
        labels.where("doc_id is not null and toxic in (0, 1)")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("part", fold(F.col("doc_id"), 5))
        .where("part != 0")
    )
    # The sample is bounded by its parameter, so it may be broadcast.
    sample = F.broadcast(hashed_sample(known, how.labelled, "doc_id"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    taught = written(texts.join(sample, "doc_id").select("doc_id", "text", "toxic", "part"), "labelled-texts")
    lexicon = _mine(taught.where("part != 4"), how)
    near = how.near

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [text_features(raw, lexicon, near) for raw in text_bytes(batch.column("text"))]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "toxic", "part")), pa.array(x, pa.list_(pa.float64()))],
            names=["doc_id", "toxic", "part", "x"],
        )

    featured = written(
        arrow_pass(taught, work, "doc_id bigint, toxic int, part bigint, x array<double>"), "toxic-features"
    )
    rows = hashed_sample(featured, how.labelled, "doc_id", "x").collect()
    x = np.array([r["x"] for r in rows]).reshape(-1, N_FEATURES)
    y = np.array([r["toxic"] for r in rows], float)
    last = np.array([r["part"] == 4 for r in rows], bool)
    trees = BoostedTrees(x[~last], y[~last])
    return ToxicityModel(lexicon, trees, Isotonic(trees.margin(x[last]), y[last]), near)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    NULL and empty texts are scored on features of 0.  Only the text enters the
    score; a NULL doc_id is held out like the empty text's checksum.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.score(list(text_bytes(batch.column("text"))))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(score)],
            names=["doc_id", "held_out", "score"],
        )

    picked = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "text",
    )
    scored = arrow_pass(picked, work, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
