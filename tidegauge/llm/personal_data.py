"""Personal data by patterns and a skip-chain conditional random field.

Patterns find four kinds of spans.  The field then labels every word that holds a
digit or an at sign, and every word inside or after a key such as ``password=``.  Words that follow each other share chain potentials; distant
words that are equal, or alike in shape and context, share skip potentials.  Loopy
message passing lets sure mentions carry over to unsure ones of the same document.
The field is fitted by pseudo-likelihood on a bounded sample of documents, with the
pattern spans and spelled-out secrets as labels.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import arrow_pass, hashed_sample, text_bytes
from tidegauge.session import written

KINDS = ["email", "ip", "card", "phone", "secret"]
LABELS = ["other", *KINDS]

_KEY_NAME = r"(?:(?<![a-z])pass(?:wd)?|password|pwd|token|secret|api[_-]?key)[\"']?"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_KEY = re.compile(_KEY_NAME + r"\s*[=:]\s*[\"']?$", re.I | re.A)
_KEY_INSIDE = re.compile(_KEY_NAME + r"[=:][\"']?", re.I | re.A)
_KEYED = _KEY_NAME + r"[ \t]*[=:][ \t]*[\"']?"
_MAYBE = re.compile(rb"[0-9@]|" + _KEYED.encode(), re.I)
# Where a word of the field is found: a digit or an at sign in it, or the value of a key.
_MARK = re.compile(r"[0-9@]|" + _KEYED + r"(?=[^\x20\x09-\x0D])", re.I | re.A)
_HEX = re.compile(r"[0-9a-fA-F]{12,}")


def _emails(text: str):
    """The run of local characters before an at sign, and the domain after it."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str):
    """Groups of four parts from the left of each chain of dotted numbers."""
    for chain in _DOTTED.finditer(text):
        parts, at = chain.group().split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; leftmost matches without overlap inside a kind."""
    found = []
    for kind, finder in enumerate((_emails, _ips, _cards, _phones)):
        found += [(kind, s, e) for s, e in finder(text)]
    return found


# --- nodes and edges of the field -------------------------------------------


@dataclass
class Graph:
    """Words of one text that may be personal data, and which of them share potentials."""

    spans: list[tuple[int, int]]
    x: np.ndarray
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def _candidates(text: str) -> list[tuple[int, int]]:
    """Words with a digit or an at sign, and words inside or after a key on the same line."""
    spans, at = [], 0
    while m := _MARK.search(text, at):
        here = m.start() if m.end() - m.start() == 1 else m.end()
        start = here
        while start > at and not _SPACE.match(text, start - 1):
            start -= 1
        space = _SPACE.search(text, here)
        end = space.start() if space else len(text)
        spans.append((start, end))
        at = end
    return spans


N_UNARY = 25
# The shortest value of a key that counts as a secret.
SECRET_CHARS = 8


def _keyed_value(word: str, before: str) -> str | None:
    """The value of a key before or inside a word, without quotes and closing marks."""
    inside = _KEY_INSIDE.search(word)
    if inside:
        word = word[inside.end() :]
    elif not _KEY.search(before):
        return None
    return word.strip("\"'.,;:!?()[]{}<>")


def _unary(word: str, before: str) -> list[float]:
    """Shape of a word and the characters before it; no check digits."""
    digits = sum(c in "0123456789" for c in word)
    letters = sum(c.isalpha() for c in word)
    core = word.strip("\"'.,;:!?()[]{}<>")
    dots = core.count(".")
    n = len(word)
    value = _keyed_value(word, before)
    return [
        1.0,
        digits / n,
        letters / n,
        float(digits == len(core)),
        float("@" in core[1:-1]),
        float("@" in core and dots > 0),
        float(dots == 3 and digits + 3 == len(core)),
        float(dots == 1 and digits + 1 == len(core)),
        float(word.startswith("+")),
        float(word.startswith("(")),
        float("-" in core),
        float(core.count("-") == 1 and digits + 1 == len(core) and digits == 7),
        float(digits < 3),
        float(digits == 3),
        float(4 <= digits <= 7),
        float(8 <= digits <= 15),
        float(16 <= digits <= 19),
        float(digits > 19),
        float(bool(_HEX.fullmatch(core)) and letters > 0),
        float(letters > 2 and digits > 2 and core.isalnum()),
        float(value is not None),
        float(bool(_HEX.search(word))),
        min(n, 64) / 16,
        float("=" in word),
        float(value is not None and len(value) >= SECRET_CHARS and any(c.isalpha() for c in value)),
    ]


def graph_of(text: str) -> Graph:
    """Nodes, chain edges between neighbours, skip edges between like words.

    A word is tied to the last equal word and to the last one of its shape and
    context, so the edges grow with the words, not with pairs of them.
    """
    spans = _candidates(text)
    rows, chain, skip = [], [], []
    last_equal: dict[str, int] = {}
    last_alike: dict[tuple, int] = {}
    for i, (s, e) in enumerate(spans):
        word, before = text[s:e], text[max(0, s - 24) : s]
        rows.append(_unary(word, before))
        if i and e > s and not text[spans[i - 1][1] : s].strip(" \t\n\v\f\r") and s - spans[i - 1][1] <= 2:
            chain.append((i - 1, i))
        core = word.strip("\"'.,;:!?()[]{}<>").lower()
        if core in last_equal:
            skip.append((last_equal[core], i))
        last_equal[core] = i
        shape = (re.sub(r"[a-z]+", "a", re.sub(r"[0-9]", "9", core))[:40], bool(_KEY.search(before)))
        if shape in last_alike and len(core) >= 6 and (last_alike[shape], i) not in skip[-1:]:
            skip.append((last_alike[shape], i))
        last_alike[shape] = i
    return Graph(spans, np.array(rows, float).reshape(-1, N_UNARY), chain, skip)


def silver_labels(text: str, graph: Graph) -> np.ndarray:
    """Labels from pattern spans, and from words after or inside a key such as ``password=``."""
    y = np.zeros(len(graph.spans), np.int64)
    secret = LABELS.index("secret")
    for i in range(len(graph.spans)):
        if graph.x[i, -1]:
            y[i] = secret
    starts = np.array([s for s, _ in graph.spans])
    ends = np.array([e for _, e in graph.spans])
    for kind, s, e in base_spans(text):
        y[(starts < e) & (ends > s)] = kind + 1
    return y


# --- the field ---------------------------------------------------------------


@dataclass(frozen=True)
class FieldParameters:
    """The field is fitted on at most ``texts`` texts with at most ``words`` words each.

    A word joins the spans if its label's probability reaches ``sure``.
    """

    texts: int = 3_000
    words: int = 64
    sure: float = 0.9
    rounds: int = 12
    steps: int = 300


# Prior weight of a long value of a key for the label ``secret``.
KEYED_PRIOR = 8.0


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


@dataclass
class Field:
    """Unary weights, chain potentials by (left, right) label, and skip agreement by label."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    how: FieldParameters

    def marginals(self, x: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Label probabilities by damped sum-product message passing.

        Edges of many texts may be passed together: they do not touch.
        """
        local = x @ self.unary
        if not len(chain) and not len(skip):
            return _softmax(local)
        source = np.concatenate([chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]])
        target = np.concatenate([chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]])
        nc, ns = len(chain), len(skip)
        back = np.concatenate([np.arange(nc) + nc, np.arange(nc), 2 * nc + ns + np.arange(ns), 2 * nc + np.arange(ns)])
        agree = np.diag(self.skip)
        tables = np.exp(np.stack([self.chain, self.chain.T, agree]))
        which = np.repeat([0, 1, 2], [nc, nc, 2 * ns])
        message = np.zeros((len(source), len(LABELS)))
        for _ in range(self.how.rounds):
            belief = local.copy()
            np.add.at(belief, target, message)
            out = belief[source] - message[back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.empty_like(out)
            for k in range(3):
                new[which == k] = out[which == k] @ tables[k]
            new = np.log(new / new.sum(1, keepdims=True))
            change = np.abs(new - message).max()
            message = 0.5 * message + 0.5 * new
            if change < 1e-3:
                break
        belief = local.copy()
        np.add.at(belief, target, message)
        return _softmax(belief)


def fit_by_pseudolikelihood(
    x: np.ndarray, y: np.ndarray, chain: np.ndarray, skip: np.ndarray, how: FieldParameters
) -> Field:
    """Each word's label given its neighbours' labels; Adam on the tied parameters."""
    k = len(LABELS)
    # Like words are expected to agree, and long values of keys to be secrets whatever
    # their characters, unless the sample says otherwise.
    prior = [np.zeros((x.shape[1], k)), np.zeros((k, k)), np.ones(k)]
    prior[0][-1, LABELS.index("secret")] = KEYED_PRIOR
    params = [p.copy() for p in prior]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    one = np.eye(k)[y]
    near = np.zeros((len(y), k))  # skip neighbours by label
    np.add.at(near, skip[:, 0], one[skip[:, 1]])
    np.add.at(near, skip[:, 1], one[skip[:, 0]])
    n = max(1, len(y))
    for t in range(1, how.steps + 1):
        z = x @ params[0] + near * params[2]
        np.add.at(z, chain[:, 1], params[1][y[chain[:, 0]]])
        np.add.at(z, chain[:, 0], params[1][:, y[chain[:, 1]]].T)
        d = one - _softmax(z)
        g_chain = np.zeros((k, k))
        np.add.at(g_chain, y[chain[:, 0]], d[chain[:, 1]])
        right = np.zeros((k, k))
        np.add.at(right, y[chain[:, 1]], d[chain[:, 0]])
        grads = [x.T @ d, g_chain + right.T, (near * d).sum(0)]
        for i, g in enumerate(grads):
            g = g / n - 1e-4 * (params[i] - prior[i])
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] + 0.1 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return Field(params[0], params[1], np.maximum(params[2], 0.0), how)


def _edges(pairs: list[tuple[int, int]]) -> np.ndarray:
    return np.array(pairs, np.int64).reshape(-1, 2)


def fit_field(docs: DataFrame, how: FieldParameters = FieldParameters()) -> Field:
    """Fit on a hashed sample of the texts that hold a digit, an at sign or a key.

    Of a longer text, a stretch of ``how.words`` words at a hashed place is used.
    Without any such text the field labels nothing.
    """
    some = written(
        docs.where(F.col("text").rlike("(?i)[0-9@]|" + _KEYED)).select(F.xxhash64("text").alias("h")).distinct(), "candidate-texts"
    )
    # Bounded by its parameter, so it may be broadcast.
    chosen = F.broadcast(hashed_sample(some, how.texts, "h"))
    texts = docs.select("text", F.xxhash64("text").alias("h")).join(chosen, "h")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {"h": [], "x": [], "y": [], "chain": [], "skip": []}
        for h, raw in zip(batch.column("h").to_pylist(), text_bytes(batch.column("text"))):
            text = raw.decode(errors="replace")
            graph = graph_of(text)
            y = silver_labels(text, graph)
            n = len(y)
            lo = h % max(1, n - how.words + 1)
            hi = min(n, lo + how.words)

            def inside(pairs):
                return _edges([(a - lo, b - lo) for a, b in pairs if lo <= a < hi and lo <= b < hi])

            out["h"].append(h)
            out["x"].append(graph.x[lo:hi].astype("<f4").tobytes())
            out["y"].append(y[lo:hi].astype("<i8").tobytes())
            out["chain"].append(inside(graph.chain).tobytes())
            out["skip"].append(inside(graph.skip).tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(out["h"], pa.int64()), *(pa.array(out[c], pa.binary()) for c in ("x", "y", "chain", "skip"))],
            names=["h", "x", "y", "chain", "skip"],
        )

    featured = arrow_pass(texts, work, "h bigint, x binary, y binary, chain binary, skip binary")
    # Copies of a text give the same row.
    rows = sorted(featured.dropDuplicates(["h"]).collect(), key=lambda r: r["h"])
    xs, ys, chains, skips, base = [], [], [], [], 0
    for r in rows:
        y = np.frombuffer(r["y"], "<i8")
        xs.append(np.frombuffer(r["x"], "<f4").reshape(-1, N_UNARY))
        ys.append(y)
        chains.append(np.frombuffer(r["chain"], "<i8").reshape(-1, 2) + base)
        skips.append(np.frombuffer(r["skip"], "<i8").reshape(-1, 2) + base)
        base += len(y)
    if not base:
        nothing = np.zeros((N_UNARY, len(LABELS)))
        nothing[0, 0] = 10.0
        return Field(nothing, np.zeros((len(LABELS), len(LABELS))), np.zeros(len(LABELS)), how)
    x, y = np.vstack(xs).astype(float), np.concatenate(ys)
    return fit_by_pseudolikelihood(x, y, np.vstack(chains), np.vstack(skips), how)


def find_spans(texts: list[bytes], field: Field) -> list[tuple[list, list]]:
    """For each text its pattern spans and all spans, as (kind, start, end)."""
    found: list[tuple[list, list]] = [([], []) for _ in texts]
    work = []
    xs, chain, skip, base = [], [], [], 0
    for i, raw in enumerate(texts):
        if not _MAYBE.search(raw):
            continue
        text = raw.decode(errors="replace")
        graph = graph_of(text)
        found[i] = (base_spans(text), [])
        work.append((i, text, graph, base))
        xs.append(graph.x)
        chain += [(a + base, b + base) for a, b in graph.chain]
        skip += [(a + base, b + base) for a, b in graph.skip]
        base += len(graph.spans)
    if not work:
        return found
    p = field.marginals(np.vstack(xs), _edges(chain), _edges(skip))
    label, sure = p.argmax(1), p.max(1) >= field.how.sure
    for i, text, graph, first in work:
        known = found[i][0]
        taken = sorted((s, e) for _, s, e in known)
        more = []
        at, reach = 0, 0
        for j, (s, e) in enumerate(graph.spans):
            while at < len(taken) and taken[at][0] < e:
                reach = max(reach, taken[at][1])
                at += 1
            if reach > s or not sure[first + j] or not label[first + j]:
                continue
            word = text[s:e]
            inside = _KEY_INSIDE.search(word)
            lo = inside.end() if inside and inside.end() < len(word) else 0
            hi = len(word.rstrip("\"'.,;:!?)]}>"))
            lo += len(word[lo:hi]) - len(word[lo:hi].lstrip("\"'([{<"))
            if lo < hi:
                more.append((int(label[first + j]) - 1, s + lo, s + hi))
        found[i] = (known, sorted(known + _joined(text, more)))
    return found


def _joined(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Neighbouring words of one kind, such as the parts of a number, as one span."""
    out: list[tuple[int, int, int]] = []
    for kind, s, e in spans:
        if out and out[-1][0] == kind and s - out[-1][2] <= 3:
            between = text[out[-1][2] : s]
            if "\n" not in between and not between.strip(" ()-"):
                out[-1] = (kind, out[-1][1], e)
                continue
        out.append((kind, s, e))
    return out


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, counts of the pattern kinds, base_sha256, spans of every document.

    Offsets count code points; broken UTF-8 counts as replacement characters.  NULL and empty texts have no spans; repeated rows
    are treated alike; other columns are ignored.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = find_spans(list(text_bytes(batch.column("text"))), field)
        counts = [[sum(k == kind for k, _, _ in base) for base, _ in found] for kind in range(4)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                *(pa.array(c, pa.int64()) for c in counts),
                pa.array([hashlib.sha256(spelled(base).encode()).hexdigest() for base, _ in found], pa.string()),
                pa.array([spelled(every) for _, every in found], pa.string()),
            ],
            names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        )

    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    return arrow_pass(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), work, schema)


def redacted_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    parts, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            parts += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """The documents with personal data replaced by its kind; a column n_chars follows the text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = list(text_bytes(batch.column("text")))
        column = batch.column("text")
        found = [every for _, every in find_spans(texts, field)]
        new = [redacted_text(t.decode(errors="replace"), every) if every else None for t, every in zip(texts, found)]
        kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
        kept = [t.encode() if t is not None else o.as_py() for t, o in zip(new, column.cast(kind))]
        columns = list(batch.columns)
        names = batch.schema.names
        columns[names.index("text")] = pa.array(kept, kind).view(column.type)
        if "n_chars" in names:
            was = batch.column("n_chars")
            sizes = [w if t is None else len(t) for t, w in zip(new, was.to_pylist())]
            columns[names.index("n_chars")] = pa.array(sizes, was.type)
        return pa.RecordBatch.from_arrays(columns, names=names)

    return arrow_pass(docs, work, docs.schema)
