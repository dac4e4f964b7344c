"""Divergence of sources against brute force in whole numbers."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tidegauge.llm import source_divergence
from tidegauge.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, term string, n bigint, block int, p int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=10, top=10):
    def lower(term):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in term)

    counts, holders, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, terms = lang or "", [lower(t) for t in TERM.findall(text or "")]
        groups.add((lang, source or ""))
        counts[lang, source or ""].update(terms)
        holders[lang].update(set(terms))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in holders[lang].items() if n >= least]

        def prices(found):
            total = sum(found[t] for t in kept)
            return {t: 1 + 10**9 * (found[t] + 2) // (total + 2 * len(kept)) for t in kept}

        whole = sum((counts[g] for g in groups if g[0] == lang), Counter())
        p, q = prices(counts[lang, source]), prices(whole)
        lists = {"pair": [], "term": []}
        for other in {s for g, s in groups if g == lang} - {source}:
            o = prices(counts[lang, other])
            lists["pair"].append((-sum((p[t] - o[t]) ** 2 // (p[t] + o[t]) for t in kept), other.encode()))
        for t in kept:
            if counts[lang, source][t] and p[t] > q[t]:
                lists["term"].append((-((p[t] - q[t]) ** 2 // (p[t] + q[t])), t.encode()))
        for part, found in lists.items():
            for rank, (value, item) in enumerate(sorted(found), 1):
                if part == "pair" or rank <= top:
                    out.add((lang, source, part, item.decode(), -value, rank))
    return out


def given(spark, rows):
    full = [(i, t, lang, source, "x", 1, 1, 1) for i, (t, lang, source) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS)


def answered(df):
    columns = ["lang", "source", "part", "item", "value", "rank"]
    assert df.columns == columns
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("least,block", [(1, 4), (3, 1 << 15)])
def test_values_against_brute_force(spark, least, block):
    rng = np.random.default_rng(least)
    words = ["Alpha", "alpha", "beta9gamma", "Ünder", "ünder", "日本語", "z", "don't", "É", "éx"] + [
        f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)
    ]
    rows = []
    for lang in ("en", "de", None):
        for i in range(60):
            size = int(rng.integers(0, 25))
            text = " ".join(words[int(k)] for k in np.minimum(rng.zipf(1.3, size), len(words)) - 1)
            rows.append((text, lang, f"s{min(int(rng.zipf(1.6)), 7)}"))
    rows += [("only ascii \x00\x7f 123 __", "xx", "lonely"), (None, "en", "empty"), ("", "en", None), ("a", "en", "")]
    rows += [rows[0]] * 5
    how = source_divergence.Divergence(least_documents=least, top=3, block_terms=block, held=50)
    assert answered(source_divergence.source_divergence(given(spark, rows), how)) == brute(rows, least, 3)


def test_edges(spark):
    assert answered(source_divergence.source_divergence(given(spark, []))) == set()
    nothing = [(None, None, None), ("", "en", "a"), ("... 1 2", "en", "b"), ("once", "en", "c")]
    found = answered(source_divergence.source_divergence(given(spark, nothing)))
    assert found == brute(nothing) and all(r[4] == 0 for r in found) and len(found) == 6
    long = " ".join(f"t{chr(97 + i % 26)}{'x' * (i % 50)}" for i in range(200_000))
    ties = [(long, "en", "a")] * 10 + [("same same", "en", s) for s in ("b", "c", "Z", "é")] * 10
    assert answered(source_divergence.source_divergence(given(spark, ties))) == brute(ties)


def test_gallop_finds_what_is_there():
    rng = np.random.default_rng(3)
    for small, large, run in ((0, 5, 4), (5, 0, 4), (40, 4000, 8), (900, 1000, 16), (3000, 3000, 256)):
        few = np.unique(rng.integers(0, 5000, small))
        many = np.unique(rng.integers(0, 5000, large))
        places = source_divergence.gallop(few, many, run)
        assert [bool(p >= 0) for p in places] == np.isin(few, many).tolist()
        assert (many[places[places >= 0]] == few[places >= 0]).all()


def test_prices_are_exact_for_large_counts():
    counts = np.array([0, 1, 7 * 10**12, 10**13], np.int64)
    size = 10**13 + 12345
    assert source_divergence.price(counts, size).tolist() == [1 + 10**9 * (int(c) + 2) // size for c in counts]


def test_arrays_round_trip():
    numbers = np.array([0, 3, 32767], np.int64)
    for largest in (1, 255, 256, 70_000, 1 << 40):
        counts = np.array([1, 2, largest], np.int64)
        back = source_divergence.decode_counts(source_divergence.encode_counts(numbers, counts))
        assert back[0].tolist() == numbers.tolist() and back[1].tolist() == counts.tolist()


def test_query_matches_sql(spark):
    documents = f"'{SMALL}/documents.parquet'"
    want = duckdb.sql(ORACLES["op13_source_divergence"].replace("FROM documents", f"FROM {documents}")).fetchall()
    assert answered(QUERIES["op13_source_divergence"](spark, SMALL)) == {tuple(r) for r in want}
