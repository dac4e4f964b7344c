"""URL filter, quality rules, toxicity, co-training: brute force, accuracy, edge cases."""

import dataclasses
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidegauge.llm import cotraining, quality_rules, toxicity, url_filter
from tidegauge.llm.boosting import BoostedTrees, Isotonic

SF = "/root/testdata/sf0.01"
LONG = "word%d " * 3
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "score double, part int, held_out boolean, n_words bigint, kept string, x int"
)


@pytest.fixture(scope="module")
def edge_docs(spark):
    long = " ".join(f"word{i % 977} you" for i in range(60_000))
    texts = [None, "", " \n\t ", "one two", long, "same text here", "same text here", "é中 " * 60]
    rows = [(i, t, None, None, None, 1.0, 1, None, 1, "x", 1) for i, t in enumerate(texts)]
    rows += [(None, "no id", "en", "s", 5, None, None, None, None, None, None), rows[5]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def tables(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


def empty_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


# --- quality rules ---------------------------------------------------------------


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, dup, len(covered)


def test_statistics_against_brute_force(tables):
    rows = tables("documents").limit(300).collect()
    texts = [r["text"] for r in rows] + ["a b c a b c", "x\n x\nx\n\n\n", "a a a a", "#|<> éé\n", "a\x0bb\x0cc d"]
    for t in texts:
        assert tuple(quality_rules.text_statistics((t or "").encode())[:5]) == brute_statistics(t)


def test_rules_keep_good_and_catch_bad(tables):
    judged = quality_rules.judge(tables("documents"), tables("labels")).join(tables("labels"), "doc_id")
    rows = [r for r in judged.collect() if not r["base_failed"]]
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.1


def test_rules_on_edges(spark, edge_docs):
    rows = quality_rules.judge(edge_docs, empty_labels(spark)).collect()
    assert len(rows) == edge_docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert all(by_id[i]["n_words"] == 0 and by_id[i]["base_failed"] and not by_id[i]["kept"] for i in (0, 1, 2))
    assert by_id[7]["word_chars"] == 120
    kept = quality_rules.keep_good(edge_docs, empty_labels(spark))
    assert kept.columns == edge_docs.columns
    none = quality_rules.judge(edge_docs.limit(0), empty_labels(spark))
    assert none.count() == 0


def test_forest_finds_the_odd_one():
    rng = np.random.default_rng(0)
    usual = rng.normal(0, 1, (2000, 3))
    forest = quality_rules.IsolationForest(usual, quality_rules.ForestParameters(trees=50))
    score = forest.normality(np.vstack([usual[:50], [[9.0, 9.0, 9.0]]]))
    assert score[-1] < score[:-1].min()


# --- toxicity and boosting ----------------------------------------------------------


def test_toxicity_on_held_out_rows(tables):
    model = toxicity.fit_toxicity(tables("documents"), tables("labels"))
    rows = toxicity.score_toxicity(tables("documents"), model).join(tables("labels"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_toxicity_on_edges(spark, edge_docs):
    model = toxicity.fit_toxicity(edge_docs, empty_labels(spark))
    rows = toxicity.score_toxicity(edge_docs, model).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_toxicity(edge_docs.limit(0), model).count() == 0


def test_masked_words_and_proximity():
    lexicon = {b"moron": 3.0}
    plain = toxicity.text_features(b"you are a moron today", lexicon, 5)
    masked = toxicity.text_features(b"you are a m0r*n today", {b"morn": 3.0, b"moron": 3.0}, 5)
    clean = toxicity.text_features(b"you are a person today", lexicon, 5)
    assert plain[0] == 0.2 and plain[5] == 0.2 and masked[0] == 0.2 and clean[0] == 0


def test_isotonic_never_falls_and_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 2))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    trees = BoostedTrees(x, y)
    margin = trees.margin(x)
    assert np.mean((margin > 0) == (y == 1)) > 0.95
    score = Isotonic(margin, y)(np.sort(margin))
    assert (np.diff(score) >= 0).all()


# --- co-training ------------------------------------------------------------------------


def test_cotraining_keeps_good_documents(tables):
    model = cotraining.fit_cotraining(tables("documents"), tables("labels"))
    rows = cotraining.score_quality(tables("documents"), model).join(tables("labels"), "doc_id").collect()
    good = np.mean([r["kept"] for r in rows if r["quality"] == 1])
    bad = np.mean([r["kept"] for r in rows if r["quality"] == 0])
    assert good > 0.93 and bad < 0.25


def test_cotraining_on_edges(spark, edge_docs):
    model = cotraining.fit_cotraining(edge_docs, empty_labels(spark))
    rows = cotraining.score_quality(edge_docs, model).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    bare = edge_docs.select("doc_id", "text")
    assert cotraining.score_quality(bare.limit(0), model).count() == 0


def test_views_teach_each_other(spark):
    """One view has signal in the labels, the other only learns through pseudo-labels."""
    rng = np.random.default_rng(2)
    how = cotraining.CoTrainingParameters(pairs=11, categories=0, pseudo=500)
    y = rng.integers(0, 2, 40).astype(float)
    pool = rng.integers(0, 2, 2000).astype(float)

    def view(labels, strength, wide):
        noise = rng.normal(size=(len(labels), wide - 1))
        return np.column_stack([labels * strength + rng.normal(size=len(labels)), noise]).astype("<f4")

    a, b, pa_, pb = view(y, 6, 11), view(y, 2, 16), view(pool, 6, 11), view(pool, 2, 16)
    rows = [(i, bytearray(u.astype("<f2").tobytes()), bytearray(w.tobytes())) for i, (u, w) in enumerate(zip(pa_, pb))]
    table = spark.createDataFrame([*rows, rows[0]], "doc_id bigint, a binary, b binary").repartition(3)
    held = np.arange(40) % 4 == 0
    unlabelled = cotraining.Pool(table, how)
    once = cotraining.co_train(a, b, y, held, unlabelled, dataclasses.replace(how, rounds=0))
    more = cotraining.co_train(a, b, y, held, unlabelled, how)

    def right(model):
        return np.mean((model.metadata.logit(pb) > 0) == (pool == 1))

    assert right(more) > right(once) + 0.02

    # The passes over the table against the same rounds over one array.
    x, ids = [pa_.astype("<f2").astype(np.float32), pb], np.arange(2000)
    views = [cotraining._View(a, y), cotraining._View(b, y)]
    cuts, n = cotraining.chosen_cuts(unlabelled.counts(views, []), {0: 30.0, 1: 40.0})
    given = cotraining.given_labels([cotraining.Round(views, cuts)], x, ids)
    for v in (0, 1):
        p = 1 / (1 + np.exp(-views[v].logit(x[v])))
        least = {1: p[given[1 - v] == 1].min(), 0: (1 - p)[given[1 - v] == 0].min()}
        for label, quota in ((1, 40), (0, 30)):
            sure = p if label else 1 - p
            assert least[label] > 0.95
            assert abs((given[1 - v] == label).sum() - min(quota, (sure > 0.95).sum())) <= 8
            assert (sure > least[label] + 0.01).sum() <= (given[1 - v] == label).sum()
    taken = unlabelled.sample([cotraining.Round(views, cuts)], n)
    assert [len(t[1]) for t in taken] == [(g >= 0).sum() for g in given]


# --- URLs ---------------------------------------------------------------------------------


def test_hosts_paths_and_rules(spark):
    urls = [
        ("https://WWW.Example.net/en/1?x#y", "www.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://a.example.net/EN/1", "a.example.net", "/EN/1", "net/", "block"),
        ("http://example.net", "example.net", "", None, None),
        ("http://badexample.net/en/", "badexample.net", "/en/", "net/", "block"),
        ("ftp://x.org/fr/?q", "x.org", "/fr/", "org/fr/", "allow"),
        ("http://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"),
        ("http://h?http://other.net/en/", "h", "", None, None),
        ("no scheme.net/en/", "", "", None, None),
        ("", "", "", None, None),
        (None, "", "", None, None),
    ]
    df = spark.createDataFrame(
        [(i, u[0], "x", 1.0) for i, u in enumerate(urls)] + [(0, urls[0][0], "x", 1.0)],
        "page_id int, url string, host string, score double",
    )
    rows = url_filter.judge_urls(df).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        _, host, path, rule, verdict = urls[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def brute_ratio(urls, how):
    """Mean log ratios per url by plain counting."""
    counts = defaultdict(lambda: [0, 0])

    def folded(u):
        u = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else "0" if c in "123456789" else c for c in u)
        return re.sub(r"[^a-z0./\-_?&=%#:~+@]", "*", u)

    for u, accepted in urls:
        s = "^" * how.order + folded(u) + "$"
        for i in range(how.order, len(s)):
            for k in range(how.order + 1):
                counts[s[i - k : i + 1]][0 if accepted else 1] += 1
    totals = defaultdict(lambda: [0, 0])
    for gram, (a, r) in counts.items():
        totals[gram[:-1]][0] += a
        totals[gram[:-1]][1] += r
    kept = {c for c in totals if sum(totals[c]) >= how.least_count or c == ""}

    def p(context, c, side):
        n = totals[context][side]
        if context == "":
            return (counts[c][side] + 1) / (n + len(url_filter.SYMBOLS))
        return (counts[context + c][side] + how.shrink * p(context[1:], c, side)) / (n + how.shrink)

    def score(u):
        s = "^" * how.order + folded(u) + "$"
        total = 0
        for i in range(how.order, len(s)):
            context = next(s[i - k : i] for k in range(how.order, -1, -1) if s[i - k : i] in kept)
            total += math.log(p(context, s[i], 0) / p(context, s[i], 1))
        return total / (len(u) + 1)

    return score


@pytest.mark.parametrize("least_count, shuffled", [(8, False), (1, True)])
def test_ratio_against_brute_force(spark, tables, monkeypatch, least_count, shuffled):
    how = url_filter.UrlModelParameters(least_count=least_count)
    if shuffled:
        monkeypatch.setattr(url_filter, "broadcast_if_small", lambda df: df.hint("merge"))
    urls = [r["url"] for r in tables("pages").select("url").distinct().limit(120).collect()]
    labelled = [(u, ".org" in u) for u in urls]
    df = spark.createDataFrame(labelled, "url string, accepted boolean")
    got = {r["url"]: r["score"] for r in url_filter.mean_ratio(df, url_filter.fit_ratio(df, how), how).collect()}
    score = brute_ratio(labelled, how)
    assert set(got) == set(urls)
    assert all(abs(got[u] - score(u)) < 1e-8 for u in urls)
    assert np.mean([(got[u] > 0) == a for u, a in labelled]) > 0.95


def test_cut_splits_the_classes(spark):
    rows = [(True, 1.0)] * 5 + [(True, 0.5)] * 5 + [(False, -1.0)] * 9 + [(False, 0.7)]
    cut = url_filter.calibrated_cut(spark.createDataFrame(rows, "accepted boolean, score double"))
    assert -1.0 < cut <= 0.5
    assert url_filter.calibrated_cut(spark.createDataFrame([(True, 1.0)], "accepted boolean, score double")) == -math.inf
