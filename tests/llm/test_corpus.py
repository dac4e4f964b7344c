"""Near duplicates, leaks, personal data, packages, mixing, scoring, pipeline."""

import hashlib
import itertools
import math
import random
import re
import zipfile
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidegauge.llm import context_mixing, decontamination, mixing, near_duplicates, personal_data, warc_packages
from tidegauge.llm.components import components
from tidegauge.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, root int, size int, start int, row int, word string, n int"


def doc(i, text, source="s", *rest):
    return (i, text, "en", source, None if text is None else len(text), "k", 1, 1, 1, 1, "w", 1)


@pytest.fixture(scope="module")
def edge_docs(spark):
    long = " ".join(f"w{i % 3011}" for i in range(90_000))
    rows = [doc(0, None), doc(1, ""), doc(2, " \n "), doc(3, "Same Words here"), doc(4, "same words here")]
    rows += [doc(4, "same words here"), doc(5, long, None), doc(None, "same  words here"), doc(None, "alone", None)]
    rows += [(None,) * 12]
    return spark.createDataFrame(rows, DOCS)


# --- near duplicates ------------------------------------------------------------------


def brute_classes(rows, width, percent):
    sets, parent = {}, {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        span = min(width, len(words))
        sets[i] = {tuple(words[j : j + span]) for j in range(len(words) - span + 1)} if words else set()
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def family(seed, size, words, changes):
    r = random.Random(seed)
    base = [f"t{seed}_{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(r.randrange(changes)):
            own[r.randrange(words)] = f"x{r.randrange(10**9)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("width", [4, 5])
def test_classes_against_brute_force(spark, width):
    texts = family(1, 60, 120, 7) + family(2, 25, 60, 4) + family(3, 8, 400, 20)
    texts += ["a b c", "A B C", "a b", "a", "", None, "a b c d", "d c b a"]
    random.Random(5).shuffle(texts)
    rows = list(enumerate(texts))
    how = near_duplicates.NearDuplicates(width=width, list_block=16, family_block=8)
    df = near_duplicates.near_duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string"), how)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}
    assert got == brute_classes(rows, width, 80)


def test_classes_on_edges(spark, edge_docs):
    rows = near_duplicates.near_duplicate_classes(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        if r["doc_id"] in (0, 1, 2, 5):
            assert r["component_id"] == r["doc_id"] and r["kept"]
    same = [r for r in rows if r["component_id"] == 3]
    assert sorted((r["doc_id"] or -1, r["kept"]) for r in same) == [(-1, False), (3, True), (4, False), (4, False)]
    left = near_duplicates.one_of_each(edge_docs)
    assert left.columns == edge_docs.columns
    assert sorted(r["text"] or "" for r in left.collect() if (r["text"] or "").strip()) == sorted(
        ["Same Words here", "alone", next(r["text"] for r in edge_docs.collect() if r["doc_id"] == 5)]
    )
    assert near_duplicates.one_of_each(edge_docs.limit(0)).count() == 0


def test_repeated_rows_enter_a_family_once(spark, monkeypatch):
    words = [f"w{i}" for i in range(200)]
    text, near = " ".join(words), " ".join([*words[:-1], "other"])
    alone = " ".join(f"n{i}" for i in range(200))
    rows = [(1, text)] * 40 + [(2, near)] + [(None, alone)] * 30 + [(None, alone + " more")] * 20
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    entered = []
    in_blocks = near_duplicates._in_blocks

    def watched(rows, group, *rest):
        if group == "root":
            entered.append(rows)
        return in_blocks(rows, group, *rest)

    monkeypatch.setattr(near_duplicates, "_in_blocks", watched)
    got = near_duplicates.near_duplicate_classes(docs).collect()
    assert [r["count"] for r in entered[0].groupBy("key").count().collect()] == [1] * 4
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == {(1, 1): 40, (2, 1): 1, (None, None): 50}


def test_bloom_filter_misses_nothing(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    for bits in (1 << 27, 1 << 10):  # ample, and saturated
        perhaps = near_duplicates.may_be_in(keys, bits)
        assert keys.where(perhaps(F.col("h"))).count() == 5000
    others = spark.range(10_000, 30_000).select(F.xxhash64("id").alias("h"))
    perhaps = near_duplicates.may_be_in(keys)
    assert others.where(perhaps(F.col("h"))).count() < 800
    assert others.where(near_duplicates.may_be_in(keys.limit(0))(F.col("h"))).count() == 0


def test_one_of_equal_ids_stays(spark):
    rows = [(7, "some words that repeat"), (7, "some words that repeat"), (7, "Some words that repeat"), (None, "q"), (None, "q")]
    left = near_duplicates.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(left) == 2


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(df, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(df.limit(0), "a", "b").count() == 0


def test_ties_of_a_part_need_no_round(spark, monkeypatch):
    """Ties lead to the smallest key of their part, and such stars are classes as they are."""
    keys = [b"d", b"b", b"e", b"a", b"c", b"f"]
    ties = near_duplicates._spanning(keys, np.array([0, 2, 1, 3]), np.array([2, 1, 0, 4]))
    assert sorted(ties) == [(b"c", b"a"), (b"d", b"b"), (b"e", b"b")]
    names = []

    def write(df, name):
        names.append(name)
        return df.cache()

    monkeypatch.setattr("tidegauge.llm.components.written", write)
    found = components(spark.createDataFrame([*ties, (None, b"a")], "a binary, b binary"), "a", "b")
    got = {bytes(r["node"]): bytes(r["root"]) for r in found.collect()}
    assert got == {b"a": b"a", b"c": b"a", b"b": b"b", b"d": b"b", b"e": b"b"}
    assert names == ["edges"]


# --- benchmark leaks ---------------------------------------------------------------------


def test_subsequence_against_brute_force():
    r = random.Random(0)

    def brute(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for _ in range(300):
        a = [b"%d" % r.randrange(5) for _ in range(r.randrange(1, 20))]
        b = [b"%d" % r.randrange(5) for _ in range(r.randrange(20))]
        masks = {}
        for i, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << i
        assert decontamination.subsequence_length(masks, len(a), b) == brute(a, b)


def test_planted_leaks_are_found(spark, edge_docs):
    r = random.Random(3)
    vocab = [f"v{i}" for i in range(3000)]
    items = [" ".join(r.choices(vocab, k=n)) for n in (10, 20, 45, 70, 150)]
    filler = lambda n: " ".join(r.choices(vocab, k=n))
    rows, expected = [], {}
    for i, item in enumerate(items):
        words = item.split()
        swapped = words[:]
        for j in range(0, len(words) - 6, 6):  # a paraphrase: every sixth word, not the answer
            swapped[j] = "other"
        for text, hit in (
            (f"{filler(90)} {item.upper()}, {filler(75)}", [i]),
            (f"{filler(33)} {' '.join(swapped)} {filler(40)}", [i]),
            (item, [i]),
            (filler(200), []),
            (" ".join(reversed(words)), []),
        ):
            expected[len(rows)] = hit
            rows.append((len(rows), text))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(
        [(i, t, 1) for i, t in enumerate(items)] + [(9, None, 1), (8, "", 1), (7, "too short", 1), (0, items[0], 1)],
        "item_id bigint, text string, block int",
    )
    how = decontamination.DecontaminationParameters(block=3)
    spaces = decontamination.latent_spaces(docs, bench, how)
    assert len(spaces) > 1
    got = {x["doc_id"]: list(x["item_ids"]) for x in decontamination.benchmark_leaks(docs, spaces, how).collect()}
    assert got == expected
    for one_pass in (decontamination.benchmark_leaks(docs, spaces, how), decontamination.without_leaks(docs, spaces, how)):
        assert one_pass._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    read = decontamination.SpaceReader(most=0)
    assert read(spaces[0]) is not read(spaces[0]) and read(spaces[0]).items == decontamination.SpaceReader()(spaces[0]).items
    clean = decontamination.without_leaks(docs, spaces, how)
    assert sorted(x["doc_id"] for x in clean.collect()) == [i for i, hit in expected.items() if not hit]
    marked = decontamination.benchmark_leaks(edge_docs, spaces, how).collect()
    assert len(marked) == edge_docs.count() and not any(x["contaminated"] for x in marked)
    assert decontamination.without_leaks(edge_docs, spaces, how).columns == edge_docs.columns
    assert decontamination.latent_spaces(docs, bench.limit(0), how) == []
    assert decontamination.without_leaks(docs.limit(0), spaces, how).count() == 0


def test_copies_beside_repeated_lines_are_found(spark):
    r = random.Random(8)
    vocab = [f"v{i}" for i in range(600)]
    texts = [r.choices(vocab, k=400) for _ in range(40)]
    items = [r.choices(vocab, k=n) for n in range(15, 60, 4)]
    beside = (["rare"], ["read", "more"], [*items[0][:2]])
    rows = [(-i, " ".join(t)) for i, t in enumerate(texts, 1)]
    rows += [
        (3 * i + k, " ".join([*(f * 48)[:48], *item, *(f * 200)[:200]]))
        for i, item in enumerate(items)
        for k, f in enumerate(beside)
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    spaces = decontamination.latent_spaces(docs, bench)
    got = {x["doc_id"]: list(x["item_ids"]) for x in decontamination.benchmark_leaks(docs, spaces).collect()}
    assert got == {i: [i // 3] if i >= 0 else [] for i, _ in rows}


def test_passages_of_long_items_and_short_items_are_found(spark):
    r = random.Random(10)
    vocab = [f"v{i}" for i in range(3000)]
    long = [r.choices(vocab, k=n) for n in (90, 100, 150, 300)]
    short = [["one"], ["two", "one"], r.choices(vocab, k=5), r.choices(vocab, k=7)]
    filler = lambda n: r.choices(vocab, k=n)
    cases = []
    for i, item in enumerate(long):
        for s in range(0, len(item) - 63, 32):
            cases.append(([*filler(50), *item[s : s + 64], *filler(120)], [i]))
        cases.append(([*filler(50), *item[:20], *filler(120)], []))
    for i, item in enumerate(short[1:], 5):
        cases.append(([*filler(40), *item, *filler(40)], [4, 5] if i == 5 else [i]))
        cases.append(([*filler(40), *item[:-1], "other", item[-1], *filler(40)], [4] if i == 5 else []))
    cases.append((short[0], [4]))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, (t, _) in enumerate(cases)], "doc_id bigint, text string")
    bench = spark.createDataFrame(
        [(i, " ".join(t)) for i, t in enumerate(long + short)], "item_id bigint, text string"
    )
    spaces = decontamination.latent_spaces(docs, bench)
    got = {x["doc_id"]: list(x["item_ids"]) for x in decontamination.benchmark_leaks(docs, spaces).collect()}
    assert got == {i: hit for i, (_, hit) in enumerate(cases)}


def test_candidates_hold_all_that_words_would_settle():
    r = random.Random(9)
    weight, times = np.array([5.0, 1.0, 3.0, 0.5]), np.array([1, 3, 2, 1])
    words = np.repeat(np.arange(4), times)
    for share in (0.65, 0.8, 1.0):
        least = min(
            weight[list({words[i] for i in kept})].sum()
            for kept in itertools.combinations(range(7), math.ceil(share * 7))
        )
        assert decontamination._needed(weight, times, share) <= least + 1e-9
    how = decontamination.DecontaminationParameters()
    column = np.full(how.dims, -1, np.int64)
    item = [b"%d" % i for i in range(40)]
    c = decontamination._columns(item, how.dims)
    column[c] = np.arange(40)
    reach = np.full((40, 1), 1 / 26 / 0.999, np.float32)
    space = decontamination.LatentSpace(column, reach, [(3, np.array([0]))], [item], [(1, item)])
    for _ in range(200):
        kept = sorted(r.sample(range(35), 21)) + [35, 36, 37, 38, 39]
        text = [b"x"] * r.randrange(20_000) + [item[i] for i in kept] + [b"x"] * r.randrange(300)
        assert decontamination.leaks_in(text, space, decontamination.WordColumns(how.dims), how) == {1: 26 / 40}


# --- personal data --------------------------------------------------------------------------


def brute_spans(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = [int(c) for c in re.sub("[^0-9]", "", m.group())][::-1]
        luhn = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0
        if 16 <= len(digits) <= 19 and luhn:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((3, *m.span()))
    return out


def test_pattern_spans_against_brute_force():
    r = random.Random(1)
    pieces = ["ab", "1", "22", "255", "256", "@", ".", "-", "+", " ", "(", ")", "a@b.c", "1.2.3.4", "4111 1111 1111 1111", "\n", "é"]
    for _ in range(4000):
        t = "".join(r.choice(pieces) for _ in range(r.randrange(14)))
        assert personal_data.base_spans(t) == brute_spans(t), t


def test_message_passing_is_exact_on_a_tree():
    rng = np.random.default_rng(0)
    k = len(personal_data.LABELS)
    field = personal_data.Field(rng.normal(size=(personal_data.N_UNARY, k)), rng.normal(size=(k, k)),
                                rng.uniform(0, 2, k), personal_data.FieldParameters(rounds=60))
    x = rng.normal(size=(4, personal_data.N_UNARY)) * 0.3
    chain, skip = np.array([[0, 1], [2, 3]]), np.array([[1, 2]])
    local = x @ field.unary
    want = np.zeros((4, k))
    for y in itertools.product(range(k), repeat=4):
        w = sum(local[i, y[i]] for i in range(4)) + sum(field.chain[y[a], y[b]] for a, b in chain)
        w = math.exp(w + sum(field.skip[y[a]] for a, b in skip if y[a] == y[b]))
        for i in range(4):
            want[i, y[i]] += w
    want /= want.sum(1, keepdims=True)
    assert np.abs(field.marginals(x, chain, skip) - want).max() < 2e-2


def test_repeated_words_agree():
    graph = personal_data.graph_of("id 12345 then later 12345, and 12345")
    assert [b for _, b in graph.skip] == [1, 2]
    k = len(personal_data.LABELS)
    field = personal_data.Field(np.zeros((personal_data.N_UNARY, k)), np.zeros((k, k)), np.full(k, 2.0), personal_data.FieldParameters())
    field.unary[0, 0] = 0.0
    x = np.zeros((3, personal_data.N_UNARY))
    x[0, 0] = 1.0
    field.unary[0, 2] = 3.0
    p = field.marginals(x, np.zeros((0, 2), int), np.array([[0, 1], [1, 2]]))
    assert p[1].argmax() == 2 and p[2].argmax() == 2


def test_personal_data_on_edges(spark, edge_docs):
    extra = spark.createDataFrame(
        [doc(20, "mail a.b@c.org and password=ab12cd34ef56ab78 é 1.2.3.4"), doc(21, "9" * 100_000 + " a" * 50_000)], DOCS
    )
    docs = edge_docs.unionByName(extra)
    r = random.Random(4)
    hexes = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    taught = []
    for i in range(300):
        secret = r.choice([f"password={hexes(16)}", f'token = "{hexes(40)}"'])
        ip = ".".join(str(r.randrange(256)) for _ in range(4))
        taught.append((i, f"some words {secret} and {ip} or m{i}.x@mail{i % 7}.org then {r.randrange(9999)} and v{i}"))
    field = personal_data.fit_field(spark.createDataFrame(taught, "doc_id bigint, text string"))
    rows = {r["doc_id"]: r for r in personal_data.personal_data(docs, field).collect()}
    assert rows[0]["spans"] == "" and rows[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[20]["n_email"] == 1 and rows[20]["n_ip"] == 1
    assert rows[20]["spans"] == "email:5:14,ip:47:54,secret:28:44"
    assert rows[20]["base_sha256"] == hashlib.sha256(b"email:5:14,ip:47:54").hexdigest()
    red = {r["doc_id"]: r for r in personal_data.redact(docs, field).collect()}
    assert red[20]["text"] == "mail <EMAIL> and password=<SECRET> é <IP>"
    assert red[20]["n_chars"] == len(red[20]["text"]) and red[0]["text"] is None
    assert personal_data.redact(docs, field).columns == docs.columns
    keyed = ["password=correct-horse-battery", "password=hunter2secret9", "the token: abcdefghijkl",
             'x "api_key": "qwertyuiopas", y', "compass: direction", "the secret: be kind", "bypass: some words",
             "password:\nEverything else"]
    spans = [personal_data.find_spans([t.encode()], field)[0][1] for t in keyed]
    values = [[t[s:e] for _, s, e in found] for t, found in zip(keyed, spans)]
    assert values == [["correct-horse-battery"], ["hunter2secret9"], ["abcdefghijkl"], ["qwertyuiopas"], [], [], [], []]
    broken = spark.sql("SELECT 1L AS doc_id, CAST(X'FF2070617373776F72643D616263643132333435' AS STRING) AS text")
    assert personal_data.personal_data(broken, field).first()["spans"] == "secret:11:20"
    assert personal_data.redact(broken, field).count() == 1
    nothing = personal_data.fit_field(docs.limit(0))
    assert personal_data.personal_data(edge_docs, nothing).count() == edge_docs.count()


def test_redaction_merges_overlaps():
    assert personal_data.redacted_text("abcdefgh", [(0, 1, 4), (2, 3, 6), (1, 7, 8)]) == "a<EMAIL>g<IP>"


# --- packages -----------------------------------------------------------------------------------


class Bytes:
    def __init__(self, raw):
        self.raw = raw

    def size(self):
        return len(self.raw)

    def read_at(self, n, at):
        return self.raw[at : at + n]


@pytest.mark.parametrize("limit", [None, 10])
def test_directory_of_plain_and_zip64_archives(tmp_path, monkeypatch, limit):
    if limit is not None:  # makes the writer use every ZIP64 field
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("one", b"x" * 500)
        z.writestr("packed", b"y" * 500, zipfile.ZIP_DEFLATED)
        z.writestr("two", b"z" * 300)
        z.comment = b"PK\x05\x06 in a comment, which is long enough to look like an end"
    raw = path.read_bytes()
    assert (b"PK\x06\x06" in raw) == (limit is not None)
    members = warc_packages.zip_members(Bytes(raw))
    assert sorted(members) == ["one", "two"]
    two = members["two"]
    assert raw[two.start : two.start + two.size] == b"z" * 300
    with pytest.raises(ValueError):
        warc_packages.zip_members(Bytes(b"not a zip"))


def test_packages_round_trip(spark):
    big = "<p>" + "é" * 100
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", big), (4, "u", "tiny"), (5, "u", "tiny"), (6, "u", None),
            (7, "u", ""), (None, "u", big), (1, "http://a/", big), (None, None, None), (8, "u", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id bigint, url string, html string, revisit int, n string")
    read = warc_packages.through_packages(spark, pages, payloads=True).collect()
    assert len(read) == len(rows)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read)
    want = Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= 100 and html == big and i != 1
        want[(i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 1 if again else None)] += 1
    assert got == want
    assert all(hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] for r in read if r["record_type"] == "response")
    assert warc_packages.through_packages(spark, pages.limit(0)).count() == 0


def test_broken_payload_is_an_error():
    row = {"page_id": 1, "url": "u", "payload": b"abc", "payload_bytes": 3, "payload_digest": "0" * 64, "revisit": False, "refers_to": None}
    with pytest.raises(ValueError):
        warc_packages.parse_record(warc_packages.warc_record(row))


# --- SQL checks and mixing ------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    rounded = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    assert Counter(map(rounded, got.select(*names).collect())) == Counter(map(rounded, cursor.fetchall()))


def filled(sizes, weights):
    """Targets by filling up round by round."""
    target, held = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in held)
        free = sum(weights[s] for s in sizes if s not in held)
        target = {s: 3.0 * sizes[s] if s in held else rest * weights[s] / free for s in sizes}
        over = {s for s in sizes if s not in held and target[s] > 3 * sizes[s]}
        if not over:
            return target
        held |= over


def test_targets_and_takings(spark, edge_docs):
    r = random.Random(2)
    rows = [doc(i, "w " * r.randrange(40), r.choice(["a", "b", "b", "b", "b", "é", "Z", None])) for i in range(500)]
    rows += [doc(900, "w " * 5, "tiny"), doc(900, "w " * 5, "tiny"), doc(901, "", "none")]
    docs = spark.createDataFrame(rows, DOCS)
    documents, pieces = mixing.mix(docs, mixing.MixParameters(bucket=16, slots=64))
    got = documents.collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for x in rows:
        sizes[x[3]] += len(x[1].split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = filled({s: n for s, n in sizes.items()}, {s: 1.0 + i % 3 for i, s in enumerate(order)})
    taken = Counter()
    for x in got:
        assert x["source_size"] == sizes[x["source"]] and abs(x["target"] - want[x["source"]]) < 1e-6
        assert 0 <= x["taken"] <= 3 * x["size"]
        taken[x["source"]] += x["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sum(p["to_word"] - p["from_word"] for p in pieces.collect()) == sum(taken.values())
    again, _ = mixing.mix(docs, mixing.MixParameters(bucket=16, slots=64))
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, got))
    edges, _ = mixing.mix(edge_docs)
    assert edges.count() == edge_docs.count()
    assert mixing.mix(docs.limit(0))[0].count() == 0
    blank, _ = mixing.mix(edge_docs.where("doc_id < 3"))
    assert [x["taken"] for x in blank.collect()] == [0, 0, 0]


def test_slots_are_spread_evenly(spark):
    rows = [doc(i, "w " * 20, "abc"[i % 3]) for i in range(300)]
    _, pieces = mixing.mix(spark.createDataFrame(rows, DOCS), mixing.MixParameters(slots=1000))
    slots = sorted({(p["slot"], p["source"]) for p in pieces.collect()})
    half = Counter(s for _, s in slots[: len(slots) // 2])
    total = Counter(s for _, s in slots)
    assert all(abs(half[s] - total[s] / 2) < 12 for s in total)


# --- scoring -----------------------------------------------------------------------------------------


def test_scores_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = context_mixing.score_documents(docs, context_mixing.MixingParameters(frequent=50, lessons=3000)).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in docs.collect()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = Counter(w for i, words in texts.items() if i not in held for w in [*words, b""])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(texts)
    for r in got:
        words = [*texts[r["doc_id"]], b""]
        assert r["held_out"] == (r["doc_id"] in held) and r["train_tokens"] == n
        assert (r["n_tokens"], r["n_known"]) == (len(words), sum(w in counts for w in words))
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        assert abs(base - r["base_score"]) < 1e-6 * max(1, abs(base))
        assert r["score"] < 0 and r["bits_per_byte"] < 8


def test_join_gives_what_frequent_words_give(spark):
    """A text scores the same whether its words travel with the tasks or come by the join."""
    rng = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, 30))) for i in range(60)], "doc_id long, text string")
    scores = []
    for frequent in (1, 100):
        how = context_mixing.MixingParameters(frequent=frequent, lessons=500, pairs=0)
        scores.append({r["doc_id"]: r["score"] for r in context_mixing.score_documents(docs, how).collect()})
    # The lessons are other draws, so the spelling differs a little.
    assert all(abs(scores[0][i] - scores[1][i]) < 0.05 * abs(scores[1][i]) for i in range(60))


def test_occurrence_terms():
    ids, start = np.array([0, 1, 0, 2, 1, 0, 0]), np.array([0, 5])
    before = np.concatenate([context_mixing.seen_before(ids[:5]), context_mixing.seen_before(ids[5:])])
    assert before.tolist() == [0, 0, 1, 0, 1, 0, 1]
    a, d = context_mixing.occurrence_terms(before, start, np.full(7, 0.5), np.full(7, 0.1), 50.0)
    assert a[5] == a[0] == 0.5 and d[0] == 0.1
    assert np.isclose(a[4], (1 - 1 / 54) * 0.5) and np.isclose(d[4], (1 - 1 / 54) * 0.1 + (1 / 54) * (1 / 4))
    assert context_mixing.words_before(ids, start).tolist() == [0, 0, 1, 0, 2, 0, 0]


def test_pairs_against_brute_force(spark):
    """All pairs of frequent words are counted; what follows a word adds up to one."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [(r["text"] or "").encode().lower().split() for r in docs.collect()]
    listed = [b"", *(w for w, _ in Counter(w for t in texts for w in t).most_common(300))]
    number = {w: k for k, w in enumerate(listed)}
    want = Counter()
    for words in texts:
        for u, w in itertools.pairwise([b"", *words, b""]):
            if u in number and w in number:
                want[number[u] * len(listed) + number[w]] += 1
    counted = context_mixing.pair_counts(docs, listed, 16).cache()
    keys, n = context_mixing.frequent_pairs(counted, 1)
    assert dict(zip(keys.tolist(), n.tolist())) == want
    least = context_mixing.least_pair_count(counted, 500)
    reached = sum(v >= least for v in want.values())
    assert 0 < reached <= 500 and context_mixing.least_pair_count(counted, 10**9) == 1

    training = docs.select((F.lit(False)).alias("held_out"), "text")
    how = context_mixing.MixingParameters(frequent=300, lessons=500, pairs=5000)
    scorer = context_mixing.fit_scorer(context_mixing.vocabulary(training).cache(), how)
    f = context_mixing.learn_followers(training, scorer)
    u = f.keys // f.words
    # Of each word before, ``keep`` and all ``extra`` make one.
    total = f.keep + np.bincount(u, f.extra, minlength=f.words)
    assert len(f.keys) and np.allclose(total, 1.0, atol=1e-5)


def test_score_beats_base_and_knows_the_order(spark):
    """Held-out texts score above the base; with shuffled words clearly lower."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(2)
    held = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 and len((r["text"] or "").split()) >= 20]
    free = (i for i in itertools.count(10**9) if zlib.crc32(str(i).encode()) % 7 == 2)
    shuffled = {next(free): r for r in held}
    rows = [(i, " ".join(rng.permutation(r["text"].split()).tolist())) for i, r in shuffled.items()]
    both = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in context_mixing.score_documents(both).collect()}
    tokens = sum(got[r["doc_id"]]["n_tokens"] for r in held)
    score = sum(got[r["doc_id"]]["score"] for r in held) / tokens
    base = sum(got[r["doc_id"]]["base_score"] for r in held) / tokens
    mixed_up = sum(got[i]["score"] for i in shuffled) / tokens
    assert score > base + 0.1 and score > mixed_up + 0.1


def test_every_training_word_teaches(spark):
    """Weights, map and share are learned from each word as often as it occurs, over several learners."""
    rng = np.random.default_rng(5)
    count = {bytes(rng.integers(97, 105, rng.integers(0, 7)).tolist()): int(rng.zipf(1.3)) % 5000 + 1 for _ in range(900)}
    tokens, bits = sum(count.values()), 8 * sum(n * (len(w) + 1) for w, n in count.items())
    vocab = spark.createDataFrame(list(count.items()), "word binary, n bigint").cache()
    n0, n1 = context_mixing.slot_counts(vocab)
    for a, b in itertools.pairwise(context_mixing.OFFSETS):
        assert n0[a:b].sum(dtype=float) + n1[a:b].sum(dtype=float) == bits
    how = context_mixing.MixingParameters(frequent=10, lessons=40, lesson_batch=10)
    counts = context_mixing.both_counts(n0, n1)
    rows = context_mixing.learned(vocab, counts, tokens, len(count), how).collect()
    of = {kind: sum(r["bits"] for r in rows if r["kind"] == kind) for kind in range(3)}
    assert np.isclose(of[context_mixing.WEIGHT], context_mixing.N_INPUTS * bits)
    assert np.isclose(of[context_mixing.REFINE], bits) and np.isclose(of[context_mixing.RATIO], tokens)
    # A word that is worth three occurrences teaches like three of it in one update.
    words = sorted(count)[:90]
    once = context_mixing.learn(counts, words, np.full(90, 3.0), context_mixing.MixingParameters())
    thrice = context_mixing.learn(counts, words * 3, np.ones(270), context_mixing.MixingParameters(lesson_batch=270))
    assert np.allclose(once.weights, thrice.weights, atol=1e-4) and np.allclose(once.met, thrice.met[:90], atol=1e-4)


def test_words_of_a_text_share_one_probability():
    """Over all continuations the probability of the next word adds up to at most one."""
    rng = np.random.default_rng(0)
    lessons = [bytes(rng.integers(97, 100, rng.integers(1, 4)).tolist()) for _ in range(2000)]
    n0, n1 = (np.zeros(int(context_mixing.OFFSETS[-1]), np.float32) for _ in range(2))
    c = context_mixing.contexts_of(lessons)
    for bit in range(8):
        y = context_mixing.bit_values(c, bit)
        for k, slot in enumerate(context_mixing.slots(c, bit)[1]):
            np.add.at(n1, context_mixing.OFFSETS[k] + slot[y == 1].astype(int), 1)
            np.add.at(n0, context_mixing.OFFSETS[k] + slot[y == 0].astype(int), 1)
    mixer, met = context_mixing.teach(n0, n1, lessons, context_mixing.MixingParameters(lessons=2000))
    words = [b""] + [bytes(w) for k in (1, 2, 3) for w in itertools.product(b"abc", repeat=k)]
    p = 10.0 ** mixer.word_logs(words)
    assert 0.9 < p.sum() <= 1.0
    assert len(met) == len(lessons) and (met < 0).all()
    # Copies of a word cost less and less inside a text.
    before = context_mixing.seen_before(np.zeros(40, int))
    a, d = context_mixing.occurrence_terms(before, np.array([0]), np.ones(40), np.zeros(40), 50.0)
    p = a * 1e-4 + d
    assert p[-1] > p[0]


def test_scores_on_edges(spark, edge_docs):
    how = context_mixing.MixingParameters(frequent=5, lessons=200)
    rows = context_mixing.score_documents(edge_docs, how).collect()
    assert len(rows) == edge_docs.count()
    assert all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (0, 1, 2))
    assert context_mixing.score_documents(edge_docs.limit(0), how).count() == 0


# --- pipeline -----------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1]
    mixed = corpus_pipeline.run(spark, SMALL)
    assert mixed.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    assert mixed.count() == sizes[-1]
