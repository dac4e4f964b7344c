"""The registered queries of the operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.context_mixing import score_documents
from tidegauge.llm.cotraining import fit_cotraining, score_quality
from tidegauge.llm.decontamination import benchmark_leaks, latent_spaces
from tidegauge.llm.mixing import mix
from tidegauge.llm.near_duplicates import NearDuplicates, near_duplicate_classes
from tidegauge.llm.personal_data import fit_field, personal_data
from tidegauge.llm.quality_rules import judge
from tidegauge.llm.source_divergence import source_divergence
from tidegauge.llm.toxicity import fit_toxicity, score_toxicity
from tidegauge.llm.url_filter import judge_urls
from tidegauge.llm.vector_cells import near_duplicate_vectors
from tidegauge.llm.warc_packages import through_packages
from tidegauge.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents over four-word shingles."""
    return near_duplicate_classes(table(spark, sf_dir, "documents"), NearDuplicates(width=4))


@query
def op4_isolation_forest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics of all documents and the forest's verdict."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


@query
def op5_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by two views that teach each other."""
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_cotraining(docs, table(spark, sf_dir, "labels")))


@query
def op3_zip_warc_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records in ZIP packages, read back by range."""
    return through_packages(spark, table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLES["op3_zip_warc_reader"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), q AS (
  SELECT *, CASE WHEN payload_bytes >= 100
                 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM q
"""


@query
def op10_skip_chain_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    docs = table(spark, sf_dir, "documents")
    return personal_data(docs, fit_field(docs))


@query
def op7_latent_semantic_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in all documents."""
    docs = table(spark, sf_dir, "documents")
    return benchmark_leaks(docs, latent_spaces(docs, table(spark, sf_dir, "benchmark")))


@query
def op9_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of all documents."""
    documents, _ = mix(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(documents: str) -> str:
    """Words taken by the mix, in SQL over a table of documents.

    However the schedule interleaves the sources, a source's slots take its shuffled
    words from the front until its target is reached, which SQL says in closed form.
    """
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle
  FROM {documents}
), tot AS (
  SELECT coalesce(sum(size), 0)::BIGINT AS words FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CAST(1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS DOUBLE) AS w
  FROM d GROUP BY source
), fill(round, source, source_size, w, held) AS (
  SELECT 0, source, source_size, w, false FROM s
  UNION ALL
  SELECT round + 1, source, source_size, w,
         held OR ((SELECT words FROM tot) - coalesce(sum(CASE WHEN held THEN 3.0 * source_size END) OVER (), 0))
                 * w / sum(CASE WHEN held THEN 0 ELSE w END) OVER () > 3.0 * source_size
  FROM fill WHERE round < (SELECT count(*) FROM s)
), lv AS (
  SELECT *, CASE WHEN held THEN 3.0 * source_size ELSE
    ((SELECT words FROM tot) - coalesce(sum(CASE WHEN held THEN 3.0 * source_size END) OVER (), 0))
    * w / sum(CASE WHEN held THEN 0 ELSE w END) OVER () END::DOUBLE AS target
  FROM fill WHERE round = (SELECT count(*) FROM s)
), pl AS (
  SELECT source, source_size, target, floor(target + 0.5)::BIGINT AS wanted FROM lv
)
SELECT d.doc_id, d.size, pl.source_size, pl.target,
       CASE WHEN d.size = 0 THEN 0 ELSE (
         d.size * (pl.wanted // pl.source_size)
         + greatest(0, least(pl.wanted % pl.source_size, d.start + d.size) - d.start)) END::BIGINT AS taken
FROM (
  SELECT doc_id, source, size, (sum(size) OVER (PARTITION BY source
           ORDER BY shuffle, doc_id NULLS FIRST, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS start
  FROM d
) d JOIN pl ON d.source IS NOT DISTINCT FROM pl.source
"""


ORACLES["op9_low_discrepancy_mix"] = mix_sql("documents")


@query
def op1_url_character_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all pages."""
    return judge_urls(table(spark, sf_dir, "pages"))


@query
def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents."""
    return score_documents(table(spark, sf_dir, "documents"))


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of every language over all documents."""
    return source_divergence(table(spark, sf_dir, "documents"))


ORACLES["op13_source_divergence"] = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms,
         row_number() OVER () AS doc
  FROM documents
), t AS (
  SELECT lang, source, doc,
         translate(unnest(terms), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM d
), kept AS (
  SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 10
), c AS (
  SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS n
  FROM t JOIN kept USING (lang, term) GROUP BY t.lang, t.source, t.term
), g AS (
  SELECT g.lang, g.source, coalesce(s.n, 0)::HUGEINT AS n,
         (SELECT count(*) FROM kept k WHERE k.lang = g.lang)::HUGEINT AS v
  FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) s USING (lang, source)
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.n + 2 * g.v) AS p
  FROM g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)
), l AS (
  SELECT lang, term,
         1 + 1000000000 * (sum(n) + 2) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang))
           AS q
  FROM c GROUP BY lang, term
), pair AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(z.value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN (
    SELECT a.lang, a.source AS a, b.source AS b, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY a.lang, a.source, b.source
  ) z ON z.lang = x.lang AND z.a = x.source AND z.b = y.source
), term AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - l.q) * (p.p - l.q) // (p.p + l.q) AS value
  FROM p JOIN l USING (lang, term) WHERE p.n > 0 AND p.p > l.q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query
def op11_spherical_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all vectors at a cosine of 0.93."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


ORACLES["op11_spherical_cells"] = """
WITH RECURSIVE r AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER () AS node FROM embeddings
), ok AS (
  SELECT * FROM r
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(v, lambda c: c <> 0)) > 0
), pairs AS (
  SELECT a.node AS x, b.node AS y
  FROM ok a JOIN ok b ON a.label = b.label AND len(a.v) = len(b.v) AND a.node <> b.node
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach(x, y) AS (
  SELECT node, node FROM r UNION SELECT reach.x, pairs.y FROM reach JOIN pairs ON pairs.x = reach.y
), classes AS (
  SELECT reach.x, min(r.vec_id) AS component_id FROM reach JOIN r ON r.node = reach.y GROUP BY reach.x
)
SELECT r.vec_id, (SELECT count(*) FROM pairs WHERE pairs.x = r.node) AS n_links, c.component_id,
       r.vec_id IS NOT DISTINCT FROM c.component_id AS kept
FROM r JOIN classes c ON c.x = r.node
"""


@query
def op12_incremental_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the leading components of their covariance."""
    rows = whiten(table(spark, sf_dir, "embeddings"))
    # NULL where the exact number is longer than a long
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))
