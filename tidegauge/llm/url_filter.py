"""URL filter: host and path rules first, a character language-model ratio for the rest.

Two smoothed Markov models of variable order, one of accepted and one of rejected
URLs, give each character a log-likelihood ratio.  A context is kept only if it is
frequent, so an order is as high as the counts allow.  The mean ratio per character
is cut at a threshold calibrated on labelled URLs that the models did not see.
Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import LOWER, UPPER, lower_ascii
from tidegauge.session import broadcast_if_small, written

# Letters, one sign for all digits, punctuation, one sign for all else, the end.
SYMBOLS = [*LOWER, "0", *"./-_?&=%#:~+@", "*", "$"]


@dataclass(frozen=True)
class Rule:
    """A host suffix and a path prefix, such as ``example.com/de/``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


@dataclass(frozen=True)
class UrlModelParameters:
    """A context counts from ``least_count`` characters, whatever their number.

    ``shrink`` is the weight of the next shorter context; one of ``folds`` parts of the
    labelled URLs calibrates the threshold.
    """

    order: int = 3
    least_count: int = 8
    shrink: float = 4.0
    folds: int = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or NULL."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def folded(url: Column) -> Column:
    """The URL over ``SYMBOLS``, without the end sign."""
    plain = F.translate(url, UPPER + "123456789", LOWER + "0" * 9)
    return F.regexp_replace(plain, r"[^a-z0./\-_?&=%#:~+@]", "*")


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """The columns of ``urls`` with one row per character and order: context and character."""
    padded = urls.withColumn("_u", F.concat(F.lit("^" * order), folded(F.col("url")), F.lit("$")))
    ends = F.sequence(F.lit(order + 1), F.length("_u"))
    grams = F.flatten(
        F.transform(ends, lambda i: F.array(*[F.substr(F.col("_u"), i - k, F.lit(k + 1)) for k in range(order + 1)]))
    )
    return padded.select(*urls.columns, F.explode(grams).alias("gram"))


def fit_ratio(urls: DataFrame, how: UrlModelParameters = UrlModelParameters()) -> DataFrame:
    """(gram, delta): what each kept context adds to the log ratio of its next character.

    ``urls`` has distinct (url, accepted).  With orders 0 to k of a position summed,
    the ratio at the longest kept context remains.  The alphabet and the order bound
    the rows (some 4.6 million); real URLs use far fewer.
    """
    counts = written(
        _grams(urls.select("url", "accepted"), how.order)
        .groupBy("gram")
        .agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
        .withColumn("context", F.substr("gram", F.lit(1), F.length("gram") - 1)),
        "url-grams",
    )
    totals = counts.groupBy("context").agg(F.sum("a").alias("all_a"), F.sum("r").alias("all_r"))
    # A suffix of a context is at least as frequent, so all suffixes of a kept one are kept.
    kept = written(
        totals.where((F.col("all_a") + F.col("all_r") >= how.least_count) | (F.col("context") == "")),
        "url-contexts",
    )
    symbols = F.array(*[F.lit(s) for s in SYMBOLS])
    found = None
    lower = None
    for k in range(how.order + 1):
        level = (
            kept.where(F.length("context") == k)
            .withColumn("symbol", F.explode(symbols))
            .withColumn("gram", F.concat("context", "symbol"))
            .join(counts.select("gram", "a", "r"), "gram", "left")
            .fillna(0, ["a", "r"])
        )
        if lower is None:
            n = len(SYMBOLS)
            level = level.withColumns(
                {f"p_{c}": (F.col(c) + 1.0) / (F.col(f"all_{c}") + float(n)) for c in "ar"}
            ).withColumn("before", F.lit(0.0))
        else:
            shorter = lower.select(
                F.col("gram").alias("_shorter"), F.col("p_a").alias("q_a"), F.col("p_r").alias("q_r")
            )
            level = (
                level.withColumn("_shorter", F.substr("gram", F.lit(2)))
                .join(shorter, "_shorter")
                .withColumns(
                    {
                        f"p_{c}": (F.col(c) + how.shrink * F.col(f"q_{c}")) / (F.col(f"all_{c}") + how.shrink)
                        for c in "ar"
                    }
                )
                .withColumn("before", F.log(F.col("q_a") / F.col("q_r")))
            )
        lower = level.select("gram", "p_a", "p_r", (F.log(F.col("p_a") / F.col("p_r")) - F.col("before")).alias("delta"))
        lower = written(lower, "url-level")
        found = lower if found is None else found.unionByName(lower)
    return found.select("gram", "delta")


def mean_ratio(urls: DataFrame, ratio: DataFrame, how: UrlModelParameters = UrlModelParameters()) -> DataFrame:
    """(url, score) of distinct non-NULL urls: mean log ratio per character, the end included.

    A model beyond the broadcast limit meets the characters by a join on the gram, in
    which adaptive execution splits a frequent one.
    """
    grams = _grams(urls.select("url"), how.order)
    summed = grams.join(broadcast_if_small(ratio), "gram").groupBy("url").agg(F.sum("delta").alias("sum"))
    return summed.select("url", F.round(F.col("sum") / (F.length("url") + 1), 9).alias("score"))


def calibrated_cut(scored: DataFrame) -> float:
    """The score with the best sum of both classes' shares on the right side.

    ``scored`` has (accepted, score).  Scores are cut at thousandths, so the
    histogram that is searched is bounded.  Without both classes nothing is cut.
    """
    bins = scored.groupBy(F.floor(F.least(F.greatest(F.col("score"), F.lit(-20.0)), F.lit(20.0)) * 1000).alias("bin")).agg(
        F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")
    )
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    shares = bins.select(
        "bin",
        F.sum("a").over(whole).alias("all_a"),
        F.sum("r").over(whole).alias("all_r"),
        F.coalesce(F.sum("a").over(below), F.lit(0)).alias("lost"),
        F.coalesce(F.sum("r").over(below), F.lit(0)).alias("caught"),
    ).where("all_a > 0 and all_r > 0")
    best = shares.orderBy(
        (F.col("caught") / F.col("all_r") - F.col("lost") / F.col("all_a")).desc(), "bin"
    ).first()
    return best["bin"] / 1000 if best else float("-inf")


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule] = RULES, how: UrlModelParameters = UrlModelParameters()
) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page.

    URLs that a rule decides teach the models; the others are allowed if their
    score reaches the cut.  A NULL url has host and path empty, no rule and score 0;
    an empty one is scored by its end alone.  Repeated rows are judged alike; a url counts
    once in the models however often it occurs.  If the rules decide no URL either
    way, everything else is allowed.  Other columns are ignored.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("_url"))
    distinct = rows.select(F.col("_url").alias("url")).where("url is not null").distinct()
    # A page table may be a few large files; the work on its urls is dealt to all cores.
    host, path = host_and_path(F.col("url"))
    urls = distinct.repartition(pages.sparkSession.sparkContext.defaultParallelism).select(
        "url", host.alias("host"), path.alias("path")
    )
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    urls = written(urls.withColumns({"rule": rule, "by_rule": verdict}), "urls")
    labelled = urls.where("by_rule is not null").select("url", (F.col("by_rule") == "allow").alias("accepted"))
    held = F.crc32(F.col("url").cast("binary")) % how.folds == 0
    ratio = fit_ratio(labelled.where(~held), how)
    scored = written(mean_ratio(urls, ratio, how), "url-scores")
    cut = calibrated_cut(labelled.where(held).join(scored, "url").select("accepted", "score"))
    score = F.coalesce(F.col("score"), F.lit(0.0))
    by_model = F.when(score >= F.lit(cut), "allow").otherwise("block")
    judged = rows.join(urls.join(scored, "url", "left"), F.col("_url") == F.col("url"), "left")
    return judged.select(
        "page_id",
        F.coalesce("host", F.lit("")).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        "rule",
        F.coalesce("by_rule", by_model).alias("verdict"),
        score.alias("score"),
    )
