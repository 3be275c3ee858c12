"""URL filter: rules by host and path, and a logistic model for the URLs that no rule fits.

The model reads hashed character n-grams of host and path, made by SQL functions. It is fitted by MLlib on a small table of labelled URLs (at most
``train_rows``, those with the smallest hash) and applied as an SQL expression over its weights, whose number is
fixed (``buckets``).

Defined cases: a null URL, or one without ``://``, has an empty host and path; no rule fits it and the model judges the empty strings.
Rules are a short list; of several that fit the longest wins. Without labelled URLs of both kinds the model gives the one
verdict there is, or ``allow``. Repeated URLs get equal verdicts; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakelens.llm.common import ascii_lower, checkpointed, fresh

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class UrlModel:
    weights: tuple[float, ...]
    intercept: float
    grams: tuple[int, ...]


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits; a rule is its host followed by its path."""

    def fits(rule: str) -> Column:
        rule_host, _, rest = rule.partition("/")
        named = (host == rule_host) | host.endswith(f".{rule_host}")
        return named & path.startswith(f"/{rest}")

    ordered = sorted((r for r, _ in rules), key=lambda r: (-len(r), r))
    return F.coalesce(*[F.when(fits(r), r) for r in ordered], F.lit(None).cast("string"))


def _grams(part: Column, name: str, n: int, buckets: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(part) - n + 1, F.lit(1)))
    hashed = F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(name), F.substring(part, i, F.lit(n))), F.lit(buckets)).cast("int"))
    return F.when(F.length(part) >= n, hashed).otherwise(F.array().cast("array<int>"))


def features(host: Column, path: Column, buckets: int, grams: Sequence[int]) -> Column:
    """Distinct hashed n-grams of the host between its ends, and of the path."""
    ends = F.concat(F.lit("."), host, F.lit("/"))
    return F.array_distinct(
        F.concat(*[_grams(ends, "host", n, buckets) for n in grams], *[_grams(path, "path", n, buckets) for n in grams])
    )


def fit_urls(labelled: DataFrame, buckets: int = 4096, grams: Sequence[int] = (3, 4), train_rows: int = 10_000) -> UrlModel:
    """Fit on (host, path, label): label 1 to allow, 0 to block; rows with nulls are left out."""
    picked = (
        labelled.where("host is not null and path is not null and label is not null")
        .select("host", "path", F.col("label").cast("double").alias("label"))
        .orderBy(F.xxhash64("host", "path"), "host", "path").limit(train_rows)
    )
    # kept: the few rows are read several times, and each time would pass over all URLs
    sample = checkpointed(picked).withColumn("grams", features(F.col("host"), F.col("path"), buckets, grams).cast("array<string>"))
    seen = [r.label for r in sample.select("label").distinct().collect()]
    if len(seen) < 2:
        return UrlModel((0.0,) * buckets, 30.0 if not seen or seen[0] else -30.0, tuple(grams))
    # the "vocabulary" is the bucket numbers: it only turns lists of them into sparse vectors
    vectors = CountVectorizerModel.from_vocabulary([str(i) for i in range(buckets)], inputCol="grams", outputCol="features")
    model = LogisticRegression(maxIter=40, regParam=0.001).fit(vectors.transform(sample).select("features", "label"))
    return UrlModel(tuple(float(w) for w in model.coefficients.toArray()), float(model.intercept), tuple(grams))


def score_url(host: Column, path: Column, model: UrlModel) -> Column:
    """Probability that a URL is to be allowed."""
    weights = F.lit(list(model.weights))
    found = features(host, path, len(model.weights), model.grams)
    total = F.aggregate(found, F.lit(model.intercept), lambda acc, i: acc + F.get(weights, i))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]], labelled: DataFrame | None = None, url: str = "url", **fit: int
) -> DataFrame:
    """``pages`` with host, path, rule, score and verdict.

    Without ``labelled`` (host, path, label) the labelled table is the URLs that a rule fits.
    """
    verdict_of = dict(rules)
    own = [c for c in pages.columns if c.lower() not in {"host", "path", "rule", "score", "verdict"}]
    # made in a generator: a filter on the rule then reads host and path, and does not take the URL apart again for each of them
    parts = pages.select(*own, F.inline(F.array(F.struct(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")))))
    parts = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    allowed = [r for r, v in rules if v == "allow"]
    if labelled is None:
        labelled = parts.where("rule is not null").select("host", "path", F.col("rule").isin(allowed).cast("int").alias("label"))
    model = fit_urls(labelled, **fit)
    by_rule = F.coalesce(*[F.when(F.col("rule") == r, v) for r, v in verdict_of.items()], F.lit(None).cast("string"))
    return parts.withColumn("score", score_url(F.col("host"), F.col("path"), model)).withColumn(
        "verdict", F.coalesce(by_rule, F.when(F.col("score") >= 0.5, "allow").otherwise("block"))
    )


def keep_allowed(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url") -> DataFrame:
    """The pages whose URL is allowed, with their own columns."""
    key = fresh(pages.columns, "_url")
    judged = judge_urls(pages.select(F.col(url).alias(key)).distinct(), rules, url=key)
    good = judged.where("verdict = 'allow'").select(key)
    return pages.join(good, pages[url].eqNullSafe(good[key]), "left_semi")
