"""URL filter: rules first, else gradient-boosted trees on lexical features; DataFrame, SQL and pyspark.ml only.

Features: lengths of url, host and path, depth, host labels, digit ratio, character entropy, parameter and
separator counts, and statistics of the host's last label and last two labels (their share of blocked labelled urls, smoothed, and
log of how many there are). The labelled urls are the ones that the rules decide, unless others are given.

Defined cases: a null url, or one without `://`, has an empty host and path, meets no rule and is judged by the
trees as the empty url. Rows that repeat are judged alike. An empty table gives no rows; urls of any length are read whole. Without labelled urls of both verdicts there are no
trees: all that no rule decides gets the one verdict seen, or allow. Other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LETTERS_LOW, LETTERS_UP, write_shared

#: Characters whose counts make the entropy; all others count as one kind.
ALPHABET = LETTERS_LOW + "0123456789-._~/?=&%:#+"
NUMBERS = ["n_url", "n_host", "n_path", "depth", "labels", "digits", "entropy", "params", "separators", "last_rate", "last_n", "two_rate", "two_n"]
#: Rules up to this many become one expression.
MOST_RULES = 1_000


def split_url(url: str = "url") -> tuple[Column, Column]:
    """Host, A to Z lower-cased, and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url), F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), LETTERS_UP, LETTERS_LOW), F.regexp_extract(text, pattern, 2)


def match_rules(rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule (host, path, verdict) that fits the columns host and path; null if none does.

    A rule is its host followed by its path. One pass without a shuffle, so the number of rules is bounded.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out = F.lit(None).cast("struct<rule string, verdict string>")
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _lexical(rows: DataFrame) -> DataFrame:
    """Adds the features that a url has by itself."""
    url = F.lower(F.coalesce("url", F.lit("")))
    n = F.greatest(F.length("low"), F.lit(1))
    counts = [F.length("low") - F.length(F.regexp_replace("low", "[0-9]", ""))]
    shares = [(F.length("low") - F.length(F.replace("low", F.lit(c)))) / n for c in ALPHABET]
    known = reduce(lambda a, b: a + b, shares)
    entropy = [F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in [*shares, 1.0 - known]]
    return rows.withColumn("low", url).select(
        "*",
        F.length("low").cast("double").alias("n_url"), F.length("host").cast("double").alias("n_host"), F.length("path").cast("double").alias("n_path"),
        F.regexp_count("path", F.lit("/[^/]")).cast("double").alias("depth"),
        F.regexp_count("host", F.lit("[^.]+")).cast("double").alias("labels"),
        (counts[0] / n).alias("digits"),
        reduce(lambda a, b: a + b, entropy).alias("entropy"),
        F.when(F.contains("low", F.lit("?")), F.regexp_count(F.regexp_extract("low", r"(?s)^[^?]*\?([^#]*)", 1), F.lit("[^&]+"))).otherwise(0).cast("double").alias("params"),
        F.regexp_count("low", F.lit("[-_.%=]")).cast("double").alias("separators"),
        F.substring_index("host", ".", -1).alias("last"), F.substring_index("host", ".", -2).alias("two"),
    ).drop("low")


def judge(
    urls: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url: str = "url", labelled: DataFrame | None = None,
    sample_rows: int = 100_000, trees: int = 10, depth: int = 4, prior: float = 5.0,
) -> DataFrame:
    """(id_col, host, path, rule, verdict, method) for each row of urls.

    labelled: (url, verdict) rows to learn from; the urls that rules decide if None. The trees are fitted on about
    sample_rows of them, chosen by the hash of the url; the statistics of suffixes come from all of them.
    """
    host, path = split_url("url")
    rows = urls.select(F.col(id_col).alias("id"), F.col(url).alias("url")).select("id", "url", host.alias("host"), path.alias("path")).withColumn("hit", match_rules(rules))
    rows = write_shared(rows, "urls")  # each url is parsed and matched once; all that follows reads this
    if labelled is None:
        known = rows.where("hit IS NOT NULL").select("url", "host", "path", F.col("hit.verdict").alias("verdict"))
    else:
        known = labelled.where("verdict IN ('allow', 'block')").select("url", *(c.alias(n) for c, n in zip(split_url(), ("host", "path"), strict=True)), "verdict")
    known = known.withColumn("label", (F.col("verdict") == "block").cast("double"))
    total, blocked = known.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not total or not 0 < blocked < total:
        only = F.lit("block" if total and blocked else "allow")
        return rows.select(F.col("id").alias(id_col), "host", "path", "hit.rule", F.coalesce("hit.verdict", only).alias("verdict"), F.when(F.col("hit").isNull(), "default").otherwise("rule").alias("method"))
    base = blocked / total

    stats = {}
    for name, k in (("last", -1), ("two", -2)):
        sums = known.groupBy(F.substring_index("host", ".", k).alias(name)).agg(F.sum("label").alias("b"), F.count(F.lit(1)).alias("n"))
        stats[name] = write_shared(sums.select(name, ((F.col("b") + prior * base) / (F.col("n") + prior)).alias(f"{name}_rate"), F.log1p("n").alias(f"{name}_n")), "suffixes")

    def with_suffixes(df: DataFrame) -> DataFrame:
        for name, found in stats.items():
            df = df.join(found, name, "left").na.fill({f"{name}_rate": base, f"{name}_n": 0.0})
        return df

    assemble = VectorAssembler(inputCols=NUMBERS, outputCol="features")
    drawn = known.where(F.pmod(F.xxhash64("url", F.lit(5)), F.lit(1 << 30)) < math.ceil(min(1.0, sample_rows / total) * (1 << 30)))
    features = write_shared(with_suffixes(_lexical(drawn)).select(*NUMBERS, "label"), "features")
    fitted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, labelCol="label").fit(assemble.transform(features).select("features", "label"))
    judged = fitted.transform(assemble.transform(with_suffixes(_lexical(rows))))
    return judged.select(
        F.col("id").alias(id_col), "host", "path", "hit.rule",
        F.coalesce("hit.verdict", F.when(F.col("prediction") > 0.5, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("hit").isNull(), "trees").otherwise("rule").alias("method"),
    )
