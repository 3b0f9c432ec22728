"""Mixing to target weights by iterative proportional fitting; DataFrame functions only.

Token sums of the cells (source, language, topic) are raked in turn to a target share for each source, each
language and each topic. A document's weight is its cell's factor a[source] * b[language] * c[topic]; it is kept
with probability min(1, scale * weight), where scale makes the expected tokens equal to `fraction` of all.

The cells are kept as one row for each source, so the step for sources stays within a row however many sources
there are; only the factors of languages and topics, small closed sets (at most MOST of each, else an error), pass
through the driver. A source, language or topic that holds a third of all rows is one key of map-side sums.

Defined cases: null source, language or topic is a value of its own. A null or empty text has no tokens and is not
kept. Rows that repeat are kept or dropped together, as the draw is a hash of the id (a null id draws as the
empty text). An empty table gives no rows. Texts of any length are counted whole. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import write_shared

MOST = 10_000
NONE = "\u0000"


def n_words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def kind_of_text(text: str = "text") -> Column:
    """A plain topic by form, for corpora without a topic column."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.contains(t, F.lit(" | ")), "table").when(F.contains(t, F.lit("Licensed under")), "licence").when(F.contains(t, F.lit("@")), "contact").otherwise("prose")


def _literal(factors: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in factors.items() for x in pair])


def _tempered(sums: dict[str, int], power: float) -> dict[str, float]:
    raised = {k: float(v) ** power if v else 0.0 for k, v in sums.items()}
    whole = sum(raised[k] for k in sorted(raised)) or 1.0
    return {k: v / whole for k, v in raised.items()}


def _aims(shares: dict[str, float] | None, sums: dict[str, int], power: float) -> dict[str, float]:
    """Target shares of the values that have tokens; given ones are scaled to a sum of 1 over these."""
    if shares is None:
        return _tempered(sums, power)
    have = {k: float(shares.get(k, 0.0)) if v else 0.0 for k, v in sums.items()}
    whole = sum(have[k] for k in sorted(have))
    if whole <= 0:
        raise ValueError("no value with a share has tokens")
    return {k: v / whole for k, v in have.items()}


def _drawn(
    docs: DataFrame, carry: tuple[Column, ...], topic: Column | None = None, id_col: str = "doc_id", source: str = "source", lang: str = "lang", text: str = "text",
    power: float = 0.5, rounds: int = 50, tolerance: float = 1e-6, fraction: float = 0.5,
    source_shares: DataFrame | dict[str, float] | None = None, lang_shares: dict[str, float] | None = None, topic_shares: dict[str, float] | None = None,
) -> DataFrame:
    """(*carry, id, n, weight, p, kept) for each row."""
    rows = docs.select(
        *carry, F.col(id_col).alias("id"), n_words(text).alias("n"),
        *(F.coalesce(c.cast("string"), F.lit(NONE)).alias(k) for k, c in (("source", F.col(source)), ("lang", F.col(lang)), ("topic", kind_of_text(text) if topic is None else topic))),
    )
    cells = rows.groupBy("source", "lang", "topic").agg(F.sum("n").alias("n"))
    nested = write_shared(cells.where("n > 0").groupBy("source").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "topic", "n")).alias("cells")), "cells")

    def margin(of: DataFrame, key: str, value: Column) -> dict[str, float]:
        found = of.groupBy(key).agg(F.sum(value)).limit(MOST + 1).collect()
        if len(found) > MOST:
            raise ValueError(f"more than {MOST} values of {key}")
        return {k: v for k, v in found}

    if source_shares is None:
        nested = nested.withColumn("share", F.pow("total", F.lit(power)))
    else:
        if isinstance(source_shares, dict):
            source_shares = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in source_shares.items()], "source string, share double")
        nested = nested.join(source_shares.select("source", "share"), "source", "left").na.fill({"share": 0.0})
    flat = nested.select("source", "total", F.inline("cells"))
    langs, topics = margin(flat, "lang", F.col("n")), margin(flat, "topic", F.col("n"))
    kept_names = [c for c in rows.columns if c not in ("source", "lang", "topic")]
    if not langs:
        return rows.select(*kept_names, F.lit(0.0).alias("weight"), F.lit(0.0).alias("p"), F.lit(False).alias("kept"))
    whole = nested.agg(F.sum("share")).first()[0]
    if not whole:
        raise ValueError("no source with a share has tokens")
    aims = {"lang": _aims(lang_shares, langs, power), "topic": _aims(topic_shares, topics, power)}
    factor = {"lang": dict.fromkeys(sorted(langs), 1.0), "topic": dict.fromkeys(sorted(topics), 1.0)}

    def weighted() -> DataFrame:
        """Cells with their factor; that of the source makes its row meet its share."""
        b, c = _literal(factor["lang"]), _literal(factor["topic"])
        inner = F.aggregate("cells", F.lit(0.0), lambda acc, x: acc + x["n"] * F.element_at(b, x["lang"]) * F.element_at(c, x["topic"]))
        return nested.withColumn("a", F.when(inner > 0, F.col("share") / whole / inner).otherwise(0.0)).select("source", "a", F.inline("cells")).withColumn("w", F.col("a") * F.col("n") * F.element_at(b, F.col("lang")) * F.element_at(c, F.col("topic")))

    for _ in range(rounds):
        off = 0.0  # by how much a margin misses its target before its step
        for key in ("lang", "topic"):
            now = margin(weighted(), key, F.col("w"))
            off = max([off, *(abs(now[k] - aims[key].get(k, 0.0)) for k in now)])
            factor[key] = {k: f * (aims[key].get(k, 0.0) / now[k] if now.get(k) else 0.0) for k, f in factor[key].items()}
        if off <= tolerance:
            break
    final = write_shared(weighted().select("source", "lang", "topic", "n", (F.col("w") / F.col("n")).alias("weight")), "weights")

    budget = fraction * sum(langs.values())
    scale = 0.0
    for _ in range(50):  # cells that reach 1 stay there; the others share what is left
        full = F.col("weight") * scale >= 1.0
        spent, open_ = final.agg(F.sum(F.when(full, F.col("n")).otherwise(0)), F.sum(F.when(~full, F.col("n") * F.col("weight")).otherwise(0.0))).first()
        better = (budget - spent) / open_ if open_ else scale
        if abs(better - scale) <= 1e-12 * max(scale, 1.0):
            break
        scale = max(scale, better)
    drawn = F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    out = rows.join(final.drop("n"), ["source", "lang", "topic"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0))).withColumn("p", F.least(F.lit(1.0), F.col("weight") * scale))
    return out.select(*kept_names, "weight", "p", ((F.col("n") > 0) & (drawn < F.col("p"))).alias("kept"))


def mix(docs: DataFrame, topic: Column | None = None, id_col: str = "doc_id", **options) -> DataFrame:
    """(id_col, n_tokens, weight, probability, kept) for each row.

    Targets: each source's share is its tokens to the power `power`, divided by the sum of these; languages and
    topics likewise. Other targets are given by value ("\\0" for null) as source_shares, lang_shares and topic_shares;
    sources, of which there may be many, also as a DataFrame (source, share). Shares are scaled to a sum of 1 over the values
    that have tokens. Raking ends when no margin misses its target by more than `tolerance`, or after `rounds`.

    A document is there once, so a probability stops at 1. Cells that reach it get less than their target, and what they
    leave goes to all others in proportion to their weights.
    """
    out = _drawn(docs, (), topic, id_col, **options)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), "weight", F.col("p").alias("probability"), "kept")


def sample(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that are kept, with all their columns. Rows meet the weights of the cells, no row is shuffled for its id."""
    return _drawn(docs, (F.struct("*").alias("row"),), id_col=id_col, **options).where("kept").select("row.*")
