"""Classification of fields, masks, differential privacy, obligations and budgets."""

from __future__ import annotations

import secrets
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from . import profile

# Sensitivities, least first.
RANKS = ("public", "internal", "confidential", "financial", "pii", "phi", "restricted")
SENSITIVE = ("pii", "phi", "financial", "restricted")


def rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in RANKS]), c)


def classify(df: DataFrame, share: float = 0.3, strict: bool = False) -> DataFrame:
    """(column, pii, sensitivity) for each field: hints of its name first (phi before pii), then its values."""
    found = profile.personal(df, share=share, strict=strict)
    level = F.when(F.col("hint") == "phi", "phi").when(F.col("pii"), "pii").otherwise("internal")
    return found.select("column", "pii", level.alias("sensitivity"))


def merge_classes(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(column, pii, sensitivity) of two classifications of a table: the higher sensitivity, and personal if either says so.

    It fails closed: a sensitivity that isn't known counts as the highest, and a column that only one of them has keeps what that one says.
    """
    both = ours.select("column", "pii", "sensitivity").unionByName(theirs.select("column", "pii", "sensitivity"))
    known = F.when(rank(F.col("sensitivity")) > 0, F.col("sensitivity")).otherwise(RANKS[-1])
    best = F.max(F.struct(rank(known).alias("r"), known.alias("s")))
    return both.groupBy("column").agg(F.bool_or(F.coalesce("pii", F.lit(True))).alias("pii"), best.alias("b")).select("column", "pii", F.col("b.s").alias("sensitivity"))


def governance_board(fields: DataFrame, policies: DataFrame, datasets: DataFrame) -> DataFrame:
    """(level, domain, datasets, pii_fields, masked_by_default, deny_rules, signed, residencies): by domain and in total.

    fields(domain, dataset, column, pii, sensitivity), policies(domain, effect), datasets(domain, dataset, signed, residency). A field is masked by default if it is
    personal; residencies counts the distinct places that datasets are bound to. What each table says is a row of one union, so the levels are one aggregate.
    """
    no = {"pii": F.lit(0), "masked": F.lit(0), "deny": F.lit(0), "signed": F.lit(0), "dataset": F.lit(None).cast("string"), "residency": F.lit(None).cast("string")}
    row = lambda df, **has: df.select("domain", *[has.get(c, v).alias(c) for c, v in no.items()])
    masked = (F.col("pii") | F.col("sensitivity").isin("pii", "phi")).cast("int")
    facts = row(fields, pii=F.col("pii").cast("int"), masked=masked).unionByName(row(policies, deny=(F.col("effect") == "deny").cast("int"))).unionByName(row(datasets, dataset=F.col("dataset"), signed=F.col("signed").cast("int"), residency=F.col("residency")))
    return facts.rollup("domain").agg(
        F.when(F.grouping("domain") == 1, "total").otherwise("domain").alias("level"), F.count("dataset").alias("datasets"), F.sum("pii").alias("pii_fields"), F.sum("masked").alias("masked_by_default"),
        F.sum("deny").alias("deny_rules"), F.sum("signed").alias("signed"), F.count_distinct("residency").alias("residencies"),
    )


def dataset_sensitivity(fields: DataFrame) -> DataFrame:
    """Of (dataset, column, pii, sensitivity): the highest sensitivity of each dataset and whether it is sensitive."""
    best = F.max(F.struct(rank(F.col("sensitivity")).alias("r"), F.col("sensitivity").alias("s")))
    return fields.groupBy("dataset").agg(best.alias("b"), F.bool_or(F.col("pii") | F.col("sensitivity").isin(*SENSITIVE)).alias("sensitive"), F.count_if("pii").alias("pii_fields")).select("dataset", F.col("b.s").alias("sensitivity"), "sensitive", "pii_fields")


def with_facts(df: DataFrame, fields: dict[str, dict]) -> DataFrame:
    """df with governance facts ({"pii": True, ...}) in the metadata of its fields."""
    return df.select(*[F.col(c).alias(c, metadata=df.schema[c].metadata | fields.get(c, {})) for c in df.columns])


def pii_fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.metadata.get("pii")]


def mask(df: DataFrame, fields: Sequence[str], strategy: str = "hash") -> DataFrame:
    """Masked in place. hash: 16 hex digits of the sha256; null: typed nulls."""
    hit = [c for c in fields if c in df.columns]
    if strategy == "null":
        return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in hit})
    return df.withColumns({c: X.mask_hash(F.col(c)) for c in hit})


def aggregate_only(df: DataFrame) -> DataFrame:
    """df itself if it has one row at most."""
    if df.limit(2).count() > 1:
        raise PermissionError("only aggregates of one row may leave")
    return df


def laplace(c: Column, scale: float, u: Column) -> Column:
    """c with noise of this scale; u is even in [0, 1)."""
    u = u - 0.5
    return c - F.lit(scale) * F.signum(u) * F.log(1 - 2 * F.abs(u))


def differential_privacy(df: DataFrame, columns: Sequence[str] | None = None, epsilon: float = 1.0, sensitivity: float | Mapping[str, float] = 1.0, seed: int | None = None) -> DataFrame:
    """Laplace noise on every numeric result column, or on the named ones; refused if there is none, as the exact result would leave.

    Each call draws fresh noise. With a seed, for tests, the noise of a row hangs on the seed and its other columns, so it is
    the same however the rows are dealt. Whole numbers are rounded half to even. sensitivity is how much one person can move a
    result, for all columns or by name (1 where a name is absent): a sum of prices needs the bound of a price.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    columns = [c for c, t in kinds.items() if isinstance(t, T.NumericType)] if columns is None else list(columns)
    if not columns:
        raise PermissionError("no numeric column can carry the noise that is asked for")
    bound = lambda c: sensitivity.get(c, 1.0) if isinstance(sensitivity, Mapping) else sensitivity
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    rest = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    out = {}
    for i, c in enumerate(columns):
        u = F.rand(secrets.randbits(62)) if seed is None else F.pmod(F.xxhash64(*rest, F.lit(seed), F.lit(i)), F.lit(1 << 52)) / float(1 << 52)
        noisy = laplace(F.col(f"`{c}`").cast("double"), bound(c) / epsilon, u)
        out[c] = F.when(F.col(f"`{c}`").isNotNull(), (F.bround(noisy, 0) if isinstance(kinds[c], whole) else noisy).cast(kinds[c]))
    return df.withColumns(out)


def merge_obligations(obligations: DataFrame) -> DataFrame:
    """(request, dataset, kind, epsilon, fields): one row for each kind, with the smallest epsilon and all fields."""
    return obligations.groupBy("request", "dataset", "kind").agg(F.min("epsilon").alias("epsilon"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("fields", F.array().cast("array<string>")))))).alias("fields"))


def apply_obligations(df: DataFrame, obligations: Sequence[dict], seed: int | None = None, noisy: Sequence[str] | None = None) -> DataFrame:
    """In order: mask, aggregate_only, differential_privacy on all numeric columns or on `noisy`. Kinds without an effect on rows are skipped."""
    steps = {
        "mask": lambda d, o: mask(d, o.get("fields", ()), o.get("strategy", "hash")), "aggregate_only": lambda d, o: aggregate_only(d),
        "differential_privacy": lambda d, o: differential_privacy(d, noisy, o.get("epsilon", 1.0), seed=seed),
    }
    return reduce(lambda d, o: steps.get(o["kind"], lambda x, _: x)(d, o), obligations, df)


def refuse_raw(columns: Sequence[str], masked: Sequence[str]) -> None:
    hit = sorted(set(columns) & set(masked))
    if hit:
        raise PermissionError(f"raw personal columns in the result: {', '.join(hit)}")


def budgets(ledger: DataFrame, epsilon: float = 1.0, delta: float = 1e-6) -> DataFrame:
    """Of (subject, dataset, epsilon) spendings: spent and remaining, never below 0."""
    spent = F.sum("epsilon")
    return ledger.groupBy("subject", "dataset").agg(F.count(F.lit(1)).alias("queries"), spent.alias("spent"), F.greatest(F.lit(0.0), F.lit(epsilon) - spent).alias("remaining")).withColumns({"epsilon": F.lit(epsilon), "delta": F.lit(delta)})


def budget_board(log: DataFrame, ledger: DataFrame, epsilon: float = 1.0) -> DataFrame:
    """For each principal and dataset of the query log (subject, datasets array): spent and remaining, if nothing spent the whole."""
    seen = log.select("subject", F.explode("datasets").alias("dataset")).distinct()
    return seen.join(budgets(ledger, epsilon).select("subject", "dataset", "spent", "remaining"), ["subject", "dataset"], "left").na.fill({"spent": 0.0, "remaining": epsilon})
