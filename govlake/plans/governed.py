"""Governed SQL: masked views, a guard on columns, noise on aggregates, and an audit row with energy and carbon."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import access, carbon, privacy
from ..sources import tables as stored
from ..streaming.admission import SLACK, Admission, Turns


_logging = threading.Lock()


@dataclass(frozen=True)
class Grant:
    """What authorization left for a query: masked fields, noise (on all numeric result columns unless named), at most one row.

    keys: result columns that may leave without noise though they aren't plain columns of a table. bounds: how much one person can move a result column, 1 unless given.
    """

    masked: Mapping[str, Sequence[str]] = field(default_factory=dict)
    strategy: str = "hash"
    epsilon: float | None = None
    noisy: Sequence[str] | None = None
    one_row: bool = False
    keys: Sequence[str] = ()
    bounds: Mapping[str, float] = field(default_factory=dict)


def _attributes(df: DataFrame) -> list[tuple[str, int]]:
    """(name, id) of the columns that the analyzed plan gives: a column that passes unchanged keeps its id, a computed one has a new one."""
    output = df._jdf.queryExecution().analyzed().output()
    return [(output.apply(i).name(), output.apply(i).exprId().id()) for i in range(output.size())]


def refuse_exact(out: DataFrame, views: Sequence[DataFrame], grant: Grant) -> None:
    """Noise goes on numbers, so whatever else leaves must be a plain column of a table, not a number cast to text or compared.

    Refused besides: any such column of a query with a set operation, whose columns are named after the first part only. `keys` lets others pass.
    """
    plain = {i for v in views for _, i in _attributes(v)}
    sets = re.search(r"(?m)^[\s:+\-]*(Union|Intersect|Except)\b", out._jdf.queryExecution().analyzed().toString())
    computed = [n for (n, i), f in zip(_attributes(out), out.schema.fields, strict=True) if not isinstance(f.dataType, T.NumericType) and n not in grant.keys and (sets or i not in plain)]
    if computed:
        raise PermissionError(f"no noise can be put on {', '.join(sorted(computed))}")


def run(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], grant: Grant | None = None, limit: int | None = None, seed: int | None = None) -> DataFrame:
    """The result of sql over views of the tables, lazily. Masks sit in the views, so an alias can't reach a raw value, and
    Catalyst prunes them like any projection; a result column named like a masked field is refused besides.

    A table is named in braces by its id, dots and all: `FROM {credit.loans}`. Other braces stay as they are. The views are gone once the plan is made.
    """
    grant = grant or Grant()
    prefix = f"governed_{uuid.uuid4().hex[:12]}"
    views = {name: f"{prefix}_{i}" for i, name in enumerate(tables)}
    masked = {name: privacy.mask(df, grant.masked.get(name, ()), grant.strategy) for name, df in tables.items()}
    named = re.sub(r"\{([^{}]*)\}", lambda m: views.get(m[1], m[0]), sql)
    try:
        for name, df in masked.items():
            df.createOrReplaceTempView(views[name])
        out = spark.sql(named)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
    privacy.refuse_raw(out.columns, [c for cs in grant.masked.values() for c in cs])
    if grant.epsilon is not None:
        refuse_exact(out, list(masked.values()), grant)
    if grant.one_row:
        out = privacy.aggregate_only(out)
    if grant.epsilon is not None:
        out = privacy.differential_privacy(out, grant.noisy, grant.epsilon, grant.bounds, seed=seed)
    return out if limit is None else out.limit(limit)


def scanned(spark: SparkSession, out: DataFrame) -> int:
    """Bytes of the files that a result is read from; 0 for tables that aren't files."""
    files = out.inputFiles()
    return stored.byte_size(spark, files).first().bytes if files else 0


def audit(spark: SparkSession, subject: str, sql: str, datasets: Sequence[str], bytes_: int, region: str, status: str = "ok", epsilon: float = 0.0) -> DataFrame:
    """One row for the query log: who, what, status, bytes, energy, carbon, epsilon spent."""
    row = spark.range(1).select(
        F.current_timestamp().alias("at"), F.lit(subject).alias("subject"), F.lit(sql).alias("sql"), F.array(*[F.lit(d) for d in datasets]).alias("datasets"),
        F.lit(status).alias("status"), F.lit(bytes_).cast("long").alias("bytes"), F.lit(region).alias("region"), F.lit(epsilon).alias("epsilon"),
    )
    return carbon.accounted(row)


def grant_of(decisions: Sequence[Row], fields: Mapping[str, Sequence[str]]) -> Grant:
    """What the obligations of all datasets of a query leave: (dataset, obligations) rows, personal fields by dataset."""
    asked = [(r.dataset, *o.partition(":")[::2]) for r in decisions for o in r.obligations]
    return Grant(
        masked={d: list(fields.get(d, ())) for d, kind, _ in asked if kind == "mask"},
        strategy=next((rest for _, kind, rest in asked if kind == "mask"), "hash"),
        epsilon=min((float(rest) for _, kind, rest in asked if kind == "differential_privacy"), default=None),
        one_row=any(kind == "aggregate_only" for _, kind, _ in asked),
    )


def query(
    spark: SparkSession, subject: str, roles: Sequence[str], region: str, sql: str, tables: Mapping[str, DataFrame], datasets: DataFrame, policies: DataFrame, base: str,
    action: str = "query", budget: float = 1.0, epsilon: float = 0.1, limit: int | None = None, bytes_: int | None = None, seed: int | None = None,
    bounds: Mapping[str, float] | None = None, admission: Admission | None = None, **how,
) -> DataFrame:
    """Governed SQL from request to audit: authorize each dataset, plan under the obligations, be admitted against the budget, log.

    tables are by dataset id, as in `datasets` (see access.authorize). Log and ledger are tables below base. Callers of one driver that ask at once take turns
    at the budget, so they can't spend the same rest twice; give an `Admission` where several drivers ask. A plan that is refused spends nothing.
    A refusal is logged as denied and raised as PermissionError: a dataset that may not be used, a raw personal column in
    the result, or an epsilon that the rest of the subject's budget for a dataset doesn't cover. bytes_: what the log says was scanned, measured unless given.
    """
    base = base.rstrip("/")

    def note(status: str, spent: float = 0.0, scan: int = 0) -> None:
        # a folder for each driver, and its callers take turns: writers of one folder disturb each other
        with _logging:
            audit(spark, subject, sql, sorted(tables), scan, region, status, spent).write.mode("append").parquet(f"{base}/log/_driver={spark.sparkContext.applicationId}")

    def refuse(why: str) -> PermissionError:
        note("denied")
        return PermissionError(why)

    row = lambda name: F.struct(*[F.lit(v).alias(c) for c, v in zip(("request", "subject", "region", "jurisdiction", "action", "dataset"), (name, subject, region, region, action, name), strict=True)])
    requests = spark.range(1).select(F.inline(F.array(*[row(name) for name in tables])), F.array(*[F.lit(r) for r in roles]).cast("array<string>").alias("roles"))
    requests = F.broadcast(requests)  # a row a table of the query
    facts = datasets.where(F.col("dataset").isin(*tables))
    personal = facts.select("dataset", F.col("pii_fields").alias("personal"))
    decisions = access.authorize(requests, facts, policies, epsilon=epsilon, **how).join(personal, "dataset", "left").collect()  # a row a table of the query
    denied = [f"{r.dataset}: {r.reason}" for r in decisions if not r.allow]
    if denied:
        raise refuse("; ".join(sorted(denied)))
    grant = grant_of(decisions, {r.dataset: r.personal or [] for r in decisions})
    grant = replace(grant, bounds=bounds or {})
    private = sorted({r.dataset for r in decisions for o in r.obligations if o.startswith("differential_privacy")}) if grant.epsilon is not None else []
    gate = admission or Turns(spark, base, budget)
    if private and gate.spent(subject, private) + grant.epsilon > gate.budget + SLACK:  # no need to plan what can't be admitted
        raise refuse(f"budget spent for {', '.join(private)}")
    try:
        out = run(spark, sql, tables, grant, limit, seed)
    except PermissionError as e:
        raise refuse(str(e)) from e
    if private and not gate.ask(subject, private, grant.epsilon):
        raise refuse(f"budget spent for {', '.join(private)}")
    note("ok", grant.epsilon or 0.0, scanned(spark, out) if bytes_ is None else bytes_)
    return out
