"""Quality rules. All rules of a table but the referential ones run in one aggregate over one scan; a rule that fails while it runs is found by halving."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import InheritableThread
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: What a failing plan or job raises; errors that Spark doesn't know of come as they are in the JVM.
FAILURES = (PySparkException, Py4JJavaError)


@dataclass(frozen=True)
class Rule:
    """kind: not_null, unique, range, regex, enum, freshness, referential or custom."""

    id: str
    kind: str
    field: str
    params: dict = field(default_factory=dict)
    severity: str = "error"


def _violations(rule: Rule, now: Column) -> Column | None:
    """The aggregate that counts what breaks a rule. Nulls pass all but not_null and unique."""
    c, p = F.col(f"`{rule.field}`"), rule.params
    if rule.kind == "not_null":
        return F.count_if(c.isNull())
    if rule.kind == "unique":
        return F.count(F.lit(1)) - F.count_distinct(c)
    if rule.kind == "range":
        bad = [b for b in (c < p["min"] if p.get("min") is not None else None, c > p["max"] if p.get("max") is not None else None) if b is not None]
        return F.count_if(reduce(lambda a, b: a | b, bad)) if bad else F.lit(0).cast("long")
    if rule.kind == "regex":
        return F.count_if(~c.cast("string").rlike(rf"\A(?:{p['pattern']})\z"))
    if rule.kind == "enum":
        return F.count_if(~c.isin(*p["values"]))
    if rule.kind == "freshness":
        age = F.unix_timestamp(now) - F.unix_timestamp(c.try_cast("timestamp"))
        return F.count_if(age > p.get("max_age_seconds", 86_400))
    if rule.kind == "custom":
        return p["violations"]
    return None


def _measured(df: DataFrame, asked: dict[int, tuple[Column, Column]]) -> dict[int, tuple]:
    """k -> (sampled, violations, passed, message) of the aggregates k -> (sampled, violations), all in one scan.

    If the scan fails the rules are halved and each half is tried again, so that a rule that fails while it runs fails alone; a
    failing rule costs about 2 log n more scans. If the table itself can't be read, that is raised.
    """
    if not asked:
        return {}
    try:
        rows = df.agg(F.array(*[F.struct(F.lit(k).alias("k"), s.cast("long").alias("s"), v.cast("long").alias("v")) for k, (s, v) in asked.items()]).alias("r")).select(F.inline("r")).collect()  # a row a rule
        return {r.k: (r.s, r.v, r.v == 0, "") for r in rows}
    except FAILURES as e:
        if len(asked) == 1:
            df.agg(F.count(F.lit(1))).collect()  # raises if it is the table that fails
            return {k: (0, 1, False, f"rule failed: {_why(e)}") for k in asked}
    half = list(asked.items())
    return _measured(df, dict(half[: len(half) // 2])) | _measured(df, dict(half[len(half) // 2 :]))


def _why(e: Exception) -> str:
    """Spark's error condition, or else the innermost exception."""
    inner = re.findall(r"Caused by: [\w.]*?(\w+)\b(?![.\w])", str(e)) if isinstance(e, Py4JJavaError) else []
    return (e.getCondition() if isinstance(e, PySparkException) else None) or (inner[-1] if inner else type(e).__name__)


def evaluate(df: DataFrame, rules: Sequence[Rule], now: Column | None = None, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """(rule_id, kind, field, severity, sampled, violations, passed, message), a row for each rule. The rules run at once.

    A missing field fails with one violation, and so does a rule that raises, be it while it is read or while it runs; the other rules count as ever. A kind that is not known passes
    with a message. A referential rule {"table", "column"} is an anti join of distinct child values' counts with the parent's keys; without its parent table it fails.
    """
    now = F.current_timestamp() if now is None else now
    asked, found = {}, {}
    for k, rule in enumerate(rules):
        if rule.field not in df.columns:
            found[k] = (0, 1, False, f"field {rule.field} is missing")
            continue
        try:
            if rule.kind == "referential":
                r = _referential(df, rule, parents or {}).first()
                found[k] = (r.sampled, r.violations, r.violations == 0, "")
                continue
            violations = _violations(rule, now)
            if violations is None:
                found[k] = (0, 0, True, f"unknown kind {rule.kind}")
                continue
            df.agg(violations)  # resolves it
        except (*FAILURES, KeyError, TypeError, ValueError) as e:
            found[k] = (0, 1, False, f"rule can't be evaluated: {_why(e)}")
            continue
        asked[k] = (F.count(F.col(f"`{rule.field}`")) if rule.kind == "freshness" else F.count(F.lit(1)), violations)
    found |= _measured(df, asked)
    rows = [(r.id, r.kind, r.field, r.severity, *found[k]) for k, r in enumerate(rules)]
    return df.sparkSession.createDataFrame(rows, "rule_id string, kind string, field string, severity string, sampled long, violations long, passed boolean, message string")


def _referential(df: DataFrame, rule: Rule, parents: dict[str, DataFrame]) -> DataFrame:
    parent = parents[rule.params["table"]].select(F.col(rule.params["column"]).alias("parent")).distinct()
    children = df.groupBy(F.col(f"`{rule.field}`").alias("child")).agg(F.count(F.lit(1)).alias("n"))
    marked = children.join(parent, F.col("child") == F.col("parent"), "left")
    lost = F.col("child").isNotNull() & F.col("parent").isNull()
    return marked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sampled"), F.coalesce(F.sum(F.when(lost, F.col("n"))), F.lit(0)).alias("violations"))


def report(results: DataFrame) -> DataFrame:
    """One row: rules, passed rules, score (share passed; 0 without rules), whether all passed whatever their severity."""
    return results.agg(
        F.count(F.lit(1)).alias("rules"), F.count_if("passed").alias("rules_passed"),
        F.coalesce(F.round(F.avg(F.col("passed").cast("double")), 4), F.lit(0.0)).alias("score"), F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"),
    )


def gate(results: dict[str, DataFrame], least: float = 0.9) -> DataFrame:
    """A row for each dataset with its score, and whether the mean score of all reaches `least`."""
    rows = [r.withColumn("dataset", F.lit(name)) for name, r in results.items()]
    scores = reduce(DataFrame.unionByName, rows).groupBy("dataset").agg(F.round(F.avg(F.col("passed").cast("double")), 4).alias("score"), F.count_if(~F.col("passed")).alias("failed"))
    mean = scores.agg(F.round(F.avg("score"), 4).alias("mean_score"))
    return scores.crossJoin(F.broadcast(mean)).withColumn("ok", F.col("mean_score") >= least)  # one row on the right


@dataclass
class PackReport:
    """The gate of a pack: results of the datasets that were evaluated, why others were skipped, what failed in the rest."""

    results: dict[str, DataFrame]
    skipped: dict[str, str]
    errored: dict[str, str]

    def scores(self, spark: SparkSession) -> DataFrame:
        """(dataset, status, score, failed, message): a row for each dataset; status is passed, failed, skipped or errored."""
        out = [(n, s, None, None, why) for s, group in (("skipped", self.skipped), ("errored", self.errored)) for n, why in group.items()]
        rest = spark.createDataFrame(out, "dataset string, status string, score double, failed long, message string")
        if not self.results:
            return rest
        rows = reduce(DataFrame.unionByName, [r.withColumn("dataset", F.lit(name)) for name, r in self.results.items()])
        failed = F.count_if(~F.col("passed"))
        each = rows.groupBy("dataset").agg(F.when(failed == 0, "passed").otherwise("failed").alias("status"), F.round(F.avg(F.col("passed").cast("double")), 4).alias("score"), failed.alias("failed"), F.lit("").alias("message"))
        return each.unionByName(rest)

    def verdict(self, spark: SparkSession) -> DataFrame:
        """One row (datasets, skipped, errored, mean_score over the evaluated, passed: none errored and all rules of the others kept)."""
        s = self.scores(spark)
        count = lambda what: F.count_if(F.col("status") == what)
        return s.agg(F.count(F.lit(1)).alias("datasets"), count("skipped").alias("skipped"), count("errored").alias("errored"), F.coalesce(F.round(F.avg("score"), 4), F.lit(0.0)).alias("mean_score"), ((count("errored") == 0) & (count("failed") == 0)).alias("passed"))


def gate_pack(
    spark: SparkSession, pack: dict[str, tuple[Callable[[], DataFrame | None], Sequence[Rule]]], now: Column | None = None, parents: dict[str, DataFrame] | None = None, at_once: int = 8, require_data: bool = False
) -> PackReport:
    """All rules of all datasets of a pack: name -> (what loads it, its rules).

    Datasets are jobs that run side by side, `at_once` of them, each in a scheduler pool of its own (fair where spark.scheduler.mode is FAIR), so a large one doesn't hold up
    the small ones. One without data (None) is skipped, or errored if data is required; one that can't be loaded or read is errored, and the others go on.
    """
    report, todo = PackReport({}, {}, {}), list(pack.items())

    def work() -> None:
        while True:
            try:
                name, (load, rules) = todo.pop()
            except IndexError:
                return
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"gate-{name}")
            try:
                df = load()
                if df is None:
                    (report.errored if require_data else report.skipped)[name] = "no data"
                else:
                    report.results[name] = evaluate(df, rules, now, parents)
            except Exception as e:  # whatever a dataset does, it is its own affair
                report.errored[name] = _why(e)

    workers = [InheritableThread(target=work) for _ in range(min(at_once, len(todo)))]
    for w in workers:
        w.start()
    for w in workers:
        w.join()
    return report


CustomRule = Callable[[DataFrame], Column]
