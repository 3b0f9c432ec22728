"""Every registered query of the governance operators with its SQL.

The test tables are clean, so cleaning and quality queries first derive dirt from the key; their SQL does the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import access, carbon, catalog, clean, export, graph, lineage, models, overview, packs, privacy, profile, provenance, quality
from ..operators.quality import Rule
from ..sources import keyed, mixed, readers
from ..sources.landing import Landings
from ..sources.shared import shared_dir
from ..streaming import ingest
from ..streaming.admission import Admission
from ..streaming.topics import Topic
from . import governed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = "2024-02-01 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- dirt derived from keys -------------------------------------------------------------------------------------

SEGMENT_SQL = "CASE WHEN c_custkey % 7 = 0 THEN '  ' || c_mktsegment WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 11 = 0 THEN 'NA' WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END"
BALANCE_SQL = "CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 101 = 0 THEN c_acctbal * 20 ELSE c_acctbal END"
JOINED_SQL = "CASE WHEN c_custkey % 19 = 0 THEN 'unknown' ELSE '20' || lpad(CAST(c_custkey % 24 AS VARCHAR), 2, '0') || '-0' || CAST(1 + c_custkey % 9 AS VARCHAR) || '-1' || CAST(c_custkey % 10 AS VARCHAR) END"
DIRTY = f"dirty AS (SELECT c_custkey, {SEGMENT_SQL} AS segment, {BALANCE_SQL} AS balance, {JOINED_SQL} AS joined FROM customer)"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
MISSING_SQL = "('', 'na', 'n/a', 'null', 'none', 'nan', '-', '--', '?', '.')"


def dirty_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    segment = F.when(k % 7 == 0, F.concat(F.lit("  "), "c_mktsegment")).when(k % 5 == 0, F.lower("c_mktsegment")).when(k % 11 == 0, "NA").when(k % 13 != 0, F.col("c_mktsegment"))
    balance = F.when(k % 17 == 0, None).when(k % 101 == 0, F.col("c_acctbal") * 20).otherwise(F.col("c_acctbal"))
    joined = F.when(k % 19 == 0, "unknown").otherwise(F.concat(F.lit("20"), F.lpad((k % 24).cast("string"), 2, "0"), F.lit("-0"), (1 + k % 9).cast("string"), F.lit("-1"), (k % 10).cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", segment.alias("segment"), balance.alias("balance"), joined.alias("joined"))


# ---- governed SQL, masks, noise ---------------------------------------------------------------------------------


@query("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 2) AS avg_price FROM orders GROUP BY o_orderpriority")
def governed_aggregate(spark, sf_dir):
    sql = "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 2) AS avg_price FROM {orders} GROUP BY o_orderpriority"
    return governed.run(spark, sql, {"orders": table(spark, sf_dir, "orders")}, governed.Grant(masked={"orders": ["o_custkey"]}))


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_discount), 6) AS avg_discount FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_returnflag")
def filtered_aggregate(spark, sf_dir):
    sql = "SELECT l_returnflag, count(*) AS n, round(avg(l_discount), 6) AS avg_discount FROM {lineitem} WHERE l_linestatus = 'O' GROUP BY l_returnflag"
    return governed.run(spark, sql, {"lineitem": table(spark, sf_dir, "lineitem")})


@query("SELECT count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_extendedprice), 4) AS avg_price FROM lineitem")
def global_aggregate(spark, sf_dir):
    sql = "SELECT count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_extendedprice), 4) AS avg_price FROM {lineitem}"
    return governed.run(spark, sql, {"lineitem": table(spark, sf_dir, "lineitem")}, governed.Grant(one_row=True))


@query("SELECT n_name, count(*) AS n, count(DISTINCT substr(sha256(c_name), 1, 16)) AS names FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def governed_join(spark, sf_dir):
    sql = "SELECT n_name, count(*) AS n, count(DISTINCT c_name) AS names FROM {customer} c JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name"
    return governed.run(spark, sql, {"customer": table(spark, sf_dir, "customer"), "nation": table(spark, sf_dir, "nation")}, governed.Grant(masked={"customer": ["c_name"]}))


@query("SELECT c_custkey, substr(sha256(c_name), 1, 16) AS c_name, c_mktsegment FROM customer")
def mask_hash(spark, sf_dir):
    return privacy.mask(table(spark, sf_dir, "customer"), ["c_name"]).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_name, CAST(NULL AS DOUBLE) AS c_acctbal FROM customer")
def mask_null(spark, sf_dir):
    return privacy.mask(table(spark, sf_dir, "customer"), ["c_name", "c_acctbal"], "null").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def dp_exact_base(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, TRUE AS noisy, TRUE AS near FROM orders GROUP BY o_orderstatus")
def dp_aggregate(spark, sf_dir):
    """The exact sums beside whether noise moved them, and by no more than noise of this scale does but once in 10^17."""
    exact = dp_exact_base(spark, sf_dir)
    noise = privacy.differential_privacy(exact, epsilon=1.0).select(F.col("o_orderstatus").alias("s"), F.col("n").alias("m"), F.col("total").alias("t"))
    off = F.abs(F.col("t") - F.col("total"))
    return exact.join(noise, F.col("o_orderstatus") == F.col("s")).select("o_orderstatus", "n", "total", (off > 0).alias("noisy"), ((off < 40) & (F.abs(F.col("m") - F.col("n")) <= 40)).alias("near"))


@query("SELECT * FROM (VALUES ('ann', 'ok', 2), ('ann', 'denied', 3), ('bob', 'ok', 1), ('eve', 'denied', 1)) t(subject, status, calls), (SELECT count(*) AS orders FROM orders)")
def governed_denied(spark, sf_dir):
    """Governed SQL over orders until the budget is spent, and with what may not leave: the log of it all, beside the rows asked about."""
    orders = table(spark, sf_dir, "orders")
    columns = "dataset string, domain string, name string, owner string, code string, place string, residency_required boolean, pii_fields array<string>, sensitive boolean"
    facts = spark.createDataFrame([("orders", "sales", "orders", "boss", "EU", "EU", True, ["o_clerk"], True)], columns)
    none = spark.createDataFrame([], "id string, position int, domain string, datasets array<string>, actions array<string>, roles array<string>, effect string, obligations array<string>")
    base = _scratch(spark)
    count = "SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM {orders} GROUP BY o_orderstatus"
    calls = [("ann", "EU", count, "query"), ("ann", "EU", count, "query"), ("ann", "EU", count, "query"), ("ann", "EU", "SELECT o_clerk FROM {orders}", "query"), ("ann", "EU", count, "read"), ("bob", "EU", count, "query"), ("eve", "US", count, "query")]
    for who, region, sql, action in calls:
        try:
            governed.query(spark, who, ["reader"], region, sql, {"orders": orders}, facts, none, base, action=action, budget=0.25)
        except PermissionError:
            pass  # the log says so
    log = spark.read.parquet(f"{base}/log").groupBy("subject", "status").agg(F.count(F.lit(1)).cast("int").alias("calls"))
    return log.crossJoin(F.broadcast(orders.agg(F.count(F.lit(1)).alias("orders"))))  # one row on the right


@query("""SELECT o_orderstatus, count(*) AS n, count(DISTINCT substr(sha256(o_orderpriority), 1, 16)) AS priorities, TRUE AS measured FROM orders WHERE regexp_matches(o_orderpriority, '^[0-9]{1}-') GROUP BY o_orderstatus""")
def governed_dotted(spark, sf_dir):
    """A dataset by its dotted id, and a pattern with braces; the log knows the bytes of the files that were read."""
    orders = table(spark, sf_dir, "orders")
    sql = "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_orderpriority) AS priorities FROM {credit.loans} WHERE c_like RLIKE '^[0-9]{1}-' GROUP BY o_orderstatus"
    out = governed.run(spark, sql, {"credit.loans": orders.withColumn("c_like", F.col("o_orderpriority"))}, governed.Grant(masked={"credit.loans": ["o_orderpriority"]}))
    return out.withColumn("measured", F.lit(governed.scanned(spark, out) > 0))


@query("""WITH RECURSIVE q AS (SELECT 'user' || (user_id % 40) AS subject, event_type AS dataset, CASE WHEN value > 50 THEN 0.25 ELSE 0.125 END::DOUBLE AS e, row_number() OVER (PARTITION BY user_id % 40, event_type ORDER BY ts, lpad(CAST(event_id AS VARCHAR), 12, '0')) AS i FROM events),
r AS (SELECT subject, dataset, i, least(e, 1) AS e, e <= 1.0 AS ok, CASE WHEN e <= 1.0 THEN e ELSE 0 END AS spent FROM q WHERE i = 1
UNION ALL SELECT q.subject, q.dataset, q.i, q.e, r.spent + q.e <= 1.0, CASE WHEN r.spent + q.e <= 1.0 THEN r.spent + q.e ELSE r.spent END FROM r JOIN q ON q.subject = r.subject AND q.dataset = r.dataset AND q.i = r.i + 1)
SELECT subject, dataset, count(*) AS requests, count(*) FILTER (ok) AS admitted, CAST(max(spent) AS DOUBLE) AS spent FROM r GROUP BY subject, dataset""")
def budget_admission(spark, sf_dir):
    """Every event as a request of its user for its type, decided in order of time against a budget of 1 by the admission stream."""
    from ..operators.graph import cut

    gate = Admission(spark, _scratch(spark), 1.0)
    asked = table(spark, sf_dir, "events").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("request"), F.concat(F.lit("user"), (F.col("user_id") % 40).cast("string")).alias("subject"), F.array("event_type").alias("datasets"),
        F.when(F.col("value") > 50, 0.25).otherwise(0.125).alias("epsilon"), F.col("ts").cast("timestamp").alias("at"),
    )
    gate.send(asked)
    gate.decide()
    return cut(gate.ledger().groupBy("subject", "dataset").agg(F.count(F.lit(1)).alias("requests"), F.count_if("admitted").alias("admitted"), F.sum("epsilon").alias("spent")))


@query("""WITH ledger AS (SELECT 'user' || CAST(user_id % 40 AS VARCHAR) AS subject, event_type AS dataset, CASE WHEN value > 50 THEN 0.25 ELSE 0.125 END AS epsilon FROM events)
SELECT subject, dataset, count(*) AS queries, CAST(sum(epsilon) AS DOUBLE) AS spent, CAST(greatest(0, 10 - sum(epsilon)) AS DOUBLE) AS remaining FROM ledger GROUP BY subject, dataset""")
def budget_ledger(spark, sf_dir):
    ledger = table(spark, sf_dir, "events").select(F.concat(F.lit("user"), (F.col("user_id") % 40).cast("string")).alias("subject"), F.col("event_type").alias("dataset"), F.when(F.col("value") > 50, 0.25).otherwise(0.125).alias("epsilon"))
    return privacy.budgets(ledger, 10.0).select("subject", "dataset", "queries", "spent", "remaining")


@query("""WITH o AS (SELECT c_custkey % 50 AS request, CASE WHEN c_custkey % 3 = 0 THEN 'mask' ELSE 'differential_privacy' END AS kind, CAST(1 + c_custkey % 4 AS DOUBLE) / 4 AS epsilon, c_mktsegment AS f FROM customer)
SELECT request, kind, min(epsilon) AS epsilon, array_to_string(list_sort(list(DISTINCT f)), ',') AS fields FROM o GROUP BY request, kind""")
def obligation_merge(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select((k % 50).alias("request"), F.lit("d").alias("dataset"), F.when(k % 3 == 0, "mask").otherwise("differential_privacy").alias("kind"), ((1 + k % 4).cast("double") / 4).alias("epsilon"), F.array("c_mktsegment").alias("fields"))
    return privacy.merge_obligations(rows).select("request", "kind", "epsilon", F.array_join("fields", ",").alias("fields"))


# ---- quality rules ----------------------------------------------------------------------------------------------


def _quality(name: str, rules: list[Rule], counted: list[tuple[str, str, str]], frame=dirty_customers, source: str = DIRTY + " SELECT * FROM dirty", now: str | None = None):
    """Registers a quality query. counted: (rule id, sampled SQL, violations SQL) over q."""

    def run(spark, sf_dir):
        out = quality.evaluate(frame(spark, sf_dir), rules, F.lit(now).cast("timestamp") if now else None)
        return out.select("rule_id", "sampled", "violations", "passed")

    run.__name__ = name
    rows = " UNION ALL ".join(f"SELECT '{i}' AS rule_id, CAST({s} AS BIGINT) AS sampled, CAST({v} AS BIGINT) AS violations, ({v}) = 0 AS passed FROM q" for i, s, v in counted)
    query(f"WITH {source.replace(' SELECT * FROM dirty', '')}, q AS (SELECT * FROM dirty) {rows}")(run)


def _c(id_, kind, field, violations, sampled="count(*)", **params):
    return Rule(id_, kind, field, params), (id_, sampled, violations)


_RULES = {
    "quality_not_null": [_c("segment_set", "not_null", "segment", "count(*) FILTER (segment IS NULL)"), _c("balance_set", "not_null", "balance", "count(*) FILTER (balance IS NULL)")],
    "quality_unique": [_c("key_once", "unique", "c_custkey", "count(*) - count(DISTINCT c_custkey)"), _c("segment_once", "unique", "segment", "count(*) - count(DISTINCT segment)")],
    "quality_range": [_c("balance_between", "range", "balance", "count(*) FILTER (balance < 0 OR balance > 9000)", min=0, max=9000), _c("balance_above", "range", "balance", "count(*) FILTER (balance < -2000)", min=-2000)],
    "quality_regex": [_c("joined_is_date", "regex", "joined", r"count(*) FILTER (NOT regexp_full_match(joined, '\d{4}-\d{2}-\d{2}'))", pattern=r"\d{4}-\d{2}-\d{2}")],
    "quality_enum": [_c("segment_known", "enum", "segment", "count(*) FILTER (segment NOT IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY'))", values=["AUTOMOBILE", "BUILDING", "MACHINERY"])],
}
for _name, _pairs in _RULES.items():
    _quality(_name, [r for r, _ in _pairs], [s for _, s in _pairs])


@query(f"""SELECT 'recent' AS rule_id, count(ts) AS sampled, count(*) FILTER (epoch(TIMESTAMP '{NOW}') - floor(epoch(ts)) > 1209600) AS violations,
count(*) FILTER (epoch(TIMESTAMP '{NOW}') - floor(epoch(ts)) > 1209600) = 0 AS passed FROM events""")
def quality_freshness(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return quality.evaluate(events, [Rule("recent", "freshness", "ts", {"max_age_seconds": 1_209_600})], F.lit(NOW).cast("timestamp")).select("rule_id", "sampled", "violations", "passed")


@query("""WITH child AS (SELECT CASE WHEN l_orderkey % 97 = 0 THEN l_orderkey + 1000000000 ELSE l_orderkey END AS k FROM lineitem)
SELECT 'order_exists' AS rule_id, count(*) AS sampled, count(*) FILTER (k NOT IN (SELECT o_orderkey FROM orders)) AS violations, count(*) FILTER (k NOT IN (SELECT o_orderkey FROM orders)) = 0 AS passed FROM child""")
def quality_referential(spark, sf_dir):
    k = F.col("l_orderkey")
    child = table(spark, sf_dir, "lineitem").select(F.when(k % 97 == 0, k + 1_000_000_000).otherwise(k).alias("k"))
    rule = Rule("order_exists", "referential", "k", {"table": "orders", "column": "o_orderkey"})
    return quality.evaluate(child, [rule], parents={"orders": table(spark, sf_dir, "orders")}).select("rule_id", "sampled", "violations", "passed")


_ALL = [r for pairs in _RULES.values() for r, _ in pairs] + [Rule("gone", "not_null", "no_such_field"), Rule("odd", "no_such_kind", "segment")]
_PASSED = " + ".join(f"CAST(({v}) = 0 AS BIGINT)" for pairs in _RULES.values() for _, (_, _, v) in pairs)


@query(f"WITH {DIRTY}, n AS (SELECT CAST({_PASSED} + 1 AS BIGINT) AS k FROM dirty) SELECT CAST({len(_ALL)} AS BIGINT) AS rules, k AS rules_passed, round(k / {len(_ALL)}.0::DOUBLE, 4) AS score, k = {len(_ALL)} AS passed FROM n")
def quality_report(spark, sf_dir):
    return quality.report(quality.evaluate(dirty_customers(spark, sf_dir), _ALL))


@query(f"""WITH {DIRTY}, c AS (SELECT count(*) FILTER (segment IS NULL) AS a, count(*) FILTER (balance < 0) AS b FROM dirty)
SELECT 'customers' AS dataset, CASE WHEN a = 0 AND b = 0 THEN 'passed' ELSE 'failed' END AS status, round((CAST(a = 0 AS INT) + CAST(b = 0 AS INT)) / 5.0::DOUBLE, 4) AS score, 3 + CAST(a > 0 AS BIGINT) + CAST(b > 0 AS BIGINT) AS failed FROM c
UNION ALL SELECT 'lines', CASE WHEN bool_and(l_quantity > 0) THEN 'passed' ELSE 'failed' END, CASE WHEN bool_and(l_quantity > 0) THEN 1.0 ELSE 0.5 END, count(*) FILTER (l_quantity <= 0 AND l_orderkey < 0) FROM lineitem
UNION ALL SELECT 'nothing', 'skipped', NULL, NULL UNION ALL SELECT 'unreadable', 'errored', NULL, NULL""")
def quality_pack(spark, sf_dir):
    """A pack: customers with two sound rules and three that fail while they run or for want of a parent, lines with two sound ones, a dataset without data and one that can't be read."""
    customers = [Rule("set", "not_null", "segment"), Rule("bad_pattern", "regex", "segment", {"pattern": "("}), Rule("text_as_number", "range", "segment", {"min": 3}), Rule("orphan", "referential", "c_custkey", {"table": "gone", "column": "k"}), Rule("positive", "range", "balance", {"min": 0})]
    lines = [Rule("quantity", "range", "l_quantity", {"min": 0.0001}), Rule("order_exists", "referential", "l_orderkey", {"table": "orders", "column": "o_orderkey"})]
    pack = {
        "customers": (lambda: dirty_customers(spark, sf_dir), customers), "lines": (lambda: table(spark, sf_dir, "lineitem"), lines),
        "nothing": (lambda: None, customers), "unreadable": (lambda: table(spark, sf_dir, "no_such_table"), lines),
    }
    report = quality.gate_pack(spark, pack, parents={"orders": table(spark, sf_dir, "orders")})
    return report.scores(spark).select("dataset", "status", "score", "failed")


# ---- profile ----------------------------------------------------------------------------------------------------

_S = STRIP.format("segment")
_COUNTS = """SELECT '{c}' AS "column", count(*) AS n, count(*) FILTER ({c} IS NULL) AS null_count, count(*) FILTER (lower({s}) IN {m}) AS blank_count,
count(*) FILTER ({c} <> {s}) AS whitespace_count, CAST(min(length({c})) AS INTEGER) AS min_length, CAST(max(length({c})) AS INTEGER) AS max_length,
count(DISTINCT {s}) FILTER (lower({s}) NOT IN {m}) AS distinct_count, round((count(*) FILTER ({c} IS NULL OR lower({s}) IN {m})) / count(*)::DOUBLE, 4) AS null_fraction FROM dirty"""


@query(f"WITH {DIRTY} " + " UNION ALL ".join(_COUNTS.format(c=c, s=STRIP.format(c), m=MISSING_SQL) for c in ("segment", "joined")))
def profile_counts(spark, sf_dir):
    return profile.counts(dirty_customers(spark, sf_dir), ["segment", "joined"]).select("column", "n", "null_count", "blank_count", "whitespace_count", "min_length", "max_length", "distinct_count", "null_fraction")


@query("""SELECT c AS "column", round(min(v), 4) AS numeric_min, round(max(v), 4) AS numeric_max, round(avg(v), 4) AS numeric_mean FROM
(SELECT 'p_size' AS c, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part) GROUP BY c""")
def profile_numeric(spark, sf_dir):
    return profile.counts(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"]).select("column", F.round("numeric_min", 4).alias("numeric_min"), F.round("numeric_max", 4).alias("numeric_max"), "numeric_mean")


@query("""WITH v AS (SELECT 'l_extendedprice' AS c, l_extendedprice AS v FROM lineitem UNION ALL SELECT 'l_quantity', CASE WHEN l_orderkey % 211 = 0 THEN l_quantity * 9 ELSE l_quantity END FROM lineitem),
q AS (SELECT c, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY c)
SELECT c AS "column", count(*) AS n, round(max(q1), 4) AS q1, round(max(q3), 4) AS q3, count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers FROM v JOIN q USING (c) GROUP BY c""")
def profile_iqr(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("l_quantity", F.when(F.col("l_orderkey") % 211 == 0, F.col("l_quantity") * 9).otherwise(F.col("l_quantity")))
    return profile.iqr_outliers(lines, ["l_extendedprice", "l_quantity"]).select("column", "n", F.round("q1", 4).alias("q1"), F.round("q3", 4).alias("q3"), "outliers")


@query(rf"""WITH {DIRTY}, t AS (SELECT {STRIP.format('joined')} AS s FROM dirty)
SELECT 'joined' AS "column", CASE WHEN avg(CAST(regexp_matches(s, '^\d{{4}}-\d{{2}}-\d{{2}}$') AS INT)) >= 0.9 THEN 'date' ELSE 'string' END AS inferred_type,
round(avg(CAST(regexp_matches(s, '^\d{{4}}-\d{{2}}-\d{{2}}$') AS INT)), 4) AS coercible_fraction FROM t
UNION ALL SELECT 'balance', 'double', 1.0 UNION ALL SELECT 'c_custkey', 'int', 1.0 UNION ALL SELECT 'segment', 'string', 1.0""")
def profile_types(spark, sf_dir):
    return profile.counts(dirty_customers(spark, sf_dir)).select("column", "inferred_type", "coercible_fraction")


@query(f"""WITH {DIRTY}, f AS (SELECT {_S} AS value, count(*) AS n FROM dirty WHERE lower({_S}) NOT IN {MISSING_SQL} GROUP BY 1)
SELECT 'segment' AS "column", value, n, CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS rank FROM f QUALIFY rank <= 5""")
def profile_topk(spark, sf_dir):
    return profile.top_values(profile.frequencies(dirty_customers(spark, sf_dir), ["segment"])).select("column", "value", "n", "rank")


@query(f"""WITH {DIRTY}, f AS (SELECT lower({_S}) AS folded, list_sort(list(DISTINCT {_S})) AS forms FROM dirty WHERE lower({_S}) NOT IN {MISSING_SQL} GROUP BY 1)
SELECT 'segment' AS "column", folded, array_to_string(forms, '|') AS forms FROM f WHERE len(forms) > 1 ORDER BY folded LIMIT 10""")
def profile_near_dup(spark, sf_dir):
    return profile.near_duplicates(profile.frequencies(dirty_customers(spark, sf_dir), ["segment"])).select("column", "folded", F.array_join("forms", "|").alias("forms"))


@query("""SELECT 'p_pack' AS "column", unit FROM (SELECT CASE WHEN p_partkey % 9 = 0 THEN 'kg' ELSE 'CM' END AS unit, count(*) AS n FROM part WHERE p_partkey % 6 <> 0 GROUP BY 1 ORDER BY n DESC LIMIT 1)""")
def embedded_unit(spark, sf_dir):
    return profile.embedded_units(profile.frequencies(packed_parts(spark, sf_dir), ["p_pack"])).select("column", "unit")


def packed_parts(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    packed = F.when(k % 6 == 0, "n/k").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" "), F.when(k % 9 == 0, "kg").otherwise("CM")))
    return table(spark, sf_dir, "part").select("p_partkey", packed.alias("p_pack"), "p_brand")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_size AS DOUBLE) END AS p_pack_value,
CASE WHEN p_partkey % 6 <> 0 THEN CASE WHEN p_partkey % 9 = 0 THEN 'kg' ELSE 'CM' END END AS p_pack_unit, p_brand FROM part""")
def split_unit(spark, sf_dir):
    return clean.split_unit(packed_parts(spark, sf_dir), ["p_pack"])


@query("WITH d AS (SELECT * FROM supplier UNION ALL SELECT * FROM supplier WHERE s_suppkey % 3 = 0) SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicates FROM d")
def duplicate_rows(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return profile.duplicate_rows(s.unionByName(s.where("s_suppkey % 3 = 0")))


@query()
def table_assessment(spark, sf_dir):
    return profile.assess(dirty_customers(spark, sf_dir))


@query()
def table_summary(spark, sf_dir):
    df = dirty_customers(spark, sf_dir)
    return profile.summary(profile.assess(df), profile.duplicate_rows(df))


# ---- cleaning ---------------------------------------------------------------------------------------------------


@query(f"WITH {DIRTY} SELECT c_custkey, {_S} AS segment FROM dirty")
def clean_trim(spark, sf_dir):
    return clean.trim(dirty_customers(spark, sf_dir), ["segment"]).select("c_custkey", "segment")


@query(r"SELECT doc_id, md5(trim(regexp_replace('  ' || replace(text, ' ', '  ') || chr(9), '\s+', ' ', 'g'))) AS text_md5 FROM documents")
def clean_collapse_ws(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("  ")), F.lit("\t")).alias("text"))
    return clean.collapse_ws(docs, ["text"]).select("doc_id", F.md5("text").alias("text_md5"))


@query(f"WITH {DIRTY} SELECT c_custkey, CASE WHEN lower({_S}) NOT IN {MISSING_SQL} THEN segment END AS segment FROM dirty")
def clean_empty_to_null(spark, sf_dir):
    return clean.empty_to_null(dirty_customers(spark, sf_dir), ["segment"]).select("c_custkey", "segment")


@query(f"WITH {DIRTY} SELECT c_custkey, upper(segment) AS segment FROM dirty")
def clean_case(spark, sf_dir):
    return clean.standardize_case(dirty_customers(spark, sf_dir), ["segment"], "upper").select("c_custkey", "segment")


@query(f"""WITH {DIRTY}, f AS (SELECT lower({_S}) AS folded, {_S} AS form, count(*) AS n FROM dirty WHERE segment IS NOT NULL GROUP BY 1, 2),
best AS (SELECT folded, form FROM f QUALIFY row_number() OVER (PARTITION BY folded ORDER BY n DESC, form) = 1)
SELECT c_custkey, form AS segment FROM dirty LEFT JOIN best ON lower({_S}) = folded""")
def clean_normalize_category(spark, sf_dir):
    return clean.normalize_category(dirty_customers(spark, sf_dir), ["segment"]).select("c_custkey", "segment")


@query(rf"WITH {DIRTY} SELECT c_custkey, CASE WHEN regexp_matches(joined, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN TRY_CAST(joined AS DATE) END AS joined FROM dirty")
def clean_coerce(spark, sf_dir):
    return clean.coerce_type(dirty_customers(spark, sf_dir), {"joined": "date"}).select("c_custkey", "joined")


@query("SELECT DISTINCT s_nationkey, s_suppkey % 4 AS k FROM supplier")
def clean_dedupe(spark, sf_dir):
    return clean.dedupe_rows(table(spark, sf_dir, "supplier").select("s_nationkey", (F.col("s_suppkey") % 4).alias("k")))


def _impute(strategy: str, sql: str, value=None):
    def run(spark, sf_dir):
        out = clean.impute(dirty_customers(spark, sf_dir), ["balance"], strategy, value)
        return out.select("c_custkey", F.round("balance", 4).alias("balance"))

    run.__name__ = f"clean_impute_{strategy}"
    query(f"WITH {DIRTY} SELECT c_custkey, round(coalesce(balance, {sql}), 4) AS balance FROM dirty")(run)


_impute("mean", "(SELECT avg(balance) FROM dirty)")
_impute("median", "(SELECT quantile_cont(balance, 0.5) FROM dirty)")
_impute("mode", "(SELECT balance FROM dirty WHERE balance IS NOT NULL GROUP BY balance ORDER BY count(*) DESC, balance LIMIT 1)")
_impute("constant", "-1.0", -1)

_FENCES = f"WITH {DIRTY}, q AS (SELECT quantile_cont(balance, 0.25) AS q1, quantile_cont(balance, 0.75) AS q3 FROM dirty)"


@query(f"{_FENCES} SELECT c_custkey, round(least(greatest(balance, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) + CASE WHEN balance IS NULL THEN NULL ELSE 0 END, 4) AS balance FROM dirty, q")
def clean_clip(spark, sf_dir):
    return clean.clip_outliers(dirty_customers(spark, sf_dir), ["balance"]).select("c_custkey", F.round("balance", 4).alias("balance"))


@query(f"{_FENCES} SELECT c_custkey, coalesce(balance < q1 - 1.5 * (q3 - q1) OR balance > q3 + 1.5 * (q3 - q1), FALSE) AS balance__outlier FROM dirty, q")
def clean_flag(spark, sf_dir):
    return clean.flag_outliers(dirty_customers(spark, sf_dir), ["balance"]).select("c_custkey", "balance__outlier")


@query(f"WITH {DIRTY} SELECT round(((count(c_custkey) + count(segment) + count(balance) + count(joined)) / count(*)::DOUBLE + 8) / 12, 4) AS score FROM dirty")
def clean_score(spark, sf_dir):
    return clean.score(dirty_customers(spark, sf_dir))


@query(rf"""WITH {DIRTY}, t AS (SELECT DISTINCT c_custkey, lower({_S}) AS s, CASE WHEN regexp_matches(joined, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN TRY_CAST(joined AS DATE) END AS joined FROM dirty)
SELECT c_custkey, CASE WHEN s NOT IN {MISSING_SQL} THEN s END AS segment, joined FROM t""")
def clean_plan(spark, sf_dir):
    plan = [clean.Step("trim", ("segment",)), clean.Step("empty_to_null", ("segment",)), clean.Step("standardize_case", ("segment",), {"case": "lower"}), clean.Step("normalize_category", ("segment",)), clean.Step("coerce_type", ("joined",), {"types": {"joined": "date"}}), clean.Step("dedupe_rows")]
    return clean.apply_plan(dirty_customers(spark, sf_dir), plan).data.select("c_custkey", "segment", "joined")


_AUDITED = f"""{DIRTY}, b AS (SELECT *, CASE WHEN c_custkey % 4 = 0 THEN 'two  blanks' ELSE 'one blank' END AS note, CASE WHEN c_custkey % 6 = 0 THEN 'n/k' ELSE c_custkey % 50 || ' KG' END AS pack FROM dirty),
d AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE c_custkey % 10 = 0), t AS (SELECT *, {_S} AS s FROM d), e AS (SELECT *, CASE WHEN lower(s) NOT IN {MISSING_SQL} THEN s END AS seg FROM t),
f AS (SELECT lower(seg) AS folded, seg AS form FROM e WHERE seg IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY lower(seg) ORDER BY count(*) DESC, seg) = 1),
n AS (SELECT e.*, form FROM e LEFT JOIN f ON lower(seg) = folded), m AS (SELECT *, coalesce(balance, (SELECT avg(balance) FROM n)) AS filled FROM n), q AS (SELECT quantile_cont(filled, 0.25) AS q1, quantile_cont(filled, 0.75) AS q3 FROM m),
o AS (SELECT count(*) FILTER (filled < q1 - 1.5 * (q3 - q1) OR filled > q3 + 1.5 * (q3 - q1)) AS out FROM m, q)"""
_AUDIT_COUNTS = [
    ("trim", "count(*) FILTER (segment <> s)", "t"), ("collapse_ws", "count(*) FILTER (c_custkey % 4 = 0)", "d"), ("empty_to_null", "count(*) FILTER (s IS NOT NULL AND seg IS NULL)", "e"),
    ("normalize_category", "count(*) FILTER (form <> seg)", "n"), ("standardize_case", "count(*) FILTER (lower(form) <> form)", "n"), ("split_unit", "count(*) FILTER (c_custkey % 6 <> 0)", "d"),
    ("coerce_type", "count(*) FILTER (joined = 'unknown')", "d"), ("impute", "count(*) FILTER (balance IS NULL)", "d"), ("flag_outliers", "max(out)", "o"), ("clip_outliers", "max(out)", "o"), ("dedupe_rows", "0 * count(*)", "d"), ("drop_empty_columns", "0 * count(*)", "d"),
]
_AUDIT_PLAN = [
    clean.Step("trim", ("segment",)), clean.Step("collapse_ws", ("note",)), clean.Step("empty_to_null", ("segment",)), clean.Step("normalize_category", ("segment",)), clean.Step("standardize_case", ("segment",), {"case": "lower"}), clean.Step("split_unit", ("pack",)),
    clean.Step("coerce_type", ("joined",), {"types": {"joined": "date"}}), clean.Step("impute", ("balance",), {"strategy": "mean"}), clean.Step("flag_outliers", ("balance",)), clean.Step("clip_outliers", ("balance",)), clean.Step("dedupe_rows"), clean.Step("drop_empty_columns"),
]


def audited_customers(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    rows = dirty_customers(spark, sf_dir).withColumn("note", F.when(k % 4 == 0, "two  blanks").otherwise("one blank")).withColumn("pack", F.when(k % 6 == 0, "n/k").otherwise(F.concat((k % 50).cast("string"), F.lit(" KG")))).withColumn("empty", F.lit(None).cast("string"))
    return rows.unionByName(rows.where(k % 10 == 0))


@query(f"WITH {_AUDITED} " + " UNION ALL ".join(f"SELECT {i + 1} AS step, '{op}' AS op, CAST({n} AS BIGINT) AS cells_changed, CAST({'count(*) FILTER (c_custkey % 10 = 0) // 2' if op == 'dedupe_rows' else '0 * max(1)'} AS BIGINT) AS rows_removed FROM {t}" for i, (op, n, t) in enumerate(_AUDIT_COUNTS)))
def clean_audit(spark, sf_dir):
    """What each of the twelve steps did, as observed in the one pass that the cleaned rows were written in."""
    done = clean.apply_plan(audited_customers(spark, sf_dir), _AUDIT_PLAN)
    done.data.write.format("noop").mode("overwrite").save()
    rows = [(i + 1, a["op"], a["cells_changed"], a["rows_removed"]) for i, a in enumerate(done.audit())]
    return spark.createDataFrame(rows, "step int, op string, cells_changed long, rows_removed long")


@query(f"WITH {_AUDITED} " + " UNION ALL ".join(
    f"SELECT {i + 1} AS step, '{op}' AS op, CAST({'count(*) FILTER (c_custkey % 10 = 0) // 2' if op == 'dedupe_rows' else '0 * max(1)' if op in ('split_unit', 'flag_outliers') else n} AS BIGINT) AS removed, CAST({'0 * max(1)' if op in ('split_unit', 'flag_outliers', 'dedupe_rows') else n} AS BIGINT) AS added FROM {t}"
    for i, (op, n, t) in enumerate(_AUDIT_COUNTS)
))
def clean_differences(spark, sf_dir):
    """How each of the twelve steps changed the bag of rows, by fingerprints that count +1 before and -1 after it."""
    return clean.step_differences(audited_customers(spark, sf_dir), _AUDIT_PLAN)


# ---- personal data ----------------------------------------------------------------------------------------------

_PII_SQL = r"""regexp_matches({0}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}') OR regexp_matches({0}, '\b\d{{3}}-\d{{2}}-\d{{4}}\b') OR regexp_matches({0}, '(^|[^0-9])(\+?[0-9][0-9\s().-]{{7,}}[0-9])($|[^0-9])')"""


@query(" UNION ALL ".join(f"SELECT '{t}' AS dataset, count(*) AS n, count(*) FILTER ({_PII_SQL.format('text')}) AS hits FROM {t}" for t in ("documents", "conversations", "benchmark")))
def pii_value_scan(spark, sf_dir):
    def one(name):
        return table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n"), F.count_if(X.looks_personal(F.col("text"))).alias("hits")).select(F.lit(name).alias("dataset"), "n", "hits")

    return one("documents").unionByName(one("conversations")).unionByName(one("benchmark"))


@query("""SELECT "column", hint, hint IS NOT NULL AS pii FROM (VALUES ('c_custkey', NULL), ('c_name', 'pii'), ('c_nationkey', NULL), ('c_acctbal', NULL), ('c_mktsegment', NULL)) t("column", hint) WHERE (SELECT count(*) FROM customer) >= 0""")
def pii_name_hints(spark, sf_dir):
    return profile.personal(table(spark, sf_dir, "customer")).select("column", "hint", "pii")


# ---- models -----------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS d, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, round(abs(value - m) / d, 6) AS anomaly_score, abs(value - m) / d > 3 OR value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS is_anomaly FROM events, s""")
def anomaly_zscore_iqr(spark, sf_dir):
    return models.anomalies(table(spark, sf_dir, "events"), ["value"]).select("event_id", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly")


@query("""WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1), d AS (SELECT event_type, median(abs(value - med)) AS mad FROM events JOIN m USING (event_type) GROUP BY 1)
SELECT event_id, round(0.6745 * (value - med) / mad, 6) AS robust_z, abs(0.6745 * (value - med) / mad) > 3.5 AS is_anomaly FROM events JOIN m USING (event_type) JOIN d USING (event_type)""")
def anomaly_robust_z(spark, sf_dir):
    return models.robust_z(table(spark, sf_dir, "events"), "value", ["event_type"]).select("event_id", F.round("robust_z", 6).alias("robust_z"), "is_anomaly")


@query(ORACLES["anomaly_robust_z"])
def model_by_reference(spark, sf_dir):
    """robust_z built from a spec row, saved, loaded and run by its reference."""
    specs = spark.createDataFrame([("odd", "anomaly", {"field": "value", "group_by": "event_type", "threshold": "3.5"})], "id string, task string, params map<string,string>")
    path = _scratch(spark)
    packs.Pack.from_specs("events", specs).save(path)
    loaded = packs.Pack("events")
    loaded.load(path, {"odd": packs.RobustZ})
    model = packs.resolve("pack://events/pack.py#odd", {"events": loaded})
    return model.transform(table(spark, sf_dir, "events")).select("event_id", F.round("robust_z", 6).alias("robust_z"), "is_anomaly")


@query("""WITH l AS (SELECT user_id, arg_max(value, (ts, event_id)) AS forecast FROM events GROUP BY 1) SELECT user_id, CAST(step AS INTEGER) AS step, forecast FROM l, range(1, 4) r(step)""")
def forecast_last(spark, sf_dir):
    return models.forecast_last(table(spark, sf_dir, "events"), "value", ["user_id"], ["ts", "event_id"], 3)


@query("""WITH x AS (SELECT user_id, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS x FROM events),
l AS (SELECT user_id, count(*) AS n, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, max(y) AS single FROM x GROUP BY 1)
SELECT user_id, CAST(step AS INTEGER) AS step, round(least(greatest(CASE WHEN n = 1 THEN single ELSE b + a * (n - 1 + step) END, 0), 180), 6) AS forecast FROM l, range(1, 4) r(step)""")
def forecast_trend(spark, sf_dir):
    return models.forecast_trend(table(spark, sf_dir, "events"), "value", ["user_id"], ["ts", "event_id"], 3).select("user_id", "step", F.round("forecast", 6).alias("forecast"))


@query("""SELECT o_orderkey, round(1 / (1 + exp(-(-1.6 + 1.15 * ln(1 + greatest(c_acctbal, 0) / greatest(o_totalprice, 1))))), 9) AS score FROM orders JOIN customer ON o_custkey = c_custkey""")
def risk_score(spark, sf_dir):
    models.refuse_protected(["c_acctbal", "o_totalprice"])
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.select("o_orderkey", F.round(models.risk_score(F.col("c_acctbal"), F.col("o_totalprice")), 9).alias("score"))


@query("SELECT o_orderkey, round((SELECT avg(o_totalprice) FROM orders), 4) AS baseline_prediction FROM orders")
def predict_mean(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return models.predict_mean(orders.select("o_totalprice", "o_orderkey"), "baseline").select("o_orderkey", F.round("baseline_prediction", 4).alias("baseline_prediction"))


@query("""WITH u AS (SELECT event_type, user_id % 7 AS node, avg(value) AS w, count(*) AS s FROM events GROUP BY 1, 2), t AS (SELECT sum(s) AS total FROM u)
SELECT event_type AS name, round(sum(w * s) / max(total), 6) AS value FROM u, t GROUP BY 1""")
def fedavg(spark, sf_dir):
    updates = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 7).alias("node")).agg(F.avg("value").alias("w"), F.count(F.lit(1)).alias("samples"))
    return models.federated_average(updates.select(F.create_map("event_type", "w").alias("weights"), "samples")).select("name", F.round("value", 6).alias("value"))


# ---- entities and lineage ---------------------------------------------------------------------------------------


def _entities(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Regions, nations and suppliers as entities with aliases, and what ties them as relations."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    e = region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit("region").alias("type"), F.lit("shared").alias("domain"), F.col("r_name").alias("label"), F.col("r_regionkey").cast("long").alias("seq"))
    e = e.unionByName(nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("nation").alias("type"), F.lit("geo").alias("domain"), F.col("n_name").alias("label"), (F.col("n_nationkey") + 100).cast("long").alias("seq")))
    e = e.unionByName(supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("supplier").alias("type"), F.lit("trade").alias("domain"), F.col("s_name").alias("label"), (F.col("s_suppkey") + 10_000).alias("seq")))
    r = nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"), F.lit("in").alias("type"))
    r = r.unionByName(supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst"), F.lit("from").alias("type")))
    return e.withColumn("aliases", F.array(F.reverse("label"))), r


_ENTITIES_SQL = """e AS (SELECT 'r' || r_regionkey AS id, 'region' AS type, 'shared' AS domain, r_name AS label, CAST(r_regionkey AS BIGINT) AS seq FROM region
UNION ALL SELECT 'n' || n_nationkey, 'nation', 'geo', n_name, n_nationkey + 100 FROM nation UNION ALL SELECT 's' || s_suppkey, 'supplier', 'trade', s_name, s_suppkey + 10000 FROM supplier),
r AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'in' AS type FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'from' FROM supplier)"""


@query(f"""WITH {_ENTITIES_SQL}, t AS (SELECT DISTINCT id, seq, lower(trim(x)) AS token FROM (SELECT id, seq, unnest([id, label, reverse(label)]) AS x FROM e)), i AS (SELECT token, arg_min(id, seq) AS id FROM t GROUP BY token),
m AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN ' ' || upper(n_name) WHEN c_custkey % 3 = 1 THEN reverse(n_name) ELSE c_name END AS mention FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT mention, coalesce(id, mention) AS resolved, id IS NOT NULL AS known FROM m LEFT JOIN i ON lower(trim(mention)) = token""")
def entity_resolve(spark, sf_dir):
    entities, _ = _entities(spark, sf_dir)
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    mentions = both.select(F.when(k % 3 == 0, F.concat(F.lit(" "), F.upper("n_name"))).when(k % 3 == 1, F.reverse("n_name")).otherwise(F.col("c_name")).alias("mention")).distinct()
    return graph.resolve(mentions, graph.alias_index(entities))


@query(f"""WITH RECURSIVE {_ENTITIES_SQL}, p AS (SELECT src, dst FROM r UNION SELECT dst, src FROM r),
w AS (SELECT id AS start, id AS node, 0 AS d FROM e WHERE type = 'region' UNION SELECT start, dst, d + 1 FROM w JOIN p ON node = src WHERE d < 2)
SELECT start, node, CAST(min(d) AS INTEGER) AS distance FROM w GROUP BY start, node HAVING min(d) > 0""")
def graph_neighbors(spark, sf_dir):
    entities, relations = _entities(spark, sf_dir)
    return graph.walk(relations, entities.where("type = 'region'").select(F.col("id").alias("start")), 2)


@query(f"WITH {_ENTITIES_SQL} SELECT src, dst, a.domain AS src_domain, b.domain AS dst_domain FROM r JOIN e a ON src = a.id JOIN e b ON dst = b.id WHERE a.domain <> b.domain AND a.domain <> 'shared' AND b.domain <> 'shared'")
def graph_cross_links(spark, sf_dir):
    entities, relations = _entities(spark, sf_dir)
    return graph.cross_domain(relations, entities).select("src", "dst", "src_domain", "dst_domain")


@query(f"WITH {_ENTITIES_SQL}, d AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM r UNION ALL SELECT dst FROM r) GROUP BY id) SELECT type, count(*) AS entities, CAST(coalesce(sum(d), 0) AS BIGINT) AS degree FROM e LEFT JOIN d USING (id) GROUP BY type")
def graph_roll_up(spark, sf_dir):
    return graph.roll_up(*_entities(spark, sf_dir))


@query("""WITH u AS (SELECT c_custkey AS k, 0 AS seq, c_acctbal AS amount, 'opened' AS what FROM customer UNION ALL SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM orders)
SELECT k, max(seq) AS seq, arg_max(amount, seq) AS amount, arg_max(what, seq) AS what FROM u GROUP BY k""")
def keyed_upsert(spark, sf_dir):
    """Customers and then their orders upserted by customer in three batches that come out of order: the latest order of each is left."""
    state = keyed.create(spark, _scratch(spark), "k long, seq long, amount double, what string", ["k"], buckets=8)
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("what"))
    late, first = orders.where("seq % 2 = 0"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(0).alias("seq"), F.col("c_acctbal").alias("amount"), F.lit("opened").alias("what"))
    for batch in (orders.where("seq % 2 = 1"), first, late):
        state.upsert(batch)
    return keyed.open_table(spark, state.path).read()


@query("""WITH n AS (SELECT 'p' || p_partkey AS id, p_partkey AS seq, 'part' || p_partkey AS label, [p_brand || '/' || p_size, upper(p_type)] AS aliases FROM part
UNION ALL SELECT 'p' || p_partkey, p_partkey + 1000000, 'Renamed ' || p_partkey, [p_type || '!'] FROM part WHERE p_partkey % 3 = 0),
t AS (SELECT id, seq, lower(trim(unnest(list_concat([id, label], aliases)))) AS token FROM n), f AS (SELECT token, arg_min(id, (seq, id)) AS id FROM t GROUP BY token)
SELECT token, f.id, arg_max(label, seq) AS label FROM f JOIN n USING (id) GROUP BY token, f.id""")
def entity_upsert(spark, sf_dir):
    """Parts as entities in three batches, a third of them renamed: every name ever written with its first writer, and the label that one has now."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    key = k.cast("string")
    first = part.select(F.concat(F.lit("p"), key).alias("id"), k.alias("seq"), F.concat(F.lit("part"), key).alias("label"), F.array(F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")), F.upper("p_type")).alias("aliases"))
    again = part.where(k % 3 == 0).select(F.concat(F.lit("p"), key).alias("id"), (k + 1_000_000).alias("seq"), F.concat(F.lit("Renamed "), key).alias("label"), F.array(F.concat("p_type", F.lit("!"))).alias("aliases"))
    g = graph.store(spark, _scratch(spark), buckets=8)
    for batch in (first.where("seq % 2 = 0"), again, first.where("seq % 2 = 1")):
        graph.upsert_entities(g, batch)
    return g.aliases.read().select("token", "id").join(g.entities.read().select("id", "label"), "id").select("token", "id", "label")


@query("""SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, 'holds' AS type, max(CAST(CAST(l_shipdate AS DATE) AS VARCHAR) || '|' || l_linenumber) AS properties FROM lineitem GROUP BY ALL""")
def relation_upsert(spark, sf_dir):
    """Which order holds which part, upserted line by line in two batches: one relation for both ends and type, with what the line shipped last says."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("holds").alias("type"),
        F.concat_ws("|", F.to_date("l_shipdate").cast("string"), F.col("l_linenumber").cast("string")).alias("properties"), (F.unix_date(F.to_date("l_shipdate")).cast("long") * 8 + F.col("l_linenumber")).alias("seq"),
    )
    g = graph.store(spark, _scratch(spark), buckets=8)
    for batch in (lines.where("seq % 8 > 3"), lines.where("seq % 8 <= 3")):
        graph.upsert_relations(g, batch)
    return g.relations.read().select("src", "dst", "type", "properties")


def _lineage(spark, sf_dir) -> DataFrame:
    """Each document flows from its source to its language, and on to a shard: edges that Spark derives from the table."""
    docs = table(spark, sf_dir, "documents")
    shard = F.concat(F.lit("shard"), (F.col("doc_id") % 6).cast("string"))
    first = docs.select(F.concat(F.lit("raw/"), "source").alias("src"), F.concat(F.lit("lang/"), "lang").alias("dst"))
    return first.unionByName(docs.select(F.concat(F.lit("lang/"), "lang").alias("src"), shard.alias("dst"))).unionByName(docs.select(shard.alias("src"), F.lit("corpus").alias("dst"))).distinct().withColumn("type", F.lit("flow"))


_LINEAGE_SQL = "r AS (SELECT DISTINCT 'raw/' || source AS src, 'lang/' || lang AS dst FROM documents UNION SELECT 'lang/' || lang, 'shard' || (doc_id % 6) FROM documents UNION SELECT 'shard' || (doc_id % 6), 'corpus' FROM documents)"


@query(f"""WITH RECURSIVE {_LINEAGE_SQL}, p AS (SELECT src, dst FROM r UNION SELECT dst, src FROM r),
w AS (SELECT 'corpus' AS start, 'corpus' AS node, 0 AS d UNION SELECT start, dst, d + 1 FROM w JOIN p ON node = src WHERE d < 3) SELECT start, node, CAST(min(d) AS INTEGER) AS distance FROM w GROUP BY ALL HAVING min(d) > 0""")
def lineage_walk(spark, sf_dir):
    return lineage.lineage(_lineage(spark, sf_dir), spark.range(1).select(F.lit("corpus").alias("start")), 3)


@query(f"""WITH RECURSIVE {_LINEAGE_SQL}, w AS (SELECT src AS node, 0 AS d FROM r WHERE src NOT IN (SELECT dst FROM r) UNION SELECT dst, d + 1 FROM w JOIN r ON node = src) SELECT node, CAST(max(d) AS INTEGER) AS depth FROM w GROUP BY node""")
def lineage_depth(spark, sf_dir):
    return lineage.depths(_lineage(spark, sf_dir))


@query(f"""WITH {_LINEAGE_SQL}, d AS (SELECT DISTINCT 'raw/' || source AS dataset FROM documents UNION SELECT DISTINCT 'events/' || event_type FROM events), t AS (SELECT src AS n FROM r UNION SELECT dst FROM r)
SELECT count(*) AS datasets, count(n) AS covered, round(count(n) / count(*)::DOUBLE, 4) AS coverage FROM d LEFT JOIN t ON dataset = n""")
def lineage_coverage(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select(F.concat(F.lit("raw/"), "source").alias("dataset")).union(table(spark, sf_dir, "events").select(F.concat(F.lit("events/"), "event_type")))
    return lineage.coverage(names, _lineage(spark, sf_dir))


# ---- access -----------------------------------------------------------------------------------------------------


def _requests(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    role = F.when(k % 23 == 0, "superadmin").when(k % 5 == 0, "owner").when(k % 3 == 0, "analyst").otherwise("reader")
    actions = F.array(*[F.lit(a) for a in ("read", "query", "export", "write", "sample")])
    return table(spark, sf_dir, "customer").select(
        k.alias("request"), F.col("c_name").alias("subject"), F.array(role).alias("roles"), F.when(k % 4 == 0, "US").otherwise("EU").alias("region"), F.when(k % 4 == 0, "US").otherwise("EU").alias("jurisdiction"),
        F.element_at(actions, (k % 5 + 1).cast("int")).alias("action"), F.when(k % 2 == 0, "credit.loans").otherwise("open.plumes").alias("dataset"),
    )


def _datasets(spark) -> DataFrame:
    rows = [("credit.loans", "credit", "loans", "nobody", "EU", "eu-north", True, ["email"], True), ("open.plumes", "open", "plumes", "nobody", "GLOBAL", "any", False, [], False)]
    return spark.createDataFrame(rows, "dataset string, domain string, name string, owner string, code string, place string, residency_required boolean, pii_fields array<string>, sensitive boolean")


def _policies(spark) -> DataFrame:
    rows = [("p1", 1, "credit", ["loan*"], ["query"], ["analyst"], "allow", ["watermark"]), ("p2", 2, "credit", ["*"], ["export"], ["reader"], "deny", []), ("p3", 3, "credit", ["loans"], ["query"], ["*"], "allow", ["note"])]
    return spark.createDataFrame(rows, "id string, position int, domain string, datasets array<string>, actions array<string>, roles array<string>, effect string, obligations array<string>")


_ACCESS_SQL = """q AS (SELECT c_custkey AS request, CASE WHEN c_custkey % 23 = 0 THEN 'superadmin' WHEN c_custkey % 5 = 0 THEN 'owner' WHEN c_custkey % 3 = 0 THEN 'analyst' ELSE 'reader' END AS role,
CASE WHEN c_custkey % 4 = 0 THEN 'US' ELSE 'EU' END AS region, ['read', 'query', 'export', 'write', 'sample'][c_custkey % 5 + 1] AS action, c_custkey % 2 = 0 AS loans FROM customer)"""


@query(f"""WITH {_ACCESS_SQL} SELECT request, CASE WHEN action = 'export' AND role = 'reader' THEN 'p2' ELSE 'p3' END AS policy_id, CASE WHEN action = 'export' THEN 'deny' ELSE 'allow' END AS effect FROM q
WHERE loans AND (action = 'query' OR (action = 'export' AND role = 'reader'))""")
def policy_match(spark, sf_dir):
    rows = _requests(spark, sf_dir).join(_datasets(spark), "dataset")
    return access.match_policies(rows, _policies(spark)).select("request", "policy_id", "effect")


@query(f"""WITH {_ACCESS_SQL} SELECT request, CASE WHEN role = 'superadmin' THEN TRUE WHEN loans AND region = 'US' THEN FALSE WHEN loans AND action = 'export' AND role = 'reader' THEN FALSE
WHEN action = 'write' AND role <> 'owner' THEN FALSE WHEN loans AND action IN ('read', 'export') AND role <> 'owner' THEN FALSE ELSE TRUE END AS allow,
CASE WHEN role = 'superadmin' THEN 'builtin:superadmin' WHEN loans AND region = 'US' THEN 'builtin:residency' WHEN loans AND action = 'export' AND role = 'reader' THEN 'p2'
WHEN action = 'write' AND role <> 'owner' THEN 'builtin:rbac' WHEN loans AND action = 'read' AND role <> 'owner' THEN 'builtin:no-raw-pii-read' WHEN loans AND action = 'export' AND role <> 'owner' THEN 'builtin:deny-pii-export'
WHEN loans AND action = 'query' THEN 'p3' END AS policy_id FROM q""")
def authorize_bulk(spark, sf_dir):
    return access.authorize(_requests(spark, sf_dir), _datasets(spark), _policies(spark)).select("request", "allow", "policy_id")


# ---- logs, carbon, feeds ----------------------------------------------------------------------------------------


def _log(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    region = F.when(e % 4 == 0, "eu-north").when(e % 4 == 1, "us-west").when(e % 4 == 2, "ap-south").otherwise("moon")
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"), (F.col("value") * 1_048_576).cast("long").alias("bytes"), region.alias("region"), F.round(F.col("value") * 10).cast("long").alias("ms"), "event_type")


_LOG_SQL = """log AS (SELECT event_id, ts, CAST(trunc(value * 1048576) AS BIGINT) AS bytes, CASE event_id % 4 WHEN 0 THEN 28.0 WHEN 1 THEN 210.0 ELSE 640.0 END AS g, CAST(round(value * 10) AS BIGINT) AS ms, event_type FROM events),
a AS (SELECT *, greatest(bytes, 1) * 0.2::DOUBLE / 1073741824 AS kwh FROM log)"""


@query(f"WITH {_LOG_SQL} SELECT event_id, round(kwh, 12) AS kwh, round(kwh * g, 9) AS grams FROM a")
def carbon_log(spark, sf_dir):
    return carbon.accounted(_log(spark, sf_dir)).select("event_id", F.round("kwh", 12).alias("kwh"), F.round("grams", 9).alias("grams"))


@query(f"WITH {_LOG_SQL} SELECT CAST(ts AS DATE) AS day, count(*) AS queries, round(sum(kwh), 8) AS kwh, round(sum(kwh * g), 6) AS grams, round(sum(kwh) * 640 - sum(kwh * g), 6) AS grams_saved FROM a GROUP BY 1")
def carbon_savings(spark, sf_dir):
    return carbon.savings(_log(spark, sf_dir)).select("day", "queries", F.round("kwh", 8).alias("kwh"), F.round("grams", 6).alias("grams"), F.round("grams_saved", 6).alias("grams_saved"))


@query("""WITH c AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ['ap-south', 'us-west'] WHEN event_id % 3 = 1 THEN ['local', 'eu-north', 'ap-south'] ELSE ['moon', 'local'] END AS c FROM events)
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'us-west' WHEN event_id % 3 = 1 THEN 'eu-north' ELSE 'local' END AS region, CASE WHEN event_id % 3 = 0 THEN 0.738 WHEN event_id % 3 = 1 THEN 0.965 ELSE 0.525 END::DOUBLE AS renewable FROM c""")
def carbon_place(spark, sf_dir):
    e = F.col("event_id")
    options = lambda *r: F.array(*[F.lit(x) for x in r])
    c = F.when(e % 3 == 0, options("ap-south", "us-west")).when(e % 3 == 1, options("local", "eu-north", "ap-south")).otherwise(options("moon", "local"))
    return table(spark, sf_dir, "events").select("event_id", carbon.greenest(c).alias("region")).withColumn("renewable", carbon.renewable_share(F.col("region")))


@query(f"""WITH {_LOG_SQL}, k AS (SELECT event_type, ms, row_number() OVER (PARTITION BY event_type ORDER BY ms) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM log)
SELECT event_type, ms AS p95_ms, n AS queries FROM k WHERE k = round_even(0.95 * (n - 1), 0)""")
def p95_latency(spark, sf_dir):
    return carbon.latency(_log(spark, sf_dir), ["event_type"])


@query(f"""WITH f AS (SELECT event_type AS feed, user_id % 5 AS part, CASE WHEN user_id % 2 = 0 THEN 'streaming' ELSE 'batch' END AS modality, max(ts) AS last_at, count(*) AS n FROM events GROUP BY ALL),
w AS (SELECT *, CASE WHEN modality = 'streaming' THEN epoch(TIMESTAMP '2024-01-30 20:00:00') - floor(epoch(last_at)) <= 30 ELSE epoch(TIMESTAMP '2024-01-30 20:00:00') - floor(epoch(last_at)) <= 14400 END AS within FROM f)
SELECT modality, count(*) AS feeds, CAST(sum(n) AS BIGINT) AS per_minute, round(avg(CAST(within AS DOUBLE)), 4) AS slo_share, count(*) FILTER (NOT within) AS attention FROM w GROUP BY modality""")
def feed_rollup(spark, sf_dir):
    feeds = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 5).alias("part"), F.when(F.col("user_id") % 2 == 0, "streaming").otherwise("batch").alias("modality")).agg(F.max(F.col("ts").cast("timestamp")).alias("last_at"), F.count(F.lit(1)).alias("per_minute"))
    return carbon.feed_roll_up(carbon.freshness(feeds, F.lit("2024-01-30 20:00:00").cast("timestamp")))


_FEEDS_SQL = """f AS (SELECT event_type AS domain, user_id % 5 AS part, CASE WHEN user_id % 2 = 0 THEN 'streaming' ELSE 'batch' END AS modality, max(ts) AS last_at, count(*) AS n FROM events GROUP BY ALL),
w AS (SELECT *, epoch(TIMESTAMP '2024-01-30 20:00:00') - floor(epoch(last_at)) <= CASE WHEN modality = 'streaming' THEN 30 ELSE 14400 END AS within FROM f)"""


@query(f"""WITH {_FEEDS_SQL} SELECT CASE WHEN grouping(modality, domain) = 3 THEN 'total' WHEN grouping(domain) = 1 THEN 'modality' ELSE 'domain' END AS level, modality, domain, count(*) AS feeds, CAST(sum(n) AS BIGINT) AS per_minute,
round(avg(CAST(within AS DOUBLE)), 4) AS slo_share, count(*) FILTER (NOT within) AS attention FROM w GROUP BY GROUPING SETS ((modality), (domain), ())""")
def feed_board(spark, sf_dir):
    feeds = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("domain"), (F.col("user_id") % 5).alias("part"), F.when(F.col("user_id") % 2 == 0, "streaming").otherwise("batch").alias("modality")).agg(F.max(F.col("ts").cast("timestamp")).alias("last_at"), F.count(F.lit(1)).alias("per_minute"))
    return carbon.feed_board(carbon.freshness(feeds, F.lit("2024-01-30 20:00:00").cast("timestamp")))


@query(f"""WITH {_LOG_SQL}, r AS (SELECT *, CAST(ts AS DATE) AS day, CASE event_id % 4 WHEN 0 THEN 'eu-north' WHEN 1 THEN 'us-west' WHEN 2 THEN 'ap-south' ELSE 'moon' END AS region FROM a)
SELECT CASE grouping(day, region) WHEN 0 THEN 'day and region' WHEN 1 THEN 'day' WHEN 2 THEN 'region' ELSE 'total' END AS level, day, region, count(*) AS queries, round(sum(kwh), 8) AS kwh, round(sum(kwh * g), 6) AS grams,
round(sum(kwh) * 0.25, 8) AS cost, round(sum(kwh) * 380 - sum(kwh * g), 6) AS grams_saved FROM r GROUP BY GROUPING SETS ((day, region), (day), (region), ())""")
def carbon_board(spark, sf_dir):
    out = carbon.savings_at_levels(_log(spark, sf_dir), carbon.INTENSITY["local"])
    return out.select("level", "day", "region", "queries", *[F.round(c, n).alias(c) for c, n in (("kwh", 8), ("grams", 6), ("cost", 8), ("grams_saved", 6))])


@query(f"""WITH {_ENTITIES_SQL}, l AS (SELECT src, dst, CAST(a.domain <> b.domain AND a.domain <> 'shared' AND b.domain <> 'shared' AS INT) AS x FROM r JOIN e a ON src = a.id JOIN e b ON dst = b.id),
d AS (SELECT id, count(*) AS d, sum(x) AS x FROM (SELECT src AS id, x FROM l UNION ALL SELECT dst, x FROM l) GROUP BY id)
SELECT CASE WHEN grouping(type, domain) = 3 THEN 'total' WHEN grouping(domain) = 1 THEN 'type' ELSE 'domain' END AS level, type, domain, count(*) AS entities, CAST(coalesce(sum(d), 0) AS BIGINT) AS degree, CAST(coalesce(sum(x), 0) AS BIGINT) AS cross_links
FROM e LEFT JOIN d USING (id) GROUP BY GROUPING SETS ((type), (domain), ())""")
def graph_board(spark, sf_dir):
    return graph.board(*_entities(spark, sf_dir))


@query("""WITH d AS (SELECT source, 'dom' || (length(source) + ascii(right(source, 1))) % 3 AS domain, count(*) AS n, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS k FROM documents GROUP BY source),
f AS (SELECT domain, count(*) * 2 AS fields, count(*) FILTER (k % 5 = 0) AS pii FROM d GROUP BY domain)
SELECT CASE WHEN grouping(d.domain) = 1 THEN 'total' ELSE 'domain' END AS level, d.domain, count(*) AS datasets, count(*) FILTER (k % 5 = 0) AS pii_fields, count(*) FILTER (k % 5 = 0 OR k % 7 = 0) AS masked_by_default,
count(*) FILTER (k % 4 = 0) AS deny_rules, count(*) FILTER (k % 2 = 0) AS signed, count(DISTINCT CASE WHEN k % 3 > 0 THEN k % 3 END) AS residencies FROM d GROUP BY ROLLUP (d.domain)""")
def governance_board(spark, sf_dir):
    """Sources of the documents as datasets, with fields, policies and residencies that hang on their number."""
    k = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    domain = F.concat(F.lit("dom"), ((F.length("source") + F.ascii(F.right("source", F.lit(1)))) % 3).cast("string"))
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", domain.alias("domain"), k.alias("k"))
    fields = d.select("domain", F.col("source").alias("dataset"), F.lit("text").alias("column"), (F.col("k") % 5 == 0).alias("pii"), F.when(F.col("k") % 7 == 0, "phi").otherwise("public").alias("sensitivity"))
    policies = d.select("domain", F.when(F.col("k") % 4 == 0, "deny").otherwise("allow").alias("effect"))
    datasets = d.select("domain", F.col("source").alias("dataset"), (F.col("k") % 2 == 0).alias("signed"), F.when(F.col("k") % 3 > 0, (F.col("k") % 3).cast("string")).alias("residency"))
    return privacy.governance_board(fields, policies, datasets)


# ---- documents for AI, streams ----------------------------------------------------------------------------------


@query("""SELECT c_custkey, 'Crm Customers record ' || c_custkey || ' — ' || concat_ws('; ', 'C Nationkey: ' || c_nationkey, CASE WHEN seg <> '' THEN 'C Mktsegment: ' || seg END) AS text
FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 6 = 0 THEN '' WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS seg FROM customer)""")
def ai_documents(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.when(k % 6 == 0, "").when(k % 7 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return export.row_text(rows, "crm_customers", ["c_name"], "c_custkey").select("c_custkey", "text")


@query("""WITH d AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, 'Part record ' || (row_number() OVER (ORDER BY p_partkey) - 1) || ' — P Partkey: ' || p_partkey || '; P Brand: ' || p_brand AS t FROM part)
SELECT CASE WHEN min(i) = max(i) THEN 'part:' || min(i) ELSE 'part:' || min(i) || '-' || max(i) END AS id, md5(string_agg(t, chr(10) || chr(10) ORDER BY i)) AS text_md5, count(*) AS n FROM d GROUP BY i // 7""")
def ai_chunks(spark, sf_dir):
    rows = export.numbered(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), ["p_partkey"], "i")
    return export.chunks(rows, "part", "i", rows=7).select("id", F.md5("text").alias("text_md5"), (F.col("last") - F.col("first") + 1).alias("n"))


@query("""WITH m AS (SELECT event_id, CASE WHEN event_id % 10 = 3 THEN 'not json' ELSE props END AS v FROM events) SELECT event_id, CAST(json_extract(v, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS absent FROM m WHERE v <> 'not json'""")
def json_conform(spark, sf_dir):
    messages = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 == 3, "not json").otherwise(F.col("props")).alias("value"))
    rows = ingest.decode(messages, T.StructType([T.StructField("k", T.LongType())]), keep=("event_id",))
    wanted = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("k", T.LongType()), T.StructField("absent", T.StringType())])
    return readers.conform(rows, wanted)


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events WHERE event_id % 10 <> 3 GROUP BY event_type")
def stream_ingest(spark, sf_dir):
    """The events as a stream of messages, decoded and appended to a table until none is left; then read as a table.

    The pattern in the path lets one file stand for a watched folder."""
    from ..operators.graph import cut

    source = table(spark, sf_dir, "events")
    base = _scratch(spark)
    stream = ingest.topic(spark, f"{sf_dir}/event[s].parquet", source.schema)
    messages = stream.select("event_id", "event_type", F.when(F.col("event_id") % 10 == 3, "not json").otherwise(F.col("props")).alias("value"))
    rows = ingest.decode(messages, T.StructType([T.StructField("k", T.LongType())]), keep=("event_id", "event_type"))
    ingest.append_to(rows, f"{base}/table", f"{base}/cursor")
    landed = spark.read.schema("event_id long, event_type string, k long").parquet(f"{base}/table")
    return cut(landed.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k")))


@query("""WITH o AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id % 2, event_id) - 1 AS i, count(*) OVER () // 3 + 1 AS most FROM events),
p AS (SELECT 'all' AS grp, i // most AS poll, event_id, event_type FROM o UNION ALL SELECT 'late', 0, event_id, event_type FROM o WHERE i < most // 2)
SELECT grp, CAST(poll AS INTEGER) AS poll, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, min(event_type) AS least_type FROM p GROUP BY grp, poll""")
def topic_poll(spark, sf_dir):
    """The events as messages with headers in two batches; one group polls a third at a time until there are none, another once."""
    from functools import reduce

    events = table(spark, sf_dir, "events")
    topic = Topic(spark, _scratch(spark))
    messages = events.select("event_id", F.col("event_id").cast("string").alias("key"), F.col("props").alias("value"), F.create_map(F.lit("type"), F.col("event_type")).alias("headers"))
    for part in (0, 1):
        topic.produce(messages.where(F.col("event_id") % 2 == part), ["event_id"])
    most = topic.end() // 3 + 1
    polls = []
    while len(poll := topic.poll("all", most)):
        polls.append(("all", len(polls), poll))
    polls.append(("late", 0, topic.poll("late", most // 2)))
    seen = [p.rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("key").cast("long")).alias("ids"), F.min(F.element_at("headers", "type")).alias("least_type")).select(F.lit(g).alias("grp"), F.lit(k).alias("poll"), "n", "ids", "least_type") for g, k, p in polls]
    return reduce(DataFrame.unionByName, seen)


@query("""WITH m AS (SELECT event_id, event_id % 10 AS r, props FROM events)
SELECT event_id, CASE WHEN r = 3 THEN 'n/a' WHEN r NOT IN (4, 5) THEN json_extract_string(props, '$.k') END AS k, CASE WHEN r = 3 THEN 2.0 WHEN r = 4 THEN 1.5 END::DOUBLE AS m, CASE WHEN r = 4 THEN TRUE END AS x FROM m""")
def mixed_columns(spark, sf_dir):
    """Properties of which one field holds numbers and text, one two kinds of number and one a truth value: text, a number that holds both, and boolean."""
    e = F.col("event_id") % 10
    props = F.when(e == 3, '{"k": "n/a", "m": 2}').when(e == 4, '{"x": true, "m": 1.5}').when(e == 5, "no json").otherwise(F.col("props"))
    out = mixed.settle(table(spark, sf_dir, "events").select("event_id", props.alias("value")), "value", ("event_id",))
    return out.select("event_id", F.col("k").cast("string").alias("k"), F.col("m").cast("double").alias("m"), F.col("x").cast("boolean").alias("x"))


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


# ---- catalog ----------------------------------------------------------------------------------------------------


def _catalog(spark, sf_dir) -> DataFrame:
    """Two records for each source of the documents, the second newer: rows, quality and tags come from the table."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    facts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("row_count"), F.avg("quality").alias("quality"))
    base = facts.select(
        F.concat(F.lit("web/"), "source").alias("id"), F.col("source").alias("name"), F.when(n % 3 == 0, "news").otherwise("forum").alias("domain"), F.concat(F.lit("Pages of "), "source").alias("title"),
        F.when(n % 4 != 0, "crawled text").otherwise("").alias("description"), F.when(n % 2 == 0, F.array(F.lit("text"), F.lit("open"))).otherwise(F.array(F.lit("text"))).alias("tags"),
        F.lit("text").alias("modality"), F.when(n % 5 == 0, "pii").otherwise("public").alias("sensitivity"), (n % 2 == 0).alias("signed"), F.lit("s3a://x").alias("location"), (n % 2).alias("semantic_types"),
        F.when(n % 3 != 1, "CC-BY").otherwise("").alias("license"), F.lit(1).alias("provenance"), F.when(n % 5 == 0, 2).otherwise(0).alias("pii_fields"), "row_count", F.coalesce("quality", F.lit(0.0)).alias("quality"), F.lit(1).alias("version"),
    )
    return base.withColumn("version_at", F.lit("2024-01-01").cast("date")).withColumn("seq", F.lit(1)).unionByName(base.withColumn("version_at", F.lit("2024-02-01").cast("date")).withColumn("seq", F.lit(2)).withColumn("version", F.lit(2)).withColumn("row_count", F.col("row_count") + 1))


_CATALOG_SQL = """f AS (SELECT source, count(*) + 1 AS row_count, coalesce(avg(quality), 0) AS quality, CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source),
c AS (SELECT *, 'web/' || source AS id, CASE WHEN n % 3 = 0 THEN 'news' ELSE 'forum' END AS domain, CASE WHEN n % 5 = 0 THEN 'pii' ELSE 'public' END AS sensitivity, n % 2 = 0 AS signed,
(CAST(n % 4 <> 0 AS INT) + 1 + CAST(n % 2 = 1 AS INT) + CAST(n % 3 <> 1 AS INT)) / 4.0::DOUBLE AS fair_score FROM f)"""


@query(f"WITH {_CATALOG_SQL} SELECT id, row_count FROM c WHERE domain = 'forum' AND signed")
def catalog_search(spark, sf_dir):
    return catalog.search(catalog.latest(_catalog(spark, sf_dir)), "pages OF src", "forum", ["open", "text"]).select("id", "row_count")


@query(f"""WITH {_CATALOG_SQL} SELECT 'domain' AS facet, domain AS value, count(*) AS n FROM c GROUP BY domain UNION ALL SELECT 'modality', 'text', count(*) FROM c
UNION ALL SELECT 'sensitivity', sensitivity, count(*) FROM c GROUP BY sensitivity UNION ALL SELECT 'signed', CAST(signed AS VARCHAR), count(*) FROM c GROUP BY signed""")
def facets(spark, sf_dir):
    return catalog.facets(catalog.latest(_catalog(spark, sf_dir)))


@query(f"WITH {_CATALOG_SQL} SELECT id, fair_score FROM c")
def fair_score(spark, sf_dir):
    return catalog.fair(catalog.latest(_catalog(spark, sf_dir))).select("id", "fair_score")


@query(f"""WITH {_CATALOG_SQL} SELECT count(*) AS datasets, count(DISTINCT domain) AS domains, CAST(sum(row_count) AS BIGINT) AS rows, count(*) FILTER (signed) AS signed,
CAST(sum(CASE WHEN n % 5 = 0 THEN 2 ELSE 0 END) AS BIGINT) AS pii_fields, round(avg(fair_score), 4) AS mean_fair, round(avg(quality), 4) AS mean_quality FROM c""")
def catalog_summary(spark, sf_dir):
    return catalog.summary(catalog.latest(_catalog(spark, sf_dir)))


@query(f"WITH {_CATALOG_SQL} SELECT source AS name, id FROM c")
def populated_version(spark, sf_dir):
    return catalog.populated_version(_catalog(spark, sf_dir))


@query(f"""WITH {_LOG_SQL}, {_CATALOG_SQL}, k AS (SELECT ms, row_number() OVER (ORDER BY ms) - 1 AS k, count(*) OVER () AS n FROM log), last AS (SELECT max(CAST(ts AS DATE)) AS d FROM events)
SELECT (SELECT count(*) FROM c) AS datasets, (SELECT count(DISTINCT domain) FROM c) AS domains, (SELECT CAST(sum(row_count) AS BIGINT) FROM c) AS rows_indexed, (SELECT round(avg(quality), 4) FROM c) AS quality_avg,
(SELECT CAST(sum(CASE WHEN n % 5 = 0 THEN 2 ELSE 0 END) AS BIGINT) FROM c) AS pii_protected, (SELECT round(count(*) FILTER (n % 4 = 1) / count(*)::DOUBLE, 4) FROM c) AS coverage,
(SELECT count(*) FROM log) AS queries, (SELECT count(*) FROM log, last WHERE CAST(ts AS DATE) = d) AS queries_today, (SELECT count(*) FROM log WHERE event_id % 9 = 0) AS denied,
(SELECT round(sum(kwh * g) / count(*), 9) FROM a) AS carbon_per_query, (SELECT round(1 - sum(kwh * g) / (sum(kwh) * 640), 4) FROM a) AS carbon_saved, (SELECT ms FROM k WHERE k = round_even(0.95 * (n - 1), 0)) AS p95_ms""")
def platform_overview(spark, sf_dir):
    """The board from daily partials: the log loaded in three lots of days, one of them twice, never read again."""
    log = _log(spark, sf_dir).withColumn("status", F.when(F.col("event_id") % 9 == 0, "denied").otherwise("ok"))
    partials = overview.store(spark, _scratch(spark))
    day = F.dayofyear("at")
    for seq, lot in enumerate((0, 1, 1, 2)):
        overview.load(partials, log.where(day % 3 == lot), seq)
    records = catalog.latest(_catalog(spark, sf_dir))
    edges = records.where(F.regexp_extract("name", r"(\d+)$", 1).cast("int") % 4 == 1).select(F.lit("raw").alias("src"), F.col("id").alias("dst"))
    last = partials.days.read().agg(F.max("day")).first()[0]
    return overview.overview(records, edges, partials, F.lit(last))


@query("""WITH s AS (SELECT * FROM (VALUES (1, 0), (2, 1), (3, 1)) v(k, upto)), n AS (SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) AS e)
SELECT 'crm/customers' AS dataset, CAST(k AS INTEGER) AS nth, k > 1 AS has_parent, CASE WHEN upto = 0 THEN e ELSE c END AS rows, k < 3 AS changed, CAST(3 AS INTEGER) AS version, c AS row_count, CAST(1 AS BIGINT) AS edges FROM s, n""")
def landed_snapshots(spark, sf_dir):
    """Customers landed three times, the last time as they were: three snapshots with parents, one catalog row, one edge."""
    from pyspark.sql import Window

    store = Landings(spark, _scratch(spark))
    customers = table(spark, sf_dir, "customer")
    for k, part in enumerate((customers.where("c_custkey % 2 = 0"), customers, customers.repartition(3))):
        store.land(part, "crm", "customers", "me", "raw:customers", at=F.lit(f"2024-01-0{k + 1} 00:00:00").cast("timestamp"))
    nth = F.row_number().over(Window.partitionBy("dataset").orderBy("at"))
    shown = store.snapshots().select("dataset", nth.alias("nth"), F.col("parent_id").isNotNull().alias("has_parent"), "rows", "changed")
    known = store.catalog().select(F.col("id").alias("dataset"), "version", "row_count")
    edges = store.edges().groupBy(F.col("dst").alias("dataset")).agg(F.count(F.lit(1)).alias("edges"))
    return shown.join(known, "dataset").join(edges, "dataset")


# ---- provenance -------------------------------------------------------------------------------------------------


def _claims(spark, sf_dir) -> DataFrame:
    k = F.col("doc_id")
    claim = F.when(k % 3 == 0, F.sha2("text", 256)).when(k % 3 == 1, F.sha2(F.concat("text", F.lit("!")), 256))
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("payload"), claim.alias("checksum"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'authentic' WHEN doc_id % 3 = 1 THEN 'tampered' WHEN strlen(text) >= 64 THEN 'unverified' ELSE 'suspect' END AS verdict,
CAST(CASE WHEN doc_id % 3 = 0 THEN 0.9 WHEN doc_id % 3 = 1 THEN 0.95 WHEN strlen(text) >= 64 THEN 0.6 ELSE 0.7 END AS DOUBLE) AS confidence FROM documents""")
def content_verdict(spark, sf_dir):
    claims = _claims(spark, sf_dir)
    said: Column = provenance.verdict(F.col("checksum").isNotNull(), F.coalesce(F.sha2("payload", 256) == F.col("checksum"), F.lit(False)), F.col("payload"), 64)
    return claims.select("doc_id", said.alias("v")).select("doc_id", "v.*")


@query("SELECT doc_id, doc_id % 3 = 0 AS checksum_match, doc_id % 5 <> 0 AS signature_present, doc_id % 3 = 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS valid FROM documents")
def signature_verify(spark, sf_dir):
    key = b"test key"
    signed = _claims(spark, sf_dir).withColumn("s", provenance.sign(F.col("payload"), key))
    k = F.col("doc_id")
    assets = signed.withColumn("signature", F.when(k % 5 == 0, None).when(k % 7 == 0, F.reverse("s")).otherwise(F.col("s")))
    return provenance.verify(assets, key).select("doc_id", "checksum_match", "signature_present", "valid")


@query()
def table_digest(spark, sf_dir):
    return provenance.digest(table(spark, sf_dir, "documents")).select("rows", F.col("digest").cast("string").alias("digest"))


_ROW_SQL = "sha256(" + " || ".join(f"'{c}=' || coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-') || ';'" for c in ("doc_id", "text", "lang", "source", "n_chars")) + ")"
_TREE_SQL = ", ".join(
    [f"h AS (SELECT row_number() OVER (ORDER BY doc_id, {_ROW_SQL}) - 1 AS i, {_ROW_SQL} AS h FROM documents)", "l0 AS MATERIALIZED (SELECT i // 50 AS node, count(*) AS rows, sha256(string_agg(h, '' ORDER BY i)) AS digest FROM h GROUP BY 1)"]
    + [f"l{k} AS MATERIALIZED (SELECT node // 4 AS node, CAST(sum(rows) AS BIGINT) AS rows, sha256(string_agg(digest, '' ORDER BY node)) AS digest FROM l{k - 1} WHERE (SELECT count(*) FROM l{k - 1}) > 1 GROUP BY 1)" for k in range(1, 9)]
)


@query(f"WITH {_TREE_SQL} " + " UNION ALL ".join(f"SELECT {k} AS level, node, rows, digest FROM l{k}" for k in range(9)))
def ordered_digest(spark, sf_dir):
    """The hash tree of the documents in order of their id: chunks of 50 rows, four nodes below each of the others."""
    return provenance.hash_tree(table(spark, sf_dir, "documents"), ["doc_id"], 50, 4)


@query("""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, doc_id % 197 = 0 AND text <> lower(text) AS hit FROM documents)
SELECT i // 50 AS node, count(*) AS rows_before, count(*) AS rows_after FROM d GROUP BY 1 HAVING bool_or(hit)""")
def tampered_chunks(spark, sf_dir):
    """Documents of which a few are changed: the chunks that hold them, found from the roots down."""
    docs = table(spark, sf_dir, "documents")
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 197 == 0, F.lower("text")).otherwise(F.col("text")))
    return provenance.changed_chunks(*(provenance.hash_tree(d, ["doc_id"], 50, 4) for d in (docs, changed)), fan=4)


@query("""WITH c AS (SELECT 'customer' AS t, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem) SELECT t AS "table", n AS rows FROM c ORDER BY n DESC, t LIMIT 1""")
def richest_table(spark, sf_dir):
    return readers.richest({t: table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem")})


@query(r"""SELECT page_id, regexp_replace(regexp_replace('https://user:pw@' || regexp_extract(url, '://(.*)$', 1) || '&token=a1', '://[^/@\s]+@', '://***@'), '(?i)((?:password|passwd|pwd|token|secret|api_?key)=)[^&;\s]*', '\1***', 'g') AS uri FROM pages""")
def redact_uri(spark, sf_dir):
    uri = F.concat(F.lit("https://user:pw@"), F.regexp_extract("url", "://(.*)$", 1), F.lit("&token=a1"))
    return table(spark, sf_dir, "pages").select("page_id", X.redact_url(uri).alias("uri"))
