"""Authorization in bulk: requests joined with dataset facts and policies, decided by ordered conditions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OWNERS, WRITERS, APEX = ("admin", "owner"), ("admin", "owner", "writer"), ("superadmin", "super-admin")


def has_role(roles: str, wanted) -> Column:
    return F.arrays_overlap(F.coalesce(F.col(roles), F.array().cast("array<string>")), F.array(*[F.lit(r) for r in wanted]))


def glob(pattern: Column) -> Column:
    """A glob with * and ? as an anchored regular expression."""
    quoted = F.regexp_replace(pattern, r"([\\.\[\](){}^$+|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)|(?P<sign>==|!=|<=|>=|[<>()\[\],-]))""")
SIGNS = {"==": "=", "!=": "<>", "[": "(", "]": ")"}
WORDS = {"and": "AND", "or": "OR", "not": "NOT", "in": "IN", "true": "TRUE", "false": "FALSE", "none": "NULL"}


def guard(condition: str) -> Column:
    """A guard such as `principal.region in ["EU", "CH"] and resource.rows > 10` as a boolean column over request rows.

    Names with dots (struct fields), texts, numbers, lists, comparisons, in, and, or, not and parentheses; anything else, calls of
    functions above all, is an error. Null counts as false.
    """
    out, at, before = [], 0, ""
    text = condition.strip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not a guard at {text[at:at + 20]!r}")
        kind, value = m.lastgroup, m[m.lastgroup]
        if value == "(" and before == "name":
            raise ValueError("a guard calls no functions")
        if kind == "text":
            plain = re.sub(r"\\(.)", r"\1", value[1:-1])
            out.append("'" + plain.replace("\\", "\\\\").replace("'", "\\'") + "'")
        elif kind == "name" and value.lower() in WORDS:
            out.append(WORDS[value.lower()])
            kind = "word"
        elif kind == "name":
            out.append(".".join(f"`{p}`" for p in value.split(".")))
        else:
            out.append(SIGNS.get(value, value))
        at, before = m.end(), kind
    return F.coalesce(F.expr(" ".join(out)), F.lit(False))


def match_policies(requests: DataFrame, policies: DataFrame, conditions: dict[str, str] | None = None) -> DataFrame:
    """(request, policy_id, effect, obligations): the first matching deny, else the last matching allow.

    policies(id, position, domain, datasets, actions, roles, effect, obligations) is the policy set, a small table
    that people write; it meets requests by domain. An empty datasets, actions or roles array fits all.
    """
    p = policies.select(*[F.col(c).alias(f"p_{c}") for c in policies.columns])
    fits_name = (F.size("p_datasets") == 0) | F.exists("p_datasets", lambda g: F.rlike("name", glob(g)))
    fits_action = (F.size("p_actions") == 0) | F.array_contains("p_actions", "*") | F.array_contains("p_actions", F.col("action"))
    fits_role = (F.size("p_roles") == 0) | F.array_contains("p_roles", "*") | F.arrays_overlap("p_roles", "roles")
    guards = F.lit(True)
    for pid, condition in (conditions or {}).items():
        guards = F.when(F.col("p_id") == pid, guard(condition)).otherwise(guards)
    hits = requests.join(p, F.col("domain") == F.col("p_domain")).where(fits_name & fits_action & fits_role & guards)
    deny = F.min(F.when(F.col("p_effect") == "deny", F.struct("p_position", "p_id")))
    allow = F.max(F.when(F.col("p_effect") != "deny", F.struct("p_position", "p_id", "p_obligations")))
    best = hits.groupBy("request").agg(deny.alias("d"), allow.alias("a"))
    return best.select("request", F.coalesce("d.p_id", "a.p_id").alias("policy_id"), F.when(F.col("d").isNotNull(), "deny").otherwise("allow").alias("effect"), F.when(F.col("d").isNull(), F.col("a.p_obligations")).alias("policy_obligations"))


def authorize(requests: DataFrame, datasets: DataFrame, policies: DataFrame, conditions: dict[str, str] | None = None, epsilon: float = 1.0, residency_enforced: bool = True, deny_export: bool = True, private: bool = True) -> DataFrame:
    """(request, allow, policy_id, reason, obligations) for each of
    requests(request, subject, roles, region, jurisdiction, action, dataset) over
    datasets(dataset, domain, name, owner, code, place, residency_required, pii_fields, sensitive).

    The ladder: apex role, residency, policies, default roles for writes, raw reads and exports of personal data, then
    obligations. A dataset that is not known is refused.
    """
    rows = requests.join(datasets, "dataset", "left")
    rows = rows.join(match_policies(rows, policies, conditions), "request", "left")
    owner = F.coalesce(F.col("subject") == F.col("owner"), F.lit(False)) | has_role("roles", OWNERS)
    personal = F.size("pii_fields") > 0
    away = F.col("residency_required") & ~F.coalesce("region", "jurisdiction").isin(F.col("code"), F.col("place"), F.lit("GLOBAL")) & (F.col("jurisdiction") != F.col("code"))
    ladder = [
        (has_role("roles", APEX), True, "builtin:superadmin", "super-admin"), (F.col("domain").isNull(), False, "builtin:unknown", "unknown dataset"),
        (away, False, "builtin:residency", "residency"), (F.col("effect") == "deny", False, None, "denied by policy"),
        (F.col("effect").isNull() & F.col("action").isin("write", "admin") & (F.col("subject") != F.col("owner")) & ~has_role("roles", WRITERS), False, "builtin:rbac", "needs a role"),
        ((F.col("action") == "read") & personal & ~owner, False, "builtin:no-raw-pii-read", "raw read of personal data"),
    ]
    if deny_export:
        ladder.append(((F.col("action") == "export") & personal & ~owner, False, "builtin:deny-pii-export", "export of personal data"))
    allow, reason, by = F.lit(True), F.lit("authorized"), F.col("policy_id")
    for condition, yes, rule, text in reversed(ladder):
        allow, reason = F.when(condition, F.lit(yes)).otherwise(allow), F.when(condition, F.lit(text)).otherwise(reason)
        by = F.when(condition, F.lit(rule) if rule else F.col("policy_id")).otherwise(by)
    asks = F.col("action").isin("aggregate", "query", "sample") & F.col("sensitive") & ~owner
    own = [F.when(personal & ~owner, F.lit("mask:hash")), F.when(asks & (F.col("action") == "sample"), F.lit("aggregate_only"))]
    if private:
        own.append(F.when(asks, F.lit(f"differential_privacy:{epsilon}")))
    own.append(F.when(F.col("residency_required") | F.lit(residency_enforced), F.concat(F.lit("residency:"), "code")))
    all_of = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.coalesce("policy_obligations", F.array().cast("array<string>")), F.array(*own)))))
    none = F.array().cast("array<string>")
    return rows.select("request", "dataset", allow.alias("allow"), by.alias("policy_id"), reason.alias("reason"), F.when(allow & ~has_role("roles", APEX), all_of).otherwise(none).alias("obligations"))
