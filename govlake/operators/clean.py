"""Cleaning from a plan: ordered steps (op, columns, params), each a DataFrame transform with an audited count.

Counts ride along as observed metrics, so a plan of row-wise steps stays one pass over the data; steps that need
statistics of the table (normalise, impute, outliers) add one aggregate each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from . import profile, quantiles


@dataclass(frozen=True)
class Step:
    op: str
    columns: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)


def _col(name: str) -> Column:
    """A column by its whole name, dots and backticks too."""
    return F.col("`" + name.replace("`", "``") + "`")


def _strings(df: DataFrame, columns: Sequence[str]) -> list[str]:
    have = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return [c for c in (columns or df.columns) if c in have]


def _numbers(df: DataFrame, columns: Sequence[str]) -> list[str]:
    have = {f.name for f in df.schema.fields if isinstance(f.dataType, profile.NUMBERS)}
    return [c for c in (columns or df.columns) if c in have]


def _each(df: DataFrame, columns: Sequence[str], how) -> DataFrame:
    return df.withColumns({c: how(_col(c)) for c in columns})


def trim(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    return _each(df, _strings(df, columns), X.strip)


def collapse_ws(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    return _each(df, _strings(df, columns), X.collapse)


def empty_to_null(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    return _each(df, _strings(df, columns), lambda c: F.when(~X.is_missing(c), c))


def standardize_case(df: DataFrame, columns: Sequence[str] = (), mode: str = "lower") -> DataFrame:
    return _each(df, _strings(df, columns), lambda c: X.case(c, mode))


def normalize_category(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Each value becomes the most frequent of the forms that are equal but for case and outer blanks; ties by value.

    The forms that matter are those of folded values with several forms; Spark broadcasts that table if it is small.
    """
    for c in _strings(df, columns):
        forms = df.where(_col(c).isNotNull()).groupBy(F.lower(X.strip(_col(c))).alias("_folded"), X.strip(_col(c)).alias("_form")).agg(F.count(F.lit(1)).alias("_n"))
        best = forms.groupBy("_folded").agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_form").alias("form"))).alias("_best")).select("_folded", F.col("_best.form").alias("_canon"))
        df = df.join(best, F.lower(X.strip(_col(c))) == F.col("_folded"), "left").withColumn(c, F.when(_col(c).isNotNull(), F.col("_canon"))).drop("_folded", "_canon")
    return df


def split_unit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """x becomes x_value (double) and x_unit in its place; both null where x isn't a number with a unit."""
    split = set(_strings(df, columns))
    out = []
    for c in df.columns:
        out += [X.unit_value(_col(c)).alias(f"{c}_value"), X.unit_name(_col(c)).alias(f"{c}_unit")] if c in split else [_col(c)]
    return df.select(*out)


def coerce_type(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.withColumns({c: X.coerce(_col(c), t) for c, t in types.items() if c in _strings(df, list(types))})


def dedupe_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold null only; the rows stay."""
    if not df.columns:
        return df
    filled = df.agg(*[F.count(_col(c)).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.select(*[_col(c) for i, c in enumerate(df.columns) if filled[i]])


def _mode(df: DataFrame, name: str) -> object:
    """The most frequent value that isn't null, the least of several; None without one. Counts are combined before the shuffle and only the first is kept, so no buffer holds all values."""
    counted = df.where(_col(name).isNotNull()).groupBy(_col(name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    best = counted.orderBy(F.desc("n"), "v").first()
    return None if best is None else best.v


def impute(df: DataFrame, columns: Sequence[str] = (), strategy: str = "mean", value=None) -> DataFrame:
    """Nulls become the mean, median, mode (least of the most frequent) or a constant that fits the type."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    columns = [c for c in (columns or df.columns) if c in kinds]
    if strategy in ("mean", "median"):
        columns = _numbers(df, columns)
    if not columns:
        return df
    if strategy == "constant":
        fills = {c: F.lit(str(value)).try_cast(kinds[c]) for c in columns}
        return df.withColumns({c: F.coalesce(_col(c), v) for c, v in fills.items()})
    if strategy == "median":
        middle = {r.column: r.median for r in quantiles.of_columns(df, {c: _col(c) for c in columns}, {"median": 0.5}).collect()}  # a row a column
        found = {c: middle.get(c) for c in columns}
    elif strategy == "mode":
        found = {c: _mode(df, c) for c in columns}
    elif strategy == "mean":
        found = df.agg(*[F.avg(_col(c)).alias(c) for c in columns]).first()
    else:
        raise ValueError(f"no strategy {strategy}")
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    fill = lambda c: F.bround(F.lit(found[c]).cast("double"), 0) if isinstance(kinds[c], whole) and strategy != "mode" else F.lit(found[c])
    return df.withColumns({c: F.coalesce(_col(c), fill(c).cast(kinds[c])) for c in columns if found[c] is not None})


def _limits(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    columns = _numbers(df, columns)
    if not columns:
        return {}
    found = df.agg(*[F.count(_col(c)).alias(c) for c in columns]).first()
    quartiles = quantiles.quartiles(df, {c: _col(c) for c in columns})
    return {c: (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) for c, (q1, q3) in quartiles.items() if found[c] >= 4 and q3 != q1}


def clip_outliers(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    out = {}
    for c, (lo, hi) in _limits(df, columns).items():
        kind = df.schema[c].dataType
        clipped = F.least(F.greatest(_col(c).cast("double"), F.lit(lo)), F.lit(hi))
        out[c] = F.when(_col(c).isNotNull(), (F.bround(clipped, 0) if not isinstance(kind, (T.FloatType, T.DoubleType)) else clipped).cast(kind))
    return df.withColumns(out)


def flag_outliers(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Adds x__outlier after each numeric x: false for null and where there are no fences."""
    limits, wanted, out = _limits(df, columns), set(_numbers(df, columns)), []
    for c in df.columns:
        out.append(_col(c))
        if c in wanted:
            lo, hi = limits.get(c, (None, None))
            out.append((F.coalesce((_col(c) < lo) | (_col(c) > hi), F.lit(False)) if c in limits else F.lit(False)).alias(f"{c}__outlier"))
    return df.select(*out)


OPS = {
    "trim": lambda df, s: trim(df, s.columns), "collapse_ws": lambda df, s: collapse_ws(df, s.columns), "empty_to_null": lambda df, s: empty_to_null(df, s.columns),
    "standardize_case": lambda df, s: standardize_case(df, s.columns, s.params.get("case", "lower")), "normalize_category": lambda df, s: normalize_category(df, s.columns),
    "split_unit": lambda df, s: split_unit(df, s.columns), "coerce_type": lambda df, s: coerce_type(df, s.params["types"]), "dedupe_rows": lambda df, s: dedupe_rows(df),
    "drop_empty_columns": lambda df, s: drop_empty_columns(df), "impute": lambda df, s: impute(df, s.columns, s.params.get("strategy", "mean"), s.params.get("value")),
    "clip_outliers": lambda df, s: clip_outliers(df, s.columns), "flag_outliers": lambda df, s: flag_outliers(df, s.columns),
}
#: Steps that change values in place, row by row or by the table's statistics: cells can be compared with what they were in the same pass.
IN_PLACE = ("trim", "collapse_ws", "empty_to_null", "standardize_case", "normalize_category", "coerce_type", "impute", "clip_outliers")


@dataclass
class Cleaned:
    data: DataFrame
    notes: list[dict]
    observations: dict[int, tuple[Observation, Observation]]

    def audit(self) -> list[dict]:
        """Once data has been written or counted: each step with the cells it changed, split or flagged, and the rows before it that are gone after it."""
        out = []
        for i, n in enumerate(self.notes):
            if i in self.observations:
                before, after = (o.get for o in self.observations[i])
                n = n | {"cells_changed": after["changed"], "rows_removed": before["rows"] - after["rows"]}
            out.append(n)
        return out


def _total(counts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, counts, F.lit(0))


def apply_plan(df: DataFrame, plan: Sequence[Step]) -> Cleaned:
    """Run the steps in order; an unknown op is noted and skipped.

    What every step does is counted in the pass that the data takes anyway, by metrics observed before and after it: no shuffle and no scan is added.
    """
    notes, seen = [], {}
    for step in plan:
        if step.op not in OPS:
            notes.append({"op": step.op, "note": "unknown op, skipped"})
            continue
        i, before, source = len(notes), df, Observation()
        counted = before.observe(source, F.count(F.lit(1)).alias("rows"))
        old = {}
        if step.op in IN_PLACE:
            columns = [c for c in step.params.get("types", step.columns or before.columns) if c in before.columns]
            old = {c: f"_old_{i}_{k}" for k, c in enumerate(columns)}
            df = OPS[step.op](counted.withColumns({o: _col(c) for c, o in old.items()}), Step(step.op, tuple(columns), step.params)) if columns else counted
            changed = [F.count_if(~_col(c).cast("string").eqNullSafe(F.col(o).cast("string"))) for c, o in old.items()]
        else:
            df = OPS[step.op](counted, step)
            added = [c for c in df.columns if c not in before.columns]
            changed = [F.count(_col(c)) for c in added if c.endswith("_value")] if step.op == "split_unit" else [F.count_if(_col(c)) for c in added] if step.op == "flag_outliers" else []
        seen[i] = (source, Observation())
        df = df.observe(seen[i][1], _total(changed).cast("long").alias("changed"), F.count(F.lit(1)).alias("rows")).drop(*old.values())
        notes.append({"op": step.op, "added": [c for c in df.columns if c not in before.columns], "removed": [c for c in before.columns if c not in df.columns]})
    return Cleaned(df, notes, seen)


def _one_zero(c: Column, kind: T.DataType) -> Column:
    """-0.0 as 0.0, in arrays and structs too: they are equal and one group, but two texts."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(c == 0, F.lit(0).cast(kind)).otherwise(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _one_zero(x, kind.elementType))
    if isinstance(kind, T.StructType) and kind.fields:
        return F.when(c.isNotNull(), F.struct(*[_one_zero(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    return c


def _common(before: DataFrame, after: DataFrame) -> list[Column]:
    """The columns that both have, to be compared. Zeros are one where the type stayed; where text became a number, its text counts."""
    kinds = {f.name: f.dataType for f in after.schema.fields}
    shared = [f for f in before.schema.fields if f.name in kinds]
    return [_one_zero(_col(f.name), f.dataType) if f.dataType.simpleString() == kinds[f.name].simpleString() else _col(f.name) for f in shared]


def _fingerprint(columns: Sequence[Column]) -> Column:
    """128 bits of a row's values as text, a null unlike any text. The second hash begins from another seed: ending it otherwise would only hash the first."""
    values = F.array(*[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in columns])
    return F.struct(F.xxhash64(values).alias("a"), F.xxhash64(F.lit(1), values).alias("b"))


def differences(frames: Sequence[DataFrame]) -> DataFrame:
    """(step from 1, removed, added): how each frame differs from the one before it as a bag of rows, over the columns that both have.

    Rows need no key: a fingerprint counts +1 before and -1 after, so rows that stay cancel, however often they repeat. Sums are made before the
    shuffle, so a row that is a third of the table is one entry of each task. All steps are one aggregate.
    """
    parts = []
    for i, df in enumerate(frames):
        sides = []
        for step, other, sign in ((i + 1, i + 1, 1), (i, i - 1, -1)):
            if 0 <= other < len(frames) and step >= 1:
                common = _common(frames[min(i, other)], frames[max(i, other)])
                sides.append(F.struct(F.lit(step).alias("step"), F.lit(sign).alias("sign"), _fingerprint(common).alias("row")))
        parts.append(df.select(F.inline(F.array(*sides))))
    left = reduce(DataFrame.unionByName, parts).groupBy("step", "row").agg(F.sum("sign").alias("n"))
    return left.groupBy("step").agg(F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n"))), F.lit(0)).alias("removed"), F.coalesce(F.sum(F.when(F.col("n") < 0, -F.col("n"))), F.lit(0)).alias("added"))


def step_differences(df: DataFrame, plan: Sequence[Step]) -> DataFrame:
    """(step, op, removed, added) for the known steps of a plan: an audit that trusts no step's own account. Each step's rows are made anew from df."""
    known = [s for s in plan if s.op in OPS]
    frames = [df]
    for step in known:
        frames.append(OPS[step.op](frames[-1], step))
    names = F.array(*[F.lit(s.op) for s in known])
    found = differences(frames)
    return found.select("step", F.element_at(names, F.col("step")).alias("op"), "removed", "added")


def derive_plan(assessment: DataFrame) -> list[Step]:
    """The plan that a profile recommends, in a fixed order. It never imputes or clips by itself."""
    rows = assessment.select("column", "inferred_type", "steps").orderBy("column").collect()  # a row for each column
    wants = lambda name: tuple(r.column for r in rows if name in r.steps)
    plan = [Step("trim", wants("trim")), Step("empty_to_null", wants("empty_to_null")), Step("standardize_case", wants("standardize_case"), {"case": "lower"}), Step("normalize_category", wants("normalize_category")), Step("split_unit", wants("split_unit"))]
    plan = [s for s in plan if s.columns]
    types = {r.column: r.inferred_type for r in rows if "coerce_type" in r.steps and "split_unit" not in r.steps}
    if types:
        plan.append(Step("coerce_type", tuple(types), {"types": types}))
    plan.append(Step("dedupe_rows"))
    return plan + ([Step("drop_empty_columns")] if wants("drop_empty_columns") else [])


def score(df: DataFrame) -> DataFrame:
    """One row: mean over columns of (completeness + 2) / 3; 1 without rows, 0 without columns."""
    if not df.columns:
        return df.sparkSession.range(1).select(F.lit(0.0).alias("score"))
    shares = [F.count(F.col(f"`{c}`")) / F.count(F.lit(1)) for c in df.columns]
    mean = reduce(lambda a, b: a + b, [(s + 2.0) / 3.0 for s in shares]) / len(shares)
    return df.agg(F.when(F.count(F.lit(1)) == 0, 1.0).otherwise(F.round(mean, 4)).alias("score"))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")
