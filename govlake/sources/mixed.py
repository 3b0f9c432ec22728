"""Columns of mixed kinds: the type that holds every value of a field, found over all rows, and text where no other does.

Spark merges the schemas of variants in one aggregate: whole numbers widen to decimals and doubles, and kinds that don't meet stay VARIANT. Such a field becomes text:
a text keeps its characters, any other value becomes its JSON. Nothing is sampled, so a single odd value among billions is seen.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What may stand as a column's type; the rest becomes text.
SCALARS = re.compile(r"(?:BIGINT|DOUBLE|FLOAT|BOOLEAN|STRING|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|DECIMAL\(\d+,\d+\))\Z")


def fields(schema: str) -> dict[str, str]:
    """Top-level fields of a variant schema `OBJECT<name: TYPE, ...>`, names in backticks or plain."""
    inside = re.match(r"OBJECT<(.*)>\Z", schema, re.S)
    out, depth, quoted, part = {}, 0, False, ""
    for c in (inside[1] if inside else "") + ",":
        quoted ^= c == "`"
        depth += (not quoted) * ((c in "<(") - (c in ">)"))
        if c == "," and not depth and not quoted:
            if m := re.match(r"\s*(?:`((?:[^`]|``)*)`|([^:]*)):\s*(.*)\Z", part, re.S):
                out[m[1].replace("``", "`") if m[1] is not None else m[2]] = m[3].strip()
            part = ""
        else:
            part += c
    return out


def _member(v: Column, name: str) -> tuple[Column, str]:
    """A field of an object and the path to read it by; paths have no escapes, so a name with both kinds of quotes goes by way of a map."""
    if "'" in name and '"' in name:
        return F.element_at(v.cast("map<string,variant>"), F.lit(name)), "$"
    return v, f"""$["{name}"]""" if "'" in name else f"$['{name}']"


def _field(v: Column, name: str, kind: str) -> Column:
    at, path = _member(v, name)
    return F.variant_get(at, path, kind if SCALARS.match(kind) else "string")


def settle(df: DataFrame, value: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The JSON objects of a text column as columns, one for each field of any row, after the columns of keep.

    A field whose values have one kind, or kinds of number that one type holds, has that type; one of mixed kinds, and a nested one, is text. Texts that are no JSON
    object give nulls, as does a field that a row lacks. One aggregate finds the types, one projection applies them.
    """
    parsed = df.select(*keep, F.try_parse_json(F.col(value)).alias("_v"))
    # anything but an object would make the whole column a variant
    objects = parsed.withColumn("_v", F.when(F.schema_of_variant("_v").startswith("OBJECT"), F.col("_v")))
    schema = objects.agg(F.schema_of_variant_agg("_v").alias("s")).first().s or ""
    found = {n: k for n, k in fields(schema).items()}
    return objects.select(*keep, *[_field(F.col("_v"), n, k).alias(n) for n, k in found.items()])


def widen(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns as the type that holds all their values: whole numbers, decimals, booleans and so on; those of mixed kinds stay text as they are."""
    parsed = {c: F.try_parse_json(F.col(f"`{c}`")) for c in columns}
    # a text that is no JSON value is a text, which no number meets
    variants = {c: F.when(F.col(f"`{c}`").isNotNull(), F.coalesce(p, F.to_variant_object(F.array(F.lit("text"))))) for c, p in parsed.items()}
    found = df.agg(*[F.schema_of_variant_agg(v).alias(str(i)) for i, v in enumerate(variants.values())]).first()
    kinds = dict(zip(columns, found, strict=True))
    return df.withColumns({c: F.col(f"`{c}`").try_cast(k) for c, k in kinds.items() if k and SCALARS.match(k) and k not in ("STRING", "BINARY")})
