"""Redaction of whole DataFrames, driven by their schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardframe.functions.jsondoc import redact_json
from guardframe.functions.pii import holds_text, holds_variant, is_sensitive_key, mask_value, redact
from guardframe.rules import SECRET_MASK


def _as_json(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.VariantType):
        return F.to_json(col)
    return F.when(col.isNotNull(), F.to_json(col, {"ignoreNullFields": "false"}))


def _field(field: T.StructField, strings: bool) -> Column:
    col = F.col(f"`{field.name}`")
    if is_sensitive_key(field.name):
        return F.lit(SECRET_MASK).alias(field.name)
    if holds_variant(field.dataType):
        return F.parse_json(redact_json(_as_json(col, field.dataType), strings)).alias(field.name)
    if not holds_text(field.dataType):
        return col
    return mask_value(col, field.dataType, strings).alias(field.name)


def redact_columns(df: DataFrame, *names: str) -> DataFrame:
    """Redact the named string columns."""
    return df.withColumns({name: redact(F.col(name)) for name in names})


def mask_sensitive_keys(df: DataFrame) -> DataFrame:
    """Replace the values of secret fields and map keys at any depth; other texts stay.

    Variants are documents of unknown shape. A column with one below a struct, array or map is
    walked as one document and comes back as a variant.
    """
    return df.select(*[_field(f, strings=False) for f in df.schema.fields])


def redact_document(df: DataFrame) -> DataFrame:
    """Mask secret fields and redact all texts at any depth; other scalars stay.

    Columns that hold variants come back as variants.
    """
    return df.select(*[_field(f, strings=True) for f in df.schema.fields])


def _has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_has_map(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has_map(dtype.elementType)
    return isinstance(dtype, (T.MapType, T.VariantType))


def differs(raw: Column, clean: Column, raw_type: T.DataType, clean_type: T.DataType) -> Column:
    """Whether redaction changed a value; as JSON where the two cannot be compared directly."""
    if isinstance(clean_type, T.VariantType) and not isinstance(raw_type, T.VariantType) and holds_variant(raw_type):
        raw = F.parse_json(_as_json(raw, raw_type))
    if raw_type == clean_type and not _has_map(raw_type):
        return ~raw.eqNullSafe(clean)
    return ~F.to_json(F.struct(raw.alias("v"))).eqNullSafe(F.to_json(F.struct(clean.alias("v"))))


def redact_with_changes(df: DataFrame, changes: str = "changes", keep: tuple[str, ...] = ()) -> DataFrame:
    """Redact the documents and add the names of the columns that changed in the row.

    Columns in ``keep`` are no part of the document and stay as they are. The masks are projected
    before the comparison, so each is worked out once per row.
    """
    changing = [f for f in df.schema.fields
                if f.name not in keep and (is_sensitive_key(f.name) or holds_text(f.dataType))]
    raw = [F.col(f"`{f.name}`").alias(f"_raw_{f.name}") for f in changing]
    clean = [F.col(f"`{f.name}`") if f.name in keep else _field(f, strings=True) for f in df.schema.fields]
    both = df.select(*clean, *raw)
    names = [
        F.when(differs(F.col(f"`_raw_{f.name}`"), F.col(f"`{f.name}`"), f.dataType, both.schema[f.name].dataType), f.name)
        for f in changing
    ]
    changed = F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")
    return both.select(*[F.col(f"`{c}`") for c in df.columns], changed.alias(changes))


def redact_with_flag(df: DataFrame, flag: str = "redaction_applied") -> DataFrame:
    """Redact the documents and add whether anything in the row changed.

    The masks are projected before the comparison, so each is worked out once per row.
    """
    changing = [f for f in df.schema.fields
                if is_sensitive_key(f.name) or holds_text(f.dataType)]
    raw = [F.col(f"`{f.name}`").alias(f"_raw_{f.name}") for f in changing]
    both = df.select(*[_field(f, strings=True) for f in df.schema.fields], *raw)
    tests = [
        differs(F.col(f"`_raw_{f.name}`"), F.col(f"`{f.name}`"), f.dataType, both.schema[f.name].dataType)
        for f in changing
    ]
    changed = reduce(lambda a, b: a | b, tests) if tests else F.lit(False)
    return both.select(*[F.col(f"`{c}`") for c in df.columns], changed.alias(flag))


def redaction_count(df: DataFrame, flag: str = "redaction_applied") -> DataFrame:
    """How many documents had anything redacted."""
    return df.agg(F.count_if(F.col(flag)).alias("total_redactions"))
