"""Personal-data masks as Column expressions.

The order email, card, SSN, phone is part of the result: each step reads the output of the one
before. Odd outputs follow from the patterns and are kept: ``+1 (555) 890-1234`` becomes
``++1 (***) ***-1234``, ten-digit numbers in text are masked as phones, thirteen-digit ones as
cards, and masking a second time may change the text again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardframe.functions.text import contains_any, java_pattern
from guardframe.rules import (
    CARD_MASK,
    CARD_PATTERN,
    EMAIL_PATTERN,
    PHONE_MASK,
    PHONE_PATTERN,
    SECRET_MASK,
    SENSITIVE_KEYS,
    SSN_MASK,
    SSN_PATTERN,
)

# Spark has no replacement callback, so a match is first wrapped in two private-use marks and
# the wrapped text is rewritten by a second pass. Marks already in the data are escaped around it;
# neither they nor their escapes are word, space or mask characters, so no pattern sees a change.
_OPEN, _CLOSE, _ESCAPE = "", "", ""
_ESCAPES = [(_ESCAPE, _ESCAPE + "!"), (_OPEN, _ESCAPE + "#"), (_CLOSE, _ESCAPE + "%")]

# Of a run of local-part signs only the first word border can begin a match, as all others end at
# the same sign; so a match is tried once per run, and the time is linear in the text.
_LOCAL = r"[a-zA-Z0-9_.+-]"
_EMAIL = java_pattern(
    rf"(?:\G|(?<!{_LOCAL}))((?:(?!\b){_LOCAL})*+)\b({_LOCAL}){_LOCAL}++(?<=({_LOCAL}))"
    + EMAIL_PATTERN[EMAIL_PATTERN.index("@"):]
)
_CARD = r"(?=\p{Nd})" + java_pattern(CARD_PATTERN)
_CARD_LAST4 = r"[\p{Nd} -]*?" + r"[ -]*".join([r"(\p{Nd})"] * 4) + r"[ -]*"
_SSN = r"(?=\p{Nd})" + java_pattern(SSN_PATTERN)
# the phone pattern with its country digits and its last four digits captured
_PHONE = r"(?=[+(\p{Nd}])" + java_pattern(
    PHONE_PATTERN.replace(r"\d{1,3}", r"(\d{1,3})").replace(r"\d{4}", r"(\d{4})")
)
# every card, SSN and phone holds nine digits with nothing but these signs between them
NINE_DIGITS = java_pattern(r"\d(?:[-.()\s]*\d){8}")
_SENSITIVE = re.compile("|".join(map(re.escape, SENSITIVE_KEYS)))


def _escape_marks(col: Column) -> Column:
    for mark, escaped in _ESCAPES:
        col = F.replace(col, F.lit(mark), F.lit(escaped))
    return col


def _unescape_marks(col: Column) -> Column:
    for mark, escaped in reversed(_ESCAPES):
        col = F.replace(col, F.lit(escaped), F.lit(mark))
    return col


def _card(col: Column) -> Column:
    wrapped = F.regexp_replace(col, f"({_CARD})", f"{_OPEN}$1{_CLOSE}")
    return F.regexp_replace(wrapped, f"{_OPEN}{_CARD_LAST4}{_CLOSE}", f"{CARD_MASK}$1$2$3$4")


def _ssn(col: Column) -> Column:
    return F.regexp_replace(col, _SSN, SSN_MASK)


def _phone(col: Column) -> Column:
    wrapped = F.regexp_replace(col, _PHONE, f"{_OPEN}$1{_CLOSE} {PHONE_MASK}$2")
    local = F.replace(wrapped, F.lit(f"{_OPEN}{_CLOSE} "), F.lit(""))
    return F.replace(F.replace(local, F.lit(_OPEN), F.lit("+")), F.lit(_CLOSE), F.lit(""))


def mask_email(col: Column) -> Column:
    """``johndoe@gmail.com`` to ``j***e@gmail.com``; texts without ``@`` skip the regex."""
    masked = F.regexp_replace(col, _EMAIL, "$1$2***$3@$4")
    return F.when(col.contains("@"), masked).otherwise(col)


def mask_card(col: Column) -> Column:
    """13 to 16 digits with spaces or dashes: keep the last four."""
    return F.when(col.rlike(NINE_DIGITS), _unescape_marks(_card(_escape_marks(col)))).otherwise(col)


def mask_ssn(col: Column) -> Column:
    """US social security numbers, masked whole."""
    return F.when(col.rlike(NINE_DIGITS), _ssn(col)).otherwise(col)


def mask_phone(col: Column) -> Column:
    """Ten digits keep the last four; leading country digits are kept behind a ``+``."""
    masked = _unescape_marks(_phone(_escape_marks(col)))
    return F.when(col.rlike(NINE_DIGITS), masked).otherwise(col)


def redact(col: Column) -> Column:
    """All four masks in order.

    Masking emails can only remove digits, so one look at the raw text for nine digits decides
    whether the three digit masks can match at all; most text skips them.
    """
    emailed = mask_email(col)
    digits = _unescape_marks(_phone(_ssn(_card(_escape_marks(emailed)))))
    return F.when(col.rlike(NINE_DIGITS), digits).otherwise(emailed)


def is_sensitive_key(name: str) -> bool:
    """Whether a field name marks its whole value as secret."""
    return _SENSITIVE.search(name.lower()) is not None


def holds_text(dtype: T.DataType) -> bool:
    """Whether redaction can change a value of this type."""
    if isinstance(dtype, T.StructType):
        return any(is_sensitive_key(f.name) or holds_text(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return holds_text(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return isinstance(dtype.keyType, T.StringType) or holds_text(dtype.valueType)
    return isinstance(dtype, (T.StringType, T.VariantType))


def holds_variant(dtype: T.DataType) -> bool:
    """Whether a value of this type has a variant in it."""
    if isinstance(dtype, T.StructType):
        return any(holds_variant(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return holds_variant(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return holds_variant(dtype.keyType) or holds_variant(dtype.valueType)
    return isinstance(dtype, T.VariantType)


def _mask_map(col: Column, dtype: T.MapType, strings: bool) -> Column:
    # A map has one value type. Text values stay as they are; others become text (nested ones as
    # JSON), because a masked value is text and any key may turn out to be a secret one.
    def masked(key, value):
        clean = mask_value(value, dtype.valueType, strings)
        if isinstance(dtype.valueType, (T.StructType, T.ArrayType, T.MapType)):
            clean = F.to_json(clean)
        elif not isinstance(dtype.valueType, T.StringType):
            clean = clean.cast("string")
        secret = contains_any(F.lower(key), SENSITIVE_KEYS)
        return F.when(secret, F.lit(SECRET_MASK)).otherwise(clean)

    if isinstance(dtype.keyType, T.StringType):
        return F.transform_values(col, masked)
    return F.transform_values(col, lambda _, value: mask_value(value, dtype.valueType, strings))


def mask_value(col: Column, dtype: T.DataType, strings: bool = True) -> Column:
    """Rebuild a value of any type: secret keys masked, and texts redacted if ``strings``."""
    if not holds_text(dtype):
        return col
    if isinstance(dtype, T.StructType):
        fields = [
            F.lit(SECRET_MASK).alias(f.name) if is_sensitive_key(f.name)
            else mask_value(col.getField(f.name), f.dataType, strings).alias(f.name)
            for f in dtype.fields
        ]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda item: mask_value(item, dtype.elementType, strings))
    if isinstance(dtype, T.MapType):
        return _mask_map(col, dtype, strings)
    return redact(col) if strings else col
