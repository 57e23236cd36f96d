"""JSON text of unknown shape: validity, keys, string values and redaction.

Validity is what ``try_parse_json`` accepts, with nothing behind the value. It refuses ``NaN`` and, unless the session sets
``spark.sql.variant.allowDuplicateKeys``, objects that name a key twice; such requests are
treated as bad JSON, which is the safe side.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardframe.functions.pii import NINE_DIGITS, is_sensitive_key, redact
from guardframe.rules import PROHIBITED_OPERATORS, SECRET_MASK, SENSITIVE_KEYS

# Possessive quantifiers keep Java from recursing once per character on long documents.
_STRING = r'"(?:[^"\\]++|\\.)*+"'
_KEY = rf"({_STRING})\s*+:|{_STRING}"
_VALUE = rf"{_STRING}\s*+:|({_STRING})"
# a control sign, which JSON strings cannot hold unescaped
_BETWEEN = "\x01"
_OPERATOR_KEY = r'[{,]"(?:' + "|".join(re.escape(op) for op in PROHIBITED_OPERATORS) + r')":'
# canonical texts that a document store client would treat as "no filter"
_NO_FILTER = ["{}", "[]", "null", "false", '""']
_ZERO = r"^-?0(?:\.0+)?(?:[eE][+-]?[0-9]+)?$"


def _as_item(text: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))


def _as_field(text: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value; false for null.

    The parser stops behind the first value, so ``1 x`` would pass. Only a single value fits both
    an array and an object: what could close or continue the one is an error in the other.
    """
    return _as_item(text).isNotNull() & _as_field(text).isNotNull()


def canonical_json(text: Column) -> Column:
    """Minified JSON with escapes decoded and keys sorted, or null if the text is not JSON."""
    value = F.try_variant_get(_as_item(text), "$[0]", "variant")
    return F.when(_as_field(text).isNotNull(), F.to_json(value))


def starts_object(text: Column) -> Column:
    """Whether JSON text is an object, by its first sign."""
    return F.coalesce(F.ltrim(text, F.lit(" \t\n\r")).startswith("{"), F.lit(False))


def is_json_object(text: Column) -> Column:
    return is_json(text) & starts_object(text)


def document_text(text: Column) -> Column:
    """Valid JSON on one line in document order: ``, `` and ``: `` between, escapes decoded.

    Strings without a backslash stay as they are; the others are read and written again.
    """
    def written(token: Column) -> Column:
        read = F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>")
        again = F.to_json(read)
        again = F.substring(again, F.lit(2), F.length(again) - 2)
        between = F.replace(F.replace(token, F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": "))
        return F.when(~token.startswith('"'), between).when(token.contains("\\"), again).otherwise(token)

    tokens = F.regexp_extract_all(text, F.lit(rf'({_STRING}|[^"\s]++)'), F.lit(1))
    return F.array_join(F.transform(tokens, written), "")


def is_empty_filter(canonical: Column) -> Column:
    """Whether a parsed filter selects everything: empty, null, false or zero."""
    return canonical.isin(_NO_FILTER) | canonical.rlike(_ZERO)


def _literals(text: Column, pattern: str) -> Column:
    # every string is matched whole, the unwanted ones outside the group
    return F.array_remove(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), "")


def _decoded(literals: Column) -> Column:
    return F.from_json(F.concat(F.lit("["), F.array_join(literals, ","), F.lit("]")), "array<string>")


def json_strings(text: Column) -> Column:
    """All string values of a JSON text at any depth, in document order (no keys)."""
    return _decoded(_literals(text, _VALUE))


def json_keys(text: Column) -> Column:
    """All keys of a JSON text at any depth, in document order."""
    return _decoded(_literals(text, _KEY))


def string_leaves(text: Column) -> Column:
    """String values joined by ``" | "``; the text must be valid JSON.

    Without escapes the literals are their own values, and only their quotes have to go.
    """
    joined = F.concat(F.lit(_BETWEEN), F.array_join(_literals(text, _VALUE), _BETWEEN), F.lit(_BETWEEN))
    plain = F.replace(joined, F.lit(f'"{_BETWEEN}"'), F.lit(" | "))
    for edge in (f'{_BETWEEN}"', f'"{_BETWEEN}', _BETWEEN):
        plain = F.replace(plain, F.lit(edge), F.lit(""))
    escaped = F.array_join(json_strings(text), " | ")
    return F.when(text.contains("\\"), escaped).otherwise(plain)


def prohibited_operator(text: Column, canonical: Column) -> Column:
    """First prohibited key in document order, or null.

    The canonical text decides: escapes such as ``\\u0024where`` are decoded there, and the sign
    before the key keeps quoted text inside values from matching. Only hits look for the order.
    """
    found = F.filter(json_keys(text), lambda key: key.isin(PROHIBITED_OPERATORS))
    return F.when(canonical.rlike(_OPERATOR_KEY), F.get(found, F.lit(0)))


_TEXT = r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
_BLANK = r"[ \t\n\r]*+"
# A key with its colon, and one token of JSON text: an opening sign; or a closing one, a string or
# another scalar, with the comma behind it. ``NaN`` and infinities pass as scalars.
_MEMBER = re.compile(rf"{_BLANK}({_TEXT}){_BLANK}:")
_TOKEN = re.compile(
    rf"{_BLANK}(?:([{{\[])|(?:([}}\]])|({_TEXT})|"
    rf"(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null|NaN|-?Infinity)){_BLANK}(,?+))")
_MASKED = f'"{SECRET_MASK}"'
# what a token may be at each place of a document
_VALUE_AT, _FIRST_ITEM, _KEY_AT, _FIRST_KEY, _AFTER, _END = range(6)


def _read_string(literal: str) -> str:
    """The value of a string literal; the literal's inside where it has no value in Unicode."""
    if "\\" not in literal:
        return literal[1:-1]
    value = json.loads(literal)
    return literal[1:-1] if any("\ud800" <= sign <= "\udfff" for sign in value) else value


def segments(text: str) -> list[tuple[str, str | None]] | None:
    """JSON text in pieces (raw, value): the pieces' raw texts are the document without secrets.

    ``value`` is that of a string that may hold personal data, and null for pieces to leave alone.
    Keys, numbers, blanks and repeated keys stay as they are; the values of secret keys, of any
    shape, are already masked. Null if the text is not JSON. Depth is bounded by memory only.
    """
    out: list[tuple[str, str | None]] = []
    shut: list[str] = []  # closing signs of the open containers
    kept = at = 0
    place, secret, hidden = _VALUE_AT, False, None
    while place != _END:
        if place in (_KEY_AT, _FIRST_KEY) and (key := _MEMBER.match(text, at)):
            secret, at, place = is_sensitive_key(_read_string(key[1])), key.end(), _VALUE_AT
            continue
        token = _TOKEN.match(text, at)
        if token is None:
            return None
        at = token.end()
        opening, closing, literal, scalar, comma = token.groups()
        if closing:
            if not (shut and closing == shut[-1] and place in (_AFTER, _FIRST_KEY if closing == "}" else _FIRST_ITEM)):
                return None
            shut.pop()
            end = token.end(2)
        elif place in (_VALUE_AT, _FIRST_ITEM):
            start, end = token.span(1 if opening else 3 if literal else 4)
            if secret and hidden is None:
                hidden = len(shut)
                out.append((text[kept:start], None))
            secret = False
            if opening:
                shut.append("}" if opening == "{" else "]")
                place = _FIRST_KEY if opening == "{" else _FIRST_ITEM
                continue
            if literal and hidden is None:
                out += [(text[kept:start], None), (literal, _read_string(literal))]
                kept = end
        else:
            return None
        # a value is complete
        if hidden == len(shut):
            out.append((_MASKED, None))
            kept, hidden = end, None
        if not comma:
            place = _AFTER if shut else _END
        elif shut:
            place = _KEY_AT if shut[-1] == "}" else _VALUE_AT
        else:
            return None
    rest = text[at:]
    return None if rest.strip(" \t\n\r") else [*out, (text[kept:], None)]


# what a mask can change; of the digits of other scripts Python knows all that Java does
_MAY_CHANGE = re.compile(r"@|\d(?:[-.()\s]*+\d){8}")
# Values are joined by a sign that no pattern takes for a digit, letter, blank or mask sign, so a
# match never spans two of them. Where a value holds the sign, two others stand for it.
_ESCAPE = "\x02"


def _parts(text: str | None, strings: bool) -> tuple[str | None, str | None, str | None]:
    """A document cut at the string values that a mask may change: (rest, literals, values).

    Each is joined by a sign that valid JSON text cannot hold. Without such values, ``rest`` is the
    whole document. Text that is no document is one value and has no rest.
    """
    found = None if text is None else segments(text)
    if found is None:
        if text is not None and text.lstrip(" \t\n\r\ufeff").startswith(("{", "[")):
            # what begins like a document but cannot be read may hold secrets anywhere
            return SECRET_MASK, None, None
        return None, None, text if strings else None
    rest, literals, values = [], [], []
    for raw, value in found:
        if strings and value is not None and _MAY_CHANGE.search(value):
            literals.append(raw)
            values.append(value.replace(_ESCAPE, _ESCAPE + "#").replace(_BETWEEN, _ESCAPE + "!"))
            rest.append(_BETWEEN)
        else:
            rest.append(raw)
    if not values:
        return "".join(rest), None, None
    return "".join(rest), _BETWEEN.join(literals), _BETWEEN.join(values)


_PARTS = ["rest", "literals", "values"]


def _parts_of(strings: bool):
    @F.pandas_udf(T.StructType([T.StructField(name, T.StringType()) for name in _PARTS]))
    def parts(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_parts(text, strings) for text in texts], columns=_PARTS, dtype=object)

    return parts


def redact_json(text: Column | str, strings: bool = True) -> Column:
    """Redact JSON documents whose keys are not known.

    Only string values that a mask changes and the values of secret keys are replaced; all other
    bytes stay. Text that is not JSON is redacted as text, or masked whole if it begins like a
    document. Secret keys may hold values of any shape, which no expression can walk without a
    schema, so Python cuts the values that a mask may change out of the text, where something in it
    asks for that; the masks are the same expressions as everywhere, and run once over all values
    of a document. ``strings=False`` masks secret keys only.
    """
    text = F.col(text) if isinstance(text, str) else text
    secret = F.lower(text).rlike("|".join(map(re.escape, SENSITIVE_KEYS)))
    asks = secret | text.contains("\\")
    if strings:
        asks = asks | text.contains("@") | text.rlike(NINE_DIGITS)
    parts = _parts_of(strings)(F.when(asks, text))
    rest, literals, values = (parts[name] for name in _PARTS)
    clean = redact(values)

    def pieces(joined: Column) -> Column:
        return F.split(joined, _BETWEEN)

    def quoted(value: Column) -> Column:
        value = F.replace(value, F.lit(_ESCAPE + "!"), F.lit(_BETWEEN))
        again = F.to_json(F.struct(F.replace(value, F.lit(_ESCAPE + "#"), F.lit(_ESCAPE)).alias("v")))
        return F.substring(again, F.lit(6), F.length(again) - 6)

    # a value that no mask changes keeps its literal
    changed = F.zip_with(pieces(values), pieces(clean), lambda was, now: F.when(was != now, quoted(now)))
    written = F.zip_with(changed, pieces(literals), lambda now, literal: F.coalesce(now, literal))
    filled = F.zip_with(pieces(rest), written, lambda raw, value: F.concat(raw, F.coalesce(value, F.lit(""))))
    whole = F.when(rest.isNull(), clean).when(values.isNull(), rest).otherwise(F.array_join(filled, ""))
    return F.coalesce(whole, text)
