"""Typed values from their texts, and their texts again."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLAIN_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
FORTRAN_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)[dD][+-]?[0-9]+$"
COMMA_FLOAT = r"^[+-]?[0-9]*,[0-9]+([eE][+-]?[0-9]+)?$"
GROUPED = r"^[+-]?[0-9]{1,3}(,[0-9]{3})+$"
SPECIAL = r"^[+-]?(INF|NaN)$"

#: The XSD type of each primitive.
XSD = {"Integer": "integer", "Float": "float", "Decimal": "decimal", "Boolean": "boolean", "Date": "date", "DateTime": "dateTime", "MonthDay": "gMonthDay", "Time": "time", "Duration": "duration", "URI": "anyURI"}


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_boolean(text: Column) -> Column:
    t = trimmed(text)
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)


def parse_float(text: Column) -> Column:
    """A double: plain, with a Fortran exponent, or with a decimal comma where it can't be a grouping comma; null otherwise."""
    t = trimmed(text)
    special = F.when(t.rlike("NaN"), float("nan")).when(t.startswith("-"), float("-inf")).otherwise(float("inf"))
    return (
        F.when(t.rlike(SPECIAL), special)
        .when(t.rlike(PLAIN_FLOAT), t.try_cast("double"))
        .when(t.rlike(FORTRAN_FLOAT), F.regexp_replace(t, "[dD]", "E").try_cast("double"))
        .when(t.rlike(COMMA_FLOAT) & ~t.rlike(GROUPED), F.replace(t, F.lit(","), F.lit(".")).try_cast("double"))
    )


def parse_integer(text: Column) -> Column:
    """A long; a float's text counts with its fraction cut off."""
    t = trimmed(text)
    return F.when(t.rlike(r"^[+-]?[0-9]{1,18}$"), t.try_cast("long")).otherwise(F.when(t.rlike(PLAIN_FLOAT), t.try_cast("double")).try_cast("long"))


def parse_primitive(text: Column, primitive: Column) -> Column:
    """STRUCT<v_bool, v_int, v_dbl, v_text, ok> by the declared primitive; strings aren't trimmed."""
    b, i, d = parse_boolean(text), parse_integer(text), parse_float(text)
    is_b, is_i, is_d = primitive == "Boolean", primitive == "Integer", primitive.isin("Float", "Decimal")
    ok = F.when(is_b, b.isNotNull()).when(is_i, i.isNotNull()).when(is_d, d.isNotNull()).otherwise(text.isNotNull())
    return F.struct(F.when(is_b, b).alias("v_bool"), F.when(is_i, i).alias("v_int"), F.when(is_d, d).alias("v_dbl"), F.when(~(is_b | is_i | is_d), text).alias("v_text"), ok.alias("ok"))


def is_lexical(text: Column, primitive: Column) -> Column:
    """May the spelling be written back as it is? A decimal has no exponent."""
    return F.when(primitive == "Decimal", text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$")).when(primitive == "Float", text.rlike(PLAIN_FLOAT) | text.rlike(r"^(-?INF|NaN)$")).otherwise(F.lit(True))


def canonical_float(value: Column | str) -> Column:
    """The canonical text of a double; null stays null (pandas itself can't tell it from NaN)."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value.isNotNull(), _canonical(value))


@F.pandas_udf(T.StringType())
def _canonical(values: pd.Series) -> pd.Series:
    """Shortest text that reads back: plain from 1e-5 to 1e16, else like 1.5E300; NaN, INF, -INF; minus zero is 0."""

    def one(x: float | None) -> str | None:
        if x is None:
            return None
        if x != x:
            return "NaN"
        if x in (float("inf"), float("-inf")):
            return "INF" if x > 0 else "-INF"
        if x == 0:
            return "0"
        digits, exponent = format_shortest(abs(x))
        sign = "-" if x < 0 else ""
        if not 1e-5 <= abs(x) < 1e16:
            return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}E{exponent}"
        if exponent >= len(digits) - 1:
            return sign + digits + "0" * (exponent - len(digits) + 1)
        if exponent >= 0:
            return f"{sign}{digits[: exponent + 1]}.{digits[exponent + 1 :]}"
        return f"{sign}0.{'0' * (-exponent - 1)}{digits}"

    found = values.notna()  # most rows of a model hold no double
    out = pd.Series("NaN", index=values.index, dtype=object)
    out[found] = values[found].map(one)
    return out


def format_shortest(x: float) -> tuple[str, int]:
    """The shortest digits of a positive number and the power of ten of the first."""
    mantissa, _, exponent = f"{x!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    power = int(exponent or 0) + (len(whole) - 1 if whole.strip("0") else -1 - (len(part) - len(part.lstrip("0"))))
    return digits.rstrip("0") or "0", power


def to_lexical(text: Column, value: Column, primitive: Column) -> Column:
    """The remembered spelling where it is lexical, else the canonical text."""
    return F.when(text.isNotNull() & is_lexical(text, primitive), text).otherwise(canonical_float(value))


def xsd_datatype(primitive: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in XSD.items() for x in kv])
    return F.coalesce(F.element_at(mapping, primitive), F.lit(""))


def as_integer(v_int: Column, v_dbl: Column) -> Column:
    return F.coalesce(v_int, v_dbl.try_cast("long"))


def as_double(v_int: Column, v_dbl: Column) -> Column:
    return F.coalesce(v_dbl, v_int.cast("double"))


def as_boolean(v_bool: Column) -> Column:
    return v_bool


def as_string(kind: Column, v_text: Column) -> Column:
    return F.when(kind == "text", v_text)


def as_enum(kind: Column, v_text: Column) -> Column:
    return F.when(kind == "enum", v_text)


def shape(kind: Column) -> Column:
    """What a stored value is, in words."""
    return F.when(kind == "bool", "a boolean").when(kind == "int", "an integer").when(kind == "dbl", "a number").when(kind == "ref", "a reference").when(kind == "enum", "an enumeration value").when(kind == "compound", "a compound").otherwise("a text")


def fits(primitive: Column, kind: Column) -> Column:
    """May a value of this stored kind stand for the primitive?"""
    return F.when(primitive == "Boolean", kind == "bool").when(primitive == "Integer", kind == "int").when(primitive.isin("Float", "Decimal"), kind.isin("dbl", "int")).otherwise(kind == "text")


def is_many(most: Column, bounded: Column) -> Column:
    """Unbounded and every bounded multiplicity count as many."""
    return most.isNull() | (most > 1) | bounded


def multiplicity(text: Column) -> Column:
    """STRUCT<least, most> of ``M:lo..hi`` or ``M:n``; most is null if unbounded."""
    lo, hi = F.regexp_extract(text, r"M:([0-9]+)", 1), F.regexp_extract(text, r"M:(?:[0-9]+\.\.)?([0-9n*]+)$", 1)
    return F.struct(lo.try_cast("int").alias("least"), hi.try_cast("int").alias("most"))
