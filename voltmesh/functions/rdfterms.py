"""RDF terms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that an IRI can't hold, as a class of a regular expression.
_NO_IRI = r'\x{0}-\x{20}<>"{}|^`\\'


def escape_literal(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_iri(text: Column) -> Column:
    """Characters that an IRI can't hold as ``\\uXXXX``; most texts have none and are left alone.

    Run by run: a call for each character would make code too large to be compiled.
    """
    runs = F.regexp_extract_all(text, F.lit(f"(?s)[{_NO_IRI}]|[^{_NO_IRI}]+"), F.lit(0))
    one = lambda run: F.when(run.rlike(f"[{_NO_IRI}]"), F.concat(F.lit("\\u"), F.lpad(F.hex(F.ascii(run)), 4, "0"))).otherwise(run)
    return F.when(text.rlike(f"[{_NO_IRI}]"), F.array_join(F.transform(runs, one), "")).otherwise(text)


def iri(text: Column) -> Column:
    return F.concat(F.lit("<"), escape_iri(text), F.lit(">"))


def literal(text: Column, datatype: Column) -> Column:
    quoted = F.concat(F.lit('"'), escape_literal(text), F.lit('"'))
    return F.when(datatype == "", quoted).otherwise(F.concat(quoted, F.lit("^^<http://www.w3.org/2001/XMLSchema#"), datatype, F.lit(">")))


def blank_label(text: Column) -> Column:
    """``_:id`` and the text where it is plain, else ``_:x`` and its bytes in hex."""
    return F.when(text.rlike("^[A-Za-z0-9_]+$"), F.concat(F.lit("_:id"), text)).otherwise(F.concat(F.lit("_:x"), F.lower(F.hex(F.encode(text, "utf-8")))))


def split_iri(text: Column) -> Column:
    """STRUCT<namespace, local>: cut after the last ``#`` or ``/``."""
    return F.struct(F.regexp_extract(text, r"^(.*[#/])[^#/]*$", 1).alias("namespace"), F.regexp_extract(text, r"([^#/]*)$", 1).alias("local"))


def is_local_name(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z_][A-Za-z0-9_.-]*$") & ~text.endswith(".")
