"""XML names, characters and escapes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ILLEGAL = r"[^\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"
NAME_START = r"A-Z_a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2FF}\x{370}-\x{37D}\x{37F}-\x{1FFF}\x{200C}-\x{200D}\x{2070}-\x{218F}\x{2C00}-\x{2FEF}\x{3001}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFFD}\x{10000}-\x{EFFFF}"
NCNAME = rf"^[{NAME_START}][{NAME_START}\-.0-9\x{{B7}}\x{{300}}-\x{{36F}}\x{{203F}}-\x{{2040}}]*$"
ABSOLUTE_IRI = r"^[A-Za-z][A-Za-z0-9+.-]*:[^\x{0}-\x{20}<>\"{}|\\^`#]+(#[^\x{0}-\x{20}<>\"{}|\\^`#]*)?$"


def has_illegal(text: Column) -> Column:
    return text.rlike(ILLEGAL)


def illegal_offset(text: Column) -> Column:
    """Byte offset of the first character that XML forbids; null without one."""
    at = F.regexp_instr(text, F.lit(ILLEGAL))
    return F.when(at > 0, F.octet_length(F.substring(text, F.lit(1), at - 1)))


def strip_illegal(text: Column) -> Column:
    return F.when(has_illegal(text), F.regexp_replace(text, ILLEGAL, "")).otherwise(text)


def describe_char(c: Column) -> Column:
    return F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), 4, "0"))


def is_ncname(text: Column) -> Column:
    return text.rlike(NCNAME)


def is_absolute_iri(text: Column) -> Column:
    return text.rlike(ABSOLUTE_IRI)


def identifier_form(text: Column) -> Column:
    """name, iri or unwritable: how an identifier can stand in a document."""
    prefixed = F.concat(F.lit("_"), text)
    return F.when((F.length(text) > 0) & is_ncname(prefixed), "name").when(is_absolute_iri(text), "iri").otherwise("unwritable")


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_text(text: Column) -> Column:
    return _replaced(text, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")])


def escape_attribute(text: Column) -> Column:
    return _replaced(text, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")])


def unescape(text: Column) -> Column:
    """The five predefined entities and numbered characters; unknown entities and numbers that are no character stay."""
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(?:[0-9]{1,7}|x[0-9a-fA-F]{1,6});"), 0))

    def character(ref: Column) -> Column:
        code = F.when(ref.startswith("&#x"), F.conv(F.regexp_extract(ref, "x([^;]*)", 1), 16, 10)).otherwise(F.regexp_extract(ref, "([0-9]+)", 1)).cast("int")
        fine = ((code >= 32) & (code < 0xD800)) | code.isin(9, 10, 13) | ((code >= 0xE000) & (code < 0xFFFE)) | ((code >= 0x10000) & (code < 0x110000))
        return F.when(code == 38, "&amp;").when(fine, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(ref)

    plain = F.when(F.size(numbers) > 0, F.aggregate(numbers, text, lambda t, ref: F.replace(t, ref, character(ref)))).otherwise(text)
    entities = _replaced(plain, [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")])
    return F.when(text.contains("&"), entities).otherwise(text)  # most texts have none


def line_and_column(text: Column, offset: Column) -> Column:
    """STRUCT<line, col> of a byte offset, both from 1, columns in bytes."""
    head = F.decode(F.substring(F.encode(text, "utf-8"), F.lit(1), offset), "ISO-8859-1")  # a character for each byte
    return F.struct(F.size(F.split(head, "\n")).alias("line"), (F.length(F.substring_index(head, "\n", -1)) + 1).alias("col"))
