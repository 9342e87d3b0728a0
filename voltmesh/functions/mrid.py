"""Master resource identifiers as column expressions.

An identifier is a UUID however it is spelled (a leading ``#``, ``urn:uuid:`` or ``_``, any case, with or without hyphens, or at the end of an
absolute IRI), or opaque text. Equal UUIDs are equal identifiers; the spelling is kept for writing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A UUID, undecorated or after the last ``#`` and one ``_``.
UUID = r"(?i)^\s*(?:#?(?:urn:uuid:)?_?|.*#_?)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{32})\s*$"


def undecorated(text: Column) -> Column:
    """Without white space around it, one ``#``, one ``urn:uuid:`` and one ``_``, in this order."""
    return F.regexp_extract(text, r"(?is)^\s*#?(?:urn:uuid:)?_?(.*?)\s*$", 1)


def hyphenated(uuid: Column) -> Column:
    plain = F.lower(F.regexp_replace(uuid, "-", ""))
    return F.regexp_replace(plain, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", r"$1-$2-$3-$4-$5")


def parse(text: Column) -> Column:
    """STRUCT<is_uuid, key, written, form>; form is uuid, compact or opaque."""
    uuid = F.when(F.length(text) >= 32, F.nullif(F.regexp_extract(text, UUID, 1), F.lit("")))  # shorter texts hold none
    form = F.when(uuid.isNull(), "opaque").when(F.length(uuid) == 32, "compact").otherwise("uuid")
    written = F.coalesce(uuid, undecorated(text))
    return F.struct(uuid.isNotNull().alias("is_uuid"), F.coalesce(hyphenated(uuid), written).alias("key"), written.alias("written"), form.alias("form"))


def is_conforming(mrid: Column) -> Column:
    return mrid["form"] == "uuid"


def complaint(mrid: Column) -> Column:
    """Why an identifier isn't conforming, in words; null if it is."""
    return F.when(mrid["form"] == "compact", F.concat(F.lit("UUID without hyphens: "), mrid["written"])).when(mrid["form"] == "opaque", F.when(F.length(mrid["key"]) == 0, "empty identifier").otherwise(F.concat(F.lit("not a UUID: "), mrid["written"])))


def rdf_id(mrid: Column) -> Column:
    return F.concat(F.lit("_"), mrid["written"])


def rdf_resource(mrid: Column) -> Column:
    return F.concat(F.lit("#_"), mrid["written"])


def urn(mrid: Column) -> Column:
    """``urn:uuid:`` for UUIDs, null otherwise."""
    return F.when(mrid["is_uuid"], F.concat(F.lit("urn:uuid:"), mrid["key"]))


def uuid_v5(namespace_hex: str, name: Column) -> Column:
    """Name-based UUID: SHA-1 of namespace and name, with version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def sort_keys(mrid: Column) -> list[Column]:
    """UUIDs before opaque text, each by bytes."""
    return [mrid["is_uuid"].desc(), mrid["key"].asc()]
