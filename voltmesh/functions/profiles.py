"""Provenance masks: which profiles a value belongs to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask(index: int) -> int:
    """The bit of a profile as a signed long; the last one is the sign."""
    if not 0 <= index < 64:
        raise ValueError("a profile mask has 64 bits")
    return (1 << index) - ((1 << 64) if index == 63 else 0)


def effective(provenance: Column, used_in: Column) -> Column:
    """Where a value is exported: its provenance within the declaration, its provenance where they don't meet, the declaration where there is none."""
    both = provenance.bitwiseAND(used_in)
    return F.when(both != 0, both).when(provenance != 0, provenance).otherwise(used_in)


def in_scope(provenance: Column, used_in: Column, scope: Column) -> Column:
    return effective(provenance, used_in).bitwiseAND(scope) != 0


def covers(provenance: Column, used_in: Column) -> Column:
    return (provenance == 0) | (provenance.bitwiseAND(used_in) != 0)


def bits(masks: Column, profiles: int = 64) -> Column:
    """The set bits of a mask as an array of profile numbers."""
    return F.filter(F.sequence(F.lit(0), F.lit(profiles - 1)), lambda i: F.call_function("shiftright", masks, i).bitwiseAND(F.lit(1)) == 1)


def stem(iri: Column) -> Column:
    """A profile IRI without its version."""
    return F.regexp_replace(iri, "/[^/]*$", "")
