"""Changes to the values of many objects at once, given as tables (2.G: G9-G12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import wide
from .difference import value_text
from .model import VALUES, Model

COLUMNS = ("mrid", "attr", "ord", *VALUES, "lex", "profiles")


def values_table(rows: DataFrame) -> DataFrame:
    """``rows`` (mrid, attr and any of the value columns) with all columns of slots; ``profiles`` is 0 (no file) unless given, and kind follows from the column that has a value."""
    types = {"v_bool": "boolean", "v_int": "long", "v_dbl": "double", "v_text": "string", "v_ref": "string", "lex": "string"}
    full = reduce(lambda df, c: df if c in df.columns else df.withColumn(c, F.lit(None).cast(types[c])), types, rows)
    kind = F.when(F.col("v_bool").isNotNull(), "bool").when(F.col("v_int").isNotNull(), "int").when(F.col("v_dbl").isNotNull(), "dbl").when(F.col("v_ref").isNotNull(), "ref").otherwise("text")
    full = full if "kind" in full.columns else full.withColumn("kind", kind)
    full = full if "profiles" in full.columns else full.withColumn("profiles", F.lit(0).cast("long"))
    return full if "ord" in full.columns else full.withColumn("ord", (F.row_number().over(Window.partitionBy("mrid", "attr").orderBy(value_text())) - 1).cast("int"))


def put(m: Model, rows: DataFrame) -> Model:
    """Set: the given values replace all of their object's attribute. Objects that aren't there are not made."""
    new = values_table(rows).select(*COLUMNS).join(wide(m.objects.select("mrid")), "mrid", "left_semi")
    kept = m.slots.join(wide(new.select("mrid", "attr").distinct()), ["mrid", "attr"], "left_anti")
    return m.with_(slots=kept.select(*COLUMNS).unionByName(new.select(*COLUMNS)))


def push(m: Model, rows: DataFrame) -> Model:
    """Push: the given values come after those that their object's attribute has."""
    new = values_table(rows).join(wide(m.objects.select("mrid")), "mrid", "left_semi")
    last = m.slots.join(wide(new.select("mrid", "attr").distinct()), ["mrid", "attr"], "left_semi").groupBy("mrid", "attr").agg((F.max("ord") + 1).alias("_next"))
    placed = new.join(wide(last), ["mrid", "attr"], "left").withColumn("ord", (F.col("ord") + F.coalesce("_next", F.lit(0))).cast("int"))
    return m.with_(slots=m.slots.select(*COLUMNS).unionByName(placed.select(*COLUMNS)))


def remove(m: Model, gone: DataFrame) -> Model:
    """Remove all values of the given attributes (mrid, attr)."""
    return m.with_(slots=m.slots.join(wide(gone.select("mrid", "attr")), ["mrid", "attr"], "left_anti"))


def remove_values(m: Model, rows: DataFrame) -> Model:
    """Remove the values of an attribute that equal a given one, whatever their spelling; those after move up."""
    gone = values_table(rows).select("mrid", "attr", "kind", value_text().alias("_value")).distinct()
    kept = m.slots.withColumn("_value", value_text()).join(wide(gone), ["mrid", "attr", "kind", "_value"], "left_anti").drop("_value")
    return m.with_(slots=kept.withColumn("ord", (F.row_number().over(Window.partitionBy("mrid", "attr").orderBy("ord")) - 1).cast("int")))


def set_headers(heads: DataFrame, new: DataFrame) -> DataFrame:
    """Headers with those of ``new`` in place of the ones of their files, or beside them."""
    return heads.join(new.select("file"), "file", "left_anti").unionByName(new, allowMissingColumns=True)


def add_members(m: Model, rows: DataFrame) -> Model:
    """Say that files have objects (file_seq, mrid); each pair counts once."""
    return m.with_(members=rows.select("file_seq", "mrid").distinct() if m.members is None else m.members.select("file_seq", "mrid").union(rows.select("file_seq", "mrid")).distinct())
