"""Compounds of any depth. A value inside a compound has a path in ``attr``: its property, the fields around it and its own, ``Property/Field/Field``.

The distinct paths of a model are few, bounded by its vocabulary; they are judged step by step, and the judgement is joined to the values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vocabulary import Vocabulary


def root(attr: Column | str = "attr") -> Column:
    return F.substring_index(attr, "/", 1)


def leaf(attr: Column | str = "attr") -> Column:
    return F.substring_index(attr, "/", -1)


def above(attr: Column | str = "attr") -> Column:
    """The path of the compound around a value; empty for one in none."""
    return F.substring(attr, F.lit(1), F.length(attr) - F.length(leaf(attr)) - 1)


def inside(attr: str = "attr") -> Column:
    return F.contains(F.col(attr), F.lit("/"))


def steps(attr: Column | str = "attr") -> Column:
    return F.split(attr, "/")


def holders(attr: Column | str = "attr") -> Column:
    """The names of the compounds around a value, outermost first."""
    return F.slice(steps(attr), F.lit(1), F.size(steps(attr)) - 1)


def judged(slots: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """attr, place and message of what is wrong with the distinct paths in ``slots``, and ``rule``.

    ``class-membership``: the compound around a step, or what stands there and is none, has no such field; ``datatype``: a step with fields inside is no compound. ``place`` is the path of that step.
    """
    name = steps()
    pairs = F.transform(F.sequence(F.lit(1), F.size(name) - 1), lambda i: F.struct(F.array_join(F.slice(name, F.lit(1), i), "/").alias("above"), F.element_at(name, i).alias("parent"), F.array_join(F.slice(name, F.lit(1), i + 1), "/").alias("place"), F.element_at(name, i + 1).alias("child")))
    each = slots.where(inside()).select("attr").distinct().select("attr", F.inline(pairs))
    known = F.broadcast(vocabulary.attrs.select(F.col("attr").alias("parent"), F.col("kind").alias("_kind"), "primitive", F.col("target").alias("class")))
    fields = F.broadcast(vocabulary.class_attrs().select("class", F.col("attr").alias("child"), F.lit(True).alias("_has")))
    told = each.join(known, "parent", "left").join(fields, ["class", "child"], "left")
    known_step, no_compound = F.col("_kind").isNotNull(), F.coalesce(F.col("_kind"), F.lit("")) != "compound"
    mismatch = told.where(known_step & no_compound).select("attr", F.lit("datatype").alias("rule"), F.col("above").alias("place"), F.concat(F.lit("compound for "), F.coalesce("primitive", "_kind")).alias("message"))
    foreign = told.where(known_step & (no_compound | F.col("_has").isNull())).select("attr", F.lit("class-membership").alias("rule"), "place", F.concat(F.when(no_compound, F.col("parent")).otherwise(F.col("class")), F.lit(" has no "), "child").alias("message"))
    return mismatch.union(foreign).distinct()


def shared(one: Column, other: Column) -> Column:
    """How many leading elements two arrays share."""
    same = F.zip_with(one, other, lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, False)
    return F.when(at == 0, F.size(same)).otherwise(at - 1).cast("int")


def nested(items: Column, begin: Callable[[Column], Column], end: Callable[[Column], Column], between: Callable[[Column, Column], Column] | None = None) -> Column:
    """The lines of ``items`` (holders, line), which are sorted by path, with the lines that begin and end each compound around them.

    ``between`` (index, line) changes a line that isn't alone; compounds that an item shares with the one before stay open.
    """
    none = F.array().cast("array<string>")
    tail = lambda names, kept: F.slice(names, kept + 1, F.size(names) - kept)

    def one(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.element_at(items, F.greatest(i, F.lit(1)))["holders"]).otherwise(none)
        kept = shared(before, x["holders"])
        begun = F.concat(F.transform(tail(x["holders"], kept), begin), F.array(x["line"]))
        if between is not None:
            begun = F.concat(F.array(between(i, F.element_at(begun, 1))), F.slice(begun, F.lit(2), F.size(begun) - 1))
        return F.concat(F.transform(F.reverse(tail(before, kept)), end), begun)

    last = F.when(F.size(items) > 0, F.element_at(items, -1)["holders"]).otherwise(none)
    plain = F.forall(items, lambda x: F.size(x["holders"]) == 0) if between is None else F.lit(False)
    return F.when(plain, F.transform(items, lambda x: x["line"])).otherwise(F.concat(F.flatten(F.transform(items, one)), F.transform(F.reverse(last), end)))
