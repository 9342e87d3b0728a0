"""The model as tables: objects, slots and file membership; merging and changing them (2.C-2.G).

``slots`` is a sparse table with one row for each value: mrid, attr, ord, kind, v_bool, v_int, v_dbl, v_text, v_ref, lex and
profiles, a mask of the profiles whose files carried it. A field of a compound has its whole path in ``attr``,
``Property/Field`` or longer. ``raw`` slots, straight from files, also have class, file_seq and
elem_seq, which order them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mrid as M
from ..functions.shared import wide
from . import compounds as C
from .vocabulary import Vocabulary

VALUES = ("kind", "v_bool", "v_int", "v_dbl", "v_text", "v_ref")
SLOTS = "mrid string, attr string, ord int, kind string, v_bool boolean, v_int long, v_dbl double, v_text string, v_ref string, lex string, profiles long"


def value_key() -> Column:
    """A value's identity without its spelling: kind and content."""
    return F.struct("kind", "v_bool", "v_int", "v_dbl", "v_text", "v_ref")


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    objects: DataFrame  # mrid, class, profiles
    slots: DataFrame
    members: DataFrame | None = None  # file_seq, mrid, seq

    def with_(self, **changes) -> Model:
        return replace(self, **changes)

    # navigation
    def of_class(self, name: str, exact: bool = False) -> DataFrame:
        """Objects of a class and its subclasses. The names are a list in the plan, so partition and row-group pruning apply."""
        if exact:
            return self.objects.where(F.col("class") == name)
        names = [r[0] for r in self.vocabulary.closure().where(F.col("ancestor") == name).select("class").collect()]
        return self.objects.where(F.col("class").isin(names))

    def view(self, name: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
        """One row for each object of a class: mrid, class, and ``columns`` (name: attribute and value column). Many-valued ones give their first."""
        picked = self.slots.where(F.col("attr").isin([a for a, _ in columns.values()])).where("ord = 0")
        columns_of = picked.groupBy("mrid").agg(*(F.max(F.when(F.col("attr") == a, F.col(v))).alias(c) for c, (a, v) in columns.items()))
        return self.of_class(name).select("mrid", "class").join(wide(columns_of), "mrid", "left")

    def find(self, mrids: list[str]) -> DataFrame:
        """Objects by identifier, however it is spelled."""
        keys = self.objects.sparkSession.createDataFrame([(x,) for x in mrids], "written string").select(M.parse(F.col("written"))["key"].alias("mrid")).distinct()
        return self.objects.join(F.broadcast(keys), "mrid", "left_semi")  # the caller's own list

    def of_file(self, file_seq: int) -> DataFrame:
        """Objects that a file names and that are still there (D3)."""
        return self.objects.join(wide(self.members.where(F.col("file_seq") == file_seq).select("mrid")), "mrid", "left_semi")

    def field(self, attr: str, *names: str) -> DataFrame:
        """The values of one field of a compound, or of compounds within it."""
        return self.values("/".join((attr, *names)))

    def display(self) -> DataFrame:
        """mrid, attr, ord and text of every value for people: a compound is ``{field=value, field={...}, ...}``, its fields by name."""
        text = F.coalesce("v_ref", "v_text", "lex", F.col("v_int").cast("string"), F.col("v_dbl").cast("string"), F.col("v_bool").cast("string"))
        rows = self.slots.select("mrid", "attr", "ord", text.alias("text"))
        item = F.struct("attr", F.expr("slice(split(attr, '/'), 2, size(split(attr, '/')) - 2)").alias("holders"), F.concat_ws("=", C.leaf(), "text").alias("line"))
        per = rows.where(C.inside()).groupBy("mrid", C.root().alias("root")).agg(F.array_sort(F.collect_list(item)).alias("items"))
        parts = C.nested(F.col("items"), lambda name: F.concat(name, F.lit("={")), lambda _: F.lit("}"), lambda i, line: F.concat(F.when(i > 0, ", ").otherwise(""), line))
        inner = per.select("mrid", F.col("root").alias("attr"), F.lit(0).alias("ord"), F.concat(F.lit("{"), F.array_join(parts, ""), F.lit("}")).alias("text"))
        return rows.where(~C.inside()).unionByName(inner)

    def values(self, attr: str) -> DataFrame:
        return self.slots.where(F.col("attr") == attr)

    def follow(self, attr: str) -> DataFrame:
        """mrid, ord, target and its class, for references that resolve."""
        return self.values(attr).select("mrid", "ord", F.col("v_ref").alias("target")).join(wide(self.objects.select(F.col("mrid").alias("target"), F.col("class").alias("target_class"))), "target")

    def references(self) -> DataFrame:
        return self.slots.where("kind = 'ref'").select("mrid", "attr", "ord", F.col("v_ref").alias("target"))

    def referrers(self, attr: str, target: str) -> DataFrame:
        return self.references().where((F.col("attr") == attr) & (F.col("target") == target)).select("mrid")

    def inverse_of(self, attr: str) -> DataFrame:
        """mrid and referrer over the other end of an association: what refers to each object by the inverse of ``attr`` (E5)."""
        other = self.vocabulary.inverses.where(F.col("attr") == attr).select(F.col("inverse").alias("attr"))
        return self.references().join(F.broadcast(other), "attr").select(F.col("target").alias("mrid"), F.col("mrid").alias("referrer"))

    def inverse_index(self) -> DataFrame:
        """target, attr and how many refer to it: edges grouped by target, counted before the shuffle."""
        return self.references().groupBy("target", "attr").agg(F.count("*").alias("referrers"), F.min("mrid").alias("first"))

    def dangling(self) -> DataFrame:
        return self.references().join(wide(self.objects.select(F.col("mrid").alias("target"))), "target", "left_anti")

    def check_links(self) -> None:
        first = self.dangling().agg(F.count("*").alias("n"), F.min("target").alias("target")).first()
        if first.n:
            raise ValueError(f"{first.n} dangling references, among them {first.target}")

    def identifiers(self, other: Model) -> DataFrame:
        """Identifiers of either model, once each (I4)."""
        return self.objects.select("mrid").union(other.objects.select("mrid")).distinct()

    def id_styles(self, scope: int) -> DataFrame:
        """mrid and style: ``rdf:ID`` where an export of ``scope`` (0: everything) introduces the object, else ``rdf:about``.

        A profile set introduces objects of the classes it defines, and of those that none of its profiles mentions.
        """
        told = lambda c: F.col(c).bitwiseAND(F.lit(scope)) != 0
        style = F.when(F.lit(scope == 0) | told("defined_in") | ~told("_mentioned"), "rdf:ID").otherwise("rdf:about")
        classes = self.vocabulary.classes.select("class", "defined_in", F.col("profiles").alias("_mentioned"))
        return self.objects.join(F.broadcast(classes), "class").select("mrid", style.alias("style"))

    def class_counts(self) -> DataFrame:
        """Objects of each class, subclasses included."""
        own = self.objects.groupBy("class").agg(F.count("*").alias("n"))
        return own.join(F.broadcast(self.vocabulary.closure()), "class").groupBy("ancestor").agg(F.sum("n").alias("n"))

    # changes
    def remove(self, gone: DataFrame) -> Model:
        return self.with_(objects=self.objects.join(wide(gone), "mrid", "left_anti"), slots=self.slots.join(wide(gone), "mrid", "left_anti"))

    def prune_empty(self) -> Model:
        return self.with_(objects=self.objects.join(wide(self.slots.select("mrid").distinct()), "mrid", "left_semi"))

    def reclassify(self, to: DataFrame) -> tuple[Model, DataFrame]:
        """The model with new classes (mrid, class), and the slots it sheds: those whose owner isn't an ancestor of the new class."""
        new = to.select("mrid", F.col("class").alias("_new"))
        objects = self.objects.join(new, "mrid", "left").withColumn("class", F.coalesce("_new", "class")).drop("_new")
        changed = self.slots.join(new, "mrid")
        owned = self.vocabulary.class_attrs().select(F.col("class").alias("_new"), F.col("attr").alias("_root"))
        shed = changed.withColumn("_root", C.root()).join(F.broadcast(owned), ["_new", "_root"], "left_anti").drop("_new", "_root")
        kept = self.slots.join(wide(shed.select("mrid", "attr").distinct()), ["mrid", "attr"], "left_anti")
        return self.with_(objects=objects, slots=kept), shed

    def in_profiles(self, scope: int) -> DataFrame:
        """The slots that a profile set exports."""
        from ..functions import profiles as P

        used = F.broadcast(self.vocabulary.attrs.select(F.col("attr").alias("_root"), "used_in"))
        return self.slots.withColumn("_root", F.substring_index("attr", "/", 1)).join(used, "_root").drop("_root").where(P.in_scope(F.col("profiles"), F.col("used_in"), F.lit(scope))).drop("used_in")


def merge_slots(raw: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Slots of many files as one model.

    A single-valued attribute takes the last value in (file_seq, elem_seq), with the masks of all its rows or-ed; the first spelling of
    an equal value stays. A many-valued one keeps each distinct value once, in order of first appearance.
    """
    many = F.broadcast(vocabulary.attrs.select("attr", (F.col("most").isNull() | (F.col("most") > 1)).alias("many")))
    order = F.struct("file_seq", "elem_seq")
    same = raw.join(many, "attr", "left").groupBy("mrid", "attr", F.coalesce("many", F.lit(False)).alias("many"), *VALUES).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.bit_or("profiles").alias("profiles"), F.min_by("lex", order).alias("lex"))
    w = Window.partitionBy("mrid", "attr")
    numbered = same.withColumns({"n": F.row_number().over(w.orderBy(F.desc("last"))), "ord": F.row_number().over(w.orderBy("first")) - 1, "all": F.bit_or("profiles").over(w)})
    kept = numbered.where(F.col("many") | (F.col("n") == 1))
    return kept.select("mrid", "attr", F.when(F.col("many"), F.col("ord")).otherwise(0).alias("ord"), *VALUES, "lex", F.when(F.col("many"), F.col("profiles")).otherwise(F.col("all")).alias("profiles"))


def conflicts(raw: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Each value that replaced a different one of a single-valued attribute: mrid, attr, discarded, kept."""
    single = raw.join(F.broadcast(vocabulary.attrs.where("most = 1").select("attr")), "attr", "left_semi")
    w = Window.partitionBy("mrid", "attr").orderBy("file_seq", "elem_seq")
    return single.withColumns({"kept": value_key(), "discarded": F.lag(value_key()).over(w)}).where("discarded is not null and discarded <> kept").select("mrid", "attr", "file_seq", "elem_seq", "discarded", "kept")


def capped(findings: DataFrame, most: int, *order: str) -> DataFrame:
    """The first ``most`` findings in order, with how many were left out in ``dropped``.

    One pass: each task keeps its first ``most`` and counts the rest, and only those meet. Tasks that run again leave one result each, so the count is right.
    """
    from ..functions.shared import cut

    def first(batches):
        held, n = None, 0
        keys = [(c, "ascending") for c in order]

        def least(table: pa.Table) -> pa.Table:
            return table.take(pc.sort_indices(table, sort_keys=keys)[:most])

        for batch in batches:
            n += batch.num_rows
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            if held.num_rows > 2 * most + 10_000:
                held = least(held)
        if held is not None:
            held = least(held)
            told = pa.array([n] + [0] * (held.num_rows - 1), pa.int64())
            yield from held.append_column("_seen", told).to_batches() if held.num_rows else pa.table({**{c: pa.nulls(1, held.schema.field(c).type) for c in held.column_names}, "_seen": pa.array([n])}).to_batches()

    from pyspark.sql.types import LongType, StructType

    few = cut(findings.mapInArrow(first, StructType([*findings.schema.fields]).add("_seen", LongType())))
    total = few.agg(F.sum("_seen")).first()[0] or 0
    return few.drop("_seen").orderBy(*(F.asc_nulls_last(c) for c in order)).limit(most).withColumn("dropped", F.lit(max(0, total - most)))


def merge_classes(raw_objects: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """mrid, class, profiles and ``collision``: an object takes the most derived class; one unrelated to it keeps the first.

    The classes that files name for one object are few; they are folded in order, each step against the closure's pairs.
    """
    pairs = vocabulary.closure().agg(F.collect_set(F.concat_ws(">", "class", "ancestor")).alias("is_a"))
    named = raw_objects.groupBy("mrid", "class").agg(F.min(F.struct("file_seq", "elem_seq")).alias("at"), F.bit_or("profiles").alias("profiles"))
    per = named.groupBy("mrid").agg(F.array_sort(F.collect_list(F.struct("at", "class"))).alias("seen"), F.bit_or("profiles").alias("profiles")).crossJoin(F.broadcast(pairs))  # one row
    start = F.struct(F.element_at("seen", 1)["class"].alias("class"), F.lit(False).alias("collision"))

    def step(acc: Column, x: Column) -> Column:
        narrower = F.array_contains("is_a", F.concat_ws(">", x["class"], acc["class"]))
        wider = F.array_contains("is_a", F.concat_ws(">", acc["class"], x["class"]))
        return F.struct(F.when(narrower, x["class"]).otherwise(acc["class"]).alias("class"), (acc["collision"] | ~(narrower | wider)).alias("collision"))

    return per.select("mrid", F.aggregate("seen", start, step).alias("s"), "profiles").select("mrid", "s.class", "profiles", "s.collision")


def merge(models: list[Model]) -> Model:
    """Models of one vocabulary, in order, as one."""
    raw, objects = None, None
    for i, m in enumerate(models):
        r = m.slots.withColumns({"file_seq": F.lit(i), "elem_seq": F.col("ord").cast("long")})
        o = m.objects.withColumns({"file_seq": F.lit(i), "elem_seq": F.lit(0).cast("long")})
        raw, objects = (r, o) if raw is None else (raw.unionByName(r), objects.unionByName(o))
    v = models[0].vocabulary
    return Model(v, merge_classes(objects, v).drop("collision"), merge_slots(raw, v))


def element_class(objects: DataFrame, slots: DataFrame, vocabulary: Vocabulary, scope: int) -> DataFrame:
    """mrid and the class an export names: the nearest ancestor declared in ``scope`` whose required attributes the object all has."""
    declared = vocabulary.classes.where(F.col("profiles").bitwiseAND(F.lit(scope)) != 0).select(F.col("class").alias("ancestor"))
    required = vocabulary.class_attrs().where((F.col("least") > 0) & (F.col("used_in").bitwiseAND(F.lit(scope)) != 0)).select(F.col("class").alias("ancestor"), "attr")
    needs = required.groupBy("ancestor").agg(F.collect_set("attr").alias("needs"))
    none = F.array().cast("array<string>")
    # the ancestors of each class, nearest first, with what they need: a row for each class of the vocabulary
    ups = vocabulary.closure().join(F.broadcast(declared), "ancestor", "left_semi").join(F.broadcast(needs), "ancestor", "left").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("depth", "ancestor", F.coalesce("needs", none).alias("needs")))).alias("ups"))
    # and of each object the required attributes that it has: values are shuffled once, by object
    has = slots.join(F.broadcast(required.select("attr").distinct()), "attr", "left_semi").groupBy("mrid").agg(F.collect_set("attr").alias("has"))
    told = objects.select("mrid", "class").join(F.broadcast(ups), "class", "left").join(wide(has), "mrid", "left")
    complete = F.filter("ups", lambda up: F.size(F.array_except(up["needs"], F.coalesce("has", none))) == 0)
    return told.select("mrid", F.coalesce(F.get(complete, F.lit(0))["ancestor"], "class").alias("element"))
