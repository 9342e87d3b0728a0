"""A vocabulary as data: classes, attributes, enumerations and profiles.

Vocabularies have at most thousands of rows, whatever the size of the models, so they are broadcast in joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import profiles as P

CLASSES = "class string, ns string, parent string, concrete boolean, profiles long, defined_in long, concrete_in long, deprecated boolean"
ATTRS = "attr string, ns string, owner string, kind string, primitive string, target string, least int, most int, used_in long, deprecated boolean, fixed string"
LITERALS = "ns string, enum string, literal string"
INVERSES = "attr string, inverse string"
PROFILES = "profile string, bit int, iri string, aliases array<string>"


@dataclass(frozen=True)
class Vocabulary:
    classes: DataFrame
    attrs: DataFrame
    literals: DataFrame
    profiles: DataFrame
    inverses: DataFrame | None = None  # attr, inverse: the two ends of an association

    @staticmethod
    def of(spark: SparkSession, classes: list[tuple], attrs: list[tuple], literals: list[tuple] = (), profiles: list[tuple] = (), inverses: list[tuple] = ()) -> Vocabulary:
        return Vocabulary(*(spark.createDataFrame(list(rows), schema) for rows, schema in ((classes, CLASSES), (attrs, ATTRS), (literals, LITERALS), (profiles, PROFILES), (inverses, INVERSES))))

    def closure(self) -> DataFrame:
        """class, ancestor, depth: every class with itself and its ancestors, nearest first.

        It is walked once for a vocabulary and kept as a local table: its rows are bounded by the classes and their depth.
        """
        known = self.__dict__.get("_closure")
        if known is None:
            parents = {r["class"]: r.parent for r in self.classes.select("class", "parent").collect()}  # a vocabulary's classes
            rows = []
            for name in parents:
                up, seen = name, []
                while up is not None and up not in seen:
                    rows.append((name, up, len(seen)))
                    seen.append(up)
                    up = parents.get(up)
            known = self.classes.sparkSession.createDataFrame(rows, "class string, ancestor string, depth int")
            object.__setattr__(self, "_closure", known)
        return known

    def has_compounds(self) -> bool:
        known = self.__dict__.get("_compounds")
        if known is None:
            known = not self.attrs.where("kind = 'compound'").isEmpty()
            object.__setattr__(self, "_compounds", known)
        return known

    def class_attrs(self) -> DataFrame:
        """class, attr, depth and the attribute's definition, inherited ones included."""
        return self.closure().join(F.broadcast(self.attrs), F.col("ancestor") == F.col("owner")).drop("ancestor")

    def concrete_classes(self) -> DataFrame:
        return self.classes.where("concrete")

    def classes_in(self, profile_bit: int) -> DataFrame:
        return self.classes.where(F.col("profiles").bitwiseAND(F.lit(P.mask(profile_bit))) != 0)

    def attr_by_label(self) -> DataFrame:
        """class, label and the most derived attribute of that label."""
        label = F.substring_index("attr", ".", -1)
        return self.class_attrs().groupBy("class", label.alias("label")).agg(F.min_by("attr", "depth").alias("attr"))

    def find_classes(self, names: DataFrame) -> DataFrame:
        """``names`` (name, and ns or null for any) with class and its namespace."""
        known = self.classes.select("class", F.col("ns").alias("class_ns"))
        return names.join(F.broadcast(known), (F.col("name") == F.col("class")) & (F.col("ns").isNull() | (F.col("ns") == F.col("class_ns"))))

    def find_literals(self, names: DataFrame) -> DataFrame:
        """``names`` (enum, literal) with the namespaces that have such a value."""
        return names.join(F.broadcast(self.literals), ["enum", "literal"])

    def by_keyword(self, keyword: str) -> DataFrame:
        """The profile of a keyword, in any case."""
        return self.profiles.where(F.lower("profile") == keyword.lower())

    def resolve_iris(self, iris: DataFrame, column: str = "iri") -> DataFrame:
        """``iris`` with ``bit``: the profile of that IRI, exactly, by alias, or by its stem without the version, in this order."""
        p = self.profiles
        exact = p.select(F.col("iri").alias("_k"), F.col("bit").alias("_b"), F.lit(0).alias("_o"))
        alias = p.select(F.explode("aliases").alias("_k"), "bit", F.lit(1))
        by_stem = p.select(P.stem(F.col("iri")).alias("_s"), F.col("bit").alias("_c")).groupBy("_s").agg(F.min("_c").alias("_c"))
        known = exact.union(alias).groupBy("_k").agg(F.min_by("_b", "_o").alias("_b"))
        joined = iris.join(F.broadcast(known), F.col(column) == F.col("_k"), "left").join(F.broadcast(by_stem), P.stem(F.col(column)) == F.col("_s"), "left")
        return joined.withColumn("bit", F.coalesce("_b", "_c")).drop("_k", "_b", "_s", "_c")


def detect(namespaces: DataFrame, vocabularies: DataFrame) -> DataFrame:
    """file and the vintage with most classes in its declared namespaces (A3, F8). ``namespaces``: file, ns; ``vocabularies``: vintage, ns, classes."""
    scores = namespaces.join(F.broadcast(vocabularies), "ns").groupBy("file", "vintage").agg(F.sum("classes").alias("score"))
    return scores.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("score"), F.desc("vintage")))).where("n = 1").drop("n")
