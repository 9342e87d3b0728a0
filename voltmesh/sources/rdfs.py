"""Vocabularies from RDFS profile descriptions (A23, 2.M)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.shared import cut
from ..operators.vocabulary import Vocabulary
from . import xmltokens as T


def triples(docs: DataFrame) -> DataFrame:
    """bit, subject, predicate, resource, text of flat descriptions. ``docs``: bit, content."""
    found = T.nodes(T.cut_whole(docs.select(F.concat_ws(":", "bit", F.md5("content")).alias("file"), "content"))).nodes
    local = lambda c: F.nullif(F.regexp_extract(c, r"([^#]*)$", 1), F.lit(""))
    subjects = found.where("level = 1").select("file", F.col("pos").alias("element"), local(T.attribute(F.col("tag"), "about")).alias("subject"))
    props = found.where("level = 2").withColumn("element", F.element_at("up", 1)).join(subjects, ["file", "element"])
    return props.select(F.substring_index("file", ":", 1).cast("int").alias("bit"), "subject", F.col("local").alias("predicate"), local(T.attribute(F.col("tag"), "resource")).alias("resource"), F.trim("text").alias("text"))


@dataclass(frozen=True)
class Vintage:
    """What a vintage of a vocabulary is made of: its namespace, the files of each profile's bit, profiles, and the stereotypes it claims."""

    name: str
    ns: str
    files: dict[int, str]
    profiles: list[tuple]  # profile, bit, iri, aliases
    claimed: tuple[str, ...] = ()
    residual: bool = False

    def documents(self, spark: SparkSession) -> DataFrame:
        read = [spark.read.text(path, wholetext=True).select(F.lit(bit).alias("bit"), F.col("value").alias("content")) for bit, path in self.files.items()]
        return reduce(DataFrame.unionByName, read)

    def vocabulary(self, spark: SparkSession) -> Vocabulary:
        return vocabulary(spark, self.documents(spark), self.ns, self.profiles, self.claimed, self.residual)


def accepted(found: DataFrame, claimed: tuple[str, ...], residual: bool) -> DataFrame:
    """The triples of a vocabulary that shares its files with another: subjects with a claimed stereotype or, if it is the ``residual`` one, all others (M2)."""
    if not claimed:
        return found
    theirs = found.where((F.col("predicate") == "stereotype") & F.coalesce("resource", "text").isin(*claimed)).select("subject").distinct()
    return found.join(theirs, "subject", "left_anti" if residual else "left_semi")


def finished(classes: DataFrame) -> DataFrame:
    """Classes whose parents are known, or roots, and that no profile defines where a class below them is only described (M6, M7)."""
    known = F.broadcast(classes.select(F.col("class").alias("parent"), F.lit(True).alias("_known")))
    rooted = cut(classes.join(known, "parent", "left").withColumn("parent", F.when(F.col("_known"), F.col("parent"))).drop("_known"))
    plain = rooted.drop("described_in")
    up = Vocabulary(plain, plain, plain, plain).closure().where("depth > 0").join(F.broadcast(rooted.select("class", "described_in")), "class")
    cleared = up.groupBy(F.col("ancestor").alias("class")).agg(F.bit_or("described_in").alias("_below"))
    return plain.join(F.broadcast(cleared), "class", "left").withColumn("defined_in", F.col("defined_in").bitwiseAND(F.bitwise_not(F.coalesce("_below", F.lit(0).cast("long"))))).select(*plain.columns)


def vocabulary(spark: SparkSession, docs: DataFrame, ns: str, profiles: list[tuple], claimed: tuple[str, ...] = (), residual: bool = False) -> Vocabulary:
    """Classes, attributes and literals, or-ing the profiles that describe each (M1-M9)."""
    t = accepted(triples(docs), claimed, residual)
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    pick = lambda name, column: F.max(F.when(F.col("predicate") == name, F.col(column)))
    about = t.groupBy("subject").agg(
        F.bit_or(mask).alias("profiles"), pick("type", "resource").alias("type"), pick("subClassOf", "resource").alias("parent"), pick("domain", "resource").alias("owner"), pick("range", "resource").alias("range"),
        pick("dataType", "resource").alias("datatype"), pick("multiplicity", "resource").alias("multiplicity"), pick("isFixed", "text").alias("fixed"), pick("inverseRoleName", "resource").alias("inverse"),
        F.bit_or(F.when((F.col("predicate") == "stereotype") & F.col("resource").isin("concrete"), mask).otherwise(0)).alias("concrete_in"),
        F.bit_or(F.when((F.col("predicate") == "type") & (F.col("resource") == "Class"), mask).otherwise(0)).alias("typed_in"),
        F.bit_or(F.when((F.col("predicate") == "stereotype") & (F.col("text") == "Description"), mask).otherwise(0)).alias("described_in"),
        F.bit_or(F.when((F.col("predicate") == "AssociationUsed") & (F.col("text") == "Yes"), mask).otherwise(0)).alias("used_in"),
        F.collect_set(F.when(F.col("predicate") == "stereotype", F.coalesce("resource", "text"))).alias("stereotypes"),
    )
    has = lambda name: F.array_contains("stereotypes", name)
    kinds = about.where("type = 'Class'")
    enums = kinds.where(has("enumeration")).select("subject")
    datatypes = kinds.where(has("CIMDatatype") | has("Primitive")).select("subject")
    compounds = kinds.where(has("Compound")).select("subject")
    plain = kinds.join(F.broadcast(enums.union(datatypes)), "subject", "left_anti")
    classes = plain.select(F.col("subject").alias("class"), F.lit(ns).alias("ns"), "parent", (F.col("concrete_in") != 0).alias("concrete"), "profiles", (F.col("typed_in").bitwiseAND(F.bitwise_not("described_in"))).alias("defined_in"), "concrete_in", has("deprecated").alias("deprecated"), "described_in")
    classes = finished(classes)
    m = V.multiplicity(F.concat(F.lit("M:"), F.regexp_extract("multiplicity", r"M:(.*)$", 1)))
    tagged = lambda df, name: F.broadcast(df.select(F.col("subject").alias("range"), F.lit(True).alias(name)))
    props = about.where("type = 'Property'").join(tagged(enums, "_enum"), "range", "left").join(tagged(compounds, "_compound"), "range", "left")
    # a CIM datatype wraps the primitive of its value property
    wrapped = F.broadcast(about.where("type = 'Property' and subject like '%.value'").select(F.col("owner").alias("datatype"), F.col("datatype").alias("_wrapped")))
    props = props.join(wrapped, "datatype", "left")
    kind = F.when(F.col("_enum"), "enum").when(F.col("_compound"), "compound").when(F.col("range").isNotNull(), "ref").otherwise("value")
    attrs = props.select(
        F.col("subject").alias("attr"), F.lit(ns).alias("ns"), "owner", kind.alias("kind"), F.when(kind == "value", F.coalesce("_wrapped", "datatype", F.lit("String"))).alias("primitive"), F.when(kind != "value", F.col("range")).alias("target"),
        F.coalesce(m["least"], F.lit(0)).alias("least"), m["most"].alias("most"), F.when(kind == "ref", F.col("used_in")).otherwise(F.col("profiles")).alias("used_in"), has("deprecated").alias("deprecated"), F.coalesce("fixed", F.lit("")).alias("fixed"),
    )
    literals = about.join(F.broadcast(enums.select(F.col("subject").alias("type"))), "type").select(F.lit(ns).alias("ns"), F.col("type").alias("enum"), F.col("subject").alias("literal"))
    listed = spark.createDataFrame(profiles, "profile string, bit int, iri string, aliases array<string>")
    inverses = about.where("type = 'Property' and inverse is not null").select(F.col("subject").alias("attr"), "inverse")
    return Vocabulary(classes, attrs, literals, listed, inverses)
