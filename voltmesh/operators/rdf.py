"""Models as RDF triples and N-Triples lines (2.L)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mrid as M
from ..functions import rdfterms as R
from ..functions import values as V
from ..functions.shared import wide
from . import compounds as C
from .model import Model, element_class

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def subject(parsed, base: str = ""):
    """The term of a parsed identifier. What is no UUID has ``written`` as its key; that is the shorter code."""
    return F.when(parsed["is_uuid"], F.concat(F.lit("<urn:uuid:"), parsed["key"], F.lit(">"))).when(F.lit(bool(base)), R.iri(F.concat(F.lit(base), parsed["written"]))).otherwise(R.blank_label(parsed["written"]))


def with_terms(rows: DataFrame, base: str, **columns: str) -> DataFrame:
    """``rows`` with the term of each named identifier column; parsed once, in a step of its own, to keep generated code small."""
    parsed = rows.withColumns({f"_{new}": M.parse(F.col(old)) for new, old in columns.items()})
    return parsed.withColumns({new: subject(F.col(f"_{new}"), base) for new in columns}).drop(*(f"_{new}" for new in columns))


def triples(m: Model, scope: int, ns: str = "http://example.org/model#", base: str = "") -> DataFrame:
    """subject, predicate, object, datatype: types by element class and every value of the scope; objects without a value in it are left out (L1-L4)."""
    slots = m.in_profiles(scope)
    live = m.objects.join(wide(slots.select("mrid").distinct()), "mrid", "left_semi")
    own = lambda name: R.iri(F.concat(F.lit(ns), F.col(name)))
    # terms that follow from the vocabulary are made there, once
    classes = F.broadcast(m.vocabulary.classes.select(F.col("class").alias("element"), own("class").alias("known")))
    types = element_class(live, slots, m.vocabulary, scope).join(classes, "element", "left").select("mrid", F.lit(f"<{RDF_TYPE}>").alias("predicate"), F.coalesce("known", own("element")).alias("object"), F.lit(None).cast("string").alias("datatype"))
    # a value inside a compound stands in the blank node of its object and the path around it; terms are made by all tasks, as a table in one file is read by few
    named = slots.repartition("mrid").withColumns({"around": C.above(), "leaf": C.leaf()})
    kinds = F.broadcast(m.vocabulary.attrs.select(F.col("attr").alias("leaf"), "primitive", V.xsd_datatype(F.col("primitive")).alias("xsd"), own("attr").alias("predicate")))
    typed = with_terms(named.join(kinds, "leaf"), base, target="v_ref")
    shown = F.coalesce("v_text", F.col("v_int").cast("string"), F.col("v_bool").cast("string"), F.when(F.col("lex").isNotNull() & V.is_lexical(F.col("lex"), F.col("primitive")), F.col("lex")).when(F.col("v_dbl").isNotNull(), V.canonical_float("v_dbl")))
    datatype = F.when(F.col("kind").isin("ref", "enum"), None).otherwise(F.col("xsd"))
    term = F.when(F.col("kind") == "ref", F.col("target")).when(F.col("kind") == "enum", own("v_text")).otherwise(R.literal(shown, F.col("xsd")))
    inner = F.col("around") != ""
    blank = lambda path: F.concat(F.lit("_:c"), F.md5(F.concat_ws("/", F.col("mrid"), path)))
    values = typed.select("mrid", F.when(inner, blank(F.col("around"))).alias("node"), "predicate", term.alias("object"), datatype.alias("datatype"))
    every_path = F.transform(F.sequence(F.lit(1), F.size(C.holders())), lambda n: F.array_join(F.slice(C.holders(), F.lit(1), n), "/"))
    holders = named.where(inner).select("mrid", F.explode(every_path).alias("path")).distinct()
    holders = holders.select("mrid", "path", C.leaf("path").alias("root"), C.above("path").alias("above")).join(F.broadcast(m.vocabulary.attrs.where("kind = 'compound'").select(F.col("attr").alias("root"), own("attr").alias("predicate"), own("target").alias("compound"))), "root")
    none = F.lit(None).cast("string")
    # the node of each holder: what holds it, and its type
    nodes = holders.withColumns({"_node": blank(F.col("path")), "_above": F.when(F.col("above") != "", blank(F.col("above")))})
    nodes = nodes.select("mrid", F.inline(F.array(F.struct(F.col("_above").alias("node"), "predicate", F.col("_node").alias("object")), F.struct(F.col("_node").alias("node"), F.lit(f"<{RDF_TYPE}>").alias("predicate"), F.col("compound").alias("object"))))).withColumn("datatype", none)
    every = types.withColumn("node", none).select("mrid", "node", "predicate", "object", "datatype").unionByName(values).unionByName(nodes)
    named_by = every.withColumn("_owner", F.when(F.col("node").isNull(), F.col("mrid")))  # nodes of compounds have their names
    found = with_terms(named_by, base, subject="_owner")
    # generated rows: Spark would repeat a filter's terms at every table they are read from, in code too large to be compiled well
    return found.select(F.inline(F.array(F.struct(F.coalesce("node", "subject").alias("subject"), "predicate", "object", "datatype"))))


#: The header's terms and what they are typed as.
HEADER = "http://iec.ch/TC57/61970-552/ModelDescription/1#"
HEADER_LITERALS = {"created": ("Model.created", "dateTime"), "scenario_time": ("Model.scenarioTime", "dateTime"), "version": ("Model.version", ""), "description": ("Model.description", "")}
HEADER_REFERENCES = {"profiles": "Model.profile", "depends_on": "Model.DependentOn", "supersedes": "Model.Supersedes"}


def header_triples(heads: DataFrame) -> DataFrame:
    """subject, predicate, object of file headers: their type, typed literals, and references as IRIs."""
    own = R.iri(F.col("id"))
    row = lambda p, o: F.struct(p.alias("predicate"), o.alias("object"))
    each = [F.array(row(F.lit(f"<{RDF_TYPE}>"), F.lit(f"<{HEADER}FullModel>")))]
    each += [F.when(F.col(c).isNotNull(), F.array(row(F.lit(f"<{HEADER}{name}>"), R.literal(F.col(c), F.lit(kind))))).otherwise(F.array().cast("array<struct<predicate:string,object:string>>")) for c, (name, kind) in HEADER_LITERALS.items() if c in heads.columns]
    references = lambda column, name: F.transform(column, lambda x: row(F.lit(f"<{HEADER}{name}>"), R.iri(x)))
    each += [references(c, name) for c, name in HEADER_REFERENCES.items() if c in heads.columns]
    return heads.where("id is not null").select(own.alias("subject"), F.inline(F.concat(*each)))


def turtle_prologue(prefixes: dict[str, str]) -> tuple[str, dict[str, str]]:
    """The prefix lines of a Turtle document, and the prefixes that may abbreviate: names of the format's own and repeated namespaces are left out."""
    own = {"rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "xsd": "http://www.w3.org/2001/XMLSchema#", "md": HEADER}
    kept: dict[str, str] = {}
    for name, iri in prefixes.items():
        if name not in own and iri not in kept.values() and iri not in own.values():
            kept[name] = iri
    return "".join(f"@prefix {k}: <{v}> .\n" for k, v in {**own, **kept}.items()), kept


def lines(found: DataFrame) -> DataFrame:
    return found.select(F.concat_ws(" ", "subject", "predicate", "object", F.lit(".")).alias("value"))


def write_ntriples(m: Model, scope: int, path: str, **options) -> None:
    """N-Triples need no order, so every task writes its own part."""
    lines(triples(m, scope, **options)).write.mode("overwrite").text(path)


def turtle(found: DataFrame, ns: str, prefix: str = "m") -> DataFrame:
    """Turtle blocks, one subject a row: its predicates and objects, abbreviated where the local name allows."""

    def short(term):
        local = F.substring(term, F.lit(len(ns) + 2), F.length(term) - F.lit(len(ns) + 2))
        return F.when(term == f"<{RDF_TYPE}>", "a").when(term.startswith("<" + ns) & R.is_local_name(local), F.concat(F.lit(prefix + ":"), local)).otherwise(term)

    pairs = found.withColumn("po", F.concat_ws(" ", short(F.col("predicate")), short(F.col("object"))))
    return pairs.groupBy("subject").agg(F.concat_ws(" ;\n    ", F.sort_array(F.collect_list("po"))).alias("body")).select(F.concat_ws(" ", "subject", "body", F.lit(".")).alias("value"))


def datatype_histogram(found: DataFrame) -> DataFrame:
    return found.groupBy("datatype").agg(F.count("*").alias("n"))
