"""CIM/XML documents as models, difference statements and headers, and models as documents (2.A, 2.B).

``xmltokens`` gives a document's nodes; names are resolved by joins with the broadcast vocabulary, by namespace and local name, and values are typed by
expressions. Nothing is parsed row by row in Python. Reading is lenient: what the vocabulary doesn't know becomes a finding, a document
cut off keeps the elements that are closed before.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import mrid as M
from ..functions import profiles as P
from ..functions import values as V
from ..functions import xmltext as X
from ..functions.ordered import numbered
from ..functions.shared import cut, wide
from ..operators import compounds as C
from ..operators.difference import resolve
from ..operators.model import Model, merge_classes, merge_slots
from ..operators.validate import RULES
from ..operators.vocabulary import Vocabulary, detect
from . import datasource
from . import store as S
from . import xmltokens as T
from .markup import DM, MD

#: The fields of a header.
ONE = {"created": "created", "scenarioTime": "scenario_time", "version": "version", "description": "description", "modelingAuthoritySet": "authority"}
MANY = {"profile": "profiles", "DependentOn": "depends_on", "Supersedes": "supersedes"}


#: The columns of findings: pos is the place of the tag that a finding is about, null where it is about a whole file or model.
FINDINGS = ("file", "rule", "written", "class", "attr", "pos")


def noted(rows: DataFrame, rule: str, written: Column, attr: Column | None = None, pos: Column | None = None) -> DataFrame:
    """Findings of one rule; ``rows`` have file, and class if they know it."""
    none = F.lit(None).cast("string")
    has_class = F.col("class") if "class" in rows.columns else none
    at = F.lit(None).cast("struct<split:bigint,at:bigint>") if pos is None else pos
    return rows.select("file", F.lit(RULES[rule]).alias("rule"), written.alias("written"), has_class.alias("class"), (none if attr is None else attr).alias("attr"), at.alias("pos"))


@dataclass(frozen=True)
class Documents:
    """The nodes of some documents, with file_seq (their number in name order) and the element each is in."""

    nodes: DataFrame  # file, file_seq, level, pos, up, within, element, ns, local, tag, text
    prefixes: DataFrame  # file, prefixes
    files: DataFrame  # file, file_seq
    problems: DataFrame  # FINDINGS: documents that can't be read, and elements too deep to be
    rows: DataFrame  # the tags that the nodes were made of
    levels: int  # how deep the deepest node stands

    @staticmethod
    def of(tokens: DataFrame, problems: DataFrame | None = None) -> Documents:
        parsed = T.nodes(tokens)
        found = cut(parsed.nodes)
        bad = noted(parsed.no_root, "unreadable-file", F.lit("no rdf:RDF"))
        if problems is not None:
            bad = bad.unionByName(noted(problems, "unreadable-file", F.col("problem")))
        bad = bad.unionByName(noted(parsed.deep, "structure", F.lit(f"more than {T.MOST_LEVELS} levels"), pos=F.col("pos")))
        names = found.select("file").union(bad.select("file")).union(parsed.prefixes.select("file")).distinct()
        files = cut(numbered(names, "file_seq", "file").select("file", (F.col("file_seq") - 1).cast("int").alias("file_seq")))
        # a node counts if the element it is in is closed; those that aren't are few, as all that follows one is inside it
        cut_off = cut(found.where("level = 1 and not closed").select("file", F.col("pos").alias("element")))
        inside = found.withColumn("element", F.when(F.col("level") == 1, F.col("pos")).otherwise(F.get("up", F.lit(0)))).where("element is not null")
        kept = inside.join(T.near(cut_off, cut_off.count()), ["file", "element"], "left_anti")
        return Documents(kept.join(T.near(files, files.count()), "file"), parsed.prefixes, files, bad, parsed.rows, parsed.levels)


def documents(spark: SparkSession, path: str, glob: str = "*.[xX][mM][lL]") -> Documents:
    """Every XML document under ``path``."""
    return Documents.of(T.tokens(spark, path, glob))


def parts(spark: SparkSession, path: str) -> Documents:
    """Documents that were written here, as folders of part files."""
    return Documents.of(T.part_tokens(spark, path))


def zipped(spark: SparkSession, path: str) -> Documents:
    """Every XML entry of the zip archives under ``path``: one task an entry, a chunk at a time; an entry that can't be read to its end is left out and reported."""
    if not S.reachable(path):
        entries = cut(T.zip_entries(spark, path))
        return Documents.of(T.cut_whole(entries.where("content is not null")), entries.where("content is null"))
    return Documents.of(*streamed(datasource.blocks(spark, path, ends=".zip")))


def streamed(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tokens of the documents, given as blocks, that were read to their end, and the problems of the others (file, problem)."""
    found = cut(scanned)
    bad = cut(found.where("problem is not null").select("file", "problem"))
    fine = found.where("problem is null").join(T.near(bad.select("file"), bad.count()), "file", "left_anti")
    return T.of_blocks(fine), bad


def folder(spark: SparkSession, path: str) -> Documents:
    """Whatever documents ``path`` has or is: XML files and the XML entries of archives."""
    return Documents.of(*streamed(datasource.blocks(spark, path)))


def in_content(docs: DataFrame) -> Documents:
    """Documents given as file and content."""
    return Documents.of(T.cut_whole(docs.select("file", "content")))


def peek_namespaces(spark: SparkSession, path: str, known: tuple[str, ...] = ()) -> DataFrame:
    """file, ns, size and bytes_read: the namespaces that start tags declare, read up to the first of ``known`` (A3)."""
    return datasource.scan(spark, path, "namespaces", known=" ".join(known)).select("file", F.explode("namespaces").alias("ns"), "size", "bytes_read")


def peek_vintage(spark: SparkSession, path: str, vocabularies: DataFrame) -> str | None:
    """The vintage of the first document under ``path``, in name order, that tells one, from the beginnings of documents."""
    known = tuple(sorted(r.ns for r in vocabularies.select("ns").distinct().collect()))  # of vocabularies
    row = detect(peek_namespaces(spark, path, known).select("file", "ns"), vocabularies).agg(F.min_by("vintage", "file").alias("vintage")).first()
    return row.vintage


def opened(spark: SparkSession, path: str, vintages: dict[str, Vocabulary]) -> tuple[Model, DataFrame, DataFrame]:
    """What ``read`` gives for whatever ``path`` has or is, by the vocabulary that it names."""
    sizes = [(name, r.ns, r.n) for name, v in vintages.items() for r in v.classes.groupBy("ns").agg(F.count("*").cast("int").alias("n")).collect()]  # namespaces of vocabularies
    vocabularies = spark.createDataFrame(sizes, "vintage string, ns string, classes int")
    told = peek_vintage(spark, path, vocabularies)
    if told is None:
        raise ValueError(f"no document under {path} names a known vocabulary")
    docs = folder(spark, path)
    model, heads, findings = read(docs, vintages[told])
    return model, heads, findings.unionByName(wrong_vintage(docs, vocabularies, told))


def located(findings: DataFrame, docs: Documents) -> DataFrame:
    """``findings`` with the line and column, from 1 and in bytes, of the tag each is about; null for those about a whole file."""
    findings = cut(findings)
    return findings.join(T.places(docs.rows, findings.where("pos is not null")), ["file", "pos"], "left").drop("pos")


def declared(docs: Documents) -> DataFrame:
    """file and each namespace it declares."""
    return docs.prefixes.select("file", F.explode(F.map_values("prefixes")).alias("ns")).distinct()


def vintages(docs: Documents, vocabularies: DataFrame) -> DataFrame:
    """file and the vintage that its namespaces name best; ``vocabularies``: vintage, ns, classes (A3)."""
    return detect(declared(docs), vocabularies)


def vintage_of_set(docs: Documents, vocabularies: DataFrame) -> str | None:
    """The vintage of the first file, in name order, that tells one."""
    return vintages(docs, vocabularies).agg(F.min_by("vintage", "file").alias("vintage")).first().vintage


def wrong_vintage(docs: Documents, vocabularies: DataFrame, wanted: str) -> DataFrame:
    """A finding for each file that names another vintage."""
    other = vintages(docs, vocabularies).where(F.col("vintage") != wanted)
    return noted(other, "wrong-vintage", F.col("vintage"))


def headers_of(docs: Documents) -> DataFrame:
    """file, id, kind and the fields of each document's header; ``extra`` has the fields of other names as they are."""
    heads = docs.nodes.where("level = 1").where(((F.col("ns") == MD) & (F.col("local") == "FullModel")) | ((F.col("ns") == DM) & (F.col("local") == "DifferenceModel")))
    own = heads.select("file", "file_seq", "element", T.attribute(F.col("tag"), "about").alias("id"), F.when(F.col("local") == "FullModel", "full").otherwise("difference").alias("kind"))
    fields = docs.nodes.where("level = 2").where(F.col("ns") != DM).join(own.select("file", "element"), ["file", "element"], "left_semi")
    return cut(header_rows(own, fields.select("file", "element", "pos", "ns", "local", T.attribute(F.col("tag"), "resource").alias("resource"), "text"), ["file", "element"]).drop("element"))  # a row for each file, asked for many times


def peek_headers(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """The same of the documents under ``path`` whose names match ``glob``, with problem, size and bytes_read: a document is read up to the end of its header."""
    found = cut(datasource.scan(spark, path, "headers", glob=glob))
    own = found.select("file", "id", "kind", "size", "bytes_read", "problem")
    fields = found.select("file", F.posexplode("fields").alias("pos", "f")).select("file", "pos", "f.*").withColumn("text", F.regexp_replace("text", "\r\n?", "\n"))
    return header_rows(own, fields, ["file"])


def header_rows(own: DataFrame, fields: DataFrame, keys: list[str]) -> DataFrame:
    """``own`` with the named fields of headers: ``fields`` has pos, ns, local, resource and text."""
    value = F.coalesce("resource", F.nullif(V.trimmed(F.col("text")), F.lit("")))
    read = fields.select(*keys, "pos", F.when((F.col("ns") == MD) & F.col("local").startswith("Model."), F.substring("local", 7, 1000)).alias("field"), "ns", "local", value.alias("value")).where("value is not null")
    listed = F.col("field").isin(*ONE, *MANY)
    in_order = lambda keep, x: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", x.alias("x"))))), lambda r: r["x"])
    columns = [F.max_by("value", F.when(F.col("field") == k, F.col("pos"))).alias(v) for k, v in ONE.items()]
    columns += [F.array_distinct(in_order(F.col("field") == k, F.col("value"))).alias(v) for k, v in MANY.items()]
    extra = in_order(~F.coalesce(listed, F.lit(False)), F.struct("ns", "local", "value")).alias("extra")
    joined = own.join(read.groupBy(*keys).agg(*columns, extra), keys, "left")
    empty = F.array().cast("array<string>")
    return joined.withColumns({v: F.coalesce(v, empty) for v in MANY.values()})


def file_masks(headers: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """file and the mask of the profiles that its header names."""
    each = vocabulary.resolve_iris(headers.select("file", F.explode("profiles").alias("iri")))
    return each.where("bit is not null").groupBy("file").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("profiles"))


def present_profiles(heads: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """profile and bit of every profile that some header declares."""
    bits = vocabulary.resolve_iris(heads.select(F.explode("profiles").alias("iri"))).where("bit is not null").select("bit").distinct()
    return vocabulary.profiles.select("profile", "bit").join(F.broadcast(bits), "bit")


def primary_profile(heads: DataFrame) -> DataFrame:
    """file and the name of its first profile: what stands before the version in its IRI."""
    first = F.try_element_at("profiles", F.lit(1))
    return heads.select("file", F.regexp_extract(first, r"([^/#]+)/[^/]*$", 1).alias("name"))


def safe_names(wanted: DataFrame) -> DataFrame:
    """``wanted`` (file, name) with output, a name that stays in its folder and that no other file has: the last part of the name, and a number from the second on.

    A numbered name may be another file's own; then it is numbered again, and the own one stays.
    """
    last = F.regexp_extract(F.regexp_replace("name", r"\\", "/"), r"([^/]*)/*$", 1)
    named = wanted.withColumns({"output": F.when(last.isin("", ".", ".."), "document.xml").otherwise(last), "turn": F.lit(0)})
    stem, end = F.regexp_extract("output", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("output", r"^(.*?)(\.[^.]*)?$", 2)
    while True:
        named = cut(named.withColumn("n", F.row_number().over(Window.partitionBy("output").orderBy("turn", "file"))))
        if named.where("n > 1").isEmpty():
            return named.drop("turn", "n")
        again = F.col("n") > 1
        named = named.withColumns({"output": F.when(again, F.concat(stem, F.lit("_"), "n", end)).otherwise(F.col("output")), "turn": F.col("turn") + again.cast("int")}).drop("n")


def identity() -> tuple[Column, Column]:
    """What an element is written as (its rdf:ID, its rdf:about, or a made-up name), and whether it has neither."""
    written = F.coalesce(T.attribute(F.col("tag"), "ID"), T.attribute(F.col("tag"), "about"))
    return F.coalesce(written, F.concat_ws("-", F.lit("no-identifier"), "file_seq", F.col("pos")["split"], F.col("pos")["at"])), written.isNull()


def elements(docs: Documents) -> DataFrame:
    """file, file_seq, element, ns, class, written, mrid, unnamed and bad_id of the top-level elements but headers."""
    written, unnamed = identity()
    body = docs.nodes.where("level = 1").where(~F.col("ns").isin(MD, DM))
    xml_id = T.attribute(F.col("tag"), "ID")
    return body.select("file", "file_seq", "element", "ns", F.col("local").alias("class"), written.alias("written"), M.parse(written)["key"].alias("mrid"), unnamed.alias("unnamed"), F.coalesce(~X.is_ncname(xml_id), F.lit(False)).alias("bad_id"))


def properties(docs: Documents, subjects: DataFrame, level: int = 2) -> DataFrame:
    """The values of ``subjects`` (file, subject: its position, and more): attr, ns, pos, text and resource.

    A value inside compounds is named by the whole path of properties to it, ``Property/Field/Field``; class elements between them (names without a dot) aren't part of it.
    A property that has fields gives no value of its own (A12).
    """
    rest = lambda column: F.slice(column, F.lit(level), F.greatest(F.size(column) - (level - 1), F.lit(0)))
    names = docs.nodes.where(F.col("level") >= level).select("file", "file_seq", "level", "pos", F.element_at("up", level - 1).alias("subject"), rest("up").alias("inner"), rest("within").alias("names"), "ns", "local", "tag", "text")
    found = names.join(wide(subjects), ["file", "subject"]).where((F.col("level") == level) | F.col("local").contains("."))
    path = F.concat_ws("/", F.filter("names", lambda n: n.contains(".")), "local")
    if docs.levels > level:  # else nothing stands inside a property
        holders = found.where(F.col("level") > level).select("file", F.explode("inner").alias("pos")).distinct()
        found = found.join(wide(holders), ["file", "pos"], "left_anti")
    named = found.withColumn("attr", path)
    return named.withColumns({"resource": T.attribute(F.col("tag"), "resource"), "illegal": X.has_illegal(F.col("text")), "text": X.strip_illegal(F.col("text"))}).drop("tag", "inner", "names", "local")


def typed(props: DataFrame, vocabulary: Vocabulary, masks: DataFrame) -> DataFrame:
    """Raw slots with their values parsed by the declared kind; ``problem`` has the code of what couldn't be used."""
    root, leaf = F.substring_index("attr", "/", 1), F.substring_index("attr", "/", -1)
    owned = F.broadcast(vocabulary.class_attrs().select("class", F.col("attr").alias("_root"), F.lit(True).alias("owned")))
    named = F.broadcast(vocabulary.attrs.select(F.col("attr").alias("_leaf"), F.col("ns").alias("_ns"), F.col("kind").alias("declared"), "primitive"))
    joined = props.withColumns({"_root": root, "_leaf": leaf}).join(owned, ["class", "_root"], "left").join(named, ["_leaf"], "left").join(F.broadcast(masks), "file", "left")
    fits = F.coalesce(F.col("owned") & (F.col("_ns") == F.col("ns")), F.lit(False))
    v = V.parse_primitive(F.col("text"), F.col("primitive"))
    plain = F.col("declared") == "value"
    kind = F.when(F.col("declared").isin("ref", "enum", "compound"), F.col("declared")).when(F.col("primitive") == "Boolean", "bool").when(F.col("primitive") == "Integer", "int").when(F.col("primitive").isin("Float", "Decimal"), "dbl").otherwise("text")
    literal = F.regexp_extract("resource", r"([^#/]*)$", 1)
    unusable = (plain & ~v["ok"]) | (F.col("declared").isin("ref", "enum") & F.col("resource").isNull())
    problem = F.when(~fits, RULES["class-membership"]).when(unusable, RULES["unparseable-value"])
    return joined.select(
        "file", "file_seq", "element", "pos", "mrid", "class", "attr", F.lit(0).alias("ord"), kind.alias("kind"),
        F.when(plain, v["v_bool"]).alias("v_bool"), F.when(plain, v["v_int"]).alias("v_int"), F.when(plain, v["v_dbl"]).alias("v_dbl"),
        F.when(plain, v["v_text"]).when(F.col("declared") == "enum", literal).alias("v_text"), F.when(F.col("declared") == "ref", M.parse(F.col("resource"))["key"]).alias("v_ref"),
        F.when(plain & F.col("primitive").isin("Float", "Decimal"), V.trimmed(F.col("text"))).alias("lex"), F.coalesce("profiles", F.lit(0)).cast("long").alias("profiles"), problem.alias("problem"), "illegal", "resource",
    )


def enum_problems(raw: DataFrame, vocabulary: Vocabulary) -> tuple[DataFrame, DataFrame]:
    """Enumeration values that are no literal of the vocabulary: those of another namespace's spelling (kept), and unknown ones (dropped)."""
    known = F.broadcast(vocabulary.literals.select(F.concat_ws(".", "enum", F.substring_index("literal", ".", -1)).alias("v_text"), F.col("ns").alias("_ns")).distinct())
    enums = raw.where("kind = 'enum' and problem is null")
    unknown = enums.join(known, "v_text", "left_anti")
    strange = enums.join(known, "v_text").where(F.substring("resource", F.lit(1), F.length("resource") - F.length("v_text")) != F.col("_ns")).drop("_ns")
    return strange, unknown


def read(docs: Documents, vocabulary: Vocabulary, check_literals: bool = False, most_findings: int = 10_000) -> tuple[Model, DataFrame, DataFrame]:
    """The merged model, the headers and the findings of a set of documents (A1, A16, A17); at most ``most_findings`` of a file (0: all), with a note."""
    heads = headers_of(docs)
    masks = file_masks(heads, vocabulary)
    found = cut(elements(docs))
    known = F.broadcast(vocabulary.classes.select("class", "ns", "concrete"))
    written, element, pos = F.col("written"), F.col("element"), F.col("pos")
    unknown = noted(found.join(known, ["class", "ns"], "left_anti"), "unknown-class", written, pos=element)
    found = found.join(known, ["class", "ns"])
    nameless = noted(found.where("unnamed"), "structure", written, pos=element).unionByName(noted(found.where("bad_id"), "structure", written, pos=element))
    raw = cut(typed(properties(docs, found.select("file", F.col("element").alias("subject"), "element", "class", "mrid")), vocabulary, masks))
    attr = F.col("attr")
    mrid = F.col("mrid")
    problems = raw.where("problem is not null").select("file", F.col("problem").alias("rule"), mrid.alias("written"), "class", "attr", "pos").unionByName(noted(raw.where("illegal"), "illegal-character", mrid, attr, pos))
    fine = raw.where("problem is null")
    if check_literals:
        strange, lost = enum_problems(raw, vocabulary)
        problems = problems.unionByName(noted(strange, "unparseable-value", F.col("resource"), attr, pos)).unionByName(noted(lost, "unparseable-value", F.col("resource"), attr, pos))
        fine = fine.join(lost.select("file", "pos"), ["file", "pos"], "left_anti")
    # a repeated single value inside one element: the last counts, silently
    w = Window.partitionBy("file_seq", "element", "attr")
    many = F.broadcast(vocabulary.attrs.where("most is null or most > 1").select("attr", F.lit(True).alias("_many")))
    fine = fine.join(many, "attr", "left").withColumn("last", F.max("pos").over(w)).where("_many or pos = last").drop("last", "problem", "_many", "illegal", "resource")
    objects = found.join(F.broadcast(masks), "file", "left").select("mrid", "class", "file_seq", F.col("element").alias("elem_seq"), F.coalesce("profiles", F.lit(0)).cast("long").alias("profiles"))
    merged = cut(merge_classes(objects, vocabulary))
    collisions = noted(merged.where("collision").withColumn("file", F.lit(None).cast("string")), "class-collision", mrid)
    members = objects.select("file_seq", "mrid").distinct()
    model = Model(vocabulary, merged.drop("collision"), merge_slots(fine.withColumnRenamed("pos", "elem_seq"), vocabulary), members)
    findings = docs.problems.unionByName(unknown).unionByName(nameless).unionByName(problems).unionByName(collisions)
    return model, heads, bounded(findings, most_findings)


def bounded(findings: DataFrame, most: int) -> DataFrame:
    """At most ``most`` findings of each file, and a note of how many more there were.

    Findings are judged once; only those of files with too many are ranked.
    """
    if not most:
        return findings
    found = cut(findings)
    over = cut(found.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") > most))
    if over.isEmpty():
        return found
    full = T.near(over, over.count())
    same = found["file"].eqNullSafe(full["file"])
    few = found.join(full, same, "left_anti")
    ranked = found.join(full, same, "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("rule", "written", "attr", "pos"))).where(F.col("n") <= most).drop("n")
    none = F.lit(None).cast("string")
    note = over.select("file", F.lit("note").alias("rule"), F.concat(F.col("n") - most, F.lit(" more findings")).alias("written"), none.alias("class"), none.alias("attr"), F.lit(None).cast("struct<split:bigint,at:bigint>").alias("pos"))
    return few.unionByName(ranked).unionByName(note)


def raw_statements(docs: Documents) -> DataFrame:
    """The statements of difference models as they are written: direction, seq, mrid, class, defines, attr, ns, resource, text (A4)."""
    sets = docs.nodes.where("level = 2").where((F.col("ns") == DM) & F.col("local").isin("reverseDifferences", "forwardDifferences")).select("file", F.col("pos").alias("set"), F.when(F.col("local") == "reverseDifferences", "reverse").otherwise("forward").alias("direction"))
    written, _ = identity()
    subjects = docs.nodes.where("level = 3").select("file", "file_seq", "pos", "ns", F.element_at("up", 2).alias("set"), "local", "tag").join(F.broadcast(sets), ["file", "set"])
    subjects = subjects.select("file", F.col("pos").alias("subject"), "direction", F.when((F.col("ns") != T.RDF) | (F.col("local") != "Description"), F.col("local")).alias("class"), M.parse(written)["key"].alias("mrid"), (T.attribute(F.col("tag"), "ID").isNotNull()).alias("defines"))
    rows = properties(docs, subjects, 4)
    return rows.select("direction", F.struct("file_seq", F.col("pos")["split"].alias("split"), F.col("pos")["at"].alias("at")).alias("seq"), "mrid", "class", "defines", "attr", "ns", "resource", "text")


def read_statements(docs: Documents, vocabulary: Vocabulary) -> DataFrame:
    """The statements of difference models that the vocabulary knows: direction, seq, mrid, class, defines, attr, kind, value (A4)."""
    return resolve(raw_statements(docs), Model(vocabulary, None, None), check_literals=False)[0]


def rendered(m: Model, scope: int, prefix: Prefix = "cim") -> DataFrame:
    """mrid and the element text of every object of the scope: with a value in it, or introduced there, by a file of it and of a class it defines."""
    from ..operators.model import element_class

    slots = m.in_profiles(scope)
    defined = F.broadcast(m.vocabulary.classes.select(F.col("class").alias("element"), (F.col("defined_in").bitwiseAND(F.lit(scope)) != 0).alias("introduces")))
    own = m.objects.where(F.col("profiles").bitwiseAND(F.lit(scope)) != 0).join(defined.where("introduces").select(F.col("element").alias("class")), "class", "left_semi").select("mrid")
    live = m.objects.join(wide(slots.select("mrid").union(own).distinct()), "mrid", "left_semi")
    return drawn(element_class(live, slots, m.vocabulary, scope).select("mrid", "element").join(defined, "element", "left"), slots, m.vocabulary, prefix)


def whole(m: Model, prefix: Prefix = "cim") -> DataFrame:
    """mrid and the element text of every object, with all its values; one without any is an empty element."""
    return drawn(m.objects.select("mrid", F.col("class").alias("element"), F.lit(True).alias("introduces")), m.slots, m.vocabulary, prefix)


#: One prefix for all names, or the prefix of each namespace (as ``prefixes_of`` binds them).
Prefix = str | dict[str, str]


def qualified(name: Column, ns: Column, prefix: Prefix) -> Column:
    """A name with the prefix of its namespace."""
    if isinstance(prefix, str):
        return F.concat(F.lit(prefix + ":"), name)
    bound = F.create_map(*(F.lit(x) for pair in prefix.items() for x in pair))  # namespaces of a vocabulary
    return F.concat_ws(":", F.try_element_at(bound, ns), name)


def property_lines(slots: DataFrame, vocabulary: Vocabulary, prefix: Prefix) -> DataFrame:
    """``slots`` with line, their text as one property or field."""
    leaf = F.broadcast(vocabulary.attrs.select(F.col("attr").alias("leaf"), F.col("ns").alias("leaf_ns"), "primitive"))
    named = slots.withColumn("leaf", C.leaf()).join(leaf, "leaf")
    shown = F.coalesce("v_text", F.col("v_int").cast("string"), F.col("v_bool").cast("string"), F.when(F.col("lex").isNotNull() & V.is_lexical(F.col("lex"), F.col("primitive")), F.col("lex")).when(F.col("v_dbl").isNotNull(), V.canonical_float("v_dbl")))
    target = M.parse(F.col("v_ref"))
    reference = F.when(F.col("kind") == "ref", F.when(X.identifier_form(target["key"]) == "iri", target["key"]).otherwise(M.rdf_resource(target))).when(F.col("kind") == "enum", F.concat(F.lit("#"), F.col("v_text")))
    tag = qualified(F.col("leaf"), F.col("leaf_ns"), prefix)
    return named.withColumn("line", F.when(reference.isNotNull(), F.concat(F.lit("    <"), tag, F.lit(' rdf:resource="'), X.escape_attribute(reference), F.lit('"/>'))).otherwise(F.concat(F.lit("    <"), tag, F.lit(">"), X.escape_text(X.strip_illegal(shown)), F.lit("</"), tag, F.lit(">"))))


def drawn(objects: DataFrame, slots: DataFrame, vocabulary: Vocabulary, prefix: Prefix, keys: tuple[str, ...] = ("mrid",)) -> DataFrame:
    """``keys`` and the element text of ``objects`` (keys, element, introduces), with their ``slots``, compounds nested."""
    classes = F.broadcast(vocabulary.classes.select(F.col("class").alias("element"), F.col("ns").alias("element_ns")))
    held = F.struct("attr", "ord", C.holders().alias("holders"), "line")
    # lines are made by all tasks: a table in one file is read by one, and what it reads is a fraction of the text
    items = property_lines(slots.repartition(*keys), vocabulary, prefix).groupBy(*keys).agg(F.array_sort(F.collect_list(held)).alias("items"))
    ns_of = F.lit(None)
    if not isinstance(prefix, str):  # a compound's name is an attribute's, bounded by the vocabulary
        ns_of = F.create_map(*(F.lit(x) for r in vocabulary.attrs.where("kind = 'compound'").select("attr", "ns").collect() for x in r)) if vocabulary.has_compounds() else F.create_map(F.lit(""), F.lit(""))
    tag = lambda name: qualified(name, F.lit(None).cast("string") if isinstance(prefix, str) else F.try_element_at(ns_of, name), prefix)
    lines = C.nested(F.col("items"), lambda name: F.concat(F.lit("    <"), tag(name), F.lit(' rdf:parseType="Resource">')), lambda name: F.concat(F.lit("    </"), tag(name), F.lit(">")))
    bodies = items.select(*keys, F.array_join(lines, "\n").alias("body"))
    own = M.parse(F.col("mrid"))
    identity = F.when(X.identifier_form(own["key"]) == "iri", F.concat(F.lit('rdf:about="'), X.escape_attribute(own["key"]))).when(F.col("introduces"), F.concat(F.lit('rdf:ID="'), X.escape_attribute(M.rdf_id(own)))).otherwise(F.concat(F.lit('rdf:about="'), X.escape_attribute(M.rdf_resource(own))))
    named = objects.join(wide(bodies), list(keys), "left").join(classes, "element", "left")
    element = qualified(F.col("element"), F.col("element_ns"), prefix)
    start = F.concat(F.lit("  <"), element, F.lit(" "), identity, F.lit('"'))
    return named.select(*keys, F.when(F.col("body").isNull(), F.concat(start, F.lit("/>"))).otherwise(F.concat(start, F.lit(">\n"), F.col("body"), F.lit("\n  </"), element, F.lit(">"))).alias("element"))


def prefixes_of(vocabulary: Vocabulary, suggested: dict[str, str]) -> dict[str, str]:
    """The prefix of each namespace that a model of ``vocabulary`` can name, by ``bound_prefixes``; ``suggested``: prefix of a namespace."""
    named = vocabulary.classes.select("ns").union(vocabulary.attrs.select("ns")).distinct()
    namespaces = sorted(r.ns for r in named.collect())  # of a vocabulary
    last = lambda ns: "".join(c for c in ns.rstrip("#/").rpartition("/")[2].lower() if c.isalnum()) or "ns"
    return bound_prefixes([("md", MD), ("dm", DM), *((suggested.get(ns, last(ns)), ns) for ns in namespaces)])


def bound_prefixes(wanted: list[tuple[str, str]]) -> dict[str, str]:
    """IRI and prefix for each (suggested prefix, IRI): rdf first, one prefix an IRI, clashes numbered from 2, unusable suggestions become ns."""
    bound, taken = {T.RDF: "rdf"}, {"rdf"}
    for prefix, iri in wanted:
        if iri in bound:
            continue
        base = prefix if prefix not in ("", "xml", "xmlns") else "ns"
        name, n = base, 2
        while name in taken:
            name, n = f"{base}{n}", n + 1
        bound[iri] = name
        taken.add(name)
    return bound


def header_text(header: dict, prefix: str = "md", kind: str = "FullModel") -> str:
    """A header in fixed field order: id, description, created, scenarioTime, version, Supersedes, DependentOn, profile, authority."""
    from xml.sax.saxutils import escape, quoteattr

    one = lambda name, key: [f"    <{prefix}:Model.{name}>{escape(header[key])}</{prefix}:Model.{name}>"] if header.get(key) is not None else []
    refs = lambda name, key: [f"    <{prefix}:Model.{name} rdf:resource={quoteattr(x)}/>" for x in header.get(key) or ()]
    lines = one("created", "created") + one("scenarioTime", "scenario_time") + one("version", "version") + one("description", "description") + one("modelingAuthoritySet", "authority")
    lines += refs("Supersedes", "supersedes") + refs("DependentOn", "depends_on") + [f"    <{prefix}:Model.profile>{escape(x)}</{prefix}:Model.profile>" for x in header.get("profiles") or ()]
    return "\n".join([f"  <{prefix}:{kind} rdf:about={quoteattr(header['id'])}>", *lines, f"  </{prefix}:{kind}>"])


def content_id(m: Model, parts: int = 4096) -> str:
    """SHA-256 of a model's content: of each object's class and sorted values, then of ``parts`` ranges of identifiers, then of those in order.

    A tree of hashes, so no task holds more than a part of the identifiers; it doesn't depend on how the tables are partitioned (F6).
    """
    from ..operators.difference import value_text

    values = m.slots.select("mrid", F.concat_ws("\x1f", "attr", "kind", value_text()).alias("v")).groupBy("mrid").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("v")), "\x1e"), 256).alias("v"))
    each = m.objects.join(wide(values), "mrid", "left").select("mrid", F.sha2(F.concat_ws("\x1f", "mrid", "class", "v"), 256).alias("h"))
    bucket = F.conv(F.substring(F.md5("mrid"), 1, 6), 16, 10).cast("long") % parts
    ranges = each.groupBy(bucket.alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return ranges.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: F.concat_ws(":", x["part"], x["h"])), ","), 256)).first()[0]


def derived_header(m: Model, profiles: list[str], vintage: str = "", created: str | None = None, namespace: str = "6ba7b811-9dad-11d1-80b4-00c04fd430c8") -> dict:
    """A header whose id is a name-based UUID over vintage, profiles and content, version 1, without a clock."""
    import uuid

    name = "\n".join([vintage, *profiles, content_id(m)])
    return {"id": f"urn:uuid:{uuid.uuid5(uuid.UUID(namespace), name)}", "version": "1", "profiles": profiles, "created": created}


def root_text(namespaces: dict[str, str], header: str = "") -> str:
    """The beginning of a document: ``namespaces`` by prefix."""
    attributes = "".join(f' xmlns:{k}="{v}"' for k, v in {"rdf": T.RDF, **namespaces}.items())
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF{attributes}>\n{header}'


END = "</rdf:RDF>"


def write_elements(rows: DataFrame, path: str, header: str, namespaces: dict[str, str]) -> None:
    """One document in part files: ``rows`` (mrid, element) sorted by identifier; its text is the parts in name order.

    Elements are settled first: dealing in ranges reads its rows twice, and would render them twice.
    """
    spark = rows.sparkSession
    ends = spark.createDataFrame([(0, "", root_text(namespaces, header)), (2, "", END)], "part int, mrid string, element string")
    body = cut(rows.select(F.lit(1).alias("part"), "mrid", "element"))
    ends.unionByName(body).orderBy("part", *M.sort_keys(M.parse(F.col("mrid")))).select("element").write.mode("overwrite").text(path)


def write_documents(elements: DataFrame, heads: DataFrame, path: str, namespaces: dict[str, str], zipped: bool = False) -> list[str]:
    """One file for each document under ``path``, or the archive ``path``: ``elements`` (document, mrid, element) sorted by identifier, between its root and end; ``heads``: document and header text (or null).

    All documents are dealt in ranges by name and identifier, once their elements are settled, and written in parts by all tasks; the parts are then joined by copying (``datasource``).
    """
    start = F.concat_ws("", F.lit(root_text(namespaces)), F.when(F.col("header").isNotNull(), F.concat("header", F.lit("\n"))))
    ends = heads.select("document", F.explode(F.array(F.struct(F.lit(0).alias("part"), start.alias("text")), F.struct(F.lit(2).alias("part"), F.lit(END + "\n").alias("text")))).alias("x")).select("document", "x.part", F.lit("").alias("mrid"), "x.text")
    body = cut(elements.select("document", F.lit(1).alias("part"), "mrid", F.concat("element", F.lit("\n")).alias("text")))
    order = ["document", "part", *M.sort_keys(M.parse(F.col("mrid")))]
    rows = ends.unionByName(body)
    return datasource.write(rows.repartitionByRange(*order).sortWithinPartitions(*order), path, zipped)


def write_profile(m: Model, scope: int, path: str, header: str, namespaces: dict[str, str], prefix: Prefix = "cim") -> None:
    """The values of a profile set as one document (B2)."""
    write_elements(rendered(m, scope, prefix), path, header, namespaces)


def write_model(m: Model, path: str, header: str, namespaces: dict[str, str], prefix: Prefix = "cim") -> None:
    """A whole model as one document (B1)."""
    write_elements(whole(m, prefix), path, header, namespaces)


def populated(m: Model) -> DataFrame:
    """profile, bit and iri of the profiles that some value came with."""
    bits = m.slots.agg(F.bit_or("profiles").alias("mask")).first().mask or 0
    return m.vocabulary.profiles.where(F.call_function("shiftright", F.lit(bits), F.col("bit")).bitwiseAND(F.lit(1)) != 0)


#: What stands at the head of a written document: nothing, or a header that follows from its content. A given header is its text.
OMIT, DERIVE = "omit", "derive"


def profile_headers(m: Model, headers: dict[str, str] | str = DERIVE) -> list[tuple]:
    """profile, bit and header text (None: none) of each populated profile: given ones, derived ones, or none."""
    out = []
    for p in populated(m).orderBy("bit").collect():  # a row for each profile
        given = headers.get(p.profile, DERIVE) if isinstance(headers, dict) else headers
        if given == DERIVE:
            given = header_text(derived_header(m.with_(slots=m.in_profiles(1 << p.bit)), [p.iri]))
        out.append((p.profile, p.bit, None if given == OMIT else given))
    return out


def save_profiles(m: Model, folder: str, stem: str, namespaces: dict[str, str], prefix: Prefix = "cim", headers: dict[str, str] | str = DERIVE) -> dict[str, str]:
    """One document in part files for each populated profile, ``<stem>_<profile>`` in ``folder``; the path of each profile."""
    out = {}
    for profile, bit, header in profile_headers(m, headers):
        out[profile] = f"{folder}/{stem}_{profile}"
        write_profile(m, 1 << bit, out[profile], header or "", {"md": MD, **namespaces}, prefix)
    return out


def save_files(m: Model, path: str, stem: str, suggested: dict[str, str] | None = None, headers: dict[str, str] | str = DERIVE, zipped: bool = False) -> list[str]:
    """One file ``<stem>_<profile>.xml`` for each populated profile, under ``path`` or in the archive ``path``; what was written.

    Each namespace of the vocabulary gets its own prefix, ``suggested`` by namespace.
    """
    bound = prefixes_of(m.vocabulary, suggested or {})
    heads, parts_of = [], []
    for profile, bit, header in profile_headers(m, headers):
        name = f"{stem}_{profile}.xml"
        heads.append((name, header))
        parts_of.append(rendered(m, 1 << bit, bound).select(F.lit(name).alias("document"), "mrid", "element"))
    if not heads:
        return []
    spark = m.slots.sparkSession
    return write_documents(reduce(DataFrame.unionByName, parts_of), spark.createDataFrame(heads, "document string, header string"), path, {p: ns for ns, p in bound.items() if p != "rdf"}, zipped)


def header_element(prefix: str = "md", kind: str = "FullModel") -> Column:
    """The text of a header from the columns of ``headers_of``, in fixed field order; fields of other names follow as they are."""
    text = lambda name, value: F.concat(F.lit(f"    <{prefix}:Model.{name}>"), X.escape_text(value), F.lit(f"</{prefix}:Model.{name}>"))
    reference = lambda name, value: F.concat(F.lit(f'    <{prefix}:Model.{name} rdf:resource="'), X.escape_attribute(value), F.lit('"/>'))
    one = [F.when(F.col(c).isNotNull(), F.array(text(name, F.col(c)))).otherwise(F.array().cast("array<string>")) for name, c in (("created", "created"), ("scenarioTime", "scenario_time"), ("version", "version"), ("description", "description"), ("modelingAuthoritySet", "authority"))]
    more = F.transform(F.filter(F.coalesce("extra", F.array().cast("array<struct<ns:string,local:string,value:string>>")), lambda x: (x["ns"] == MD) & x["local"].rlike(r"^[\w.-]+$")), lambda x: F.concat(F.lit(f"    <{prefix}:"), x["local"], F.lit(">"), X.escape_text(x["value"]), F.lit(f"</{prefix}:"), x["local"], F.lit(">")))
    many = [F.transform("supersedes", lambda x: reference("Supersedes", x)), F.transform("depends_on", lambda x: reference("DependentOn", x)), F.transform("profiles", lambda x: text("profile", x))]
    about = F.when(F.col("id").isNotNull(), F.concat(F.lit(' rdf:about="'), X.escape_attribute(F.col("id")), F.lit('"'))).otherwise("")
    return F.array_join(F.concat(F.array(F.concat(F.lit(f"  <{prefix}:{kind}"), about, F.lit(">"))), *one, *many, more, F.array(F.lit(f"  </{prefix}:{kind}>"))), "\n")


def save_as_loaded(m: Model, docs: Documents, heads: DataFrame, path: str, suggested: dict[str, str] | None = None, zipped: bool = False) -> tuple[list[str], DataFrame, DataFrame]:
    """One file for each full header, named as it was loaded, with its header, its objects and the values of its profiles.

    Gives what was written, the files that were skipped (no header of a model, or none of its profiles known), and the values that no file can take. Two files of one name, as
    entries of different folders, get different ones.
    """
    bound = prefixes_of(m.vocabulary, suggested or {})
    elements, unwritten = as_loaded(m, docs, heads, bound)
    known = file_masks(heads, m.vocabulary).select("file")
    full = heads.where("kind = 'full'").join(known, "file", "left_semi")
    skipped = docs.files.select("file").join(full.select("file"), "file", "left_anti")
    name = F.regexp_replace(F.substring_index("file", "!", -1), r"(?i)(\.xml)?$", "")
    named = cut(safe_names(full.withColumn("name", F.concat(name, F.lit(".xml")))).withColumnRenamed("output", "document"))
    heads_text = named.select("document", header_element().alias("header"))
    placed = elements.join(T.near(named.select("file", "document"), named.count()), "file").select("document", "mrid", "element")
    return write_documents(placed, heads_text, path, {p: ns for ns, p in bound.items() if p != "rdf"}, zipped), skipped, unwritten


def as_loaded(m: Model, docs: Documents, heads: DataFrame, prefix: Prefix = "cim") -> tuple[DataFrame, DataFrame]:
    """file, mrid and element text of every object of every file as it was loaded, and the values that no file can take.

    An object goes to the files that named it, with the values of their profiles, in one pass for all files; objects of no file go to the first file that has
    a profile of theirs.
    """
    masks = cut(file_masks(heads, m.vocabulary).join(docs.files, "file").select("file_seq", "file", F.col("profiles").alias("file_mask")))
    n_files = masks.count()
    members = m.members.join(T.near(masks, n_files), "file_seq")
    # the first file of each profile; a value's mask is told bit by bit, so nothing meets all files
    firsts = F.broadcast(masks.select(F.explode(P.bits(F.col("file_mask"))).alias("bit"), F.struct("file_seq", "file", "file_mask").alias("f")).groupBy("bit").agg(F.min("f").alias("f")))  # 64 rows at most
    homeless = m.slots.join(wide(members.select("mrid").distinct()), "mrid", "left_anti").select("mrid", F.explode(P.bits(F.col("profiles"))).alias("bit")).distinct().join(firsts, "bit")
    adopted = homeless.groupBy("mrid").agg(F.min("f").alias("f")).select("f.file_seq", "mrid", "f.file", "f.file_mask")
    homes = members.select("file_seq", "mrid", "file", "file_mask").unionByName(adopted)
    used = F.broadcast(m.vocabulary.attrs.select(F.col("attr").alias("_root"), "used_in"))
    slots = m.slots.withColumn("_root", F.substring_index("attr", "/", 1)).join(used, "_root").drop("_root")
    fits = F.when(F.col("profiles") != 0, F.col("profiles")).otherwise(F.col("used_in")).bitwiseAND(F.col("file_mask")) != 0
    placed = slots.join(wide(homes), "mrid").where(fits)
    unwritten = m.slots.join(wide(placed.select("mrid", "attr", "ord").distinct()), ["mrid", "attr", "ord"], "left_anti")
    defined = F.broadcast(m.vocabulary.classes.select("class", "defined_in"))
    objects = homes.join(wide(m.objects.select("mrid", "class")), "mrid").join(defined, "class").select("file", "mrid", F.col("class").alias("element"), (F.col("defined_in").bitwiseAND(F.col("file_mask")) != 0).alias("introduces"))
    return drawn(objects, placed, m.vocabulary, prefix, ("file", "mrid")), unwritten
