"""Difference models: what turns one state of a model into another, and applying it (2.H).

A statement is a row (direction, mrid, class, defines, attr, kind, value): ``reverse`` ones are retracted, then ``forward`` ones asserted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import profiles as P
from ..functions.ordered import islands
from ..functions.shared import cut, wide
from .model import Model

#: What the class of an object is called among its values while states are compared.
CLASS = "\x00class"
KEY = ("mrid", "attr", "kind", "value")


def value_text() -> Column:
    """A value as text that equal values share, whatever their spelling; doubles by their bits' hexadecimal order-free cast."""
    return F.coalesce(F.col("v_ref"), F.col("v_text"), F.col("v_int").cast("string"), F.col("v_dbl").cast("string"), F.col("v_bool").cast("string"))


def scoped(m: Model, scope: int | None) -> DataFrame:
    slots = m.slots.where("kind <> 'compound' and not contains(attr, '/')")  # statements can't express compounds
    if scope is not None:
        slots = slots.join(F.broadcast(m.vocabulary.attrs.select("attr", "used_in")), "attr").where(P.in_scope(F.col("profiles"), F.col("used_in"), F.lit(scope)))
    return slots.select("mrid", "attr", "kind", value_text().alias("value"))


def statements(base: Model, target: Model, scope: int | None = None) -> DataFrame:
    """The statements that turn ``base`` into ``target``: a multiset difference for each attribute, both ways (H1-H3).

    One signed count of values and classes over both states gives everything, so the states are shuffled once; it is settled, as small as
    the difference, and the rest works on it.
    """
    classes_of = lambda m: m.objects.select("mrid", F.lit(CLASS).alias("attr"), F.lit("class").alias("kind"), F.col("class").alias("value"))
    was, now = scoped(base, scope).unionByName(classes_of(base)), scoped(target, scope).unionByName(classes_of(target))
    counted = cut(was.withColumn("n", F.lit(-1)).unionByName(now.withColumn("n", F.lit(1))).groupBy(*KEY).agg(F.sum("n").alias("n")).where("n <> 0"))
    values = counted.where(F.col("attr") != CLASS)
    rows = values.withColumns({"direction": F.when(F.col("n") > 0, "forward").otherwise("reverse"), "n": F.explode(F.sequence(F.lit(1), F.abs("n").cast("int")))}).drop("n")
    # objects whose class is in both states have no row here
    classes = counted.where(F.col("attr") == CLASS).groupBy("mrid").agg(F.max(F.when(F.col("n") < 0, F.col("value"))).alias("was"), F.max(F.when(F.col("n") > 0, F.col("value"))).alias("now"))
    only_class = classes.where("was <> now").join(wide(rows.where("direction = 'forward'").select("mrid")), "mrid", "left_anti").select("mrid", F.lit("mRID").alias("attr"), F.lit("class").alias("kind"), F.col("now").alias("value"), F.lit("forward").alias("direction"))
    named = rows.unionByName(only_class).join(wide(classes), "mrid", "left")
    return named.select(
        "direction", "mrid", *KEY[1:], F.when(F.col("direction") == "forward", F.col("now")).otherwise(F.coalesce("was", "now")).alias("class"),
        (F.col("was").isNull() & F.col("now").isNotNull() & (F.col("direction") == "forward")).alias("defines"),
    )


def counts(found: DataFrame) -> DataFrame:
    """added, removed and changed objects: those with at least one statement. An object is removed if it has a class to lose and nothing asserted."""
    per = found.groupBy("mrid").agg(F.bool_or("defines").alias("added"), (~F.bool_or(F.col("direction") == "forward") & F.bool_or(F.col("class").isNotNull())).alias("removed"))
    return per.agg(F.count_if("added").alias("added"), F.count_if("removed").alias("removed"), F.count_if(~F.col("added") & ~F.col("removed")).alias("changed"))


def deletion_warning(found: DataFrame, most: int = 0) -> DataFrame:
    """One row (severity, rule, n, message) if more than ``most`` objects lose all that they have: statements can't say that an object is gone (H5)."""
    lost = counts(found).select(F.col("removed").alias("n")).where(F.col("n") > most)
    return lost.select(F.lit("warning").alias("severity"), F.lit("structure").alias("rule"), "n", F.concat("n", F.lit(" objects lose all their values")).alias("message"))


def inexpressible(m: Model) -> DataFrame:
    """mrid and attr of the values that statements can't express: compounds (H4)."""
    return m.slots.where("kind = 'compound' or contains(attr, '/')").select("mrid", F.substring_index("attr", "/", 1).alias("attr")).distinct()


def derived_header(base_ids: list[str], content: str, created: str | None = None, namespace: str = "6ba7b811-9dad-11d1-80b4-00c04fd430c8") -> dict:
    """A difference's header: it supersedes the models it is against, each once, and its id is a name-based UUID over them or, without any, over the content (H6)."""
    import uuid

    superseded = list(dict.fromkeys(base_ids))
    return {"id": f"urn:uuid:{uuid.uuid5(uuid.UUID(namespace), chr(10).join(superseded) or content)}", "version": "1", "supersedes": superseded, "created": created}


def affected(found: DataFrame) -> DataFrame:
    """Subjects in order of first appearance; ``found`` has seq."""
    return found.groupBy("mrid").agg(F.min("seq").alias("first")).orderBy("first")


def statement_groups(found: DataFrame) -> DataFrame:
    """Consecutive statements of one direction, subject and class, numbered as groups within their direction (B5). ``found`` has seq."""
    runs = islands(found, F.struct("direction", "mrid", F.coalesce("class", F.lit("")).alias("class")), "run", "direction", "seq")
    first = runs.groupBy("direction").agg(F.min("run").alias("_first"))  # two rows
    return runs.join(F.broadcast(first), "direction").withColumn("group", F.col("run") - F.col("_first") + 1).drop("run", "_first")


SLOT_COLUMNS = ("mrid", "attr", "ord", "kind", "v_bool", "v_int", "v_dbl", "v_text", "v_ref", "lex", "profiles")


def typed_values(found: DataFrame) -> DataFrame:
    """Statements with the columns of slots, from their kind and value."""
    kind, value = F.col("kind"), F.col("value")
    return found.withColumns({
        "ord": F.lit(0), "v_bool": F.when(kind == "bool", value.try_cast("boolean")), "v_int": F.when(kind == "int", value.try_cast("long")), "v_dbl": F.when(kind == "dbl", value.try_cast("double")),
        "v_text": F.when(kind.isin("text", "enum"), value), "v_ref": F.when(kind == "ref", value), "lex": F.lit(None).cast("string"), "profiles": F.lit(0).cast("long"),
    })


def _near(df: DataFrame, rows: int) -> DataFrame:
    """A table as large as a difference, broadcast if its counted rows are few."""
    return F.broadcast(df) if rows <= 100_000 else wide(df)


def _order(found: DataFrame) -> Column:
    return F.col("seq") if "seq" in found.columns else F.col("value")


def apply(base: Model, found: DataFrame, profiles: int = 0) -> Model:
    """``base`` with the statements applied: retract, retype, assert, then drop touched objects without values (H7-H9).

    The values of objects that statements name are settled once, and all is judged on them; the others pass by an anti-join with the statements' keys, whose rows are counted. A retraction takes the first of equal
    values, by place and spelling; asserted values come after those there, in the order of ``seq`` if ``found`` has it, and of a single-valued attribute the last stays. Asserted values belong to ``profiles``.
    """
    return _applied(base, cut(found), profiles)[0]


def _applied(base: Model, found: DataFrame, profiles: int, own: DataFrame | None = None) -> tuple[Model, DataFrame, DataFrame]:
    """The changed model, the values that reclassifying shed, and the retractions that found no value (mrid, attr, n).

    ``own``: mrid and class, as ``was``, of the base's objects that statements name, where they are known.
    """
    order = _order(found)
    values = typed_values(found.where("kind <> 'class'")).withColumn("profiles", F.lit(profiles).cast("long")).select(*SLOT_COLUMNS, "value", F.when(F.col("direction") == "reverse", 1).otherwise(2).alias("side"), F.struct(order.alias("at")).alias("at"))
    keys = cut(values.select("mrid", "attr").distinct())
    n_keys = keys.count()
    touched = cut(found.select("mrid").distinct())
    n_touched = touched.count()
    stay = base.slots.join(_near(keys, n_keys), ["mrid", "attr"], "left_anti").select(*SLOT_COLUMNS)
    theirs = cut(base.slots.join(_near(touched, n_touched), "mrid", "left_semi").select(*SLOT_COLUMNS))
    held = theirs.join(_near(keys, n_keys), ["mrid", "attr"], "left_semi").select(*SLOT_COLUMNS, value_text().alias("value"), F.lit(0).alias("side"), F.lit(None).cast(values.schema["at"].dataType).alias("at"))
    single = F.broadcast(base.vocabulary.attrs.where("most = 1").select("attr", F.lit(True).alias("_single")))
    rows = held.unionByName(values).join(single, "attr", "left").repartition("mrid", "attr")
    equal = Window.partitionBy("mrid", "attr", "kind", "value")
    told = cut(rows.withColumns({"_gone": F.count_if(F.col("side") == 1).over(equal), "_held": F.count_if(F.col("side") == 0).over(equal), "_n": F.row_number().over(equal.orderBy("side", "ord", "lex", "profiles", "at"))}))
    missed = told.where((F.col("side") == 1) & (F.col("_n") - F.col("_held") > F.col("_held"))).groupBy("mrid", "attr").agg(F.count("*").alias("n"))
    kept = told.where(((F.col("side") == 0) & (F.col("_n") > F.col("_gone"))) | (F.col("side") == 2))
    group = Window.partitionBy("mrid", "attr")
    placed = kept.withColumns({"ord": F.row_number().over(group.orderBy("side", "ord", "at")) - 1, "_all": F.count("*").over(group), "_set": F.max("side").over(group)})
    placed = placed.where(~(F.coalesce("_single", F.lit(False)) & (F.col("_set") == 2)) | (F.col("ord") == F.col("_all") - 1))
    changed = cut(placed.withColumn("ord", F.when(F.coalesce("_single", F.lit(False)) & (F.col("_set") == 2), 0).otherwise(F.col("ord"))).select(*SLOT_COLUMNS))
    named = found.where("class is not null and direction = 'forward'")
    retype = cut(named.groupBy("mrid").agg((F.min_by("class", "seq") if "seq" in found.columns else F.min("class")).alias("class")))
    m = base.with_(slots=stay.unionByName(changed))
    after = theirs.join(_near(keys, n_keys), ["mrid", "attr"], "left_anti").unionByName(changed.where("ord >= 0"))  # all: a union of a checkpoint itself keeps constraints on columns that it lacks, and Spark fails
    if own is None:
        own = base.objects.join(_near(touched, n_touched), "mrid", "left_semi").select("mrid", F.col("class").alias("was"))
    moved = cut(retype.join(wide(own), "mrid").where("class <> was").drop("was"))
    shed = changed.limit(0)
    n_moved = moved.count()
    if n_moved:
        near_moved = _near(moved, n_moved)
        shed = cut(m.with_(slots=after).reclassify(near_moved)[1])
        lost = wide(shed.select("mrid", "attr").distinct())
        left = lambda slots: slots.join(lost, ["mrid", "attr"], "left_anti")
        m, after = m.with_(objects=m.reclassify(near_moved)[0].objects, slots=left(m.slots)), left(after)
    owner = m.vocabulary.attrs.select("attr", "owner")
    first = values.where("side = 2").join(F.broadcast(owner), "attr").groupBy("mrid").agg(F.min_by("owner", "at").alias("owner"))
    created = first.join(wide(own.select("mrid")), "mrid", "left_anti").join(wide(retype), "mrid", "left").select("mrid", F.coalesce("class", "owner").alias("class"), F.lit(profiles).cast("long").alias("profiles"))
    objects = m.objects.select("mrid", "class", "profiles").unionByName(created)
    # of the objects that statements name, those without values go
    empty = touched.join(wide(after.select("mrid").distinct()), "mrid", "left_anti")
    return m.with_(objects=objects.join(_near(empty, n_touched), "mrid", "left_anti")), shed, missed


def apply_checked(base: Model, found: DataFrame, profiles: int = 0) -> tuple[Model, DataFrame]:
    """``apply`` without the statements that can't hold, and findings (severity, rule, mrid, attr, message) (H8, H9).

    Reported are: a class that isn't known (the object keeps its own), a change to a class that is no refinement, the values that such a change sheds, an assertion of an attribute that the object's class then lacks (it is left out),
    a retraction from an object that isn't there, and one of a value that isn't. ``found`` are resolved statements: what is wrong with their names and values, ``resolve`` reports.
    """
    from .validate import finding

    v = base.vocabulary
    found, order = cut(found), _order(found)
    touched = cut(found.select("mrid").distinct())
    own = cut(base.objects.join(_near(touched, touched.count()), "mrid", "left_semi").select("mrid", F.col("class").alias("was")))
    classes = F.broadcast(v.classes.select("class"))
    named = found.where("class is not null and direction = 'forward'").groupBy("mrid").agg(F.min_by("class", order).alias("class"))
    unknown = finding(named.join(classes, "class", "left_anti"), "warning", "unknown-class", F.col("class"))
    retype = cut(named.join(classes, "class", "left_semi"))
    moved = retype.join(wide(own), "mrid").where("class <> was")
    narrower = F.broadcast(v.closure().select("class", F.col("ancestor").alias("was")))
    sideways = finding(moved.join(narrower, ["class", "was"], "left_anti"), "info", "structure", F.concat(F.lit("from "), F.col("was"), F.lit(" to "), F.col("class")))
    values = found.where("kind <> 'class'")
    absent = finding(values.where("direction = 'reverse'").join(wide(own), "mrid", "left_anti"), "warning", "dangling-reference", F.lit("not in the model"), F.col("attr"))
    owners = F.broadcast(v.attrs.select("attr", "owner"))
    first = values.where("direction = 'forward'").join(owners, "attr").groupBy("mrid").agg(F.min_by("owner", order).alias("owner"))
    becomes = first.join(wide(own), "mrid", "left").join(wide(retype), "mrid", "left").select("mrid", F.coalesce("class", "was", "owner").alias("_becomes"))
    owned = F.broadcast(v.class_attrs().select(F.col("class").alias("_becomes"), "attr", F.lit(True).alias("_owned")))
    judged = cut(found.join(wide(becomes), "mrid", "left").join(owned, ["_becomes", "attr"], "left").withColumn("_foreign", (F.col("direction") == "forward") & (F.col("kind") != "class") & F.col("_owned").isNull()))
    foreign = finding(judged.where("_foreign"), "warning", "class-membership", F.concat("_becomes", F.lit(" has no "), "attr"), F.col("attr"))
    usable = judged.where("not _foreign").join(F.broadcast(v.classes.select("class", F.lit(True).alias("_known"))), "class", "left").withColumn("class", F.when(F.col("_known"), F.col("class"))).select(*found.columns)
    done, shed, missed = _applied(base, cut(usable), profiles, own)
    lost = finding(shed.join(wide(retype), "mrid"), "warning", "structure", F.concat("attr", F.lit(" was dropped with the class")), F.col("attr"))
    missing = finding(missed.join(wide(own), "mrid", "left_semi"), "info", "structure", F.concat("n", F.lit(" not present")), F.col("attr"))
    out = unknown
    for more in (sideways, absent, foreign, lost, missing):
        out = out.unionByName(more)
    return done, cut(out)


def resolve(raw: DataFrame, m: Model, check_literals: bool = True) -> tuple[DataFrame, DataFrame]:
    """Statements whose names and values the vocabulary knows, and findings of the others (H9). ``raw``: direction, seq, mrid, class, defines, attr, ns, resource and text, as ``cimxml.raw_statements`` reads them."""
    from ..functions import mrid as M
    from ..functions import values as V
    from .validate import finding

    v = m.vocabulary
    named = F.broadcast(v.attrs.select("attr", "ns", F.col("kind").alias("declared"), "primitive"))
    joined = raw.join(named, ["attr", "ns"], "left")
    literals = F.broadcast(v.literals.select(F.concat_ws(".", "enum", F.substring_index("literal", ".", -1)).alias("_literal"), F.lit(True).alias("_known")).distinct())
    joined = joined.withColumn("_literal", F.regexp_extract("resource", r"#([^#/]*)$", 1)).join(literals, "_literal", "left")
    value = V.parse_primitive(F.col("text"), F.coalesce("primitive", F.lit("String")))
    declared, is_class = F.col("declared"), F.coalesce(F.col("attr") == "mRID", F.lit(False)) & F.col("class").isNotNull() & F.col("resource").isNull()
    kind = F.when(is_class, "class").when(declared.isin("ref", "enum"), declared).when(F.col("resource").isNotNull(), "ref").when(F.col("primitive") == "Boolean", "bool").when(F.col("primitive") == "Integer", "int").when(F.col("primitive").isin("Float", "Decimal"), "dbl").otherwise("text")
    text = F.when(is_class, F.col("class")).when(kind == "ref", M.parse(F.col("resource"))["key"]).when(kind == "enum", F.col("_literal")).otherwise(F.coalesce(value["v_text"], value["v_int"].cast("string"), value["v_dbl"].cast("string"), value["v_bool"].cast("string")))
    no_name = F.col("declared").isNull() & ~is_class
    enum = ~no_name & (declared == "enum")
    no_iri = enum & (F.col("resource").isNull() | ~F.coalesce(F.col("resource").contains("#"), F.lit(False)))
    no_literal = enum & ~no_iri & F.lit(check_literals) & F.col("_known").isNull()
    bad_value = ~no_name & ~enum & ~is_class & (F.when(declared == "ref", F.col("resource").isNull()).otherwise(F.col("resource").isNull() & ~value["ok"]))
    why = F.when(no_name, "class-membership").when(no_iri | no_literal | bad_value, "unparseable-value")
    judged = joined.withColumns({"kind": kind, "value": text, "_why": why, "_message": F.when(no_name, F.concat(F.lit("no property "), "attr")).when(no_iri, F.concat(F.lit("no IRI: "), F.coalesce("resource", "text"))).when(no_literal, F.concat(F.lit("no literal: "), "resource")).otherwise(F.concat_ws(" for ", "text", F.coalesce("primitive", "declared")))})
    settled = cut(judged)
    bad = settled.where("_why is not null")
    problems = finding(bad.where("_why = 'class-membership'"), "warning", "class-membership", F.col("_message"), F.col("attr")).unionByName(finding(bad.where("_why <> 'class-membership'"), "error", "unparseable-value", F.col("_message"), F.col("attr")))
    return settled.where("_why is null").select("direction", "seq", "mrid", "class", "defines", "attr", "kind", "value"), problems


def statement_lines(found: DataFrame, m: Model, prefix: str = "cim") -> DataFrame:
    """direction, seq and the text of each group of statements: consecutive ones of one subject and class share an element."""
    from ..sources.cimxml import drawn

    v = F.col("value")
    kind = F.col("kind")
    slots = found.where("kind <> 'class'").withColumns({
        "ord": F.lit(0), "v_bool": F.when(kind == "bool", v.try_cast("boolean")), "v_int": F.when(kind == "int", v.try_cast("long")), "v_dbl": F.when(kind == "dbl", v.try_cast("double")),
        "v_text": F.when(kind.isin("text", "enum"), v), "v_ref": F.when(kind == "ref", v), "lex": F.lit(None).cast("string"),
    })
    grouped = statement_groups(slots)
    heads = grouped.groupBy("direction", "group", "mrid").agg(F.max("class").alias("class"), F.bool_or("defines").alias("introduces"), F.min("seq").alias("seq"))
    objects = heads.withColumn("element", F.coalesce("class", F.lit("\x00")))
    lines = drawn(objects, grouped, m.vocabulary, prefix, ("direction", "group", "mrid"))
    described = F.replace("element", F.lit(f"{prefix}:\x00"), F.lit("rdf:Description"))
    return lines.withColumn("element", described).join(wide(heads.select("direction", "group", "seq")), ["direction", "group"]).select("direction", "seq", "element")


def write(found: DataFrame, m: Model, path: str, header: dict, namespaces: dict[str, str], prefix: str = "cim") -> None:
    """A difference model as one document in part files, reverse statements first (B5). ``found`` has seq."""
    from ..sources import cimxml

    lines = cut(statement_lines(found, m, prefix).select(F.when(F.col("direction") == "reverse", 1).otherwise(3).alias("part"), F.col("seq").cast("long").alias("seq"), "element"))
    bound = {"rdf": cimxml.T.RDF, "md": cimxml.MD, "dm": cimxml.DM, **namespaces}
    head = cimxml.header_text(header, kind="DifferenceModel").replace("md:DifferenceModel", "dm:DifferenceModel").rsplit("\n", 1)[0]
    root = "".join(f' xmlns:{k}="{v}"' for k, v in bound.items())
    frame = [(0, f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF{root}>\n{head}\n<dm:reverseDifferences rdf:parseType="Statements">'), (2, '</dm:reverseDifferences>\n<dm:forwardDifferences rdf:parseType="Statements">'), (4, "</dm:forwardDifferences>\n  </dm:DifferenceModel>\n</rdf:RDF>")]
    ends = found.sparkSession.createDataFrame([(p, 0, t) for p, t in frame], "part int, seq long, element string")
    ends.unionByName(lines).orderBy("part", "seq").select("element").write.mode("overwrite").text(path)
