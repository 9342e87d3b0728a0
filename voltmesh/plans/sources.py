"""Queries over documents as files: the data source, archives, as-loaded files, positions, deep compounds, findings of changes, and lookups by vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions import xmltext as X
from ..functions.shared import cut, new_folder
from ..operators import difference as D
from ..operators import edits as E
from ..operators import model as O
from ..operators import rdf
from ..operators import validate as K
from ..operators.inverse import InverseIndex
from ..operators.views import typed_view
from ..operators.vocabulary import Vocabulary
from ..sources import cimxml, datasource, rdfs
from ..sources import xmltokens as T
from . import star
from .documents import _NAMES, shown
from .registry import query, t

_VALUES = f"{_NAMES} union all select 'customer:' || c_custkey, 'Party.acctbal', 'dbl', round(c_acctbal * 100)::bigint::varchar, 2 from customer"


def _hundredths(slots: DataFrame) -> DataFrame:
    return shown(slots).withColumn("value", F.when(F.col("kind") == "dbl", F.round(F.col("value").cast("double") * 100).cast("long").cast("string")).otherwise(F.col("value")))


def _files(spark: SparkSession, sf: str, zipped: bool = False) -> str:
    """Documents of three tables, a file for each profile or one archive."""
    folder = new_folder(spark, "documents")
    cimxml.save_files(star.model(spark, sf, ("region", "nation", "customer")), f"{folder}/star.zip" if zipped else folder, "star", {star.NS: "s"}, zipped=zipped)
    return folder


@query(_VALUES)
def cim_archive_values(spark, sf):
    """Profiles saved as one archive, deflated in parts by all tasks, and read back by entry."""
    return _hundredths(cimxml.read(cimxml.folder(spark, _files(spark, sf, True)), star.vocabulary(spark))[0].slots)


@query(_VALUES)
def cim_as_loaded_values(spark, sf):
    """Files read, saved as they were loaded, and read back: the same values with the same provenance."""
    v = star.vocabulary(spark)
    docs = cimxml.folder(spark, _files(spark, sf))
    m, heads, _ = cimxml.read(docs, v)
    folder = new_folder(spark, "documents")
    cimxml.save_as_loaded(m, docs, heads, folder, {star.NS: "s"})
    return _hundredths(cimxml.read(cimxml.folder(spark, folder), v)[0].slots)


@query("select 'star_REF.xml' as name, 'full' as kind, '1' as version, 'http://example.org/profiles/Reference/3.0' as profile, true as early union all select 'star_OPS.xml', 'full', '1', 'http://example.org/profiles/Operation/3.0', true")
def cim_peek_headers(spark, sf):
    """Headers read by the beginnings of files."""
    heads = cimxml.peek_headers(spark, _files(spark, sf))
    return heads.select(F.substring_index("file", "/", -1).alias("name"), "kind", "version", F.element_at("profiles", 1).alias("profile"), (F.col("bytes_read") <= F.least(F.lit(8192).cast("long"), F.col("size"))).alias("early"))


@query("select 'star_REF.xml' as name, true as named union all select 'star_OPS.xml', true")
def cim_peek_vintage(spark, sf):
    """The vocabulary that files name, read up to the tag that names it."""
    seen = cimxml.peek_namespaces(spark, _files(spark, sf), (star.NS,))
    return seen.groupBy(F.substring_index("file", "/", -1).alias("name")).agg(F.bool_or((F.col("ns") == star.NS) & (F.col("bytes_read") <= 8192)).alias("named"))


_LINE = "'<s:Customer rdf:ID=\"_c' || c_custkey || '\"><s:Thing.name>' || c_name || '</s:Thing.name>'"


@query(f"select 'CIM0002' as rule, 'c' || c_custkey as written, (row_number() over (order by c_custkey) + 2)::bigint as line, (length({_LINE}) + 1)::bigint as col from customer")
def cim_positions(spark, sf):
    """The line and column of each finding in a file of many splits."""
    line = F.concat(F.lit('<s:Customer rdf:ID="_c'), "c_custkey", F.lit('"><s:Thing.name>'), "c_name", F.lit("</s:Thing.name><s:Thing.shade>x</s:Thing.shade></s:Customer>\n"))
    frame = spark.createDataFrame([(0, cimxml.root_text({"s": star.NS})), (2, cimxml.END)], "part int, text string").withColumn("c_custkey", F.lit(0).cast("long"))
    rows = t(spark, sf, "customer").select(F.lit(1).alias("part"), line.alias("text"), F.col("c_custkey").cast("long").alias("c_custkey")).unionByName(frame)
    folder = new_folder(spark, "documents")
    datasource.write(rows.repartitionByRange("part", "c_custkey").sortWithinPartitions("part", "c_custkey").select(F.lit("customers.xml").alias("document"), "text"), folder)
    docs = cimxml.documents(spark, folder)
    return cimxml.located(cimxml.read(docs, star.vocabulary(spark), most_findings=0)[2], docs).select("rule", "written", "line", "col")


def _deep_vocabulary(spark: SparkSession) -> Vocabulary:
    v = star.vocabulary(spark)
    classes = [(c, star.NS, None, False, 1, 1, 0, False) for c in ("Address", "Town", "Point")]
    compound = lambda name, owner, target: (name, star.NS, owner, "compound", None, target, 0, 1, 1, False, "")
    value = lambda name, owner, kind: (name, star.NS, owner, "value", kind, None, 0, 1, 1, False, "")
    attrs = [compound("Customer.home", "Customer", "Address"), compound("Address.town", "Address", "Town"), compound("Town.place", "Town", "Point"), value("Address.street", "Address", "String"), value("Town.name", "Town", "String"), value("Point.zone", "Point", "Integer"), value("Point.note", "Point", "String")]
    return Vocabulary(v.classes.unionByName(spark.createDataFrame(classes, v.classes.schema)), v.attrs.unionByName(spark.createDataFrame(attrs, v.attrs.schema)), v.literals, v.profiles, v.inverses)


#: The paths of a customer's home, with the SQL and the Spark expression of each value.
HOME = {
    "Customer.home/Address.street": ("text", "c_mktsegment || ' road'", "concat(c_mktsegment, ' road')"),
    "Customer.home/Address.town/Town.name": ("text", "'T' || c_nationkey", "concat('T', c_nationkey)"),
    "Customer.home/Address.town/Town.place/Point.zone": ("int", "c_custkey::varchar", "cast(c_custkey as string)"),
    "Customer.home/Address.town/Town.place/Point.note": ("text", "c_name || ' & co'", "concat(c_name, ' & co')"),
}
_DEEP = " union all ".join(f"select 'customer:' || c_custkey as mrid, '{path}' as attr, '{kind}' as kind, {sql} as value from customer" for path, (kind, sql, _) in HOME.items())


def _deep(spark, sf) -> O.Model:
    """Customers with homes three compounds deep."""
    rows = t(spark, sf, "customer")
    kinds = {"text": ("v_text", "string"), "int": ("v_int", "long")}
    items = [F.struct(F.lit(path).alias("attr"), F.lit(kind).alias("kind"), *((F.expr(e) if kinds[kind][0] == c else F.lit(None)).cast(ty).alias(c) for c, ty in kinds.values())) for path, (kind, _, e) in HOME.items()]
    slots = rows.select(F.expr("concat('customer:', c_custkey)").alias("mrid"), F.inline(F.array(*items))).selectExpr("mrid", "attr", "0 as ord", "kind", "cast(null as boolean) as v_bool", "v_int", "cast(null as double) as v_dbl", "v_text", "cast(null as string) as v_ref", "cast(null as string) as lex", "cast(1 as bigint) as profiles")
    m = star.model(spark, sf, ("customer",), ["Party.Nation"])
    return m.with_(vocabulary=_deep_vocabulary(spark), slots=slots.unionByName(m.slots))


@query(_DEEP)
def cim_deep_values(spark, sf):
    """Values three compounds deep, written nested into one file and read back."""
    m = _deep(spark, sf)
    folder = new_folder(spark, "documents")
    cimxml.save_files(m, folder, "deep", {star.NS: "s"})
    return shown(cimxml.read(cimxml.folder(spark, folder), m.vocabulary)[0].slots.where("attr like 'Customer.home/%'")).drop("profiles")


@query("select 'customer:' || c_custkey as mrid, 'Customer.home' as attr, '{Address.street=' || c_mktsegment || ' road, Address.town={Town.name=T' || c_nationkey || ', Town.place={Point.note=' || c_name || ' & co, Point.zone=' || c_custkey || '}}}' as text from customer")
def deep_display(spark, sf):
    """Nested compounds for people."""
    return _deep(spark, sf).display().where("attr = 'Customer.home'").select("mrid", "attr", "text")


@query("""select 'CIM0019' as rule, 'customer:' || c_custkey as mrid, 'Customer.home/Address.town/Town.place/Point.note' as attr, 'at byte ' || octet_length(encode(c_name)) as message from customer where c_custkey % 5 = 0
 union all select 'CIM0016', 'customer:' || c_custkey, 'Customer.home/Address.town/Town.place/Point.zone', 'text for Integer' from customer where c_custkey % 7 = 0
 union all select 'CIM0002', 'customer:' || c_custkey, 'Customer.home/Address.street/Town.name', 'Address.street has no Town.name' from customer where c_custkey % 11 = 0
 union all select 'CIM0016', 'customer:' || c_custkey, 'Customer.home/Address.street', 'compound for String' from customer where c_custkey % 11 = 0
 union all select 'CIM0002', 'customer:' || c_custkey, 'Customer.home/Point.note', 'Address has no Point.note' from customer where c_custkey % 13 = 0""")
def deep_rules(spark, sf):
    """Rules over values inside compounds, all in one validation."""
    m = _deep(spark, sf)
    key = F.expr("cast(substring_index(mrid, ':', -1) AS bigint)")
    zone, note = F.col("attr").endswith("/Point.zone"), F.col("attr").endswith("/Point.note")
    changed = m.slots.withColumns({
        "v_text": F.when(note & (key % 5 == 0), F.replace("v_text", F.lit(" & co"), F.lit("\x01"))).when(zone & (key % 7 == 0), F.col("v_int").cast("string")).otherwise(F.col("v_text")),
        "kind": F.when(zone & (key % 7 == 0), "text").otherwise(F.col("kind")),
    })
    name = m.slots.where("attr like '%/Town.name'")
    stray = name.where(key % 11 == 0).withColumn("attr", F.lit("Customer.home/Address.street/Town.name")).unionByName(name.where(key % 13 == 0).withColumn("attr", F.lit("Customer.home/Point.note")))
    return K.validate(m.with_(slots=changed.unionByName(stray)), K.Options(rules=(K.class_membership, K.datatype, K.illegal_character))).select("rule", "mrid", "attr", "message")


_NODE = "'_:c' || md5('customer:' || c_custkey || '/{}')"
_HOME, _TOWN, _PLACE = (_NODE.format(p) for p in ("Customer.home", "Customer.home/Address.town", "Customer.home/Address.town/Town.place"))


@query(" union all ".join(f"select {s} as subject, '<{star.NS}{p}>' as predicate, {o} as object from customer" for s, p, o in (
    (_HOME, "Address.street", "'\"' || c_mktsegment || ' road\"'"), (_HOME, "Address.town", _TOWN), (_TOWN, "Town.name", "'\"T' || c_nationkey || '\"'"), (_TOWN, "Town.place", _PLACE),
    (_PLACE, "Point.zone", "'\"' || c_custkey || '\"^^<http://www.w3.org/2001/XMLSchema#integer>'"), (_PLACE, "Point.note", "'\"' || c_name || ' & co\"'"),
)) + "".join(f" union all select {s}, '<{rdf.RDF_TYPE}>', '<{star.NS}{c}>' from customer" for s, c in ((_HOME, "Address"), (_TOWN, "Town"), (_PLACE, "Point"))))
def deep_triples(spark, sf):
    """The nodes of nested compounds, typed and linked, with their values (L2)."""
    return rdf.triples(_deep(spark, sf), 1, star.NS).where(F.col("subject").startswith("_:c") & ~F.col("subject").startswith("_:id")).where(F.length("subject") == 35).select("subject", "predicate", "object")


@query("""select 'nation:' || n_nationkey as target, a.attr, a.mrid from nation join (select 'Party.Nation' as attr, 'customer:' || c_custkey as mrid, c_nationkey as k from customer union all select 'Party.Nation', 'supplier:' || s_suppkey, s_nationkey from supplier) a on a.k = n_nationkey where n_regionkey = 2""")
def all_referrers(spark, sf):
    """What refers to a region's nations, from the stored reverse index; lists are kept short so that most targets have several parts."""
    index = InverseIndex.build(star.model(spark, sf, ("nation", "customer", "supplier"), ["Party.Nation", "Nation.Region"]), buckets=8, most=5)
    wanted = t(spark, sf, "nation").where("n_regionkey = 2").select(F.expr("concat('nation:', n_nationkey)").alias("target"))
    found = cut(index.probe(wanted))
    index.drop()
    return found


@query("""select 'customer:' || c_custkey as mrid, 'Customer' as class, c_mktsegment as mktsegment, 'nation:' || c_nationkey as "Nation", c_acctbal as acctbal, c_name as name from customer""")
def view_generated(spark, sf):
    """All columns of a class from the vocabulary, none listed."""
    return typed_view(star.model(spark, sf, ("customer",)), "Customer")


def _statements(spark, sf) -> DataFrame:
    """Statements of each kind that can't hold, about orders."""
    o = t(spark, sf, "orders")
    cases = iter(range(10))  # their order among an order's statements

    def row(where, direction, attr, resource=None, text=None, cls=None, mrid="concat('orders:', o_orderkey)"):
        given = {"class": cls, "attr": attr, "ns": star.NS, "resource": resource, "text": text}
        seq = (F.col("o_orderkey") * 10 + next(cases)).cast("long").alias("seq")
        return o.where(where).select(F.lit(direction).alias("direction"), seq, F.expr(mrid).alias("mrid"), F.lit(False).alias("defines"), *(F.lit(x).cast("string").alias(c) for c, x in given.items()))

    rows = [
        row("o_orderkey % 50 = 0", "forward", "Order.colour", text="red"),
        row("o_orderkey % 51 = 0", "forward", "Order.totalprice", text="much"),
        row("o_orderkey % 52 = 0", "forward", "Order.status", resource=star.NS + "Status.Q"),
        row("o_orderkey % 53 = 0", "reverse", "Order.priority", text="9-NONE"),
        row("o_orderkey % 54 = 0", "reverse", "Order.priority", text="x", mrid="concat('orders:none', o_orderkey)"),
        row("o_orderkey % 55 = 0", "forward", "Part.size", text="7"),
        row("o_orderkey % 57 = 0", "forward", "Part.size", text="8", cls="Part"),
        row("o_orderkey % 59 = 0", "forward", "Order.priority", text="new", cls="Planet"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


_OID = "'orders:' || o_orderkey"


@query(f"""select 'warning' as severity, 'CIM0002' as rule, {_OID} as mrid, 'Order.colour' as attr, 'no property Order.colour' as message from orders where o_orderkey % 50 = 0
 union all select 'error', 'CIM0003', {_OID}, 'Order.totalprice', 'much for Decimal' from orders where o_orderkey % 51 = 0
 union all select 'error', 'CIM0003', {_OID}, 'Order.status', 'no literal: {star.NS}Status.Q' from orders where o_orderkey % 52 = 0
 union all select 'info', 'CIM0015', {_OID}, 'Order.priority', '1 not present' from orders where o_orderkey % 53 = 0
 union all select 'warning', 'CIM0006', 'orders:none' || o_orderkey, 'Order.priority', 'not in the model' from orders where o_orderkey % 54 = 0
 union all select 'warning', 'CIM0002', {_OID}, 'Part.size', 'Order has no Part.size' from orders where o_orderkey % 55 = 0 and o_orderkey % 57 <> 0
 union all select 'info', 'CIM0015', {_OID}, null, 'from Order to Part' from orders where o_orderkey % 57 = 0
 union all select 'warning', 'CIM0015', {_OID}, a, a || ' was dropped with the class' from orders, (values ('Order.Customer'), ('Order.status'), ('Order.totalprice'), ('Order.priority')) v(a) where o_orderkey % 57 = 0
 union all select 'warning', 'CIM0002', {_OID}, 'Order.priority', 'Part has no Order.priority' from orders where o_orderkey % 57 = 0 and o_orderkey % 59 = 0
 union all select 'warning', 'CIM0001', {_OID}, null, 'Planet' from orders where o_orderkey % 59 = 0 and o_orderkey % 57 <> 0""")
def apply_findings(spark, sf):
    """What applying a difference reports, a row for each kind of statement that can't hold (H8, H9)."""
    m = star.model(spark, sf, ("orders",))
    found, problems = D.resolve(_statements(spark, sf), m)
    return problems.unionByName(D.apply_checked(m, found)[1])


@query(f"""select {_OID} as mrid, a as attr, case a when 'Order.Customer' then 'customer:' || o_custkey when 'Order.status' then o_orderstatus when 'Order.totalprice' then round(o_totalprice * 100)::bigint::varchar else case when o_orderkey % 59 = 0 then 'new' else o_orderpriority end end as value
 from orders, (values ('Order.Customer'), ('Order.status'), ('Order.totalprice'), ('Order.priority')) v(a) where o_orderkey % 57 <> 0
 union all select {_OID}, 'Part.size', '8' from orders where o_orderkey % 57 = 0""")
def apply_checked_values(spark, sf):
    """The model after these statements: what can hold is applied, a single value is replaced, a changed class sheds what it lacks (H7-H9)."""
    m = star.model(spark, sf, ("orders",))
    found, _ = D.resolve(_statements(spark, sf), m)
    slots = D.apply_checked(m, found)[0].slots
    return slots.select("mrid", "attr", F.when(F.col("kind") == "dbl", F.round(F.col("v_dbl") * 100).cast("long").cast("string")).otherwise(D.value_text()).alias("value"))


@query("""select 'Nation' as class, label, attr, (select count(*) from nation) as n from (values ('name', 'Thing.name'), ('Region', 'Nation.Region')) v(label, attr)
 union all select 'Supplier', label, attr, (select count(*) from supplier) from (values ('name', 'Thing.name'), ('Nation', 'Party.Nation'), ('acctbal', 'Party.acctbal')) v(label, attr)""")
def attribute_by_label(spark, sf):
    """The attribute that a label means for the objects of each class."""
    m = star.model(spark, sf, ("nation", "supplier"))
    return m.objects.join(F.broadcast(m.vocabulary.attr_by_label()), "class").groupBy("class", "label", "attr").agg(F.count("*").alias("n"))


@query("select 'Region' as class, count(*) as n from region union all select 'Nation', count(*) from nation")
def concrete_in_profile(spark, sf):
    """Objects of the concrete classes of a profile that have no operational values."""
    m = star.model(spark, sf, ("region", "nation", "orders"))
    known = m.vocabulary.classes_in(0).join(m.vocabulary.concrete_classes().select("class"), "class", "left_semi").select("class")
    return m.objects.join(F.broadcast(known), "class").groupBy("class").agg(F.count("*").alias("n"))


@query("select 'default' as preset, 'CIM0017' as rule, count(*) as n from part where p_brand <> 'Brand#11' union all select 'thorough', 'CIM0017', count(*) from part where p_brand <> 'Brand#11' union all select p, 'CIM0004', count(*) from part, (values ('default'), ('thorough')) v(p) group by p")
def rule_presets(spark, sf):
    """What each preset of rules finds; the essential ones find nothing here."""
    m = star.model(spark, sf, ("part",))
    out = [K.validate(m, o).groupBy("rule").agg(F.count("*").alias("n")).select(F.lit(name).alias("preset"), "rule", "n") for name, o in (("default", K.Options()), ("essential", K.Options.essential()), ("thorough", K.Options.thorough()))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("select count(*) as objects, true as essential, (select count(*) from nation where n_regionkey = 0) = 0 as partial from region where r_regionkey <> 0")
def conforming(spark, sf):
    """Whether a model has no errors, with and without the objects that others need."""
    rows = {"region": t(spark, sf, "region").where("r_regionkey <> 0")}
    m = star.model(spark, sf, ("region", "nation"), rows=rows)
    whole = K.is_conforming(K.validate(m, K.Options.essential()))
    lost = m.with_(slots=m.slots.withColumn("v_ref", F.when(F.col("v_ref") == "region:0", F.col("mrid")).otherwise(F.col("v_ref"))))
    partial = K.is_conforming(K.validate(lost, K.Options.essential()))
    return rows["region"].agg(F.count("*").alias("objects")).withColumns({"essential": F.lit(whole), "partial": F.lit(partial)})


def _described(spark, sf) -> DataFrame:
    """RDFS descriptions whose classes are regions and, below them, nations: profile 0 has all, profile 1 the nations of some regions."""
    about = lambda name, inner: F.concat(F.lit('<rdf:Description rdf:about="#'), name, F.lit('">'), inner, F.lit("</rdf:Description>"))
    kind = lambda name: F.lit(f'<rdf:type rdf:resource="{name}"/>')
    cls, prop = kind("http://www.w3.org/2000/01/rdf-schema#Class"), kind("http://www.w3.org/1999/02/22-rdf-syntax-ns#Property")
    concrete = F.lit('<cims:stereotype rdf:resource="http://iec.ch/TC57/NonStandard/UML#concrete"/>')
    regions = t(spark, sf, "region").select(F.lit(0).alias("bit"), F.concat(F.lit("R"), "r_regionkey").alias("k"), about(F.concat(F.lit("R"), "r_regionkey"), cls).alias("e"))
    n = t(spark, sf, "nation")
    name = F.concat(F.lit("N"), "n_nationkey")
    own = F.concat(about(name, F.concat(cls, concrete, F.lit('<rdfs:subClassOf rdf:resource="#R'), F.col("n_regionkey").cast("string"), F.lit('"/>'))), about(F.concat(name, F.lit(".size")), F.concat(prop, F.lit('<rdfs:domain rdf:resource="#'), name, F.lit('"/><cims:dataType rdf:resource="#Integer"/><cims:multiplicity rdf:resource="http://x#M:1..1"/>'))))
    nations = n.select(F.explode(F.when(F.col("n_regionkey") < 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("bit"), name.alias("k"), own.alias("e"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "e"))), lambda x: x["e"]), "")
    docs = regions.unionByName(nations).groupBy("bit").agg(body.alias("body"))
    start = f'<rdf:RDF xmlns:rdf="{T.RDF}" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:cims="http://iec.ch/TC57/1999/rdf-schema-extensions-19990926#">'
    return docs.select("bit", F.concat(F.lit(start), "body", F.lit("</rdf:RDF>")).alias("content"))


@query("select 'R' || r_regionkey as class, null::varchar as parent, false as concrete, 1::bigint as profiles from region union all select 'N' || n_nationkey, 'R' || n_regionkey, true, case when n_regionkey < 2 then 3 else 1 end from nation")
def rdfs_classes_of_nations(spark, sf):
    """Classes of a vocabulary described in two profiles."""
    return rdfs.vocabulary(spark, _described(spark, sf), star.NS, []).classes.select("class", "parent", "concrete", "profiles")


@query("select 'N' || n_nationkey || '.size' as attr, 'N' || n_nationkey as owner, 'value' as kind, 'Integer' as primitive, 1 as least, 1 as most, case when n_regionkey < 2 then 3 else 1 end::bigint as used_in from nation")
def rdfs_attributes_of_nations(spark, sf):
    """Their attributes (M4, M5, M9)."""
    return rdfs.vocabulary(spark, _described(spark, sf), star.NS, []).attrs.select("attr", "owner", "kind", "primitive", "least", "most", "used_in")


@query("select 'nation:' || n_nationkey as mrid, 'text' as shape, n_name as text, null::varchar as literal, 'U+' || upper(lpad(to_hex(ascii(n_name)), 4, '0')) as first from nation union all select 'customer:' || c_custkey, 'enum', null, c_mktsegment, 'U+' || upper(lpad(to_hex(ascii(c_mktsegment)), 4, '0')) from customer")
def text_coercions(spark, sf):
    """Values read as texts and as enumeration values (C4), and how a character is named."""
    rows = star.model(spark, sf, ("nation", "customer"), ["Thing.name", "Customer.mktsegment"]).slots.where("mrid like 'nation:%' or attr = 'Customer.mktsegment'")
    return rows.select("mrid", F.col("kind").alias("shape"), V.as_string(F.col("kind"), F.col("v_text")).alias("text"), V.as_enum(F.col("kind"), F.col("v_text")).alias("literal"), X.describe_char(F.col("v_text")).alias("first"))


@query("select 'part:' || p_partkey as mrid, case p_partkey % 3 when 0 then p_size || '.0' when 1 then p_size::varchar else p_size::varchar end as text, true as fits from part")
def lexical_rendering(spark, sf):
    """A number keeps its spelling where that is one of its type, and is canonical else."""
    k = F.col("p_partkey") % 3
    spelled = F.when(k == 0, F.concat("p_size", F.lit(".0"))).when(k == 1, F.concat("p_size", F.lit(",0")))
    rows = t(spark, sf, "part").select(F.expr("concat('part:', p_partkey)").alias("mrid"), spelled.alias("lex"), F.col("p_size").cast("double").alias("v"))
    return rows.select("mrid", V.to_lexical(F.col("lex"), F.col("v"), F.lit("Float")).alias("text"), V.fits(F.lit("Float"), F.lit("dbl")).alias("fits"))


@query("select 'Order.status' as attr, count(*) as n, false as many from orders union all select 'Order.totalprice', count(*), false from orders union all select 'Order.Customer', count(*), false from orders union all select 'Order.priority', count(*), false from orders")
def many_valued(spark, sf):
    """Values of each attribute, and whether it takes many."""
    m = star.model(spark, sf, ("orders",))
    told = m.vocabulary.attrs.select("attr", V.is_many(F.col("most"), F.lit(False)).alias("many"))
    return m.slots.groupBy("attr").agg(F.count("*").alias("n")).join(F.broadcast(told), "attr")


@query("select 'Status.' || o_orderstatus as literal, count(*) as n from orders group by 1")
def literal_lookups(spark, sf):
    """Values of an enumeration that the vocabulary has."""
    m = star.model(spark, sf, ("orders",), ["Order.status"])
    named = m.slots.select(F.lit("Status").alias("enum"), F.col("v_text").alias("literal"))
    return m.vocabulary.find_literals(named).groupBy(F.concat_ws(".", "enum", "literal").alias("literal")).agg(F.count("*").alias("n"))


@query("select s as word, case s when 'REF' then 0 when 'OPS' then 1 end as bit, (select count(*) from customer) as n from (values ('REF'), ('OPS')) v(s)")
def profile_keywords(spark, sf):
    """The profiles that a table's provenance names, by keyword in any case."""
    m = star.model(spark, sf, ("customer",))
    out = [m.objects.where(F.col("profiles").bitwiseAND(F.lit(1 << bit)) != 0).agg(F.count("*").alias("n")).crossJoin(F.broadcast(m.vocabulary.by_keyword(word).select(F.col("profile").alias("word"), "bit"))) for bit, word in ((0, "ref"), (1, "Ops"))]  # one row each
    return out[0].unionByName(out[1])


@query("select 'star_REF.xml' as file, 'Reference' as name, '2' as version union all select 'star_OPS.xml', 'Operation', '1'")
def header_changes(spark, sf):
    """Headers of files with one replaced, and each file's first profile."""
    heads = cimxml.peek_headers(spark, _files(spark, sf))
    new = E.set_headers(heads, heads.where("file like '%_REF.xml'").withColumn("version", F.lit("2")))
    name = F.substring_index("file", "/", -1)
    return new.select(name.alias("file"), "version").join(cimxml.primary_profile(new).select(name.alias("file"), "name"), "file")


@query("select count(*) as n, count(*) || ' dangling references, among them region:0' as told from nation where n_regionkey = 0")
def strict_links(spark, sf):
    """What a strict check of links says of references to a region that isn't loaded."""
    m = star.model(spark, sf, ("region", "nation"), ["Nation.Region"], {"region": t(spark, sf, "region").where("r_regionkey <> 0")})
    try:
        m.check_links()
        told = None
    except ValueError as e:
        told = str(e)
    return m.dangling().agg(F.count("*").alias("n")).withColumn("told", F.lit(told))


@query("select count(*) as nations, 'urn:uuid:' || substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h,17,1)) - 1) % 4 + 1, 1) || substr(h,18,3) || '-' || substr(h,21,12) as id from nation, (select sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('urn:uuid:a' || chr(10) || 'urn:uuid:b')) as h) group by h")
def difference_header(spark, sf):
    """A difference's header: a name-based identifier over what it supersedes, each once (H6)."""
    head = D.derived_header(["urn:uuid:a", "urn:uuid:b", "urn:uuid:a"], "content", namespace="6ba7b811-9dad-11d1-80b4-00c04fd430c8")
    return t(spark, sf, "nation").agg(F.count("*").alias("nations")).withColumn("id", F.lit(head["id"]))
