"""Queries over documents: tables of the star written as CIM/XML, RDF or difference documents in the shared folder, and read back (2.A, 2.B, 2.M)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import numbered
from ..functions.shared import cut, new_folder
from ..operators import difference as D
from ..operators.model import Model
from ..operators.vocabulary import Vocabulary
from ..sources import cimxml, rdfs
from ..sources import xmltokens as T
from . import star
from .registry import _edited, query, t

PREFIXES = {"s": star.NS}


def shown(slots: DataFrame) -> DataFrame:
    return slots.select("mrid", "attr", "kind", D.value_text().alias("value"), "profiles")


def saved(spark: SparkSession, sf: str) -> tuple[Model, str]:
    """The model of three tables, and the folder of its profiles' documents."""
    m = star.model(spark, sf, ("region", "nation", "customer"))
    folder = new_folder(spark, "documents")
    cimxml.save_profiles(m, folder, "star", PREFIXES, "s")
    return m, folder


_NAMES = "select 'region:' || r_regionkey as mrid, 'Thing.name' as attr, 'text' as kind, r_name as value, 1::bigint as profiles from region union all select 'nation:' || n_nationkey, 'Thing.name', 'text', n_name, 1 from nation union all select 'nation:' || n_nationkey, 'Nation.Region', 'ref', 'region:' || n_regionkey, 1 from nation union all select 'customer:' || c_custkey, 'Thing.name', 'text', c_name, 1 from customer union all select 'customer:' || c_custkey, 'Party.Nation', 'ref', 'nation:' || c_nationkey, 1 from customer union all select 'customer:' || c_custkey, 'Customer.mktsegment', 'enum', c_mktsegment, 1 from customer"


@query(f"{_NAMES} union all select 'customer:' || c_custkey, 'Party.acctbal', 'dbl', round(c_acctbal * 100)::bigint::varchar, 2 from customer")
def cim_roundtrip_values(spark, sf):
    """Profiles saved as documents of their own and read back as one model: values and their provenance (A1, A5-A7, A17, B2-B4, B8). Balances are shown in hundredths."""
    _, folder = saved(spark, sf)
    back = cimxml.read(cimxml.parts(spark, folder), star.vocabulary(spark))[0]
    return shown(back.slots).withColumn("value", F.when(F.col("kind") == "dbl", F.round(F.col("value").cast("double") * 100).cast("long").cast("string")).otherwise(F.col("value")))


@query("select 'region:' || r_regionkey as mrid, 'Region' as class, 1::bigint as profiles from region union all select 'nation:' || n_nationkey, 'Nation', 1 from nation union all select 'customer:' || c_custkey, 'Customer', 3 from customer")
def cim_roundtrip_objects(spark, sf):
    """Objects that two documents name, one of them by a base class."""
    _, folder = saved(spark, sf)
    return cimxml.read(cimxml.parts(spark, folder), star.vocabulary(spark))[0].objects


@query("select 'star_REF' as name, 'full' as kind, '1' as version, 'http://example.org/profiles/Reference/3.0' as profile, 0::bigint as findings union all select 'star_OPS', 'full', '1', 'http://example.org/profiles/Operation/3.0', 0")
def cim_headers(spark, sf):
    """Derived headers, as they are read back."""
    _, folder = saved(spark, sf)
    docs = cimxml.parts(spark, folder)
    _, heads, findings = cimxml.read(docs, star.vocabulary(spark))
    return heads.select(F.substring_index("file", "/", -1).alias("name"), "kind", "version", F.element_at("profiles", 1).alias("profile")).crossJoin(F.broadcast(findings.agg(F.count("*").alias("findings"))))  # one row


@query("select 'region:' || r_regionkey as mrid, '  <s:Region rdf:about=\"region:' || r_regionkey || '\">' || chr(10) || '    <s:Thing.name>' || r_name || '</s:Thing.name>' || chr(10) || '  </s:Region>' as element from region")
def cim_element_text(spark, sf):
    """The text of elements."""
    return cimxml.whole(star.model(spark, sf, ("region",)), "s")


@query("select (select count(*) from region) + (select count(*) from nation) + (select count(*) from customer) + (select count(*) from part) as objects, 0::bigint as statements, 0::bigint as findings, true as same_content")
def cim_whole_model(spark, sf):
    """A whole model written and read back leaves no difference, and the same content identifier."""
    m = star.model(spark, sf, ("region", "nation", "customer", "part"))
    folder = new_folder(spark, "documents")
    cimxml.write_model(m, f"{folder}/whole", cimxml.header_text(cimxml.derived_header(m, [])), {"md": cimxml.MD, **PREFIXES}, "s")
    back, _, findings = cimxml.read(cimxml.parts(spark, folder), m.vocabulary)
    same = cimxml.content_id(m) == cimxml.content_id(back.with_(objects=back.objects.repartition(3)))
    rows = back.objects.agg(F.count("*").alias("objects")).crossJoin(D.statements(m, back).agg(F.count("*").alias("statements"))).crossJoin(findings.agg(F.count("*").alias("findings")))  # one row each
    return rows.withColumn("same_content", F.lit(same))


@query("select 'star_REF' as name, (select count(*) from region) + (select count(*) from nation) + (select count(*) from customer) as elements, 0::bigint as unwritten union all select 'star_OPS', (select count(*) from customer), 0")
def cim_save_as_loaded(spark, sf):
    """Each file's objects with the values of its profiles, as they were loaded."""
    _, folder = saved(spark, sf)
    docs = cimxml.parts(spark, folder)
    m, heads, _ = cimxml.read(docs, star.vocabulary(spark))
    elements, unwritten = cimxml.as_loaded(m, docs, heads, "s")
    return elements.groupBy(F.substring_index("file", "/", -1).alias("name")).agg(F.count("*").alias("elements")).crossJoin(F.broadcast(unwritten.agg(F.count("*").alias("unwritten"))))  # one row


def odd_document(spark: SparkSession, sf: str) -> DataFrame:
    """One document of nations in odd markup: comments, CDATA, single quotes, further attributes, unknown names, bad values."""
    k = F.col("n_nationkey")
    text = lambda s: F.lit(s)
    element = F.concat(
        text("<s:Nation s:note='a > b' rdf:ID = \"_n"), k, text('"><!-- c > <d> --><s:Thing.name><![CDATA[<'), "n_name", text(">]]> &amp; c&#111;</s:Thing.name>"), F.when(k % 5 == 0, "<s:Nation.colour>red</s:Nation.colour>").otherwise(""),
        F.concat(text("<s:Nation.Region rdf:resource='#_r"), "n_regionkey", text("'/></s:Nation>")), F.when(k % 3 == 0, F.concat(text('<s:Planet rdf:about="#_p'), k, text('"/>'))).otherwise(""),
        F.when(k % 4 == 0, F.concat(text('<o:Region rdf:ID="_o'), k, text('"/>'))).otherwise(""), F.when(k % 6 == 0, F.concat(text('<s:Part rdf:ID="_q'), k, text('"><s:Part.size>big</s:Part.size></s:Part>'))).otherwise(""),
    )
    body = t(spark, sf, "nation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), element.alias("e")))), lambda x: x["e"]), "\n").alias("body"))
    start = f'<?xml version="1.0"?><wrap xmlns:s="{star.NS}"><rdf:RDF xmlns:rdf="{T.RDF}" xmlns:o="http://example.org/other#">'
    return body.select(F.lit("odd.xml").alias("file"), F.concat(text(start), "body", text("</rdf:RDF></wrap>")).alias("content"))


@query("select 'n' || n_nationkey as mrid, '<' || n_name || '> & co' as name, 'r' || n_regionkey as region from nation")
def cim_odd_values(spark, sf):
    """Values of odd but well-formed markup."""
    m = cimxml.read(cimxml.in_content(odd_document(spark, sf)), star.vocabulary(spark))[0]
    return m.view("Nation", {"name": ("Thing.name", "v_text"), "region": ("Nation.Region", "v_ref")}).drop("class")


@query("""select 'CIM0001' as rule, (select count(*) from nation where n_nationkey % 3 = 0) + (select count(*) from nation where n_nationkey % 4 = 0) as n
 union all select 'CIM0002', count(*) from nation where n_nationkey % 5 = 0 union all select 'CIM0003', count(*) from nation where n_nationkey % 6 = 0""")
def cim_odd_findings(spark, sf):
    """What reading reports of it: unknown classes, attributes, and values."""
    return cimxml.read(cimxml.in_content(odd_document(spark, sf)), star.vocabulary(spark))[2].groupBy("rule").agg(F.count("*").alias("n"))


@query("select 'odd.xml' as file, 'star' as vintage, 1::bigint as wrong")
def cim_vintage(spark, sf):
    """The vintage that a document's namespaces tell, and the finding if another was wanted."""
    docs = cimxml.in_content(odd_document(spark, sf))
    known = spark.createDataFrame([("star", star.NS, 9), ("other", "http://example.org/other#", 3)], "vintage string, ns string, classes int")
    return cimxml.vintages(docs, known).select("file", "vintage").crossJoin(cimxml.wrong_vintage(docs, known, "other").agg(F.count("*").alias("wrong")))  # one row each


def with_addresses(spark: SparkSession) -> Vocabulary:
    v = star.vocabulary(spark)
    classes = v.classes.unionByName(spark.createDataFrame([("Address", star.NS, None, False, 1, 1, 0, False)], v.classes.schema))
    rows = [("Customer.address", star.NS, "Customer", "compound", None, "Address", 0, 1, 1, False, ""), ("Address.zone", star.NS, "Address", "value", "Integer", None, 0, 1, 1, False, ""), ("Address.street", star.NS, "Address", "value", "String", None, 0, 1, 1, False, "")]
    return Vocabulary(classes, v.attrs.unionByName(spark.createDataFrame(rows, v.attrs.schema)), v.literals, v.profiles, v.inverses)


@query("select 'customer:' || c_custkey as mrid, 'Customer.address/Address.zone' as attr, 'int' as kind, c_nationkey::varchar as value from customer union all select 'customer:' || c_custkey, 'Customer.address/Address.street', 'text', c_mktsegment || ' road' from customer union all select 'customer:' || c_custkey, 'Thing.name', 'text', c_name from customer")
def cim_compounds(spark, sf):
    """Values inside a compound, written nested and read back."""
    v, rows = with_addresses(spark), t(spark, sf, "customer")
    m = star.model(spark, sf, ("customer",), ["Thing.name"])
    field = lambda attr, kind, **cols: rows.select(F.expr("concat('customer:', c_custkey)").alias("mrid"), F.lit(f"Customer.address/{attr}").alias("attr"), F.lit(0).alias("ord"), F.lit(kind).alias("kind"), *(cols.get(c, F.lit(None)).cast(ty).alias(c) for c, ty in (("v_bool", "boolean"), ("v_int", "long"), ("v_dbl", "double"), ("v_text", "string"), ("v_ref", "string"), ("lex", "string"))), F.lit(1).cast("long").alias("profiles"))
    slots = m.slots.unionByName(field("Address.zone", "int", v_int=F.col("c_nationkey"))).unionByName(field("Address.street", "text", v_text=F.concat("c_mktsegment", F.lit(" road"))))
    folder = new_folder(spark, "documents")
    cimxml.write_model(m.with_(vocabulary=v, slots=slots), f"{folder}/nested", "", PREFIXES, "s")
    return shown(cimxml.read(cimxml.parts(spark, folder), v)[0].slots).drop("profiles")


@query("""with e as (select 'reverse' as direction, 'orders:' || o_orderkey as mrid from orders where o_orderkey % 97 = 0 union all select 'forward', 'orders:' || (o_orderkey + 10000000) from orders where o_orderkey % 101 = 0)
 select direction, mrid, count(*) as n from e, (values (1), (2), (3), (4)) group by all""")
def cim_difference_document(spark, sf):
    """A difference written as a document and read back: what is retracted of dropped orders, and asserted of new ones."""
    base, target = _edited(spark, sf)
    found = cut(numbered(D.statements(base, target), "seq", F.col("direction").desc(), "mrid", "attr", "value"))
    folder = new_folder(spark, "documents")
    D.write(found, base, f"{folder}/difference", {"id": "urn:uuid:00000000-0000-5000-8000-000000000001"}, PREFIXES, "s")
    read = cimxml.read_statements(cimxml.parts(spark, folder), base.vocabulary)
    named = read.where("class is not null")
    return named.groupBy("direction", "mrid").agg(F.count("*").alias("n"))


@query("select 0::bigint as statements, count(*) as objects from (select o_orderkey from orders where o_orderkey % 97 <> 0 union all select o_orderkey + 10000000 from orders where o_orderkey % 101 = 0)")
def cim_difference_applied(spark, sf):
    """Applying a difference as it was read from its document gives the target state (H7-H9)."""
    base, target = _edited(spark, sf)
    found = cut(numbered(D.statements(base, target), "seq", F.col("direction").desc(), "mrid", "attr", "value"))
    folder = new_folder(spark, "documents")
    D.write(found, base, f"{folder}/difference", {"id": "urn:uuid:00000000-0000-5000-8000-000000000001"}, PREFIXES, "s")
    done = D.apply(base, cut(cimxml.read_statements(cimxml.parts(spark, folder), base.vocabulary)))
    done = done.with_(objects=cut(done.objects))
    return D.statements(done, target).agg(F.count("*").alias("statements")).crossJoin(done.objects.agg(F.count("*").alias("objects")))  # one row each


def star_rdfs() -> list[tuple[int, str]]:
    """(profile bit, description) of the star's vocabulary, each profile with the classes and attributes it describes."""
    ref = lambda name: f'rdf:resource="#{name}"'
    out = []
    for bit in range(4):
        items = []
        for name, _, parent, concrete, profiles, *_ in star.CLASSES:
            if profiles >> bit & 1:
                inner = '<rdf:type rdf:resource="http://www.w3.org/2000/01/rdf-schema#Class"/>' + (f"<rdfs:subClassOf {ref(parent)}/>" if parent else "") + ('<cims:stereotype rdf:resource="http://iec.ch/TC57/NonStandard/UML#concrete"/>' if concrete else "")
                items.append(f'<rdf:Description rdf:about="#{name}">{inner}</rdf:Description>')
        for name, _, owner, kind, primitive, target, least, most, used_in, *_ in star.ATTRS:
            if used_in >> bit & 1 and kind != "enum":
                what = f"<rdfs:range {ref(target)}/><cims:AssociationUsed>Yes</cims:AssociationUsed>" if kind == "ref" else f"<cims:dataType {ref(primitive)}/>"
                items.append(f'<rdf:Description rdf:about="#{name}"><rdf:type rdf:resource="http://www.w3.org/1999/02/22-rdf-syntax-ns#Property"/><rdfs:domain {ref(owner)}/>{what}<cims:multiplicity rdf:resource="http://x#M:{least}..{most}"/></rdf:Description>')
        out.append((bit, f'<rdf:RDF xmlns:rdf="{T.RDF}" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:cims="http://iec.ch/TC57/1999/rdf-schema-extensions-19990926#">{"".join(items)}</rdf:RDF>'))
    return out


def _quoted(x) -> str:
    return "null" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower()


@query("select class, parent, concrete, profiles::bigint as profiles from (values " + ", ".join(f"({_quoted(c)}, {_quoted(p)}, {_quoted(k)}, {m})" for c, _, p, k, m, *_ in star.CLASSES) + ") v(class, parent, concrete, profiles)")
def rdfs_classes(spark, sf):
    """Classes of a vocabulary from one description a profile."""
    return rdfs.vocabulary(spark, spark.createDataFrame(star_rdfs(), "bit int, content string"), star.NS, []).classes.select("class", "parent", "concrete", "profiles")


@query("select attr, owner, kind, primitive, target, least, most, used_in::bigint as used_in from (values " + ", ".join(f"({_quoted(a)}, {_quoted(o)}, {_quoted(k)}, {_quoted(p)}, {_quoted(g)}, {lo}, {hi}, {u})" for a, _, o, k, p, g, lo, hi, u, *_ in star.ATTRS if k != "enum") + ") v(attr, owner, kind, primitive, target, least, most, used_in)")
def rdfs_attributes(spark, sf):
    """Their attributes (M4, M5, M9)."""
    return rdfs.vocabulary(spark, spark.createDataFrame(star_rdfs(), "bit int, content string"), star.NS, []).attrs.select("attr", "owner", "kind", "primitive", "target", "least", "most", "used_in")
