"""Queries over changes, lookups and renderings of models (2.C, 2.D, 2.G, 2.H, 2.J-2.L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mrid as M
from ..functions import values as V
from ..operators import difference as D
from ..operators import edits as E
from ..operators import rdf
from ..operators import validate as K
from ..sources import cimxml
from . import star
from .documents import with_addresses
from .registry import _edited, query, t

_ORDER = "'orders:' || o_orderkey"


def _statuses(m):
    return m.slots.where("attr = 'Order.status'").select("mrid", "ord", F.col("v_text").alias("value"))


def _some(spark, sf, divisor: int):
    return t(spark, sf, "orders").where(f"o_orderkey % {divisor} = 0").select(F.expr("concat('orders:', o_orderkey)").alias("mrid"), F.lit("Order.status").alias("attr"), F.lit("enum").alias("kind"), F.lit("X").alias("v_text"))


@query(f"select {_ORDER} as mrid, 0 as ord, case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end as value from orders")
def put_values(spark, sf):
    """Set: given values replace those of an attribute."""
    return _statuses(E.put(star.model(spark, sf, ("orders",), ["Order.status"]), _some(spark, sf, 5)))


@query(f"select {_ORDER} as mrid, 0 as ord, o_orderstatus as value from orders union all select {_ORDER}, 1, 'X' from orders where o_orderkey % 5 = 0")
def push_values(spark, sf):
    """Push: given values come after those there."""
    return _statuses(E.push(star.model(spark, sf, ("orders",), ["Order.status"]), _some(spark, sf, 5)))


@query(f"select {_ORDER} as mrid, 0 as ord, o_orderstatus as value from orders where o_orderkey % 5 <> 0")
def remove_attribute(spark, sf):
    """Remove an attribute of some objects."""
    return _statuses(E.remove(star.model(spark, sf, ("orders",), ["Order.status"]), _some(spark, sf, 5)))


@query(f"select {_ORDER} as mrid, 0 as ord, case when o_orderstatus = 'F' then 'X' else o_orderstatus end as value from orders where o_orderstatus <> 'F' or o_orderkey % 5 = 0")
def remove_equal_values(spark, sf):
    """Remove by value: what is left moves up."""
    m = E.push(star.model(spark, sf, ("orders",), ["Order.status"]), _some(spark, sf, 5).join(t(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.expr("concat('orders:', o_orderkey)").alias("mrid")), "mrid", "left_semi"))
    gone = m.objects.select("mrid", F.lit("Order.status").alias("attr"), F.lit("enum").alias("kind"), F.lit("F").alias("v_text"))
    return _statuses(E.remove_values(m, gone))


@query("select 'part:' || p_partkey as mrid, trunc(p_retailprice)::bigint as whole, p_size::double as size, 'an integer' as shape from part")
def coercions(spark, sf):
    """Numbers read as another kind of number, and what a value is in words."""
    rows = star.model(spark, sf, ("part",), ["Part.size", "Part.retailprice"]).slots
    per = rows.groupBy("mrid").agg(F.max(F.when(F.col("attr") == "Part.retailprice", V.as_integer(F.col("v_int"), F.col("v_dbl")))).alias("whole"), F.max(F.when(F.col("attr") == "Part.size", V.as_double(F.col("v_int"), F.col("v_dbl")))).alias("size"), F.max(F.when(F.col("attr") == "Part.size", V.shape(F.col("kind")))).alias("shape"))
    return per


def _addressed(spark, sf):
    rows = t(spark, sf, "customer")
    base = star.model(spark, sf, ("customer",), ["Party.Nation"])
    fields = rows.select(F.expr("concat('customer:', c_custkey)").alias("mrid"), F.inline(F.array(F.struct(F.lit("Customer.address/Address.zone").alias("attr"), F.col("c_nationkey").cast("long").alias("v_int"), F.lit(None).cast("string").alias("v_text")), F.struct(F.lit("Customer.address/Address.street").alias("attr"), F.lit(None).cast("long").alias("v_int"), F.col("c_mktsegment").alias("v_text")))))
    return E.push(base.with_(vocabulary=with_addresses(spark)), fields)


@query("select 'customer:' || c_custkey as mrid, c_nationkey::bigint as zone from customer")
def compound_field(spark, sf):
    """One field of a compound."""
    return _addressed(spark, sf).field("Customer.address", "Address.zone").select("mrid", F.col("v_int").alias("zone"))


@query("select 'customer:' || c_custkey as mrid, 'Customer.address' as attr, '{Address.street=' || c_mktsegment || ', Address.zone=' || c_nationkey || '}' as text from customer union all select 'customer:' || c_custkey, 'Party.Nation', 'nation:' || c_nationkey from customer")
def display_values(spark, sf):
    """Values for people."""
    return _addressed(spark, sf).display().select("mrid", "attr", "text")


@query("select 'customer:' || c_custkey as mrid, 'CIM0002' as rule, 'Customer.address/Address.street' as attr from customer where c_custkey % 9 = 0 union all select 'customer:' || c_custkey, 'CIM0002', 'Party.Nation/Address.zone' from customer where c_custkey % 11 = 0")
def compound_membership(spark, sf):
    """Fields that no compound of the property has, and properties that the class lacks (K2)."""
    m = _addressed(spark, sf)
    key = F.expr("cast(substring_index(mrid, ':', -1) AS bigint)")
    strange = m.slots.where("attr = 'Customer.address/Address.zone'").where(key % 11 == 0).withColumn("attr", F.lit("Party.Nation/Address.zone"))
    objects = m.objects.withColumn("class", F.when(key % 9 == 0, "Supplier").otherwise(F.col("class")))
    only = m.slots.where("attr = 'Customer.address/Address.street'")
    return K.class_membership(m.with_(objects=objects, slots=only.unionByName(strange))).select("mrid", "rule", "attr")


@query("select 'customer:' || c_custkey as mrid, 'Customer' as class from customer where c_custkey in (1, 7, 20) union all select 'nation:4', 'Nation'")
def point_lookup(spark, sf):
    """Objects by identifier."""
    return star.model(spark, sf, ("nation", "customer")).find(["customer:1", " customer:7", "#_customer:20", "nation:4", "nation:999"]).select("mrid", "class")


@query("select 1 as file_seq, 'customer:' || c_custkey as mrid from customer where c_custkey % 2 = 0 and c_custkey % 10 <> 0")
def objects_of_file(spark, sf):
    """The objects that a file names and that are still there."""
    m = star.model(spark, sf, ("customer",))
    key = F.expr("cast(substring_index(mrid, ':', -1) AS bigint)")
    named = E.add_members(m, m.objects.select((1 - key % 2).cast("int").alias("file_seq"), "mrid"))
    return named.remove(m.objects.where(key % 10 == 0).select("mrid")).of_file(1).select(F.lit(1).alias("file_seq"), "mrid")


@query("select 'warning' as severity, 'structure' as rule, count(*) as n, count(*) || ' objects lose all their values' as message from orders where o_orderkey % 97 = 0 having count(*) > 2")
def deletion_warning(spark, sf):
    """A difference that empties more objects than allowed (H5)."""
    return D.deletion_warning(D.statements(*_edited(spark, sf)), 2)


@query("select 'customer:' || c_custkey as mrid, 'Customer.address' as attr from customer")
def inexpressible_values(spark, sf):
    """What statements can't express (H4)."""
    return D.inexpressible(_addressed(spark, sf))


@query("select c_custkey, case c_custkey % 3 when 0 then 'UUID without hyphens: ' || md5(c_name) when 1 then 'not a UUID: ' || c_name end as complaint from customer")
def identifier_complaints(spark, sf):
    """Why identifiers aren't conforming, in words."""
    md5 = F.md5("c_name")
    uuid = F.regexp_replace(md5, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", r"$1-$2-$3-$4-$5")
    spelled = F.when(F.col("c_custkey") % 3 == 0, md5).when(F.col("c_custkey") % 3 == 1, F.col("c_name")).otherwise(uuid)
    return t(spark, sf, "customer").select("c_custkey", M.complaint(M.parse(spelled)).alias("complaint"))


@query("select 'warning[CIM0006] nation:' || n_nationkey || ' Nation.Region: region:' || n_regionkey as line from nation where n_regionkey = 0")
def rendered_findings(spark, sf):
    """Findings as lines."""
    m = star.model(spark, sf, ("region", "nation"), ["Nation.Region"], {"region": t(spark, sf, "region").where("r_regionkey <> 0")})
    return K.rendered(K.by_rule(K.validate(m, K.Options(rules=(K.dangling, K.abstract_class))), "dangling-reference"))


@query("select 'customer:' || c_custkey as mrid, 'CIM0018' as rule, round(c_acctbal + 1, 2) as kept from customer where c_custkey % 4 = 0")
def conflicting_values(spark, sf):
    """Values that a later file replaced, as findings."""
    m = star.model(spark, sf, ("customer",), ["Party.acctbal"])
    first = m.slots.withColumns({"file_seq": F.lit(0), "elem_seq": F.lit(0)})
    key = F.expr("cast(substring_index(mrid, ':', -1) AS bigint)")
    later = first.where(key % 4 == 0).withColumns({"file_seq": F.lit(1), "v_dbl": F.col("v_dbl") + 1})
    return K.conflicting(first.unionByName(later), m.vocabulary).select("mrid", "rule", F.round(F.substring_index("message", " replaces ", 1).cast("double"), 2).alias("kept"))


@query("""with h as (select c_mktsegment as seg, min(c_name) as v from customer group by 1)
 select '<urn:seg:' || seg || '>' as subject, p as predicate, o as object from h, lateral (select unnest(['<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<http://iec.ch/TC57/61970-552/ModelDescription/1#Model.version>', '<http://iec.ch/TC57/61970-552/ModelDescription/1#Model.profile>']) as p,
 unnest(['<http://iec.ch/TC57/61970-552/ModelDescription/1#FullModel>', '"' || v || '"', '<http://example.org/ref>']) as o)""")
def header_triples(spark, sf):
    """File headers as triples."""
    heads = t(spark, sf, "customer").groupBy("c_mktsegment").agg(F.min("c_name").alias("version")).select(F.concat(F.lit("urn:seg:"), "c_mktsegment").alias("id"), "version", F.array(F.lit("http://example.org/ref")).alias("profiles"))
    return rdf.header_triples(heads)


@query("select kind, count(*) as n from (select unnest(['class', 'type', 'held', 'zone', 'street', 'nation']) as kind from customer) group by 1")
def compound_triples(spark, sf):
    """Compounds as blank nodes: the object's type and reference, the node's type, what holds it and its fields (L2)."""
    found = rdf.triples(_addressed(spark, sf), star.REF, star.NS)
    is_type, blank = F.col("predicate") == f"<{rdf.RDF_TYPE}>", F.col("subject").startswith("_:c")
    kind = F.when(is_type & blank, "type").when(is_type, "class").when(F.col("predicate").endswith("Customer.address>"), "held").when(F.col("predicate").endswith("zone>"), "zone").when(F.col("predicate").endswith("street>"), "street").otherwise("nation")
    return found.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("select 'REF' as profile, 0 as bit union all select 'OPS', 1")
def present_profiles(spark, sf):
    """Profiles that some header declares, by address, alias or stem."""
    heads = t(spark, sf, "nation").select(F.col("n_name").alias("file"), F.array(F.when(F.col("n_nationkey") % 2 == 0, "http://example.org/ref").otherwise("http://example.org/profiles/Operation/9.9")).alias("profiles"))
    return cimxml.present_profiles(heads, star.vocabulary(spark))


@query("select p_partkey, case when n = 1 then plain else regexp_replace(plain, '\\.xml$', '') || '_' || n || '.xml' end as output from (select *, row_number() over (partition by plain order by p_partkey) as n from (select p_partkey, 'p' || (p_size % 7) || '.xml' as plain from part))")
def safe_names(spark, sf):
    """Names of files that stay in their folder and differ."""
    wanted = t(spark, sf, "part").select(F.col("p_partkey").alias("file"), F.concat(F.when(F.col("p_partkey") % 2 == 0, "../../").otherwise("a\\b\\"), F.lit("p"), F.col("p_size") % 7, F.lit(".xml")).alias("name"))
    return cimxml.safe_names(wanted).select(F.col("file").alias("p_partkey"), "output")


@query("select 'Nation' as name, 'http://example.org/star#' as class_ns union all select 'Order', 'http://example.org/star#'")
def name_lookups(spark, sf):
    """Classes by name, in one namespace or any."""
    names = spark.createDataFrame([("Nation", None), ("Order", star.NS), ("Order", "http://example.org/none#"), ("Nowhere", None)], "name string, ns string")
    return star.vocabulary(spark).find_classes(names).select("name", "class_ns")
