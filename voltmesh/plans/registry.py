"""Registered queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import mrid as M
from ..functions import profiles as P
from ..functions import rdfterms as R
from ..functions import values as V
from ..functions import xmltext as X
from ..functions.ordered import numbered
from ..functions.shared import cut
from ..operators import difference as D
from ..operators import model as O
from ..operators import rdf
from ..operators import validate as K
from . import star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return add


t = star.table


# -- navigation ------------------------------------------------------------------------------------------------------------------------


@query("""select r_name as region, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as lines from lineitem join orders on l_orderkey = o_orderkey
 join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1""")
def region_revenue(spark, sf):
    """Five references followed in a row, then a sum."""
    m = star.model(spark, sf, ("region", "nation", "customer", "orders"), ["Thing.name", "Nation.Region", "Party.Nation", "Order.Customer"])
    step = lambda attr, a, b: m.values(attr).select(F.col("mrid").alias(a), F.col("v_ref").alias(b))
    # lines have no key of their own, so as objects they would fall together: their order and amount are taken from one row, and summed by order before any join
    lines = t(spark, sf, "lineitem").select(F.expr("concat('orders:', l_orderkey)").alias("order"), F.expr("l_extendedprice * (1 - l_discount)").alias("amount"))
    per_order = lines.groupBy("order").agg(F.sum("amount").alias("amount"), F.count("*").alias("lines"))
    joined = per_order.join(step("Order.Customer", "order", "customer"), "order").join(step("Party.Nation", "customer", "nation"), "customer")
    per_nation = joined.groupBy("nation").agg(F.sum("amount").alias("amount"), F.sum("lines").alias("lines"))
    named = m.values("Thing.name").select(F.col("mrid").alias("region_id"), F.col("v_text").alias("region"))
    return per_nation.join(step("Nation.Region", "nation", "region_id"), "nation").join(named, "region_id").groupBy("region").agg(F.round(F.sum("amount"), 2).alias("revenue"), F.sum("lines").alias("lines"))


@query("""select 'nation:' || n_nationkey as mrid, 'Thing.name' as attr, 'text' as kind, n_name as value from nation union all select 'nation:' || n_nationkey, 'Nation.Region', 'ref', 'region:' || n_regionkey from nation
 union all select 'region:' || r_regionkey, 'Thing.name', 'text', r_name from region""")
def slots_unpivot(spark, sf):
    return star.model(spark, sf, ("region", "nation")).slots.select("mrid", "attr", "kind", F.coalesce("v_text", "v_ref").alias("value"))


@query("""select 'Region' as class, count(*) as n from region union all select 'Nation', count(*) from nation union all select 'Customer', count(*) from customer union all select 'Supplier', count(*) from supplier
 union all select 'Part', count(*) from part union all select 'Order', count(*) from orders""")
def objects_by_class(spark, sf):
    return star.model(spark, sf).objects.groupBy("class").agg(F.count("*").alias("n"))


_COUNTS = "select (select count(*) from region) r, (select count(*) from nation) n, (select count(*) from customer) c, (select count(*) from supplier) s, (select count(*) from part) p, (select count(*) from orders) o"


@query(f"""with k as ({_COUNTS}) select unnest(['Region','Nation','Place','Customer','Supplier','Party','Part','Order','Thing']) as ancestor, unnest([r, n, r+n, c, s, c+s, p, o, r+n+c+s+p+o])::bigint as n from k""")
def class_rollup(spark, sf):
    return star.model(spark, sf).class_counts()


@query("""select 'customer:' || c_custkey as mrid, c_name as name, 'nation:' || c_nationkey as nation, c_acctbal as acctbal, c_mktsegment as segment from customer""")
def view_customer(spark, sf):
    m = star.model(spark, sf, ("customer",))
    return m.view("Customer", {"name": ("Thing.name", "v_text"), "nation": ("Party.Nation", "v_ref"), "acctbal": ("Party.acctbal", "v_dbl"), "segment": ("Customer.mktsegment", "v_text")}).drop("class")


@query("""select 'customer:' || c_custkey as mrid, 'Customer' as class, c_name as name, c_acctbal as acctbal from customer union all select 'supplier:' || s_suppkey, 'Supplier', s_name, s_acctbal from supplier""")
def view_party(spark, sf):
    m = star.model(spark, sf, ("nation", "customer", "supplier"))
    return m.view("Party", {"name": ("Thing.name", "v_text"), "acctbal": ("Party.acctbal", "v_dbl")})


@query("""select 'customer:' || c_custkey as mrid, 'nation:' || n_nationkey as target, 'Nation' as target_class from customer join nation on c_nationkey = n_nationkey""")
def follow_nation(spark, sf):
    return star.model(spark, sf, ("nation", "customer")).follow("Party.Nation").drop("ord")


@query("""select 'orders:' || o_orderkey as mrid, count(*) as lines, round(sum(l_quantity), 2) as quantity from orders join lineitem on l_orderkey = o_orderkey group by 1""")
def follow_all_lines(spark, sf):
    lines = star.slots_of(t(spark, sf, "lineitem"), "lineitem", ["LineItem.Order"]).select(F.col("v_ref").alias("mrid"))
    quantity = t(spark, sf, "lineitem").groupBy(F.expr("concat('orders:', l_orderkey)").alias("mrid")).agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return lines.join(star.objects_of(t(spark, sf, "orders"), "orders"), "mrid", "left_semi").groupBy("mrid").agg(F.count("*").alias("lines")).join(quantity, "mrid")


@query("select 'customer:' || c_custkey as mrid from customer where c_nationkey = 3 union all select 'supplier:' || s_suppkey from supplier where s_nationkey = 3")
def referrers_of_nation(spark, sf):
    return star.model(spark, sf, ("customer", "supplier")).referrers("Party.Nation", "nation:3")


@query("""select 'nation:' || k as target, 'Party.Nation' as attr, count(*) as referrers, min(m) as first from (select c_nationkey k, 'customer:' || c_custkey m from customer union all select s_nationkey, 'supplier:' || s_suppkey from supplier) group by 1
 union all select 'region:' || n_regionkey, 'Nation.Region', count(*), min('nation:' || n_nationkey) from nation group by 1
 union all select 'customer:' || o_custkey, 'Order.Customer', count(*), min('orders:' || o_orderkey) from orders group by 1""")
def inverse_index(spark, sf):
    return star.model(spark, sf).inverse_index()


@query("""select 'customer:' || c_custkey as mrid, 'nation:' || c_nationkey as target, 'Party.Nation' as attr from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 0)
 union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'Party.Nation' from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey = 0)""")
def dangling_partial_load(spark, sf):
    """References left open when a region's nations aren't loaded."""
    m = star.model(spark, sf, ("nation", "customer", "supplier"), ["Party.Nation"], {"nation": t(spark, sf, "nation").where("n_regionkey <> 0")})
    return m.dangling().select("mrid", "target", "attr")


@query("select count(*) as n, count(distinct n_regionkey) as targets from nation where n_regionkey = 0")
def check_links_total(spark, sf):
    m = star.model(spark, sf, ("region", "nation"), ["Nation.Region"], {"region": t(spark, sf, "region").where("r_regionkey <> 0")})
    return m.dangling().agg(F.count("*").alias("n"), F.countDistinct("target").alias("targets"))


@query("select attr, count(*) as n from (select 'Thing.name' as attr from customer union all select 'Party.Nation' from customer union all select 'Party.acctbal' from customer union all select 'Customer.mktsegment' from customer) group by 1")
def value_count(spark, sf):
    return star.model(spark, sf, ("customer",)).slots.groupBy("attr").agg(F.count("*").alias("n"))


@query("select (3 * (select count(*) from supplier) + 4 * (select count(*) from part))::bigint as n")
def values_total(spark, sf):
    return star.model(spark, sf, ("supplier", "part")).slots.agg(F.count("*").alias("n"))


@query("""select class, ancestor, depth from (values ('Thing','Thing',0),('Place','Place',0),('Place','Thing',1),('Region','Region',0),('Region','Place',1),('Region','Thing',2),('Nation','Nation',0),('Nation','Place',1),('Nation','Thing',2),('Party','Party',0),('Party','Thing',1),
 ('Customer','Customer',0),('Customer','Party',1),('Customer','Thing',2),('Supplier','Supplier',0),('Supplier','Party',1),('Supplier','Thing',2),('Part','Part',0),('Part','Thing',1),('Order','Order',0),('Order','Thing',1),('LineItem','LineItem',0),('LineItem','Thing',1),('Event','Event',0),('Event','Thing',1)) v(class, ancestor, depth)""")
def class_closure(spark, sf):
    return star.vocabulary(spark).closure()


@query("select 'part:' || p_partkey as mrid, p_name as value from part")
def first_value(spark, sf):
    return star.model(spark, sf, ("part",)).values("Thing.name").where("ord = 0").select("mrid", F.col("v_text").alias("value"))


@query("select 'nation:' || c_nationkey as mrid, 'customer:' || c_custkey as referrer from customer union all select 'nation:' || s_nationkey, 'supplier:' || s_suppkey from supplier")
def inverse_role(spark, sf):
    return star.model(spark, sf, ("nation", "customer", "supplier")).inverse_of("Nation.Parties")


@query("select 'customer:' || c_custkey as mrid, 'rdf:about' as style from customer union all select 'orders:' || o_orderkey, 'rdf:ID' from orders")
def id_style(spark, sf):
    """In the operations profile customers are defined elsewhere; orders are mentioned nowhere in it, so the file introduces them."""
    return star.model(spark, sf, ("customer", "orders")).id_styles(star.OPS)


# -- merging ---------------------------------------------------------------------------------------------------------------------------

_ORDER = "l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


def _colliding(spark, sf):
    """Line items under identifiers that collide: raw slots of one file, in a total order of their rows."""
    rows = t(spark, sf, "lineitem").withColumn("elem_seq", F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*_ORDER.split(", "))).cast("long"))
    null = F.lit(None)
    return rows.select(
        F.expr("concat_ws(':', 'lineitem', l_orderkey, l_linenumber)").alias("mrid"), F.lit("LineItem.quantity").alias("attr"), F.lit(0).alias("ord"), F.lit("dbl").alias("kind"), null.cast("boolean").alias("v_bool"), null.cast("long").alias("v_int"),
        F.col("l_quantity").alias("v_dbl"), null.cast("string").alias("v_text"), null.cast("string").alias("v_ref"), null.cast("string").alias("lex"), F.when(F.col("l_returnflag") == "R", 2).otherwise(4).cast("long").alias("profiles"), F.lit(0).alias("file_seq"), "elem_seq",
    )


_RAW = f"select 'lineitem:' || l_orderkey || ':' || l_linenumber as mrid, l_quantity as q, case when l_returnflag = 'R' then 2 else 4 end as p, row_number() over (partition by l_orderkey, l_linenumber order by {_ORDER}) as n from lineitem"


@query(f"select mrid, arg_max(q, n) as quantity, bit_or(p)::bigint as profiles from ({_RAW}) group by 1")
def merge_lineitem_lww(spark, sf):
    return O.merge_slots(_colliding(spark, sf), star.vocabulary(spark)).select("mrid", F.col("v_dbl").alias("quantity"), "profiles")


@query(f"select mrid, n as elem_seq, was as discarded, q as kept from (select *, lag(q) over (partition by mrid order by n) as was from ({_RAW})) where was <> q")
def merge_conflicts(spark, sf):
    return O.conflicts(_colliding(spark, sf), star.vocabulary(spark)).select("mrid", "elem_seq", F.col("discarded.v_dbl").alias("discarded"), F.col("kept.v_dbl").alias("kept"))


@query(f"select mrid, n as elem_seq, greatest(0, count(*) over () - 1000)::bigint as dropped from (select *, lag(q) over (partition by mrid order by n) as was from ({_RAW})) where was <> q order by mrid, n limit 1000")
def conflicts_capped(spark, sf):
    return O.capped(O.conflicts(_colliding(spark, sf), star.vocabulary(spark)), 1000, "mrid", "elem_seq").select("mrid", "elem_seq", F.col("dropped").cast("long").alias("dropped"))


def _two_files(spark, sf):
    """Customers in a reference file as Customer and in an operations file as Party."""
    c = t(spark, sf, "customer")
    ref = star.model(spark, sf, ("customer",), ["Thing.name", "Party.Nation"])
    ops = star.model(spark, sf, ("customer",), ["Party.acctbal"], {"customer": c.where("c_custkey % 3 <> 0")})
    return ref.with_(objects=ref.objects.withColumn("profiles", F.lit(1).cast("long"))), ops.with_(objects=ops.objects.withColumns({"class": F.lit("Party"), "profiles": F.lit(2).cast("long")}))


@query("select 'customer:' || c_custkey as mrid, 'Customer' as class, (case when c_custkey % 3 <> 0 then 3 else 1 end)::bigint as profiles, (case when c_custkey % 3 <> 0 then 3 else 2 end)::bigint as values from customer")
def merge_ref_ops(spark, sf):
    m = O.merge(list(_two_files(spark, sf)))
    return m.objects.join(m.slots.groupBy("mrid").agg(F.count("*").alias("values")), "mrid")


@query("select 'customer:' || c_custkey as mrid, case when c_custkey % 5 = 0 then 'Supplier' else 'Customer' end as class, c_custkey % 5 = 0 as collision from customer")
def merge_class_refined(spark, sf):
    """A base class gives way to a derived one; of unrelated classes the first stays, and that is an error."""
    c = t(spark, sf, "customer").select(F.expr("concat('customer:', c_custkey)").alias("mrid"), "c_custkey")
    row = lambda df, cls, i: df.select("mrid", F.lit(cls).alias("class"), F.lit(1).cast("long").alias("profiles"), F.lit(i).alias("file_seq"), F.lit(0).cast("long").alias("elem_seq"))
    raw = row(c, "Party", 0).unionByName(row(c.where("c_custkey % 5 = 0"), "Supplier", 1)).unionByName(row(c, "Customer", 2))
    return O.merge_classes(raw, star.vocabulary(spark)).drop("profiles")


@query("select 'orders:' || l_orderkey as mrid, bit_or(case l_returnflag when 'R' then 1 when 'A' then 2 else 4 end)::bigint as profiles from lineitem group by 1")
def provenance_or(spark, sf):
    bit = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(4).cast("long")
    return t(spark, sf, "lineitem").groupBy(F.expr("concat('orders:', l_orderkey)").alias("mrid")).agg(F.bit_or(bit).alias("profiles"))


@query("select o_orderkey, (case when ((o_orderkey % 8) & 5) <> 0 then (o_orderkey % 8) & 5 when o_orderkey % 8 <> 0 then o_orderkey % 8 else 5 end)::bigint as effective, ((o_orderkey % 8) = 0 or ((o_orderkey % 8) & 5) <> 0) as covered from orders")
def effective_profiles(spark, sf):
    mask = F.col("o_orderkey") % 8
    return t(spark, sf, "orders").select("o_orderkey", P.effective(mask, F.lit(5).cast("long")).alias("effective"), P.covers(mask, F.lit(5).cast("long")).alias("covered"))


@query("select 'customer:' || c_custkey as mrid, 'Party.acctbal' as attr from customer union all select 'supplier:' || s_suppkey, 'Party.acctbal' from supplier union all select 'part:' || p_partkey, 'Part.retailprice' from part")
def profile_slice(spark, sf):
    return star.model(spark, sf).in_profiles(star.OPS).select("mrid", "attr")


@query(f"with k as ({_COUNTS}) select unnest([0, 1, 2]) as bit, unnest([r+n+c+s+p, c+s+p, o])::bigint as objects, unnest([r+2*n+3*c+2*s+3*p-x, c+s+p, 4*o])::bigint as values, unnest([x, 0, 0])::bigint as missing from k, (select count(*) as x from part where p_partkey % 10 = 0)")
def profile_coverage(spark, sf):
    """Objects, values and missing required values of each profile, where every tenth part has no brand."""
    m = star.model(spark, sf)
    return K.coverage(m.with_(slots=m.slots.where("NOT (attr = 'Part.brand' AND cast(substring_index(mrid, ':', -1) AS bigint) % 10 = 0)")))


# -- validation ------------------------------------------------------------------------------------------------------------------------


@query("""select 'customer:' || c_custkey as mrid, a as attr from customer, (values ('Party.acctbal'), ('Party.Nation')) v(a) where c_custkey % 7 = 0""")
def missing_required(spark, sf):
    m = star.model(spark, sf, ("customer",))
    gone = m.slots.where("attr IN ('Party.acctbal', 'Party.Nation') AND cast(substring_index(mrid, ':', -1) AS bigint) % 7 = 0").select("mrid", "attr")
    return K.missing_required(m.with_(slots=m.slots.join(gone, ["mrid", "attr"], "left_anti"))).select("mrid", "attr")


@query("select 'lineitem:' || l_orderkey || ':' || l_linenumber as mrid, count(*)::varchar || ' > 1' as message from lineitem group by l_orderkey, l_linenumber having count(*) > 1")
def cardinality_exceeded(spark, sf):
    m = star.model(spark, sf, ("region",))
    return K.cardinality(m.with_(slots=_colliding(spark, sf))).select("mrid", "message")


@query("select 'orders:' || l_orderkey as mrid, count(*)::varchar || ' < 4' as message from lineitem group by l_orderkey having count(*) < 4")
def lower_bound(spark, sf):
    """Orders with some parts, but fewer than the least number (K6)."""
    v = star.vocabulary(spark)
    parts = F.col("attr") == "LineItem.Part"
    v = replace(v, attrs=v.attrs.withColumns({"least": F.when(parts, 4).otherwise(F.col("least")), "most": F.when(~parts, F.col("most"))}))
    slots = star.slots_of(t(spark, sf, "lineitem"), "lineitem", ["LineItem.Part"]).withColumn("mrid", F.concat(F.lit("orders:"), F.element_at(F.split("mrid", ":"), 2)))
    return K.cardinality(O.Model(v, star.objects_of(t(spark, sf, "orders"), "orders"), slots)).select("mrid", "message")


@query("select 'orders:' || o_orderkey as mrid, 'Part is no Party' as message from orders where o_orderkey % 11 = 0 and o_custkey in (select p_partkey from part)")
def wrong_target(spark, sf):
    """Orders that refer to a part; a reference to a class above the declared one is fine (K8)."""
    m = star.model(spark, sf, ("customer", "part", "orders"), ["Order.Customer"])
    moved = m.slots.withColumn("v_ref", F.when(F.col("mrid").like("orders:%") & (F.substring_index("mrid", ":", -1).cast("long") % 11 == 0), F.replace("v_ref", F.lit("customer"), F.lit("part"))).otherwise(F.col("v_ref")))
    return K.wrong_target(m.with_(slots=moved)).select("mrid", "message")


@query("select 'customer:' || c_custkey as mrid, 'Party' as message from customer where c_custkey % 3 <> 0")
def abstract_instance(spark, sf):
    return K.abstract_class(_two_files(spark, sf)[1]).select("mrid", "message")


@query("select 'supplier:' || s_suppkey as mrid, 'Customer.mktsegment' as attr from supplier where s_suppkey % 2 = 0")
def class_membership(spark, sf):
    m = star.model(spark, sf, ("customer", "supplier"))
    stray = m.slots.where("mrid LIKE 'supplier:%' AND attr = 'Thing.name' AND cast(substring_index(mrid, ':', -1) AS bigint) % 2 = 0").withColumn("attr", F.lit("Customer.mktsegment"))
    return K.class_membership(m.with_(slots=m.slots.unionByName(stray))).select("mrid", "attr")


@query("select 'Thing.name' as attr, count(*)::varchar || ' values' as message, min('part:' || p_partkey) as mrid from part having count(*) > 0")
def profile_reach(spark, sf):
    m = star.model(spark, sf, ("part", "region"))
    moved = m.slots.withColumn("profiles", F.when(F.col("mrid").like("part:%") & (F.col("attr") == "Thing.name"), F.lit(2).cast("long")).otherwise(F.col("profiles")))
    return K.not_in_profile(m.with_(slots=moved)).select("attr", "message", "mrid")


@query("select 'part:' || p_partkey as mrid, p_brand || ' is not Brand#11' as message from part where p_brand <> 'Brand#11'")
def fixed_value(spark, sf):
    return K.fixed_value(star.model(spark, sf, ("part",))).select("mrid", "message")


@query("select 'part:' || p_partkey as mrid, 'text for Integer' as message from part where p_size > 25")
def datatype_mismatch(spark, sf):
    m = star.model(spark, sf, ("part",))
    big = (F.col("attr") == "Part.size") & (F.col("v_int") > 25)
    return K.datatype(m.with_(slots=m.slots.withColumns({"kind": F.when(big, "text").otherwise(F.col("kind"))}))).select("mrid", "message")


@query("select 'orders:' || o_orderkey as mrid, 'Order.priority' as attr from orders")
def deprecated_use(spark, sf):
    return K.deprecated(star.model(spark, sf, ("orders",))).select("mrid", "attr")


_HEADERS = "select case when o_orderkey % 5 = 0 then null when o_orderkey % 5 = 1 then 'model ' || o_orderkey else lower(md5('order:' || o_orderkey)) end as id, case when o_orderkey % 2 = 0 then 'x' end as created, case when o_orderkey % 3 = 0 then 'y' end as scenario_time, o_orderkey % 7 = 0 as bare from orders"


def _headers(spark, sf):
    k = F.col("o_orderkey")
    digest = M.hyphenated(F.md5(F.concat(F.lit("order:"), k)))
    return t(spark, sf, "orders").select(F.when(k % 5 == 0, None).when(k % 5 == 1, F.concat(F.lit("model "), k)).otherwise(digest).alias("id"), F.when(k % 2 == 0, "x").alias("created"), F.when(k % 3 == 0, "y").alias("scenario_time"), F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("p"))).alias("profiles"))


@query(f"""select severity, message, n from (select 'error' as severity, 'no identifier' as message, count(*) filter (id is null) as n from ({_HEADERS}) union all select 'warning', 'identifier is no UUID', count(*) filter (id like 'model %') from ({_HEADERS})
 union all select 'error', 'no profile', count(*) filter (bare) from ({_HEADERS}) union all select 'warning', 'no scenario time', count(*) filter (scenario_time is null) from ({_HEADERS}) union all select 'warning', 'no creation time', count(*) filter (created is null) from ({_HEADERS})) where n > 0""")
def header_rules(spark, sf):
    return K.headers(_headers(spark, sf)).groupBy("severity", "message").agg(F.count("*").alias("n"))


@query("select 'customer:' || c_custkey as id from customer where c_custkey % 4 in (0, 2)")
def headers_serving(spark, sf):
    """Headers that name the operations profile, in any version of its address."""
    k, base = F.col("c_custkey") % 4, "http://example.org/profiles/"
    named = F.when(k == 0, F.array(F.lit(base + "Reference/3.0"), F.lit(base + "Operation/4.1"))).when(k == 1, F.array(F.lit(base + "Reference/3.0"))).when(k == 2, F.array(F.lit(base + "Operation/3.0"))).otherwise(F.array().cast("array<string>"))
    return K.serving(t(spark, sf, "customer").select(F.expr("concat('customer:', c_custkey)").alias("id"), named.alias("profiles")), star.vocabulary(spark), star.OPS).select("id")


@query("select 'customer:' || c_custkey as mrid, 'nation:' || c_nationkey as needed from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 2)")
def dependency_missing(spark, sf):
    there = t(spark, sf, "nation").where("n_regionkey <> 2").select(F.expr("concat('nation:', n_nationkey)").alias("id"), F.array().cast("array<string>").alias("depends_on"))
    heads = there.unionByName(t(spark, sf, "customer").select(F.expr("concat('customer:', c_custkey)").alias("id"), F.array(F.expr("concat('nation:', c_nationkey)")).alias("depends_on")))
    return K.dependencies(heads).select("mrid", F.col("message").alias("needed"))


@query("""select 'CIM0004' as rule, 'warning' as severity, (select count(*) from customer) + (select count(*) from part) as n union all select 'CIM0006', 'warning', (select count(*) from customer) union all select 'CIM0017', 'warning', (select count(*) from part where p_brand <> 'Brand#11')""")
def report_summary(spark, sf):
    """All default rules over customers and parts without their nations."""
    return K.summary(K.validate(star.model(spark, sf, ("customer", "part"))))


@query("select 'warning' as severity, 2 * (select count(*) from customer) + (select count(*) from part) + (select count(*) from part where p_brand <> 'Brand#11') as n")
def severity_counts(spark, sf):
    return K.severities(K.validate(star.model(spark, sf, ("customer", "part"))))


@query("select 'part:' || p_partkey as mrid, p_brand || ' is not Brand#11' as message, greatest(0, count(*) over () - 25)::bigint as dropped from part where p_brand <> 'Brand#11' order by 1 limit 25")
def report_capped(spark, sf):
    """A report's first findings, and how many it leaves out."""
    return O.capped(K.fixed_value(star.model(spark, sf, ("part",))).select("mrid", "message"), 25, "mrid").withColumn("dropped", F.col("dropped").cast("long"))


# -- identifiers and texts -------------------------------------------------------------------------------------------------------------

_HEX = "md5('customer:' || c_custkey)"
_UUID = f"(substr({_HEX},1,8) || '-' || substr({_HEX},9,4) || '-' || substr({_HEX},13,4) || '-' || substr({_HEX},17,4) || '-' || substr({_HEX},21))"
_SPELLED = f"select c_custkey, case c_custkey % 6 when 0 then '_' || {_UUID} when 1 then '#_' || upper({_UUID}) when 2 then 'urn:uuid:' || {_UUID} when 3 then {_HEX} when 4 then 'https://grid.example.net/north.xml#_' || {_UUID} else ' Depot ' || c_custkey end as s, {_UUID} as u from customer"


def _spelled(spark, sf):
    k, u = F.col("c_custkey"), M.hyphenated(F.md5(F.concat(F.lit("customer:"), F.col("c_custkey"))))
    bare = F.md5(F.concat(F.lit("customer:"), k))
    s = F.when(k % 6 == 0, F.concat(F.lit("_"), u)).when(k % 6 == 1, F.concat(F.lit("#_"), F.upper(u))).when(k % 6 == 2, F.concat(F.lit("urn:uuid:"), u)).when(k % 6 == 3, bare).when(k % 6 == 4, F.concat(F.lit("https://grid.example.net/north.xml#_"), u)).otherwise(F.concat(F.lit(" Depot "), k))
    return t(spark, sf, "customer").select("c_custkey", s.alias("s"))


@query(f"select c_custkey, c_custkey % 6 < 5 as is_uuid, case when c_custkey % 6 < 5 then u else trim(s) end as key, case c_custkey % 6 when 3 then 'compact' when 5 then 'opaque' else 'uuid' end as form from ({_SPELLED})")
def mrid_parse(spark, sf):
    return _spelled(spark, sf).select("c_custkey", M.parse(F.col("s")).alias("m")).select("c_custkey", "m.is_uuid", "m.key", "m.form")


@query("select case c_custkey % 6 when 3 then 'compact' when 5 then 'opaque' else 'uuid' end as form, c_custkey % 6 not in (3, 5) as conforming, count(*) as n from customer group by all")
def mrid_form(spark, sf):
    m = _spelled(spark, sf).select(M.parse(F.col("s")).alias("m"))
    return m.groupBy("m.form", M.is_conforming(F.col("m")).alias("conforming")).agg(F.count("*").alias("n"))


@query(f"select count(*) as spellings, count(distinct case when c_custkey % 6 < 5 then u else trim(s) end) as identities from ({_SPELLED})")
def mrid_dedupe(spark, sf):
    return _spelled(spark, sf).agg(F.countDistinct("s").alias("spellings"), F.countDistinct(M.parse(F.col("s"))["key"]).alias("identities"))


@query(f"""select c_custkey, '_' || w as rdf_id, '#_' || w as rdf_resource, case when c_custkey % 6 < 5 then 'urn:uuid:' || u end as urn from (select *, case c_custkey % 6 when 1 then upper(u) when 3 then replace(u, '-', '') when 5 then trim(s) else u end as w from ({_SPELLED}))""")
def mrid_render(spark, sf):
    m = _spelled(spark, sf).select("c_custkey", M.parse(F.col("s")).alias("m"))
    return m.select("c_custkey", M.rdf_id(F.col("m")).alias("rdf_id"), M.rdf_resource(F.col("m")).alias("rdf_resource"), M.urn(F.col("m")).alias("urn"))


@query(f"select c_custkey, row_number() over (order by (c_custkey % 6 < 5) desc, case when c_custkey % 6 < 5 then u else trim(s) end) as place from ({_SPELLED})")
def mrid_sort(spark, sf):
    m = _spelled(spark, sf).select("c_custkey", M.parse(F.col("s")).alias("m"))
    return numbered(m, "place", *M.sort_keys(F.col("m"))).select("c_custkey", "place")


@query("""select c_custkey, substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h,17,1)) - 1) % 4 + 1, 1) || substr(h,18,3) || '-' || substr(h,21,12) as id
 from (select c_custkey, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(c_name)) as h from customer)""")
def uuid_v5(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", M.uuid_v5("6ba7b8119dad11d180b400c04fd430c8", F.col("c_name")).alias("id"))


_NUMBERS = "select o_orderkey, o_orderkey % 9 as k, (o_orderkey % 1000)::varchar as n from orders"
_NUMBER = "case k when 0 then n when 1 then ' ' || n || '.5 ' when 2 then n || ',25' when 3 then '1,234,' || lpad(n, 3, '0') when 4 then n || 'D2' when 5 then n || 'd' when 6 then 'x' || n when 7 then '-' || n || 'e1' else '1,' || lpad(n, 3, '0') end"


def _numbers(spark, sf):
    k, n = F.col("o_orderkey") % 9, (F.col("o_orderkey") % 1000).cast("string")
    pad = F.lpad(n, 3, "0")
    forms = [n, F.concat(F.lit(" "), n, F.lit(".5 ")), F.concat(n, F.lit(",25")), F.concat(F.lit("1,234,"), pad), F.concat(n, F.lit("D2")), F.concat(n, F.lit("d")), F.concat(F.lit("x"), n), F.concat(F.lit("-"), n, F.lit("e1")), F.concat(F.lit("1,"), pad)]
    return t(spark, sf, "orders").select("o_orderkey", F.coalesce(*[F.when(k == i, f) for i, f in enumerate(forms)]).alias("s"))


@query(f"select o_orderkey, case k when 0 then n::double when 1 then (n || '.5')::double when 2 then (n || '.25')::double when 4 then (n || 'e2')::double when 7 then ('-' || n || 'e1')::double end as x from ({_NUMBERS})")
def parse_float(spark, sf):
    return _numbers(spark, sf).select("o_orderkey", V.parse_float(F.col("s")).alias("x"))


@query(f"select o_orderkey, case k when 0 then n::bigint when 1 then n::bigint when 7 then -10 * n::bigint end as x from ({_NUMBERS})")
def parse_integer(spark, sf):
    return _numbers(spark, sf).select("o_orderkey", V.parse_integer(F.col("s")).alias("x"))


@query("select o_orderkey, case o_orderkey % 6 when 0 then true when 1 then false when 2 then true when 3 then false end as x from orders")
def parse_boolean(spark, sf):
    k = F.col("o_orderkey") % 6
    s = F.when(k == 0, " true ").when(k == 1, "false").when(k == 2, "1").when(k == 3, "0\n").when(k == 4, "True").otherwise("yes")
    return t(spark, sf, "orders").select("o_orderkey", V.parse_boolean(s).alias("x"))


@query(f"select o_orderkey, regexp_full_match({_NUMBER}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') as ok from ({_NUMBERS})")
def lexical_ok(spark, sf):
    return _numbers(spark, sf).select("o_orderkey", V.is_lexical(F.col("s"), F.lit("Float")).alias("ok"))


@query("select doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(13), '&#13;') as escaped from documents")
def xml_escape_text(spark, sf):
    return t(spark, sf, "documents").select("doc_id", X.escape_text(F.col("text")).alias("escaped"))


@query("""select page_id, md5(replace(replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(9), '&#9;'), chr(10), '&#10;'), chr(13), '&#13;')) as escaped from pages""")
def xml_escape_attr(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.md5(X.escape_attribute(F.col("html"))).alias("escaped"))


_INJECTED = "select doc_id, case when doc_id % 3 = 0 then left(text, 7) || chr(1) || text else text end as x from documents"


def _injected(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.left("text", F.lit(7)), F.lit("\x01"), "text")).otherwise(F.col("text")).alias("x"))


@query(f"select doc_id, x like '%' || chr(1) || '%' as bad, case when doc_id % 3 = 0 then octet_length(encode(split_part(x, chr(1), 1))) end as at from ({_INJECTED})")
def xml_illegal_scan(spark, sf):
    return _injected(spark, sf).select("doc_id", X.has_illegal(F.col("x")).alias("bad"), X.illegal_offset(F.col("x")).cast("long").alias("at"))


@query(f"select doc_id, md5(replace(x, chr(1), '')) as clean from ({_INJECTED})")
def xml_strip(spark, sf):
    return _injected(spark, sf).select("doc_id", F.md5(X.strip_illegal(F.col("x"))).alias("clean"))


@query("select p_partkey, regexp_full_match(case p_partkey % 4 when 0 then p_brand when 1 then replace(p_brand, '#', '-') when 2 then '1' || p_brand else '_é.' || p_partkey end, '[A-Za-z_é][A-Za-z0-9_.é-]*') as ok from part")
def ncname(spark, sf):
    k = F.col("p_partkey")
    s = F.when(k % 4 == 0, F.col("p_brand")).when(k % 4 == 1, F.replace("p_brand", F.lit("#"), F.lit("-"))).when(k % 4 == 2, F.concat(F.lit("1"), "p_brand")).otherwise(F.concat(F.lit("_é."), k))
    return t(spark, sf, "part").select("p_partkey", X.is_ncname(s).alias("ok"))


@query("""select doc_id, '<' || replace(replace(replace(replace(x, chr(92), chr(92) || 'u005C'), ' ', chr(92) || 'u0020'), '|', chr(92) || 'u007C'), chr(10), chr(92) || 'u000A') || '>' as iri
 from (select doc_id, source || case when doc_id % 2 = 0 then ' |' || chr(92) || chr(10) || 'é' else '' end as x from documents)""")
def iri_escape(spark, sf):
    x = F.concat("source", F.when(F.col("doc_id") % 2 == 0, " |\\\né").otherwise(""))
    return t(spark, sf, "documents").select("doc_id", R.iri(x).alias("iri"))


@query("select page_id, regexp_full_match(url, '[A-Za-z][A-Za-z0-9+.-]*:[^ #<>\"]+(#[^ #<>\"]*)?') as absolute from pages")
def absolute_iri(spark, sf):
    return t(spark, sf, "pages").select("page_id", X.is_absolute_iri(F.col("url")).alias("absolute"))


@query("select p_partkey, case p_partkey % 4 when 0 then 'name' when 1 then 'iri' else 'unwritable' end as form from part")
def identifier_form(spark, sf):
    k = F.col("p_partkey")
    s = F.when(k % 4 == 0, F.concat(F.lit("Part-"), k)).when(k % 4 == 1, F.concat(F.lit("https://grid.example.net/x#"), k)).when(k % 4 == 2, F.concat(F.lit("two words "), k)).otherwise("p#q#r")
    return t(spark, sf, "part").select("p_partkey", X.identifier_form(s).alias("form"))


@query("select doc_id, md5(replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')) as escaped from documents")
def nt_escape(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.md5(R.escape_literal(F.col("text"))).alias("escaped"))


@query("select p_partkey, case when regexp_full_match(p_name, '[A-Za-z0-9_]+') then '_:id' || p_name else '_:x' || lower(hex(encode(p_name))) end as label from part")
def blank_label(spark, sf):
    return t(spark, sf, "part").select("p_partkey", R.blank_label(F.col("p_name")).alias("label"))


@query("select page_id, regexp_extract(url, '^(.*[#/])[^#/]*$', 1) as namespace, regexp_extract(url, '([^#/]*)$', 1) as local from pages")
def split_iri(spark, sf):
    return t(spark, sf, "pages").select("page_id", R.split_iri(F.col("url")).alias("s")).select("page_id", "s.*")


@query("select doc_id, (len(head) - len(replace(head, chr(10), '')) + 1)::int as line, (octet_length(encode(regexp_extract(head, '([^\\n]*)$', 1))) + 1)::int as col from (select doc_id, text as head from documents)")
def line_and_column(spark, sf):
    at = F.octet_length("text")  # the end of the text
    return t(spark, sf, "documents").select("doc_id", X.line_and_column(F.col("text"), at).alias("p")).select("doc_id", "p.line", F.col("p.col").cast("int").alias("col"))


@query("select n_nationkey, case n_nationkey % 4 when 0 then 0 when 1 then 0 when 2 then 1 end as bit from nation")
def profile_by_iri(spark, sf):
    k = F.col("n_nationkey") % 4
    iri = F.when(k == 0, "http://example.org/profiles/Reference/4.0").when(k == 1, "http://example.org/ref").when(k == 2, "http://example.org/profiles/Operation/3.0").otherwise("http://example.org/none/1")
    return star.vocabulary(spark).resolve_iris(t(spark, sf, "nation").select("n_nationkey", iri.alias("iri"))).select("n_nationkey", "bit")


# -- differences -----------------------------------------------------------------------------------------------------------------------


def _edited(spark, sf):
    """Orders after an edit: some dropped, some added, some with another status."""
    o = t(spark, sf, "orders")
    kept = o.where("o_orderkey % 97 <> 0").withColumn("o_orderstatus", F.when((F.col("o_orderkey") % 13 == 0) & (F.col("o_orderstatus") == "F"), "P").otherwise(F.col("o_orderstatus")))
    added = o.where("o_orderkey % 101 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)
    return star.model(spark, sf, ("orders",)), star.model(spark, sf, ("orders",), rows={"orders": kept.unionByName(added)})


_ATTR_ROWS = "select 'orders:' || k as mrid, a as attr from (select o_orderkey as k, * from {rows}), (values ('Order.Customer'), ('Order.status'), ('Order.priority'), ('Order.totalprice')) v(a)"
_CHANGED = "select 'orders:' || o_orderkey, 'Order.status' from orders where o_orderkey % 13 = 0 and o_orderkey % 97 <> 0 and o_orderstatus = 'F'"


@query("select (select count(*) from orders where o_orderkey % 101 = 0) as added, (select count(*) from orders where o_orderkey % 97 = 0) as removed, (select count(*) from orders where o_orderkey % 13 = 0 and o_orderkey % 97 <> 0 and o_orderstatus = 'F') as changed")
def diff_counts(spark, sf):
    base, target = _edited(spark, sf)
    return D.counts(D.statements(base, target))


@query(_ATTR_ROWS.format(rows="(select o_orderkey + 10000000 as o_orderkey from orders where o_orderkey % 101 = 0)") + " union all " + _CHANGED)
def diff_forward(spark, sf):
    return D.statements(*_edited(spark, sf)).where("direction = 'forward'").select("mrid", "attr")


@query(_ATTR_ROWS.format(rows="(select o_orderkey from orders where o_orderkey % 97 = 0)") + " union all " + _CHANGED)
def diff_reverse(spark, sf):
    return D.statements(*_edited(spark, sf)).where("direction = 'reverse'").select("mrid", "attr")


@query("select 0::bigint as n")
def diff_respelling_is_empty(spark, sf):
    """The same numbers in another spelling are no difference."""
    m = star.model(spark, sf, ("orders",))
    return D.statements(m, m.with_(slots=m.slots.withColumn("lex", F.concat("lex", F.lit("0"))))).agg(F.count("*").alias("n"))


@query("select 0::bigint as n")
def diff_profile_scoped(spark, sf):
    """The edits are in one profile; in another there is no difference."""
    return D.statements(*_edited(spark, sf), scope=star.OPS).agg(F.count("*").alias("n"))


def _many_valued(spark, sf):
    """Orders with the parts of their lines, reduced to three numbers so that values repeat; the target drops some lines and doubles others."""
    lines = t(spark, sf, "lineitem").withColumn("l_partkey", F.col("l_partkey") % 3)
    edited = lines.where("l_linenumber <> 2").unionByName(lines.where("l_linenumber = 3"))
    whole = star.model(spark, sf, ("orders",))
    v = whole.vocabulary  # of a single-valued attribute, asserting would keep the last value alone
    whole = whole.with_(vocabulary=replace(v, attrs=v.attrs.withColumn("most", F.when(F.col("attr") != "LineItem.Part", F.col("most")))))
    slots = lambda rows: star.slots_of(rows, "lineitem", ["LineItem.Part"]).withColumn("mrid", F.concat(F.lit("orders:"), F.element_at(F.split("mrid", ":"), 2)))
    return whole.with_(slots=slots(lines)), whole.with_(slots=slots(edited))


_WAS = "select 'orders:' || l_orderkey as mrid, 'part:' || (l_partkey % 3) as value from lineitem"
_NOW = f"{_WAS} where l_linenumber <> 2 union all {_WAS} where l_linenumber = 3"


@query(f"select 'reverse' as direction, mrid, value from ({_WAS} except all ({_NOW})) union all select 'forward', mrid, value from (({_NOW}) except all {_WAS})")
def diff_multiset(spark, sf):
    """Repeated values count as often as they stand."""
    return D.statements(*_many_valued(spark, sf)).select("direction", "mrid", "value")


@query(f"select mrid, value, count(*) as n from ({_NOW}) where mrid in (select 'orders:' || o_orderkey from orders) group by all")
def apply_retract_many(spark, sf):
    """A retraction takes away one of several equal values (H9)."""
    base, target = _many_valued(spark, sf)
    return D.apply(base, D.statements(base, target)).slots.groupBy("mrid", F.col("v_ref").alias("value")).agg(F.count("*").alias("n"))


@query("select 'orders:' || o_orderkey as mrid from orders union select 'orders:' || (o_orderkey + 10000000) from orders where o_orderkey % 101 = 0")
def union_ids(spark, sf):
    base, target = _edited(spark, sf)
    return base.identifiers(target)


@query("select 0::bigint as statements, (select count(*) from orders where o_orderkey % 97 <> 0) + (select count(*) from orders where o_orderkey % 101 = 0) as objects")
def diff_apply_roundtrip(spark, sf):
    """Applying the difference gives the target: what is left between them is nothing (H7)."""
    base, target = _edited(spark, sf)
    done = D.apply(base, cut(D.statements(base, target)))
    done = done.with_(objects=cut(done.objects))
    return D.statements(done, target).agg(F.count("*").alias("statements")).crossJoin(done.objects.agg(F.count("*").alias("objects")))  # one row each


@query("select 'customer:' || c_custkey as mrid, 'Customer.mktsegment' as attr from customer where c_custkey % 10 = 0")
def reclassify_shed(spark, sf):
    m = star.model(spark, sf, ("customer",))
    return m.reclassify(m.objects.where("cast(substring_index(mrid, ':', -1) AS bigint) % 10 = 0").select("mrid", F.lit("Supplier").alias("class")))[1].select("mrid", "attr")


@query("select 'orders:' || o_orderkey as mrid from orders where o_orderkey % 2 = 0")
def prune_empty(spark, sf):
    m = star.model(spark, sf, ("orders",))
    return m.with_(slots=m.slots.where("cast(substring_index(mrid, ':', -1) AS bigint) % 2 = 0")).prune_empty().objects.select("mrid")


@query("select 'customer:' || user_id as mrid, min(event_id) as first from events group by 1")
def affected_objects(spark, sf):
    return D.affected(t(spark, sf, "events").select(F.expr("concat('customer:', user_id)").alias("mrid"), F.col("event_id").alias("seq")))


@query("""select seq, grp as "group" from (select seq, sum(fresh) over (partition by d order by seq) as grp from (select event_id as seq, event_type as d, case when lag(user_id % 5) over (partition by event_type order by event_id) is distinct from user_id % 5 then 1 else 0 end as fresh from events))""")
def statement_groups(spark, sf):
    rows = t(spark, sf, "events").select(F.col("event_type").alias("direction"), F.col("event_id").alias("seq"), (F.col("user_id") % 5).cast("string").alias("mrid"), F.lit(None).cast("string").alias("class"))
    return D.statement_groups(rows).select("seq", "group")


# -- RDF, censuses, names --------------------------------------------------------------------------------------------------------------

_NS = star.NS


@query(f"""select '_:x' || lower(hex(encode(m))) || ' ' || p || ' ' || o || ' .' as value from (
 select 'nation:' || n_nationkey as m, '<{rdf.RDF_TYPE}>' as p, '<{_NS}Nation>' as o from nation union all select 'region:' || r_regionkey, '<{rdf.RDF_TYPE}>', '<{_NS}Region>' from region
 union all select 'nation:' || n_nationkey, '<{_NS}Thing.name>', '"' || n_name || '"' from nation union all select 'region:' || r_regionkey, '<{_NS}Thing.name>', '"' || r_name || '"' from region
 union all select 'nation:' || n_nationkey, '<{_NS}Nation.Region>', '_:x' || lower(hex(encode('region:' || n_regionkey))) from nation)""")
def nt_lines(spark, sf):
    return rdf.lines(rdf.triples(star.model(spark, sf, ("region", "nation")), star.REF, _NS))


@query(f"""select '_:x' || lower(hex(encode('part:' || p_partkey))) as subject, '<{_NS}Part>' as object from part union all select '_:x' || lower(hex(encode('supplier:' || s_suppkey))), '<{_NS}Supplier>' from supplier""")
def nt_type_rows(spark, sf):
    found = rdf.triples(star.model(spark, sf, ("part", "supplier")), star.REF, _NS)
    return found.where(F.col("predicate") == f"<{rdf.RDF_TYPE}>").select("subject", "object")


@query("select 'integer' as datatype, (select count(*) from part) as n union all select '', 2 * (select count(*) from part) union all select 'decimal', (select count(*) from part) union all select null, (select count(*) from part)")
def nt_datatype_histogram(spark, sf):
    return rdf.datatype_histogram(rdf.triples(star.model(spark, sf, ("part",)), star.REF | star.OPS, _NS))


@query("select 'customer:' || c_custkey as mrid, case when c_custkey % 3 = 0 then 'Thing' else 'Customer' end as element from customer")
def element_class(spark, sf):
    """Customers without a balance can't stand as Customer or Party in the operations profile."""
    m = star.model(spark, sf, ("customer",), ["Party.acctbal", "Party.Nation"])
    slots = m.slots.where("NOT (attr = 'Party.acctbal' AND cast(substring_index(mrid, ':', -1) AS bigint) % 3 = 0)")
    return O.element_class(m.objects, slots, m.vocabulary, star.OPS)


@query("select case when c_custkey % 3 = 0 then 'Thing' else 'Customer' end as element, 'rdf:about' as style, count(*) as n from customer group by 1")
def element_census(spark, sf):
    """Elements of an export by name and identity style."""
    m = star.model(spark, sf, ("customer",), ["Party.acctbal", "Party.Nation"])
    slots = m.slots.where("NOT (attr = 'Party.acctbal' AND cast(substring_index(mrid, ':', -1) AS bigint) % 3 = 0)")
    return O.element_class(m.objects, slots, m.vocabulary, star.OPS).join(m.id_styles(star.OPS), "mrid").groupBy("element", "style").agg(F.count("*").alias("n"))


@query("select 'customer:' || c_custkey as mrid, case when c_custkey % 3 <> 0 then 2 else 1 end::bigint as files from customer")
def identifier_census(spark, sf):
    ref, ops = _two_files(spark, sf)
    return ref.objects.select("mrid").union(ops.objects.select("mrid")).groupBy("mrid").agg(F.count("*").alias("files"))


@query("select o_orderstatus as value, count(*) as n from orders group by 1")
def value_census(spark, sf):
    return star.model(spark, sf, ("orders",), ["Order.status"]).slots.groupBy(F.col("v_text").alias("value")).agg(F.count("*").alias("n"))


@query("select user_id, event_id, case when n = 1 then event_type || '.xml' else event_type || '_' || n || '.xml' end as name from (select *, row_number() over (partition by user_id, event_type order by event_id) as n from events)")
def unique_names(spark, sf):
    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    return t(spark, sf, "events").withColumn("n", n).select("user_id", "event_id", F.when(F.col("n") == 1, F.concat("event_type", F.lit(".xml"))).otherwise(F.concat("event_type", F.lit("_"), "n", F.lit(".xml"))).alias("name"))


@query("select c_mktsegment as file, case when max(c_nationkey) >= 20 then 'b' else 'a' end as vintage from customer group by 1")
def vintage_score(spark, sf):
    from ..operators.vocabulary import detect

    seen = t(spark, sf, "customer").select(F.col("c_mktsegment").alias("file"), F.when(F.col("c_nationkey") >= 20, "ns:b").otherwise("ns:a").alias("ns")).distinct()
    known = spark.createDataFrame([("a", "ns:a", 3), ("b", "ns:b", 5)], "vintage string, ns string, classes int")
    return detect(seen, known).select("file", "vintage")


@query("select user_id, list_distinct(list(event_type order by event_id)).len()::int as n, first(event_type order by event_id) as first from events group by 1")
def dedup_ordered(spark, sf):
    ordered = t(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"), F.min_by("event_type", "event_id").alias("first"))
    return ordered.select("user_id", F.size("kinds").alias("n"), "first")


from . import documents, edits, sources  # noqa: E402,F401  their queries register themselves
