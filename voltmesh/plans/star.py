"""Relational tables as a model: the star schema of the test tables seen through a small vocabulary.

Every row is an object, named ``table:key``; every column is a slot. Four profiles stand for four files: reference data (bit 0), operational
values (1), transactions (2) and events (3). The same operators that serve CIM documents so run on, and are checked against, plain tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.model import Model
from ..operators.vocabulary import Vocabulary

NS = "http://example.org/star#"
REF, OPS, TXN, EVT = 1, 2, 4, 8

# class, ns, parent, concrete, profiles, defined_in, concrete_in, deprecated
CLASSES = [
    ("Thing", NS, None, False, 15, 1, 0, False), ("Place", NS, "Thing", False, 1, 1, 0, False), ("Region", NS, "Place", True, 1, 1, 1, False), ("Nation", NS, "Place", True, 1, 1, 1, False),
    ("Party", NS, "Thing", False, 3, 1, 0, False), ("Customer", NS, "Party", True, 3, 1, 1, False), ("Supplier", NS, "Party", True, 3, 1, 1, False), ("Part", NS, "Thing", True, 3, 1, 1, False),
    ("Order", NS, "Thing", True, 4, 4, 4, False), ("LineItem", NS, "Thing", True, 4, 4, 4, False), ("Event", NS, "Thing", True, 8, 8, 8, True),
]
# attr, ns, owner, kind, primitive, target, least, most, used_in, deprecated, fixed
ATTRS = [
    ("Thing.name", NS, "Thing", "value", "String", None, 0, 1, REF, False, ""), ("Nation.Region", NS, "Nation", "ref", None, "Region", 1, 1, REF, False, ""), ("Party.Nation", NS, "Party", "ref", None, "Nation", 1, 1, REF, False, ""),
    ("Party.acctbal", NS, "Party", "value", "Decimal", None, 1, 1, OPS, False, ""), ("Customer.mktsegment", NS, "Customer", "enum", None, None, 0, 1, REF, False, ""), ("Part.brand", NS, "Part", "value", "String", None, 1, 1, REF, False, "Brand#11"),
    ("Part.size", NS, "Part", "value", "Integer", None, 1, 1, REF, False, ""), ("Part.retailprice", NS, "Part", "value", "Decimal", None, 0, 1, OPS, False, ""), ("Order.Customer", NS, "Order", "ref", None, "Party", 1, 1, TXN, False, ""),
    ("Order.status", NS, "Order", "enum", None, None, 0, 1, TXN, False, ""), ("Order.priority", NS, "Order", "value", "String", None, 0, 1, TXN, True, ""), ("Order.totalprice", NS, "Order", "value", "Decimal", None, 1, 1, TXN, False, ""),
    ("LineItem.Order", NS, "LineItem", "ref", None, "Order", 1, 1, TXN, False, ""), ("LineItem.Supplier", NS, "LineItem", "ref", None, "Supplier", 1, 1, TXN, False, ""), ("LineItem.Part", NS, "LineItem", "ref", None, "Part", 1, 1, TXN, False, ""),
    ("LineItem.quantity", NS, "LineItem", "value", "Decimal", None, 1, 1, TXN, False, ""), ("LineItem.amount", NS, "LineItem", "value", "Decimal", None, 1, 1, TXN, False, ""), ("Event.User", NS, "Event", "ref", None, "Customer", 0, 1, EVT, False, ""),
    ("Event.type", NS, "Event", "enum", None, None, 0, 1, EVT, False, ""), ("Event.value", NS, "Event", "value", "Float", None, 0, 1, EVT, False, ""),
]

#: table -> class, key expression, profiles of the object, {attribute: (kind, expression, profiles)}
TABLES = {
    "region": ("Region", "r_regionkey", REF, {"Thing.name": ("text", "r_name", REF)}),
    "nation": ("Nation", "n_nationkey", REF, {"Thing.name": ("text", "n_name", REF), "Nation.Region": ("ref", "concat('region:', n_regionkey)", REF)}),
    "customer": ("Customer", "c_custkey", REF | OPS, {"Thing.name": ("text", "c_name", REF), "Party.Nation": ("ref", "concat('nation:', c_nationkey)", REF), "Party.acctbal": ("dbl", "c_acctbal", OPS), "Customer.mktsegment": ("enum", "c_mktsegment", REF)}),
    "supplier": ("Supplier", "s_suppkey", REF | OPS, {"Thing.name": ("text", "s_name", REF), "Party.Nation": ("ref", "concat('nation:', s_nationkey)", REF), "Party.acctbal": ("dbl", "s_acctbal", OPS)}),
    "part": ("Part", "p_partkey", REF | OPS, {"Thing.name": ("text", "p_name", REF), "Part.brand": ("text", "p_brand", REF), "Part.size": ("int", "p_size", REF), "Part.retailprice": ("dbl", "p_retailprice", OPS)}),
    "orders": ("Order", "o_orderkey", TXN, {"Order.Customer": ("ref", "concat('customer:', o_custkey)", TXN), "Order.status": ("enum", "o_orderstatus", TXN), "Order.priority": ("text", "o_orderpriority", TXN), "Order.totalprice": ("dbl", "o_totalprice", TXN)}),
    "lineitem": ("LineItem", "concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey)", TXN, {"LineItem.Order": ("ref", "concat('orders:', l_orderkey)", TXN), "LineItem.Supplier": ("ref", "concat('supplier:', l_suppkey)", TXN), "LineItem.Part": ("ref", "concat('part:', l_partkey)", TXN), "LineItem.quantity": ("dbl", "l_quantity", TXN), "LineItem.amount": ("dbl", "l_extendedprice * (1 - l_discount)", TXN)}),
    "events": ("Event", "event_id", EVT, {"Event.User": ("ref", "concat('customer:', user_id)", EVT), "Event.type": ("enum", "event_type", EVT), "Event.value": ("dbl", "value", EVT)}),
}
#: The ends of associations that are not stored, and the attribute at the other end.
INVERSES = [("Nation.Parties", "Party.Nation"), ("Region.Nations", "Nation.Region"), ("Party.Orders", "Order.Customer")]
DEFAULT = ("region", "nation", "customer", "supplier", "part", "orders")


def vocabulary(spark: SparkSession) -> Vocabulary:
    profiles = [("REF", 0, "http://example.org/profiles/Reference/3.0", ["http://example.org/ref"]), ("OPS", 1, "http://example.org/profiles/Operation/3.0", []), ("TXN", 2, "http://example.org/profiles/Transaction/3.0", []), ("EVT", 3, "http://example.org/profiles/Event/1.0", [])]
    return Vocabulary.of(spark, CLASSES, ATTRS, [(NS, "Status", x) for x in "FOP"], profiles, INVERSES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slots_of(rows: DataFrame, name: str, attrs: list[str] | None = None) -> DataFrame:
    """The slots of one table, by an in-place ``inline`` of its columns; only the named attributes' columns are read."""
    _, key, _, columns = TABLES[name]
    typed = lambda kind, want, e, t: f"cast({e if kind in want else 'null'} as {t})"
    structs = [
        f"named_struct('attr', '{a}', 'ord', 0, 'kind', '{kind}', 'v_bool', cast(null as boolean), 'v_int', {typed(kind, ('int',), e, 'bigint')}, 'v_dbl', {typed(kind, ('dbl',), e, 'double')}, "
        f"'v_text', {typed(kind, ('text', 'enum'), e, 'string')}, 'v_ref', {typed(kind, ('ref',), e, 'string')}, 'lex', cast(null as string), 'profiles', cast({p} as bigint))"
        for a, (kind, e, p) in columns.items() if attrs is None or a in attrs
    ]
    return rows.selectExpr(f"concat('{name}:', {key}) AS mrid", f"inline(array({', '.join(structs)}))").where("coalesce(v_text, v_ref, cast(v_int AS string), cast(v_dbl AS string)) IS NOT NULL")


def objects_of(rows: DataFrame, name: str) -> DataFrame:
    cls, key, profiles, _ = TABLES[name]
    return rows.select(F.expr(f"concat('{name}:', {key})").alias("mrid"), F.lit(cls).alias("class"), F.lit(profiles).cast("long").alias("profiles"))


def model(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = DEFAULT, attrs: list[str] | None = None, rows: dict[str, DataFrame] | None = None) -> Model:
    """The model of some tables (``rows``: changed ones), with some attributes."""
    read = {t: (rows or {}).get(t, None) for t in tables}
    read = {t: table(spark, sf_dir, t) if r is None else r for t, r in read.items()}
    named = lambda t: attrs is None or set(attrs) & set(TABLES[t][3])
    slots = reduce(DataFrame.unionByName, [slots_of(r, t, attrs) for t, r in read.items() if named(t)])
    return Model(vocabulary(spark), reduce(DataFrame.unionByName, [objects_of(r, t) for t, r in read.items()]), slots)
