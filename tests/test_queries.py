"""Every registered query with SQL against DuckDB on the smallest tables, and the functions' fixtures."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from voltmesh.functions import mrid as M
from voltmesh.functions import values as V
from voltmesh.functions import xmltext as X
from voltmesh.operators import rdf
from voltmesh.plans.registry import ORACLE_SQL, QUERIES
from voltmesh.sources import cimxml

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame):
    def one(x):
        if x is None or x is pd.NA or x != x:
            return None
        x = x.item() if hasattr(x, "item") else x
        return int(x) if isinstance(x, float) and x == int(x) else round(x, 6) if isinstance(x, float) else x

    return sorted(repr([one(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    found, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(want.columns) and rows(found) == rows(want)


def column(spark, values, expression, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(expression(F.col("x"))).collect()]


def test_identifiers(spark):
    u = "9c8b7a65-1234-4def-8abc-0123456789ab"
    spelled = [u, "_" + u, "#_" + u.upper(), "urn:uuid:" + u, "URN:UUID:_" + u, u.replace("-", ""), "https://grid.example.net/north.xml#_" + u, " " + u + " "]
    assert set(column(spark, spelled, lambda x: M.parse(x)["key"])) == {u}
    assert [tuple(r) for r in column(spark, ["_Depot 7", u.replace("-", "")], lambda x: F.struct(M.parse(x)["key"], M.parse(x)["form"]))] == [("Depot 7", "opaque"), (u, "compact")]
    assert column(spark, [u, u.replace("-", ""), "Depot 7", ""], lambda x: M.complaint(M.parse(x))) == [None, f"UUID without hyphens: {u.replace('-', '')}", "not a UUID: Depot 7", "empty identifier"]


def test_floats(spark):
    texts = ["2.25D+2", "-8,12", "6,02E3", "9,876", "4,000", "7,654.3", "9,876,543", "2.5d", "", "zero", " 8.0 "]
    assert column(spark, texts, V.parse_float) == [225.0, -8.12, 6020.0, None, None, None, None, None, None, None, 8.0]
    assert column(spark, ["31", "9.0", "9.8", "no"], V.parse_integer) == [31, 9, 9, None]
    numbers = [2.5e210, 3e-8, 0.0002, -0.0, float("nan"), float("inf"), -float("inf"), 640.0, 1e16, 98765.25, 1e-5, 4e22, None]
    assert column(spark, numbers, V.canonical_float, "double") == ["2.5E210", "3E-8", "0.0002", "0", "NaN", "INF", "-INF", "640", "1E16", "98765.25", "0.00001", "4E22", None]


def test_names(spark):
    assert column(spark, ["_pump", "p", "P-3.1", "\u00f1", "", "3pump", "-pump", "p:q", "p q", "p/q", "p#q", ".pump"], X.is_ncname) == [True] * 4 + [False] * 8
    assert column(spark, ["https://grid.example.net/n.xml#d7", "urn:isbn:x", "file:///p", "7http://x", "http://p q", "http://p#q#r", ":none"], X.is_absolute_iri) == [True] * 3 + [False] * 4
    assert column(spark, ["Depot7", "https://grid.example.net/n.xml#d7", "p:q", "two words", "p#q#r", "", "p/q"], X.identifier_form) == ["name", "iri", "iri", "unwritable", "unwritable", "unwritable", "unwritable"]
    assert column(spark, ["xy\0z", "\u00f6\x02", "good", "\ufffe", "\ufffd"], X.illegal_offset) == [2, 2, None, 0, None]
    assert [tuple(r) for r in column(spark, [0, 4, 7], lambda x: X.line_and_column(F.lit("red\ngreen\nblue"), x), "int")] == [(1, 1), (2, 1), (2, 4)]
    texts = ["&lt;a&gt; &amp;amp; &#233;&#x1F4A7; &#38;lt; &none; &#0; &#xD800;"]
    assert column(spark, texts, X.unescape) == ["<a> &amp; \u00e9\U0001f4a7 &lt; &none; &#0; &#xD800;"]


def test_bound_prefixes():
    wanted = [("cim", "u#"), ("cim", "v#"), ("", "w#"), ("xml", "x#"), ("other", "u#"), ("rdf", "y#")]
    assert cimxml.bound_prefixes(wanted) == {cimxml.T.RDF: "rdf", "u#": "cim", "v#": "cim2", "w#": "ns", "x#": "ns2", "y#": "rdf2"}
    lines, kept = rdf.turtle_prologue({"cim": "u#", "rdf": "z#", "again": "u#"})
    assert kept == {"cim": "u#"} and lines.count("@prefix") == 4
