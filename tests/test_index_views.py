"""The stored reverse index, generated views, capped reports, and differences applied with findings."""

import random

import pytest
from pyspark.sql import functions as F
from voltmesh.operators import difference as D
from voltmesh.operators import model as O
from voltmesh.operators.inverse import InverseIndex
from voltmesh.operators.views import named, typed_view
from voltmesh.operators.vocabulary import Vocabulary

NS = "http://example.org/farm#"


def slot(mrid, attr, kind, value, n=0):
    at = {"bool": 0, "int": 1, "dbl": 2, "text": 3, "enum": 3, "ref": 4}[kind]
    return (mrid, attr, n, kind, *(value if i == at else None for i in range(5)), None, 1)


@pytest.fixture(scope="module")
def farm(spark):
    classes = [("Thing", NS, None, False, 1, 1, 0, False), ("Field", NS, "Thing", True, 1, 1, 1, False), ("Barn", NS, "Thing", True, 1, 1, 1, False), ("BigBarn", NS, "Barn", True, 1, 1, 1, False), ("Roof", NS, None, False, 1, 1, 0, False)]
    attr = lambda name, kind, primitive=None, target=None, most=1: (name, NS, name.split(".")[0], kind, primitive, target, 0, most, 1, False, "")
    attrs = [attr("Thing.name", "value", "String"), attr("Field.area", "value", "Float"), attr("Field.Barn", "ref", None, "Barn"), attr("Barn.name", "value", "String"), attr("Barn.open", "value", "Boolean"), attr("Barn.tags", "value", "String", most=None), attr("BigBarn.roof", "compound", None, "Roof"), attr("BigBarn.class", "value", "Integer"), attr("Roof.slope", "value", "Float"), attr("Roof.Roof", "compound", None, "Roof")]
    return Vocabulary.of(spark, classes, attrs, [], [], [("Barn.Fields", "Field.Barn")])


def test_inverse_index(spark, farm):
    rng = random.Random(3)
    targets = ["hot"] * 400 + [f"b{i}" for i in range(60)]
    edges = [(f"f{i}", "Field.Barn" if i % 5 else "Field.Other", rng.choice(targets)) for i in range(1500)]
    m = O.Model(farm, spark.createDataFrame([("hot", "Barn", 1)], "mrid string, class string, profiles long"), spark.createDataFrame([slot(a, b, "ref", c) for a, b, c in edges], O.SLOTS))
    index = InverseIndex.build(m, buckets=8, most=100)
    try:
        rows = index.lists().collect()
        assert sum(len(r.referrers) for r in rows) == 1500 and max(len(r.referrers) for r in rows) < 250 and sum(r.target == "hot" for r in rows) > 8
        assert all(r.referrers == sorted(r.referrers) for r in rows)
        for target in ("hot", "b7", "#_b8", "none"):
            key = target.removeprefix("#_")
            assert sorted(map(tuple, index.all_referrers(target).collect())) == sorted((b, a) for a, b, c in edges if c == key)
            assert {r.mrid for r in index.referrers("Field.Barn", target).collect()} == {a for a, b, c in edges if c == key and b == "Field.Barn"}
        one = index.all_referrers("b7")
        plan = one._jdf.queryExecution().executedPlan()
        one.collect()
        parts = plan.collectLeaves().head().inputRDD().filePartitions()
        read = {f.filePath().toString() for i in range(parts.length()) for f in parts.apply(i).files()}
        # of the files of 8 buckets only those of one are read
        assert 1 <= len(read) <= 4 < spark.table(index.table).select(F.input_file_name()).distinct().count() and "Exchange" not in plan.toString()
        wanted = spark.createDataFrame([("hot",), ("b1",), ("b1",)], "target string")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            probe = index.probe(wanted)
            plan = probe._jdf.queryExecution().executedPlan().toString()
            found = sorted(map(tuple, probe.collect()))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert found == sorted((c, b, a) for a, b, c in edges if c in ("hot", "b1"))
        assert not any("Exchange" in line and "referrers" in line for line in plan.splitlines())
        assert sorted(map(tuple, index.inverse_of(m, "Barn.Fields").collect())) == sorted((c, a) for a, b, c in edges if b == "Field.Barn")
    finally:
        index.drop()


def test_names_of_columns():
    found = [(0, "BigBarn.class", "BigBarn"), (1, "Barn.name", "Barn"), (2, "Thing.name", "Thing"), (3, "Other.Thing_name", "Other"), (3, "Thing.Name", "Thing")]
    assert named(found) == {"BigBarn.class": "BigBarn_class", "Barn.name": "name", "Thing.name": "Thing_name", "Other.Thing_name": "Other_Thing_name", "Thing.Name": "Thing_Name_2"}


def test_typed_view(spark, farm):
    rows = [slot("b", "Barn.name", "text", "own"), slot("b", "Thing.name", "text", "plain"), slot("b", "Barn.open", "bool", True), slot("b", "Barn.tags", "text", "y", 1), slot("b", "Barn.tags", "text", "x", 0), slot("b", "BigBarn.class", "int", 4), slot("b", "BigBarn.roof/Roof.slope", "dbl", 0.5), slot("b", "BigBarn.roof/Roof.Roof/Roof.slope", "dbl", 0.25)]
    m = O.Model(farm, spark.createDataFrame([("b", "BigBarn", 1), ("e", "BigBarn", 1), ("c", "Barn", 1)], "mrid string, class string, profiles long"), spark.createDataFrame(rows, O.SLOTS))
    view = typed_view(m, "BigBarn", {"BigBarn.class": "none"})
    assert view.columns == ["mrid", "class", "BigBarn_class", "roof", "name", "open", "tags", "Thing_name"]
    got = {r.mrid: r for r in view.collect()}
    assert (got["b"].BigBarn_class, got["b"].name, got["b"].Thing_name, got["b"].open, got["b"].tags) == (4, "own", "plain", True, ["x", "y"])
    assert got["b"].roof.slope == 0.5 and got["b"].roof.Roof.slope == 0.25 and got["e"].name is None and set(got) == {"b", "e"}
    assert view.schema["BigBarn_class"].metadata == {"attr": "BigBarn.class", "kind": "value", "unit": "none"}
    assert {r.mrid for r in typed_view(m, "Barn").collect()} == {"b", "c", "e"} and typed_view(m, "Roof").count() == 0
    assert typed_view(m, "Field").schema["Barn"].metadata["target"] == "Barn"


def test_capped(spark):
    rows = [(i * 7919 % 5000, None if i % 11 == 0 else f"k{i % 13}") for i in range(5000)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(7)
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[0]))
    for most in (1, 40, 4999, 6000):
        got = O.capped(df, most, "b", "a").collect()
        assert [(r.a, r.b) for r in got] == want[:most] and {r.dropped for r in got} == {max(0, 5000 - most)}
    assert O.capped(df.limit(0), 5, "a").count() == 0


def test_apply_checked(spark, farm):
    m = O.Model(farm, spark.createDataFrame([("b", "Barn", 1), ("f", "Field", 1), ("idle", "Field", 1)], "mrid string, class string, profiles long"), spark.createDataFrame([slot("b", "Barn.name", "text", "old"), slot("b", "Barn.tags", "text", "x"), slot("f", "Field.area", "dbl", 2.0), slot("f", "Thing.name", "text", "n")], O.SLOTS))
    rows = [
        ("forward", 0, "b", None, False, "Barn.name", "text", "new"), ("forward", 1, "b", None, False, "Barn.tags", "text", "z"), ("reverse", 2, "b", None, False, "Barn.tags", "text", "nothing"), ("forward", 3, "b", None, False, "Field.area", "dbl", "1"),
        ("forward", 4, "f", "Barn", False, "Barn.open", "bool", "true"), ("reverse", 5, "gone", None, False, "Thing.name", "text", "n"), ("forward", 6, "fresh", "Nothing", True, "Field.area", "dbl", "3"), ("forward", 7, "big", "BigBarn", True, "Thing.name", "text", "g"),
    ]
    found = spark.createDataFrame(rows, "direction string, seq long, mrid string, class string, defines boolean, attr string, kind string, value string")
    done, findings = D.apply_checked(m, found, 2)
    assert {(r.mrid, r["class"]) for r in done.objects.collect()} == {("b", "Barn"), ("f", "Barn"), ("idle", "Field"), ("fresh", "Field"), ("big", "BigBarn")}
    assert {(r.mrid, r.attr, r.ord, r.v_text or r.v_dbl or r.v_bool, r.profiles) for r in done.slots.collect()} == {
        ("b", "Barn.name", 0, "new", 2), ("b", "Barn.tags", 0, "x", 1), ("b", "Barn.tags", 1, "z", 2), ("f", "Thing.name", 0, "n", 1), ("f", "Barn.open", 0, True, 2), ("fresh", "Field.area", 0, 3.0, 2), ("big", "Thing.name", 0, "g", 2),
    }
    assert {(r.severity, r.rule, r.mrid, r.attr) for r in findings.collect()} == {
        ("info", "CIM0015", "b", "Barn.tags"), ("warning", "CIM0002", "b", "Field.area"), ("info", "CIM0015", "f", None), ("warning", "CIM0015", "f", "Field.area"), ("warning", "CIM0006", "gone", "Thing.name"), ("warning", "CIM0001", "fresh", None),
    }
    nothing = found.limit(0)
    same, none = D.apply_checked(m, nothing)
    assert none.count() == 0 and D.statements(m, same).count() == 0
    assert D.statements(D.apply(m, nothing), m).count() == 0 and D.apply(m, found).objects.where(F.col("mrid") == "idle").count() == 1
