"""CIM/XML documents: reading, merging, differences and writing, on small hand-made files."""

import zipfile

import pytest
from pyspark.sql import functions as F
from voltmesh.operators import difference as D
from voltmesh.operators import rdf
from voltmesh.operators import validate as K
from voltmesh.operators.vocabulary import Vocabulary
from voltmesh.sources import cimxml, rdfs, xmltokens
from voltmesh.streaming import changes

NS = "http://example.org/waterworks#"
PLAN, LIVE = "http://example.org/profiles/Plan/2.0", "http://example.org/profiles/Live/2.0"
PUMP, TANK, PORT = "0d5f1c52-7a3e-4d0b-9b1e-6a2f3c4d5e01", "0d5f1c52-7a3e-4d0b-9b1e-6a2f3c4d5e02", "0d5f1c52-7a3e-4d0b-9b1e-6a2f3c4d5e03"
RDF_NS = 'xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"'


def document(profile, body, ident="77777777-0000-4000-8000-000000000000", more=""):
    head = f"<md:FullModel rdf:about='urn:uuid:{ident}'><md:Model.created>2031-05-06</md:Model.created><md:Model.scenarioTime>noon</md:Model.scenarioTime><md:Model.profile>{profile}</md:Model.profile><md:Model.DependentOn rdf:resource='urn:uuid:none'/><md:Model.colour>red</md:Model.colour></md:FullModel>"
    return f'<?xml version="1.0"?>\n<rdf:RDF {RDF_NS} xmlns:w="{NS}" xmlns:md="{cimxml.MD}"{more}><!-- c <w:Junk rdf:ID="_x"/> -->{head}\n{body}\n</rdf:RDF>'


@pytest.fixture(scope="module")
def vocabulary(spark):
    classes = [("Item", NS, None, False, 3, 1, 0, False), ("Device", NS, "Item", False, 3, 1, 0, False), ("Pump", NS, "Device", True, 3, 1, 1, False), ("Tank", NS, "Device", True, 3, 1, 1, False), ("Port", NS, "Item", True, 3, 1, 1, False), ("Place", NS, None, False, 3, 1, 0, False)]
    value = lambda name, owner, kind, mask, least=0: (name, NS, owner, "value", kind, None, least, 1, mask, False, "")
    attrs = [value("Item.label", "Item", "String", 1), value("Pump.head", "Pump", "Float", 1, 1), value("Pump.flow", "Pump", "Float", 1), value("Device.running", "Device", "Boolean", 2), value("Port.number", "Port", "Integer", 1)]
    attrs += [("Port.Device", NS, "Port", "ref", None, "Device", 0, 1, 1, False, ""), ("Port.side", NS, "Port", "enum", None, None, 0, 1, 1, False, "")]
    attrs += [("Device.place", NS, "Device", "compound", None, "Place", 0, 1, 1, False, ""), value("Place.street", "Place", "String", 1), value("Place.floor", "Place", "Integer", 1)]
    return Vocabulary.of(spark, classes, attrs, [(NS, "Side", "left")], [("PLAN", 0, PLAN, []), ("LIVE", 1, LIVE, [])])


A = document(PLAN, f"""
  <w:Pump rdf:ID="_{PUMP}"><w:Item.label>Wells &amp; Sons &lt;north&gt; &#233;&#x1F4A7;</w:Item.label><w:Pump.head>2,75</w:Pump.head><w:Pump.flow>plenty</w:Pump.flow>
    <w:Device.place rdf:parseType="Resource"><w:Place.street>High Row</w:Place.street><w:Place.floor>3</w:Place.floor></w:Device.place></w:Pump>
  <w:Tank rdf:ID='_{TANK}' w:note="1" /><w:Crane rdf:ID="_u"><w:Crane.arm>1</w:Crane.arm></w:Crane><other:Tank xmlns:other="http://example.org/other#" rdf:ID="_o"/>
  <w:Port lang="x" rdf:ID = "_{PORT}"><w:Port.number> 12.0 </w:Port.number><w:Port.Device rdf:resource="http://host/x#_{TANK.upper()}"/><w:Port.side rdf:resource="{NS}Side.left"/><w:Tank.depth>1</w:Tank.depth></w:Port>""")
B = document(LIVE, f'<w:Device rdf:about="#_{PUMP}"><w:Device.running>true</w:Device.running></w:Device>')


@pytest.fixture(scope="module")
def loaded(spark, vocabulary, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cim")
    (folder / "a_plan.xml").write_text(A, encoding="utf-8")
    (folder / "b_live.XML").write_text(B)
    return cimxml.read(cimxml.documents(spark, f"file://{folder}"), vocabulary)


def test_read_and_merge(loaded):
    model, heads, findings = loaded
    objects = {r.mrid: (r["class"], r.profiles) for r in model.objects.collect()}
    assert objects == {PUMP: ("Pump", 3), TANK: ("Tank", 1), PORT: ("Port", 1)}
    slots = {(r.mrid, r.attr): r for r in model.slots.collect()}
    assert slots[PUMP, "Item.label"].v_text == "Wells & Sons <north> é\U0001f4a7" and slots[PUMP, "Pump.head"].v_dbl == 2.75 and slots[PUMP, "Device.running"].v_bool is True
    assert slots[PUMP, "Device.place/Place.street"].v_text == "High Row" and slots[PUMP, "Device.place/Place.floor"].v_int == 3 and (PUMP, "Device.place") not in slots
    assert slots[PORT, "Port.number"].v_int == 12 and slots[PORT, "Port.Device"].v_ref == TANK and slots[PORT, "Port.side"].v_text == "Side.left"
    # a class of another namespace is unknown too
    assert sorted(r.rule for r in findings.collect()) == ["CIM0001", "CIM0001", "CIM0002", "CIM0003"]
    assert {r.profiles[0] for r in heads.collect()} == {PLAN, LIVE} and heads.count() == 2 and {r.extra[0].value for r in heads.collect()} == {"red"}
    assert model.dangling().count() == 0 and K.dependencies(heads).count() == 2 and K.headers(heads).count() == 0
    assert model.view("Device", {"head": ("Pump.head", "v_dbl"), "on": ("Device.running", "v_bool")}).where("head = 2.75 and on").count() == 1


def test_splits_and_odd_markup(spark, vocabulary, tmp_path):
    body = "".join(f'<w:Tank rdf:ID="_t{i}"><w:Item.label>tank {i} {"x" * (i % 50)}</w:Item.label></w:Tank>\n' for i in range(400))
    (tmp_path / "plain.xml").write_text(document(PLAN, body).replace('<!-- c <w:Junk rdf:ID="_x"/> -->', ""))
    odd = """<!-- 1 > 0 <w:Tank rdf:ID="_no"/> > --><w:Tank rdf:ID="_c"><w:Item.label><![CDATA[a > b <!-- kept --> &amp;]]> and c > d</w:Item.label></w:Tank><w:Tank w:say="x > y" rdf:ID="_q"/><w:Tank rdf:ID="_cut"><w:Item.label>"""
    (tmp_path / "odd.xml").write_text(document(PLAN, odd, more=' xmlns:late="x"').split("</w:Item.label>\n</rdf:RDF>")[0].removesuffix("\n</rdf:RDF>"))
    (tmp_path / "not.xml").write_text("<html><body>no</body></html>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = xmltokens.tokens(spark, f"file://{tmp_path}")
        assert found.where("file like '%plain.xml'").select("split").distinct().count() > 10
        model, _, findings = cimxml.read(cimxml.Documents.of(found), vocabulary)
        labels = {r.mrid: r.v_text for r in model.slots.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert labels == {f"t{i}": f"tank {i} {'x' * (i % 50)}" for i in range(400)} | {"c": "a > b <!-- kept --> &amp; and c > d"}
    assert {r.mrid for r in model.objects.collect()} == set(labels) | {"q"}
    assert [(r.rule, r.written) for r in findings.collect()] == [("CIM0022", "no rdf:RDF")]


def test_zip_entries_and_vintage(spark, vocabulary, tmp_path):
    with zipfile.ZipFile(tmp_path / "set.ZIP", "w") as z:
        z.writestr("1.xml", A)
        z.writestr("2.xml", b"\xff\xfe\x00bad")
        z.writestr("3.xml", B)
        z.writestr("notes.txt", "no")
    (tmp_path / "broken.zip").write_bytes(b"PK no")
    docs = cimxml.zipped(spark, f"file://{tmp_path}")
    model, heads, findings = cimxml.read(docs, vocabulary)
    assert heads.count() == 2 and {r.mrid for r in model.objects.collect()} == {PUMP, TANK, PORT}
    assert sorted(r.file.rsplit("/", 1)[1] for r in findings.where("rule = 'CIM0022'").collect()) == ["broken.zip", "set.ZIP!2.xml"]
    known = spark.createDataFrame([("old", "http://example.org/old#", 5), ("new", NS, 6)], "vintage string, ns string, classes long")
    assert {r.vintage for r in cimxml.vintages(docs, known).collect()} == {"new"} and cimxml.vintage_of_set(docs, known) == "new"
    assert cimxml.wrong_vintage(docs, known, "old").count() == 2 and cimxml.wrong_vintage(docs, known, "new").count() == 0


def test_findings_are_bounded(spark, vocabulary):
    body = "".join(f'<w:Crane rdf:ID="_{i}"/>' for i in range(20)) + "<w:Tank><w:Item.label>no name</w:Item.label></w:Tank><w:Port><w:Port.side rdf:resource='http://x#Side.left'/></w:Port><w:Port rdf:ID='_p'><w:Port.side rdf:resource='http://x#Side.top'/></w:Port>"
    docs = cimxml.in_content(spark.createDataFrame([("f", document(PLAN, body))], "file string, content string"))
    model, _, findings = cimxml.read(docs, vocabulary, check_literals=True, most_findings=5)
    assert [(r.rule, r.written) for r in findings.collect() if r.rule == "note"] == [("note", "19 more findings")] and findings.count() == 6
    assert {r.v_text for r in model.slots.collect()} == {"no name", "Side.left"} and model.objects.where("mrid like 'no-identifier-%'").count() == 2


def test_write_and_read_back(spark, vocabulary, loaded, tmp_path):
    model = loaded[0]
    for bit, profile, name in ((1, PLAN, "a"), (2, LIVE, "b")):
        head = document(profile, "").split("<md:FullModel", 1)[1].split("</md:FullModel>")[0]
        cimxml.write_profile(model, bit, f"file://{tmp_path}/{name}", f"<md:FullModel{head}</md:FullModel>", {"w": NS, "md": cimxml.MD}, "w")
        text = "\n".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
        (tmp_path / f"{name}.xml").write_text(text)
        assert ('rdf:ID="_' in text) == (bit == 1)
    back, _, findings = cimxml.read(cimxml.documents(spark, f"file://{tmp_path}", "[ab].xml"), vocabulary)
    assert D.statements(model, back).count() == 0 and findings.count() == 0


def test_difference(spark, vocabulary, loaded):
    model = loaded[0]
    other = model.with_(slots=model.slots.withColumn("v_dbl", F.when(F.col("attr") == "Pump.head", 9.5).otherwise(F.col("v_dbl"))).where("attr <> 'Port.side'"))
    found = D.statements(model, other)
    assert sorted((r.direction, r.attr, r.value) for r in found.collect()) == [("forward", "Pump.head", "9.5"), ("reverse", "Port.side", "Side.left"), ("reverse", "Pump.head", "2.75")]
    assert D.statements(D.apply(model, found), other).count() == 0
    text = f'<rdf:RDF {RDF_NS} xmlns:w="{NS}" xmlns:dm="{cimxml.DM}"><dm:DifferenceModel rdf:about="urn:uuid:1"><dm:reverseDifferences rdf:parseType="Statements"><rdf:Description rdf:about="#_{PUMP}"><w:Pump.head>2.750</w:Pump.head></rdf:Description></dm:reverseDifferences><dm:forwardDifferences rdf:parseType="Statements"><rdf:Description rdf:about="#_{PUMP}"><w:Pump.head>9.5</w:Pump.head></rdf:Description></dm:forwardDifferences></dm:DifferenceModel></rdf:RDF>'
    read = cimxml.read_statements(cimxml.in_content(spark.createDataFrame([("d", text)], "file string, content string")), vocabulary)
    done = D.apply(model, read)
    assert [r.v_dbl for r in done.values("Pump.head").collect()] == [9.5]


def test_rdf(loaded):
    found = rdf.triples(loaded[0], 2, NS)
    assert sorted(r.value for r in rdf.lines(found).collect()) == [f"<urn:uuid:{PUMP}> <{NS}Device.running> \"true\"^^<http://www.w3.org/2001/XMLSchema#boolean> .", f"<urn:uuid:{PUMP}> <{rdf.RDF_TYPE}> <{NS}Pump> ."]
    assert [r.value for r in rdf.turtle(found, NS, "w").collect()] == [f"<urn:uuid:{PUMP}> a w:Pump ;\n    w:Device.running \"true\"^^<http://www.w3.org/2001/XMLSchema#boolean> ."]


def test_vocabulary_from_rdfs(spark):
    about = lambda name, inner: f'<rdf:Description rdf:about="#{name}">{inner}</rdf:Description>'
    cls = '<rdf:type rdf:resource="http://www.w3.org/2000/01/rdf-schema#Class"/>'
    prop = '<rdf:type rdf:resource="http://www.w3.org/1999/02/22-rdf-syntax-ns#Property"/>'
    concrete = '<cims:stereotype rdf:resource="http://iec.ch/TC57/NonStandard/UML#concrete"/>'
    text = about("A", cls) + about("B", cls + concrete + '<rdfs:subClassOf rdf:resource="#A"/>') + about("B.r", prop + '<rdfs:domain rdf:resource="#B"/><cims:dataType rdf:resource="#Float"/><cims:multiplicity rdf:resource="http://x#M:1..1"/>')
    text += about("B.A", prop + '<rdfs:domain rdf:resource="#B"/><rdfs:range rdf:resource="#A"/><cims:multiplicity rdf:resource="http://x#M:0..n"/><cims:AssociationUsed>Yes</cims:AssociationUsed>')
    text = f'<rdf:RDF {RDF_NS} xmlns:rdfs="r#" xmlns:cims="c#">{text}</rdf:RDF>'
    v = rdfs.vocabulary(spark, spark.createDataFrame([(2, text)], "bit int, content string"), NS, [("X", 2, "http://x/1", [])])
    assert {(r["class"], r.parent, r.concrete, r.profiles) for r in v.classes.collect()} == {("A", None, False, 4), ("B", "A", True, 4)}
    assert {(r.attr, r.kind, r.primitive, r.target, r.least, r.most, r.used_in) for r in v.attrs.collect()} == {("B.r", "value", "Float", None, 1, 1, 4), ("B.A", "ref", None, "A", 0, None, 4)}


def test_stream_of_changes(spark, vocabulary, loaded, tmp_path):
    """Batches in the state store equal differences applied one after the other, and the log has what they changed alone."""
    model, at = loaded[0], f"file://{tmp_path}"
    many = spark.range(500).select(F.concat(F.lit("t"), "id").alias("mrid"), F.lit("Tank").alias("class"), F.lit(1).cast("long").alias("profiles"))
    labels = many.select("mrid", F.lit("Item.label").alias("attr"), F.lit(0).alias("ord"), F.lit("text").alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in (("v_bool", "boolean"), ("v_int", "long"), ("v_dbl", "double"))), F.col("mrid").alias("v_text"), F.lit(None).cast("string").alias("v_ref"), F.lit(None).cast("string").alias("lex"), F.lit(1).cast("long").alias("profiles"))
    model = model.with_(objects=model.objects.select("mrid", "class", "profiles").unionByName(many), slots=model.slots.unionByName(labels)).prune_empty()
    changes.save(model, f"{at}/store")
    batches = [
        [("reverse", 0, PUMP, None, False, "Item.label", "text", "Wells & Sons <north> é\U0001f4a7"), ("forward", 1, PUMP, None, False, "Item.label", "text", "new"), ("reverse", 2, PUMP, None, False, "Pump.head", "dbl", "2.75"), ("forward", 3, PUMP, None, False, "Pump.head", "dbl", "9.5")],
        [("forward", 0, "fresh", "Pump", True, "Pump.flow", "dbl", "1.5"), ("forward", 1, PUMP, "Tank", False, "Item.label", "text", "second"), ("reverse", 2, "t7", "Tank", False, "Item.label", "text", "t7"), ("reverse", 3, "t8", None, False, "Item.label", "text", "not there")],
        [("forward", 0, "t7", None, False, "Device.running", "bool", "true"), ("forward", 1, "fresh", "Pump", False, "mRID", "class", "Pump"), ("reverse", 2, "fresh", None, False, "Pump.flow", "dbl", "1.5")],
    ]
    want = model
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, changes.STATEMENTS).coalesce(1).write.parquet(f"{at}/in/{i}")
        want = D.apply(want, spark.createDataFrame(rows, changes.STATEMENTS))
        changes.apply_stream(spark, vocabulary, f"{at}/in/*", f"{at}/store", f"{at}/check").awaitTermination()
        got = changes.load(spark, vocabulary, f"{at}/store", i)
        shown = lambda m: (sorted((r.mrid, r["class"]) for r in m.objects.collect()), sorted(str((r.mrid, r.attr, r.ord, r.kind, r.v_bool, r.v_int, r.v_dbl, r.v_text, r.v_ref)) for r in m.slots.collect()))
        assert shown(got) == shown(want)
        assert spark.read.parquet(f"{at}/store/log/version={i}").select("mrid").distinct().count() == len({r[2] for r in rows})
    changes.compact(spark, vocabulary, f"{at}/store", 2, f"{at}/next")
    assert shown(changes.load(spark, vocabulary, f"{at}/next", -1)) == shown(want)


def test_rules_together_equal_rules_alone(spark, vocabulary, loaded):
    model = loaded[0]
    odd = [(PUMP, "Tank.depth", 0, "text", None, None, None, "x\x01y", None, None, 1), (TANK, "Item.label", 0, "int", None, 5, None, None, None, None, 1), (PORT, "Port.Device", 1, "ref", None, None, None, None, PORT, None, 1), (PORT, "Port.Device", 2, "ref", None, None, None, None, "nowhere", None, 1)]
    m = model.with_(slots=model.slots.unionByName(spark.createDataFrame(odd, model.slots.schema)), objects=model.objects.unionByName(spark.createDataFrame([("a b", "Device", 1), ("x", "Item", 1)], model.objects.schema)))
    options = K.Options()
    alone = [tuple(r) for rule in options.rules for r in rule(m).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, K.validate(m, options).collect()), key=key) == sorted(alone, key=key)
    assert {"CIM0002", "CIM0004", "CIM0006", "CIM0009", "CIM0011", "CIM0016", "CIM0019", "CIM0020"} <= {r[1] for r in alone}
    few = K.validate(m, K.Options(most=3)).collect()
    assert len(few) == 3 and {r.severity for r in few} == {"error"}
