"""The data source: headers read by their beginnings, archives by entry, one-file and archive writers, positions and compounds of any depth."""

import hashlib
import os
import re
import zipfile

import pytest
from pyspark.sql import functions as F
from voltmesh.operators import difference as D
from voltmesh.operators import rdf
from voltmesh.operators import validate as K
from voltmesh.operators.vocabulary import Vocabulary
from voltmesh.sources import cimxml, datasource, markup, store, xmltokens

from .test_documents import LIVE, NS, PLAN, PORT, PUMP, TANK, A, B, document, vocabulary  # noqa: F401  fixtures

LONG = "".join(f'<w:Tank rdf:ID="_t{i}"><w:Item.label>tank {i} {"long " * 60}</w:Item.label></w:Tank>\n' for i in range(3000))


@pytest.fixture(scope="module")
def stored(tmp_path_factory):
    folder = tmp_path_factory.mktemp("set")
    (folder / "a.xml").write_text(A, encoding="utf-8")
    (folder / "long.XML").write_text(document(PLAN, LONG, "88888888-0000-4000-8000-000000000000"))
    (folder / "not.xml").write_text("<html/>")
    latin = document(LIVE, "").replace('version="1.0"', 'version="1.0" encoding="ISO-8859-1"').replace("noon", "d\xe9j\xe0")
    (folder / "latin.xml").write_bytes(latin.encode("latin-1"))
    with zipfile.ZipFile(folder / "two.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("n/b.xml", B)
        z.writestr("long.xml", document(PLAN, LONG))
    return f"file://{folder}"


def test_headers_are_read_by_their_beginnings(spark, stored):
    heads = {r.file.rsplit("/", 1)[1]: r for r in cimxml.peek_headers(spark, stored).collect()}
    assert heads.keys() == {"a.xml", "long.XML", "not.xml", "latin.xml", "b.xml", "two.zip!long.xml"}
    assert heads["long.XML"].size > 1_000_000 and heads["long.XML"].bytes_read <= 16_384 and heads["two.zip!long.xml"].bytes_read <= 16_384
    assert heads["not.xml"].problem == "no rdf:RDF" and heads["latin.xml"].scenario_time == "d\xe9j\xe0" and heads["latin.xml"].profiles == [LIVE]
    known = {"file", "id", "kind", "created", "scenario_time", "version", "description", "authority", "profiles", "depends_on", "supersedes", "extra"}
    whole = {r.file.rsplit("/", 1)[1]: r for r in cimxml.headers_of(cimxml.documents(spark, stored, "a.xml")).collect()}["a.xml"]
    assert all(whole[c] == heads["a.xml"][c] for c in known - {"file"})
    assert {r.file.rsplit("/", 1)[1] for r in cimxml.peek_headers(spark, stored, "*/a.xml").collect()} == {"a.xml"}


def test_vintage_from_beginnings(spark, stored):
    known = spark.createDataFrame([("old", "http://example.org/old#", 5), ("new", NS, 6)], "vintage string, ns string, classes int")
    seen = cimxml.peek_namespaces(spark, stored, (NS,))
    assert cimxml.peek_vintage(spark, stored, known) == "new" and seen.agg(F.max("bytes_read")).first()[0] <= 16_384


def test_open_whatever_is_there(spark, stored, vocabulary):  # noqa: F811
    model, heads, findings = cimxml.opened(spark, stored, {"new": vocabulary})
    assert model.objects.count() == 3003 and heads.count() == 5 and model.objects.where(F.col("mrid") == PUMP).first().profiles == 3
    assert [r.file.rsplit("/", 1)[1] for r in findings.where("rule = 'CIM0022'").collect()] == ["not.xml"]
    with pytest.raises(ValueError, match="names a known vocabulary"):
        cimxml.opened(spark, stored, {"other": Vocabulary.of(spark, [("X", "http://x#", None, True, 1, 1, 1, False)], [])})


def test_pushed_conditions(spark, stored):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = lambda: datasource.scan(spark, stored, "headers", push="true")
        assert read().where(F.col("file").endswith("a.xml")).count() == 1 and read().where(F.col("file").contains("zip!")).count() == 2
        assert read().where(F.col("file") == f"{stored}/a.xml").count() == 1 and read().where(F.col("file").isin(f"{stored}/a.xml", f"{stored}/long.XML")).count() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_large_archive_with_a_bad_entry(spark, tmp_path, vocabulary):  # noqa: F811
    path = tmp_path / "large.zip"
    with open(path, "wb") as f:
        f.truncate(2_300_000_000)  # a hole before the archive
    with zipfile.ZipFile(path, "a", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.xml", A)
        z.writestr("b.xml", B)
        z.writestr("c.xml", document(PLAN, '<w:Tank rdf:ID="_c"/>' * 3000))
        z.writestr("stored.xml", document(PLAN, '<w:Tank rdf:ID="_s"/>'), zipfile.ZIP_STORED)
    bad = {e.name: e for e in store.entries(str(path))}["c.xml"]
    with open(path, "r+b") as f:
        f.seek(bad.offset + 30 + 5 + bad.packed - 12)
        f.write(b"\xff" * 8)
    docs = cimxml.zipped(spark, f"file://{tmp_path}")
    model, heads, findings = cimxml.read(docs, vocabulary)
    assert {r.mrid for r in model.objects.collect()} == {PUMP, TANK, PORT, "s"} and heads.count() == 3
    assert [r.file.rsplit("!", 1)[1] for r in findings.where("rule = 'CIM0022'").collect()] == ["c.xml"]


def test_ranges_and_streams_give_the_same_tokens(spark, stored):
    plain = [r.value for r in datasource.scan(spark, f"{stored}/long.XML", splitBytes=3000, chunkBytes=700).where("value is not null").orderBy("split", "at").collect()]
    streamed = [r.value for r in datasource.scan(spark, f"{stored}/long.XML", chunkBytes=501).orderBy("split", "at").collect()]
    text = document(PLAN, LONG, "88888888-0000-4000-8000-000000000000")
    assert "".join(streamed) == text and "".join(plain) == text
    odd = "a<b <!-- > --> <x y='>'/> &lt; <![CDATA[ ]] > ]]> <? ?> < <z"
    for n in (1, 2, 3, 7, 100):
        assert list(markup.tokens([odd[i : i + n] for i in range(0, len(odd), n)])) == list(markup.tokens([odd])) and "".join(markup.tokens([odd])) == odd


@pytest.mark.parametrize("zipped", [False, True])
def test_files_and_archives_of_profiles(spark, tmp_path, stored, vocabulary, zipped):  # noqa: F811
    model = cimxml.read(cimxml.folder(spark, stored), vocabulary)[0]
    model = model.with_(objects=model.objects.repartition(5))
    target = f"file://{tmp_path}/out" + (".zip" if zipped else "")
    written = cimxml.save_files(model, target, "model", {NS: "w"}, zipped=zipped)
    assert len(written) == (1 if zipped else 2) and all(os.path.exists(w.removeprefix("file://")) for w in written)
    if zipped:
        with zipfile.ZipFile(tmp_path / "out.zip") as z:
            assert z.testzip() is None and z.namelist() == ["model_LIVE.xml", "model_PLAN.xml"]
    assert not any(n.endswith("parts") or n.startswith("_") for n in os.listdir(tmp_path))
    back, heads, findings = cimxml.read(cimxml.folder(spark, target), vocabulary)
    assert D.statements(model, back).count() == 0 and findings.count() == 0 and {h.profiles[0] for h in heads.collect()} == {PLAN, LIVE}
    assert cimxml.content_id(back) == cimxml.content_id(model)


def test_save_as_loaded(spark, tmp_path, vocabulary):  # noqa: F811
    os.makedirs(tmp_path / "in")
    with zipfile.ZipFile(tmp_path / "in" / "a.zip", "w") as z:
        z.writestr("north/eq.xml", A)
        z.writestr("south/eq.xml", document(PLAN, f'<w:Tank rdf:about="#_{TANK}"/><w:Tank rdf:ID="_alone"/>', "99999999-0000-4000-8000-000000000000"))
        z.writestr("live.xml", B)
        z.writestr("change.xml", document("http://example.org/profiles/Unknown/1.0", ""))
    docs = cimxml.folder(spark, f"file://{tmp_path}/in")
    model, heads, _ = cimxml.read(docs, vocabulary)
    written, skipped, unwritten = cimxml.save_as_loaded(model, docs, heads, f"file://{tmp_path}/out", {NS: "w"})
    assert sorted(w.rsplit("/", 1)[1] for w in written) == ["eq.xml", "eq_2.xml", "live.xml"] and unwritten.count() == 0
    assert [r.file.rsplit("!", 1)[1] for r in skipped.collect()] == ["change.xml"]
    again = cimxml.folder(spark, f"file://{tmp_path}/out")
    back, heads_again, findings = cimxml.read(again, vocabulary)
    assert D.statements(model, back).count() == 0 and findings.count() == 0
    columns = [c for c in heads.columns if c not in ("file", "file_seq")]
    shown = lambda h: sorted(str([r[c] for c in columns]) for r in h.where("profiles[0] not like '%Unknown%'").collect())
    assert shown(heads) == shown(heads_again)
    members = lambda m, d: sorted(r.mrid for r in m.members.join(d.files, "file_seq").collect())
    assert members(back, again) == members(model, docs) == sorted([PUMP, TANK, PORT, TANK, "alone", PUMP])


def test_names_stay_apart(spark):
    wanted = [("1", "a/EQ.xml"), ("2", "b\\EQ.xml"), ("3", "EQ_2.xml"), ("4", "../.."), ("5", ""), ("6", "EQ.xml"), ("7", "none")]
    got = {r.file: r.output for r in cimxml.safe_names(spark.createDataFrame(wanted, "file string, name string")).collect()}
    assert got["1"] == "EQ.xml" and got["3"] == "EQ_2.xml" and got["7"] == "none" and len(set(got.values())) == 7 and not any("/" in v or ".." in v for v in got.values())


def test_header_sources(spark, tmp_path, vocabulary):  # noqa: F811
    model = cimxml.read(cimxml.in_content(spark.createDataFrame([("f", B)], "file string, content string")), vocabulary)[0]
    for headers, n in ((cimxml.OMIT, 0), (cimxml.DERIVE, 1), ({"LIVE": "<md:FullModel rdf:about='urn:uuid:1'/>"}, 1)):
        path = f"file://{tmp_path}/{n}{len(headers)}"
        cimxml.save_files(model, path, "m", headers=headers)
        assert cimxml.headers_of(cimxml.folder(spark, path)).count() == n


def test_positions(spark, tmp_path, vocabulary):  # noqa: F811
    body = "".join(f'{" " * (i % 7)}<w:Crane rdf:ID="_{i}"/>{chr(10) * (i % 3)}<w:Tank rdf:ID="_t{i}">\r\n  é <w:Tank.depth>{"x" * (i % 40)}</w:Tank.depth></w:Tank>' for i in range(300))
    text = document(PLAN, body)
    (tmp_path / "plain.xml").write_bytes(text.encode())
    (tmp_path / "odd.xml").write_bytes(text.replace("<!-- c ", "<!-- > c ").encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        docs = cimxml.documents(spark, f"file://{tmp_path}")
        found = cimxml.located(cimxml.read(docs, vocabulary)[2], docs).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = set()
    for name, content in (("plain.xml", text), ("odd.xml", text.replace("<!-- c ", "<!-- > c "))):
        data = content.encode()
        for tag, rule in ((b"<w:Crane ", "CIM0001"), (b"<w:Tank.depth>", "CIM0002")):
            at = data.find(tag)
            while at >= 0:
                want.add((name, rule, data[:at].count(b"\n") + 1, at - (data.rfind(b"\n", 0, at) + 1) + 1))
                at = data.find(tag, at + 1)
    assert {(r.file.rsplit("/", 1)[1], r.rule, r.line, r.col) for r in found} == want and len(found) == 1200


@pytest.fixture(scope="module")
def deep(spark, vocabulary):  # noqa: F811
    value = lambda name, owner, kind: (name, NS, owner, "value", kind, None, 0, 1, 1, False, "")
    compound = lambda name, owner, target: (name, NS, owner, "compound", None, target, 0, 1, 1, False, "")
    classes = [(c, NS, None, False, 3, 1, 0, False) for c in ("Address", "Town", "Point")]
    attrs = [compound("Pump.site", "Pump", "Address"), compound("Address.town", "Address", "Town"), compound("Address.mail", "Address", "Town"), compound("Town.at", "Town", "Point"), value("Town.name", "Town", "String"), value("Point.x", "Point", "Float"), value("Point.note", "Point", "String"), ("Point.side", NS, "Point", "enum", None, "Side", 0, 1, 1, False, "")]
    v = vocabulary
    return Vocabulary(v.classes.unionByName(spark.createDataFrame(classes, v.classes.schema)), v.attrs.unionByName(spark.createDataFrame(attrs, v.attrs.schema)), v.literals, v.profiles, v.inverses)


DEEP = document(PLAN, f"""<w:Pump rdf:ID="_{PUMP}"><w:Pump.head>1</w:Pump.head><w:Pump.site rdf:parseType="Resource"><w:Address.town><w:Town rdf:ID="_in"><w:Town.name>one</w:Town.name>
  <w:Town.at rdf:parseType="Resource"><w:Point.x>2,50</w:Point.x><w:Point.note>n &amp; m</w:Point.note></w:Town.at></w:Town></w:Address.town>
  <w:Address.mail rdf:parseType="Resource"><w:Town.name>two</w:Town.name></w:Address.mail></w:Pump.site></w:Pump>""")
PATHS = {"Pump.head": 1.0, "Pump.site/Address.town/Town.name": "one", "Pump.site/Address.town/Town.at/Point.x": 2.5, "Pump.site/Address.town/Town.at/Point.note": "n & m", "Pump.site/Address.mail/Town.name": "two"}


def test_deep_compounds(spark, tmp_path, deep):
    model, _, findings = cimxml.read(cimxml.in_content(spark.createDataFrame([("f", DEEP)], "file string, content string")), deep)
    slots = lambda m: {r.attr: r.v_text if r.v_dbl is None else r.v_dbl for r in m.slots.collect()}
    assert slots(model) == PATHS and findings.count() == 0 and [r.v_dbl for r in model.field("Pump.site", "Address.town", "Town.at", "Point.x").collect()] == [2.5]
    shown = {r.attr: r.text for r in model.display().collect()}
    assert shown == {"Pump.head": "1", "Pump.site": "{Address.mail={Town.name=two}, Address.town={Town.at={Point.note=n & m, Point.x=2,50}, Town.name=one}}"}
    cimxml.save_files(model, f"file://{tmp_path}/w", "deep", {NS: "w"})
    assert slots(cimxml.read(cimxml.folder(spark, f"file://{tmp_path}/w"), deep)[0]) == PATHS
    lines = [r.value for r in rdf.lines(rdf.triples(model, 1, NS)).collect()]
    node = lambda predicate: {(line.split()[0], line.split()[2]) for line in lines if f"<{NS}{predicate}>" in line and "rdf-syntax-ns#type" not in line}
    (_, site), (_, town), (_, at) = node("Pump.site").pop(), node("Address.town").pop(), node("Town.at").pop()
    assert node("Address.town") == {(site, town)} and node("Town.at") == {(town, at)} and {s for s, _ in node("Point.x")} == {at} and len({x for x, _ in node("Town.name")}) == 2
    types = {line.split()[0]: line.split()[2] for line in lines if "rdf-syntax-ns#type" in line}
    assert types[at] == f"<{NS}Point>" and types[town] == f"<{NS}Town>" and types[site] == f"<{NS}Address>"


def test_rules_in_deep_compounds(spark, deep):
    at = "Pump.site/Address.town/Town.at"
    rows = [
        (PUMP, f"{at}/Point.note", 0, "text", None, None, None, "x\x01y", None, None, 1),
        (PUMP, f"{at}/Point.x", 0, "text", None, None, None, "two", None, None, 1),
        (PUMP, f"{at}/Point.side", 0, "enum", None, None, None, "Colour.red", None, None, 1),
        (PUMP, f"{at}/Town.name", 0, "text", None, None, None, "no field of a point", None, None, 1),
        (PUMP, "Pump.site/Town.at/Point.note", 0, "text", None, None, None, "no field of an address", None, None, 1),
        (PUMP, "Item.label/Point.note", 0, "text", None, None, None, "in what is no compound", None, None, 1),
        (TANK, "Pump.site/Address.mail/Town.name", 0, "text", None, None, None, "a tank has no site", None, None, 1),
        (PUMP, "Pump.site", 0, "text", None, None, None, "flat", None, None, 1),
    ]
    from voltmesh.operators.model import SLOTS, Model

    m = Model(deep, spark.createDataFrame([(PUMP, "Pump", 1), (TANK, "Tank", 1)], "mrid string, class string, profiles long"), spark.createDataFrame(rows, SLOTS))
    rules = (K.class_membership, K.datatype, K.illegal_character)
    want = {
        ("CIM0019", PUMP, f"{at}/Point.note", "at byte 1"),
        ("CIM0016", PUMP, f"{at}/Point.x", "text for Float"),
        ("CIM0016", PUMP, f"{at}/Point.side", "Colour.red for Side"),
        ("CIM0002", PUMP, f"{at}/Town.name", "Point has no Town.name"),
        ("CIM0002", PUMP, "Pump.site/Town.at", "Address has no Town.at"),
        ("CIM0016", PUMP, "Item.label", "compound for String"),
        ("CIM0002", PUMP, "Item.label/Point.note", "Item.label has no Point.note"),
        ("CIM0002", TANK, "Pump.site/Address.mail/Town.name", "Tank has no Pump.site"),
        ("CIM0016", PUMP, "Pump.site", "text for compound"),
    }
    shown = lambda found: {(r.rule, r.mrid, r.attr, r.message) for r in found.collect()}
    assert shown(K.validate(m, K.Options(rules=rules))) == want and set().union(*(shown(rule(m)) for rule in rules)) == want


def test_too_deep_is_reported(spark, monkeypatch, deep):
    monkeypatch.setattr(xmltokens, "MOST_LEVELS", 4)
    model, _, findings = cimxml.read(cimxml.in_content(spark.createDataFrame([("f", DEEP)], "file string, content string")), deep)
    assert {r.written for r in findings.where("rule = 'CIM0015'").collect()} == {"more than 4 levels"} and findings.count() == 4 and "Pump.head" in {r.attr for r in model.slots.collect()}


def test_blocks_are_tokens():
    """Blocks hold the tokens of the stream, whatever stands in comments, quotes or broken ends, and wherever chunks end."""
    plain = re.compile(markup.PLAIN)
    for doc in ("<a>t</a><b x=\"1>2\"/> <!-- c > -->x<![CDATA[ > ]]><c/>", "a < b <c>d</c", "<a b='<'><?p > ?><>", "<a><b c=\"never closed> <d/>", "<!DOCTYPE x><a/>tail", ""):
        for size in (1, 3, 100):
            chunks = [doc[i : i + size] for i in range(0, len(doc), size)]
            cut = [t for run, text in markup.blocks(chunks) for t in (plain.findall(text) if run else [text])]
            assert cut == list(markup.tokens(chunks)) and "".join(cut) == doc


def test_one_large_document_is_cut_by_many_tasks(spark, tmp_path):
    """A document is one stream, but its tags are cut by a task for each split or so; nothing is lost or doubled."""
    n = 150_000
    (tmp_path / "large.xml").write_text("<rdf:RDF>" + "".join(f"<e><p>{i} padding of a text to make the file as large as two tasks' share</p></e>" for i in range(n)) + "</rdf:RDF>")
    found = xmltokens.of_blocks(datasource.blocks(spark, str(tmp_path)))
    parts = found.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in parts) == 4 * n + 2 and len(parts) > 1
    assert found.select("file", "split", "at").distinct().count() == 4 * n + 2
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "at", "value"))), lambda x: x["value"]), "")
    assert found.agg(F.md5(text).alias("h")).first().h == hashlib.md5((tmp_path / "large.xml").read_bytes()).hexdigest()


@pytest.mark.parametrize("way", ["documents", "elements"])
def test_elements_are_rendered_once(spark, tmp_path, way):
    """Dealing in ranges takes a sample of its rows first; what is written isn't made a second time for that."""
    made = spark.sparkContext.accumulator(0)

    def element(n):
        made.add(1)
        return f"<e>{n}</e>"

    rows = spark.range(100).select(F.lit("d.xml").alias("document"), F.format_string("x%03d", "id").alias("mrid"), F.udf(element, "string")("id").alias("element"))
    if way == "documents":
        cimxml.write_documents(rows, spark.createDataFrame([("d.xml", None)], "document string, header string"), str(tmp_path / "out"), {})
    else:
        cimxml.write_elements(rows, str(tmp_path / "out"), "", {})
    assert made.value == 100
    text = "".join(sorted(r.value for r in spark.read.text(str(tmp_path / "out")).where("value like '<e>%'").collect()))
    assert text == "".join(sorted(f"<e>{n}</e>" for n in range(100)))
