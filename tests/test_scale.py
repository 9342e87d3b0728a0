"""Faults that show on larger tables only: what is broadcast, and how much of a table one task holds."""

import re

from voltmesh.operators import validate as K
from voltmesh.plans import star
from voltmesh.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_model_sized_joins_are_not_broadcast(spark):
    """Compressed key columns look small to Spark: 2 million objects or 8 million values were broadcast through the driver."""
    for found in (K.validate(star.model(spark, SF, ("customer", "part"))), QUERIES["severity_counts"](spark, SF), QUERIES["report_summary"](spark, SF), QUERIES["put_values"](spark, SF), QUERIES["follow_nation"](spark, SF)):
        assert not re.search(r"BroadcastHashJoin \[(mrid|target)#", plan(found)) and "SortMergeJoin" in plan(found)


def test_many_values_are_asserted_whole(spark):
    """Applying a difference to orders with many parts gives the target's values, as often as they stand there."""
    from voltmesh.operators import difference as D
    from voltmesh.plans.registry import _many_valued

    base, target = _many_valued(spark, SF)
    done = D.apply(base, D.statements(base, target))
    count = lambda m: sorted((r.mrid, r.v_ref, r["count"]) for r in m.slots.groupBy("mrid", "v_ref").count().collect())
    assert count(done) == count(target)


def test_splits_that_move_between_readings(spark, tmp_path):
    """Splits follow from the cores that are there when a file is read: if they change while a document is read, no tag is lost."""
    from voltmesh.sources import cimxml
    from voltmesh.sources import xmltokens as T

    (tmp_path / "doc").mkdir()
    body = "".join(f'<s:Region rdf:about="region:{i}"><s:Thing.name>name {i}</s:Thing.name></s:Region>\n' for i in range(4000))
    (tmp_path / "doc" / "part-00000-x.txt").write_text(f'<rdf:RDF xmlns:rdf="{T.RDF}" xmlns:s="{star.NS}">\n{body}</rdf:RDF>\n')
    settle, size = T.cut, "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)

    def moved(df):
        out = settle(df)
        spark.conf.set(size, "30000")
        return out

    try:
        spark.conf.set(size, "100000")
        T.cut = moved
        m = cimxml.read(cimxml.parts(spark, str(tmp_path)), star.vocabulary(spark))[0]
        assert m.objects.count() == 4000 and m.slots.count() == 4000
    finally:
        T.cut = settle
        spark.conf.set(size, before)


def test_beam_search_holds_little():
    """Searching the lists of many queries holds a block of vectors, not 500 rows' neighbours' (half a GB for a beam of 64)."""
    import tracemalloc

    import numpy as np
    from voltmesh.llm import posting_lists as L

    rng = np.random.default_rng(3)
    shared, x = L.Centroids(rng.normal(size=(2000, 64))), rng.normal(size=(512, 64))
    tracemalloc.start()
    try:
        found, dist = shared.near(x, 64)
        assert tracemalloc.get_traced_memory()[1] < 100e6
    finally:
        tracemalloc.stop()
    whole = L.beam_search(x, shared.c, shared.graph, 64, shared.entries)
    assert (found == whole[0]).all() and np.allclose(dist, whole[1])


def test_lists_that_no_query_reads(spark):
    """On large tables some lists are read by no query: an empty answer failed to become an array of structs."""
    from voltmesh.llm import posting_lists as L

    rows = [(i, [float(i // 20 * 1000 + 1), float(i % 20)]) for i in range(400)]
    found = L.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3, query_every=400, per_list=20, copies=1, least_lists=1, prune=1.0).collect()
    assert sorted((r["rank"], r.vec_id) for r in found) == [(1, 1), (2, 2), (3, 3)]


def _saved(spark):
    from voltmesh.plans.documents import saved
    from voltmesh.sources import cimxml

    return cimxml.parts(spark, saved(spark, SF)[1])


def test_text_is_made_by_all_tasks(spark):
    """A table in one small file is read by one task, which made the text of all of its elements (61 s of one task at 60 times sf0.1)."""
    from voltmesh.sources import cimxml

    for found in (cimxml.whole(star.model(spark, SF, ("customer",)), "s"), cimxml.rendered(star.model(spark, SF, ("customer",)), 2, "s")):
        text = plan(found)
        assert "ArrowEvalPython" in text and re.search(r"ArrowEvalPython.*REPARTITION_BY_COL", text, re.S)


def test_closed_elements_are_not_joined_by_sorting(spark):
    """Whoever asked for nodes, headers or values sorted and joined all nodes with all elements, to leave out one that is cut off."""
    docs = _saved(spark)
    assert "SortMergeJoin" not in plan(docs.nodes) and docs.levels == 2


def test_cut_off_and_closed(spark):
    """An element that is cut off goes with all that is in it; those before it stay, and so does the other document."""
    from voltmesh.sources import cimxml
    from voltmesh.sources import xmltokens as T

    start = f'<rdf:RDF xmlns:rdf="{T.RDF}" xmlns:s="{star.NS}">'
    one = '<s:Region rdf:about="region:{0}"><s:Thing.name>n{0}</s:Thing.name></s:Region>'
    texts = [("a.xml", start + one.format(1) + '<s:Region rdf:about="region:2"><s:Thing.name>n2</s:Thing.name>'), ("b.xml", start + one.format(3) + "</rdf:RDF>")]
    m = cimxml.read(cimxml.in_content(spark.createDataFrame(texts, "file string, content string")), star.vocabulary(spark))[0]
    assert sorted(r.mrid for r in m.objects.collect()) == ["region:1", "region:3"] == sorted(r.mrid for r in m.slots.collect())


def test_places_are_found_by_split(spark):
    """All tags of a file met in one task to be numbered: 470 MB of it at 20 times sf0.1."""
    from voltmesh.sources import xmltokens as T

    rows = spark.createDataFrame([("a.xml", i, i, "\n", "<a>") for i in range(8)], "file string, split long, at long, text string, tag string")
    found = T.places(rows, rows.select("file"))
    assert "BroadcastHashJoin [file#" in plan(found) and not re.search(r"SortMergeJoin \[file#\d+L?\], \[file#\d+L?\], LeftSemi", plan(found))
    assert sorted((r.pos.split, r.line, r.col) for r in found.collect()) == [(i, i + 2, 1) for i in range(8)]


def test_triples_compile(spark):
    """Terms are made by compiled code: a step whose code is too large runs many times slower, and Spark says so only in its log."""
    from pyspark.sql import functions as F

    from voltmesh.functions import rdfterms as R

    fallback = "spark.sql.codegen.fallback"
    before = spark.conf.get(fallback)
    spark.conf.set(fallback, "false")
    try:
        found = QUERIES["deep_triples"](spark, SF)
        assert found.count() == 9 * spark.read.parquet(f"{SF}/customer.parquet").count()
        # no filter on a subject is repeated where tables are read
        assert not re.search(r"Filter .*RLIKE", plan(found))
    finally:
        spark.conf.set(fallback, before)
    odd = "".join(map(chr, range(0x21))) + '<>"{}|^`\\'
    text = f"a{odd}é\U0001d11e-{odd}\\u0041"
    want = "".join(f"\\u{ord(c):04X}" if c in odd else c for c in text)
    rows = spark.createDataFrame([(text,), ("plain/\U0001d11e",), ("",), (None,)], "x string").select("x", R.escape_iri(F.col("x")).alias("y")).collect()
    assert [r.y for r in rows] == [want, "plain/\U0001d11e", "", None]


def test_checking_a_difference_reads_the_values_once(spark):
    """Findings of a difference need the values of the objects it names: all others are read once, to tell them apart."""
    from voltmesh.operators import difference as D
    from voltmesh.plans.sources import _statements

    m = star.model(spark, SF, ("orders",))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    watched = m.with_(slots=m.slots.mapInArrow(counted, m.slots.schema))
    found, _ = D.resolve(_statements(spark, SF), m)
    findings = D.apply_checked(watched, found)[1]
    assert findings.where("message like '% was dropped with the class'").count() > 0
    assert seen.value == m.slots.count()
