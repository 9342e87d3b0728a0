"""XML documents as rows, one for each tag, and as nodes with their texts.

Spark's text source cuts files at every ``>``, so a large document is read by many tasks: a row is a tag and the text
before it. Depth, and the element that a row belongs to, are running sums and running last values in two steps, inside a split and over the
splits of a file. Files where a ``>`` stands inside a comment, CDATA or attribute, and entries of zip archives, are cut by their markup as a stream
(``datasource``), a chunk at a time; where a store can be read by Spark only, they are cut whole by one regular expression.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import xmltext as X
from ..functions.shared import cut, wide
from . import datasource
from .markup import PLAIN

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
COMPLETE = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>"
OPEN = r"(?s)<!--|<!\[CDATA\[|<\?|<[^<>\"'!?][^<>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^<>\"']*)*(?:\"[^\"]*|'[^']*)$"
TOKEN = r"(?s)[^<]*+(?:<!--.*?(?:-->|\z)|<!\[CDATA\[.*?(?:\]\]>|\z)|<\?.*?(?:\?>|\z)|<[^<>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^<>\"']*+)*+(?:>|\z)|<|\z)"
#: The most levels that are read: elements, properties, and fields inside them. What is deeper is reported.
MOST_LEVELS = 32


def listed(spark: SparkSession, path: str, glob: str = "*.[xX][mM][lL]"):
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)


def tokens(spark: SparkSession, path: str, glob: str = "*.[xX][mM][lL]") -> DataFrame:
    """file, split, at (in order within a split) and value of every tag with the text before it."""
    read = listed(spark, path, glob).option("lineSep", ">").text(path)
    rows = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.concat("value", F.lit(">")).alias("value"))
    odd = [r.file for r in rows.where(F.regexp_replace("value", COMPLETE, "").rlike(OPEN)).select("file").distinct().collect()]  # names of files
    if not odd:
        return rows
    plain = rows.where(~F.col("file").isin(odd))
    if datasource.S.reachable(odd[0]):
        return plain.unionByName(of_blocks(datasource.blocks(spark, path, files=json.dumps(odd))))
    whole = spark.read.text(odd, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
    return plain.unionByName(cut_whole(whole))


def part_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The same of documents that were written as part files: a folder is a document, its parts in name order."""
    read = listed(spark, path, "part-*").option("lineSep", ">").text(path)
    name = F.col("_metadata.file_path")
    part = F.regexp_extract(name, r"part-(\d+)-[^/]*$", 1).cast("long")
    return read.select(F.regexp_extract(name, r"^(.*)/[^/]*$", 1).alias("file"), (F.shiftleft(part, 40) + F.col("_metadata.file_block_start")).alias("split"), F.monotonically_increasing_id().alias("at"), F.concat("value", F.lit(">")).alias("value"))


def of_blocks(blocks: DataFrame) -> DataFrame:
    """The same rows from the data source's blocks; a token is no shorter than a character, so places by characters leave room for all."""
    each = F.when(F.col("plain"), F.regexp_extract_all("value", F.lit(PLAIN), 0)).otherwise(F.array("value"))
    return blocks.where("value is not null").select("file", "split", F.col("at").alias("_from"), F.posexplode(each).alias("_n", "value")).select("file", "split", (F.col("_from") + F.col("_n")).alias("at"), "value")


def cut_whole(docs: DataFrame) -> DataFrame:
    """The same rows from file and content."""
    return docs.select("file", F.lit(0).cast("long").alias("split"), F.posexplode(F.regexp_extract_all("content", F.lit(TOKEN), 0)).alias("at", "value")).select("file", "split", F.col("at").cast("long").alias("at"), "value").where("value <> ''")


def zip_entries(spark: SparkSession, path: str) -> DataFrame:
    """file (archive!entry), content and problem of the XML entries of zip archives, each entry on its own; an entry or archive that can't be read has a problem."""
    import pyarrow as pa

    def entries(batches):
        import io
        import zipfile

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(data.as_py())) as z:
                        for entry in sorted(n for n in z.namelist() if n.lower().endswith(".xml")):
                            try:
                                rows.append((f"{name}!{entry}", z.read(entry).decode("utf-8"), None))
                            except (UnicodeDecodeError, zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError) as e:
                                rows.append((f"{name}!{entry}", None, type(e).__name__))
                except (zipfile.BadZipFile, OSError) as e:
                    rows.append((name, None, type(e).__name__))
                for row in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in row], names=["file", "content", "problem"])

    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.[zZ][iI][pP]").option("recursiveFileLookup", True).load(path)
    return archives.select("path", "content").mapInArrow(entries, "file string, content string, problem string")


def attribute(tag: Column, local: str) -> Column:
    """An attribute's value by its local name; null without one."""
    quoted = F.regexp_extract(tag, rf"(?s)\s(?:[\w.-]+:)?{local}\s*=\s*(\"[^\"]*\"|'[^']*')", 1)
    return F.when(tag.contains(local) & (quoted != ""), X.unescape(F.substring(quoted, F.lit(2), F.length(quoted) - 2)))


def namespaces(leveled: DataFrame) -> DataFrame:
    """file and a map of its prefixes ("" for the default one), wherever declared; the first declaration of a prefix counts."""
    pattern = r"(?s)\sxmlns(?::([\w.-]+))?\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    each = leveled.where(F.col("tag").contains("xmlns")).select("file", F.struct("split", "at").alias("pos"), F.explode(F.regexp_extract_all("tag", F.lit(pattern), 0)).alias("d"))
    named = each.select("file", "pos", F.regexp_extract("d", pattern, 1).alias("prefix"), F.concat(F.regexp_extract("d", pattern, 2), F.regexp_extract("d", pattern, 3)).alias("ns"))
    first = named.groupBy("file", "prefix").agg(F.min_by("ns", "pos").alias("ns"))
    return first.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("prefix", "ns"))).alias("prefixes"))


def leveled(found: DataFrame) -> DataFrame:
    """``tokens`` with text, tag, kind (open, empty, close, cdata, other, text), name and ``depth``, how many elements are open before the tag.

    The tags are read once and settled: where splits begin follows from the cores that are there when a file is read, so two readings may number them differently.
    """
    text = F.substring_index("value", "<", 1)
    rows = found.withColumn("text", text).withColumn("tag", F.expr("substring(value, length(text) + 1)")).drop("value")
    tag = F.col("tag")
    kind = F.when(tag == "", "text").when(tag.startswith("<![CDATA["), "cdata").when(tag.startswith("<!") | tag.startswith("<?"), "other").when(tag.startswith("</"), "close").when(tag.endswith("/>") | (tag.contains("/") & tag.rlike(r"/\s*>$")), "empty").otherwise("open")
    rows = rows.withColumn("kind", kind).withColumn("name", F.when(F.col("kind").isin("open", "empty", "close"), F.regexp_extract("tag", r"^</?([^\s/>]+)", 1)))
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    here = Window.partitionBy("file", "split").orderBy("at")
    rows = cut(rows.withColumn("inside", F.sum(step).over(here) - step))
    sums = cut(rows.groupBy("file", "split").agg(F.sum(step).alias("n")))
    before = sums.select("file", "split", (F.sum("n").over(Window.partitionBy("file").orderBy("split")) - F.col("n")).alias("before"))
    return rows.join(near(before, sums.count()), ["file", "split"]).withColumn("depth", (F.col("before") + F.col("inside")).cast("int")).drop("before", "inside")


def near(df: DataFrame, rows: int) -> DataFrame:
    """``df`` broadcast if it has few rows by count (rows of files or of splits)."""
    return F.broadcast(df) if rows <= 100_000 else wide(df)


def places(rows: DataFrame, files: DataFrame) -> DataFrame:
    """file, pos, line and col (in bytes, from 1) of every tag in ``files``, from ``leveled`` rows: running sums of bytes and line ends, within a split and over splits."""
    value = F.concat("text", "tag")
    lines = lambda x: (F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))).cast("long")
    size = lambda x: F.octet_length(x).cast("long")
    tail = lambda x: F.when(F.instr(x, "\n") > 0, size(x) - size(F.substring_index(x, "\n", -1)))  # noqa: E731  bytes up to the last line end
    # a join by sorting would put all tags of a file into one task, and the windows would keep them there
    named = cut(files.select("file").distinct())
    some = rows.join(near(named, named.count()), "file", "left_semi").select("file", "split", "at", size(value).alias("bytes"), size(F.col("text")).alias("ahead"), lines(value).alias("ends"), lines(F.col("text")).alias("ends_ahead"), tail(value).alias("last"), tail(F.col("text")).alias("last_ahead"))
    here = Window.partitionBy("file", "split").orderBy("at")
    inside = some.withColumns({"start": F.sum("bytes").over(here) - F.col("bytes"), "line": F.sum("ends").over(here) - F.col("ends")})
    inside = inside.withColumn("found", F.max(F.col("start") + F.col("last")).over(here.rowsBetween(Window.unboundedPreceding, -1)))
    per = inside.groupBy("file", "split").agg(F.sum("bytes").alias("n"), F.sum("ends").alias("n_ends"), F.max(F.col("start") + F.col("last")).alias("n_last"))
    over = Window.partitionBy("file").orderBy("split")
    carried = per.withColumns({"start_before": F.sum("n").over(over) - F.col("n"), "line_before": F.sum("n_ends").over(over) - F.col("n_ends")})
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.withColumn("last_before", F.max(F.col("start_before") + F.col("n_last")).over(earlier)).select("file", "split", "start_before", "line_before", "last_before")
    at = inside.join(carried, ["file", "split"])
    tag = F.col("start_before") + F.col("start") + F.col("ahead")
    last = F.coalesce(F.col("start_before") + F.col("start") + F.col("last_ahead"), F.col("start_before") + F.col("found"), F.col("last_before"), F.lit(0))
    return at.select("file", F.struct("split", "at").alias("pos"), (1 + F.col("line_before") + F.col("line") + F.col("ends_ahead")).alias("line"), (1 + tag - last).alias("col"))


@dataclass(frozen=True)
class Nodes:
    """The parts of some documents."""

    rows: DataFrame  # what ``leveled`` gives
    nodes: DataFrame
    prefixes: DataFrame  # file, prefixes
    no_root: DataFrame  # file
    deep: DataFrame  # file, pos: elements below MOST_LEVELS
    levels: int  # of the deepest node


def nodes(found: DataFrame) -> Nodes:
    """The nodes of documents.

    A node is an element below ``rdf:RDF`` (wherever that stands): file, level (1: elements, 2: properties, and as deep as the documents go, up to MOST_LEVELS), pos, up and within (the positions and
    local names of the nodes around it), ns, local, tag, text (its own, white space kept, line ends as line feeds) and closed.
    """
    rows = leveled(found)
    prefixes = cut(namespaces(rows))
    n_files = prefixes.count()
    local = F.substring_index("name", ":", -1)
    start = F.col("kind").isin("open", "empty")
    rdf_roots = cut(rows.where(start & (local == "RDF")).groupBy("file").agg(F.min_by(F.col("depth"), F.struct("split", "at")).alias("root")))
    no_root = rows.select("file").distinct().join(rdf_roots, "file", "left_anti")
    pos = F.struct("split", "at")
    under = rows.join(near(rdf_roots, n_files), "file").withColumn("rel", F.col("depth") - F.col("root")).where("rel >= 1")
    sizes = under.where(start).agg(F.max("rel"), F.countDistinct("file", "split")).first()
    levels, n_splits = min(sizes[0] or 1, MOST_LEVELS), sizes[1]
    deep = under.where(start & (F.col("rel") > levels)).select("file", pos.alias("pos"))
    inner = under.where(F.col("rel") <= levels + 1)
    each = range(1, levels + 1)
    begins = [F.when(start & (F.col("rel") == k), F.struct("split", "at", local.alias("local"))) for k in each]
    inner = inner.withColumns({f"b{k}": b for k, b in zip(each, begins)})
    lasts = inner.groupBy("file", "split").agg(*(F.max(f"b{k}").alias(f"l{k}") for k in each))
    over = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("file", "split", *(F.max(f"l{k}").over(over).alias(f"c{k}") for k in each))  # a row for each split
    here = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = inner.withColumns({f"b{k}": F.max(f"b{k}").over(here) for k in each}).join(near(carried, n_splits), ["file", "split"])
    around = F.array(*(F.coalesce(f"b{k}", f"c{k}") for k in each))
    placed = placed.withColumn("around", around).drop(*(f"{x}{k}" for x in "bc" for k in each))
    # a start tag stands in the nodes of lower levels; the text before a tag, and an end tag, belong to the nodes open there
    up = F.slice("around", F.lit(1), F.col("rel") - 1)
    place = lambda x: F.struct(x["split"].alias("split"), x["at"].alias("at"))
    node = F.struct(F.col("rel").alias("level"), F.transform(up, place).alias("up"), F.transform(up, lambda x: x["local"]).alias("within"), "name", "tag", (F.col("kind") == "empty").alias("empty"))
    piece = F.when(F.col("kind") == "cdata", F.concat(X.unescape(F.col("text")), F.regexp_extract("tag", r"(?s)^<!\[CDATA\[(.*?)(?:\]\]>)?$", 1))).otherwise(X.unescape(F.col("text")))
    # both go to their node in one shuffle: a row is the start of a node, a piece of the one around it, or both
    begun = F.when(start & (F.col("rel") <= levels), F.struct(pos.alias("pos"), node.alias("node"), F.lit(None).alias("p"), F.lit(None).alias("close")))
    within = F.when(F.col("rel") > 1, F.struct(place(F.element_at("around", F.col("rel") - 1)).alias("pos"), F.lit(None).alias("node"), F.struct("split", "at", piece.alias("piece")).alias("p"), (F.col("kind") == "close").alias("close")))
    told = placed.select("file", F.inline(F.filter(F.array(begun, within), lambda x: x.isNotNull())))
    whole = told.groupBy("file", "pos").agg(F.first("node", ignorenulls=True).alias("node"), F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["piece"]), "").alias("text"), F.bool_or("close").alias("closed"))
    joined = whole.where("node is not null").select("file", "pos", "node.*", "text", "closed").join(near(prefixes, n_files), "file", "left")
    prefix = F.when(F.instr("name", ":") > 0, F.substring_index("name", ":", 1)).otherwise("")
    text = F.coalesce("text", F.lit(""))
    clean = F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)
    found_nodes = joined.select("file", "level", "pos", "up", "within", F.coalesce(F.try_element_at("prefixes", prefix), F.lit("")).alias("ns"), F.substring_index("name", ":", -1).alias("local"), "tag", clean.alias("text"), (F.col("empty") | F.coalesce("closed", F.lit(False))).alias("closed"))
    return Nodes(rows, found_nodes, prefixes, no_root, deep, levels)
