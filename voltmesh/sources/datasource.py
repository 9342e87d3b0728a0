"""``spark.read.format("cimxml")`` and ``df.write.format("cimxml")``: documents as a data source.

Reading, by the option ``scan``:

* ``tokens`` (default): the rows of ``xmltokens.tokens``. A document is one stream in one task, cut by its markup, whatever stands in comments, CDATA or attributes; a chunk is held at a time.
  With ``splitBytes`` it is planned in byte ranges, cut at every ``>``.
* ``blocks``: the same documents as runs of plain tags, each some hundred thousand characters, and the other tokens between them; ``at`` is the place in the split by characters. Reading a document is one stream, so it
  does no more there than find where tags end; tasks cut the blocks (``xmltokens.of_blocks``).
* ``headers``: a row for each document with its header's fields. A document is read up to the end of its header.
* ``namespaces``: a row for each document with the namespaces that its start tags declare, read up to the first tag that declares one of the option ``known`` (separated by spaces); without it the
  first tag that declares any. That tells the vintage.

The files are those under the path that end in one of ``ends`` (``.xml .zip``), or those of ``files``, a JSON list. A zip archive is planned by its central directory: a partition for each entry, which reads its range of the archive alone. An entry or file that can't be read gives a row with ``problem``;
what its stream gave before stays in ``tokens`` and is left out by the readers in ``cimxml``. The option ``glob`` chooses files and entries by their shown names when partitions are planned, so others aren't opened. Conditions on
``file`` (equal, one of, starts, ends, contains) are taken likewise with the option ``push``, in sessions that push filters to Python sources (``spark.sql.python.filterPushdown.enabled``). The library
doesn't use that: Spark 4.1 keeps a pushed filter with the data frame, so a second query on the same one would miss rows.

Writing takes rows (document, text) in the order of tasks and rows: each task writes a part for each document it meets, deflated for ``kind`` ``zip``. The commit leaves a list of parts, a
few bytes for each, and ``assemble`` joins them in tasks, one for each document or archive, by copying bytes. A failed job leaves nothing but its folder of parts, which the abort removes.
"""

from __future__ import annotations

import json
import os
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import ArrowInvalid
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from . import markup as K
from . import store as S

SCHEMAS = {
    "tokens": "file string, split long, at long, value string, problem string",
    "blocks": "file string, split long, at long, value string, plain boolean, problem string",
    "headers": "file string, kind string, id string, fields array<struct<ns:string,local:string,resource:string,text:string>>, size long, bytes_read long, problem string",
    "namespaces": "file string, namespaces array<string>, size long, bytes_read long, problem string",
}
#: What a file that isn't what its name says raises.
UNREADABLE = (OSError, UnicodeError, LookupError, ArrowInvalid, zipfile.BadZipFile, zlib.error)
SPLIT_CHARS = 1 << 22
#: Characters of a batch of blocks, and bytes of documents for a task that cuts blocks into tags.
BLOCK_CHARS, TASK_BYTES = 1 << 18, 1 << 23


@dataclass
class Pieces(InputPartition):
    """What a task reads: (shown name, path, start, end or None) of files, entries of archives, and problems known already."""

    files: list
    entries: list
    problems: list

    def __init__(self, files=(), entries=(), problems=()):
        self.files, self.entries, self.problems = list(files), list(entries), list(problems)


def kept(name: str, conditions: list[Filter], glob: str | None = None) -> bool:
    if glob is not None and not fnmatchcase(name, glob):
        return False
    for f in conditions:
        if isinstance(f, EqualTo):
            fine = name == f.value
        elif isinstance(f, In):
            fine = name in f.value
        elif isinstance(f, StringStartsWith):
            fine = name.startswith(f.value)
        elif isinstance(f, StringEndsWith):
            fine = name.endswith(f.value)
        else:
            fine = f.value in name
        if not fine:
            return False
    return True


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.scan = options.get("scan", "tokens")
        self.path, self.ends = options["path"], tuple(options.get("ends", ".xml .zip").split())
        self.files = json.loads(options["files"]) if "files" in options else None
        self.split = int(options.get("splitbytes", 0))
        self.together = int(options.get("filesperpartition", 1 if self.scan in ("tokens", "blocks") else 32))
        self.chunk = int(options.get("chunkbytes", {"tokens": S.CHUNK, "blocks": BLOCK_CHARS}.get(self.scan, 1 << 13)))
        self.known = set(options.get("known", "").split())
        self.glob = options.get("glob")
        self.conditions: list[Filter] = []

    def partitions(self):
        out, small = [], []
        found = S.listing(self.path, self.ends) if self.files is None else [f for path in self.files for f in S.listing(path, self.ends)]
        for path, size in found:
            if path.lower().endswith(".zip"):
                try:
                    listed = [e for e in S.entries(path) if e.name.lower().endswith(".xml")]
                except UNREADABLE as e:
                    out += [Pieces(problems=[(path, type(e).__name__)])] if kept(path, self.conditions, self.glob) else []
                    continue
                out += [Pieces(entries=[e]) for e in listed if kept(f"{path}!{e.name}", self.conditions, self.glob)]
            elif kept(path, self.conditions, self.glob):
                if self.scan == "tokens" and self.split and size > self.split:
                    out += [Pieces(files=[(path, start, min(size, start + self.split))]) for start in range(0, size, self.split)]
                else:
                    small.append((path, 0, None))
        out += [Pieces(files=small[i : i + self.together]) for i in range(0, len(small), self.together)]
        return out or [Pieces()]

    def read(self, partition):
        for path, problem in partition.problems:
            yield self.failed(path, problem, 0, 0)
        for path, start, end in partition.files:
            source = S.Counted(path, chunk=self.chunk)
            if end is not None:
                yield from self.range_of(path, start, end)
            else:
                yield from self.document(path, source, iter(source), None)
        for e in partition.entries:
            source = S.Counted(e.archive, chunk=self.chunk)
            yield from self.document(f"{e.archive}!{e.name}", source, S.unpacked(e, source), e.size)

    def failed(self, name: str, problem: str, size: int, read: int):
        return {"tokens": (name, 0, 0, None, problem), "blocks": self.batch([(name, 0, 0, None, None, problem)]), "headers": (name, None, None, None, size, read, problem), "namespaces": (name, None, size, read, problem)}[self.scan]

    def document(self, name: str, source: S.Counted, chunks: Iterator[bytes], size: int | None):
        try:
            if size is None:
                store, inside = S.at(source.path)
                size = store.get_file_info(inside).size
            if self.scan == "blocks":
                yield from self.blocks(name, chunks)
                return
            tokens = K.tokens(K.decoded(chunks))
            if self.scan == "tokens":
                split = at = chars = 0
                for value in tokens:
                    yield name, split, at, value, None
                    at, chars = at + 1, chars + len(value)
                    if chars >= SPLIT_CHARS:
                        split, at, chars = split + 1, 0, 0
            elif self.scan == "headers":
                rooted, head = K.header(tokens)
                fields = [(f["ns"], f["local"], f["resource"], f["text"]) for f in head["fields"]] if head else None
                yield name, head and head["kind"], head and head["id"], fields, size, source.bytes, None if rooted else "no rdf:RDF"
            else:
                found: list[str] = []
                for pairs in K.declarations(tokens):
                    found += [ns for _, ns in pairs]
                    if not self.known or self.known.intersection(found):
                        break
                yield name, list(dict.fromkeys(found)), size, source.bytes, None
        except UNREADABLE as e:
            yield self.failed(name, type(e).__name__, size or 0, source.bytes)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["file", "split", "at", "value", "plain", "problem"])

    def blocks(self, name: str, chunks: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        split = at = held = 0
        rows: list[tuple] = []
        for plain, value in K.blocks(K.decoded(chunks)):
            rows.append((name, split, at, value, plain, None))
            at, held = at + len(value), held + len(value)
            if held >= BLOCK_CHARS:
                yield self.batch(rows)
                rows, held = [], 0
            if at >= SPLIT_CHARS:
                split, at = split + 1, 0
        if rows:
            yield self.batch(rows)

    def range_of(self, path: str, start: int, end: int):
        """The records, each up to a ``>``, that begin in a byte range."""
        at, place, rest = 0, max(0, start - 1), b""
        first = start > 0
        for data in S.Counted(path, place, None, self.chunk):
            rest += data
            while (cut := rest.find(b">")) >= 0:
                begin, place = place, place + cut + 1
                record, rest = rest[: cut + 1], rest[cut + 1 :]
                if first:
                    first = False  # the record before
                elif begin < end:
                    yield path, start, at, record.decode("utf-8", "replace"), None
                    at += 1
                if place >= end:
                    return
        if rest and not first and place < end:
            yield path, start, at, rest.decode("utf-8", "replace"), None


class PushedReader(Reader):
    """A reader that takes conditions on the file's name."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) and f.attribute == ("file",):
                self.conditions.append(f)
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    """The parts that a task wrote: (document, part)."""

    parts: list


class Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.deflate, self.overwrite = options["path"].rstrip("/"), options.get("kind", "documents") == "zip", overwrite
        self.parts = f"{self.path}{'.parts' if self.deflate else '/_parts'}/{uuid.uuid4().hex}"

    def write(self, iterator):
        from pyspark import TaskContext

        order, out, name, writer = TaskContext.get().partitionId(), [], None, None
        mine = f"{self.parts}/{order}-{uuid.uuid4().hex}"
        for row in iterator:
            if row.document != name or writer is None:
                if writer is not None:
                    out.append((name, writer.close()))
                name, writer = row.document, S.PartWriter(f"{mine}-{len(out)}", (order << 20) + len(out), self.deflate)
            writer.write(row.text.encode())
        if writer is not None:
            out.append((name, writer.close()))
        return Written([(n, p.path, p.order, p.packed, p.size, p.crc) for n, p in out])

    def commit(self, messages):
        listed = [p for m in messages if m is not None for p in m.parts]
        store, inside = S.at(manifest_of(self.path, self.deflate))
        store.create_dir(os.path.dirname(inside), recursive=True)
        with store.open_output_stream(inside) as out:
            for p in listed:
                out.write((json.dumps(p) + "\n").encode())

    def abort(self, messages):
        store, inside = S.at(self.parts)
        if store.get_file_info(inside).type == S.stores.FileType.Directory:
            store.delete_dir(inside)


def manifest_of(path: str, zipped: bool) -> str:
    return path.rstrip("/") + (".parts/manifest" if zipped else "/_parts/manifest")


class CimXml(DataSource):
    @classmethod
    def name(cls):
        return "cimxml"

    def schema(self):
        return SCHEMAS[self.options.get("scan", "tokens")]

    def reader(self, schema):
        options = {k.lower(): v for k, v in self.options.items()}
        return (PushedReader if options.get("push") == "true" else Reader)(options)

    def writer(self, schema, overwrite):
        return Writer({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(CimXml)


def scan(spark: SparkSession, path: str, kind: str = "tokens", **options) -> DataFrame:
    register(spark)
    return spark.read.format("cimxml").options(scan=kind, **{k: str(v) for k, v in options.items()}).load(path)


def text_size(path: str, ends: str = ".xml .zip", files: str | None = None) -> int:
    """Bytes of the documents that such a scan reads, those of entries unpacked."""
    total = 0
    for name, size in [f for p in (json.loads(files) if files else [path]) for f in S.listing(p, tuple(ends.split()))]:
        try:
            total += sum(e.size for e in S.entries(name)) if name.lower().endswith(".zip") else size
        except UNREADABLE:
            pass
    return total


def blocks(spark: SparkSession, path: str, **options) -> DataFrame:
    """The scan ``blocks``, dealt by split over a task for each TASK_BYTES of text."""
    return scan(spark, path, "blocks", **options).repartition(1 + text_size(path, **options) // TASK_BYTES, "file", "split")


def write(rows: DataFrame, path: str, zipped: bool = False) -> list[str]:
    """``rows`` (document, text), in the order of their partitions, as one file for each document under ``path``, or as the archive ``path``; the paths written.

    Rows of a document must follow each other, as after a range partition by document and place and a sort.
    """
    spark = rows.sparkSession
    register(spark)
    rows.select("document", "text").write.format("cimxml").option("kind", "zip" if zipped else "documents").mode("append").save(path)
    return assemble(spark, path, zipped)


def assemble(spark: SparkSession, path: str, zipped: bool) -> list[str]:
    """Join the parts that a committed write has listed: a task for each document, or one for the archive; then the parts go."""
    listed = manifest_of(path, zipped)
    rows = spark.read.schema("line string").text(listed)
    target = path.rstrip("/")

    def join(batches):
        found: dict[str, list[S.Part]] = {}
        for batch in batches:
            for line in batch.column(1).to_pylist():
                name, *part = json.loads(line)
                found.setdefault(name, []).append(S.Part(*part))
        done = []
        if zipped and found:
            S.archived(target, sorted(found.items()))
            done.append(target)
        elif not zipped:
            for name, parts in sorted(found.items()):
                S.put_together(f"{target}/{name}", parts)
                done.append(f"{target}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["path"])

    document = F.lit("") if zipped else F.get_json_object("line", "$[0]")
    named = rows.select(document.alias("document"), "line")
    count = 1 if zipped else max(1, named.select("document").distinct().count())
    done = sorted(r.path for r in named.repartition(count, "document").mapInArrow(join, "path string").collect())  # names of files
    store, inside = S.at(os.path.dirname(listed))
    store.delete_dir(inside)
    return done
