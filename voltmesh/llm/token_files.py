"""Token ids in binary files of patched frame-of-reference blocks.

Every text is encoded by a public tokenizer of the ``tokenizers`` library and followed by an end id. Documents are
range-partitioned by id, text and row number, so that a frequent id is spread over tasks, and sorted, so the files, in the order of the numbers in their names, hold all ids in ascending doc_id order. Spark's own
text writer stores the records (a record's bytes and a line feed), so files land on whatever store the path names and
under Spark's commit protocol; ``binaryFile`` reads them.

A task begins a new file at a document's end once a file has its blocks, so no file grows with the input. A file is a run
of records, each followed by one 0x0A byte (little-endian numbers); empty records before the index fill a file
up to the number of records at which Spark's writer begins the next, and a record may hold several blocks:

    block    uint32 count, uint8 width, uint32 minimum, uint16 exceptions; count values (id - minimum) of
             ``width`` bits, low bits first; uint16 position of each exception, then its uint32 value
    index    uint64 start of each block; uint32 length and int64 doc_id of each document, uint8 flag of
             a null doc_id; then the trailer: uint64 blocks, documents, ids, start of the index, and the mark

The width is the least that holds the ``percentile`` of a block's values; larger ones are exceptions, so
one rare id doesn't widen a block.

Words are encoded once per worker and remembered (at most ``most`` parts and ``most_chars`` characters, the most used ones stay): a text is cut only where the tokenizer's own splitting always
cuts (before a single space or around white space), and each part is encoded by the library.

Defined cases: null and empty texts hold the end id alone; null doc_ids come first; repeated rows are all stored;
ties of doc_id are ordered by text; an empty table gives no file and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, map_batches, slices

BLOCK = 4096
HEAD, TRAILER, MARK = "<IBIH", "<QQQQ8s", b"VMPFOR01"
#: Parts whose ends the tokenizer always cuts at: white space but its last character, and runs without white space with a space before them.
_PARTS = re.compile(r"\s+(?!\S)| ?\S+|\s")
_OTHER_SPACE = re.compile(r"[^\S \n]")
#: ASCII punctuation that the splitting puts into one part after letters; the apostrophe may begin a contraction.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_ODD = "\x00\x1c\x1d\x1e\x1f"  # the mark below, and white space for Python alone: such texts are encoded whole


def parts_of(text: str | None) -> list[str]:
    """The parts of a text, as keys: a word after a space is itself, a line feed is itself, any other part has a NUL before it."""
    if not text:
        return []
    if any(c in text for c in _ODD):
        return ["\x00" + text]
    parts = ("\x00" + text.replace("\n", " \n \x00")).split(" ")
    if "" in parts or "\x00" in parts:  # white space next to white space, or at an end
        return [p[1:] if p[0] == " " and len(p) > 1 and not p.isspace() else p if p == "\n" else "\x00" + p for p in _PARTS.findall(text)]
    return parts


def part_text(key: str) -> str:
    return key[1:] if key[0] == "\x00" else key if key == "\n" else " " + key


class Parts(dict):
    """Numbers of parts; a part that is looked up for the first time gets the next number and stands in ``new``."""

    new: list[str]

    def __missing__(self, part: str) -> int:
        number = self[part] = len(self)
        self.new.append(part)
        return number


def byte_characters() -> dict[int, str]:
    """The character that a byte-level vocabulary writes for each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    itself = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in itself]
    return {b: chr(b) for b in itself} | {b: chr(256 + i) for i, b in enumerate(others)}


@lru_cache(maxsize=1)
def encoder_for(definition: str) -> WordEncoder:
    """The worker's encoder, kept from task to task."""
    return WordEncoder(definition)


class WordEncoder:
    """Texts to ids, with the ids of parts remembered."""

    def __init__(self, definition: str, most: int = 300_000, most_chars: int = 8_000_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.most_chars = Tokenizer.from_str(definition), most, most_chars
        line = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in ("\n", " a\n b")]
        told = json.loads(definition)
        split = told.get("pre_tokenizer") or {}
        # of such a tokenizer, letters after a space and the punctuation after them are two parts, each given to the model as it is
        self.direct = told.get("normalizer") is None and (told.get("model") or {}).get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        self.written = byte_characters()
        self.line = line[0][0] if len(line[0]) == 1 and line[1].count(line[0][0]) == 1 else None
        self.clear()

    def together(self, keys: list[str]) -> list[list[int]]:
        """The ids of each of some parts. Words are encoded as lines of one text: its line feeds are ids of their own."""
        texts = list(map(part_text, keys))
        lines = "\n".join([*texts, ""])
        if self.line is not None and not _OTHER_SPACE.search(lines):
            ids = np.array(self.tokenizer.encode_batch_fast([lines], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(ids == self.line)
            if len(ends) == len(keys):
                return [x[:-1].tolist() for x in np.split(ids, ends[:-1] + 1)]
        return self.one_by_one(texts)

    def one_by_one(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def tail(self, text: str) -> list[int]:
        """The ids of punctuation."""
        found = self.tails.get(text)
        if found is None:
            if len(self.tails) > 10_000:
                self.tails.clear()
            found = self.tails[text] = [t.id for t in self.tokenizer.model.tokenize(text)]
        return found

    def direct_ids(self, keys: list[str]) -> tuple[list[int], list[int]]:
        """The ids, in a row, of parts that are Latin letters with or without punctuation after them, and how many each has; -1 for any other part."""
        tokenize, written, ids, sizes = self.tokenizer.model.tokenize, self.written, [], []
        space = written[32]
        for key in keys:
            first, word = ("", key[1:]) if key[0] == "\x00" else (space, key)
            stem = spelled = word.rstrip(_TAIL)
            if not stem.isalpha():
                sizes.append(-1)
                continue
            if not stem.isascii():
                if max(stem) > "\u02af":
                    sizes.append(-1)
                    continue
                spelled = stem.encode().decode("latin-1").translate(written)
            found = tokenize(first + spelled)
            ids += [t.id for t in found]
            if len(stem) < len(word):
                tail = self.tail(word[len(stem) :])
                ids += tail
                sizes.append(len(found) + len(tail))
            else:
                sizes.append(len(found))
        return ids, sizes

    def clear(self) -> None:
        self.at, self.start, self.ids, self.used = Parts(), np.zeros(1, np.int64), np.empty(0, np.uint32), np.zeros(0, np.int64)
        self.at.new, self.chars, self.tails = [], 0, {}

    def shrink(self) -> None:
        """Keep what was used most, up to half of either bound."""
        parts = list(self.at)
        chars = np.fromiter(map(len, parts), np.int64, len(parts))
        keep = np.argsort(-self.used, kind="stable")[: self.most // 2]
        keep = np.sort(keep[np.cumsum(chars[keep]) <= self.most_chars // 2])
        if not len(keep):
            self.clear()
            return
        self.chars = int(chars[keep].sum())
        size = (self.start[1:] - self.start[:-1])[keep]
        ends = np.cumsum(size)
        self.ids = self.ids[np.repeat(self.start[keep] - ends + size, size) + np.arange(ends[-1])]
        self.start = np.concatenate([[0], ends])
        self.at, self.used = Parts((parts[k], i) for i, k in enumerate(keep.tolist())), self.used[keep] >> 1
        self.at.new = []

    def learn(self) -> None:
        """Encode the parts that have a number only."""
        new, self.at.new = self.at.new, []
        direct, sizes = self.direct_ids(new) if self.direct else ([], [-1] * len(new))
        sizes = np.array(sizes, np.int64)
        left = sizes < 0
        got: dict[int, list[int]] = dict.fromkeys(np.flatnonzero(left).tolist(), [])
        plain = [i for i in got if new[i][0] != "\x00" and new[i] != "\n" or new[i][1:].isalpha()]
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            got.update(zip(some, self.together([new[i] for i in some])))
        other = list(got.keys() - set(plain))
        got.update(zip(other, self.one_by_one([part_text(new[i]) for i in other])))
        sizes[left] = list(map(len, got.values()))
        ids, apart = np.empty(int(sizes.sum()), np.uint32), np.repeat(left, sizes)
        ids[~apart] = direct
        ids[apart] = np.fromiter(chain.from_iterable(got.values()), np.uint32)
        self.chars += sum(map(len, new))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        out = []
        for i in range(0, len(texts), 256):
            group = [parts_of(t) for t in texts[i : i + 256]]
            flat = [p for parts in group for p in parts]
            if len(self.at) > self.most or self.chars > self.most_chars:
                self.shrink()
            number = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
            if self.at.new:
                self.learn()
            self.used += np.bincount(number, minlength=len(self.used))
            size = self.start[number + 1] - self.start[number]
            ends = np.cumsum(size)
            ids = self.ids[np.repeat(self.start[number] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
            bounds = np.concatenate([[0], ends])[np.cumsum([len(parts) for parts in group])]
            out += np.split(ids, bounds[:-1])
        return out


def pack(values: np.ndarray, width: int) -> bytes:
    """``width`` low bits of each value, low bits first."""
    if not width:
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, count: int) -> np.ndarray:
    if not width:
        return np.zeros(count, np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=width * count, bitorder="little").reshape(count, width)
    padded = np.zeros((count, 32), np.uint8)
    padded[:, :width] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u4").ravel()


def encode_block(ids: np.ndarray, percentile: float = 0.95) -> bytes:
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype(np.uint32)
    width = int(np.partition(rest, int(percentile * (len(rest) - 1)))[int(percentile * (len(rest) - 1))]).bit_length()
    large = np.flatnonzero(rest >> np.uint32(width) if width < 32 else np.zeros(len(rest), np.uint32))
    return struct.pack(HEAD, len(ids), width, low, len(large)) + pack(rest, width) + large.astype("<u2").tobytes() + rest[large].astype("<u4").tobytes()


def decode_block(data: memoryview, at: int) -> np.ndarray:
    count, width, low, n = struct.unpack_from(HEAD, data, at)
    at += struct.calcsize(HEAD)
    end = at + -(-width * count // 8)
    ids = unpack(data[at:end], width, count)
    ids[np.frombuffer(data[end : end + 2 * n], "<u2")] = np.frombuffer(data[end + 2 * n : end + 6 * n], "<u4")
    return ids + np.uint32(low)


def runs(ids: list[np.ndarray], most: int):
    """Bounds of runs of documents that end with the one that brings them to ``most`` ids."""
    first, size = 0, 0
    for k, x in enumerate(ids):
        size += len(x) + 1
        if size >= most or k == len(ids) - 1:
            yield first, k + 1
            first, size = k + 1, 0


def estimated_bytes(docs: DataFrame) -> int:
    """The bytes that Spark expects ``docs`` to have, from the sizes of its files; 0 where it doesn't know (it then says 2 ** 63)."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2, files: int | None = None, percentile: float = 0.95, file_blocks: int = 3072, range_bytes: int = 512 << 20) -> None:
    """Write the ids of ``docs`` (doc_id, text) to ``path``.

    ``files``: how many ranges; by default one for each ``range_bytes`` of Spark's estimate of the input, at least the session's shuffle
    partitions and at most 200,000. A range goes on in a new file at the first document that ends after ``file_blocks`` blocks.
    """
    spark = docs.sparkSession
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(estimated_bytes(docs) // range_bytes, 200_000))
    records = file_blocks * 4 // 3 + 2  # Spark begins a new file after so many
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())

    def run(batches):
        encoder, rest, at, written = encoder_for(definition.value), np.empty(0, np.uint32), 0, 0
        starts, lengths, names, nulls, total = [], [], [], [], 0
        held: list[bytes] = []  # blocks of a very long document that go into the last record before the index

        def record(*data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], names=["record"])

        def index() -> bytes:
            return b"".join([np.array(starts, "<u8").tobytes(), np.array(lengths, "<u4").tobytes(), np.array(names, "<i8").tobytes(), np.array(nulls, np.uint8).tobytes(), struct.pack(TRAILER, len(starts), len(lengths), total, at, MARK)])

        def blocks(ids: np.ndarray):
            """The records of some blocks."""
            nonlocal at, written
            for i in range(0, len(ids), BLOCK):
                starts.append(at)
                data = encode_block(ids[i : i + BLOCK], percentile)
                at += len(data)
                if written < records - 2:
                    at += 1
                    written += 1
                    yield record(data)
                else:
                    held.append(data)

        def last():
            """What is held, in one record."""
            nonlocal at, written
            if held:
                at += 1
                written += 1
                yield record(b"".join(held))
                held.clear()

        for batch in (some for whole in batches for some in slices(whole, 1)):
            doc_ids = batch.column(0).to_pylist()
            ids = encoder(batch.column(1).to_pylist())
            for i, j in runs(ids, BLOCK * min(256, file_blocks)):
                lengths += [len(x) + 1 for x in ids[i:j]]
                names += [x or 0 for x in doc_ids[i:j]]
                nulls += [x is None for x in doc_ids[i:j]]
                parts = [rest]
                for x in ids[i:j]:
                    parts += [x, np.array([end_id], np.uint32)]
                rest = np.concatenate(parts)
                total += len(rest) - len(parts[0])
                whole = len(rest) // BLOCK * BLOCK
                yield from blocks(rest[:whole])
                rest = rest[whole:]
                if len(starts) >= file_blocks:
                    yield from blocks(rest)
                    yield from last()
                    pad = records - 1 - written
                    at += pad
                    yield record(*[b""] * pad, index())
                    starts, lengths, names, nulls, total, at, written, rest = [], [], [], [], 0, 0, 0, np.empty(0, np.uint32)
        if lengths:
            yield from blocks(rest)
            yield from last()
            yield record(index())

    # the row's number parts rows that are equal, so no id and no row is too frequent for its range
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id())
    src = numbered.repartitionByRange(files, "doc_id", "text", "row").select("doc_id", "text").sortWithinPartitions("doc_id", "text")
    src.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", records).text(path)


def stored(batch: pa.RecordBatch):
    """file, position in the file, doc_id and ids of the documents in some files, a few blocks at a time."""
    for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
        data = memoryview(content.as_buffer())
        if len(data) < struct.calcsize(TRAILER):
            continue
        blocks, n, total, index, mark = struct.unpack_from(TRAILER, data, len(data) - 1 - struct.calcsize(TRAILER))
        if mark != MARK:
            raise ValueError(f"{name} is not a token file")
        starts = np.frombuffer(data[index : index + 8 * blocks], "<u8")
        at = index + 8 * blocks
        lengths = np.frombuffer(data[at : at + 4 * n], "<u4").astype(np.int64)
        names = np.frombuffer(data[at + 4 * n : at + 12 * n], "<i8")
        nulls = np.frombuffer(data[at + 12 * n : at + 13 * n], np.uint8).astype(bool)
        if lengths.sum() != total:
            raise ValueError(f"{name} tells {lengths.sum()} of {total} ids")
        ends = np.cumsum(lengths)
        rest, block, i = np.empty(0, np.uint32), 0, 0
        while i < n:
            done = int(ends[i] - lengths[i])
            j = max(i + 1, min(i + 2048, int(np.searchsorted(ends, done + 256 * BLOCK, "right"))))
            want, parts, have = int(ends[j - 1]) - done, [rest], len(rest)
            while have < want and block < blocks:
                parts.append(decode_block(data, int(starts[block])))
                have, block = have + len(parts[-1]), block + 1
            if have < want:
                raise ValueError(f"{name} holds {done + have} of {total} ids")
            ids = np.concatenate(parts)
            rest = ids[want:]
            offsets = pa.array(np.concatenate([[0], ends[i:j] - done]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([name] * (j - i)), pa.array(np.arange(i, j)), pa.array(names[i:j], pa.int64(), mask=nulls[i:j]), pa.ListArray.from_arrays(offsets, pa.array(ids[:want].view(np.int32)))], names=["file", "position", "doc_id", "ids"])
            i = j
        if len(rest) or block < blocks:
            raise ValueError(f"{name} holds more than {total} ids")


def files_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, position in the file, doc_id and ids of every stored document."""
    return map_batches(files_of(spark, path), stored, "file string, position long, doc_id long, ids array<int>")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def summary(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(3)
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(values.astype("<i4"))).cast("B")
        crc = [zlib.crc32(raw[4 * int(a) : 4 * int(b)]) for a, b in zip(offsets[:-1], offsets[1:])]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["file", "position", "doc_id", "n_tokens", "ids_crc32"])

    rows = cut(map_batches(files_of(spark, path), lambda batch: map(summary, stored(batch)), "file string, position long, doc_id long, n_tokens long, ids_crc32 long"))
    return with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def file_order(file: str) -> list[F.Column]:
    """The range and the number in its range that a file's name tells, as numbers: names have five digits or more."""
    return [F.regexp_extract(file, pattern, 1).cast("long") for pattern in (r"part-(\d+)-[^/]*$", r"-c(\d+)(?:\.[^/]*)?$")]


def with_starts(rows: DataFrame) -> DataFrame:
    """``rows`` (file, position, n_tokens and more) with ``start``: how many ids stand before, in the order of files."""
    part, number = file_order("file")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumns({"part": part, "number": number})  # a row for each file
    totals = totals.withColumn("bucket", F.floor(F.col("part") / 1024))
    inner = F.sum("n").over(Window.partitionBy("bucket").orderBy("part", "number")) - F.col("n")
    buckets = totals.groupBy("bucket").agg(F.sum("n").alias("m"))  # a row for 1,024 ranges
    earlier = buckets.withColumn("earlier", F.sum("m").over(Window.orderBy("bucket")) - F.col("m")).select("bucket", "earlier")
    before = totals.withColumn("inner", inner).join(F.broadcast(earlier), "bucket").select("file", (F.col("inner") + F.col("earlier")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("position")) - F.col("n_tokens")
    return rows.withColumn("inside", inside).join(before, "file").withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")
