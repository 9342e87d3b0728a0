"""Phrase collocation mining: n-grams of frequent words as fixed-width binary keys, range-partitioned, radix-sorted and run-length counted.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and tabs; every language
(null: ``und``) is counted by itself.

1. *Dictionary.* Words are counted in all texts. Those with ``min_count`` occurrences or more get numbers, the others can't be part of a frequent phrase
   and break the pieces. A number stands for a word of one language, so keys of languages never meet.
2. *Keys.* Each position with a frequent word after its own gives one key: the numbers of the next ``longest`` words, four bytes each, zeros from the end
   of the piece on. All shorter phrases that begin there are prefixes of that key.
3. *Sort and count.* A task radix-sorts, 16 bits a pass, and run-length counts what it has read, about ``KEYS_AT_ONCE`` keys at a time, so repeated texts shrink before the shuffle. Sorted keys are dealt in ranges, as packed
   columns of one range each: numbers follow the words' frequency, so the running sum of the counts tells the ranges of the first word, and where that is frequent, of the second. Each range is radix-sorted again, and the runs of each prefix
   length are its counts. A range with much more than its share of keys, as after a very common pair of words, is split by a hash of the key, and the counts of its parts are summed.
4. *Scores.* A phrase is cut at each place; counts of the parts are joined by key. The lowest ``floor(1000 a n / (l r))`` counts, in whole numbers of 38 digits.
   A phrase within a longer one as frequent as itself is dropped; as counts only fall with length, phrases longer by one word tell it.

A dictionary of at most ``most_words`` words is broadcast. A larger one has its ``most_words`` most frequent words broadcast, and the others are joined to the words
of each text.

Defined cases: null texts have no words; null ids don't matter and repeated rows count each; texts, pieces and words of any length are taken whole; an empty table,
or one without frequent phrases, gives an empty result; ties are ranked by the phrase's bytes; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import numbered
from .common import cut, map_batches, map_groups, mix, new_folder, remove_folder, slices, small, values_of

#: Bytes as the contract reads them: A-Z lower-case, piece ends as a byte that UTF-8 never has, tabs as spaces.
BREAK = b"\xff"
_BYTES = bytearray(range(256))
for _c in range(65, 91):
    _BYTES[_c] = _c + 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _BYTES[_c] = BREAK[0]
_BYTES[9] = 32
_TO_PIECES = bytes(_BYTES)
_TO_WORDS = _TO_PIECES.replace(BREAK, b" ")
KEYS_AT_ONCE = 1 << 20
ROWS_A_RANGE = 1 << 20


def with_languages(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word and n of all words; the row without a word holds the language's total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[bytes, int]] = {}
        totals: dict[str, int] = {}
        held = [0]

        def rows() -> pa.RecordBatch:
            out = [(lang, word, n) for lang, of in counts.items() for word, n in of.items()] + [(lang, None, n) for lang, n in totals.items()]
            counts.clear()
            totals.clear()
            held[0] = 0
            lang, word, n = zip(*out) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for some in slices(batch, 1):
                for lang, text in zip(values_of(some.column(0)), values_of(some.column(1))):
                    words = text.encode().translate(_TO_WORDS).split()
                    of = counts.setdefault(lang, {})
                    before = len(of)
                    for w in words:
                        of[w] = of.get(w, 0) + 1
                    totals[lang] = totals.get(lang, 0) + len(words)
                    held[0] += len(of) - before
                if held[0] > 100_000:
                    yield rows()
        yield rows()

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of rows of ``keys`` (uint32), by a radix sort of 16 bits a pass from the last number to the first."""
    order = np.arange(len(keys))
    for at in reversed(range(keys.shape[1])):
        column = keys[:, at]
        for shift in (0, 16) if len(column) and column.max() >> 16 else (0,):
            digit = (column >> np.uint32(shift)).astype(np.uint16)
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def counted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted ``keys`` and their sums of ``n``."""
    order = radix_order(keys)
    keys, n = keys[order], n[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(1)
    starts = np.flatnonzero(new)
    return keys[starts], np.add.reduceat(n, starts) if len(starts) else n


def as_binary(keys: np.ndarray) -> pa.Array:
    """Rows of numbers as big-endian binary values, which sort as the rows do."""
    width = 4 * keys.shape[1]
    offsets = np.arange(len(keys) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(keys, ">u4").tobytes())])


def packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys and their counts, column after column, the first one by its steps."""
    columns = np.empty((keys.shape[1] + 1, len(keys)), np.uint32)
    columns[:-1], columns[-1] = keys.T, n
    columns[0, 1:] -= keys[:-1, 0]
    return zstandard.compress(columns.tobytes(), 1)


def unpacked(block: bytes, longest: int) -> tuple[np.ndarray, np.ndarray]:
    columns = np.frombuffer(zstandard.decompress(block), np.uint32).reshape(longest + 1, -1).copy()
    columns[0] = np.cumsum(columns[0], dtype=np.uint32)
    return columns[:-1].T, columns[-1].astype(np.int64)


def phrase_keys(ids: np.ndarray, longest: int) -> np.ndarray:
    """The key of each position of ``ids`` (0: a break) that has a number after its own."""
    padded = np.append(ids, np.zeros(longest, np.uint32))
    at = np.flatnonzero((padded[:-1] > 0) & (padded[1:] > 0))
    keys = np.empty((len(at), longest), np.uint32)
    keys[:, 0], keys[:, 1] = padded[at], padded[at + 1]
    for m in range(2, longest):
        keys[:, m] = padded[at + m] * (keys[:, m - 1] > 0)
    return keys


class Ranges:
    """Which range a key is in: ``before`` and ``of`` have, by number, the occurrences of all words before and of each known word.

    A range holds about ``share`` keys. The words before give the range of the first word; a word with more than a share has ranges of its own, told by the second.
    """

    def __init__(self, before: np.ndarray, of: np.ndarray, share: int):
        own = np.maximum(1, of // share)
        # words of one range each lie together by their running sums; after a word with ranges of its own a new one begins
        place = before // share
        step = np.zeros(len(of), np.int64)
        step[1:] = np.where((own[1:] > 1) | (own[:-1] > 1), own[:-1], np.minimum(1, place[1:] - place[:-1]))
        self.first, self.own, self.before, self.total = np.cumsum(step), own, before, max(1, int(before[-1] + of[-1])) if len(of) else 1

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The ranges of sorted keys; numbers beyond the known ones are rare words, which share the ranges after."""
        known = len(self.first)
        one = np.minimum(keys[:, 0].astype(np.int64) - 1, known - 1)
        two = np.minimum(keys[:, 1].astype(np.int64) - 1, known - 1)
        inner = (self.before[two] * self.own[one]) // self.total  # whole numbers: occurrences times ranges
        return self.first[one] + np.minimum(inner, self.own[one] - 1)


def encoded_keys(texts: DataFrame, dictionary: DataFrame, words: int, longest: int, most_words: int) -> DataFrame:
    """range, rows and block: the phrase keys of all texts, sorted and counted within each task's chunks. ``dictionary``: id, lang, word and n, numbered from the most frequent on."""
    known: dict[str, dict[bytes, int]] = {}
    count = np.zeros(min(words, most_words), np.int64)
    for r in dictionary.where(F.col("id") <= most_words).select("lang", "word", "id", "n").toLocalIterator():
        known.setdefault(r.lang, {})[r.word.encode()] = r.id
        count[r.id - 1] = r.n
    shared = texts.sparkSession.sparkContext.broadcast((known, Ranges(np.cumsum(count) - count, count, ROWS_A_RANGE)))
    if words <= most_words:
        told = texts.withColumn("told", F.lit(None).cast("array<struct<word:string,id:long>>"))
    else:
        # the rarer words of each text, joined to the rest of the dictionary; texts with one hash get a union, which is right for each of them

        def rarer(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for some in slices(batch, 2):
                found = []
                for lang, text in zip(values_of(some.column(1)), values_of(some.column(2))):
                    frequent = shared.value[0].get(lang, {})
                    found.append([w.decode() for w in set(text.encode().translate(_TO_WORDS).split()) if w not in frequent])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(found, pa.list_(pa.string()))], names=["place", "lang", "words"])

        place = F.xxhash64("lang", "text")
        listed = map_batches(texts.select(place.alias("place"), "lang", "text"), rarer, "place long, lang string, words array<string>").select("place", "lang", F.explode("words").alias("word")).distinct()
        hits = listed.join(dictionary.where(F.col("id") > most_words), ["lang", "word"]).groupBy("place").agg(F.collect_list(F.struct("word", "id")).alias("told"))
        told = texts.withColumn("place", place).join(hits, "place", "left").select("lang", "text", "told")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        frequent, ranges = shared.value

        def blocks() -> pa.RecordBatch:
            keys = np.concatenate(held) if held else np.empty((0, longest), np.uint32)
            keys, n = counted(keys, np.ones(len(keys), np.int64))
            of = ranges.of(keys) if len(keys) else np.empty(0, np.int64)
            starts = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(keys))
            rows = [packed(keys[a:b], n[a:b]) for a, b in zip(starts[:-1], starts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(of[starts[:-1]]), pa.array(np.diff(starts)), pa.array(rows, pa.binary())], names=["range", "rows", "block"])

        for batch in batches:
            for some in slices(batch, 1):
                ids = []
                for lang, text, more in zip(*(values_of(c) for c in some.columns)):
                    known_here = frequent.get(lang, {})
                    if more:
                        known_here = known_here | {m["word"].encode(): m["id"] for m in more}
                    get = known_here.get
                    ids += [get(w, 0) for w in text.encode().translate(_TO_PIECES).replace(BREAK, b" \xff ").split()]
                    ids.append(0)
                held.append(phrase_keys(np.array(ids, np.uint32), longest))
                n_held += len(held[-1])
                if n_held >= KEYS_AT_ONCE:
                    yield blocks()
                    held, n_held = [], 0
        yield blocks()

    return told.select("lang", "text", "told").mapInArrow(run, "range long, rows long, block binary")


def phrase_counts(blocks: DataFrame, longest: int, min_count: int) -> DataFrame:
    """key (zeros after the phrase) and a, of the phrases of 2 words or more with ``min_count`` occurrences.

    The first two words tell the range, so a range has all of a phrase. Of a range in parts, only whole keys do: its shorter phrases leave with what each part has, and are summed.
    """
    sizes = blocks.groupBy("range").agg(F.sum("rows").alias("n")).where(F.col("n") > 4 * ROWS_A_RANGE).select("range", F.ceil(F.col("n") / ROWS_A_RANGE).cast("int").alias("parts"))
    hot = cut(sizes)
    split = small(hot, hot.count())
    whole = blocks.join(split, "range", "left_anti").select("range", F.lit(0).alias("part"), F.lit(False).alias("partial"), "block")

    def deal(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for of, parts, block in zip(*(values_of(c) for c in batch.columns)):
            keys, n = unpacked(block, longest)
            mixed = np.zeros(len(keys), np.uint64)
            for at in range(longest):
                mixed = mix(mixed + keys[:, at])
            part_of = (mixed % np.uint64(parts)).astype(np.int64)
            rows = [(p, packed(keys[part_of == p], n[part_of == p])) for p in np.unique(part_of).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([of] * len(rows), pa.int64()), pa.array([p for p, _ in rows], pa.int32()), pa.array([True] * len(rows)), pa.array([b for _, b in rows], pa.binary())], names=["range", "part", "partial", "block"])

    parted = map_batches(blocks.join(split, "range").select("range", "parts", "block"), deal, "range long, part int, partial boolean, block binary")

    def run(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        out_keys, out_n = [], []
        for a, b in zip(starts, np.append(starts[1:], rows.num_rows)):
            parts = [unpacked(x, longest) for x in values_of(rows.column("block").slice(a, b - a))]
            keys, n = counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            partial = rows.column("partial")[int(a)].as_py()
            differ = np.ones(len(keys), bool)
            differ[1:] = keys[1:, 0] != keys[:-1, 0]
            for m in range(2, longest + 1):
                differ[1:] |= keys[1:, m - 1] != keys[:-1, m - 1]
                at = np.flatnonzero(differ)
                sums = np.add.reduceat(n, at)
                keep = (keys[at, m - 1] > 0) & ((sums >= min_count) | (partial and m < longest))
                found = keys[at[keep]].copy()
                found[:, m:] = 0
                out_keys.append(found)
                out_n.append(sums[keep])
        return pa.RecordBatch.from_arrays([as_binary(np.concatenate(out_keys)), pa.array(np.concatenate(out_n))], names=["key", "a"])

    runs = map_groups(whole.unionByName(parted), ["range", "part"], run, "key binary, a long")
    return runs.groupBy("key").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)


def part(key: Column, first: Column | int, words: Column, longest: int) -> Column:
    """The key of ``words`` words of a phrase from its word ``first`` (from 0) on."""
    return F.rpad(F.substring(key, F.lit(first) * 4 + 1, words * 4), 4 * longest, F.lit(bytearray(b"\0")))


def scored(phrases: DataFrame, counts: DataFrame, totals: DataFrame, longest: int) -> DataFrame:
    """``phrases`` (key, m, a, lang) with l, r, n and score of their lowest cut. ``counts``: key and a of all phrases and words."""
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.withColumn("left", part(F.col("key"), 0, F.col("k"), longest)).withColumn("right", part(F.col("key"), F.col("k"), F.col("m") - F.col("k"), longest))
    both = cuts.join(counts.select(F.col("key").alias("left"), F.col("a").alias("l")), "left").join(counts.select(F.col("key").alias("right"), F.col("a").alias("r")), "right").join(totals, "lang")
    score = F.expr("cast((cast(1000 * a as decimal(19,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as long)")
    best = both.withColumn("score", score).groupBy("key").agg(F.min(F.struct("score", "k", "l", "r", "n", "lang", "a", "m")).alias("b"))
    return best.select("key", "b.lang", "b.m", "b.a", "b.l", "b.r", "b.n", "b.score")


def maximal(phrases: DataFrame, longest: int) -> DataFrame:
    """``phrases`` without those in a longer one that is as frequent."""
    shorter = F.col("m") - 1
    longer = phrases.where("m > 2").select("key", "m", F.col("a").alias("other"))
    within = longer.select(F.explode(F.array(part(F.col("key"), 0, shorter, longest), part(F.col("key"), 1, shorter, longest))).alias("key"), "other").groupBy("key").agg(F.max("other").alias("other"))
    return phrases.join(within, "key", "left").where("other is null or 100 * other < 100 * a").drop("other")


def collocations(docs: DataFrame, min_count: int = 100, longest: int = 5, most: int = 2000, most_words: int = 200_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``most`` phrases."""
    texts = with_languages(docs)
    spark = docs.sparkSession
    counts = cut(word_counts(texts).where((F.col("n") >= min_count) | F.col("word").isNull()))
    totals = counts.where("word is null").select("lang", "n")
    dictionary = cut(numbered(counts.where("word is not null"), "id", F.desc("n"), "lang", "word"))
    words, languages = dictionary.count(), totals.count()
    totals = small(totals, languages)
    path = new_folder(spark, "phrase-keys")
    encoded_keys(texts, dictionary, words, longest, most_words).write.parquet(path)
    found = cut(phrase_counts(spark.read.parquet(path), longest, min_count))
    remove_folder(spark, path)
    rows = found.count()
    number = lambda at: F.conv(F.hex(F.substring("key", at * 4 + 1, 4)), 16, 10).cast("long")
    languages_of = small(dictionary.select(F.col("id").alias("first"), "lang"), words)
    sized = found.withColumn("m", sum((number(at) > 0).cast("int") for at in range(longest))).withColumn("first", number(0))
    phrases = sized.join(languages_of, "first").drop("first")
    singles = dictionary.select(F.rpad(F.unhex(F.lpad(F.hex("id"), 8, "0")), 4 * longest, F.lit(bytearray(b"\0"))).alias("key"), F.col("n").alias("a"))
    kept = cut(scored(maximal(phrases, longest), small(found.union(singles), rows + words), totals, longest))
    # the first ones of a bucket, then those of all buckets; ties stay until the phrase tells them apart
    best = F.desc("score"), F.desc("a")
    few = kept.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(64)))
    for group in (["lang", "bucket"], ["lang"]):
        few = few.withColumn("place", F.rank().over(Window.partitionBy(*group).orderBy(*best))).where(F.col("place") <= most)
    few = cut(few.drop("place", "bucket"))
    spelled = few.select("key", F.posexplode(F.array(*(number(at) for at in range(longest)))).alias("at", "id")).where("id > 0").join(small(dictionary.select("id", "word"), words), "id")
    phrase = spelled.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = few.join(phrase, "key").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best, "phrase"))).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
