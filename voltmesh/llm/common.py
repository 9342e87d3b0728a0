"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import cut, new_folder, remove_folder  # noqa: F401  used by the operators

MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """Broadcast ``df`` if its measured number of rows is within ``most``; otherwise leave the join to Spark."""
    return F.broadcast(df) if rows <= most else df


def least_by(df: DataFrame, key: Column, n: int, *order: str) -> DataFrame:
    """The ``n`` least rows of ``df`` by ``key``, a 64-bit hash, and ``order``: the same as sorting and taking ``n``.

    Hashes spread evenly, so about 2 n rows lie below a cut that follows from the count; only these are sorted, and
    the driver or the last task gets about 2 n rows, not n from each task. If fewer than n lie there, all are sorted.
    """
    total = df.count()
    if total > 2 * n:
        few = df.where(key <= F.lit(2 * n * (1 << 64) // total - (1 << 63)))
        if few.count() >= n:
            df = few
    return df.orderBy(key, *order).limit(n)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch], schema) -> DataFrame:
    """``mapInArrow`` with a function of one batch that gives one or several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: int, rows: int = 256, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """A batch a few rows and about ``most`` bytes of the string column ``text`` at a time, so that texts and what is made of them never stand in memory for all of it."""
    size = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False)))
    i = 0
    while i < batch.num_rows:
        j = min(i + rows, max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, "right"))))
        yield batch.slice(i, j - i)
        i = j


def words(text: str | bytes | None) -> list[bytes]:
    """Maximal runs outside space, tab, line feed, vertical tab, form feed and carriage return."""
    if not text:
        return []
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).split()


#: A random number for each byte, and the same with ASCII letters in one case.
_LETTER = np.random.default_rng(20240301).integers(0, 2**64, 256, np.uint64)
_FOLDED = _LETTER.copy()
_FOLDED[65:91] = _LETTER[97:123]
#: Kinds of bytes; runs of one kind are hashed, those of kind 0 lie between. TOKENS parts ASCII punctuation and line feeds from words.
WORDS = np.ones(256, np.uint8)
WORDS[[9, 10, 11, 12, 13, 32]] = 0
TOKENS = WORDS.copy()
TOKENS[[i for i in range(33, 127) if not chr(i).isalnum()]] = 2
TOKENS[10] = 3
_BASE = 0x9E6C63D0876A9A47 | 1
AT_ONCE = 1 << 17


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of _BASE and of its inverse modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.append(np.uint64(1), np.full(2 * AT_ONCE + 1, b, np.uint64))) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def _runs(data: np.ndarray, kinds: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and polynomial sum of the runs of bytes of one kind other than 0."""
    up, down = _powers()
    kind = kinds[data]
    edges = np.append(np.flatnonzero(np.diff(kind, prepend=kind[:1] + 1)), len(data))
    inside = kind[edges[:-1]] > 0
    starts, ends = edges[:-1][inside], edges[1:][inside]
    with np.errstate(over="ignore"):
        sums = np.append(np.uint64(0), np.cumsum(letters[data] * up[: len(data)]))
        return starts, ends, (sums[ends] - sums[starts]) * down[starts]


def _finished(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(sums + lengths.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _long_text(text: bytes, kinds: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The hashes of one text, AT_ONCE bytes at a time; a word that may go on in the next bytes is carried over."""
    out, carried, length = [], 0, 0
    for i in range(0, len(text), AT_ONCE):
        data = np.frombuffer(text, np.uint8, min(AT_ONCE, len(text) - i), i)
        starts, ends, sums = _runs(data, kinds, letters)
        sizes = ends - starts
        if length and kinds[data[0]] == kinds[text[i - 1]]:
            sums[0] = (carried + int(sums[0]) * pow(_BASE, length, 1 << 64)) & MASK64
            sizes[0] += length
        elif length:
            sums, sizes, ends = np.append(np.uint64(carried), sums), np.append(length, sizes), np.append(0, ends)
        carried, length = 0, 0
        if len(ends) and ends[-1] == len(data):
            carried, length = int(sums[-1]), int(sizes[-1])
            sums, sizes = sums[:-1], sizes[:-1]
        out.append(_finished(sums, sizes))
    if length:
        out.append(_finished(np.array([carried], np.uint64), np.array([length])))
    return np.concatenate(out)


def word_hashes(texts: Iterable[bytes | None], kinds: np.ndarray = WORDS, fold: bool = False) -> Iterator[np.ndarray]:
    """For each text the 64-bit hashes of its words (or TOKENS), in order; ``fold``: ASCII letters in one case.

    A word's hash is a polynomial over its bytes, from running sums of about AT_ONCE bytes, so no word is remembered and memory
    depends on neither the corpus nor a text's length.
    """
    letters = _FOLDED if fold else _LETTER
    group: list[bytes] = []

    def together() -> Iterator[np.ndarray]:
        size = np.cumsum([len(t) + 1 for t in group])
        starts, ends, sums = _runs(np.frombuffer(b" ".join([*group, b""]), np.uint8), kinds, letters)
        yield from np.split(_finished(sums, ends - starts), np.searchsorted(starts, size[:-1]))

    held = 0
    for t in texts:
        if t is not None and len(t) > AT_ONCE:
            if group:
                yield from together()
                group, held = [], 0
            yield _long_text(t, kinds, letters)
            continue
        group.append(t or b"")
        held += len(group[-1]) + 1
        if held >= AT_ONCE:
            yield from together()
            group, held = [], 0
    if group:
        yield from together()


def values_of(column: pa.Array) -> Iterator:
    """The values of a column, one at a time."""
    return (v.as_py() for v in column)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def mix_int(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK64
    return x ^ (x >> 31)


def mix(x: np.ndarray) -> np.ndarray:
    """The same finaliser on an array of uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` over whole groups of equal ``keys`` (longs or ints), many groups a call: it gets a table and where each group starts.

    Rows are dealt by the keys and sorted; a task holds an Arrow batch and one group at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
            starts = group_starts(now, keys)
            if starts[-1]:
                yield fn(now.slice(0, int(starts[-1])).combine_chunks(), starts[:-1])
            rest = now.slice(int(starts[-1]))
        if rest is not None:
            yield fn(rest.combine_chunks(), np.zeros(1, np.int64))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def group_starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for k in keys:
        x = rows.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)
