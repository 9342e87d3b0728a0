"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Vocabulary and scores come from a public SentencePiece model; the merging is done here. A text is escaped as the
model does it (a leading space, spaces as U+2581), starts as single characters, and an agenda merges the best-scored
pair, leftmost first, until none is left. A candidate merge - the symbol starting at a place and the piece it would make - is
skipped for good if a keyed hash of (seed, document, copy, occurrence, part, place, piece) falls below ``dropout``: every
occurrence of a word draws for itself. With dropout 0 the ids equal the library's.

A worker remembers, by word, what no key changes: the ids if nothing is dropped and the candidates offered on the way;
and likewise the ids and candidates for each set of dropped ones that came up. An occurrence draws for the
candidates it is offered and follows its drops from one to the next until nothing new is dropped. The memory is emptied at a bound.
New words and new sets are merged together, one array step for all;
parts of over 64 characters go through a heap one by one. Characters outside the vocabulary become bytes, a literal
U+2581 too, so decoding gives back every text exactly.

Defined cases: null gives null ids and decodes to null; empty text gives no ids; null doc_ids hash as -1;
repeated rows with one id get equal ids unless a column ``copy`` numbers them; any length works; an empty table gives an empty result; extra columns
pass through ``encode`` and ``decode``.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MASK64, map_batches, mix, mix_int, slices
from .token_files import part_text

SPACE = "▁"
#: Parts between which no merge can reach: a line feed, or spaces and the word after them.
_PARTS = re.compile(r"\n| *[^ \n]+| +")
LONG = 64
_GOLD = 0x9E3779B97F4A7C15


def characters(text: str) -> np.ndarray:
    """Code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


@lru_cache(maxsize=2)
def pieces_for(model: bytes, dropout: float, seed: int) -> Pieces:
    """The worker's tables and memory, kept from task to task."""
    return Pieces(model, dropout, seed)


class Runs:
    """Growing runs of numbers, by row."""

    def __init__(self, dtype):
        self.n, self.end = 0, 0
        self.values, self.offset, self.size = np.empty(0, dtype), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        n, end = self.n + len(sizes), self.end + len(values)
        if n > len(self.size):
            self.offset, self.size = (np.concatenate([x[: self.n], np.zeros(n * 3 // 2 - self.n, np.int64)]) for x in (self.offset, self.size))
        if end > len(self.values):
            self.values = np.concatenate([self.values[: self.end], np.zeros(end * 3 // 2 - self.end, self.values.dtype)])
        self.offset[self.n : n], self.size[self.n : n], self.values[self.end : end] = self.end + np.cumsum(sizes) - sizes, sizes, values
        self.n, self.end = n, end

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of some rows in a row, and how many each has."""
        size = self.size[rows]
        ends = np.cumsum(size)
        return self.values[np.repeat(self.offset[rows] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], size


class Pieces:
    """Tables of one model, and the merging."""

    def __init__(self, model: bytes, dropout: float, seed: int, most: int = 150_000):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.bytes_of = [b""] * n
        self.byte_id, self.id_of, score = {}, {}, np.zeros(n)
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id_of[piece] = i
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
                score[i] = sp.get_score(i)
        order = np.argsort(-score, kind="stable")
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        self.size = n
        pairs = [(self.id_of[p[:k]] * n + self.id_of[p[k:]], i) for p, i in self.id_of.items() for k in range(1, len(p)) if p[:k] in self.id_of and p[k:] in self.id_of]
        pairs.sort()
        self.pair, self.merged = np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64)
        self.pair_of = dict(pairs)
        # a pair's place by its hash; of those that share one only the first has it, the others are searched for
        slot = self.slot(self.pair)
        self.first, self.shared = np.zeros(1 << 19, np.int32), np.bincount(slot, minlength=1 << 19) > 1
        self.first[slot[::-1]] = np.arange(len(self.pair), dtype=np.int32)[::-1]
        self.char_id = np.full(0x110000, -1, np.int32)
        for piece, i in self.id_of.items():
            if len(piece) == 1:
                self.char_id[ord(" " if piece == SPACE else piece)] = i
        self.lines = not any("\n" in p for p in self.id_of)
        self.below, self.seed, self.most = min(int(dropout * 2**32), 2**32 - 1), seed, most
        self.clear()

    def clear(self) -> None:
        """Forget all nodes: a part and the candidates dropped so far, ``ids`` if no more are, ``offers`` then met and not dropped so far."""
        self.at, self.child = {}, {}
        self.ids, self.offers, self.hashes = Runs(np.int32), Runs(np.int64), Runs(np.uint64)
        self.part, self.drops, self.long = [], Runs(np.int64), Runs(bool)

    def branch(self, parts: list[str], dropped: np.ndarray, sizes: np.ndarray) -> None:
        """New nodes: for each a part and all candidates dropped in it, in a row with their numbers. Long parts are not merged here, so none is dropped in them."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        apart = lengths > LONG
        short = np.flatnonzero(~apart)
        some = sizes[short]
        sets = np.full((len(short), 1 + int(some.max(initial=0))), -1, np.int64)
        sets[:, 0] = short
        row = np.repeat(np.arange(len(short)), some)
        sets[row, 1 + np.arange(len(row)) - np.repeat(np.cumsum(some) - some, some)] = dropped
        self.seen: list[np.ndarray] = []
        ids, counts = self.merge_all([parts[i] for i in short.tolist()], sets)
        every = np.zeros(len(parts), np.int64)
        every[short] = counts
        self.ids.add(ids, every)
        offered = np.sort(np.concatenate([np.empty(0, np.int64), *self.seen]))
        offered = offered[np.append(offered[1:] != offered[:-1], True)] if len(offered) else offered
        self.offers.add(offered & 0xFFFFFFFF, np.bincount(offered >> 32, minlength=len(parts)))
        one = np.ones(len(parts), np.int64)
        self.hashes.add(self.part_hashes(characters("".join(parts)), np.cumsum(lengths) - lengths), one)
        self.long.add(apart, one)
        self.drops.add(dropped, sizes)
        self.part += parts

    def part_hashes(self, chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
        size = np.diff(np.append(starts, len(chars)))
        place = np.arange(len(chars)) - np.repeat(starts, size)
        with np.errstate(over="ignore"):
            return np.add.reduceat(mix(chars.astype(np.uint64) * np.uint64(_GOLD) + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), starts)

    def with_occurrences(self, hashes: np.ndarray, occurrences: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(hashes + np.uint64(self.seed * 0xD6E8FEB86659FD93 & MASK64) + occurrences.astype(np.uint64) * np.uint64(_GOLD))

    def keys(self, chars: np.ndarray, starts: np.ndarray, occurrences: np.ndarray) -> np.ndarray:
        """The dropout keys of parts, given all their characters, where each starts and the numbers of their occurrences."""
        return self.with_occurrences(self.part_hashes(chars, starts), occurrences)

    def skips(self, key: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Whether candidates (place * size + piece) are dropped, given the upper halves of the keys, which are well mixed."""
        with np.errstate(over="ignore"):
            h = key + code.astype(np.uint32) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
            h *= np.uint32(0xC2B2AE35)
        return h < np.uint32(self.below)

    def skipped(self, key: int, place: int, piece: int) -> bool:
        return bool(self.skips(np.array([key >> 32], np.uint32), np.array([place * self.size + piece]))[0])

    def symbols(self, chars: np.ndarray) -> np.ndarray:
        """Ids of single characters; ``-1 - code point`` of those outside the vocabulary."""
        found = self.char_id[chars]
        return np.where((found < 0) | (chars == ord(SPACE)), -1 - chars.astype(np.int32), found)

    def as_ids(self, symbols: list[int]) -> list[int]:
        out = []
        for s in symbols:
            if s >= 0:
                out.append(s)
            else:
                out += [self.byte_id[b] for b in chr(-1 - s).encode("utf-8", "surrogatepass")]
        return out

    def agenda(self, part: str, occurrence: int) -> list[int]:
        """One part, by a heap of candidate merges."""
        chars = characters(part)
        key, sym = int(self.keys(chars, np.zeros(1, np.int64), np.array([occurrence], np.uint64))[0]), self.symbols(chars).tolist()
        n, end = len(sym), len(sym)
        nxt, prv, ver = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
        heap: list[tuple[int, int, int, int, int, int]] = []

        def offer(a: int) -> None:
            b = nxt[a]
            if b < end and sym[a] >= 0 and sym[b] >= 0:
                m = self.pair_of.get(sym[a] * self.size + sym[b])
                if m is not None and not self.skipped(key, a, m):
                    heapq.heappush(heap, (int(self.rank[m]), a, b, ver[a], ver[b], m))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, b, va, vb, m = heapq.heappop(heap)
            if ver[a] != va or ver[b] != vb:
                continue
            sym[a], nxt[a] = m, nxt[b]
            ver[a] += 1
            ver[b] = -1
            if nxt[a] < end:
                prv[nxt[a]] = a
            if prv[a] >= 0:
                offer(prv[a])
            offer(a)
        out, at = [], 0
        while at < end:
            out.append(sym[at])
            at = nxt[at]
        return self.as_ids(out)

    def slot(self, pairs: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (pairs.astype(np.uint64) * np.uint64(_GOLD) >> np.uint64(45)).astype(np.int64)

    def place(self, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of some pairs, and whether they are there."""
        slot = self.slot(want)
        found = self.first[slot]
        ok = self.pair[found] == want
        again = np.flatnonzero(self.shared[slot] & ~ok)
        if len(again):
            found[again] = np.minimum(np.searchsorted(self.pair, want[again]), len(self.pair) - 1)
            ok[again] = self.pair[found[again]] == want[again]
        return found, ok

    def candidate(self, left: np.ndarray, right: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``size``: none) and piece of the merges of adjacent symbols. ``key``: the parts' dropout keys, or rows of a number and the candidates to drop."""
        want = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.size + right, -1)
        found, ok = self.place(want)
        piece = self.merged[found]
        code = place.astype(np.int64) * self.size + piece
        if key.ndim == 2:
            ok &= ~(key[:, 1:] == code[:, None]).any(1)
            self.seen.append((key[ok, 0] << 32) + code[ok])
        elif self.below:
            ok &= ~self.skips((key >> np.uint64(32)).astype(np.uint32), code)
        return np.where(ok, self.rank[piece], self.size).astype(np.int32), piece.astype(np.int32)

    def with_bytes(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``as_ids`` of rows of symbols, ``counts`` in each."""
        odd = symbols < 0
        if not odd.any():
            return symbols, counts
        spelled = [self.as_ids([s]) for s in symbols[odd].tolist()]
        size = np.ones(len(symbols), np.int64)
        size[odd] = [len(s) for s in spelled]
        out, there = np.empty(int(size.sum()), np.int32), np.repeat(odd, size)
        out[there], out[~there] = np.fromiter(chain.from_iterable(spelled), np.int32), symbols[~odd]
        return out, np.add.reduceat(size, np.cumsum(counts) - counts)  # every part has a symbol

    def together(self, parts: list[str], occurrences) -> list[list[int]]:
        """``merge_all`` as lists."""
        ids, size = self.merge_all(parts, np.asarray(occurrences) if isinstance(occurrences, np.ndarray) else np.array(occurrences, np.uint64))
        flat, ends = ids.tolist(), np.cumsum(size).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def merge_all(self, parts: list[str], occurrences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many parts of at most LONG characters in a row, and how many each has; each round merges the best pair of every part.

        ``occurrences``: their numbers, or a matrix with a row of a number and the candidates to drop for each part.
        """
        out = Runs(np.int32)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        order = np.argsort(lengths, kind="stable")
        for i in range(0, len(order), 8192):
            rows = order[i : i + 8192]
            length = lengths[rows]
            chars = characters("".join([parts[r] for r in rows.tolist()]))
            starts = np.cumsum(length) - length
            key = occurrences[rows] if occurrences.ndim == 2 else self.keys(chars, starts, occurrences[rows])
            n, width = len(rows), int(length.max())
            at = np.repeat(np.arange(n), length)
            col = np.arange(len(chars)) - np.repeat(starts, length)
            # symbols stay in the columns of their first characters, with links to their neighbours
            m = np.full((n, width + 1), -1, np.int32)
            m[at, col] = self.symbols(chars)
            after, before = (np.tile(np.arange(d, width + 1 + d, dtype=np.int32), (n, 1)) for d in (1, -1))
            piece, alive = np.zeros((n, width), np.int32), np.arange(width)[None, :] < length[:, None]
            rank = np.full((n, width), self.size, np.int32)
            rank[at, col], piece[at, col] = self.candidate(m[at, col], m[at, col + 1], key[at], col)
            live = np.arange(n)
            while True:
                best = rank.argmin(1)
                going = rank[np.arange(len(live)), best] < self.size
                if not going.all():
                    rank, live, best = rank[going], live[going], best[going]
                    if not len(live):
                        break
                k, keys = np.arange(len(live)), key[live]
                made, gone = piece[live, best], after[live, best]
                right = after[live, gone]
                m[live, best], after[live, best], before[live, right] = made, right, best
                alive[live, gone], rank[k, gone] = False, self.size
                rank[k, best], piece[live, best] = self.candidate(made, m[live, right], keys, best)
                left = before[live, best]
                some = np.flatnonzero(left >= 0)
                left, rest = left[some], live[some]
                rank[some, left], piece[rest, left] = self.candidate(m[rest, left], made[some], keys[some], left)
            out.add(*self.with_bytes(m[:, :width][alive], alive.sum(1)))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return out.take(back)

    def parts_of(self, text: str | None) -> list[str]:
        """The parts of a text, as keys: a word after a space is itself, a line feed is itself, any other part has a NUL before it."""
        if not text:
            return []
        if not self.lines or "\x00" in text:
            return ["\x00 " + text]
        parts = text.replace("\n", " \n \x00").split(" ")
        if "" in parts or "\x00" in parts or text[0] == "\n":  # spaces next to spaces or line feeds, or at an end
            return [p[1:] if p[0] == " " and p[1:2] not in ("", " ") else p if p == "\n" else "\x00" + p for p in _PARTS.findall(" " + text)]
        return parts

    def encode(self, texts: list[str | None], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts in a row, and where each text's begin and the last one's end; ``keys`` name the documents and copies."""
        group = [self.parts_of(t) for t in texts]
        flat = [p for parts in group for p in parts]
        if self.ids.n > self.most:
            self.clear()
        new = list(set(flat) - self.at.keys())
        if new:
            self.at.update(zip(new, range(self.ids.n, self.ids.n + len(new))))
            self.branch([part_text(p) for p in new], np.empty(0, np.int64), np.zeros(len(new), np.int64))
        node = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        counts = np.array([len(parts) for parts in group], np.int64)
        bounds = np.cumsum(counts)
        inner = np.arange(len(flat)) - np.repeat(bounds - counts, counts)
        doc = np.repeat(np.array([mix_int((k + self.seed * _GOLD) & MASK64) for k in keys], np.uint64), counts)
        with np.errstate(over="ignore"):
            occurrence = mix(doc + inner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        apart = self.long.values[node]
        if self.below:
            self.follow(node, occurrence, apart)
        size = np.where(apart, 0, self.ids.size[node]) if len(node) else np.empty(0, np.int64)
        ids = self.ids.take(node[~apart])[0]
        if apart.any():
            which = np.flatnonzero(apart)
            got = [self.agenda(self.part[node[k]], int(occurrence[k])) for k in which]
            size[which] = [len(g) for g in got]
            every, there = np.empty(int(size.sum()), np.int32), np.repeat(apart, size)
            every[there], every[~there] = np.fromiter(chain.from_iterable(got), np.int32), ids
            ids = every
        return ids, np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], bounds])]

    def follow(self, node: np.ndarray, occurrence: np.ndarray, apart: np.ndarray) -> None:
        """Move each occurrence from its part's first node to that of what it drops; those with too many candidates for a mask become ``apart``."""
        key = (self.with_occurrences(self.hashes.values[node], occurrence) >> np.uint64(32)).astype(np.uint32)
        left = np.flatnonzero(~apart)
        while len(left):
            many = self.offers.size[node[left]] > 62
            apart[left[many]] = True
            left = left[~many & (self.offers.size[node[left]] > 0)]
            if not len(left):
                return
            code, row, bit = self.candidates_of(node[left])
            # a mask of the drops of each occurrence that has some
            drops = np.flatnonzero(self.skips(key[left][row], code))
            if not len(drops):
                return
            row = row[drops]
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            mask, left = np.add.reduceat(np.int64(1) << bit[drops], first), left[row[first]]
            steps = list(zip(node[left].tolist(), mask.tolist()))
            new = list(set(steps) - self.child.keys())
            if new:
                at, masks = np.array([n for n, _ in new]), np.array([m for _, m in new])
                code, row, bit = self.candidates_of(at)
                told = (masks[row] >> bit) & 1 == 1
                old, size = self.drops.take(at)
                rows = np.concatenate([np.repeat(np.arange(len(at)), size), row[told]])
                self.child.update(zip(new, range(self.ids.n, self.ids.n + len(new))))
                self.branch([self.part[n] for n in at.tolist()], np.concatenate([old, code[told]])[np.argsort(rows, kind="stable")], np.bincount(rows, minlength=len(at)))
            node[left] = np.fromiter(map(self.child.__getitem__, steps), np.int64, len(steps))

    def candidates_of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The candidates offered in some nodes, each with its node's place in ``nodes`` and its own among that node's."""
        code, size = self.offers.take(nodes)
        return code, np.repeat(np.arange(len(nodes)), size), np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def _shared(spark: SparkSession, model_file: str, dropout: float, seed: int):
    with open(model_file, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    return lambda: pieces_for(model.value, dropout, seed)


def document_keys(column: pa.Array, copies: pa.Array | None = None) -> list[int]:
    keys = [-1 & MASK64 if k is None else k & MASK64 for k in column.to_pylist()]
    return keys if copies is None else [(k + (c or 0) * 0xA0761D6478BD642F) & MASK64 for k, c in zip(keys, copies.to_pylist())]


def encode(docs: DataFrame, model_file: str, dropout: float = 0.1, seed: int = 7) -> DataFrame:
    """``docs`` with ``ids``, from its doc_id and text and, if there is one, the number ``copy`` of a repeated row."""
    get = _shared(docs.sparkSession, model_file, dropout, seed)
    docs = docs.drop("ids")
    at = docs.columns.index("text"), docs.columns.index("doc_id")
    copy = docs.columns.index("copy") if "copy" in docs.columns else None

    def run(batch: pa.RecordBatch):
        for some in slices(batch, at[0]):
            texts = some.column(at[0]).to_pylist()
            ids, offsets = get().encode(texts, document_keys(some.column(at[1]), None if copy is None else some.column(copy)))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=pa.array([t is None for t in texts]))
            yield pa.RecordBatch.from_arrays([*some.columns, lists], names=[*some.schema.names, "ids"])

    return map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, model_file: str, into: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ``ids``."""
    get = _shared(encoded.sparkSession, model_file, 0.0, 0)
    encoded = encoded.drop(into)
    at = encoded.columns.index("ids")

    def run(batch: pa.RecordBatch):
        for i in range(0, batch.num_rows, 256):
            some = batch.slice(i, 256)
            texts = [None if x is None else get().decode(x) for x in some.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], names=[*some.schema.names, into])

    return map_batches(encoded, run, T.StructType([*encoded.schema.fields, T.StructField(into, T.StringType())]))


def round_trip(docs: DataFrame, model_file: str, dropout: float = 0.1, seed: int = 7) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian 32-bit ids), decoded_sha256 and lossless of every row."""
    import hashlib

    get = _shared(docs.sparkSession, model_file, dropout, seed)

    def run(batch: pa.RecordBatch):
        for some in slices(batch, 1):
            texts = some.column(1).to_pylist()
            ids, offsets = get().encode(texts, document_keys(some.column(0)))
            crc, sha, same = [], [], []
            for t, a, b in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist()):
                back = None if t is None else get().decode(ids[a:b].tolist())
                crc.append(zlib.crc32(ids[a:b].astype("<i4").tobytes()))
                sha.append(None if back is None else hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                same.append(back == t)
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.diff(offsets)), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same)], names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "lossless"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean")
