"""Files of a store as Python tasks see them: listing, ranged reads, zip archives by their directory, and archives put together from parts.

Tasks read byte ranges through ``pyarrow.fs`` (local files, HDFS, S3, GCS), so nothing is held but a chunk. A store that only Spark's own
readers can open isn't reachable from here; ``reachable`` tells.
"""

from __future__ import annotations

import io
import os
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs as stores

CHUNK = 1 << 16
STORED, DEFLATED = 0, 8
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


def at(path: str) -> tuple[stores.FileSystem, str]:
    """The store of a path and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        path = os.path.abspath(path)
    elif path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return stores.FileSystem.from_uri(path)


def reachable(path: str) -> bool:
    try:
        store, inside = at(path)
        return store.get_file_info(inside).type != stores.FileType.NotFound
    except (OSError, ValueError, NotImplementedError):
        return False


def listing(path: str, ends: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, size) of the files under ``path``, or of itself, with one of the ``ends`` in any case, in name order."""
    store, inside = at(path)
    info = store.get_file_info(inside)
    if info.type == stores.FileType.File:
        return [(path, info.size)]
    prefix = path.rstrip("/")
    found = store.get_file_info(stores.FileSelector(inside, recursive=True)) if info.type == stores.FileType.Directory else []
    base = inside.rstrip("/")
    return sorted((prefix + f.path[len(base) :], f.size) for f in found if f.type == stores.FileType.File and f.base_name.lower().endswith(ends) and not f.base_name.startswith(("_", ".")))


class Counted:
    """Chunks of a byte range of a file, and how many bytes were read of it."""

    def __init__(self, path: str, start: int = 0, end: int | None = None, chunk: int = CHUNK):
        self.path, self.start, self.end, self.chunk, self.bytes = path, start, end, chunk, 0

    def __iter__(self) -> Iterator[bytes]:
        store, inside = at(self.path)
        with store.open_input_file(inside) as f:
            f.seek(self.start)
            left = (f.size() if self.end is None else self.end) - self.start
            while left > 0:
                data = f.read(min(self.chunk, left))
                if not data:
                    return
                left -= len(data)
                self.bytes += len(data)
                yield data


@dataclass(frozen=True)
class Entry:
    """An entry of an archive, as its central directory tells."""

    archive: str
    name: str
    offset: int
    packed: int
    size: int
    method: int
    crc: int
    encrypted: bool


def entries(path: str) -> list[Entry]:
    """The entries of an archive by name; only its directory is read."""
    store, inside = at(path)
    with store.open_input_file(inside) as f, zipfile.ZipFile(f) as z:
        return sorted((Entry(path, i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC, bool(i.flag_bits & 1)) for i in z.infolist() if not i.is_dir()), key=lambda e: e.name)


def unpacked(e: Entry, source: Counted | None = None) -> Iterator[bytes]:
    """The content of an entry, chunk by chunk, by one ranged read; its checksum is tested at the end."""
    if e.encrypted or e.method not in (STORED, DEFLATED):
        raise zipfile.BadZipFile("encrypted" if e.encrypted else f"method {e.method}")
    store, inside = at(e.archive)
    with store.open_input_file(inside) as f:
        f.seek(e.offset)
        head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile("no entry where the directory says")
    name, extra = struct.unpack("<HH", head[26:30])
    source = source or Counted(e.archive)
    source.path, source.start = e.archive, e.offset + 30 + name + extra
    source.end = source.start + e.packed
    crc = 0
    expand = zlib.decompressobj(-15) if e.method == DEFLATED else None
    for data in source:
        while data:
            out = expand.decompress(data, 4 * CHUNK) if expand else data
            data = expand.unconsumed_tail if expand else b""
            if out:
                crc = zlib.crc32(out, crc)
                yield out
    if expand:
        out = expand.flush()
        crc = zlib.crc32(out, crc)
        yield out
    if crc != e.crc:
        raise zipfile.BadZipFile("checksum")


# archives from parts

_POLY = 0xEDB88320  # fixed: the polynomial of the zip checksum, bits reversed


def _times(a: int, b: int) -> int:
    """The product of two polynomials over bits, modulo the checksum's."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """The checksum of two texts in a row from theirs and the second's ``length``: the first's is moved on by 8 ``length`` bits."""
    moved, step, n = 1 << 31, 1 << 23, length  # 1, x ** 8
    while n:
        if n & 1:
            moved = _times(step, moved)
        step = _times(step, step)
        n >>= 1
    return _times(moved, first) ^ second


@dataclass(frozen=True)
class Part:
    """A written part of a document: its file, place in order, bytes in the file, bytes of its text, and their checksum."""

    path: str
    order: int
    packed: int
    size: int
    crc: int


class PartWriter:
    """Writes one part; deflated ones end on a byte, without a last block, so that parts of one document stand in a row."""

    def __init__(self, path: str, order: int, deflate: bool):
        self.path, self.order, self.deflate = path, order, deflate
        store, inside = at(path)
        store.create_dir(os.path.dirname(inside), recursive=True)
        self.out = store.open_output_stream(inside)
        self.pack = zlib.compressobj(6, zlib.DEFLATED, -15) if deflate else None
        self.packed = self.size = self.crc = 0
        self.held: list[bytes] = []
        self.n_held = 0

    def _put(self, data: bytes) -> None:
        if data:
            self.packed += len(data)
            self.out.write(data)

    def write(self, text: bytes) -> None:
        self.held.append(text)
        self.n_held += len(text)
        if self.n_held >= CHUNK:
            self._flush()

    def _flush(self) -> None:
        data = b"".join(self.held)
        self.held, self.n_held = [], 0
        self.size += len(data)
        self.crc = zlib.crc32(data, self.crc)
        self._put(self.pack.compress(data) if self.pack else data)

    def close(self) -> Part:
        self._flush()
        if self.pack:
            self._put(self.pack.flush(zlib.Z_FULL_FLUSH))
        self.out.close()
        return Part(self.path, self.order, self.packed, self.size, self.crc)


def _moved_in(out, parts: Iterable[Part]) -> None:
    for p in parts:
        for data in Counted(p.path, chunk=1 << 22):
            out.write(data)


def put_together(path: str, parts: list[Part]) -> None:
    """One file from parts in order. It gets its name when it is whole, so a task that is run again leaves one file."""
    store, inside = at(path)
    mine = f"{inside}.{os.urandom(8).hex()}.part"
    store.create_dir(os.path.dirname(inside), recursive=True)
    with store.open_output_stream(mine) as out:
        _moved_in(out, sorted(parts, key=lambda p: p.order))
    store.move(mine, inside)


def _wide(values: list[int]) -> tuple[list[int], bytes]:
    """Values as they stand in 32-bit fields, and the extra field with those that don't fit."""
    over = [v for v in values if v >= _FULL32]
    return [min(v, _FULL32) for v in values], struct.pack(f"<HH{len(over)}Q", 1, 8 * len(over), *over) if over else b""


def archived(path: str, documents: list[tuple[str, list[Part]]]) -> None:
    """A zip archive of documents (name, deflated parts) in the given order: headers, the parts as they are, and the directory."""
    store, inside = at(path)
    mine = f"{inside}.{os.urandom(8).hex()}.part"
    store.create_dir(os.path.dirname(inside), recursive=True)
    directory, place = io.BytesIO(), 0
    with store.open_output_stream(mine) as out:
        for name, parts in documents:
            parts = sorted(parts, key=lambda p: p.order)
            crc = size = 0
            for p in parts:
                crc, size = joined_crc(crc, p.crc, p.size), size + p.size
            packed, text = sum(p.packed for p in parts) + 2, name.encode()  # 2: the empty last block
            wide = packed >= _FULL32 or size >= _FULL32
            extra = struct.pack("<HHQQ", 1, 16, size, packed) if wide else b""
            fields = (0x800, DEFLATED, 0, 0x21, crc, *((_FULL32, _FULL32) if wide else (packed, size)), len(text))
            head = struct.pack("<4s5H3L2H", b"PK\x03\x04", 45 if wide else 20, *fields, len(extra)) + text + extra
            out.write(head)
            _moved_in(out, parts)
            out.write(b"\x03\x00")
            (short_size, short_packed, short_place), extra = _wide([size, packed, place])
            directory.write(struct.pack("<4s6H3L5H2L", b"PK\x01\x02", 45, 45 if extra else 20, 0x800, DEFLATED, 0, 0x21, crc, short_packed, short_size, len(text), len(extra), 0, 0, 0, 0, short_place) + text + extra)
            place += len(head) + packed
        listed = directory.getvalue()
        out.write(listed)
        n, end = len(documents), place + len(listed)
        if n >= _FULL16 or place >= _FULL32 or len(listed) >= _FULL32:
            out.write(struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, len(listed), place) + struct.pack("<4sLQL", b"PK\x06\x07", 0, end, 1))
        out.write(struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, min(n, _FULL16), min(n, _FULL16), min(len(listed), _FULL32), min(place, _FULL32), 0))
    store.move(mine, inside)
