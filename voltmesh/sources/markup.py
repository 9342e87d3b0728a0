"""Markup read as a stream, for tasks that stop early or can't cut a file at every ``>``: tokens as chunks come, and the header of a document."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterable, Iterator

MD = "http://iec.ch/TC57/61970-552/ModelDescription/1#"
DM = "http://iec.ch/TC57/61970-552/DifferenceModel/1#"
_TAG = re.compile(r"<[^<>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^<>\"']*+)*+")
#: A tag that is no comment, CDATA section, instruction or declaration, with the text before it; for Python and Java.
PLAIN = r"[^<]*+<[^<>\"'!?][^<>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^<>\"']*+)*+>"
_PLAINS = re.compile(f"(?:{PLAIN})*+")
_BRACKETS = (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?", "?>"))
_LONGEST = max(len(b) for b, _ in _BRACKETS)
_DECLARED = re.compile(rb"^\s*<\?xml[^>]*encoding\s*=\s*[\"']([A-Za-z0-9._-]+)")
_XMLNS = re.compile(r"\sxmlns(?::([\w.-]+))?\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_ENTITY = re.compile(r"&(?:(lt|gt|quot|apos|amp)|#([0-9]{1,7})|#x([0-9a-fA-F]{1,6}));")
_NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def decoded(chunks: Iterable[bytes]) -> Iterator[str]:
    """Text of a document's bytes: by its byte order mark, its declaration, or as UTF-8."""
    decoder = None
    for chunk in chunks:
        if decoder is None:
            name = "utf-16" if chunk[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig"
            declared = _DECLARED.match(chunk)
            if declared and name == "utf-8-sig" and declared.group(1).lower() not in (b"utf-8", b"utf8"):
                name = declared.group(1).decode()
            decoder = codecs.getincrementaldecoder(name)()
        text = decoder.decode(chunk)
        if text:
            yield text
    if decoder is not None:
        yield decoder.decode(b"", True)


def _token_end(buffer: str, at: int, final: bool) -> int:
    """Where the token that begins at ``at`` ends; -1 if the buffer doesn't tell."""
    open_ = buffer.find("<", at)
    if open_ < 0 or (len(buffer) - open_ < _LONGEST and not final):
        return -1
    for begin, close in _BRACKETS:
        if buffer.startswith(begin, open_):
            end = buffer.find(close, open_ + len(begin))
            return end + len(close) if end >= 0 else -1
    end = _TAG.match(buffer, open_).end()
    if end < len(buffer) and buffer[end] == "<":
        return open_ + 1  # a stray sign
    return end + 1 if end < len(buffer) and buffer[end] == ">" else -1


def tokens(chunks: Iterable[str]) -> Iterator[str]:
    """Every tag, comment, CDATA section or instruction with the text before it; what is left at the end is one more. Holds a chunk and a token."""
    buffer, at = "", 0

    def ends(final: bool) -> Iterator[str]:
        nonlocal at
        while (end := _token_end(buffer, at, final)) >= 0:
            yield buffer[at:end]
            at = end

    for chunk in chunks:
        buffer, at = buffer[at:] + chunk, 0
        yield from ends(False)
    yield from ends(True)
    if at < len(buffer):
        yield buffer[at:]


def blocks(chunks: Iterable[str]) -> Iterator[tuple[bool, str]]:
    """The same tokens, with runs of plain tags and their texts uncut: whether a text is such a run (each match of ``PLAIN`` is a token), or one token."""
    buffer = ""

    def found(final: bool) -> Iterator[tuple[bool, str]]:
        nonlocal buffer
        at = 0
        while True:
            end = _PLAINS.match(buffer, at).end()
            if end > at:
                yield True, buffer[at:end]
            at, end = end, _token_end(buffer, end, final)
            if end < 0:
                buffer = buffer[at:]
                return
            yield False, buffer[at:end]
            at = end

    for chunk in chunks:
        buffer += chunk
        yield from found(False)
    yield from found(True)
    if buffer:
        yield False, buffer


def unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        if m.group(1):
            return _NAMED[m.group(1)]
        code = int(m.group(2)) if m.group(2) else int(m.group(3), 16)
        fine = 32 <= code < 0xD800 or code in (9, 10, 13) or 0xE000 <= code < 0xFFFE or 0x10000 <= code < 0x110000
        return chr(code) if fine else m.group()

    return _ENTITY.sub(one, text)


def attribute(tag: str, local: str) -> str | None:
    m = re.search(rf"\s(?:[\w.-]+:)?{local}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", tag)
    return unescaped(m.group(1) if m.group(1) is not None else m.group(2)) if m else None


def declarations(found: Iterable[str]) -> Iterator[list[tuple[str, str]]]:
    """The (prefix, namespace) pairs of each start tag that has any."""
    for token in found:
        tag = token[token.find("<") :] if "<" in token else ""
        if "xmlns" in tag and tag[1:2] not in ("!", "?", "/"):
            yield [(m.group(1) or "", unescaped(m.group(2) if m.group(2) is not None else m.group(3))) for m in _XMLNS.finditer(tag)]


def header(found: Iterable[str]) -> tuple[bool, dict | None]:
    """Whether there is an RDF root, and the header: kind, id and fields (ns, local, resource, text) in order. Nothing is read after the header's end tag."""
    depth, root, prefixes = 0, None, {}
    head: dict | None = None
    field: dict | None = None
    for token in found:
        cut = token.find("<")
        text, tag = (token, "") if cut < 0 else (token[:cut], token[cut:])
        cdata = tag.startswith("<![CDATA[")
        other = not tag or cdata or tag[1:2] in ("!", "?") or tag == "<"
        close, empty = tag.startswith("</"), tag.rstrip(">").rstrip().endswith("/") and tag.endswith(">")
        start = not other and not close
        if field is not None and depth == root + 3:
            field["text"] += unescaped(text) + (tag[9:-3] if cdata and tag.endswith("]]>") else "")
        if start:
            for prefix, ns in ((m.group(1) or "", m.group(2) if m.group(2) is not None else m.group(3)) for m in _XMLNS.finditer(tag)):
                prefixes.setdefault(prefix, unescaped(ns))
            name = re.match(r"</?([^\s/>]*)", tag).group(1)
            prefix, _, local = name.rpartition(":")
            ns = prefixes.get(prefix.split(":")[0] if prefix else "", "")
            if root is None:
                root = depth if local == "RDF" else None
            elif head is None and depth == root + 1 and (ns, local) in ((MD, "FullModel"), (DM, "DifferenceModel")):
                head = {"kind": "full" if local == "FullModel" else "difference", "id": attribute(tag, "about"), "fields": []}
                if empty:
                    return True, head
            elif head is not None and depth == root + 2 and ns != DM:
                field = {"ns": ns, "local": local, "resource": attribute(tag, "resource"), "text": ""}
                head["fields"].append(field)
                field = None if empty else field
        depth += start and not empty
        depth -= close
        if close and head is not None and root is not None:
            if depth == root + 2:
                field = None
            elif depth <= root + 1:
                return True, head
    return root is not None, head
