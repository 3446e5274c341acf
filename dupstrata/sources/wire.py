"""Records of the trace formats as bytes, in plain Python: length-delimited protobuf, the legacy binary, and UBC text.

A record is (filename, size, type, label, partial, chunks); a chunk is (size, fingerprint, hash or None).
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from typing import BinaryIO, NamedTuple


class Chunk(NamedTuple):
    size: int
    fp: bytes
    hash: int | None = None


class Record(NamedTuple):
    filename: str
    size: int
    type: str
    label: str | None
    partial: bool
    chunks: list[Chunk]


class Truncated(Exception):
    """The input ends inside a record."""


# Field numbers of the messages, and the legacy format's record size and largest chunk.
FILE_FIELDS = {"filename": 1, "size": 2, "type": 3, "chunk_count": 4, "label": 5, "partial": 6}
CHUNK_FIELDS = {"fp": 2, "size": 3, "hash": 4}
LEGACY_RECORD, LEGACY_LARGEST = 24, 65536
UBC_END = "LOGCOMPLETE"


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(f: BinaryIO) -> int | None:
    """None at the end of the input."""
    n = shift = 0
    while True:
        b = f.read(1)
        if not b:
            if shift:
                raise Truncated
            return None
        n |= (b[0] & 0x7F) << shift
        if b[0] < 0x80:
            return n
        shift += 7
        if shift > 63:
            raise ValueError("a varint is too long")


def fields(message: bytes) -> dict[int, int | bytes]:
    """Field number to its last value; unknown ones are kept and do no harm."""
    out: dict[int, int | bytes] = {}
    at = 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            if at >= len(message):
                raise Truncated
            b = message[at]
            at += 1
            n |= (b & 0x7F) << shift
            if b < 0x80:
                return n
            shift += 7

    while at < len(message):
        tag = number()
        kind = tag & 7
        if kind == 0:
            out[tag >> 3] = number()
        elif kind in (1, 2, 5):
            n = number() if kind == 2 else 8 if kind == 1 else 4
            if at + n > len(message):
                raise Truncated
            out[tag >> 3] = message[at : at + n]
            at += n
        else:
            raise ValueError(f"wire type {kind}")
    return out


def delimited(f: BinaryIO) -> bytes | None:
    n = read_varint(f)
    if n is None:
        return None
    raw = f.read(n)
    if len(raw) < n:
        raise Truncated
    return raw


def _chunk(raw: bytes) -> Chunk:
    got = fields(raw)
    h = got.get(CHUNK_FIELDS["hash"])
    return Chunk(int(got.get(CHUNK_FIELDS["size"], 0)), bytes(got.get(CHUNK_FIELDS["fp"], b"")), None if h is None else h - (1 << 64) if h >> 63 else h)


def read_protobuf(f: BinaryIO, mode: str = "FALLBACK") -> Iterator[Record]:
    """Records up to the end or to where the input breaks off. A record without a name is, in mode FALLBACK, a stray chunk and gets a file of its own; FAILFAST raises for both."""
    stray = 0
    while True:
        try:
            raw = delimited(f)
            if raw is None:
                return
            got = fields(raw)
            text = lambda k: bytes(got.get(FILE_FIELDS[k], b"")).decode("utf-8", "replace")  # noqa: B023, E731
            name = text("filename") if isinstance(got.get(1, b""), bytes) else ""
            if not name:
                if mode == "FAILFAST":
                    raise ValueError("a file record has no name")
                stray += 1
                c = _chunk(raw)
                yield Record(f"FALLBACK {stray}", c.size, "FALLBACK", None, False, [c])
                continue
            chunks = []
            for _ in range(int(got.get(FILE_FIELDS["chunk_count"], 0))):
                part = delimited(f)
                if part is None:
                    raise Truncated
                chunks.append(_chunk(part))
            yield Record(name, int(got.get(FILE_FIELDS["size"], 0)), text("type"), text("label") if FILE_FIELDS["label"] in got else None, bool(got.get(FILE_FIELDS["partial"], 0)), chunks)
        except Truncated:
            if mode == "FAILFAST":
                raise
            return


def write_protobuf(f: BinaryIO, records: Iterable[Record]) -> int:
    n = 0
    string = lambda k, b: varint(k << 3 | 2) + varint(len(b)) + b
    number = lambda k, v: varint(k << 3) + varint(v)
    for r in records:
        head = string(1, r.filename.encode()) + number(2, r.size) + string(3, (r.type or "").encode()) + number(4, len(r.chunks))
        head += string(5, r.label.encode()) if r.label is not None else b""
        head += number(6, 1) if r.partial else b""
        f.write(varint(len(head)) + head)
        for c in r.chunks:
            body = string(2, c.fp) + number(3, c.size) + (number(4, c.hash) if c.hash is not None else b"")
            f.write(varint(len(body)) + body)
        n += 1
    return n


def read_legacy(f: BinaryIO) -> Iterator[Record]:
    """A text line `name TAB size [TAB type]`, then chunk records, an end byte and a separator."""
    while line := f.readline():
        head = line.decode("iso-8859-1").rstrip("\r\n").split("\t")
        if len(head) < 2:
            return
        chunks = []
        while True:
            kind = f.read(1)
            if not kind or kind[0] in (0, 255):
                break
            if kind[0] != LEGACY_RECORD:
                raise ValueError(f"a chunk record of {kind[0]} bytes")
            raw = f.read(LEGACY_RECORD)
            if len(raw) < LEGACY_RECORD:
                break
            size = struct.unpack("<i", raw[:4])[0]
            if not 0 <= size < LEGACY_LARGEST:
                raise ValueError(f"a chunk of {size} bytes")
            chunks.append(Chunk(size, raw[4:]))
        f.read(1)
        yield Record(head[0], int(head[1]), head[2] if len(head) > 2 else "", None, False, chunks)


def write_legacy(f: BinaryIO, records: Iterable[Record]) -> int:
    raise NotImplementedError("the legacy format is read only")


def _ubc_chunk(line: str) -> Chunk:
    """`digest:size`, the digest in lower-case hex or, from a z on, as it stands; anything else raises."""
    digest, colon, size = line.partition(":")
    if not colon or not digest or set(digest) - set("0123456789abcdefz") or not size.isascii() or not size.isdigit():
        raise ValueError(f"an illegal chunk line: {line!r}")
    return Chunk(int(size), digest.encode() if digest[0] == "z" else bytes.fromhex(digest))


def read_ubc(f: BinaryIO) -> Iterator[Record]:
    """Text: a header to a blank line; for each file three lines (directory, name, extension: what stands before a colon counts), a skipped one, the size, seven skipped ones, lines that begin SV:, V: or A: skipped, chunk lines to a blank one.

    The name is the three hashes joined, the type the extension's, the size the sum of the chunks. A file that breaks off before its chunks ends the input; an illegal chunk line raises.
    """
    lines = (x.decode("iso-8859-1").strip() for x in f)
    for line in lines:
        if not line:
            break
    for first in lines:
        if first == UBC_END:
            return
        if not first:
            continue
        try:
            folder, name, suffix = (x.partition(":")[0] for x in (first, next(lines), next(lines)))
            for _ in range(9):
                next(lines)
        except StopIteration:
            return
        chunks = []
        for line in lines:
            if not line:
                break
            if chunks or not line.startswith(("SV:", "V:", "A:")):
                chunks.append(_ubc_chunk(line))
        yield Record(folder + name + suffix, sum(c.size for c in chunks), suffix, None, False, chunks)


READERS = {"protobuf": read_protobuf, "legacy": read_legacy, "ubc": read_ubc}
WRITERS = {"protobuf": write_protobuf, "legacy": write_legacy}
