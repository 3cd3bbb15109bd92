"""Parquet footers as plain structures, so that encoded column blocks can be copied without decoding them.

The footer is Thrift's compact protocol. It is read into generic structures (field number to type and
value) and written back, which keeps every field, known here or not. Field numbers are those of the
public Parquet format.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass
from typing import Any, BinaryIO

MAGIC = b"PAR1"

# Types of the compact protocol.
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)


class CompactReader:
    """Reads one value after another from a buffer."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def value(self, kind: int, in_list: bool = False) -> Any:
        if kind in (TRUE, FALSE):
            if in_list:
                self.at += 1
                return self.data[self.at - 1] == TRUE
            return kind == TRUE
        if kind == BYTE:
            self.at += 1
            return struct.unpack_from("<b", self.data, self.at - 1)[0]
        if kind in (I16, I32, I64):
            return self.zigzag()
        if kind == DOUBLE:
            self.at += 8
            return struct.unpack_from("<d", self.data, self.at - 8)[0]
        if kind == BINARY:
            n = self.varint()
            self.at += n
            return self.data[self.at - n : self.at]
        if kind in (LIST, SET):
            head = self.data[self.at]
            self.at += 1
            n, item = head >> 4, head & 15
            if n == 15:
                n = self.varint()
            return item, [self.value(item, True) for _ in range(n)]
        if kind == MAP:
            n = self.varint()
            if not n:
                return 0, 0, []
            kinds = self.data[self.at]
            self.at += 1
            return kinds >> 4, kinds & 15, [(self.value(kinds >> 4, True), self.value(kinds & 15, True)) for _ in range(n)]
        if kind == STRUCT:
            return self.struct()
        raise ValueError(f"unknown type {kind} in a footer")

    def struct(self) -> dict[int, tuple[int, Any]]:
        out, number = {}, 0
        while head := self.data[self.at]:
            self.at += 1
            kind = head & 15
            number = number + (head >> 4) if head >> 4 else self.zigzag()
            out[number] = (kind, self.value(kind))
        self.at += 1
        return out


class CompactWriter:
    """Writes what CompactReader reads."""

    def __init__(self):
        self.out = bytearray()

    def varint(self, n: int) -> None:
        while n > 0x7F:
            self.out.append(n & 0x7F | 0x80)
            n >>= 7
        self.out.append(n)

    def zigzag(self, n: int) -> None:
        self.varint((n << 1) ^ (n >> 63) if n < 0 else n << 1)

    def value(self, kind: int, x: Any, in_list: bool = False) -> None:
        if kind in (TRUE, FALSE):
            if in_list:
                self.out.append(TRUE if x else FALSE)
        elif kind == BYTE:
            self.out += struct.pack("<b", x)
        elif kind in (I16, I32, I64):
            self.zigzag(x)
        elif kind == DOUBLE:
            self.out += struct.pack("<d", x)
        elif kind == BINARY:
            self.varint(len(x))
            self.out += x
        elif kind in (LIST, SET):
            item, items = x
            self.out.append((min(len(items), 15) << 4) | item)
            if len(items) >= 15:
                self.varint(len(items))
            for y in items:
                self.value(item, y, True)
        elif kind == MAP:
            k, v, pairs = x
            self.varint(len(pairs))
            if pairs:
                self.out.append((k << 4) | v)
                for a, b in pairs:
                    self.value(k, a, True)
                    self.value(v, b, True)
        elif kind == STRUCT:
            self.struct(x)
        else:
            raise ValueError(f"unknown type {kind}")

    def struct(self, fields: dict[int, tuple[int, Any]]) -> None:
        before = 0
        for number, (kind, x) in sorted(fields.items()):
            if kind in (TRUE, FALSE):
                kind = TRUE if x else FALSE
            if 0 < number - before < 16:
                self.out.append((number - before) << 4 | kind)
            else:
                self.out.append(kind)
                self.zigzag(number)
            self.value(kind, x)
            before = number
        self.out.append(0)


@dataclass
class Footer:
    """The footer of one file: its fields, and what copying needs to know of them."""

    fields: dict[int, tuple[int, Any]]

    @property
    def rows(self) -> int:
        return self.fields[3][1]

    @property
    def blocks(self) -> list[dict]:
        return self.fields[4][1][1]

    @property
    def fingerprint(self) -> str:
        """Equal for files whose blocks may stand in one file: the same schema, to the letter."""
        out = CompactWriter()
        out.value(*self.fields[2])
        return hashlib.sha256(bytes(out.out)).hexdigest()


def read_footer(f: BinaryIO, size: int) -> Footer:
    """The footer of an open file; ValueError if it is no Parquet file or is encrypted."""
    if size < 12:
        raise ValueError("no Parquet file: shorter than its frame")
    f.seek(size - 8)
    tail = f.read(8)
    length = int.from_bytes(tail[:4], "little")
    if tail[4:] != MAGIC or length > size - 12:
        raise ValueError("no Parquet file, or an encrypted one")
    f.seek(size - 8 - length)
    return Footer(CompactReader(f.read(length)).struct())


def _chunk_range(chunk: dict) -> tuple[int, int]:
    """First byte and length of a column chunk's pages."""
    meta = chunk[3][1]
    start = meta[9][1]
    if 11 in meta and 0 < meta[11][1] < start:
        start = meta[11][1]
    return start, meta[7][1]


class BlockFile:
    """A Parquet file under construction from the row groups of others."""

    #: Bytes copied at a time.
    STEP = 8 << 20

    def __init__(self, sink: BinaryIO):
        self.sink, self.at, self.first, self.groups, self.rows = sink, len(MAGIC), None, [], 0
        sink.write(MAGIC)

    def append(self, source: BinaryIO, footer: Footer) -> int:
        """Copies all row groups of a file; its fingerprint must equal that of those before. Returns the bytes copied.

        Page indexes and Bloom filters hold positions in the old file and are left out of the new footer.
        """
        if self.first is None:
            self.first = footer
        elif footer.fingerprint != self.first.fingerprint:
            raise ValueError("the schemas differ")
        copied = 0
        for block in footer.blocks:
            chunks = []
            for chunk in block[1][1][1]:
                if 1 in chunk or 8 in chunk or 9 in chunk:
                    raise ValueError("column chunks in other files, or encrypted ones, can't be copied")
                start, length = _chunk_range(chunk)
                meta = dict(chunk[3][1])
                shift = self.at + copied - start
                for field in (9, 10, 11):
                    if field in meta:
                        kind, value = meta[field]
                        meta[field] = (kind, value + shift if value > 0 else value)
                for field in (14, 15):
                    meta.pop(field, None)
                source.seek(start)
                left = length
                while left:
                    part = source.read(min(left, self.STEP))
                    if not part:
                        raise ValueError("a column chunk ends before its length")
                    self.sink.write(part)
                    left -= len(part)
                copied += length
                moved = {k: v for k, v in chunk.items() if k not in (4, 5, 6, 7)}
                moved[2] = (I64, 0)
                moved[3] = (STRUCT, meta)
                chunks.append(moved)
            new = dict(block)
            new[1] = (LIST, (STRUCT, chunks))
            new.pop(7, None)
            if 5 in new:
                new[5] = (I64, _chunk_range(chunks[0])[0] if chunks else self.at)
            self.groups.append(new)
        self.at += copied
        self.rows += footer.rows
        return copied

    def close(self) -> int:
        """Writes the footer; returns the size of the file."""
        fields = dict(self.first.fields)
        fields[3] = (I64, self.rows)
        fields[4] = (LIST, (STRUCT, self.groups))
        out = CompactWriter()
        out.struct(fields)
        self.sink.write(bytes(out.out) + len(out.out).to_bytes(4, "little") + MAGIC)
        return self.at + len(out.out) + 8
