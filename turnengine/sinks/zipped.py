"""Zip archives put together from pieces that tasks deflate: every piece is inflated without those before it, so the text of
an entry can be made in any number of tasks and its bytes copied one behind the other."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

#: Fixed values of the format: what ends a deflated text, the first day that a date can be, the largest 32-bit and 16-bit fields.
LAST, _DAY, _MAX32, _MAX16 = b"\x03\x00", 0x21, 0xFFFFFFFF, 0xFFFF
#: The polynomial of CRC-32, and x^0 and x^8 modulo it, lowest power in the highest bit (fixed values).
_POLYNOMIAL, _ONE, _BYTE = 0xEDB88320, 1 << 31, 1 << 23


def deflated(text: bytes) -> bytes:
    """text as deflated blocks that others may follow, none of which refers to what stands before."""
    packer = zlib.compressobj(wbits=-15)
    return packer.compress(text) + packer.flush(zlib.Z_FULL_FLUSH)


def _product(a: int, b: int) -> int:
    out = 0
    while a:
        if a & _ONE:
            out ^= b
        a = a << 1 & _MAX32
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def joined_crc(parts: Iterable[tuple[int, int]]) -> int:
    """CRC-32 of texts one behind the other, by (CRC-32, length) of each."""
    whole = 0
    for crc, length in parts:
        shift, power = _ONE, _BYTE
        while length:
            if length & 1:
                shift = _product(shift, power)
            power, length = _product(power, power), length >> 1
        whole = _product(whole, shift) ^ crc
    return whole


@dataclass(frozen=True)
class Entry:
    """A deflated file of an archive: packed and length are its bytes with and without deflation."""

    name: str
    crc: int
    packed: int
    length: int

    def _fields(self, extra: bytes, large: bool) -> tuple:
        sizes = (_MAX32, _MAX32) if large else (self.packed, self.length)
        return (45 if extra else 20, 0x800, 8, 0, _DAY, self.crc, *sizes, len(self.name.encode()), len(extra))

    @property
    def _large(self) -> bool:
        return max(self.packed, self.length) >= _MAX32

    def header(self) -> bytes:
        """What stands before its bytes."""
        extra = struct.pack("<2H2Q", 1, 16, self.length, self.packed) if self._large else b""
        return struct.pack("<4s5H3I2H", b"PK\3\4", *self._fields(extra, self._large)) + self.name.encode() + extra

    def listed(self, offset: int) -> bytes:
        """Its line in the archive's directory; offset is where its header stands."""
        wide = ([self.length, self.packed] if self._large else []) + ([offset] if offset >= _MAX32 else [])
        extra = struct.pack(f"<2H{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
        return struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, *self._fields(extra, self._large), 0, 0, 0, 0, min(offset, _MAX32)) + self.name.encode() + extra


def end(count: int, size: int, offset: int) -> bytes:
    """What ends an archive of count entries, whose directory of size bytes stands at offset."""
    wide = b""
    if count >= _MAX16 or size >= _MAX32 or offset >= _MAX32:
        wide = struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, count, count, size, offset) + struct.pack("<4sIQI", b"PK\6\7", 0, offset + size, 1)
    return wide + struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, min(count, _MAX16), min(count, _MAX16), min(size, _MAX32), min(offset, _MAX32), 0)
