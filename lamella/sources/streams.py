"""Byte ranges of plain and gzip files without inflating or holding all of them.

A gzip file may be a row of members, each a stream of its own. The blocked layout (a subfield `BC` in every member's
header that gives the member's size, 64 KB of data at most; fixed values of the format) lets a reader hop from member to
member by their headers and inflate only those that hold the range: they are the access points. Every gzip reader reads
such files. A gzip file of another layout is inflated from its start up to the end of the range, a piece at a time.
"""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

PIECE = 1 << 20
#: Data of a member, its header, and the empty member that ends a blocked file (fixed by the format).
BLOCK = 0xFF00
_HEAD = struct.Struct("<4BI2BH2BHH")
_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def blocked(data: bytes, level: int = 6) -> bytes:
    """data as gzip members of the blocked layout."""
    out = []
    for a in range(0, len(data), BLOCK):
        part = data[a : a + BLOCK]
        packer = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        if len(body) + 26 > 1 << 16:  # what does not shrink is stored
            packer = zlib.compressobj(0, zlib.DEFLATED, -15)
            body = packer.compress(part) + packer.flush()
        out.append(_HEAD.pack(31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<2I", zlib.crc32(part), len(part)))
    return b"".join([*out, _END])


class Bytes:
    """The data of a file from a place on, inflated if it is gzip: read(start, stop). taken and inflated count bytes."""

    def __init__(self, path: str | Path, offset: int = 0, packed: bool | None = None):
        self.path, self.offset, self.taken, self.inflated = Path(path), offset, 0, 0
        if packed is None:
            with self.path.open("rb") as f:
                f.seek(offset)
                packed = f.read(2) == b"\x1f\x8b"
        self.packed = packed

    def read(self, start: int, stop: int) -> bytes:
        with self.path.open("rb") as f:
            f.seek(self.offset)
            if not self.packed:
                f.seek(start, 1)
                out = f.read(max(stop - start, 0))
                self.taken += len(out)
                return out
            head = self._take(f, 18)
            f.seek(-len(head), 1)
            return self._by_blocks(f, start, stop) if self._size(head) else self._by_stream(f, start, stop)

    def _take(self, f, n: int) -> bytes:
        out = f.read(n)
        self.taken += len(out)
        return out

    @staticmethod
    def _size(head: bytes) -> int:
        """Bytes of the member that starts with these, 0 if it isn't of the blocked layout."""
        if len(head) < 18:
            return 0
        a, b, _, flags, _, _, _, extra, one, two, length, size = _HEAD.unpack(head)
        return size + 1 if (a, b, flags & 4, extra, one, two, length) == (31, 139, 4, 6, 66, 67, 2) else 0

    def _by_blocks(self, f, start: int, stop: int) -> bytes:
        out, at = [], 0
        while at < stop:
            here, head = f.tell(), self._take(f, 18)
            if not head:
                break
            size = self._size(head)
            if not size:
                raise ValueError(f"{self.path} changes its layout")
            f.seek(here + size - 4)
            n = struct.unpack("<I", self._take(f, 4))[0]
            if at + n > start and n:
                f.seek(here + 18)
                part = zlib.decompress(self._take(f, size - 26), -15)
                self.inflated += len(part)
                out.append(part[max(start - at, 0) : stop - at])
            f.seek(here + size)
            at += n
        return b"".join(out)

    def _by_stream(self, f, start: int, stop: int) -> bytes:
        out, at, left = [], 0, b""
        inflate = zlib.decompressobj(47)
        while at < stop:
            piece = left or self._take(f, PIECE)
            if not piece:
                break
            part = inflate.decompress(piece, PIECE)
            left = inflate.unconsumed_tail
            self.inflated += len(part)
            if at + len(part) > start:
                out.append(part[max(start - at, 0) : max(stop - at, 0)])
            at += len(part)
            if inflate.eof:
                left, inflate = inflate.unused_data or left, zlib.decompressobj(47)
                if not left and f.peek(1) == b"":
                    break
        return b"".join(out)
