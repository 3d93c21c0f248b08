"""Records of a stored WARC file, read piece by piece and never whole.

A file is plain or gzipped, as one member or one for each record.  A record is
``WARC/``, a head of at most ``HEAD`` bytes that ends at an empty line and states
a Content-Length, so many bytes, and an empty line; bytes that are no such record
go on to the next ``WARC/`` after an empty line, or to the end, as one entry.
What is held is a few pieces, however long files, records and claims are: a
record beyond ``HELD`` is hashed as it passes, and if its end is not where its
head says, reading goes back to its start.  A gzip stream that is damaged or cut
ends where it can be unpacked no further.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import IO

PIECE, HELD, HEAD = 1 << 20, 4 << 20, 1 << 20
START, EMPTY_LINE = b"WARC/", b"\r\n\r\n"


class Unpacked:
    """The unpacked bytes of a file that can seek: ``held`` from ``at`` on, of which ``used`` have passed."""

    def __init__(self, file: IO[bytes]) -> None:
        self.file, self.total = file, None
        self.gzipped = file.read(2) == b"\x1f\x8b"
        file.seek(0)
        self.member, self.rest = None, b""
        self.held, self.used, self.at = b"", 0, 0

    def _piece(self) -> bytes:
        if not self.gzipped:
            return self.file.read(PIECE)
        while True:
            if not self.rest:
                self.rest = self.file.read(PIECE)
            if not self.rest:
                return b""
            if self.member is None:
                self.rest = self.rest.lstrip(b"\0")  # padding between members
                if not self.rest:
                    continue
                self.member = zlib.decompressobj(wbits=31)
            try:
                piece = self.member.decompress(self.rest, PIECE)
            except zlib.error:
                return b""
            self.rest = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            if self.member.eof:
                self.member = None
            if piece:
                return piece

    def ahead(self, n: int) -> int:
        """Bytes that are held beyond what has passed: ``n`` or more, fewer only at the end of the file."""
        have, pieces = len(self.held) - self.used, []
        while have < n and (self.total is None or self.at + have < self.total):
            piece = self._piece()
            if not piece:
                self.total = self.at + have
                break
            pieces.append(piece)
            have += len(piece)
        if pieces:
            self.held, self.used = b"".join([self.held[self.used :], *pieces]), 0
        return have

    def take(self, n: int) -> memoryview:
        """The next ``n`` bytes, which are held, pass."""
        taken = memoryview(self.held)[self.used : self.used + n]
        self.used += n
        self.at += n
        return taken

    def mark(self) -> tuple:
        return self.file.tell(), self.member and self.member.copy(), self.rest, self.held[self.used :], self.at

    def back(self, mark: tuple) -> None:
        place, self.member, self.rest, self.held, self.at = mark
        self.used = 0
        self.file.seek(place)


def _size(data: Unpacked) -> int | None:
    """Bytes of the record that begins here by what its head says, if one does."""
    if data.ahead(len(START)) < len(START) or not data.held.startswith(START, data.used):
        return None
    wanted, end = 4096, -1
    while end < 0:
        have = data.ahead(wanted)
        end = data.held.find(EMPTY_LINE, data.used, data.used + HEAD)
        if end < 0 and (have < wanted or wanted >= HEAD):
            return None
        wanted = min(wanted * 4, HEAD)
    size = b""
    for line in data.held[data.used : end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon and name.strip().lower() == b"content-length":
            size = value.strip()
    # a length of more digits than any file has is no length
    return end - data.used + int(size) + 2 * len(EMPTY_LINE) if size.isdigit() and len(size) < 19 else None


def _record(data: Unpacked, size: int) -> str | None:
    """The digest of the record of ``size`` bytes; None, and nothing has passed, if it does not end there."""
    if data.total is not None and data.at + size > data.total:
        return None
    if size <= HELD:
        if data.ahead(size) < size or not data.held.startswith(EMPTY_LINE, data.used + size - len(EMPTY_LINE)):
            return None
        return hashlib.sha256(data.take(size)).hexdigest()
    mark, digest, left = data.mark(), hashlib.sha256(), size
    while left > len(EMPTY_LINE):
        n = min(data.ahead(1), left - len(EMPTY_LINE))
        if not n:
            break
        digest.update(data.take(n))
        left -= n
    if data.ahead(len(EMPTY_LINE)) >= len(EMPTY_LINE) and data.held.startswith(EMPTY_LINE, data.used):
        digest.update(data.take(len(EMPTY_LINE)))
        return digest.hexdigest()
    data.back(mark)
    return None


def _stray(data: Unpacked) -> tuple[int, str]:
    """(bytes, digest) of what lies here before the next record or the end."""
    next_one, digest, start, skip = EMPTY_LINE + START, hashlib.sha256(), data.at, 1
    while True:
        have = data.ahead(PIECE)
        found = data.held.find(next_one, data.used + skip)
        n = found + len(EMPTY_LINE) - data.used if found >= 0 else have if have < PIECE else have - len(next_one) + 1
        digest.update(data.take(n))
        if found >= 0 or have < PIECE:
            return data.at - start, digest.hexdigest()
        skip = 0


def entries(file: IO[bytes]) -> Iterator[tuple[int, int, str]]:
    """(offset, length, sha256) of each record and of what lies between."""
    data = Unpacked(file)
    while data.ahead(1):
        at, size = data.at, _size(data)
        digest = None if size is None else _record(data, size)
        if digest is None:
            size, digest = _stray(data)
        yield at, size, digest
