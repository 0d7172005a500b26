"""Restart points of gzip files, so that many tasks read one of them.

A gzip stream can be read from the start of any of its blocks, given the bytes that
were put out last.  points() goes through a file once, which is cheap next to parsing what is in it,
and about every so many compressed bytes looks for the start of a block: between
the last byte of a block and the first of the next there is a header that puts out nothing, so
bytes are fed singly until some in a row have no effect.  The block starts at one of the few bits
before; the one from which decoding gives what the stream goes on with is taken.  Members of a
file are points too.  Where none is found the range is just longer.

read() decodes from a point to the end of the file, for as long as it's asked.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import numpy as np

#: What a block may refer back to, bytes without output that are a header, bytes tried one by one, and bytes that prove a start.
WINDOW, SILENT, TRIED, PROOF = 1 << 15, 24, 1 << 20, 1 << 14
#: Compressed bytes read at once, and what the last bits of a proof may put out at most.
BLOCK, SLACK = 1 << 18, 4096


class Point(NamedTuple):
    """Where decoding can start: bit (of byte at), the offset of what it puts out, what came out before, and where the file's next member starts.

    bit is -1 at the start of a member, following -1 in the last one.
    """

    at: int
    bit: int
    out: int
    window: bytes
    following: int = -1


class _Feed:
    """The bytes of a source that aren't used yet, and where they start."""

    def __init__(self, source: BinaryIO):
        self.source, self.raw, self.low, self.at = source, b"", 0, 0
        source.seek(0)

    def need(self, n: int) -> bool:
        """Whether so many bytes are there."""
        while len(self.raw) - self.low < n and (more := self.source.read(BLOCK)):
            self.raw, self.low = self.raw[self.low :] + more, 0
        return len(self.raw) - self.low >= n

    def peek(self, n: int) -> bytes:
        return self.raw[self.low : self.low + n]

    def take(self, n: int) -> bytes:
        taken = self.peek(n)
        self.low, self.at = self.low + len(taken), self.at + len(taken)
        return taken

    def give(self, unused: bytes) -> None:
        """Takes back the last bytes that were taken."""
        self.low, self.at = self.low - len(unused), self.at - len(unused)


def _shifted(raw: bytes, bit: int) -> bytes:
    """The bytes of a bit stream that starts at a bit of the first byte; the last one lacks its high bits."""
    if not bit or not raw:
        return raw
    b = np.frombuffer(raw, np.uint8).astype(np.uint16)
    return (b >> bit | np.append(b[1:], np.uint16(0)) << 8 - bit).astype(np.uint8).tobytes()


def _inflater(window: bytes):
    return zlib.decompressobj(-15, zdict=window) if window else zlib.decompressobj(-15)


def _start(raw: bytes, window: bytes, proof: bytes) -> int:
    """The bit of raw's first five bytes where a block starts that puts out the proof; -1 if there's none."""
    for bit in range(40):
        try:
            got = _inflater(window).decompress(_shifted(raw[bit // 8 :], bit % 8))
        except zlib.error:
            continue
        if proof and got[: len(proof)] == proof:
            return bit
    return -1


def _search(feed: _Feed, made, tail: bytes) -> tuple[list[bytes], tuple[int, int] | None]:
    """Feeds single bytes until a block starts; what came out, and byte and bit of the start, if one was found."""
    came, recent, silent, seen = [], b"", 0, False
    for _ in range(TRIED):
        if made.eof or not feed.need(1):
            break
        byte = feed.take(1)
        recent = (recent + byte)[-SILENT - 2 :]
        if got := made.decompress(byte):
            came.append(got)
            silent, seen = 0, True
            continue
        silent += 1
        if seen and silent == SILENT and len(recent) == SILENT + 2:
            feed.need(PROOF)
            ahead = feed.peek(PROOF)
            truth = made.copy().decompress(ahead)
            bit = _start(recent + ahead, (tail + b"".join(came))[-WINDOW:], truth[: max(0, len(truth) - SLACK)])
            if bit >= 0:
                return came, (feed.at - len(recent) + bit // 8, bit % 8)
    return came, None


def points(source: BinaryIO, every: int) -> Iterator[Point]:
    """The points of a gzip file, about every so many compressed bytes apart; checksums are verified on the way."""
    feed, out = _Feed(source), 0
    while feed.need(2) and feed.peek(2) == b"\x1f\x8b":
        # points of a member are held until it's known where it ends: one window for each
        made, tail, member, tried = zlib.decompressobj(31), b"", [Point(feed.at, -1, out, b"")], feed.at
        while not made.eof and feed.need(1):
            found = None
            if feed.at - tried < every:
                came = [made.decompress(feed.take(min(BLOCK, max(1, every - (feed.at - tried)))))]
            else:
                came, found = _search(feed, made, tail)
                tried = feed.at
            if made.eof:
                feed.give(made.unused_data)
            out, tail = out + sum(map(len, came)), b"".join([tail, *came])[-WINDOW:]
            if found:
                member.append(Point(*found, out, tail))
        if not made.eof:
            raise EOFError("the file ends before its last member does")
        while feed.need(1) and feed.peek(1) == b"\0":  # padding
            feed.take(1)
        following = feed.at if feed.need(1) else -1
        yield from (p._replace(following=following) for p in member)


def read(source: BinaryIO, point: Point) -> Iterator[bytes]:
    """What the file puts out from a point on."""
    source.seek(point.at)
    if point.bit >= 0:
        made, kept, more = _inflater(point.window), b"", True
        while more and not made.eof:
            raw = source.read(BLOCK)
            more, raw = bool(raw), kept + raw
            # the last byte is shifted with what follows it
            yield made.decompress(_shifted(raw, point.bit)[: len(raw) - 1 if more and point.bit else len(raw)])
            kept = raw[-1:] if point.bit else b""
        if point.following < 0:
            return
        source.seek(point.following)
    made = zlib.decompressobj(31)
    while raw := source.read(BLOCK):
        while raw:
            if made.eof:
                raw = raw.lstrip(b"\0")
                if not raw:
                    break
                made = zlib.decompressobj(31)
            yield made.decompress(raw)
            raw = made.unused_data if made.eof else b""
