"""Cutting FASTQ files into pieces that tasks read by themselves.

A record is four lines, so counting line ends tells where records start and what their ordinals
are, whatever the lines hold.  A large file is cut into ranges of bytes; one pass over them, a task
for each range, counts line ends and notes where the first four are.  Sums of these counts, one row
a range, give every range the place and ordinal of the first record that starts in it.

Plain files are cut anywhere.  Gzip files are cut between members if these state their sizes (blocked
gzip, as :mod:`.fastq` writes it): a range starts at the first member behind its cut, found by its
header and those of the members that follow.  Any other gzip file is one piece.
"""

from __future__ import annotations

import gzip
import io
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession

from ..functions.errors import InputError

SPLIT_BYTES = 64 << 20
#: Pieces of less than ``SPLIT_BYTES`` are cut while a list of files has at most so many, as each is a task.
MOST_SMALL = 256
_READ = 1 << 20
#: Start of a member with an extra field, and the fixed part of its header.
MAGIC, FIXED = b"\x1f\x8b\x08\x04", 12
#: Headers that must follow each other for a member's start to be believed.
CHAIN = 4


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path) else f"file://{os.path.abspath(path)}")


def open_bytes(path: str) -> pa.NativeFile:
    """A file's bytes as they are."""
    try:
        system, inner = file_system(path)
        return system.open_input_file(inner)
    except (OSError, pa.ArrowInvalid) as e:
        raise InputError(f"can't open {path}: {e}") from e


def is_gzip(path: str) -> bool:
    return path.rsplit(".", 1)[-1] == "gz"


def member_size(header: bytes) -> int | None:
    """Bytes of the gzip member that starts with ``header``, if it states them."""
    if len(header) < FIXED or header[:4] != MAGIC:
        return None
    (extra,) = struct.unpack_from("<H", header, 10)
    at, end = FIXED, FIXED + extra
    while at + 4 <= min(end, len(header)):
        (size,) = struct.unpack_from("<H", header, at + 2)
        if header[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(header):
            return struct.unpack_from("<H", header, at + 4)[0] + 1
        at += 4 + size
    return None


def is_blocked(path: str) -> bool:
    with open_bytes(path) as raw:
        return member_size(raw.read(512)) is not None


def find_member(raw: pa.NativeFile, at: int, size: int) -> int | None:
    """The first member that starts at ``at`` or behind, in a file of ``size`` bytes."""

    def holds(p: int) -> bool:
        for _ in range(CHAIN):
            if p == size:
                return True
            raw.seek(p)
            step = member_size(raw.read(512))
            if step is None or p + step > size:
                return False
            p += step
        return True

    while at < size:
        raw.seek(at)
        window = raw.read(_READ)
        k = window.find(MAGIC)
        while k >= 0:
            if holds(at + k):
                return at + k
            k = window.find(MAGIC, k + 1)
        if at + len(window) >= size:
            return None
        at += len(window) - len(MAGIC) + 1
    return None


def unpack_member(data: bytes, where: str) -> bytes:
    """The content of a whole gzip member with an extra field; damage is an error."""
    try:
        (extra,) = struct.unpack_from("<H", data, 10)
        content = zlib.decompressobj(-15)
        out = content.decompress(data[FIXED + extra : -8])
        if not content.eof or content.unused_data or struct.unpack("<II", data[-8:]) != (zlib.crc32(out), len(out) & 0xFFFFFFFF):
            raise zlib.error("check sums differ")
    except (zlib.error, struct.error) as e:
        raise InputError(f"{where} is damaged: {e}") from e
    return out


def members(path: str, start: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    """(place, size, content) of the members of a blocked file that start in [start, end)."""
    with open_bytes(path) as raw:
        size = raw.size()
        at = 0 if start == 0 else find_member(raw, start, size)
        while at is not None and at < min(end, size):
            raw.seek(at)
            step = member_size(raw.read(512))
            if step is None or at + step > size:
                raise InputError(f"{path} is damaged: no whole member at byte {at}")
            raw.seek(at)
            yield at, step, unpack_member(raw.read(step), f"{path}: the member at byte {at}")
            at += step


@dataclass(frozen=True)
class Counted:
    """Line ends of a range: how many, where the first four are (byte or member, bytes within), and whether one comes last."""

    start: int
    end: int
    lines: int
    first: tuple[tuple[int, int], ...]
    closed: bool | None


def count_lines(path: str, start: int, end: int, blocked: bool) -> Counted:
    """What :class:`Counted` says of the range [start, end) of a file."""
    lines, first, closed, began, last = 0, [], None, None, start

    def parts() -> Iterator[tuple[int, int, bytes]]:
        with open_bytes(path) as raw:
            raw.seek(start)
            at = start
            while at < end and (data := raw.read(min(_READ, end - at))):
                yield at, len(data), data
                at += len(data)

    for at, step, data in members(path, start, end) if blocked else parts():
        began = at if began is None else began
        last = at + step
        k = data.find(b"\n")
        while k >= 0 and len(first) < 4:
            first.append((at, k + 1) if blocked else (at + k + 1, 0))
            k = data.find(b"\n", k + 1)
        lines += data.count(b"\n")
        closed = data.endswith(b"\n") if data else closed
    return Counted(start if began is None else began, last if began is not None else start, lines, tuple(first), closed)


@dataclass(frozen=True)
class Piece:
    """Records of a file: from where (a byte, or a member and bytes of its content), their first ordinal and number (None: all).

    ``before`` are the records of a folder's parts before this file.
    """

    path: str
    at: int = 0
    skip: int = 0
    ordinal: int = 0
    records: int | None = None
    before: int = 0

    @property
    def place(self) -> int:
        """The first ordinal, over all parts of a folder."""
        return self.before + self.ordinal

    def open(self) -> io.BufferedReader:
        raw = open_bytes(self.path)
        raw.seek(self.at)
        stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if is_gzip(self.path) else raw, _READ)
        stream.read(self.skip)
        return stream


def _gapless(ranges: list[Counted], size: int, blocked: bool) -> bool:
    """Whether ranges that aren't empty make up the whole file; if not, some member's header was found by chance."""
    ends = [0, *(r.end for r in ranges)]
    return ends[-1] == size and not (blocked and any(e != r.start for e, r in zip(ends, ranges)))


def pieces_of(path: str, ranges: list[Counted], size: int, blocked: bool) -> list[Piece]:
    """The pieces of a file from what was counted in its ranges, in order."""
    ranges = [r for r in ranges if r.end > r.start]
    if not _gapless(ranges, size, blocked):
        return [Piece(path)]
    closed = next((r.closed for r in reversed(ranges) if r.closed is not None), True)
    total, out, lines = sum(r.lines for r in ranges), [], 0
    for k, r in enumerate(ranges):
        after = lines + r.lines
        # a record starts behind every fourth line end, and at the start of the file
        first, n = lines // 4 + 1, after // 4 - lines // 4
        if n and closed and total % 4 == 0 and after == total:
            n -= 1  # nothing follows the last line end
        if k == 0:
            out.append(Piece(path, 0, 0, 0, n + 1))
        elif n > 0:
            out.append(Piece(path, *r.first[4 * first - lines - 1], first, n))
        lines = after
    return out


def lines_of(path: str, ranges: list[Counted], size: int, blocked: bool) -> int | None:
    """The lines of a file from what was counted in its ranges, or None where these don't tell."""
    ranges = [r for r in ranges if r.end > r.start]
    if not _gapless(ranges, size, blocked):
        return None
    closed = next((r.closed for r in reversed(ranges) if r.closed is not None), True)
    return sum(r.lines for r in ranges) + (not closed)


def cut_bytes(sizes: list[int], split_bytes: int) -> int:
    """Bytes of a piece: ``split_bytes``, or as many as leave no more than ``MOST_SMALL`` pieces of less than ``SPLIT_BYTES``."""
    return max(split_bytes, min(SPLIT_BYTES, -(-sum(sizes) // MOST_SMALL)))


def _count_whole(path: str) -> Counted:
    """The lines of a file that can't be cut."""
    lines, closed = 0, None
    with Piece(path).open() as stream:
        while data := stream.read(_READ):
            lines, closed = lines + data.count(b"\n"), data.endswith(b"\n")
    with open_bytes(path) as raw:
        return Counted(0, raw.size(), lines, (), closed)


def _count(spark: SparkSession, ranges: list[tuple[str, int, int]], blocked: dict[str, bool]) -> dict[str, list[Counted]]:
    """What was counted in each file's ranges, in order; ``blocked`` lacks files that are counted as a whole."""
    if not ranges:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                path, a, b = ranges[k]
                r = count_lines(path, a, b, blocked[path]) if path in blocked else _count_whole(path)
                row = {"id": k, "start": r.start, "end": r.end, "lines": r.lines, "first": [x for p in r.first for x in p], "closed": r.closed}
                yield pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("lines", pa.int64()), ("first", pa.list_(pa.int64())), ("closed", pa.bool_())])
    tasks = min(len(ranges), max(MOST_SMALL, sum(b - a for _, a, b in ranges) // SPLIT_BYTES))
    told = spark.range(0, len(ranges), 1, tasks).mapInArrow(count, "id long, start long, end long, lines long, first array<long>, closed boolean")
    counted: dict[str, list[Counted]] = {}
    for r in sorted(told.collect()):
        first = tuple(zip(r["first"][::2], r["first"][1::2]))
        counted.setdefault(ranges[r["id"]][0], []).append(Counted(r["start"], r["end"], r["lines"], first, r["closed"]))
    return counted


def _opened(paths: list[str]) -> tuple[dict[str, int], dict[str, bool]]:
    """The size of each file; whether those that can be cut are blocked gzip."""
    sizes, blocked = {}, {}
    for path in dict.fromkeys(paths):
        with open_bytes(path) as raw:
            sizes[path] = raw.size()
        if not is_gzip(path) or is_blocked(path):
            blocked[path] = is_gzip(path)
    return sizes, blocked


def _ranges(path: str, size: int, step: int, whole: bool) -> list[tuple[str, int, int]]:
    return [(path, 0, size)] if whole else [(path, a, min(a + step, size)) for a in range(0, size, step)]


def line_counts(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES) -> dict[str, int]:
    """The lines of each file, counted by ranges of large ones."""
    sizes, blocked = _opened(paths)
    step = cut_bytes(list(sizes.values()), split_bytes)
    counted = _count(spark, [r for p, n in sizes.items() for r in _ranges(p, n, step, p not in blocked)], blocked)
    lines = {p: lines_of(p, counted.get(p, []), n, blocked.get(p, False)) for p, n in sizes.items()}
    again = _count(spark, [(p, 0, sizes[p]) for p, n in lines.items() if n is None], {})
    return lines | {p: lines_of(p, rows, sizes[p], False) for p, rows in again.items()}


def index(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES, counted: frozenset[str] = frozenset()) -> dict[str, list[Piece]]:
    """The pieces of each file.  Files that can't be cut, or needn't be, are one of unknown length unless they are to be ``counted``.

    What the driver holds is a row for each range of :func:`cut_bytes`.
    """
    out, ranges = {}, []
    sizes, blocked = _opened(paths)
    step = cut_bytes(list(sizes.values()), split_bytes)
    for path, size in sizes.items():
        if path in counted or size > step and path in blocked:
            ranges += _ranges(path, size, step, path not in blocked)
        else:
            out[path] = [Piece(path)]
    found = _count(spark, ranges, blocked)
    for path in (p for p in sizes if p not in out):
        rows = found.get(path, [])
        out[path] = [] if all(r.closed is None for r in rows) else pieces_of(path, rows, sizes[path], blocked.get(path, False))
    unknown = [p for p in counted if any(x.records is None for x in out[p])]
    for path, rows in _count(spark, [(p, 0, sizes[p]) for p in unknown], {}).items():
        out[path] = pieces_of(path, rows, sizes[path], False)
    return out
