"""FASTQ as Spark data sources.

``fastq`` reads files of records (file_index, ordinal, name, description, seq, qual);
``fastq_pairs`` reads two files in step (file_index, pair_ordinal and both records).  By
:func:`scan` and :func:`scan_pairs` large files are many tasks: plain ones are cut anywhere, gzip
ones between members that state their sizes (:mod:`.splits`); mates that are cut at different
bytes meet by their ordinals.  To them a folder is one file in parts.  Read by ``format`` alone, a
file is one task, and a folder stands for its part files.  The order of a list of files is that of (file_index, ordinal); :func:`with_place`
numbers it through.  Files are opened through pyarrow's file systems: local and shared folders by
path, other stores by URI.

``df.write.format("fastq")`` writes a folder of numbered parts, blocked gzip if its name ends in
``gz``: tasks write beside it, and all parts show with one rename when the last has ended, so a
failed task leaves nothing.  A single file is made on request only, of the parts' bytes in order
(members of a gzip file may follow each other).

Records are strict: a header that starts with @, a separator that starts with +, equal
lengths of sequence and quality, quality bytes of 33 or more, and no record cut short.
Gzip is chosen by the extension ``gz``; all members are read.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.errors import InputError, PairingError
from .arrivals import Arrivals, PairStreamReader
from .splits import SPLIT_BYTES, Piece, cut_bytes, file_system, index, is_blocked, is_gzip, line_counts, members

RECORD = "file_index int, ordinal bigint, name string, description string, seq string, qual string"
PAIR = "file_index int, pair_ordinal bigint, r1_name string, r1_seq string, r1_qual string, r2_name string, r2_seq string, r2_qual string"
PAIR_NAMES = "file_index int, pair_ordinal bigint, r1_name string, r2_name string"
#: Bytes that are parsed together; a reader of two files holds some thirty times as many.
CHUNK = 1 << 20


def file_size(path: str) -> int | None:
    """Bytes of a file, or None where there is none."""
    system, inner = file_system(path)
    info = system.get_file_info(inner)
    return info.size if info.type == pyarrow.fs.FileType.File else None


def open_lines(path: str) -> io.BufferedReader:
    """A file's bytes, unpacked if its extension is gz."""
    return Piece(path).open()


def _checked(lines: io.BufferedIOBase, n: int, path: str) -> Iterator[tuple[str, str, str]]:
    """(header, seq, qual) of each record from the ``n``-th on; a malformed one is an error."""
    while header := lines.readline():
        seq, plus, qual = lines.readline(), lines.readline(), lines.readline()
        where = f"record {n + 1} of {path}"
        if not header.startswith(b"@"):
            raise InputError(f"{where}: the header must start with @")
        if not qual:
            raise InputError(f"{where}: cut short")
        if not plus.startswith(b"+"):
            raise InputError(f"{where}: the separator must start with +")
        seq, qual = seq.rstrip(b"\r\n"), qual.rstrip(b"\r\n")
        if len(seq) != len(qual):
            raise InputError(f"{where}: {len(seq)} bases, {len(qual)} qualities")
        if qual and min(qual) < 33:
            raise InputError(f"{where}: a quality byte is below 33")
        try:
            yield header[1:].rstrip(b"\r\n").decode(), seq.decode(), qual.decode("latin-1")
        except UnicodeDecodeError as e:
            raise InputError(f"{where}: not UTF-8") from e
        n += 1


def _named(header: str) -> tuple[str, str]:
    name, _, description = header.partition(" ")
    return (header if "\t" in name else name), description


def records(path: str) -> Iterator[tuple[str, str, str, str]]:
    """(name, description, seq, qual) of each record; a malformed one is an error."""
    with open_lines(path) as lines:
        for header, seq, qual in _checked(lines, 0, path):
            yield *_named(header), seq, qual


def _plain_chunk(data: bytes, ends: np.ndarray) -> pa.Table | None:
    """Records (header, seq, qual) of whole lines by Arrow alone, or None where a record needs a closer look."""
    a = np.frombuffer(data, np.uint8, ends[-1] + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))
    sizes = (ends - starts).reshape(-1, 4)
    first = a[starts].reshape(-1, 4)
    if (first[:, 0] != 64).any() or (first[:, 2] != 43).any() or (sizes[:, 1] != sizes[:, 3]).any() or (a == 13).any():
        return None
    odd = np.flatnonzero(((a < 33) & (a != 10)) | (a > 127))
    if (np.searchsorted(ends, odd) % 4 == 3).any():
        return None
    offsets = np.append(starts, ends[-1] + 1).astype(np.int32)
    lines = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    each = np.arange(0, len(ends), 4)
    try:
        columns = [pc.binary_slice(lines.take(pa.array(each + k)), s, -1).cast(pa.string()) for k, s in ((0, 1), (1, 0), (3, 0))]
    except pa.ArrowInvalid:  # not UTF-8
        return None
    return pa.table(columns, ["header", "seq", "qual"])


def record_tables(piece: Piece, drop: int = 0) -> Iterator[pa.Table]:
    """The records (header, seq, qual) of a piece but its first ``drop``, some thousands at a time."""
    n, held, left = piece.ordinal, b"", piece.records
    with piece.open() as stream:
        while left is None or left > 0:
            data = stream.read(CHUNK)
            held += data
            ends = np.flatnonzero(np.frombuffer(held, np.uint8) == 10)
            ends = ends[: len(ends) // 4 * 4]
            if data and not len(ends):
                continue
            if data:
                table = _plain_chunk(held, ends)
                stop = int(ends[-1]) + 1
            else:
                table, stop = None, len(held)
            if table is None:
                rows = list(zip(*_checked(io.BytesIO(held[:stop]), n, piece.path))) or [[], [], []]
                table = pa.table([pa.array(c, pa.string()) for c in rows], ["header", "seq", "qual"])
            held = held[stop:]
            if left is not None:
                table = table.slice(0, left)
                left -= len(table)
            n += len(table)
            if drop:
                gone = min(drop, len(table))
                table, drop = table.slice(gone), drop - gone
            if len(table):
                yield table
            if not data:
                return


def _in_step(one: Iterator[pa.Table], two: Iterator[pa.Table], paths: tuple[str, str], n: int) -> Iterator[tuple[pa.Table, pa.Table]]:
    """Equal numbers of rows of both; one that ends before the other is an error, ``n`` pairs having been before."""
    left, right = next(one, None), next(two, None)
    while left is not None and right is not None:
        k = min(len(left), len(right))
        yield left.slice(0, k), right.slice(0, k)
        n += k
        left = left.slice(k) if len(left) > k else next(one, None)
        right = right.slice(k) if len(right) > k else next(two, None)
    if left is not None or right is not None:
        raise PairingError(f"{paths[0 if left is None else 1]} ends after {n} complete pairs, its mate file goes on")


@dataclass
class Part(InputPartition):
    """What one task reads: pieces of a file, and of its mate those with the same ordinals, ``drop`` records of which come before."""

    index: int
    pieces: tuple[Piece, ...]
    mates: tuple[Piece, ...] = ()
    drop: int = 0


def _numbered(part: Part, n: int, rows: int) -> list[pa.Array]:
    return [pa.array(np.full(rows, part.index, np.int32)), pa.array(np.arange(n, n + rows))]


class FastqReader(DataSourceReader):
    def __init__(self, parts: list[Part]):
        self.parts = parts

    def partitions(self) -> list[InputPartition]:
        return self.parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        n = partition.pieces[0].place
        for table in chain.from_iterable(map(record_tables, partition.pieces)):
            header = table.column("header").combine_chunks()
            if pc.any(pc.match_substring(header, "\t")).as_py():
                name, description = (pa.array(c, pa.string()) for c in zip(*map(_named, header.to_pylist())))
            else:
                cut = pc.extract_regex(header, r"(?s)^(?P<name>[^ ]*) ?(?P<description>.*)$")
                name, description = cut.field("name"), cut.field("description")
            columns = [*_numbered(partition, n, len(table)), name, description, *(table.column(c).combine_chunks() for c in ("seq", "qual"))]
            yield pa.RecordBatch.from_arrays(columns, ["file_index", "ordinal", "name", "description", "seq", "qual"])
            n += len(table)


class PairReader(FastqReader):
    def __init__(self, parts: list[Part], names_only: bool):
        super().__init__(parts)
        self.fields = [("header", "name")] if names_only else [("header", "name"), ("seq", "seq"), ("qual", "qual")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        one, two = partition.pieces, partition.mates
        n = one[0].place
        names = ["file_index", "pair_ordinal", *(f"r{k}_{to}" for k in (1, 2) for _, to in self.fields)]
        drops = (partition.drop, *[0] * len(two))
        mated = chain.from_iterable(map(record_tables, two, drops))
        for left, right in _in_step(chain.from_iterable(map(record_tables, one)), mated, (one[0].path, two[0].path), n):
            mates = [t.column(c).combine_chunks() for t in (left, right) for c, _ in self.fields]
            yield pa.RecordBatch.from_arrays([*_numbered(partition, n, len(left)), *mates], names)
            n += len(left)


def files_of(path: str) -> list[str]:
    """The part files of a folder by name, or the file."""
    system, inner = file_system(path)
    if system.get_file_info(inner).type != pyarrow.fs.FileType.Directory:
        return [path]
    found = system.get_file_info(pyarrow.fs.FileSelector(inner))
    return [f"{path.rstrip('/')}/{f.base_name}" for f in sorted(found, key=lambda f: f.base_name) if f.is_file and f.base_name.startswith("part-")]


def _paths(text: str | None, option: str) -> list[str]:
    if not text:
        raise InputError(f"option {option} is needed")
    return [f for p in text.split(",") if p for f in files_of(p)]


def _parts(options: dict, names: tuple[str, ...]) -> list[Part]:
    """The parts that an option tells, or each file or pair of files that options ``names`` list as a whole."""
    if told := options.get("parts"):
        return [Part(i, *(tuple(Piece(**p) for p in some) for some in (pieces, mates)), drop) for i, pieces, mates, drop in json.loads(told)]
    lists = [_paths(options.get(n), n) for n in names]
    if len(lists[0]) != len(lists[-1]):
        raise PairingError(f"{len(lists[0])} forward files, {len(lists[-1])} reverse files")
    return [Part(i, *((Piece(p),) for p in files)) for i, files in enumerate(zip(*lists))]


class FastqSource(DataSource):
    """``spark.read.format("fastq").option("path", "a.fastq,b.fastq.gz")``; ``df.write.format("fastq").save("folder.gz")``."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema: StructType) -> DataSourceReader:
        return FastqReader(_parts(self.options, ("path",)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FastqWriter(self.options, schema.names, overwrite)


class FastqPairSource(DataSource):
    """``spark.read.format("fastq_pairs").option("r1", "a_1.fastq.gz").option("r2", "a_2.fastq.gz")``; lists by comma.

    With option ``columns`` as ``names`` only headers are taken.  As a stream it takes the file pairs of option
    ``folder`` as they get complete, and keeps their order in ``log``; options ``forward`` and ``reverse`` are what
    tells the names of mates apart (``_1.`` and ``_2.``), and file_index numbers the pairs.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq_pairs"

    def schema(self) -> str:
        return PAIR_NAMES if self.options.get("columns") == "names" else PAIR

    def reader(self, schema: StructType) -> DataSourceReader:
        return PairReader(_parts(self.options, ("r1", "r2")), self.options.get("columns") == "names")


    def streamReader(self, schema: StructType) -> PairStreamReader:
        folder, log = self.options.get("folder"), self.options.get("log")
        if not folder or not log:
            raise InputError("options folder and log are needed")
        arrivals = Arrivals(folder, log, (self.options.get("forward", "_1."), self.options.get("reverse", "_2.")))
        return PairStreamReader(arrivals, PairReader([], self.options.get("columns") == "names"), _arrived)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqSource)
    spark.dataSource.register(FastqPairSource)


def _told(parts: list[Part]) -> str:
    return json.dumps([(p.index, [asdict(x) for x in p.pieces], [asdict(x) for x in p.mates], p.drop) for p in parts])


def _found(spark: SparkSession, lists: list[list[str]], split_bytes: int) -> list[list[Piece]]:
    """The pieces of files and of folders, whose ordinals run through their parts."""
    several = frozenset(f for files in lists if len(files) > 1 for f in files)
    found = index(spark, [f for files in lists for f in files], split_bytes, several)
    return [_through(files, found) if len(files) > 1 else [p for f in files for p in found[f]] for files in lists]


def _through(files: list[str], found: dict[str, list[Piece]]) -> list[Piece]:
    """The pieces of a folder's parts, each with the number of records in the parts before."""
    out, before = [], 0
    for f in files:
        out += [replace(p, before=before) for p in found[f] if p.records]
        before += sum(p.records for p in found[f])
    return out or [Piece(f, records=0) for f in files[:1]]


def scan(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of files, large ones in pieces of about ``split_bytes`` (more of very large ones); a folder is one file in parts."""
    register(spark)
    found = _found(spark, [files_of(p) for p in paths], split_bytes)
    parts = [Part(i, (piece,)) for i, pieces in enumerate(found) for piece in pieces]
    return spark.read.format("fastq").option("path", ",".join(paths)).option("parts", _told(parts)).load()


@dataclass(frozen=True)
class PairScan:
    """Two lists of files, and the parts that tasks read of them."""

    spark: SparkSession
    ones: list[str]
    twos: list[str]
    parts: list[Part]

    def read(self, names_only: bool = False) -> DataFrame:
        """The pairs, or of each only its place and headers."""
        reader = self.spark.read.format("fastq_pairs").option("r1", ",".join(self.ones)).option("r2", ",".join(self.twos))
        return reader.option("parts", _told(self.parts)).option("columns", "names" if names_only else "all").load()

    def first(self, n: int) -> PairScan:
        """The scan without parts that start behind the first ``n`` pairs of a file."""
        return replace(self, parts=[p for p in self.parts if p.pieces[0].place < n])


def scan_pairs(spark: SparkSession, ones: list[str], twos: list[str], split_bytes: int = SPLIT_BYTES) -> PairScan:
    """A scan of two lists of files, large ones in pieces of about ``split_bytes`` of the forward file.

    A folder is one file in parts.  A pair of files of which one can't be cut is one task.
    """
    register(spark)
    if len(ones) != len(twos):
        raise PairingError(f"{len(ones)} forward files, {len(twos)} reverse files")
    lists = [files_of(p) for p in (*ones, *twos)]
    found = _found(spark, lists, split_bytes)
    parts, k = [], len(ones)
    for i, (a, b) in enumerate(zip(ones, twos)):
        parts += _mated(i, (a, b), (lists[i], lists[k + i]), found[i], found[k + i])
    return PairScan(spark, ones, twos, parts)


def _mated(i: int, paths: tuple[str, str], files: tuple[list[str], list[str]], left: list[Piece], right: list[Piece]) -> list[Part]:
    """The parts of a pair of files: a piece's mates start in the last piece of the other one with an ordinal that isn't larger."""
    if any(p.records is None for p in (*left, *right)):
        return [Part(i, *(tuple(map(Piece, some)) for some in files))]
    if (n := sum(p.records for p in left)) != (m := sum(p.records for p in right)):
        raise PairingError(f"{paths[n > m]} ends after {min(n, m)} complete pairs, its mate file goes on")
    firsts, parts = [p.place for p in right], []
    for piece in left:
        k = max(0, int(np.searchsorted(firsts, piece.place, "right")) - 1)
        drop = piece.place - right[k].place
        parts.append(Part(i, (piece,), tuple(_covering(right, k, piece.records + drop)), drop))
    return parts


def _covering(pieces: list[Piece], k: int, n: int) -> Iterator[Piece]:
    """``n`` records from the ``k``-th piece on, with one piece of each file."""
    while True:
        last, have = k + 1, pieces[k].records
        while have < n and last < len(pieces) and pieces[last].path == pieces[k].path:
            have, last = have + pieces[last].records, last + 1
        yield replace(pieces[k], records=min(have, n))
        n -= have
        if n <= 0 or last == len(pieces):
            return
        k = last


#: Records of a part, as its writer says in its name.
_SAID = re.compile(r"part-\d+-[0-9a-f]{8}-(\d+)\.")


def _arrived(i: int, one: str, two: str) -> list[Part]:
    """The parts of a pair of files that a stream takes: those of folders where their names tell the numbers of records."""
    files = files_of(one), files_of(two)
    told = [{f: _SAID.match(f.rsplit("/", 1)[-1]) for f in some} for some in files]
    if not all(m for some in told for m in some.values()):
        return [Part(i, *(tuple(map(Piece, some)) for some in files))]
    left, right = (_through(list(some), {f: [Piece(f, records=int(m[1]))] for f, m in some.items()}) for some in told)
    return _mated(i, (one, two), files, left, right)


#: Content of a member of blocked gzip, so that its size in bytes fits 16 bits, and the empty member that ends a file.
BLOCK = 0xFF00
_LAST = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def blocked_gzip(data: bytes) -> bytes:
    """``data`` as gzip members that state their sizes."""
    out = []
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25)
        out.append(head + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


@dataclass
class Wrote(WriterCommitMessage):
    partition: int
    path: str
    records: int


class FastqWriter(DataSourceArrowWriter):
    """Parts of a folder, one a task.  Tasks write to a folder beside it; the commit renames it.

    Columns are ``name``, ``seq`` and ``qual``, or those that options of these names give.  An existing
    folder is replaced (overwrite) or added to (append).
    """

    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.path = (options.get("path") or "").rstrip("/")
        if not self.path:
            raise InputError("option path is needed")
        self.at = [columns.index(options.get(c, c)) for c in ("name", "seq", "qual")]
        self.overwrite, self.beside = overwrite, f"{self.path}.writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        context, gz = TaskContext.get(), is_gzip(self.path)
        system, folder = file_system(self.beside)
        system.create_dir(folder, recursive=True)
        # an attempt's file has a name of its own; only those that the driver hears of are taken
        name = f"{context.partitionId():05d}-{context.taskAttemptId()}"
        n, held, size = 0, [], 0
        with system.open_output_stream(f"{folder}/{name}", compression=None) as out:

            def flush() -> None:
                data = b"".join(held)
                held.clear()
                out.write(blocked_gzip(data) if gz else data)

            for batch in iterator:
                header, seq, qual = (batch.column(k) for k in self.at)
                header, end = pc.binary_join_element_wise("@", header, ""), pc.binary_join_element_wise(qual, "\n", "")
                text = pc.binary_join_element_wise(header, seq, "+", end, "\n")
                n += len(text)
                held.append(b"".join(text.cast(pa.binary()).to_pylist()))
                size += len(held[-1])
                if size > CHUNK:
                    flush()
                    size = 0
            flush()
            if gz:
                out.write(_LAST)
        return Wrote(context.partitionId(), name, n)

    def commit(self, messages: list[Wrote | None]) -> None:
        system, folder = file_system(self.beside)
        target, end = file_system(self.path)[1], ".fastq.gz" if is_gzip(self.path) else ".fastq"
        system.create_dir(folder, recursive=True)
        there = system.get_file_info(target).type == pyarrow.fs.FileType.Directory
        label = uuid.uuid4().hex[:8]
        names = {f"part-{m.partition:05d}-{label}-{m.records}{end}": m.path for m in sorted((m for m in messages if m), key=lambda m: m.partition)}
        for name, made in names.items():
            system.move(f"{folder}/{made}", f"{folder}/{name}")
        for info in system.get_file_info(pyarrow.fs.FileSelector(folder)):
            if info.base_name not in names:
                system.delete_file(info.path)  # of attempts that were lost
        if there and not self.overwrite:
            first = sum(f.base_name.startswith("part-") for f in system.get_file_info(pyarrow.fs.FileSelector(target)))
            for k, name in enumerate(sorted(names)):
                system.move(f"{folder}/{name}", f"{target}/part-{first + k:05d}-{name.split('-', 2)[2]}")
            system.delete_dir(folder)
        else:
            if there:
                system.delete_dir(target)
            system.move(folder, target)

    def abort(self, messages: list[Wrote | None]) -> None:
        system, folder = file_system(self.beside)
        if system.get_file_info(folder).type == pyarrow.fs.FileType.Directory:
            system.delete_dir(folder)


def record_text(name: str, seq: str, qual: str) -> F.Column:
    """A record as four lines."""
    return F.concat(F.lit("@"), F.col(name), F.lit("\n"), F.col(seq), F.lit("\n+\n"), F.col(qual))


def write_folder(rows: DataFrame, path: str, order: list[str], name: str = "name", seq: str = "seq", qual: str = "qual") -> None:
    """Records in order as numbered part files of a folder, in place of one that is there; gzip if the path ends in gz.

    Without ``order`` the rows are in order as they are partitioned.
    """
    register(rows.sparkSession)
    sorted_rows = (rows.orderBy(*order) if order else rows).select(F.col(name).alias("name"), F.col(seq).alias("seq"), F.col(qual).alias("qual"))
    sorted_rows.write.format("fastq").mode("overwrite").save(path)


def _hadoop(spark: SparkSession, path: str) -> tuple[object, object]:
    """The file system of a path, and the path, as the JVM knows them."""
    full = path if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path) else f"file://{os.path.abspath(path)}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(full)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def join_parts(spark: SparkSession, folder: str, path: str) -> None:
    """The part files of a folder as one file, in the order of their names; the folder goes."""
    system, where = _hadoop(spark, folder)
    out_system, out_where = _hadoop(spark, path)
    out_system.setWriteChecksum(False)
    copy = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    out = out_system.create(out_where, True)
    try:
        for part in sorted((f.getPath() for f in system.listStatus(where)), key=lambda p: p.getName()):
            if part.getName().startswith("part-"):
                source = system.open(part)
                copy(source, out, 1 << 20, False)
                source.close()
    finally:
        out.close()
    system.delete(where, True)


def write_file(rows: DataFrame, path: str, order: list[str], name: str = "name", seq: str = "seq", qual: str = "qual") -> None:
    """Records in order as one file: sorted parts beside it, then their bytes put together."""
    parts = f"{path}.parts-{uuid.uuid4().hex}" + (".gz" if path.endswith("gz") else "")
    write_folder(rows, parts, order, name, seq, qual)
    join_parts(rows.sparkSession, parts, path)


def write_pair_folders(rows: DataFrame, r1: str, r2: str) -> None:
    """Pairs (name1, r1_seq, r1_qual, name2, r2_seq, r2_qual), in order as they are partitioned, as two folders with equal parts."""
    write_folder(rows, r1, [], "name1", "r1_seq", "r1_qual")
    write_folder(rows, r2, [], "name2", "r2_seq", "r2_qual")


def count_records(path: str) -> int:
    """Lines by four, plain or gzip."""
    with open_lines(path) as lines:
        return sum(1 for _ in lines) // 4


def record_counts(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, records) of many files and folders, lines by four; large files are counted in pieces."""
    parts = {p: files_of(p) for p in sorted(set(paths))}
    lines = line_counts(spark, [f for some in parts.values() for f in some], split_bytes)
    return spark.createDataFrame([(p, sum(lines[f] // 4 for f in some)) for p, some in parts.items()], "path string, records long")


def check_gzip(path: str) -> None:
    """Decode a gzip file and discard it; damage is an error."""
    try:
        with open_lines(path) as lines:
            while lines.read(1 << 20):
                pass
    except (OSError, EOFError) as e:
        raise InputError(f"{path} is damaged: {e}") from e


def gzip_faults(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, fault): what is wrong with each gzip file or folder, null where it is whole; decoded and checked on executors.

    Blocked files are checked by ranges of their members, others by a task each.
    """
    files = [(path, part, file_size(part) or 0) for path in dict.fromkeys(paths) for part in files_of(path)]
    step, work = cut_bytes([size for _, _, size in files], split_bytes), []
    for path, part, size in files:
        cuts = range(0, size, step) if size and is_blocked(part) else []
        work += [(path, part, a, min(a + step, size), size) for a in cuts] or [(path, part, 0, None, None)]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                path, part, start, end, size = work[k]
                first = last = fault = None
                try:
                    if end is None:
                        check_gzip(part)
                    else:
                        for at, step, _ in members(part, start, end):
                            first, last = at if first is None else first, at + step
                except InputError as e:
                    fault = str(e)
                row = dict(path=path, part=part, start=start, first=first, last=last, size=size, fault=fault)
                yield pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema([("path", pa.string()), ("part", pa.string()), *((c, pa.int64()) for c in ("start", "first", "last", "size")), ("fault", pa.string())])
    told = spark.range(0, len(work), 1, max(1, len(work))).mapInArrow(check, "path string, part string, start long, first long, last long, size long, fault string")
    # members follow each other without a gap, also from one range to the next and up to the end
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("path", "part").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    gap = lambda at: F.concat(F.col("part"), F.lit(" is damaged: no whole member at byte "), at.cast("string"))
    told = told.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("fault", F.coalesce("fault", F.when(F.col("first") != F.col("before"), gap(F.col("before")))))
    by_part = told.groupBy("path", "part", "size").agg(
        F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("start"))).alias("fault"), F.coalesce(F.max("last"), F.lit(0)).alias("end")
    )
    by_part = by_part.withColumn("fault", F.coalesce("fault", F.when(F.col("end") < F.col("size"), gap(F.col("end")))))
    return by_part.groupBy("path").agg(F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("part"))).alias("fault"))


def with_place(rows: DataFrame, ordinal: str = "pair_ordinal", place: str = "place", most: int | None = None) -> DataFrame:
    """Number rows through over all files, in the order of (file_index, ordinal).

    Files are counted (each up to ``most`` rows, where later places don't matter), and only these
    counts, one row per file, are summed in one task and broadcast: rows of a file are a hot key to any join by shuffle.
    """
    counted = rows if most is None else rows.where(F.col(ordinal) < most)
    files = counted.groupBy("file_index").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file_index").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("file_index", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    return counted.join(F.broadcast(bases), "file_index").withColumn(place, F.col("__base") + F.col(ordinal)).select(*rows.columns, place)


def head(rows: DataFrame, n: int, ordinal: str = "pair_ordinal") -> DataFrame:
    """The first n rows over all files."""
    return with_place(rows, ordinal, "__place", n).where(F.col("__place") < n).drop("__place")
