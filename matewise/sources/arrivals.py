"""Pairs of FASTQ files as they arrive in a folder.

The stream's offset is a number of file pairs.  Mates may arrive in different batches: a pair
counts when both its files are there, and is then written to a log, so that its number stays the
same whatever arrives later and after a restart.  Files are to appear whole, by a rename, as do
folders of parts, which count as files; one reader at a time keeps the log.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSourceStreamReader, InputPartition

from ..functions.errors import InputError
from .splits import file_system

#: Names of folders that hold a file's parts; what is written beside them has others.
_FOLDER = re.compile(r"\.(fastq|fq)(\.gz)?$")


class Arrivals:
    """The complete pairs of ``folder`` in the order in which they were first seen, by the log.

    Mates have equal names but for ``marks`` (forward, reverse), the first place each is found at.
    """

    def __init__(self, folder: str, log: str, marks: tuple[str, str] = ("_1.", "_2.")):
        if not all(marks) or marks[0] == marks[1]:
            raise InputError("forward and reverse files need different marks")
        self.folder, self.log, self.marks = folder.rstrip("/"), log.rstrip("/"), marks

    def known(self) -> list[tuple[str, str]]:
        system, inner = file_system(self.log)
        if system.get_file_info(inner).type != pyarrow.fs.FileType.Directory:
            return []
        files = sorted(f.path for f in system.get_file_info(pyarrow.fs.FileSelector(inner)) if f.base_name.endswith(".json"))
        out: list[tuple[str, str]] = []
        for path in files:
            with system.open_input_file(path) as f:
                out += map(tuple, json.loads(f.read()))
        return out

    def look(self) -> int:
        """Log the pairs that are complete by now; how many are known."""
        system, inner = file_system(self.folder)
        there = system.get_file_info(pyarrow.fs.FileSelector(inner, allow_not_found=True))
        names = {f.base_name for f in there if f.is_file or _FOLDER.search(f.base_name)}
        found, known = [], self.known()
        old = set(known)
        for name in sorted(names):
            mate = name.replace(*self.marks, 1)
            pair = f"{self.folder}/{name}", f"{self.folder}/{mate}"
            if self.marks[0] in name and mate in names and pair not in old:
                found.append(pair)
        if found:
            system, inner = file_system(self.log)
            system.create_dir(inner, recursive=True)
            beside = f"{inner}/{uuid.uuid4().hex}"
            with system.open_output_stream(beside) as f:
                f.write(json.dumps(found).encode())
            system.move(beside, f"{inner}/{len(known):012d}.json")
        return len(known) + len(found)


class PairStreamReader(DataSourceStreamReader):
    """Batches of file pairs; ``parts`` makes the parts of a pair and ``batch`` reads them."""

    def __init__(self, arrivals: Arrivals, batch: object, parts: Callable[[int, str, str], list[InputPartition]]):
        self.arrivals, self.batch, self.parts = arrivals, batch, parts

    def initialOffset(self) -> dict:
        return {"pairs": 0}

    def latestOffset(self) -> dict:
        return {"pairs": self.arrivals.look()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        known = self.arrivals.known()
        return [part for i in range(start["pairs"], end["pairs"]) for part in self.parts(i, *known[i])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from self.batch.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing to do: the log says what is known, the checkpoint what is done."""

    def stop(self) -> None:
        """Nothing is held."""
