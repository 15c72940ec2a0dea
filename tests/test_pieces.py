"""How many tasks read files, and folders of parts as one file."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from matewise.functions.errors import PairingError
from matewise.sources import fastq, splits, tables
from matewise.sources.arrivals import Arrivals, PairStreamReader

from test_fastq import rows_of, text_of, written


def folder_of(path, sizes: list[int], mate: int, end: str, named: bool = True) -> str:
    """Records in parts of ``sizes``."""
    path = path.with_suffix(f".fastq{end}")
    path.mkdir()
    lines = text_of(7 + mate, sum(sizes), mate).split("\n")
    for k, n in enumerate(sizes):
        data = "".join(x + "\n" for x in lines[4 * sum(sizes[:k]) : 4 * sum(sizes[: k + 1])]).encode()
        data = b"".join(fastq.blocked_gzip(data[at : at + 300]) for at in range(0, len(data), 300)) + fastq._LAST if end else data
        (path / f"part-{k:05d}-01234567{f'-{n}' * named}.fastq{end}").write_bytes(data)
    return str(path)


def test_small_pieces_are_few(spark, tmp_path):
    """Tasks don't grow with a large file while pieces are small."""
    path = written(tmp_path / "a.fastq", text_of(1, 2000).encode(), False)
    found = splits.index(spark, [path], 64)[path]
    assert splits.MOST_SMALL // 2 < len(found) <= splits.MOST_SMALL
    assert sum(p.records for p in found) == 2000
    assert splits.cut_bytes([1 << 34], 1 << 16) == splits.SPLIT_BYTES and splits.cut_bytes([1 << 30], 1 << 16) == 1 << 22


def test_a_file_cut_in_its_last_members(spark, tmp_path):
    """No member of the last range is found by its followers; the file still ends too early."""
    raw = open(written(tmp_path / "a.fastq", text_of(6, 800).encode(), True), "rb").read()
    starts = [at for at, _, _ in splits.members(str(tmp_path / "a.fastq.gz"), 0, len(raw))]
    for k, n in enumerate((40, 41, 60)):
        (tmp_path / f"cut{k}.fastq.gz").write_bytes(raw[: starts[n] - 4])
        (tmp_path / f"inside{k}.fastq.gz").write_bytes(raw[: starts[n] + 15])
    paths = [str(p) for p in tmp_path.iterdir()]
    told = {r["path"].rsplit("/", 1)[1]: r["fault"] for r in fastq.gzip_faults(spark, paths, 300).collect()}
    assert [n for n, fault in told.items() if fault is None] == ["a.fastq.gz"]


@pytest.mark.parametrize("end", ["", ".gz"])
def test_a_folder_is_one_file(spark, tmp_path, end):
    one = folder_of(tmp_path / "one", [50, 0, 30, 20], 1, end)
    two = folder_of(tmp_path / "two", [10, 65, 25], 2, end)
    for split in (600, 1 << 30):
        rows = rows_of(fastq.scan(spark, [two, one], split))
        assert [r[:2] for r in rows] == [(i, k) for i in range(2) for k in range(100)]
        pairs = rows_of(fastq.scan_pairs(spark, [one], [two], split).read())
        assert [r[1] for r in pairs] == list(range(100)) and all(r[2].split("/")[0] == r[5].split("/")[0] == f"read{r[1]}" for r in pairs)
    assert [r["records"] for r in fastq.record_counts(spark, [one, two], 600).orderBy("path").collect()] == [100, 100]
    with pytest.raises(PairingError, match="three.*ends after 99 complete pairs"):
        fastq.scan_pairs(spark, [one], [folder_of(tmp_path / "three", [9, 90], 2, end)])
    empty = folder_of(tmp_path / "empty", [0, 0], 1, end)
    assert fastq.scan(spark, [empty]).count() == 0 and fastq.record_counts(spark, [empty]).first()["records"] == 0


def test_the_head_reads_few_parts(spark, tmp_path):
    one, two = folder_of(tmp_path / "one", [50] * 8, 1, ""), folder_of(tmp_path / "two", [50] * 8, 2, "")
    scan = fastq.scan_pairs(spark, [one], [two]).first(60)
    assert len(scan.parts) == 2
    assert [r["pair_ordinal"] for r in fastq.head(scan.read(names_only=True), 60).orderBy("pair_ordinal").collect()] == list(range(60))


def test_records_are_counted_and_checked_by_ranges(spark, tmp_path, monkeypatch):
    path = written(tmp_path / "a.fastq", text_of(6, 800).encode(), True)
    asked, count = [], splits._count
    monkeypatch.setattr(splits, "_count", lambda s, ranges, b: asked.append(len(ranges)) or count(s, ranges, b))
    assert fastq.record_counts(spark, [path], 2000).first()["records"] == 800 and asked[0] > 10
    monkeypatch.setattr(fastq, "check_gzip", lambda p: pytest.fail("decoded as a whole"))
    tables.write_subset(spark, str(tmp_path / "subset"), {"name": "n", "accession": "x"}, 3, path, path)
    assert tables.read_subset(spark, str(tmp_path / "subset"))["r1_records"] == "800"


def test_a_stream_takes_parts_by_tasks(tmp_path):
    for named in (True, False):
        there = tmp_path / f"in{named}"
        there.mkdir()
        folder_of(there / "a_1", [30, 0, 20], 1, ".gz", named)
        folder_of(there / "a_2", [10, 40], 2, ".gz", named)
        reader = PairStreamReader(Arrivals(str(there), str(tmp_path / f"log{named}")), fastq.PairReader([], False), fastq._arrived)
        parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
        assert len(parts) == (2 if named else 1)
        rows = [r for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
        assert [r["pair_ordinal"] for r in rows] == list(range(50))
        assert all(r["r1_name"].split("/")[0] == r["r2_name"].split("/")[0] == f"read{k}" for k, r in enumerate(rows))


def test_written_parts_tell_their_records(spark, tmp_path):
    rows = spark.range(0, 100, 1, 4).select(F.lit("r").alias("name"), F.lit("A").alias("seq"), F.lit("I").alias("qual"))
    for mode in ("overwrite", "append"):
        rows.write.format("fastq").mode(mode).save(str(tmp_path / "a.fastq")) if mode == "append" else fastq.write_folder(rows, str(tmp_path / "a.fastq"), [])
    names = [p.rsplit("/", 1)[1] for p in fastq.files_of(str(tmp_path / "a.fastq"))]
    assert len(names) == 8 and all(fastq._SAID.match(n)[1] == "25" for n in names)
