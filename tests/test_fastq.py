"""FASTQ in pieces, gzip by members, and the write source."""

from __future__ import annotations

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from matewise.functions.errors import InputError, PairingError
from matewise.operators.assembly import assemble, pairs_from
from matewise.plans import file_queries, job
from matewise.sources import fastq, splits
from matewise.streaming import pairs as stream

from test_engine import _fastq, _mix


def text_of(seed: int, n: int, mate: int = 1) -> str:
    """Records whose qualities and sequences start with @ and + where they can."""
    rng, out = random.Random(seed), []
    for i in range(n):
        size = rng.choice([1, 3, 20, 150])
        seq = "".join(rng.choices("ACGT", k=size))
        qual = rng.choice("@+I!") + "".join(rng.choices("@+!IJ", k=size - 1))
        out.append(f"@read{i}/{mate} {'note é' * rng.randrange(2)}\n{seq}\n+{'again' * rng.randrange(2)}\n{qual}\n")
    return "".join(out)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


def written(path, data: bytes, blocked: bool, size: int = 300) -> str:
    if blocked:
        path = path.with_suffix(".fastq.gz")
        data = b"".join(fastq.blocked_gzip(data[k : k + size]) for k in range(0, len(data), size)) + fastq._LAST
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize("blocked", [False, True])
def test_any_number_of_pieces_gives_the_rows_of_one(spark, tmp_path, blocked):
    path = written(tmp_path / "a.fastq", text_of(1, 400).encode(), blocked)
    size = fastq.file_size(path)
    want = rows_of(fastq.scan(spark, [path], size))
    assert [r[1] for r in want] == list(range(400))
    assert [r[2:] for r in want] == [tuple(r) for r in fastq.records(path)]
    for n in (7, 64):
        found = splits.index(spark, [path], -(-size // n))[path]
        assert len(found) > n // 2
        assert rows_of(fastq.scan(spark, [path], -(-size // n))) == want


def counted(path: str, cuts: list[int], blocked: bool) -> list[splits.Counted]:
    return [splits.count_lines(path, a, b, blocked) for a, b in zip(cuts, cuts[1:]) if a < b]


@pytest.mark.parametrize("blocked", [False, True])
@pytest.mark.parametrize("end", ["\n", ""])
def test_borders_inside_every_line(tmp_path, blocked, end):
    """A cut at each byte of the file, beside one that stays."""
    data = (text_of(2, 7).rstrip("\n") + end).encode()
    path = written(tmp_path / "a.fastq", data, blocked, 40)
    size = fastq.file_size(path)
    want = list(fastq._checked(fastq.open_lines(path), 0, path))
    for cut in range(size + 1):
        for cuts in ([0, cut, size], sorted([0, cut, size // 3, size])):
            pieces = splits.pieces_of(path, counted(path, cuts, blocked), size, blocked)
            got = [tuple(r.values()) for p in pieces for t in fastq.record_tables(p) for r in t.to_pylist()]
            assert got == want, cuts
            firsts = [p.ordinal for p in pieces]
            assert firsts == [sum(q.records or 0 for q in pieces[:k]) for k in range(len(pieces))]


@pytest.mark.parametrize("blocked", [False, True])
def test_mates_cut_at_different_bytes_meet_by_ordinal(spark, tmp_path, blocked):
    one = written(tmp_path / "a.fastq", text_of(3, 300, 1).encode(), blocked)
    two = written(tmp_path / "b.fastq", text_of(4, 300, 2).encode(), blocked)
    whole = rows_of(fastq.scan_pairs(spark, [one], [two], 1 << 30).read())
    assert [r[1] for r in whole] == list(range(300)) and all(r[2].split("/")[0] == r[5].split("/")[0] for r in whole)
    for split in (900, 2500):
        scan = fastq.scan_pairs(spark, [one], [two], split)
        assert len(scan.parts) > 3 and rows_of(scan.read()) == whole
        names = scan.read(names_only=True)
        assert names.columns == ["file_index", "pair_ordinal", "r1_name", "r2_name"]
        assert rows_of(names) == [(r[0], r[1], r[2], r[5]) for r in whole]
    short = written(tmp_path / "c.fastq", text_of(4, 299, 2).encode(), blocked)
    with pytest.raises(PairingError, match="c.fastq.* ends after 299 complete pairs"):
        fastq.scan_pairs(spark, [one], [short], 900)
    # a mate that can't be cut makes the pair of files one task
    packed = tmp_path / "d.fastq.gz"
    packed.write_bytes(gzip.compress(text_of(4, 300, 2).encode()))
    mixed = fastq.scan_pairs(spark, [one], [str(packed)], 900)
    assert len(mixed.parts) == 1 and rows_of(mixed.read()) == whole


def test_faults_show_in_pieces_as_in_a_whole_file(spark, tmp_path):
    lines = text_of(5, 200).split("\n")
    for k, fault, said in ((401, "", "bases"), (400, "read", "must start with @"), (402, "x", "separator")):
        bad = lines.copy()
        bad[k] = fault
        path = written(tmp_path / f"{k}.fastq", "\n".join(bad).encode(), False)
        with pytest.raises(Exception, match=f"record 101 of .*{said}"):
            fastq.scan(spark, [path], 1000).collect()
        with pytest.raises(InputError, match=f"record 101 of .*{said}"):
            list(fastq.records(path))


def test_lines_with_carriage_returns_tabs_and_other_letters(tmp_path):
    path = tmp_path / "a.fastq"
    path.write_bytes("@a\tb c\r\nAC\r\n+\r\nI\x7f\r\n@é d e\nG\n+x\n!\n".encode() + b"@f\n\n+\n\n@g\nA\n+\n\xe9\n")
    got = [tuple(r.values()) for t in fastq.record_tables(splits.Piece(str(path))) for r in t.to_pylist()]
    assert got == [("a\tb c", "AC", "I\x7f"), ("é d e", "G", "!"), ("f", "", ""), ("g", "A", "é")]


def test_gzip_members(spark, tmp_path):
    data = text_of(6, 800).encode()
    path = written(tmp_path / "a.fastq", data, True)
    assert gzip.open(path).read() == data and splits.is_blocked(path)
    plain = tmp_path / "plain.fastq.gz"
    plain.write_bytes(gzip.compress(data))
    assert not splits.is_blocked(str(plain)) and splits.index(spark, [str(plain)], 500)[str(plain)] == [splits.Piece(str(plain))]
    raw = open(path, "rb").read()
    starts = [at for at, _, _ in splits.members(path, 0, len(raw))]
    assert [c for _, _, c in splits.members(path, 0, len(raw))][0] == data[:300]
    for k, at in enumerate((starts[0] + 30, starts[50] + 40, starts[50] + 2, starts[51] - 3)):
        bad = bytearray(raw)
        bad[at] ^= 1
        (tmp_path / f"bad{k}.fastq.gz").write_bytes(bytes(bad))
    (tmp_path / "cut.fastq.gz").write_bytes(raw[: starts[60] + 9])
    (tmp_path / "cut2.fastq.gz").write_bytes(plain.read_bytes()[:-9])
    names = ["bad0", "bad1", "bad2", "bad3", "cut", "cut2", "a", "plain"]
    told = fastq.gzip_faults(spark, [str(tmp_path / f"{n}.fastq.gz") for n in names], 1500).collect()
    found = {r["path"].rsplit("/", 1)[1].split(".")[0]: r["fault"] for r in told}
    assert found["a"] is None and found["plain"] is None
    assert "member at byte 0 is damaged" in found["bad0"] and found["cut2"] is not None
    assert all(f"at byte {starts[50]}" in found[k] for k in ("bad1", "bad2", "bad3")) and f"at byte {starts[60]}" in found["cut"]


def test_a_header_by_chance_inside_a_member(tmp_path):
    """Content that looks like a member's header, stored as it is, starts no piece."""
    fake = fastq.blocked_gzip(b"x" * 9)[:18]
    member = bytearray(fastq._LAST)
    body = b"\x01" + len(fake).to_bytes(2, "little") + (len(fake) ^ 0xFFFF).to_bytes(2, "little") + fake
    import struct
    import zlib

    member = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(fake), len(fake))
    data = fastq.blocked_gzip(b"a" * 50) + member + fastq.blocked_gzip(b"b" * 50) + fastq._LAST
    (tmp_path / "a.gz").write_bytes(data)
    path, first = str(tmp_path / "a.gz"), len(fastq.blocked_gzip(b"a" * 50))
    with splits.open_bytes(path) as raw:
        assert splits.find_member(raw, first + 1, len(data)) == first + len(member)


@pytest.mark.parametrize("end", ["", ".gz"])
def test_write_source(spark, tmp_path, end):
    fastq.register(spark)
    rows = spark.range(0, 1000, 1, 5).select(F.concat(F.lit("r"), "id").alias("name"), F.lit("AC").alias("seq"), F.lit("II").alias("qual"), "id")
    out = str(tmp_path / f"out.fastq{end}")
    fastq.write_folder(rows, out, ["id"])
    parts = fastq.files_of(out)
    assert len(parts) > 1 and all(p.endswith(f".fastq{end}") for p in parts)
    assert [r[0] for p in parts for r in fastq.records(p)] == [f"r{i}" for i in range(1000)]
    placed = fastq.with_place(fastq.scan(spark, [out]), "ordinal").orderBy("place")
    assert [r["name"] for r in placed.collect()] == [f"r{i}" for i in range(1000)]
    named = rows.withColumnsRenamed({"name": "a", "seq": "b", "qual": "c"}).where("id < 3")
    named.write.format("fastq").mode("append").option("name", "a").option("seq", "b").option("qual", "c").save(out)
    assert fastq.scan(spark, [out]).count() == 1003 and fastq.files_of(out)[: len(parts)] == parts
    rows.limit(0).write.format("fastq").mode("overwrite").save(out)
    assert fastq.scan(spark, [out]).count() == 0 if fastq.files_of(out) else True
    assert [p.name for p in tmp_path.iterdir()] == [f"out.fastq{end}"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    fastq.register(spark)
    (tmp_path / "there").mkdir()
    rows = spark.range(0, 100, 1, 4).select(F.lit("r").alias("name"), F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise("A").alias("seq"), F.lit("I").alias("qual"))
    for out in ("new.fastq", "there"):
        with pytest.raises(Exception, match="lost"):
            rows.write.format("fastq").mode("overwrite").save(str(tmp_path / out))
    assert [p.name for p in tmp_path.iterdir()] == ["there"] and not list((tmp_path / "there").iterdir())


def test_no_pair_is_assembled_past_the_budget(spark, tmp_path, monkeypatch):
    one, two = _mix(50, mismatch=range(3, 40))
    r1, r2 = _fastq(tmp_path / "a.fastq", one), _fastq(tmp_path / "b.fastq", two)
    monkeypatch.setattr(job, "assemble", lambda *_: pytest.fail("assembled"))
    with pytest.raises(PairingError, match="6 pairs seen"):
        job.run(spark, r1, r2, str(tmp_path / "o.fastq"), max_mismatches=2)
    plan = fastq.scan_pairs(spark, [r1], [r2], 500).read(names_only=True)._jdf.queryExecution().toString()
    assert "r1_name" in plan and "r1_seq" not in plan


def test_the_job_writes_folders(spark, tmp_path):
    one, two = _mix(40)
    r1, r2 = _fastq(tmp_path / "a.fastq", one), _fastq(tmp_path / "b.fastq", two)
    job.run(spark, r1, r2, str(tmp_path / "out.fastq.gz") + "/", str(tmp_path / "rest") + "/", split_bytes=700)
    assert [r[0] for p in fastq.files_of(str(tmp_path / "out.fastq.gz")) for r in fastq.records(p)] == [f"m{i}" for i in range(40)]
    assert [r[0] for p in fastq.files_of(str(tmp_path / "rest")) for r in fastq.records(p)] == ["none/1", "none/2", "low/1", "low/2"]


def test_the_job_keeps_nothing_in_memory(spark, tmp_path, monkeypatch):
    """Executors hold no result while outputs are written, and what is stored goes, also when a pair fails."""
    one, two = _mix(40)
    r1, r2 = _fastq(tmp_path / "a.fastq", one), _fastq(tmp_path / "b.fastq", two)
    cached, places, write, folder = [], [], job.write, job.folder
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = held()
    monkeypatch.setattr(job, "write", lambda *a: cached.append(held()) or write(*a))
    monkeypatch.setattr(job, "folder", lambda *a: places.append(folder(*a)) or places[-1])
    job.run(spark, r1, r2, str(tmp_path / "out") + "/", str(tmp_path / "rest") + "/", split_bytes=700)
    assert cached == [before] * 2
    monkeypatch.setattr(job, "run_stats", lambda *a: pytest.fail("no counters"))
    with pytest.raises(pytest.fail.Exception, match="no counters"):
        job.run(spark, r1, r2, str(tmp_path / "never") + "/", split_bytes=700)
    assert len(places) == 2 and not any(os.path.exists(p.removeprefix("file:")) for p in places)


def test_records_are_numbered_where_they_are_read(spark, tmp_path, monkeypatch):
    """No row of a file is shuffled for its number, and an output's records are read once."""
    paths = [written(tmp_path / f"{k}.fastq", text_of(k, 30).encode(), False) for k in range(2)]
    placed = fastq.with_place(fastq.scan(spark, paths, 500), "ordinal")
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert [r["place"] for r in placed.orderBy("file_index", "ordinal").collect()] == list(range(60))
    one, two = _mix(40)
    r1, r2 = _fastq(tmp_path / "a.fastq", one), _fastq(tmp_path / "b.fastq", two)
    job.run(spark, r1, r2, f"{tmp_path}/merged.fastq.gz/", f"{tmp_path}/rest.fastq/", split_bytes=700)
    monkeypatch.setattr(file_queries, "_job", lambda *a: (str(tmp_path), None))
    for name, n in (("merged_fastq", 40), ("unmerged_fastq", 4)):
        rows = file_queries.queries()[name](spark, "")
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.columns == ["ordinal", "name", "description", "seq", "qual"]
        assert sorted(r["ordinal"] for r in rows.collect()) == list(range(n))


def test_readers_hold_little_at_a_time(tmp_path):
    text = "".join(f"@read{i}\n{'ACGT' * 64}\n+\n{'IJ!+' * 64}\n" for i in range(12_000))
    pieces = [(splits.Piece(written(tmp_path / f"{k}.fastq", text.encode(), blocked, 1 << 15)),) for k, blocked in ((1, False), (2, True))]
    batches = list(fastq.PairReader([], False).read(fastq.Part(0, *pieces)))
    assert sum(b.num_rows for b in batches) == 12_000
    assert max(b.nbytes for b in batches) < 3 << 20


def test_a_stream_of_files(spark, tmp_path):
    """Mates that arrive in different batches, a restart, and a budget of mismatches over all batches."""
    files = [_mix(9), _mix(30, mismatch=(5,)), _mix(4, mismatch=(0, 2)), _mix(3, mismatch=(1,))]
    (tmp_path / "in").mkdir()

    def arrive(name: str, k: int, mate: int) -> None:
        _fastq(tmp_path / name, files[k][mate - 1])
        (tmp_path / name).rename(tmp_path / "in" / name)

    def run(most: int = 3) -> list:
        pairs = stream.read_files(spark, str(tmp_path / "in"), str(tmp_path / "log"))
        stream.assemble_files(pairs, str(tmp_path / "out"), str(tmp_path / "state"), max_mismatches=most).awaitTermination(120)
        if not (tmp_path / "out").exists():
            return []
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("file_index", "pair_ordinal", "r1_name", "status").collect()))

    arrive("b_1.fastq", 0, 1)
    arrive("c_2.fastq", 1, 2)
    assert run() == []
    arrive("b_2.fastq", 0, 2)
    first = run()
    assert len(first) == 11 and {r[0] for r in first} == {0}
    arrive("a_1.fastq.gz", 2, 1)
    arrive("c_1.fastq", 1, 1)
    arrive("a_2.fastq.gz", 2, 2)
    rows = run()
    ones, twos = ([str(tmp_path / "in" / f"{x}_{k}.fastq{'.gz' if x == 'a' else ''}") for x in "bac"] for k in (1, 2))
    named = pairs_from(fastq.scan_pairs(spark, ones, twos).read(), stream.FILE_KEYS, r1_name="r1_name", r2_name="r2_name")
    assert rows == sorted(map(tuple, assemble(named).select("file_index", "pair_ordinal", "r1_name", "status").collect()))
    assert run() == rows
    arrive("d_1.fastq", 3, 1)
    arrive("d_2.fastq", 3, 2)
    with pytest.raises(Exception, match="more than 3 mates don't match"):
        run()
    assert len(run(4)) == len(rows) + 5
