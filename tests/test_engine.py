"""Columns, FASTQ, the job, streams, statistics, the warehouse and the driver entry."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from matewise.functions import columns as C
from matewise.functions.errors import EvidenceError, InputError, OverlapError, PairingError
from matewise.functions.params import EngineConfig, OverlapParams, OverlapTie
from matewise.operators.assembly import assemble, pairs_from
from matewise.plans import catalogue, job, progress
from matewise.plans import warehouse as W
from matewise.sources import fastq, tables
from matewise.streaming import pairs as stream

from test_kernel import MIXED, rc

DATA = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("name,key", [("read123/1", "read123"), ("read123/2", "read123"), ("read123/1 extra", "read123"), ("/1", ""), ("read/10", "read/10"), ("a\tb", "a")])
def test_mate_key(spark, name, key):
    assert one(spark, C.mate_key(F.lit(name))) == key


@pytest.mark.parametrize("header,key", [("@read/10 x", "read/10"), ("@read stuff/1", "read"), ("@read/1/2", "read/1"), ("@  spaced/2", "spaced")])
def test_read_id(spark, header, key):
    assert one(spark, C.read_id(F.lit(header))) == key


def test_scalar_functions(spark):
    assert one(spark, C.tagged_sha256(F.lit("ACGT"))) == "sha256:" + hashlib.sha256(b"ACGT").hexdigest()
    assert one(spark, C.quality_summary(F.lit("!+5"))).asDict() == {"avg": 10.0, "min": 0, "max": 20}
    assert one(spark, C.quality_summary(F.lit("")))["avg"] == 0.0
    assert one(spark, C.reverse_complement(F.lit("ACGTRn"))) == "nRACGT"
    assert one(spark, C.iupac_reverse_complement(F.lit("ACGTRYN"))) == "NRYACGT"
    with pytest.raises(Exception, match="IUPAC"):
        one(spark, C.iupac_reverse_complement(F.lit("AX")))
    with pytest.raises(Exception, match="empty read id"):
        one(spark, C.checked_read_id(F.lit("@")))
    assert one(spark, C.phred(F.lit("!I "))) == [0, 40, 0]
    assert one(spark, C.safe_fraction(F.lit(1), F.lit(0))) == 0.0


def _fastq(path, records):
    opener = gzip.open if str(path).endswith("gz") else open
    with opener(path, "wt") as f:
        for name, seq, qual in records:
            f.write(f"@{name}\n{seq}\n+\n{qual}\n")
    return str(path)


def _mix(n=1, mismatch=()):
    q, one_, two = "I" * 56, [], []
    for i in range(n):
        other = "x" if i in mismatch else ""
        one_.append((f"m{i}/1", MIXED, q))
        two.append((f"m{i}{other}/2", rc(MIXED), q))
    one_ += [("none/1", "A" * 56, q), ("low/1 note", "A" * 56, q)]
    two += [("none/2", "C" * 56, q), ("low/2 note", "T" * 56, q)]
    return one_, two


@pytest.mark.parametrize("end", ["", ".gz"])
def test_job(spark, tmp_path, end):
    one_, two = _mix(40)
    r1, r2 = _fastq(tmp_path / f"a.fastq{end}", one_), _fastq(tmp_path / f"b.fastq{end}", two)
    out, rest = str(tmp_path / f"out.fastq{end}"), str(tmp_path / f"rest.fastq{end}")
    summary = job.run(spark, r1, r2, out, rest)
    s = summary.stats
    assert (s["pairs_seen"], s["pairs_merged"], s["pairs_unmerged_no_overlap"], s["pairs_unmerged_validation_rejected"]) == (42, 40, 1, 1)
    assert [r[0] for r in fastq.records(out)] == [f"m{i}" for i in range(40)]
    assert [" ".join(r[:2]).strip() for r in fastq.records(rest)] == ["none/1", "none/2", "low/1 note", "low/2 note"]
    assert fastq.count_records(rest) == 4
    doc = json.loads(summary.json())
    assert doc["stats"]["unmerged_pairs_written"] == 2 and doc["merge_fraction"] == pytest.approx(40 / 42)
    assert "pairs merged:        40 (95.24%)" in summary.text()


def test_mismatch_budget(spark, tmp_path):
    one_, two = _mix(4, mismatch=(1, 2))
    r1, r2 = _fastq(tmp_path / "a.fastq", one_), _fastq(tmp_path / "b.fastq", two)
    s = job.run(spark, r1, r2, str(tmp_path / "o.fastq"), max_mismatches=2).stats
    assert (s["pairs_seen"], s["pairs_processed"], s["mate_id_mismatches"], s["pairs_merged"]) == (6, 4, 2, 2)
    with pytest.raises(PairingError, match="3 pairs seen"):
        job.run(spark, r1, r2, str(tmp_path / "never.fastq"), max_mismatches=1)
    assert not (tmp_path / "never.fastq").exists()


@pytest.mark.parametrize("end", ["", ".gz"])
def test_job_over_several_files(spark, tmp_path, end):
    """Two pairs of files: outputs in the order of the lists, one mismatch budget over both."""
    many = [_mix(9), _mix(30, mismatch=(5,)), _mix(4, mismatch=(0, 2))]
    ones, twos = ([_fastq(tmp_path / f"{k}{i}.fastq{end}", f[k]) for i, f in enumerate(many)] for k in (0, 1))
    out, rest = str(tmp_path / f"out.fastq{end}"), str(tmp_path / f"rest.fastq{end}")
    s = job.run(spark, ",".join(ones), ",".join(twos), out, rest).stats
    assert (s["pairs_seen"], s["mate_id_mismatches"], s["pairs_merged"]) == (49, 3, 40)
    want = [f"m{i}" for i in range(9)] + [f"m{i}" for i in range(30) if i != 5] + ["m1", "m3"]
    assert [r[0] for r in fastq.records(out)] == want
    assert [r[0] for r in fastq.records(rest)] == ["none/1", "none/2", "low/1", "low/2"] * 3
    with pytest.raises(PairingError, match="44 pairs seen"):
        job.run(spark, ",".join(ones), ",".join(twos), str(tmp_path / "never.fastq"), max_mismatches=1)
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name[0].isdigit()) == [f"out.fastq{end}", f"rest.fastq{end}"]
    fastq.register(spark)
    pairs = spark.read.format("fastq_pairs").option("r1", ",".join(ones)).option("r2", ",".join(twos)).load()
    got = [(r["file_index"], r["pair_ordinal"]) for r in fastq.head(pairs, 13).orderBy("file_index", "pair_ordinal").collect()]
    assert got == [(0, i) for i in range(11)] + [(1, 0), (1, 1)]
    assert [r["place"] for r in fastq.with_place(pairs).orderBy("place").collect()] == list(range(49))
    assert {r["path"]: r["records"] for r in fastq.record_counts(spark, ones).collect()} == dict(zip(ones, (11, 32, 6)))


def test_a_failed_pair_ends_the_job(spark, tmp_path):
    one_, two = _mix(3)
    two[1] = ("m1/2", rc(MIXED)[:-1] + "A" * 0, "I" * 55)
    r1, r2 = _fastq(tmp_path / "a.fastq", one_), _fastq(tmp_path / "b.fastq", two)
    config = EngineConfig(OverlapParams(5, 10, 0.2, 10, OverlapTie.REJECT))
    with pytest.raises(OverlapError, match="m0/1: overlap_tie"):
        job.run(spark, r1, r2, str(tmp_path / "o.fastq"), config=config)
    assert not (tmp_path / "o.fastq").exists()


def test_progress(spark, tmp_path):
    one_, two = _mix(40)
    r1, r2 = _fastq(tmp_path / "a.fastq", one_), _fastq(tmp_path / "b.fastq", two)
    assert progress.message(Counter(merged=3, no_overlap=1, validation_rejected=1, mate_mismatch=1), 2.0) == (
        "pairs=6 merged=3 unmerged=2 (60.0% merged) mate_mismatches=1 3 pairs/s top_unmerged=no_overlap:1"
    )
    assert progress.message(Counter(), 0.0).endswith("(0.0% merged) mate_mismatches=0 0 pairs/s top_unmerged=none")
    fastq.register(spark)
    named = pairs_from(spark.read.format("fastq_pairs").option("r1", r1).option("r2", r2).load(), "pair_ordinal")
    for mode, lines in (("plain", 1), ("live", 0), ("off", 0)):
        out = io.StringIO()
        with progress.Progress(spark.sparkContext, 10, mode, out) as p:
            assemble(named, seen=p.seen).count()
        assert out.getvalue().count("\n") >= lines and ("pairs=42 merged=40" in out.getvalue()) == (mode != "off")


def test_files_of_different_lengths(spark, tmp_path):
    one_, two = _mix(2)
    r1, r2 = _fastq(tmp_path / "a.fastq", one_), _fastq(tmp_path / "b.fastq", two[:-1])
    fastq.register(spark)
    with pytest.raises(Exception, match="ends after 3 complete pairs"):
        spark.read.format("fastq_pairs").option("r1", r1).option("r2", r2).load().collect()


@pytest.mark.parametrize("text", ["r\nA\n+\nI\n", "@r\nA\n-\nI\n", "@r\nAC\n+\nI\n", "@r\nA\n+\n", "@r\nA\n+\n \n", "@r\n"])
def test_malformed_records(tmp_path, text):
    path = tmp_path / "bad.fastq"
    path.write_text(text)
    with pytest.raises(InputError):
        list(fastq.records(str(path)))


def test_fastq_source_and_head(spark, tmp_path):
    one_, two = _mix(9)
    r1, r2 = _fastq(tmp_path / "a.fastq", one_), _fastq(tmp_path / "b.fastq.gz", two)
    fastq.register(spark)
    rows = spark.read.format("fastq").option("path", r1).load().collect()
    assert [(r["ordinal"], r["name"], r["description"]) for r in rows][-1] == (10, "low/1", "note")
    pairs = spark.read.format("fastq_pairs").option("r1", r1).option("r2", r2).load()
    assert fastq.head(pairs, 3).count() == 3
    fastq.check_gzip(r2)
    (tmp_path / "c.gz").write_bytes(b"no gzip")
    with pytest.raises(InputError):
        fastq.check_gzip(str(tmp_path / "c.gz"))


def test_help_and_bad_config(capsys):
    assert job.main([]) == 0 and "usage" in capsys.readouterr().out
    assert job.main(["a", "b", "-k", "1", "--min-score", "30"]) == 2


def test_stream(spark, tmp_path):
    rows = [(i, MIXED, "I" * 56, rc(MIXED), "I" * 56) for i in range(5)]
    spark.createDataFrame(rows, stream.SCHEMA).write.parquet(str(tmp_path / "in"))
    q = stream.assemble_stream(stream.read_pairs(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).where("status = 'merged'").count() == 5


def test_small_sources(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("# name\taccession\n\na\tX1\t50\tnote\nb\tX2\n")
    got = {r["name"]: r["read_pairs"] for r in tables.with_effective_pairs(tables.datasets(spark, str(tmp_path / "d.tsv")), 80).collect()}
    assert got == {"a": 50, "b": 80}
    (tmp_path / "bad.tsv").write_text("a\tX1\t-5\n")
    with pytest.raises(InputError):
        tables.datasets(spark, str(tmp_path / "bad.tsv"))
    (tmp_path / "log").write_text("Pairs: 1,200 done\n  77 Merged reads (6%)\n")
    assert tables.log_metrics(spark, str(tmp_path / "log"), ["Pairs"], ["Merged reads"]) == {"Pairs": 1200, "Merged reads": 77}
    (tmp_path / "t.json").write_text('{"results": [{"mean": 1.5, "median": 1.4, "min": 1, "max": 2, "user": 3, "system": 0.5}]}')
    r = tables.timings(spark, str(tmp_path / "t.json")).first()
    assert (r["mean"], r["stddev"]) == (1.5, None)
    assert tables.paired_run("PAIRED", "a;b") == ["a", "b"]
    with pytest.raises(InputError):
        tables.paired_run("SINGLE", "a;b")


def _execution(tool, n, folder="o"):
    return dict(
        run_key="r1", dataset_name="d", tool=tool, command="run it", execution_order=1, hyperfine_mean_s=1.5, hyperfine_median_s=1.0,
        hyperfine_stddev_s=None, hyperfine_min_s=1.0, hyperfine_max_s=1.0, hyperfine_user_s=1.0, hyperfine_system_s=1.0, merged_reads=n,
        merged_read_records=n, output_dir=folder,
    )


def _run(key="r1", **more):
    return dict(
        run_key=key, created_at="20240101T000000Z", status="running", benchmark_mode="default", read_pairs=10, replicates=3, threads=8,
        run_dir="runs/r1", config_path="c.tsv", data_root="data", vcs_kind="git",
    ) | more


def _warehouse(spark, tmp_path):
    w = W.Warehouse.create(spark, str(tmp_path / "w"))
    w.insert("benchmark_runs", _run())
    w.insert("dataset_subsets", dict(run_key="r1", dataset_name="d", accession="X", read_pairs=10, r1_path="a", r2_path="b", r1_bytes=1, r2_bytes=2))
    return w


def _reads(spark, *ids):
    return W.read_records(spark.createDataFrame([(f"@{i} x", "ACGT", "IIII") for i in ids], "header string, seq string, qual string"))


def test_warehouse(spark, tmp_path):
    with pytest.raises(EvidenceError):
        W.Warehouse.open(spark, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    w, reads = _warehouse(spark, tmp_path), lambda *ids: _reads(spark, *ids)
    w.replace_evidence(_execution("one", 2), reads("a", "b"))
    w.replace_evidence(_execution("two", 3), reads("b", "c", "d"))
    w.upsert_execution(_execution("zero", 0))
    assert w.agreement_report("r1").count() == 0  # still running
    with pytest.raises(EvidenceError):
        w.latest("default")
    w.complete_run("r1", "20240102T000000Z")
    w = W.Warehouse.open(spark, w.root)
    assert w.latest("default") == "r1" and w.run("r1").count() == 1
    got = {(r["left_tool"], r["right_tool"]): (r["left_merged"], r["right_merged"], r["shared_merged"], r["jaccard"]) for r in w.agreement_report("r1").collect()}
    assert got == {("one", "two"): (2, 3, 1, 0.25), ("one", "zero"): (2, 0, 0, 0.0), ("two", "zero"): (3, 0, 0, 0.0)}
    for bad in (reads("x", "x"), reads("x")):
        with pytest.raises(EvidenceError):
            w.replace_evidence(_execution("one", 2), bad)
    assert {r["read_id"] for r in w.table("merged_read_records").where("tool = 'one'").collect()} == {"a", "b"}
    w.validate()
    w.insert("artifacts", dict(run_key="r1", dataset_name="lost", tool="one", artifact_kind="command", path="p", required=True))
    with pytest.raises(EvidenceError, match="reference"):
        w.validate()
    rows = [r.asDict() for r in w.tool_results("r1").collect()]
    assert len(rows[0]) == 20 and "| d | one | 1.5 | 1.0 |  | 1.0 | 1.0 | 2 |" in W.timing_markdown(rows)
    W.write_results(w.tool_results("r1"), str(tmp_path / "results"))
    text = next(p for p in (tmp_path / "results").iterdir() if p.name.startswith("part-")).read_text().splitlines()
    assert text[0].split("\t")[:3] == ["run_id", "benchmark_mode", "dataset"] and len(text) == 4
    assert text[1].split("\t")[8:11] == ["1.5", "1.0", ""]
    table = W.overlap_table([r.asDict() for r in w.agreement_report("r1").collect()]).splitlines()
    assert table[0].startswith("╭─") and len(table) == 7 and "│ one       │ two        │ 2" in table[3]
    for empty in (lambda: W.overlap_table([]), lambda: W.write_results(w.tool_results("none"), str(tmp_path / "no"))):
        with pytest.raises(EvidenceError):
            empty()


def test_agreement_of_many_tools(spark):
    """More tools than a long has bits, in two datasets, against sets."""
    rng = random.Random(9)
    merged = {(d, f"t{k:02}"): {f"r{i}" for i in range(40) if rng.random() < 0.3} for d in ("d1", "d2") for k in range(70 if d == "d1" else 3)}
    merged["d2", "t01"] = set()
    records = spark.createDataFrame([("r", d, t, i) for (d, t), ids in merged.items() for i in ids], "run_key string, dataset_name string, tool string, read_id string")
    executions = spark.createDataFrame([("r", d, t) for d, t in merged], "run_key string, dataset_name string, tool string")
    got = {(r["dataset_name"], r["left_tool"], r["right_tool"]): tuple(r)[4:9] for r in W.agreement(records, executions).collect()}
    want = {
        (d, a, b): (len(x), len(y), len(x & y), len(x - y), len(y - x))
        for (d, a), x in merged.items() for (e, b), y in merged.items() if d == e and a < b
    }
    assert got == want


def test_evidence_changes_as_a_whole(spark, tmp_path, monkeypatch):
    w, reads = _warehouse(spark, tmp_path), lambda *ids: _reads(spark, *ids)
    log = spark.createDataFrame([("r1", "d", "one", "command", "old", True, 1)], W.SCHEMAS["artifacts"])
    w.replace_evidence(_execution("one", 1), reads("a"), log)
    state = lambda: [sorted(map(tuple, w.table(n).collect()), key=str) for n in W.SCHEMAS]
    before, switch = state(), W.Warehouse._switch
    monkeypatch.setattr(W.Warehouse, "_switch", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    for change in (lambda: w.replace_evidence(_execution("one", 2), reads("b", "c")), lambda: w.complete_run("r1", "t"), lambda: w.upsert_execution(_execution("x", 0))):
        with pytest.raises(RuntimeError):
            change()
        assert state() == before
    monkeypatch.setattr(W.Warehouse, "_switch", switch)
    w.replace_evidence(_execution("one", 2), reads("b", "c"))
    assert {r["read_id"] for r in w.table("merged_read_records").collect()} == {"b", "c"} and w.table("artifacts").count() == 0
    w.upsert_execution(_execution("one", 2, "elsewhere"))
    assert w.table("merged_read_records").count() == 2 and w.table("tool_executions").first()["output_dir"] == "elsewhere"
    now = state()
    assert w.vacuum() > 3 and state() == now and w.vacuum() == 0
    with pytest.raises(EvidenceError):
        w.append("merged_read_records", reads("z"))


def test_artifacts(spark, tmp_path):
    assert len(W.ARTIFACT_KINDS) == 16
    for name in ("fastp.json", "out.fastq"):
        (tmp_path / name).write_text("12345")
    paths = {k: str(tmp_path / ("out.fastq" if k == "merged_fastq" else k)) for k in W.COMMON_ARTIFACTS}
    rows = W.artifacts_of(spark, _execution("fastp", 1, str(tmp_path)), paths)
    got = {r["artifact_kind"]: (r["required"], r["bytes"]) for r in rows.collect()}
    assert len(got) == 10 and got["merged_fastq"] == (True, 5) and got["fastp_json"] == (True, 5) and got["fastp_failed_fastq"] == (False, None)
    assert {r["artifact_kind"] for r in W.missing_artifacts(rows).collect()} == {"command", "stdout_log", "stderr_log", "hyperfine_json", "fastp_html"}
    w = _warehouse(spark, tmp_path)
    w.replace_evidence(_execution("fastp", 0, str(tmp_path)), _reads(spark, "a").limit(0), rows)
    w.validate()
    w.insert("artifacts", dict(run_key="r1", dataset_name="d", tool="fastp", artifact_kind="photo", path="p", required=True))
    with pytest.raises(EvidenceError, match="artifacts: check"):
        w.validate()


def test_tool_accounting(spark, tmp_path):
    assert W.accounting(10, 10, 5, 5, [5, 5], [5, 5], "") == []
    assert len(W.accounting(10, 9, 5, 4, [5, 4], [5, 4], "java.lang.Error")) == 5
    record = "@a\nA\n+\nI\n"
    (tmp_path / "m.fastq").write_text(record * 7)
    (tmp_path / "bbmerge.unmerged1.fastq").write_text(record * 3)
    log = "Pairs:  10\t100%\nJoined:  7 \t70%\nNo Solution: 2\nToo Short: 1\n"
    (tmp_path / "bbmerge.stderr.log").write_text(log)
    check = lambda tool="bbmerge", pairs=10: W.check_tool(spark, tool, str(tmp_path), pairs, str(tmp_path / "m.fastq"))
    check()
    (tmp_path / "vsearch.stderr.log").write_text("  10  Pairs\n   7  Merged (70.0%)\n   3  Not merged (30.0%)\n")
    check("vsearch")
    check("unknown")
    (tmp_path / "bbmerge.unmerged2.fastq").write_text(record * 4)
    with pytest.raises(EvidenceError, match="4 records, expected 3"):
        check()
    (tmp_path / "bbmerge.unmerged2.fastq").write_text(record * 3)
    with pytest.raises(EvidenceError, match="reported 10 pairs, expected 11"):
        check(pairs=11)
    for text, message in ((log + "java.lang.OutOfMemoryError\n", "exception"), (log.replace("Joined", "Jonied"), "lacks Joined")):
        (tmp_path / "bbmerge.stderr.log").write_text(text)
        with pytest.raises(EvidenceError, match=message):
            check()


def test_metadata_files(spark, tmp_path):
    r1 = _fastq(tmp_path / "a.fastq.gz", [("x", "ACGT", "IIII")] * 3)
    dataset = {"name": "d", "accession": "X1", "note": "few"}
    listing = {"run": "R", "platform": "P", "layout": "PAIRED", "strategy": "S", "read_count": 3, "base_count": 12, "urls": "u1;u2"}
    tables.write_source(spark, str(tmp_path / "source"), dataset, listing, r1, r1)
    source = tables.read_source(spark, str(tmp_path / "source"))
    assert (source["name"], source["r1"], source["note"]) == ("d", r1, "few")
    tables.write_subset(spark, str(tmp_path / "subset"), source, 3, r1, r1)
    subset = tables.read_subset(spark, str(tmp_path / "subset"))
    assert (subset["read_pairs"], subset["r2_records"]) == ("3", "3") and int(subset["r1_bytes"]) > 20
    with pytest.raises(InputError):
        tables.write_source(spark, str(tmp_path / "x"), dataset, listing | {"layout": "SINGLE"}, r1, r1)
    with pytest.raises(InputError):
        tables.metadata(spark, str(tmp_path / "subset"), 10)


QUERIES = sorted(catalogue.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "nation", "region", "supplier"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    rows = catalogue.queries()[name](spark, DATA)
    names = sorted(rows.columns)
    rel = con.sql(catalogue.oracle_sql()[name])
    assert sorted(rel.columns) == names
    key = lambda r: tuple((x is None, str(x)) for x in r)
    mine = sorted((tuple(r) for r in rows.select(*names).collect()), key=key)
    other = sorted(rel.project(", ".join(f'"{c}"' for c in names)).fetchall(), key=key)
    assert len(mine) == len(other)
    for a, b in zip(mine, other):
        assert all(x == y or (isinstance(x, float) and abs(x - y) < 1e-9) for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).count() == 1500
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.oracle_sql()) == set(catalogue.queries())
