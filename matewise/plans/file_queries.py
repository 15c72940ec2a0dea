"""Queries that write files and read them again: FASTQ scans and sinks, the batch job, lists, logs and timings."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.errors import InputError
from ..functions.params import CorrectionParams
from ..sources import fastq, tables
from ..sources.splits import file_system, find_member
from ..streaming import pairs as stream
from . import datagen, job
from . import oracles as O
from .datagen import pairs as generated
from .shared import folder, once, write_text

Query = Callable[[SparkSession, str], DataFrame]
#: More mismatched mates than any table has.
ANY = 1 << 40
#: Bytes of a piece, so that small files are read in several.
SMALL = 1 << 16
#: Bytes of a row group that tasks share out.
GROUP = 8 << 20
#: Pairs of a part of a large file.
PART = 250_000


def _files(spark: SparkSession, sf_dir: str) -> tuple[str, list[str], list[str]]:
    """All pairs by the parity of their keys in two pairs of files in parts, plain and gzip: the folder, forward and reverse files.

    Keys are sorted before anything is generated, so reads are never shuffled, and mates' files have equal parts.
    """
    fastq.register(spark)

    def make() -> tuple[str, list[str], list[str]]:
        root, keys = folder(spark, "fastq"), datagen.keys(spark, sf_dir)
        ones, twos = ([f"{root}/r{k}_even.fastq", f"{root}/r{k}_odd.fastq.gz"] for k in (1, 2))
        parts = max(spark.sparkContext.defaultParallelism, keys.count() // (2 * PART))
        for i in range(2):
            mine = keys.where(F.col("o_orderkey") % 2 == i).repartitionByRange(parts, "o_orderkey").sortWithinPartitions("o_orderkey").persist()
            fastq.write_pair_folders(datagen.pairs_of(mine), ones[i], twos[i])
            mine.unpersist()
        return root, ones, twos

    return once(spark, sf_dir, "fastq", make)


def fastq_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reverse reads, each file in pieces of 64 KiB."""
    _, _, twos = _files(spark, sf_dir)
    return fastq.scan(spark, twos, SMALL)


def fastq_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs written as FASTQ files in the shared folder and read again in step, by pieces of the forward files."""
    return fastq.scan_pairs(spark, *_files(spark, sf_dir)[1:], SMALL).read()


def fastq_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 1,000 pairs over both files."""
    scan = fastq.scan_pairs(spark, *_files(spark, sf_dir)[1:], SMALL)
    return fastq.head(scan.first(1000).read(names_only=True), 1000).select("file_index", "pair_ordinal", "r1_name")


def fastq_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ones, twos = _files(spark, sf_dir)
    counts = fastq.record_counts(spark, [*ones, *twos], SMALL)
    return counts.select(F.element_at(F.split("path", "/"), -1).alias("file"), "records")


_TEXTS = [
    "@{k}\nACGT\n+\nIIII\n",
    "{k}\nACGT\n+\nIIII\n",
    "@{k}\nACGT\n-\nIIII\n",
    "@{k}\nACGT\n+\nIII\n",
    "@{k}\nACGT\n+\n",
    "@{k}\nACGT\n+\nII I\n",
    "@{k}\nAC\udce9T\n+\nIIII\n",
]
_FAULTS = ["none", "header", "separator", "lengths", "cut short", "quality byte", "UTF-8"]
_SAID = [("must start with @", "header"), ("separator", "separator"), ("bases,", "lengths"), ("cut short", "cut short"), ("below 33", "quality byte"), ("not UTF-8", "UTF-8")]


def malformed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the strict reader says of small files with one fault each."""
    fastq.register(spark)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"))
    root = folder(spark, "faults")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            faults = []
            for k in batch.column(0).to_pylist():
                path = f"{root}/{k}.fastq"
                system, inner = file_system(path)
                with system.open_output_stream(inner) as out:
                    out.write(_TEXTS[k % 7].format(k=k).encode("utf-8", "surrogateescape"))
                try:
                    list(fastq.records(path))
                    faults.append("none")
                except InputError as e:
                    faults.append(next(kind for words, kind in _SAID if words in str(e)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(faults, pa.string())], ["k", "fault"])

    return nation.mapInArrow(tell, "k long, fault string")


def _damaged(spark: SparkSession, path: str, root: str) -> list[str]:
    """Copies of a blocked gzip file in parts, a task for each: one cut in the middle, one with a byte changed there."""
    name, parts = path.rsplit("/", 1)[1].removesuffix(".fastq.gz"), fastq.files_of(path)
    copies = [f"{root}/{name}_{kind}.fastq.gz" for kind in ("cut", "changed")]
    ends = list(accumulate(fastq.file_size(p) for p in parts))
    middle = next(k for k, end in enumerate(ends) if end > ends[-1] // 2)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                system, inner = file_system(parts[k])
                with system.open_input_file(inner) as f:
                    size = f.size()
                    # the last bytes of a member are its check sum and size, so no damage there leaves it whole
                    end = find_member(f, size // 2, size) or size
                    f.seek(0)
                    data = f.read()
                cut, changed = data, bytearray(data)
                if k == middle:
                    cut, changed[end - 8] = data[: end - 4], data[end - 8] ^ 255
                for to, some in zip(copies, (cut, bytes(changed))):
                    if k > middle and some is cut:
                        continue  # behind the cut
                    system, inner = file_system(to)
                    system.create_dir(inner, recursive=True)
                    with system.open_output_stream(f"{inner}/{parts[k].rsplit('/', 1)[1]}", compression=None) as out:
                        out.write(some)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["id"])

    spark.range(0, len(parts), 1, len(parts)).mapInArrow(copy, "id long").count()
    return copies


def gzip_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gzip files, the same cut in the middle, and with a byte changed there: checked by ranges of members on executors."""
    _, ones, twos = _files(spark, sf_dir)
    root = folder(spark, "damaged")
    paths = [p for path in (ones[1], twos[1]) for p in (path, *_damaged(spark, path, root))]
    told = fastq.gzip_faults(spark, paths, SMALL)
    return told.select(F.regexp_extract("path", r"([^/]*)\.fastq\.gz$", 1).alias("file"), F.col("fault").isNull().alias("whole"))


def _job(spark: SparkSession, sf_dir: str) -> tuple[str, object]:
    root, ones, twos = _files(spark, sf_dir)
    outputs = f"{root}/merged.fastq.gz/", f"{root}/rest.fastq/"
    run = lambda: job.run(spark, ",".join(ones), ",".join(twos), *outputs, max_mismatches=ANY, split_bytes=SMALL)
    return root, once(spark, sf_dir, "job", run)


def _output(name: str) -> Query:
    """The records of an output.  A folder is one file, whose ordinals run through its parts, so they need no numbering."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        root, _ = _job(spark, sf_dir)
        return fastq.scan(spark, [f"{root}/{name}"], SMALL).select("ordinal", "name", "description", "seq", "qual")

    return query


def job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary's JSON, read again; what varies with time and place is left out."""
    doc = json.loads(_job(spark, sf_dir)[1].json())
    stats = {k: v for k, v in doc["stats"].items()}
    row = stats | {"merge_fraction": doc["merge_fraction"], "unmerged_fraction": doc["unmerged_fraction"]}
    return spark.createDataFrame([tuple(row.values())], list(row))


def job_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary's text by label."""
    lines = [x.strip().partition(":") for x in _job(spark, sf_dir)[1].text().splitlines() if ":" in x]
    varies = ("input", "merged output", "unmerged output", "elapsed", "throughput")
    return spark.createDataFrame([(a, v.strip()) for a, _, v in lines if not a.startswith(varies)], "label string, value string")


def dataset_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a dataset list, with and without a cap, and the pairs each asks for."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()
    lines = ["# name\taccession\tcap\tnote", ""]
    for r in nations:
        lines.append(f"{r['n_name']}\tX{r['n_nationkey']}" + (f"\t{r['n_nationkey'] * 10}\tcapped" if r["n_nationkey"] % 3 == 1 else ""))
    path = write_text(spark, f"{folder(spark, 'lists')}/datasets.tsv", "\n".join(lines) + "\n")
    return tables.with_effective_pairs(tables.datasets(spark, path), 100)


def subset_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of prepared subsets, written and read again; byte sizes are left out."""
    root, ones, twos = _files(spark, sf_dir)
    rows = []
    for i, name in enumerate(("even", "odd")):
        tables.write_subset(spark, f"{root}/{name}", {"name": name, "accession": f"X{i}"}, 7, ones[i], twos[i])
        rows.append(tables.read_subset(spark, f"{root}/{name}"))
    names = ("name", "accession", "read_pairs", "r1_records", "r2_records")
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], list(names))


def tool_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in both grammars of tools' logs."""
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    text = f"version 1\nPairs:               \t{n}\t100%\nJoined: {n // 3} \t33%\nPairs: 0\n  {n}  Pairs\n {n // 2}  Not merged (50.0%)\n"
    path = write_text(spark, f"{folder(spark, 'logs')}/tool.log", text)
    found = tables.log_metrics(spark, path, ["Pairs", "Joined", "Missing"], ["Pairs", "Not merged"])
    return spark.createDataFrame(list(found.items()), "metric string, value long")


def timing_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timing files of suppliers, one with a deviation in two; only the first result counts."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey <= 10").select("s_suppkey", F.col("s_acctbal").cast("double").alias("b")).collect()
    root = folder(spark, "timings")
    for r in rows:
        first = {k: r["b"] / i for i, k in enumerate(("mean", "median", "min", "max", "user", "system"), 1)}
        if r["s_suppkey"] % 2:
            first["stddev"] = 0.5
        write_text(spark, f"{root}/{r['s_suppkey']}.json", json.dumps({"results": [first, {"mean": 0.0}]}))
    return tables.timings(spark, root)


def stream_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs as a stream of tables, by status.

    Tables have small row groups, so a batch of two files is many tasks.
    """
    root = folder(spark, "stream")
    rows = generated(spark, sf_dir).where("key % 4001 <> 0").select("key", "r1_seq", "r1_qual", "r2_seq", "r2_qual")
    rows.write.option("parquet.block.size", GROUP).parquet(f"{root}/in")
    stream.assemble_stream(stream.read_pairs(spark, f"{root}/in", 2), f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("key", "status", "reason", "seq", "qual")


def stream_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes of all file pairs of a folder, read as a stream."""
    files, _, _ = _files(spark, sf_dir)
    root = folder(spark, "stream-files")
    arriving = stream.read_files(spark, files, f"{root}/log", "r1_", "r2_")
    stream.assemble_files(arriving, f"{root}/out", f"{root}/state", max_mismatches=ANY).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("file_index", "pair_ordinal", "r1_name", "status", "reason", "seq", "qual")


def queries() -> dict[str, Query]:
    return {
        "fastq_scan": fastq_scan,
        "fastq_roundtrip": fastq_roundtrip,
        "fastq_head": fastq_head,
        "fastq_counts": fastq_counts,
        "malformed_records": malformed_records,
        "gzip_integrity": gzip_integrity,
        "merged_fastq": _output("merged.fastq.gz"),
        "unmerged_fastq": _output("rest.fastq"),
        "job_summary": job_summary,
        "job_report": job_report,
        "dataset_list": dataset_list,
        "subset_metadata": subset_metadata,
        "tool_log": tool_log,
        "timing_json": timing_json,
        "stream_assemble": stream_assemble,
        "stream_files": stream_files,
    }


def oracle_sql(totals: str) -> dict[str, str]:
    """SQL by query; ``totals`` are the layers up to the counters ``tot`` of a run."""
    f = O.final
    file, place = "CAST(key % 2 AS INTEGER) AS file_index", "row_number() OVER (PARTITION BY key % 2 ORDER BY key) - 1"
    result = O.merged(O.validated(), correction=CorrectionParams())
    faults = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_FAULTS))
    percent = "printf('%d (%.2f%%)', {0}, 100.0 * ({0}) / (m + no + rej))".format
    report = [
        ("pairs seen", "seen"), ("pairs processed", "m + no + rej"), ("pairs merged", percent("m")), ("pairs unmerged", percent("no + rej")),
        ("no overlap", "no"), ("validation reject", "rej"), ("unmerged written", "no + rej"), ("mate ID mismatches", "mis"), ("bases in", "bi"),
        ("bases merged", "bm"), ("quality correction", "'enabled'"),
    ]
    n = "(SELECT count(*) FROM orders)"
    timing = ", ".join(f"CAST(s_acctbal AS DOUBLE) / {i} AS {k}" for i, k in enumerate(("mean", "median", "min", "max", '"user"', "system"), 1))
    return {
        "fastq_scan": f(O.base(), f"SELECT {file}, {place} AS ordinal, split_part(name2, ' ', 1) AS name, split_part(name2, ' ', 2) AS description, r2_seq AS seq, r2_qual AS qual FROM pairs"),
        "fastq_roundtrip": f(O.base(), f"SELECT {file}, {place} AS pair_ordinal, name1 AS r1_name, r1_seq, r1_qual, name2 AS r2_name, r2_seq, r2_qual FROM pairs"),
        "fastq_head": f(
            O.base(),
            f"SELECT file_index, pair_ordinal, r1_name FROM (SELECT {file}, {place} AS pair_ordinal, name1 AS r1_name, row_number() OVER (ORDER BY key % 2, key) AS r FROM pairs) WHERE r <= 1000",
        ),
        "fastq_counts": f(
            O.base(),
            "SELECT 'r' || mate || CASE key % 2 WHEN 0 THEN '_even.fastq' ELSE '_odd.fastq.gz' END AS file, count(*) AS records FROM pairs, (SELECT unnest([1, 2]) AS mate) GROUP BY ALL",
        ),
        "malformed_records": f"SELECT CAST(n_nationkey AS BIGINT) AS k, CASE n_nationkey % 7 {faults} END AS fault FROM nation",
        "gzip_integrity": "SELECT 'r' || mate || '_odd' || kind AS file, kind = '' AS whole FROM (SELECT unnest([1, 2]) AS mate), (SELECT unnest(['', '_cut', '_changed']) AS kind)",
        "merged_fastq": f(
            result,
            f"SELECT row_number() OVER (ORDER BY key % 2, key) - 1 AS ordinal, {O.KEY.format('name1')} AS name, '' AS description, seq, qual "
            "FROM res JOIN pairs USING (key) WHERE status = 'merged'",
        ),
        "unmerged_fastq": f(
            result,
            "SELECT row_number() OVER (ORDER BY key % 2, key, mate) - 1 AS ordinal, split_part(CASE mate WHEN 1 THEN name1 ELSE name2 END, ' ', 1) AS name, "
            "CASE mate WHEN 1 THEN '' ELSE 'extra' END AS description, CASE mate WHEN 1 THEN r1_seq ELSE r2_seq END AS seq, CASE mate WHEN 1 THEN r1_qual ELSE r2_qual END AS qual "
            "FROM res JOIN pairs USING (key), (SELECT unnest([1, 2]) AS mate) WHERE status IN ('no_overlap', 'validation_rejected')",
        ),
        "job_summary": f(
            totals,
            "SELECT seen AS pairs_seen, m + no + rej AS pairs_processed, m AS pairs_merged, no + rej AS pairs_unmerged, no AS pairs_unmerged_no_overlap, "
            "rej AS pairs_unmerged_validation_rejected, no + rej AS unmerged_pairs_written, CAST(0 AS BIGINT) AS unmerged_pairs_not_written, mis AS mate_id_mismatches, "
            "bi AS bases_in, bm AS bases_merged, TRUE AS quality_correction_enabled, CAST(m AS DOUBLE) / (m + no + rej) AS merge_fraction, "
            "CAST(no + rej AS DOUBLE) / (m + no + rej) AS unmerged_fraction FROM tot",
        ),
        "job_report": f(totals, " UNION ALL ".join(f"SELECT '{a}' AS label, CAST({v} AS VARCHAR) AS value FROM tot" for a, v in report)),
        "dataset_list": "SELECT n_name AS name, 'X' || n_nationkey AS accession, CASE WHEN n_nationkey % 3 = 1 THEN 'capped' ELSE '' END AS note, cap AS read_pair_cap, "
        "least(coalesce(cap, 100), 100) AS read_pairs FROM (SELECT *, CASE WHEN n_nationkey % 3 = 1 THEN CAST(n_nationkey * 10 AS BIGINT) END AS cap FROM nation)",
        "subset_metadata": "SELECT CASE o_orderkey % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS name, 'X' || CAST(o_orderkey % 2 AS VARCHAR) AS accession, '7' AS read_pairs, "
        "CAST(count(*) AS VARCHAR) AS r1_records, CAST(count(*) AS VARCHAR) AS r2_records FROM orders GROUP BY o_orderkey % 2",
        "tool_log": f"SELECT 'Pairs' AS metric, {n} AS value UNION ALL SELECT 'Joined', {n} // 3 UNION ALL SELECT 'Missing', NULL UNION ALL SELECT 'Not merged', {n} // 2",
        "timing_json": f"SELECT {timing}, CASE WHEN s_suppkey % 2 = 1 THEN CAST(0.5 AS DOUBLE) END AS stddev FROM supplier WHERE s_suppkey <= 10",
        "stream_assemble": f(result, "SELECT key, status, reason, seq, qual FROM res WHERE key % 4001 <> 0"),
        "stream_files": f(result, f"SELECT {file}, {place} AS pair_ordinal, name1 AS r1_name, status, reason, seq, qual FROM res JOIN pairs USING (key)"),
    }
