"""The batch job: paired FASTQ in, merged reads, unmerged pairs and a summary out."""

from __future__ import annotations

import argparse
import logging
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import mate_key, same_mates
from ..functions.errors import ERRORS, ConfigError, InputError, PairingError
from ..functions.params import CorrectionParams, EngineConfig, OverlapParams, ValidationPolicy
from ..operators.assembly import READS, assemble, pairs_from
from ..operators.kernel import FAILED
from ..sources import fastq
from .progress import Progress
from .shared import drop, folder
from .stats import RunSummary, run_stats

log = logging.getLogger("matewise")


ORDER = ["file_index", "pair_ordinal"]
#: What counters and outputs take of a result.
KEPT = [*ORDER, "r1_name", "r2_name", *READS, "status", "reason", "seq", "qual"]
#: Bytes of a row group of the result, which each task that writes it holds.
GROUP = 8 << 20


def run(
    spark: SparkSession,
    r1: str,
    r2: str,
    out: str | None = None,
    unmerged_out: str | None = None,
    config: EngineConfig = EngineConfig(),
    max_mismatches: int = 3,
    progress_every: int = 0,
    progress_mode: str = "plain",
    split_bytes: int = fastq.SPLIT_BYTES,
) -> RunSummary:
    """Assemble two FASTQ files, or lists of files by comma, whose pairs are one sequence in the order of the lists.

    A first pass takes headers alone and ends as soon as mates mismatch more often than allowed, before
    any pair is assembled.  Then pairs are parsed and assembled once, into a result in the shared folder
    (:func:`.shared.folder`) that the counters and both outputs read; executors keep none of it in memory.
    No output is written if any pair fails.  Outputs are folders of parts where their names end in a slash,
    else single files, through which all bytes pass the driver.
    """
    began = time.monotonic()
    scan = fastq.scan_pairs(spark, r1.split(","), r2.split(","), split_bytes)
    check_mates(scan.read(names_only=True), max_mismatches)
    named = pairs_from(scan.read(), [*ORDER, "r1_name", "r2_name"], r1_name="r1_name", r2_name="r2_name")
    tasks = spark.sparkContext.defaultParallelism
    spread = named if len(scan.parts) >= tasks else named.repartition(tasks * 2)
    progress = Progress(spark.sparkContext, progress_every, progress_mode)
    assembled = assemble(spread, config, progress.seen if progress.active else None).select(*KEPT)
    place = folder(spark, "job")
    try:
        with progress:
            assembled.write.option("parquet.block.size", GROUP).parquet(f"{place}/result")
            result = spark.read.schema(assembled.schema).parquet(f"{place}/result")
            counters = run_stats(result, config.correction is not None, unmerged_out is not None).first().asDict()
        if failed := result.where(F.col("status") == FAILED).orderBy(*ORDER).select("r1_name", "reason").first():
            raise ERRORS.get(failed["reason"], InputError)(f"pair failed: {failed['r1_name']}: {failed['reason']}")
        merged = merged_reads(result)
        if out:
            write(merged, out, ORDER)
        else:
            for row in merged.orderBy(*ORDER).select(fastq.record_text("name", "seq", "qual").alias("v")).toLocalIterator():
                sys.stdout.write(row["v"] + "\n")
        if unmerged_out:
            write(unmerged_reads(result), unmerged_out, [*ORDER, "mate"])
    finally:
        drop(spark, place)
    return RunSummary(r1, r2, out, unmerged_out, time.monotonic() - began, counters)


def write(rows: DataFrame, path: str, order: list[str]) -> None:
    """Records in order, as a folder of parts if the path ends in a slash."""
    (fastq.write_folder if path.endswith("/") else fastq.write_file)(rows, path, order)


def mismatches(names: DataFrame) -> DataFrame:
    """The pairs (file_index, pair_ordinal, r1_name, r2_name) whose mates don't match."""
    return names.where(~same_mates(F.col("r1_name"), F.col("r2_name")))


def check_mates(names: DataFrame, most: int) -> None:
    """Raise if more than ``most`` pairs have mates that don't match, naming the pair with which that is so.

    As many mismatches are looked for as make the error, so on files in different orders few tasks run.
    """
    bad = mismatches(names)
    if most >= (1 << 31) - 1 or bad.limit(most + 1).count() <= most:
        return
    last = bad.orderBy(*ORDER).limit(most + 1).orderBy(*[F.desc(c) for c in ORDER]).first()
    earlier = names.where(f"file_index < {last['file_index']}").count()
    raise PairingError(
        f"more than {most} mates don't match, so the files seem to be in different orders; last headers: {last['r1_name']}, "
        f"{last['r2_name']}; {earlier + last['pair_ordinal'] + 1} pairs seen before failure; sort both files alike and run again"
    )


def merged_reads(result: DataFrame) -> DataFrame:
    """(file_index, pair_ordinal, name, seq, qual); the name has no description."""
    name = F.regexp_extract("r1_name", r"^(\S*)", 1)
    return result.where("status = 'merged'").select(*ORDER, mate_key(name).alias("name"), "seq", "qual")


def unmerged_reads(result: DataFrame) -> DataFrame:
    """(file_index, pair_ordinal, mate, name, seq, qual): both original records, headers untouched."""
    mates = [
        F.struct(F.lit(m).alias("mate"), F.col(f"r{m}_name").alias("name"), F.col(f"r{m}_seq").alias("seq"), F.col(f"r{m}_qual").alias("qual"))
        for m in (1, 2)
    ]
    return result.where(F.col("status").isin("no_overlap", "validation_rejected")).select(*ORDER, F.inline(F.array(*mates)))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="matewise", description="Merge overlapping read pairs.")
    p.add_argument("r1")
    p.add_argument("r2")
    p.add_argument("-o", "--output", help="merged reads, as a folder of parts if it ends in a slash; standard output if left out")
    p.add_argument("-u", "--unmerged", help="unmerged pairs, interleaved; a folder if it ends in a slash")
    p.add_argument("--max-differences", type=int, default=5)
    p.add_argument("--min-overlap", type=int, default=10)
    p.add_argument("--max-difference-share", type=float, default=0.2)
    p.add_argument("--min-comparisons", type=int, default=10)
    p.add_argument("-k", type=int, default=3)
    p.add_argument("--min-score", type=int, default=30)
    p.add_argument("--no-validate", action="store_true")
    p.add_argument("--no-correct", action="store_true")
    p.add_argument("--max-mate-mismatches", type=int, default=3)
    p.add_argument("--progress-every", type=int, default=100_000, help="pairs between progress lines; 0 for none")
    p.add_argument("--summary", help="write the summary as JSON")
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("-q", "--quiet", action="count", default=0)
    return p


def config_from(args: argparse.Namespace) -> EngineConfig:
    overlap = OverlapParams(args.max_differences, args.min_overlap, args.max_difference_share, args.min_comparisons)
    policy = None if args.no_validate else ValidationPolicy().with_k(args.k).with_score(args.min_score)
    return EngineConfig(overlap, policy, correction=None if args.no_correct else CorrectionParams())


def main(argv: list[str] | None = None) -> int:
    args_in = sys.argv[1:] if argv is None else argv
    if not args_in:
        parser().print_help()
        return 0
    args = parser().parse_args(args_in)
    levels = [logging.ERROR, logging.WARNING, logging.INFO, logging.DEBUG]
    logging.basicConfig(level=logging.CRITICAL if args.quiet > 2 else levels[max(0, min(3, 1 + args.verbose - args.quiet))])
    try:
        config = config_from(args)
    except ConfigError as e:
        log.error("%s", e)
        return 2
    spark = SparkSession.builder.appName("matewise").getOrCreate()
    mode = "off" if args.quiet else "live" if sys.stderr.isatty() else "plain"
    every = max(0, args.progress_every)
    summary = run(spark, args.r1, args.r2, args.output, args.unmerged, config, args.max_mate_mismatches, every, mode)
    if args.summary:
        with open(args.summary, "w", encoding="utf-8") as f:
            f.write(summary.json())
    if args.quiet < 2:
        sys.stderr.write(summary.text())
    return 0


if __name__ == "__main__":
    sys.exit(main())
