"""Run statistics: counters as one distributed aggregate, and their text and JSON forms."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_fraction
from ..operators.kernel import MERGED, MISMATCH, NO_OVERLAP, REJECTED


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def run_stats(result: DataFrame, correction: bool = True, unmerged_written: bool = False) -> DataFrame:
    """One row of counters over an assembly result that still has its read columns.

    Pairs whose mates don't match are seen and skipped: they are in neither output and
    not processed.
    """
    status = F.col("status")
    both = F.coalesce(F.length("r1_seq"), F.lit(0)) + F.coalesce(F.length("r2_seq"), F.lit(0))
    counted = result.agg(
        F.count(F.lit(1)).alias("pairs_seen"),
        _count(status == MERGED).alias("pairs_merged"),
        _count(status == NO_OVERLAP).alias("pairs_unmerged_no_overlap"),
        _count(status == REJECTED).alias("pairs_unmerged_validation_rejected"),
        _count(status == MISMATCH).alias("mate_id_mismatches"),
        F.coalesce(F.sum(both), F.lit(0)).cast("long").alias("bases_in"),
        F.coalesce(F.sum(F.when(status == MERGED, F.length("seq"))), F.lit(0)).cast("long").alias("bases_merged"),
    )
    unmerged = F.col("pairs_unmerged_no_overlap") + F.col("pairs_unmerged_validation_rejected")
    out = counted.withColumn("pairs_unmerged", unmerged)
    return out.select(
        "pairs_seen",
        (F.col("pairs_merged") + F.col("pairs_unmerged")).alias("pairs_processed"),
        "pairs_merged",
        "pairs_unmerged",
        "pairs_unmerged_no_overlap",
        "pairs_unmerged_validation_rejected",
        (F.col("pairs_unmerged") if unmerged_written else F.lit(0).cast("long")).alias("unmerged_pairs_written"),
        (F.lit(0).cast("long") if unmerged_written else F.col("pairs_unmerged")).alias("unmerged_pairs_not_written"),
        "mate_id_mismatches",
        "bases_in",
        "bases_merged",
        F.lit(correction).alias("quality_correction_enabled"),
    )


def with_fractions(stats: DataFrame) -> DataFrame:
    """Add the two fractions of processed pairs."""
    return stats.withColumn("merge_fraction", safe_fraction(F.col("pairs_merged"), F.col("pairs_processed"))).withColumn(
        "unmerged_fraction", safe_fraction(F.col("pairs_unmerged"), F.col("pairs_processed"))
    )


def top_unmerged_reason(stats: DataFrame) -> DataFrame:
    """(top_reason, pairs): the commoner reason, no overlap if tied, null if there are none."""
    none, bad = F.col("pairs_unmerged_no_overlap"), F.col("pairs_unmerged_validation_rejected")
    reason = F.when((none == 0) & (bad == 0), None).when(none >= bad, F.lit(NO_OVERLAP)).otherwise(F.lit(REJECTED))
    return stats.select(reason.alias("top_reason"), F.greatest(none, bad).alias("pairs"))


@dataclass(frozen=True)
class RunSummary:
    """What a batch run reports when it succeeds."""

    input1: str
    input2: str
    output_file: str | None
    unmerged_out: str | None
    elapsed_seconds: float
    stats: dict

    @property
    def pairs_per_second(self) -> float:
        return self.stats["pairs_seen"] / self.elapsed_seconds if self.elapsed_seconds > 1e-9 else 0.0

    def _share(self, name: str) -> float:
        return self.stats[name] / self.stats["pairs_processed"] if self.stats["pairs_processed"] else 0.0

    def as_dict(self) -> dict:
        names = ("input1", "input2", "output_file", "unmerged_out")
        return {
            "context": {n: getattr(self, n) for n in names},
            "elapsed_seconds": self.elapsed_seconds,
            "pairs_per_second": self.pairs_per_second,
            "merge_fraction": self._share("pairs_merged"),
            "unmerged_fraction": self._share("pairs_unmerged"),
            "stats": self.stats,
        }

    def json(self) -> str:
        return json.dumps(self.as_dict(), indent=2)

    def text(self) -> str:
        s = self.stats
        lines = [("input 1", self.input1), ("input 2", self.input2)]
        lines += [(n, v) for n, v in (("merged output", self.output_file), ("unmerged output", self.unmerged_out)) if v]
        lines += [
            ("elapsed", f"{self.elapsed_seconds:.2f}s"),
            ("throughput", f"{self.pairs_per_second:.1f} pairs/s"),
            ("pairs seen", s["pairs_seen"]),
            ("pairs processed", s["pairs_processed"]),
            ("pairs merged", f"{s['pairs_merged']} ({self._share('pairs_merged') * 100:.2f}%)"),
            ("pairs unmerged", f"{s['pairs_unmerged']} ({self._share('pairs_unmerged') * 100:.2f}%)"),
            ("  no overlap", s["pairs_unmerged_no_overlap"]),
            ("  validation reject", s["pairs_unmerged_validation_rejected"]),
            ("unmerged written", s["unmerged_pairs_written"]),
            ("mate ID mismatches", s["mate_id_mismatches"]),
            ("bases in", s["bases_in"]),
            ("bases merged", s["bases_merged"]),
            ("quality correction", "enabled" if s["quality_correction_enabled"] else "disabled"),
        ]
        return "\nrun summary\n" + "".join(f"  {n + ':':<21}{v}\n" for n, v in lines)
