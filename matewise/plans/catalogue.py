"""Registered queries of the read-pair engine and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.params import (
    BaseTie,
    CorrectionParams,
    EngineConfig,
    MergeParams,
    OverlapParams,
    OverlapTie,
    ValidationPolicy,
)
from ..operators import relational as R
from ..operators.assembly import Assembler, PairFlow, Read, assemble, compare, pairs_from, run_steps
from . import evidence_queries, file_queries
from . import oracles as O
from . import stats as S
from . import warehouse as W
from .datagen import pairs as generated

Query = Callable[[SparkSession, str], DataFrame]
POLICIES = {"loose": ValidationPolicy.loose(), "normal": ValidationPolicy.normal(), "strict": ValidationPolicy.strict()}
#: Differently configured runs, as the tools that reports compare.
TOOLS = {
    "loose": EngineConfig(validation=POLICIES["loose"]),
    "normal": EngineConfig(),
    "strict": EngineConfig(validation=POLICIES["strict"]),
    "unchecked": EngineConfig(validation=None),
}
#: K-mers that are longer than some of the broken reads.
LONG_MERS = ValidationPolicy(30, 13)
OVERLAP_COLUMNS = ("overlap_len", "r1_start", "r2_start", "diff")
OUTCOME = ("key", "status", "reason", "seq", "qual")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_from(generated(spark, sf_dir), "key", r1_name="name1", r2_name="name2")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark, sf_dir)


def mate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = C.mate_key(F.col("name1")), C.mate_key(F.col("name2"))
    return _names(spark, sf_dir).select("key", one.alias("key1"), two.alias("key2"), C.same_mates(F.col("name1"), F.col("name2")).alias("same"))


def read_id_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.concat(F.lit("@"), F.col("name2"))
    return _names(spark, sf_dir).select("key", C.read_id(header).alias("read_id"))


def orient_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.oriented(pairs(spark, sf_dir)).select("key", "a", "qa", "b", "qb")


def phred_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = C.phred(F.col("r1_qual"))
    total = F.aggregate(q, F.lit(0), lambda acc, x: acc + x)
    return _names(spark, sf_dir).select(
        "key",
        F.size(q).alias("n"),
        total.alias("q_sum"),
        F.array_min(q).alias("q_min"),
        F.array_max(q).alias("q_max"),
        C.quality_text(q).alias("again"),
    )


def iupac_revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("key", C.iupac_reverse_complement(F.col("r1_seq")).alias("rc"))


def allowed_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _names(spark, sf_dir).select((F.col("key") % 200 + 1).cast("int").alias("n")).distinct()
    return n.select("n", C.allowed_differences(F.col("n"), 0.2, 5).alias("a20"), C.allowed_differences(F.col("n"), 0.35, 99).alias("a35"))


def _direction(end: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = pairs(spark, sf_dir).withColumn("mates_match", F.lit(True))
        rows = run_steps(rows, EngineConfig(), ("overlap_end" if end else "overlap_start",)).where("overlap_len IS NOT NULL")
        return rows.select("key", F.col("r2_start" if end else "r1_start").alias("start"), "overlap_len", "diff")

    return query


def _search(tie: OverlapTie) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        flow = PairFlow(pairs(spark, sf_dir)).find_overlap(OverlapParams(tie=tie))
        return flow.found().select("key", *OVERLAP_COLUMNS)

    return query


def packed_overlap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search by bit-parallel comparison of packed reads, without Python."""
    found = R.packed_overlap_search(pairs(spark, sf_dir).where("mates_match"))
    return found.where("overlap_len IS NOT NULL").select("key", *OVERLAP_COLUMNS)


def _complexity(tail: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = pairs(spark, sf_dir).withColumn("mates_match", F.lit(True))
        return run_steps(rows, EngineConfig(), ("need_tail" if tail else "need_head",)).select("key", F.col("min_informative").alias("need"))

    return query


def min_informative_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).withColumn("mates_match", F.lit(True))
    return run_steps(rows, EngineConfig(), ("informative",)).select("key", "min_informative")


def validation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = PairFlow(pairs(spark, sf_dir).where("mates_match")).find_overlap().validate().metrics()
    rounded = {c: F.round(c, 6) for c in ("expected_errors", "observed_rate", "expected_rate")}
    return rows.withColumns(rounded)


def _validate(policy: ValidationPolicy) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = PairFlow(pairs(spark, sf_dir)).find_overlap().validate(policy).result()
        return rows.select("key", F.when(F.col("status") == "pair", "ok").otherwise(F.col("status")).alias("status"), "reason")

    return query


def _merge(tie: BaseTie) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return PairFlow(pairs(spark, sf_dir)).find_overlap().merge(MergeParams(tie)).reads()

    return query


def _correct(correction: CorrectionParams, first: bool = False) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        flow = PairFlow(pairs(spark, sf_dir)).find_overlap()
        flow = flow.correct(correction).merge() if first else flow.merge().correct(correction)
        return flow.reads()

    return query


def correct_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PairFlow(pairs(spark, sf_dir)).find_overlap().correct().corrected_pairs()


def _assemble(config: EngineConfig) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return assemble(pairs(spark, sf_dir), config).select(*OUTCOME)

    return query


def unmerged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both original records of every unmerged pair."""
    rows = assemble(pairs(spark, sf_dir)).where(F.col("status").isin("no_overlap", "validation_rejected"))
    mates = F.array(
        F.struct(F.lit(1).alias("mate"), F.col("r1_seq").alias("seq"), F.col("r1_qual").alias("qual")),
        F.struct(F.lit(2).alias("mate"), F.col("r2_seq").alias("seq"), F.col("r2_qual").alias("qual")),
    )
    return rows.select("key", "status", F.inline(mates))


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_fractions(S.run_stats(assemble(pairs(spark, sf_dir)), True, True))


def top_unmerged_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_unmerged_reason(S.run_stats(assemble(pairs(spark, sf_dir))))


def mate_mismatch_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir)
    return rows.where("NOT mates_match").select("key").withColumn("status", F.lit("mate_mismatch"))


def mate_mismatch_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mate_budget(pairs(spark, sf_dir), "key", 2)


def _labelled(tool: str) -> list[Column]:
    return [F.lit("run1").alias("run_key"), F.lit("orders").alias("dataset_name"), F.lit(tool).alias("tool")]


def _merged_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the reads that each tool merges, all tools in one pass: a pair that passes is merged."""
    passed = compare(pairs(spark, sf_dir), TOOLS).where("status = 'merged'")
    name = F.concat(F.lit("read"), F.col("key").cast("string")).alias("read_id")
    return passed.select(*_labelled("")[:2], F.col("config").alias("tool"), name)


def merged_read_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.concat(F.lit("@read"), F.col("key").cast("string"), F.lit("/1")).alias("header")
    reads = assemble(pairs(spark, sf_dir)).where("status = 'merged'").select(*_labelled("normal"), header, "seq", "qual", "avg_qual", "min_qual", "max_qual")
    return W.read_records(reads).withColumn("avg_qual", F.round("avg_qual", 6))


def _executions(spark: SparkSession) -> DataFrame:
    """Executions of the tools, and of one that merged nothing."""
    names = [*TOOLS, "none"]
    return spark.createDataFrame([("run1", "orders", t) for t in names], "run_key string, dataset_name string, tool string")


def agreement_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.agreement(_merged_ids(spark, sf_dir), _executions(spark))


def tool_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.tool_counts(_merged_ids(spark, sf_dir))


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A warehouse's dimension tables from customers (runs), nations (subsets) and suppliers (executions)."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    text = lambda c, p: F.concat(F.lit(p), F.col(c).cast("string"))
    runs = nation.select(
        text("n_nationkey", "run").alias("run_key"),
        text("n_regionkey", "2024010").alias("created_at"),
        F.when(F.col("n_nationkey") % 3 == 0, "running").otherwise("completed").alias("status"),
        F.when(F.col("n_nationkey") % 2 == 0, "default").otherwise("tuned").alias("benchmark_mode"),
        F.lit(3).cast("long").alias("replicates"),
        F.lit(8).cast("long").alias("threads"),
    )
    subsets = nation.select(
        text("n_nationkey", "run").alias("run_key"), text("n_regionkey", "set").alias("dataset_name"), F.col("n_name").alias("accession"),
        F.col("n_nationkey").cast("long").alias("read_pairs"), F.lit("a").alias("r1_path"), F.lit("b").alias("r2_path"),
        F.lit(10).cast("long").alias("r1_bytes"), F.lit(20).cast("long").alias("r2_bytes"),
    )
    executions = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(
        text("n_nationkey", "run").alias("run_key"), text("n_regionkey", "set").alias("dataset_name"), text("s_suppkey", "tool").alias("tool"),
        *[F.round(F.col("s_acctbal") / k, 4).alias(f"hyperfine_{x}_s") for k, x in enumerate(("mean", "median", "min", "max", "user", "system"), 1)],
        F.when(F.col("s_suppkey") % 2 == 0, F.lit(0.5)).alias("hyperfine_stddev_s"), F.col("s_suppkey").cast("long").alias("merged_reads"),
        F.col("s_suppkey").cast("long").alias("merged_read_records"), text("s_suppkey", "out/").alias("output_dir"),
    )
    return runs, subsets, executions


def tool_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.tool_results(*_runs(spark, sf_dir), "run4")


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.latest_run(_runs(spark, sf_dir)[0], "default")


def overlap_tie_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes where equally good overlaps of both directions are an error."""
    rows = PairFlow(pairs(spark, sf_dir)).find_overlap(OverlapParams(tie=OverlapTie.REJECT)).result()
    return rows.select("key", "status", "reason", *OVERLAP_COLUMNS)


def merge_prefer_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes where equally sure mates that differ are an error, and what the error is about."""
    rows = R.with_details(PairFlow(pairs(spark, sf_dir)).find_overlap().merge(MergeParams(BaseTie.REJECT)).result())
    return rows.select("key", "status", "reason", "detail.offset", "detail.left_base", "detail.right_base", "detail.quality")


def overlap_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that overlap and pairs that don't, as an inspecting flow sees them."""
    seen: list[DataFrame] = []
    flow = PairFlow(pairs(spark, sf_dir).where("mates_match")).find_overlap()
    flow.inspect(lambda d: seen.append(d.select("key", F.lit("found").alias("outcome")))).inspect(
        lambda d: seen.append(d.select("key", F.lit("no_overlap").alias("outcome"))), found=False
    )
    return seen[0].unionByName(seen[1])


def validate_custom_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of the caller's in the loose policy: floor and allowance stay the policy's."""
    return _validate(POLICIES["loose"].with_score(40))(spark, sf_dir)


def valid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each pair that overlaps is valid, merged first and validated then."""
    flow = PairFlow(pairs(spark, sf_dir).where("mates_match")).find_overlap().merge().validate()
    return flow.found().select("key", flow.valid().alias("is_valid"))


def broken_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of pairs with missing, cut and foreign parts; with k-mers longer than some reads."""
    rows = generated(spark, sf_dir)
    fault = F.col("key") % 8
    rows = rows.select(
        "key",
        F.when(fault == 1, None).when(fault == 2, F.concat(F.lit("\u65e5"), F.substring("r1_seq", 2, 99))).when(fault == 5, F.substring("r1_seq", 1, 12)).otherwise(F.col("r1_seq")).alias("r1_seq"),
        F.when(fault == 3, F.substring("r1_qual", 2, 99)).when(fault == 5, F.substring("r1_qual", 1, 12)).otherwise(F.col("r1_qual")).alias("r1_qual"),
        F.when(fault == 4, "").otherwise(F.col("r2_seq")).alias("r2_seq"),
        F.when(fault == 4, "").otherwise(F.col("r2_qual")).alias("r2_qual"),
        "name1",
        F.when(fault == 6, F.lit("other")).otherwise(F.col("name2")).alias("name2"),
    )
    return assemble(pairs_from(rows, "key", r1_name="name1", r2_name="name2"), EngineConfig(validation=LONG_MERS)).select("key", "status", "reason")


def records_in_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain over records one by one, as they come out of an iterator: merged, none, or the error's class."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Assembler()
        for batch in batches:
            key, n1, s1, q1, n2, s2, q2 = (c.to_pylist() for c in batch.columns)
            mates = ((Read(a, b, c), Read(d, e, f)) for a, b, c, d, e, f in zip(n1, s1, q1, n2, s2, q2))
            out = [(x.seq, None) if isinstance(x, Read) else (None, x and type(x).__name__) for x in chain.process_iter(mates)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in zip(*out))], ["key", "seq", "error"])

    rows = generated(spark, sf_dir)
    named = rows.select("key", C.mate_key(F.col("name1")).alias("n1"), "r1_seq", "r1_qual", C.mate_key(F.col("name2")).alias("n2"), "r2_seq", "r2_qual")
    return named.mapInArrow(go, "key long, seq string, error string")


def queries() -> dict[str, Query]:
    return {
        "mate_keys": mate_keys,
        "read_id_normalize": read_id_normalize,
        "orient_pairs": orient_pairs,
        "phred_decode": phred_decode,
        "iupac_revcomp": iupac_revcomp,
        "allowed_differences": allowed_differences,
        "overlap_from_start": _direction(False),
        "overlap_from_end": _direction(True),
        "overlap_search": _search(OverlapTie.FROM_START),
        "packed_overlap_search": packed_overlap_search,
        "overlap_tie_from_end": _search(OverlapTie.FROM_END),
        "complexity_head": _complexity(False),
        "complexity_tail": _complexity(True),
        "min_informative_overlap": min_informative_overlap,
        "validation_metrics": validation_metrics,
        **{f"validate_{n}": _validate(p) for n, p in POLICIES.items()},
        **{f"merge_prefer_{t.value}": _merge(t) for t in BaseTie if t is not BaseTie.REJECT},
        "correct_merged": _correct(CorrectionParams()),
        "correct_quality_only": _correct(CorrectionParams(quality_only=True)),
        "correct_delta10": _correct(CorrectionParams(min_delta=10)),
        "correct_then_merge": _correct(CorrectionParams(min_delta=10), True),
        "correct_pair": correct_pair,
        "assemble_default": _assemble(EngineConfig()),
        "assemble_no_validate": _assemble(EngineConfig(validation=None)),
        "assemble_no_correct": _assemble(EngineConfig(correction=None)),
        "unmerged_records": unmerged_records,
        "run_stats": run_stats,
        "top_unmerged_reason": top_unmerged_reason,
        "mate_mismatch_skip": mate_mismatch_skip,
        "mate_mismatch_budget": mate_mismatch_budget,
        "merged_read_records": merged_read_records,
        "agreement_report": agreement_report,
        "tool_counts": tool_counts,
        "tool_results": tool_results,
        "latest_run": latest_run,
        "overlap_tie_reject": overlap_tie_reject,
        "merge_prefer_reject": merge_prefer_reject,
        "overlap_outcomes": overlap_outcomes,
        "validate_custom_score": validate_custom_score,
        "valid_pairs": valid_pairs,
        "broken_pairs": broken_pairs,
        "records_in_hand": records_in_hand,
        **file_queries.queries(),
        **evidence_queries.queries(),
    }


def oracle_sql() -> dict[str, str]:
    f, c = O.final, CorrectionParams()
    ints = "CAST({} AS INTEGER) AS {}".format
    overlap = "SELECT key, " + ", ".join(ints(x, y) for x, y in (("n", "overlap_len"), ("s1", "r1_start"), ("s2", "r2_start"), ("d", "diff")))
    found = f"{overlap} FROM ov WHERE n IS NOT NULL AND same"
    start = "SELECT key, CAST(ofs AS INTEGER) AS start, CAST(n AS INTEGER) AS overlap_len, CAST(d AS INTEGER) AS diff FROM "
    normal, any_pair = O.validated(), O.unchecked()
    reads, whole = "SELECT key, seq, qual FROM res WHERE status = 'merged'", "SELECT key, status, reason, seq, qual FROM res"
    q = "list_transform(string_split(r1_qual, ''), lambda x: greatest(ascii(x) - 33, 0))"
    out = {
        "mate_keys": f(O.base(), f"SELECT key, {O.KEY.format('name1')} AS key1, {O.KEY.format('name2')} AS key2, {O.KEY.format('name1')} = {O.KEY.format('name2')} AS same FROM pairs"),
        "read_id_normalize": f(O.base(), r"SELECT key, regexp_replace(regexp_extract('@' || name2, '^@?\s*(\S*)', 1), '/[12]$', '') AS read_id FROM pairs"),
        "orient_pairs": f(O.base(), "SELECT key, a, qa, b, qb FROM ori"),
        "phred_decode": f(
            O.base(),
            f"SELECT key, CAST(len({q}) AS INTEGER) AS n, CAST(list_sum({q}) AS INTEGER) AS q_sum, CAST(list_min({q}) AS INTEGER) AS q_min, "
            f"CAST(list_max({q}) AS INTEGER) AS q_max, r1_qual AS again FROM pairs",
        ),
        "iupac_revcomp": f(O.base(), "SELECT key, reverse(translate(r1_seq, 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN')) AS rc FROM pairs"),
        "allowed_differences": f(
            O.base(),
            "SELECT DISTINCT n, CAST(least(5, floor(n * CAST(CAST(0.2 AS FLOAT) AS DOUBLE))) AS INTEGER) AS a20, "
            "CAST(least(99, floor(n * CAST(CAST(0.35 AS FLOAT) AS DOUBLE))) AS INTEGER) AS a35 FROM (SELECT CAST(key % 200 + 1 AS INTEGER) AS n FROM pairs)",
        ),
        "overlap_from_start": f(f"{O.base()}, {O.direction('fs', 'a', 'b', OverlapParams())}", start + "fs"),
        "overlap_from_end": f(f"{O.base()}, {O.direction('fe', 'b', 'a', OverlapParams())}", start + "fe"),
        "overlap_search": f(O.search(), found),
        "packed_overlap_search": f(O.search(), found),
        "overlap_tie_from_end": f(O.search(OverlapParams(tie=OverlapTie.FROM_END)), found),
        "complexity_head": f(f"{O.base()}, {O.need('h', 'upper(a)', POLICIES['normal'])}", "SELECT key, CAST(need AS INTEGER) AS need FROM h"),
        "complexity_tail": f(f"{O.base()}, {O.need('h', 'reverse(upper(a))', POLICIES['normal'])}", "SELECT key, CAST(need AS INTEGER) AS need FROM h"),
        "min_informative_overlap": f(f"{O.base()}, {O.informative(POLICIES['normal'])}", "SELECT key, CAST(informative AS INTEGER) AS min_informative FROM inf"),
        "validation_metrics": f(
            f"{normal}, {O.float_errors()}",
            "SELECT key, CAST(n AS INTEGER) AS overlap_len, CAST(informative AS INTEGER) AS min_informative, CAST(mm AS INTEGER) AS mismatches, "
            "round(CAST(err AS DOUBLE), 6) AS expected_errors, round(CAST(mm AS DOUBLE) / n, 6) AS observed_rate, round(CAST(err AS DOUBLE) / n, 6) AS expected_rate "
            "FROM val JOIN errs USING (key) WHERE n IS NOT NULL AND same",
        ),
        **{f"validate_{n}": f(O.validated(p), "SELECT key, status, reason FROM val") for n, p in POLICIES.items()},
        **{f"merge_prefer_{t.value}": f(O.merged(any_pair, MergeParams(t)), reads) for t in BaseTie if t is not BaseTie.REJECT},
        "correct_merged": f(O.merged(any_pair, correction=c), reads),
        "correct_quality_only": f(O.merged(any_pair, correction=CorrectionParams(quality_only=True)), reads),
        "correct_delta10": f(O.merged(any_pair, correction=CorrectionParams(min_delta=10)), reads),
        "correct_then_merge": f(O.merged(any_pair, correction=CorrectionParams(min_delta=10), correct_first=True), reads),
        "correct_pair": f(O.corrected_pairs(), "SELECT key, r1_out, q1_out, r2_out, q2_out FROM fixed"),
        "assemble_default": f(O.merged(normal, correction=c), whole),
        "assemble_no_validate": f(O.merged(any_pair, correction=c), whole),
        "assemble_no_correct": f(O.merged(normal), whole),
        "unmerged_records": f(
            normal,
            "SELECT key, status, mate, CASE mate WHEN 1 THEN r1_seq ELSE r2_seq END AS seq, CASE mate WHEN 1 THEN r1_qual ELSE r2_qual END AS qual "
            "FROM val JOIN pairs USING (key), (SELECT CAST(unnest([1, 2]) AS INTEGER) AS mate) WHERE status IN ('no_overlap', 'validation_rejected')",
        ),
        "mate_mismatch_skip": f(O.base(), "SELECT key, 'mate_mismatch' AS status FROM ori WHERE NOT same"),
        "mate_mismatch_budget": f(
            O.base(),
            "SELECT key AS ordinal, key + 1 AS pairs_seen FROM (SELECT key, row_number() OVER (ORDER BY key) AS r FROM ori WHERE NOT same) WHERE r = 3",
        ),
    }
    counts = """tot AS (SELECT count(*) AS seen, count(*) FILTER (status = 'merged') AS m, count(*) FILTER (status = 'no_overlap') AS no,
        count(*) FILTER (status = 'validation_rejected') AS rej, count(*) FILTER (status = 'mate_mismatch') AS mis,
        CAST(coalesce(sum(length(r1_seq) + length(r2_seq)), 0) AS BIGINT) AS bi, CAST(coalesce(sum(length(seq)), 0) AS BIGINT) AS bm FROM res JOIN pairs USING (key))"""
    stats = f"{O.merged(normal, correction=c)}, {counts}"
    out["run_stats"] = f(
        stats,
        "SELECT seen AS pairs_seen, m + no + rej AS pairs_processed, m AS pairs_merged, no + rej AS pairs_unmerged, no AS pairs_unmerged_no_overlap, "
        "rej AS pairs_unmerged_validation_rejected, no + rej AS unmerged_pairs_written, CAST(0 AS BIGINT) AS unmerged_pairs_not_written, mis AS mate_id_mismatches, "
        "bi AS bases_in, bm AS bases_merged, TRUE AS quality_correction_enabled, CAST(m AS DOUBLE) / (m + no + rej) AS merge_fraction, "
        "CAST(no + rej AS DOUBLE) / (m + no + rej) AS unmerged_fraction FROM tot",
    )
    out["top_unmerged_reason"] = f(
        stats,
        "SELECT CASE WHEN no = 0 AND rej = 0 THEN NULL WHEN no >= rej THEN 'no_overlap' ELSE 'validation_rejected' END AS top_reason, greatest(no, rej) AS pairs FROM tot",
    )
    tagged = "'sha256:' || sha256({})".format
    values = "list_transform(string_split(qual, ''), lambda x: ascii(x) - 33)"
    out["merged_read_records"] = f(
        O.merged(normal, correction=c),
        "SELECT 'run1' AS run_key, 'orders' AS dataset_name, 'normal' AS tool, 'read' || key AS read_id, 'read' || key || '/1' AS output_header, "
        f"CAST(length(seq) AS BIGINT) AS merged_len, round(list_avg({values}), 6) AS avg_qual, CAST(list_min({values}) AS BIGINT) AS min_qual, "
        f"CAST(list_max({values}) AS BIGINT) AS max_qual, {tagged('seq')} AS sequence_hash, {tagged('qual')} AS quality_hash FROM res WHERE status = 'merged'",
    )

    out["overlap_tie_reject"] = f(
        O.search(),
        "SELECT key, CASE WHEN NOT same THEN 'mate_mismatch' WHEN tied THEN 'error' WHEN hit THEN 'pair' ELSE 'no_overlap' END AS status, "
        "CASE WHEN same AND tied THEN 'overlap_tie' END AS reason, "
        + ", ".join(f"CAST(CASE WHEN same AND NOT tied THEN {x} END AS INTEGER) AS {y}" for x, y in (("n", "overlap_len"), ("s1", "r1_start"), ("s2", "r2_start"), ("d", "diff")))
        + " FROM (SELECT ov.*, hit, coalesce(fs.n - 5 * fs.d = fe.n - 5 * fe.d, FALSE) AS tied FROM ov JOIN found USING (key) LEFT JOIN fs USING (key) LEFT JOIN fe USING (key))",
    )
    out["merge_prefer_reject"] = f(
        f"{any_pair}, win AS (SELECT key, arg_min(j, j) AS j, arg_min(x, j) AS x, arg_min(y, j) AS y, arg_min(qx, j) AS q FROM ("
        "SELECT key, j, substr(a, s1 + j, 1) AS x, substr(b, s2 + j, 1) AS y, greatest(ascii(substr(qa, s1 + j, 1)) - 33, 0) AS qx, greatest(ascii(substr(qb, s2 + j, 1)) - 33, 0) AS qy "
        "FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM val WHERE status = 'ok')) WHERE x <> y AND qx = qy GROUP BY key)",
        "SELECT key, CASE WHEN status <> 'ok' THEN status WHEN j IS NOT NULL THEN 'error' ELSE 'merged' END AS status, CASE WHEN j IS NOT NULL THEN 'base_disagreement' END AS reason, "
        'CAST(j - 1 AS INTEGER) AS "offset", x AS left_base, y AS right_base, CAST(q AS INTEGER) AS quality FROM val LEFT JOIN win USING (key)',
    )
    out["overlap_outcomes"] = f(O.search(), "SELECT key, CASE WHEN n IS NULL THEN 'no_overlap' ELSE 'found' END AS outcome FROM ov WHERE same")
    out["validate_custom_score"] = f(O.validated(ValidationPolicy(40, 3, 5, 10.0, 1.5)), "SELECT key, status, reason FROM val")
    out["valid_pairs"] = f(normal, "SELECT key, status = 'ok' AS is_valid FROM val WHERE same AND n IS NOT NULL")
    # reads of class 5 are cut and those of class 4 empty, so the search sees them; what fails before it is told by class
    whole_pairs = O.base().partition("pairs AS (")[2].rpartition("),\n    ori AS")[0]
    cut = (
        f"raw AS ({whole_pairs}), pairs AS (SELECT key, ins, name1, CASE WHEN key % 8 = 5 THEN substr(r1_seq, 1, 12) ELSE r1_seq END AS r1_seq, "
        "CASE WHEN key % 8 = 5 THEN substr(r1_qual, 1, 12) ELSE r1_qual END AS r1_qual, CASE WHEN key % 8 = 6 THEN 'other' ELSE name2 END AS name2, "
        "CASE WHEN key % 8 = 4 THEN '' ELSE r2_seq END AS r2_seq, CASE WHEN key % 8 = 4 THEN '' ELSE r2_qual END AS r2_qual FROM raw),\n    ori AS"
    )
    fault = "CASE key % 8 WHEN 1 THEN 'null_read' WHEN 2 THEN 'not_bytes' WHEN 3 THEN 'sequence_quality_length' WHEN 5 THEN CASE WHEN n IS NOT NULL THEN 'k_exceeds_read' END END"
    out["broken_pairs"] = f(
        O.validated(LONG_MERS).replace(f"pairs AS ({whole_pairs}),\n    ori AS", cut),
        "SELECT key, CASE WHEN status = 'mate_mismatch' THEN status WHEN fault IS NOT NULL THEN 'error' WHEN status = 'ok' THEN 'merged' ELSE status END AS status, "
        f"CASE WHEN status <> 'mate_mismatch' THEN coalesce(fault, reason) END AS reason FROM (SELECT *, {fault} AS fault FROM val)",
    )
    out["records_in_hand"] = f(
        O.merged(normal, correction=c),
        "SELECT key, seq, CASE status WHEN 'mate_mismatch' THEN 'PairingError' WHEN 'validation_rejected' THEN 'ValidationError' END AS error FROM res",
    )
    out |= file_queries.oracle_sql(stats)
    out |= evidence_queries.oracle_sql(lambda config: O.merged(O.validated(config.validation) if config.validation else any_pair, correction=c))

    def nested(name: str, config: EngineConfig) -> str:
        source = O.validated(config.validation) if config.validation else any_pair
        return f"(WITH {source} SELECT '{name}' AS tool, key FROM val WHERE status = 'ok')"

    rec = "rec AS (" + " UNION ALL ".join(f"SELECT * FROM {nested(t, cfg)}" for t, cfg in TOOLS.items()) + ")"
    out["tool_counts"] = f(rec, "SELECT 'run1' AS run_key, 'orders' AS dataset_name, tool, count(*) AS merged FROM rec GROUP BY tool")
    tools = ", ".join(f"('{t}')" for t in [*TOOLS, "none"])
    out["agreement_report"] = f(
        f"{rec}, tools(tool) AS (VALUES {tools}), n AS (SELECT tool, count(*) AS c FROM rec GROUP BY tool), "
        "sh AS (SELECT l.tool AS lt, r.tool AS rt, count(*) AS c FROM rec l JOIN rec r USING (key) WHERE r.tool > l.tool GROUP BY ALL), "
        "j AS (SELECT a.tool AS lt, b.tool AS rt, coalesce(x.c, 0) AS l, coalesce(y.c, 0) AS r, coalesce(sh.c, 0) AS s FROM tools a JOIN tools b ON b.tool > a.tool "
        "LEFT JOIN n x ON x.tool = a.tool LEFT JOIN n y ON y.tool = b.tool LEFT JOIN sh ON sh.lt = a.tool AND sh.rt = b.tool)",
        "SELECT 'run1' AS run_key, 'orders' AS dataset_name, lt AS left_tool, rt AS right_tool, l AS left_merged, r AS right_merged, s AS shared_merged, "
        "l - s AS left_only, r - s AS right_only, round(CASE WHEN l + r - s = 0 THEN 0.0 ELSE CAST(s AS DOUBLE) / (l + r - s) END, 6) AS jaccard FROM j",
    )
    runs = """runs AS (SELECT 'run' || n_nationkey AS run_key, '2024010' || n_regionkey AS created_at, CASE WHEN n_nationkey % 3 = 0 THEN 'running' ELSE 'completed' END AS status,
        CASE WHEN n_nationkey % 2 = 0 THEN 'default' ELSE 'tuned' END AS benchmark_mode, CAST(3 AS BIGINT) AS replicates, CAST(8 AS BIGINT) AS threads FROM nation)"""
    out["latest_run"] = f(runs, "SELECT * FROM runs WHERE status = 'completed' AND benchmark_mode = 'default' ORDER BY created_at DESC, run_key DESC LIMIT 1")
    timing = ", ".join(f"round(s_acctbal / {k}, 4) AS {x}_s" for k, x in enumerate(("mean", "median", "min", "max", "user", "system"), 1))
    out["tool_results"] = f(
        runs,
        "SELECT run_key, benchmark_mode, 'set' || n_regionkey AS dataset_name, n_name AS accession, CAST(n_nationkey AS BIGINT) AS read_pairs, 'tool' || s_suppkey AS tool, "
        f"replicates, threads, {timing}, CASE WHEN s_suppkey % 2 = 0 THEN CAST(0.5 AS DOUBLE) END AS stddev_s, CAST(s_suppkey AS BIGINT) AS merged_reads, "
        "CAST(s_suppkey AS BIGINT) AS merged_read_records, CAST(10 AS BIGINT) AS r1_bytes, CAST(20 AS BIGINT) AS r2_bytes, 'out/' || s_suppkey AS output_dir "
        "FROM runs JOIN nation ON 'run' || n_nationkey = run_key JOIN supplier ON s_nationkey = n_nationkey WHERE run_key = 'run4' AND status = 'completed'",
    )
    return out
