"""Queries on a warehouse that they make: changes, constraints, artifacts, accounting and reports as files."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.errors import EvidenceError
from ..functions.params import EngineConfig
from ..operators.assembly import assemble, pairs_from, run_steps
from ..operators.kernel import PAIR
from . import oracles as O
from . import warehouse as W
from .datagen import pairs as generated
from .shared import drop, folder, once, write_text

Query = Callable[[SparkSession, str], DataFrame]
NAMES = ("mean", "median", "min", "max", "user", "system")


def _run(key: str, created: str = "20240101T000000Z", **more: object) -> dict:
    return dict(
        run_key=key, created_at=created, status="running", benchmark_mode="default", read_pairs=100, replicates=3, threads=8, run_dir=f"runs/{key}",
        config_path="datasets.tsv", data_root="data", vcs_kind="git", vcs_working_copy_dirty=False,
    ) | more


def _subset(key: str, name: str) -> dict:
    return dict(run_key=key, dataset_name=name, accession=f"X-{name}", read_pairs=100, r1_path="a", r2_path="b", r1_bytes=10, r2_bytes=20)


def _execution(tool: str, n: int, order: int = 1, name: str = "orders", at: str = "out", key: str = "run1") -> dict:
    times = {f"hyperfine_{x}_s": order + i / 8 for i, x in enumerate(NAMES)}
    return times | dict(
        run_key=key, dataset_name=name, tool=tool, command=f"{tool} --all", execution_order=order, hyperfine_stddev_s=0.25 if order % 2 else None,
        merged_reads=n, merged_read_records=n, output_dir=at,
    )


def _made(spark: SparkSession) -> W.Warehouse:
    w = W.Warehouse.create(spark, folder(spark, "evidence"))
    w.insert("benchmark_runs", _run("run1"), _run("run2", "20240102T000000Z"), _run("run3", "20240103T000000Z", benchmark_mode="tuned"))
    w.insert("dataset_subsets", _subset("run1", "orders"), _subset("run2", "orders"))
    return w


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged reads of a run without validation, and which of them a default run merges too (``passed``).

    Pairs are generated once: validation only takes pairs away, so one assembly gives the reads of both runs.
    """
    pairs = pairs_from(generated(spark, sf_dir), "key", r1_name="name1", r2_name="name2")
    checked = run_steps(pairs, EngineConfig(), ("overlap", "validate")).select(*pairs.columns, (F.col("status") == PAIR).alias("passed"))
    merged = assemble(checked, EngineConfig(validation=None)).where("status = 'merged'")
    header = F.concat(F.lit("@read"), F.col("key").cast("string"), F.lit("/1")).alias("header")
    return W.read_records(merged.select(header, "seq", "qual", "avg_qual", "min_qual", "max_qual", "passed"), also=("passed",))


def _filled(spark: SparkSession, sf_dir: str) -> W.Warehouse:
    """Evidence of three tools: one replaced, and one whose replacement fails on its count and on a read that is there twice."""

    def make() -> str:
        w = _made(spark)
        _records(spark, sf_dir).write.parquet(staged := f"{folder(spark, 'records')}/all")
        both = spark.read.parquet(staged)
        merged = {False: both.where("passed").drop("passed"), True: both.drop("passed")}
        number = F.regexp_extract("read_id", r"([0-9]+)$", 1).cast("long")
        for unchecked, tool, part in ((False, "normal", 2), (False, "normal", 1), (True, "unchecked", 3)):
            records = merged[unchecked].where(number % part == 0)
            w.replace_evidence(_execution(tool, records.count(), 1 if tool == "normal" else 2), records)
        some = merged[False].where(number % 5 == 0)
        for records, n in ((some, 0), (some.unionByName(some), 2 * some.count())):
            with contextlib.suppress(EvidenceError):
                w.replace_evidence(_execution("unchecked", n, 9), records)
        drop(spark, staged)
        w.upsert_execution(_execution("zero", 0, 3))
        w.complete_run("run1", "20240201T000000Z")
        return w.root

    return W.Warehouse.open(spark, once(spark, sf_dir, "evidence", make))


def evidence_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).table(W.RECORDS).withColumn("avg_qual", F.round("avg_qual", 6))


def _dimensions(spark: SparkSession, sf_dir: str) -> W.Warehouse:
    """A warehouse of a run for each nation, a subset for each run, and an execution for each supplier."""
    w = W.Warehouse.create(spark, folder(spark, "dimensions"))
    nation, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "supplier"))
    number, whole = F.col("n_nationkey").cast("long"), lambda n: F.lit(n).cast("long")
    run = F.concat(F.lit("run"), F.col("n_nationkey").cast("string")).alias("run_key")
    created = F.concat(F.lit("2024010"), F.col("n_regionkey").cast("string")).alias("created_at")
    mode = F.when(F.col("n_nationkey") % 2 == 0, "default").otherwise("tuned").alias("benchmark_mode")
    same = {"run_dir": "runs", "config_path": "c.tsv", "data_root": "data", "vcs_kind": "git"}
    runs = nation.select(
        run, created, F.lit("running").alias("status"), mode, number.alias("read_pairs"), whole(3).alias("replicates"), whole(8).alias("threads"),
        *(F.lit(v).alias(c) for c, v in same.items()),
    )
    w.append("benchmark_runs", runs)
    paths = [F.lit("a").alias("r1_path"), F.lit("b").alias("r2_path"), whole(10).alias("r1_bytes"), whole(20).alias("r2_bytes")]
    w.append("dataset_subsets", nation.select(run, F.lit("orders").alias("dataset_name"), F.col("n_name").alias("accession"), number.alias("read_pairs"), *paths))
    balance, key = F.col("s_acctbal").cast("double"), F.col("s_suppkey").cast("long")
    executions = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(
        run, F.lit("orders").alias("dataset_name"), F.concat(F.lit("tool"), key.cast("string")).alias("tool"), F.lit("run it").alias("command"),
        key.alias("execution_order"), *((balance / k).alias(f"hyperfine_{x}_s") for k, x in enumerate(NAMES, 1)),
        F.lit(None).cast("double").alias("hyperfine_stddev_s"), key.alias("merged_reads"), key.alias("merged_read_records"), F.lit("out").alias("output_dir"),
    )
    w.upsert_executions(executions)
    return w


def execution_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions added together, and every third of them replaced."""
    w = _dimensions(spark, sf_dir)
    again = w.table("tool_executions").where("execution_order % 3 = 0").withColumns({"merged_reads": F.col("merged_reads") * 2, "output_dir": F.lit("again")})
    w.upsert_executions(again)
    return w.table("tool_executions").select("run_key", "tool", "execution_order", F.round("hyperfine_mean_s", 6).alias("mean_s"), "merged_reads", "merged_read_records", "output_dir")


def run_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, two of which were completed."""
    w = _dimensions(spark, sf_dir)
    for k in (2, 7):
        w.complete_run(f"run{k}", f"2024020{k}")
    return w.table("benchmark_runs").select("run_key", "created_at", "status", "completed_at", "benchmark_mode", "read_pairs")


def run_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dimensions(spark, sf_dir).run("run13").select("run_key", "created_at", "status", "benchmark_mode", "read_pairs", "threads")


def latest_completed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of the newest completed run of each mode, and of none where there is an error."""
    w = _dimensions(spark, sf_dir)
    for k in (2, 4, 6, 10):
        w.complete_run(f"run{k}", "20240203")
    rows = []
    for mode in ("default", "tuned"):
        try:
            rows.append((mode, w.latest(mode)))
        except EvidenceError:
            rows.append((mode, None))
    return spark.createDataFrame(rows, "mode string, run_key string")


def warehouse_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by table after inserts of every kind, in a warehouse that was made twice and opened."""
    w = _dimensions(spark, sf_dir)
    executions = w.table("tool_executions")
    w.append("tool_versions", executions.select("run_key", "tool", F.lit("/bin/tool").alias("path")))
    artifact = [F.lit("command").alias("artifact_kind"), F.lit("c.sh").alias("path"), F.lit(True).alias("required")]
    w.append("artifacts", executions.where("execution_order % 2 = 0").select(*W.PARTITIONS, *artifact))
    W.Warehouse.create(spark, w.root)
    w = W.Warehouse.open(spark, w.root)
    w.validate()
    counts = [w.table(n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n in W.SCHEMAS]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of broken rule, by the keys of nations and suppliers."""
    w = _dimensions(spark, sf_dir)
    runs, number = w.table("benchmark_runs"), F.regexp_extract("run_key", "([0-9]+)$", 1).cast("int")
    other = F.concat(F.lit("other-"), "run_key")
    w.append("benchmark_runs", runs.where(number % 7 == 0))
    for rest, change in ((1, {"status": F.lit("completed")}), (2, {"threads": F.lit(None).cast("long")}), (3, {"status": F.lit("lost")})):
        w.append("benchmark_runs", runs.where(number % 7 == rest).withColumns(change | {"run_key": other}))
    w.append("dataset_subsets", w.table("dataset_subsets").where(number % 7 == 4).withColumn("run_key", other))
    photo = [F.lit("photo").alias("artifact_kind"), F.lit("p").alias("path"), F.lit(True).alias("required")]
    w.append("artifacts", w.table("tool_executions").where("execution_order % 5 = 0").select(*W.PARTITIONS, *photo))
    return w.violations()


def duplicate_read_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of a file that are there twice, ids being taken modulo 1,000."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("read"), (F.col("o_orderkey") % 1000).cast("string")).alias("read_id"))
    return W.duplicate_ids(rows)


def artifact_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts of every tool, some of whose files are there."""
    root, out = folder(spark, "artifacts"), None
    paths = {k: write_text(spark, f"{root}/{k}", k) for k in W.COMMON_ARTIFACTS if k != "stderr_log"} | {"stderr_log": f"{root}/stderr_log"}
    write_text(spark, f"{root}/fastp.json", "{}")
    write_text(spark, f"{root}/vsearch.unmerged2.fastq", "@a\nA\n+\nI\n")
    for tool in W.TOOL_ARTIFACTS:
        rows = W.artifacts_of(spark, _execution(tool, 0, at=root), paths)
        out = rows if out is None else out.unionByName(rows)
    return out.select("tool", "artifact_kind", "required", "bytes")


def tool_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs held against files: (case, problem), the problem being null where all adds up."""
    nations, regions = (spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("nation", "region"))
    record, rest = "@a\nA\n+\nI\n", nations - regions

    def told(pairs: int, joined: int, short: int, more: str = "") -> str:
        return f"Pairs:  {pairs}\t100%\nJoined: {joined}\t20%\nNo Solution: {rest - 2}\t70%\nToo Short: {short}\t10%\n{more}"

    cases = {
        "right": ("bbmerge", told(nations, regions, 2), rest),
        "pairs": ("bbmerge", told(nations + 1, regions, 2), rest),
        "joined": ("bbmerge", told(nations, regions + 1, 1), rest - 1),
        "outcomes": ("bbmerge", told(nations, regions, 3), rest),
        "unmerged": ("bbmerge", told(nations, regions, 2), rest + 1),
        "exception": ("bbmerge", told(nations, regions, 2, "Exception in thread main\n"), rest),
        "missing": ("bbmerge", "Pairs: 1\n", rest),
        "other grammar": ("vsearch", f" {nations}  Pairs\n {regions}  Merged (20%)\n {rest}  Not merged\n", 0),
        "unknown tool": ("else", "", 0),
    }
    out = []
    for case, (tool, log, unmerged) in cases.items():
        root = folder(spark, "accounting")
        write_text(spark, f"{root}/{tool}.stderr.log", log)
        merged = write_text(spark, f"{root}/merged.fastq", record * regions)
        write_text(spark, f"{root}/{tool}.unmerged1.fastq", record * unmerged)
        try:
            W.check_tool(spark, tool, root, nations, merged)
            out.append((case, None))
        except EvidenceError as e:
            out.append((case, str(e).replace(root, "")))
    return spark.createDataFrame(out, "case string, problem string")


def results_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results file of a run, read again."""
    w = _filled(spark, sf_dir)
    W.write_results(w.tool_results("run1"), path := f"{w.root}/results")
    texts = {"run_id", "benchmark_mode", "dataset", "accession", "tool", "output_dir"}
    names = [W.RESULT_COLUMNS.get(c, c) for c in w.tool_results("run1").columns]
    schema = ", ".join(f"{c} {'string' if c in texts else 'double' if c.endswith('_s') else 'bigint'}" for c in names)
    return spark.read.csv(path, sep="\t", header=True, schema=schema, enforceSchema=False)


def timing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a run's timing table."""
    rows = [r.asDict() for r in _filled(spark, sf_dir).tool_results("run1").collect()]
    return spark.createDataFrame(list(enumerate(W.timing_markdown(rows).splitlines())), "line long, text string")


def overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of a run's overlap table."""
    lines = W.overlap_table([r.asDict() for r in _filled(spark, sf_dir).agreement_report("run1").collect()]).splitlines()
    cells = [[x.strip() for x in line.strip("│").split("│")] for line in lines if line.startswith("│")]
    return spark.createDataFrame(cells[1:], cells[0])


def queries() -> dict[str, Query]:
    return {
        "evidence_replace": evidence_replace,
        "execution_upsert": execution_upsert,
        "run_completed": run_completed,
        "run_by_key": run_by_key,
        "latest_completed_run": latest_completed_run,
        "warehouse_tables": warehouse_tables,
        "constraint_violations": constraint_violations,
        "duplicate_read_ids": duplicate_read_ids,
        "artifact_registry": artifact_registry,
        "tool_accounting": tool_accounting,
        "results_tsv": results_tsv,
        "timing_report": timing_report,
        "overlap_report": overlap_report,
    }


def _table(schema: str, rows: list[dict]) -> str:
    """A literal table for SQL."""
    kinds = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}

    def value(x: object, kind: str) -> str:
        return f"CAST({'NULL' if x is None else repr(x)} AS {kinds[kind]})"

    fields = [f.split() for f in schema.split(", ")]
    return " UNION ALL ".join("SELECT " + ", ".join(f"{value(r.get(c), k)} AS {c}" for c, k in fields) for r in rows)


def oracle_sql(result: Callable[[EngineConfig], str]) -> dict[str, str]:
    """SQL by query; ``result`` gives the layers up to ``res`` of a configuration."""
    values = "list_transform(string_split(qual, ''), lambda x: ascii(x) - 33)"

    def reads(config: EngineConfig, tool: str, condition: str) -> str:
        return (
            f"(WITH {result(config)} SELECT 'run1' AS run_key, 'orders' AS dataset_name, '{tool}' AS tool, 'read' || key AS read_id, 'read' || key || '/1' AS output_header, "
            f"CAST(length(seq) AS BIGINT) AS merged_len, round(list_avg({values}), 6) AS avg_qual, CAST(list_min({values}) AS BIGINT) AS min_qual, "
            f"CAST(list_max({values}) AS BIGINT) AS max_qual, 'sha256:' || sha256(seq) AS sequence_hash, 'sha256:' || sha256(qual) AS quality_hash "
            f"FROM res WHERE status = 'merged' AND {condition})"
        )

    records = f"SELECT * FROM {reads(EngineConfig(), 'normal', 'TRUE')} UNION ALL SELECT * FROM {reads(EngineConfig(validation=None), 'unchecked', 'key % 3 = 0')}"
    run = "SELECT 'run' || n_nationkey AS run_key, '2024010' || n_regionkey AS created_at, CASE WHEN n_nationkey % 2 = 0 THEN 'default' ELSE 'tuned' END AS benchmark_mode, CAST(n_nationkey AS BIGINT) AS read_pairs,"
    tools = [("normal", 1), ("unchecked", 2), ("zero", 3)]
    counts = f"rec AS ({records}), n AS (SELECT tool, count(*) AS c FROM rec GROUP BY tool)"

    def merged(tool: str) -> str:
        return f"coalesce((SELECT c FROM n WHERE tool = '{tool}'), 0)"

    def result_row(tool: str, order: int) -> str:
        e = _execution(tool, 0, order)
        times = ", ".join(f"CAST({e[f'hyperfine_{x}_s']} AS DOUBLE) AS {x}_s" for x in NAMES)
        spread = "CAST(0.25 AS DOUBLE)" if order % 2 else "CAST(NULL AS DOUBLE)"
        return (
            f"SELECT 'run1' AS run_id, 'default' AS benchmark_mode, 'orders' AS dataset, 'X-orders' AS accession, CAST(100 AS BIGINT) AS read_pairs, '{tool}' AS tool, "
            f"CAST(3 AS BIGINT) AS replicates, CAST(8 AS BIGINT) AS threads, {times}, {spread} AS stddev_s, {merged(tool)} AS merged_reads, {merged(tool)} AS merged_read_records, "
            "CAST(10 AS BIGINT) AS r1_bytes, CAST(20 AS BIGINT) AS r2_bytes, 'out' AS output_dir"
        )

    lines = ["'| dataset | tool | mean_s | median_s | stddev_s | min_s | max_s | merged_reads |'", "'| --- | --- |" + " ---: |" * 6 + "'"]
    for tool, order in tools:
        t = [order + i / 8 for i in range(4)]
        lines.append(f"'| orders | {tool} | {t[0]} | {t[1]} | {0.25 if order % 2 else ''} | {t[2]} | {t[3]} | ' || {merged(tool)} || ' |'")
    sizes = {k: len(k) for k in W.COMMON_ARTIFACTS if k != "stderr_log"} | {"fastp_json": 2, "vsearch_unmerged2_fastq": 9}
    kinds = [(t, k, True) for t in W.TOOL_ARTIFACTS for k in W.COMMON_ARTIFACTS] + [(t, k, need) for t, some in W.TOOL_ARTIFACTS.items() for k, _, need in some]
    registry = [dict(tool=t, artifact_kind=k, required=need, bytes=sizes.get(k)) for t, k, need in kinds]
    c, j = "(SELECT count(*) FROM nation)", "(SELECT count(*) FROM region)"
    problems = [
        ("right", "NULL"), ("pairs", f"'bbmerge: reported ' || ({c} + 1) || ' pairs, expected ' || {c}"),
        ("joined", f"'bbmerge: reported ' || ({j} + 1) || ' joined reads, but ' || {j} || ' records'"),
        ("outcomes", f"'bbmerge: outcomes sum to ' || ({c} + 1) || ' of ' || {c} || ' pairs'"),
        ("unmerged", f"'bbmerge: an unmerged file has ' || ({c} - {j} + 1) || ' records, expected ' || ({c} - {j})"),
        ("exception", "'bbmerge: the log holds an exception'"), ("missing", "'/bbmerge.stderr.log lacks Joined, No Solution, Too Short'"),
        ("other grammar", "NULL"), ("unknown tool", "NULL"),
    ]
    pairs = [(a, b) for i, (a, _) in enumerate(tools) for b, _ in tools[i + 1 :]]
    shared = "(SELECT count(*) FROM rec l JOIN rec r USING (read_id) WHERE l.tool = '{}' AND r.tool = '{}')".format
    cells = " UNION ALL ".join(
        f"SELECT '{a}' AS lt, '{b}' AS rt, {merged(a)} AS l, {merged(b)} AS r, {shared(a, b)} AS s" for a, b in pairs
    )
    number = "CAST({} AS VARCHAR) AS {}".format
    return {
        "evidence_replace": records,
        "execution_upsert": "SELECT 'run' || s_nationkey AS run_key, 'tool' || s_suppkey AS tool, CAST(s_suppkey AS BIGINT) AS execution_order, round(CAST(s_acctbal AS DOUBLE), 6) AS mean_s, "
        "CAST(s_suppkey * CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS merged_reads, CAST(s_suppkey AS BIGINT) AS merged_read_records, "
        "CASE WHEN s_suppkey % 3 = 0 THEN 'again' ELSE 'out' END AS output_dir FROM supplier",
        "run_completed": f"{run} CASE WHEN n_nationkey IN (2, 7) THEN 'completed' ELSE 'running' END AS status, CASE WHEN n_nationkey IN (2, 7) THEN '2024020' || n_nationkey END AS completed_at FROM nation",
        "run_by_key": f"{run} 'running' AS status, CAST(8 AS BIGINT) AS threads FROM nation WHERE n_nationkey = 13",
        "latest_completed_run": "SELECT mode, (SELECT 'run' || n_nationkey FROM nation WHERE n_nationkey IN (2, 4, 6, 10) AND mode = CASE WHEN n_nationkey % 2 = 0 THEN 'default' ELSE 'tuned' END "
        "ORDER BY n_regionkey DESC, 'run' || n_nationkey DESC LIMIT 1) AS run_key FROM (SELECT unnest(['default', 'tuned']) AS mode)",
        "warehouse_tables": "SELECT 'benchmark_runs' AS name, count(*) AS n FROM nation UNION ALL SELECT 'dataset_subsets', count(*) FROM nation UNION ALL SELECT 'tool_versions', count(*) FROM supplier "
        "UNION ALL SELECT 'tool_executions', count(*) FROM supplier UNION ALL SELECT 'merged_read_records', 0 UNION ALL SELECT 'artifacts', count(*) FROM supplier WHERE s_suppkey % 2 = 0",
        "constraint_violations": "SELECT 'benchmark_runs' AS \"table\", CASE n_nationkey % 7 WHEN 0 THEN 'key' WHEN 2 THEN 'null' ELSE 'check' END AS \"rule\", "
        "CASE n_nationkey % 7 WHEN 0 THEN '' ELSE 'other-' END || 'run' || n_nationkey AS \"key\" FROM nation WHERE n_nationkey % 7 < 4 "
        "UNION ALL SELECT 'dataset_subsets', 'reference', 'other-run' || n_nationkey || '/orders' FROM nation WHERE n_nationkey % 7 = 4 "
        "UNION ALL SELECT 'artifacts', 'check', 'run' || s_nationkey || '/orders/tool' || s_suppkey || '/photo' FROM supplier WHERE s_suppkey % 5 = 0",
        "duplicate_read_ids": "SELECT 'read' || (o_orderkey % 1000) AS read_id, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1",
        "artifact_registry": _table("tool string, artifact_kind string, required boolean, bytes bigint", registry),
        "tool_accounting": " UNION ALL ".join(f"SELECT '{k}' AS \"case\", CAST({v} AS VARCHAR) AS problem" for k, v in problems),
        "results_tsv": f"WITH {counts} " + " UNION ALL ".join(result_row(*t) for t in tools),
        "timing_report": f"WITH {counts} " + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS line, {x} AS text" for i, x in enumerate(lines)),
        "overlap_report": f"WITH {counts}, j AS ({cells}) SELECT 'orders' AS dataset, lt AS left_tool, rt AS right_tool, {number('l', 'left_merged')}, {number('r', 'right_merged')}, "
        f"{number('s', 'shared_merged')}, {number('l - s', 'left_only')}, {number('r - s', 'right_only')}, "
        f"{number('round(CASE WHEN l + r - s = 0 THEN 0.0 ELSE CAST(s AS DOUBLE) / (l + r - s) END, 6)', 'jaccard')} FROM j",
    }
