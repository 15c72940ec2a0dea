"""The evidence warehouse: six tables, their constraints, changes, and reports.

Tables are Parquet folders under one root.  Merged reads, the one large table, are partitioned
by run, dataset, tool and generation, so replacing one tool's evidence writes its partition
alone, and reports on one run read only that run.  The other tables are small; a change writes
them anew under another version.  Which versions hold is one small file that is replaced
by an atomic rename, and an execution names the generation of its reads: a change of several
tables shows as a whole or, on failure, not at all.  One writer at a time is assumed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import columns as C
from ..functions.errors import EvidenceError
from ..sources import fastq, tables

# The columns, keys, references and literals of the tables.
SCHEMAS = {
    "benchmark_runs": "run_key string, created_at string, status string, completed_at string, benchmark_mode string, read_pairs bigint, "
    "replicates bigint, threads bigint, run_dir string, config_path string, data_root string, vcs_kind string, vcs_change_id string, "
    "vcs_commit_id string, vcs_description string, vcs_working_copy_dirty boolean",
    "dataset_subsets": "run_key string, dataset_name string, accession string, read_pairs bigint, r1_path string, r2_path string, "
    "r1_bytes bigint, r2_bytes bigint",
    "tool_versions": "run_key string, tool string, path string, version string",
    "tool_executions": "run_key string, dataset_name string, tool string, command string, execution_order bigint, hyperfine_mean_s double, "
    "hyperfine_median_s double, hyperfine_stddev_s double, hyperfine_min_s double, hyperfine_max_s double, hyperfine_user_s double, "
    "hyperfine_system_s double, merged_reads bigint, merged_read_records bigint, output_dir string",
    "merged_read_records": "run_key string, dataset_name string, tool string, read_id string, output_header string, merged_len bigint, "
    "avg_qual double, min_qual bigint, max_qual bigint, sequence_hash string, quality_hash string",
    "artifacts": "run_key string, dataset_name string, tool string, artifact_kind string, path string, required boolean, bytes bigint",
}
KEYS = {
    "benchmark_runs": ["run_key"],
    "dataset_subsets": ["run_key", "dataset_name"],
    "tool_versions": ["run_key", "tool"],
    "tool_executions": ["run_key", "dataset_name", "tool"],
    "merged_read_records": ["run_key", "dataset_name", "tool", "read_id"],
    "artifacts": ["run_key", "dataset_name", "tool", "artifact_kind"],
}
PARENTS = {
    "dataset_subsets": ("benchmark_runs", ["run_key"]),
    "tool_versions": ("benchmark_runs", ["run_key"]),
    "tool_executions": ("dataset_subsets", ["run_key", "dataset_name"]),
    "merged_read_records": ("tool_executions", ["run_key", "dataset_name", "tool"]),
    "artifacts": ("tool_executions", ["run_key", "dataset_name", "tool"]),
}
OPTIONAL = {
    "completed_at", "vcs_kind", "vcs_change_id", "vcs_commit_id", "vcs_description", "vcs_working_copy_dirty", "version", "hyperfine_stddev_s", "bytes"
}
#: Artifacts of every tool, and of each tool: kind, file below the output folder, required.  This engine's own carry its name.
COMMON_ARTIFACTS = ("command", "stdout_log", "stderr_log", "hyperfine_json", "merged_fastq")
TOOL_ARTIFACTS = {
    "matewise": [("matewise_summary_json", "matewise.summary.json", True), ("matewise_unmerged_fastq", "matewise.unmerged.fastq", False)],
    "fastp": [
        ("fastp_json", "fastp.json", True),
        ("fastp_html", "fastp.html", True),
        ("fastp_unpaired1_fastq", "fastp.unpaired1.fastq", False),
        ("fastp_unpaired2_fastq", "fastp.unpaired2.fastq", False),
        ("fastp_failed_fastq", "fastp.failed.fastq", False),
    ],
    "bbmerge": [("bbmerge_unmerged1_fastq", "bbmerge.unmerged1.fastq", False), ("bbmerge_unmerged2_fastq", "bbmerge.unmerged2.fastq", False)],
    "vsearch": [("vsearch_unmerged1_fastq", "vsearch.unmerged1.fastq", False), ("vsearch_unmerged2_fastq", "vsearch.unmerged2.fastq", False)],
}
ARTIFACT_KINDS = (*COMMON_ARTIFACTS, *(kind for some in TOOL_ARTIFACTS.values() for kind, _, _ in some))
CHECKS = {
    "benchmark_runs": "status IN ('running', 'completed') AND (status = 'completed') = (completed_at IS NOT NULL)",
    "artifacts": "artifact_kind IN (" + ", ".join(f"'{k}'" for k in ARTIFACT_KINDS) + ")",
}
RESULT_COLUMNS = {"run_key": "run_id", "dataset_name": "dataset"}
# End of fixed values.
PARTITIONS = ["run_key", "dataset_name", "tool"]
RECORDS, GENERATION = "merged_read_records", "generation"


def read_records(reads: DataFrame, header: str = "header", seq: str = "seq", qual: str = "qual", also: tuple[str, ...] = ()) -> DataFrame:
    """Merged reads as warehouse rows: id, header, length, quality summary, two tagged hashes; columns ``also`` stay.

    The summary is taken from the assembly result's columns where ``reads`` has them.
    """
    names = ("avg_qual", "min_qual", "max_qual")
    if set(names) <= set(reads.columns):
        summary = {n[:3]: F.coalesce(F.col(n), F.lit(0)).cast("double" if n == "avg_qual" else "long") for n in names}
    else:
        summary = C.quality_summary(F.col(qual))
    keep = [c for c in reads.columns if c in (*PARTITIONS, *also)]
    return reads.select(
        *keep,
        C.checked_read_id(F.col(header)).alias("read_id"),
        F.regexp_replace(F.col(header), "^@", "").alias("output_header"),
        F.length(seq).cast("long").alias("merged_len"),
        summary["avg"].alias("avg_qual"),
        summary["min"].alias("min_qual"),
        summary["max"].alias("max_qual"),
        C.tagged_sha256(F.col(seq)).alias("sequence_hash"),
        C.tagged_sha256(F.col(qual)).alias("quality_hash"),
    )


def tool_counts(records: DataFrame) -> DataFrame:
    return records.groupBy(*PARTITIONS).agg(F.count(F.lit(1)).alias("merged"))


#: Tools that one long tells of.
_BITS = 62


def agreement(records: DataFrame, executions: DataFrame) -> DataFrame:
    """Per dataset and unordered pair of tools: merged, shared and exclusive reads, Jaccard.

    Tools are numbered within their run and dataset.  A read's tools are bits that one aggregation
    unites, with partial results; equal sets are counted, and only these few are taken apart into pairs
    (a tool with itself gives its own count).  Tools that merged nothing still appear.
    """
    where = PARTITIONS[:2]
    tools = executions.select(*PARTITIONS).distinct()
    numbered = tools.select(
        *PARTITIONS,
        (F.row_number().over(Window.partitionBy(*where).orderBy("tool")) - 1).alias("at"),
        F.dense_rank().over(Window.orderBy(*where)).alias("group"),
    )  # a row for each execution
    words = (numbered.agg(F.max("at")).first()[0] or 0) // _BITS + 1
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") % _BITS)
    sets = [f"w{k}" for k in range(words)]
    per_read = (
        records.join(F.broadcast(numbered), PARTITIONS)
        .groupBy("group", "read_id")
        .agg(*(F.bit_or(F.when(F.floor(F.col("at") / _BITS) == k, bit).otherwise(F.lit(0).cast("long"))).alias(w) for k, w in enumerate(sets)))
    )
    counted = per_read.groupBy("group", *sets).agg(F.count(F.lit(1)).alias("n"))
    held = [F.transform(F.filter(F.sequence(F.lit(0), F.lit(_BITS - 1)), _has(w)), _plus(k * _BITS)) for k, w in enumerate(sets)]
    both = F.flatten(F.transform("held", lambda i: F.transform(F.filter("held", lambda j: j >= i), lambda j: F.struct(i.alias("l"), j.alias("r")))))
    counted = counted.select("group", "n", F.flatten(F.array(*held)).alias("held")).select("group", "n", F.explode(both).alias("pair"))
    counted = counted.groupBy("group", "pair").agg(F.sum("n").alias("n"))
    counts = counted.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("pair", "n"))).alias("counts"))
    left = numbered.select("group", *where, F.col("tool").alias("left_tool"), F.col("at").alias("left_at"))
    right = numbered.select("group", F.col("tool").alias("right_tool"), F.col("at").alias("right_at"))
    pairs = left.join(right, "group").where("right_at > left_at").join(counts, "group", "left")

    def number(left: str, right: str) -> F.Column:
        return F.coalesce(F.try_element_at("counts", F.struct(F.col(left).alias("l"), F.col(right).alias("r"))), F.lit(0)).cast("long")

    n_l, n_r, shared = number("left_at", "left_at"), number("right_at", "right_at"), number("left_at", "right_at")
    union = n_l + n_r - shared
    return pairs.select(
        *where,
        "left_tool",
        "right_tool",
        n_l.alias("left_merged"),
        n_r.alias("right_merged"),
        shared.alias("shared_merged"),
        (n_l - shared).alias("left_only"),
        (n_r - shared).alias("right_only"),
        F.round(F.when(union == 0, F.lit(0.0)).otherwise(shared / union), 6).alias("jaccard"),
    )


def _has(word: str):
    return lambda i: F.call_function("shiftright", F.col(word), i).bitwiseAND(F.lit(1)) == 1


def _plus(base: int):
    return lambda i: i + base


def latest_run(runs: DataFrame, mode: str) -> DataFrame:
    """The newest completed run of a mode: one row, or none."""
    done = runs.where((F.col("status") == "completed") & (F.col("benchmark_mode") == mode))
    return done.orderBy(F.desc("created_at"), F.desc("run_key")).limit(1)


def artifacts_of(spark: SparkSession, execution: dict, paths: dict[str, str]) -> DataFrame:
    """The artifacts of an execution (run_key, dataset_name, tool, output_dir): the common ones at ``paths``, and its tool's.

    A file that isn't there has no bytes.
    """
    folder = execution["output_dir"].rstrip("/")
    named = [(k, paths[k], True) for k in COMMON_ARTIFACTS]
    named += [(kind, paths.get(kind, f"{folder}/{name}"), needed) for kind, name, needed in TOOL_ARTIFACTS.get(execution["tool"], [])]
    rows = [(*(execution[c] for c in PARTITIONS), kind, path, needed, fastq.file_size(path)) for kind, path, needed in named]
    return spark.createDataFrame(rows, SCHEMAS["artifacts"])


def missing_artifacts(artifacts: DataFrame) -> DataFrame:
    """Required artifacts whose file isn't there."""
    return artifacts.where("required AND bytes IS NULL").select(*KEYS["artifacts"], "path")


@dataclass(frozen=True)
class Warehouse:
    spark: SparkSession
    root: str

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> Warehouse:
        """Open a warehouse, making the tables it lacks."""
        found = cls(spark, root.rstrip("/"))
        have = found._versions()
        found._switch(have | {n: found._write(n, spark.createDataFrame([], found._schema(n))) for n in SCHEMAS if n != RECORDS and n not in have})
        return found

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Warehouse:
        """Open an existing warehouse; one that isn't there is an error and isn't made."""
        found = cls(spark, root.rstrip("/"))
        if set(found._versions()) != set(SCHEMAS) - {RECORDS}:
            raise EvidenceError(f"no warehouse at {root}")
        return found

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _system(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> dict[str, str]:
        """The version of each small table that holds."""
        if not self._system().exists(self._path("versions.json")):
            return {}
        lines = self.spark.read.text(f"{self.root}/versions.json", wholetext=True).first()
        return json.loads(lines["value"])

    def _switch(self, versions: dict[str, str]) -> None:
        """Make versions hold, all at once."""
        jvm, new = self.spark.sparkContext._jvm, self._path(f"versions-{uuid.uuid4().hex}.json")
        out = self._system().create(new, True)
        out.write(json.dumps(versions).encode())
        out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        files.rename(new, self._path("versions.json"), how)

    def _schema(self, name: str) -> StructType:
        schema = self.spark.createDataFrame([], SCHEMAS[name]).schema
        return schema.add(GENERATION, "string") if name == "tool_executions" else schema

    def _write(self, name: str, rows: DataFrame) -> str:
        """A small table anew, as one file; returns its version, which doesn't hold yet."""
        version = uuid.uuid4().hex
        cast = rows.select(*[F.col(f.name).cast(f.dataType) for f in self._schema(name).fields])
        cast.coalesce(1).write.parquet(f"{self.root}/{name}/{version}")
        return version

    def _held(self, name: str) -> DataFrame:
        return self.spark.read.schema(self._schema(name)).parquet(f"{self.root}/{name}/{self._versions()[name]}")

    def _generation(self, key: dict) -> str:
        return f"{self.root}/{RECORDS}/" + "/".join(f"{c}={key[c]}" for c in (*PARTITIONS, GENERATION))

    def table(self, name: str) -> DataFrame:
        """A table as it stands now."""
        if name != RECORDS:
            return self._held(name).drop(GENERATION)
        schema = self.spark.createDataFrame([], SCHEMAS[name]).schema
        if not self._system().exists(self._path(RECORDS)):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(StructType(schema.fields).add(GENERATION, "string")).parquet(f"{self.root}/{RECORDS}")
        standing = F.broadcast(self._held("tool_executions").select(*PARTITIONS, GENERATION))  # a row for each execution
        return rows.join(standing, [*PARTITIONS, GENERATION], "left_semi").select(*schema.fieldNames())

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows to a small table; merged reads come with :meth:`replace_evidence`."""
        if name == RECORDS:
            raise EvidenceError("merged reads belong to an execution: use replace_evidence")
        held = self._held(name)
        for c in held.columns:
            rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None))
        self._switch(self._versions() | {name: self._write(name, held.unionByName(rows.select(*held.columns)))})

    def insert(self, name: str, *rows: dict) -> None:
        fields = self.spark.createDataFrame([], SCHEMAS[name]).schema.fieldNames()
        self.append(name, self.spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], SCHEMAS[name]))

    def complete_run(self, run_key: str, at: str) -> None:
        """Mark a run completed."""
        runs, hit = self._held("benchmark_runs"), F.col("run_key") == run_key
        done = runs.withColumn("status", F.when(hit, "completed").otherwise(F.col("status"))).withColumn(
            "completed_at", F.when(hit, at).otherwise(F.col("completed_at"))
        )
        self._switch(self._versions() | {"benchmark_runs": self._write("benchmark_runs", done)})

    def _executions_with(self, row: dict, generation: str | None) -> DataFrame:
        held = self._held("tool_executions")
        fields = [f for f in held.columns if f != GENERATION]
        new = self.spark.createDataFrame([tuple(row.get(f) for f in fields)], SCHEMAS["tool_executions"])
        if generation is not None:
            new = new.withColumn(GENERATION, F.lit(generation))
        else:  # the reads of the execution that was there stay its reads
            new = new.join(held.select(*PARTITIONS, GENERATION), PARTITIONS, "left").select(*held.columns)
        return upserted(held, new, PARTITIONS)

    def upsert_execution(self, row: dict) -> None:
        """Replace the execution of a run, dataset and tool, or add it."""
        rows = self._executions_with(row, None)
        self._switch(self._versions() | {"tool_executions": self._write("tool_executions", rows)})

    def upsert_executions(self, rows: DataFrame) -> None:
        """:meth:`upsert_execution` of many; a run, dataset and tool must not be there twice."""
        held = self._held("tool_executions")
        new = rows.join(held.select(*PARTITIONS, GENERATION), PARTITIONS, "left").select(*held.columns)
        self._switch(self._versions() | {"tool_executions": self._write("tool_executions", upserted(held, new, PARTITIONS))})

    def replace_evidence(self, execution: dict, records: DataFrame, artifacts: DataFrame | None = None) -> None:
        """Replace a tool's execution, merged reads and artifacts together.

        Everything is checked before anything visible changes: no read twice, as many as the
        execution says.  On failure the old rows stay, all of them.
        """
        generation = uuid.uuid4().hex
        path, names = self._generation(execution | {GENERATION: generation}), [f for f in records.columns if f not in PARTITIONS]
        schema = StructType([f for f in self._schema(RECORDS).fields if f.name not in PARTITIONS])
        try:
            records.select(*names).write.parquet(path)
            held = self.spark.read.schema(schema).parquet(path)
            if twice := duplicate_ids(held).first():
                raise EvidenceError(f"read {twice['read_id']} is merged {twice['n']} times")
            if (n := held.count()) != execution["merged_read_records"]:
                raise EvidenceError(f"{n} merged reads, but the execution says {execution['merged_read_records']}")
            new = {"tool_executions": self._write("tool_executions", self._executions_with(execution, generation))}
            mine = " AND ".join(f"{c} = '{execution[c]}'" for c in PARTITIONS)
            rest = self._held("artifacts").where(f"NOT ({mine})")
            new["artifacts"] = self._write("artifacts", rest if artifacts is None else rest.unionByName(artifacts))
        except Exception:
            self._system().delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)
            raise
        self._switch(self._versions() | new)

    def vacuum(self) -> int:
        """Delete what no version that holds refers to; returns how many folders went.  Not while reports still read."""
        system, held, gone = self._system(), self._versions(), 0
        standing = {self._generation(r.asDict()) for r in self._held("tool_executions").where(f"{GENERATION} IS NOT NULL").collect()}
        old = [f.getPath() for n in held for f in system.listStatus(self._path(n)) if f.getPath().getName() != held[n]]
        if system.exists(self._path(RECORDS)):
            for f in system.globStatus(self._path(f"{RECORDS}/*/*/*/*")) or []:
                below = f.getPath().toString().partition(f"/{RECORDS}/")[2]
                if f"{self.root}/{RECORDS}/{below}" not in standing:
                    old.append(f.getPath())
        for path in old:
            gone += system.delete(path, True)
        return gone

    def violations(self) -> DataFrame:
        """(table, rule, key) of every broken key, reference, check or missing value."""
        out = self.spark.createDataFrame([], "table string, rule string, key string")
        for name, keys in KEYS.items():
            rows, text = self.table(name), F.concat_ws("/", *keys)
            twice = rows.groupBy(*keys).count().where("count > 1")
            out = out.unionByName(twice.select(F.lit(name).alias("table"), F.lit("key").alias("rule"), text.alias("key")))
            needed = [f for f in rows.columns if f not in OPTIONAL]
            empty = rows.where(F.greatest(*[F.col(f).isNull() for f in needed]))
            out = out.unionByName(empty.select(F.lit(name).alias("table"), F.lit("null").alias("rule"), text.alias("key")))
            if name in PARENTS:
                parent, on = PARENTS[name]
                lost = rows.join(self.table(parent).select(*on), on, "left_anti").select(*keys).distinct()
                out = out.unionByName(lost.select(F.lit(name).alias("table"), F.lit("reference").alias("rule"), text.alias("key")))
            if name in CHECKS:
                bad = rows.where(f"NOT ({CHECKS[name]})")
                out = out.unionByName(bad.select(F.lit(name).alias("table"), F.lit("check").alias("rule"), text.alias("key")))
        return out

    def validate(self) -> None:
        if found := self.violations().take(5):
            raise EvidenceError("; ".join(f"{r['table']}: {r['rule']} {r['key']}" for r in found))

    def latest(self, mode: str) -> str:
        found = latest_run(self.table("benchmark_runs"), mode).first()
        if found is None:
            raise EvidenceError(f"no completed run in mode {mode}")
        return found["run_key"]

    def run(self, run_key: str) -> DataFrame:
        """A run's row, completed or not."""
        return self.table("benchmark_runs").where(F.col("run_key") == run_key).limit(1)

    def _of(self, name: str, run_key: str) -> DataFrame:
        done = self.table("benchmark_runs").where((F.col("run_key") == run_key) & (F.col("status") == "completed"))
        return self.table(name).where(F.col("run_key") == run_key).join(done.select("run_key"), "run_key", "left_semi")

    def agreement_report(self, run_key: str) -> DataFrame:
        rows = agreement(self._of("merged_read_records", run_key), self._of("tool_executions", run_key)).drop("run_key")
        return rows.orderBy("dataset_name", "left_tool", "right_tool")

    def tool_results(self, run_key: str) -> DataFrame:
        return tool_results(self.table("benchmark_runs"), self.table("dataset_subsets"), self.table("tool_executions"), run_key)


def tool_results(runs: DataFrame, subsets: DataFrame, executions: DataFrame, run_key: str) -> DataFrame:
    """Timings and counts of a completed run's executions, 20 columns, in order."""
    done = runs.where((F.col("run_key") == run_key) & (F.col("status") == "completed")).select("run_key", "benchmark_mode", "replicates", "threads")
    joined = done.join(subsets.drop("r1_path", "r2_path"), "run_key").join(executions, ["run_key", "dataset_name"])
    timings = [F.col(f"hyperfine_{x}_s").alias(f"{x}_s") for x in ("mean", "median", "stddev", "min", "max", "user", "system")]
    return joined.select(
        "run_key", "benchmark_mode", "dataset_name", "accession", "read_pairs", "tool", "replicates", "threads", *timings,
        "merged_reads", "merged_read_records", "r1_bytes", "r2_bytes", "output_dir",
    ).orderBy("dataset_name", "tool")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` replacing those of equal keys."""
    both = old.withColumn("__n", F.lit(0)).unionByName(new.withColumn("__n", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__n")))
    return both.withColumn("__r", rank).where("__r = 1").drop("__n", "__r")


def duplicate_ids(records: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, read_id, n) of reads that are there more than once."""
    return records.groupBy(*keys, "read_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def accounting(expected_pairs: int, reported_pairs: int, joined: int, records: int, parts: list[int], unmerged: list[int], log: str) -> list[str]:
    """What in a tool's own numbers doesn't add up; empty if all does.

    ``parts`` are the outcomes it reports, ``unmerged`` the records of each of its unmerged files.
    """
    wrong = []
    if reported_pairs != expected_pairs:
        wrong.append(f"reported {reported_pairs} pairs, expected {expected_pairs}")
    if joined != records:
        wrong.append(f"reported {joined} joined reads, but {records} records")
    if parts and sum(parts) != expected_pairs:
        wrong.append(f"outcomes sum to {sum(parts)} of {expected_pairs} pairs")
    wrong += [f"an unmerged file has {n} records, expected {expected_pairs - joined}" for n in unmerged if n != expected_pairs - joined]
    if "Exception in thread" in log or "java.lang." in log:
        wrong.append("the log holds an exception")
    return wrong


#: What a tool's log says of its pairs (fixed values): labels before or words after a number; pairs, merged, then the other outcomes.
LOG_METRICS = {"bbmerge": ("label", ["Pairs", "Joined", "No Solution", "Too Short"]), "vsearch": ("words", ["Pairs", "Merged", "Not merged"])}


def check_tool(spark: SparkSession, tool: str, folder: str, expected_pairs: int, merged_path: str, log_path: str | None = None) -> None:
    """Hold a tool's log against its files; anything that doesn't add up is an error.  Tools without a known log pass."""
    if tool not in LOG_METRICS:
        return
    kind, names = LOG_METRICS[tool]
    path = log_path or f"{folder.rstrip('/')}/{tool}.stderr.log"
    found = tables.log_metrics(spark, path, names if kind == "label" else [], names if kind == "words" else [])
    if lost := [n for n in names if found[n] is None]:
        raise EvidenceError(f"{path} lacks {', '.join(lost)}")
    pairs, joined, *rest = (found[n] for n in names)
    exceptions = spark.read.text(path).where("value LIKE '%Exception in thread%' OR value LIKE '%java.lang.%'").limit(1).collect()
    unmerged = [p for _, name, _ in TOOL_ARTIFACTS[tool] if fastq.file_size(p := f"{folder.rstrip('/')}/{name}") is not None] if tool == "bbmerge" else []
    counts = {r["path"]: r["records"] for r in fastq.record_counts(spark, [merged_path, *unmerged]).collect()}
    wrong = accounting(
        expected_pairs, pairs, joined, counts[merged_path], [joined, *rest], [counts[p] for p in unmerged], "".join(r["value"] for r in exceptions)
    )
    if wrong:
        raise EvidenceError(f"{tool}: {'; '.join(wrong)}")


def write_results(results: DataFrame, path: str) -> None:
    """Tool results as a folder with one tab-separated file: 20 columns, an empty cell for a missing deviation."""
    if results.limit(1).count() == 0:
        raise EvidenceError("no tool results")
    tables.write_tsv(results.withColumnsRenamed(RESULT_COLUMNS), path)


def timing_markdown(rows: list[dict]) -> str:
    """Tool results as a Markdown table of 8 columns."""
    head = ["dataset", "tool", "mean_s", "median_s", "stddev_s", "min_s", "max_s", "merged_reads"]

    def cell(x: object) -> str:
        return "" if x is None else str(x)

    lines = ["| " + " | ".join(head) + " |", "| --- | --- |" + " ---: |" * 6]
    for r in rows:
        lines.append("| " + " | ".join([r["dataset_name"], r["tool"], *(cell(r[c]) for c in head[2:])]) + " |")
    return "\n".join(lines) + "\n"


def overlap_table(rows: list[dict]) -> str:
    """The agreement report as a table with rounded corners; it needs two tools."""
    if not rows:
        raise EvidenceError("an overlap report needs two tools in one run")
    names = ["dataset", "left_tool", "right_tool", "left_merged", "right_merged", "shared_merged", "left_only", "right_only", "jaccard"]
    cells = [names, *([str(r["dataset_name" if n == "dataset" else n]) for n in names] for r in rows)]
    widths = [max(len(row[k]) for row in cells) for k in range(len(names))]

    def rule(left: str, middle: str, right: str) -> str:
        return left + middle.join("─" * (w + 2) for w in widths) + right

    body = ["│" + "│".join(f" {x:<{w}} " for x, w in zip(row, widths)) + "│" for row in cells]
    return "\n".join([rule("╭", "┬", "╮"), body[0], rule("├", "┼", "┤"), *body[1:], rule("╰", "┴", "╯")]) + "\n"
