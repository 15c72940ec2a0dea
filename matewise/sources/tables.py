"""Small text sources of the evidence warehouse: dataset lists, metadata, logs, timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import effective_pairs
from ..functions.errors import InputError
from . import fastq


def datasets(spark: SparkSession, path: str) -> DataFrame:
    """A dataset list (tab-separated name, accession, cap, note): blank lines and # comments are skipped."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split("value", "\t")
    cell = lambda i: F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit(""))
    rows = lines.select(cell(0).alias("name"), cell(1).alias("accession"), cell(2).alias("cap"), F.coalesce(cell(3), F.lit("")).alias("note"))
    if bad := rows.where("name IS NULL OR accession IS NULL").first():
        raise InputError(f"a dataset needs a name and an accession: {bad.asDict()}")
    if bad := rows.where("cap IS NOT NULL AND coalesce(try_cast(cap AS BIGINT), 0) <= 0").first():
        raise InputError(f"a cap must be a positive number: {bad['cap']}")
    return rows.withColumn("read_pair_cap", F.expr("try_cast(cap AS BIGINT)")).drop("cap")


def with_effective_pairs(rows: DataFrame, requested: int) -> DataFrame:
    return rows.withColumn("read_pairs", effective_pairs(F.col("read_pair_cap"), F.lit(requested).cast("long")))


def metadata(spark: SparkSession, path: str, least_columns: int) -> dict[str, str]:
    """The first data row of a tab-separated file with a header."""
    rows = spark.read.csv(path, sep="\t", header=True)
    if len(rows.columns) < least_columns:
        raise InputError(f"{path} has {len(rows.columns)} columns, {least_columns} are needed")
    found = rows.first()
    if found is None:
        raise InputError(f"{path} has no data row")
    return found.asDict()


def write_tsv(rows: DataFrame, path: str) -> None:
    """A small result as tab-separated text with a header; nulls are empty."""
    rows.coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="", emptyValue="")


# The columns of the two metadata files.
SOURCE_COLUMNS = ("name", "accession", "run", "platform", "layout", "strategy", "read_count", "base_count", "r1", "r2", "note")
SUBSET_COLUMNS = ("name", "accession", "read_pairs", "r1", "r2", "r1_bytes", "r2_bytes", "r1_records", "r2_records")


def write_source(spark: SparkSession, path: str, dataset: dict, listing: dict, r1: str, r2: str) -> None:
    """Metadata of a fetched dataset, a row of 11 columns; the run must be paired, with two files."""
    paired_run(listing["layout"], listing["urls"])
    row = dataset | listing | {"r1": r1, "r2": r2}
    write_tsv(spark.createDataFrame([tuple(str(row.get(c, "")) for c in SOURCE_COLUMNS)], list(SOURCE_COLUMNS)), path)


def write_subset(spark: SparkSession, path: str, source: dict, read_pairs: int, r1: str, r2: str) -> None:
    """Metadata of a prepared subset, a row of 9 columns: sizes and records are read from its files, or folders of parts."""
    packed = [p for p in dict.fromkeys((r1, r2)) if p.endswith("gz")]
    if packed and (bad := fastq.gzip_faults(spark, packed).where("fault IS NOT NULL").first()):
        raise InputError(bad["fault"])
    counts = {r["path"]: r["records"] for r in fastq.record_counts(spark, [r1, r2]).collect()}
    sizes = [sum(fastq.file_size(f) for f in fastq.files_of(p)) for p in (r1, r2)]
    row = (source["name"], source["accession"], read_pairs, r1, r2, *sizes, counts[r1], counts[r2])
    write_tsv(spark.createDataFrame([tuple(map(str, row))], list(SUBSET_COLUMNS)), path)


def read_source(spark: SparkSession, path: str) -> dict[str, str]:
    return metadata(spark, path, 10)


def read_subset(spark: SparkSession, path: str) -> dict[str, str]:
    return metadata(spark, path, 5)


def paired_run(layout: str, urls: str) -> list[str]:
    """The two files of a sequencing run's listing; it must be paired."""
    found = [u for u in urls.split(";") if u]
    if layout != "PAIRED" or len(found) < 2:
        raise InputError(f"not a paired run: layout {layout}, {len(found)} files")
    return found[:2]


def labelled_metric(label: str) -> Column:
    """A number from a line ``Label: n ...``."""
    return F.expr(f"try_cast(regexp_replace(regexp_extract(value, '^\\\\s*{label}:\\\\s*([0-9,]+)', 1), ',', '') AS BIGINT)")


def counted_metric(words: str) -> Column:
    """A number from a line ``n Label words ...``."""
    return F.expr(f"try_cast(regexp_extract(value, '^\\\\s*([0-9]+)\\\\s+{words}', 1) AS BIGINT)")


def log_metrics(spark: SparkSession, path: str, labels: list[str], phrases: list[str]) -> dict[str, int | None]:
    """The first value of each metric in a tool's log."""
    lines = spark.read.text(path)
    wanted = [F.first(labelled_metric(x), ignorenulls=True).alias(x) for x in labels]
    wanted += [F.first(counted_metric(x), ignorenulls=True).alias(x) for x in phrases]
    return lines.agg(*wanted).first().asDict()


def timings(spark: SparkSession, path: str) -> DataFrame:
    """The first result of a timing file: mean, stddev (may be null), median, min, max, user, system."""
    fields = "mean double, stddev double, median double, min double, max double, user double, system double"
    rows = spark.read.schema(f"results array<struct<{fields.replace(' double', ': double')}>>").json(path, multiLine=True)
    return rows.select(F.get("results", F.lit(0)).alias("r")).where("r IS NOT NULL").select("r.*")
