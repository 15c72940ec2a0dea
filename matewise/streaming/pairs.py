"""Assembly of a stream of pairs.

The chain is a stateless map over rows, so a stream of pair tables needs no watermark
and no state; pairing by position has happened before, where the files were read.  A stream of
file pairs has one: how many mates haven't matched so far, which the outcomes written before tell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.errors import PairingError
from ..functions.params import EngineConfig
from ..operators.assembly import assemble, pairs_from
from ..operators.kernel import MISMATCH
from ..sources import fastq

SCHEMA = "key bigint, r1_seq string, r1_qual string, r2_seq string, r2_qual string"


def read_pairs(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Pair tables as they arrive in a folder of Parquet files."""
    return pairs_from(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path), "key")


def assemble_stream(pairs: DataFrame, out: str, checkpoint: str, config: EngineConfig = EngineConfig()) -> StreamingQuery:
    """Append outcomes as Parquet, by status; ends when what is there has been read."""
    rows = assemble(pairs, config)
    writer = rows.writeStream.format("parquet").partitionBy("status").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(out)


FILE_KEYS = ["file_index", "pair_ordinal", "r1_name", "r2_name"]


def read_files(spark: SparkSession, folder: str, log: str, forward: str = "_1.", reverse: str = "_2.") -> DataFrame:
    """Pairs of FASTQ files as both mates' files are there, in whichever batch each arrived."""
    fastq.register(spark)
    reader = spark.readStream.format("fastq_pairs").option("folder", folder).option("log", log)
    return reader.option("forward", forward).option("reverse", reverse).load()


def assemble_files(pairs: DataFrame, out: str, checkpoint: str, config: EngineConfig = EngineConfig(), max_mismatches: int = 3) -> StreamingQuery:
    """Outcomes of :func:`read_files` as Parquet by batch and status; ends when what is there has been read.

    Mismatched mates count over all batches; with more than ``max_mismatches`` the query fails, and nothing of
    that batch is written.  A batch that is repeated after a failure replaces its outcomes.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = pairs_from(batch, FILE_KEYS, r1_name="r1_name", r2_name="r2_name")
        seen, bad = rows.agg(F.count(F.lit(1)), F.count_if(~F.col("mates_match"))).first()
        if not seen:
            return
        if number and bad <= max_mismatches:
            before = spark.read.schema("batch int, status string").option("basePath", out).parquet(out) if _is_there(spark, out) else None
            bad += before.where((F.col("batch") < number) & (F.col("status") == MISMATCH)).count() if before is not None else 0
        if bad > max_mismatches:
            raise PairingError(f"more than {max_mismatches} mates don't match up to batch {number}; sort both files of each pair alike")
        assemble(rows, config).write.mode("overwrite").partitionBy("status").parquet(f"{out}/batch={number}")

    return pairs.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _is_there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
