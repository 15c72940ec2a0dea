"""Helpers shared by the training-data operators.

Everything here is DataFrame code: no UDF, pandas, Arrow or RDD use, so that
operators which must stay native can call it.
"""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words as the contracts define them (white space is these six ASCII characters only).
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch in passes that :func:`stash` runs; rows may hold whole texts or sets.
BATCH_BYTES = 16 << 20
#: The same where memory is short: the executor and its Python worker both hold a batch, some of it more than once.
SMALL_BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_STASHED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only on one machine (tests, a laptop)
    the warehouse folder is used where that is unset.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_matewise"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stash(df: DataFrame, label: str = "step", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; ``batch_bytes`` bounds its Arrow batches.

    This cuts the lineage, so a lost executor costs a re-read and no re-computation,
    and later readers prune columns.  The files go when the driver ends, at the end of
    the :func:`scratch` they were made in, or with :func:`drop_stashes`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with _setting(spark, _BATCH, str(batch_bytes)):
        df.write.parquet(path)
    _STASHED.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the folders of stashed frames that nothing still to be computed reads."""
    for df in frames:
        for item in [x for x in _STASHED if x[1] == getattr(df, "_stashed_at", None)]:
            _STASHED.remove(item)
            _delete(*item)


@contextmanager
def scratch() -> Iterator[None]:
    """What is stashed inside goes at the end, so results must be written by then."""
    mine = set(_STASHED)
    try:
        yield
    finally:
        for item in [x for x in _STASHED if x not in mine]:
            _STASHED.remove(item)
            _delete(*item)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_stashes() -> None:
    """Delete every folder :func:`stash` wrote.  Best effort: the session may be gone."""
    while _STASHED:
        try:
            _delete(*_STASHED.pop())
        except Exception:  # noqa: BLE001 - the JVM has ended already
            continue


atexit.register(drop_stashes)


def code_points(text: Column) -> Column:
    """Length in code points, null counting as empty."""
    return F.coalesce(F.length(text), F.lit(0)).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that the given columns alone decide."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def apart(key: Column) -> Column:
    """A join key (long) with the meaning of ``key`` that no aggregation by ``key`` is partitioned by.

    A join on the key of an aggregate uses its partitions as they are, and then Spark can't split a
    skewed one.  On this key both sides are shuffled for the join (the aggregated one is small), so
    a key with a third of all rows is split where adaptive execution finds it.
    """
    return F.bitwise_not(key)


def running_sum(rows: DataFrame, keys: list[str], at: str, value: str, out: str, width: int = 4096) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``keys`` with a smaller ``at`` (unique within keys).

    Only rows of one key and block of ``width`` places are sorted together, and the sums of blocks.
    Rows with a null key are left out (callers give none); ``rows`` is read twice.
    """
    block, base = "__block", "__block_base"
    placed = rows.withColumn(block, F.floor(F.col(at) / width))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy(*keys, block).agg(F.sum(value).alias("__sum")).select(*keys, block, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias(base))
    within = Window.partitionBy(*keys, block).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(bases, [*keys, block]).withColumn(out, F.col(base) + F.coalesce(F.sum(value).over(within), F.lit(0))).drop(block, base)


def running_offsets(
    rows: DataFrame,
    group: str,
    order: list[str],
    value: str | None,
    out: str,
    rows_per_chunk: int = 512,
    row: str = "row",
) -> DataFrame:
    """Add ``out``: the sum of ``value`` (or the count) over the rows before, within ``group``.

    The order is that of ``order`` after a hash, so it is pseudorandom but fixed.
    Rows are cut by hash into chunks of about ``rows_per_chunk`` rows over all groups;
    the chunks of a group are summed up in two levels, and only rows of one group and chunk
    are ever sorted together: a group that holds a third of all rows spreads over many
    tasks.  Where more rows than a chunk should hold are equal in ``order``, their unique number
    ``row`` spreads them; between such rows alone the order depends on it.  ``group`` must not be
    null; ``rows`` is read four times, so stash what is dear to compute.
    """
    h, chunk, base = "__h", "__chunk", "__base"
    amount = F.lit(1).cast("long") if value is None else F.col(value).cast("long")
    chunks = max(1, -(-rows.count() // rows_per_chunk))
    placed = rows.withColumn(h, F.xxhash64(*[F.col(c) for c in order]))
    equal = stash(placed.groupBy(h).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows_per_chunk).select(h), "equal")
    if n := equal.count():
        some = equal.select(F.col(h).alias("__equal"))
        placed = placed.join(F.broadcast(some) if n <= 100_000 else some, F.col(h) == F.col("__equal"), "left")
        placed = placed.withColumn(h, F.when(F.col("__equal").isNull(), F.col(h)).otherwise(F.xxhash64(h, row))).drop("__equal")
    placed = placed.withColumn(chunk, F.pmod(F.col(h), F.lit(chunks)))
    totals = placed.groupBy(group, chunk).agg(F.sum(amount).alias("__total"))
    bases = running_sum(totals, [group], chunk, "__total", base).drop("__total")
    within = Window.partitionBy(group, chunk).orderBy(h, *order, row).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(bases, [group, chunk])
        .withColumn(out, F.col(base) + F.coalesce(F.sum(amount).over(within), F.lit(0)))
        .drop(h, chunk, base)
    )
