"""Deterministic read pairs from the orders table, in SQL that Spark and DuckDB evaluate alike.

Inserts of 20 to 179 bases give 75-base reads: long inserts overlap at their ends, short
ones are read through into adapters.  By the key, pairs also get base errors, equal
qualities, repetitive inserts, ambiguous bases, unrelated mates and foreign mate names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READ = 75
_HEX, _BASES = "0123456789abcdef", "ACGTACGTACGTACGT"
_QUALS = "#%+05:?ABDFGHIJJ"


def _hex(tag: str, count: int) -> str:
    return "concat(" + ", ".join(f"md5(concat('{tag}{i}-', k))" for i in range(count)) + ")"


def _rotated(read: str, places: list[int]) -> str:
    """The read with other bases at some places, in pieces: the read is named once per piece."""
    parts, at = [], 1
    for place in places:
        parts += [f"substr({read}, {at}, {place - at})", f"translate(substr({read}, {place}, 1), 'ACGT', 'CGTA')"]
        at = place + 1
    return "concat(" + ", ".join([*parts, f"substr({read}, {at}, {READ})"]) + ")"


def pairs_sql(source: str = "orders") -> str:
    """Query text: key, ins, name1, r1_seq, r1_qual, name2, r2_seq, r2_qual."""
    dna = f"translate({{}}, '{_HEX}', '{_BASES}')"
    return f"""
    SELECT key, ins,
           concat('read', k, '/1') AS name1, r1_seq, r1_qual,
           concat('read', CASE WHEN key % 4001 = 0 THEN concat(k, 'x') ELSE k END, '/2 extra') AS name2,
           CASE WHEN key % 13 = 0 THEN {_rotated("r2", [11, 20, 31, 40, 52, 60, 66])}
                WHEN key % 11 = 0 THEN {_rotated("r2", [11, 31, 52])} WHEN key % 3 = 0 THEN {_rotated("r2", [37])} ELSE r2 END AS r2_seq,
           r2_qual
    FROM (
      SELECT key, k, ins,
             CASE WHEN key % 23 = 0 THEN concat(substr(r1, 1, 9), 'N', substr(r1, 11, {READ})) ELSE r1 END AS r1_seq,
             CASE WHEN key % 5 = 0 THEN repeat('I', {READ}) ELSE substr(translate({_hex("p", 3)}, '{_HEX}', '{_QUALS}'), 1, {READ}) END AS r1_qual,
             r2,
             CASE WHEN key % 5 = 0 THEN repeat('I', {READ}) ELSE substr(translate({_hex("q", 3)}, '{_HEX}', '{_QUALS}'), 1, {READ}) END AS r2_qual
      FROM (
        SELECT key, k, ins,
               substr(concat(dna, {dna.format(_hex("x", 2))}, repeat('T', 30)), 1, {READ}) AS r1,
               substr(concat(CASE WHEN key % 29 = 0 THEN {dna.format(_hex("z", 3))} ELSE reverse(translate(dna, 'ACGT', 'TGCA')) END,
                             {dna.format(_hex("y", 2))}, repeat('G', 30)), 1, {READ}) AS r2
        FROM (
          SELECT key, k, ins,
                 CASE WHEN key % 17 = 0 THEN repeat('A', ins) WHEN key % 19 = 0 THEN substr(repeat('AC', 90), 1, ins)
                      ELSE substr({dna.format(_hex("i", 6))}, 1, ins) END AS dna
          FROM (
            SELECT o_orderkey AS key, CAST(o_orderkey AS STRING) AS k, CAST(20 + (o_orderkey * 7) % 160 AS INT) AS ins
            FROM {source}
          ) AS keys
        ) AS inserts
      ) AS reads
    ) AS qualities
    """


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")


def pairs_of(orders: DataFrame) -> DataFrame:
    """The pairs of orders (o_orderkey), partitioned and in order as these are."""
    orders.createOrReplaceTempView("matewise_orders")
    return orders.sparkSession.sql(pairs_sql("matewise_orders")).withColumn("ins", F.col("ins").cast("int"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of a scale's orders.

    Keys are spread before anything is generated: they are small, reads are not, and the
    source may be a single file.
    """
    return pairs_of(keys(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism, "o_orderkey"))
