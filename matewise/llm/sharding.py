"""Sharding by a hierarchical weighted hash tree (native).

A key descends region, rack and shard.  At each level every child draws
``-ln(u) / weight`` with ``u`` hashed from the key and the child's name; the
smallest draw wins.  A child's draw depends on nothing but the key, its name and
its weight, so when one weight changes, keys move only between that child and its
siblings: movement stays in the subtree whose weights change.

A tree grows by a region of its own for each new shard.  The keys that the new
region wins have only the new shard below it, so a grown tree takes rows only into
the new shard and moves nothing else.

Edge cases: null ids hash as one fixed key; null texts have size 8 and CRC 0;
repeated rows share a shard and get slots of their own; an empty table gives an
empty result; only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_offsets, stash, uniform


@dataclass(frozen=True)
class HashTree:
    """Weights of the shards: ``regions[i][j]`` is the tuple of shard weights of a rack."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @classmethod
    def uniform(cls, regions: int, racks: int, shards: int) -> HashTree:
        return cls(tuple(tuple((1.0,) * shards for _ in range(racks)) for _ in range(regions)))

    def __post_init__(self) -> None:
        weights = [w for region in self.regions for rack in region for w in rack]
        if not weights or any(not w > 0 for w in weights):
            raise ValueError("a tree needs shards, and every weight must be above 0")

    @property
    def n_shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)

    def grown(self, weight: float = 1.0) -> HashTree:
        """One more shard, in a region of its own."""
        return HashTree((*self.regions, ((weight,),)))


def _draw(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the smallest weighted draw."""
    if len(children) == 1:
        return children[0][2]
    draws = [
        F.struct((-F.ln(uniform(key, F.lit(name))) / F.lit(float(weight))).alias("d"), value.alias("v"))
        for name, weight, value in children
    ]
    return F.array_min(F.array(*draws))["v"]


def _pick(number: Column, options: list[Column]) -> Column:
    """``options[number]``; only the chosen one is evaluated."""
    out = options[-1]
    for i in reversed(range(len(options) - 1)):
        out = F.when(number == i, options[i]).otherwise(out)
    return out


def descend(df: DataFrame, key: Column, tree: HashTree, prefix: str = "") -> DataFrame:
    """Add ``{prefix}region``, ``{prefix}rack`` and ``{prefix}shard`` (all int, global numbers)."""
    region, rack, shard, k = f"{prefix}region", f"{prefix}rack", f"{prefix}shard", "__key"
    mass = [sum(sum(r) for r in reg) for reg in tree.regions]
    racks: list[list[tuple[str, float, Column]]] = []
    leaves: list[list[tuple[str, float, Column]]] = []
    for i, reg in enumerate(tree.regions):
        racks.append([])
        for j, weights in enumerate(reg):
            racks[-1].append((f"{i}/{j}", sum(weights), F.lit(len(leaves))))
            first = sum(len(x) for x in leaves)
            leaves.append([(f"{i}/{j}/{m}", w, F.lit(first + m)) for m, w in enumerate(weights)])
    out = df.withColumn(k, F.coalesce(key.cast("string"), F.lit("∅")))
    out = out.withColumn(region, _draw(F.col(k), [(str(i), w, F.lit(i)) for i, w in enumerate(mass)]))
    out = out.withColumn(rack, _pick(F.col(region), [_draw(F.col(k), x) for x in racks]))
    return out.withColumn(shard, _pick(F.col(rack), [_draw(F.col(k), x) for x in leaves])).drop(k)


def shard_rows(
    docs: DataFrame, tree: HashTree, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Place every row: id, size, text_crc32, region, rack, shard, slot, grown_shard.

    ``slot`` numbers the rows of a shard from 0 without gaps.  Sizes are UTF-8 bytes
    plus 8 for the id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    rows = descend(rows, F.col("id"), tree)
    rows = descend(rows, F.col("id"), tree.grown(), "grown_")
    return running_offsets(stash(rows, "places"), "shard", ["id", "text_crc32", "size"], None, "slot").drop("row")
