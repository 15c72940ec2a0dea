"""Embedding near-duplicates by randomised-rotation binary codes.

A unit vector is turned by fixed random rotations and kept as sign bits, with one
correction factor per rotation: the inner product of the turned vector and its own code
vector.  For a query q and a coded vector o, <q, code> / factor is an unbiased estimate
of <q, o>; its error stays within ``sqrt((1 - f^2) / (f^2 (d - 1)))`` times a few
standard deviations, less by the square root of the number of rotations averaged.  Only
pairs whose upper confidence bound reaches the threshold are recomputed exactly, in
double precision on the original vectors.

Candidates share at least one band of code bits.  The number of bits in a band grows
with the logarithm of the largest label, the number of bands follows from the wanted
miss probability of a pair right at the threshold.  A bucket with more than
``block_rows`` members is cut into blocks, and pairs of blocks are compared in
different tasks, so no task holds an unbounded bucket and no pair is dropped.

Exact copies are one class with a count; their links need no pairs.  A task returns no
pairs either: it adds up the links of each of its members and tells which of them belong
together, so what leaves it is linear in its members, however dense they lie.

Edge cases: a null label or id, or a vector that is null, empty, zero or holds a null or
non-finite component, links with nothing and is returned; vectors of different lengths
never link; repeated rows are copies of each other (with equal ids they count each
other), and rows with one id and different vectors are separate vectors; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, stash
from .graph import components
from .runs import by_run


def rotations(dims: int, count: int, seed: int) -> np.ndarray:
    """``count`` random orthogonal matrices, [count, dims, dims]."""
    rng = np.random.default_rng([seed, dims])
    out = np.empty((count, dims, dims))
    for i in range(count):
        q, r = np.linalg.qr(rng.standard_normal((dims, dims)))
        out[i] = q * np.sign(np.diag(r))
    return out


def band_shape(rows: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits in a band, bands) so that a pair at the threshold is missed with probability ``miss``."""
    bits = max(10, math.ceil(math.log2(max(rows, 2))) - 2)
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


class Codes:
    """Sign codes of unit vectors of one length."""

    def __init__(self, dims: int, bits: int, bands: int, seed: int):
        self.dims, self.bits, self.bands = dims, bits, bands
        self.turns = rotations(dims, -(-bits * bands // dims), seed)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signs [n, turns, dims] and factors [n, turns] (inner product with the own code vector)."""
        turned = np.einsum("nd,rde->nre", unit, self.turns)
        return turned >= 0, np.abs(turned).sum(axis=2) / math.sqrt(self.dims)

    def keys(self, signs: np.ndarray) -> np.ndarray:
        """Band keys [n, bands]."""
        flat = signs.reshape(len(signs), -1)[:, : self.bits * self.bands].reshape(len(signs), self.bands, self.bits)
        return flat @ (1 << np.arange(self.bits, dtype=np.int64))

    def estimate(self, unit: np.ndarray, signs: np.ndarray, factors: np.ndarray, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of unit @ coded.T, and their error bounds (per coded vector)."""
        turned = np.einsum("nd,rde->nre", unit, self.turns)
        code = np.where(signs, 1.0, -1.0) / math.sqrt(self.dims)
        each = np.einsum("nre,mre->rnm", turned, code, optimize=True) / factors.T[:, None, :]
        error = np.sqrt(np.maximum(1 - factors**2, 0) / (factors**2 * max(self.dims - 1, 1)))
        return each.mean(axis=0), sigmas * np.sqrt((error**2).sum(axis=1)) / factors.shape[1]


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # keeps squares in range
    return vectors / np.sqrt(np.einsum("nd,nd->n", vectors, vectors))[:, None]


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def usable(vector: str) -> F.Column:
    """Whether a vector takes part: not null, not empty, not all zero, every component finite."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0), F.lit(False))


def joined_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n points the smallest point that the edges (a, b) connect it with."""
    label = np.arange(n)
    while True:
        low, last = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(label, last[a], low)
        np.minimum.at(label, last[b], low)
        while (label != (label := label[label])).any():
            pass
        if (label == last).all():
            return label


def link_counts(
    classes: DataFrame, threshold: float, miss: float = 1e-7, sigmas: float = 5.0, block_rows: int = 1024, seed: int = 0
) -> DataFrame:
    """What tasks find of the links of ``classes`` (node, label, dims, vector, copies) with cosine >= threshold.

    Rows (node, n, other): n rows of other classes link with ``node``, to be summed over all rows, and
    ``other``, where not null, is reachable from it.
    """
    largest = classes.groupBy("label", "dims").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("n")).first()["n"]
    bits, bands = band_shape(largest, threshold, miss)
    made: dict[int, Codes] = {}

    def codes(dims: int) -> Codes:
        if dims not in made:
            made[dims] = Codes(dims, bits, bands, seed)
        return made[dims]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for dims in set(table.column("dims").to_pylist()):
                part = table.filter(pa.compute.equal(table.column("dims"), dims))
                for at in range(0, len(part), 2048):
                    some = part.slice(at, 2048).combine_chunks()
                    c = codes(dims)
                    keys = c.keys(c.encode(unit_rows(matrix(some.column("vector"), dims)))[0])
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [some.column(n).combine_chunks() for n in ("node", "label", "dims")] + [flat], ["node", "label", "dims", "keys"]
                    )

    label = classes.schema["label"].dataType.simpleString()
    placed = classes.select("node", "label", "dims", "vector").mapInArrow(keyed, f"node long, label {label}, dims int, keys array<long>")
    bucket = ["label", "dims", "band", "key"]
    members = stash(placed.select("node", "label", "dims", F.posexplode("keys").alias("band", "key")), "bands")
    shared = members.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # the blocks of a bucket: a member of block i meets those of every block j >= i
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    block = F.pmod(F.xxhash64("node"), blocks).cast("int")
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")),
    )
    at = lambda rows: rows.withColumn("__key", apart(F.col("key")))
    work = (
        at(members)
        .join(at(shared).drop("key"), ["label", "dims", "band", "__key"])
        .drop("__key")
        .withColumn("blocks", blocks)
        .withColumn("block", block)
        .select("node", *bucket, "block", F.explode(meets).alias("meet"))
        .select("node", *bucket, "block", "meet.i", "meet.j")
        .join(classes.select("node", "vector", "copies"), "node")
        .repartition(*bucket, "i", "j")
        .sortWithinPartitions(*bucket, "i", "j", "node")
    )
    group = [*bucket, "i", "j"]

    def compare(some: pa.Table) -> pa.RecordBatch | None:
        first = {c: some.column(c)[0].as_py() for c in group}
        c, node, side, copies = codes(first["dims"]), *(some.column(x).to_numpy() for x in ("node", "block", "copies"))
        unit = unit_rows(matrix(some.column("vector"), first["dims"]))
        left, right = side == first["i"], side == first["j"]
        signs, factors = c.encode(unit)
        keys = c.keys(signs)
        at, to = np.flatnonzero(left), np.flatnonzero(right)
        if not len(at) or not len(to):
            return None
        found = []
        for k in range(0, len(at), 256):
            rows = at[k : k + 256]
            guess, error = c.estimate(unit[rows], signs[to], factors[to], sigmas)
            x, y = np.nonzero(guess + error[None, :] >= threshold)
            a, b = rows[x], to[y]
            if first["i"] == first["j"]:
                a, b = a[a < b], b[a < b]
            # each pair once: in the first band that both share
            once = (keys[a] == keys[b]).argmax(axis=1) == first["band"]
            a, b = a[once], b[once]
            exact = np.einsum("nd,nd->n", unit[a], unit[b]) >= threshold
            found.append(np.stack([a[exact], b[exact]]))
        a, b = np.concatenate(found, axis=1)
        n = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
        linked = np.flatnonzero(n)
        other = joined_labels(len(node), a, b)[linked]
        columns = [pa.array(node[linked]), pa.array(n[linked].astype(np.int64)), pa.array(node[other], mask=other == linked)]
        return pa.RecordBatch.from_arrays(columns, ["node", "n", "other"]) if len(linked) else None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in by_run(batches, group):
            if (out := compare(some)) is not None:
                yield out

    return work.select("node", *group, "block", "vector", "copies").mapInArrow(counted, "node long, n long, other long")


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    **options: float,
) -> DataFrame:
    """Rows (id, n_links, component_id, kept).

    Compared are only vectors with equal labels that are not null.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    rows = rows.withColumn("takes_part", usable("vector") & F.col("label").isNotNull() & F.col("id").isNotNull())
    part = rows.where("takes_part")
    classes = part.groupBy("label", "vector").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = stash(classes.withColumns({"dims": F.size("vector"), "node": F.monotonically_increasing_id()}), "classes")
    told = stash(link_counts(classes, threshold, **options), "links")
    others = told.groupBy("node").agg(F.sum("n").alias("others"))
    known = components(told.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = known.join(classes.select("node", "first"), "node")
    named = named.join(named.groupBy("component").agg(F.min("first").alias("component_id")), "component").select("node", "component_id")
    nodes = (
        classes.join(others, "node", "left")
        .join(named, "node", "left")
        .select(
            "label",
            "vector",
            (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("component_id", "first").alias("component_id"),
        )
    )
    alone = rows.where("NOT takes_part").select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    out = part.join(nodes, ["label", "vector"]).select("id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
