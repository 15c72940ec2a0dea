"""Approximate nearest neighbours by NN-descent and greedy graph search.

The neighbour graph starts from random-hyperplane buckets and is improved by NN-descent:
in each iteration a node's sampled new and old neighbours, in both directions, are
joined to their vectors, compared with each other, and any that beat a member's worst
neighbour are proposed to it.  Neighbours of neighbours are thus found by joins alone.

A query starts from a fixed sample of seed nodes and their neighbours, which are broadcast
(``seeds`` rows of at most twice ``neighbours`` codes), so no node is asked by every query.
It then repeatedly expands its best unexpanded nodes.  Requests travel to the node's row,
which carries its neighbours' codes; only candidates that beat the query's bound travel back.
The search ends when nothing within the beam is unexpanded; finished queries are set aside.
What was found is scored again on the original vectors in double precision.

Graph and search are over distinct directions: rows whose unit vectors are equal are one
class, which keeps its k + 1 smallest ids.  Classes are expanded after the exact scoring, so
equal scores go to the smallest ids, however many copies there are and however rows lie.

Vectors travel as 8-bit codes with a scale.  All rows are indexed; the bounds are the
documented parameters: neighbours per node, sampled members per node and iteration,
seeds, and beam width.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components
take no part, as query or candidate; vectors of different lengths are separate indexes;
repeated rows are separate candidates; a row without an id is a candidate, the last among ties; a query with fewer candidates than asked gets
them all; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, discard, stash
from .runs import by_run
from .vectorlinks import matrix, unit_rows, usable


@dataclass(frozen=True)
class Shape:
    """Parameters of the index and the search."""

    neighbours: int = 20
    sample: int = 10
    trees: int = 4
    bucket: int = 512
    iterations: int = 3
    seeds: int = 256
    beam: int = 512
    expand: int = 192
    recheck: int = 64
    seed: int = 0


def pack_codes(unit: np.ndarray) -> list[bytes]:
    """8-bit codes: a float32 scale, then one signed byte per component."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return [s.tobytes() + c.tobytes() for s, c in zip(scale.astype("<f4"), codes)]


def read_codes(values: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    raw = np.frombuffer(b"".join(values.to_pylist()), np.uint8).reshape(-1, dims + 4)
    return raw[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view("<f4")


def best(rows: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each group."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def first_graph(nodes: DataFrame, n: int, dims: int, shape: Shape) -> DataFrame:
    """(node, nbr, sim) from the buckets of ``trees`` sets of random hyperplanes."""
    bits = max(0, math.ceil(math.log2(max(1, 2 * n / shape.bucket))))
    planes = np.random.default_rng([shape.seed, dims]).standard_normal((dims, shape.trees * max(1, bits)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = (read_codes(batch.column(1), dims) @ planes >= 0).reshape(len(batch), shape.trees, -1)[:, :, :bits]
            codes = signs @ (1 << np.arange(bits, dtype=np.int64)) * shape.trees + np.arange(shape.trees)
            flat = pa.array(np.repeat(batch.column(0).to_numpy(), shape.trees))
            yield pa.RecordBatch.from_arrays([flat, pa.array(codes.astype(np.int64).ravel())], ["node", "bucket"])

    placed = stash(nodes.select("node", "code").mapInArrow(place, "node long, bucket long"), "buckets")
    sizes = placed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / shape.bucket).alias("parts"))
    work = (
        placed.withColumn("at", apart(F.col("bucket")))
        .join(sizes.select(apart(F.col("bucket")).alias("at"), "parts"), "at")
        .select("node", "bucket", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"))
        .join(nodes.select("node", "code"), "node")
        .repartition("bucket", "part")
        .sortWithinPartitions("bucket", "part", "node")
        .select("bucket", "part", "node", "code")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in by_run(batches, ["bucket", "part"]):
            node, unit = run.column("node").to_numpy(), read_codes(run.column("code"), dims)
            k = min(shape.neighbours, len(node) - 1)
            if not k:
                continue
            sim = unit @ unit.T
            np.fill_diagonal(sim, -9)
            top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(node, k)), pa.array(node[top].ravel()), pa.array(np.take_along_axis(sim, top, 1).ravel())],
                ["node", "nbr", "sim"],
            )

    found = work.mapInArrow(compare, "node long, nbr long, sim float").groupBy("node", "nbr").agg(F.max("sim").alias("sim"))
    return best(found, "node", shape.neighbours, F.desc("sim"), F.asc("nbr"))


def descend(graph: DataFrame, nodes: DataFrame, dims: int, shape: Shape, turn: int) -> DataFrame:
    """One NN-descent iteration over (node, nbr, sim, new)."""
    by_node = graph.repartition("node")
    order = Window.partitionBy("node", "new").orderBy(F.xxhash64(F.lit(turn), "node", "nbr"))
    aged = by_node.withColumn("taken", F.row_number().over(order) <= shape.sample)
    taken = aged.where("taken")
    forward = taken.select(F.col("node").alias("center"), F.col("nbr").alias("member"), "new")
    turned = taken.select(F.col("nbr").alias("center"), F.col("node").alias("member"), "new")
    limit = Window.partitionBy("center", "new").orderBy(F.xxhash64(F.lit(turn), "member"))
    turned = turned.withColumn("r", F.row_number().over(limit)).where(F.col("r") <= shape.sample).drop("r")
    members = forward.unionByName(turned)
    worst = by_node.groupBy("node").agg(
        F.when(F.count(F.lit(1)) >= shape.neighbours, F.min("sim")).otherwise(F.lit(-9.0).cast("float")).alias("worst")
    )
    known = nodes.select("node", "code").join(worst, "node", "left").withColumnRenamed("node", "member")
    work = (
        members.join(known, "member")
        .repartition("center")
        .sortWithinPartitions("center", "member", F.desc("new"))
        .select("center", "member", "new", "code", F.coalesce("worst", F.lit(-9.0).cast("float")).alias("worst"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in by_run(batches, ["center"]):
            member = run.column("member").to_numpy()
            once = np.flatnonzero(np.concatenate(([True], member[1:] != member[:-1])))  # new before old
            new = run.column("new").to_numpy(zero_copy_only=False)[once]
            if len(new) < 2 or not new.any():
                continue
            member, worst = member[once], run.column("worst").to_numpy()[once]
            unit = read_codes(run.column("code"), dims)[once]
            sim = unit @ unit.T
            np.fill_diagonal(sim, -9)
            sim[np.ix_(~new, ~new)] = -9
            a, b = np.nonzero(sim > np.maximum(worst, -8)[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(member[a]), pa.array(member[b]), pa.array(sim[a, b])], ["node", "nbr", "sim"])

    proposals = work.mapInArrow(compare, "node long, nbr long, sim float").withColumn("new", F.lit(True))
    kept = aged.select("node", "nbr", "sim", (F.col("new") & ~F.col("taken")).alias("new"))
    merged = kept.unionByName(proposals).repartition("node").groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    return best(merged, "node", shape.neighbours, F.desc("sim"), F.asc("nbr"))


def build(nodes: DataFrame, n: int, dims: int, shape: Shape) -> DataFrame:
    """The neighbour graph (node, nbr, sim)."""
    graph = stash(first_graph(nodes, n, dims, shape).withColumn("new", F.lit(True)), "graph")
    for turn in range(shape.iterations):
        last, graph = graph, stash(descend(graph, nodes, dims, shape, turn), "graph")
        discard(last)
    return graph.drop("new")


BEAM = "q long, code binary, ids array<long>, sims array<float>, done array<boolean>, open int, kind int"


def _lists(values: np.ndarray, ends: list[int], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _beams(rows: list[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Beams (q, code, ids, sims, done) as a batch of the BEAM schema."""
    ends = np.cumsum([0, *(len(r[2]) for r in rows)]).tolist()
    ids, sims, done = (np.concatenate([r[k] for r in rows]) if rows else np.empty(0) for k in (2, 3, 4))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.binary()),
            _lists(ids.astype(np.int64), ends, pa.int64()),
            _lists(sims.astype(np.float32), ends, pa.float32()),
            _lists(done.astype(bool), ends, pa.bool_()),
            pa.array([int((~r[4]).sum()) for r in rows], pa.int32()),
            pa.array(np.zeros(len(rows), np.int32)),
        ],
        ["q", "code", "ids", "sims", "done", "open", "kind"],
    )


def search(queries: DataFrame, graph: DataFrame, nodes: DataFrame, dims: int, shape: Shape, keep: int) -> DataFrame:
    """(q, node, sim): the ``keep`` best of the beam of every query of ``queries`` (q, code).

    A beam is one row per query, best first.  A round sends its best unexpanded nodes as
    requests to the nodes' rows (one shuffle) and takes what they answer back into the
    beam (one more).
    """
    spark = nodes.sparkSession
    back = best(
        graph.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "sim"), "node", shape.neighbours, F.desc("sim"), F.asc("nbr")
    )
    pairs = graph.select("node", "nbr").unionByName(back.select("node", "nbr")).distinct()
    rows = (
        pairs.join(nodes.select(F.col("node").alias("nbr"), "code"), "nbr")
        .groupBy("node")
        .agg(F.collect_list(F.struct("nbr", "code")).alias("near"))
        .select("node", F.col("near.nbr").alias("nbrs"), F.col("near.code").alias("codes"))
    )
    rows = stash(rows, "adjacency").repartition("node").persist(StorageLevel.MEMORY_AND_DISK)
    seeds = nodes.orderBy(F.xxhash64(F.lit("seed"), "node"), "node").limit(shape.seeds).select("node", "code")
    around = rows.join(F.broadcast(seeds.select("node")), "node").select(F.explode(F.arrays_zip("nbrs", "codes")).alias("x"))
    start = seeds.select("node", "code", F.lit(True).alias("seed")).unionByName(
        around.select(F.col("x.nbrs").alias("node"), F.col("x.codes").alias("code"), F.lit(False).alias("seed"))
    )
    start = start.groupBy("node").agg(F.any_value("code").alias("code"), F.max("seed").alias("seed")).toArrow()
    shared = spark.sparkContext.broadcast(
        (start.column(0).to_numpy(), read_codes(start.column(1), dims), start.column(2).to_numpy())
    )

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit, expanded = shared.value
        expanded = expanded.astype(bool)
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                out = []
                for q, code, sims in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), read_codes(some.column(1), dims) @ unit.T):
                    near = np.argpartition(-sims, shape.beam)[: shape.beam] if len(sims) > shape.beam else np.arange(len(sims))
                    order = near[np.lexsort((ids[near], -sims[near]))]
                    out.append((q, code, ids[order], sims[order], expanded[order]))
                yield _beams(out)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, code, ids, sims, done in zip(*(batch.column(k).to_pylist() for k in range(5))):
                nodes_asked = [i for i, d in zip(ids, done) if not d][: shape.expand]
                bound = sims[-1] if len(ids) >= shape.beam else -9.0
                n = len(nodes_asked)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q] * n, pa.int64()), pa.array([code] * n, pa.binary()), pa.array([bound] * n, pa.float32()), pa.array(nodes_asked, pa.int64())],
                    ["q", "code", "bound", "node"],
                )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            near, ids, codes = read_codes(batch.column(1), dims), batch.column(3), batch.column(4)
            sizes = np.diff(ids.offsets.to_numpy())
            which = np.repeat(np.arange(len(batch)), sizes)
            sim = np.einsum("nd,nd->n", read_codes(codes.flatten(), dims), near[which])
            hit = sim > batch.column(2).to_numpy()[which]
            ends = np.concatenate(([0], np.cumsum(np.bincount(which[hit], minlength=len(batch))))).tolist()
            n, found = len(batch), int(hit.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.nulls(n, pa.binary()),
                    _lists(ids.flatten().to_numpy()[hit], ends, pa.int64()),
                    _lists(sim[hit].astype(np.float32), ends, pa.float32()),
                    _lists(np.zeros(found, bool), ends, pa.bool_()),
                    pa.array(np.zeros(n, np.int32)),
                    pa.array(np.ones(n, np.int32)),
                ],
                ["q", "code", "ids", "sims", "done", "open", "kind"],
            )

    def take_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for run in by_run(batches, ["q"]):
            q, code = run.column("q")[0].as_py(), run.column("code")[0].as_py()
            ids, sims, done = (run.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("ids", "sims", "done"))
            own = len(run.column("ids")[0])
            done = done.astype(bool).copy()
            done[np.flatnonzero(~done[:own])[: shape.expand]] = True
            ids, first = np.unique(ids, return_index=True)  # the beam's own entry comes first
            sims, done = sims[first], done[first]
            order = np.lexsort((ids, -sims))[: shape.beam]
            out.append((q, code, ids[order], sims[order], done[order]))
            if len(out) >= 256:
                yield _beams(out)
                out = []
        if out:
            yield _beams(out)

    found = None
    state = stash(queries.select("q", "code").mapInArrow(begin, BEAM), "beam")
    while True:
        now = state.agg(F.count_if(F.col("open") > 0).alias("going"), F.count_if(F.col("open") == 0).alias("done")).first()
        if now["done"] or not now["going"]:
            done = state.where("open = 0").select("q", *[F.slice(c, 1, keep).alias(c) for c in ("ids", "sims")])
            done = stash(done, "found")
            found = done if found is None else found.unionByName(done)
        if not now["going"]:
            break
        going = state.where("open > 0")
        asked = going.mapInArrow(ask, "q long, code binary, bound float, node long")
        answers = asked.join(rows, "node").select("q", "code", "bound", "nbrs", "codes").mapInArrow(answer, BEAM)
        merged = going.unionByName(answers).repartition("q").sortWithinPartitions("q", "kind")
        last, state = state, stash(merged.mapInArrow(take_back, BEAM), "beam")
        discard(last)
    rows.unpersist()
    discard(state)
    return found.select("q", F.explode(F.arrays_zip("ids", "sims")).alias("x")).select("q", F.col("x.ids").alias("node"), F.col("x.sims").alias("sim"))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    shape: Shape = Shape(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each query row, without its own."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), is_query.alias("is_query"))
    rows = rows.where(usable("vector")).withColumn("dims", F.size("vector"))
    rows = stash(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    found = None
    for dims in sorted(r["dims"] for r in rows.select("dims").distinct().collect()):
        some = _nearest(rows.where(F.col("dims") == dims), dims, k, shape)
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    return found


def classes(rows: DataFrame, dims: int, k: int) -> tuple[DataFrame, DataFrame]:
    """The distinct directions (print, node, asked, members, vector, code), and the rows (row, id, is_query, print)."""
    id_type = rows.schema["id"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = unit_rows(matrix(batch.column(3), dims)) + 0.0 if len(batch) else np.empty((0, dims))  # no negative zeros
            prints = [hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in unit]
            codes = pack_codes(unit) if len(batch) else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(prints, pa.binary()), pa.array(codes, pa.binary())], ["row", "id", "is_query", "print", "code"]
            )

    schema = f"row long, id {id_type}, is_query boolean, print binary, code binary"
    coded = stash(rows.select("row", "id", "is_query", "vector").mapInArrow(code, schema), "codes")
    first = coded.groupBy("print").agg(F.min("row").alias("node"), F.max("is_query").alias("asked"))
    members = best(coded.select("print", "id", "row"), "print", k + 1, F.asc_nulls_last("id"), F.asc("row"))
    members = members.groupBy("print").agg(F.collect_list(F.struct("id", "row")).alias("members"))
    kept = coded.select(F.col("row").alias("node"), "code").join(rows.select(F.col("row").alias("node"), "vector"), "node")
    return stash(first.join(members, "print").join(kept, "node"), "classes"), coded.drop("code")


def _nearest(rows: DataFrame, dims: int, k: int, shape: Shape) -> DataFrame:
    nodes, coded = classes(rows, dims, k)
    queries = nodes.where("asked").select(F.col("node").alias("q"), "code")
    keep = max(shape.recheck, 4 * k) + 1  # the query itself may be among them
    beam = search(queries, build(nodes, nodes.count(), dims, shape), nodes, dims, shape, keep).where("q <> node").select("q", "node")
    beam = beam.unionByName(queries.select("q", F.col("q").alias("node")))  # the query's own copies
    pairs = (
        beam.join(nodes.select("node", F.col("vector").alias("v"), "members"), "node")
        .join(nodes.select(F.col("node").alias("q"), "print", F.col("vector").alias("w")), "q")
        .select("print", "members", "v", "w")
    )
    id_type = rows.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact = np.einsum("nd,nd->n", unit_rows(matrix(batch.column(2), dims)), unit_rows(matrix(batch.column(3), dims))) if len(batch) else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(exact, pa.float64())], ["print", "members", "score"])

    scored = pairs.mapInArrow(score, f"print binary, members array<struct<id:{id_type},row:bigint>>, score double")
    each = scored.select("print", "score", F.explode("members").alias("m")).select("print", "score", "m.id", "m.row")
    # one more than asked, as a query's own row is among them
    w = Window.partitionBy("print").orderBy(F.desc("score"), F.asc_nulls_last("id"), F.asc("row"))
    top = each.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k + 1)
    top = top.groupBy("print").agg(F.array_sort(F.collect_list(F.struct("place", "id", "row", "score"))).alias("top"))
    told = coded.where("is_query").select("print", "row", F.col("id").alias("query_id")).join(top, "print")
    others = F.slice(F.filter("top", lambda x: x["row"] != F.col("row")), 1, k)
    return told.select("query_id", F.posexplode(others).alias("place", "x")).select(
        "query_id", (F.col("place") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score")
    )
