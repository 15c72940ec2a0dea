"""Near-duplicates of texts and vectors, and nearest neighbours, against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matewise.llm import catalogue, graph, neardup, nndescent, vectorlinks
from matewise.llm.runs import give_back, lean

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def roots(ids, linked):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out: list[str | None] = [None, "", "  \t", "one", "One", "a b c d", "a b c d e", "a b c d e f", "x\x85y z é É w"]
    base = [word() for _ in range(60)]
    for n in range(40):  # a chain and a cloud of near copies
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(60)] = word()
        out.append(" ".join(copy))
        if n % 8 == 0:
            base[rng.randrange(60)] = word()
    passage = " ".join(word() for _ in range(50))
    out += [" ".join(word() for _ in range(20)) + " " + passage for _ in range(30)]
    out += [" ".join(word() for _ in range(5000)), out[12], out[12].upper(), out[12]]
    return out


def test_near_duplicates_equal_all_pairs(spark):
    docs = list(enumerate(texts()))
    sets = {i: plain_set(t) for i, t in docs}
    linked = [
        (i, j)
        for i, a in sets.items()
        for j, b in sets.items()
        if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b)
    ]
    want = roots(sets, linked)
    frame = spark.createDataFrame([(i, t, i, "x") for i, t in docs], "doc_id long, text string, component_id long, kept string")
    got = {r["id"]: r for r in neardup.near_duplicates(frame, block_rows=8).collect()}
    assert len(got) == len(docs)
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), want[i], want[i] == i)


def test_near_duplicates_edge_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["id"] or 0, r["n_shingles"], r["kept"]) for r in got) == [(0, 2, True), (1, 2, True), (1, 2, True), (2, 0, True)]
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_duplicates_where_ids_repeat_or_are_no_numbers(spark):
    one, two, far = "a b c d e f g h", "p q r s t u v w", "k l m n o p"
    rows = [("x", one), ("x", two), ("y", one + " "), ("a", two), ("x", far), ("x", far), ("z", None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    want = [("x", 4, "x"), ("x", 4, "a"), ("y", 4, "x"), ("a", 4, "a"), ("x", 2, "x"), ("x", 2, "x"), ("z", 0, "z")]
    assert sorted((r["id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(want)
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got)


def test_sketches_merge_and_estimate():
    sketch, rng = neardup.SetSketch(), np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:])
    regs = sketch.registers([a, b, np.unique(np.concatenate([a, b])), np.empty(0, np.uint64), a[:1]])
    assert (np.maximum(regs[0], regs[1]) == regs[2]).all() and not regs[3].any() and (regs[4] > 0).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    found = sketch.similarity(*[np.array([x]) for x in ((regs[0] > regs[1]).sum(), (regs[0] < regs[1]).sum(), len(a), len(b))])[0]
    assert abs(found - true) < 0.12


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (200, 150), (150, 160)] + [(300, 300 + k) for k in range(1, 30)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    rng = np.random.default_rng(4)
    rows, center = [], rng.standard_normal(24)
    for i in range(150):
        v = center + rng.standard_normal(24) * 0.12 if i % 3 == 0 else rng.standard_normal(24)
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 2))
    rows += [(200, rows[0][1], 0), (201, [2 * x for x in rows[0][1]], 0), (202, rows[0][1], None)]
    rows += [(203, None, 0), (204, [0.0] * 24, 0), (205, [float("nan")] + [1.0] * 23, 0), (206, [], 0), (207, [1.0, 2.0], 0), (208, [2.0, 4.0], 0)]
    return rows


def usable(v):
    return bool(v) and all(np.isfinite(v)) and any(v)


def cosine(a, b):
    return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))


def test_vector_links_equal_all_pairs(spark):
    rows = vectors()
    ok = [r for r in rows if r[2] is not None and usable(r[1])]
    linked = [(a[0], b[0]) for a in ok for b in ok if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= 0.98]
    want = roots([r[0] for r in rows], linked)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = {r["id"]: r for r in vectorlinks.near_duplicates(frame, block_rows=16).collect()}
    assert len(got) == len(rows) and linked
    for i in want:
        assert got[i]["n_links"] == sum(i in p for p in linked), i
        assert (got[i]["component_id"], got[i]["kept"]) == (want[i], want[i] == i)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectorlinks.near_duplicates(empty).count() == 0


def test_vector_links_where_ids_repeat(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    near = lambda v: [x + 0.01 for x in v]
    rows = [(1, a, 0), (1, b, 0), (2, near(a), 0), (3, near(b), 0), (None, a, 0), (4, a, None), (5, [0.5, None, 0.1], 0)]
    got = vectorlinks.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    key = lambda r: (r["id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"])
    assert sorted(map(key, got)) == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True), (5, 0, 5, True)]


def test_dense_vectors_give_no_rows_per_pair(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in 1 + rng.standard_normal(16) * 0.01], 0) for i in range(200)]
    frame = spark.createDataFrame(rows, "node long, vector array<double>, label int").withColumns({"dims": F.lit(16), "copies": F.lit(1).cast("long")})
    told = vectorlinks.link_counts(frame, 0.98, block_rows=64)
    assert told.groupBy("node").agg(F.sum("n").alias("n")).where("n = 199").count() == 200
    assert told.count() < 200 * 60  # a row per member and group of work


def test_joined_labels():
    rng = np.random.default_rng(2)
    for n, k in ((1, 0), (50, 10), (50, 40), (300, 299)):
        a, b = rng.integers(0, n, k), rng.integers(0, n, k)
        want = roots(range(n), list(zip(a.tolist(), b.tolist())))
        assert vectorlinks.joined_labels(n, a, b).tolist() == [want[i] for i in range(n)]
    chain = np.arange(999)
    assert not vectorlinks.joined_labels(1000, chain, chain + 1).any()


def test_rotation_codes_estimate_within_their_bounds():
    rng = np.random.default_rng(1)
    unit = vectorlinks.unit_rows(rng.standard_normal((80, 64)))
    codes = vectorlinks.Codes(64, 14, 30, 0)
    signs, factors = codes.encode(unit)
    guess, error = codes.estimate(unit, signs, factors, 5.0)
    assert (np.abs(guess - unit @ unit.T) <= error[None, :] + 1e-9).mean() > 0.999
    assert abs((guess - unit @ unit.T).mean()) < 0.01


def test_neighbours_are_found(spark):
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    shape = nndescent.Shape(neighbours=8, sample=6, trees=2, bucket=32, iterations=3, seeds=16, beam=48, expand=16)
    got: dict[int, list] = {}
    for r in nndescent.nearest(frame, F.col("vec_id") % 10 == 0, 5, shape).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ok, hits, total = [r for r in rows if usable(r[1]) and len(r[1]) == 24], 0, 0
    for q in (r for r in ok if r[0] % 10 == 0):
        best = sorted(((-cosine(q[1], r[1]), r[0]) for r in ok if r[0] != q[0]))[:5]
        assert len(got[q[0]]) == 5
        assert [s for _, s in got[q[0]]] == sorted((s for _, s in got[q[0]]), reverse=True)
        hits += len({i for _, i in best} & {i for i, _ in got[q[0]]})
        total += 5
    assert hits / total >= 0.9
    clashing = frame.withColumns({"rank": F.lit("x"), "score": F.lit("y"), "node": F.lit(None)})
    again = nndescent.nearest(clashing.repartition(3), F.col("vec_id") % 10 == 0, 5, shape).select("query_id", "rank", "vec_id", "score")
    assert again.count() == sum(map(len, got.values()))
    few = nndescent.nearest(frame.where("vec_id >= 207"), F.lit(True), 5).collect()
    assert {(r["query_id"], r["vec_id"]) for r in few} == {(207, 208), (208, 207)}
    assert nndescent.nearest(frame.limit(0), F.lit(True), 5).count() == 0


def test_the_registered_search_against_brute_force(spark):
    """Recall of the production parameters over the largest given table."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ok = [(r["vec_id"], r["embedding"]) for r in table if usable(r["embedding"])]
    ids, unit = np.array([i for i, _ in ok]), np.array([np.array(v) / np.linalg.norm(v) for _, v in ok])
    got: dict[int, list] = {}
    for r in catalogue.op7_nn_descent_search(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
    hits = total = 0
    for k in np.flatnonzero(ids % 50 == 0):
        sims = unit @ unit[k]
        sims[k] = -9
        best = sorted(zip(-sims, ids))[:5]
        mine = got[int(ids[k])]
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(r["score"] == pytest.approx(float(unit[np.flatnonzero(ids == r["vec_id"])[0]] @ unit[k]), abs=1e-12) for r in mine)
        hits, total = hits + len({i for _, i in best} & {r["vec_id"] for r in mine}), total + 5
    assert set(got) == set(ids[ids % 50 == 0].tolist()) and hits / total >= 0.95


def test_ties_go_to_the_smallest_ids_in_any_row_order(spark):
    rng = np.random.default_rng(6)
    copied = [float(x) for x in rng.standard_normal(16).astype(np.float32)]
    rows = [(i, copied) for i in range(300)] + [(i, [float(x) for x in rng.standard_normal(16).astype(np.float32)]) for i in range(300, 400)]
    rows += [(7, copied), (400, [2 * x for x in copied])]
    order = rng.permutation(len(rows))
    frame = spark.createDataFrame([rows[i] for i in order], "vec_id long, embedding array<float>")
    shape = nndescent.Shape(neighbours=8, sample=6, trees=2, bucket=32, iterations=3, seeds=16, beam=48, expand=16)
    got: dict[int, list] = {}
    for r in nndescent.nearest(frame, F.col("vec_id") % 50 == 0, 5, shape).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got[0] == [1, 2, 3, 4, 5] and set(got) == set(range(0, 401, 50))
    assert all(got[q] == [0, 1, 2, 3, 4] for q in (50, 100, 150, 200, 250, 400))
    seven = nndescent.nearest(frame, F.col("vec_id") == 7, 9, shape).orderBy("rank").collect()
    assert [r["vec_id"] for r in seven] == sorted([*range(9)] * 2)


def test_a_hot_node_is_split_in_the_join_with_its_minimum(spark, tmp_path):
    """A third of all edges at one node: no task of the join gets more than twice an even share of it."""
    edges = spark.range(0, 900_000, 1, 12).select(F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("u"), F.xxhash64("id").alias("v"))
    edges.write.parquet(str(tmp_path / "edges"))
    edges = spark.read.option("maxPartitionBytes", "1m").parquet(str(tmp_path / "edges"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "300KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "300KB",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        sizes = {}
        for name, joined in (("apart", graph.meet(edges, low)), ("plain", edges.join(low, "u"))):
            parts = joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "m").cast("double")).alias("s"))
            sizes[name] = [r["n"] for r in parts.collect()]
        assert sum(sizes["apart"]) == sum(sizes["plain"]) == 900_000
        assert max(sizes["plain"]) > 300_000 > 2 * 900_000 / 8 >= max(sizes["apart"])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rows_without_an_id_are_the_last_among_ties(spark):
    rows = [(0, [1.0, 0.0]), (None, [0.5, 0.5]), (7, [1.0, 1.0]), (3, [2.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nndescent.nearest(frame, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [3, 7, None]


def test_a_lean_pass_gives_its_memory_back():
    """Freed blocks below one that is still held stay with the allocator of C unless it is told to return them."""
    held = []

    def resident() -> int:
        return int(open("/proc/self/statm").read().split()[1]) * 4096

    def make(batches):
        for batch in batches:
            blocks = [bytearray(b"x" * 100_000) for _ in range(2_000)]
            held.append(blocks[-1])
            del blocks
            yield batch

    batch = pa.RecordBatch.from_arrays([pa.array([1])], ["a"])
    list(make(iter([batch])))
    before = resident()
    kept = before - (give_back() or resident())
    held.clear()
    start = resident()
    assert list(lean(make)(iter([batch, batch]))) == [batch, batch]
    assert kept > 100 << 20 and resident() - start < 50 << 20
