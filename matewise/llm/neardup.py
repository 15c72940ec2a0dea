"""MinHash near-duplicates with SetSketch registers.

A document's shingle set becomes ``m`` registers: register i holds the truncated
logarithm, to a base close to 1, of the smallest of the exponential values that the
set's elements draw for it.  Sketches of unions are element-wise maxima, and two sets
agree in a register with a probability close to their Jaccard similarity, so bands of
registers are a locality-sensitive hash.  For a candidate pair the counts of registers
that are larger, smaller and equal give a joint maximum-likelihood estimate of the
similarity; pairs that could reach the threshold are verified on their full sets.

The values of an element are the points of a Poisson process dealt to the registers, so
points beyond a bound that fills every register need not be drawn.

Only the components of the link graph are returned, so a bucket of g sets that are all
alike needs g - 1 comparisons with its leader.  What remains are buckets whose members
are in different components; there every pair of sets from different components is
compared, in blocks of bounded size and without emitting pairs that the estimate rules
out.  No bucket is capped and no pair dropped.

Edge cases: null and empty texts have an empty set, link with nothing and are their own
component; equal sets are one class; a null id links with nothing and is returned as its own
component; rows that repeat an id are separate documents, each with the component of its own
text; ids are of any type with an order; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_BATCH_BYTES, apart, discard
from .common import stash as stashed
from .graph import components
from .runs import by_run, lean

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Batches of texts and sets are small, as many steps run one after the other in the same workers."""
    return stashed(df, label, SMALL_BATCH_BYTES)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    A-Z are lower-cased; words are what stands between space and the characters 9 to 13.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    size = min(words, len(parts))
    n = len(parts) - size + 1
    out = np.full(n, (size * 0x2545F4914F6CDD1D) & (2**64 - 1), np.uint64)
    for j in range(size):
        out += mixed(h[j : j + n] + np.uint64(int(_ODD[j % 5]) * (j + 1) % 2**64)) * _ODD[j % 5]
    return np.unique(mixed(out))


class SetSketch:
    """Registers of sets: ``m`` of them, base ``b``, rate ``a``, 16 bits each."""

    def __init__(self, bands: int = 48, rows: int = 4, b: float = 1.001, a: float = 20.0):
        self.bands, self.rows, self.m, self.b, self.a, self.top = bands, rows, bands * rows, b, a, 65535

    def registers(self, sets: list[np.ndarray]) -> np.ndarray:
        """[n, m] uint16; rows of empty sets are 0."""
        out = np.zeros((len(sets), self.m), np.uint16)
        todo = np.array([i for i, s in enumerate(sets) if len(s)], dtype=np.int64)
        reach = math.log(self.m) + 3
        while len(todo):
            some = [sets[i] for i in todo]
            self._draw(out, todo, some, reach)
            todo = todo[(out[todo] == 0).any(axis=1)]
            reach *= 2
        return out

    def _draw(self, out: np.ndarray, rows: np.ndarray, sets: list[np.ndarray], reach: float) -> None:
        sizes = np.array([len(s) for s in sets])
        element = np.concatenate(sets)
        row = np.repeat(rows, sizes)
        bound = np.repeat(reach / (self.a * sizes), sizes)
        x, step, flat = np.zeros(len(element)), 0, out.reshape(-1)
        while len(element):
            step += 1
            h = mixed(element + np.uint64((step * 0x9E3779B97F4A7C15) & (2**64 - 1)))
            x -= np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (self.a * self.m)
            keep = x <= bound
            element, row, bound, x, h = element[keep], row[keep], bound[keep], x[keep], h[keep]
            value = np.clip(np.floor(1 - np.log(x) / math.log(self.b)), 1, self.top).astype(np.uint16)
            register = mixed(h ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(self.m)
            np.maximum.at(flat, row * self.m + register.astype(np.int64), value)

    def band_keys(self, registers: np.ndarray) -> np.ndarray:
        """[n, bands] int64; a key names its band too."""
        groups = registers.reshape(len(registers), self.bands, self.rows).astype(np.uint64)
        keys = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64) * _ODD[0], groups.shape[:2]).copy()
        for j in range(self.rows):
            keys = mixed(keys ^ (groups[:, :, j] * _ODD[1 + j % 4]))
        return keys.view(np.int64)

    def similarity(self, greater: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Maximum-likelihood Jaccard similarity from register comparisons and known set sizes."""
        u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
        most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
        equal = self.m - greater - less

        def p(x: np.ndarray) -> np.ndarray:
            return np.maximum(-np.log1p(-x * (self.b - 1) / self.b) / math.log(self.b), 1e-12)

        def likelihood(j: np.ndarray) -> np.ndarray:
            more, fewer = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
            return greater * np.log(more) + less * np.log(fewer) + equal * np.log(np.maximum(1 - more - fewer, 1e-12))

        low, high, golden = np.zeros(len(u)), most.astype(np.float64), (math.sqrt(5) - 1) / 2
        for _ in range(30):
            x, y = high - golden * (high - low), low + golden * (high - low)
            right = likelihood(x) < likelihood(y)
            low, high = np.where(right, x, low), np.where(right, high, y)
        return (low + high) / 2


class Threshold:
    """A link holds when 100 * |A & B| >= percent * |A | B|."""

    def __init__(self, percent: int, sketch: SetSketch, sigmas: float = 6.0):
        self.percent = percent
        j = percent / 100
        self.least = j - sigmas * math.sqrt(j * (1 - j) / sketch.m)

    def possible(self, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        return 100 * np.minimum(n_a, n_b) >= self.percent * np.maximum(n_a, n_b)

    def holds(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= self.percent * (len(a) + len(b) - both)


def unpack(column: pa.Array, dtype: str) -> np.ndarray:
    """Equal-length binary values as a matrix."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(values.to_pylist()), dtype=dtype).reshape(len(values), -1)


def sketches(docs: DataFrame, sketch: SetSketch, words: int, batch_elements: int = 300_000) -> DataFrame:
    """(id, place, n, print, registers) of every row of ``docs`` (id, place, text)."""
    id_type = docs.schema["id"].dataType.simpleString()
    names = ["id", "place", "n", "print", "registers"]

    @lean
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, held, first = [], 0, 0

            def done(upto: int) -> pa.RecordBatch:
                regs = sketch.registers(sets)
                prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                columns = [batch.column(k).slice(first, upto - first) for k in range(2)]
                columns += [pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary())]
                return pa.RecordBatch.from_arrays([*columns, pa.array([r.tobytes() for r in regs], pa.binary())], names)

            for i, text in enumerate(batch.column(2)):
                sets.append(shingles(text.as_py(), words))
                held += len(sets[-1])
                if held > batch_elements:
                    yield done(i + 1)
                    sets, held, first = [], 0, i + 1
            if sets:
                yield done(len(batch))

    return docs.select("id", "place", "text").mapInArrow(make, f"id {id_type}, place long, n long, print binary, registers binary")


def full_sets(docs: DataFrame, wanted: DataFrame, words: int, bits: int = 23) -> DataFrame:
    """(node, set) for ``wanted`` (node, place), from the whole texts of ``docs`` (place, text).

    A bit map of fixed size, built by aggregation and broadcast, first drops the documents that
    are surely not wanted, so their texts reach neither Python nor a shuffle; the join decides.
    """
    spot = F.pmod("place", F.lit(1 << bits))
    at, bit = F.shiftright(spot, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int")).alias("bit")
    marks = wanted.select(at, bit).groupBy("at").agg(F.bit_or("bit").alias("bits"))  # 2 ** (bits - 6) rows at most
    some = docs.select("place", "text", at, bit).join(F.broadcast(marks), "at").where(F.col("bit").bitwiseAND(F.col("bits")) != 0)

    @lean
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task makes the set of a text once, however many copies it meets
        for batch in batches:
            first = [p not in seen and not seen.add(p) for p in batch.column(0).to_pylist()]
            batch = batch.filter(pa.array(first, pa.bool_()))
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                sets = [shingles(t.as_py(), words).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["place", "set"])

    made = some.select("place", "text").mapInArrow(make, "place long, set binary")
    return made.join(wanted, "place").select("node", "set").dropDuplicates(["node"])


def near_duplicates(
    docs: DataFrame,
    percent: int = 75,
    words: int = 5,
    sketch: SetSketch | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_rows: int = 1024,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept, place (a hash of the text) and sole.

    ``sole`` holds for one id and text of each component, one with the component's id.
    """
    sketch = sketch or SetSketch()
    limit = Threshold(percent, sketch)
    # equal texts share a place, so one document of a class stands for all at its place
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("place"), F.col(text_col).alias("text"))
    drawn = stash(sketches(docs, sketch, words), "sketches")
    usable = (F.col("n") > 0) & F.col("id").isNotNull()
    grouped = drawn.where(usable).groupBy("print").agg(
        F.min(F.struct("id", "place")).alias("first"), F.any_value("n").alias("n"), F.any_value("registers").alias("registers")
    )
    nodes = grouped.select("print", "first", "first.place", "n", "registers", F.monotonically_increasing_id().alias("node"))
    nodes = stash(nodes, "nodes")
    wide, drawn = drawn, stash(drawn.drop("registers"), "rows")
    discard(wide)

    @lean
    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = sketch.band_keys(unpack(batch.column(1), "<u2"))
            flat = [pa.array(np.repeat(batch.column(0).to_numpy(), sketch.bands)), pa.array(keys.ravel())]
            yield pa.RecordBatch.from_arrays(flat, ["node", "key"])

    banded_rows = nodes.select("node", "registers").mapInArrow(banded, "node long, key long")
    leaders = banded_rows.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last"))
    shared = leaders.where("leader < last").select(apart(F.col("key")).alias("at"), "leader")
    members = stash(banded_rows.withColumn("at", apart(F.col("key"))).join(shared, "at").select("key", "leader", "node"), "bands")

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that the estimate doesn't rule out."""
        known = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a"))
        other = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("r_b"))
        near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
        joined = pairs.join(known, "a").join(other, "b").where(near).select("a", "b", "n_a", "n_b", "r_a", "r_b")

        @lean
        def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                r_a, r_b = unpack(batch.column(4), "<u2"), unpack(batch.column(5), "<u2")
                found = sketch.similarity((r_a > r_b).sum(axis=1), (r_a < r_b).sum(axis=1), batch.column(2).to_numpy(), batch.column(3).to_numpy())
                hit = pa.array(found >= limit.least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit), batch.column(1).filter(hit)], ["a", "b"])

        return joined.mapInArrow(estimate, "a long, b long")

    def placed(wanted: DataFrame) -> DataFrame:
        return stash(wanted.distinct().join(nodes.select("node", "place"), "node"), "wanted")

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs that hold on their full sets."""
        pairs = stash(pairs, "pairs")
        wanted = placed(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))))
        sets = stash(full_sets(docs, wanted, words), "sets")
        joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("s_a")), "a").join(
            sets.select(F.col("node").alias("b"), F.col("set").alias("s_b")), "b"
        )

        @lean
        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = [
                    limit.holds(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
                    for x, y in zip(batch.column(2), batch.column(3))
                ]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(hit, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

        out = stash(joined.select("a", "b", "s_a", "s_b").mapInArrow(compare, "a long, b long"), "links")
        discard(pairs, wanted, sets)
        return out

    def labelled(links: DataFrame) -> DataFrame:
        """``members`` of buckets that still hold more than one component, with comp."""
        known = components(links)
        rows = members.join(known, "node", "left").select("key", "leader", "node", F.coalesce("component", "node").alias("comp"))
        mixed_keys = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("size"))
        open_keys = mixed_keys.where("low < high").select(apart(F.col("key")).alias("at"), "size")
        lead = known.select(F.col("node").alias("leader"), F.col("component").alias("lead_comp"))
        rows = rows.withColumn("at", apart(F.col("key"))).join(open_keys, "at").drop("at").join(lead, "leader", "left")
        return stash(rows.withColumn("lead_comp", F.coalesce("lead_comp", "leader")), "open")

    # 1. every set against the smallest of its buckets' leaders; 2. against the other leaders
    first = members.where("leader < node").groupBy("node").agg(F.min("leader").alias("a")).select("a", F.col("node").alias("b"))
    links = verified(likely(first))
    rest = labelled(links)
    second = rest.where("comp <> lead_comp").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = links.unionByName(verified(likely(second)))
    discard(rest)
    # 3. what is left: sets of different components that share a bucket
    rest = labelled(links)
    wanted = placed(rest.select("node"))
    crossing, read = cross_pairs(rest, nodes, full_sets(docs, wanted, words), sketch, limit, block_rows)
    links = links.unionByName(verified(crossing.distinct()))
    known = components(links)
    discard(rest, members, wanted, *read)
    named = nodes.select("print", "node", "first").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first").alias("smallest"))
    named = stash(named.join(smallest, "component").select("print", "smallest"), "named")
    discard(nodes)
    out = drawn.select("id", "place", "n", "print").join(named, "print", "left")
    own = F.when(usable, F.col("smallest.id")).otherwise(F.col("id"))
    sole = ~usable | ((F.col("id") == F.col("smallest.id")) & (F.col("place") == F.col("smallest.place")))
    return out.select("id", F.col("n").alias("n_shingles"), own.alias("component_id"), "place", sole.alias("sole")).select(
        "id", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "place", "sole"
    )


def cross_pairs(
    rows: DataFrame, nodes: DataFrame, sets: DataFrame, sketch: SetSketch, limit: Threshold, block_rows: int
) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs of one bucket (key) in different components (comp) that hold on 32-bit sets, give or take a percent.

    A bucket is cut into blocks by hash; each pair of blocks is one group of work, streamed
    from a sorted partition.  Within it, equal registers are counted for all pairs at once;
    pairs that the joint estimate leaves open are compared on their sets, in the first band
    they share, so only near certain links leave the task.  Also returned are the stashed
    frames that the result reads.
    """
    blocks = F.ceil(F.col("size") / block_rows).cast("int")
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j"))
    )

    @lean
    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = [np.unique(np.frombuffer(x.as_buffer(), np.uint64).astype(np.uint32)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(small, pa.binary())], ["node", "set"])

    known = stash(nodes.select("node", "n", "registers").join(sets.mapInArrow(narrow, "node long, set binary"), "node"), "open-sets")
    work = (
        rows.withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .select("node", "comp", "key", "block", F.explode(meets).alias("meet"))
        .select("node", "comp", "key", "block", "meet.i", "meet.j")
        .join(known, "node")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j", "node")
        .select("key", "i", "j", "block", "node", "comp", "n", "registers", "set")
    )

    def compare(some: pa.Table) -> pa.RecordBatch:
        block, node, comp, n = (some.column(c).to_numpy() for c in ("block", "node", "comp", "n"))
        i, j, key = (some.column(c)[0].as_py() for c in ("i", "j", "key"))
        regs = unpack(some.column("registers"), "<u2")
        band = int(np.flatnonzero(sketch.band_keys(regs[:1])[0] == key)[0])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        columns, held = np.ascontiguousarray(regs[right].T), some.column("set")

        def in_both(p: int, q: int) -> tuple[int, int]:
            """Elements that two sets share, and the sum of their sizes."""
            s, t = (np.frombuffer(held[k].as_buffer(), np.uint32) for k in (p, q))
            return int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum()), len(s) + len(t)

        found: list[tuple[int, int]] = []
        for at in range(0, len(left), 128):
            rows = left[at : at + 128]
            equal = np.zeros((len(rows), len(right)), np.uint16)
            for r in range(sketch.m):
                equal += regs[rows, r][:, None] == columns[r][None, :]
            near = (equal >= sketch.m * (limit.least - 0.1)) & (comp[rows][:, None] != comp[right][None, :])
            if i == j:
                near &= rows[:, None] < right[None, :]
            x, y = np.nonzero(near)
            a, b = rows[x], right[y]
            fits = limit.possible(n[a], n[b])
            a, b = a[fits], b[fits]
            for k in range(0, len(a), 4096):
                c, d = a[k : k + 4096], b[k : k + 4096]
                more, less = regs[c] > regs[d], regs[c] < regs[d]
                same = ~(more | less).reshape(len(c), sketch.bands, sketch.rows).any(axis=2)
                likely = sketch.similarity(more.sum(axis=1), less.sum(axis=1), n[c], n[d]) >= limit.least
                pick = (same.argmax(axis=1) == band) & likely
                for p, q in zip(c[pick].tolist(), d[pick].tolist()):
                    both, sizes = in_both(p, q)
                    if 100 * both >= (limit.percent - 1) * (sizes - both):
                        found.append((p, q))
        pairs = node[np.array(found, np.int64).reshape(-1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["a", "b"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in by_run(batches, ["key", "i", "j"]):
            yield compare(some)

    return work.mapInArrow(run, "a long, b long"), [known]
