"""Assembly of read pairs as one Arrow pass over a DataFrame.

The kernel handles pairs by length class, so a batch of mixed lengths costs one set of
array operations per class; reads are taken from Arrow's buffers as two-dimensional arrays
and results are put together as buffers, never row by row.  No shuffle: a pair is one row,
and everything happens where the row is.  ``status`` is ``merged``, ``pair``, ``no_overlap``, ``validation_rejected``,
``mate_mismatch`` or ``error``; ``reason`` says more.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

from ..functions import columns as C
from ..functions.errors import ERRORS, ConfigError, MatewiseError, PairingError, StageError
from ..functions.params import CorrectionParams, EngineConfig, MergeParams, OverlapParams, ValidationPolicy
from . import kernel as K

INT_COLUMNS = ("overlap_len", "r1_start", "r2_start", "diff", "min_informative", "mismatches")
RESULT = StructType(
    [
        StructField("status", StringType()),
        StructField("reason", StringType()),
        *[StructField(c, IntegerType()) for c in INT_COLUMNS],
        StructField("expected_errors", DoubleType()),
        StructField("seq", StringType()),
        StructField("qual", StringType()),
        StructField("r1_out", StringType()),
        StructField("q1_out", StringType()),
        StructField("r2_out", StringType()),
        StructField("q2_out", StringType()),
        StructField("avg_qual", DoubleType()),
        StructField("min_qual", IntegerType()),
        StructField("max_qual", IntegerType()),
    ]
)
ARROW_TYPES = {StringType(): pa.string(), IntegerType(): pa.int32(), DoubleType(): pa.float64()}
READS = ("r1_seq", "r1_qual", "r2_seq", "r2_qual")


def pairs_from(
    df: DataFrame,
    key: str | list[str],
    r1_seq: str = "r1_seq",
    r1_qual: str = "r1_qual",
    r2_seq: str = "r2_seq",
    r2_qual: str = "r2_qual",
    r1_name: str | None = None,
    r2_name: str | None = None,
) -> DataFrame:
    """Any DataFrame as pairs: the key columns, the four read columns, and ``mates_match``.

    With names given, mates match when their keys do; without, they always do.
    """
    keys = [key] if isinstance(key, str) else key
    same = C.same_mates(F.col(r1_name), F.col(r2_name)) if r1_name and r2_name else F.lit(True)
    reads = [F.col(c).alias(n) for c, n in zip((r1_seq, r1_qual, r2_seq, r2_qual), READS)]
    return df.select(*keys, *reads, F.coalesce(same, F.lit(False)).alias("mates_match"))


@dataclass
class Texts:
    """A string column as bytes: where each value starts and how long it is (one byte per Latin-1 character)."""

    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    null: np.ndarray
    odd: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        n = len(column)
        null, odd = column.is_null().to_numpy(zero_copy_only=False), np.zeros(n, bool)
        column = column.cast(pa.large_string())
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        if (data[ends[0] : ends[-1]] > 127).any():
            values = []
            for i, x in enumerate(column.to_pylist()):
                try:
                    values.append((x or "").encode("latin-1"))
                except UnicodeEncodeError:
                    values.append(b"")
                    odd[i] = True
            data, ends = np.frombuffer(b"".join(values), np.uint8), np.cumsum([0, *map(len, values)])
        return cls(data, ends[:-1], np.diff(ends), null, odd)

    def grid(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Rows of one length as [rows, width]; adjacent ones are a view."""
        first = self.starts[rows]
        if len(rows) and (np.diff(first) == width).all():
            return self.data[first[0] : first[0] + width * len(rows)].reshape(len(rows), width)
        return self.data[first[:, None] + np.arange(width)]


class Builder:
    """The result columns of a batch, filled class by class."""

    def __init__(self, n: int):
        self.n = n
        self.status, self.reason = np.full(n, None, object), np.full(n, None, object)
        self.ints = {c: np.full(n, -1, np.int64) for c in (*INT_COLUMNS, "min_qual", "max_qual")}
        self.doubles = {c: np.full(n, np.nan) for c in ("expected_errors", "avg_qual")}
        self.texts: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

    def put_text(self, name: str, rows: np.ndarray, grid: np.ndarray, sizes: np.ndarray) -> None:
        """Texts of the rows with sizes of 0 or more; others stay null."""
        some = sizes >= 0
        if some.all():
            self.texts.setdefault(name, []).append((rows, grid, sizes))
        elif some.any():
            self.texts.setdefault(name, []).append((rows[some], grid[some], sizes[some]))

    def _text(self, name: str) -> pa.Array:
        parts = self.texts.get(name)
        if not parts:
            return pa.nulls(self.n, pa.string())
        sizes, valid = np.zeros(self.n, np.int64), np.zeros(self.n, bool)
        for rows, _, some in parts:
            sizes[rows], valid[rows] = some, True
        ends = np.concatenate(([0], np.cumsum(sizes)))
        data = np.empty(int(ends[-1]), np.uint8)
        for rows, grid, some in parts:
            inside = np.arange(grid.shape[1]) < some[:, None]
            if len(parts) == 1 and (np.diff(rows) > 0).all():
                data = grid[inside]  # already in the order of the rows
            else:
                data[(ends[rows][:, None] + np.arange(grid.shape[1]))[inside]] = grid[inside]
        if (data > 127).any():
            raw = data.tobytes()
            return pa.array([raw[a:z].decode("latin-1") if v else None for a, z, v in zip(ends, ends[1:], valid)], pa.string())
        buffers = [pa.py_buffer(np.packbits(valid, bitorder="little")), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)]
        return pa.Array.from_buffers(pa.string(), self.n, buffers, int((~valid).sum()))

    def arrays(self) -> list[pa.Array]:
        out = []
        for f in RESULT.fields:
            if f.name in ("status", "reason"):
                out.append(pa.array(getattr(self, f.name), pa.string()))
            elif f.name in self.ints:
                out.append(pa.array(self.ints[f.name].astype(np.int32), mask=self.ints[f.name] < 0))
            elif f.name in self.doubles:
                out.append(pa.array(self.doubles[f.name], mask=np.isnan(self.doubles[f.name])))
            else:
                out.append(self._text(f.name))
        return out


Step = str | tuple[str, object]


def assemble_arrays(reads: list[pa.Array], match: pa.Array, config: EngineConfig, steps: tuple[Step, ...], mates: bool) -> list[pa.Array]:
    """Results of a batch, column by column as RESULT has them, in the order of the rows."""
    out = Builder(len(match))
    for rows, p in _oriented(reads, match, out):
        K.run(p, config, steps)
        _collect(p, rows, out, mates)
    return out.arrays()


def _oriented(reads: list[pa.Array], match: pa.Array, out: Builder) -> Iterator[tuple[np.ndarray, K.Pairs]]:
    """The pairs of a batch by length class, at most 8192 at a time; rows that can't be oriented get their status."""
    texts = [Texts.of(c) for c in reads]
    open_rows = np.ones(out.n, bool)

    def settle(where: np.ndarray, status: str, reason: str | None = None) -> None:
        rows = open_rows & where
        out.status[rows], out.reason[rows], open_rows[rows] = status, reason, False

    settle(~match.fill_null(False).to_numpy(zero_copy_only=False), K.MISMATCH)
    settle(np.any([t.null for t in texts], axis=0), K.FAILED, "null_read")
    settle(np.any([t.odd for t in texts], axis=0), K.FAILED, "not_bytes")
    one, two = texts[0].sizes, texts[2].sizes
    settle((one != texts[1].sizes) | (two != texts[3].sizes), K.FAILED, "sequence_quality_length")
    settle((one == 0) | (two == 0), K.NO_OVERLAP)
    rows = np.flatnonzero(open_rows)
    classes, which = np.unique((one[rows] << 32) | two[rows], return_inverse=True)
    order = np.argsort(which, kind="stable")
    for k, some in enumerate(np.split(rows[order], np.cumsum(np.bincount(which, minlength=len(classes)))[:-1]) if len(rows) else []):
        widths = [int(classes[k] >> 32)] * 2 + [int(classes[k] & 0xFFFFFFFF)] * 2
        for at in range(0, len(some), 8192):
            part = some[at : at + 8192]
            yield part, K.Pairs.orient(*(t.grid(part, w) for t, w in zip(texts, widths)))


def _collect(p: K.Pairs, rows: np.ndarray, out: Builder, mates: bool) -> None:
    out.status[rows], out.reason[rows] = p.status, p.error
    for name, values in zip(INT_COLUMNS, (p.length, p.s1, p.s2, p.diff, p.informative, p.mismatches)):
        out.ints[name][rows] = values
    out.doubles["expected_errors"][rows] = p.expected
    if p.out is not None:
        sizes = np.where(p.status == K.MERGED, p.out_len, -1)
        out.put_text("seq", rows, p.out, sizes)
        out.put_text("qual", rows, K.encode(p.out_q), sizes)
        inside = np.arange(p.out_q.shape[1]) < sizes[:, None]
        merged = sizes > 0
        total = (p.out_q * inside).sum(axis=1, dtype=np.int32)
        out.doubles["avg_qual"][rows] = np.where(merged, total / np.maximum(sizes, 1), np.nan)
        out.ints["min_qual"][rows] = np.where(merged, np.where(inside, p.out_q, 255).min(axis=1, initial=255), -1)
        out.ints["max_qual"][rows] = np.where(merged, (p.out_q * inside).max(axis=1, initial=0), -1)
    elif mates:
        seq2, qual2 = K.reverse_mate(p)
        for name, grid in (("r1_out", p.a), ("q1_out", K.encode(p.qa)), ("r2_out", seq2), ("q2_out", qual2)):
            out.put_text(name, rows, grid, np.where(p.live, grid.shape[1], -1))


def run_steps(pairs: DataFrame, config: EngineConfig, steps: tuple[Step, ...], seen: Accumulator | None = None) -> DataFrame:
    """Run the kernel over ``pairs`` (:func:`pairs_from`): its columns, then those of RESULT.

    A step is a name, with the parameters that ``config`` has for it, or a name and parameters of its own.
    ``seen`` gets the numbers of pairs by status, as tasks end.
    """
    mates = "merge" not in [K.named(x)[0] for x in steps]
    names = pairs.columns
    at = [names.index(c) for c in (*READS, "mates_match")]
    schema = StructType([*pairs.schema.fields, *RESULT.fields])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *reads, match = (batch.column(i) for i in at)
            arrays = assemble_arrays(reads, match, config, steps, mates)
            if seen is not None:
                seen.add(Counter(arrays[0].to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*names, *(f.name for f in RESULT.fields)])

    return pairs.mapInArrow(go, schema)


def assemble(pairs: DataFrame, config: EngineConfig = EngineConfig(), seen: Accumulator | None = None) -> DataFrame:
    """The batch chain: overlap, validate, merge, correct, as ``config`` has them."""
    return run_steps(pairs, config, config.steps(), seen)


def compare(pairs: DataFrame, configs: dict[str, EngineConfig]) -> DataFrame:
    """Outcomes of several configurations in one pass: the key columns, config, status, reason.

    Reads are oriented once and each kind of overlap search runs once, whatever the number
    of configurations; a pair that passes has the status ``merged``.
    """
    keys = [c for c in pairs.columns if c not in (*READS, "mates_match")]
    at = [pairs.columns.index(c) for c in (*READS, "mates_match")]
    schema = StructType(
        [*(pairs.schema[c] for c in keys), *(StructField(c, StringType()) for c in ("config", "status", "reason"))]
    )

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *reads, match = (batch.column(i) for i in at)
            common = Builder(len(match))
            found = {name: [np.full(len(match), None, object) for _ in range(2)] for name in configs}
            for rows, p in _oriented(reads, match, common):
                searched: dict[OverlapParams, K.Pairs] = {}
                for name, config in configs.items():
                    if config.overlap not in searched:
                        searched[config.overlap] = p.copy()
                        K.run(searched[config.overlap], config, ("overlap",))
                    one = searched[config.overlap].copy()
                    if config.validation is not None:
                        K.run(one, config, ("validate",))
                    found[name][0][rows] = np.where(one.status == K.PAIR, K.MERGED, one.status)
                    found[name][1][rows] = one.error
            for name, (status, reason) in found.items():
                settled = np.not_equal(common.status, None)
                status[settled], reason[settled] = common.status[settled], common.reason[settled]
                arrays = [batch.column(batch.schema.get_field_index(c)) for c in keys]
                arrays += [pa.array([name] * len(match), pa.string()), pa.array(status, pa.string()), pa.array(reason, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, [*keys, "config", "status", "reason"])

    return pairs.mapInArrow(go, schema)


@dataclass(frozen=True)
class PairFlow:
    """Stages one after another, checked when they are named, run in one pass.

    Legal orders: overlap first; validate after overlap, merge or correction (once, again
    after a correction); merge and correct once each after overlap, in either order.
    Correction drops validation.  A stage's own parameters hold for that stage alone; without
    any it takes those of ``config``.
    """

    pairs: DataFrame
    config: EngineConfig = EngineConfig()
    steps: tuple[tuple[str, object], ...] = ()
    validated: bool = False

    @property
    def stages(self) -> tuple[str, ...]:
        return tuple(name for name, _ in self.steps)

    def _next(self, step: str, validated: bool, params: object) -> PairFlow:
        return replace(self, steps=(*self.steps, (step, params)), validated=validated)

    def _need(self, ok: bool, what: str) -> None:
        if not ok:
            raise StageError(f"{what} after {self.stages or 'no stage'}")

    def find_overlap(self, params: OverlapParams | None = None) -> PairFlow:
        self._need(not self.steps, "find_overlap")
        return self._next("overlap", False, params)

    def validate(self, policy: ValidationPolicy | None = None) -> PairFlow:
        self._need("overlap" in self.stages and not self.validated, "validate")
        return self._next("validate", True, policy)

    def merge(self, params: MergeParams | None = None) -> PairFlow:
        self._need("overlap" in self.stages and "merge" not in self.stages, "merge")
        return self._next("merge", self.validated, params)

    def correct(self, params: CorrectionParams | None = None) -> PairFlow:
        self._need("overlap" in self.stages and "correct" not in self.stages, "correct")
        return self._next("correct", False, params)

    def and_then_found(self, more: Callable[[PairFlow], PairFlow]) -> PairFlow:
        """Go on with the pairs that overlap; the others keep their outcome, as after every stage."""
        self._need("overlap" in self.stages, "and_then_found")
        return more(self)

    def process(self) -> PairFlow:
        """The rest of the whole chain: overlap, validate, merge, correct."""
        self._need(not self.steps, "process")
        return self.find_overlap().and_then_found(lambda f: f.validate().merge().correct())

    def result(self, on_error: str = "column") -> DataFrame:
        """All rows with their outcome; ``on_error="fail"`` ends the job at the first failed pair."""
        self._need(bool(self.steps), "result")
        if on_error not in ("column", "fail"):
            raise ConfigError("on_error must be column or fail")
        out = run_steps(self.pairs, self.config, self.steps)
        return raise_on_error(out) if on_error == "fail" else out

    def inspect(self, seen: Callable[[DataFrame], object], found: bool = True) -> PairFlow:
        """Hand the rows that overlap (or those that don't) to ``seen``, and go on."""
        seen(self.found() if found else self.no_overlap())
        return self

    @staticmethod
    def is_found() -> Column:
        return F.col("overlap_len").isNotNull()

    @staticmethod
    def is_no_overlap() -> Column:
        return F.col("status") == K.NO_OVERLAP

    def found(self) -> DataFrame:
        return self.result().where(self.is_found())

    def no_overlap(self) -> DataFrame:
        return self.result().where(self.is_no_overlap())

    def valid(self) -> Column:
        """Whether a row passed the validation this flow holds."""
        self._need(self.validated, "valid")
        return F.col("status").isin(K.PAIR, K.MERGED)

    def metrics(self) -> DataFrame:
        """The measures of the validation this flow holds, with both error rates, of every pair that overlaps."""
        self._need(self.validated, "metrics")
        keys = [c for c in self.pairs.columns if c not in (*READS, "mates_match")]
        n = F.col("overlap_len")
        return self.found().select(
            *keys, "overlap_len", "min_informative", "mismatches", "expected_errors",
            (F.col("mismatches") / n).alias("observed_rate"), (F.col("expected_errors") / n).alias("expected_rate"),
        )

    def reads(self) -> DataFrame:
        """Merged reads: key columns, seq, qual."""
        self._need("merge" in self.stages, "reads")
        keys = [c for c in self.pairs.columns if c not in (*READS, "mates_match")]
        return self.result().where(F.col("status") == K.MERGED).select(*keys, "seq", "qual")

    def corrected_pairs(self) -> DataFrame:
        """Corrected mates as sequenced."""
        self._need("correct" in self.stages and "merge" not in self.stages, "corrected_pairs")
        keys = [c for c in self.pairs.columns if c not in (*READS, "mates_match")]
        return self.result().where(F.col("status") == K.PAIR).select(*keys, "r1_out", "q1_out", "r2_out", "q2_out")


def raise_on_error(result: DataFrame) -> DataFrame:
    """Fail the job at the first row whose status is an error (``on_error="fail"``)."""
    checked = F.when(F.col("status") == K.FAILED, F.raise_error(F.concat(F.lit("pair failed: "), F.col("reason")))).otherwise(F.col("status"))
    return result.withColumn("status", checked)


@dataclass(frozen=True)
class Read:
    """One read outside a DataFrame."""

    id: str
    seq: str
    qual: str


@dataclass(frozen=True)
class Assembler:
    """The chain for records in hand, in batches through the same kernel; for tables use :func:`assemble`."""

    config: EngineConfig = EngineConfig()

    def process_pair(self, one: Read, two: Read) -> Read | None:
        """The merged read, or None where there is no overlap; anything else is an error."""
        found = next(self.process_iter([(one, two)]))
        if isinstance(found, MatewiseError):
            raise found
        return found

    def process_iter(self, pairs: Iterable[tuple[Read, Read]], batch: int = 1024) -> Iterator[Read | MatewiseError | None]:
        """For each pair in order its merged read, None, or its error, for the caller to raise or to skip."""
        return self.process_iter_with(pairs, self.config.steps(), batch)

    def process_iter_with(
        self, pairs: Iterable[tuple[Read, Read]], steps: tuple[Step, ...], batch: int = 1024
    ) -> Iterator[Read | tuple[Read, Read] | MatewiseError | None]:
        """The same for any steps; without a merge among them both mates come back."""
        merged, held = "merge" in [K.named(x)[0] for x in steps], []
        for pair in pairs:
            held.append(pair)
            if len(held) == batch:
                yield from self._run(held, steps, merged)
                held = []
        if held:
            yield from self._run(held, steps, merged)

    def _run(self, pairs: list[tuple[Read, Read]], steps: tuple[Step, ...], merged: bool) -> Iterator[object]:
        reads = [pa.array([getattr(p[k], c) for p in pairs], pa.string()) for k in (0, 1) for c in ("seq", "qual")]
        match = pa.array([one.id == two.id for one, two in pairs], pa.bool_())
        rows = pa.Table.from_arrays(assemble_arrays(reads, match, self.config, steps, not merged), [f.name for f in RESULT.fields]).to_pylist()
        for (one, two), r in zip(pairs, rows):
            if r["status"] == K.NO_OVERLAP:
                yield None
            elif r["status"] in (K.MERGED, K.PAIR):
                yield Read(one.id, r["seq"], r["qual"]) if merged else (Read(one.id, r["r1_out"], r["q1_out"]), Read(two.id, r["r2_out"], r["q2_out"]))
            elif r["status"] == K.MISMATCH:
                yield PairingError(f"unmatched ids: {one.id} and {two.id}")
            else:
                yield ERRORS.get(r["reason"], MatewiseError)(f"pair {one.id}: {r['reason']}")
