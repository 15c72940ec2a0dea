"""The pair kernel: numpy over all pairs of one length class at a time.

Pairs are grouped by the lengths of their mates, so every stage is a handful of
operations on two-dimensional byte arrays; rows that are resolved leave the arrays.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

import numpy as np

from ..functions.errors import OverlapError
from ..functions.params import BaseTie, CorrectionParams, EngineConfig, MergeParams, OverlapParams, OverlapTie, ValidationPolicy

#: Status of a pair.
MERGED, PAIR, NO_OVERLAP, REJECTED, MISMATCH, FAILED = "merged", "pair", "no_overlap", "validation_rejected", "mate_mismatch", "error"
#: Largest quality that the correction tables tell apart, and largest they return.
TABLE_TOP, QUALITY_TOP = 41, 40


def byte_table(source: str, target: str) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[np.frombuffer(source.encode(), np.uint8)] = np.frombuffer(target.encode(), np.uint8)
    return table


_READ = byte_table("ACGTacgt", "TGCAtgca")
_UPPER = byte_table("ACGT", "TGCA")
_CODE = np.full(256, -1, dtype=np.int16)
_CODE[np.frombuffer(b"ACGTacgt", np.uint8)] = [0, 1, 2, 3, 0, 1, 2, 3]
#: Points of a k-mer by how often it was seen before.
_POINTS = np.array([4, 1, 0], np.int32)
_DEFINED = np.zeros(256, dtype=bool)
_DEFINED[np.frombuffer(b"ACGT", np.uint8)] = True
_ERROR = np.power(np.float32(10), -np.arange(256, dtype=np.float32) / np.float32(10)).astype(np.float32)


def correction_tables() -> tuple[np.ndarray, np.ndarray]:
    """Qualities of agreeing and of differing columns, [42, 42]; the second is indexed higher, lower."""
    e = 10.0 ** (-np.arange(TABLE_TOP + 1) / 10.0)
    x, y = e[:, None], e[None, :]
    agree = (x * y / 3) / ((1 - x) * (1 - y) + 4 * x * y / 3)
    differ = x * (1 - y / 3) / (x + y - 4 * x * y / 3)

    def quality(p: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.floor(-10 * np.log10(p))
        return np.clip(np.where(np.isfinite(score), score, 0), 0, QUALITY_TOP).astype(np.uint8)

    return quality(agree), quality(differ)


_AGREE, _DIFFER = correction_tables()


@dataclass
class Pairs:
    """Oriented pairs of one length class, and what the stages found for them."""

    a: np.ndarray
    qa: np.ndarray
    b: np.ndarray
    qb: np.ndarray
    status: np.ndarray = field(init=False)
    error: np.ndarray = field(init=False)
    length: np.ndarray = field(init=False)
    s1: np.ndarray = field(init=False)
    s2: np.ndarray = field(init=False)
    diff: np.ndarray = field(init=False)
    informative: np.ndarray = field(init=False)
    mismatches: np.ndarray = field(init=False)
    expected: np.ndarray = field(init=False)
    out: np.ndarray | None = None
    out_q: np.ndarray | None = None
    out_len: np.ndarray | None = None
    corrected: bool = False

    def __post_init__(self) -> None:
        n = len(self.a)
        self.status = np.full(n, PAIR, dtype=object)
        self.error = np.full(n, None, dtype=object)
        self.length, self.s1, self.s2, self.diff = (np.full(n, -1, np.int64) for _ in range(4))
        self.informative, self.mismatches = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.expected = np.full(n, np.nan)
        self.raw = (self.a, self.qa, self.b, self.qb)

    @classmethod
    def orient(cls, r1: np.ndarray, q1: np.ndarray, r2: np.ndarray, q2: np.ndarray) -> Pairs:
        """From bytes as sequenced: the reverse mate is reverse-complemented, qualities are decoded."""

        def decode(q: np.ndarray) -> np.ndarray:
            return np.where(q >= 33, q - np.minimum(q, 33), 0).astype(np.uint8)

        return cls(r1, decode(q1), np.ascontiguousarray(_READ[r2][:, ::-1]), np.ascontiguousarray(decode(q2)[:, ::-1]))

    def copy(self) -> Pairs:
        """The same reads with outcomes of their own."""
        out = copy.copy(self)
        for name in ("status", "error", "informative", "mismatches", "expected"):
            setattr(out, name, getattr(self, name).copy())
        return out

    @property
    def live(self) -> np.ndarray:
        return (self.status == PAIR) | (self.status == MERGED)

    def fail(self, rows: np.ndarray, kind: str) -> None:
        self.status[rows], self.error[rows] = FAILED, kind

    def columns(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions in a and in b of each row's overlap columns, where they are columns, and the width."""
        width = int(self.length[rows].max()) if len(rows) else 0
        j = np.arange(width)[None, :]
        inside = j < self.length[rows][:, None]
        at_a = np.where(inside, self.s1[rows][:, None] + j, 0)
        at_b = np.where(inside, self.s2[rows][:, None] + j, 0)
        return at_a, at_b, inside, np.arange(width)


def scan(left: np.ndarray, right: np.ndarray, params: OverlapParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First acceptable (offset into left, length, differences) of each row; -1 where none is.

    ``left`` slides against the start of ``right``.  The first 32 columns are compared for all rows, the
    others where these leave it open; rows that are resolved leave once they are a quarter.
    """
    n, l1, l2 = len(left), left.shape[1], right.shape[1]
    offset, length, diff = (np.full(n, -1, np.int64) for _ in range(3))
    rows, going = np.arange(n), np.ones(n, bool)
    for at in range(max(l1 - params.min_overlap, 0) + 1):
        size = min(l1 - at, l2)
        if size < params.min_overlap or not len(rows):
            break
        if size < params.min_comparisons:
            continue
        if not size:
            raise OverlapError("an overlap of no bases: min_overlap and min_comparisons are 0")
        most, head = params.allowed(size), min(32, size)
        d = (left[:, at : at + head] != right[:, :head]).view(np.uint8).sum(axis=1, dtype=np.uint8).astype(np.int64)
        near = np.flatnonzero((d <= most) & going)
        if head < size and len(near):
            d[near] += np.count_nonzero(left[near, at + head : at + size] != right[near, head:size], axis=1)
            near = near[d[near] <= most]
        if len(near):
            found = rows[near]
            offset[found], length[found], diff[found] = at, size, d[near]
            going[near] = False
            if np.count_nonzero(going) <= 0.75 * len(rows):
                left, right, rows = left[going], right[going], rows[going]
                going = np.ones(len(rows), bool)
    return offset, length, diff


def find_overlaps(p: Pairs, params: OverlapParams) -> None:
    fs, fn, fd = scan(p.a, p.b, params)
    es, en, ed = scan(p.b, p.a, params)
    start, end = fs >= 0, es >= 0
    more = (fn - 5 * fd) - (en - 5 * ed)
    tied = start & end & (more == 0)
    use_end = end & (~start | (more < 0))
    if params.tie is OverlapTie.FROM_END:
        use_end |= tied
    use_start = start & ~use_end
    p.length, p.diff = np.where(use_end, en, fn), np.where(use_end, ed, fd)
    p.s1, p.s2 = np.where(use_start, fs, np.where(use_end, 0, -1)), np.where(use_end, es, np.where(use_start, 0, -1))
    if params.tie is OverlapTie.REJECT:
        p.fail(tied, "overlap_tie")
        for x in (p.length, p.s1, p.s2, p.diff):
            x[tied] = -1
    p.status[~start & ~end] = NO_OVERLAP


def find_from_one_end(p: Pairs, params: OverlapParams, end: bool) -> None:
    """The first acceptable overlap of one direction alone: the reverse mate slides if ``end``, else the forward one."""
    start, p.length, p.diff = scan(p.b, p.a, params) if end else scan(p.a, p.b, params)
    none, zero = start < 0, np.where(start < 0, -1, 0)
    p.s1, p.s2 = (zero, start) if end else (start, zero)
    p.status[none] = NO_OVERLAP


def complexity_need(bases: np.ndarray, k: int, score: int) -> np.ndarray:
    """Bases from the start until k-mers (first sighting 4, second 1) score enough; the length + 1 if never.

    Rows leave as soon as they score enough, which most do within a few k-mers.
    """
    n, size = bases.shape
    if size < k:
        return np.full(n, size + 1)
    if k > 5:
        return _need_by_order(bases, k, score)
    need, rows, total, seen = np.full(n, size + 1), np.arange(n), np.zeros(n, np.int32), np.zeros((n, 4**k), np.uint8)
    powers = 4 ** np.arange(k - 1, -1, -1)
    for at in range(size - k + 1):
        letters = _CODE[bases[rows, at : at + k]]
        good = (letters >= 0).all(axis=1)
        code = np.where(good, letters @ powers, 0)
        before = seen[rows, code]
        total += np.where(good, _POINTS[before], 0)
        seen[rows, code] = np.where(good, np.minimum(before + 1, 2), before)
        done = good & (total >= score)
        if done.any():
            need[rows[done]] = at + k
            rows, total = rows[~done], total[~done]
            if not len(rows):
                break
    return need


def _need_by_order(bases: np.ndarray, k: int, score: int) -> np.ndarray:
    """The same for any k, with all k-mers of a row sorted at once."""
    size = bases.shape[1]
    each = _CODE[bases]
    code, bad = np.zeros((len(bases), size - k + 1), np.int64), np.zeros((len(bases), size - k + 1), bool)
    for j in range(k):
        part = each[:, j : j + size - k + 1]
        code, bad = code * 4 + np.maximum(part, 0), bad | (part < 0)
    code[bad] = -1
    order = np.argsort(code, axis=1, kind="stable")
    sorted_codes = np.take_along_axis(code, order, 1)
    index = np.broadcast_to(np.arange(code.shape[1]), code.shape)
    fresh = np.ones(code.shape, bool)
    fresh[:, 1:] = sorted_codes[:, 1:] != sorted_codes[:, :-1]
    seen = np.empty(code.shape, np.int64)
    np.put_along_axis(seen, order, index - np.maximum.accumulate(np.where(fresh, index, 0), axis=1), 1)
    total = np.cumsum(np.where(bad, 0, _POINTS[np.minimum(seen, 2)]), axis=1)
    enough = (total >= score) & ~bad
    return np.where(enough.any(axis=1), enough.argmax(axis=1) + k, size + 1)


def informative_length(a: np.ndarray, b: np.ndarray, k: int, score: int) -> np.ndarray:
    """Least overlap that is informative: the largest need of both reads from both ends, capped."""
    needs = [complexity_need(x, k, score) for x in (a, a[:, ::-1], b, b[:, ::-1])]
    return np.minimum(np.max(needs, axis=0), min(a.shape[1], b.shape[1]) + 1)


def summed_errors(bases: np.ndarray, quals: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Expected errors per row in 32-bit floats: eights are summed first, then what is left one by one."""
    each = np.where(_DEFINED[bases], _ERROR[quals], np.float32(1)).astype(np.float32)
    each[~inside] = 0
    sizes, total = inside.sum(axis=1), np.zeros(len(bases), np.float32)
    for c in range(bases.shape[1] // 8):
        lane = np.zeros(len(bases), np.float32)
        for j in range(8):
            lane = lane + each[:, c * 8 + j]
        total = np.where((c + 1) * 8 <= sizes, total + lane, total)
    for j in range(7):
        at = sizes // 8 * 8 + j
        more = at < sizes
        total = np.where(more, total + np.take_along_axis(each, np.where(more, at, 0)[:, None], 1)[:, 0], total)
    return total.astype(np.float32)


def validate(p: Pairs, policy: ValidationPolicy) -> None:
    rows = np.flatnonzero(p.live)
    if min(p.a.shape[1], p.b.shape[1]) < policy.k:
        p.fail(rows, "k_exceeds_read")
        return
    if not len(rows):
        return
    p.informative[rows] = informative_length(p.a[rows], p.b[rows], policy.k, policy.score)
    at_a, at_b, inside, _ = p.columns(rows)
    r = rows[:, None]
    wa, wb, va, vb = p.a[r, at_a], p.b[r, at_b], p.qa[r, at_a], p.qb[r, at_b]
    p.mismatches[rows] = ((wa != wb) & inside).sum(axis=1)
    p.expected[rows] = np.minimum(summed_errors(wa, va, inside), summed_errors(wb, vb, inside)).astype(np.float64)
    short = p.length[rows] < np.maximum(p.informative[rows], policy.floor)
    allowed = p.expected[rows] * float(np.float32(policy.times)) + float(np.float32(policy.plus))
    many = ~short & (p.mismatches[rows] > allowed)
    p.status[rows[short | many]] = REJECTED
    p.error[rows[short]] = "insufficient_overlap_length"
    p.error[rows[many]] = "excessive_mismatch_rate"


def _layout(p: Pairs, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions in a and b of each output base, and whether it is in the left part, the overlap, or any part."""
    end = p.s1[rows] + p.length[rows]
    size = end + p.b.shape[1] - (p.s2[rows] + p.length[rows])
    at = np.broadcast_to(np.arange(int(size.max()) if len(rows) else 0), (len(rows), int(size.max()) if len(rows) else 0))
    left, overlap = at < p.s1[rows][:, None], (at >= p.s1[rows][:, None]) & (at < end[:, None])
    at_b = at - p.s1[rows][:, None] + p.s2[rows][:, None]
    clip_b = np.clip(at_b, 0, p.b.shape[1] - 1)
    return np.minimum(at, p.a.shape[1] - 1), clip_b, left, overlap, size


def merge(p: Pairs, params: MergeParams) -> None:
    rows = np.flatnonzero(p.live)
    at_a, at_b, left, overlap, size = _layout(p, rows)
    r = rows[:, None]
    x, y, qx, qy = p.a[r, at_a], p.b[r, at_b], p.qa[r, at_a], p.qb[r, at_b]
    if p.corrected:  # both mates agree on corrected columns; the forward copy is used
        forward = left | overlap
        base, qual = np.where(forward, x, y), np.where(forward, qx, qy)
    else:
        tie = overlap & (qx == qy) & (x != y)
        use_a = left | (overlap & (qx >= qy))
        if params.tie is BaseTie.REVERSE:
            use_a &= ~tie
        elif params.tie is BaseTie.INTERIOR:
            near_a, near_b = np.minimum(at_a, p.a.shape[1] - 1 - at_a), np.minimum(at_b, p.b.shape[1] - 1 - at_b)
            use_a &= ~(tie & (near_a < near_b))
        base, qual = np.where(use_a, x, y), np.where(use_a, qx, qy)
        if params.tie is BaseTie.AMBIGUOUS:
            base = np.where(tie, np.uint8(ord("N")), base)
        elif params.tie is BaseTie.REJECT:
            p.fail(rows[tie.any(axis=1)], "base_disagreement")
    p.out = np.zeros((len(p.a), base.shape[1]), np.uint8)
    p.out_q = np.zeros_like(p.out)
    p.out[rows], p.out_q[rows] = base, qual
    p.out_len = np.full(len(p.a), -1, np.int64)
    p.out_len[rows] = size
    p.status[p.status == PAIR] = MERGED


def corrected_columns(
    x: np.ndarray, y: np.ndarray, qx: np.ndarray, qy: np.ndarray, params: CorrectionParams
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corrected bases and qualities, and where bases may change."""
    ix, iy = np.minimum(qx, TABLE_TOP), np.minimum(qy, TABLE_TOP)
    same = x == y
    qual = np.where(same, _AGREE[ix, iy], _DIFFER[np.maximum(ix, iy), np.minimum(ix, iy)])
    change = same | (np.abs(qx.astype(np.int16) - qy.astype(np.int16)) >= params.min_delta)
    return np.where(qx >= qy, x, y), np.minimum(qual, params.max_quality).astype(np.uint8), change & (not params.quality_only)


def correct(p: Pairs, params: CorrectionParams) -> None:
    """Correct both mates' overlap windows, and the consensus if there is one.  Validation state is dropped."""
    rows = np.flatnonzero(p.live)
    at_a, at_b, inside, _ = p.columns(rows)
    r = rows[:, None]
    a, qa, b, qb = (x.copy() for x in (p.a, p.qa, p.b, p.qb))
    base, qual, change = corrected_columns(p.a[r, at_a], p.b[r, at_b], p.qa[r, at_a], p.qb[r, at_b], params)
    i, j = np.nonzero(inside)
    row, xa, xb = rows[i], at_a[i, j], at_b[i, j]
    qa[row, xa] = qb[row, xb] = qual[i, j]
    if p.out is not None:
        p.out_q[row, xa] = qual[i, j]
    i, j = np.nonzero(inside & change)
    row, xa, xb = rows[i], at_a[i, j], at_b[i, j]
    a[row, xa] = b[row, xb] = base[i, j]
    if p.out is not None:
        p.out[row, xa] = base[i, j]
    p.a, p.qa, p.b, p.qb, p.corrected = a, qa, b, qb, True
    p.informative[rows], p.mismatches[rows], p.expected[rows] = -1, -1, np.nan


def encode(quals: np.ndarray) -> np.ndarray:
    return np.minimum(quals.astype(np.int16) + 33, 255).astype(np.uint8)


def reverse_mate(p: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """The reverse mate as sequenced: upper-case bases are complemented back."""
    return _UPPER[p.b][:, ::-1], encode(p.qb)[:, ::-1]


def named(step: str | tuple[str, object]) -> tuple[str, object]:
    """A step's name and its own parameters, if any."""
    return (step, None) if isinstance(step, str) else step


def check_spans(p: Pairs) -> None:
    """Every overlap that was found lies within both reads and has at least one column."""
    rows = p.length >= 0
    n, s1, s2, d = (x[rows] for x in (p.length, p.s1, p.s2, p.diff))
    inside = (n > 0) & (s1 >= 0) & (s2 >= 0) & (s1 + n <= p.a.shape[1]) & (s2 + n <= p.b.shape[1]) & (d >= 0) & (d <= n)
    if not inside.all():
        raise OverlapError("an overlap reaches beyond its reads")


def run(p: Pairs, config: EngineConfig, steps: tuple[str | tuple[str, object], ...]) -> None:
    """Run the steps; one without parameters of its own takes those of ``config``."""
    for step, own in map(named, steps):
        if step == "overlap":
            find_overlaps(p, own or config.overlap)
            check_spans(p)
        elif step in ("overlap_start", "overlap_end"):
            find_from_one_end(p, own or config.overlap, step == "overlap_end")
            check_spans(p)
        elif step == "informative":
            policy = own or config.validation or ValidationPolicy()
            p.informative = informative_length(p.a, p.b, policy.k, policy.score)
        elif step in ("need_head", "need_tail"):
            policy = own or config.validation or ValidationPolicy()
            p.informative = complexity_need(p.a if step == "need_head" else p.a[:, ::-1], policy.k, policy.score)
        elif step == "validate":
            validate(p, own or config.validation or ValidationPolicy())
        elif step == "merge":
            merge(p, own or config.merge)
        elif step == "correct":
            correct(p, own or config.correction or CorrectionParams())
        else:
            raise ValueError(step)
