"""The kernel against a plain scalar version, and against the relational forms."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matewise.functions.errors import ConfigError, OverlapError, PairingError, RecordError, StageError, ValidationError
from matewise.functions.params import (
    BaseTie,
    CorrectionParams,
    EngineConfig,
    MergeParams,
    OverlapParams,
    OverlapTie,
    ValidationPolicy,
)
from matewise.operators import kernel as K
from matewise.operators import relational as R
from matewise.operators.assembly import RESULT, Assembler, PairFlow, Read, assemble, assemble_arrays, pairs_from, raise_on_error

COMP = str.maketrans("ACGTacgt", "TGCAtgca")


def rc(s: str) -> str:
    return s.translate(COMP)[::-1]


def plain_overlap(r1: str, r2: str, p: OverlapParams):
    """The longest way round: every offset of both directions in turn."""
    a, b = r1, rc(r2)

    def first(x, y):
        for o in range(max(len(x) - p.min_overlap, 0) + 1):
            n = min(len(x) - o, len(y))
            if n < p.min_overlap:
                return None
            d = sum(c != e for c, e in zip(x[o : o + n], y[:n]))
            if n >= p.min_comparisons and d <= p.allowed(n):
                return o, n, d
        return None

    s, e = first(a, b), first(b, a)
    if s and e:
        ss, se = s[1] - 5 * s[2], e[1] - 5 * e[2]
        if ss == se and p.tie is OverlapTie.REJECT:
            return "tie"
        use_end = se > ss or (se == ss and p.tie is OverlapTie.FROM_END)
    else:
        use_end = s is None
    hit = e if use_end else s
    return None if hit is None else (hit[1], 0 if use_end else hit[0], hit[0] if use_end else 0, hit[2])


def columns(reads, config, steps, mates):
    arrays = assemble_arrays([pa.array(x, pa.string()) for x in reads], pa.array([True] * len(reads[0])), config, steps, mates)
    return {f.name: x.to_pylist() for f, x in zip(RESULT.fields, arrays)}


def outcome(r1, r2, q1=None, q2=None, config=None, steps=("overlap",)):
    reads = [[r1], [q1 or "I" * len(r1)], [r2], [q2 or "I" * len(r2)]]
    out = columns(reads, config or EngineConfig(), steps, "merge" not in steps)
    return {k: v[0] for k, v in out.items()}


def found(o):
    return None if o["overlap_len"] is None else (o["overlap_len"], o["r1_start"], o["r2_start"], o["diff"])


CASES = [
    ("GGGGACGT", "ACGT", OverlapParams(0, 4, 0.0, 4), True),
    ("GGGGACGT", "ACGTA", OverlapParams(0, 5, 0.0, 4), False),
    ("ACGTACGT", "TCGTACGT", OverlapParams(1, 7, 0.2, 8), True),
    ("ACGTACGT", "TCGTACGT", OverlapParams(0, 7, 0.0, 8), False),
    ("ACGT", "ACGT", OverlapParams(0, 4, 0.0, 5), False),
    ("ACGTACGT", "ACGTACGTAAAA", OverlapParams(2, 4, 0.2, 4), True),
    ("A" * 12, "C" * 12, OverlapParams(0, 6, 0.0, 6), False),
]


@pytest.mark.parametrize("r1,r2,params,expected", CASES)
def test_overlap_cases(r1, r2, params, expected):
    o = outcome(r1, r2, config=EngineConfig(params))
    assert (found(o) is not None) is expected
    assert found(o) == plain_overlap(r1, r2, params)


def test_first_acceptable_wins_not_best():
    longer = outcome("ACGTACGTACAC", rc("GTATGTACACGT"), config=EngineConfig(OverlapParams(5, 4, 0.2, 4)))
    assert found(longer) == (10, 2, 0, 1)
    exact = outcome("ACGTACGTGGAC", rc("GGACGTACGTGG"), config=EngineConfig(OverlapParams(5, 4, 0.2, 4)))
    assert found(exact) == (10, 0, 2, 0)


def test_offset_zero_ties_and_the_policy_decides():
    r = "ACGTACGT"
    params = OverlapParams(5, 3, 0.2, 3)
    assert found(outcome(r, r, config=EngineConfig(params)))[0] == 8
    o = outcome(r, r, config=EngineConfig(OverlapParams(5, 3, 0.2, 3, OverlapTie.REJECT)))
    assert (o["status"], o["reason"], o["overlap_len"]) == ("error", "overlap_tie", None)


@settings(max_examples=150, deadline=None)
@given(
    st.text("ACGTN", min_size=8, max_size=80),
    st.text("ACGTN", min_size=8, max_size=80),
    st.integers(0, 4),
    st.integers(4, 32),
    st.floats(0, 0.35),
    st.integers(1, 64),
    st.sampled_from(list(OverlapTie)),
)
def test_search_equals_plain_search(r1, r2, diffs, least, share, comparisons, tie):
    params = OverlapParams(diffs, least, share, comparisons, tie)
    want, o = plain_overlap(r1, r2, params), outcome(r1, r2, config=EngineConfig(params))
    assert (o["reason"] == "overlap_tie") if want == "tie" else (found(o) == want)


@pytest.mark.parametrize("seed", range(12))
def test_insert_geometry(seed):
    rng = random.Random(seed)
    n, left, right = rng.randint(20, 96), rng.randint(1, 48), rng.randint(1, 48)
    middle = "".join(rng.choice("AC") for _ in range(n))
    o = outcome("T" * left + middle, rc(middle + "G" * right), config=EngineConfig(OverlapParams(0, 20, 0.0, 20)))
    assert found(o) == (n, left, 0, 0)


def test_allowed_differences():
    p = OverlapParams()
    assert [p.allowed(n) for n in (10, 14, 15, 20, 25, 100)] == [2, 2, 3, 4, 5, 5]
    wide = OverlapParams(max_differences=99, max_difference_share=0.35)
    assert [wide.allowed(n) for n in (20, 40, 100)] == [6, 13, 34]  # 0.35 as a 32-bit float is a little less
    assert OverlapParams(max_difference_share=0.0).allowed(50) == 0


def plain_need(s: str, k: int, score: int) -> int:
    seen: dict[str, int] = {}
    total = 0
    for i in range(len(s) - k + 1):
        kmer = s[i : i + k].upper()
        if set(kmer) <= set("ACGT"):
            seen[kmer] = seen.get(kmer, 0) + 1
            total += {1: 4, 2: 1}.get(seen[kmer], 0)
            if total >= score:
                return i + k
    return len(s) + 1


@settings(max_examples=80, deadline=None)
@given(st.text("ACGTNacgt", min_size=3, max_size=60), st.integers(1, 4), st.integers(1, 60))
def test_complexity(s, k, score):
    grid = np.frombuffer(s.encode(), np.uint8)[None, :]
    want = plain_need(s, k, score) if len(s) >= k else len(s) + 1
    assert K.complexity_need(grid, k, score)[0] == want


MIXED = "ACGTTGCAAGCTTACGGATCCATGCGTATTCAGGCTAACGTCCGATAGTTCACTGA"


def test_mix_of_outcomes():
    ok = outcome(MIXED, rc(MIXED), steps=EngineConfig().steps())
    assert (ok["status"], ok["seq"], ok["qual"]) == ("merged", MIXED, "I" * len(MIXED))
    assert outcome("A" * 56, "C" * 56, steps=EngineConfig().steps())["status"] == "no_overlap"
    low = outcome("A" * 56, "T" * 56, steps=EngineConfig().steps())
    assert (low["status"], low["min_informative"]) == ("validation_rejected", 57)
    loose = EngineConfig(validation=None)
    assert outcome("A" * 56, "T" * 56, config=loose, steps=loose.steps())["status"] == "merged"


def test_policies():
    assert (ValidationPolicy.loose().score, ValidationPolicy().score, ValidationPolicy.strict().score) == (24, 30, 39)
    with pytest.raises(ConfigError):
        ValidationPolicy(score=65)
    with pytest.warns(UserWarning):
        assert ValidationPolicy().with_score(0).score == 30
    o = outcome("ACGTAC", rc("ACGTAC"), config=EngineConfig(OverlapParams(0, 4, 0.0, 4), ValidationPolicy(k=8)), steps=("overlap", "validate"))
    assert (o["status"], o["reason"]) == ("error", "k_exceeds_read")


def _merge(left, fwd, rev, right, tie=BaseTie.FORWARD, q=("", "", "", ""), steps=("overlap", "merge"), correction=None):
    ql, qf, qr, qq = (x or "I" * len(s) for x, s in zip(q, (left, fwd, rev, right)))
    p = K.Pairs.orient(*(np.frombuffer(x.encode(), np.uint8)[None, :] for x in (left + fwd, ql + qf, rc(rev + right), (qr + qq)[::-1])))
    p.length[:], p.s1[:], p.s2[:], p.diff[:] = len(fwd), len(left), 0, 0
    K.run(p, EngineConfig(merge=MergeParams(tie), correction=correction), steps[1:])
    n = int(p.out_len[0])
    return bytes(p.out[0, :n]).decode(), p.out_q[0, :n].tolist(), p.status[0]


def test_merge_policies():
    assert _merge("TT", "ACGT", "ACGT", "GG")[0] == "TTACGTGG"
    assert _merge("", "AAAA", "TTTT", "")[0] == "AAAA"
    assert _merge("", "AAAA", "TTTT", "", BaseTie.REVERSE)[0] == "TTTT"
    assert _merge("", "AAAA", "TTTT", "", BaseTie.AMBIGUOUS)[0] == "NNNN"
    assert _merge("", "AAAA", "TTTT", "", BaseTie.REJECT)[2] == "error"
    assert _merge("", "AAAA", "TTTT", "GGGG", BaseTie.INTERIOR)[0] == "AATTGGGG"
    assert _merge("", "AAAA", "TTTT", "", q=("", "5555", "IIII", ""))[0] == "TTTT"


def test_correction():
    assert [int(K._AGREE[q, q]) for q in (0, 5, 10, 15, 17, 18)] == [6, 12, 23, 34, 38, 40]
    pairs = [((40, 40), 3), ((40, 20), 20), ((35, 20), 15), ((20, 10), 10), ((10, 0), 11), ((41, 2), 40), ((0, 0), 0)]
    assert all(int(K._DIFFER[hi, lo]) == want for (hi, lo), want in pairs)
    steps = ("overlap", "merge", "correct")
    seq, q, _ = _merge("", "A", "A", "", steps=steps, correction=CorrectionParams(max_quality=10))
    assert (seq, q) == ("A", [10])
    kept = _merge("", "A", "G", "", q=("", "D", "?", ""), steps=steps, correction=CorrectionParams(min_delta=10))
    assert kept[0] == "A"  # 35 against 30
    ambiguous = _merge("", "AAAA", "TTTT", "", BaseTie.AMBIGUOUS, steps=steps, correction=CorrectionParams())
    assert ambiguous[0] == "AAAA"  # correction reads the mates, not the consensus
    quality = _merge("", "AAAA", "TTTT", "", BaseTie.AMBIGUOUS, steps=steps, correction=CorrectionParams(quality_only=True))
    assert quality[0] == "NNNN"


def test_order_of_correction_and_merge():
    reads = [[MIXED], ["I" * 56], [rc(MIXED[:20] + "A" + MIXED[21:])], ["5" * 56]]
    runs = [columns(reads, EngineConfig(), s, False) for s in (("overlap", "merge", "correct"), ("overlap", "correct", "merge"))]
    assert runs[0]["seq"] == runs[1]["seq"] and runs[0]["qual"] == runs[1]["qual"]


def test_flow_states(spark):
    rows = pairs_from(spark.createDataFrame([(1, MIXED, "I" * 56, rc(MIXED), "I" * 56)], "key long, r1_seq string, r1_qual string, r2_seq string, r2_qual string"), "key")
    flow = PairFlow(rows)
    for bad in (lambda: flow.merge(), lambda: flow.validate(), lambda: flow.correct(), lambda: flow.find_overlap().merge().merge(), lambda: flow.find_overlap().reads()):
        with pytest.raises(StageError):
            bad()
    again = flow.find_overlap().validate().correct().validate().merge()
    assert again.reads().first()["seq"] == MIXED
    assert flow.find_overlap().correct().corrected_pairs().first()["r2_out"] == rc(MIXED)
    assert flow.find_overlap().no_overlap().count() == 0


LOW = ("AC" * 28, "I" * 56)


def test_each_stage_keeps_its_own_parameters(spark):
    schema = "key long, r1_seq string, r1_qual string, r2_seq string, r2_qual string"
    rows = pairs_from(spark.createDataFrame([(1, MIXED, "I" * 56, rc(MIXED), "I" * 56)], schema), "key")
    loose, strict = ValidationPolicy(score=4, floor=1), ValidationPolicy(floor=57)
    flow = PairFlow(rows).find_overlap().validate(loose).correct().validate(strict)
    assert flow.result().first()["status"] == "validation_rejected"
    assert PairFlow(rows).find_overlap().validate(strict).correct().validate(loose).result().first()["status"] == "validation_rejected"
    one = PairFlow(rows).find_overlap().validate(loose).result().first()
    assert (one["status"], one["min_informative"]) == ("pair", 3)
    two = PairFlow(rows, EngineConfig(validation=loose)).find_overlap().validate().correct().validate(ValidationPolicy()).metrics().first()
    assert two["min_informative"] > 3 and two["expected_rate"] == pytest.approx(two["expected_errors"] / 56)
    seen = []
    out = PairFlow(rows).find_overlap().inspect(lambda d: seen.append(d.count())).inspect(lambda d: seen.append(d.count()), found=False)
    assert seen == [1, 0] and out.and_then_found(lambda f: f.merge()).reads().count() == 1
    assert PairFlow(rows).process().result("fail").first()["seq"] == MIXED
    with pytest.raises(ConfigError):
        PairFlow(rows).process().result("skip")


def test_records_in_hand():
    q = "I" * 56
    good, none = (Read("a", MIXED, q), Read("a", rc(MIXED), q)), (Read("b", "A" * 56, q), Read("b", "C" * 56, q))
    foreign, broken = (good[0], Read("x", rc(MIXED), q)), (Read("c", "ACG", "I"), Read("c", "ACG", "III"))
    low = (Read("d", *LOW), Read("d", rc(LOW[0]), LOW[1]))
    chain = Assembler()
    assert chain.process_pair(*good).seq == MIXED and chain.process_pair(*none) is None
    for pair, error in ((foreign, PairingError), (broken, RecordError), (low, ValidationError)):
        with pytest.raises(error):
            chain.process_pair(*pair)
    got = list(chain.process_iter([good, none, foreign, broken, low, good], batch=4))
    assert [type(x).__name__ for x in got] == ["Read", "NoneType", "PairingError", "RecordError", "ValidationError", "Read"]
    mates = next(chain.process_iter_with([good], ("overlap", "correct")))
    assert (mates[0].seq, mates[1].seq) == (good[0].seq, good[1].seq)
    tie = Assembler(EngineConfig(OverlapParams(5, 3, 0.2, 3, OverlapTie.REJECT)))
    assert isinstance(next(tie.process_iter([(Read("e", "ACGTACGT", "I" * 8), Read("e", "ACGTACGT", "I" * 8))])), OverlapError)
    assert list(chain.process_iter([])) == []


def test_spans_are_checked():
    p = K.Pairs.orient(*(np.frombuffer(x, np.uint8)[None, :] for x in (b"ACGT", b"IIII", b"ACGT", b"IIII")))
    p.length[:], p.s1[:], p.s2[:], p.diff[:] = 4, 1, 0, 0
    with pytest.raises(OverlapError):
        K.check_spans(p)
    with pytest.raises(OverlapError):
        outcome("ACGT", "TTTT", config=EngineConfig(OverlapParams(0, 0, 0.0, 0)))


def test_both_ways_to_score_kmers_agree():
    rng = np.random.default_rng(4)
    for letters in (b"ACGT", b"AC", b"ACGTNacgt"):
        bases = np.frombuffer(letters, np.uint8)[rng.integers(0, len(letters), (200, 40))]
        for k, score in ((1, 10), (2, 20), (3, 30), (3, 64), (5, 39)):
            assert (K.complexity_need(bases, k, score) == K._need_by_order(bases, k, score)).all()


def test_batches_of_many_lengths_keep_their_rows(spark):
    rng = random.Random(11)
    data = []
    for i in range(300):
        insert = "".join(rng.choice("ACGT") for _ in range(rng.randint(20, 60)))
        n = rng.choice([30, 31, 45])
        r1, r2 = (insert + "ACGTTGCA" * 5)[:n], (rc(insert) + "GGATCCTT" * 5)[: rng.choice([30, 40])]
        quals = ["".join(rng.choice("5?I\u00c8") for _ in x) for x in (r1, r2)]
        data.append((i, r1, quals[0], r2, quals[1]) if i % 17 else (i, None, quals[0], r2, "I"))
    schema = "key long, r1_seq string, r1_qual string, r2_seq string, r2_qual string"
    steps = EngineConfig(validation=None).steps()
    got = {r["key"]: r for r in assemble(pairs_from(spark.createDataFrame(data, schema).repartition(3), "key"), EngineConfig(validation=None)).collect()}
    for key, *reads in data:
        want = columns([[x] for x in reads], EngineConfig(validation=None), steps, False)
        assert [got[key][c] for c in want] == [v[0] for v in want.values()]
        if (qual := got[key]["qual"]) is not None:
            values = [ord(c) - 33 for c in qual]
            assert (got[key]["min_qual"], got[key]["max_qual"]) == (min(values), max(values)) and got[key]["avg_qual"] == pytest.approx(sum(values) / len(values))


def test_kernel_equals_relational_forms(spark):
    rng = random.Random(5)
    data = []
    for i in range(60):
        insert = "".join(rng.choice("ACGT") for _ in range(rng.randint(15, 70)))
        r1, r2 = (insert + "ACGTTGCA" * 5)[:40], (rc(insert) + "GGATCCTT" * 5)[:40]
        data.append((i, r1, "I" * 40, r2, "".join(rng.choice("5?I") for _ in range(40))))
    rows = pairs_from(spark.createDataFrame(data, "key long, r1_seq string, r1_qual string, r2_seq string, r2_qual string"), "key")
    columns = ["key", "overlap_len", "r1_start", "r2_start", "diff"]
    one = {tuple(r) for r in PairFlow(rows).find_overlap().result().select(*columns).collect()}
    assert one == {tuple(r) for r in R.overlap_search(rows).select(*columns).collect()}
    need = {r["key"]: r["min_informative"] for r in R.informative_length(rows, "key", 3, 30).collect()}
    kernel = PairFlow(rows).find_overlap().validate().found().select("key", "min_informative").collect()
    assert all(need[r["key"]] == r["min_informative"] for r in kernel)


def test_details_of_errors(spark):
    """What a failed pair's error is about; outcomes that aren't errors have none."""
    insert = "ACGTTGCATCAGGATCCATTGACCATGCAA"
    other = rc(insert[:7] + "G" + insert[8:])
    data = [
        (1, insert, "I" * 30, other, "I" * 30), (2, insert, "I" * 29, rc(insert), "I" * 30), (3, insert, "I" * 30, rc(insert), "I" * 28),
        (4, insert, "I" * 30, rc(insert), "I" * 30), (5, None, "I", "A", "I"), (6, "A" * 30, "I" * 30, "C" * 30, "I" * 30),
    ]
    rows = pairs_from(spark.createDataFrame(data, "key long, r1_seq string, r1_qual string, r2_seq string, r2_qual string"), "key")
    result = PairFlow(rows).find_overlap().merge(MergeParams(BaseTie.REJECT)).result()
    found = R.with_details(result)
    assert found.columns == [*result.columns, "detail"]
    got = {r["key"]: (r["reason"], r["detail"] and tuple(r["detail"])) for r in found.collect()}
    n = None
    assert got == {
        1: ("base_disagreement", (n, n, n, n, n, 7, insert[7], "G", 40)), 2: ("sequence_quality_length", (1, 30, 29, n, n, n, n, n, n)),
        3: ("sequence_quality_length", (2, 30, 28, n, n, n, n, n, n)), 4: (None, n), 5: ("null_read", n), 6: (None, n),
    }
    tied = PairFlow(rows.where("key = 4")).find_overlap(OverlapParams(tie=OverlapTie.REJECT)).result()
    assert tuple(R.with_details(tied).first()["detail"]) == (n, n, n, 30, 0, n, n, n, n)


def test_packed_search_equals_the_kernel(spark):
    """Reads of 0 to 200 bases, with N and other symbols, under several parameters; no Python in the plan."""
    rng = random.Random(12)
    data = []
    for i in range(250):
        letters = rng.choice(["ACGT", "ACGT", "ACGTN", "AC", "ACGTRn."])
        insert = "".join(rng.choice(letters) for _ in range(rng.choice([12, 31, 32, 33, 64, 65, 90, 150, 190])))
        cut = [rng.choice([10, 31, 32, 33, 63, 64, 65, 100, 200]) for _ in range(2)]
        r1, r2 = (insert + "ACGTTGCA" * 25)[: cut[0]], (rc(insert) + "GGATCCTT" * 25)[: cut[1]]
        r2 = "".join(rng.choice("ACGTN") if rng.random() < 0.02 else c for c in r2)
        data.append((i, r1, "I" * len(r1), r2, "I" * len(r2)))
    data.append((999, "", "", "ACGT" * 5, "I" * 20))
    rows = pairs_from(spark.createDataFrame(data, "key long, r1_seq string, r1_qual string, r2_seq string, r2_qual string"), "key")
    columns = ["key", "overlap_len", "r1_start", "r2_start", "diff"]
    for params in (OverlapParams(), OverlapParams(9, 5, 0.35, 5, OverlapTie.FROM_END), OverlapParams(0, 20, 0.0, 12, OverlapTie.FROM_START)):
        want = {tuple(r) for r in PairFlow(rows).find_overlap(params).result().select(*columns).collect()}
        found = R.packed_overlap_search(rows, params)
        assert {tuple(r) for r in found.select(*columns).collect()} == want and sum(r[1] is not None for r in want) > 50
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_packed_search_tries_offsets_in_compiled_code(spark):
    """No lambda goes over all offsets; repeated rows and null reads keep their rows."""
    insert = "ACGTTGCAAGGTCCATTGACCGTAGGCT" * 5
    data = [(1, insert, "I", rc(insert), "I")] * 2 + [(2, None, "I", "ACGT", "I"), (None, insert[:40], "I", rc(insert[:40]), "I")]
    rows = pairs_from(spark.createDataFrame(data, "key long, r1_seq string, r1_qual string, r2_seq string, r2_qual string"), "key")
    found = R.packed_overlap_search(rows)
    assert "filter(sequence(" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(((r["key"], r["overlap_len"], r["r1_start"], r["r2_start"], r["diff"]) for r in found.collect()), key=str)
    n = None
    assert got == [(1, 140, 0, 0, 0), (1, 140, 0, 0, 0), (2, n, n, n, n), (n, 40, 0, 0, 0)]


def test_bad_rows_have_a_status(spark):
    data = [(1, None, "I", "A", "I"), (2, "ACG", "II", "ACG", "III"), (3, "", "", "A", "I"), (4, "日本", "II", "AC", "II")]
    rows = pairs_from(spark.createDataFrame(data, "key long, r1_seq string, r1_qual string, r2_seq string, r2_qual string"), "key")
    got = {r["key"]: (r["status"], r["reason"]) for r in assemble(rows).collect()}
    assert got == {1: ("error", "null_read"), 2: ("error", "sequence_quality_length"), 3: ("no_overlap", None), 4: ("error", "not_bytes")}
    with pytest.raises(Exception, match="pair failed"):
        raise_on_error(assemble(rows)).collect()
    assert assemble(rows.where(F.lit(False))).count() == 0
