"""DuckDB SQL of the read-pair queries, written independently of the Spark code.

Layers of common table expressions: pairs, oriented mates, overlap search, validation,
then one row per output column for merging and correction.
"""

from __future__ import annotations

from ..functions.params import BaseTie, CorrectionParams, MergeParams, OverlapParams, OverlapTie, ValidationPolicy
from .datagen import pairs_sql

KEY = r"regexp_replace(regexp_extract({}, '^([^ \t\n\f\r]*)', 1), '/[12]$', '')"


def base() -> str:
    return f"""pairs AS ({pairs_sql()}),
    ori AS (SELECT key, r1_seq AS a, r1_qual AS qa, reverse(translate(r2_seq, 'ACGTacgt', 'TGCAtgca')) AS b, reverse(r2_qual) AS qb,
                   {KEY.format('name1')} = {KEY.format('name2')} AS same FROM pairs)"""


def direction(name: str, left: str, right: str, p: OverlapParams) -> str:
    """First acceptable offset of ``left`` against the start of ``right``."""
    return f"""{name} AS (
      SELECT key, arg_min(ofs, ofs) AS ofs, arg_min(n, ofs) AS n, arg_min(d, ofs) AS d FROM (
        SELECT key, ofs, n, hamming(substr({left}, ofs + 1, n), substr({right}, 1, n)) AS d FROM (
          SELECT key, {left}, {right}, ofs, least(length({left}) - ofs, length({right})) AS n FROM (
            SELECT key, {left}, {right}, unnest(range(0, greatest(length({left}) - {p.min_overlap}, 0) + 1)) AS ofs FROM ori)))
      WHERE n >= {max(p.min_overlap, p.min_comparisons)}
        AND d <= CASE WHEN n * {p.share!r} > 0 THEN least({p.max_differences}, floor(n * {p.share!r})) ELSE 0 END
      GROUP BY key)"""


def search(p: OverlapParams = OverlapParams()) -> str:
    wins = ">=" if p.tie is OverlapTie.FROM_END else ">"
    return f"""{base()}, {direction('fs', 'a', 'b', p)}, {direction('fe', 'b', 'a', p)},
    found AS (SELECT ori.*, fs.ofs IS NOT NULL OR fe.ofs IS NOT NULL AS hit,
                     fe.ofs IS NOT NULL AND (fs.ofs IS NULL OR fe.n - 5 * fe.d {wins} fs.n - 5 * fs.d) AS use_end,
                     fs.ofs AS sat, fs.n AS sn, fs.d AS sd, fe.ofs AS eat, fe.n AS en, fe.d AS ed
              FROM ori LEFT JOIN fs USING (key) LEFT JOIN fe USING (key)),
    ov AS (SELECT key, a, qa, b, qb, same, CASE WHEN use_end THEN en ELSE sn END AS n, CASE WHEN use_end THEN 0 ELSE sat END AS s1,
                  CASE WHEN use_end THEN eat WHEN hit THEN 0 END AS s2, CASE WHEN use_end THEN ed ELSE sd END AS d FROM found)"""


def need(name: str, text: str, policy: ValidationPolicy, source: str = "ori") -> str:
    k = policy.k
    return f"""{name} AS (
      SELECT key, coalesce(min(CASE WHEN good AND total >= {policy.score} THEN ofs + {k} - 1 END), max(size) + 1) AS need FROM (
        SELECT *, sum(CASE WHEN NOT good THEN 0 WHEN sight = 1 THEN 4 WHEN sight = 2 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY key ORDER BY ofs) AS total FROM (
          SELECT *, row_number() OVER (PARTITION BY key, kmer ORDER BY ofs) AS sight FROM (
            SELECT key, size, ofs, substr(t, ofs, {k}) AS kmer, regexp_matches(substr(t, ofs, {k}), '^[ACGT]+$') AS good FROM (
              SELECT key, {text} AS t, length({text}) AS size, unnest(range(1, greatest(length({text}) - {k} + 2, 2))) AS ofs FROM {source}))))
      GROUP BY key)"""


def informative(policy: ValidationPolicy) -> str:
    parts = [("n1", "upper(a)"), ("n2", "reverse(upper(a))"), ("n3", "upper(b)"), ("n4", "reverse(upper(b))")]
    return ", ".join(need(n, t, policy) for n, t in parts) + """,
    inf AS (SELECT key, least(greatest(n1.need, n2.need, n3.need, n4.need), least(length(a), length(b)) + 1) AS informative
            FROM ori JOIN n1 USING (key) JOIN n2 USING (key) JOIN n3 USING (key) JOIN n4 USING (key))"""


def _p_error(base_col: str, qual: str) -> str:
    return f"CASE WHEN {base_col} IN ('A', 'C', 'G', 'T') THEN pow(10.0, -({qual}) / 10.0) ELSE 1.0 END"


def validated(policy: ValidationPolicy = ValidationPolicy(), p: OverlapParams = OverlapParams()) -> str:
    return f"""{search(p)}, {informative(policy)},
    col AS (SELECT key, j, substr(a, s1 + j, 1) AS x, substr(b, s2 + j, 1) AS y, greatest(ascii(substr(qa, s1 + j, 1)) - 33, 0) AS qx,
                   greatest(ascii(substr(qb, s2 + j, 1)) - 33, 0) AS qy
            FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM ov WHERE n IS NOT NULL)),
    sums AS (SELECT key, count(*) FILTER (x <> y) AS mm, least(sum({_p_error('x', 'qx')}), sum({_p_error('y', 'qy')})) AS ee FROM col GROUP BY key),
    val AS (SELECT ov.*, informative, mm, ee,
                   CASE WHEN NOT same THEN 'mate_mismatch' WHEN n IS NULL THEN 'no_overlap'
                        WHEN n < greatest(informative, {policy.floor}) OR mm > ee * {policy.times} + {policy.plus} THEN 'validation_rejected'
                        ELSE 'ok' END AS status,
                   CASE WHEN same AND n < greatest(informative, {policy.floor}) THEN 'insufficient_overlap_length'
                        WHEN same AND mm > ee * {policy.times} + {policy.plus} THEN 'excessive_mismatch_rate' END AS reason
            FROM ov JOIN inf USING (key) LEFT JOIN sums USING (key))"""


def float_errors() -> str:
    """``errs``: expected errors of the rows of ``col`` in 32-bit floats: eights are summed first, then what is left one by one."""
    each = "CASE WHEN {0} IN ('A', 'C', 'G', 'T') THEN CAST(pow(10.0, CAST(CAST(-q{0} AS FLOAT) / CAST(10 AS FLOAT) AS DOUBLE)) AS FLOAT) ELSE CAST(1 AS FLOAT) END".format
    add = "lambda acc, x: acc + x"

    def summed(values: str) -> str:
        eights = f"list_transform(range(0, len({values}) // 8), lambda c: list_reduce({values}[c * 8 + 1 : c * 8 + 8], {add}))"
        rest = f"{values}[len({values}) // 8 * 8 + 1 :]"
        return f"list_reduce([CAST(0 AS FLOAT)] || {eights} || {rest}, {add})"

    return f"""lists AS (SELECT key, list({each('x')} ORDER BY j) AS ex, list({each('y')} ORDER BY j) AS ey FROM col GROUP BY key),
    errs AS (SELECT key, least({summed('ex')}, {summed('ey')}) AS err FROM lists)"""


def unchecked(p: OverlapParams = OverlapParams()) -> str:
    """As :func:`validated`, without validation."""
    return f"""{search(p)},
    val AS (SELECT *, CASE WHEN NOT same THEN 'mate_mismatch' WHEN n IS NULL THEN 'no_overlap' ELSE 'ok' END AS status,
                   CAST(NULL AS VARCHAR) AS reason FROM ov)"""


def _quality(p: str) -> str:
    return f"least(40, greatest(0, floor(-10 * log10({p}))))"


def merged(
    source: str, merge: MergeParams = MergeParams(), correction: CorrectionParams | None = None, correct_first: bool = False
) -> str:
    """``out``: key, status, reason, seq, qual from the rows of ``val`` that are ok."""
    tie = {
        BaseTie.FORWARD: "x",
        BaseTie.REVERSE: "y",
        BaseTie.AMBIGUOUS: "'N'",
        BaseTie.INTERIOR: "CASE WHEN least(ja, la - 1 - ja) >= least(jb, lb - 1 - jb) THEN x ELSE y END",
    }[merge.tie]
    plain = f"CASE WHEN qx > qy THEN x WHEN qy > qx THEN y WHEN x = y THEN x ELSE {tie} END"
    top = "greatest(qx, qy)"
    base_sql, qual_sql = plain, top
    if correction is not None:
        ex, ey = "pow(10.0, -least(qx, 41) / 10.0)", "pow(10.0, -least(qy, 41) / 10.0)"
        hi, lo = f"least({ex}, {ey})", f"greatest({ex}, {ey})"
        agree = f"(({ex}) * ({ey}) / 3) / ((1 - {ex}) * (1 - {ey}) + 4 * ({ex}) * ({ey}) / 3)"
        differ = f"({hi}) * (1 - ({lo}) / 3) / (({hi}) + ({lo}) - 4 * ({hi}) * ({lo}) / 3)"
        qual_sql = f"least({correction.max_quality}, CASE WHEN x = y THEN {_quality(agree)} ELSE {_quality(differ)} END)"
        may = f"(x = y OR abs(qx - qy) >= {correction.min_delta})" if not correction.quality_only else "FALSE"
        better = "CASE WHEN qx >= qy THEN x ELSE y END"
        base_sql = f"CASE WHEN {may} THEN {better} ELSE {'x' if correct_first else plain} END"
    return f"""{source},
    lay AS (SELECT key, length(a) AS la, length(b) AS lb, s1, n, a, b, qa, qb, unnest(range(0, s1 + length(b) - s2)) AS j, s2 FROM val WHERE status = 'ok'),
    pos AS (SELECT key, j, s1, n, la, lb, j AS ja, j - s1 + s2 AS jb, substr(a, j + 1, 1) AS x, greatest(ascii(substr(qa, j + 1, 1)) - 33, 0) AS qx,
                   CASE WHEN j - s1 + s2 >= 0 THEN substr(b, j - s1 + s2 + 1, 1) END AS y,
                   CASE WHEN j - s1 + s2 >= 0 THEN greatest(ascii(substr(qb, j - s1 + s2 + 1, 1)) - 33, 0) END AS qy FROM lay),
    cons AS (SELECT key, string_agg(CASE WHEN j < s1 THEN x WHEN j >= s1 + n THEN y ELSE {base_sql} END, '' ORDER BY j) AS seq,
                    string_agg(chr(CAST(CASE WHEN j < s1 THEN qx WHEN j >= s1 + n THEN qy ELSE {qual_sql} END + 33 AS INTEGER)), '' ORDER BY j) AS qual
             FROM pos GROUP BY key),
    res AS (SELECT val.key, CASE WHEN val.status = 'ok' THEN 'merged' ELSE val.status END AS status, val.reason, cons.seq, cons.qual
            FROM val LEFT JOIN cons USING (key))"""


def corrected_pairs(correction: CorrectionParams = CorrectionParams()) -> str:
    """``fixed``: key and both corrected mates as sequenced, for pairs with an overlap."""
    ex, ey = "pow(10.0, -least(qx, 41) / 10.0)", "pow(10.0, -least(qy, 41) / 10.0)"
    hi, lo = f"least({ex}, {ey})", f"greatest({ex}, {ey})"
    agree = f"(({ex}) * ({ey}) / 3) / ((1 - {ex}) * (1 - {ey}) + 4 * ({ex}) * ({ey}) / 3)"
    differ = f"({hi}) * (1 - ({lo}) / 3) / (({hi}) + ({lo}) - 4 * ({hi}) * ({lo}) / 3)"
    qual = f"least({correction.max_quality}, CASE WHEN x = y THEN {_quality(agree)} ELSE {_quality(differ)} END)"

    def mate(name: str, own: str, own_q: str, start: str) -> str:
        return f"""{name} AS (SELECT key, string_agg(CASE WHEN c IS NULL THEN x0 ELSE c END, '' ORDER BY j) AS seq,
            string_agg(chr(CAST(coalesce(cq, q0) + 33 AS INTEGER)), '' ORDER BY j) AS qual
          FROM (SELECT w.key, w.j, substr(w.{own}, w.j + 1, 1) AS x0, greatest(ascii(substr(w.{own_q}, w.j + 1, 1)) - 33, 0) AS q0, fix.c, fix.cq
                FROM (SELECT key, {own}, {own_q}, {start} AS s, n, unnest(range(0, length({own}))) AS j FROM val WHERE status = 'ok') w
                LEFT JOIN fix ON fix.key = w.key AND fix.j = w.j - w.s) GROUP BY key)"""

    return f"""{unchecked()},
    win AS (SELECT key, j, substr(a, s1 + j + 1, 1) AS x, substr(b, s2 + j + 1, 1) AS y, greatest(ascii(substr(qa, s1 + j + 1, 1)) - 33, 0) AS qx,
                   greatest(ascii(substr(qb, s2 + j + 1, 1)) - 33, 0) AS qy
            FROM (SELECT *, unnest(range(0, n)) AS j FROM val WHERE status = 'ok')),
    fix AS (SELECT key, j, CASE WHEN qx >= qy THEN x ELSE y END AS c, {qual} AS cq FROM win),
    {mate('m1', 'a', 'qa', 's1')}, {mate('m2', 'b', 'qb', 's2')},
    fixed AS (SELECT m1.key, m1.seq AS r1_out, m1.qual AS q1_out, reverse(translate(m2.seq, 'ACGT', 'TGCA')) AS r2_out, reverse(m2.qual) AS q2_out
              FROM m1 JOIN m2 USING (key))"""


def final(layers: str, select: str) -> str:
    return f"WITH {layers} {select}"
