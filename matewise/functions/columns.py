"""Scalar functions as Catalyst expressions; none needs Python workers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The complements, one table per use.
READ_FROM, READ_TO = "ACGTacgt", "TGCAtgca"
UPPER_FROM, UPPER_TO = "ACGT", "TGCA"
IUPAC_FROM, IUPAC_TO = "ACGTRYSWKMBDHVNacgtryswkmbdhvn", "TGCAYRSWMKVHDBNtgcayrswmkvhdbn"


def mate_key(name: Column) -> Column:
    """First token of a read name (ASCII white space) without one trailing /1 or /2."""
    return F.regexp_replace(F.regexp_extract(name, r"^([^ \t\n\f\r]*)", 1), "/[12]$", "")


def read_id(header: Column) -> Column:
    """A FASTQ header's id: no leading @, first token, one trailing /1 or else /2 off."""
    return F.regexp_replace(F.regexp_extract(header, r"^@?\s*(\S*)", 1), "/[12]$", "")


def checked_read_id(header: Column) -> Column:
    """As :func:`read_id`; an empty id is an error."""
    found = read_id(header)
    return F.when(found == "", F.raise_error(F.concat(F.lit("empty read id in header: "), header))).otherwise(found)


def same_mates(left: Column, right: Column) -> Column:
    return mate_key(left) == mate_key(right)


def lengths_agree(seq: Column, qual: Column) -> Column:
    return F.length(seq) == F.length(qual)


def phred(qual: Column) -> Column:
    """Quality string to numbers, saturating at 0."""
    return F.transform(F.split(qual, ""), lambda c: F.greatest(F.ascii(c) - 33, F.lit(0)))


def quality_text(values: Column) -> Column:
    """Numbers to a quality string, saturating at byte 255."""
    return F.array_join(F.transform(values, lambda q: F.call_function("chr", F.least(q + 33, F.lit(255)))), "")


def reverse_complement(seq: Column) -> Column:
    """Orientation of a reverse mate: ACGT and acgt are complemented, all else stays."""
    return F.reverse(F.translate(seq, READ_FROM, READ_TO))


def complement_upper(seq: Column) -> Column:
    """Egress of a corrected reverse mate: upper-case ACGT only."""
    return F.translate(seq, UPPER_FROM, UPPER_TO)


def iupac_reverse_complement(seq: Column) -> Column:
    """All 15 IUPAC codes in both cases; any other character is an error."""
    odd = seq.rlike(f"[^{IUPAC_FROM}]")
    return F.when(odd, F.raise_error(F.concat(F.lit("not an IUPAC sequence: "), seq))).otherwise(
        F.reverse(F.translate(seq, IUPAC_FROM, IUPAC_TO))
    )


def allowed_differences(length: Column, share: float, cap: int) -> Column:
    scaled = length.cast("double") * F.lit(float(np.float32(share)))
    return F.when(scaled > 0, F.least(F.lit(cap), F.floor(scaled).cast("int"))).otherwise(F.lit(0)).cast("int")


def differences(left: Column, right: Column) -> Column:
    """Positions at which two strings of one length differ."""
    pairs = F.zip_with(F.split(left, ""), F.split(right, ""), lambda a, b: F.when(a != b, 1).otherwise(0))
    return F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x)


def evidence_score(length: Column, diff: Column) -> Column:
    return length - diff * 5


def error_probability(quality: Column) -> Column:
    return F.pow(F.lit(10.0), -quality.cast("double") / 10)


def expected_errors(seq: Column, qual: Column) -> Column:
    """Sum of error probabilities; a base other than ACGT counts 1."""
    each = F.zip_with(
        F.split(seq, ""), phred(qual), lambda b, q: F.when(b.isin("A", "C", "G", "T"), error_probability(q)).otherwise(F.lit(1.0))
    )
    return F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x)


def end_distance(position: Column, length: Column) -> Column:
    """Bases to the nearer end of a read."""
    return F.least(position, length - 1 - position)


def tagged_sha256(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def quality_summary(qual: Column) -> Column:
    """Struct of avg, min and max quality; zeros when empty, an error below byte 33."""
    raw = F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)
    total = F.aggregate(raw, F.lit(0).cast("long"), lambda acc, x: acc + x)
    bad = F.exists(raw, lambda x: x < 0)
    none = F.size(raw) == 0
    summary = F.struct(
        F.when(none, F.lit(0.0)).otherwise(total / F.size(raw)).alias("avg"),
        F.coalesce(F.array_min(raw), F.lit(0)).cast("long").alias("min"),
        F.coalesce(F.array_max(raw), F.lit(0)).cast("long").alias("max"),
    )
    return F.when(bad, F.raise_error(F.lit("a quality byte is below 33")).cast("struct<avg:double,min:bigint,max:bigint>")).otherwise(summary)


def safe_fraction(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def effective_pairs(cap: Column, requested: Column) -> Column:
    return F.least(F.coalesce(cap, requested), requested)
