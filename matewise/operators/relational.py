"""The same operators as Catalyst expressions and windows, without Python workers.

A second, independent implementation: tests hold it against the kernel, and relational
queries use it directly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.params import OverlapParams, OverlapTie


def oriented(pairs: DataFrame) -> DataFrame:
    """Add a, qa, b, qb: the mates in one orientation, qualities as text."""
    return pairs.select(
        "*",
        F.col("r1_seq").alias("a"),
        F.col("r1_qual").alias("qa"),
        C.reverse_complement(F.col("r2_seq")).alias("b"),
        F.reverse("r2_qual").alias("qb"),
    )


def first_hit(left: Column, right: Column, params: OverlapParams) -> Column:
    """Struct (at, n, d) of the first acceptable offset of ``left`` against the start of ``right``, or null."""
    last = F.greatest(F.length(left) - params.min_overlap, F.lit(0))

    def candidate(at: Column) -> Column:
        n = F.least(F.length(left) - at, F.length(right))
        d = C.differences(F.substring(left, at + 1, n), F.substring(right, F.lit(1), n))
        return F.struct(at.alias("at"), n.alias("n"), d.alias("d"))

    def accepted(x: Column) -> Column:
        return (
            (x["n"] >= max(params.min_overlap, params.min_comparisons))
            & (x["d"] <= C.allowed_differences(x["n"], params.max_difference_share, params.max_differences))
        )

    return F.get(F.filter(F.transform(F.sequence(F.lit(0), last), candidate), accepted), F.lit(0))


#: Bases of a word, so that two words fit a long.
WORD = 32
_FULL = (1 << WORD) - 1
#: The symbols that are packed, and their bits in three planes: two tell A, C, G and T apart, the third marks N.
SYMBOLS, PLANES = "ACGTN", ("00110", "01010", "00001")


def _call(name: str, value: Column, bits: Column) -> Column:
    return F.call_function(name, value, bits.cast("int"))


def packed(seq: Column) -> list[Column]:
    """A read's planes, each an array of longs: bases 32 i to 32 i + 63 in the i-th, one bit each, the first one highest."""

    def plane(signs: str) -> Column:
        bits = F.translate(seq, SYMBOLS, signs)
        count = F.floor((F.length(seq) + WORD - 1) / WORD).cast("int")
        some = F.transform(F.sequence(F.lit(0), count), lambda i: F.rpad(F.substring(bits, i * WORD + 1, F.lit(WORD)), WORD, "0"))
        words = F.transform(some, lambda x: F.conv(x, 2, 10).cast("long"))
        return F.zip_with(words, F.slice(words, 2, 1 << 30), lambda x, y: F.shiftleft(x, WORD).bitwiseOR(F.coalesce(y, F.lit(0).cast("long"))))

    return [plane(signs) for signs in PLANES]


def _window(plane: Column, at: Column) -> Column:
    """The 32 bits of a plane from base ``at`` on."""
    word = F.coalesce(F.get(plane, F.floor(at / WORD).cast("int")), F.lit(0).cast("long"))
    return _call("shiftrightunsigned", word, WORD - at % WORD).bitwiseAND(F.lit(_FULL))


def _unequal(left: list[Column], right: list[Column], at: Column, k: Column, n: Column) -> Column:
    """Of the n bases of ``left`` from ``at`` on, how many of the k-th 32 differ from those of ``right``: XOR and bit count."""
    apart = None
    for p, q in zip(left, right):
        x = _window(p, at + k * WORD).bitwiseXOR(_window(q, k * WORD))
        apart = x if apart is None else apart.bitwiseOR(x)
    # of the last word only the first bases count
    held = F.greatest(F.lit(0), WORD - (n - k * WORD))
    mask = _call("shiftleft", F.lit(_FULL), held).bitwiseAND(F.lit(_FULL))
    return F.bit_count(apart.bitwiseAND(mask))


def first_packed_hit(left: list[Column], right: list[Column], left_len: Column, right_len: Column, params: OverlapParams) -> Column:
    """As :func:`first_hit`, on packed reads.

    The first 32 bases rule out nearly every offset; those that are left are counted in full.
    """
    last = F.greatest(left_len - params.min_overlap, F.lit(0))
    need = max(params.min_overlap, params.min_comparisons)
    size = lambda at: F.least(left_len - at, right_len)

    def candidate(at: Column) -> Column:
        n = size(at)
        words = F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / WORD).cast("int"), F.lit(0)))
        d = F.aggregate(words, F.lit(0), lambda acc, k: acc + _unequal(left, right, at, k, n))
        return F.struct(at.alias("at"), n.alias("n"), d.alias("d"))

    near = F.filter(F.sequence(F.lit(0), last), lambda at: (size(at) >= need) & (_unequal(left, right, at, F.lit(0), size(at)) <= params.max_differences))
    allowed = lambda x: x["d"] <= C.allowed_differences(x["n"], params.max_difference_share, params.max_differences)
    return F.get(F.filter(F.transform(near, candidate), allowed), F.lit(0))


def _once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are worked out once a row: a generator's output isn't written out again where it is used."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _hits(rows: DataFrame, params: OverlapParams, needed: Column | None = None) -> DataFrame:
    """Add fs and fe, the first hits of oriented rows from both directions, where ``needed`` (everywhere, if not given)."""
    only = lambda c: c if needed is None else F.when(needed, c)
    planes = {f"__{x}{k}": only(p) for x in "ab" for k, p in enumerate(packed(F.col(x)))}
    odd = F.coalesce(F.col("a").rlike(f"[^{SYMBOLS}]") | F.col("b").rlike(f"[^{SYMBOLS}]"), F.lit(False))
    names = [*planes, "__la", "__lb", "__odd"]
    rows = _once(rows, planes | {"__la": F.length("a"), "__lb": F.length("b"), "__odd": odd})
    hit = lambda x, y: F.when(F.col("__odd"), first_hit(F.col(x), F.col(y), params)).otherwise(
        first_packed_hit(*([F.col(f"__{z}{k}") for k in range(len(PLANES))] for z in (x, y)), F.col(f"__l{x}"), F.col(f"__l{y}"), params)
    )
    return _once(rows, {"fs": only(hit("a", "b")), "fe": only(hit("b", "a"))}).drop(*names)


#: Bases of a long at three bits each, its lowest bits one a base, and the symbols' digits: any two differ in at most three bits.
OCTAL = 21
_ONES, _LOW63, DIGITS = int("1" * OCTAL, 8), (1 << 63) - 1, "03567"
#: Words of overlaps that are compared without a loop.
UNROLLED = 4


def octal_words(seq: Column) -> Column:
    """A read as longs of 21 bases, three bits each, the first base highest; two without bases end it."""
    digits = F.translate(seq, SYMBOLS, DIGITS)
    count = F.ceil(F.length(seq) / OCTAL).cast("int")
    some = F.transform(F.sequence(F.lit(0), count + 1), lambda i: F.rpad(F.substring(digits, i * OCTAL + 1, F.lit(OCTAL)), OCTAL, "0"))
    return F.transform(some, lambda x: F.conv(x, 8, 10).cast("long"))


def _octal_window(words: Column, q: Column, r: Column) -> Column:
    """The 21 bases from base 21 q + r on."""
    head = _call("shiftleft", F.get(words, q), r * 3).bitwiseAND(F.lit(_LOW63))
    return head.bitwiseOR(_call("shiftrightunsigned", F.get(words, q + 1), 63 - r * 3))


def _octal_differences(n: Column) -> Column:
    """Of n bases of __left from base 21 __q + __r on, how many differ from those of __right; short reads in compiled code."""

    def part(k: Column) -> Column:
        x = _octal_window(F.col("__left"), F.col("__q") + k, F.col("__r")).bitwiseXOR(F.get("__right", k))
        folded = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseAND(F.lit(_ONES))
        counted = _call("shiftleft", F.lit(_ONES), 3 * F.greatest(F.lit(0), OCTAL - (n - k * OCTAL)))
        return F.bit_count(folded.bitwiseAND(counted))

    words = F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / OCTAL).cast("int"), F.lit(0)))
    few = part(F.lit(0))
    for k in range(1, UNROLLED):
        few = few + F.when(n > k * OCTAL, part(F.lit(k))).otherwise(0)
    return F.when(n <= UNROLLED * OCTAL, few).otherwise(F.aggregate(words, F.lit(0), lambda acc, k: acc + part(k)))


def packed_overlap_search(pairs: DataFrame, params: OverlapParams = OverlapParams()) -> DataFrame:
    """:func:`overlap_search` by bit-parallel comparison, in built-in expressions.

    Each direction and offset is a row while its first 21 bases are compared, in compiled code; the few that are near
    are counted in full, and an aggregation finds each pair's first.  Every pair has a row (offset -1) whatever is found.
    Reads with symbols other than A, C, G, T and N are compared letter by letter.
    """
    need = max(params.min_overlap, params.min_comparisons)
    code = lambda at, d: _call("shiftleft", at.cast("long"), F.lit(32)).bitwiseOR(d.cast("long"))
    odd = F.coalesce(F.col("a").rlike(f"[^{SYMBOLS}]") | F.col("b").rlike(f"[^{SYMBOLS}]"), F.lit(False))
    rows = oriented(pairs).withColumn("__row", F.monotonically_increasing_id())
    sizes = {"__la": F.length("a"), "__lb": F.length("b")}
    rows = _once(rows, {"__a": octal_words(F.col("a")), "__b": octal_words(F.col("b")), "__odd": odd} | sizes)
    plain = {f"__p{x}": F.when(F.col("__odd"), first_hit(F.col(x), F.col(y), params)) for x, y in ("ab", "ba")}
    rows = rows.select(*pairs.columns, "__row", "__a", "__b", *sizes, "__odd", *(c.alias(n) for n, c in plain.items()))
    ways = [
        F.struct(F.lit(i).alias("__way"), F.col(f"__{x}").alias("__left"), F.col(f"__{y}").alias("__right"), F.col(f"__l{x}").alias("__m"),
                 F.col(f"__l{y}").alias("__n"), F.col(f"__p{x}").alias("__plain"))
        for i, (x, y) in enumerate(("ab", "ba"))
    ]
    rows = rows.select(*pairs.columns, "__row", *sizes, "__odd", F.inline(F.array(*ways)))
    last = F.when(F.col("__odd") | F.col("__m").isNull() | F.col("__n").isNull(), -1).otherwise(F.greatest(F.col("__m") - params.min_overlap, F.lit(0)))
    tried = rows.withColumn("__first", F.get("__right", F.lit(0))).withColumn("__at", F.explode(F.sequence(F.lit(-1), last)))
    q = F.call_function("div", F.col("__at"), F.lit(OCTAL)).cast("int")
    tried = tried.withColumn("__q", q).withColumn("__r", F.col("__at") - F.col("__q") * OCTAL)
    tried = tried.withColumn("__size", F.least(F.col("__m") - F.col("__at"), F.col("__n")))
    real, size = F.col("__at") >= 0, F.col("__size")
    counted = _call("shiftleft", F.lit(_LOW63), 3 * F.greatest(F.lit(0), OCTAL - size)).bitwiseAND(F.lit(_LOW63))
    bits = F.bit_count(_octal_window(F.col("__left"), F.col("__q"), F.col("__r")).bitwiseXOR(F.col("__first")).bitwiseAND(counted))
    allowed = C.allowed_differences(size, params.max_difference_share, params.max_differences)
    near = ~real | ((size >= need) & (bits <= 3 * allowed))
    tried = tried.where(near).withColumn("__d", F.when(real, _octal_differences(size)))
    hit = F.when(real, F.when(F.col("__d") <= allowed, code(F.col("__at"), F.col("__d")))).otherwise(code(F.col("__plain.at"), F.col("__plain.d")))
    best = tried.withColumn("__hit", hit).groupBy("__row").agg(
        *(F.first(c).alias(c) for c in [*pairs.columns, *sizes]), *(F.min(F.when(F.col("__way") == i, F.col("__hit"))).alias(f"__c{x}") for i, x in enumerate("ab"))
    )
    for x, y, out in (("a", "b", "fs"), ("b", "a", "fe")):
        at = F.shiftright(f"__c{x}", 32).cast("int")
        n, d = F.least(F.col(f"__l{x}") - at, F.col(f"__l{y}")), F.col(f"__c{x}").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
        best = best.withColumn(out, F.when(F.col(f"__c{x}").isNotNull(), F.struct(at.alias("at"), n.alias("n"), d.alias("d"))))
    return _chosen(best, pairs.columns, params)


DETAIL = "struct<mate:int,bases:int,qualities:int,overlap_len:int,diff:int,offset:int,left_base:string,right_base:string,quality:int>"


def with_details(result: DataFrame, params: OverlapParams = OverlapParams()) -> DataFrame:
    """Add ``detail`` to outcomes that still have their reads: what a failed pair's error is about, null elsewhere.

    Unequal lengths: the mate, its bases and qualities.  A tie of overlaps: length and differences of the one
    from the start.  Mates that differ with equal quality: the first such offset in the overlap, both bases in one
    orientation, and the quality.  The search is repeated for such pairs alone.
    """
    reason, names = F.col("reason"), ("a", "qa", "b", "qb", "fs", "fe")
    rows = _hits(oriented(result), params, F.coalesce(reason.isin("base_disagreement", "overlap_tie"), F.lit(False)))
    none = {f.split(":")[0]: F.lit(None).cast(f.split(":")[1]) for f in DETAIL[7:-1].split(",")}
    told = lambda **more: F.struct(*((more.get(n, c)).alias(n) for n, c in none.items()))
    uneven = F.length("r1_seq") != F.length("r1_qual")
    mate = [F.when(uneven, one).otherwise(two) for one, two in ((F.lit(1), F.lit(2)), *((F.length(f"r1_{c}"), F.length(f"r2_{c}")) for c in ("seq", "qual")))]
    hit, use_end = _choice(params)
    s1, s2 = F.when(use_end, 0).otherwise(hit["at"]), F.when(use_end, hit["at"]).otherwise(0)
    at = lambda c, i: F.substring(c, i + 1, F.lit(1))
    score = lambda c, i: F.greatest(F.ascii(at(c, i)) - 33, F.lit(0))
    equal = lambda j: (at("a", s1 + j) != at("b", s2 + j)) & (score("qa", s1 + j) == score("qb", s2 + j))
    offset = F.get(F.filter(F.sequence(F.lit(0), hit["n"] - 1), equal), F.lit(0))
    rows = _once(rows, {"__offset": F.when(reason == "base_disagreement", offset), "__s1": s1, "__s2": s2})
    j = F.col("__offset")
    apart = told(
        offset=j, left_base=at("a", F.col("__s1") + j), right_base=at("b", F.col("__s2") + j), quality=score("qa", F.col("__s1") + j)
    )
    detail = (
        F.when(reason == "sequence_quality_length", told(mate=mate[0], bases=mate[1], qualities=mate[2]))
        .when(reason == "overlap_tie", told(overlap_len=F.col("fs.n"), diff=F.col("fs.d")))
        .when(reason == "base_disagreement", apart)
    )
    return rows.withColumn("detail", detail).drop(*names, "__offset", "__s1", "__s2")


def overlap_search(pairs: DataFrame, params: OverlapParams = OverlapParams()) -> DataFrame:
    """Add overlap_len, r1_start, r2_start, diff (null where there is none), from both directions."""
    rows = oriented(pairs)
    rows = rows.withColumn("fs", first_hit(F.col("a"), F.col("b"), params)).withColumn("fe", first_hit(F.col("b"), F.col("a"), params))
    return _chosen(rows, pairs.columns, params)


def _choice(params: OverlapParams) -> tuple[Column, Column]:
    """The better of the hits fs (from the start) and fe (from the end), and whether it is the one from the end."""
    score_s, score_e = C.evidence_score(F.col("fs.n"), F.col("fs.d")), C.evidence_score(F.col("fe.n"), F.col("fe.d"))
    tied = F.coalesce(score_s == score_e, F.lit(False))
    end_wins = score_e >= score_s if params.tie is OverlapTie.FROM_END else score_e > score_s
    use_end = F.col("fe").isNotNull() & (F.col("fs").isNull() | end_wins)
    failed = tied if params.tie is OverlapTie.REJECT else F.lit(False)
    return F.when(failed, None).when(use_end, F.col("fe")).otherwise(F.col("fs")), use_end


def _chosen(rows: DataFrame, columns: list[str], params: OverlapParams) -> DataFrame:
    """The columns of the better hit."""
    hit, use_end = _choice(params)
    rows = rows.withColumn("hit", hit).withColumn("use_end", use_end)
    return rows.select(
        *columns,
        F.col("hit.n").alias("overlap_len"),
        F.when(F.col("hit").isNotNull(), F.when(F.col("use_end"), F.lit(0)).otherwise(F.col("hit.at"))).alias("r1_start"),
        F.when(F.col("hit").isNotNull(), F.when(F.col("use_end"), F.col("hit.at")).otherwise(F.lit(0))).alias("r2_start"),
        F.col("hit.d").alias("diff"),
    )


def complexity_need(reads: DataFrame, key: str, seq: str, k: int, score: int, out: str, from_tail: bool = False) -> DataFrame:
    """(key, out): bases from one end until k-mers score enough, the read's length + 1 if never.

    A k-mer's first sighting scores 4, its second 1; k-mers with other letters are skipped.
    """
    text = F.upper(F.col(seq))
    text = F.reverse(text) if from_tail else text
    rows = reads.select(F.col(key), text.alias("text"), F.length(seq).alias("size"))
    starts = F.when(F.col("size") >= k, F.sequence(F.lit(1), F.col("size") - k + 1)).otherwise(F.array().cast("array<int>"))
    kmers = rows.select(key, "size", "text", F.explode_outer(starts).alias("at")).withColumn("kmer", F.substring("text", F.col("at"), F.lit(k)))
    good = F.col("kmer").rlike("^[ACGT]+$")
    sight = F.row_number().over(Window.partitionBy(key, "kmer").orderBy("at"))
    points = F.when(~good, 0).when(F.col("sight") == 1, 4).when(F.col("sight") == 2, 1).otherwise(0)
    running = F.sum("points").over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    scored = kmers.withColumn("sight", sight).withColumn("points", points).withColumn("total", running)
    reached = F.min(F.when((F.col("total") >= score) & good, F.col("at") + k - 1))
    return scored.groupBy(key).agg(F.coalesce(reached, F.max("size") + 1).cast("int").alias(out))


def informative_length(pairs: DataFrame, key: str, k: int, score: int) -> DataFrame:
    """(key, min_informative): the largest need of both reads from both ends, capped at the shorter read + 1."""
    rows = pairs.select(key, "r1_seq", C.reverse_complement(F.col("r2_seq")).alias("b"))
    parts = [
        complexity_need(rows, key, seq, k, score, name, tail)
        for seq, name, tail in (("r1_seq", "n1", False), ("r1_seq", "n2", True), ("b", "n3", False), ("b", "n4", True))
    ]
    out = rows.select(key, (F.least(F.length("r1_seq"), F.length("b")) + 1).alias("most"))
    for part in parts:
        out = out.join(part, key)
    return out.select(key, F.least(F.greatest("n1", "n2", "n3", "n4"), F.col("most")).cast("int").alias("min_informative"))


def mate_budget(pairs: DataFrame, order: str, most: int) -> DataFrame:
    """The pair with which mismatched mates exceed ``most``, if any: one row (ordinal, pairs_seen)."""
    bad = pairs.where(~F.col("mates_match"))
    over = bad.orderBy(order).limit(most + 1).agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("ordinal"))
    return over.where(F.col("n") > most).select("ordinal", (F.col("ordinal") + 1).alias("pairs_seen"))
