"""Secret scans over a trigram inverted index.

Texts are indexed in segments: for each trigram (of UTF-8 bytes, A-Z lower-cased) the documents of
the segment that hold it, as a list or, where shorter, a bit map.  The index is a table sorted by
trigram, so a lookup reads little of it; segments are never merged, so building needs no shuffle.
From each rule's regular expression a Boolean query over trigrams is derived that every match
must satisfy.  Postings are intersected and united segment by segment; only the texts that are
left are searched with the rule itself.  A rule without mandatory trigrams scans every text.

Equal texts are one document of a segment and are searched once, so copies cost narrow rows.

Edge cases: a null text is empty and has no spans; a null id is kept; repeated rows are each
returned with their spans; spans are in code points, end exclusive, of whole texts, however
long; matches of one rule don't overlap, those of different rules may; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stash
from .neardup import LOWER
from .runs import by_run

#: A Boolean query: None (anything), a trigram, or ("and" | "or", parts).
Query = tuple | int | None
#: More alternatives than these are not told apart.
MOST = 24
#: Bytes and documents of a segment.
SEGMENT_BYTES, SEGMENT_DOCS = 4 << 20, 4096
DIRECTORY = -1


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` of which ``group`` has ``least`` characters; letters in either case (ASCII) if ``fold``."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    fold: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.fold else 0))

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Leftmost non-overlapping matches, without those that are too short."""
        return [m.span() for m in self.compiled().finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


# fixed values: the contract's three kinds, then public formats of keys
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, fold=True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("slack", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)


def both(*parts: Query) -> Query:
    return _joined("and", [p for p in parts if p is not None])


def either(*parts: Query) -> Query:
    """One of ``parts``, without those that ask for all that another asks for, and more."""
    if any(p is None for p in parts):
        return None
    asks = {p: set(p[1]) if isinstance(p, tuple) and p[0] == "and" else {p} for p in dict.fromkeys(parts)}
    return _joined("or", [p for p in asks if not any(asks[o] < asks[p] for o in asks)])


def _joined(word: str, parts: list[Query]) -> Query:
    flat: list[Query] = []
    for p in parts:
        flat += p[1] if isinstance(p, tuple) and p[0] == word else (p,)
    flat = list(dict.fromkeys(flat))
    return (word, tuple(flat)) if len(flat) > 1 else flat[0] if flat else None


def one_of(texts: frozenset[bytes]) -> Query:
    """What holds of every text that has one of ``texts`` in it."""
    return either(*(both(*(t[i] << 16 | t[i + 1] << 8 | t[i + 2] for i in range(len(t) - 2))) for t in sorted(texts)))


@dataclass(frozen=True)
class Facts:
    """What is known of the texts a part of a pattern matches (as lower-cased bytes).

    ``exact``: all of them, if few; ``first`` and ``last``: one of which each starts and ends with;
    ``holds``: a query that each satisfies.
    """

    exact: frozenset[bytes] | None
    first: frozenset[bytes]
    last: frozenset[bytes]
    holds: Query = None


NOTHING = frozenset([b""])
UNKNOWN = Facts(None, NOTHING, NOTHING)


def known(texts: frozenset[bytes]) -> Facts:
    return Facts(texts, texts, texts) if len(texts) <= MOST else Facts(None, few(texts, False), few(texts, True), one_of(texts))


def few(texts: frozenset[bytes], tail: bool) -> frozenset[bytes]:
    """Shorter ends of texts, two bytes at most if they are many, or nothing."""
    for size in (None, 2, 1):
        cut = texts if size is None else frozenset(t[-size:] if tail else t[:size] for t in texts)
        if len(cut) <= MOST:
            return cut
    return NOTHING


def followed(x: Facts, y: Facts) -> Facts:
    """The facts of x and then y."""
    cross = lambda a, b: frozenset(s + t for s in a for t in b)
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= MOST:
        return Facts(cross(x.exact, y.exact), cross(x.exact, y.exact), cross(x.exact, y.exact))
    first = few(cross(x.exact, y.first), False) if x.exact is not None else x.first
    last = few(cross(x.last, y.exact), True) if y.exact is not None else y.last
    sides = [p.holds if p.exact is None else one_of(p.exact) for p in (x, y)]
    border = one_of(cross(frozenset(t[-2:] for t in x.last), frozenset(t[:2] for t in y.first)))
    whole = [one_of(first)] if x.exact is not None else []
    return Facts(None, first, last, both(*sides, border, *whole))


def alternatives(parts: list[Facts]) -> Facts:
    if all(p.exact is not None for p in parts):
        return known(frozenset().union(*(p.exact for p in parts)))
    query = either(*(p.holds if p.exact is None else one_of(p.exact) for p in parts))
    ends = [few(frozenset().union(*sets), tail) for sets, tail in (([p.first for p in parts], False), ([p.last for p in parts], True))]
    return Facts(None, *ends, query)


def _letters(items: list) -> Facts:
    """Facts of a class of characters."""
    points: set[int] = set()
    for op, value in items:
        if op is sre.LITERAL:
            points.add(value)
        elif op is sre.RANGE and value[1] - value[0] < 128:
            points.update(range(value[0], value[1] + 1))
        else:
            return UNKNOWN
        if len(points) > 2 * MOST:
            return UNKNOWN
    texts = frozenset(chr(p).encode().translate(LOWER) for p in points)
    return known(texts) if len(texts) <= MOST else UNKNOWN


def facts(tree: object) -> Facts:
    """Facts of a parsed pattern.  What isn't understood is taken to match anything."""
    out = known(NOTHING)
    for op, value in tree:
        if op is sre.LITERAL:
            part = known(frozenset([chr(value).encode("utf-8", "surrogatepass").translate(LOWER)]))
        elif op is sre.IN:
            part = _letters(value)
        elif op is sre.SUBPATTERN:
            part = facts(value[3])
        elif op is sre.ATOMIC_GROUP:
            part = facts(value)
        elif op is sre.BRANCH:
            part = alternatives([facts(p) for p in value[1]])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, inner = value
            once = facts(inner)
            if least == 0:
                part = alternatives([known(NOTHING), once]) if most == 1 else UNKNOWN
            elif least == most == 1:
                part = once
            else:
                part = Facts(None, once.first, once.last, once.holds if once.exact is None else one_of(once.exact))
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue
        else:
            part = UNKNOWN
        out = followed(out, part)
    return out


def trigram_query(rule: Rule) -> Query:
    """The Boolean query that every text with a match of ``rule`` satisfies; None asks nothing."""
    found = facts(_parser.parse(rule.pattern, re.ASCII | (re.IGNORECASE if rule.fold else 0)))
    return found.holds if found.exact is None else one_of(found.exact)


def trigrams_of(query: Query) -> set[int]:
    return set() if query is None else {query} if isinstance(query, int) else set().union(*map(trigrams_of, query[1]))


def matching(query: Query, postings: dict[int, np.ndarray], size: int) -> np.ndarray:
    """Which of ``size`` documents satisfy a query."""
    if query is None:
        return np.ones(size, bool)
    if isinstance(query, int):
        return postings.get(query, np.zeros(size, bool))
    parts = [matching(q, postings, size) for q in query[1]]
    return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)


def text_trigrams(text: bytes) -> np.ndarray:
    """Sorted distinct trigrams of a text, lower-cased."""
    b = np.frombuffer(text.translate(LOWER), np.uint8).astype(np.uint32)
    t = np.sort((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) if len(b) > 2 else np.empty(0, np.uint32)
    return t[np.concatenate(([True], t[1:] != t[:-1]))] if len(t) else t


def packed(docs: np.ndarray, size: int) -> bytes:
    """Documents as 16-bit numbers, or as a bit map where that is shorter."""
    if (size + 7) // 8 < 2 * len(docs):
        bits = np.zeros(size, bool)
        bits[docs] = True
        return np.packbits(bits).tobytes()
    return docs.astype("<u2").tobytes()


def unpacked(data: bytes, count: int, size: int) -> np.ndarray:
    if len(data) != 2 * count:
        return np.unpackbits(np.frombuffer(data, np.uint8), count=size).astype(bool)
    out = np.zeros(size, bool)
    out[np.frombuffer(data, "<u2")] = True
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, h1, h2): null texts are empty, and two hashes name a text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))


def build_index(texts: DataFrame) -> DataFrame:
    """(trigram, segment, count, docs) of texts (text, h1, h2), by trigram; DIRECTORY rows hold a segment's hashes."""

    def segment(number: int, held: dict[tuple[int, int], bytes]) -> pa.RecordBatch:
        found = [text_trigrams(t) for t in held.values()]
        gram, doc = np.concatenate(found), np.repeat(np.arange(len(found)), [len(t) for t in found])
        order = np.argsort(gram, kind="stable")
        gram, doc = gram[order], doc[order]
        starts = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.empty(0, np.int64)
        ends = np.append(starts[1:], len(gram))
        lists = [packed(doc[a:b], len(held)) for a, b in zip(starts.tolist(), ends.tolist())]
        columns = [
            pa.array(np.append(gram[starts].astype(np.int32), np.int32(DIRECTORY))),
            pa.array(np.full(len(starts) + 1, number)),
            pa.array(np.append(ends - starts, len(held)).astype(np.int32)),
            pa.array([*lists, np.array(list(held), "<i8").tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["trigram", "segment", "count", "docs"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, {}, 0
        for batch in batches:
            for text, h1, h2 in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if (h1, h2) in held:
                    continue
                held[h1, h2] = text.as_py()
                size += len(held[h1, h2])
                if size >= SEGMENT_BYTES or len(held) == SEGMENT_DOCS:
                    yield segment(number, held)
                    number, held, size = number + 1, {}, 0
        if held:
            yield segment(number, held)

    rows = texts.select("text", "h1", "h2").mapInArrow(make, "trigram int, segment long, count int, docs binary")
    return rows.sortWithinPartitions("trigram", "segment")


def candidates(index: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """(h1, h2, rules): texts that satisfy a query, and the queries, by number, as bits."""
    needed = sorted(set().union(*map(trigrams_of, queries.values())))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in by_run(batches, ["segment"]):
            rows = {r["trigram"]: r for r in run.select(["trigram", "count", "docs"]).to_pylist()}
            directory = rows.pop(DIRECTORY)
            size = directory["count"]
            postings = {t: unpacked(r["docs"], r["count"], size) for t, r in rows.items()}
            rules = np.zeros(size, np.int64)
            for k, query in queries.items():
                rules |= matching(query, postings, size).astype(np.int64) << k
            at = np.flatnonzero(rules)
            names = np.frombuffer(directory["docs"], "<i8").reshape(-1, 2)[at]
            yield pa.RecordBatch.from_arrays([pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(rules[at])], ["h1", "h2", "rules"])

    some = index.where(F.col("trigram").isin([DIRECTORY, *needed]))
    dealt = some.repartition("segment").sortWithinPartitions("segment", "trigram")
    return dealt.mapInArrow(look, "h1 long, h2 long, rules long").distinct()


SPANS = "array<struct<start:int,kind:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def searched(texts: DataFrame, rules: dict[int, Rule], keep_all: bool) -> DataFrame:
    """``texts`` with their text replaced by spans of those ``rules`` that column rules (bits) names; rows without go unless ``keep_all``."""
    names = [c for c in texts.columns if c not in ("text", "rules")]
    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            found = []
            for text, mask in zip(table.column("text"), table.column("rules").to_pylist()):
                text = text.as_py()
                found.append(sorted((a, k, b) for k, r in rules.items() if mask >> k & 1 for a, b in r.spans(text)))
            rows = [[{"start": a, "kind": k, "end": b} for a, k, b in spans] for spans in found]
            out = table.select(names).append_column("spans", pa.array(rows, _SPANS))
            if not keep_all:
                out = out.filter(pa.array([bool(f) for f in found]))
            yield from out.combine_chunks().to_batches()

    return texts.mapInArrow(search, f"{kinds}, spans {SPANS}")


def verified(texts: DataFrame, wanted: DataFrame, rules: dict[int, Rule], bits: int = 23) -> DataFrame:
    """(h1, h2, spans) of ``wanted`` (h1, h2, rules), each text searched once.

    A bit map of fixed size, built by aggregation and broadcast, drops texts that are surely
    not wanted before any is shuffled; the join decides.
    """
    spot = F.pmod("h1", F.lit(1 << bits))
    at, bit = F.shiftright(spot, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int")).alias("bit")
    marks = wanted.select(at, bit).groupBy("at").agg(F.bit_or("bit").alias("bits"))  # 2 ** (bits - 6) rows at most
    some = texts.select("text", "h1", "h2", at, bit).join(F.broadcast(marks), "at").where(F.col("bit").bitwiseAND(F.col("bits")) != 0)
    once = some.groupBy("h1", "h2").agg(F.first("text").alias("text"))
    return searched(once.join(wanted, ["h1", "h2"]), rules, keep_all=False)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every document; spans are structs (start, kind, end), kind being the number of a rule, in that order."""
    queries = dict(enumerate(map(trigram_query, rules)))
    asked = {k: q for k, q in queries.items() if q is not None}
    texts = keyed(docs, id_col, text_col)
    free = {k: rules[k] for k, q in queries.items() if q is None}
    every = searched(texts.withColumn("rules", F.lit(sum(1 << k for k in free)).cast("long")), free, keep_all=True)
    if not asked:
        return every.select("id", "spans")
    index = stash(build_index(texts), "trigrams")
    wanted = stash(candidates(index, asked), "candidates")
    discard(index)
    found = stash(verified(texts, wanted, dict(enumerate(rules))), "found")
    more = found.select("h1", "h2", F.col("spans").alias("more"))
    joined = every.join(more, ["h1", "h2"], "left")
    return joined.select("id", F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast(SPANS)))).alias("spans"))


def count_of(spans: str, kind: int) -> Column:
    """How many spans are of a kind, by its number."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
