"""Phrase collocations by PrefixSpan-style contiguous pattern growth.

Every occurrence of a frequent two-word prefix is projected: its pointer carries what follows it,
up to the longest phrase, and ends where a word pair is not frequent any more (no longer phrase
can be).  Equal projections are one with a count.  Each prefix's projections go to one task, which
extends the prefix to the right depth-first, one frequent word at a time.  A prefix with more
projections than a task should hold is split: it is counted by an aggregation and its children,
prefixes of one word more, are dealt in its place.

Words and pairs that are frequent are known to the tasks as bit maps of bounded size, which only
leave out what is surely not frequent (pairs are first counted by hash); counts are exact.  A phrase scores ``1000 * a * n / (l * r)``
at its worst cut, in integers of 38 digits.

Edge cases: null and empty texts have no words; a null language is ``und``; repeated rows count
each time; a piece without words is none, and phrases don't pass the border of a piece; an id is
not needed; texts are read whole, however long; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stash
from .neardup import _ODD, mixed
from .runs import by_run

#: Lower case for A-Z, one sign for all that ends a piece, a space for a tab.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
#: Tokens whose counts a task adds up before it passes them on.
FLUSH = 1_500_000


def words_of(text: bytes) -> list[bytes]:
    """A text's words, with a line feed where a piece ends, and empty strings between."""
    return text.translate(PLAIN).replace(b"\n", b" \n ").split(b" ")


class Tokens:
    """Word ids of some texts: 0 is no word, 1 the end of a piece."""

    def __init__(self) -> None:
        self.ids: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.ids[b""], self.ids[b"\n"]
        self.langs: defaultdict[str, int] = defaultdict(count().__next__)
        self.parts: list[np.ndarray] = []
        self.of: list[int] = []
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        found = words_of(text)
        ids = np.fromiter(map(self.ids.__getitem__, found), np.int64, len(found))
        self.parts.append(np.append(ids[ids > 0], 1))
        self.of.append(self.langs[lang])
        self.size += len(self.parts[-1])

    def arrays(self) -> tuple[np.ndarray, np.ndarray, list[bytes], list[str]]:
        """Ids, the language of each, words and languages by number."""
        ids = np.concatenate(self.parts)
        return ids, np.repeat(self.of, [len(p) for p in self.parts]), list(self.ids), list(self.langs)


def batches_of_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
    """The texts of a task (lang, text) as tokens, about FLUSH at a time."""
    held = Tokens()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            held.add(lang, text.as_py())
            if held.size >= FLUSH:
                yield held
                held = Tokens()
    if held.size:
        yield held


def distinct_rows(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first, count) of each distinct row of non-negative columns."""
    code = columns[0]
    for c in columns[1:]:
        base = int(c.max(initial=0)) + 1
        if int(code.max(initial=0)) >= (1 << 62) // base:
            code = np.unique(code, return_inverse=True)[1]
        code = code * base + c
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    return first, n


def batch_of(langs: list[str], phrases: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
    text = pa.array(phrases, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), text, pa.array(counts, pa.int64())], ["lang", "phrase", "n"])


def codes(names: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))


def word_codes(ids: np.ndarray, of: np.ndarray, names: list[bytes], langs: list[str]) -> np.ndarray:
    """A hash of the language and word at each place."""
    return mixed(codes(names)[ids] + _ODD[0] * codes([x.encode() for x in langs])[of])


class BitMap:
    """Hashes that are in a set, or are held by chance: 16 bits for each, 2 ** 27 at most."""

    def __init__(self, hashes: DataFrame):
        """From (code long); what reaches the driver is the map, not the hashes."""
        bits = min(27, max(12, (16 * hashes.count()).bit_length()))
        spot = F.pmod("code", F.lit(1 << bits))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int"))
        rows = hashes.groupBy(F.shiftright(spot, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toPandas()
        held = np.zeros(1 << (bits - 6), np.int64)
        held[rows["at"].to_numpy()] = rows["bits"].to_numpy()
        self.last, self.map = np.uint64((1 << bits) - 1), hashes.sparkSession.sparkContext.broadcast(held)

    def holds(self, code: np.ndarray) -> np.ndarray:
        at = (code & self.last).astype(np.int64)
        return (self.map.value[at >> 6] >> (at & 63)) & 1 == 1


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, phrase, n) of every word, and of all words together, whose phrase is null."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens in batches_of_tokens(batches):
            ids, of, words, langs = tokens.arrays()
            ids, of = ids[ids > 1], of[ids > 1]
            first, n = distinct_rows([of, ids])
            yield batch_of([langs[k] for k in of[first]], [words[k] for k in ids[first]], n)
            sizes = np.bincount(of, minlength=len(langs))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.nulls(len(langs), pa.string()), pa.array(sizes, pa.int64())], ["lang", "phrase", "n"])

    return texts.mapInArrow(counted, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def word_map(words: DataFrame) -> BitMap:
    """The bit map of words (lang, phrase)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, names = (c.to_pylist() for c in batch.columns)
            at = np.arange(len(names))
            code = word_codes(at, at, [x.encode() for x in names], langs)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64))], ["code"])

    return BitMap(words.select("lang", "phrase").mapInArrow(hashed, "code long"))


def frequent_pairs(ids: np.ndarray, code: np.ndarray, words: BitMap) -> tuple[np.ndarray, np.ndarray]:
    """Places that start a pair of frequent words, and hashes of the pairs."""
    good = (ids > 1) & words.holds(code)
    # every text ends with the end of a piece, so a pair never passes from one text to the next
    at = np.flatnonzero(good[:-1] & good[1:])
    return at, mixed(code[at] * _ODD[1] + code[at + 1])


def pair_map(texts: DataFrame, words: BitMap, least: int) -> BitMap:
    """The bit map of pairs that may be frequent: those whose hash is, counted over all texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens in batches_of_tokens(batches):
            ids, of, names, langs = tokens.arrays()
            code, n = np.unique(frequent_pairs(ids, word_codes(ids, of, names, langs), words)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], ["code", "n"])

    found = texts.mapInArrow(counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return BitMap(stash(found.select("code"), "pair-hashes"))


def projections(texts: DataFrame, words: BitMap, pairs: BitMap, longest: int) -> DataFrame:
    """(lang, phrase, n): each pair in the maps, and the up to ``longest`` words from each place where one starts, if three or more."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens in batches_of_tokens(batches):
            ids, of, names, langs = tokens.arrays()
            at, code = frequent_pairs(ids, word_codes(ids, of, names, langs), words)
            at = at[pairs.holds(code)]
            if not len(at):
                continue
            first, n = distinct_rows([of[at], ids[at], ids[at + 1]])
            found = at[first]
            yield batch_of([langs[k] for k in of[found]], [names[a] + b" " + names[b] for a, b in zip(ids[found], ids[found + 1])], n)
            good = np.zeros(len(ids) + longest, bool)
            good[at] = True
            starts = at[good[at + 1]]
            padded = np.append(ids, np.zeros(longest, np.int64))
            going, window = np.ones(len(starts), bool), [padded[starts]]
            for k in range(1, longest):
                going = going & good[starts + k - 1]
                window.append(np.where(going, padded[starts + k], 0))
            first, n = distinct_rows([of[starts], *window])
            rows = zip(*(w[first].tolist() for w in window))
            yield batch_of([langs[k] for k in of[starts[first]]], [b" ".join(names[w] for w in row if w) for row in rows], n)

    return texts.mapInArrow(project, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def grown(projected: DataFrame, depth: int, least: int) -> DataFrame:
    """(lang, phrase, n) of the frequent phrases longer than ``depth`` words, each prefix of ``depth`` words in one task."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in by_run(batches, ["lang", "prefix"]):
            windows = [p.split(" ") for p in run.column("phrase").to_pylist()]
            before = np.concatenate(([0], np.cumsum(run.column("n").to_numpy()))).tolist()
            found: list[tuple[str, int]] = []

            def right(low: int, high: int, at: int) -> None:
                """Extend the prefix of ``at`` words that the projections low to high (sorted) share."""
                while low < high and len(windows[low]) == at:  # what ends here has no extension
                    low += 1
                while low < high:
                    word, end = windows[low][at], low + 1
                    while end < high and windows[end][at] == word:
                        end += 1
                    if before[end] - before[low] >= least:
                        found.append((" ".join(windows[low][: at + 1]), before[end] - before[low]))
                        right(low, end, at + 1)
                    low = end

            right(0, len(windows), depth)
            lang = run.column("lang")[0].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())],
                ["lang", "phrase", "n"],
            )

    rows = projected.select("lang", "prefix", "phrase", "n").repartition("lang", "prefix")
    rows = rows.sortWithinPartitions("lang", "prefix", F.split("phrase", " "))
    return rows.mapInArrow(extend, "lang string, phrase string, n long")


def long_phrases(projected: DataFrame, least: int, longest: int, most_rows: int) -> DataFrame:
    """(lang, phrase, n) of the frequent phrases of three words or more.

    Prefixes with up to ``most_rows`` projections are grown in one task each; larger ones are
    counted, and their children dealt, one word deeper.
    """
    found, rest = None, projected
    for depth in range(2, longest):
        rest = rest.withColumn("prefix", F.substring_index("phrase", " ", depth))
        sizes = rest.groupBy("lang", "prefix").agg(F.count(F.lit(1)).alias("rows"))
        large = stash(sizes.where(F.col("rows") > most_rows).select("lang", "prefix"), "large")
        none = large.isEmpty()
        small = rest if none else rest.join(large, ["lang", "prefix"], "left_anti")
        more = grown(small, depth, least)
        found = more if found is None else found.unionByName(more)
        if none:
            return found
        rest = rest.join(large, ["lang", "prefix"], "left_semi").where(F.size(F.split("phrase", " ")) > depth)
        child = F.substring_index("phrase", " ", depth + 1).alias("phrase")
        counted = rest.groupBy("lang", child).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        found = found.unionByName(counted.select("lang", "phrase", "n"))
    return found


def ends(k: Column) -> Column:
    """The first k words of a phrase, or the last -k."""
    return F.call_function("substring_index", F.col("phrase"), F.lit(" "), k)


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)), exact while products have 38 digits or fewer."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = F.lit(1000).cast("decimal(4,0)") * wide(a) * wide(n)
    return F.call_function("div", top.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def scored(phrases: DataFrame, sizes: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, a, k, l, r, n, score) of phrases of two words or more, at their worst cuts.

    ``phrases`` holds (lang, phrase, n) of every frequent phrase, single words too; ``sizes`` (lang, n).
    """
    words = F.split("phrase", " ")
    longer = phrases.where(F.size(words) > 1).select("lang", "phrase", F.col("n").alias("a"), F.size(words).alias("m"))
    cuts = longer.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"), "m")
    cuts = cuts.withColumn("first", ends(F.col("k"))).withColumn("rest", ends(F.col("k") - F.col("m")))
    for part, out in (("first", "l"), ("rest", "r")):
        known = phrases.select("lang", F.col("phrase").alias(part), F.col("n").alias(out))
        cuts = cuts.join(known, ["lang", part])
    total = F.broadcast(sizes.select("lang", "n")) if sizes.count() <= 100_000 else sizes.select("lang", "n")
    cuts = cuts.join(total, "lang")
    worst = F.min(F.struct(score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r", "a", "n")).alias("w")
    return cuts.groupBy("lang", "phrase").agg(worst).select("lang", "phrase", "w.a", "w.k", "w.l", "w.r", "w.n", "w.score")


def maximal(candidates: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, a) that no longer candidate with the same count holds.

    A phrase never occurs less often than one it is part of, so if any such candidate has the same
    count, then so has one with a single word more.
    """
    words = F.size(F.split("phrase", " "))
    longer = candidates.where(words > 2).select("lang", F.col("a").alias("__a"), "phrase", (words - 1).alias("m"))
    parts = longer.select("lang", "__a", F.explode(F.array(ends(F.col("m")), ends(-F.col("m")))).alias("phrase"))
    most = stash(parts.groupBy("lang", "phrase").agg(F.max("__a").alias("__a")), "inside")
    return candidates.join(most, ["lang", "phrase"], "left").where(F.col("__a").isNull() | (F.col("__a") < F.col("a"))).drop("__a")


def frequent_phrases(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100, longest: int = 5, most_rows: int = 200_000
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of every phrase of up to ``longest`` words that occurs ``least`` times, and (lang, n): all words."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text IS NOT NULL AND text <> ''")
    counted = stash(word_counts(texts).where((F.col("n") >= least) | F.col("phrase").isNull()), "words")
    words = counted.where("phrase IS NOT NULL")
    held = word_map(words)
    projected = stash(projections(texts, held, pair_map(texts, held, least), longest), "projections")
    pair = F.size(F.split("phrase", " ")) == 2
    pairs = stash(projected.where(pair & (F.col("n") >= least)), "pairs")
    longer = stash(long_phrases(projected.where(~pair), least, longest, most_rows), "longer")
    discard(projected)
    return words.unionByName(pairs).unionByName(longer), counted.where("phrase IS NULL").select("lang", "n")


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    least: int = 100,
    longest: int = 5,
    top: int = 2000,
    most_rows: int = 200_000,
) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    phrases, sizes = frequent_phrases(docs, lang_col, text_col, least, longest, most_rows)
    candidates = stash(scored(phrases, sizes, longest), "candidates")
    # the first of each part of a language, then the first of these
    order = [F.desc("score"), F.desc("a"), "phrase"]
    parts = maximal(candidates).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
