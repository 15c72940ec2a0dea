"""Language ID by language-bitmask n-gram filters.

The filters of all languages share one table of bit slices: ``slices[:, p]`` holds bit p
of every language's Bloom filter side by side, 64 languages to a word.  An n-gram reads the
slices at its hash positions and ANDs them, which gives the set of all languages that contain
it in one step.  A text's n-grams add up to one popcount per language; each is corrected for
that filter's false-positive rate, and the largest decides.

A language's filter holds the n-grams that make up at least ``least_share`` of its
training n-grams, so at most ``1 / least_share`` of them, and whose share is at least
``near`` times the largest share in any language.

Edge cases: a null text or one without a letter is ``und`` with score 0; a text whose
n-grams no filter knows gets the first language by name with score 0; equal counts go
to the first language by name; with nothing to learn from, every text is ``und``.
Rows without a language or text teach nothing.  Texts are read whole, in blocks of a
million characters.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stash

UNKNOWN = "und"
BLOCK = 1 << 20
SIZES = (2, 3, 4)
HASHES = 3
#: N-grams whose counts a task adds up before it passes them on.
FLUSH = 2_000_000


@cache
def letter_table() -> np.ndarray:
    """Code point to lower-case letter, or to a space for all that is no letter."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if unicodedata.category(c)[0] in "LM":
            out[cp] = ord(c.lower()) if len(c.lower()) == 1 else cp
    return out


def grams(text: str) -> np.ndarray:
    """64-bit hashes of the 2-, 3- and 4-grams of one block, non-letters being single spaces."""
    codes = letter_table()[np.frombuffer(f" {text} ".encode("utf-32-le"), dtype="<u4")]
    space = codes == 32
    codes = codes[~(space & np.concatenate(([False], space[:-1])))].astype(np.uint64)
    out, h = [], codes * np.uint64(0x9E3779B97F4A7C15)
    for n in range(2, max(SIZES) + 1):
        if len(codes) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + codes[n - 1 :] * np.uint64(0x94D049BB133111EB)
        if n in SIZES:
            out.append(h ^ (h >> np.uint64(32)))
    return np.concatenate(out) if out and (codes != 32).any() else np.empty(0, np.uint64)


def positions(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The filter positions of each n-gram."""
    step = (h >> np.uint64(33)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64((1 << bits) - 1)).astype(np.int64) for i in range(HASHES)]


def blocks(text: str) -> Iterator[str]:
    for at in range(0, len(text), BLOCK):
        yield text[at : at + BLOCK + max(SIZES) - 1]


@dataclass(frozen=True)
class LanguageFilters:
    languages: tuple[str, ...]
    slices: np.ndarray
    bits: int
    false_rate: np.ndarray

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """Corrected counts per language, and the number of n-grams."""
        hits, n = np.zeros(len(self.languages)), 0
        for block in blocks(text):
            h = grams(block)
            n += len(h)
            if not len(h):
                continue
            at = positions(h, self.bits)
            for k, slices in enumerate(self.slices):
                mask, some = slices[at[0]], len(self.languages[64 * k : 64 * k + 64])
                for p in at[1:]:
                    mask &= slices[p]
                if some <= 16:
                    seen = np.bincount(mask.astype(np.int64), minlength=1 << some)
                    which = np.arange(len(seen))
                    found = [seen[(which >> i) & 1 == 1].sum() for i in range(some)]
                else:
                    found = [np.count_nonzero(mask & np.uint64(1 << i)) for i in range(some)]
                hits[64 * k : 64 * k + some] += found
        return np.maximum(hits - n * self.false_rate, 0) / (1 - self.false_rate), n

    def best(self, text: str | None) -> tuple[str, float, int]:
        """The likeliest of these languages, its corrected count and the number of n-grams; UNKNOWN if there are none."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0
        hits, n = self.counts(text)
        if not n:
            return UNKNOWN, 0.0, 0
        best = int(np.argmax(hits))
        return self.languages[best], float(hits[best]), n


@dataclass(frozen=True)
class Learned:
    """Filters of any number of languages, of which ``block`` (a multiple of 64) are held in memory together."""

    languages: tuple[str, ...]
    bits: int
    false_rate: np.ndarray
    marks: DataFrame | None  # (word, at, mask): a stashed table of slices
    block: int

    def blocks(self) -> Iterator[LanguageFilters]:
        for first in range(0, len(self.languages), self.block):
            names = self.languages[first : first + self.block]
            some = self.marks.where(F.col("word").between(first // 64, (first + len(names) - 1) // 64)).toArrow()
            slices = np.zeros((-(-len(names) // 64), 1 << self.bits), dtype=np.uint64)
            slices[some.column(0).to_numpy() - first // 64, some.column(1).to_numpy()] = some.column(2).to_numpy().view(np.uint64)
            yield LanguageFilters(names, slices, self.bits, self.false_rate[first : first + len(names)])

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score of one text."""
        found = [b.best(text) for b in self.blocks()] or [(UNKNOWN, 0.0, 0)]
        lang, hits, n = max(found, key=lambda x: x[1])  # the first of equals
        return lang, min(1.0, hits / n) if n else 0.0


def fit(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    most_rows: int = 20_000,
    bits: int = 20,
    least_share: float = 1e-5,
    near: float = 0.3,
    block_languages: int = 1024,
) -> Learned:
    """Learn the filters from about ``most_rows`` labelled rows, those with the smallest hashes of id and text.

    Each language has an equal part of the sample, and is taken whole where it has fewer rows.
    The sample bound is the only one; every row counts towards what fraction of its language it is.
    Counting is distributed; the driver receives a row for each language, and at most ``2 ** bits`` slices for
    each 64 of ``block_languages`` languages at a time.  Every language is learned, however many there are.
    """
    if block_languages < 64 or block_languages % 64:
        raise ValueError("block_languages must be a multiple of 64")
    spark = labelled.sparkSession
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.lit("fit"), F.col(id_col), F.col(text_col)), F.lit(1 << 40)).alias("draw")
    )
    per = sorted(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())
    languages = tuple(r["lang"] for r in per)
    if not languages:
        return Learned((), bits, np.zeros(0), None, block_languages)
    each = most_rows / len(languages)
    limits = [(r["lang"], i, int((1 << 40) * min(1.0, each / r["n"]))) for i, r in enumerate(per)]
    index = F.broadcast(spark.createDataFrame(limits, "lang string, bit int, most long"))  # a row for each language, as on the driver
    sample = rows.join(index, "lang").where(F.col("draw") < F.col("most"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[str, list[np.ndarray]] = defaultdict(list)
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                which, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(which), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for block in blocks(text.as_py()):
                    held[lang].append(grams(block).view(np.int64))
                    size += len(held[lang][-1])
                    if size > FLUSH:
                        yield from flush()
                        size = 0
        yield from flush()

    counted = (
        sample.select("lang", "text")
        .mapInArrow(count, "lang string, gram long, n long")
        .groupBy("gram", "lang")
        .agg(F.sum("n").alias("n"))
    )
    counted = stash(counted, "grams")
    sums = F.broadcast(counted.groupBy("lang").agg(F.sum("n").alias("all_n")).join(index, "lang"))
    shares = counted.join(sums, "lang").select("gram", "bit", (F.col("n") / F.col("all_n")).alias("share"))
    per_gram = shares.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("bit", "share")).alias("in"))
    kept = F.filter("in", lambda x: (x["share"] >= least_share) & (x["share"] >= F.col("top") * near))
    held = stash(per_gram.select("gram", F.explode(kept).alias("x")).select("gram", "x.bit"), "held")
    full = np.zeros(len(languages))
    for r in held.groupBy("bit").count().collect():
        full[r["bit"]] = r["count"]
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))
    masks = held.groupBy("gram", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(one).alias("mask"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(positions(batch.column(0).to_numpy().view(np.uint64), bits))
            rest = [pa.array(np.tile(batch.column(k).to_numpy(), HASHES)) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(at), *rest], ["at", "word", "mask"])

    set_bits = masks.mapInArrow(spread, "at long, word int, mask long").groupBy("word", "at").agg(F.bit_or("mask").alias("mask"))
    marks = stash(set_bits, "slices")
    discard(counted, held)
    return Learned(languages, bits, (1 - np.exp(-HASHES * full / (1 << bits))) ** HASHES, marks, block_languages)


def predict(docs: DataFrame, filters: Learned, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Add the predicted language and its score (the corrected share of known n-grams, 0 to 1).

    All columns of ``docs`` stay; one named like an output is replaced.  Only the text is
    read by the prediction.  Each block of languages is a pass over the texts; where there are several,
    the best so far is written with the rows between them, so one block at a time is broadcast.
    """
    names = docs.drop(lang_out, score_out).columns
    docs = docs.select(*names, F.lit(UNKNOWN).alias("__best"), F.lit(0.0).alias("__hits"), F.lit(0).cast("long").alias("__n"))
    schema, at, spark = docs.schema, names.index(text_col), docs.sparkSession

    def told(docs: DataFrame, known: Broadcast) -> DataFrame:
        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = known.value
            for batch in batches:
                before = zip(*(batch.column(k).to_pylist() for k in range(len(names), len(names) + 3)))
                out = []
                for text, held in zip(batch.column(at), before):
                    found = model.best(text.as_py())
                    out.append(found if held[0] == UNKNOWN or found[1] > held[1] else held)
                kinds = (pa.string(), pa.float64(), pa.int64())
                columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *columns], batch.schema.names)

        return docs.mapInArrow(tell, schema)

    last = None
    for block in filters.blocks():
        if last is not None:
            docs = stash(docs, "languages")
            last.destroy()
        last = spark.sparkContext.broadcast(block)
        docs = told(docs, last)
    score = F.when(F.col("__n") > 0, F.least(F.lit(1.0), F.col("__hits") / F.col("__n"))).otherwise(0.0)
    return docs.select(*names, F.col("__best").alias(lang_out), score.alias(score_out))


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Rows kept from training: CRC-32 of the id as text leaves 2 modulo 4."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))
