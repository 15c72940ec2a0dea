"""Token counts from distinct pre-tokens, and packed ids of whole texts.

A byte-level BPE never merges across pre-tokens, so a text's token count is the sum
over its pre-tokens of their piece counts.  Each distinct pre-token is encoded once;
per-document pre-token frequencies are joined to those counts and summed, and no ids
are kept.

Texts are cut by the library's pattern in the ``regex`` module where every character
is one on which both sides' Unicode tables agree, and by the library itself
elsewhere.  Tests compare both on every code point of the fast range.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import stash

# The split patterns of the two public tokenizers.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Characters outside the range where the fast cut is known to equal the library's.
_SLOW_BYTE = regex.compile(r"[^\x00-՗ -⁯₠-₿]")
_SLOW_WORD = regex.compile(r"[^\x00-ɏ‐-‧‰-⁞₠-₿]")


def _latin_class(major: str) -> str:
    """The Latin-1 characters of a Unicode major category, as the inside of a character class."""
    return "".join(re.escape(c) for c in map(chr, range(256)) if unicodedata.category(c)[0] == major)


# The same two patterns over Latin-1 alone, where the standard library's engine is twice as fast.
# Letters come first; no other alternative starts with one.
_L, _N = _latin_class("L"), _latin_class("N")
_S = r"\t-\r \x85\xa0"
_LATIN_BYTE = re.compile(
    rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)
_LATIN_WORD = re.compile(rf"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[{_N}]|[^{_S}{_L}{_N}]+")


def is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


#: Distinct pre-tokens a Python worker gathers before it sends them on.
CACHE = 60_000
#: Characters a Python worker cuts before it looks pieces up and sends them on.
CHARACTERS = 1_000_000
#: Words whose ids a Python worker remembers.
WORD_CACHE = 1_000_000


class PreTokens:
    """Cuts texts as a byte-level tokenizer file does, and counts pieces of pre-tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
            raise ValueError("only a plain byte-level tokenizer without a normalizer counts by pre-token")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with strip or word rules are not supported")
        self.path = path
        self.pattern = regex.compile(BYTE_LEVEL)
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """Loaded where pieces are counted; most texts are cut without it."""
        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    def cut(self, text: str) -> tuple[list[str], int]:
        """The text's pre-tokens, and how many added tokens stand between them."""
        parts, n = [text], 0
        if self.added is not None and self.added.search(text):
            parts = self.added.split(text)
            n = len(parts) - 1
        out: list[str] = []
        for part in parts:
            if is_latin(part):
                out += _LATIN_BYTE.findall(part)
            elif _SLOW_BYTE.search(part) is None:
                out += self.pattern.findall(part)
            else:
                out += [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return out, n

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        """Pieces of each pre-token, encoded one by one: a batch would start a thread pool in each worker."""
        encode = self.tokenizer.encode
        return [len(encode(p, add_special_tokens=False)) for p in pre_tokens]


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = 1 << 20
) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, n_pre_tokens.

    Pre-tokens that make up at least one in ``frequent`` of all occurrences, or for each 64
    characters that many, are summed from a broadcast table: at most ``frequent`` strings of
    ``64 * frequent`` characters together.  Every other goes through a shuffle join on the
    pre-token, where no key can be hot.
    Null and empty texts count 0; repeated rows are counted each; a null id is kept;
    extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    id_type = rows.schema["id"].dataType.simpleString()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, seen = PreTokens(path), Counter()

        def flush() -> pa.RecordBatch:
            out = [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays(out, ["piece", "n"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(cutter.cut(text.as_py())[0])
                if len(seen) > CACHE:
                    yield flush()
        if seen:
            yield flush()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = PreTokens(path)
        for batch in batches:
            counts = cutter.pieces(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], ["piece", "n", "tokens"])

    vocabulary = rows.select("text").mapInArrow(frequencies, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    vocabulary = stash(vocabulary.mapInArrow(encode, "piece string, n long, tokens long"), "pieces")
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    is_frequent = F.col("n") * F.lit(float(frequent)) >= F.greatest(F.lit(1.0), F.length("piece") / 64) * F.lit(total)
    top = vocabulary.where(is_frequent).select("piece", "tokens").toArrow().combine_chunks()
    pieces, tokens = (top.column(i).combine_chunks() for i in range(2))
    known = spark.sparkContext.broadcast((pieces, tokens.to_numpy()))
    names = ["piece", "row", "n", "id", "n_bytes", "n_pre", "tokens"]

    def per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = PreTokens(path)
        frequent_pieces, frequent_tokens = known.value

        def counted(some: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """One row per document with what the frequent pieces give, then one per rare piece and document."""
            pieces, counts, ends, n_bytes, n_pre, added = [], [], [0], [], [], []
            for text in some.column(2):
                text = text.as_py()
                pre, n = cutter.cut(text)
                each = Counter(pre)
                pieces += each
                counts += each.values()
                ends.append(len(pieces))
                n_bytes.append(len(text.encode()))
                n_pre.append(len(pre) + n)
                added.append(n)
            piece, n = pa.array(pieces, pa.string()), np.array(counts, np.int64)
            doc = np.repeat(np.arange(len(some)), np.diff(ends))
            at = pc.index_in(piece, frequent_pieces)
            rare = at.is_null().to_numpy(zero_copy_only=False)
            tokens = np.array(added, np.int64)
            if len(frequent_pieces):
                np.add.at(tokens, doc[~rare], frequent_tokens[at.fill_null(0).to_numpy()[~rare]] * n[~rare])
            row = some.column(0).to_numpy()
            keys = pa.array([f"\0{r}" for r in row.tolist()], pa.string())  # equal to no pre-token
            whole = [pa.array(x, pa.int64()) for x in (n_bytes, n_pre, tokens)]
            yield pa.RecordBatch.from_arrays([keys, some.column(0), pa.array(np.zeros(len(row), np.int64)), some.column(1), *whole], names)
            rest = np.flatnonzero(rare)
            none = [pa.nulls(len(rest), t) for t in (some.column(1).type, pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([piece.take(pa.array(rest)), pa.array(row[doc[rest]]), pa.array(n[rest]), *none], names)

        for batch in batches:
            lengths = pc.utf8_length(batch.column(2)).to_numpy()
            cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // CHARACTERS)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
                yield from counted(batch.slice(a, b - a))

    parts = rows.mapInArrow(
        per_document, f"piece string, row long, n long, id {id_type}, n_bytes long, n_pre long, tokens long"
    )
    rest = vocabulary.where(~is_frequent).select("piece", F.col("tokens").alias("each"))
    return (
        parts.join(rest, "piece", "left")
        .groupBy("row")
        .agg(
            F.any_value("id", True).alias("id"),
            F.sum("n_bytes").alias("n_bytes"),
            F.sum(F.coalesce("tokens", F.lit(0)) + F.col("n") * F.coalesce("each", F.lit(0))).alias("n_tokens"),
            F.sum("n_pre").alias("n_pre_tokens"),
        )
        .drop("row")
    )


class WordIds:
    """Ids of whole texts as little-endian 32-bit bytes, by a word-level BPE file.

    Words are looked up in a bounded cache, so each is encoded about once per worker.
    Texts with added-token strings or characters outside the fast range go to the
    library whole.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = [t["content"] for t in spec["added_tokens"]]
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.fast = split == WORD_LEVEL and steps == ["NFC", "Replace", "Lowercase"]
        self.pattern = regex.compile(WORD_LEVEL)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.is_end = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.is_end[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, encoded as one text: a space keeps them apart, end marks show where each ends."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("a word did not encode to ids that end in one end mark")
        raw, at = ids.tobytes(), (ends * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *at], at)]

    def encode(self, text: str) -> bytes:
        if not self.fast or (self.added is not None and self.added.search(text)):
            return self._whole(text)
        if is_latin(text):
            words = _LATIN_WORD.findall(text.lower())
        elif _SLOW_WORD.search(text) is None:
            words = self.pattern.findall(text.lower())
        else:
            return self._whole(text)
        known = self.cache
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if len(known) > WORD_CACHE:
                known.clear()
            missing = [w for w in dict.fromkeys(words) if w not in known]
            known.update(zip(missing, self._words(missing)))
            return b"".join([known[w] for w in words])


def cut_pieces(
    docs: DataFrame, path: str, most: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece: row, id, piece, start, length, ids_crc32 (and ids, if asked).

    A document is its ids and then ``end_id``; only longer ones than ``most`` are cut,
    every ``most`` ids.  A null or empty text is the end id alone.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type, end = rows.schema["id"].dataType.simpleString(), end_id.to_bytes(4, "little")
    names = ["row", "id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds(path)
        for batch in batches:
            cols: tuple[list, ...] = tuple([] for _ in names)
            types = [pa.int64(), batch.column(1).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            for row, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                buf = encoder.encode(text.as_py()) + end
                for p, at in enumerate(range(0, len(buf), 4 * most)):
                    part = buf[at : at + 4 * most]
                    values = [row, key, p, at // 4, len(part) // 4, zlib.crc32(part)]
                    if with_ids:
                        values.append([int.from_bytes(part[i : i + 4], "little") for i in range(0, len(part), 4)])
                    for col, v in zip(cols, values):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    schema = f"row long, id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(cut, schema)
