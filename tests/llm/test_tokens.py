"""Token operators against the tokenizers library itself."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from matewise.llm import packing, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "",
    None,
    "   ",
    "\n\n a\t b\x85c\xa0d \x1c\x1d x\x1fy ",
    "it's they'll WE'RE don't '' 'sx",
    "<|endoftext|>a<|endoftext|><|startoftext|> b",
    "naïve Ångström ½ ² ª straße ŒUVRE İstanbul ΑΣΣΟΣ é 日本語 👩‍👩‍👧 \U00010940",
    "a1b22c333!!??..__--",
    "word " * 5000,
    "Same text.",
    "Same text.",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


def test_every_fast_character_is_cut_as_the_library_does(library):
    byte, word = library
    pre, ids = tokens.PreTokens(BYTE), tokens.WordIds(WORD)
    for cp in [*range(0x558), *range(0x2000, 0x2070), *range(0x20A0, 0x20C0)]:
        c = chr(cp)
        for text in (f"a{c}b", f"1{c}2", f".{c}!", f" {c} ", f"{c}{c}s", f"'{c}", f"  {c}\n"):
            assert pre.cut(text)[0] == [text[a:b] for _, (a, b) in byte.pre_tokenizer.pre_tokenize_str(text)], (cp, text)
            want = np.array(word.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            assert ids.encode(text) == want, (cp, text)


def test_counts_equal_the_library(spark, library):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x")], "doc_id long, text string, n_tokens string")
    got = {r["id"]: r for r in tokens.count_tokens(docs, BYTE, frequent=16).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        assert got[i]["n_tokens"] == len(library[0].encode(t or "", add_special_tokens=False).ids)
        assert got[i]["n_bytes"] == len((t or "").encode())


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.count_tokens(docs, BYTE).count() == 0
    assert packing.pack(docs, WORD).count() == 0


def test_packed_pieces_are_the_documents_and_sequences_have_no_gaps(spark, library):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = packing.pack(docs, WORD, most=64).collect()
    seen, sequences = {}, {}
    for r in rows:
        seen[r["id"], r["piece"]] = (r["start"], r["length"], r["ids_crc32"])
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = {}
    for i, t in enumerate(TEXTS):
        ids = np.array([*library[1].encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for p in range(0, len(ids), 64):
            want[i, p // 64] = (p, len(ids[p : p + 64]), zlib.crc32(ids[p : p + 64].tobytes()))
    assert seen == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_packing_ignores_clashing_columns_and_takes_long_and_equal_rows(spark, library):
    rows = [(1, "word " * 60_000, 7, "x"), (2, "same", 8, "y"), (2, "same", 8, "y"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, sequence_id string")
    got = packing.pack(docs, WORD).collect()
    n = len(library[1].encode("word " * 60_000, add_special_tokens=False).ids) + 1
    assert sum(r["length"] for r in got if r["id"] == 1) == n and [r["length"] for r in got if r["id"] == 2] == [2, 2]
    assert [(r["length"], r["piece"]) for r in got if r["id"] is None] == [(1, 0)]
    assert len({r["sequence_id"] for r in got}) == -(-(n + 5) // 2048)


def test_long_frequent_pre_tokens_are_no_join_key(spark, library):
    long = "x" * 5000
    docs = spark.createDataFrame([(i, f"{long} a{i}") for i in range(50)], "doc_id long, text string")
    want = {i: len(library[0].encode(f"{long} a{i}", add_special_tokens=False).ids) for i in range(50)}
    for frequent in (1, 200, 1 << 20):
        assert {r["id"]: r["n_tokens"] for r in tokens.count_tokens(docs, BYTE, frequent=frequent).collect()} == want


def test_sum_of_squares_takes_the_smallest_sum():
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 33, 300))[::-1]
    bins, offsets = packing.sum_of_squares(lengths, 32)
    gaps: dict[int, int] = {}
    for size, b, offset in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
        open_now = list(gaps.values())

        def cost(gap):  # of the whole state, after placing into a bin with this gap (32: a new one)
            after = [g for g in open_now]
            if gap < 32:
                after.remove(gap)
            after.append(gap - size)
            return sum(after.count(g) ** 2 for g in set(after) - {0})

        costs = {g: cost(g) for g in set(open_now) if g >= size}
        chosen = gaps.get(b, 32)
        if chosen < 32:
            assert costs[chosen] == min(costs.values())
        else:
            assert not costs  # a new one only where none has room
        assert offset == 32 - chosen
        gaps[b] = chosen - size
        if not gaps[b]:
            del gaps[b]
    assert len(set(bins.tolist())) <= 1.05 * int(lengths.sum()) / 32
