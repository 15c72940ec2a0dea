"""Collocations against a plain count of every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from matewise.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest=5, top=2000):
    f, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, min(longest, len(words) - i) + 1):
                    f[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        n, found = sizes[lang], []
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        held = {p[i:j] for p in candidates for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and candidates[p] >= candidates[p[i:j]]}
        for p, a in candidates.items():
            score, k = min((1000 * a * n // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if p not in held:
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["a", "b", "ab", "a\x01", "A", "é", "c.d", "long-word", "x"]
    out = []
    for _ in range(n):
        parts = rng.choices(words, [9, 7, 5, 2, 3, 2, 1, 1, 1], k=rng.randrange(40))
        out.append((rng.choice(["en", "en", "fr", None]), "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", "\r\n", " | "]) for w in parts)))
    return out + [("en", None), ("fr", ""), ("de", "..."), ("en", "the same line again and again " * 30)]


def run(spark, rows, **more):
    frame = spark.createDataFrame([(i % 3, lang, text, 1, "x") for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, n long, phrase string")
    got = collocations.collocations(frame, **more)
    assert [t for _, t in got.dtypes] == ["string", "int", "string"] + ["bigint"] * 5
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("most_rows", [200_000, 5])
def test_equals_a_plain_count(spark, monkeypatch, most_rows):
    monkeypatch.setattr(collocations, "FLUSH", 700)
    rows = texts(3, 400)
    want = plain(rows, 8)
    assert any(len(r[2].split(" ")) == 5 for r in want)
    assert run(spark, rows, least=8, most_rows=most_rows) == want


def test_ranks_and_ties(spark):
    rows = texts(4, 120)
    assert run(spark, rows, least=3, top=7) == plain(rows, 3, top=7)
    assert run(spark, [], least=1) == []
    assert run(spark, [("en", None), (None, " \t")], least=1) == []


def test_scores_pass_64_bits(spark):
    rows = [(10**12 + 7, 10**14 + 3, 10**12 + 9, 10**13 + 1), (100, 9 * 10**17, 100, 101), (3, 7, 2, 5), (10**15, 10**16, 10**15, 10**15)]
    frame = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = frame.select(collocations.score(*(F.col(c) for c in "anlr")).alias("s"))
    assert got.dtypes == [("s", "bigint")]
    assert [r["s"] for r in got.collect()] == [1000 * a * n // (left * right) for a, n, left, right in rows]


def test_one_text_larger_than_a_flush(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FLUSH", 50)
    rows = [("en", " ".join(w for _, t in texts(5, 60) for w in (t or "").split()))]
    assert run(spark, rows, least=6) == plain(rows, 6)


def test_equal_lines_in_a_third_of_all_rows_are_one_projection(spark):
    rows = [("en", "one very common line of words")] * 3000 + [r for r in texts(6, 200) if r[0] and r[1]]
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    words = collocations.word_map(spark.createDataFrame([("en", w) for w in "one very common line of words".split()], "lang string, phrase string"))
    pairs = collocations.pair_map(frame, words, 3000)
    got = {r["phrase"]: r["n"] for r in collocations.projections(frame, words, pairs, 5).where("lang = 'en'").collect()}
    for phrase in ("one very", "line of", "one very common line of", "very common line of words", "common line of words", "line of words"):
        assert got[phrase] == 3000
