"""Secret scans against plain regular expressions on every text."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from matewise.llm import catalogue, secrets

WORDS = ["token", "TOKEN", "secret", "passwd", "password", "api_key", "APIKEY", "ApI_kEy", "toKen", "ſecret", "toKen", "é", "日本", "AKIA", "akia", "x"]
SIGNS = ["=", ":", " = ", '": "', "==", "' : '", " ", "\t=", "\n", ",", "-", "/"]
TAILS = ["abcdefghijkl", "ABCdef0123456789", "0123456789abcdef", "0123456789abcde", "AKIA0123456789ABCD", "AKIA0123456789ABC", "short", "a-b_c.d=e/f+g"]


def random_text(rng):
    return "".join(rng.choice(rng.choice([WORDS, SIGNS, TAILS, SIGNS])) for _ in range(rng.randrange(60)))


def plain(text):
    """kind:start:end of the base kinds, by the patterns as the contract has them."""
    keyword = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    found = []
    for m in re.finditer(keyword + r"""["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
        found += [(m.start(), 0, f"assign:{m.start()}:{m.end()}")] if len(m[1]) >= 12 else []
    for m in re.finditer(r"AKIA[A-Z0-9]+", text or ""):
        found += [(m.start(), 1, f"access:{m.start()}:{m.end()}")] if len(m[0]) >= 18 else []
    for m in re.finditer(r"[0-9a-f]+", text or ""):
        found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}")] if len(m[0]) >= 16 else []
    return [s for _, _, s in sorted(found)]


def found_in(spark, rows):
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, rules long, h1 string")
    out = secrets.find_secrets(frame).select("id", secrets.listed(F.col("spans")).alias("s")).collect()
    return sorted(((r["id"], r["s"]) for r in out), key=str)


def base(listed):
    return ",".join(s for s in listed.split(",") if s.split(":")[0] in ("assign", "access", "hex"))


def test_base_spans_equal_plain_expressions(spark, monkeypatch):
    monkeypatch.setattr(secrets, "SEGMENT_DOCS", 7)
    rng = random.Random(1)
    rows = [(i, random_text(rng)) for i in range(600)]
    rows += [(None, rows[5][1]), (7, rows[7][1]), (7, "token = 'abcdefghijkl'"), (900, None), (901, ""), (902, "ab"), (903, "é" * 5000 + "Secret:" + "z" * 100_000)]
    rows += [(1000 + i, 'password="hunter2hunter2"') for i in range(50)]
    got = found_in(spark, rows)
    assert [(i, base(s)) for i, s in got] == sorted(((i, ",".join(plain(t))) for i, t in rows), key=str)
    assert sum("assign" in s for _, s in got) > 60 and sum("access" in s for _, s in got) > 10


def test_other_kinds_add_spans(spark):
    text = "ghp_" + "a1B2" * 9 + " -----BEGIN RSA PRIVATE KEY----- AIza" + "x" * 35 + " xoxb-1234567890-a eyJhbGciOi.eyJzdWIi.c2ln token=" + "e" * 16
    ((_, spans),) = found_in(spark, [(1, text)])
    assert [s.split(":")[0] for s in spans.split(",")] == ["github", "private_key", "google", "slack", "jwt", "assign", "hex"]
    for part in spans.split(","):
        kind, a, b = part.split(":")
        assert re.fullmatch(next(r for r in secrets.RULES if r.kind == kind).pattern, text[int(a) : int(b)])


def test_no_rows_and_rules_without_trigrams(spark):
    assert found_in(spark, []) == []
    frame = spark.createDataFrame([(1, "a0b1c2d3e4f5a6b7")], "doc_id long, text string")
    assert [len(r["spans"]) for r in secrets.find_secrets(frame, (secrets.RULES[2],)).collect()] == [1]
    assert [len(r["spans"]) for r in secrets.find_secrets(frame, (secrets.RULES[1],)).collect()] == [0]


def holds(query, text):
    grams = set(secrets.text_trigrams(text.encode()).tolist())
    if query is None or isinstance(query, int):
        return query is None or query in grams
    return (all if query[0] == "and" else any)(holds(q, text) for q in query[1])


def test_queries_are_what_matches_need():
    gram = lambda s: int.from_bytes(s.encode(), "big")
    query = lambda p, **more: secrets.trigram_query(secrets.Rule("k", p, **more))
    assert query(r"[0-9a-f]+") is None and query(r"ab") is None and query(r"(abc|d)x*") is None and query(r"(abc)?") is None
    assert query(r"AKIA[A-Z0-9]+") == ("and", (gram("aki"), gram("kia")))
    assert query(r"abc|abcd") == gram("abc")
    assert query(r"ab.*cde") == gram("cde") and query(r"(?:abc)+") == gram("abc")
    assert holds(query(r"x[ab]y"), "--xby") and not holds(query(r"x[ab]y"), "xcy xay"[:3])


SAMPLES = {
    "assign": "Api_Key='abcdefghijkl", "access": "AKIA0123456789ABCDE", "hex": "0123456789abcdef", "private_key": "-----BEGIN EC PRIVATE KEY-----",
    "github": "ghp_" + "a1B2" * 9, "google": "AIza" + "x" * 35, "slack": "xoxb-1234567890", "jwt": "eyJh.eyJz.c2",
}
PATTERNS = {r.pattern: SAMPLES[r.kind] for r in secrets.RULES}
PATTERNS |= {r"a(b|cd)?e{2,}f": "acdeef", r"(foo|ba[rz])+q?u*x": "foobazx", r"\bkey\d*=é?": "key7=é", r"[a-c]{3}(?=x)": "abcx", r"(ab){2}c|x[0-9]y": "ababc"}


@pytest.mark.parametrize("pattern", PATTERNS)
def test_every_match_satisfies_its_query(pattern):
    rng = random.Random(pattern)
    sample = PATTERNS[pattern]
    parts = 9 * [sample, sample[: len(sample) // 2], sample[len(sample) // 2 :]] + ["a", "b", "c", "e", "f", "x7y", "foo", "bar", "x", "é"] + WORDS + SIGNS + TAILS
    for fold in (False, True):
        rule = secrets.Rule("k", pattern, fold=fold)
        query, hits = secrets.trigram_query(rule), 0
        for _ in range(3000):
            text = "".join(rng.choices(parts, k=rng.randrange(1, 12)))
            if rule.spans(text):
                hits += 1
                assert holds(query, text), (pattern, text)
        assert hits > 10


def test_index_finds_each_trigram(spark, monkeypatch):
    monkeypatch.setattr(secrets, "SEGMENT_DOCS", 40)
    rng = random.Random(2)
    texts = [random_text(rng) for _ in range(150)]
    keyed = secrets.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").repartition(3)
    names = {(r["h1"], r["h2"]): r["text"] for r in keyed.collect()}
    queries = {0: secrets.one_of(frozenset([b"token"])), 1: secrets.one_of(frozenset([b"abcdefg", b"secret"]))}
    found = {(r["h1"], r["h2"]): r["rules"] for r in secrets.candidates(secrets.build_index(keyed), queries).collect()}
    for name, text in names.items():
        assert found.get(name, 0) == sum(holds(q, text) << k for k, q in queries.items())


def test_query_digest(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = catalogue.queries()["op11_trigram_secrets"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        want = plain(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
