"""Sharding, mixing, quotations, page text, language ID and the pipeline on small tables."""

from __future__ import annotations

import html
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from matewise.llm import common, htmltext, langid, mixing, quotes, sharding

SF = "/root/testdata/sf0.001"


def spark_hash(*values: str, seed: int = 42) -> int:
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode(), seed=seed)
    return seed


def plain_shard(key: str, tree: sharding.HashTree) -> tuple[int, int, int]:
    def draw(children):
        def cost(child):
            u = ((spark_hash(key, child[0]) >> 11) + 0.5) / 2**53
            return -math.log(u) / child[1]

        return min(children, key=cost)[2] if len(children) > 1 else children[0][2]

    i = draw([(str(i), sum(map(sum, r)), i) for i, r in enumerate(tree.regions)])
    j = draw([(f"{i}/{j}", sum(r), j) for j, r in enumerate(tree.regions[i])])
    m = draw([(f"{i}/{j}/{m}", w, m) for m, w in enumerate(tree.regions[i][j])])
    racks = [r for reg in tree.regions[:i] for r in reg]
    return i, len(racks) + j, sum(map(len, racks)) + sum(len(r) for r in tree.regions[i][:j]) + m


def test_shards(spark):
    rows = [(i, "text é" * (i % 7), "s") for i in range(800)] + [(None, None, "s"), (5, "twice", "s"), (5, "twice", "s")]
    tree = sharding.HashTree.uniform(2, 3, 4)
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string, shard string"), tree).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        key = "∅" if r["id"] is None else str(r["id"])
        assert (r["region"], r["rack"], r["shard"]) == plain_shard(key, tree)
        assert r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(24))
    first = next(r for r in got if r["id"] == 3)
    assert (first["size"], first["text_crc32"]) == (len(("text é" * 3).encode()) + 8, zlib.crc32(("text é" * 3).encode()))
    assert 8 <= sum(r["grown_shard"] == 24 for r in got) <= 70
    assert sharding.shard_rows(spark.createDataFrame([], "doc_id long, text string"), tree).count() == 0


def test_weights_move_rows_inside_their_subtree_only(spark):
    docs = spark.createDataFrame([(i, "") for i in range(2000)], "doc_id long, text string")
    heavy = sharding.HashTree((((1.0, 1.0), (1.0, 1.0)), ((1.0, 1.0), (3.0, 1.0))))
    one = sharding.descend(docs, F.col("doc_id"), sharding.HashTree.uniform(2, 2, 2))
    both = sharding.descend(one, F.col("doc_id"), heavy, "new_").collect()
    assert all(r["shard"] == r["new_shard"] or r["new_region"] == 1 for r in both)
    with pytest.raises(ValueError):
        sharding.HashTree((((0.0,),),))


def plain_targets(sizes: dict, weights, share, most):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        out = {s: rest * w[s] / sum(w[x] for x in free) for s in free} | capped
        over = [s for s in free if out[s] > most * sizes[s]]
        if not over:
            return out
        capped |= {s: most * sizes[s] for s in over}


def test_mix(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(n)), "abcde"[i % 5] if i % 11 else None, 7) for i, n in enumerate(rng.integers(0, 300, 300))]
    rows += [(900, None, "a", 7), (901, "", "b", 7), (902, "once more", "hot", 7), (902, "once more", "hot", 7), (903, "w " * 9000, "a", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    kept, _, pieces = mixing.mix(docs, block_words=16, shard_slots=100)
    got = mixing.taken_words(kept, pieces).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    want = plain_targets(sizes, (3, 1, 2), 1.5, 2.0)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.taken_words(*[x for x in mixing.mix(docs.repartition(3), block_words=16, shard_slots=100)][::2]).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in got) == Counter((r["doc_id"], r["taken"]) for r in again)
    mixed = mixing.mixed_documents(docs, kept, pieces, block_words=16)
    words = mixed.select(F.sum(F.regexp_count("text", F.lit(r"[^ ]+"))).alias("n")).first()["n"]
    assert abs(words - sum(taken.values())) <= 4 and mixed.columns == docs.columns  # one of two equal rows speaks for both
    assert mixing.mix(docs.limit(0))[2].count() == 0


def test_mix_returns_equal_rows_without_words(spark):
    rows = [(5, None, "a"), (5, None, "a"), (6, "", "a"), (6, "", "a"), (None, " ", None), (None, " ", None), (7, "x y", "a"), (8, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept, _, pieces = mixing.mix(docs)
    got = mixing.taken_words(kept, pieces).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((i, s, len((t or "").split())) for i, t, s in rows)
    assert sum(r["taken"] for r in got) == 4 and all(r["taken"] <= 2 * r["size"] for r in got)
    empty = mixing.mix(docs.where("doc_id < 7 AND doc_id > 4"))
    assert mixing.taken_words(empty[0], empty[2]).where("taken = 0 AND target = 0").count() == 4


def test_running_sum(spark):
    rows = [(g, i, i % 7) for g in range(3) for i in range(0, 500, g + 1)]
    frame = spark.createDataFrame(rows, "g int, at long, v long")
    for r in common.running_sum(frame, ["g"], "at", "v", "before", width=16).collect():
        assert r["before"] == sum(v for g, at, v in rows if g == r["g"] and at < r["at"])


def test_scratch_deletes_what_was_stashed_inside(spark):
    kept = common.stash(spark.range(3))
    with common.scratch():
        inside = common.stash(spark.range(4))
        assert inside.count() == 4
    assert kept.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(inside._stashed_at).count()


def test_every_pass_is_a_permutation(spark):
    for n in (1, 2, 7, 100, 1001):
        x = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("y")).collect()
        assert sorted(r["y"] for r in x) == list(range(n))


def test_quotations(spark):
    rows = [
        (1, 0, "a", "Hello  there\n\nSecond part\nwrapped"),
        (1, 1, "b", "> hello THERE\nI agree"),
        (1, 2, "c", ">> hello there\n> I agree\nMe too"),
        (1, 3, "a", "> second part\n> wrapped\n\n> unknown words\nok"),
        (1, 4, "b", "plain"),
        (2, 0, "a", "> I agree\nfrom another conversation"),
        (2, 1, "a", None),
        (2, 1, "a", None),
        (None, None, None, "lost"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out, quoted = quotes.threads(frame.withColumn("position", F.lit("x")))
    got = {(r["conv"], r["turn"]): r for r in out.collect()}
    assert len(got) == 8
    one = got[1, 1]
    assert (one["body"], one["reply_to"], one["link"], one["root"]) == ("I agree", 0, "quote", 0)
    two = got[1, 2]
    assert (two["reply_to"], two["root"], two["n_quotes"], two["n_linked"], two["levels"]) == (1, 0, 2, 2, 2)
    three = got[1, 3]
    assert (three["reply_to"], three["n_quotes"], three["n_linked"], three["body"]) == (0, 2, 1, "\nok".strip(" "))
    assert (got[1, 4]["reply_to"], got[1, 4]["link"], got[1, 4]["position"]) == (3, "previous", 4)
    assert (got[2, 0]["link"], got[2, 0]["n_linked"], got[2, 1]["copies"]) == ("start", 0, 2)
    assert got[None, None]["link"] == "start"
    assert quoted.where("original IS NULL").count() == 2
    assert quotes.threads(frame.limit(0))[0].count() == 0


def plain_threads(rows):
    """{(conv, turn): (body, reply_to, position)} for rows with distinct turns, message by message."""
    out, convs = {}, defaultdict(list)
    for conv, turn, _, text in rows:
        convs[conv].append((turn, text))
    for conv, messages in convs.items():
        first, up, below, last = {}, {}, defaultdict(list), None
        for turn, text in sorted(messages):
            runs, body, level, before = defaultdict(list), [], 0, None
            for line in text.split("\n"):
                level = len(re.match(r"[ \t]*((?:>[ \t]?)*)", line)[0].replace(" ", "").replace("\t", ""))
                bare = re.sub(r"^[ \t]*(>[ \t]?)+", "", line)
                if not bare.strip() or level != before:
                    before = level if bare.strip() else None
                    if bare.strip():
                        runs[level].append([bare])
                else:
                    runs[level][-1].append(bare)
                if level == 0:
                    body.append(bare)
            clean = {k: [re.sub(r"\s+", " ", "\n".join(x)).strip().lower() for x in v] for k, v in runs.items()}
            votes = Counter()
            for k, parts in clean.items():
                for p in parts:
                    if k and p in first:
                        votes[first[p]] += 10**6 * (k == 1) + 1
            up[turn] = max(votes, key=lambda t: (votes[t], t)) if votes else last
            below[up[turn]].append(turn)
            for p in clean.get(0, ()):
                first.setdefault(p, turn)
            out[conv, turn] = ("\n".join(body).strip(" "), up[turn])
            last = turn
        todo, n = below[None][::-1], 0
        while todo:
            turn = todo.pop()
            out[conv, turn] += (n,)
            n += 1
            todo += below[turn][::-1]
    return out


def test_generated_threads_equal_a_plain_parser(spark):
    rng = np.random.default_rng(9)
    rows, told = [], defaultdict(list)
    for conv in range(60):
        for turn in range(int(rng.integers(1, 60)) if conv else 700):
            text = f"Message {turn} of  {conv}\nsays this" if rng.random() < 0.9 else "Same words"
            if turn and rng.random() < 0.6:
                quoted = told[conv][int(rng.integers(0, turn)) if rng.random() < 0.7 else 0]
                marked = [("> " if rng.random() < 0.5 else ">") + x.upper() for x in quoted.split("\n")]
                text = "\n".join(marked) + "\n" + text
            told[conv].append(text)
            rows.append((conv, turn, "ab"[turn % 2], text))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    out = quotes.threads(frame)[0]
    got = {(r["conv"], r["turn"]): (r["body"], r["reply_to"], r["position"]) for r in out.collect()}
    assert got == plain_threads(rows)
    assert sum(p[2] != k[1] for k, p in got.items()) > 500 and max(text.count(">>") for *_, text in rows) > 0
    parts = quotes.conversations(out, 50).where("conv = 0").orderBy("part").collect()
    assert [p["n_messages"] for p in parts] == [50] * 14
    by_place = {v[2]: v[0] for k, v in got.items() if k[0] == 0}
    order = [x.split(": ", 1)[1] for p in parts for x in re.split(r"\n\n(?=[ab]: )", p["text"])]
    assert order == [by_place[i] for i in range(700)]


def test_equal_and_null_turns_are_numbered_over_ranges(spark):
    rows = [(1, None if i % 2 else 5, "a", f"text {i}") for i in range(400)] + [(1, 6, "b", "> text 0\nyes")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotes.threads(frame)[0].collect()
    assert sorted(r["position"] for r in got) == list(range(401))
    assert next(r["reply_to"] for r in got if r["turn"] == 6) == 5


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/>Home</a><li>About</ul></nav><div class="ad">Buy</div><div id="cookie-notice">We use cookies</div>
<article><header><h1>A &amp; B</h1></header><p>First   <b>bold <p>Second{extra}<br>line</p><aside>Related</aside>
<form><input>Search</form><section class="comments"><p>reader</p></section></article><footer>(c)</footer>"""


def test_page_text():
    got = htmltext.main_texts([PAGE.format(extra=""), None, "", "no markup at all", "<p>a<p>b &lt;c&gt;"])
    assert [x[0] for x in got] == ["A & B\nFirst bold\nSecond line", "", "", "no markup at all", "a\nb <c>"]
    odd = ['<p title="a<b">x</p>1 < 2 <!-- gone', '<a href="x>y</a> z', "<p>" + "<a '" * 50_000, "<nav>" * 500 + "x", "a<br/>b"]
    assert [x[0] for x in htmltext.main_texts(odd)][:2] == ["x\n1 < 2", "y z"] and htmltext.main_texts(odd[-1:])[0][0] == "a b"


def test_host_boilerplate_without_a_main_element(spark):
    menu = "<div>Start page of this very fine site with many things to see</div>"
    rows = [(i, f"http://H.example/{i}", f"<body>{menu}<p>Own text number {i} {'x' * i}</p></body>", 1) for i in range(5)]
    rows += [(9, None, None, 1), (10, "odd", "<p>alone</p>", 1), (0, "http://h.example/0", rows[0][2], 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = {(r["id"], r["url"]): r for r in htmltext.extract(frame).collect()}
    assert len(got) == 8
    assert got[3, "http://H.example/3"]["text"] == "Own text number 3 xxx"
    assert got[9, None]["text"] == "" and got[10, "odd"]["text"] == "alone" and got[10, "odd"]["n_chars"] == 5
    assert htmltext.extract(frame.limit(0)).count() == 0


def test_repeats_equal_plain_search():
    rng = np.random.default_rng(0)
    streams = [rng.integers(0, 3, n) for n in (0, 5, 40, 60, 80, 3)]
    got = htmltext.repeated_tokens([s.astype(np.int64) for s in streams], 8)
    for i, s in enumerate(streams):
        want = np.zeros(len(s), bool)
        for a in range(len(s) - 7):
            part = s[a : a + 8].tolist()
            if any(part == t[b : b + 8].tolist() for j, t in enumerate(streams) if j != i for b in range(len(t) - 7)):
                want[a : a + 8] = True
        assert (got[i] == want).all()


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", langid.held_out())
    filters = langid.fit(docs.where("NOT held_out"))
    told = langid.predict(docs, filters)
    right = told.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("x")).first()["x"]
    assert right >= 0.99 and told.columns == [*docs.columns, "lang_pred", "score"]
    odd = [(1, None), (2, ""), (3, "12 + 34 !? \u0301"), (4, "日本語"), (5, "the and of the"), (6, "the and of " * 200_000)]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(odd, "doc_id long, text string"), filters).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3
    assert got[4]["score"] < 0.2 and got[4]["lang_pred"] in filters.languages
    assert got[5]["lang_pred"] == got[6]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = langid.fit(docs.limit(0))
    assert langid.predict(docs.limit(3), none).select("lang_pred").distinct().collect()[0][0] == "und"


def test_filter_corrects_false_positives(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    small = langid.fit(docs, bits=14, most_rows=500)
    assert (small.false_rate > 0.001).all()
    assert small.predict("the house and of the")[0] == "en"


def plain_languages(rows, least_share=1e-5, near=0.3):
    """A predictor with exact n-gram sets in place of filters, from all rows (lang, text)."""
    counts = defaultdict(Counter)
    for lang, text in rows:
        counts[lang].update(plain_grams(text))
    shares = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    top = defaultdict(float)
    for some in shares.values():
        for g, s in some.items():
            top[g] = max(top[g], s)
    sets = {lang: {g for g, s in shares[lang].items() if s >= least_share and s >= near * top[g]} for lang in sorted(shares)}

    def predict(text):
        own = plain_grams(text)
        hits = {lang: sum(g in some for g in own) for lang, some in sets.items()}
        best = max(hits, key=hits.get)
        return best, hits[best] / len(own)

    return predict


def plain_grams(text):
    letters = "".join(c.lower() if len(c.lower()) == 1 else c for c in (x if unicodedata.category(x)[0] in "LM" else " " for x in text))
    letters = " " + " ".join(letters.split(" ")) + " "
    letters = re.sub(" +", " ", letters)
    return [letters[i : i + n] for n in langid.SIZES for i in range(len(letters) - n + 1)]


def test_languages_equal_exact_sets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", langid.held_out())
    rows = docs.where("text IS NOT NULL").collect()
    want = plain_languages([(r["lang"], r["text"]) for r in rows if not r["held_out"] and r["lang"] is not None])
    told = {r["doc_id"]: r for r in langid.predict(docs, langid.fit(docs.where("NOT held_out"))).collect()}
    for r in rows:
        if any(map(str.isalpha, r["text"])):
            lang, score = want(r["text"])
            assert told[r["doc_id"]]["lang_pred"] == lang and told[r["doc_id"]]["score"] == pytest.approx(score, abs=0.01)


def test_more_languages_than_a_word_holds(spark):
    rng = np.random.default_rng(3)
    words = {f"l{k:02}": ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(5)] for k in range(100)}
    rows = [(i, " ".join(rng.permutation(words[lang])), lang) for lang in words for i in range(3)]
    filters = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    (block,) = filters.blocks()
    assert block.slices.shape == (2, 1 << 20) and filters.languages == tuple(sorted(words))
    assert all(block.best(" ".join(some))[0] == lang for lang, some in words.items())


def test_every_one_of_1500_languages_is_learned(spark):
    """In blocks of 640 as in one, and each predicted from its own words."""
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ")
    words = {f"l{k:04}": " ".join("".join(rng.choice(letters, 7)) for _ in range(6)) for k in range(1500)}
    rows = [(i, text, lang) for lang, text in words.items() for i in range(2)] + [(0, words["l0007"], "l0008")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = spark.createDataFrame([(lang, text, 1) for lang, text in words.items()] + [("none", "12", 2), ("null", None, 3)], "want string, text string, __n2 int")
    several = langid.predict(texts, langid.fit(docs, bits=16, block_languages=640)).collect()
    assert sum(r["want"] == r["lang_pred"] for r in several) >= 1499 and all(0 <= r["score"] <= 1 for r in several)
    assert {r["want"]: r["lang_pred"] for r in several if r["want"] in ("none", "null")} == {"none": "und", "null": "und"}
    assert sorted(several) == sorted(langid.predict(texts, langid.fit(docs, bits=16, block_languages=1536)).collect())
    with pytest.raises(ValueError):
        langid.fit(docs, block_languages=100)


def test_languages_ignore_clashing_columns(spark):
    rows = [(1, "the house", "en", "x", 0.5), (2, "das Haus", "de", "y", None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    told = langid.predict(docs, langid.fit(docs))
    assert sorted(told.columns) == sorted(docs.columns) and {r["lang_pred"] for r in told.collect()} == {"en", "de", "und"}
    assert told.where("doc_id IS NULL").count() == 1


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_pipeline_equals_plain_stages(spark):
    """Each stage on a table with nulls, repeats, a long text and clashing columns, against plain Python."""
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(*r, "x", 0.5) for r in given]
    rows += [(*given[0], "y", None), (given[1][0], "a different text under the id of another document here", "en", "s", 54, "z", 0.1)]
    rows += [(10**6, None, None, None, None, None, None), (10**6 + 1, "", "en", "src0", 0, "x", 1.0), (10**6 + 2, "the and of " * 40_000, "en", None, 440_000, "x", 1.0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string, score double"
    docs = spark.createDataFrame(rows, schema).repartition(4).persist()
    told = corpus_pipeline.identify_language(spark, docs, SF).collect()
    predict = plain_languages([(r[2], r[1]) for r in rows if r[1] and r[2]])
    letters = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    assert Counter((r["doc_id"], r["text"]) for r in told) == Counter((r[0], r[1]) for r in letters if predict(r[1])[1] >= corpus_pipeline.LEAST_SCORE)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    sets = {(r[0], r[1]): plain_set(r[1]) for r in rows}
    group = {k: k for k in sets}

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    keys = sorted((k for k in sets if sets[k]), key=lambda k: len(sets[k]))
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if 100 * len(sets[a]) < 75 * len(sets[b]):
                break
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    members = defaultdict(list)
    for k in sets:
        members[find(k)].append(k)
    stay = Counter((r["doc_id"], r["text"]) for r in kept)
    assert set(stay.values()) == {1} and len(stay) == len(members)
    assert all(sum(k in stay for k in some) == 1 and min(k[0] for k in some) == next(k[0] for k in some if k in stay) for some in members.values())
    mixed = corpus_pipeline.mix_sources(spark, docs, SF).collect()
    sizes, taken, per = defaultdict(int), defaultdict(int), Counter()
    words = lambda t: len(re.findall(mixing.WORD, t or ""))
    for r in rows:
        sizes[r[3]] += words(r[1])
    for r in mixed:
        taken[r["source"]] += words(r["text"])
        per[r["doc_id"]] += words(r["text"])
        assert r["n_chars"] == len(r["text"]) and mixed[0].__fields__ == docs.columns
    want = plain_targets({s: n for s, n in sizes.items()}, (3, 1, 2), 1.5, 2.0)
    assert all(abs(taken[s] - want[s]) <= 1 + 2 * words(given[0][1]) for s in want)  # rows that are equal speak for each other
    own = Counter()
    for r in rows:
        own[r[0]] += words(r[1])
    assert all(n <= 2 * own[i] for i, n in per.items())
    packed = corpus_pipeline.pack_sequences(spark, docs, SF).collect()
    ids = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = Counter()
    for r in rows:
        lengths[r[0]] += len(ids.encode(r[1] or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in packed:
        got[r["doc_id"]] += r["length"]
    assert got == lengths and len({r["sequence_id"] for r in packed}) <= 1 + 1.01 * sum(lengths.values()) / 2048
    docs.unpersist()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_long_texts_are_taken_whole(spark):
    long = "word é " * 200_000
    docs = spark.createDataFrame([(1, long, "s", 3), (2, None, None, None)], "doc_id long, text string, region string, slot int")
    got = {r["id"]: r for r in sharding.shard_rows(docs, sharding.HashTree.uniform(2, 3, 4)).collect()}
    assert (got[1]["size"], got[1]["text_crc32"]) == (len(long.encode()) + 8, zlib.crc32(long.encode())) and got[2]["size"] == 8
    chat = [(1, 0, "a", f"first\n\n{long}"), (1, 1, "b", f"> {long}\nyes")]
    out = quotes.threads(spark.createDataFrame(chat, "conv_id long, turn long, role string, text string"))[0].collect()
    assert next(r for r in out if r["turn"] == 1)["n_linked"] == 1 and sum(len(r["body"]) for r in out) == len(f"first\n\n{long}".strip()) + 3


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "123 456", "en", "src0", 7), (None, "the and of the", "en", "src0", 14)], docs.schema)
    docs = docs.unionByName(extra)
    told = corpus_pipeline.identify_language(spark, docs, SF)
    assert told.count() == docs.count() - 2 and told.columns == docs.columns
    kept = corpus_pipeline.drop_near_duplicates(spark, told, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < told.count()
    assert kept.where("doc_id IS NULL").count() == 1
    mixed = corpus_pipeline.mix_sources(spark, kept, SF)
    words = lambda d: d.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).first()["n"]
    assert mixed.columns == docs.columns and words(mixed) == pytest.approx(1.5 * words(kept), rel=0.01)
    packed = corpus_pipeline.pack_sequences(spark, mixed, SF)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "mix_sources", "pack"]


def plain_main_text(pages: list[list[htmltext.Block]], rule=htmltext.Rule()) -> list[str]:
    """Texts of one host's distinct pages by sets of word windows."""
    windows = []
    for page in pages:
        words = [w for b in page for w in b.text.split(" ")]
        windows.append({tuple(words[i : i + 8]) for i in range(len(words) - 7)})
    on = Counter(w for some in windows for w in some)
    out = []
    for page in pages:
        words = [(k, w) for k, b in enumerate(page) for w in b.text.split(" ")]

        def hit(least):
            marks = [False] * len(words)
            for i in range(len(words) - 7):
                if on[tuple(w for _, w in words[i : i + 8])] >= least:
                    marks[i : i + 8] = [True] * 8
            return [[m for m, (j, _) in zip(marks, words) if j == k] for k in range(len(page))]

        often, most = hit(max(3, 0.1 * len(pages))), hit(max(5, 0.5 * len(pages)))
        main = any(b.zone == "main" for b in page)
        outer = [b.zone == "chrome" or (b.zone == "loose" and sum(o) >= rule.covered * len(o)) for b, o in zip(page, often)]
        kept = []
        for k, b in enumerate(page):
            if b.zone not in (("main",) if main else ("plain", "loose")) or (not main and (all(outer[: k + 1]) or all(outer[k:]))):
                continue
            runs = [(m, [w for _, w in g]) for m, g in groupby(zip(most[k], b.text.split(" ")), key=lambda x: x[0])]
            if sum(most[k]) >= rule.covered * len(most[k]):
                runs = [r for m, r in runs if not m and len(r) >= 8]
            else:
                runs = [r for m, r in runs if not m or len(r) < 8]
            kept.append(" ".join(w for r in runs for w in r))
        zones = ("main",) if main else ("plain", "loose")
        out.append("\n".join([x for x in kept if x] or [b.text for b in page if b.zone in zones]))
    return out


def test_extraction_equals_plain_windows_for_any_number_of_chunks(spark):
    rng = np.random.default_rng(5)
    words = lambda n, few: " ".join(f"w{k}" for k in rng.integers(0, few, n))
    notices = [f"<div>{words(14, 10**6)}</div>" for _ in range(6)]
    rows = []
    for i in range(300):
        more = "".join(x for k, x in enumerate(notices) if rng.random() < (0.9, 0.5, 0.2, 0.1, 0.05, 0.01)[k])
        own = f"<p>{words(20, 9)}</p><p>{words(30, 10**6)}</p>"
        rows.append((i, f"http://h.example/{i}", f"<article>{own}{more}</article>" if i % 3 == 0 else own + more))
    rows += [(1000 + k, f"http://h.example/copy{k}", rows[1][2]) for k in range(200)] + [(2000, "http://i.example/", rows[0][2]), (2001, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [{r["id"]: tuple(r) for r in htmltext.extract(frame, chunk_pages=n).collect()} for n in (5000, 250, 20)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)
    want = plain_main_text([htmltext.blocks(h) for _, _, h in rows[:300]])
    assert [got[0][i][2] for i in range(300)] == want
    without = ["\n".join(b.text for b in htmltext.blocks(h) if b.zone != "chrome") for _, _, h in rows[:300]]
    assert sum(a != b for a, b in zip(want, without)) > 250 and any("<article>" in h and a != b for (_, _, h), a, b in zip(rows, want, without))
    assert all(got[0][1000 + k][2] == want[1] for k in range(200)) and got[0][2001][2] == ""
    by_bytes = {r["id"]: tuple(r) for r in htmltext.extract(frame, chunk_bytes=20_000).collect()}
    assert by_bytes == got[0]


def test_page_text_of_the_given_table(spark):
    """Every page of the table against its article, cut at headings and paragraphs."""
    rows = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in htmltext.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect():
        article = re.search(r"<article>(.*)</article>", rows[r["id"]]["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x.replace("<b>", "").replace("</b>", ""))).split()) for x in re.split(r"</?(?:h1|p)>", article)]
        assert r["text"] == "\n".join(x for x in parts if x)


def test_no_article_is_lost_on_the_given_pages_without_their_tags(spark):
    """Every page's text is its article also where nothing marks it; without the list of names too, but for what is left besides."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["id"]: r["text"] for r in htmltext.extract(pages).collect()}
    bare = pages.withColumn("html", F.regexp_replace("html", "</?(article|main)>", ""))
    assert {r["id"]: r["text"] for r in htmltext.extract(bare).collect()} == want
    names, htmltext.CHROME_NAMES = htmltext.CHROME_NAMES, frozenset()
    try:
        hosts = defaultdict(list)
        for r in bare.collect():
            hosts[r["url"].split("/")[2]].append(r)
        for rows in hosts.values():
            for r, (text, _, _) in zip(rows, htmltext.main_texts([r["html"] for r in rows])):
                assert not Counter(want[r["page_id"]].split("\n")) - Counter(text.split("\n"))
    finally:
        htmltext.CHROME_NAMES = names


def test_unique_runs_of_a_covered_block_stay():
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    legal = words("legal", 40)
    pages = [f"<article><p>{words(f'own{i}x', 20)}</p><p>{words(f'lead{i}x', 9)} {legal} by{i}</p></article>" for i in range(6)]
    pages += [f"<article><p>{words(f'own{i}x', 20)}</p><p>{legal} by{i}</p></article>" for i in range(6, 9)]
    got = [x[0] for x in htmltext.main_texts(pages)]
    assert got[:6] == [f"{words(f'own{i}x', 20)}\n{words(f'lead{i}x', 9)}" for i in range(6)]
    assert got[6:] == [words(f"own{i}x", 20) for i in range(6, 9)]


def test_pipeline_keeps_one_of_each_group_where_ids_repeat(spark):
    one, two, far = "a b c d e f g h", "p q r s t u v w", "k l m n o p"
    rows = [(1, one), (1, two), (2, one + " "), (0, two), (3, far), (3, far), (4, far), (5, None), (5, ""), (None, far)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    want = [(1, one), (0, two), (3, far), (5, None), (5, ""), (None, far)]
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter(want) and kept[0].__fields__ == docs.columns


def test_passages_that_two_pages_share_stay():
    words = lambda name: " ".join(f"{name}{k}" for k in range(20))
    article, quote, menu = f"<p>{words('a')}</p><p>{words('b')}</p>", words("q"), f"<div>{words('menu')}</div>"
    text = lambda *pages: [x[0] for x in htmltext.main_texts(list(pages))]
    assert text(article, article + "<p>One more</p>") == [f"{words('a')}\n{words('b')}", f"{words('a')}\n{words('b')}\nOne more"]
    own = [f"{menu}<p>{words(f'own{i}x')}</p>" for i in range(4)]
    quoting = [f"{own[0]}<p>{quote}</p>", f"{own[1]}<p>{quote}</p>", own[2], own[3]]
    want = [f"{words('own0x')}\n{quote}", f"{words('own1x')}\n{quote}", words("own2x"), words("own3x")]
    assert text(*quoting) == want
    assert text(*quoting, quoting[2], quoting[2]) == [*want, want[2], want[2]]  # copies lose the menu too


def test_host_boilerplate_inside_the_main_element():
    words = lambda name: " ".join(f"{name}{k}" for k in range(20))
    page = lambda i, more="": f"<article><p>{words(f'own{i}x')}</p>{more}</article>"
    notice, shared = f"<p class=hint>{words('notice')}</p>", f"<p>{words('shared')}</p>"
    pages = [page(i, notice) for i in range(6)] + [page(6, shared), page(7, shared), f"<main>{notice}</main>"]
    want = [words(f"own{i}x") for i in range(6)] + [f"{words(f'own{i}x')}\n{words('shared')}" for i in (6, 7)] + [words("notice")]
    assert [x[0] for x in htmltext.main_texts(pages)] == want


def test_rare_languages_are_learned_whole(spark):
    rows = [(i, f"the house and of the garden {i}", "en") for i in range(3000)] + [(None, "zwölf größere Häuser über", "de")] * 3
    filters = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_rows=20)
    assert filters.predict("größere Häuser")[0] == "de" and filters.predict("the garden")[0] == "en"
