"""Operators over texts against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import re
import sys
from collections import defaultdict
from html import unescape
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from facewave.llm import bpe, html_text, jaccard_join, langid, suffix_arrays, toxicity
from facewave.llm._shared import connected

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


# --- suffix arrays


def windows_by_hand(docs, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    found = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            found[tuple(w[k : k + width])].add(str(i))
    out = {}
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in found}:
            for k in range(len(w) - n + 1):
                if x := found.get(tuple(w[k : k + n])):
                    ids |= x
                    hit |= set(range(k, k + n))
        out[d] = (len(w), len(hit), sorted(ids))
    return out


def located(df):
    return {r[0]: (r[1], sum(r[2][1::2]) - sum(r[2][::2]), r[3]) for r in df.collect()}


@pytest.mark.parametrize("block_words", [200_000, 3])
def test_windows(spark, block_words):
    ten = "one two three four five six seven eight nine ten"
    docs = [(1, None), (2, ""), (3, "a b c"), (4, "x a b c d a b a b c"), (5, f"É {ten} eleven " * 3), (6, "q"), (7, ten), (8, f"{ten} " * 500), (9, f"{ten} " * 500)]
    items = [(10, "A, b c"), (11, None), (12, ""), (13, f"{ten} eleven É one"), (14, "b"), (15, ten), (15, "zzz"), (16, ten)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert located(suffix_arrays.locate(d, b, block_words=block_words, shard_bytes=4000)) == windows_by_hand(docs, items)


def test_random_windows(spark):
    rng = np.random.default_rng(1)
    text = lambda n: " ".join(rng.choice(["a", "b", "c"], n))
    docs, items = [(i, text(rng.integers(0, 60))) for i in range(40)], [(i, text(rng.integers(0, 8))) for i in range(12)]
    d, b = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    assert located(suffix_arrays.locate(d, b, width=4)) == windows_by_hand(docs, items, 4)
    longest = {r["item_id"]: r["n_words"] for r in suffix_arrays.longest_matches(d, b).collect()}
    for i, t in items:
        w = t.split()
        spans = [(k, n) for k in range(len(w)) for n in range(len(w) - k, 0, -1)]
        best = max((n for k, n in spans if any(f" {' '.join(w[k : k + n])} " in f" {x} " for _, x in docs)), default=0)
        assert longest.get(str(i), 0) == best


@pytest.mark.parametrize("block_words", [200_000, 4])
def test_rows_that_share_an_id(spark, block_words):
    rows = [(1, "x alpha beta y"), (1, "clean"), (None, "gamma"), (None, "clean too"), (2, "alpha beta gamma"), (2, "alpha beta gamma"), (3, None)]
    items = [("a", "alpha beta"), ("g", "gamma"), (None, "beta gamma"), ("z", "alpha nothing like it"), ("z", "omega omega omega omega omega")]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = sorted(((r[0], r[1], sum(r[2][1::2]) - sum(r[2][::2]), r[3]) for r in suffix_arrays.locate(d, b, block_words=block_words).collect()), key=str)
    want = [(1, 4, 2, ["a"]), (1, 1, 0, []), (None, 1, 1, ["g"]), (None, 2, 0, []), (2, 3, 3, ["", "a", "g"]), (2, 3, 3, ["", "a", "g"]), (3, 0, 0, [])]
    assert got == sorted(want, key=str)
    clean = suffix_arrays.decontaminate(d, b, block_words=block_words)
    assert sorted(str(r["text"]) for r in clean.collect()) == ["None", "clean", "clean too"]
    # the longest match of an item does not hang on the items beside it
    longest = {r["item_id"]: r["n_words"] for r in suffix_arrays.longest_matches(d, b, block_words=block_words).collect()}
    assert longest == {"a": 2, "g": 1, "": 2, "z": 1}


def test_empty_benchmark_and_extra_columns(spark):
    d = documents(spark, ["a b", "c"]).withColumn("items", F.lit(1)).withColumn("hits", F.lit(2))
    none = spark.createDataFrame([], "item_id long, text string")
    assert suffix_arrays.decontaminate(d, none).count() == 2
    some = spark.createDataFrame([(1, "c")], "item_id long, text string")
    out = suffix_arrays.decontaminate(d, some)
    assert out.columns == d.columns and [r["doc_id"] for r in out.collect()] == [0]
    assert suffix_arrays.decontaminate(d.limit(0), some).count() == 0


# --- Jaccard join


def components_by_hand(docs):
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("often", [2, 16])
def test_components(spark, often):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", "  ", "a b", "A  b", "a b c d", "x"]
    for _ in range(12):  # groups with ever more edits, so that distances lie on both sides of the threshold
        base = list(rng.choice(vocabulary, rng.integers(6, 120)))
        texts += [" ".join(base)] * int(rng.integers(1, 3))
        for _ in range(int(rng.integers(1, 8))):
            base = [w if rng.random() > 0.02 else str(rng.choice(vocabulary)) for w in base]
            texts.append(" ".join(base))
    line = " ".join(rng.choice(vocabulary, 30))
    texts += [f"{line} {' '.join(rng.choice(vocabulary, 25))}" for _ in range(30)]
    texts += ["la " * 5000, "la " * 4000]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = components_by_hand(docs)
    for rows, limit in ((512, 1_000_000), (6, 0)):
        got = {r[0]: (r[1], r[2]) for r in jaccard_join.components(df, often=often, leaf_rows=rows, frequent_limit=limit, part_bytes=20_000).collect()}
        assert got == want


@pytest.mark.parametrize(("pivots", "block_rows"), [(64, 1024), (3, 5)])
def test_cells_of_large_regions(spark, monkeypatch, pivots, block_rows):
    """One region of chains of ever more edits and of unlike sets, parted to the end, by cells or at last by blocks."""
    monkeypatch.setattr(jaccard_join, "PIVOTS", pivots)
    rng = np.random.default_rng(7)
    sets = []
    for _ in range(6):
        s = set(rng.integers(0, 4000, 40).tolist())
        for _ in range(25):
            s = {x for x in s if rng.random() > 0.06} | set(rng.integers(0, 4000, 3).tolist())
            sets.append(s)
    sets += [set(range(100_000 + 50 * i, 100_000 + 50 * i + 40)) | {1, 2} for i in range(40)]
    sids = [int(x) for x in rng.permutation(10_000)[: len(sets)]]
    near = [(a, b) for a in range(len(sets)) for b in range(a) if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]

    def classes(pairs):
        root = {x: x for x in sids}
        for a, b in pairs:
            a, b = root[a], root[b]
            root = {x: min(a, b) if r in (a, b) else r for x, r in root.items()}
        return root

    regions = spark.createDataFrame([("x", i, len(s)) for i, s in zip(sids, sets, strict=True)], "region string, sid long, n long")
    shingles = spark.createDataFrame([(i, np.array(sorted(s), np.uint64).tobytes()) for i, s in zip(sids, sets, strict=True)], "sid long, shingles binary")
    links = [(r["a"], r["b"]) for r in jaccard_join.join_regions(regions, shingles, 8, 1 << 20, block_rows).collect()]
    by_sid = dict(zip(sids, sets, strict=True))
    assert all(4 * len(by_sid[a] & by_sid[b]) >= 3 * len(by_sid[a] | by_sid[b]) for a, b in links)
    assert classes(links) == classes([(sids[a], sids[b]) for a, b in near])


def test_join_of_odd_rows(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (7, text), (8, None)], "doc_id long, text string").withColumn("sid", F.lit("x"))
    got = sorted(((r[0], r[1], r[2]) for r in jaccard_join.components(df).collect()), key=str)
    assert got == sorted([(5, 3, 5), (5, 3, 5), (None, 3, None), (7, 3, 5), (8, 0, 8)], key=str)
    assert sorted(str(r[0]) for r in jaccard_join.keep_one(df).collect()) == ["5", "8", "None"]
    assert jaccard_join.components(df.limit(0)).count() == jaccard_join.keep_one(df.limit(0)).count() == 0


def test_rows_with_one_id_are_judged_by_their_texts(spark):
    a, near, b = "one two three four five six seven", "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(5, a), (7, a), (7, b), (7, b), (7, None), (7, ""), (9, f"{a} "), (None, b), (None, b), (6, near.upper()), (4, "something else entirely here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__sid", F.lit("x"))
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(str, kept.drop("__sid").collect())) == sorted(str(r) for r in spark.createDataFrame([(5, a), (7, b), (7, None), (7, ""), (None, b), (None, b), (4, rows[-1][1])], "doc_id long, text string").collect())
    only = spark.createDataFrame([(7, a), (7, a), (7, f"{a} eight")], "doc_id long, text string")
    assert jaccard_join.keep_one(only).count() == 1


def test_two_shingles_on_one_key_do_not_lose_a_link():
    x = np.array([5, 5 + (1 << 60), 7], np.uint64)
    assert len(jaccard_join._keys(x, 1)) == 2 and np.array_equal(jaccard_join._keys(x, 1), np.array([5, 7], np.uint64))
    parts = jaccard_join._keys(np.array([(1 << 64) - 1, 1 << 63, 3], np.uint64), 10)
    assert (parts >> np.uint64(32)).tolist() == [0, 5, 9]


def test_connected(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (300, 300), (None, 1)]
    got = {r[0]: r[1] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100}


# --- BPE


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(3)
    letters = [chr(c) for c in [*range(0x250), *range(0x300, 0x500), *range(0x1E00, 0x2070), *range(0x3000, 0x3100), *range(0x1F300, 0x1F350)]]
    letters += ["'s", "'ll", " ", "<|endoftext|>", "<|startoftext|>", "a", "e"] * 20
    texts = ["".join(rng.choice(letters, rng.integers(0, 50))) for _ in range(500)]
    texts += [None, "", "  ", "a" * 5000, "ab" * 3000, "é" * 300, "!" * 1000, "x" * 49, "İΣς"]
    library = Tokenizer.from_file(tokenizer_path())
    df = documents(spark, texts).withColumn("ids", F.lit(1))
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode(df, tokenizer_path()).collect()}
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert ids == want
    decoded = {r["doc_id"]: r["decoded"] for r in bpe.decode(bpe.encode(df, tokenizer_path()), tokenizer_path()).collect()}
    assert decoded == {i: library.decode(x, skip_special_tokens=False) for i, x in want.items()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r[0]: tuple(r)[1:] for r in bpe.digests(df, tokenizer_path()).collect()}
    assert got == {i: (len(x), sha(" ".join(map(str, x))), sha(decoded[i])) for i, x in want.items()}
    assert bpe.digests(df.limit(0), tokenizer_path()).count() == 0


# --- learned operators

WORDS = {"en": "the of and to in that is was for it with as his on be", "de": "der die und in den von zu das mit sich des auf ist im dem", "es": "de la que el en los del se las por un para con una su"}


def language_rows(spark, n=60):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(WORDS[k].split(), 40)), k) for i, k in enumerate(sorted(WORDS) * n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language(spark):
    rows = language_rows(spark)
    model = langid.fit(rows.where(~langid.held_out()))
    out = langid.predict(rows.withColumn("score", F.lit("x")), model)
    assert out.where(langid.held_out() & (F.col("lang") == F.col("lang_pred"))).count() == rows.where(langid.held_out()).count()
    assert out.where("rejected").count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !!"), (4, "der die das und " * 20_000), (5, "und")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(got[i]["rejected"] and got[i]["score"] == 0 for i in (1, 2, 3))
    assert got[4]["lang_pred"] == "de" and 0 <= got[4]["score"] <= 1
    assert langid.predict(odd, langid.fit(rows.limit(0))).where("lang_pred = 'und'").count() == 5
    # long texts of no learned language, and of no language, go; a brief clean one stays; repeated rows and ties agree
    rng = np.random.default_rng(9)
    junk = ["".join(rng.choice(list("bcdfghjklmnpqrstvwxz "), 600)), rng.bytes(400).hex(), "".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 300)), "это предложение на русском языке " * 12]
    texts = [*junk, "was it", "der und die", "la de que", "was it"]
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["rejected"] for r in got] == [True] * 4 + [False] * 4 and got[4][2:] == got[7][2:]
    assert langid.predict(odd.limit(0), model).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_held_out_rows_of_the_queries(spark):
    """The learned queries on held-out rows of the given tables: languages, what is rejected, and toxic documents."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = langid.op10_langid(spark, folder).where("held_out").join(docs.select("doc_id", "lang", "text"), "doc_id").where("lang is not null and text rlike '[A-Za-z]'").toPandas()
    assert (found["lang"] == found["lang_pred"]).mean() > 0.98 and found["rejected"].mean() < 0.01
    scored = toxicity.op4_toxicity(spark, folder).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").where("toxic is not null").toPandas()
    toxic = scored[scored["toxic"] == 1]
    assert (toxic["predicted"] == 1).mean() > 0.6 and (scored[scored["toxic"] == 0]["predicted"] == 1).mean() < 0.03


def toxic_rows(spark, n=300):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru") for b in ("ta", "ne", "so") for c in ("l", "n", "r")]
    rows = []
    for i in range(n):
        text = list(rng.choice(words, 40))
        if i % 5 == 0:
            for _ in range(4):
                text[int(rng.integers(40))] = str(rng.choice(["blarg", "snorfle", "quimp"]))
        rows.append((i, " ".join(text), int(i % 5 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity(spark):
    rows = toxic_rows(spark)
    model = toxicity.fit(rows.select("doc_id", "text").where(~langid.held_out()), rows.select("doc_id", "toxic"))
    out = toxicity.score(rows.withColumn("predicted", F.lit("x")), model)
    assert out.where(F.col("predicted") != F.col("toxic")).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "katal " * 50_000), (4, "blarg")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    assert got[1] == got[2] == got[3] < 0.3 and all(0 <= s <= 1 for s in got.values())
    assert toxicity.score(odd, toxicity.fit(rows.limit(0), rows)).where("score = 0").count() == 4


def test_grammar_weighs_the_clause():
    words = toxicity.lexicon({b"blarg": 3.0}, {b"snor": 3.0})
    weigh = lambda t, **how: toxicity.matches(__import__("pyarrow").array([t]), words, **how)[0]
    plain = weigh("a blarg here")[0]
    assert plain == 3.0 and weigh("a snorfle here")[0] == 3.0
    assert weigh("you blarg")[0] > plain > weigh("he said blarg")[0] > weigh("not a blarg")[0] > 0
    assert weigh("not this one. a blarg")[0] == plain  # a negation ends with its clause
    assert weigh("blarg blarg")[0] > 2 * plain
    assert weigh("kill you")[0] < weigh("you kill")[0]
    assert tuple(weigh("")) == (0, 0, 0)
    # contractions: an ending's apostrophe goes, a French article stays apart
    assert weigh("you aren't a blarg")[0] == weigh("you arent a blarg")[0] < weigh("you are a blarg")[0]
    assert weigh("you aren\u2019t a blarg")[0] == weigh("you arent a blarg")[0]
    assert weigh("'blarg' l'blarg")[2] == 1 and weigh("l'blarg")[0] == plain
    # each transducer has its part
    text = "you aren't a blarg, she said blarg blarg"
    assert len({float(weigh(text, without=w)[0]) for w in ((), ("aim",), ("negate",), ("report",), ("stack",))}) == 5


def grammar_rows(spark, n=1200):
    """Toxic: an insult, or a deed that is meant for someone. Clean: the same words denied, reported, or meant for nobody."""
    rng = np.random.default_rng(8)
    filler = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru", "ve", "do") for b in ("ta", "ne", "so", "ki") for c in ("l", "n", "r")]
    patterns = [*[("{} blarg", 1)] * 3, *[("you {} blarg", 1)] * 2, *[("you frob {}", 1)] * 2, ("not {} blarg", 0), ("{} muttered blarg", 0), *[("{} frob", 0)] * 2, *[("you {}", 0)] * 4, *[("{}", 0)] * 4]
    rows = []
    for i in range(n):
        pattern, toxic = patterns[int(rng.integers(len(patterns)))]
        clauses = [" ".join(rng.choice(filler, 5)) for _ in range(6)]
        clauses[int(rng.integers(6))] = pattern.format(str(rng.choice(filler)))
        rows.append((i, ". ".join(clauses), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_learned_classes_and_each_transducer(spark):
    """Threats and reporting words are learned, and on held-out rows every transducer but that of repeated insults is missed."""
    rows = grammar_rows(spark).cache()
    train, labels = rows.select("doc_id", "text").where(~langid.held_out()), rows.select("doc_id", "toxic")

    def wrong(*without):
        model = toxicity.fit(train, labels, odds=3.0, without=without)
        out = toxicity.score(rows.where(langid.held_out()), model).toPandas()
        return ((out["score"] >= 0.5) != (out["toxic"] == 1)).mean()

    whole = wrong()
    assert whole < 0.1
    for name in ("aim", "negate", "report"):
        assert wrong(name) > whole + 0.02, name


def test_toxicity_of_odd_tables(spark):
    rows = toxic_rows(spark)
    text = rows.where("toxic = 1").first()["text"]
    odd = spark.createDataFrame([(None, text), (1, text), (1, text), (1, "katal"), (None, None)], "doc_id long, text string").union(rows.select("doc_id", "text"))
    labels = rows.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (3, None), (4, 7)], "doc_id long, toxic int"))
    got = toxicity.score(odd, toxicity.fit(odd, labels))
    found = {(r["doc_id"], r["text"]): r["score"] for r in got.collect()}
    assert found[None, text] == found[1, text] > 0.3 > found[1, "katal"] and got.count() == 305
    assert toxicity.score(odd.limit(0), toxicity.fit(odd, labels)).count() == 0


# --- pages


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain & text &amp; more", "plain & text & more"),
        ("<p>one<p>two <b>b</b>old &nbsp; x", "one two bold x"),
        ("<body><header>site</header><nav>n</nav><div id=main><h1>T</h1><p>alpha beta gamma</p><div class='comments'><p>a long reader comment, longer than the article</p></div></div><aside>side</aside><footer>foot</footer>", "T alpha beta gamma"),
        ("<article><header><h1>Title</h1></header><section><p>a b c</p></section><section><ul><li>x<li>y</ul><form>f</form></section></article>", "Title a b c x y"),
        ("<div class=ad>long long long advert</div><article><p>hi</p></article>", "hi"),
        ("<div class='cookie-notice'>c</div><p>text</p><script>var x='<p>no</p>'</script>", "text"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"), ("a < b &am", "a < b &am"), ("<article><p>caf&eacute; &#x41;&#66;</p></article>", "café AB"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


LINKS = "<ul>" + "".join(f"<li><a href='/{i}'>Topic number {i}</a></li>" for i in range(8)) + "</ul>"
PROSE = [f"Sentence {i} of a longer story, which goes on for a while and holds no link at all, so that it is dense." for i in range(12)]


def paragraphs(a, b):
    return "".join(f"<p>{x}</p>" for x in PROSE[a:b])


@pytest.mark.parametrize(
    ("html", "text"),
    [
        # no article or main: lists of links without a telling class
        (f"<body><div>{LINKS}</div><div>{paragraphs(0, 4)}</div><div>{LINKS}</div></body>", PROSE[:4]),
        (f"<body><div><div>{LINKS}</div><div><div>{paragraphs(0, 4)}</div></div></div></body>", PROSE[:4]),
        (f"<body>{LINKS}{paragraphs(0, 4)}{LINKS}</body>", PROSE[:4]),
        (f"<body><div><a href=a>One link</a></div><div><a href=b>Another one</a></div>{paragraphs(0, 4)}</body>", PROSE[:4]),
        (f"<body>{LINKS}{'<br><br>'.join(PROSE[:4])}<div>{LINKS}</div></body>", PROSE[:4]),
        # every article and section, also with lists between them
        (f"<article>{paragraphs(0, 4)}</article><div>{LINKS}</div><article>{paragraphs(4, 6)}</article>", PROSE[:6]),
        (f"<main><article>{paragraphs(0, 2)}</article>{LINKS}<article>{paragraphs(2, 8)}</article></main>", PROSE[:8]),
        (f"<div><section>{paragraphs(0, 2)}</section><div>{LINKS}</div><section>{paragraphs(2, 7)}</section></div>", PROSE[:7]),
        # a class word, a role or a form around the whole page
        (f"<div class='no-sidebar'><div>{LINKS}</div><div>{paragraphs(0, 4)}</div></div>", PROSE[:4]),
        (f"<form id=page>{LINKS}<div>{paragraphs(0, 4)}</div><select><option>o</select></form>", PROSE[:4]),
        (f"<div class='with-sidebar'><article>{paragraphs(0, 4)}</article><div class=sidebar>{paragraphs(4, 5)}</div></div>", PROSE[:4]),
        (f"<div>{paragraphs(0, 4)}<span class='share'>Share <span>this</span> now</span></div><div class='comments'>{paragraphs(4, 8)}</div>", PROSE[:4]),
        (f"<article>{paragraphs(0, 1)}</article><div class='comments'>{paragraphs(1, 12)}</div>", PROSE[:1]),
    ],
)
def test_main_text_by_density(html, text):
    assert html_text.main_text(html) == " ".join(text)


def test_extract_keeps_columns(spark):
    df = spark.createDataFrame([(1, "<p>x</p>", "old"), (2, None, "old")], "page_id int, html string, text string")
    out = html_text.extract(df.withColumn("h", F.col("html")), "h")
    assert [(r["page_id"], r["text"]) for r in out.orderBy("page_id").collect()] == [(1, "x"), (2, "")]
    assert html_text.main_text("<div>" * 20_000 + "deep" + "</p></section>" * 20_000 + "</div>" * 20_000) == "deep"
    same = spark.createDataFrame([(1, "<p>x y</p>"), (1, "<p>x y</p>"), (None, "<p>x y</p>"), (2, ""), (3, "<p>" + "long text " * 100_000)], "page_id int, html string")
    assert sorted(len(r["text"]) for r in html_text.extract(same).collect()) == [0, 3, 3, 3, 999_999]
    assert html_text.extract(same.limit(0)).count() == 0


PAGES = Path("/root/testdata/sf0.01/pages.parquet")


@pytest.mark.skipif(not PAGES.exists(), reason="no test tables")
def test_what_density_and_weights_do():
    """The article of the given pages, also after its name and those of menu, footer and advert are taken away: then density has to find it."""
    import pyarrow.parquet as pq

    def article(page):
        inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        return " ".join(unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(?:h1|p|br|li|ul|div|table|tr|td)[^>]*>", " ", inner))).split())

    pages = [p for p in pq.read_table(PAGES)["html"].to_pylist() if p]
    bare = [re.sub(r"<(/?)(?:article|nav|footer)\b", r"<\1div", p).replace(' class="ad"', "") for p in pages]
    right = lambda some, **how: sum(html_text.main_text(p, **how) == article(q) for p, q in zip(some, pages, strict=True)) / len(pages)
    assert right(pages) == 1
    assert right(bare) > 0.85  # articles shorter than the advert and the footer are lost
    assert right(bare, dense=False) == 0
    assert 0.85 < right(pages, weigh=False) < 1


def test_trigrams_do_not_hang_on_neighbours():
    import pyarrow as pa

    texts = ["", "a", None, "Die und", "", "a", "x  y", "Die und"]
    alone = [next(langid.trigram_counts(pa.array([t], pa.string())))[1][0] for t in texts]
    together = next(langid.trigram_counts(pa.array(texts)))[1]
    assert np.array_equal(np.array(alone), together)
    assert together[1].sum() == 1 and together[0].sum() == 0
