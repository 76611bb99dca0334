"""Periodic runs, the conversation trie and compression bands against plain versions."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from facewave.llm import periodic_runs, prefix_trie, quality_rules
from facewave.llm.oracle import ORACLE_SQL

DATA = Path("/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMPTY = hashlib.sha256(b"").hexdigest()


def plain_runs(w, exponent, least):
    """Every maximal stretch of each period, kept if no smaller period fits."""
    out = set()
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            n, x = j - i + p, w[i : j + p]
            if j > i and n >= max(least, exponent * p) and all(any(x[k] != x[k + d] for k in range(n - d)) for d in range(1, p)):
                out.add((i, n, p))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@given(st.lists(st.integers(0, 2), max_size=40), st.sampled_from([2, 3, 4]))
@settings(max_examples=400, deadline=None)
def test_runs_are_all_found(words, exponent):
    assert periodic_runs.runs(words, exponent, 2) == plain_runs(words, exponent, 2)


@given(st.lists(st.integers(0, 3), min_size=1, max_size=25))
@settings(max_examples=300, deadline=None)
def test_lyndon_groups(words):
    size, group = periodic_runs.lyndon_groups(words)
    for i in range(len(words)):
        smaller = next((j for j in range(i + 1, len(words)) if words[j:] < words[i:]), len(words))
        assert size[i] == smaller - i
        for j in range(i):
            assert (group[i] == group[j]) == (words[i : i + size[i]] == words[j : j + size[j]])


def test_long_runs_are_linear():
    assert periodic_runs.runs([7] * 100_000) == [(0, 100_000, 1)]
    assert periodic_runs.runs([*range(1000)] * 40) == [(0, 40_000, 1000)]


def plain_document(doc_id, text):
    w = WORD.findall(text or "")
    h, n = (zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w, 4, 6)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    listed = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def texts():
    r = random.Random(5)
    some = [None, "", " \n\t", "one", "a a a a a a", "a a a a a", "a b a b a b a b", "x a b a b a b a b a y", "é é é é é é é", "a\nb\ta b\x0ba b a b", "A a A a A a A a", "a\x00 a\x00 a\x00 a\x00 a\x00 a\x00"]
    for _ in range(200):
        w = [r.choice("ab cd é f g".split()) for _ in range(r.randrange(60))]
        i, p = r.randrange(len(w) + 1), r.randrange(1, 6)
        w[i:i] = [f"w{k % p}" for k in range(r.randrange(4 * p + 6))]
        some.append(r.choice([" ", "\n", "  \t"]).join(w))
    some.append(" ".join(["lorem ipsum dolor"] * 90_000))  # more than a slice
    return some


def test_document_runs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(3, "b b b b b b", "x", 1), (3, "b b b b b b", "x", 1), (None, "c c c c c c c", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs string, `a.b` int")
    got = periodic_runs.document_runs(docs, tails=True).drop("n_words").collect()
    long = len(texts()) - 1
    assert sorted(map(str, (tuple(r) for r in got if r.doc_id != long))) == sorted(str(plain_document(r[0], r[1])) for r in rows if r[0] != long)
    (r,) = [r for r in got if r.doc_id == long]
    assert (r.n_runs, r.start, r.length, r.period) == (1, 0, 270_000, 3) or zlib.crc32(str(long).encode()) % 10 == 0
    assert periodic_runs.document_runs(docs.limit(0)).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_op11_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[:-1] for r in periodic_runs.op11_periodic_runs(spark, str(DATA)).collect()}
    short = [d for d in docs if len(d.text or "") < 4000]
    assert len(got) == len(docs) and len(short) > 100
    for d in short:
        assert got[d.doc_id] == plain_document(d.doc_id, d.text)


def plain_bands(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_base_rules_against_a_plain_version(spark):
    some = [*texts(), "#*$%&|<>" * 3, "a b c d e f g h a b c d e f g h", "é\n\n é\né\n", "same line\nsame line \nsame line"]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(some)] + [(0, None, False), (None, "x", None)], "doc_id long, text string, kept boolean")
    for r in quality_rules.compression_bands(docs).collect():
        if r.doc_id is not None:
            assert tuple(r)[1:7] == plain_bands(some[r.doc_id])
            assert not (r.base_failed and r.kept)
    assert quality_rules.compression_bands(docs.limit(0)).count() == 0


def judged(text):
    return dict(zip(("words", "chars", "symbols", "dup", "repeat", "failed", "kept", "ratio", "outside"), next(iter(quality_rules.judged(pa.array([text])))), strict=True))


def prose(n, seed=0, words=400):
    r = random.Random(seed)
    stock = ["".join(r.choice(["th", "er", "in", "an", "ou", "st", "re", "ly"]) for _ in range(r.randrange(1, 5))) for _ in range(words)]
    return " ".join(r.choice(stock) for _ in range(n))


def test_bands():
    for n in (25, 100, 1000, 20_000):
        assert judged(prose(n))["kept"], n
    assert not judged(" ".join(w for w in prose(40).split() for _ in range(7)))["kept"]  # each word seven times: no window of eight occurs twice
    r = random.Random(1)
    noise = "".join(chr(r.randrange(0x20, 0x7F)) for _ in range(6000))
    assert not judged(noise)["kept"] and not judged(noise)["failed"] and judged(noise)["ratio"] > 0.75
    # half of the chunks are noise: the whole lies in its band, the chunks do not
    mixed = judged(prose(3000) + " " + "".join(chr(r.randrange(0x20, 0x7F)) for _ in range(20_000)))
    assert mixed["outside"] > 0.3 and not mixed["kept"] and not mixed["failed"]
    one = judged(prose(12_000) + " " + noise[:4000])  # one chunk of many does not reject a text
    assert one["kept"] and 0 < one["outside"] < 0.3


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_op13_query(spark):
    rows = {r.doc_id: r for r in quality_rules.op13_compression_bands(spark, str(DATA)).collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    assert all(rows[x.doc_id].kept for x in labels if x.quality == 1 and x.doc_id in rows and not rows[x.doc_id].base_failed)


def plain_trie(convs):
    """convs: id -> list of (role, text)."""
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


def plain_spliced(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + turns[h:]
    return out


def some_conversations(seed, n, longest):
    r = random.Random(seed)
    out = {}
    for c in r.sample(range(4 * n), n):
        copy = list(r.choice(list(out.values()))) if out and r.random() < 0.7 else []
        turns = copy[: r.randrange(len(copy) + 1)]
        turns += [(r.choice(["user", "assistant", ""]), r.choice(["", "a", "bé", "c" * 9])) for _ in range(r.randrange(longest))]
        out[c] = turns or [("user", "x")]
    return out


def as_rows(convs, seed=0):
    r = random.Random(seed)
    rows = [(c, None if i == 0 and r.random() < 0.3 else i * 100, role or r.choice([None, ""]), text or r.choice([None, ""]), i) for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    r.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, depth int"


def result(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


@pytest.mark.parametrize(("n", "longest"), [(60, 5), (25, 90)])
def test_trie(spark, n, longest):
    convs = some_conversations(n, n, longest)
    df = spark.createDataFrame([*as_rows(convs), (None, 1, "user", "nobody", 0)], SCHEMA)
    assert result(prefix_trie.conversation_trie(df)) == plain_trie(convs)
    turns, ids = prefix_trie.numbered(prefix_trie.turn_digests(df))
    assert result(prefix_trie.prefix_trie(*prefix_trie.spliced(turns, ids))) == plain_trie(plain_spliced(convs))


def test_trie_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert result(prefix_trie.conversation_trie(empty)) == []
    # a conversation whose own turns all go and that has no first of its family is a member of the root
    lone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    turns, ids = prefix_trie.numbered(prefix_trie.turn_digests(spark.createDataFrame([(lone, 0, "user", "x", 0)], SCHEMA)))
    assert result(prefix_trie.prefix_trie(*prefix_trie.spliced(turns, ids))) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    # rows with the same turn: an order of their own, the same however the table is dealt
    tied = [(1, 0, "user", t, 0) for t in "abcab"] + [(2, 0, "user", t, 0) for t in "bacba"]
    got = [result(prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(k))) for rows, k in ((tied, 1), (tied[::-1], 5))]
    assert got[0] == got[1] and len(got[0]) == 6 and all(r[3] == 2 for r in got[0])


def test_trie_of_many_copies(spark):
    """Ids of one node in several texts: more copies than one holds, and copies that part late."""
    copies = {c: [("user", f"t{i}") for i in range(20)] for c in range(0, 9000, 2)}
    for c in range(0, 9000, 900):
        copies[c] = copies[c][:17] + [("user", f"own {c}")]
    assert result(prefix_trie.conversation_trie(spark.createDataFrame(as_rows(copies), SCHEMA))) == plain_trie(copies)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_op12_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{os.fspath(DATA)}/conversations.parquet'")
    found = duck.execute(ORACLE_SQL["op12_prefix_trie"])
    names = [c[0] for c in found.description]
    df = prefix_trie.op12_prefix_trie(spark, str(DATA))
    assert df.columns == names
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, found.fetchall()))
