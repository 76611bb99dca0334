"""Clashing and dotted columns, repeated ids, deep nesting: what the operators and stages return for them."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from facewave.llm import html_text, kd_shards, periodic_runs, prefix_trie, quality_rules, suffix_arrays, vp_search

ODD = "doc_id long, text string, lang string, source string, n_chars long, score string, rejected int, lang_pred string, predicted string, `a.b` string, __text int, __part int, __html int, sid int"
PROSE = "the thing about the north wind is that it never rests over the heath in winter and the sheep know it well enough".split()


def document(i, text, lang="en"):
    return (i, text, lang, "s", len(text or ""), "mine", 7, "keep", "own", "dot", 1, 2, 3, 4)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    rows = [document(i, " ".join(rng.permutation(PROSE)) + f" number {i}") for i in range(60)]
    rows += [document(60, rows[3][1]), document(61, None), document(62, ""), document(None, " ".join(rng.permutation(PROSE))), document(5, rows[5][1])]
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([("b1", "never mind " + " ".join(PROSE), 1)], "item_id string, text string, `x.y` int").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0), "z") for i in range(60)], "doc_id long, quality int, toxic int, score string").write.parquet(f"{folder}/labels.parquet")
    return spark.createDataFrame(rows, ODD), str(folder)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_leave_columns_alone(spark, odd, stage):
    docs, folder = odd
    out = stage[1](spark, docs, folder)
    assert out.schema == docs.schema
    got, all_rows = Counter(map(tuple, out.collect())), Counter(map(tuple, docs.collect()))
    assert got and not got - all_rows
    empty = stage[1](spark, docs.limit(0), folder)
    assert empty.columns == docs.columns and empty.count() == 0


def test_last_stage(spark, odd):
    docs, folder = odd
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_operators_read_odd_tables(spark, odd):
    docs, folder = odd
    n = docs.count()
    assert periodic_runs.document_runs(docs).count() == quality_rules.compression_bands(docs).count() == n
    assert suffix_arrays.locate(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).count() == n
    out = kd_shards.shards(docs, 3, F.octet_length(F.coalesce("text", F.lit(""))) + 16, {"c": kd_shards.scaled(docs, "n_chars"), "d": kd_shards.placed_by(docs, "a.b")}, F.crc32(F.coalesce("text", F.lit("")).cast("binary")), "doc_id")
    assert out.columns == [*docs.columns, "shard", "slot"]
    assert Counter(map(tuple, out.drop("shard", "slot").collect())) == Counter(map(tuple, docs.collect()))
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("html"), "`a.b`", "__html")
    out = html_text.extract(pages)
    assert out.columns == [*pages.columns, "text"] and out.count() == n
    assert html_text.extract(pages, "html", "html").columns == ["page_id", "a.b", "__html", "html"]
    turns = spark.createDataFrame([(1, 0, "user", "x", 5, "q")], "conv_id long, turn long, role string, text string, depth int, `a.b` string")
    assert prefix_trie.conversation_trie(turns).count() == 2


def test_equal_texts_share_a_shard(spark):
    """Copies that differ in every dimension stay together; only a group larger than a quarter of a shard is split."""
    rng = np.random.default_rng(0)
    rows = [(i, f"text {rng.integers(400)} " + "x" * int(rng.integers(10)) * 0, float(rng.random()), int(rng.integers(99))) for i in range(3000)] + [(5000 + i, "hot", float(rng.random()), 1) for i in range(1500)]
    points = spark.createDataFrame(rows, "id long, text string, p double, q int").withColumns({"size": F.octet_length("text") + 16, "crc": F.crc32(F.col("text").cast("binary"))})
    points = kd_shards.in_groups(points, ["text"], ["p", "q"], "id", 9).cache()
    assert points.count() == 4500
    dims = {"p": kd_shards.scaled(points, "p"), "q": kd_shards.scaled(points, "q")}
    got = kd_shards.shards(points, 9, F.col("size"), dims, F.col("crc"), "id", F.col("tie")).toPandas()
    each = got.groupby("text").shard.nunique()
    assert (each.drop("hot") == 1).all() and each["hot"] > 1
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 9 and size.max() - size.min() <= 2 * got.groupby("text")["size"].sum().drop("hot").max()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


@pytest.mark.parametrize("copies", [6, 25])
def test_a_query_id_on_several_rows(spark, copies):
    rng = np.random.default_rng(1)
    near = np.array([5.0, 5.0, 5.0])
    rows = [(0, (near + rng.normal(0, 0.01, 3)).tolist()) for _ in range(copies)] + [(i, rng.normal(0, 1, 3).tolist()) for i in range(1, 31)] + [(7, (2 * near).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = vp_search.search(df, df.where("vec_id = 0"), k=5, factor=1.0, shard_rows=1000).orderBy("rank").collect()
    asked = min(v for i, v in rows if i == 0)
    want = sorted(((-float(np.dot(v, asked)), i) for i, v in rows if i), key=lambda x: x)[:5]
    assert [(r.vec_id, round(r.score, 6)) for r in got] == [(i, round(-s, 6)) for s, i in want]


ARTICLE = "One long sentence of the article follows another, and each says a little more about the matter at hand. " * 8


@pytest.mark.parametrize("html", [
    "<article><p>{}</p>" + "<div class='comment'>" * 400 + "deep" + "</div>" * 400 + "</article>",
    "<div class='main-with-sidebar'><p>{}</p></div><div class='footer'>" + ARTICLE[:400] + "</div>",
    "<div class='no-sidebar'><p>{}</p></div><div><a href=x>one</a></div>",
    "<div class='widget'><p>{}</p></div><div class='footer'>" + ARTICLE[:300] + "</div>",
    "<div id='search'><p>{}</p></div><nav>" + "<a href=x>link</a> " * 20 + "</nav>",
])
def test_articles_are_not_lost(html):
    assert html_text.main_text(html.format(ARTICLE)).startswith(ARTICLE[:200])


def test_pages_of_menus_are_empty():
    assert html_text.main_text("<nav><a href=x>a</a> <a href=y>b</a></nav><footer>Imprint</footer>") == ""
    assert html_text.main_text("<div class='comment'>" * 3000 + "x") in ("", "x")
