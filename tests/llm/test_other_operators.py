"""Vectors, shards, archives and the pipeline."""

from __future__ import annotations

import base64
import hashlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from facewave.llm import kd_shards, vp_search, warc
from facewave.llm._shared import shared_folder


def test_exact_search_with_factor_one(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[50:60] = x[0]  # copies
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got: dict = {}
    for r in vp_search.search(df, df.where("vec_id % 20 = 0"), k=5, factor=1.0, shard_rows=150, block=7).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for q in range(0, 400, 20):
        score = (x.astype(float) * x[q].astype(float)).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(400), -score)) if i != q][:5]
        assert [got[q][k + 1] for k in range(5)] == [(i, score[i]) for i in order]


def test_a_larger_factor_finds_nearly_all():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = vp_search.VpTree(x)
    qi, rows, every = tree.search(x[:50], 20, 1.0)
    qj, some, fewer = tree.search(x[:50], 20, 4.0)
    exact = set(zip(qi.tolist(), rows.tolist(), strict=True))
    assert len(exact) == 1000 and len(exact & set(zip(qj.tolist(), some.tolist(), strict=True))) >= 900
    assert fewer <= every


def test_ties_and_repeated_ids(spark):
    """Small whole numbers make many equal products, also at the last place; several blocks of queries; ids that come twice."""
    rng = np.random.default_rng(6)
    x = rng.integers(-2, 3, (600, 3)).astype(float)
    x[(x == 0).all(axis=1)] = 1.0
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    df = spark.createDataFrame([*rows, rows[0], rows[20], rows[33]], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in vp_search.search(df, df.where("vec_id % 20 = 0"), k=7, factor=1.0, shard_rows=200, block=9).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert len(got) == 30
    for q, found in got.items():
        score = x @ x[q]
        want = [i for i in np.lexsort((np.arange(600), -score)) if i != q][:7]
        assert sorted(found) == [(n + 1, i, score[i]) for n, i in enumerate(want)]


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_recall_of_the_query(spark):
    got = vp_search.op2_vp_search(spark, "/root/testdata/sf0.01").toPandas()
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    x = np.array(table["embedding"].tolist(), float)
    ids = table["vec_id"].to_numpy()
    hit = 0
    for q, rows in got.groupby("query_id"):
        score = np.where(ids == q, -np.inf, x @ x[ids == q][0])
        hit += len(set(ids[np.argsort(-score)[:20]]) & set(rows["vec_id"]))
        assert np.allclose(sorted(rows["score"]), sorted(score[np.searchsorted(ids, rows["vec_id"])]))
    assert hit >= 0.9 * len(got) and len(got) == 20 * (ids % 20 == 0).sum()


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (20, [float("nan"), 1.0]), (40, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [1.0]), (None, [1.0, 1.0]), (60, []), (5, [1.0, None]), (6, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vp_search.search(df, df.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 3, 5.0), (0, 2, 40, 5.0), (40, 1, 0, 5.0), (40, 2, 3, 5.0)]
    assert vp_search.search(df.limit(0), df).count() == 0


def test_shards_are_even_and_gapless(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(10, 3000)) if i % 3 else 500, int(rng.integers(0, 2**32)) if i % 4 else 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, size long, crc long").withColumns({"slot": F.lit("x"), "shard": F.lit("y")})
    dims = {"size": kd_shards.scaled(df, "size"), "crc": F.shiftright("crc", 8).cast("int")}
    out = kd_shards.shards(df, 7, F.col("size"), dims, F.col("crc"), "doc_id").toPandas()
    assert len(out) == 3000 and set(out["shard"]) == set(range(7))
    total = out.groupby("shard")["size"].sum()
    assert total.max() / total.min() < 1.02
    assert all(sorted(s) == list(range(len(s))) for _, s in out.groupby("shard")["slot"])


def test_shards_of_equal_rows_and_none(spark):
    df = spark.createDataFrame([(i, 100, 5) for i in range(1000)], "doc_id long, size long, crc long")
    dims = {"size": kd_shards.scaled(df, "size")}
    counts = kd_shards.shards(df, 4, F.col("size"), dims, F.col("crc"), "doc_id").groupBy("shard").count().toPandas()["count"]
    assert len(counts) == 4 and counts.max() - counts.min() <= 60
    assert kd_shards.shards(df.limit(0), 4, F.col("size"), dims, F.col("crc"), "doc_id").count() == 0


def test_archive_round_trip(spark):
    pages = [(1, None, None), (2, "http://x/ü\r\nFoo: y", "a\r\n\r\nb"), (3, None, ""), (None, "u", "z"), (5, "u", "a\r\n\r\nb"), (5, "u", "a\r\n\r\nb"), (4, "u", "ß" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("bundle", F.lit(1))
    index = warc.write(df, f"{shared_folder(spark)}/w", frame_bytes=1000)
    got = sorted((r["page_id"], r["record_type"], r["refers_to"] or -1, r["payload_bytes"], r["payload"] or "") for r in warc.read(index).collect())
    assert got == [(1, "revisit", 3, 0, ""), (2, "revisit", 5, 6, ""), (3, "response", -1, 0, ""), (4, "response", -1, 600_000, "ß" * 300_000), (5, "response", -1, 6, "a\r\n\r\nb"), (5, "response", -1, 6, "a\r\n\r\nb")]
    digests = {r["page_id"]: r["payload_digest"] for r in warc.read(index, payloads=False).collect()}
    assert digests[2] == base64.b32encode(hashlib.sha1(b"a\r\n\r\nb").digest()).decode()
    one = index.where("page_id = 4")
    assert [r["page_id"] for r in warc.read(one).collect()] == [4]
    assert {r["refers_to"] for r in warc.read(warc.write(df, f"{shared_folder(spark)}/w", least=1)).where("payload_bytes = 0").collect()} == {None}
    assert warc.write(df.limit(0), f"{shared_folder(spark)}/w").count() == 0


def test_a_bundle_is_plain_zstandard(spark):
    import zstandard
    from pyarrow import fs

    df = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id long, url string, html string").coalesce(1)
    bundle = warc.write(df, f"{shared_folder(spark)}/w", frame_bytes=500).first()["bundle"]
    system, name = fs.FileSystem.from_uri(bundle)
    raw = system.open_input_file(name).read()
    reader = warc.Reader(bundle)
    whole = b"".join(reader.frame(k) for k in range(len(reader.sizes)))
    # any Zstandard reader steps over the seek table
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == whole
    assert len(reader.sizes) > 1


def test_pipeline_keeps_clean_and_drops_the_rest(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tests.llm.test_text_operators import toxic_rows

    rows = [(r["doc_id"], r["text"], r["toxic"]) for r in toxic_rows(spark).collect()]
    copy = rows[1][1]
    passage = "zeta eta theta iota kappa lambda mu nu xi omikron pi"
    docs = [(i, t, "en", "s", len(t)) for i, t, _ in rows] + [(1000, copy, "en", "s", 1), (1001, f"{rows[2][1]} {passage}", "en", "s", 1), (1002, "123", "en", "s", 3), (1003, None, "en", "s", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert kept == {i for i, _, y in rows if not y}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_shards_of_the_query(spark):
    """Sizes, sums and places of op8 by hand; its shards are near equal in bytes as far as single texts allow."""
    import zlib

    docs = spark.read.parquet(str(DATA / "documents.parquet")).toPandas()
    got = kd_shards.op8_kd_shards(spark, str(DATA), 8).toPandas().merge(docs, on="doc_id")
    raw = [(t or "").encode() for t in got["text"]]
    assert len(got) == len(docs) and (got["size"] == [len(t) + 16 for t in raw]).all() and (got["text_crc32"] == [zlib.crc32(t) for t in raw]).all()
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"]) and set(got["shard"]) == set(range(8))
    total = got.groupby("shard")["size"].sum()
    assert (total - got["size"].sum() / 8).abs().max() <= 2 * got["size"].max()


def test_shards_of_odd_rows(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "x", "en", "s", 1), (2, "", "en", None, 0), (3, "y" * 5000, None, "s", -1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    dims = {"lang": kd_shards.placed_by(df, "lang"), "chars": kd_shards.scaled(df, "n_chars")}
    out = kd_shards.shards(df, 3, F.coalesce(F.octet_length("text"), F.lit(0)) + 16, dims, F.crc32(F.coalesce("text", F.lit("")).cast("binary")), "doc_id").toPandas()
    assert len(out) == 5 and set(out["shard"]) <= {0, 1, 2} and all(sorted(s) == list(range(len(s))) for _, s in out.groupby("shard")["slot"])


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_stages_by_brute_force(spark):
    """What the near-duplicate and benchmark stages keep of the given documents, with rows that share an id beside them, against pairs and windows by hand."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tests.llm.test_text_operators import components_by_hand, windows_by_hand

    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    groups = components_by_hand(rows)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, str(DATA)).collect()}
    assert kept == {d for d, (_, low) in groups.items() if d == low}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(str(DATA / "benchmark.parquet")).collect()]
    hit = windows_by_hand(rows, items)
    shared = docs.union(docs.where("doc_id < 40").withColumn("text", F.lit("nothing of any item here, only this")))
    clean = corpus_pipeline.benchmark(spark, shared, str(DATA))
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted([str(d) for d, x in hit.items() if not x[1]] + [str(d) for d, _ in rows if d is not None and d < 40])


def test_pipeline_of_no_rows(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
