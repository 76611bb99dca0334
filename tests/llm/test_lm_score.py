"""Cross-entropy difference against a plain version."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from facewave.llm import lm_score

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(docs, target, alpha=0.01):
    ids = {}
    for _, t in docs:
        for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)):
            if w not in ids:
                ids[w] = int(next(lm_score.bigrams(pa.array([w])))[3][0])
    pairs, one = (Counter(), Counter()), (Counter(), Counter())
    seqs = {}
    for d, t in docs:
        w = [lm_score.START, *(ids[x] for x in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)))]
        seqs[d] = list(zip(w, w[1:]))
        for k in (0, 1):
            if k == 0 or d in target:
                pairs[k].update(seqs[d])
                one[k].update(a for a, _ in seqs[d])
    out = {}
    for d, s in seqs.items():
        own = (Counter(s), Counter(s) if d in target else Counter())
        before = [Counter(a for a, _ in x.elements()) for x in own]
        scale = (sum(one[1].values()) - own[1].total()) / (sum(one[0].values()) - own[0].total())
        loss = [-sum(math.log((pairs[k][x] - own[k][x]) * m + alpha) - math.log((one[k][x[0]] - before[k][x[0]]) * m + alpha * lm_score.VOCABULARY) for x in s) / len(s) if s else None for k, m in ((1, 1), (0, scale))]
        out[d] = (len(s), loss[0], loss[1], loss[1] - loss[0] if s else 0.0)
    return out


@pytest.mark.parametrize(("hot", "flush"), [(0.001, 1 << 20), (0.0001, 50), (1.0, 1 << 20)])
def test_losses(spark, hot, flush):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 60), p=np.arange(30, 0, -1) / 465))) for i in range(200)]
    docs += [(1000, None), (1001, " "), (1002, "W1  w2\nw1"), (1003, "w0 w1 " * 3000), (1004, docs[0][1])]
    target = {i for i in range(0, 200, 3)}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = {r[0]: tuple(r)[1:] for r in lm_score.losses(df, spark.createDataFrame([(i,) for i in target] * 2, "doc_id long"), hot=hot, flush=flush).collect()}
    want = plain(docs, target)
    assert set(out) == set(want)
    for d in want:
        assert out[d] == want[d] if want[d][1] is None else out[d] == pytest.approx(want[d], rel=1e-9)


def test_pieces_hold_whole_keys():
    pairs = np.sort(np.random.default_rng(2).integers(0, 40, 500).astype(np.uint64) << np.uint64(32) | np.arange(500, dtype=np.uint64))
    parts = list(lm_score._whole_keys(pairs, 30))
    assert np.array_equal(np.concatenate(parts), pairs)
    keys = [set((p >> np.uint64(32)).tolist()) for p in parts]
    assert len(parts) > 5 and not any(a & b for a, b in zip(keys, keys[1:]))


def test_no_target_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (None, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert [(r["doc_id"], r["score"]) for r in lm_score.losses(df, none).collect()] == [(1, 0.0)]
    assert lm_score.losses(df.limit(0), none).count() == 0


def test_only_target_row_and_rows_that_share_an_id(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b d"), (3, "x y")], "doc_id long, text string")
    one = spark.createDataFrame([(1,)], "doc_id long")
    out = {r["doc_id"]: r["score"] for r in lm_score.losses(df, one).collect()}
    assert out[1] == 0.0  # nothing is left of the target
    assert out[2] > out[3]
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b d")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_score.losses(twice, one).collect()}
    assert got[1]["n_tokens"] == 6 and got[1]["score"] > 0  # each row still has the other one


def test_target_documents_score_as_held_out_ones(spark):
    """The documents that were counted as target and good ones that were not have about the same scores."""
    out = lm_score.op3_lm_score(spark, "/root/testdata/sf0.01").toPandas()
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").toPandas()["doc_id"]
    out = out[out.doc_id.isin(good) & (out.n_tokens >= 20)]
    counted, held = out[~out.held_out].score, out[out.held_out].score
    assert len(counted) > 20 and len(held) > 5
    assert abs(counted.mean() - held.mean()) < 3 * (counted.var() / len(counted) + held.var() / len(held)) ** 0.5
