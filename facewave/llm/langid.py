"""Language identification by nearest centroid (operator 10).

A text is the vector of its byte trigrams (A-Z in lower case, other ASCII that is no letter as one blank), hashed to
``DIM`` places, weighted by TF-IDF and set to length one. Each language has a few centroids, found by spherical k-means
among its own training rows; the nearest centroid by cosine names the language. Cosines grow with length, so texts are held against training rows of their own
length (trigrams between two powers of two): a text is ``rejected`` if its best cosine lies below ``STRICT`` of the lowest per mille there. Shorter ones than
``BRIEF`` trigrams, of which a clean one may have no common trigram, are rejected only below a quarter of the lowest per mille of all rows.

Bound: the model is fitted on about ``per_lang`` rows of each language, ``per_model`` in all (chosen by a hash of the key; all rows where there
are fewer); its size does not follow the input. Every text is scored whole.

Defined results: null text, or text without a letter, is ``und`` with score 0 and rejected; with no training rows every
text is ``und``; equal texts get equal results; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from facewave.llm._shared import by_place, named, rows_where
from facewave.llm._text import SLICE, slices, tidy, utf8

DIM = 4096
MOST = 65535  # a trigram counts so often in a text at most, in training and later
LENGTHS = 40
#: Trigrams from which on a text is held against those of its length, the share of their lowest cosine, and rows that make a length's bound.
BRIEF, STRICT, ENOUGH = 64, 0.5, 30
LETTER = regex.compile(r"\p{L}")
#: Bytes as they count: letters in lower case, all bytes from 0x80 on as they are, the rest as a blank.
CLASS = np.full(256, 0x20, np.uint8)
CLASS[0x61:0x7B] = np.arange(0x61, 0x7B)
CLASS[0x41:0x5B] = np.arange(0x61, 0x7B)
CLASS[0x80:] = np.arange(0x80, 0x100)


def _codes(part: np.ndarray) -> np.ndarray:
    """The place of each trigram."""
    part = part.astype(np.uint32)
    code = part[:-2] * np.uint32(0x9E3779B1) ^ part[1:-1] * np.uint32(0x85EBCA77) ^ part[2:] * np.uint32(0xC2B2AE3D)
    return (code * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 12)


def _long_counts(raw: np.ndarray) -> np.ndarray:
    """The counts of one text, a part at a time; runs of blanks are one."""
    part = np.concatenate(([0x20], CLASS[raw], [0x20])).astype(np.uint8)
    part = part[np.concatenate(([True], (part[1:] != 0x20) | (part[:-1] != 0x20)))]
    return sum(np.bincount(_codes(part[k : k + SLICE + 2]), minlength=DIM) for k in range(0, max(len(part) - 2, 1), SLICE))


def trigram_counts(column: pa.Array, rows: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts [rows, DIM]) of runs of rows."""
    data, offsets = utf8(column)
    for start, stop in slices(offsets, SLICE):
        for first in range(start, stop, rows):
            last = min(first + rows, stop)
            if offsets[last] - offsets[first] > SLICE:  # one long text: slices are shorter otherwise
                yield first, _long_counts(data[offsets[first] : offsets[last]]).astype(np.int32)[None]
                continue
            at = offsets[first : last + 1] - offsets[first]
            part = CLASS[data[offsets[first] : offsets[last]]]
            owner = np.repeat(np.arange(last - first, dtype=np.int32), np.diff(at))
            # a blank on both sides of every text, so that the shortest one has a trigram
            edges = np.concatenate([at[1:], at[:-1]])  # where two texts meet, the end of one stands before the start of the next
            part = np.insert(part, edges, 0x20)
            owner = np.insert(owner, edges, np.concatenate([np.arange(last - first, dtype=np.int32)] * 2))
            keep = np.ones(len(part), bool)
            keep[1:] = (part[1:] != 0x20) | (part[:-1] != 0x20) | (owner[1:] != owner[:-1])
            code, owner = _codes(part[keep]), owner[keep]
            same = owner[2:] == owner[:-2]
            cells = np.bincount(owner[:-2][same] * DIM + code[same].astype(np.int32), minlength=(last - first) * DIM)
            yield first, cells.astype(np.int32).reshape(last - first, DIM)


def lettered(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter. Only texts without one in ASCII are looked at by character."""
    data, offsets = utf8(column)
    out = np.zeros(len(column), bool)
    for first, last in slices(offsets, SLICE):
        ascii_letters = (CLASS[data[offsets[first] : offsets[last]]] - np.uint8(0x61)) < 26
        seen = np.concatenate(([0], np.cumsum(ascii_letters, dtype=np.int64)))
        out[first:last] = np.diff(seen[offsets[first : last + 1] - offsets[first]]) > 0
    for row in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[row] = LETTER.search(data[offsets[row] : offsets[row + 1]].tobytes().decode()) is not None
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Model:
    names: list[str]  # one for each centroid
    idf: np.ndarray
    centroids: np.ndarray
    reject_below: np.ndarray  # by length: the whole logarithm (base 2) of the number of trigrams

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return unit(np.log1p(np.minimum(counts, MOST), dtype=np.float32) * self.idf)


def length_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts.sum(axis=1), 1)).astype(np.int64), LENGTHS - 1)


def bounds(length: np.ndarray, best: np.ndarray) -> np.ndarray:
    """The least cosine that is not rejected, by length; a length with few rows takes the bound of the one below it."""
    out = np.full(LENGTHS, np.quantile(best, 0.001) / 4)
    for k in range(BRIEF.bit_length() - 1, LENGTHS):
        here = best[length == k]
        out[k] = STRICT * np.quantile(here, 0.001) if len(here) >= ENOUGH else out[k - 1]
    return out


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; every start after the first is drawn (by a fixed seed) the likelier the farther it is from the others.
    Clusters under a twentieth of the rows are dropped, as they may be rows with a wrong label."""
    rng = np.random.default_rng(0)
    starts = [x[int(rng.integers(len(x)))]]
    while len(starts) < min(k, len(x)):
        far = np.clip(1 - (x @ np.array(starts).T).max(axis=1), 0, None) ** 2
        if not far.sum():
            break
        starts.append(x[int(rng.choice(len(x), p=far / far.sum()))])
    c = np.array(starts)
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = unit(np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))]))
    share = np.bincount((x @ c.T).argmax(axis=1), minlength=len(c)) / len(x)
    return c[share >= min(0.05, share.max())]


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 800, clusters: int = 3, per_model: int = 40_000) -> Model | None:
    """The model of the languages in ``rows``; None where no row has both a language and a text. With very many languages each has fewer rows, so that
    ``per_model`` rows (8 kB each) come to the driver in all."""
    rows = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    per_lang = max(1, min(per_lang, per_model // len(sizes)))
    share = F.create_map(*[F.lit(x) for n, c in sizes.items() for x in (n, int(2**20 * min(1.0, per_lang / c)))])
    sample = rows.where(F.pmod(F.xxhash64("key"), F.lit(2**20)) < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, cells in trigram_counts(batch.column(0)):
                packed = [np.minimum(c, MOST).astype(np.uint16).tobytes() for c in cells]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, len(cells)), pa.array(packed, pa.binary())], ["lang", "cells"])

    got = sample.select("text", "lang").mapInArrow(tidy(count), "lang string, cells binary").toArrow()
    labels = np.array(got["lang"].to_pylist())
    if not len(labels):
        return None
    counts = np.array([np.frombuffer(c, np.uint16) for c in got["cells"].to_pylist()])
    counts, labels = counts[counts.any(axis=1)], labels[counts.any(axis=1)]
    if not len(labels):
        return None
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    model = Model([], idf, np.empty((0, DIM), np.float32), np.zeros(LENGTHS))
    x = model.vectors(counts)
    order = np.lexsort(x.T[:8])  # the sample comes in any order; the starts must not follow it
    x, labels, length = x[order], labels[order], length_of(counts)[order]
    found = [(name, c) for name in sorted(set(labels)) for c in k_means(x[labels == name], clusters)]
    centroids = np.array([c for _, c in found], np.float32)
    best = (x @ centroids.T).max(axis=1)
    return Model([str(n) for n, _ in found], idf, centroids, bounds(length, best))


def predict(df: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score (cosine with the nearest centroid) and rejected to the columns ``keep`` (default: all);
    columns of these names are replaced."""
    new = StructType.fromDDL("lang_pred string, score double, rejected boolean")
    kept = [c for c in (df.columns if keep is None else keep) if c not in new.names]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, rejected = judge(batch.column(0), model)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], [*kept, *new.names])

    return by_place(df.select(named(text), *map(named, kept))).mapInArrow(tidy(work), StructType([*(df.schema[c] for c in kept), *new]))


def judge(column: pa.Array, model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether the text is rejected, of each text."""
    letters = lettered(column)
    best, at, least = np.zeros(len(column)), np.zeros(len(column), np.int64), np.full(len(column), 2.0)
    if model:
        for first, cells in trigram_counts(column):
            near = model.vectors(cells) @ model.centroids.T
            best[first : first + len(cells)] = near.max(axis=1)
            at[first : first + len(cells)] = near.argmax(axis=1)
            least[first : first + len(cells)] = model.reject_below[length_of(cells)]
    names = [model.names[i] if ok and model else "und" for i, ok in zip(at, letters, strict=True)]
    score = np.where(letters, np.clip(best, 0, 1), 0.0)
    return names, score, ~letters | (score < least)


def accepted(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows that are not rejected, in their own columns, whatever these are called."""
    return rows_where(df, text, lambda column: ~judge(column, model)[2])


def held_out(key: str = "doc_id") -> F.Column:
    return F.crc32(F.col(key).cast("string")) % 4 == 2


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()))
    return predict(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
