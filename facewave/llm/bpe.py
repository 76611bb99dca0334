"""BPE encoding and decoding of whole texts with the file of a public tokenizer (operator 9).

A word is a row of a matrix: the parts between its boundaries and, beside them, the rank of every adjacent pair. All
distinct new words of a slice are handled together: find each row's smallest rank (leftmost first), merge it by deleting
one boundary, look up the two ranks beside it, and repeat until no row has a pair that merges. Words of more than
``LONG`` bytes keep the same arrays in a heap, so that a very long run of letters stays near-linear.

Defined results: null text counts as empty (no ids); the strings of special tokens in a text become their ids, as the
library does by default; repeated rows give equal results; other columns are not touched.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from facewave.llm._shared import by_place, named
from facewave.llm._text import SLICE, slices, tidy, utf8

LONG = 48
NONE = np.iinfo(np.int32).max
#: Bytes of a generation of kept results, of which there are two; words of more than ``LONG`` letters are not kept.
KEPT = 32 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the others
    for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _weight(word: str, found) -> int:
    """Bytes that a kept result takes, about: the word, a place in the dictionary, and what was found."""
    return 160 + len(word) + (40 * len(found) if not found or isinstance(found[0], int) else sum(64 + len(x) for x in found))


class Kept:
    """Results by word in two generations: when the newer is full it becomes the older, and words in use move on."""

    def __init__(self) -> None:
        self.now: dict = {}
        self.before: dict = {}
        self.size = 0  # of the newer, about

    def put(self, words: list[str], found: list) -> None:
        self.now.update(zip(words, found, strict=True))
        self.size += sum(map(_weight, words, found))

    def forget(self, words: list[str]) -> None:
        """Drops those of ``words`` that are too long to keep."""
        for w in words:
            if len(w) > LONG:
                del self.now[w]

    def missing(self, words: set[str]) -> list[str]:
        """Has every known one of ``words`` in ``now``; returns the others."""
        if self.size > KEPT:
            self.now, self.before, self.size = {}, self.now, 0
        new = [w for w in words if w not in self.now]
        old = [w for w in new if w in self.before]
        self.put(old, [self.before[w] for w in old])
        return [w for w in new if w not in self.before]


class Bpe:
    """One tokenizer file, with pair ranks as sorted arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.name = {i: t for t, i in {**self.vocab, **self.special}.items()}
        self.end = model.get("end_of_word_suffix") or ""
        kinds = json.dumps([spec.get(k) for k in ("normalizer", "pre_tokenizer")])
        if not self.end or '"NFC"' not in kinds or '"Lowercase"' not in kinds or model.get("byte_fallback"):
            raise ValueError(f"{path}: only byte-level BPE with word ends, NFC and lower case is built")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # \s as Unicode White_Space, which Python's own classes extend by four separators
        space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", f"[^{space}"))
        self.parts = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        # the same classes spelled out for texts that stay below U+0250, where Python's own matcher is several times faster
        among = lambda kind: "".join(f"\\u{c:04x}" for c in range(0x250) if regex.match(kind, chr(c)))
        letter, number, blank = among(r"\p{L}"), among(r"\p{N}"), among(f"[{space}]")
        self.latin = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{letter}]+|[{number}]|[^{blank}{letter}{number}]+")
        self.beyond = re.compile("[^\u0000-\u024f]")
        letters = byte_letters()
        self.inner = np.array([self.vocab[c] for c in letters], np.int32)
        self.last = np.array([self.vocab[c + self.end] for c in letters], np.int32)
        pairs = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        key = np.array([(a << 32) | b for a, b, _ in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.merged = np.array([m for *_, m in pairs], np.int32)
        self.pairs = {(a, b): (r, m) for r, (a, b, m) in enumerate(pairs)}
        self.seen, self.written = Kept(), Kept()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def short(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of words of at most ``LONG`` bytes, all in one matrix."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        width = int(size.max())
        part = np.full((len(words), width + 1), -1, np.int32)
        inside = np.arange(width)[None, :] < size[:, None]
        part[:, :width][inside] = self.inner[np.frombuffer(b"".join(words), np.uint8)]
        part[np.arange(len(words)), size - 1] = self.last[np.fromiter((w[-1] for w in words), np.uint8, len(words))]
        rank = np.full((len(words), width), NONE, np.int32)
        rank[:, :] = self.rank(part[:, :-1].ravel(), part[:, 1:].ravel()).reshape(rank.shape)
        live = np.arange(len(words))
        cols = np.arange(width + 1)
        out: list[tuple[int, ...] | None] = [None] * len(words)
        p, r, count = part, rank, size.copy()
        while len(live):
            at = r.argmin(axis=1)
            low = r[np.arange(len(live)), at]
            done = low == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[live[i]] = tuple(p[i, : count[i]].tolist())
                keep = ~done
                live, p, r, count, at, low = live[keep], p[keep], r[keep], count[keep], at[keep], low[keep]
                if not len(live):
                    break
            here = np.arange(len(live))
            p[here, at] = self.merged[low]
            # the boundary after the merged part goes: everything right of it moves one place left
            source = np.minimum(cols[None, :] + (cols[None, :] > at[:, None]), width)
            p = np.take_along_axis(p, source, axis=1)
            p[:, width] = -1
            r = np.take_along_axis(r, np.minimum(source[:, :width], width - 1), axis=1)
            r[:, width - 1] = NONE
            r[here, at] = self.rank(p[here, at], p[here, at + 1])
            left = np.flatnonzero(at)
            r[left, at[left] - 1] = self.rank(p[left, at[left] - 1], p[left, at[left]])
            count = count - 1
        return out  # type: ignore[return-value]

    def long(self, word: bytes) -> tuple[int, ...]:
        """The same merges for one long word, the smallest rank kept in a heap."""
        ids = [*(int(self.inner[b]) for b in word[:-1]), int(self.last[word[-1]])]
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(x[0], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (x := self.pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.pairs[a, b][1], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (found := self.pairs.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (found[0], x, ids[x], ids[y]))
        return tuple(i for i in ids if i >= 0)

    def split(self, text: str | None) -> list[str]:
        """The words of a text; special tokens stand as themselves."""
        out: list[str] = []
        for piece in self.parts.split(text) if text and self.parts and "<" in text else (text,):
            if piece in self.special:
                out.append(piece)
            elif piece:
                piece = piece if piece.isascii() or unicodedata.is_normalized("NFC", piece) else unicodedata.normalize("NFC", piece)
                piece = piece.replace("Σ", "σ").lower()
                out += self.words.findall(piece) if self.beyond.search(piece) else self.latin.findall(piece)
        return out

    def ids(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of distinct words; words of like length share a matrix."""
        known = {w: (self.special[w],) for w in words if w in self.special}
        raw = sorted(((w, w.encode()) for w in words if w not in known), key=lambda x: len(x[1]))
        known.update((w, self.long(b)) for w, b in raw if len(b) > LONG)
        brief = [x for x in raw if len(x[1]) <= LONG]
        for k in range(0, len(brief), 4096):
            part = brief[k : k + 4096]
            known.update(zip((w for w, _ in part), self.short([b for _, b in part]), strict=True))
        return [known[w] for w in words]

    def found(self, texts: list[str | None], kept: Kept, of) -> list[list]:
        """For each text, what ``kept`` has for its words; ``of`` makes it from the ids of a word."""
        split = [self.split(t) for t in texts]
        new = kept.missing(set(chain.from_iterable(split)))
        kept.put(new, [*map(of, self.ids(new))])
        have = kept.now.__getitem__
        out = [[*map(have, words)] for words in split]
        kept.forget(new)
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [[i for ids in found for i in ids] for found in self.found(texts, self.seen, tuple)]

    def decode(self, ids: list[int] | None) -> str:
        """Names joined by one blank, special tokens too; ids outside the vocabulary are left out."""
        return " ".join(self.name[i] for i in ids or () if i in self.name)


    def clear(self) -> None:
        """Drops kept results: they serve one task."""
        self.seen, self.written = Kept(), Kept()


@lru_cache(maxsize=1)
def load(path: str) -> Bpe:
    return Bpe(path)


def _runs(column: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a column, some at a time."""
    _, offsets = utf8(column)
    for first, last in slices(offsets, SLICE):
        yield column.slice(first, last - first).to_pylist()


def _task(path: str, work: Callable[[Bpe, pa.RecordBatch], pa.RecordBatch]) -> Callable:
    """``work`` on every batch of a task; what it has kept goes when the task ends."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        try:
            for batch in batches:
                yield work(bpe, batch)
        finally:
            bpe.clear()

    return tidy(batches_of)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids`` (array<int>) to every row; a column of that name is replaced."""

    def work(bpe: Bpe, batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [pa.array(bpe.encode(run), pa.list_(pa.int32())) for run in _runs(batch.column(place))]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))], schema.names)

    df = df.select([named(c) for c in df.columns if c != ids])
    place, schema = df.columns.index(text), StructType([*df.schema, StructField(ids, ArrayType(IntegerType()))])
    return by_place(df).mapInArrow(_task(path, work), schema)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the text of ``ids`` to every row; a column of that name is replaced. Null ids give an empty text."""

    def work(bpe: Bpe, batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(place)
        out = [bpe.decode(x) for first in range(0, len(column), 256) for x in column.slice(first, 256).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], schema.names)

    df = df.select([named(c) for c in df.columns if c != decoded])
    place, schema = df.columns.index(ids), StructType([*df.schema, StructField(decoded, StringType())])
    return by_place(df).mapInArrow(_task(path, work), schema)


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row: each text is encoded, its ids are decoded again, and only
    the digests of both leave the task."""

    def work(bpe: Bpe, batch: pa.RecordBatch) -> pa.RecordBatch:
        name = bpe.name
        of = lambda ids: (" ".join([str(i) for i in ids]), " ".join([name[i] for i in ids]))
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        n, a, b = [], [], []
        for run in _runs(batch.column(1)):
            for found in bpe.found(run, bpe.written, of):
                numbers = " ".join([x[0] for x in found])
                n.append(numbers.count(" ") + 1 if numbers else 0)
                a.append(sha(numbers))
                b.append(sha(" ".join([x[1] for x in found])))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(_task(path, work), f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
