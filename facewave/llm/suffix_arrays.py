"""Benchmark decontamination by suffix arrays over the training text (operator 1).

Every task turns its documents into shards of bounded size and builds one suffix array for each: the start of every word
sequence in the benchmark's vocabulary, sorted by the words that follow. All suffixes of all benchmark items are then binary-searched in it
together; their neighbours give the longest verbatim match of each, and the range of suffixes that begin with a window gives all its locations. To find
windows, suffixes are told apart up to a window's words; to find longest matches, up to those of the longest item. A document lies in one shard
only, so what is found in it needs no shuffle.

A window is ``width`` consecutive words of an item; an item with fewer words, but at least one, is one window. Words
outside the benchmark's vocabulary match nothing, so a suffix begins only where one can match.

The benchmark goes to the tasks in blocks of at most ``block_words`` words. Where there are several, the documents are searched once for each, and what the earlier ones
found is stored beside each row: the driver and a task hold one block at a time, and rows, not ids, carry the results.

Defined results: null or empty documents have no words and no hits; null or empty items have no window; repeated items each
count (their ids are all reported); an item without an id counts under an empty one; an empty benchmark hits nothing; rows with equal or null ids are
judged each by its own text; equal texts get equal results; other columns are not touched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facewave.llm._shared import discard, rows_where, stored
from facewave.llm._text import slices, tidy, utf8

#: A-Z in lower case; bytes that are neither letter, digit nor from 0x80 on become blanks.
TO_WORDS = bytes(b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))


#: Words that are compared at a time.
STEP = 16


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


@dataclass
class Suffixes:
    """A block of benchmark items: their words as numbers, one after the other and each item closed by a 0."""

    number: dict[bytes, int]
    flat: np.ndarray
    starts: np.ndarray  # of every suffix
    lengths: np.ndarray  # words of every suffix, up to the end of its item
    owner: list[str]  # item of every suffix
    window_rows: np.ndarray  # for every distinct window, a suffix that begins with it
    widths: np.ndarray  # and its words
    items: list[list[str]]  # and the items that hold it

    @property
    def depth(self) -> int:
        return int(self.lengths.max())


def benchmark_suffixes(items: list[tuple[str, str | None]], width: int = 10) -> Suffixes | None:
    split = [(i, w) for i, t in items if (w := words_of((t or "").encode()))]
    if not split:
        return None
    number = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in split for w in ws}))}
    flat: list[int] = []
    starts, lengths, owner, windows = [], [], [], defaultdict(set)
    first: dict[tuple[int, ...], int] = {}
    for i, ws in split:
        n = [number[w] for w in ws]
        for k in range(len(n)):
            window = tuple(n[k : k + width]) if len(n) - k >= width else tuple(n) if k == 0 else ()
            if window:
                first.setdefault(window, len(starts))
                windows[window].add(i)
            starts.append(len(flat) + k)
            lengths.append(len(n) - k)
            owner.append(i)
        flat += [*n, 0]
    return Suffixes(number, np.array([*flat, *[0] * STEP], np.int32), np.array(starts), np.array(lengths), owner, np.array([*first.values()]), np.array([*map(len, first)]), [sorted(windows[w]) for w in first])


def suffix_array(words: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` sorted by the ``depth`` words that follow each (``words`` is padded by as many zeros). Keys pack as many words
    as 62 bits hold; after each key only suffixes that still have equals are sorted on."""
    bits = max(int(words.max()).bit_length(), 1)
    per = max(1, 62 // bits)
    order, group = starts.copy(), np.zeros(len(starts), np.int64)
    open_ = np.arange(len(starts))
    for first in range(0, depth, per):
        here = order[open_]
        key = np.zeros(len(here), np.int64)
        for k in range(first, min(first + per, depth)):
            key = (key << bits) | words[here + k]
        by = np.lexsort((key, group[open_]))
        here, key, of = here[by], key[by], group[open_][by]
        order[open_] = here
        new = np.ones(len(here), bool)
        new[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1])
        group[open_] = open_[np.flatnonzero(new)][np.cumsum(new) - 1]
        alone = new & np.append(new[1:], True)
        open_ = open_[~alone]
        if not len(open_):
            break
    return order


def compare(words: np.ndarray, places: np.ndarray, bench: Suffixes, suffixes: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sign of (text at ``places``) - (benchmark suffix) over the first ``widths`` words, and how many words agree."""
    sign, agree = np.zeros(len(places), np.int64), widths.astype(np.int64).copy()
    live, cols, first = np.arange(len(places)), np.arange(STEP), 0
    while len(live):
        at, of = places[live] + first, bench.starts[suffixes[live]] + first
        gap = words[np.minimum(at[:, None] + cols, len(words) - 1)] - bench.flat[np.minimum(of[:, None] + cols, len(bench.flat) - 1)]
        gap[cols[None, :] >= (widths[live] - first)[:, None]] = 0
        col = (gap != 0).argmax(axis=1)
        differ = gap[np.arange(len(live)), col]
        hit = differ != 0
        sign[live[hit]], agree[live[hit]] = np.sign(differ[hit]), first + col[hit]
        first += STEP
        live = live[~hit & (widths[live] > first)]
    return sign, agree


def search(words: np.ndarray, array: np.ndarray, bench: Suffixes, suffixes: np.ndarray, widths: np.ndarray, after: bool) -> np.ndarray:
    """For each benchmark suffix the first place in ``array`` that is not below its first ``widths`` words (``after``: that
    is above them). All binary searches step together."""
    low, high = np.zeros(len(suffixes), np.int64), np.full(len(suffixes), len(array), np.int64)
    while len(open_ := np.flatnonzero(low < high)):
        mid = (low[open_] + high[open_]) // 2
        sign, _ = compare(words, array[mid], bench, suffixes[open_], widths[open_])
        up = sign <= 0 if after else sign < 0
        low[open_[up]] = mid[up] + 1
        high[open_[~up]] = mid[~up]
    return low


class Shard:
    """Some texts, their words as numbers, and the suffix array over them, sorted by ``depth`` words."""

    def __init__(self, texts: list[bytes], bench: Suffixes, depth: int) -> None:
        get = bench.number.get
        numbers = [np.fromiter((get(w, 0) for w in words_of(t)), np.int32) for t in texts]
        self.n_words = np.array([len(x) for x in numbers], np.int64)
        self.ends = np.cumsum(self.n_words + 1)  # a 0 parts the texts
        size = int(self.ends[-1]) if len(texts) else 0
        self.words = np.zeros(size + depth + 1, np.int32)
        for x, e in zip(numbers, self.ends, strict=True):
            self.words[e - 1 - len(x) : e - 1] = x
        self.depth = depth
        starts = np.flatnonzero(self.words)
        self.array = suffix_array(self.words, starts, depth) if len(starts) else starts

    def longest(self, bench: Suffixes) -> tuple[np.ndarray, np.ndarray]:
        """Of each benchmark suffix the words of its longest match in this shard (up to ``depth``), and where that is (-1: nowhere)."""
        every = np.arange(len(bench.starts))
        words, at = np.zeros(len(every), np.int64), np.full(len(every), -1, np.int64)
        if len(self.array):
            widths = np.minimum(bench.lengths, self.depth)
            place = search(self.words, self.array, bench, every, widths, False)
            for beside in (np.maximum(place - 1, 0), np.minimum(place, len(self.array) - 1)):
                _, agree = compare(self.words, self.array[beside], bench, every, widths)
                more = agree > words
                words[more], at[more] = agree[more], self.array[beside][more]
        return words, at

    def windows(self, bench: Suffixes) -> tuple[list[list[int]], list[set[int]]]:
        """Of each text the runs of hit words as [start, end, start, end, ...], and the numbers of the windows in it."""
        able = np.flatnonzero(self.longest(bench)[0][bench.window_rows] >= bench.widths)
        rows, widths = bench.window_rows[able], bench.widths[able]
        change = np.zeros(len(self.words) + 1, np.int32)
        found: list[set[int]] = [set() for _ in self.n_words]
        low, high = (search(self.words, self.array, bench, rows, widths, after) for after in (False, True))
        for k, n, a, b in zip(able.tolist(), widths.tolist(), low.tolist(), high.tolist(), strict=True):
            at = self.array[a:b]
            np.add.at(change, at, 1)
            np.add.at(change, at + n, -1)
            for doc in np.unique(np.searchsorted(self.ends, at, "right")).tolist():
                found[doc].add(k)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(change) > 0).astype(np.int8)))))
        begins = self.ends - 1 - self.n_words
        cut = np.searchsorted(edges, [begins, self.ends])
        return [(edges[a:b] - s).tolist() for a, b, s in zip(*cut, begins, strict=True)], found


def _shards(column: pa.Array, bench: Suffixes, depth: int, shard_bytes: int) -> Iterator[tuple[int, Shard]]:
    """(first row, shard) of the texts of a batch."""
    data, offsets = utf8(column)
    for first, last in slices(offsets, shard_bytes):
        yield first, Shard([data[offsets[i] : offsets[i + 1]].tobytes() for i in range(first, last)], bench, depth)


def _blocks(bench: DataFrame, item: str, text: str, block_words: int) -> tuple[int, Iterator[list[tuple[str, str | None]]]]:
    """The number of blocks, and the benchmark in parts of about ``block_words`` words, one at a time."""
    rows = bench.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).where("t is not null")
    total = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0] / 4
    n = int(total // block_words) + 1
    return n, ([(r["i"], r["t"]) for r in (rows if n == 1 else rows.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k)).collect()] for k in range(n))


def _merged(a: list[int], b: list[int]) -> list[int]:
    """Two lists of runs [start, end, ...] as one, without overlaps."""
    out: list[int] = []
    for start, end in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def locate(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 10, shard_bytes: int = 1 << 22, block_words: int = 200_000) -> DataFrame:
    """(key, n_words, hits, items) of every row: its words, the runs of hit words as [start, end, start, end, ...] and
    the sorted ids of the items with windows in it."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["n_words", "hits", "items"]

    def one(rows: DataFrame, block: Suffixes | None, first: bool, last: bool) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_words, hits, ids = [], [], []
                for _, shard in _shards(batch.column(1), block, int(block.widths.max()), shard_bytes) if block else ():
                    runs, found = shard.windows(block)
                    n_words += shard.n_words.tolist()
                    hits += runs
                    ids += [sorted({i for w in ws for i in block.items[w]}) for ws in found]
                if not block:
                    n_words = [len(words_of(t.encode())) if t else 0 for t in batch.column(1).to_pylist()]
                    hits, ids = [[] for _ in n_words], [[] for _ in n_words]
                if not first:
                    hits = [_merged(a, b) if a and b else a or b for a, b in zip(batch.column(3).to_pylist(), hits, strict=True)]
                    ids = [sorted({*a, *b}) for a, b in zip(batch.column(4).to_pylist(), ids, strict=True)]
                kept = batch.columns[:1] if last else batch.columns[:2]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.string()))], [*batch.schema.names[: len(kept)], *names])

        return rows.mapInArrow(tidy(work), f"`{key}` {kind}, {'' if last else '__text string, '}n_words long, hits array<long>, items array<string>")

    n, blocks = _blocks(bench, item, item_text, block_words)
    rows = docs.select(key, F.col(text).alias("__text"))
    for k, items in enumerate(blocks):
        old, rows = rows, one(rows, benchmark_suffixes(items, width), k == 0, k == n - 1)
        if n > 1:
            rows = stored(rows, "located")
            if k:
                discard(old)
    return rows


def longest_matches(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", shard_bytes: int = 1 << 22, block_words: int = 200_000) -> DataFrame:
    """(item, item_start, n_words, key, start): for each benchmark item the longest word sequence that a document repeats,
    and one place of it."""
    kind = docs.schema[key].dataType.simpleString()

    def one(block: Suffixes | None) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches if block else ():
                for first, shard in _shards(batch.column(1), block, block.depth, shard_bytes):
                    words, at = shard.longest(block)
                    best: dict[str, int] = {}
                    for k in np.flatnonzero(words).tolist():
                        if words[k] > words[best.get(block.owner[k], k)] or block.owner[k] not in best:
                            best[block.owner[k]] = k
                    ks = np.array([*best.values()], np.int64)
                    doc = np.searchsorted(shard.ends, at[ks], "right")
                    origin = {o: s for o, s in zip(reversed(block.owner), reversed(block.starts.tolist()), strict=True)}
                    yield pa.RecordBatch.from_arrays([pa.array([*best], pa.string()), pa.array([int(block.starts[k]) - origin[block.owner[k]] for k in ks], pa.int64()), pa.array(words[ks]), batch.column(0).take(pa.array(first + doc)), pa.array(at[ks] - (shard.ends - 1 - shard.n_words)[doc])], [item, "item_start", "n_words", key, "start"])

        found = docs.select(key, text).mapInArrow(tidy(work), f"`{item}` string, item_start long, n_words long, `{key}` {kind}, start long")
        return found.groupBy(item).agg(F.min(F.struct((-F.col("n_words")).alias("n"), F.col(key).alias("k"), "start", "item_start")).alias("b"))

    n, blocks = _blocks(bench, item, item_text, block_words)
    found = [one(benchmark_suffixes(items)) if n == 1 else stored(one(benchmark_suffixes(items)), "matches") for items in blocks]
    best = reduce(DataFrame.union, found).groupBy(item).agg(F.min("b").alias("b"))
    return best.select(item, F.col("b.item_start").alias("item_start"), (-F.col("b.n")).alias("n_words"), F.col("b.k").alias(key), F.col("b.start").alias("start"))


def decontaminate(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 10, shard_bytes: int = 1 << 22, block_words: int = 200_000) -> DataFrame:
    """The rows without any hit, in their own columns. Each row is kept or dropped where its text is searched, so neither its id nor a join has a part in it."""

    def one(rows: DataFrame, block: Suffixes) -> DataFrame:
        depth = int(block.widths.max())
        return rows_where(rows, text, lambda column: [not found for _, shard in _shards(column, block, depth, shard_bytes) for found in shard.windows(block)[1]])

    n, blocks = _blocks(bench, item, item_text, block_words)
    rows = docs
    for k, items in enumerate(blocks):
        if block := benchmark_suffixes(items, width):
            old, rows = rows, one(rows, block)
            if n > 1:
                rows = stored(rows, "clean")
                if old is not docs:
                    discard(old)
    return rows


def op1_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = locate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size("hits") - 1), F.lit(0).cast("long"), lambda a, i: a + F.when(i % 2 == 0, -F.get("hits", i)).otherwise(F.get("hits", i)))
    found = found.withColumn("n_hit", F.when(F.size("hits") > 0, n_hit).otherwise(F.lit(0).cast("long")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
