"""Periodic runs of words: Lyndon roots from the grouping phase of Baier's suffix sorter, under an order of the words and its reverse.

That phase sorts suffixes into groups by their longest Lyndon prefix, whose length is the Lyndon array. Every run is periodic with a root that is the longest Lyndon word at its place
under one of the two orders, so repeated roots are equal groups one period apart; their common extension gives the run. Each document is judged in its own task, whole; nothing is shuffled.

Null and empty texts have no words and no run. Rows are judged one by one: repeated ids, null ids and extra columns change nothing (the result has the columns named below only). Words are
numbered exactly (no hashes). Equal exponents: the smallest start, then the smallest period, is the greatest run.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from facewave.llm._text import NOT_SPACE, SLICE, slices, tidy, utf8, word_spans

Run = tuple[int, int, int]  # start, length, period

RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long"


def lyndon_groups(ranks: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(length of the longest Lyndon word at each place, number of its group): equal numbers mean equal words.

    Groups are taken from the highest down. Each member finds the nearest place to its left that is in a lower group; a place that was found c times has c copies of the group's word
    behind its own, so it moves to a new group right above its old one, above those that were found less often."""
    n = len(ranks)
    place = {r: g for g, r in enumerate(sorted(set(ranks)))}
    group = [-1] + [place[r] for r in ranks]  # place 0 stands for "none" and is never taken
    members: list[list[int]] = [[] for _ in place]
    for i in range(1, n + 1):
        members[group[i]].append(i)
    size = [1] * len(place)
    below, above = list(range(-1, len(place) - 1)), [*range(1, len(place)), -1]
    left = list(range(n + 1))  # the way to the nearest place on the left that is not taken yet
    now = len(place) - 1
    while now >= 0:
        own = [i for i in members[now] if group[i] == now]
        for i in own:
            left[i] = i - 1
        found: dict[int, int] = {}
        for i in own:
            at = left[i]
            while left[at] != at:
                left[at] = at = left[left[at]]
            left[i] = at
            if at:
                found[at] = found.get(at, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for i, c in found.items():
            moved.setdefault((c, group[i]), []).append(i)
        for c, old in sorted(moved, reverse=True) if len(moved) > 1 else moved:
            new, over = len(size), above[old]
            size.append(size[old] + c * size[now])
            members.append(moved[c, old])
            below.append(old)
            above.append(over)
            above[old] = below[over] = new  # ``over`` is never -1: the group in hand stands above
            for i in moved[c, old]:
                group[i] = new
        now = below[now]
    groups = np.array(group[1:], np.int64)
    return (np.array(size, np.int64)[groups] if n else groups), groups


def runs(words: Sequence[int], exponent: int = 4, least: int = 6) -> list[Run]:
    """All runs (start, length, period) of a sequence with length >= max(least, exponent * period), by start and period."""
    n, found = len(words), set()
    for ranks in (words, [-w for w in words]):
        lyndon, group = lyndon_groups(ranks)
        places = np.arange(n)
        chained = places + (exponent - 2) * lyndon < n  # a run of this exponent holds its root exponent - 1 times at least
        for k in range(1, exponent - 1):
            ahead = np.minimum(places + k * lyndon, n - 1)
            chained &= group[ahead] == group
        back = places - lyndon
        chained &= (back < 0) | (group[np.maximum(back, 0)] != group)
        for i in np.flatnonzero(chained).tolist():
            p, g = int(lyndon[i]), group[i]
            end = i + p
            while end < n and group[end] == g:  # roots one period apart: whole periods of the common extension
                end += p
            while end < n and words[end] == words[end - p]:
                end += 1
            start = i
            while start and words[start - 1] == words[start - 1 + p]:
                start -= 1
            if end - start >= max(least, exponent * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[NOT_SPACE[data]]))])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _stretches(numbers: np.ndarray, row: np.ndarray, often: int, least: int) -> Iterator[np.ndarray]:
    """Stretches of places that can hold runs: a word in a run occurs in it as often as the run's exponent says, so words that are rarer between two cuts are cuts themselves."""
    at, part, span = np.arange(len(numbers)), row.astype(np.int64), int(numbers.max(initial=0)) + 1
    while len(at):
        _, which, count = np.unique(part * span + numbers[at], return_inverse=True, return_counts=True)
        keep = count[which] >= often
        before = len(at)
        at, part = at[keep], part[keep]
        part = np.cumsum(np.concatenate(([0], (np.diff(at) != 1) | (np.diff(part) != 0)))) if len(at) else part
        keep = np.bincount(part)[part] >= least if len(at) else keep[:0]
        at, part = at[keep], part[keep]
        if len(at) > 0.9 * before:
            break
    if len(at):
        yield from np.split(at, np.flatnonzero(np.diff(part)) + 1)


def replanted(n: int, doc_id) -> tuple[int, int]:
    """Where the periodic tail of a document of n words begins, and its period; (n, 0) if it has none."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return n, 0
    a = (h // 10) % n
    return a, 1 + (n - a) // (3 + (h // 10) % 8)


def digests(ids: Sequence, texts: pa.Array | pa.ChunkedArray, tails: bool = True, exponent: int = 4, least: int = 6) -> Iterator[tuple]:
    """A row of ``RESULT`` for each text; ``tails`` rebuilds some by their id first (see ``replanted``)."""
    data, offsets = utf8(texts)
    for first, last in slices(offsets, SLICE):
        rows = offsets[first : last + 1] - offsets[first]
        part = data[offsets[first] : offsets[last]]
        starts, ends, bounds = word_spans(part, rows, NOT_SPACE)
        numbers, source, changed = _numbers(part, starts, ends), np.arange(len(starts)), set()
        for r in range(last - first if tails else 0):
            a, b = int(bounds[r]), int(bounds[r + 1])
            tail, period = replanted(b - a, ids[first + r])
            if period:
                changed.add(r)
                source[a + tail : b] = a + tail + np.arange(b - a - tail) % period
        numbers = numbers[source]
        row = np.repeat(np.arange(last - first), np.diff(bounds))
        found: dict[int, list[Run]] = {}
        for at in _stretches(numbers, row, exponent, least):
            r = int(row[at[0]])
            here = runs(numbers[at].tolist(), exponent, least)
            found.setdefault(r, []).extend((s + int(at[0] - bounds[r]), n, p) for s, n, p in here)
        # texts that stay as they are: their words and one blank after each but the last
        keep, plain = NOT_SPACE[part], part.copy()
        gap = ends[:-1][row[:-1] == row[1:]] if len(ends) else ends
        plain[gap], keep[gap] = 32, True
        plain, cuts = plain[keep], np.concatenate(([0], np.cumsum(keep)))[rows]
        for r in range(last - first):
            a, b = int(bounds[r]), int(bounds[r + 1])
            own = sorted(found.get(r, ()), key=lambda x: (x[0], x[2]))
            if own or r in changed:
                stays = np.ones(b - a, bool)
                for s, n, p in own:
                    stays[s + p : s + n] = False
                kept = source[a:b][stays]
                text = b" ".join(part[s:e].tobytes() for s, e in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True))
            else:
                text = plain[cuts[r] : cuts[r + 1]]
            best = (None, None, None)
            for s, n, p in own:  # in order of start and period, so the first of equals stays
                if best[0] is None or n * best[2] > best[1] * p:
                    best = (s, n, p)
            listed = "".join(f"{s},{n},{p}\n" for s, n, p in own)
            milli = None if best[0] is None else 1000 * best[1] // best[2]
            yield (len(own), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), b - a)


def document_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", tails: bool = False, exponent: int = 4, least: int = 6) -> DataFrame:
    """(key, columns of ``RESULT``) of every row: number of runs, the one with the greatest exponent, and digests of all runs and of the text without the words that a run repeats."""
    from pyspark.sql.types import StructType

    rows = docs.select(docs[f"`{key}`"].alias("doc_id"), docs[f"`{text}`"].alias("text"))
    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL(RESULT).fields])
    names = schema.names

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            got = list(zip(*digests(ids.to_pylist(), batch.column("text"), tails, exponent, least), strict=True)) or [[]] * (len(names) - 1)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(got, kinds, strict=True))], names=names)

    return rows.mapInArrow(work, schema)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), tails=True)
