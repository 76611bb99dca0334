"""Quality rules by compression: bands of Zstandard ratios for whole texts and for fixed chunks, by length.

Repetitive text packs far below what prose of its length does, random or packed data far above; short texts pack badly whatever they hold, so each length has limits of its own. A text is kept
if it passes the base rules, its own ratio lies in the band of its length, and chunks outside their bands make up no more than a given share of its bytes. Every text is judged whole in
its own task, nothing is shuffled. Null and empty texts have no words and fail the base rules. Rows are judged one by one: repeated or null ids and extra columns change nothing.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from facewave.llm._text import NOT_SPACE, PLACES, SLICE, U, mix, slices, tidy, utf8, word_hashes, word_spans

#: (bytes from which it holds, least ratio, greatest ratio) at level 3. Prose lies at 0.9 to 0.6 of its size at 128 to 512 bytes, at 0.5 at 2 KB and near 0.4 from 16 KB on;
#: the same line over and over below 0.2, base 64 at 0.76 and more.
BANDS = ((0, 0.0, float("inf")), (64, 0.35, 1.35), (128, 0.30, 1.10), (256, 0.28, 0.95), (512, 0.26, 0.85), (1024, 0.24, 0.75), (4096, 0.21, 0.70), (16384, 0.18, 0.67), (65536, 0.15, 0.65))

SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunks_outside double"


@dataclass(frozen=True)
class Rules:
    """``bands`` by length; ``chunk`` bytes to a chunk; ``most`` is the greatest share of bytes in chunks outside their bands."""

    bands: Sequence[tuple[int, float, float]] = BANDS
    chunk: int = 4096
    most: float = 0.3
    level: int = 3
    least_words: int = 20
    repeats: int = 30  # greatest per cent of words in repeated windows
    window: int = 8

    def outside(self, raw: int, packed: int) -> bool:
        """Whether a text of ``raw`` bytes that packs to ``packed`` is outside its band."""
        _, low, high = self.bands[bisect.bisect_right(self.bands, raw, key=lambda b: b[0]) - 1]
        return not low * raw <= packed <= high * raw if raw else False

    def ratios(self, text, packer: zstandard.ZstdCompressor) -> tuple[float | None, float, bool]:
        """Ratio of a whole text (None if empty), share of its bytes in chunks outside their bands, and whether the bands reject it."""
        if not len(text):
            return None, 0.0, False
        packed = len(packer.compress(text))
        whole = self.outside(len(text), packed)
        if len(text) <= self.chunk:
            return packed / len(text), float(whole), whole
        bad = 0
        for a in range(0, len(text), self.chunk):
            piece = text[a : a + self.chunk]
            bad += len(piece) if self.outside(len(piece), len(packer.compress(piece))) else 0
        share = bad / len(text)
        return packed / len(text), share, whole or share > self.most


def _again(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place whether its hash occurs again in its row, and whether it did so before."""
    order = np.lexsort((np.arange(len(hashes)), hashes, row))
    same = (np.diff(hashes[order]) == 0) & (np.diff(row[order]) == 0)
    before, twice = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    before[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, before


def judged(texts: pa.Array | pa.ChunkedArray, rules: Rules = Rules()) -> Iterator[tuple]:
    """A row of ``RESULT`` for each text. Windows and lines are compared by 64-bit hashes within a text."""
    data, offsets = utf8(texts)
    packer = zstandard.ZstdCompressor(level=rules.level)
    for first, last in slices(offsets, SLICE):
        n = last - first
        rows = offsets[first : last + 1] - offsets[first]
        part = data[offsets[first] : offsets[last]]
        starts, ends, bounds = word_spans(part, rows, NOT_SPACE)
        words = np.diff(bounds)
        total = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[rows])
        chars = total(NOT_SPACE[part] & ((part & 0xC0) != 0x80))
        symbols = total(SYMBOLS[part])
        # windows of words found twice
        h, size = word_hashes(part, starts, ends), rules.window
        row = np.repeat(np.arange(n), words)
        m = max(len(h) - size + 1, 0)
        window = np.zeros(m, U)
        for k in range(size):
            window += h[k : k + m] * PLACES[k]
        at = np.flatnonzero(row[:m] == row[size - 1 :][:m]) if m else np.empty(0, np.int64)
        twice, _ = _again(row[at], mix(window[at]))
        edges = np.bincount(at[twice], minlength=len(h) + 1) - np.bincount(at[twice] + size, minlength=len(h) + 1)
        repeated = np.bincount(row, weights=np.cumsum(edges)[: len(h)] > 0, minlength=n).astype(np.int64)
        # lines that came before
        lines, stops, places = word_spans(part, rows, np.arange(256) != 10)
        full = np.searchsorted(starts, stops) > np.searchsorted(starts, lines)
        line_row = np.repeat(np.arange(n), np.diff(places))[full]
        _, before = _again(line_row, word_hashes(part, lines, stops)[full])
        dup = np.bincount(line_row[before], minlength=n)
        for r in range(n):
            ratio, share, rejected = rules.ratios(part[rows[r] : rows[r + 1]], packer)
            failed = bool(words[r] < rules.least_words or 100 * repeated[r] > rules.repeats * words[r])
            yield int(words[r]), int(chars[r]), int(symbols[r]), int(dup[r]), int(repeated[r]), failed, not failed and not rejected, ratio, share


def compression_bands(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: Rules = Rules()) -> DataFrame:
    """(key, columns of ``RESULT``) of every row."""
    from pyspark.sql.types import StructType

    rows = docs.select(docs[f"`{key}`"].alias("doc_id"), docs[f"`{text}`"].alias("text"))
    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL(RESULT).fields])
    names = schema.names
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(zip(*judged(batch.column("text"), rules), strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(got, kinds, strict=True))], names=names)

    return rows.mapInArrow(work, schema)


def op13_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(spark.read.parquet(f"{sf_dir}/documents.parquet"))
