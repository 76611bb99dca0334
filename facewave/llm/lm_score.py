"""Language-model scoring by cross-entropy difference (operator 3).

Two bigram models, one of a target corpus and one of all documents, share one vocabulary (words hashed to ``VOCABULARY`` places), one
smoothing and one mass: background counts are scaled to the target's number of words. The score of a document is its loss per word under the
background less that under the target: the higher, the more it reads like the target.

With additive smoothing, log p(b | a) = log(count(a b) + alpha) - log(count(a) + alpha V), so a document's losses are sums of one
term per bigram and one per context. Context counts are a table of the vocabulary's size and go to every task. Bigrams are dealt to tasks by
hash, in parts of about ``part_bytes`` of text (more parts would mean more partial sums for a document), each with its row's number and length; a task counts its bigrams over all rows and in each row, works out their terms and returns one partial sum for
each document, packed by destination. Bigrams that make up ``hot`` of any slice of the text, which would all meet in one task, are counted apart
(there are 1 / hot of them in a slice at most) and scored where the documents are. Counts cover all documents.

Defined results: words are runs other than white space, A-Z in lower case; the first word follows a start mark; null text
and text without words have no words, no losses and score 0; ids are whole numbers, and rows with a null id or one that is no number are left out; rows that share an id are one document,
whose losses are summed over its rows, each scored without itself alone; where no other target row has words both models are even and the score is 0; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facewave.llm._shared import parts_by_bytes, stored
from facewave.llm._text import LOWER, NOT_SPACE, SLICE, U, mix, slices, tidy, utf8, word_hashes, word_spans
from facewave.llm.langid import held_out

BITS = 18
VOCABULARY = 1 << BITS
#: The mark before a first word: one more context.
START = VOCABULARY


def bigrams(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end, contexts, words, row of each) of slices of rows."""
    data, offsets = utf8(column)
    for first, last in slices(offsets, limit):
        rows = offsets[first : last + 1] - offsets[first]
        part = LOWER[data[offsets[first] : offsets[last]]]
        starts, ends, bounds = word_spans(part, rows, NOT_SPACE)
        word = (word_hashes(part, starts, ends) >> U(64 - BITS)).astype(np.int64)
        before = np.concatenate([[START], word[:-1]]) if len(word) else word
        row = np.repeat(np.arange(last - first), np.diff(bounds))
        if len(word):
            before[bounds[:-1][np.diff(bounds) > 0]] = START
        yield first, last, before, word, row


def _key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix((before.astype(U) << U(BITS)) | word.astype(U))


def _counted(rows: DataFrame, hot: float) -> tuple[np.ndarray, np.ndarray]:
    """Context counts [2, VOCABULARY + 1] (all rows, target rows), and the keys of hot bigrams."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, VOCABULARY + 1), np.int64)
        found: set[int] = set()
        for batch in batches:
            target = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
            for first, _, before, word, row in bigrams(batch.column(1)):
                total[0] += np.bincount(before, minlength=VOCABULARY + 1)
                total[1] += np.bincount(before[target[first + row]], minlength=VOCABULARY + 1)
                keys, n = np.unique(_key(before, word), return_counts=True)
                found.update(keys[n >= max(hot * len(word), 32)].view(np.int64).tolist())
        at = np.flatnonzero(total[0])
        for kind, a, b, c in ((0, at, total[0][at], total[1][at]), (1, np.array(sorted(found), np.int64), np.zeros(len(found), np.int64), np.zeros(len(found), np.int64))):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(c)], ["kind", "key", "n", "t"])

    got = rows.mapInArrow(tidy(work), "kind int, key long, n long, t long").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toArrow()
    kind, key = got["kind"].to_numpy(), got["key"].to_numpy()
    context = np.zeros((2, VOCABULARY + 1))
    for i, name in enumerate(("n", "t")):
        context[i][key[kind == 0]] = got[name].to_numpy()[kind == 0]
    return context, np.sort(key[kind == 1].view(U))


def _hot_counts(rows: DataFrame, keys: np.ndarray) -> np.ndarray:
    """Counts [2, len(keys)] of the hot bigrams (all rows, target rows)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(keys)), np.int64)
        for batch in batches:
            target = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
            for first, _, before, word, row in bigrams(batch.column(1)):
                at, hit = _find(keys, _key(before, word))
                total[0] += np.bincount(at[hit], minlength=len(keys))
                total[1] += np.bincount(at[hit & target[first + row]], minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(keys))), pa.array(total[0]), pa.array(total[1])], ["i", "n", "t"])

    out = np.zeros((2, len(keys)))
    for r in rows.mapInArrow(tidy(work), "i long, n long, t long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect():
        out[:, r["i"]] = r["n"], r["t"]
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _times(row: np.ndarray, code: np.ndarray, codes: int) -> np.ndarray:
    """How often each entry's code occurs in its row."""
    _, place, n = np.unique(row * codes + code, return_inverse=True, return_counts=True)
    return n[place]


def _whole_keys(pairs: np.ndarray, size: int = 1 << 18) -> Iterator[np.ndarray]:
    """Sorted pairs in pieces of about ``size``, all pairs of a key in one."""
    a = 0
    while a < len(pairs):
        b = min(a + size, len(pairs))
        if b < len(pairs):
            b = int(np.searchsorted(pairs, pairs[b - 1] | U(0xFFFFFFFF), "right"))
        yield pairs[a:b]
        a = b


def _packed(parts: int, ids: np.ndarray, sums: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    """(destination, ids, sums [3 or 2, n]) by destination of the document: words and both losses, or the losses alone."""
    to = (mix(ids.view(U)) % U(parts)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    return [(int(to[at[0]]), ids[at].tobytes(), np.ascontiguousarray(sums[:, at]).tobytes()) for at in np.split(order, cuts) if len(at)]


def losses(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", alpha: float = 0.01, hot: float = 0.001, broadcast_rows: int = 2_000_000, flush: int = 1 << 20, part_bytes: int = 32 << 20) -> DataFrame:
    """(key, n_tokens, target_loss, background_loss, score) of every document; ``target`` has the keys of the target corpus, which is part of ``docs``."""
    spark = docs.sparkSession
    parts = max(16, parts_by_bytes(docs, text, part_bytes))
    marks = stored(target.select(F.col(key).try_cast("long").alias("__id")).where("__id is not null").distinct(), "target")
    marks = F.broadcast(marks) if marks.count() <= broadcast_rows else marks
    rows = docs.select(F.col(key).try_cast("long").alias("__id"), F.col(text).alias("text")).where("__id is not null").join(marks.withColumn("__t", F.lit(True)), "__id", "left").select("__id", "text", F.coalesce("__t", F.lit(False)).alias("target"))
    context, keys = _counted(rows, hot)
    counts = _hot_counts(rows, keys) if len(keys) else np.zeros((2, 0))
    total, mass = int(context[0].sum()), int(context[1].sum())
    shared = spark.sparkContext.broadcast((keys, counts, context))

    def scale(length: np.ndarray, target: np.ndarray) -> np.ndarray:
        """What makes the background's mass the target's, both without a row of this length."""
        return (mass - length * target) / np.maximum(total - length, 1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, context = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        ids: list[np.ndarray] = []
        flags: list[np.ndarray] = []
        local: list[np.ndarray] = []
        size = docs_held = 0

        def out() -> pa.RecordBatch:
            doc, flag = np.concatenate(ids), np.concatenate(flags)
            k = np.concatenate([x for x, _ in held])
            of = np.concatenate([x for _, x in held])
            rows = [(1, p, b"", b"", i, s) for p, i, s in _packed(parts, doc, np.concatenate(local, axis=1))]
            part = (((k >> U(32)) * U(parts)) >> U(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                if len(at):
                    inside, place = np.unique(of[at], return_inverse=True)
                    rows.append((0, int(part[at[0]]), (k[at] & U(0xFFFFFFFF)).astype(np.uint32).tobytes(), place.astype(np.uint32 if len(inside) > 65535 else np.uint16).tobytes(), doc[inside].tobytes(), flag[inside].tobytes()))
            types = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["kind", "part", "keys", "docs", "ids", "extra"])

        for batch in batches:
            number = batch.column(0).to_numpy()
            target = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
            for first, last, before, word, row in bigrams(batch.column(1)):
                k = _key(before, word)
                at, hit = _find(keys, k)
                n = last - first
                length, in_target = np.bincount(row, minlength=n), target[first:last]
                own, even = _times(row, before, VOCABULARY + 1), scale(length, in_target)[row]
                below = [np.log(context[1][before] - own * in_target[row] + alpha * VOCABULARY), np.log((context[0][before] - own) * even + alpha * VOCABULARY)]
                known = [np.zeros(0)] * 2
                if hit.any():
                    own, place = _times(row[hit], at[hit], len(keys)), at[hit]
                    known = [np.log(counts[1][place] - own * in_target[row[hit]] + alpha), np.log((counts[0][place] - own) * even[hit] + alpha)]
                losses_of = [np.bincount(row[hit], weights=a, minlength=n) - np.bincount(row, weights=b, minlength=n) for a, b in zip(known, below, strict=True)]
                local.append(np.array([length, *losses_of]))
                ids.append(number[first:last])
                flags.append(np.where(in_target, -length, length).astype(np.int32))
                held.append((k[~hit], row[~hit] + docs_held))
                docs_held += n
                size += len(word)
                if size >= flush or docs_held >= flush // 8:
                    yield out()
                    held, ids, flags, local, size, docs_held = [], [], [], [], 0, 0
        if ids:
            yield out()

    def meet(table: pa.Table) -> pa.Table:
        if table["kind"][0].as_py() == 1:
            return table.select(["part", "ids", "extra"])
        ids, lengths = [], []
        pairs = np.empty(pc.sum(pc.binary_length(table["keys"])).as_py() // 4, U)  # a bigram's hash, then the row it is in
        base = end = 0
        for k, d, i, f in zip(*(table[c] for c in ("keys", "docs", "ids", "extra")), strict=True):
            i, k, d = np.frombuffer(i.as_buffer(), np.int64), np.frombuffer(k.as_buffer(), np.uint32), d.as_buffer()
            part = pairs[end : end + len(k)]
            part[:] = k
            part <<= U(32)
            part |= np.frombuffer(d, np.uint16 if d.size == 2 * len(k) else np.uint32).astype(U) + U(base)
            ids.append(i)
            lengths.append(np.frombuffer(f.as_buffer(), np.int32))
            base, end = base + len(i), end + len(k)
        ids, lengths = np.concatenate(ids), np.concatenate(lengths)
        pairs.sort()
        in_target, even = lengths < 0, scale(np.abs(lengths).astype(np.int64), lengths < 0)
        sums = np.zeros((2, len(ids)))
        for p in _whole_keys(pairs):
            starts = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
            own = np.diff(np.append(starts, len(p)))
            of, key = (p[starts] & U(0xFFFFFFFF)).astype(np.int64), p[starts] >> U(32)
            begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(begins, len(key)))
            left_n, left_t = (np.repeat(np.add.reduceat(x, begins), size) - x for x in (own, own * in_target[of]))
            for j, x in enumerate((left_t, left_n * even[of])):
                sums[j] += np.bincount(of, weights=own * np.log(x + alpha), minlength=len(ids))
        ids, place = np.unique(ids, return_inverse=True)
        sums = np.array([np.bincount(place, weights=s, minlength=len(ids)) for s in sums])
        rows = _packed(parts, ids, sums)
        return pa.table([pa.array([p for p, _, _ in rows], pa.int32()), pa.array([i for _, i, _ in rows], pa.binary()), pa.array([s for _, _, s in rows], pa.binary())], ["part", "ids", "extra"])

    def finish(table: pa.Table) -> pa.Table:
        ids = np.concatenate([np.frombuffer(i, np.int64) for i in table["ids"].to_pylist()])
        size = [len(i) // 8 for i in table["ids"].to_pylist()]
        sums = np.zeros((3, len(ids)))
        for n, end, s in zip(size, np.cumsum(size), table["extra"].to_pylist(), strict=True):
            part = np.frombuffer(s, np.float64).reshape(-1, n)
            sums[3 - len(part) :, end - n : end] = part
        ids, place = np.unique(ids, return_inverse=True)
        n, t, b = (np.bincount(place, weights=s, minlength=len(ids)) for s in sums)
        with np.errstate(invalid="ignore", divide="ignore"):
            t, b = -t / n, -b / n
        none = n == 0
        return pa.table([pa.array(ids), pa.array(n.astype(np.int64)), pa.array(t, mask=none), pa.array(b, mask=none), pa.array(np.where(none, 0.0, b - t))], ["id", "n_tokens", "target_loss", "background_loss", "score"])

    dealt = rows.mapInArrow(tidy(spread), "kind int, part int, keys binary, docs binary, ids binary, extra binary")
    partial = dealt.groupBy("kind", "part").applyInArrow(meet, "part int, ids binary, extra binary")
    out = partial.groupBy("part").applyInArrow(finish, "id long, n_tokens long, target_loss double, background_loss double, score double")
    return out.withColumnRenamed("id", key)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as of good quality, outside the held-out part."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    target = spark.read.parquet(f"{sf_dir}/labels.parquet").where((F.col("quality") == 1) & ~held_out())
    out = losses(docs, target)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "target_loss", "background_loss", "score")
