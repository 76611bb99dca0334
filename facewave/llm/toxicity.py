"""Toxicity by a weighted finite-state pattern grammar (operator 4).

Each clause of a text is a sequence of word classes: insult, threat, target, negation, reporting verb, other. Four small
weighted transducers read it side by side - one lets a target raise what follows (a threat far more than an insult), one lets
a negation lower the next words, one lowers what stands after a reporting verb, one raises an insult after an insult - and are composed into a single table of
states. A clause scores the weights of its matched patterns; a document is scored from its clauses by a fitted logistic curve,
so a lone word counts by the pattern it stands in.

Targets and negations are closed classes and given; the others are learned from labelled rows. Insults (words, and beginnings of 4 to 6 bytes) are those
whose log-odds in toxic rows reach ``odds``. Threats are words that reach it only where their clause has a target, so that "kill" alone says little.
Reporting words are those after which a match speaks for a clean row. A few threats and reporting verbs are given besides. The curve is
learned last. Bound: about ``per_class`` rows of each class, chosen by a hash of the key; rows of one class whose smallest shingle hash
agrees (copies) count once, so that a group of copies teaches no words. Every text is scored whole.

Words are runs of letters and digits; the apostrophe of an English ending goes ("aren't" is read as "arent").

Defined results: null and empty texts score like a text without any match; a null key teaches nothing, and each row is scored by its own text; without labelled
rows of both classes the score is the share of toxic rows (0 if none) for every text; equal texts get equal scores; other columns are not touched.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from facewave.llm._shared import by_place, named, rows_where, stored
from facewave.llm._text import LOWER, SLICE, shingle_sets, slices, tidy, utf8, word_hashes, word_spans
from facewave.llm.langid import held_out

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: How much a target raises a threat; a given threat has the first weight.
AIMED, GIVEN = 10.0, 0.1
BEGINNINGS = (4, 5, 6)

# Given word classes, in English, German, French and Spanish.
THREATS = "kill killing hurt destroy murder shoot beat burn crush töten umbringen vernichten schlagen tuer tuerai frapper détruire brûler matar matarte golpear destruir quemar"
TARGETS = "you your yours youre u ur they them those these people he she him her du dich dir dein deine ihr euch sie tu toi te vous votre ils eux tú ti usted ustedes vosotros ellos"
NEGATIONS = "not no never isnt arent wasnt werent dont doesnt didnt wont cant couldnt shouldnt wouldnt nicht kein keine nie niemals ne pas jamais aucun nunca jamás tampoco"
REPORTS = "said says say saying wrote writes claimed claims reported quoted quote called sagte sagt schrieb behauptet zitiert dit disait écrit affirme cité dijo dice escribió afirma citó"

IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
ENDINGS = (b"t", b"s", b"d", b"m", b"re", b"ve", b"ll")
IS_BREAK = np.zeros(256, bool)
IS_BREAK[[ord(c) for c in ".!?;:\n"]] = True

#: A transducer: start state and {(state, class): (next state, factor)}; what it lacks keeps the state with factor 1.
Transducer = tuple[int, dict[tuple[int, int], tuple[int, float]]]


def transducers() -> dict[str, Transducer]:
    # a negation lowers the matches in the three words after it
    negate = {(s, NEGATION): (3, 1.0) for s in range(4)}
    negate |= {(s, c): (s - 1, 0.3 if c in (INSULT, THREAT) else 1.0) for s in (1, 2, 3) for c in (OTHER, INSULT, THREAT, TARGET, REPORT)}
    return {
        "aim": (0, {(0, TARGET): (1, 1.0), (1, INSULT): (1, 1.5), (1, THREAT): (1, AIMED)}),
        "negate": (0, negate),
        "report": (0, {(0, REPORT): (1, 1.0), (1, INSULT): (1, 0.4), (1, THREAT): (1, 0.4)}),
        # an insult after an insult of the same clause weighs more
        "stack": (0, {(0, INSULT): (1, 1.0), (1, INSULT): (1, 1.25)}),
    }


def compose(parts: list[Transducer]) -> tuple[int, np.ndarray, np.ndarray]:
    """The product of transducers: start, next state [state, class] and factor [state, class]."""
    sizes = [1 + max(x for (s, _), (n, _) in arcs.items() for x in (s, n)) for _, arcs in parts]
    states = list(itertools.product(*map(range, sizes)))
    number = {s: i for i, s in enumerate(states)}
    after, factor = np.zeros((len(states), 6), int), np.ones((len(states), 6))
    for s in states:
        for c in range(6):
            arcs = [arc.get((x, c), (x, 1.0)) for x, (_, arc) in zip(s, parts, strict=True)]
            after[number[s], c] = number[tuple(n for n, _ in arcs)]
            factor[number[s], c] = np.prod([w for _, w in arcs])
    return number[tuple(s for s, _ in parts)], after, factor


@dataclass
class Lexicon:
    """Word and beginning hashes with class and weight, sorted by hash."""

    keys: np.ndarray
    classes: np.ndarray
    weights: np.ndarray
    heard: np.ndarray = field(init=False)  # by the low 16 bits: whether any key has them

    def __post_init__(self) -> None:
        self.heard = np.zeros(1 << 16, bool)
        self.heard[(self.keys & np.uint64(0xFFFF)).astype(int)] = True

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        classes, weights = np.zeros(len(hashes), np.int8), np.zeros(len(hashes))
        maybe = np.flatnonzero(self.heard[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), max(len(self.keys) - 1, 0))
        if len(self.keys):
            hit = self.keys[at] == hashes[maybe]
            classes[maybe[hit]], weights[maybe[hit]] = self.classes[at[hit]], self.weights[at[hit]]
        return classes, weights


def hash_of(word: bytes) -> np.uint64:
    """The hash of one word (lower case)."""
    return word_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0]


def beginning(word: bytes) -> np.uint64:
    return ~hash_of(word)


def lexicon(words: dict[bytes, float], starts: dict[bytes, float], threats: dict[bytes, float] | None = None, reports: Iterable[bytes] = ()) -> Lexicon:
    """Learned words and beginnings; the given classes hold for words that are not among them."""
    found = {hash_of(w.encode()): (c, x) for c, ws, x in ((REPORT, REPORTS, 1.0), (THREAT, THREATS, GIVEN)) for w in ws.split()}
    found |= {hash_of(w): (REPORT, 1.0) for w in reports} | {hash_of(w): (THREAT, x) for w, x in (threats or {}).items()}
    found |= {hash_of(w.encode()): (c, 1.0) for c, ws in ((NEGATION, NEGATIONS), (TARGET, TARGETS)) for w in ws.split()}
    found |= {beginning(w): (INSULT, x) for w, x in starts.items()} | {hash_of(w): (INSULT, x) for w, x in words.items()}
    keys = np.array(sorted(found), np.uint64)
    return Lexicon(keys, np.array([found[k][0] for k in keys], np.int8), np.array([found[k][1] for k in keys]))


def joined(part: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes and their row offsets without the apostrophes (' and U+2019) of English endings."""
    text = part.tobytes()
    word = np.concatenate((IS_WORD[part], np.zeros(4, bool)))
    gone = np.zeros(len(part), bool)
    for mark in (b"'", b"\xe2\x80\x99"):
        at, n = text.find(mark), len(mark)
        while at >= 0:
            if at and word[at - 1] and any(text.startswith(e, at + n) and not word[at + n + len(e)] for e in ENDINGS):
                gone[at : at + n] = True
            at = text.find(mark, at + n)
    if not gone.any():
        return part, rows
    return part[~gone], rows - np.concatenate(([0], np.cumsum(gone)))[rows]


def read(part: np.ndarray, rows: np.ndarray, words: Lexicon) -> tuple[np.ndarray, ...]:
    """Of lower-case texts: bytes, starts and ends of the words, their places by row, their clauses, classes and weights."""
    part, rows = joined(part, rows)
    starts, ends, bounds = word_spans(part, rows, IS_WORD)
    classes, weights = words.of(word_hashes(part, starts, ends))
    for k in BEGINNINGS:
        long = np.flatnonzero((ends - starts > k) & (classes != INSULT))
        c, w = words.of(~word_hashes(part, starts[long], starts[long] + k))
        hit = c > 0
        classes[long[hit]], weights[long[hit]] = c[hit], w[hit]
    clause = np.cumsum(IS_BREAK[part])[starts] + np.searchsorted(rows, starts, "right") if len(starts) else starts
    return part, starts, ends, bounds, clause, classes, weights


def matches(column: pa.Array, words: Lexicon, without: tuple[str, ...] = ()) -> np.ndarray:
    """[rows, 3]: weight of all matched patterns, of the strongest clause, number of matched clauses. ``without`` names transducers to leave out."""
    start, after, factor = compose([t for name, t in transducers().items() if name not in without])
    data, offsets = utf8(column)
    out = np.zeros((len(column), 3))
    for first, last in slices(offsets, SLICE):
        _, starts, _, bounds, clause, classes, weights = read(LOWER[data[offsets[first] : offsets[last]]], offsets[first : last + 1] - offsets[first], words)
        for i in np.unique(clause[(classes == INSULT) | (classes == THREAT)]):
            a, b = np.searchsorted(clause, (i, i + 1))
            state, total = start, 0.0
            for c, w in zip(classes[a:b].tolist(), weights[a:b].tolist(), strict=True):
                if c == INSULT or c == THREAT:
                    total += w * factor[state, c]
                state = after[state, c]
            row = first + int(np.searchsorted(bounds, a, "right")) - 1
            out[row] += total, 0, 1
            out[row, 1] = max(out[row, 1], total)
    return out


def _inputs(found: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(found)), np.log1p(found[:, 0]), np.minimum(found[:, 1], 20) / 5, np.log1p(found[:, 2])])


@dataclass
class Model:
    words: Lexicon | None
    curve: np.ndarray | None
    share: float
    without: tuple[str, ...] = ()

    def score(self, column: pa.Array) -> np.ndarray:
        if self.words is None or self.curve is None:
            return np.full(len(column), self.share)
        return 1 / (1 + np.exp(-np.clip(_inputs(matches(column, self.words, self.without)) @ self.curve, -30, 30)))


def _curve(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the constant is not shrunk."""
    b, shrink = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    shrink[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + shrink, x.T @ (w * (y - p)) - shrink @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", per_class: int = 6000, least: float = 0.02, odds: float = 10.0, without: tuple[str, ...] = ()) -> Model:
    """``docs`` have keys and texts; ``labels`` have keys and a label of 0 or 1 (others do not count; of several labels of a
    key the highest counts). Labels are chosen first, so only the bounded sample of texts is moved."""
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    marks = marks.join(docs.select(F.col(key).alias("key")), "key", "left_semi")
    sizes = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(None, None, float(1 in sizes))
    rate = {y: min(1.0, per_class / n) for y, n in sizes.items()}
    chosen = F.pmod(F.xxhash64("key"), F.lit(2**20)) < F.when(F.col("y") == 1, int(2**20 * rate[1])).otherwise(int(2**20 * rate[0]))
    # about 2 * per_class keys: small enough for every task by that bound
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(marks.where(chosen)), "key")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [int(x[:1].view(np.int64)[0]) if len(x) else 0 for _, x in shingle_sets(batch.column(0))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low, pa.int64())], ["text", "y", "low"])

    sample = rows.select("text", "y").mapInArrow(tidy(sketch), "text string, y int, low long").groupBy("y", "low").agg(F.min("text").alias("text"))
    sample = stored(sample.select("text", "y"), "sample")

    def texts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int]]:
        for t, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            yield LOWER[np.frombuffer((t.as_py() or "").encode(), np.uint8)], y

    def rows_of(seen: dict[tuple, list[int]]) -> Iterator[pa.RecordBatch]:
        items = list(seen.items())
        for k in range(0, len(items), 50_000):
            part = items[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([a for (a, _), _ in part], pa.int32()), pa.array([b for (_, b), _ in part], pa.binary()), *(pa.array([n[y] for _, n in part], pa.int64()) for y in (0, 1))], ["kind", "word", "clean", "toxic"])

    def tally(seen: dict[tuple, list[int]], keys: set[tuple], y: int) -> None:
        for x in keys:
            seen.setdefault(x, [0, 0])[y] += 1

    given = lexicon({}, {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by word (0), beginning (1), and word of a clause with a target (2)."""
        seen: dict[tuple, list[int]] = {}
        for batch in batches:
            for part, y in texts(batch):
                part, starts, ends, _, clause, classes, _ = read(part, np.array([0, len(part)]), given)
                raw = part.tobytes()
                words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                aimed = np.isin(clause, clause[classes == TARGET]) & (classes != TARGET)
                keys = {(0, w) for w in words if len(w) > 2} | {(2, words[i]) for i in np.flatnonzero(aimed) if len(words[i]) > 2}
                tally(seen, keys | {(1, w[:k]) for _, w in keys for k in BEGINNINGS if len(w) > k}, y)
        yield from rows_of(seen)

    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    enough = max(4, least * n.get(1, 0))
    table = "kind int, word binary, clean long, toxic long"
    summed = lambda work: sample.mapInArrow(tidy(work), table).groupBy("kind", "word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    log_odds = F.log((F.col("toxic") + 0.5) / (n.get(1, 0) + 1) / (F.col("clean") + 0.5) * (n.get(0, 0) + 1))
    learned = summed(count).where(F.col("toxic") >= enough).withColumn("w", log_odds).where(F.col("w") >= float(np.log(odds))).collect()
    insults, starts, aimed = ({bytes(r["word"]): r["w"] for r in learned if r["kind"] == k} for k in (0, 1, 2))
    threats = {w: x / AIMED for w, x in aimed.items() if w not in insults}
    words = lexicon(insults, starts, threats)

    def count_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by word that stands before a match in its clause."""
        seen: dict[tuple, list[int]] = {}
        for batch in batches:
            for part, y in texts(batch):
                part, starts, ends, _, clause, classes, _ = read(part, np.array([0, len(part)]), words)
                raw, keys = part.tobytes(), set()
                for i in np.flatnonzero((classes == INSULT) | (classes == THREAT)):
                    a = np.searchsorted(clause, clause[i])
                    keys |= {(3, raw[starts[j] : ends[j]]) for j in range(a, i) if classes[j] == OTHER}
                tally(seen, keys, y)
        yield from rows_of(seen)

    # a word after which a match is found in clean rows ``odds`` times as often as in toxic ones, by their numbers
    lowers = (F.col("clean") >= enough) & (log_odds <= -float(np.log(odds)))
    words = lexicon(insults, starts, threats, [bytes(r["word"]) for r in summed(count_before).where(lowers).collect()])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = matches(batch.column(0), words, without)
            yield pa.RecordBatch.from_arrays([*(pa.array(found[:, k]) for k in range(3)), batch.column(1)], ["a", "b", "c", "y"])

    got = sample.mapInArrow(tidy(measure), "a double, b double, c double, y int").toPandas().sort_values(["y", "a", "b", "c"])
    y = got["y"].to_numpy(float)
    weight = np.where(y == 1, sizes[1] / max(n.get(1, 1), 1), sizes[0] / max(n.get(0, 1), 1))
    return Model(words, _curve(_inputs(got[["a", "b", "c"]].to_numpy()), y, weight * len(y) / weight.sum()), sizes[1] / sum(sizes.values()), without)


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """Adds score and predicted to the columns ``keep`` (default: all); columns of these names are replaced."""
    new = StructType.fromDDL("score double, predicted int")
    kept = [c for c in (df.columns if keep is None else keep) if c not in new.names]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(batch.column(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*kept, *new.names])

    return by_place(df.select(named(text), *map(named, kept))).mapInArrow(tidy(work), StructType([*(df.schema[c] for c in kept), *new]))


def accepted(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows that score below the threshold, in their own columns, whatever these are called."""
    return rows_where(df, text, lambda column: model.score(column) < threshold)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")
