"""Subject-wise splits, samples and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facewave.operators.sequence import numbered


def some(df: DataFrame, rows: int, most: int = 1_000_000) -> DataFrame:
    """``df``, which has ``rows`` rows, marked to go to every task if these are at most ``most``."""
    return F.broadcast(df) if rows <= most else df


def _dealt(sizes: Sequence[tuple[int, int]], k: int) -> list[tuple[int, int, list[tuple[int, list[int]]]]]:
    """(size, subjects, steps) for sizes from the largest on with their numbers of subjects: who gets the next subject, as the lightest of ``k`` folds, for all subjects of a size at once. Each fold would take them
    at its load, its load and one size, and so on; all folds merged, these loads are rounds over the folds that lie low enough, and a step (first place, folds in turn) holds until the next fold is reached."""
    load, out = [0] * k, []
    for size, many in sizes:
        high = [divmod(x, size) for x in load]
        levels = sorted({a for a, _ in high})
        steps, start = [], 0
        for i, level in enumerate(levels):
            if start >= many:
                break
            turn = sorted((f for f in range(k) if high[f][0] <= level), key=lambda f: (high[f][1], f))
            items = many - start
            if i + 1 < len(levels):
                items = min(items, (levels[i + 1] - level) * len(turn))
            each, more = divmod(items, len(turn))
            for at, f in enumerate(turn):
                load[f] += size * (each + (at < more))
            steps.append((start, turn))
            start += items
        out.append((size, many, steps))
    return out


def subject_folds(rows: DataFrame, folds: int, subject: str = "subject", sample: int = 1280) -> DataFrame:
    """(subject, rows, fold): subjects from the largest on, each to the fold with the fewest rows so far (ties: the first). Of equal sizes the larger id comes first. Only the distinct sizes with their
    numbers of subjects reach the driver (n rows have at most sqrt(2 n)), and ``sample`` ids that cut the subjects of a size into ranges, in which they are numbered."""
    sizes = rows.where(F.col(subject).isNotNull()).groupBy(subject).agg(F.count("*").alias("rows"))
    classes = [(r["rows"], r["n"]) for r in sizes.groupBy("rows").agg(F.count("*").alias("n")).orderBy(F.desc("rows")).collect()]
    k = min(folds, sum(n for _, n in classes))
    if k < 2:
        raise ValueError("subject-wise folds need at least two subjects")
    ids = sizes.select(subject).orderBy(F.xxhash64(subject), subject).limit(sample).orderBy(subject).collect()
    at = numbered(sizes, ["rows"], subject, "__at", bounds=[r[0] for r in ids[20::20]])
    table = rows.sparkSession.createDataFrame(_dealt(classes, k), "rows long, __many long, __steps array<struct<start: long, turn: array<int>>>")
    place = F.col("__many") - 1 - F.col("__at")
    step = F.element_at(F.filter("__steps", lambda s: s["start"] <= place), -1)
    out = at.join(some(table, len(classes), 100_000), "rows").withColumn("__place", place).withColumn("__step", step)
    return out.select(subject, "rows", F.get("__step.turn", ((F.col("__place") - F.col("__step.start")) % F.size("__step.turn")).cast("int")).alias("fold"))


def placed(rows: DataFrame, folds: int, subject: str = "subject") -> DataFrame:
    """Rows with the fold of their subject."""
    table = subject_folds(rows, folds, subject).drop("rows")
    return rows.join(some(table, table.count()), subject)


def hold_out(rows: DataFrame, share: float = 0.2, seed: int = 42, subject: str = "subject") -> DataFrame:
    """Adds ``held_out``: the first ceil(share * G) subjects by a seeded hash."""
    names = rows.select(subject).where(F.col(subject).isNotNull()).distinct()
    n = -int(-share * names.count() // 1)
    first = names.orderBy(F.xxhash64(F.lit(seed), subject), subject).limit(n).withColumn("held_out", F.lit(True))
    return rows.join(some(first, n), subject, "left").fillna(False, ["held_out"])


def subject_bootstrap(rows: DataFrame, times: int, seed: int = 42, subject: str = "subject") -> DataFrame:
    """Rows of the drawn subjects with ``boot`` and ``weight``, how often the subject was drawn. Draws are rows of a
    small table, and a row is never repeated. Subjects are numbered where they lie, by a hash."""
    names = numbered(rows.select(subject).where(F.col(subject).isNotNull()).distinct().withColumn("__h", F.xxhash64(F.lit(seed), subject).cast("double")), [], "__h", "__at").drop("__h")
    n = names.count()
    draws = rows.sparkSession.range(times * n).select(F.floor(F.col("id") / max(n, 1)).cast("int").alias("boot"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(n, 1))).alias("__at"))
    weights = draws.groupBy("boot", "__at").agg(F.count("*").alias("weight")).join(some(names, n), "__at").drop("__at")
    return rows.join(some(weights, times * n), subject)


def subject_bootstraps(rows: DataFrame, of: str, times: int, seed: int = 42, subject: str = "subject") -> DataFrame:
    """(of, subject, boot, weight): what ``subject_bootstrap`` draws from the subjects (distinct rows) of each sample ``of`` (int) with the seed ``seed`` + ``of``, all samples at once."""
    own = (F.lit(seed) + F.col(of)).cast("int")
    names = numbered(rows.select(of, subject).withColumn("__h", F.xxhash64(own, subject).cast("double")), [of], "__h", "__at").drop("__h")
    many = rows.groupBy(of).agg(F.count("*").alias("__n"))
    ids = rows.sparkSession.range(times * (many.agg(F.max("__n")).first()[0] or 0)).crossJoin(F.broadcast(many)).where(F.col("id") < times * F.col("__n"))  # a row for each sample
    draws = ids.select(of, F.floor(F.col("id") / F.col("__n")).cast("int").alias("boot"), F.pmod(F.xxhash64(own, "id"), F.col("__n")).alias("__at"))
    return draws.groupBy(of, "boot", "__at").agg(F.count("*").alias("weight")).join(names, [of, "__at"]).select(of, subject, "boot", "weight")


def hashed_sample(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the first by a seeded hash: a top-n, not a sort of the table."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def distinct_labels(folds: Sequence[tuple[int, DataFrame]], label: str, room: int = 16) -> DataFrame:
    """The fold outputs as one table, labels moved apart by ``room`` for each fold."""
    parts = [df.withColumn(label, F.col(label) + room * (fold + 1)).withColumn("fold", F.lit(fold)) for fold, df in folds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leaked_subjects(train: DataFrame, held_out: DataFrame, subject: str = "subject") -> DataFrame:
    """Subjects on both sides; must be empty."""
    return train.select(subject).intersect(held_out.select(subject))
