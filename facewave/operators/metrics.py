"""Metrics, ranks, agreement of labels, and tables of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from facewave.operators import spectral


def mid_ranks(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank", parts: int = 64) -> DataFrame:
    """Adds the mid-rank (from 1; equal values share the mean rank) of ``value`` among all rows, or among those equal in ``by``.

    Equal values are counted first. Ranks over all rows are worked out in ranges of values, whose totals are added up
    apart, so no window runs over the whole table. Null values have no rank."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if by:
        ranked = counts.withColumn("__b", before(Window.partitionBy(*by).orderBy(value)))
    else:
        bounds = sorted(set(df.approxQuantile(value, [i / parts for i in range(1, parts)], 0.005)))
        part = F.lit(0)
        for b in bounds:
            part = part + (F.col(value) > b).cast("int")
        counts = counts.withColumn("__p", part)
        totals = counts.groupBy("__p").agg(F.sum("__n").alias("__n")).withColumn("__o", before(Window.orderBy("__p"))).drop("__n")  # at most ``parts`` rows
        ranked = counts.withColumn("__b", before(Window.partitionBy("__p").orderBy(value))).join(F.broadcast(totals), "__p").withColumn("__b", F.col("__b") + F.col("__o"))
    ranked = ranked.select(*by, F.col(value).alias("__v"), (F.col("__b") + (F.col("__n") + 1) / 2).alias(name))
    on = [df[c].eqNullSafe(ranked[c]) for c in by] + [df[value] == ranked["__v"]]
    return df.join(ranked, on, "left").select(df["*"], ranked[name])


def mean_gap(value: str, first: Column, second: Column) -> Column:
    """Aggregate: the mean of ``value`` where ``first`` holds less that where ``second`` holds. A sum of doubles hangs on its order, so that equal means may come out a last digit apart; here sums are
    of decimals and the gap is one quotient of exact numbers, so its sign is exact and equal gaps are equal. Groups with a value that 26 digits, 18 of them decimals, do not hold have the gap of plain averages."""
    v, count = F.col(value), "decimal(10,0)"
    exact = v.try_cast("decimal(26,18)")
    total = lambda c: F.try_sum(F.when(c, exact)).try_cast("decimal(26,18)")
    a, b, n, m = total(first), total(second), F.count(F.when(first, v)), F.count(F.when(second, v))
    gap = (a * m.cast(count) - b * n.cast(count)) / F.nullif((n * m).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    held = F.coalesce(F.bool_and(F.coalesce(exact.cast("double") == v, F.lit(False)) | v.isNull()), F.lit(False))
    return F.coalesce(F.when(held, gap.cast("double")), F.avg(F.when(first, v)) - F.avg(F.when(second, v)))


def safe_corr(a: str, b: str) -> Column:
    """Correlation; 0 where one side does not vary."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 0, F.covar_pop(a, b) / spread).otherwise(0.0)


def r_squared(target: str, pred: str, mean: str = "__mean") -> Column:
    """1 - residual / total; of a constant target 1 if it is met exactly and 0 if not. ``mean`` is a column with the target's mean."""
    residual, total = F.sum(F.pow(F.col(target) - F.col(pred), 2)), F.sum(F.pow(F.col(target) - F.col(mean), 2))
    return F.when(total > 0, 1 - residual / total).when(residual == 0, 1.0).otherwise(0.0)


def regression(df: DataFrame, by: Sequence[str], pred: str, target: str) -> DataFrame:
    """(by..., n, mae, rmse, pearson, spearman, r2); groups of fewer than two rows have zeros."""
    ranked = mid_ranks(mid_ranks(df, pred, by, "__rp"), target, by, "__rt")
    mean = df.groupBy(*by).agg(F.avg(target).alias("__mean"))
    ranked = ranked.join(mean, list(by)) if by else ranked.crossJoin(F.broadcast(mean))
    gap = F.col(pred) - F.col(target)
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), safe_corr(pred, target).alias("pearson"), safe_corr("__rp", "__rt").alias("spearman"), r_squared(target, pred).alias("r2"))
    return out.select(*by, "n", *[F.when(F.col("n") >= 2, F.col(c)).otherwise(0.0).alias(c) for c in ("mae", "rmse", "pearson", "spearman", "r2")])


def summary(results: DataFrame, by: str, metrics: Sequence[str], sort: str, sample: bool = False) -> DataFrame:
    """Means (and sample deviations) of metrics by a column, the best of ``sort`` first."""
    more = [F.stddev_samp(m).alias(f"{m}_std") for m in metrics] if sample else []
    return results.groupBy(by).agg(*[F.avg(m).alias(m) for m in metrics], *more).orderBy(F.desc(sort))


def rand_index(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., ari): adjusted Rand index of two labels of the same rows, from counts of label pairs."""
    two = lambda n: n * (n - 1) / 2
    cells = df.groupBy(*by, a, b).agg(F.count("*").alias("n"))
    over = lambda keys: cells.groupBy(*by, *keys).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(two(F.col("n"))).alias("s"))
    join = (lambda x, y: x.join(y, list(by))) if by else (lambda x, y: x.crossJoin(y))  # one row each without keys
    out = join(join(join(cells.groupBy(*by).agg(F.sum(two(F.col("n"))).alias("s"), two(F.sum("n")).alias("all")), over([a]).withColumnRenamed("s", "sa")), over([b]).withColumnRenamed("s", "sb")), over([]).drop("s"))
    expected = F.try_divide(F.col("sa") * F.col("sb"), F.col("all"))
    top = (F.col("sa") + F.col("sb")) / 2 - expected
    return out.select(*by, F.when(F.coalesce(top, F.lit(0.0)) == 0, 1.0).otherwise((F.col("s") - expected) / top).alias("ari"))


def pairwise_rand_index(assignments: DataFrame, run: str = "run", row: str = "row", label: str = "label") -> DataFrame:
    """The adjusted Rand index of each pair of runs on the rows they share."""
    left = assignments.select(F.col(run).alias("run_a"), row, F.col(label).alias("a"))
    right = assignments.select(F.col(run).alias("run_b"), row, F.col(label).alias("b"))
    return rand_index(left.join(right, row).where("run_a < run_b"), "a", "b", ["run_a", "run_b"])


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """(bin, n, density) over [min, max] in equal bins, the last one closed."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("all"))
    at = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(span))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    binned = at.withColumn("bin", F.when(width > 0, F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0))
    return binned.groupBy("bin", "all", width.alias("width")).agg(F.count("*").alias("n")).select("bin", "n", F.when(F.col("width") > 0, F.col("n") / F.col("all") / F.col("width")).alias("density"))


def motion_contrast(df: DataFrame, subject: str, label: str, value: str, high: int, low: int) -> DataFrame:
    """(subject, contrast): mean value in one cluster less that in another, for subjects that have both."""
    mean = lambda k: F.avg(F.when(F.col(label) == k, F.col(value)))
    return df.groupBy(subject).agg((mean(high) - mean(low)).alias("contrast")).where("contrast is not null")


def pass_statistics(passes: DataFrame, key: str, values: str) -> DataFrame:
    """(key, pos, mean, std): mean and sample deviation of each output position over the passes."""
    return passes.select(key, F.posexplode(values).alias("pos", "v")).groupBy(key, "pos").agg(F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"))


def waveform(values: Column) -> dict[str, Column]:
    n = F.nullif(F.size(values), F.lit(0))
    return {"rms": F.sqrt(F.aggregate(values, F.lit(0.0), lambda t, x: t + x * x) / n), "peak_to_peak": (F.array_max(values) - F.array_min(values)).cast("double")}


def smooth_l1(pred: Column, target: Column) -> Column:
    """Mean of 0.5 d^2 below one and |d| - 0.5 beyond."""
    gaps = F.zip_with(pred, target, lambda a, b: F.abs(a - b).cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda t, d: t + F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5)) / F.nullif(F.size(gaps), F.lit(0))


def gaussian_nll(pred: Column, target: Column, log_var: Column) -> Column:
    """Mean of 0.5 (log variance + d^2 / variance)."""
    parts = F.zip_with(F.zip_with(pred, target, lambda a, b: F.pow(a - b, 2)), log_var, lambda d, v: 0.5 * (v + d * F.exp(-v)))
    return F.aggregate(parts, F.lit(0.0), lambda t, x: t + x) / F.nullif(F.size(parts), F.lit(0))


def squared_error(pred: Column, target: Column) -> Column:
    """Mean of d^2."""
    parts = F.zip_with(pred, target, lambda a, b: F.pow(a - b, 2))
    return F.aggregate(parts, F.lit(0.0), lambda t, x: t + x) / F.nullif(F.size(parts), F.lit(0))


def correlation_loss(pred: Column, target: Column, floor: float = 1e-8) -> Column:
    """1 - correlation; the product of norms is raised by ``floor``."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda t, v: t + v)
    centred = lambda x: F.transform(x, lambda v: v - total(x) / F.size(x))
    p, t = centred(pred), centred(target)
    dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y))
    return 1 - dot(p, t) / (F.sqrt(dot(p, p)) * F.sqrt(dot(t, t)) + floor)


#: What each part weighs in the total.
LOSS_WEIGHTS = {"waveform": 1.0, "spectral": 0.4, "band_power": 0.6, "correlation": 0.3, "uncertainty": 0.1}


def losses(df: DataFrame, pred: str, target: str, pred_band: str, target_band: str, variance: str) -> DataFrame:
    """Adds a column for each part of the loss of a stored prediction, and their weighted ``total``. ``variance`` is the predicted one (a number)."""
    p, t = F.col(pred), F.col(target)
    log_var = F.transform(p, lambda _: F.log(F.col(variance) + 1e-6))
    df = df.withColumns({"__p": spectral.magnitudes(p), "__t": spectral.magnitudes(t)})
    df = df.withColumns({"waveform": smooth_l1(p, t), "spectral": smooth_l1(F.col("__p"), F.col("__t")), "band_power": squared_error(F.col(pred_band), F.col(target_band)), "correlation": correlation_loss(p, t), "uncertainty": gaussian_nll(p, t, log_var)})
    return df.withColumn("total", sum((F.col(c) * w for c, w in LOSS_WEIGHTS.items()), F.lit(0.0))).drop("__p", "__t")


def waveform_regression(windows: DataFrame, by: str | None, order: str, pred: str, target: str, width: int, rate: float) -> DataFrame:
    """``regression`` of all samples and ``spectral_errors`` side by side, for each value of ``by`` or over all windows."""
    keys = [by] if by else []
    points = windows.select(*keys, F.explode(F.arrays_zip(F.col(pred).alias("p"), F.col(target).alias("t"))).alias("x")).select(*keys, F.col("x.p").alias("p"), F.col("x.t").alias("t"))
    errors, spectrum = regression(points, keys, "p", "t"), spectral.spectral_errors(windows, by, order, pred, target, width, rate)
    return errors.join(spectrum, keys, "left") if by else errors.crossJoin(spectrum)  # one row each without keys
