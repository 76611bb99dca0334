"""Rank tests, corrections, permutation and bootstrap."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from facewave.operators.metrics import mid_ranks
from facewave.operators.sequence import numbered
from facewave.operators.splits import some
from facewave.sources.shared import stored


def chi_square_tail(x: float, df: int) -> float:
    """P(X > x): the regularised upper incomplete gamma function, by series or continued fraction."""
    a, z = df / 2, x / 2
    if z <= 0 or df <= 0:
        return 1.0
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - front * total)
    b, c = z + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def kruskal_wallis(df: DataFrame, label: str, value: str) -> DataFrame:
    """One row (n, groups, h, p, epsilon2): the tie-corrected statistic, its p by chi square, and its effect size; 0, 1 and 0 where there
    are fewer than two groups, no more rows than groups, or one value only."""
    rows = df.where(F.col(label).isNotNull() & F.col(value).isNotNull())
    ranked = mid_ranks(rows, value)
    groups = ranked.groupBy(label).agg(F.sum("rank").alias("r"), F.count("*").alias("m")).agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"), F.sum("m").alias("n"), F.count("*").alias("groups"))
    ties = rows.groupBy(value).agg(F.count("*").alias("t")).agg(F.sum(F.col("t").cast("double") * (F.col("t") * F.col("t") - 1)).alias("ties"))
    n, k = F.col("n").cast("double"), F.col("groups")
    correct = 1 - F.col("ties") / (n * n * n - n)
    h = F.when((k >= 2) & (n > k) & (correct > 0), (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / correct).otherwise(0.0)
    return groups.crossJoin(ties).withColumn("h", h).select("n", "groups", "h", chi_square_p(F.col("h"), F.col("groups") - 1).alias("p"), epsilon_squared(F.col("h"), k, n).alias("epsilon2"))


@F.pandas_udf(DoubleType())
def chi_square_p(h: pd.Series, degrees: pd.Series) -> pd.Series:
    """One value for each test, so a few rows at most."""
    return pd.Series([chi_square_tail(x, int(d)) if x > 0 else 1.0 for x, d in zip(h, degrees, strict=True)])


def band_statistics(df: DataFrame, label: str, bands: Sequence[str]) -> DataFrame:
    """(band, n, groups, h, p, epsilon2, adjusted): the test of each band's values against the labels, and its p adjusted over the bands."""
    rows = [kruskal_wallis(df, label, b).select(F.lit(b).alias("band"), "*") for b in bands]
    return holm(reduce(DataFrame.unionByName, rows), "p", tie="band")


def kruskal_wallis_by(df: DataFrame, by: Sequence[str], label: str, value: str, parts: int = 64) -> DataFrame:
    """(by..., n, groups, h, p, epsilon2): ``kruskal_wallis`` of every group of rows in one plan. Equal values are counted first; a group's ranks are worked out in ``parts`` ranges of its values,
    so that no window holds a whole group. Null values of ``by`` are a group."""
    rows = df.where(F.col(label).isNotNull() & F.col(value).isNotNull()).select(F.struct(*by).alias("__g"), F.col(label).alias("__l"), F.col(value).cast("double").alias("__v"))
    cells = rows.groupBy("__g", "__v", "__l").agg(F.count("*").alias("m"))
    bounds = rows.groupBy("__g").agg(F.percentile_approx("__v", [i / parts for i in range(1, parts)], 1000).alias("__q"))
    values = cells.groupBy("__g", "__v").agg(F.sum("m").alias("t")).join(F.broadcast(bounds), "__g").withColumn("__p", F.size(F.filter("__q", lambda b: b < F.col("__v")))).drop("__q")
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = values.groupBy("__g", "__p").agg(F.sum("t").alias("all")).withColumn("o", before(Window.partitionBy("__g").orderBy("__p"), "all")).drop("all")  # ``parts`` rows a group
    ranked = values.withColumn("b", before(Window.partitionBy("__g", "__p").orderBy("__v"), "t")).join(F.broadcast(ranges), ["__g", "__p"]).select("__g", "__v", (F.col("o") + F.col("b") + (F.col("t") + 1) / 2).alias("rank"))
    sums = cells.join(ranked, ["__g", "__v"]).groupBy("__g", "__l").agg(F.sum(F.col("rank") * F.col("m")).alias("r"), F.sum("m").alias("m"))
    sums = sums.groupBy("__g").agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"), F.sum("m").alias("n"), F.count("*").alias("groups"))
    ties = values.groupBy("__g").agg(F.sum(F.col("t").cast("double") * (F.col("t") * F.col("t") - 1)).alias("ties"))
    n, k = F.col("n").cast("double"), F.col("groups")
    correct = 1 - F.col("ties") / F.greatest(n * n * n - n, F.lit(1.0))
    h = F.when((k >= 2) & (n > k) & (correct > 0), (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / correct).otherwise(0.0)
    out = sums.join(ties, "__g").withColumn("h", h)
    return out.select("__g.*", "n", "groups", "h", chi_square_p(F.col("h"), F.col("groups") - 1).alias("p"), epsilon_squared(F.col("h"), k, n).alias("epsilon2"))


def epsilon_squared(h: Column, groups: Column, n: Column) -> Column:
    return F.when((n > groups) & (groups >= 2), F.greatest(F.lit(0.0), (h - groups + 1) / (n - groups))).otherwise(0.0)


def holm(df: DataFrame, p: str, by: Sequence[str] = (), tie: str | None = None) -> DataFrame:
    """Adds ``adjusted``: step-down p-values. A family of tests is small, so one window per family is enough."""
    family = list(by) or [F.lit(0)]
    w = Window.partitionBy(*family).orderBy(p, *([tie] if tie else []))
    step = (F.count("*").over(Window.partitionBy(*family)) - F.row_number().over(w) + 1) * F.col(p)
    return df.withColumn("__s", step).withColumn("adjusted", F.least(F.lit(1.0), F.max("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("__s")


def sign_test(positive: int, n: int) -> float:
    """Two-sided p of ``positive`` among ``n`` non-zero differences; 1 if there are none."""
    if not n:
        return 1.0
    low = min(positive, n - positive)
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(low + 1)]
    return min(1.0, 2 * sum(map(math.exp, logs)))


def signed_rank(differences: np.ndarray) -> float:
    """Two-sided Wilcoxon signed-rank p of one value per subject: exact without ties up to 50, else normal; 1 if all are zero or only one is given."""
    d = differences[np.isfinite(differences)]
    if len(d) <= 1 or not np.any(d):
        return 1.0
    d = d[d != 0]
    values, back, count = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    ranks = (np.cumsum(count) - (count - 1) / 2)[back]
    n, plus = len(d), ranks[d > 0].sum()
    if n <= 50 and len(values) == n:
        return _exact_signed(n, plus)
    variance = n * (n + 1) * (2 * n + 1) / 24 - (count**3 - count).sum() / 48
    return float(math.erfc(abs(plus - n * (n + 1) / 4) / math.sqrt(2 * variance)))


@F.pandas_udf(DoubleType())
def sign_p(positive: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([sign_test(int(a), int(b)) for a, b in zip(positive, n, strict=True)])


def sign_table(df: DataFrame, difference: str) -> DataFrame:
    """One row (positive, n, p) of the non-zero differences."""
    d = F.col(difference)
    return df.agg(F.count(F.when(d > 0, 1)).alias("positive"), F.count(F.when(d != 0, 1)).alias("n")).select("positive", "n", sign_p("positive", "n").alias("p"))


def signed_rank_table(df: DataFrame, difference: str, exact: int = 50) -> DataFrame:
    """One row (n, plus, z, p) of the finite non-zero differences: the sum of the ranks of positive ones, and its two-sided p, exact without ties up to ``exact`` rows and normal
    beyond. Ranks are made in ranges of values, so no task holds them all; no difference, or one alone, has p 1."""
    d = F.col(difference)
    rows = df.where(d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))).withColumn("__size", F.abs(d))
    ranked = mid_ranks(rows.where(d != 0), "__size", name="__rank")
    ties = rows.where(d != 0).groupBy("__size").agg(F.count("*").cast("double").alias("t")).agg(F.coalesce(F.sum(F.col("t") * (F.col("t") * F.col("t") - 1)), F.lit(0.0)).alias("ties"))
    sums = ranked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(d > 0, F.col("__rank")).otherwise(0.0)), F.lit(0.0)).alias("plus"))
    given = rows.agg(F.count("*").alias("given"))
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    out = sums.crossJoin(ties).crossJoin(given).withColumn("z", F.when(variance > 0, (F.col("plus") - n * (n + 1) / 4) / F.sqrt(variance)).otherwise(0.0))  # one row each

    @F.pandas_udf(DoubleType())
    def p_value(n: pd.Series, given: pd.Series, plus: pd.Series, ties: pd.Series, z: pd.Series) -> pd.Series:
        found = []
        for m, g, w, t, x in zip(n, given, plus, ties, z, strict=True):
            found.append(1.0 if g <= 1 or not m else _exact_signed(int(m), w) if m <= exact and not t else math.erfc(abs(x) / math.sqrt(2)))
        return pd.Series(found)

    return out.select("n", "plus", "z", p_value("n", "given", "plus", "ties", "z").alias("p"))


def _exact_signed(n: int, plus: float) -> float:
    """Two-sided p of a sum of positive ranks without ties, by counting the ways to each sum."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for r in range(1, n + 1):
        ways[r:] = ways[r:] + ways[:-r].copy()
    low = int(min(plus, n * (n + 1) / 2 - plus))
    return float(min(1.0, 2 * ways[: low + 1].sum() / 2.0**n))


def drawn(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """How many of ``good`` are among ``taken`` of all (hypergeometric). NumPy draws from fewer than 10 ** 9 only; beyond, this is the same method of rejection (Stadlober's ratio of uniforms)."""
    if not len(good) or (good + bad).max() < 10**9:
        return rng.hypergeometric(good, bad, taken)
    lgamma = np.vectorize(math.lgamma, [float])
    few, many, every = np.minimum(good, bad), np.maximum(good, bad), good + bad
    m = np.minimum(taken, every - taken)
    share = few / every
    mean, wide = m * share + 0.5, np.sqrt((every - m) / (every - 1) * taken * share * (1 - share) + 0.5)
    scale, mode = 1.7155277699214135 * wide + 0.8989161620588988, np.floor((m + 1) * ((few + 1) / (every + 2)))
    logs = lambda z, at: lgamma(z + 1) + lgamma(few[at] - z + 1) + lgamma(m[at] - z + 1) + lgamma(many[at] - m[at] + z + 1)
    top, end = logs(mode, slice(None)), np.minimum(np.minimum(m, few) + 1, np.floor(mean + 16 * wide))
    out, left = np.zeros(len(good), np.int64), np.arange(len(good))
    while len(left):
        x, y = 1 - rng.random(len(left)), rng.random(len(left))
        z = mean[left] + scale[left] * (y - 0.5) / x
        inside = (z >= 0) & (z < end[left])
        at, x, z = left[inside], x[inside], np.floor(z[inside])
        taken_in = 2 * np.log(x) <= top[at] - logs(z, at)
        out[at[taken_in]] = z[taken_in]
        left = np.setdiff1d(left, at[taken_in], assume_unique=True)
    out = np.where(good > bad, m - out, out)
    return np.where(m < taken, good - out, out)


def halved(rng: np.random.Generator, counts: np.ndarray, taken: int) -> np.ndarray:
    """Of rows with [permutations, labels] ``counts``, those of each label among the first ``taken`` places of a random order."""
    out, rest, left = np.zeros_like(counts), counts.sum(axis=1), np.full(len(counts), taken)
    for j in range(counts.shape[1]):
        rest = rest - counts[:, j]
        out[:, j] = drawn(rng, counts[:, j], rest, left)
        left = left - out[:, j]
    return out


def permutation_ranks(df: DataFrame, label: str, rank: str, strata: Sequence[str], key: str, n: int, seed: int = 42, block_rows: int = 4096) -> DataFrame:
    """(perm, label, r, m): rank sums by label when labels are shuffled within strata. Ranks never change, so they are made once.

    Rows of a stratum with one rank are alike, so they are counted (and no ``key`` tells them apart). Ranks of ``block_rows`` rows or more are blocks of their own, and the others are dealt to blocks of
    about as many rows. How many of a stratum's labels fall into a block in a permutation comes from halving its blocks again and again, by hypergeometric draws that are the same for all who ask. In a block
    of one rank these counts give the sums; in others the rows are permuted. So a stratum of any size is permuted as a whole, and rows of one rank cost no more the more they are."""
    kind = df.schema[label].dataType.simpleString()
    stratum = F.xxhash64(*strata) if strata else F.lit(0).cast("long")
    held = df.select(F.col(label).alias("label"), F.col(rank).cast("double").alias("rank"), stratum.alias("stratum")).groupBy("stratum", "rank", "label").agg(F.count("*").alias("c"))
    held = stored(held, "held")
    counts = held.groupBy("stratum", "label").agg(F.sum("c").alias("c"))
    cells = held.groupBy("stratum", "rank").agg(F.sum("c").alias("m"))
    about = counts.agg(F.sum("c").alias("rows"), F.collect_set("label").alias("names")).first()
    names = sorted(about["names"])  # the groups that are compared
    block_rows = max(block_rows, (about["rows"] or 0) // 16384)  # so that there are some ten thousand blocks at most beside those of small strata
    light = F.col("m") < block_rows
    rest = cells.agg(F.coalesce(F.sum(F.when(light, F.col("m"))), F.lit(0)).alias("rows"), F.count(F.when(~light, 1)).alias("blocks")).first()
    tasks = int((rest["rows"] + 100 * rest["blocks"]) * n // 20_000_000 + rest["rows"] // 200_000) + 1  # of some seconds each
    code = F.array_position(F.lit(names) if names else F.array(), F.col("label")).cast("int") - 1
    dealt = counts.withColumn("code", code).groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("code", "c"))).alias("held"))
    dealt = dealt.select("stratum", F.col("held.code").alias("codes"), F.col("held.c").alias("sizes"))
    dealt = dealt.join(cells.groupBy("stratum").agg(F.greatest(F.ceil(F.sum(F.when(light, F.col("m"))) / block_rows), F.lit(1)).cast("int").alias("blocks")), "stratum")
    dealt = stored(dealt, "dealt")
    own, block = F.when(~light, F.col("rank")), F.when(light, F.pmod(F.xxhash64(F.lit(seed), "rank"), F.col("blocks"))).otherwise(-1).cast("int")
    spread = cells.join(some(dealt, dealt.count()), "stratum").select("stratum", block.alias("block"), own.alias("own"), "rank", "m", "codes", "sizes")
    sized = spread.groupBy("stratum", "block", "own").agg(F.sum("m").alias("m")).withColumn("beside", F.count("*").over(Window.partitionBy("stratum")))
    blocks = sized.where("beside > 1").select("stratum", "block", "own", "m").orderBy("stratum", "block", "own").toPandas()
    places = {}  # of strata with several blocks: the number of each block, and where its rows begin
    for s, part in blocks.groupby("stratum"):
        places[int(s)] = {(b, o): i for i, (b, o) in enumerate(zip(part["block"].tolist(), part["own"].fillna(0.0).tolist(), strict=True))}, np.append(0, part["m"].to_numpy(np.int64).cumsum())
    shared = df.sparkSession.sparkContext.broadcast(places)
    start = seed & (2**64 - 1)

    def blocks_of(name: int, counts: np.ndarray, ends: np.ndarray, low: int, high: int, wanted: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(block, [permutations, labels] counts) of the wanted ones of the blocks from ``low`` to ``high``."""
        if high - low == 1:
            yield low, counts
        elif wanted:
            half = (low + high) // 2
            first = halved(np.random.default_rng([start, name, low, high]), counts, int(ends[half] - ends[low]))
            for a, b, c in ((low, half, first), (half, high, counts - first)):
                if some_ := [i for i in wanted if a <= i < b]:
                    yield from blocks_of(name, c, ends, a, b, some_)

    def permute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches) or [pd.DataFrame(columns=["stratum", "block", "own", "rank", "m", "codes", "sizes"])])  # bounded by the number of tasks
        sums, seen = np.zeros((n, len(names))), np.zeros(len(names), bool)
        for s, part in rows.groupby("stratum", sort=False):
            name, codes, sizes = int(s) & (2**64 - 1), np.array(part["codes"].iloc[0], np.int64), np.array(part["sizes"].iloc[0], np.int64)
            seen[codes] = True
            number, ends = shared.value.get(int(s), ({}, np.array([0, sizes.sum()])))
            own = {number.get((int(b), float(o)), 0): x for (b, o), x in part.fillna({"own": 0.0}).groupby(["block", "own"], sort=False)}
            for i, counts in blocks_of(name, np.tile(sizes, (n, 1)), ends, 0, len(ends) - 1, sorted(own)):
                x = own[i].sort_values("rank")
                ranks, m = x["rank"].to_numpy(float), x["m"].to_numpy(np.int64)
                if len(ranks) == 1:
                    sums[:, codes] += ranks[0] * counts
                    continue
                ranks, rng, last = np.repeat(ranks, m), np.random.default_rng([start, name, i]), counts.cumsum(axis=1)
                step = max(1, (1 << 16) // len(ranks))  # numbers that stay near the processor
                for a in range(0, n, step):
                    some_ = last[a : a + step]
                    total = np.zeros((len(some_), len(ranks) + 1))
                    np.cumsum(rng.permuted(np.broadcast_to(ranks, (len(some_), len(ranks))), axis=1), axis=1, out=total[:, 1:])
                    sums[a : a + step, codes] += np.diff(np.take_along_axis(total, some_, axis=1), axis=1, prepend=0.0)
        perm, at = np.nonzero(np.broadcast_to(seen, sums.shape))
        yield pd.DataFrame({"perm": perm, "at": at, "r": sums[perm, at]})

    sums = spread.repartition(tasks, "stratum", "block", "own").mapInPandas(permute, "perm int, at int, r double").groupBy("perm", "at").agg(F.sum("r").alias("r"))
    sums = sums.withColumn("label", F.get(F.lit(names) if names else F.array(), F.col("at")).cast(kind))
    many = counts.groupBy("label").agg(F.sum("c").alias("m"))  # a permutation leaves as many of each
    return sums.join(F.broadcast(many), "label").select("perm", "label", "r", "m")


def hash_text(text: str) -> int:
    """A number from a text that does not change between processes."""
    import zlib

    return zlib.crc32(text.encode())


def permutation_test(df: DataFrame, label: str, value: str, strata: Sequence[str], key: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """One row (h, p): the Kruskal-Wallis statistic against labels shuffled within strata, p = (1 + reached) / (1 + n)."""
    true = kruskal_wallis(df, label, value)
    ranked = mid_ranks(df.where(F.col(label).isNotNull() & F.col(value).isNotNull()), value)
    sums = permutation_ranks(ranked, label, "rank", strata, key, n, seed).groupBy("perm").agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"))
    own = ranked.groupBy(label).agg(F.sum("rank").alias("r"), F.count("*").alias("m")).agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("own"))
    # the statistic rises with the sum of squares, so these are compared; a small slack covers rounding
    reached = sums.crossJoin(F.broadcast(own)).agg(F.sum(F.when(F.col("s") >= F.col("own") * (1 - 1e-12), 1).otherwise(0)).alias("reached"))
    return true.crossJoin(reached).select("h", F.when(F.col("h") > 0, (F.col("reached") + 1) / F.lit(n + 1)).otherwise(1.0).alias("p"))


def bootstrap_ci(df: DataFrame, by: str, value: str, n: int = 2000, confidence: float = 0.95, seed: int = 0, block_rows: int = 10_000, key: str | None = None) -> DataFrame:
    """(by, n, mean, std, low, high) of finite values; nulls where there is none.

    Each bootstrap draws as many values as there are, with replacement. The values of a group are numbered and stand in blocks; how many of a bootstrap's draws fall into a block comes from halving
    the blocks again and again, by a binomial draw each time, which is the same for all who ask. A block is drawn from in a task, and its sums are added up, so that groups of
    every size are resampled in the same way. Rows are numbered by a hash of ``key``, or else of the value."""
    kind = df.schema[by].dataType.simpleString()
    v = F.col(value).cast("double")
    rows = df.select(F.col(by).alias("k"), (F.col(key) if key else v).alias("row"), F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v).alias("x"))
    about = rows.groupBy("k").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.when(F.count("x") > 1, F.stddev_samp("x")).when(F.count("x") == 1, 0.0).alias("std"))
    bounds = [(1 - confidence) / 2, (1 + confidence) / 2]
    some_ = rows.where("x is not null").withColumns({"g": F.coalesce(F.xxhash64("k"), F.lit(0)), "h": F.xxhash64(F.lit(seed), "k", "row", "x").cast("double")})
    many = some_.groupBy("g").agg(F.count("*").alias("many"))
    some_ = numbered(some_, ["g"], "h", "i", tie="x").join(some(many, many.count()), "g").withColumn("block", F.floor(F.col("i") / block_rows))

    def draws(name: int, block: int, many: int) -> np.ndarray:
        """How many draws of each bootstrap fall into a block."""
        low, high, out = 0, -(-many // block_rows), np.full(n, many)
        while high - low > 1:
            half = (low + high) // 2
            size = [min(b * block_rows, many) - min(a * block_rows, many) for a, b in ((low, half), (low, high))]
            first = np.random.default_rng([seed, name, low, high]).binomial(out, size[0] / size[1])
            low, high, out = (low, half, first) if block < half else (half, high, out - first)
        return out

    def resample(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, name, block = pdf.sort_values("i")["x"].to_numpy(float), int(keys[0]) & (2**63 - 1), int(keys[1])
        rng, sums = np.random.default_rng([seed, name, block]), np.empty(n)
        counts = draws(name, block, int(pdf["many"].iloc[0]))
        for a in range(0, n, 100):
            c = counts[a : a + 100]
            taken = np.append(x[rng.integers(0, len(x), c.sum())], 0.0)
            sums[a : a + 100] = np.where(c > 0, np.add.reduceat(taken, np.cumsum(c) - c), 0.0)
        return pd.DataFrame({"g": keys[0], "boot": range(n), "s": sums})

    boots = some_.select("g", "block", "i", "x", "many").groupBy("g", "block").applyInPandas(resample, "g long, boot int, s double").groupBy("g", "boot").agg(F.sum("s").alias("s"))
    ends = boots.join(some(many, many.count()), "g").groupBy("g").agg(*[F.percentile(F.col("s") / F.col("many"), F.lit(b)).alias(c) for b, c in zip(bounds, ("low", "high"), strict=True)])  # n values each
    return about.withColumn("g", F.coalesce(F.xxhash64("k"), F.lit(0))).join(ends, "g", "left").select(F.col("k").alias(by), "n", "mean", "std", "low", "high")
