"""Queries over windows and targets: normalisation, spectra, metrics, splits, tests and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facewave.operators import hypothesis, metrics, models, normalise, spectral, splits, together
from facewave.plans.tables import FRAMES, at, frames, lines, windows

ENTRIES: dict = {}


def entry(name: str, sql: str | None = None):
    def keep(query):
        ENTRIES[name] = (query, sql)
        return query

    return keep


def r(c, n: int = 6):
    return F.round(c, n)


_list = "embedding::DOUBLE[]"


@entry("a1_window_statistics", f"SELECT vec_id, round(list_avg({_list}), 6) AS mean, round(list_stddev_pop({_list}), 6) AS std, round(list_min({_list}), 6) AS low, round(list_max({_list}), 6) AS high, round(list_avg(list_transform({_list}, lambda v: v * v)), 6) AS energy FROM embeddings")
def a1(spark: SparkSession, d: str) -> DataFrame:
    s = windows(spark, d).select("vec_id", spectral.statistics(F.col("x")).alias("s"))
    return s.select("vec_id", *[r(F.col("s")[k]).alias(n) for k, n in (("mean", "mean"), ("std", "std"), ("min", "low"), ("max", "high"), ("energy", "energy"))])


@entry("e8_plain_power", "WITH s AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range(64) t(i)), m AS (SELECT vec_id, avg(x) AS m FROM s GROUP BY vec_id), b AS (SELECT vec_id, k, sum((x - m) * cos(2 * pi() * k * i / 64)) AS re, sum((x - m) * sin(2 * pi() * k * i / 64)) AS im FROM s JOIN m USING (vec_id), range(33) u(k) GROUP BY vec_id, k) SELECT vec_id, round(sum(re * re + im * im) / 64, 6) AS power FROM b GROUP BY vec_id")
def e8(spark, d):
    return windows(spark, d).select("vec_id", r(spectral.plain_power(F.col("x"))).alias("power"))


_stats = "WITH s AS (SELECT l_suppkey, avg(l_quantity) AS m, stddev_pop(l_quantity) + 1e-8 AS s, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) + 1e-8 AS sp FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_suppkey), g AS (SELECT avg(l_quantity) AS gm, stddev_pop(l_quantity) + 1e-8 AS gs, avg(l_extendedprice) AS gmp, stddev_pop(l_extendedprice) + 1e-8 AS gsp FROM lineitem WHERE l_linestatus = 'F')"
VALUES = ["l_quantity", "l_extendedprice"]


@entry("a2_subject_statistics", f"{_stats} SELECT l_suppkey, round(m, 6) AS mean, round(s, 6) AS std, round(mp, 4) AS mean_price FROM s UNION ALL SELECT NULL, round(gm, 6), round(gs, 6), round(gmp, 4) FROM g")
def a2(spark, d):
    s = normalise.fit(lines(spark, d).where("l_linestatus = 'F'"), VALUES, "l_suppkey")
    return s.select("l_suppkey", r(F.col("m_l_quantity")).alias("mean"), r(F.col("s_l_quantity")).alias("std"), r(F.col("m_l_extendedprice"), 4).alias("mean_price"))


@entry("a3_global_zscore", f"{FRAMES} SELECT frame_idx, round((ear - avg(ear) OVER ()) / (stddev_pop(ear) OVER () + 1e-8), 6) AS z FROM fr")
def a3(spark, d):
    x = frames(spark, d).withColumn("nobody", F.lit(None).cast("string"))
    stats = normalise.fit(x.withColumn("nobody", F.lit("all")), ["ear"], "nobody").where("nobody is null")
    return normalise.transform(x, stats, ["ear"], "nobody").select("frame_idx", r(F.col("ear")).alias("z"))


@entry("j4_apply_normaliser", f"{_stats} SELECT l_orderkey, l_linenumber, round((l_quantity - coalesce(m, gm)) / coalesce(s, gs), 6) AS quantity, round((l_extendedprice - coalesce(mp, gmp)) / coalesce(sp, gsp), 6) AS price FROM lineitem l LEFT JOIN s USING (l_suppkey), g")
def j4(spark, d):
    x = lines(spark, d)
    out = normalise.transform(x, normalise.fit(x.where("l_linestatus = 'F'"), VALUES, "l_suppkey"), VALUES, "l_suppkey")
    return out.select("l_orderkey", "l_linenumber", r(F.col("l_quantity")).alias("quantity"), r(F.col("l_extendedprice")).alias("price"))


@entry("a4_inverse_targets", f"{_stats} SELECT l_orderkey, l_linenumber, round(l_discount * coalesce(s, gs) + coalesce(m, gm), 6) AS value FROM lineitem LEFT JOIN s USING (l_suppkey), g")
def a4(spark, d):
    x = lines(spark, d)
    stats = normalise.fit(x.where("l_linestatus = 'F'"), ["l_quantity"], "l_suppkey")
    out = normalise.inverse(x.drop("l_quantity").withColumn("l_quantity", F.col("l_discount")), stats, ["l_quantity"], "l_suppkey")
    return out.select("l_orderkey", "l_linenumber", r(F.col("l_quantity")).alias("value"))


@entry("j5_leaked_subjects", "SELECT DISTINCT user_id AS session FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'signup'")
def j5(spark, d):
    x = frames(spark, d)
    return splits.leaked_subjects(x.where("event_type = 'error'"), x.where("event_type = 'signup'"), "session")


_rank = lambda v, by: f"(rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0)"


def _regression_sql(by: str) -> str:
    keep, group = (f"{by}, ", f"GROUP BY {by}") if by != "1" else ("", "")
    return f"""WITH q AS (SELECT *, {_rank('l_quantity', by)} AS rp, {_rank('l_linenumber * 10.0', by)} AS rt, l_linenumber * 10.0 AS y, avg(l_linenumber * 10.0) OVER (PARTITION BY {by}) AS my FROM lineitem)
SELECT {keep}count(*) AS n, round(avg(abs(l_quantity - y)), 6) AS mae, round(sqrt(avg(power(l_quantity - y, 2))), 6) AS rmse, round(corr(l_quantity, y), 6) AS pearson, round(corr(rp, rt), 6) AS spearman, round(1 - sum(power(y - l_quantity, 2)) / sum(power(y - my, 2)), 6) AS r2 FROM q {group}"""


def _regressed(spark, d, by):
    x = lines(spark, d).withColumn("y", F.col("l_linenumber") * 10.0)
    m = metrics.regression(x, by, "l_quantity", "y")
    return m.select(*by, "n", *[r(F.col(c)).alias(c) for c in ("mae", "rmse", "pearson", "spearman", "r2")])


@entry("a5_regression_metrics", _regression_sql("1"))
def a5(spark, d):
    return _regressed(spark, d, [])


@entry("a6_subject_metrics", _regression_sql("l_suppkey"))
def a6(spark, d):
    return _regressed(spark, d, ["l_suppkey"])


# every window's prediction is made from the window itself; all windows (of a label) joined end to end are one signal
_joined = """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS t FROM embeddings), w AS (SELECT vec_id, {by} AS g, t, list_transform(range(1, 65), lambda i: 0.8 * t[i] + 0.1 * t[65 - i]) AS p, row_number() OVER (PARTITION BY {by} ORDER BY vec_id) - 1 AS n FROM v),
s AS (SELECT g, n * 64 + i AS at, p[i + 1] AS p, t[i + 1] AS t FROM w, range(64) u(i)), c AS (SELECT g, count(*) AS n FROM s GROUP BY g),
k AS (SELECT g, unnest(range((n - 512) // 256 + 1)) AS k FROM c), e AS (SELECT k.g, k.k, s.at - k.k * 256 AS i, p, t FROM k JOIN s ON s.g = k.g AND s.at >= k.k * 256 AND s.at < k.k * 256 + 512),
m AS (SELECT g, k, avg(p) AS p, avg(t) AS t FROM e GROUP BY g, k), d AS (SELECT e.g, e.k, i, (e.p - m.p) * (0.5 - 0.5 * cos(2 * pi() * i / 512)) AS p, (e.t - m.t) * (0.5 - 0.5 * cos(2 * pi() * i / 512)) AS t FROM e JOIN m USING (g, k)),
f AS (SELECT g, k, b, sum(p * cos(2 * pi() * b * i / 512)) AS pr, sum(p * sin(2 * pi() * b * i / 512)) AS pi, sum(t * cos(2 * pi() * b * i / 512)) AS tr, sum(t * sin(2 * pi() * b * i / 512)) AS ti FROM d, range(257) u(b) GROUP BY g, k, b),
q AS (SELECT g, b, b * 0.5 AS freq, avg(pr * pr + pi * pi) / (256 * 192) * CASE WHEN b IN (0, 256) THEN 1 ELSE 2 END AS p, avg(tr * tr + ti * ti) / (256 * 192) * CASE WHEN b IN (0, 256) THEN 1 ELSE 2 END AS t FROM f GROUP BY g, b),
z AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY p) + (count(*) OVER (PARTITION BY g, p) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY g ORDER BY t) + (count(*) OVER (PARTITION BY g, t) - 1) / 2.0 AS rt, avg(t) OVER (PARTITION BY g) AS mt FROM s),
r AS (SELECT g, count(*) AS n, avg(abs(p - t)) AS mae, sqrt(avg(power(p - t, 2))) AS rmse, corr(p, t) AS pearson, corr(rp, rt) AS spearman, 1 - sum(power(t - p, 2)) / sum(power(t - mt, 2)) AS r2 FROM z GROUP BY g)"""
_WAVES = ["mae", "rmse", "pearson", "spearman", "r2", "spectral_correlation", "spectral_distance", *[f"{b}_power_mae" for b in spectral.BANDS]]


def _joined_band(column: str, low: float, high: float) -> str:
    inside = f"freq >= {low} AND freq < {high}"
    return f"(sum({column}) FILTER ({inside}) - (arg_min({column}, freq) FILTER ({inside}) + arg_max({column}, freq) FILTER ({inside})) / 2) * 0.5"


def _waves_sql(by: str, name: str) -> str:
    bands = ", ".join(f"round(abs({_joined_band('p', a, b)} - {_joined_band('t', a, b)}), 6) AS {n}_power_mae" for n, (a, b) in spectral.BANDS.items())
    plain = ", ".join(f"round({c}, 6) AS {c}" for c in ("mae", "rmse", "pearson", "spearman", "r2"))
    return f"{_joined.format(by=by)} SELECT {name}n, {plain}, x.* EXCLUDE (g) FROM r JOIN (SELECT g, round(corr(p, t), 6) AS spectral_correlation, round(sqrt(sum(power(p - t, 2))), 6) AS spectral_distance, {bands} FROM q GROUP BY g) x USING (g)"


def _waves(spark, d, by):
    t = F.col("x")
    w = windows(spark, d).select("vec_id", "label", t.alias("t"), F.zip_with(t, F.reverse(t), lambda a, b: 0.8 * a + 0.1 * b).alias("p"))
    return metrics.waveform_regression(w, by, "vec_id", "p", "t", 64, 256.0).select(*([by] if by else []), "n", *[r(F.col(c)).alias(c) for c in _WAVES])


@entry("a5_waveform_metrics", _waves_sql("0", ""))
def a5_waves(spark, d):
    return _waves(spark, d, None)


@entry("a6_waveform_metrics_by_label", _waves_sql("label", "g AS label, "))
def a6_waves(spark, d):
    return _waves(spark, d, "label")


@entry("a8_result_summary", "SELECT l_returnflag, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY l_returnflag")
def a8(spark, d):
    return metrics.summary(lines(spark, d), "l_returnflag", ["l_discount", "l_tax"], "l_tax").select("l_returnflag", r(F.col("l_discount")).alias("l_discount"), r(F.col("l_tax")).alias("l_tax"))


@entry("a9_fold_summary", "SELECT l_returnflag, round(avg(l_discount), 6) AS mean, round(stddev_samp(l_discount), 6) AS std FROM lineitem GROUP BY l_returnflag")
def a9(spark, d):
    return metrics.summary(lines(spark, d), "l_returnflag", ["l_discount"], "l_discount", True).select("l_returnflag", r(F.col("l_discount")).alias("mean"), r(F.col("l_discount_std")).alias("std"))


@entry("a10_selection_curve", "SELECT l_returnflag AS covariance, l_linenumber AS k, round(avg(l_tax), 6) AS bic FROM lineitem GROUP BY ALL")
def a10(spark, d):
    return lines(spark, d).groupBy(F.col("l_returnflag").alias("covariance"), F.col("l_linenumber").alias("k")).agg(r(F.avg("l_tax")).alias("bic"))


def _ari_sql(rows: str, by: str = "") -> str:
    b, j = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    g = lambda keys: f"SELECT {b}sum(n * (n - 1) / 2.0) AS s FROM (SELECT {b}{keys}, sum(n) AS n FROM c GROUP BY {b}{keys}) {'GROUP BY ' + by if by else ''}"
    return f"""WITH c AS (SELECT {b}a, b, count(*) AS n FROM ({rows}) GROUP BY {b}a, b), s AS ({g('a, b')}), sa AS ({g('a')}), sb AS ({g('b')}), t AS (SELECT {b}sum(n) * (sum(n) - 1) / 2.0 AS total FROM c {'GROUP BY ' + by if by else ''})
SELECT {b}round((s.s - sa.s * sb.s / total) / ((sa.s + sb.s) / 2 - sa.s * sb.s / total), 6) AS ari FROM s JOIN sa {j} JOIN sb {j} JOIN t {j}"""


@entry("a11_rand_index", _ari_sql("SELECT l_returnflag AS a, l_linestatus AS b FROM lineitem"))
def a11(spark, d):
    return metrics.rand_index(lines(spark, d), "l_returnflag", "l_linestatus").select(r(F.col("ari")).alias("ari"))


_runs = "SELECT vec_id, i AS run, CASE WHEN embedding[i + 1] > 0 THEN 1 ELSE 0 END + CASE WHEN embedding[1] > 0.05 THEN 2 ELSE 0 END AS label FROM embeddings, range(4) t(i)"


@entry("a12_pairwise_rand_index", _ari_sql(f"SELECT p.run AS run_a, q.run AS run_b, p.label AS a, q.label AS b FROM ({_runs}) p JOIN ({_runs}) q ON p.vec_id = q.vec_id AND p.run < q.run", "run_a, run_b"))
def a12(spark, d):
    x = windows(spark, d).select("vec_id", F.col("x")[0].alias("x0"), F.posexplode(F.slice("x", 1, 4)).alias("run", "v"))
    x = x.withColumn("label", F.when(F.col("v") > 0, 1).otherwise(0) + F.when(F.col("x0") > F.lit(0.05).cast("float").cast("double"), 2).otherwise(0))
    return metrics.pairwise_rand_index(x, "run", "vec_id", "label").select(F.col("run_a").cast("long"), F.col("run_b").cast("long"), r(F.col("ari")).alias("ari"))


@entry("a13_profile_zscores", f"WITH p AS (SELECT label, avg({at(0)}) AS m FROM embeddings GROUP BY label) SELECT label, round((m - avg(m) OVER ()) / (CASE WHEN stddev_pop(m) OVER () < 1e-8 THEN 1 ELSE stddev_pop(m) OVER () END), 6) AS z FROM p")
def a13(spark, d):
    p = windows(spark, d).groupBy("label").agg(F.avg(F.col("x")[0]).alias("m"))
    s = p.agg(F.avg("m").alias("a"), F.stddev_pop("m").alias("s"))
    return p.crossJoin(F.broadcast(s)).select("label", r((F.col("m") - F.col("a")) / F.when(F.col("s") < 1e-8, 1.0).otherwise(F.col("s"))).alias("z"))


@entry("a14_motion_contrast", "SELECT l_suppkey, round(avg(l_discount) FILTER (l_linenumber = 7) - avg(l_discount) FILTER (l_linenumber = 1), 6) AS contrast FROM lineitem GROUP BY l_suppkey HAVING avg(l_discount) FILTER (l_linenumber = 7) - avg(l_discount) FILTER (l_linenumber = 1) IS NOT NULL")
def a14(spark, d):
    return metrics.motion_contrast(lines(spark, d), "l_suppkey", "l_linenumber", "l_discount", 7, 1).select("l_suppkey", r(F.col("contrast")).alias("contrast"))


@entry("a15_residual_histogram", "WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS c FROM lineitem) SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 50)), 49) AS BIGINT) AS bin, count(*) AS n, round(count(*) / any_value(c) / any_value((hi - lo) / 50), 9) AS density FROM lineitem, b GROUP BY 1")
def a15(spark, d):
    h = metrics.histogram(lines(spark, d), "l_extendedprice")
    return h.select(F.col("bin").cast("long").alias("bin"), "n", F.round("density", 9).alias("density"))


@entry("a16_alpha_by_cluster", "SELECT l_linenumber, count(*) AS n, round(quantile_cont(l_discount, 0.5), 6) AS median, min(l_discount) AS low, max(l_discount) AS high FROM lineitem GROUP BY l_linenumber")
def a16(spark, d):
    return lines(spark, d).groupBy("l_linenumber").agg(F.count("*").alias("n"), r(F.percentile("l_discount", F.lit(0.5))).alias("median"), F.min("l_discount").alias("low"), F.max("l_discount").alias("high"))


@entry("a17_pass_statistics", "SELECT label, CAST(i AS INTEGER) AS pos, round(avg(CAST(embedding[i + 1] AS DOUBLE)), 6) AS mean, round(coalesce(stddev_samp(CAST(embedding[i + 1] AS DOUBLE)), 0), 6) AS std FROM embeddings, range(64) t(i) GROUP BY label, i")
def a17(spark, d):
    return metrics.pass_statistics(windows(spark, d), "label", "x").select("label", "pos", r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"))


@entry("a18_waveform", f"SELECT vec_id, round(sqrt(list_avg(list_transform({_list}, lambda v: v * v))), 6) AS rms, round(list_max({_list}) - list_min({_list}), 6) AS peak_to_peak FROM embeddings")
def a18(spark, d):
    return windows(spark, d).select("vec_id", *[r(c).alias(k) for k, c in metrics.waveform(F.col("x")).items()])


@entry("a19_buffer_statistics", f"{FRAMES}, g AS (SELECT session, ear, (ts - lag(ts) OVER (PARTITION BY session ORDER BY ts, frame_idx)) * 1000 AS g FROM fr) SELECT session, round(avg(ear), 6) AS mean, round(stddev_pop(ear), 6) AS std, round(avg(ear * ear), 4) AS energy, round(stddev_pop(g), 3) AS jitter FROM g GROUP BY session")
def a19(spark, d):
    from facewave.operators.sequence import in_order

    x = frames(spark, d).withColumn("g", (F.col("ts") - F.lag("ts").over(in_order())) * 1000)
    return x.groupBy("session").agg(r(F.avg("ear")).alias("mean"), r(F.stddev_pop("ear")).alias("std"), r(F.avg(F.col("ear") * F.col("ear")), 4).alias("energy"), r(F.stddev_pop("g"), 3).alias("jitter"))


def _huber(gap: str) -> str:
    return f"list_avg(list_transform({gap}, lambda v: CASE WHEN v < 1 THEN 0.5 * v * v ELSE v - 0.5 END))"


@entry("a20_waveform_losses", f"""WITH v AS (SELECT vec_id, label, {_list} AS e FROM embeddings), z AS (SELECT vec_id, e[1:32] AS p, e[33:64] AS t, 0.5 + label / 10.0 AS var FROM v),
w AS (SELECT *, list_avg(p) AS mp, list_avg(t) AS mt, list_transform(range(1, 33), lambda i: abs(p[i] - t[i])) AS gap FROM z),
f AS (SELECT vec_id, list(abs(sqrt(pr * pr + pj * pj) - sqrt(tr * tr + tj * tj)) ORDER BY b) AS gap FROM (SELECT vec_id, b, sum(p[i + 1] * cos(2 * pi() * b * i / 32)) AS pr, sum(p[i + 1] * sin(2 * pi() * b * i / 32)) AS pj, sum(t[i + 1] * cos(2 * pi() * b * i / 32)) AS tr, sum(t[i + 1] * sin(2 * pi() * b * i / 32)) AS tj FROM z, range(32) r(i), range(17) u(b) GROUP BY vec_id, b) GROUP BY vec_id),
l AS (SELECT vec_id, {_huber('w.gap')} AS waveform, {_huber('f.gap')} AS spectral, list_avg(list_transform(w.gap[1:5], lambda v: v * v)) AS band_power,
1 - list_sum(list_transform(range(1, 33), lambda i: (p[i] - mp) * (t[i] - mt))) / (sqrt(list_sum(list_transform(p, lambda v: power(v - mp, 2)))) * sqrt(list_sum(list_transform(t, lambda v: power(v - mt, 2)))) + 1e-8) AS correlation,
list_avg(list_transform(w.gap, lambda v: 0.5 * (ln(var + 1e-6) + v * v / (var + 1e-6)))) AS uncertainty FROM w JOIN f USING (vec_id))
SELECT vec_id, round(waveform, 6) AS waveform, round(spectral, 6) AS spectral, round(band_power, 6) AS band_power, round(correlation, 6) AS correlation, round(uncertainty, 6) AS uncertainty, round(waveform + 0.4 * spectral + 0.6 * band_power + 0.3 * correlation + 0.1 * uncertainty, 6) AS total FROM l""")
def a20(spark, d):
    w = windows(spark, d).select("vec_id", F.slice("x", 1, 32).alias("p"), F.slice("x", 33, 32).alias("t"), (F.lit(0.5) + F.col("label") / 10.0).alias("var"))
    w = w.withColumns({"pb": F.slice("p", 1, 5), "tb": F.slice("t", 1, 5)})
    return metrics.losses(w, "p", "t", "pb", "tb", "var").select("vec_id", *[r(F.col(c)).alias(c) for c in (*metrics.LOSS_WEIGHTS, "total")])


@entry("a21_cluster_table", """WITH s AS (SELECT l_suppkey % 5 AS fold, l_returnflag AS band, avg(l_quantity) AS h, avg(l_tax) AS p, avg(l_discount) AS e FROM lineitem GROUP BY ALL), g AS (SELECT l_linestatus AS model, CASE WHEN l_linenumber < 4 THEN 'compact' ELSE 'augmented' END AS fs, avg(l_tax) AS mae, avg(l_discount) AS r2 FROM lineitem GROUP BY ALL)
SELECT CAST(fold AS INTEGER) AS fold, """ + ", ".join(f"round(max({c}) FILTER (band = '{b}'), 6) AS {n}_{b}" for b in "ANR" for c, n in (("h", "kw"), ("p", "p_holm"), ("e", "epsilon_squared"))) + ", " + ", ".join(f"(SELECT round({m}, 6) FROM g WHERE model = '{k}' AND fs = '{f}') AS {k}_{f}_{m}" for k in "FO" for f in ("compact", "augmented") for m in ("mae", "r2")) + ", " + ", ".join(f"round((SELECT {m} FROM g WHERE model = '{k}' AND fs = 'augmented') - (SELECT {m} FROM g WHERE model = '{k}' AND fs = 'compact'), 6) AS {k}_paired_{m}_delta" for k in "FO" for m in ("mae", "r2")) + " FROM s GROUP BY fold")
def a21(spark, d):
    from facewave.plans import study

    x = lines(spark, d)
    stats = x.groupBy((F.col("l_suppkey") % 5).cast("int").alias("fold"), F.col("l_returnflag").alias("band")).agg(F.avg("l_quantity").alias("h"), F.avg("l_tax").alias("adjusted"), F.avg("l_discount").alias("epsilon2"))
    fits = x.groupBy(F.col("l_linestatus").alias("model"), F.when(F.col("l_linenumber") < 4, "compact").otherwise("augmented").alias("features")).agg(F.avg("l_tax").alias("mae"), F.avg("l_discount").alias("r2"))
    out = study.cluster_table(stats, fits, ["A", "N", "R"], ["F", "O"], ["mae", "r2"])
    return out.select("fold", *[r(F.col(c)).alias(c) for c in out.columns if c != "fold"])


@entry("j6_cluster_exclusion", "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE l_linenumber NOT IN (SELECT l_linenumber FROM lineitem GROUP BY 1 HAVING avg(l_tax) > 0.0401) GROUP BY l_linenumber")
def j6(spark, d):
    x = lines(spark, d)
    out = x.groupBy("l_linenumber").agg(F.avg("l_tax").alias("m")).where("m > 0.0401")
    return x.join(F.broadcast(out), "l_linenumber", "left_anti").groupBy("l_linenumber").agg(F.count("*").alias("n"))  # at most one row per cluster


@entry("j7_paired_metrics", "SELECT a.l_suppkey, round(b.m - a.m, 6) AS gain FROM (SELECT l_suppkey, avg(l_tax) AS m FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) a JOIN (SELECT l_suppkey, avg(l_tax) AS m FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) b USING (l_suppkey)")
def j7(spark, d):
    mean = lambda s: F.avg(F.when(F.col("l_linestatus") == s, F.col("l_tax")))
    return lines(spark, d).groupBy("l_suppkey").agg(r(mean("O") - mean("F")).alias("gain")).where("gain is not null")


@entry("j8_label_pairs", f"{FRAMES} SELECT event_type AS a, k // 20 AS b, count(*) AS n FROM fr GROUP BY ALL")
def j8(spark, d):
    x = frames(spark, d)
    pairs = x.select("frame_idx", F.col("event_type").alias("a")).join(x.select("frame_idx", F.floor(F.col("k") / 20).alias("b")), "frame_idx")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


_psd = "s AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range(64) t(i)), m AS (SELECT vec_id, avg(x) AS m FROM s GROUP BY vec_id), b AS (SELECT vec_id, k, sum((x - m) * (0.5 - 0.5 * cos(2 * pi() * i / 64)) * cos(2 * pi() * k * i / 64)) AS re, sum((x - m) * (0.5 - 0.5 * cos(2 * pi() * i / 64)) * sin(2 * pi() * k * i / 64)) AS im FROM s JOIN m USING (vec_id), range(33) u(k) GROUP BY vec_id, k), p AS (SELECT vec_id, CAST(k AS INTEGER) AS bin, k * 4.0 AS freq, (re * re + im * im) / (256 * 24) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS power FROM b)"


def _spectrum(spark, d):
    return spectral.psd(windows(spark, d), "vec_id", "x", 256.0)


@entry("e1_power_density", f"WITH {_psd} SELECT vec_id, bin, round(power * 1000, 6) AS power FROM p")
def e1(spark, d):
    return _spectrum(spark, d).select("vec_id", "bin", r(F.col("power") * 1000).alias("power"))


def _trapezoid(low: float, high: float) -> str:
    inside = f"freq >= {low} AND freq < {high}"
    return f"coalesce((sum(power) FILTER ({inside}) - (arg_min(power, freq) FILTER ({inside}) + arg_max(power, freq) FILTER ({inside})) / 2) * 4 * CASE WHEN count(*) FILTER ({inside}) > 1 THEN 1 ELSE 0 END, 0)"


@entry("e2_band_power", f"WITH {_psd} SELECT vec_id, {', '.join(f'round({_trapezoid(a, b)} * 1000, 6) AS {n}' for n, (a, b) in spectral.BANDS.items())} FROM p GROUP BY vec_id")
def e2(spark, d):
    return spectral.band_power(_spectrum(spark, d), "vec_id", 256.0).select("vec_id", *[r(F.col(n) * 1000).alias(n) for n in spectral.BANDS])


@entry("e3_signal_features", f"WITH {_psd}, t AS (SELECT vec_id, sum(power) AS t, arg_max(freq, power) AS dominant FROM p GROUP BY vec_id), e AS (SELECT vec_id, -sum(power / (t + 1e-12) * ln(power / (t + 1e-12) + 1e-12)) AS entropy FROM p JOIN t USING (vec_id) GROUP BY vec_id) SELECT vec_id, round(sqrt(list_avg(list_transform({_list}, lambda v: v * v))), 6) AS rms, round(list_var_pop({_list}), 6) AS variance, dominant::DOUBLE AS dominant, round(entropy, 5) AS entropy FROM embeddings JOIN t USING (vec_id) JOIN e USING (vec_id)")
def e3(spark, d):
    w = windows(spark, d)
    f = spectral.signal_features(w, _spectrum(spark, d), "vec_id", "x")
    return f.select("vec_id", r(F.col("rms")).alias("rms"), r(F.col("variance")).alias("variance"), "dominant", r(F.col("entropy"), 5).alias("entropy"))


@entry("e4_clean_windows")
def e4(spark, d):
    return spectral.clean_windows(windows(spark, d), "vec_id", "x", 256.0)


# 50 windows of 64 samples and more for each label, so every signal has segments of 512
@entry("e5_long_spectrum", _joined.format(by="label").split("z AS (SELECT")[0].rstrip().rstrip(",") + " SELECT CAST(g AS INTEGER) AS label, CAST(b AS INTEGER) AS bin, round(t * 1000, 6) AS power FROM q")
def e5(spark, d):
    return spectral.long_signal_psd(windows(spark, d), "label", "vec_id", "x", 64, 256.0, 512).select(F.col("label").cast("int").alias("label"), "bin", r(F.col("power") * 1000).alias("power"))


@entry("e6_spectral_distance", f"WITH {_psd}, c AS (SELECT label, bin, avg(power) AS b FROM p JOIN embeddings USING (vec_id) GROUP BY label, bin), q AS (SELECT p.vec_id, p.power AS a, c.b FROM p JOIN embeddings e USING (vec_id) JOIN c ON c.label = e.label AND c.bin = p.bin) SELECT vec_id, round(coalesce(corr(a, b), 0), 6) AS correlation, round(sqrt(sum(power(a - b, 2))) * 1000, 6) AS distance FROM q GROUP BY vec_id")
def e6(spark, d):
    p = _spectrum(spark, d).join(windows(spark, d).select("vec_id", "label"), "vec_id")
    centre = p.groupBy("label", "bin").agg(F.avg("power").alias("b"))
    q = p.join(centre, ["label", "bin"])
    return q.groupBy("vec_id").agg(r(metrics.safe_corr("power", "b")).alias("correlation"), r(F.sqrt(F.sum(F.pow(F.col("power") - F.col("b"), 2))) * 1000).alias("distance"))


@entry("e7_spectrogram", "WITH s AS (SELECT vec_id, k AS segment, i, CAST(embedding[k * 8 + i + 1] AS DOUBLE) AS x FROM embeddings, range(5) t(k), range(32) u(i)), m AS (SELECT vec_id, segment, avg(x) AS m FROM s GROUP BY ALL), f AS (SELECT vec_id, segment, b, sum((x - m) * (0.5 - 0.5 * cos(2 * pi() * i / 32)) * cos(2 * pi() * b * i / 32)) AS re, sum((x - m) * (0.5 - 0.5 * cos(2 * pi() * i / 32)) * sin(2 * pi() * b * i / 32)) AS im FROM s JOIN m USING (vec_id, segment), range(13) v(b) GROUP BY ALL) SELECT vec_id, CAST(segment AS INTEGER) AS segment, b * 8.0 AS freq, round((re * re + im * im) / (256 * 12) * CASE WHEN b = 0 THEN 1 ELSE 2 END * 1000, 6) AS power FROM f")
def e7(spark, d):
    return spectral.spectrogram(windows(spark, d), "vec_id", "x", 256.0, 32, 24).select("vec_id", "segment", "freq", r(F.col("power") * 1000).alias("power"))


@entry("e9_resample", f"{FRAMES}, q AS (SELECT session, ts AS a, ear AS va, lead(ts) OVER w AS b, lead(ear) OVER w AS vb, min(ts) OVER (PARTITION BY session) AS o FROM fr WINDOW w AS (PARTITION BY session ORDER BY ts)) SELECT session, CAST(i AS BIGINT) AS i, round(va + (vb - va) * (o + i * 21600.0 - a) / (b - a), 5) AS value FROM (SELECT *, unnest(range(CAST(ceil((a - o) / 21600) AS BIGINT), CAST(ceil((b - o) / 21600) AS BIGINT))) AS i FROM q WHERE b > a)")
def e9(spark, d):
    return spectral.resample(frames(spark, d), 21600.0, "session", "ts", "ear").select("session", "i", r(F.col("ear"), 5).alias("value"))


# the lightest fold, subject by subject
@entry("g1_subject_folds", "WITH RECURSIVE s AS (SELECT l_suppkey, count(*) AS rows, row_number() OVER (ORDER BY count(*) DESC, l_suppkey DESC) AS i FROM lineitem GROUP BY l_suppkey), g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS load, CAST(NULL AS BIGINT) AS l_suppkey, CAST(NULL AS BIGINT) AS rows, 0 AS fold UNION ALL SELECT s.i, list_transform(range(1, 6), lambda k: g.load[k] + CASE WHEN k = list_position(g.load, list_min(g.load)) THEN s.rows ELSE 0 END), s.l_suppkey, s.rows, list_position(g.load, list_min(g.load)) - 1 FROM g JOIN s ON s.i = g.i + 1) SELECT l_suppkey, rows, CAST(fold AS INTEGER) AS fold FROM g WHERE i > 0")
def g1(spark, d):
    return splits.subject_folds(lines(spark, d), 5, "l_suppkey")


@entry("g2_hold_out", "SELECT CAST(ceil(count(DISTINCT user_id) * 0.2) AS BIGINT) AS held_out, count(DISTINCT user_id) AS subjects FROM events")
def g2(spark, d):
    x = splits.hold_out(frames(spark, d), 0.2, 42, "session")
    return x.agg(F.countDistinct(F.when(F.col("held_out"), F.col("session"))).alias("held_out"), F.countDistinct("session").alias("subjects"))


@entry("g3_subject_bootstrap", "SELECT CAST(i AS INTEGER) AS boot, count(DISTINCT user_id) AS draws FROM events, range(5) t(i) GROUP BY i")
def g3(spark, d):
    x = splits.subject_bootstrap(frames(spark, d), 5, 42, "session")
    return x.select("boot", "session", "weight").distinct().groupBy("boot").agg(F.sum("weight").alias("draws"))


@entry("g4_sample", "SELECT count(*) AS n FROM (SELECT vec_id FROM embeddings LIMIT 300)")
def g4(spark, d):
    return splits.hashed_sample(windows(spark, d), 300, "vec_id").agg(F.count("*").alias("n"))


@entry("g5_prefix", "SELECT event_id AS frame_idx, value AS ear FROM events ORDER BY event_id LIMIT 1000")
def g5(spark, d):
    return frames(spark, d).orderBy("frame_idx").limit(1000).select("frame_idx", "ear")


@entry("g6_fold_union", "SELECT l_linenumber + 16 * (CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END) AS label, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS fold, count(*) AS n FROM lineitem GROUP BY ALL")
def g6(spark, d):
    x = lines(spark, d).withColumn("label", F.col("l_linenumber"))
    u = splits.distinct_labels([(i, x.where(F.col("l_linestatus") == s)) for i, s in enumerate("FO")], "label")
    return u.groupBy("label", "fold").agg(F.count("*").alias("n"))


@entry("g7_set_operations", "(SELECT DISTINCT user_id AS session FROM events WHERE event_type = 'view') EXCEPT SELECT user_id FROM events WHERE value > 300")
def g7(spark, d):
    x = frames(spark, d)
    return x.where("event_type = 'view'").select("session").subtract(x.where("ear > 300").select("session"))


def _kw_sql(label: str, value: str) -> str:
    return f"""WITH q AS (SELECT {label} AS g, {value} AS v, rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0 AS r FROM lineitem), n AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(DISTINCT g) AS k FROM q),
s AS (SELECT sum(x) AS s FROM (SELECT power(sum(r), 2) / count(*) AS x FROM q GROUP BY g)), t AS (SELECT sum(c * (c * c - 1)) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM q GROUP BY v)),
h AS (SELECT n, k, (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h FROM n, s, t)"""


_bands = ["l_discount", "l_quantity", "l_tax"]


def _tests_sql(tests: str) -> str:
    """Holm's adjustment of a union of tests (band, n, groups, h, p, epsilon2)."""
    return f"WITH u AS ({tests}), s AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, band) + 1) * p AS step FROM u) SELECT band, n, groups, round(h, 5) AS h, round(p, 8) AS p, round(epsilon2, 8) AS epsilon2, round(least(1, max(step) OVER (ORDER BY p, band ROWS UNBOUNDED PRECEDING)), 8) AS adjusted FROM s"


def _test_sql(label: str, band: str, tail: str, rows: str = "") -> str:
    sql = _kw_sql(label, band).replace("FROM lineitem)", f"FROM lineitem {rows})")
    return f"SELECT * FROM ({sql} SELECT '{band}' AS band, CAST(n AS BIGINT) AS n, k AS groups, h, {tail} AS p, greatest(0, (h - k + 1) / (n - k)) AS epsilon2 FROM h)"


# three groups have two degrees of freedom, where the tail is exp(-h / 2)
@entry("t1_kruskal_wallis", _tests_sql(" UNION ALL ".join(_test_sql("l_returnflag", b, "exp(-h / 2)") for b in _bands)))
def t1(spark, d):
    out = hypothesis.band_statistics(lines(spark, d), "l_returnflag", _bands)
    return out.select("band", "n", "groups", r(F.col("h"), 5).alias("h"), *[r(F.col(c), 8).alias(c) for c in ("p", "epsilon2", "adjusted")])


_ps = "SELECT l_linenumber, exp(-(avg(l_quantity) - 24) * 4) / 10 AS p FROM lineitem GROUP BY l_linenumber"


@entry("t3_holm", f"WITH p AS ({_ps}) SELECT l_linenumber, round(least(1, max(s) OVER (ORDER BY p, l_linenumber ROWS UNBOUNDED PRECEDING)), 8) AS adjusted FROM (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, l_linenumber) + 1) * p AS s FROM p)")
def t3(spark, d):
    p = lines(spark, d).groupBy("l_linenumber").agg((F.exp(-(F.avg("l_quantity") - 24) * 4) / 10).alias("p"))
    return hypothesis.holm(p, "p", tie="l_linenumber").select("l_linenumber", r(F.col("adjusted"), 8).alias("adjusted"))


@entry("t4_permutation_test")
def t4(spark, d):
    return hypothesis.permutation_test(lines(spark, d), "l_returnflag", "l_quantity", ["l_linestatus"], "row")


@entry("t5_bootstrap_interval")
def t5(spark, d):
    x = lines(spark, d).groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_discount").alias("m"))
    return hypothesis.bootstrap_ci(x, "l_returnflag", "m", key="l_suppkey")


_differences = "WITH d AS (SELECT l_suppkey, avg(l_tax) FILTER (l_linestatus = 'F') - avg(l_tax) FILTER (l_linestatus = 'O') AS d FROM lineitem GROUP BY l_suppkey)"


def _difference(spark, d):
    s = F.col("l_linestatus")
    return lines(spark, d).groupBy("l_suppkey").agg(metrics.mean_gap("l_tax", s == "F", s == "O").alias("d"))


@entry("t6_sign_test", f"{_differences}, c AS (SELECT count(*) FILTER (d > 0) AS positive, count(*) FILTER (d <> 0) AS n FROM d) SELECT positive, n, round(least(1, 2 * list_sum(list_transform(range(least(positive, n - positive) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))), 8) AS p FROM c")
def t6(spark, d):
    return hypothesis.sign_table(_difference(spark, d), "d").select("positive", "n", r(F.col("p"), 8).alias("p"))


# the normal tail by the series of the error function; at fewer than 51 differences without ties the exact p stands instead
@entry("t7_signed_rank", f"{_differences}, q AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0), t AS (SELECT sum(c * (c * c - 1)) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM q GROUP BY abs(d))), w AS (SELECT count(*) AS n, sum(r) FILTER (d > 0) AS plus FROM q), z AS (SELECT n, plus, (plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1.0) * (2 * n + 1) / 24 - ties / 48) AS z FROM w, t), x AS (SELECT *, abs(z) / sqrt(2) AS x FROM z) SELECT n, plus, round(z, 6) AS z, round(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(60), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * k + 1) * ln(greatest(x, 1e-300)) - lgamma(k + 1)) / (2 * k + 1))), 6) AS p FROM x")
def t7(spark, d):
    out = hypothesis.signed_rank_table(_difference(spark, d), "d", exact=0)
    return out.select("n", "plus", r(F.col("z")).alias("z"), r(F.col("p")).alias("p"))


@entry("m1_principal_components")
def m1(spark, d):
    w = windows(spark, d)
    return models.principal_components(w, "x", 0.5).transform(w, "x").select("vec_id", "components")


@entry("m2_mixture_selection")
def m2(spark, d):
    w = windows(spark, d).select("vec_id", "x")
    best = together.fit_mixtures(w, "x", "vec_id")[1][0]
    return models.assign(w, "x", best).select("vec_id", "label")


@entry("m3_kmeans_selection")
def m3(spark, d):
    fits = together.prepare(windows(spark, d).withColumn("w", F.array(F.lit(1.0))), "x", "w", "vec_id", [0], None, 1.0)
    try:
        best, curve = together.chosen_k_means(fits, together.k_means(fits, [range(2, 9)]))[0]
    finally:
        fits.close()
    return spark.createDataFrame([(a, b, a == best.k) for a, b in curve.items()], "k int, silhouette double, chosen boolean")


_folds = "WITH f AS (SELECT l_suppkey % 5 AS fold, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), t AS (SELECT fold, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS xx, sum(x * y) AS xy FROM f GROUP BY fold), o AS (SELECT a.fold, sum(b.n) AS n, sum(b.sx) AS sx, sum(b.sy) AS sy, sum(b.xx) AS xx, sum(b.xy) AS xy FROM t a JOIN t b ON a.fold <> b.fold GROUP BY a.fold), w AS (SELECT fold, sy / n AS my, sx / n AS mx, (xy - sx * sy / n) / ((xx - sx * sx / n) + 10 * (xx / n - sx * sx / n / n)) AS b FROM o)"


def _one_feature(spark, d):
    return lines(spark, d).select("row", F.array("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_suppkey") % 5).cast("int").alias("fold"))


@entry("m6_baselines", f"{_folds} SELECT CAST(fold AS INTEGER) AS fold, round(avg(abs(y - (my + (x - mx) * b))), 6) AS ridge_mae, round(avg(abs(y - my)), 6) AS mean_mae FROM f JOIN w USING (fold) GROUP BY fold")
def m6(spark, d):
    x = _one_feature(spark, d)
    x = models.predict_by_fold(x, "x", "fold", models.ridge_by_fold(x, "x", ["y"], "fold", 10.0), ["p"])
    sums = x.groupBy("fold").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    total = sums.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    means = sums.crossJoin(F.broadcast(total)).select("fold", ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("m"))
    return x.join(F.broadcast(means), "fold").groupBy("fold").agg(r(F.avg(F.abs(F.col("y") - F.col("p")))).alias("ridge_mae"), r(F.avg(F.abs(F.col("y") - F.col("m")))).alias("mean_mae"))


def _without(x, i):
    """A vector without the component that is the target."""
    return F.filter(x, lambda v, k: k != i)


@entry("m6_all_baselines")
def m6_all(spark, d):
    w = windows(spark, d).select("vec_id", "x", F.col("x")[20].alias("y"), (F.col("vec_id") % 5).cast("int").alias("fold"))
    return models.baselines(w.withColumn("x", _without("x", 20)), "x", "y", "fold", 2)


@entry("m7_pooled_r2", f"{_folds} SELECT round(1 - sum(power(y - (my + (x - mx) * b), 2)) / (sum(y * y) - power(sum(y), 2) / count(*)), 6) AS r2 FROM f JOIN w USING (fold)")
def m7(spark, d):
    x = _one_feature(spark, d)
    return spark.createDataFrame([(float(round(models.pooled_r2(models.gram(x, "x", ["y"], "fold"), 1, 10.0)[0], 6)),)], "r2 double")


@entry("m8_permutation_control")
def m8(spark, d):
    w = windows(spark, d).select("vec_id", _without("x", 10).alias("x"), F.col("x")[10].alias("y"), (F.col("vec_id") % 5).cast("int").alias("fold"))
    return spark.createDataFrame([models.permutation_control(w, "x", "y", "fold", "vec_id", 10.0)], "r2 double, p double")


@entry("m9_ablation")
def m9(spark, d):
    w = windows(spark, d).select("vec_id", _without("x", 10).alias("x"), F.col("x")[10].alias("y"), (F.col("vec_id") % 5).cast("int").alias("fold"))
    score = lambda df: float(models.pooled_r2(models.gram(df, "x", ["y"], "fold"), 63, 10.0)[0])
    a, b = score(w), score(models.zeroed(w, "x", [3, 4]))
    return spark.createDataFrame([(a, b, a - b)], "base double, ablated double, lost double")


def _study(spark, d):
    w = windows(spark, d)
    return w.select(F.col("vec_id").alias("id"), F.concat(F.lit("s"), F.col("label").cast("string")).alias("subject"), _without("x", 20).alias("features"), F.col("x")[20].alias("alpha"), "label", "x")


@entry("a7_alpha_metrics", "WITH q AS (SELECT l_suppkey, l_linestatus AS model, l_discount AS p, l_tax AS t, avg(l_tax) OVER (PARTITION BY l_suppkey, l_linestatus) AS m FROM lineitem) SELECT l_suppkey, model, round(avg(abs(p - t)), 6) AS mae, round(1 - sum(power(t - p, 2)) / sum(power(t - m, 2)), 6) AS r2, round(corr(p, t), 6) AS pearson FROM q GROUP BY l_suppkey, model")
def a7(spark, d):
    x = lines(spark, d).withColumn("model", F.col("l_linestatus"))
    m = metrics.regression(x, ["l_suppkey", "model"], "l_discount", "l_tax")
    return m.select("l_suppkey", "model", *[r(F.col(c)).alias(c) for c in ("mae", "r2", "pearson")])


@entry("t2_effect_size", f"{_kw_sql('l_linestatus', 'l_extendedprice')} SELECT round(greatest(0, (h - k + 1) / (n - k)), 8) AS epsilon2 FROM h")
def t2(spark, d):
    return hypothesis.kruskal_wallis(lines(spark, d), "l_linestatus", "l_extendedprice").select(r(F.col("epsilon2"), 8).alias("epsilon2"))


@entry("m4_exact_silhouette", f"WITH s AS (SELECT a.vec_id, a.label, b.label AS other, sum(sqrt(list_sum(list_transform(range(1, 65), lambda i: power(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE), 2))))) AS t, count(*) AS n FROM embeddings a, embeddings b GROUP BY a.vec_id, a.label, b.label), o AS (SELECT vec_id, t / (n - 1) AS a FROM s WHERE label = other), e AS (SELECT vec_id, min(t / n) AS b FROM s WHERE label <> other GROUP BY vec_id) SELECT vec_id, round((b - a) / greatest(a, b), 5) AS silhouette FROM o JOIN e USING (vec_id)")
def m4(spark, d):
    from facewave.plans import study

    return study.exact_silhouette(windows(spark, d), "x", "label", "vec_id").select("vec_id", r(F.col("silhouette"), 5).alias("silhouette"))


@entry("m5_profiles")
def m5(spark, d):
    from facewave.plans import study

    p = study.fit_scorer(_study(spark, d), range(2, 9)).profiles()
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(p) for j, v in enumerate(row)], "component int, feature int, mean double")


@entry("m10_augmented_regression")
def m10(spark, d):
    from facewave.plans import held_out

    return held_out.compact_and_augmented(held_out.fit(_study(spark, d), boots=0, with_boosting=True))


# subjects are suppliers, models line states: the gain is the lower error of the tax beside the discount
@entry("m10_paired_summary")
def m10_paired(spark, d):
    from facewave.plans import study

    gap = lambda c: F.avg(F.abs(F.col(c) - 0.05))
    gains = lines(spark, d).groupBy(F.col("l_linestatus").alias("model"), F.col("l_suppkey").alias("subject")).agg((gap("l_discount") - gap("l_tax")).alias("gain"))
    return study.paired_summary(gains)


def _bands_study(spark, d):
    """Windows with three targets that are none of their features; the first components stand in for the named features."""
    rest = F.filter("x", lambda v, k: ~k.isin(19, 20, 21))
    return windows(spark, d).select(F.col("vec_id").alias("id"), F.concat(F.lit("s"), F.col("label").cast("string")).alias("subject"), rest.alias("features"), *[F.col("x")[i].alias(b) for b, i in zip(("theta", "alpha", "beta"), (19, 20, 21), strict=True)])


def _fitted(spark, d):
    from facewave.plans import held_out

    return held_out.fit(_bands_study(spark, d), targets=("theta", "alpha", "beta"), roles={n: i for i, n in enumerate(held_out.ARTIFACT_ROLES)}, blink=(0, 3))


@entry("m11_clustering_study")
def m11(spark, d):
    from facewave.plans import held_out

    return held_out.study(_fitted(spark, d), "alpha")


@entry("m12_stability")
def m12(spark, d):
    from facewave.plans import held_out

    return held_out.agreement(_fitted(spark, d))


@entry("m13_scored_windows")
def m13(spark, d):
    from facewave.plans import study

    x = _study(spark, d)
    return study.fit_scorer(x, range(2, 9)).score(x).select("id", "label", "share")


@entry("m14_experiment")
def m14(spark, d):
    from facewave.plans import held_out

    return held_out.experiment(_bands_study(spark, d), ablated=(3, 4), clustering=_fitted(spark, d))


# five groups have four degrees of freedom, where the tail is exp(-h / 2) (1 + h / 2)
@entry("t8_artifact_check", " UNION ALL ".join(f"SELECT {f} AS fold, band AS variable, n, groups, h, p, adjusted, adjusted < 0.05 AS survives FROM ({_tests_sql(' UNION ALL '.join(_test_sql('l_linenumber', b, 'exp(-h / 2) * (1 + h / 2)', f'WHERE l_linenumber NOT IN (3, 7) AND l_suppkey % 2 = {f}') for b in _bands))})" for f in (0, 1)))
def t8(spark, d):
    from facewave.plans import study

    x = lines(spark, d).withColumns({"label": F.col("l_linenumber"), "fold": (F.col("l_suppkey") % 2).cast("int")})
    out = study.artifact_check(x, {0: [3, 7], 1: [3, 7]}, _bands)
    return out.select("fold", "variable", "n", "groups", r(F.col("h"), 5).alias("h"), r(F.col("p"), 8).alias("p"), r(F.col("adjusted"), 8).alias("adjusted"), "survives")
