"""The held-out clustering study as a whole: every fold's selection, its refit without blink columns and its bootstraps are fitted in shared passes, every row is scored once, and the tables of the
study come from what the rows then carry.

A study takes a table (id, subject, features array<double>, targets double). Rows with a null or non-finite feature or target take no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facewave.operators import boosting, hypothesis, metrics, models, splits, together
from facewave.plans.study import normaliser, paired_summary
from facewave.sources.shared import stored

#: Normalised means above this mark a cluster as an artifact.
ARTIFACT = 0.5
#: Labels of different folds are this far apart.
ROOM = 16
#: The features whose component means tell artifacts, and the one that orders clusters by motion.
ARTIFACT_ROLES, MOTION = ("blink_rate", "ear_std", "head_motion_energy"), "head_motion_energy"


@dataclass
class Fitted:
    """What a study has fitted. ``rows`` are all rows with what every fold says of them:

    (id, subject, fold, y, label, kmeans, blink_free, probability, compact, augmented, reference, boots), where y are the normalised targets, compact and augmented the ridges' predictions of them without and
    with the cluster probabilities, reference the labels of all folds' mixtures and then K-Means, boots those of the fold's bootstraps in the same order. For boosting they also have z and zy, features and targets as the
    folds that train on them see them, own, the features as their own fold sees them, and probabilities, those of every fold, ``most`` places for each."""

    rows: DataFrame
    folds: int
    boots: int
    targets: list[str]
    roles: dict[str, int]
    mixtures: list[list[models.Mixture]]
    mixture_silhouettes: list[float]
    k_means: list[tuple[together.Centres, dict[int, float]]]
    profiles: list[np.ndarray]
    train_rows: list[int]
    most: int = 0

    def close(self) -> None:
        self.rows.unpersist()

    def artifacts(self, fold: int) -> list[int]:
        """Components whose mean is above ``ARTIFACT`` in one of the features that tell artifacts."""
        at = [self.roles[n] for n in ARTIFACT_ROLES if n in self.roles]
        return [i for i, m in enumerate(self.profiles[fold]) if at and (m[at] > ARTIFACT).any()]


def _weighted(df: DataFrame, folds: int, boots: int, seed: int) -> tuple[DataFrame, int]:
    """Rows with ``fold`` and ``w``: first whether a row trains each fold, then how often its subject was drawn for each bootstrap of each fold's training subjects."""
    table = splits.subject_folds(df, folds).drop("rows").cache()
    count = table.agg(F.max("fold")).first()[0] + 1
    subjects, w = table, F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: (F.col("fold") != i).cast("double"))
    if boots:
        each = table.select("subject", F.explode(F.filter(F.sequence(F.lit(0), F.lit(count - 1)), lambda f: f != F.col("fold"))).alias("of"))
        draws = splits.subject_bootstraps(each, "of", boots, seed + 1000).select("subject", (F.col("of") * boots + F.col("boot")).alias("s"), F.col("weight").cast("double").alias("weight"))
        drawn = draws.groupBy("subject").agg(F.map_from_entries(F.collect_list(F.struct("s", "weight"))).alias("__d"))  # an entry for each bootstrap at most
        subjects = table.join(drawn, "subject", "left")
        w = F.concat(w, F.transform(F.sequence(F.lit(0), F.lit(count * boots - 1)), lambda i: F.coalesce(F.try_element_at("__d", i), F.lit(0.0))))
    subjects = subjects.select("subject", "fold", w.alias("w"))
    return df.join(splits.some(subjects, table.count()), "subject"), count


def _moments(rows: DataFrame, parts: int, column: int) -> dict[int, np.ndarray]:
    """By sample: total weight, weighted mean and population deviation of the vectors, from sums about a centre. ``rows`` are (h, vector, w)."""
    shift = models.centre(rows.select(rows.columns[1]))

    def work(h, v, w):
        v = v - shift
        yield 0, np.column_stack([w.sum(axis=0), w.T @ v, w.T @ (v * v)]).ravel()

    s = together.block_sums(rows, parts, work)[0].reshape(-1, 2 * column + 1)
    out = {}
    for i, row in enumerate(s):
        n = max(row[0], 1e-300)
        mean = row[1 : column + 1] / n
        out[i] = row[0], mean + shift, np.sqrt(np.maximum(row[column + 1 :] / n - mean**2, 0))
    return out


def fit(df: DataFrame, folds: int = 5, ks: Sequence[int] = range(2, 9), targets: Sequence[str] = ("alpha",), roles: Mapping[str, int] | None = None, blink: Sequence[int] = (), boots: int = 5, restarts: int = 20, keep: float = 0.95, rounds: int = 50, alpha: float = 1.0, seed: int = 42, part_rows: int = 50_000, with_boosting: bool = False) -> Fitted:
    """Folds of whole subjects; for each: statistics of the training subjects (held-out ones take those of all training rows), axes for ``keep`` of the variance, the mixture of lowest BIC and the K-Means of
    largest silhouette over ``ks``, a mixture without the ``blink`` columns (none given: the same one), ``boots`` refits of the chosen kinds on training subjects drawn with replacement, and ridges on the features without and with
    the fold's own probabilities. A subject's statistics are the same in every sample that holds it, so rows are normalised once."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = F.concat(F.transform("features", lambda x: x.cast("double")), F.array(*[F.col(t).cast("double") for t in targets]))
    clean = df.where(F.col("subject").isNotNull() & F.col("features").isNotNull()).select("id", "subject", v.alias("v")).where(F.forall("v", real))
    placed, folds = _weighted(clean, folds, boots, seed)
    own = normaliser(clean, "v").where(F.col("subject").isNotNull())
    z = F.zip_with(F.zip_with("v", "mean", lambda x, m: x - m), "std", lambda x, s: x / s)
    table = stored(placed.join(splits.some(own, own.count()), "subject").select("id", "subject", "fold", "v", z.alias("z"), "w"), "windows").persist()
    first = table.select(F.size("v")).first()
    wide, parts = first[0], table.count() // part_rows + 1
    d = wide - len(targets)
    every = _moments(table.select(F.xxhash64("id").alias("h"), "v", "w"), parts, wide)
    used = list(range(d))
    plain = [c for c in used if c not in set(blink)]

    bare_at = folds if blink else 0
    both = folds + bare_at
    selected = together.prepare(table, "z", "w", "id", [i % folds for i in range(both)], ([used] * folds + [plain] * folds)[:both], keep, part_rows)
    again = None
    try:
        found = together.k_means(selected, [ks] * both, restarts, rounds, seed=seed)
        kinds = [[(k, diagonal) for k in ks for diagonal in (True, False)]] * both
        mixed = together.mixtures(selected, kinds, found, 2, rounds)
        picked = together.chosen_k_means(selected, {k: c for k, c in found.items() if k[0] < folds})
        best = [m[0] for m in mixed]
        spread = together.silhouettes(selected, [(f, lambda x, m=best[f]: together.predict(m, x).argmax(axis=1), len(best[f].weights)) for f in range(folds)])
        light, dealt = selected.models(), selected.dealt(range(folds))

        def ridge(g, h, z, w):
            for f in dealt[g]:
                on, x, weight = light.seen(f, z, w)
                q = np.column_stack([np.ones(len(on)), z[on, :d], together.predict(best[f], x), z[on, d:]])
                yield f, ((q * weight[:, None]).T @ q).ravel()

        weights = []
        for f, s in sorted(selected.sums(ridge).items()):
            k = len(best[f].weights)
            m = s.reshape(1 + wide + k, -1)
            small = [*range(d + 1), *range(d + 1 + k, 1 + wide + k)]
            weights.append((models._ridge(m[np.ix_(small, small)], d, alpha), models._ridge(m, d + k, alpha)))
        boot_mixtures, boot_means, boot_axes = [], [], []
        if boots:
            again = together.prepare(table, "z", "w", "id", [folds + i for i in range(folds * boots)], [used] * (folds * boots), keep, part_rows)
            of = [i // boots for i in range(folds * boots)]
            seen = together.k_means(again, [sorted({picked[f][0].k, len(best[f].weights)}) for f in of], restarts, rounds, seed=seed + 1)
            boot_mixtures = [m[0] for m in together.mixtures(again, [[(len(best[f].weights), best[f].diagonal)] for f in of], seen, 2, rounds)]
            boot_means = [seen[i, picked[f][0].k][0] for i, f in enumerate(of)]
            boot_axes = again.axes
    finally:
        selected.close()
        if again:
            again.close()

    axes, means, most = selected.axes, [p[0] for p in picked], max(len(m.weights) for m in best[:folds])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = len(pdf)
            if not n:
                continue
            v, z, w = (np.array(pdf[c].tolist(), float).reshape(n, -1) for c in ("v", "z", "w"))
            fold = pdf["fold"].to_numpy()

            def by(sample: int, on: np.ndarray) -> np.ndarray:
                _, mean, std = every[sample]
                return np.where(w[on, sample, None] > 0, z[on], (v[on] - mean) / (std + 1e-8))

            all_ = np.arange(n)
            reference = np.zeros((n, 2 * folds), int)
            label, other, plain_, boot = np.zeros(n, int), np.zeros(n, int), np.zeros(n, int), np.zeros((n, 2 * boots), int)
            y, probability, compact, augmented = np.zeros((n, len(targets))), [None] * n, np.zeros((n, len(targets))), np.zeros((n, len(targets)))
            own, every_p = np.zeros((n, d)), np.zeros((n, folds, most))
            for f in range(folds):
                x = by(f, all_)
                at = (x - axes[f].mean) @ axes[f].axes.T
                p = together.predict(best[f], at)
                reference[:, f], reference[:, folds + f] = p.argmax(axis=1), means[f].label(at)
                on = np.flatnonzero(fold == f)
                own[on], every_p[:, f, : p.shape[1]] = x[on, :d], p
                label[on], other[on], y[on] = reference[on, f], reference[on, folds + f], x[on, d:]
                bare = (x[on] - axes[bare_at + f].mean) @ axes[bare_at + f].axes.T
                plain_[on] = together.predict(best[bare_at + f], bare).argmax(axis=1)
                one = np.ones((len(on), 1))
                compact[on], augmented[on] = np.hstack([one, x[on, :d]]) @ weights[f][0], np.hstack([one, x[on, :d], p[on]]) @ weights[f][1]
                for i in on:
                    probability[i] = p[i].tolist()
                for b in range(boots):
                    i = f * boots + b
                    at = (by(folds + i, on) - boot_axes[i].mean) @ boot_axes[i].axes.T
                    boot[on, b], boot[on, boots + b] = together.predict(boot_mixtures[i], at).argmax(axis=1), boot_means[i].label(at)
            more = {"z": z[:, :d].tolist(), "zy": z[:, d:].tolist(), "own": own.tolist(), "probabilities": every_p.reshape(n, -1).tolist()} if with_boosting else {}
            yield pd.DataFrame({"id": pdf["id"], "subject": pdf["subject"], "fold": fold, "y": y.tolist(), "label": label, "kmeans": other, "blink_free": plain_, "probability": probability, "compact": compact.tolist(), "augmented": augmented.tolist(), "reference": reference.tolist(), "boots": boot.tolist()} | more)

    name = lambda c: table.schema[c].dataType.simpleString()
    rows = table.mapInPandas(score, f"id {name('id')}, subject {name('subject')}, fold int, y array<double>, label int, kmeans int, blink_free int, probability array<double>, compact array<double>, augmented array<double>, reference array<int>, boots array<int>" + ", z array<double>, zy array<double>, own array<double>, probabilities array<double>" * with_boosting).persist()
    rows.count()
    table.unpersist()
    profiles = [axes[f].inverse(best[f].means)[:, :d] for f in range(folds)]
    return Fitted(rows, folds, boots, list(targets), dict(roles or {}), mixed[:folds], spread, picked, profiles, [int(every[f][0]) for f in range(folds)], most)


def agreement(fitted: Fitted) -> DataFrame:
    """(kind, a, b, ari): ``mixture_k_means`` (a: fold), ``mixture_boot`` and ``k_means_boot`` (a: fold, b: bootstrap) on held-out rows, ``mixture_folds`` and ``k_means_folds`` (two folds) on all rows. Counts of label pairs of
    all of them are one aggregation."""
    n, boots = fitted.folds, fitted.boots
    at = lambda c, i: F.get(c, F.lit(i))
    pair = lambda kind, a, b, x, y: F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("a"), F.lit(b).cast("int").alias("b"), x.alias("x"), y.alias("y"))
    pairs = [pair("mixture_k_means", F.col("fold"), -1, F.col("label"), F.col("kmeans"))]
    for b in range(boots):
        pairs += [pair("mixture_boot", F.col("fold"), b, F.col("label"), at("boots", b)), pair("k_means_boot", F.col("fold"), b, F.col("kmeans"), at("boots", boots + b))]
    for i in range(n):
        for j in range(i + 1, n):
            pairs += [pair("mixture_folds", F.lit(i), j, at("reference", i), at("reference", j)), pair("k_means_folds", F.lit(i), j, at("reference", n + i), at("reference", n + j))]
    return metrics.rand_index(fitted.rows.select(F.explode(F.array(*pairs)).alias("p")).select("p.*"), "x", "y", ["kind", "a", "b"])


def statistics(fitted: Fitted) -> DataFrame:
    """(kind, fold, band, n, groups, h, p, epsilon2, adjusted, survives): each target against the labels, ``fold`` by fold, ``kept`` by fold without the rows of artifact clusters, ``pooled`` and ``blink_free`` over all
    folds (fold -1) with the folds' labels apart; p adjusted over the targets, which survive below 0.05 where two clusters remain."""
    gone = F.create_map(*[x for f in range(fitted.folds) for x in (F.lit(f), F.array(*[F.lit(i) for i in fitted.artifacts(f)]).cast("array<int>"))])
    apart = ROOM * (F.col("fold") + 1)
    kind = lambda k, fold, label: F.struct(F.lit(k).alias("kind"), fold.cast("int").alias("of"), label.cast("int").alias("label"))
    kept = F.when(~F.array_contains(F.try_element_at(gone, F.col("fold")), F.col("label")), F.col("label"))
    kinds = F.array(kind("fold", F.col("fold"), F.col("label")), kind("kept", F.col("fold"), kept), kind("pooled", F.lit(-1), F.col("label") + apart), kind("blink_free", F.lit(-1), F.col("blink_free") + apart))
    bands = F.array(*[F.struct(F.lit(t).alias("band"), F.get("y", F.lit(i)).alias("value")) for i, t in enumerate(fitted.targets)])
    long = fitted.rows.select(F.explode(kinds).alias("k"), bands.alias("b")).select("k.*", F.explode("b").alias("b")).select("kind", F.col("of").alias("fold"), "label", "b.*")
    tests = hypothesis.kruskal_wallis_by(long, ["kind", "fold", "band"], "label", "value")
    return hypothesis.holm(tests, "p", ["kind", "fold"], "band").withColumn("survives", (F.col("adjusted") < 0.05) & (F.col("groups") > 1))


def motion(fitted: Fitted, target: str) -> DataFrame:
    """(fold, subject, contrast): a held-out subject's mean target in the fold's cluster of most motion less that in the one of least, for subjects that have both."""
    i = fitted.roles[MOTION]
    ends = [(f, int(p[:, i].argmax()), int(p[:, i].argmin())) for f, p in enumerate(fitted.profiles) if len(p) > 1]
    table = fitted.rows.sparkSession.createDataFrame(ends, "fold int, high int, low int")
    value = F.get("y", F.lit(fitted.targets.index(target)))
    mean = lambda c: F.avg(F.when(F.col("label") == F.col(c), value))
    return fitted.rows.join(F.broadcast(table), "fold").groupBy("fold", "subject").agg((mean("high") - mean("low")).alias("contrast")).where("contrast is not null")  # a row for each fold


def _by_subject(rows: DataFrame, targets: Sequence[str]) -> DataFrame:
    sides = [F.struct(F.lit(s).alias("features"), F.lit(t).alias("target"), F.get(s, F.lit(i)).alias("pred"), F.get("y", F.lit(i)).alias("true")) for s in ("compact", "augmented") for i, t in enumerate(targets)]
    long = rows.select("subject", F.explode(F.array(*sides)).alias("x")).select("subject", "x.*")
    return metrics.regression(long, ["subject", "features", "target"], "pred", "true").select("subject", "features", "target", "mae", "r2", "pearson")


def regression(fitted: Fitted) -> DataFrame:
    """(subject, features, target, mae, r2, pearson) of the held-out ridges without (compact) and with (augmented) the cluster probabilities."""
    return _by_subject(fitted.rows, fitted.targets)


def boosted(fitted: Fitted, trees: int = 40, depth: int = 2) -> DataFrame:
    """The same as ``regression`` of gradient boosting: a fold's trees learn from the other folds' rows as that fold sees them and with the probabilities of its own mixture, all folds and targets in the
    same passes. Needs a study that was fitted ``with_boosting``."""
    names = [f"__p{i}" for i in range(len(fitted.targets))]
    rows = fitted.rows.select("subject", "fold", "y", "zy", F.concat("z", "probabilities").alias("x"), F.concat("own", "probabilities").alias("own"))
    learnt = rows.select("fold", "x", *[F.get("zy", F.lit(i)).alias(n) for i, n in enumerate(names)])
    d = fitted.profiles[0].shape[1]
    for side, wide in (("compact", 0), ("augmented", fitted.most)):
        forest = boosting.fit_boosted(learnt, "x", names, "fold", trees, depth, columns=[[*range(d), *range(d + f * fitted.most, d + f * fitted.most + wide)] for f in range(fitted.folds)])
        rows = boosting.predict_boosted(rows, forest, "own", "fold", names).withColumn(side, F.array(*names)).drop(*names)
    return _by_subject(rows, fitted.targets)


def compact_and_augmented(fitted: Fitted) -> DataFrame:
    """(model, subject, target, mae_compact, mae_augmented, gain) of ridges and of boosting without and with the cluster probabilities, on the same folds. The study is closed."""
    both = regression(fitted).withColumn("model", F.lit("ridge")).unionByName(boosted(fitted).withColumn("model", F.lit("boosted")))
    side = lambda s: F.max(F.when(F.col("features") == s, F.col("mae")))
    out = both.groupBy("model", "subject", "target").agg(side("compact").alias("mae_compact"), side("augmented").alias("mae_augmented")).withColumn("gain", F.col("mae_compact") - F.col("mae_augmented")).persist()
    out.count()
    fitted.close()
    return out


def gains(results: DataFrame) -> DataFrame:
    """(measure, subject, gain): means over the targets of what the augmented features change."""
    measures = ["mae", "r2", "pearson"]
    side = lambda s, m: F.avg(F.when(F.col("features") == s, F.col(m)))
    wide = results.groupBy("subject").agg(*[(side("augmented", m) - side("compact", m)).alias(m) for m in measures])
    return wide.select("subject", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("gain")) for m in measures])).alias("x")).select("x.measure", "subject", "x.gain")


def records(fitted: Fitted, agreed: DataFrame, tests: DataFrame, main: str) -> DataFrame:
    """One row for each fold: its sizes, what was selected, how the labels agree, the main target's test, which components are artifacts and whether the target survives without them."""
    spark = fitted.rows.sparkSession
    table = [(f, fitted.train_rows[f], len(m[0].weights), "diagonal" if m[0].diagonal else "full", float(m[0].bic), fitted.mixture_silhouettes[f], c.k, curve[c.k], fitted.artifacts(f)) for f, (m, (c, curve)) in enumerate(zip(fitted.mixtures, fitted.k_means, strict=True))]
    chosen = spark.createDataFrame(table, "fold int, train_rows long, components int, covariance string, bic double, silhouette double, k_means int, k_means_silhouette double, artifacts array<int>")
    mean = lambda k: F.avg(F.when(F.col("kind") == k, F.col("ari")))
    ari = agreed.groupBy(F.col("a").alias("fold")).agg(mean("mixture_k_means").alias("mixture_k_means_ari"), mean("mixture_boot").alias("mixture_boot_ari"), mean("k_means_boot").alias("k_means_boot_ari"))
    of = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    own = tests.where((F.col("band") == main) & (F.col("fold") >= 0)).groupBy("fold").agg(of("fold", "n").alias("rows"), of("fold", "h").alias("h"), of("fold", "adjusted").alias("adjusted"), of("fold", "epsilon2").alias("epsilon2"), of("kept", "survives").alias("survives"))
    return chosen.join(F.broadcast(ari), "fold", "left").join(F.broadcast(own), "fold", "left").withColumn("survives", F.coalesce("survives", F.lit(False)))  # a row for each fold


def pooled(fitted: Fitted, agreed: DataFrame, tests: DataFrame, main: str, permutations: int = 1000, seed: int = 42) -> DataFrame:
    """(measure, value) over all folds: the main target's pooled test with its permutation p (labels shuffled within subjects), the same without blink columns, agreement between folds, and the subjects' motion contrast
    with its interval and sign test."""
    spark = fitted.rows.sparkSession
    i = fitted.targets.index(main)
    labels = fitted.rows.select("id", "subject", "fold", (F.col("label") + ROOM * (F.col("fold") + 1)).alias("label"), F.get("y", F.lit(i)).alias("value"))
    out: dict[str, float | None] = {}
    for r in tests.where((F.col("fold") == -1) & (F.col("band") == main)).collect():  # two rows
        out |= {f"{r['kind']}_{c}": float(r[c]) for c in ("h", "adjusted", "epsilon2", "survives")}
    out["permutation_p"] = hypothesis.permutation_test(labels, "label", "value", ["fold", "subject"], "id", permutations, seed).first()["p"]
    for r in agreed.groupBy("kind").agg(F.avg("ari").alias("ari")).collect():  # five rows at most
        out[f"{r['kind']}_ari"] = r["ari"]
    if MOTION in fitted.roles:
        contrast = motion(fitted, main).withColumn("all", F.lit(0)).cache()
        sign = hypothesis.sign_table(contrast, "contrast").first()
        about = hypothesis.bootstrap_ci(contrast, "all", "contrast", key="subject").first()
        contrast.unpersist()
        out |= {"motion_subjects": float(about["n"]) if about else 0.0, "motion_p": sign["p"]} | {f"motion_{c}": about[c] if about else None for c in ("mean", "low", "high")}
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in sorted(out.items())], "measure string, value double")


def paired(fitted: Fitted) -> DataFrame:
    """(measure, n, mean, std, low, high, p) of the subjects' gains by the cluster probabilities."""
    found = gains(regression(fitted)).persist()
    out = paired_summary(found, "measure").persist()
    out.count()
    found.unpersist()
    return out


def study(fitted: Fitted, main: str, permutations: int = 1000) -> DataFrame:
    """(fold, measure, value) of all that the study finds: what was selected and tested for each fold, and (fold -1) the pooled measures and the summaries of the gains by cluster probabilities."""
    agreed, tests = agreement(fitted).persist(), statistics(fitted).persist()
    by_fold = records(fitted, agreed, tests, main)
    number = lambda c: F.size(c).cast("double") if c == "artifacts" else (F.col(c) == "diagonal").cast("double") if c == "covariance" else F.col(c).cast("double")
    name = {"covariance": "diagonal"}
    long = lambda df, columns: F.explode(F.array(*[F.struct(F.lit(name.get(c, c)).alias("measure"), number(c).alias("value")) for c in columns])).alias("x")
    out = by_fold.select("fold", long(by_fold, [c for c in by_fold.columns if c != "fold"])).select("fold", "x.*")
    out = out.unionByName(pooled(fitted, agreed, tests, main, permutations).withColumn("fold", F.lit(-1)))
    more = paired(fitted)
    numbers = F.explode(F.array(*[F.struct(F.concat(F.lit("gain_"), "measure", F.lit(f"_{c}")).alias("measure"), F.col(c).cast("double").alias("value")) for c in ("n", "mean", "std", "low", "high", "p")])).alias("x")
    return out.unionByName(more.select(F.lit(-1).alias("fold"), numbers).select("fold", "x.*"))


def experiment(df: DataFrame, main: str = "alpha", folds: int = 5, permutations: int = 200, ablated: Sequence[int] = (), column: int = 0, clustering: Fitted | None = None, study_permutations: int = 1000) -> DataFrame:
    """(part, name, fold, measure, value): ``baselines`` of every fold, their ``report`` (means over the folds), the ``controls`` (permuted targets, features set to 0) of a ridge, and the clustering
    study where a fitted one is given."""
    placed = splits.placed(df, folds).select("id", "fold", "features", F.col(main).cast("double").alias("y")).persist()
    found = models.baselines(placed, "features", "y", "fold", column).persist()
    measures = ["mae", "rmse", "r2"]
    long = lambda c: F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])).alias("x")
    rows = found.select(F.lit("baselines").alias("part"), F.col("model").alias("name"), "fold", long(found)).select("part", "name", "fold", "x.*")
    report = metrics.summary(found, "model", measures, "r2")
    rows = rows.unionByName(report.select(F.lit("report").alias("part"), F.col("model").alias("name"), F.lit(-1).alias("fold"), long(report)).select("part", "name", "fold", "x.*"))
    d = placed.select(F.size("features")).first()[0]
    r2, p = models.permutation_control(placed, "features", "y", "fold", "id", 100.0, permutations)
    less = float(models.pooled_r2(models.gram(models.zeroed(placed, "features", ablated), "features", ["y"], "fold"), d, 100.0)[0]) if ablated else r2
    controls = [("r2", r2), ("p", p), ("r2_ablated", less), ("lost", r2 - less)]
    rows = rows.unionByName(df.sparkSession.createDataFrame([("controls", "ridge", -1, k, v) for k, v in controls], "part string, name string, fold int, measure string, value double"))
    if clustering:
        rows = rows.unionByName(study(clustering, main, study_permutations).select(F.lit("clustering").alias("part"), F.lit("study").alias("name"), "fold", "measure", "value"))
    return rows
