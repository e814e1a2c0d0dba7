"""Classification metrics, volume reports and data-set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions.groups import attach, exact_percentiles
from ..functions.lineage import cut
from .neighbors import knn_sums
from .sampling import sample_n

NAMES = {v: k for k, v in P.LABELS.items()}


def _keys(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


# ------------------------------------------------------------ classification

def confusion(preds: DataFrame) -> DataFrame:
    """Counts and row shares for every pair of seen classes; empty rows have share 0."""
    counts = preds.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    classes = counts.select(F.explode(F.array("y_true", "y_pred")).alias("c")).distinct()
    # The grid of classes is tiny: one row per pair of class ids.
    lists = classes.agg(F.collect_set("c").alias("cs"))
    grid = lists.select(F.explode("cs").alias("y_true"), "cs").select("y_true", F.explode("cs").alias("y_pred"))
    full = grid.join(counts, ["y_true", "y_pred"], "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("y_true"))
    return full.withColumn("share", F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0)))


def _class_counts(preds: DataFrame, by=()) -> DataFrame:
    """True positives, predicted and actual counts per class seen in truth or prediction.

    A column ``_n`` says that a row stands for as many predictions.
    """
    by = _keys(by)
    cells = preds.groupBy(*by, "y_true", "y_pred").agg((F.sum("_n") if "_n" in preds.columns else F.count(F.lit(1))).alias("n"))
    sides = cells.select(*by, F.explode(F.array(
        F.struct(F.col("y_true").alias("cls"), F.col("n").alias("sup"), F.lit(0).cast("long").alias("prd"),
                 F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("y_pred").alias("cls"), F.lit(0).cast("long").alias("sup"), F.col("n").alias("prd"),
                 F.lit(0).cast("long").alias("tp")),
    )).alias("s"))
    return sides.groupBy(*by, F.col("s.cls").alias("cls")).agg(
        F.sum("s.tp").alias("tp"), F.sum("s.prd").alias("n_pred"), F.sum("s.sup").alias("support")
    )


def _zero_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def class_report(preds: DataFrame, by=()) -> DataFrame:
    """Precision, recall, F1 and support per class; division by zero gives 0."""
    c = _class_counts(preds, by)
    tp, prd, sup = F.col("tp"), F.col("n_pred"), F.col("support")
    return c.select(
        *_keys(by), "cls", _zero_div(tp, prd).alias("precision"), _zero_div(tp, sup).alias("recall"),
        _zero_div(2 * tp, prd + sup).alias("f1"), "support",
    )


def macro_f1(preds: DataFrame, by=()) -> DataFrame:
    """Mean F1 over the classes seen in truth or prediction."""
    return class_report(preds, by).groupBy(*_keys(by)).agg(F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("n_classes"))


def binary_report(preds: DataFrame, cls: int = 1) -> DataFrame:
    """One class against the rest: IoU of both sides, precision, recall, F1, support."""
    t, p = F.col("y_true") == cls, F.col("y_pred") == cls
    c = preds.agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn"),
    )
    tp, fp, fn, tn = [F.col(k) for k in ("tp", "fp", "fn", "tn")]
    return c.select(
        _zero_div(tp, tp + fp + fn).alias("iou_cls"), _zero_div(tn, tn + fp + fn).alias("iou_rest"),
        _zero_div(tp, tp + fp).alias("precision"), _zero_div(tp, tp + fn).alias("recall"),
        _zero_div(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"), (tp + fp + fn + tn).alias("n"),
    )


def scene_metrics(preds: DataFrame, classes=(0, 1, 2, 3, 4)) -> DataFrame:
    """Accuracy, macro-F1, F1 per class and count per scene."""
    report = class_report(preds, "scene_id")
    f1s = report.groupBy("scene_id").agg(
        F.avg("f1").alias("macro_f1"),
        *[F.coalesce(F.max(F.when(F.col("cls") == c, F.col("f1"))), F.lit(0.0)).alias(f"f1_{NAMES[c]}") for c in classes],
    )
    acc = preds.groupBy("scene_id").agg(
        F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n")
    )
    return acc.join(f1s, "scene_id")


def fold_mean(preds: DataFrame, fold: str = "fold") -> DataFrame:
    """Mean over folds of macro-F1, and mean and population std of F1 per class."""
    per_fold = class_report(preds, fold)
    macro = per_fold.groupBy(fold).agg(F.avg("f1").alias("m")).agg(F.avg("m").alias("macro_f1"))
    classes = per_fold.groupBy("cls").agg(F.avg("f1").alias("f1_mean"), F.stddev_pop("f1").alias("f1_std"), F.sum("support").alias("support"))
    return classes.withColumn("_k", F.lit(0)).join(macro.withColumn("_k", F.lit(0)), "_k").drop("_k")


def pooled_report(preds: DataFrame) -> DataFrame:
    """Report over all out-of-fold predictions at once."""
    return class_report(preds)


def diff(preds: DataFrame) -> DataFrame:
    """Outcome per point: ``correct`` or ``wrong_<true class>``."""
    name = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    wrong = F.concat(F.lit("wrong_"), F.coalesce(F.element_at(name, F.col("y_true")), F.lit("unknown")))
    return preds.withColumn("outcome", F.when(F.col("y_true") == F.col("y_pred"), "correct").otherwise(wrong))


def diff_summary(preds: DataFrame) -> DataFrame:
    return diff(preds).groupBy("scene_id").agg(
        F.count_if(F.col("outcome") != "correct").alias("n_errors"),
        F.avg((F.col("outcome") == "correct").cast("int")).alias("accuracy"),
    )


def gate(metrics: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Acceptance: ``macro_f1``, ``f1_cargo`` and ``recall_cargo`` at the threshold, and IoU bands."""
    ok = (F.col("macro_f1") >= threshold) & (F.col("f1_cargo") >= threshold) & (F.col("recall_cargo") >= threshold)
    band = F.when(F.col("iou_cargo") >= 0.90, "collapse").when(F.col("iou_cargo") >= 0.85, "four_class").otherwise("retrain")
    return metrics.withColumns({"passed": ok, "iou_band": band})


def config_deltas(results: DataFrame, base: str, other: str, metrics: list[str]) -> DataFrame:
    """Differences between two configurations and their verdicts.

    F1 columns: gains or loses beyond 0.005 (0.002 for the macro mean); ``cv_time_s``:
    faster or slower beyond 10 s.
    """
    long = results.select("config", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics
    ])).alias("e")).select("config", "e.*")
    a = long.where(F.col("config") == base).select("metric", F.col("value").alias("base_value"))
    b = long.where(F.col("config") == other).select("metric", F.col("value").alias("other_value"))
    d = F.col("other_value") - F.col("base_value")
    tol = F.when(F.col("metric") == "f1_macro", 0.002).otherwise(0.005)
    verdict = F.when(
        F.col("metric") == "cv_time_s", F.when(d < -10, "faster").when(d > 10, "slower").otherwise("same")
    ).otherwise(F.when(d > tol, "gains").when(d < -tol, "loses").otherwise("tie"))
    return a.join(b, "metric").withColumns({"delta": d, "verdict": verdict})


# ----------------------------------------------------------------- volume reports

def volume_error_report(errors: DataFrame, rel: str = "rel") -> DataFrame:
    """Signed bias, mean, median and 90th percentile of |error| and shares per bucket."""
    rows = errors.where(F.col(rel).isNotNull()).withColumns({"_k": F.lit(0), "_abs": F.abs(rel)})
    edges = (0.0, 0.05, 0.10, 0.20, 0.50, float("inf"))
    names = ("b0_5", "b5_10", "b10_20", "b20_50", "b50_up")
    stats = rows.groupBy("_k").agg(
        F.count(F.lit(1)).alias("n"), F.avg(rel).alias("bias"), F.avg("_abs").alias("mean_abs"),
        *[F.count_if((F.col("_abs") >= lo) & (F.col("_abs") < hi)).alias(nm) for nm, lo, hi in zip(names, edges, edges[1:])],
    )
    pct = exact_percentiles(rows, "_k", "_abs", {"median_abs": 0.5, "p90_abs": 0.9})
    return stats.join(pct, "_k").drop("_k")


def ratio_stats(df: DataFrame, cols: list[str], by: str = "scenario") -> DataFrame:
    """n, mean, median, sample std, min and max per group and metric, plus a global row.

    Failed and missing values do not count.  With one value the group's std is NULL
    and the global std 0.
    """
    long = df.select(F.col(by).cast("string").alias("grp"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols
    ])).alias("e")).select("grp", "e.*").where(F.col("value").isNotNull())
    both = long.unionByName(long.withColumn("grp", F.lit("ALL")))
    stats = both.groupBy("grp", "metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.when(F.count("value") > 1, F.stddev_samp("value")).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    med = exact_percentiles(both, ["grp", "metric"], "value", {"median": 0.5})
    return stats.join(med, ["grp", "metric"]).withColumn(
        "std", F.when((F.col("grp") == "ALL") & F.col("std").isNull(), 0.0).otherwise(F.col("std"))
    )


def ratio_outliers(df: DataFrame, ratio: str = "ratio_hf", lo: float = 0.4, hi: float = 1.5) -> DataFrame:
    return df.where((F.col(ratio) < lo) | (F.col(ratio) > hi))


def ratio_counts(df: DataFrame, ratio: str = "ratio_hf", lo: float = 0.4, hi: float = 1.5) -> DataFrame:
    """Totals: captures, failures, missing references, valid ratios and outliers."""
    out = (F.col(ratio) < lo) | (F.col(ratio) > hi)
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "crash").alias("n_failed"),
        F.count_if(F.col("vol_ref").isNull()).alias("n_missing"), F.count(ratio).alias("n_valid"),
        F.count_if(out).alias("n_outliers"),
    )


def scenario_summary(df: DataFrame, ratio: str = "ratio_hf", est: str = "vol_hf", cap: float = 5.0, by: str = "scenario") -> DataFrame:
    """Chart data per scenario: box-plot quartiles of all ratios and volume means up to the cap."""
    valid = df.where(F.col(ratio).isNotNull())
    q = exact_percentiles(valid, by, ratio, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    fair = valid.where(F.col(ratio) <= cap).groupBy(by).agg(
        F.count(ratio).alias("n_fair"), F.avg("vol_ref").alias("mean_ref"), F.stddev_samp("vol_ref").alias("std_ref"),
        F.avg(est).alias("mean_est"), F.stddev_samp(est).alias("std_est"),
    )
    all_ = valid.groupBy(by).agg(F.count(ratio).alias("n"), F.count_if(F.col(ratio) > cap).alias("n_excluded"))
    return all_.join(q, by).join(fair, by, "left").withColumn("calibrated", F.col("median").between(0.5, 1.2))


# ------------------------------------------------------------------ cluster reports

def purity_report(clusters: DataFrame) -> DataFrame:
    """Purity statistics over all clusters and over those with a cargo majority."""
    scopes = clusters.withColumn("scope", F.explode(F.when(
        F.col("majority") == 1, F.array(F.lit("all"), F.lit("cargo_majority"))).otherwise(F.array(F.lit("all")))))
    stats = scopes.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n"), F.avg("purity").alias("mean"),
        F.avg((F.col("purity") < 0.6).cast("int")).alias("below_06"), F.avg((F.col("purity") < 0.8).cast("int")).alias("below_08"),
    )
    pct = exact_percentiles(scopes, "scope", "purity", {"median": 0.5, "p25": 0.25, "p10": 0.10})
    return stats.join(pct, "scope")


def class_prior(clusters: DataFrame, label: str = "y_cluster") -> DataFrame:
    counts = clusters.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


# Edges of the probability histogram.
PROBABILITY_EDGES = (0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 0.99, 1.001)


def proba_histogram(preds: DataFrame, proba: str = "p_cargo") -> DataFrame:
    p = F.col(proba)
    b = F.lit(None).cast("int")
    for i in range(len(PROBABILITY_EDGES) - 2, -1, -1):
        upper = p <= PROBABILITY_EDGES[i + 1] if i == len(PROBABILITY_EDGES) - 2 else p < PROBABILITY_EDGES[i + 1]
        b = F.when((p >= PROBABILITY_EDGES[i]) & upper, i).otherwise(b)
    return preds.withColumn("bin", b).where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def proba_by_class(preds: DataFrame, proba: str = "p_cargo", label: str = "y_true") -> DataFrame:
    stats = preds.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(proba).alias("mean"))
    return stats.join(exact_percentiles(preds, label, proba, {"p10": 0.1, "p90": 0.9}), label)


def feature_shift(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """Median, ratio of medians and z of b's median against a's mean and std; flag |z| > 2."""
    def long(d):
        return d.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols
        ])).alias("e")).select("e.*")

    la, lb = long(a), long(b)
    sa = la.groupBy("feature").agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_std"))
    ma = exact_percentiles(la, "feature", "value", {"median_a": 0.5})
    mb = exact_percentiles(lb, "feature", "value", {"median_b": 0.5})
    z = (F.col("median_b") - F.col("_mean")) / (F.col("_std") + 1e-9)
    return sa.join(ma, "feature").join(mb, "feature").select(
        "feature", "median_a", "median_b",
        F.when(F.abs("median_a") > 1e-9, F.col("median_b") / F.col("median_a")).alias("ratio"),
        z.alias("z"), (F.abs(z) > 2.0).alias("shifted"),
    )


def excluded_cluster_report(points: DataFrame, preds: DataFrame, floor: DataFrame, cls: int = 2, confidence: float = 0.75) -> DataFrame:
    """Shape of every cluster predicted as ``cls`` and whether its confidence is doubtful.

    The input is stored once.  Centres are means of decimals with 15 places, so they do not depend on the order of the rows.
    """
    from .volumes import oriented_box

    by = ["scene_id", "cluster_id"]
    wanted = preds.where(F.col("y_pred") == cls).select(*by, "max_prob")
    pts = cut(attach(points.where(F.col("cluster_id").isNotNull()).select(*by, "x", "y", "z"), wanted, by, "inner"))
    box = oriented_box(pts, by)
    mean = lambda c: F.avg(F.col(c).cast("decimal(28,15)")).cast("double")
    where = pts.groupBy(*by, "max_prob").agg(mean("x").alias("ctr_x"), mean("z").alias("ctr_z"), F.min("y").alias("_y0"))
    rows = box.join(where, by).join(floor.select("scene_id", "floor_y"), "scene_id")
    return rows.select(
        *by, "n", "max_prob", (F.col("max_prob") < confidence).alias("doubtful"), "box_long", "box_short", "box_height",
        (F.col("box_long") / F.greatest("box_short", F.lit(1e-6))).alias("aspect_ls"),
        (F.col("box_height") / F.greatest("box_long", F.lit(1e-6))).alias("aspect_hl"),
        "ctr_x", "ctr_z", (F.col("_y0") - F.col("floor_y")).alias("above_floor"),
    )


def excluded_cluster_counts(preds: DataFrame, cls: int = 2, confidence: float = 0.75) -> DataFrame:
    hit = F.col("y_pred") == cls
    return preds.groupBy("scene_id").agg(
        F.count_if(hit).alias("n_excluded"), F.count_if(hit & (F.col("max_prob") < confidence)).alias("n_doubtful")
    )


# ----------------------------------------------------------------- noise and spacing

def tail_stats(df: DataFrame, value: str, by="scene_id") -> DataFrame:
    """MAD inside +-1.5, 3 and 5 cm, sigma from the IQR and share beyond 2.5 sigma."""
    by = _keys(by)
    df = cut(df.select(*by, value))
    q = exact_percentiles(df, by, value, {"_q1": 0.25, "_q3": 0.75})
    rows = attach(df.select(*by, value), q, by).withColumn("_sigma", (F.col("_q3") - F.col("_q1")) / 1.349)
    out = rows.groupBy(*by).agg(
        F.first("_sigma").alias("sigma"), F.avg((F.abs(value) > 2.5 * F.col("_sigma")).cast("int")).alias("tail_share"),
    )
    for name, r in (("mad_15", 0.015), ("mad_30", 0.03), ("mad_50", 0.05)):
        inside = df.where(F.abs(value) <= r).select(*by, value)
        med = exact_percentiles(inside, by, value, {"_m": 0.5})
        dev = attach(inside, med, by).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
        out = out.join(exact_percentiles(dev, by, "_d", {name: 0.5}), by, "left")
    return out


def nn_spacing(df: DataFrame, n: int = 5000, uniform=None, seed: int = 0) -> DataFrame:
    """Median and mean nearest-neighbour distance inside a sample of ``n`` points per scene."""
    sample = sample_n(df, n, uniform, seed)
    near = cut(knn_sums(sample, 1, include_self=False).select("scene_id", F.sqrt("d2_last").alias("d")))
    mean = near.groupBy("scene_id").agg(F.avg("d").alias("mean_nn"), F.count(F.lit(1)).alias("n"))
    return mean.join(exact_percentiles(near, "scene_id", "d", {"median_nn": 0.5}), "scene_id")


def calibration_report(a: DataFrame, b: DataFrame, voxel: float = 0.019) -> DataFrame:
    """Compare one-row statistics of two data sets and say which settings to change.

    Each side: ``median_nn``, ``rough_floor``, ``rough_cargo`` (metres) and ``mean_points``.
    """
    k = F.lit(0).alias("_k")
    cols = ("median_nn", "rough_floor", "rough_cargo", "mean_points")
    side = lambda d, p: d.select(k, *[F.col(c).alias(f"{p}_{c}") for c in cols])
    rows = side(a, "a").join(side(b, "b"), "_k")
    ratio = F.col("b_median_nn") / F.col("a_median_nn")
    gap = lambda c: (F.col(f"b_{c}") - F.col(f"a_{c}")) * 1000.0

    def status(g):
        return F.when(F.abs(g) < 5, "ok").when(g > 0, "increase_noise").otherwise("decrease_noise")

    return rows.select(
        ratio.alias("spacing_ratio"), F.when(ratio > 1.0, ratio * voxel).otherwise(F.lit(voxel)).alias("suggested_voxel"),
        F.when(ratio > 1.5, "increase_voxel").otherwise("ok").alias("spacing_status"),
        gap("rough_floor").alias("floor_gap_mm"), status(gap("rough_floor")).alias("floor_status"),
        gap("rough_cargo").alias("cargo_gap_mm"), status(gap("rough_cargo")).alias("cargo_status"),
        (F.col("b_mean_points") / F.col("a_mean_points")).alias("count_ratio"),
    )


def dataset_stats(df: DataFrame, n: int = 5000, uniform=None, floor_cell: float = 0.05, min_cell: int = 8) -> DataFrame:
    """One row per data set (points with ``height``): pooled medians and points per scene."""
    from .grids import roughness, scene_count_stats

    # Several passes follow: they read a table instead of deriving the points again.
    df = cut(df)
    near = knn_sums(sample_n(df, n, uniform), 1, include_self=False).select(F.sqrt("d2_last").alias("d"))
    parts = [exact_percentiles(near, [], "d", {"median_nn": 0.5})]
    for name, kw in (("rough_floor", {}), ("rough_cargo", {"lo": 0.20, "hi": 1.60})):
        cells = roughness(df, cell_size=floor_cell, min_cell=min_cell, **kw)
        parts.append(exact_percentiles(cells, [], "sigma", {name: 0.5}))
    parts.append(scene_count_stats(df).select("mean_points"))
    out = parts[0].withColumn("_k", F.lit(0))
    for p in parts[1:]:
        out = out.join(p.withColumn("_k", F.lit(0)), "_k", "left")
    return out.drop("_k")
