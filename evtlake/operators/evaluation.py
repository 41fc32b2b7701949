"""Classification results and error summaries of prediction tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evtlake.functions import codes
from evtlake.functions.expr import angle, argmax, norm, softmax, softplus
from evtlake.operators.labels import finite_only
from evtlake.operators.losses import squared_distance
from evtlake.plans import binning, ordering
from evtlake.plans.quantiles import exact_quantiles


def predict_class(df: DataFrame, logits: Column, label: str, ignore: int = -1) -> DataFrame:
    """Add ``predicted`` (first maximum) and ``probs``; rows of the ignored class leave."""
    return df.where(F.col(label) != ignore).withColumns({"predicted": argmax(logits), "probs": softmax(logits)})


def _with_row_share(cells: DataFrame, row: str) -> DataFrame:
    total = F.sum("count").over(Window.partitionBy(row))
    return cells.withColumn(
        "percent", F.when(total > 0, 100.0 * F.col("count") / total).otherwise(F.lit(0.0)))


def _named(cells: DataFrame, names: Mapping[str, Mapping[int, str]]) -> DataFrame:
    """Add ``<column>_name`` for every column of codes that has names."""
    return cells.withColumns({
        f"{column}_name": codes.lookup(dict(known), F.col(column), codes.UNKNOWN_NAME) for column, known in names.items() if known})


def confusion_raw(df: DataFrame, raw_codes: Sequence[int], num_classes: int,
                  raw: str = "morphology_raw", predicted: str = "predicted",
                  class_names: Sequence[str] = (), raw_names: Mapping[int, str] | None = None) -> DataFrame:
    """Raw code x predicted class with counts and row percent; rows without events are left out.

    Rows carry the raw code itself, so a partial mapping cannot mislabel them. With
    ``class_names`` the cells also name the class, and the raw code by ``raw_names``
    (by default the usual names of the codes).
    """
    seen = df.where(F.col(raw).isin(*raw_codes) & F.col(predicted).between(0, num_classes - 1))
    counts = seen.groupBy(raw, predicted).count()
    cells = binning.grid(df, **{predicted: num_classes}).withColumn(
        raw, F.explode(F.array(*[F.lit(c) for c in raw_codes])))
    out = _with_row_share(binning.fill_grid(counts, cells, [raw, predicted], ["count"]), raw)
    out = out.withColumn("_t", F.sum("count").over(Window.partitionBy(raw))).where(F.col("_t") > 0).drop("_t")
    if not class_names:
        return out
    return _named(out, {raw: raw_names or codes.names_by_code(), predicted: dict(enumerate(class_names))})


def confusion_mapped(df: DataFrame, num_classes: int, label: str = "label", predicted: str = "predicted",
                     class_names: Sequence[str] = ()) -> DataFrame:
    """Class x predicted class with zero cells present; ``class_names`` adds the names of both."""
    counts = df.where(
        F.col(label).between(0, num_classes - 1) & F.col(predicted).between(0, num_classes - 1)
    ).groupBy(label, predicted).count()
    cells = binning.grid(df, **{label: num_classes, predicted: num_classes})
    out = _with_row_share(binning.fill_grid(counts, cells, [label, predicted], ["count"]), label)
    known = dict(enumerate(class_names))
    return _named(out, {label: known, predicted: known})


def class_accuracy(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Accuracy and N per class, and overall in the row whose class is NULL."""
    hit = (F.col(label) == F.col(predicted)).cast("double")
    return df.rollup(label).agg(F.avg(hit).alias("accuracy"), F.count("*").alias("n"))


def _score_steps(df: DataFrame, probs: str, label: str, num_classes: int) -> tuple[DataFrame, DataFrame]:
    """Distinct scores per class with positives and negatives at and above them, and class totals.

    Scores are counted map-side first, so equal scores form one step.
    """
    scored = df.where(F.col(label).between(0, num_classes - 1)).select(
        label, F.posexplode(probs).alias("class", "threshold")).where(F.col("class") < num_classes)
    positive = F.col(label) == F.col("class")
    steps = scored.groupBy("class", "threshold").agg(
        F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    falling = F.col("threshold").desc()
    blocks = ordering.sorted_blocks(steps, [F.col("class"), falling])
    ranked = ordering.running_totals(
        blocks, {"tp": F.col("p"), "fp": F.col("q")}, ["_blk"], [falling], ["class"], inclusive=True)
    totals = blocks.groupBy("class").agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives")).where(
        F.col("positives") > 0)
    return ranked, totals


def _corners(ranked: DataFrame) -> DataFrame:
    """Steps after which the curve goes on with another step; the rest lie on a straight line.

    The step after the last one of a block is the first of the class's next block.
    """
    step = F.struct("p", "q")
    heads = ranked.groupBy("class", "_blk").agg(F.max_by(step, "threshold").alias("_head"))
    heads = heads.withColumn("_head", F.lead("_head").over(Window.partitionBy("class").orderBy("_blk")))
    falling = Window.partitionBy("class", "_blk").orderBy(F.col("threshold").desc())
    following = ordering.null_safe_join(ranked.withColumn("_next", F.lead(step).over(falling)), heads, ["class", "_blk"])
    return following.where(~F.coalesce("_next", "_head").eqNullSafe(step)).drop("_next", "_head")


def roc_curve(df: DataFrame, probs: str, label: str, num_classes: int, thin: bool = False) -> DataFrame:
    """One-vs-rest points (class, threshold, fpr, tpr), one per distinct score.

    Every class with positives also has the starting point (0, 0), without a threshold.
    ``thin`` leaves out points whose step equals the next one: the line stays the same.
    """
    ranked, totals = _score_steps(df, probs, label, num_classes)
    if thin:
        ranked = _corners(ranked)
    points = ranked.join(F.broadcast(totals), "class").select(
        "class", "threshold",
        F.try_divide(F.col("fp").cast("double"), "negatives").alias("fpr"), (F.col("tp") / F.col("positives")).alias("tpr"))
    start = totals.select(
        "class", F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def roc_auc(df: DataFrame, probs: str, label: str, num_classes: int) -> DataFrame:
    """Trapezoid area under the curve per class.

    The trapezoid of a step with q negatives is q times the mean of the positives above
    and up to it, so one sum over the steps replaces walking along the curve.
    """
    ranked, totals = _score_steps(df, probs, label, num_classes)
    area = F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2.0))
    return ranked.groupBy("class").agg(area.alias("_a")).join(F.broadcast(totals), "class").select(
        "class", F.try_divide("_a", F.col("positives").cast("double") * F.col("negatives")).alias("auc"))


# --- error summaries ------------------------------------------------------------------


def angular_errors(df: DataFrame, pred: Sequence[Column], true: Sequence[Column]) -> DataFrame:
    """Add ``error_deg``, ``kappa`` (length of the raw prediction) and ``cos_zenith`` of both sides.

    The true cosine goes through acos, so a component beyond +-1 gives NaN.
    """
    z = F.when(F.abs(true[2]) <= 1, true[2]).when(true[2].isNotNull(), F.lit(float("nan")))
    length = F.greatest(norm(pred), F.lit(1e-12))
    return df.withColumns({
        "error_deg": F.degrees(angle(pred, true)), "kappa": norm(pred),
        "true_cos_zenith": F.cos(F.acos(z)), "pred_cos_zenith": pred[2] / length,
    })


def angular_summary(errors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    stats = [
        F.avg("error_deg").alias("mean_deg"), F.stddev_pop("error_deg").alias("std_deg"),
        F.min("kappa").alias("min_kappa"), F.avg("kappa").alias("mean_kappa"), F.max("kappa").alias("max_kappa")]
    return exact_quantiles(errors, "error_deg", {"median_deg": 0.5}, keys, stats=stats)


def vertex_errors(df: DataFrame, pred: Sequence[Column], true: Sequence[Column], raw_sigma: Column) -> tuple[DataFrame, DataFrame]:
    """Add ``distance``, ``sigma`` and pulls per axis; rows with non-finite values leave.

    Returns the rows and the one-row report of kept and dropped ones.
    """
    sigma = softplus(raw_sigma)
    added = df.withColumns({
        "distance": F.sqrt(squared_distance(pred, true)), "sigma": sigma,
        **{f"pull_{a}": (t - p) / sigma for a, p, t in zip("xyz", pred, true)}})
    return finite_only(added, ["distance", "sigma", "pull_x", "pull_y", "pull_z"])


def vertex_summary(errors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    stats = [F.avg("distance").alias("mean_distance"), F.stddev_pop("distance").alias("std_distance")]
    for a in "xyz":
        stats += [F.avg(f"pull_{a}").alias(f"mean_pull_{a}"), F.stddev_pop(f"pull_{a}").alias(f"std_pull_{a}")]
    return exact_quantiles(errors, "distance", {"median_distance": 0.5}, keys, stats=stats)


def energy_errors(df: DataFrame, pred: Column, true: Column, raw_sigma: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Add ``residual``, ``abs_residual`` and, with a sigma, ``sigma`` and ``pull``; finite rows and report."""
    added = {"residual": pred - true, "abs_residual": F.abs(pred - true)}
    if raw_sigma is not None:
        sigma = softplus(raw_sigma)
        added |= {"sigma": sigma, "pull": (true - pred) / sigma}
    return finite_only(df.withColumns(added), [c for c in added if c != "abs_residual"])


def energy_summary(errors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """MAE, median absolute error, RMS and bias; with a sigma also its mean and the pull moments."""
    stats = [
        F.avg("abs_residual").alias("mae"),
        F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rms"),
        F.avg("residual").alias("bias")]
    if "pull" in errors.columns:
        stats += [F.avg("sigma").alias("mean_sigma"), F.avg("pull").alias("pull_mean"),
                  F.stddev_pop("pull").alias("pull_std")]
    return exact_quantiles(errors, "abs_residual", {"median_ae": 0.5}, keys, stats=stats)
