"""Losses and validation metrics as aggregate columns.

Every function returns a Column for ``df.agg(...)`` or ``df.groupBy(...).agg(...)``, so one
pass with map-side partial aggregation computes any number of them, per any grouping.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evtlake.functions.expr import angle, argmax, dot, log_sum_exp, norm, softplus, unit
from evtlake.plans.quantiles import exact_quantiles


def squared_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    gaps = [p - q for p, q in zip(a, b)]
    return dot(gaps, gaps)


def gaussian_nll(pred: Sequence[Column], true: Sequence[Column], raw_sigma: Column) -> Column:
    """Isotropic Gaussian negative log likelihood in any dimension, without the constant."""
    sigma = softplus(raw_sigma)
    return F.avg(len(pred) * F.log(sigma) + squared_distance(pred, true) / (2 * sigma * sigma))


def vmf_loss(pred: Sequence[Column], true: Sequence[Column], normalise_first: bool = False,
             eps: float = 1e-8) -> Column:
    """von Mises-Fisher loss; the length of the prediction is the concentration.

    Training normalises predictions first, which fixes the concentration at 1.
    """
    p = unit(pred) if normalise_first else list(pred)
    kappa = norm(p)
    log_c = -kappa + F.log((kappa + eps) / (1 - F.exp(-2 * kappa) + 2 * eps))
    return -F.avg(dot(true, p) + log_c)


def angular_distance(pred: Sequence[Column], true: Sequence[Column], reduction: str = "mean") -> Column:
    radians = angle(pred, true)
    reductions = {"mean": F.avg, "sum": F.sum, "none": lambda c: c}
    if reduction not in reductions:
        raise ValueError(f"unknown reduction {reduction!r}")
    return reductions[reduction](radians)


def mse(pred: Sequence[Column], true: Sequence[Column]) -> Column:
    """Mean squared error, averaged over the components."""
    return F.avg(squared_distance(pred, true) / len(pred))


def cross_entropy(logits: Column, label: Column, ignore: int = -1) -> Column:
    kept = label != ignore
    return F.avg(F.when(kept, log_sum_exp(logits) - F.get(logits, label.cast("int"))))


def mae(pred: Column, true: Column) -> Column:
    return F.avg(F.abs(true - pred))


def mean_sigma(raw_sigma: Column) -> Column:
    return F.avg(softplus(raw_sigma))


def mean_distance(pred: Sequence[Column], true: Sequence[Column]) -> Column:
    return F.avg(F.sqrt(squared_distance(pred, true)))


def accuracy(logits: Column, label: Column) -> Column:
    """Share of right first maxima over rows with a class of at least 0."""
    return F.avg(F.when(label >= 0, (argmax(logits) == label).cast("double")))


def task_loss(task: str, loss: str, pred: Sequence[Column] | Column, true: Sequence[Column] | Column,
              raw_sigma: Column | None = None) -> Column:
    """Loss of a task by name; unknown names fall back as the training code does."""
    if task == "angular_reco" and loss == "vmf":
        return vmf_loss(pred, true, normalise_first=True)
    if task == "angular_reco" and loss == "angular_distance":
        return angular_distance(pred, true)
    if task == "energy_reco":
        return gaussian_nll(pred, true, raw_sigma) if loss == "gaussian_nll" else mse(pred, true)
    if task == "vertex_reco":
        return gaussian_nll(pred, true, raw_sigma) if loss == "isotropic_gaussian_nll_3d" else mse(pred, true)
    if task == "morphology_classification":
        return cross_entropy(pred, true)
    raise ValueError(f"no loss {loss!r} for task {task!r}")


def energy_validation(pred: Column, true: Column, raw_sigma: Column | None = None) -> list[Column]:
    out = [mae(pred, true).alias("mae"), mse([pred], [true]).alias("mse")]
    return out if raw_sigma is None else [*out, mean_sigma(raw_sigma).alias("mean_sigma")]


def angular_validation(df: DataFrame, pred: Sequence[Column], true: Sequence[Column],
                       keys: Sequence[str] = ()) -> DataFrame:
    """Lower median of the angular error in degrees."""
    errors = df.withColumn("_e", F.degrees(angle(pred, true)))
    return exact_quantiles(errors, "_e", {"median_angular_error_deg": 0.5}, keys, method="lower")
