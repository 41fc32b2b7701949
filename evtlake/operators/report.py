"""All result tables of an evaluation task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evtlake.operators import distributions as dist
from evtlake.operators import evaluation as ev

BANDS = ("median", "p25", "p75", "rms")


class Tables(Mapping):
    """Result tables by name. A table is planned when it is first asked for, so that others cost nothing."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def _smoothed(profile: DataFrame) -> DataFrame:
    return dist.smooth_profile(profile, BANDS)


def classification_report(df: DataFrame, logits: Column, label: str, raw: str, num_classes: int,
                          raw_codes: Sequence[int] = range(8)) -> Tables:
    predicted = ev.predict_class(df, logits, label)
    return Tables({
        "accuracy": lambda: ev.class_accuracy(predicted, label),
        "confusion_raw": lambda: ev.confusion_raw(predicted, raw_codes, num_classes, raw),
        "confusion_mapped": lambda: ev.confusion_mapped(predicted, num_classes, label),
        "roc_curve": lambda: ev.roc_curve(predicted, "probs", label, num_classes),
        "roc_auc": lambda: ev.roc_auc(predicted, "probs", label, num_classes),
    })


def angular_report(df: DataFrame, pred: Sequence[Column], true: Sequence[Column], log_energy: str) -> Tables:
    errors = ev.angular_errors(df, pred, true)
    return Tables({
        "summary": lambda: ev.angular_summary(errors),
        "error_histogram": lambda: dist.histogram_1d(errors, "error_deg"),
        "error_density": lambda: dist.kde_1d(errors, "error_deg"),
        "error_by_energy": lambda: dist.histogram_2d_colnorm(errors, log_energy, "error_deg", (20, 50)),
        "error_profile": lambda: _smoothed(dist.binned_profile(errors, log_energy, "error_deg")),
        "zenith": lambda: dist.zenith_histograms(errors),
        "true_zenith_density": lambda: dist.kde_1d(errors, "true_cos_zenith"),
        "pred_zenith_density": lambda: dist.kde_1d(errors, "pred_cos_zenith"),
        "kappa": lambda: dist.kappa_maps(errors),
    })


def vertex_report(df: DataFrame, pred: Sequence[Column], true: Sequence[Column], raw_sigma: Column,
                  log_energy: str) -> Tables:
    errors, dropped = ev.vertex_errors(df, pred, true, raw_sigma)
    out = {
        "dropped": lambda: dropped,
        "summary": lambda: ev.vertex_summary(errors),
        "distance_histogram": lambda: dist.histogram_1d(errors, "distance", limits=(0, 1000)),
        "distance_density": lambda: dist.kde_1d(errors, "distance"),
        "distance_by_energy": lambda: dist.histogram_2d_colnorm(errors, log_energy, "distance", (20, 50), y_limits=(0, 1000)),
        "distance_profile": lambda: _smoothed(dist.binned_profile(errors, log_energy, "distance")),
        "sigma_calibration": lambda: dist.sigma_calibration(errors, "sigma", "distance", 1000.0),
    }
    for a in "xyz":
        out[f"pull_{a}"] = lambda a=a: dist.histogram_1d(errors, f"pull_{a}", density=True)
        out[f"pull_{a}_density"] = lambda a=a: dist.kde_1d(errors, f"pull_{a}")
    return Tables(out)


def energy_report(df: DataFrame, pred_log: str, true_log: str, raw_sigma: Column | None = None) -> Tables:
    errors, dropped = ev.energy_errors(df, F.col(pred_log), F.col(true_log), raw_sigma)
    ratio = F.pow(F.lit(10.0), F.col(pred_log) - F.col(true_log)) - 1
    out = {
        "dropped": lambda: dropped,
        "summary": lambda: ev.energy_summary(errors),
        "true_against_predicted": lambda: dist.histogram_2d_colnorm(errors, true_log, pred_log),
        "residual_histogram": lambda: dist.histogram_1d(errors, "residual"),
        "residual_density": lambda: dist.kde_1d(errors, "residual"),
        "resolution_by_energy": lambda: dist.histogram_2d_colnorm(errors, true_log, "residual", (20, 50), y_limits=(-1.5, 1.5)),
        "resolution_profile": lambda: _smoothed(dist.energy_resolution(errors, pred_log, true_log)),
        "fraction_by_energy": lambda: dist.histogram_2d_colnorm(
            errors.withColumn("_fe", ratio), true_log, "_fe", (20, 50), y_limits=(-2, 2)),
        "fraction_profile": lambda: _smoothed(dist.fractional_energy_error(errors, pred_log, true_log)),
    }
    if raw_sigma is not None:
        out["pull"] = lambda: dist.histogram_1d(errors, "pull", density=True)
        out["pull_density"] = lambda: dist.kde_1d(errors, "pull")
        out["sigma_calibration"] = lambda: dist.sigma_calibration(errors, "sigma", "abs_residual", 2.0)
    return Tables(out)


REPORTS = {
    "morphology_classification": classification_report,
    "angular_reco": angular_report,
    "vertex_reco": vertex_report,
    "energy_reco": energy_report,
}


def evaluate(task: str, df: DataFrame, *columns, **named) -> Tables:
    """Report of a task by name. Persist ``df`` first if predictions are costly to read."""
    if task not in REPORTS:
        raise ValueError(f"no evaluation for task {task!r}")
    return REPORTS[task](df, *columns, **named)
