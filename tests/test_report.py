"""Every table of every evaluation task, on the smallest predictions."""

import pytest
from pyspark.sql import functions as F

from evtlake.operators.report import Tables, evaluate
from evtlake.surrogate import reco
from evtlake.surrogate import views

SF = "/root/testdata/sf0.001"


def test_reports(spark):
    df = views.predictions(spark, SF).persist()
    n = df.count()
    angular = evaluate("angular_reco", df, *reco.direction(), "true_log_energy")
    vertex = evaluate("vertex_reco", df, *reco.vertex(), F.col("raw_sigma"), "true_log_energy")
    energy = evaluate("energy_reco", df, "pred_log_energy", "true_log_energy", F.col("raw_sigma"))
    mse = evaluate("energy_reco", df, "pred_log_energy", "true_log_energy")
    rows = {f"{t}.{k}": d.count() for t, r in (("a", angular), ("v", vertex), ("e", energy)) for k, d in r.items()}
    assert rows["a.summary"] == rows["v.summary"] == rows["e.summary"] == 1
    assert rows["a.error_by_energy"] == 1000 and rows["e.true_against_predicted"] == 2500
    assert rows["v.distance_profile"] == rows["e.fraction_profile"] == 20
    assert rows["a.error_density"] == 200 and rows["v.pull_x"] == 50
    assert "pull" in energy and "pull" not in mse
    assert energy["dropped"].first().kept == n
    assert sum(r["count"] for r in angular["error_histogram"].collect()) == n
    df.unpersist()


def test_classification_report(spark):
    df = reco.classified(spark, SF)
    out = evaluate("morphology_classification", df, F.col("logits"), "label", "morphology_raw", 2)
    total = [r for r in out["accuracy"].collect() if r.label is None][0]
    assert total.n == df.where("label >= 0").count()
    assert {r["class"] for r in out["roc_auc"].collect()} == {0, 1}
    assert out["confusion_mapped"].count() == 4 and out["confusion_raw"].count() > 0 and out["roc_curve"].count() > 2


def test_tables_are_planned_when_asked_for(spark):
    made = []
    tables = Tables({name: lambda name=name: made.append(name) or name for name in "abc"})
    assert list(tables) == ["a", "b", "c"] and len(tables) == 3 and not made
    assert (tables["b"], tables["b"]) == ("b", "b") and made == ["b"]


def test_unknown_task(spark):
    with pytest.raises(ValueError):
        evaluate("deposited_energy_reco", spark.range(1))
