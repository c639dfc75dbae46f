"""The one-pass report against the single metrics, with few and with many groups; what it leaves behind."""

import os

import pytest

from defectflow import commit_metrics as cm
from defectflow import shared


def predictions(spark, groups, n=4000):
    rows = [(i, f"p{i * i % groups if groups == 40 else i % groups}", (i * 7919 % 97) / 97, int(i * 31 % 5 == 0 or i % groups == 3), float(i * 17 % 23)) for i in range(n)]
    return spark.createDataFrame(rows, "commit_hash long, project string, prob double, real_label int, loc double")


@pytest.mark.parametrize(("groups", "heavy"), [(3, 400), (40, 4), (1, 400)])
def test_report_as_by_the_single_metrics(spark, monkeypatch, groups, heavy):
    monkeypatch.setattr(cm, "HEAVY_KEYS", heavy)
    monkeypatch.setattr(shared, "HEAVY_KEYS", heavy)
    preds = predictions(spark, groups)
    for keys in (["project"], []):
        one = lambda df, keys=keys: {tuple(r[k] for k in keys): r for r in df.collect()}
        report, f1 = one(cm.commit_report(preds, keys)), one(cm.confusion(cm.threshold(preds), keys))
        curve = cm.effort_curve(preds, group_cols=keys)
        parts = {"auc": one(cm.roc_auc(preds, keys)), "p_opt": one(cm.p_opt(preds, keys)), "recall_at_effort": one(cm.recall_at_effort(curve, 20, keys)), "effort_at_recall": one(cm.effort_at_recall(curve, 20, keys)), "f1": f1}
        assert report.keys() == f1.keys() and len(report) == (groups if keys and groups < 40 else len(report))
        for name, want in parts.items():
            for k, r in report.items():
                assert r[name] == (pytest.approx(want[k][name]) if want[k][name] is not None else None), (name, k)


def test_intermediate_tables_are_released(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base))
    cm.commit_report(predictions(spark, 3), ["project"]).collect()
    assert {name.rsplit("-", 1)[0] for name in set(os.listdir(base)) - before} == {"metrics"}


def test_report_of_nothing(spark):
    none = predictions(spark, 3).limit(0)
    assert cm.commit_report(none, ["project"]).count() == 0
    (r,) = cm.commit_report(none).collect()
    assert r["auc"] is None and r["p_opt"] is None


def test_repeated_keys_are_reported(spark):
    preds = predictions(spark, 3, 10)
    assert cm.repeated_keys(preds).count() == 0
    assert [tuple(r) for r in cm.repeated_keys(preds.union(preds.where("commit_hash < 2"))).orderBy("commit_hash").collect()] == [(0, 2), (1, 2)]
