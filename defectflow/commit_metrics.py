"""Commit-level metrics, from a threshold to effort-aware curves. All of them take optional group columns.

Ties in a curve are broken by the commit's hash. Commits without lines of code have infinite density if their numerator is positive, else none (last).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectflow.prefix import prefix_sum
from defectflow.shared import HEAVY_KEYS, look_up, materialize, release

PERCENTS = tuple(range(10, 101, 10))


def threshold(preds: DataFrame, t: float = 0.5) -> DataFrame:
    """``pred_label`` is 1 where ``prob`` exceeds ``t``."""
    return preds.withColumn("pred_label", F.when(F.col("prob") > t, 1).otherwise(0))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(preds: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Counts, precision, recall, F1, false alarm rate and distance to heaven."""
    count = lambda real, pred: F.coalesce(F.sum(F.when((F.col("real_label") == real) & (F.col("pred_label") == pred), 1).otherwise(0)), F.lit(0))
    c = preds.groupBy(*group_cols).agg(count(0, 0).alias("tn"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(1, 1).alias("tp"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    c = c.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn), "far": _ratio(fp, fp + tn)})
    return c.withColumn("d2h", F.sqrt(((1 - F.col("recall")) * (1 - F.col("recall")) + F.col("far") * F.col("far")) / 2))


def _small(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """A row for each group, computed and written now; the tables that it was made of go."""
    out = materialize(df, "metrics", free=False)
    release(*tables)
    return out


def _levels(preds: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each distinct probability: ``pos`` and ``neg``, its commits."""
    real = F.col("real_label")
    return preds.groupBy(*keys, "prob").agg(F.sum(F.when(real == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(real == 1, 0).otherwise(1)).alias("neg"))


def roc_auc(preds: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties count one half; null if only one class is there. Sorting starts from one row for each distinct probability."""
    keys = list(group_cols)
    levels = materialize(_levels(preds, keys), "levels", free=False)
    summed = prefix_sum(levels, [F.col("prob")], {"through": F.col("neg")}, keys)
    area = F.sum(F.col("pos") * (F.col("through") - F.col("neg") / 2.0))
    total = summed.groupBy(*keys).agg(area.alias("area"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return _small(total.select(*keys, F.try_divide(F.col("area"), F.col("p") * F.col("n")).alias("auc")), levels, *summed.tables)


def repeated_keys(df: DataFrame, key: str = "commit_hash") -> DataFrame:
    """The report of keys with several rows: ``key, n``. ``attach_loc`` and ``attach_truth`` need one row a commit: the first keeps the least row, the second would multiply."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def attach_loc(preds: DataFrame, features: DataFrame) -> DataFrame:
    """Predictions of commits with features, with ``loc = la + ld``; one row a commit (the smallest, if there are several; ``repeated_keys`` names them)."""
    keep = lambda df: df.groupBy("commit_hash").agg(F.min(F.struct(*(c for c in df.columns if c != "commit_hash"))).alias("r")).select("commit_hash", "r.*")
    loc = keep(features.select("commit_hash", (F.col("la") + F.col("ld")).alias("loc")))
    return keep(preds).join(loc, "commit_hash")


def _buggy() -> Column:
    return F.when(F.col("real_label") == 1, 1).otherwise(0)


def _density(value: Column) -> Column:
    return F.when(F.col("loc") > 0, value / F.col("loc")).when(value > 0, F.lit(float("inf")))


def _written(preds: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``preds`` as a written table, and what is to be released of it."""
    if hasattr(preds, "folder"):
        return preds, []
    out = materialize(preds, "predictions", free=False)
    return out, [out]


def effort_curve(preds: DataFrame, order: str = "predicted", group_cols: Sequence[str] = ()) -> DataFrame:
    """``preds`` (``commit_hash, prob, real_label, loc``) with ``cum_loc`` and ``found``, the lines inspected and buggy commits found up to each commit."""
    once, mine = _written(preds)
    ordered = once.withColumn("density", _density(F.col("prob") if order == "predicted" else F.col("real_label").cast("double")))
    first = F.col("density").asc_nulls_last() if order == "worst" else F.col("density").desc_nulls_last()
    out = prefix_sum(ordered, [first, F.col("commit_hash")], {"cum_loc": F.col("loc"), "found": _buggy()}, list(group_cols))
    release(*mine)  # the ranges have all of it
    return out


def _totals(rows: DataFrame, keys: list[str], **more: Column) -> DataFrame:
    """A written row for each group: ``total_loc, n_buggy`` and ``__n``, its rows."""
    summed = rows.groupBy(*keys).agg(F.sum("loc").alias("total_loc"), F.sum(_buggy()).alias("n_buggy"), F.count(F.lit(1)).alias("__n"), *(v.alias(k) for k, v in more.items()))
    return materialize(summed, "totals", free=False, groups=F.count(F.lit(1)), rows=F.sum("__n"))


def _with_totals(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their group's totals. Few groups go to every task; of many only the heavy ones do."""
    own = totals.select(*keys, "total_loc", "n_buggy", "__n")
    if not keys:
        return rows.crossJoin(F.broadcast(own)).drop("__n")  # one row
    if totals.totals["groups"] <= HEAVY_KEYS:
        return rows.join(F.broadcast(own), keys).drop("__n")
    return look_up(rows, own, keys, totals.totals["rows"], "__n")


def _recall(pct: float) -> Column:
    inside = F.sum(F.when((F.col("real_label") == 1) & (F.col("cum_loc") <= F.lit(pct / 100.0) * F.col("total_loc")), 1).otherwise(0))
    return F.try_divide(inside, F.max("n_buggy"))


def _effort(pct: float) -> Column:
    at = (F.col("real_label") == 1) & (F.col("found") == F.ceil(F.lit(pct / 100.0) * F.col("n_buggy")))
    return F.try_divide(F.max(F.when(at, F.floor("cum_loc"))), F.max("total_loc"))


def _of_curve(curve: DataFrame, keys: list[str], figure: Column) -> DataFrame:
    totals = _totals(curve, keys)
    return _small(_with_totals(curve, totals, keys).groupBy(*keys).agg(figure), totals)


def recall_at_effort(curve: DataFrame, pct: float = 20, group_cols: Sequence[str] = ()) -> DataFrame:
    """Share of buggy commits found within ``pct`` percent of the lines."""
    return _of_curve(curve, list(group_cols), _recall(pct).alias("recall_at_effort"))


def effort_at_recall(curve: DataFrame, pct: float = 20, group_cols: Sequence[str] = ()) -> DataFrame:
    """Share of the lines to inspect until ``pct`` percent of the buggy commits are found; ``curve`` as ``effort_curve`` gives it."""
    return _of_curve(curve, list(group_cols), _effort(pct).alias("effort_at_recall"))


ORDERS = ("predicted", "optimal", "worst")


def _figures(preds: DataFrame, keys: list[str], t: float, auc: bool) -> DataFrame:
    """A row for each group: the counts of ``confusion``, ``p_opt``, recall and effort at 20 percent, and ``auc``. One range shuffle sums all orders: the three of commits, and that of distinct probabilities."""
    once, mine = _written(preds.select(*keys, "commit_hash", "prob", "real_label", "loc"))
    real, pred = F.col("real_label"), F.when(F.col("prob") > t, 1).otherwise(0)
    count = lambda a, b: F.coalesce(F.sum(F.when((real == a) & (pred == b), 1).otherwise(0)), F.lit(0))
    totals = _totals(once, keys, tn=count(0, 0), fp=count(0, 1), fn=count(1, 0), tp=count(1, 1))
    value = {"predicted": -_density(F.col("prob")), "optimal": -_density(real.cast("double")), "worst": _density(real.cast("double"))}
    each = F.inline(F.array(*(F.struct(F.lit(o).alias("__order"), value[o].alias("__by")) for o in ORDERS)))
    rows = _with_totals(once, totals, keys).select(*keys, "commit_hash", "real_label", "loc", "total_loc", "n_buggy", each)
    if auc:
        at = _levels(once, keys).select(*keys, F.lit("auc").alias("__order"), F.col("prob").alias("__by"), F.col("neg").cast("double").alias("loc"), "pos")
        rows = rows.unionByName(at, allowMissingColumns=True)
    curves = prefix_sum(rows, [F.col("__by").asc_nulls_last(), F.col("commit_hash")], {"cum_loc": F.col("loc"), "found": _buggy()}, [*keys, "__order"])
    area = F.sum(F.col("pos") * (F.col("cum_loc") - F.col("loc") / 2.0)) if auc else F.lit(None).cast("double")
    one = curves.groupBy(*keys, "__order").agg(*(_recall(p).alias(f"r{p}") for p in PERCENTS), _effort(20).alias("effort"), area.alias("under"))
    below = sum(((F.col(f"r{a}") + F.col(f"r{b}")) * 0.05 for a, b in zip(PERCENTS[1:-1], PERCENTS[2:], strict=True)), (F.col("r10") + F.col("r20")) * 0.05)
    of = lambda order, x: F.max(F.when(F.col("__order") == order, x))
    wide = one.groupBy(*keys).agg(*(of(o, below).alias(o) for o in ORDERS), of("predicted", F.col("r20")).alias("recall_at_effort"), of("predicted", F.col("effort")).alias("effort_at_recall"), of("auc", F.col("under")).alias("under"))
    joined = wide.join(totals, keys) if keys else wide.crossJoin(F.broadcast(totals))  # one row
    popt = 1 - F.try_divide(F.col("optimal") - F.col("predicted"), F.col("optimal") - F.col("worst"))
    roc = F.try_divide(F.col("under"), F.col("n_buggy") * (F.col("__n") - F.col("n_buggy")))
    out = joined.select(*keys, "tn", "fp", "fn", "tp", "recall_at_effort", "effort_at_recall", popt.alias("p_opt"), roc.alias("auc"))
    return _small(out, totals, *mine, *curves.tables)


def p_opt(preds: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """1 - (A_optimal - A_predicted) / (A_optimal - A_worst), areas by trapezoids over recall at 10, 20, ... 100 % effort."""
    return _figures(preds, list(group_cols), 0.5, False).select(*group_cols, "p_opt")


def commit_report(preds: DataFrame, group_cols: Sequence[str] = (), t: float = 0.5) -> DataFrame:
    """F1, AUC, recall at 20 % effort, effort at 20 % recall and POpt, a row for each group. The predictions are computed once and written down."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    f1 = _ratio(2 * tp, 2 * tp + fp + fn)
    return _figures(preds, list(group_cols), t, True).select(*group_cols, f1.alias("f1"), "auc", "recall_at_effort", "effort_at_recall", "p_opt")
