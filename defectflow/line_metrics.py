"""Line-level localisation metrics; a commit's lines are ranked by score, ties by ``idx``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from defectflow.dataset import batch_tokenizer

ADD, DEL = "[ADD]", "[DEL]"


def line_tokens(lines: DataFrame, tokenizer=None, tokenize=None) -> DataFrame:
    """``commit_id, idx, changed_type, token``: a row for each token of each changed line. ``tokenizer``: column to array column, words by default; or ``tokenize``: a Python function from texts to their tokens."""
    if tokenize:
        tokens = F.get(batch_tokenizer(tokenize)(F.array(F.coalesce("changed_line", F.lit("")))), F.lit(0))
    else:
        tokens = tokenizer(F.col("changed_line")) if tokenizer else F.split(F.trim(F.col("changed_line")), r"\s+")
    out = lines.select("commit_id", "idx", "changed_type", F.explode(tokens).alias("token"))
    return out.withColumn("token", F.replace("token", F.lit("Ġ"), F.lit(""))).where("token <> ''")


def token_scores(attention: DataFrame) -> DataFrame:
    """``commit_hash, token, score``: mean over heads, highest over the places of a token between the first ``[ADD]`` and the first ``[DEL]`` (or before the last token)."""
    edges = attention.groupBy("commit_hash").agg(
        F.min(F.when(F.col("token") == ADD, F.col("pos"))).alias("start"), F.min(F.when(F.col("token") == DEL, F.col("pos"))).alias("stop"), F.max("pos").alias("last")
    )
    inside = attention.join(edges, "commit_hash").where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.coalesce("stop", "last")))
    mean = F.aggregate("scores", F.lit(0.0), lambda t, x: t + x) / F.size("scores")
    return inside.groupBy("commit_hash", "token").agg(F.max(mean).alias("score"))


def line_scores(tokens: DataFrame, scores: DataFrame, labels: DataFrame, only_added: bool = True) -> DataFrame:
    """``commit_id, idx, score, label``: the sum of the line's token scores (a token counts each time it stands there, an unknown one counts 0)."""
    kept = tokens.where("changed_type = 'added'") if only_added else tokens
    s = scores.withColumnRenamed("commit_hash", "commit_id")
    summed = kept.join(s, ["commit_id", "token"], "left").groupBy("commit_id", "idx").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("score"))
    return summed.join(labels.select("commit_id", "idx", "label"), ["commit_id", "idx"])


def minmax_scale(scores: DataFrame) -> DataFrame:
    """``scaled``: the score from 0 to 1 within its commit; 0 if all are equal."""
    w = W.partitionBy("commit_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scores.withColumn("scaled", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(0.0))


def rank_lines(scores: DataFrame) -> DataFrame:
    """``rank`` from 1, ``n`` and ``n_buggy`` of the commit, and ``buggy_rank``: how many buggy lines there are up to the line."""
    w = W.partitionBy("commit_id")
    order = w.orderBy(F.col("score").desc(), "idx")
    buggy = F.when(F.col("label") == 1, 1).otherwise(0)
    running = order.rowsBetween(W.unboundedPreceding, 0)
    return scores.withColumns({"rank": F.row_number().over(order), "n": F.count(F.lit(1)).over(w), "n_buggy": F.sum(buggy).over(w), "buggy_rank": F.sum(buggy).over(running)})


def _per_commit(ranked: DataFrame, **columns: Column) -> DataFrame:
    return ranked.groupBy("commit_id").agg(*(c.alias(k) for k, c in columns.items()))


def _buggy_within(limit: Column) -> Column:
    return F.sum(F.when((F.col("label") == 1) & (F.col("rank") <= limit), 1).otherwise(0))


def _ifa() -> Column:
    return F.coalesce(F.min(F.when(F.col("label") == 1, F.col("rank"))) - 1, F.max("n"))


def _top_k(k: int) -> Column:
    return _buggy_within(F.lit(k)) / F.least(F.lit(k), F.max("n"))


def _recall(share: float) -> Column:
    return F.coalesce(F.try_divide(_buggy_within(F.floor(F.lit(share) * F.col("n"))), F.max("n_buggy")), F.lit(0.0))


def _effort(share: float) -> Column:
    at = F.min(F.when((F.col("label") == 1) & (F.col("buggy_rank") == F.ceil(F.lit(share) * F.col("n_buggy"))), F.col("rank")))
    return F.when(F.max("n_buggy") > 0, at / F.max("n")).otherwise(F.ceil(F.lit(share) * F.max("n")).cast("double"))


def ifa(ranked: DataFrame) -> DataFrame:
    """Clean lines before the first buggy one; all lines if there is none."""
    return _per_commit(ranked, ifa=_ifa())


def top_k_accuracy(ranked: DataFrame, k: int) -> DataFrame:
    """Buggy lines among the first ``k``, over ``min(k, n)``."""
    return _per_commit(ranked, accuracy=_top_k(k))


def recall_at_loc(ranked: DataFrame, share: float = 0.2) -> DataFrame:
    """Share of the buggy lines among the first ``share`` of the lines; 0 if none is buggy."""
    return _per_commit(ranked, recall=_recall(share))


def line_effort_at_recall(ranked: DataFrame, share: float = 0.2) -> DataFrame:
    """Share of the lines to read until ``share`` of the buggy ones are found; without a buggy line the number of lines to read."""
    return _per_commit(ranked, effort=_effort(share))


def clean_commit_penalty(attention: DataFrame) -> DataFrame:
    """What a clean commit that was predicted buggy costs: its ``[ADD]`` tokens but one."""
    cost = F.sum(F.when(F.col("token") == ADD, 1).otherwise(0)) - 1
    return attention.groupBy(F.col("commit_hash").alias("commit_id")).agg(cost.alias("penalty"))


def line_report(ranked: DataFrame, preds: DataFrame, attention: DataFrame, population: str = "hit", group_cols: Sequence[str] = ()) -> DataFrame:
    """Means of the five metrics over commits that have ``[ADD]`` and are predicted buggy: truly buggy ones (``hit``), or all, clean ones by penalty (``predicted``); a row for each group of columns of ``preds``."""
    penalty = clean_commit_penalty(attention).where("penalty >= 0")
    chosen = preds.where("pred_label = 1").select(*group_cols, F.col("commit_hash").alias("commit_id"), "real_label").join(penalty, "commit_id")
    if population == "hit":
        chosen = chosen.where("real_label = 1")
    each = _per_commit(ranked, top10=_top_k(10), top5=_top_k(5), recall=_recall(0.2), effort=_effort(0.2), ifa=_ifa().cast("double"))
    clean = F.col("real_label") == 0
    joined = chosen.join(each, "commit_id", "left").where(clean | F.col("ifa").isNotNull())
    cost = F.col("penalty").cast("double")
    return joined.groupBy(*group_cols).agg(
        *(F.avg(F.when(clean, 0.0).otherwise(F.col(c))).alias(c) for c in ("top10", "top5", "recall")),
        *(F.avg(F.when(clean, cost).otherwise(F.col(c))).alias(c) for c in ("effort", "ifa")),
    )
