"""Splits of commits by project."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectflow.diffs import COMMIT
from defectflow.prefix import prefix_sum


def leave_one_project_out(samples: DataFrame, project: str, order: Sequence[Column] | None = None, seed: int = 42, train: float = 0.8) -> DataFrame:
    """``samples`` with ``split``: test for the project's commits; of the others, in shuffled order, the first ``train`` train, the rest valid."""
    order = order or [F.xxhash64(F.lit(seed), "commit_hash"), F.col("commit_hash")]
    mine, others = F.col("project") == project, ~F.coalesce(F.col("project") == project, F.lit(False))
    rest = samples.where(others)
    cut = int(train * rest.count())
    ranked = prefix_sum(rest, order, {"__rank": F.lit(1)})
    split = ranked.withColumn("split", F.when(F.col("__rank") <= cut, "train").otherwise("valid")).drop("__rank")
    return split.select(*samples.columns, "split").unionByName(samples.where(mine).withColumn("split", F.lit("test")))


def leave_one_project_out_all(samples: DataFrame, projects: Sequence[str], order: Sequence[Column] | None = None, seed: int = 42, train: float = 0.8) -> DataFrame:
    """``samples`` with ``train_bits``: a row for each sample, with bit i of the array of longs set where it is for training when ``projects[i]`` is the test project. ``split_of`` reads one of the splits.

    One pass ranks all samples: a row's place among the others is its place less the project's rows up to it."""
    order = order or [F.xxhash64(F.lit(seed), "commit_hash"), F.col("commit_hash")]
    mine = {p: F.coalesce(F.col("project") == p, F.lit(False)) for p in projects}
    sums = {f"__n{i}": F.when(m, 1).otherwise(0) for i, m in enumerate(mine.values())}
    ranked = prefix_sum(samples, order, {"__rank": F.lit(1), **sums})
    totals = samples.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in sums.items())).first()
    bits = [F.when(~m & (F.col("__rank") - F.col(f"__n{i}") <= int(train * (totals["n"] - totals[f"__n{i}"]))), F.shiftleft(F.lit(1).cast("long"), i % 64)).otherwise(F.lit(0)) for i, m in enumerate(mine.values())]
    words = [functools.reduce(lambda a, b: a.bitwiseOR(b), bits[i : i + 64]) for i in range(0, len(bits), 64)]
    return ranked.select(*samples.columns, F.array(*(w.cast("long") for w in words)).cast("array<long>").alias("train_bits"))


def split_of(splits: DataFrame, projects: Sequence[str], project: str) -> DataFrame:
    """``samples`` with the ``split`` that has ``project`` as its test project, from the rows of ``leave_one_project_out_all``."""
    i = list(projects).index(project)
    trains = F.get("train_bits", F.lit(i // 64)).bitwiseAND(F.shiftleft(F.lit(1).cast("long"), i % 64)) != 0
    return splits.withColumn("split", F.when(F.col("project") == project, "test").when(trains, "train").otherwise("valid")).drop("train_bits")


def project_of_commit(records: DataFrame) -> DataFrame:
    """``commit_hash, project`` of the first record (by ``ord``)."""
    return records.groupBy("commit_hash").agg(F.min_by("project", "ord").alias("project"))


def group_by_commit(records: DataFrame) -> DataFrame:
    """All file records of a commit as ``files``, by ``ord``."""
    inner = [c for c in records.columns if c not in (*COMMIT, "ord")]
    return records.groupBy(*COMMIT).agg(F.sort_array(F.collect_list(F.struct("ord", *inner))).alias("files"))
