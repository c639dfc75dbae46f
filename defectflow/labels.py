"""Labels of lines, files and commits from known bug-introducing snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectflow.diffs import COMMIT, FILE
from defectflow.text import _trim

#: Fixed value: snippets that say nothing.
TRIVIAL = r"^\}\s*(?:else|catch|finally)\s*\{$"


def usable_snippets(snippets: DataFrame) -> DataFrame:
    s = snippets.select(*FILE, _trim(F.col("snippet")).alias("snippet"))
    return s.where((F.length("snippet") > 1) & ~F.col("snippet").rlike(TRIVIAL)).distinct()


def buggy_lines(added: DataFrame, snippets: DataFrame) -> DataFrame:
    """Added lines whose trimmed text equals a usable snippet of the same file. Trivial snippets go before the join, so common lines don't meet."""
    text = _trim(F.substring("code", 2, 1 << 30))
    return added.where("change_type = 'added'").withColumn("snippet", text).join(usable_snippets(snippets), [*FILE, "snippet"], "left_semi").select(*FILE, "line_no", "code")


def filter_commits(commits: DataFrame, buggy: bool = True) -> DataFrame:
    return commits.where(F.col("is_buggy_commit") == (1.0 if buggy else 0.0))


def buggy_line_index(commits: DataFrame, added: DataFrame, snippets: DataFrame) -> DataFrame:
    """``project, commit_hash, files``: a map from file to its buggy lines for each buggy commit, empty without a hit."""
    per_file = buggy_lines(added, snippets).groupBy(*FILE).agg(F.sort_array(F.collect_list("line_no")).alias("buggy_lines"))
    maps = per_file.groupBy(*COMMIT).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("file_path", "buggy_lines")))).alias("files"))
    empty = F.create_map().cast("map<string,array<int>>")
    return filter_commits(commits).select(*COMMIT).distinct().join(maps, COMMIT, "left").withColumn("files", F.coalesce("files", empty))


def file_labels(files: DataFrame, index: DataFrame) -> DataFrame:
    """``label`` 1 for files with a buggy line, whatever the commit's label."""
    hit = index.select(*COMMIT, F.explode("files").alias("file_path", "__lines")).select(*FILE, F.lit(1).alias("__hit"))
    return files.join(hit, FILE, "left").withColumn("label", F.coalesce("__hit", F.lit(0))).drop("__hit")


def attach_truth(preds: DataFrame, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predictions with ``real_label``, and the number (``unmatched``) of those without a commit. ``commits``: a row for each commit (``commit_metrics.repeated_keys`` reports others)."""
    truth = commits.select("commit_hash", F.col("is_buggy_commit").cast("double").cast("int").alias("real_label"))
    return preds.join(truth, "commit_hash"), preds.join(truth, "commit_hash", "left_anti").agg(F.count(F.lit(1)).alias("unmatched"))
