"""Batch work around model answers: pending rows, contexts, parsing, merging and scores."""

from __future__ import annotations

import bisect
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import parquet
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from defectflow.commit_metrics import confusion, roc_auc
from defectflow.shared import shared_dir
from defectflow.text import flatten_newlines, match_key, squeeze_whitespace

EVIDENCE = "evidence array<struct<diff_code:string,reason:string,severity:string,confidence:string>>"
# Fixed value: the reason of a commit without context.
NO_CONTEXT = "No valid context to analyze.(only no semantic diff)"


def pending(preds: DataFrame, pattern: str) -> DataFrame:
    """Rows without a reason yet."""
    reason = F.col(f"{pattern}_reason")
    return preds.where(reason.isNull() | (F.trim(reason) == ""))


def prompt_context(slices: DataFrame, mode: str = "all") -> DataFrame:
    """``commit_hash, context``: path and squeezed slice of each file (``file_ord, file_path, slice, has_added``), in order; ``last``: the last file only."""
    piece = F.concat(F.lit("PATH:"), F.col("file_path"), F.lit(",PROGRAM_SLICE:"), F.replace(squeeze_whitespace(F.col("slice")), F.lit("\\n"), F.lit("\n")))
    named = slices.withColumn("piece", F.when(F.col("has_added"), piece).otherwise(""))
    if mode == "last":
        return named.groupBy("commit_hash").agg(F.max_by("piece", "file_ord").alias("context"))
    listed = F.sort_array(F.collect_list(F.struct("file_ord", "piece")))
    return named.groupBy("commit_hash").agg(F.array_join(listed["piece"], "").alias("context"))


def simple_context(diffs: DataFrame) -> DataFrame:
    return diffs.select("commit_hash", F.col("diff_text").alias("context"))


def truncate_prompt(context: Column, limit: int = 30_000) -> Column:
    return F.substring(context, 1, limit)


def without_context(df: DataFrame) -> DataFrame:
    """``predicted, reason``: false and the fixed reason where there is nothing to ask about, else null."""
    empty = F.coalesce(F.trim("context"), F.lit("")) == ""
    return df.withColumns({"predicted": F.when(empty, F.lit(False)), "reason": F.when(empty, NO_CONTEXT)})


def _ask(scorer: Callable[[list[str]], list[str | None]], folder: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Asks each batch (rows in order of ``batch``) whose file isn't in ``folder`` yet, and writes that file at once; a file appears whole or not at all."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = FileSystem.from_uri(folder)
        store.create_dir(path)

        def asked(number: int, rows: list[tuple[str, str | None]]) -> int:
            name = f"{path}/{number}.parquet"
            if store.get_file_info(name).type != FileType.NotFound:
                return 0  # by an earlier attempt of this task
            error, answers = None, [None] * len(rows)
            try:
                answers = list(scorer([context for _, context in rows]))
                if len(answers) != len(rows):
                    raise ValueError(f"{len(answers)} answers for {len(rows)} contexts")
            except Exception as e:  # whatever the user's function raises
                error, answers = f"{type(e).__name__}: {e}", [None] * len(rows)
            at = time.time_ns()
            table = pa.table({"commit_hash": [k for k, _ in rows], "answer": answers, "error": [error] * len(rows), "batch": [number] * len(rows), "at": [at] * len(rows)}, LEDGER)
            part = f"{path}/.{number}-{uuid.uuid4().hex}"
            parquet.write_table(table, part, filesystem=store)
            store.move(part, name)
            return len(rows)

        now, held, n = None, [], 0
        for frame in frames:
            for number, key, context in zip(frame["batch"].tolist(), frame["commit_hash"].tolist(), frame["context"].tolist(), strict=True):
                if number != now and held:
                    n += asked(now, held)
                    held = []
                now = number
                held.append((key, context))
        if held:
            n += asked(now, held)
        yield pd.DataFrame({"n": [n]})

    return run


LEDGER = pa.schema([("commit_hash", pa.string()), ("answer", pa.string()), ("error", pa.string()), ("batch", pa.int64()), ("at", pa.int64())])


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """``commit_hash, answer, error, batch, at`` of every batch that was asked; the key as text."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    return spark.read.schema("commit_hash string, answer string, error string, batch long, at long").option("recursiveFileLookup", "true").parquet(ledger)


def score_batch(df: DataFrame, scorer: Callable[[list[str]], list[str | None]], concurrency: int = 5, batch: int = 64, ledger: str | None = None) -> DataFrame:
    """``commit_hash, answer, error``: the scorer's answers to ``context``; a failed batch has null answers and what went wrong, and is asked again in the next run.

    ``ledger`` is a folder that driver and executors share. Batches follow from the keys' hashes; each is written there by its task as soon as it is answered, so neither a retried task nor a later action or run
    asks it again: a run asks only for keys without an answer in the ledger, and what is returned is read from it. Only a task that dies between answer and file asks one batch twice.
    Of several rows with one key the least context is asked."""
    spark = df.sparkSession
    ledger = ledger or shared_dir(spark, "answers")
    known = read_ledger(spark, ledger).where("answer is not null").select("commit_hash").distinct()
    todo = df.groupBy(F.col("commit_hash").cast("string").alias("commit_hash")).agg(F.min("context").alias("context")).join(known, "commit_hash", "left_anti")
    batches = -(-todo.count() // batch)
    if batches:
        dealt = todo.withColumn("batch", F.pmod(F.xxhash64("commit_hash"), F.lit(batches)))
        sorted_ = dealt.repartition(concurrency, "batch").sortWithinPartitions("batch", "commit_hash")
        sorted_.mapInPandas(_ask(scorer, f"{ledger.rstrip('/')}/run-{uuid.uuid4().hex}"), "n long").agg(F.sum("n")).collect()
    told = read_ledger(spark, ledger).groupBy("commit_hash").agg(F.max_by("answer", F.when(F.col("answer").isNotNull(), F.col("at"))).alias("answer"), F.max_by("error", "at").alias("error"))
    mine = df.select("commit_hash").distinct().withColumn("__key", F.col("commit_hash").cast("string"))
    out = mine.join(told.withColumnRenamed("commit_hash", "__key"), "__key", "left")
    return out.select("commit_hash", "answer", F.when(F.col("answer").isNull(), F.col("error")).alias("error"))


def parse_answer(answer: Column) -> Column:
    """Struct (predicted, reason): from the first ``{`` to the last ``}``, if that is one valid JSON object."""
    start, back = F.locate("{", answer), F.locate("}", F.reverse(answer))
    stop = F.length(answer) - back + 1
    cut = F.when((start > 0) & (back > 0) & (stop > start), F.substring(answer, start, stop - start + 1))
    wrapped = F.from_json(F.concat(F.lit("["), cut, F.lit("]")), "array<struct<introduces_bug:string,evidence:string>>", {"allowSingleQuotes": "false"})
    valid = F.coalesce(F.size(wrapped) == 1, F.lit(False)) & wrapped.isNotNull()
    predicted = F.when(valid, F.coalesce(F.get(wrapped, F.lit(0))["introduces_bug"] == "yes", F.lit(False))).otherwise(F.lit(False))
    return F.struct(predicted.alias("predicted"), F.when(valid, cut).otherwise("").alias("reason"))


def merge_answers(preds: DataFrame, answers: DataFrame, pattern: str) -> DataFrame:
    """Writes ``predicted`` (1.0 or 0.0) and the flattened ``reason`` of ``answers`` where there is a result."""
    new = answers.where("predicted is not null").select("commit_hash", F.col("predicted").cast("double").alias("__p"), flatten_newlines(F.col("reason")).alias("__r"))
    p, r = f"{pattern}_predicted", f"{pattern}_reason"
    return preds.join(new, "commit_hash", "left").withColumns({p: F.coalesce("__p", p), r: F.coalesce("__r", r)}).select(*preds.columns)


def reset(preds: DataFrame, pattern: str) -> DataFrame:
    return preds.withColumns({f"{pattern}_predicted": F.lit(None).cast("double"), f"{pattern}_reason": F.lit("")})


def pattern_scores(preds: DataFrame, patterns: tuple[str, ...] = ("simple", "context")) -> DataFrame:
    """F1 and AUC of the 0/1 predictions for each pattern."""
    long = preds.select(F.col("is_buggy_commit").cast("int").alias("real_label"), F.explode(F.create_map(*(x for p in patterns for x in (F.lit(p), F.col(f"{p}_predicted"))))).alias("pattern", "prob"))
    long = long.withColumn("pred_label", F.col("prob").cast("int"))
    return confusion(long, ["pattern"]).select("pattern", "f1").join(roc_auc(long, ["pattern"]), "pattern")


def suffix_array(text: str) -> np.ndarray:
    """Starts of all suffixes in their order (by doubled prefixes)."""
    rank = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)[1].astype(np.int64)
    n, k, order = len(rank), 1, np.argsort(rank, kind="stable")
    while n and rank.max() < n - 1:
        pair = rank * (n + 1) + np.r_[rank[k:] + 1, np.zeros(min(k, n), np.int64)]
        order = np.argsort(pair, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, pair[order][1:] != pair[order][:-1]])
        k *= 2
    return order


#: Between evidence texts; no text of a table holds it.
BETWEEN = "\ud800"


def n_found(texts: list[str], parts: list[str]) -> int:
    """How many of ``parts`` (repeats included, empty ones not) stand in one of the texts: each is looked up once, by bisection of the texts' suffixes."""
    text = BETWEEN.join(texts)
    order = suffix_array(text).tolist() if parts else []

    def stands(part: str) -> bool:
        i = bisect.bisect_left(order, part, key=lambda start: text[start : start + len(part)])
        return i < len(order) and text.startswith(part, order[i])

    return sum(n for part, n in Counter(parts).items() if part and stands(part))


@F.pandas_udf(IntegerType())
def _n_found(texts: pd.Series, parts: pd.Series) -> pd.Series:
    return pd.Series([n_found([t for t in a if t is not None], [p for p in b if p is not None]) for a, b in zip(texts, parts, strict=True)], dtype="int32")


def evidence_hits(preds: DataFrame, line_labels: DataFrame, pattern: str) -> DataFrame:
    """Per commit ``match_count``, ``n`` and ``valid``: buggy lines that are part of some evidence, all buggy lines, and whether every evidence names its code."""
    evidence = F.from_json(F.col(f"{pattern}_reason"), EVIDENCE)["evidence"]
    p = preds.select("commit_hash", F.col(f"{pattern}_predicted").alias("predicted"), F.col("is_buggy_commit").alias("truth"), evidence.alias("e"))
    truth = line_labels.where("label = 1").groupBy(F.col("commit_id").alias("commit_hash")).agg(F.collect_list(match_key(F.col("raw_changed_line"))).alias("lines"))
    none = F.array().cast("array<string>")
    both = p.join(truth, "commit_hash", "left").withColumn("lines", F.coalesce("lines", none))
    both = both.withColumn("keys", F.coalesce(F.transform("e", lambda x: match_key(x["diff_code"])), none))
    valid = F.col("e").isNotNull() & F.coalesce(F.forall("e", lambda x: x["diff_code"].isNotNull()), F.lit(False))
    return both.select("commit_hash", "predicted", "truth", _n_found("keys", "lines").alias("match_count"), F.size("lines").alias("n"), valid.alias("valid"))


def acc_at_k(hits: DataFrame, k: int, only_hit: bool = False) -> DataFrame:
    """Mean over commits predicted buggy (and truly buggy, if ``only_hit``)."""
    sample = hits.where("predicted = 1")
    if only_hit:
        sample = sample.where("truth = 1")
    c = F.col
    score = F.when((c("truth") == 0) | (c("n") == 0) | ~c("valid"), 0.0).when(c("match_count") >= k, 1.0).otherwise(F.try_divide(c("match_count"), F.least(F.lit(k), c("n"))))
    return sample.agg(F.avg(score).alias(f"acc_at_{k}"))
