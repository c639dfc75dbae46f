"""Readers and writers. Paths may be in any store that Spark reads."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from defectflow.dataset import METRICS
from defectflow.shared import materialize

COMMITS = "project string, commit_hash string, parent_hashes string, is_buggy_commit double, " + ", ".join(f"{m} string" if m == "fix" else f"{m} double" for m in METRICS)
SNIPPETS = "map<string, map<string, struct<added_buggy_level: map<string, struct<added_buggy: array<string>>>>>>"
NODE = "struct<id: int, node_type: string, start_row: int, end_row: int, source_lines: array<string>, def_set: array<string>, use_set: array<string>>"
GRAPH = f"struct<directed: boolean, multigraph: boolean, nodes: array<{NODE}>, links: array<struct<source: int, target: int, key: string>>>"
RECORDS = f"project string, commit_hash string, file_path string, add_codes array<string>, remove_codes array<string>, relate_graph {GRAPH}, diff_node array<int>, buggy_nodes array<int>, label int"
LINE_LABELS = "commit_id string, idx int, changed_type string, label int, raw_changed_line string, changed_line string"
PREDICTIONS = "commit_id string, prob double, pred int, label int"
CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def read_commits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """CSV files by split's name; columns are found by the header."""
    out = None
    for split, path in paths.items():
        raw = spark.read.options(**CSV).csv(path)
        fields = [f.strip().rsplit(" ", 1) for f in COMMITS.split(",")]
        one = raw.select(*((F.col(n).try_cast(t) if n in raw.columns else F.lit(None).cast(t)).alias(n) for n, t in fields), F.lit(split).alias("split"))
        out = one if out is None else out.unionByName(one)
    return out


#: What stands before the value of each commit. Within a JSON string its quotes would be escaped, and no string but a name is followed by a colon.
LEVEL = '"added_buggy_level":'
_PARTS = "file string, block long, at long, project string, commit_hash string, file_path string, snippets array<string>, last boolean"


def _commit_values(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From what stands between two ``LEVEL``s: the files of a commit, and the names of the next commit and, where it changes, its project.

    A split's records come in order. Names that an earlier split of the file holds are left null; each split ends with the names that hold then."""
    decode, blank = json.JSONDecoder().raw_decode, re.compile(r"[\s,:]*")
    names = [c.split()[0] for c in _PARTS.split(", ")]
    now, at, held = None, 0, [None, None]

    def after(text: str, place: int, depth: int) -> None:
        """Follows closing braces, further values and names up to the next ``LEVEL``."""
        while (place := blank.match(text, place).end()) < len(text):
            if text[place] == "}":
                depth, place = depth - 1, place + 1
            elif text[place] == "{":
                depth, place = depth + 1, place + 1
            elif depth < 3:
                held[depth - 1], place = decode(text, place)
            else:  # another name of a commit and its value
                place = decode(text, place)[1]
                place = decode(text, blank.match(text, place).end())[1]

    for frame in frames:
        out = []
        for file, block, text in zip(frame["file"], frame["block"].tolist(), frame["value"], strict=True):
            if (file, block) != now:
                if now:
                    out.append((*now, at, *held, None, None, True))
                now, at, held[:] = (file, block), 0, (None, None)
                if block == 0:
                    after(text, 0, 0)
                    continue
            files, end = decode(text, blank.match(text, 0).end())
            for path, value in (files or {}).items():
                out.append((*now, at, *held, path, (value or {}).get("added_buggy") or [], False))
            at += 1
            after(text, end, 3)
        yield pd.DataFrame(out, columns=names)
    if now:
        yield pd.DataFrame([(*now, at, *held, None, None, True)], columns=names)


def read_buggy_snippets(spark: SparkSession, path: str) -> DataFrame:
    """``project, commit_hash, file_path, snippet`` from nested JSON, one document a file.

    A file of any size is read by many tasks: Spark's text reader cuts it at ``LEVEL``, wherever its splits lie. What a split holds before its first name of a project or commit goes by the last one of the splits
    before, for which a window sees one row a split."""
    text = spark.read.text(path, lineSep=LEVEL).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    parts = materialize(text.mapInPandas(_commit_values, _PARTS), "snippets", free=False)
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ends = parts.where("last").select("file", "block", *(F.last(c, ignorenulls=True).over(before).alias(f"{c}_before") for c in ("project", "commit_hash")))
    whole = parts.where("not last").join(ends, ["file", "block"])
    named = [F.coalesce(F.col(c), F.col(f"{c}_before")).alias(c) for c in ("project", "commit_hash")]
    return whole.select(*named, "file_path", F.explode("snippets").alias("snippet"))


def read_graph_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORDS).json(path)


def write_graph_records(records: DataFrame, path: str) -> None:
    """JSON Lines, compressed (gzip), since names and types of nodes recur in each record; ``read_graph_records`` knows by the files' names. A file is read by one task: it holds what one task wrote."""
    records.write.options(ignoreNullFields="false", compression="gzip").json(path)


def zip_changes(df: DataFrame) -> DataFrame:
    """From rows of four parallel arrays to a row for each commit; of equal ids the last stays, of several at the same place of their rows the greatest."""
    zipped = df.select(F.posexplode(F.arrays_zip("ids", "labels", "msgs", "codes")).alias("at", "z"))
    last = zipped.groupBy(F.col("z.ids").alias("commit_hash")).agg(F.max(F.struct("at", "z"))["z"].alias("z"))
    return last.select("commit_hash", F.col("z.labels").alias("label"), F.col("z.msgs").alias("msg"), F.col("z.codes.added_code").alias("added_code"), F.col("z.codes.removed_code").alias("removed_code"))


def read_line_labels(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.schema(LINE_LABELS).parquet(path) if kind == "parquet" else spark.read.schema(LINE_LABELS).options(**CSV).csv(path)


def read_predictions(spark: SparkSession, path: str, schema: str = PREDICTIONS) -> DataFrame:
    """CSV with a header; columns are named and typed by place."""
    return spark.read.schema(schema).options(**CSV, enforceSchema="true").csv(path)


def write_predictions(preds: DataFrame, path: str) -> None:
    preds.write.options(**{k: v for k, v in CSV.items() if k != "multiLine"}, quoteAll="true").csv(path)


def write_by_project(records: DataFrame, path: str) -> None:
    """A folder for each project. Tasks are cut by the measured sizes of the shuffled data (``spark.sql.adaptive.advisoryPartitionSizeInBytes``): a large project is split over many, small ones share one."""
    records.hint("rebalance", F.col("project")).write.option("ignoreNullFields", "false").partitionBy("project").json(path)


def line_index_entries(index: DataFrame) -> DataFrame:
    """``key`` (project:commit) and ``files``, a map from file to the text of its lines; empty for a commit without lines."""
    text = F.concat(F.lit("["), F.array_join(F.col("buggy_lines").cast("array<string>"), ", "), F.lit("]"))
    entry = F.when(F.col("file_path").isNotNull() & (F.size("buggy_lines") > 0), F.struct("file_path", text.alias("lines")))
    grouped = index.groupBy(F.concat_ws(":", "project", "commit_hash").alias("key")).agg(F.sort_array(F.collect_list(entry)).alias("files"))
    return grouped.withColumn("files", F.map_from_entries("files"))


def write_line_index(index: DataFrame, path: str) -> None:
    """JSON Lines of the entries, sorted by key."""
    line_index_entries(index).orderBy("key").write.json(path)


def append_report(report: DataFrame, path: str) -> None:
    """Appends a row of metrics, four decimals each."""
    report.select(*(F.format_string("%.4f", F.col(n).cast("double")).alias(n) if t in ("double", "float") else F.col(n) for n, t in report.dtypes)).write.mode("append").options(header="true").csv(path)
