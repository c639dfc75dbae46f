"""Readers and writers that are cut by size, compact splits, else chains and grouped reports."""

import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from defectflow import dataset, line_metrics, sources, splits


def flat(document):
    for project, commits in document.items():
        for commit, value in (commits or {}).items():
            for path, file in ((value or {}).get("added_buggy_level") or {}).items():
                for snippet in (file or {}).get("added_buggy") or []:
                    yield project, commit, path, snippet


def documents(seed):
    rng = random.Random(seed)
    texts = ['x = "a";', "}", "", "é \\ \n", '"added_buggy_level": {', "added_buggy_level", "long " * 30]

    def commit():
        files = {f"src/{rng.randint(0, 99)}.java": rng.choice([{"added_buggy": rng.choices(texts, k=rng.randint(0, 4))}, {"other": 1}, {"added_buggy": None}, None]) for _ in range(rng.randint(0, 3))}
        kinds = [{"added_buggy_level": files}, {"other": {"a": [1, {"b": "}"}]}, "added_buggy_level": files, "z": "{"}, {"other": "x"}, None, {"added_buggy_level": None}]
        return rng.choices(kinds, [6, 3, 1, 1, 1])[0]

    for _ in range(6):
        yield {f"p{i}": rng.choice([None, {}]) if rng.random() < 0.1 else {f"c{rng.randint(0, 10**6)}": commit() for _ in range(rng.randint(1, 20))} for i in range(rng.randint(0, 8))}


@pytest.mark.parametrize(("size", "style"), [(300, {}), (5000, {"separators": (",", ":")}), (1 << 27, {"indent": 1})])
def test_snippets_of_large_files_are_read_by_many_tasks(spark, tmp_path, size, style):
    want = []
    for i, document in enumerate(documents(size)):
        (tmp_path / f"{i}.json").write_text(json.dumps(document, **style))
        want += flat(document)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        got = sources.read_buggy_snippets(spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(want) and want
        if size == 300:
            assert spark.read.text(str(tmp_path), lineSep=sources.LEVEL).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_a_large_project_is_written_by_many_tasks_a_small_one_by_one(spark, tmp_path):
    rows = spark.range(0, 20_000, 1, 8).select(F.when(F.col("id") < 10_000, "big").otherwise(F.concat(F.lit("p"), F.col("id") % 20)).alias("project"), F.sha2(F.col("id").cast("string"), 256).alias("commit_hash"))
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.shuffle.partitions": "30"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        sources.write_by_project(rows, f"{tmp_path}/out")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    files = {p: len(glob.glob(f"{tmp_path}/out/project={p}/part*")) for p in ["big", *(f"p{i}" for i in range(20))]}
    assert files["big"] >= 3 and max(n for p, n in files.items() if p != "big") == 1
    assert spark.read.json(f"{tmp_path}/out").count() == 20_000 and os.path.isdir(f"{tmp_path}/out/project=big")


def test_a_row_of_split_bits_for_each_sample(spark):
    projects = [f"p{i}" for i in range(70)]
    samples = spark.createDataFrame([(i, None if i % 101 == 0 else f"p{i * i % 75}") for i in range(600)], "commit_hash int, project string")
    order = [(F.col("commit_hash") * 7) % 601, F.col("commit_hash")]
    bits = splits.leave_one_project_out_all(samples, projects, order).cache()
    assert bits.count() == 600 and bits.columns == ["commit_hash", "project", "train_bits"]
    for p in ("p0", "p1", "p64", "p69"):
        want = splits.leave_one_project_out(samples, p, order)
        assert sorted(map(str, splits.split_of(bits, projects, p).collect())) == sorted(map(str, want.collect()))


def test_line_report_by_group(spark):
    lines = spark.createDataFrame([(c, i, float(s), b) for c in range(4) for i, (s, b) in enumerate([(3, 0), (2, 1), (1, c % 2)])], "commit_id int, idx int, score double, label int")
    preds = spark.createDataFrame([(c, 1, 1, f"p{c % 2}") for c in range(4)], "commit_hash int, pred_label int, real_label int, test_project string")
    attention = spark.createDataFrame([(c, "[ADD]") for c in range(4) for _ in range(2)], "commit_hash int, token string")
    ranked = line_metrics.rank_lines(lines)
    got = {r["test_project"]: r["top5"] for r in line_metrics.line_report(ranked, preds, attention, group_cols=["test_project"]).collect()}
    assert got == {"p0": pytest.approx(1 / 3), "p1": pytest.approx(2 / 3)}
    assert line_metrics.line_report(ranked, preds, attention).count() == 1


def halves(texts):
    """A tokenizer of subwords: each word in two parts."""
    return [[p for w in t.split() for p in (w[: len(w) // 2 + 1], "Ġ" + w[len(w) // 2 + 1 :]) if p.strip("Ġ")] for t in texts]


def test_tokenizers_in_python(spark):
    rows = [("a", "fix it", ["int foo = 1;", ""], ["return;"]), ("b", None, None, []), ("c", "m" * 9, ["x"] * 40, None)]
    changes = spark.createDataFrame(rows, "commit_hash string, msg string, added_code array<string>, removed_code array<string>")
    got = {r["commit_hash"]: r for r in dataset.diff_tokens(changes, 16, 3, tokenize=halves).collect()}
    assert got["a"]["tokens"][:5] == ["[CLS]", "fi", "Ġx", "it", "[ADD]"] and got["a"]["tokens"][-1] == "[SEP]" and "[DEL]" in got["a"]["tokens"]
    assert got["b"]["tokens"] == ["[CLS]", "[ADD]", "[DEL]", "[SEP]"] + ["[PAD]"] * 12 and sum(got["b"]["attention_mask"]) == 4
    assert len(got["c"]["tokens"]) == 16 and got["c"]["tokens"][-1] == "[SEP]"
    lines = spark.createDataFrame([(1, 0, "added", "abcd ef"), (1, 1, "added", None)], "commit_id int, idx int, changed_type string, changed_line string")
    assert [r["token"] for r in line_metrics.line_tokens(lines, tokenize=halves).collect()] == ["abc", "d", "ef"]
