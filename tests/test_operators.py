"""Operators on small hand-made tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from defectflow import answers, diffs, labels, retrieval, slicing, text
from defectflow.prefix import prefix_sum
from defectflow.shared import look_up, materialize, shared_dir

KEY = ("p", "c", "F.java")


def test_changed_lines(spark):
    diff = """diff --git a/F.java b/F.java
--- a/F.java
+++ b/F.java
@@ -10,3 +10,4 @@
 x
+added
-gone
+++i;
@@ -40 +41,2 @@
+last
\\ No newline at end of file
diff --git a/r.md b/r.md
@@ -1 +1 @@
+no"""
    blocks = diffs.split_diff(spark.createDataFrame([("p", "c", diff)], "project string, commit_hash string, diff_text string"))
    got = sorted((r["change_type"], r["line_no"], r["code"]) for r in diffs.changed_lines(blocks).collect())
    assert got == [("added", 11, "+added"), ("added", 41, "+last"), ("deleted", 11, "-gone")]
    strict = sorted((r["change_type"], r["line_no"]) for r in diffs.changed_lines(blocks, strict=True).collect())
    assert ("added", 12) in strict


def test_buggy_lines(spark):
    added = spark.createDataFrame([(*KEY, "added", 3, "+  x = 1;"), (*KEY, "added", 4, "+ } else {")], "project string, commit_hash string, file_path string, change_type string, line_no int, code string")
    snippets = spark.createDataFrame([(*KEY, " x = 1; "), (*KEY, "} else {"), (*KEY, "}")], "project string, commit_hash string, file_path string, snippet string")
    assert [r["line_no"] for r in labels.buggy_lines(added, snippets).collect()] == [3]


def test_slices(spark):
    types = ["class_declaration", "method_declaration", "local_variable_declaration", "while_statement", "expression_statement", "break_statement", "return_statement"]
    rows = [0, 1, 2, 3, 4, 5, 7]
    nodes = spark.createDataFrame([(*KEY, i, t, r, r, [f"line {r}\n"]) for i, (t, r) in enumerate(zip(types, rows, strict=True))], "project string, commit_hash string, file_path string, node_id int, node_type string, start_row int, end_row int, source_lines array<string>")
    cdg = [(0, 1), (1, 2), (1, 3), (1, 6), (3, 4), (3, 5)]
    ddg = [(1, 2), (2, 3), (2, 4), (2, 6), (4, 6)]
    edges = spark.createDataFrame([(*KEY, a, b, k) for k, e in (("CDG", cdg), ("DDG", ddg)) for a, b in e], "project string, commit_hash string, file_path string, src int, dst int, edge_type string")
    changed = spark.createDataFrame([(*KEY, "added", 5, "+y")], "project string, commit_hash string, file_path string, change_type string, line_no int, code string")
    seeds = slicing.seed_nodes(nodes, changed)
    ids = lambda df: {r["node_id"] for r in df.collect()}
    assert ids(seeds) == {4}
    assert ids(slicing.forward_slice(seeds, edges)) == {0, 1, 2, 3, 4}
    assert ids(slicing.backward_slice(seeds, nodes, edges)) == {1, 3, 4, 6}
    kept = slicing.slice_nodes(seeds, nodes, edges)
    assert ids(kept) == {0, 1, 2, 3, 4, 6}
    out = slicing.render_slice(slicing.slice_lines(nodes, kept), changed).first()["slice"]
    assert out == "line 0\\nline 1\\nline 2\\nline 3\\n+line 4\\nline 7\\n"


@pytest.mark.parametrize(("answer", "predicted", "valid"), [
    ('Sure: {"introduces_bug":"yes","evidence":[{"diff_code":"+ a = b;"}]} done', True, True), ("} nothing {", False, False), ("no braces", False, False),
    ('{"introduces_bug":}', False, False), ("{'introduces_bug':'yes'}", False, False), ('{"introduces_bug":"yes"} {"x":1}', False, False), ('{"introduces_bug":"yes","evidence":"none"}', True, True),
])
def test_parse_answer(spark, answer, predicted, valid):
    r = spark.createDataFrame([(answer,)], "a string").select(answers.parse_answer(F.col("a")).alias("r")).first()["r"]
    assert r["predicted"] == predicted and (r["reason"] != "") == valid


def test_text(spark):
    one = lambda f, x: spark.createDataFrame([(x,)], "a string").select(f(F.col("a")).alias("r")).first()["r"]
    assert one(text.normalize_code, 'foo(a, "b c") { x = 12; }') == "foo a <STR> x = <NUM>"
    assert one(text.strip_comments, "a /* b\nc */ d // e\nf //www.x\n") == "a  d \\nf //www.x\\n"
    lines = F.array(*map(F.lit, ["x;\n", "// c\n", "/* open\n", "in\n", "end */\n", "y; /* cut */\n", 's = "/*";\n']))
    assert spark.range(1).select(text.blank_comment_lines(lines).alias("r")).first()["r"] == ["x;\n", "\n", "\n", "\n", "\n", "y; \n", 's = "/*";\n']


def test_prefix_sum(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = {r["id"]: r["s"] for r in prefix_sum(df, [F.col("id").desc()], {"s": F.col("v")}, buckets=5).collect()}
    total = 0
    for i in range(999, -1, -1):
        total += i % 7
        assert got[i] == total


@pytest.mark.parametrize("buckets", [1, 5, 40])
def test_prefix_sum_of_groups(spark, buckets):
    """Groups that span many ranges, one row, null groups and null values in the order."""
    rows = [(None if i % 50 == 0 else i % 3 if i < 900 else i, None if i % 11 == 0 else (i * 7) % 100, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g int, o int, i int").withColumn("v", F.col("i") % 7)
    got = {r["i"]: (r["s"], r["n"]) for r in prefix_sum(df, [F.col("o").desc_nulls_last(), F.col("i")], {"s": F.col("v"), "n": F.lit(1)}, ["g"], buckets).collect()}
    totals = {}
    for g, _, i in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2])):
        s, n = totals.get(g, (0, 0))
        totals[g] = (s + i % 7, n + 1)
        assert got[i] == totals[g]


def test_look_up_spreads_heavy_keys(spark):
    """A third of all rows have one key, which a broadcast serves; all others are joined by a shuffle; keys without a row in the table go."""
    rows = materialize(spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id"), "rows", n=F.count(F.lit(1)))
    table = materialize(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m")).where("k < 2000"), "table")
    out = look_up(rows, table, "k", rows.totals["n"])
    assert out.columns == ["k", "id", "m"]
    got = {(r["id"], r["k"], r["m"]) for r in out.collect()}
    assert got == {(i, -1, 2999 - 2999 % 3) if i % 3 == 0 else (i, i, i) for i in range(3000) if i % 3 == 0 or i < 2000}


def test_shared_dir_needs_a_setting_on_a_cluster(spark):
    class Session:
        conf, sparkContext = type("C", (), {"get": staticmethod(lambda *a: None)}), type("S", (), {"master": "spark://host"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session, "x")


def test_diff_with_repeated_paths_and_many_hunks(spark):
    text = "diff --git a/F.java b/F.java\n+old\ndiff --git a/r.md b/r.md\n+x\ndiff --git a/F.java b/F.java\n@@ -5,1 +7,2 @@\n+a\n b\n-c\n@@ foo @@\n+d\n@@ -50 +60 @@\n-e\n+f"
    frame = spark.createDataFrame([("p", "c", text), ("p", "d", ""), ("p", "e", None)], "project string, commit_hash string, diff_text string")
    got = {(r["commit_hash"], r["change_type"], r["line_no"], r["code"]) for r in diffs.changed_lines(diffs.split_diff(frame)).collect()}
    assert got == {("c", "added", 7, "+a"), ("c", "deleted", 6, "-c"), ("c", "added", 9, "+d"), ("c", "deleted", 50, "-e"), ("c", "added", 60, "+f")}


def test_knn(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(50, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in retrieval.knn(df.where("id < 5"), df, 3).collect()}
    for q in range(5):
        order = np.lexsort((np.arange(50), np.sqrt(((v[q] - v) ** 2).sum(1))))
        assert [got[q, i + 1] for i in range(3)] == order[:3].tolist()
