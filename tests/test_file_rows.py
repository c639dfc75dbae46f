"""Operators on a file's row against those on long tables, and how often queries on them shuffle."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from defectflow import graph, plans, slicing, sources
from defectflow.diffs import FILE

HEAD = "project string, commit_hash string, file_path string"
KINDS = ["if_statement", "else", "try_statement", "catch_clause", "while_statement", "break_statement", "continue_statement", "switch_expression", "expression_statement"]


@pytest.mark.parametrize("name", ["g5_cfg_edges", "c7_render_slice", "c9_graph_dataset", "k1_buggy_knowledge"])
def test_line_items_are_shuffled_once(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_written_records_are_shuffled_once_compressed_and_whole(spark, sf_dir, tmp_path, monkeypatch):
    written = {}

    def write(records, path, was=sources.write_graph_records):
        written.update(plan=records._jdf.queryExecution().executedPlan().toString(), path=path)
        was(records, path)

    monkeypatch.setattr(sources, "write_graph_records", write)
    n = plans.QUERIES["s3_graph_records"](spark, sf_dir).count()
    assert written["plan"].count("Exchange") == 1
    back = sources.read_graph_records(spark, written["path"])
    back.write.json(str(tmp_path / "plain"))
    size = lambda folder: sum(os.path.getsize(p) for p in glob.glob(f"{folder}/part-*"))
    assert n == back.count() == spark.read.json(str(tmp_path / "plain")).count() > 0 and size(written["path"]) < size(tmp_path / "plain") / 4


def trees(seed, files=40):
    """Statements with a parent above, and further edges of control dependence from nodes above."""
    rng = random.Random(seed)
    nodes, edges = [], set()
    for f in range(files):
        key, n = ("p", f"c{f % 5}", f"F{f}.java"), rng.randint(1, 15)
        for v in range(n):
            up = rng.randrange(v) if v and rng.random() < 0.9 else None
            nodes.append((*key, v, rng.choice(KINDS), up))
            if up is not None:
                edges.add((*key, up, v))
            if v and rng.random() < 0.2:
                edges.add((*key, rng.randrange(v), v))
    return nodes, sorted(edges)


@pytest.mark.parametrize(("seed", "files"), [(1, 256), (2, 3)])
def test_flow_in_a_row_as_by_long_tables(spark, monkeypatch, seed, files):
    monkeypatch.setattr(graph, "FILES", files)
    nodes, edges = trees(seed)
    n = spark.createDataFrame(nodes, f"{HEAD}, node_id int, node_type string, parent_id int")
    cdg = spark.createDataFrame(edges, f"{HEAD}, src int, dst int").withColumn("edge_type", F.lit("CDG"))
    want = graph.cfg_edges(n, cdg, graph.sibling_links(n, cdg)).select("file_path", "src", "dst")
    links = F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("edge_type").alias("key"))).alias("links")
    rows = n.groupBy(*FILE).agg(F.collect_list(F.struct(F.col("node_id").alias("id"), "node_type", "parent_id")).alias("nodes")).join(cdg.groupBy(*FILE).agg(links), FILE, "left")
    none = F.array().cast(graph.LINKS)
    got = rows.select("file_path", F.inline(graph.flow_links(F.col("nodes"), F.coalesce("links", none)))).select("file_path", "source", "target")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > len(nodes) / 2
    assert rows.limit(0).select(F.inline(graph.flow_links(F.col("nodes"), none))).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_slices_of_a_row_as_by_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    nodes, changed, want = [], [], set()
    for f in range(40):
        key, lines = ("p", f"c{f % 5}", f"F{f}.java"), {}
        for v in range(rng.randint(0, 8)):
            start, text = rng.randint(0, 12), [rng.choice(["\n", f"a{v}{i};\n", "+b\n", f"c{v} // d\n"]) for i in range(rng.randint(0, 3))]
            nodes.append((*key, v, start, text))
            for i, t in enumerate(text):
                lines.setdefault(start + i, t)
        lines = {r: t for r, t in sorted(lines.items()) if not t.startswith("\n")}
        rows = [rng.randint(-1, 16) for _ in range(rng.randint(0, 6))]
        changed += [(*key, rng.choice(["added", "added", "deleted"]), r + 1) for r in rows]
        added = {x[4] - 1 for x in changed if x[:3] == key and x[3] == "added"}
        for mark in ("target", "reference"):
            plus = {r for r in lines if r in added or mark == "reference" and r + 1 in lines}
            if lines:
                want.add((key[2], mark, "".join(("+" if r in plus else "") + t for r, t in lines.items()).replace("// d", "").replace("\n", "\\n")))
    n = spark.createDataFrame(nodes, f"{HEAD}, node_id int, start_row int, source_lines array<string>")
    ch = spark.createDataFrame(changed, f"{HEAD}, change_type string, line_no int")
    arrays = n.groupBy(*FILE).agg(F.collect_list(F.struct(F.col("node_id").alias("id"), "start_row", "source_lines")).alias("nodes"))
    listed = arrays.select(*FILE, F.inline(slicing.lines_of(F.col("nodes"))))
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, slicing.slice_lines(n, n).collect()))
    got = {(r["file_path"], m, r["slice"]) for m in ("target", "reference") for r in slicing.render_slice(listed, ch, m).collect()}
    assert got == want and len(want) > 40
