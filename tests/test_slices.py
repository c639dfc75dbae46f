"""Slices, data dependence and records on random graphs: the grouped passes against plain walks and against the single operators."""

import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from defectflow import diffs, graph, labels, records, retrieval, slicing
from defectflow.diffs import FILE

HEAD = "project string, commit_hash string, file_path string"
TYPES = ["class_declaration", "if_statement", "expression_statement", "return_statement"]


def backward_search(rows, edges):
    before = defaultdict(list)
    for a, b in edges:
        before[b].append(a)
    defs = {v: set(d) for v, d, _ in rows}
    found = set()
    for use, _, names in rows:
        for name in set(names):
            seen, todo = {use}, [use]
            while todo:
                for p in before[todo.pop()]:
                    if p not in seen:
                        seen.add(p)
                        if name in defs.get(p, ()):
                            found.add((p, use))
                        else:
                            todo.append(p)
    return found


@pytest.mark.parametrize("bits", [3, 1 << 13])
def test_reaching_definitions_of_random_cyclic_graphs(monkeypatch, bits):
    monkeypatch.setattr(graph, "DEFINITIONS", bits)
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 14)
        some = lambda: rng.sample("abcd", rng.randint(0, 2))  # noqa: B023, E731
        rows = [(v, some(), some()) for v in range(n)]
        edges = [(rng.randint(0, n), rng.randint(0, n)) for _ in range(rng.randint(0, 2 * n))]
        assert set(graph.reaching_definitions(rows, edges)) == backward_search(rows, edges)


def test_a_file_of_many_statements_takes_seconds():
    rng, n = random.Random(5), 20_000
    rows = [(v, [f"x{rng.randint(0, 3000)}"], [f"x{rng.randint(0, 3000)}"]) for v in range(n)]
    edges = [(v, v + 1) for v in range(n - 1)] + [(v, max(0, v - rng.randint(1, 300))) for v in range(0, n, 7)] + [(v, min(n - 1, v + rng.randint(1, 50))) for v in range(0, n, 3)]
    began = time.perf_counter()
    assert len(list(graph.reaching_definitions(rows, edges))) > n
    assert time.perf_counter() - began < 20


def random_graphs(seed, files=25):
    rng = random.Random(seed)
    nodes, edges, lines = [], [], []
    for f in range(files):
        key, n, at = ("p", f"c{f % 7}", f"F{f}.java"), rng.randint(1, 12), 0
        for v in range(n):
            size = rng.randint(1, 3)
            text = [rng.choice(["\n", f"a{v}{i};\n", "+b\n", "// c\n", "x /* y */ z\n"]) for i in range(size + rng.randint(0, 1))]
            nodes.append((*key, v * 3 + 1, rng.choice(TYPES), at, at + size - 1, text))
            at += rng.randint(0, size)
        ids = [v * 3 + 1 for v in range(n)] + [500]  # 500 is no node
        edges += {(*key, rng.choice(ids), rng.choice(ids), rng.choice(["CDG", "DDG", "CFG"])) for _ in range(rng.randint(0, 25))}
        if rng.random() < 0.9:
            some = rng.sample(range(0, at + 3), rng.randint(1, min(5, at + 3)))
            lines += [(*key, rng.choice(["added", "added", "deleted"]), line, rng.choice("+-") + f" code{line % 3}") for line in some]
    return nodes, edges, lines


def frames(spark, seed):
    nodes, edges, lines = random_graphs(seed)
    return (
        spark.createDataFrame(nodes, f"{HEAD}, node_id int, node_type string, start_row int, end_row int, source_lines array<string>"),
        spark.createDataFrame(edges, f"{HEAD}, src int, dst int, edge_type string"),
        spark.createDataFrame(lines, f"{HEAD}, change_type string, line_no int, code string"),
    )


def plain_slice(nodes, edges, seeds, ddg, cdg, forward, backward):
    kind = {(n[2], n[3]): n[4] for n in nodes}

    def hop(at, name, back):
        return at | {(f, a if back else b) for _, _, f, a, b, k in edges if k == name and (f, b if back else a) in at}

    out = set()
    if forward:
        at = set(seeds)
        for _ in range(ddg):
            at = hop(at, "DDG", True)
        for _ in range(cdg):
            at = hop(at, "CDG", True)
        out |= at
    if backward:
        at = set(seeds) | hop({s for s in seeds if s in kind and "declaration" not in kind[s]}, "CDG", False)
        for _ in range(ddg):
            at = hop(at, "DDG", False)
        for _ in range(cdg):
            at = hop(at, "CDG", True)
        out |= at
    return out


@pytest.mark.parametrize(("seed", "ddg", "cdg"), [(1, 2, 1), (2, 0, 0), (3, 50, 50)])
def test_slices_as_by_plain_walks(spark, seed, ddg, cdg):
    nodes, edges, _ = random_graphs(seed)
    n, e, _ = frames(spark, seed)
    picked = [(*x[:3], x[3]) for x in nodes[::4]] + [("p", "c0", "F0.java", 500), ("p", "none", "G.java", 7)]
    seeds = spark.createDataFrame(picked + picked[:3], f"{HEAD}, node_id int")
    start = {(f, v) for _, _, f, v in picked}
    got = lambda df: sorted((r["file_path"], r["node_id"]) for r in df.collect())
    for df, ways in ((slicing.forward_slice(seeds, e, ddg, cdg), (True, False)), (slicing.backward_slice(seeds, n, e, ddg, cdg), (False, True)), (slicing.slice_nodes(seeds, n, e, ddg, cdg), (True, True))):
        assert got(df) == sorted(plain_slice(nodes, edges, start, ddg, cdg, *ways))
        assert df._jdf.queryExecution().toString().count("+- Exchange hashpartitioning") <= 2  # once in the initial plan, once in the final one
    assert got(slicing.slice_nodes(seeds.limit(0), n, e)) == [] and got(slicing.slice_nodes(seeds, n, e.limit(0), 2, 1)) == sorted(start)


def by_operators(nodes, edges, lines, index):
    """The records of ``graph_dataset``, from the operators one by one."""
    added = lines.where("change_type = 'added'")
    seeds = slicing.seed_nodes(nodes, added)
    kept = slicing.slice_nodes(seeds, nodes, edges)
    graphs = graph.to_node_link(*slicing.induced_subgraph(slicing.mark_changed_rows(nodes, added), edges, kept))
    wrong = index.select("project", "commit_hash", F.explode("files").alias("file_path", "b")).select(*FILE, F.explode("b").alias("line_no"))
    ids = lambda rows, name: rows.groupBy(*FILE).agg(F.sort_array(F.collect_set("node_id")).alias(name))
    files = labels.file_labels(diffs.changed_line_arrays(lines), index)
    for part in (graphs, ids(seeds, "diff_node"), ids(slicing.buggy_nodes(seeds, wrong), "buggy_nodes")):
        files = files.join(part, FILE, "left")
    for r in files.collect():
        full = r["relate_graph"] is not None and r["add_lines"]
        yield (r["commit_hash"], r["file_path"] if full else "", r["relate_graph"] if full else None, (r["diff_node"] or []) if full else [], (r["buggy_nodes"] or []) if full else [], r["label"] if full else 0)


@pytest.mark.parametrize("seed", [7, 8])
def test_records_as_by_the_single_operators(spark, seed):
    nodes, edges, lines = frames(spark, seed)
    files = lines.where("line_no % 2 = 0").groupBy(*FILE).agg(F.collect_list("line_no").alias("b"))
    index = files.groupBy("project", "commit_hash").agg(F.map_from_entries(F.collect_list(F.struct("file_path", "b"))).alias("files"))
    got = [(r["commit_hash"], r["file_path"], r["relate_graph"], r["diff_node"], r["buggy_nodes"], r["label"]) for r in records.graph_dataset(lines, nodes, edges, index).collect()]
    want = list(by_operators(nodes, edges, lines, index))
    assert sorted(map(str, got)) == sorted(map(str, want)) and any(r[2] for r in want)
    assert records.graph_dataset(lines.limit(0), nodes, edges, index).count() == 0
    assert {r["label"] for r in records.graph_dataset(lines, nodes.limit(0), edges.limit(0), index).collect()} == {0}


@pytest.mark.parametrize("seed", [9, 10])
def test_knowledge_as_by_the_single_operators(spark, seed):
    nodes, edges, lines = frames(spark, seed)
    buggy = lines.where("change_type = 'added' and line_no % 2 = 0").select(*FILE, "line_no", "code")
    changed = buggy.withColumn("change_type", F.lit("added"))
    kept = slicing.slice_nodes(slicing.seed_nodes(nodes, changed), nodes, edges)
    text = {r["file_path"]: r["slice"] for r in slicing.render_slice(slicing.slice_lines(nodes, kept), changed).collect()}
    got = {r["file_path"]: r["slicing"] for r in retrieval.buggy_knowledge(buggy, nodes, edges).collect()}
    assert got == {f: text.get(f, "") for f in got} and set(text) <= set(got) and any(got.values())


def scanned(block, strict):
    """Numbered lines of a block, by one scan."""
    old = new = 0
    seen = False
    for code in block.split("\n"):
        if code.startswith("@@"):
            a, b = re.search(r"-(\d+),?", code), re.search(r"\+(\d+),?", code)
            if a and b:
                old, new, seen = int(a[1]) - 1, int(b[1]) - 1, True
        elif code.startswith("+") and (not code.startswith("+++") or strict and seen):
            new += 1
            yield "added", new, code
        elif code.startswith("-") and (not code.startswith("---") or strict and seen):
            old += 1
            yield "deleted", old, code
        elif code.startswith(" "):
            old, new = old + 1, new + 1


@pytest.mark.parametrize("strict", [False, True])
def test_numbered_lines_as_by_a_scan_and_without_a_shuffle(spark, strict):
    rng = random.Random(11)
    some = ["@@ -3,2 +10,4 @@", "@@ -7 +8 @@ void f()", "@@ broken", "@@ +4 -9", "@@@ -1 -2 +30", "+a", "-b", " c", "", "+++ b/x", "--- a/x", "++i;", "+++j;", "---k;", "\\ No newline", "index 1..2", "+\r", "+x @@ -1 +1", " @@ -5 +5"]
    blocks = ["\n".join(rng.choices(some, k=rng.randint(0, 25))) for _ in range(300)]
    frame = spark.createDataFrame([("p", "c", f"F{i}", b) for i, b in enumerate(blocks)], f"{HEAD}, block string")
    lines = diffs.changed_lines(frame, strict)
    assert sorted((r["file_path"], r["change_type"], r["line_no"], r["code"]) for r in lines.collect()) == sorted((f"F{i}", *x) for i, b in enumerate(blocks) for x in scanned(b, strict))
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
