"""Graph derivation, assembly, splits, readers and writers on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from defectflow import dataset, graph, slicing, sources, splits

KEY = ("p", "c", "F.java")
HEAD = "project string, commit_hash string, file_path string"

#: A class with a method that holds a loop with a break, and a return.
TYPES = ["class_declaration", "method_declaration", "local_variable_declaration", "while_statement", "expression_statement", "break_statement", "return_statement"]
ROWS = [0, 1, 2, 3, 4, 5, 7]
PARENTS = [None, 0, 1, 1, 3, 3, 1]
DEFS = [["A"], ["f", "p"], ["x"], [], ["y"], [], []]
USES = [[], [], ["p"], ["x"], ["x"], [], ["x", "y"]]


@pytest.fixture()
def nodes(spark):
    data = [(*KEY, i, t, r, r, [f"line {r}\n"], d, u, p) for i, (t, r, d, u, p) in enumerate(zip(TYPES, ROWS, DEFS, USES, PARENTS, strict=True))]
    return spark.createDataFrame(data, f"{HEAD}, node_id int, node_type string, start_row int, end_row int, source_lines array<string>, def_set array<string>, use_set array<string>, parent_id int")


def pairs(edges):
    return {(r["src"], r["dst"]) for r in edges.collect()}


def statements(spark, rows):
    return spark.createDataFrame([(*KEY, *r) for r in rows], f"{HEAD}, pos int, parent_pos int, node_type string, start_row int, end_row int, of_else_if boolean")


def test_kept_statements(spark):
    rows = [(i, p, t, r, r, False) for i, (t, r, p) in enumerate(zip(TYPES, ROWS, PARENTS, strict=True))]
    assert pairs(graph.cdg_edges(graph.cdg_nodes(statements(spark, rows)))) == {(0, 1), (1, 2), (1, 3), (1, 6), (3, 4), (3, 5)}


def test_nested_ranges_try_and_else_if(spark):
    rows = [
        (0, None, "if_statement", 0, 1, False),
        (1, 0, "parenthesized_expression", 0, 0, False),  # inside its ancestor's header
        (2, 1, "expression_statement", 2, 2, False),
        (3, 0, "else", 3, 3, True),  # of an else if
        (4, 0, "try_statement", 4, 4, False),
        (5, 4, "expression_statement", 5, 5, False),  # depends on what is above try
    ]
    kept = graph.cdg_nodes(statements(spark, rows))
    assert {(r["node_id"], r["pos"], r["parent_id"]) for r in kept.collect()} == {(0, 0, None), (1, 2, 0), (2, 4, 0), (3, 5, 0)}


def test_control_flow_and_data_dependence(nodes):
    cdg = graph.cdg_edges(nodes)
    links = {r["node_id"]: (r["next_sibling"], r["first_child"]) for r in graph.sibling_links(nodes, cdg).collect()}
    assert links == {0: (None, 1), 1: (None, 2), 2: (3, None), 3: (6, 4), 4: (5, None), 5: (None, None), 6: (None, None)}
    cfg = graph.cfg_edges(nodes, cdg, graph.sibling_links(nodes, cdg))
    assert pairs(cfg) == {(0, 1), (1, 2), (2, 3), (3, 4), (3, 6), (4, 5), (5, 6), (5, 3)}
    assert pairs(graph.ddg_edges(nodes, cfg)) == {(1, 2), (2, 3), (2, 4), (2, 6), (4, 6)}


def test_else_chain(spark):
    kinds = [(0, "if_statement", "if (a)"), (1, "expression_statement", "x"), (2, "if_statement", "} else if (b)"), (3, "expression_statement", "y"), (4, "else", "} else {"), (5, "expression_statement", "z")]
    nodes = spark.createDataFrame([(*KEY, i, t, [line]) for i, t, line in kinds], f"{HEAD}, node_id int, node_type string, source_lines array<string>")
    cdg = spark.createDataFrame([(*KEY, a, b, "CDG") for a, b in [(0, 1), (0, 2), (2, 3), (2, 4), (2, 5)]], graph.EDGES)
    assert pairs(graph.else_chain_edges(nodes, cdg)) == {(0, 4), (0, 5), (4, 5)}


def chain_edges(kinds, lines, edges):
    """The rule by recursion: a chain collects its conditions; later branches depend on all of them."""
    kids = {v: {b for a, b in edges if a == v} for v in kinds}
    added = set()

    def visit(v, chain):
        reached_else = False
        for kid in sorted(kids[v]):
            condition = kinds[kid] == "if_statement" and "else" in lines[kid]
            reached_else = reached_else or kinds[kid] == "else"
            if condition or reached_else:
                for c in chain - {kid}:
                    added.add((c, kid))
                    kids[c].add(kid)
            if condition or kinds[kid] == "else":
                chain.add(kid)
            if condition:
                visit(kid, chain)

    for head in sorted(kinds):
        if kinds[head] == "if_statement" and "else" not in lines[head]:
            visit(head, {head})
    return added - set(edges)


def test_else_chains_of_random_graphs(spark):
    rng = random.Random(4)
    rows, links, want = [], [], set()
    for g in range(300):
        n = rng.randrange(2, 14)
        kinds = {i: rng.choice(["if_statement", "if_statement", "else", "expression_statement"]) for i in range(n)}
        lines = {i: ("} else if (x)" if rng.random() < 0.6 else "if (x)") if kinds[i] == "if_statement" else "x;" for i in range(n)}
        edges = {(rng.randrange(i), i) for i in range(1, n)}
        name = ("p", "c", f"{g}.java")
        rows += [(*name, i, kinds[i], [lines[i]]) for i in range(n)]
        links += [(*name, a, b, "CDG") for a, b in edges]
        want |= {(name[2], a, b) for a, b in chain_edges(kinds, lines, edges)}
    nodes = spark.createDataFrame(rows, f"{HEAD}, node_id int, node_type string, source_lines array<string>")
    got = {(r["file_path"], r["src"], r["dst"]) for r in graph.else_chain_edges(nodes, spark.createDataFrame(links, graph.EDGES)).collect()}
    assert got == want and len(want) > 100


def test_identifiers(spark):
    nodes = spark.createDataFrame([(*KEY, 0, "expression_statement"), (*KEY, 1, "for_statement"), (*KEY, 2, "return_statement")], f"{HEAD}, node_id int, node_type string")
    rows = [
        (0, "x", "identifier", "assignment", 3, "=", None), (0, "y", "identifier", "assignment", 3, None, None), (1, "i", "identifier", "declarator", 3, "=", "for"),
        (1, "n", "identifier", "binary", 3, None, ";"), (2, "T", "type_identifier", "generic_type", 2, None, None), (2, "U", "type_identifier", "other", 2, None, None),
    ]
    ids = spark.createDataFrame([(*KEY, *r) for r in rows], f"{HEAD}, node_id int, name string, token_type string, holder_type string, holder_child_count int, next_sibling_type string, header_prev_sibling_type string")
    got = {r["node_id"]: (r["def_set"], r["use_set"]) for r in graph.def_use_sets(ids, nodes).collect()}
    assert got == {0: (["x"], ["y"]), 1: (["i"], ["n"]), 2: ([], ["T"])}


def test_node_link_round_trip(spark, nodes, tmp_path):
    plain = nodes.drop("parent_id")
    edges = graph.cdg_edges(nodes)
    records = graph.to_node_link(plain, edges).select("*", F.array(F.lit("+a")).alias("add_codes"), F.array().cast("array<string>").alias("remove_codes"), F.array(F.lit(4)).alias("diff_node"), F.array().cast("array<int>").alias("buggy_nodes"), F.lit(1).alias("label"))
    sources.write_graph_records(records, str(tmp_path / "g"))
    back, links = graph.from_node_link(sources.read_graph_records(spark, str(tmp_path / "g")))
    assert {(r["node_id"], r["node_type"]) for r in back.collect()} == set(enumerate(TYPES))
    assert pairs(links) == pairs(edges)
    assert slicing.typed_edges(edges, edges).count() == edges.count()


def test_empty_graph_tables(spark, nodes):
    none, cdg = nodes.limit(0), graph.cdg_edges(nodes).limit(0)
    assert graph.ddg_edges(none, cdg).count() == 0
    assert graph.ddg_edges(nodes, cdg).count() == 0
    assert graph.sibling_links(none, cdg).count() == 0


def test_tokens_of_a_change(spark):
    change = spark.createDataFrame([("c", "fix it", ["int a = 1"], [])], "commit_hash string, msg string, added_code array<string>, removed_code array<string>")
    row = dataset.diff_tokens(change, max_len=12).first()
    assert row["tokens"] == ["[CLS]", "fix", "it", "[ADD]", "int", "a", "=", "<NUM>", "[DEL]", "[SEP]", "[PAD]", "[PAD]"]
    assert row["attention_mask"] == [1] * 10 + [0, 0]
    cut = dataset.diff_tokens(change, max_len=6).first()
    assert cut["tokens"] == ["[CLS]", "fix", "it", "[ADD]", "int", "[SEP]"]


def test_neighbour_sum(spark):
    vectors = spark.createDataFrame([("c", 0, [1.0, 2.0]), ("c", 1, [3.0, 4.0])], "commit_hash string, node_ix int, vector array<double>")
    edges = spark.createDataFrame([("c", 0, 1, 0), ("c", 0, 1, 1)], "commit_hash string, src_ix int, dst_ix int, type_code int")
    got = {r["node_ix"]: r["vector"] for r in dataset.typed_neighbor_sum(vectors, edges, {0: [1.0, 1.0], 1: [10.0, 0.0]}).collect()}
    assert got == {0: [0.0, 0.0], 1: [11.0, 2.0]}


def test_split_shares(spark):
    commits = spark.createDataFrame([(f"c{i}", "a" if i < 5 else "b") for i in range(25)], "commit_hash string, project string")
    got = {(r["split"], r["n"]) for r in splits.leave_one_project_out(commits, "a").groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {("test", 5), ("train", 16), ("valid", 4)}


def test_snippets_and_changes(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"p": {"c": {"added_buggy_level": {"F.java": {"added_buggy": ["a();", "}"]}}}}}))
    assert [tuple(r) for r in sources.read_buggy_snippets(spark, str(tmp_path / "s.json")).collect()] == [(*KEY, "a();"), (*KEY, "}")]
    schema = "ids array<string>, labels array<int>, msgs array<string>, codes array<struct<added_code:array<string>,removed_code:array<string>>>"
    changes = spark.createDataFrame([(["c", "c"], [0, 1], ["m", "n"], [(["a"], []), (["b"], [])])], schema)
    assert [tuple(r) for r in sources.zip_changes(changes).collect()] == [("c", 1, "n", ["b"], [])]


def test_tables_in_files(spark, tmp_path):
    preds = spark.createDataFrame([("c", 0.5, 0, 1)], "commit_hash string, prob double, pred_label int, real_label int")
    sources.write_predictions(preds, str(tmp_path / "p"))
    assert [tuple(r) for r in sources.read_predictions(spark, str(tmp_path / "p")).collect()] == [("c", 0.5, 0, 1)]
    (tmp_path / "train.csv").write_text("project,commit_hash,la,fix,is_buggy_commit\np,c,3,True,1.0\n")
    row = sources.read_commits(spark, {"train": str(tmp_path / "train.csv")}).first()
    assert (row["la"], row["ld"], row["split"], row["is_buggy_commit"]) == (3.0, None, "train", 1.0)
    sources.write_by_project(preds.withColumn("project", F.lit("p")), str(tmp_path / "by"))
    assert spark.read.json(str(tmp_path / "by" / "project=p")).count() == 1
    for _ in range(2):
        sources.append_report(spark.createDataFrame([(0.62941,)], "f1 double"), str(tmp_path / "r"))
    assert [r["f1"] for r in spark.read.option("header", "true").csv(str(tmp_path / "r")).collect()] == ["0.6294"] * 2
