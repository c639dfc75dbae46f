"""Registered queries on statements, records, samples and knowledge rows, and their SQL. Graphs as in ``graph_plans``; each changed line is the first row of a statement."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from defectflow import dataset, graph, records, retrieval, slicing, splits
from defectflow.diffs import FILE
from defectflow.graph_plans import _NODES, _PLAIN, _SLICES, _cdg, _cdg_links, _cfg, _cfg_links, _files, _kept, _nodes
from defectflow.text_plans import _COMMENTS, _NORMAL


def _code(flag: Column, suppkey: Column) -> Column:
    return F.concat(F.when(flag == "R", "+").otherwise("-"), F.when(suppkey % 4 == 0, " // c").otherwise(F.concat(F.lit(" v"), suppkey)))


def _changed(n: DataFrame) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "added").when(F.col("l_returnflag") == "A", "deleted")
    return n.select(*FILE, kind.alias("change_type"), (F.col("start_row") + 1).alias("line_no"), _code(F.col("l_returnflag"), F.col("l_suppkey")).alias("code")).where("change_type is not null")


def _lines(nodes: Column, where: Callable[[Column], Column]) -> Column:
    """Changed lines of some statements of a file's row: ``line_no, code``, sorted."""
    return F.transform(F.filter(nodes, where), lambda x: F.struct((x["start_row"] + 1).alias("line_no"), _code(x["l_returnflag"], x["l_suppkey"]).alias("code")))


def _all_links(nodes: Column) -> Column:
    """All edges of a file's row, each once, sorted."""
    return F.array_sort(F.array_distinct(F.concat(_cdg_links(nodes), _cfg_links(nodes), graph.data_links(_kept(nodes, "def_set", "use_set"), _cfg_links(nodes)))))


def _parts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges in one table, to compare both."""
    own = nodes.select("file_path", F.col("node_id").cast("int").alias("src"), F.lit(-1).alias("dst"), F.col("node_type").alias("kind"))
    return own.unionByName(edges.select("file_path", "src", "dst", F.col("edge_type").alias("kind")))


def g1_def_use_sets(spark, d):
    n = _nodes(spark, d)
    kinds = ["class_declaration", "for_statement", "expression_statement", "import_declaration", "enhanced_for_statement", "field_declaration", "return_statement"]
    n = n.withColumn("node_type", F.get(F.array(*map(F.lit, kinds)), F.col("node_id") % 7))
    pk, sk = F.col("l_partkey"), F.col("l_suppkey")
    own = n.select(
        *FILE, F.explode(F.array(F.col("node_id"), F.floor(F.col("node_id") / 2).cast("int"))).alias("node_id"), F.concat(F.lit("v"), pk % 4).alias("name"),
        F.when(pk % 5 < 3, "identifier").when(pk % 5 == 3, "type_identifier").otherwise("other").alias("token_type"), F.when(sk % 4 == 0, "type_list").when(sk % 4 == 1, "generic_type").when(sk % 4 == 2, "superclass").otherwise("x").alias("holder_type"),
        (1 + pk % 3).cast("int").alias("holder_child_count"), F.when(sk % 3 == 0, "=").alias("next_sibling_type"), F.when(pk % 3 == 0, "for").when(pk % 3 == 1, "int_type").alias("header_prev_sibling_type"),
    )
    sets = graph.def_use_sets(own, n)
    return sets.select("file_path", "node_id", F.array_join("def_set", ",").alias("def_set"), F.array_join("use_set", ",").alias("use_set"))


def g2_cdg_nodes(spark, d):
    n, i = _nodes(spark, d), F.col("node_id")
    kind = F.when(F.col("node_type") == "field_declaration", "try_statement").otherwise(F.col("node_type"))
    st = n.select(*FILE, i.alias("pos"), F.when(i > 1, F.floor(i / 2).cast("int")).alias("parent_pos"), (i - F.col("l_partkey") % 3).cast("int").alias("start_row"), (i + F.col("l_suppkey") % 4).cast("int").alias("end_row"), kind.alias("node_type"), (F.col("l_suppkey") % 9 == 0).alias("of_else_if"))
    return graph.cdg_nodes(st).select("file_path", "node_id", "pos", "parent_id")


def g8_induced_subgraph(spark, d):
    n = _nodes(spark, d)
    edges = _cdg(n).unionByName(_cfg(n))
    return _parts(*slicing.induced_subgraph(n, edges, n.where("changed or node_id % 3 = 1")))


def g9_node_link(spark, d):
    n = _nodes(spark, d)
    return _parts(*graph.from_node_link(graph.to_node_link(n.select(*FILE, "node_id", "node_type", "source_lines"), _cdg(n).unionByName(_cfg(n)))))


def c1_seed_nodes(spark, d):
    n = _nodes(spark, d)
    return slicing.seed_nodes(n, _changed(n)).select("file_path", "node_id", "line_no")


def c2_buggy_nodes(spark, d):
    n = _nodes(spark, d)
    lines = _changed(n)
    return slicing.buggy_nodes(slicing.seed_nodes(n, lines), lines.where("line_no % 4 = 1")).select("file_path", "node_id")


def c6_slice_lines(spark, d):
    n = _nodes(spark, d)
    return slicing.slice_lines(n, n.where("changed")).select("file_path", "line_row", "text")


def c7_render_slice(spark, d):
    nodes = F.col("nodes")
    rows = F.transform(_lines(nodes, lambda x: x["l_returnflag"] == "R"), lambda x: x["line_no"] - 1)
    f = _files(spark, d).select("file_path", slicing.lines_of(F.filter(nodes, lambda x: x["id"] % 3 > 0)).alias("lines"), rows.alias("rows"))
    marks = [F.struct(F.lit(m).alias("mark"), slicing.render_lines(F.col("lines"), F.col("rows"), m).alias("slice")) for m in ("target", "reference")]
    return f.select("file_path", F.inline(F.when(F.size("lines") > 0, F.array(*marks))))


def c8_mark_changed_rows(spark, d):
    n = _nodes(spark, d)
    return slicing.mark_changed_rows(n, _changed(n)).select("file_path", "node_id", F.array_join("source_lines", "").alias("text"))


def c9_graph_dataset(spark, d):
    nodes = F.col("nodes")
    wrong = _lines(nodes, lambda x: x["changed"] & (x["id"] % 2 == 0))["line_no"]
    f = _files(spark, d).select(*FILE, "nodes", _lines(nodes, lambda x: x["l_returnflag"] == "R").alias("a"), _lines(nodes, lambda x: x["l_returnflag"] == "A").alias("r"), wrong.alias("b"))
    changed = f.where((F.size("a") > 0) | (F.size("r") > 0)).withColumns({"add_lines": F.col("a.line_no"), "add_codes": F.col("a.code"), "remove_codes": F.col("r.code"), "buggy_lines": F.when(F.size("b") > 0, F.col("b")), "links": _all_links(nodes)})
    r = records.file_records(changed.withColumn("nodes", _kept(nodes, "node_type", "start_row", "end_row", "source_lines", "def_set", "use_set")).drop("a", "r", "b"))
    ids = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    links = F.array_join(F.array_sort(F.transform("relate_graph.links", lambda x: F.concat_ws(" ", x["source"], x["target"], x["key"]))), ",")
    nodes = F.array_join(F.transform("relate_graph.nodes", lambda x: F.concat(x["id"], F.lit(":"), F.array_join(x["source_lines"], ""))), "")
    return r.select("commit_hash", "file_path", F.array_join("add_codes", "|").alias("add_codes"), F.array_join("remove_codes", "|").alias("remove_codes"), nodes.alias("nodes"), links.alias("links"), ids("diff_node").alias("diff_node"), ids("buggy_nodes").alias("buggy_nodes"), F.col("label"))


def k1_buggy_knowledge(spark, d):
    nodes = F.col("nodes")
    f = _files(spark, d).select(*FILE, "nodes", _lines(nodes, lambda x: x["changed"] & (x["id"] % 2 == 0)).alias("changed")).where(F.size("changed") > 0)
    return retrieval.file_knowledge(f.withColumns({"links": _all_links(nodes), "nodes": _kept(nodes, "node_type", "start_row", "end_row", "source_lines")})).select("hash", "file_path", "slicing", F.array_join("diff", "|").alias("diff"), "desc")


def k2_clean_knowledge(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    commit = F.floor(F.col("o_orderkey") / 4)
    commits = o.select(F.lit("p").alias("project"), commit.alias("commit_hash"), F.when(commit % 3 == 0, 1.0).otherwise(0.0).alias("is_buggy_commit"))
    slices = o.select(F.lit("p").alias("project"), commit.alias("commit_hash"), (F.col("o_orderkey") % 4).alias("file_ord"), F.expr("repeat('abcdefghij', cast(o_custkey % 4 * 700 as int))").alias("slice"), F.array("o_orderstatus", "o_orderpriority").alias("add_codes"))
    return retrieval.clean_knowledge(commits, slices).select("hash", F.length("slicing").alias("n"), F.array_join("diff", "|").alias("diff"), "desc")


def _letters(texts: list[str]) -> np.ndarray:
    """A small encoder: length, blanks and letters e of a text."""
    return np.array([[len(t), t.count(" "), t.count("e")] for t in texts], np.float32)


def k3_embed(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    out = retrieval.embed(docs, "text", _letters)
    return out.select("doc_id", *(F.get("embedding", F.lit(i)).cast("int").alias(c) for i, c in enumerate(("n", "blanks", "e"))))


def a3_node_marks(spark, d):
    n = _nodes(spark, d)
    marks = dataset.commit_node_marks(dataset.reindex_nodes(n), n.where("changed"), n.where("changed and node_id % 2 = 0"))
    return marks.select("commit_hash", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("diff_idx", "buggy_idx")))


def a4_join_changes(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("commit_hash"))
    li = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("commit_hash")).agg(F.count(F.lit(1)).alias("n"))
    found, missing = dataset.join_changes(o, li)
    return found.unionByName(missing.withColumn("n", F.lit(-1).cast("long")))


def a5_diff_tokens(spark, d):
    some = lambda keep: F.filter(F.split("text", "\n"), lambda _, i: (i > 0) & keep(i))
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.element_at(F.split("text", "\n"), 1).alias("msg"), some(lambda i: i % 3 != 2).alias("added_code"), some(lambda i: i % 3 == 2).alias("removed_code"))
    return dataset.diff_tokens(docs).select("doc_id", F.array_join("tokens", " ").alias("tokens"), F.aggregate("attention_mask", F.lit(0), lambda t, x: t + x).alias("n"))


def a6_token_ids(spark, d):
    b = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.split("text", " ").alias("tokens"))
    words = spark.read.parquet(f"{d}/documents.parquet").select(F.explode(F.split("text", " ")).alias("token")).where("length(token) <= 3").distinct()
    vocabulary = words.select("token", (F.length("token") * 1000 + F.ascii("token")).alias("id"))
    return dataset.token_ids(b, vocabulary, ["item_id"], unknown=-1).select("item_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def _dims(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("vector").alias("dim", "x")).withColumn("x", F.round("x", 6))


def a7_mean_pool(spark, d):
    rows = _embeddings(spark, d).select("label", "embedding", F.when((F.col("vec_id") % 3 > 0) & (F.col("label") != 3), 1).otherwise(0).alias("mask"))
    return _dims(dataset.mean_pool(rows, ["label"], 64), "label")


def a8_neighbor_sum(spark, d):
    e, ix = _embeddings(spark, d), F.floor(F.col("vec_id") / 5)
    v = e.select((F.col("vec_id") % 5).cast("int").alias("commit_hash"), ix.cast("int").alias("node_ix"), F.col("embedding").cast("array<double>").alias("vector"))
    edges = v.select("commit_hash", F.col("node_ix").alias("src_ix"), F.floor(F.col("node_ix") / 2).cast("int").alias("dst_ix"), (F.col("node_ix") % 3).alias("type_code"))
    return _dims(dataset.typed_neighbor_sum(v, edges, {t: [0.5 * (t + 1) + i / 64 for i in range(64)] for t in range(3)}), "commit_hash", "node_ix")


def a10_change_features(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    fix = F.when(F.col("o_orderstatus") == "F", "True").when(F.col("o_orderstatus") == "O", "1.0").otherwise("False")
    c = o.select(F.col("o_orderkey").alias("commit_hash"), *((fix if m == "fix" else F.col("o_custkey") % (i + 2)).alias(m) for i, m in enumerate(dataset.METRICS)))
    return dataset.change_features(c)


def p1_leave_one_out_all(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("commit_hash"), F.col("o_orderpriority").alias("project"))
    order = [(F.col("commit_hash") * 7919) % 10007, F.col("commit_hash")]
    projects = ["1-URGENT", "2-HIGH", "5-LOW"]
    all_splits = splits.leave_one_project_out_all(o, projects, order)
    one, *more = [splits.split_of(all_splits, projects, p).select("commit_hash", "project", "split", F.lit(p).alias("test_project")) for p in projects]
    return functools.reduce(DataFrame.unionByName, more, one)


def _records(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("commit_hash"), F.col("o_orderpriority").alias("project"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("file"))


def p2_project_of_commit(spark, d):
    return splits.project_of_commit(_records(spark, d))


def p3_group_by_commit(spark, d):
    return splits.group_by_commit(_records(spark, d)).select("project", "commit_hash", F.array_join(F.transform("files", lambda x: F.concat_ws(":", x["ord"], x["file"])), ",").alias("files"))


QUERIES = {
    f.__name__: f
    for f in (
        g1_def_use_sets, g2_cdg_nodes, g8_induced_subgraph, g9_node_link, c1_seed_nodes, c2_buggy_nodes, c6_slice_lines, c7_render_slice, c8_mark_changed_rows, c9_graph_dataset, k1_buggy_knowledge, k2_clean_knowledge, k3_embed,
        a3_node_marks, a4_join_changes, a5_diff_tokens, a6_token_ids, a7_mean_pool, a8_neighbor_sum, a10_change_features, p1_leave_one_out_all, p2_project_of_commit, p3_group_by_commit,
    )
}

_IX = ", ix AS (SELECT *, row_number() OVER (PARTITION BY commit_hash ORDER BY file_ord, file_path, id) - 1 AS node_ix FROM n)"
#: Rows of statements with their text, and changed lines.
_ROWS = """,
rw AS (SELECT *, CASE WHEN sk % 7 = 0 AND r % 2 = 1 THEN chr(10) ELSE 'r' || r || ' // c' || sk || chr(10) END AS text FROM (SELECT *, unnest(range(2 * id, 2 * id + pk % 2 + 1))::INT AS r FROM n)),
ch AS (SELECT *, 2 * id + 1 AS line_no, CASE WHEN flag = 'R' THEN '+' ELSE '-' END || CASE WHEN sk % 4 = 0 THEN ' // c' ELSE ' v' || sk END AS code FROM n WHERE flag IN ('R', 'A'))"""
_BOTH = "(SELECT f, src, dst, 'CDG' AS kind FROM cdg UNION ALL SELECT f, src, dst, 'CFG' FROM cfg)"
_RENDER = _COMMENTS.format("string_agg({0} || text, '' ORDER BY r)")


def _change_list(flag: str) -> str:
    return f"coalesce(string_agg(trim(substr(code, 2)), '|' ORDER BY line_no) FILTER (flag = '{flag}' AND sk % 4 <> 0), '')"


def _slices(where: str) -> str:
    """The slices around some statements: nodes (f, id)."""
    return _SLICES.replace("WHERE changed", f"WHERE {where}") + ", sl AS (SELECT f, id FROM fw UNION SELECT f, id FROM bw)"


_DIM = "SELECT {0}, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim, vec_id FROM embeddings"

ORACLE_SQL = {
    "g1_def_use_sets": f"""WITH {_PLAIN}, ids AS (SELECT file_path, unnest([id, id // 2]) AS id, 'v' || pk % 4 AS name, CASE WHEN pk % 5 < 3 THEN 'identifier' WHEN pk % 5 = 3 THEN 'type_identifier' ELSE 'other' END AS tok,
  ['type_list', 'generic_type', 'superclass', 'x'][sk % 4 + 1] AS holder, 1 + pk % 3 AS kids, sk % 3 = 0 AS assigned, CASE pk % 3 WHEN 0 THEN 'for' WHEN 1 THEN 'int_type' ELSE '' END AS head FROM n),
k AS (SELECT file_path, id, ['class_declaration', 'for_statement', 'expression_statement', 'import_declaration', 'enhanced_for_statement', 'field_declaration', 'return_statement'][id % 7 + 1] AS kind FROM n),
j AS (SELECT k.*, name, tok = 'identifier' AND holder <> 'type_list' AND (kind IN ('class_declaration', 'import_declaration') OR kind LIKE '%for_statement' AND (head = 'for' OR head LIKE '%type%') OR kind IN ('expression_statement', 'field_declaration') AND (assigned OR kids = 1)) AS def
  FROM k JOIN ids USING (file_path, id) WHERE tok = 'identifier' OR holder = 'type_list' OR tok = 'type_identifier' AND holder IN ('superclass', 'generic_type'))
SELECT k.file_path, k.id AS node_id, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (def), '') AS def_set, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (NOT def), '') AS use_set FROM k LEFT JOIN j USING (file_path, id) GROUP BY ALL""",
    "g2_cdg_nodes": f"""WITH RECURSIVE {_PLAIN},
st AS (SELECT file_path AS f, id AS pos, CASE WHEN id > 1 THEN id // 2 END AS up, id - pk % 3 AS s, id + sk % 4 AS e, kind = 'field_declaration' AS thin, sk % 9 = 0 AS flag FROM n),
r(f, pos, kept, under, above) AS (SELECT f, pos, NOT flag, CASE WHEN NOT flag THEN pos END, NULL::INT FROM st WHERE up IS NULL
  UNION ALL SELECT f, pos, kept, CASE WHEN NOT kept OR thin AND above IS NOT NULL THEN above ELSE pos END, above FROM (
    SELECT st.f, st.pos, st.thin AS thin, r.under AS above, NOT (st.flag OR coalesce(a.s <= st.s AND st.e <= a.e, false)) AS kept FROM r JOIN st ON st.f = r.f AND st.up = r.pos LEFT JOIN st a ON a.f = r.f AND a.pos = r.under)),
k AS (SELECT f, pos, above, (row_number() OVER (PARTITION BY f ORDER BY pos) - 1)::INT AS node_id FROM r WHERE kept)
SELECT k.f AS file_path, k.node_id, k.pos, a.node_id AS parent_id FROM k LEFT JOIN k a ON a.f = k.f AND a.pos = k.above""",
    "g8_induced_subgraph": f"""WITH {_PLAIN}, keep AS (SELECT file_path AS f, id FROM n WHERE changed OR id % 3 = 1)
SELECT file_path, id AS src, -1 AS dst, kind FROM n WHERE changed OR id % 3 = 1 UNION ALL SELECT f, src::INT, dst::INT, kind FROM {_BOTH} WHERE (f, src) IN (SELECT f, id FROM keep) AND (f, dst) IN (SELECT f, id FROM keep)""",
    "g9_node_link": f"WITH {_PLAIN} SELECT file_path, id AS src, -1 AS dst, kind FROM n UNION ALL SELECT f, src::INT, dst::INT, kind FROM {_BOTH}",
    "c1_seed_nodes": f"WITH {_PLAIN}{_ROWS} SELECT DISTINCT rw.file_path, rw.id AS node_id, line_no FROM rw JOIN ch ON ch.file_path = rw.file_path AND line_no - 1 = r",
    "c2_buggy_nodes": f"WITH {_PLAIN}{_ROWS} SELECT DISTINCT file_path, id AS node_id FROM ch WHERE line_no % 4 = 1",
    "c6_slice_lines": f"WITH {_PLAIN}{_ROWS} SELECT file_path, r AS line_row, text FROM rw WHERE changed AND text <> chr(10)",
    "c7_render_slice": f"""WITH {_PLAIN}{_ROWS}, t AS (SELECT rw.file_path, r, text, EXISTS (FROM ch WHERE ch.file_path = rw.file_path AND line_no - 1 = r AND ch.flag = 'R') AS target,
  lead(r) OVER (PARTITION BY rw.file_path ORDER BY r) = r + 1 AS joins FROM rw WHERE id % 3 > 0 AND text <> chr(10))
SELECT file_path, 'target' AS mark, {_RENDER.format("CASE WHEN target THEN '+' ELSE '' END")} AS slice FROM t GROUP BY file_path
UNION ALL SELECT file_path, 'reference', {_RENDER.format("CASE WHEN target OR coalesce(joins, false) THEN '+' ELSE '' END")} FROM t GROUP BY file_path""",
    "c8_mark_changed_rows": f"WITH {_PLAIN}{_ROWS} SELECT file_path, id AS node_id, string_agg(CASE WHEN changed AND r = 2 * id THEN '+' ELSE '' END || text, '' ORDER BY r) AS text FROM rw GROUP BY ALL",
    "c9_graph_dataset": f"""WITH RECURSIVE {_NODES}{_slices("changed")}{_ROWS},
fl AS (SELECT commit_hash, file_path AS f, {_change_list("R")} AS add_codes, {_change_list("A")} AS remove_codes, sum((flag = 'R')::INT) > 0 AS any_added,
  coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (flag = 'R'), '') AS diff_node, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (flag = 'R' AND id % 2 = 0), '') AS buggy_nodes FROM ch GROUP BY ALL),
tx AS (SELECT f, string_agg(t, '' ORDER BY id) AS nodes FROM (SELECT file_path AS f, id, id || ':' || string_agg(CASE WHEN changed AND r = 2 * id THEN '+' ELSE '' END || text, '' ORDER BY r) AS t FROM rw GROUP BY file_path, id) JOIN sl USING (f, id) GROUP BY f),
ed AS (SELECT f, src, dst, 'CDG' AS kind FROM cdg UNION SELECT f, src, dst, 'CFG' FROM cfg UNION SELECT f, src, dst, 'DDG' FROM ddg),
lk AS (SELECT f, string_agg(e, ',' ORDER BY e) AS links FROM (SELECT ed.f, src || ' ' || dst || ' ' || kind AS e FROM ed JOIN sl a ON a.f = ed.f AND a.id = src JOIN sl b ON b.f = ed.f AND b.id = dst) GROUP BY f)
SELECT commit_hash, CASE WHEN any_added THEN f ELSE '' END AS file_path, add_codes, remove_codes, CASE WHEN any_added THEN nodes END AS nodes, CASE WHEN any_added THEN coalesce(links, '') END AS links,
  diff_node, CASE WHEN any_added THEN buggy_nodes ELSE '' END AS buggy_nodes, (any_added AND buggy_nodes <> '')::INT AS label FROM fl LEFT JOIN tx USING (f) LEFT JOIN lk USING (f)""",
    "k1_buggy_knowledge": f"""WITH RECURSIVE {_NODES}{_slices("changed AND id % 2 = 0")}{_ROWS},
t AS (SELECT file_path AS f, {_RENDER.format("CASE WHEN changed AND rw.id % 2 = 0 AND r = 2 * rw.id THEN '+' ELSE '' END")} AS slicing FROM rw JOIN sl ON sl.f = file_path AND sl.id = rw.id WHERE text <> chr(10) GROUP BY file_path),
df AS (SELECT commit_hash, file_path, code, min(line_no) AS pl FROM ch WHERE changed AND id % 2 = 0 GROUP BY ALL)
SELECT commit_hash AS hash, file_path, coalesce(max(slicing), '') AS slicing, string_agg(code, '|' ORDER BY pl) AS diff, '' AS desc FROM df LEFT JOIN t ON f = file_path GROUP BY commit_hash, file_path""",
    "k2_clean_knowledge": """WITH f AS (SELECT o_orderkey // 4 AS hash, arg_min(o_custkey, o_orderkey % 4) AS c, arg_min(o_orderstatus || '|' || o_orderpriority, o_orderkey % 4) AS diff FROM orders GROUP BY 1)
SELECT hash, (c % 4 * 7000)::INT AS n, diff, 'This commit does not introduce any bugs or issues.' AS desc FROM f WHERE hash % 3 > 0 AND c % 4 IN (1, 2)""",
    "k3_embed": r"""SELECT doc_id, length(t)::INT AS n, (length(t) - length(replace(t, ' ', '')))::INT AS blanks, (length(t) - length(replace(t, 'e', '')))::INT AS e
FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS t FROM documents)""",
    "a3_node_marks": f"""WITH {_PLAIN}{_IX} SELECT commit_hash, coalesce(string_agg(node_ix::VARCHAR, ',' ORDER BY node_ix) FILTER (changed), '') AS diff_idx,
  coalesce(string_agg(node_ix::VARCHAR, ',' ORDER BY node_ix) FILTER (changed AND id % 2 = 0), '') AS buggy_idx FROM ix GROUP BY commit_hash""",
    "a4_join_changes": "SELECT o_orderkey AS commit_hash, coalesce(n, -1) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
    "a5_diff_tokens": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
m AS (SELECT doc_id, i, {_NORMAL.format("line")} AS t FROM l),
j AS (SELECT doc_id, max(t) FILTER (i = 0) AS msg, coalesce(string_agg(t, ' [ADD] ' ORDER BY i) FILTER (i > 0 AND i % 3 <> 2), '') AS a, coalesce(string_agg(t, ' [DEL] ' ORDER BY i) FILTER (i % 3 = 2), '') AS r FROM m GROUP BY doc_id),
w AS (SELECT doc_id, list_concat(list_filter(string_split(msg, ' '), lambda x: x <> '')[1:64], list_filter(string_split('[ADD] ' || a || ' [DEL] ' || r, ' '), lambda x: x <> ''))[1:510] AS body FROM j)
SELECT doc_id, '[CLS] ' || array_to_string(body, ' ') || ' [SEP]' || repeat(' [PAD]', 510 - len(body)) AS tokens, (len(body) + 2)::INT AS n FROM w""",
    "a6_token_ids": """WITH v AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM documents), b AS (SELECT item_id, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) AS i FROM benchmark)
SELECT item_id, string_agg(CASE WHEN v.token IS NULL THEN '-1' ELSE (length(b.token) * 1000 + CASE WHEN b.token = '' THEN 0 ELSE ord(b.token) END)::VARCHAR END, ' ' ORDER BY i) AS ids FROM b LEFT JOIN v ON v.token = b.token AND length(v.token) <= 3 GROUP BY item_id""",
    "a7_mean_pool": f"""WITH v AS ({_DIM.format("label")}) SELECT label, dim::INT AS dim, round(sum(CASE WHEN vec_id % 3 > 0 AND label <> 3 THEN x ELSE 0 END) / greatest(sum((vec_id % 3 > 0 AND label <> 3)::INT), 1e-9), 6) AS x FROM v GROUP BY label, dim""",
    "a8_neighbor_sum": f"""WITH v AS ({_DIM.format("(vec_id % 5)::INT AS commit_hash, (vec_id // 5)::INT AS node_ix")}),
s AS (SELECT commit_hash, node_ix // 2 AS node_ix, dim, sum(x * (0.5 * (node_ix % 3 + 1) + dim / 64.0)) AS x FROM v GROUP BY ALL)
SELECT v.commit_hash, v.node_ix, v.dim::INT AS dim, round(coalesce(s.x, 0)::DOUBLE, 6) AS x FROM v LEFT JOIN s USING (commit_hash, node_ix, dim)""",
    "a10_change_features": "SELECT o_orderkey AS commit_hash, "
    + ", ".join((f"CASE WHEN o_orderstatus IN ('F', 'O') THEN 1.0 ELSE 0.0 END::DOUBLE AS {m}" if m == "fix" else f"(o_custkey % {i + 2})::DOUBLE AS {m}") for i, m in enumerate(dataset.METRICS))
    + f", (o_custkey % {dataset.METRICS.index('la') + 2} + o_custkey % {dataset.METRICS.index('ld') + 2})::DOUBLE AS loc FROM orders",
    "p1_leave_one_out_all": """WITH t AS (SELECT unnest(['1-URGENT', '2-HIGH', '5-LOW']) AS test_project),
r AS (SELECT *, row_number() OVER (PARTITION BY test_project ORDER BY (o_orderkey * 7919) % 10007, o_orderkey) AS k, count(*) OVER (PARTITION BY test_project) AS c FROM orders, t WHERE o_orderpriority <> test_project)
SELECT o_orderkey AS commit_hash, o_orderpriority AS project, CASE WHEN k <= floor(0.8 * c) THEN 'train' ELSE 'valid' END AS split, test_project FROM r
UNION ALL SELECT o_orderkey, o_orderpriority, 'test', test_project FROM orders, t WHERE o_orderpriority = test_project""",
    "p2_project_of_commit": "SELECT o_custkey AS commit_hash, arg_min(o_orderpriority, o_orderkey) AS project FROM orders GROUP BY 1",
    "p3_group_by_commit": "SELECT o_orderpriority AS project, o_custkey AS commit_hash, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS files FROM orders GROUP BY 1, 2",
}
