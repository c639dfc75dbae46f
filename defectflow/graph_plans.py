"""Registered queries on statement graphs, splits and vectors, and their SQL.

An order stands in for a source file: its line items are statements, item i depends on item i div 2.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from defectflow import dataset, graph, retrieval, slicing, sources, splits


KINDS = ["if_statement", "else", "field_declaration", "while_statement", "break_statement", "continue_statement", "expression_statement"]


ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]


def _file() -> list[Column]:
    order = F.col("l_orderkey")
    return [F.lit("p").alias("project"), F.floor(order / 4).cast("string").alias("commit_hash"), order.cast("string").alias("file_path"), (order % 4).cast("int").alias("file_ord")]


def _statement(c: Callable[[str], Column], i: Column) -> list[Column]:
    """The statement of a line item: columns from its columns by name and its place from 1."""
    start, row = i * 2, lambda r: F.concat(F.lit("r"), r, F.lit(" // c"), c("l_suppkey"), F.lit("\n"))
    lines = F.transform(F.sequence(start, start + (c("l_partkey") % 2).cast("int")), lambda r: F.when((c("l_suppkey") % 7 == 0) & (r % 2 == 1), F.lit("\n")).otherwise(row(r)))
    return [
        F.get(F.array(*map(F.lit, KINDS)), c("l_linenumber") % 7).alias("node_type"), F.array((c("l_partkey") % 5).cast("string")).alias("def_set"), F.array((c("l_suppkey") % 5).cast("string")).alias("use_set"),
        (c("l_returnflag") == "R").alias("changed"), start.alias("start_row"), (start + c("l_partkey") % 2).cast("int").alias("end_row"), lines.alias("source_lines"), *(c(x).alias(x) for x in ("l_partkey", "l_suppkey", "l_returnflag")),
    ]


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("node_id", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ORDER)))
    return li.select(*_file(), "node_id", *_statement(F.col, F.col("node_id")))


def _files(spark: SparkSession, d: str) -> DataFrame:
    """A row for each file: its key, ``file_ord`` and ``nodes``, the statements of ``_nodes`` (``id`` first) in order. Line items are shuffled once; what queries derive from a file's arrays stays in its row."""
    items = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", F.struct(*ORDER, "l_returnflag").alias("x"))
    held = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("items"))
    return held.select(*_file(), F.transform("items", lambda x, i: F.struct((i + 1).alias("id"), *_statement(lambda name: x[name], i + 1))).alias("nodes"))


def _kept(nodes: Column, *fields: str) -> Column:
    """Nodes with some of their fields."""
    return F.transform(nodes, lambda x: F.struct(*(x[f].alias(f) for f in ("id", *fields))))


def _links(nodes: Column, where: Callable[[Column], Column], source: Callable[[Column], Column], target: Callable[[Column], Column], kind: str) -> Column:
    return F.transform(F.filter(nodes, lambda x: where(x["id"])), lambda x: F.struct(source(x["id"]).cast("int").alias("source"), target(x["id"]).cast("int").alias("target"), F.lit(kind).alias("key")))


def _cdg_links(nodes: Column) -> Column:
    return _links(nodes, lambda i: i > 1, lambda i: F.floor(i / 2), lambda i: i, "CDG")


def _cfg_links(nodes: Column) -> Column:
    return F.concat(_links(nodes, lambda i: i > 1, lambda i: i - 1, lambda i: i, "CFG"), _links(nodes, lambda i: i % 3 == 0, lambda i: i, lambda i: F.floor(i / 2), "CFG"))


def _edge(nodes: DataFrame, src, dst, kind: str) -> DataFrame:
    return nodes.select(*slicing.FILE, src.cast("int").alias("src"), dst.cast("int").alias("dst"), F.lit(kind).alias("edge_type"))


def _cdg(nodes: DataFrame) -> DataFrame:
    return _edge(nodes.where("node_id > 1"), F.floor(F.col("node_id") / 2), F.col("node_id"), "CDG")


def _cfg(nodes: DataFrame) -> DataFrame:
    i = F.col("node_id")
    return _edge(nodes.where("node_id > 1"), i - 1, i, "CFG").unionByName(_edge(nodes.where("node_id % 3 = 0"), i, F.floor(i / 2), "CFG"))


_NODES = """
n AS (SELECT 'p' AS project, (l_orderkey // 4)::VARCHAR AS commit_hash, l_orderkey::VARCHAR AS file_path, (l_orderkey % 4)::INT AS file_ord,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity)::INT AS id,
  ['if_statement', 'else', 'field_declaration', 'while_statement', 'break_statement', 'continue_statement', 'expression_statement'][l_linenumber % 7 + 1] AS kind,
  l_partkey % 5 AS def, l_suppkey % 5 AS use, l_returnflag = 'R' AS changed, l_partkey AS pk, l_suppkey AS sk, l_returnflag AS flag FROM lineitem),
cdg AS (SELECT file_path AS f, id // 2 AS src, id AS dst FROM n WHERE id > 1),
cfg AS (SELECT file_path AS f, id - 1 AS src, id AS dst FROM n WHERE id > 1 UNION SELECT file_path, id, id // 2 FROM n WHERE id % 3 = 0),
back(f, v, u, w) AS (SELECT file_path, use, id, src FROM n JOIN cfg ON f = file_path AND dst = id
  UNION SELECT b.f, v, u, c.src FROM back b JOIN n ON file_path = b.f AND id = w JOIN cfg c ON c.f = b.f AND c.dst = w WHERE w <> u AND def <> v),
ddg AS (SELECT DISTINCT f, w AS src, u AS dst FROM back JOIN n ON file_path = f AND id = w WHERE def = v AND w <> u)"""
#: The nodes and plain edges alone.
_PLAIN = _NODES[: _NODES.index(",\nback(")]
_SLICES = """,
s AS (SELECT file_path AS f, id FROM n WHERE changed),
a1 AS (SELECT * FROM s UNION SELECT f, src FROM s JOIN ddg USING (f) WHERE dst = id), a2 AS (SELECT * FROM a1 UNION SELECT f, src FROM a1 JOIN ddg USING (f) WHERE dst = id),
fw AS (SELECT * FROM a2 UNION SELECT f, src FROM a2 JOIN cdg USING (f) WHERE dst = id),
b0 AS (SELECT * FROM s UNION SELECT s.f, dst FROM s JOIN n ON file_path = s.f AND n.id = s.id JOIN cdg ON cdg.f = s.f AND src = s.id WHERE kind NOT LIKE '%declaration%'),
b1 AS (SELECT * FROM b0 UNION SELECT f, dst FROM b0 JOIN ddg USING (f) WHERE src = id), b2 AS (SELECT * FROM b1 UNION SELECT f, dst FROM b1 JOIN ddg USING (f) WHERE src = id),
bw AS (SELECT * FROM b2 UNION SELECT f, src FROM b2 JOIN cdg USING (f) WHERE dst = id)"""


def g3_else_chains(spark, d):
    n = _nodes(spark, d)
    kind = F.get(F.array(*map(F.lit, ["if_statement", "else", "if_statement", "expression_statement", "if_statement"])), F.col("l_partkey") % 5)
    line = F.when(F.col("l_suppkey") % 3 > 0, "} else if (a)\n").otherwise("if (b)\n")
    return graph.else_chain_edges(n.withColumns({"node_type": kind, "source_lines": F.array(line)}), _cdg(n)).select("file_path", "src", "dst")


def g4_sibling_links(spark, d):
    n = _nodes(spark, d)
    return graph.sibling_links(n, _cdg(n)).select("file_path", "node_id", "next_sibling", "first_child")


def g5_cfg_edges(spark, d):
    f, nodes = _files(spark, d), F.col("nodes")
    parents = F.transform(nodes, lambda x: F.struct(x["id"], x["node_type"], F.when(x["id"] > 1, F.floor(x["id"] / 2).cast("int")).alias("parent_id")))
    flow = f.select("file_path", F.inline(graph.flow_links(parents, _cdg_links(nodes))))
    return flow.select("file_path", F.col("source").alias("src"), F.col("target").alias("dst"))


def g6_ddg_edges(spark, d):
    n = _nodes(spark, d)
    return graph.ddg_edges(n, _cfg(n)).select("file_path", "src", "dst")


def _typed(n: DataFrame) -> DataFrame:
    return slicing.typed_edges(_cdg(n), _cfg(n), graph.ddg_edges(n, _cfg(n)))


def c3_forward_slice(spark, d):
    n = _nodes(spark, d)
    return slicing.forward_slice(n.where("changed"), _typed(n)).select("file_path", "node_id")


def c5_slice_nodes(spark, d):
    n = _nodes(spark, d)
    return slicing.slice_nodes(n.where("changed"), n, _typed(n)).select("file_path", "node_id")


def a1_reindex_nodes(spark, d):
    return dataset.reindex_nodes(_nodes(spark, d)).select("commit_hash", "file_path", "node_id", "node_ix")


def a2_commit_edges(spark, d):
    n = _nodes(spark, d)
    return dataset.commit_edges(dataset.reindex_nodes(n), _cdg(n).unionByName(_cfg(n)), compat=True).select("commit_hash", "src_ix", "dst_ix", "type_code")


def s8_line_index(spark, d):
    n = _nodes(spark, d)
    index = n.groupBy(*slicing.FILE).agg(F.sort_array(F.collect_list(F.when(F.col("changed"), F.col("node_id")))).alias("buggy_lines"))
    return sources.line_index_entries(index).select("key", F.to_json("files").alias("files"))


def p1_leave_one_out(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("commit_hash"), F.col("o_orderpriority").alias("project"))
    order = [(F.col("commit_hash") * 7919) % 10007, F.col("commit_hash")]
    return splits.leave_one_project_out(o, "1-URGENT", order).select("commit_hash", "project", "split")


def a9_max_pool(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    v = e.select(F.col("label").alias("commit_hash"), F.col("vec_id").alias("node_ix"), F.col("embedding").alias("vector"))
    return dataset.max_pool_marked(v, v.where("node_ix % 2 = 0"), v, 64).select("commit_hash", F.posexplode("vector").alias("dim", "x")).withColumn("x", F.round("x", 6))


def k4_knn(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.knn(e.where("id % 50 = 0"), e, 5).select("query_id", "id", "rank")


QUERIES = {f.__name__: f for f in (g3_else_chains, g4_sibling_links, g5_cfg_edges, g6_ddg_edges, c3_forward_slice, c5_slice_nodes, a1_reindex_nodes, a2_commit_edges, s8_line_index, p1_leave_one_out, a9_max_pool, k4_knn)}

_IX = ", ix AS (SELECT *, (row_number() OVER (PARTITION BY commit_hash ORDER BY file_ord, file_path, id) - 1)::INT AS node_ix FROM n)"
ORACLE_SQL = {
    "g3_else_chains": f"""WITH RECURSIVE {_PLAIN},
k AS (SELECT file_path AS f, id, id // 2 AS up, ['if', 'else', 'if', 'other', 'if'][pk % 5 + 1] AS kind, sk % 3 > 0 AS says FROM n),
c AS (SELECT *, kind = 'if' AND says AS further, max((kind = 'else')::INT) OVER (PARTITION BY f, up ORDER BY id ROWS UNBOUNDED PRECEDING) = 1 AS behind FROM k),
v(f, head, id, path, further, behind, kind) AS (SELECT f, id, id, []::INT[], false, false, 'else' FROM c WHERE kind = 'if' AND NOT says
  UNION ALL SELECT c.f, head, c.id, list_append(path, c.id), c.further, c.behind, c.kind FROM v JOIN c ON c.f = v.f AND c.up = v.id WHERE len(path) = 0 OR v.further)
SELECT DISTINCT a.f AS file_path, a.id::INT AS src, b.id::INT AS dst FROM v a JOIN v b ON b.f = a.f AND b.head = a.head AND a.path < b.path AND a.id <> b.id
WHERE (a.further OR a.kind = 'else') AND (b.further OR b.behind) AND NOT EXISTS (FROM cdg WHERE cdg.f = a.f AND src = a.id AND dst = b.id)""",
    "g4_sibling_links": f"""WITH RECURSIVE {_NODES},
k AS (SELECT n.*, CASE WHEN n.id > 1 THEN n.id // 2 ELSE -1 END AS parent FROM n),
l AS (SELECT k.*, lead(id) OVER w AS nx, lead(kind) OVER w AS nk FROM k WINDOW w AS (PARTITION BY file_path, parent ORDER BY id))
SELECT l.file_path, l.id AS node_id, (CASE WHEN q.kind IN ('if_statement', 'try_statement') AND (nk = 'else' OR nk LIKE '%clause%') THEN NULL ELSE nx END)::INT AS next_sibling,
  (SELECT min(dst) FROM cdg WHERE f = l.file_path AND src = l.id)::INT AS first_child FROM l LEFT JOIN n q ON q.file_path = l.file_path AND q.id = l.parent""",
    "g6_ddg_edges": f"WITH RECURSIVE {_NODES} SELECT f AS file_path, src::INT AS src, dst::INT AS dst FROM ddg",
    "c3_forward_slice": f"WITH RECURSIVE {_NODES}{_SLICES} SELECT f AS file_path, id::INT AS node_id FROM fw",
    "c5_slice_nodes": f"WITH RECURSIVE {_NODES}{_SLICES} SELECT f AS file_path, id::INT AS node_id FROM fw UNION SELECT f, id::INT FROM bw",
    "a1_reindex_nodes": f"WITH RECURSIVE {_NODES}{_IX} SELECT commit_hash, file_path, id AS node_id, node_ix FROM ix",
    "a2_commit_edges": f"""WITH {_PLAIN}{_IX}, e AS (SELECT *, 1 AS code FROM cdg UNION ALL SELECT *, 0 FROM cfg),
j AS (SELECT a.commit_hash, a.node_ix AS src_ix, b.node_ix AS dst_ix, code AS type_code FROM e JOIN ix a ON a.file_path = f AND a.id = src JOIN ix b ON b.file_path = f AND b.id = dst),
k AS (SELECT *, count(*) OVER (PARTITION BY commit_hash, src_ix, dst_ix) AS times FROM j)
SELECT commit_hash, src_ix, dst_ix, type_code FROM (SELECT *, unnest(range(times)) FROM k)""",
    "g5_cfg_edges": f"""WITH RECURSIVE {_PLAIN},
k AS (SELECT file_path AS f, id, kind, CASE WHEN id > 1 THEN id // 2 END AS up, CASE WHEN id > 1 THEN id // 2 ELSE -1 END AS parent FROM n),
l AS (SELECT *, lead(id) OVER w AS nx, lead(kind) OVER w AS nk FROM k WINDOW w AS (PARTITION BY f, parent ORDER BY id)),
g AS (SELECT l.f, l.id, l.kind, l.up, CASE WHEN q.kind IN ('if_statement', 'try_statement') AND (nk = 'else' OR nk LIKE '%clause%') THEN NULL ELSE nx END AS after, c.first FROM l LEFT JOIN k q ON q.f = l.f AND q.id = l.up
  LEFT JOIN (SELECT f, src, min(dst) AS first FROM cdg GROUP BY ALL) c ON c.f = l.f AND c.src = l.id),
anc(f, v, a, depth) AS (SELECT f, id, up, 1 FROM g WHERE up IS NOT NULL UNION ALL SELECT anc.f, v, up, depth + 1 FROM anc JOIN g ON g.f = anc.f AND g.id = a WHERE up IS NOT NULL),
up AS (SELECT anc.f, v, a, depth, kind, after FROM anc JOIN g ON g.f = anc.f AND g.id = a),
near AS (SELECT f, v, min_by(a, depth) AS a FROM up WHERE kind IN ('for_statement', 'while_statement', 'enhanced_for_statement', 'do_statement', 'switch_expression', 'labeled_statement') GROUP BY ALL),
near2 AS (SELECT near.f, v, a, after FROM near JOIN g ON g.f = near.f AND g.id = a),
stop AS (SELECT f, v, min(depth) AS depth FROM up WHERE kind IN ('try_statement', 'if_statement', 'catch_clause', 'finally_clause', 'try_with_resources_statement') AND after IS NOT NULL GROUP BY ALL)
SELECT DISTINCT f AS file_path, src::INT AS src, dst::INT AS dst FROM (
  SELECT f, id AS src, first AS dst FROM g
  UNION ALL SELECT f, id, after FROM g
  UNION ALL SELECT g.f, id, CASE WHEN kind = 'break_statement' THEN near2.after ELSE near2.a END FROM g JOIN near2 ON near2.f = g.f AND v = id WHERE kind IN ('break_statement', 'continue_statement')
  UNION ALL SELECT g.f, g.id, c.dst FROM g JOIN cdg c ON c.f = g.f AND c.src = g.id JOIN k ON k.f = g.f AND k.id = c.dst WHERE g.kind IN ('if_statement', 'try_statement', 'try_with_resources_statement') AND (k.kind = 'else' OR k.kind LIKE '%clause%')
  UNION ALL SELECT up.f, up.v, up.a FROM up JOIN g ON g.f = up.f AND g.id = v LEFT JOIN stop ON stop.f = up.f AND stop.v = up.v
    WHERE g.after IS NULL AND up.kind IN ('for_statement', 'while_statement', 'enhanced_for_statement', 'do_statement') AND (stop.depth IS NULL OR up.depth <= stop.depth)
  UNION ALL SELECT up.f, up.v, up.after FROM up JOIN g ON g.f = up.f AND g.id = v JOIN stop ON stop.f = up.f AND stop.v = up.v AND stop.depth = up.depth WHERE g.after IS NULL
) WHERE dst IS NOT NULL""",
    "s8_line_index": f"""WITH RECURSIVE {_NODES}, g AS (SELECT commit_hash, file_path, list(id ORDER BY id) FILTER (changed) AS ids FROM n GROUP BY ALL)
SELECT 'p:' || commit_hash AS key, '{{' || coalesce(string_agg('"' || file_path || '":"[' || array_to_string(ids, ', ') || ']"', ',' ORDER BY file_path) FILTER (len(ids) > 0), '') || '}}' AS files FROM g GROUP BY commit_hash""",
    "p1_leave_one_out": """WITH r AS (SELECT *, row_number() OVER (ORDER BY (o_orderkey * 7919) % 10007, o_orderkey) AS k, count(*) OVER () AS c FROM orders WHERE o_orderpriority <> '1-URGENT')
SELECT o_orderkey AS commit_hash, o_orderpriority AS project, CASE WHEN k <= floor(0.8 * c) THEN 'train' ELSE 'valid' END AS split FROM r
UNION ALL SELECT o_orderkey, o_orderpriority, 'test' FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "a9_max_pool": """WITH v AS (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
c AS (SELECT * FROM (SELECT DISTINCT label FROM embeddings), range(64) t(dim))
SELECT c.label AS commit_hash, c.dim::INT AS dim, round(coalesce(max(x) FILTER (vec_id % 2 = 0), 0)::DOUBLE, 6) AS x FROM c LEFT JOIN v ON v.label = c.label AND v.dim = c.dim GROUP BY ALL""",
    "k4_knn": """SELECT query_id, id, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id
ORDER BY list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)), v.vec_id)::INT AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) WHERE rank <= 5""",
}
