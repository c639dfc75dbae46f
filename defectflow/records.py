"""Graph records: one for each file of a commit, assembled from changed lines, statements, edges and buggy lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectflow import graph, slicing
from defectflow.diffs import FILE, changed_line_arrays
from defectflow.text import _trim


def without_noise(codes: Column) -> Column:
    """Codes without marker, trimmed, without empty lines and comment lines."""
    bare = F.transform(codes, lambda x: _trim(F.substring(x, 2, 1 << 30)))
    return F.filter(bare, lambda x: (x != "") & ~x.rlike(r"^(//|/\*|\*)"))


def graph_dataset(lines: DataFrame, nodes: DataFrame, edges: DataFrame, index: DataFrame) -> DataFrame:
    """``project, commit_hash, file_path, add_codes, remove_codes, relate_graph, diff_node, buggy_nodes, label`` of each changed file.

    ``lines``: changed lines; ``nodes``, ``edges``: the files' statement graphs; ``index``: commit key and ``files``, a map from file to its buggy lines. The graph is the part of the statement graph
    in the slices around the added lines, with ``+`` before those lines; the label is 1 for files in the index. A file without added lines, statements or slice gives an empty record
    (no path, no graph, no nodes, label 0). Each input is shuffled once, by file; all else happens in the row of a file."""
    wrong = index.select("project", "commit_hash", F.explode("files").alias("file_path", "buggy_lines"))
    return file_records(changed_line_arrays(lines).join(slicing.file_graphs(nodes, edges), FILE, "left").join(wrong, FILE, "left"))


def file_records(files: DataFrame) -> DataFrame:
    """``graph_dataset`` of rows that hold a file each: ``add_lines, add_codes, remove_codes`` (``changed_line_arrays``), ``nodes`` and ``links`` (``slicing.file_graphs``) and ``buggy_lines``, null for a file that isn't in the index. Nothing is shuffled."""
    listed = lambda c: F.coalesce(c, F.array().cast("array<int>"))
    no_links = F.array().cast(files.schema["links"].dataType)
    whole = files.withColumns({"nodes": F.coalesce("nodes", F.array().cast(files.schema["nodes"].dataType)), "links": F.coalesce("links", no_links), "label": F.col("buggy_lines").isNotNull().cast("int")})
    whole = whole.withColumn("cut", slicing.cut(F.col("nodes"), F.col("links"), F.col("add_lines"), listed("buggy_lines")))
    both = F.arrays_zip("nodes", F.col("cut.nodes").alias("cut"))
    marked = lambda x: F.transform(x["nodes"]["source_lines"], lambda t, i: F.when(F.array_contains(x["cut"]["marked"], i) & ~t.startswith("+"), F.concat(F.lit("+"), t)).otherwise(t))
    shown = F.transform(F.filter(both, lambda x: x["cut"]["kept"]), lambda x: F.when(F.size(x["cut"]["marked"]) > 0, x["nodes"].withField("source_lines", marked(x))).otherwise(x["nodes"]))
    links = F.transform(F.filter(F.arrays_zip("links", F.col("cut.links").alias("kept")), lambda x: x["kept"]), lambda x: x["links"])
    ids = lambda flag: F.array_distinct(F.transform(F.filter(both, lambda x: x["cut"][flag]), lambda x: x["nodes"]["id"])).cast("array<int>")
    cut = whole.select("*", shown.alias("shown"), links.alias("kept_links"), ids("seed").alias("diff_node"), ids("buggy").alias("buggy_nodes"))
    full = (F.size("shown") > 0) & (F.size("add_lines") > 0)
    none = F.array().cast("array<int>")
    return cut.select(
        "project", "commit_hash", F.when(full, F.col("file_path")).otherwise("").alias("file_path"), without_noise(F.col("add_codes")).alias("add_codes"), without_noise(F.col("remove_codes")).alias("remove_codes"),
        F.when(full, graph.node_link(F.col("shown"), F.col("kept_links"))).alias("relate_graph"), *(F.when(full, F.col(c)).otherwise(none).alias(c) for c in ("diff_node", "buggy_nodes")), F.when(full, F.col("label")).otherwise(0).alias("label"),
    )
