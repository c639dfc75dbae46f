"""Statement graphs: control dependence, siblings, control flow and data dependence.

Tables as in ``slicing``; a graph is one source file. Walks of unbounded depth run over whole graphs, one row each, in the tasks; the rest is joins and windows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from defectflow.diffs import FILE
from defectflow.slicing import file_graphs

# Statement types by their role.
DEFINING = ["class_declaration", "method_declaration", "enum_declaration", "interface_declaration", "constructor_declaration", "yield_statement", "catch_clause"]
ASSIGNING = ["assignment_expression", "local_variable_declaration", "field_declaration", "expression_statement", "try_with_resources_statement", "enum_constant"]
TYPE_HOLDERS = ["superclass", "generic_type", "object_creation_expression", "type_arguments"]
TRANSPARENT = {"import_declaration", "try_statement"}
LOOPS = {"for_statement", "while_statement", "enhanced_for_statement", "do_statement"}
BREAKABLE = {"for_statement", "while_statement", "enhanced_for_statement", "do_statement", "switch_expression", "labeled_statement"}
EXITS = {"try_statement", "if_statement", "catch_clause", "finally_clause", "try_with_resources_statement"}
BRANCHING = {"if_statement", "try_statement", "try_with_resources_statement"}

EDGES = "project string, commit_hash string, file_path string, src int, dst int, edge_type string"
LINKS = "array<struct<source:int,target:int,key:string>>"


def def_use_sets(identifiers: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``def_set`` and ``use_set``, sorted.

    ``identifiers``: graph key, ``node_id, name, token_type, holder_type, holder_child_count, next_sibling_type, header_prev_sibling_type``."""
    kind = F.col("node_type")
    header = F.coalesce("header_prev_sibling_type", F.lit(""))
    is_def = (
        F.when((F.col("token_type") != "identifier") | (F.col("holder_type") == "type_list"), False)
        .when(kind.isin(DEFINING) | kind.contains("import"), True)
        .when(kind.isin("for_statement", "enhanced_for_statement"), (header == "for") | header.contains("type"))
        .when(kind.isin(ASSIGNING), (F.coalesce("next_sibling_type", F.lit("")) == "=") | (F.col("holder_child_count") == 1))
        .otherwise(False)
    )
    counts = (F.col("token_type") == "identifier") | (F.col("holder_type") == "type_list") | ((F.col("token_type") == "type_identifier") & F.col("holder_type").isin(TYPE_HOLDERS))
    named = identifiers.where(counts).join(nodes.select(*FILE, "node_id", "node_type"), [*FILE, "node_id"]).withColumn("is_def", is_def)
    one = lambda flag: F.sort_array(F.collect_set(F.when(flag, F.col("name"))))
    sets = named.groupBy(*FILE, "node_id").agg(one(F.col("is_def")).alias("def_set"), one(~F.col("is_def")).alias("use_set"))
    none = F.array().cast("array<string>")
    return nodes.drop("def_set", "use_set").join(sets, [*FILE, "node_id"], "left").withColumns({c: F.coalesce(c, none) for c in ("def_set", "use_set")})


def _per_graph(nodes: DataFrame, columns: list[str], edges: DataFrame | None, walk: Callable[[list, list], Iterator[tuple]], schema: str) -> DataFrame:
    """``walk(nodes, edges)`` of each graph, as sorted rows of ``columns`` and (src, dst); its tuples follow the graph key in ``schema``."""
    held = nodes.groupBy(*FILE).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("n"))
    if edges is not None:
        held = held.join(edges.groupBy(*FILE).agg(F.sort_array(F.collect_set(F.struct("src", "dst"))).alias("e")), FILE, "left")
    else:
        held = held.withColumn("e", F.lit(None))
    names = [f.split()[0] for f in schema.split(", ")]
    held = held.select(*FILE, "n", F.coalesce("e", F.array().cast("array<struct<src:int,dst:int>>")).alias("e"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for g in frame.itertuples(index=False):
                out += [(*g[:3], *row) for row in walk([tuple(x.values()) for x in g.n], [(x["src"], x["dst"]) for x in g.e])]
            yield pd.DataFrame(out, columns=names)

    return held.mapInPandas(run, schema)


#: Files of a batch that are Python objects at a time.
FILES = 256


def _tuples(lists: pa.Array) -> Iterator[list[tuple]]:
    """The structs of each list as tuples."""
    whole = list(zip(*(c.to_pylist() for c in lists.flatten().flatten()), strict=True))
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy()).tolist()
    return (whole[a:b] for a, b in zip([0, *ends], ends, strict=False))


def _links(walk: Callable[[list, list], Iterator[tuple[int, int]]], nodes: Column, links: Column, key: str) -> Column:
    """``walk(nodes, edges)`` of each file from the arrays of its row, as ``_per_graph`` does from long tables: sorted rows of ``nodes`` and distinct (source, target) of ``links``; the pairs it gives are links."""

    def some(nodes: pa.Array, edges: pa.Array) -> pa.Array:
        found = [list(walk(sorted(n), sorted(set(e)))) for n, e in zip(_tuples(nodes), _tuples(edges), strict=True)]
        offsets = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
        source, target = (pa.array([p[i] for pairs in found for p in pairs], pa.int32()) for i in (0, 1))
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([source, target, pa.array([key] * len(source), pa.string())], names=["source", "target", "key"]))

    @F.arrow_udf(LINKS)
    def run(nodes: pa.Array, edges: pa.Array) -> pa.Array:
        return pa.concat_arrays([some(nodes.slice(at, FILES), edges.slice(at, FILES)) for at in range(0, len(nodes), FILES) or [0]])

    return run(nodes, F.transform(links, lambda x: F.struct(x["source"].cast("int").alias("source"), x["target"].cast("int").alias("target"))))


def cdg_nodes(statements: DataFrame) -> DataFrame:
    """Kept statements: graph key, ``node_id``, the statement's ``pos`` and the ``parent_id`` it depends on.

    ``statements``: graph key, ``pos`` (order of a top-down walk), ``parent_pos``, ``start_row``, ``end_row``, ``node_type``, ``of_else_if`` (an ``else`` before ``if``)."""

    def walk(rows, _):
        kept, under = [], {}
        for pos, up, start, end, kind, of_else_if in rows:
            above = under.get(up)
            inside = above is not None and kept[above][0] <= start and end <= kept[above][1]
            if inside or of_else_if:
                under[pos] = above
                continue
            node = len(kept)
            kept.append((start, end))
            under[pos] = above if above is not None and kind in TRANSPARENT else node
            yield node, pos, above

    columns = ["pos", "parent_pos", "start_row", "end_row", "node_type", "of_else_if"]
    flagged = statements.withColumn("of_else_if", F.coalesce("of_else_if", F.lit(False)))
    return _per_graph(flagged, columns, None, walk, EDGES.split(", src")[0] + ", node_id int, pos int, parent_id int")


def cdg_edges(kept: DataFrame) -> DataFrame:
    return kept.where("parent_id is not null").select(*FILE, F.col("parent_id").alias("src"), F.col("node_id").alias("dst"), F.lit("CDG").alias("edge_type"))


def else_chain_edges(nodes: DataFrame, cdg: DataFrame) -> DataFrame:
    """Further control dependence of the branches of an if chain on all of the chain's conditions."""

    def walk(rows, edges):
        kids = defaultdict(set)
        for a, b in edges:
            kids[a].add(b)
        kind, line = {r[0]: r[1] for r in rows}, {r[0]: r[2] or "" for r in rows}
        added = set()
        for head in (v for v in kind if kind[v] == "if_statement" and "else" not in line[v]):
            chain, open_levels = {head}, [[iter(sorted(kids[head])), False]]
            while open_levels:
                level = open_levels[-1]
                kid = next(level[0], None)
                if kid is None:
                    open_levels.pop()
                    continue
                further = kind.get(kid) == "if_statement" and "else" in line[kid]
                level[1] |= kind.get(kid) == "else"
                if further or level[1]:
                    new = {(p, kid) for p in chain if p != kid}
                    added |= new
                    for p, k in new:
                        kids[p].add(k)
                if further or kind.get(kid) == "else":
                    chain.add(kid)
                if further:
                    open_levels.append([iter(sorted(kids[kid])), False])
        yield from ((a, b, "CDG") for a, b in sorted(added - set(edges)))

    first = nodes.select(*FILE, "node_id", "node_type", F.get("source_lines", F.lit(0)).alias("line"))
    return _per_graph(first, ["node_id", "node_type", "line"], cdg, walk, EDGES)


def sibling_links(nodes: DataFrame, cdg: DataFrame) -> DataFrame:
    """``node_id, next_sibling, first_child``. A child of several parents follows the one with the highest id; roots follow each other."""
    kind = nodes.select(*FILE, "node_id", "node_type")
    edges = cdg.select(*FILE, F.col("src").alias("parent"), F.col("dst").alias("node_id")).distinct()
    roots = kind.join(edges.select(*FILE, "node_id").distinct(), [*FILE, "node_id"], "left_anti").withColumn("parent", F.lit(-1))
    placed = edges.join(kind, [*FILE, "node_id"]).unionByName(roots)
    types = kind.select(*FILE, F.col("node_id").alias("parent"), F.col("node_type").alias("parent_type"))
    order = W.partitionBy(*FILE, "parent").orderBy("node_id")
    near = placed.join(types, [*FILE, "parent"], "left").withColumns({"next": F.lead("node_id").over(order), "next_type": F.lead("node_type").over(order)})
    stops = F.col("parent_type").isin("if_statement", "try_statement") & ((F.col("next_type") == "else") | F.col("next_type").contains("clause"))
    following = near.withColumn("next", F.when(F.coalesce(stops, F.lit(False)), None).otherwise(F.col("next")))
    chosen = following.groupBy(*FILE, "node_id").agg(F.max_by(F.struct("next"), "parent")["next"].alias("next_sibling"))
    children = edges.groupBy(*FILE, F.col("parent").alias("node_id")).agg(F.min("node_id").alias("first_child"))
    return chosen.join(children, [*FILE, "node_id"], "left").select(*FILE, "node_id", "next_sibling", "first_child")


def siblings(kind: dict[int, str], edges: list[tuple[int, int]]) -> tuple[dict[int, int | None], dict[int, int]]:
    """``sibling_links`` of one file, by node: what follows and the first child. ``edges`` are distinct."""
    families, first, below = defaultdict(list), {}, set()
    for a, b in sorted(edges):
        first.setdefault(a, b)
        below.add(b)
        if b in kind:
            families[a].append(b)
    families[-1] = sorted(families[-1] + [v for v in kind if v not in below])
    after = {}
    for parent, kids in sorted(families.items()):  # of several parents the last one counts
        for v, w in zip(kids, [*kids[1:], None], strict=True):
            branch = w is not None and kind.get(parent) in ("if_statement", "try_statement") and (kind[w] == "else" or "clause" in (kind[w] or ""))
            after[v] = None if branch else w
    return after, first


def control_flow(kind: dict[int, str], up: dict[int, int | None], after: dict[int, int | None], first: dict[int, int | None], edges: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Control flow of one file, by node: type, parent, next sibling and first child; ``edges`` of control dependence."""
    kids = defaultdict(list)
    for a, b in edges:
        kids[a].append(b)

    def ancestors(v):
        while (v := up.get(v)) is not None:
            yield v

    found = set()
    for v, k in kind.items():
        found.add((v, first.get(v)))
        if k in ("break_statement", "continue_statement"):
            target = next((a for a in ancestors(v) if kind[a] in BREAKABLE), None)
            found.add((v, after.get(target) if k == "break_statement" else target))
        if k in BRANCHING:
            found |= {(v, c) for c in kids[v] if kind.get(c) == "else" or "clause" in kind.get(c, "")}
        if k in ("while_statement", "do_statement"):
            found.add((v, after[v]))
        if k == "switch_expression":
            case = first.get(v)
            while case is not None:
                found.add((v, case))
                case = after.get(case)
        if after[v] is not None:
            found.add((v, after[v]))
            continue
        for a in ancestors(v):
            if kind[a] in LOOPS:
                found.add((v, a))
            if kind[a] in EXITS and after[a] is not None:
                found.add((v, after[a]))
                break
    yield from sorted(x for x in found if x[1] is not None)


def flow_links(nodes: Column, links: Column) -> Column:
    """``cfg_edges`` within a file's row, as links: from ``nodes`` (``id, node_type, parent_id``) and the links of control dependence; siblings follow from both. Nothing is shuffled."""

    def walk(rows, edges):
        kind, up = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
        yield from control_flow(kind, up, *siblings(kind, edges), edges)

    return _links(walk, F.transform(nodes, lambda x: F.struct(x["id"], x["node_type"], x["parent_id"])), links, "CFG")


def cfg_edges(nodes: DataFrame, cdg: DataFrame, siblings: DataFrame) -> DataFrame:
    """Control flow. ``nodes`` with ``parent_id``; ``cdg`` with the else-chain edges, ``siblings`` derived from both."""

    def walk(rows, edges):
        yield from ((a, b, "CFG") for a, b in control_flow(*({r[0]: r[i] for r in rows} for i in (1, 2, 3, 4)), edges))

    full = nodes.select(*FILE, "node_id", "node_type", "parent_id").join(siblings, [*FILE, "node_id"])
    return _per_graph(full, ["node_id", "node_type", "parent_id", "next_sibling", "first_child"], cdg, walk, EDGES)


#: Definitions that are followed at a time, one bit each for every statement.
DEFINITIONS = 1 << 13


def _reverse_postorder(nodes: list, after: dict[int, list[int]], before: dict[int, list[int]]) -> list[int]:
    """Statements so that, loops aside, each comes after those that lead to it."""
    seen, out = set(), []
    for root in [v for v in nodes if not before.get(v)] + nodes:
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(after.get(root, ())))]
        while stack:
            v, rest = stack[-1]
            for w in rest:
                if w not in seen:
                    seen.add(w)
                    stack.append((w, iter(after.get(w, ()))))
                    break
            else:
                stack.pop()
                out.append(v)
    return out[::-1]


def reaching_definitions(rows: list[tuple[int, list[str], list[str]]], edges: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Pairs (definition, use) of statements (id, defined names, used names): some path leads from the one to the other without another definition of the name.

    Sets of definitions are whole numbers, a bit each; sweeps in reverse postorder carry them over the edges to the fixed point, for ``DEFINITIONS`` of them at a time."""
    before, after = defaultdict(list), defaultdict(list)
    for a, b in edges:
        before[b].append(a)
        after[a].append(b)
    order = _reverse_postorder(sorted({r[0] for r in rows} | before.keys() | after.keys()), after, before)
    place = {v: i for i, v in enumerate(order)}
    into, out_of = ([[place[w] for w in side.get(v, ())] for v in order] for side in (before, after))
    defined, used = defaultdict(set), defaultdict(set)
    for v, d, u in rows:
        for name in d:
            defined[name].add(place[v])
        for name in u:
            used[name].add(place[v])
    names, found = sorted(defined.keys() & used.keys()), set()
    while names:
        bits, masks, gen, kill = [], {}, defaultdict(int), defaultdict(int)
        while names and (not bits or len(bits) + len(defined[names[-1]]) <= DEFINITIONS):
            name = names.pop()
            first = len(bits)
            bits += sorted(defined[name])
            masks[name] = (1 << len(bits)) - (1 << first)
            for i, v in enumerate(bits[first:], first):
                gen[v] |= 1 << i
                kill[v] |= masks[name]
        every = (1 << len(bits)) - 1
        reach, leave = [0] * len(order), [gen.get(v, 0) for v in range(len(order))]
        sweep = {w for v in gen for w in out_of[v]}
        while sweep:  # what lies behind waits for the next sweep, so loops cost a sweep a level
            todo, waits, sweep = sorted(sweep), sweep, set()
            while todo:
                v = heapq.heappop(todo)
                come = 0
                for p in into[v]:
                    come |= leave[p]
                if come == reach[v]:
                    continue
                reach[v] = come
                go = gen[v] | come & (every ^ kill[v]) if v in kill else come
                if go != leave[v]:
                    leave[v] = go
                    for w in out_of[v]:
                        if w <= v:
                            sweep.add(w)
                        elif w not in waits:
                            waits.add(w)
                            heapq.heappush(todo, w)
        for name, mask in masks.items():
            for v in used[name]:
                left = reach[v] & mask
                while left:
                    low = left & -left
                    p = bits[low.bit_length() - 1]
                    if p != v:
                        found.add((order[p], order[v]))
                    left ^= low
    yield from sorted(found)


def data_links(nodes: Column, links: Column) -> Column:
    """``ddg_edges`` within a file's row, as links: from ``nodes`` (``id, def_set, use_set``) and the links of control flow. Nothing is shuffled."""
    empty = F.array().cast("array<string>")
    return _links(reaching_definitions, F.transform(nodes, lambda x: F.struct(x["id"], F.coalesce(x["def_set"], empty).alias("d"), F.coalesce(x["use_set"], empty).alias("u"))), links, "DDG")


def ddg_edges(nodes: DataFrame, cfg: DataFrame) -> DataFrame:
    """Data dependence: definitions that reach a use over control flow, each path ending at its first definition backwards; none from a statement to itself."""

    def walk(rows, edges):
        yield from ((a, b, "DDG") for a, b in reaching_definitions(rows, edges))

    empty = F.array().cast("array<string>")
    sets = nodes.select(*FILE, "node_id", F.coalesce("def_set", empty).alias("d"), F.coalesce("use_set", empty).alias("u"))
    return _per_graph(sets, ["node_id", "d", "u"], cfg, walk, EDGES)


def to_node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Graph key and ``relate_graph``: nodes and links as arrays, sorted."""
    return file_graphs(nodes, edges).select(*FILE, node_link(F.col("nodes"), F.col("links")).alias("relate_graph"))


def node_link(nodes: Column, links: Column) -> Column:
    return F.struct(F.lit(True).alias("directed"), F.lit(True).alias("multigraph"), nodes.alias("nodes"), links.alias("links"))


def from_node_link(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of nested records."""
    nodes = records.select(*FILE, F.inline("relate_graph.nodes")).withColumnRenamed("id", "node_id")
    edges = records.select(*FILE, F.inline("relate_graph.links")).withColumnsRenamed({"source": "src", "target": "dst", "key": "edge_type"})
    return nodes, edges
