"""From graph records of files to samples of commits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from defectflow.diffs import COMMIT, FILE
from defectflow.text import normalize_code

# Codes of edge types.
EDGE_CODES = {"CFG": 0, "CDG": 1, "DDG": 2}
METRICS = ["ns", "nd", "nf", "entropy", "la", "ld", "lt", "fix", "ndev", "age", "nuc", "exp", "rexp", "sexp"]


def reindex_nodes(nodes: DataFrame) -> DataFrame:
    """``nodes`` (with ``file_ord``) with ``node_ix``: its place from 0 among the nodes of its commit, by file and node."""
    return nodes.withColumn("node_ix", F.row_number().over(W.partitionBy(*COMMIT).orderBy("file_ord", "file_path", "node_id")) - 1)


def commit_edges(indexed: DataFrame, edges: DataFrame, compat: bool = False) -> DataFrame:
    """``src_ix, dst_ix, type_code``; ``compat``: each edge as often as its pair has parallel edges."""
    ix = indexed.select(*FILE, "node_id", "node_ix")
    out = edges
    for end in ("src", "dst"):
        out = out.join(ix.withColumnsRenamed({"node_id": end, "node_ix": f"{end}_ix"}), [*FILE, end])
    code = F.coalesce(*(F.when(F.col("edge_type") == k, v) for k, v in EDGE_CODES.items()))
    out = out.select(*COMMIT, "src_ix", "dst_ix", code.alias("type_code"))
    if compat:
        n = F.count(F.lit(1)).over(W.partitionBy(*COMMIT, "src_ix", "dst_ix"))
        out = out.withColumn("n", n).withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")
    return out


def commit_node_marks(indexed: DataFrame, seeds: DataFrame, buggy: DataFrame) -> DataFrame:
    """``diff_idx`` and ``buggy_idx`` of each commit, sorted."""
    mark = lambda rows, name: rows.select(*FILE, "node_id").distinct().withColumn(name, F.lit(True))
    ix = indexed.select(*FILE, "node_id", "node_ix").join(mark(seeds, "d"), [*FILE, "node_id"], "left").join(mark(buggy, "b"), [*FILE, "node_id"], "left")
    places = lambda c: F.sort_array(F.collect_list(F.when(F.col(c), F.col("node_ix"))))
    return ix.groupBy(*COMMIT).agg(places("d").alias("diff_idx"), places("b").alias("buggy_idx"))


def join_changes(commits: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commits with their change, and those without one."""
    return commits.join(changes, "commit_hash"), commits.join(changes, "commit_hash", "left_anti")


def _tokens(c: Column) -> Column:
    return F.filter(F.split(normalize_code(F.coalesce(c, F.lit(""))), " "), lambda t: t != "")


def batch_tokenizer(tokenize: Callable[[list[str]], list[list[str]]]) -> Callable[[Column], Column]:
    """From a Python function over many texts, such as a subword tokenizer's, to one from a column of arrays of texts to arrays of arrays of tokens; a batch of rows is one call."""

    @F.pandas_udf(ArrayType(ArrayType(StringType())))
    def run(rows: pd.Series) -> pd.Series:
        found = tokenize([t for texts in rows for t in texts])
        ends = np.cumsum([len(texts) for texts in rows]).tolist()
        return pd.Series([found[a:b] for a, b in zip([0, *ends], ends, strict=False)])

    return run


def diff_tokens(changes: DataFrame, max_len: int = 512, msg_len: int = 64, tokenizer: Callable[[Column], Column] = _tokens, tokenize: Callable[[list[str]], list[list[str]]] | None = None) -> DataFrame:
    """``changes`` with ``tokens`` (message, added and removed lines between markers, padded) and ``attention_mask``. ``tokenizer``: string column to array column; or ``tokenize``: a Python function from normalized texts to their tokens."""
    lines = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    if tokenize:
        texts = F.transform(F.concat(F.array(F.coalesce("msg", F.lit(""))), lines("added_code"), lines("removed_code")), lambda t: normalize_code(F.coalesce(t, F.lit(""))))
        rows = changes.withColumn("__tokens", batch_tokenizer(tokenize)(texts))
        n = F.size(lines("added_code"))
        msg, added, removed = F.get("__tokens", F.lit(0)), F.slice("__tokens", F.lit(2), n), F.slice("__tokens", n + 2, F.size(lines("removed_code")))
    else:
        rows, msg, added, removed = changes, tokenizer(F.col("msg")), F.transform(lines("added_code"), tokenizer), F.transform(lines("removed_code"), tokenizer)
    joined = lambda parts, marker: F.flatten(F.transform(parts, lambda x, i: F.concat(F.when(i > 0, F.array(F.lit(marker))).otherwise(F.array().cast("array<string>")), x)))
    body = F.concat(F.slice(msg, 1, msg_len), F.array(F.lit("[ADD]")), joined(added, "[ADD]"), F.array(F.lit("[DEL]")), joined(removed, "[DEL]"))
    full = F.concat(F.array(F.lit("[CLS]")), F.slice(body, 1, max_len - 2), F.array(F.lit("[SEP]")))
    out = rows.withColumn("tokens", full).drop("__tokens")
    pad = F.lit(max_len) - F.size("tokens")
    mask = F.concat(F.transform("tokens", lambda _: F.lit(1)), F.array_repeat(F.lit(0), pad))
    return out.withColumn("attention_mask", mask).withColumn("tokens", F.concat("tokens", F.array_repeat(F.lit("[PAD]"), pad)))


def token_ids(rows: DataFrame, vocabulary: DataFrame, keys: list[str], unknown: int = 0) -> DataFrame:
    """``ids`` of each row's ``tokens``, in order. ``vocabulary``: ``token, id``; Spark broadcasts it if it is small."""
    at = rows.select(*keys, F.posexplode("tokens").alias("pos", "token")).join(vocabulary, "token", "left")
    return at.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(unknown)).alias("id"))))["id"].alias("ids"))


#: Numbers of a task's partial results before they are sent on.
HELD = 1 << 22


def _fold(how: np.ufunc, keys: list[str], width: int, in_order: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each key from rows ``keys, __key, vector``: batch by batch in numpy, held over batches. ``in_order``: equal keys follow each other, so none is sent on before its last row."""
    most = max(1, HELD // width)

    def sent(held: dict, parts: list[pa.RecordBatch], total: np.ndarray) -> pa.RecordBatch:
        names = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1, dtype=np.int32) * width), pa.array(total[: len(held)].ravel()))
        return pa.RecordBatch.from_arrays([*names.columns, vectors], names=[*names.schema.names, "vector"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, total = {}, [], np.zeros((0, width))
        for whole in batches:
            for start in range(0, len(whole), most):
                batch = whole.slice(start, most)
                coded = batch.column("__key").dictionary_encode()
                code, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
                order = np.argsort(code, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
                mine = how.reduceat(batch.column("vector").flatten().to_numpy().reshape(len(batch), width)[order], first, axis=0)
                if in_order and held and len(held) >= most and names[0] not in held:
                    yield sent(held, parts, total)
                    held, parts, total = {}, [], np.zeros((0, width))
                if not in_order and len(held) + len(names) > 2 * most:
                    yield sent(held, parts, total)
                    held, parts, total = {}, [], np.zeros((0, width))
                new = np.array([n not in held for n in names])
                at = np.array([held.setdefault(n, len(held)) for n in names])
                parts.append(batch.select([*keys, "__key"]).take(pa.array(order[first][new])))
                if len(held) > len(total):
                    total = np.concatenate([total, np.empty((len(held), width))])
                total[at[new]] = mine[new]
                total[at[~new]] = how(total[at[~new]], mine[~new])
        if held:
            yield sent(held, parts, total)

    return run


def _pooled(rows: DataFrame, keys: list[str], width: int, how: np.ufunc) -> DataFrame:
    """``keys, vector``: the sum or maximum (``how``) of ``vector`` (``width`` numbers, none null) in two levels: in the tasks, then of one row for each key and task. Vectors stay arrays all the way."""
    named = rows.select(*keys, F.to_json(F.struct(*keys)).alias("__key"), F.col("vector").cast("array<double>").alias("vector"))
    schema = StructType([*named.schema.fields[:-1], StructField("vector", ArrayType(DoubleType()))])
    part = named.mapInArrow(_fold(how, keys, width, False), schema)
    return part.repartition("__key").sortWithinPartitions("__key").mapInArrow(_fold(how, keys, width, True), schema).select(*keys, "vector")


def mean_pool(rows: DataFrame, keys: list[str], dims: int) -> DataFrame:
    """``vector``: mean of the ``embedding`` of tokens whose ``mask`` is 1; zeros if there are none. A token without embedding counts as masked."""
    mask = F.when(F.col("embedding").isNotNull(), F.coalesce(F.col("mask"), F.lit(0))).otherwise(0).cast("double")
    own = F.transform(F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), dims)), lambda x: F.coalesce(x, F.lit(0.0)).cast("double"))
    both = rows.select(*keys, own.alias("own"), mask.alias("m")).select(*keys, F.concat(F.transform("own", lambda x: x * F.col("m")), F.array("m")).alias("vector"))
    summed = _pooled(both, keys, dims + 1, np.add).withColumn("n", F.greatest(F.get("vector", F.lit(dims)), F.lit(1e-9)))
    return summed.select(*keys, F.transform(F.slice("vector", 1, dims), lambda x: x / F.col("n")).alias("vector"))


def typed_neighbor_sum(vectors: DataFrame, edges: DataFrame, type_weights: dict[int, list[float]]) -> DataFrame:
    """One message round: source vectors times their edge type's weights, summed at the target; zeros without edges. Edges of other types, and null vectors, send nothing.

    ``vectors``: ``commit_hash, node_ix, vector``; ``edges``: ``commit_hash, src_ix, dst_ix, type_code``."""
    dims = len(next(iter(type_weights.values())))
    weights = F.create_map(*(x for k, w in type_weights.items() for x in (F.lit(k), F.lit(list(map(float, w))))))
    sent = edges.join(vectors.withColumnRenamed("node_ix", "src_ix"), ["commit_hash", "src_ix"])
    product = F.zip_with(F.col("vector"), F.element_at(weights, F.col("type_code")), lambda x, w: F.coalesce(x * w, F.lit(0.0)))
    got = _pooled(sent.select("commit_hash", F.col("dst_ix").alias("node_ix"), product.alias("vector")).where("vector is not null"), ["commit_hash", "node_ix"], dims, np.add)
    zeros = F.transform(F.col("own"), lambda _: F.lit(0.0).cast("double"))
    return vectors.withColumnRenamed("vector", "own").join(got, ["commit_hash", "node_ix"], "left").select("commit_hash", "node_ix", F.coalesce("vector", zeros).alias("vector"))


def max_pool_marked(vectors: DataFrame, marks: DataFrame, commits: DataFrame, dims: int) -> DataFrame:
    """Element-wise maximum over each commit's marked nodes (``commit_hash, node_ix``); zeros for a commit without one. Null vectors and numbers are passed over."""
    mine = vectors.where("vector is not null").join(marks.select("commit_hash", "node_ix").distinct(), ["commit_hash", "node_ix"], "left_semi")
    low = F.lit(float("-inf"))
    top = _pooled(mine.select("commit_hash", F.transform("vector", lambda x: F.coalesce(x.cast("double"), low)).alias("vector")), ["commit_hash"], dims, np.maximum)
    top = top.withColumn("vector", F.transform("vector", lambda x: F.when(x == low, 0.0).otherwise(x)))
    return commits.select("commit_hash").distinct().join(top, "commit_hash", "left").withColumn("vector", F.coalesce("vector", F.array_repeat(F.lit(0.0), dims)))


def change_features(commits: DataFrame) -> DataFrame:
    """The change metrics as doubles (``fix``: 0 or 1) and ``loc``."""
    fix = F.when(F.lower(F.col("fix").cast("string")).isin("true", "1", "1.0"), 1.0).otherwise(0.0)
    out = commits.select("commit_hash", *((fix if c == "fix" else F.col(c).cast("double")).alias(c) for c in METRICS))
    return out.withColumn("loc", F.col("la") + F.col("ld"))
