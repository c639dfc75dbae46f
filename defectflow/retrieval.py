"""Knowledge rows and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from defectflow import slicing
from defectflow.diffs import COMMIT, FILE
from defectflow.labels import filter_commits
from defectflow.shared import materialize, release
from defectflow.text import squeeze_whitespace

#: Numbers of a block of vectors (of queries a quarter), the most pivots (they go to every task), and vectors that are compared at a time.
BLOCK, PIVOTS, STRIPE = 1 << 22, 1024, 2000


def embed(df: DataFrame, text_col: str, encoder: Callable[[list[str]], np.ndarray], batch: int = 64) -> DataFrame:
    """``df`` with ``embedding``, the encoder's vectors of the squeezed text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = [encoder(frame["__text"].iloc[i : i + batch].tolist()) for i in range(0, len(frame), batch)]
            yield frame.drop(columns="__text").assign(embedding=[v.tolist() for part in parts for v in part])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.withColumn("__text", squeeze_whitespace(F.coalesce(text_col, F.lit("")))).mapInPandas(run, f"{schema}, embedding array<float>")


def _assigned(rows: DataFrame, pivots: Broadcast) -> DataFrame:
    """``id, embedding`` with the number of the nearest pivot and the distance to it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.stack(frame["embedding"]) if len(frame) else np.zeros((0, pivots.value.shape[1]))
            near = _squares(x, pivots.value).argmin(axis=1)
            yield frame.assign(pivot=near, far=np.sqrt(((x - pivots.value[near]) ** 2).sum(axis=1)))

    typed = rows.where("embedding is not null").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return typed.mapInPandas(run, "id long, embedding array<double>, pivot int, far double")


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by one matrix product; right but for rounding."""
    return (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)


def _blocks(rows: DataFrame, counts: DataFrame, size: int, more: Sequence[str] = ()) -> DataFrame:
    """Rows of a pivot in blocks of about ``size`` by hash, packed into arrays. ``counts`` has at most a row for each pivot."""
    dealt = rows.join(F.broadcast(counts), "pivot").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / size)).cast("int"))
    listed = F.sort_array(F.collect_list(F.struct("id", "embedding", *more))).alias("rows")
    packed = dealt.groupBy("pivot", "block").agg(listed)
    return packed.select("pivot", "block", F.col("rows.id").alias("ids"), F.flatten("rows.embedding").alias("values"), *(F.col(f"rows.{c}").alias(c) for c in more))


def _meet(asked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """``query_id, id, square``: of each pair of a query block (``q_ids, q_values`` with the ``pivot, block`` it asks) and that block, each query's best ``k``."""
    pairs = asked.join(blocks.hint("merge"), ["pivot", "block"])
    return pairs.select("q_ids", "q_values", "ids", "values").mapInPandas(_nearest(k), "query_id long, id long, square double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("square", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn(queries: DataFrame, vectors: DataFrame, k: int, block: int = BLOCK, most_pivots: int = PIVOTS) -> DataFrame:
    """``query_id, id, distance, rank``: the ``k`` nearest by L2 of each query (both ``id, embedding``; distinct ids), ties by id; exact.

    Vectors are grouped around pivots, random ones of their own, at most ``most_pivots``, and dealt in blocks of about ``block`` numbers. A query first meets the blocks of its own pivot; the k-th distance
    there is a bound. By the triangle inequality a group whose nearest member can't be within it is left out: a query goes on only to blocks of groups that can hold a neighbour. Rows without a vector are left out."""
    spark = queries.sparkSession
    total = vectors.where("embedding is not null").count()
    picked = vectors.where("embedding is not null").orderBy(F.xxhash64("id"), "id").limit(min(most_pivots, 1 + total * _width(vectors) // block)).select(F.col("embedding").cast("array<double>")).collect()
    if not picked:
        return spark.createDataFrame([], "query_id long, id long, distance double, rank int")
    pivots = spark.sparkContext.broadcast(np.array([r[0] for r in picked]))
    width = pivots.value.shape[1]
    mine = materialize(_assigned(vectors, pivots), "vectors", free=False)
    asking = materialize(_assigned(queries, pivots), "queries", free=False)
    groups = mine.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("least"), F.max("far").alias("most")).collect()  # a row for each pivot
    size, asked_size = max(1, block // width), max(1, block // 4 // width)
    bounds = np.full((3, len(picked)), np.inf)
    for g in groups:
        bounds[:, g["pivot"]] = g["least"], g["most"], -(-g["n"] // size)
    held = spark.sparkContext.broadcast(bounds)
    counts = spark.createDataFrame([(g["pivot"], g["n"]) for g in groups], "pivot int, n long")
    blocks = materialize(_blocks(mine, counts, size), "blocks", free=False)
    asked = asking.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))

    parts = F.broadcast(counts.select("pivot", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / size) - 1).cast("int"))).alias("ask")))
    own = _blocks(asking, asked, asked_size).join(parts, "pivot").select("pivot", F.col("ask").alias("block"), F.col("ids").alias("q_ids"), F.col("values").alias("q_values"))
    near = materialize(_best(_meet(own, blocks, k), k), "near", free=False)
    limits = near.groupBy(F.col("query_id").alias("id")).agg(F.max("square").alias("square"), F.count(F.lit(1)).alias("found"))
    limited = asking.join(limits, "id", "left").withColumn("limit", F.when(F.col("found") >= k, F.sqrt("square")).otherwise(float("inf")))
    further = _blocks(limited.select("id", "embedding", "pivot", "limit"), asked, asked_size, ["limit"]).mapInPandas(_asks(pivots, held), "pivot int, block int, q_ids array<long>, q_values array<double>")
    out = _best(_meet(further, blocks, k).unionByName(near.drop("rank")), k).select("query_id", "id", F.sqrt("square").alias("distance"), "rank")
    out = materialize(out, "neighbours", free=False)
    release(mine, asking, blocks, near)
    return out


def _width(vectors: DataFrame) -> int:
    first = vectors.where("embedding is not null").select(F.size("embedding")).first()
    return first[0] if first else 1


def _asks(pivots: Broadcast, held: Broadcast):
    """From blocks of queries with their limits to the blocks of other groups that can hold a neighbour of them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least, most, parts = held.value
        for frame in frames:
            for r in frame.itertuples():
                ids = np.asarray(r.ids)
                q = np.asarray(r.values).reshape(len(ids), -1)
                away = np.sqrt(np.maximum(_squares(q, pivots.value), 0))
                slack = 1e-6 * (1 + away + np.where(np.isfinite(most), most, 0))  # far above rounding
                can = np.isfinite(most) & (np.maximum(away - most, least - away) - slack <= np.asarray(r.limit)[:, None])
                can[:, r.pivot] = False
                for p in np.flatnonzero(can.any(axis=0)).tolist():
                    some = can[:, p]
                    n = int(parts[p])
                    one = (p, ids[some], q[some].ravel())
                    yield pd.DataFrame([(p, b, *one[1:]) for b in range(n)], columns=["pivot", "block", "q_ids", "q_values"])

    return run


def nearest(q: np.ndarray, v: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, names and exact squared distances of each query's best ``k``, ties by name.

    A matrix product finds those that can be among them, but for rounding; only their distances are computed exactly. Vectors come ``STRIPE`` at a time."""
    at, best, square = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for start in range(0, len(v), STRIPE):
        part = v[start : start + STRIPE]
        near = _squares(q, part)
        last = min(k, len(part)) - 1
        reach = np.partition(near, last, axis=1)[:, last] + 1e-9 * ((q * q).sum(axis=1) + (part * part).sum(axis=1).max())
        i, j = np.nonzero(near <= reach[:, None])
        step = max(1, BLOCK // q.shape[1])
        exact = [((q[i[s : s + step]] - part[j[s : s + step]]) ** 2).sum(axis=1) for s in range(0, len(i), step)]
        at, best, square = np.r_[at, i], np.r_[best, names[start + j]], np.concatenate([square, *exact])
        order = np.lexsort((best, square, at))
        at, best, square = at[order], best[order], square[order]
        first = np.searchsorted(at, at)
        keep = np.arange(len(at)) - first < k
        at, best, square = at[keep], best[keep], square[keep]
    return at, best, square


def _nearest(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for pair in frame.itertuples():
                ids, names = np.asarray(pair.q_ids), np.asarray(pair.ids)
                at, best, square = nearest(np.asarray(pair.q_values).reshape(len(ids), -1), np.asarray(pair.values).reshape(len(names), -1), names, k)
                yield pd.DataFrame({"query_id": ids[at], "id": best, "square": square})

    return run


def buggy_knowledge(buggy: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``repo, hash, file_path, slicing, diff, desc``: for each file with buggy lines (``line_no``, ``code`` with its marker) the slice around them, and their distinct texts in order; no description yet.

    Each input is shuffled once, by file; slice and text come from the arrays of a file's row."""
    listed = F.sort_array(F.collect_list(F.struct("line_no", "code")))
    return file_knowledge(buggy.groupBy(*FILE).agg(listed.alias("changed")).join(slicing.file_graphs(nodes, edges), FILE, "left"))


def file_knowledge(files: DataFrame) -> DataFrame:
    """``buggy_knowledge`` of rows that hold a file each: ``changed`` (its buggy lines, sorted: ``line_no, code``), ``nodes`` and ``links`` (``slicing.file_graphs``). Nothing is shuffled."""
    cut = slicing.cut(F.col("nodes"), F.col("links"), F.col("changed.line_no"), F.array().cast("array<int>"))
    known = files.withColumns({c: F.coalesce(c, F.array().cast(files.schema[c].dataType)) for c in ("nodes", "links")}).withColumn("cut", cut)
    return known.select(
        F.col("project").alias("repo"), F.col("commit_hash").alias("hash"), "file_path", slicing.render_cut(F.col("nodes"), F.col("cut.nodes")).alias("slicing"),
        F.array_distinct("changed.code").alias("diff"), F.lit("").alias("desc"),
    )


#: The description of clean commits, and the longest slice that is kept.
CLEAN, LONGEST_SLICE = "This commit does not introduce any bugs or issues.", 18_000


def clean_knowledge(commits: DataFrame, slices: DataFrame) -> DataFrame:
    """``repo, hash, slicing, diff, desc`` of clean commits: the slice and added codes of the commit's first file (``slices``: commit key, ``file_ord``, ``slice``, ``add_codes``), if it has 1 to ``LONGEST_SLICE`` characters."""
    first = slices.groupBy(*COMMIT).agg(F.min_by(F.struct("slice", "add_codes"), "file_ord").alias("f"))
    out = filter_commits(commits, buggy=False).select(*COMMIT).distinct().join(first, COMMIT)
    kept = out.where(F.length("f.slice").between(1, LONGEST_SLICE))
    return kept.select(F.col("project").alias("repo"), F.col("commit_hash").alias("hash"), F.col("f.slice").alias("slicing"), F.col("f.add_codes").alias("diff"), F.lit(CLEAN).alias("desc"))
