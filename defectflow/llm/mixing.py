"""Mixing sources to target weights by blocks and pseudorandom index permutations.

The words of each source are packed, in a fixed order of documents, into blocks of ``block_words``. The mix has as many slots as the targets have blocks, in output shards of
``shard_slots`` slots. All slots of all sources are dealt over the places of the shards by one keyed permutation of their numbers: each shard's counts of sources are then a multinomial draw
conditional on the sources' totals, so shards have a fixed size and totals meet the targets (``shard_counts`` lists the draws). A source's slots are numbered through; slot j of turn j div B maps
through that turn's permutation of the source's B blocks. Permutations are keyed Feistel networks over index bits with cycle walking, so no table is held and each slot is made by itself, in
any task. Blocks join documents by index.

A document's place in its source is a running sum by ranges of (source, document), so a hot source is spread like the others. The targets stop at twice the size, so a block is used at most twice.
Targets are found by passes over the table of sources, of which only sums reach the driver. The same rows and seed give the same mix.

Defined results: a null or empty text has size 0 and takes nothing; a null source is a source of its own, last by order; documents are placed by
``doc_id``, then size, then the text's hash; repeated rows each have their words; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectflow.llm.common import let, look_up, materialize, mix, n_words, words
from defectflow.prefix import prefix_sum

BLOCK_WORDS = 64
SHARD_SLOTS = 4096
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: Slots that a task makes at a time.
RUN_SLOTS = 20_000
MOST_TASKS = 100_000


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed pseudorandom permutation of range(n): Feistel rounds on the index bits; values of n or more walk on."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    value = index.astype(np.uint64)
    todo = np.arange(len(value))
    while len(todo):
        left, right = value[todo] >> np.uint64(half), value[todo] & mask
        for r in range(4):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
            left, right = right, left ^ (mix(right ^ salt) & mask)
        value[todo] = left << np.uint64(half) | right
        todo = todo[value[todo] >= n]
    return value.astype(np.int64)


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target, place, n``: a row for each source by code point, null last; ``n``: its rows.

    Shares are level * weight, stopped at ``most`` sizes. The level rises from pass to pass, as sources stop and leave their excess, until none is above; each pass is a sum over sources."""
    named = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = [F.col("source").isNull(), F.col("source")]
    placed = prefix_sum(named, order, {"place": F.lit(1).cast("long")}).withColumn("place", F.col("place") - 1)
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod("place", F.lit(len(weights))).cast("int"))
    table = materialize(placed.withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(float(most))}), "sources")
    total, level = share * (table.agg(F.sum("source_size")).first()[0] or 0), 0.0
    while True:
        stopped = F.col("cap") <= F.lit(level) * F.col("weight")
        held, free = table.agg(F.coalesce(F.sum(F.when(stopped, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0.0))).first()
        new = (total - held) / free if free else level
        if new <= level:
            break
        level = new
    return table.withColumn("target", F.least("cap", F.lit(level) * F.col("weight"))).select("source", "source_size", "target", "place", "n")


def _key(*parts: int) -> int:
    out = 0
    for p in parts:
        out = int(mix(np.array([(out * 0x9E3779B97F4A7C15 + p + 1) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])
    return out


def _slots(seed: int, total: int, shard_slots: int):
    """Shard, slot, block and turn of runs of a source's slots, numbered among all slots."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for s in frame.itertuples():
                own = np.arange(s.begin, s.end)
                at = permute(own + s.first, total, _key(seed))
                block = np.empty(len(own), np.int64)
                for turn in range(s.begin // s.blocks, (s.end - 1) // s.blocks + 1):
                    here = own // s.blocks == turn
                    block[here] = permute(own[here] % s.blocks, s.blocks, _key(seed, s.place + 1, turn + 1))
                yield pd.DataFrame({"place": s.place, "shard": at // shard_slots, "slot": at % shard_slots, "block": block, "turn": own // s.blocks})

    return run


def slots(targets: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> DataFrame:
    """The mix: ``place`` (source), ``shard``, ``slot``, ``block``, ``turn``. Runs of ``RUN_SLOTS`` slots of a source are dealt over the tasks."""
    blocks = F.ceil(F.col("source_size") / block_words)
    wanted = targets.where("source_size > 0").select("place", blocks.alias("blocks"), F.round(F.col("target") / F.col("source_size") * blocks).cast("long").alias("slots")).where("slots > 0")
    first = prefix_sum(wanted, [F.col("place")], {"through": F.col("slots")})
    first = materialize(first.select("place", "blocks", "slots", (F.col("through") - F.col("slots")).alias("first")), "slots")
    total = first.agg(F.sum("slots")).first()[0] or 0
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(RUN_SLOTS).cast("long")))
    runs = first.withColumn("begin", begin).withColumn("end", F.least("slots", F.col("begin") + RUN_SLOTS))
    tasks = max(1, min(-(-total // RUN_SLOTS), MOST_TASKS))
    return runs.repartition(tasks, "place", "begin").mapInPandas(_slots(seed, total, shard_slots), "place long, shard long, slot long, block long, turn long")


def shard_counts(targets: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> DataFrame:
    """``shard, place, n``: the drawn counts of each source in each output shard."""
    return slots(targets, block_words, shard_slots, seed).groupBy("shard", "place").agg(F.count(F.lit(1)).alias("n"))


def placed(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``sized`` (with ``h``, the text's hash, and ``row``) with its source's row of ``targets`` and ``begin``: the words of its source before it."""
    summed = prefix_sum(sized, [F.col(c) for c in ("doc_id", "size", "h", "row")], {"through": F.col("size")}, ["source"])
    found = summed.withColumn("begin", F.col("through") - F.col("size")).drop("through")
    # A null source is told apart by a flag, so that the join has one plain key.
    key = F.concat(F.col("source").isNull().cast("string"), F.coalesce("source", F.lit("")))
    named = targets.select(key.alias("__source"), "source_size", "target", "place", "n")
    found = materialize(found.withColumn("__source", key), "placed", n=F.count(F.lit(1)))
    return look_up(found, named, "__source", found.totals.get("n") or 0).drop("__source")


def _sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, h`` (hash of the whole row: rows that agree in it are interchangeable) and ``row``."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64(*(docs[c] for c in docs.columns)).alias("h"))
    return materialize(sized.withColumn("row", F.monotonically_increasing_id()), "sizes")


def _spans(at: DataFrame, block_words: int) -> DataFrame:
    """A row for each block that a document reaches into: ``block``, and the words ``from_word`` (counted from 0) and ``n_here`` of the document."""
    last = (F.col("begin") + F.col("size") - 1)
    spans = at.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block_words), F.floor(last / block_words))))
    start = F.greatest(F.col("block") * block_words, F.col("begin"))
    stop = F.least((F.col("block") + 1) * block_words, F.col("begin") + F.col("size"))
    return spans.withColumn("from_word", start - F.col("begin")).withColumn("n_here", stop - start)


def mix_sources(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 7, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of each row of ``docs`` (``doc_id`` integer, ``text``, ``source``)."""
    sized = _sized(docs)
    targets = source_targets(sized, weights, share)
    used = slots(targets, block_words, seed=seed).groupBy("place", "block").agg(F.count(F.lit(1)).alias("uses"))
    at = materialize(placed(sized, targets), "targets")
    taken = _spans(at.select("row", "place", "begin", "size"), block_words).join(used.hint("merge"), ["place", "block"]).groupBy("row").agg(F.sum(F.col("n_here") * F.col("uses")).alias("taken"))
    return at.join(taken.hint("merge"), "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 7, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, shard_column: str | None = None) -> DataFrame:
    """The mix as documents with their own columns: for each turn through a source, the words of each document that this turn took, in order.

    A document that a turn takes whole keeps its text as it is; of others the taken words remain, joined by blanks. ``n_chars``, if there, is the new length.
    ``shard_column``: a further column with the output shard of the document's first taken block."""
    sized = _sized(docs)
    targets = source_targets(sized, weights, share)
    chosen = slots(targets, block_words, seed=seed).select("place", "block", "turn", "shard")
    spans = _spans(placed(sized, targets).select("doc_id", "h", "row", "place", "begin", "size"), block_words)
    piece = F.struct("from_word", "n_here")
    runs = spans.join(chosen.hint("merge"), ["place", "block"]).groupBy("doc_id", "h", "row", "size", "turn").agg(F.sum("n_here").alias("n"), F.sort_array(F.collect_list(piece)).alias("runs"), F.min_by("shard", "from_word").alias("shard"))
    runs = runs.select(*(F.col(c).alias(f"__{c}") for c in ("doc_id", "h", "n", "size", "runs", "shard")))
    mine = docs.withColumn("__key", F.xxhash64(*(docs[c] for c in docs.columns)))
    if not sized.groupBy("doc_id", "h").count().where("count > 1").isEmpty():  # equal rows: one of them meets the runs of all
        mine = mine.dropDuplicates(["doc_id", "__key"])
    joined = mine.join(runs.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("__doc_id")) & (F.col("__key") == F.col("__h")))
    return _cut(joined, docs.columns, shard_column)


def _cut(joined: DataFrame, columns: list[str], shard_column: str | None) -> DataFrame:
    taken = let(words(F.col("text")), lambda w: F.array_join(F.flatten(F.transform(F.col("__runs"), lambda r: F.slice(w, (r["from_word"] + 1).cast("int"), r["n_here"].cast("int")))), " "))
    new = F.when(F.col("__n") == F.col("__size"), F.col("text")).otherwise(taken)
    out = joined.withColumn("text", new)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*columns, *([F.col("__shard").alias(shard_column)] if shard_column else []))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
