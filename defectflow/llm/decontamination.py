"""Benchmark decontamination: BM25 index of test items, block-max WAND, then overlap of question and answer.

The test items are the indexed documents, every training passage is a query. Impacts are BM25 weights divided by the item's score of itself, so a
score of 1 is a passage with all of the item's words, whatever its length, and one threshold serves all items. Document frequencies and the mean length
come from all items, counted by Spark; that is all by which items influence each other. Items are searched by length class (the next power of two of their words, ``STRIDE`` at least): passages are windows of two
strides, a stride apart, where a stride is the class's length, so each place of an item lies whole in some passage, and an item's passages depend on no other item. Bounds come first: a passage whose terms' highest
impacts, over all items and then over each of at most ``COARSE`` ranges of items, sum below the threshold can't reach it and isn't searched; the others go through block-max WAND, which skips ranges and blocks of
items by their highest impact. All items at or above the threshold are verified in the passage: of the question's
five-word shingles at least 0.8, and of the answer's words at least 0.8. The answer is an item's last sentence, the question what is before it
(an item of one sentence: its last quarter).

The index is built in tasks, as packed blocks of about ``BLOCK_BYTES`` of one class each, in a written table. Blocks of up to that size together are broadcast for a pass over the documents; more items take more passes, each
with its own broadcast, which is freed when its result is written.

Defined results: null or empty items match nothing, null or empty texts have no passage; copies of a document or an item are each found; a null ``doc_id`` or
``item_id`` is reported as null; empty tables give an empty result; further columns don't matter, and ``decontaminate`` returns them.
"""

from __future__ import annotations

import functools
import math
import pickle
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectflow.llm.common import materialize, release
from defectflow.prefix import prefix_sum

K1, B = 1.2, 0.75
THRESHOLD = 0.5
SHINGLE = 5
OVERLAP = 0.8
STRIDE = 64
BLOCK_BYTES = 8_000_000
POSTING_BLOCK = 32
#: Ranges of items for which a passage's bound is summed first.
COARSE = 64
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_MARKS = bytes(32 if chr(c) in "\"'`.,;:!?()[]{}<>#*$%&|/\\-_=+~^@" else c for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return text.lower().encode("utf-8", "replace").translate(_MARKS).split() if text else []


def shingles(words: list[bytes], size: int = SHINGLE) -> set:
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def parts(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item."""
    sentences = [t for s in _SENTENCE.split(text) if (t := terms(s))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = terms(text)
    cut = len(words) - max(1, len(words) // 4)
    return (words[:cut], words[cut:]) if cut else (words, words)


class Index:
    """Inverted index of one block of items of one length class; impacts are already divided by the item's own score."""

    def __init__(self, stride: int, names: list, texts: list[str], vocabulary: list[bytes], bounds: np.ndarray, items: np.ndarray, impacts: np.ndarray, threshold: float):
        self.stride, self.names, self.texts, self.threshold = stride, names, texts, threshold
        self.vocabulary = {w: i for i, w in enumerate(vocabulary)}
        ends = bounds.tolist()
        self.items = [items[x:y].tolist() for x, y in zip(ends, ends[1:], strict=False)]
        self.impacts = [impacts[x:y].tolist() for x, y in zip(ends, ends[1:], strict=False)]
        self.tops = np.array([max(x) for x in self.impacts] + [0.0])  # the last: terms that no item has
        self.blocks = [[max(x[i : i + POSTING_BLOCK]) for i in range(0, len(x), POSTING_BLOCK)] for x in self.impacts]
        self.width = -(-len(names) // COARSE)
        self.coarse = np.zeros((len(self.tops), -(-len(names) // self.width)), np.float32)
        np.maximum.at(self.coarse, (np.repeat(np.arange(len(self.items)), np.diff(bounds)), items // self.width), impacts)
        self.part = functools.lru_cache(4096)(self._part)

    def _part(self, item: int) -> tuple[set, set]:
        question, answer = parts(self.texts[item])
        return shingles(question), set(answer)

    def search(self, query: list[int], ranges: list[int] | None = None) -> list[tuple[int, float]]:
        """Block-max WAND: every item whose impacts over the distinct terms sum to the threshold or more. ``ranges``: those that can reach it, in order; all others are skipped."""
        at = {t: 0 for t in query}
        found, floor, top = [], self.threshold - 1e-9, self.tops
        begins = [r * self.width for r in ranges] if ranges is not None else [0]
        ends = [x + self.width for x in begins] if ranges is not None else [len(self.names)]
        reach = 0

        def forward(target: int) -> list[int]:
            for t in live:
                if self.items[t][at[t]] < target:
                    at[t] = bisect_left(self.items[t], target, at[t])
            return sorted((t for t in live if at[t] < len(self.items[t])), key=lambda t: self.items[t][at[t]])

        live = list(query)
        live = forward(begins[0]) if begins else []
        while live:
            bound, pivot = 0.0, -1
            for i, t in enumerate(live):
                bound += top[t]
                if bound >= floor:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = self.items[live[pivot]][at[live[pivot]]]
            while reach < len(ends) and ends[reach] <= item:
                reach += 1
            if reach == len(ends):
                break
            if item < begins[reach]:
                live = forward(begins[reach])
                continue
            while pivot + 1 < len(live) and self.items[live[pivot + 1]][at[live[pivot + 1]]] == item:
                pivot += 1
            near = 0.0
            ahead = self.items[live[pivot + 1]][at[live[pivot + 1]]] if pivot + 1 < len(live) else math.inf
            for t in live[: pivot + 1]:
                block = bisect_left(self.items[t], item, at[t]) // POSTING_BLOCK
                if block < len(self.blocks[t]):
                    near += self.blocks[t][block]
                    end = min((block + 1) * POSTING_BLOCK, len(self.items[t])) - 1
                    ahead = min(ahead, self.items[t][end] + 1)
            if near >= floor:
                score = 0.0
                for t in live[: pivot + 1]:
                    i = bisect_left(self.items[t], item, at[t])
                    if i < len(self.items[t]) and self.items[t][i] == item:
                        score += self.impacts[t][i]
                if score >= floor:
                    found.append((item, score))
                ahead = item + 1
            target = max(ahead, item + 1) if near < floor else ahead
            for t in live[: pivot + 1]:
                at[t] = bisect_left(self.items[t], target, at[t])
            live = sorted((t for t in live if at[t] < len(self.items[t])), key=lambda t: self.items[t][at[t]])
        return found

    def leaks(self, words: list[bytes]) -> dict[int, tuple[float, float, float]]:
        """Verified items of a text's terms: item's place to its best score, and the question's and answer's overlap there."""
        if not words:
            return {}
        none = len(self.tops) - 1
        get = self.vocabulary.get
        ids = np.array([get(w, none) for w in words])
        sums = np.r_[0.0, np.cumsum(self.tops[ids])]
        starts = np.arange(0, max(len(words) - self.stride, 1), self.stride)
        stops = np.minimum(starts + 2 * self.stride, len(words))
        out: dict[int, tuple[float, float, float]] = {}
        for k in np.flatnonzero(sums[stops] - sums[starts] >= self.threshold - 1e-6).tolist():
            a, b = starts[k], stops[k]
            distinct = np.sort(ids[a:b])
            distinct = distinct[np.r_[True, distinct[1:] != distinct[:-1]]]
            ranges = np.flatnonzero(np.add.reduce(self.coarse[distinct]) >= self.threshold - 1e-4)
            if not len(ranges):
                continue
            hits = self.search([t for t in distinct.tolist() if t != none], ranges.tolist())
            if not hits:
                continue
            here, grams = set(words[a:b]), shingles(words[a:b])
            for item, score in hits:
                q, w = self.part(item)
                asked = sum(self._has(g, grams, words[a:b]) for g in q) / len(q)
                answered = len(w & here) / len(w)
                if asked >= OVERLAP and answered >= OVERLAP:
                    out[item] = max(out.get(item, (0.0, 0.0, 0.0)), (round(score, 6), asked, answered))
        return out

    @staticmethod
    def _has(gram: tuple, grams: set, words: list[bytes]) -> bool:
        """A question of under five words is a shorter shingle."""
        n = len(gram)
        return gram in grams if n == SHINGLE else any(tuple(words[i : i + n]) == gram for i in range(len(words) - n + 1))


def weighted_terms(items: DataFrame) -> DataFrame:
    """(row, item_id, text, terms, impacts) of each item with a word; the statistics cover all items."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(words=[[w.decode("utf-8", "replace") for w in terms(t)] for t in frame["text"]])

    source = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("text is not null")
    named = source.withColumn("row", F.monotonically_increasing_id())
    listed = named.mapInPandas(run, "item_id long, text string, row long, words array<string>").where(F.size("words") > 0).withColumn("n", F.size("words"))
    about = listed.agg(F.count(F.lit(1)).alias("items"), F.avg("n").alias("mean"))
    counted = listed.select("row", "n", F.explode("words").alias("term")).groupBy("row", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("items") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    scored = counted.join(df, "term").join(F.broadcast(about), how="cross").withColumn("weight", weight)  # about: one row
    lists = scored.groupBy("row").agg(F.sum("weight").alias("self"), F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("terms"))
    return listed.select("row", "item_id", "text", "n").join(lists, "row")


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    """One block of items as arrays, pickled."""
    frame = frame.sort_values(["item_id", "text", "row"], na_position="last")
    vocabulary: dict[str, int] = {}
    terms_of = [[(vocabulary.setdefault(t["term"], len(vocabulary)), t["weight"]) for t in listed] for listed in frame["terms"]]
    term = np.array([t for one in terms_of for t, _ in one], np.int64)
    item = np.repeat(np.arange(len(frame)), [len(one) for one in terms_of])
    impact = np.array([w for one in terms_of for _, w in one]) / np.repeat(frame["self"].to_numpy(), [len(one) for one in terms_of])
    order = np.lexsort((item, term))
    bounds = np.r_[0, np.cumsum(np.bincount(term, minlength=len(vocabulary)))]
    names = [None if pd.isna(x) else int(x) for x in frame["item_id"]]
    stride = int(frame["stride"].iloc[0])
    packed = pickle.dumps((stride, names, frame["text"].tolist(), [w.encode("utf-8", "replace") for w in vocabulary], bounds, item[order].astype(np.int32), impact[order]))
    return pd.DataFrame({"stride": [stride], "block": [int(frame["block"].iloc[0])], "size": [len(packed)], "packed": [packed]})


def index_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``stride, block, size, packed``: the index in blocks, each built in one task from items of one class."""
    weighted = weighted_terms(items).withColumn("stride", F.greatest(F.lit(STRIDE), F.pow(2.0, F.ceil(F.log2("n") - 1e-9)).cast("int")))
    size = F.octet_length("text") + 40 * F.size("terms")
    numbered = prefix_sum(weighted.withColumn("bytes", size.cast("long")), [F.col("item_id"), F.col("text"), F.col("row")], {"through": F.col("bytes")}, ["stride"])
    blocked = numbered.withColumn("block", F.floor(F.col("through") / block_bytes))
    return materialize(blocked.groupBy("stride", "block").applyInPandas(_pack, "stride int, block long, size long, packed binary"), "index")


def passes(blocks: DataFrame, threshold: float, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[object, bool]]:
    """A broadcast of blocks of about ``block_bytes`` together for each pass over the documents, and whether it is the last. The driver holds the blocks of one pass."""
    listed = [(r["stride"], r["block"], r["size"]) for r in blocks.select("stride", "block", "size").orderBy("stride", "block").collect()]
    groups: list[list] = []
    for stride, block, size in listed:
        if not groups or sum(x[2] for x in groups[-1]) + size > block_bytes:
            groups.append([])
        groups[-1].append((stride, block, size))
    for i, group in enumerate(groups):
        chosen = functools.reduce(lambda x, y: x | y, ((F.col("stride") == s) & (F.col("block") == b) for s, b, _ in group))
        packed = [bytes(r["packed"]) for r in blocks.where(chosen).select("packed").collect()]
        yield blocks.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, packed, threshold)), i == len(groups) - 1


_LOADED: dict[str, list[Index]] = {}


def _indexes(shared) -> list[Index]:
    """The indexes of a broadcast; a Python worker keeps those of one."""
    name, packed, threshold = shared.value
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = [Index(*pickle.loads(p), threshold) for p in packed]
    return _LOADED[name]


LEAKS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and test item that it holds."""
    out = docs.sparkSession.createDataFrame([], LEAKS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    for shared, last in passes(index_blocks(items, block_bytes), threshold, block_bytes):
        found = texts.mapInArrow(_search(shared), LEAKS)
        if not last:
            found = materialize(found, "leaks")
            shared.destroy()
        out = out.unionByName(found)
    return out


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = _indexes(shared)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = terms(text.as_py())
                rows += [(doc_id, index.names[i], *found) for index in indexes for i, found in sorted(index.leaks(words).items())]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no test item, with their own columns; each is judged where it is, without a shuffle."""
    before = None
    for shared, last in passes(index_blocks(items, block_bytes), threshold, block_bytes):
        docs = docs.mapInArrow(_clean(shared), docs.schema)
        if not last:
            docs = materialize(docs, "clean")
            shared.destroy()
            if before is not None:
                release(before)
            before = docs
    return docs


def _clean(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = _indexes(shared)
        for batch in batches:
            texts = map(terms, batch.column("text").to_pylist())
            yield batch.filter(pa.array([not any(index.leaks(words) for index in indexes) for words in texts], pa.bool_()))

    return run


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
