"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is its letters in lower case, with one gap in place of whatever stands between two of them, at its start and at its end. Its features are all n-grams of ``ORDERS`` within a word and its
two gaps, hashed to ``BUCKETS``. Training counts the n-grams of every learning document by language and bucket, in dense vectors within a task and by a shuffled sum over tasks. The matrix of log-probabilities
(add-one smoothing, prior by documents) goes to the tasks as a broadcast, ``LANGUAGES`` languages at a time (16 MB), so its size doesn't depend on the corpus; texts are scored in numpy over batches.
Log-probabilities are whole numbers of ``1 / SCALE``: sums don't depend on the order of batches, and reruns agree. A text's score is the posterior probability of the predicted language.

Defined results: null text, or text without a letter: ``und``, score 0; also for all texts if nothing is learned. Equal posteriors: the first language by code point. Whole texts are read, long ones
in slices. Repeated rows each get their row; a null ``doc_id`` counts as empty text for the fold; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectflow.llm.common import materialize, release

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
SCALE = 1 << 20
#: Languages of a broadcast, and characters that are held at a time.
LANGUAGES, CHARS = 64, 2_000_000
UNKNOWN = "und"
NO_LETTER = re.compile(r"[\W\d_]")


@functools.cache
def _letters() -> np.ndarray:
    """Of each code point: its lower-case form if it is a letter, else 0."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in map(chr, range(sys.maxunicode + 1)):
        if c.isalpha():
            low = c.lower()
            table[ord(c)] = ord(low) if len(low) == 1 else ord(c)
    return table


def _spelled(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, 0 for the gaps between, and the text of each place."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    code = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _letters()[code]
    of = np.repeat(np.arange(len(texts)), sizes)
    of = np.r_[of[:1], of]
    keep = np.r_[True, (letters[1:] != 0) | (letters[:-1] != 0)]
    return letters[keep], of[keep]


def n_grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the text (rising) and bucket of every n-gram."""
    letters, of = _spelled(texts)
    gap = letters == 0
    rolling, whole = letters.copy(), np.ones(len(letters), bool)
    for k in range(1, max(ORDERS) + 1):
        if k > 1:
            rolling = rolling[:-1] * np.uint32(0x9E3779B1) + letters[k - 1 :]
            whole = whole[:-1] if k == 2 else whole[:-1] & ~gap[k - 2 : -1]
        if k in ORDERS and len(rolling):
            real = whole & ~gap if k == 1 else whole
            mixed = (rolling + np.uint32(k)) * np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(15)
            bucket = (mixed * np.uint32(0xC2B2AE35)) >> np.uint32(16)
            yield of[min(k, 2) - 1 :][: len(rolling)][real], bucket[real].astype(np.int64)


def _batches(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """The texts with their numbers, about ``CHARS`` characters at a time; a longer text is cut at what is no letter, which no n-gram spans."""
    owners, parts, size = [], [], 0
    for i, text in enumerate(texts):
        start = 0
        while start < len(text):
            stop = NO_LETTER.search(text, start + CHARS) if len(text) - start > CHARS else None
            end = stop.start() if stop else len(text)
            owners.append(i)
            parts.append(text[start:end])
            size, start = size + end - start, end
            if size >= CHARS:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts by language and bucket over a task; bucket -1 counts documents."""
    held: dict[str, np.ndarray] = {}

    def rows():
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": at - 1, "n": counts[at]})
        held.clear()

    for frame in frames:
        for lang, texts in frame.groupby("lang")["text"]:
            counts = held.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
            counts[0] += len(texts)
            for _, parts in _batches(texts.tolist()):
                for _, bucket in n_grams(parts):
                    counts[1:] += np.bincount(bucket, minlength=BUCKETS)
        if len(held) > LANGUAGES:
            yield from rows()
    yield from rows()


def train(labelled: DataFrame) -> DataFrame:
    """The model of ``text, lang``, a written table: ``lang``, ``docs`` and the counts of its n-grams as two arrays ``bucket, n``. Rows with a null are left out."""
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), "text").where("lang is not null and text is not null")
    counts = rows.mapInPandas(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    listed = F.sort_array(F.collect_list(F.when(F.col("bucket") >= 0, F.struct("bucket", "n"))))  # at most BUCKETS entries
    model = counts.groupBy("lang").agg(F.max(F.when(F.col("bucket") < 0, F.col("n"))).alias("docs"), listed.alias("x"))
    return materialize(model.select("lang", "docs", F.col("x.bucket").alias("bucket"), F.col("x.n").alias("n")), "language-model")


def matrix(model: pd.DataFrame, all_docs: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their log-priors, and log-probabilities by language and bucket, in units of 1 / SCALE."""
    weights = np.zeros((len(model), BUCKETS), np.int64)
    for row, (bucket, n) in enumerate(zip(model["bucket"], model["n"], strict=True)):
        weights[row, np.asarray(bucket, np.int64)] = n
    logs = np.log(weights + 1.0) - np.log(weights.sum(axis=1, keepdims=True) + float(BUCKETS))
    prior = np.log(model["docs"].to_numpy(dtype=float) / all_docs)
    return model["lang"].tolist(), np.rint(prior * SCALE).astype(np.int64), np.rint(logs * SCALE).astype(np.int32)


def scores(texts: list[str], prior: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-posteriors (less a constant) by text and language, and the number of n-grams of each text."""
    total, found = np.tile(prior, (len(texts), 1)), np.zeros(len(texts), np.int64)
    for owners, parts in _batches(texts):
        for of, bucket in n_grams(parts):
            ends = np.searchsorted(of, np.arange(len(parts) + 1))
            np.add.at(found, owners, np.diff(ends))
            for lang in range(len(prior)):
                through = np.r_[0, np.cumsum(logs[lang][bucket], dtype=np.int64)]
                np.add.at(total[:, lang], owners, through[ends[1:]] - through[ends[:-1]])
    return total, found


def _scored(block) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds a block of languages to what is known of each text: its ``lang_pred``, that one's log-posterior ``__best``, and ``__mass``, the sum of all posteriors relative to the best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prior, logs = block.value
        for batch in batches:
            total, found = scores([t or "" for t in batch.column("text").to_pylist()], prior, logs)
            at = total.argmax(axis=1) if len(total) else np.zeros(0, np.int64)  # the first of equal ones: languages come in order
            top, before = total[np.arange(len(at)), at], batch.column("__best").to_numpy()
            best = np.maximum(before, top)
            mass = np.exp((total - best[:, None]) / SCALE).sum(axis=1) + batch.column("__mass").to_numpy() * np.exp((before - best) / SCALE)
            won = (found > 0) & (top > before)
            pred = np.where(won, np.asarray(names, object)[at], batch.column("lang_pred").to_numpy(zero_copy_only=False))
            new = {"lang_pred": pa.array(pred, pa.string()), "__best": pa.array(best), "__mass": pa.array(mass)}
            yield pa.RecordBatch.from_arrays([new.get(f.name, batch.column(i)) for i, f in enumerate(batch.schema)], names=batch.schema.names)

    return run


def predict(docs: DataFrame, model: DataFrame) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; ``model`` as ``train`` gives it. Each block of ``LANGUAGES`` languages is one more step of the same stage."""
    heads = model.select("lang", "docs").toArrow().to_pandas().sort_values("lang")  # a row for each language
    names = heads["lang"].tolist()
    out = docs.withColumns({"lang_pred": F.lit(UNKNOWN), "__best": F.lit(-(1 << 62)), "__mass": F.lit(0.0)})
    for start in range(0, len(names), LANGUAGES):
        part = model.where(F.col("lang").isin(names[start : start + LANGUAGES])).toArrow().to_pandas().sort_values("lang")
        block = docs.sparkSession.sparkContext.broadcast(matrix(part, int(heads["docs"].sum())))
        out = out.mapInArrow(_scored(block), out.schema)
    score = F.when(F.col("lang_pred") == UNKNOWN, 0.0).otherwise(F.round(1 / F.col("__mass"), 6))
    return out.withColumn("score", score).drop("__best", "__mass")


def held_out(doc_id: Column) -> Column:
    """Whether the document is of the fifth that nothing is learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op11_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")
    release(model)  # the tasks have it as a broadcast
    return out
