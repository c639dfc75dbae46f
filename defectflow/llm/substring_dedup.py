"""Substring dedup by relative Lempel-Ziv parsing.

Every text is at once a document to parse and a reference block. The index holds each phrase of ``window`` words (production: 35) that the
collection has more than once, with the places (text, word) of its first and last occurrence by the texts' order of hash. A document is factored greedily: a phrase that is found starts a
factor with a place elsewhere (never the document's own), and the factor grows word by word as long as the next phrase is found at the reference's next place; where it ends, at a factor
boundary, the next phrase is looked up by itself, so that passages straddling two references aren't lost. A phrase that stands again in the document itself refers to its
nearest earlier place there. Factors have at least ``window`` words; the words that they cover are the duplicate spans, which are removed.

How the index stays small: of any ``window`` words the smallest hash of ``ANCHOR`` consecutive words is an anchor, so equal phrases
share their anchor. Only phrases around an anchor that occurs twice are looked up; all others can't repeat. Steps, each one shuffle by hash
with map-side sums: count anchors; send repeated anchors to their texts; count the phrases around them; send repeated phrases to their texts; parse. What is sent back goes by ``look_up``, so an anchor or
phrase of a third of all documents is spread over the tasks. Phrases are compared by 64-bit hashes.

Defined results: a null or empty text has no words, removes nothing and keeps the empty text; each copy of a repeated row loses what
the others have (its reference is another copy); a null ``doc_id`` is kept as it is; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectflow.llm.common import look_up, materialize, pieces, release, window_hashes, word_bytes, word_hashes

WINDOW = 35
ANCHOR = 16
#: A place is one number: the text (low bits of its hash) and the word. Texts that share these bits only share a name.
PLACE_BITS, TEXT_BITS = 29, 34
#: Phrases are counted and sent back in so many parts by hash, one after the other: only one part's shuffles are on disk.
PARTS = 3


class Batch:
    """Word hashes of several texts in one array; ``inside(k)`` marks the starts whose ``k`` words are of one text."""

    def __init__(self, texts: list[str | None]):
        self.words = [word_bytes(t) for t in texts]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.hashes = word_hashes([w for one in self.words for w in one])
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)

    def inside(self, k: int) -> np.ndarray:
        n = max(len(self.hashes) - k + 1, 0)
        return self.owner[:n] == self.owner[k - 1 : k - 1 + n]

    def anchors(self, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the anchors, and all hashes of ``k`` words."""
        grams, inside = window_hashes(self.hashes, k), self.inside(window)
        if not inside.any():
            return np.zeros(0, np.int64), grams
        lowest = sliding_window_view(grams, window - k + 1)[: len(inside)].argmin(axis=1)
        return np.unique((lowest + np.arange(len(lowest)))[inside]), grams


def _counted(owner: np.ndarray, h: np.ndarray, at: np.ndarray, keys: np.ndarray, name: str) -> pd.DataFrame:
    """One row for each text and hash, with its first and last place in the text."""
    order = np.lexsort((at, h, owner))
    o, h, at = owner[order], h[order], at[order]
    first = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(h)][: len(first)] - 1
    return pd.DataFrame({name: h[first].view(np.int64), "key": keys[o[first]], "first": at[first].astype(np.int32), "last": at[last].astype(np.int32)})


def _find_anchors(window: int, k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in pieces(frames):
            batch = Batch(part["text"].tolist())
            at, grams = batch.anchors(window, k)
            found = _counted(batch.owner[at], grams[at], at, part["key"].to_numpy(), "anchor")
            yield found.assign(twice=found["first"] < found["last"]).drop(columns=["first", "last"])

    return run


def _find_phrases(window: int, k: int):
    """Phrases around repeated anchors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in pieces(frames):
            batch = Batch(part["text"].tolist())
            at, grams = batch.anchors(window, k)
            known = [np.asarray(x, np.int64).view(np.uint64) for x in part["anchors"]]
            starts = np.r_[0, batch.ends]
            bounds = np.searchsorted(at, starts)
            hit = np.concatenate([np.isin(grams[at[a:b]], x) for a, b, x in zip(bounds[:-1], bounds[1:], known, strict=True)] or [np.zeros(0, bool)])
            phrases, inside = window_hashes(batch.hashes, window), batch.inside(window)
            near = np.zeros(len(phrases) + 1, np.int64)
            np.add.at(near, np.clip(at[hit] - (window - k), 0, len(phrases)), 1)
            np.add.at(near, np.clip(at[hit] + 1, 0, len(phrases)), -1)
            chosen = np.flatnonzero((np.cumsum(near)[:-1] > 0) & inside)
            owner = batch.owner[chosen]
            found = _counted(owner, phrases[chosen], chosen - starts[owner], part["key"].to_numpy(), "phrase")
            # In the texts' order, so that the columns compress.
            found = found.assign(twice=found["first"] < found["last"], text=pd.factorize(found["key"])[0]).sort_values(["text", "first"])
            yield found[["phrase", "key", "first", "twice"]]

    return run


def elsewhere(phrases: np.ndarray) -> np.ndarray:
    """For each place the nearest earlier place of the same phrase, for the first one the next; the place itself if there is no other."""
    order = np.argsort(phrases, kind="stable")
    same = phrases[order][1:] == phrases[order][:-1]
    out = np.arange(len(phrases))
    out[order[:-1][same]] = order[1:][same]
    out[order[1:][same]] = order[:-1][same]
    return out


def factor(phrases: np.ndarray, index: np.ndarray, window: int, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greedy parse of the document of text ``key``. ``index``: rows (phrase, place elsewhere). Starts, lengths, references and their places of the factors."""
    index = index[np.argsort(index[:, 0], kind="stable")]
    row = np.searchsorted(index[:, 0], phrases)
    row[row == len(index)] = 0
    found, here = index[row, 0] == phrases, np.arange(len(phrases))
    own = elsewhere(phrases)
    # Copies of the document refer to each other at the same place.
    listed, at = index[row, 1] >> PLACE_BITS, index[row, 1] & ((1 << PLACE_BITS) - 1)
    inside = (own != here) | (listed == key)
    ref, place = np.where(inside, key, listed), np.where(inside, own, at)
    grows = np.r_[False, found[1:] & found[:-1] & (ref[1:] == ref[:-1]) & (place[1:] == place[:-1] + 1)][: len(found)]
    starts = np.flatnonzero(found & ~grows)
    lasts = np.flatnonzero(found & ~np.r_[grows[1:], False][: len(found)])
    return starts, lasts - starts + window, ref[starts], place[starts]


def _parse(window: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in pieces(frames):
            rows = []
            for doc_id, text, key, index in zip(part["doc_id"], part["text"], part["key"], part["index"], strict=True):
                tokens = word_bytes(text)
                kept, factors = tokens, ([], [], [], [])
                if index is not None and len(index) and len(tokens) >= window:
                    phrases = window_hashes(word_hashes(tokens), window).view(np.int64)
                    factors = factor(phrases, np.asarray(index, np.int64).reshape(-1, 2), window, key & ((1 << TEXT_BITS) - 1))
                    edge = np.zeros(len(tokens) + 1, np.int64)
                    np.add.at(edge, factors[0], 1)
                    np.add.at(edge, factors[0] + factors[1], -1)
                    kept = [tokens[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
                joined = b" ".join(kept)
                rows.append((doc_id, len(tokens), len(tokens) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "replace"), *map(list, factors)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "starts", "lengths", "refs", "ref_starts"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """A row for each row of ``docs`` (``doc_id`` integer, ``text``): word counts, the kept text and its digest, and the factors (``refs``: the low ``TEXT_BITS`` bits of the reference texts' hashes)."""
    anchor = min(anchor, window)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))
    texts = keyed.select("key", "text")
    n = F.count(F.lit(1))

    found = materialize(texts.mapInPandas(_find_anchors(window, anchor), "anchor long, key long, twice boolean"), "anchors", n=n)
    repeated = found.groupBy("anchor").agg(n.alias("n"), F.max("twice").alias("twice")).where("n > 1 or twice").drop("twice")
    mine = look_up(found.select("anchor", "key"), repeated, "anchor", found.totals.get("n") or 0)
    anchors = materialize(mine.groupBy("key").agg(F.collect_set("anchor").alias("anchors")), "repeated-anchors")
    release(found)

    phrases = materialize(texts.join(anchors, "key").mapInPandas(_find_phrases(window, anchor), "phrase long, key long, first int, twice boolean"), "phrases", n=n)
    release(anchors)
    name = lambda key: F.col(key).bitwiseAND(F.lit((1 << TEXT_BITS) - 1))
    parts = []
    for part in range(PARTS):
        mine = phrases.where(F.pmod("phrase", F.lit(PARTS)) == part).select("phrase", (F.shiftleft(name("key"), PLACE_BITS) + F.col("first")).alias("place"), "twice")
        known = mine.groupBy("phrase").agg(n.alias("n"), F.min("place").alias("low"), F.max("place").alias("high"), F.max("twice").alias("twice")).where("n > 1 or twice").drop("twice")
        sent = look_up(mine.select("phrase", "place"), known, "phrase", phrases.totals.get("n") or 0).withColumn("name", F.shiftright("place", PLACE_BITS))
        entry = F.array("phrase", F.when(F.shiftright("low", PLACE_BITS) == F.col("name"), F.col("high")).otherwise(F.col("low")))
        parts.append(materialize(sent.select("name", entry.alias("entry")).groupBy("name").agg(F.flatten(F.collect_set("entry")).alias("index")), "phrase-index"))
    release(phrases)
    # Written down, so that the join below is one of two plain shuffles, whose hot texts (copies) Spark deals out anew.
    index = materialize(functools.reduce(DataFrame.unionByName, parts).groupBy("name").agg(F.flatten(F.collect_list("index")).alias("index")), "index")
    release(*parts)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, starts array<long>, lengths array<long>, refs array<long>, ref_starts array<long>"
    return keyed.withColumn("name", name("key")).join(index, "name", "left").select("doc_id", "text", "key", "index").mapInPandas(_parse(window), schema)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("starts").cast("long").alias("n_factors"))
