"""SimHash near-duplicates through an inverted index on byte positions.

A fingerprint has eight bytes. Fingerprints that differ in at most four bits differ in at most four bytes, so they share at least four of the eight
positions. The index is keyed by four positions with their bytes (70 keys for each distinct fingerprint): a posting by one position would hold n/256 fingerprints, one by four
holds n/2^32. Pairs that meet in a posting are tallied over all eight positions; those that share the guaranteed four, of which the posting's are the first, are verified by
their differing bits. So each pair is judged in one posting.

A posting is dealt into tiles of about ``TILE`` fingerprints by their hash, and each pair of tiles is a cell of its own: no task holds more of a posting than two tiles, however many fingerprints it
has. A cell gives each fingerprint at most one link, to the smallest one that it reaches there; pairs are never listed. Exact copies share one fingerprint and are joined only at the end.
Components come from large-star and small-star rounds over the links, all joins with hubs by ``look_up``; nothing is collected.

Defined results: a null or empty text (or one without words) has fingerprint zero and is linked like any other; repeated rows are one group;
a null ``doc_id`` gets its row, and counts for ``component_id`` only if nothing else is in its component (then null); an empty table gives an empty
result; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectflow.llm.common import look_up, materialize, release, word_bytes

SHINGLE = 4
MAX_BITS = 4
TILE = 512


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64 (seed 42)."""
    tokens = word_bytes(text)
    if not tokens:
        return 0
    line = b" ".join(tokens).lower()
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.r_[0, ends[:-1]].tolist()
    stops = (ends - 1).tolist()
    n = max(len(tokens) - size + 1, 1)
    last = min(size, len(tokens)) - 1
    hashed = np.fromiter((xxhash.xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[:n], stops[last : last + n], strict=True)), np.uint64, n)
    total = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        total += np.unpackbits(hashed[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``h`` (hash of the text) and ``fp`` (the fingerprint as a signed long) of each row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "h": frame["h"], "fp": _signed([fingerprint(t, size) for t in frame["text"]])})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("h"), F.col("text").alias("text")).mapInPandas(run, "doc_id long, h long, fp long")


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255).cast("long"))


#: The guaranteed four of eight byte positions, in every way.
CHOICES = list(combinations(range(8), 4))
#: For each set of shared positions (a bit each), the number of its first four in ``CHOICES``; -1 below four.
FIRST = np.array([CHOICES.index(tuple(i for i in range(8) if s >> i & 1)[:4]) if s.bit_count() >= 4 else -1 for s in range(256)])


def _postings(fps: DataFrame) -> DataFrame:
    """(posting, fp): the posting packs which four of eight positions, and their bytes."""
    split = fps.select("fp", *(_byte(F.col("fp"), i).alias(f"b{i}") for i in range(8)))
    packed = lambda c, at: sum((F.shiftleft(F.col(f"b{i}"), 24 - 8 * k) for k, i in enumerate(at)), F.lit(c << 32).cast("long"))
    return split.select("fp", F.explode(F.array(*(packed(c, at) for c, at in enumerate(CHOICES)))).alias("posting"))


def _near(posting: int, a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs of two lists are links of this posting: tallied over all eight positions, four or more shared, these four the first of them, then verified by bits."""
    apart = a[:, None] ^ b[None, :]
    shared = np.packbits(apart.view(np.uint8).reshape(*apart.shape, 8) == 0, axis=-1, bitorder="little")[..., 0]
    return (FIRST[shared] == posting >> 32) & (np.bitwise_count(apart) <= max_bits)


def _forest(fps: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each fingerprint with the smallest one that it reaches: at most one for each."""
    order = np.argsort(fps, kind="stable")
    fps, near = fps[order], near[np.ix_(order, order)] | np.eye(len(fps), dtype=bool)
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (new == label).all():
            break
        label = new
    moved = label < np.arange(len(fps))
    return fps[label[moved]], fps[moved]


def _pairs(frame: pd.DataFrame, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of cells with two fingerprints, all at once."""
    x = np.sort(np.stack(frame["first"].to_numpy()), axis=1)
    apart = x[:, 0] ^ x[:, 1]
    shared = np.packbits(apart.view(np.uint8).reshape(-1, 8) == 0, axis=-1, bitorder="little")[:, 0]
    near = (FIRST[shared] == frame["posting"].to_numpy() >> 32) & (np.bitwise_count(apart.view(np.uint64)) <= max_bits)
    return x[near, 0], x[near, 1]


def _cell_links(max_bits: int):
    """Links within cells: (posting, lo, hi, two lists of fingerprints). A cell of one tile compares its list with itself, one of two tiles compares across."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            two = (frame["lo"] == frame["hi"]) & (frame["first"].str.len() == 2)
            found = [_pairs(frame[two], max_bits)] if two.any() else []
            for c in frame[~two].itertuples():
                x = np.asarray(c.first, np.int64)
                if c.lo == c.hi:
                    near = _near(c.posting, x.view(np.uint64), x.view(np.uint64), max_bits)
                else:
                    y = np.asarray(c.second, np.int64)
                    across = _near(c.posting, x.view(np.uint64), y.view(np.uint64), max_bits)
                    near = np.zeros((len(x) + len(y),) * 2, bool)
                    near[: len(x), len(x) :], near[len(x) :, : len(x)] = across, across.T
                    x = np.concatenate([x, y])
                if near.any():
                    found.append(_forest(x, near))
            none = np.zeros(0, np.int64)
            yield pd.DataFrame({"a": np.concatenate([none, *(f[0] for f in found)]), "b": np.concatenate([none, *(f[1] for f in found)])})

    return run


def links(fps: DataFrame, tile: int = TILE, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b), a < b, over distinct fingerprints: their components are those of all pairs within ``max_bits`` (at most four) bits."""
    assert max_bits <= 4, "four shared bytes are guaranteed up to four bits"
    wide = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = _postings(fps.repartition(wide, "fp"))  # seventy rows for each: a small table is dealt out first
    met = postings.groupBy("posting").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    placed = postings.join(met.hint("merge"), "posting").select("posting", "fp", tiles.alias("tiles"), F.pmod(F.xxhash64("fp"), tiles).cast("int").alias("tile"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    # A fingerprint goes to a cell for each tile of its posting: the tiles of a large one are spread before.
    dealt = placed.repartition(wide, "posting", "tile").select("posting", "fp", "tile", other.alias("other")).select("posting", "fp", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile")
    mine = lambda part: F.collect_list(F.when(F.col("tile") == F.col(part), F.col("fp")))
    cells = dealt.groupBy("posting", "lo", "hi").agg(mine("lo").alias("first"), F.collect_list(F.when(F.col("tile") != F.col("lo"), F.col("fp"))).alias("second"))
    return cells.mapInPandas(_cell_links(max_bits), "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b), a < b, reaches.

    Rounds of large star (each node's larger neighbours go to its smallest one) and small star (its smaller ones do) until every tree is a star, which the count of neighbours tells."""
    edges = materialize(edges.select("a", "b"), "links", n=F.count(F.lit(1)))
    total = 2 * (edges.totals.get("n") or 0)
    u, v = F.col("u"), F.col("v")
    for _ in range(rounds):
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        about = near.groupBy("u").agg(F.least(u, F.min(v)).alias("m"), F.count(F.lit(1)).alias("n"), F.count_if(v < u).alias("below"))
        middle = F.count_if((F.col("below") > 1) | (F.col("below") == 1) & (F.col("n") > 1))
        low = materialize(about, "lowest", middle=middle)
        if not low.totals.get("middle"):
            break
        large = materialize(look_up(near.where(v > u), low.drop("below"), "u", total).select(v.alias("u"), F.col("m").alias("v")).distinct(), "large-star", n=F.count(F.lit(1)))
        lowest = large.groupBy("u").agg(F.min(v).alias("m"), F.count(F.lit(1)).alias("n"))
        star = look_up(large, lowest, "u", large.totals["n"]).select(v.alias("b"), F.col("m").alias("a")).unionByName(lowest.select(u.alias("b"), F.col("m").alias("a")))
        new = materialize(star.where("a <> b").distinct(), "links", n=F.count(F.lit(1)))
        release(edges, low, large)
        edges, total = new, 2 * new.totals["n"]
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return low.select(u.alias("node"), F.col("m").alias("root"))


def _rooted(docs: DataFrame, size: int, max_bits: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows (``doc_id, h, fp``, ``h``: hash of the text), and each distinct one with its number of rows, first row (id, then text) and component's ``root``."""
    prints = materialize(fingerprints(docs, size), "fingerprints", n=F.count(F.lit(1)))
    row = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "h")
    values = materialize(prints.groupBy("fp").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("n")), "values", n=F.count(F.lit(1)))
    found = components(links(values.select("fp"), tile, max_bits))
    rooted = values.join(found.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("smallest"), F.count(F.lit(1)).alias("fps"))
    return prints, materialize(look_up(rooted, smallest, "root", values.totals.get("n") or 0, "fps"), "named")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of each row of ``docs``."""
    prints, named = _rooted(docs, size, max_bits, tile)
    return look_up(prints, named.select("fp", "n", F.col("smallest.doc_id").alias("component_id")), "fp", prints.totals.get("n") or 0).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """One row of each component, with its own columns: the one with the smallest ``doc_id`` (null ids last), then by the text's hash. Of rows that agree in both one stays."""
    prints, named = _rooted(docs, size, max_bits, tile)
    total = prints.totals.get("n") or 0
    first = F.col("smallest")
    judged = look_up(prints, named.select("fp", "n", "smallest"), "fp", total).select("doc_id", "h", (F.col("doc_id").eqNullSafe(first["doc_id"]) & (F.col("h") == first["h"])).alias("stays"))
    groups = judged.groupBy("doc_id", "h").agg(F.bool_and("stays").alias("__stays"), F.count(F.lit(1)).alias("__rows")).where(~F.col("__stays") | (F.col("__rows") > 1))
    groups = materialize(groups.withColumnsRenamed({"doc_id": "__id", "h": "__h"}), "copies", stay=F.count_if("__stays"))
    mine = docs.withColumn("__text", text_hash(F.col("text")))
    joined = mine.join(groups, mine["doc_id"].cast("long").eqNullSafe(groups["__id"]) & (mine["__text"] == groups["__h"]), "left")
    kept = joined.where(F.col("__rows").isNull()).select(*(docs[c] for c in docs.columns))
    if not groups.totals.get("stay"):
        return kept
    once = joined.where(F.col("__stays") & (F.col("__rows") > 1)).dropDuplicates(["__id", "__h"]).select(*(docs[c] for c in docs.columns))
    return kept.unionByName(once)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
