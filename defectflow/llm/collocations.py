"""Phrase collocations: words that follow each other far more often than their parts would let expect, counted exactly in direct-address tiles.

1. Tasks cut texts into words and pieces and write chunks of about ``CHUNK_WORDS`` words of one language: word numbers that count within the chunk, and the chunk's distinct words with their counts.
2. Words with ``MIN_COUNT`` or more occurrences in the language are ranked by frequency; each chunk gets the ranks of its own words by a join on them, so no task holds the dictionary.
3. Pairs of ranks fall into tiles. Ranks are cut into bands, one for each doubling; by Zipf's law each band has about the same mass, so tiles do too, and a tile's place and width follow from its number. Within a chunk a
   tile is counted by a dense ``bincount`` where its table is at most ``DENSE`` times its pairs, else as sorted coordinates with counts; a tile's rows from all chunks are then summed the same way, as a stream.
4. Frequent pairs are ranked again. A stream per tile sends each chunk the ranks of the frequent pairs that it has, and (pair rank, word rank) are counted as pairs are: a triple's first and last pair must both be frequent.
5. Scores, cuts and the removal of phrases inside longer ones are joins of frequent phrases; hot words there go through ``look_up``. Products are decimals of 38 digits.

A tile is dealt further into parts by its cells, one for each ``PART_WORDS`` words of the corpus, so a task's memory doesn't grow with it. A very common word, pair or language is one cell, or a few tiles, of each chunk.

Defined results: a null or empty text has no phrases; null ``lang`` is ``und``; repeated rows count again; equal scores and counts go by phrase; an empty table gives no rows; further columns don't matter.
Long texts are cut into chunks between pieces. At most 2^32 words of a language may be frequent, and 2^63 cells a tile; beyond that the job fails rather than miscounts.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from defectflow.llm.common import look_up, materialize, release
from defectflow.prefix import prefix_sum

MIN_COUNT, COVERED, TOP = 10, 50, 2000
CHUNK_WORDS, PART_WORDS = 1 << 19, 1 << 30
DENSE = 8
#: Cells that wait to be summed, and rows of a result frame.
WAITING, FRAME = 2_000_000, 200_000

#: What ends a piece; words end at blanks and tabs.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytes.maketrans(BREAKS + b"\t" + bytes(range(65, 91)), b"." * len(BREAKS) + b" " + bytes(range(97, 123)))


def spelled(text: str | None) -> list[bytes]:
    """Words in lower case (A to Z), and ``.`` for each end of a piece."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).replace(b".", b" . ").split()


def _stretches(tokens: list[bytes]) -> Iterator[list[bytes]]:
    start = 0
    while len(tokens) - start > CHUNK_WORDS and b"." in (rest := tokens[start + CHUNK_WORDS :]):
        stop = start + CHUNK_WORDS + rest.index(b".")
        yield tokens[start:stop]
        start = stop
    yield tokens[start:]


class _Chunk:
    """Word numbers of texts of one language; 0 ends a piece."""

    def __init__(self):
        self.of = defaultdict(count().__next__)
        self.of[b"."]  # number 0
        self.ids = array("i")

    def add(self, tokens: list[bytes]) -> None:
        self.ids.extend(map(self.of.__getitem__, tokens))
        self.ids.append(0)

    def row(self, number: int, lang: str) -> tuple:
        ids = np.frombuffer(self.ids, np.int32)
        counts = np.bincount(ids, minlength=len(self.of))
        return number, lang, int(counts[1:].sum()), _pack(ids), [w.decode("utf-8", "surrogatepass") for w in self.of][1:], counts[1:]


def _pack(ids: np.ndarray) -> bytes:
    """Four bytes an id, compressed: rows stay small on their way through shuffles and into tasks."""
    return len(ids).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(ids, "<u4").tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    return np.frombuffer(pa.decompress(packed[8:], size * 4, codec="zstd"), "<u4")


CHUNKS = "chunk long, lang string, n_words long, ids binary, words array<string>, counts array<long>"


def _chunked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names, task, made = [c.split()[0] for c in CHUNKS.split(", ")], TaskContext.get().partitionId(), 0
    open_chunks: dict[str, _Chunk] = defaultdict(_Chunk)

    def flush(langs):
        nonlocal made
        for lang in langs:
            yield pd.DataFrame([open_chunks.pop(lang).row(task << 32 | made, lang)], columns=names)
            made += 1

    held = 0
    for frame in frames:
        for lang, text in zip(frame["lang"], frame["text"], strict=True):
            for tokens in _stretches(spelled(text)):
                chunk = open_chunks[lang]
                chunk.add(tokens)
                held += len(tokens) + 1
                if held >= 2 * CHUNK_WORDS:  # many languages: all of them
                    held = 0
                    yield from flush(list(open_chunks))
                elif len(chunk.ids) >= CHUNK_WORDS:
                    held -= len(chunk.ids)
                    yield from flush([lang])
    yield from flush(list(open_chunks))


def band(rank: np.ndarray) -> np.ndarray:
    """The band of ranks from 1 on, one for each doubling."""
    return np.frexp(rank.astype(np.float64))[1].astype(np.int64) - 1


def bounds(band: int) -> tuple[int, int]:
    """First rank and width (in bits) of a band."""
    return 1 << band, band


def tally(cells: np.ndarray, weights: np.ndarray | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order and their sums: by a table of all cells where that is small, else by sorting."""
    if size <= DENSE * len(cells):
        sums = np.bincount(cells, weights)  # weights: doubles, exact below 2^53
        at = np.flatnonzero(sums)
        return at, sums[at].astype(np.int64)
    order = np.argsort(cells, kind="stable")
    cells = cells[order]
    first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    sums = np.diff(np.r_[first, len(cells)]) if weights is None else np.add.reduceat(weights[order], first)
    return cells[first], sums.astype(np.int64)


def _cell_type(tile: int) -> str:
    return "<u4" if bounds(tile >> 8)[1] + bounds(tile & 255)[1] <= 32 else "<u8"


def _cells(tile: int, packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, _cell_type(tile)).astype(np.int64)


def _cell_bytes(tile: int, cells: np.ndarray) -> bytes:
    return cells.astype(_cell_type(tile)).tobytes()


def tiles(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Counted pairs of ranks: tile number, cells in it, counts."""
    tile = (band(x) << 8 | band(y)).astype(np.uint16)
    order = np.argsort(tile, kind="stable")  # a radix sort for 16 bits
    tile, x, y = tile[order], x[order], y[order]
    edges = np.flatnonzero(np.r_[len(tile) > 0, tile[1:] != tile[:-1], True]).tolist()
    for a, b in zip(edges, edges[1:], strict=False):
        t = int(tile[a])
        (x0, x_bits), (y0, y_bits) = bounds(t >> 8), bounds(t & 255)
        if x_bits + y_bits > 63:
            raise OverflowError("more ranks than a tile's cells can number")
        yield t, *tally((x[a:b] - x0 << y_bits) + (y[a:b] - y0), None, 1 << x_bits + y_bits)


TILES = "lang string, tile int, part int, chunk long, cells binary, counts binary"


def _tile_rows(lang: str, chunk: int, x: np.ndarray, y: np.ndarray, parts: int) -> pd.DataFrame:
    out = []
    for tile, cells, counts in tiles(x, y):
        part = cells * 0x9E3779B1 % (1 << 31) % parts if parts > 1 else np.zeros(1, np.int64)
        for p in np.unique(part).tolist():
            mine = part == p if parts > 1 else slice(None)
            out.append((lang, tile, p, chunk, _cell_bytes(tile, cells[mine]), counts[mine].astype("<u4").tobytes()))
    return pd.DataFrame(out, columns=[c.split()[0] for c in TILES.split(", ")])


TOTALS = "lang string, tile int, part int, cell long, x long, y long, n long"


def totals(tile_rows: DataFrame, at_least: int) -> DataFrame:
    """Frequent cells of all tiles, from the rows of all chunks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready, n_ready = [], 0
        now, cells, sums, size = None, [], [], 0

        def summed():
            bits = bounds(now[1] >> 8)[1] + bounds(now[1] & 255)[1]
            return tally(np.concatenate(cells), np.concatenate(sums), 1 << bits)

        def finished():
            (x0, _), (y0, y_bits) = bounds(now[1] >> 8), bounds(now[1] & 255)
            at, n = summed()
            at, n = at[n >= at_least].astype(np.int64), n[n >= at_least]
            return pd.DataFrame(dict(zip(("lang", "tile", "part"), now, strict=True)) | {"cell": at, "x": x0 + (at >> y_bits), "y": y0 + (at & (1 << y_bits) - 1), "n": n})

        for frame in frames:
            for lang, tile, part, c, n in zip(*(frame[k].tolist() for k in ("lang", "tile", "part", "cells", "counts")), strict=True):
                if (lang, tile, part) != now:
                    if now is not None and len(one := finished()):
                        ready.append(one)
                        n_ready += len(one)
                        if n_ready >= FRAME:
                            yield pd.concat(ready)
                            ready, n_ready = [], 0
                    now, cells, sums, size = (lang, tile, part), [], [], 0
                cells.append(_cells(tile, c))
                sums.append(np.frombuffer(n, "<u4").astype(np.int64))
                size += len(cells[-1])
                if size > WAITING:
                    at, n = summed()
                    cells, sums, size = [at], [n], 0
        if now is not None:
            ready.append(finished())
        if ready:
            yield pd.concat(ready)

    key = ("lang", "tile", "part")
    return tile_rows.select(*key, "cells", "counts").repartition(*key).sortWithinPartitions(*key).mapInPandas(run, TOTALS)


def _ranked(frequent: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """A written table with ``rank`` by falling count within the language."""
    return materialize(prefix_sum(frequent, [F.col("n").desc(), *order], {"rank": F.lit(1).cast("long")}, ["lang"]), name, free=False, rows=F.count(F.lit(1)))


def _chunks(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    return materialize(rows.mapInPandas(_chunked, CHUNKS), "chunks", n_words=F.sum("n_words"))


def _in_ranks(chunks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Chunks with ranks in place of the words' numbers, 0 for rare words and ends of pieces."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                ids = _unpack(r.ids)
                of = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
                if r.at is not None:
                    of[np.asarray(r.at, np.int64)] = r.rank
                yield pd.DataFrame([(r.chunk, r.lang, _pack(of[ids]))], columns=["chunk", "lang", "ids"])

    listed = chunks.select("chunk", "lang", F.posexplode("words").alias("at", "word"))
    known = listed.join(vocabulary.select("lang", "word", "rank").hint("merge"), ["lang", "word"])
    mine = known.groupBy("chunk").agg(F.collect_list(F.col("at") + 1).alias("at"), F.collect_list("rank").alias("rank"))  # a chunk's own words
    return chunks.select("chunk", "lang", "ids").join(mine.hint("merge"), "chunk", "left").mapInPandas(run, "chunk long, lang string, ids binary")


def _pair_tiles(encoded: DataFrame, parts: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                ids = _unpack(r.ids).astype(np.int64)
                both = (ids[:-1] > 0) & (ids[1:] > 0)
                yield _tile_rows(r.lang, r.chunk, ids[:-1][both], ids[1:][both], parts)

    return encoded.mapInPandas(run, TILES)


def _marks(tile_rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``chunk, tile, cells, ranks``: frequent pairs of each chunk and tile. In a tile's stream the frequent cells come first, then the chunks' rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, known, ranks = None, None, None
        out, size, names = [], 0, ["chunk", "tile", "cells", "ranks"]
        for frame in frames:
            for r in frame.itertuples(index=False):
                key = (r.lang, r.tile, r.part)
                if r.known is not None:
                    now, known, ranks = key, np.asarray(r.known, np.int64), np.asarray(r.ranks, np.int64)
                elif key == now:
                    cells = _cells(r.tile, r.cells)
                    cells = cells[np.isin(cells, known, assume_unique=True)]
                    if len(cells):
                        its = ranks[np.searchsorted(known, cells)]
                        out.append((r.chunk, r.tile, _cell_bytes(r.tile, cells), its.astype("<u4" if its.max() < 1 << 32 else "<u8").tobytes()))
                        size += len(cells)
                        if size >= FRAME:
                            yield pd.DataFrame(out, columns=names)
                            out, size = [], 0
        yield pd.DataFrame(out, columns=names)

    key = ["lang", "tile", "part"]
    held = F.sort_array(F.collect_list(F.struct("cell", "rank")))
    frequent = pairs.groupBy(*key).agg(held.alias("h")).select(*key, F.col("h.cell").alias("known"), F.col("h.rank").alias("ranks"))
    both = tile_rows.select(*key, "chunk", "cells").unionByName(frequent, allowMissingColumns=True)
    return both.repartition(*key).sortWithinPartitions(*key, F.col("chunk").asc_nulls_first()).mapInPandas(run, "chunk long, tile int, cells binary, ranks binary")


def _triple_tiles(encoded: DataFrame, marks: DataFrame, parts: int) -> DataFrame:
    """Tiles of (rank of the first two words, rank of the third); in a chunk's stream its marks come first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, ranks = [], []
        for frame in frames:
            for r in frame.itertuples(index=False):
                if r.ids is None:
                    (x0, _), (y0, y_bits) = bounds(int(r.tile) >> 8), bounds(int(r.tile) & 255)
                    cells = _cells(int(r.tile), r.cells)
                    keys.append((x0 + (cells >> y_bits)) << 32 | y0 + (cells & (1 << y_bits) - 1))
                    ranks.append(np.frombuffer(r.ranks, "<u4" if len(r.ranks) == 4 * len(cells) else "<u8").astype(np.int64))
                    continue
                if keys:
                    known, of = np.concatenate(keys), np.concatenate(ranks)
                    order = np.argsort(known)
                    known, of = known[order], of[order]
                    ids = _unpack(r.ids).astype(np.int64)
                    pair = ids[:-1] << 32 | ids[1:]
                    at = np.minimum(np.searchsorted(known, pair), len(known) - 1)
                    rank = np.where(known[at] == pair, of[at], 0)
                    both = (rank[:-1] > 0) & (rank[1:] > 0)
                    yield _tile_rows(r.lang, r.chunk, rank[:-1][both], ids[2:][both], parts)
                keys, ranks = [], []

    both = encoded.unionByName(marks, allowMissingColumns=True)
    return both.repartition("chunk").sortWithinPartitions("chunk", F.col("ids").isNotNull()).mapInPandas(run, TILES)


def _with(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` (a written table) with the columns of ``table``, one row for each of ``keys``; hot keys are spread."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return look_up(rows, table.join(counted, keys), keys, total, "__n")


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)); counts stay below 10^16, so products stay below 10^38."""
    exact = lambda c: f"cast({c} as decimal(16,0))"
    return F.expr(f"({exact(a)} * {exact(a)} * 1000000) div ({exact(left)} * {exact(right)})")


def phrases(docs: DataFrame, min_count: int = MIN_COUNT, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``. A phrase goes if a longer one around it has ``covered`` percent of its occurrences."""
    chunks = _chunks(docs)
    parts = 1 + (chunks.totals["n_words"] or 0) // PART_WORDS
    sizes = materialize(chunks.groupBy("lang").agg(F.sum("n_words").alias("n")), "sizes", free=False)
    listed = chunks.select("lang", F.inline(F.arrays_zip("words", "counts"))).withColumnRenamed("words", "word")
    common = materialize(listed.groupBy("lang", "word").agg(F.sum("counts").alias("n")).where(F.col("n") >= min_count), "words")
    words = _ranked(common, [F.col("word")], "vocabulary")
    encoded = materialize(_in_ranks(chunks, words), "encoded")
    release(chunks, common)

    tiled = materialize(_pair_tiles(encoded, parts), "pair-tiles", free=False)
    found = materialize(totals(tiled, min_count), "pairs")
    pairs = _ranked(found, [F.col("x"), F.col("y")], "ranked-pairs")
    release(found)
    marks = materialize(_marks(tiled, pairs), "marks")
    release(tiled)
    tiled = materialize(_triple_tiles(encoded, marks, parts), "triple-tiles")
    release(encoded, marks)
    triples = materialize(totals(tiled, min_count).select("lang", F.col("x").alias("pair"), F.col("y").alias("z"), F.col("n").alias("a")), "triples", rows=F.count(F.lit(1)))
    release(tiled)

    n_pairs, n_triples = pairs.totals["rows"], triples.totals["rows"]
    counts = lambda key, name: words.select("lang", F.col("rank").alias(key), F.col("n").alias(name))
    one = materialize(_with(pairs.select("lang", "x", "y", F.col("n").alias("a"), F.col("rank").alias("pair")), counts("x", "l"), ["lang", "x"], n_pairs), "left", free=False)
    two = materialize(_with(one, counts("y", "r"), ["lang", "y"], n_pairs), "both", free=False)
    first = two.select("lang", "pair", "x", "y", F.col("l").alias("l1"), F.col("a").alias("l2"))
    begun = materialize(_with(triples, first, ["lang", "pair"], n_triples), "begun", free=False)
    last = two.select("lang", F.col("x").alias("y"), F.col("y").alias("z"), F.col("a").alias("r1"), F.col("r").alias("r2"))
    ended = materialize(_with(begun, last, ["lang", "y", "z"], n_triples).withColumns({"s1": _score("a", "l1", "r1"), "s2": _score("a", "l2", "r2")}), "ended", free=False)

    around = ended.select("lang", F.col("x"), F.col("y"), "a").unionByName(ended.select("lang", F.col("y").alias("x"), F.col("z").alias("y"), "a"))
    longest = around.groupBy("lang", "x", "y").agg(F.max("a").alias("longer"))
    alone = two.join(longest, ["lang", "x", "y"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    by_pair = alone.select("lang", "x", "y", F.lit(None).cast("long").alias("z"), "a", "l", "r", _score("a", "l", "r").alias("score"))
    lower = F.col("s2") < F.col("s1")
    by_triple = ended.select("lang", "x", "y", "z", "a", F.when(lower, F.col("l2")).otherwise(F.col("l1")).alias("l"), F.when(lower, F.col("r2")).otherwise(F.col("r1")).alias("r"), F.least("s1", "s2").alias("score"))
    scored = materialize(by_pair.unionByName(by_triple), "scored", free=False)
    falling = [F.col("score").desc(), F.col("a").desc()]
    placed = prefix_sum(scored, [*falling, F.col("x"), F.col("y"), F.col("z")], {"place": F.lit(1)}, ["lang"])
    least = placed.where(F.col("place") == top).select("lang", F.col("score").alias("s0"), F.col("a").alias("a0"))  # a row for each language; its ties stay until they have words
    near = placed.join(least, "lang", "left").where(F.col("s0").isNull() | (F.col("score") > F.col("s0")) | (F.col("score") == F.col("s0")) & (F.col("a") >= F.col("a0")))
    near = materialize(near.select("lang", "x", "y", "z", "a", "l", "r", "score"), "best", free=False)
    release(one, two, begun, ended, scored, *placed.tables)
    for key in ("x", "y", "z"):
        near = near.join(words.select("lang", F.col("rank").alias(key), F.col("word").alias(f"{key}_word")), ["lang", key], "left")
    named = near.withColumn("phrase", F.concat_ws(" ", "x_word", "y_word", "z_word"))
    numbered = named.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*falling, "phrase")).cast("long")).where(F.col("rank") <= top)
    return numbered.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) AS s(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
cut AS (SELECT c.lang, c.phrase, c.k, c.a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail FROM c, (VALUES (1), (2)) AS s(j) WHERE j < c.k),
s AS (SELECT cut.lang, cut.phrase, cut.k, cut.a, j, h.a AS l, t.a AS r, (1000000::HUGEINT * cut.a * cut.a // (h.a::HUGEINT * t.a))::BIGINT AS score
      FROM cut JOIN f AS h ON h.lang = cut.lang AND h.phrase = head JOIN f AS t ON t.lang = cut.lang AND t.phrase = tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM c WHERE k = 3) AS o
      ON o.lang = b.lang AND o.part = b.phrase AND 100 * o.a >= 50 * b.a WHERE b.k = 2),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank FROM b ANTI JOIN i ON i.lang = b.lang AND i.phrase = b.phrase)
SELECT o.lang, o.rank, o.phrase, o.a, o.l, o.r, n.n, o.score FROM o JOIN n ON n.lang = o.lang WHERE o.rank <= 2000
"""
