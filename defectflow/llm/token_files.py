"""Token files: concatenated ids with Elias-Fano encoded document boundaries.

A file set is a Parquet folder of blocks, so that Spark's commit protocol covers lost tasks and any store works. A block holds the ids of
consecutive documents (ascending ``doc_id``) as one little-endian array, 16 bits an id where the vocabulary allows, else 32, and the documents'
end offsets within it as an Elias-Fano sequence: for n offsets up to u, the low floor(log2(u/n)) bits are packed side by side, and the high parts are a bit
vector in unary with a one for each offset. ``select`` finds the i-th one through samples of the vector's bytes (every 64th one), so an offset is read
without a table of 64-bit offsets: about 2 + log2(u/n) bits a document. The documents' ids, less the block's first one, are a second such sequence. All readers go through ``select``.

Encoding runs in tasks that each hold a range of (``doc_id``, text). Texts are cut where the tokenizer's own split always falls (at
white space), over the bytes of many texts at once, and each distinct piece is encoded once for a bounded cache, by the tokenizers library; the ids of all
pieces are then gathered by number. The cuts are used only for a byte-level tokenizer with its usual split and without normalizer; texts with a special token's string, and other tokenizers, are encoded whole.

Defined results: a null or empty text is one end id; documents of the same ``doc_id`` follow by text; null ids come first; an empty table gives no
blocks and no rows; further columns don't matter.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from defectflow.llm.common import shared_dir

END_ID = 0
BLOCK_IDS = 1 << 20
SAMPLE = 64
CACHE = 600_000
JOINED = 2000
#: Bytes of text that a task encodes at a time.
SLICE = 2_000_000
#: A cut may fall between two bytes that share a bit: 1 no white space, white space; 2 letter or digit, mark; 4 end of a longer character, mark.
_BEFORE, _AFTER = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
_BEFORE[0x21:0x7F] = 1
_BEFORE[0x80:] = 1 | 4
_BEFORE[[c for c in range(0x80) if chr(c).isalnum()]] |= 2
_AFTER[[0x20, *range(0x09, 0x0E)]] = 1
_AFTER[list(b",.;:!?")] = 2 | 4
#: Middle bytes of all white space of three bytes.
_SPACE_MIDDLE = np.zeros(256, bool)
_SPACE_MIDDLE[[0x80, 0x81, 0x9A, 0xA0]] = True
BLOCK = (
    "part int, block int, base long, bits int, ids binary, n long, low_bits int, low binary, high binary, samples binary, "
    "nulls int, first long, id_low_bits int, id_low binary, id_high binary, id_samples binary"
)
_ARROW = pa.schema([(name, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[kind]) for name, kind in map(str.split, BLOCK.split(", "))])
WIDEST = 1 << 62


class EliasFano:
    """A non-decreasing sequence of non-negative integers; ``select(i)`` is its i-th."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.samples = np.frombuffer(samples, np.uint32)

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = (values[:, None] >> np.arange(low_bits)) & 1 if n else np.zeros((0, 0))
        ones = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype(np.uint32).tobytes())

    def _low(self, i: int) -> int:
        a, b = i * self.low_bits, (i + 1) * self.low_bits
        return (int.from_bytes(self.low[a >> 3 : (b + 7) >> 3], "little") >> (a & 7)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """From the sample before the i-th one, whole bytes are skipped by their count of ones."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        word = self.high[byte] >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        position = byte * 8 + (word & -word).bit_length() - 1
        return ((position - i) << self.low_bits) | self._low(i)

    def decode(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        low = np.zeros(self.n, np.int64)
        if self.low_bits and self.n:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            low = bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return ((ones - np.arange(self.n)) << self.low_bits) | low


def _solid(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends at each of these bytes is surely no white space (control characters and some marks count as unsure)."""
    out = _BEFORE[raw[at]] > 0
    high = np.flatnonzero(raw[at] >= 0x80)
    last, one, two = raw[at[high]], raw[np.maximum(at[high] - 1, 0)], raw[np.maximum(at[high] - 2, 0)]
    out[high] = ~((one == 0xC2) & (last <= 0xA0) | (two >= 0xE1) & (two <= 0xE3) & _SPACE_MIDDLE[one])
    return out


def _cuts(raw: np.ndarray) -> np.ndarray:
    """Where the split falls whatever stands around: before white space, after a single line end or tab, between a letter or digit and a mark."""
    at = np.flatnonzero(_BEFORE[raw[:-1]] & _AFTER[raw[1:]]) + 1
    here = raw[at]
    sure = np.ones(len(at), bool)
    high = np.flatnonzero(raw[at - 1] >= 0x80)
    last, one = raw[at[high] - 1], raw[np.maximum(at[high] - 2, 0)]
    sure[high] = np.where(_AFTER[here[high]] == 1, _solid(raw, at[high] - 1), (one == 0xC3) & (last != 0x97) & (last != 0xB7))  # letters of Latin-1
    single = at[sure & (here < 0x20)]
    single = single[single + 1 < len(raw)] + 1
    return np.concatenate([at[sure], single[(raw[single] > 0x20) & (raw[single] < 0x7F)]])


def _binary(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of texts without nulls."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, np.uint8), bounds - bounds[0]


class Encoder:
    """Texts to ids. A Python worker keeps one, with its cache, for all its tasks."""

    def __init__(self, tokenizer: str, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        about = json.loads(tokenizer)
        split = about.get("pre_tokenizer") or {}
        self.cuts = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not about.get("normalizer")
        self.special = [t["content"] for t in about.get("added_tokens", [])]
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        #: Bytes of each id's token, to find pieces in an encoding of many; a special token with a blank might arise between two pieces.
        self.widths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())]) if self.cuts else None
        self.joins = self.cuts and not any(re.search(r"\s", s) for s in self.special)
        #: Each cached piece's number; its ids stand in ``pool`` from ``starts`` on.
        self.cache: dict[bytes, int] = {}
        self.pool, self.starts, self.sizes = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.most = cache

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece_ids(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces, and where each one's start and how many they are. Pieces between two blanks are encoded many at a time: the split falls at each blank."""
        raw, bounds = _binary(new)
        starts, sizes, pool, held = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), [], 0
        joined = (_AFTER[raw[bounds[:-1]]] == 1) & _solid(raw, bounds[1:] - 1) if self.joins and len(new) else np.zeros(len(new), bool)
        alone = [np.flatnonzero(~joined)]
        plain = np.flatnonzero(joined)
        raw, bounds = _binary(new.take(pa.array(plain)))
        for at in range(0, len(plain), JOINED):
            group = plain[at : at + JOINED]
            ends = bounds[at : at + JOINED + 1]
            text = raw[ends[0] : ends[-1]].tobytes().decode("utf-8", "replace")
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            reached, ends = np.cumsum(self.widths[ids]), ends[1:] - ends[0]
            cut = np.searchsorted(reached, ends)
            if len(ids) and reached[-1] == ends[-1] and (reached[cut] == ends).all():
                starts[group] = held + np.concatenate([[0], cut[:-1] + 1])
                sizes[group] = np.diff(cut, prepend=-1)
                pool.append(ids)
                held += len(ids)
            else:
                alone.append(group)
        alone = np.concatenate(alone)
        ids = [np.frombuffer(x, self.kind) for x in self._ids([p.decode("utf-8", "replace") for p in new.take(pa.array(alone)).to_pylist()])]
        sizes[alone] = [len(x) for x in ids]
        starts[alone] = held + np.cumsum(sizes[alone]) - sizes[alone]
        return np.concatenate([np.zeros(0, self.kind), *pool, *ids]), starts, sizes

    def encode_all(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with ``end_id`` after it, and each text's end in them.
        The first pieces seen stay cached, the frequent ones among them; once the cache is full, new ones last for this call."""
        raw, bounds = _binary(texts)
        at = np.zeros(len(raw) + 1, bool)
        if self.cuts and len(raw):
            at[_cuts(raw)] = True
        for special in self.special if self.cuts else ():
            for i in np.flatnonzero(pc.match_substring(texts.cast(pa.large_binary()), special).to_numpy(zero_copy_only=False)):
                at[bounds[i] : bounds[i + 1]] = False  # stays whole
        at[bounds] = True
        begins = np.flatnonzero(at[:-1])
        offsets = np.append(begins, len(raw)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = len(self.cache)
        number = np.fromiter(map(self.cache.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(number < 0)
        fresh, starts, sizes = self._piece_ids(found.dictionary.take(pa.array(new)))
        number[new] = known + np.arange(len(new))
        pool, starts, sizes = np.concatenate([self.pool, fresh]), np.concatenate([self.starts, starts + len(self.pool)]), np.concatenate([self.sizes, sizes])
        if known + len(new) <= self.most:
            self.cache.update(zip(map(distinct.__getitem__, new.tolist()), range(known, known + len(new)), strict=True))
            self.pool, self.starts, self.sizes = pool, starts, sizes
        # The end is one more piece after each text.
        pool, starts, sizes = np.append(pool, np.array([end_id or 0], self.kind)), np.append(starts, len(pool)), np.append(sizes, int(end_id is not None))
        counts = np.searchsorted(begins, bounds[1:])
        order = np.insert(number[found.indices.to_numpy()], counts, len(starts) - 1)
        long = sizes[order]
        reached = np.cumsum(long)
        ids = pool[np.repeat(starts[order] - reached + long, long) + np.arange(reached[-1] if len(reached) else 0)]
        return ids, reached[counts + np.arange(len(counts))]

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.encode_all(pa.array([t.encode("utf-8", "replace") for t in texts], pa.large_binary()))
        return [x.tobytes() for x in np.split(ids, ends[:-1])] if texts else []


@functools.lru_cache(1)
def encoder_of(tokenizer: str) -> Encoder:
    return Encoder(tokenizer)


def _slices(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """doc_id and text of rows whose texts have about ``limit`` bytes together (a longer text stays whole), for bounded memory."""
    for batch in batches:
        names, texts = batch.column(0), pc.fill_null(batch.column(1), "")
        _, bounds = _binary(texts)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
            yield names.slice(at, to - at), texts.slice(at, to - at)
            at = to


def _block(part: int, number: int, base: int, names: list[pa.Array], ids: list[np.ndarray], ends: list[np.ndarray]) -> pa.RecordBatch:
    docs, ids, ef = pa.chunked_array(names), np.concatenate(ids), EliasFano.encode(np.concatenate(ends))
    named = docs.drop_null().to_numpy()
    first = int(named[0]) if len(named) else 0
    sequence = EliasFano.encode(named - first)
    row = {
        "part": part, "block": number, "base": base, "bits": ids.dtype.itemsize * 8, "ids": ids.tobytes(), "n": ef.n, "low_bits": ef.low_bits, "low": ef.low, "high": ef.high, "samples": ef.samples.tobytes(),
        "nulls": docs.null_count, "first": first, "id_low_bits": sequence.low_bits, "id_low": sequence.low, "id_high": sequence.high, "id_samples": sequence.samples.tobytes(),
    }
    return pa.RecordBatch.from_pylist([row], _ARROW)


def _read_block(b) -> tuple[np.ndarray, list[int], list[int | None]]:
    """A block's ids, its bounds (0 and each document's end) and its documents' ids, by ``select``."""
    ends = EliasFano(b.n, b.low_bits, b.low, b.high, b.samples)
    names = EliasFano(b.n - b.nulls, b.id_low_bits, b.id_low, b.id_high, b.id_samples)
    return np.frombuffer(b.ids, np.dtype(f"<u{b.bits // 8}")), [0, *map(ends.select, range(b.n))], [None] * b.nulls + [b.first + names.select(i) for i in range(names.n)]


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, partitions: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Encodes ``docs`` (``doc_id`` integer, ``text``) into the folder ``path``. ``tokenizer``: the tokenizer file's content."""
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        part, number, base, held, first, block = TaskContext.get().partitionId(), 0, 0, 0, None, ([], [], [])
        for names, texts in _slices(batches, SLICE):
            ids, ends = encoder.encode_all(texts, end_id)
            at, done = 0, 0  # documents and ids that are in a block
            while at < len(names):
                rest = names.slice(at).drop_null()
                first = int(rest[0].as_py()) if first is None and len(rest) else first
                to = min(len(names), int(np.searchsorted(ends, done + block_ids - held)) + 1)
                if len(rest) and first + WIDEST <= rest[-1].as_py():  # ids too far apart for one sequence
                    to = min(to, len(names) - len(rest) + int(np.searchsorted(rest.to_numpy(), first + WIDEST)))
                if to > at:
                    for part_of, one in zip(block, (names.slice(at, to - at), ids[done : ends[to - 1]], ends[at:to] - done + held), strict=True):
                        part_of.append(one)
                    held += int(ends[to - 1]) - done
                    at, done = to, int(ends[to - 1])
                if held >= block_ids or at < len(names):
                    yield _block(part, number, base, *block)
                    number, base, held, first, block = number + 1, base + held, 0, None, ([], [], [])
        if held:
            yield _block(part, number, base, *block)

    # Ranges are cut by the beginning of the text, in the order of whole texts.
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).repartitionByRange(partitions, "doc_id", F.left("text", F.lit(24))).sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(run, BLOCK).write.option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks, with ``start``: the ids of all blocks before."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    # One row for each range of doc_id: as many as write_tokens had tasks, whatever the number of documents.
    sizes = blocks.select("part", (F.octet_length("ids") * 8 / F.col("bits")).cast("long").alias("ids_here")).groupBy("part").agg(F.sum("ids_here").alias("ids_here"))
    before = sizes.select("part", (F.sum("ids_here").over(W.orderBy("part")) - F.col("ids_here")).alias("before"))
    # Without the hint Spark takes the sums for as large as the blocks, and shuffles those.
    return blocks.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("base")).drop("before")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b in frame.itertuples():
                ids, bounds, names = _read_block(b)
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[x:y]) for x, y in zip(bounds, bounds[1:], strict=False)]
                yield pd.DataFrame({"doc_id": pd.array(names, "Int64"), "start": b.start + np.array(bounds[:-1]), "n_tokens": np.diff(bounds), "ids_crc32": np.array(crc, np.int64)})

    return read_blocks(spark, path).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id`` and its ids."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b in frame.itertuples():
                ids, bounds, names = _read_block(b)
                yield pd.DataFrame({"doc_id": pd.array(names, "Int64"), "ids": [ids[x:y].astype(np.int64) for x, y in zip(bounds, bounds[1:], strict=False)]})

    return read_blocks(spark, path).mapInPandas(run, "doc_id long, ids array<long>")


def tokenizer_text(path: str | None = None) -> str:
    """Content of a tokenizer file on the driver; the public byte-level BPE by default."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


def tokenize_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes ``docs`` as token files to a new shared folder and reads them back, a row for each document."""
    path = shared_dir(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_text(tokenizer), path)
    return read_documents(docs.sparkSession, path)


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    return tokenize_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
