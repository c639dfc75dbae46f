"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from defectflow.shared import look_up, materialize, release, shared_dir  # noqa: F401  (for the operators)

#: What separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text, in order; none for null. A split at one plain character needs no regular expression."""
    return F.array_remove(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " "), " "), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_bytes(text: str | None) -> list[bytes]:
    """The same words in a task's Python: bytes.split() cuts at the same six bytes."""
    return text.encode("utf-8", "replace").split() if text else []


def pieces(frames: Iterator[pd.DataFrame], column: str = "text", limit: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Frames whose texts have about ``limit`` characters together (a longer text stays whole), for bounded memory."""
    for frame in frames:
        size = frame[column].str.len().fillna(0).to_numpy(dtype="int64")
        cut = np.cumsum(size) // limit
        for _, part in frame.groupby(cut, sort=False):
            yield part


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` consecutive word hashes, by start."""
    n = max(len(h) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(k if n else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mix(out)
