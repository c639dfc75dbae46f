"""Collocations against plain counting, and the tiles against dictionaries."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from defectflow.llm import collocations
from tests.llm.helpers import CLASH, EDGES


def plain_phrases(rows, least, top, covered=50):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in candidates.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    longest[part] = max(longest[part], a)
        scored = []
        for p, a in candidates.items():
            if len(p) == 2 and p in longest and 100 * longest[p] >= covered * a:
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), " ".join(p), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p, -a, left, right, totals[lang], -s) for i, (s, a, _, p, left, right) in enumerate(sorted(scored)[:top])]
    return out


def random_rows(seed, n, words=12):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "a", "é", "É", "b-c", "x's", "12", "\x1cz", "\xa0", "word", "W2"][:words]
    ends = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!", "\r\n", ";x:", "\x0b"]
    one = lambda: "".join(w + rng.choice(ends) for w in rng.choices(vocabulary, [2.0 ** -i for i in range(len(vocabulary))], k=rng.randint(0, 60)))
    return [(one(), rng.choice(["en", "en", "de", None, "und"])) for _ in range(n)]


def run(spark, rows, **parameters):
    frame = spark.createDataFrame([(i, t, lang, "s", 1, 1, "f", 2, 3, 4, 5.0, "r") for i, (t, lang) in enumerate(rows)], CLASH)
    return sorted(tuple(r) for r in collocations.phrases(frame, **parameters).collect())


@pytest.mark.parametrize(("seed", "chunk", "part", "dense", "waiting"), [(1, 1 << 21, 1 << 32, 8, 4_000_000), (2, 50, 7, 0, 20), (3, 200, 1 << 32, 1 << 40, 1)])
def test_as_plain_counting(spark, monkeypatch, seed, chunk, part, dense, waiting):
    for name, value in (("CHUNK_WORDS", chunk), ("PART_WORDS", max(part, 500) if part < 1 << 20 else part), ("DENSE", dense), ("WAITING", waiting)):
        monkeypatch.setattr(collocations, name, value)
    rows = random_rows(seed, 60) + [(t, s) for _, t, s in EDGES]
    assert run(spark, rows, top=25, min_count=4) == sorted(plain_phrases(rows, 4, 25))


def test_empty(spark):
    assert run(spark, [("a b", "en")] * 2) == []
    frame = spark.createDataFrame([(1, "a", "b", "c", 1, 1, "f", 2, 3, 4, 5.0, "r")], CLASH).limit(0)
    assert collocations.phrases(frame).count() == 0


def test_bands_and_tiles():
    ranks = np.arange(1, 5000)
    bands = collocations.band(ranks)
    for b in np.unique(bands).tolist():
        first, bits = collocations.bounds(b)
        assert ranks[bands == b].tolist() == [r for r in range(first, first + (1 << bits)) if r < 5000]
    rng = np.random.default_rng(5)
    x, y = (rng.zipf(1.3, 20_000).clip(1, 1 << 28) for _ in range(2))
    for dense in (0, 8):
        got = {}
        for tile, cells, counts in collocations.tiles(x, y):
            (x0, _), (y0, bits) = collocations.bounds(tile >> 8), collocations.bounds(tile & 255)
            got |= {(x0 + (c >> bits), y0 + (c & (1 << bits) - 1)): n for c, n in zip(cells.tolist(), counts.tolist(), strict=True)}
        assert got == Counter(zip(x.tolist(), y.tolist(), strict=True)), dense


def test_products_beyond_64_bits(spark):
    a, left, right = 3_000_000_000_017, 3_000_000_000_019, 7_000_000_000_001
    (got,) = spark.range(1).selectExpr(f"{a}L as a", f"{left}L as l", f"{right}L as r").select(collocations._score("a", "l", "r")).first()
    assert got == 10**6 * a * a // (left * right)


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 5)
    tokens = collocations.spelled("a b c d e f g. h i, j k l m n o p q r; s" * 3)
    parts = list(collocations._stretches(tokens))
    assert sum(parts, []) == tokens and len(parts) > 3 and all(p[0] == b"." for p in parts[1:])


def test_registered_query_equals_its_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = db.execute(collocations.OP13_SQL)
    names = [c[0] for c in want.description]
    got = collocations.op13_collocations(spark, sf_dir).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and got
