"""The pipeline's stages, each on what the one before kept, against brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from defectflow.llm import common, mixing
from tests.llm.helpers import CLASH, EDGES, documents, split, with_clashes
from tests.llm.test_contracts import brute_components, brute_print, brute_quality, brute_targets, library_ids
from tests.llm.test_more import brute_leaks

ITEMS = "item_id long, text string, row int"


def written(spark, path, rows, items):
    with_clashes(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def stages(spark, path):
    """Rows of each stage's input and the last result, as the stages are run: written and read again."""
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(common.materialize(stage(spark, seen[-1], path), name.replace(" ", "-")))
    return seen


def rows_of(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()]


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    good = lambda name, n=120: " ".join(f"{name}{i} and so on" for i in range(n // 4))
    items = [(i, t, 1) for i, t in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()] + [(None, None, 1), (5, "", 1)]
    rows = EDGES + documents(sf_dir, spark)
    rows += [(9000, good("a"), "s"), (9001, good("a"), "t"), (9001, good("a"), "t"), (None, good("a"), None), (None, good("b"), None), (9002, good("c") + " " + items[0][1] + " " + good("d"), "s"), (9003, good("e", 4000), "s")]
    path = written(spark, tmp_path, rows, items)
    docs, kept, single, clean, mix, tokens = stages(spark, path)
    columns = docs.columns
    assert all(df.columns == columns for df in (kept, single, clean, mix)) and tokens.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]

    at = rows_of(kept)
    assert Counter(at) == Counter(r for r in rows if brute_quality(r[1])[-1])
    prints = {t: brute_print(t) for _, t, _ in at}
    roots = brute_components(list(prints.values()))
    groups = defaultdict(list)
    for r in at:
        groups[roots[prints[r[1]]]].append(r)
    one = rows_of(single)
    assert len(one) == len(groups)
    for d, t, _ in one:
        ids = [x for x, *_ in groups[roots[prints[t]]] if x is not None]
        assert d == min(ids, default=None)
    leaks, _ = brute_leaks([(i, t, s) for i, (_, t, s) in enumerate(one)], [(i, t) for i, t, _ in items])
    left = rows_of(clean)
    assert Counter(left) == Counter(r for i, r in enumerate(one) if i not in {x for x, _ in leaks}) and 9002 not in {d for d, *_ in left}

    sizes, taken = Counter(), Counter()
    for _, t, s in left:
        sizes[s] += len(split(t))
    out = rows_of(mix)
    for _, t, s in out:
        taken[s] += len(split(t))
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    targets = brute_targets([sizes[s] for s in names], [(3.0, 1.0, 2.0)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()))
    for s, target in zip(names, targets, strict=True):
        assert abs(taken[s] - target) <= 2 * mixing.BLOCK_WORDS
    words = {(d, s): set(split(t)) for d, t, s in left}
    assert all(set(split(t)) <= words[d, s] for d, t, s in out) and max(Counter((d, s) for d, _, s in out).values()) <= 2

    order = sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for (d, *_), ids in zip(order, library_ids([t or "" for _, t, _ in order]), strict=True):
        ids = [*ids, 0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in tokens.orderBy("start").collect()] == want
    assert Counter(map(tuple, corpus_pipeline.run(spark, path).collect())) == Counter(want), "run() is the stages one after the other, and reruns agree"


@pytest.mark.parametrize(("rows", "items"), [([], [(1, "a b c d e f. g h", 1)]), ([(1, "w" * 5, "s"), (None, None, None)], []), ([], [])])
def test_empty_tables(spark, tmp_path, rows, items):
    path = written(spark, tmp_path, rows, items)
    seen = stages(spark, path)
    assert [df.count() for df in seen[1:]] == [0] * 5 and seen[1].columns == [c.split()[0].strip("`") for c in CLASH.split(", ")]


def test_empty_benchmark_keeps_all(spark, sf_dir, tmp_path):
    rows = documents(sf_dir, spark)
    seen = stages(spark, written(spark, tmp_path, rows, []))
    assert seen[3].count() == seen[2].count() > 0
