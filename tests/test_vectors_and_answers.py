"""Pruned neighbours, pooled vectors, the ledger of asked batches and evidence search against plain code."""

import random
import string
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from defectflow import answers, dataset, retrieval


def vectors(seed, n, width, clusters):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 100, (clusters, width))
    out = [(i, (centers[i % clusters] + rng.normal(0, 1, width)).round(3).tolist()) for i in range(n)]
    return out + [(n + i, out[i][1]) for i in range(7)]  # equal vectors


def plain_knn(queries, stored, k):
    v, ids = np.array([x for _, x in stored]), np.array([i for i, _ in stored])
    for q, x in queries:
        square = ((np.array(x) - v) ** 2).sum(axis=1)
        order = np.lexsort((ids, square))[:k]
        yield from ((q, int(ids[j]), round(float(np.sqrt(square[j])), 6), rank + 1) for rank, j in enumerate(order))


@pytest.mark.parametrize(("k", "clusters", "block"), [(5, 20, 120), (40, 20, 120), (3, 1, 60), (5, 20, 1 << 22), (1000, 3, 200)])
def test_neighbours_by_pruned_search(spark, monkeypatch, k, clusters, block):
    stored = vectors(k, 300, 6, clusters)
    queries = [(1000 + i, x) for i, (_, x) in enumerate(vectors(k, 60, 6, clusters)[:50])] + [(2000, [1e3] * 6)]
    monkeypatch.setattr(retrieval, "STRIPE", 37)
    asked, meet = [], retrieval._meet
    monkeypatch.setattr(retrieval, "_meet", lambda a, b, n: asked.append((a.select(F.size("q_ids")).collect(), b.count())) or meet(a, b, n))
    schema = "id long, embedding array<double>"
    rows = retrieval.knn(spark.createDataFrame(queries, schema), spark.createDataFrame([*stored, (9999, None)], schema), k, block).collect()
    assert sorted((r["query_id"], r["id"], round(r["distance"], 6), r["rank"]) for r in rows) == sorted(plain_knn(queries, stored, k))
    if clusters == 20 and k == 5 and block == 120:  # queries meet few of the blocks
        met, blocks = sum(n for pairs, _ in asked for (n,) in pairs), asked[0][1]
        assert blocks > 10 and met < 0.5 * len(queries) * blocks


def test_neighbours_of_nothing(spark):
    schema = "id long, embedding array<float>"
    one, none = spark.createDataFrame([(1, [1.0])], schema), spark.createDataFrame([], schema)
    assert retrieval.knn(one, none, 3).count() == 0 and retrieval.knn(none, one, 3).count() == 0


def test_pools_of_768_numbers(spark, monkeypatch):
    rng = np.random.default_rng(1)
    width, n = 768, 400
    x = rng.normal(0, 1, (n, width)).astype(np.float32)
    mask, key = rng.integers(0, 2, n), [None if i % 11 == 0 else i % 9 for i in range(n)]
    rows = [(k, str(k), int(m), v.tolist()) for k, m, v in zip(key, mask, x, strict=True)] + [(50, "50", 1, None), (51, "51", 0, [1.0] * width)]
    frame = spark.createDataFrame(rows, "a int, b string, mask int, embedding array<float>").repartition(5)
    for held in (1 << 22, 3 * width):
        monkeypatch.setattr(dataset, "HELD", held)
        pooled = dataset.mean_pool(frame, ["a", "b"], width)
        got = {r["a"]: r["vector"] for r in pooled.collect()}
        assert len(got) == 12 and got[50] == got[51] == [0.0] * width
        for k in set(key):
            mine = [i for i in range(n) if key[i] == k and mask[i]]
            np.testing.assert_allclose(got[k], x[mine].astype(float).mean(axis=0), atol=1e-9)
    marks = spark.createDataFrame([(i % 4, i) for i in range(0, n, 2)], "commit_hash int, node_ix int")
    nodes = spark.createDataFrame([(i % 4, i, v.tolist()) for i, v in enumerate(x)], "commit_hash int, node_ix int, vector array<float>")
    top = {r["commit_hash"]: r["vector"] for r in dataset.max_pool_marked(nodes, marks, nodes.select("commit_hash").union(spark.range(9, 10)), width).collect()}
    assert top[1] == top[3] == top[9] == [0.0] * width
    np.testing.assert_allclose(top[2], x[2::4].max(axis=0))
    weights = {0: rng.normal(0, 1, width).tolist(), 1: [2.0] * width}
    edges = [(c, s, c, t) for c in range(4) for s in range(c, n, 4) for t in (0, 1, 7)]
    sums = {(r["commit_hash"], r["node_ix"]): r["vector"] for r in dataset.typed_neighbor_sum(nodes, spark.createDataFrame(edges, "commit_hash int, src_ix int, dst_ix int, type_code int"), weights).collect()}
    assert len(sums) == n and sums[0, 4] == [0.0] * width
    np.testing.assert_allclose(sums[3, 3], x[3::4].astype(float).sum(axis=0) * (np.array(weights[0]) + 2), atol=1e-6)
    assert dataset.mean_pool(frame.limit(0), ["a", "b"], width).count() == 0


def test_one_row_for_each_key_and_task_is_shuffled(spark):
    frame = spark.range(0, 3000, 1, 3).select((F.col("id") % 5).alias("a"), F.lit(1).alias("mask"), F.array(*[F.col("id").cast("float")] * 4).alias("embedding"))
    pooled = dataset.mean_pool(frame, ["a"], 4)
    pooled.collect()
    plan, found = [pooled._jdf.queryExecution().executedPlan().finalPhysicalPlan()], []
    while plan:
        p = plan.pop()
        name = p.nodeName()
        if name == "Exchange":
            found.append(p.metrics().apply("shuffleRecordsWritten").value())
        children = p.children()
        plan += [children.apply(i) for i in range(children.size())] + ([p.plan()] if name.endswith("QueryStage") else [])
    assert found == [15]


def asker(log, dies_at=None, fails=()):
    def ask(contexts):
        with open(log, "a+") as f:
            f.seek(0)
            if dies_at is not None and len(f.read().splitlines()) >= dies_at:
                raise KeyboardInterrupt  # as if the task were lost
            if any(c in fails for c in contexts):
                raise RuntimeError("no service")
            f.write("".join(f"{c}\n" for c in contexts))
        return [f"about {c}" for c in contexts]

    return ask


def test_each_batch_is_asked_once_over_failures_actions_and_runs(spark, tmp_path):
    log, ledger = str(tmp_path / "log"), str(tmp_path / "ledger")
    df = spark.createDataFrame([(i, f"c{i}", i) for i in range(60)], "commit_hash long, context string, answer int")
    with pytest.raises(Exception, match="KeyboardInterrupt"):
        answers.score_batch(df, asker(log, dies_at=20), 2, 4, ledger)
    before = open(log).read().splitlines()
    assert 20 <= len(before) < 60
    told = answers.score_batch(df, asker(log), 2, 4, ledger)
    assert told.count() == 60
    assert {r["answer"] for r in told.collect()} == {f"about c{i}" for i in range(60)}
    assert sorted(open(log).read().splitlines()) == sorted(f"c{i}" for i in range(60))
    again = answers.score_batch(df.union(spark.createDataFrame([(99, "c99", 1)], df.schema)), asker(log), 2, 4, ledger)
    assert again.count() == 61 and open(log).read().splitlines().count("c99") == 1 and len(open(log).read().splitlines()) == 61


def test_a_failed_batch_keeps_its_error_and_is_asked_again(spark, tmp_path):
    log, ledger = str(tmp_path / "log"), str(tmp_path / "ledger")
    df = spark.createDataFrame([(str(i), None if i == 3 else f"c{i}") for i in range(20)], "commit_hash string, context string")
    first = {r["commit_hash"]: r for r in answers.score_batch(df, asker(log, fails=("c7",)), 2, 3, ledger).collect()}
    assert first["7"]["answer"] is None and first["7"]["error"] == "RuntimeError: no service"
    assert sum(r["answer"] is None for r in first.values()) < 12
    second = answers.score_batch(df, asker(log), 2, 3, ledger).collect()
    assert all(r["answer"] and r["error"] is None for r in second) and len(open(log).read().splitlines()) == 20
    assert answers.score_batch(df.limit(0), asker(log)).count() == 0


def test_a_retried_task_asks_no_written_batch_again(tmp_path):
    import pandas as pd

    frame = pd.DataFrame({"batch": [1, 1, 2], "commit_hash": ["a", "b", "c"], "context": ["x", "y", "z"]})
    run = answers._ask(asker(str(tmp_path / "log")), str(tmp_path / "run"))
    assert [int(f["n"].sum()) for _ in range(2) for f in run(iter([frame.iloc[:2], frame.iloc[2:]]))] == [3, 0]


def test_evidence_is_searched_as_substrings():
    rng = random.Random(2)
    for _ in range(300):
        texts = ["".join(rng.choices("abé", k=rng.randint(0, 12))) for _ in range(rng.randint(0, 4))]
        parts = ["".join(rng.choices("abé", k=rng.randint(0, 4))) for _ in range(rng.randint(0, 9))]
        assert answers.n_found(texts, parts) == sum(p != "" and any(p in t for t in texts) for p in parts)


def test_evidence_of_a_commit_with_many_lines_takes_seconds():
    rng = random.Random(3)
    texts = ["".join(rng.choices(string.ascii_letters, k=60)) for _ in range(1000)]
    parts = [(t := rng.choice(texts))[(i := rng.randint(0, 50)) : i + 9] if n % 2 else "".join(rng.choices(string.ascii_letters, k=30)) for n in range(100_000)]
    began = time.perf_counter()
    assert answers.n_found(texts, parts) >= 50_000
    assert time.perf_counter() - began < 15
