"""Language identification against a plain naive Bayes, and its accuracy on held-out documents."""

import math
import zlib
from collections import Counter

import numpy as np

from defectflow.llm import language_id
from tests.llm.helpers import CLASH, EDGES

ROWS = [
    (1, "The cat sat on the mat.", "en"), (2, "the Dog and the bird, 12 things", "en"), (4, "Der Hund und die Katze", "de"), (5, "über die Brücke", "de"),
    (6, None, "de"), (8, "text", None), (9, "", "en"), (10, "a b c", "en"), (12, "x" * 40 + " y", "fr"), (12, "x" * 40 + " y", "fr"),
]


def grams(text):
    """n-grams of 1 to 4 letters and gaps, as one text."""
    letters = "".join(c.lower() if c.isalpha() else " " for c in text)
    for word in letters.split():
        padded = f" {word} "
        for k in language_id.ORDERS:
            for i in range(len(padded) - k + 1):
                if padded[i : i + k] != " ":
                    yield padded[i : i + k]


def bucket(gram):
    rolling = 0
    for c in gram:
        rolling = (rolling * 0x9E3779B1 + (0 if c == " " else ord(c))) % 2**32
    mixed = (rolling + len(gram)) * 0x85EBCA6B % 2**32
    mixed ^= mixed >> 15
    return mixed * 0xC2B2AE35 % 2**32 >> 16


def plain_model(rows):
    counts, docs = {}, Counter()
    for _, text, lang in rows:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(map(bucket, grams(text)))
            docs[lang] += 1
    return counts, docs


def plain_prediction(text, counts, docs):
    found = list(map(bucket, grams(text or "")))
    if not found or not docs:
        return "und", 0.0
    unit = language_id.SCALE
    posterior = {}
    for lang in sorted(docs):
        total = sum(counts[lang].values()) + language_id.BUCKETS
        log = lambda b: round((math.log(counts[lang][b] + 1) - math.log(total)) * unit)  # noqa: B023, E731
        posterior[lang] = round(math.log(docs[lang] / sum(docs.values())) * unit) + sum(map(log, found))
    best = max(posterior, key=lambda lang: posterior[lang])
    return best, 1 / sum(math.exp((v - posterior[best]) / unit) for v in posterior.values())


def frame(spark, rows, langs=True):
    return spark.createDataFrame([(d, t, lang, "s", 1, 1, "f", 2, 3, 4, 5.0, "r") for d, t, lang in rows], CLASH)


def test_as_plain_naive_bayes(spark):
    texts = ROWS + [(d, t, None) for d, t, _ in EDGES] + [(50, "Brücke the", None), (51, "ÉÀ", "x"), (52, "123 .,;", None), (53, "x", None)]
    model = language_id.train(frame(spark, ROWS))
    counts, docs = plain_model(ROWS)
    assert {r["lang"]: r["docs"] for r in model.collect()} == docs
    got = language_id.predict(frame(spark, texts), model).collect()
    assert len(got) == len(texts)
    want = Counter((d, t, *((p, round(s, 5)) if (p := plain_prediction(t, counts, docs)[0]) else ())) for d, t, _ in texts for s in [plain_prediction(t, counts, docs)[1]])
    assert Counter((r["doc_id"], r["text"], r["lang_pred"], round(r["score"], 5)) for r in got) == want


def test_blocks_of_languages_and_slices_change_nothing(spark, monkeypatch):
    rows = [(i, f"{'abcdefghij'[i % 10] * 3} word{chr(97 + i % 26)} the {i}", f"l{i % 7}") for i in range(70)]
    texts = [(100 + i, f"{'abcdefghij'[i % 10] * 3} the " * (i + 1), None) for i in range(10)] + [(120, None, None)]
    model = language_id.train(frame(spark, rows))
    whole = {tuple(r) for r in language_id.predict(frame(spark, texts), model).select("doc_id", "lang_pred", "score").collect()}
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    monkeypatch.setattr(language_id, "CHARS", 10)
    assert {tuple(r) for r in language_id.predict(frame(spark, texts), model).select("doc_id", "lang_pred", "score").collect()} == whole
    sliced, one = (np.zeros((1, 7), np.int64), np.zeros((1, language_id.BUCKETS), np.int32))
    monkeypatch.setattr(language_id, "LANGUAGES", 64)
    again = language_id.train(frame(spark, rows))
    key = lambda m: sorted((r["lang"], r["docs"], tuple(r["bucket"]), tuple(r["n"])) for r in m.collect())
    assert key(again) == key(model)


def test_nothing_learned_and_empty_tables(spark):
    none = language_id.train(frame(spark, ROWS[:1]).limit(0))
    got = language_id.predict(frame(spark, ROWS), none).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)} and len(got) == len(ROWS)
    assert language_id.predict(frame(spark, ROWS[:1]).limit(0), language_id.train(frame(spark, ROWS))).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = language_id.op11_language_id(spark, sf_dir).collect()
    assert len(got) == len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    judged = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == rows[r["doc_id"]]["lang"] for r in judged) >= 0.95 * len(judged) > 0
    assert all(0 <= r["score"] <= 1 for r in got)
