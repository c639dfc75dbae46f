"""Rows for the tests: nulls, empty and long texts, ties, repeated rows, and columns whose names clash with results."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    return WORD.findall(text or "")


CLASH = "doc_id long, text string, lang string, source string, n_chars long, n_words long, fingerprint string, key long, salt int, `begin` long, target double, rejected_by string"


def with_clashes(spark, rows):
    """rows: (doc_id, text, source)."""
    return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t), 1, "f", 2, 3, 4, 5.0, "r") for d, t, s in rows], CLASH)


def plain(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def documents(sf_dir, spark, limit=None):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    return rows[:limit]


EDGES = [
    (1, None, "a"), (2, "", None), (3, " \t\n\x0b ", "a"), (None, "one two three four five", "b"), (5, "x" * 5000, "b"),
    (6, "one two three four five", None), (6, "one two three four five", None), (7, "é è b c", "c"), (8, "word " * 3000, "a"),
    (9, "L1 a b\nL1 a b\n\nL1 a b\nother line", "a"), (10, "<|endoftext|> a <|endoftext|>", "z"), (11, "A  b\n c\td 's 's  !!  x", "z"),
]
