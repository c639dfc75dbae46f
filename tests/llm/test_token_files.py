"""Token files: what is asked of the tokenizers library, cuts in bytes, blocks and plans."""

import functools

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from defectflow.llm import token_files
from tests.llm.helpers import plain


@functools.cache
def encoder_once():
    return token_files.Encoder(token_files.tokenizer_text())


class Counting:
    """A tokenizer that counts the bytes it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.asked += sum(len(t.encode()) for t in texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_are_encoded_once():
    """More words than the cache held before; a second time none is given to the library."""
    encoder = token_files.Encoder(token_files.tokenizer_text())
    encoder.tokenizer = counting = Counting(encoder.tokenizer)
    texts = ["".join(f" w{i}" for i in range(at, at + 50_000)) for at in range(0, 450_000, 50_000)]
    first = [encoder.encode([t]) for t in texts]
    counting.asked = 0
    assert [encoder.encode([t]) for t in texts] == first
    assert counting.asked == 0


SPACES = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 ᠎ ​   　﻿"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(SPACES + "  ab9é×÷Ǆ漢’…²,.;:!?'-_<|>\U0001f600"), max_size=30), max_size=6))
def test_cuts_in_bytes(texts):
    encoder = encoder_once()
    ids, ends = encoder.encode_all(pa.array(texts, pa.string()), 0)
    whole = [e.ids + [0] for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for one in whole for i in one]
    assert ends.tolist() == np.cumsum([len(one) for one in whole]).tolist()


@pytest.mark.parametrize("texts", [["<|endoftext|>", "a <|endoftext|> b", "", "a <|endof text|>"], ["x" * 3000 + ", " + "y " * 3000], ["", "", "a", ""], []])
def test_texts_in_a_slice_of_a_column(texts):
    encoder = encoder_once()
    column = pa.array(["before it", *texts, "after it"], pa.string()).slice(1, len(texts))
    ids, ends = encoder.encode_all(column)
    assert [x.tobytes() for x in np.split(ids, ends[:-1])][: len(texts)] == encoder._ids(texts)


def test_bytes_that_are_no_utf8():
    encoder = encoder_once()
    texts = [b"ok \xff\xfe bad, \xc3 cut\xe2\x80 x", b"\x80 a", b"a\xc2"]
    ids, ends = encoder.encode_all(pa.array(texts, pa.binary()))
    assert [x.tobytes() for x in np.split(ids, ends[:-1])] == encoder._ids([t.decode("utf-8", "replace") for t in texts])


def test_blocks_are_not_shuffled_to_be_read(spark):
    """However large the blocks are: only their sums move."""
    path = token_files.shared_dir(spark, "t")
    token_files.write_tokens(plain(spark, [(i, f"text {i}", "a") for i in range(50)]), token_files.tokenizer_text(), path, block_ids=7)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        read = token_files.read_documents(spark, path)
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        rows = sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in read.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [r[0] for r in rows] == list(range(50))
    assert [r[1] for r in rows] == [0, *np.cumsum([r[2] for r in rows])[:-1].tolist()]
