"""Licences in long texts: found wherever they stand, in time linear in the words."""

import random
import time

from defectflow.llm import licenses
from tests.llm.helpers import plain


def found(spark, rows):
    return {(r["doc_id"], r["license"]): (r["containment"], r["n_places"]) for r in licenses.scan_licenses(plain(spark, rows)).collect()}


def test_a_text_of_100_000_words_that_holds_the_gpl(spark):
    rng = random.Random(1)
    gpl = licenses.TEMPLATES["GPL-3.0-text"]
    code = [f"var{rng.randint(0, 10**6)} = call{rng.randint(0, 999)}(x);" for _ in range(25_000)]
    text = " ".join(code[:9000]) + "\n" + gpl + "\n" + " ".join(code[9000:]) + " Released under the MIT License."
    assert len(licenses.template_words(text)) > 80_000
    found(spark, [(1, gpl, "s")])
    alone = time.perf_counter()
    short = found(spark, [(1, gpl, "s")])
    alone = time.perf_counter() - alone
    began = time.perf_counter()
    long = found(spark, [(1, text, "s")])
    assert time.perf_counter() - began < alone + 5
    assert {k: v[0] for k, v in long.items() if k[1].startswith("GPL-3.0")} == {k: v[0] for k, v in short.items() if k[1].startswith("GPL-3.0")} and (1, "MIT-notice") in long


def test_a_notice_that_is_repeated_many_times(spark):
    text = " ".join(f"Released under the MIT License. {i}" for i in range(20_000))
    began = time.perf_counter()
    assert found(spark, [(1, text, "s"), (2, None, "s"), (3, "", "s")]).keys() == {(1, "MIT-notice")}
    assert time.perf_counter() - began < 60
