"""Equal values in every grouping keep one pseudonym; the key is in no plan."""

import re

import pytest
from pyspark.sql import functions as F

from defectflow.llm import pii
from tests.llm.helpers import plain

GROUPINGS = {
    "iban": ["GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32"],
    "iban2": ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00"],
    "card": ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"],
    "amex": ["378282246310005", "3782 822463 10005", "3782-822463-10005"],
    "phone": ["+442079460958", "+44 20 7946 0958", "+44-20-7946-0958", "+44.2079.460958"],
    "phone3": ["+35312345678", "+353 1234 5678", "+353 12 345678"],
    "phone1": ["+15551234567", "+1 (555) 123-4567", "+1 555 123 4567", "+1-555-123-4567"],
    "local": ["(555) 123-4567", "555-123-4567", "555.123.4567", "555 123 4567", "(555)123 4567"],
    "ssn": ["123-45-6789", "123 45 6789"],
    "late": ["1999-12-30", "1999/12/30", "30.12.1999", "30/12/1999", "12/30/1999", "30 December 1999", "30 Dec 1999", "December 30, 1999", "Dec 30, 1999"],
    "early": ["2004-05-06", "2004/05/06", "06.05.2004", "05/06/2004", "5/6/2004", "6 May 2004", "May 6, 2004"],
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def bare(kind, text):
    """The value without its form."""
    if kind not in ("late", "early"):
        return re.sub(r"[^A-Za-z0-9]", "", text)
    if word := re.search("[A-Za-z]+", text):
        day, year = re.findall(r"\d+", text)
        return int(year), MONTHS.index(word[0][:3].lower()) + 1, int(day)
    a, b, c = map(int, re.findall(r"\d+", text))
    if a > 1000:
        return a, b, c
    return (c, b, a) if "." in text or a > 12 else (c, a, b)


@pytest.mark.parametrize("key", ["k", "k2", "another key \n é"])
def test_every_kind_in_every_grouping(spark, key):
    values = [(kind, v) for kind, some in GROUPINGS.items() for v in some]
    rows = [(i, f"it is {v}, yes", "s") for i, (_, v) in enumerate(values)]
    got = {r["doc_id"]: r["text"] for r in pii.protect(plain(spark, rows), key).collect()}
    made = {}
    for i, (kind, v) in enumerate(values):
        new = re.fullmatch("it is (.*), yes", got[i])[1]
        assert new != v and re.sub("[0-9]", "0", re.sub("[A-Z]", "A", new)) == re.sub("[0-9]", "0", re.sub("[A-Z]", "A", v)) or kind in ("late", "early"), (v, new)
        made.setdefault(kind, set()).add(bare(kind, new))
    assert {kind: len(x) for kind, x in made.items()} == dict.fromkeys(GROUPINGS, 1), made


def test_addresses_keep_their_case_and_stay_linked(spark):
    rows = [(0, "alice.smith@x.org", "s"), (1, "Alice.Smith@x.org", "s"), (2, "ALICE.SMITH@x.org", "s"), (3, "aLiCe.sMiTh@x.org", "s")]
    got = [r["text"] for r in pii.protect(plain(spark, rows), "k").orderBy("doc_id").collect()]
    assert len({t.lower() for t in got}) == 1 and got[0] == got[0].lower() != rows[0][1]
    for (_, old, _), new in zip(rows, got, strict=True):
        assert [c.isupper() for c in old] == [c.isupper() for c in new]


def test_the_key_is_in_no_plan(spark):
    docs = pii.protect(plain(spark, [(1, "call +1 555 123 4567", "s")]), "TOPSECRETKEY")
    docs.collect()
    plan = docs._jdf.queryExecution()
    for text in (plan.toString(), plan.logical().toString(), plan.executedPlan().toString(), plan.stringWithStats(), spark.sparkContext.getConf().toDebugString()):
        assert "TOPSECRETKEY" not in text and "TOPSECRETKEY".encode().hex() not in text.lower()
    same = spark.createDataFrame([("call +1 555 123 4567",)], "text string").select(pii.pseudonymize(F.col("text"), "TOPSECRETKEY").alias("t")).first()["t"]
    assert docs.first()["text"] == same
