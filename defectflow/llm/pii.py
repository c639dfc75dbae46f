"""Format-preserving Feistel pseudonyms for personal numbers and dates.

Values are found by pattern and validated: card numbers (13 to 19 digits, unbroken or in groups) by Luhn's check digit, IBAN by its remainder of 97, dates by the calendar, IPv4 by its four bytes, US social
security numbers by their ranges, phone numbers by their form and number of digits. A valid value becomes another valid value of the same format: its free digits are split in two halves that take turns adding a
keyed hash (SHA-256 over the key, the kind, the round and the other half), modulo their number of values, which is a permutation of the whole format; check digits are computed anew, and where a format has fewer
values than the network, steps are repeated until one is met. The same value and key give the same pseudonym in every document, whatever its separators, grouping or date format, so links between documents stay. E-mail addresses keep
their domain and case, access keys their prefix; in them, in hexadecimal secrets, IPv6 addresses and account numbers each letter or digit turns within its own class, by a network over two parts of each character. Separators and surrounding text stay as they are. Built-in columns only.

Dates: ``1999-12-31``, ``1999/12/31``, ``31.12.1999``, ``12/31/1999`` (day first if it can't be a month), ``31 December 1999``, ``December 31, 1999`` and short English months, from 1900 to 2099. Phones: ``+`` and 8 to 15 digits,
``(555) 123-4567``, ``555-123-4567`` (also with dots or blanks); the country code stays.

Defined results: a null text stays null; texts without a valid value are unchanged; invalid look-alikes are unchanged; long texts are read whole; repeated rows each get their row;
an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectflow.llm.common import let, shared_dir

ROUNDS = 8
DAYS = 73_049  # 1900-01-01 to 2099-12-31
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_YEAR = r"(?:19|20)\d\d"

#: Tried in this order at each place; no group is captured.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*\d)(?=[0-9A-Fa-f:]*::)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsur]_[A-Za-z0-9]{36,255}|sk-[A-Za-z0-9_-]{20,200}|xox[abprs]-[A-Za-z0-9-]{10,200}|AIza[0-9A-Za-z_-]{35})(?![A-Za-z0-9])",
    "secret": r"(?<![0-9A-Za-z])(?=[0-9]*[a-fA-F])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "phone": r"\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+\d{1,3}(?:(?: \d{2,8}(?!\d|\.\d)){1,5}|(?:-\d{2,8}(?!\d)){1,5}|(?:\.\d{2,8}(?!\d)){1,5})|\+\d{8,15}(?!\d)"
    r"|(?<![\w)])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3} \d{3} \d{4})(?![\d-])",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d)",
    "date": rf"(?<![\d/.-])(?:{_YEAR}-\d\d-\d\d|{_YEAR}/\d\d/\d\d|\d\d\.\d\d\.{_YEAR}|\d{{1,2}}/\d{{1,2}}/{_YEAR})(?![\d/-])|(?<!\d)\d{{1,2}} {_MONTH} {_YEAR}(?!\d)|(?<![A-Za-z]){_MONTH} \d{{1,2}}, {_YEAR}(?!\d)",
    "ssn": r"(?<![\d-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4})(?![\d-])",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}(?:-\d{4}){3}(?:-\d{3})?|\d{4}(?: \d{4}){3}(?: \d{3}(?!\d))?|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
}
PATTERN = "|".join(PATTERNS.values())
ALNUM = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
HEX = ("0123456789", "abcdef", "ABCDEF")


def _hash(key: Column, what: str, *values: Column) -> Column:
    """A keyed hash from 0 to 2^48."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(what), *(v.cast("string") for v in values)), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def feistel(value: Column, left_size: int, right_size: int, key: Column, what: str) -> Column:
    """A keyed permutation of 0 to left_size * right_size - 1."""
    start = F.struct((F.floor(value / right_size)).cast("long").alias("l"), F.pmod(value, F.lit(right_size)).cast("long").alias("r"))

    def turn(s: Column, r: Column) -> Column:
        left = F.when(r % 2 == 0, F.pmod(s["l"] + _hash(key, what, r, s["r"]), F.lit(left_size))).otherwise(s["l"])
        right = F.when(r % 2 == 1, F.pmod(s["r"] + _hash(key, what, r, s["l"]), F.lit(right_size))).otherwise(s["r"])
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    return let(done, lambda s: s["l"] * right_size + s["r"])


def _characters(text: Column, classes: tuple[str, ...], key: Column, what: str) -> Column:
    """Characters turn within their class, all others stay. Each character's place in its class is 2 * high + low; all highs and all lows are the halves of a Feistel network."""
    known = F.filter(F.transform(F.split(text, ""), lambda c: c), lambda c: c != "")

    def place(c: Column) -> Column:
        out = F.struct(F.lit(0).alias("k"), F.lit(0).alias("h"), F.lit(0).alias("l"), F.lit(0).alias("n"))
        for k, letters in enumerate(classes, 1):
            at = F.instr(F.lit(letters), c) - 1
            out = F.when(at >= 0, F.struct(F.lit(k).alias("k"), F.floor(at / 2).cast("int").alias("h"), (at % 2).alias("l"), F.lit(len(letters) // 2).alias("n"))).otherwise(out)
        return out

    def turn(s: Column, r: Column) -> Column:
        half = lambda name: F.array_join(F.transform(s, lambda x: x[name].cast("string")), ",")

        def moved(x: Column, i: Column, other: Column) -> Column:
            add = _hash(key, what, r, i, other)
            high = F.when(r % 2 == 0, F.pmod(x["h"] + add, F.greatest(x["n"], F.lit(1)))).otherwise(x["h"]).cast("int")
            low = F.when(r % 2 == 1, F.pmod(x["l"] + add, F.lit(2))).otherwise(x["l"]).cast("int")
            return F.when(x["k"] > 0, F.struct(x["k"].alias("k"), high.alias("h"), low.alias("l"), x["n"].alias("n"))).otherwise(x)

        return F.flatten(F.transform(F.array(F.when(r % 2 == 0, half("l")).otherwise(half("h"))), lambda other: F.transform(s, lambda x, i: moved(x, i, other))))

    def written(pair: Column) -> Column:
        out = pair["c"]
        for k, letters in enumerate(classes, 1):
            out = F.when(pair["x"]["k"] == k, F.substring(F.lit(letters), pair["x"]["h"] * 2 + pair["x"]["l"] + 1, F.lit(1))).otherwise(out)
        return out

    done = let(known, lambda cs: F.arrays_zip(cs.alias("c"), F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.transform(cs, place), turn).alias("x")))
    return F.array_join(F.transform(done, written), "")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _put(m: Column, digits: Column, taken: Callable[[Column], Column] = lambda c: c.between("0", "9")) -> Column:
    """``m`` with its digits (or other ``taken`` characters) replaced in order."""
    chars = F.filter(F.split(m, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def add(s: Column, c: Column) -> Column:
        own = taken(c)
        return F.struct(F.concat(s["out"], F.when(own, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + F.when(own, 1).otherwise(0)).alias("at"))

    return F.aggregate(chars, start, add, lambda s: s["out"])


def _number(digits: Column, low: int, high: int, key: Column, what: str) -> Column:
    """``low`` to ``high`` digits to as many digits."""
    out = None
    for n in range(low, high + 1):
        a = n // 2
        new = F.lpad(feistel(digits.cast("decimal(20,0)").cast("long"), 10**a, 10 ** (n - a), key, f"{what}{n}").cast("string"), n, "0")
        out = F.when(F.length(digits) == n, new) if out is None else out.when(F.length(digits) == n, new)
    return out


def _digit_sum(digits: Column, odd_doubled: bool) -> Column:
    """Luhn's sum; ``odd_doubled``: the last digit counts double."""

    def add(total: Column, pair: Column) -> Column:
        d = pair["d"].cast("int")
        twice = pair["i"] % 2 == (0 if odd_doubled else 1)
        return total + F.when(twice & (d > 4), 2 * d - 9).when(twice, 2 * d).otherwise(d)

    placed = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    return F.aggregate(F.filter(placed, lambda p: p["d"] != ""), F.lit(0), add)


def luhn_valid(digits: Column) -> Column:
    return _digit_sum(digits, False) % 10 == 0


def _card(m: Column, key: Column) -> Column:
    def new(d: Column) -> Column:
        body = _number(F.substring(d, F.lit(1), F.length(d) - 1), 12, 18, key, "card")
        return F.when(luhn_valid(d), _put(m, let(body, lambda b: F.concat(b, F.pmod(-_digit_sum(b, True), F.lit(10)).cast("string"))))).otherwise(m)

    return let(_digits(m), new)


def _ip(m: Column, key: Column) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("long"))
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda t, p: t * 256 + p)
    new = let(feistel(value, 1 << 16, 1 << 16, key, "ip"), lambda v: F.concat_ws(".", *(F.pmod(F.shiftright(v, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0))))
    return F.when(F.forall(parts, lambda p: p <= 255), new).otherwise(m)


def _date(m: Column, key: Column) -> Column:
    """Days from 1900-01-01. Of the 281 * 260 = 73,060 values of the network 73,049 are days. Written day first, only the 13th and later can be read again; so, whatever the format, days up to the 12th and
    later ones turn among themselves. Steps repeat until such a day is met, which happens at the latest at the date itself, at the end of its cycle."""
    first = F.lit("1900-01-01").cast("date")
    ahead = F.split(m, "/")[0].cast("int") > 12
    name = lambda plain, short: F.when(m.rlike(r"[A-Za-z]{4}"), plain).otherwise(short)
    fmt = (
        F.when(m.rlike(r"^\d{4}-"), "yyyy-MM-dd").when(m.rlike(r"^\d{4}/"), "yyyy/MM/dd").when(m.contains("."), "dd.MM.yyyy")
        .when(m.contains("/"), F.when(F.length(m) == 10, F.when(ahead, "dd/MM/yyyy").otherwise("MM/dd/yyyy")).otherwise(F.when(ahead, "d/M/yyyy").otherwise("M/d/yyyy")))
        .when(m.contains(","), name("MMMM d, yyyy", "MMM d, yyyy")).otherwise(name("d MMMM yyyy", "d MMM yyyy"))
    )

    def new(fmt: Column) -> Column:
        day = F.datediff(F.try_to_timestamp(m, fmt).cast("date"), first).cast("long")
        late = lambda v: F.dayofmonth(F.date_add(first, F.least(v, F.lit(DAYS)).cast("int"))) > 12
        outside = lambda v: (v >= DAYS) | (late(v) != late(day))
        step = lambda v: feistel(v, 281, 260, key, "date")
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(99)), step(day), lambda v, _: F.when(outside(v), step(v)).otherwise(v))
        # A longer walk is an event of less than 1 in 10^21 a date; the date then stands for itself.
        return let(walked, lambda v: F.when(day.isNull() | ~day.between(0, DAYS - 1), m).otherwise(F.call_function("date_format", F.date_add(first, F.when(outside(v), day).otherwise(v).cast("int")), fmt)))

    return let(fmt, new)


def _ssn(m: Column, key: Column) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999: each free part is one mixed-radix digit."""
    area, group, serial = F.substring(m, 1, 3).cast("long"), F.substring(m, 5, 2).cast("long"), F.substring(m, 8, 4).cast("long")
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    rank = area - 1 - F.when(area > 666, 1).otherwise(0)
    value = (rank * 99 + group - 1) * 9999 + serial - 1

    def back(v: Column) -> Column:
        a = F.floor(v / (99 * 9999)).cast("long")
        named = a + 1 + F.when(a >= 665, 1).otherwise(0)
        return _put(m, F.format_string("%03d%02d%04d", named, F.pmod(F.floor(v / 9999).cast("long"), F.lit(99)) + 1, F.pmod(v, F.lit(9999)) + 1))

    return F.when(valid, let(feistel(value, 898 * 99, 9999, key, "ssn"), back)).otherwise(m)


#: Country codes of one and of two digits; all others have three.
CODES = "^(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"


def _phone(m: Column, key: Column) -> Column:
    """The country code (after ``+``) stays, the other digits are one number, whatever the separators."""

    def new(d: Column) -> Column:
        code = F.when(m.startswith("+"), F.when(d.rlike(CODES), F.regexp_extract(d, CODES, 0)).otherwise(F.substring(d, 1, 3))).otherwise("")
        return let(code, lambda c: _put(m, F.concat(c, let(F.substring(d, F.length(c) + 1, F.length(d)), lambda r: _number(r, 5, 14, key, "phone")))))

    return let(_digits(m), lambda d: F.when(F.length(d).between(8, 15), new(d)).otherwise(m))


def _email(m: Column, key: Column) -> Column:
    """Addresses that differ in case alone stay linked, and each letter keeps its case."""
    local = F.substring_index(m, "@", 1)
    new = _characters(F.lower(local), ALNUM[:2], key, "email")
    letters = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    cased = F.transform(F.arrays_zip(letters(local).alias("old"), letters(new).alias("new")), lambda x: F.when(x["old"].between("A", "Z"), F.upper(x["new"])).otherwise(x["new"]))
    return F.concat(F.array_join(cased, ""), F.lit("@"), F.substring_index(m, "@", -1))


def _remainder(text: Column) -> Column:
    """Of 97, letters counting as 10 to 35."""

    def add(r: Column, c: Column) -> Column:
        letter = F.instr(F.lit(ALNUM[2]), c)
        return F.when(c == "", r).when(letter > 0, F.pmod(r * 100 + letter + 9, F.lit(97))).otherwise(F.pmod(r * 10 + c.cast("int"), F.lit(97))).cast("int")

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _iban(m: Column, key: Column) -> Column:
    """Country and grouping stay, the account turns by character of its unspaced form, the check digits are new. A last group that is a following word is left out."""
    bare = lambda t: F.replace(t, F.lit(" "), F.lit(""))
    valid = lambda t: let(bare(t), lambda b: F.length(b).between(15, 34) & (_remainder(F.concat(F.substring(b, 5, 34), F.substring(b, 1, 4))) == 1))

    def new(t: Column) -> Column:
        def written(b: Column) -> Column:
            account = _characters(F.substring(b, 5, 60), (ALNUM[0], ALNUM[2]), key, "iban")
            return let(account, lambda a: F.concat(F.substring(b, 1, 2), F.lpad((98 - _remainder(F.concat(a, F.substring(b, 1, 2), F.lit("00")))).cast("string"), 2, "0"), a))

        return let(let(bare(t), written), lambda w: _put(t, w, lambda c: c != " "))

    short = F.regexp_replace(m, " [A-Z0-9]{1,4}$", "")
    return F.when(valid(m), new(m)).when(valid(short), F.concat(new(short), F.substring(m, F.length(short) + 1, F.lit(9)))).otherwise(m)


def _key(m: Column, key: Column) -> Column:
    head = F.regexp_extract(m, r"^(AKIA|ASIA|gh[a-z]_|sk-|xox[a-z]-|AIza)", 1)
    return F.concat(head, _characters(F.substring(m, F.length(head) + 1, F.length(m)), ALNUM, key, "key"))


def pseudonym(m: Column, key: Column) -> Column:
    """The pseudonym of one matched value; the value itself if it isn't valid."""
    makers: dict[str, Callable[[Column, Column], Column]] = {
        "email": _email, "ipv6": lambda x, k: _characters(x, HEX, k, "ipv6"), "iban": _iban, "key": _key, "secret": lambda x, k: _characters(x, HEX, k, "secret"), "phone": _phone, "ip": _ip, "date": _date,
        "ssn": _ssn, "card": _card,
    }
    out = None
    for name, make in makers.items():
        whole = m.rlike(f"^(?:{PATTERNS[name]})$")
        out = F.when(whole, make(m, key)) if out is None else out.when(whole, make(m, key))
    return out.otherwise(m)


def pseudonymize(text: Column, key: Column | str) -> Column:
    """The text with every valid value replaced: the pieces between matches are joined with the pseudonyms. A ``key`` that is text stands in the plan; ``protect`` keeps it out."""
    key = F.lit(key) if isinstance(key, str) else key

    def joined(found: Column) -> Column:
        new = F.transform(found, lambda m: pseudonym(m, key))
        parts = F.arrays_zip(F.split(text, PATTERN).alias("a"), new.alias("b"))
        return F.array_join(F.flatten(F.transform(parts, lambda p: F.array(F.coalesce(p["a"], F.lit("")), F.coalesce(p["b"], F.lit(""))))), "")

    found = F.regexp_extract_all(text, F.lit(f"({PATTERN})"), F.lit(1))
    return F.when(text.rlike("[0-9@]"), let(found, lambda f: F.when(F.size(f) > 0, joined(f)).otherwise(text))).otherwise(text)


def _with_key(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the key as column ``__key``, read by the tasks from a file of one line in the shared folder that only its owner may read: no plan, log or page shows it."""
    if not key:
        raise ValueError("a secret key is needed")
    spark = docs.sparkSession
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(shared_dir(spark, "pii"))
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(folder, jvm.org.apache.hadoop.fs.permission.FsPermission("700"))
    out = store.create(jvm.org.apache.hadoop.fs.Path(folder, "key"))
    out.write(bytearray(key.encode().hex().encode()))
    out.close()
    line = spark.read.schema("__key string").text(folder.toString())
    return docs.crossJoin(F.broadcast(line.select(F.decode(F.unhex("__key"), "UTF-8").alias("__key"))))  # one row


def protect(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``text`` replaced by its pseudonymised form, all other columns as they are. Who knows the key can undo it."""
    return _with_key(docs, key).withColumn("text", pseudonymize(F.col("text"), F.col("__key"))).drop("__key")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """The key is the session's ``spark.defectflow.pii.secret`` (a name that Spark's pages redact), or a new one for each call."""
    key = spark.conf.get("spark.defectflow.pii.secret", None) or secrets.token_hex(32)
    docs = _with_key(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key)
    new = docs.select("doc_id", F.col("text").alias("old"), pseudonymize(F.col("text"), F.col("__key")).alias("text"))
    return new.select("doc_id", "text", (~F.col("text").eqNullSafe(F.col("old"))).alias("changed"))
