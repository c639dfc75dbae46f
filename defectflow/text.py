"""Text functions, column to column. Regular expressions are Unicode-aware and know only the line feed as a line's end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_code(c: Column) -> Column:
    """Punctuation to blanks, literals to ``<STR>`` and ``<NUM>``, white space squeezed."""
    c = F.translate(c, "(){}[].:;,", " " * 10)
    c = F.replace(c, F.lit(" _ "), F.lit("_"))
    for quoted in ("``.*``", "'.*'", '".*"'):
        c = F.regexp_replace(c, f"(?Ud){quoted}", "<STR>")
    return _trim(F.regexp_replace(F.regexp_replace(c, r"(?U)\d+", "<NUM>"), r"(?U)\s+", " "))


def squeeze_whitespace(c: Column) -> Column:
    return F.regexp_replace(_trim(c), r"(?U)\s+", " ")


def redact_tokens(c: Column) -> Column:
    """Runs of 20 or more letters and digits become ``[REDACTED]``."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "[A-Za-z0-9]{20,}", "[REDACTED]")


def strip_comments(c: Column) -> Column:
    """Without block and line comments (``//www`` stays); a line feed becomes a backslash and an n."""
    c = F.regexp_replace(c, r"(?s)/\*.*?\*/", "")
    c = F.regexp_replace(c, r"(?d)//(?!www).*", "")
    return F.replace(F.replace(c, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\\n"))


def inside_quotes(line: Column, pos: Column) -> Column:
    """Whether the character at ``pos`` (from 0) is in quotes: each kind toggles outside the other, there are no escapes."""
    start = F.struct(F.lit(False).alias("s"), F.lit(False).alias("d"))

    def step(q: Column, ch: Column) -> Column:
        return F.struct(F.when((ch == "'") & ~q["d"], ~q["s"]).otherwise(q["s"]).alias("s"), F.when((ch == '"') & ~q["s"], ~q["d"]).otherwise(q["d"]).alias("d"))

    state = F.aggregate(F.split(F.substring(line, F.lit(1), pos.cast("int")), ""), start, step, lambda q: q["s"] | q["d"])
    return F.when((pos < 0) | (pos >= F.length(line)), F.lit(False)).otherwise(state)


def blank_comment_lines(lines: Column) -> Column:
    """An array of lines (each with its line feed) with comment lines blanked, in order.

    A fold notes for each line, as one character, whether a block comment is open before it; the lines are then rewritten each by itself."""

    def about(line: Column) -> tuple[Column, Column, Column]:
        """Without leading blanks; where a block comment begins behind the code (from 1); whether the line is cut there."""
        bare = F.regexp_replace(line, r"^[ \t\r\n\f\x0b]+", "")
        semi = F.locate(";", line)
        at = F.when(semi > 0, F.locate("/*", line, 1)).otherwise(F.lit(0))
        return bare, at, (semi > 0) & (at > semi) & ~inside_quotes(line, at - 1)

    def step(s: Column, line: Column) -> Column:
        bare, _, cut = about(line)
        ends = F.rtrim(F.replace(line, F.lit("\n"), F.lit(""))).endswith("*/")
        still = (
            F.when(s["open"], ~line.contains("*/")).when(bare.startswith("//"), F.lit(False)).when(bare.startswith("/*"), ~line.contains("*/")).when(cut, ~ends).otherwise(F.lit(False))
        )
        return F.struct(still.alias("open"), F.concat(s["seen"], F.when(s["open"], "1").otherwise("0")).alias("seen"))

    def rewritten(seen: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            bare, at, cut = about(line)
            blank = (F.substring(seen, i + 1, F.lit(1)) == "1") | bare.startswith("//") | bare.startswith("/*")
            return F.when(blank, F.lit("\n")).when(cut, F.concat(F.substring(line, F.lit(1), (at - 1).cast("int")), F.lit("\n"))).otherwise(line)

        return F.transform(lines, one)

    start = F.struct(F.lit(False).alias("open"), F.lit("").alias("seen"))
    return F.flatten(F.transform(F.array(F.aggregate(lines, start, step, lambda s: s["seen"])), rewritten))


def ascii_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def match_key(c: Column) -> Column:
    """Without one leading ``+`` or ``-``, blanks and tabs."""
    return F.translate(F.regexp_replace(c, r"^[+-]", ""), " \t", "")


def flatten_newlines(c: Column) -> Column:
    return F.translate(c, "\n\r", "")


def strip_added_marker(lines: Column) -> Column:
    """A node's source lines without one leading ``+`` each, joined and normalised: the text to embed."""
    return normalize_code(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"^\+", "")), ""))
