"""From diff texts to numbered changed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectflow.text import _trim

COMMIT = ["project", "commit_hash"]
FILE = [*COMMIT, "file_path"]


def split_diff(diffs: DataFrame, strict: bool = False, suffix: str = ".java") -> DataFrame:
    """``project, commit_hash, file_path, file_ord, block``: the text is cut at ``diff --git`` (``strict``: at line starts only).

    Of a text's blocks with the same path the last stays: they are sorted by path within the row, so nothing is shuffled. ``diffs``: a row for each commit."""
    blocks = F.split(_trim(F.coalesce("diff_text", F.lit(""))), "(?m)^diff --git" if strict else "diff --git")
    path = lambda b: F.regexp_extract(F.substring_index(b, "\n", 1), r"(?d)^a/(.*?) b/(.*?)$", 2)
    trimmed = F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))), _trim)
    parts = F.transform(trimmed, lambda b, i: F.struct(path(b).alias("file_path"), i.alias("file_ord"), b.alias("block")))
    listed = F.sort_array(F.filter(parts, lambda x: x["file_path"].endswith(suffix)))
    last = F.flatten(F.transform(F.array(listed), lambda all_: F.filter(all_, lambda x, i: ~F.coalesce(F.get(all_, i + 1)["file_path"] == x["file_path"], F.lit(False)))))
    return diffs.select(*COMMIT, F.inline(last)).select(*FILE, "file_ord", "block")


#: Before a hunk header that gives both line numbers.
HUNK = r"(?dm)^(?=@@[^\n]*-\d)(?=@@[^\n]*\+\d)"


def changed_lines(blocks: DataFrame, strict: bool = False) -> DataFrame:
    """``project, commit_hash, file_path, change_type, line_no, code`` with the old or new file's line number; ``code`` keeps its marker.

    Lines starting with ``+++`` or ``---`` are taken for headers and not counted; ``strict`` does so only before the first hunk. All happens within a block's row: it is cut before its hunk headers, and of a
    hunk's lines those of one side are filtered, so that a line's place among them is its number; nothing is shuffled or sorted."""

    def hunk_lines(hunk: Column, place: Column) -> Column:
        head = F.substring_index(hunk, "\n", 1)
        valid = head.rlike(HUNK)
        first = lambda sign: F.when(valid, F.regexp_extract(head, rf"{sign}(\d+),?", 1).try_cast("int")).otherwise(1)
        about = F.struct(F.split(hunk, "\n").alias("lines"), first(r"\+").alias("new"), first("-").alias("old"), ((place == 0) & ~valid).alias("before"))

        def side(h: Column, sign: str, start: str, kind: str) -> Column:
            header = lambda x: x.startswith(sign * 3) & (h["before"] if strict else F.lit(True))
            mine = F.filter(h["lines"], lambda x: x.startswith(" ") | (x.startswith(sign) & ~header(x)))
            numbered = F.transform(mine, lambda x, i: F.struct(F.lit(kind).alias("change_type"), (h[start] + i).alias("line_no"), x.alias("code")))
            return F.filter(numbered, lambda x: x["code"].startswith(sign))

        # In an array of one, so that the struct is computed once for all lines.
        return F.flatten(F.transform(F.array(about), lambda h: F.concat(side(h, "+", "new", "added"), side(h, "-", "old", "deleted"))))

    found = F.flatten(F.transform(F.split("block", HUNK), hunk_lines))
    return blocks.select(*FILE, F.inline(found)).select(*FILE, "change_type", "line_no", "code")


def changed_line_arrays(lines: DataFrame) -> DataFrame:
    """Per file ``add_lines, add_codes, remove_lines, remove_codes``, by line number."""
    one = lambda kind: F.sort_array(F.collect_list(F.when(F.col("change_type") == kind, F.struct("line_no", "code"))))
    out = lines.groupBy(*FILE).agg(one("added").alias("a"), one("deleted").alias("r"))
    return out.select(*FILE, F.col("a.line_no").alias("add_lines"), F.col("a.code").alias("add_codes"), F.col("r.line_no").alias("remove_lines"), F.col("r.code").alias("remove_codes"))


def drop_noise_lines(lines: DataFrame) -> DataFrame:
    """``code`` without marker, trimmed; empty lines and comment lines go."""
    bare = lines.withColumn("code", _trim(F.substring("code", 2, 1 << 30)))
    return bare.where((F.col("code") != "") & ~F.col("code").rlike(r"^(//|/\*|\*)"))


def files_without_additions(files: DataFrame) -> DataFrame:
    """The empty records of ``files`` without an added line: no path, no graph, no nodes, label 0, codes kept."""
    none = F.array().cast("array<int>")
    empty = files.where(F.size("add_lines") == 0).withColumn("file_path", F.lit(""))
    return empty.withColumns({"diff_node": none, "buggy_nodes": none, "label": F.lit(0)})


def commits_with_added_code(lines: DataFrame) -> DataFrame:
    """Files with an added line."""
    return lines.where("change_type = 'added'").select(*FILE).distinct()
