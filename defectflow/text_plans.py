"""Registered queries on diffs, labels and code text, and their SQL. Lines of ``documents`` stand in for code; some words become comment marks and quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defectflow import diffs, labels, text
from defectflow.records import without_noise

#: Words that become marks, so that the texts hold comments, quotes and numbers.
MARKS = {" de ": " // ", " la ": " /* ", " et ": " */ ", " the ": ' "', " and ": "' ", " of ": "; ", " que ": "\r", " un ": " 17 ", ". ": ";\n"}


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _code(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, code``"""
    code = F.col("text")
    for word, mark in MARKS.items():
        code = F.replace(code, F.lit(word), F.lit(mark))
    return _documents(spark, d).select("doc_id", code.alias("code"))


def _quoted(s: str) -> str:
    return " || ".join(f"chr({ord(c)})" if c in "\r\n'" else f"'{c}'" for c in s)


_CODE = "text"
for _word, _mark in MARKS.items():
    _CODE = f"replace({_CODE}, {_quoted(_word)}, {_quoted(_mark)})"
_CODE = f"code AS (SELECT doc_id, {_CODE} AS code FROM documents)"

_NORMAL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(translate({0}, '(){{}}[].:;,', '          '), ' _ ', '_'),
 '``.*``', '<STR>', 'g'), '''.*''', '<STR>', 'g'), '".*"', '<STR>', 'g'), '\d+', '<NUM>', 'g'), '\s+', ' ', 'g'))"""
_COMMENTS = r"replace(replace(regexp_replace(regexp_replace({0}, '/\*.*?\*/', '', 'gs'), '//.*', '', 'g'), chr(13), ''), chr(10), '\n')"


def _column_query(name: str, function, sql: str):
    def run(spark, d):
        return _code(spark, d).select("doc_id", function(F.col("code")).alias("value"))

    run.__name__ = name
    return run, f"WITH {_CODE} SELECT doc_id, {sql} AS value FROM code"


def x5_blank_comment_lines(spark, d):
    lines = F.transform(F.split("code", "\n"), lambda x: F.concat(x, F.lit("\n")))
    return _code(spark, d).select("doc_id", F.array_join(text.blank_comment_lines(lines), "").alias("value"))


def x6_inside_quotes(spark, d):
    lines = _code(spark, d).select("doc_id", F.posexplode(F.split("code", "\n")).alias("line_no", "line"))
    places = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(40), F.lit(90), F.lit(200), F.lit(100_000))).alias("pos")
    return lines.select("doc_id", "line_no", "line", places).select("doc_id", "line_no", "pos", text.inside_quotes(F.col("line"), F.col("pos")).alias("inside"))


def x10_strip_added_marker(spark, d):
    lines = F.transform(F.split("code", "\n"), lambda x, i: F.concat(F.when(i % 2 == 0, "+").otherwise(""), x, F.lit("\n")))
    return _code(spark, d).select("doc_id", text.strip_added_marker(lines).alias("value"))


_X5 = r"""
l AS (SELECT doc_id, unnest(string_split(code, chr(10))) || chr(10) AS line, generate_subscripts(string_split(code, chr(10)), 1) AS i FROM code),
p AS (SELECT *, regexp_replace(line, '^[ \t\r\n\f\x0b]+', '') AS bare, strpos(line, ';') AS sc, strpos(line, '/*') AS pt FROM l),
q AS (SELECT *, sc > 0 AND pt > sc AND NOT regexp_matches(regexp_replace(line[1:pt - 1], '''[^'']*''|"[^"]*"', '', 'g'), '[''"]') AS cut FROM p),
s(doc_id, i, line, open_after) AS (
  SELECT doc_id, 0::BIGINT, '', false FROM code
  UNION ALL
  SELECT q.doc_id, q.i, CASE WHEN s.open_after OR bare LIKE '//%' OR bare LIKE '/*%' THEN chr(10) WHEN cut THEN q.line[1:pt - 1] || chr(10) ELSE q.line END,
    CASE WHEN s.open_after THEN NOT contains(q.line, '*/') WHEN bare LIKE '//%' THEN false WHEN bare LIKE '/*%' THEN NOT contains(q.line, '*/') WHEN cut THEN NOT rtrim(replace(q.line, chr(10), ''), ' ') LIKE '%*/' ELSE false END
  FROM s JOIN q ON q.doc_id = s.doc_id AND q.i = s.i + 1)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Changed lines of the documents' diffs; those of every fifth document are removals only."""
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i % 3 == 0, " ").when((i % 3 == 1) & (F.col("doc_id") % 5 > 0), "+").otherwise("-"), x))
    name = F.concat(F.lit("f"), F.col("doc_id"), F.lit(".java"))
    head = F.concat(F.lit("diff --git a/old.java b/"), name, F.lit("\n--- a\n+++ b\n@@ -1 +1 @@\n+wrong\ndiff --git a/n.md b/n.md\n@@ -1 +1 @@\n+no\ndiff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- a\n+++ b\n@@ -10,3 +20,4 @@\n"))
    frame = _documents(spark, d).select(F.col("source").alias("project"), F.col("doc_id").alias("commit_hash"), F.concat(head, F.array_join(marked, "\n")).alias("diff_text"))
    return diffs.changed_lines(diffs.split_diff(frame))


_LINES = r"""
x AS (SELECT source AS project, doc_id AS commit_hash, 'f' || doc_id || '.java' AS file_path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
m AS (SELECT *, CASE WHEN pos % 3 = 0 THEN ' ' WHEN pos % 3 = 1 AND commit_hash % 5 > 0 THEN '+' ELSE '-' END || line AS code FROM x),
k AS (SELECT *, (starts_with(code, '+') AND NOT starts_with(code, '+++'))::INT AS plus, (starts_with(code, '-') AND NOT starts_with(code, '---'))::INT AS minus, starts_with(code, ' ')::INT AS blank FROM m),
c AS (SELECT *, 19 + sum(plus + blank) OVER w AS new_no, 9 + sum(minus + blank) OVER w AS old_no FROM k WINDOW w AS (PARTITION BY project, commit_hash ORDER BY pos ROWS UNBOUNDED PRECEDING)),
ch0 AS (SELECT project, commit_hash, file_path, plus, (CASE WHEN plus = 1 THEN new_no ELSE old_no END)::INT AS line_no, regexp_replace(code, '\s+$', '') AS code, pos FROM c WHERE plus + minus > 0),
ch AS (SELECT project, commit_hash, file_path, plus, line_no, CASE WHEN pos = last_pos THEN code ELSE raw END AS code FROM (
  SELECT ch0.*, m.code AS raw, max(m.pos) OVER (PARTITION BY m.commit_hash) AS last_pos FROM ch0 JOIN m USING (commit_hash, pos)))"""
_LINES = _LINES.replace(
    "SELECT ch0.*, m.code AS raw, max(m.pos) OVER (PARTITION BY m.commit_hash) AS last_pos FROM ch0 JOIN m USING (commit_hash, pos)",
    "SELECT ch0.*, m.code AS raw, t.last_pos FROM ch0 JOIN m USING (commit_hash, pos) JOIN (SELECT commit_hash, max(pos) AS last_pos FROM m GROUP BY 1) t USING (commit_hash)",
)


def _texts(files: DataFrame) -> DataFrame:
    """Arrays as texts, which compare alike everywhere."""
    return files.withColumns({c: F.array_join(F.col(c).cast("array<string>"), "\n") for c, t in files.dtypes if t.startswith("array")})


def d3_line_arrays(spark, d):
    return _texts(diffs.changed_line_arrays(_lines(spark, d))).drop("project")


def d4_noise_lines(spark, d):
    return diffs.drop_noise_lines(_lines(spark, d)).select("commit_hash", "change_type", "line_no", "code")


def d5_empty_records(spark, d):
    files = diffs.changed_line_arrays(_lines(spark, d)).withColumn("remove_codes", without_noise(F.col("remove_codes")))
    empty = diffs.files_without_additions(files)
    return _texts(empty).select("project", "commit_hash", "file_path", "add_codes", "remove_codes", "diff_node", "buggy_nodes", "label")


def d6_files_with_added_code(spark, d):
    return diffs.commits_with_added_code(_lines(spark, d))


def _snippets(spark: SparkSession, d: str) -> DataFrame:
    lines = _documents(spark, d).select(F.col("source").alias("project"), F.col("doc_id").alias("commit_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    snippet = F.when(F.col("pos") % 8 == 4, F.lit(" } else {")).when(F.col("pos") % 8 == 0, F.col("line"))
    return lines.where("pos % 4 = 0").select("project", "commit_hash", F.concat(F.lit("f"), F.col("commit_hash"), F.lit(".java")).alias("file_path"), snippet.alias("snippet"))


_SNIPPETS = r"""
sn AS (SELECT DISTINCT project, commit_hash, file_path, s AS snippet FROM (SELECT project, commit_hash, file_path, CASE WHEN pos % 8 = 4 THEN '} else {' ELSE regexp_replace(line, '^\s+|\s+$', '', 'g') END AS s FROM x WHERE pos % 4 = 0)
  WHERE length(s) > 1 AND NOT regexp_full_match(s, '\}\s*(?:else|catch|finally)\s*\{')),
co AS (SELECT source AS project, doc_id AS commit_hash, CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS is_buggy_commit FROM documents),
hit AS (SELECT ch.* FROM ch WHERE plus = 1 AND (project, commit_hash, regexp_replace(substr(code, 2), '^\s+|\s+$', '', 'g')) IN (SELECT project, commit_hash, snippet FROM sn))"""


def _commits(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select(F.col("source").alias("project"), F.col("doc_id").alias("commit_hash"), F.when(F.col("doc_id") % 3 == 0, 1.0).otherwise(0.0).alias("is_buggy_commit"))


def b1_usable_snippets(spark, d):
    return labels.usable_snippets(_snippets(spark, d))


def _index(spark: SparkSession, d: str) -> DataFrame:
    return labels.buggy_line_index(_commits(spark, d), _lines(spark, d), _snippets(spark, d))


def b3_line_index(spark, d):
    files = F.transform(F.map_entries("files"), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"].cast("array<string>"), ",")))
    return _index(spark, d).select("project", "commit_hash", F.array_join(F.array_sort(files), ";").alias("files"))


def b4_file_labels(spark, d):
    files = _lines(spark, d).select("project", "commit_hash", "file_path").distinct()
    return labels.file_labels(files, _index(spark, d))


def b5_clean_commits(spark, d):
    return labels.filter_commits(_commits(spark, d), buggy=False).select("commit_hash", "is_buggy_commit")


def b6_attach_truth(spark, d):
    known = _commits(spark, d).where("commit_hash % 7 > 0")
    preds, unmatched = labels.attach_truth(_documents(spark, d).select(F.col("doc_id").alias("commit_hash")), known)
    return preds.select("commit_hash", F.col("real_label").cast("long").alias("real_label")).unionByName(unmatched.select(F.lit(-1).cast("long").alias("commit_hash"), F.col("unmatched").alias("real_label")))


_COLUMNS = [
    _column_query("x1_normalize_code", text.normalize_code, _NORMAL.format("code")),
    _column_query("x2_squeeze_whitespace", text.squeeze_whitespace, r"regexp_replace(regexp_replace(code, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"),
    _column_query("x4_strip_comments", text.strip_comments, _COMMENTS.format("code")),
]

QUERIES = {f.__name__: f for f, _ in _COLUMNS} | {
    f.__name__: f
    for f in (
        x5_blank_comment_lines, x6_inside_quotes, x10_strip_added_marker, d3_line_arrays, d4_noise_lines, d5_empty_records, d6_files_with_added_code, b1_usable_snippets, b3_line_index, b4_file_labels,
        b5_clean_commits, b6_attach_truth,
    )
}

_W = f"WITH {_LINES}"
_FILES = """(SELECT project, commit_hash, file_path, coalesce(string_agg(line_no::VARCHAR, chr(10) ORDER BY line_no, code) FILTER (plus = 1), '') AS add_lines, coalesce(string_agg(code, chr(10) ORDER BY line_no, code) FILTER (plus = 1), '') AS add_codes,
  coalesce(string_agg(line_no::VARCHAR, chr(10) ORDER BY line_no, code) FILTER (plus = 0), '') AS remove_lines, coalesce(string_agg(code, chr(10) ORDER BY line_no, code) FILTER (plus = 0), '') AS remove_codes, count(*) FILTER (plus = 1) AS n_added FROM ch GROUP BY ALL)"""
_BARE = r"regexp_replace(substr(code, 2), '^\s+|\s+$', '', 'g')"

ORACLE_SQL = {f.__name__: sql for f, sql in _COLUMNS} | {
    "x5_blank_comment_lines": f"WITH RECURSIVE {_CODE},{_X5} SELECT doc_id, string_agg(line, '' ORDER BY i) AS value FROM s GROUP BY doc_id",
    "x6_inside_quotes": f"""WITH {_CODE}, n AS (SELECT doc_id, unnest(string_split(code, chr(10))) AS line, (generate_subscripts(string_split(code, chr(10)), 1) - 1)::INT AS line_no FROM code), l AS (SELECT *, unnest([-1, 0, 40, 90, 200, 100000]) AS pos FROM n)
SELECT doc_id, line_no, pos::INT AS pos, pos >= 0 AND pos < length(line) AND regexp_matches(regexp_replace(line[1:pos], '''[^'']*''|"[^"]*"', '', 'g'), '[''"]') AS inside FROM l""",
    "x10_strip_added_marker": f"""WITH {_CODE}, l AS (SELECT doc_id, unnest(string_split(code, chr(10))) AS line, generate_subscripts(string_split(code, chr(10)), 1) AS i FROM code),
j AS (SELECT doc_id, string_agg(CASE WHEN i % 2 = 0 AND starts_with(line, '+') THEN substr(line, 2) ELSE line END || chr(10), '' ORDER BY i) AS t FROM l GROUP BY doc_id) SELECT doc_id, {_NORMAL.format("t")} AS value FROM j""",
    "d3_line_arrays": f"{_W} SELECT commit_hash, file_path, add_lines, add_codes, remove_lines, remove_codes FROM {_FILES}",
    "d4_noise_lines": f"{_W} SELECT commit_hash, CASE WHEN plus = 1 THEN 'added' ELSE 'deleted' END AS change_type, line_no, {_BARE} AS code FROM ch WHERE {_BARE} <> '' AND NOT regexp_matches({_BARE}, '^(//|/\\*|\\*)')",
    "d5_empty_records": f"""{_W} SELECT project, commit_hash, '' AS file_path, '' AS add_codes, coalesce(string_agg({_BARE}, chr(10) ORDER BY line_no, code) FILTER ({_BARE} <> '' AND NOT regexp_matches({_BARE}, '^(//|/\\*|\\*)')), '') AS remove_codes,
'' AS diff_node, '' AS buggy_nodes, 0 AS label FROM ch GROUP BY project, commit_hash, ch.file_path HAVING sum(plus) = 0""",
    "d6_files_with_added_code": f"{_W} SELECT DISTINCT project, commit_hash, file_path FROM ch WHERE plus = 1",
    "b1_usable_snippets": f"{_W},{_SNIPPETS} SELECT * FROM sn",
    "b3_line_index": f"""{_W},{_SNIPPETS}, f AS (SELECT project, commit_hash, file_path || ':' || string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS f FROM hit GROUP BY project, commit_hash, file_path)
SELECT project, commit_hash, coalesce(string_agg(f, ';' ORDER BY f), '') AS files FROM co LEFT JOIN f USING (project, commit_hash) WHERE is_buggy_commit = 1.0 GROUP BY ALL""",
    "b4_file_labels": f"""{_W},{_SNIPPETS} SELECT DISTINCT project, commit_hash, file_path, (commit_hash IN (SELECT commit_hash FROM hit JOIN co USING (project, commit_hash) WHERE is_buggy_commit = 1.0))::INT AS label FROM ch""",
    "b5_clean_commits": "SELECT doc_id AS commit_hash, 0.0::DOUBLE AS is_buggy_commit FROM documents WHERE doc_id % 3 <> 0",
    "b6_attach_truth": "SELECT doc_id AS commit_hash, (doc_id % 3 = 0)::BIGINT AS real_label FROM documents WHERE doc_id % 7 > 0 UNION ALL SELECT -1, count(*) FROM documents WHERE doc_id % 7 = 0",
}
