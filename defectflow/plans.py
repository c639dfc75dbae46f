"""Registered queries on the star-schema tables, and their SQL.

Orders stand in for commits (project: priority, label: status F), line items for changed lines, text lines of ``documents`` for code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defectflow import commit_metrics as cm
from defectflow import diffs, graph_plans, labels, model_plans, record_plans, text, text_plans
from defectflow import line_metrics as lm
from defectflow.stand_ins import _LINES, _PREDS, _lines, _preds, _table


def _curve_sql(name: str, value: str, direction: str) -> str:
    return f"""
{name} AS (SELECT *, sum(loc) OVER (PARTITION BY project ORDER BY density {direction} NULLS LAST, commit_hash ROWS UNBOUNDED PRECEDING) AS cum_loc,
                  sum(real_label) OVER (PARTITION BY project ORDER BY density {direction} NULLS LAST, commit_hash ROWS UNBOUNDED PRECEDING) AS found,
                  sum(loc) OVER (PARTITION BY project) AS total_loc, sum(real_label) OVER (PARTITION BY project) AS n_buggy
           FROM (SELECT *, CASE WHEN loc > 0 THEN {value} / loc WHEN {value} > 0 THEN 'inf'::DOUBLE END AS density FROM p))"""


def _area_sql(curve: str) -> str:
    r = [f"sum(CASE WHEN real_label = 1 AND cum_loc <= {p / 100.0} * total_loc THEN 1 ELSE 0 END) / max(n_buggy)::DOUBLE" for p in cm.PERCENTS]
    return f"SELECT project, {' + '.join(f'({a} + {b}) * 0.05' for a, b in zip(r, r[1:], strict=False))} AS area FROM {curve} GROUP BY project"


_CURVES = ",".join([_PREDS, _curve_sql("pred", "prob", "DESC"), _curve_sql("opt", "real_label::DOUBLE", "DESC"), _curve_sql("worst", "real_label::DOUBLE", "ASC")])
_CONFUSION = """SELECT project, sum(((real_label = 0) AND NOT prob > 0.5)::INT) AS tn, sum(((real_label = 0) AND prob > 0.5)::INT) AS fp,
  sum(((real_label = 1) AND NOT prob > 0.5)::INT) AS fn, sum(((real_label = 1) AND prob > 0.5)::INT) AS tp FROM p GROUP BY project"""
_AUC = """SELECT project, sum(pos * (through - neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM (
  SELECT *, sum(neg) OVER (PARTITION BY project ORDER BY prob) AS through FROM (
    SELECT project, prob, sum(real_label)::DOUBLE AS pos, sum(1 - real_label)::DOUBLE AS neg FROM p GROUP BY 1, 2)) GROUP BY project"""
_RECALL = "SELECT project, sum(CASE WHEN real_label = 1 AND cum_loc <= 0.2 * total_loc THEN 1 ELSE 0 END) / max(n_buggy)::DOUBLE AS recall_at_effort FROM pred GROUP BY project"
_EFFORT = "SELECT project, max(CASE WHEN real_label = 1 AND found = ceil(0.2 * n_buggy) THEN floor(cum_loc) END) / max(total_loc) AS effort_at_recall FROM pred GROUP BY project"
_POPT = f"""SELECT project, 1 - (o.area - a.area) / (o.area - w.area) AS p_opt FROM ({_area_sql("pred")}) a JOIN ({_area_sql("opt")}) o USING (project) JOIN ({_area_sql("worst")}) w USING (project)"""


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def m2_confusion(spark, d):
    return _round(cm.confusion(cm.threshold(_preds(spark, d)), ["project"]), "precision", "recall", "f1", "far", "d2h")


def m3_roc_auc(spark, d):
    return _round(cm.roc_auc(_preds(spark, d), ["project"]), "auc")


def m3_roc_auc_all(spark, d):
    return _round(cm.roc_auc(_preds(spark, d)), "auc")


def m5_effort_curve(spark, d):
    return cm.effort_curve(_preds(spark, d)).select("commit_hash", "cum_loc")


def m6_recall_at_effort(spark, d):
    return _round(cm.recall_at_effort(cm.effort_curve(_preds(spark, d), group_cols=["project"]), 20, ["project"]), "recall_at_effort")


def m7_effort_at_recall(spark, d):
    return _round(cm.effort_at_recall(cm.effort_curve(_preds(spark, d), group_cols=["project"]), 20, ["project"]), "effort_at_recall")


def m8_p_opt(spark, d):
    return _round(cm.p_opt(_preds(spark, d), ["project"]), "p_opt")


def m9_commit_report(spark, d):
    return _round(cm.commit_report(_preds(spark, d), ["project"]), "f1", "auc", "recall_at_effort", "effort_at_recall", "p_opt")


def l4_minmax_scale(spark, d):
    return _round(lm.minmax_scale(_lines(spark, d)), "scaled").select("commit_id", "idx", "scaled")


def l5_ifa(spark, d):
    return lm.ifa(lm.rank_lines(_lines(spark, d)))


def l6_top5_accuracy(spark, d):
    return _round(lm.top_k_accuracy(lm.rank_lines(_lines(spark, d)), 5), "accuracy")


def l7_recall_at_loc(spark, d):
    return _round(lm.recall_at_loc(lm.rank_lines(_lines(spark, d))), "recall")


def l8_line_effort(spark, d):
    return _round(lm.line_effort_at_recall(lm.rank_lines(_lines(spark, d))), "effort")


def _text_query(function, name):
    def run(spark, d):
        return _table(spark, d, "documents").select("doc_id", function(F.col("text")).alias("value"))

    run.__name__ = name
    return run


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    """A diff text for each document: its lines as context, added and removed in turn."""
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i % 3 == 0, " ").when(i % 3 == 1, "+").otherwise("-"), x))
    head = F.concat(F.lit("diff --git a/f"), F.col("doc_id"), F.lit(".java b/f"), F.col("doc_id"), F.lit(".java\n--- a\n+++ b\n@@ -10,3 +20,4 @@\n"))
    return _table(spark, d, "documents").select(F.col("source").alias("project"), F.col("doc_id").alias("commit_hash"), F.concat(head, F.array_join(marked, "\n")).alias("diff_text"))


_CHANGED = r"""
x AS (SELECT source AS project, doc_id AS commit_hash, 'f' || doc_id || '.java' AS file_path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
m AS (SELECT *, CASE pos % 3 WHEN 0 THEN ' ' WHEN 1 THEN '+' ELSE '-' END || line AS code FROM x),
k AS (SELECT *, (starts_with(code, '+') AND NOT starts_with(code, '+++'))::INT AS plus, (starts_with(code, '-') AND NOT starts_with(code, '---'))::INT AS minus, starts_with(code, ' ')::INT AS blank FROM m),
c AS (SELECT *, 19 + sum(plus + blank) OVER w AS new_no, 9 + sum(minus + blank) OVER w AS old_no FROM k WINDOW w AS (PARTITION BY project, commit_hash ORDER BY pos ROWS UNBOUNDED PRECEDING)),
ch AS (SELECT project, commit_hash, file_path, CASE WHEN plus = 1 THEN 'added' ELSE 'deleted' END AS change_type, CASE WHEN plus = 1 THEN new_no ELSE old_no END AS line_no, code FROM c WHERE plus + minus > 0)"""


def d2_changed_lines(spark, d):
    return diffs.changed_lines(diffs.split_diff(_diffs(spark, d))).withColumn("code", F.rtrim("code"))


def _snippets(spark: SparkSession, d: str) -> DataFrame:
    lines = _table(spark, d, "documents").select(F.col("source").alias("project"), F.col("doc_id").alias("commit_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "snippet"))
    return lines.where("pos % 4 = 0").withColumn("file_path", F.concat(F.lit("f"), F.col("commit_hash"), F.lit(".java"))).drop("pos")


def b2_buggy_lines(spark, d):
    added = diffs.changed_lines(diffs.split_diff(_diffs(spark, d)))
    return labels.buggy_lines(added, _snippets(spark, d)).select("project", "commit_hash", "file_path", "line_no")


_B2 = f"""WITH {_CHANGED} SELECT project, commit_hash, file_path, line_no FROM ch WHERE change_type = 'added' AND (project, commit_hash, regexp_replace(substr(code, 2), '^\\s+|\\s+$', '', 'g')) IN (
  SELECT project, commit_hash, s FROM (SELECT project, commit_hash, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM x WHERE pos % 4 = 0)
  WHERE length(s) > 1 AND NOT regexp_full_match(s, '\\}}\\s*(?:else|catch|finally)\\s*\\{{'))"""

QUERIES = {
    f.__name__: f
    for f in (
        m2_confusion, m3_roc_auc, m3_roc_auc_all, m5_effort_curve, m6_recall_at_effort, m7_effort_at_recall, m8_p_opt, m9_commit_report,
        l4_minmax_scale, l5_ifa, l6_top5_accuracy, l7_recall_at_loc, l8_line_effort, d2_changed_lines, b2_buggy_lines,
        _text_query(text.redact_tokens, "x3_redact_tokens"), _text_query(text.ascii_only, "x7_ascii_only"),
        _text_query(text.match_key, "x8_match_key"), _text_query(text.flatten_newlines, "x9_flatten_newlines"),
    )
}

ORACLE_SQL = {
    "m2_confusion": f"""WITH {_PREDS}, c AS ({_CONFUSION}),
q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS re,
  CASE WHEN fp + tn > 0 THEN fp / (fp + tn)::DOUBLE ELSE 0 END AS fa, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f FROM c)
SELECT project, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp, round(pr, 6) AS "precision", round(re, 6) AS recall, round(f, 6) AS f1, round(fa, 6) AS far, round(sqrt(((1 - re) * (1 - re) + fa * fa) / 2), 6) AS d2h FROM q""",
    "m3_roc_auc": f"WITH {_PREDS} SELECT project, round(auc, 6) AS auc FROM ({_AUC})",
    "m3_roc_auc_all": f"WITH {_PREDS.replace('o_orderpriority AS project', '1 AS project')} SELECT round(auc, 6) AS auc FROM ({_AUC})",
    "m5_effort_curve": "WITH " + _PREDS.replace("o_orderpriority AS project", "1 AS project") + "," + _curve_sql("pred", "prob", "DESC") + " SELECT commit_hash, cum_loc FROM pred",
    "m6_recall_at_effort": f"WITH {_CURVES} SELECT project, round(recall_at_effort, 6) AS recall_at_effort FROM ({_RECALL})",
    "m7_effort_at_recall": f"WITH {_CURVES} SELECT project, round(effort_at_recall, 6) AS effort_at_recall FROM ({_EFFORT})",
    "m8_p_opt": f"WITH {_CURVES} SELECT project, round(p_opt, 6) AS p_opt FROM ({_POPT})",
    "m9_commit_report": f"""WITH {_CURVES} SELECT project, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, round(auc, 6) AS auc, round(recall_at_effort, 6) AS recall_at_effort,
round(effort_at_recall, 6) AS effort_at_recall, round(p_opt, 6) AS p_opt FROM ({_CONFUSION}) JOIN ({_AUC}) USING (project) JOIN ({_RECALL}) USING (project) JOIN ({_EFFORT}) USING (project) JOIN ({_POPT}) USING (project)""",
    "l4_minmax_scale": f"""WITH {_LINES} SELECT commit_id, idx, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END, 6) AS scaled
FROM (SELECT *, min(score) OVER (PARTITION BY commit_id) AS lo, max(score) OVER (PARTITION BY commit_id) AS hi FROM l)""",
    "l5_ifa": f"WITH {_LINES} SELECT commit_id, coalesce(min(CASE WHEN label = 1 THEN rank END) - 1, max(n)) AS ifa FROM r GROUP BY 1",
    "l6_top5_accuracy": f"WITH {_LINES} SELECT commit_id, round(sum(CASE WHEN label = 1 AND rank <= 5 THEN 1 ELSE 0 END) / least(5, max(n))::DOUBLE, 6) AS accuracy FROM r GROUP BY 1",
    "l7_recall_at_loc": f"WITH {_LINES} SELECT commit_id, round(CASE WHEN max(n_buggy) = 0 THEN 0 ELSE sum(CASE WHEN label = 1 AND rank <= floor(0.2 * n) THEN 1 ELSE 0 END) / max(n_buggy)::DOUBLE END, 6) AS recall FROM r GROUP BY 1",
    "l8_line_effort": f"""WITH {_LINES} SELECT commit_id, round(CASE WHEN max(n_buggy) > 0 THEN min(CASE WHEN label = 1 AND buggy_rank = ceil(0.2 * n_buggy) THEN rank END) / max(n)::DOUBLE
ELSE ceil(0.2 * max(n)) END, 6) AS effort FROM r GROUP BY 1""",
    "d2_changed_lines": f"WITH {_CHANGED} SELECT project, commit_hash, file_path, change_type, line_no::INT AS line_no, rtrim(code) AS code FROM ch",
    "b2_buggy_lines": _B2.replace("line_no FROM ch", "line_no::INT AS line_no FROM ch"),
    "x3_redact_tokens": r"SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[A-Za-z0-9]{20,}', '[REDACTED]', 'g') AS value FROM documents",
    "x7_ascii_only": r"SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS value FROM documents",
    "x8_match_key": "SELECT doc_id, replace(replace(regexp_replace(text, '^[+-]', ''), ' ', ''), chr(9), '') AS value FROM documents",
    "x9_flatten_newlines": "SELECT doc_id, replace(replace(text, chr(10), ''), chr(13), '') AS value FROM documents",
}

for _module in (graph_plans, text_plans, record_plans, model_plans):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
