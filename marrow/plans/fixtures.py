"""Input views that queries derive from the given tables.

Every view is one statement that Spark and DuckDB read alike; {name} stands for a table
or another view.  ``frame`` gives a view as a DataFrame, ``with_views`` puts the views
that a statement names in front of it for DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "embeddings", "labels")

#: Run grid: models by size, and for each approach the (context window, k) of its runs.
MODELS = [("model-3b", 3), ("model-8b", 8), ("model-14b", 14), ("model-32b", 32)]
CONTEXTS = (2048, 4096, 8192)
KS = (1, 3, 5, 9, 15)


def _arms() -> str:
    """Runs with the hex cut-offs (of 00..ff) below which a made prediction is right, or invalid from."""
    rows = []
    for m, (model, size) in enumerate(MODELS):
        for c, ctx in enumerate(CONTEXTS):
            rows.append((model, "few_shot", ctx, 0, 120 + 10 * m, 244 + 2 * c))
            rows += [(model, "few_shot", ctx, k, 140 + 9 * m + 4 * c + 3 * i - (i * i), 240 + 3 * c + m - i) for i, k in enumerate(KS)]
            rows.append((model, "fine_tune", ctx, -1, 150 + 8 * m - 3 * c, 256))
    rows += [("vote-similarity", "vote", 0, k, 130 + 4 * i, 256) for i, k in enumerate(KS)]
    body = ", ".join(f"('{m}', '{a}', {c}, {k}, {right}, {bad})" for m, a, c, k, right, bad in rows)
    return f"SELECT * FROM (VALUES {body}) AS t(model, approach, context_window, top_k, right_below, bad_from)"


VIEWS = {
    "issues_all": """SELECT doc_id AS item_id, split_part(text, chr(10), 1) AS title,
        substr(text, length(split_part(text, chr(10), 1)) + 2) AS body,
        CASE doc_id % 3 WHEN 0 THEN 'bug' WHEN 1 THEN 'feature' ELSE 'question' END AS labels
        FROM {documents}""",
    "issues_lab": """SELECT d.doc_id AS item_id, split_part(d.text, chr(10), 1) AS title,
        substr(d.text, length(split_part(d.text, chr(10), 1)) + 2) AS body,
        CASE WHEN l.toxic = 1 THEN 'question' WHEN l.quality = 0 THEN 'feature' ELSE 'bug' END AS labels
        FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    "vec_items": """SELECT vec_id AS item_id, embedding AS vector,
        CASE label % 3 WHEN 0 THEN 'bug' WHEN 1 THEN 'feature' ELSE 'question' END AS labels
        FROM {embeddings}""",
    "raw_outputs": """SELECT doc_id AS item_id,
        CASE doc_id % 3 WHEN 0 THEN 'bug' WHEN 1 THEN 'feature' ELSE 'question' END AS ground_truth,
        CASE doc_id % 17
        WHEN 0 THEN '<label>bug</label>' WHEN 1 THEN '<label>Feature</label>'
        WHEN 2 THEN '<label>bug' WHEN 3 THEN concat('<label>', chr(10), 'question', chr(10), '</label>')
        WHEN 4 THEN '<label>enhancement</label>'
        WHEN 5 THEN '<think>maybe <label>bug</label></think><label>question</label>'
        WHEN 6 THEN '<think>unfinished bug' WHEN 7 THEN 'bug, feature, or question: question'
        WHEN 8 THEN 'bug, feature, question' WHEN 9 THEN 'howto'
        WHEN 10 THEN 'feature_request please' WHEN 11 THEN ''
        WHEN 12 THEN 'b-u-g' WHEN 13 THEN '<label>none</label>'
        WHEN 14 THEN 'Answer: bug' WHEN 15 THEN '<label>Bug.</label>'
        ELSE 'featurerequest' END AS raw_output
        FROM {documents}""",
    "arms": _arms(),
    "pred_grid": """SELECT p.model, p.approach, p.context_window, p.top_k, p.item_id, p.ground_truth,
        CASE WHEN h >= lpad(hex(bad_from), 3, '0') AND bad_from < 256 THEN 'invalid'
             WHEN h < lpad(hex(right_below), 3, '0') THEN ground_truth
             WHEN item_id % 2 = 0 THEN CASE ground_truth WHEN 'bug' THEN 'question' ELSE 'bug' END
             ELSE CASE ground_truth WHEN 'feature' THEN 'question' ELSE 'feature' END END AS predicted_label,
        CAST(60 + (top_k + 1) * (20 + item_id % 37) AS BIGINT) AS prompt_tokens,
        CAST(3 + item_id % 5 AS BIGINT) AS generated_tokens
        FROM (SELECT a.*, i.item_id, i.labels AS ground_truth,
              concat('0', upper(substr(md5(concat(a.model, '|', a.approach, '|', CAST(a.context_window AS STRING), '|', CAST(a.top_k AS STRING), '|', CAST(i.item_id AS STRING))), 1, 2))) AS h
              FROM {issues_all} i CROSS JOIN {arms} a) p""",
    "cost_runs": """SELECT model, approach, context_window, top_k,
        CAST(context_window + 64 * (top_k + 2) AS DOUBLE) AS gpu_peak_memory_mb,
        CAST((top_k + 2) * (context_window + 512) AS DOUBLE) / 100.0 AS wall_time_s,
        CASE WHEN approach = 'fine_tune' THEN CAST(context_window AS DOUBLE) / 8.0 END AS training_time_s
        FROM {arms}""",
    "run_paths": """SELECT context_window, top_k, model, approach,
        concat('items_ctx', CAST(context_window AS STRING), '/', model, '/',
        CASE approach WHEN 'few_shot' THEN 'few_shot' WHEN 'fine_tune' THEN CASE WHEN context_window = 4096 THEN 'finetune_flawed' ELSE 'finetune_fixed' END ELSE 'vote' END,
        '/evaluations/eval_k', CAST(top_k AS STRING), '.csv') AS path FROM {arms}""",
    "class_scores": """SELECT item_id, ground_truth, c.label,
        CAST(ascii(substr(md5(concat(CAST(item_id AS STRING), c.label)), 1, 1)) - 45 AS DOUBLE) / 20.0 + CASE WHEN c.label = ground_truth THEN 1.0 ELSE 0.0 END AS score_a,
        CAST(ascii(substr(md5(concat(c.label, CAST(item_id AS STRING))), 1, 1)) - 45 AS DOUBLE) / 20.0 AS score_b
        FROM (SELECT item_id, labels AS ground_truth FROM {issues_all}) i CROSS JOIN (SELECT * FROM (VALUES ('bug'), ('feature'), ('question')) AS t(label)) c""",
    "pair_preds": """SELECT a.item_id, a.ground_truth, a.predicted_label AS pred_a, b.predicted_label AS pred_b
        FROM {pred_grid} a JOIN {pred_grid} b ON a.item_id = b.item_id
        WHERE a.model = 'model-8b' AND a.approach = 'few_shot' AND a.context_window = 8192 AND a.top_k = 3
        AND b.model = 'vote-similarity' AND b.top_k = 9""",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir or a view over it."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    needs = dict.fromkeys(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: frame(spark, sf_dir, n) for n in needs}) if needs else spark.sql(sql)


def with_views(sql: str, more: dict[str, str] | None = None) -> str:
    """``sql`` with every view it names (as {name}) in front, for DuckDB."""
    known = {**VIEWS, **(more or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        for n in dict.fromkeys(re.findall(r"\{(\w+)\}", text)):
            if n in known and n not in order:
                visit(known[n])
                order.append(n)

    visit(sql)
    plain = lambda t: re.sub(r"\{(\w+)\}", r"\1", t)
    head = ",\n".join(f"{n} AS ({plain(known[n])})" for n in order)
    return (f"WITH {head}\n" if head else "") + plain(sql)
