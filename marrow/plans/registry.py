"""Registered queries and their SQL, by name (letters are those of the operator inventory)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow import sources
from marrow.functions import LABELS, SYNONYMS, TOKEN, canonical_label, content_key, dot, l2_normalize, n_tokens
from marrow.operators import calibrate, curate, debias, directions, errors, parse, prompts, retrieve, runs, sample, score, vote
from marrow.plans.fixtures import CONTEXTS, KS, frame, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
View = Callable[[str], DataFrame]

#: SQL-only views: what operators make of the input views.
VIEWS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a view getter, with its DuckDB SQL."""

    def add(f: Callable[[View], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda n: frame(spark, sf_dir, n))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, VIEWS)
        return f

    return add


# --- SQL building blocks -------------------------------------------------------------

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def strip(c: str) -> str:
    return _STRIP.replace("{0}", c)


def key(t: str = "title", b: str = "body") -> str:
    return f"md5(concat(lower({strip(t)}), '||', lower({strip(b)})))"


def canon(c: str) -> str:
    x = f"lower({strip(c)})"
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SYNONYMS.items()) + f" ELSE {x} END"


def ntok(c: str) -> str:
    return f"CAST(len(regexp_extract_all({c}, '{TOKEN}')) AS BIGINT)"


def eval_sql(src: str, by: str, valid: bool = False, out: bool = True) -> str:
    t, p = f"lower({strip('ground_truth')})", f"lower({strip('predicted_label')})"
    counts = ", ".join(f"count(*) FILTER (t = '{v}' AND p = '{v}') AS tp_{v}, count(*) FILTER (p = '{v}') AS pp_{v}, count(*) FILTER (t = '{v}') AS support_{v}" for v in LABELS)
    keep = "WHERE p IN ('bug', 'feature', 'question')" if valid else ""
    pr = ", ".join(f"coalesce(CAST(tp_{v} AS DOUBLE) / nullif(pp_{v}, 0), 0) AS p_{v}, coalesce(CAST(tp_{v} AS DOUBLE) / nullif(support_{v}, 0), 0) AS r_{v}" for v in LABELS)
    fs = ", ".join(f"coalesce(p_{v} * r_{v} * 2 / nullif(p_{v} + r_{v}, 0), 0) AS f_{v}" for v in LABELS)
    total = " + ".join(f"support_{v}" for v in LABELS)
    cols = ", ".join(f"round(p_{v}, 4) AS precision_{v}, round(r_{v}, 4) AS recall_{v}, round(f_{v}, 4) AS f1_{v}, support_{v}" for v in LABELS)
    for s, name in (("p", "precision"), ("r", "recall"), ("f", "f1")):
        cols += f", round(({' + '.join(f'{s}_{v}' for v in LABELS)}) / 3, 4) AS {name}_macro"
        cols += f", round(coalesce(({' + '.join(f'{s}_{v} * support_{v}' for v in LABELS)}) / nullif({total}, 0), 0), 4) AS {name}_weighted"
    every = f"(SELECT {by}, count(*) AS e_n, count(*) FILTER (coalesce(lower({strip('predicted_label')}), '') NOT IN ('bug', 'feature', 'question')) AS e_bad FROM {src} GROUP BY ALL)"
    inner = f"SELECT {by}, count(*) AS n, count(*) FILTER (p = 'invalid') AS n_invalid, count(*) FILTER (t = p) AS right_n, {counts} FROM (SELECT {by}, {t} AS t, {p} AS p FROM {src}) {keep} GROUP BY ALL"
    bad = ("e_bad", "CAST(e_bad AS DOUBLE) / e_n") if valid else ("n_invalid", "CAST(n_invalid AS DOUBLE) / n")
    body = f"SELECT *, {fs} FROM (SELECT *, {pr} FROM ({inner}))"
    if valid:
        body = f"SELECT * FROM ({body}) JOIN {every} USING ({by})"
    return f"SELECT {by}, n AS total_issues, {bad[0]} AS invalid_count, round({bad[1]}, 4) AS invalid_rate, round(CAST(right_n AS DOUBLE) / n, 4) AS accuracy, {cols} FROM ({body})"


RUN = "context_window, approach, model, top_k"
FIRST = "context_window, approach, model, top_k"


def best_sql(where: str, by: str) -> str:
    return f"SELECT * FROM {{runs}} WHERE {where} QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY f1_macro DESC NULLS LAST, {FIRST}) = 1"


_NORM = "sqrt(list_inner_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[])))"
VIEWS |= {
    "unit": f"SELECT item_id, labels, [x / CASE WHEN n > 0 THEN n ELSE 1 END FOR x IN CAST(vector AS DOUBLE[])] AS v FROM (SELECT *, {_NORM.replace('{0}', 'vector')} AS n FROM {{vec_items}})",
    "split_vec": "SELECT *, CASE WHEN row_number() OVER (PARTITION BY labels ORDER BY item_id) <= floor(count(*) OVER (PARTITION BY labels) * 0.5) THEN 'test' ELSE 'train' END AS split FROM {unit}",
    "neighbors": """SELECT test_id, rn - 1 AS neighbor_rank, neighbor_id, similarity, test_label, neighbor_label FROM (
        SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY similarity DESC, neighbor_id) AS rn FROM (
        SELECT q.item_id AS test_id, p.item_id AS neighbor_id, q.labels AS test_label, p.labels AS neighbor_label, round(list_inner_product(q.v, p.v), 12) AS similarity
        FROM {split_vec} q CROSS JOIN {split_vec} p WHERE q.split = 'test' AND p.split = 'train')) WHERE rn <= 30""",
    "votes": """SELECT scheme, k, test_id, ground_truth, predicted_label FROM (
        SELECT *, row_number() OVER (PARTITION BY scheme, k, test_id ORDER BY s DESC, best) AS rn FROM (
        SELECT scheme, k, test_id, test_label AS ground_truth, neighbor_label AS predicted_label, min(neighbor_rank) AS best,
        sum(CASE scheme WHEN 'similarity' THEN similarity WHEN 'shepard' THEN similarity * similarity ELSE 1 END ORDER BY neighbor_rank) AS s
        FROM {neighbors} CROSS JOIN (VALUES ('similarity'), ('shepard'), ('majority')) m(scheme) CROSS JOIN (SELECT unnest([1, 3, 5, 9, 15, 30]) AS k)
        WHERE neighbor_rank < k GROUP BY ALL)) WHERE rn = 1""",
    "runs": eval_sql("{pred_grid}", RUN),
    "items": f"SELECT item_id, title, body, labels, {key()} AS k FROM {{issues_all}}",
    "deduped": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY item_id) AS rn FROM {items}) WHERE rn = 1",
    "split_items": "SELECT *, CASE WHEN row_number() OVER (PARTITION BY labels ORDER BY item_id) <= floor(count(*) OVER (PARTITION BY labels) * 0.5) THEN 'test' ELSE 'train' END AS split FROM {items}",
    "mix": "SELECT test_id AS item_id, count(*) FILTER (neighbor_label = 'bug') AS c_bug, count(*) FILTER (neighbor_label = 'feature') AS c_feature, count(*) FILTER (neighbor_label = 'question') AS c_question FROM {neighbors} WHERE neighbor_rank < 9 GROUP BY 1",
    "preds9": "SELECT test_id AS item_id, ground_truth, predicted_label FROM {votes} WHERE scheme = 'similarity' AND k = 9",
    "best_ctx": best_sql("approach = 'few_shot' AND top_k > 0", "model, context_window"),
    "best_runs": best_sql("true", "model, approach"),
    "layers": "SELECT item_id, labels, l AS layer, vector[l * 16 + 1 : l * 16 + 16] AS vector FROM {vec_items} CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS l)",
}


# --- Spark building blocks -----------------------------------------------------------

#: Ks of the vote sweep.
VOTE_KS = [1, 3, 5, 9, 15, 30]


def split_vec(v: View) -> DataFrame:
    """The split, written once: it takes several passes, and retrieval reads each side more than once."""
    return sources.stored(sample.head_split(v("vec_items"), fraction=0.5))


def neighbors(v: View) -> DataFrame:
    s = split_vec(v)
    test, train = s.where("split = 'test'"), s.where("split = 'train'")
    return retrieve.enrich_neighbors(retrieve.knn_join(test, train, 30), test, train, ("labels",))


def votes(v: View) -> DataFrame:
    return vote.vote_sweep(neighbors(v), VOTE_KS)


def run_scores(v: View) -> DataFrame:
    return score.evaluate_strict(v("pred_grid"), runs.RUN)


def predictions(near: DataFrame) -> DataFrame:
    return vote.vote(near, 9).select(F.col("test_id").alias("item_id"), "ground_truth", "predicted_label")


def preds9(v: View) -> DataFrame:
    return predictions(neighbors(v))


def preds_and_mix(v: View) -> tuple[DataFrame, DataFrame]:
    """Predictions and label counts of one neighbour table, which is written once."""
    near = sources.stored(neighbors(v))
    return predictions(near), errors.label_mix(near, 9)


def layers(v: View) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("layer"), F.slice("vector", 16 * k + 1, 16).alias("part")) for k in range(4))))
    return v("vec_items").select("item_id", "labels", each.alias("x")).select("item_id", "labels", "x.layer", F.col("x.part").alias("vector"))


def split_items(v: View) -> DataFrame:
    return sample.head_split(v("issues_all"), fraction=0.5)


# --- flagship ------------------------------------------------------------------------


@query("flagship_vote_sweep", eval_sql("{votes}", "scheme, k"))
def _(v):
    return score.evaluate_strict(votes(v), ["scheme", "k"])


# --- A, B: sources and curation ------------------------------------------------------


@query("a2_conform_items", f"SELECT item_id, title, body, lower({strip('labels')}) AS labels FROM {{issues_all}}")
def _(v):
    return curate.conform_items(v("issues_all").withColumnRenamed("labels", "label"))


@query("a3_load_neighbors", "SELECT test_id, string_agg(CAST(neighbor_rank AS VARCHAR) || ':' || neighbor_label, ',' ORDER BY neighbor_rank) AS near FROM {neighbors} WHERE neighbor_rank < 5 GROUP BY 1")
def _(v):
    from marrow.sources import load_neighbors

    n = load_neighbors(neighbors(v), 5)
    return n.select("test_id", F.array_join(F.transform("neighbors", lambda x: F.concat(x["neighbor_rank"].cast("string"), F.lit(":"), x["neighbor_label"])), ",").alias("near"))


#: Paths of one output file for each document: dataset folder, seed (for some), approach, file.
VIEWS["doc_paths"] = """SELECT doc_id AS item_id, concat(coalesce(source, 'none'), '_ctx', CAST(1024 * (1 + doc_id % 8) AS VARCHAR), CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('/seed', CAST(doc_id % 3 AS VARCHAR)) END,
    CASE doc_id % 4 WHEN 0 THEN '/few_shot_fixed' WHEN 1 THEN '/finetune_flawed' WHEN 2 THEN '/finetune_fixed' ELSE '/vote' END, '/', coalesce(lang, 'xx'), '.csv') AS path FROM {documents}"""


@query("a4_a5_tag_runs", """SELECT item_id, path, CAST(nullif(regexp_extract(path, '_ctx([0-9]+)', 1), '') AS BIGINT) AS tag_context,
    CASE WHEN contains(path, 'few_shot') THEN 'few_shot' WHEN contains(path, 'flawed') THEN 'fine_tune_flawed' WHEN contains(path, 'fixed') THEN 'fine_tune_fixed' ELSE 'unknown' END AS tag_approach,
    split_part(path, '/', 1) AS tag_dataset, split_part(path, '/', 2) AS tag_seed FROM {doc_paths}""")
def _(v):
    d = v("documents")
    n = F.col("doc_id")
    seed = F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("/seed"), (n % 3).cast("string")))
    kind = F.when(n % 4 == 0, "/few_shot_fixed").when(n % 4 == 1, "/finetune_flawed").when(n % 4 == 2, "/finetune_fixed").otherwise("/vote")
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("_ctx"), (1024 * (1 + n % 8)).cast("string"), seed, kind, F.lit("/"), F.coalesce("lang", F.lit("xx")), F.lit(".csv"))
    return runs.tag_runs(runs.tag_context(d.select(n.alias("item_id"), path.alias("path"))))


def _folder(v: View) -> str:
    return sources.shared_folder(v("documents").sparkSession)


@query("a1_read_items", f"SELECT item_id, coalesce(title, '') AS title, coalesce(body, '') AS body, lower({strip('labels')}) AS labels FROM {{issues_all}}")
def _(v):
    d, path = v("issues_all"), _folder(v)
    sources.write(d, path, "csv")
    return sources.read_items(d.sparkSession, path)


@query("a7_write_splits", """SELECT concat(split, '_split') AS part, item_id, title, body, labels FROM {split_items}
    UNION ALL SELECT concat(split, '_split_info'), item_id, title, NULL, labels FROM {split_items}""")
def _(v):
    s, path = split_items(v), _folder(v)
    sources.write_splits(s, path)
    back = [s.sparkSession.read.parquet(f"{path}/{x}").withColumn("part", F.lit(x)) for x in ("train_split", "test_split", "train_split_info", "test_split_info")]
    return runs.concat_runs(back).select("part", "item_id", "title", "body", "labels")


@query("a8_write_neighbors", "SELECT k, test_id, neighbor_rank, neighbor_label, round(similarity, 6) AS similarity FROM {neighbors} CROSS JOIN (SELECT unnest([1, 5, 9]) AS k) WHERE neighbor_rank < k")
def _(v):
    n, path = retrieve.explode_k(neighbors(v), [1, 5, 9]), _folder(v)
    sources.write_neighbors(n, path)
    return n.sparkSession.read.parquet(path).select(F.col("k").cast("long").alias("k"), "test_id", "neighbor_rank", "neighbor_label", F.round("similarity", 6).alias("similarity"))


@query("a9_write_predictions", f"SELECT p.*, r.f1_macro FROM {{preds9}} p CROSS JOIN ({eval_sql('(SELECT 1 AS run, * FROM {preds9})', 'run')}) r")
def _(v):
    path = _folder(v)
    sources.write_predictions(preds9(v), f"{path}/predictions", "csv")
    back = sources.read_csv(v("documents").sparkSession, f"{path}/predictions", "item_id long, ground_truth string, predicted_label string")
    sources.write(score.evaluate_strict(back.withColumn("run", F.lit(1)), ["run"]), f"{path}/runs")
    return back.join(F.broadcast(back.sparkSession.read.parquet(f"{path}/runs").select("f1_macro")))  # one row


@query("a11_skip_existing", "SELECT item_id, labels, true AS first_written, false AS second_written, true AS is_complete FROM {split_items} WHERE split = 'test'")
def _(v):
    s, path = split_items(v).select("item_id", "labels", "split"), _folder(v)
    first = sources.write(s.where("split = 'test'").drop("split"), path, mode="ignore")
    second = sources.write(s.where("split = 'train'").drop("split"), path, mode="ignore")  # complete: nothing is written
    whole = sources.complete(s.sparkSession, path)
    return s.sparkSession.read.parquet(path).select("item_id", "labels", F.lit(first).alias("first_written"), F.lit(second).alias("second_written"), F.lit(whole).alias("is_complete"))


@query("a8_bucketed_votes", "SELECT test_id, ground_truth, predicted_label FROM {votes} WHERE scheme = 'similarity' AND k = 9")
def _(v):
    """A vote over a neighbour table in buckets by test_id: it isn't shuffled again."""
    path = _folder(v)
    n = sources.store_neighbors(neighbors(v), f"neighbors_{path.rsplit('/', 1)[-1]}", path, 8)
    return vote.vote(n, 9).select("test_id", "ground_truth", "predicted_label")


@query("a6_concat_runs", "SELECT model, top_k, f1_macro, NULL::DOUBLE AS wall_time_s FROM {runs} UNION ALL SELECT model, top_k, NULL, wall_time_s FROM {cost_runs}")
def _(v):
    return runs.concat_runs([run_scores(v).select("model", "top_k", "f1_macro"), v("cost_runs").select("model", "top_k", "wall_time_s")])


@query("a10_log_rows", "SELECT item_id, substr(raw_output, 1, 500) AS raw_output, parsed_label, ground_truth FROM (SELECT *, CASE doc17 WHEN 0 THEN 'bug' WHEN 1 THEN 'feature' WHEN 3 THEN 'question' WHEN 4 THEN 'feature' WHEN 5 THEN 'question' WHEN 7 THEN 'question' WHEN 9 THEN 'question' WHEN 10 THEN 'feature' WHEN 12 THEN 'bug' WHEN 15 THEN 'bug' WHEN 16 THEN 'feature' ELSE 'invalid' END AS parsed_label FROM (SELECT *, item_id % 17 AS doc17 FROM {raw_outputs}))")
def _(v):
    from marrow.sources import log_rows

    return log_rows(parse.parse_outputs(v("raw_outputs")))


@query("b1_b2_clean_text", r"SELECT item_id, regexp_replace(regexp_replace(concat(title, ' ', body), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text, concat(title, ' ', body) AS raw_text FROM {issues_all}")
def _(v):
    return v("issues_all").select("item_id", curate.item_text().alias("text"), curate.item_text(False).alias("raw_text"))


@query("b3_content_key", "SELECT item_id, k AS content_key FROM {items}")
def _(v):
    return v("issues_all").select("item_id", content_key("title", "body").alias("content_key"))


@query("b4_dedup_first", "SELECT item_id, title, body, labels FROM {deduped}")
def _(v):
    return curate.dedup_first(v("issues_all"))


@query("b4_dedup_report", "SELECT count(*) AS n_before, count(DISTINCT k) AS n_after, count(*) - count(DISTINCT k) AS n_removed FROM {items}")
def _(v):
    return curate.dedup_report(v("issues_all"))


@query("b5_drop_leaks", "SELECT item_id, labels FROM {split_items} WHERE split = 'train' AND k NOT IN (SELECT k FROM {split_items} WHERE split = 'test')")
def _(v):
    s = split_items(v)
    return curate.drop_leaks(s.where("split = 'train'"), s.where("split = 'test'")).select("item_id", "labels")


@query("b6_leak_report", "SELECT labels, count(*) AS n_leaked FROM {split_items} WHERE split = 'train' AND k IN (SELECT k FROM {split_items} WHERE split = 'test') GROUP BY 1")
def _(v):
    return curate.leak_report(v("issues_all"), split_items(v).where("split = 'test'"))


@query("b7_canonical_label", f"SELECT item_id, {canon('w')} AS label FROM (SELECT item_id, split_part(title, ' ', 1) AS w FROM {{issues_all}} UNION ALL SELECT item_id, CASE item_id % 13 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(SYNONYMS)) + " ELSE 'Bug ' END FROM {issues_all})")
def _(v):
    d = v("issues_all")
    words = F.lit("Bug ")
    for i, k in reversed(list(enumerate(SYNONYMS))):
        words = F.when(F.col("item_id") % 13 == i, k).otherwise(words)
    w = d.select("item_id", F.split_part("title", F.lit(" "), F.lit(1)).alias("w")).unionByName(d.select("item_id", words.alias("w")))
    return w.select("item_id", canonical_label("w").alias("label"))


@query("b8_label_counts", "SELECT labels, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test FROM {split_items} GROUP BY 1")
def _(v):
    return curate.label_counts(split_items(v))


@query("b9_dedup_rows", "SELECT count(*) AS n_before, (SELECT count(*) FROM (SELECT DISTINCT title, body FROM {issues_all})) AS n_after FROM {issues_all}")
def _(v):
    return curate.dedup_rows_report(v("issues_all").select("title", "body"))


@query("b9_distinct_rows", "SELECT DISTINCT title, labels FROM {issues_all}")
def _(v):
    return curate.dedup_rows(v("issues_all").select("title", "labels"))


@query("b10_config_conflicts", "SELECT context_window, model, top_k, count(*) AS n_rows FROM {pred_grid} GROUP BY 1, 2, 3 HAVING count(*) > 1")
def _(v):
    return curate.config_conflicts(v("pred_grid"))


@query("b10_config_counts", "SELECT context_window, count(DISTINCT model) AS n_models, count(DISTINCT top_k) AS n_ks FROM {pred_grid} GROUP BY 1")
def _(v):
    return curate.config_counts(v("pred_grid"))


# --- C: splits and samples -----------------------------------------------------------

_RANK = "SELECT *, row_number() OVER (PARTITION BY labels ORDER BY {order}, item_id) AS rn, count(*) OVER (PARTITION BY labels) AS cnt, dense_rank() OVER (ORDER BY labels) - 1 AS li, (SELECT count(DISTINCT labels) FROM {src}) AS nl FROM {src}"


def _rank(src: str, order: str = "item_id") -> str:
    return _RANK.replace("{order}", order).replace("{src}", src)


@query("c1_head_split", "SELECT item_id, labels, split FROM {split_items}")
def _(v):
    return split_items(v).select("item_id", "labels", "split")


@query("c1_test_idx", "SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS test_idx FROM {split_items} WHERE split = 'test'")
def _(v):
    return sample.with_test_idx(split_items(v).where("split = 'test'").select("item_id"))


@query("c2_head_split_total", f"SELECT item_id, labels, CASE WHEN rn <= least(100 // nl, cnt) THEN 'test' ELSE 'train' END AS split FROM ({_rank('{issues_lab}')})")
def _(v):
    return sample.head_split(v("issues_lab"), total=100).select("item_id", "labels", "split")


_MD5 = "md5(concat('7|', CAST(item_id AS VARCHAR)))"


@query("c3_c4_subsample_sweep", f"SELECT pool_size, item_id, labels FROM ({_rank('{issues_lab}', _MD5)}) CROSS JOIN (SELECT unnest([20, 100, 250]) AS pool_size) WHERE rn <= pool_size // nl + CASE WHEN li < pool_size % nl THEN 1 ELSE 0 END")
def _(v):
    return sample.subsample_sweep(v("issues_lab"), [20, 100, 250], 7).select("pool_size", "item_id", "labels")


@query("c5_quota_check", "SELECT labels, available, CAST(300 // nl + CASE WHEN li < 300 % nl THEN 1 ELSE 0 END AS BIGINT) AS quota FROM (SELECT labels, count(*) AS available, row_number() OVER (ORDER BY labels) - 1 AS li, count(*) OVER () AS nl FROM {issues_lab} GROUP BY 1) WHERE 300 // nl + CASE WHEN li < 300 % nl THEN 1 ELSE 0 END > available")
def _(v):
    return sample.quota_check(v("issues_lab"), 300)


@query("c6_per_label_sample", f"SELECT item_id, labels FROM ({_rank('{issues_lab}', _MD5)}) WHERE rn <= 100 // nl")
def _(v):
    return sample.per_label_sample(v("issues_lab"), 100, 7).select("item_id", "labels")


@query("c7_random_subset", f"SELECT item_id, labels FROM {{issues_all}} ORDER BY {_MD5}, item_id LIMIT 50")
def _(v):
    return sample.random_subset(v("issues_all"), 50, 7).select("item_id", "labels")


def _round(i: int) -> str:
    """One round of the keyed permutation over (l, r) with sides a and b."""
    side, other, n = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
    mixed = f"CAST(concat('0x', substr(md5(concat(seed, '|', test_id, '|{i}|', {other})), 1, 12)) AS BIGINT)"
    return f"SELECT * REPLACE (({side} + {mixed}) % {n} AS {side}) FROM "


_ONCE = "".join(f"{_round(i)}(" for i in reversed(range(sample.ROUNDS))) + "{0}" + ")" * sample.ROUNDS


@query("c8_c9_random_neighbors", f"""SELECT * FROM (WITH RECURSIVE size AS (SELECT count(*) AS n, greatest(2, CAST(floor(sqrt(count(*))) AS BIGINT)) AS root FROM {{split_vec}} WHERE split = 'train'),
    sides AS (SELECT n, a, greatest(2, (n + a - 1) // a) AS b FROM (SELECT n, unnest(range(greatest(2, root - root // 4), root + 1)) AS a FROM size) ORDER BY (a - n % a) % a, a DESC LIMIT 1),
    walk AS (SELECT 0 AS step, seed, test_id, neighbor_rank, n, a, b, CAST(neighbor_rank // b AS BIGINT) AS l, CAST(neighbor_rank % b AS BIGINT) AS r
        FROM (SELECT item_id AS test_id FROM {{split_vec}} WHERE split = 'test') CROSS JOIN sides CROSS JOIN (SELECT unnest([1, 2]) AS seed) CROSS JOIN (SELECT unnest(range(5)) AS neighbor_rank)
        UNION ALL SELECT step + 1, seed, test_id, neighbor_rank, n, a, b, l, r FROM ({_ONCE.replace('{0}', 'SELECT * FROM walk WHERE step = 0 OR l * b + r >= n')}))
    SELECT w.seed, w.test_id, w.neighbor_rank, p.neighbor_id, CAST(0 AS DOUBLE) AS similarity FROM walk w
    JOIN (SELECT item_id AS neighbor_id, row_number() OVER (ORDER BY md5(CAST(item_id AS VARCHAR)), item_id) - 1 AS place FROM {{split_vec}} WHERE split = 'train') p ON p.place = w.l * w.b + w.r
    WHERE w.step > 0 AND w.l * w.b + w.r < w.n)""")
def _(v):
    s = split_vec(v)
    return sample.random_neighbors(s.where("split = 'test'"), s.where("split = 'train'"), 5, [1, 2])


# --- D, E: retrieval and votes -------------------------------------------------------


@query("d1_l2_normalize", "SELECT item_id, round(list_sum(v), 6) AS total, round(v[1], 6) AS first_x FROM {unit}")
def _(v):
    u = v("vec_items").select("item_id", l2_normalize("vector").alias("u"))
    return u.select("item_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.get("u", F.lit(0)), 6).alias("first_x"))


@query("d2_knn_join", "SELECT test_id, neighbor_rank, neighbor_id, round(similarity, 6) AS similarity FROM {neighbors}")
def _(v):
    s = split_vec(v)
    return retrieve.knn_join(s.where("split = 'test'"), s.where("split = 'train'"), 30).withColumn("similarity", F.round("similarity", 6))


@query("d3_explode_k", "SELECT k, test_id, neighbor_rank, neighbor_id FROM {neighbors} CROSS JOIN (SELECT unnest([1, 5, 40]) AS k) WHERE neighbor_rank < k")
def _(v):
    return retrieve.explode_k(neighbors(v), [1, 5, 40]).select("k", "test_id", "neighbor_rank", "neighbor_id")


@query("d4_knn_sweep", f"""SELECT pool_size, test_id, rn - 1 AS neighbor_rank, neighbor_id FROM (
    SELECT *, row_number() OVER (PARTITION BY pool_size, test_id ORDER BY similarity DESC, neighbor_id) AS rn FROM (
    SELECT pool_size, q.item_id AS test_id, p.item_id AS neighbor_id, round(list_inner_product(q.v, p.v), 12) AS similarity
    FROM {{split_vec}} q CROSS JOIN (SELECT * FROM ({_rank("(SELECT * FROM {split_vec} WHERE split = 'train')", _MD5)}) CROSS JOIN (SELECT unnest([30, 90]) AS pool_size) WHERE rn <= pool_size // nl + CASE WHEN li < pool_size % nl THEN 1 ELSE 0 END) p WHERE q.split = 'test')) WHERE rn <= 5""")
def _(v):
    s = split_vec(v)
    pools = sample.subsample_sweep(s.where("split = 'train'"), [30, 90], 7)
    return retrieve.knn_sweep(s.where("split = 'test'"), pools, 5).select("pool_size", "test_id", "neighbor_rank", "neighbor_id")


@query("d5_enrich_neighbors", "SELECT test_id, neighbor_rank, neighbor_id, test_label, neighbor_label FROM {neighbors}")
def _(v):
    return neighbors(v).select("test_id", "neighbor_rank", "neighbor_id", "test_label", "neighbor_label")


@query("d6_match_pairs", "SELECT a_id, b_id, round(similarity, 6) AS similarity FROM (SELECT a.item_id AS a_id, b.item_id AS b_id, round(list_inner_product(a.v, b.v), 12) AS similarity FROM {unit} a CROSS JOIN {unit} b WHERE a.labels = 'bug' AND b.labels = 'question') QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY similarity DESC, b_id) = 1")
def _(v):
    return retrieve.match_pairs(v("vec_items"), "bug", "question").withColumn("similarity", F.round("similarity", 6))


@query("d7_knn_cells", """SELECT q.item_id AS test_id, least(10, n) AS n_neighbors, true AS ranks_complete, true AS exact_similarity
    FROM {split_vec} q CROSS JOIN (SELECT count(*) AS n FROM {split_vec} WHERE split = 'train') WHERE q.split = 'test'""")
def _(v):
    s = split_vec(v)
    u = s.select("item_id", l2_normalize("vector").alias("u"))
    near = retrieve.knn_cells(s.where("split = 'test'"), s.where("split = 'train'"), 10)
    r = near.join(u.select(F.col("item_id").alias("test_id"), F.col("u").alias("a")), "test_id").join(u.select(F.col("item_id").alias("neighbor_id"), F.col("u").alias("b")), "neighbor_id")
    return r.groupBy("test_id").agg(F.count("*").alias("n_neighbors"), (F.count_distinct("neighbor_rank", "neighbor_id") == F.max("neighbor_rank") + 1).alias("ranks_complete"), F.every(F.abs(F.col("similarity") - dot("a", "b")) < 1e-9).alias("exact_similarity"))


@query("d7_recall", """SELECT n_q * least(10, n_p) AS n_true, 900 AS recall_thousandths_to_900, 250 AS scored_thousandths_from_250
    FROM (SELECT count(*) FILTER (split = 'test') AS n_q, count(*) FILTER (split = 'train') AS n_p FROM {split_vec})""")
def _(v):
    """Recall against the exact join, cut off above 0.9, and the share of pairs scored exactly, cut off below a quarter."""
    s = split_vec(v)
    test, train = s.where("split = 'test'"), s.where("split = 'train'")
    exact = retrieve.knn_join(test, train, 10).select("test_id", "neighbor_id")
    near = sources.stored(retrieve.knn_cells(test, train, 10, scored=True))
    found = near.select("test_id", "neighbor_id", F.lit(1).alias("found"))
    n = exact.join(found, ["test_id", "neighbor_id"], "left").agg(F.count("*").alias("n_true"), F.floor(F.count("found") * 1000 / F.count("*")).alias("recall"))
    pairs = s.agg((F.count_if(F.col("split") == "test") * F.count_if(F.col("split") == "train")).alias("pairs"))
    scored = near.groupBy("test_id").agg(F.max("n_scored").alias("n")).agg(F.sum("n").alias("scored"))
    one = n.join(F.broadcast(pairs)).join(F.broadcast(scored))  # one row each
    return one.select("n_true", F.least("recall", F.lit(900)).cast("int").alias("recall_thousandths_to_900"), F.greatest(F.ceil(F.col("scored") * 1000 / F.col("pairs")), F.lit(250)).cast("int").alias("scored_thousandths_from_250"))


@query("e1_e5_vote_sweep", "SELECT scheme, k, test_id, ground_truth, predicted_label FROM {votes}")
def _(v):
    return votes(v)


@query("e6_to_predictions", "SELECT v.test_id AS test_idx, i.title, i.body, v.ground_truth, v.predicted_label, v.predicted_label AS raw_output, false AS truncated, false AS neighbors_truncated, false AS query_truncated, 0 AS tokens_removed, 'vote-' || scheme AS parsed_via, 0 AS prompt_tokens, 0 AS generated_tokens, scheme, k FROM {votes} v JOIN {issues_all} i ON i.item_id = v.test_id")
def _(v):
    return vote.to_predictions(votes(v), v("issues_all"))


@query("e7_vote_accuracy", "SELECT scheme, k, round(avg(CASE WHEN predicted_label = ground_truth THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM {votes} GROUP BY 1, 2")
def _(v):
    return vote.vote_accuracy(votes(v)).withColumn("accuracy", F.round("accuracy", 6))


# --- G: output parsing ---------------------------------------------------------------

_PARSED = """SELECT item_id, ground_truth, raw_output,
    CASE c WHEN 0 THEN 'bug' WHEN 1 THEN 'feature' WHEN 3 THEN 'question' WHEN 4 THEN 'feature' WHEN 5 THEN 'question' WHEN 7 THEN 'question' WHEN 9 THEN 'question' WHEN 10 THEN 'feature' WHEN 12 THEN 'bug' WHEN 15 THEN 'bug' WHEN 16 THEN 'feature' ELSE 'invalid' END AS predicted_label,
    CASE WHEN c IN (0, 1, 4, 5, 15) THEN 'xml' WHEN c IN (3, 7, 9, 10, 12, 16) THEN 'regex' ELSE 'failed' END AS parsed_via
    FROM (SELECT *, item_id % 17 AS c FROM {raw_outputs})"""
VIEWS["parsed"] = _PARSED


@query("g1_g6_parse_outputs", "SELECT item_id, substr(raw_output, 1, 300) AS raw_output, predicted_label, parsed_via FROM {parsed}")
def _(v):
    return parse.parse_outputs(v("raw_outputs")).select("item_id", "raw_output", "predicted_label", "parsed_via")


@query("g1_last_tag", r"SELECT item_id, CASE WHEN len(m) > 0 THEN lower(trim(m[-1], ' ' || chr(10))) END AS tag FROM (SELECT item_id, regexp_extract_all(raw_output, '(?is)<label>\s*(.*?)\s*</label>', 1) AS m FROM {raw_outputs})")
def _(v):
    has = F.size(F.regexp_extract_all("raw_output", F.lit(parse.TAG), F.lit(1))) > 0
    return v("raw_outputs").select("item_id", F.when(has, parse.last_tag(F.col("raw_output"))).alias("tag"))


@query("g3_without_thinking", r"SELECT item_id, trim(regexp_replace(regexp_replace(raw_output, '(?is)<think>.*?</think>', '', 'g'), '(?is)<think>.*$', ''), ' ' || chr(10)) AS rest FROM {raw_outputs}")
def _(v):
    return v("raw_outputs").select("item_id", parse.without_thinking(F.col("raw_output")).alias("rest"))


@query("g7_parse_keyword", r"SELECT item_id, coalesce(nullif(lower(regexp_extract(raw_output, '(?i)\b(bug|feature|question)\b', 1)), ''), 'invalid') AS label FROM {raw_outputs}")
def _(v):
    return v("raw_outputs").select("item_id", parse.parse_keyword(F.col("raw_output")).alias("label"))


@query("g8_after_marker", r"SELECT item_id, CASE WHEN has THEN trim(rest) ELSE 'NO_RESPONSE_MARKER' END AS raw_output, CASE WHEN has THEN l ELSE 'invalid' END AS predicted_label, CASE WHEN has AND l <> 'invalid' THEN 'regex' ELSE 'failed' END AS parsed_via FROM (SELECT *, coalesce(nullif(lower(regexp_extract(rest, '(?i)\b(bug|feature|question)\b', 1)), ''), 'invalid') AS l FROM (SELECT item_id, item_id % 3 > 0 AS has, CASE item_id % 3 WHEN 1 THEN ' ' || ground_truth WHEN 2 THEN ' none' END AS rest FROM {raw_outputs}))")
def _(v):
    raw = F.concat(F.lit("q ### Response: x"), F.when(F.col("item_id") % 3 > 0, F.concat(F.lit("### Response: "), F.when(F.col("item_id") % 3 == 1, F.col("ground_truth")).otherwise("none"))).otherwise(""))
    d = v("raw_outputs").select("item_id", F.when(F.col("item_id") % 3 == 0, "bug without it").otherwise(raw).alias("raw_output"))
    return parse.after_marker(d).select("item_id", "raw_output", "predicted_label", "parsed_via")


@query("g10_parse_report", "SELECT ground_truth, n, n_xml, n_regex, n_failed, round(n_xml * 100.0 / n, 4)::DOUBLE AS pct_xml, round(n_regex * 100.0 / n, 4)::DOUBLE AS pct_regex, round(n_failed * 100.0 / n, 4)::DOUBLE AS pct_failed FROM (SELECT ground_truth, count(*) AS n, count(*) FILTER (parsed_via = 'xml') AS n_xml, count(*) FILTER (parsed_via = 'regex') AS n_regex, count(*) FILTER (parsed_via = 'failed') AS n_failed FROM {parsed} GROUP BY 1)")
def _(v):
    return parse.parse_report(parse.parse_outputs(v("raw_outputs")), ["ground_truth"])


@query("g11_error_rows", "SELECT ground_truth, count(*) AS n, count(*) FILTER (item_id % 7 = 0) AS n_errors, round(CAST(count(*) FILTER (item_id % 7 = 0) AS DOUBLE) / count(*), 6) AS error_rate FROM {raw_outputs} GROUP BY 1")
def _(v):
    d = v("raw_outputs").withColumn("raw_output", F.when(F.col("item_id") % 7 == 0, "ERROR: out of memory <label>bug</label>").otherwise(F.col("raw_output")))
    return parse.error_rows(parse.parse_outputs(d), ["ground_truth"])


# --- H: debiasing --------------------------------------------------------------------

_GATED = "SELECT *, count(*) FILTER (neighbor_rank < 9 AND neighbor_label = 'bug') OVER w AS nb, count(*) FILTER (neighbor_rank < 9 AND neighbor_label = 'question') OVER w AS nq FROM {neighbors} WHERE neighbor_rank < 16 WINDOW w AS (PARTITION BY test_id)"
VIEWS["gated"] = f"SELECT *, nb > 0 AND nb - nq <= 2 AS gate FROM ({_GATED})"


@query("h1_debias_margin", "SELECT test_id, neighbor_rank, neighbor_id FROM {gated} WHERE neighbor_rank < 9 AND NOT (gate AND neighbor_label = 'bug')")
def _(v):
    return debias.debias(neighbors(v), 9, 2).select("test_id", "neighbor_rank", "neighbor_id")


@query("h2_debias_always", "SELECT test_id, rn - 1 AS neighbor_rank, neighbor_id FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY neighbor_rank) AS rn FROM {gated} WHERE neighbor_label <> 'bug') WHERE rn <= 9")
def _(v):
    return debias.debias(neighbors(v), 9, mode="always").select("test_id", "neighbor_rank", "neighbor_id")


@query("h3_debias_replace", "SELECT test_id, rn - 1 AS neighbor_rank, neighbor_id FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY neighbor_rank) AS rn FROM {gated} WHERE NOT (gate AND neighbor_label = 'bug')) WHERE rn <= 9")
def _(v):
    return debias.debias(neighbors(v), 9, 2, mode="replace").select("test_id", "neighbor_rank", "neighbor_id")


@query("h4_debias_cap", "SELECT test_id, neighbor_rank, neighbor_id FROM (SELECT *, row_number() OVER (PARTITION BY test_id, neighbor_label = 'bug' ORDER BY neighbor_rank) AS nth FROM {gated} WHERE neighbor_rank < 9) WHERE neighbor_label <> 'bug' OR nth <= 1")
def _(v):
    return debias.debias(neighbors(v), 9, mode="cap").select("test_id", "neighbor_rank", "neighbor_id")


@query("h5_debias_report", "SELECT count(*) AS n_items, count(*) FILTER (a < 9) AS n_debiased, count(*) FILTER (a = 0) AS n_zero_shot FROM (SELECT test_id, count(*) FILTER (NOT (gate AND neighbor_label = 'bug')) AS a FROM {gated} WHERE neighbor_rank < 9 GROUP BY 1)")
def _(v):
    n = neighbors(v)
    return debias.debias_report(n, debias.debias(n, 9, 2), 9)


# --- I: scores -----------------------------------------------------------------------


@query("i1_i5_evaluate_strict", "SELECT * FROM {runs}")
def _(v):
    return run_scores(v)


VIEWS["valid_runs"] = eval_sql("{pred_grid}", RUN, valid=True)


@query("i2_evaluate_valid", "SELECT * FROM {valid_runs}")
def _(v):
    return score.evaluate_valid(v("pred_grid"), runs.RUN)


@query("i2_evaluate_valid_percent", "SELECT r.* EXCLUDE (invalid_rate), round(100.0 * r.invalid_count / n.n, 2)::DOUBLE AS invalid_rate FROM {valid_runs} r JOIN (SELECT " + RUN + ", count(*) AS n FROM {pred_grid} GROUP BY ALL) n USING (" + RUN + ")")
def _(v):
    return score.evaluate_valid(v("pred_grid"), runs.RUN, percent=True)


@query("i3_confusion", "SELECT model, approach, ground_truth AS truth, " + ", ".join(f"count(*) FILTER (predicted_label = '{x}') AS n_{x}" for x in (*LABELS, "invalid")) + ", count(*) AS support, round(CAST(count(*) FILTER (predicted_label = ground_truth) AS DOUBLE) / count(*), 4) AS recall FROM {pred_grid} GROUP BY 1, 2, 3")
def _(v):
    return score.confusion(v("pred_grid"), ["model", "approach"])


@query("i4_class_report", " UNION ALL ".join(f"SELECT {RUN}, '{x}' AS label, precision_{x} AS precision, recall_{x} AS recall, f1_{x} AS f1, support_{x} AS support FROM {{runs}}" for x in LABELS))
def _(v):
    return score.class_report(run_scores(v), runs.RUN)


@query("i6_convention_gap", f"SELECT {RUN}, s.f1_macro AS f1_strict, v.f1_macro AS f1_valid, round(s.f1_macro - v.f1_macro, 4) AS f1_gap, round(s.accuracy - v.accuracy, 4) AS accuracy_gap FROM {{runs}} s JOIN {{valid_runs}} v USING ({RUN})")
def _(v):
    return score.convention_gap(v("pred_grid"), runs.RUN)


# --- F: prompts and training texts ---------------------------------------------------

_ITEM = "concat('Title: ', {t}, chr(10), 'Body: ', {b})"


def item(t: str = "title", b: str = "body") -> str:
    return _ITEM.replace("{t}", t).replace("{b}", b)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


VIEWS["few"] = """SELECT test_id, q.title AS test_title, q.body AS test_body, neighbor_rank, p.title AS neighbor_title, p.body AS neighbor_body, neighbor_label
    FROM {neighbors} n JOIN {issues_all} q ON q.item_id = test_id JOIN {issues_all} p ON p.item_id = neighbor_id WHERE neighbor_rank < 3"""


def few(v: View) -> DataFrame:
    s = split_vec(v)
    n = retrieve.knn_join(s.where("split = 'test'"), s.where("split = 'train'"), 3)
    lab = v("vec_items").select(F.col("item_id").alias("neighbor_id"), F.col("labels").alias("neighbor_label"))
    i = v("issues_all")
    return retrieve.enrich_neighbors(n, i, i, ("title", "body")).join(lab, "neighbor_id")


@query("f1_prompt_label", f"SELECT item_id, CASE WHEN l IN ('bug', 'feature', 'question') THEN l ELSE 'bug' END AS label FROM (SELECT item_id, {canon('raw_output')} AS l FROM {{raw_outputs}})")
def _(v):
    return v("raw_outputs").select("item_id", prompts.prompt_label("raw_output").alias("label"))


@query("f2_f3_token_counts", f"SELECT item_id, {ntok('title')} AS title_tokens, {ntok('body')} AS body_tokens, {ntok(item())} AS item_tokens FROM {{issues_all}}")
def _(v):
    return prompts.token_counts(v("issues_all")).select("item_id", "title_tokens", "body_tokens", "item_tokens")


@query("f4_budget", f"SELECT item_id, CAST(greatest(100, 2048 - 50 - 20 - ({ntok('body')} + 50)) AS BIGINT) AS budget FROM {{issues_all}}")
def _(v):
    return v("issues_all").select("item_id", prompts.budget(2048, 50, n_tokens("body")).alias("budget"))


_BUDGET = 900


def _cut(c: str, n: str) -> str:
    return f"CASE WHEN {ntok(c)} > {n} THEN concat(regexp_replace(array_to_string(regexp_extract_all({c}, '{TOKEN}')[1:greatest({n}, 0)], ''), '\\s+$', ''), '...') ELSE {c} END"


VIEWS["fits"] = f"""SELECT *, original > {_BUDGET} AS truncated, {_BUDGET} - {int(_BUDGET * 0.3)} - nt AS room FROM (
    SELECT test_id, test_title AS title, test_body AS body, {ntok(item('test_title', 'test_body'))} AS q, {ntok('test_title')} AS qt,
    {ntok(item('test_title', 'test_body'))} + CAST(sum(n) AS BIGINT) AS original, CAST(sum(t) AS BIGINT) AS nt, CAST(sum(b) AS BIGINT) AS nb FROM (
    SELECT *, {ntok('neighbor_title')} AS t, {ntok('neighbor_body')} AS b, {ntok(item('neighbor_title', 'neighbor_body'))} AS n FROM {{few}}) GROUP BY test_id, test_title, test_body)"""
VIEWS["cut_near"] = f"""SELECT test_id, neighbor_rank, neighbor_title AS title, neighbor_label AS label,
    CASE WHEN nbt AND b > most THEN {_cut('neighbor_body', 'most')} ELSE neighbor_body END AS body,
    CASE WHEN nbt THEN t + least(b, most) ELSE n END AS n, nbt FROM (
    SELECT *, CASE WHEN room <= 0 THEN 5 ELSE greatest(5, CAST(floor(room * (CAST(b AS DOUBLE) / greatest(nb, 1))) AS BIGINT)) END AS most FROM (
    SELECT f.*, x.room, x.nb, x.truncated AND (x.room <= 0 OR x.nb > x.room) AS nbt, {ntok('neighbor_title')} AS t, {ntok('neighbor_body')} AS b, {ntok(item('neighbor_title', 'neighbor_body'))} AS n
    FROM {{few}} f JOIN {{fits}} x USING (test_id)))"""
VIEWS["cut_all"] = f"""SELECT *, CASE WHEN qcut THEN {ntok(item('title', 'body'))} ELSE q END + nn AS final FROM (
    SELECT test_id, q, nn, original, truncated, nbt, qcut,
    CASE WHEN qcut AND bb <= 10 THEN {_cut('title', 'tb')} ELSE title END AS title,
    CASE WHEN qcut THEN {_cut('body', 'mb')} ELSE body END AS body FROM (
    SELECT *, CASE WHEN bb > 10 THEN bb ELSE greatest(5, rest - tb) END AS mb FROM (
    SELECT *, rest - qt AS bb, greatest(5, CAST(floor(rest * 0.4::DOUBLE) AS BIGINT)) AS tb, truncated AND q > rest AND rest > 0 AS qcut FROM (
    SELECT x.*, s.nn, s.nbt, {_BUDGET} - s.nn AS rest FROM {{fits}} x JOIN (SELECT test_id, CAST(sum(n) AS BIGINT) AS nn, bool_or(nbt) AS nbt FROM {{cut_near}} GROUP BY 1) s USING (test_id)))))"""


@query("f5_truncate_examples", "SELECT test_id, title, body, truncated, nbt AS neighbors_truncated, qcut AS query_truncated, original AS original_tokens, final AS final_tokens, original - final AS tokens_removed FROM {cut_all}")
def _(v):
    return prompts.truncate_examples(few(v), _BUDGET).drop("near")


VIEWS["shots"] = f"""SELECT c.test_id, concat({lit(prompts.HEADER)}, p.shown, {lit(prompts.TARGET)}, {item('c.title', 'c.body')}) AS prompt FROM {{cut_all}} c JOIN (
    SELECT test_id, string_agg(concat('--- Example ', neighbor_rank + 1, ' ---', chr(10), {item()}, chr(10), 'Answer: <label>', label, '</label>', chr(10), chr(10)), '' ORDER BY neighbor_rank) AS shown FROM {{cut_near}} GROUP BY 1) p USING (test_id)"""


@query("f6_build_prompt", "SELECT test_id, prompt FROM {shots}")
def _(v):
    return prompts.truncate_examples(few(v), _BUDGET).select("test_id", prompts.build_prompt().alias("prompt"))


@query("f7_to_messages", f"""SELECT item_id, CAST(to_json([struct_pack(role := 'system', content := {lit(prompts.SYSTEM_THINKING)}), struct_pack(role := 'user', content := {item()}), struct_pack(role := 'assistant', content := {lit(prompts.PREFILL)})]) AS VARCHAR) AS messages FROM {{issues_all}}""")
def _(v):
    d = v("issues_all").select("item_id", prompts.render_item("title", "body").alias("user"))
    return d.select("item_id", prompts.to_messages(F.col("user"), thinking=True, prefill=True).alias("messages"))


VIEWS["lengths"] = f"SELECT item_id % 4 AS k, item_id, {ntok(item())} AS n_prompt_tokens FROM {{issues_all}}"


def lengths(v: View) -> DataFrame:
    return v("issues_all").select((F.col("item_id") % 4).alias("k"), "item_id", n_tokens(prompts.render_item("title", "body")).alias("n_prompt_tokens"))


@query("f8_prompt_stats", "SELECT k, count(*) AS n, min(n_prompt_tokens) AS min_tokens, round(avg(n_prompt_tokens), 6) AS mean_tokens, " + ", ".join(f"CAST(floor(quantile_cont(n_prompt_tokens, {p})) AS BIGINT) AS p{round(p * 100)}" for p in (0.5, 0.75, 0.9, 0.95, 0.99)) + ", max(n_prompt_tokens) AS max_tokens FROM {lengths} GROUP BY 1")
def _(v):
    return prompts.prompt_stats(lengths(v), ["k"])


@query("f9_window_fit", 'SELECT k, w AS "window", round(avg(CASE WHEN n_prompt_tokens >= w THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS share_over, round(1 - avg(CASE WHEN n_prompt_tokens >= w THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS share_fit FROM {lengths} CROSS JOIN (SELECT unnest([128, 512, 2048]) AS w) GROUP BY 1, 2')
def _(v):
    return prompts.window_fit(lengths(v), ["k"], windows=(128, 512, 2048))


_MAX = 600
VIEWS["cut_item"] = f"""SELECT item_id, labels, truncated, CASE WHEN truncated THEN concat(array_to_string(regexp_extract_all(item, '{TOKEN}')[1:most], ''), chr(10), '...[TRUNCATED]') ELSE item END AS item FROM (
    SELECT *, {ntok('item')} > most AS truncated FROM (SELECT item_id, labels, {item()} AS item, {_MAX} - 30 - {ntok(lit(prompts.TRAIN.replace('{}', '')))} AS most FROM {{issues_all}}))"""


def _filled(template: str, *values: str) -> str:
    parts = template.split("{}")
    return "concat(" + ", ".join([lit(parts[0])] + [x for v, p in zip(values, parts[1:]) for x in (v, lit(p))]) + ")"


@query("f10_sft_rows", f"SELECT item_id, concat({_filled(prompts.TRAIN, 'item', 'labels')}, '{prompts.EOS}') AS text, truncated FROM {{cut_item}}")
def _(v):
    return prompts.sft_rows(v("issues_all"), _MAX)


@query("f11_sft_rows_legacy", f"SELECT item_id, concat({_filled(prompts.TRAIN_LEGACY, item(), lit(prompts.THOUGHT), 'labels')}, '{prompts.EOS}') AS text, false AS truncated FROM {{issues_all}}")
def _(v):
    return prompts.sft_rows(v("issues_all"), style="legacy")


_LEGACY_ASK = _filled(prompts.ASK_LEGACY, _filled(prompts.ASK_ITEM, "concat(title, ' ', chr(10), ' ', body)"))


@query("f11_inference_rows_legacy", f"SELECT item_id, {_LEGACY_ASK} AS prompt, false AS truncated FROM {{issues_all}}")
def _(v):
    return prompts.inference_rows(v("issues_all"), style="legacy")


@query("f12_inference_rows", f"SELECT item_id, regexp_replace({_filled(prompts.TRAIN, 'item', lit(''))}, '\\s+$', '') AS prompt, truncated FROM {{cut_item}}")
def _(v):
    return prompts.inference_rows(v("issues_all"), _MAX)


@query("f13_paired_prompts", f"SELECT item_id, c AS continuation, concat({lit(prompts.SYSTEM)}, chr(10), chr(10), {item()}, chr(10), '<label>', c) AS prompt FROM {{issues_all}} CROSS JOIN (VALUES ('bug'), ('question')) t(c)")
def _(v):
    return prompts.paired_prompts(v("issues_all"))


@query("f14_truncation_report", "SELECT test_id % 5 AS run, count(*) AS n, count(*) FILTER (truncated) AS n_truncated, count(*) FILTER (nbt) AS n_neighbors_truncated, count(*) FILTER (qcut) AS n_query_truncated, CAST(sum(original - final) AS BIGINT) AS tokens_removed FROM {cut_all} GROUP BY 1")
def _(v):
    return prompts.truncation_report(prompts.truncate_examples(few(v), _BUDGET).withColumn("run", F.col("test_id") % 5), ["run"])


# --- J: runs -------------------------------------------------------------------------


def costs(v: View) -> DataFrame:
    return v("cost_runs")


@query("j1_cost_rollup", f"SELECT {RUN}, count(*) AS total_issues, CAST(sum(prompt_tokens) AS BIGINT) AS total_prompt_tokens, round(avg(prompt_tokens), 6) AS avg_prompt_tokens, min(prompt_tokens) AS min_prompt_tokens, max(prompt_tokens) AS max_prompt_tokens, CAST(sum(generated_tokens) AS BIGINT) AS total_generated_tokens, round(avg(generated_tokens), 6) AS avg_generated_tokens, any_value(gpu_peak_memory_mb) AS gpu_peak_memory_mb, any_value(wall_time_s) AS wall_time_s, any_value(training_time_s) AS training_time_s, round(count(*) / any_value(wall_time_s), 6) AS issues_per_second FROM {{pred_grid}} JOIN {{cost_runs}} USING ({RUN}) GROUP BY {RUN}")
def _(v):
    return runs.throughput(runs.cost_rollup(v("pred_grid")), costs(v))


@query("j2_unify_runs", f"SELECT {RUN}, f1_macro, row_number() OVER (ORDER BY {FIRST}) - 1 AS ordinal FROM {{runs}}")
def _(v):
    r = run_scores(v).select(*runs.RUN, "f1_macro")
    return runs.unify_runs(r.unionByName(r))


@query("j3_best_configs", "SELECT model, approach, context_window, top_k, f1_macro, invalid_rate FROM {best_runs}")
def _(v):
    return runs.best_configs(run_scores(v))


VIEWS["best_few"] = best_sql("approach = 'few_shot' AND top_k > 0", "model")


@query("j4_zero_shot_gain", "SELECT *, round(avg(gain) OVER (), 6) AS mean_gain FROM (SELECT b.model, z.f1_macro AS f1_zero, b.f1_macro AS f1_best, b.top_k, b.context_window, round(b.f1_macro - z.f1_macro, 4) AS gain FROM {best_few} b JOIN {runs} z ON z.model = b.model AND z.approach = 'few_shot' AND z.top_k = 0 AND z.context_window = 2048)")
def _(v):
    return runs.zero_shot_gain(run_scores(v))


@query("j5_heatmap", "SELECT model, top_k, " + ", ".join(f"round(max(f1) FILTER (context_window = {c}), 4) AS ctx_{c}" for c in CONTEXTS) + ", CAST(sum(CASE WHEN abs(f1 - best) < 0.0001 THEN 1 ELSE 0 END) AS BIGINT) AS n_best_cells FROM (SELECT model, top_k, context_window, f1_macro AS f1, max(f1_macro) OVER (PARTITION BY model) AS best FROM {runs} WHERE approach = 'few_shot') GROUP BY 1, 2")
def _(v):
    return runs.heatmap(run_scores(v), list(CONTEXTS))


@query("j6_invalid_heatmap", "SELECT context_window, top_k, round(avg(invalid_rate), 6) AS mean_invalid_rate, count(*) FILTER (invalid_rate >= 0.1) AS n_flagged, count(*) AS n_models FROM {runs} WHERE approach = 'few_shot' GROUP BY 1, 2")
def _(v):
    return runs.invalid_heatmap(run_scores(v), [0, *KS])


@query("j6_invalid_rollup", "SELECT model, round(avg(invalid_rate), 6) AS mean_invalid_rate FROM {runs} WHERE approach = 'few_shot' GROUP BY ROLLUP (model)")
def _(v):
    return runs.invalid_rollup(run_scores(v))


VIEWS["performance"] = f"SELECT b.*, gpu_peak_memory_mb, wall_time_s + coalesce(training_time_s, 0) AS total_time_s FROM {{best_runs}} b LEFT JOIN {{cost_runs}} c USING ({RUN})"


@query("j7_cost_performance", "SELECT p.model, p.approach, p.context_window, p.top_k, p.f1_macro, p.total_time_s, p.gpu_peak_memory_mb, round(coalesce(p.gpu_peak_memory_mb / nullif(t.gpu_peak_memory_mb, 0), 0), 6) AS memory_share FROM {performance} p LEFT JOIN {performance} t ON t.model = p.model AND t.approach = 'fine_tune'")
def _(v):
    return runs.cost_performance(run_scores(v), costs(v))


@query("j8_time_ratio", "SELECT f.model, round(f.total_time_s / t.total_time_s, 6) AS time_ratio, f.total_time_s < t.total_time_s AS is_faster FROM {performance} f JOIN {performance} t USING (model) WHERE f.approach = 'few_shot' AND t.approach = 'fine_tune'")
def _(v):
    return runs.time_ratio(runs.cost_performance(run_scores(v), costs(v)))


@query("j9_marginal_value", "SELECT model, f1_macro, f AS f1_floor, round(f1_macro - f, 4) AS delta, round((f1_macro - f) / f * 100, 4) AS delta_pct FROM (SELECT model, max(f1_macro) AS f1_macro FROM {runs} WHERE approach = 'few_shot' GROUP BY 1) CROSS JOIN (SELECT max(f1_macro) AS f FROM {runs} WHERE approach = 'vote')")
def _(v):
    return runs.marginal_value(run_scores(v))


@query("j10_scaling_steps", "SELECT model, approach, size, f1_macro, round(f1_macro - lag(f1_macro) OVER (PARTITION BY approach ORDER BY size), 4) AS step_gain, CASE WHEN f1_macro > o THEN 'beats' WHEN f1_macro < o THEN 'trails' ELSE 'equals' END AS vs_tuned FROM (SELECT *, CASE model WHEN 'model-3b' THEN 3 WHEN 'model-8b' THEN 8 WHEN 'model-14b' THEN 14 WHEN 'model-32b' THEN 32 END AS size, max(f1_macro) FILTER (approach = 'fine_tune') OVER (PARTITION BY model) AS o FROM {best_runs} WHERE approach <> 'vote')")
def _(v):
    return runs.scaling_steps(run_scores(v))


@query("j11_best_by_context", "SELECT model, arg_max(context_window, f1_macro * 100000 - context_window / 1000000.0) AS best_context, arg_min(context_window, f1_macro * 100000 + context_window / 1000000.0) AS worst_context, round(max(f1_macro) - min(f1_macro), 4) AS spread FROM {best_ctx} GROUP BY 1")
def _(v):
    return runs.best_by_context(run_scores(v))


@query("j12_delta_by_context", "SELECT model, context_window, top_k, round(f1_macro - t, 4) AS delta FROM {best_ctx} JOIN (SELECT model, max(f1_macro) AS t FROM {runs} WHERE approach = 'fine_tune' GROUP BY 1) USING (model)")
def _(v):
    return runs.delta_by_context(run_scores(v))


VIEWS["ctx_cost"] = f"SELECT model, context_window, top_k, f1_macro, wall_time_s, gpu_peak_memory_mb FROM {{best_ctx}} LEFT JOIN {{cost_runs}} USING ({RUN})"


@query("j13_cost_by_context", "SELECT * FROM {ctx_cost}")
def _(v):
    return runs.cost_by_context(run_scores(v), costs(v))


@query("j14_marginal_returns", "SELECT * EXCLUDE (n) FROM (SELECT model, lag(context_window) OVER w AS from_context, context_window, round(f1_macro - lag(f1_macro) OVER w, 4) AS d_f1, round(gpu_peak_memory_mb - lag(gpu_peak_memory_mb) OVER w, 4) AS d_memory_mb, round(wall_time_s - lag(wall_time_s) OVER w, 4) AS d_time_s, count(*) OVER (PARTITION BY model) AS n FROM {ctx_cost} WINDOW w AS (PARTITION BY model ORDER BY context_window)) WHERE n >= 3 AND from_context IS NOT NULL")
def _(v):
    return runs.marginal_returns(run_scores(v), costs(v))


@query("j15_time_by_context", 'SELECT c.model, c.context_window, round(c.wall_time_s / t.total_time_s, 6) AS time_ratio, c.wall_time_s / t.total_time_s <= 1.0 AS "within" FROM {ctx_cost} c JOIN {performance} t ON t.model = c.model AND t.approach = \'fine_tune\'')
def _(v):
    return runs.time_by_context(run_scores(v), costs(v))


@query("j16_summary_configs", f"SELECT 'by_model' AS kind, model, approach, context_window, top_k, f1_macro FROM {{best_runs}} UNION ALL SELECT 'overall', model, approach, context_window, top_k, f1_macro FROM (SELECT * FROM {{runs}} ORDER BY f1_macro DESC, {FIRST} LIMIT 1)")
def _(v):
    return runs.summary_configs(run_scores(v))


@query("j17_pareto", f"SELECT {RUN}, f1_macro, gpu_peak_memory_mb FROM (SELECT *, max(f1_macro) OVER (ORDER BY gpu_peak_memory_mb ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT * FROM {{runs}} JOIN {{cost_runs}} USING ({RUN}) QUALIFY row_number() OVER (PARTITION BY gpu_peak_memory_mb ORDER BY f1_macro DESC, {FIRST}) = 1)) WHERE b IS NULL OR f1_macro > b")
def _(v):
    return runs.pareto(run_scores(v), costs(v))


VIEWS["seed_runs"] = "SELECT CASE WHEN approach = 'vote' THEN 'random' ELSE concat(approach, '-', model) END AS arm, top_k AS seed, f1_macro FROM {runs} WHERE approach IN ('vote', 'few_shot') AND context_window IN (0, 2048)"


@query("j18_seed_ablation", "SELECT arm, f1_mean, f1_std, n_seeds, round(f1_mean - (max(f1_mean) FILTER (arm = 'random') OVER ()), 6) AS over_random FROM (SELECT arm, round(avg(f1_macro), 6) AS f1_mean, round(stddev_samp(f1_macro), 6) AS f1_std, count(*) AS n_seeds FROM {seed_runs} GROUP BY 1)")
def _(v):
    r = run_scores(v).where("approach in ('vote', 'few_shot') and context_window in (0, 2048)")
    arm = F.when(F.col("approach") == "vote", "random").otherwise(F.concat("approach", F.lit("-"), "model"))
    return runs.seed_ablation(r.select(arm.alias("arm"), F.col("top_k").alias("seed"), "f1_macro"))


VIEWS["pool_table"] = "SELECT model, context_window AS pool_size, approach, max(f1_macro) AS f1_macro FROM {runs} WHERE approach <> 'vote' GROUP BY 1, 2, 3"


@query("j19_crossover", "SELECT model, min(pool_size) FILTER (stays) AS crossover_size, count(*) AS n_sizes FROM (SELECT *, bool_and(tuned >= few) OVER (PARTITION BY model ORDER BY pool_size DESC) AS stays FROM (SELECT model, pool_size, max(f1_macro) FILTER (approach = 'few_shot') AS few, max(f1_macro) FILTER (approach = 'fine_tune') AS tuned FROM {pool_table} GROUP BY 1, 2)) GROUP BY 1")
def _(v):
    t = run_scores(v).where("approach <> 'vote'").groupBy("model", F.col("context_window").alias("pool_size"), "approach").agg(F.max("f1_macro").alias("f1_macro"))
    return runs.crossover(t)


VIEWS["sweep"] = "SELECT context_window AS layer, CASE top_k WHEN 0 THEN -1 ELSE top_k END AS multiplier, f1_macro FROM {runs} WHERE approach = 'few_shot' AND model = 'model-8b'"


@query("j20_sweep_winner", "SELECT layer, multiplier, f1_macro FROM {sweep} WHERE layer = (SELECT layer FROM {sweep} WHERE multiplier = -1 ORDER BY f1_macro DESC, layer LIMIT 1) ORDER BY f1_macro DESC, layer, multiplier LIMIT 1")
def _(v):
    r = run_scores(v).where("approach = 'few_shot' and model = 'model-8b'")
    return runs.sweep_winner(r.select(F.col("context_window").alias("layer"), F.when(F.col("top_k") == 0, -1).otherwise(F.col("top_k")).alias("multiplier"), "f1_macro"))


VIEWS["vote_runs"] = eval_sql("{votes}", "scheme, k")


@query("j21_ablation_table", "SELECT scheme, " + ", ".join(f"max(f1_macro) FILTER (k = {k}) AS k_{k}" for k in VOTE_KS) + ", arg_max(k, f1_macro * 100000 - k / 1000000.0) AS best_k, max(f1_macro) AS best_f1 FROM {vote_runs} GROUP BY 1")
def _(v):
    return runs.ablation_table(score.evaluate_strict(votes(v), ["scheme", "k"]), "scheme", VOTE_KS)


#: Two groups of runs that together are all runs.
_SMALL = "model IN ('model-3b', 'model-8b')"


def _gap_side(small: bool) -> str:
    return eval_sql(f"(SELECT 'x' AS side, * FROM {{pred_grid}} WHERE {'' if small else 'NOT '}{_SMALL})", "side")


@query("j22_dataset_gap", f"SELECT label, f1_a, f1_b, delta, round(coalesce(delta / nullif(sum(delta) OVER (), 0), 0), 4) AS gap_share FROM (SELECT *, round(f1_b - f1_a, 4) AS delta FROM (" + " UNION ALL ".join(f"SELECT '{x}' AS label, a.f1_{x} AS f1_a, b.f1_{x} AS f1_b FROM ({_gap_side(True)}) a, ({_gap_side(False)}) b" for x in LABELS) + "))")
def _(v):
    p = v("pred_grid").withColumn("side", F.lit("x"))
    a = score.evaluate_strict(p.where(_SMALL), ["side"])
    return runs.dataset_gap(a, score.evaluate_strict(p.where(f"not {_SMALL}"), ["side"]))


@query("j23_short_names", f"SELECT {RUN}, CASE model WHEN 'model-3b' THEN '3B' WHEN 'model-8b' THEN '8B' WHEN 'model-14b' THEN '14B' WHEN 'model-32b' THEN '32B' WHEN 'vote-similarity' THEN 'vote' ELSE model END AS short_name FROM {{runs}}")
def _(v):
    return runs.short_names(run_scores(v)).select(*runs.RUN, "short_name")


@query("j24_timing_rollup", "SELECT stage, approach, round(sum(seconds), 4) AS seconds, count(*) AS n FROM (SELECT CASE WHEN top_k < 0 THEN 'train' ELSE 'infer' END AS stage, approach, CAST(prompt_tokens AS DOUBLE) / 8 AS seconds FROM {pred_grid}) GROUP BY 1, 2")
def _(v):
    t = v("pred_grid").select(F.when(F.col("top_k") < 0, "train").otherwise("infer").alias("stage"), F.lit("d").alias("dataset"), "model", "approach", (F.col("prompt_tokens").cast("double") / 8).alias("seconds"))
    return runs.timing_rollup(t)


VIEWS["variants"] = "SELECT model, concat('k', top_k) AS variant, f1_macro FROM {valid_runs} WHERE approach = 'few_shot' AND context_window = 4096"


@query("j25_compare_variants", "SELECT v.model, v.variant, v.f1_macro, round(v.f1_macro - b.f1_macro, 4) AS delta, v.variant = w.variant AS is_best FROM {variants} v LEFT JOIN {variants} b ON b.model = v.model AND b.variant = 'k0' JOIN (SELECT model, variant FROM {variants} QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1_macro DESC, variant DESC) = 1) w ON w.model = v.model")
def _(v):
    s = score.evaluate_valid(v("pred_grid").where("approach = 'few_shot' and context_window = 4096"), runs.RUN)
    return runs.compare_variants(s.select("model", F.concat(F.lit("k"), F.col("top_k").cast("string")).alias("variant"), "f1_macro"), "k0")


@query("j26_k_study", "SELECT model, CASE WHEN approach = 'few_shot' THEN top_k END AS top_k, f1_macro FROM {valid_runs} WHERE approach IN ('few_shot', 'fine_tune') AND context_window = 4096")
def _(v):
    return runs.k_study(score.evaluate_valid(v("pred_grid"), runs.RUN), 4096)


# --- K: error analysis ---------------------------------------------------------------


@query("k1_neighbor_mix", "SELECT CASE WHEN ground_truth = predicted_label THEN concat('right_', ground_truth) ELSE concat(ground_truth, '_as_', predicted_label) END AS outcome, count(*) AS n, " + ", ".join(f"round(avg(c_{x}), 6) AS mean_{x}, CAST(quantile_cont(c_{x}, 0.5) AS DOUBLE) AS median_{x}" for x in LABELS) + " FROM {preds9} JOIN {mix} USING (item_id) GROUP BY 1")
def _(v):
    return errors.neighbor_mix(*preds_and_mix(v))


_OWN = "CASE ground_truth WHEN 'bug' THEN c_bug WHEN 'feature' THEN c_feature ELSE c_question END"
_OTHER = "CASE predicted_label WHEN 'bug' THEN c_bug WHEN 'feature' THEN c_feature ELSE c_question END"


@query("k2_neighbor_histogram", f"SELECT n_same, n_errors, round(coalesce(CAST(n_errors AS DOUBLE) / nullif(sum(n_errors) OVER (), 0), 0) * 100, 4) AS pct FROM (SELECT b AS n_same, count(own) AS n_errors FROM (SELECT unnest(range(10)) AS b) LEFT JOIN (SELECT {_OWN} AS own FROM {{preds9}} JOIN {{mix}} USING (item_id) WHERE ground_truth <> predicted_label) ON own = b GROUP BY 1)")
def _(v):
    return errors.neighbor_histogram(*preds_and_mix(v), 9)


@query("k3_k4_signal_ignored", f"SELECT ground_truth, predicted_label, count(*) AS n_errors, round(avg(CASE WHEN {_OWN} >= {_OTHER} THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS ignored_rate FROM {{preds9}} JOIN {{mix}} USING (item_id) WHERE ground_truth <> predicted_label GROUP BY 1, 2")
def _(v):
    return errors.signal_ignored(*preds_and_mix(v))


@query("k5_contingency", "SELECT count(*) FILTER (a AND b) AS both_right, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS both_wrong FROM (SELECT pred_a = ground_truth AS a, pred_b = ground_truth AS b FROM {pair_preds})")
def _(v):
    return errors.contingency(v("pair_preds"))


@query("k6_recall_delta", " UNION ALL ".join(f"SELECT a.model, '{x}' AS label, round(a.recall_{x} - b.recall_{x}, 4) AS delta FROM {{best_runs}} a JOIN {{best_runs}} b USING (model) WHERE a.approach = 'few_shot' AND b.approach = 'fine_tune'" for x in LABELS))
def _(v):
    r = run_scores(v)
    best = runs.best_configs(r).select(*runs.RUN)
    return errors.recall_delta(r.join(best, runs.RUN), "few_shot", "fine_tune")


@query("k7_universal_errors", "SELECT item_id, ground_truth FROM {pred_grid} WHERE approach = 'few_shot' AND context_window = 8192 AND top_k = 3 GROUP BY 1, 2 HAVING bool_and(predicted_label <> ground_truth)")
def _(v):
    return errors.universal_errors(v("pred_grid").where("approach = 'few_shot' and context_window = 8192 and top_k = 3"))


@query("k8_error_by_similarity", "SELECT CAST(floor(similarity * 10) AS BIGINT) AS band, count(*) AS n, round(avg(CASE WHEN p.ground_truth <> p.predicted_label THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS error_rate FROM {preds9} p JOIN {neighbors} n ON n.test_id = p.item_id AND n.neighbor_rank = 0 GROUP BY 1")
def _(v):
    near = sources.stored(neighbors(v))
    return errors.error_by_similarity(predictions(near), near)


@query("k9_error_samples", "SELECT item_id, ground_truth, predicted_label, c_bug, c_feature, c_question FROM {preds9} JOIN {mix} USING (item_id) WHERE ground_truth <> predicted_label QUALIFY row_number() OVER (PARTITION BY ground_truth, predicted_label ORDER BY item_id) <= 3")
def _(v):
    return errors.error_samples(*preds_and_mix(v), 3)


# --- L: calibration and ensembles ----------------------------------------------------

_ORDER = "CASE label WHEN 'bug' THEN 1 WHEN 'feature' THEN 2 ELSE 3 END"


def _argmax_sql(src: str, by: str, s: str) -> str:
    return f"SELECT {by} item_id, ground_truth, label AS predicted_label FROM ({src}) QUALIFY row_number() OVER (PARTITION BY {by} item_id ORDER BY {s} DESC, {_ORDER}) = 1"


def _calibrated_sql(src: str, by: str) -> str:
    return _argmax_sql(f"SELECT *, round(p - avg(p) OVER (PARTITION BY {by} label) + 1.0::DOUBLE / 3, 12) AS c FROM (SELECT *, e / sum(e) OVER (PARTITION BY {by} item_id) AS p FROM (SELECT *, exp(score - max(score) OVER (PARTITION BY {by} item_id)) AS e FROM ({src})))", by, "c")


_CONTRAST = "SELECT alpha, item_id, ground_truth, label, round(score_a - alpha * score_b, 9) AS score FROM {class_scores} CROSS JOIN (SELECT unnest([0.5::DOUBLE, 0.75, 1.0]) AS alpha)"
ALPHAS = [0.5, 0.75, 1.0]


def _scores(v: View, s: str) -> DataFrame:
    return v("class_scores").select("item_id", "ground_truth", "label", F.col(s).cast("double").alias("score"))


@query("l1_batch_calibrate", _calibrated_sql("SELECT item_id % 2 AS run, item_id, ground_truth, label, CAST(score_a AS DOUBLE) AS score FROM {class_scores}", "run,"))
def _(v):
    return calibrate.batch_calibrate(_scores(v, "score_a").withColumn("run", F.col("item_id") % 2), ["run"])


@query("l2_contrast", _argmax_sql(_CONTRAST, "alpha,", "score"))
def _(v):
    return calibrate.contrast(_scores(v, "score_a"), _scores(v, "score_b"), ALPHAS)


@query("l3_calibrated_contrast", _calibrated_sql(_CONTRAST, "alpha,"))
def _(v):
    return calibrate.calibrated_contrast(_scores(v, "score_a"), _scores(v, "score_b"), ALPHAS)


VIEWS["margins"] = "SELECT item_id, list_sort([c_bug, c_feature, c_question], 'DESC')[1] - list_sort([c_bug, c_feature, c_question], 'DESC')[2] AS margin FROM {mix}"


@query("l4_override", "SELECT item_id, ground_truth, CASE WHEN pred_a <> pred_b AND margin > 2 AND pred_b = 'question' THEN pred_b ELSE pred_a END AS predicted_label FROM {pair_preds} JOIN {margins} USING (item_id)")
def _(v):
    return calibrate.override(v("pair_preds"), calibrate.margin_of(neighbors(v), 9), 2, question_only=True)


@query("l5_pair_winner", "SELECT p.item_id, p.ground_truth, CASE WHEN rb > ra THEN p.pred_b ELSE p.pred_a END AS predicted_label FROM {pair_preds} p LEFT JOIN (SELECT pred_a, pred_b, count(*) FILTER (pred_a = ground_truth) AS ra, count(*) FILTER (pred_b = ground_truth) AS rb FROM {pair_preds} WHERE pred_a <> pred_b GROUP BY 1, 2) s USING (pred_a, pred_b)")
def _(v):
    return calibrate.pair_winner(v("pair_preds"))


@query("l6_agreement", "SELECT count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS {n}" for c, n in (("pred_a = pred_b", "agreement"), ("pred_a = ground_truth OR pred_b = ground_truth", "oracle_accuracy"), ("pred_a = ground_truth", "accuracy_a"), ("pred_b = ground_truth", "accuracy_b"))) + " FROM {pair_preds}")
def _(v):
    return calibrate.agreement(v("pair_preds"))


@query("l6_oracle_scores", eval_sql("(SELECT 'oracle' AS arm, ground_truth, CASE WHEN pred_b = ground_truth THEN pred_b ELSE pred_a END AS predicted_label FROM {pair_preds})", "arm"))
def _(v):
    return score.evaluate_strict(calibrate.oracle_labels(v("pair_preds")).withColumn("arm", F.lit("oracle")), ["arm"])


@query("l7_vote_prior", "SELECT item_id AS test_id, concat('{{\"bug\":', c_bug, ',\"feature\":', c_feature, ',\"question\":', c_question, '}}') AS prior FROM {mix}".replace("{{", "{").replace("}}", "}"))
def _(v):
    return calibrate.vote_prior(neighbors(v), 9)


# --- M: directions -------------------------------------------------------------------

VIEWS["mean_dir"] = """SELECT layer, list(x ORDER BY pos) AS vector FROM (SELECT layer, pos, max(m) FILTER (labels = 'bug') - max(m) FILTER (labels = 'question') AS x FROM (
    SELECT layer, labels, pos, round(avg(CAST(vector[pos] AS DOUBLE)), 12) AS m FROM {layers} CROSS JOIN (SELECT unnest(range(1, 17)) AS pos) GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1"""


def _flat(df: DataFrame, *by: str) -> DataFrame:
    return df.select(*by, F.posexplode("vector").alias("pos", "x")).select(*by, F.col("pos"), F.round("x", 6).alias("x"))


def _flat_sql(src: str, by: str) -> str:
    return f"SELECT {by}, CAST(pos - 1 AS INTEGER) AS pos, round(vector[pos], 6) AS x FROM ({src}) CROSS JOIN (SELECT unnest(range(1, 17)) AS pos)"


def bug_direction(v: View) -> DataFrame:
    return directions.mean_difference(layers(v), "bug", "question")


@query("m1_mean_difference", _flat_sql("SELECT * FROM {mean_dir}", "layer"))
def _(v):
    return _flat(bug_direction(v), "layer")


@query("m2_pair_difference", "SELECT layer, CAST(pos - 1 AS INTEGER) AS pos, round(avg(CAST(a.vector[pos] AS DOUBLE) - CAST(b.vector[pos] AS DOUBLE)), 6) AS x FROM {layers} a JOIN (SELECT a_id, b_id FROM (SELECT a.item_id AS a_id, b.item_id AS b_id, round(list_inner_product(a.v, b.v), 12) AS s FROM {unit} a CROSS JOIN {unit} b WHERE a.labels = 'bug' AND b.labels = 'question') QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY s DESC, b_id) = 1) p ON p.a_id = a.item_id JOIN {layers} b USING (layer) CROSS JOIN (SELECT unnest(range(1, 17)) AS pos) WHERE b.item_id = p.b_id GROUP BY 1, 2")
def _(v):
    return _flat(directions.pair_difference(layers(v), retrieve.match_pairs(v("vec_items"), "bug", "question")), "layer")


@query("m3_variant_difference", "SELECT a.layer, CAST(pos - 1 AS INTEGER) AS pos, round(avg(CAST(a.vector[pos] AS DOUBLE) - CAST(b.vector[pos] AS DOUBLE) / 2), 6) AS x FROM {layers} a JOIN {layers} b USING (layer, item_id) CROSS JOIN (SELECT unnest(range(1, 17)) AS pos) GROUP BY 1, 2")
def _(v):
    d = layers(v).select("layer", "item_id", F.col("vector").cast("array<double>").alias("vector"))
    half = d.withColumn("vector", F.transform("vector", lambda x: x / 2)).withColumn("variant", F.lit("half"))
    return _flat(directions.variant_difference(d.withColumn("variant", F.lit("whole")).unionByName(half), "whole", "half"), "layer")


@query("m4_layer_norms", "SELECT layer, round(sqrt(list_inner_product(vector, vector)), 4) AS l2_norm FROM {mean_dir}")
def _(v):
    return directions.layer_norms(bug_direction(v))


@query("m5_shift_vectors", "SELECT item_id, l.layer, CAST(pos - 1 AS INTEGER) AS pos, round(CAST(l.vector[pos] AS DOUBLE) + CASE WHEN l.layer IN (1, 3) THEN -1.5 * d.vector[pos] ELSE 0 END, 6) AS x FROM {layers} l JOIN {mean_dir} d USING (layer) CROSS JOIN (SELECT unnest(range(1, 17)) AS pos)")
def _(v):
    return _flat(directions.shift_vectors(layers(v), bug_direction(v), -1.5, [1, 3]), "item_id", "layer")


@query("m6_remove_direction", "SELECT item_id, layer, CAST(pos - 1 AS INTEGER) AS pos, round(x[pos] - list_inner_product(x, r) * r[pos], 6) AS x FROM (SELECT item_id, layer, CAST(l.vector AS DOUBLE[]) AS x, [y / n FOR y IN d.vector] AS r FROM {layers} l JOIN (SELECT *, sqrt(list_inner_product(vector, vector)) AS n FROM {mean_dir}) d USING (layer)) CROSS JOIN (SELECT unnest(range(1, 17)) AS pos)")
def _(v):
    return _flat(directions.remove_direction(layers(v), bug_direction(v)), "item_id", "layer")
