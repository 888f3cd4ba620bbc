"""Few-shot prompts and training texts as dataset-building jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrow.functions import LABELS, canonical_label, cut_tokens, n_tokens
from marrow.operators.select import percentiles

# Prompt texts.
SYSTEM = """Classify the GitHub issue into exactly one category.

Rules:
1. Read the issue title and body.
2. Choose one label: bug, feature, or question.
3. Respond with ONLY the label wrapped in XML tags.
4. Do NOT write anything else. No explanation. No reasoning. No extra text.

Correct response format examples:
<label>bug</label>
<label>feature</label>
<label>question</label>"""
SYSTEM_THINKING = """Classify the GitHub issue into exactly one category.

Rules:
1. Read the issue title and body.
2. Choose one label: bug, feature, or question.
3. You may reason about your choice first.
4. You MUST end your response with the label in XML tags.

Correct format for your final answer:
<label>bug</label>"""
HEADER = "Here are some examples of correctly classified issues:\n\n"
TARGET = "Now, classify the following target issue:\n\n"
TRAIN = """Below is an instruction that describes a task, paired with an input that provides further context.
Write a response that appropriately completes the request.

### Instruction:
You are a GitHub issue classifier. Classify the following GitHub issue based on its title and description.
You must respond with exactly one word: 'bug', 'feature', or 'question'. Do not provide any other text.

### Issue:
{}

### Response:
{}"""
TRAIN_LEGACY = """Below is an instruction that describes a task, paired with an input that provides further context.
Write a response that appropriately completes the request.
Before answering, think carefully about the question and create a step-by-step chain of thoughts to ensure a logical and accurate response.

### Instruction:
You are a GitHub issue classifier that will classify GitHub issues based on their title and description as 'bug', 'feature', or 'question'.
'bug', 'feature', or 'question' is the label. And the labels are the only possible response.
Please classify the following GitHub issue.

### Question:
{}

### Response:{}{}"""
THOUGHT = "Analyzing the title and body to determine if it is a bug, feature request, or a general question: "
ASK_LEGACY = """Below is an instruction that describes a task, paired with an input that provides further context.
Write a response that appropriately completes the request.
Please classify the following GitHub issue as 'bug', 'feature', or 'question'. Only return the label.

### Question:
{}

### Response:
"""
ASK_ITEM = "Classify, IN ONLY 1 WORD, the following GitHub issue as 'feature', 'bug', or 'question' based on its title and body:\n{}"
EOS = "<|endoftext|>"
CUT_MARK = "\n...[TRUNCATED]"
PREFILL = "<label>"
#: Context windows that prompt lengths are held against.
WINDOWS = (2048, 4096, 8192, 16384)

Counter = Callable[[Column], Column]


def fill(template: str, *values: Column) -> Column:
    """The template with {} replaced in order."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for v, p in zip(values, parts[1:]):
        out += [v, F.lit(p)]
    return F.concat(*out)


def prompt_label(c: Column | str) -> Column:
    """A label for prompts: what isn't a class or a synonym becomes bug."""
    x = canonical_label(c)
    return F.when(x.isin(*LABELS), x).otherwise("bug")


def render_item(title: Column | str, body: Column | str) -> Column:
    t, b = (F.col(x) if isinstance(x, str) else x for x in (title, body))
    return F.concat(F.lit("Title: "), F.coalesce(t, F.lit("")), F.lit("\nBody: "), F.coalesce(b, F.lit("")))


def token_counts(df: DataFrame, count: Counter = n_tokens) -> DataFrame:
    return df.withColumn("title_tokens", count(F.col("title"))).withColumn("body_tokens", count(F.col("body"))).withColumn("item_tokens", count(render_item("title", "body")))


def budget(max_seq: int, max_new: int, system_tokens: Column | int) -> Column:
    """Tokens for content: at least 100."""
    s = F.lit(system_tokens) if isinstance(system_tokens, int) else system_tokens
    return F.greatest(F.lit(100), F.lit(max_seq - max_new - 20) - (s + 50)).cast("long")


def truncate_examples(nbrs: DataFrame, budget_tokens: Column | int, count: Counter = n_tokens) -> DataFrame:
    """One row per query with cut texts: test_id, title, body, near (rank, title, body, label) and truncation facts.

    ``nbrs`` has test_id, test_title, test_body, neighbor_rank, neighbor_title,
    neighbor_body, neighbor_label.  30 % of the budget is for the query; neighbour bodies
    share what titles leave, in proportion; whole numbers are cut off, not rounded.  After
    a cut a neighbour counts as title plus body, without the rendering around them.
    """
    bud = F.lit(budget_tokens).cast("long") if isinstance(budget_tokens, int) else budget_tokens
    near = F.struct(
        "neighbor_rank",
        F.coalesce("neighbor_title", F.lit("")).alias("title"),
        F.coalesce("neighbor_body", F.lit("")).alias("body"),
        prompt_label("neighbor_label").alias("label"),
        count(F.col("neighbor_title")).alias("t"),
        count(F.col("neighbor_body")).alias("b"),
        count(render_item("neighbor_title", "neighbor_body")).alias("n"),
    )
    q = nbrs.groupBy("test_id").agg(F.first("test_title").alias("title"), F.first("test_body").alias("body"), F.array_sort(F.collect_list(near)).alias("near"))
    total = lambda f: F.aggregate("near", F.lit(0).cast("long"), lambda acc, x: acc + x[f])
    q = q.withColumn("budget", bud).withColumn("q_tokens", count(render_item("title", "body"))).withColumn("q_title", count(F.col("title")))
    q = q.withColumn("original_tokens", F.col("q_tokens") + total("n")).withColumn("truncated", F.col("original_tokens") > F.col("budget"))
    q = q.withColumn("all_bodies", total("b")).withColumn("room", F.col("budget") - F.floor(F.col("budget") * 0.3).cast("long") - total("t"))
    some = F.col("truncated") & (F.col("room") > 0) & (F.col("all_bodies") > F.col("room"))
    none = F.col("truncated") & (F.col("room") <= 0)
    q = q.withColumn("neighbors_truncated", some | none)
    most = lambda x: F.when(none, F.lit(5).cast("long")).otherwise(F.greatest(F.lit(5).cast("long"), F.floor(F.col("room") * (x["b"].cast("double") / F.greatest(F.col("all_bodies"), F.lit(1)))).cast("long")))

    def cut(x):
        body = F.when(F.col("neighbors_truncated") & (x["b"] > most(x)), cut_tokens(x["body"], most(x))).otherwise(x["body"])
        n = F.when(F.col("neighbors_truncated"), x["t"] + F.least(x["b"], most(x))).otherwise(x["n"])
        return F.struct(x["neighbor_rank"].alias("rank"), x["title"].alias("title"), body.alias("body"), x["label"].alias("label"), n.alias("n"))

    q = q.withColumn("near", F.transform("near", cut)).withColumn("left", F.col("budget") - total("n"))
    # the query keeps its title if over ten tokens then remain for its body; else the title gets two fifths
    long = lambda x: F.floor(x).cast("long")
    floor5 = lambda x: F.greatest(F.lit(5).cast("long"), x)
    q = q.withColumn("query_truncated", F.col("truncated") & (F.col("left") > 0) & (F.col("q_tokens") > F.col("left")))
    q = q.withColumn("beside_title", F.col("left") - F.col("q_title")).withColumn("title_share", floor5(long(F.col("left") * 0.4)))
    roomy = F.col("beside_title") > 10
    body_most = F.when(roomy, F.col("beside_title")).otherwise(floor5(F.col("left") - F.col("title_share")))
    new_title = F.when(F.col("query_truncated") & ~roomy, cut_tokens("title", F.col("title_share"))).otherwise(F.coalesce("title", F.lit("")))
    new_body = F.when(F.col("query_truncated"), cut_tokens("body", body_most)).otherwise(F.coalesce("body", F.lit("")))
    q = q.withColumn("new_title", new_title).withColumn("new_body", new_body)
    after = F.when(F.col("query_truncated"), count(render_item("new_title", "new_body"))).otherwise(F.col("q_tokens"))
    q = q.withColumn("final_tokens", after + total("n"))
    facts = ["truncated", "neighbors_truncated", "query_truncated", "original_tokens", "final_tokens"]
    return q.select("test_id", F.col("new_title").alias("title"), F.col("new_body").alias("body"), "near", *facts, (F.col("original_tokens") - F.col("final_tokens")).alias("tokens_removed"))


def build_prompt(near: str = "near") -> Column:
    """The user message: numbered examples with answers, then the target (columns title, body)."""
    example = lambda x, i: F.concat(F.lit("--- Example "), (i + 1).cast("string"), F.lit(" ---\n"), render_item(x["title"], x["body"]), F.lit("\nAnswer: <label>"), x["label"], F.lit("</label>\n\n"))
    shown = F.concat(F.lit(HEADER), F.array_join(F.transform(near, example), ""), F.lit(TARGET))
    return F.concat(F.when(F.size(near) > 0, shown).otherwise(""), render_item("title", "body"))


def to_messages(user: Column, thinking: bool = False, prefill: bool = False) -> Column:
    """System and user message as JSON; with a prefilled start of the answer if asked."""
    turns = [("system", F.lit(SYSTEM_THINKING if thinking else SYSTEM)), ("user", user)] + ([("assistant", F.lit(PREFILL))] if prefill else [])
    return F.to_json(F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in turns)))


def prompt_stats(lengths: DataFrame, by: list[str], n_col: str = "n_prompt_tokens") -> DataFrame:
    """n, min, mean, exact linear percentiles (cut to whole numbers) and max of prompt lengths; no task holds the lengths of a group."""
    shares = (0.5, 0.75, 0.9, 0.95, 0.99)
    ps = percentiles(lengths, by, n_col, list(shares))
    named = ps.select(*(F.col(c).alias(f"_{c}") for c in by), *(F.floor(f"p{k}").cast("long").alias(f"p{round(x * 100)}") for k, x in enumerate(shares)))
    stats = lengths.groupBy(*by).agg(F.count("*").alias("n"), F.min(n_col).alias("min_tokens"), F.round(F.avg(n_col), 6).alias("mean_tokens"), F.max(n_col).alias("max_tokens"))
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    cols = [*by, "n", "min_tokens", "mean_tokens", *(f"p{round(x * 100)}" for x in shares), "max_tokens"]
    return stats.join(named, same, "left").select(*cols)


def window_fit(lengths: DataFrame, by: list[str], n_col: str = "n_prompt_tokens", windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Shares of prompts at or above, and below, each window."""
    each = lengths.withColumn("window", F.explode(F.array(*(F.lit(w) for w in windows))))
    over = F.avg((F.col(n_col) >= F.col("window")).cast("double"))
    return each.groupBy(*by, "window").agg(F.round(over, 6).alias("share_over"), F.round(1 - over, 6).alias("share_fit"))


def _cut_item(df: DataFrame, max_seq: int) -> DataFrame:
    """Adds item text cut to max_seq less the template and 30 tokens, and a flag."""
    item = render_item("title", "body")
    most = F.lit(max_seq - 30).cast("long") - n_tokens(F.lit(TRAIN.replace("{}", "")))
    long = n_tokens(item) > most
    head = F.array_join(F.slice(F.regexp_extract_all(item, F.lit(r"\s*[A-Za-z0-9_]+|\s*[^A-Za-z0-9_\s]"), F.lit(0)), F.lit(1), F.greatest(most, F.lit(0)).cast("int")), "")
    return df.withColumn("truncated", long).withColumn("item", F.when(long, F.concat(head, F.lit(CUT_MARK))).otherwise(item))


def sft_rows(df: DataFrame, max_seq: int = 2048, style: str = "clean", eos: str = EOS) -> DataFrame:
    """Training texts (item_id, text, truncated): clean cuts the item, legacy has a reasoning prefix and no cut."""
    if style == "legacy":
        return df.select("item_id", F.concat(fill(TRAIN_LEGACY, render_item("title", "body"), F.lit(THOUGHT), F.col("labels")), F.lit(EOS)).alias("text"), F.lit(False).alias("truncated"))
    return _cut_item(df, max_seq).select("item_id", F.concat(fill(TRAIN, F.col("item"), F.col("labels")), F.lit(eos)).alias("text"), "truncated")


def inference_rows(df: DataFrame, max_seq: int = 2048, style: str = "clean") -> DataFrame:
    """Prompts (item_id, prompt, truncated) without the answer, right-stripped in the clean form."""
    if style == "legacy":
        item = F.concat(F.coalesce("title", F.lit("")), F.lit(" \n "), F.coalesce("body", F.lit("")))
        return df.select("item_id", fill(ASK_LEGACY, fill(ASK_ITEM, item)).alias("prompt"), F.lit(False).alias("truncated"))
    return _cut_item(df, max_seq).select("item_id", F.regexp_replace(fill(TRAIN, F.col("item"), F.lit("")), r"\s+$", "").alias("prompt"), "truncated")


def paired_prompts(df: DataFrame, a: str = "bug", b: str = "question") -> DataFrame:
    """Zero-shot prompts, each with either label as the start of the answer."""
    each = df.withColumn("continuation", F.explode(F.array(F.lit(a), F.lit(b))))
    return each.select("item_id", "continuation", F.concat(F.lit(SYSTEM), F.lit("\n\n"), render_item("title", "body"), F.lit("\n"), F.lit(PREFILL), "continuation").alias("prompt"))


def truncation_report(facts: DataFrame, by: list[str]) -> DataFrame:
    n = lambda c: F.count(F.when(F.col(c), 1)).alias(f"n_{c}")
    return facts.groupBy(*by).agg(F.count("*").alias("n"), n("truncated"), n("neighbors_truncated"), n("query_truncated"), F.sum("tokens_removed").alias("tokens_removed"))


def random_examples(test: DataFrame, train: DataFrame, k: int, seed: int) -> DataFrame:
    """Stand-in neighbours where no neighbour table exists (see sample.random_neighbors)."""
    from marrow.operators.sample import random_neighbors

    return random_neighbors(test, train, k, [seed]).drop("seed")


