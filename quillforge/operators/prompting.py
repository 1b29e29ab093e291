"""Prompts from templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillforge.operators.pool import hash_shard

# What template placeholders stand for besides the source.
VALUES = {
    "src_label_en": "English", "src_label_ko": "영어", "tgt_label_en": "Korean", "tgt_label_ko": "한국어", "src_lang_en": "English", "src_lang_name": "English",
    "src_lang_ko": "영어", "tgt_lang_en": "Korean", "tgt_lang_name": "Korean", "tgt_lang_ko": "한국어", "domain_en": "economic and financial", "domain_ko": "경제·금융",
}


def rendered(template: Column, source: Column, values: dict[str, str] | None = None) -> Column:
    """The template with its placeholders filled. The source comes last, so that braces in it stay as they are."""
    out = template
    for k, v in (VALUES | (values or {})).items():
        out = F.replace(out, F.lit("{" + k + "}"), F.lit(v))
    for k in ("{source}", "{src}"):
        out = F.array_join(F.transform(F.split(out, "\\Q" + k + "\\E"), lambda x: x), "\x00")
    return F.replace(out, F.lit("\x00"), source)


def system_and_user(system: Column, user: Column) -> Column:
    """A system part, where there is one, above the user's."""
    return F.when(F.coalesce(F.length(system), F.lit(0)) > 0, F.concat(system, F.lit("\n\n"), user)).otherwise(user)


def template_hash(system: Column, user: Column) -> Column:
    return F.sha2(F.concat(F.lit("system:"), F.coalesce(system, F.lit("")), F.lit("\nuser:"), user), 256)


def requests(pool: DataFrame, templates: DataFrame, run: str, subset: Column) -> DataFrame:
    """A request for each pool row: its template by a stable hash of the id, and the prompt. Templates are a handful of rows."""
    listed = sorted((r["prompt_template_id"], r["prompt_template_group"], r["template_text"]) for r in templates.select("prompt_template_id", "prompt_template_group", "template_text").collect())
    if not listed:
        raise ValueError("there is no template")
    table = F.array(*(F.struct(F.lit(a).alias("id"), F.lit(b).alias("group"), F.lit(c).alias("text")) for a, b, c in listed))
    x = pool.withColumn("_t", F.element_at(table, (hash_shard(F.col("id"), len(listed)) + 1).cast("int")))
    return x.select(
        F.format_string("%s/subsets/subset_%03d/%s/student", F.lit(run), subset, F.col("id")).alias("request_id"), "id", "order_idx", subset.alias("subset_idx"), "source",
        rendered(F.col("_t.text"), F.col("source")).alias("prompt"), F.col("_t.id").alias("prompt_template_id"), F.col("_t.group").alias("prompt_template_group"),
        template_hash(F.lit(""), F.col("_t.text")).alias("prompt_template_hash"))


def messages(c: Column, prompt: Column) -> Column:
    """Chat messages that have a role and content; else the prompt as one user message."""
    good = F.filter(c, lambda m: m["role"].isNotNull() & m["content"].isNotNull())
    one = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    return F.when(F.coalesce(F.size(good), F.lit(0)) > 0, good).otherwise(one)
