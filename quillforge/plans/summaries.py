"""Queries on names, keys, logs, requests for scores, and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillforge.functions import text as T
from quillforge.functions import values as V
from quillforge.operators import joins as J
from quillforge.operators import pool as P
from quillforge.plans import pool, rows
from quillforge.plans import sql as Q
from quillforge.sources.tables import table

RULES = [("run-hazel/subsets/", "h/"), ("run-", "r/")]


def names(s: SparkSession, d: str) -> DataFrame:
    st = table(s, d, "student_translations")
    return st.select(
        "request_id", V.subset_name(F.col("subset_idx")).alias("subset"), V.part_name(F.col("order_idx")).alias("part"), V.checkpoint_name(F.col("order_idx")).alias("checkpoint"),
        V.clean_run_id(F.col("request_id")).alias("run"), V.byte_size(F.coalesce("generated_token_count", F.lit(0)) * 997).alias("size"), V.renamed(F.col("request_id"), RULES).alias("key"))


def collisions(s: SparkSession, d: str) -> DataFrame:
    """Keys that would collide once the run is left out of them."""
    st = table(s, d, "student_translations").select("request_id").distinct()
    return J.duplicates(st.select(F.regexp_replace("request_id", "^run-[a-z]+/", "").alias("key")), "key")


def ignored_ids(s: SparkSession, d: str) -> DataFrame:
    st = table(s, d, "student_translations")
    return st.select("request_id", F.length("request_id").cast("bigint").alias("n")).where(~V.ignored(F.col("request_id"), ["*/kfr-wire-*", "no-such", "run-a?pen/*"])).agg(F.count("*").alias("files"), F.sum("n").alias("bytes"))


def log_metrics(s: SparkSession, d: str) -> DataFrame:
    """Numbers of a log record, one row each."""
    st = table(s, d, "student_translations")
    m = F.create_map(F.lit("tokens"), F.col("generated_token_count").cast("string"), F.lit("model"), F.col("model_name"), F.lit("total_flos"), F.lit("12"), F.lit("order"), F.col("order_idx").cast("string"))
    return st.select("request_id", F.explode(V.numeric_log(F.map_filter(m, lambda _, v: v.isNotNull()))).alias("metric", "value"))


def contents(s: SparkSession, d: str) -> DataFrame:
    """Answers of a chat interface: text as a string or in parts, and the tokens used."""
    st = table(s, d, "student_translations").where("translation is not null")
    body = F.when(F.col("order_idx") % 3 == 0, F.to_json(F.array(F.struct(F.substring("translation", 1, 9).alias("text")), F.struct(F.substring("translation", 10, 1 << 30).alias("text")))))
    body = body.when(F.col("order_idx") % 3 == 1, F.substring(F.to_json(F.array("translation")), 2, 1 << 30)).otherwise(F.lit("17"))
    whole = F.when(F.col("order_idx") % 3 == 1, F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)
    usage = F.to_json(F.struct(F.struct(F.col("generated_token_count").alias("completion_tokens")).alias("usage")))
    return st.select("request_id", V.message_content(whole).alias("content"), V.usage_field(usage, "completion_tokens").alias("completion_tokens"), V.usage_field(F.lit("oops"), "total_tokens").alias("total_tokens"))


def chosen_models(s: SparkSession, d: str) -> DataFrame:
    """Models asked for by name or alias, in the order asked."""
    m = table(s, d, "student_translations").select("model_name").distinct().withColumn("alias", F.explode(F.array("model_name", F.right("model_name", F.lit(2)))))
    asked = s.createDataFrame([(0, "s2"), (1, "student-a-s0"), (2, "nobody")], "position bigint, alias string")
    return F.broadcast(asked).join(m, "alias").select("position", "model_name")


def ranked_templates(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "prompt_templates").select("prompt_template_id", T.word_count("template_text").alias("words"))
    # a dozen rows
    return t.withColumn("place", F.row_number().over(Window.orderBy(F.desc("words"), F.desc("prompt_template_id"))).cast("bigint"))


def eval_rows(s: SparkSession, d: str) -> DataFrame:
    """The first usable rows of the validation set: the limit counts rows after the filter."""
    return table(s, d, "eval_items").where(T.has_text(F.col("source")) & T.has_text(F.col("target"))).orderBy("item_id").limit(50).select("item_id", "id", "source_tokens")


def score_requests(s: SparkSession, d: str) -> DataFrame:
    """Requests for scores of valid responses, with the reference."""
    st = rows.last_students(s, d).where((F.col("student_status") == "ok") & T.has_text(F.col("translation")))
    c = table(s, d, "cycle").select("order_idx", F.col("source").alias("src"), F.col("target").alias("ref"))
    return st.join(c, "order_idx").select(F.concat_ws("/", "request_id", F.lit("qe-selection")).alias("id"), F.col("id").alias("row_id"), "order_idx", F.coalesce("src", F.lit("")).alias("src"), F.col("translation").alias("mt"), F.coalesce("ref", F.lit("")).alias("ref"), T.has_text(F.col("ref")).alias("has_ref"))


def score_maps(s: SparkSession, d: str) -> DataFrame:
    """Scores of a request by backend and model, laid onto its row."""
    qe = table(s, d, "qe_scores").where("qe_status = 'ok' and qe_score is not null and not isnan(qe_score)")
    best = qe.groupBy("request_id", F.concat_ws("/", "qe_backend", "qe_model").alias("metric")).agg(F.max("qe_score").alias("score"))
    each = best.groupBy("request_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "score")))).alias("scores"))
    x = table(s, d, "student_translations").select("request_id").distinct().join(each, "request_id", "left")
    return x.select("request_id", F.coalesce(F.size("scores"), F.lit(0)).cast("bigint").alias("metrics"), F.array_max(F.map_values("scores")).alias("best"))


def blocked(s: SparkSession, d: str) -> DataFrame:
    """Of the requests selected from all scored rows, those that the classifier keeps from the teacher, by label."""
    from quillforge.operators import degeneration as D
    from quillforge.operators import selection as S

    chosen = S.stratified_top(pool.scored(s, d), pool.K, "low").select(F.col("id").alias("request_id"))
    st = table(s, d, "student_translations").select("request_id", "order_idx", "translation", "student_status", "finish_reason", "finished_at")
    # at most K requests are chosen
    last = J.latest(st.join(F.broadcast(chosen), "request_id", "left_semi"), ["request_id"], [F.col("finished_at").desc()])
    x = last.join(table(s, d, "cycle").select("order_idx", "source"), "order_idx")
    labelled = D.classify(x, "source", "translation", "student_status", "finish_reason")
    # clean rows are dropped as a group: a filter of rows would be pushed down, with the classifier's expressions written out in it
    return labelled.groupBy("degeneration_label").agg(F.count_if(F.col("degeneration_label") != "clean").alias("requests")).where("requests > 0")


def mask_audit(s: SparkSession, d: str) -> DataFrame:
    """The first rows' masks: where the response begins."""
    return audited(rows.masked(s, d))


def audited(masked: DataFrame) -> DataFrame:
    x = masked.orderBy("order_idx").limit(5)
    return x.select("id", "order_idx", F.size("input_ids").cast("bigint").alias("tokens"), F.size(F.filter("labels", lambda v: v == -100)).cast("bigint").alias("masked"))


def longest_row(s: SparkSession, d: str) -> DataFrame:
    """The longest row before any limit, and the rows that the sequence limit would not hold: they, and those whose prompt alone fills it."""
    size = F.size("prompt_ids") + F.size("response_ids") + 1
    return rows.word_ids(s, d).agg(
        F.max(size).cast("bigint").alias("longest"), F.count("*").alias("rows"), F.count_if(size > rows.LIMIT).alias("over_limit"),
        F.count_if(F.size("prompt_ids") >= rows.LIMIT).alias("no_room"))


def smoke_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows made from a few sentences: every fourth one is long."""
    text = F.element_at(F.array(*(F.lit(x) for x in ("Revenue increased.", "The board met.", "Costs fell."))), (F.col("id") % 3 + 1).cast("int"))
    return s.range(64).select(F.format_string("smoke_%03d", F.col("id")).alias("id"), F.when(F.col("id") % 4 == 0, F.repeat(F.concat(text, F.lit(" ")), F.lit(40))).otherwise(text).alias("source"), (F.col("id") % 4 == 0).alias("long_context"))


def eval_summary(s: SparkSession, d: str) -> DataFrame:
    st = table(s, d, "student_translations")
    ok = F.col("student_status") == "ok"
    return st.agg(F.count("*").alias("rows"), F.count_if(ok).alias("ok_rows"), F.count_if(~ok).alias("failed_rows"), T.ratio(F.count_if(~ok), F.count("*")).alias("fail_ratio"), F.countDistinct("model_name").alias("models"), F.bool_and(F.col("run_id").startswith("run-")).alias("all_named"))


def per_subset_usage(s: SparkSession, d: str) -> DataFrame:
    """Shards of hashed rows with their rows and tokens, for an even split."""
    st = table(s, d, "student_translations")
    return st.groupBy(P.hash_shard(F.col("request_id"), 4).alias("shard")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("generated_token_count"), F.lit(0)).alias("tokens"))


QUERIES = {
    "artifact_names": names, "key_collisions": collisions, "ignored_files": ignored_ids, "log_metrics": log_metrics, "message_contents": contents, "model_selection": chosen_models,
    "template_rank": ranked_templates, "eval_rows": eval_rows, "score_requests": score_requests, "score_maps": score_maps, "filter_blocked": blocked, "mask_audit": mask_audit,
    "longest_row": longest_row, "smoke_rows": smoke_rows, "eval_summary": eval_summary, "shard_load": per_subset_usage,
}

N = "(coalesce(generated_token_count, 0) * 997)"
SIZE = "case " + " ".join(f"when {N} >= {1 << (10 * i)} then printf('%.1f', floor({N} * 10 / {1 << (10 * i)}) / 10) || ' {u}'" for i, u in reversed([*enumerate(("KiB", "MiB", "GiB", "TiB"), 1)])) + f" else {N}::VARCHAR || ' B' end"

SQL = {
    "artifact_names": f"""select request_id, 'subset_' || lpad(subset_idx::VARCHAR, 3, '0') as subset, 'part-' || lpad(order_idx::VARCHAR, 5, '0') as part, 'checkpoint-' || lpad(order_idx::VARCHAR, 6, '0') as checkpoint,
 substr(trim(regexp_replace(request_id, '[^A-Za-z0-9_-]+', '-', 'g'), '-'), 1, 128) as run, {SIZE} as size,
 case when starts_with(request_id, 'run-hazel/subsets/') then 'h/' || substr(request_id, 19) when starts_with(request_id, 'run-') then 'r/' || substr(request_id, 5) else request_id end as key from student_translations""",
    "key_collisions": "select regexp_replace(request_id, '^run-[a-z]+/', '') as key, count(*)::BIGINT as occurrences from (select distinct request_id from student_translations) group by 1 having count(*) > 1",
    "ignored_files": "select count(*)::BIGINT as files, sum(length(request_id))::BIGINT as bytes from student_translations where not (request_id like '%/kfr-wire-%' or request_id like 'run-a_pen/%')",
    "log_metrics": """select request_id, 'train/tokens' as metric, generated_token_count::DOUBLE as value from student_translations where generated_token_count is not null
 union all select request_id, 'train/order', order_idx::DOUBLE from student_translations where order_idx is not null""",
    "message_contents": "select request_id, case when order_idx % 3 = 2 then '' else translation end as content, generated_token_count as completion_tokens, null::BIGINT as total_tokens from student_translations where translation is not null",
    "model_selection": """select p as position, model_name from (select distinct model_name from student_translations) m join (values (0::BIGINT, 's2'), (1, 'student-a-s0'), (2, 'nobody')) a(p, n) on a.n = m.model_name or a.n = right(m.model_name, 2)""",
    "template_rank": f"select prompt_template_id, {Q.word_count('template_text')} as words, row_number() over (order by {Q.word_count('template_text')} desc, prompt_template_id desc)::BIGINT as place from prompt_templates",
    "eval_rows": f"select item_id, id, source_tokens from eval_items where {Q.has_text('source')} and {Q.has_text('target')} order by item_id limit 50",
    "score_requests": f"""select st.request_id || '/qe-selection' as id, st.id as row_id, st.order_idx, coalesce(c.source, '') as src, st.translation as mt, coalesce(c.target, '') as ref, {Q.has_text('c.target')} as has_ref
 from {Q.LAST_STUDENT} st join cycle c on c.order_idx = st.order_idx where st.student_status = 'ok' and {Q.has_text('st.translation')}""",
    "score_maps": """with q as (select request_id, qe_backend || '/' || qe_model as m, max(qe_score) as s from qe_scores where qe_status = 'ok' and qe_score is not null and not isnan(qe_score) and qe_backend is not null and qe_model is not null group by 1, 2)
 select r.request_id, count(q.m)::BIGINT as metrics, max(q.s) as best from (select distinct request_id from student_translations) r left join q on q.request_id = r.request_id group by 1""",
    "mask_audit": f"with {rows.MASK} select id, order_idx, len(ids)::BIGINT as tokens, least(na, len(ids))::BIGINT as masked from m order by order_idx limit 5",
    "longest_row": f"with {rows.MASK} select max(total)::BIGINT as longest, count(*)::BIGINT as rows, count_if(total > {rows.LIMIT})::BIGINT as over_limit, count_if(na >= {rows.LIMIT})::BIGINT as no_room from m",
    "smoke_rows": """with r as (select unnest(range(64)) as i), t as (select i, ['Revenue increased.', 'The board met.', 'Costs fell.'][i % 3 + 1] as t from r)
 select 'smoke_' || lpad(i::VARCHAR, 3, '0') as id, case when i % 4 = 0 then repeat(t || ' ', 40) else t end as source, i % 4 = 0 as long_context from t""",
    "eval_summary": """select count(*)::BIGINT as rows, count_if(student_status = 'ok')::BIGINT as ok_rows, count_if(student_status <> 'ok')::BIGINT as failed_rows, count_if(student_status <> 'ok')::DOUBLE / greatest(count(*), 1) as fail_ratio,
 count(distinct model_name)::BIGINT as models, bool_and(starts_with(run_id, 'run-')) as all_named from student_translations""",
    "shard_load": "select (('0x' || substr(sha256(request_id), 1, 16))::HUGEINT % 4)::BIGINT as shard, count(*)::BIGINT as rows, coalesce(sum(generated_token_count), 0)::BIGINT as tokens from student_translations group by 1",
}
