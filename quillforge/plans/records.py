"""Queries on the records of a run and on the checks of its artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.functions import text as T
from quillforge.operators import joins as J
from quillforge.operators import pool as P
from quillforge.operators import records as R
from quillforge.operators import selection as S
from quillforge.operators.pool import hash_shard
from quillforge.plans import pool
from quillforge.plans import sql as Q
from quillforge.sources.tables import table

SHARDS = 5


def filter_rows(s: SparkSession, d: str) -> DataFrame:
    """Student rows, each request once, with their source and the label of the basic validity check. The request's id is the row's id: ids of the pool repeat."""
    st = table(s, d, "student_translations").select("request_id", "order_idx", "translation", "student_status", "student_error", "finish_reason", "generated_token_count", "prompt_template_id", "finished_at")
    last = J.latest(st, ["request_id"], [F.col("finished_at").desc()])
    c = table(s, d, "cycle").select("order_idx", "source", "target", "metadata", "source_tokens")
    t = table(s, d, "prompt_templates").select("prompt_template_id", "prompt_template_group")
    bad = F.col("student_status").isNull() | (F.col("student_status") != "ok")
    label = F.when(bad, "invalid_status").when(~F.coalesce(T.has_text(F.col("translation")), F.lit(False)), "empty").otherwise("clean")
    return last.join(c, "order_idx").join(t, "prompt_template_id", "left").select(
        F.col("request_id").alias("id"), "request_id", "order_idx", "source", "target", "metadata", "source_tokens", F.col("translation").alias("student_translation"), *R.STUDENT,
        label.alias("degeneration_label"), F.when(label != "clean", F.array(label)).otherwise(F.array().cast("array<string>")).alias("degeneration_flags"), F.lit(True).alias("degeneration_filter_enabled"))


def score_tables(s: SparkSession, d: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Score requests of clean rows, and the last answer of each request."""
    sent = rows.where("degeneration_label = 'clean'").select(
        F.concat("id", F.lit("/qe-selection")).alias("id"), F.col("id").alias("row_id"), "order_idx", F.col("source").alias("src"), F.col("student_translation").alias("mt"),
        F.when(T.has_text(F.col("target")), F.col("target")).alias("ref"), F.lit("xcomet").alias("backend"), F.lit("xl").alias("model"))
    number = F.when(~F.isnan("qe_score"), F.col("qe_score"))
    qe = table(s, d, "qe_scores").select("request_id", number.alias("score"), F.col("qe_status").alias("status"), F.col("qe_backend").alias("backend"), F.col("qe_model").alias("model"), "scored_at")
    last = J.latest(qe, ["request_id"], [F.col("scored_at").desc_nulls_last(), F.col("score").desc_nulls_last(), F.col("status").desc_nulls_last()])
    got = last.select(F.concat("request_id", F.lit("/qe-selection")).alias("id"), F.col("request_id").alias("row_id"), "status", "score", F.lit(None).cast("string").alias("error"), "backend", "model")
    return sent, got


def score_records(s: SparkSession, d: str) -> DataFrame:
    rows = filter_rows(s, d)
    sent, got = score_tables(s, d, rows)
    x = R.score_records(sent, got, rows)
    return x.withColumn("metadata", F.coalesce(F.size("metadata"), F.lit(0)).cast("bigint")).withColumn("degeneration_flags", F.array_join("degeneration_flags", ","))


def compact(s: SparkSession, d: str) -> DataFrame:
    rows = filter_rows(s, d)
    sent, got = score_tables(s, d, rows)
    chosen = S.stratified_top(pool.scored(s, d), pool.K, "low").withColumn("selection_rule", F.lit("low"))
    kept = rows.where("degeneration_label <> 'clean'").select("id")
    blocked = got.join(kept, got["row_id"] == kept["id"], "left_semi").select(
        F.col("row_id").alias("id"), F.lit(None).cast("bigint").alias("selection_rank"), F.lit("blocked").alias("selection_rule"), F.lit(0).cast("bigint").alias("length_bucket_idx"), F.lit("1-64").alias("length_bucket"))
    return R.compact(rows, sent, got, chosen, blocked)


def compact_full(s: SparkSession, d: str) -> DataFrame:
    """All sides of the record, laid flat."""
    x = compact(s, d)
    return x.select(
        "id", "source_tokens", F.coalesce(F.size("metadata"), F.lit(0)).cast("bigint").alias("meta_entries"), F.col("student.status").alias("student_status"),
        F.length("student.translation").cast("bigint").alias("translation_chars"), F.col("student.generated_token_count").alias("generated_token_count"), F.col("student.prompt_template_group").alias("prompt_template_group"),
        "filter.filtered", "filter.label", F.col("qe").isNotNull().alias("has_qe"), F.col("qe.status").alias("qe_status"), F.col("qe.score").alias("qe_score"), F.col("qe.requires_reference").alias("requires_reference"),
        F.col("qe.backend").alias("qe_backend"), F.col("qe.request_id").alias("qe_request_id"), "selection.selected_for_teacher", "selection.selection_rank", "selection.blocked_by_filter",
        F.col("selection.blocked_selection_rule").alias("blocked_rule"))


def restored(s: SparkSession, d: str) -> DataFrame:
    """Ten tables out of the compact records: rows, ids and a sum of each."""
    out = None
    for name, t in R.restored(compact(s, d)).items():
        number = {"input": F.length("source"), "qe_scores": F.lit(1), "selected": R.rank_order(F.col("selection_rank")), "blocked": R.rank_order(F.col("selection_rank"))}.get(name, F.col("order_idx") if "order_idx" in t.columns else F.lit(1))
        row = t.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.coalesce(F.sum(number.cast("bigint")), F.lit(0)).cast("bigint").alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


def raw_random(s: SparkSession, d: str) -> DataFrame:
    """The baseline over the pool's rows, each id once: the last delivery."""
    rows = P.normalized(table(s, d, "cycle")).withColumn("length_bucket_idx", P.bucket_of(P.token_length(F.col("source_tokens"), F.col("source"))))
    once = J.latest(rows.select("id", "order_idx", "length_bucket_idx"), ["id"], [F.col("order_idx").desc()])
    return R.raw_random(once, pool.K).select("id", "order_idx", "length_bucket_idx", "length_bucket", "selection_rank", "student_status", "selection_rule", "qe_score")


def faults(s: SparkSession, d: str) -> DataFrame:
    """Faults of the score answers against all requests, by kind."""
    sent = table(s, d, "student_translations").select(F.col("request_id").alias("id"), F.col("id").alias("row_id")).distinct()
    got = table(s, d, "qe_scores").select(F.col("request_id").alias("id"), F.col("id").alias("row_id"), F.col("qe_status").alias("status"))
    return R.response_faults(sent, got).groupBy("fault").agg(F.count("*").alias("keys"))


def shard_union(s: SparkSession, d: str) -> DataFrame:
    """The pool cut into shards and put together again, checked against its number of rows. A row's place is its rank by order_idx, whose
    values may have gaps; rows that share one are told apart by the rest of the row."""
    c = table(s, d, "cycle").select("order_idx", "id", F.length("source").alias("chars"))
    n = c.count()
    placed = P.places(c, "order_idx", ["id", "chars"])
    shard = P.order_shard(F.col("place"), F.lit(n), SHARDS)
    return R.checked_union([placed.where(shard == i) for i in range(SHARDS)], n, "place").select("order_idx", "id", "chars")


def missing_drafts(s: SparkSession, d: str) -> DataFrame:
    return R.required(table(s, d, "student_translations").select("request_id", "translation").distinct(), "translation", "request_id").select("lacking", F.array_join("first", ",").alias("first"))


def missing_references(s: SparkSession, d: str) -> DataFrame:
    return R.required(table(s, d, "cycle").select("order_idx", "target"), "target", "order_idx").select("lacking", F.array_join("first", ",").alias("first"))


def front_summary(s: SparkSession, d: str) -> DataFrame:
    """One row on the stages before training: rows, labels, scores, selection, golden pairs. One-row aggregates are put side by side."""
    st, qe, gold = filter_rows(s, d), table(s, d, "qe_scores"), table(s, d, "golden_pairs")
    bad = F.col("degeneration_label") != "clean"
    a = st.agg(
        F.count("*").alias("student_rows"), F.count_if(~bad).alias("filter_pass_rows"), F.count_if(bad).alias("filter_fail_rows"), T.ratio(F.count_if(bad), F.count("*")).alias("filter_fail_ratio"),
        *(F.count_if(F.col("degeneration_label") == x).alias(f"label_{x}") for x in ("clean", "empty", "invalid_status")), F.coalesce(F.sum("generated_token_count"), F.lit(0)).alias("generated_tokens"))
    number = (F.col("qe_status") == "ok") & F.col("qe_score").isNotNull() & ~F.isnan("qe_score")
    b = qe.agg(F.count("*").alias("score_rows"), F.count_if(number).alias("scored_rows"), F.round(F.avg(F.when(number, F.col("qe_score"))), 9).alias("qe_score_mean"))
    score = F.when(~F.isnan("qe_score"), F.col("qe_score"))
    c = gold.agg(F.count("*").alias("accepted_rows"), F.count_if(F.col("selection_rank").isNotNull()).alias("ranked_rows"), F.round(F.avg(score), 9).alias("accepted_score_mean"), F.greatest(F.lit(0), F.lit(1000) - F.count("*")).cast("bigint").alias("shortfall_rows"))
    e = table(s, d, "cycle").agg(F.count("*").alias("input_rows"), F.countDistinct("id").alias("input_ids"))
    return a.join(F.broadcast(b)).join(F.broadcast(c)).join(F.broadcast(e))


def checkpoint_fit(s: SparkSession, d: str) -> DataFrame:
    """Keys of the scores (checkpoint) against those of the requests (model)."""
    a = table(s, d, "qe_scores").select(F.col("request_id").alias("key"), F.lit("a").alias("side"))
    b = table(s, d, "student_translations").select(F.col("request_id").alias("key"), F.lit("b").alias("side"))
    return R.compatible(J.coverage(a.unionByName(b)))


def resume_faults(s: SparkSession, d: str) -> DataFrame:
    """A run with faults of every kind, made of the golden pairs by a hash of their ids."""
    c = table(s, d, "golden_pairs").where("id is not null").select("id")
    h = hash_shard(F.col("id"), 8)
    twice = c.unionByName(c.where(h == 0))
    accepted = c.where(h.isin(1, 2)).unionByName(c.where(h == 1)).unionByName(c.where(h == 3).select(F.concat("id", F.lit("/new")).alias("id")))
    rejected = c.where(h.isin(2, 4, 5)).unionByName(c.where(h.isin(4, 5)))
    log = c.where(h == 5).select("id", F.lit("failed").alias("status"), F.lit(1).alias("pos")).unionByName(c.where(h == 6).select(F.concat("id", F.lit("/lost")).alias("id"), F.lit("failed").alias("status"), F.lit(2).alias("pos")))
    return R.resume_faults(twice, accepted, rejected, log).groupBy("fault").agg(F.count("*").alias("ids"))


QUERIES = {
    "score_records": score_records, "compact_full": compact_full, "restored_tables": restored, "raw_random_selection": raw_random, "response_faults": faults, "shard_union": shard_union,
    "missing_drafts": missing_drafts, "missing_references": missing_references, "front_summary": front_summary, "checkpoint_fit": checkpoint_fit, "resume_faults": resume_faults,
}

LABEL = f"case when student_status is null or student_status <> 'ok' then 'invalid_status' when not {Q.has_text('translation')} then 'empty' else 'clean' end"
ROWS = f"""fr as (select st.request_id as id, st.order_idx, c.source, c.target, c.metadata, c.source_tokens, st.translation, st.student_status, st.student_error, st.finish_reason, st.generated_token_count,
  st.prompt_template_id, t.prompt_template_group, {LABEL.replace('translation)', 'st.translation)').replace('student_status', 'st.student_status')} as label
  from {Q.LAST_STUDENT} st join cycle c on c.order_idx = st.order_idx left join prompt_templates t on t.prompt_template_id = st.prompt_template_id),
 qa as (select request_id, case when not isnan(qe_score) then qe_score end as score, qe_status as status, qe_backend as backend, qe_model as model from qe_scores
  qualify row_number() over (partition by request_id order by scored_at desc nulls last, case when not isnan(qe_score) then qe_score end desc nulls last, qe_status desc nulls last) = 1)"""
RAW = f"""raw as (select case when {Q.has_text('id')} then id else 'row_' || lpad(order_idx::VARCHAR, 12, '0') end as id, order_idx, {Q.bucket('(' + Q.token_length('source_tokens', 'source') + ')')} as length_bucket_idx
  from cycle where {Q.has_text('source')}), scored as (select *, null::DOUBLE as qe_score from raw qualify row_number() over (partition by id order by order_idx desc) = 1)"""
SHARD8 = "(('0x' || substr(sha256(id), 1, 16))::HUGEINT % 8)"

SQL = {
    "score_records": f"""with {ROWS} select fr.id, fr.id || '/qe-selection' as request_id, fr.order_idx, source, target, coalesce(cardinality(metadata), 0)::BIGINT as metadata, source_tokens, translation as student_translation,
 student_status, student_error, finish_reason, generated_token_count, prompt_template_id, prompt_template_group, label as degeneration_label, '' as degeneration_flags, true as degeneration_filter_enabled, 'xcomet' as qe_backend, 'xl' as qe_model,
 {Q.has_text('target')} as qe_requires_reference, coalesce(qa.status, 'missing') as qe_status, qa.score as qe_score, null::VARCHAR as qe_error from fr left join qa on qa.request_id = fr.id where label = 'clean'""",
    "compact_full": f"""with {ROWS}, sel as ({pool.SQL['select_low']}) select fr.id, source_tokens, coalesce(cardinality(metadata), 0)::BIGINT as meta_entries, coalesce(student_status, 'failed') as student_status,
 length(coalesce(translation, ''))::BIGINT as translation_chars, coalesce(generated_token_count, 0)::BIGINT as generated_token_count, prompt_template_group, label <> 'clean' as filtered, label,
 label = 'clean' or qa.request_id is not null as has_qe, case when qa.request_id is not null then coalesce(qa.status, 'missing') when label = 'clean' then 'missing' end as qe_status, qa.score as qe_score,
 case when label = 'clean' then {Q.has_text('target')} when qa.request_id is not null then false end as requires_reference, case when qa.request_id is not null then qa.backend when label = 'clean' then 'xcomet' end as qe_backend,
 case when label = 'clean' then fr.id || '/qe-selection' end as qe_request_id, sel.id is not null as selected_for_teacher, sel.selection_rank, label <> 'clean' and qa.request_id is not null as blocked_by_filter,
 case when label <> 'clean' and qa.request_id is not null then 'blocked' end as blocked_rule from fr left join qa on qa.request_id = fr.id left join sel on sel.id = fr.id""",
    "restored_tables": f"""with {ROWS}, sel as ({pool.SQL['select_low']}), q as (select fr.*, qa.request_id is not null as answered from fr left join qa on qa.request_id = fr.id),
 n as (select count(*)::BIGINT as rows, sum(length(coalesce(source, '')))::BIGINT as chars, sum(order_idx)::BIGINT as places from q)
 select 'input' as table_name, rows, rows as ids, chars as total from n union all select x, rows, rows, places from n, (select unnest(['requests', 'responses', 'student_rows', 'filter_rows']) as x)
 union all select x, count(*)::BIGINT, count(distinct case when label = 'clean' then id end)::BIGINT, coalesce(sum(case when label = 'clean' then order_idx end), 0)::BIGINT from q, (select unnest(['qe_requests', 'qe_responses']) as x) where label = 'clean' or answered group by x
 union all select 'qe_scores', count(*)::BIGINT, count(*)::BIGINT, count(*)::BIGINT from q where label = 'clean' or answered
 union all select 'selected', count(*)::BIGINT, count(*)::BIGINT, coalesce(sum(selection_rank), 0)::BIGINT from sel join q on q.id = sel.id
 union all select 'blocked', count(*)::BIGINT, count(*)::BIGINT, (count(*) * {R.NO_RANK})::BIGINT from q where label <> 'clean' and answered""",
    "raw_random_selection": "select id, order_idx, x.length_bucket_idx, length_bucket, selection_rank, 'skipped_raw_random' as student_status, 'random_raw_length_bucket_candidate_pool' as selection_rule, null::DOUBLE as qe_score from ("
    + pool.select_sql(pool.RANDOM, "n").replace(pool.SCORED_SQL, RAW) + ") x join (select id as rid, order_idx from (" + f"with {RAW} select id, order_idx from scored" + ")) y on y.rid = x.id",
    "response_faults": """with a as (select id, count(*) as n, list_distinct(list(row_id)) as r from (select distinct request_id as id, id as row_id from student_translations) group by id),
 b as (select request_id as id, count(*) as n, list_distinct(list(id)) as r, bool_and(coalesce(qe_status = 'ok', false)) as ok from qe_scores group by 1),
 x as (select coalesce(a.id, b.id) as id, a.n as asked, b.n as got, a.r as ar, b.r as br, ok from a full join b on a.id is not distinct from b.id),
 f as (select 'duplicate_request' as fault, count_if(asked > 1) as keys from x union all select 'no_id', count_if(got is not null and coalesce(trim(id), '') = '') from x union all select 'duplicate_response', count_if(got > 1) from x
  union all select 'missing', count_if(got is null) from x union all select 'extra', count_if(asked is null) from x
  union all select 'row_mismatch', count_if(asked is not null and got is not null and len(list_distinct(list_concat(ar, br))) > least(len(ar), len(br))) from x union all select 'not_ok', count_if(asked is not null and got is not null and not ok) from x)
 select fault, keys::BIGINT as keys from f where keys > 0""",
    "shard_union": "select order_idx, id, length(source)::INTEGER as chars from cycle",
    "missing_drafts": f"with l as (select distinct request_id from (select distinct request_id, translation from student_translations) where not {Q.has_text('translation')}) select (select count(*) from l)::BIGINT as lacking, (select coalesce(string_agg(request_id, ',' order by request_id), '') from (select request_id from l order by request_id limit 5)) as first",
    "missing_references": f"with l as (select order_idx from cycle where not {Q.has_text('target')}) select (select count(*) from l)::BIGINT as lacking, (select coalesce(string_agg(order_idx::VARCHAR, ',' order by order_idx), '') from (select order_idx from l order by order_idx limit 5)) as first",
    "front_summary": f"""with {ROWS} select * from (select count(*)::BIGINT as student_rows, count_if(label = 'clean')::BIGINT as filter_pass_rows, count_if(label <> 'clean')::BIGINT as filter_fail_rows, count_if(label <> 'clean')::DOUBLE / greatest(count(*), 1) as filter_fail_ratio,
  count_if(label = 'clean')::BIGINT as label_clean, count_if(label = 'empty')::BIGINT as label_empty, count_if(label = 'invalid_status')::BIGINT as label_invalid_status, coalesce(sum(generated_token_count), 0)::BIGINT as generated_tokens from fr),
 (select count(*)::BIGINT as score_rows, count_if(qe_status = 'ok' and qe_score is not null and not isnan(qe_score))::BIGINT as scored_rows, round(avg(qe_score) filter (where qe_status = 'ok' and qe_score is not null and not isnan(qe_score)), 9) as qe_score_mean from qe_scores),
 (select count(*)::BIGINT as accepted_rows, count(selection_rank)::BIGINT as ranked_rows, round(avg(qe_score) filter (where not isnan(qe_score)), 9) as accepted_score_mean, greatest(0, 1000 - count(*))::BIGINT as shortfall_rows from golden_pairs),
 (select count(*)::BIGINT as input_rows, count(distinct id)::BIGINT as input_ids from cycle)""",
    "checkpoint_fit": """with k as (select coalesce(a.k, b.k) as k, a.k is not null as a, b.k is not null as b from (select distinct request_id as k from qe_scores) a full join (select distinct request_id as k from student_translations) b on a.k = b.k),
 n as (select count_if(a and b) as m, count_if(a and not b) as oa, count_if(b and not a) as ob from k) select m::BIGINT as matched, oa::BIGINT as only_a, ob::BIGINT as only_b, m::DOUBLE / greatest(m + ob, 1) as covered, oa > 0 or m::DOUBLE / greatest(m + ob, 1) < 0.99 as refused from n""",
    "resume_faults": f"""with g as (select id, count(*) as n, any_value({SHARD8}) as h from golden_pairs where id is not null group by id),
 f as (select 'repeated_candidate' as fault, count_if(h = 0 or n > 1) as ids from g union all select 'repeated_accepted', count_if(h = 1 or (h in (2, 3) and n > 1)) from g union all select 'unknown_accepted', count_if(h = 3) from g
  union all select 'unknown_retry', count_if(h = 6) from g union all select 'repeated_rejected', count_if(h = 4 or (h = 2 and n > 1)) from g union all select 'accepted_and_rejected', count_if(h = 2) from g)
 select fault, ids::BIGINT as ids from f where ids > 0""",
}
