"""Queries on the teacher's batches, answers and acceptance. The answers are made from the golden pairs, some of them broken on purpose."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillforge.operators import pool as P
from quillforge.operators import teacher as TE
from quillforge.operators.pool import hash_shard
from quillforge.plans import sql as Q
from quillforge.session import checkpoint_folder
from quillforge.sources.tables import table

SIZE, TARGET, MOST = 4, 40, 60


def candidates(s: SparkSession, d: str) -> DataFrame:
    """Golden pairs as candidates, ranked; a repeated id counts once."""
    g = table(s, d, "golden_pairs").where("id is not null")
    first = g.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("accepted_at"))).where("_n = 1")
    ranked = P.positions(first.withColumn("_key", F.sha2("id", 256)), "_key", ["id"], "_rank")
    return ranked.select("id", "source", F.col("target").alias("student_translation"), "teacher_label", (F.col("_rank") + 1).alias("selection_rank"))


def raw_answers(s: SparkSession, d: str) -> DataFrame:
    """batch_idx, item_ids, status, raw_text: every seventh batch has one kind of fault each."""
    b = TE.batches(candidates(s, d), SIZE)
    label = F.when(F.col("teacher_label").isin(TE.LABELS), F.col("teacher_label")).otherwise(F.lit("invalid"))
    item = F.struct("batch_pos", "id", label.alias("label"), F.coalesce("student_translation", F.lit("")).alias("final_translation"))
    g = b.groupBy("batch_idx").agg(F.array_sort(F.collect_list(item)).alias("x"))
    kind = F.col("batch_idx") % 7
    kept = F.when(kind == 3, F.slice("x", 2, SIZE)).otherwise(F.col("x"))
    shaped = F.transform(kept, lambda i: F.struct(i["id"].alias("id"), F.when(kind == 2, F.lit("perfect")).otherwise(i["label"]).alias("label"), i["final_translation"].alias("final_translation")))
    body = F.to_json(F.struct(shaped.alias("items")))
    text = F.when(kind == 0, F.lit("sorry, no JSON today")).when(kind == 1, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("\n "), body))
    return g.select("batch_idx", F.transform("x", lambda i: i["id"]).alias("item_ids"), F.when(kind == 5, "failed").otherwise("ok").alias("status"), text.alias("raw_text"))


def parsed_items(s: SparkSession, d: str) -> DataFrame:
    return TE.items(TE.parsed_answers(raw_answers(s, d)))


def decided(s: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("final_translation").rlike("니다"), F.lit("clean")).otherwise(F.lit("low_hangul_other"))
    return TE.decision(parsed_items(s, d).withColumn("degeneration_label", label), MOST)


def parse(s: SparkSession, d: str) -> DataFrame:
    return parsed_items(s, d)


def decisions(s: SparkSession, d: str) -> DataFrame:
    return decided(s, d).select("batch_idx", "batch_pos", "id", "reject_reason")


def accepted(s: SparkSession, d: str) -> DataFrame:
    return TE.accept_until(decided(s, d), TARGET, ["batch_idx", "batch_pos"]).select("batch_idx", "batch_pos", "id", "reject_reason", "accept_rank")


def reject_counts(s: SparkSession, d: str) -> DataFrame:
    return decided(s, d).where("reject_reason is not null").groupBy("reject_reason").agg(F.count("*").alias("items"))


def ratios(s: SparkSession, d: str) -> DataFrame:
    return TE.label_ratios(table(s, d, "golden_pairs").where("teacher_label is not null"), "teacher_label")


def prompts(s: SparkSession, d: str) -> DataFrame:
    x = TE.batch_prompts(TE.batches(candidates(s, d), SIZE))
    return x.select("batch_idx", F.array_join("item_ids", ",").alias("item_ids"), "items_text")


def union(s: SparkSession, d: str) -> DataFrame:
    raw = raw_answers(s, d)
    rejected = decided(s, d).where("reject_reason is not null").select("id", "reject_reason")
    x = TE.artifacts(raw.select("batch_idx", "item_ids"), raw, parsed_items(s, d), rejected)
    return x.groupBy("record_type").agg(F.count("*").alias("records"), F.count("batch_idx").alias("with_batch"), F.count("id").alias("with_id"))


def resumed(s: SparkSession, d: str) -> DataFrame:
    """A run that broke off after two thirds of its candidates."""
    c = candidates(s, d)
    h = hash_shard(F.col("id"), 6)
    log = c.where(h < 4).select("id", F.when(h == 1, "failed").otherwise("ok").alias("status"), F.lit(1).alias("pos"))
    again = c.where(h == 0).select("id", F.lit("ok").alias("status"), F.lit(2).alias("pos"))
    x = TE.resume(c.select("id", "selection_rank"), c.where(h == 0).select("id"), c.where(h.isin(1, 2)).select("id"), log.unionByName(again))
    return x.select("id", "selection_rank", "state")


def refilled(s: SparkSession, d: str) -> DataFrame:
    """Refill in windows of 16 with an answer that accepts two thirds."""
    g = table(s, d, "golden_pairs").where("id is not null").groupBy("id").agg(F.max(F.when(~F.isnan("qe_score"), F.col("qe_score"))).alias("qe_score"))
    c = candidates(s, d).withColumn("length_bucket_idx", F.pmod("selection_rank", F.lit(3))).join(g, "id")
    answer = lambda w: w.select("id", (hash_shard(F.col("id"), 3) < 2).alias("accepted"), (hash_shard(F.col("id"), 7) == 0).alias("failed"))
    folder = f"{checkpoint_folder(s)}/refill-{uuid.uuid4().hex}"
    out = TE.refill(c.select("id", "selection_rank", "length_bucket_idx", "qe_score"), TARGET, 16, [1.0, 1.0, 1.0], answer, folder)
    return out.select("id", "selection_rank", "length_bucket_idx", "window_no", "schedule_idx", "outcome", "accept_rank")


def summary(s: SparkSession, d: str) -> DataFrame:
    x = decided(s, d)
    return x.agg(
        F.count("*").alias("requested"), F.count_if(F.col("reject_reason").isNull()).alias("acceptable"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"),
        F.greatest(F.lit(0), F.lit(TARGET) - F.count_if(F.col("reject_reason").isNull())).cast("bigint").alias("shortfall"), F.sum("error_count").alias("errors"))


CAND = """c as (select *, row_number() over (order by sha256(id), id) as selection_rank from (select id, source, target, teacher_label from golden_pairs where id is not null qualify row_number() over (partition by id order by accepted_at) = 1)),
 b as (select *, (selection_rank - 1) // 4 as batch_idx, (selection_rank - 1) % 4 as batch_pos, case when teacher_label in ('keep', 'edit', 'rewrite', 'translate', 'invalid') then teacher_label else 'invalid' end as label from c)"""
ITEMS = f"""{CAND},
 i as (select batch_idx, batch_pos, id, case batch_idx % 7 when 5 then 'failed' when 0 then 'not_json' when 2 then 'unknown_label' when 3 then 'wrong_ids' else 'ok' end as parse_status, label as l, coalesce(target, '') as t from b),
 x as (select batch_idx, batch_pos, id, parse_status, case when parse_status = 'ok' then l end as label, case when parse_status = 'ok' and l <> 'invalid' then t end as final_translation,
  case when parse_status = 'ok' and l = 'invalid' then '사유 없음' end as invalid_reason_ko, 0::BIGINT as error_count from i),
 y as (select *, case when parse_status <> 'ok' or label is null then 'missing_or_unparsed_teacher_item' when label = 'invalid' then 'teacher_invalid' when not {Q.has_text('final_translation')} then 'empty_teacher_translation'
  when {Q.word_count('final_translation')} > {MOST} then 'teacher_output_too_long' when not contains(final_translation, '니다') then 'teacher_low_hangul_other' end as reject_reason from x)"""
SHARD6 = "(('0x' || substr(sha256(id), 1, 16))::HUGEINT % 6)"

QUERIES = {
    "teacher_json_parse": parse,
    "teacher_decision": decisions,
    "accept_until_target": accepted,
    "reject_histogram": reject_counts,
    "label_ratios": ratios,
    "batch_prompts": prompts,
    "artifact_union": union,
    "resume_states": resumed,
    "refill_windows": refilled,
    "teacher_summary": summary,
}

SQL = {
    "teacher_json_parse": f"with {ITEMS} select batch_idx, batch_pos, id, parse_status, label, final_translation, invalid_reason_ko, error_count from x",
    "teacher_decision": f"with {ITEMS} select batch_idx, batch_pos, id, reject_reason from y",
    "accept_until_target": f"""with {ITEMS}, r as (select *, sum(case when reject_reason is null then 1 else 0 end) over (order by batch_idx, batch_pos) as run from y)
 select batch_idx, batch_pos, id, reject_reason, case when reject_reason is null then run end::BIGINT as accept_rank from r where run - (case when reject_reason is null then 1 else 0 end) < {TARGET}""",
    "reject_histogram": f"with {ITEMS} select reject_reason, count(*)::BIGINT as items from y where reject_reason is not null group by 1",
    "label_ratios": """with n as (select teacher_label as label, count(*) as n from golden_pairs where teacher_label is not null group by 1), l as (select unnest(['keep', 'edit', 'rewrite', 'translate']) as label)
 select coalesce(l.label, n.label) as label, coalesce(n.n, 0)::BIGINT as n, coalesce(n.n, 0)::DOUBLE / greatest((select sum(n) from n), 1)::DOUBLE as share from l full join n on l.label = n.label""",
    "batch_prompts": f"""with {CAND} select batch_idx, string_agg(id, ',' order by batch_pos) as item_ids,
 string_agg('[ITEM ' || (batch_pos + 1)::VARCHAR || ']' || chr(10) || 'id: ' || id || chr(10) || 'source: ' || source || chr(10) || 'draft: ' || coalesce(target, ''), chr(10) || chr(10) order by batch_pos) as items_text from b group by 1""",
    "artifact_union": f"""with {ITEMS}, n as (select count(distinct batch_idx) as n, count(*) as i from b), r as (select count(*) as r from y where reject_reason is not null)
 select 'teacher_request' as record_type, n::BIGINT as records, n::BIGINT as with_batch, 0::BIGINT as with_id from n union all select 'teacher_raw_response', n, n, 0 from n
 union all select 'teacher_parsed_item', i, i, i from n union all select 'teacher_rejected_row', r, 0, r from r""",
    "resume_states": f"with {CAND} select id, selection_rank, case {SHARD6} when 0 then 'accepted' when 1 then 'retry' when 2 then 'rejected' else 'pending' end as state from c",
    "teacher_summary": f"""with {ITEMS} select count(*)::BIGINT as requested, count_if(reject_reason is null)::BIGINT as acceptable, count_if(reject_reason is not null)::BIGINT as rejected,
 greatest(0, {TARGET} - count_if(reject_reason is null))::BIGINT as shortfall, sum(error_count)::BIGINT as errors from y""",
}
