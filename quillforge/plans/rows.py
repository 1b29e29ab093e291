"""Queries on joins, audits, training rows, planning and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillforge.functions import text as T
from quillforge.operators import evaluate as E
from quillforge.operators import joins as J
from quillforge.operators import pool as P
from quillforge.operators import prompting as R
from quillforge.operators import training as TR
from quillforge.plans import sql as Q
from quillforge.sources import files
from quillforge.sources.tables import spread, table

EOS, BATCH = 2, 8
#: The sequence limit of training: input and output tokens and the prompt's overhead.
LIMIT = 1280 + 1500 + 128
PER_DEVICE, WORLD, EFFECTIVE = 4, 4, 128


def students(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "student_translations")


def last_students(s: SparkSession, d: str) -> DataFrame:
    return J.latest(students(s, d), ["request_id"], [F.col("finished_at").desc()])


def request_response(s: SparkSession, d: str) -> DataFrame:
    """Each response beside the pool row that it answers; a response without one would fail the query."""
    st = last_students(s, d).select("request_id", F.col("id").alias("row_id"), "order_idx", "student_status", "generated_token_count")
    c = table(s, d, "cycle").select("order_idx", F.col("id").alias("pool_id"), F.length("source").cast("bigint").alias("source_chars"))
    return J.complete_join(st, c, ["order_idx"]).select("request_id", "order_idx", "row_id", "pool_id", "student_status", F.coalesce("generated_token_count", F.lit(0)).alias("generated_token_count"), "source_chars")


def audit(s: SparkSession, d: str) -> DataFrame:
    return J.response_audit(students(s, d).select("request_id", "id"), table(s, d, "qe_scores").select("request_id", "id"), "request_id", "id").groupBy("side").agg(F.count("*").alias("requests"))


def repeated(s: SparkSession, d: str) -> DataFrame:
    return J.duplicates(students(s, d), "request_id")


def first_missing(s: SparkSession, d: str) -> DataFrame:
    missing = students(s, d).select("request_id").join(table(s, d, "qe_scores").select("request_id"), "request_id", "left_anti")
    return J.first_examples(missing, "request_id", 5).select(F.array_join("examples", ",").alias("examples"))


def last_events(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest_status"), F.count("*").alias("events"))


def key_coverage(s: SparkSession, d: str) -> DataFrame:
    a = students(s, d).select(F.regexp_replace("request_id", "^run-[a-z]+/", "run/").alias("key"), F.lit("a").alias("side"))
    b = table(s, d, "qe_scores").select(F.regexp_replace("request_id", "^run-[a-z]+/", "run/").alias("key"), F.lit("b").alias("side"))
    return J.coverage(a.unionByName(b))


def summary_upsert(s: SparkSession, d: str) -> DataFrame:
    st = students(s, d)

    def part(where):
        by = st.where(where).groupBy("corpus").agg(F.count("*").alias("rows"), F.sum(F.coalesce("generated_token_count", F.lit(0))).alias("tokens"))
        return by.withColumn("position", (F.row_number().over(Window.orderBy("corpus")) - 1).cast("bigint"))

    return J.upsert(part((F.col("run_id") == "run-hazel") & (F.col("corpus") < "p")), part(F.col("run_id") == "run-maple"), "corpus")


def pool_prompts(s: SparkSession, d: str) -> DataFrame:
    c = P.normalized(table(s, d, "cycle"))
    out = R.requests(c, table(s, d, "prompt_templates"), "run-x", F.floor(F.col("order_idx") / 1000).cast("bigint"))
    return out.select("request_id", "order_idx", "subset_idx", "prompt", "prompt_template_id", "prompt_template_group", "prompt_template_hash")


def gold(s: SparkSession, d: str) -> DataFrame:
    """Golden pairs with a place from 1: in the order of hashed ids, repeated ids by their time."""
    g = table(s, d, "golden_pairs").withColumn("_key", F.sha2(F.coalesce("id", F.lit("")), 256))
    return P.positions(g, "_key", ["accepted_at"], "_place").withColumn("_place", F.col("_place") + 1).drop("_key")


def training(s: SparkSession, d: str) -> DataFrame:
    return TR.training_rows(gold(s, d), F.concat(F.lit("Translate: "), F.coalesce("source", F.lit("")), F.lit("\nKorean:")), ["_place"])


def word_ids(s: SparkSession, d: str) -> DataFrame:
    """Whole rows as ids of prompt and response."""
    ids = lambda c: F.transform(T.raw_words(c), lambda w: F.length(w))
    return training(s, d).select("id", "order_idx", ids("source").alias("prompt_ids"), ids("target").alias("response_ids"))


def masked(s: SparkSession, d: str) -> DataFrame:
    """Whole rows: one over the sequence limit fails the query. Word lengths stand in for token ids, so that both engines have the same."""
    x = word_ids(s, d).withColumn("y", TR.whole_labels(F.col("id"), F.col("prompt_ids"), F.col("response_ids"), EOS, LIMIT))
    return x.select("id", "order_idx", "y.input_ids", "y.labels", "y.prompt_tokens", "y.response_tokens")


def shown(x: DataFrame) -> DataFrame:
    return x.select("id", "order_idx", F.array_join("input_ids", " ").alias("input_ids"), F.array_join("labels", " ").alias("labels"), "prompt_tokens", "response_tokens")


def label_mask(s: SparkSession, d: str) -> DataFrame:
    return shown(masked(s, d))


def batch_padding(s: SparkSession, d: str) -> DataFrame:
    return batches(masked(s, d))


def batches(rows: DataFrame) -> DataFrame:
    x = TR.padded_batches(rows, "order_idx", BATCH, 0)
    return x.select("id", "order_idx", "batch_idx", F.size("input_ids").cast("bigint").alias("width"), F.array_join("attention_mask", "").alias("attention_mask"), F.array_join("labels", " ").alias("labels"))


def stage_padding(s: SparkSession, d: str) -> DataFrame:
    g = gold(s, d).select("id", (F.col("_place") - 1).alias("order_idx"))
    acc = TR.accumulation(EFFECTIVE, PER_DEVICE, WORLD)
    return J.padded(g, "order_idx", TR.padded_rows(g.count(), PER_DEVICE, WORLD, acc))


def steps(s: SparkSession, d: str) -> DataFrame:
    sizes = students(s, d).groupBy("subset_idx").agg(F.countDistinct("order_idx").alias("rows"))
    return TR.step_plan(sizes, PER_DEVICE, WORLD, EFFECTIVE)


def cadence(s: SparkSession, d: str) -> DataFrame:
    every = s.range(2, 23).select(F.col("id").alias("subset_idx"))
    n = students(s, d).groupBy("subset_idx").agg(F.count("*").alias("rows"))
    return TR.evaluated(every, 3, 0, 23, True).join(n, "subset_idx", "left").select("subset_idx", "evaluate", F.coalesce("rows", F.lit(0)).alias("rows"))


def metric_means(s: SparkSession, d: str) -> DataFrame:
    x = E.metric_means(table(s, d, "qe_scores"), ["qe_backend", "qe_model"], "qe_score")
    return x.withColumn("mean_score", F.round("mean_score", 9))


def usage(s: SparkSession, d: str) -> DataFrame:
    u = students(s, d).select("model_name", F.create_map(F.lit("completion_tokens"), F.col("generated_token_count").cast("string"), F.lit("prompt_tokens"), F.length("prompt_template_id").cast("string")).alias("usage"))
    return E.usage_totals(u, "usage", ["prompt_tokens", "completion_tokens", "total_tokens"])


def translated(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "cycle").select("order_idx", "target")
    st = spread(students(s, d).select("request_id", "order_idx", "model_name", "translation", "student_status", "finished_at"))
    last = J.latest(st, ["request_id"], [F.col("finished_at").desc()]).where("student_status = 'ok' and translation is not null")
    return last.select("request_id", "order_idx", "model_name", "translation").join(t.where("target is not null"), "order_idx")


def bleu_statistics(s: SparkSession, d: str) -> DataFrame:
    return E.bleu_statistics(translated(s, d), "translation", "target").drop("translation", "target", "order_idx", "model_name")


def bleu(s: SparkSession, d: str) -> DataFrame:
    x = E.bleu_score(E.bleu_statistics(translated(s, d), "translation", "target"), ["model_name"])
    return x.select("model_name", "out_len", "ref_len", "match_1", "total_1", "match_4", "total_4", F.round("bleu", 6).alias("bleu"))


def chrf(s: SparkSession, d: str) -> DataFrame:
    return E.chrf_score(E.chrf_statistics(translated(s, d), "translation", "target"), ["model_name"]).select("model_name", F.round("chrf", 6).alias("chrf"))


def nested(s: SparkSession, d: str) -> DataFrame:
    """Response and score as one nested record a request."""
    qe = J.latest(table(s, d, "qe_scores").select("request_id", "qe_score", "qe_status", "qe_model", "scored_at"), ["request_id"], [F.col("scored_at").desc(), F.col("qe_score").desc_nulls_last(), F.col("qe_model")])
    x = last_students(s, d).join(qe, "request_id", "left")
    return x.select(
        "request_id", F.struct("id", "translation", "student_status", "finish_reason").alias("student"),
        F.when(F.col("qe_status").isNotNull(), F.struct("qe_score", "qe_status", "qe_model")).alias("qe"))


def compact_record(s: SparkSession, d: str) -> DataFrame:
    """The nested record, taken apart again."""
    n = nested(s, d)
    score = F.when(F.isnan("qe.qe_score"), F.lit(None)).otherwise(F.col("qe.qe_score"))
    return n.select("request_id", "student.id", "student.student_status", "student.finish_reason", score.alias("qe_score"), "qe.qe_status", F.col("qe").isNotNull().alias("has_score"))


def subset_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows of each subset of a stated range, absent and empty ones included."""
    n = students(s, d).groupBy("subset_idx").agg(F.count("*").alias("n"))
    every = s.range(0, 30).select(F.col("id").alias("subset_idx"))
    return every.join(n, "subset_idx", "left").select("subset_idx", F.coalesce("n", F.lit(0)).alias("rows"), F.col("n").isNull().alias("missing"))


def token_totals(s: SparkSession, d: str) -> DataFrame:
    """Rows and tokens by run and model, with the totals of each run and of all."""
    x = students(s, d).rollup("run_id", "model_name").agg(F.count("*").alias("rows"), F.sum(F.coalesce("generated_token_count", F.lit(0))).alias("tokens"))
    return x.select(F.coalesce("run_id", F.lit("all")).alias("run_id"), F.coalesce("model_name", F.lit("all")).alias("model_name"), "rows", "tokens")


def jsonl_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Golden pairs written as JSON lines and read back under a declared schema."""
    g = table(s, d, "golden_pairs").select("id", "source", "target", "teacher_label", "teacher_accept_rank")
    path = files.scratch(s, "golden_jsonl")
    files.write_jsonl(g, path)
    return files.read_jsonl(s, path, "id string, source string, target string, teacher_label string, teacher_accept_rank bigint")


def csv_summary(s: SparkSession, d: str) -> DataFrame:
    path = files.scratch(s, "summary_csv")
    x = students(s, d).groupBy("corpus").agg(F.count("*").alias("rows"), F.countDistinct("request_id").alias("requests"))
    files.write_csv(x, path, ["corpus", "rows"])
    return files.read_csv(s, path, "corpus string, rows bigint, requests bigint")


GOLD = "(select *, row_number() over (order by sha256(coalesce(id, '')), accepted_at) as place from golden_pairs)"
TRAIN = f"""t as (select id, place - 1 as order_idx, source, {Q.strip('target')} as target, 'Translate: ' || coalesce(source, '') || chr(10) || 'Korean:' as p
 from {GOLD} where {Q.has_text('source')} and {Q.has_text('target')})"""
IDS = lambda c: f"list_transform(regexp_extract_all({c}, '{Q.WORD}'), lambda x: length(x))"
MASK = f"""{TRAIN}, i as (select id, order_idx, {IDS('source')} as a, {IDS('target')} as b from t),
 m as (select id, order_idx, list_concat(a, b, [{EOS}])[1:{LIMIT}] as ids, list_concat(list_transform(a, lambda x: -100), b, [{EOS}])[1:{LIMIT}] as labels, len(a) as na, len(a) + len(b) + 1 as total from i)"""
ACC = TR.accumulation(EFFECTIVE, PER_DEVICE, WORLD)
BLEU_TOKENS = r"regexp_extract_all(coalesce({c}, ''), '[\p{{L}}\p{{N}}]+|[^\s\x{{0B}}\p{{L}}\p{{N}}]')"
STATS = f"""p as materialized (select st.request_id, st.model_name, {BLEU_TOKENS.format(c='st.translation')} as h, {BLEU_TOKENS.format(c='c.target')} as r
  from {Q.LAST_STUDENT} st join cycle c on c.order_idx = st.order_idx where st.student_status = 'ok' and c.target is not null and st.translation is not null),
 n as (select unnest([1, 2, 3, 4]) as n),
 gh as (select request_id, n, list_slice(h, i, i + n - 1) as g, count(*) as c from (select request_id, n, h, unnest(range(1, len(h) - n + 2)) as i from p, n where len(h) >= n) group by 1, 2, 3),
 gr as (select request_id, n, list_slice(r, i, i + n - 1) as g, count(*) as c from (select request_id, n, r, unnest(range(1, len(r) - n + 2)) as i from p, n where len(r) >= n) group by 1, 2, 3),
 m as (select request_id, n, sum(least(gh.c, gr.c))::BIGINT as c from gh join gr using (request_id, n, g) group by 1, 2),
 b as (select p.request_id, p.model_name, len(h)::BIGINT as out_len, len(r)::BIGINT as ref_len, {", ".join(f"coalesce((select c from m where m.request_id = p.request_id and m.n = {n}), 0)::BIGINT as match_{n}, greatest(0, len(h) - {n - 1})::BIGINT as total_{n}" for n in range(1, 5))} from p)"""
SUM = ", ".join(f"sum({c})::BIGINT as {c}" for c in ["out_len", "ref_len", *(f"{k}_{n}" for n in range(1, 5) for k in ("match", "total"))])

QUERIES = {
    "request_response_join": request_response,
    "response_audit": audit,
    "duplicate_requests": repeated,
    "first_missing": first_missing,
    "latest_status": last_events,
    "key_coverage": key_coverage,
    "matrix_upsert": summary_upsert,
    "prompt_requests": pool_prompts,
    "sft_rows": training,
    "label_mask": label_mask,
    
    "batch_padding": batch_padding,
    
    "stage_padding": stage_padding,
    "step_plan": steps,
    "eval_cadence": cadence,
    "metric_means": metric_means,
    "usage_totals": usage,
    "bleu_stats": bleu_statistics,
    "bleu_score": bleu,
    "chrf_score": chrf,
    "compact_record": compact_record,
    "subset_rows": subset_rows,
    "token_rollup": token_totals,
    "jsonl_round_trip": jsonl_round_trip,
    "csv_summary": csv_summary,
}

SQL = {
    "request_response_join": f"""select st.request_id, st.order_idx, st.id as row_id, c.id as pool_id, st.student_status, coalesce(st.generated_token_count, 0) as generated_token_count, length(c.source)::BIGINT as source_chars
 from {Q.LAST_STUDENT} st join cycle c on c.order_idx = st.order_idx""",
    "response_audit": """with a as (select request_id, min(id) as a from student_translations group by 1), b as (select request_id, min(id) as b from qe_scores group by 1)
 select case when b.request_id is null then 'missing' when a.request_id is null then 'extra' when a.a is distinct from b.b then 'mismatched' else 'matched' end as side, count(*)::BIGINT as requests
 from a full join b on a.request_id = b.request_id group by 1""",
    "duplicate_requests": "select request_id, count(*)::BIGINT as occurrences from student_translations group by 1 having count(*) > 1",
    "first_missing": """select coalesce(string_agg(request_id, ',' order by request_id), '') as examples from (select distinct request_id from student_translations
 where request_id not in (select request_id from qe_scores) order by 1 limit 5)""",
    "latest_status": "select user_id, arg_max(event_type, row(ts, event_id)) as latest_status, count(*)::BIGINT as events from events group by 1",
    "key_coverage": """with a as (select distinct regexp_replace(request_id, '^run-[a-z]+/', 'run/') as k from student_translations), b as (select distinct regexp_replace(request_id, '^run-[a-z]+/', 'run/') as k from qe_scores),
 n as (select count_if(a.k is not null and b.k is not null)::BIGINT as matched, count_if(b.k is null)::BIGINT as only_a, count_if(a.k is null)::BIGINT as only_b from a full join b on a.k = b.k)
 select *, matched::DOUBLE / greatest(matched + only_a, 1) as share_a, matched::DOUBLE / greatest(matched + only_b, 1) as share_b from n""",
    "matrix_upsert": """with g as (select run_id, corpus, count(*)::BIGINT as rows, sum(coalesce(generated_token_count, 0))::BIGINT as tokens from student_translations group by 1, 2),
 o as (select corpus, rows, tokens, row_number() over (order by corpus) - 1 as position from g where run_id = 'run-hazel' and corpus < 'p'),
 n as (select corpus, rows, tokens, row_number() over (order by corpus) - 1 as position from g where run_id = 'run-maple')
 select coalesce(n.corpus, o.corpus) as corpus, coalesce(o.position, (select coalesce(max(position), -1) from o) + row_number() over (partition by o.corpus is null order by n.position, n.corpus))::BIGINT as position,
 case when n.corpus is not null then n.rows else o.rows end as rows, case when n.corpus is not null then n.tokens else o.tokens end as tokens from o full join n on o.corpus = n.corpus""",
    "prompt_requests": f"""with t as (select row_number() over (order by prompt_template_id) - 1 as i, * from prompt_templates),
 c as (select order_idx, case when {Q.has_text('id')} then id else 'row_' || lpad(order_idx::VARCHAR, 12, '0') end as id, source from cycle where {Q.has_text('source')}),
 k as (select *, (('0x' || substr(sha256(id), 1, 16))::HUGEINT % 12)::BIGINT as i, order_idx // 1000 as subset_idx from c)
 select 'run-x/subsets/subset_' || lpad(subset_idx::VARCHAR, 3, '0') || '/' || id || '/student' as request_id, order_idx, subset_idx, replace(t.template_text, '{{source}}', source) as prompt, prompt_template_id, prompt_template_group,
 sha256('system:' || chr(10) || 'user:' || t.template_text) as prompt_template_hash from k join t on t.i = k.i""",
    "sft_rows": f"with {TRAIN} select id, order_idx, source, target, p || chr(10) || target as text, length(p)::BIGINT + 1 as response_start from t",
    "label_mask": f"with {MASK} select id, order_idx, array_to_string(ids, ' ') as input_ids, array_to_string(labels, ' ') as labels, least(na, len(ids))::BIGINT as prompt_tokens, greatest(0, len(ids) - na)::BIGINT as response_tokens from m",
    "batch_padding": f"""with {MASK}, w as (select *, order_idx // {BATCH} as batch_idx, max(len(ids)) over (partition by order_idx // {BATCH}) as width from m)
 select id, order_idx, batch_idx, width::BIGINT as width, repeat('1', len(ids)) || repeat('0', width - len(ids)) as attention_mask, array_to_string(labels, ' ') || repeat(' -100', width - len(labels)) as labels from w""",
    "stage_padding": f"""with g as (select id, place - 1 as order_idx from {GOLD}), n as (select count(*) as n from g), k as (select n, greatest(1, ceil(greatest(1, ceil(greatest(n, 1) / {PER_DEVICE * WORLD})) / {ACC}))::BIGINT * {ACC * PER_DEVICE * WORLD} as total from n)
 select id, order_idx, false as is_padding, order_idx as padded_idx from g union all
 select g.id, g.order_idx, true, n + i from k, (select unnest(range(0, (select total - n from k)::BIGINT)) as i) r join g on g.order_idx = r.i % (select n from n)""",
    "step_plan": f"""with s as (select subset_idx, count(distinct order_idx)::BIGINT as rows from student_translations group by 1),
 u as (select *, greatest(1, ceil(greatest(1, ceil(greatest(rows, 1)::DOUBLE / {PER_DEVICE * WORLD})) / {ACC}))::BIGINT as steps from s)
 select subset_idx, rows, steps, steps * {ACC * PER_DEVICE * WORLD} as padded_rows, sum(steps) over (order by subset_idx)::BIGINT as end_step from u""",
    "eval_cadence": """select r.i as subset_idx, (r.i % 3 = 0 or r.i = 22) as evaluate, (select count(*) from student_translations where subset_idx = r.i)::BIGINT as rows from (select unnest(range(2, 23))::BIGINT as i) r""",
    "metric_means": """select qe_backend, qe_model, count(*)::BIGINT as rows, count(case when not isnan(qe_score) then qe_score end)::BIGINT as scored, round(avg(case when not isnan(qe_score) then qe_score end), 9) as mean_score
 from qe_scores group by 1, 2""",
    "usage_totals": "select sum(length(prompt_template_id))::BIGINT as prompt_tokens, sum(generated_token_count)::BIGINT as completion_tokens, null::BIGINT as total_tokens from student_translations",
    "bleu_stats": f"with {STATS} select request_id, out_len, ref_len, {', '.join(f'match_{n}, total_{n}' for n in range(1, 5))} from b",
    "bleu_score": f"""with {STATS}, s as (select model_name, {SUM} from b group by 1)
 select model_name, out_len, ref_len, match_1, total_1, match_4, total_4, round(case when least(match_1, match_2, match_3, match_4) = 0 then 0.0 else 100 * (case when out_len < ref_len then exp(1 - ref_len::DOUBLE / out_len) else 1.0 end)
 * exp(({' + '.join(f'ln(match_{n}::DOUBLE / total_{n})' for n in range(1, 5))}) / 4) end, 6) as bleu from s""",
    "compact_record": f"""with q as (select * from qe_scores qualify row_number() over (partition by request_id order by scored_at desc, qe_score desc nulls last, qe_model) = 1)
 select st.request_id, st.id, st.student_status, st.finish_reason, case when isnan(q.qe_score) then null else q.qe_score end as qe_score, q.qe_status, q.qe_status is not null as has_score
 from {Q.LAST_STUDENT} st left join q on q.request_id = st.request_id""",
    "subset_rows": """with n as (select subset_idx, count(*) as n from student_translations group by 1)
 select r.i as subset_idx, coalesce(n.n, 0)::BIGINT as rows, n.n is null as missing from (select unnest(range(0, 30))::BIGINT as i) r left join n on n.subset_idx = r.i""",
    "token_rollup": """select coalesce(run_id, 'all') as run_id, coalesce(model_name, 'all') as model_name, count(*)::BIGINT as rows, sum(coalesce(generated_token_count, 0))::BIGINT as tokens
 from student_translations group by rollup (run_id, model_name)""",
    "jsonl_round_trip": "select id, source, target, teacher_label, teacher_accept_rank from golden_pairs",
    "csv_summary": "select corpus, count(*)::BIGINT as rows, count(distinct request_id)::BIGINT as requests from student_translations group by 1",
}
SQL["prompt_requests"] = SQL["prompt_requests"].replace("{{source}}", "{source}")
