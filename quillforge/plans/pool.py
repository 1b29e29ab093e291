"""Queries on the source pool and on selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.functions import text as T
from quillforge.operators import joins as J
from quillforge.operators import pool as P
from quillforge.operators import selection as S
from quillforge.plans import sql as Q
from quillforge.sources.tables import table

K, SUBSET, SHARDS = 400, 500, 7


def normalized(s: SparkSession, d: str) -> DataFrame:
    return P.normalized(table(s, d, "cycle")).select("order_idx", "id", "source", "target", "corpus", F.size("metadata").cast("bigint").alias("meta_entries"))


def lengths(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "cycle").select("order_idx", P.token_length(F.col("source_tokens"), F.col("source")).alias("length"), T.word_count("source").alias("words"))


def histogram(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "cycle").select(P.bucket_of(P.token_length(F.col("source_tokens"), F.col("source"))).alias("length_bucket_idx"))
    return P.bucket_histogram(rows, "length_bucket_idx")


def quota(s: SparkSession, d: str) -> DataFrame:
    rows = histogram(s, d).orderBy("length_bucket_idx").collect()
    shares = S.quotas(1000, [float(r["rows"]) for r in rows])
    return s.createDataFrame([(r["length_bucket_idx"], r["rows"], q) for r, q in zip(rows, shares)], "length_bucket_idx bigint, rows bigint, quota bigint")


def subset_assign(s: SparkSession, d: str) -> DataFrame:
    return P.subsets(table(s, d, "cycle").select("order_idx", "id"), SUBSET).select("order_idx", "id", "pool_position", "subset_idx", "subset_order")


def exact_subset(s: SparkSession, d: str) -> DataFrame:
    return P.exact_shuffle(table(s, d, "cycle").select("order_idx", "id"))


def shards(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "cycle")
    n = c.count()
    key = F.when(T.has_text(F.col("id")), F.col("id")).otherwise(F.format_string("row_%012d", "order_idx"))
    return c.select("order_idx", "id", P.hash_shard(key, SHARDS).alias("hash_shard"), P.order_shard(F.col("order_idx"), F.lit(n), SHARDS).alias("order_shard"))


def template_assign(s: SparkSession, d: str) -> DataFrame:
    c = P.normalized(table(s, d, "cycle")).select("order_idx", "id")
    return c.select("order_idx", "id", P.template_index(F.col("id"), 12, 42).alias("template_idx"), P.weighted_choice(F.col("id"), [("한국어", 0.85), ("한글", 0.10), ("국어", 0.05)], 42).alias("variant"))


def scored(s: SparkSession, d: str) -> DataFrame:
    """Requests with a valid response and a score, each once, with their length bucket."""
    # validity is worked out before the shuffle, so that no text travels
    valid = ((F.col("student_status") == "ok") & T.has_text(F.col("translation"))).alias("valid")
    st = J.latest(table(s, d, "student_translations").select("request_id", "order_idx", "finished_at", valid), ["request_id"], [F.col("finished_at").desc()]).where("valid")
    qe = table(s, d, "qe_scores").where((F.col("qe_status") == "ok") & F.col("qe_score").isNotNull() & ~F.isnan("qe_score")).select("request_id", "qe_score", "scored_at")
    qe = J.latest(qe, ["request_id"], [F.col("scored_at").desc(), F.col("qe_score").desc()])
    cy = table(s, d, "cycle").select("order_idx", P.bucket_of(P.token_length(F.col("source_tokens"), F.col("source"))).alias("length_bucket_idx"))
    return st.join(qe.select("request_id", "qe_score"), "request_id").join(cy, "order_idx").select(F.col("request_id").alias("id"), "qe_score", "length_bucket_idx")


def select(order: str, strategy="proportional"):
    def run(s: SparkSession, d: str) -> DataFrame:
        out = S.stratified_top(scored(s, d), K, order, strategy)
        return out.select("id", "qe_score", "length_bucket_idx", "length_bucket", "selection_rank")

    return run


def global_top(s: SparkSession, d: str) -> DataFrame:
    return S.plain_top(scored(s, d), K, "low").select("id", "qe_score", "selection_rank")


def pending(s: SparkSession, d: str) -> DataFrame:
    """Pool rows without a golden pair. A row without an id has the id made from its position."""
    gold = table(s, d, "golden_pairs").select("id").distinct()
    return P.normalized(table(s, d, "cycle")).select("order_idx", "id").join(gold, "id", "left_anti")


def clean_semi(s: SparkSession, d: str) -> DataFrame:
    """Scores of requests whose response is valid."""
    ok = table(s, d, "student_translations").where((F.col("student_status") == "ok") & T.has_text(F.col("translation"))).select("request_id")
    return table(s, d, "qe_scores").select("request_id", "qe_status", "qe_backend").join(ok, "request_id", "left_semi")


SCORED_SQL = f"""scored as (
 select st.request_id as id, qe.qe_score, c.length_bucket_idx from {Q.LAST_STUDENT} st
 join {Q.LAST_SCORE} qe on qe.request_id = st.request_id
 join (select order_idx, {Q.bucket('(' + Q.token_length('source_tokens', 'source') + ')')} as length_bucket_idx from cycle) c on c.order_idx = st.order_idx
 where st.student_status = 'ok' and {Q.has_text('st.translation')})"""


def select_sql(keys: str, weights: str) -> str:
    """weights: an expression over b (bucket) and n (its rows)."""
    return f"""with {SCORED_SQL},
 n as (select b, (select count(*) from scored where length_bucket_idx = b)::BIGINT as n from (select unnest([0, 1, 2])::BIGINT as b)),
 w as (select b, n, ({weights})::DOUBLE as w from n),
 r as (select b, n, w, least({K}, (select sum(n) from n)) * w / (select sum(w) from w) as raw from w),
 f as (select *, floor(raw) as whole, row_number() over (order by raw - floor(raw) desc, b) as place from r),
 q as (select b, n, w, (whole + case when place <= least({K}, (select sum(n) from n)) - (select sum(whole) from f) then 1 else 0 end)::BIGINT as quota from f),
 k as (select s.*, q.quota, q.w, row_number() over (partition by length_bucket_idx order by {keys}) as in_bucket from scored s join q on q.b = s.length_bucket_idx),
 first as (select * from k where in_bucket <= quota),
 short as (select least({K}, (select sum(n) from q where w > 0)) - (select sum(least(n, quota)) from q) as m),
 rest as (select * from (select *, row_number() over (order by {keys}) as rest from k where in_bucket > quota and w > 0) where rest <= (select m from short)),
 chosen as (select id, qe_score, length_bucket_idx from first union all select id, qe_score, length_bucket_idx from rest)
 select id, qe_score, length_bucket_idx, {Q.bucket_name('length_bucket_idx')} as length_bucket,
  row_number() over (order by length_bucket_idx, {keys})::BIGINT as selection_rank from chosen"""


RANDOM = f"sha256('{S.RANDOM_SALT}|seed=42|' || id), id"

QUERIES = {
    "pool_normalize": normalized,
    "source_token_length": lengths,
    "length_bucket_hist": histogram,
    "bucket_quota": quota,
    "subset_assign": subset_assign,
    "subset_exact_shuffle": exact_subset,
    "row_shards": shards,
    "template_assign": template_assign,
    "select_low": select("low"),
    "select_high": select("high"),
    "select_random": select("random"),
    "select_uniform": select("low", "uniform"),
    "select_weighted_zero_bucket": select("low", [0.0, 1.0, 3.0]),
    "select_global": global_top,
    "pending_candidates": pending,
    "clean_scores": clean_semi,
}

SQL = {
    "pool_normalize": f"""select order_idx, case when {Q.has_text('id')} then id else 'row_' || lpad(order_idx::VARCHAR, 12, '0') end as id, source, target, corpus,
 coalesce(cardinality(metadata), 0)::BIGINT as meta_entries from cycle where {Q.has_text('source')}""",
    "source_token_length": f"select order_idx, {Q.token_length('source_tokens', 'source')} as length, {Q.word_count('source')} as words from cycle",
    "length_bucket_hist": f"""with b as (select {Q.bucket('(' + Q.token_length('source_tokens', 'source') + ')')} as b from cycle)
 select x.b as length_bucket_idx, {Q.bucket_name('x.b')} as length_bucket, (select count(*) from b where b.b = x.b)::BIGINT as rows from (select unnest([0, 1, 2])::BIGINT as b) x""",
    "bucket_quota": f"""with t as (select {Q.bucket('(' + Q.token_length('source_tokens', 'source') + ')')} as b from cycle),
 n as (select x.b, (select count(*) from t where t.b = x.b)::BIGINT as n from (select unnest([0, 1, 2])::BIGINT as b) x),
 r as (select b, n, 1000 * n::DOUBLE / (select sum(n) from n) as raw from n),
 f as (select *, floor(raw) as whole, row_number() over (order by raw - floor(raw) desc, b) as place from r)
 select b as length_bucket_idx, n as rows, (whole + case when place <= 1000 - (select sum(whole) from f) then 1 else 0 end)::BIGINT as quota from f""",
    "subset_assign": f"""with p as (select order_idx, id, row_number() over (order by sha256('42|' || order_idx::VARCHAR), order_idx)::BIGINT - 1 as pool_position from cycle)
 select order_idx, id, pool_position, pool_position // {SUBSET} as subset_idx, pool_position % {SUBSET} as subset_order from p""",
    "row_shards": f"""select order_idx, id, (('0x' || substr(sha256(case when {Q.has_text('id')} then id else 'row_' || lpad(order_idx::VARCHAR, 12, '0') end), 1, 16))::HUGEINT % {SHARDS})::BIGINT as hash_shard,
 least(order_idx * {SHARDS} // greatest((select count(*) from cycle), 1), {SHARDS - 1})::BIGINT as order_shard from cycle""",
    "select_low": select_sql("qe_score, id", "n"),
    "select_high": select_sql("qe_score desc, id", "n"),
    "select_random": select_sql(RANDOM, "n"),
    "select_uniform": select_sql("qe_score, id", "1"),
    "select_weighted_zero_bucket": select_sql("qe_score, id", "case b when 0 then 0 when 1 then 1 else 3 end"),
    "select_global": f"with {SCORED_SQL} select id, qe_score, row_number() over (order by qe_score, id)::BIGINT as selection_rank from scored order by qe_score, id limit {K}",
    "pending_candidates": f"""select order_idx, id from (select order_idx, case when {Q.has_text('id')} then id else 'row_' || lpad(order_idx::VARCHAR, 12, '0') end as id from cycle where {Q.has_text('source')})
 where id not in (select id from golden_pairs where id is not null)""",
    "clean_scores": f"select request_id, qe_status, qe_backend from qe_scores where request_id in (select request_id from student_translations where student_status = 'ok' and {Q.has_text('translation')})",
}
