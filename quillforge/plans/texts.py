"""Queries on text features and on degenerate output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.functions import text as T
from quillforge.functions.repeats import unit_runs
from quillforge.operators import degeneration as D
from quillforge.operators import splitter as X
from quillforge.plans import sql as Q
from quillforge.sources.tables import spread, table


def students(s: SparkSession, d: str) -> DataFrame:
    """The columns that the text queries read."""
    return spread(table(s, d, "student_translations").select("request_id", "order_idx", "translation", "student_status", "finish_reason", "corpus"))


def pairs(s: SparkSession, d: str) -> DataFrame:
    return students(s, d).join(table(s, d, "cycle").select("order_idx", "source"), "order_idx")


def script_counts(s: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("translation", F.lit(""))
    return students(s, d).select("request_id", *(v.alias(k) for k, v in T.script_counts(t).items()), F.length(t).cast("bigint").alias("chars"), T.mixed_script_words(t).alias("mixed_words"))


def overlap(s: SparkSession, d: str) -> DataFrame:
    src, out = F.coalesce("source", F.lit("")), F.coalesce("translation", F.lit(""))
    return pairs(s, d).select("request_id", T.source_overlap(src, out).alias("source_overlap"), T.output_precision(src, out).alias("output_precision"), T.has_auxiliary(out).alias("auxiliary"))


def tokens(s: SparkSession, d: str) -> DataFrame:
    return students(s, d).select("request_id", T.bounded(T.words(F.coalesce("translation", F.lit(""))), 500).alias("tokens"))


def token_features(s: SparkSession, d: str) -> DataFrame:
    t = F.col("tokens")
    return tokens(s, d).select("request_id", F.size(t).cast("bigint").alias("tokens"), T.longest_run(t).alias("word_run"), T.most_equal(t).alias("top_token"), T.most_equal(T.function_words(t)).alias("top_function_word"))


def ngrams(low: int, high: int):
    def run(s: SparkSession, d: str) -> DataFrame:
        x = tokens(s, d).withColumn("r", T.ngram_repeat(F.col("tokens"), low, high))
        return x.select("request_id", F.col("r.count").alias("repeats"), F.col("r.n").alias("n"), F.col("r.coverage").alias("coverage"))

    return run


def clauses(s: SparkSession, d: str) -> DataFrame:
    x = students(s, d).select("request_id", T.clause_duplication(F.coalesce("translation", F.lit(""))).alias("c"))
    return x.select("request_id", F.col("c.count").alias("most_equal"), F.col("c.ratio").alias("doubled_share"))


def spans(s: SparkSession, d: str) -> DataFrame:
    x = tokens(s, d).withColumn("r", T.span_repeat(F.col("tokens")))
    return x.select("request_id", "r.run", "r.span", "r.score")


def char_runs(s: SparkSession, d: str) -> DataFrame:
    return students(s, d).select("request_id", unit_runs(F.coalesce("translation", F.lit(""))).alias("char_run"))


def labels(t: D.Thresholds | None = None):
    def run(s: SparkSession, d: str) -> DataFrame:
        x = D.classify(pairs(s, d), "source", "translation", "student_status", "finish_reason", t)
        return x.select("request_id", "degeneration_label", F.array_join("degeneration_flags", ",").alias("flags"))

    return run


WITHOUT_REPETITION = D.Thresholds(checks=D.Thresholds().checks - {"repetition"})


def label_summary(t: D.Thresholds | None = None):
    def run(s: SparkSession, d: str) -> DataFrame:
        x = D.classify(pairs(s, d), "source", "translation", "student_status", "finish_reason", t)
        return D.label_summary(x, ["corpus"])

    return run


def validity(s: SparkSession, d: str) -> DataFrame:
    x = D.filtered(students(s, d), "translation", "translation", "student_status", "finish_reason", "basic")
    return x.groupBy("degeneration_label", "filter_enabled", "basic_validity_only").agg(F.count("*").alias("rows"))


def chunks(s: SparkSession, d: str) -> DataFrame:
    c = spread(table(s, d, "cycle").select("order_idx", "id", "source", "metadata"))
    return X.split_rows(c, "source", 256, "order_idx").select("order_idx", "id", "chunk_idx", "chunk_count", "source", F.map_entries("metadata").alias("metadata"))


def chunk_counters(s: SparkSession, d: str) -> DataFrame:
    return X.counters(X.split_rows(spread(table(s, d, "cycle").select("order_idx", "source").where("source is not null")), "source", 256, "order_idx"), "order_idx")


T0 = "coalesce(translation, '')"
KEY = "request_id"
TOKENS = f"(select request_id, row_number() over () as r, {Q.bounded(Q.words(T0))} as t from student_translations)"
NGRAM_IGNORED = ", ".join("['" + "', '".join(x) + "']" for x in T.IGNORED_BIGRAMS)


def ngram_sql(low: int, high: int) -> str:
    sizes = [n for n in (2, 3, 4, 6, 8, 12) if low <= n <= high]
    return f"""with k as materialized {TOKENS},
 n as (select unnest({sizes}) as n),
 g as (select r, n, list_slice(t, i, i + n - 1) as g from (select r, n, t, unnest(range(1, len(t) - n + 2)) as i from k, n where len(t) >= 2 * n)),
 f as (select r, n, g, count(*) as c from g where not (n <= 3 and len(list_distinct(g)) = 1) and g not in ({NGRAM_IGNORED}) group by r, n, g),
 m as (select r, n, max(c) as c from f group by r, n),
 b as (select r, n, c from m qualify row_number() over (partition by r order by c * n desc, n) = 1)
 select k.request_id, coalesce(b.c, 1)::BIGINT as repeats, coalesce(b.n, 0)::BIGINT as n,
  (case when b.n is null then 0.0 else least(1.0, (b.c * b.n)::DOUBLE / greatest(len(k.t), 1)) end)::DOUBLE as coverage from k left join b on b.r = k.r"""


def re2(pattern: str) -> str:
    """A pattern of the classifier in RE2's syntax, as a SQL string."""
    head, _, body = pattern.partition(")")
    flags = head.removeprefix("(?").replace("U", "").replace("d", "")
    return "'" + ("(?" + flags + ")" + body).replace("'", "''") + "'"


FINAL = "'[.!?。！？…\"'')\\]”’]$'"
SUFFIX_SQL = "(" + " or ".join(f"ends_with(t, '{x}')" for x in D.SUFFIXES) + ")"
PARTICLE_SQL = "(" + " or ".join(f"ends_with(t, '{x}')" for x in D.PARTICLES) + ")"
AUX_SQL = "[" + ", ".join(f"'{x}'" for x in T.AUXILIARIES) + "]"
LABELS_SQL = f"""p as (
 select st.request_id, st.corpus, st.student_status as status, lower(st.finish_reason) as finish, coalesce({Q.strip('st.translation')}, '') as t, coalesce(c.source, '') as s
 from student_translations st join cycle c on c.order_idx = st.order_idx),
 q as (select *, length(t) as n, length(s) as m, {Q.count('t', '[가-힣]')} as hangul, {Q.count('t', Q.LATIN)} as latin, {Q.count('t', Q.LATIN_X)} as latinx,
  {Q.count('t', Q.CJK)} + {Q.count('t', Q.KANA)} + {Q.count('t', Q.OTHER)} as wrong,
  list_distinct({Q.long_words('s')}) as sw, {Q.long_words('t')} as tw, {Q.rstrip('s')} as sr from p),
 v as (select *, hangul::DOUBLE / greatest(n, 1) as rh, latin::DOUBLE / greatest(n, 1) as rl, (latin + latinx)::DOUBLE / greatest(n, 1) as rx,
  case when len(sw) = 0 then 0.0 else len(list_intersect(sw, list_distinct(tw)))::DOUBLE / len(sw) end as overlap,
  case when len(sw) = 0 or len(tw) = 0 then 0.0 else len(list_filter(tw, lambda x: list_contains(sw, x)))::DOUBLE / len(tw) end as precise from q),
 a as (select *, regexp_matches(t, {re2(D.ARTIFACT)}) as a1, regexp_matches(t, {re2(D.LABEL)}) and n >= 8 and (rx >= 0.20 or rh <= 0.45) as a2, regexp_matches(t, {re2(D.PREAMBLE)}) as a3 from v),
 f as (select *, list_filter([
  case when contains(t, '�') then 'encoding_replchar' end,
  case when regexp_matches(t, {re2(D.THINKING)}) then 'thinking_trace' end,
  case when a1 or a2 or a3 then 'prompt_artifact' end, case when a1 then 'prompt_artifact_instruction' end, case when a2 then 'prompt_artifact_label' end, case when a3 then 'prompt_artifact_preamble' end,
  case when (rh < 0.05 and rl > 0.50 and overlap >= 0.55)
    or (n >= 6 and m >= 20 and rh < 0.05 and rl > 0.50 and precise >= 0.80 and len({Q.words('t')}) <= 12 and len({Q.words('s')}) >= 5)
    or (n >= 40 and rh < 0.05 and rx >= 0.35 and overlap >= 0.55 and len(list_intersect({Q.words('s')}, {AUX_SQL})) > 0 and len(list_intersect({Q.words('t')}, {AUX_SQL})) > 0) then 'english_passthrough' end,
  case when wrong >= 5 or regexp_matches(t, '[\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{3040}}-\\x{{30FF}}]{{4,}}') then 'wrong_script_heavy' end,
  case when n >= 30 and wrong >= 3 then 'wrong_script_light' end,
  case when coalesce(finish in ('length', 'max_tokens'), false)
    or (n >= 30 and not regexp_matches(t, {FINAL}) and regexp_matches(sr, {FINAL}) and not regexp_matches(sr, '\\b[A-Z]\\.$') and ({SUFFIX_SQL} or (n >= 80 and {PARTICLE_SQL})))
    or (m >= 160 and n < greatest(12, floor(m * 0.12))) then 'truncation' end,
  case when n > greatest(1000, m * 4) then 'length_explosion' end,
  case when n >= 40 and rh < 0.15 and wrong > 0 then 'low_hangul_other' end], lambda x: x is not null) as found from a),
 l as (select request_id, corpus, case when status is null or status <> 'ok' then ['invalid_status'] when n = 0 then ['empty'] else found end as flags from f)"""

QUERIES = {
    "script_counts": script_counts,
    "token_overlap": overlap,
    "token_features": token_features,
    "ngram_repeat": ngrams(3, 12),
    "short_ngram": ngrams(2, 2),
    "clause_dup": clauses,
    "immediate_span": spans,
    "char_repeat": char_runs,
    "degeneration_labels": labels(),
    "degeneration_labels_plain": labels(D.plain()),
    "degeneration_checks": labels(WITHOUT_REPETITION),
    "filter_summary": label_summary(),
    "basic_validity": validity,
    "chunk_explode": chunks,
    "preprocess_counters": chunk_counters,
}

SQL = {
    "script_counts": f"""select {KEY}, {Q.count(T0, '[가-힣]')} as hangul, {Q.count(T0, Q.LATIN)} as latin, {Q.count(T0, Q.LATIN_X)} as latin_ext, {Q.count(T0, Q.CJK)} as cjk,
 {Q.count(T0, Q.KANA)} as kana, {Q.count(T0, Q.OTHER)} as other, length({T0})::BIGINT as chars,
 len(list_filter(regexp_extract_all({T0}, '{Q.WORD}'), lambda x: length(x) >= 5 and regexp_matches(x, '[가-힣]') and regexp_matches(x, '{Q.LATIN}|{Q.LATIN_X}')))::BIGINT as mixed_words
 from student_translations""",
    "token_overlap": f"""with p as (select st.request_id, list_distinct({Q.long_words("coalesce(c.source, '')")}) as s, {Q.long_words("coalesce(st.translation, '')")} as m,
 {Q.words("coalesce(st.translation, '')")} as w from student_translations st join cycle c on c.order_idx = st.order_idx)
 select {KEY}, case when len(s) = 0 then 0.0 else len(list_intersect(s, list_distinct(m)))::DOUBLE / len(s) end as source_overlap,
 case when len(s) = 0 or len(m) = 0 then 0.0 else len(list_filter(m, lambda x: list_contains(s, x)))::DOUBLE / len(m) end as output_precision,
 len(list_intersect(w, {AUX_SQL})) > 0 as auxiliary from p""",
    "token_features": f"""with k as materialized {TOKENS},
 e as (select r, unnest(t) as w, generate_subscripts(t, 1) as i from k),
 runs as (select r, max(c) as c from (select r, w, g, count(*) as c from (select r, w, i - row_number() over (partition by r, w order by i) as g from e) group by r, w, g) group by r),
 freq as (select r, max(c) as c, max(case when w in ({", ".join(f"'{x}'" for x in T.KO_FUNCTION_WORDS)}) then c end) as k from (select r, w, count(*) as c from e group by r, w) group by r)
 select k.request_id, len(k.t)::BIGINT as tokens, coalesce(runs.c, 1)::BIGINT as word_run, coalesce(freq.c, 0)::BIGINT as top_token, coalesce(freq.k, 0)::BIGINT as top_function_word
 from k left join runs on runs.r = k.r left join freq on freq.r = k.r""",
    "ngram_repeat": ngram_sql(3, 12),
    "short_ngram": ngram_sql(2, 2),
    "clause_dup": f"""with k as materialized (select {KEY}, row_number() over () as r, list_filter(list_transform(regexp_split_to_array({T0}, '[.!?。！？\\n;；,，]+'),
  lambda x: lower(regexp_replace(x, '[^0-9A-Za-z가-힣\\x{{00C0}}-\\x{{024F}}]+', '', 'g'))), lambda x: length(x) >= 10) as c from student_translations),
 f as (select r, x, count(*) as n from (select r, unnest(c) as x from k) group by r, x), g as (select r, max(n) as n, sum(case when n > 1 then n else 0 end) as d, sum(n) as a from f group by r)
 select k.request_id, coalesce(g.n, 1)::BIGINT as most_equal, coalesce(g.d::DOUBLE / g.a, 0.0) as doubled_share from k left join g on g.r = k.r""",
    "degeneration_checks": f"with {LABELS_SQL} select {KEY}, coalesce(flags[1], 'clean') as degeneration_label, array_to_string(flags, ',') as flags from l",
    "basic_validity": f"""select case when student_status is null or student_status <> 'ok' then 'invalid_status' when not {Q.has_text('translation')} then 'empty' else 'clean' end as degeneration_label,
 false as filter_enabled, true as basic_validity_only, count(*)::BIGINT as rows from student_translations group by 1""",
}
