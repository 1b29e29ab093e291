"""Records of a subset's run: score records, the compact record that joins all stages, its way back into tables, and the checks of artifacts.

Every join is on one key, and a table that may hold a key twice is reduced to one row a key before it is joined. The tables of selected and blocked
rows are small in practice, but nothing here relies on it: adaptive execution broadcasts what it measures to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillforge.functions import text as T
from quillforge.operators import selection as S

# Fields of a student's row that records carry on, and of a selection.
STUDENT = ["student_status", "student_error", "finish_reason", "generated_token_count", "prompt_template_id", "prompt_template_group"]
RANKED = ["selection_rank", "selection_rule", "length_bucket_idx", "length_bucket"]
NO_RANK = 10**12


def one(df: DataFrame, key: str) -> DataFrame:
    """One row a key, the greatest of equal keys, so that a join cannot multiply rows."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(*rest)).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def score_records(requests: DataFrame, responses: DataFrame, rows: DataFrame) -> DataFrame:
    """A record for each score request with its answer and its row. A request without an answer has the status ``missing``; one without a row has
    nulls in the row's fields. requests: id, row_id, order_idx, src, mt, ref, backend, model; responses: id, status, score, error; rows: id, ..."""
    r, a, x = requests.alias("r"), one(responses.select("id", "status", "score", "error"), "id").alias("a"), rows.alias("x")
    joined = r.join(a, F.col("r.id") == F.col("a.id"), "left").join(x, F.col("r.row_id") == F.col("x.id"), "left")
    return joined.select(
        F.col("r.row_id").alias("id"), F.col("r.id").alias("request_id"), F.col("r.order_idx").alias("order_idx"), F.col("r.src").alias("source"),
        F.coalesce("r.ref", "x.target").alias("target"), F.col("x.metadata").alias("metadata"), F.col("x.source_tokens").alias("source_tokens"),
        F.col("r.mt").alias("student_translation"), *(F.col(f"x.{c}").alias(c) for c in STUDENT), F.col("x.degeneration_label").alias("degeneration_label"),
        F.coalesce("x.degeneration_flags", F.array().cast("array<string>")).alias("degeneration_flags"), F.col("x.degeneration_filter_enabled").alias("degeneration_filter_enabled"),
        F.col("r.backend").alias("qe_backend"), F.col("r.model").alias("qe_model"), F.col("r.ref").isNotNull().alias("qe_requires_reference"),
        F.coalesce("a.status", F.lit("missing")).alias("qe_status"), F.col("a.score").cast("double").alias("qe_score"), F.col("a.error").alias("qe_error"))


def compact(rows: DataFrame, requests: DataFrame, responses: DataFrame, selected: DataFrame, blocked: DataFrame) -> DataFrame:
    """One nested record a row: student, filter, qe and selection. ``qe`` is null where there is neither a request nor an answer. All four tables join
    on the row's id; requests and responses bring it as ``row_id``."""
    q = one(requests.select("row_id", "id", "order_idx", "backend", "model", F.col("ref").isNotNull().alias("with_ref")), "row_id").alias("q")
    a = one(responses.select("row_id", "status", "score", "error", "backend", "model"), "row_id").alias("a")
    s, b = (one(t.select("id", *RANKED), "id").alias(n) for t, n in ((selected, "s"), (blocked, "b")))
    x = rows.alias("x")
    has_q, has_a = F.col("q.row_id").isNotNull(), F.col("a.row_id").isNotNull()
    joined = x.join(q, F.col("x.id") == F.col("q.row_id"), "left").join(a, F.col("x.id") == F.col("a.row_id"), "left")
    joined = joined.join(s, F.col("x.id") == F.col("s.id"), "left").join(b, F.col("x.id") == F.col("b.id"), "left")
    either = lambda c: F.when(has_a, F.col(f"a.{c}")).otherwise(F.col(f"q.{c}")).alias(c)
    qe = F.struct(
        either("backend"), either("model"), (has_q & F.coalesce("q.with_ref", F.lit(False))).alias("requires_reference"),
        F.when(has_a, F.coalesce("a.status", F.lit("missing"))).otherwise(F.lit("missing")).alias("status"), F.col("a.score").cast("double").alias("score"),
        F.col("a.error").alias("error"), F.col("q.id").alias("request_id"), F.col("q.order_idx").alias("order_idx"))
    label = F.coalesce("x.degeneration_label", F.lit("unknown"))
    return joined.select(
        F.col("x.id").alias("id"), F.coalesce("x.source", F.lit("")).alias("source"), F.col("x.target").alias("target"), F.col("x.metadata").alias("metadata"),
        F.col("x.source_tokens").alias("source_tokens"),
        F.struct(
            F.coalesce("x.student_translation", F.lit("")).alias("translation"), F.coalesce("x.student_status", F.lit("failed")).alias("status"), F.col("x.student_error").alias("error"),
            F.col("x.finish_reason").alias("finish_reason"), F.coalesce("x.generated_token_count", F.lit(0)).cast("bigint").alias("generated_token_count"),
            F.col("x.request_id").alias("request_id"), F.col("x.order_idx").alias("order_idx"), F.col("x.prompt_template_id").alias("prompt_template_id"),
            F.col("x.prompt_template_group").alias("prompt_template_group")).alias("student"),
        F.struct((label != "clean").alias("filtered"), label.alias("label")).alias("filter"),
        F.when(has_q | has_a, qe).alias("qe"),
        F.struct(
            F.col("s.id").isNotNull().alias("selected_for_teacher"), *(F.col(f"s.{c}").alias(c) for c in RANKED),
            F.col("b.id").isNotNull().alias("blocked_by_filter"), *(F.col(f"b.{c}").alias(f"blocked_{c}") for c in RANKED)).alias("selection"))


def restored(records: DataFrame) -> dict[str, DataFrame]:
    """The way back: ten tables out of the compact records, each a projection of the same scan. Prompts and flags are not kept in a record and come
    back empty. Selected and blocked rows come with their rank, by which a writer orders them; a missing rank goes last (``rank_order``)."""
    row = [F.col("id"), F.col("source"), F.col("target"), F.col("metadata"), F.col("source_tokens")]
    st = {c: F.col(f"student.{c}") for c in ("translation", "status", "error", "finish_reason", "generated_token_count", "request_id", "order_idx", "prompt_template_id", "prompt_template_group")}
    keys = [st["request_id"].alias("id"), F.col("id").alias("row_id"), st["order_idx"].alias("order_idx")]
    templates = [st[c].alias(c) for c in ("prompt_template_id", "prompt_template_group")]
    student = [
        *row, st["translation"].alias("student_translation"), st["status"].alias("student_status"), st["error"].alias("student_error"), st["finish_reason"].alias("finish_reason"),
        st["generated_token_count"].alias("generated_token_count"), st["request_id"].alias("request_id"), st["order_idx"].alias("order_idx"), *templates]
    filtered = [*student, F.col("filter.label").alias("degeneration_label"), F.array().cast("array<string>").alias("degeneration_flags")]
    scored = records.where("qe is not null")
    qe = [F.col("qe.request_id").alias("id"), F.col("id").alias("row_id"), F.col("qe.order_idx").alias("order_idx"), F.col("qe.backend").alias("backend"), F.col("qe.model").alias("model")]
    candidate = [*filtered, F.col("qe.score").alias("qe_score"), F.col("qe.backend").alias("qe_backend"), F.col("qe.model").alias("qe_model")]

    def ranked(flag: str, prefix: str) -> DataFrame:
        chosen = records.where(F.col(f"selection.{flag}"))
        return chosen.select(*candidate, *(F.col(f"selection.{prefix}{c}").alias(c) for c in RANKED))

    return {
        "input": records.select(*row),
        "requests": records.select(*keys, F.col("source"), F.col("metadata"), F.lit("").alias("prompt"), *templates),
        "responses": records.select(*keys, st["status"].alias("status"), st["translation"].alias("mt"), st["error"].alias("error"), st["finish_reason"].alias("finish_reason"), st["generated_token_count"].alias("generated_token_count")),
        "student_rows": records.select(*student),
        "filter_rows": records.select(*filtered),
        "qe_requests": scored.select(*qe, F.col("source").alias("src"), st["translation"].alias("mt"), F.when(F.col("qe.requires_reference"), F.col("target")).alias("ref")),
        "qe_responses": scored.select(*qe, F.col("qe.status").alias("status"), F.col("qe.score").alias("score"), F.col("qe.error").alias("error")),
        "qe_scores": scored.select("id", F.col("qe.request_id").alias("request_id"), F.col("qe.score").alias("qe_score")),
        "selected": ranked("selected_for_teacher", ""),
        "blocked": ranked("blocked_by_filter", "blocked_"),
    }


def rank_order(rank: Column) -> Column:
    """The key by which ranked rows are written: a missing rank is last."""
    return F.coalesce(rank.cast("bigint"), F.lit(NO_RANK))


def raw_random(rows: DataFrame, k: int, strategy: str | list[float] = "proportional", order: str = "random", seed: int = 42) -> DataFrame:
    """The baseline that selects raw rows without scores, by bucket quotas in the random order. Columns of a student's row that ``rows`` lacks come
    with their defaults; a column that is there stays, nulls included. Any other order is an error."""
    if S.ORDERS.get(order) != "random":
        raise ValueError("the baseline without scores selects in random order only")
    chosen = S.stratified_top(rows.withColumn("qe_score", F.lit(None).cast("double")), k, "random", strategy, seed=seed)
    defaults = {"student_translation": F.lit(""), "student_status": F.lit("skipped_raw_random"), "student_error": F.lit(None).cast("string")}
    for c, v in defaults.items():
        if c not in rows.columns:
            chosen = chosen.withColumn(c, v)
    return chosen.withColumns({"qe_backend": F.lit(None).cast("string"), "qe_model": F.lit(None).cast("string"), "selection_rule": F.lit("random_raw_length_bucket_candidate_pool")})


def response_faults(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Faults of an answer table against its requests, one row each kind and key: duplicate_request, no_id, duplicate_response, missing, extra,
    row_mismatch, not_ok. Both tables have id and row_id, responses a status. A key with several answers is compared with each of them."""
    blank = ~T.has_text(F.col("id"))
    a = requests.groupBy("id").agg(F.count("*").alias("_asked"), F.collect_set("row_id").alias("_rows"))
    b = responses.groupBy("id").agg(F.count("*").alias("_got"), F.collect_set("row_id").alias("_answered"), F.bool_and(F.coalesce(F.col("status") == "ok", F.lit(False))).alias("_ok"))
    x = a.alias("a").join(b.alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")), "full").select(F.coalesce("a.id", "b.id").alias("id"), "_asked", "_got", "_rows", "_answered", "_ok")
    both = F.col("_asked").isNotNull() & F.col("_got").isNotNull()
    kinds = {
        "duplicate_request": F.col("_asked") > 1, "no_id": F.col("_got").isNotNull() & F.coalesce(blank, F.lit(True)), "duplicate_response": F.col("_got") > 1, "missing": F.col("_got").isNull(),
        "extra": F.col("_asked").isNull(), "row_mismatch": both & (F.size(F.array_union("_rows", "_answered")) > F.least(F.size("_rows"), F.size("_answered"))), "not_ok": both & ~F.col("_ok"),
    }
    found = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in kinds.items())), lambda v: v.isNotNull())
    return x.select("id", F.explode(found).alias("fault"))


def checked_union(parts: list[DataFrame], total: int, order: str) -> DataFrame:
    """Rows of all parts, which must be ``total`` with the places 0 to total - 1, each once. A repeated or missing place is an error; the check is one
    aggregate, and the rows come back unordered, for a writer to order within its ranges."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    n = out.agg(F.count("*").alias("rows"), F.countDistinct(order).alias("places"), F.min(order).alias("low"), F.max(order).alias("high")).first()
    if n["rows"] != total or n["places"] != total or (total and (n["low"], n["high"]) != (0, total - 1)):
        raise ValueError(f"parts hold {n['rows']} rows with {n['places']} places from {n['low']} to {n['high']}; {total} rows with places 0 to {total - 1} are due")
    return out


def required(rows: DataFrame, column: str, key: str, examples: int = 5) -> DataFrame:
    """How many rows lack a text in ``column``, and the first of their keys, in order. Only a few keys travel."""
    lacking = rows.where(~F.coalesce(T.has_text(F.col(column)), F.lit(False)))
    first = lacking.select(key).orderBy(key).limit(examples).agg(F.array_sort(F.collect_list(key)).alias("first"))
    return lacking.agg(F.count("*").alias("lacking")).join(F.broadcast(first))  # two aggregates of one row


def require(rows: DataFrame, column: str, key: str, what: str) -> None:
    """An error that names the first keys if a row lacks a text in ``column``."""
    r = required(rows, column, key).first()
    if r["lacking"]:
        raise ValueError(f"{what} is required: {r['lacking']} rows lack it, first {r['first']}")


def compatible(coverage: DataFrame, least: float = 0.99) -> DataFrame:
    """Whether a checkpoint's keys fit a model's: refused if a key is only in the checkpoint, or if less than ``least`` of the model's are covered.
    ``coverage`` is the row of joins.coverage with the checkpoint as side a and the model as side b."""
    covered = F.col("matched").cast("double") / F.greatest(F.col("matched") + F.col("only_b"), F.lit(1))
    return coverage.select("matched", "only_a", "only_b", covered.alias("covered"), ((F.col("only_a") > 0) | (covered < least)).alias("refused"))


def resume_faults(candidates: DataFrame, accepted: DataFrame, rejected: DataFrame, log: DataFrame) -> DataFrame:
    """What forbids resuming, one row each kind and id: repeated_candidate, repeated_accepted, unknown_accepted, unknown_retry, repeated_rejected, unknown_rejected,
    accepted_and_rejected. Rejections of items to be tried again are dropped first. log has id, status, pos."""
    last = log.groupBy("id").agg(F.max_by("status", "pos").alias("_last"))
    tagged = candidates.select("id", F.lit("c").alias("k")).unionByName(accepted.select("id", F.lit("a").alias("k"))).unionByName(rejected.select("id", F.lit("r").alias("k")))
    n = tagged.groupBy("id").agg(*(F.count_if(F.col("k") == k).alias(k) for k in "car"))
    x = n.join(last, "id", "full").na.fill(0, ["c", "a", "r"])
    retry = F.coalesce(F.col("_last") == "failed", F.lit(False)) & (F.col("a") == 0)
    kinds = {
        "repeated_candidate": F.col("c") > 1, "repeated_accepted": F.col("a") > 1, "unknown_accepted": (F.col("a") > 0) & (F.col("c") == 0), "unknown_retry": retry & (F.col("c") == 0),
        "repeated_rejected": ~retry & (F.col("r") > 1), "unknown_rejected": ~retry & (F.col("r") > 0) & (F.col("c") == 0), "accepted_and_rejected": (F.col("a") > 0) & (F.col("r") > 0),
    }
    found = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in kinds.items())), lambda v: v.isNotNull())
    return x.select("id", F.explode(found).alias("fault"))


def next_batch(requests: DataFrame, raw: DataFrame) -> DataFrame:
    """The number of the next batch: one more than the greatest so far, 0 without any."""
    return requests.select("batch_idx").unionByName(raw.select("batch_idx")).agg(F.coalesce(F.max("batch_idx") + 1, F.lit(0)).cast("bigint").alias("next_batch_idx"))
