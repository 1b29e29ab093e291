"""Batches sent to a teacher model, its answers, and what is accepted of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillforge.functions import text as T
from quillforge.operators.selection import quotas

# Labels and the schema of an answer.
ACCEPTED = ["keep", "edit", "rewrite", "translate"]
LABELS = [*ACCEPTED, "invalid"]
ITEM = "struct<id:string,label:string,final_translation:string,invalid_reason_ko:string,errors:array<struct<type:string,severity:string,note:string>>>"
ANSWER = f"struct<items:array<{ITEM}>>"


#: Batches of a block, within which running counts are made in one task.
BLOCK = 100_000


def batches(candidates: DataFrame, size: int, order: str = "selection_rank") -> DataFrame:
    """batch_idx and place in the batch by rank."""
    return candidates.withColumns({"batch_idx": F.floor((F.col(order) - 1) / size).cast("bigint"), "batch_pos": ((F.col(order) - 1) % size).cast("bigint")})


def batch_prompts(batched: DataFrame) -> DataFrame:
    """One prompt a batch: numbered items, and the same as JSON."""
    item = F.struct("batch_pos", "id", "source", "student_translation")
    got = batched.groupBy("batch_idx").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    line = lambda x, i: F.concat(F.lit("[ITEM "), (i + 1).cast("string"), F.lit("]\nid: "), x["id"], F.lit("\nsource: "), x["source"], F.lit("\ndraft: "), F.coalesce(x["student_translation"], F.lit("")))
    return got.select(
        "batch_idx", F.transform("_items", lambda x: x["id"]).alias("item_ids"), F.array_join(F.transform("_items", line), "\n\n").alias("items_text"),
        F.to_json(F.transform("_items", lambda x: F.struct(x["id"].alias("id"), x["source"].alias("source"), x["student_translation"].alias("draft")))).alias("items_json"))


def fenced(c: Column) -> Column:
    """The first fenced block of an answer, else the answer."""
    body = F.regexp_extract(c, r"(?si)```(?:json)?\s*(.*?)```", 1)
    return T.strip(F.when(c.rlike(r"(?si)```(?:json)?\s*.*?```"), body).otherwise(c))


def parsed_answers(raw: DataFrame) -> DataFrame:
    """raw (batch_idx, item_ids, status, raw_text) with what its text holds: ``answer`` and parse_status, which is ok only if the text is
    JSON, every label is known and the ids are those asked for, each once."""
    body = raw.withColumn("_json", fenced(F.col("raw_text")))
    tried = body.withColumn("answer", F.when(F.try_parse_json("_json").isNotNull(), F.from_json("_json", ANSWER)))
    ids = F.transform("answer.items", lambda x: x["id"])
    known = F.forall("answer.items", lambda x: F.coalesce(x["label"].isin(LABELS), F.lit(False)))
    same = (F.size(ids) == F.size("item_ids")) & (F.array_sort(ids) == F.array_sort("item_ids"))
    status = (
        F.when(F.col("status") != "ok", "failed").when(F.col("answer.items").isNull(), "not_json").when(~known, "unknown_label").when(~same, "wrong_ids").otherwise("ok")
    )
    return tried.withColumn("parse_status", status).drop("_json")


def items(parsed: DataFrame) -> DataFrame:
    """One row an item asked for: the teacher's item, normalised, or a failed one. An invalid item has no translation and no errors."""
    asked = parsed.select("batch_idx", "parse_status", "answer", F.posexplode("item_ids").alias("batch_pos", "id"))
    got = F.when(F.col("parse_status") == "ok", F.element_at(F.filter("answer.items", lambda x: x["id"] == F.col("id")), 1))
    it = asked.withColumn("_item", got)
    invalid = F.col("_item.label") == "invalid"
    return it.select(
        "batch_idx", F.col("batch_pos").cast("bigint").alias("batch_pos"), "id", "parse_status", F.col("_item.label").alias("label"),
        F.when(~invalid, F.col("_item.final_translation")).alias("final_translation"), F.when(invalid, F.coalesce("_item.invalid_reason_ko", F.lit("사유 없음"))).alias("invalid_reason_ko"),
        F.when(invalid, F.lit(0)).otherwise(F.coalesce(F.size("_item.errors"), F.lit(0))).cast("bigint").alias("error_count"))


def decision(item: DataFrame, most_tokens: int) -> DataFrame:
    """reject_reason of each item, or null where it is accepted; the first reason that holds counts."""
    text = F.col("final_translation")
    return item.withColumn("reject_reason", (
        F.when((F.col("parse_status") != "ok") | F.col("label").isNull(), "missing_or_unparsed_teacher_item").when(F.col("label") == "invalid", "teacher_invalid")
        .when(~T.has_text(text), "empty_teacher_translation").when(T.word_count(text) > most_tokens, "teacher_output_too_long")
        .when(F.col("degeneration_label") != "clean", F.concat(F.lit("teacher_"), F.col("degeneration_label")))))


def accept_until(decided: DataFrame, target: int, order: list[str]) -> DataFrame:
    """Decided items up to the one that reaches the target; later ones are neither accepted nor rejected. Accepted ones get their rank.

    The running count is made in three levels: blocks of BLOCK batches, of which a table has few, the batches of each block, and the items of each batch."""
    ok = F.col("reject_reason").isNull()
    first, rest = order[0], order[1:]
    per = decided.groupBy(first).agg(F.count_if(ok).alias("_n"))
    per = per.withColumn("_block", F.floor(F.col(first) / BLOCK))
    blocks = per.groupBy("_block").agg(F.sum("_n").alias("_sum"))
    blocks = blocks.select("_block", F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("_block").orderBy(first).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = per.withColumn("_in_block", earlier).join(blocks, "_block").select(first, (F.col("_earlier") + F.col("_in_block")).alias("_before"))
    inside = Window.partitionBy(first).orderBy(*rest).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.sum(ok.cast("bigint")).over(inside)
    x = decided.withColumn("_run", run).join(before, first).withColumn("_run", F.col("_run") + F.col("_before"))
    return x.where(F.col("_run") - ok.cast("bigint") < target).withColumn("accept_rank", F.when(ok, F.col("_run")).cast("bigint")).drop("_run", "_before")


def latest_status(log: DataFrame, item: str, status: str, order: list[str]) -> DataFrame:
    """The last status of each item in log order."""
    return log.groupBy(item).agg(F.max_by(status, F.struct(*order)).alias("latest_status"))


def resume(candidates: DataFrame, accepted: DataFrame, rejected: DataFrame, log: DataFrame) -> DataFrame:
    """What is left of a run that broke off: each candidate's state. Items whose last answer failed and that were not accepted are to be
    tried again, whatever rejection they got; accepted and other rejected ones are done; the rest is pending."""
    last = latest_status(log, "id", "status", ["pos"])
    x = (
        candidates.join(accepted.select("id", F.lit(True).alias("_a")).distinct(), "id", "left")
        .join(rejected.select("id", F.lit(True).alias("_r")).distinct(), "id", "left").join(last, "id", "left")
    )
    state = F.when(F.col("_a"), "accepted").when(F.col("latest_status") == "failed", "retry").when(F.col("_r"), "rejected").otherwise("pending")
    return x.withColumn("state", state).drop("_a", "_r", "latest_status")


def artifacts(requests: DataFrame, raw: DataFrame, parsed: DataFrame, rejected: DataFrame) -> DataFrame:
    """The four kinds of records in one table, told apart by record_type."""
    tagged = [d.withColumn("record_type", F.lit(n)) for n, d in (("teacher_request", requests), ("teacher_raw_response", raw), ("teacher_parsed_item", parsed), ("teacher_rejected_row", rejected))]
    out = tagged[0]
    for d in tagged[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def label_ratios(accepted: DataFrame, label: str) -> DataFrame:
    """Counts and shares of the accepted labels, zero included."""
    spark = accepted.sparkSession
    every = spark.createDataFrame([(x,) for x in ACCEPTED], "label string")
    counts = accepted.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    # a row a label: the total is over a handful of rows
    return every.join(counts, "label", "full").select("label", n.alias("n"), T.ratio(n, F.sum(n).over(Window.partitionBy(F.lit(1)))).alias("share"))


@dataclass
class Cursor:
    """Where a bucket's queue stands."""

    size: int
    quota: int
    open: bool  # whether it may give more than its quota
    taken: int = 0
    accepted: int = 0


def scheduled(cursors: list[Cursor], heads: dict[tuple[int, int], tuple[bool, float, str]], window: int) -> list[tuple[int, int]]:
    """The next window as (bucket, place in its queue), in the order in which items are sent. While a bucket is under its quota, the one that is least filled
    gives its head; then the open bucket whose head has the best score (``heads``: whether it lacks one, the score, the id) gives it."""
    sent, out = [0] * len(cursors), []
    for _ in range(window):
        left = [i for i, c in enumerate(cursors) if c.taken + sent[i] < c.size]
        under = [i for i in left if cursors[i].accepted + sent[i] < cursors[i].quota]
        if under:
            pick = min(under, key=lambda i: ((cursors[i].accepted + sent[i]) / max(cursors[i].quota, 1), i))
        else:
            left = [i for i in left if cursors[i].open]
            if not left:
                break
            pick = min(left, key=lambda i: (*heads[i, cursors[i].taken + sent[i] + 1], i))
        sent[pick] += 1
        out.append((pick, cursors[pick].taken + sent[pick]))
    return out


def refill(candidates: DataFrame, target: int, window: int, weights: list[float], answer: Callable[[DataFrame], DataFrame], folder: str, explicit: bool = True) -> DataFrame:
    """Candidates sent to a model, window by window, until ``target`` are accepted or the queues are empty, each with its ``outcome``: accepted (with
    accept_rank), rejected, or unused (sent, but behind the item that met the target).

    A window's composition depends on what was accepted before, so windows follow one another. ``answer`` gets a window's candidates and gives back their ids with
    ``accepted`` and ``failed``; it is run once a window, and its answers are written to ``folder``, a shared one, before they are counted, so that neither a lost
    executor nor a later use of the result asks the model again. If all answers of a window failed, the run ends with an error; what was answered is kept.
    Candidates have a unique id, length_bucket_idx, selection_rank and qe_score. With explicit weights, buckets of weight zero give nothing beyond their quota."""
    spark = candidates.sparkSession
    buckets = len(weights)
    queue = candidates.withColumn("_place", F.row_number().over(Window.partitionBy("length_bucket_idx").orderBy("selection_rank", "id")))
    # the queue is written once, in its order: a window reads only the rows near its heads
    queue.repartitionByRange("length_bucket_idx", "_place").sortWithinPartitions("length_bucket_idx", "_place").write.mode("overwrite").parquet(f"{folder}/queue")
    queue = spark.read.parquet(f"{folder}/queue")
    sizes = {r["length_bucket_idx"]: r["count"] for r in queue.groupBy("length_bucket_idx").count().collect()}
    cursors = [Cursor(sizes.get(i, 0), q, not explicit or weights[i] > 0) for i, q in enumerate(quotas(target, weights))]
    done, number, first_rank = 0, 0, []
    while done < target:
        near = F.lit(False)
        for i, c in enumerate(cursors):
            near = near | (F.col("length_bucket_idx") == i) & (F.col("_place") > c.taken) & (F.col("_place") <= c.taken + window)
        # at most ``window`` heads a bucket, three short values each
        heads = {(r[0], r[1]): (r[2] is None, r[2] or 0.0, r[3]) for r in queue.where(near).select("length_bucket_idx", "_place", F.when(~F.isnan("qe_score"), F.col("qe_score")), "id").collect()}
        items = scheduled(cursors, heads, window)
        if not items:
            break
        sent = spark.createDataFrame([(b, p, n) for n, (b, p) in enumerate(items, 1)], "length_bucket_idx bigint, _place int, schedule_idx bigint")
        asked = queue.where(near).join(F.broadcast(sent), ["length_bucket_idx", "_place"]).drop("_place")
        path = f"{folder}/window-{number:06d}"
        got = answer(asked).select("id", F.coalesce("accepted", F.lit(False)).alias("accepted"), F.coalesce("failed", F.lit(False)).alias("failed"))
        asked.join(got, "id", "left").na.fill({"accepted": False, "failed": True}).write.mode("overwrite").parquet(path)
        kept = spark.read.parquet(path)
        by = {r["length_bucket_idx"]: r for r in kept.groupBy("length_bucket_idx").agg(F.count_if("accepted").alias("accepted"), F.count_if("failed").alias("failed"), F.count("*").alias("sent")).collect()}
        for i, r in by.items():
            cursors[i].taken += r["sent"]
            cursors[i].accepted += r["accepted"]
        first_rank.append(done)
        done += sum(r["accepted"] for r in by.values())
        number += 1
        if all(r["failed"] == r["sent"] for r in by.values()):
            raise RuntimeError(f"all {sum(r['sent'] for r in by.values())} answers of window {number - 1} failed; its items are kept in {path}")
    if not number:
        none = candidates.limit(0)
        return none.select("*", F.lit(0).cast("bigint").alias("window_no"), F.lit(0).cast("bigint").alias("schedule_idx"), F.lit("").alias("outcome"), F.lit(0).cast("bigint").alias("accept_rank"))
    out = None
    for n, before in enumerate(first_rank):
        part = spark.read.parquet(f"{folder}/window-{n:06d}").withColumn("window_no", F.lit(n).cast("bigint")).withColumn("_before", F.lit(before).cast("bigint"))
        out = part if out is None else out.unionByName(part)
    # a window's items are few: the running count is within each window
    run = F.col("_before") + F.sum(F.col("accepted").cast("bigint")).over(Window.partitionBy("window_no").orderBy("schedule_idx"))
    x = out.withColumn("_run", run)
    used = F.col("_run") - F.col("accepted").cast("bigint") < target
    outcome = F.when(~used, "unused").when(F.col("accepted"), "accepted").otherwise("rejected")
    return x.select(*candidates.columns, "window_no", "schedule_idx", outcome.alias("outcome"), F.when(used & F.col("accepted"), F.col("_run")).alias("accept_rank"))
