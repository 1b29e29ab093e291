"""Training rows and the arithmetic of training steps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillforge.functions import text as T

MASKED = -100


def joined_text(prompt: Column, response: Column) -> Column:
    """(text, response_start): prompt and response, with a line end between them unless the prompt ends in white space of its own."""
    p = F.regexp_replace(F.coalesce(prompt, F.lit("")), r"\x00+\z", "")
    r = T.strip(F.coalesce(response, F.lit("")))
    gap = F.when((F.length(p) == 0) | p.rlike(r"[ \n\t]\z"), F.lit("")).otherwise(F.lit("\n"))
    return F.struct(F.concat(p, gap, r).alias("text"), (F.length(p) + F.length(gap)).cast("bigint").alias("response_start"))


def training_rows(golden: DataFrame, prompt: Column, order: list[str]) -> DataFrame:
    """Prompt and response of each pair. Pairs with a blank side are dropped, after every pair got its place."""
    placed = golden.withColumn("order_idx", (F.col(order[0]) - 1).cast("bigint")) if len(order) == 1 else golden.withColumn("order_idx", (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint"))
    kept = placed.where(T.has_text(F.col("source")) & T.has_text(F.col("target")))
    return kept.withColumn("_joined", joined_text(prompt, F.col("target"))).select(
        "id", "order_idx", "source", T.strip("target").alias("target"), F.col("_joined.text").alias("text"), F.col("_joined.response_start").alias("response_start"))


def labels(prompt_ids: Column, response_ids: Column, end: int, most: int) -> Column:
    """(input_ids, labels, prompt_tokens, response_tokens): the prompt masked, the end token learned, both cut at ``most``."""
    ids = F.concat(prompt_ids, response_ids, F.array(F.lit(end)))
    mask = F.concat(F.array_repeat(F.lit(MASKED), F.size(prompt_ids)), response_ids, F.array(F.lit(end)))
    kept = F.least(F.size(ids), F.lit(most))
    return F.struct(
        F.slice(ids, 1, most).alias("input_ids"), F.slice(mask, 1, most).alias("labels"), F.least(F.size(prompt_ids), kept).cast("bigint").alias("prompt_tokens"),
        F.greatest(F.lit(0), kept - F.size(prompt_ids)).cast("bigint").alias("response_tokens"))


def whole_labels(key: Column, prompt_ids: Column, response_ids: Column, end: int, limit: int) -> Column:
    """As ``labels``, but nothing is cut: a row longer than ``limit``, or whose prompt leaves no room for the response, is an error."""
    size = F.size(prompt_ids) + F.size(response_ids) + 1
    message = F.concat(
        F.lit("row "), F.coalesce(key.cast("string"), F.lit("null")), F.when(F.size(prompt_ids) >= limit, F.lit(": the prompt leaves no room for the response,")).otherwise(F.lit(":")),
        F.format_string(f" %d prompt and %d response tokens exceed the sequence limit of {limit}", F.size(prompt_ids), F.size(response_ids) + 1))
    return F.when(size > limit, F.raise_error(message)).otherwise(labels(prompt_ids, response_ids, end, limit))


def padded_batches(rows: DataFrame, order: str, size: int, pad: int) -> DataFrame:
    """Rows padded to the longest of their batch."""
    b = rows.withColumn("batch_idx", F.floor(F.col(order) / size).cast("bigint"))
    longest = F.max(F.size("input_ids")).over(Window.partitionBy("batch_idx"))
    x = b.withColumn("_pad", longest - F.size("input_ids"))
    return x.select(
        "id", order, "batch_idx", F.concat("input_ids", F.array_repeat(F.lit(pad), F.col("_pad"))).alias("input_ids"),
        F.concat("labels", F.array_repeat(F.lit(MASKED), F.col("_pad"))).alias("labels"),
        F.concat(F.array_repeat(F.lit(1), F.size("input_ids")), F.array_repeat(F.lit(0), F.col("_pad"))).alias("attention_mask"))


def accumulation(effective: int, per_device: int, world: int) -> int:
    """Micro-batches of one update."""
    return max(1, math.ceil(effective / max(1, per_device * world)))


def update_steps(rows: int, per_device: int, world: int, accumulate: int) -> int:
    """Updates for a number of rows."""
    return max(1, math.ceil(max(1, math.ceil(max(1, rows) / max(1, per_device * world))) / max(1, accumulate)))


def padded_rows(rows: int, per_device: int, world: int, accumulate: int) -> int:
    """Rows that fill the updates exactly."""
    return update_steps(rows, per_device, world, accumulate) * accumulate * per_device * world


def step_plan(sizes: DataFrame, per_device: int, world: int, effective: int) -> DataFrame:
    """sizes (subset_idx, rows) with each subset's updates, padded rows and the running total of updates."""
    acc, micro = accumulation(effective, per_device, world), per_device * world
    micro_batches = F.greatest(F.lit(1), F.ceil(F.greatest(F.col("rows"), F.lit(1)) / micro))
    steps = F.greatest(F.lit(1), F.ceil(micro_batches / acc)).cast("bigint")
    return sizes.withColumn("steps", steps).withColumn("padded_rows", F.col("steps") * acc * micro).withColumn(
        "end_step", F.sum("steps").over(Window.orderBy("subset_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def evaluated(subsets: DataFrame, every: int, start: int, end: int, final: bool) -> DataFrame:
    """Whether a subset is evaluated: every ``every`` subsets from the start, and the last one if ``final``; never for every <= 0."""
    due = F.lit(False) if every <= 0 else (((F.col("subset_idx") - start) % every == 0) | (F.lit(final) & (F.col("subset_idx") == end - 1)))
    return subsets.withColumn("evaluate", due)
