"""Selection of candidates: orders, quotas by largest remainder, stratified top-k with refill."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillforge.operators.pool import BUCKETS, bucket_name

#: The salt of the random order, where the caller gives none. A run that has to repeat another's draw passes that run's salt.
RANDOM_SALT = "candidate-selection-v1"
ORDERS = {"low": "low", "bottom": "low", "lowest": "low", "low_qe": "low", "bottom_qe": "low", "high": "high", "top": "high", "highest": "high", "high_qe": "high", "top_qe": "high", "random": "random"}


def candidate_count(target: int, multiplier: float, pool: int = 0, ratio: float = 0.0) -> int:
    """Candidates for a target: the target times the multiplier, rounded up; without a target a share of the pool stands for it."""
    t = target if target > 0 else max(1, int(pool * ratio + 0.999999))
    return max(t, int(t * max(1.0, multiplier) + 0.999999))


def quotas(total: int, weights: list[float]) -> list[int]:
    """Largest remainder: whole parts first, the rest to the largest fractions, ties to the lower index."""
    if total < 0 or not weights or any(w < 0 or math.isnan(w) for w in weights) or sum(weights) <= 0:
        raise ValueError("quotas need a total, and weights of which one is positive")
    raw = [total * w / sum(weights) for w in weights]
    out = [int(x) for x in raw]
    for i in sorted(range(len(raw)), key=lambda i: (out[i] - raw[i], i))[: total - sum(out)]:
        out[i] += 1
    return out


def order_columns(order: str, seed: int = 42, salt: str = RANDOM_SALT) -> list[Column]:
    """Sort keys of an order; ids break ties."""
    kind = ORDERS.get(order)
    if kind is None:
        raise ValueError(f"unknown order {order!r}")
    if kind == "random":
        return [F.sha2(F.concat(F.lit(f"{salt}|seed={seed}|"), F.col("id")), 256), F.col("id")]
    return [F.col("qe_score").asc() if kind == "low" else F.col("qe_score").desc(), F.col("id")]


def bucket_counts(df: DataFrame, buckets=BUCKETS) -> list[int]:
    got = {r["length_bucket_idx"]: r["count"] for r in df.groupBy("length_bucket_idx").count().collect()}
    return [got.get(i, 0) for i in range(len(buckets))]


def stratified_top(df: DataFrame, k: int, order: str = "low", strategy: str | list[float] = "proportional", buckets=BUCKETS, seed: int = 42, salt: str = RANDOM_SALT) -> DataFrame:
    """The k best rows with quotas for the buckets of ``length_bucket_idx``, and what buckets leave unfilled from the global order (buckets
    of weight zero excluded), ranked by bucket and order. df has unique ids, qe_score and length_bucket_idx.

    Only the first ``k`` rows of each bucket can be chosen, quota or rest, so each bucket is cut at this bound first (the limit is a
    literal, which lets Spark keep a group's best rows before the shuffle); what is ranked globally is at most k rows a bucket."""
    counts = bucket_counts(df, buckets)
    if isinstance(strategy, str):
        weights = {"proportional": [float(c) for c in counts], "uniform": [1.0] * len(buckets)}.get(strategy)
        if weights is None:
            raise ValueError(f"unknown strategy {strategy!r}")
    else:
        weights = [max(0.0, float(w)) for w in strategy]
    keys = order_columns(order, seed, salt)
    named = lambda x: x.withColumn("length_bucket", bucket_name(F.col("length_bucket_idx"), buckets))
    if k <= 0 or not sum(counts):
        return named(df.limit(0)).withColumn("selection_rank", F.lit(0).cast("bigint"))
    quota = quotas(min(k, sum(counts)), weights)
    best = df.withColumn("_in_bucket", F.row_number().over(Window.partitionBy("length_bucket_idx").orderBy(*keys))).where(F.col("_in_bucket") <= k)
    of = F.element_at(F.array(*map(F.lit, quota)), (F.col("length_bucket_idx") + 1).cast("int"))
    allowed = F.element_at(F.array(*(F.lit(w > 0) for w in weights)), (F.col("length_bucket_idx") + 1).cast("int"))
    marked = best.withColumn("_first", F.col("_in_bucket") <= of)
    short = min(k, sum(c for c, w in zip(counts, weights) if w > 0)) - sum(min(c, q) for c, q in zip(counts, quota))
    rest = F.row_number().over(Window.partitionBy("_first").orderBy(*keys))
    chosen = marked.where(F.col("_first") | allowed).withColumn("_rest", rest).where(F.col("_first") | (F.col("_rest") <= max(0, short)))
    ranked = chosen.withColumn("selection_rank", F.row_number().over(Window.orderBy("length_bucket_idx", *keys)).cast("bigint"))
    return named(ranked.drop("_in_bucket", "_first", "_rest"))


def plain_top(df: DataFrame, k: int, order: str = "low", seed: int = 42) -> DataFrame:
    """The first k rows of the global order."""
    keys = order_columns(order, seed)
    return df.orderBy(*keys).limit(k).withColumn("selection_rank", F.row_number().over(Window.orderBy(*keys)).cast("bigint"))
