"""Joins and the audits that stand beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the last by the order given, whose last column should break ties."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(key).agg(F.count("*").alias("occurrences")).where("occurrences > 1")


def response_audit(requests: DataFrame, responses: DataFrame, key: str, row: str) -> DataFrame:
    """Every key once, with its side: matched, missing (no response), extra (no request), or mismatched (any delivery of the key names another row)."""
    a = requests.groupBy(key).agg(F.min(row).alias("_a"), F.max(row).alias("_a2"), F.lit(True).alias("_in_a"))
    b = responses.groupBy(key).agg(F.min(row).alias("_b"), F.max(row).alias("_b2"), F.lit(True).alias("_in_b"))
    same = F.col("_a").eqNullSafe(F.col("_b")) & F.col("_a2").eqNullSafe(F.col("_b2")) & F.col("_a").eqNullSafe(F.col("_a2"))
    side = F.when(F.col("_in_b").isNull(), "missing").when(F.col("_in_a").isNull(), "extra").when(~same, "mismatched").otherwise("matched")
    return a.join(b, key, "full").select(key, side.alias("side"))


def complete_join(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Inner join that fails if a left row has no partner."""
    held = right.withColumn("_held", F.lit(True))
    joined = left.join(held, key, "left")
    guard = F.when(F.col("_held").isNull(), F.raise_error(F.concat_ws(" ", F.lit("no partner for"), *[F.col(k).cast("string") for k in key]))).otherwise(F.lit(True))
    return joined.withColumn("_held", guard).where("_held").drop("_held")


def first_examples(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n smallest distinct values, as one array: only n values travel."""
    some = df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(n)
    return some.agg(F.array_sort(F.collect_list(column)).alias("examples"))


def upsert(old: DataFrame, new: DataFrame, key: str, position: str = "position") -> DataFrame:
    """Rows of old, replaced by those of new with the same key at the old place; new keys go to the end in their own order. ``new`` has one
    row a key and the columns of ``old``."""
    values = [c for c in old.columns if c not in (key, position)]
    o, n = old.alias("o"), new.alias("n")
    end = old.agg(F.coalesce(F.max(position), F.lit(-1))).first()[0]
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    fresh = F.row_number().over(Window.partitionBy(F.col(f"o.{key}").isNull()).orderBy(F.col(f"n.{position}"), F.col(f"n.{key}")))
    held = F.col(f"n.{key}").isNotNull()
    return joined.withColumn("_fresh", fresh).select(
        F.coalesce(f"n.{key}", f"o.{key}").alias(key),
        F.when(F.col(f"o.{key}").isNotNull(), F.col(f"o.{position}")).otherwise(F.lit(end) + F.col("_fresh")).cast("bigint").alias(position),
        *(F.when(held, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in values))


def coverage(keys: DataFrame) -> DataFrame:
    """Two sets of keys, told apart by ``side`` ('a' or 'b'): matched, only in a, only in b, and the shares matched of either."""
    each = keys.groupBy("key").agg(F.bool_or(F.col("side") == "a").alias("a"), F.bool_or(F.col("side") == "b").alias("b"))
    n = each.agg(F.count_if(F.col("a") & F.col("b")).alias("matched"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"))
    share = lambda other: F.col("matched").cast("double") / F.greatest(F.col("matched") + F.col(other), F.lit(1))
    return n.withColumns({"share_a": share("only_a"), "share_b": share("only_b")})


def padded(rows: DataFrame, order: str, total: int) -> DataFrame:
    """Rows and copies up to ``total``: copy i repeats row i modulo the number of rows. Each row makes its own copies, so nothing is joined."""
    n = rows.count()
    if n == 0 or total < n:
        return rows.withColumns({"is_padding": F.lit(False), "padded_idx": F.col(order).cast("bigint")})
    extra = total - n
    times = F.floor((F.lit(extra - 1) - F.col(order)) / n) + 1
    more = rows.where(F.col(order) < extra).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), times.cast("bigint") - 1)))
    copies = more.withColumns({"is_padding": F.lit(True), "padded_idx": (n + F.col("_i") * n + F.col(order)).cast("bigint")}).drop("_i")
    return rows.withColumns({"is_padding": F.lit(False), "padded_idx": F.col(order).cast("bigint")}).unionByName(copies)
