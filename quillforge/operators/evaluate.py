"""Evaluation: corpus BLEU and chrF from summed statistics, metric means, token usage.

Statistics are worked out row by row and summed, so a corpus score is one partial and one final aggregation; scores follow Papineni et al.
(2002) and Popovic (2015)."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(order: int):
    """An Arrow UDF: for n from 1 to ``order`` the size of the intersection of two sequences' n-grams as multisets. Built-in functions take
    quadratic time for it."""

    def shared(x, y) -> list[int]:
        out = []
        for n in range(1, order + 1):
            a = Counter(zip(*(x[i:] for i in range(n))))
            b = Counter(zip(*(y[i:] for i in range(n))))
            out.append(sum(min(c, b[g]) for g, c in a.items() if g in b))
        return out

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([shared(list(x), list(y)) for x, y in zip(a, b)], dtype=object)

    return F.pandas_udf(run, "array<bigint>")


def bleu_tokens(c: Column) -> Column:
    """Runs of letters and digits, and single marks."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0))


def bleu_statistics(df: DataFrame, output: str, reference: str, order: int = 4) -> DataFrame:
    """df with lengths and, for each n, matched and possible n-grams."""
    x = df.withColumns({"_h": bleu_tokens(F.col(output)), "_r": bleu_tokens(F.col(reference))})
    x = x.withColumn("_m", matches(order)("_h", "_r"))
    cols = {"out_len": F.size("_h").cast("bigint"), "ref_len": F.size("_r").cast("bigint")}
    for n in range(1, order + 1):
        cols[f"match_{n}"] = F.col("_m")[n - 1]
        cols[f"total_{n}"] = F.greatest(F.lit(0), F.size("_h") - (n - 1)).cast("bigint")
    return x.withColumns(cols).drop("_h", "_r", "_m")


def bleu_score(stats: DataFrame, by: list[str], order: int = 4) -> DataFrame:
    """Corpus BLEU of each group; 0 where an order has no match."""
    names = ["out_len", "ref_len", *(f"{k}_{n}" for n in range(1, order + 1) for k in ("match", "total"))]
    s = stats.groupBy(*by).agg(*(F.sum(c).alias(c) for c in names))
    logs = sum((F.ln(F.col(f"match_{n}").cast("double") / F.col(f"total_{n}")) for n in range(1, order + 1)), F.lit(0.0)) / order
    brief = F.when(F.col("out_len") < F.col("ref_len"), F.exp(1 - F.col("ref_len").cast("double") / F.col("out_len"))).otherwise(F.lit(1.0))
    any_zero = F.lit(False)
    for n in range(1, order + 1):
        any_zero = any_zero | (F.col(f"match_{n}") == 0) | (F.col(f"total_{n}") == 0)
    return s.withColumn("bleu", F.when(any_zero, F.lit(0.0)).otherwise(100 * brief * F.exp(logs)))


def chrf_statistics(df: DataFrame, output: str, reference: str, order: int = 6) -> DataFrame:
    """df with, for each n, matched character n-grams and those of either side; white space is left out."""
    chars = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)\s+", "")
    x = df.withColumns({"_h": chars(output), "_r": chars(reference)})
    x = x.withColumn("_m", matches(order)("_h", "_r"))
    cols = {}
    for n in range(1, order + 1):
        cols[f"match_{n}"] = F.col("_m")[n - 1]
        cols[f"out_{n}"] = F.greatest(F.lit(0), F.length("_h") - (n - 1)).cast("bigint")
        cols[f"ref_{n}"] = F.greatest(F.lit(0), F.length("_r") - (n - 1)).cast("bigint")
    return x.withColumns(cols).drop("_h", "_r", "_m")


def chrf_score(stats: DataFrame, by: list[str], order: int = 6, beta: float = 2.0) -> DataFrame:
    """Corpus chrF of each group: F-scores of the orders that occur on both sides, averaged."""
    s = stats.groupBy(*by).agg(*(F.sum(f"{k}_{n}").alias(f"{k}_{n}") for n in range(1, order + 1) for k in ("match", "out", "ref")))
    total, used = F.lit(0.0), F.lit(0)
    for n in range(1, order + 1):
        m, o, r = (F.col(f"{k}_{n}").cast("double") for k in ("match", "out", "ref"))
        there = (o > 0) & (r > 0)
        p, q = m / o, m / r
        f = F.when(there & (m > 0), (1 + beta**2) * p * q / (beta**2 * p + q)).otherwise(F.lit(0.0))
        total, used = total + f, used + there.cast("int")
    return s.withColumn("chrf", F.when(used == 0, F.lit(0.0)).otherwise(100 * total / used))


def metric_means(scores: DataFrame, by: list[str], score: str) -> DataFrame:
    """Rows, rows with a number, and the mean of those; NaN is no number."""
    usable = F.when(F.col(score).isNotNull() & ~F.isnan(score), F.col(score))
    return scores.groupBy(*by).agg(F.count("*").alias("rows"), F.count(usable).alias("scored"), F.avg(usable).alias("mean_score"))


def usage_totals(df: DataFrame, usage: str, keys: list[str]) -> DataFrame:
    """Sums of integer counters kept as text in a map; null where none was seen."""
    return df.agg(*(F.sum(F.try_element_at(usage, F.lit(k)).try_cast("bigint")).alias(k) for k in keys))
