"""Functions for SQL: the splitter as a table function, and scalar functions that no built-in expresses."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillforge.functions.repeats import longest_unit_runs
from quillforge.operators.splitter import split_text


class SplitPieces:
    """split_pieces(text, budget): a row for each piece of a text, with its place; none for a null text."""

    def eval(self, text: str, budget: int) -> Iterator[tuple[int, str]]:
        if text is not None and budget is not None:
            yield from enumerate(split_text(text, budget))


def unit_run(texts: pd.Series) -> pd.Series:
    there = texts.notna()
    found = iter(longest_unit_runs(texts[there].tolist(), 16, 6000))
    return pd.Series([next(found) if ok else None for ok in there], dtype="Int64")


def pieces(texts: pd.Series, budgets: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else split_text(t, int(b)) for t, b in zip(texts, budgets)], dtype=object)


def register(spark: SparkSession) -> None:
    """Make split_pieces (a table function), text_pieces and unit_run known to the session's SQL."""
    spark.udtf.register("split_pieces", F.udtf(SplitPieces, returnType="chunk_idx int, piece string"))
    spark.udf.register("unit_run", F.pandas_udf(unit_run, "bigint"))
    spark.udf.register("text_pieces", F.pandas_udf(pieces, "array<string>"))
