"""File sources and sinks: JSON lines, text with compression by suffix, CSV, discovery of data files."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.session import checkpoint_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written table in the folder that all executors share."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a declared schema. Blank lines are skipped; a line that is no JSON object ends the query. Files ending in .gz are
    decompressed on the way."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with the keys in alphabetical order; null fields are kept."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def strict_objects(lines: DataFrame, column: str, schema: str) -> Column:
    """A line as a struct; the query ends at a line that is no JSON object."""
    line = F.col(column)
    good = F.try_parse_json(line).isNotNull() & F.ltrim(line).startswith("{")
    return F.when(good, F.from_json(line, schema)).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring(line, 1, 80))))


def write_csv(df: DataFrame, path: str, first: list[str]) -> None:
    """A summary with the columns named first, then the others in their order."""
    df.select(*first, *(c for c in df.columns if c not in first)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def preferred(paths: list[str]) -> list[str]:
    """Data files in reading order: parquet before JSON lines; those with 'train' in their name or folder, if there are any."""
    files = sorted(p for p in paths if p.endswith(".parquet")) + sorted(p for p in paths if re.search(r"\.jsonl(\.gz)?$", p))
    train = [p for p in files if "train" in "/".join(p.split("/")[-2:])]
    return train or files


def read_pool(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """One table from parquet and JSON-lines files; columns that a file lacks are null."""
    chosen = preferred(paths)
    parts = [p for p in ([spark.read.parquet(*[x for x in chosen if x.endswith(".parquet")])] if any(x.endswith(".parquet") for x in chosen) else [])]
    lines = [x for x in chosen if not x.endswith(".parquet")]
    if lines:
        parts.append(spark.read.schema(schema).option("mode", "FAILFAST").json(lines))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def numbered(spark: SparkSession, paths: list[str], pattern: str) -> DataFrame:
    """Paths with the number that ``pattern`` finds in them, such as checkpoints or subsets; others are left out."""
    rows = [(p, int(m.group(1))) for p in paths if (m := re.search(pattern, p))]
    return spark.createDataFrame(rows, "path string, number bigint")


def latest(found: DataFrame) -> DataFrame:
    """The path with the largest number."""
    return found.agg(F.max_by("path", "number").alias("path"), F.max("number").alias("number"))
