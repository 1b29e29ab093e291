"""Expressions on names, keys, maps and JSON values."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Throughput keys that training logs leave out.
THROUGHPUT = ["train_runtime", "train_samples_per_second", "train_steps_per_second", "total_flos"]


def subset_name(i: Column) -> Column:
    return F.format_string("subset_%03d", i)


def part_name(i: Column) -> Column:
    return F.format_string("part-%05d", i)


def checkpoint_name(i: Column) -> Column:
    return F.format_string("checkpoint-%06d", i)


def clean_run_id(c: Column, default: str = "run") -> Column:
    """Letters, digits, _ and - only, at most 128 of them, without - at either end."""
    out = F.substring(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_-]+", "-"), r"\A-+|-+\z", ""), 1, 128)
    return F.when(F.coalesce(F.length(out), F.lit(0)) == 0, F.lit(default)).otherwise(out)


def truth(c: Column) -> Column:
    """A yes or no in words; null for anything else."""
    v = F.lower(F.trim(c))
    return F.when(v.isin("1", "true", "yes", "y", "on"), True).when(v.isin("0", "false", "no", "n", "off"), False)


def byte_size(n: Column) -> Column:
    """A number of bytes in the largest unit that leaves at least 1, with one decimal beyond bytes."""
    out = F.format_string("%d B", n)
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        size = 1 << (10 * i)
        out = F.when(n >= size, F.format_string(f"%.1f {unit}", F.floor(n * 10 / size) / 10)).otherwise(out)
    return out


def glob_pattern(glob: str) -> str:
    """The regular expression of a file glob: * and ? cross folders, as name matching does."""
    return r"\A" + "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in glob) + r"\z"


def ignored(path: Column, globs: list[str]) -> Column:
    """Whether a glob matches the path or its last part."""
    name = F.regexp_extract(path, r"([^/]*)\z", 1)
    return reduce(lambda a, b: a | b, [path.rlike(glob_pattern(g)) | name.rlike(glob_pattern(g)) for g in globs], F.lit(False))


def renamed(key: Column, rules: list[tuple[str, str]]) -> Column:
    """A key with its prefix replaced by the first rule that fits."""
    out = None
    for old, new in rules:
        value = F.concat(F.lit(new), F.substring(key, len(old) + 1, 1 << 30))
        out = F.when(key.startswith(old), value) if out is None else out.when(key.startswith(old), value)
    return key if out is None else out.otherwise(key)


def numeric_log(m: Column, prefix: str = "train/") -> Column:
    """Entries of a text map that are numbers, without throughput, under prefixed keys."""
    keep = F.map_filter(m, lambda k, v: ~k.isin(THROUGHPUT) & v.try_cast("double").isNotNull())
    return F.transform_values(F.transform_keys(keep, lambda k, _: F.concat(F.lit(prefix), k)), lambda _, v: v.try_cast("double"))


def message_content(c: Column) -> Column:
    """The text of an answer's content, which is a JSON string, or a list of parts whose texts are joined; else empty."""
    v = F.try_parse_json(c)
    parts = F.from_json(F.when(F.schema_of_variant(v).startswith("ARRAY"), c), "array<struct<text:string>>")
    texts = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), texts, F.lit(""))


def usage_field(c: Column, key: str) -> Column:
    """An integer of an answer's usage; null where it is missing or no integer."""
    return F.try_variant_get(F.try_parse_json(c), f"$.usage.{key}", "bigint")
