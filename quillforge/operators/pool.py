"""The source pool: normalising, lengths, buckets, positions, subsets and shards."""

from __future__ import annotations

import hashlib
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillforge.functions import text as T

BUCKETS = ((1, 64), (65, 256), (257, 1280))


def token_length(tokens: Column, source: Column) -> Column:
    """A stated number of tokens, cut to a whole number of at least 0; else the source's words, at least 1. Numbers may come as text;
    what is no finite number counts as missing."""
    stated = tokens.cast("string").try_cast("double")
    usable = stated.isNotNull() & ~F.isnan(stated) & (F.abs(stated) < 9.2e18)
    return F.when(usable, F.greatest(F.lit(0).cast("bigint"), stated.cast("bigint"))).otherwise(F.greatest(F.lit(1).cast("bigint"), F.coalesce(T.word_count(source), F.lit(0))))


def normalized(pool: DataFrame, position: str = "order_idx") -> DataFrame:
    """Rows with a source that is not blank. Missing and blank ids are made from the position in the unfiltered pool, missing metadata
    are an empty map. Re-deliveries stay: they are told apart by their position."""
    made = F.format_string("row_%012d", F.col(position))
    return pool.where(T.has_text(F.col("source"))).select(
        position, F.when(T.has_text(F.col("id")), F.col("id")).otherwise(made).alias("id"), "source", "target", "source_tokens",
        F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"), "corpus",
    )


def bucket_of(length: Column, buckets=BUCKETS) -> Column:
    """The first bucket that holds a length; below the first it is the first, anywhere else the last."""
    check_buckets(buckets)
    out = F.when(length < buckets[0][0], F.lit(0))
    for i, (low, high) in enumerate(buckets):
        out = out.when((length >= low) & (length <= high), F.lit(i))
    return out.otherwise(F.lit(len(buckets) - 1)).cast("bigint")


def check_buckets(buckets) -> None:
    if not buckets or any(len(b) != 2 or b[0] > b[1] for b in buckets):
        raise ValueError("buckets are pairs with the lower bound first")


def bucket_name(bucket: Column, buckets=BUCKETS) -> Column:
    return F.element_at(F.array(*(F.lit(f"{a}-{b}") for a, b in buckets)), (bucket + 1).cast("int"))


def bucket_histogram(df: DataFrame, bucket: str, buckets=BUCKETS) -> DataFrame:
    """Rows of each bucket, empty ones included."""
    spark = df.sparkSession
    every = spark.range(len(buckets)).select(F.col("id").alias(bucket))
    return F.broadcast(every).join(df.groupBy(bucket).agg(F.count("*").alias("rows")), bucket, "left").select(
        bucket, bucket_name(F.col(bucket), buckets).alias("length_bucket"), F.coalesce("rows", F.lit(0)).alias("rows"))


def hashed_key(key: Column, salt: str) -> Column:
    """A uniform, salted order key: 64 hexadecimal digits."""
    return F.sha2(F.concat(F.lit(salt), key), 256)


def positions(df: DataFrame, key: str, ties: list[str], out: str = "position", digits: int = 4) -> DataFrame:
    """The 0-based position in the order of a hexadecimal key. The key's first digits cut the rows into ordered parts of about equal
    size, so that no task ranks more than a part: positions are the rows of the parts before, plus the rank within the part."""
    part = df.withColumn("_part", F.substring(key, 1, digits))
    before = part.groupBy("_part").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(key, *ties))
    return (
        part.withColumn("_within", within).join(before.select("_part", "_before"), "_part")
        .withColumn(out, (F.coalesce("_before", F.lit(0)) + F.col("_within") - 1).cast("bigint")).drop("_part", "_within", "_before")
    )


def part_of(value: Column, cuts: list, first: int = 0) -> Column:
    """How many of the ascending ``cuts`` lie below a value, by bisection; a null comes behind all of them."""
    if not cuts:
        return F.lit(first)
    m = len(cuts) // 2
    return F.when(value <= F.lit(cuts[m]), part_of(value, cuts[:m], first)).otherwise(part_of(value, cuts[m + 1 :], first + m + 1))


def places(df: DataFrame, key: str, ties: list[str], out: str = "place", parts: int = 64) -> DataFrame:
    """The 0-based place in the order of a number, whatever gaps its values leave; nulls come last. Quantiles of the values cut the rows into
    ordered parts, whose sizes are all that the driver gets: a place is the rows of the parts before, plus the rank within the part."""
    cuts = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)])).first()[0]
    part = df.withColumn("_part", part_of(F.col(key), sorted(set(cuts or []))))
    sizes = dict(part.groupBy("_part").count().collect())
    before = [sum(n for p, n in sizes.items() if p < i) for i in range(max(sizes, default=0) + 1)]
    within = F.row_number().over(Window.partitionBy("_part").orderBy(F.col(key).asc_nulls_last(), *ties))
    place = F.element_at(F.array(*(F.lit(n).cast("bigint") for n in before)), F.col("_part") + 1) + within - 1
    return part.withColumn(out, place.cast("bigint")).drop("_part")


def subsets(pool: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """Every row's place in the seeded order, its subset and its place there: one pass gives all subsets. The order is that of a salted
    hash of the position, which is a different sample from that of exact_shuffle."""
    keyed = pool.withColumn("_key", hashed_key(F.col("order_idx").cast("string"), f"{seed}|"))
    placed = positions(keyed, "_key", ["order_idx"], "pool_position").drop("_key")
    return placed.withColumns({"subset_idx": F.floor(F.col("pool_position") / size).cast("bigint"), "subset_order": (F.col("pool_position") % size).cast("bigint")})


def exact_shuffle(pool: DataFrame, seed: int = 42) -> DataFrame:
    """Places by the seeded shuffle of Python's generator, which depends on the number of rows only. The permutation is made on the
    driver (8 bytes a row; use subsets() for pools beyond some hundred million rows) and joined by position."""
    spark, n = pool.sparkSession, pool.count()
    order = list(range(n))
    random.Random(seed).shuffle(order)
    places = spark.createDataFrame(((old, new) for new, old in enumerate(order)), "position bigint, pool_position bigint") if n else spark.createDataFrame([], "position bigint, pool_position bigint")
    ranked = pool.withColumn("_key", F.lpad(F.hex(F.col("order_idx")), 16, "0"))
    return positions(ranked, "_key", [], "position", 14).drop("_key").join(places, "position").drop("position")


def hash_shard(key: Column, shards: int) -> Column:
    """Shard by the first 16 hexadecimal digits of the key's sha256 as a number."""
    number = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(number, F.lit(shards).cast("decimal(20,0)")).cast("bigint")


def order_shard(position: Column, total: Column, shards: int) -> Column:
    """Shard by position: equal runs of consecutive rows."""
    return F.least(F.floor(position * shards / F.greatest(total, F.lit(1))).cast("bigint"), F.lit(shards - 1).cast("bigint"))


def template_index(key: Column, count: int, seed: int) -> Column:
    """A stable choice among ``count``: blake2b of the seed and the key, 8 bytes, modulo. There is no built-in, so it runs as an Arrow UDF."""
    def choose(keys: pd.Series) -> pd.Series:
        digest = lambda k: int.from_bytes(hashlib.blake2b(f"{seed}|{k}".encode(), digest_size=8).digest(), "big") % count
        return keys.map(digest, na_action="ignore").astype("Int64")

    return F.pandas_udf(choose, "bigint")(key)


def weighted_choice(key: Column, values: list[tuple[str, float]], seed: int) -> Column:
    """A stable weighted choice: the first value whose running weight reaches the key's draw. Without weights it is the first value."""
    total = sum(w for _, w in values)

    def pick(k: str) -> str:
        if total <= 0:
            return values[0][0]
        draw, run = random.Random(f"{seed}|{k}").random() * total, 0.0
        for value, weight in values:
            run += weight
            if draw <= run:
                return value
        return values[-1][0]

    def choose(keys: pd.Series) -> pd.Series:
        return keys.map(pick, na_action="ignore").astype(object).where(keys.notna(), None)

    return F.pandas_udf(choose, "string")(key) if values else F.lit("")
