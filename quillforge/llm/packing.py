"""Filling fixed-capacity sequences with whole texts (problem 6).

Method: length-histogram planning. Best fit runs over the counts of each length rather than over documents, so the plan depends on at
most ``capacity`` lengths whatever the number of documents. Documents then take the planned slots by joining on their rank within their
length. A text longer than a sequence is the only one split: into full sequences and a rest that is packed like any other item.

The plan is sent to the tasks; its size has a bound that no data can exceed: each length splits one group of equal sequences and opens two
at most, so there are at most 3 x capacity groups, and a group holds at most sqrt(2 x capacity) different lengths: for 2,048 tokens 393,216
ranges of 40 bytes, 16 MB.

Sizes are tokens of a public tokenizer, whose file is a parameter. Ranks within a length are worked out in two levels (a hash part
within the length, then the rank within the part), so that a length that holds a third of all documents is not ranked in one task.

Defined results: null and empty texts have no tokens and take no room; they are listed with a null sequence. Blank texts have tokens
like any other. Repeated documents each take a slot. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillforge.llm.chars import map_rows
from quillforge.session import checkpoint_folder

CAPACITY = 2_048
#: Rows of one length that one task ranks, about.
RANKED = 200_000
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def encoder(file: str = TOKENIZER):
    """A public tokenizer's encoding. ``file`` is a vocabulary's path, or the name of one that the installed package holds."""
    import os

    import public_tokenizers
    import tiktoken

    path = file if os.path.sep in file else public_tokenizers.path(file)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, file: str = TOKENIZER) -> DataFrame:
    """doc_id, a hash of its text, which tells rows of one doc_id apart, and the tokens of the text. One pass, two columns."""

    def make():
        encode = encoder(file).encode_ordinary

        def work(ids, texts, keys):
            return {"doc_id": ids, "text_key": keys, "tokens": [len(encode(t)) if t else 0 for t in texts]}

        return work

    return map_rows(documents.select("doc_id", "text", F.xxhash64("text").alias("text_key")), make, "doc_id bigint, text_key bigint, tokens bigint", text=1)


@dataclass
class Plan:
    """Ranges of ranks within a length and the slots they take, sorted by length and rank."""

    length: np.ndarray
    first: np.ndarray  # first rank of the range
    sequence: np.ndarray  # sequence of the first rank
    copies: np.ndarray  # items of this length that a sequence of the range holds
    offset: np.ndarray  # token offset of the first of them in its sequence
    sequences: int
    used: int

    def slots(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of items by their length and rank."""
        key = self.length.astype(np.int64) << 44 | self.first
        at = np.searchsorted(key, length.astype(np.int64) << 44 | rank, "right") - 1
        step = rank - self.first[at]
        return self.sequence[at] + step // self.copies[at], self.offset[at] + step % self.copies[at] * length


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best fit by decreasing length over counts. Sequences with the same content are one group with a count; each length splits at
    most one group and opens at most two, so the groups stay in proportion to the number of lengths."""
    if any(not 0 < x <= capacity for x in histogram):
        raise ValueError("lengths must lie between 1 and the capacity")
    # groups[room]: (count, content), content being a chain (content before, length, copies)
    groups: dict[int, list] = {}
    rooms = np.zeros(capacity + 1, bool)

    def put(room: int, count: int, content) -> None:
        groups.setdefault(room, []).append((count, content))
        rooms[room] = True

    for length in sorted(histogram, reverse=True):
        left = int(histogram[length])
        while left:
            fit = np.flatnonzero(rooms[length:])
            room = int(fit[0]) + length if len(fit) else capacity
            k = room // length
            if len(fit):
                count, content = groups[room].pop()
                if not groups[room]:
                    rooms[room] = False
            else:
                count, content = -(-left // k), None
            full = min(count, left // k)
            if full:
                put(room - k * length, full, (content, length, k))
            left -= full * k
            if full < count and left:
                put(room - left * length, 1, (content, length, left))
                full, left = full + 1, 0
            if full < count and content is not None:
                put(room, count - full, content)
                if left == 0:
                    break
    rows, taken, sequence, used = [], dict.fromkeys(histogram, 0), 0, 0
    for room in sorted(groups):
        for count, content in groups[room]:
            chain, at = [], 0
            while content is not None:
                content, length, k = content
                chain.append((length, k))
            for length, k in reversed(chain):
                rows.append((length, taken[length], sequence, k, at))
                taken[length] += count * k
                at += length * k
            sequence += count
            used += count * at
    if taken != {x: int(n) for x, n in histogram.items()}:
        raise AssertionError("the plan does not hold every item once")
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*a.T, sequences=sequence, used=used)


def pieces_of(counts: DataFrame, capacity: int) -> DataFrame:
    """Items: a text that fits is one; a longer one gives full sequences and a rest. doc_id, piece_no, first_token, tokens."""
    starts = F.when(F.col("tokens") > 0, F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("tokens") - 1, F.lit(0)), F.lit(capacity).cast("bigint")))
    items = counts.select("doc_id", "text_key", "tokens", F.posexplode_outer(starts).alias("piece_no", "first_token"))
    return items.select(
        "doc_id", "text_key", F.coalesce(F.col("piece_no").cast("bigint"), F.lit(0)).alias("piece_no"), F.coalesce("first_token", F.lit(0)).alias("first_token"),
        F.when(F.col("tokens") == 0, 0).otherwise(F.least(F.lit(capacity), F.col("tokens") - F.col("first_token"))).cast("bigint").alias("tokens"))


def ranked(items: DataFrame, total: int) -> DataFrame:
    """Items with their rank within their length, from 0, in two levels."""
    parts = max(8, -(-total // RANKED))
    part = items.withColumn("_part", F.pmod(F.xxhash64("doc_id", "text_key", "piece_no"), F.lit(parts)))
    before = (
        part.groupBy("tokens", "_part").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("tokens").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
        .select("tokens", "_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    within = F.row_number().over(Window.partitionBy("tokens", "_part").orderBy("doc_id", "text_key", "piece_no"))
    return part.withColumn("_rank", within).join(before, ["tokens", "_part"]).select(
        "doc_id", "text_key", "piece_no", "first_token", "tokens", (F.col("_before") + F.col("_rank") - 1).cast("bigint").alias("rank"))


def placed(documents: DataFrame, capacity: int, file: str) -> DataFrame:
    """Every document's pieces with the sequence and the place in it that they take, and the hash of the document's text."""
    checkpoint_folder(documents.sparkSession)
    counts = token_counts(documents, file).checkpoint()
    items = pieces_of(counts, capacity)
    filled = items.where("tokens > 0")
    # at most ``capacity`` rows
    histogram = {r["tokens"]: r["count"] for r in filled.groupBy("tokens").count().collect()}
    none = items.where("tokens = 0").select("*", F.lit(None).cast("bigint").alias("sequence_id"), F.lit(None).cast("bigint").alias("at_token"))
    if not histogram:
        return none
    p, total = plan(histogram, capacity), sum(histogram.values())

    def make():
        def work(ids, keys, piece, first, tokens, rank):
            length = np.array(tokens, np.int64)
            sequence, at = p.slots(length, np.array(rank, np.int64))
            return {"doc_id": ids, "text_key": keys, "piece_no": piece, "first_token": first, "tokens": tokens, "sequence_id": sequence, "at_token": at}

        return work

    schema = "doc_id bigint, text_key bigint, piece_no bigint, first_token bigint, tokens bigint, sequence_id bigint, at_token bigint"
    return map_rows(ranked(filled, total), make, schema, text=-1).unionByName(none)


def packed(documents: DataFrame, capacity: int = CAPACITY, file: str = TOKENIZER) -> DataFrame:
    """Every document's pieces with the sequence and the place in it that they take."""
    return placed(documents, capacity, file).drop("text_key")


def token_rows(documents: DataFrame, capacity: int = CAPACITY, file: str = TOKENIZER) -> DataFrame:
    """The filled sequences: sequence_id, items and token_ids (``capacity`` at most). A document's places are brought to it once, so that it is
    tokenized once however many pieces it gives; a sequence's items are bounded by its capacity."""
    places = placed(documents, capacity, file).where("sequence_id is not null")
    by_document = places.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first_token", "tokens", "sequence_id", "at_token")).alias("places"))
    # rows that repeat both id and text are brought once and fill the places of all copies
    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("text_key")).dropDuplicates(["doc_id", "text_key"])
    joined = by_document.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "places").join(
        texts, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key"))).select("places", "text")

    def make():
        encode = encoder(file).encode_ordinary

        def work(places, texts):
            out = {"sequence_id": [], "at_token": [], "ids": []}
            for spots, text in zip(places, texts):
                ids = encode(text)
                for p in spots:
                    out["sequence_id"].append(p["sequence_id"])
                    out["at_token"].append(p["at_token"])
                    out["ids"].append(ids[p["first_token"] : p["first_token"] + p["tokens"]])
            return out

        return work

    parts = map_rows(joined, make, "sequence_id bigint, at_token bigint, ids array<int>", text=1, scan=False)
    whole = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("at_token", "ids"))).alias("_parts"))
    return whole.select("sequence_id", F.size("_parts").cast("bigint").alias("items"), F.flatten(F.transform("_parts", lambda p: p["ids"])).alias("token_ids"))


def fill_report(documents: DataFrame, capacity: int = CAPACITY, file: str = TOKENIZER) -> DataFrame:
    """Sequences, tokens in them and the share of room left unused."""
    by = packed(documents, capacity, file).where("sequence_id is not null").groupBy("sequence_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"))
    return by.agg(
        F.count("*").alias("sequences"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"),
        F.round(1 - F.sum("tokens") / (F.count("*") * capacity), 6).alias("unused_share"))
