"""Vectorised character work shared by the text operators: many texts laid end to end in one numpy array."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from quillforge.sources.tables import spread

#: Rows and characters that one vectorised step handles at most, which bounds a worker's memory whatever the batch.
STEP_ROWS, STEP_CHARS = 6_000, 1_500_000
#: Bytes of a slot's parts that wait to be merged, whatever was merged before.
HELD_BYTES = 4_000_000


def fold_table() -> np.ndarray:
    """Lower case and one digit class for the basic plane; other characters stay as they are."""
    out = np.arange(0x10000, dtype=np.uint32)
    for c in range(0x590):
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    out[[*range(0x30, 0x3A), *range(0xFF10, 0xFF1A)]] = ord("0")
    out[[0xA0, 0x3000, 0x09, 0x2007, 0x202F, *range(0x2000, 0x200B)]] = ord(" ")
    return out


FOLD = fold_table()


def parted(ends: re.Pattern, text: str) -> list[str]:
    """The parts of a text between the matches of ``ends``, each of which begins with a mark that stays in its part, a line end, or a slash,
    which needs a space before it that no match has taken."""
    last, parts = 0, []
    for m in ends.finditer(text):
        at, behind = m.span()
        mark = text[at]
        if mark == "/":
            at -= 1
            if at < last:
                continue
        elif mark != "\n":
            at += 1
        parts.append(text[last:at])
        last = behind
    parts.append(text[last:])
    return parts


class Chars:
    """Texts as code points in one array, each text followed by ``pad`` zeros."""

    def __init__(self, texts: list[str], pad: int = 8):
        gap = "\0" * pad
        self.raw = np.frombuffer((gap.join(texts) + gap).encode("utf-32-le", "replace"), dtype=np.uint32)
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.concatenate(([0], np.cumsum(self.lengths + pad)[:-1])).astype(np.int64) if texts else np.zeros(0, np.int64)

    def folded(self) -> np.ndarray:
        return folded(self.raw)


def folded(raw: np.ndarray) -> np.ndarray:
    """The codes of characters, lower case and with one digit class."""
    out = np.take(FOLD, raw, mode="clip")
    if len(raw) and raw.max() >= 0x10000:
        beyond = np.flatnonzero(raw >= 0x10000)
        out[beyond] = raw[beyond]
    return out


def grams(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The hash of the n codes that start at each position, to ``bits`` bits; positions near the end wrap into the padding."""
    return gram_orders(codes, [n], bits)[0]


def gram_orders(codes: np.ndarray, orders: Iterable[int], bits: int) -> list[np.ndarray]:
    """``grams`` for several n in rising order, of which each goes on from the one before."""
    h, out, k = np.zeros(len(codes), np.uint32), [], 0
    for n in orders:
        for k in range(k, n):
            h *= np.uint32(0x01000193)
            if k:
                h[:-k] += codes[k:]
            else:
                h += codes
        k = n
        m = h ^ h >> np.uint32(15)
        m *= np.uint32(0x2C1B3C6D)
        m ^= m >> np.uint32(12)
        m >>= np.uint32(32 - bits)
        out.append(m)
    return out


def steps(columns: list[list], text: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows within STEP_ROWS and STEP_CHARS; a single longer text makes a range of its own."""
    at, total, rows = 0, 0, columns[text]
    for i, x in enumerate(rows):
        size = len(x or "")
        if i > at and (i - at >= STEP_ROWS or total + size > STEP_CHARS):
            yield at, i
            at, total = i, 0
        total += size
    if at < len(rows):
        yield at, len(rows)


def map_rows(df: DataFrame, make, schema: str, text: int = 0, scan: bool = True) -> DataFrame:
    """Run ``make()`` once a task and its result on lists of columns, step by step; it returns a dict of output columns. ``text`` is the
    column whose length bounds a step (-1: none has long values); ``scan`` tells that df is a plain scan, whose rows may be spread."""

    fields = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for a, b in (steps(columns, text) if text >= 0 else [(0, len(columns[0]))] * bool(columns[0])):
                out = work(*[c[a:b] for c in columns])
                if out is not None:
                    yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out, schema=fields)

    return (spread(df) if scan and text >= 0 else df).mapInArrow(run, schema)


def gathered(df: DataFrame, start, merge, text: int, slots: int, finish=None) -> dict[int, bytes]:
    """What all rows of df add up to, by slot. ``start()`` makes a task's work, whose add() takes lists of columns step by step and whose parts()
    gives pairs of slot and bytes; the parts of a slot are merged in the slot's own task, as soon as they are more than twice what was merged
    last, and ``finish`` is applied to the result, so that the driver gets one value a slot."""
    schema = "slot int, data binary"
    fields = pa.schema([("slot", pa.int32()), ("data", pa.binary())])

    def rows(pairs: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        for slot, data in pairs:
            yield pa.RecordBatch.from_pydict({"slot": [slot], "data": [data]}, schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for a, b in steps(columns, text):
                work.add(*[c[a:b] for c in columns])
        yield from rows(work.parts())

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for slot, data in zip(batch["slot"].to_pylist(), batch["data"].to_pylist()):
                some = held.setdefault(slot, [])
                some.append(data)
                if len(some) > 2 and sum(map(len, some[1:])) > 2 * max(len(some[0]), HELD_BYTES):
                    held[slot] = [merge(*some)]
        for k, some in held.items():
            data = merge(*some) if len(some) > 1 else some[0]
            yield from rows([(k, finish(k, data) if finish else data)])

    parts = df.mapInArrow(run, schema).repartition(slots, "slot").mapInArrow(fold, schema)
    return {r["slot"]: bytes(r["data"]) for r in parts.collect()}


def hash_sample(df: DataFrame, key: str, rows: int, salt: str = "sample", where: Column | None = None, pool: int = 0) -> list:
    """At most ``rows`` rows, the lowest by a hash of ``key``. The rate comes from the table's row count, which the footers hold, so
    that the rows collected stay near ``rows`` whatever the table's size, and the same keys come back on every run. With ``where``, a
    costly condition, the rows come from a hash sample of ``pool`` rows, so that only these are tested."""
    total = df.count()
    if not total:
        return []
    rank = F.pmod(F.xxhash64(F.lit(salt), F.col(key).cast("string")), F.lit(1 << 30))
    part, take = df.withColumn("_rank", rank), max(rows, pool)
    if total > take:
        part = part.where(F.col("_rank") < int((1 << 30) * min(1.0, 1.1 * take / total + 20 / total)))
    if where is not None:
        part = part.where(where)
    # rows of one key share their hash: one row a key keeps what is collected bounded, however many rows a key has
    return sorted(part.dropDuplicates([key]).collect(), key=lambda r: (r["_rank"], str(r[key])))[:rows]


def strata_sample(df: DataFrame, key: str, by: str, stratum, rows: int, salt: str = "sample") -> list:
    """About ``rows`` rows at most of each stratum, the lowest by a hash of ``key``, each with its stratum as ``_stratum``. ``stratum``
    maps a value of the column ``by`` to its stratum or null; of the values, the 10,000 most frequent are considered."""
    values = df.groupBy(by).count().orderBy(F.desc("count"), by).limit(10_000).collect()
    of = {r[by]: s for r in values if r[by] is not None and (s := stratum(r[by])) is not None}
    total: dict = {}
    for r in values:
        if r[by] in of:
            total[of[r[by]]] = total.get(of[r[by]], 0) + r["count"]
    if not of:
        return []
    part = F.create_map(*(x for v, s in of.items() for x in (F.lit(v), F.lit(int((1 << 30) * min(1.0, 1.1 * rows / total[s] + 20 / total[s]))))))
    rank = F.pmod(F.xxhash64(F.lit(salt), F.col(key).cast("string")), F.lit(1 << 30))
    found = df.where(F.col(by).isin(*of)).withColumn("_rank", rank).where(F.col("_rank") < F.element_at(part, F.col(by))).dropDuplicates([key]).collect()
    out, left = [], dict.fromkeys(total, rows)
    for r in sorted(found, key=lambda r: (r["_rank"], str(r[key]))):
        s = of[r[by]]
        if left[s] > 0:
            left[s] -= 1
            out.append((s, r))
    return out
