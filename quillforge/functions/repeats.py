"""Runs of repeated character units. Sixteen back-reference expressions per text take most of the classifier's time in the JVM; here whole
batches are compared with themselves, shifted by each unit length, so it runs as an Arrow UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def streaks(equal: np.ndarray) -> np.ndarray:
    """For each position the number of true values in a row from there on."""
    n = len(equal)
    stops = np.where(~equal, np.arange(n), n)
    return np.minimum.accumulate(stops[::-1])[::-1] - np.arange(n)


def longest_unit_runs(texts: list[str], longest_unit: int, most: int) -> list[int]:
    """For each text the longest run of a unit of 1 to ``longest_unit`` characters: scanned from the left, greedy, without overlap; blank
    units do not count; at least 1. Texts over ``most`` characters are cut to their first and last half of it."""
    half = most // 2
    cut = [t if len(t) <= most else t[:half] + t[len(t) - half :] for t in texts]
    gap = longest_unit + 1
    # separators of private characters, all different, keep runs from crossing from text to text
    apart = "".join(chr(0xF0000 + i) for i in range(gap))
    joined = np.frombuffer("".join(t + apart for t in cut).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.fromiter(map(len, cut), np.int64, len(cut))
    starts = np.concatenate(([0], np.cumsum(lengths + gap)[:-1])) if len(cut) else np.zeros(0, np.int64)
    best = np.ones(len(cut), np.int64)
    for k in range(1, longest_unit + 1):
        equal = np.zeros(len(joined), bool)
        equal[:-k] = joined[:-k] == joined[k:]
        run = streaks(equal)
        hits = np.flatnonzero(run >= k)
        if not len(hits):
            continue
        owner = np.searchsorted(starts, hits, "right") - 1
        end, last = -1, -1
        for i, o in zip(hits.tolist(), owner.tolist()):
            if o == last and i < end:
                continue
            times = int(run[i]) // k + 1
            last, end = o, i + times * k
            a = i - int(starts[o])
            if times > best[o] and cut[o][a : a + k].strip():
                best[o] = times
    return best.tolist()


def unit_runs(c: Column, longest_unit: int = 16, most: int = 6000) -> Column:
    """longest_unit_runs of a column; null for null."""

    def run(texts: pd.Series) -> pd.Series:
        there = texts.notna().tolist()
        values = [t for t, ok in zip(texts, there) if ok]
        found: list[int] = []
        at = 0
        while at < len(values):  # steps bound the memory
            upto, size = at, 0
            while upto < len(values) and (upto == at or size < 1_000_000):
                size += min(len(values[upto]), most)
                upto += 1
            found += longest_unit_runs(values[at:upto], longest_unit, most)
            at = upto
        rest = iter(found)
        return pd.Series([next(rest) if ok else None for ok in there], dtype="Int64")

    # declared so that the optimizer neither moves it into a branch nor evaluates it twice
    return F.pandas_udf(run, "bigint").asNondeterministic()(c)
