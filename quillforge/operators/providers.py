"""Calls of models: an interface, and a table of prompts in, a table of answers out.

A provider is any picklable object with ``name``, ``model`` and ``complete(system, prompt)``, which gives a dict with ``text`` and, if known, ``usage`` (a dict of
whole numbers) and ``latency_ms``. Network clients are the caller's; none is shipped. Batches of prompts are the rows; Spark's tasks are the parallel callers.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

ANSWERS = "batch_idx bigint, item_ids array<string>, status string, provider string, model string, attempts bigint, raw_text string, latency_ms double, usage map<string,bigint>, error string"
#: Longest pause between two attempts, in seconds.
LONGEST_PAUSE = 15.0


class Provider(Protocol):
    name: str
    model: str

    def complete(self, system: str, prompt: str) -> dict: ...


@dataclass(frozen=True)
class Weighted:
    """A provider and its share of the batches."""

    provider: Provider
    weight: float


def enabled(providers: list[Weighted]) -> list[Weighted]:
    """Those with a positive weight; none is an error."""
    out = [p for p in providers if p.weight and p.weight > 0]
    if not out:
        raise ValueError("no provider has a positive weight")
    return out


def chosen(providers: list[Weighted], batch: int, seed: int = 42) -> Provider:
    """The provider of a batch: a weighted draw that depends on the seed and the batch only, so that a repeated task asks the same one."""
    draw = random.Random(f"{seed}|teacher|{batch}").random() * sum(p.weight for p in providers)
    for p in providers:
        draw -= p.weight
        if draw <= 0:
            return p.provider
    return providers[-1].provider


def parses(text: str, ids: list[str]) -> None:
    """An error unless the text is a JSON object whose items carry exactly the ids asked for."""
    body = json.loads(text)
    got = [str(x.get("id")) for x in body["items"]] if isinstance(body, dict) and isinstance(body.get("items"), list) else None
    if got is None:
        raise ValueError("the answer has no list of items")
    if sorted(got) != sorted(ids):
        raise ValueError(f"the answer's ids differ from the {len(ids)} asked for")


def called(provider: Provider, system: str, prompt: str, ids: list[str], attempts: int, check: Callable[[str, list[str]], None], pause: Callable[[float], None]) -> dict:
    """One batch's answer. An attempt whose call or check fails is followed by another, after a pause that doubles; the last error is kept."""
    text, error = "", ""
    for n in range(1, attempts + 1):
        try:
            got = provider.complete(system, prompt)
            text = str(got.get("text") or "")
            check(text, ids)
        except (ValueError, RuntimeError, KeyError, TypeError, AttributeError, OSError) as e:
            error = str(e) or type(e).__name__
            if n < attempts:
                pause(min(2.0 ** (n - 1), LONGEST_PAUSE))
            continue
        usage = {k: int(v) for k, v in (got.get("usage") or {}).items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
        return {"status": "ok", "attempts": n, "raw_text": text, "latency_ms": got.get("latency_ms"), "usage": usage, "error": None}
    return {"status": "failed", "attempts": attempts, "raw_text": text, "latency_ms": None, "usage": {}, "error": error}


def ask(prompts: DataFrame, providers: list[Weighted], system: str, attempts: int = 3, callers: int = 50, seed: int = 42, check: Callable[[str, list[str]], None] = parses, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """Answers to batches of prompts (batch_idx, item_ids, prompt), one row a batch, failed ones included. ``callers`` tasks call at once. Write the result before
    it is used twice: a model may answer differently the second time. An empty system prompt is an error, as are attempts below one."""
    if not system.strip() or attempts < 1:
        raise ValueError("a system prompt and at least one attempt are needed")
    some = enabled(providers)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for batch, ids, prompt in zip(frame["batch_idx"], frame["item_ids"], frame["prompt"]):
                p = chosen(some, int(batch), seed)
                out.append({"batch_idx": batch, "item_ids": list(ids), "provider": p.name, "model": p.model, **called(p, system, prompt, [str(i) for i in ids], attempts, check, pause)})
            yield pd.DataFrame(out, columns=[f.split()[0] for f in ANSWERS.split(", ")])

    return prompts.select("batch_idx", "item_ids", "prompt").repartition(callers, "batch_idx").mapInPandas(run, ANSWERS)
