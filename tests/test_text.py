"""Text features against brute force."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quillforge.functions import text as T
from quillforge.functions.repeats import longest_unit_runs, unit_runs

IGNORED = set(T.IGNORED_BIGRAMS)


def brute_span(tokens, longest=24):
    best = (1, 0, 0)
    for k in (2, 3, 4, 6, 8, 12, 16, 24):
        if k > longest or 2 * k > len(tokens):
            continue
        i = 0
        while i + 2 * k <= len(tokens):
            unit, run = tokens[i : i + k], 1
            if len(set(unit)) > 1:
                while tokens[i + run * k : i + (run + 1) * k] == unit:
                    run += 1
            if run > 1:
                if run * k > best[2]:
                    best = (run, k, run * k)
                i += run * k
            else:
                i += 1
    return best


def brute_ngram(tokens, low, high):
    best = (1, 0)
    for n in (2, 3, 4, 6, 8, 12):
        if low <= n <= high and 2 * n <= len(tokens):
            grams = [tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)]
            grams = [g for g in grams if not (n <= 3 and len(set(g)) == 1) and g not in IGNORED]
            top = max(Counter(grams).values(), default=0)
            if top * n > best[0] * max(best[1], 1):
                best = (top, n)
    return (*best, min(1.0, best[0] * best[1] / max(1, len(tokens))) if best[1] else 0.0)


def brute_chars(text, units=16, most=6000):
    if len(text) > most:
        text = text[: most // 2] + text[-(most // 2) :]
    best = 1
    for k in range(1, units + 1):
        for m in re.finditer(r"(.{%d})\1+" % k, text, re.S):
            if m.group(1).strip():
                best = max(best, len(m.group()) // k)
    return best


def test_repetition_against_brute_force(spark):
    rng = random.Random(3)
    lists = [[rng.choice("abc가"[: rng.randint(2, 4)]) for _ in range(rng.randint(0, 40))] for _ in range(120)]
    lists += [list("abaababbabbab"), [], ["할", "수"] * 8, ["x"] * 9, list("abcabcabcabdabd")]
    df = spark.createDataFrame([(i, x, "".join(x)) for i, x in enumerate(lists)], "i int, t array<string>, s string")
    t = F.col("t")
    rows = df.select("i", T.span_repeat(t).alias("span"), T.ngram_repeat(t, 2, 2).alias("two"), T.ngram_repeat(t, 3, 12).alias("many"), T.longest_run(t).alias("run"),
                     T.most_equal(t).alias("top"), unit_runs(F.col("s")).alias("chars")).collect()
    for r in rows:
        x = lists[r["i"]]
        assert tuple(r["span"]) == brute_span(x), x
        assert tuple(r["two"]) == brute_ngram(x, 2, 2), x
        assert tuple(r["many"]) == brute_ngram(x, 3, 12), x
        assert r["top"] == max(Counter(x).values(), default=0)
        assert r["chars"] == brute_chars("".join(x))
        run = best = 1
        for a, b in zip(x, x[1:]):
            run = run + 1 if a == b else 1
            best = max(best, run)
        assert r["run"] == best


def test_white_space_words_and_bounds(spark):
    df = spark.createDataFrame([("　 a b\x1c\n",), ("",), (None,), ("x" * 7000,)], "s string")
    got = df.select(T.strip("s").alias("a"), T.word_count("s").alias("n"), T.has_text(F.col("s")).alias("h"), F.length(T.bounded_text(F.col("s"), 6000)).alias("b")).collect()
    assert [tuple(r) for r in got] == [("a b", 2, True, 7), ("", 0, False, 0), (None, None, False, None), ("x" * 7000, 1, True, 6000)]
    odd = spark.createDataFrame([(list("abcdefg"),)], "t array<string>").select(T.bounded(F.col("t"), 5)).first()[0]
    assert odd == list("abfg")


def test_overlap_and_clauses(spark):
    df = spark.createDataFrame([("The bank raised rates", "bank bank raised 금리를"), ("", "abc"), ("ab cd", "ab")], "s string, m string")
    got = [tuple(r) for r in df.select(T.source_overlap(F.col("s"), F.col("m")), T.output_precision(F.col("s"), F.col("m"))).collect()]
    assert got == [(0.5, 0.75), (0.0, 0.0), (0.0, 0.0)]
    c = spark.createDataFrame([("같은 문장이 또 나온다 정말. 같은 문장이 또 나온다 정말! 다른 문장도 하나 나온다고",), ("짧다",)], "s string")
    assert [tuple(r[0]) for r in c.select(T.clause_duplication(F.col("s"))).collect()] == [(2, 2 / 3), (1, 0.0)]


def test_unit_runs_against_brute_force():
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab 가") for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["", " " * 50, "ab" * 5000, "하하하하", "x" * 13_000, "a\n" * 9]
    assert longest_unit_runs(texts, 16, 6000) == [brute_chars(t) for t in texts]
    assert longest_unit_runs(texts, 3, 40) == [brute_chars(t, 3, 40) for t in texts]
