"""Text expressions. All are built-in Spark expressions, so they stay in the JVM and inside generated code.

Null in, null out, unless a docstring says otherwise. White space is Unicode white space with the four ASCII separators.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and word lists that labels depend on.
SPACE = r"[\s\x1C-\x1F]"
NOT_SPACE = r"[^\s\x1C-\x1F]"
WORD = r"[A-Za-z0-9가-힣\x{00C0}-\x{024F}]+"
HANGUL = r"[가-힣]"
LATIN = r"[A-Za-z]"
LATIN_EXTENDED = r"[\x{00C0}-\x{024F}]"
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"
KANA = r"[\x{3040}-\x{30FF}]"
OTHER_SCRIPT = r"[\x{0400}-\x{04FF}\x{0600}-\x{06FF}\x{0E00}-\x{0E7F}\x{0900}-\x{097F}\x{0370}-\x{03FF}]"
AUXILIARIES = "am are be been being can could did do does had has have is may might must shall should was were will would".split()
KO_FUNCTION_WORDS = ["의", "및", "등", "또는", "그리고", "거나", "이나", "하며"]
IGNORED_BIGRAMS = [("할", "수"), ("수", "있습니다"), ("수", "있다"), ("수", "있는"), ("될", "수"), ("있을", "수")]
CLAUSE_END = r"[.!?。！？\n;；,，]+"
NOT_WORD = r"[^0-9A-Za-z가-힣\x{00C0}-\x{024F}]+"
SENTENCE_FINAL = "[.!?。！？…\"')\\]”’]\\z"


def strip(c: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def rstrip(c: Column | str) -> Column:
    return F.regexp_replace(c, rf"(?U){SPACE}+\z", "")


def has_text(c: Column) -> Column:
    """Whether there is a character other than white space; false for null."""
    return F.coalesce(c.rlike(rf"(?U){NOT_SPACE}"), F.lit(False))


def word_count(c: Column | str) -> Column:
    """Runs of characters without white space."""
    return F.regexp_count(c, F.lit(rf"(?U){NOT_SPACE}+")).cast("bigint")


def words(c: Column | str) -> Column:
    """Words of letters, digits, Hangul and extended Latin, in lower case."""
    return F.transform(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), F.lower)


def raw_words(c: Column | str) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def bounded(tokens: Column, most: int) -> Column:
    """At most ``most`` tokens: the first and the last half where there are more."""
    half = most // 2
    return F.when(F.size(tokens) > most, F.concat(F.slice(tokens, 1, half), F.slice(tokens, -half, half))).otherwise(tokens)


def bounded_text(c: Column, most: int) -> Column:
    """The same cut on characters."""
    half = most // 2
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, half), F.right(c, F.lit(half)))).otherwise(c)


def count_of(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("bigint")


def script_counts(c: Column) -> dict[str, Column]:
    """Characters by script."""
    classes = {"hangul": HANGUL, "latin": LATIN, "latin_ext": LATIN_EXTENDED, "cjk": CJK, "kana": KANA, "other": OTHER_SCRIPT}
    return {k: count_of(c, v) for k, v in classes.items()}


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, so that expressions grow in proportion to what they do."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ratio(count: Column, total: Column) -> Column:
    """count / max(total, 1)."""
    return count.cast("double") / F.greatest(total, F.lit(1)).cast("double")


def long_words(c: Column | str, least: int = 3) -> Column:
    return F.filter(words(c), lambda w: F.length(w) >= least)


def source_overlap(source: Column, output: Column) -> Column:
    """Share of the source's distinct words of three or more characters that the output has; 0 where the source has none."""
    share = lambda s: F.when(F.size(s) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(s, long_words(output))).cast("double") / F.size(s))
    return let(F.array_distinct(long_words(source)), share)


def output_precision(source: Column, output: Column) -> Column:
    """Share of the output's words of three or more characters, repeats counted, that the source has; 0 where either has none."""

    def share(x: Column) -> Column:
        s, m = x["s"], x["m"]
        copied = F.size(F.filter(m, lambda w: F.array_contains(x["both"], w)))
        return F.when((F.size(s) == 0) | (F.size(m) == 0) | (F.size(x["both"]) == 0), F.lit(0.0)).otherwise(copied.cast("double") / F.size(m))

    words_of = F.struct(F.array_distinct(long_words(source)).alias("s"), long_words(output).alias("m"))
    return let(words_of, lambda x: let(F.struct(x["s"].alias("s"), x["m"].alias("m"), F.array_intersect(x["m"], x["s"]).alias("both")), share))


def has_auxiliary(c: Column) -> Column:
    return F.arrays_overlap(words(c), F.array(*map(F.lit, AUXILIARIES)))


def ends_sentence(c: Column) -> Column:
    return rstrip(c).rlike(SENTENCE_FINAL)


def source_ends_sentence(c: Column) -> Column:
    """Ends with a closing mark that is not the full stop of an initial."""
    return ends_sentence(c) & ~rstrip(c).rlike(r"(?U)\b[A-Z]\.\z")


def mixed_script_words(c: Column) -> Column:
    """Words of five or more characters that hold Hangul and Latin letters."""
    return F.size(F.filter(raw_words(c), lambda w: (F.length(w) >= 5) & w.rlike(HANGUL) & w.rlike(rf"{LATIN}|{LATIN_EXTENDED}"))).cast("bigint")


def any_suffix(c: Column, suffixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.endswith(s) for s in suffixes], F.lit(False))


# Repetition.


def longest_run(tokens: Column) -> Column:
    """Longest run of equal tokens, at least 1."""
    zero = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(1).alias("best"))

    def step(state, token):
        run = F.when(token.eqNullSafe(state["last"]), state["run"] + 1).otherwise(F.lit(1))
        return let(run, lambda r: F.struct(token.alias("last"), r.alias("run"), F.greatest(state["best"], r).alias("best")))

    return F.aggregate(tokens, zero, step, lambda s: s["best"]).cast("bigint")


def most_equal(values: Column) -> Column:
    """Number of times the most frequent value occurs; 0 for an empty array. Sorting puts equal values side by side, without a shuffle."""
    return let(F.sort_array(values), lambda v: F.when(F.size(v) == 0, F.lit(0).cast("bigint")).otherwise(longest_run(v)))


def function_words(tokens: Column) -> Column:
    listed = F.array(*map(F.lit, KO_FUNCTION_WORDS))
    return F.filter(tokens, lambda w: F.array_contains(listed, w))


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of an array as strings; without uniform ones for n up to 3, and without the ignored pairs."""
    at = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    parts = F.transform(at, lambda i: F.slice(tokens, i, n))
    if n <= 3:
        parts = F.filter(parts, lambda p: F.size(F.array_distinct(p)) > 1)
    grams = F.transform(parts, lambda p: F.array_join(p, "\x1f"))
    if n == 2:
        ignored = F.array(*[F.lit("\x1f".join(x)) for x in IGNORED_BIGRAMS])
        grams = F.filter(grams, lambda g: ~F.array_contains(ignored, g))
    return grams


def ngram_repeat(tokens: Column, low: int, high: int) -> Column:
    """(count, n, coverage) of the n-gram with the largest count x n; the smallest n wins ties. Only n up to half the tokens count, and
    with no eligible n the result is (1, 0, 0)."""

    def case(n: int) -> Column:
        count = F.when(F.size(tokens) >= 2 * n, most_equal(ngrams(tokens, n))).otherwise(F.lit(0).cast("bigint"))
        return let(count, lambda c: F.struct((c * n).alias("score"), F.lit(-n).cast("bigint").alias("minus_n"), c.alias("count")))

    cases = [case(n) for n in (2, 3, 4, 6, 8, 12) if low <= n <= high]
    best = F.array_max(F.filter(F.array(*cases), lambda c: c["score"] > 1))
    none = F.struct(F.lit(1).cast("bigint").alias("count"), F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("coverage"))
    share = lambda b: F.least(F.lit(1.0), b["score"].cast("double") / F.greatest(F.size(tokens), F.lit(1)))
    return let(best, lambda b: F.when(b.isNull(), none).otherwise(F.struct(b["count"].alias("count"), (-b["minus_n"]).alias("n"), share(b).alias("coverage"))))


def clauses(c: Column, least: int = 10) -> Column:
    """Normalised clauses of at least ``least`` characters."""
    parts = F.transform(F.split(c, CLAUSE_END), lambda x: F.lower(F.regexp_replace(x, NOT_WORD, "")))
    return F.filter(parts, lambda x: F.length(x) >= least)


def clause_duplication(c: Column, least: int = 10) -> Column:
    """(largest count of a clause, share of the clauses that occur more than once); (1, 0) without clauses."""

    def measure(found):
        # equal clauses stand together: one without an equal neighbour is single
        alone = lambda x, i: ~F.coalesce(F.get(found, i - 1) == x, F.lit(False)) & ~F.coalesce(F.get(found, i + 1) == x, F.lit(False))
        single, n = F.filter(found, alone), F.size(found)
        return F.when(n == 0, F.struct(F.lit(1).cast("bigint").alias("count"), F.lit(0.0).alias("ratio"))).otherwise(
            F.struct(longest_run(found).alias("count"), ((n - F.size(single)).cast("double") / n).alias("ratio")))

    return let(F.sort_array(clauses(c, least)), measure)


def span_repeat(tokens: Column, longest: int = 24) -> Column:
    """(run, span, score) of the immediately repeated token span with the largest run x span. Each span length is scanned from left to
    right; a run found is jumped over, and spans of one repeated token are passed by. The shortest span wins ties."""
    n = F.size(tokens)

    def case(k: int) -> Column:
        def step(s: Column, i: Column) -> Column:
            span = F.slice(tokens, i, k)
            starts = (i >= s["open"]) & (span == F.slice(tokens, i + k, k)) & (F.size(F.array_distinct(span)) > 1)
            room = F.floor((n - i + 1) / k).cast("int")
            # how often the span stands in a row: up to the first place where it does not
            other = F.filter(F.sequence(F.lit(1), room - 1), lambda j: F.slice(tokens, i + j * k, k) != span)
            run = F.when(F.size(other) == 0, room).otherwise(F.element_at(other, 1))
            return F.when(starts, let(run, lambda r: F.struct((i + r * k).alias("open"), F.greatest(s["run"], r).alias("run")))).otherwise(s)

        zero = F.struct(F.lit(1).alias("open"), F.lit(0).alias("run"))
        run = F.when(n >= 2 * k, F.aggregate(F.sequence(F.lit(1), n - 2 * k + 1), zero, step, lambda s: s["run"])).otherwise(F.lit(0))
        return let(run, lambda r: F.struct((r * k).alias("score"), F.lit(-k).alias("minus_span"), r.alias("run")))

    cases = [case(k) for k in (2, 3, 4, 6, 8, 12, 16, 24) if k <= longest]
    best = F.array_max(F.filter(F.array(*cases), lambda c: c["run"] >= 2))
    values = lambda b: {"run": F.coalesce(b["run"], F.lit(1)), "span": F.coalesce(-b["minus_span"], F.lit(0)), "score": F.coalesce(b["score"], F.lit(0))}
    return let(best, lambda b: F.struct(*(v.cast("bigint").alias(k) for k, v in values(b).items())))
