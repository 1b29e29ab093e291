"""Labels for degenerate model output, as one plan of built-in expressions.

The costly features are worked out only for rows that pass a cheap gate, and a source's features only for rows whose output is suspect:
the gates change results, so they are part of the operator.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillforge.functions import text as T
from quillforge.functions.repeats import unit_runs

# Patterns (Java syntax; the flags stand for ignoring case, Unicode classes, lines ending at \n only).
THINKING = r"(?iU)<\s*/?\s*think\s*>|\bwe need to translate\b|\blet'?s understand\b|\bpossible translation\b"
ARTIFACT = (
    r"(?iUmsd)<\|im_(?:start|end)\|>|<\|endoftext\|>"
    r"|(^|\n)\s*(?:system|assistant|user)\s*[:：]?\s*($|\n)"
    r"|당신은\s*경제.*전문\s*번역가"
    r"|전문(?:적인)?\s*영어\s*[-–—]\s*한국어\s*번역가"
    r"|전문\s*번역가입니다|번역\s*지침|번역\s*결과만\s*출력|원문에\s*없는\s*설명|한국어\s*번역문만\s*출력"
    r"|해당\s*문장.*영어.*한국어.*번역하세요"
    r"|영어에서\s*한국어로\s*번역(?:하세요|해\s*주세요)|한국어로\s*번역해\s*주세요"
    r"|다음\s*영어\s*(?:문장|텍스트|원문).*(?:번역|한국어)"
    r"|사용자가\s*익숙한\s*단어.*(?:구문|개념).*번역|아래\s*세부\s*정보.*번역"
    r"|번역할\s*수\s*없(?:습니다|다)|정확한\s*번역을\s*위해|전체\s*문장은\s*다음과\s*같이\s*번역"
    r"|Korean\s+translation\s*[:：]"
)
LABEL = r"(?iU)(^|\n|\s)(?:원문|영어|한국어|번역문)\s*[:：]"
PREAMBLE = (
    r"(?iU)^\s*(?:네|예|물론입니다|물론|알겠습니다)[,.! ]*(?:제가\s*)?(?:번역(?:을)?\s*(?:도와|해)|한국어로\s*번역)"
    r"|^\s*(?:아래|다음)(?:은|는)?\s*(?:요청하신\s*)?(?:한국어\s*)?번역(?:문)?"
    r"|^\s*번역(?:문)?\s*[:：]|^\s*Here\s+is\s+(?:the\s+)?(?:Korean\s+)?translation"
    r"|^\s*Here\s+are\s+(?:a\s+few|some|several)\s+(?:ways\s+to\s+translate|options\s+for\s+(?:the\s+)?(?:Korean\s+)?translation)\b"
)
SUFFIXES = ["이었으며", "였으며", "었으며", "했으며", "되었으며", "이며", "하며", "하고", "했고", "하였고", "되었고", "하기 위해", "위해", "때문에"]
PARTICLES = ["에", "의", "로", "으로", "와", "과", "은", "는", "을", "를", "이", "가", "에서", "부터", "까지"]


@dataclass(frozen=True)
class Repetition:
    """Thresholds of the repetition flags."""

    max_chars: int = 6000
    max_tokens: int = 500
    max_unit: int = 16
    max_span: int = 24
    char_run: int = 10
    char_excess: int = 8
    word_run: int = 8
    word_excess: int = 5
    span_tokens: int = 2
    span_run: int = 3
    span_score: int = 8
    span_excess: int = 6
    long_span_tokens: int = 6
    long_span_run: int = 2
    long_span_score: int = 14
    long_span_excess: int = 8
    ngram_low: int = 3
    ngram_high: int = 12
    ngram_count: int = 4
    ngram_coverage: float = 0.18
    ngram_excess: int = 8
    short_low: int = 2
    short_high: int = 2
    short_cheap: int = 8
    short_count: int = 8
    short_coverage: float = 0.04
    short_excess: int = 10
    token_count: int = 30
    token_ratio: float = 0.06
    token_excess: int = 20
    function_count: int = 15
    function_ratio: float = 0.10
    clause_chars: int = 10
    clause_count: int = 3
    clause_ratio: float = 0.30
    clause_excess: int = 2
    short_clause_count: int = 2
    short_clause_ratio: float = 0.80
    short_clause_excess: int = 1
    short_text: int = 1000


@dataclass(frozen=True)
class Thresholds:
    """Which checks run, and their thresholds. The defaults are those of the production configuration; see plain()."""

    checks: frozenset = frozenset("encoding_replchar thinking_trace prompt_artifact repetition english_passthrough wrong_script_heavy wrong_script_light truncation length_explosion low_hangul_other".split())
    wrong_script_count: int = 3
    mixed_script_words: int = 999_999
    dangling_chars: int = 30
    particle_chars: int = 80
    repetition: Repetition = field(default_factory=Repetition)


def plain() -> Thresholds:
    """The thresholds that hold where no configuration is given."""
    base = Thresholds()
    return replace(base, checks=base.checks | {"foreign_passthrough"}, wrong_script_count=1, mixed_script_words=1, repetition=replace(base.repetition, max_chars=12_000, max_tokens=1_200, char_run=16))


FULL_FEATURES = ("char", "word", "token", "function", "clause", "span", "ngram", "short")


def cheap_features(text: Column, tokens: Column, r: Repetition) -> dict[str, Column]:
    """Features that need no scan over spans or n-grams."""
    return {
        "char": F.col("_char"),
        "word": T.longest_run(tokens), "token": T.most_equal(tokens), "function": T.most_equal(T.function_words(tokens)),
        "clause": T.clause_duplication(text, r.clause_chars), "size": F.size(tokens).cast("bigint"),
    }


def classify(df: DataFrame, source: str, output: str, status: str, finish: str, t: Thresholds | None = None) -> DataFrame:
    """df with degeneration_label (the first flag, or ``clean``) and degeneration_flags (in order of evaluation, a family before its
    members). A null status is no success; a null output is empty; a null source is an empty text."""
    t = t or Thresholds()
    r, on = t.repetition, t.checks
    own = [c for c in df.columns]
    x = df.withColumns({"_t": F.coalesce(T.strip(output), F.lit("")), "_s": F.coalesce(F.col(source), F.lit(""))})
    if "repetition" in on:
        x = x.withColumns({"_char": unit_runs(F.col("_t"), r.max_unit, r.max_chars), "_schar": unit_runs(F.col("_s"), r.max_unit, r.max_chars)})
    x = x.withColumns({"_n": F.length("_t"), "_m": F.length("_s"), "_tokens": T.bounded(T.words(F.col("_t")), r.max_tokens), **{f"_{k}": v for k, v in T.script_counts(F.col("_t")).items()}})
    share = lambda *names: T.ratio(sum((F.col(f"_{k}") for k in names[1:]), F.col(f"_{names[0]}")), F.col("_n"))
    x = x.withColumns({"_rh": share("hangul"), "_rl": share("latin"), "_rx": share("latin", "latin_ext"), "_wrong": F.col("_cjk") + F.col("_kana") + F.col("_other")})
    if "repetition" in on:
        # columns of their own: the fields of a struct would be worked out again at each use
        x = x.withColumns({f"_c_{k}": v for k, v in cheap_features(F.col("_t"), F.col("_tokens"), r).items()})
        c = lambda k: F.col(f"_c_{k}")
        doubled = (c("clause.count") >= r.clause_count) & (c("clause.ratio") >= r.clause_ratio)
        short = (c("clause.count") >= r.short_clause_count) & (c("clause.ratio") >= r.short_clause_ratio) & (F.col("_n") <= r.short_text)
        gate = (c("char") >= r.char_run) | (c("word") >= r.word_run) | (c("token") >= min(r.token_count, r.short_cheap, r.ngram_count)) | (c("function") >= r.function_count) | doubled | short
        deep = lambda tokens: F.struct(T.span_repeat(tokens, r.max_span).alias("span"), T.ngram_repeat(tokens, r.ngram_low, r.ngram_high).alias("ngram"), T.ngram_repeat(tokens, r.short_low, r.short_high).alias("short"))
        x = x.withColumn("_deep", F.when(gate, deep(F.col("_tokens"))))
        d = lambda k: F.col(f"_deep.{k}")
        token_share, function_share = T.ratio(c("token"), c("size")), T.ratio(c("function"), c("size"))
        suspect = d("span").isNotNull() & (
            (c("char") >= r.char_run) | (c("word") >= r.word_run) | (d("span.run") >= r.span_run) & (d("span.score") >= r.span_score) | doubled | short
            | (d("ngram.count") >= r.ngram_count) & (d("ngram.coverage") >= r.ngram_coverage) | (c("token") >= r.token_count) & (token_share >= r.token_ratio)
            | (c("function") >= r.function_count) & (function_share >= r.function_ratio) | (d("short.count") >= r.short_count) & (d("short.coverage") >= r.short_coverage))
        x = x.withColumn("_stokens", F.when(suspect, T.bounded(T.words(F.col("_s")), r.max_tokens)))
        st = F.col("_stokens")
        x = x.withColumn("_src", F.when(st.isNotNull(), F.struct(
            F.col("_schar").alias("char"), T.longest_run(st).alias("word"), T.most_equal(st).alias("token"),
            T.clause_duplication(F.col("_s"), r.clause_chars).alias("clause"), deep(st).alias("deep"))))
        s = lambda k: F.col(f"_src.{k}")
        repeated = lambda p: d(f"{p}.count") * d(f"{p}.n")
        source_repeated = lambda p: s(f"deep.{p}.count") * s(f"deep.{p}.n")
        members = {
            "repetition_char": (c("char") >= r.char_run) & (c("char") >= s("char") + r.char_excess),
            "repetition_word": (c("word") >= r.word_run) & (c("word") >= s("word") + r.word_excess),
            "repetition_immediate_span": (d("span.run") >= r.span_run) & (d("span.span") >= r.span_tokens) & (d("span.score") >= r.span_score) & (d("span.score") >= s("deep.span.score") + r.span_excess),
            "repetition_long_immediate_span": (d("span.run") >= r.long_span_run) & (d("span.span") >= r.long_span_tokens) & (d("span.score") >= r.long_span_score) & (d("span.score") >= s("deep.span.score") + r.long_span_excess),
            "repetition_clause_dup": doubled & (c("clause.count") >= s("clause.count") + r.clause_excess),
            "repetition_short_clause_dup": short & (c("clause.count") >= s("clause.count") + r.short_clause_excess),
            "repetition_ngram": (d("ngram.count") >= r.ngram_count) & (d("ngram.n") >= r.ngram_low) & (d("ngram.coverage") >= r.ngram_coverage) & (repeated("ngram") >= source_repeated("ngram") + r.ngram_excess),
            "repetition_short_ngram": (d("short.count") >= r.short_count) & (d("short.n") >= r.short_low) & (d("short.coverage") >= r.short_coverage) & (repeated("short") >= source_repeated("short") + r.short_excess),
            "repetition_token_frequency": (c("token") >= r.token_count) & (token_share >= r.token_ratio) & (c("token") >= s("token") + r.token_excess),
            "repetition_ko_function_token": (c("function") >= r.function_count) & (function_share >= r.function_ratio),
        }
        found = F.filter(F.array(*(F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in members.items())), lambda f: f.isNotNull())
        x = x.withColumn("_repetition", F.when(st.isNotNull(), found).otherwise(F.array().cast("array<string>")))
    text, src, n, m = F.col("_t"), F.col("_s"), F.col("_n"), F.col("_m")
    rh, rl, rx = F.col("_rh"), F.col("_rl"), F.col("_rx")
    label_there = text.rlike(LABEL) & (n >= 8) & ((rx >= 0.20) | (rh <= 0.45))
    artifacts = F.filter(F.array(F.when(text.rlike(ARTIFACT), F.lit("prompt_artifact_instruction")), F.when(label_there, F.lit("prompt_artifact_label")), F.when(text.rlike(PREAMBLE), F.lit("prompt_artifact_preamble"))), lambda f: f.isNotNull())
    overlap = T.source_overlap(src, text)
    english = (
        ((rh < 0.05) & (rl > 0.50) & (overlap >= 0.55))
        | ((n >= 6) & (m >= 20) & (rh < 0.05) & (rl > 0.50) & (F.size(T.raw_words(text)) <= 12) & (F.size(T.raw_words(src)) >= 5) & (T.output_precision(src, text) >= 0.80))
        | ((n >= 40) & (rh < 0.05) & (rx >= 0.35) & (overlap >= 0.55) & T.has_auxiliary(src) & T.has_auxiliary(text)))
    foreign = (n >= 80) & (((rh < 0.10) & (rx > 0.50)) | ((rh < 0.45) & (rx > 0.30) & (overlap >= 0.12)))
    dangling = (n >= t.dangling_chars) & ~T.ends_sentence(text) & T.source_ends_sentence(src) & (T.any_suffix(text, SUFFIXES) | (n >= t.particle_chars) & T.any_suffix(text, PARTICLES))
    truncated = F.coalesce(F.lower(finish).isin("length", "max_tokens"), F.lit(False)) | dangling | ((m >= 160) & (n < F.greatest(F.lit(12), F.floor(m * 0.12))))
    light = (n >= 30) & ((F.col("_wrong") >= t.wrong_script_count) | (T.mixed_script_words(text) >= t.mixed_script_words))
    single = lambda flag, when: F.when(when, F.array(F.lit(flag))).otherwise(F.array().cast("array<string>"))
    family = lambda flag, members: F.when(F.size(members) > 0, F.concat(F.array(F.lit(flag)), members)).otherwise(F.array().cast("array<string>"))
    steps = {
        "encoding_replchar": lambda: single("encoding_replchar", text.contains("�")),
        "thinking_trace": lambda: single("thinking_trace", text.rlike(THINKING)),
        "prompt_artifact": lambda: family("prompt_artifact", artifacts),
        "repetition": lambda: family("repetition", F.col("_repetition")),
        "foreign_passthrough": lambda: single("foreign_passthrough", foreign),
        "english_passthrough": lambda: single("english_passthrough", english),
        "wrong_script_heavy": lambda: single("wrong_script_heavy", (F.col("_wrong") >= 5) | text.rlike(r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}]{4,}")),
        "wrong_script_light": lambda: single("wrong_script_light", light),
        "truncation": lambda: single("truncation", truncated),
        "length_explosion": lambda: single("length_explosion", n > F.greatest(F.lit(1000), m * 4)),
        "low_hangul_other": lambda: single("low_hangul_other", (n >= 40) & (rh < 0.15) & (F.col("_wrong") > 0)),
    }
    flags = F.concat(*(make() for k, make in steps.items() if k in on))
    flags = (
        F.when(~F.coalesce(F.col(status) == "ok", F.lit(False)), F.array(F.lit("invalid_status")))
        .when(n == 0, F.array(F.lit("empty"))).otherwise(flags)
    )
    x = x.withColumn("degeneration_flags", flags)
    return x.select(*own, F.coalesce(F.try_element_at("degeneration_flags", F.lit(1)), F.lit("clean")).alias("degeneration_label"), "degeneration_flags")


def basic_validity(df: DataFrame, output: str, status: str) -> DataFrame:
    """Only status and emptiness are checked."""
    label = F.when(~F.coalesce(F.col(status) == "ok", F.lit(False)), F.lit("invalid_status")).when(~T.has_text(F.col(output)), F.lit("empty")).otherwise(F.lit("clean"))
    return df.withColumn("degeneration_label", label).withColumn("degeneration_flags", F.when(F.col("degeneration_label") == "clean", F.array().cast("array<string>")).otherwise(F.array("degeneration_label")))


def filtered(df: DataFrame, source: str, output: str, status: str, finish: str, mode: str = "full", t: Thresholds | None = None) -> DataFrame:
    """The filter as configured: ``full``, ``basic`` or ``off``; adds whether it was on and whether only validity was checked."""
    if mode not in ("full", "basic", "off"):
        raise ValueError(f"unknown filter mode {mode!r}")
    if mode == "full":
        out = classify(df, source, output, status, finish, t)
    elif mode == "basic":
        out = basic_validity(df, output, status)
    else:
        out = df.withColumns({"degeneration_label": F.lit("clean"), "degeneration_flags": F.array().cast("array<string>")})
    return out.withColumns({"filter_enabled": F.lit(mode == "full"), "basic_validity_only": F.lit(mode == "basic")})


def label_summary(labelled: DataFrame, by: list[str]) -> DataFrame:
    """Rows, passes, failures and share of failures by group."""
    return labelled.groupBy(*by).agg(
        F.count("*").alias("rows"), F.count_if(F.col("degeneration_label") == "clean").alias("passed"), F.count_if(F.col("degeneration_label") != "clean").alias("failed")
    ).withColumn("fail_ratio", T.ratio(F.col("failed"), F.col("rows")))
