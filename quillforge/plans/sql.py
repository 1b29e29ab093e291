"""Pieces of DuckDB SQL that several oracles share. RE2 knows only ASCII white space, so the Unicode class is spelled out."""

WS = r"\t-\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = r"[A-Za-z0-9가-힣\x{00C0}-\x{024F}]+"
LATIN = "[A-Za-z]"
LATIN_X = r"[\x{00C0}-\x{024F}]"
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"
KANA = r"[\x{3040}-\x{30FF}]"
OTHER = r"[\x{0400}-\x{04FF}\x{0600}-\x{06FF}\x{0E00}-\x{0E7F}\x{0900}-\x{097F}\x{0370}-\x{03FF}]"


def has_text(c: str) -> str:
    return f"coalesce(regexp_matches({c}, '[^{WS}]'), false)"


def strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def rstrip(c: str) -> str:
    return f"regexp_replace({c}, '[{WS}]+$', '')"


def count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))::BIGINT"


def word_count(c: str) -> str:
    return count(c, f"[^{WS}]+")


def words(c: str) -> str:
    return f"list_transform(regexp_extract_all({c}, '{WORD}'), lambda x: lower(x))"


def long_words(c: str) -> str:
    return f"list_filter({words(c)}, lambda x: length(x) >= 3)"


def bounded(c: str, most: int = 500) -> str:
    h = most // 2
    return f"(case when len({c}) > {most} then list_concat({c}[1:{h}], {c}[-{h}:]) else {c} end)"


def token_length(tokens: str, source: str) -> str:
    return f"case when {tokens} is not null then greatest(0, {tokens}) else greatest(1, coalesce({word_count(source)}, 0)) end::BIGINT"


def bucket(length: str) -> str:
    return f"case when {length} < 1 then 0 when {length} between 1 and 64 then 0 when {length} between 65 and 256 then 1 else 2 end::BIGINT"


def bucket_name(b: str) -> str:
    return f"case {b} when 0 then '1-64' when 1 then '65-256' else '257-1280' end"


#: Responses, each request once: the last delivery.
LAST_STUDENT = "(select * from student_translations qualify row_number() over (partition by request_id order by finished_at desc) = 1)"
#: Scores, each request once: the last scoring that gave a number.
LAST_SCORE = (
    "(select request_id, qe_score from qe_scores where qe_status = 'ok' and qe_score is not null and not isnan(qe_score)"
    " qualify row_number() over (partition by request_id order by scored_at desc, qe_score desc) = 1)"
)
