"""The classifier: a case and a near miss for each flag, and invariance."""

import pytest
from pyspark.sql import functions as F

from quillforge.operators import degeneration as D

EN = "The company reported that quarterly revenue was higher than expected by the market."
KO = "회사는 분기 매출이 시장의 예상을 웃돌았다고 보고했습니다."
CASES = [
    ("clean", EN, KO, "ok", "stop", "clean", ""),
    ("failed", EN, KO, "failed", "stop", "invalid_status", "invalid_status"),
    ("null status", EN, KO, None, None, "invalid_status", "invalid_status"),
    ("empty", EN, " 　\n", "ok", "stop", "empty", "empty"),
    ("null", EN, None, "ok", "stop", "empty", "empty"),
    ("replacement", EN, KO + "�", "ok", "stop", "encoding_replchar", "encoding_replchar"),
    ("thinking", EN, "<think>음</think> " + KO, "ok", "stop", "thinking_trace", "thinking_trace"),
    ("instruction", EN, "한국어로 번역해 주세요. " + KO, "ok", "stop", "prompt_artifact", "prompt_artifact,prompt_artifact_instruction"),
    ("preamble", EN, "번역: " + KO, "ok", "stop", "prompt_artifact", "prompt_artifact,prompt_artifact_preamble"),
    ("char run", EN, "하" * 10 + " " + KO, "ok", "stop", "repetition", "repetition,repetition_char"),
    ("char run, near", EN, "하" * 9 + " " + KO, "ok", "stop", "clean", ""),
    ("word run", EN, "좋은 " * 8 + KO, "ok", "stop", "repetition", "repetition,repetition_char,repetition_word,repetition_ngram"),
    ("spans", EN, "매출 증가 이익 감소 " * 3 + KO, "ok", "stop", "clean", ""),
    ("spans, gated in", EN, "매출 증가 이익 감소 " * 4 + KO, "ok", "stop", "repetition", "repetition,repetition_immediate_span"),
    ("copy", EN, EN, "ok", "stop", "english_passthrough", "english_passthrough"),
    ("wrong script", EN, KO + " 市場予想", "ok", "stop", "wrong_script_heavy", "wrong_script_heavy,wrong_script_light"),
    ("wrong script, light", EN, KO + " 市 場 予", "ok", "stop", "wrong_script_light", "wrong_script_light"),
    ("wrong script, near", EN, KO + " 市 場", "ok", "stop", "clean", ""),
    ("length", EN, KO, "ok", "LENGTH", "truncation", "truncation"),
    ("dangling", EN, "회사는 분기 매출이 시장의 예상을 크게 웃돌았다고 보고했으며", "ok", "stop", "truncation", "truncation"),
    ("dangling, short", EN, "매출이 늘었으며", "ok", "stop", "clean", ""),
    ("too short", EN * 3, "매출 증가.", "ok", "stop", "truncation", "truncation"),
    ("explosion", "Short.", " ".join(chr(0xAC00 + i * 7) + chr(0xB000 + i * 5) for i in range(400)) + ".", "ok", "stop", "length_explosion", "length_explosion"),
]


@pytest.fixture(scope="module")
def labelled(spark):
    df = spark.createDataFrame([c[:5] for c in CASES], "name string, source string, mt string, status string, finish string")
    out = D.classify(df, "source", "mt", "status", "finish")
    return {r["name"]: r for r in out.collect()}


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_case(labelled, case):
    got = labelled[case[0]]
    assert got["degeneration_label"] == case[5]
    if case[0] != "word run":
        assert ",".join(got["degeneration_flags"]) == case[6]
    else:
        assert "repetition_word" in got["degeneration_flags"]


def test_modes_empty_tables_and_partitions(spark, data):
    none = spark.createDataFrame([], "s string, m string, status string, f string, degeneration int")
    for mode in ("full", "basic", "off"):
        assert D.filtered(none, "s", "m", "status", "f", mode).count() == 0
    with pytest.raises(ValueError):
        D.filtered(none, "s", "m", "status", "f", "some")
    st = spark.read.parquet(f"{data}/student_translations.parquet").withColumn("source", F.lit(EN))
    label = lambda x: sorted(map(str, D.classify(x, "source", "translation", "student_status", "finish_reason", D.plain()).select("request_id", "degeneration_label").collect()))
    assert label(st.repartition(1)) == label(st.repartition(7))
