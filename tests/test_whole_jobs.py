"""Queries over whole rows and with all checks, on small fixtures."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillforge.operators import degeneration as D
from quillforge.operators import pool as P
from quillforge.plans import queries as core

EN = "The company reported that quarterly revenue was higher than expected by the market."
KO = "회사는 분기 매출이 시장의 예상을 웃돌았다고 보고했습니다."
# name, translation, finish_reason
RESPONSES = [("clean", KO, "stop"), ("repeated", "좋은 " * 8 + KO, "stop"), ("copy", EN, "stop"), ("odd finish", KO, "Stopped"), ("no finish", KO, None), ("cut", KO, "length")]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Six responses to six rows, each with a score."""
    d = str(tmp_path_factory.mktemp("small"))
    n = len(RESPONSES)
    spark.createDataFrame(
        [(f"r{i}", f"row{i}", i, t, "ok", f, "a" if i < 3 else "b", "2026-01-01") for i, (_, t, f) in enumerate(RESPONSES)],
        "request_id string, id string, order_idx bigint, translation string, student_status string, finish_reason string, corpus string, finished_at string",
    ).coalesce(1).write.parquet(f"{d}/student_translations.parquet")
    spark.createDataFrame([(i, f"row{i}", EN, 12) for i in range(n)], "order_idx bigint, id string, source string, source_tokens bigint").coalesce(1).write.parquet(f"{d}/cycle.parquet")
    spark.createDataFrame([(f"r{i}", i / 10, "ok", "2026-01-01") for i in range(n)], "request_id string, qe_score double, qe_status string, scored_at string").coalesce(1).write.parquet(f"{d}/qe_scores.parquet")
    return d


def test_filter_summary_counts_repetition(spark, small):
    got = {r["corpus"]: (r["rows"], r["passed"], r["failed"]) for r in core.queries()["filter_summary"](spark, small).collect()}
    assert got == {"a": (3, 1, 2), "b": (3, 2, 1)}


def test_filter_summary_counts_the_labels(spark, data):
    labels = core.queries()["degeneration_labels"](spark, data).withColumn("clean", F.col("degeneration_label") == "clean")
    corpus = spark.read.parquet(f"{data}/student_translations.parquet").select("request_id", "corpus").distinct()
    want = {tuple(r) for r in labels.join(corpus, "request_id").groupBy("corpus").agg(F.count("*"), F.count_if("clean"), F.count_if(~F.col("clean"))).collect()}
    assert {tuple(r)[:4] for r in core.queries()["filter_summary"](spark, data).collect()} == want


def golden(spark, folder, pairs):
    spark.createDataFrame([(f"g{i}", s, t, f"2026-01-{i + 1:02}") for i, (s, t) in enumerate(pairs)], "id string, source string, target string, accepted_at string").coalesce(1).write.parquet(f"{folder}/golden_pairs.parquet")
    return str(folder)


def test_training_rows_are_whole(spark, tmp_path):
    d = golden(spark, tmp_path, [("word " * 120, "말 " * 150), ("one two", "하나 둘")])
    run = lambda name: core.queries()[name](spark, d).collect()
    got = {r["id"]: r for r in run("label_mask")}
    assert (got["g0"]["prompt_tokens"], got["g0"]["response_tokens"]) == (120, 151)
    assert got["g0"]["input_ids"].split() == ["4"] * 120 + ["1"] * 150 + ["2"]
    assert got["g0"]["labels"].split() == ["-100"] * 120 + ["1"] * 150 + ["2"]
    assert got["g1"]["labels"] == "-100 -100 2 1 2"
    padded = {r["id"]: r for r in run("batch_padding")}
    assert {r["width"] for r in padded.values()} == {271}
    assert padded["g1"]["attention_mask"] == "1" * 5 + "0" * 266 and padded["g1"]["labels"].split()[5:] == ["-100"] * 266
    assert {r["id"]: (r["tokens"], r["masked"]) for r in run("mask_audit")} == {"g0": (271, 120), "g1": (5, 2)}
    assert [tuple(r) for r in run("longest_row")] == [(271, 2, 0, 0)]


@pytest.mark.parametrize("source, target, no_room", [("word " * 2908, "말", 1), ("word " * 2900, "말 " * 8, 0)])
def test_rows_over_the_limit_are_reported(spark, tmp_path, source, target, no_room):
    d = golden(spark, tmp_path, [(source, target), ("one", "하나")])
    assert [tuple(r)[1:] for r in core.queries()["longest_row"](spark, d).collect()] == [(2, 1, no_room)]
    for name in ("label_mask", "batch_padding", "mask_audit"):
        with pytest.raises(Exception, match="row g0.*exceed the sequence limit of 2908"):
            core.queries()[name](spark, d).collect()


def test_rows_of_the_limit_fit(spark, tmp_path):
    d = golden(spark, tmp_path, [("word " * 2900, "말 " * 7)])
    assert core.queries()["label_mask"](spark, d).first()["response_tokens"] == 8


def test_blocked_requests_by_label(spark, small):
    got = {r["degeneration_label"]: r["requests"] for r in core.queries()["filter_blocked"](spark, small).collect()}
    assert got == {"repetition": 1, "english_passthrough": 1, "truncation": 1}


def test_blocked_labels_are_those_of_the_selection(spark, data):
    """Brute force: the chosen ids and each one's last delivery, labelled one by one."""
    chosen = {r["id"] for r in core.queries()["select_low"](spark, data).collect()}
    st = spark.read.parquet(f"{data}/student_translations.parquet").select("request_id", "order_idx", "translation", "student_status", "finish_reason", "finished_at").collect()
    source = {r["order_idx"]: r["source"] for r in spark.read.parquet(f"{data}/cycle.parquet").collect()}
    last = {}
    for r in st:
        if r["request_id"] in chosen and (r["request_id"] not in last or r["finished_at"] > last[r["request_id"]]["finished_at"]):
            last[r["request_id"]] = r
    rows = [(k, source[r["order_idx"]], r["translation"], r["student_status"], r["finish_reason"]) for k, r in last.items()]
    labelled = D.classify(spark.createDataFrame(rows, "id string, s string, t string, status string, f string"), "s", "t", "status", "f").collect()
    want = Counter(r["degeneration_label"] for r in labelled if r["degeneration_label"] != "clean")
    assert {r["degeneration_label"]: r["requests"] for r in core.queries()["filter_blocked"](spark, data).collect()} == want


def test_shards_of_a_pool_whose_keys_have_gaps(spark, tmp_path):
    """Keys far apart, repeated, negative or missing: every row comes back once."""
    rows = [(k, f"row{i}", "x" * (i % 7)) for i, k in enumerate([*range(300), *range(10_000_000, 10_000_300), -5, 7, 7, None, None, 1 << 40])]
    spark.createDataFrame(rows, "order_idx bigint, id string, source string").repartition(3).write.parquet(f"{tmp_path}/cycle.parquet")
    got = [tuple(r) for r in core.queries()["shard_union"](spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter((k, i, len(s)) for k, i, s in rows)


def test_places_are_ranks(spark):
    values = [5, -3, None, 1 << 40, 5, 0, 10**6, -3, None, 2]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "k bigint, i int")
    want = sorted(range(len(values)), key=lambda i: (values[i] is None, values[i] or 0, i))
    for parts in (1, 2, 64):
        assert [r["i"] for r in P.places(df, "k", ["i"], parts=parts).orderBy("place").collect()] == want
    assert sorted(r["place"] for r in P.places(df, "k", ["i"]).collect()) == list(range(len(values)))
    assert P.places(df.limit(0), "k", ["i"]).count() == 0
