"""Operators on small tables: ties, nulls, empty tables, properties."""

import gzip
import json
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillforge.operators import evaluate as E
from quillforge.operators import joins as J
from quillforge.operators import pool as P
from quillforge.operators import prompting as R
from quillforge.operators import providers as PR
from quillforge.operators import selection as S
from quillforge.operators import splitter as X
from quillforge.operators import records as RE
from quillforge.operators import teacher as TE
from quillforge.operators import training as TR
from quillforge.sources import files


def test_quotas():
    assert S.quotas(1000, [67.8, 448.5, 483.7]) == [68, 448, 484]
    assert S.quotas(2, [1, 1, 1]) == [1, 1, 0]
    rng = random.Random(1)
    for _ in range(200):
        w = [rng.random() for _ in range(rng.randint(1, 6))]
        total = rng.randint(0, 99)
        q = S.quotas(total, w)
        assert sum(q) == total and all(abs(a - total * b / sum(w)) < 1 for a, b in zip(q, w))
    with pytest.raises(ValueError):
        S.quotas(3, [0.0])


def test_candidate_count():
    assert S.candidate_count(1000, 4) == 4000
    assert S.candidate_count(0, 1, pool=101, ratio=0.1) == 11


def brute_select(rows, k, weights):
    by = {i: sorted((r for r in rows if r[2] == i), key=lambda r: (r[1], r[0])) for i in range(3)}
    q = S.quotas(min(k, len(rows)), weights)
    chosen = [r for i in range(3) for r in by[i][: q[i]]]
    left = sorted((r for r in rows if r not in chosen and weights[r[2]] > 0), key=lambda r: (r[1], r[0]))
    short = min(k, sum(len(by[i]) for i in range(3) if weights[i] > 0)) - len(chosen)
    return sorted(chosen + left[: max(0, short)], key=lambda r: (r[2], r[1], r[0]))


@pytest.mark.parametrize("weights", [[1.0, 1.0, 1.0], [0.0, 1.0, 3.0], [5.0, 1.0, 0.0]])
def test_stratified_top_with_ties_and_refill(spark, weights):
    rng = random.Random(5)
    rows = [(f"id{i:03d}", round(rng.random(), 1), min(2, int(rng.random() * 2.3))) for i in range(80)]
    df = spark.createDataFrame(rows, "id string, qe_score double, length_bucket_idx bigint")
    for k in (0, 7, 40, 70, 200):
        got = [(r["id"], r["qe_score"], r["length_bucket_idx"]) for r in S.stratified_top(df, k, "low", weights).orderBy("selection_rank").collect()]
        assert got == (brute_select(rows, k, weights) if k else [])
    assert S.stratified_top(df.limit(0), 5).count() == 0
    assert [r["id"] for r in S.plain_top(df, 3, "top").collect()] == [x[0] for x in sorted(rows, key=lambda r: (-r[1], r[0]))[:3]]


def test_buckets_lengths_and_positions(spark):
    df = spark.createDataFrame([("12.7", "a b"), ("nan", "a b"), (None, ""), ("-3", "x"), ("1e30", " "), (None, None)], "n string, s string")
    assert [r[0] for r in df.select(P.token_length(F.col("n"), F.col("s"))).collect()] == [12, 2, 1, 0, 1, 1]
    lens = spark.createDataFrame([(x,) for x in (0, 1, 64, 65, 256, 257, 1280, 1281)], "n int")
    assert [r[0] for r in lens.select(P.bucket_of(F.col("n"))).collect()] == [0, 0, 0, 1, 1, 2, 2, 2]
    assert [r[0] for r in lens.select(P.bucket_of(F.col("n"), ((1, 10), (100, 200)))).collect()][2] == 1  # a gap falls to the last
    with pytest.raises(ValueError):
        P.check_buckets([(5, 1)])
    pool = spark.range(500).select(F.col("id").alias("order_idx"))
    placed = P.subsets(pool, 100).collect()
    assert sorted(r["pool_position"] for r in placed) == list(range(500))
    assert P.subsets(pool.limit(0), 100).count() == 0
    exact = {r["order_idx"]: r["pool_position"] for r in P.exact_shuffle(pool).collect()}
    order = list(range(500))
    random.Random(42).shuffle(order)
    assert [exact[x] for x in order] == list(range(500))


def test_joins(spark):
    a = spark.createDataFrame([("r1", "x"), ("r2", "y"), ("r4", None)], "k string, row string")
    b = spark.createDataFrame([("r1", "x"), ("r2", "z"), ("r3", "w"), ("r4", None)], "k string, row string")
    assert {r["k"]: r["side"] for r in J.response_audit(a, b, "k", "row").collect()} == {"r1": "matched", "r2": "mismatched", "r3": "extra", "r4": "matched"}
    assert J.complete_join(a.select("k"), b.select("k"), ["k"]).count() == 3
    with pytest.raises(Exception, match="no partner"):
        J.complete_join(b.select("k"), a.select("k"), ["k"]).count()
    old = spark.createDataFrame([("m1", 0, 1.0), ("m2", 1, 2.0)], "slug string, position bigint, v double")
    new = spark.createDataFrame([("m9", 0, 9.0), ("m1", 1, None), ("m0", 2, 0.5)], "slug string, position bigint, v double")
    assert sorted(tuple(r) for r in J.upsert(old, new, "slug").collect()) == [("m0", 3, 0.5), ("m1", 0, None), ("m2", 1, 2.0), ("m9", 2, 9.0)]
    for n, total in ((3, 8), (3, 3), (5, 2), (0, 4)):
        rows = J.padded(spark.range(n).select(F.col("id").alias("i")), "i", total).orderBy("padded_idx").collect()
        expect = max(n, total) if n else 0
        assert [r["padded_idx"] for r in rows] == list(range(expect)) and all(r["i"] == r["padded_idx"] % max(1, n) for r in rows)
    keys = spark.createDataFrame([("k1", "a"), ("k1", "b"), ("k1", "b"), ("k2", "b")], "key string, side string")
    assert tuple(J.coverage(keys).first()) == (1, 0, 1, 1.0, 0.5)


def test_resume_and_acceptance(spark):
    """A run over a to e that broke off: a accepted, b failed, c rejected for good; the target is three."""
    c = spark.createDataFrame([(x, i + 1) for i, x in enumerate("abcde")], "id string, selection_rank bigint")
    log = spark.createDataFrame([("a", "ok", 1), ("b", "ok", 1), ("b", "failed", 2), ("c", "ok", 2)], "id string, status string, pos bigint")
    got = TE.resume(c, c.where("id = 'a'"), c.where("id in ('b', 'c')"), log)
    state = {r["id"]: r["state"] for r in got.collect()}
    assert state == {"a": "accepted", "b": "retry", "c": "rejected", "d": "pending", "e": "pending"}
    again = TE.resume(c, c.where("id = 'a'"), c.where("id in ('b', 'c')"), log)
    assert {r["id"]: r["state"] for r in again.collect()} == state
    todo = got.where("state in ('retry', 'pending')").select("id", F.lit(0).alias("batch_idx"), "selection_rank", F.lit(None).cast("string").alias("reject_reason"))
    taken = TE.accept_until(todo, 3 - 1, ["batch_idx", "selection_rank"])
    assert [r["id"] for r in taken.orderBy("selection_rank").collect()] == ["b", "d"]
    assert TE.accept_until(todo, 0, ["batch_idx", "selection_rank"]).count() == 0


def test_teacher_answers(spark):
    ok = json.dumps({"items": [{"id": "a", "label": "edit", "final_translation": "가"}, {"id": "b", "label": "invalid", "final_translation": "나", "errors": [{"type": "x"}]}]})
    raw = [
        (0, ["a", "b"], "ok", f"```json\n{ok}\n```"), (1, ["a", "b"], "ok", ok), (2, ["a", "b"], "ok", "{"), (3, ["a", "c"], "ok", ok), (4, ["a", "b"], "failed", ok), (5, ["a"], "ok", None), (6, ["a", "a"], "ok", ok),
    ]
    df = spark.createDataFrame(raw, "batch_idx bigint, item_ids array<string>, status string, raw_text string")
    p = TE.parsed_answers(df)
    assert [r["parse_status"] for r in p.orderBy("batch_idx").collect()] == ["ok", "ok", "not_json", "wrong_ids", "failed", "not_json", "wrong_ids"]
    first = TE.items(p).where("batch_idx = 1").orderBy("batch_pos").collect()
    assert (first[0]["final_translation"], first[1]["final_translation"], first[1]["invalid_reason_ko"], first[1]["error_count"]) == ("가", None, "사유 없음", 0)
    assert TE.items(p).count() == 13


def brute_refill(items, target, window, weights, accepts, explicit=True):
    """Item by item: the window's order, then acceptance in that order."""
    quota, queues = S.quotas(target, weights), [sorted((x for x in items if x["length_bucket_idx"] == i), key=lambda x: x["selection_rank"]) for i in range(len(weights))]
    got, out = [0] * len(weights), []
    accepted = 0
    while accepted < target:
        sent, now = [0] * len(weights), []
        while len(now) < window:
            need = [i for i, q in enumerate(queues) if q and got[i] + sent[i] < quota[i]]
            if need:
                pick = min(need, key=lambda i: ((got[i] + sent[i]) / max(quota[i], 1), i))
            else:
                rest = [i for i, q in enumerate(queues) if q and (weights[i] > 0 or not explicit)]
                if not rest:
                    break
                pick = min(rest, key=lambda i: (queues[i][0]["qe_score"] is None, queues[i][0]["qe_score"] or 0, queues[i][0]["id"], i))
            sent[pick] += 1
            now.append(queues[pick].pop(0))
        if not now:
            break
        for x in now:
            if accepted >= target:
                out.append((x["id"], "unused", None))
            elif accepts(x["id"]):
                accepted += 1
                out.append((x["id"], "accepted", accepted))
            else:
                out.append((x["id"], "rejected", None))
        for x in now:
            got[x["length_bucket_idx"]] += bool(accepts(x["id"]))
    return out


@pytest.mark.parametrize("weights, target, explicit", [([1.0, 1.0, 1.0], 20, True), ([1.0, 0.0, 3.0], 25, True), ([1.0, 0.0, 3.0], 28, False), ([1.0, 1.0, 1.0], 90, True)])
def test_refill_against_item_by_item(spark, tmp_path, weights, target, explicit):
    items = [{"id": f"x{i:02}", "selection_rank": i, "length_bucket_idx": (i * 7) % 3, "qe_score": None if i % 11 == 0 else (i * 37 % 17) / 17} for i in range(60)]
    c = spark.createDataFrame([tuple(x.values()) for x in items], "id string, selection_rank bigint, length_bucket_idx bigint, qe_score double")
    calls = []

    def answer(w):
        calls.append(1)
        return w.select("id", (F.substring("id", 2, 2).cast("int") % 3 != 1).alias("accepted"), F.lit(False).alias("failed"))

    got = TE.refill(c, target, 8, weights, answer, str(tmp_path / "r"), explicit).orderBy("window_no", "schedule_idx").collect()
    want = brute_refill(items, target, 8, weights, lambda k: int(k[1:]) % 3 != 1, explicit)
    assert [(r["id"], r["outcome"], r["accept_rank"]) for r in got] == want
    assert len(calls) == len({r["window_no"] for r in got})
    if weights[1] == 0 and explicit:
        assert not any(r["length_bucket_idx"] == 1 for r in got)


def test_refill_asks_once_and_ends_when_all_fail(spark, tmp_path):
    c = spark.createDataFrame([("a", 1, 0, 0.1), ("b", 2, 0, None)], "id string, selection_rank bigint, length_bucket_idx bigint, qe_score double")
    fail = lambda w: w.select("id", F.lit(False).alias("accepted"), F.lit(True).alias("failed"))
    with pytest.raises(RuntimeError, match="all 2 answers of window 0 failed"):
        TE.refill(c, 2, 4, [1.0], fail, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f/window-000000")).count() == 2
    assert TE.refill(c.limit(0), 2, 4, [1.0], fail, str(tmp_path / "e")).count() == 0


def test_a_broken_run_is_resumed(spark, tmp_path):
    """a was accepted, b failed, c was rejected, d was not sent: b and d are sent, c is not."""
    c = spark.createDataFrame([(k, n, 0, 0.5) for n, k in enumerate("abcd", 1)], "id string, selection_rank bigint, length_bucket_idx bigint, qe_score double")
    ids = lambda x: spark.createDataFrame([(k,) for k in x], "id string")
    log = spark.createDataFrame([("a", "ok", 1), ("b", "failed", 2), ("c", "ok", 3)], "id string, status string, pos int")
    state = {r["id"]: r["state"] for r in TE.resume(c, ids("a"), ids("bc"), log).collect()}
    assert state == {"a": "accepted", "b": "retry", "c": "rejected", "d": "pending"}
    left = c.where(F.col("id").isin([k for k, v in state.items() if v in ("retry", "pending")]))
    yes = lambda w: w.select("id", F.lit(True).alias("accepted"), F.lit(False).alias("failed"))
    got = TE.refill(left, 3, 4, [1.0], yes, str(tmp_path / "p")).orderBy("schedule_idx").collect()
    assert [r["id"] for r in got] == ["b", "d"] and {r["outcome"] for r in got} == {"accepted"}
    assert RE.resume_faults(c, ids("a"), ids("bc"), log).count() == 0
    assert {tuple(r) for r in RE.resume_faults(c, ids("aax"), ids("acz"), log).collect()} == {("a", "repeated_accepted"), ("x", "unknown_accepted"), ("a", "accepted_and_rejected"), ("z", "unknown_rejected")}
    assert RE.next_batch(spark.createDataFrame([(3,), (None,)], "batch_idx bigint"), spark.createDataFrame([(5,)], "batch_idx bigint")).first()[0] == 6
    assert RE.next_batch(spark.createDataFrame([], "batch_idx bigint"), spark.createDataFrame([], "batch_idx bigint")).first()[0] == 0


def test_checks_of_artifacts(spark):
    sent = spark.createDataFrame([("q1", "r1"), ("q2", "r2"), ("q2", "r2"), ("q3", "r3"), ("q4", "r4")], "id string, row_id string")
    got = spark.createDataFrame([("q1", "r1", "ok"), ("q2", "r2", "ok"), ("q3", "r9", "failed"), ("q5", "r5", "ok"), (" ", "r6", "ok"), ("q1", "r7", None)], "id string, row_id string, status string")
    want = {("q2", "duplicate_request"), ("q4", "missing"), ("q3", "row_mismatch"), ("q3", "not_ok"), ("q5", "extra"), (" ", "extra"), (" ", "no_id"), ("q1", "duplicate_response"), ("q1", "row_mismatch"), ("q1", "not_ok")}
    assert {tuple(r) for r in RE.response_faults(sent, got).collect()} == want
    parts = [spark.createDataFrame([(0, "a"), (2, "c")], "place int, v string"), spark.createDataFrame([(1, "b")], "place int, v string")]
    assert RE.checked_union(parts, 3, "place").count() == 3
    for bad, n in ((parts[:1], 3), ([*parts, parts[1]], 4), (parts[:1], 2)):
        with pytest.raises(ValueError, match="are due"):
            RE.checked_union(bad, n, "place")
    with pytest.raises(ValueError, match="a reference is required: 2 rows"):
        RE.require(spark.createDataFrame([("a", " "), ("b", None), ("c", "x")], "id string, ref string"), "ref", "id", "a reference")
    with pytest.raises(ValueError, match="random order only"):
        RE.raw_random(sent, 1, order="low")
    rows = spark.createDataFrame([(f"r{i}", i % 3, None if i else "given") for i in range(9)], "id string, length_bucket_idx bigint, student_translation string")
    chosen = {r["id"]: r for r in RE.raw_random(rows, 9).collect()}
    assert len(chosen) == 9 and chosen["r0"]["student_translation"] == "given" and chosen["r1"]["student_translation"] is None and chosen["r1"]["student_status"] == "skipped_raw_random"
    fit = lambda a, b: RE.compatible(J.coverage(spark.createDataFrame([*((k, "a") for k in a), *((k, "b") for k in b)], "key string, side string"))).first()["refused"]
    assert not fit("xyz", "xyz") and fit("xyzw", "xyz") and fit("xy", "xyz")



TEXTS = [
    "", " ", "One. Two! Three? Four.", "Dr. Smith paid $3.5 bn to Acme Inc. in the U.S. market. It closed at 3.14 today... Or so. \"Yes.\" He left.\n\nNew part here. See www. example.com now.",
    "회사는 밝혔다. 매출이 늘었다. 이익도 늘었다.", "word " * 400, "x" * 500, "A.B. said e.g. this. Then 12 more. (Next one.) 'Quoted.' End",
]


@pytest.mark.parametrize("budget", [1, 3, 7, 50])
def test_splitter_properties(budget):
    for t in TEXTS:
        parts = X.split_text(t, budget)
        if X.count_words(t) <= budget:
            assert parts == [t]
            continue
        assert all(0 < X.count_words(p) <= budget for p in parts)
        assert "".join("".join(parts).split()) == "".join(t.split())
    chars = X.split_text("x" * 500, 64, len)
    assert [len(c) for c in chars] == [64] * 7 + [52]
    with pytest.raises(ValueError):
        X.split_text("a", 0)


def test_sentence_boundaries():
    cut = lambda t: [u.strip() for u in X.units(t)]
    assert cut("Dr. Lee came. He left.") == ["Dr. Lee came.", "He left."]
    assert cut("It was 3.5 percent. not so. But yes!") == ["It was 3.5 percent. not so.", "But yes!"]
    assert cut("Wait... What? \"Go.\" (Now.) U.S. Steel rose.") == ["Wait... What?", "\"Go.\"", "(Now.)", "U.S. Steel rose."]
    assert cut("늘었다. 줄었다.") == ["늘었다. 줄었다."]
    assert cut("one\n\ntwo") == ["one", "two"]


def test_split_rows(spark, tmp_path):
    long = " ".join(f"Sentence {i} is here." for i in range(20))
    rows = [(0, "a", long, {"k": "v", "split_parent_id": "old"}), (1, "b", "short", None), (2, None, None, None), (3, None, long, None), (4, "a", long, {})]
    df = spark.createDataFrame(rows, "order_idx bigint, id string, source string, metadata map<string,string>")
    out = X.split_rows(df, "source", 10, "order_idx").cache()
    first = out.where("order_idx = 0").orderBy("chunk_idx").collect()
    assert len(first) == 10 and first[3]["id"] == "a__chunk_3" and first[3]["metadata"] == {"k": "v", "split_parent_id": "a", "split_parent_row_index": "0", "split_chunk_idx": "3", "split_chunk_count": "10"}
    assert [tuple(r) for r in out.where("order_idx in (1, 2)").orderBy("order_idx").select("id", "source", "chunk_count").collect()] == [("b", "short", 1), (None, None, 1)]
    assert out.where("order_idx = 3").select("id").distinct().collect()[0][0] is None
    assert tuple(X.counters(out, "order_idx").first()) == (5, 32, 3, 30)
    X.write_shards(out, str(tmp_path / "s"), "order_idx", 7, 2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 32


def test_training(spark):
    df = spark.createDataFrame([("p ", " r\n"), ("p", "r"), ("", "r"), (None, None), ("p\x00\x00", "r")], "p string, r string")
    assert [tuple(r[0]) for r in df.select(TR.joined_text(F.col("p"), F.col("r"))).collect()] == [("p r", 2), ("p\nr", 2), ("r", 0), ("", 0), ("p\nr", 2)]
    x = spark.createDataFrame([([5, 6], [7, 8])], "a array<int>, b array<int>")
    assert tuple(x.select(TR.labels(F.col("a"), F.col("b"), 2, 4)).first()[0]) == ([5, 6, 7, 8], [-100, -100, 7, 8], 2, 2)
    assert TR.accumulation(128, 4, 4) == 8 and TR.update_steps(1000, 4, 4, 8) == 8 and TR.padded_rows(1000, 4, 4, 8) == 1024
    runs = [r["subset_idx"] for r in TR.evaluated(spark.range(2, 23).select(F.col("id").alias("subset_idx")), 3, 0, 23, True).where("evaluate").collect()]
    assert runs == [3, 6, 9, 12, 15, 18, 21, 22]
    assert TR.evaluated(spark.range(3).select(F.col("id").alias("subset_idx")), 0, 0, 3, True).where("evaluate").count() == 0


def test_bleu_and_chrf(spark):
    df = spark.createDataFrame([("g", "the cat sat on the mat today", "the cat sat on the mat today"), ("g", "a b c d e", "a b c d f"), ("h", "the the the the", "the cat is on it"), ("e", "", "x")], "g string, o string, r string")
    b = {r["g"]: r for r in E.bleu_score(E.bleu_statistics(df, "o", "r"), ["g"]).collect()}
    assert (b["g"]["match_1"], b["g"]["total_1"], b["g"]["match_4"], b["g"]["total_4"]) == (11, 12, 5, 6)
    want = 100 * ((11 / 12) * (9 / 10) * (7 / 8) * (5 / 6)) ** 0.25
    assert abs(b["g"]["bleu"] - want) < 1e-9 and b["h"]["bleu"] == 0 and b["h"]["match_1"] == 1 and b["e"]["bleu"] == 0
    c = {r["g"]: r["chrf"] for r in E.chrf_score(E.chrf_statistics(df, "o", "r"), ["g"]).collect()}
    assert 70 < c["g"] < 100 and c["e"] == 0
    same = E.chrf_score(E.chrf_statistics(df.limit(1), "o", "r"), ["g"]).first()["chrf"]
    assert abs(same - 100) < 1e-9


def test_prompts(spark):
    df = spark.createDataFrame([("T {source}|{tgt_label_ko}|{x}", "a {tgt_label_ko} $1 \\ b"), ("none", "s")], "t string, s string")
    assert [r[0] for r in df.select(R.rendered(F.col("t"), F.col("s"))).collect()] == ["T a {tgt_label_ko} $1 \\ b|한국어|{x}", "none"]
    m = spark.createDataFrame([([("user", "hi"), (None, "x")],), ([],), (None,)], "m array<struct<role:string,content:string>>")
    assert [len(r[0]) for r in m.select(R.messages(F.col("m"), F.lit("p"))).collect()] == [1, 1, 1]


def test_files(spark, tmp_path):
    p = tmp_path / "in"
    p.mkdir()
    (p / "a.jsonl").write_text('{"id": "1", "n": 2}\n\n   \n{"id": "2", "extra": 1}\n')
    with gzip.open(p / "b.jsonl.gz", "wt") as f:
        f.write('{"n": 3, "id": "3"}\n')
    got = files.read_jsonl(spark, str(p), "id string, n bigint")
    assert sorted(tuple(r) for r in got.collect()) == [("1", 2), ("2", None), ("3", 3)]
    (p / "c.jsonl").write_text("not json\n")
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(p), "id string, n bigint").collect()
    lines = spark.createDataFrame([('{"id": "x"}',), ("[1]",)], "l string")
    assert lines.where("l like '{%'").select(files.strict_objects(lines, "l", "id string").alias("o")).first()["o"]["id"] == "x"
    with pytest.raises(Exception, match="not a JSON object"):
        lines.select(files.strict_objects(lines, "l", "id string")).collect()
    files.write_jsonl(got.where("id <> 'z'").limit(0).unionByName(spark.createDataFrame([("9", None)], "id string, n bigint")), str(tmp_path / "out"))
    assert "".join(x.read_text() for x in (tmp_path / "out").glob("*.json")) == '{"id":"9","n":null}\n'
    assert files.preferred(["x/b.jsonl", "x/a.parquet", "train/c.jsonl", "x/train-1.parquet", "x/readme"]) == ["x/train-1.parquet", "train/c.jsonl"]
    assert tuple(files.latest(files.numbered(spark, ["r/checkpoint-9", "r/checkpoint-10", "r/x"], r"checkpoint-(\d+)$")).first()) == ("r/checkpoint-10", 10)


def test_stream(spark, tmp_path):
    from quillforge.streaming import answers as A

    src = tmp_path / "src"
    src.mkdir()
    (src / "1.json").write_text('{"id": "a", "status": "failed", "answered_at": "2025-01-01T00:00:00", "batch_idx": 1}\n' * 2 + '{"id": "b", "status": "ok", "answered_at": "2025-01-01T00:01:00", "batch_idx": 1}\n')
    (src / "2.json").write_text('{"id": "a", "status": "ok", "answered_at": "2025-01-01T00:05:00", "batch_idx": 2}\n')
    q = A.into_table(A.once(A.answers(spark, str(src))), str(tmp_path / "t"), str(tmp_path / "c"))
    q.awaitTermination(120)
    table = spark.read.parquet(str(tmp_path / "t"))
    assert table.count() == 3
    assert {r["id"]: r["status"] for r in A.latest(table).collect()} == {"a": "ok", "b": "ok"}


class Scripted:
    """A provider that answers from a table; a batch's first answers may be broken."""

    name, model = "scripted", "s1"

    def __init__(self, broken):
        self.broken, self.seen = broken, {}

    def complete(self, system, prompt):
        n = self.seen[prompt] = self.seen.get(prompt, 0) + 1
        if n <= self.broken.get(prompt, 0):
            raise RuntimeError(f"busy {n}")
        ids = prompt.split(",")
        return {"text": json.dumps({"items": [{"id": i, "label": "keep"} for i in ids]}), "usage": {"completion_tokens": len(ids), "note": "x"}, "latency_ms": 1.5}


def no_pause(_):
    return None


def test_providers_are_called_with_retries(spark):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import the tests
    prompts = spark.createDataFrame([(0, ["a", "b"], "a,b"), (1, ["c"], "c"), (2, ["d"], "d"), (3, ["e"], "x")], "batch_idx bigint, item_ids array<string>, prompt string")
    some = [PR.Weighted(Scripted({"c": 2, "d": 9}), 1.0), PR.Weighted(Scripted({"a,b": 9}), 0.0)]
    got = {r["batch_idx"]: r for r in PR.ask(prompts, some, "translate", callers=2, pause=no_pause).collect()}
    assert [(got[i]["status"], got[i]["attempts"]) for i in range(4)] == [("ok", 1), ("ok", 3), ("failed", 3), ("failed", 3)]
    assert got[0]["usage"] == {"completion_tokens": 2} and got[2]["error"] == "busy 3" and "ids differ" in got[3]["error"] and got[1]["item_ids"] == ["c"]
    assert PR.ask(prompts.limit(0), some, "translate").count() == 0
    for bad in (lambda: PR.ask(prompts, some[1:], "x"), lambda: PR.ask(prompts, some, " ")):
        with pytest.raises(ValueError):
            bad()
    two = [PR.Weighted(Scripted({}), 1.0), PR.Weighted(Scripted({}), 3.0)]
    share = sum(PR.chosen(two, i) is two[1].provider for i in range(2000)) / 2000
    assert 0.7 < share < 0.8 and PR.chosen(two, 7) is PR.chosen(two, 7)
    pauses = []
    PR.called(Scripted({"c": 9}), "s", "c", ["c"], 7, PR.parses, pauses.append)
    assert pauses == [1.0, 2.0, 4.0, 8.0, 15.0, 15.0]


def test_functions_in_sql(spark):
    from quillforge.functions.register import register

    register(spark)
    spark.createDataFrame([(1, "One two. Three four. Five six."), (2, None), (3, "short")], "k int, t string").createOrReplaceTempView("split_me")
    rows = [tuple(r) for r in spark.sql("select k, p.chunk_idx, p.piece from split_me, lateral split_pieces(t, 4) p order by k, chunk_idx").collect()]
    assert rows == [(1, 0, "One two. Three four."), (1, 1, "Five six."), (3, 0, "short")]
    got = [tuple(r) for r in spark.sql("select k, size(text_pieces(t, 4)), unit_run(concat(t, 'ababab')) from split_me where t is not null order by k").collect()]
    assert [r[1] for r in got] == [2, 1] and all(r[2] >= 3 for r in got)
