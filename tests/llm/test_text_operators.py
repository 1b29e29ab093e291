"""Residue, truncation, language and pair defects on the given tables and on hand-made edge cases."""

import pickle
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillforge.llm import language, pairs, residue, truncation
from quillforge.sources.tables import table

SCHEMA = "request_id string, id string, translation string, order_idx bigint, lang_label string, corpus string, spoiled boolean, _rank bigint, source string, cut string"
EDGE = [
    ("e1", "1", None, 1, None, "c", None, 1, "s", "x"), ("e2", "2", "", 2, "ko", "c", None, 1, "s", "x"), ("e3", "3", " \n　", 3, "ko", None, None, 1, "s", "x"),
    ("e4", "4", "가" * 200_000, 4, "ko", "c", None, 1, "s", "x"), (None, None, "매출이 늘었습니다.", None, None, None, None, None, None, None), ("e5", "5", "��", 5, "", "c", None, 1, "s", "x"),
    ("e6", "6", "{{ amount }} 매출이 늘었습니다.", 6, "ko", "c", None, 1, "s", "x"), ("e6", "6", "{{ amount }} 매출이 늘었습니다.", 6, "ko", "c", None, 1, "s", "x"),
]


@pytest.fixture(scope="module")
def students(spark, data):
    """The given rows and the edge cases, with columns whose names the operators use inside."""
    given = table(spark, data, "student_translations").select("request_id", "id", "translation", "order_idx", "lang_label", "corpus")
    for c, t in (("spoiled", "boolean"), ("_rank", "bigint"), ("source", "string"), ("cut", "string")):
        given = given.withColumn(c, F.lit(None).cast(t))
    return given.unionByName(spark.createDataFrame(EDGE, SCHEMA)).cache()


@pytest.fixture(scope="module")
def spoiled(students):
    return {r[0] for r in residue.p2_found(students).collect()}


@pytest.fixture(scope="module")
def residue_model():
    """Fitted on whole texts of the given tables; every fifth text is held out of the fit."""
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table("/root/testdata/sf0.1/student_translations.parquet", columns=["translation"])["translation"].to_pylist() if t]
    sure = [bool(residue.trusted_spans(t, residue.SEEDS[0]) or residue.trusted_spans(t, residue.SEEDS[1])) for t in texts]
    known = [i for i in range(len(texts)) if i % 5]
    fit = [texts[i] for i in known[:4_000]] + [texts[i] for i in known[4_000:] if sure[i]]
    return residue.train(fit), [(texts[i], sure[i]) for i in range(0, len(texts), 5)]


def test_residue(students, spoiled):
    assert "e6" in spoiled and not spoiled & {"e1", "e2", "e3", "e4", "e5", None}
    assert residue.p2_found(students.limit(0)).count() == 0


def test_residue_model_on_held_out_texts(residue_model):
    """The model alone finds what is trusted in texts that it has not seen, and little beside."""
    model, held = residue_model
    got = model.found([t for t, _ in held])
    want = np.array([s for _, s in held])
    assert got[want].mean() > 0.97
    # forms that no seed names are found too, but whatever is found stays a small share
    assert (got & ~want).mean() < 0.01


@pytest.mark.parametrize("text", [
    "집합 { A, B }로 나눈 두 가지 안 가운데 이사회는 첫째를 택했다.", "가나 그룹은 ‘페이지를 찾을 수 없음’ 안내가 뜨는 오류를 2020년 3분기에 고쳤다.", "회사는 쿠키 동의 화면 개편에 3억 달러를 썼다.",
    "고객센터에는 2020년 1분기 오류 신고 12건이 접수됐다.", "마진은 7.5%에서 9%로 늘었다.", "", "가격은 $5에서 $7로 올랐다.", "I'm sorry, but I can't help with that request.",
])
def test_reports_are_no_residue(residue_model, text):
    assert not residue_model[0].found([text])[0]


@pytest.mark.parametrize("text", [
    "매출은 ${amount} 늘었다.", "%(unit)s 부문", "<%= 분기 %> 실적", "{%- segment -%} 전망", "회사는 «날짜» 실적이 늘었다고 밝혔다.", "[INSERT amount] 달러", "회사명은 __회사명__ 입니다.", "회사는 {{ company_name }} 부문을 매각했다.",
    "Lorem ipsum dolor sit amet", "503 Service Unavailable", "{\"error\": {\"code\": 500}}", "요청하신 페이지를 찾을 수 없습니다.", "Please enable JavaScript to view this content.", "asdf asdf qwer", "◆◆◆◆ ◆◆◆◆◆ ◆◆◆ ◆◆◆◆◆◆",
])
def test_residue_forms(residue_model, text):
    assert residue_model[0].found([text])[0]


def test_residue_of_a_mark_that_no_text_holds(residue_model):
    """Masks of a mark that was never seen are found by their shape."""
    assert residue_model[0].found(["◇◇◇◇ ◇◇◇◇◇ ◇◇◇ ◇◇◇◇◇◇", "회사는 예산을 승인했다.\n▣▣▣▣ ▣▣▣▣▣ ▣▣▣ ▣▣▣▣"]).all()


def test_residue_without_a_trusted_record():
    model = residue.train(["매출이 늘었습니다.", "The board approved it."])
    assert not model.found(["{{ amount }}", None, "매출이 늘었습니다."]).any()
    assert not residue.train([]).found(["{{ amount }}"]).any()


def test_residue_report(students):
    rows = residue.residue_share(students).collect()
    total = students.select("request_id", "corpus").distinct().count()
    assert sum(r["requests"] for r in rows) == total and all(0 <= r["share"] <= 1 for r in rows)


def test_truncation(students, spoiled):
    cut = {r[0] for r in truncation.p1_found(students).collect()}
    assert not cut & spoiled and not cut & {"e1", "e2", "e3"}
    assert truncation.p1_found(students.limit(0)).count() == 0
    shares = {r["corpus"]: r for r in truncation.cut_share(students).collect()}
    assert sum(r["cut_off"] for r in shares.values()) == len(cut)


def test_truncation_on_held_out_text(spark, data):
    """Accuracy on sentences cut at random places and on whole ones, of rows that the model has not seen."""
    texts = [r["target"] for r in table(spark, data.replace("sf0.001", "sf0.01"), "cycle").where("target is not null").orderBy("order_idx").collect()]
    model = truncation.train(texts[:1200])
    rng = random.Random(2)
    whole = [t for t in texts[1200:] if len(t) > 30 and t.rstrip().endswith(".")]
    broken = []
    for t in whole:
        sentence = re.split(r"(?<=[.])\s+", t)[-1]
        at = rng.randint(3, max(4, len(sentence) - 6))
        broken.append(t[: len(t) - len(sentence) + at])
    got_whole, got_broken = model.many_cut(whole + [w.rstrip(".") for w in whole]), model.many_cut(broken + [b + "…" for b in broken])
    assert got_whole.mean() < 0.02
    assert got_broken.mean() > 0.9


def test_truncation_behind_a_mark_that_closes_nothing():
    """Where a column's texts go on after an abbreviation, an end behind it is a cut; each language has a threshold of its own."""
    rng = random.Random(3)
    names, verbs = ["Kim", "Varde", "Norpano", "Lee", "Halbex", "Corhol"], ["approved the plan", "sold its unit", "named a director", "cut its outlook"]
    many = ["two", "seven", "nine", "forty", "ninety"]
    line = lambda: f"The offer by approx. {rng.choice(many)} funds was approved. {rng.choice(names)} {rng.choice(verbs)}. The board of {rng.choice(names)} {rng.choice(verbs)} at approx. {rng.choice(many)} sites. It closed."
    model = truncation.train([line() for _ in range(1500)], ["en"] * 1500)
    whole, cut = [line() for _ in range(60)], ["The offer by approx. two funds was approved. The board of Kim cut its outlook at approx."] * 3
    assert not model.many_cut(whole, ["en"] * 60).any() and model.many_cut(cut, ["en", "de", None]).all()
    assert model.threshold.shape == (2, truncation.SLOTS) and model.threshold[1, 0] == -np.inf


def test_fits_count_all_rows(spark):
    """More rows than any sample held: every unit is counted or sets the thresholds, and every text takes part in the residue fit; a delivery counts once."""
    texts = [f"매출이 {'가나다라마바사아자차'[i % 10] * 3} 늘었다. 이사회는 예산을 승인했다" + " {{ amount }}" * (i % 500 == 0) for i in range(15_000)]
    df = spark.createDataFrame([(f"r{i}", t, "ko", "c") for i, t in enumerate(texts)], "request_id string, translation string, lang_label string, corpus string").cache()
    held = {r[0] for r in df.where(F.pmod(F.xxhash64(F.lit("ends"), "request_id"), F.lit(truncation.HELD)) == truncation.HELD - 1).select("request_id").collect()}
    model = truncation.fit(df.unionByName(df.limit(200)))
    counted = [t for i, t in enumerate(texts) if f"r{i}" not in held]
    inside = model.inside[np.searchsorted(model.keys, truncation.contexts("매")[0])]
    assert inside == sum(len(re.findall("매(?=[가-힣])", t)) for t in counted) and 11_000 < len(counted) < 13_000
    every = truncation.Counts()
    every.add(counted)
    want = truncation.model_of({k: truncation.finish_counts(k, v) for k, v in every.parts()})
    assert all((getattr(model, x) == getattr(want, x)).all() for x in ("keys", "ends", "inside")) and model.prior == want.prior

    def tally(fitted):
        work = residue.Tally(residue.SEEDS, residue.TRUSTED, fitted)
        work.add(texts)
        return dict(work.parts())

    got, want = residue.fit(df), residue.rounds_of(tally, residue.ROUNDS)
    assert np.allclose(got.prior, want.prior) and np.abs(got.windows - want.windows).max() < 0.01 and np.abs(got.sentences - want.sentences).max() < 0.01


def test_last_unit_is_the_end_of_the_last_of_all_units():
    for t in ("회사는 매출이 늘었다고 밝혔습니다. 국", "가나 " * 40 + "끝", "표제\n본문이 길게 이어지다가 끝나는 자리", "", "A board approved the budget. The"):
        want = truncation.units(t)[-1] if t else ""
        assert want.endswith(truncation.last_unit(t)) and len(truncation.last_unit(t)) >= min(truncation.ORDER, len(want))


def test_noun_endings():
    assert truncation.noun_endings("상쇄했다") == ["상쇄함", "상쇄했음"]
    assert truncation.noun_endings("전합니다") == ["전함"]
    assert truncation.noun_endings("전망") == []


LABELLED = {
    "ko": "회사는 매출이 늘었다고 밝혔습니다. 이사회는 예산을 승인했습니다. 회사는 “annual report first”라는 말을 남겼다. 그는 Varde Works에서 일한다.", "en": "The company said that sales rose in the second quarter. The board approved a budget.",
    "ja": "当社は売上高が増加したと発表した。取締役会は予算を承認した。", "zh": "公司表示收入有所增长。董事会批准了预算。", "de": "Das Unternehmen meldete einen höheren Umsatz. Der Vorstand genehmigte das Budget.",
    "fr": "La société a annoncé une hausse de ses ventes. Le conseil a approuvé le budget.", "es": "La compañía comunicó que los ingresos aumentaron. El consejo aprobó el presupuesto.",
    "pt": "A empresa informou que as receitas cresceram. A diretoria aprovou o orçamento.",
}


def test_network_accuracy_held_out(spark, data):
    """Held-out accuracy on labelled sentences of a larger sample, by language."""
    rows = table(spark, data.replace("sf0.001", "sf0.1"), "student_translations").where("lang_label in ('ko', 'en', 'ja', 'zh', 'de', 'fr', 'es', 'pt')").select("lang_label", "translation").orderBy("request_id").collect()
    x, y = [], []
    for r in rows:
        k = language.LANGS.index(r["lang_label"])
        if k == 0 and len(y) - len(set(y)) > 6000:
            continue
        for s in language.sentences_of(r["translation"] or ""):
            if language.scripts(s)[k] and language.has_words(s):
                x.append(s)
                y.append(k)
    order = np.random.default_rng(1).permutation(len(x))
    cut = len(order) * 3 // 4
    net = language.train([x[i] for i in order[:cut]], [y[i] for i in order[:cut]])
    test = [i for i in order[cut:] if len(x[i]) > 20]
    got, _, _ = language.Segments(net).classify([x[i] for i in test])
    right = np.array([y[i] for i in test]) == got
    assert right.mean() > 0.93  # some labels are wrong
    for k in range(len(language.LANGS)):
        mine = np.array([y[i] for i in test]) == k
        assert right[mine].mean() > 0.6, language.LANGS[k]  # a third of the labels of a rare language may be wrong


def test_network_is_fitted_on_all_labelled_requests(spark, monkeypatch):
    """Far more requests than the start takes: every labelled one is gone over, whatever the layout of the files."""
    monkeypatch.setattr(language, "SAMPLE", 5)
    rows = [(f"{k}{i}", t.replace("1", str(i)), k) for i in range(60) for k, t in LABELLED.items()] + [("none", LABELLED["ko"], None), ("other", LABELLED["ko"], "xx")]
    df = spark.createDataFrame(rows, "request_id string, translation string, lang_label string").repartition(3)
    start, got = language.first_weights(df), language.fit(df).network
    work = language.Tuning(start)
    mine = sorted(r for r in rows if r[2])
    work.add([r[1] for r in mine], [r[2] for r in mine])
    sentences = [(s, k) for _, t, k in mine if language.label(k) for s in language.sentences_of(t)]
    assert work.held.sum() > 0 and 0 < work.seen.sum() <= sum(-(-len(s.encode()) // language.WINDOW) for s, _ in sentences)
    assert work.seen.sum() > 5 * 8 * 8  # more windows than the start has requests
    want = language.tuned(start, np.frombuffer(next(work.parts())[1]))
    assert work.adam.taken and not np.array_equal(got.dense, start.dense)
    for k in language.WEIGHTS:
        np.testing.assert_allclose(getattr(got, k), getattr(want, k), atol=1e-5)
    again = language.fit(df.repartition(7)).network
    assert got.temperature == want.temperature == again.temperature and np.array_equal(got.dense, again.dense)


def test_segments():
    net = language.train([s for v in LABELLED.values() for s in language.sentences_of(v)] * 12, [k for k, v in enumerate(LABELLED.values()) for _ in language.sentences_of(v)] * 12)
    seg = language.Segments(net)
    mixed = LABELLED["ko"] + "\n" + LABELLED["en"] + " " + LABELLED["ja"]
    got = seg.segments([None, "", "12.5% / 7,000 USD", LABELLED["ko"], mixed, "회사는 “facility management first”라는 표어를 내걸었다.", mixed])
    assert [len(x) for x in got] == [0, 0, 0, 1, 3, 1, 3]
    assert [x[0] for x in got[4]] == ["ko", "en", "ja"] and got[4] == got[6]
    assert got[5][0][0] == "ko" and all(0 < c <= 1 for _, c in got[4])


def test_labels():
    assert [language.label(x) for x in (None, "", " ko", "KO-kr", "ko_KR", "Korean", "한국어", "und", "N/A", "unknown", "pt-BR", "zho")] == [None, None, "ko", "ko", "ko", "ko", "ko", None, None, None, "pt", "zh"]


def test_language_queries(students, spoiled):
    rows = language.p5_found(students).collect()
    ids = {r["request_id"] for r in rows}
    assert not ids & spoiled and not ids & {"e1", "e2", "e3"}
    assert None in ids  # no label, Korean text
    by = {}
    for r in rows:
        by.setdefault(r["request_id"], []).append(r["segment_no"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values())
    assert language.p5_found(students.limit(0)).count() == 0


def test_every_text_with_words_has_a_language(students, spoiled):
    """Spoiled requests too: only p5_found leaves them out."""
    rows = language.language_records(students).collect()
    texts = students.select("request_id", "translation").collect()
    assert {r["request_id"] for r in rows} == {r["request_id"] for r in texts if r["translation"] and language.has_words(r["translation"]) and language.sentences_of(r["translation"])}
    assert {r["request_id"] for r in rows if r["spoiled"]} <= spoiled and any(r["spoiled"] for r in rows)


def slow_lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_lcs_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 40))] for _ in range(2))
        assert pairs.lcs(a, b) == slow_lcs(a, b)


def test_pair_rules():
    source = "The company said that sales rose 12.5% in the second quarter of 2020."
    assert pairs.is_copy(source, "the company said that SALES rose 12.5 percent in the second quarter of 2020")
    assert not pairs.is_copy(source, "Revenue declined at the other company in the third quarter of 2021.")
    assert not pairs.is_copy("7,899 KRX / 2,321%", "7,899 KRX / 2,321%") and not pairs.is_copy(None, "x") and not pairs.is_copy(source, "…")
    assert pairs.is_empty(None) and pairs.is_empty("<br/>") and pairs.is_empty("** **") and not pairs.is_empty("(0)")
    assert pairs.is_refusal("죄송하지만 이 요청은 정책상 번역해 드릴 수 없습니다. 양해 부탁드립니다.") and pairs.is_refusal("I'm sorry, but I must decline to process this text.") and pairs.is_refusal("申し訳ありませんが、ご依頼にはお応えできません。")
    plain = "매출은 12억 달러로 늘었습니다. 비용은 줄었습니다. 이사회는 예산을 승인했습니다. "
    assert pairs.is_refusal(plain + "이 내용은 제가 번역할 수 없습니다.") and pairs.is_refusal(plain * 3 + "I'm unable to comply with this, sorry.")
    assert pairs.is_refusal("회사가 지난 분기에 발표한 모든 자료와 그 부속 서류를 하나하나 살펴본 다음 " * 8 + "말씀드리자면 이 요청을 처리할 수 없습니다.")
    assert pairs.is_refusal("I can't help with that request.") and pairs.is_refusal("답변을 제공해 드릴 수 없습니다.") and not pairs.is_refusal(plain * 50)
    assert pairs.is_copy("매출 rose 12 percent", "매출 ROSE 12 percent!")
    assert not pairs.is_refusal("가나 그룹은 인수 제안을 번역해 배포해 달라는 요청을 거절했다.") and not pairs.is_refusal("대변인은 해당 질문에 답변할 수 없다고 말했다.")


def test_pair_queries(spark, data, students, spoiled):
    cycle = table(spark, data, "cycle").withColumn("translation", F.lit("clash")).withColumn("request_id", F.lit("clash"))
    rows = [tuple(r) for r in pairs.p4_found(students, cycle).collect()]
    assert len(rows) == len(set(rows)) and not {r[0] for r in rows} & spoiled
    assert {("e1", "empty"), ("e2", "empty"), ("e3", "empty"), ("e5", "empty")} <= set(rows)
    cut = {r[0] for r in truncation.p1_found(students).collect()}
    assert {r[0] for r in rows if r[1] == "truncated"} == cut
    assert pairs.p4_found(students.limit(0), cycle).count() == 0
    assert {r[1] for r in pairs.p4_found(students, cycle.limit(0)).collect()}.isdisjoint({"copy"})


def test_samples_stay_bounded_when_one_key_holds_most_rows(spark):
    from quillforge.llm.chars import hash_sample, strata_sample

    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.when(F.col("id") % 2 == 0, F.lit("ko")).otherwise(F.lit("EN ")).alias("l"))
    got = hash_sample(df, "k", 300)
    assert 100 < len(got) <= 300 and len({r["k"] for r in got}) == len(got)
    assert [r["k"] for r in hash_sample(df, "k", 300)] == [r["k"] for r in got]
    some = hash_sample(df, "k", 300, where=F.col("k").endswith("7"), pool=3000)
    assert 0 < len(some) <= 300 and all(r["k"].endswith("7") for r in some)
    by = {}
    for s, r in strata_sample(df, "k", "l", language.label, 200):
        by.setdefault(s, set()).add(r["k"])
    assert set(by) == {"ko", "en"} and all(50 < len(v) <= 200 for v in by.values())
    assert hash_sample(df.limit(0), "k", 5) == [] and strata_sample(df.limit(0), "k", "l", language.label, 5) == []


def test_what_a_cut_leaves_behind():
    cases = {
        "매출이 늘었습니다": ("매출이 늘었습니다", 0.0), "매출이 늘…": ("매출이 늘", 0.0), "매출이 [...]": ("매출이", 0.0), "매출(생략)": ("매출", 0.0), "매출이 �": ("매출이", truncation.BROKEN),
        "매출이 <br": ("매출이", truncation.BROKEN), "매출&nb": ("매출", truncation.BROKEN), "매출 &#4": ("매출", truncation.BROKEN), "그는 떠났다. ": ("그는 떠났다.", 0.0), "그는 ": ("그는", 0.0), "총액(부가세 제외)": ("총액(부가세 제외)", 0.0),
    }
    assert {k: truncation.stripped(k) for k in cases} == cases
    assert truncation.question("") is None and truncation.question("…") is None and truncation.question("12.5") is None and truncation.question("끝났다.") == ("끝났다.", 1, 0.0)


def odd_texts(n: int, letters: str) -> list[str]:
    rng = np.random.default_rng(3)
    return ["".join(rng.choice(list(letters), rng.integers(0, 30))) for _ in range(n)]


def test_units_are_those_of_a_plain_split():
    """The ends that are looked for from their mark are those that a split by lookbehinds gives."""
    plain = re.compile(r"(?<=[^\W\d][.!?])[\"'”’»)]*[ \t]+(?=[^\sa-z])|(?<=[\d]{4}[.!?])[\"'”’»)]*[ \t]+(?=\S)|(?<=[%)”’\"][.!?])[ \t]+(?=\S)|(?<=[。！？])|\s*\n+\s*| / ")
    for t in [*odd_texts(20_000, "aB가1234.!?。 \n\t/\"'”)%]  .."), "끝. / 다음. / / 끝", "。 / 。\n/ x"]:
        assert truncation.units(t) == [u.strip() for u in plain.split(t) if u.strip()], t
    for t in odd_texts(20_000, "aB가.!?。 \t/\"'”)  .."):
        parts = [" ".join(s.split()) for s in language.SENTENCE.split(t)]
        assert [x for s in language.split_sentences(t) if (x := " ".join(s.split()))] == [x for x in parts if x], t
    for t in odd_texts(20_000, "aB.… [](&<#\\u가-\n\x1f​�"):
        assert truncation.stripped(t)[0] == truncation.MARKS.sub("", t), t


def test_passages_give_what_plain_sums_give():
    texts = [*odd_texts(300, "aabBㅁ가{}%$<>[]_@: 12.=-…\n*#😀"), "x" * 200 + " y", "가" * 70 + "나" * 70]
    p = residue.Passages(texts)
    rng = np.random.default_rng(1)
    for weights, hashes, got in (
        (rng.normal(size=(len(residue.ORDERS), residue.NONE)), p.grams, p.sentence_scores),
        (rng.normal(size=(len(residue.WIDTHS), residue.NONE)), p.shapes, p.window_scores),
    ):
        per = [np.where(h == residue.NONE, 0.0, w[np.minimum(h, residue.NONE - 1)]) for w, h in zip(weights, hashes)]
        if hashes is p.grams:
            want = np.bincount(p.sentence, sum(per)) / residue.TEMPER[0]
        else:
            want = residue.moving(sum(residue.moving(x, k - 1, 0) for k, x in zip(residue.WIDTHS, per)), 1, 1) / (3 * residue.TEMPER[1])
        np.testing.assert_allclose(got(weights), want, atol=1e-5)
    # runs of one content have one hash wherever they stand, longer ones than the table of powers too
    twice = residue.Passages([*texts, *texts])
    assert np.array_equal(twice.shapes[0][: len(p.at)], p.shapes[0]) and np.array_equal(twice.shapes[0][len(p.at) :], p.shapes[0])


def test_quick_test_leaves_out_no_trusted_form(students):
    forms = ["ＬＯＲＥＭ 가 가", "Lorem Ipsum", "ĿOREM ıpsum lorem İpsum", "ERROR 404 NOT FOUND", "하 다시 로그인해 주세요", "xx xx xx", "가가 가가 가가", "{{ a }}", "%이름%", "[ 입력 ]", "__a__", "쿠키를 허용", "BLAH BLAH", "aſdf", "COOKIES ARE OFF", "주소가 삭제되었습니다", "＜html", "<HTML>", "PÁGINA NO ENCONTRADA"]
    texts = [*forms, *(r[0] for r in students.select("translation").collect() if r[0])]
    got = residue.Tally(residue.SEEDS, 1.0).with_form(texts)
    assert got == [any(residue.trusted_spans(t, x) for x in residue.SEEDS) for t in texts] and sum(got) > 5
    for t, may in zip(texts, residue.may_be_trusted(texts)):
        for kind, form in zip(may, residue.SEEDS):
            assert kind or not form.search(t), t


def test_looked_up_pairs_give_the_filters(students):
    """The network on windows of every length, against the plain sums."""
    rng = np.random.default_rng(2)
    total = language.FILTERS * len(language.WIDTHS)
    net = language.Network(rng.normal(size=(256, language.DIM)), rng.normal(size=language.filter_mask().shape) * language.filter_mask(), rng.normal(size=total),
                           rng.normal(size=(total, len(language.LANGS))), rng.normal(size=len(language.LANGS)), rng.normal(size=(2 * language.SCRIPTS, len(language.LANGS))))
    net.embed[0] = 0
    x, owner = language.windows([r[0][:n] for n, r in enumerate(students.where("length(translation) > 0").select("translation").limit(400).collect(), 1)])
    shares = rng.normal(size=(len(x), 2 * language.SCRIPTS))
    cols = net.columns(x)
    z = np.maximum((cols @ net.filters).max(1) + net.bias, 0) @ net.dense + shares @ net.shares + net.dense_bias
    want = z - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)) - z.max(1, keepdims=True)
    np.testing.assert_allclose(net.log_probabilities(x, shares), want, atol=1e-3)
    assert net.log_probabilities(x[:0], shares[:0]).shape == (0, len(language.LANGS))


def test_quick_tests_of_pairs_leave_out_none(spark, data):
    """Refusals and copies with and without what is tested first."""
    templates = [d for d in pairs.DECLINES]
    texts = [r[0] for r in table(spark, data, "student_translations").where("translation <> ''").select("translation").collect()]
    texts += [f"가나. {d[:3].upper()}{d[3:]}! 다" for d in templates] + [" ".join(d) for d in templates] + ["Ｉ ｃａｎｎｏｔ ｔｒａｎｓｌａｔｅ ｔｈｉｓ", "😀 i cannot translate this", "번역할 수 없습니다"]
    may = pairs.may_refuse(texts)
    found = [pairs.is_refusal(t) for t in texts]
    assert sum(found) > 2 * len(templates) * 0.9 and not any(f and not m for f, m in zip(found, may.tolist())) and 2 * may.sum() < len(texts)

    def plain(source, text):
        a, b = pairs.words(source), pairs.words(text)
        return bool(b) and any(c.islower() for c in source) and pairs.lcs(b, a) >= pairs.COPY * len(b)

    source = "The board approved a budget of 12 million in the second quarter for Varde Works."
    for text in (source, source + " 매출", source + " 매출이 늘었다 했다", "ＴＨＥ board approved a budget of 12 million in the second quarter", "한 the board", source.replace("budget", "예산"), "매출은 12 million", "..."):
        for s in (source, source + " 매출이 늘었다 했다", "x ㈀ﾡ"):
            assert pairs.is_copy(s, text) == plain(s, text), (s, text)


def test_residue_of_a_text_does_not_depend_on_its_neighbours(residue_model):
    model, _ = residue_model
    texts = ["매출은 3.2% 늘었다.", "Dear {{name}}, thanks.", "", "The plant in Ulsan opens in May."]
    alone = np.concatenate([model.evidence([t]) for t in texts])
    assert np.allclose(model.evidence(texts * 500), np.tile(alone, (500, 1)), atol=1e-4)


def test_percentages_need_no_search_for_slots():
    assert residue.may_be_trusted(["매출은 3.2%로 늘었다.", "%name% 님, 50%name%", "100%(추정)"]) == [(False, False), (False, True), (False, True)]


def test_tables_of_contexts_are_narrow_and_merged_at_once():
    rng = np.random.default_rng(1)
    draws = [rng.integers(0, 1 << 32, 200_000, dtype=np.uint32) for _ in range(3)]
    draws[0][:300], draws[1][:70_000] = 7, 0xFFFFFFFF
    tables = [truncation.counted(x) for x in draws]
    got = truncation.unpacked(truncation.merge_counts(*map(truncation.packed, tables)))
    keys, n = np.unique(np.concatenate(draws), return_counts=True)
    assert all(np.array_equal(*x) for x in zip(truncation.split(got), (keys, n)))
    assert len(truncation.packed(got)) < 3.1 * len(got) and truncation.unpacked(truncation.packed(got[:0])).size == 0
    back = pickle.loads(pickle.dumps(model := truncation.train(["매출이 늘었다. 이익은 줄었다. 끝."] * 300)))
    assert all(np.array_equal(getattr(back, x), getattr(model, x)) for x in ("keys", "ends", "inside", "threshold"))


def test_counts_of_contexts_are_sent_once(spark):
    texts = [f"{i}번 공장의 매출이 늘었다. 이익은 줄었다. 끝이 났다." for i in range(40)]
    model = truncation.fit(spark.createDataFrame([(str(i), t, "ko") for i, t in enumerate(texts)], "request_id string, translation string, lang_label string"))
    assert model.sent is not None and "packed" not in model.__getstate__()
    there = spark.sparkContext.parallelize([0], 1).map(lambda _: (model.keys.tobytes(), model.threshold.tobytes(), model.many_cut(texts).tolist())).collect()
    assert there == [(model.keys.tobytes(), model.threshold.tobytes(), model.many_cut(texts).tolist())]


def test_sentences_of_many_texts_are_those_of_each():
    for letters in ("aB가1234.!?。 \n\t/\"'”)%]  ..", "aB가.!? :…,12٣ \n\n  ", "ABab .<>/ 1", "a\0b. 😀\n가²_ 9", "ab.  !? \n\r\x1f 1,0."):
        texts = odd_texts(6_000, letters)
        for some in (texts, *([t] for t in texts[:500])):
            assert list(zip(*language.all_sentences(some))) == [(s, i) for i, t in enumerate(some) for s in language.each_sentence(t)]
    assert language.all_sentences([]) == ([], []) and language.all_sentences(["", "…"]) == ([], [])


def test_cases_are_those_of_all_records(students):
    case = (F.col("segments") > 1) | F.col("label").isNull() | (F.col("label") != F.col("lang"))
    want = language.language_records(students).where(~F.col("spoiled") & case).drop("confidence").collect()
    got = language.language_records(students, cases=True).drop("confidence").collect()
    assert len(got) > 20 and sorted(map(str, got)) == sorted(map(str, want))
