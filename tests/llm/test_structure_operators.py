"""Splitting, packing, leakage and subjects: brute force, round trips, edge cases."""

import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillforge.llm import leakage, packing, splitting, subjects
from quillforge.sources.tables import table


def tokens(text):
    return splitting.TOKEN.findall(text)


@pytest.mark.parametrize("limit,overlap", [(20, 4), (50, 0), (7, 6)])
def test_pieces_round_trip(limit, overlap):
    rng = random.Random(limit)
    texts = ["", " ", "one", "word " * 300, "a. b. c.\n\n" * 40, "# Head\n\nText here.\n- item one\n  - deeper\n- item two\n\n| a | b |\n| c | d |\r\n" * 20, "　한 문장.　다음 문장! " * 30, "x" * 5000]
    texts += ["".join(rng.choice(["w ", "w. ", "w; ", "\n", "\n\n", "- w ", "W "]) for _ in range(400)) for _ in range(20)]
    for t in texts:
        parts = splitting.split(t, limit, overlap)
        assert "".join(p[skip:] for p, _, _, skip in parts) == t
        if len(tokens(t)) <= limit:
            assert parts == [(t, len(tokens(t)), 0, 0)]
            continue
        assert len(parts) > 1
        for i, (p, n, shared, _) in enumerate(parts):
            assert n == len(tokens(p)) <= limit
            assert shared == (min(overlap, sum(x[1] - x[2] for x in parts[:i])) if i else 0)
            if i and shared:
                assert tokens(parts[i - 1][0])[-shared:] == tokens(p)[:shared] or shared > parts[i - 1][1]
    with pytest.raises(ValueError):
        splitting.split("a", 5, 5)


def test_pieces_cut_at_the_strongest_boundary():
    text = "\n\n".join(" ".join(f"Part {i} sentence {j} says so." for j in range(6)) for i in range(6))
    parts = splitting.split(text, 80, 4)
    assert [p[skip:].lstrip()[:17] for p, _, _, skip in parts] == [f"Part {i} sentence 0" for i in range(0, 6, 2)]


def test_split_queries(spark, data):
    c = table(spark, data, "cycle").withColumn("piece", F.lit("clash")).withColumn("pieces", F.lit(0))
    edge = spark.createDataFrame([(10_001, None, None, None), (10_002, "x", "", "c"), (10_003, "y", "w " * 3000, None), (10_003, "y", "w " * 3000, None), (10_004, None, "x" * 9000, "c")], "order_idx bigint, id string, source string, corpus string")
    both = c.unionByName(edge, allowMissingColumns=True)
    found = {r[0] for r in splitting.p3_found(both).collect()}
    want = {r["order_idx"] for r in both.select("order_idx", "source").collect() if len(tokens(r["source"] or "")) > 1280}
    assert found == want and 10_003 in found
    pool = splitting.split_pool(both).collect()
    assert len({r["order_idx"] for r in pool}) == both.select("order_idx").distinct().count()
    texts = {r["order_idx"]: r["source"] for r in both.select("order_idx", "source").collect()}
    by = {}
    for r in sorted((r for r in pool if r["order_idx"] != 10_003), key=lambda r: (r["order_idx"], r["piece_no"])):
        by[r["order_idx"]] = by.get(r["order_idx"], "") + (r["piece"] or "")[r["overlap_chars"] :]
    assert all(by[k] == (texts[k] or "") for k in by)
    assert splitting.p3_found(both.limit(0)).count() == 0 and splitting.split_pool(both.limit(0)).count() == 0


def best_fit(lengths, capacity):
    """Plain best fit decreasing, item by item."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= x]
        if fit:
            r = min(fit)
            rooms.remove(r)
            rooms.append(r - x)
        else:
            rooms.append(capacity - x)
    return len(rooms)


def test_plan_against_item_by_item_best_fit():
    rng = random.Random(6)
    for _ in range(60):
        capacity = rng.choice([10, 37, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        histogram = {x: lengths.count(x) for x in set(lengths)}
        p = packing.plan(histogram, capacity)
        assert p.used == sum(lengths) and p.sequences == best_fit(lengths, capacity)
        room = {}
        for x, n in histogram.items():
            sequence, at = p.slots(np.full(n, x), np.arange(n))
            for s, a in zip(sequence.tolist(), at.tolist()):
                room.setdefault(s, []).append((a, x))
        assert len(room) == p.sequences
        for items in room.values():
            end = 0
            for a, x in sorted(items):
                assert a == end
                end = a + x
            assert end <= capacity
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def check_packing(rows, sizes, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["piece_no"], r["first_token"], r["tokens"]))
        if r["sequence_id"] is not None:
            by_sequence.setdefault(r["sequence_id"], []).append((r["at_token"], r["tokens"]))
    assert {k: sum(x[2] for x in v) for k, v in by_doc.items()} == sizes
    for k, v in by_doc.items():
        assert len(v) == max(1, -(-sizes[k] // capacity))
        assert [x[1] for x in sorted(v)] == [i * capacity for i in range(len(v))]
    for items in by_sequence.values():
        end = 0
        for a, n in sorted(items):
            assert a == end and n > 0
            end += n
        assert end <= capacity
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return len(by_sequence)


def test_packing_queries(spark, data):
    docs = table(spark, data, "documents").select("doc_id", "text").withColumn("tokens", F.lit(-1)).withColumn("rank", F.lit(-1))
    edge = spark.createDataFrame([(90_001, None), (90_002, ""), (90_003, " \n "), (90_004, "long text here " * 4000), (90_005, "가나다 " * 300)], "doc_id bigint, text string")
    both = docs.unionByName(edge, allowMissingColumns=True)
    encode = packing.encoder().encode_ordinary
    sizes = {r["doc_id"]: len(encode(r["text"])) if r["text"] else 0 for r in both.collect()}
    rows = packing.packed(both).collect()
    n = check_packing(rows, sizes, packing.CAPACITY)
    assert n <= -(-sum(sizes.values()) // packing.CAPACITY) * 1.02 + 1
    assert {r["doc_id"] for r in rows if r["sequence_id"] is None} == {k for k, v in sizes.items() if v == 0}
    report = packing.fill_report(both).first()
    assert report["sequences"] == n and report["tokens"] == sum(sizes.values()) and report["fullest"] <= packing.CAPACITY
    filled = packing.token_rows(both).collect()
    want = {}
    for r in rows:
        if r["sequence_id"] is not None:
            want.setdefault(r["sequence_id"], []).append((r["at_token"], r["doc_id"], r["first_token"], r["tokens"]))
    texts = {r["doc_id"]: r["text"] for r in both.collect()}
    assert len(filled) == n
    for r in filled:
        ids = [x for _, d, a, k in sorted(want[r["sequence_id"]]) for x in encode(texts[d])[a : a + k]]
        assert r["token_ids"] == ids and r["items"] == len(want[r["sequence_id"]]) and len(ids) <= packing.CAPACITY
    assert packing.token_rows(both.limit(0)).count() == 0
    assert packing.packed(both.limit(0)).count() == 0 and packing.packed(edge.limit(2)).count() == 2


def test_hot_length_ranks_in_parts(spark):
    n = 4000
    items = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("text_key"), F.lit(0).cast("bigint").alias("piece_no"), F.lit(0).cast("bigint").alias("first_token"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50 + 1).cast("bigint").alias("tokens"))
    seen = {}
    for r in packing.ranked(items, n).collect():
        seen.setdefault(r["tokens"], []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in seen.values()) and len(seen[7]) > 1300


def test_plan_keeps_its_bound():
    """Every length with a count that fits no other: the ranges stay under the bound that holds for any data."""
    for capacity in (64, 300):
        p = packing.plan({x: 1_000_003 + 7919 * x for x in range(1, capacity + 1)}, capacity)
        assert len(p.length) <= 3 * capacity * (2 * capacity) ** 0.5


def test_documents_that_repeat_an_id_keep_their_texts(spark):
    rows = [(1, "one text here"), (1, "another text, longer than it"), (1, "one text here"), (None, "no id"), (None, "none either")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    encode = packing.encoder().encode_ordinary
    got = packing.token_rows(docs).collect()
    assert sum(r["items"] for r in got) == 5 and sorted(x for r in got for x in r["token_ids"]) == sorted(x for _, t in rows for x in encode(t))


ITEM = "Between July and November, 716 sealed envelopes from Varde were photographed twice, once by Norpano Works. Brimir Corporation owes Stonelea exactly 18,496.66 crowns for sealed envelopes damaged on 24 August. Clerks in Pell Quay moved 41,491 duplicate receipts and 929 leased scanners to Izel Bay."
KOREAN = "7월부터 11월 사이에 바르데의 봉인 봉투 716건이 두 번 처리됐고 그중 한 번은 노르파노 웍스가 촬영했다. 브리미르 코퍼레이션은 8월 24일에 파손된 봉인 봉투 때문에 스톤리에 정확히 18,496.66 크라운을 빚지고 있다."
AROUND = "The margin of precision tools was higher than planned. " * 20


def leaks(index, text):
    """(item, share) of one text."""
    return [(item, share) for _, item, share in index.leaks([text])]


def test_leaks():
    ix = leakage.Index([(1, ITEM), (1, KOREAN), (2, None), (2, "")])
    w = ITEM.split()
    half = " ".join(w[:26])
    assert [x[0] for x in leaks(ix, AROUND + half + " " + AROUND)] == [1]
    assert leaks(ix, AROUND + " ".join(w[: len(w) * 2 // 5]) + AROUND) == []
    noisy = half.upper().replace("SEALED", "SEA­LED").replace(",", "").replace(" WERE", "\n> WERE").replace("PHOTOGRAPHED", "PHOTO-\n> GRAPHED")
    assert [x[0] for x in leaks(ix, AROUND + noisy + AROUND)] == [1]
    changed = [x if i not in (5, 15, 30) else "changed" for i, x in enumerate(w)]
    assert [x[0] for x in leaks(ix, AROUND + " ".join(changed) + AROUND)] == [1]
    added = w[:10] + ["really"] + w[10:25] + ["quite"] + w[25:]
    assert [x[0] for x in leaks(ix, AROUND + " ".join(added) + AROUND)] == [1]
    other = [x if i % 4 else "other" for i, x in enumerate(w)]
    assert leaks(ix, AROUND + " ".join(other) + AROUND) == []
    assert [x[0] for x in leaks(ix, "앞 문장이다. " + KOREAN + " 뒤 문장이다.")] == [1]
    assert leaks(ix, None) == [] and leaks(ix, "") == [] and leaks(leakage.Index([]), ITEM) == []


@pytest.mark.parametrize("item, words", [(ITEM, ["notwithstanding", "internationally"]), (ITEM, ["sixteenth", "frequently"]), (KOREAN, ["국제적으로는", "아시다시피도"])])
def test_long_added_words_count_once(item, words):
    ix = leakage.Index([(1, item)])
    n = 23 if item == ITEM else 20
    w = item.split()[:n]
    added = w[:7] + [words[0]] + w[7:14] + [words[1]] + w[14:]
    share = n / len(item.split())
    assert leaks(ix, AROUND + " ".join(added) + " " + AROUND) == [(1, pytest.approx(share))]


def test_added_words_that_begin_as_the_word_before_ends():
    ix = leakage.Index([(1, ITEM)])
    w = ITEM.split()[:24]
    for k in range(4, 20):
        added = w[:k] + [w[k - 1].strip(".,")[-1] + "qqq"] + w[k:]
        assert leaks(ix, AROUND + " ".join(added) + " " + AROUND) == [(1, pytest.approx(24 / len(ITEM.split())))], added[k]


def test_short_added_words_count_each():
    ix = leakage.Index([(1, ITEM)])
    w = ITEM.split()
    n = -(-len(w) // 2)
    added = w[: n // 2] + ["a", "b", "c", "d", "e"] + w[n // 2 : n]
    assert leaks(ix, AROUND + " ".join(added) + " " + AROUND) == []


def test_bound_holds_for_passages_of_every_length():
    rng = random.Random(3)
    for words in (36, 37, 58):
        lens = np.array([rng.randint(2, 9) for _ in range(words)])
        bound = leakage.least_grams(lens)
        for n in range(-(-words // 2), words + 1):
            for at in range(words - n + 1):
                edits = sorted(lens[at : at + n])[::-1][: n // 10]
                assert bound <= lens[at : at + n].sum() - (leakage.Q - 1) - sum(x + leakage.Q - 1 for x in edits)
    # 18 words with one edit keep more than 20 with two
    assert leakage.least_grams(np.full(36, 2)) == 20 * 2 - 5 - 2 * 7 < 18 * 2 - 5 - 7


@pytest.mark.parametrize("length", [28, 60, 300, 1000])
@pytest.mark.parametrize("kind", ["changed", "longer", "added"])
def test_recall_under_the_allowed_edits(length, kind):
    """One word in ten replaced or added at random places of passages from half of an item to the whole."""
    rng = random.Random(length)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.choice((2, 3, 5, 7, 9))))
    rounds, hit = (8 if length == 1000 else 25), 0
    for _ in range(rounds):
        item = [word() for _ in range(length)]
        ix = leakage.Index([(1, " ".join(item))])
        n = rng.choice((-(-length // 2), length * 3 // 4, length))
        a = rng.randint(0, length - n)
        p = item[a : a + n]
        for at in sorted(rng.sample(range(1, n - 1), n // 10), reverse=True):
            new = "".join(rng.choice(letters) for _ in range(12 if kind != "changed" else len(p[at])))
            p[at : at + (kind != "added")] = [new]
        around = [word() for _ in range(400)]
        hit += leaks(ix, " ".join(around[:200] + p + around[200:])) != []
        twice = leaks(ix, " ".join(x if i % 4 else word() for i, x in enumerate(item)))
        assert twice == []
    assert hit == rounds


def test_batches_give_what_single_texts_give():
    ix = leakage.Index([(1, ITEM), (1, KOREAN), (3, "단 세 글자"), (4, "ab cd")])
    texts = [AROUND + ITEM, None, "", KOREAN * 2, "가 단 세 글자 나", AROUND, "x" + ITEM[40:] + "\0" + KOREAN, "xx ab cd yy", ITEM[: len(ITEM) // 3]]
    assert ix.leaks(texts) == [(i, item, share) for i, t in enumerate(texts) for item, share in leaks(ix, t)]
    found = {(t, i) for t, i, _ in ix.leaks(texts)}
    assert {(0, 1), (3, 1), (4, 3), (6, 1), (7, 4)} <= found and not found & {(1, 1), (2, 1), (5, 1), (8, 1)}


@functools.lru_cache(None)
def compacted(word):
    return leakage.Compact([word]).codes.tobytes()


def brute_leaks(text, item):
    """Longest run of the item's words found in the text in order and adjacent, without changes."""
    a, b = ([compacted(x) for x in t.split()] for t in (item, text))
    a, b = [x for x in a if x], [x for x in b if x]
    best = 0
    places = {}
    for j, y in enumerate(b):
        places.setdefault(y, []).append(j)
    for i in range(len(a)):
        for j in places.get(a[i], ()):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best / max(1, len(a))


def test_leak_queries_find_every_exact_passage(spark, data):
    docs = table(spark, data, "documents").withColumn("item_id", F.lit(-1)).withColumn("share", F.lit(0.0))
    items = table(spark, data, "eval_items")
    edge = spark.createDataFrame([(90_001, None), (90_002, ""), (None, ITEM), (90_003, "x" * 100_000), (90_004, AROUND * 50)], "doc_id bigint, text string")
    both = docs.unionByName(edge, allowMissingColumns=True)
    found = {tuple(r) for r in leakage.p7_found(both, items).collect()}
    sides = [(r["item_id"], t) for r in items.collect() for t in (r["source"], r["target"])]
    exact = {(r["doc_id"], i) for r in both.select("doc_id", "text").collect() if r["text"] and len(r["text"]) < 50_000 for i, t in sides if brute_leaks(r["text"], t) >= 0.5}
    assert exact <= found and len(found) <= 3 * len(exact) + 5
    assert leakage.p7_found(both.limit(0), items).count() == 0 and leakage.p7_found(both, items.limit(0)).count() == 0


def test_blocks_of_items_give_the_same(spark, data, monkeypatch):
    docs, items = table(spark, data, "documents"), table(spark, data, "eval_items")
    whole = {tuple(r) for r in leakage.p7_found(docs, items).collect()}
    monkeypatch.setattr(leakage, "BLOCK", 60_000)
    assert {tuple(r) for r in leakage.p7_found(docs, items).collect()} == whole


def test_sentences_of_documents():
    text = "News at a glance\n\nSales rose by 3.5%. The U.S. unit grew.\n- One item here.\n- Two items,\ngoing on here.\n\nThis document is provided for information only and is not an offer to buy or sell anything."
    assert subjects.sentences(text) == ["Sales rose by 3.5%.", "The U.S. unit grew.", "One item here.", "Two items, going on here."]
    assert subjects.sentences("The minutes contain the words “797. When Lower Brenn” once. Sales fell.") == ["The minutes contain the words “797. When Lower Brenn” once.", "Sales fell."]
    assert subjects.sentences(None) == [] and subjects.sentences("n/a") == [] and subjects.sentences("…") == []


def test_paragraphs_without_a_closing_mark_keep_their_sentences():
    assert subjects.sentences("Sales rose. Costs fell\nin the north. The board will meet") == ["Sales rose.", "Costs fell in the north."]
    assert subjects.sentences("He said “Sales rose. Costs fell. And then") == ["He said “Sales rose. Costs fell."]
    assert subjects.sentences("매출이 늘었다. 비용은 줄었다. 이사회는") == ["매출이 늘었다.", "비용은 줄었다."]
    assert subjects.sentences("Results of the U.S. Department\n\nMarkets at noon") == []


def test_mixtures_lower_the_objective():
    rng = np.random.default_rng(0)
    h = rng.random((4, subjects.TERMS)).astype(np.float32)
    h /= h.sum(1, keepdims=True)
    owner = np.repeat(np.arange(30), 20)
    ids, counts = rng.integers(0, subjects.TERMS, 600), rng.integers(1, 4, 600).astype(np.float32)

    def loss(inner):
        w, _ = subjects.mixtures(h, owner, ids, counts, 30, inner)
        return -(counts * np.log((h[:, ids] * w[:, owner]).sum(0))).sum()

    assert loss(12) <= loss(3) <= loss(1) + 1e-3


def test_matrix_rows_hold_the_terms_of_every_sentence():
    import pyarrow as pa

    texts = ["Sales rose. Costs fell in the north.", None, "", "매출이 늘었다. 비용은 줄었다.", "Sales rose. Sales rose."]
    ids, counts, back, sizes = (pa.array(c, pa.binary()) for c in subjects.rows_of(subjects.Vocabulary(), texts))
    owner, terms, n = subjects.entries(ids, counts)
    places, lengths = subjects.buffer(back, np.uint16)
    assert subjects.buffer(sizes, np.int32)[1].tolist() == [2, 0, 0, 2, 2] and lengths.tolist()[1:3] == [0, 0]
    assert [int(n[owner == d].sum()) for d in range(5)] == lengths.tolist()
    for d, text in enumerate(texts):
        mine = terms[owner == d]
        assert sorted(set(mine.tolist())) == mine.tolist()
        flat, _ = subjects.Vocabulary().terms(subjects.sentences(text))
        a = int(lengths[:d].sum())
        assert mine[places[a : a + lengths[d]]].tolist() == flat.tolist()
    part = pa.RecordBatch.from_arrays([ids], ["ids"]).slice(3, 2).column(0)
    assert subjects.buffer(part, np.uint16)[0].tolist() == terms[owner >= 3].tolist()


def test_subject_queries(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    docs = table(spark, folder, "documents").withColumn("terms", F.lit("clash")).withColumn("counts", F.lit(0))
    labels, names = table(spark, folder, "subject_labels"), table(spark, folder, "subjects")
    edge = spark.createDataFrame([(90_001, None), (90_002, ""), (90_003, "n/a"), (90_004, "…" * 50_000)], "doc_id bigint, text string")
    both = docs.unionByName(edge, allowMissingColumns=True)
    found = {tuple(r) for r in subjects.p8_found(both, labels, names).collect()}
    assert not {d for d, _ in found} & {90_001, 90_002, 90_003, 90_004}
    given = {(r["doc_id"], r["subject_id"]) for r in labels.where("subject_id is not null").collect()}
    assert len(given & found) > 0.75 * len(given)
    assert subjects.p8_found(both.limit(0), labels, names).count() == 0
    assert subjects.p8_found(both, labels, names.limit(0)).count() == 0
    assert subjects.p8_found(docs.limit(50), labels.limit(0), names).count() >= 0
