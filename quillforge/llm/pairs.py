"""Defects of prompt and response pairs (problem 4): empty, truncated, refusal, copy, wrong_language.

Method: prompt and response are aligned as word sequences. Shingle containment (the share of the response's shingles of one word, with
their counts, that the prompt holds) bounds the longest common subsequence from above, so only pairs at or above the copy share are
aligned; longer shingles would break at every changed word of a copy that keeps four fifths of them. The alignment is a bit-parallel longest
common subsequence over whole texts. Refusals are aligned in the same way with refusal templates, in every sentence: shingles of three
characters pick the stretches to align. Truncation and language come from the operators of problems 1 and 5.

Defined results: a null or blank response is ``empty`` and nothing else. A pair without a prompt row, or with a null prompt, cannot be
a copy. Repeated deliveries count once. Prompts that occur for several responses are joined by their unique position. Empty tables give
no rows. Tables with clashing column names are narrowed to the columns read before they are joined.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.llm import language, residue, truncation
from quillforge.llm.chars import Chars, grams, map_rows
from quillforge.sources.tables import spread

#: Share of the response's words that makes a copy.
COPY = 0.8
#: Share of a refusal template that has to align.
ALIGN = 0.86

# What is declined, by language.
DECLINES = (
    "번역해 드릴 수 없습니다", "옮길 수 없습니다", "처리하지 않겠습니다", "도와드리기 어렵습니다", "응답하지 못합니다", "번역을 제공할 수 없음을 알려 드립니다",
    "요청을 들어드릴 수가 없네요", "이 글을 다룰 권한이 없어요", "번역은 맡지 않습니다", "옮기는 일을 사양하겠습니다", "작업을 중단합니다",
    "번역을 진행하지 않았습니다", "결과를 드리지 못하는 점 이해해 주세요", "도움을 드릴 수 없습니다", "번역할 수 없습니다", "답변을 드릴 수 없습니다", "제공해 드릴 수 없습니다",
    "can't translate this passage", "am not able to help with that request", "this is not something i can assist with", "must decline to process this text",
    "won't be able to provide a korean version", "translating this would go against the rules i follow", "i cannot translate this", "i am unable to translate this",
    "i cannot help with that", "i can't assist with that request", "i can't provide a translation",
    "この文章は翻訳できません", "ご依頼にはお応えできません", "この内容の翻訳は控えさせていただきます", "お手伝いできません",
    "我无法翻译这段内容", "无法提供该文本的翻译", "我不能协助完成这个请求", "无法处理这个请求",
    "diesen text kann ich nicht übersetzen", "ich kann diesen text nicht übersetzen", "kann ich dabei nicht helfen",
    "je ne peux pas traduire ce texte", "je ne suis pas en mesure de traduire ce texte", "no puedo traducir este texto", "no puedo ayudar con esa solicitud",
    "não posso traduzir este texto", "não posso ajudar com esse pedido",
)

# Verbs of tasks and the ways to decline them, of which templates are made by combination.
_TASKS = {
    "ko": (("번역", "답변", "응답", "처리", "수행", "작성", "진행", "번역을 제공", "답변을 제공", "요청을 처리", "요청을 수행"), ("할 수 없습니다", "해 드릴 수 없습니다", "해 드리기 어렵습니다", "하기 어렵습니다", "할 수 없네요")),
    "en": (("translate", "help with", "assist with", "comply with", "process", "fulfill", "complete", "answer"), ("i cannot {} this", "i can't {} this", "i am unable to {} this", "i'm unable to {} this", "i am not able to {} this", "i'm not able to {} this", "i won't {} this", "i cannot {} that request", "i can't {} that request", "i am unable to {} that request")),
}

WORD = re.compile(r"\S+")
#: The rest of a word from its first Hangul syllable, and characters from which a Hangul syllable may come.
KOREAN_WORD = re.compile(r"[가-힣]\S*")
BEYOND = re.compile(r"[\u1100-\u11ff\u3130-\u318f\u3200-\u32ff\ua960-\ua97f\uac00-\ud7ff\uff00-\uffef]")
PUNCT = re.compile(r"[^\w]|_")
MARKUP = re.compile(r"<[^<>]*>|&[a-z]+;|```\w*")


def squeeze(text: str) -> str:
    """Letters and digits only, folded."""
    return PUNCT.sub("", unicodedata.normalize("NFKC", text).casefold())


TEMPLATES = sorted({squeeze(x) for x in (*DECLINES, *(a + b for a in _TASKS["ko"][0] for b in _TASKS["ko"][1]), *(b.format(a) for a in _TASKS["en"][0] for b in _TASKS["en"][1]))})
#: The templates that hold each shingle of three characters.
SHINGLES: dict[str, set[int]] = {}
for _n, _t in enumerate(TEMPLATES):
    for _i in range(len(_t) - 2):
        SHINGLES.setdefault(_t[_i : _i + 3], set()).add(_n)


#: The fewest shingles that any template keeps, and the longest stretch of letters that they stand in.
EDITS = [int((1 - ALIGN) * len(t)) for t in TEMPLATES]
LEAST = [max(1, len(t) - 2 - 3 * e) for t, e in zip(TEMPLATES, EDITS)]
SPANS = [len(t) + max(2, len(t) // 6) for t in TEMPLATES]
#: By a shingle's hash, whether a template holds it.
KNOWN = np.zeros(1 << 20, bool)
for _x in SHINGLES:
    KNOWN[grams(np.array([*map(ord, _x)], np.uint32), 3, 20)[0]] = True
#: Letters and digits of the basic plane, folded; zero for the others. ODD: those that folding makes into several, or that join others.
KEPT, ODD = np.zeros(0x10000, np.uint32), np.zeros(0x10000, bool)
for _i in range(0x10000):
    _f = squeeze(chr(_i))
    KEPT[_i] = ord(_f) if len(_f) == 1 else 0
    ODD[_i] |= len(_f) > 1 or unicodedata.combining(chr(_i)) > 0 or 0x1100 <= _i < 0x1200 or 0xFF9E <= _i <= 0xFFDC or 0xD800 <= _i < 0xE000
    _d = unicodedata.decomposition(chr(_i)).split()
    if len(_d) == 2 and _d[0][0] != "<" and int(_d[1], 16) < 0x10000:
        ODD[int(_d[1], 16)] = True


def may_refuse(texts: list[str]) -> np.ndarray:
    """Whether each text may hold a refusal: whether shingles of the templates stand as close together as a template's least number of them must. A quick
    test for many texts at once, which leaves out none."""
    c = Chars(texts)
    low = np.minimum(c.raw, 0xFFFF)
    out = np.zeros(len(texts), bool)
    # folded otherwise than letter by letter: not tested here
    out[np.searchsorted(c.starts, np.flatnonzero(ODD[low] | (c.raw >= 0x10000)), "right") - 1] = True
    kept = KEPT[low]
    stay = np.flatnonzero(kept)
    at = np.flatnonzero(KNOWN[grams(kept[stay], 3, 20)])
    owner = np.searchsorted(c.starts, stay[at], "right") - 1
    for least, span in sorted({(x, max(s for y, s in zip(LEAST, SPANS) if y == x)) for x in LEAST}):
        if len(at) >= least:
            n = len(at) - least + 1
            near = (at[least - 1 :] - at[:n] <= span) & (owner[least - 1 :] == owner[:n])
            out[owner[:n][near]] = True
    return out


def lcs(a, b) -> int:
    """Length of the longest common subsequence of two sequences, bit-parallel over a."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & where.get(y, 0)
        if u:
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def words(text: str) -> list[str]:
    return [w for m in WORD.finditer(unicodedata.normalize("NFKC", text)) if (w := PUNCT.sub("", m.group()).casefold())]


def is_empty(text: str | None) -> bool:
    return not text or not any(c.isalnum() for c in MARKUP.sub(" ", text))


def is_copy(source: str | None, text: str) -> bool:
    if not source or not any(c.islower() for c in source):
        return False
    if not BEYOND.search(source) and unicodedata.is_normalized("NFKC", text):
        # no word of the prompt has a Hangul letter: can the others be enough
        if 5 * len(KOREAN_WORD.findall(text)) > len(text.split()):
            return False
    b = words(text)
    if not b:
        return False
    a = words(source)
    have = Counter(a)
    shared = sum(min(n, have[w]) for w, n in Counter(b).items())
    return shared >= COPY * len(b) and lcs(b, a) >= COPY * len(b)


def is_refusal(text: str) -> bool:
    """Whether a template aligns with a stretch of one of the sentences. An aligned stretch misses at most a seventh of the template's
    characters, so it keeps a number of its shingles; only around these is aligned."""
    for sentence in language.split_sentences(text):
        s = squeeze(sentence)
        hits: dict[int, list[int]] = {}
        for i in range(len(s) - 2):
            for n in SHINGLES.get(s[i : i + 3], ()):
                hits.setdefault(n, []).append(i)
        for n, at in hits.items():
            t = TEMPLATES[n]
            least, span = LEAST[n], SPANS[n]
            if len(at) < least:
                continue
            for first, last in zip(at, at[least - 1 :]):
                # enough shingles within the template's length: align the stretch around them
                a, b = max(0, last + 3 - span), first + span
                if last - first <= span and lcs(t, s[a:b]) >= ALIGN * len(t) and any(lcs(t, s[x : x + span]) >= ALIGN * len(t) for x in range(a, max(a + 1, b - len(t) + 1))):
                    return True
    return False


def is_korean(sentence: str) -> bool:
    n = len(language.HANGUL.findall(sentence))
    return n > 0 and (2 * n >= len(sentence) or bool(language.scripts(sentence)[0]))


def defects(source: str | None, text: str | None, cut: bool, segments: language.Segments, refused: bool = True) -> list[str]:
    """All defects of a pair; the response is not spoiled. ``refused``: whether it may be a refusal."""
    if is_empty(text):
        return ["empty"]
    out = []
    if cut:
        out.append("truncated")
    refusal = refused and is_refusal(text)
    copy = not refusal and is_copy(source, text)
    out += ["refusal"] * refusal + ["copy"] * copy
    if not (refusal or copy) and language.has_words(text):
        # a Korean sentence is mostly the first; a text without sentences has no segments
        if not any(map(is_korean, language.each_sentence(text))):
            found = segments.segments([text])[0]
            if found and all(lang != "ko" for lang, _ in found):
                out.append("wrong_language")
    return out


def pair_defects(students: DataFrame, cycle: DataFrame) -> DataFrame:
    """request_id, corpus and defect of every pair that is not spoiled, one row a delivery and defect."""
    ends, segments, spoiled = truncation.fit(students), language.fit(students), residue.fit(students)
    left = spread(students.select("request_id", "corpus", "order_idx", "translation", "lang_label"))
    pairs = left.join(cycle.select("order_idx", "source"), "order_idx", "left").select("request_id", "corpus", "source", "translation", "lang_label")

    def make():
        def work(ids, corpora, sources, texts, labels):
            out = {"request_id": [], "corpus": [], "defect": []}
            spoilt, cut, refused = spoiled.found(texts).tolist(), ends.many_cut(texts, labels), may_refuse([t or "" for t in texts]).tolist()
            for i in range(len(ids)):
                if spoilt[i]:
                    continue
                for d in defects(sources[i], texts[i], bool(cut[i]), segments, refused[i]):
                    out["request_id"].append(ids[i])
                    out["corpus"].append(corpora[i])
                    out["defect"].append(d)
            return out

        return work

    return map_rows(pairs, make, "request_id string, corpus string, defect string", text=2, scan=False)


def p4_found(students: DataFrame, cycle: DataFrame) -> DataFrame:
    """One row for each request and defect."""
    return pair_defects(students, cycle).select("request_id", "defect").distinct()


def defect_counts(students: DataFrame, cycle: DataFrame) -> DataFrame:
    """Requests by corpus and defect. A request counts once."""
    return pair_defects(students, cycle).distinct().groupBy("corpus", "defect").agg(F.count("*").alias("requests"))
