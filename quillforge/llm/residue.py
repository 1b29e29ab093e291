"""Template residue, filler and messages of pages and services (problem 2).

Method: positive-unlabelled naive Bayes by expectation-maximization, on passages of two kinds. Sentences (a message or filler fills one)
are bags of hashed character n-grams; windows over the collapsed shape of the text (an unfilled slot stands inside a real sentence) are
bags of shape n-grams and of the runs of letters in them. The positives are passages of records that hold a trusted form, the ``SEEDS``; all
others are unlabelled and get a posterior that each round re-estimates. A record is spoiled if one of its passages is: the seeds take no
part in the decision, so that forms that they lack are found by what they share with the trusted ones.

The fit takes a pass over all texts for each round; only sums of a fixed size leave a task.

Defined results: null, empty and blank texts hold no residue. Repeated texts get the same answer each time. A text of any length is scored
whole. An empty table, or one without a trusted record, gives no rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.llm.chars import STEP_CHARS, STEP_ROWS, Chars, gathered, gram_orders, grams, map_rows, steps
from quillforge.sources.tables import spread

BITS = 17
#: Character n-grams of sentences, and n-grams over the collapsed shape (a run of letters of one class or of digits counts as one), as it is
#: and with all marks of markup alike.
ORDERS, SHAPES = (3, 5), ((3, False), (4, False), (5, False), (3, True), (5, True))
WIDTHS = (1, *(k for k, _ in SHAPES))
#: Rounds of expectation-maximization, and the posterior from which an unlabelled passage counts as positive in the next, less that
#: share of the threshold.
ROUNDS, SURE, ABSORBED = 3, 0.98, 0.5
#: Divisors that temper the evidence of overlapping n-grams: of a sentence, of a window.
TEMPER = (8.0, 4.0)
#: Bounds of one n-gram's evidence: in sentences, in windows.
CLIP = ((-4.0, 5.0), (-4.0, 5.0))
#: Weight of the prior, in n-grams.
PRIOR_MASS = 100.0
#: Weight of a request with a trusted form in the fit.
TRUSTED = 11.0
#: Texts that are scored at once, so few that their arrays stay in a core's cache.
NEAR = 1_600
#: Log-odds from which a passage spoils its record: of sentences, of windows.
THRESHOLD = (1.0, 12.2)

# Public forms by which records are trusted at training time.
_NAME = r"[\w가-힣 .|:+-]{1,40}"
SLOT = "|".join(
    (
        r"\{\{\s*" + _NAME + r"\s*\}\}",
        r"\{%-?\s*" + _NAME + r"\s*-?%\}",
        r"[$#]\{\s*" + _NAME + r"\s*\}",
        r"\{(?:[A-Za-z가-힣]\w+(?:[|:!.]\w+)?|\d+(?::\w+)?)\}",
        r"%\(\s*" + _NAME + r"\s*\)[sdf]",
        r"<%=?\s*" + _NAME + r"\s*%>",
        r"<<\s*" + _NAME + r"\s*>>",
        r"«\s*\w+\s*»",
        r"(?<![\d%])%[A-Za-z가-힣]\w+%",
        r"(?<!\w)\$[A-Za-z가-힣]\w+\$",
        r"(?<![\w:]):[A-Za-z_가-힣]{2,}:(?!\w*:)",
        r"\[\[\s*" + _NAME + r"\s*\]\]",
        r"__[A-Za-z가-힣]\w*?__",
        r"@@\w+@@",
        r"\[(?:INSERT|Insert|insert|YOUR|Your|TODO|TBD)\b[^\]\n]{0,40}\]",
        r"[(\[<][^()\[\]<>\n]{0,20}(?:입력|기입|삽입)(?: 필요)?[)\]>]",
    )
)
FILLER = "|".join(
    (
        r"(?i:\blorem ipsum\b)",
        r"(?i:\b(?:asdf|qwer|qwerty|blah blah|foo bar)\b)",
        r"ㅁㄴㅇㄹ|가나다라마바사",
        r"(?i:\b(?:dummy|placeholder|sample|filler) (?:text|copy|paragraph)\b|\binsert (?:text|copy) here\b)|더미 텍스트|샘플 (?:문장|텍스트)|임시 문구|자리 채움",
        r"\b(?:TBD|TODO|FIXME)\b",
        r"(?:여기에|이곳에|아래에|아래 칸에) [가-힣]+[을를] ?(?:작성|입력|넣|붙여|적어|기입)",
    )
)
MASK = r"(?<!\S)(?P<mask>[^\s\d=.-])(?P=mask)+(?:\s(?P=mask){2,}){2,}(?!\S)"
ERROR = "|".join(
    (
        r"(?i:<(?:html|head|title|body|noscript|script)\b[^>\n]*>)",
        r"Traceback \(most recent call last\)",
        r"\b[A-Z]\w+(?:Error|Exception): ",
        r"\{\s*\"(?:error|errors|code|message|status)\"\s*:",
        r"(?i:\b[45]\d\d (?:bad request|unauthorized|forbidden|not found|request timeout|gone|too many requests|internal server error|bad gateway|service unavailable|gateway time-?out)\b)",
        r"(?i:\bsomething went wrong\b|\bsession has expired\b|\baccess denied\b|\bpage (?:was |is )?not found\b|\btry again later\b|\bunder maintenance\b|\bchecking your browser\b)",
        r"(?i:seite nicht gefunden|page introuvable|página no encontrada|página não encontrada|ページが見つかりません|页面不存在|找不到页面)",
        r"(?:페이지|문서|사이트|주소)(?:를|가|을|이)? (?:찾을 수 없습니다|삭제되었습니다|존재하지 않)",
        r"(?:접근|접속) ?권한이 없습니다|세션이 만료|로그인 시간이 초과|다시 로그인해|시스템 점검 중입니다|일시적인 오류가 발생|잠시 후 다시 시도|관리자에게 문의",
    )
)
SCRIPT = "|".join(
    (
        r"(?i:\b(?:enable|turn on|switch on|allow|requires?)\b[^.\n]{0,24}\b(?:javascript|cookies?|scripts)\b)",
        r"(?i:\b(?:javascript|cookies?|scripts?|scripting) (?:is|are) (?:off|disabled|required|blocked)\b)",
        r"(?:자바스크립트|JavaScript|쿠키)(?:가|를|을|이|와)? ?(?:지원되지|꺼져|차단|켜|허용|활성화|필요)",
    )
)
#: The seeds by the kind of passage that they make positive: sentences, windows.
SEEDS = tuple(
    re.compile("|".join([MASK, *(f"(?=[{first}])(?:{forms})" for first, forms in kinds)]))
    # the characters that a form may begin with are tested first, which most places fail; without case, ı, İ and ſ equal i and s
    for kinds in (
        (("lLaAqQbBfFdDpPsSſiIıİTㅁ가더샘임자여이아", FILLER), ("<{45A-Zsſaptucペ页找페문사주접세로다시일잠관", ERROR), ("eEtTsSſaArRjJcC자쿠", SCRIPT)),
        ((r"{$#%<«:\[_@(", SLOT),),
    )
)
# What a text must hold, in lower case, to hold one of the forms of SEEDS[0] but MASK; the last three are letters that equal others without case.
HELD = (
    "lorem ipsum", "asdf", "qwer", "blah blah", "foo bar", "ㅁㄴㅇㄹ", "가나다라마바사", "dummy ", "placeholder ", "sample ", "filler ", "insert ", "더미 텍스트", "샘플 ",
    "임시 문구", "자리 채움", "tbd", "todo", "fixme", "여기에 ", "이곳에 ", "아래에 ", "아래 칸에 ", "<html", "<head", "<title", "<body", "<noscript", "<script",
    "traceback (most recent call last)", "error: ", "exception: ", '"error', '"code"', '"message"', '"status"', "bad request", "unauthorized", "forbidden", "not found",
    "request timeout", " gone", "too many requests", "internal server error", "bad gateway", "service unavailable", "gateway time", "something went wrong",
    "session has expired", "access denied", "try again later", "under maintenance", "checking your browser", "seite nicht gefunden", "page introuvable",
    "página no encontrada", "página não encontrada", "ページが見つかりません", "页面不存在", "找不到页面", " 찾을 수 없습니다", " 삭제되었습니다", " 존재하지 않", "권한이 없습니다",
    "세션이 만료", "로그인 시간이 초과", "다시 로그인해", "시스템 점검 중입니다", "일시적인 오류가 발생", "잠시 후 다시 시도", "관리자에게 문의", "script", "cookie", "자바스크립트", "쿠키",
    "ı", "i̇", "ſ",
)
#: What a text must hold to hold one of the forms of SEEDS[1] but MASK and those with a word. A sign of percent after a digit, as texts are full of, begins no slot.
SLOT_HELD = re.compile(r"[{«%<$:\[_@](?:(?<=[{«])|(?<=%)\(|(?<=%)(?<![\d%]%)[A-Za-z가-힣]|(?<=<)[%<]|(?<=\$)[A-Za-z가-힣]|(?<=:)[A-Za-z_가-힣]|(?<=\[)[\[IiYT]|(?<=_)_|(?<=@)@)")


#: Of each of them three letters that are rare elsewhere, by their hash.
RARE = np.zeros(1 << 20, bool)
for _x in filter(lambda x: len(x) > 2, HELD):
    _at = max(0, len(_x.rstrip()) - 3) if _x.isascii() else 0
    RARE[grams(Chars([_x[_at : _at + 3]], 0).folded(), 3, 20)[0]] = True
#: Letters that equal others without case.
WITHOUT_CASE = np.array([0x130, 0x131, 0x17F, 0x212A], np.uint32)


def may_be_trusted(texts: list[str]) -> list[tuple[bool, bool]]:
    """For each text whether it may hold a form of SEEDS[0] and of SEEDS[1]: a quick test, which leaves out no form."""
    return [x for a in range(0, len(texts), NEAR) for x in near_trusted(texts[a : a + NEAR])]


def near_trusted(texts: list[str]) -> list[tuple[bool, bool]]:
    c = Chars(texts)
    raw, folded = c.raw, c.folded()
    some = np.zeros((2, len(texts)), bool)

    def mark(kind: int, at: np.ndarray) -> None:
        some[kind, np.searchsorted(c.starts, at, "right") - 1] = True

    mark(0, np.flatnonzero(RARE[grams(folded, 3, 20)] | np.isin(raw, WITHOUT_CASE)))
    for i in np.flatnonzero(some[0]):
        low, some[0, i] = texts[i].lower(), False
        for x in HELD:
            if x in low:
                some[0, i] = True
                break
    # a mask: a letter or mark twice, a space, and the same twice
    masks = np.flatnonzero((raw[4:] == raw[:-4]) & (raw[3:-1] == raw[:-4]) & (raw[1:-3] == raw[:-4]) & (raw[:-4] > 0x20))
    mark(0, masks)
    mark(1, masks)
    for kind, (a, b) in ((0, "쿠키"), (1, "입력"), (1, "기입"), (1, "삽입")):
        mark(kind, np.flatnonzero((raw[:-1] == ord(a)) & (raw[1:] == ord(b))))
    return [(a, b or SLOT_HELD.search(t) is not None) for a, b, t in zip(*some.tolist(), texts)]


#: A form inside quotation marks is talked about: it is not trusted.
QUOTED = re.compile(r"[‘“][^’”\n]{0,60}[’”]")

#: Powers that a character's place in its run is weighed by, up to the place LONG, and those of the inverse; for texts of any length.
LONG, PRIME = 64, 0x01000193
POWERS = INVERSE = np.zeros(0, np.uint32)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global POWERS, INVERSE
    if len(POWERS) < n:
        some = max(n, STEP_CHARS + 8 * STEP_ROWS)
        POWERS, INVERSE = (np.cumprod(np.full(some, x & 0xFFFFFFFF, np.uint32), dtype=np.uint32) for x in (PRIME, pow(PRIME, -1, 1 << 32)))
    return POWERS[:n], INVERSE[:n]



#: Marks of markup, whose shapes also count with all of them alike.
MARKS = np.zeros(256, bool)
MARKS[[ord(c) for c in "{}[]<>%$#@_|~^:*«»\\"]] = True
#: Marks that are often repeated: digits, leaders, rules.
REPEATED = np.array([0x30, *map(ord, ".-=…")], np.uint32)


#: Classes of characters by code: what ends a line, a closing mark, the full stop that needs no space.
LINE, MARK, STOP = 1, 2, 4
CLASS = np.zeros(0x10000, np.uint8)
CLASS[[0, 10, 13]], CLASS[[46, 33, 63]], CLASS[0x3002] = LINE, MARK, STOP
#: The letter class of each character, which is itself where it is no letter.
KIND = np.arange(0x10000, dtype=np.uint32)
KIND[0xAC00:], KIND[0x3040:0xA000] = 2, 3
KIND[[*range(97, 123), *range(0xC0, 0x250)]] = 4
#: The slot of places that begin no n-gram.
NONE = 1 << BITS


def starts_of_sentences(codes: np.ndarray) -> np.ndarray:
    """Whether a sentence or line begins at each position: after a line end, a closing mark and a space, or the padding."""
    begins = np.zeros(len(codes), bool)
    if len(codes) > 2:
        kind = np.take(CLASS, codes, mode="clip")
        at = np.flatnonzero(kind[:-1])
        kind = kind[at]
        begins[at[(kind & (LINE | STOP)) != 0] + 1] = True
        at = at[(kind & (MARK | STOP)) != 0]
        at = at[at < len(codes) - 2]
        begins[at[codes[at + 1] == 32] + 2] = True
    begins[:1] = True
    return begins


def runs_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions where a run of one letter class (or a single other character) begins, its shape, and the hash of its content."""
    kind = np.take(KIND, codes, mode="clip")
    # any mark or letter three times over is one class: what hides or stands for text
    again = np.flatnonzero((codes[1:] == codes[:-1]) & (codes[1:] > 0x20)) + 1
    again = again[~np.isin(codes[again], REPEATED)]
    twice = again[1:][np.diff(again) == 1]
    for k in (0, 1, 2):
        kind[twice - k] = 5
    run = (kind - np.uint32(2) <= 3) | (kind == 0x30)
    begins = np.ones(len(kind), bool)
    begins[1:] = ~run[1:] | (kind[1:] != kind[:-1])
    at = np.flatnonzero(begins)
    # a run's characters weighed by the powers of their places in it: by those of their places in all texts, taken back
    power, back = powers(len(codes))
    total = np.zeros(len(codes) + 1, np.uint32)
    np.cumsum(codes * power, dtype=np.uint32, out=total[1:])
    content = np.diff(total[np.append(at, len(codes))])
    content[1:] *= back[at[1:] - 1]
    size = np.diff(at, append=len(codes))
    for i in np.flatnonzero(size > LONG):
        content[i] = (codes[at[i] : at[i] + size[i]] * power[np.minimum(np.arange(size[i]), LONG - 1)]).sum(dtype=np.uint32)
    content ^= content >> np.uint32(15)
    content *= np.uint32(0x2C1B3C6D)
    return at, kind[at], (content ^ (content >> np.uint32(12))) >> np.uint32(32 - BITS)


def moving(x: np.ndarray, before: int, after: int) -> np.ndarray:
    """At each place the sum from ``before`` places before it to ``after`` behind it."""
    total = np.concatenate((np.zeros(before + 1), np.cumsum(x), np.full(after, x.sum())))
    return total[before + after + 1 :] - total[: len(x)]


class Passages:
    """The passages of many texts: sentences with the n-grams that begin in them, and windows over the shape."""

    def __init__(self, texts: list[str]):
        c = Chars(texts)
        codes = c.folded()
        n = len(codes)
        self.chars = c
        begins = starts_of_sentences(codes)
        self.sentence = np.cumsum(begins, dtype=np.int32) - 1  # of each position
        self.first = np.flatnonzero(begins)
        #: the n-gram that begins at each position, or NONE
        self.grams = gram_orders(codes, ORDERS, BITS)
        blank, later = np.flatnonzero(codes == 0), self.first[self.first >= max(ORDERS)]
        early = self.first[(self.first > 0) & (self.first < max(ORDERS))]
        for k, h in zip(ORDERS, self.grams):
            h[blank] = NONE
            # those that begin before a sentence and reach into it
            for back in range(1, k):
                h[later - back] = NONE
                h[np.maximum(early - back, 0)[early >= back]] = NONE
            h[max(0, n - k + 1) :] = NONE
        self.at, kind, content = runs_of(codes)
        self.inside = kind != 0
        self.shapes = [np.where(self.inside, content, np.uint32(NONE))]
        alike = np.where(MARKS[np.minimum(kind, 0xFF)], np.uint32(6), kind)
        hashes = {}
        for same, symbols in ((False, kind), (True, alike)):
            widths = [k for k, a in SHAPES if a == same]
            hashes |= {(k, same): h for k, h in zip(widths, gram_orders(symbols, widths, BITS))}
        for k, same in SHAPES:
            ok = self.inside.copy()
            # the padding stands for the text's edge
            ok[: -(k - 1)] |= self.inside[k - 1 :]
            ok[max(0, len(kind) - k + 1) :] = False
            h = hashes[k, same]
            h[~ok] = NONE
            self.shapes.append(h)

    def sentence_scores(self, weights: np.ndarray) -> np.ndarray:
        """Tempered evidence of each sentence."""
        per = sum(np.take(w, h, mode="clip") for w, h in zip(padded(weights), self.grams))
        return np.add.reduceat(per, self.first, dtype=np.float64) / TEMPER[0]

    def window_scores(self, weights: np.ndarray) -> np.ndarray:
        """Tempered evidence of each place of the shape: of all n-grams over it and the places beside it."""
        n = len(self.at)
        per: dict[int, np.ndarray] = {}
        for k, w, h in zip(WIDTHS, padded(weights), self.shapes):
            some = np.take(w, h, mode="clip")
            per[k] = per[k] + some if k in per else some
        over, reach = np.zeros(n, np.float32), np.zeros(n, np.float32)
        # of the n-grams that begin so many places before: those that reach here
        for back in range(max(WIDTHS) - 1, -1, -1):
            if back + 1 in per:
                reach += per[back + 1]
            over[back:] += reach[: n - back]
        out = over.copy()
        out[1:] += over[:-1]
        out[:-1] += over[1:]
        return out / (3 * TEMPER[1])


def padded(weights: np.ndarray) -> list[np.ndarray]:
    """The weights of each order with none for the slot NONE; those that have it stay."""
    return [w if len(w) > NONE else np.append(w.astype(np.float32), np.float32(0)) for w in weights]


@dataclass
class Residue:
    """Log-odds of each hashed feature, residue against other text, and the log-odds of a passage that has none: sentences, windows."""

    sentences: np.ndarray
    windows: np.ndarray
    prior: tuple[float, float]

    @cached_property
    def padded(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Once a task: what is sent has none of it."""
        return padded(self.sentences), padded(self.windows)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "padded"}

    def surely(self, p: Passages) -> list[np.ndarray]:
        """The posterior of each sentence and each place of the shape, 0 where it is not sure."""
        out = []
        for kind, score in enumerate((p.sentence_scores(self.padded[0]), p.window_scores(self.padded[1]))):
            score = score + self.prior[kind] - ABSORBED * THRESHOLD[kind]
            soft, at = np.zeros(len(score)), np.flatnonzero(score > 0)
            x = 1 / (1 + np.exp(-np.minimum(score[at], 30)))
            soft[at] = np.where(x >= SURE, x, 0.0)
            out.append(soft)
        return out

    def evidence(self, texts: list[str]) -> np.ndarray:
        """(texts, 2) log-odds of each text's best sentence and window, less the threshold; it is spoiled where one is positive."""
        out = np.full((len(texts), 2), -np.inf)
        for a in range(0, len(texts), NEAR):
            if any(some := texts[a : a + NEAR]):
                # with an empty text first, whose padding stands before the next, what is found in a text does not depend on its place
                out[a : a + NEAR] = self.evidence_of(Passages(["", *some]))[1:]
        return out

    def evidence_of(self, p: Passages) -> np.ndarray:
        out = np.empty((len(p.chars.lengths), 2))
        windows = p.window_scores(self.padded[1])
        windows[~p.inside] = -np.inf
        for kind, (places, score) in enumerate(((p.first, p.sentence_scores(self.padded[0])), (p.at, windows))):
            out[:, kind] = np.maximum.reduceat(score, np.searchsorted(places, p.chars.starts)) + self.prior[kind] - THRESHOLD[kind]
        out[p.chars.lengths == 0] = -np.inf
        return out

    def found(self, texts: list[str | None]) -> np.ndarray:
        """Whether each text is spoiled: whether the evidence of one of its passages reaches the threshold."""
        return self.evidence([t or "" for t in texts]).max(1, initial=-np.inf) >= 0


def trusted_spans(text: str, seeds: re.Pattern) -> list[tuple[int, int]]:
    """Where a text holds a trusted form outside quotation marks."""
    found = [m.span() for m in seeds.finditer(text)]
    if not found:
        return found
    quoted = [m.span() for m in QUOTED.finditer(text)]
    return [(a, b) for a, b in found if not any(x <= a and b <= y for x, y in quoted)]


FEATURES = len(ORDERS) + len(WIDTHS)


def weights_of(both: np.ndarray, pos: np.ndarray, clip: tuple[float, float]) -> np.ndarray:
    """The M-step: log-odds of each feature from its counts in all passages and in the positives."""
    weights = np.zeros(both.shape, np.float32)
    for i in range(len(both)):
        neg, seen = np.maximum(both[i] - pos[i], 0), max(1, int((both[i] > 0).sum()))
        # other text's distribution is the prior of the positives', so that what they never held speaks against them, however rare it is
        other = (neg + 0.05) / (neg.sum() + 0.05 * seen)
        ratio = np.log((pos[i] + PRIOR_MASS * other) / (pos[i].sum() + PRIOR_MASS)) - np.log(other)
        weights[i] = np.where(both[i] > 0, np.clip(ratio, *clip), 0.0)
    return weights


def trusted_passages(texts: list[str], p: Passages, seeds: tuple[re.Pattern, re.Pattern]) -> list[np.ndarray]:
    """Which sentences and which places of the shape hold a trusted form."""
    sure = [np.zeros(len(p.first), bool), np.zeros(len(p.at), bool)]
    for i, t in enumerate(texts):
        for a, b in trusted_spans(t, seeds[0]):
            sure[0][p.sentence[p.chars.starts[i] + a] : p.sentence[p.chars.starts[i] + b - 1] + 1] = True
        for a, b in trusted_spans(t, seeds[1]):
            # the symbols of the form itself, and those beside it
            lo, hi = np.searchsorted(p.at, (p.chars.starts[i] + a, p.chars.starts[i] + b))
            sure[1][max(0, lo) : hi] = True
    return sure


def in_positives(p: Passages, kind: int, posterior: np.ndarray) -> list[np.ndarray]:
    """How often each feature of a kind stands in the positives: an n-gram of a sentence has the sentence's posterior, one of the shape the mean of its places."""
    if not posterior.any():
        return [np.zeros(1 << BITS)] * (len(WIDTHS) if kind else len(ORDERS))
    shares = [moving(posterior, 0, k - 1) / k for k in WIDTHS] if kind else [posterior[p.sentence]] * len(ORDERS)
    return [np.bincount(h, share, NONE + 1)[:NONE] for h, share in zip(p.shapes if kind else p.grams, shares)]


class Tally:
    """What a round adds up over texts. Without a model: each feature's count in all passages and in the trusted ones, and the numbers of passages
    and of trusted ones, by kind. With one: each feature's count in the passages that the model adds to the positives."""

    def __init__(self, seeds: tuple[re.Pattern, re.Pattern], weight: float, model: Residue | None = None):
        self.seeds, self.weight, self.model = seeds, weight, model
        self.both, self.pos = (np.zeros((FEATURES, 1 << BITS)) for _ in range(2))
        self.passages, self.trusted = np.zeros(2), np.zeros(2)

    def add(self, texts: list[str | None]) -> None:
        texts = [t for t in texts if t and t.strip()]
        if self.model is None:
            form = np.array(self.with_form(texts), bool)
            for side, weight in ((~form, 1.0), (form, self.weight)):
                self.count([texts[i] for i in np.flatnonzero(side)], weight, side is form)
        elif texts:
            self.absorb(texts)

    def with_form(self, texts: list[str]) -> list[bool]:
        """Whether each text holds a trusted form."""
        if not texts:
            return []
        may = may_be_trusted(texts) if self.seeds == SEEDS else [(True, True)] * len(texts)
        return [any(m and trusted_spans(t, x) for m, x in zip(ms, self.seeds)) for ms, t in zip(may, texts)]

    def count(self, texts: list[str], weight: float, form: bool) -> None:
        if not texts:
            return
        p = Passages(texts := ["", *texts])
        for i, h in enumerate((*p.grams, *p.shapes)):
            self.both[i] += weight * np.bincount(h, minlength=NONE + 1)[:NONE]
        sure = trusted_passages(texts, p, self.seeds) if form else [np.zeros(len(p.first), bool), np.zeros(len(p.at), bool)]
        for kind in (0, 1):
            # without those of the padding before the first text, a passage each
            self.passages[kind] += weight * (len(sure[kind]) - p.chars.starts[1])
            self.trusted[kind] += weight * sure[kind].sum()
            self.grow(kind, weight, in_positives(p, kind, sure[kind].astype(np.float64)))

    def grow(self, kind: int, weight: float, counts: list[np.ndarray]) -> None:
        for i, n in enumerate(counts):
            self.pos[i + kind * len(ORDERS)] += weight * n

    def absorb(self, texts: list[str]) -> None:
        # only texts with a passage that is sure are worked on: are they trusted, and where
        some: list[str] = []
        for a in range(0, len(texts), NEAR):
            p = Passages(["", *texts[a : a + NEAR]])
            has = np.zeros(len(p.chars.starts), bool)
            for x, places in zip(self.model.surely(p), (p.first, p.at)):
                has[np.searchsorted(p.chars.starts, places[np.flatnonzero(x)], "right") - 1] = True
            some += [texts[a + i] for i in np.flatnonzero(has[1:])]
        form = self.with_form(some)
        for weight, mine in ((1.0, [t for t, f in zip(some, form) if not f]), (self.weight, [t for t, f in zip(some, form) if f])):
            if not mine:
                continue
            q = Passages(mine := ["", *mine])
            soft, sure = self.model.surely(q), trusted_passages(mine, q, self.seeds)
            for kind in (0, 1):
                self.grow(kind, weight, in_positives(q, kind, np.where(sure[kind], 0.0, soft[kind])))

    def parts(self):
        for i in range(FEATURES):
            if self.model is None:
                yield i, zlib.compress(self.both[i].tobytes(), 1)
            yield FEATURES + i, zlib.compress(self.pos[i].tobytes(), 1)
        yield 2 * FEATURES, zlib.compress(np.concatenate((self.passages, self.trusted)).tobytes(), 1)


def merge_tallies(*parts: bytes) -> bytes:
    total = np.frombuffer(zlib.decompress(parts[0])).copy()
    for x in parts[1:]:
        total += np.frombuffer(zlib.decompress(x))
    return zlib.compress(total.tobytes(), 1)


def rounds_of(tally, rounds: int) -> Residue:
    """Expectation-maximization: ``tally(model)`` adds up a round over all texts. Trusted passages stay positive, the rest get a posterior that
    each round re-estimates."""
    first = {k: np.frombuffer(zlib.decompress(v)) for k, v in tally(None).items()}
    shape = [np.zeros((len(ORDERS), 1 << BITS), np.float16), np.zeros((len(SHAPES) + 1, 1 << BITS), np.float16)]
    model = Residue(*shape, (-np.inf, -np.inf))
    if not first:
        return model
    both = np.stack([first[i] for i in range(FEATURES)])
    trusted = np.stack([first[FEATURES + i] for i in range(FEATURES)])
    total, sure = first[2 * FEATURES].reshape(2, 2)
    share = sure / np.maximum(total, 1)
    prior = tuple(float(np.log(x / (1 - x + 1e-9))) if x > 0 else -np.inf for x in share)
    absorbed = np.zeros_like(trusted)
    for r in range(rounds):
        if r:
            more = {k: np.frombuffer(zlib.decompress(v)) for k, v in tally(model).items()}
            absorbed = np.stack([more[FEATURES + i] for i in range(FEATURES)])
        n = len(ORDERS)
        weights = [weights_of(both[x], (trusted + absorbed)[x], c) if p > -np.inf else w for x, c, p, w in zip((slice(0, n), slice(n, None)), CLIP, prior, shape)]
        model = Residue(weights[0].astype(np.float16), weights[1].astype(np.float16), prior)
    return model


def train(texts: list[str], rounds: int = ROUNDS, seeds: tuple[re.Pattern, re.Pattern] = SEEDS) -> Residue:
    """Fit by EM on texts in memory, of which each weighs the same."""

    def tally(model: Residue | None) -> dict[int, bytes]:
        work = Tally(seeds, 1.0, model)
        for a, b in steps([texts], 0):
            work.add(texts[a:b])
        return dict(work.parts())

    return rounds_of(tally, rounds)


def fit(students: DataFrame) -> Residue:
    """Fit on all requests' translations, a pass over the column for each round; requests with a trusted form, which are few, weigh TRUSTED times as much."""
    rows = spread(students.select("translation"))
    return rounds_of(lambda model: gathered(rows, lambda: Tally(SEEDS, TRUSTED, model), merge_tallies, 0, 2 * FEATURES + 1), ROUNDS)


def residue_records(students: DataFrame, model: Residue | None = None) -> DataFrame:
    """request_id and whether its translation is spoiled, one row a delivery. No shuffle: one pass over two columns."""
    model = model or fit(students)

    def make():
        def work(ids, texts):
            return {"request_id": ids, "spoiled": model.found(texts)}

        return work

    return map_rows(students.select("request_id", "translation"), make, "request_id string, spoiled boolean", text=1)


def p2_found(students: DataFrame) -> DataFrame:
    """The requests whose translation is spoiled, each once."""
    return residue_records(students).where("spoiled").select("request_id").distinct()


def residue_share(students: DataFrame) -> DataFrame:
    """For each corpus, its requests, those that are spoiled and their share. A request counts once."""
    model = fit(students)

    def make():
        def work(ids, corpora, texts):
            return {"request_id": ids, "corpus": corpora, "spoiled": model.found(texts)}

        return work

    rows = map_rows(students.select("request_id", "corpus", "translation"), make, "request_id string, corpus string, spoiled boolean", text=2)
    return (
        rows.groupBy("request_id", "corpus").agg(F.max("spoiled").alias("spoiled"))
        .groupBy("corpus").agg(F.count("*").alias("requests"), F.count_if("spoiled").alias("spoiled"))
        .withColumn("share", F.col("spoiled") / F.col("requests"))
    )
