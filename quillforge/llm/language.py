"""Language of each text and of each segment of a mixed text (problem 5).

Method: a byte convolutional network, trained in numpy: byte embedding, filters of several widths, max pooling over the window and a
softmax. It is applied to batches of fixed-length windows of the sentences' UTF-8 bytes. The shares of the scripts in the sentence, with and
without its quoted and bracketed parts, are inputs of the last layer beside the pooled filters; no rule stands over the network. A sentence's
score is the mean log-probability of its windows, and its confidence the softmax of that at a temperature set on held-out sentences.

Defined results: null, blank and wordless texts (numbers, codes, marks) have no segment. A sentence without words joins the segment
before it. A text of any length is read whole. Labels are compared after their spelling is set aside. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.llm import residue
from quillforge.llm.chars import Chars, gathered, map_rows, parted, strata_sample

LANGS = ("ko", "en", "ja", "zh", "de", "fr", "es", "pt")
#: Spellings of language labels, lower case, without region.
SPELLINGS = {
    "ko": ("ko", "kor", "korean", "한국어", "한글", "국어", "조선말", "kr"),
    "en": ("en", "eng", "english", "영어", "英語", "英语"),
    "ja": ("ja", "jpn", "japanese", "日本語", "일본어", "jp"),
    "zh": ("zh", "zho", "chi", "chinese", "中文", "汉语", "漢語", "중국어", "cn", "mandarin"),
    "de": ("de", "deu", "ger", "german", "deutsch", "독일어"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "프랑스어"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "스페인어"),
    "pt": ("pt", "por", "portuguese", "português", "portugues", "포르투갈어"),
}
SPELT = {w: k for k, v in SPELLINGS.items() for w in v}

WINDOW = 64
DIM, WIDTHS, FILTERS = 8, (2, 3, 4), 16
#: Labelled requests of each language from which the network's weights start, before all requests train it, and windows of each language. English, the language of the
#: prompts, comes in the widest range of wordings (copies, refusals) and gets more windows.
SAMPLE, TRAIN_WINDOWS, MORE_WINDOWS, EPOCHS, RATE = 2_200, 1_500, {"en": 5_000}, 20, 5e-3
#: Windows of a step, and loss from which a window's label is doubtful.
BATCH, DOUBTFUL = 64, 3.0
#: Requests that one task goes over from the start's weights, its rate, and the error below which a window has no gradient to speak of. A task's
#: windows of one language weigh at most HEAVIEST times as much as others.
SHARD, FINE_RATE, SETTLED, HEAVIEST = 12_000, 3e-4, 1e-3, 8.0
#: A sentence with fewer letters than SHORT counts by itself from confidence SURE, any other from UNSURE; else it takes the language
#: of a sentence beside it.
SHORT, SURE, UNSURE = 12, 0.9, 0.6

SENTENCE = re.compile(r"(?<=[.!?])[\"'”’»)\]]*\s+|(?<=[。！？])[”’」』)]*\s*|\s*\n\s*\n\s*|(?<=[.!?:。！？”’»)\]…])\s*\n\s*|(?<=[가-힣])\s*\n\s*(?![가-힣])|(?<![가-힣\s])\s*\n\s*(?=[가-힣ぁ-ヿ一-鿿])|\s+/\s+")
#: The same for texts in one line, which most are; see ``parted``.
IN_LINE = re.compile(r"[.!?。！？/](?:(?<=[.!?])[\"'”’»)\]]*\s+|(?<=[。！？])[”’」』)]*\s*|(?<=\s/)\s+)")
NUMBER = re.compile(r"\d[\d.,]*\d|\d")
#: Codes (currencies, tickers, labels in brackets), which are no words; and what shows that a sentence is not all in capitals.
CODE = re.compile(r"(?<![^\W\d_])[A-Z]{2,4}(?![^\W\d_])")
CAPITALS = re.compile(r"[A-Z][A-Z]")
CASED = re.compile(r"[a-z\u00df-\uffff]")
LETTERS = re.compile(r"[^\W\d_]+")
HANGUL = re.compile(r"[가-힣]")
#: What only words hold.
IN_WORDS = re.compile(r"[가-힣]|[A-Za-z][a-z]")
QUOTED = re.compile(r"[“‘\"(（「『][^”’\")）」』\n]{1,120}[”’\")）」』]")
TAG = re.compile(r"<[^<>\n]{0,80}>|https?://\S+")


@lru_cache(10_000)
def label(value: str | None) -> str | None:
    """The language a label names; null where it is missing, undetermined or unknown."""
    if not value:
        return None
    v = value.strip().lower().replace("_", "-")
    return SPELT.get(v) or SPELT.get(v.split("-")[0])


def has_words(text: str) -> bool:
    """Whether a text holds words rather than only numbers, codes and marks."""
    caps = 0
    if "<" in text or "://" in text:
        text = TAG.sub(" ", text)
    if IN_WORDS.search(text):
        return True
    for m in LETTERS.finditer(text):
        w = m.group()
        if not w.isascii() or (len(w) > 1 and not w.isupper()):
            return True
        caps += len(w) > 3
    return caps >= 2


@dataclass
class Network:
    """Weights of the network."""

    embed: np.ndarray
    filters: np.ndarray  # (sum over widths of width * DIM zero-padded to the widest, all filters)
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    shares: np.ndarray  # weights of the script shares
    temperature: float = 1.0

    def columns(self, x: np.ndarray) -> np.ndarray:
        """im2col: (windows, positions, widest * DIM)."""
        e = self.embed[x]
        w = max(WIDTHS)
        n = WINDOW - w + 1
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (len(x), n, w * DIM), (s[0], s[1], s[2]), writeable=False)

    def log_probabilities(self, x: np.ndarray, shares: np.ndarray, step: int = 1024) -> np.ndarray:
        """(windows, languages) for windows of bytes and the script shares of their sentences. What a filter gives at a place is the sum of what it
        gives for two pairs of bytes, which are looked up; windows of like length are worked on together, up to their last byte."""
        widest, total = max(WIDTHS), self.filters.shape[1]
        out = np.empty((len(x), len(LANGS)), np.float32)
        y = np.zeros((len(x), WINDOW + 2), np.uint16)
        y[:, :WINDOW] = x
        pairs = y[:, :-1] << 8 | y[:, 1:]
        known = np.zeros(1 << 16, bool)
        known[pairs] = True
        known = np.flatnonzero(known)
        slots = np.zeros(1 << 16, np.int32)
        slots[known] = np.arange(len(known))
        a, b = known >> 8, known & 0xFF
        each = [(self.embed @ self.filters[k * DIM : (k + 1) * DIM]).astype(np.float32, copy=False) for k in range(widest)]
        first, second = each[0][a] + each[1][b], each[2][a] + each[3][b]
        size = WINDOW - (x[:, ::-1] != 0).argmax(1)
        order = np.argsort(size, kind="stable")
        at = slots[pairs[order].T].astype(np.intp)  # by place
        places = WINDOW - widest + 1
        buffers = [np.empty((step, total), np.float32) for _ in range(3)]
        for i in range(0, len(x), step):
            c = order[i : i + step]
            m = min(places, int(size[c[-1]]))
            top, here, more = (x[: len(c)] for x in buffers)
            top[:] = -np.inf
            for j in range(m):
                np.take(first, at[j, i : i + step], axis=0, out=here, mode="clip")
                np.take(second, at[j + 2, i : i + step], axis=0, out=more, mode="clip")
                here += more
                np.maximum(top, here, out=top)
            # behind the last byte a filter gives zero
            z = np.maximum((np.maximum(top, 0) if m < places else top) + self.bias, 0) @ self.dense + shares[c] @ self.shares + self.dense_bias
            z -= z.max(1, keepdims=True)
            out[c] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out


#: Bytes as the network sees them: digits alike, ASCII upper case as lower.
BYTES = np.arange(256, dtype=np.uint8)
BYTES[48:58] = 48
BYTES[65:91] += 32
BYTES[[9, 10, 13]] = 32


def windows(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the sentences' bytes, zero-padded, and the sentence of each."""
    raw = [s.encode("utf-8", "replace") for s in sentences]
    n = np.fromiter(map(len, raw), np.int64, len(raw))
    count = np.maximum(1, -(-n // WINDOW))
    owner = np.repeat(np.arange(len(raw)), count)
    flat = np.zeros(int(count.sum()) * WINDOW, np.uint8)
    first = np.concatenate(([0], np.cumsum(count)[:-1])) * WINDOW
    body = BYTES[np.frombuffer(b"".join(raw), np.uint8)]
    at = np.arange(len(body)) + np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    flat[at] = body
    return flat.reshape(-1, WINDOW), owner


def sentence_scores(net: Network, sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sentences, languages) mean log-probabilities of each sentence's windows, and its letters."""
    x, owner = windows(sentences)
    shares, letters = shares_of(sentences)
    weight = np.count_nonzero(x, axis=1).astype(np.float64)
    lp = net.log_probabilities(x, shares[owner]) * weight[:, None]
    first = np.searchsorted(owner, np.arange(len(sentences)))
    return np.add.reduceat(lp, first, axis=0) / np.maximum(np.add.reduceat(weight, first), 1)[:, None], letters


def softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


#: Temperatures among which the best is sought.
TEMPERATURES = np.geomspace(0.5, 4, 25)


def losses(score: np.ndarray, langs: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(languages, temperatures) what held-out sentences of these scores lose; those whose label the network contradicts beyond doubt are left out."""
    at = np.flatnonzero(score[np.arange(len(langs)), langs] > -DOUBTFUL)
    score, langs, weight = score[at], langs[at], weight[at]
    each = [-weight * np.log(np.maximum(softmax(score / t)[np.arange(len(at)), langs], 1e-12)) if len(at) else weight for t in TEMPERATURES]
    return np.stack([np.bincount(langs, x, len(LANGS)) for x in each], axis=1)


def calibrated(net: Network, sentences: list[str], langs: np.ndarray) -> float:
    """The temperature at which held-out sentences are most likely."""
    if not sentences:
        return 1.0
    return float(TEMPERATURES[losses(sentence_scores(net, sentences)[0], langs, np.ones(len(langs))).sum(0).argmin()])


def filter_mask() -> np.ndarray:
    """Which weights of the filters, padded to the widest, are in use."""
    mask = np.zeros((max(WIDTHS) * DIM, FILTERS * len(WIDTHS)), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[: w * DIM, i * FILTERS : (i + 1) * FILTERS] = 1
    return mask


def shifted(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Windows of any length occur, and begin anywhere: shorten and shift."""
    x = np.roll(x, -int(rng.integers(0, 24)), axis=1)
    cutoff = rng.integers(16, WINDOW + 1, len(x))
    x[np.arange(WINDOW)[None, :] >= cutoff[:, None]] = 0
    return x


class Adam:
    """Steps of Adam on a network's weights, which are changed in place."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.mask, self.taken = p, filter_mask(), 0
        self.m, self.v = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def step(self, x: np.ndarray, u: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        p, widest, rows = self.p, max(WIDTHS), np.arange(len(x))
        cols = Network(**p).columns(x)
        z = (cols.reshape(-1, cols.shape[2]) @ p["filters"]).reshape(len(x), cols.shape[1], -1)
        top = z.argmax(1)
        best = np.take_along_axis(z, top[:, None, :], 1)[:, 0] + p["bias"]
        hidden = np.maximum(best, 0)
        logits = hidden @ p["dense"] + u @ p["shares"] + p["dense_bias"]
        logits -= logits.max(1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(1, keepdims=True)
        prob[rows, y] -= 1
        prob *= weight[:, None] / len(x)
        g = {"dense": hidden.T @ prob, "dense_bias": prob.sum(0), "shares": u.T @ prob}
        back = (prob @ p["dense"].T) * (best > 0)
        g["bias"] = back.sum(0)
        chosen = cols[rows[:, None], top]  # (batch, filters, widest * DIM)
        g["filters"] = np.einsum("bf,bfd->df", back, chosen) * self.mask
        through = back[:, :, None] * p["filters"].T[None]  # (batch, filters, widest * DIM)
        at = x[rows[:, None, None], top[:, :, None] + np.arange(widest)].astype(np.int64)
        cell = at[..., None] * DIM + np.arange(DIM)  # the same order as through
        g["embed"] = np.bincount(cell.ravel(), through.ravel(), 256 * DIM).reshape(256, DIM).astype(np.float32)
        g["embed"][0] = 0
        self.taken += 1
        for k in p:
            self.m[k] = 0.9 * self.m[k] + 0.1 * g[k]
            self.v[k] = 0.999 * self.v[k] + 0.001 * g[k] ** 2
            p[k] -= (rate * (self.m[k] / (1 - 0.9**self.taken)) / (np.sqrt(self.v[k] / (1 - 0.999**self.taken)) + 1e-8)).astype(np.float32)


def train(sentences: list[str], langs: list[int], seed: int = 5) -> Network:
    """Fit by Adam on windows balanced over languages; after half the epochs the windows with the largest loss, whose label
    is doubtful, are left out. Every tenth sentence is held out and sets the temperature."""
    rng = np.random.default_rng(seed)
    mask = filter_mask()
    widest, total = max(WIDTHS), FILTERS * len(WIDTHS)
    p = {
        "embed": rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
        "filters": (rng.normal(0, 1, (widest * DIM, total)) * mask / np.sqrt(3 * DIM)).astype(np.float32),
        "bias": np.zeros(total, np.float32),
        "dense": rng.normal(0, 0.2, (total, len(LANGS))).astype(np.float32),
        "dense_bias": np.zeros(len(LANGS), np.float32),
        "shares": np.zeros((2 * SCRIPTS, len(LANGS)), np.float32),
    }
    p["embed"][0] = 0
    if not sentences:
        return Network(**p)
    held = sentences[9::10], np.asarray(langs)[9::10]
    langs = [k for i, k in enumerate(langs) if i % 10 != 9]
    sentences = [t for i, t in enumerate(sentences) if i % 10 != 9]
    x, owner = windows(sentences)
    y, u = np.asarray(langs)[owner], shares_of(sentences)[0][owner]
    keep = (x != 0).sum(1) >= 6
    x, y, u = x[keep], y[keep], u[keep]
    pick = np.concatenate([rng.permutation(np.flatnonzero(y == k))[: MORE_WINDOWS.get(lang, TRAIN_WINDOWS)] for k, lang in enumerate(LANGS)]).astype(np.int64)
    x, y, u = x[pick], y[pick], u[pick]
    weight = np.ones(len(y), np.float32)
    for k in range(len(LANGS)):
        if (y == k).any():
            weight[y == k] = min(4.0, max(1.0, TRAIN_WINDOWS / (y == k).sum()))
    adam = Adam(p)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        if epoch == EPOCHS // 2:
            net = Network(**p)
            loss = -net.log_probabilities(x, u)[np.arange(len(y)), y]
            good = loss < DOUBTFUL
            x, y, u, weight = x[good], y[good], u[good], weight[good]
            order = rng.permutation(len(x))
        for i in range(0, len(order), BATCH):
            b = order[i : i + BATCH]
            adam.step(shifted(x[b], rng), u[b], y[b], weight[b], RATE * (1 - 0.8 * epoch / EPOCHS))
    net = Network(**p)
    net.temperature = calibrated(net, *held)
    return net


#: Hangul, kana, Han and Latin.
SCRIPTS = 4


def counts_of(sentences: list[str]) -> np.ndarray:
    """(sentences, 4) numbers of Hangul, kana, Han and Latin letters."""
    c = Chars(sentences, pad=1)
    raw = c.raw
    kinds = ((raw >= 0xAC00) & (raw <= 0xD7A3), (raw >= 0x3040) & (raw <= 0x30FF), (raw >= 0x4E00) & (raw <= 0x9FFF),
             ((raw | 32) >= 97) & ((raw | 32) <= 122) | (raw >= 0xC0) & (raw <= 0xFF))
    return np.stack([np.add.reduceat(k, c.starts, dtype=np.int64) for k in kinds], axis=1)


def admitted(n: np.ndarray) -> np.ndarray:
    """(sentences, languages): which languages the letters' scripts admit."""
    hangul, kana, han, latin = n.T
    ok = np.zeros((len(n), len(LANGS)), bool)
    korean = (hangul > 0) & (hangul * 3 >= latin * 0.5) & (hangul >= han + kana)
    japanese = ~korean & (kana > 0) & ((kana + han) * 3 >= latin * 0.4)
    chinese = ~korean & ~japanese & (han > 0) & (han * 4 >= latin * 0.5)
    western = ~korean & ~japanese & ~chinese & (latin > 0)
    ok[korean, 0] = True
    ok[japanese | chinese & (kana > 0), 2] = True
    ok[chinese, 3] = True
    ok[np.ix_(western, [1, 4, 5, 6, 7])] = True
    ok[~(korean | japanese | chinese | western)] = True
    return ok


def script_counts(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sentences, SCRIPTS) letters of each script, and the same without quoted and bracketed parts, unless nothing else is there."""
    n = counts_of(sentences)
    core = n.copy()
    mixed = np.flatnonzero((n > 0).sum(1) > 1)
    if len(mixed):
        outside = counts_of([QUOTED.sub(" ", sentences[i]) for i in mixed])
        some = outside.sum(1) > 0
        core[mixed[some]] = outside[some]
    return n, core


def shares_of(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The network's script inputs of each sentence, and its letters."""
    if not sentences:
        return np.zeros((0, 2 * SCRIPTS), np.float32), np.zeros(0, np.int64)
    n, core = script_counts(sentences)
    return shares_from(n, core), n.sum(1)


def shares_from(n: np.ndarray, core: np.ndarray) -> np.ndarray:
    share = [x / np.maximum(x.sum(1, keepdims=True), 1) for x in (core, n)]
    # small shares tell as much as large ones, and both more than a single filter
    return 3 * np.sqrt(np.concatenate(share, axis=1)).astype(np.float32)


def scripts_of(sentences: list[str]) -> np.ndarray:
    """Which languages each sentence's script admits. Used where labelled sentences are chosen, not where sentences are classified."""
    return admitted(script_counts(sentences)[1]) if sentences else np.zeros((0, len(LANGS)), bool)


def scripts(sentence: str) -> np.ndarray:
    return scripts_of([sentence])[0]


def split_sentences(text: str) -> Iterable[str]:
    """A text's sentences, with or without the spaces around them."""
    return SENTENCE.split(text) if "\n" in text else parted(IN_LINE, text)


def sentences_of(text: str) -> list[str]:
    return list(each_sentence(text))


#: Kinds of characters: digits, marks inside numbers, spaces, letters, ends of sentences, closing marks; capitals, and what makes a text be read by ``each_sentence``:
#: tags, slashes, ends that need no space.
DIGIT, IN_NUMBER, SPACE, LETTER_LIKE, END, CLOSING, CAPITAL, HARD = (1 << k for k in range(8))
#: Marks behind which a line end always ends a sentence.
BEFORE_LINE = np.array([0, *map(ord, ".!?:…")], np.uint32)


def kinds_table() -> np.ndarray:
    out = np.zeros(0x10000, np.uint8)
    for i in range(1, 0x10000):
        c = chr(i)
        out[i] = DIGIT * c.isdecimal() | SPACE * c.isspace() | LETTER_LIKE * (c.isalnum() and not c.isdecimal())
    for kind, marks in ((IN_NUMBER, ".,"), (END, ".!?"), (CLOSING, "\"'”’»)]"), (CAPITAL, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (HARD, "<。！？/\uffff")):
        out[[*map(ord, marks)]] |= kind
    return out


KINDS = kinds_table()


def all_sentences(texts: list[str]) -> tuple[list[str], list[int]]:
    """``each_sentence`` of many texts: the sentences, and the text of each. Plain texts, as most are, are worked on together: a run of spaces that ends a sentence
    becomes a line end, any other a space, and a number becomes a digit."""
    if not texts:
        return [], []
    c = Chars(texts, pad=1)
    raw, edges = c.raw.copy(), c.starts + c.lengths
    kind = np.take(KINDS, raw, mode="clip")
    space = (kind & SPACE) != 0
    # runs of spaces: where they begin, what stands before and behind, whether they hold a line end
    begins = np.flatnonzero(space & ~np.concatenate(([False], space[:-1])))
    behind = np.flatnonzero(space & ~np.concatenate((space[1:], [False]))) + 1
    before = np.where(begins > 0, raw[begins - 1], 0)
    broken = np.zeros(len(begins), bool)
    broken[np.searchsorted(begins, np.flatnonzero(raw == 10), "right") - 1] = True
    # texts that are not plain
    odd = (kind & HARD) != 0
    odd[:-1] |= ((kind[:-1] & kind[1:] & CAPITAL) != 0) | ((kind[:-1] & END) != 0) & ((kind[1:] & CLOSING) != 0)
    odd[begins[broken & ~np.isin(before, BEFORE_LINE) & (raw[behind] != 0)]] = True
    hard = np.zeros(len(texts), bool)
    hard[np.searchsorted(c.starts, np.flatnonzero(odd), "right") - 1] = True
    zeros = np.flatnonzero(raw == 0)
    if len(zeros) > len(texts):
        hard[np.searchsorted(c.starts, np.setdiff1d(zeros, edges), "right") - 1] = True
    # a number is what lies between the first and the last digit of a run of digits and marks
    digits = np.flatnonzero(kind & DIGIT)
    other = np.cumsum((kind & (DIGIT | IN_NUMBER)) == 0, dtype=np.int32)
    later = np.flatnonzero(np.diff(other[digits]) == 0) + 1
    raw[digits] = 48
    gone = np.zeros(len(raw) + 1, np.int8)
    gone[digits[later - 1] + 1] += 1
    gone[digits[later] + 1] -= 1
    keep = np.cumsum(gone[:-1], dtype=np.int8) == 0
    keep[space] = False
    keep[begins] = True
    ends = broken | np.isin(before, BEFORE_LINE[:4]) | (raw[behind] == 0)
    raw[begins] = np.where(ends, 10, 32)
    raw[edges] = 10
    edge = np.zeros(len(raw), bool)
    edge[edges] = True
    raw, edge, letter = raw[keep], edge[keep], (kind[keep] & LETTER_LIKE) != 0
    cuts = np.flatnonzero(raw == 10)
    some = np.logical_or.reduceat(letter, np.concatenate(([0], cuts[:-1] + 1)))
    of = np.cumsum(edge, dtype=np.int64)[cuts] - edge[cuts]
    some &= ~hard[of]
    lines = raw.tobytes().decode("utf-32-le", "replace").split("\n")
    parts, owner = [lines[i] for i in np.flatnonzero(some)], of[some]
    if hard.any():
        at = np.flatnonzero(hard)
        more = [(i, x) for i in at.tolist() for x in each_sentence(texts[i])]
        parts += [x for _, x in more]
        owner = np.concatenate((owner, np.array([i for i, _ in more], np.int64)))
        order = np.argsort(owner, kind="stable")
        parts, owner = [parts[i] for i in order], owner[order]
    return parts, owner.tolist()


def each_sentence(text: str) -> Iterator[str]:
    """Sentences with words or part of them; pieces without a letter are dropped, since they make no segment. Numbers and codes, which say nothing of
    the language, become a digit, so that more sentences of a batch are equal and worked out once."""
    if "<" in text or "://" in text:
        text = TAG.sub(" ", text)
    for s in split_sentences(text):
        if s and LETTERS.search(s):
            yield " ".join(NUMBER.sub("0", CODE.sub("0", s) if CAPITALS.search(s) and CASED.search(s) else s).split())


@dataclass
class Segments:
    """Languages of texts by a trained network."""

    network: Network

    def classify(self, sentences: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, confidence and letters of each sentence. Equal sentences of a batch are worked out once."""
        if not sentences:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        keys: dict[str, int] = {}
        index = np.fromiter((keys.setdefault(s, len(keys)) for s in sentences), np.int64, len(sentences))
        distinct = list(keys)
        score, letters = sentence_scores(self.network, distinct)
        prob = softmax(score / self.network.temperature)
        best = prob.argmax(1)
        return best[index], prob[np.arange(len(best)), best][index], letters[index]

    def segments(self, texts: list[str | None]) -> list[list[tuple[str, float]]]:
        """For each text its segments' languages and confidences, in order."""
        parts, owner = all_sentences([t if t and has_words(t) else "" for t in texts])
        lang, sure, letters = self.classify(parts)
        out: list[list[tuple[str, float]]] = [[] for _ in texts]
        if not parts:
            return out
        known = sure >= np.where(letters >= SHORT, UNSURE, SURE)
        # most texts are in one language throughout
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        one = np.logical_and.reduceat(known, first) & (np.minimum.reduceat(lang, first) == np.maximum.reduceat(lang, first))
        size = np.fromiter(map(len, parts), np.float64, len(parts))
        mean = np.add.reduceat(sure * size, first) / np.add.reduceat(size, first)
        ends = np.append(first[1:], len(parts)).tolist()
        whole = {i: (j, c) for i, j, c in zip(first[one].tolist(), np.array(ends)[one].tolist(), mean[one].tolist())}
        known, lang, sure = known.tolist(), lang.tolist(), sure.tolist()
        i = 0
        while i < len(parts):
            if i in whole:
                j, c = whole[i]
                out[owner[i]].append((LANGS[lang[i]], c))
                i = j
                continue
            j = i
            while j < len(parts) and owner[j] == owner[i]:
                j += 1
            last = next((lang[k] for k in range(i, j) if known[k]), lang[i])
            o, weight = out[owner[i]], 0.0
            for k in range(i, j):
                last = lang[k] if known[k] else last
                size, c = float(len(parts[k])), sure[k]
                if o and o[-1][0] == LANGS[last]:
                    o[-1] = (o[-1][0], (o[-1][1] * weight + c * size) / (weight + size))
                    weight += size
                else:
                    o.append((LANGS[last], c))
                    weight = size
            i = j
        return out


class Tuning:
    """Training on a shard of the labelled requests, from given weights. Every window is scored; steps are taken on those that have a gradient, weighted
    so that languages balance as they do at the start. Every tenth sentence, by its hash, is held out for the temperature."""

    def __init__(self, start: Network):
        self.net = Network(**{k: getattr(start, k).copy() for k in WEIGHTS})
        self.adam = Adam({k: getattr(self.net, k) for k in WEIGHTS})
        self.rng = np.random.default_rng(5)
        self.seen, self.held, self.lost = np.zeros(len(LANGS)), np.zeros(len(LANGS)), np.zeros((len(LANGS), len(TEMPERATURES)))

    def add(self, texts: list[str | None], labels: list[str | None]) -> None:
        both = [(t, LANGS.index(named)) for t, named in zip(texts, map(label, labels)) if named and t]
        parts, owner = all_sentences([t for t, _ in both])
        times = Counter(zip(parts, [both[i][1] for i in owner]))
        pairs = [x for x in times if has_words(x[0])]
        if not pairs:
            return
        sentences, langs, often = [s for s, _ in pairs], np.array([k for _, k in pairs]), np.array([times[x] for x in pairs], np.float64)
        n, core = script_counts(sentences)
        # in a script that the label's language cannot have, the label is wrong beyond doubt
        fits = np.flatnonzero(admitted(core)[np.arange(len(langs)), langs])
        if not len(fits):
            return
        sentences, langs, often, u = [sentences[i] for i in fits], langs[fits], often[fits], shares_from(n[fits], core[fits])
        held = np.fromiter((zlib.crc32(s.encode("utf-8", "replace")) % 10 == 9 for s in sentences), bool, len(sentences))
        if held.any():
            score, _ = sentence_scores(self.net, [sentences[i] for i in np.flatnonzero(held)])
            self.lost += losses(score, langs[held], often[held])
            self.held += np.bincount(langs[held], often[held], len(LANGS))
        x, owner = windows(sentences)
        keep = ~held[owner] & ((x != 0).sum(1) >= 6)
        x, owner = x[keep], owner[keep]
        self.seen += np.bincount(langs[owner], often[owner], len(LANGS))
        weight = WANTED * self.seen.sum() / np.maximum(self.seen, 1)
        weight = (np.minimum(weight, HEAVIEST)[langs] * often).astype(np.float32)
        order = self.rng.permutation(len(x))
        for i in range(0, len(order), MOST):
            b = order[i : i + MOST]
            p = np.exp(self.net.log_probabilities(x[b], u[owner[b]])[np.arange(len(b)), langs[owner[b]]])
            b = b[(p < 1 - SETTLED) & (p > np.exp(-DOUBTFUL))]
            for j in range(0, len(b), BATCH):
                c = b[j : j + BATCH]
                self.adam.step(shifted(x[c], self.rng), u[owner[c]], langs[owner[c]], weight[owner[c]], FINE_RATE)

    def parts(self):
        total = self.seen.sum()
        flat = np.concatenate([getattr(self.net, k).ravel().astype(np.float64) for k in WEIGHTS])
        yield 0, np.concatenate(([total], self.held, self.lost.ravel(), total * flat)).tobytes()


#: The network's weights, and windows that are scored before steps are taken on them.
WEIGHTS, MOST = ("embed", "filters", "bias", "dense", "dense_bias", "shares"), 4096
#: The share of each language in what is learnt.
WANTED = np.array([MORE_WINDOWS.get(x, TRAIN_WINDOWS) for x in LANGS]) / sum(MORE_WINDOWS.get(x, TRAIN_WINDOWS) for x in LANGS)


def merge_weights(*parts: bytes) -> bytes:
    return sum(map(np.frombuffer, parts)).tobytes()


def tuned(start: Network, total: np.ndarray) -> Network:
    """The mean of the shards' networks, each weighing as many windows as it went over, and the temperature of all their held-out sentences."""
    if not total[0]:
        return start
    _, held, lost, flat = np.split(total, np.cumsum([1, len(LANGS), len(LANGS) * len(TEMPERATURES)]))
    flat = (flat / total[0]).astype(np.float32)
    # languages count as they do in training, however many sentences they have
    lost = (WANTED / np.maximum(held, 1)) @ lost.reshape(len(LANGS), -1)
    ends = np.cumsum([getattr(start, k).size for k in WEIGHTS])
    parts = {k: x.reshape(getattr(start, k).shape) for k, x in zip(WEIGHTS, np.split(flat, ends[:-1]))}
    return Network(**parts, temperature=float(TEMPERATURES[lost.argmin()]) if lost.any() else start.temperature)


def first_weights(students: DataFrame) -> Network:
    """Where training on all requests starts: a fit on a hash sample of the requests of each label (SAMPLE rows at most)."""
    rows = students.select("request_id", "translation", "lang_label")
    sample = strata_sample(rows, "request_id", "lang_label", label, SAMPLE, "language")
    found = [(s, LANGS.index(sample[i][0])) for s, i in zip(*all_sentences([r["translation"] or "" for _, r in sample])) if has_words(s)]
    sentences, langs = [s for s, _ in found], [k for _, k in found]
    # in a script that the label's language cannot have, the label is wrong beyond doubt
    fits = np.flatnonzero(scripts_of(sentences)[np.arange(len(langs)), langs]) if langs else []
    return train([sentences[i] for i in fits], [langs[i] for i in fits])


def fit(students: DataFrame) -> Segments:
    """Fit on all labelled requests. They are dealt out by their ids to shards, which train side by side from the same weights; the mean of the shards' weights is
    the network. Shards follow from the ids alone, so that another layout of the files gives the same."""
    start = first_weights(students)
    shards = -(-students.count() // SHARD)
    if not shards:
        return Segments(start)
    rows = students.where("lang_label is not null").select("request_id", "translation", "lang_label")
    dealt = rows.repartition(shards, "request_id").sortWithinPartitions("request_id", "translation", "lang_label").select("translation", "lang_label")
    total = gathered(dealt, lambda: Tuning(start), merge_weights, 0, 1)
    return Segments(tuned(start, np.frombuffer(total[0])) if total else start)


def language_records(students: DataFrame, cases: bool = False) -> DataFrame:
    """Segments of every request: request_id, lang_label, label, segment_no, segments, lang, confidence, and whether the request is spoiled. With ``cases``
    only those of requests that are not spoiled and whose label is missing or not the segment's, or that have several."""
    model, residues = fit(students), residue.fit(students)

    def make():
        def work(ids, labels, texts):
            bad = residues.found(texts).tolist()
            out = {k: [] for k in ("request_id", "lang_label", "label", "segment_no", "segments", "lang", "confidence", "spoiled")}
            if cases:
                texts = [None if b else t for t, b in zip(texts, bad)]
            for i, parts in enumerate(model.segments(texts)):
                named = label(labels[i])
                if cases and len(parts) == 1 and parts[0][0] == named:
                    continue
                for n, (lang, sure) in enumerate(parts, 1):
                    for k, v in zip(out, (ids[i], labels[i], named, n, len(parts), lang, sure, bad[i])):
                        out[k].append(v)
            return out

        return work

    schema = "request_id string, lang_label string, label string, segment_no bigint, segments bigint, lang string, confidence double, spoiled boolean"
    return map_rows(students.select("request_id", "lang_label", "translation"), make, schema, text=2)


def p5_found(students: DataFrame) -> DataFrame:
    """Segments of the requests whose label is missing or wrong or whose text has several languages, each once; spoiled requests are left out."""
    case = (F.col("segments") > 1) | F.col("label").isNull() | (F.col("label") != F.col("lang"))
    return language_records(students, cases=True).where(~F.col("spoiled") & case).select("request_id", "segment_no", "lang").distinct()


def language_share(students: DataFrame) -> DataFrame:
    """Requests by language found and label, with the mean confidence. A request counts once."""
    once = language_records(students).groupBy("request_id", "segment_no").agg(
        F.max("lang").alias("lang"), F.max("label").alias("label"), F.max("confidence").alias("confidence"))
    return once.groupBy("lang", "label").agg(F.countDistinct("request_id").alias("requests"), F.count("*").alias("segments"), F.round(F.avg("confidence"), 3).alias("confidence"))
