"""Text that breaks off inside a word or a sentence (problem 1).

Method: a backward character n-gram model. For the last k characters of a text (k from 1 to 12) it knows how often they stood at the
end of a complete unit and how often the text went on after them; longer contexts back off to shorter ones. The log-odds of end of
text against continuation, for each value's final context, are compared with a threshold that is set for each language of the column, and for
ends with and without a closing mark, on units held out from the counts: a full stop closes no sentence where texts mostly go on after it (an
abbreviation, a number). Ends inside texts (a sentence or line with another after it) are complete by construction; ends of whole values
count with their own occurrence left out. The language is the label's, if the script of the final context admits it, else the script's.

All requests take part: four fifths are counted, the rest set the thresholds. A final context reaches back to where the last unit begins, as the counted ones do.

Defined results: null, blank and wordless texts are not cut off. Marks and broken characters that a cut leaves behind (an ellipsis,
a bracketed ellipsis, a replacement character, a half-written tag) are set aside before the context is read. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.llm import residue
from quillforge.llm.language import LANGS, label
from quillforge.llm.chars import FOLD, folded, gathered, map_rows, parted
from quillforge.sources.tables import spread

ORDER = 12
#: Longer contexts than this count only if they occurred twice inside texts, or at an end.
DEEP = 8
#: Weight of the shorter context's estimate in the longer one's.
BACK_OFF = 0.6
#: By how much the end of a broken transfer (a broken character, tag or escape) raises the threshold. On 40,000 requests it decides one, which
#: ends in a number and half a tag; marks of left-out text and a space at the end decided none, and add nothing.
BROKEN = 8.0
#: No threshold is below this, and a language with fewer held-out units than FEW takes that of its script.
LOWEST, FEW = -5.0, 60
#: What a cut leaves behind.
MARKS = re.compile(r"(?:\s|…|\.\.\.|\[…\]|\[\.\.\.\]|\((?:생략|중략|후략|이하 생략|계속|다음에 계속|cut|truncated|continued|more)\)|�|<[a-zA-Z/]{0,8}$|&#?[a-z0-9]{0,5}$|\\u?[0-9a-fA-F]{0,3}$|[​﻿⁠]|[-–—]$)+$")
#: Characters on which a mark may end, besides full stops, brackets and the half-written.
LEFT_LAST = frozenset([*filter(str.isspace, map(chr, range(0x3001))), *"…�​﻿⁠-–—"])
#: Closing marks, which a complete text may have or lack.
CLOSERS = "\"'”’»」』)]}*_`"
FINAL = ".!?。！？"
#: Boundaries inside a text: after a closing mark, or a line end. A number before a full stop makes none, unless it is a year or a share.
#: Each begins with the character that is looked for, which few places hold, and then looks back.
INNER = re.compile(r"[.!?。！？\n/](?:(?<=[^\W\d][.!?])[\"'”’»)]*[ \t]+(?=[^\sa-z])|(?<=[\d]{4}[.!?])[\"'”’»)]*[ \t]+(?=\S)|(?<=[%)”’\"][.!?])[ \t]+(?=\S)|(?<=[。！？])|(?<=\n)\s*|(?<= /) )")
HANGUL = re.compile(r"[가-힣]")
#: Languages by script: Hangul, Han and kana, Latin.
SCRIPTS = (("ko",), ("ja", "zh"), ("en", "de", "fr", "es", "pt"))
#: Thresholds: of each language, and of each script, with and without a closing mark.
SLOTS = len(LANGS) + len(SCRIPTS)


def script(text: str) -> int:
    """The script of a final context."""
    tail = text[-24:]
    if HANGUL.search(tail):
        return 0
    if re.search(r"[぀-ヿ一-鿿]", tail):
        return 1
    return 2


def place_of(text: str, named: str | None) -> int:
    """The threshold's place for a final context and the language that a label names."""
    k = script(text)
    return LANGS.index(named) if named in SCRIPTS[k] else len(LANGS) + k


def stripped(text: str) -> tuple[str, float]:
    """The text without what a cut leaves behind, and by how much that raises the threshold."""
    if text[-1:] not in LEFT_LAST and not text.endswith(("...", "]", ")")) and not any(c in text[-9:] for c in "<&\\"):
        return text, 0.0
    core = MARKS.sub("", text)
    return core, BROKEN if re.search(r"[�<&\\]", text[len(core) :]) else 0.0


def fold(text: str) -> list[int]:
    return [int(FOLD[c]) if c < 0x10000 else c for c in map(ord, text)]


def contexts(text: str) -> np.ndarray:
    """Hashes of the last 1 to ORDER characters."""
    return many_contexts([text])[0]


def many_contexts(texts: list[str]) -> np.ndarray:
    """(texts, ORDER) hashes of each text's last 1 to ORDER characters; places before its start count as code 1."""
    tails = [t[-ORDER:].rjust(ORDER, "\x01") for t in texts]
    codes = np.ascontiguousarray(folded(np.frombuffer("".join(tails).encode("utf-32-le", "replace"), np.uint32)).reshape(len(texts), ORDER).T)
    h, out = np.full(len(texts), 0x811C9DC5, np.uint32), np.empty((len(texts), ORDER), np.uint32)
    for k in range(ORDER):
        h = (h ^ codes[ORDER - 1 - k]) * np.uint32(0x01000193)
        m = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out[:, k] = m ^ (m >> np.uint32(12))
    return out


def all_contexts(codes: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the hash of the characters up to and with each of the positions ``at``; places before the start count as code 1."""
    before = np.concatenate((np.ones(ORDER, np.uint32), codes))
    h = np.full(len(at), 0x811C9DC5, np.uint32)
    at = at + ORDER
    for _ in range(ORDER):
        h ^= np.take(before, at, mode="clip")
        h *= np.uint32(0x01000193)
        m = h >> np.uint32(15)
        m ^= h
        m *= np.uint32(0x2C1B3C6D)
        m ^= m >> np.uint32(12)
        yield m
        at -= 1


def bare(unit: str) -> str:
    """A unit without closing marks."""
    return unit.rstrip(FINAL + CLOSERS + " \t:;")


def noun_endings(unit: str) -> list[str]:
    """The forms in which a complete Korean sentence may close as a noun, as headings and notes do, by the rule of the alphabet."""
    if not unit.endswith("다"):
        return []
    tail = unit[-4:]
    return [unit[: len(unit) - len(tail)] + x for x in noun_tails(tail)]


@lru_cache(100_000)
def noun_tails(tail: str) -> tuple[str, ...]:
    """The same for the last four characters, which all follows from."""
    m = re.search(r"(.)(?:습니다|다)$|(.)니다$", tail)
    if not m or not (s := m.group(1) or m.group(2)) or not 0xAC00 <= ord(s) <= 0xD7A3:
        return ()
    stem, code = tail[: m.start()], ord(s) - 0xAC00
    final, vowel, base = code % 28, code // 28 % 21, code // 28
    # vowels of the past tense and those of their stems: ae-a, wae-oe, yeo-i, wa-o, wo-u
    back = {1: 0, 10: 11, 6: 20, 9: 8, 14: 13}.get(vowel, vowel) if final == 20 else vowel
    noun = chr(0xAC00 + (base - vowel + back) * 28 + 16)
    if final in (4, 17) or final == 0:
        return (stem + noun,)
    return (stem + noun, stem + s + "음") if final == 20 else (stem + s + "음",)


@dataclass
class Ends:
    """Counts of contexts at ends and inside, by the hash of the context, and the thresholds: (without and with a closing mark, SLOTS)."""

    keys: np.ndarray
    ends: np.ndarray
    inside: np.ndarray
    prior: float
    threshold: np.ndarray = field(default_factory=lambda: np.zeros((2, SLOTS)))
    #: A broadcast of the counts, where there is one: tasks share it, so that the counts are sent and unpacked once for all passes.
    sent: Broadcast | None = None

    def __getstate__(self) -> dict:
        """Sorted keys as steps, in small types, so that what goes to the tasks stays small; they are the contexts of all requests."""
        if self.sent is not None:
            return {"sent": self.sent, "prior": self.prior, "threshold": self.threshold}
        packed = narrow(np.diff(self.keys, prepend=np.uint32(0)), np.uint16) + narrow(self.ends, np.uint8) + narrow(self.inside, np.uint8)
        return {"packed": packed, "prior": self.prior, "threshold": self.threshold}

    def __setstate__(self, state: dict) -> None:
        self.sent, self.prior, self.threshold = None, state["prior"], state["threshold"]
        if "sent" in state:
            of = state["sent"].value
            self.keys, self.ends, self.inside = of.keys, of.ends, of.inside
            return
        keys, at = widened(state["packed"], 0, np.uint16)
        self.keys = np.cumsum(keys, dtype=np.uint32)
        self.ends, at = widened(state["packed"], at, np.uint8)
        self.inside, _ = widened(state["packed"], at, np.uint8)

    def log_odds(self, text: str) -> float:
        return float(self.many_log_odds([text])[0])

    def many_log_odds(self, texts: list[str]) -> np.ndarray:
        h = many_contexts(texts)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        known = np.logical_and.accumulate(self.keys[at] == h, axis=1)
        e, c = self.ends[at].astype(np.float64), self.inside[at].astype(np.float64)
        p = np.full(len(texts), self.prior)
        for k in range(ORDER):
            p = np.where(known[:, k], (e[:, k] + BACK_OFF * p * 4) / (e[:, k] + c[:, k] + BACK_OFF * 4), p)
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return np.log(p / (1 - p)) - np.log(self.prior / (1 - self.prior))

    def cut(self, text: str | None) -> bool:
        return bool(self.many_cut([text])[0])

    def many_cut(self, texts: list[str | None], labels: list[str | None] | None = None) -> np.ndarray:
        out = np.zeros(len(texts), bool)
        at, asked, bounds = [], [], []
        for i, t in enumerate(texts):
            if t and (q := question(t)):
                at.append(i)
                asked.append(last_unit(q[0]))
                bounds.append(self.threshold[q[1], place_of(q[0], label(labels[i]) if labels else None)] + q[2])
        if at:
            out[at] = self.many_log_odds(asked) < np.array(bounds)
        return out


def last_unit(text: str) -> str:
    """The end of a text back to where its last unit begins, or ORDER characters at least: what contexts inside texts are counted in."""
    parts = units(text[-4 * ORDER :])
    return parts[-1] if parts else ""


def question(text: str) -> tuple[str, int, float] | None:
    """The final context to judge, whether it has a closing mark, and what raises the threshold; null where there is no letter to judge."""
    core, marked = stripped(text)
    tail = core.rstrip(CLOSERS + " ")
    if tail[-1:] and tail[-1] in FINAL:
        return (tail, 1, 0.0) if any(map(str.isalpha, tail)) else None
    if not any(map(str.isalpha, tail[-ORDER:])) and (not marked or not any(map(str.isalpha, tail))):
        return None
    return bare(core), 0, marked


def units(text: str) -> list[str]:
    return [u for part in parted(INNER, text) if (u := part.strip())]


#: A mark inside a unit, after which it goes on.
GOES_ON = re.compile(r"[.!?](?=[ \t]*\w)")


def bound(whole: np.ndarray, broken: np.ndarray) -> float:
    """The threshold between complete and broken ends, of which each step's numbers are given: complete texts are far more frequent than cut ones."""
    cost = 25 * np.cumsum(whole)[:-1] / whole.sum() + 1 - np.cumsum(broken)[:-1] / broken.sum()
    near = STEPS[cost <= cost.min() + 0.01]
    return max(LOWEST, float(0.65 * near[0] + 0.35 * near[-1]))


#: Whether a folded character is a letter, digit or space.
WORD = np.array([chr(x).isalnum() or x == 32 for x in range(0x10000)])
#: Tables of counts: contexts inside units by order, contexts at the ends of units, and at the ends of whole values.
AT_END, FINAL_END = ORDER, ORDER + 1
#: Slots that a table is cut into by its keys' first bits, so that no task merges a whole one.
CUTS = 4
#: So many last characters of a form hold all that its contexts and those of its noun endings are made of.
ENOUGH = ORDER + 4
#: One request in so many sets the thresholds; the others are counted.
HELD = 5


def counted(keys: np.ndarray) -> np.ndarray:
    """Distinct keys in order with how often they occur, each as one number: the key above, the count below."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ 1))
    return keys[at].astype(np.uint64) << np.uint64(32) | np.diff(at, append=len(keys)).astype(np.uint64)


def split(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (table >> np.uint64(32)).astype(np.uint32), table & np.uint64(0xFFFFFFFF)


def joined(tables: list[np.ndarray]) -> np.ndarray:
    """The distinct keys of all tables with the sums of their counts."""
    if len(tables) == 1:
        return tables[0]
    both = np.concatenate(tables)
    both.sort()
    keys, n = split(both)
    at = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ 1))
    sums = np.add.reduceat(n, at) if len(at) else n
    return keys[at].astype(np.uint64) << np.uint64(32) | np.minimum(sums, np.uint64(0xFFFFFFFF))


def narrow(x: np.ndarray, kind: type) -> bytes:
    """Numbers in a smaller type, and those that it does not hold behind them."""
    most = np.iinfo(kind).max
    rest = x[x >= most].astype(np.uint32)
    return np.array([len(x), len(rest)], np.int64).tobytes() + np.minimum(x, most).astype(kind).tobytes() + rest.tobytes()


def widened(data: bytes, at: int, kind: type) -> tuple[np.ndarray, int]:
    """The numbers that ``narrow`` put at a place, and the place behind them."""
    n, more = np.frombuffer(data, np.int64, 2, at).tolist()
    end = at + 16 + n * np.dtype(kind).itemsize
    x = np.frombuffer(data, kind, n, at + 16).astype(np.uint32)
    if more:
        x[x == np.iinfo(kind).max] = np.frombuffer(data[end : end + 4 * more], np.uint32)
    return x, end + 4 * more


def packed(table: np.ndarray) -> bytes:
    """A table as steps between its keys and counts, most of which are small."""
    keys, n = split(table)
    return narrow(np.diff(keys, prepend=np.uint32(0)), np.uint16) + narrow(n, np.uint8)


def unpacked(data: bytes) -> np.ndarray:
    keys, at = widened(data, 0, np.uint16)
    return np.cumsum(keys, dtype=np.uint32).astype(np.uint64) << np.uint64(32) | widened(data, at, np.uint8)[0]


class Counts:
    """Counts of contexts over any number of texts. The tables of steps are joined when they have grown to twice what was joined last."""

    def __init__(self):
        self.tables: list[list[np.ndarray]] = [[] for _ in range(ORDER + 2)]
        self.joined = [1 << 20] * (ORDER + 2)
        self.known = self.finals = self.going = 0

    def put(self, at: int, hashes: np.ndarray) -> None:
        some = self.tables[at]
        some.append(counted(hashes))
        if len(some) > 1 and sum(map(len, some)) > 2 * self.joined[at]:
            self.tables[at] = [joined(some)]
            self.joined[at] = max(1 << 20, len(self.tables[at][0]))

    def add(self, texts: list[str | None]) -> None:
        parts = [units(t) for t in texts if t and t.strip()]
        every = [u for p in parts for u in p]
        if not every:
            return
        known = [u for p in parts for u in p[:-1]]
        final = [f for t in texts if t and t.strip() if (f := last_unit(bare(stripped(t)[0])))]
        raw = np.frombuffer(("\x01" * ORDER + ("\x01" * ORDER).join(every)).encode("utf-32-le", "replace"), np.uint32)
        c = folded(raw)
        word = np.take(WORD, c, mode="clip")
        for i in np.flatnonzero(c >= 0x10000):
            word[i] = chr(c[i]).isalnum()
        # a position counts as inside where the same unit goes on with a letter, digit or space after it, or a number with a mark inside it
        goes = np.zeros(len(c), bool)
        goes[:-1] = (c[:-1] != 1) & word[1:] & (c[:-1] != 32)
        digit = c == 48
        goes[:-1] |= digit[:-1] & (c[1:] == 37)
        goes[:-2] |= digit[:-2] & ((c[1:-1] == 44) | (c[1:-1] == 46)) & digit[2:]
        for k, h in enumerate(all_contexts(c, np.flatnonzero(goes))):
            self.put(k, h)
        times: dict[str, int] = {}
        for u in known:
            # of a long form only the end takes part: equal ends are worked out once
            end = u[-ENOUGH - 4 :]
            if len(bare(end)) < ENOUGH:
                end = u
            times[end] = times.get(end, 0) + 1
        ends: dict[str, int] = {}
        for u, n in times.items():
            b = bare(u)
            for form in {u.rstrip(CLOSERS), b, *noun_endings(b)}:
                if form:
                    ends[form[-ORDER:]] = ends.get(form[-ORDER:], 0) + n
        if ends:
            self.put(AT_END, np.repeat(many_contexts(list(ends)), list(ends.values()), axis=0).ravel())
        if final:
            self.put(FINAL_END, many_contexts(final).ravel())
        self.known += len(known)
        self.finals += len(parts)
        self.going += int(goes.sum())

    def parts(self):
        """Each table's slots, packed, and at the last slot the numbers of units, values and places inside."""
        for at, some in enumerate(self.tables):
            if some:
                table = joined(some)
                bounds = np.searchsorted(table, np.arange(1, CUTS, dtype=np.uint64) * np.uint64((1 << 64) // CUTS))
                for i, x in enumerate(np.split(table, bounds)):
                    yield at * CUTS + i, packed(x)
                some.clear()
        yield (ORDER + 2) * CUTS, np.array([self.known, self.finals, self.going], np.int64).tobytes()


def merge_counts(*parts: bytes) -> bytes:
    if len(parts[0]) == 24:
        return sum(np.frombuffer(x, np.int64) for x in parts).tobytes()
    return packed(joined([unpacked(x) for x in parts]))


def finish_counts(slot: int, data: bytes) -> bytes:
    """Deep contexts count if they occurred twice, and ends of whole values with their own occurrence left out."""
    at = slot // CUTS
    if at > FINAL_END:
        return data
    keys, n = split(unpacked(data))
    if at == FINAL_END:
        n = n - np.uint64(1)
    keep = n > np.uint64(DEEP <= at < ORDER)
    return packed(keys[keep].astype(np.uint64) << np.uint64(32) | n[keep])


def model_of(slots: dict[int, bytes]) -> Ends:
    """The model from the finished slots of all counts, its thresholds still unset."""
    known, finals, going = np.frombuffer(slots.get((ORDER + 2) * CUTS, bytes(24)), np.int64).tolist()
    tables = {k: unpacked(v) for k, v in slots.items() if k < (ORDER + 2) * CUTS}
    nothing = np.zeros(0, np.uint64)
    sides = [joined([nothing, nothing, *(v for k, v in tables.items() if (k >= AT_END * CUTS) == side)]) for side in (True, False)]
    tables.clear()
    keys = np.sort(np.concatenate([split(x)[0] for x in sides]))
    keys = keys[np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ 1))]
    if not len(keys):
        return Ends(*np.zeros((3, 1), np.uint32), 0.5)
    out = []
    for x in sides:
        k, n = split(x)
        out.append(np.zeros(len(keys), np.uint32))
        out[-1][np.searchsorted(keys, k)] = n.astype(np.uint32)
    total = known * 2 + finals
    return Ends(keys, out[0], out[1], total / (total + going))


#: Thresholds among which the best is sought.
STEPS = np.linspace(-8, 6, 141)


class Margins:
    """How many complete and broken ends of held-out units lie below each step, by kind of end and place of the threshold."""

    def __init__(self, model: Ends):
        self.model = model
        self.below = np.zeros((2, SLOTS, 2, len(STEPS) + 1), np.int64)  # closing mark, place, complete or broken, step

    def add(self, texts: list[str | None], labels: list[str | None]) -> None:
        ends: list[str] = []
        kinds: list[tuple[int, int, int]] = []
        for t, named in zip(texts, map(label, labels)):
            for u in units(t)[:-1] if t and t.strip() else ():
                form, draw = bare(u), zlib.crc32(u.encode("utf-8", "replace"))
                if len(form) > 3:
                    at = place_of(form, named)
                    ends.append(form)
                    kinds.append((0, at, 0))
                    if len(u) > 8 and (broken := bare(u[: 2 + draw % (len(u) - 4)])):
                        ends.append(broken)
                        kinds.append((0, at, 1))
                closed = u.rstrip(CLOSERS + " ")
                if closed and closed[-1] in FINAL and any(map(str.isalpha, closed)):
                    at = place_of(closed, named)
                    ends.append(closed)
                    kinds.append((1, at, 0))
                    if inner := [m.end() for m in GOES_ON.finditer(closed[:-1])]:
                        ends.append(closed[: inner[draw % len(inner)]])
                        kinds.append((1, at, 1))
        if ends:
            step = np.searchsorted(STEPS, self.model.many_log_odds(ends), side="right")
            np.add.at(self.below, (*np.array(kinds).T, step), 1)

    def parts(self):
        yield 0, self.below.tobytes()


def merge_margins(*parts: bytes) -> bytes:
    return sum(np.frombuffer(x, np.int64) for x in parts).tobytes()


def set_thresholds(model: Ends, below: np.ndarray) -> Ends:
    """The thresholds from all held-out units."""
    for kind in (0, 1):
        for g in [*range(len(LANGS), SLOTS), *range(len(LANGS))]:
            names = SCRIPTS[g - len(LANGS)] if g >= len(LANGS) else (LANGS[g],)
            whole, broken = below[kind, [*{g, *(LANGS.index(x) for x in names)}]].sum(0)
            of = next(len(LANGS) + k for k, x in enumerate(SCRIPTS) if names[0] in x)
            if g < len(LANGS) and (whole.sum() < FEW or broken.sum() < FEW):
                model.threshold[kind, g] = model.threshold[kind, of]
            elif broken.sum() < (FEW if kind else 1):
                # without broken ends nothing can be told apart
                model.threshold[kind, g] = -np.inf if kind else LOWEST
            else:
                model.threshold[kind, g] = bound(whole, broken)
    return model


def train(texts: list[str], labels: list[str | None] | None = None) -> Ends:
    """Count contexts on four fifths of the texts and set the thresholds on the rest."""
    both = [(t, x) for t, x in zip(texts, labels or [None] * len(texts)) if t and t.strip()]
    counts = Counts()
    counts.add([t for i, (t, _) in enumerate(both) if i % HELD != HELD - 1])
    model = model_of({k: finish_counts(k, v) for k, v in counts.parts()})
    margins = Margins(model)
    margins.add(*zip(*both[HELD - 1 :: HELD])) if len(both) >= HELD else None
    return set_thresholds(model, margins.below)


def fit(students: DataFrame) -> Ends:
    """Fit on all requests: four fifths are counted, each delivery once, since an end's own occurrence is left out; the rest set the thresholds."""
    held = F.pmod(F.xxhash64(F.lit("ends"), F.col("request_id")), F.lit(HELD)) == HELD - 1
    rows = students.select("request_id", "translation", "lang_label")
    texts = rows.where(~held).select("request_id", "translation").distinct().select("translation")
    model = model_of(gathered(texts, Counts, merge_counts, 0, (ORDER + 2) * CUTS + 1, finish_counts))
    model.sent = students.sparkSession.sparkContext.broadcast(model)
    below = gathered(spread(rows.where(held).select("translation", "lang_label")), lambda: Margins(model), merge_margins, 0, 1)
    return set_thresholds(model, np.frombuffer(below[0], np.int64).reshape(2, SLOTS, 2, -1) if below else Margins(model).below)


def cut_records(students: DataFrame) -> DataFrame:
    """request_id, corpus and whether the translation is cut off or spoiled, one row a delivery. One pass, no shuffle."""
    ends, spoiled = fit(students), residue.fit(students)

    def make():
        def work(ids, corpora, texts, labels):
            bad = spoiled.found(texts)
            return {"request_id": ids, "corpus": corpora, "spoiled": bad, "cut": ends.many_cut([None if b else t for t, b in zip(texts, bad)], labels)}

        return work

    schema = "request_id string, corpus string, spoiled boolean, cut boolean"
    return map_rows(students.select("request_id", "corpus", "translation", "lang_label"), make, schema, text=2)


def p1_found(students: DataFrame) -> DataFrame:
    """The requests whose translation is cut off, each once; spoiled requests are left out."""
    return cut_records(students).where("cut").select("request_id").distinct()


def cut_share(students: DataFrame) -> DataFrame:
    """For each corpus, its requests, those cut off and their share. A request counts once."""
    once = cut_records(students).groupBy("request_id", "corpus").agg(F.max("cut").alias("cut"))
    return (
        once.groupBy("corpus").agg(F.count("*").alias("requests"), F.count_if("cut").alias("cut_off"))
        .withColumn("share", F.col("cut_off") / F.col("requests"))
    )
