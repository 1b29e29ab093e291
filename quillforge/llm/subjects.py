"""Subjects of each document (problem 8).

Method: the document-term matrix of the whole corpus is factored into non-negative components by alternating multiplicative updates of
the Kullback-Leibler objective. Twelve components are anchored, each to one subject, by seeds from hand labels and the subjects'
descriptions; two more take the common wording of either script. Each pass goes over all documents: their mixtures are updated where
they lie, and only the components' sums (components x terms, hashed to a fixed number) travel, added up in a tree. A document's own
mixture then weighs the components for each of its sentences, and the subjects' shares are shares of its sentences.

Defined results: null, blank and stub texts have no subject. Headings and closing notes are no sentences. Null labels are left out;
a document with several labels seeds each in part. Repeated documents are each reported. With no labels the descriptions alone are the
seeds; with no subjects, or an empty corpus, there is no row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.llm.chars import map_rows
from quillforge.session import checkpoint_folder

#: Hashed terms: the lower half for Latin script, the upper for the rest.
HALF = 1 << 14
TERMS = 2 * HALF
#: Passes over the corpus, and updates of each document's mixture in a pass.
PASSES, INNER = 4, 6
#: Updates of a document's mixture with the last components.
LAST = 12
#: Documents of one vectorised step, and partial sums added in one task.
STEP, FAN = 1_000, 16
#: Documents whose mixtures are updated together.
CACHED = 128
#: Share of a document's sentences that makes a subject, and evidence (in terms) that gives a sentence to a subject.
SHARE, EVIDENCE = 0.25, 1.3
SEED_WEIGHT, SMOOTH = 3.0, 0.02

WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
BULLET = re.compile(r"^\s*(?:[-*•·▪◦]|\d{1,3}[.)]|\([0-9a-z]\))\s+")
END = re.compile(r"[.!?。！？…][\"'”’»)\]]*$")
SPLIT = re.compile(r"(?<=[.!?。！？])[\"'”’»)]*\s+(?=[“‘\"'(]?[A-Z가-힣0-9一-鿿])")
ABBREVIATED = re.compile(r"(?:\b(?:approx|U\.S|Inc|Corp|Ltd|Co|No|vs|Mr|Ms|Dr)\.|\b[A-Z]\.)$")
#: Wording of closing notes.
CLOSING = re.compile(r"for information only|not an offer to (?:buy|sell)|not investment advice|정보 제공만을 목적|거래의 권유|투자 권유", re.I)


def sentences(text: str | None) -> list[str]:
    """Sentences of a text: without headings and closing notes; a line that goes on in the next is joined with it."""
    if not text:
        return []
    out: list[str] = []
    for block in re.split(r"\n[ \t\r]*\n", text.replace("\r\n", "\n")):
        lines: list[str] = []
        for line in block.split("\n"):
            if not line.strip():
                continue
            if lines and not BULLET.match(line) and not END.search(lines[-1].rstrip()):
                lines[-1] = lines[-1].rstrip().removesuffix("-") + ("" if lines[-1].rstrip().endswith("-") else " ") + line.strip()
            else:
                lines.append(line)
        for line in lines:
            item = BULLET.match(line)
            body = line[item.end() :].strip() if item else line.strip()
            unfinished = not item and not END.search(body)
            held = ""
            # a heading, or the unfinished tail of a paragraph, is no sentence
            for part in SPLIT.split(body)[: -1 if unfinished else None]:
                held = f"{held} {part}" if held else part
                if ABBREVIATED.search(held) or held.count("“") > held.count("”"):
                    continue  # an abbreviation, or still inside a quotation
                out.append(held)
                held = ""
            if held and not (unfinished and ABBREVIATED.search(held)):
                out.append(held)
    return [s for s in out if WORD.search(s) and not CLOSING.search(s)]


class Known(dict):
    """Words met before, each with its row in a table of hashed terms."""

    def __init__(self):
        super().__init__()
        self.rows = np.full((1 << 12, 4), -1, np.int32)

    def __missing__(self, w: str) -> int:
        low = w.lower()
        if low.isascii():
            stem = low[:-3] + "y" if low.endswith("ies") and len(low) > 4 else low[:-1] if low.endswith("s") and not low.endswith("ss") and len(low) > 3 else low
            ids = [zlib.crc32(stem.encode()) % HALF]
        else:
            # Korean words carry particles: their beginnings stand for them
            ids = [HALF + zlib.crc32(low[:n].encode("utf-8", "replace")) % HALF for n in (2, 3, 4) if len(low) >= n] or [HALF + zlib.crc32(low.encode("utf-8", "replace")) % HALF]
        at = self[w] = len(self)
        if at == len(self.rows):
            self.rows = np.concatenate((self.rows, np.full_like(self.rows, -1)))
        self.rows[at, : len(ids)] = ids
        return at


class Vocabulary:
    """Hashed terms of sentences: words and pairs of neighbouring words of one script. Words met before are remembered, up to a bound."""

    def __init__(self):
        self.known = Known()

    def terms(self, sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The terms of many sentences, end to end, and the sentence of each."""
        if len(self.known) > 200_000:
            self.known = Known()
        words = [WORD.findall(x) for x in sentences]
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64)
        of = np.repeat(np.arange(len(sentences)), np.fromiter(map(len, words), np.int64, len(words)))
        ids = self.known.rows[at]
        first = ids[:, 0].astype(np.int64)
        pair = (of[1:] == of[:-1]) & ((first[1:] < HALF) == (first[:-1] < HALF))
        pairs = (first[:-1] * 7919 + first[1:] * 104729) % HALF + np.where(first[1:] >= HALF, HALF, 0)
        here = ids >= 0
        flat, owner = np.concatenate((ids[here], pairs[pair])), np.concatenate((np.repeat(of, here.sum(1)), of[1:][pair]))
        order = np.argsort(owner, kind="stable")
        return flat[order].astype(np.int64), owner[order]


#: Rows of the matrix. Buffers of fixed-width numbers: the document's distinct terms (uint16) and their counts (float32); then for each of its
#: terms, sentence by sentence, the place of the term among the distinct ones (uint16), and the number of terms of each sentence (int32).
ROW = "doc_id bigint, ids binary, counts binary, back binary, sizes binary"


def rows_of(vocabulary: Vocabulary, texts: list[str | None]) -> list[list[bytes]]:
    """The matrix's buffers for many texts, column by column."""
    parts = [sentences(t) for t in texts]
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    flat, owner = vocabulary.terms([x for part in parts for x in part])
    doc = np.repeat(np.arange(len(parts)), n)[owner]
    keys, back, counts = np.unique(doc * TERMS + flat, return_inverse=True, return_counts=True)
    first = np.searchsorted(keys, np.arange(len(parts) + 1) * TERMS)
    begins = np.searchsorted(doc, np.arange(len(parts) + 1))
    ids, counts, back = (keys % TERMS).astype(np.uint16), counts.astype(np.float32), (back - first[doc]).astype(np.uint16)
    sizes, whole = np.bincount(owner, minlength=int(n.sum())).astype(np.int32), np.concatenate(([0], np.cumsum(n)))
    out: list[list[bytes]] = []
    for values, ends in ((ids, first), (counts, first), (back, begins), (sizes, whole)):
        out.append([values[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())])
    return out


def matrix(documents: DataFrame) -> DataFrame:
    """The document-term matrix, one row a document. Its terms keep their sentences, so that no text is parsed twice."""

    def make():
        vocabulary = Vocabulary()

        def work(ids, texts):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.binary()) for c in rows_of(vocabulary, texts))], ["doc_id", "ids", "counts", "back", "sizes"])

        return work

    return map_rows(documents.select("doc_id", "text"), make, ROW, text=1)


def buffer(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of buffers, end to end, and how many each row has; nothing is copied."""
    size = np.dtype(dtype).itemsize
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] // size
    values = np.frombuffer(data, dtype, int(ends[-1])) if data is not None else np.zeros(0, dtype)
    return values[ends[0] :], np.diff(ends)


def entries(ids: pa.Array, counts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, term and count of the entries of some rows."""
    terms, n = buffer(ids, np.uint16)
    return np.repeat(np.arange(len(n)), n), terms, buffer(counts, np.float32)[0]


def mixtures(h: np.ndarray, owner: np.ndarray, ids: np.ndarray, counts: np.ndarray, docs: int, inner: int = INNER) -> tuple[np.ndarray, np.ndarray]:
    """Documents' mixtures (components, documents) for components h (components, terms), and each entry's responsibilities times its count
    (components, entries). Some documents at a time, so that they stay in the cache."""
    k = len(h)
    first = np.searchsorted(owner, np.arange(docs + 1))
    mixture, shares = np.full((k, docs), np.float32(1.0 / k)), np.empty((k, len(ids)), np.float32)
    for d in range(0, docs, CACHED):
        a, b = int(first[d]), int(first[min(docs, d + CACHED)])
        n = np.diff(first[d : d + CACHED + 1])
        some = np.flatnonzero(n)
        if not len(some):
            continue
        part, c, n = np.take(h, ids[a:b], axis=1), counts[a:b], n[some]
        begins = np.cumsum(n) - n
        w = np.full((k, len(some)), np.float32(1.0 / k))
        for _ in range(inner):
            share = np.repeat(w, n, axis=1)
            share *= part
            share *= c / np.maximum(share.sum(0), 1e-30)
            w = np.add.reduceat(share, begins, axis=1) + np.float32(SMOOTH)
            w /= w.sum(0)
        mixture[:, d + some] = w
        shares[:, a:b] = share
    return mixture, shares


def summed(rows: DataFrame, tasks: int, add: Callable, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of ``add``'s arrays: one for each of at most ``tasks`` tasks, then added in a tree of FAN at a time, so that no
    task and not the driver holds more than FAN of them."""

    def run(parts):
        from pyspark import TaskContext

        total = np.zeros(shape, np.float32)
        work = add(total)
        for batch in parts:
            for i in range(0, batch.num_rows, STEP):
                work(*batch.slice(i, STEP).columns)
        yield pa.RecordBatch.from_pydict({"slot": pa.array([TaskContext.get().partitionId()], pa.int64()), "sums": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(shape, np.float32)
        for x in frame["sums"]:
            total += np.frombuffer(zlib.decompress(x), np.float32).reshape(shape)
        return pd.DataFrame({"slot": [int(frame["slot"].iloc[0]) // FAN], "sums": [zlib.compress(total.tobytes(), 1)]})

    sums, left = rows.mapInArrow(run, "slot bigint, sums binary"), tasks
    while left > FAN:
        sums = sums.groupBy((F.col("slot") / FAN).cast("bigint").alias("_group")).applyInPandas(lambda f: merge(f), "slot bigint, sums binary")
        left = -(-left // FAN)
    total = np.zeros(shape, np.float32)
    for r in sums.collect():
        total += np.frombuffer(zlib.decompress(bytes(r["sums"])), np.float32).reshape(shape)
    return total


def seeds(labelled: np.ndarray, overall: np.ndarray, described: np.ndarray) -> np.ndarray:
    """First components from labelled sums (subjects, terms), the corpus's sums and the descriptions: what is more frequent under a label
    than overall anchors it; common wording goes to the components of the two scripts."""
    k = len(labelled)
    b = overall + 0.01
    b = b / b.sum()
    h = np.zeros((k + 2, TERMS), np.float32)
    mass = labelled + SEED_WEIGHT * described
    for i in range(k):
        # shrink towards the corpus: a term seen once or twice says little
        p = (mass[i] + 2 * b * 50) / (mass[i].sum() + 100)
        lift = np.log(np.maximum(p / b, 1e-9))
        h[i] = p * np.clip(lift - 0.5, 0, 4) + 1e-4 * b
    h[k, :HALF], h[k + 1, HALF:] = b[:HALF], b[HALF:]
    return h / h.sum(1, keepdims=True)


def factor(terms: DataFrame, labels: DataFrame, subjects: list[tuple[int, str]], passes: int = PASSES) -> np.ndarray:
    """Components (subjects and two of common wording, terms) after alternating updates over the whole corpus."""
    k, place = len(subjects), {s: i for i, (s, _) in enumerate(subjects)}
    vocabulary = Vocabulary()
    described = np.zeros((k, TERMS), np.float32)
    flat, owner = vocabulary.terms([text for _, text in subjects])
    np.add.at(described, (owner, flat), 1)
    given = labels.where(F.col("subject_id").isin([s for s, _ in subjects])).groupBy("doc_id").agg(F.collect_set("subject_id").alias("given"))

    def add_labelled(total):
        def work(given, ids, counts):
            owner, at, n = entries(ids, counts)
            for d, g in enumerate(given.to_pylist()):
                mine = owner == d
                for s in g:
                    total[place[s]] += np.bincount(at[mine], n[mine] / len(g), TERMS)
        return work

    def add_all(total):
        def work(ids, counts):
            _, at, n = entries(ids, counts)
            total[0] += np.bincount(at, n, TERMS)
        return work

    tasks = terms.rdd.getNumPartitions()
    joined = max(tasks, int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    labelled = summed(terms.join(given, "doc_id").select("given", "ids", "counts"), joined, add_labelled, (k, TERMS))
    plain = terms.select("ids", "counts")
    overall = summed(plain, tasks, add_all, (1, TERMS))[0]
    h = seeds(labelled, overall, described)
    for _ in range(passes):

        def add(total, h=h.astype(np.float32)):
            def work(ids, counts):
                owner, at, n = entries(ids, counts)
                if len(at):
                    share = mixtures(h, owner, at, n, len(ids))[1]
                    for j in range(len(total)):
                        total[j] += np.bincount(at, share[j], TERMS)
            return work

        # components keep a part of their anchors, so that none drifts to another subject
        new = summed(plain, tasks, add, (k + 2, TERMS)) + 1e-6
        new /= new.sum(1, keepdims=True)
        h = np.where(h > 1e-9, new, 1e-9)
        h /= h.sum(1, keepdims=True)
    return h


def sentence_shares(h: np.ndarray, ids: pa.Array, counts: pa.Array, back: pa.Array, sizes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each row of the matrix its sentences, and how many of them each subject takes. A document's mixture weighs
    the components for each of its terms; a sentence goes to the subject with the most evidence in it."""
    k = len(h) - 2
    owner, at, n = entries(ids, counts)
    sizes_of, many = buffer(sizes, np.int32)
    taken = np.zeros((len(ids), k), np.int64)
    if not len(at):
        return many, taken
    w, _ = mixtures(h, owner, at, n, len(ids), LAST)
    part = np.take(h, at, axis=1)
    part *= w[:, owner]
    part /= np.maximum(part.sum(0), 1e-30)
    part = np.ascontiguousarray(part[:k].T)
    places, length = buffer(back, np.uint16)
    first = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(ids)))[:-1]))
    score = np.add.reduceat(part[places + np.repeat(first, length)], np.concatenate(([0], np.cumsum(sizes_of)[:-1])), axis=0)
    best = score.argmax(1)
    sure = score[np.arange(len(best)), best] >= EVIDENCE
    doc = np.repeat(np.arange(len(ids)), many)
    np.add.at(taken, (doc[sure], best[sure]), 1)
    return many, taken


def subject_shares(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """doc_id, subject_id, sentences of the document, sentences the subject takes, and its share, for each subject found in a document."""
    checkpoint_folder(documents.sparkSession)
    terms = matrix(documents).checkpoint()
    # a stated set of subjects: a few hundred at most
    named = sorted((r["subject_id"], f"{r['subject_name'] or ''} {r['description'] or ''}") for r in subjects.dropna(subset=["subject_id"]).distinct().collect())
    schema = "doc_id bigint, subject_id bigint, sentences bigint, taken bigint, share double"
    if not named:
        return documents.sparkSession.createDataFrame([], schema)
    h = factor(terms, labels, named).astype(np.float32)
    packed, shape = zlib.compress(h.tobytes(), 1), h.shape
    ids_of = np.array([s for s, _ in named], np.int64)

    def run(parts):
        components = np.frombuffer(zlib.decompress(packed), np.float32).reshape(shape)
        for batch in parts:
            for i in range(0, batch.num_rows, STEP):
                docs, *columns = batch.slice(i, STEP).columns
                many, taken = sentence_shares(components, *columns)
                d, j = np.nonzero(taken)
                values = taken[d, j]
                yield pa.RecordBatch.from_arrays(
                    [docs.take(pa.array(d)), pa.array(ids_of[j]), pa.array(many[d].astype(np.int64)), pa.array(values), pa.array(values / many[d])], ["doc_id", "subject_id", "sentences", "taken", "share"])

    return terms.mapInArrow(run, schema)


def p8_found(documents: DataFrame, labels: DataFrame, subjects: DataFrame, share: float = SHARE) -> DataFrame:
    """The subjects that take at least ``share`` of a document's sentences."""
    return subject_shares(documents, labels, subjects).where(F.col("share") >= share).select("doc_id", "subject_id").distinct()


def composition(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """For each subject: documents that deal with it and sentences it takes in the corpus."""
    found = subject_shares(documents, labels, subjects)
    sums = found.groupBy("subject_id").agg(F.count_if(F.col("share") >= SHARE).alias("documents"), F.sum("taken").alias("sentences"))
    return subjects.select("subject_id", "subject_name").join(sums, "subject_id", "left").select(
        "subject_id", "subject_name", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("sentences", F.lit(0)).alias("sentences"))
