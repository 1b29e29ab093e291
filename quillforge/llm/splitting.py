"""Splitting oversized texts at natural boundaries (problem 3).

Method: structure-tree packing. A text is parsed into a tree: a node's children are parted by its strongest inner boundaries (headings,
blank lines, lines with their list or table marks, sentences, clauses, words), and a heading belongs to what follows it. Only nodes over the
room of a piece are descended into; their subtrees' pieces are merged bottom-up with their siblings' as long as they stay within the room.
A scrap at the end of a node takes whole units from the piece before it. Consecutive pieces share ``overlap`` tokens; the first has none to share and may fill the limit.

A token is a longest run of characters without Unicode white space. Pieces keep the source's characters: piece n without its first
``overlap_chars`` characters, appended to the pieces before it, gives the source back.

Defined results: null and blank texts, and texts within the limit, stay one piece, unchanged. A token longer than any limit is never cut.
Repeated rows are split alike; rows are told apart by ``order_idx``. An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.llm.chars import map_rows

LIMIT, OVERLAP = 1_280, 64
SPACE = "\t-\r \x85\xa0  -     　"
TOKEN = re.compile(f"[^{SPACE}]+")
LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
#: Marks at the start of a line: headings, list items with their indent, table rows.
HEADING = re.compile(r"#{1,6}$|=+$|-{3,}$|<h[1-6]>|(?:Chapter|Section|Part|Article)$|제\d+[장절조]")
ITEM = re.compile(r"[-*•·▪◦–]$|\(?\d{1,3}[.)]$|\(?[a-zA-Z][.)]$|[ivxIVX]{1,4}[.)]$")
SENTENCE_END = re.compile(r"[.!?。！？…][\"'”’»)\]]*$")
NOT_END = re.compile(r"^(?:[A-Z]\.|(?:Mr|Mrs|Ms|Dr|Prof|Inc|Corp|Ltd|Co|No|vs|etc|approx|e\.g|i\.e|U\.S|St|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)\.)$", re.I)
CLAUSE_END = re.compile(r"[;:,、，；：—–][\"'”’»)\]]*$")
#: Levels of boundaries, strongest first; the last ties a heading to what follows it.
SECTION, BLOCK, ITEMS, LINES, SENTENCES, CLAUSES, WORDS, TIED = range(8)


def parse(text: str) -> tuple[list[int], list[int]]:
    """Start of each token, and the level of the boundary before it."""
    starts, levels = [], []
    before, indent_of, heads = None, 0, False
    for m in TOKEN.finditer(text):
        if before is None:
            level, heads = SECTION, bool(HEADING.match(m.group()))
        else:
            gap = text[before.end() : m.start()]
            breaks = len(LINE.findall(gap))
            last = before.group()
            if breaks and heads and not HEADING.match(m.group()):
                level, heads = TIED, False
            elif breaks >= 2:
                line_end = LINE.search(text, m.start())
                line = text[m.start() : line_end.start() if line_end else len(text)]
                after = LINE.findall(re.match(f"[{SPACE}]*", text[m.start() + len(line) :]).group()) if line_end else []
                # a short line between blank lines, without a closing mark, heads what follows
                heads = bool(HEADING.match(m.group())) or (len(after) >= 2 and len(line) <= 120 and not SENTENCE_END.search(line.rstrip()) and not ITEM.match(m.group()))
                level = SECTION if heads else BLOCK
            elif breaks == 1:
                heads = bool(HEADING.match(m.group()))
                if heads:
                    level = SECTION
                else:
                    indent = len(gap) - max(gap.rfind("\n"), gap.rfind("\r")) - 1
                    item = ITEM.match(m.group()) or m.group().startswith("|")
                    # a deeper item belongs to the item above it
                    level = (ITEMS if indent <= indent_of else LINES) if item else LINES
                    if item:
                        indent_of = min(indent, indent_of) if indent <= indent_of else indent_of
            elif SENTENCE_END.search(last) and not NOT_END.match(last):
                level = SENTENCES
            elif CLAUSE_END.search(last) or last == "|":
                level = CLAUSES
            else:
                level = WORDS
        starts.append(m.start())
        levels.append(level)
        before = m
    return starts, levels


@dataclass
class Node:
    """Tokens a to b of a text, as a subtree of its structure."""

    a: int
    b: int

    def level(self, levels: list[int]) -> int:
        """The strongest boundary inside."""
        return min(levels[self.a + 1 : self.b], default=TIED)

    def children(self, levels: list[int]) -> list[Node]:
        strongest = self.level(levels)
        cuts = [self.a, *(i for i in range(self.a + 1, self.b) if levels[i] == strongest), self.b]
        return [Node(x, y) for x, y in zip(cuts, cuts[1:])]


def pack(levels: list[int], node: Node, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces of a node as ranges of tokens. A piece that begins the text may have ``limit`` tokens, any other ``limit`` less the overlap."""

    def room(a: int) -> int:
        return limit - min(overlap, a)

    if node.b - node.a <= room(node.a):
        return [(node.a, node.b)]
    parts: list[tuple[int, int]] = []
    if node.level(levels) >= WORDS:
        a = node.a
        while a < node.b:
            b = min(node.b, a + room(a))
            # a heading is parted from its text only where it fills the room
            while a + 1 < b < node.b and levels[b] == TIED:
                b -= 1
            parts.append((a, b if b > a + 1 or room(a) == 1 else min(node.b, a + room(a))))
            a = parts[-1][1]
        return parts
    for child in node.children(levels):
        for a, b in pack(levels, child, limit, overlap):
            if parts and b - parts[-1][0] <= room(parts[-1][0]):
                parts[-1] = (parts[-1][0], b)
            else:
                parts.append((a, b))
    return [*levelled(levels, parts, limit - overlap)]


def levelled(levels: list[int], parts: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """Pieces whose scraps, under an eighth of the room, take whole units from the piece before them."""
    out = parts[:1]
    for a, b in parts[1:]:
        x = out[-1][0]
        if b - a < room // 8:
            among = [i for i in range(max(x + 1, b - room), a) if min(i - x, b - i) >= (b - x) // 4 and levels[i] <= SENTENCES]
            if among:
                cut = min(among, key=lambda i: (levels[i], abs(2 * i - x - b)))
                out[-1], a = (x, cut), cut
        out.append((a, b))
    return out


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[str, int, int, int]]:
    """Pieces as (text, tokens, shared tokens at its start, shared characters at its start)."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    starts, levels = parse(text)
    if len(starts) <= limit:
        return [(text, len(starts), 0, 0)]
    out = []
    for a, b in pack(levels, Node(0, len(starts)), limit, overlap):
        shared = min(overlap, a)
        begin = starts[a - shared] if a else 0
        own = starts[a] if a else 0
        end = starts[b] if b < len(starts) else len(text)
        out.append((text[begin:end], b - a + shared, shared, own - begin))
    return out


PIECES = "order_idx bigint, id string, corpus string, piece_no bigint, pieces bigint, piece string, piece_tokens bigint, overlap_tokens bigint, overlap_chars bigint"


def pieces_of(cycle: DataFrame, limit: int, overlap: int, whole: bool) -> DataFrame:
    """The pieces of the rows over the limit, with ``whole`` also the other rows as they are. One scan."""

    def make():
        def work(orders, ids, corpora, texts):
            out = {c.split()[0]: [] for c in PIECES.split(", ")}
            for o, i, c, t in zip(orders, ids, corpora, texts):
                # more than limit tokens need at least limit + 1 characters and limit characters of space between them
                parts = split(t, limit, overlap) if len(t or "") > 2 * limit else [(t, None if t is None else len(TOKEN.findall(t)), 0, 0)]
                if whole or len(parts) > 1:
                    for n, p in enumerate(parts, 1):
                        for k, v in zip(out, (o, i, c, n, len(parts), *p)):
                            out[k].append(v)
            return out

        return work

    return map_rows(cycle.select("order_idx", "id", "corpus", "source"), make, PIECES, text=3)


def split_large(cycle: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of the rows over the limit. Rows too short in characters to exceed it never reach Python."""
    return pieces_of(cycle.where(F.length("source") > 2 * limit), limit, overlap, False)


def split_pool(cycle: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Every row of the pool once, rows over the limit replaced by their pieces."""
    return pieces_of(cycle, limit, overlap, True)


def p3_found(cycle: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The rows that were cut into pieces."""
    return split_large(cycle, limit, overlap).where("piece_no = 1").select("order_idx").distinct()


def piece_report(cycle: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """For each corpus: rows cut, their pieces, and tokens in and out."""
    p = split_large(cycle, limit, overlap)
    return p.groupBy("corpus").agg(
        F.count_if(F.col("piece_no") == 1).alias("rows_cut"), F.count("*").alias("pieces"), F.max("piece_tokens").alias("most_tokens"),
        F.sum(F.col("piece_tokens") - F.col("overlap_tokens")).alias("source_tokens"), F.sum("piece_tokens").alias("piece_tokens"))
