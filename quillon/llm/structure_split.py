"""Items over a size limit cut into overlapping pieces along their structure.

A text is parsed into a tree: sections under headings, then paragraphs and list items, lines,
sentences, clauses, words. Sibling subtrees are merged bottom-up as long as they fit the limit together;
only nodes over the limit are descended into. A piece therefore ends at the highest boundary
that the limit allows, and inside a sentence only where the sentence alone is too large.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import NOT_SPACE, count_tokens

TOKENS_PER_WORD = 1.33
_HEADING = re.compile(
    r"(?:#{1,6}\s+\S.*|(?i:unidade|unidad|unit|unité|einheit|parte|part|teil|partie|cap[íi]tulo|chapter|chapitre|kapitel|se[çc][ãa]o|secci[óo]n|section|abschnitt)\s+[\dIVXLC]+\b.*|\d+(?:\.\d+)+\.?\s+\S.*)$"
)
_LIST_ITEM = re.compile(r"\s*(?:[-*•–]|\d+[.)]|[a-z]\))\s+")
_SENTENCE_END = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+(?=[\"'“‘«(\[¿¡—–]*[^\W_a-zß-öø-ÿ])")
_BOUNDARY = {12: _SENTENCE_END, 13: re.compile(r"[;:.!?…]['\"”’»)\]]*\s+"), 14: re.compile(r"[,–—)]\s+")}


def tokens_of(words: int) -> int:
    """The project's estimate: words times 1.33, cut to an integer, at least 1."""
    return max(1, int(words * TOKENS_PER_WORD))


def words_within(tokens: int) -> int:
    """The most words whose estimate is at most ``tokens``, at least one."""
    n = max(1, int(tokens / TOKENS_PER_WORD) + 2)
    while n > 1 and tokens_of(n) > tokens:
        n -= 1
    return n


def words_for(tokens: int) -> int:
    """The fewest words whose estimate is at least ``tokens``."""
    if tokens <= 0:
        return 0
    n = max(1, int(tokens / TOKENS_PER_WORD) - 1)
    while tokens_of(n) < tokens:
        n += 1
    return n


def _cut(text: str, start: int, end: int, ends: list[int]) -> list[tuple[int, int]]:
    """The span cut at the given inner positions."""
    marks = [start, *[e for e in ends if start < e < end], end]
    return list(zip(marks, marks[1:]))


def _section_depth(line: str) -> int:
    """Depth of a heading, 0 where the line is none."""
    line = line.strip()
    if not line or len(line) > 120 or not _HEADING.match(line):
        return 0
    if line[0] == "#":
        return len(line) - len(line.lstrip("#"))
    if line[0].isdigit():
        return 3 + line.split()[0].rstrip(".").count(".")
    return 1 if re.match(r"(?i)uni|parte?\b|teil|partie|einheit", line) else 2


def _children(text: str, start: int, end: int, level: int) -> tuple[list[tuple[int, int]], int]:
    """Child spans of a node at the first finer level that has any, and that level.

    Levels: 1-8 sections by heading depth, 9 paragraphs, 10 list items, 11 lines, 12 sentences,
    13 and 14 clauses, 15 words.
    """
    while level < 15:
        level += 1
        if level <= 8:
            cuts, depth_of, at = [], [], start
            for line in text[start:end].split("\n"):
                if d := _section_depth(line):
                    cuts.append(at), depth_of.append(d)
                at += len(line) + 1
            spans = _cut(text, start, end, [c for c, d in zip(cuts, depth_of) if d == level])
        elif level == 9:
            spans = _cut(text, start, end, [m.end() for m in re.compile(r"\n[ \t\r]*\n\s*").finditer(text, start, end)])
        elif level in (10, 11):
            breaks = [m.end() for m in re.compile(r"\n").finditer(text, start, end)]
            spans = _cut(text, start, end, [b for b in breaks if level == 11 or _LIST_ITEM.match(text, b)])
        elif level in _BOUNDARY:
            spans = _cut(text, start, end, [m.end() for m in _BOUNDARY[level].finditer(text, start, end)])
        else:
            spans = _cut(text, start, end, [m.start() for m in re.compile(r"(?<=\s)\S").finditer(text, start, end)])
        if len(spans) > 1:
            return spans, level
    return [(start, end)], level


def split_spans(text: str, max_words: int, overlap_words: int) -> list[tuple[int, int, int]]:
    """(start, core start, end) of the pieces of a text; what lies before the core is the overlap.

    The cores follow each other without gaps over the whole text; a piece with its overlap has
    at most ``max_words`` words.
    """
    begins = [m.start() for m in re.finditer(r"\S+", text)]
    if len(begins) <= max_words:
        return [(0, 0, len(text))]
    overlap = min(overlap_words, max_words - 1)
    def words(start: int, end: int) -> int:
        return bisect_left(begins, end) - bisect_left(begins, start)

    def room(start: int) -> int:
        """Words that a core may have that begins here: at the beginning there is less to share, or nothing."""
        return max_words - min(overlap, bisect_left(begins, start))

    def pack(start: int, end: int, level: int) -> list[tuple[int, int]]:
        spans, level = _children(text, start, end, level)
        out: list[tuple[int, int]] = []
        open_run = False  # whether the last piece may take in the next sibling
        size = 0
        for s, e in spans:
            n = words(s, e)
            if n > room(s) and len(spans) > 1:
                finer = pack(s, e, level)
                # a heading, or a few words, go with what is behind them
                if open_run and size <= 20 and size + words(*finer[0]) <= room(out[-1][0]):
                    finer[0] = (out.pop()[0], finer[0][1])
                out += finer
                # the rest that is left at the end may take in the next sibling
                open_run, size = True, words(*finer[-1])
            elif open_run and size + n <= room(out[-1][0]):
                out[-1] = (out[-1][0], e)
                size += n
            else:
                out.append((s, e))
                open_run, size = True, n
        return out

    cores = pack(0, len(text), 0)
    pieces = []
    for k, (s, e) in enumerate(cores):
        back = bisect_left(begins, s) - overlap
        pieces.append((s if k == 0 or not overlap else begins[max(0, back)], s, e))
    return pieces


def split_oversized(
    items: DataFrame, item_id: str = "chunk_id", text: str = "text", limit: str = "max_tokens", overlap: str = "overlap_tokens"
) -> DataFrame:
    """The pieces of every distinct item, in order.

    Columns: the id, ``piece_no`` from 0, ``n_pieces``, ``item_tokens``, ``max_tokens``,
    ``piece_tokens``, ``shared_tokens`` (of the words a piece shares with the one before it),
    ``start`` and ``stop`` (characters), ``piece`` and ``oversized``. An item within its limit, or with a null
    limit, is one piece, its text unchanged, and never leaves the JVM. Null, empty and blank
    texts and null ids have no pieces; an overlap not below the limit is cut to what leaves room
    for one new word; repeated rows count once.
    """
    rows = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(item_id, F.col(text).alias("piece"), F.col(limit).cast("int").alias("lim"), F.col(overlap).cast("int").alias("ovl"))
    # pieces are told apart by the item they come from, not by their places in it alone
    rows = rows.withColumns({"item": F.xxhash64(F.col("piece"), F.coalesce("lim", F.lit(-(1 << 31))), F.coalesce("ovl", F.lit(0))), "size": count_tokens(F.col("piece"))}).where(F.col("piece").rlike(NOT_SPACE))
    # so many words need so many characters, which is known without looking for the words
    long = F.char_length("piece") >= 2 * F.floor((F.col("lim") + 1) / TOKENS_PER_WORD) - 1
    over = F.coalesce(long & (F.col("size") > F.col("lim")), F.lit(False))
    number = lambda x, name: F.lit(x).alias(name)
    whole = rows.where(~over).select(
        item_id, number(0, "piece_no"), number(1, "n_pieces"), F.col("size").alias("item_tokens"), F.col("lim").alias("max_tokens"), F.col("size").alias("piece_tokens"),
        number(0, "shared_tokens"), number(0, "start"), F.char_length("piece").alias("stop"), "piece", "item", F.lit(False).alias("oversized"),
    )
    kind = rows.schema[item_id].dataType.simpleString()
    names = ["piece_no", "n_pieces", "item_tokens", "max_tokens", "piece_tokens", "shared_tokens", "start", "stop", "piece", "item"]
    schema = f"`{item_id}` {kind}, " + ", ".join(f"{n} {'string' if n == 'piece' else 'bigint' if n == 'item' else 'int'}" for n in names)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            out: list[list] = [[] for _ in names[:-1]]
            for i, (t, lim, ovl, size) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 5)))):
                spans = split_spans(t, words_within(lim), words_for(ovl or 0))
                for k, (s, core, e) in enumerate(spans):
                    at.append(i)
                    row = [k, len(spans), size, lim, size if len(spans) == 1 else tokens_of(len(t[s:e].split())), 0 if core == s else tokens_of(len(t[s:core].split())), s, e, t[s:e]]
                    for column, value in zip(out, row):
                        column.append(value)
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(where)] + [pa.array(c, pa.string() if n == "piece" else pa.int32()) for n, c in zip(names, out)] + [batch.column(4).take(where)], names=[item_id, *names]
            )

    cut = rows.where(over).select(item_id, "piece", "lim", "ovl", "item", "size").mapInArrow(pieces, schema)
    # told by the branch, so that a query of either kind of items reads the table once
    return whole.unionByName(cut.withColumn("oversized", F.lit(True))).dropDuplicates([item_id, "item", "piece_no", "oversized"]).drop("item")
