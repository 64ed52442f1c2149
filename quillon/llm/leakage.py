"""Evaluation passages that stand, whole or in part, in a corpus.

One Aho-Corasick automaton holds the normalised seeds of all passages, questions and answers:
their blocks of words that lie end to end. Twice a block's length less one consecutive words
of a passage always hold a whole block, so no shared run of ``min_words`` goes unseen. Each
text is normalised once and scanned once; a hit is extended word by word to the longest common
run, and its offsets are mapped back to the original text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import textarrays as ta

MIN_WORDS = 12
#: Characters of evaluation text that one automaton takes; more text is scanned for in further passes.
AUTOMATON_CHARS = 16_000_000


class Words:
    """Normalised words of a list of texts: accents and case folded, runs of letters and digits."""

    def __init__(self, texts: list[str]):
        original = ta.codes_of(texts)
        folded = ta.map_codes(ta.fold_table(), original)
        kept = np.flatnonzero(folded != 0)
        codes = folded[kept]
        part = ta.look(ta.flags("isalnum"), codes)
        # of what is between words one character stays, as a space
        gap = ~part
        gap[1:] &= part[:-1]
        take = np.flatnonzero(part | gap)
        self._kept = kept[take]
        shown = np.where(part[take], codes[take], np.uint32(32))
        # a space before the first word as well
        self.text = " " + shown.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") + " "
        edge = np.diff(part[take].view(np.int8), prepend=0, append=0)
        self.start, self.stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        lengths = self.stop - self.start
        solid = codes[part]
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1])) if lengths.size else np.empty(0, dtype=np.int64)
        self.prints = ta.fingerprints(ta.noise(solid), begin, lengths)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        self._begins = np.concatenate(([0], ends[:-1]))
        self.owner = np.searchsorted(ends, self._kept[self.start], side="right") if lengths.size else begin

    def word(self, word: int) -> str:
        return self.text[self.start[word] + 1 : self.stop[word] + 1]

    def offsets(self, first: int, last: int) -> tuple[int, int]:
        """Characters of the original text from the first word to the end of the last."""
        base = self._begins[self.owner[first]]
        return int(self._kept[self.start[first]] - base), int(self._kept[self.stop[last] - 1] + 1 - base)


class Leaks:
    """The automaton over a list of (item, field, passage)."""

    def __init__(self, passages: list[tuple[str, str, str]], min_words: int = MIN_WORDS):
        self._passages, self._min = passages, min_words
        block = (min_words + 1) // 2
        words = Words([p for _, _, p in passages])
        counts = np.bincount(words.owner, minlength=len(passages)) if words.owner.size else np.zeros(len(passages), dtype=np.int64)
        self._prints = np.split(words.prints, np.cumsum(counts)[:-1]) if passages else []
        seeds: dict[str, list[tuple[int, int]]] = defaultdict(list)
        first = 0
        for p, n in enumerate(counts):
            if n >= min_words:
                for at in range(0, n - block + 1, block):
                    seeds[" " + " ".join(words.word(first + at + j) for j in range(block)) + " "].append((p, at))
            first += n
        self._block = block
        self._automaton = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self._automaton.add_word(seed, places)
        self._automaton.make_automaton()
        self._any = bool(seeds)

    def scan(self, texts: list[str]) -> Iterator[tuple[int, str, str, int, int, int]]:
        """(text index, item, field, words in common, start, stop) for the longest run of each pair."""
        if not self._any:
            return
        words = Words(texts)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for end, places in self._automaton.iter(words.text):
            # the hit ends with the space behind its last word
            last = int(np.searchsorted(words.stop, end - 1, side="right")) - 1
            first = last - self._block + 1
            owner = words.owner[first]
            if first < 0 or words.owner[last] != owner:
                continue
            low, high = np.searchsorted(words.owner, owner, side="left"), np.searchsorted(words.owner, owner, side="right")
            for p, at in places:
                own = self._prints[p]
                a, b = first, at
                while a > low and b > 0 and words.prints[a - 1] == own[b - 1]:
                    a, b = a - 1, b - 1
                c, d = last + 1, at + self._block
                while c < high and d < own.size and words.prints[c] == own[d]:
                    c, d = c + 1, d + 1
                if c - a >= self._min and c - a > best.get((owner, p), (0, 0))[0]:
                    best[owner, p] = (c - a, a)
        for (owner, p), (n, a) in best.items():
            yield int(owner), self._passages[p][0], self._passages[p][1], n, *words.offsets(a, a + n - 1)


def evaluation_passages(items: DataFrame, fields: tuple[str, ...], item_id: str = "item_id") -> Iterator[list[tuple[str, str, str]]]:
    """(item, field, text) of the given fields, in parts that one automaton holds each.

    Array fields give a passage for each element; nulls are left out.
    """
    part, chars = [], 0
    columns = [F.when(F.lit(True), F.col(f)).alias(f) if items.schema[f].dataType.typeName() == "array" else F.array(f).alias(f) for f in fields]
    for row in items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("id"), *columns).toLocalIterator():
        for f in fields:
            for text in row[f] or ():
                if text:
                    part.append((row.id, f, text))
                    chars += len(text)
        if chars >= AUTOMATON_CHARS:
            yield part
            part, chars = [], 0
    yield part


def leaked_passages(
    docs: DataFrame, items: DataFrame, fields: tuple[str, ...] = ("relevant_texts",), min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id"
) -> DataFrame:
    """(item_id, field, doc_id, words, start, stop) of the longest run that a document shares.

    ``words`` consecutive words, at least ``min_words``, of the item's field stand in the
    characters from ``start`` to ``stop`` of the document. Null texts, ids and passages give no
    rows, passages of fewer words cannot leak; items that share a passage are all reported and
    a repeated row counts once. No items, no rows.
    """
    picked = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"item_id string, field string, doc_id {picked.schema['doc_id'].dataType.simpleString()}, words int, start int, stop int"
    out = None
    for part in evaluation_passages(items, fields, item_id):

        def rows(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            leaks = Leaks(part, min_words)
            for batch in batches:
                found = [(first + i, *rest) for first, texts in ta.blocks(batch.column(1)) for i, *rest in leaks.scan([t or "" for t in texts])]
                at, item, field, words, start, stop = zip(*found) if found else [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item, pa.string()), pa.array(field, pa.string()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(words, pa.int32()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())],
                    names=["item_id", "field", "doc_id", "words", "start", "stop"],
                )

        scanned = picked.mapInArrow(rows, schema)
        out = scanned if out is None else out.unionByName(scanned)
    best = F.max(F.struct("words", -F.col("start"), -F.col("stop"))).alias("best")
    return out.groupBy("item_id", "field", "doc_id").agg(best).select("item_id", "field", "doc_id", F.col("best.words").alias("words"), (-F.col("best.col2")).alias("start"), (-F.col("best.col3")).alias("stop"))
