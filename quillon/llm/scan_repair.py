"""Text of scanned pages repaired into continuous paragraphs.

Running headers are found by fuzzy repetition of lines at page edges within a source: a title
is keyed by each half of its words, so one misread character leaves the other half equal, and
an edit distance decides. Page numbers are lines whose distance to the sheet's position is the
one that most pages of the source have. Lines that end in a hyphen are joined by the corpus
vocabulary: the joined word against the word with its hyphen. Misread words are rare words
that turn into frequent ones by undoing usual confusions of character recognition.

Everything that looks beyond a page is an aggregate or an equi-join (on source and title half,
source and page, or word), so no source is ever gathered in one task.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.runtime import materialize

HYPHENS = "-‐\xad¬"
_ENDS = ".!?…:"
_DECORATION = r"[\s\-–—•·*\[\]()|/~=<>]*"
_PAGE_NUMBER = re.compile(rf"{_DECORATION}(?:(?i:p[áa]ginas?|p[áa]gs?|pages?|pp?|seite|s|folha|hoja|fls?|f)\b\.?\s*)?(\d{{1,5}}|[ivxlc]+)(?:\s*(?:/|de|of|von|sur)\s*\d+)?{_DECORATION}")
_FIRST_NUMBER = re.compile(r"^(?:\d+|[ivxlc]+)(?:\s{2,}|\s*[|•·–—-]\s+)")
_LAST_NUMBER = re.compile(r"(?:\s{2,}|\s*[|•·]\s*)(?:\d+|[ivxlc]+)$")
_CHAPTER = re.compile(r"\W*(?:\d+\s+)?\S{4,12}\s+(?:\d+|[IVXLC]+)\s*[–—:.-]\s+\S")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_LETTER_IN_NUMBER = re.compile(r"(?=(?:.*\d){2})[\dlIOoSBgZ]*[lIOoSBgZ][\dlIOoSBgZ]*")
_OPENING, _CLOSING = "\"“”„«»‘’'([{¿¡–—-", "\"“”«»‘’')]}.,;:…?–—"
#: What is printed and what character recognition takes it for.
CONFUSIONS = {
    "e": "c", "c": "e", "t": "f", "f": "t", "n": "ri", "m": "rn", "d": "cl", "u": "ii", "v": "y", "ã": "á", "ç": "c", "ti": "ü", "h": "li", "ri": "n", "rn": "m", "cl": "d",
    "l": "i", "i": "l", "b": "h", "w": "vv", "é": "e", "ó": "o", "á": "a", "í": "i", "ê": "e", "ô": "o", "g": "q", "q": "g", "in": "m", "o": "c",
}
#: Letters that signs and digits are read for.
SIGNS = {"0": "od", "1": "litf", "!": "lit", "|": "lit", "@": "a", "5": "s", "6": "béó", "9": "gq", "8": "b", "$": "s", "3": "e", "4": "a", "7": "t", "2": "z", "&": "e"}
#: A word is taken as misread for one so many times as frequent, if it stands at most so often
#: as misreading explains: a few times, and this share of the other word's count.
RATIO, FEW, SHARE = 8, 3, 0.02
#: A word of so many characters or more may have a letter confused besides its signs; so many signs at most are undone.
MIXED, MOST_SIGNS = 5, 5
#: Share of a source's pages with a repeated title at an edge from which it has running titles.
RUNNING = 0.45
#: Pages at whose edges a title stands from which it is a running one, whatever the share, if no more lines of it stand inside.
MANY = 4

_EDGE = "page_id {id}, source string, page int, line_no int, pos string, norm string, half int, key string, value int, roman boolean, capitals boolean"


def _plain(text: str) -> str:
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def _roman(text: str) -> int:
    total = 0
    for c, after in itertools.zip_longest(text, text[1:]):
        total += -_ROMAN[c] if after and _ROMAN[c] < _ROMAN[after] else _ROMAN[c]
    return total


def page_number(line: str) -> tuple[int, bool] | None:
    """(number, is roman) of a line that holds nothing but a number in some decoration."""
    m = _PAGE_NUMBER.fullmatch(line)
    if not m:
        return None
    return (int(m[1]), False) if m[1].isdigit() else (_roman(m[1]), True)


def without_number(line: str) -> str:
    """A title line without the page number that stands apart at an end."""
    return _LAST_NUMBER.sub("", _FIRST_NUMBER.sub("", line.strip())).strip()


def title_norm(line: str) -> str:
    """Words of a title line without accents, case, decoration and the page number at an end."""
    words = [w for w in (t.strip("–—-•*[](){}.,:;") for t in _plain(without_number(line)).split()) if w]
    # a bar between words may be a misread letter, one at an end is decoration
    return " ".join(words).strip(" |")


def in_capitals(line: str) -> bool:
    """Whether most letters are capitals; single ones may be misread."""
    return sum(map(str.isupper, line)) > sum(map(str.islower, line))


def _halves(norm: str) -> list[tuple[int, str]]:
    words = norm.split()
    if len(words) < 2:
        return []
    middle = (len(words) + 1) // 2
    return [(0, " ".join(words[:middle])), (1, " ".join(words[middle:]))]


def distance(a: str, b: str, most: int) -> int:
    """Edit distance, or ``most`` + 1 where it is larger; a column of the table is two numbers' bits."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    start, least = 0, min(len(a), len(b))
    while start < least and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b):
        same = places.get(c, 0)
        steep = same | down
        flat = (((same & up) + up) ^ up) | same
        rise, fall = down | full & ~(flat | up), up & flat
        score += (rise & last > 0) - (fall & last > 0)
        # the rest can lower it by one a character at most
        if score - left > most:
            return most + 1
        rise, fall = rise << 1 | 1, fall << 1
        up, down = full & (fall | ~(steep | rise)), rise & steep & full
    return min(score, most + 1)


def _alike(a: str, b: str | None) -> bool:
    return bool(b) and distance(a, b, most := 1 + len(b) // 40) <= most


def _edge_lines(lines: list[str]) -> list[tuple[int, str]]:
    """(line, position) of the lines that may be furniture, and of those that stand alone inside."""
    solid = [i for i, line in enumerate(lines) if line.strip()]
    out = {i: f"T{k}" for k, i in enumerate(solid[:2])}
    for k, i in enumerate(reversed(solid[-2:])):
        out.setdefault(i, f"B{k}")
    for i in solid[2:-2] if len(solid) > 4 else ():
        alone = not lines[i - 1].strip() or not lines[i + 1].strip() or lines[i + 1].startswith("  ")
        if alone and len(lines[i]) <= 90 and lines[i].rstrip()[-1] not in ".,;!?…-‐\xad¬":
            out[i] = "I"
    return sorted(out.items())


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at: list[int] = []
        rows: list[tuple] = []
        sources, pages = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for r, text in enumerate(batch.column(3).to_pylist()):
            lines = text.split("\n")
            for i, pos in _edge_lines(lines):
                number = page_number(lines[i])
                norm = title_norm(lines[i])
                for half, key in [(-1, "")] if number else _halves(norm):
                    at.append(r)
                    rows.append((sources[r], pages[r], i, pos, norm, half, key, *(number or (None, None)), in_capitals(lines[i])))
        columns = list(zip(*rows)) if rows else [()] * 10
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at, pa.int64()))] + [pa.array(c, k) for c, k in zip(columns, kinds)],
            names=["page_id", "source", "page", "line_no", "pos", "norm", "half", "key", "value", "roman", "capitals"],
        )


def latest_pages(pages: DataFrame) -> DataFrame:
    """One row for each page id, of rescans the latest; null ids and null texts are left out.

    A null source is a source of its own for each page.
    """
    kept = pages.where("page_id IS NOT NULL AND text IS NOT NULL").select(
        "page_id",
        F.coalesce("source", F.concat(F.lit("\u0000"), F.col("page_id").cast("string"))).alias("source"),
        F.col("page").cast("int").alias("page"),
        "text",
        "book_title",
        "scanned_at",
    )
    newest = F.max_by(F.struct("source", "page", "text", "book_title"), F.struct("scanned_at", "text")).alias("p")
    return kept.groupBy("page_id").agg(newest).select("page_id", "p.*")


def _furniture(lines: list[str], book: str | None, page: int | None, hits: list, style: dict) -> dict[int, str]:
    """Kind of every line of a page that is furniture.

    ``hits``: (line, title as most often printed, whether it is on many pages and in
    capitals there) by half title;
    ``style``: what the source's page numbers are like, and whether its running titles stand at
    the bottom (null: it has none). The book's title and titles on many pages are headers on
    either side; a chapter's heading is one only where the running titles stand.
    """
    solid = [i for i, line in enumerate(lines) if line.strip()]
    if not solid:
        return {}
    title = title_norm(book) if book else None
    found: dict[int, list] = {}
    for h in hits:
        found.setdefault(h["line_no"], []).append(h)

    def is_number(i: int) -> bool:
        parsed = page_number(lines[i])
        if parsed is None:
            return False
        value, roman = parsed
        if page is None:
            low, high = style.get("low"), style.get("high")
            return roman or (low is not None and low - 40 <= value <= high + 40)
        if style.get("best") is not None and style["votes"] >= 2 and not roman:
            return value - page == style["best"]
        return roman or (value < 1000 and 0 <= value - page <= 40)

    def is_header(i: int, bottom: bool) -> bool:
        bare = without_number(lines[i])
        norm = title_norm(lines[i])
        # no title looks like a piece of a sentence; a small l may stand for any capital
        if len(norm.split()) < 2 or len(bare) > 100 or re.search(r"[,.;:?] ", bare) or re.match(r"[^\W\dA-ZÀ-ÖØ-Þl_]", bare.lstrip("(“\"'¿¡«–— ")):
            return False
        if title and _alike(norm, title):
            return True
        alike = [h for h in found.get(i, ()) if _alike(norm, h["title"])]
        if bottom != style.get("bottom"):
            # a chapter's own heading, at the edge by chance, is told from its running title by the letters
            return any(h["many"] and h["large"] == in_capitals(bare) for h in alike) and (in_capitals(bare) or not _CHAPTER.match(bare))
        return bool(alike) or _CHAPTER.match(bare) is not None

    kinds: dict[int, str] = {}
    for edge, bottom in ((solid, False), (solid[::-1], True)):
        for k, i in enumerate(edge[:2]):
            if i in kinds:
                continue
            if is_number(i) and "pagenum" not in (kinds.get(j) for j in edge[:k]):
                kinds[i] = "pagenum"
            elif is_header(i, bottom) and "header" not in (kinds.get(j) for j in edge[:k]):
                kinds[i] = "header"
            else:
                break
    return kinds


def misread_number(word: str) -> bool:
    """Whether a number, a range of numbers, or one of these before an exclamation mark, has a letter for a digit."""
    sides = re.split("[-–—]", word.removesuffix("!"))
    read = [_LETTER_IN_NUMBER.fullmatch(side) is not None for side in sides]
    return any(read) and all(r or side.isdecimal() for r, side in zip(read, sides))


def _words(line: str) -> list[str]:
    out = []
    for t in line.split():
        w = t.lstrip(_OPENING).rstrip(_CLOSING)
        if w:
            out.append(w)
    return out


@lru_cache(1 << 17)
def _token(t: str) -> tuple[str, str | None, bool] | None:
    """What stands between white space: the word without quotes and stops, the same lowered if it has letters, and whether it is a misread number."""
    w = t.lstrip(_OPENING).rstrip(_CLOSING)
    if not w:
        return None
    if w.isalpha():
        return w, w.lower(), False
    if w.isdecimal():
        return w, None, False
    if misread_number(w):
        return w, None, True
    return w, w.lower() if any(c.isalpha() for c in w) else None, False


_TOKENS = (
    "page_id {id}, source string, page int, kind string, line_no int, word string, next_word string, next_line int, capital boolean, n bigint, words array<string>, at array<int>"
)
#: Pages that a worker turns into rows at once.
_BLOCK_PAGES = 512


def _page_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a page by kind: furniture, line ends in a hyphen, first word, misread numbers, and one
    row with all words of the running text and their lines; a batch also has a row for each
    distinct word with its count."""
    for whole in batches:
        counts: Counter[str] = Counter()
        for first in range(0, whole.num_rows, _BLOCK_PAGES):
            batch = whole.slice(first, _BLOCK_PAGES)
            get = {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names)}
            rows: list[tuple] = []
            for r, text in enumerate(get["text"]):
                words, at = _one_page(rows, {k: v[r] for k, v in get.items()})
                counts.update(words)
                rows.append((get["page_id"][r], get["source"][r], get["page"][r], "words", None, None, None, None, None, None, words, at))
            yield _token_batch(rows, whole.schema.field("page_id").type)
        yield _token_batch([(None, None, None, "count", None, w, None, None, None, n, None, None) for w, n in counts.items()], whole.schema.field("page_id").type)


def _token_batch(rows: list[tuple], page_id: pa.DataType) -> pa.RecordBatch:
    kinds = [page_id, pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32())]
    names = ["page_id", "source", "page", "kind", "line_no", "word", "next_word", "next_line", "capital", "n", "words", "at"]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def _one_page(rows: list[tuple], p: dict) -> tuple[list[str], list[int]]:
    """Adds the rows of a page; returns the words of its running text, lowered, and their lines."""
    lines = p["text"].split("\n")
    kinds = _furniture(lines, p["book_title"] or p["book"], p["page"], p["hits"] or [], p)

    def add(kind: str, i: int, word: str | None = None, after: str | None = None, after_line: int | None = None, capital: bool = False) -> None:
        rows.append((p["page_id"], p["source"], p["page"], kind, i, word, after, after_line, capital, None, None, None))

    body = [i for i, line in enumerate(lines) if line.strip() and i not in kinds]
    for i, kind in kinds.items():
        add(kind, i)
    found: list[str] = []
    where: list[int] = []
    skip_first = False
    for k, i in enumerate(body):
        raw = lines[i].strip()
        words = [w for w in map(_token, raw.split()) if w]
        if k == 0 and words:
            add("first", i, words[0][0])
        # the letter before the hyphen may be misread itself, a number's range is no word
        broken = len(raw) > 1 and raw[-1] in HYPHENS and (raw[-2].isalnum() or raw[-2] in SIGNS) and any(c.isalpha() for c in raw.split()[-1])
        begin, stop = 1 if skip_first else 0, len(words)
        skip_first = False
        if broken:
            head = raw.split()[-1][:-1].lstrip(_OPENING)
            after = body[k + 1] if k + 1 < len(body) else None
            tail = _words(lines[after])[:1] if after is not None else []
            add(f"hyphen{raw[-1]}", i, head, tail[0] if tail else None, after, head[:1].isupper())
            # neither half is a word
            skip_first = bool(tail)
            if words and raw.split()[-1].lstrip(_OPENING).rstrip(_CLOSING + HYPHENS) == words[-1][0].rstrip(HYPHENS):
                stop -= 1
        for word, low, number in words[begin:stop] if begin or stop < len(words) else words:
            if number:
                add("number", i, word)
            elif low is not None:
                found.append(low)
                where.append(i)
    return found, where


def with_edges(pages: DataFrame) -> DataFrame:
    """The pages with what their source tells of titles and page numbers."""
    kind = pages.schema["page_id"].dataType.simpleString()
    edges = materialize(pages.select("page_id", "source", "page", "text").mapInArrow(_edges, _EDGE.format(id=kind)), "edges")
    # counted by spelling first, so that a hot title costs one row a task and spelling
    edge = F.col("pos") != "I"
    spelled = edges.where("half >= 0").groupBy("source", "half", "key", "norm").agg(F.count("*").alias("n"), F.count(F.when(edge, 1)).alias("n_edge"), F.count(F.when(edge & F.col("capitals"), 1)).alias("n_capitals"))
    # those at edges and inside are compared by one spelling: titles that share a half do not count for each other
    best = F.max_by(F.struct("norm", "n", "n_edge", "n_capitals"), F.struct("n", "norm")).alias("b")
    titles = spelled.groupBy("source", "half", "key").agg(F.sum("n").alias("lines"), best)
    titles = titles.select("source", "half", "key", "lines", F.col("b.norm").alias("title"), ((F.col("b.n_edge") >= MANY) & (2 * F.col("b.n_edge") >= F.col("b.n"))).alias("many"), (2 * F.col("b.n_capitals") > F.col("b.n_edge")).alias("large"))
    met = edges.where("half >= 0 AND pos <> 'I'").join(titles.where("lines >= 2"), ["source", "half", "key"]).select("source", "page_id", "pos", "line_no", "title", "many", "large")
    met = materialize(met, "titles")
    hits = met.groupBy("page_id").agg(F.collect_list(F.struct("line_no", "title", "many", "large")).alias("hits"))
    # running titles are on most pages and on one side; elsewhere a chapter's own heading is at the edge by chance
    sides = met.groupBy("source", "page_id").agg(F.max(F.col("pos").startswith("T").cast("int")).alias("t"), F.max(F.col("pos").startswith("B").cast("int")).alias("b"))
    sides = sides.groupBy("source").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
    sizes = pages.groupBy("source").agg(F.count("*").alias("n"))
    titled = F.greatest("t", "b") >= RUNNING * F.col("n")
    sides = sizes.join(sides, "source").select("source", F.when(titled, F.col("b") > F.col("t")).alias("bottom"))
    votes = edges.where("value IS NOT NULL AND page IS NOT NULL AND NOT roman").groupBy("source", (F.col("value") - F.col("page")).alias("off")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    numbers = votes.groupBy("source").agg(F.max_by(F.struct(F.col("off").alias("best"), F.col("n").cast("int").alias("votes"), "low", "high"), F.struct("n", -F.abs("off"))).alias("b")).select("source", "b.*")
    books = pages.where("book_title IS NOT NULL").groupBy("source", "book_title").agg(F.count("*").alias("n")).groupBy("source").agg(F.max_by("book_title", F.struct("n", "book_title")).alias("book"))
    return pages.join(hits, "page_id", "left").join(numbers, "source", "left").join(sides, "source", "left").join(books, "source", "left")


def _confused(word: str) -> Iterator[tuple[str, int]]:
    for printed, read in CONFUSIONS.items():
        at = word.find(read)
        while at >= 0:
            yield word[:at] + printed + word[at + len(read) :], at
            at = word.find(read, at + 1)


def _variants(word: str) -> Iterator[tuple[str, int]]:
    """(what may have been printed, first character that differs) for a word as read."""
    signs = [i for i, c in enumerate(word) if c in SIGNS]
    if signs and len(signs) <= MOST_SIGNS:
        for letters in itertools.product(*(SIGNS[word[i]] for i in signs)):
            chars = list(word)
            for i, c in zip(signs, letters):
                chars[i] = c
            yield "".join(chars), signs[0]
        if word[-1] == "!" and len(signs) > 1:
            yield from _variants(word[:-1])
    if not signs:
        yield from _confused(word)


def _mixed(word: str) -> Iterator[tuple[str, int]]:
    """Like ``_variants`` for a word with signs, of whose letters one is confused too."""
    signs = sum(c in SIGNS for c in word)
    if len(word) >= MIXED and 0 < signs <= 2:
        for plain, first in _variants(word):
            for printed, at in _confused(plain):
                yield printed, min(first, at)


def corrections(counts: DataFrame) -> DataFrame:
    """(word, printed, at) for the misread words of a vocabulary (word, n, capital).

    A word with a sign or digit among its letters needs a known word behind it, one of plain
    letters a word far more frequent, and so do words of two characters, which need a sign, and
    those with a letter confused besides a sign, which are tried last; an exclamation mark at the
    end counts as such where the rest is a word.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sign = any(c in SIGNS for c in w)
                if len(w) > 2 or len(w) == 2 and sign:
                    out += [(w, n, v, at, sign and len(w) > 2, False) for v, at in _variants(w) if v != w]
                    out += [(w, n, v, at, False, True) for v, at in _mixed(w) if v != w]
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.bool_()))], names=["word", "n", "printed", "at", "sign", "mixed"]
            )

    known = counts.select(F.col("word").alias("printed"), F.col("n").alias("m"))
    # a word becomes many rows, so it is spread by itself and neither side's size can be told before
    spread = counts.select("word", "n").repartition(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tried = spread.mapInArrow(rows, "word string, n bigint, printed string, at int, sign boolean, mixed boolean").hint("merge").join(known, "printed")
    likely = tried.where(F.when(F.col("sign"), (F.col("m") >= 2) & (F.col("m") > F.col("n"))).otherwise((F.col("m") >= 4) & (F.col("m") >= RATIO * F.col("n")) & (F.col("n") <= FEW + SHARE * F.col("m"))))
    best = likely.groupBy("word").agg(F.max_by(F.struct("printed", "at"), F.struct(~F.col("mixed"), "m", "printed")).alias("b")).select("word", "b.*")
    ended = counts.where(F.col("word").endswith("!")).select("word", F.expr("substring(word, 1, length(word) - 1)").alias("printed"))
    real = ended.join(known.where("m >= 2"), "printed").select("word")
    return best.join(real, "word", "left_anti")


class Repair:
    """Findings on all pages of a table of scans; the steps share the materialised page rows."""

    def __init__(self, pages: DataFrame):
        self.pages = materialize(latest_pages(pages), "pages")
        kind = self.pages.schema["page_id"].dataType.simpleString()
        rows = with_edges(self.pages).select("page_id", "source", "page", "text", "book_title", "book", "hits", "best", "votes", "low", "high", "bottom")
        self.rows = materialize(rows.mapInArrow(_page_rows, _TOKENS.format(id=kind)), "rows")
        # the words were counted in the tasks that read them
        counts = self.rows.where("kind = 'count'").groupBy("word").agg(F.sum("n").alias("n"))
        self.vocabulary = materialize(counts.unionByName(self._ended(counts)).groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
        self.breaks = materialize(self._breaks(), "breaks")
        # words cut in two are words like others
        joined = self.breaks.where("cut AND next_word IS NOT NULL").groupBy(F.lower(F.concat("head", "next_word")).alias("word")).agg(F.count("*").alias("n"))
        counted = self.vocabulary.unionByName(joined).groupBy("word").agg(F.sum("n").alias("n"))
        self.corrections = materialize(corrections(counted), "corrections")

    @staticmethod
    def _ended(counts: DataFrame) -> DataFrame:
        """Words before an exclamation mark count for the word itself too."""
        return counts.where(F.col("word").rlike(r"^[\p{L}-]+!$")).select(F.expr("substring(word, 1, length(word) - 1)").alias("word"), "n")

    def _breaks(self) -> DataFrame:
        """Line ends in a hyphen: page, line, both halves, and whether the line break alone cut the word."""
        ends = self.rows.where(F.col("kind").startswith("hyphen")).select(
            "page_id", "source", "page", "line_no", F.col("word").alias("head"), "next_word", "next_line", F.substring("kind", 7, 1).alias("mark"), "capital"
        )
        first = self.rows.where("kind = 'first' AND page IS NOT NULL").select("source", (F.col("page") - 1).alias("page"), F.col("word").alias("fw"), F.col("line_no").alias("fl"), F.col("page_id").alias("fp"))
        first = first.groupBy("source", "page").agg(F.min(F.struct("fp", "fl", "fw")).alias("f"))
        ends = ends.join(first, ["source", "page"], "left").select(
            "page_id", "source", "page", "line_no", "head", "mark", "capital",
            F.coalesce("next_word", "f.fw").alias("next_word"),
            F.when(F.col("next_word").isNull(), F.col("f.fp")).otherwise(F.col("page_id")).alias("next_page"),
            F.when(F.col("next_word").isNull(), F.col("f.fl")).otherwise(F.col("next_line")).alias("next_line"),
        )
        known = self.vocabulary
        clean = F.regexp_replace(F.lower("next_word"), "!+$", "")
        styles = ends.groupBy("source", "mark").agg(F.count("*").alias("n")).groupBy("source").agg(F.max_by("mark", F.struct("n", "mark")).alias("style"))
        parts = F.split("word", "-")
        stems = (
            known.where(F.col("word").rlike(r"\p{L}-\p{L}"))
            .select("n", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "-"))).alias("stem"))
            .groupBy("stem")
            .agg(F.sum("n").alias("n_stem"))
        )
        tried = (
            ends.withColumns({"whole": F.lower(F.concat("head", clean)), "compound": F.lower(F.concat("head", F.lit("-"), clean)), "stem": F.lower("head"), "tail": clean})
            .join(known.select(F.col("word").alias("whole"), F.col("n").alias("n_whole")), "whole", "left")
            .join(known.select(F.col("word").alias("compound"), F.col("n").alias("n_compound")), "compound", "left")
            .join(stems, "stem", "left")
            .join(styles, "source", "left")
        )
        n_whole, n_compound, n_stem = (F.coalesce(c, F.lit(0)) for c in ("n_whole", "n_compound", "n_stem"))
        # the compound also stands in the vocabulary where the next line's half is itself cut or misread
        cut = (
            F.when(n_whole > n_compound, True)
            .when(n_compound > 0, False)
            .when((n_stem > 0) & ((F.col("mark") != F.col("style")) | (n_whole == 0) & (n_stem >= 2)), False)
            .otherwise(True)
        )
        return tried.select("page_id", "line_no", "head", "next_word", "next_page", "next_line", "mark", "capital", cut.alias("cut"))

    def misread(self) -> DataFrame:
        """(page_id, line_no, word, printed): words and numbers of the running text read wrongly."""
        every = self.rows.where("kind = 'words'").select("page_id", F.explode(F.arrays_zip("words", "at")).alias("w")).select("page_id", F.col("w.at").alias("line_no"), F.col("w.words").alias("word"))
        plain = every.join(self.corrections, "word").select("page_id", "line_no", "word", "printed")
        numbers = self.rows.where("kind = 'number'").select("page_id", "line_no", "word", F.translate("word", "lIOoSBgZ", "11005892").alias("printed"))
        split = (
            self.breaks.where("cut AND next_word IS NOT NULL")
            .withColumn("word", F.lower(F.concat("head", "next_word")))
            .join(self.corrections, "word")
            .select(
                F.when(F.col("at") < F.length("head"), F.col("page_id")).otherwise(F.col("next_page")).alias("page_id"),
                F.when(F.col("at") < F.length("head"), F.col("line_no")).otherwise(F.col("next_line")).alias("line_no"),
                "word",
                "printed",
            )
        )
        return plain.unionByName(numbers).unionByName(split)

    def found(self) -> DataFrame:
        """(page_id, line_no, kind) with kind header, pagenum, hyphen or misread."""
        furniture = self.rows.where("kind IN ('header', 'pagenum')").select("page_id", "line_no", "kind")
        hyphens = self.breaks.where("cut").select("page_id", "line_no", F.lit("hyphen").alias("kind"))
        wrong = self.misread().select("page_id", "line_no", F.lit("misread").alias("kind"))
        return furniture.unionByName(hyphens).unionByName(wrong).distinct()

    def paragraphs(self) -> DataFrame:
        """(source, paragraph, first_page_id, text): the continuous paragraphs of every source.

        Paragraphs are numbered in page order; pages without a position come as sources of
        their own, named by source and page id in ``paragraph_of``.
        """
        furniture = self.rows.where("kind IN ('header', 'pagenum')").groupBy("page_id").agg(F.collect_set("line_no").alias("drop"))
        ends = self.breaks.groupBy("page_id").agg(F.collect_list(F.struct("line_no", "cut")).alias("ends"))
        fixes = self.misread().groupBy("page_id").agg(F.collect_set(F.struct("word", "printed")).alias("fixes"))
        full = self.pages.join(furniture, "page_id", "left").join(ends, "page_id", "left").join(fixes, "page_id", "left")
        kind = self.pages.schema["page_id"].dataType.simpleString()
        pieces = full.select("page_id", "source", "page", "text", "drop", "ends", "fixes").mapInArrow(
            _fragments, f"page_id {kind}, source string, page int, fragment int, text string, starts boolean, open boolean, glue string"
        )
        pieces = materialize(pieces, "fragments")
        # the last fragment of the page before tells whether the first of this one goes on
        last = pieces.where("page IS NOT NULL").groupBy("source", "page").agg(F.max_by(F.struct("open", "glue"), "fragment").alias("l"))
        before = last.select("source", (F.col("page") + 1).alias("page"), F.col("l.open").alias("was_open"))
        joined = pieces.join(before, ["source", "page"], "left")
        goes_on = (F.col("fragment") == 0) & ~F.col("starts") & F.coalesce("was_open", F.lit(False))
        unit = F.when(F.col("page").isNull(), F.concat_ws("#", "source", F.col("page_id").cast("string"))).otherwise(F.col("source"))
        marked = joined.select("page_id", "source", "page", "fragment", "text", "glue", unit.alias("paragraph_of"), F.when(goes_on, 0).otherwise(1).alias("begin"), F.expr("coalesce(page, 0) div 256").alias("stretch"))
        # running number of paragraph starts as prefix sums over stretches of pages, then within one
        total = marked.groupBy("paragraph_of", "stretch").agg(F.sum("begin").alias("begun"))
        along = Window.partitionBy("paragraph_of").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
        base = total.select("paragraph_of", "stretch", F.coalesce(F.sum("begun").over(along), F.lit(0)).alias("base"))
        inside = Window.partitionBy("paragraph_of", "stretch").orderBy("page", "page_id", "fragment").rowsBetween(Window.unboundedPreceding, 0)
        numbered = marked.withColumn("within", F.sum("begin").over(inside)).join(base, ["paragraph_of", "stretch"]).withColumn("paragraph", F.col("base") + F.col("within"))
        parts = F.array_sort(F.collect_list(F.struct("page", "page_id", "fragment", "text", "glue")))
        merged = numbered.groupBy("source", "paragraph_of", "paragraph").agg(parts.alias("parts"))
        text = F.aggregate(
            "parts",
            F.struct(F.lit("").alias("t"), F.lit("").alias("g")),
            lambda acc, p: F.struct(F.concat(acc["t"], acc["g"], p["text"]).alias("t"), p["glue"].alias("g")),
            lambda acc: acc["t"],
        )
        own = F.when(F.col("source").startswith("\u0000"), None).otherwise(F.col("source"))
        return merged.select(own.alias("source"), "paragraph_of", F.col("paragraph").cast("int").alias("paragraph"), F.col("parts")[0]["page_id"].alias("first_page_id"), text.alias("text"))


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The paragraphs of each page: text, whether one surely starts here, whether its end is open, what joins it on."""
    for batch in batches:
        at, rows = [], []
        cols = [batch.column(k).to_pylist() for k in range(1, 7)]
        for r, (source, page, text, drop, ends, fixes) in enumerate(zip(*cols)):
            lines = text.split("\n")
            dropped, cut = set(drop or ()), {e["line_no"]: e["cut"] for e in ends or ()}
            fixed = {f["word"]: f["printed"] for f in fixes or ()}
            whole = {w: p for w, p in fixed.items()}

            def mend(text: str, whole: dict[str, str] = whole) -> str:
                if not whole:
                    return text

                def one(m: re.Match) -> str:
                    w = m[0].lstrip(_OPENING).rstrip(_CLOSING)
                    p = whole.get(w.lower()) or whole.get(w)
                    if not w or p is None:
                        return m[0]
                    if w.isupper():
                        p = p.upper()
                    elif w[0].isupper() or (w[0] in SIGNS and m[0][0] == w[0] and m.start() == 0):
                        p = p[0].upper() + p[1:]
                    return m[0].replace(w, p, 1)

                return re.sub(r"\S+", one, text)

            out: list[list] = []
            gap = False
            glue = ""
            for i, line in enumerate(lines):
                if i in dropped:
                    continue
                if not line.strip():
                    gap = True
                    continue
                t = line.strip()
                indented = line.startswith("  ")
                new = not out or indented or (gap and (out[-1][0].rstrip()[-1:] in _ENDS + "”»\")" or t[:1].isupper() or t[:1].isdigit()) and glue == " ")
                if new:
                    first = not out
                    out.append(["", indented or (not first)])
                    glue = ""
                out[-1][0] += glue + t
                if i in cut:
                    if cut[i]:
                        out[-1][0] = out[-1][0][:-1]
                    glue = ""
                else:
                    glue = " "
                gap = False
            for k, (t, surely) in enumerate(out):
                final = k == len(out) - 1
                at.append(r)
                rows.append((source, page, k, mend(t), surely, final and (glue == "" or t.rstrip()[-1:] not in _ENDS + "”»\")"), glue if final else " "))
        columns = list(zip(*rows)) if rows else [()] * 7
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at, pa.int64()))] + [pa.array(c, t) for c, t in zip(columns, kinds)],
            names=["page_id", "source", "page", "fragment", "text", "starts", "open", "glue"],
        )
