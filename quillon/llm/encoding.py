"""Text that was decoded with the wrong character encoding, found and restored.

A step undoes one wrong decoding: characters are turned back into the bytes of the encoding
that was used and those are read in the right one. A chain is one or more steps. For every
value with words that any step could explain, each chain's candidate is compressed with the
zstandard dictionary of its language; the chain with the minimum description length, its own
cost included, is chosen. If none is shorter than the value as it stands, the value is left
unchanged.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.labels import labelled_sample

#: Texts of each language from which its dictionary is trained, and its size in bytes.
SAMPLE_TEXTS = 300
DICTIONARY_BYTES = 48 << 10
#: Description length in bytes of a step that undoes UTF-8, and of one that maps byte by byte.
#: The first is what is expected where whole byte sequences fit, which hardly happens by chance,
#: so it has a bonus; the second fits many words by chance. Each further step costs a byte.
UTF8_COST, BYTE_COST, NEXT_COST = -2, 3, 1
#: Extra bytes for each character that a step brings in and the dictionaries' languages do not use.
STRANGE_COST = 5
#: Extra bytes for a word built as none is: a capital inside small letters, a sign between letters,
#: a letter behind a full stop, an accented letter alone that is no word. Bytes that a word of the
#: dictionary saves.
ODD_COST, KNOWN_GAIN = 6, 3
_LEVEL = 12
_ODD = re.compile(
    r"(?<=[^\W\d_])[À-ÖØ-Þ](?=[a-zß-öø-ÿ])|[a-zß-öø-ÿ][À-ÖØ-Þ]|[ß-öø-ÿ][A-Z]|(?<=[^\W\d_])[^\w\s\x00-\x7f’‘–—…“”«»](?=[^\W\d_])"
    r"|(?<=[^\W\d_])[¡¿«“„]|[.,;:!?)\d][À-ÖØ-öø-ÿ]\W*$|^\W*[^\W\x00-\x7féàáóôÉÀÁÓÔ]\W*$"
)
LOST = "�"
#: Encodings that text is read with by mistake, and the ones it was written in.
READ_AS = ("cp1252", "cp850", "cp437", "mac_roman", "cp1250")
_ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñßœÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑŒ"
#: What western text holds beside ASCII.
_EXPECTED = frozenset(_ACCENTED + "æøåÆØÅÿ¿¡«»“”„‘’‚–—…ªº°§©®·•²³¹½¼¾µ×€£\xa0\u202f")
#: Words of usual shape: all capitals, or small letters behind at most one plain capital.
_USUAL = re.compile(r"""[^\w\s]*(?:[A-Z]?[a-záàâãäéèêëíìîïóòôõöúùûüçñßœ'’\-]*|[A-ZÁÀÂÃÄÉÈÊËÍÓÔÕÖÚÜÇÑ'’\-]+)[.,;:!?…”“"»)\]\d’']*""")
_ODD_PUNCTUATION = re.compile("[^\\x00-\\x7f“”„‘’–—…«»¿¡áàâãäéèêëíìîïóòôõöúùûüçñßœÁÀÂÃÄÉÈÊËÍÓÔÕÖÚÜÇÑ]")

#: Signs of three bytes in UTF-8 are measured as two, like letters, by their places in cp1252: else
#: any reading that turns one into a letter were a byte shorter.
_EVEN = [(c.encode(), chr(b).encode()) for b in range(0x80, 0xA0) if len((c := bytes([b]).decode("cp1252", "replace")).encode()) == 3 and c != LOST]
_MARKS = "\"'“”„‘’()[]{}«»¿¡.,;:!?…–—"
_WORD = re.compile(r"[^ \t\n\r\f\v]+")

Step = Callable[[str], str]


def _measured(text: str) -> bytes:
    """What is compressed for a text."""
    data = text.encode("utf-8", "surrogatepass")
    if b"\xe2" in data:
        for sign, even in _EVEN:
            data = data.replace(sign, even)
    return data


@cache
def _bytes_of(encoding: str) -> dict[str, int]:
    """The byte of each high character; bytes that the encoding leaves open are their own code point."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            pass
        if encoding == "cp1252":
            out.setdefault(chr(b), b)
    return out


def _utf8_step(encoding: str) -> Step:
    """Undo the reading of UTF-8 as a single-byte encoding, wherever its sequences stand."""
    byte = _bytes_of(encoding)

    def some(low: int, high: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in byte.items() if low <= b <= high) + "]"

    tail = some(0x80, 0xBF)
    sequence = re.compile(f"{some(0xC2, 0xDF)}{tail}|{some(0xE0, 0xEF)}{tail}{{2}}|{some(0xF0, 0xF4)}{tail}{{3}}")

    def read(m: re.Match) -> str:
        try:
            return bytes(byte[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    return lambda text: sequence.sub(read, text)


def _byte_step(encoding: str, written: str = "cp1252") -> Step:
    """Undo the reading of one single-byte encoding as another, for a word as a whole."""
    byte = _bytes_of(encoding)
    mapping = {}
    for c, b in byte.items():
        try:
            mapping[c] = bytes([b]).decode(written)
        except UnicodeDecodeError:
            continue
    mapping = {c: d for c, d in mapping.items() if d in _EXPECTED and not d.isspace()}

    known, to = frozenset(mapping), str.maketrans(mapping)

    def step(word: str) -> str:
        return word.translate(to) if known.issuperset(c for c in word if c >= "\x80") else word

    return step


@cache
def chains() -> list[tuple[str, tuple[Step, ...], int]]:
    """(name, steps, cost) of every chain: each step alone, then UTF-8 read wrongly two or three times."""
    utf8 = {f"utf-8 as {e}": _utf8_step(e) for e in READ_AS}
    single = {f"cp1252 as {e}": _byte_step(e) for e in READ_AS if e != "cp1252"}
    out = [(name, (step,), UTF8_COST if name in utf8 else BYTE_COST) for name, step in (utf8 | single).items()]
    out += [(f"{a} > {b}", (utf8[a], utf8[b]), UTF8_COST + NEXT_COST) for a, b in itertools.product(utf8, repeat=2)]
    first = "utf-8 as cp1252"
    return out + [(f"{first} > {first} > {first}", (utf8[first],) * 3, UTF8_COST + 2 * NEXT_COST)]


#: Only where two characters of the upper half meet can there be bytes of one character in UTF-8.
_PAIR = re.compile(r"[^\x00-\x7f]{2}")


def readings(word: str) -> dict[int, tuple[str, int]]:
    """By the number of each chain that changes a word: what it is behind it, and how many strange characters that brings in.

    No control characters come out.
    """
    out: dict[int, tuple[str, int]] = {}
    met = _PAIR.search(word) is not None
    done: dict[tuple[Step, str], str] = {}
    for k, (_, steps, cost) in enumerate(chains()):
        if not met and cost < BYTE_COST:
            continue
        now = word
        for step in steps:
            if (new := done.get((step, now))) is None:
                new = done[step, now] = step(now)
            now = new
        if now != word and not any(unicodedata.category(c) == "Cc" for c in now):
            out[k] = now, _brought_in(word, now)
    return out


def train_dictionaries(samples: dict[str, list[str]]) -> dict[str, bytes]:
    """A zstandard dictionary for each language, from the texts that hold nothing suspicious."""
    out = {}
    for lang, texts in samples.items():
        clean = [t for t in texts if not any(suspicious_shape(w) for w in t.split())]
        if not (parts := [line.encode() for t in clean for line in t.split("\n") if line.strip()]):
            continue
        size = sum(map(len, parts))
        try:
            # a dictionary must stay well below its samples
            out[lang] = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 8)), parts).as_bytes()
        except zstandard.ZstdError:
            # too little for training: the plain texts serve as content
            out[lang] = b"\n".join(parts)[-DICTIONARY_BYTES:]
    return out or {"any": _ACCENTED.encode() * 4}


def _split(text: str) -> list[str]:
    """Words between plain white space; a no-break space or a next-line sign may be half of a garbled letter."""
    return _WORD.findall(text) if "\xa0" in text or "\x85" in text else text.split()


def suspicious_shape(word: str) -> bool:
    """Whether a word is not plainly built: only such words are compared under the chains."""
    return not word.isascii() and (_ODD_PUNCTUATION.search(word) is not None or not _USUAL.fullmatch(word) or _ODD.search(word) is not None)


class Restorer:
    """Restores single values; remembers the words it has judged."""

    def __init__(self, dictionaries: dict[str, bytes], remember: int = 200_000):
        self._zip = {}
        for lang, d in dictionaries.items():
            held = zstandard.ZstdCompressionDict(d)
            held.precompute_compress(level=_LEVEL)
            self._zip[lang] = zstandard.ZstdCompressor(level=_LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)
        self._content = {lang: d.decode("utf-8", "ignore") for lang, d in dictionaries.items()}
        self._known: dict[str, dict[int, set[str]]] = {}
        self._remember = remember
        self._words: dict[str, bool] = {}
        self._reads: dict[str, dict[int, tuple[str, int]]] = {}
        self._costs: dict[tuple[str, str], int] = {}

    def _vocabulary(self, lang: str) -> dict[int, set[str]]:
        """Words that stand whole in the dictionary, by length."""
        if lang not in self._known:
            by: dict[int, set[str]] = {}
            for w in re.findall(r"(?<=\s)[^\W\d_]+(?=[\s.,;:])", self._content[lang].lower()):
                by.setdefault(len(w), set()).add(w)
            self._known[lang] = by
        return self._known[lang]

    def _size(self, lang: str, text: str) -> int:
        return len(self._zip[lang].compress(_measured(text)))

    def _cost(self, lang: str, word: str) -> int:
        key = (lang, word)
        if (n := self._costs.get(key)) is None:
            if len(self._costs) >= self._remember:
                self._costs.clear()
            core = word.strip(_MARKS).lower()
            known = core in self._vocabulary(lang).get(len(core), ())
            n = self._costs[key] = self._size(lang, f" {word} ") + ODD_COST * bool(_ODD.search(word)) - KNOWN_GAIN * known
        return n

    def _readings(self, word: str) -> dict[int, tuple[str, int]]:
        if (found := self._reads.get(word)) is None:
            if len(self._reads) >= self._remember:
                self._reads.clear()
            found = self._reads[word] = readings(word)
        return found

    def _run(self, chain: int, word: str, lang: str, chosen: bool = False) -> str:
        """The word behind the chain, or as it was where that is no shorter.

        Where the chain is ``chosen`` for the value already, as short is enough.
        """
        if (read := self._readings(word).get(chain)) is None:
            return word
        out, strange = read
        gain = self._cost(lang, word) - self._cost(lang, out) - STRANGE_COST * strange - min(chains()[chain][2], 0)
        if gain == 0 and chosen and not _ODD.search(out):
            plain = lambda w: w.strip(_MARKS).lower()
            known = self._vocabulary(lang)
            return word if plain(word) in known.get(len(plain(word)), ()) and plain(out) not in known.get(len(plain(out)), ()) else out
        return out if gain > 0 else word

    def _suspect(self, word: str) -> bool:
        """Whether some chain's reading of the word is shorter in some language."""
        if (known := self._words.get(word)) is None:
            known = LOST in word or any(self._run(k, word, lang) != word for k in self._readings(word) for lang in self._zip)
            if len(self._words) >= self._remember:
                self._words.clear()
            self._words[word] = known
        return known

    def _mend_lost(self, word: str, lang: str) -> str:
        """Fill replacement characters: by the dictionary's word that fits, else by the filling that is clearly the shortest."""
        core = word.strip("".join(c for c in word if not c.isalnum() and c != LOST))
        if core.strip(LOST):
            fits = re.compile("".join(f"[{_ACCENTED}–]" if c == LOST else re.escape(c) for c in core.lower()))
            known = [w for w in self._vocabulary(lang).get(len(core), ()) if fits.fullmatch(w)]
            if known:
                best = min(known, key=lambda w: (self._cost(lang, w), w))
                return word.replace(core, "".join(b if c == LOST else c for b, c in zip(best, core)), 1)
        beam = [word]
        while LOST in beam[0]:
            grown = {w.replace(LOST, c, 1) for w in beam for c in _ACCENTED + "–…“”"}
            beam = sorted(grown, key=lambda w: (self._cost(lang, w), w))[:12]
        best, second = beam[0], beam[1]
        return best if self._cost(lang, best) < min(self._cost(lang, second), self._cost(lang, word)) else word

    def restore(self, text: str | None) -> tuple[str | None, str | None]:
        """(restored, chain); the chain is None where the value holds nothing garbled."""
        if not text or text.isascii():
            return text, None
        words = {w for w in _split(text) if not w.isascii()}
        if not any(self._suspect(w) for w in words):
            return text, None
        # nothing lost counts for the language: the shortest description of the value as it stands
        lang = min(self._zip, key=lambda x: (self._size(x, text), x))
        odd, way = {w for w in words if _ODD.search(w)}, None
        best, name, length = text, None, self._size(lang, text) + ODD_COST * len(odd)
        places: dict[str, list[tuple[int, int]]] = {w: [] for w in words}
        for m in _WORD.finditer(text):
            if m[0] in places:
                places[m[0]].append(m.span())
        changing: dict[int, dict[str, str]] = {}
        for w in words:
            for k in self._readings(w):
                if (new := self._run(k, w, lang)) != w:
                    changing.setdefault(k, {})[w] = new
        for k, (chain, _, cost) in enumerate(chains()):
            if changed := changing.get(k):
                candidate = _put(text, sorted((s, e, new) for w, new in changed.items() for s, e in places[w]))
                still = len(odd - changed.keys()) + sum(_ODD.search(new) is not None for new in changed.values())
                strange = sum(self._readings(w)[k][1] for w in changed)
                total = self._size(lang, candidate) + ODD_COST * still + STRANGE_COST * strange + cost
                if total < length:
                    best, name, length, way = candidate, chain, total, k
        if way is not None:
            best = _replace(text, {w: self._run(way, w, lang, chosen=True) for w in words})
        if LOST in best:
            lost = {w: new for w in _split(best) if LOST in w and (new := self._mend_lost(w, lang)) != w}
            best, name = _replace(best, lost), " > ".join(filter(None, (name, "lost bytes")))
        return best, name


def _brought_in(word: str, out: str) -> int:
    """How many more characters of no expected language there are behind a step."""
    count = lambda t: sum(c >= "\x80" and c not in _EXPECTED for c in t)
    return max(0, count(out) - count(word))


def _put(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, stop, new in spans:
        out += text[at:start], new
        at = stop
    return "".join(out) + text[at:]


def _replace(text: str, changed: dict[str, str]) -> str:
    return _WORD.sub(lambda m: changed.get(m[0], m[0]), text) if changed else text


def fit_dictionaries(docs: DataFrame, text: str = "text", source: str = "source", label: str = "lang") -> dict[str, bytes]:
    """Dictionaries from at most ``SAMPLE_TEXTS`` labelled texts a language and their sources."""
    both = docs.select(F.concat_ws("\n", source, text).alias("t"), F.col(label).alias("l"))
    return train_dictionaries(labelled_sample(both, SAMPLE_TEXTS, "t", "l"))


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def garbled_values(docs: DataFrame, dictionaries: dict[str, bytes], doc_id: str = "doc_id", fields: tuple[str, ...] = ("text", "source")) -> DataFrame:
    """(doc_id, field, restored, chain) of every value that holds garbled characters.

    Values with bytes lost for good are reported too, restored as far as the dictionaries
    tell. Null, empty and blank values are none; a repeated row counts once.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(dictionaries)
        for batch in batches:
            at, field, restored, chain = [], [], [], []
            for k, name in enumerate(fields):
                for i, value in enumerate(batch.column(k + 1).to_pylist()):
                    new, how = restorer.restore(value)
                    if how:
                        at.append(i), field.append(name), restored.append(new), chain.append(how)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(field, pa.string()), pa.array(restored, pa.string()), pa.array(chain, pa.string())],
                names=["doc_id", "field", "restored", "chain"],
            )

    picked = docs.select(doc_id, *fields).where(f"`{doc_id}` IS NOT NULL")
    return picked.mapInArrow(rows, f"doc_id {_type(docs, doc_id)}, field string, restored string, chain string").dropDuplicates(["doc_id", "field"])


def restore_encoding(docs: DataFrame, dictionaries: dict[str, bytes], fields: tuple[str, ...] = ("text", "source")) -> DataFrame:
    """Every row with its fields as originally written and a column ``<field>_chain`` for each.

    The chain names how the value had been read; it is null where nothing was changed. All
    other columns stay as they are; columns of the added names are replaced.
    """
    docs = docs.drop(*[f"{f}_chain" for f in fields])
    schema = T.StructType(list(docs.schema.fields))
    for f in fields:
        schema = schema.add(f"{f}_chain", "string")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(dictionaries)
        for batch in batches:
            names, columns, chain = batch.schema.names, list(batch.columns), []
            for f in fields:
                done = [restorer.restore(v) for v in columns[names.index(f)].to_pylist()]
                columns[names.index(f)] = pa.array([d[0] for d in done], pa.string())
                chain.append(pa.array([d[1] for d in done], pa.string()))
            yield pa.RecordBatch.from_arrays(columns + chain, names=names + [f"{f}_chain" for f in fields])

    return docs.mapInArrow(rows, schema)
