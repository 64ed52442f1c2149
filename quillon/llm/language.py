"""Languages of documents and of their mixed-language segments.

A sparse multinomial logistic regression over TF-IDF weighted character n-grams, hashed into
a fixed table, is trained with follow-the-regularised-leader under elastic-net penalties on a
bounded sample of labelled texts; a temperature fitted on held-out sentences calibrates its
probabilities. Every sentence of every text is classified; neighbouring sentences of one
language form a segment.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import textarrays as ta
from quillon.llm.labels import LANGUAGES, label_language, labelled_sample

#: Bounds of the training sample: texts and sentences of each label.
SAMPLE_TEXTS, SAMPLE_SENTENCES = 400, 2500
BUCKETS = 1 << 17
ORDERS = (2, 3, 4)
#: A sentence speaks for a language from so many letters and words on, and from this probability.
#: What has no mark at its end is a title or a notice rather than a sentence, unless it is long.
MIN_LETTERS, MIN_WORDS, MIN_CONFIDENCE, UNMARKED_LETTERS = 20, 4, 0.8, 70

#: Frequent small words. Too short for the model, a sentence with an end mark is judged by these.
_SMALL = {
    "pt": "não é são uma isso isto este esta você também muito pelo pela ele ela bom boa está em ao foi com os as tem o a e um de que do da das dos se no na me bem",
    "es": "el los las una un muy pero esto eso este esta ella él usted también fue bueno buena está es y hay del con no la lo le de que se en me bien a o son",
    "en": "the is this that it are and of with you he she they very not good well we his her was were for to in on no me a an as do so has have had",
    "fr": "le la les une un et est c il elle on ce cette pas très nous vous ils qui que dans avec bon bonne bien de des du se en me a y son tu je",
    "de": "das ist der die den und nicht ein eine ich wir sie er es sehr gut war was mit auf im in so an zu du des dem man am",
}
_ALPHA, _BETA, _L1, _L2 = 0.5, 1.0, 0.02, 0.02


@cache
def _among(characters: str) -> np.ndarray:
    table = np.zeros(ta.SPAN, dtype=bool)
    table[[ord(c) for c in characters]] = True
    return table


def _sentences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all texts, sentence starts, stops, text index, has an end mark) by ends of lines and sentences."""
    codes = ta.codes_of(texts, "\x00")
    line = (codes == 10) | (codes == 0) | (codes == 13)
    space = ta.look(ta.flags("isspace"), codes) | line
    # a sentence ends behind its mark and the closing quotes that follow, if white space comes next
    mark = ta.look(_among(".!?…"), codes)
    closer = ta.look(_among("\"'”’»)]"), codes)
    for _ in range(2):
        mark[1:] |= closer[1:] & mark[:-1]
    end = mark.copy()
    end[:-1] &= space[1:]
    cut = np.flatnonzero(end | line) + 1
    start, stop = np.concatenate(([0], cut[:-1])), cut
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    return codes, start, stop, np.searchsorted(ends, start, side="right"), end[stop - 1]


def _ngrams(codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """For each order the buckets and the index of their sentence; letters and words of each sentence.

    Text is lowered; what is no letter becomes one space between words.
    """
    owner = np.repeat(np.arange(start.size), stop - start)
    letter = ta.look(ta.flags("isalpha"), codes)
    first = letter & ~np.concatenate(([False], letter[:-1]))
    gap = ~letter
    gap[1:] &= letter[:-1] | (owner[1:] != owner[:-1])
    take = letter | gap
    kept = owner[take]
    low = np.where(letter[take], ta.map_codes(ta.lower_table(), codes[take]), np.uint32(32)).astype(np.uint32)
    out = []
    for n in ORDERS:
        if low.size < n:
            out.append((np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)))
            continue
        m = low.size - n + 1
        h = np.full(m, n, dtype=np.uint32)
        for j in range(n):
            h = h * np.uint32(0x01000193) + low[j : j + m]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        same = kept[:m] == kept[n - 1 :]
        out.append(((h[same] >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64), kept[:m][same]))
    size = start.size
    return out, np.bincount(owner[letter], minlength=size), np.bincount(owner[first], minlength=size)


def _runs(grams: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order the buckets, where each sentence begins in them, and which sentence that is."""
    out = []
    for buckets, owner in grams:
        if owner.size:
            begin = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1))
            out.append((buckets, begin, owner[begin]))
    return out


def _summed(table: np.ndarray, runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """Sum of the table's values over the n-grams of each sentence."""
    total = np.zeros(size)
    for buckets, begin, owner in runs:
        total[owner] += np.add.reduceat(table[buckets], begin, dtype=np.float64)
    return total


@dataclass(frozen=True)
class Model:
    """``weights`` hold the inverse document frequencies already; ``squares`` those squared."""

    languages: tuple[str, ...]
    weights: np.ndarray
    squares: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, grams: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
        runs = _runs(grams)
        norm = np.sqrt(np.maximum(_summed(self.squares, runs, size), 1e-9))
        return np.stack([_summed(w, runs, size) / norm for w in self.weights], axis=1) + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def _ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by one pass of follow-the-regularised-leader over (buckets, values, class)."""
    z, n = np.zeros((BUCKETS + 1, classes), dtype=np.float32), np.zeros((BUCKETS + 1, classes), dtype=np.float32)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= _L1, 0.0, -(zi - np.sign(zi) * _L1) / ((_BETA + np.sqrt(ni)) / _ALPHA + _L2))

    for k in np.random.default_rng(seed).permutation(len(examples)):
        at, x, label = examples[k]
        zi, ni = z[at], n[at]
        w = weights(zi, ni)
        p = _softmax(x @ w)
        p[label] -= 1.0
        g = x[:, None] * p[None, :]
        sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / _ALPHA
        z[at] = zi + g - sigma * w
        n[at] = ni + g * g
    w = weights(z, n)
    return w[:BUCKETS], w[BUCKETS]


def _without_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def train(samples: dict[str, list[str]], per_label: int = SAMPLE_SENTENCES, seed: int = 5) -> Model:
    """A model from labelled texts, some of which may be labelled wrongly.

    Every second sentence is taken without its accents and every fifth in capitals turned
    small, as such texts occur. After a first pass the sentences that the model is sure are of
    another language than labelled are left out of the second.
    """
    languages = tuple(k for k in LANGUAGES if samples.get(k)) or LANGUAGES[:1]
    texts, labels = [], []
    for k, lang in enumerate(languages):
        own = [s for t in samples.get(lang, ()) for s in re.split(r"(?<=[.!?…])\s+|\n", t) if len(s) >= 30][:per_label]
        texts += [_without_accents(s) if i % 2 else s for i, s in enumerate(own)]
        labels += [k] * len(own)
    size = len(texts)
    if not size:
        return Model(languages, np.zeros((len(languages), BUCKETS), np.float32), np.ones(BUCKETS, np.float32), np.zeros(len(languages)), 1.0)
    codes = ta.codes_of(texts, "\n")
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=size)
    stop = np.cumsum(lengths)
    grams, _, _ = _ngrams(codes, stop - lengths, stop)
    owner, bucket = np.concatenate([o for _, o in grams]), np.concatenate([b for b, _ in grams])
    pairs, tf = np.unique(owner * (BUCKETS + 1) + bucket, return_counts=True)
    doc, feature = pairs // (BUCKETS + 1), pairs % (BUCKETS + 1)
    df = np.bincount(feature, minlength=BUCKETS)
    idf = np.log((size + 1) / (df + 1)) + 0.1
    values = tf * idf[feature]
    norm = np.sqrt(np.maximum(np.bincount(doc, weights=tf * idf[feature] ** 2, minlength=size), 1e-9))
    values = (values / norm[doc]).astype(np.float32)
    edges = np.searchsorted(doc, np.arange(size + 1))
    examples = [(np.append(feature[a:b], BUCKETS), np.append(values[a:b], np.float32(1.0)), y) for a, b, y in zip(edges, edges[1:], labels)]
    held, used = examples[::10], [e for i, e in enumerate(examples) if i % 10]
    for _ in range(2):
        w, bias = _ftrl(used, len(languages), seed)
        full = np.vstack([w, bias])
        sure = [_softmax(4 * (x @ full[at])) for at, x, _ in used]
        used = [e for e, p in zip(used, sure) if p.argmax() == e[2] or p.max() < 0.7]
        seed += 1
    scores = np.stack([x @ full[at] for at, x, _ in held]) if held else np.zeros((0, len(languages)))
    truth = np.array([y for _, _, y in held], dtype=np.int64)
    right = scores.argmax(axis=1) == truth if held else np.zeros(0, dtype=bool)

    def loss(t: float) -> float:
        # wrongly labelled sentences must not blunt the probabilities: the middle nine tenths count
        z = scores[right] / t
        return float(np.mean(np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)) + z.max(axis=1) - z[np.arange(len(z)), truth[right]])) + 0.02 / t

    temperature = min((0.02 * 1.25**k for k in range(24)), key=loss) if right.any() else 1.0
    return Model(languages, np.ascontiguousarray((w * idf[:, None]).T.astype(np.float32)), (idf**2).astype(np.float32), bias, temperature)


def fit(docs: DataFrame, text: str = "text", label: str = "lang") -> Model:
    """A model from at most ``SAMPLE_TEXTS`` texts of each label."""
    return train(labelled_sample(docs, SAMPLE_TEXTS, text, label))


@cache
def _small_words() -> dict[str, frozenset[str]]:
    by: dict[str, set[str]] = {}
    for lang, words in _SMALL.items():
        for w in words.split():
            by.setdefault(w, set()).add(lang)
    return {w: frozenset(langs) for w, langs in by.items()}


def short_language(sentence: str) -> str | None:
    """The one language that all small words of a short sentence share, if they are two at least and half of its words."""
    words = re.findall(r"[^\W\d_]+", sentence.lower())
    known = [_small_words()[w] for w in words if w in _small_words()]
    if len(known) < 2 or 2 * len(known) < len(words):
        return None
    shared = frozenset.intersection(*known)
    return next(iter(shared)) if len(shared) == 1 else None


def classify(model: Model, texts: list[str]) -> list[list[tuple[int, int, int, str, float, bool]]]:
    """For each text its segments: (start, stop, letters, language, confidence, holds a whole sentence).

    Sentences too short to judge, or not surely of another language, go with the segment
    before them, the first ones with the one behind.
    """
    codes, start, stop, owner, marked = _sentences(texts)
    grams, letters, words = _ngrams(codes, start, stop)
    logits = model.logits(grams, start.size)
    p = model.probabilities(logits)
    best, top = p.argmax(axis=1), p.max(axis=1)
    whole = (letters >= MIN_LETTERS) & (words >= MIN_WORDS) & (top >= MIN_CONFIDENCE) & (marked | (letters >= UNMARKED_LETTERS))
    begins = np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))[:-1]))
    for i in np.flatnonzero(marked & (words >= 2) & ((letters < MIN_LETTERS) | (words < MIN_WORDS))):
        lang = short_language(texts[owner[i]][start[i] - begins[owner[i]] : stop[i] - begins[owner[i]]])
        if lang in model.languages:
            best[i], whole[i] = model.languages.index(lang), True
            p[i] = np.arange(len(model.languages)) == best[i]
    out: list[list] = [[] for _ in texts]
    # only sentences with letters count; a text without any has no segment
    for i in np.flatnonzero(letters > 0):
        t = owner[i]
        segments = out[t]
        s, e = int(start[i] - begins[t]), int(min(stop[i] - begins[t], len(texts[t])))
        if segments and (segments[-1][3] == best[i] or not whole[i] or not segments[-1][5]):
            last = segments[-1]
            last[1], last[2] = e, last[2] + int(letters[i])
            if whole[i]:
                if not last[5]:
                    last[3], last[6] = best[i], np.zeros_like(p[i])
                last[5], last[6] = True, last[6] + p[i] * letters[i]
            elif not last[5]:
                last[6] = last[6] + p[i] * letters[i]
                last[3] = last[6].argmax()
        else:
            segments.append([s, e, int(letters[i]), best[i], 0.0, bool(whole[i]), p[i] * letters[i]])
    return [[(s, e, n, model.languages[k], float(m[k] / m.sum()), w) for s, e, n, k, _, w, m in segments] for segments in out]


def language_segments(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, segment, start, stop, letters, lang, confidence, whole) in the order of the text.

    ``whole`` says that the segment holds at least one whole sentence of its language. Texts
    without letters, null texts and null ids have no segments; a repeated row counts once.
    """
    picked = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, segment int, start int, stop int, letters int, lang string, confidence double, whole boolean"
    names = ["segment", "start", "stop", "letters", "lang", "confidence", "whole"]
    kinds = [pa.int32()] * 4 + [pa.string(), pa.float64(), pa.bool_()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for first, texts in ta.blocks(batch.column(1)):
                for i, segments in enumerate(classify(model, [t or "" for t in texts])):
                    for k, segment in enumerate(segments):
                        at.append(first + i)
                        found.append((k, *segment))
            columns = list(zip(*found)) if found else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64()))] + [pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", *names]
            )

    return picked.mapInArrow(rows, schema).dropDuplicates(["doc_id", "segment", "start", "stop"])


def document_languages(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang, confidence, languages, segments): the main language by letters, and the set."""
    parts = language_segments(docs, model, doc_id, text)
    by = parts.groupBy("doc_id", "lang").agg(
        F.sum("letters").alias("n"), F.sum(F.col("letters") * F.col("confidence")).alias("weight"), F.count("*").alias("segments"), F.max("whole").alias("whole")
    )
    return by.groupBy("doc_id").agg(
        F.max_by("lang", F.struct("n", "lang")).alias("lang"),
        (F.max_by("weight", F.struct("n", "lang")) / F.sum("n")).alias("confidence"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("whole"), F.col("lang")))), ",").alias("languages"),
        F.sum("segments").cast("int").alias("segments"),
    )


def mislabelled(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """(doc_id, lang): each language of every document whose set of languages is not just its label's.

    The set holds the languages with at least one whole sentence; where no sentence is whole,
    the language of the text as a whole.
    """
    named = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), label_language(F.col(label)).alias("named")).distinct()
    parts = language_segments(docs, model, doc_id, text).groupBy("doc_id", "lang").agg(F.sum("letters").alias("n"), F.max("whole").alias("whole"))
    sets = parts.groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("whole"), F.col("lang"))).alias("sure"), F.max_by("lang", F.struct("n", "lang")).alias("main")
    ).select("doc_id", F.when(F.size("sure") > 0, F.col("sure")).otherwise(F.array("main")).alias("langs"))
    wrong = sets.join(named, "doc_id").where(~((F.size("langs") == 1) & F.coalesce(F.col("langs")[0] == F.col("named"), F.lit(False))))
    return wrong.select("doc_id", F.explode("langs").alias("lang")).distinct()
