"""Languages and what their labels look like."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("pt", "en", "es", "fr", "de")
#: ISO 639 codes and the languages' names in each of the five, without accents.
SPELLINGS = {
    "pt": "pt por portuguese portugues portugais portugiesisch",
    "en": "en eng english ingles anglais englisch inglesa",
    "es": "es spa spanish espanol espanhol espagnol spanisch castellano castelhano",
    "fr": "fr fra fre french frances francais franzosisch",
    "de": "de deu ger german alemao aleman allemand deutsch",
}
#: Parts of the hash's range in which shares of a table are counted.
_SHARES = 1 << 40
_NAMED = {word: lang for lang, words in SPELLINGS.items() for word in words.split()}
_ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñ"
_PLAIN = unicodedata.normalize("NFD", _ACCENTED).encode("ascii", "ignore").decode()


def language_of_label(label: str | None) -> str | None:
    """The language that a label names, in any usual code or spelling, with or without a region."""
    if not label:
        return None
    plain = label.lower().translate(str.maketrans(_ACCENTED, _PLAIN))
    words = re.findall(r"[a-z]+", plain)
    if words and words[0] in _NAMED:
        return _NAMED[words[0]]
    return next((_NAMED[w] for w in words if len(w) > 3 and w in _NAMED), None)


def label_language(label: Column) -> Column:
    """``language_of_label`` as an expression, null where the label names no language."""
    words = F.regexp_extract_all(F.translate(F.lower(label), _ACCENTED, _PLAIN), F.lit("[a-z]+"), F.lit(0))
    named = F.create_map(*[F.lit(x) for pair in _NAMED.items() for x in pair])
    first = F.try_element_at(named, F.get(words, F.lit(0)))
    later = F.filter(words, lambda w: (F.length(w) > 3) & F.try_element_at(named, w).isNotNull())
    return F.coalesce(first, F.try_element_at(named, F.get(later, F.lit(0))))


def labelled_sample(docs: DataFrame, per_language: int, text: str = "text", label: str = "lang") -> dict[str, list[str]]:
    """At most ``per_language`` non-blank texts of each language, as labelled; labels may be wrong.

    The texts with the least hashes are taken, so the sample depends on the rows alone and not on
    how they lie in files. The labels are counted first; then one pass keeps the share of each
    language that its bound asks for, a quarter more to be sure, and copies of a text once, so that a text with very many copies makes the sample smaller. What
    comes to the driver is bounded, whatever the size of the table.
    """
    named = label_language(F.col(label))
    counts = {r.l: r.n for r in docs.groupBy(named.alias("l")).agg(F.count("*").alias("n")).where("l IS NOT NULL").collect()}
    known = docs.select(F.col(text).alias("t"), named.alias("l")).where(F.col("t").rlike(r"\p{L}")).withColumn("h", F.xxhash64("t"))
    low = F.pmod(F.col("h"), F.lit(_SHARES))
    taken = [(F.col("l") == lang) & (low < min(_SHARES, -(-_SHARES * per_language * 5 // (n * 4)))) for lang, n in counts.items()]
    if not taken:
        return {lang: [] for lang in LANGUAGES}
    # one row a text and task is shuffled, however many copies there are
    drawn = known.where(reduce(Column.__or__, taken)).groupBy("l", "h").agg(F.min("t").alias("t")).collect()
    drawn.sort(key=lambda r: (r.h % _SHARES, r.h))
    return {lang: [r.t for r in drawn if r.l == lang][:per_language] for lang in LANGUAGES}
