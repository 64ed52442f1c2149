"""Text that looks the same brought to one form.

Each Arrow batch is handed to an embedded DuckDB, which finds and maps decomposed accents
(nfc_normalize), full-width forms (translate), unusual spaces, invisible characters and
look-alike letters of other scripts (regular expressions) in one SQL statement. Superscripts,
ordinals, fractions, dashes, quotes, emoji and words wholly of another script stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ranges of the Unicode character database.
SPACES = r"\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
FULL_WIDTH = r"\x{FF01}-\x{FF60}\x{FFE0}-\x{FFE6}"
INVISIBLE = (
    r"\x{0}-\x{8}\x{E}-\x{1F}\x{7F}-\x{9F}\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}"
    r"\x{2028}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{1D173}-\x{1D17A}\x{E0000}-\x{E0FFF}"
)
_BASE = (
    r"[\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2190}-\x{21FF}\x{2300}-\x{23FF}\x{24C2}\x{25A0}-\x{27BF}\x{2900}-\x{297F}"
    r"\x{2B00}-\x{2BFF}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1FAFF}]"
)
_DRESSED = _BASE + r"[\x{FE0E}\x{FE0F}\x{1F3FB}-\x{1F3FF}]*"
EMOJI = rf"(?:{_DRESSED}(?:[\x{{E0020}}-\x{{E007E}}]+\x{{E007F}})?(?:\x{{200D}}{_DRESSED})*|[0-9#*]\x{{FE0F}}\x{{20E3}})"
#: A letter of a script other than Latin.
_OTHER = r"[^\p{Latin}\p{Common}\p{Inherited}\P{L}]"
MIXED = rf"(?:\p{{Latin}}[\p{{L}}\p{{M}}]*{_OTHER}|{_OTHER}[\p{{L}}\p{{M}}]*\p{{Latin}})"
#: Letters of Greek and Cyrillic that look like the Latin letter below them.
ALIKE = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγικνορυχόίάАВЕЅІЈКМНОРСТУХҮԚԜаеорсухѕіјһԁԛԝӏѵ"
LATIN = "ABEZHIKMNOPTYXayikvopuxóíáABESIJKMHOPCTYXYQWaeopcyxsijhdqwlv"
# the same letters for words that are of the other script but for a Latin look-alike
_CYRILLIC = "АВЕЅІЈКМНОРСТУХаеорсухѕіј"
_LATIN_OF_CYRILLIC = "ABESIJKMHOPCTYXaeopcyxsij"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "￠￡￢￣￤￥￦"
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + "¢£¬¯¦¥₩"
KINDS = ("decomposed", "full_width", "space", "invisible", "mixed")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Only texts with a character outside this set are looked at closely.
_PLAIN = r"\x{9}-\x{D}\x{20}-\x{7E}\x{A1}-\x{AC}\x{AE}-\x{24F}\x{2010}-\x{2027}\x{20AC}"


def flags_sql(relation: str) -> str:
    """SQL that adds a boolean column for each kind of look-alike to ``relation`` (i, text)."""
    return rf"""
    SELECT *,
      odd AND regexp_matches(text, '\p{{M}}') AND len(list_filter(regexp_extract_all(text, '\p{{L}}\p{{M}}+'), lambda s: length(nfc_normalize(s)) < length(s))) > 0 AS decomposed,
      odd AND regexp_matches(text, '[{FULL_WIDTH}]') AS full_width,
      odd AND regexp_matches(text, '[{SPACES}]') AS space,
      odd AND regexp_matches(text, '[{INVISIBLE}]') AND regexp_matches(regexp_replace(text, '{EMOJI}', '', 'g'), '[{INVISIBLE}]') AS invisible,
      odd AND regexp_matches(text, '{MIXED}') AS mixed
    FROM (SELECT *, coalesce(regexp_matches(text, '[^{_PLAIN}]'), false) AS odd FROM {relation})"""


def normalised_sql(relation: str) -> str:
    """SQL over the flagged relation that adds ``normalised``; texts without a case keep theirs."""
    visible = rf"CASE WHEN invisible THEN array_to_string(list_filter(regexp_extract_all(text, '{EMOJI}|(?s:.)'), lambda s: NOT regexp_full_match(s, '[{INVISIBLE}]')), '') ELSE text END"
    spaced = f"CASE WHEN space OR full_width THEN translate(regexp_replace(text, '[{SPACES}]', ' ', 'g'), {_quoted(_WIDE)}, {_quoted(_NARROW)}) ELSE text END"
    composed = "CASE WHEN decomposed OR invisible OR full_width THEN nfc_normalize(text) ELSE text END"
    latin = f"translate(w, {_quoted(ALIKE)}, {_quoted(LATIN)})"
    other = f"translate(w, {_quoted(_LATIN_OF_CYRILLIC)}, {_quoted(_CYRILLIC)})"
    word = rf"CASE WHEN NOT regexp_matches(w, '{MIXED}') THEN w WHEN NOT regexp_matches({latin}, '{_OTHER}') THEN {latin} WHEN NOT regexp_matches({other}, '\p{{Latin}}') THEN {other} ELSE w END"
    one_script = rf"CASE WHEN text IS NOT NULL AND (mixed OR invisible) AND regexp_matches(text, '{MIXED}') THEN array_to_string(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{M}}]+|[^\p{{L}}\p{{M}}]+'), lambda w: {word}), '') ELSE text END"
    sql = f"SELECT * REPLACE ({visible} AS text) FROM ({relation})"
    for step in (spaced, composed):
        sql = f"SELECT * REPLACE ({step} AS text) FROM ({sql})"
    return f"SELECT * EXCLUDE (text), {one_script} AS normalised FROM ({sql})"


def normalise(df: DataFrame, text: str = "text") -> DataFrame:
    """Every row with a flag for each kind of look-alike and ``normalised``.

    Null texts have no flag set and stay null, empty and blank ones stay as they are (blank
    ones of unusual spaces become plain spaces). All other columns are kept; columns of the
    added names are replaced.
    """
    added = [*KINDS, "normalised"]
    kept = df.drop(*added)
    schema = T.StructType(list(kept.schema.fields))
    for k in KINDS:
        schema = schema.add(k, "boolean")
    schema = schema.add("normalised", "string")
    columns = ", ".join(added)
    sql = f"SELECT {columns} FROM ({normalised_sql(flags_sql('batch'))}) ORDER BY i"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1, "memory_limit": "400MB"}) as con:
            for batch in batches:
                for start in range(0, batch.num_rows, 2048):
                    part = batch.slice(start, 2048)
                    con.register("batch", pa.table({"i": pa.array(range(part.num_rows)), "text": part.column(part.schema.names.index(text))}))
                    done = con.sql(sql).to_arrow_table().combine_chunks()
                    yield pa.RecordBatch.from_arrays(
                        list(part.columns) + [done[c].chunk(0).cast(pa.string() if c == "normalised" else pa.bool_()) for c in added],
                        names=part.schema.names + added,
                    )

    return kept.mapInArrow(rows, schema)


def any_case():
    return F.coalesce(F.greatest(*[F.col(k) for k in KINDS]), F.lit(False))
