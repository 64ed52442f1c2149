"""Look-alike characters, case by case."""

import unicodedata

import pytest

from quillon.llm import lookalikes as la

CASES = {
    "na\u0303o": ("decomposed", "n\u00e3o"),
    "x\u0304 média": (None, "x\u0304 média"),
    "Ｈｅｌｌｏ！": ("full_width", "Hello!"),
    "a\u00a0b\u2009c": ("space", "a b c"),
    "a​b﻿": ("invisible", "ab"),
    "co­operar": ("invisible", "cooperar"),
    "aa\u200b\u0301": ("invisible", "a\u00e1"),
    "fim ❤️ 👨‍👩‍👧 👩‍🔬 👍🏽": (None, "fim ❤️ 👨‍👩‍👧 👩‍🔬 👍🏽"),
    "a️b": ("invisible", "ab"),
    "a‍ 👍": ("invisible", "a 👍"),
    "1️⃣ um": (None, "1️⃣ um"),
    "dе lа": ("mixed", "de la"),
    "ΕGΕΤΑÇÃO": ("mixed", "EGETAÇÃO"),
    "мoре": ("mixed", "море"),
    "λόγος «мир» α e π": (None, "λόγος «мир» α e π"),
    "m² 3ª nº ½ CO₂ – “x”… €": (None, "m² 3ª nº ½ CO₂ – “x”… €"),
    "5 µm": (None, "5 µm"),
    "tab\tlinha\r\n": (None, "tab\tlinha\r\n"),
    "": (None, ""),
    "   ": (None, "   "),
}


def test_cases(spark):
    df = spark.createDataFrame([(i, t, "x", True) for i, t in enumerate(CASES)] + [(99, None, None, None)], "i int, text string, normalised string, space boolean")
    rows = {r.i: r for r in la.normalise(df).collect()}
    assert len(rows) == len(CASES) + 1 and rows[99].normalised is None
    for i, (text, (kind, clean)) in enumerate(CASES.items()):
        on = [k for k in la.KINDS if rows[i][k]]
        assert (kind in on) if kind else not on, (text, on)
        assert rows[i].normalised == clean, text
    flagged = {r.i for r in la.normalise(df).where(la.any_case()).collect()}
    assert flagged == {i for i, (k, _) in enumerate(CASES.values()) if k}


def test_result_is_stable_and_composed(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "text string")
    once = la.normalise(df).select("normalised").collect()
    twice = la.normalise(spark.createDataFrame([(r[0],) for r in once], "text string")).collect()
    assert sorted(r[0] for r in once) == sorted(r.normalised for r in twice)
    assert not any(r[k] for r in twice for k in la.KINDS)
    assert all(unicodedata.normalize("NFC", r[0]) == r[0] for r in once)


def test_long_and_empty(spark):
    df = spark.createDataFrame([("é " * 200_000,)], "text string")
    assert len(la.normalise(df).first().normalised) == 400_000
    assert la.normalise(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [len(la.ALIKE), len(la._CYRILLIC)])
def test_tables_have_equal_length(n):
    assert len(la.ALIKE) == len(la.LATIN) and len(la._CYRILLIC) == len(la._LATIN_OF_CYRILLIC) and len(la._WIDE) == len(la._NARROW)


def test_full_width_letters_with_accents_apart(spark):
    df = spark.createDataFrame([(1, "\uff23\uff41\uff46\uff45\u0301")], "i int, text string")
    assert la.normalise(df).first().normalised == "Café"
