"""Restoring wrongly decoded text: round trips through the usual mistakes."""

import pytest

from quillon.llm import encoding as en

PT = ["A produção de açúcar é uma operação que não pode esperar, pois as estações são curtas e a água é pouca.", "O êxodo rural e a câmara municipal: opiniões, órgãos e exceções em síntese.", "Não há intervenção humana às margens do rio; também já não chove."]
EN = ["The river trade describes the growth of the towns in the oldest manuals – it’s clear.", "According to the handout, air pressure disturbs the balance of the ecosystem."]


@pytest.fixture(scope="module")
def restorer():
    return en.Restorer(en.train_dictionaries({"pt": PT * 60, "en": EN * 60}))


def wrong(text, written, read):
    return text.encode(written).decode(read)


@pytest.mark.parametrize(("written", "read"), [("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp850"), ("utf-8", "cp437"), ("cp1252", "mac_roman"), ("cp1252", "cp850")])
def test_round_trip(restorer, written, read):
    for text in PT:
        garbled = wrong(text, written, read)
        assert restorer.restore(garbled)[0] == text
        assert restorer.restore(garbled)[1]


def test_twice(restorer):
    text = PT[0]
    assert restorer.restore(wrong(wrong(text, "utf-8", "cp1252"), "utf-8", "cp1252"))[0] == text


def test_only_a_part_is_garbled(restorer):
    mixed = PT[1] + "\n" + wrong(PT[0], "utf-8", "latin-1")
    assert restorer.restore(mixed)[0] == PT[1] + "\n" + PT[0]


def test_lost_bytes(restorer):
    text, chain = restorer.restore(PT[0].encode("latin-1").decode("utf-8", "replace"))
    assert chain and "operação" in text


@pytest.mark.parametrize("text", [*PT, *EN, None, "", "  ", "CONSERVAÇÃO DA ÁGUA", "SÃO PAULO", "Ça va? Él está “aquí”… ¿Qué? naïve façade", "Übung «É» Ñandú", "DIVISAO sem acentos", "x² + y³ = 5 µm", "λόγος и мир"])
def test_clean_values_stay(restorer, text):
    assert restorer.restore(text) == (text, None)


def test_tables(spark):
    garbled = wrong(PT[0], "utf-8", "latin-1")
    rows = [(1, garbled, "s"), (1, garbled, "s"), (2, None, "hist√≥ria.txt"), (3, "", None), (None, garbled, "x"), (4, PT[1], "limpo")]
    df = spark.createDataFrame([(*r, "pt", 1) for r in rows], "doc_id bigint, text string, source string, lang string, field int")
    dictionaries = en.train_dictionaries({"pt": PT * 60})
    assert {(r.doc_id, r.field) for r in en.garbled_values(df, dictionaries).collect()} == {(1, "text"), (2, "source")}
    full = en.restore_encoding(df, dictionaries)
    assert full.count() == 6 and full.where("doc_id = 2").first().source == "história.txt"
    assert full.where("doc_id = 4").first().text_chain is None
    empty = df.limit(0)
    assert en.garbled_values(empty, en.fit_dictionaries(empty)).count() == 0


def test_a_wrong_word_of_usual_shape():
    de = ["Das Licht schwächt die Härte, während sich die Hänge mit der Wärme ändern und die Nähe der Städte stört."]
    restorer = en.Restorer(en.train_dictionaries({"de": de * 60, "pt": PT * 60}))
    garbled = wrong("Es schwächt die Hänge, während sich die Wärme ändert.", "cp1252", "cp850")
    assert restorer.restore(garbled)[0] == "Es schwächt die Hänge, während sich die Wärme ändert."


def test_signs_are_no_shorter_as_letters(restorer):
    for text in ("Um termo (“peer review”) aqui.", "1819…”", "(“open air”).", "“(Bolemgravi)”"):
        assert restorer.restore(text) == (text, None)


def test_readings_change_the_word():
    assert not en.readings("casa") and all(out != "ação" for out, _ in en.readings("ação").values())
    assert any(out == "ação" for out, _ in en.readings(wrong("ação", "utf-8", "cp1252")).values())
