"""Language labels, held-out accuracy, segments."""

import pytest
from pyspark.sql import functions as F

from quillon.llm import language as lg
from quillon.llm.labels import label_language, language_of_label

LABELS = {"pt": "pt", "PT-br": "pt", "pt_PT": "pt", "por": "pt", "Português (Brasil)": "pt", "portugues": "pt", "Brazilian Portuguese": "pt", "en-US": "en", "English": "en", "eng": "en", "inglês": "en", "es_ES": "es", "español": "es", "spa": "es", "fr-CA": "fr", "français": "fr", "fre": "fr", "deu": "de", "Deutsch": "de", "ger": "de", "und": None, "unknown": None, "": None, "  ": None, None: None, "x": None, "it": None}


@pytest.fixture(scope="module")
def tables(spark, small):
    return spark.read.parquet(f"{small}/../sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return lg.fit(tables)


def test_labels(spark):
    df = spark.createDataFrame([(k, v) for k, v in LABELS.items()], "l string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", label_language(F.col("l"))).collect())
    assert {k: language_of_label(k) for k in LABELS} == LABELS


TEXTS = {
    "pt": "Na prática, o manguezal costeiro amplia a relação entre as espécies nas margens do rio. A câmara municipal desloca a saúde dos moradores durante a estação seca.",
    "en": "In practice, the coastal wetland changes the bond between species on the banks of the river. The town council reduces the health of the villagers during the dry season.",
    "es": "En la práctica, el humedal costero amplía la relación entre las especies en las orillas del río. El ayuntamiento reduce la salud de los vecinos durante la estación seca.",
    "fr": "En pratique, la zone humide côtière modifie la relation entre les espèces au bord de la rivière. Le conseil réduit la santé des habitants pendant la saison sèche.",
    "de": "In der Praxis verändert das Relief des Gebirges das Wachstum der Pflanzen am Ufer des Flusses. Der Luftdruck verstärkt den Streit um das Land in den meisten Provinzen.",
}
FAR = {
    "pt": "A professora explicou que as florestas precisam de chuva.",
    "en": "The teacher explained that forests need rain.",
    "es": "La profesora explicó que los bosques necesitan lluvia.",
    "fr": "La professeure a expliqué que les forêts ont besoin de pluie.",
    "de": "Die Lehrerin erklärte, dass die Wälder Regen brauchen.",
}


def test_held_out_sentences(model):
    got = lg.classify(model, list(TEXTS.values()))
    assert [[s[3] for s in segments] for segments in got] == [[k] for k in TEXTS]
    plain = lg.classify(model, [lg._without_accents(t).upper() for t in TEXTS.values()])
    assert [segments[0][3] for segments in plain] == list(TEXTS)
    far = lg.classify(model, list(FAR.values()))
    assert sum(segments[0][3] == k for segments, k in zip(far, FAR)) >= 4


def test_held_out_rows(spark, model, tables):
    # rows of the larger table agree with their labels but for those that are wrong
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text IS NOT NULL AND doc_id % 20 = 3").select("text", "lang").collect()
    known = [(r.text, language_of_label(r.lang)) for r in rows if language_of_label(r.lang) and r.text.strip()]
    main = [max(s, key=lambda x: x[2])[3] if s else None for s in lg.classify(model, [t for t, _ in known])]
    assert sum(a == b for a, (_, b) in zip(main, known)) / len(known) > 0.85


def test_mixed_text(model):
    text = TEXTS["pt"] + "\n" + TEXTS["de"] + " " + TEXTS["pt"]
    got = lg.classify(model, [text])[0]
    assert [s[3] for s in got] == ["pt", "de", "pt"] and all(s[5] and 0.5 < s[4] <= 1 for s in got)
    assert "Luftdruck" in text[got[1][0] : got[1][1]] and got[0][0] == 0 and got[-1][1] == len(text)


def test_a_foreign_phrase_is_no_segment(model):
    text = "Na prática, o manguezal costeiro (“the food chain”) amplia a relação entre as espécies nas margens do rio."
    assert [s[3] for s in lg.classify(model, [text])[0]] == ["pt"]


def test_short_sentences_count(model):
    for lang, short in {"de": "Das ist gut.", "en": "This is good.", "es": "Está bien.", "fr": "C'est bien.", "pt": "Isso é bom."}.items():
        other = "en" if lang == "pt" else "pt"
        assert {s[3] for s in lg.classify(model, [f"{TEXTS[other]} {short}"])[0] if s[5]} == {other, lang}
    assert {s[3] for s in lg.classify(model, [TEXTS["pt"] + " Dr. Silva. Um total. Das ist"])[0] if s[5]} == {"pt"}


def test_tables_of_edges(spark, model):
    rows = [(1, TEXTS["pt"], "pt-BR"), (2, TEXTS["pt"], "en"), (2, TEXTS["pt"], "en"), (3, TEXTS["en"] + " " + TEXTS["fr"], "en"), (4, None, "pt"), (5, "", "pt"), (6, " \n ", None), (7, TEXTS["es"], None), (None, TEXTS["es"], None), (8, "12345 !!", "pt"), (9, TEXTS["en"] * 3000, "und")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lang string, letters int")
    assert {(r.doc_id, r.lang) for r in lg.mislabelled(df, model).collect()} == {(2, "pt"), (3, "en"), (3, "fr"), (7, "es"), (9, "en")}
    docs = {r.doc_id: r for r in lg.document_languages(df, model).collect()}
    assert set(docs) == {1, 2, 3, 7, 9} and docs[3].languages == "en,fr" and docs[1].lang == "pt"
    empty = df.limit(0)
    assert lg.mislabelled(empty, lg.fit(empty)).count() == 0


def test_training_on_nothing():
    model = lg.train({})
    assert lg.classify(model, ["texto qualquer aqui"])[0]
