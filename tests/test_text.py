"""Text functions against the values they are defined by."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as tx


def evaluate(spark, column_of, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in rows.select("i", column_of(F.col("t")).alias("x")).orderBy("i").collect()]


def test_token_estimate(spark):
    words = ["", "a", "a b", "a b c", "a b c d", "a b c d e", "   ", None, "a b c"]
    assert evaluate(spark, tx.count_tokens, *words) == [0, 1, 2, 3, 5, 6, 1, 0, 3]


def test_chunk_id(spark):
    made = lambda t: tx.chunk_id(t, F.lit(0), F.lit(3))
    assert evaluate(spark, made, "a.pdf") == ["e24434f8033946a1"]


@pytest.mark.parametrize(
    ("line", "level"),
    [("Unidade 1: Teste", 1), ("Capitulo 1: Introducao", 2), ("5.1 Alcanos", 3), ("Parte dos líderes da revolta", 0), ("", 0), ("123", 0), ("MÓDULO II", 1), ("REVOLUÇÃO INDUSTRIAL", 2), ("1789 1790 1791", 0), (None, 0)],
)
def test_line_levels(spark, line, level):
    assert evaluate(spark, tx.line_level, line) == [level]


@pytest.mark.parametrize(("size", "level"), [(12.0, 3), (14.4, 1), (0.0, 0), (None, 0)])
def test_bold_lines(spark, size, level):
    rows = spark.createDataFrame([("Uma linha curta", size, 12.0)], "t string, s double, b double")
    assert rows.select(tx.line_level(F.col("t"), F.col("s"), F.col("b"))).first()[0] == level
    long = " ".join(["Palavra"] * 25)
    assert spark.createDataFrame([(long, 20.0, 12.0)], "t string, s double, b double").select(tx.line_level(F.col("t"), F.col("s"), F.col("b"))).first()[0] == 0


def test_page_text(spark):
    cleaned = evaluate(spark, tx.clean_page_text, "texto\n12\nMais", "a fre-\nquência", "antes © 2020 X. Todos os direitos reservados depois", "UM TÍTULO\nTexto", "a\n\n\n\nB", None, "nor\nte")
    assert cleaned == ["texto 12\nMais", "a frequência", "antes  depois".replace("  ", " "), "Texto", "a\n\nB", None, "nor te"]


def test_decomposed_accents_are_composed(spark):
    assert evaluate(spark, tx.clean_page_text, "café") == ["café"]


def test_sentences(spark):
    assert evaluate(spark, tx.sentences, 'Um. Dois! Três? quatro… "Cinco". (Seis)') == [["Um.", "Dois!", "Três? quatro…", '"Cinco".', "(Seis)"]]


def test_titles_questions_and_answers(spark):
    assert evaluate(spark, tx.clean_title, "<think>x</think>\"Um\ntítulo.\"", "a" * 70, None) == ["Um título", "a" * 60 + "…", ""]
    assert evaluate(spark, tx.clean_question, "<think>a</think>\nPergunta: O que é isso?", "curto?", "sem interrogação", None) == ["O que é isso?", None, None, None]
    answered = lambda t: tx.clean_answer(t, F.lit("oi"))
    assert evaluate(spark, answered, "<think>x</think> Resposta", "Oi: tudo bem", "Contexto: eco", "<think>aberto", None) == ["Resposta", "tudo bem", tx.REFUSAL, tx.REFUSAL, tx.REFUSAL]


def test_section_and_metadata(spark):
    assert evaluate(spark, tx.detect_section, "texto pequeno.\n3. Energia Nuclear\nA fissão.", "só minúsculas", None) == ["3. Energia Nuclear", None, None]
    assert evaluate(spark, tx.chapter_of, "Veja o Cap. 5 aqui", "nada") == ["Cap. 5", None]


def test_expected_strings(spark):
    found = lambda t: tx.expected_found(t, F.array(F.lit("CO2")))
    assert evaluate(spark, found, "Usa CO₂ aqui", "nada", None) == [True, False, False]
    assert spark.range(1).select(tx.expected_found(F.lit("x"), F.array().cast("array<string>"))).first()[0] is True
