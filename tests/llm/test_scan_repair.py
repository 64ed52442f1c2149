"""A small book with known furniture, breaks and misread words."""

import datetime
import random

import pytest

from quillon.llm import scan_repair as sr

SCHEMA = "page_id bigint, source string, page int, text string, book_title string, body_size double, scanned_at timestamp"
WORDS = "a produção de açúcar altera o trabalho das cooperativas na região estudada durante a estação seca com apoio da comunidade segundo fontes da época".split()
AT = datetime.datetime(2025, 1, 1)


def book(source="livro.pdf", pages=8):
    r = random.Random(3)
    rows, truth = [], set()
    for p in range(1, pages + 1):
        lines = ["GEOGRAFIA DO VALE" if p % 2 else "CAPÍTULO 1 – A ÁGUA DOCE", ""]
        truth.add((p, 0, "header"))
        if p == 1:
            lines += ["Capítulo 1 – A água doce", ""]
        for k in range(6):
            line = " ".join(r.choice(WORDS) for _ in range(8))
            lines.append(line[0].upper() + line[1:] + ".")
        lines += ["1915", "", f"- {p + 4} -"]
        truth.add((p, len(lines) - 1, "pagenum"))
        rows.append([p, source, p, lines, "Geografia do Vale"])
    return rows, truth


def table(spark, rows):
    return spark.createDataFrame([(i, s, p, "\n".join(t), b, 11.0, AT) for i, s, p, t, b in rows], SCHEMA)


def test_book(spark):
    rows, truth = book()
    rows[1][3][4] = "o trabalho das coopera-"
    rows[1][3][5] = "tivas na região."
    truth.add((2, 4, "hyphen"))
    rows[2][3][3] = "A esta5ão seca na re9ião."
    truth.add((3, 3, "misread"))
    rows[3][3][0] = "CAPÍ|ULO 1 – A ÁGUA DOCE"
    got = sr.Repair(table(spark, [*rows, rows[0]])).found().collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {(r.page_id, r.line_no, r.kind) for r in got} == truth


def test_compounds_stay_and_words_join_over_pages(spark):
    rows, truth = book()
    for p in range(4):
        rows[p][3][5] = "O norte-nordeste e a mão-de-obra."
    rows[4][3][4], rows[4][3][5] = "no norte-", "nordeste seco."
    rows[5][3][-4], rows[5][3][-3] = "fontes da comuni-", ""
    rows[6][3][2] = "dade da região."
    truth = {t for t in truth} | {(6, len(rows[5][3]) - 4, "hyphen")}
    repair = sr.Repair(table(spark, rows))
    assert {(r.page_id, r.line_no, r.kind) for r in repair.found().collect()} == truth
    texts = [r.text for r in repair.paragraphs().orderBy("paragraph").collect()]
    assert any("norte-nordeste seco" in t for t in texts) and any("comunidade da região" in t for t in texts)
    assert not any("GEOGRAFIA" in t or "- 5 -" in t for t in texts)


def test_edges(spark):
    rows, _ = book(pages=3)
    odd = [(50, None, 1, ["Só um texto."], None), (51, "x", None, ["Outro texto.", "12"], None), (52, "x", 2, [""], None), (53, "x", 3, ["   ", "\t"], None)]
    df = table(spark, [*rows, *odd]).unionByName(spark.createDataFrame([(60, "x", 1, None, None, None, None), (None, "x", 1, "a", None, None, None)], SCHEMA))
    repair = sr.Repair(df)
    assert {r.page_id for r in repair.found().collect()} <= {1, 2, 3, 51}
    out = repair.paragraphs().collect()
    assert {"Só um texto."} <= {r.text for r in out} and all(r.source != "\u0000" + "50" for r in out)
    empty = sr.Repair(df.limit(0))
    assert empty.found().count() == 0 and empty.paragraphs().count() == 0


@pytest.mark.parametrize(("line", "number"), [("12", (12, False)), ("- 7 -", (7, False)), ("  [iv] ", (4, True)), ("p. 3", (3, False)), ("Página 9", (9, False)), ("• 10 •", (10, False)), ("1860.", None), ("em 1860", None), ("3 / 120", (3, False)), ("", None)])
def test_page_numbers(line, number):
    assert sr.page_number(line) == number


def test_misread_numbers_before_a_mark_and_in_ranges(spark):
    rows, truth = book()
    rows[1][3][4] = "A região foi ocupada em 1g63!"
    rows[2][3][4] = "A cooperativa (l812-1834) cresceu."
    rows[3][3][4] = "A comunidade de 1860! E de 1812-1834!"
    truth |= {(2, 4, "misread"), (3, 4, "misread")}
    repair = sr.Repair(table(spark, rows))
    assert {(r.page_id, r.line_no, r.kind) for r in repair.found().collect()} == truth
    text = "\n".join(r.text for r in repair.paragraphs().collect())
    assert "em 1963!" in text and "(1812-1834)" in text


def test_short_words_and_words_of_many_signs(spark):
    rows, truth = book()
    lines = {1: "A seca d0 trabalho.", 2: "A região d| comunidade.", 3: "A c00p3ra7ivas.", 4: "A co0perafivas.", 5: "A cooperativas e d!"}
    for p, line in lines.items():
        rows[p][3][4] = line
    for p in (0, 6, 7):
        rows[p][3][6] = "do da di " * 4 + "cooperativas " * 3 + "."
    truth |= {(p + 1, 4, "misread") for p in lines}
    assert {(r.page_id, r.line_no, r.kind) for r in sr.Repair(table(spark, rows)).found().collect()} == truth


def test_titles_on_few_pages_and_on_both_sides(spark):
    few, _ = book("poucas.pdf", 24)
    sides, _ = book("dois.pdf", 12)
    truth = set()
    for row in few:
        # titles on every third page only, the book's and a chapter's by turns
        row[3][0] = "" if row[0] % 3 else ("GEOGRAFIA DO VALE" if row[0] % 2 else "CAPÍTULO 1 – A ÁGUA DOCE")
    for row in sides:
        row[0] += 100
        row[3][0] = "GEOGRAFIA DO VALE"
        row[3].insert(-1, "CAPÍTULO 1 – A ÁGUA DOCE")
    for row in few + sides:
        truth |= {(row[0], i) for i, line in enumerate(row[3]) if line.isupper()}
    got = {(r.page_id, r.line_no) for r in sr.Repair(table(spark, few + sides)).found().where("kind = 'header'").collect()}
    assert got == truth


def test_variants():
    assert "ciclo" in {v for v, _ in sr._variants("cic1o")} and "dinâmica" in {v for v, _ in sr._variants("dinârnica")} and "geral" in {v for v, _ in sr._variants("gera!")}


def test_distance():
    assert [sr.distance("abc", b, 2) for b in ("abc", "abd", "ab", "xyz")] == [0, 1, 1, 3]
