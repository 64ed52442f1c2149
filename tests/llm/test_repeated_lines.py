"""Repeated lines against plain code, and the cases at the edges."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.llm import repeated_lines as rl

SCHEMA = "doc_id bigint, text string, source string"


def plain(rows, least):
    seen, where = collections.defaultdict(set), collections.defaultdict(set)
    for i, text, source in rows:
        for k, line in enumerate(text.split("\n") if i is not None and text is not None and source is not None else ()):
            norm = re.sub(r"\d+", "0", re.sub(r"\s+", " ", line.strip()).lower())
            if norm:
                seen[source, norm].add(i)
                where[source, norm].add((i, k))
    return {w for key, ids in seen.items() if len(ids) >= least for w in where[key]}


def found(spark, rows, least=6):
    got = rl.repeated_lines(spark.createDataFrame(rows, SCHEMA), least).collect()
    assert len(got) == len({(r.doc_id, r.line_no) for r in got})
    return {(r.doc_id, r.line_no) for r in got}


def test_against_plain_code(spark):
    r = random.Random(1)
    long = [" ".join(r.choice(["um", "Dois", "três", "QUATRO", "5", "sextas-feiras"]) for _ in range(40)) for _ in range(6)]
    short = ["© 2023 Casa.", "Leia  também", "", "   ", "pág. 12", "ÁGUA"]
    vary = lambda s: r.choice([s, s.upper(), f"  {s}\t", re.sub(r"\d+", "777", s), s.replace(" ", "  ")])
    rows = []
    for i in range(120):
        parts = [vary(r.choice(long + short)) for _ in range(r.randint(0, 8))] + [f"eigen {i} " * r.randint(0, 30)]
        r.shuffle(parts)
        rows.append((i, r.choice(["\n", "\r\n"]).join(parts), f"s{r.randint(0, 5)}"))
    rows += rows[:5]
    want = plain(rows, 6)
    assert want and found(spark, rows) == want


def test_edges(spark):
    rows = [(i, "igual\n\núnica " + "x" * i, "s") for i in range(6)] + [(None, "igual", "s"), (7, None, "s"), (8, "", "s"), (9, "igual", None), (10, "igual", "t")]
    assert found(spark, rows) == {(i, 0) for i in range(6)}
    assert found(spark, []) == set()
    # one document that repeats a line, and one id given twice, count once
    assert found(spark, [(1, "a\n" * 9, "s")] * 7) == set()


def test_very_long_text(spark):
    line = "palavra " * 40_000
    rows = [(i, f"{line}\nfim {'x' * i}", "s") for i in range(6)]
    assert found(spark, rows) == {(i, 0) for i in range(6)}


def test_texts_come_out_without_the_lines(spark):
    rows = [(i, f"aviso {i}\r\ncorpo {'x' * i}\nAVISO 3", "s") for i in range(6)] + [(None, "aviso 1", "s"), (9, None, None), (10, "", "s")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", line_no int, clean_text string")
    got = {r.doc_id: r for r in rl.remove_repeated_lines(df).collect()}
    assert [got[i].clean_text for i in range(6)] == [f"corpo {'x' * i}" for i in range(6)]
    assert got[3].lines_removed == 2 and got[9].clean_text is None and got[10].clean_text == "" and got[None].clean_text == "aviso 1"


@pytest.mark.parametrize("n", [1, 15, 16, 47, 48, 49, 200, 1000])
def test_chunks_cover_lines_and_depend_on_them_alone(n):
    text = ("abcdefghij klmnop qrstuv " * 60)[:n]
    alone = rl._cut([text])
    within = rl._cut(["outra linha", f"antes\n{text}\ndepois"])
    assert [c for line, c in zip(alone[4], alone[5]) if line == 0] == [c for line, c in zip(within[4], within[5]) if line == 2]


def test_passages_over_line_ends(spark):
    import re

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    notice = "\n".join(" ".join(word() for _ in range(9)) for _ in range(8))
    rows = []
    for i in range(40):
        own = [" ".join(word() for _ in range(r.randint(3, 30))) for _ in range(6)]
        own.insert(r.randint(0, 6), notice.upper() if i % 3 else notice.replace(" ", "  ")) if i < 20 else None
        rows.append((i, r.choice(["\n", "\r\n"]).join(own), "a" if i != 19 else "b"))
    rows += [rows[0], (50, None, "a"), (51, "", "a"), (None, notice, "a"), (52, notice, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = rl.repeated_passages(df).collect()
    by = {d: (t, s) for d, t, s in rows if d is not None}
    norm = lambda x: re.sub(r"\s+", " ", x.lower()).strip()
    for x in got:
        part = norm(by[x.doc_id][0][x.start : x.stop])
        assert sum(part in norm(t or "") for t, s in by.values() if s == "a") >= 6 and len(part) >= 40
    covered = {i: sum(x.stop - x.start for x in got if x.doc_id == i) for i in range(19)}
    assert all(c > 0.5 * len(notice) for c in covered.values()) and not any(x.doc_id >= 19 for x in got)
    assert any("\n" in by[x.doc_id][0][x.start : x.stop] for x in got) and len({(x.doc_id, x.start) for x in got}) == len(got)
    spans = df.where("doc_id = 3").limit(1).selectExpr("text", "array(named_struct('start', 2, 'stop', 5), named_struct('start', 7, 'stop', 8)) AS s")
    t = by[3][0]
    assert spans.select(rl.cut_out(F.col("text"), F.col("s")).alias("x")).first().x == t[:2] + t[5:7] + t[8:]
    assert rl.repeated_passages(df.limit(0)).count() == 0
    clean = {r.doc_id: r for r in rl.remove_repeated_passages(df.withColumn("start", F.lit(1))).where("doc_id IS NOT NULL").collect()}
    assert len(clean[3].clean_text) == len(by[3][0]) - covered[3] and clean[30].clean_text == by[30][0] and clean[50].clean_text is None and clean[3].start == 1
