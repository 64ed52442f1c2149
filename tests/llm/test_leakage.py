"""Leaked passages against a search through all windows."""

import random
import re
import unicodedata

import pytest

from quillon.llm import leakage


def words(text):
    return re.findall(r"[^\W_]+", "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower())


def plain(docs, items, n):
    out = {}
    for d, text in docs:
        w = words(text or "")
        for item, passages in items:
            for p in passages or ():
                q = words(p or "")
                best = 0
                for i in range(len(w)):
                    for j in range(len(q)):
                        k = 0
                        while i + k < len(w) and j + k < len(q) and w[i + k] == q[j + k]:
                            k += 1
                        best = max(best, k)
                if best >= n:
                    out[item, d] = max(best, out.get((item, d), 0))
    return out


@pytest.mark.parametrize("n", [3, 4, 7, 12])
def test_against_all_windows(spark, n):
    r = random.Random(n)
    pool = ["água", "Não", "x2", "ação", "rio", "é", "b"]
    items = [(f"i{k}", [" ".join(r.choice(pool) for _ in range(r.randint(1, 30))) for _ in range(r.randint(0, 2))]) for k in range(8)] + [("none", None)]
    items.append(("twin", items[0][1]))
    docs = []
    for d in range(30):
        parts = [" ".join(r.choice(pool) for _ in range(r.randint(0, 15)))]
        source = r.choice([p for _, ps in items if ps for p in ps])
        cut = source.split()[r.randint(0, 3) :]
        parts.append(r.choice([" ", ", ", "\n", "  –  "]).join(cut).upper() if r.random() < 0.5 else unicodedata.normalize("NFD", " ".join(cut)))
        docs.append((d, " | ".join(parts)))
    docs += [(100, None), (101, ""), docs[0]]
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, words int")
    ev = spark.createDataFrame(items, "item_id string, relevant_texts array<string>")
    got = leakage.leaked_passages(df, ev, min_words=n).collect()
    assert {(r.item_id, r.doc_id): r.words for r in got} == plain(docs, items, n)
    text = dict(docs)
    for r in got:
        assert len(words(text[r.doc_id][r.start : r.stop])) == r.words


def test_several_automata_and_other_fields(spark, monkeypatch):
    monkeypatch.setattr(leakage, "AUTOMATON_CHARS", 10)
    ev = spark.createDataFrame([("a", "um dois três quatro", ["x"]), ("b", "cinco seis sete oito", None), (None, "um dois três quatro", None)], "item_id string, query string, relevant_texts array<string>")
    docs = spark.createDataFrame([(1, "Um, dois; três quatro e cinco seis sete oito")], "doc_id bigint, text string")
    assert {(r.item_id, r.field) for r in leakage.leaked_passages(docs, ev, ("relevant_texts", "query"), 4).collect()} == {("a", "query"), ("b", "query")}
    assert leakage.leaked_passages(docs, ev.limit(0)).count() == 0 and leakage.leaked_passages(docs.limit(0), ev).count() == 0
