"""Splitting and packing: every rule on random texts, and small optima."""

import itertools
import random

import pytest

from quillon.llm import packing, structure_split as ss


def sample(r):
    parts = []
    for _ in range(r.randint(1, 12)):
        kind = r.random()
        if kind < 0.2:
            parts.append(r.choice(["# Título um", "## Parte", "Capítulo 3: Água", "1.2 Tópico", "Unidade II"]))
        elif kind < 0.4:
            parts.append("\n".join(f"- item {'x ' * r.randint(1, 15)}" for _ in range(r.randint(1, 6))))
        else:
            parts.append(" ".join("palavra " * r.randint(1, 25) + r.choice([".", "!", ";", ","]) + " Outra" for _ in range(r.randint(1, 8))))
    return r.choice(["\n", "\n\n", "\r\n"]).join(parts)


def test_rules_on_random_texts():
    r = random.Random(6)
    for _ in range(300):
        text, most, overlap = sample(r), r.randint(1, 60), r.randint(0, 30)
        spans = ss.split_spans(text, most, overlap)
        assert spans[0][0] == spans[0][1] == 0 and spans[-1][2] == len(text)
        assert all(a[2] == b[1] for a, b in itertools.pairwise(spans))
        assert all(len(text[s:e].split()) <= most for s, _, e in spans)
        assert all(text[s:c].strip() or not overlap or most == 1 for s, c, _ in spans[1:])
        shared = min(overlap, most - 1)
        assert all(len(text[s:c].split()) == min(shared, len(text[:c].split())) for s, c, _ in spans[1:])


def test_cuts_at_the_highest_boundary():
    text = "# A\n\n" + "um dois três. " * 3 + "\n\n# B\n\n" + "quatro cinco seis. " * 3
    assert [text[c:e].strip()[:3] for _, c, e in ss.split_spans(text, 12, 0)] == ["# A", "# B"]
    listed = "\n".join(f"- a b c d {i}" for i in range(4))
    assert [listed[c:e].count("- ") for _, c, e in ss.split_spans(listed, 12, 0)] == [2, 2]


@pytest.mark.parametrize("tokens", range(0, 60))
def test_word_limits(tokens):
    if tokens:
        n = ss.words_within(tokens)
        assert ss.tokens_of(n) <= tokens or n == 1
        assert ss.tokens_of(n + 1) > tokens
    assert tokens == 0 or ss.tokens_of(ss.words_for(tokens)) >= tokens


def test_pieces_of_a_table(spark):
    rows = [("a", "um " * 100, 40, 10), ("a", "um " * 100, 40, 10), ("b", "um " * 30, 40, 0), ("c", "um " * 31, 40, 0), ("d", None, 40, 0), ("e", "  ", 40, 0), ("f", "um " * 99, None, None), (None, "um", 40, 0), ("g", "um " * 31, 40, 50), ("h", "x" * 300_000, 1, 0)]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "chunk_id string, text string, max_tokens int, overlap_tokens int, piece_no int, piece string")
    got = ss.split_oversized(df).collect()
    over = {r.chunk_id for r in got if r.max_tokens is not None and r.item_tokens > r.max_tokens}
    assert over == {"a", "c", "g"}
    assert {r.chunk_id for r in got} == {"a", "b", "c", "f", "g", "h"}
    assert all(r.piece_tokens <= r.max_tokens for r in got if r.max_tokens)
    assert sorted(r.piece_no for r in got if r.chunk_id == "a") == list(range(max(r.n_pieces for r in got if r.chunk_id == "a")))
    assert all(10 <= r.shared_tokens <= 11 for r in got if r.chunk_id == "a" and r.piece_no)
    assert ss.split_oversized(df.limit(0)).count() == 0


def test_items_of_one_id_keep_their_pieces(spark):
    rows = [("a", "um dois", 40, 0), ("a", "um três", 40, 0), ("a", "um três", 40, 0), ("a", "um seis", 40, 0), ("a", "um seis", 50, 0), ("a", "um seis", None, 0)]
    got = ss.split_oversized(spark.createDataFrame(rows, "chunk_id string, text string, max_tokens int, overlap_tokens int")).collect()
    assert sorted((r.piece, r.max_tokens or 0) for r in got) == [("um dois", 40), ("um seis", 0), ("um seis", 40), ("um seis", 50), ("um três", 40)]


def test_differencing_is_a_partition_and_nearly_equal():
    r = random.Random(1)
    for _ in range(50):
        sizes, k = [r.randint(1, 100) for _ in range(r.randint(1, 40))], r.randint(1, 12)
        parts = packing.differencing(sizes, k)
        assert sorted(i for p in parts for i in p) == list(range(len(sizes))) and len(parts) <= k
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]


def test_packing_against_the_optimum():
    r = random.Random(2)

    def optimum(sizes, cap):
        for k in range(1, len(sizes) + 1):
            for to in itertools.product(range(k), repeat=len(sizes)):
                if all(sum(s for s, t in zip(sizes, to) if t == w) <= cap for w in range(k)):
                    return k

    for _ in range(25):
        sizes = [r.randint(1, 10) for _ in range(r.randint(1, 7))]
        window = packing.pack_block(sizes, 10)
        assert all(sum(s for s, w in zip(sizes, window) if w == k) <= 10 for k in set(window))
        assert len(set(window)) <= optimum(sizes, 10) + 1


def test_containers_of_a_table(spark):
    texts = [(1, "á" * 50), (2, "x" * 9), (2, "x" * 9), (3, None), (None, "x"), (4, ""), (5, "x" * 10), (6, "😀" * 5)]
    docs = spark.createDataFrame([(*t, 7, 8) for t in texts], "doc_id bigint, text string, size int, block int")
    targets = spark.createDataFrame([(1, 10), (1, 10), (2, 1000), (None, 5), (3, None)], "target_id int, capacity int")
    got = packing.pack(docs, targets, block_items=3).collect()
    fill = {}
    for r in got:
        fill[r.target_id, r.block, r.window] = fill.get((r.target_id, r.block, r.window), 0) + r.size
    assert all(s <= {1: 10, 2: 1000}[k[0]] for k, s in fill.items())
    by = {r.doc_id: r.text for r in docs.where("doc_id IS NOT NULL AND text IS NOT NULL").collect()}
    for target in (1, 2):
        for doc, text in by.items():
            parts = sorted((r.piece_no, r.start, r.stop) for r in got if r.target_id == target and r.doc_id == doc)
            assert "".join(text[s:e] for _, s, e in parts) == text and parts
    assert {(r.target_id, r.doc_id) for r in packing.split_alone(packing.pack(docs, targets)).collect()} == {(1, 1), (1, 5), (1, 6)}
    assert packing.pack(docs.limit(0), targets).count() == 0 and packing.pack(docs, targets.limit(0)).count() == 0


def test_targets_in_several_passes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * (i % 37 + 1)) for i in range(200)], "doc_id bigint, text string")
    targets = spark.createDataFrame([(t, 20 + t) for t in range(5)], "target_id int, capacity int")
    want = sorted(packing.pack(docs, targets, block_items=40).collect())
    monkeypatch.setattr(packing, "TARGETS_AT_ONCE", 2)
    got = sorted(packing.pack(docs, targets, block_items=40).collect())
    assert got == want and {r.target_id for r in got} == set(range(5))
    assert packing.split_alone(packing.pack(docs, targets)).where("target_id = 0").count() == sum(i % 37 + 2 > 20 for i in range(200))


def test_a_few_words_go_with_what_is_behind():
    text = "Ein kurzer Anfang.\n" + " ".join(["Wort"] * 30) + ".\n" + " ".join(["Ende"] * 5) + "."
    spans = ss.split_spans(text, 35, 10)
    assert len(text[spans[0][0] : spans[0][2]].split()) > 20
    assert all(len(text[s:e].split()) <= 35 for s, _, e in spans)
