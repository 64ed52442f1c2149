"""Vectors, outline, chunking, dialogue, reports, sampling, links, components."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.config import ChunkConfig
from quillon.operators import chunking, components, dialogue, genmetrics, links, outline, reports, sampling, vectors
from quillon.plans import catalog


def unit_rows(n, dim=16, seed=1):
    m = np.random.default_rng(seed).normal(size=(n, dim))
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


@pytest.fixture(scope="module")
def vecs(spark):
    m = unit_rows(400)
    return m, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id bigint, embedding array<float>").repartition(5)


def brute(m, ids, k):
    s = m.astype(np.float64) @ m.astype(np.float64).T
    return {(q, c) for q in ids for c in [j for j in sorted(range(len(m)), key=lambda j: (-s[q, j], j)) if j != q][:k]}


def test_exact_search(spark, vecs):
    m, df = vecs
    got = vectors.top_k(df, df.where("vec_id % 20 = 0"), 7).collect()
    assert {(r.qid, r.cid) for r in got} == brute(m, range(0, 400, 20), 7)
    assert vectors.top_k(df, df, 0).count() == 0


def test_exact_search_in_several_blocks(spark, vecs, monkeypatch):
    m, df = vecs
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 6)
    got = vectors.top_k(df, df.where("vec_id % 20 = 0"), 3).collect()
    assert {(r.qid, r.cid) for r in got} == brute(m, range(0, 400, 20), 3)


def test_exact_search_with_repeated_rows(spark, vecs):
    m, _ = vecs
    near = [int(i) for i in np.argsort(-(m[:200].astype(np.float64) @ m[0].astype(np.float64)))[1:3]]
    rows = [(i, v.tolist()) for i, v in enumerate(m[:200])] + [(i, m[i].tolist()) for i in near for _ in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1)
    one = {(r.qid, r.cid) for r in vectors.top_k(df, df.where("vec_id % 20 = 0"), 7).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    many = {(r.qid, r.cid) for r in vectors.top_k(df, df.where("vec_id % 20 = 0"), 7).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert one == many == brute(m[:200], range(0, 200, 20), 7)


def test_approximate_search_recall(spark, vecs):
    m, df = vecs
    want = brute(m, range(0, 400, 20), 10)
    got = {(r.qid, r.cid) for r in vectors.approximate_top_k(df, df.where("vec_id % 20 = 0"), 10, cells=12).collect()}
    assert len(got & want) / len(want) >= 0.9


def test_approximate_search_recall_as_registered(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, m = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    want = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = np.where(ids == ids[i], -np.inf, m @ m[i])
        want[int(ids[i])] = set(ids[np.lexsort((ids, -s))[:10]].tolist())
    got = {}
    for r in catalog.queries()["approximate_search"](spark, folder).collect():
        got.setdefault(r.qid, set()).add(r.cid)
    assert set(got) == set(want) and all(len(c) == 10 for c in got.values())
    assert sum(len(got[q] & want[q]) for q in want) / (10 * len(want)) >= 0.9


def test_vectors_with_nulls(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [1.0, 0.0]), (3, [0.5, None]), (4, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert {(r.qid, r.cid) for r in vectors.top_k(df, df, 5).collect()} == {(1, 4), (4, 1)}


def test_signature():
    vectors.check_signature(None, "m")
    vectors.check_signature("m\n", "m")
    with pytest.raises(vectors.EmbeddingMismatchError):
        vectors.check_signature("other", "m")


def test_outline_resets(spark):
    text = ["Unidade 1: A", "corpo", "Capítulo 1: B", "1.1 Tópico", "corpo", "Unidade 2: C", "corpo", "2.1 Outro"]
    pages = spark.createDataFrame([("s", i, i, t) for i, t in enumerate(text)], "source string, page int, page_key int, text string")
    got = outline.sections(pages).orderBy("section").collect()
    assert [(r.unit, r.chapter, r.topic, r.level) for r in got] == [
        ("Unidade 1: A", None, None, 1), ("Unidade 1: A", "Capítulo 1: B", None, 2), ("Unidade 1: A", "Capítulo 1: B", "1.1 Tópico", 3), ("Unidade 2: C", None, None, 1), ("Unidade 2: C", None, "2.1 Outro", 3),
    ]
    assert got[0].text == "Unidade 1: A\ncorpo"
    assert got[2].breadcrumb == "Unidade 1: A > Capítulo 1: B > 1.1 Tópico"


def test_outline_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(outline, "STRETCH", 2)
    test_outline_resets(spark)


def test_contents_pages_are_skipped(spark):
    page = "\n".join(["Um ..... 1", "Dois ..... 2", "Três ..... 3", "a", "b", "c"])
    pages = spark.createDataFrame([("s", 1, 1, page), ("s", 2, 2, None)], "source string, page int, page_key int, text string")
    assert outline.sections(pages).count() == 0


def test_tiny_sections_merge(spark):
    rows = [("a", None, 0, 1, "x", None, None, 1, "x", "um dois"), ("a", None, 1, 1, "y", None, None, 1, "y", "três"), ("b", None, 0, 1, "z", None, None, 1, "z", "quatro")]
    df = spark.createDataFrame(rows, "source string, document int, section int, page int, unit string, chapter string, topic string, level int, breadcrumb string, text string")
    assert {(r.source, r.unit, r.text) for r in outline.merge_tiny(df, 1000).collect()} == {("a", "x", "um dois\n\ntrês"), ("b", "z", "quatro")}
    assert outline.merge_tiny(df, 1).count() == 3


def test_packing_rules():
    r = random.Random(5)
    for _ in range(300):
        parts = [" ".join([f"s{i}"] * r.randint(1, 40)) for i in range(r.randint(0, 25))]
        config = ChunkConfig(min_tokens=r.randint(1, 30), max_tokens=r.randint(20, 60), overlap_tokens=r.choice([0, 5, 20]))
        packs = [sorted({int(w[1:]) for w in p.split()}) for p in chunking.pack_sentences(parts, config)]
        # consecutive sentences, none left out, order kept
        assert all(p == list(range(p[0], p[-1] + 1)) for p in packs)
        assert sorted({i for p in packs for i in p}) == list(range(len(parts)))
        for before, after in zip(packs, packs[1:]):
            shared = set(before) & set(after)
            assert before[-1] < after[-1] and after[0] <= before[-1] + 1
            assert not shared or config.overlap_tokens
            # more than one shared sentence only within the overlap
            assert len(shared) < 2 or sum(chunking.estimate(parts[i]) for i in shared) <= config.overlap_tokens
        sizes = [chunking.estimate(p) for p in parts]
        for k, p in enumerate(packs[:-1]):
            # over the limit only alone, or as long as too small; the overlap, one sentence at least, comes on top
            new = [i for i in p if not k or i > packs[k - 1][-1]]
            assert sum(sizes[i] for i in new) <= config.max_tokens or len(new) == 1 or sum(sizes[i] for i in p[:-1]) < config.min_tokens


def test_chunk_documents(spark):
    long = " ".join(["Esta frase tem nove palavras contando com esta aqui."] * 30)
    rows = [(1, "a.txt", "Uma frase curta."), (2, "a.txt", ""), (3, None, long), (4, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string")
    got = chunking.chunk(docs, ChunkConfig.of_chars(200)).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("tokens").alias("t")).collect()
    by = {r.doc_id: r for r in got}
    assert set(by) == {1, 3} and by[1].n == 1 and by[3].n > 1


def test_history(spark):
    said = [("s", i, "user" if i % 2 else "assistant", f"m{i}") for i in range(1, 9)] + [("s", 9, "system", "x")]
    df = spark.createDataFrame(said, "session_id string, turn int, role string, content string")
    assert [r.turn for r in dialogue.trim_history(df, 2).orderBy("turn").collect()] == [5, 6, 7, 8]
    flags = {r.turn: r.follow_up for r in dialogue.follow_ups(spark.createDataFrame([("s", 1, "user", "continue"), ("s", 2, "assistant", "x"), ("s", 3, "user", "Continue por favor"), ("s", 5, "user", None)], df.schema)).collect()}
    assert flags == {1: False, 3: True, 5: False}


@pytest.mark.parametrize(("longest", "statuses"), [(3500 + 5 * 40, None), (200, ["whole", "cut"])])
def test_context_packing(spark, longest, statuses):
    rows = [(1, i + 1, "x" * n, "dir/a.pdf", "", 0.5) for i, n in enumerate([90, 300, 100])]
    df = spark.createDataFrame(rows, "qid int, rank int, text string, source string, breadcrumb string, score double")
    got = dialogue.pack_context(df, longest=longest, least_rest=10).orderBy("rank").collect()
    assert [r.status for r in got] == (statuses or ["whole"] * 3)
    assert got[0].entry.startswith("[fonte: a.pdf | relevância: 0.50]\n")
    assert sum(len(r.entry) for r in got) <= longest + 1


def test_latencies(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 21)] + [("b", None)], "k string, v double")
    got = reports.latencies(df, "v", "k").collect()
    assert [(r.k, r.n, r.p50, r.p95) for r in got] == [("a", 20, 11.0, 20.0)]


def test_dedup_keeps_the_first(spark):
    df = spark.createDataFrame([(2, "x"), (1, "x"), (3, None), (4, "y")], "i int, t string")
    assert {r.i for r in reports.first_of_text(df, "t", ["i"]).collect()} == {1, 4}


def test_styled_lines(spark):
    spans = [("s", 1, 1, 1, "Um ", 16, "A", 12.0), ("s", 1, 1, 2, "dois", 0, "B Bold", 14.0), ("s", 1, 2, 1, "três", 0, "A", 11.0)]
    df = spark.createDataFrame(spans, "source string, page int, line_no int, span_no int, text string, flags int, font string, size double")
    assert [(r.text, r.bold, r.size) for r in reports.styled_lines(df).orderBy("line_no").collect()] == [("Um dois", True, 14.0), ("três", False, 11.0)]


def test_rouge_by_brute_force(spark):
    from itertools import combinations

    r = random.Random(2)
    for _ in range(50):
        a, b = [[r.choice("abc") for _ in range(r.randint(0, 7))] for _ in range(2)]
        subs = {c for n in range(len(a) + 1) for c in combinations(a, n)} & {c for n in range(len(b) + 1) for c in combinations(b, n)}
        assert genmetrics.common_length(a, b) == max(map(len, subs))
    df = spark.createDataFrame([("a b c", "b c d"), (None, "x")], "a string, b string").select(genmetrics.rouge_l("a", "b").alias("r"))
    assert [round(x.r.f1, 6) for x in df.collect()] == [0.666667, 0.0]


def test_tfidf(spark):
    df = spark.createDataFrame([(1, "a b c", "b c d"), (2, None, "x")], "k int, a string, b string")
    assert {r.k: round(r.similarity, 6) for r in genmetrics.tfidf_similarity(df, "k", "a", "b").collect()} == {1: 0.503103, 2: 0.0}


def test_chunk_groups(spark):
    rows = [(f"c{u}{i}", "x" * 250, f"u{u}", None, i) for u in range(3) for i in range(5)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, unit string, chapter string, page int")
    one = sampling.chunk_groups(df, 1, 3).join(df, "chunk_id").collect()
    assert len({r.unit for r in one}) == 3
    far = spark.createDataFrame([("a", "x" * 250, "u", "c", 1), ("b", "x" * 250, "u", "c", 20), ("c", "x" * 250, "u", "c", 21)], df.schema)
    assert {r.chunk_id for r in sampling.chunk_groups(far, 2, 5).collect()} == {"b", "c"}
    assert sampling.chunk_groups(far.where("chunk_id <> 'c'"), 3, 5).count() == 0
    assert sampling.chunk_groups(df, 2, 4).orderBy("group_no", "position").collect() == sampling.chunk_groups(df, 2, 4).orderBy("group_no", "position").collect()


def test_links(spark):
    items = spark.createDataFrame([("i1", "curto"), ("i2", "x" * 200), ("i3", " "), (None, "curto"), ("i4", None)], "item_id string, passage string")
    chunks = spark.createDataFrame([(1, "um texto curto aqui"), (2, "x" * 120 + "y"), (3, None)], "chunk_id bigint, text string")
    assert {(r.item, r.chunk) for r in links.link_passages(items, chunks).collect()} == {("i1", 1), ("i2", 2)}


def test_components_against_union_find(spark):
    r = random.Random(4)
    pairs = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = components.connected_components(spark.createDataFrame(pairs + [(None, 3)], "a int, b int")).collect()
    assert {x.node: x.component for x in got} == {n: find(n) for n in root}


def test_outline_across_stretches(spark, monkeypatch):
    pages = [(f"k{p}", "s" if p % 2 else None, p // 2, f"Unidade {p}: A\ncorpo" if p % 10 < 2 else (f"Capítulo {p}: B\ncorpo" if p % 6 < 2 else f"{p % 9}.1 Tópico\ncorpo {p}")) for p in range(40)]
    df = spark.createDataFrame(pages, "page_key string, source string, page int, text string")
    want = sorted(map(repr, outline.sections(df).collect()))
    monkeypatch.setattr(outline, "STRETCH", 3)
    assert sorted(map(repr, outline.sections(df).collect())) == want and len(want) >= 40


def test_bold_lines_are_compared_composed(spark):
    df = spark.createDataFrame([("k", "s", 1, "Introduc\u0327a\u0303o Geral\ncorpo", [("Introdução Geral", 20.0)], 10.0)], "page_key string, source string, page int, text string, bold_lines array<struct<text:string,size:double>>, body_size double")
    assert [r.level for r in outline.lines(df).orderBy("line_no").collect()] == [1, 0]


def test_search_keeps_the_best_across_batches(spark):
    rng = np.random.default_rng(11)
    m = rng.normal(size=(900, 6)).round(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id bigint, embedding array<double>").coalesce(2)
    got = {(r.qid, r.cid) for r in vectors.top_k(df, df.where("vec_id % 20 = 0"), 5).collect()}
    want = set()
    for q in range(0, 900, 20):
        s = m @ m[q]
        order = sorted((i for i in range(900) if i != q), key=lambda i: (-s[i], i))
        # scores equal but for rounding may change places
        want |= {(q, i) for i in order if s[i] >= s[order[4]] - 1e-9}
    assert got <= want and len(got) == 45 * 5
    assert vectors.approximate_top_k(df.limit(0), df, 5).count() == 0 and vectors.approximate_top_k(df, df.limit(0), 5).count() == 0


def test_generated_sets(spark):
    from quillon.operators import datasets
    from quillon.providers import CountingQuestion

    rows = [(f"c{i}", "x" * (200 + i), "u", None, i, None if i else "a > b") for i in range(12)] + [("n", None, "u", None, 1, None), (None, "y" * 300, None, None, None, None)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, unit string, chapter string, page int, breadcrumb string")
    got = datasets.generated_items(df, CountingQuestion(), ["Não?"], 3, 2, 1).orderBy("id").collect()
    assert [r.id for r in got] == [f"q{i:04d}" for i in range(len(got))] and got[-1].category == "negative" and not got[-1].answerable
    assert all(len(r.relevant_chunks) == r.n_source_chunks for r in got[:-1])
    assert datasets.generated_items(df.limit(0), CountingQuestion(), [], 3, 2, 1).count() == 0
