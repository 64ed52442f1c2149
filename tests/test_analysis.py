"""Links, fallbacks, failures, traces and details on small tables with nulls, repeats and nothing at all."""

import random

from pyspark.sql import functions as F

from quillon.operators import analysis, links, metrics

TRACE = "stage_no int, stage string, qid bigint, cid bigint, rank int, score double"
STAGES = ("first", "last")


def brute(passages, chunks):
    heads = [(c, t.strip()[:120]) for c, t in chunks if c is not None and t and t.strip()]
    return {(i, c) for i, p in passages if i is not None and p and p.strip() for c, h in heads if p.strip()[:120] in h}


def test_links_against_all_pairs(spark):
    r = random.Random(3)
    text = lambda n: "".join(r.choice("ab ") for _ in range(n))
    chunks = [(i, text(r.randint(0, 200))) for i in range(80)] + [(3, "aab"), (None, "aab"), (90, None), (91, "á" * 130)]
    passages = [(f"p{i}", text(r.choice((1, 2, 3, 5, 9, 17, 40)))) for i in range(60)] + [(f"c{c}", t) for c, t in chunks[:20]] + [("n", None), (None, "a"), ("x", "á" * 120), ("p1", "ab")]
    got = links.link_passages(spark.createDataFrame(passages, "item_id string, passage string"), spark.createDataFrame(chunks, "chunk_id bigint, text string")).collect()
    assert {(x.item, x.chunk) for x in got} == brute(passages, chunks) and len(got) == len(brute(passages, chunks))


def test_links_of_many_passages_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(links, "FEW", 0)
    items = spark.createDataFrame([("a", "bc"), ("b", "abcd")], "item_id string, passage string")
    assert {(x.item, x.chunk) for x in links.link_passages(items, spark.createDataFrame([(1, "abcd")], "chunk_id bigint, text string")).collect()} == {("a", 1), ("b", 1)}


def test_linked_benchmark_keeps_what_is_linked(spark):
    kind = "id string, relevant_texts array<string>, relevant_chunks array<struct<chunk_id:string,relevance:int>>, chunk string"
    items = spark.createDataFrame([("a", ["um texto"], None, "k"), ("b", ["um texto"], [("own", 1)], "k"), ("c", None, [], "k"), ("d", ["nada"], [], "k"), ("e", [None, " "], [], None)], kind)
    chunks = spark.createDataFrame([("z", "um texto longo"), ("y", " um texto"), ("", "um texto"), (None, "um texto")], "chunk_id string, text string")
    got = {r.id: [tuple(c) for c in r.relevant_chunks or ()] for r in analysis.link_benchmark(items, chunks).collect()}
    assert got == {"a": [("y", 3), ("z", 3)], "b": [("own", 1)], "c": [], "d": [], "e": []}
    assert analysis.link_benchmark(items, chunks.limit(0)).columns == items.columns


def test_fallback_on_beginnings(spark):
    results = spark.createDataFrame([(1, "c1", "Texto um"), (2, "c2", " Texto dois "), (3, "c3", "Outro"), (4, "Sem id", "Sem id")], "qid bigint, cid string, text string")
    qrels = spark.createDataFrame([(1, "c1", 3), (2, "x", 2), (3, "x", 2)], "qid bigint, cid string, relevance int")
    passages = spark.createDataFrame([(1, "Outro"), (2, "Texto dois"), (3, "Texto um"), (4, "Sem id"), (5, None)], "qid bigint, passage string")
    got = {(r.qid, r.cid, r.relevance) for r in analysis.effective_qrels(results, qrels, passages).collect()}
    assert got == {(1, "c1", 3), (2, "Texto dois", 1), (3, "x", 2), (4, "Sem id", 1)}


def test_failures_and_their_summary(spark):
    failures = spark.createDataFrame([(1, True, 1, None), (2, False, 3, "first"), (3, False, None, None)], "qid bigint, hit boolean, first_rank int, failure_stage string")
    items = spark.createDataFrame([(1, "x"), (2, None)], "qid bigint, category string")
    assert {r.qid for r in analysis.failure_records(failures, items, failures_only=True).collect()} == {2, 3}
    assert [r.category for r in analysis.failure_records(failures, items, query_id=1).collect()] == ["x"]
    got = {(r.part, r.name): (r.n, r.hits) for r in analysis.failure_summary(analysis.failure_records(failures, items)).collect()}
    assert got == {("all", ""): (3, 1), ("stage", "first"): (1, 0), ("stage", "nothing expected"): (1, 0), ("category", "x"): (1, 1), ("category", "uncategorized"): (2, 0)}
    assert analysis.failure_summary(analysis.failure_records(failures.limit(0), items)).where("n > 0").count() == 0


def test_traces(spark):
    trace = spark.createDataFrame([(0, "first", 1, c, c, 1.0 / c) for c in range(1, 8)] + [(1, "last", 1, 2, 1, 0.5)], TRACE)
    texts = spark.createDataFrame([(1, "nada\naqui"), (2, "Agulha"), (3, None)], "cid bigint, text string")
    shots = analysis.snapshots(trace, texts)
    assert {r.cid: r.preview for r in shots.where("stage_no = 0").collect()}[1] == "nada aqui"
    queries = spark.createDataFrame([(1, "q"), (2, None)], "qid bigint, query string")
    told = {r.qid: r.summary for r in analysis.trace_summaries(shots, queries, STAGES).collect()}
    assert "[first] 7 candidates" in told[1] and "... and 2 more" in told[1] and told[1].endswith("FINAL: 1 results") and told[2].endswith("FINAL: 0 results")
    needles = spark.createDataFrame([(1, "AGULHA"), (2, "x"), (3, None)], "qid bigint, needle string")
    got = {(r.qid, r.stage): (r.candidates, r.position) for r in analysis.needle_positions(trace, texts, needles, STAGES).collect()}
    assert got == {(1, "first"): (7, 2), (1, "last"): (1, 1), (2, "first"): (0, None), (2, "last"): (0, None), (3, "first"): (0, None), (3, "last"): (0, None)}
    assert {r.qid: r.trace for r in analysis.trace_json(trace, queries, STAGES).collect()}[2] == '{"stages":[{"stage":"first","count":0},{"stage":"last","count":0}],"final_count":0}'


def test_details(spark):
    chunks = spark.createDataFrame([("a", "x" * 201, "s", 1, 9)], "chunk_id string, text string, source string, page int, qid int")
    qrels = spark.createDataFrame([(1, "a", 3), (1, "b", None), (1, "c", 0)], "qid bigint, cid string, relevance int")
    got = {r.cid: (r.relevance, len(r.preview), r.source, r.page) for r in analysis.expected_chunks(qrels, chunks).collect()}
    assert got == {"a": (3, 201, "s", 1), "b": (3, 0, "", None), "c": (0, 0, "", None)}
    results = spark.createDataFrame([(1, "a", 1, 0.123456), (1, "c", 2, 0.1)], "qid bigint, cid string, rank int, score double")
    assert [(r.cid, r.score, r.is_relevant) for r in analysis.retrieved_chunks(results, qrels, chunks).orderBy("rank").collect()] == [("a", 0.1235, True), ("c", 0.1, False)]


def test_reports(spark):
    a = spark.createDataFrame([("x", 0.5), ("y", None)], "k string, m double")
    b = spark.createDataFrame([("x", 0.75), ("z", 1.0)], "k string, m double")
    assert {r.k: r.delta for r in analysis.deltas(a, b, "k", ["m"]).collect()} == {"x": 0.25, "y": None, "z": None}
    runs = spark.createDataFrame([("a", True, 1.0), ("a", None, None), ("b", True, 2.0), ("c", False, 9.0)], "m string, ok boolean, s double")
    assert [(r.model, r.n, r.most_accurate, r.fastest) for r in analysis.model_ranking(runs, "m", "ok", "s").orderBy("place").collect()] == [("b", 1, True, False), ("a", 2, True, False), ("c", 1, False, True)]
    lines = [r.line for r in analysis.metric_lines(spark.createDataFrame([(0.5, None)], "recall double, hit double"), ("recall", "hit"), 4).orderBy("line_no").collect()]
    assert lines == ["recall       0.5000 ##", "hit          0.0000 "]
    checked = spark.createDataFrame([(1, True), (2, False)], "qid int, passed boolean")
    assert metrics.guardrail_rate(checked).first()[:3] == (2, 1, 0.5) and metrics.guardrail_rate(checked.limit(0)).first()[:3] == (0, 0, 1.0)
    report = analysis.chunk_reports(
        spark.createDataFrame([(1, 2, 1, " x ", None, 0.5)], "qid int, cid int, rank int, text string, source string, score double"), spark.createDataFrame([(1, 2, "cut")], "qid int, cid int, status string"),
        spark.createDataFrame([(1, False)], "qid int, relevant boolean"), spark.createDataFrame([(1, "q"), (2, None)], "qid int, query string"),
    )
    assert {r.qid: r.report for r in report.collect()} == {1: "q\n[#1] score=0.500 cut (1 chars) desconhecido\noff topic", 2: "\nnothing found"}


def test_neighbours_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(metrics, "STRETCH", 3)
    rows = [(i, s) for i in range(0, 40, 3) for s in ("a",)] + [(i, None) for i in range(1, 20, 4)]
    got = {(r.qid, r.cid) for r in metrics.neighbour_qrels(spark.createDataFrame(rows, "id bigint, source string"), "id", "source", "id").collect()}
    want = set()
    for s in ("a", None):
        ids = sorted(i for i, x in rows if x == s)
        want |= {(i, j) for k, i in enumerate(ids) for j in ids[max(0, k - 1) : k + 2]}
    assert got == want


def test_latencies_against_sorting(spark):
    from quillon.operators import reports

    r = random.Random(5)
    rows = [(g, float(r.choice((1, 2, 2, 2, r.randint(0, 500))))) for g in ("a", "b", None) for _ in range(r.randint(1, 700))] + [("c", 7.0), ("a", None)]
    got = {x.g: (x.n, x.p50, x.p95, x.p99, x.least, x.largest) for x in reports.latencies(spark.createDataFrame(rows, "g string, v double"), "v", "g").collect()}
    for g in ("a", "b", None, "c"):
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert got[g] == (len(v), *[v[min(len(v) * p // 100, len(v) - 1)] for p in (50, 95, 99)], v[0], v[-1])
    assert reports.latencies(spark.createDataFrame(rows, "g string, v double"), "v").first().n == len(rows) - 1


def test_earlier_messages_by_stretches(spark, monkeypatch):
    from quillon.operators import dialogue

    monkeypatch.setattr(dialogue, "STRETCH", 4)
    rows = [("s", t, "user", "e a", t) for t in range(1, 30, 2)] + [("t", 5, "user", None, 0), (None, 1, "user", "x", 0), (None, 9, "user", "x", 0)]
    got = {(r.session_id, r.turn): r.earlier for r in dialogue.with_earlier(spark.createDataFrame(rows, "session_id string, turn int, role string, content string, base int").drop("base")).collect()}
    assert got == {("s", t): i for i, t in enumerate(range(1, 30, 2))} | {("t", 5): 0, (None, 1): 0, (None, 9): 1}


def test_titles_fall_back(spark):
    from quillon.operators import dialogue
    from quillon.providers import GenerationProvider

    class Moody(GenerationProvider):
        def generate(self, prompts):
            if any("mau" in p for p in prompts):
                raise RuntimeError("no")
            return ['"Um título."' if "bom" in p else "" for p in prompts]

    rows = spark.createDataFrame([(1, "bom dia"), (2, "dia mau"), (3, "nada"), (4, None)], "i int, m string")
    assert {r.i: r.title for r in dialogue.with_titles(rows, Moody(), "m").collect()} == {1: "Um título", 2: "dia mau", 3: "nada", 4: ""}


def test_flags_of_words(spark):
    from quillon.functions import text as tx

    df = spark.createDataFrame([(" Sim ",), ("0",), ("talvez",), (None,)], "w string")
    assert [r.b for r in df.select(tx.parse_bool(F.col("w"), True).alias("b")).collect()] == [True, False, True, True]
