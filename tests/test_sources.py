"""Files, stores, providers and streams."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.operators.vectors import EmbeddingMismatchError
from quillon.providers import FirstSentence, HashedEmbedding, OverlapScorer, embed, generate, pair_score
from quillon.sources import files, stores
from quillon.streaming import events, thoughts


def test_documents_of_a_folder(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("olá mundo", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes(b"caf\xe9")
    (tmp_path / "c.md").write_text("   ")
    (tmp_path / "d.json").write_text(json.dumps({"count": 42, "flag": True, "name": "test", "x": ["u", {"y": "v"}]}))
    (tmp_path / "e.csv").write_text("no")
    (tmp_path / "f.json").write_text("{broken")
    (tmp_path / "g.pdf").write_bytes(b"%PDF")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "h.txt").write_text("deep")
    got = {r.source: r for r in files.load_documents(spark, str(tmp_path)).collect()}
    assert {k: v.text for k, v in got.items() if v.error is None} == {"a.TXT": "olá mundo", "b.txt": "café", "d.json": "test u v"}
    assert set(k for k, v in got.items() if v.error) == {"f.json", "g.pdf"}
    assert files.load_documents(spark, str(tmp_path / "none")).count() == 0


def test_index_appends_new_texts_only(spark, tmp_path):
    path = str(tmp_path / "index")
    index = stores.VectorIndex(spark, path, "m|1")
    index.add(spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "pos int, text string"), ["pos"])
    index.add(spark.createDataFrame([(4, "y"), (5, "z")], "pos int, text string"), ["pos"])
    assert sorted(r.pos for r in index.rows().collect()) == [1, 3, 5] and index.size() == 3
    assert stores.VectorIndex(spark, path, "m|1").size() == 3
    with pytest.raises(EmbeddingMismatchError):
        stores.VectorIndex(spark, path, "other")


def test_eval_items(spark, tmp_path):
    path = tmp_path / "items.json"
    path.write_text(json.dumps([{"id": "a", "query": "q", "relevant_chunks": [{"chunk_id": "c1", "relevance": 3}, {"chunk_id": "c2", "relevance": 0}, {"chunk_id": "", "relevance": 2}]}, {"id": "b", "query": "r", "relevant_chunk_ids": ["c3"]}]))
    items = stores.read_eval_items(spark, str(path))
    assert {(r.qid, r.cid, r.relevance) for r in stores.item_qrels(items).collect()} == {("a", "c1", 3), ("b", "c3", 1)}


def test_sessions(spark, tmp_path):
    s = stores.Sessions(spark, str(tmp_path / "sessions"))
    assert s.list().count() == 0
    key = s.create("s1", now=1.0)
    s.update(key, [("user", "oi", 2.0), ("assistant", "olá", 2.0)], 2.0)
    s.set_title(key, "Título")
    s.append_turns(spark.createDataFrame([("s1", "user", "mais", 3.0), ("s2", "user", "novo", 4.0)], "id string, role string, content string, ts double"))
    assert [(r.id, r.title, r.n_messages) for r in s.list().collect()] == [("s2", "New Chat", 1), ("s1", "Título", 3)]
    assert s.delete("s1") and not s.delete("s1")
    assert [r.id for r in s.list().collect()] == ["s2"]


def test_versions():
    assert stores.next_version([]) == 1
    assert stores.next_version(["v1", "v10", "x", "v"]) == 11


def test_providers(spark):
    df = spark.createDataFrame([(1, "um dois"), (2, "um dois"), (3, None)], "i int, text string")
    provider = HashedEmbedding(8)
    vectors = embed(df, provider).orderBy("i").collect()
    assert vectors[0].embedding == vectors[1].embedding and vectors[2].embedding is None
    cache = spark.createDataFrame([(vectors[0].text_sha256, [9.0] * 8)], "text_sha256 string, embedding array<float>")
    assert embed(df, provider, cache=cache).where("i = 1").first().embedding == [9.0] * 8
    assert df.select(pair_score(OverlapScorer(), F.lit("um x"), F.col("text")).alias("s")).collect()[0].s == 0.5
    assert df.select(generate(FirstSentence(), F.lit("A b. C")).alias("g")).first().g == "A b"


@pytest.mark.parametrize(
    ("tokens", "left"),
    [
        (["Olá", ", ", "mundo"], "Olá, mundo"),
        (["<think>", "raciocínio", "</think>", "Resposta"], "Resposta"),
        (["<thi", "nk>pensando", "</th", "ink>\n\nOk", "!"], "\n\nOk!"),
        (["Antes ", "<think>", "nunca fecha"], "Antes "),
        (["a ", "<", " b"], "a < b"),
        (["fim ", "<thi"], "fim <thi"),
    ],
)
def test_thoughts(tokens, left):
    assert thoughts.visible_text(tokens) == left


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", i, t) for i, t in enumerate(["<thi", "nk>x", "</think>", "sim"])] + [("a", 9, None), ("b", 0, "fim <thi"), ("b", 1, None)]
    df = spark.createDataFrame(rows, "session_id string, seq bigint, token string")
    for n, part in enumerate((df.where("seq < 2"), df.where("seq >= 2"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/p{n}"))
    source = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = thoughts.visible_stream(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    text = lambda d: {r.session_id: r.t for r in d.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "visible"))), lambda x: x["visible"]), "").alias("t")).collect()}
    assert text(spark.read.parquet(str(tmp_path / "out"))) == text(thoughts.visible_tokens(df)) == {"a": "sim", "b": "fim <thi"}


def test_events(spark):
    df = spark.createDataFrame([("s", "um dois", "t", None), ("e", None, None, "boom")], "session_id string, answer string, title string, error string")
    got = [json.loads(r.event) for r in events.turn_events(df).where("session_id = 's'").orderBy("seq").collect()]
    assert [g["type"] for g in got] == ["token", "token", "done", "title"] and "".join(g.get("text", "") for g in got) == "um dois"
    assert [json.loads(r.event)["type"] for r in events.turn_events(df).where("session_id = 'e'").collect()] == ["error"]


def test_written_eval_items_are_read_as_they_were(spark, tmp_path):
    rows = [{"id": f"q{i}", "query": "ação\n?" if i % 2 else "[x]", "answerable": None if i == 3 else True, "relevant_chunks": [{"chunk_id": "c", "relevance": i}] if i else None, "relevant_texts": ["a", "b"] if i > 2 else None} for i in range(6)]
    items = spark.createDataFrame(rows, stores.EVAL_SCHEMA)
    stores.write_eval_items(items.coalesce(1), str(tmp_path / "one"))
    stores.write_eval_items(items.repartition(3), str(tmp_path / "three"))
    for name in ("one", "three"):
        assert sorted(stores.read_eval_items(spark, str(tmp_path / name)).collect(), key=lambda r: r.id) == items.collect()
    stores.write_eval_items(items.limit(0), str(tmp_path / "none"))
    assert stores.read_eval_items(spark, str(tmp_path / "none")).count() == 0


def test_an_index_that_cannot_be_read_is_an_empty_store(spark, tmp_path):
    index = stores.VectorIndex(spark, str(tmp_path / "i"), "m")
    assert not index.load() and index.size() == 0
    index.add(spark.createDataFrame([(1, "x")], "pos int, text string"), ["pos"])
    assert index.load() and index.size() == 1
    for p in (tmp_path / "i" / "rows").glob("*.parquet"):
        p.write_bytes(b"broken")
        (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    assert not stores.VectorIndex(spark, str(tmp_path / "i"), "m").load()


def test_embedding_cache(spark, tmp_path):
    cache = stores.EmbeddingCache(spark, str(tmp_path / "c"))
    assert cache.rows() is None
    texts = spark.createDataFrame([(1, "um"), (2, "um"), (3, None), (4, "dois")], "i int, text string")
    cache.add(embed(texts.where("i < 4"), HashedEmbedding(8)))
    first = {r.text_sha256: r.embedding for r in cache.rows().collect()}
    cache.add(embed(texts, HashedEmbedding(8), cache=cache.rows()))
    both = {r.text_sha256: r.embedding for r in cache.rows().collect()}
    assert len(first) == 1 and len(both) == 2 and first.items() <= both.items()


def test_many_sessions_at_once(spark, tmp_path):
    s = stores.Sessions(spark, str(tmp_path / "s"))
    s.append_turns(spark.createDataFrame([("a", "user", "x", 1.0), ("b", "user", "y", 2.0)], "id string, role string, content string, ts double"))
    s.set_titles(spark.createDataFrame([("a", "A"), ("z", "Z")], "id string, title string"))
    s.delete_all(spark.createDataFrame([("b",), ("y",)], "id string"))
    assert [(r.id, r.title) for r in s.list().collect()] == [("a", "A")]


def test_tables_of_reports(spark, tmp_path):
    for n in (1, 2):
        stores.save_table(spark.createDataFrame([(n, 0.5)], "n int, recall double"), str(tmp_path / f"r{n}"))
    assert {(r.run, r.n) for r in stores.read_tables(spark, {"a": str(tmp_path / "r1"), "b": str(tmp_path / "r2")}, "run").collect()} == {("a", 1), ("b", 2)}
