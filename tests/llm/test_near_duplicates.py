"""Near duplicates against all pairs."""

import itertools
import random
import re
import time
from pathlib import Path

import pytest

from quillon.llm import near_duplicates as nd
from quillon.runtime import own_tables

SCHEMA = "chunk_id string, text string"


def plain(rows, t, n):
    sets = {}
    for i, text in rows:
        if i is not None and text is not None:
            w = re.findall(r"[^\W_]+", text.lower())
            sets.setdefault(i, set()).update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def corpus(seed, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        base = [r.choice(words) for _ in range(r.randint(30, 160))]
        rows.append((f"{i:04x}a", " ".join(base)))
        for k in range(r.randint(0, 3)):
            copy = list(base)
            for _ in range(r.randint(0, len(copy) // 8)):
                p = r.randrange(len(copy))
                r.choice([lambda: copy.pop(p), lambda: copy.insert(p, r.choice(words)), lambda: copy.__setitem__(p, "Neu!")])()
            rows.append((f"{i:04x}b{k}", " ".join(copy)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("t", "n"), [(0.6, 3), (0.8, 5)])
def test_against_all_pairs(spark, t, n):
    rows = corpus(7)
    rows += rows[:4]
    want = plain(rows, t, n)
    got = {(r.chunk_id_a, r.chunk_id_b) for r in nd.similar_pairs(spark.createDataFrame(rows, SCHEMA), t, n).collect()}
    assert not got - want
    assert len(want) > 10 and len(got) >= 0.99 * len(want)


def test_no_pair_at_the_threshold_is_lost(spark):
    # 60 shared runs of three words, 20 in each text alone: exactly 0.6
    rows = []
    for i in range(4000):
        same = [f"s{i}x{k}" for k in range(62)]
        rows += [(f"{i:04}{side}", " ".join(same + [f"{side}{i}x{k}" for k in range(20)])) for side in "ab"]
    got = {(r.chunk_id_a, r.chunk_id_b) for r in nd.similar_pairs(spark.createDataFrame(rows, SCHEMA), 0.6, 3).collect()}
    assert got == {(f"{i:04}a", f"{i:04}b") for i in range(4000)}


def test_ids_by_shuffle_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame(corpus(9, 25), SCHEMA)
    one = nd.similar_pairs(df, 0.6, 3).collect()
    monkeypatch.setattr(nd, "BROADCAST_IDS", 0)
    assert sorted(one) == sorted(nd.similar_pairs(df, 0.6, 3).collect())


def test_edges(spark):
    same = "um dois três quatro cinco"
    rows = [("a", same), ("b", same), ("b", same), ("c", "UM, dois; três quatro cinco!"), ("d", "um dois"), ("e", "um dois"), ("f", None), (None, same), ("g", ""), ("h", " ")]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], SCHEMA + ", uid int, key int")
    assert {(r.chunk_id_a, r.chunk_id_b) for r in nd.similar_pairs(df, 0.6, 3).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    groups = {r.chunk_id: (r.group_id, r.links, r.copies) for r in nd.duplicate_groups(df, 0.6, 3).collect()}
    assert groups == {"a": ("a", 1, 1), "b": ("a", 1, 1), "c": ("a", 1, 0), "d": ("d", 0, 0), "e": ("e", 0, 0), "f": ("f", 0, 0), "g": ("g", 0, 0), "h": ("h", 0, 0)}
    empty = spark.createDataFrame([], SCHEMA)
    assert nd.similar_pairs(empty).count() == 0 and nd.duplicate_groups(empty).count() == 0


def test_groups_are_the_components(spark):
    rows = corpus(11, 30)
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = [(r.chunk_id_a, r.chunk_id_b) for r in nd.similar_pairs(df, 0.6, 3).collect()]
    group = {i: i for i, _ in rows}
    for _ in range(len(rows)):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    assert {r.chunk_id: r.group_id for r in nd.duplicate_groups(df, 0.6, 3).collect()} == group


def test_the_ring_keeps_what_it_promises():
    for t in (0.5, 0.6, 0.7, 0.8, 0.9):
        ring = nd.Ring(t)
        assert (1 - t**ring.width) ** ring.segments <= ring.miss
        assert ring.tau >= ring.positions * (1 - t)


def test_rows_that_multiply_are_never_broadcast(spark):
    df = spark.createDataFrame(corpus(3, 10), SCHEMA)
    pairs = nd.candidate_pairs(nd._texts(df, "text"), nd.Ring(0.6), 3)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_a_text_that_all_tasks_hold(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(f"{i:04d}", text) for i in range(300)] + [("x", text + " ende"), ("y", text.replace("w30", "v30"))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(16)
    groups = {r.chunk_id: (r.group_id, r.links, r.copies) for r in nd.duplicate_groups(df, 0.8, 5).collect()}
    assert groups["0007"] == ("0000", 2, 299) and groups["x"][0] == groups["y"][0] == "0000" and groups["x"][2] == 0


def of_phrases(seed, n):
    """Texts put together from few phrases: unlike, but many share a segment."""
    r = random.Random(seed)
    phrases = [" ".join(f"p{i}w{k}" for k in range(r.randint(4, 9))) for i in range(40)]
    return [(f"{i:04}", " ".join(r.choices(phrases, k=8))) for i in range(n)]


def test_unlike_texts_do_not_leave_the_join(spark):
    rows = of_phrases(5, 400)
    rows += [(f"{i}x", f"{text} ende") for i, text in rows[:40]]
    pairs = nd.candidate_pairs(nd._texts(spark.createDataFrame(rows, SCHEMA), "text"), nd.Ring(0.6), 3).count()
    assert len(plain(rows, 0.6, 3)) <= pairs <= 60  # without sizes and parities some hundred more


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_")}


def test_the_index_leaves_the_disk_part_by_part(spark, monkeypatch):
    rows = corpus(13, 80) + of_phrases(13, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows, 0.6, 3)
    monkeypatch.setattr(nd, "PART_TEXTS", 100, raising=False)
    before = shuffle_files(spark)
    similar = nd.similar_texts(nd._texts(df, "text"), 0.6, 3)
    for _ in range(50):
        if (left := sum(n for name, n in shuffle_files(spark).items() if name not in before)) < 20_000:
            break
        time.sleep(0.1)
    assert left < 20_000  # a row for each segment of these texts takes more than a megabyte
    assert not list(Path(own_tables(spark).removeprefix("file:")).glob("index-*"))
    got = {(r.chunk_id_a, r.chunk_id_b) for r in nd.similar_pairs(df, 0.6, 3).collect()}
    assert not got - want and len(got) >= 0.99 * len(want) and similar.count() > 10
