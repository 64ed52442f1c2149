"""Bounded samples of labelled texts: the same whatever the layout, bounded whatever the copies."""

from quillon.llm import labels


def test_sample_depends_on_the_rows_alone(spark):
    rows = [(f"texto número {i}", ("pt", "en-US", None, "xx")[i % 4]) for i in range(4000)] + [("sempre igual", "pt")] * 3000 + [(None, "pt"), ("  ", "pt"), ("", "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    one = labels.labelled_sample(df.coalesce(1), 50)
    many = labels.labelled_sample(df.repartition(7), 50)
    assert one == many and len(one["en"]) == 50 and 10 <= len(one["pt"]) <= 50 and one["pt"].count("sempre igual") <= 1
    assert not one["de"] and all(t.strip() for ts in one.values() for t in ts)


def test_small_tables_are_taken_whole(spark):
    df = spark.createDataFrame([("um", "pt"), ("one", "en"), ("two", "en"), ("two", "en"), ("?", "en")], "text string, lang string")
    got = labels.labelled_sample(df, 50)
    assert sorted(got["en"]) == ["one", "two"] and got["pt"] == ["um"]
    assert labels.labelled_sample(df.limit(0), 50) == {lang: [] for lang in labels.LANGUAGES}
