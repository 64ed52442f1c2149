"""Shared folder and shipped package."""

from pathlib import Path

from quillon import runtime


def test_materialized_tables_and_their_end(spark):
    df = runtime.materialize(spark.range(5).selectExpr("id", "array(id) AS a"), "t")
    assert df.count() == 5 and df.schema.names == ["id", "a"]
    folder = Path(runtime.own_tables(spark).removeprefix("file:"))
    assert any(folder.iterdir())
    runtime.clean_shared(spark)
    assert not folder.exists()


def test_the_folder_of_the_session_is_used():
    # a setting of the application, so the session is a stand-in
    class Conf:
        def get(self, key, default=None):
            return {"spark.checkpoint.dir": "hdfs://shared/folder"}.get(key, default)

    class Session:
        conf = Conf()

    assert runtime.shared_dir(Session()) == "hdfs://shared/folder"
