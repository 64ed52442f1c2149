"""Stored tables: the vector index, evaluation sets, sessions, versioned reports."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.operators import reports
from quillon.operators.vectors import check_signature

EVAL_SCHEMA = (
    "id string, query string, category string, answerable boolean, relevant_chunks array<struct<chunk_id:string,relevance:int>>, relevant_chunk_ids array<string>, "
    "relevant_texts array<string>, reference_answer string, n_source_chunks int, source_breadcrumb string"
)
SESSION_SCHEMA = "id string, title string, messages array<struct<role:string,content:string,ts:double>>, updated_at double"


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException:
        # nothing was written yet; a store that is there but broken raises
        return None


class VectorIndex:
    """A folder of Parquet parts, each written once, so a failed append leaves the index whole."""

    def __init__(self, spark: SparkSession, path: str, signature: str):
        self.spark, self.path, self.signature = spark, path.rstrip("/"), signature
        meta = _read(spark, f"{self.path}/meta")
        stored = meta.select("signature").limit(1).collect() if meta is not None else []
        check_signature(stored[0].signature if stored else None, signature)

    def rows(self) -> DataFrame | None:
        return _read(self.spark, f"{self.path}/rows")

    def load(self) -> bool:
        """Whether there is an index that can be read; one that cannot is set aside, and the store is empty."""
        try:
            rows = self.rows()
            if rows is None:
                return False
            rows.select(F.count("text_md5"), F.count("text")).collect()
        except (PySparkException, Py4JJavaError):
            self.path = f"{self.path}/anew-{uuid.uuid4().hex}"
            return False
        return True

    def add(self, chunks: DataFrame, order: list[str]) -> None:
        """Append the rows whose text is new, the first of each text."""
        stored = self.rows()
        fresh = reports.first_of_text(chunks, "text", order) if stored is None else reports.new_texts(chunks, stored, "text", order)
        fresh.write.mode("append").parquet(f"{self.path}/rows")
        self.spark.createDataFrame([(self.signature,)], "signature string").write.mode("overwrite").parquet(f"{self.path}/meta")

    def size(self) -> int:
        rows = self.rows()
        return 0 if rows is None else rows.count()


def read_eval_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON arrays or of JSON lines, in either layout, missing fields null.

    A file is one row until its items are taken apart; evaluation sets are small by nature.
    """
    item = T._parse_datatype_string(EVAL_SCHEMA)
    whole = F.trim(F.col("value"))
    lines = F.transform(F.filter(F.split("value", r"\r\n|\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, item))
    items = F.when(F.startswith(whole, F.lit("[")), F.from_json(whole, T.ArrayType(item))).otherwise(lines)
    return spark.read.text(path, wholetext=True).select(F.inline(items))


def write_eval_items(items: DataFrame, path: str) -> None:
    """Items as JSON lines that keep their letters; ``read_eval_items`` reads them back as they were."""
    items.write.mode("overwrite").json(path)


def item_qrels(items: DataFrame, item_id: str = "id") -> DataFrame:
    """(qid, cid, relevance): graded chunks, or the plain list (relevance 1) where there are none."""
    graded = F.transform(F.filter("relevant_chunks", lambda x: F.coalesce(x["chunk_id"], F.lit("")) != ""), lambda x: F.struct(x["chunk_id"].alias("cid"), F.coalesce(x["relevance"], F.lit(3)).alias("relevance")))
    plain = F.transform(F.filter("relevant_chunk_ids", lambda x: F.coalesce(x, F.lit("")) != ""), lambda x: F.struct(x.alias("cid"), F.lit(1).alias("relevance")))
    both = F.when(F.coalesce(F.size(graded), F.lit(0)) > 0, graded).otherwise(plain)
    return items.select(F.col(item_id).alias("qid"), F.explode(both).alias("r")).select("qid", "r.cid", "r.relevance").where("relevance > 0").distinct()


class Sessions:
    """Conversations as a log of changes; the current state is the last change of each session."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self) -> DataFrame:
        schema = SESSION_SCHEMA + ", change bigint, deleted boolean"
        stored = _read(self.spark, self.path, schema)
        return stored if stored is not None else self.spark.createDataFrame([], schema)

    def current(self) -> DataFrame:
        last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("change")))
        return self._log().withColumn("n", last).where("n = 1 AND NOT deleted").drop("n", "change", "deleted")

    def _append(self, rows: DataFrame, deleted: bool = False) -> None:
        at = (self._log().agg(F.coalesce(F.max("change"), F.lit(0)).alias("m")).collect()[0].m) + 1
        rows.withColumns({"change": F.lit(at).cast("bigint"), "deleted": F.lit(deleted)}).write.mode("append").parquet(self.path)

    def create(self, session_id: str | None = None, title: str = "New Chat", now: float = 0.0) -> str:
        key = session_id or uuid.uuid4().hex
        self._append(self.spark.createDataFrame([(key, title, [], now)], SESSION_SCHEMA))
        return key

    def get(self, session_id: str) -> DataFrame:
        return self.current().where(F.col("id") == session_id)

    def update(self, session_id: str, messages: list[tuple[str, str, float]], now: float) -> None:
        rows = self.get(session_id).select("id", "title").collect()
        if rows:
            self._append(self.spark.createDataFrame([(session_id, rows[0].title, messages, now)], SESSION_SCHEMA))

    def append_turns(self, turns: DataFrame) -> None:
        """Add (id, role, content, ts) messages to many sessions at once, creating those that are new."""
        added = turns.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ts", "role", "content"))).alias("m"), F.max("ts").alias("at"))
        shaped = added.select("id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), x["ts"].alias("ts"))).alias("new"), "at")
        old = self.current().select("id", "title", "messages")
        empty = F.array().cast("array<struct<role:string,content:string,ts:double>>")
        merged = shaped.join(old, "id", "left").select("id", F.coalesce("title", F.lit("New Chat")).alias("title"), F.concat(F.coalesce("messages", empty), "new").alias("messages"), F.col("at").alias("updated_at"))
        self._append(merged)

    def set_title(self, session_id: str, title: str) -> None:
        self._append(self.get(session_id).withColumn("title", F.lit(title)))

    def set_titles(self, titles: DataFrame) -> None:
        """Titles (id, title) of many sessions at once; those of sessions that are not stored are left out."""
        self._append(self.current().drop("title").join(titles, "id").select("id", "title", "messages", "updated_at"))

    def delete_all(self, ids: DataFrame) -> None:
        """Delete the sessions of a table (id)."""
        self._append(self.current().join(ids, "id", "left_semi"), deleted=True)

    def delete(self, session_id: str) -> bool:
        rows = self.get(session_id)
        if rows.isEmpty():
            return False
        self._append(rows, deleted=True)
        return True

    def list(self) -> DataFrame:
        return self.current().select("id", "title", "updated_at", F.size("messages").alias("n_messages")).orderBy(F.desc("updated_at"), "id")


class EmbeddingCache:
    """Vectors by the hash of model and text, in folders by its first two hex digits.

    ``providers.embed`` takes ``rows()`` as its cache; ``add`` appends what it computed anew.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self) -> DataFrame | None:
        stored = _read(self.spark, self.path)
        return None if stored is None else stored.select("text_sha256", "embedding")

    def add(self, embedded: DataFrame) -> None:
        """Append the vectors (text_sha256, embedding) that are not stored yet."""
        fresh = embedded.where("text_sha256 IS NOT NULL AND embedding IS NOT NULL").select("text_sha256", "embedding").dropDuplicates(["text_sha256"])
        stored = self.rows()
        if stored is not None:
            fresh = fresh.join(stored.select("text_sha256"), "text_sha256", "left_anti")
        # one file a folder and write, whatever the number of tasks
        shard = fresh.withColumn("shard", F.substring("text_sha256", 1, 2))
        shard.repartition("shard").write.mode("append").partitionBy("shard").parquet(self.path)


def next_version(names: list[str]) -> int:
    """One more than the highest of names v1, v2, ..."""
    return 1 + max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), default=0)


def report_json(report: DataFrame) -> str:
    """A small report as JSON text."""
    return json.dumps([r.asDict(recursive=True) for r in report.collect()], ensure_ascii=False, default=str)


def save_table(report: DataFrame, path: str) -> None:
    """A report as JSON lines in one file of any path the cluster reaches; reports are small."""
    report.coalesce(1).write.mode("overwrite").json(path)


def read_tables(spark: SparkSession, paths: dict[str, str], key: str) -> DataFrame:
    """Saved reports of one shape together, each named in the column ``key``."""
    parts = [spark.read.json(path).withColumn(key, F.lit(name)) for name, path in paths.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
