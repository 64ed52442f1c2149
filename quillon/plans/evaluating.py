"""Evaluation of a retrieval at several depths, with its guardrail and versioned reports."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import analysis, metrics
from quillon.sources import files, stores

Search = Callable[[DataFrame, int], DataFrame]


def evaluate(items: DataFrame, search: Search, depths: tuple[int, ...] = (5, 10, 15)) -> dict[str, DataFrame]:
    """Tables "report", "per_query", "by_category" and "guardrail" over all depths, each with k.

    ``items`` as ``read_eval_items`` gives them; ``search`` maps (queries (qid, query), k) to
    results (qid, cid, rank). Items that are answerable (true where null) are scored, the others
    must find nothing. Blank queries are left out.
    """
    asked = items.where(F.col("query").rlike(r"[^\s\p{Z}]")).select(F.col("id").alias("qid"), "query", "category", F.coalesce("answerable", F.lit(True)).alias("answerable"))
    qrels = stores.item_qrels(items)
    good, bad = asked.where("answerable"), asked.where("NOT answerable")
    out: dict[str, DataFrame] = {}
    for k in depths:
        scored = metrics.per_query(good, search(good.select("qid", "query"), k), qrels, k)
        parts = {
            "per_query": scored, "report": metrics.report(scored), "by_category": metrics.report_by_category(scored, good),
            "guardrail": metrics.guardrail(bad, search(bad.select("qid", "query"), k)),
        }
        for name, df in parts.items():
            part = df.withColumn("k", F.lit(k))
            out[name] = out[name].unionByName(part) if name in out else part
    return out


def details(items: DataFrame, results: DataFrame, chunks: DataFrame, chunk_id: str = "chunk_id") -> dict[str, DataFrame]:
    """Tables "expected" and "retrieved": what each item should find and what it found, in the order returned.

    ``results`` (qid, cid, rank, score), ``chunks`` with text, source and page.
    """
    qrels = stores.item_qrels(items)
    return {"expected": analysis.expected_chunks(qrels, chunks, chunk_id), "retrieved": analysis.retrieved_chunks(results, qrels, chunks, chunk_id)}


def save_reports(tables: dict[str, DataFrame], folder: str, meta: dict) -> str:
    """Write the tables as JSON into the next version's folder, on any file system the session reaches; returns it. Reports are small."""
    spark = next(iter(tables.values())).sparkSession
    target = f"{folder.rstrip('/')}/v{stores.next_version(files.names_in(spark, folder))}"
    contents = [(f"{name}.json", stores.report_json(df)) for name, df in tables.items()]
    files.write_files(spark, target, [*contents, ("run_meta.json", json.dumps(meta, ensure_ascii=False, default=str))])
    return target


def load_reports(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of every saved version, named in the column ``version``."""
    versions = [v for v in files.names_in(spark, folder) if v[:1] == "v" and v[1:].isdigit()]
    parts = [spark.read.option("multiLine", True).json(f"{folder.rstrip('/')}/{v}/{name}.json").withColumn("version", F.lit(v)) for v in versions]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
