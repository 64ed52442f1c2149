"""Documents from folders of text, markdown, JSON and PDF files."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

SUFFIXES = ("txt", "md", "json", "pdf")
SCHEMA = "text string, source string, page int, section string, bold_lines array<struct<text:string,size:double>>, body_size double, error string"


class PdfReader(ABC):
    """What reads PDF bytes; none is bundled."""

    @abstractmethod
    def pages(self, content: bytes) -> list[dict]:
        """Pages with text, page, section, bold_lines and body_size."""


def json_strings(value: object) -> Iterator[str]:
    """All string values of a parsed document, depth first; no keys, numbers or truth values."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            yield x
        elif isinstance(x, dict):
            stack += reversed(list(x.values()))
        elif isinstance(x, list):
            stack += reversed(x)


def json_text(value: object) -> str:
    """A document as JSON that keeps its letters."""
    return json.dumps(value, ensure_ascii=False)


def write_files(spark: SparkSession, folder: str, contents: list[tuple[str, str]]) -> None:
    """A few files (name, text) in a folder of any file system that the session reaches."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, text in contents:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(conf).create(path)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder, in order; nothing for one that is missing."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []


def decoded(content):
    """UTF-8 where the bytes are valid, else Latin-1."""
    as_text = content.cast("string")
    return F.when(F.is_valid_utf8(as_text), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def load_documents(spark: SparkSession, folder: str, pdf: PdfReader | None = None) -> DataFrame:
    """One row for each file of a supported kind, for PDF one for each page; not recursive.

    A file that cannot be read gives a row with a null text and its ``error``; blank documents
    are left out. A missing folder gives no rows.
    """
    try:
        files = spark.read.format("binaryFile").load(folder)
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)
    named = files.select("path", "content", F.regexp_extract(F.url_decode("path"), r"[^/]+$", 0).alias("source"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("suffix")).where(F.col("suffix").isin(*SUFFIXES))
    text = decoded(F.col("content"))
    plain = named.where(F.col("suffix").isin("txt", "md")).select(
        text.alias("text"), "source", F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("section"),
        F.lit(None).cast("array<struct<text:string,size:double>>").alias("bold_lines"), F.lit(None).cast("double").alias("body_size"), F.lit(None).cast("string").alias("error"),
    )

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                base = {"source": r.source, "page": None, "section": None, "bold_lines": None, "body_size": None, "error": None, "text": None}
                try:
                    if r.suffix == "json":
                        rows.append(base | {"text": " ".join(json_strings(json.loads(bytes(r.content).decode("utf-8"))))})
                    elif pdf is None:
                        rows.append(base | {"error": "no reader for PDF"})
                    else:
                        rows += [base | p for p in pdf.pages(bytes(r.content))]
                except Exception as e:  # noqa: BLE001 - one bad file must not end the scan
                    rows.append(base | {"error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=["text", "source", "page", "section", "bold_lines", "body_size", "error"])

    others = named.where(F.col("suffix").isin("json", "pdf")).select("content", "source", "suffix").mapInPandas(parsed, SCHEMA)
    return plain.unionByName(others).where(F.col("error").isNotNull() | F.col("text").rlike(r"[^\s\p{Z}]"))
