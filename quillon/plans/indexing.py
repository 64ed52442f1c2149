"""From a folder of files to a searchable index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.config import ChunkConfig
from quillon.operators import chunking, outline, reports
from quillon.providers import EmbeddingProvider, embed
from quillon.sources.stores import VectorIndex


def chunks_of(pages: DataFrame, config: ChunkConfig | None = None) -> DataFrame:
    """Outline and chunks of loaded pages (text, source, page, bold_lines, body_size).

    The key of a chunk is ``section_key``, made of source, document, section and page, with
    ``chunk_no``; unpaged texts are documents of their own, told apart by their content.
    """
    keyed = pages.where(F.col("text").isNotNull()).withColumn("page_key", F.md5(F.concat_ws("\n", "source", F.col("page").cast("string"), "text")))
    parts = outline.section_documents(outline.sections(keyed))
    ready = parts.withColumn("section_key", F.md5(F.concat_ws("|", F.coalesce("source", F.lit("")), F.coalesce("document", F.lit("")), F.col("section_no").cast("string"))))
    return chunking.chunk(ready, config, doc_key="section_key")


def build_index(pages: DataFrame, index: VectorIndex, provider: EmbeddingProvider, config: ChunkConfig | None = None, passage_prefix: str = "") -> DataFrame:
    """Chunk, drop texts that the index holds, embed the rest and append them; returns chunk statistics.

    Copies are dropped before embedding, as a model is the costliest step.
    """
    made = chunks_of(pages, config)
    stored = index.rows()
    fresh = reports.first_of_text(made, "text", ["section_key", "chunk_no"])
    if stored is not None:
        fresh = fresh.join(stored.select("text_md5"), "text_md5", "left_anti")
    vectors = embed(fresh.withColumn("__t", F.concat(F.lit(passage_prefix), "text")), provider, "__t").drop("__t")
    index.add(vectors.drop("text_md5"), ["section_key", "chunk_no"])
    return reports.chunk_stats(made)
