"""Cleaned documents cut into chunks: paragraphs, and sentences packed with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.config import ChunkConfig
from quillon.functions import text as tx

_SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=[A-ZÁÉÍÓÚÀÂÊÔÃÕÇ\"(])")


def estimate(text: str) -> int:
    return max(1, int(len(text.split()) * tx.TOKENS_PER_WORD)) if text else 0


def split_sentences(text: str) -> list[str]:
    return [s for p in _SENTENCE.split(text.strip()) if (s := p.strip())]


def _tail(parts: list[str], target: int) -> list[str]:
    """The last parts with about ``target`` tokens, one at least."""
    taken, size = [], 0
    for part in reversed(parts) if target > 0 else ():
        size += estimate(part)
        if taken and size > target:
            break
        taken.append(part)
    return taken[::-1]


def pack_sentences(parts: list[str], config: ChunkConfig) -> list[str]:
    """Sentences packed up to the largest size; a pack below the least size goes on growing.

    A sentence over the limit is a chunk alone. A chunk that is closed hands its last sentences
    on as overlap; a small rest joins the chunk before it.
    """
    out: list[str] = []
    open_, size = [], 0
    for part in parts:
        own = estimate(part)
        if own > config.max_tokens:
            out += [" ".join(open_)] if open_ else []
            out.append(part)
            open_, size = [], 0
            continue
        if open_ and size + own > config.max_tokens and size >= config.min_tokens:
            out.append(" ".join(open_))
            open_ = _tail(open_, config.overlap_tokens)
            size = sum(map(estimate, open_))
        open_.append(part)
        size += own
    if open_:
        rest = " ".join(open_)
        if size < config.min_tokens and out:
            out[-1] = f"{out[-1]} {rest}".strip()
        else:
            out.append(rest)
    return out


def cut_text(text: str, config: ChunkConfig) -> list[tuple[int, str]]:
    """(index, text) of the chunks of a cleaned text; a merged chunk keeps the index of its first."""
    if not text.strip():
        return []
    if estimate(text) <= config.max_tokens:
        return [(0, text)]
    found: list[tuple[int, str]] = []
    for paragraph in (p.strip() for p in re.split(r"\n\n+", text)):
        if paragraph:
            packs = [paragraph] if estimate(paragraph) <= config.max_tokens else pack_sentences(split_sentences(paragraph), config)
            base = len(found)
            found += [(base + i, p) for i, p in enumerate(packs)]
    merged: list[tuple[int, str]] = []
    for index, piece in found:
        if merged:
            was, now = estimate(merged[-1][1]), estimate(piece)
            if min(was, now) < config.min_tokens and was + now <= config.max_tokens:
                merged[-1] = (merged[-1][0], f"{merged[-1][1]} {piece}".strip())
                continue
        merged.append((index, piece))
    return merged


def chunk(docs: DataFrame, config: ChunkConfig | None = None, doc_key: str = "doc_id") -> DataFrame:
    """The chunks of all documents.

    Columns: the key, ``chunk_no``, text, source, page, section, chunk_id, chapter, topic,
    section_title, unit, breadcrumb, tokens. Outline columns that the table lacks count as
    null; a chunk inherits the document's chapter and topic where its own text names none.
    Null, empty and blank texts have no chunks. Chunk ids repeat where a source repeats index
    and page, so key and ``chunk_no`` together are the key of a row.
    """
    config = config or ChunkConfig.of_chars()
    cols = {c: (F.col(c) if c in docs.columns else F.lit(None)).cast("string") for c in ("section", "unit", "chapter", "topic", "breadcrumb")}
    page = (F.col("page") if "page" in docs.columns else F.lit(None)).cast("int")
    cleaned = tx.clean_page_text(F.col("text"), config.remove_headers, config.remove_boilerplate)
    ready = docs.where(F.col("text").isNotNull()).select(F.col(doc_key), cleaned.alias("text"))
    kind = ready.schema[doc_key].dataType.simpleString()
    ready = docs.where(F.col("text").isNotNull()).select(F.col(doc_key), F.coalesce("source", F.lit("desconhecido")).alias("source"), page.alias("page"), *[c.alias(f"doc_{n}") for n, c in cols.items()], cleaned.alias("text"))
    names = [f.name for f in ready.schema.fields]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, number, index, pieces = [], [], [], []
            for r, text in enumerate(batch.column(len(names) - 1).to_pylist()):
                for n, (i, piece) in enumerate(cut_text(text, config)):
                    at.append(r), number.append(n), index.append(i), pieces.append(piece)
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(j).take(where) for j in range(len(names) - 1)] + [pa.array(pieces, pa.string()), pa.array(number, pa.int32()), pa.array(index, pa.int32())],
                names=[*names, "chunk_no", "i"],
            )

    schema = f"`{doc_key}` {kind}, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ready.schema.fields[1:]) + ", chunk_no int, i int"
    cut = ready.mapInArrow(rows, schema)
    text = F.col("text")
    return cut.select(
        doc_key, "chunk_no", "text", "source", "page", F.col("doc_section").alias("section"),
        tx.chunk_id(F.col("source"), F.col("i"), F.col("page")).alias("chunk_id"),
        F.coalesce(tx.chapter_of(text), F.col("doc_chapter")).alias("chapter"),
        F.coalesce(tx.topic_of(text), F.col("doc_topic")).alias("topic"),
        tx.section_title_of(text, F.col("doc_section")).alias("section_title"),
        F.col("doc_unit").alias("unit"), F.col("doc_breadcrumb").alias("breadcrumb"), tx.count_tokens(text).alias("tokens"),
    )
