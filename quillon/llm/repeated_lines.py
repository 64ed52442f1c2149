"""Lines repeated across the documents of one source.

Texts are cut into content-defined chunks: a gear hash rolls over the normalised text and a
chunk ends where the hash of the last sixteen characters has its low bits at zero. The
rolling state starts anew behind a line feed, as the result is asked by line, so the chunks
of a line depend on that line alone. Distinct documents are counted for each chunk and
source; a line all of whose chunks are repeated excessively is a candidate, and the same
count over the fingerprint of the whole line decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import textarrays as ta
from quillon.runtime import materialize

MIN_DOCS = 6
#: A chunk is at least this long, so that its window lies within its own line.
MIN_CHUNK = 48
#: One position in so many ends a chunk.
CUT_EVERY = 128
#: The same for chunks that run over line ends, and the least length of one that is cut out.
PASSAGE_CUT, MIN_PASSAGE = 64, 40
_WINDOW_STEPS = 4  # a window of 2**4 characters

_SCHEMA = "doc_id {id}, skey bigint, line_no int, n_chunks int, line_key bigint, chunk_key bigint, first_in_doc int"


def _gear(values: np.ndarray) -> np.ndarray:
    """Gear hash of the last sixteen values, by doubling the window four times."""
    h = values.copy()
    for step in range(_WINDOW_STEPS):
        w = 1 << step
        shifted = h[:-w] << np.uint64(w)
        h[w:] += shifted
    return h


def _normalised(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case; runs of white space as one space, none at line ends; digit runs as one zero. And where each character was."""
    newline = codes == 10
    space = ta.look(ta.flags("isspace"), codes) & ~newline
    digit = ta.look(ta.flags("isdecimal"), codes)
    before = np.empty_like(codes)
    before[0], before[1:] = 10, codes[:-1]
    run = np.flatnonzero(space & ~np.concatenate(([False], space[:-1])))
    keep = ~space & ~(digit & np.concatenate(([False], digit[:-1])))
    if run.size:
        solid = np.flatnonzero(~space)
        after = codes[solid[np.minimum(np.searchsorted(solid, run), solid.size - 1)]]
        keep[run[(before[run] != 10) & (after != 10)]] = True
    out = ta.map_codes(ta.lower_table(), codes)
    out = np.where(space, np.uint32(32), np.where(digit, np.uint32(48), out))
    return out[keep], np.flatnonzero(keep)


def _cut(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Lines and chunks of the texts.

    Returns, by line: text index, line number, number of chunks, fingerprint; by chunk: line
    index, fingerprint. Blank lines have no chunk.
    """
    ends = np.cumsum([t.count("\n") + 1 for t in texts])
    codes, _ = _normalised(ta.codes_of(texts))
    stop = np.flatnonzero(codes == 10)
    start = np.concatenate(([0], stop[:-1] + 1))
    text_of = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    number = np.arange(stop.size) - np.concatenate(([0], ends[:-1]))[text_of]
    values = ta.noise(codes)
    line_of = np.repeat(np.arange(stop.size), stop - start + 1)
    offset = np.arange(codes.size) - start[line_of]
    left = stop[line_of] - np.arange(codes.size)
    cut = ((_gear(values) >> np.uint64(20)) % np.uint64(CUT_EVERY) == 0) & (offset >= MIN_CHUNK - 1) & (left > MIN_CHUNK)
    begins = np.union1d(np.flatnonzero(cut) + 1, start[stop > start])
    chunk_line = line_of[begins]
    following = np.append(begins[1:], codes.size)
    lengths = np.minimum(following, stop[chunk_line]) - begins
    chunk_print = ta.fingerprints(values, begins, lengths)
    line_print = ta.fingerprints(values, start, stop - start)
    return text_of, number, np.bincount(chunk_line, minlength=stop.size), line_print, chunk_line, chunk_print


def _cut_through(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Chunks that run over line ends: text index, fingerprint, start and stop in the text as it stands.

    The hash rolls over a whole text and its line feeds like over other characters; chunks of
    fewer than ``MIN_PASSAGE`` characters are left out.
    """
    codes, kept = _normalised(ta.codes_of(texts))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    stop = np.searchsorted(kept, ends - 1)
    start = np.concatenate(([0], stop[:-1] + 1))
    values = ta.noise(codes)
    text_of = np.repeat(np.arange(len(texts)), stop - start + 1)
    offset = np.arange(codes.size) - start[text_of]
    cut = ((_gear(values) >> np.uint64(20)) % np.uint64(PASSAGE_CUT) == 0) & (offset >= (1 << _WINDOW_STEPS) - 1) & (np.arange(codes.size) < stop[text_of] - 1)
    begins = np.union1d(np.flatnonzero(cut) + 1, start[stop > start])
    owner = text_of[begins]
    lengths = np.minimum(np.append(begins[1:], codes.size), stop[owner]) - begins
    prints = ta.fingerprints(values, begins, lengths)
    long = lengths >= MIN_PASSAGE
    owner, begins, lengths = owner[long], begins[long], lengths[long]
    base = np.concatenate(([0], ends[:-1]))[owner]
    return owner, prints[long], kept[begins] - base, kept[begins + lengths - 1] + 1 - base


def _passage_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        skeys = batch.column(1).to_numpy().view(np.uint64)
        for first, texts in ta.blocks(batch.column(2)):
            owner, prints, start, stop = _cut_through([t or "" for t in texts])
            row = first + owner
            key = ta.mix64(prints ^ ta.mix64(skeys[row]))
            order = np.lexsort((key, row))
            once = np.ones(order.size, dtype=np.int32)
            once[order[1:][(row[order][1:] == row[order][:-1]) & (key[order][1:] == key[order][:-1])]] = 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(ta.signed(key)), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(once)],
                names=["doc_id", "chunk_key", "start", "stop", "first_in_doc"],
            )


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        skeys = batch.column(1).to_numpy().view(np.uint64)
        for first, texts in ta.blocks(batch.column(2)):
            text_of, number, n_chunks, line_print, line, chunk = _cut([t or "" for t in texts])
            if not line.size:
                continue
            row = first + text_of[line]
            salt = ta.mix64(skeys[row])
            chunk_key = ta.mix64(chunk ^ salt)
            order = np.lexsort((chunk_key, row))
            again = np.zeros(order.size, dtype=bool)
            again[1:] = (row[order][1:] == row[order][:-1]) & (chunk_key[order][1:] == chunk_key[order][:-1])
            once = np.ones(order.size, dtype=np.int32)
            once[order[again]] = 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)),
                    pa.array(skeys[row].view(np.int64)),
                    pa.array(number[line].astype(np.int32)),
                    pa.array(n_chunks[line].astype(np.int32)),
                    pa.array(ta.signed(ta.mix64(line_print[line] ^ salt))),
                    pa.array(ta.signed(chunk_key)),
                    pa.array(once),
                ],
                names=["doc_id", "skey", "line_no", "n_chunks", "line_key", "chunk_key", "first_in_doc"],
            )


def _sourced(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """(doc_id, skey, text) of the rows that have an id, a text and a source."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(source).alias("skey"), F.col(text).alias("text")).where(
        F.col(doc_id).isNotNull() & F.col(source).isNotNull() & F.col(text).isNotNull()
    )


def content_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The content-defined chunks of every text that has an id, a text and a source.

    Line and chunk keys hold the source, so equal keys mean equal content within one source.
    """
    kept = _sourced(docs, doc_id, text, source)
    return kept.mapInArrow(_chunk_batches, _SCHEMA.format(id=kept.schema["doc_id"].dataType.simpleString()))


def repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, line_no) of the lines that at least ``min_docs`` documents of one source hold.

    Null or blank texts, null sources and null ids give no rows; blank lines are none of the
    lines; a document repeated under one id counts once; an empty table gives an empty result.
    Lines are the same if they differ only in letter case, white space or digit runs.
    """
    chunks = materialize(content_chunks(docs, doc_id, text, source), "chunks")
    # partial sums leave one row a key and task to shuffle, however hot the key is
    frequent = chunks.groupBy("chunk_key").agg(F.sum("first_in_doc").alias("n")).where(F.col("n") >= min_docs).select("chunk_key")
    line = ["doc_id", "line_no", "line_key", "n_chunks"]
    whole = chunks.where("n_chunks = 1").join(frequent, "chunk_key", "left_semi").select(*line)
    cut = (
        chunks.where("n_chunks > 1")
        .join(frequent, "chunk_key", "left_semi")
        .groupBy(*line)
        .agg(F.count("*").alias("hits"))
        .where("hits >= n_chunks")
        .select(*line)
    )
    candidates = whole.unionByName(cut).select("doc_id", "line_no", "line_key").distinct()
    exact = candidates.groupBy("line_key").agg(F.count_distinct("doc_id").alias("n")).where(F.col("n") >= min_docs).select("line_key")
    return candidates.join(exact, "line_key", "left_semi").select("doc_id", "line_no")


def repeated_passages(docs: DataFrame, min_docs: int = MIN_DOCS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, start, stop): the stretches of each text that at least ``min_docs`` documents of its source hold.

    Stretches are content-defined chunks of the whole text, line feeds included, and are the
    same if they differ only in letter case, white space or digit runs. Null texts, sources and
    ids give no rows; a document repeated under one id counts once.
    """
    kept = _sourced(docs, doc_id, text, source)
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, chunk_key bigint, start int, stop int, first_in_doc int"
    chunks = materialize(kept.mapInArrow(_passage_batches, schema), "passages")
    likely = chunks.groupBy("chunk_key").agg(F.sum("first_in_doc").alias("n")).where(F.col("n") >= min_docs).select("chunk_key")
    # of rows repeated under one id only the candidates are told apart
    candidates = chunks.join(likely, "chunk_key", "left_semi").select("doc_id", "chunk_key", "start", "stop").distinct()
    sure = candidates.groupBy("chunk_key").agg(F.count_distinct("doc_id").alias("n")).where(F.col("n") >= min_docs).select("chunk_key")
    return candidates.join(sure, "chunk_key", "left_semi").select("doc_id", "start", "stop").distinct()


def cut_out(text: Column, spans: Column) -> Column:
    """``text`` without the spans (start, stop), which are in order and do not overlap."""
    zero, end = F.array(F.lit(0)), F.array(F.char_length(text))
    froms, tos = F.concat(zero, F.transform(spans, lambda s: s["stop"])), F.concat(F.transform(spans, lambda s: s["start"]), end)
    return F.array_join(F.zip_with(froms, tos, lambda a, b: F.substring(text, a + 1, b - a)), "")


def remove_repeated_passages(docs: DataFrame, min_docs: int = MIN_DOCS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every row of ``docs`` with ``clean_text``, its text freed of the repeated stretches; others come out as they were."""
    found = repeated_passages(docs, min_docs, doc_id, text, source)
    spans = found.groupBy(F.col("doc_id").alias("__id")).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("__spans"))
    joined = docs.join(spans, docs[doc_id] == spans["__id"], "left")
    return joined.withColumn("clean_text", F.when(F.col("__spans").isNull(), docs[text]).otherwise(cut_out(docs[text], F.col("__spans")))).drop("__id", "__spans")


def drop_lines(text: Column, numbers: Column) -> Column:
    """``text`` without the lines whose numbers are in the array; otherwise unchanged."""
    kept = F.filter(
        F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
        lambda s: ~F.array_contains(numbers, s["i"]),
    )
    return F.array_join(F.transform(kept, lambda s: s["x"]), "\n")


def remove_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every row of ``docs`` with its text freed of the repeated lines, and their number.

    Adds ``clean_text`` and ``lines_removed``; rows that hold no such line (null texts and
    sources among them) come out with their text as it was and 0.
    """
    found = repeated_lines(docs, min_docs, doc_id, text, source)
    lines = found.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("line_no").alias("__lines"))
    joined = docs.join(lines, docs[doc_id] == lines["__id"], "left")
    return joined.withColumns(
        {
            "clean_text": F.when(F.col("__lines").isNull(), docs[text]).otherwise(drop_lines(docs[text], F.col("__lines"))),
            "lines_removed": F.coalesce(F.size("__lines"), F.lit(0)),
        }
    ).drop("__id", "__lines")
