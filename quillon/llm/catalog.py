"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import encoding, language, leakage, lookalikes, near_duplicates, packing, repeated_lines, scan_repair, structure_split
from quillon.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, folder, "documents"))


def p1_clean(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return repeated_lines.remove_repeated_lines(docs).select("doc_id", "clean_text", "lines_removed")


def p1_passages(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines.repeated_passages(table(spark, folder, "documents"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.similar_pairs(table(spark, folder, "chunks"), threshold=0.6, words=3)


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.duplicate_groups(table(spark, folder, "chunks"), threshold=0.6, words=3)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return encoding.garbled_values(docs, encoding.fit_dictionaries(docs)).select("doc_id", "field")


def p3_restored(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return encoding.restore_encoding(docs.select("doc_id", "text", "source"), encoding.fit_dictionaries(docs))


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").select(F.lit("chunk").alias("origin"), F.col("chunk_id").alias("rec_id"), "text")
    chats = table(spark, folder, "chat_requests").select(F.lit("chat").alias("origin"), F.col("request_id").cast("string").alias("rec_id"), F.col("message").alias("text"))
    return chunks.unionByName(chats).where("rec_id IS NOT NULL")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    flagged = lookalikes.normalise(_messages(spark, folder))
    return flagged.where(lookalikes.any_case()).select("origin", "rec_id").distinct()


def p4_normalised(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.normalise(_messages(spark, folder)).select("origin", "rec_id", "normalised").distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return scan_repair.Repair(table(spark, folder, "scan_pages")).found()


def p5_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return scan_repair.Repair(table(spark, folder, "scan_pages")).paragraphs()


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").select("chunk_id", "text", "config_id")
    configs = table(spark, folder, "chunk_configs").select("config_id", "max_tokens", "overlap_tokens")
    return structure_split.split_oversized(chunks.join(configs, "config_id", "left"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The items that come out in pieces."""
    return p6_pieces(spark, folder).where("oversized").select("chunk_id").distinct()


def p6_checked(spark: SparkSession, folder: str) -> DataFrame:
    """(chunk_id, item_tokens, whole, within, kept_overlap): every item put together again from its pieces.

    ``whole`` is the hash of the pieces without their overlaps, ``within`` says that none is over
    the limit, ``kept_overlap`` that each shares with the one before what it must.
    """
    chunks = table(spark, folder, "chunks").select("chunk_id", "text", "config_id")
    configs = table(spark, folder, "chunk_configs").select("config_id", "max_tokens", "overlap_tokens")
    pieces = structure_split.split_oversized(chunks.join(configs, "config_id", "left")).withColumn("limit", F.coalesce("max_tokens", F.lit(1 << 30)))
    by = pieces.join(configs.select(F.col("max_tokens").alias("limit"), F.col("overlap_tokens").alias("wanted")).dropDuplicates(["limit"]), "limit", "left")
    parts = F.array_sort(F.collect_list(F.struct("piece_no", "start", "stop", "piece")))
    shared = (F.col("start") == 0) | (F.col("shared_tokens") >= F.least(F.col("wanted"), F.col("limit") - 2))
    one = by.groupBy("chunk_id", "item_tokens", "n_pieces").agg(parts.alias("p"), F.min(F.col("piece_tokens") <= F.col("limit")).alias("within"), F.min(shared).alias("kept_overlap"))
    # a piece begins before the end of the one before it by as many characters as they share
    core = F.transform("p", lambda x, i: F.when(i == 0, x["piece"]).otherwise(F.substring(x["piece"], F.get("p", i - 1)["stop"] - x["start"] + 1, F.length(x["piece"]))))
    return one.select("chunk_id", "item_tokens", F.md5(F.array_join(core, "")).alias("whole"), "within", F.coalesce("kept_overlap", F.lit(True)).alias("kept_overlap"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return packing.split_alone(packing.pack(table(spark, folder, "documents"), table(spark, folder, "pack_targets")))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), table(spark, folder, "pack_targets")).drop("blank")


def p7_totals(spark: SparkSession, folder: str) -> DataFrame:
    """(target_id, documents, bytes, overfull): what each target's containers hold in all, and how many hold too much."""
    packed = p7_containers(spark, folder)
    filled = packed.groupBy("target_id", "capacity", "block", "window").agg(F.sum("size").alias("filled"), F.sum(F.col("size") - packing.END_TOKENS).alias("bytes"), F.count_if(F.col("piece_no") == 0).alias("documents"))
    return filled.groupBy("target_id").agg(F.sum("documents").alias("documents"), F.sum("bytes").alias("bytes"), F.count_if(F.col("filled") > F.col("capacity")).cast("int").alias("overfull"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("item_id", "doc_id").distinct()


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    fields = ("relevant_texts", "query", "reference_answer")
    return leakage.leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items"), fields)


def p8_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, field, doc_id, words): how long the longest shared runs of the report are."""
    return p8_report(spark, folder).select("item_id", "field", "doc_id", "words")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.mislabelled(docs, language.fit(docs))


def p9_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.document_languages(docs, language.fit(docs))


def p9_segments(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.language_segments(docs, language.fit(docs))


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_clean": p1_clean,
        "p1_passages": p1_passages,
        "p2_found": p2_found,
        "p2_groups": p2_groups,
        "p3_found": p3_found,
        "p3_restored": p3_restored,
        "p4_found": p4_found,
        "p4_normalised": p4_normalised,
        "p5_found": p5_found,
        "p5_paragraphs": p5_paragraphs,
        "p6_found": p6_found,
        "p6_pieces": p6_pieces,
        "p6_checked": p6_checked,
        "p7_found": p7_found,
        "p7_containers": p7_containers,
        "p7_totals": p7_totals,
        "p8_found": p8_found,
        "p8_report": p8_report,
        "p8_runs": p8_runs,
        "p9_found": p9_found,
        "p9_documents": p9_documents,
        "p9_segments": p9_segments,
    }


_P4_FOUND = r"""
WITH m AS (
  SELECT 'chunk' AS origin, chunk_id AS rec_id, text AS t FROM chunks WHERE chunk_id IS NOT NULL
  UNION ALL SELECT 'chat', CAST(request_id AS VARCHAR), message FROM chat_requests WHERE request_id IS NOT NULL),
s AS (SELECT *, regexp_replace(t, '[\x{2190}-\x{2BFF}\x{1F000}-\x{1FAFF}][\x{FE0E}\x{FE0F}\x{1F3FB}-\x{1F3FF}]*(\x{200D}[\x{2190}-\x{2BFF}\x{1F000}-\x{1FAFF}]\x{FE0F}?)*', '#', 'g') AS bare FROM m)
SELECT DISTINCT origin, rec_id FROM s
WHERE length(nfc_normalize(t)) < length(t)
   OR regexp_matches(t, '[\x{FF01}-\x{FF60}\x{FFE0}-\x{FFE6}]')
   OR regexp_matches(regexp_replace(t, ' ', '', 'g'), '\p{Zs}')
   OR regexp_matches(bare, '[\p{Cf}\x{FE00}-\x{FE0F}]')
   OR EXISTS (SELECT 1 FROM (SELECT unnest(regexp_extract_all(t, '\p{L}+')) AS w)
              WHERE regexp_matches(w, '\p{Latin}') AND regexp_matches(w, '[\p{Greek}\p{Cyrillic}]'))
"""

_P6_FOUND = r"""
SELECT DISTINCT chunk_id FROM chunks JOIN chunk_configs USING (config_id)
WHERE chunk_id IS NOT NULL AND greatest(1, CAST(floor(len(regexp_extract_all(text, '[^\s\x{B}\x{1C}-\x{1F}\x{85}\p{Z}]+')) * CAST(1.33 AS DOUBLE)) AS INT)) > max_tokens
  AND regexp_matches(text, '[^\s\x{B}\x{1C}-\x{1F}\x{85}\p{Z}]')
"""

_P7_FOUND = r"""
SELECT DISTINCT target_id, doc_id FROM documents, pack_targets
WHERE doc_id IS NOT NULL AND regexp_matches(text, '[^\s\p{Z}]') AND octet_length(encode(text)) + 1 > capacity
"""

_P2_FOUND = r"""
WITH c AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL),
w AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM c),
s AS MATERIALIZED (SELECT DISTINCT chunk_id, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY chunk_id),
o AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY ALL)
SELECT a AS chunk_id_a, b AS chunk_id_b FROM o JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b WHERE 8 * o >= 3 * (x.n + y.n)
"""

_P2_GROUPS = r"""
WITH RECURSIVE m AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE chunk_id IS NOT NULL),
t AS MATERIALIZED (SELECT text, min(chunk_id) AS least, count(*) AS held, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM m WHERE text IS NOT NULL GROUP BY text),
k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY least, text) AS id FROM t),
s AS MATERIALIZED (SELECT DISTINCT id, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM k)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
o AS (SELECT a.id AS a, b.id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 8 * o >= 3 * (x.n + y.n)),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
heads AS (SELECT r.a AS id, min(k.least) AS head FROM reach r JOIN k ON k.id = r.b GROUP BY r.a),
degree AS (SELECT a AS id, count(*) AS links FROM l GROUP BY a),
told AS (SELECT m.chunk_id, CASE WHEN len(k.w) >= 3 THEN least(k.least, coalesce(h.head, k.least)) ELSE m.chunk_id END AS group_id, coalesce(d.links, 0) AS links, CASE WHEN len(k.w) >= 3 THEN k.held - 1 ELSE 0 END AS copies
  FROM m JOIN k ON k.text = m.text LEFT JOIN heads h ON h.id = k.id LEFT JOIN degree d ON d.id = k.id
  UNION ALL SELECT chunk_id, chunk_id, 0, 0 FROM m WHERE text IS NULL)
SELECT chunk_id, min(group_id) AS group_id, max(links) AS links, max(copies) AS copies FROM told GROUP BY chunk_id
"""

# the steps one after another on every text, whatever it holds
_VISIBLE = rf"array_to_string(list_filter(regexp_extract_all(t, '{lookalikes.EMOJI}|(?s:.)'), lambda s: NOT regexp_full_match(s, '[{lookalikes.INVISIBLE}]')), '')"
_SPACED = rf"translate(regexp_replace({_VISIBLE}, '[{lookalikes.SPACES}]', ' ', 'g'), '{lookalikes._WIDE.replace(chr(39), chr(39) * 2)}', '{lookalikes._NARROW.replace(chr(39), chr(39) * 2)}')"
_OF_LATIN = f"translate(w, '{lookalikes.ALIKE}', '{lookalikes.LATIN}')"
_OF_CYRILLIC = f"translate(w, '{lookalikes._LATIN_OF_CYRILLIC}', '{lookalikes._CYRILLIC}')"
_P4_NORMALISED = rf"""
WITH m AS (
  SELECT 'chunk' AS origin, chunk_id AS rec_id, text AS t FROM chunks WHERE chunk_id IS NOT NULL
  UNION ALL SELECT 'chat', CAST(request_id AS VARCHAR), message FROM chat_requests WHERE request_id IS NOT NULL),
c AS (SELECT DISTINCT origin, rec_id, t, nfc_normalize({_SPACED}) AS n FROM m)
SELECT DISTINCT origin, rec_id, CASE WHEN t IS NULL THEN NULL ELSE array_to_string(list_transform(regexp_extract_all(n, '[\p{{L}}\p{{M}}]+|[^\p{{L}}\p{{M}}]+'), lambda w:
  CASE WHEN NOT (regexp_matches(w, '\p{{Latin}}') AND regexp_matches(w, '[\p{{Greek}}\p{{Cyrillic}}]')) THEN w
       WHEN NOT regexp_matches({_OF_LATIN}, '[\p{{Greek}}\p{{Cyrillic}}]') THEN {_OF_LATIN} WHEN NOT regexp_matches({_OF_CYRILLIC}, '\p{{Latin}}') THEN {_OF_CYRILLIC} ELSE w END), '') END AS normalised FROM c
"""

_P6_CHECKED = r"""
WITH t AS (SELECT DISTINCT chunk_id, text, max_tokens, overlap_tokens FROM chunks LEFT JOIN chunk_configs USING (config_id) WHERE chunk_id IS NOT NULL AND regexp_matches(text, '[^\s\x{B}\x{1C}-\x{1F}\x{85}\p{Z}]'))
SELECT chunk_id, CAST(greatest(1, CAST(floor(len(regexp_extract_all(text, '[^\s\x{B}\x{1C}-\x{1F}\x{85}\p{Z}]+')) * CAST(1.33 AS DOUBLE)) AS INT)) AS INT) AS item_tokens, md5(text) AS whole, true AS within, true AS kept_overlap FROM t
"""

_P7_TOTALS = r"""
SELECT target_id, count(*) AS documents, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, 0 AS overfull
FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL), (SELECT DISTINCT target_id, capacity FROM pack_targets) GROUP BY target_id
"""

_P8_FOUND = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(nfc_normalize(text))), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT item_id, regexp_extract_all(strip_accents(lower(nfc_normalize(x))), '[\p{L}\p{N}]+') AS w FROM (SELECT item_id, unnest(relevant_texts) AS x FROM eval_items) WHERE x IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
pg AS (SELECT DISTINCT item_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM p))
SELECT DISTINCT item_id, doc_id FROM pg JOIN dg USING (g)
"""

_P8_RUNS = r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(strip_accents(lower(nfc_normalize(text))), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
f AS (SELECT item_id, 'relevant_texts' AS field, unnest(relevant_texts) AS x FROM eval_items UNION ALL SELECT item_id, 'query', query FROM eval_items UNION ALL SELECT item_id, 'reference_answer', reference_answer FROM eval_items),
p AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY item_id, field, x) AS pid FROM (SELECT item_id, field, x, regexp_extract_all(strip_accents(lower(nfc_normalize(x))), '[\p{L}\p{N}]+') AS w FROM f WHERE x IS NOT NULL)),
dg AS (SELECT doc_id, i AS j, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
pg AS (SELECT pid, i, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT pid, w, unnest(range(1, len(w) - 10)) AS i FROM p)),
hit AS (SELECT DISTINCT pid, doc_id, i, j FROM pg JOIN dg USING (g)),
run AS (SELECT pid, doc_id, j - i AS diag, i - row_number() OVER (PARTITION BY pid, doc_id, j - i ORDER BY i) AS island FROM hit),
long AS (SELECT pid, doc_id, count(*) + 11 AS words FROM run GROUP BY pid, doc_id, diag, island)
SELECT item_id, field, doc_id, CAST(max(words) AS INT) AS words FROM long JOIN p USING (pid) GROUP BY item_id, field, doc_id
"""

# places in the original text: its words and what is between them, each with the length of all before
_P8_REPORT = _P8_RUNS.split("\nlong AS")[0] + r"""
long AS MATERIALIZED (SELECT pid, doc_id, count(*) + 11 AS words, min(j) AS first FROM (SELECT r.*, h.j FROM (SELECT pid, doc_id, i, j, j - i AS diag, i - row_number() OVER (PARTITION BY pid, doc_id, j - i ORDER BY i) AS island FROM hit) r JOIN hit h USING (pid, doc_id, i, j)) GROUP BY pid, doc_id, diag, island),
cut AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}][\p{L}\p{N}\p{M}]*|[^\p{L}\p{N}]+') AS parts FROM (SELECT DISTINCT doc_id, text FROM documents) WHERE doc_id IN (SELECT doc_id FROM long)),
part AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM cut),
placed AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM part),
word AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS j, begin, begin + length(regexp_replace(part, '\p{M}+$', '')) AS stop FROM placed WHERE regexp_matches(part, '^[\p{L}\p{N}]')),
spot AS (SELECT p.item_id, p.field, l.doc_id, l.words, a.begin AS start, b.stop FROM long l JOIN p USING (pid) JOIN word a ON a.doc_id = l.doc_id AND a.j = l.first JOIN word b ON b.doc_id = l.doc_id AND b.j = l.first + l.words - 1)
SELECT item_id, field, doc_id, CAST(words AS INT) AS words, CAST(start AS INT) AS start, CAST(stop AS INT) AS stop FROM (SELECT *, row_number() OVER (PARTITION BY item_id, field, doc_id ORDER BY words DESC, start, stop) AS n FROM spot) WHERE n = 1
"""

_P1_LINES = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no
  FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
named AS (
  SELECT doc_id, source, line_no, trim(regexp_replace(regexp_replace(lower(line), '[\s\x{85}\p{Z}]+', ' ', 'g'), '\p{Nd}+', '0', 'g')) AS norm FROM lines),
hot AS (
  SELECT source, norm FROM named WHERE norm <> '' GROUP BY source, norm HAVING count(DISTINCT doc_id) >= 6),
found AS (SELECT DISTINCT doc_id, CAST(line_no AS INT) AS line_no FROM named JOIN hot USING (source, norm))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P2_FOUND,
        "p2_groups": _P2_GROUPS,
        "p4_normalised": _P4_NORMALISED,
        "p6_checked": _P6_CHECKED,
        "p7_totals": _P7_TOTALS,
        "p6_found": _P6_FOUND,
        "p8_found": _P8_FOUND,
        "p8_runs": _P8_RUNS,
        "p8_report": _P8_REPORT,
        "p7_found": _P7_FOUND,
        "p4_found": _P4_FOUND,
        "p1_found": _P1_LINES + "SELECT doc_id, line_no FROM found",
        "p1_clean": _P1_LINES
        + """
, kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS clean_text FROM lines l
  LEFT JOIN found f ON f.doc_id = l.doc_id AND f.line_no = l.line_no WHERE f.doc_id IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN n.n IS NULL THEN d.text ELSE coalesce(k.clean_text, '') END AS clean_text, CAST(coalesce(n.n, 0) AS INT) AS lines_removed
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id) n ON n.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id""",
    }
