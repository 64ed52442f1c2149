"""SQL twins of the registered queries, for another engine to compute the same rows.

Each is written from the definition of the result, on whole tables. Queries without a twin are
those SQL cannot express: folds over sentences and sections, models, and streams.
"""

from __future__ import annotations

from quillon.functions import text as tx

_SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
_NOT_SPACE = r"[^\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
_UPPER = "A-ZÁÉÍÓÚÀÂÊÔÃÕÇ"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _words(x: str) -> str:
    return f"regexp_extract_all({x}, '{_NOT_SPACE}+')"


def _count_tokens(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN 0 ELSE greatest(1, CAST(floor(len({_words(x)}) * CAST(1.33 AS DOUBLE)) AS INT)) END"


def _tokens(x: str, stop=None, least: int = 1) -> str:
    base = rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"
    return f"list_filter({base}, lambda t: length(t) >= {least}" + (f" AND NOT list_contains({_list(stop)}, t))" if stop else ")")


def _any(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"


_RANKING = lambda x: _tokens(x, tx.RANKING_STOPWORDS, 3)
_TOPIC = lambda x: _tokens(x, tx.TOPIC_STOPWORDS, 4)

# --- the cascade, with the parameters of the registered queries


def _near(k: int) -> str:
    return f"""near AS (SELECT * FROM (
  SELECT q.vec_id AS qid, e.vec_id AS cid, list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank
  FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id) WHERE rank <= {k})"""


_QUERIES = f"""queries AS MATERIALIZED (
  SELECT v.vec_id AS qid, string_split(d.text, chr(10))[1] AS query, {_RANKING("string_split(d.text, chr(10))[1]")} AS qtok
  FROM embeddings v LEFT JOIN documents d ON d.doc_id = v.vec_id WHERE v.vec_id % 20 = 0)"""


def _cascade(pool: int = 40) -> str:
    return f"""WITH {_near(pool)}, {_QUERIES},
semantic AS MATERIALIZED (SELECT n.*, d.text, d.source, {_RANKING("d.text")} AS ctok, q.qtok FROM near n LEFT JOIN documents d ON d.doc_id = n.cid JOIN queries q USING (qid)),
absolute AS (SELECT * FROM semantic WHERE score >= 0.25),
adaptive AS MATERIALIZED (SELECT * EXCLUDE (mx, sd) FROM (SELECT *, max(score) OVER w AS mx, stddev_pop(score) OVER w AS sd FROM absolute WINDOW w AS (PARTITION BY qid)) WHERE score >= greatest(0.25, mx - 2.0 * sd)),
gap1 AS (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM adaptive),
gap2 AS (SELECT *, coalesce(avg(CASE WHEN score <> best THEN score END) OVER (PARTITION BY qid), 0) AS others FROM gap1),
gap AS MATERIALIZED (SELECT * EXCLUDE (best, others) FROM gap2 WHERE CASE WHEN best >= 0.45 THEN score >= best - 0.20 WHEN best >= 0.32 THEN score >= best - 0.18 ELSE best - others >= 0.10 AND score >= best - 0.18 END),
keyword AS MATERIALIZED (SELECT * FROM gap WHERE coalesce(len(qtok), 0) = 0 OR list_has_any(qtok, coalesce(ctok, []))),
{_bm25("keyword", "bm")},
mixed AS (SELECT *, CASE WHEN count(*) OVER w < 3 OR coalesce(len(qtok), 0) = 0 THEN score ELSE
   0.6 * CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END +
   0.4 * CASE WHEN max(bm25) OVER w - min(bm25) OVER w < 1e-9 THEN 0 ELSE (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) END END AS mix
  FROM bm WINDOW w AS (PARTITION BY qid)),
hybrid AS MATERIALIZED (SELECT * EXCLUDE (score, rank, mix), mix AS score, row_number() OVER (PARTITION BY qid ORDER BY mix DESC, rank) AS rank FROM mixed),
final AS (SELECT *, CASE WHEN score >= 0.45 THEN 'high' WHEN score >= 0.32 THEN 'medium' ELSE 'low' END AS confidence FROM hybrid WHERE rank <= 10)"""


def _bm25(rows: str, name: str) -> str:
    return f"""{name}_base AS (SELECT *, coalesce(len(ctok), 0) AS dl, count(*) OVER (PARTITION BY qid) AS n, avg(coalesce(len(ctok), 0)) OVER (PARTITION BY qid) AS avgdl FROM {rows}),
{name}_tok AS (SELECT qid, cid, tok, count(*) AS times FROM (SELECT qid, cid, unnest(qtok) AS tok FROM {name}_base) GROUP BY ALL),
{name}_tf AS (SELECT t.qid, t.cid, t.tok, t.times, len(list_filter(coalesce(b.ctok, []), lambda x: x = t.tok)) AS tf, b.dl, b.n, b.avgdl FROM {name}_tok t JOIN {name}_base b ON b.qid = t.qid AND b.cid = t.cid),
{name}_df AS (SELECT *, sum(CASE WHEN tf > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid, tok) AS df FROM {name}_tf),
{name}_sum AS (SELECT qid, cid, sum(CASE WHEN tf > 0 AND avgdl > 0 THEN times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl) + 1e-9) ELSE 0 END) AS bm25 FROM {name}_df GROUP BY ALL),
{name} AS MATERIALIZED (SELECT b.* EXCLUDE (dl, n, avgdl), coalesce(s.bm25, 0) AS bm25 FROM {name}_base b LEFT JOIN {name}_sum s USING (qid, cid))"""


_CASCADE = _cascade()
_STAGES = ("semantic", "absolute", "adaptive", "gap", "keyword", "hybrid", "final")
_TRACE = "trace AS (" + " UNION ALL ".join(f"SELECT {i} AS stage_no, '{s}' AS stage, qid, cid, rank FROM {s}" for i, s in enumerate(_STAGES)) + ")"

_QRELS = """qrels AS (SELECT q.vec_id AS qid, e.vec_id AS cid, CASE WHEN e.label = q.label THEN 3 ELSE 1 END AS relevance
  FROM embeddings q JOIN embeddings e ON e.label IN (q.label, q.label + 1) AND e.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)"""


def _metrics(k: int) -> str:
    return f"""WITH {_near(k)}, {_QRELS},
ideal AS (SELECT qid, count(*) AS n_relevant, sum(CASE WHEN i <= {k} THEN relevance / log2(i + 1) END) AS idcg FROM
  (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, cid) AS i FROM qrels) GROUP BY qid),
top AS (SELECT n.qid, n.rank, r.relevance, CASE WHEN r.cid IS NULL THEN 0 ELSE 1 END AS rel FROM near n LEFT JOIN qrels r USING (qid, cid)),
run AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY rank) AS hits FROM top),
got AS (SELECT qid, count(*) AS n_results, sum(rel) AS n_hits, min(CASE WHEN rel = 1 THEN rank END) AS first_rank, sum(CASE WHEN rel = 1 THEN relevance / log2(rank + 1) END) AS dcg,
  sum(CASE WHEN rel = 1 THEN hits / rank END) AS gained FROM run GROUP BY qid),
base AS (SELECT v.vec_id AS qid, coalesce(n_results, 0) AS n_results, coalesce(n_relevant, 0) AS n_relevant, coalesce(n_hits / n_results, 0) AS precision, coalesce(n_hits / n_relevant, 0) AS recall,
  CAST(coalesce(n_hits, 0) > 0 AS INT) AS hit, coalesce(1 / first_rank, 0) AS rr, coalesce(dcg / idcg, 0) AS ndcg, coalesce(gained / least(n_relevant, {k}), 0) AS ap
  FROM embeddings v LEFT JOIN got ON got.qid = v.vec_id LEFT JOIN ideal ON ideal.qid = v.vec_id WHERE v.vec_id % 20 = 0),
scored AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM base)"""


_MEAN = ", ".join(f"round(avg({m}), 6) AS {m}" for m in ("precision", "recall", "f1", "rr", "ndcg", "ap", "hit"))
_FAIL = f"""{_CASCADE}, {_TRACE}, {_QRELS},
seen AS (SELECT DISTINCT t.qid, t.stage_no, min(t.rank) OVER (PARTITION BY t.qid, t.stage_no) AS rank FROM trace t JOIN qrels r USING (qid, cid) WHERE r.relevance = 3),
spans AS (SELECT qid, list(stage_no) AS at, min(stage_no) AS first_no, min(CASE WHEN stage_no = 0 THEN rank END) AS first_rank FROM seen GROUP BY qid),
lost AS (SELECT q.qid, coalesce(list_contains(s.at, (SELECT max(stage_no) FROM trace)), false) AS hit, s.first_rank,
  CASE WHEN q.qid NOT IN (SELECT qid FROM qrels WHERE relevance = 3) THEN NULL WHEN s.at IS NULL THEN 0
       ELSE list_filter(range(s.first_no, (SELECT max(stage_no) FROM trace) + 1), lambda x: NOT list_contains(s.at, x))[1] END AS stage_no
  FROM queries q LEFT JOIN spans s USING (qid)),
failed AS (SELECT qid, hit, first_rank, CASE WHEN hit THEN NULL ELSE {_list(_STAGES)}[stage_no + 1] END AS failure_stage FROM lost)"""

_MESSAGES = """WITH m AS (SELECT session_id, request_id, min(message) AS content, min(sent_at) AS sent_at FROM chat_requests WHERE session_id IS NOT NULL GROUP BY ALL),
messages AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sent_at, request_id) AS turn FROM m),
said AS (SELECT *, CASE WHEN turn % 2 = 1 THEN 'user' ELSE 'assistant' END AS role FROM messages)"""


def _title(x: str) -> str:
    # no message holds a reasoning block
    trimmed = f"""regexp_replace(replace({_strip(f"coalesce({x}, '')")}, chr(10), ' '), '^[ \\"''“”.\\-]+|[ \\"''“”.\\-]+$', '', 'g')"""
    return f"CASE WHEN length({trimmed}) > 60 THEN regexp_replace(substring({trimmed}, 1, 60), '{_SPACE}+$', '') || '…' ELSE {trimmed} END"


def _level(t: str) -> str:
    edge = r"([^\p{L}\p{N}_]|$)"
    number = r"(?:[IVXLCDM]+|\d+)"
    digits = rf"(length({t}) - length(regexp_replace({t}, '\p{{Nd}}', '', 'g')))"
    bold = rf"coalesce(size, 0) > 0 AND length({t}) BETWEEN 4 AND 120 AND regexp_matches({t}, '^[\p{{Lu}}\p{{Nd}}]') AND len({_words(t)}) <= 20"
    return rf"""CASE WHEN {t} IS NULL OR length({t}) < 3 OR regexp_matches({t}, '^\p{{Nd}}{{1,4}}$') THEN 0
  WHEN regexp_matches({t}, '(?i)^(?:UNIDADE|M[ÓO]DULO|PARTE){_SPACE}+{number}{edge}') THEN 1
  WHEN regexp_matches({t}, '(?i)^CAP[ÍI]TULO{_SPACE}+{number}({_SPACE}*[:\-–—]?{_SPACE}+[{_UPPER}][^\n]{{0,80}}|{_SPACE}*[:\-–—]?)$') THEN 2
  WHEN regexp_matches({t}, '^\d{{1,2}}\.\d{{1,2}}(?:\.\d{{1,2}})?{_SPACE}+[{_UPPER}]') OR regexp_matches({t}, '^[a-z]\){_SPACE}+[{_UPPER}][^\n]{{8,}}$')
    OR regexp_matches({t}, '(?i)^(?:EM PAUTA|TRABALHO COM FONTES|TRABALHO E JUVENTUDES|ESTRATÉGIA DE ESTUDO){_SPACE}+[{_UPPER}]') THEN 3
  WHEN {bold} THEN CASE WHEN size >= coalesce(body_size, 12.0) * 1.2 THEN 1 ELSE 3 END
  WHEN regexp_matches({t}, '^(?:[{_UPPER}\-–—:,0-9]|{_SPACE}){{4,100}}$') AND NOT regexp_matches({t}, '[,;:()\[\]]|\.{{2,}}') AND len({_words(t)}) <= 12 AND length({t}) >= 10 AND {digits} < length({t}) * 0.3 THEN 2
  ELSE 0 END"""


def _lines(styled: bool) -> str:
    size = "(SELECT last(b.size) FROM (SELECT unnest(bold_lines) AS b) WHERE regexp_replace(" + _strip("b.text") + r", '\s+', ' ', 'g') = regexp_replace(" + _strip("line") + r", '\s+', ' ', 'g'))" if styled else "CAST(NULL AS DOUBLE)"
    normal = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    title = _strip(rf"regexp_replace(regexp_replace(line, '(?s){_SPACE}*\.{{3,}}.*$', ''), '{_SPACE}+\d{{1,4}}{_SPACE}*$', '')")
    return rf"""kept AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip("x")}), lambda x: x <> '') AS solid FROM documents WHERE text IS NOT NULL),
split AS (SELECT doc_id, source, page, bold_lines, body_size, unnest(string_split({normal}, chr(10))) AS line, unnest(range(len(string_split({normal}, chr(10))))) AS line_no FROM kept
  WHERE NOT (len(solid) > 5 AND len(list_filter(solid, lambda x: contains(x, '.....') OR contains(x, '…'))) > len(solid) * 0.4)),
sized AS (SELECT *, {size} AS size, {_strip("line")} AS t FROM split),
levelled AS MATERIALIZED (SELECT doc_id, source, page, line_no, line, {_level("t")} AS level, {title} AS title FROM sized)"""


_SECTIONS = f"""WITH {_lines(True)},
doc AS (SELECT *, CASE WHEN page IS NULL THEN doc_id END AS document, CASE WHEN level > 0 THEN 1 ELSE 0 END AS head FROM levelled),
numbered AS (SELECT *, sum(head) OVER (PARTITION BY source, document ORDER BY page, doc_id, line_no ROWS UNBOUNDED PRECEDING) AS section FROM doc),
grouped AS (SELECT source, document, section, max(level) AS head_level, max(CASE WHEN head = 1 THEN title END) AS head, min(page) AS page,
  string_agg(CASE WHEN head = 1 THEN title ELSE line END, chr(10) ORDER BY page, doc_id, line_no) AS body FROM numbered GROUP BY ALL),
state AS (SELECT *, last_value(CASE WHEN head_level = 1 THEN section END IGNORE NULLS) OVER w AS us, last_value(CASE WHEN head_level = 1 THEN head END IGNORE NULLS) OVER w AS u,
  last_value(CASE WHEN head_level = 2 THEN section END IGNORE NULLS) OVER w AS cs, last_value(CASE WHEN head_level = 2 THEN head END IGNORE NULLS) OVER w AS c,
  last_value(CASE WHEN head_level = 3 THEN section END IGNORE NULLS) OVER w AS ts, last_value(CASE WHEN head_level = 3 THEN head END IGNORE NULLS) OVER w AS t
  FROM grouped WINDOW w AS (PARTITION BY source, document ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
named AS (SELECT source, document, CAST(section AS INT) AS section_no, page, nullif(u, '') AS unit, CASE WHEN cs > coalesce(us, -1) THEN nullif(c, '') END AS chapter,
  CASE WHEN ts > coalesce(us, -1) AND ts > coalesce(cs, -1) THEN nullif(t, '') END AS topic, {_strip("body")} AS text FROM state)"""


def sql() -> dict[str, str]:
    out = {f"stage_{s}": f"{_CASCADE} SELECT qid, cid, rank, round(score, 6) AS score FROM {s}" for s in _STAGES[:-1]}
    out["retrieve"] = f"{_CASCADE} SELECT qid, cid, rank, round(score, 6) AS score, confidence FROM final"
    out["bm25_pool"] = f"{_CASCADE}, {_bm25('absolute', 'pool')} SELECT qid, cid, round(bm25, 6) AS bm25 FROM pool"
    out["min_max_scores"] = f"{_CASCADE} SELECT qid, cid, round(CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS scaled FROM absolute WINDOW w AS (PARTITION BY qid)"
    out["pair_rerank"] = f"""{_cascade(40)}, pairs AS (SELECT qid, cid, rank, score AS hybrid_score, CASE WHEN len(list_distinct(coalesce(qtok, []))) = 0 THEN 0 ELSE
      len(list_intersect(list_distinct(coalesce(qtok, [])), coalesce(ctok, []))) / len(list_distinct(coalesce(qtok, []))) END AS pair_score FROM hybrid WHERE rank <= 10),
    kept AS (SELECT * FROM pairs WHERE pair_score >= 0.05),
    fused AS (SELECT *, 0.4 * CASE WHEN max(hybrid_score) OVER w - min(hybrid_score) OVER w < 1e-9 THEN 0 ELSE (hybrid_score - min(hybrid_score) OVER w) / (max(hybrid_score) OVER w - min(hybrid_score) OVER w) END
      + 0.6 * CASE WHEN max(pair_score) OVER w - min(pair_score) OVER w < 1e-9 THEN 0 ELSE (pair_score - min(pair_score) OVER w) / (max(pair_score) OVER w - min(pair_score) OVER w) END AS score FROM kept WINDOW w AS (PARTITION BY qid)),
    ranked AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS rank FROM fused)
    SELECT qid, cid, rank, round(hybrid_score, 6) AS hybrid_score, round(pair_score, 6) AS pair_score, round(score, 6) AS score, CASE WHEN score >= 0.45 THEN 'high' WHEN score >= 0.32 THEN 'medium' ELSE 'low' END AS confidence FROM ranked WHERE rank <= 10"""
    out["best_confidence"] = f"{_CASCADE} SELECT q.qid, CASE WHEN max(f.score) IS NULL THEN 'none' WHEN max(f.score) >= 0.45 THEN 'high' WHEN max(f.score) >= 0.32 THEN 'medium' ELSE 'low' END AS confidence FROM queries q LEFT JOIN final f USING (qid) GROUP BY q.qid"
    out["trace_counts"] = f"{_CASCADE}, {_TRACE} SELECT stage_no, stage, count(*) AS n, count(DISTINCT qid) AS n_queries FROM trace GROUP BY ALL"

    out["ranking_metrics"] = f"{_metrics(10)} SELECT qid, n_results, n_relevant, hit, " + ", ".join(f"round({m}, 6) AS {m}" for m in ("precision", "recall", "f1", "rr", "ndcg", "ap")) + " FROM scored"
    out["eval_report"] = f"{_metrics(10)} SELECT count(*) AS n, {_MEAN} FROM scored"
    out["eval_by_category"] = f"{_metrics(10)} SELECT coalesce(nullif(d.lang, ''), 'uncategorized') AS category, count(*) AS n, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS rr FROM scored LEFT JOIN documents d ON d.doc_id = scored.qid GROUP BY 1"
    out["worst_queries"] = f"{_metrics(10)} SELECT qid, round(recall, 6) AS recall, hit FROM scored ORDER BY round(recall, 6), hit, qid LIMIT 10"
    out["recall_curve"] = " UNION ALL ".join(f"(SELECT * FROM ({_metrics(k)} SELECT {k} AS k, round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit FROM scored))" for k in (1, 3, 5, 10))
    runs = " UNION ALL ".join(f"(SELECT * FROM ({_metrics(k)} SELECT 'k{k}' AS name, round(avg(precision), 6) AS p, round(avg(recall), 6) AS r FROM scored))" for k in (5, 10))
    out["compare_reports"] = f"WITH runs AS ({runs}), flat AS (SELECT 'precision' AS metric, name, p AS value FROM runs UNION ALL SELECT 'recall', name, r FROM runs) SELECT *, value = max(value) OVER (PARTITION BY metric) AS best FROM flat"
    out["guardrail"] = f"{_CASCADE} SELECT q.qid, count(s.cid) AS retrieved, count(s.cid) = 0 AS passed FROM queries q LEFT JOIN semantic s ON s.qid = q.qid AND s.score >= 0.45 GROUP BY q.qid"
    out["failure_stages"] = f"{_FAIL} SELECT * FROM failed"
    out["failure_histogram"] = f"{_FAIL} SELECT failure_stage, count(*) AS n, count(*) FILTER (first_rank <= 1) AS top1, count(*) FILTER (first_rank <= 5) AS top5 FROM failed GROUP BY failure_stage"
    out["neighbour_qrels"] = """WITH near AS (SELECT doc_id, lag(doc_id) OVER w AS a, lead(doc_id) OVER w AS b FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
      SELECT qid, cid, 3 AS relevance FROM (SELECT doc_id AS qid, doc_id AS cid FROM near UNION ALL SELECT doc_id, a FROM near UNION ALL SELECT doc_id, b FROM near) WHERE cid IS NOT NULL"""
    head = lambda x: f"substring({_strip(x)}, 1, 120)"
    out["passage_links"] = f"""WITH p AS (SELECT DISTINCT item_id, {head("x")} AS p FROM (SELECT item_id, unnest(relevant_texts) AS x FROM eval_items)), d AS (SELECT doc_id, {head("text")} AS h FROM documents)
      SELECT DISTINCT p.item_id AS item, d.doc_id AS chunk FROM p JOIN d ON contains(d.h, p.p) WHERE p.p <> ''"""

    out["token_estimate"] = f"SELECT doc_id, {_count_tokens('text')} AS tokens FROM documents"
    out["chunk_stats"] = f"SELECT count(*) AS n, sum(t) AS tokens, round(avg(t), 6) AS mean_tokens, min(t) AS min_tokens, max(t) AS max_tokens, count(*) FILTER (t < 30) AS n_tiny, count(*) FILTER (t > 600) AS n_huge FROM (SELECT {_count_tokens('text')} AS t FROM chunks)"
    out["structure_report"] = "SELECT unit, chapter, count(*) AS chunks, count(DISTINCT topic) AS topics FROM chunks GROUP BY unit, chapter"
    out["unstructured_share"] = "SELECT count(*) AS n, round(avg(CASE WHEN unit IS NULL AND chapter IS NULL THEN 1 ELSE 0 END), 6) AS unstructured FROM chunks"
    out["source_report"] = "SELECT source, count(*) AS rows, count(DISTINCT page) AS pages, count(DISTINCT unit) AS units, count(DISTINCT chapter) AS chapters, count(DISTINCT topic) AS topics FROM chunks GROUP BY source"
    out["body_sizes"] = """WITH v AS (SELECT source, round(body_size, 1) AS s, count(*) AS n, min(doc_id) AS p FROM documents WHERE source IS NOT NULL AND body_size IS NOT NULL GROUP BY 1, 2),
      b AS (SELECT source, s, row_number() OVER (PARTITION BY source ORDER BY n DESC, p) AS i FROM v)
      SELECT d.source, coalesce(b.s, 12.0) AS body_size FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) d LEFT JOIN b ON b.source = d.source AND b.i = 1"""
    out["first_of_text"] = "SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL GROUP BY text"
    out["new_texts"] = "SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE text IS NOT NULL AND (source IS NULL OR source LIKE 'saber%')) GROUP BY text"
    made = "substring(sha1(coalesce(source, '') || '::' || config_id || CASE WHEN page IS NULL THEN '' ELSE '::page' || page END), 1, 16)"
    out["row_keys"] = f"SELECT DISTINCT chunk_id, {made} AS made_id, sha256(concat_ws('::', 'm', text)) AS key, md5({_strip('substring(text, 1, 64)')}) AS by_text FROM chunks"
    out["breadcrumbs"] = "SELECT DISTINCT chunk_id, concat_ws(' > ', nullif(unit, ''), nullif(chapter, ''), nullif(topic, '')) AS crumb FROM chunks"
    chapter = rf"nullif({_strip(rf"regexp_extract(substring(text, 1, 200), '(?i)cap(?:ítulo)?\.?{_SPACE}+(\d+|[IVX]+)')")}, '')"
    topic = rf"list_filter(list_transform(string_split(text, chr(10))[1:5], lambda x: {_strip('x')}), lambda x: length(x) BETWEEN 10 AND 80 AND NOT regexp_matches(x, '[.!?]$'))[1]"
    # of the lines shaped like a title the first counts; without lookbehind its last character is tested apart
    shaped = rf"list_filter(string_split(text, chr(10)), lambda x: regexp_full_match(x, '(?:\d+[.)]{_SPACE}+)?[{_UPPER}][^\n]{{3,79}}') AND NOT regexp_matches(x, '[.!?,;:]$'))[1]"
    out["text_metadata"] = f"SELECT doc_id, CASE WHEN {_strip(shaped)} <> '' AND len({_words(_strip(shaped))}) <= 12 THEN {_strip(shaped)} END AS title, {chapter} AS chapter, {topic} AS topic, coalesce(nullif(section, ''), {topic}) AS section_title FROM documents"
    out["line_levels"] = f"WITH {_lines(False)} SELECT doc_id, CAST(line_no AS INT) AS line_no, level, CASE WHEN level > 0 THEN title END AS title FROM levelled"
    out["outline_sections"] = _SECTIONS + """ SELECT source, document, section_no, page, unit, chapter, topic, CASE WHEN topic IS NOT NULL THEN 3 WHEN chapter IS NOT NULL THEN 2 WHEN unit IS NOT NULL THEN 1 ELSE 0 END AS level,
      concat_ws(' > ', unit, chapter, topic) AS breadcrumb, coalesce(topic, chapter, unit) AS section, md5(text) AS text_md5 FROM named WHERE text <> ''"""
    keywords = f"""WITH w AS (SELECT doc_id, unnest({_tokens('text', tx.EVALUATION_STOPWORDS, 4)}) AS word, unnest(range(len({_tokens('text', tx.EVALUATION_STOPWORDS, 4)}))) AS pos FROM documents),
      c AS (SELECT doc_id, word, count(*) AS times, min(pos) AS pos FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY times DESC, pos) AS rank FROM c)"""
    out["top_keywords"] = f"{keywords} SELECT doc_id, rank, word, times FROM r WHERE rank <= 3"
    out["keyword_queries"] = f"""{keywords}, k AS (SELECT doc_id, list(word ORDER BY rank) AS kw FROM r WHERE rank <= 3 GROUP BY doc_id)
      SELECT doc_id, CASE WHEN coalesce(section, '') <> '' THEN 'O que o material diz sobre ' || array_to_string(kw[1:2], ' e ') || ' em: ' || section || '?'
        WHEN len(kw) >= 2 THEN 'Explique a relação entre ' || kw[1] || ' e ' || kw[2] || '.' ELSE 'O que é ' || kw[1] || '?' END AS query FROM k JOIN documents USING (doc_id)"""
    out["keyword_sets"] = f"SELECT doc_id, array_to_string(list_sort(list_distinct({_TOPIC('text')})), ' ') AS keywords FROM documents WHERE text IS NOT NULL"
    out["previews"] = "SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '…' ELSE text END AS preview FROM documents"

    out["history_trim"] = f"{_MESSAGES} SELECT session_id, turn, role, content FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS b FROM said) WHERE b <= 8"
    from quillon.operators import dialogue

    out["follow_ups"] = f"{_MESSAGES} SELECT session_id, turn, turn - 1 AS earlier, turn - 1 >= 2 AND coalesce({_any('lower(content)', dialogue.FOLLOW_UPS)}, false) AS follow_up FROM said WHERE role = 'user'"
    bare = r"""regexp_replace(x, '^[.,;:!?"()\[\]]+|[.,;:!?"()\[\]]+$', '', 'g')"""
    out["history_context"] = rf"""{_MESSAGES}, late AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS b FROM said),
      told AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS a FROM late WHERE b <= 4 AND role = 'assistant' AND content IS NOT NULL AND NOT {_any('content', (tx.REFUSAL, tx.OLD_REFUSAL))}),
      ws AS (SELECT session_id, turn, list_filter(list_transform({_words('content')}, lambda x: {bare}), lambda x: length(x) >= 5 AND (regexp_matches(x, '^\p{{Lu}}') OR list_contains({_list(dialogue.SUBJECT_WORDS)}, lower(x)))) AS w FROM told WHERE a <= 2),
      flat AS (SELECT session_id, turn, unnest(w) AS x, unnest(range(len(w))) AS i FROM ws), firsts AS (SELECT session_id, x, min(turn * 100000 + i) AS o FROM flat GROUP BY ALL),
      kept AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY o) AS k FROM firsts)
      SELECT s.session_id, coalesce(string_agg(k.x, ' ' ORDER BY k.o), '') AS context FROM (SELECT DISTINCT session_id FROM ws) s LEFT JOIN kept k ON k.session_id = s.session_id AND k.k <= 8 GROUP BY s.session_id"""
    out["session_list"] = f"{_MESSAGES} SELECT session_id, count(*) AS n_messages, epoch_us(max(sent_at)) / 1e6 AS updated_at, {_title('min_by(content, turn)')} AS title FROM said GROUP BY session_id"
    packed = rf"""{_CASCADE}, usable0 AS (SELECT qid, rank, text, source, round(score, 1) AS score, max(CASE WHEN length(text) >= 80 THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS any_long FROM absolute WHERE text IS NOT NULL),
      usable AS (SELECT *, '[fonte: ' || regexp_extract(coalesce(source, 'desconhecido'), '[^/]*$') || ' | relevância: ' || printf('%.2f', score) || ']' || chr(10) || {_strip('text')} AS e FROM usable0 WHERE length(text) >= 80 OR any_long = 0),
      summed AS (SELECT *, sum(length(e)) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS s FROM usable),
      packed AS (SELECT qid, rank, CASE WHEN s <= 3500 THEN 'whole' ELSE 'cut' END AS status, CASE WHEN s <= 3500 THEN e ELSE substring(e, 1, CAST(3500 - (s - length(e)) AS BIGINT)) || '…' END AS entry FROM summed WHERE s <= 3500 OR 3500 - (s - length(e)) > 150)"""
    out["context_pack"] = f"{packed} SELECT * FROM packed"
    out["context_blocks"] = f"{packed} SELECT qid, string_agg(entry, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM packed GROUP BY qid"
    t = _strip("a.text")
    out["prompt_statuses"] = f"""{packed}, b AS (SELECT qid, string_agg(entry, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM packed GROUP BY qid),
      u AS (SELECT qid, max(length(text)) >= 80 AS usable FROM absolute WHERE text IS NOT NULL GROUP BY qid)
      SELECT a.qid, a.cid, CASE WHEN length({t}) < 80 AND usable THEN 'filtered' WHEN {t} <> '' AND contains(coalesce(context, ''), {t}) THEN 'in prompt' WHEN {t} <> '' AND contains(coalesce(context, ''), substring({t}, 1, 60)) THEN 'cut' ELSE 'out' END AS status
      FROM absolute a JOIN u USING (qid) LEFT JOIN b USING (qid) WHERE a.text IS NOT NULL"""
    names = rf"list_transform(list_filter({_words('@')}, lambda x: regexp_matches(x, '^\p{{Lu}}') AND length(x) > 3), lambda x: lower(x))"
    out["topical_relevance"] = f"""{_CASCADE}, asked AS (SELECT qid, list_distinct({_TOPIC('query')}) AS kw, {names.replace('@', 'query')} AS names FROM queries),
      pool AS (SELECT qid, flatten(list(list_concat({_TOPIC('text')}, {names.replace('@', 'text')}))) AS words FROM final WHERE text IS NOT NULL GROUP BY qid)
      SELECT a.qid, coalesce(len(kw), 0) = 0 OR coalesce(list_has_any(names, coalesce(words, [])), false) OR len(list_intersect(kw, coalesce(words, []))) / greatest(len(kw), 1) >= 0.15 AS relevant FROM asked a LEFT JOIN pool p USING (qid)"""

    out["tfidf_similarity"] = f"""WITH b AS (SELECT item_id, 0 AS side, {_tokens("coalesce(query, '')")} AS w FROM eval_items UNION ALL SELECT item_id, 1, {_tokens("coalesce(reference_answer, '')")} FROM eval_items),
      c AS (SELECT item_id, w, CAST(count(*) FILTER (side = 0) AS DOUBLE) AS na, CAST(count(*) FILTER (side = 1) AS DOUBLE) AS nb FROM (SELECT item_id, side, unnest(w) AS w FROM b) GROUP BY ALL),
      t AS (SELECT *, sum(na) OVER (PARTITION BY item_id) AS ta, sum(nb) OVER (PARTITION BY item_id) AS tb, ln(3 / ((na > 0)::INT + (nb > 0)::INT + 1)) + 1 AS idf FROM c),
      v AS (SELECT item_id, CASE WHEN ta > 0 THEN na / ta ELSE 0 END * idf AS wa, CASE WHEN tb > 0 THEN nb / tb ELSE 0 END * idf AS wb FROM t),
      s AS (SELECT item_id, sum(wa * wb) AS d, sum(wa * wa) AS aa, sum(wb * wb) AS bb FROM v GROUP BY item_id)
      SELECT e.item_id, round(CASE WHEN aa > 0 AND bb > 0 THEN d / (sqrt(aa) * sqrt(bb)) ELSE 0 END, 6) AS similarity FROM eval_items e LEFT JOIN s USING (item_id)"""
    long = lambda x: f"list_distinct({_tokens(x, None, 4)})"
    jac = lambda a, b: f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"
    mark = r"regexp_replace(" + _strip("answer") + rf", '([.!?]){_SPACE}+', '\1' || chr(30), 'g')"
    answers = f"""WITH i AS (SELECT *, array_to_string(coalesce(relevant_texts, []), ' ') AS context, coalesce(reference_answer, '') AS answer FROM eval_items),
      w AS (SELECT *, {long("context")} AS cw, {long("answer")} AS aw, list_filter(list_transform(string_split({mark}, chr(30)), lambda x: {_strip("x")}), lambda x: length(x) > 10) AS parts FROM i),
      s AS (SELECT item_id, sum(CASE WHEN len(own) > 0 AND ({jac("own", "cw")} >= 0.08 OR len(list_intersect(own, cw)) / len(own) >= 0.35) THEN 1 ELSE 0 END) AS good FROM (SELECT item_id, cw, {long("p")} AS own FROM (SELECT item_id, cw, unnest(parts) AS p FROM w)) GROUP BY item_id),
      o AS (SELECT w.item_id, w.category, w.answerable, round({jac("aw", "cw")}, 6) AS overlap, round(CASE WHEN len(parts) = 0 THEN 0 ELSE coalesce(good, 0) / len(parts) END, 6) AS faithfulness,
        len(list_filter(string_split(query, ' '), lambda x: contains(lower(translate(answer, '₀₁₂₃₄₅₆₇₈₉', '0123456789')), lower(x)))) > 0 AS exact, {_any("lower(answer)", tx.REFUSAL_MARKERS)} AS refused FROM w LEFT JOIN s USING (item_id))"""
    out["answer_overlap"] = f"{answers} SELECT item_id, overlap, faithfulness, exact, refused FROM o"
    out["answer_report"] = f"""{answers} SELECT category, count(*) AS n, round(avg(CASE WHEN coalesce(answerable, true) THEN faithfulness END), 6) AS faithfulness, round(avg(CASE WHEN coalesce(answerable, true) THEN exact::INT END), 6) AS exact,
      round(CAST(count(*) FILTER (NOT coalesce(answerable, true) AND refused) AS DOUBLE) / nullif(count(*) FILTER (refused), 0), 6) AS refusal_precision, round(CAST(count(*) FILTER (NOT coalesce(answerable, true) AND refused) AS DOUBLE) / nullif(count(*) FILTER (NOT coalesce(answerable, true)), 0), 6) AS refusal_recall FROM o GROUP BY category"""
    out["vector_cosine"] = "WITH h AS (SELECT label, min_by(embedding, vec_id) AS head FROM embeddings GROUP BY label) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], head::DOUBLE[]), 6) AS cosine FROM embeddings JOIN h USING (label)"

    out["hash_sample"] = "SELECT doc_id FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL ORDER BY md5('42:' || doc_id), doc_id LIMIT 30"
    out["entry_ids"] = "SELECT item_id, CASE WHEN coalesce(n_source_chunks, 0) <= 1 THEN 'factual' ELSE 'multi_hop' END AS kind, printf('q%04d', row_number() OVER (ORDER BY item_id)) AS id FROM eval_items"
    place = lambda p: f"max(CASE WHEN i = least(n * {p} // 100, n - 1) THEN value END)"
    out["latency_percentiles"] = f"WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS largest, " + ", ".join(f"round({place(p)}, 6) AS p{p}" for p in (50, 95, 99)) + " FROM r GROUP BY event_type"
    out["event_pivot"] = "SELECT source, " + ", ".join(f"count(*) FILTER (config_id = {i}) AS n{i}" for i in range(1, 6)) + " FROM chunks GROUP BY source"
    cut = lambda x, after: rf"list_filter(list_transform(string_split({x}, chr(30)), lambda s: {_strip('s')}), lambda s: {after})"
    ended = rf"regexp_replace({_strip('x')}, '([.!?…]){_SPACE}+([{_UPPER}\"(])', '\1' || chr(30) || '\2', 'g')"
    breaks = r"regexp_replace(text, '\n\n+', chr(30), 'g')"
    out["text_parts"] = f"SELECT doc_id, len({cut(breaks, 's <> chr(0) AND s <> ' + chr(39) * 2)}) AS paragraphs, len({cut(ended.replace('x,', 'text,'), 's <> ' + chr(39) * 2)}) AS sentences FROM documents WHERE text IS NOT NULL"
    told = rf"regexp_replace({_strip('text')}, '([.!?]){_SPACE}+', '\1' || chr(30), 'g')"
    out["query_sentences"] = f"""WITH k AS (SELECT doc_id, {cut(told, 'length(s) >= 40')} AS s FROM documents), u AS (SELECT doc_id, len(s) // 2 AS m, unnest(s) AS x, unnest(range(len(s))) AS i FROM k),
      r AS (SELECT doc_id, {_strip("regexp_replace(x, '" + r"\[.*?\]|\(p\.\s*\d+\)" + "', '', 'g')")} AS b, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN {_any("lower(x)", tx.DEFINITION_MARKERS)} THEN 3 ELSE 0 END - abs(i - m) DESC, i) AS n FROM u)
      SELECT d.doc_id, CASE WHEN length(b) >= 30 THEN b END AS sentence FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND n = 1"""
    clean = "nfc_normalize(text)"
    for pattern in tx.BOILERPLATE:
        clean = f"regexp_replace({clean}, '{pattern.replace('u)', ')', 1)}', '', 'g')"
    clean = rf"regexp_replace({clean}, '([\p{{L}}\p{{N}}_])-{_SPACE}*\n{_SPACE}*([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    clean = rf"regexp_replace({clean}, '([^\n])\n([a-záéíóúàâêôãõç0-9,;:\"''])', '\1 \2', 'g')"
    clean = rf"regexp_replace(regexp_replace({clean}, '(?m)^{_SPACE}*\d{{1,4}}{_SPACE}*$', '', 'g'), '(?m)^(?:[{_UPPER}]|{_SPACE}){{5,60}}$', '', 'g')"
    clean = _strip(rf"regexp_replace(regexp_replace({clean}, '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")
    out["page_texts"] = f"SELECT doc_id, {clean} AS clean FROM documents"
    out["embedded_messages"] = "SELECT request_id, sha256('hashed-32::' || message) AS text_sha256, CASE WHEN message IS NOT NULL THEN 32 END AS dimension FROM chat_requests"
    out["value_growth"] = "SELECT user_id, round(min_by(value, event_id), 6) AS first, round(max_by(value, event_id), 6) AS last, round(max_by(value, event_id) - min_by(value, event_id), 6) AS growth FROM events GROUP BY user_id"
    # counts and ranks in the width that the queries give them
    narrow = dict.fromkeys([f"stage_{x}" for x in _STAGES[:-1]] + ["retrieve", "pair_rerank", "top_keywords", "context_pack"], ("rank", "INT"))
    narrow |= {"failure_stages": ("first_rank", "INT"), "chunk_stats": ("tokens", "BIGINT"), "history_trim": ("turn", "INT")}
    for name, (column, kind) in narrow.items():
        out[name] = f"SELECT * REPLACE (CAST({column} AS {kind}) AS {column}) FROM ({out[name]})"
    out["follow_ups"] = f"SELECT * REPLACE (CAST(turn AS INT) AS turn, CAST(earlier AS INT) AS earlier) FROM ({out['follow_ups']})"
    return out
