"""Conversations: history, follow-ups, topical relevance, prompt packing and sessions.

Messages are rows (session_id, turn, role, content); turns are ordered within a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text as tx
from quillon.providers import GenerationProvider, generate

# Phrases that refer to what was said before.
FOLLOW_UPS = (
    "explique melhor", "e sobre", "e quanto", "nos estavamos falando", "nós estávamos falando", "você disse", "você mencionou", "continue", "mais detalhes",
    "aprofunde", "detalhe", "e a", "e o", "como assim", "o que você quis dizer", "pode explicar", "como foi", "o que foi", "quem foi", "quando foi", "onde foi",
    "por que", "porque", "qual foi", "quais foram", "me fale mais", "conte mais", "explique", "esclareça", "desenvolva",
)
# Subject words that count as context without a capital.
SUBJECT_WORDS = (
    "revolução revolucao guerra governo industrial trabalhadores economia política politica estado brasil brasileiro brasileira período periodo ditadura "
    "democracia constitucional provisório provisorio"
).split()
SEPARATOR = "\n\n---\n\n"


#: Turns of a session that one task lines up.
STRETCH = 4096


def trim_history(messages: DataFrame, turns: int) -> DataFrame:
    """The last ``2 * turns`` user and assistant messages of every session.

    The planner turns the bound into a limit before the exchange, so a long session sends no
    more than its last messages from each task.
    """
    said = messages.where(F.col("role").isin("user", "assistant"))
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn")))
    return said.withColumn("__back", back).where(F.col("__back") <= 2 * turns).drop("__back")


def with_earlier(messages: DataFrame) -> DataFrame:
    """The messages with ``earlier``, how many of their session come before.

    Counted by stretches of turns first and then within each, without the messages' content.
    """
    slim = messages.select("session_id", "turn").withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    sizes = slim.groupBy("session_id", "stretch").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("session_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("session_id").alias("__s"), F.col("stretch").alias("__b"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    counted = messages.withColumn("__stretch", F.floor(F.col("turn") / STRETCH)).withColumn("__within", F.row_number().over(Window.partitionBy("session_id", "__stretch").orderBy("turn")) - 1)
    same = counted["session_id"].eqNullSafe(bases["__s"]) & (counted["__stretch"] == bases["__b"])
    return counted.join(bases, same).withColumn("earlier", (F.col("base") + F.col("__within")).cast("int")).drop("__stretch", "__within", "__s", "__b", "base")


def is_follow_up(message: Column, earlier: Column) -> Column:
    """Whether a message with so many earlier ones refers to them."""
    return (earlier >= 2) & F.coalesce(tx.contains_any(F.lower(message), FOLLOW_UPS), F.lit(False))


def follow_ups(messages: DataFrame) -> DataFrame:
    """The user messages with ``earlier`` (messages before) and ``follow_up``."""
    counted = with_earlier(messages).where(F.col("role") == "user")
    return counted.withColumn("follow_up", is_follow_up(F.col("content"), F.col("earlier")))


def history_context(messages: DataFrame, recent: int = 4, answers: int = 2, words: int = 8) -> DataFrame:
    """(session_id, context): subject words of the last answers that are no refusals.

    Capitalised words and subject words of five characters or more, in order of appearance.
    """
    w = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    late = messages.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= recent)
    refused = tx.contains_any(F.coalesce(F.col("content"), F.lit("")), (tx.REFUSAL, tx.OLD_REFUSAL))
    told = late.where((F.col("role") == "assistant") & F.col("content").isNotNull() & ~refused)
    told = told.withColumn("__a", F.row_number().over(w)).where(F.col("__a") <= answers)
    found = F.transform(tx.words_of(F.col("content")), lambda x: F.regexp_replace(x, r"^[.,;:!?\"()\[\]]+|[.,;:!?\"()\[\]]+$", ""))
    subject = F.array(*[F.lit(x) for x in SUBJECT_WORDS])
    kept = F.filter(found, lambda x: (F.length(x) >= 5) & (x.rlike(r"^\p{Lu}") | F.array_contains(subject, F.lower(x))))
    lists = F.array_sort(F.collect_list(F.struct("turn", kept.alias("ws"))))
    flat = F.array_distinct(F.flatten(F.transform(lists, lambda s: s["ws"])))
    return told.groupBy("session_id").agg(F.array_join(F.slice(flat, 1, words), " ").alias("context"))


def topically_relevant(queries: DataFrame, results: DataFrame, least: float = 0.15) -> DataFrame:
    """(qid, relevant): whether the results of a query share enough of its keywords.

    ``queries`` (qid, query), ``results`` (qid, text). Queries without keywords are relevant;
    so are those one of whose capitalised words stands in a result. The comparison is made
    row by row and only its outcome aggregated, so no list of words is gathered.
    """
    asked = queries.select("qid", tx.topic_keywords(F.col("query")).alias("kw"), F.transform(F.filter(tx.words_of(F.col("query")), lambda x: x.rlike(r"^\p{Lu}") & (F.length(x) > 3)), F.lower).alias("names"))
    capital = F.transform(F.filter(tx.words_of(F.col("text")), lambda x: x.rlike(r"^\p{Lu}") & (F.length(x) > 3)), F.lower)
    pool = results.select("qid", F.array_union(tx.topic_keywords(F.col("text")), capital).alias("words"))
    joined = asked.join(pool, "qid", "left")
    words = F.coalesce("words", F.array().cast("array<string>"))
    each = joined.select("qid", "kw", F.coalesce(F.arrays_overlap("names", words), F.lit(False)).alias("named"), F.array_intersect("kw", words).alias("shared"))
    named = each.groupBy("qid").agg(F.max("named").alias("named"), F.first(F.size("kw")).alias("n"))
    shared = each.select("qid", F.explode("shared").alias("w")).distinct().groupBy("qid").agg(F.count("*").alias("hits"))
    n = F.coalesce("n", F.lit(0))
    verdict = (n <= 0) | F.coalesce("named", F.lit(False)) | (F.coalesce("hits", F.lit(0)) / F.greatest(n, F.lit(1)) >= least)
    return named.join(shared, "qid", "left").select("qid", verdict.alias("relevant"))


def pack_context(results: DataFrame, longest: int = 3500, min_chars: int = 80, least_rest: int = 150) -> DataFrame:
    """(qid, rank, status, entry) of the rows that enter a prompt, in order.

    ``results`` (qid, rank, text, source, breadcrumb, score). Rows under ``min_chars`` are left
    out unless the query has no others. Entries are taken while they fit; the first that does
    not is cut to the rest if that is more than ``least_rest`` characters, and ends the context.
    """
    long_enough = F.length("text") >= min_chars
    usable = results.withColumn("__any", F.max(long_enough).over(Window.partitionBy("qid"))).where(long_enough | ~F.col("__any"))
    base = F.regexp_extract(F.coalesce("source", F.lit("desconhecido")), r"[^/]*$", 0)
    crumb = F.when(F.coalesce("breadcrumb", F.lit("")) != "", F.concat(F.lit(" | "), "breadcrumb")).otherwise("")
    header = F.concat(F.lit("[fonte: "), base, crumb, F.lit(" | relevância: "), F.format_string("%.2f", F.col("score").cast("double")), F.lit("]"))
    entries = usable.withColumn("__e", F.concat(header, F.lit("\n"), tx.strip(F.col("text"))))
    so_far = F.sum(F.length("__e")).over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    entries = entries.withColumn("__sum", so_far).withColumn("__rest", F.lit(longest) - (F.col("__sum") - F.length("__e")))
    fits = F.col("__sum") <= longest
    first_over = (F.col("__sum") > longest) & (F.col("__rest") >= 0) & (F.col("__rest") > least_rest)
    return entries.where(fits | first_over).select(
        "qid", "rank", F.when(fits, "whole").otherwise("cut").alias("status"), F.when(fits, F.col("__e")).otherwise(F.concat(F.expr("substring(__e, 1, __rest)"), F.lit("…"))).alias("entry")
    )


def context_blocks(packed: DataFrame) -> DataFrame:
    """(qid, context): the packed entries of a query as one text."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "entry")))
    return packed.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda x: x["entry"]), SEPARATOR).alias("context"))


def with_titles(rows: DataFrame, provider: GenerationProvider, message: str, system: str = "") -> DataFrame:
    """The rows with ``title``: a model's short title of the message, the cut message where the model fails or says nothing."""
    prompt = F.concat(F.lit(f"{system}\n\n"), F.coalesce(message, F.lit(""))) if system else F.coalesce(message, F.lit(""))
    told = tx.clean_title(generate(provider, prompt, safe=True))
    return rows.withColumn("title", F.coalesce(F.nullif(told, F.lit("")), tx.clean_title(F.col(message))))


def question_messages(texts: Column, system: str) -> Column:
    """Messages that ask a model for a question about one or several texts."""
    numbered = F.transform(texts, lambda x, i: F.concat(F.lit("TRECHO "), (i + 1).cast("string"), F.lit(":\n"), x))
    body = F.when(F.size(texts) == 1, F.get(texts, F.lit(0))).otherwise(F.array_join(numbered, "\n\n"))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), body.alias("content")))


def fold_system(messages: Column) -> Column:
    """Messages for models without a system role: its text goes before the first user message."""
    system = F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: m["content"]), "\n\n")
    others = F.filter(messages, lambda m: m["role"] != "system")
    first = F.array_position(F.transform(others, lambda m: m["role"]), F.lit("user"))
    joined = lambda m, i: F.struct(m["role"].alias("role"), F.when((system != "") & (i + 1 == first), F.concat(system, F.lit("\n\n"), m["content"])).otherwise(m["content"]).alias("content"))
    return F.transform(others, joined)
