"""Answers of turns as a stream of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def turn_events(answers: DataFrame) -> DataFrame:
    """(session_id, seq, event) rows of JSON for answered turns (session_id, answer, title, error).

    A failed turn has one error event. Others have a token event for each word, a done event
    and, where there is a title, a title event.
    """
    words = F.split(F.coalesce("answer", F.lit("")), r"(?<=\s)(?=\S)")
    event = lambda kind, **parts: F.to_json(F.struct(F.lit(kind).alias("type"), *[v.alias(k) for k, v in parts.items()]))
    tokens = F.transform(words, lambda w: event("token", text=w))
    titled = F.when(F.col("title").isNotNull(), F.array(event("title", title=F.col("title")))).otherwise(F.array().cast("array<string>"))
    good = F.concat(tokens, F.array(event("done")), titled)
    failed = F.array(event("error", message=F.col("error")))
    return answers.select("session_id", F.posexplode(F.when(F.col("error").isNotNull(), failed).otherwise(good)).alias("seq", "event"))


def write_events(turns: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, until_done: bool = False):
    """Start a query that answers each micro-batch of turns and writes its events as JSON lines.

    A batch that is run again overwrites its own folder, so no event is written twice. With
    ``until_done`` the query ends when it has taken what there is.
    """

    def batch(rows: DataFrame, number: int) -> None:
        turn_events(answer(rows)).write.mode("overwrite").json(f"{path}/batch={number}")

    writer = turns.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if until_done else writer).start()
