"""Reasoning blocks taken out of streams of tokens, whose tags may be split between tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OPEN, CLOSE = "<think>", "</think>"


def held_back(text: str, tag: str) -> int:
    """Length of the longest end of the text that may be the beginning of the tag."""
    return next((n for n in range(min(len(tag) - 1, len(text)), 0, -1) if tag.startswith(text[-n:])), 0)


def step(waiting: str, inside: bool, token: str) -> tuple[str, str, bool]:
    """(visible, waiting, inside) after a token."""
    waiting += token
    visible = []
    while True:
        before, tag, after = waiting.partition(CLOSE if inside else OPEN)
        if tag:
            visible += [] if inside else [before]
            waiting, inside = after, not inside
            continue
        keep = held_back(waiting, CLOSE if inside else OPEN)
        visible += [] if inside else [waiting[: len(waiting) - keep]]
        return "".join(visible), waiting[len(waiting) - keep :], inside


def visible_text(tokens: list[str]) -> str:
    """What is left of a finished stream."""
    out, waiting, inside = [], "", False
    for t in tokens:
        shown, waiting, inside = step(waiting, inside, t)
        out.append(shown)
    return "".join(out) + ("" if inside else waiting)


_OUT = "session_id string, seq bigint, visible string"


def visible_stream(tokens: DataFrame) -> DataFrame:
    """A streaming table (session_id, seq, token) as (session_id, seq, visible).

    State of a session is what waits for the rest of a tag and whether a block is open. A null
    token ends the session: what waits is shown and the state dropped. Tokens are taken in the
    order of seq within each micro-batch.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, inside = state.get if state.exists else ("", False)
        rows, ended = [], False
        for r in pd.concat(list(parts)).sort_values("seq").itertuples(index=False):
            if r.token is None or r.token != r.token:
                rows.append((key[0], r.seq, "" if inside else waiting))
                waiting, inside, ended = "", False, True
            else:
                shown, waiting, inside = step(waiting, inside, r.token)
                rows.append((key[0], r.seq, shown))
                ended = False
        if ended:
            state.remove()
        else:
            state.update((waiting, inside))
        yield pd.DataFrame(rows, columns=["session_id", "seq", "visible"])

    return tokens.groupBy("session_id").applyInPandasWithState(run, _OUT, "waiting string, inside boolean", "append", GroupStateTimeout.NoTimeout)


def visible_tokens(tokens: DataFrame) -> DataFrame:
    """The same over a finished table.

    The tokens of a session stream by in order; what is kept of it is its state alone, so a
    session of any length takes no more memory than a batch.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, waiting, inside = None, "", False
        for part in parts:
            shown = []
            for key, token in zip(part["session_id"], part["token"]):
                if key != session:
                    session, waiting, inside = key, "", False
                if token is None or token != token:
                    shown.append("" if inside else waiting)
                    waiting, inside = "", False
                else:
                    out, waiting, inside = step(waiting, inside, token)
                    shown.append(out)
            yield pd.DataFrame({"session_id": part["session_id"], "seq": part["seq"], "visible": pd.Series(shown, index=part.index, dtype=object)})

    ordered = tokens.select("session_id", "seq", "token").repartition("session_id").sortWithinPartitions("session_id", "seq")
    return ordered.mapInPandas(run, _OUT)
