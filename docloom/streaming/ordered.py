"""Stateful streams: ordered emission, items completed piece by piece, sessions that expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "next long, held array<struct<seq:long,text:string>>, rest string"


def _arrivals(frames: Iterator[pd.DataFrame], state: GroupState) -> tuple[int, dict[int, str], str]:
    """State with the new pieces put in; a sequence number that came before is ignored."""
    start, held, rest = state.get if state.exists else (0, [], "")
    waiting = {h["seq"]: h["text"] for h in held}
    for frame in frames:
        for seq, text in zip(frame["seq"], frame["text"], strict=True):
            if seq >= start:
                waiting.setdefault(int(seq), text or "")
    return start, waiting, rest


def _ready(start: int, waiting: dict[int, str]) -> list[tuple[int, str]]:
    out = []
    while start in waiting:
        out.append((start, waiting.pop(start)))
        start += 1
    return out


def _keep(state: GroupState, start: int, waiting: dict[int, str], rest: str) -> None:
    state.update((start, [{"seq": k, "text": v} for k, v in sorted(waiting.items())], rest))


def emit_in_order(pieces: DataFrame, key: str, seq: str, text: str) -> DataFrame:
    """(key, seq, text) with each key's pieces in the order of their numbers from 0.

    A piece that comes early waits in the key's state for those before it; one
    that comes again is dropped.
    """

    def step(k, frames, state):
        start, waiting, _ = _arrivals(frames, state)
        out = _ready(start, waiting)
        _keep(state, start + len(out), waiting, "")
        yield pd.DataFrame([(k[0], *x) for x in out], columns=["key", "seq", "text"])

    rows = pieces.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), F.col(text).alias("text"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, seq long, text string", STATE, "append", GroupStateTimeout.NoTimeout)


def take_objects(text: str) -> tuple[list[str], str]:
    """The complete top-level JSON objects of a text, and what is left from the first incomplete one on."""
    out, depth, begin, quoted, escaped = [], 0, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            escaped, quoted = c == "\\" and not escaped, c != '"' or escaped
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            begin = i if not depth else begin
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                out.append(text[begin : i + 1])
    return out, text[begin:] if depth else ""


def completed_items(pieces: DataFrame, key: str, seq: str, text: str) -> DataFrame:
    """(key, item): each JSON object of a key's text as soon as its last piece is there, whatever the cuts."""

    def step(k, frames, state):
        start, waiting, rest = _arrivals(frames, state)
        ready = _ready(start, waiting)
        items, rest = take_objects(rest + "".join(t for _, t in ready))
        _keep(state, start + len(ready), waiting, rest)
        yield pd.DataFrame({"key": [k[0]] * len(items), "item": items})

    rows = pieces.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), F.col(text).alias("text"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, item string", STATE, "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, started, ended, n): runs of events no further apart than ``gap``; works on tables and streams.

    On a stream a session is given out, and its state dropped, once the
    watermark (``late`` behind the newest event) has passed its end.
    """
    rows = events.withWatermark(at, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(at, gap).alias("w"), F.col(key)).agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count(F.lit(1)).alias("n"))
    return out.select(key, "started", "ended", "n")
