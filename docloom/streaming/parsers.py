"""Answers that arrive piece by piece, parsed as they come: each key's state is where its parser stands, not what it has read."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# The marks around an item and the labels of its fields, as answers are asked to write them.
OPEN, CLOSE = "<<<FAQ", ">>>"
LABELS = {"근거:": "evidence", "질문:": "question", "답변:": "answer"}
# Fixed value: the name of the object whose pairs are read.
UPDATES = '"updates"'

EVENTS = "key string, at long, kind string, name string, text string"


def _item_events(fields: dict) -> list[tuple]:
    return [("item", None, json.dumps({n: fields.get(n, "") for n in LABELS.values()}, ensure_ascii=False))]


class ItemParser:
    """Items between marks, a label a line: their fields as they end, the answer as it grows, and each item whole.

    Events are (kind, name, text): ``field`` with a field's name, ``delta``
    with what is new of an answer, ``item`` with the item as JSON. Text outside items is
    passed over. An item that isn't closed ends where the next one opens, or with the answer. The state
    is the line at hand and the fields of the item at hand.
    """

    start = {"line": "", "inside": False, "field": "", "fields": {}, "sent": 0}

    @classmethod
    def feed(cls, state: dict, text: str) -> tuple[dict, list[tuple]]:
        s, events = {**state, "fields": dict(state["fields"])}, []
        *whole, rest = text.replace("\r", "").split("\n")
        for line in whole:
            s["line"] += line
            events += cls._line(s)
            s["line"] = ""
        s["line"] += rest
        head = s["line"].lstrip()
        if s["inside"] and (label := next((k for k in LABELS if head.startswith(k)), None)) and LABELS[label] == "answer":
            events += cls._grown(s, head[len(label) :].strip())  # blanks at its end may be the end
        return s, events

    @classmethod
    def finish(cls, state: dict) -> list[tuple]:
        s = {**state, "fields": dict(state["fields"])}
        events = cls._line(s) if s["line"] else []
        return events + (_item_events(s["fields"]) if s["inside"] else [])

    @staticmethod
    def _grown(s: dict, answer: str) -> list[tuple]:
        new, s["sent"] = answer[s["sent"] :], max(s["sent"], len(answer))
        return [("delta", "answer", new)] if new else []

    @classmethod
    def _line(cls, s: dict) -> list[tuple]:
        line = s["line"].strip()
        opens, closes = line.startswith(OPEN), line.startswith(CLOSE)
        if opens or (closes and s["inside"]):
            ended = _item_events(s["fields"]) if s["inside"] else []
            s.update(inside=opens, field="", fields={}, sent=0)
            return ended
        if not s["inside"]:
            return []
        label = next((k for k in LABELS if line.startswith(k)), None)
        if label:
            s["field"], value = LABELS[label], line[len(label) :].strip()
            s["fields"][s["field"]] = value
            return cls._grown(s, value) if s["field"] == "answer" else [("field", s["field"], value)]
        if s["field"] == "answer" and line:  # an answer over several lines is one
            s["fields"]["answer"] = f"{s['fields'].get('answer', '')} {line}".strip()
            return cls._grown(s, s["fields"]["answer"])
        return []


class PairParser:
    """The pairs of the object ``"updates"`` in JSON, each once it is closed: a number may still grow, so a comma or brace must follow.

    Events are (``pair``, name, value as JSON). What comes before the object is
    matched letter by letter and not kept; what isn't of its shape ends the
    reading. The state is the pair at hand.
    """

    start = {"phase": "seek", "seen": 0, "name": "", "value": "", "depth": 0, "quoted": False, "escaped": False}

    @classmethod
    def feed(cls, state: dict, text: str) -> tuple[dict, list[tuple]]:
        s, events = dict(state), []
        for c in text:
            while getattr(cls, "_" + s["phase"])(s, c, events):
                pass  # a phase that ended with this character hands it to the next
        return s, events

    @staticmethod
    def finish(state: dict) -> list[tuple]:
        return []

    @staticmethod
    def _seek(s: dict, c: str, events: list) -> bool:
        n = s["seen"]
        if n < len(UPDATES):
            s["seen"] = n + 1 if c == UPDATES[n] else int(c == UPDATES[0])
        elif c.isspace():
            s["seen"] = max(n, len(UPDATES) + 1) if n <= len(UPDATES) + 1 else n
        elif n <= len(UPDATES) + 1 and c == ":":
            s["seen"] = len(UPDATES) + 2
        elif n == len(UPDATES) + 2 and c == "{":
            s["phase"] = "between"
        else:  # the last quote may have been a first one
            s["seen"] = 2 if n == len(UPDATES) and c == UPDATES[1] else int(c == UPDATES[0])
        return False

    @staticmethod
    def _between(s: dict, c: str, events: list) -> bool:
        if c == '"':
            s.update(phase="name", name=c, escaped=False)
        elif c != "," and not c.isspace():
            s["phase"] = "done"
        return False

    @staticmethod
    def _name(s: dict, c: str, events: list) -> bool:
        s["name"] += c
        if c == '"' and not s["escaped"]:
            s["phase"] = "colon"
        s["escaped"] = c == "\\" and not s["escaped"]
        return False

    @staticmethod
    def _colon(s: dict, c: str, events: list) -> bool:
        if not c.isspace():
            s["phase"] = "first" if c == ":" else "done"
        return False

    @staticmethod
    def _first(s: dict, c: str, events: list) -> bool:
        if not c.isspace():
            s.update(phase="value", value=c, quoted=c == '"', escaped=False, depth=int(c in "{["))
        return False

    @classmethod
    def _value(cls, s: dict, c: str, events: list) -> bool:
        if s["quoted"]:
            s["value"] += c
            if c == '"' and not s["escaped"]:
                s["quoted"] = False
                s["phase"] = "value" if s["depth"] else "closed"
            s["escaped"] = c == "\\" and not s["escaped"]
        elif s["depth"]:
            s["value"] += c
            s["quoted"] = c == '"'
            s["depth"] += (c in "{[") - (c in "}]")
            s["phase"] = "value" if s["depth"] else "closed"
        elif c in ",}" or c.isspace():
            s["phase"] = "closed"
            return True
        else:
            s["value"] += c
        return False

    @staticmethod
    def _closed(s: dict, c: str, events: list) -> bool:
        if c.isspace():
            return False
        try:
            events.append(("pair", json.loads(s["name"]), json.dumps(json.loads(s["value"]), ensure_ascii=False)))
        except ValueError:
            s["phase"] = "done"
            return False
        s.update(phase="between", name="", value="")
        return True

    @staticmethod
    def _done(s: dict, c: str, events: list) -> bool:
        return False


PARSERS = {"items": ItemParser, "pairs": PairParser}


class _Pieces(StatefulProcessor):
    """A key's parser and the pieces that came before their turn; both go when nothing has come for ``ttl``."""

    def __init__(self, parser: str, ttl: int):
        self.parser, self.ttl = parser, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("parser", "next long, events long, state string", self.ttl)
        self.early = handle.getMapState("early", "seq long", "text string", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        following, n, state = self.at.get() if self.at.exists() else (0, 0, None)
        for frame in rows:
            for seq, text in zip(frame["seq"].tolist(), frame["text"].tolist(), strict=True):
                if seq >= following and not self.early.containsKey((seq,)):
                    self.early.updateValue((seq,), (text,))
        parser = PARSERS[self.parser]
        state, events, ended = parser.start if state is None else json.loads(state), [], False
        while not ended and self.early.containsKey((following,)):
            (text,) = self.early.getValue((following,))
            self.early.removeKey((following,))
            following += 1
            if text is None:
                events += parser.finish(state)
                ended = True
            else:
                state, some = parser.feed(state, text)
                events += some
        if ended:  # a number that no piece reaches keeps what comes late out, until the state expires
            self.early.clear()
            following = 1 << 62
        self.at.update((following, n + len(events), json.dumps(state if not ended else parser.start, ensure_ascii=False)))
        yield pd.DataFrame([(key[0], n + i, *e) for i, e in enumerate(events)], columns=["key", "at", "kind", "name", "text"])

    def close(self) -> None:
        pass


def _parsed(frames: Iterator[pd.DataFrame], parser) -> Iterator[pd.DataFrame]:
    """A table's pieces, sorted by key and number, through the same parsers."""
    key, state, following, n, open_ = None, None, 0, 0, False

    def end() -> list[tuple]:
        return parser.finish(state) if open_ else []

    for frame in frames:
        out = []
        for k, seq, text in zip(frame["key"].tolist(), frame["seq"].tolist(), frame["text"].tolist(), strict=True):
            if k != key or state is None:
                out += [(key, n + i, *e) for i, e in enumerate(end())]
                key, state, following, n, open_ = k, parser.start, 0, 0, True
            if seq != following or not open_:  # again, or after a gap or the end
                continue
            following += 1
            if text is None:
                events, open_ = parser.finish(state), False
            else:
                state, events = parser.feed(state, text)
            out += [(key, n + i, *e) for i, e in enumerate(events)]
            n += len(events)
        yield pd.DataFrame(out, columns=["key", "at", "kind", "name", "text"])
    yield pd.DataFrame([(key, n + i, *e) for i, e in enumerate(end())], columns=["key", "at", "kind", "name", "text"])


def parse_pieces(pieces: DataFrame, key: str, seq: str, text: str, parser: str = "items", ttl_seconds: int = 3600) -> DataFrame:
    """(key, at, kind, name, text): what the parser (``items`` or ``pairs``) tells of each key's pieces, as soon as they allow it.

    Pieces are numbered from 0; one that comes early waits, one that comes again
    is dropped, and a null text ends its key. How the text is cut shows only in how
    answers are parted into deltas. On a stream a key's state is its parser's place and the pieces that
    wait, and it is dropped once ``ttl_seconds`` have passed without any: a missing piece holds nothing for ever. A
    table's pieces are sorted and streamed, and its keys end with their last piece.

    Null keys are a key; pieces without a number are dropped, as they have no place.
    """
    name = F.col(key).cast("string")
    rows = pieces.select(name.alias("key"), F.col(seq).cast("long").alias("seq"), F.col(text).cast("string").alias("text")).where("seq >= 0")
    if not pieces.isStreaming:
        made = PARSERS[parser]
        return rows.repartition("key").sortWithinPartitions("key", "seq", "text").mapInPandas(lambda frames: _parsed(frames, made), EVENTS)
    spark = pieces.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the only one with several states a key
    return rows.groupBy("key").transformWithStateInPandas(_Pieces(parser, ttl_seconds * 1000), EVENTS, "Append", "ProcessingTime")


class _Sessions(StatefulProcessor):
    """A session's last items, and a timer that clears it."""

    def __init__(self, most: int, ttl: int):
        self.most, self.ttl = most, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", "item string")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [x for (x,) in self.items.get()] if self.items.exists() else []
        for frame in rows:
            for item in frame.sort_values("seq")["item"].tolist():
                held = [x for x in held if x != item] + [item]
        held = held[-self.most :]
        self.items.put([(x,) for x in held])
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        due = timerValues.getCurrentProcessingTimeInMs() + self.ttl
        self.handle.registerTimer(due)
        self.due.update((due,))
        yield pd.DataFrame({"key": [key[0]], "items": [held], "expired": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.items.clear()
        self.due.clear()
        yield pd.DataFrame({"key": [key[0]], "items": [[]], "expired": [True]})

    def close(self) -> None:
        pass


def keep_items(saves: DataFrame, key: str, seq: str, item: str, most: int = 5, ttl_seconds: int = 3600) -> DataFrame:
    """(key, items, expired): a session's last ``most`` distinct items after each batch of saves, and once, empty, when it expires.

    A session expires when nothing was saved to it for ``ttl_seconds``; its
    state is gone then, and what is saved later starts anew. A saved item that is
    there already moves to the end. Streams only: a table's last items are ``ordered.keep_last``.
    """
    saves.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = saves.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), F.col(item).cast("string").alias("item"))
    return rows.groupBy("key").transformWithStateInPandas(_Sessions(most, ttl_seconds * 1000), "key string, items array<string>, expired boolean", "Append", "ProcessingTime")
